"""Graph embeddings: normalised adjacency, propagation, training and dot-product search."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators.similarity import degrees
from larder.session import durable


def normalised_edges(edges: DataFrame) -> DataFrame:
    """Both directions of distinct (user, item) edges with weight 1 / sqrt(deg user * deg item), nodes prefixed."""
    w = edges.join(degrees(edges, "user").select("user", F.col("deg").alias("du")), "user").join(degrees(edges, "item").select("item", F.col("deg").alias("di")), "item")
    e = w.select(F.concat(F.lit("u:"), "user").alias("src"), F.concat(F.lit("i:"), "item").alias("dst"), (1.0 / F.sqrt(F.col("du").cast("double") * F.col("di"))).alias("w"))
    both = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("t")), F.struct(F.col("dst").alias("s"), F.col("src").alias("t"))))
    return e.select(both.alias("p"), "w").select(F.col("p.s").alias("src"), F.col("p.t").alias("dst"), "w")


def initial_vectors(adj: DataFrame, dims: int) -> DataFrame:
    """A fixed start: component j of a node from the codes of its name."""
    code = F.ascii(F.substring("node", -1, 1)) * 31 + F.ascii(F.substring("node", -2, 1)) * 17 + F.length("node")
    return adj.select(F.col("src").alias("node")).distinct().withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: F.pmod(code * (j + 3) * 37, F.lit(101)) / 101.0 - 0.5))


def propagate(adj: DataFrame, start: DataFrame, layers: int, dims: int) -> DataFrame:
    """Mean over layers 0..L of repeated weighted sums over the neighbours.

    A layer is one join and one aggregation with a sum per component, combined
    map-side; each layer is cut durably, so the plan does not grow.
    """
    total, layer = start, start
    for _ in range(layers):
        msgs = adj.join(layer, adj["dst"] == layer["node"]).select("src", *[(F.col("w") * F.get("v", F.lit(j))).alias(f"x{j}") for j in range(dims)])
        layer = durable(msgs.groupBy("src").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(dims)]).select(F.col("src").alias("node"), F.array(*[f"x{j}" for j in range(dims)]).alias("v")))
        total = total.unionByName(layer)
    return total.groupBy("node").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"x{j}") for j in range(dims)]).select("node", F.transform(F.array(*[f"x{j}" for j in range(dims)]), lambda x: x / (layers + 1.0)).alias("v"))


#: Edges of a block of users that one task trains, and epochs between two averages of the items.
BLOCK_EDGES, LOCAL_EPOCHS = 50_000, 10
_PART = "block int, state binary, item string, w long, v array<float>"
_PARTS = pa.schema([("block", pa.int32()), ("state", pa.binary()), ("item", pa.string()), ("w", pa.int64()), ("v", pa.list_(pa.float32()))])
#: Weighted components are summed as whole multiples of this, so that a sum does not depend on its order.
_UNIT = 2.0**-30


def train(edges: DataFrame, dims: int = 16, epochs: int = 20, rate: float = 0.05, decay: float = 1e-4, batch: int = 1024, seed: int = 7) -> DataFrame:
    """(node, v) trained by pairwise ranking loss with uniform negatives and Adam, seeded, over all edges.

    Users are cut into blocks of about ``BLOCK_EDGES`` edges by hash; a task trains
    the users of a block and a copy of the items for ``LOCAL_EPOCHS`` epochs over all
    edges of the block. Then items are averaged over the blocks, weighted by how
    often each was met; Adam starts anew, so that only vectors (as floats) are kept
    between. Every node gets a vector. Only the items (one vector each)
    pass the driver.
    """
    spark = edges.sparkSession
    blocks = max(1, -(-edges.count() // BLOCK_EDGES))

    def gather(group: pa.Table) -> pa.Table:
        pairs = sorted(set(zip(group["user"].to_pylist(), group["item"].to_pylist())))
        return pa.Table.from_pylist([{"block": group["block"][0].as_py(), "state": zlib.compress(pickle.dumps((pairs, None)), 1)}], _PARTS)

    named = edges.select("user", "item").withColumn("block", F.pmod(F.xxhash64("user"), F.lit(blocks)).cast("int"))
    parts = durable(named.groupBy("block").applyInArrow(gather, _PART))
    names = [r.item for r in edges.select("item").distinct().orderBy("item").collect()]
    if not names:
        return spark.createDataFrame([], "node string, v array<double>")
    table = np.random.default_rng(seed).normal(0, 0.1, (len(names), dims))
    for done in range(0, epochs, LOCAL_EPOCHS):
        shared = spark.sparkContext.broadcast((names, table))
        parts = durable(parts.filter("state is not null").mapInArrow(_round(shared, dims, min(LOCAL_EPOCHS, epochs - done), done, rate, decay, batch, seed), _PART))
        total = parts.filter("item is not null").groupBy("item").agg(F.sum("w").alias("w"), *[F.sum((F.get("v", F.lit(j)).cast("double") * F.col("w") / _UNIT).cast("long")).alias(f"x{j}") for j in range(dims)])
        mean = total.select("item", F.array(*[F.col(f"x{j}") * _UNIT / F.col("w") for j in range(dims)]).alias("v")).orderBy("item").toArrow()
        table = np.array(mean["v"].combine_chunks().flatten()).reshape(len(names), dims)
        shared.unpersist()

    def users(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for state in b.column(0).to_pylist():
                pairs, kept = pickle.loads(zlib.decompress(state))
                own = sorted({u for u, _ in pairs})
                e = _start(seed, own, dims) if kept is None else kept
                yield pa.RecordBatch.from_arrays([pa.array([f"u:{u}" for u in own]), pa.array(e.tolist(), pa.list_(pa.float64()))], names=["node", "v"])

    items = spark.createDataFrame(pa.table({"node": [f"i:{x}" for x in names], "v": pa.array(table.tolist(), pa.list_(pa.float64()))}))
    return parts.filter("state is not null").select("state").mapInArrow(users, "node string, v array<double>").unionByName(items)


def _start(seed: int, users: list, dims: int) -> np.ndarray:
    return np.random.default_rng([seed, zlib.crc32(str(users[0]).encode())]).normal(0, 0.1, (len(users), dims))


def _round(shared, dims: int, epochs: int, done: int, rate: float, decay: float, batch: int, seed: int):
    """Some epochs of every block: its new state, and the vectors of the items it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        at_i = {x: k for k, x in enumerate(names)}
        for b in batches:
            for block, state in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pairs, kept = pickle.loads(zlib.decompress(state))
                users = sorted({x for x, _ in pairs})
                at_u = {x: k for k, x in enumerate(users)}
                u, i = np.array([at_u[x] for x, _ in pairs]), len(users) + np.array([at_i[x] for _, x in pairs])
                size = len(users) + len(names)
                own = _start(seed, users, dims) if kept is None else kept
                m, v, t = np.zeros((size, dims)), np.zeros((size, dims)), 0
                e, met = np.concatenate([own, table]), np.zeros(size, np.int64)
                rng = np.random.default_rng([seed, block, done])
                for _ in range(epochs):
                    order = rng.permutation(len(u))
                    for lo in range(0, len(order), batch):
                        a, p = u[order[lo : lo + batch]], i[order[lo : lo + batch]]
                        q = len(users) + rng.integers(0, len(names), len(a))
                        x = (e[a] * (e[p] - e[q])).sum(axis=1)
                        s = -1 / (1 + np.exp(np.clip(x, -30, 30)))[:, None] / len(a)
                        # Gradients and moments of the nodes of the batch only.
                        node = np.concatenate([a, p, q])
                        each = np.concatenate([s * (e[p] - e[q]), s * e[a], -s * e[a]]) + decay * e[node] / len(a)
                        by = np.argsort(node, kind="stable")
                        n, first, often = np.unique(node[by], return_index=True, return_counts=True)
                        g = np.add.reduceat(each[by], first, axis=0)
                        met[n] += often
                        t += 1
                        m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
                        e[n] -= rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
                yield pa.RecordBatch.from_pylist([{"block": block, "state": zlib.compress(pickle.dumps((pairs, e[: len(users)].astype(np.float32))), 1)}], _PARTS)
                seen = np.flatnonzero(met[len(users) :])
                none = pa.nulls(len(seen))
                w, x = met[len(users) :][seen], e[len(users) :][seen]
                yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.binary()), pa.array([names[k] for k in seen], pa.string()), pa.array(w), pa.array(x.tolist(), pa.list_(pa.float32()))], schema=_PARTS)

    return run


#: Query vectors taken in one block; larger query sets are taken in several.
QUERY_BLOCK = 20_000


def top_by_dot(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """(query, item, score, rank): the k items with the largest dot product of every query vector.

    ``queries`` and ``items`` hold id and v. Blocks of queries are broadcast to the
    items, which stay where they are; each task keeps the k best of its batches
    by a matrix product, and only these are merged. Vectors with nulls or of
    another length than the first query are left out.
    """
    ids = queries.filter("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-ids.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        own = ids.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        if not own.num_rows:
            continue
        one = _block(items, np.array(own["id"].to_pylist()), np.array(own["v"].to_pylist(), float), k, exclude_self)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query long, item long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "item"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _block(items: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
    shared = items.sparkSession.sparkContext.broadcast((ids, q))  # QUERY_BLOCK vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best_s, best_i = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == q.shape[1] and None not in v]
            for lo in range(0, len(rows), 2048):
                i = np.array([r[0] for r in rows[lo : lo + 2048]])
                s = q @ np.array([r[1] for r in rows[lo : lo + 2048]], float).T
                if exclude_self:
                    s[ids[:, None] == i[None, :]] = -np.inf
                s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, np.broadcast_to(i, s.shape)], axis=1)
                # Ties at the edge are kept by id: sort by rounded score, then id.
                order = np.lexsort((i, -np.round(s, 9)), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
        if best_s.shape[1]:
            ok = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best_s.shape)[ok]), pa.array(best_i[ok]), pa.array(best_s[ok])], names=["query", "item", "score"])

    return items.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, "query long, item long, score double")
