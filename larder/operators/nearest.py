"""The nearest entities of each query under Swing, cosine or Jaccard similarity, exactly and without an exchange of pairs.

Pairs are many more than edges, so none leaves the task that makes it. Queries are cut into blocks and all entities into
chunks; a cell (block, chunk) holds the packed edges of both and gives the k nearest of each of its queries in its chunk.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.similarity import ALPHA1, ALPHA2, BETA, degrees, top_similar
from larder.session import durable, shuffle_width

#: Edges of a chunk of entities and queries of a block, as one task holds them; copies of all edges made for parallelism alone.
CHUNK_EDGES, BLOCK_QUERIES, COPIES = 2_000_000, 1 << 16, 12
#: Elements of a chunk that are counted by classes of entities instead of pairs, and the rows from which one is.
HOT, HOT_ROWS = 8, 256
#: Pairs, and rows to be packed, that are held at once.
AT_ONCE = 1_000_000

_PACKED = pa.schema([("asked", pa.bool_()), ("part", pa.int32()), ("held", pa.binary())])


def nearest(edges: DataFrame, entity: str, shared: str, queries: DataFrame, k: int, measure: str) -> DataFrame:
    """(a, b, sim, rank): the ``k`` entities nearest to each of ``queries`` (a column ``entity``) among those that share
    an element with it, ties of the twelfth digit by b. ``measure`` is swing, cosine or jaccard as in ``similarity``.

    ``edges`` holds distinct (entity, shared), for cosine with a count n, and is read several times.
    """
    spark = edges.sparkSession
    chunks = max(1, -(-edges.count() // CHUNK_EDGES))
    asked = queries.select(entity).distinct()
    n = asked.count()
    blocks = max(1, -(-n // BLOCK_QUERIES), min(COPIES, -(-2 * spark.sparkContext.defaultParallelism // chunks), -(-n // 64)))
    own, other = {"swing": ("deg", None), "cosine": ("n", "n"), "jaccard": (None, None)}[measure]
    value = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(1)) if c else F.lit(1).cast("long")
    part = lambda seed, parts: F.pmod(F.xxhash64(F.col(entity), F.lit(seed)), F.lit(parts)).cast("int")

    items = durable(degrees(edges, shared).withColumn("id", F.monotonically_increasing_id()))
    named = edges.join(items, shared, "left").join(asked.withColumn("asked", F.lit(True)), entity, "left").filter(F.col(entity).isNotNull())
    rows = named.select(F.col(entity).alias("e"), F.coalesce("id", F.lit(-1)).alias("i"), value(own).alias("own"), value(other).alias("other"), F.coalesce("asked", F.lit(False)).alias("asked"), part(1, blocks).alias("block"), part(2, chunks).alias("chunk"))
    packed = rows.repartition(shuffle_width(spark), "e").sortWithinPartitions("e").mapInArrow(_pack, "asked boolean, part int, held binary")
    every = lambda parts, cell: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), cell)
    cell = F.when(F.col("asked"), every(chunks, lambda c: F.col("part") * chunks + c)).otherwise(every(blocks, lambda b: b * chunks + F.col("part")))
    cells = packed.select(F.explode(cell).alias("cell"), "asked", "held").repartitionById(blocks * chunks, "cell")
    kind = edges.schema[entity].dataType.simpleString()
    return top_similar(cells.mapInArrow(_search(k, measure), f"a {kind}, b {kind}, sim double"), k)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block or chunk as one compressed row: names, edges of each name, elements and values."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= AT_ONCE:
            yield from _packed(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from _packed(pa.Table.from_batches(held))


def _packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    every = np.ones(table.num_rows, dtype=bool)
    for asked, part, value, kept in ((True, "block", "own", table["asked"].to_numpy()), (False, "chunk", "other", every)):
        parts = table[part].to_numpy()
        for p in np.unique(parts[kept]):
            mine = table.filter(pa.array(kept & (parts == p)))
            names = mine["e"].combine_chunks().dictionary_encode()
            codes = names.indices.to_numpy()
            by = np.argsort(codes, kind="stable")
            state = names.dictionary, np.bincount(codes), mine["i"].to_numpy()[by], mine[value].to_numpy()[by]
            yield pa.RecordBatch.from_pydict({"asked": [asked], "part": [int(p)], "held": [zlib.compress(pickle.dumps(state), 1)]}, _PACKED)


class _Edges:
    """Edges of packed rows, entities numbered in the order of their names and sorted by number."""

    def __init__(self, held: list[bytes], measure: str) -> None:
        states = [pickle.loads(zlib.decompress(h)) for h in held]
        names = pa.chunked_array([s[0] for s in states]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(names.dictionary).to_numpy()
        self.names = names.dictionary.take(pa.array(order))
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        at = np.repeat(number[names.indices.to_numpy()], np.concatenate([s[1] for s in states]))
        by = np.argsort(at, kind="stable")
        self.at = at[by]
        self.item = np.concatenate([s[2] for s in states])[by]
        self.value = np.concatenate([s[3] for s in states])[by].astype(float)
        # Elements without a value are shared with nobody, but belong to the size.
        self.size = np.bincount(self.at, self.value**2 if measure == "cosine" else None, len(order)).astype(float)
        known = self.item >= 0
        self.at, self.item, self.value = self.at[known], self.item[known], self.value[known]
        self.scale = np.sqrt(self.size) if measure == "cosine" else (self.size + ALPHA1) ** -BETA if measure == "swing" else self.size


def _search(k: int, measure: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for cell, asked, held in zip(*(c.to_pylist() for c in batch.columns)):
                cells.setdefault(cell, ([], []))[0 if asked else 1].append(held)
        for cell in sorted(cells):
            own, other = cells.pop(cell)
            if own and other:
                yield from _cell(_Edges(own, measure), _Edges(other, measure), k, measure)

    return run


def _cell(own: _Edges, other: _Edges, k: int, measure: str) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest of each of ``own`` in ``other``.

    Products are made for all elements but the hot ones. An entity that shares only hot elements with a query has a
    similarity that follows from its counts of them and its size, so k + 1 (the query may be one) of each such class, the
    first by name, stand for all: those they stand for come after k others. Entities with further shared elements are
    only more similar than that, and are counted themselves.
    """
    n = len(other.names)
    by = np.argsort(other.item, kind="stable")
    item, b, value = other.item[by], other.at[by], other.value[by]
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, dtype=np.int64)
    known, length = item[first], np.diff(np.r_[first, len(item)])
    hot = np.argsort(-length, kind="stable")[:HOT]
    hot = hot[length[hot] >= HOT_ROWS]
    column = np.full(len(known), -1)
    column[hot] = np.arange(len(hot))
    counts = np.zeros((len(hot), n))
    for h, x in enumerate(hot):
        counts[h, b[first[x] : first[x] + length[x]]] = value[first[x] : first[x] + length[x]]
    # The first k + 1 by name of each class of counts of hot elements and size.
    some = np.flatnonzero(counts.any(axis=0)) if len(hot) else np.zeros(0, dtype=np.int64)
    keys = np.vstack([counts[:, some], other.size[some]])
    order = np.lexsort(keys)
    new = np.r_[True, (np.diff(keys[:, order]) != 0).any(axis=0)] if len(some) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))
    stand = some[order[np.arange(len(some)) - start <= k]]
    stand_counts, stand_scale = np.ascontiguousarray(counts[:, stand]), other.scale[stand]

    weight = 1.0 / (own.value + ALPHA2) if measure == "swing" else own.value
    spot = np.searchsorted(known, own.item)
    met = (spot < len(known)) & (known[np.minimum(spot, len(known) - 1)] == own.item) if len(known) else np.zeros(len(spot), dtype=bool)
    q, spot, weight = own.at[met], spot[met], weight[met]
    of = np.searchsorted(q, np.arange(len(own.names) + 1))
    many = np.where(column[spot] < 0, length[spot], 0)
    pairs = np.r_[0, np.cumsum(many)]
    self_at = pc.fill_null(pc.index_in(own.names, value_set=other.names), -1).to_numpy(zero_copy_only=False)
    # Similarities are ordered by their twelfth digit: what may be equal there is kept, whatever the scale of the query.
    least = 1.0 if measure == "jaccard" else own.scale.min() if measure == "swing" else 1.0 / own.scale.max()
    slack = 2e-12 / least

    def similar(raw, x, y):
        return raw * x * y if measure == "swing" else raw / (x * y) if measure == "cosine" else raw / (x + y - raw)

    standing: dict[tuple, np.ndarray] = {}

    def by_hot(columns, weights, x):
        """Those of the standing that may be among the k + 1 nearest by hot elements alone."""
        sign = columns.tobytes(), weights.tobytes(), x if measure == "jaccard" else 0
        if sign not in standing:
            raw = weights @ stand_counts[columns]
            sim = np.where(raw > 0, similar(raw, x if measure == "jaccard" else 1.0, stand_scale), -1.0)
            bound = np.partition(sim, -k - 1)[-k - 1] if len(sim) > k else -1.0
            standing[sign] = stand[(sim >= bound - slack) & (raw > 0)]
        return standing[sign]

    total, place = np.zeros(n), np.zeros(n, dtype=np.int64)
    out_a, out_b, out_sim = [], [], []
    lo = 0
    while lo < len(own.names):
        # Queries whose pairs fit at once, one at least.
        hi = max(lo + 1, int(np.searchsorted(pairs[of[1:]], pairs[of[lo]] + AT_ONCE, side="right")))
        fits = pairs[of[hi]] - pairs[of[lo]] <= AT_ONCE
        if fits:
            e = slice(of[lo], of[hi])
            index = np.arange(pairs[of[lo]], pairs[of[hi]]) + np.repeat(first[spot[e]] - pairs[:-1][e], many[e])
            found, product = b[index], np.repeat(weight[e], many[e]) * value[index]
        for a in range(lo, hi):
            e = slice(of[a], of[a + 1])
            if fits:
                p = slice(pairs[of[a]] - pairs[of[lo]], pairs[of[a + 1]] - pairs[of[lo]])
                cand = found[p]
                np.add.at(total, cand, product[p])
            else:
                for x, w in zip(spot[e][many[e] > 0], weight[e][many[e] > 0]):
                    p = slice(first[x], first[x] + length[x])
                    total[b[p]] += w * value[p]
                cand = np.flatnonzero(total)
            columns = column[spot[e]]
            warm = columns >= 0
            columns, weights = columns[warm], weight[e][warm]
            if len(columns):
                turn = np.argsort(columns)
                columns, weights = columns[turn], weights[turn]
                cand = np.concatenate([cand, by_hot(columns, weights, own.scale[a])])
            place[cand] = np.arange(len(cand))
            cand = cand[(place[cand] == np.arange(len(cand))) & (cand != self_at[a])]
            raw = total[cand]
            total[cand] = 0.0
            if self_at[a] >= 0:
                total[self_at[a]] = 0.0
            for c, w in zip(columns, weights):
                raw += w * counts[c, cand]
            if not len(cand):
                continue
            sim = similar(raw, own.scale[a], other.scale[cand])
            digit = np.floor(sim * 1e12 + 0.5)
            if len(cand) > k:
                kept = np.flatnonzero(digit >= np.partition(digit, -k)[-k])
                cand, sim, digit = cand[kept], sim[kept], digit[kept]
            top = np.lexsort((cand, -digit))[:k]
            out_a.append(np.full(len(top), a))
            out_b.append(cand[top])
            out_sim.append(sim[top])
        lo = hi
        if out_a and (lo == len(own.names) or len(out_a) >= 10_000):
            columns = [own.names.take(pa.array(np.concatenate(out_a))), other.names.take(pa.array(np.concatenate(out_b))), pa.array(np.concatenate(out_sim))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "sim"])
            out_a, out_b, out_sim = [], [], []
