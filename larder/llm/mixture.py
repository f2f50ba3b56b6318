"""Mixtures of sources by target shares of tokens, with capped repetition.

Each source first gets whole epochs, then a part of one more, drawn by
Efraimidis-Spirakis sampling: a document's key is exponential with its quality
weight as rate, and documents are taken in key order up to the token budget. The
order is held as buckets of keys: prefix sums over the buckets of a source decide
all of them but one, and only the documents of that bucket are sorted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.session import durable

# Fixed value: how a byte-level vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets of keys per source (rows of the prefix sum), and documents per bucket from which there are more.
BUCKETS, PER_BUCKET = 1024, 1_000_000
#: Least weight.
LEAST = 1e-6


def letter_shares(texts: list[str]) -> np.ndarray:
    """The share of letters among the signs of each text that are no blanks, at least a tenth."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.flatnonzero(np.bincount(code, minlength=1)) if len(code) else np.zeros(0, np.int64)
    kind = np.zeros((int(code.max(initial=0)) + 1, 2), np.int64)
    kind[there] = [(chr(c).isalpha(), not chr(c).isspace()) for c in there] if len(there) else kind[there]
    upto = np.zeros((len(code) + 1, 2), np.int64)
    np.cumsum(kind[code], axis=0, out=upto[1:])
    cuts = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    held = upto[cuts[1:]] - upto[cuts[:-1]]
    return np.maximum(held[:, 0] / np.maximum(held[:, 1], 1), 0.1)


def prepared(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Sized documents, cut durably: doc_id, source, weight (``letter_shares``) and n_tokens.

    ``tokenizer`` is the file of a public byte-level vocabulary, a token in base64
    and its rank a line; its entries travel as one broadcast. Null texts and
    sources have no row; a text that recurs is counted once a batch; texts of any
    length are read whole.
    """
    if not Path(tokenizer).is_file():
        raise FileNotFoundError(f"no vocabulary file at {tokenizer}: give the path of a public tokenizer's ranks")
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(tokenizer).read_bytes().splitlines())}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        for batch in batches:
            at: dict[str, int] = {}
            which = np.array([at.setdefault(t, len(at)) for t in batch.column(2).to_pylist()], np.int64)
            sizes = np.array([len(encode(t)) for t in at], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(letter_shares(list(at))[which]), pa.array(sizes[which])], names=["doc_id", "source", "weight", "n_tokens"])

    rows = docs.filter("text is not null and source is not null").select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return durable(rows.mapInArrow(run, "doc_id long, source string, weight double, n_tokens long"))


def _bucketed(sized: DataFrame, seed: int) -> DataFrame:
    """``sized`` with the key of each document and its bucket; buckets rise with the key."""
    buckets = max(BUCKETS, -(-sized.count() // PER_BUCKET))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    key = -F.log(u) / F.greatest(F.coalesce("weight", F.lit(LEAST)), F.lit(LEAST))
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") / 2)) * buckets), F.lit(buckets - 1)).cast("int")
    return sized.select("source", "doc_id", "n_tokens", key.alias("key")).withColumn("bucket", bucket)


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """One row per source of ``targets``, cut durably: its documents and tokens (available), its budget (at most
    max_repeats epochs), whole epochs and rest in tokens, and where the rest ends: the first bucket of keys that does
    not fit (cut) and the tokens before it."""
    sums = durable(_bucketed(sized, seed).groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n")))
    have = sums.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum("size").alias("available"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce("total", F.lit(0.0))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    b = wanted.join(have, "source", "left").fillna(0, ["n_docs", "available"]).crossJoin(sums.agg(F.sum("size").cast("double").alias("total")))  # one row
    b = b.withColumn("budget", F.least(F.floor(F.col("target_share") * total), F.col("max_repeats") * F.col("available")).cast("long"))
    epochs = F.when(F.col("available") > 0, F.floor(F.try_divide(F.col("budget"), F.col("available")))).otherwise(0).cast("int")
    b = b.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available")).drop("total")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    beyond = sums.withColumn("upto", upto).join(b.select("source", "rest"), "source").filter("upto > rest")
    cut = beyond.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"))).alias("c")).select("source", "c.*").withColumnRenamed("bucket", "cut")
    return durable(b.join(cut, "source", "left"))


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """Documents of the mixture: source, doc_id, n_tokens, copies.

    ``sized`` (doc_id, source, weight, n_tokens) is read several times and should
    be cut by the caller. ``total_tokens`` defaults to the tokens of all
    documents. A source that cannot reach its share is used ``max_repeats`` times
    throughout; one without documents adds nothing. Null and non-positive weights
    count as the least weight 1e-6. Equal keys are ordered by doc_id; a doc_id
    occurring twice is two documents; documents without tokens or of sources
    without target are left out; an empty table gives no rows.
    """
    return _mixed(sized, budgets(sized, targets, total_tokens, seed), seed)


def _mixed(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    placed = _bucketed(sized, seed).filter("n_tokens > 0").join(F.broadcast(plan.select("source", "epochs", "rest", "cut", "before")), "source")  # one row per source of the targets
    clear = placed.filter("cut is null or bucket <> cut").withColumn("more", F.when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1).otherwise(0))
    within = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.filter("bucket = cut").withColumn("more", F.when(F.col("before") + within <= F.col("rest"), 1).otherwise(0))  # one bucket a source
    out = clear.unionByName(edge)
    return out.withColumn("copies", (F.col("epochs") + F.col("more")).cast("int")).filter("copies > 0").select("source", "doc_id", "n_tokens", "copies")


def shares(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """Target and actual share of every source of ``targets`` in the mixture, with its sizes in tokens."""
    plan = budgets(sized, targets, total_tokens, seed)
    mixed = _mixed(sized, plan, seed).groupBy("source").agg(F.count(F.lit(1)).alias("docs_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    both = plan.join(mixed, "source", "left").fillna(0, ["docs_used", "mixed_tokens", "most_copies"])
    actual = F.coalesce(F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy())), F.lit(0.0))  # one row per source
    return both.select("source", "target_share", "max_repeats", "n_docs", "available", "budget", "epochs", "docs_used", "most_copies", "mixed_tokens", F.round(actual, 6).alias("actual_share"))
