"""Clean forms of ids, days and controlled names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import within

# Writings that stand for "no value" once trimmed and lower-cased.
NO_VALUE = ("", "-", "--", "?", ".", "n/a", "na", "nan", "nil", "none", "null", "unknown", "undefined", "tbd", "<na>")
SHARED_ACCOUNT = "guest"
BLANKS = " \t\n\r\f\x0b\u00a0"

#: Vocabularies up to this size are matched inside the row expression; larger ones by a join.
VOCABULARY_BOUND = 2000
#: Distinct writings (some 50 bytes each) up to which their names are broadcast.
BROADCAST_WRITINGS = 200_000


def clean_id(c: Column) -> Column:
    """Lower case without surrounding blanks; blanks and placeholders give null."""
    t = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(t.isin(*NO_VALUE), None).otherwise(t)


def day_number(c: Column) -> Column:
    """First run of digits in texts such as ``' 12 days'`` or ``'3 days 00:00:00'``."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def seconds_of_day(c: Column) -> Column:
    """Seconds of ``HH:MM:SS``; null where a part is missing."""
    p = F.split(c, ":")
    return F.get(p, F.lit(0)).try_cast("int") * 3600 + F.get(p, F.lit(1)).try_cast("int") * 60 + F.get(p, F.lit(2)).try_cast("int")


def letters(c: Column) -> Column:
    """The letters and digits of a name in lower case: what is left of it in any layout."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def squeezed(c: Column) -> Column:
    """Lower case, separators as single blanks, placeholders as null: the form of names outside the vocabulary."""
    return clean_id(F.regexp_replace(c, r"[\s_\-.]+", " "))


def swaps(name: str) -> list[str]:
    """All words made by swapping two neighbouring, different characters."""
    return [name[:i] + name[i + 1] + name[i] + name[i + 2 :] for i in range(len(name) - 1) if name[i] != name[i + 1]]


def vocabulary(df: DataFrame, column: str) -> dict[str, str] | None:
    """Distinct clean names of a controlled column with their letters, or None if there are more than the bound."""
    name = squeezed(F.col(column))
    rows = df.select(name.alias("n")).filter("n is not null").distinct().limit(VOCABULARY_BOUND + 1).select("n", letters(F.col("n")).alias("k")).collect()
    return {r.n: r.k for r in sorted(rows)} if len(rows) <= VOCABULARY_BOUND else None


def canonical_name(c: Column, names: dict[str, str]) -> Column:
    """The vocabulary name that a writing stands for.

    Case, blanks, separators and punctuation do not count. A writing with the
    letters of a name stands for it; else for a name from which it is one letter
    missing, added or replaced or one swap of neighbours away; of several, for
    the least. A writing that fits no name keeps its squeezed form; blanks and
    placeholders give null. The common case (written as in the vocabulary) is one
    hash-set test, and no row moves between tasks.
    """
    if not names:
        return squeezed(c)
    table = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])
    keys: dict[str, str] = {}
    swapped: dict[str, str] = {}
    for n, k in sorted(names.items()):
        keys.setdefault(k, n)
        for x in swaps(k):
            swapped.setdefault(x, n)
    key = letters(c)
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for n, k in sorted(names.items())])
    near = F.get(F.filter(known, lambda v: F.levenshtein(v["k"], key, 1) >= 0), F.lit(0))["n"]
    turned = F.try_element_at(table(swapped), key) if swapped else F.lit(None).cast("string")
    plain = [n for k, n in keys.items()]
    return F.when(c.isin(*plain), c).when(squeezed(c).isNull(), None).otherwise(F.coalesce(F.try_element_at(table(keys), key), F.least(turned, near), squeezed(c)))


def _places(k: Column, first: int) -> Column:
    """first .. length of a word, empty for shorter words."""
    return F.when(F.length(k) >= first, F.sequence(F.lit(first), F.length(k))).otherwise(F.array().cast("array<int>"))


def matched_names(writings: DataFrame, vocab: DataFrame) -> DataFrame:
    """(_w, _n): the name that each distinct writing (_w) stands for, by the definition of ``canonical_name``, found by
    joins; ``vocab`` holds squeezed names (_n). Words one letter apart have a word with one letter left out in common."""
    k = F.col("_vk")
    v = vocab.distinct().withColumn("_vk", letters(F.col("_n")))
    w = writings.select("_w", letters(F.col("_w")).alias("_wk"), squeezed(F.col("_w")).alias("_q")).filter("_q is not null").drop("_q")
    shortened = lambda k: F.explode(F.array_distinct(F.concat(F.array(k), F.transform(_places(k, 1), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k)))))))
    turned = F.explode(F.array_distinct(F.transform(_places(k, 2), lambda i: F.concat(F.substring(k, F.lit(1), i - 2), F.substring(k, i, F.lit(1)), F.substring(k, i - 1, F.lit(1)), F.substring(k, i + 1, F.length(k))))))
    near = w.withColumn("_s", shortened(F.col("_wk"))).join(v.withColumn("_s", shortened(k)), "_s").filter(F.levenshtein("_wk", "_vk", 1) >= 0)
    swap = w.join(v.select("_n", "_vk", turned.alias("_s")), F.col("_wk") == F.col("_s"))
    pairs = near.select("_w", "_n", F.when(F.col("_wk") == k, 0).otherwise(1).alias("_c")).unionByName(swap.select("_w", "_n", F.when(F.col("_wk") == k, 0).otherwise(1).alias("_c")))
    return pairs.groupBy("_w").agg(F.min(F.struct("_c", "_n")).alias("_b")).select("_w", F.col("_b._n").alias("_n"))


def with_canonical(df: DataFrame, column: str, out: str, vocab: DataFrame, vocab_column: str) -> DataFrame:
    """``df`` with ``out``, the canonical name of ``column``.

    Up to ``VOCABULARY_BOUND`` names this is an expression, beyond joins of the
    distinct writings; both follow one definition. The writings' names come back
    by broadcast where they are few; else by a join that splits hot writings.
    """
    names = vocabulary(vocab, vocab_column)
    if names is not None:
        return df.withColumn(out, canonical_name(F.col(column), names))
    best = matched_names(df.select(F.col(column).alias("_w")).filter("_w is not null").distinct(), vocab.select(squeezed(F.col(vocab_column)).alias("_n")).filter("_n is not null"))
    best = F.broadcast(best) if within(best, BROADCAST_WRITINGS) else best
    return df.join(best, df[column] == best["_w"], "left").withColumn(out, F.coalesce(F.col("_n"), squeezed(F.col(column)))).drop("_w", "_n")
