"""Token ids and labels of chat texts for supervised training: the prompt is masked, long texts lose their beginning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label of a token that does not count.
MASKED = -100
_SCHEMA = "input_ids array<int>, attention_mask array<int>, labels array<int>"


def masked(encode: Callable[[str], list[int]], text: str, marker: str, cutoff: int) -> tuple[list[int], list[int]]:
    """(input ids, labels) of a text: labels up to and with the first ``marker`` are masked; without one, none is."""
    ids = encode(text)
    at = text.find(marker) if marker else -1
    hidden = min(len(ids), len(encode(text[: at + len(marker)]))) if at >= 0 else 0
    labels = [MASKED] * hidden + ids[hidden:]
    return (ids[-cutoff:], labels[-cutoff:]) if cutoff > 0 else ([], [])


def encode_supervised(rows: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[str], list[int]]], marker: str, cutoff: int) -> DataFrame:
    """(key, input_ids, attention_mask, labels) of every row with a text, in Arrow batches.

    ``encoder`` is called once a task and returns the function from a text to its
    token ids. Of texts with more than ``cutoff`` tokens the last ones are kept, so
    the answer survives. Null texts have no row, empty ones empty lists; repeated
    rows are encoded each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        lists = pa.list_(pa.int32())
        for b in batches:
            both = [masked(encode, t, marker, cutoff) for t in b.column(1).to_pylist()]
            ids, labels = [x for x, _ in both], [y for _, y in both]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, lists), pa.array([[1] * len(x) for x in ids], lists), pa.array(labels, lists)], names=[key, "input_ids", "attention_mask", "labels"])

    narrow = rows.select(key, F.col(text).cast("string").alias("_text")).filter("_text is not null")
    return narrow.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {_SCHEMA}")
