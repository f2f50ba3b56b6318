"""Runs of repeated consecutive events, collapsed to one event each.

Events are range-partitioned on (entity, order columns), so an entity with any
share of all events is spread over many tasks. In each task a state machine
reads the sorted rows batch by batch, compares every event with the anchor of
the open run and emits a run when it ends. Only the first and the last run of a
task can continue in a neighbour; these edges, two per task at most, are
stitched afterwards.

With tolerances a second machine joins equal runs whose values are near those of
the anchor, the first event of the open run. Two events of one run are each
within the tolerance of its anchor, so neighbours further apart than twice that
surely belong to different runs: what lies between two such places in a task is
decided there, the rest by entity in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.session import durable, shuffle_width

_STATE = "part long, seq long, edge boolean, entity string, anchor string, n long, first_id long, last_id long, first_at long, last_at long"
_ARROW = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("edge", pa.bool_()), ("entity", pa.string()), ("anchor", pa.string()), ("n", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("first_at", pa.int64()), ("last_at", pa.int64())])


def _breaks(entity: pa.Array, anchor: pa.Array, at: pa.Array, max_gap: int | None):
    """For rows 1.. of a batch: whether the row opens a run, as a numpy mask."""
    a, b = slice(0, len(entity) - 1), slice(1, None)
    differs = pc.or_(pc.not_equal(entity[b], entity[a]), pc.not_equal(anchor[b], anchor[a]))
    if max_gap is not None:
        differs = pc.or_(differs, pc.fill_null(pc.greater(pc.subtract(at[b], at[a]), max_gap), False))
    return differs.to_numpy(zero_copy_only=False)


def _machine(max_gap: int | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, seq, first, open_run = TaskContext.get().partitionId(), 0, True, None

        def emit(runs: list[tuple], last: bool) -> pa.RecordBatch:
            nonlocal seq, first
            rows = []
            for i, r in enumerate(runs):
                edge = first or (last and i == len(runs) - 1)
                first = False
                if edge or r[2] >= least:
                    rows.append((part, seq, edge, *r))
                seq += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            entity, anchor, ident, at = (batch.column(i) for i in range(4))
            starts = np.concatenate([[0], np.flatnonzero(_breaks(entity, anchor, at, max_gap)) + 1]).astype(np.int64)
            ends = np.concatenate([starts[1:], [n]]) - 1
            take = lambda c, i: c.take(pa.array(i)).to_pylist()
            runs = list(zip(take(entity, starts), take(anchor, starts), (ends - starts + 1).tolist(), take(ident, starts), take(ident, ends), take(at, starts), take(at, ends)))
            if open_run is not None:
                e, a, k, i0, _, t0, t1 = open_run
                h = runs[0]
                near = max_gap is None or t1 is None or h[5] is None or h[5] - t1 <= max_gap
                if (e, a) == (h[0], h[1]) and near:
                    runs[0] = (e, a, k + h[2], i0, h[4], t0, h[6])
                else:
                    runs.insert(0, open_run)
            open_run = runs.pop()
            if runs:
                yield emit(runs, False)
        if open_run is not None:
            yield emit([open_run], True)

    return run


@lru_cache(maxsize=1 << 16)
def _distance(a: str, b: str) -> int:
    """Edit distance of two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


_NEAR = "entity string, part long, seq long, same array<string>, n long, first_id long, last_id long, first_at long, last_at long, opens boolean, final boolean"
_NEAR_ARROW = pa.schema([("entity", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("same", pa.list_(pa.string())), ("n", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("first_at", pa.int64()), ("last_at", pa.int64()), ("opens", pa.bool_()), ("final", pa.bool_())])


def _near_machine(tolerance: list[int], max_gap: int | None, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (entity, part, seq, same, n, first_id, last_id, first_at, last_at, opens) in order to runs around anchors.
    Unless the task holds ``whole`` entities, rows before its first and after its last sure break are passed on as they
    are; the latter begin with a row that surely opens a run."""

    def apart(a: list, b: list, factor: int) -> bool:
        late = max_gap is not None and a[8] is not None and b[7] is not None and b[7] - a[8] > max_gap
        return late or b[9] or a[0] != b[0] or any(x != y and (t == 0 or _distance(x, y) > factor * t) for x, y, t in zip(a[3], b[3], tolerance))

    def runs_of(block: list[list]) -> list[list]:
        out: list[list] = []
        for r in block:
            # The values compared are the anchor's, the time is that of the last event.
            if out and not apart(out[-1], r, 1):
                out[-1][4] += r[4]
                out[-1][6], out[-1][8] = r[6], r[8]
            else:
                out.append(list(r))
        return out

    def batch_of(rows: list[list], final: bool) -> pa.RecordBatch:
        cols = [*map(list, zip(*rows)), [final] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NEAR_ARROW)], schema=_NEAR_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, done = [], not whole, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if block and apart(block[-1], r, 2):
                    if first:
                        yield batch_of(block, False)
                    else:
                        done += runs_of(block)
                    block, first, r = [], False, (*r[:9], True)
                block.append(r)
                if len(done) > 4096:
                    yield batch_of(done, True)
                    done = []
        if done:
            yield batch_of(done, True)
        if block:
            yield batch_of(runs_of(block) if whole else block, whole)

    return run


def _joined_near(equal: DataFrame, same: list[str], tolerance: dict[str, int], max_gap: int | None) -> DataFrame:
    """Equal runs (with part and seq, their order) joined around anchors."""
    names = ["entity", "part", "seq", "same", "n", "first_id", "last_id", "first_at", "last_at", "opens"]
    width, order = shuffle_width(equal.sparkSession), ["entity", "part", "seq"]
    rows = durable(equal.select("entity", "part", "seq", F.array(*[F.col(f"same_{c}") for c in same]).alias("same"), *names[4:9], F.lit(False).alias("opens")))
    each = [tolerance.get(c, 0) for c in same]
    cut = durable(rows.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(_near_machine(each, max_gap, False), _NEAR))
    edges = cut.filter("not final").select(*names).repartition(width, "entity").sortWithinPartitions(*order)
    out = cut.filter("final").unionByName(edges.mapInArrow(_near_machine(each, max_gap, True), _NEAR))
    return out.select("entity", *[F.get("same", F.lit(i)).alias(f"same_{c}") for i, c in enumerate(same)], *names[4:9])


def collapse_runs(events: DataFrame, entity: str, order_by: list[str], same: list[str], ident: str, at: str, max_gap: int | None = None, least: int = 1, tolerance: dict[str, int] | None = None) -> DataFrame:
    """One row per maximal run of consecutive equal events of an entity.

    ``same`` are canonical columns (near-identical writings must already share a
    form); two neighbouring events belong together if all of them are equal and,
    with ``max_gap``, no more than so many units of ``at`` lie between them.
    ``tolerance`` maps columns of ``same`` to an edit distance: an event then
    belongs to the open run if these are so near to the run's first event.
    ``least`` drops shorter runs. Returns entity, n, first_id, last_id, first_at,
    last_at, duration and the ``same`` columns.

    Events lacking the entity or one of ``same`` are left out beforehand. Null
    order values sort first and a null ``at`` never breaks a run. Events equal in
    all ``order_by`` columns keep an arbitrary order among themselves, so
    ``order_by`` should end with a unique column. Other columns are ignored. An
    empty input gives no rows.
    """
    keys = [F.col(c).cast("string") for c in same]
    # Length-prefixed parts, so that no two different keys share a text.
    anchor = F.concat(*[F.concat(F.length(k).cast("string"), F.lit(":"), k) for k in keys])
    present = F.col(entity).isNotNull()
    for c in same:
        present = present & F.col(c).isNotNull()
    order = [f"_o{i}" for i in range(len(order_by))]
    narrow = events.filter(present).select(F.col(entity).cast("string").alias("entity"), anchor.alias("anchor"), F.col(ident).cast("long").alias("ident"), F.col(at).cast("long").alias("at"), *[F.col(c).alias(o) for c, o in zip(order_by, order)])
    spread = narrow.repartitionByRange(shuffle_width(events.sparkSession), "entity", *order).sortWithinPartitions("entity", *order)
    runs = spread.select("entity", "anchor", "ident", "at").mapInArrow(_machine(max_gap, 1 if tolerance else least), _STATE)

    # Edges meet in one small group (two rows per task at most); all other runs are final and stay apart.
    group = F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("part"))
    w = Window.partitionBy("group").orderBy("part", "seq")
    prev = lambda c: F.lag(c).over(w)
    joined = (F.col("group") == -1) & (prev("part") < F.col("part")) & (prev("entity") == F.col("entity")) & (prev("anchor") == F.col("anchor"))
    if max_gap is not None:
        joined = joined & F.coalesce(F.col("first_at") - prev("last_at") <= max_gap, F.lit(True))
    islands = runs.withColumn("group", group).withColumn("opens", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.struct("part", "seq"), F.struct("part", "seq")
    whole = islands.groupBy("group", "island").agg(*([F.min(first).alias("at")] if tolerance else []), F.min("entity").alias("entity"), F.min("anchor").alias("anchor"), F.sum("n").alias("n"), F.min_by("first_id", first).alias("first_id"), F.max_by("last_id", last).alias("last_id"), F.min_by("first_at", first).alias("first_at"), F.max_by("last_at", last).alias("last_at"))
    out = whole if tolerance else whole.filter(F.col("n") >= least)
    rest, parts = F.col("anchor"), []
    for i, c in enumerate(same):
        size = F.substring_index(rest, ":", 1).cast("int")
        body = F.length(F.substring_index(rest, ":", 1)) + 2
        parts.append(F.substring(rest, body, size).alias(f"same_{c}"))
        rest = F.substring(rest, body + size, F.lit(2**30)) if i < len(same) - 1 else rest
    names = ["n", "first_id", "last_id", "first_at", "last_at"]
    out = out.select("entity", *(["at.part", "at.seq"] if tolerance else []), *parts, *names)
    if tolerance:
        out = _joined_near(out, same, tolerance, max_gap).filter(F.col("n") >= least)
    return out.select("entity", *[f"same_{c}" for c in same], *names, (F.col("last_at") - F.col("first_at")).alias("duration"))
