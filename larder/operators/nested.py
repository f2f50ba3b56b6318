"""Nested JSON records to related flat rows, by vectorised structural indexing.

A batch of lines is one byte array. Bitmaps of quotes, brackets and delimiters
outside strings are made with array operations, nesting depth by a prefix sum
over the brackets, and the elements of every container by one stable sort on
(line, depth). No parser walks a line; the spans of the wanted elements are
gathered into Arrow strings and emitted with parent and position.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "rec_id long, child string, parent_pos int, pos int, item_key string, detail string"
_ARROW = pa.schema([("rec_id", pa.int64()), ("child", pa.string()), ("parent_pos", pa.int32()), ("pos", pa.int32()), ("item_key", pa.string()), ("detail", pa.string())])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_STRUCT = np.zeros(256, bool)
_STRUCT[[ord(x) for x in "{}[],:"]] = True


#: An element of several parts written as one text is ``vendor||cuisine (slot)``: what stands in brackets at its end is
#: the slot, however that is written, and no part of the key.
SLOT = r"\s*\([^()]*\)\s*$"


@dataclass(frozen=True)
class Child:
    """A nested list that becomes a table.

    ``parts`` make the item key, joined by ``||``: fields of an object element,
    leading items of a list element, or the text of a plain one. An object in
    place of the list is one lone element if it has a field in ``lone``, else a
    mapping whose keys stand for the first part.
    """

    name: str
    parts: tuple[str, ...]
    lone: tuple[str, ...]
    nested: dict[str, Child] = field(default_factory=dict)


class Index:
    """Structure of a batch of JSON texts: containers and the value spans in them."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.b = b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        lines = len(texts)

        def line_of(p: np.ndarray) -> np.ndarray:
            return np.searchsorted(off, p, side="right") - 1

        # The first '{' of each line; whatever stands before it does not count.
        braces = np.flatnonzero(b == 123)
        first = np.full(lines, len(b) + 1)
        bl, bi = np.unique(line_of(braces), return_index=True)
        first[bl] = braces[bi]
        # Encoded fields may also open with '['.
        brackets = np.flatnonzero(b == 91)
        ol, oi = np.unique(line_of(brackets), return_index=True)
        leads, firsts = np.zeros(lines, bool), np.full(lines, len(b) + 1)
        firsts[ol] = brackets[oi]
        nonspace = np.flatnonzero(~_SPACE[b])
        at = np.searchsorted(nonspace, off[:-1])
        has = at < len(nonspace)
        leads[has] = nonspace[at[has]] == firsts[has]
        first = np.where(leads, firsts, first)

        # Quote bitmap without escaped quotes (an odd run of backslashes before them).
        slashes = np.flatnonzero(b == 92)
        quotes = np.flatnonzero(b == 34)
        if slashes.size:
            cut = np.flatnonzero((np.diff(slashes) > 1) | (line_of(slashes[1:]) != line_of(slashes[:-1]))) + 1
            begin, end = np.r_[0, cut], np.r_[cut, slashes.size]
            after = slashes[end - 1] + 1
            odd = (end - begin) % 2 == 1
            quotes = quotes[~np.isin(quotes, after[odd])]
        ql = line_of(quotes)
        keep = quotes > first[ql]
        quotes, ql = quotes[keep], ql[keep]
        lead = np.searchsorted(ql, np.arange(lines))  # quotes before each line
        # Structural characters outside strings.
        s = np.flatnonzero(_STRUCT[b])
        sl = line_of(s)
        inside = (np.searchsorted(quotes, s) - lead[sl]) % 2 == 1
        keep = ~inside & (s >= first[sl])
        s, sl = s[keep], sl[keep]
        c = b[s]
        opens, closes = (c == 123) | (c == 91), (c == 125) | (c == 93)
        # Nesting depth by prefix sum, restarted at each line.
        step = opens.astype(np.int64) - closes
        run = np.cumsum(step)
        base = np.r_[0, run][np.searchsorted(sl, np.arange(lines))]
        depth = run - base[sl] + closes
        # The root's closing bracket ends the record; lines without one are left out.
        ends = np.full(lines, -1)
        at = np.flatnonzero(closes & (depth == 1))
        el, ei = np.unique(sl[at], return_index=True)
        ends[el] = s[at[ei]]
        keep = s <= ends[sl]
        s, sl, c, opens, closes, depth = s[keep], sl[keep], c[keep], opens[keep], closes[keep], depth[keep]
        order = np.lexsort((s, depth, sl))
        s, sl, c, opens, closes, depth = s[order], sl[order], c[order], opens[order], closes[order], depth[order]
        cid = np.cumsum(opens) - 1
        self.n = int(opens.sum())
        self.is_object = c[opens] == 123
        self.open_at = s[opens]
        self.close_at = np.full(self.n, -1)
        self.close_at[cid[closes]] = s[closes]
        self.line, self.depth = sl[opens], depth[opens]
        by_pos = np.argsort(self.open_at, kind="stable")
        commas = np.cumsum(c == 44)
        at_open = commas[opens]
        # A gap lies between neighbouring tokens of one container.
        left = np.flatnonzero(~closes[:-1]) if len(s) else np.zeros(0, np.int64)
        left = left[cid[left] == cid[left + 1]]
        start, end = s[left] + 1, s[left + 1]
        i, j = np.searchsorted(nonspace, start), np.searchsorted(nonspace, end)
        full = j > i
        in_object = self.is_object[cid[left]]
        is_key = in_object & (c[left + 1] == 58)
        is_value = full & np.where(in_object, c[left] == 58, True)
        safe = np.minimum(i, max(len(nonspace) - 1, 0))
        start = np.where(full, nonspace[safe] if len(nonspace) else start, start)
        end = np.where(full, nonspace[np.maximum(j - 1, 0)] + 1 if len(nonspace) else end, end)
        v = np.flatnonzero(is_value)
        self.v_cid, self.v_idx, self.v_start, self.v_end = cid[left[v]], commas[left[v]] - at_open[cid[left[v]]], start[v], end[v]
        self.v_kind = b[self.v_start]
        has_key = in_object[v]
        k = np.where(has_key, v - 1, v)
        self.k_start, self.k_end = np.where(has_key & is_key[k], start[k], 0), np.where(has_key & is_key[k], end[k], 0)
        self.v_child = np.full(len(v), -1)
        nested = (self.v_kind == 123) | (self.v_kind == 91)
        if nested.any():
            spots = np.searchsorted(self.open_at[by_pos], self.v_start[nested])
            found = by_pos[np.minimum(spots, self.n - 1)]
            self.v_child[nested] = np.where(self.open_at[found] == self.v_start[nested], found, -1)
        self.first_value = np.searchsorted(self.v_cid, np.arange(self.n + 1))
        self._named: dict[str, np.ndarray] = {}

    def named(self, name: str) -> np.ndarray:
        """For each container, the value under the key ``name`` (the last one), or -1."""
        if name not in self._named:
            q = np.frombuffer(f'"{name}"'.encode(), np.uint8)
            at = np.flatnonzero(self.k_end - self.k_start == len(q))
            same = (self.b[self.k_start[at][:, None] + np.arange(len(q))] == q).all(axis=1) if at.size else np.zeros(0, bool)
            out = np.full(self.n + 1, -1)
            out[self.v_cid[at[same]]] = at[same]
            self._named[name] = out
        return self._named[name]

    def texts(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The spans as strings."""
        size = np.maximum(end - start, 0)
        offsets = np.r_[0, np.cumsum(size)]
        data = self.b[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])] if offsets[-1] else np.zeros(0, np.uint8)
        return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])

    def values(self, v: np.ndarray) -> pa.Array:
        """Values as plain text: strings without quotes and escapes, null and -1 as the empty string."""
        there = v >= 0
        w = np.where(there, v, 0)
        if not len(self.v_start):
            return pa.array([""] * len(v), pa.large_string())
        quoted = there & (self.v_kind[w] == 34)
        none = ~there | (self.v_kind[w] == 110)
        out = self.texts(np.where(none, 0, self.v_start[w] + quoted), np.where(none, 0, self.v_end[w] - quoted))
        return _unescaped(out)


def _unescaped(texts: pa.Array) -> pa.Array:
    escaped = pc.match_substring(texts, "\\")
    if not pc.any(escaped).as_py():
        return texts

    def plain(t: str) -> str:
        try:
            return json.loads(f'"{t}"')
        except ValueError:
            return t

    return pc.replace_with_mask(texts, escaped, pa.array([plain(t) for t in texts.filter(escaped).to_pylist()], pa.large_string()))


def _rows_of(ix: Index, ids: np.ndarray, spec: dict[str, Child], top: np.ndarray | None, detail: bool) -> Iterator[pa.RecordBatch]:
    """Rows of all children found in an index; ids: the record of each line.

    top: None for whole records; else the field (a position in ``spec``) whose encoded text each line is.
    """
    later: list[tuple[np.ndarray, pa.Array, int]] = []
    for f, (name, child) in enumerate(spec.items()):
        if top is None:
            at = ix.named(name)[:-1]
            found = np.flatnonzero(at >= 0)
            # The shallowest container with that key, once a line.
            found = found[np.lexsort((ix.open_at[found], ix.depth[found], ix.line[found]))]
            _, i = np.unique(ix.line[found], return_index=True)
            v = at[found[i]]
            lines = ix.line[found[i]]
            coded = ix.v_kind[v] == 34
            if coded.any():
                later.append((ids[lines[coded]], ix.values(v[coded]), f))
            whole = ix.v_child[v] >= 0
            yield from _emit(ix, ids[lines[whole]], ix.v_child[v[whole]], None, child, detail)
        else:
            roots = np.flatnonzero((ix.depth == 1) & (top[ix.line] == f))
            yield from _emit(ix, ids[ix.line[roots]], roots, None, child, detail)
    if later:
        texts = pa.concat_arrays([x[1] for x in later])
        yield from _rows_of(Index(texts), np.concatenate([x[0] for x in later]), spec, np.concatenate([np.full(len(x[0]), x[2]) for x in later]), detail)


def _emit(ix: Index, rec: np.ndarray, cid: np.ndarray, parent: np.ndarray | None, child: Child, detail: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ``child`` for containers ``cid`` of records ``rec``, and of what is nested in them."""
    if not len(cid):
        return
    lone = np.zeros(len(cid), bool)
    for k in child.lone:
        lone |= ix.named(k)[cid] >= 0
    lone &= ix.is_object[cid]
    parent = np.full(len(cid), -1) if parent is None else parent
    # Elements: all values of lists and mappings, and the lone objects themselves.
    src = np.flatnonzero(~lone)
    lo, hi = ix.first_value[cid[src]], ix.first_value[cid[src] + 1]
    size = hi - lo
    value = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(src) else np.zeros(0, np.int64)
    owner = np.repeat(src, size)
    keyed = ix.is_object[cid[owner]]
    real = (ix.v_kind[value] != 110) | keyed if len(value) else np.zeros(0, bool)
    value, owner, keyed = value[real], owner[real], keyed[real]
    one = np.flatnonzero(lone)
    owner, keyed = np.r_[owner, one], np.r_[keyed, np.zeros(len(one), bool)]
    value = np.r_[value, np.full(len(one), -1)]
    n = len(owner)
    if not n:
        return
    v = np.maximum(value, 0)
    own = np.where(value >= 0, ix.v_child[v] if len(ix.v_child) else -1, cid[owner])
    pos = np.where(value >= 0, ix.v_idx[v] if len(ix.v_idx) else 0, 0)
    is_obj = (own >= 0) & ix.is_object[np.maximum(own, 0)] & ~keyed
    is_list = (own >= 0) & ~ix.is_object[np.maximum(own, 0)] & ~keyed
    plain = (own < 0) & ~keyed
    parts = []
    for i, p in enumerate(child.parts):
        in_list = ix.first_value[np.maximum(own, 0)] + i
        ok = is_list & (in_list < ix.first_value[np.maximum(own, 0) + 1])
        # Empty slots hold no value, so the position in the list is checked too.
        at = np.where(is_obj, ix.named(p)[np.maximum(own, 0)], np.where(ok, in_list, -1))
        if i == 0:
            at = np.where(plain, value, at)
        parts.append(ix.values(at))
    key = parts[0]
    if plain.any():
        key = pc.if_else(pa.array(plain), pc.replace_substring_regex(key, SLOT, "") if len(parts) > 1 else key, key)
    if keyed.any():
        at = np.where(keyed, ix.k_start[v], 0), np.where(keyed, ix.k_end[v], 0)
        key = pc.if_else(pa.array(keyed), _unescaped(ix.texts(at[0] + 1, at[1] - 1)), key)
    if len(parts) > 1:
        joined = pc.binary_join_element_wise(key, *parts[1:], pa.scalar("||", pa.large_string()))
        key = pc.if_else(pa.array(plain | keyed), key, joined)
    start = np.where(value >= 0, ix.v_start[v] if len(ix.v_start) else 0, ix.open_at[cid[owner]])
    end = np.where(value >= 0, ix.v_end[v] if len(ix.v_end) else 0, ix.close_at[cid[owner]] + 1)
    text = ix.texts(start, end).cast(pa.string()) if detail else pa.nulls(n, pa.string())
    cols = [pa.array(rec[owner], pa.int64()), pa.array([child.name]).take(pa.array(np.zeros(n, np.int64))), pa.array(parent[owner].astype(np.int32)), pa.array(pos.astype(np.int32)), key.cast(pa.string()), text]
    yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)
    for name, sub in child.nested.items():
        at = np.where((own >= 0) & ix.is_object[np.maximum(own, 0)], ix.named(name)[np.maximum(own, 0)], -1)
        has = np.flatnonzero((at >= 0) & (ix.v_child[np.maximum(at, 0)] >= 0 if len(ix.v_child) else False))
        yield from _emit(ix, rec[owner[has]], ix.v_child[at[has]], pos[has], sub, detail)


def flatten_lines(lines: DataFrame, rec_id: str, text: str, spec: dict[str, Child], detail: bool = False) -> DataFrame:
    """One row per non-null element of every list in ``spec``: rec_id, child, parent_pos, pos, item_key, detail.

    ``text`` holds one JSON object a line, at any depth of wrapping objects; a
    field may itself be JSON encoded as a string. ``pos`` counts from 0 in stored
    order, null elements included; ``parent_pos`` is the position of the parent
    element, -1 for the first level. ``detail`` (on request) is the JSON text of
    the element. Text before the first ``{`` and after its closing bracket is
    ignored; null, empty, truncated and object-free lines give no rows. Missing
    and null parts are empty strings. Repeated lines give repeated rows. Other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = part.column(1).fill_null("")
                yield from _rows_of(Index(texts), part.column(0).to_numpy(zero_copy_only=False), spec, None, detail)

    return lines.select(F.col(rec_id).cast("long"), F.col(text).cast("string")).filter(F.col(rec_id).isNotNull()).mapInArrow(run, SCHEMA)


def flatten_columns(rows: DataFrame, rec_id: str, spec: dict[str, Child], detail: bool = False) -> DataFrame:
    """The same for typed nested columns, which are written as JSON in the JVM first; null columns give no rows."""
    text = F.to_json(F.struct(*[F.col(c) for c in spec]))
    return flatten_lines(rows.select(F.col(rec_id).alias("_id"), text.alias("_text")), "_id", "_text", spec, detail)
