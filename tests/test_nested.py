import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.operators.nested import Child, Index, _rows_of, flatten_columns, flatten_lines
from larder.plans.records import RECORD, RESULT


def brute(rid, line):
    """The same rows by a parser and loops."""
    at = (line or "").find("{")
    if at < 0:
        return []
    try:
        o, _ = json.JSONDecoder().raw_decode(line[at:])
    except ValueError:
        return []

    def find(x):
        if any(f in x for f in RESULT):
            return x
        return next((r for v in x.values() if isinstance(v, dict) and (r := find(v)) is not None), None)

    o = find(o) or {}
    text = lambda x: "" if x is None else str(x)
    out = []

    def emit(v, child, parent):
        if isinstance(v, str):
            v = json.loads(v)
        if v is None or not isinstance(v, (list, dict)):
            return
        if isinstance(v, dict):
            els = [(0, None, v)] if any(k in v for k in child.lone) else [(i, k, x) for i, (k, x) in enumerate(v.items())]
        else:
            els = [(i, None, x) for i, x in enumerate(v) if x is not None]
        for i, k, x in els:
            if k is not None:
                key = k
            elif isinstance(x, dict):
                key = "||".join(text(x.get(p)) for p in child.parts)
            elif isinstance(x, list):
                key = "||".join(text(x[j]) if j < len(x) else "" for j in range(len(child.parts)))
            else:
                key = re.sub(r"\s*\([^()]*\)\s*$", "", x) if len(child.parts) > 1 else x
            out.append((rid, child.name, parent, i, key))
            for name, sub in child.nested.items():
                if isinstance(x, dict) and x.get(name) is not None:
                    emit(x[name], sub, i)

    for name, child in RESULT.items():
        emit(o.get(name), child, -1)
    return out


def fast(lines):
    rows = []
    for b in _rows_of(Index(pa.array([x or "" for x in lines])), np.arange(len(lines)), RESULT, None, False):
        rows += list(zip(*[b.column(i).to_pylist() for i in range(5)]))
    return rows


def same(lines):
    assert sorted(fast(lines)) == sorted(r for i, x in enumerate(lines) for r in brute(i, x))


CASES = [
    None, "", "  ", "no object", "{}", "[]", '{"order_history_tuples": null}', '{"order_history_tuples": []}',
    '{"order_history_tuples": [null, ["a", "b", "c"], ["a"], [], {"vendor_id": null, "cuisine": "x"}, "v||c (Mon 1:00)"]}',
    '{"order_history_tuples": {"vendor_id": "a", "cuisine": "b"}}',
    '﻿{"result": {"lightgcn_top_cuisines": {"thai": 1.5, "a\\"b": -2}}, "run": "x"}, ',
    '{"lightgcn_top_cuisines": "[[\\"pizza\\", 1.1], [\\"a \\\\\\"q\\\\\\" {b}\\", 2]]"}',
    '{"similar_users": {"u1": {"records": [["a", "b"], null]}, "u2": {}, "u3": null}}',
    '{"similar_users": [{"user_id": "u1", "records": {"vendor_id": "z"}}, {"records": []}, null, {"user_id": null}]}',
    '{"similar_users": {"user_id": "u", "records": ["a||b (x)", "c||d"]}}',
    '{"similar_users": [{"user_id": "u1", "records": [["a", "b"]]}', '{"a": "\\\\", "order_history_tuples": [["\\\\\\"", "}]"]]}',
    '{"meta": {"x": [1, {"y": "}"}]}, "payload": {"result": {"order_history_tuples": [["å", "不要葱"]]}}}}}',
    '{ "order_history_tuples" : [ [ "a" , "b" ] , \n null ] , "x" : "order_history_tuples" }',
    'x" y {"order_history_tuples": [["a", "b"]]} "z',
]


def test_cases():
    same(CASES)
    for c in CASES:
        same([c])


value = st.recursive(st.none() | st.integers(-9, 9) | st.text('ab"\\{}[],: \n', max_size=5), lambda x: st.lists(x, max_size=3), max_leaves=5)
pair = st.lists(st.none() | st.text('ab"\\{}[]å', max_size=4), min_size=0, max_size=3)
part = st.fixed_dictionaries({}, optional={"vendor_id": st.none() | st.text('a"\\{', max_size=3), "cuisine": st.text("b]}", max_size=3), "slot": st.text(max_size=3)})
element = st.none() | pair | part | st.sampled_from(["v||c (Mon 1)", "v||c"])
user = st.none() | st.fixed_dictionaries({"user_id": st.none() | st.text("u\\\"1", max_size=3)}, optional={"records": st.none() | st.lists(element, max_size=3), "similarity": st.floats(-1, 1)})
record = st.fixed_dictionaries({"x": value}, optional={"order_history_tuples": st.none() | st.lists(element, max_size=4), "similar_users": st.none() | st.lists(user, max_size=3), "lightgcn_top_cuisines": st.none() | st.dictionaries(st.text('ab "', min_size=1, max_size=4), st.floats(-1, 1), max_size=3)})


@settings(max_examples=150, deadline=None)
@given(st.lists(record, min_size=1, max_size=4), st.booleans(), st.integers(0, 40))
def test_any_records(records, wrap, cut):
    lines = [json.dumps({"result": r} if wrap else r, ensure_ascii=bool(cut % 2)) for r in records]
    lines[-1] = lines[-1][: max(1, len(lines[-1]) - cut)]
    same(lines)


def test_tables(spark):
    pytest.importorskip("duckdb")
    random.seed(1)
    df = spark.read.parquet("/root/testdata/sf0.001/stage9_repeat_raw.parquet")
    got = [(r.rec_id, r.child, r.parent_pos, r.pos, r.item_key) for r in flatten_lines(df, "line_id", "line", RESULT).collect()]
    assert sorted(got) == sorted(x for r in df.collect() for x in brute(r.line_id, r.line))


def test_typed_columns_and_clashing_names(spark):
    schema = "rec_id long, child int, order_history_tuples array<struct<vendor_id:string,cuisine:string,slot:string>>, lightgcn_top_cuisines array<struct<cuisine:string,score:double>>, similar_users array<struct<user_id:string,similarity:double,records:array<struct<vendor_id:string,cuisine:string>>>>"
    rows = [(1, 9, [("a", None, "s"), None, (None, None, None)], None, [("u", 0.5, [("x", "y"), None]), None, (None, None, None)]), (1, 9, [], [("thai", 1.0)], None), (None, 1, [("a", "b", "c")], None, None), (3, 1, None, None, None)]
    got = sorted(tuple(r)[:5] for r in flatten_columns(spark.createDataFrame(rows, schema), "rec_id", RESULT, detail=True).collect())
    assert got == sorted([(1, "history", -1, 0, "a||"), (1, "history", -1, 2, "||"), (1, "user", -1, 0, "u"), (1, "user", -1, 2, ""), (1, "user_record", 0, 0, "x||y"), (1, "cuisine", -1, 0, "thai")])
    assert flatten_lines(spark.createDataFrame([], "i long, t string"), "i", "t", RESULT).count() == 0


def test_detail_is_the_element(spark):
    df = spark.createDataFrame([(1, '{"similar_users": [{"user_id": "u", "similarity": 0.5}]}')], "i long, t string")
    assert json.loads(flatten_lines(df, "i", "t", {"similar_users": Child("user", ("user_id",), ("user_id",), {"records": RECORD})}, True).first().detail) == {"user_id": "u", "similarity": 0.5}


def test_very_long_line():
    same(['{"order_history_tuples": [' + ", ".join('["v%d", "c"]' % i for i in range(20000)) + "]}"])
