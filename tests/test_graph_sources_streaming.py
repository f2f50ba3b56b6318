import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import graph
from larder.sources import readers, sinks
from larder.streaming import jobs


def test_top_by_dot_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(100, None), (101, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    q = df.filter("id < 12")
    want = {i: [int(j) for j in np.argsort(-np.where(np.arange(60) == i, -np.inf, v @ v[i]))[:3]] for i in range(12)}
    for block in (20_000, 4):
        monkeypatch.setattr(graph, "QUERY_BLOCK", block)
        got = {}
        for r in graph.top_by_dot(q, df, 3).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.item)
        assert got == want
    assert graph.top_by_dot(df.filter("id < 0"), df, 3).count() == 0


def test_propagation_is_a_matrix_power(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "user string, item string")
    adj = graph.normalised_edges(e)
    nodes = ["u:a", "u:b", "i:x", "i:y"]
    m = np.zeros((4, 4))
    for r in adj.collect():
        m[nodes.index(r.src), nodes.index(r.dst)] = r.w
    assert np.allclose(m, m.T)
    start = graph.initial_vectors(adj, 3)
    x0 = np.array([dict((r.node, r.v) for r in start.collect())[n] for n in nodes])
    want = (x0 + m @ x0 + m @ m @ x0) / 3
    got = dict((r.node, r.v) for r in graph.propagate(adj, start, 2, 3).collect())
    assert np.allclose([got[n] for n in nodes], want)


def test_training_is_seeded_and_ranks_positives(spark):
    pairs = [(f"u{i}", f"i{j}") for i in range(12) for j in range(8) if (i + j) % 4 == 0 or (i < 6) == (j < 4)]
    e = spark.createDataFrame(pairs, "user string, item string")
    a, b = ({r.node: r.v for r in graph.train(e, dims=8, epochs=30).collect()} for _ in range(2))
    assert a == b
    score = lambda u, i: float(np.dot(a[f"u:{u}"], a[f"i:{i}"]))
    pos = np.mean([score(u, i) for u, i in pairs])
    neg = np.mean([score(f"u{i}", f"i{j}") for i in range(12) for j in range(8) if (f"u{i}", f"i{j}") not in pairs])
    assert pos > neg


def test_delimited_sources(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "orders_sg_train.txt").write_text("customer_id,order_id,vendor_id,product_id,geohash,order_time,order_day,day_of_week\nc1,1,v1,p1,g,12:30:00,3 days,2\nc2,2,v9,p1,,x,,9\n")
    (tmp_path / "vendors_sg.txt").write_text("vendor_id,primary_cuisine,geohash,chain_id\nv1,thai,h,\n")
    (tmp_path / "products_sg.txt").write_text("vendor_id,product_id,name,unit_price\nv1,p1,,\n")
    assert readers.region_of(spark, d) == "sg"
    m = {r.customer_id: r for r in readers.merged(readers.load_orders(spark, d), readers.load_vendors(spark, d), readers.load_products(spark, d)).collect()}
    assert (m["c1"].hour, m["c1"].day_num, m["c1"].day_name, m["c1"].cuisine, m["c1"].product_name, m["c1"].chain_id) == (12, 3, "Wed", "thai", "Unknown Product", "")
    assert (m["c2"].hour, m["c2"].day_num, m["c2"].day_name, m["c2"].cuisine) == (None, None, "Unknown", "unknown")
    with pytest.raises(FileNotFoundError):
        readers.load_orders(spark, d, "test")
    with pytest.raises(ValueError, match="nothing"):
        readers.require_columns(spark.range(1), "nothing")


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}], indent=1))
    (tmp_path / "b.json").write_text('{"x": 1}\n\n{"x": 2}\n')
    for n in ("a", "b"):
        assert sorted(r.x for r in readers.read_json_any(spark, str(tmp_path / f"{n}.json"), "x long").collect()) == [1, 2]


def test_ratings(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,1,4.0,1\n1,2,3.5,2\n1,3,5.0,3\n")
    (tmp_path / "movies.csv").write_text("movieId,title\n1,One\n3,Three\n")
    r = readers.history_lines(readers.load_ratings(spark, str(tmp_path)), 2).collect()
    assert len(r) == 1 and r[0].lines == ["1. One (rating ≈ 4.0)", "2. Movie 2 (rating ≈ 3.5)"]


def test_resume_and_keys(spark, tmp_path):
    out = str(tmp_path / "out")
    s = spark.createDataFrame([("c", "1"), ("c", "2")], "customer_id string, order_id string")
    assert sinks.missing_from(s, spark, out).count() == 2
    sinks.append_results(s.limit(1), out)
    assert sinks.missing_from(s, spark, out).count() == 1
    a, b = spark.range(10), spark.range(10).repartition(3).orderBy(F.desc("id"))
    assert sinks.content_key(a, {"k": 1}) == sinks.content_key(b, {"k": 1}) != sinks.content_key(a, {"k": 2})
    assert sinks.preview(a, 3).count() == 3 and sinks.preview(a, 3).first().total_rows == 10
    assert sinks.run_folder("b").startswith("b/20")


def test_streams(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    ev = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 30 as int)) as t, 'a' as event_type, cast(id as double) as value from range(20)").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    ev.write.parquet(src)
    jobs.hourly_counts(spark, src, "ts timestamp, event_type string, value double", out, ck).awaitTermination(60)
    got = spark.read.parquet(out)
    assert 0 < got.count() < 11 and got.agg(F.max("n")).first()[0] == 2
    res, o2, c2 = (str(tmp_path / x) for x in ("res", "o2", "c2"))
    rows = spark.createDataFrame([("c", "1"), ("c", "1"), ("d", "2")], "customer_id string, order_id string")
    rows.write.json(res)
    for _ in range(2):
        jobs.resumable_results(spark, res, "customer_id string, order_id string", o2, c2).awaitTermination(60)
        rows.write.mode("append").json(res)
    assert spark.read.json(o2).count() == 2
