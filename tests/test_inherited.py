"""Plans whose results or costs the small tables do not show."""

import re

from pyspark.sql import functions as F

from marlstone.plans.catalogue import ORACLE, QUERIES


def _tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _same(spark, folder, name, *tables):
    """A query's rows are those of its SQL, as a multiset."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, QUERIES[name](spark, folder).collect())))
    assert got == sorted(map(repr, con.execute(ORACLE[name]).fetchall()))
    return got


def test_lateral_orders_within_its_window(spark, tmp_path):
    """Row numbers over a window without an order follow the order in which blocks come from other executors."""
    orders = [(k, k % 5 if k % 7 else None, None if k % 11 == 0 else float(k * 37 % 23)) for k in range(200)]
    folder = _tables(spark, tmp_path, customer=([(0, 9500.0), (1, 9500.0), (1, 9500.0), (2, 100.0), (3, None), (4, 9001.0)], "c_custkey long, c_acctbal double"), orders=(orders, "o_orderkey long, o_custkey long, o_totalprice double"))
    assert len(_same(spark, folder, "lateral_top_orders", "customer", "orders")) == 8
    assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey[^,]*, o_totalprice[^,]* DESC NULLS LAST, o_orderkey", _plan(QUERIES["lateral_top_orders"](spark, folder)))


def test_bands_are_broadcast_in_shares(spark, tmp_path, monkeypatch):
    """Events are never shuffled, whatever the threshold and however many the bands."""
    from marlstone.plans import inherited

    events = [(k, None if k % 9 == 0 else k * 0.125) for k in range(400)]
    folder = _tables(spark, tmp_path, events=(events, "event_id long, value double"), supplier=([(k, None if k % 8 == 0 else k * 11.5 - 100) for k in range(300)], "s_suppkey long, s_acctbal double"))
    monkeypatch.setattr(inherited, "BAND_ROWS", 70, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _same(spark, folder, "range_join_bands", "events", "supplier")
        plan = _plan(QUERIES["range_join_bands"](spark, folder))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 4 and "Exchange hashpartitioning" not in plan


def test_distinct_keys_keep_no_sketches(spark, tmp_path):
    rows = [(f, k % 40 if k % 6 else None, None if k % 17 == 0 else float(k * 7919 % 1009)) for k in range(999) for f in ("A", "N", None)[: 1 + k % 3]]
    folder = _tables(spark, tmp_path, lineitem=(rows, "l_returnflag string, l_partkey long, l_extendedprice double"))
    df = QUERIES["approximate_aggregates"](spark, folder)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, [("A", True, True), ("N", True, True), (None, True, True)]))
    assert "percentile(" not in _plan(df)


def test_exact_medians(spark):
    from marlstone.plans.inherited import exact_medians

    of = {"a": [3.0], "b": [1.0, 2.0], "c": [float(k * k % 977) for k in range(5000)], "d": [5.0] * 100 + [7.0] * 100, None: [float(k) for k in range(7)], "e": [None]}
    rows = spark.createDataFrame([(k, v) for k, vs in of.items() for v in vs], "k string, v double").repartition(3)
    sketches = rows.selectExpr("k", "v").groupBy("k").agg(F.percentile_approx("v", [0.49, 0.5, 0.51], 10_000).alias("q"), F.count("v").alias("n"))
    got = {r["k"]: r["median"] for r in exact_medians(rows, sketches, "k", "v").collect()}
    assert got == {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.expr("percentile(v, 0.5)").alias("m")).where("m IS NOT NULL").collect()}
