"""Queries of plain SQL capability that come with the engine underneath: joins, windows, cubes, sets, time windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.session import cut
from marlstone.sources.tables import parquet
from marlstone.streaming import embedding as streaming

#: Bands that are broadcast at once; each is two rows of 24 bytes.
BAND_ROWS = 500_000

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    rows = parquet(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def customers_by_nation(spark, sf_dir):
    c, n, r = (parquet(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def sales_cube(spark, sf_dir):
    return parquet(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderkey, o_custkey, r::INT AS r, round(running, 2) AS running FROM (SELECT o_orderkey, o_custkey, row_number() OVER w AS r, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))")
def rank_window(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0))
    return parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("r"), F.round(running, 2).alias("running"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, sf_dir):
    return parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(parquet(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except(spark, sf_dir):
    return parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(parquet(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark, sf_dir):
    return parquet(spark, sf_dir, "customer").join(parquet(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT * FROM (PIVOT (SELECT o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING count(*) GROUP BY o_orderpriority)")
def pivot_status(spark, sf_dir):
    return parquet(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    out = streaming.windowed(parquet(spark, sf_dir, "events"), "1 hour", by=("event_type",), n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def events_session(spark, sf_dir):
    out = streaming.sessions(parquet(spark, sf_dir, "events"), "30 minutes", ("user_id",), n=F.count(F.lit(1)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("""SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts, event_id % 1000 AS k FROM events) e
ASOF LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, o_orderdate FROM orders GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def asof_events_orders(spark, sf_dir):
    """The last order of the user at or before each event: one union, one window by user, no pairs."""
    e = parquet(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = parquet(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at")).agg(F.max("o_orderkey").alias("o_orderkey")).withColumn("event_id", F.lit(None).cast("long"))
    w = W.partitionBy("k").orderBy("at", F.col("event_id").isNotNull(), "event_id").rowsBetween(W.unboundedPreceding, 0)
    both = e.unionByName(o.select("k", "at", "event_id", "o_orderkey"))
    return both.withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w)).where("event_id IS NOT NULL").select("event_id", "o_orderkey")


@query("SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE r = 1")
def top_line_of_order(spark, sf_dir):
    line = parquet(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct((-F.col("l_extendedprice")).alias("p"), "l_linenumber")).alias("m"))
    return parquet(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("m.l_linenumber").alias("l_linenumber"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def grouping_sets(spark, sf_dir):
    parquet(spark, sf_dir, "orders").createOrReplaceTempView("ms_orders")
    return spark.sql("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM ms_orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")


@query("SELECT l_shipdate::DATE AS day, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL HAVING count(*) > 20")
def filtered_aggregate(spark, sf_dir):
    rows = parquet(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"))
    return rows.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n")).where("n > 20").drop("n")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 5000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey")
def full_outer_join(spark, sf_dir):
    c = parquet(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    s = parquet(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "c", "s")


@query("SELECT p_partkey, field, value FROM (UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME field VALUE value)")
def unpivot_part(spark, sf_dir):
    rows = parquet(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rows.unpivot("p_partkey", ["p_size", "p_retailprice"], "field", "value")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def range_join_dates(spark, sf_dir):
    o, line = parquet(spark, sf_dir, "orders"), parquet(spark, sf_dir, "lineitem")
    return o.join(line, (F.col("o_orderkey") == F.col("l_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"))).select("o_orderkey", "l_linenumber")


@query("SELECT event_id, s_suppkey FROM events JOIN supplier ON value BETWEEN s_acctbal / 100 AND s_acctbal / 100 + 0.5")
def range_join_bands(spark, sf_dir):
    """A band join by buckets of the band's width: each band meets two buckets, and the bounds are checked after.

    Bands are broadcast, beyond ``BAND_ROWS`` a share of them at a time, so that events are never shuffled: there are few
    buckets, and each is a hot key. The pairs themselves grow with events times bands.
    """
    width = 0.5
    e = parquet(spark, sf_dir, "events").select("event_id", "value", F.floor(F.col("value") / width).alias("b"))
    s = parquet(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("lo")).where("lo IS NOT NULL")
    shares = max(1, -(-s.count() // BAND_ROWS))
    found = []
    for i in range(shares):
        some = s.where(F.pmod(F.xxhash64("s_suppkey", "lo"), F.lit(shares)) == i) if shares > 1 else s
        some = some.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + width) / width))))
        found.append(e.join(F.broadcast(some), "b").where(F.col("value").between(F.col("lo"), F.col("lo") + width)).select("event_id", "s_suppkey"))
    return reduce(DataFrame.unionAll, found)


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) WHERE c_acctbal > 9000")
def lateral_top_orders(spark, sf_dir):
    """The order is the window's own: Spark turns a LATERAL with ORDER BY and LIMIT into row numbers over a window without one."""
    c, o = parquet(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey"), parquet(spark, sf_dir, "orders").where("o_custkey IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")))
    best = o.select("o_custkey", "o_orderkey", rank.alias("r")).where("r <= 2")
    return c.join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("WITH RECURSIVE t(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
def recursive_cte(spark, sf_dir):
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_union(spark, sf_dir):
    clicks = parquet(spark, sf_dir, "events").where("event_type = 'click'").select("user_id")
    return clicks.union(parquet(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")).distinct()


@query("SELECT event_id, user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 HOUR AS pause, ntile(4) OVER (PARTITION BY event_type ORDER BY value, event_id)::INT AS quarter FROM events")
def lag_and_ntile(spark, sf_dir):
    by_user, by_type = W.partitionBy("user_id").orderBy("ts", "event_id"), W.partitionBy("event_type").orderBy("value", "event_id")
    return parquet(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") - F.lag("ts").over(by_user) > F.expr("INTERVAL 1 HOUR")).alias("pause"), F.ntile(4).over(by_type).alias("quarter"))


@query("SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT user_id FROM events")
def set_intersect_all(spark, sf_dir):
    return parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersectAll(parquet(spark, sf_dir, "events").select("user_id"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'click'")
def set_except_all(spark, sf_dir):
    return parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).exceptAll(parquet(spark, sf_dir, "events").where("event_type = 'click'").select("user_id"))


@query("""SELECT l_returnflag, true AS suppliers_near, true AS median_near FROM lineitem GROUP BY l_returnflag""")
def approximate_aggregates(spark, sf_dir):
    """Sketches of distinct counts and quantiles, held against the exact figures by their stated errors.

    Distinct keys are counted apart: beside them Spark would keep the sketches of each key.
    """
    near = lambda a, b, e: F.abs(a - b) <= e * b
    rows = parquet(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice")
    quantiles = F.percentile_approx("l_extendedprice", [0.49, 0.5, 0.51], 10_000).alias("q")
    sketches = cut(rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), quantiles, F.count("l_extendedprice").alias("n")), "sketches")
    exact = rows.select("l_returnflag", "l_partkey").distinct().groupBy(F.col("l_returnflag").alias("__f")).agg(F.count("l_partkey").alias("b"))
    both = sketches.join(exact, F.col("l_returnflag").eqNullSafe(F.col("__f"))).drop("__f")
    median = exact_medians(rows, sketches, "l_returnflag", "l_extendedprice").withColumnRenamed("l_returnflag", "__f")
    both = both.join(median, F.col("l_returnflag").eqNullSafe(F.col("__f")), "left")
    return both.select("l_returnflag", near(F.col("a"), F.col("b"), 0.1).alias("suppliers_near"), near(F.col("q")[1], F.col("median"), 0.01).alias("median_near"))


def exact_medians(rows, sketches, by: str, of: str):
    """(by, median) of each group, from sketches of its 0.49, 0.5 and 0.51 quantiles (q) and its count of values (n).

    The sketch's error is a hundredth of that distance, so its outer values enclose the median: values below them are
    counted, and only those between are shuffled and put in order.
    """
    bounds = sketches.select(F.col(by).alias("__f"), F.col("q")[0].alias("__lo"), F.col("q")[2].alias("__hi"), F.col("n").alias("__n"))
    placed = rows.join(bounds, F.col(by).eqNullSafe(F.col("__f"))).where(F.col(of) <= F.col("__hi"))
    counts = placed.groupBy(by, "__n", F.when(F.col(of) >= F.col("__lo"), F.col(of)).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("c", F.sum("c").over(W.partitionBy(by).orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0)))
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    at = lambda rank: F.min(F.when(F.col("c") > rank, F.col("v")))
    found = upto.groupBy(by, "__n").agg(at(low).alias("x"), at(high).alias("y"), F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"))
    median = F.when((F.col("below") <= low) & F.col("y").isNotNull(), (F.col("x") + F.col("y")) / 2).otherwise(F.raise_error(F.lit("the sketch does not enclose the median")))
    return found.select(by, median.alias("median"))


@query("""WITH p AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_orderkey % 10 = 0) AS e FROM lineitem GROUP BY 1) SELECT l_returnflag, true AS share_near FROM p""")
def table_sample(spark, sf_dir):
    """A seeded sample of a tenth: its share of each group is near a tenth."""
    rows = parquet(spark, sf_dir, "lineitem")
    drawn = rows.sample(0.1, seed=7).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("k"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).join(drawn, "l_returnflag").select("l_returnflag", (F.abs(F.col("k") / F.col("n") - 0.1) < 0.02).alias("share_near"))


@query("SELECT o_orderkey, event_id FROM orders JOIN events ON o_custkey = user_id AND o_orderstatus = 'P' AND event_type = 'purchase'")
def equi_join_filtered(spark, sf_dir):
    o, e = parquet(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), parquet(spark, sf_dir, "events").where("event_type = 'purchase'")
    return o.join(e, F.col("o_custkey") == F.col("user_id")).select("o_orderkey", "event_id")
