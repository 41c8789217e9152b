"""Registered queries over the driver's tables: statements of the dialect and operators, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.macros import expand
from .operators import changes, match, timeline
from .operators.select import run_select
from .plans.parser import parse
from .sources.documents import flatten_json
from .sources.exposition import exposition
from .sources.workspace import workspace
from .streaming.continuous import ContinuousAggregate

MONEY = "decimal(18,2)"


def _read(spark: SparkSession, sf_dir: str, table: str, exact: tuple[str, ...] = ("s_acctbal", "p_retailprice"), seconds: bool = True) -> DataFrame:
    """A table with money that is summed or matched as decimals and, with `seconds`, times as seconds since the epoch."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for name, kind in df.dtypes if seconds or exact else ():
        if name in exact:
            df = df.withColumn(name, F.col(name).cast(MONEY))
        elif not seconds:
            continue
        elif kind in ("timestamp", "timestamp_ntz"):
            df = df.withColumn(name, F.unix_timestamp(F.col(name).cast("timestamp")))
    return df


#: Statements of the dialect, each with DuckDB SQL where that differs.
STATEMENTS: dict[str, tuple[str, str]] = {
    "scan_filter": (
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice < 100000)",
        "SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice::DECIMAL(18,2) < 100000)",
    ),
    "expr_project": ("SELECT l_orderkey, l_linenumber, l_linenumber * 10 + 1 AS x FROM lineitem WHERE l_quantity > 45", ""),
    "int_division": ("SELECT o_orderkey, o_custkey / 7 AS q, o_custkey % 7 AS r FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey % 7 AS r FROM orders"),
    "divide_by_zero": ("SELECT n_nationkey, 10 / n_regionkey AS q FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN 10 // n_regionkey END AS q FROM nation"),
    "case_searched": (
        "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size FROM orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice::DECIMAL(18,2) > 250000 THEN 'large' WHEN o_totalprice::DECIMAL(18,2) > 100000 THEN 'medium' ELSE 'small' END AS size FROM orders",
    ),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders", ""),
    "conditional": ("SELECT l_orderkey, l_linenumber, l_quantity > 25 ? 'many' : 'few' AS x FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS x FROM lineitem"),
    "is_null": ("SELECT COUNT(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL", ""),
    "is_identical": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus =?= 'F'", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F'"),
    "missing_attribute": ("SELECT r_name, NoSuch AS x, NoSuch + 1 AS y FROM region WHERE NoSuch IS NULL", "SELECT r_name, NULL::INTEGER AS x, NULL::INTEGER AS y FROM region"),
    "in_list_member": ("SELECT o_orderkey FROM orders WHERE member(o_orderpriority, {'1-URGENT', '2-HIGH'})", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "regexp_filter": ("SELECT p_partkey, p_name FROM part WHERE regexp('[aeiou]t', p_name)", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]t')"),
    "strcat_string": ("SELECT strcat(n_name, ':', string(n_regionkey)) AS s FROM nation", "SELECT concat(n_name, ':', n_regionkey::VARCHAR) AS s FROM nation"),
    "bitwise": ("SELECT o_orderkey, (o_orderkey & 12) | 1 AS b, o_orderkey ^ 5 AS c FROM orders", "SELECT o_orderkey, (o_orderkey & 12) | 1 AS b, xor(o_orderkey, 5) AS c FROM orders"),
    "distinct_cols": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", ""),
    "distinct_star": ("SELECT DISTINCT * FROM region", ""),
    "orderby_limit_topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS o_totalprice FROM orders ORDER BY o_totalprice::DECIMAL(18,2) DESC, o_orderkey LIMIT 10"),
    "count_star": ("SELECT COUNT(*) AS n FROM lineitem", ""),
    "count_attr": ("SELECT COUNT(l_shipdate) AS n, COUNT(*) AS a FROM lineitem WHERE l_quantity < 10", ""),
    "count_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", ""),
    "sum_avg_min_max": (
        "SELECT l_returnflag, SUM(l_extendedprice) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, AVG(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_filter_pivot": (
        "SELECT o_orderpriority, COUNT(*) AS total, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority",
        "",
    ),
    "case_lowering": (
        "SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, SUM(CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS c FROM orders GROUP BY o_orderpriority",
        "",
    ),
    "agg_expression": (
        "SELECT o_orderstatus, 100 * COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') / COUNT(*) AS share, MAX(o_custkey) - MIN(o_custkey) AS span FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, 100 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') // count(*) AS share, max(o_custkey) - min(o_custkey) AS span FROM orders GROUP BY o_orderstatus",
    ),
    "group_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", ""),
    "group_alias": ("SELECT o_custkey % 10 AS digit, COUNT(*) AS n FROM orders GROUP BY digit", "SELECT o_custkey % 10 AS digit, count(*) AS n FROM orders GROUP BY 1"),
    "group_case": (
        "SELECT CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS size, COUNT(*) AS n FROM lineitem GROUP BY CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END",
        "",
    ),
    "group_arith": ("SELECT l_linenumber / 2 AS half, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber / 2", "SELECT l_linenumber // 2 AS half, count(*) AS n FROM lineitem GROUP BY 1"),
    "having_agg": ("SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND n < 15", "SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS s FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND count(*) < 15"),
    "having_no_groupby": ("SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 3", ""),
    "having_only": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", ""),
    "time_bucket_hour": ("SELECT time_bucket(ts, '1h') AS b, COUNT(*) AS n FROM events GROUP BY time_bucket(ts, '1h')", "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS b, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1"),
    "time_bucket_day": ("SELECT time_bucket(ts, '1d') AS b, COUNT(DISTINCT user_id) AS n FROM events GROUP BY b", "SELECT (floor(epoch(ts) / 86400) * 86400)::BIGINT AS b, count(DISTINCT user_id) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1"),
    "time_bucket_label": ("SELECT time_bucket(ts, '1h') AS b, event_type, COUNT(*) AS n FROM events GROUP BY b, event_type", "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS b, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"),
    "time_filter_macro": ("SELECT event_id FROM events WHERE $__timeFilter(ts)", "SELECT event_id FROM events WHERE epoch(ts) >= 1704240000 AND epoch(ts) <= 1704672000"),
    "rank_row_number": ("SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events", ""),
    "rank_rank": ("SELECT s_suppkey, RANK() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey / 3 DESC) AS r FROM supplier", "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey // 3 DESC) AS r FROM supplier"),
    "rank_dense": ("SELECT s_suppkey, DENSE_RANK() OVER (ORDER BY s_nationkey) AS r FROM supplier", ""),
    "qualify_topn": (
        "SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events QUALIFY r <= 3",
        "",
    ),
}


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = expand(STATEMENTS[name][0], 1704240000, 1704672000)
        st = parse(text)
        exact = tuple(c for c in ("o_totalprice", "l_extendedprice") if f"SUM({c})" in text)
        out = run_select(_read(spark, sf_dir, st.table, exact, seconds=False), st, undefined_last=True)  # filters reach the scan
        return out.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in out.dtypes])

    return run


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, workspace(spark))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, as rows of a keyed table."""
    return _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("Key"), "event_id", "ts", "user_id", "event_type")


def engine_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, updated in and deleted from by statements, and read."""
    engine = _engine(spark)
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("Key"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    engine.write_rows("orders", orders)
    engine.sql("UPDATE orders SET o_orderpriority = 'none', o_custkey = 0 - o_custkey WHERE o_orderstatus = 'P'")
    engine.sql("BEGIN")
    engine.sql("DELETE FROM orders WHERE o_totalprice > 250000")
    engine.sql("INSERT INTO orders (Key, o_custkey, o_orderstatus) VALUES ('new', ?, 'N')", [-1])
    engine.sql("COMMIT")
    return engine.sql("SELECT Key, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice IS NULL OR o_totalprice > 1000")


def as_of_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events are written twice, a while apart; AS OF a time between reads the first state."""
    engine, events = _engine(spark), _read(spark, sf_dir, "events", seconds=False)
    seen = events.filter(F.col("ts") < F.timestamp_seconds(F.lit(1704844801)).cast(dict(events.dtypes)["ts"]))
    for at, log in ((1704844800, seen), (1704931200, events)):
        engine.clock = lambda at=at: at
        last = timeline.latest(log.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), "event_id", "event_type"), "user_id", ["ts", "event_id"])
        engine.write_rows("users", last.withColumn("Key", F.col("user_id").cast("string")))
    engine.clock = lambda: 1704931300
    return engine.sql("SELECT user_id, ts, event_id, event_type FROM users AS OF '-1h'")


def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return timeline.versions(log, "user_id", ["ts", "event_id"], "ts")


def scd2_gauge_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions of each event type are live at each day's start."""
    log = _read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return timeline.gauge_series(timeline.versions(log, "user_id", ["ts", "event_id"], "ts"), "ts", "superseded_at", 86400, ["event_type"])


def mv_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A materialised view of orders by status."""
    engine = _engine(spark)
    engine.register("orders", _read(spark, sf_dir, "orders", ("o_totalprice",)))
    engine.sql("CREATE MATERIALIZED VIEW totals AS SELECT o_orderstatus AS label_status, COUNT(*) AS metric_orders, SUM(o_totalprice) AS metric_value FROM orders GROUP BY o_orderstatus")
    return _doubles(engine.sql("SELECT * FROM totals"))


def continuous_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A continuous aggregate: most buckets are sealed, the last are open, and the oldest have gone."""
    engine = _engine(spark)
    engine.write_rows("events", _events(spark, sf_dir))
    engine.sql("CREATE MATERIALIZED VIEW hourly MAXSERIES 1000000000 AS SELECT time_bucket(ts, '1h') AS bucket, event_type, COUNT(*) AS n FROM events GROUP BY bucket, event_type WITH (grace = '10m', retention = '14d')")
    return engine.sql("SELECT bucket, event_type, n FROM hourly")


def watermark_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed hours of a stream whose views come in a second run: those for hours sealed before are dropped."""
    root, events = workspace(spark), _events(spark, sf_dir)
    hours = ContinuousAggregate("ts", 3600, ["event_type"], 600)
    for k, batch in enumerate((F.col("event_type") != "view", F.col("event_type") == "view")):
        events.filter(batch).write.parquet(f"{root}/in/batch={k}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        query = hours.start(stream, f"{root}/out", f"{root}/checkpoint")
        query.awaitTermination()
    return spark.read.schema("bucket long, event_type string, n long").parquet(f"{root}/out")


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ask for suppliers whose balance covers the price; both have expression texts."""
    part = _read(spark, sf_dir, "part").withColumn("Requirements", F.lit("TARGET.s_acctbal >= p_retailprice && p_size <= TARGET.s_nationkey")).withColumn("Rank", F.lit("TARGET.s_acctbal"))
    supplier = _read(spark, sf_dir, "supplier").withColumn("Requirements", F.lit("true"))
    return match.top(part, supplier, 2, "p_partkey", "s_suppkey", ("p_retailprice", "p_size")).select("request", "resource", "place")


def match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").withColumn("Requirements", F.lit("TARGET.s_acctbal >= p_retailprice && p_size <= TARGET.s_nationkey")).withColumn("Rank", F.lit("TARGET.s_acctbal"))
    return match.assign(part, _read(spark, sf_dir, "supplier"), 0, "p_partkey", "s_suppkey")


def cdc_delete_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return changes.delete_sweep(orders, orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 150000)), "o_custkey")


def dedupe_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return changes.first_delivery(events, ["user_id", "event_type"], ["event_id"])


def incremental_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second import takes: later than the mark, and those at the mark that the first did not have."""
    events = _read(spark, sf_dir, "events")
    mark = 1704844800
    had = events.filter((F.col("ts") == mark) & (F.col("event_type") == "view")).select("event_id")
    return changes.beyond_mark(events.select("event_id", "ts"), mark, "ts", had, "event_id")


def flatten_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_json(spark.read.parquet(f"{sf_dir}/events.parquet"), "props", ["k"]).select("event_id", "k")


def prom_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposition(mv_gauge(spark, sf_dir), "orders")


def watch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WATCH from the beginning of a table from which rows were deleted."""
    engine = _engine(spark)
    engine.write_rows("events", _events(spark, sf_dir))
    engine.sql("DELETE FROM events WHERE event_type = 'view'")
    return engine.sql("WATCH user_id, event_type, user_id * 2 AS twice FROM events WHERE user_id > 20 SINCE BEGINNING").drop("_seq")


OPERATORS = (engine_write_read, as_of_latest, scd2_versions, scd2_gauge_series, mv_gauge, continuous_agg, watermark_late_drop, match_candidates, match_greedy, cdc_delete_sweep, dedupe_history, incremental_import, flatten_doc, prom_export, watch_replay)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _statement(name) for name in STATEMENTS} | {f.__name__: f for f in OPERATORS}

ORACLE_SQL: dict[str, str] = {name: sql or text for name, (text, sql) in STATEMENTS.items()} | {
    "as_of_latest": "SELECT user_id, floor(epoch(ts))::BIGINT AS ts, event_id, event_type FROM events WHERE epoch(ts) < 1704844801 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) DESC, event_id DESC) = 1",
    "scd2_versions": "SELECT user_id, t AS ts, event_id, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS superseded_at FROM (SELECT *, floor(epoch(ts))::BIGINT AS t FROM events)",
    "scd2_gauge_series": """
WITH v AS (SELECT event_type, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS e FROM (SELECT *, floor(epoch(ts))::BIGINT AS t FROM events)),
steps AS (
  SELECT event_type, (ceil(t / 86400) * 86400)::BIGINT AS bucket, 1 AS d FROM v
  UNION ALL SELECT event_type, (ceil(e / 86400) * 86400)::BIGINT, -1 FROM v WHERE e IS NOT NULL)
SELECT event_type, bucket, (sum(sum(d)) OVER (PARTITION BY event_type ORDER BY bucket))::BIGINT AS active FROM steps GROUP BY event_type, bucket""",
    "engine_write_read": """
SELECT o_orderkey::VARCHAR AS Key, CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_totalprice <= 250000 AND o_totalprice > 1000 UNION ALL SELECT 'new', -1, 'N', NULL""",
    "mv_gauge": "SELECT o_orderstatus AS label_status, count(*) AS metric_orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS metric_value FROM orders GROUP BY 1",
    "continuous_agg": """
WITH b AS (SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS bucket, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT bucket, event_type, n FROM b WHERE bucket + 3600 > (SELECT max(bucket) FROM b) - 14 * 86400""",
    "watermark_late_drop": """
WITH e AS (SELECT floor(epoch(ts))::BIGINT AS t, event_type FROM events WHERE ts IS NOT NULL),
w AS (SELECT max(CASE WHEN event_type <> 'view' THEN t END) - 600 AS first_mark, max(t) - 600 AS last_mark FROM e)
SELECT t // 3600 * 3600 AS bucket, event_type, count(*) AS n FROM e, w
WHERE (event_type <> 'view' OR t // 3600 * 3600 + 3600 > first_mark) AND t // 3600 * 3600 + 3600 <= last_mark GROUP BY 1, 2""",
    "match_candidates": """
SELECT p_partkey AS request, s_suppkey AS resource, row_number() OVER (PARTITION BY p_partkey ORDER BY s_acctbal::DECIMAL(18,2) DESC, s_suppkey) AS place
FROM part JOIN supplier ON s_acctbal::DECIMAL(18,2) >= p_retailprice::DECIMAL(18,2) AND p_size <= s_nationkey QUALIFY place <= 2""",
    "cdc_delete_sweep": "SELECT DISTINCT o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P' AND x.o_totalprice::DECIMAL(18,2) > 150000)",
    "dedupe_history": "SELECT user_id, event_type, event_id, floor(epoch(ts))::BIGINT AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "incremental_import": "SELECT event_id, floor(epoch(ts))::BIGINT AS ts FROM events WHERE floor(epoch(ts)) > 1704844800 OR (floor(epoch(ts)) = 1704844800 AND event_type IS DISTINCT FROM 'view')",
    "flatten_doc": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "watch_replay": "SELECT 'upsert' AS _op, event_id::VARCHAR AS _key, user_id, event_type, user_id * 2 AS twice FROM events WHERE event_type <> 'view' AND user_id > 20",
}
