"""The dialect against small tables with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.select import run_select
from tidemark.plans.lexer import QueryError
from tidemark.plans.parser import parse

JOBS = [("1.0", "alice", 4, 100), ("1.1", "alice", 2, 200), ("2.0", "bob", 8, 300), ("2.1", "bob", 2, 400)]
STATES = [("alice", 4, 1), ("alice", 4, 2), ("alice", 2, 4), ("alice", 5, 8), ("bob", 4, 1), ("bob", 2, 2), ("bob", 2, 16)]
HOSTS = [("alice", "a", 4), ("alice", "a", 4), ("alice", "b", 2), ("bob", "c", 2), ("bob", "c", 2), ("carol", "a", 4)]
QUEUE = [("1", "alice", 30), ("2", "alice", 20), ("3", "alice", 10), ("4", "bob", 25), ("5", "bob", 15), ("6", "bob", 15)]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "jobs": spark.createDataFrame(JOBS, "Key string, Owner string, Cpus long, Mem long"),
        "states": spark.createDataFrame(STATES, "Owner string, JobStatus long, Cpus long"),
        "hosts": spark.createDataFrame(HOSTS, "Owner string, Host string, JobStatus long"),
        "queue": spark.createDataFrame(QUEUE, "Key string, Owner string, QDate long"),
        "times": spark.createDataFrame([(3600, 1), (3700, 2), (7200, 4), (7300, 8), (10800, 3), (None, 9), (-1, 5)], "at long, n long"),
    }


def rows(tables, text):
    st = parse(text)
    return [tuple(r) for r in run_select(tables[st.table], st).collect()]


CASES = [
    ("SELECT 2 * COUNT(*) AS a, SUM(Cpus)/COUNT(*) AS b, MAX(Mem)-MIN(Mem) AS c, (SUM(Cpus)+COUNT(*))*10 AS d FROM jobs", [(8, 4, 300, 200)]),
    ("SELECT Owner, SUM(Cpus)/COUNT(*) AS m FROM jobs GROUP BY Owner ORDER BY Owner", [("alice", 3), ("bob", 5)]),
    ("SELECT strcat(Owner, ':', string(COUNT(*))) AS s FROM jobs GROUP BY Owner ORDER BY s", [("alice:2",), ("bob:2",)]),
    ("SELECT Owner, COUNT(*) AS t, COUNT(*) FILTER (WHERE JobStatus = 2) AS r, COUNT(*) FILTER (WHERE JobStatus = 4) AS d FROM states GROUP BY Owner ORDER BY Owner", [("alice", 4, 1, 2), ("bob", 3, 2, 1)]),
    ("SELECT Owner, 100 * COUNT(*) FILTER (WHERE JobStatus = 2) / COUNT(*) AS p FROM states GROUP BY Owner ORDER BY Owner", [("alice", 25), ("bob", 66)]),
    ("SELECT SUM(Cpus) FILTER (WHERE JobStatus=2) AS s, MAX(Cpus) FILTER (WHERE JobStatus=2) AS m, COUNT(*) FILTER (WHERE JobStatus=9) AS z FROM states", [(22, 16, 0)]),
    ("SELECT Owner, SUM(Cpus) AS s FROM jobs GROUP BY Owner HAVING SUM(Cpus) > 8", [("bob", 10)]),
    ("SELECT COUNT(*) AS n FROM jobs HAVING COUNT(*) > 3", [(4,)]),
    ("SELECT COUNT(*) AS n FROM jobs HAVING COUNT(*) > 100", []),
    ("SELECT COUNT(DISTINCT Owner) AS o, COUNT(DISTINCT Host) AS h, COUNT(*) AS n FROM hosts", [(3, 3, 6)]),
    ("SELECT Owner, COUNT(DISTINCT Host) AS h FROM hosts GROUP BY Owner ORDER BY Owner", [("alice", 2), ("bob", 1), ("carol", 1)]),
    ("SELECT Key, RANK() OVER (PARTITION BY Owner ORDER BY QDate DESC) AS r FROM queue ORDER BY Key", [("1", 1), ("2", 2), ("3", 3), ("4", 1), ("5", 2), ("6", 2)]),
    ("SELECT Key, DENSE_RANK() OVER (ORDER BY QDate) AS r FROM queue QUALIFY r <= 2 ORDER BY Key", [("3", 1), ("5", 2), ("6", 2)]),
    ("SELECT Key, ROW_NUMBER() OVER (PARTITION BY Owner ORDER BY QDate DESC, Key) AS r FROM queue QUALIFY r <= 2 ORDER BY Key", [("1", 1), ("2", 2), ("4", 1), ("5", 2)]),
    ("SELECT time_bucket(at, '1h') AS b, COUNT(*) AS n, SUM(n) AS s FROM times GROUP BY b ORDER BY b", [(-3600, 1, 5), (3600, 2, 3), (7200, 2, 12), (10800, 1, 3)]),
    ("SELECT CASE WHEN Mem > 150 THEN 'big' ELSE 'small' END AS size, COUNT(*) AS n FROM jobs GROUP BY size ORDER BY size", [("big", 3), ("small", 1)]),
    ("SELECT Mem / 1000 AS z, Mem / 0 AS e, NoSuch AS u FROM jobs ORDER BY Mem LIMIT 1", [(0, None, None)]),
    ("SELECT Key FROM jobs ORDER BY Mem DESC LIMIT 2", [("2.1",), ("2.0",)]),
    ("SELECT DISTINCT Owner FROM jobs ORDER BY Owner DESC", [("bob",), ("alice",)]),
    ("SELECT NoSuch ? 1 : 2 AS a, CASE WHEN NoSuch THEN 1 ELSE 2 END AS b FROM jobs LIMIT 1", [(None, 2)]),
    ("SELECT member(Cpus, {4, 8}) AS m, size({1, 2}) AS n FROM jobs WHERE Key = '1.0'", [(True, 2)]),
    ("SELECT Owner =?= 'alice' AS a, Owner =?= 1 AS b, NoSuch =?= undefined AS c FROM jobs WHERE Key = '1.0'", [(True, False, True)]),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_select(tables, text, expected):
    assert rows(tables, text) == expected


def test_empty_global_aggregate(tables):
    assert rows(tables, "SELECT COUNT(*) AS n, SUM(Cpus) AS s FROM jobs WHERE Cpus > 99") == [(0, None)]


def test_filter_reaches_the_scan(spark, tables, tmp_path):
    tables["jobs"].write.parquet(f"{tmp_path}/j")
    st = parse("SELECT Owner FROM j WHERE Cpus > 3")
    plan = run_select(spark.read.parquet(f"{tmp_path}/j"), st)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Cpus,3)" in plan and "Mem#" not in plan


def test_writes_and_time_travel(engine):
    now = [1000.0]
    engine.clock = lambda: now[0]
    engine.sql("CREATE TABLE ads")
    engine.sql("INSERT INTO ads (Key, JobStatus, Req) VALUES ('k', 1, Memory > 1024)")
    now[0] = 2000.0
    assert engine.sql("UPDATE ads SET JobStatus = JobStatus + 1 WHERE Key = 'k'").first()[0] == 1
    assert [tuple(r) for r in engine.sql("SELECT JobStatus, Req FROM ads").collect()] == [(2, None)]  # no Memory
    at = datetime.datetime.fromtimestamp(1500).isoformat()
    assert engine.sql(f"SELECT JobStatus FROM ads AS OF '{at}'").first()[0] == 1
    assert engine.sql("SELECT COUNT(*) AS n FROM ads AS OF '-1500s'").first()[0] == 0
    engine.sql("INSERT INTO ads (JobStatus) VALUES (7)")
    assert engine.sql("DELETE FROM ads WHERE JobStatus = 2").first()[0] == 1
    assert [r[0] for r in engine.sql("SELECT Key FROM ads").collect()] == ["row-1"]
    with pytest.raises(QueryError):
        engine.sql("UPDATE ads SET Key = 'x'")
    watched = engine.sql("WATCH JobStatus FROM ads SINCE BEGINNING").collect()
    assert [(r["_op"], r["JobStatus"]) for r in watched] == [("upsert", 7)]
    engine.log("ads").compact()
    assert engine.sql("SELECT COUNT(*) AS n FROM ads").first()[0] == 1


def test_transaction(engine):
    engine.sql("CREATE TABLE t")
    engine.sql("INSERT INTO t (Key, a) VALUES ('x', 1)")
    engine.sql("BEGIN")
    with pytest.raises(QueryError):
        engine.sql("BEGIN")
    engine.sql("INSERT INTO t (Key, a) VALUES ('y', 2)")
    engine.sql("UPDATE t SET a = 5 WHERE Key = 'x'")
    assert sorted(tuple(r) for r in engine.sql("SELECT Key, a FROM t").collect()) == [("x", 5), ("y", 2)]
    with pytest.raises(QueryError):
        engine.sql("INSERT INTO u (Key) VALUES ('z')")
    engine.sql("ROLLBACK")
    assert [tuple(r) for r in engine.sql("SELECT Key, a FROM t").collect()] == [("x", 1)]
    engine.sql("BEGIN WORK")
    engine.sql("DELETE FROM t WHERE Key = 'x'")
    engine.sql("INSERT INTO t (Key, a) VALUES ('z', 3)")
    engine.sql("COMMIT")
    assert [tuple(r) for r in engine.sql("SELECT Key, a FROM t").collect()] == [("z", 3)]


def test_match(engine, spark):
    engine.register("machines", spark.createDataFrame([("slot1", 8, "X86_64", "true"), ("slot2", 4, "X86_64", "true"), ("slot3", 16, "ARM", "true")], "Key string, Cpus long, Arch string, Requirements string"))
    engine.register("jobs", spark.createDataFrame([(k, 4, "TARGET.Cpus >= RequestCpus", "TARGET.Cpus") for k in ("1.0", "2.0")], "Key string, RequestCpus long, Requirements string, Rank string"))
    assert tuple(engine.sql("MATCH jobs TO machines").first()) == ("1.0", "slot3", 16.0)
    assert engine.sql("MATCH jobs TO machines WHERE TARGET Arch = 'X86_64'").first()["Resource"] == "slot1"
    assert [r["Resource"] for r in engine.sql("MATCH jobs TO machines USING (RequestCpus) LIMIT 5").collect()] == ["slot3", "slot1"]
    assert [r["Resource"] for r in engine.sql("MATCH KEY '2.0' IN jobs TO machines WHERE TARGET Cpus > 99").collect()] == [None]


def test_view_and_exposition(engine, spark):
    from tidemark.shell import Shell

    engine.register("jobs", spark.createDataFrame([("1.0", "alice", 1, 100), ("1.1", "alice", 1, 200), ("4.0", "bob", 1, 400)], "Key string, Owner string, JobStatus long, RequestMemory long"))
    engine.sql("CREATE MATERIALIZED VIEW cluster_usage AS SELECT Owner AS label_owner, JobStatus AS label_status, SUM(RequestMemory) AS metric_memory FROM jobs GROUP BY Owner, JobStatus")
    shell = Shell(engine)
    assert 'cluster_usage_memory{owner="bob",status="1"} 400' in shell.run(".export cluster_usage")
    assert shell.run(".views") == "cluster_usage"
    assert shell.run(".frob").startswith("unknown command")
    assert "error:" in shell.run("SELECT * FROM nowhere")
    shell.run(".format json")
    assert '"label_owner":"bob"' in shell.run("SELECT * FROM cluster_usage WHERE label_owner = 'bob'")
    engine.sql("CREATE MATERIALIZED VIEW small MAXSERIES 1 AS SELECT Owner, COUNT(*) AS n FROM jobs GROUP BY Owner")
    with pytest.raises(QueryError, match="more than 1 series"):
        engine.sql("SELECT * FROM small")
    engine.sql("DROP MATERIALIZED VIEW small")
    assert "limit: 1 applied after ORDER BY" in "\n".join(r[0] for r in engine.sql("EXPLAIN SELECT Key FROM jobs ORDER BY Key LIMIT 1").collect())


def test_dbapi(engine, spark):
    from tidemark import dbapi

    engine.register("jobs", spark.createDataFrame(JOBS, "Key string, Owner string, Cpus long, Mem long"))
    c = dbapi.connect(engine)
    cur = c.execute("SELECT Key, Cpus FROM jobs WHERE Owner = ? AND Mem > ? ORDER BY Key", ["bob", 1])
    assert [d[0] for d in cur.description] == ["Key", "Cpus"] and cur.fetchone() == ("2.0", 8) and cur.fetchall() == [("2.1", 2)]
    assert list(c.mappings("SELECT Key, NoSuch FROM jobs WHERE Key = '1.0'")) == [{"Key": "1.0"}]
    with pytest.raises(dbapi.ProgrammingError):
        c.execute("SELECT")


def test_write_rows(engine, spark):
    n, bad = engine.write_rows("w", spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "Key string, v long"))
    assert n == 1 and bad.count() == 3
    assert [tuple(r) for r in engine.sql("SELECT Key, v FROM w").collect()] == [("a", 1)]


def test_archive(engine, spark):
    from tidemark.shell import Shell

    archive = engine.archive("history", "CompletionDate")
    assert archive.rows().count() == 0
    archive.append(spark.createDataFrame([(1, 1_700_000_000), (2, 1_700_000_100), (3, None)], "ClusterId long, CompletionDate long"))
    archive.append(spark.createDataFrame([(4, 1_700_200_000)], "ClusterId long, CompletionDate long"))
    assert [r["ClusterId"] for r in archive.newest(2).collect()] == [4, 2]
    assert [r[0] for r in engine.sql("SELECT ClusterId FROM history ORDER BY ClusterId DESC LIMIT 2").collect()] == [4, 3]
    assert archive.rows(1_700_000_050, 1_700_100_000).count() == 1
    with pytest.raises(QueryError):
        engine.sql("SELECT ClusterId FROM history AS OF '-1h'")
    with pytest.raises(QueryError):
        engine.sql("DELETE FROM history")
    assert archive.retain(1_700_300_000, age=150_000) == [0, 1_700_000_000 // 86_400]
    shell = Shell(engine)
    shell.table = "history"
    assert shell.run(".retention 1") == "days kept: 1, dropped: 0"
    assert "ClusterId" in shell.run(".suggest")


def test_snapshot_and_follower(engine, spark, tmp_path):
    from tidemark.engine import Engine
    from tidemark.sources.snapshots import apply_events, restore, snapshot

    engine.sql("CREATE TABLE t")
    engine.sql("INSERT INTO t (Key, a) VALUES ('x', 1)")
    assert [snapshot(spark, engine.root, f"file://{tmp_path}/snap", str(k), keep=2) for k in range(3)][-1] == ["1", "2"]
    restore(spark, f"file://{tmp_path}/snap/2", f"file://{tmp_path}/again")
    other = Engine(spark, f"file://{tmp_path}/again")
    assert tuple(other.sql("SELECT Key, a FROM t").first()) == ("x", 1)
    cursor = apply_events(other.log("copy"), engine.log("t").events(), 0)
    engine.sql("INSERT INTO t (Key, a) VALUES ('y', 2)")
    engine.sql("DELETE FROM t WHERE Key = 'x'")
    again = apply_events(other.log("copy"), engine.log("t").events(), cursor)
    assert again == apply_events(other.log("copy"), engine.log("t").events(), again)
    assert [tuple(r) for r in other.sql("SELECT Key, a FROM copy").collect()] == [("y", 2)]
    reset = engine.log("t").events().limit(1).withColumn("_op", F.lit("reset")).withColumn("_seq", F.lit(again + 1).cast("long"))
    apply_events(other.log("copy"), reset, again)
    assert other.sql("SELECT COUNT(*) AS n FROM copy").first()[0] == 0


def test_match_many_texts(spark, monkeypatch):
    """More distinct texts than one join compiles, on either side, and rows without a text."""
    from tidemark.operators import match

    monkeypatch.setattr(match, "MOST_TEXTS", 12)
    requests = [(f"q{k}", k % 7, f"TARGET.size >= {k}" if k % 6 else None, f"TARGET.size * {k % 3}") for k in range(30)]
    resources = [(f"r{k}", k, f"TARGET.need <= {k % 17}") for k in range(24)]
    a = spark.createDataFrame(requests, "Key string, need long, Requirements string, Rank string")
    b = spark.createDataFrame(resources, "Key string, size long, Requirements string")
    want = {(f"q{q}", f"r{r}", float(r * (q % 3))) for q in range(30) for r in range(24) if (q % 6 == 0 or r >= q) and q % 7 <= r % 17}
    assert len(match._parts(a, ("Requirements", "Rank"))) > 1 and len(match._parts(b, ("Requirements",))) > 1
    got = [tuple(r) for r in match.candidates(a, b).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in match.candidates(a, b, using=("need",)).collect()} == want


def test_match_greedy_all_parts(spark, tmp_path):
    from tidemark.queries import QUERIES

    parts = [(k, float(900 + k * 37 % 500), k % 25) for k in range(1, 121)]
    suppliers = [(k, float(1000 + k * 53 % 700), k % 25) for k in range(1, 91)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    taken, want = set(), {}
    for key, price, size in parts:
        free = [(-balance, s) for s, balance, nation in suppliers if s not in taken and balance >= price and size <= nation]
        want[key] = min(free)[1] if free else None
        taken.add(want[key])
    got = {r["request"]: r["resource"] for r in QUERIES["match_greedy"](spark, str(tmp_path)).collect()}
    assert got == want and len(taken) > 41


def _market(spark, rank_type="double"):
    """Requests and resources with ties, undefined values and attributes of few values."""
    requests = [(f"q{k:02}", k * 7 % 5 if k % 11 else None, float(k * 13 % 17) if k % 9 else None) for k in range(40)]
    resources = [(f"r{k:02}", k * 3 % 6 if k % 10 else None, float(k * 29 % 23) if k % 8 else None) for k in range(50)]
    a = spark.createDataFrame(requests, "Key string, Cpus long, Need double")
    b = spark.createDataFrame(resources, "Key string, Slots long, Size double")
    return a.withColumn("Need", F.col("Need").cast(rank_type)), b.withColumn("Size", F.col("Size").cast(rank_type))


#: Requirements and Rank of the requests, Requirements of the resources, type of Need and Size.
MARKETS = [
    ("TARGET.Size >= Need && Cpus <= TARGET.Slots", "TARGET.Size", "true", "double"),
    ("TARGET.Size > Need && Cpus <= TARGET.Slots", "Size", "Size != 4 && TARGET.Cpus > 0", "decimal(18,2)"),
    ("TARGET.Size >= Need", "TARGET.Size", "TARGET.Need + 1 < Size", "long"),
    ("TARGET.Size >= Cpus", "TARGET.Size", "true", "decimal(18,2)"),
    ("TARGET.Size >= Need && Cpus <= TARGET.Slots", "TARGET.Size * (Cpus - 2)", "true", "double"),
    ("TARGET.Size <= Need || Cpus == TARGET.Slots", "0 - TARGET.Size", "TARGET.Cpus != 3", "double"),
    ("Need > 3", "TARGET.Slots", "Slots < 4", "double"),
    ("TARGET.Size >= Need", None, None, "double"),
    (None, "TARGET.Slots", "true", "double"),
]


def _with_texts(a, b, mine, rank, theirs):
    a = a.withColumn("Requirements", F.lit(mine)) if mine else a
    a = a.withColumn("Rank", F.lit(rank)) if rank else a
    return a, b.withColumn("Requirements", F.lit(theirs)) if theirs else b


@pytest.mark.parametrize(("mine", "rank", "theirs", "kind"), MARKETS)
def test_match_best(spark, mine, rank, theirs, kind):
    """The best resources are those of all candidates."""
    from tidemark.operators import match

    a, b = _with_texts(*_market(spark, kind), mine, rank, theirs)
    for using in ((), ("Cpus", "Need"), ("Need",)):
        want = match.top_candidates(match.candidates(a, b, using=using), 3).collect()
        got = match.top(a, b, 3, using=using).collect()
        assert want or using == ("Need",)
        assert sorted((r["request"], r["place"], r["resource"], r["rank"]) for r in got) == sorted((r["request"], r["place"], r["resource"], r["rank"]) for r in want), using


def test_match_best_of_many_texts(spark, monkeypatch):
    from tidemark.operators import match

    monkeypatch.setattr(match, "MOST_TEXTS", 12)
    a, b = _market(spark)
    a = a.withColumn("Requirements", F.concat(F.lit("TARGET.Size >= Need + "), F.substring("Key", 3, 1))).withColumn("Rank", F.when(F.col("Cpus") > 2, "TARGET.Size").otherwise("0 - TARGET.Slots"))
    b = b.withColumn("Requirements", F.when(F.col("Slots") > 1, F.concat(F.lit("TARGET.Cpus != "), F.substring("Key", 3, 1))))
    want = match.top_candidates(match.candidates(a, b), 2).select("request", "resource", "place").collect()
    assert want and sorted(map(tuple, match.top(a, b, 2).select("request", "resource", "place").collect())) == sorted(map(tuple, want))


def test_match_bound_beyond_doubles(spark):
    """Balances that are one double, but not one decimal."""
    from tidemark.operators import match

    base = 9_007_199_254_740_992
    a = spark.createDataFrame([("q", base + 1)], "Key string, Need long").withColumn("Requirements", F.lit("TARGET.Size >= Need")).withColumn("Rank", F.lit("TARGET.Size"))
    b = spark.createDataFrame([("r1", base), ("r2", base + 1)], "Key string, Size long")
    assert [r["resource"] for r in match.top(a, b, 1).collect()] == ["r2"]


def test_match_best_joins_few(spark, tmp_path, monkeypatch):
    """Of resources that no bound but the rank's tells apart, only the best are joined."""
    from tidemark.operators import match
    from tidemark.queries import QUERIES

    spark.range(300).selectExpr("id AS p_partkey", "double(900 + id % 50) AS p_retailprice", "int(id % 30) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2000).selectExpr("id AS s_suppkey", "double(id * 37 % 3000) AS s_acctbal", "int(id % 25) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    seen, best = [], match.top_candidates
    monkeypatch.setattr(match, "top_candidates", lambda pairs, n: seen.append(pairs) or best(pairs, n))
    assert QUERIES["match_candidates"](spark, str(tmp_path)).count() == 2 * 250
    assert 0 < seen[0].count() <= 150 * 25 * 2


@pytest.mark.parametrize(("mine", "rank", "theirs", "kind"), MARKETS)
@pytest.mark.parametrize("limit", [0, 7])
def test_match_assignment(spark, mine, rank, theirs, kind, limit):
    """Each request takes the best candidate that none before it took."""
    from tidemark.operators import match

    a, b = _with_texts(*_market(spark, kind), mine, rank, theirs)
    _same_assignment(match, a, b, limit)


def _same_assignment(match, a, b, limit=0, using=()):
    pairs = sorted((r["request"], -r["rank"], r["resource"]) for r in match.candidates(a, b, using=using).collect())
    taken, want = set(), {}
    for q in sorted(r["Key"] for r in a.collect())[: limit or None]:
        free = [(r, -k) for p, k, r in pairs if p == q and r not in taken]
        want[q] = free[0] if free else (None, None)
        taken.add(want[q][0])
    got = match.assign(a, b, limit, using=using).collect()
    assert len(got) == len(want) and {r["request"]: (r["resource"], r["rank"]) for r in got} == want


def test_match_assignment_of_many_texts(spark, monkeypatch):
    from tidemark.operators import match

    monkeypatch.setattr(match, "MOST_TEXTS", 12)
    a, b = _market(spark)
    _same_assignment(match, a.withColumn("Requirements", F.lit("TARGET.Size >= Need")), b, using=("Need",))
    a = a.withColumn("Requirements", F.concat(F.lit("TARGET.Size >= Need + "), F.substring("Key", 3, 1))).withColumn("Rank", F.when(F.col("Cpus") > 2, "TARGET.Size").otherwise("0 - TARGET.Slots"))
    _same_assignment(match, a, b.withColumn("Requirements", F.when(F.col("Slots") > 1, F.concat(F.lit("TARGET.Cpus != "), F.substring("Key", 3, 1)))))
    variant = b.withColumn("Slots", F.expr("CASE WHEN Slots = 2 THEN parse_json('true') ELSE cast(Slots AS variant) END"))
    _same_assignment(match, a.withColumn("Requirements", F.lit("TARGET.Slots >= Cpus")).drop("Rank"), variant)


def test_match_assignment_streams_few(spark, tmp_path, monkeypatch):
    """The task that assigns is sent requests, resources and classes, not the candidates."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from tidemark.queries import QUERIES

    spark.range(600).selectExpr("id AS p_partkey", "double(900 + id % 50) AS p_retailprice", "int(id % 30) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).selectExpr("id AS s_suppkey", "double(id * 37 % 3000) AS s_acctbal", "int(id % 25) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    seen = []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(Classic, name, lambda self, *args, run=getattr(Classic, name), **more: seen.append(self) or run(self, *args, **more))
    assert QUERIES["match_greedy"](spark, str(tmp_path)).count() == 600
    assert len(seen) == 1 and seen[0].count() <= 600 + 400 + 30 * 25


def test_wide_rows_survive(engine, spark):
    """Each write keeps every row, also when adaptive execution merges shuffle partitions."""
    wide = spark.range(40_000).select(F.col("id").cast("string").alias("Key"), F.col("id").alias("n"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 16).alias("pad"))
    assert engine.write_rows("wide", wide)[0] == 40_000
    assert engine.sql("SELECT COUNT(*) AS n FROM wide").first()[0] == 40_000
    assert engine.sql("UPDATE wide SET n = n + 1 WHERE n < 30000").first()[0] == 30_000
    assert tuple(engine.table("wide").agg(F.count("*"), F.sum("n")).first()) == (40_000, sum(range(40_000)) + 30_000)
    assert engine.sql("DELETE FROM wide WHERE n > 35000").first()[0] == 4_999
    assert engine.sql("SELECT COUNT(*) AS n FROM wide").first()[0] == 35_001
    events = engine.log("wide").events()
    assert events.count() == events.select("_seq").distinct().count() == 74_999


def test_restart(engine, spark):
    from tidemark.engine import Engine

    engine.sql("CREATE TABLE t")
    engine.sql("INSERT INTO t (a) VALUES (1)")
    engine.sql("CREATE INDEX ON t (a)")
    engine.sql("CREATE MATERIALIZED VIEW v AS SELECT a, COUNT(*) AS n FROM t GROUP BY a")
    engine.archive("old", "at").append(spark.createDataFrame([(1, 5)], "x long, at long"))
    engine.sql("CREATE TABLE m MEMORY")
    engine.sql("INSERT INTO m (Key, a) VALUES ('x', 1)")
    engine.sql("UPDATE m SET a = 2")
    assert [tuple(r) for r in engine.sql("SELECT * FROM m").collect()] == [("x", 2)]
    again = Engine(spark, engine.root)
    again.sql("INSERT INTO t (a) VALUES (2)")
    assert sorted(tuple(r) for r in again.sql("SELECT * FROM t").collect()) == [("row-1", 1), ("row-2", 2)]
    assert again.tables() == ["old", "t", "v"] and again.indexes == {("t", "a"): "VALUE"}
    assert sorted(tuple(r) for r in again.sql("SELECT * FROM v").collect()) == [(1, 1), (2, 1)]
    assert again.sql("SELECT x FROM old").first()[0] == 1


def test_second_writer(engine, spark, monkeypatch):
    """One of two writers that saw the same state is refused; what it wrote is never read."""
    engine.sql("CREATE TABLE t")
    one, two = engine.log("t"), engine.log("t")
    seen = two._state()
    event = spark.createDataFrame([("upsert", "x", "x", 1)], "_op string, _key string, Key string, a long")
    one.append(event)
    monkeypatch.setattr(two, "_state", lambda: seen)
    with pytest.raises(QueryError):
        two.append(event)
    assert one.events().count() == 1
    staged = one.commits()  # a writer that breaks off between its record and the move
    fs, data = one._fs(f"{one.root}/{staged[0]}")
    fs.rename(data, one._fs(f"{one.root}/{staged[0].replace('data/', '_staging/')}")[1])
    assert one.events().count() == 1
    one.append(spark.createDataFrame([("upsert", "y", "y", 2)], "_op string, _key string, Key string, a long"))
    assert one.events().count() == 2 and not one._staged() - {c for c in one._staged() if "commit-000000000002" in c}


def test_columns_of_several_types(engine):
    for k, v in enumerate(("42", "'text'", "true", "UNDEFINED", "2.5", "'42'")):
        engine.sql(f"INSERT INTO h (Key, V, W) VALUES ('{k}', {v}, {k if k % 2 else k + 0.5})")
    got = {r["Key"]: r["V"].toPython() if r["V"] is not None else None for r in engine.sql("SELECT Key, V FROM h").collect()}
    assert got == {"0": 42, "1": "text", "2": True, "3": None, "4": 2.5, "5": "42"}
    assert [r[0] for r in engine.sql("SELECT Key FROM h WHERE V > 2 ORDER BY Key").collect()] == ["0", "4"]
    assert [r[0] for r in engine.sql("SELECT Key FROM h WHERE V = 'text'").collect()] == ["1"]
    assert [r[0] for r in engine.sql("SELECT Key FROM h WHERE V IS NULL").collect()] == ["3"]
    assert engine.sql("SELECT SUM(V) AS s, COUNT(DISTINCT V) AS n, SUM(W) AS w FROM h").first() == (44.5, 4, 16.5)
    assert {r["V"]: r["n"] for r in engine.sql("SELECT V, COUNT(*) AS n FROM h GROUP BY V").collect()} == {"42": 2, "text": 1, "true": 1, None: 1, "2.5": 1}
    engine.log("h").compact()
    assert engine.sql("SELECT COUNT(V) AS n FROM h WHERE V =?= '42'").first()[0] == 1


def test_attributes_with_expressions(engine):
    engine.sql("INSERT INTO ads (Key, Memory, Big, Bad, Own, A, B) VALUES ('x', 2048, Memory > 1024, Memory / 0, Own + 1, B + 1, A + 1)")
    engine.sql("INSERT INTO ads (Key, Memory, Big, Twice, Four) VALUES ('y', 512, 'no', Memory * 2, Twice * 2)")
    assert engine.sql("SELECT Big, Bad, Own, A, B FROM ads WHERE Key = 'x'").first()[1:] == (None, None, None, None)
    assert {r["Key"]: r["Big"].toPython() for r in engine.sql("SELECT Key, Big FROM ads").collect()} == {"x": True, "y": "no"}
    assert engine.sql("SELECT Key, Four FROM ads WHERE Twice = 1024").collect() == [("y", 2048)]
    assert engine.sql("UPDATE ads SET Memory = 4096 WHERE Four = 2048").first()[0] == 1
    assert engine.sql("SELECT Four, Twice FROM ads WHERE Key = 'y'").first() == (16384, 8192)
    engine.sql("UPDATE ads SET Twice = 1 WHERE Key = 'y'")
    assert engine.sql("SELECT Four FROM ads WHERE Key = 'y'").first()[0] == 2
    assert sorted(engine.sql("SELECT * FROM ads").columns) == sorted(["Key", "Memory", "Big", "Bad", "Own", "A", "B", "Twice", "Four"])
    engine.sql("INSERT INTO slots (Key, Cpus, Requirements) VALUES ('s', 8, TARGET.Cpus <= Cpus)")
    engine.sql("INSERT INTO jobs (Key, Cpus, Rank) VALUES ('j', 4, TARGET.Cpus)")
    engine.sql("INSERT INTO jobs (Key, Cpus) VALUES ('k', 40)")
    assert [tuple(r) for r in engine.sql("MATCH jobs TO slots LIMIT 2").collect()] == [("j", "s", 8.0), ("k", None, None)]


def test_continuous_view(engine):
    """Buckets are sealed once; rows for a sealed bucket are late; old buckets go."""
    def put(key, at, owner="alice"):
        engine.sql(f"INSERT INTO jobs (Key, QDate, Owner) VALUES ('{key}', {at}, '{owner}')")

    for k, (at, owner) in enumerate([(3600, "alice"), (3700, "alice"), (3800, "bob"), (7200, "alice")]):
        put(k, at, owner)
    engine.sql("CREATE MATERIALIZED VIEW hourly AS SELECT time_bucket(QDate, '1h') AS b, Owner, COUNT(*) AS n FROM jobs GROUP BY b, Owner WITH (grace = '10m', retention = '3h')")
    read = lambda: sorted(tuple(r) for r in engine.sql("SELECT b, Owner, n FROM hourly").collect())
    assert read() == [(3600, "alice", 2), (3600, "bob", 1), (7200, "alice", 1)]
    put("in time", 3900)
    assert read()[0] == (3600, "alice", 3)
    put("seals", 7900)
    assert read() == [(3600, "alice", 3), (3600, "bob", 1), (7200, "alice", 2)] and engine.seal("hourly")["sealed"] == 7200
    put("late", 3950)
    put("x", 7300)
    assert read() == [(3600, "alice", 3), (3600, "bob", 1), (7200, "alice", 3)]
    assert engine.seal("hourly")["late"] == 1
    put("far", 36000)
    assert read() == [(36000, "alice", 1)]
    assert engine.seal("hourly", 50_000)["sealed"] == 46_800 and read() == [(36000, "alice", 1)]
    engine.sql("DROP MATERIALIZED VIEW hourly")
    assert engine.tables() == ["jobs"]
