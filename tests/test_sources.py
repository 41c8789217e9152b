import io
import tarfile

from pyspark.sql import functions as F

from tidemark.operators import changes, timeline
from tidemark.sources import documents, joblog, records, tarballs
from tidemark.streaming.continuous import ContinuousAggregate, late_rows
from tidemark.streaming.exporters import export, lost, message_records, tombstones
from tidemark.streaming.watch import follow


def test_load_records(spark, tmp_path):
    (tmp_path / "ads").write_text('Name = "a"\nCpus = 4\nLoad = 0.5\nOk = true\nRank = Cpus + 1\nMyType = "Machine"\n\nname = "b"\nCPUS = 8\nLoad = 1\nOk = FALSE\nRank = 2\nMyType = "Machine"\n\n\nCpus = 1\n\nbroken line\n')
    rows, bad = records.load_records(spark, f"file://{tmp_path}/ads", auto=True)
    got = {r["_key"]: r.asDict() for r in rows.collect()}
    assert set(got) == {"a", "b"} and got["a"]["Rank"] == "Cpus + 1" and got["a"]["_table"] == "machines"
    cpus = next(k for k in got["a"] if k.lower() == "cpus")
    assert got["b"][cpus] == 8 and got["a"]["Ok"] is True and got["b"]["Load"] == 1.0
    assert bad.count() == 2


def test_render(spark):
    df = spark.createDataFrame([("a", 1, None)], "Key string, n long, x string")
    assert [records.render(df, s).first()[0] for s in ("json", "old", "new")] == ['{"Key":"a","n":1}', 'Key = "a"\nn = 1\n', '[Key = "a"; n = 1]']


def test_job_log(spark, tmp_path):
    log = "107 1 CreationTimestamp 1\n101 01.-1 Job Machine\n103 01.-1 Owner \"al ice\"\n101 1.0 Job Machine\n103 1.0 Cpus 4\n103 1.0 Cpus 5\n103 1.0 X 1\n104 1.0 X\n101 2.0 Job Machine\n103 2.0 Cpus 1\n102 2.0\n105\n103 1.0 Lost 1\n"
    (tmp_path / "log").write_text(log)
    held = joblog.attributes(joblog.read_log(spark, f"file://{tmp_path}/log"))
    assert sorted(map(tuple, held.collect())) == [("01.-1", "Owner", '"al ice"'), ("1.0", "Cpus", "5")]
    assert sorted(map(tuple, joblog.inherit(held).collect())) == [("1.0", "Cpus", "5"), ("1.0", "Owner", '"al ice"')]
    (tmp_path / "again").write_text("\n".join(r[0] for r in joblog.write_log(held).collect()))
    again = joblog.attributes(joblog.read_log(spark, f"file://{tmp_path}/again"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, held.collect()))


def test_history(spark, tmp_path):
    (tmp_path / "h").write_text("ClusterId = 1\nProcId = 0\nOwner = \"a\"\n*** Offset = 0\nClusterId = 2\nProcId = 0\n*** Offset = 9\nClusterId = 1\nProcId = 0\n*** Offset = 20\n")
    assert sorted(r["key"] for r in joblog.read_history(spark, f"file://{tmp_path}/h", 5).collect()) == ["1.0", "2.0"]


def test_job_documents(spark):
    df = spark.createDataFrame([("s#1.0#9", 4, 5, 100, 0, "slot1@host", "x" * 300), ("s#2.0#9", None, 5, 1, 1, None, "")], "GlobalJobId string, JobStatus long, JobUniverse long, CompletionDate long, QDate long, RemoteHost string, Note string")
    (d,) = documents.job_documents(df, 7).collect()
    assert (d["_id"], d["ScheddName"], d["StartdSlot"], d["StartdName"], d["Status"], d["Universe"], d["QDate"], len(d["Note"])) == ("s#1.0#9#100", "s", "slot1", "host", "Completed", "Vanilla", None, 256)


def test_tarballs(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(7)], "_key string, v long").coalesce(1)
    files = tarballs.pack_records(df, 3).collect()
    assert sorted(f["records"] for f in files) == [1, 3, 3]
    with tarfile.open(fileobj=io.BytesIO(files[0]["content"])) as tar:
        assert b"v = " in tar.extractfile(tar.getmembers()[0]).read()


def test_timeline(spark):
    log = spark.createDataFrame([("a", 1, "upsert", 1), ("a", 5, "upsert", 2), ("b", 2, "upsert", 3), ("b", 3, "delete", None)], "k string, t long, op string, v long")
    assert sorted(map(tuple, timeline.latest(log, "k", ["t"], op="op").collect())) == [("a", 5, "upsert", 2)]
    assert timeline.latest(log, "k", ["t"], F.col("t") <= 2, "op").count() == 2
    series = timeline.gauge_series(timeline.versions(log, "k", ["t"], "t"), "t", "superseded_at", 2)
    assert sorted(map(tuple, series.collect())) == [(2, 2), (4, 2), (6, 2)]
    assert sorted(r[0] for r in changes.delete_sweep(log, log.filter("k = 'a'"), "k").collect()) == ["b"]


def test_continuous_aggregate(spark, tmp_path):
    schema = "at long, who string"
    source = f"{tmp_path}/in"
    spark.createDataFrame([(3600, "alice"), (3700, "alice"), (3800, "bob"), (7200, "alice")], schema).coalesce(1).write.parquet(source)
    view = ContinuousAggregate("at", 3600, ["who"], 600)

    def advance():
        q = view.start(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination()
        return q

    advance()
    spark.createDataFrame([(20000, "zoe")], schema).write.mode("append").parquet(source)
    advance()
    q = None
    spark.createDataFrame([(3601, "late")], schema).write.mode("append").parquet(source)
    q = advance()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("bucket", "who", "n").collect()))
    assert got == [(3600, "alice", 2), (3600, "bob", 1), (7200, "alice", 1)]
    assert late_rows(q) == 1


def test_follow_and_export(engine, spark, tmp_path):
    from tidemark.plans.parser import parse

    engine.sql("CREATE TABLE t")
    for k in ("a", "b"):
        engine.sql(f"INSERT INTO t (Key, n) VALUES ('{k}', 1)")
    stream = follow(engine, parse("WATCH * FROM t SINCE BEGINNING"))
    for _ in range(2):  # the second run finds nothing new
        export(stream, f"{tmp_path}/x", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.json(f"{tmp_path}/x").count() == 2
    events = engine.log("t").events()
    one = message_records(events, "t").filter("_seq = 1").first()
    assert bytes(one["key"]) == b"a" and bytes(one["headers"][0]["value"]) == (1).to_bytes(8, "big")
    assert tombstones(events, events.filter("_key = 'a'")).count() == 1
    assert lost(10, 5) == 4 and lost(3, 5) == 0
