"""Transaction logs and history files of a job queue, and their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Operation numbers of the log.
NEW, DESTROY, SET, DELETE, BEGIN, END = 101, 102, 103, 104, 105, 106


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Operations of one log in order: n, op, key, name, value.  Operations of a transaction that has no end are left
    out.  A log is one ordered stream, so its lines are numbered by their place in the file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).filter("line <> ''")
    part = F.split("line", " ", 4)
    ops = lines.select("n", part[0].try_cast("int").alias("op"), F.get(part, F.lit(1)).alias("key"), F.get(part, F.lit(2)).alias("name"), F.get(part, F.lit(3)).alias("value"))
    # inside a transaction the next mark is an end
    ahead = Window.orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    behind = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("op").isin(BEGIN, END), F.col("op"))
    ops = ops.withColumn("last", F.last(mark, True).over(behind)).withColumn("next", F.first(mark, True).over(ahead))
    open_ = F.col("last").eqNullSafe(BEGIN) & ~F.col("next").eqNullSafe(END)
    return ops.filter(F.col("op").isin(NEW, DESTROY, SET, DELETE) & ~open_).drop("last", "next")


def route(key: str | Column) -> Column:
    """The table that a record belongs to, by its key `cluster.proc`."""
    key = F.col(key) if isinstance(key, str) else key
    cluster, proc = (F.get(F.split(key, r"\."), F.lit(k)).try_cast("int") for k in (0, 1))
    return (
        F.when(key == "0.0", "header")
        .when((cluster > 0) & (proc >= 0), "jobs")
        .when((cluster > 0) & (proc == -1), "clusters")
        .when((cluster > 0) & (proc == -2), "clusterprivate")
        .when((cluster > 0) & (proc == -100), "jobsets")
    )


def attributes(ops: DataFrame) -> DataFrame:
    """The attributes that hold after all operations: key, name, value."""
    born = ops.filter(F.col("op").isin(NEW, DESTROY)).groupBy("key").agg(F.max("n").alias("since"), F.max_by("op", "n").alias("last"))
    sets = ops.filter(F.col("op").isin(SET, DELETE)).join(born, "key", "left").filter("since is null or n > since")
    held = sets.groupBy("key", "name").agg(F.max_by(F.struct("op", "value"), "n").alias("x"), F.first("last").alias("last"))
    return held.filter((F.col("x.op") == SET) & ~F.col("last").eqNullSafe(DESTROY)).select("key", "name", F.col("x.value").alias("value"))


def inherit(held: DataFrame) -> DataFrame:
    """Jobs' attributes with those of their cluster; a job's own hold first."""
    jobs = held.filter(route("key") == "jobs").withColumn("cluster", F.substring_index("key", ".", 1))
    shared = held.filter(route("key") == "clusters").select(F.regexp_replace(F.substring_index("key", ".", 1), "^0+", "").alias("cluster"), "name", F.col("value").alias("theirs"))
    given = jobs.select("key", "cluster").distinct().join(shared, "cluster")
    return jobs.select("key", "name", F.col("value").alias("own")).join(given.select("key", "name", "theirs"), ["key", "name"], "full").select("key", "name", F.coalesce("own", "theirs").alias("value"))


def write_log(held: DataFrame) -> DataFrame:
    """Attributes as log lines in a column `value`: each record is made, then set."""
    made = held.select("key").distinct().select("key", F.lit(0).alias("k"), F.lit("").alias("name"), F.concat_ws(" ", F.lit(NEW), "key", F.lit("Job"), F.lit("Machine")).alias("value"))
    sets = held.select("key", F.lit(1).alias("k"), "name", F.concat_ws(" ", F.lit(SET), "key", "name", "value").alias("value"))
    return made.unionByName(sets).orderBy("key", "k", "name").select("value")


def read_history(spark: SparkSession, path: str, entered: int) -> DataFrame:
    """Records of a history file, which end at a banner line `*** `: key (cluster.proc), attributes, EnteredHistoryTime.
    A record that comes twice is kept once."""
    text = spark.read.option("lineSep", "\n*** ").text(path)
    body = F.regexp_replace("value", r"^Offset = [^\n]*(\n|$)", "")  # the rest of the banner before
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\w+ = "))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, " = ", 1).alias("k"), F.regexp_replace(x, r"^\w+ = ", "").alias("v")))
    rows = text.select(F.map_from_entries(pairs).alias("attributes")).filter(F.size("attributes") > 0)
    key = F.concat_ws(".", F.try_element_at("attributes", F.lit("ClusterId")), F.try_element_at("attributes", F.lit("ProcId")))
    return rows.select(key.alias("key"), "attributes", F.lit(entered).alias("EnteredHistoryTime")).dropDuplicates(["key"])
