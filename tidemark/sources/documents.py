"""Flat search documents from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of job states and universes by number.
STATUS = {1: "Idle", 2: "Running", 3: "Removed", 4: "Completed", 5: "Held", 6: "Error"}
UNIVERSE = {1: "Standard", 4: "PVM", 5: "Vanilla", 7: "Scheduler", 8: "MPI", 9: "Grid", 10: "Java", 11: "Parallel", 12: "Local"}
#: Strings longer than this many bytes are cut.
LONGEST = 256


def flatten_json(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Fields of a JSON text as columns."""
    return df.select("*", *[F.get_json_object(column, f"$.{k}").alias(k) for k in keys])


def _named(code: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("Unknown"))


def record_time(df: DataFrame, launch: int) -> Column:
    """When a record was made: completion, else epoch end, else the last change of state, else `launch`."""

    def positive(name: str, extra: Column | None = None) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("long")
        ok = F.col(name) > 0
        return F.when(ok if extra is None else ok & extra, F.col(name)).cast("long")

    return F.coalesce(positive("CompletionDate", F.col("JobStatus").isin(3, 4, 6)), positive("EpochWriteDate"), positive("EnteredCurrentStatus"), F.lit(launch))


def job_documents(df: DataFrame, launch: int = 0, secret: tuple[str, ...] = ("ClaimId", "ClaimIds", "Capability", "TransferKey")) -> DataFrame:
    """Jobs as documents with `_id`, derived fields, short strings and lower-case names; others are left out."""
    rows = df.filter(F.col("JobStatus").isNotNull() & F.col("GlobalJobId").isNotNull())
    if "TaskType" in df.columns:
        rows = rows.filter(~F.col("TaskType").eqNullSafe("ROOT"))
    at = record_time(df, launch)
    hosts = [F.col(c) for c in ("RemoteHost", "LastRemoteHost") if c in df.columns]
    host = F.coalesce(*hosts, F.lit("UNKNOWN@UNKNOWN"))
    out = [
        F.concat(F.col("GlobalJobId"), F.lit("#"), at.cast("string")).alias("_id"),
        at.alias("RecordTime"),
        F.substring_index("GlobalJobId", "#", 1).alias("ScheddName"),
        F.substring_index(host, "@", 1).alias("StartdSlot"),
        F.substring_index(host, "@", -1).alias("StartdName"),
        _named(F.col("JobStatus"), STATUS).alias("Status"),
    ]
    if "JobUniverse" in df.columns:
        out.append(_named(F.col("JobUniverse"), UNIVERSE).alias("Universe"))
    for name, kind in df.dtypes:
        if name in secret:
            continue
        c = F.col(f"`{name}`")
        if kind == "string":
            c = F.when(F.octet_length(c) > LONGEST, F.concat(F.substring(c, 1, LONGEST - 3), F.lit("..."))).otherwise(c)
        elif name.endswith("Date"):
            c = F.when(c != 0, c)
        out.append(c.alias(name))
    return rows.select(*out)
