"""Records as attribute text, one `name = value` a line and a blank line between records, and other renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INT, _REAL, _BOOL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.[0-9]*|\.?[0-9]+)([eE][+-]?[0-9]+)?$", r"^(?i)(true|false)$"
_STRING = r'^"(.*)"$'


def load_records(spark: SparkSession, path: str, key: str = "Name", auto: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read records below `path`: typed rows with `_key` (and `_table` with `auto`), and the text of those refused.

    A column is long, double, boolean or string if every value in it is; else it keeps the text of the values, which
    may be expressions.  A record without the key attribute, or with a line that isn't `name = value`, is refused.
    """
    text = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value") != "")
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = text.select("value", lines.alias("lines")).filter(F.size("lines") > 0)
    pattern = r"^([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(.+)$"
    good = F.forall("lines", lambda x: x.rlike(pattern))
    pairs = F.transform("lines", lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), F.regexp_extract(x, pattern, 2).alias("v")))
    # the last of repeated attributes holds
    spread = text.filter(good).withColumn("id", F.monotonically_increasing_id()).select("id", "value", F.posexplode(pairs).alias("n", "p"))
    cells = spread.groupBy("id", F.lower("p.k").alias("k")).agg(F.max_by("p.v", "n").alias("v"), F.max_by("p.k", "n").alias("name"))
    kinds = cells.groupBy("k").agg(
        F.min_by("name", "name").alias("name"),
        *[F.min((F.col("v").rlike(p) | F.lower("v").isin("undefined", "error")).cast("int")).alias(n) for n, p in (("i", _INT), ("r", _REAL), ("b", _BOOL), ("s", _STRING))],
    )
    kinds = {r["k"]: r for r in kinds.collect()}  # a row an attribute
    maps = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))

    def typed(k: str) -> Column:
        v = F.try_element_at("m", F.lit(k))
        v = F.when(F.lower(v).isin("undefined", "error"), None).otherwise(v)
        r = kinds[k]
        if r["i"]:
            return v.try_cast("long")
        if r["r"]:
            return v.try_cast("double")
        if r["b"]:
            return v.try_cast("boolean")
        return F.regexp_extract(v, _STRING, 1) if r["s"] else v

    has_key = F.try_element_at("m", F.lit(key.lower())).isNotNull() if key.lower() in kinds else F.lit(False)
    own = typed(key.lower()).cast("string") if key.lower() in kinds else F.lit(None).cast("string")
    extra = []
    if auto:
        kind = F.regexp_replace(F.try_element_at("m", F.lit("mytype")), '"', "")
        extra.append(F.concat(F.lower(kind), F.lit("s")).alias("_table"))
    rows = maps.filter(has_key).select(own.alias("_key"), *extra, *[typed(k).alias(kinds[k]["name"]) for k in sorted(kinds)])
    keyless = spread.join(maps.filter(~has_key).select("id"), "id").select("value").distinct()
    return rows, text.filter(~good).select("value").unionByName(keyless)


def _literal(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if dict(df.dtypes)[name] == "string":
        quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), quoted, F.lit('"'))
    return c.cast("string")


def render(df: DataFrame, style: str) -> DataFrame:
    """Rows as text in a column `value`: json, old (lines of name = value) or new ([name = value; ...])."""
    names = [c for c in df.columns if not c.startswith("_")]
    if style == "json":
        return df.select(F.to_json(F.struct(*[f"`{c}`" for c in names])).alias("value"))
    parts = [F.concat(F.lit(f"{c} = "), _literal(df, c)) for c in names]
    if style == "old":
        return df.select(F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("value"))
    if style == "new":
        return df.select(F.concat(F.lit("["), F.concat_ws("; ", *parts), F.lit("]")).alias("value"))
    raise ValueError(f"unknown format {style!r} (json, old, new)")
