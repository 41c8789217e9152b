"""Prometheus text of a view: columns named label_x are labels, metric_y are gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exposition(view: DataFrame, name: str) -> DataFrame:
    """One line a series and metric, in a column `line`."""
    labels = [c for c in view.columns if c.lower().startswith("label_")]
    metrics = [c for c in view.columns if c.lower().startswith("metric_")]

    def escaped(c: str):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.concat(F.lit(f'{c[6:]}="'), text, F.lit('"'))

    tags = F.concat(F.lit("{"), F.concat_ws(",", *[escaped(c) for c in labels]), F.lit("}")) if labels else F.lit("")
    lines = F.array(*[F.when(F.col(m).isNotNull(), F.concat(F.lit(f"{name}_{m[7:]}"), tags, F.lit(" "), F.col(m).cast("string"))) for m in metrics])
    return view.select(F.explode(lines).alias("line")).filter("line is not null")
