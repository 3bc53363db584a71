"""Metric roll-up per sample by the metric's own mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import Tables


def rollup_metrics(t: Tables) -> DataFrame:
    """(sample_id, name, aggregate, value, metrics).

    SUM and AVERAGE give one number per sample and name over the values that are numbers; N
    (and unset) metrics are not aggregated and pass through as text, one row each.  A metric
    linked to several readsets of one sample counts once.
    """
    m = t["metric"].filter(~F.col("deprecated") & ~F.col("deleted")).select(
        F.col("id").alias("metric_id"), "name", "value", "aggregate"
    )
    r = t["readset"].select(F.col("id").alias("readset_id"), "sample_id")
    owned = t["readset_metric"].join(r, "readset_id").select("sample_id", "metric_id").distinct()
    rows = owned.join(m, "metric_id")
    number = F.col("value").try_cast("double")
    summed = (
        rows.filter(F.col("aggregate").isin("SUM", "AVERAGE"))
        .groupBy("sample_id", "name", "aggregate")
        .agg(
            F.when(F.col("aggregate") == "SUM", F.sum(number)).otherwise(F.avg(number)).alias("number"),
            F.count(F.lit(1)).alias("metrics"),
        )
        .select("sample_id", "name", "aggregate", "number", F.lit(None).cast("string").alias("value"), "metrics")
    )
    passed = rows.filter(F.coalesce(F.col("aggregate"), F.lit("N")) == "N").select(
        "sample_id", "name", "aggregate", F.lit(None).cast("double").alias("number"), "value",
        F.lit(1).cast("bigint").alias("metrics"),
    )
    return summed.unionByName(passed)
