"""Saved results: CSV and parquet tables, resuming, reusing and merging runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allotment.operators.analytics import audit_metrics


def write_csv(df: DataFrame, path: str) -> DataFrame:
    """Write with a header and read back with the same types."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def config_hash(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(str(p)) for p in parts]))


def pending_cells(plan: DataFrame, done: DataFrame, keys: list[str], config: Column) -> DataFrame:
    """Planned cells without a saved result; a saved cell of another configuration stops the run."""
    current = config
    checked = done.withColumn("_ok", F.when(F.col("config") == current, True).otherwise(
        F.raise_error(F.lit("saved results belong to another configuration")).cast("boolean")))
    return plan.join(checked.where("_ok").select(*keys), keys, "left_anti")


def reuse_cells(saved: DataFrame, wanted: DataFrame, recomputed: DataFrame, keys: list[str], metric: str, tolerance: float) -> DataFrame:
    """Saved cells on the wanted grid whose metric agrees with a recomputation from raw estimates."""
    bad = audit_metrics(recomputed, saved, keys, metric, tolerance).select(*keys)
    return saved.join(wanted.select(*keys), keys, "left_semi").join(bad, keys, "left_anti")


def merge_reports(grid: DataFrame, reports: list[DataFrame], keys: list[str]) -> DataFrame:
    """Put the rows of several reports on one grid; every planned cell gets a status.

    The grid has `feasible`; cells without a row are pending, or infeasible for their budget.
    """
    rows = reports[0]
    for report in reports[1:]:
        rows = rows.unionByName(report)
    status = F.when(~F.col("feasible"), "budget_infeasible").when(F.col("_have"), "complete").otherwise("pending")
    return grid.join(rows.withColumn("_have", F.lit(True)), keys, "left").withColumn(
        "_have", F.coalesce("_have", F.lit(False))).withColumn("status", status).drop("_have", "feasible")
