"""Whole report runs: read or take a panel, compute the tables, write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthmark.operators import aggregates as agg
from monthmark.operators import changes as ch
from monthmark.operators import lifecycle, quality
from monthmark.operators import rating as rt
from monthmark.operators import reconcile as rec
from monthmark.params import Params
from monthmark.sources import readers, writers


def flag_file(spark: SparkSession, source: str, target: str, fmt: str = "csv") -> DataFrame:
    """Read a panel, flag it, write it in policy order; returns the change summary.

    The summary is taken from the written panel, so the flags are computed once.
    """
    flagged = ch.flag_panel(readers.scan_panel(spark, source, fmt), in_order=True)
    writers.write_sorted_panel(flagged, target, fmt=fmt, in_order=True)
    return ch.change_summary(readers.scan_panel(spark, target, fmt))


def monthly_report(panel: DataFrame, changed: DataFrame | None, types: list[str]) -> DataFrame:
    """One row for each month: distribution, new and renewed policies, a share column for each vehicle type and,
    with changes, the means of policies with and without one. All sides have a row per month."""
    month = {"inforce_yy": "year", "inforce_mm": "month"}
    out = lifecycle.monthly_distribution(panel, changed).join(
        agg.type_share_pivot(panel, types).withColumnsRenamed(month), ["year", "month"], "left")
    if changed is None:
        return out
    return out.join(agg.monthly_change_split(panel, changed).withColumnsRenamed(month), ["year", "month"], "left")


def distribution_tables(panel: DataFrame, changed: DataFrame | None,
                        types: list[str] | None = None) -> dict[str, DataFrame]:
    """The report's tables; with the vehicle types to show, the monthly report as well."""
    extra = {}
    if types is not None:
        extra["monthly_report"] = monthly_report(panel, changed, types)
    if changed is not None:
        extra["change_split"] = agg.monthly_change_split(panel, changed)
    return {
        **extra,
        "vehicle_type_shares": agg.type_share(panel),
        "monthly_distribution_summary": lifecycle.monthly_distribution(panel, changed),
        "policies": agg.distinct_cardinality(panel),
        "expiry_dates": agg.top_expiry_dates(panel),
        "tenure": agg.stats_with_median(panel, "client_tenure_days"),
        "vehicle_types": agg.value_counts(panel, "vehicle_type"),
        "model_years": agg.model_year_mode(panel),
        "vehicles_per_policy": agg.per_policy_count(panel, "vehicle_no", "vehicles"),
        "driver_types": agg.value_counts(panel, "driver_type"),
        "driver_ages": agg.stats_with_median(panel, "driver_age"),
        "drivers_per_policy": agg.per_policy_count(panel, "driver_no", "drivers"),
        "years": agg.rows_span(panel, "inforce_yy"),
        "months": agg.rows_span(panel, "inforce_mm", with_span=False),
        "premiums": agg.stats_with_median(panel, "premium_paid", money=True),
        "premium_by_driver_type": agg.premium_by_driver_type(panel),
    }


def distribution_report(panel: DataFrame, folder: str, with_changes: bool = True,
                        types: list[str] | None = None) -> dict[str, str]:
    """Write every distribution table; the panel's Parquet is read with pruned columns."""
    changed = ch.changed_months(panel) if with_changes else None
    return writers.write_report_tables(distribution_tables(panel, changed, types), folder)


def profiling_report(panel: DataFrame, folder: str, params: Params) -> dict[str, str]:
    """Write the profile and the monthly, vehicle-type and driver-type tables."""
    return writers.write_report_tables({
        "profile": quality.profile_overview(panel, params.as_of_year),
        "monthly_profiling_summary": agg.temporal_report(panel),
        "vehicle_type_profiling": agg.type_profile(panel, "vehicle_type"),
        "driver_type_profiling": agg.type_profile(panel, "driver_type", with_age=True),
    }, folder)


def reconcile(panel: DataFrame, masters: dict[str, DataFrame], folder: str,
              params: Params) -> dict[str, str]:
    """Compare the policy system with the panel; write comparison, discrepancies, counts.

    The comparison has a row per policy and is read back for the tables made from it.
    """
    spark = panel.sparkSession
    calculated = rt.policy_premiums(masters["policies"], masters["assignments"],
                                    masters["vehicles"], masters["drivers"], params)
    compared = rec.compare(calculated, rec.inforce_latest(panel), params)
    root = folder.rstrip("/")
    path = f"{root}/premium_validation_comparison"
    compared.write.mode("overwrite").parquet(path)
    kept = spark.read.parquet(path)
    return {
        "comparison": path,
        "discrepancies": writers.write_csv(rec.discrepancies(kept),
                                           f"{root}/premium_validation_discrepancies"),
        **writers.write_report_tables({"counts": rec.discrepancy_counts(kept),
                                       "top_discrepancies": rec.top_discrepancies(kept),
                                       "averages": rec.compare_summary(kept)}, root),
    }
