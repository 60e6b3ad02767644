"""Aggregates: masking summaries, per-app and global metrics, leakage, running snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LEAK_THRESHOLD, TOTAL_TASKS


def ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """Zero where there is nothing to divide by."""
    return F.when(F.coalesce(bottom, F.lit(0)) == 0, F.lit(0.0)).otherwise(scale * top / bottom)


def anonymization_summary(df: DataFrame, original: str, masked: str, by: list[str]) -> DataFrame:
    """Totals overall and by each of by: one pass over GROUPING SETS."""
    sets = [[], *([c] for c in by)]
    return (
        df.groupingSets([[F.col(c) for c in s] for s in sets], *by)
        .agg(F.count(F.lit(1)).alias("records"), F.sum(original).alias("original_chars"), F.sum(masked).alias("masked_chars"), F.grouping_id().alias("_g"))
        .select(*by, "records", "original_chars", "masked_chars", F.round(ratio(F.col("masked_chars"), F.col("original_chars"), 100.0), 2).alias("masked_percent"))
    )


#: Columns that a table of agents and apps may have.
MOST_APPS = 2000


def app_metrics(df: DataFrame, app: str, complete: Column, partial: Column, rrr: Column, ror: Column) -> DataFrame:
    """Per app. A complete task counts 1 for the partial score too; null reward ratios are skipped and none means 0."""
    full = complete.cast("int")
    rows = df.select(F.col(app).alias("app"), full.alias("_c"), F.when(full == 1, 1.0).otherwise(partial).alias("_p"), F.when(full == 1, rrr).alias("_r"), ror.alias("_o"))
    return rows.groupBy("app").agg(
        F.count(F.lit(1)).alias("total"), F.sum("_c").alias("complete_correct"), F.avg(F.col("_c").cast("double")).alias("acc"), F.sum("_p").alias("sum_partial_acc"), F.avg("_p").alias("partial_acc"),
        F.coalesce(F.avg("_r"), F.lit(0.0)).alias("rrr"), F.coalesce(F.sum("_r"), F.lit(0.0)).alias("sum_rrr"), F.coalesce(F.avg("_o"), F.lit(0.0)).alias("ror"), F.coalesce(F.sum("_o"), F.lit(0.0)).alias("sum_ror"),
    )


def global_metrics(apps: DataFrame) -> DataFrame:
    total = F.sum("total")
    return apps.agg(
        total.alias("total"), F.sum("complete_correct").alias("correct"), ratio(F.sum("complete_correct"), total).alias("sr"), ratio(F.sum("sum_partial_acc"), total).alias("sub_sr"),
        ratio(F.sum("sum_rrr"), F.sum("complete_correct")).alias("rrr"), ratio(F.sum("sum_ror"), total).alias("ror"),
    )


def leaderboard(apps: DataFrame, agent: str, total: int = TOTAL_TASKS) -> DataFrame:
    """Per agent: sums over a fixed number of tasks in percent; the reward ratio over what was completed."""
    return apps.groupBy(agent).agg(
        (100.0 * F.sum("complete_correct") / total).alias("sr"), (100.0 * F.sum("sum_partial_acc") / total).alias("sub_sr"),
        ratio(F.sum("sum_rrr"), F.sum("complete_correct"), 100.0).alias("rrr"), (100.0 * F.sum("sum_ror") / total).alias("ror"), ratio(F.sum("complete_correct"), F.sum("total")).alias("acc"),
    )


def leaderboard_detail(df: DataFrame, agent: str, app: str, value: str, apps: list[str] | None = None) -> DataFrame:
    """agent x app: a column for each of apps, or else for each app of the data (MOST_APPS at most, as a sheet of more columns
    is none; beyond it raises). Rows of no app count nowhere."""
    if apps is None:
        apps = [r[0] for r in df.filter(F.col(app).isNotNull()).select(app).distinct().limit(MOST_APPS + 1).collect()]
        if len(apps) > MOST_APPS:
            raise ValueError(f"more than {MOST_APPS} apps make no table")
    return df.groupBy(agent).pivot(app, sorted(apps)).agg(F.sum(value)).na.fill(0)


def reward_ratio(complete: Column, human: Column, steps: Column) -> Column:
    """Human steps over steps, only of complete tasks with known human steps."""
    return F.when(complete & (steps > 0), human / steps)


def reasonable_ratio(no_ops: Column, steps: Column) -> Column:
    return F.when(steps == 1, F.lit(1.0)).when(steps == 0, F.lit(1.0)).otherwise(1.0 - no_ops / (steps - 1))


def leakage(df: DataFrame, score: Column, answered: Column, by: list[str] | None = None, threshold: float = LEAK_THRESHOLD) -> DataFrame:
    """Mean score, share of fields above the threshold (strictly), share answered; 0 without fields."""
    n = F.count(score)
    return df.groupBy(*(by or [])).agg(
        n.alias("fields"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("average_match_score"),
        F.round(ratio(F.sum((score > threshold).cast("int")), n), 4).alias("leakage_rate"), F.round(ratio(F.sum(answered.cast("int")), n), 4).alias("response_rate"),
    )


def answered(prediction: Column) -> Column:
    p = F.trim(F.coalesce(prediction, F.lit("")))
    return (p != "") & (p != "0")


def timing_means(df: DataFrame, by: list[str], seconds: str, failed: Column, copied: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(seconds).alias("mean_seconds"), F.sum(seconds).alias("total_seconds"), F.count(F.lit(1)).alias("items"), F.count_if(failed).alias("failed"), F.count_if(copied).alias("copied"))


def layer_summary(df: DataFrame, kind: str = "type", original: str = "original_length", masked: str = "anonymized_chars_count", legacy: str | None = None) -> DataFrame:
    """By type and overall (rollup), with a legacy column standing in where masked is null."""
    chars = F.coalesce(masked, legacy) if legacy else F.coalesce(F.col(masked), F.lit(0))
    rows = df.select(F.col(kind).alias("type"), F.col(original).alias("_o"), chars.alias("_m"))
    out = rows.rollup("type").agg(F.grouping("type").alias("overall"), F.count(F.lit(1)).alias("records"), F.sum("_o").alias("original_chars"), F.sum("_m").alias("masked_chars"))
    return out.withColumn("masked_percent", ratio(F.col("masked_chars"), F.col("original_chars"), 100.0))
