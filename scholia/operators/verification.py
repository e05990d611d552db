"""Records against what their identifiers resolve to: field by field, per identifier, overall."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TITLE, JOURNAL = 0.9, 0.8  # fixed values: least similarities of a match


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two normal forms, to four places; null if either is."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else round(SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b)], dtype="float64")


def three_way(a: Column, b: Column, same: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit("not_compared")).when(same, F.lit("match")).otherwise(F.lit("mismatch"))


def title_status(a: Column, b: Column, ratio: Column) -> Column:
    """a, b: normal forms; ratio: of them, asked for only where they differ."""
    return three_way(a, b, (a == b) | (ratio >= TITLE))


def journal_status(a: Column, b: Column, ratio: Column) -> Column:
    """Soft: equal, contained, or similar. Never decides the overall status."""
    return three_way(a, b, (a == b) | a.contains(b) | b.contains(a) | (ratio >= JOURNAL))


def check_status(outcome: Column, title: Column, year: Column, author: Column) -> Column:
    """struct(outcome, status, reasons) for one looked-up identifier."""
    reasons = F.array_compact(F.array(
        F.when(title == "mismatch", F.lit("title_mismatch")).when(title == "not_compared", F.lit("title_not_compared")),
        F.when(year == "mismatch", F.lit("year_mismatch")), F.when(author == "mismatch", F.lit("first_author_mismatch"))))
    resolved = outcome == "resolved"
    return F.struct(
        outcome.alias("outcome"),
        F.when(~resolved, F.lit("not_verified")).when(F.size(reasons) == 0, F.lit("verified")).otherwise(F.lit("partially_verified")).alias("status"),
        F.when(resolved, reasons).otherwise(F.array(outcome)).alias("reasons"),
    )


def combined_checks(checks: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, status, reasons) of a record over its checks (key, kind of identifier in order, outcome, status,
    reasons). A record without identifiers has a row whose outcome is null."""
    resolved = F.col("outcome") == "resolved"
    g = checks.groupBy(key).agg(
        F.count("outcome").alias("n"), F.count_if(resolved).alias("n_resolved"),
        F.coalesce(F.bool_and(F.when(resolved, F.col("status") == "verified")), F.lit(False)).alias("all_verified"),
        F.count_if(F.col("outcome") == "not_found").alias("n_missing"), F.count_if(F.col("outcome") == "lookup_failed").alias("n_failed"),
        F.array_sort(F.collect_list(F.when(F.col("outcome").isNotNull(), F.struct("kind", "outcome", "reasons")))).alias("all"),
    )
    none = F.col("n_resolved") == 0
    lead = F.when(F.col("n_failed") > 0, F.lit("lookup_failed")).otherwise(F.lit("not_found"))
    each = F.flatten(F.transform("all", lambda c: F.transform(c["reasons"], lambda r: F.concat(c["kind"], F.lit(":"), r))))
    outcomes = F.transform("all", lambda c: F.concat(c["kind"], F.lit(":"), c["outcome"]))
    status = F.when(none, F.lit("not_verified")).when(F.col("all_verified") & (F.col("n_missing") == 0), F.lit("verified")).otherwise(F.lit("partially_verified"))
    reasons = F.when(F.col("n") == 0, F.array(F.lit("no_identifier"))).when(none, F.concat(F.array(lead), outcomes)).otherwise(each)
    return g.select(key, status.alias("status"), reasons.alias("reasons"))


STATUSES = ("verified", "partially_verified", "not_verified")


def status_counts(df: DataFrame, column: str, values: tuple[str, ...] = STATUSES) -> DataFrame:
    """(column, n): a row for each value, zero where none has it."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
