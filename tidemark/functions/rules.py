"""Row rules: named conditions a row must meet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Mapping[str, Column]


def violations(rules: Rules) -> Column:
    """Names of the rules a row breaks; an undecidable (null) condition counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


def checked(frame: DataFrame, rules: Rules) -> DataFrame:
    return frame.withColumn("violations", violations(rules))


def valid_rows(frame: DataFrame, rules: Rules) -> DataFrame:
    return checked(frame, rules).filter(F.size("violations") == 0).drop("violations")


def violation_counts(frame: DataFrame, rules: Rules) -> DataFrame:
    """Rows per broken rule, with ``valid`` for the rows that break none."""
    return (
        checked(frame, rules)
        .select(
            F.explode(
                F.when(F.size("violations") == 0, F.array(F.lit("valid"))).otherwise(
                    F.col("violations")
                )
            ).alias("outcome")
        )
        .groupBy("outcome")
        .agg(F.count("*").alias("n_rows"))
    )
