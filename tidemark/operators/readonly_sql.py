"""Read-only SQL over registered views.

Only one SELECT or WITH statement passes. The text is first analysed inside a subquery, where
Spark's grammar admits no command and no second statement, and only then run as written. Files cannot be
named as relations, and the functions that call into the JVM are refused.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Statements named in the refusal.
ON_FILES = "spark.sql.runSQLOnFiles"
WRITES = ("DROP", "ALTER", "CREATE", "TRUNCATE", "DELETE", "UPDATE", "INSERT")
ONLY_SELECT = "Only SELECT queries are permitted."
# Functions that call any static method of the JVM.
REFLECTIVE = ("reflect", "java_method", "try_reflect")
_GAP = r"`?(?:\s|--[^\n]*\n|/\*.*?\*/)*\("
# Also matched inside a text literal: better one refusal too many.
_REFLECTIVE = re.compile(rf"\b({'|'.join(REFLECTIVE)}){_GAP}", re.DOTALL | re.IGNORECASE)
_COMMENTS = re.compile(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)+", re.DOTALL)
_PLACE = re.compile(r"line (\d+),? pos(?:ition)? (\d+)")


# Functions by the names and meanings that other engines' SQL gives them, made of Spark's own. Weeks start on
# Mondays; a bucket's width is days to seconds.
FUNCTIONS = {
    "time_bucket": """(width INTERVAL DAY TO SECOND, at TIMESTAMP_NTZ) RETURNS TIMESTAMP_NTZ RETURN
        CAST(timestamp_micros(unix_micros(CAST(at AS TIMESTAMP)) - pmod(
          unix_micros(CAST(at AS TIMESTAMP)) - unix_micros(TIMESTAMP '2000-01-03 00:00:00Z'),
          CAST((extract(DAY FROM width) * 86400 + extract(HOUR FROM width) * 3600 + extract(MINUTE FROM width) * 60
            + extract(SECOND FROM width)) * 1000000 AS BIGINT))) AS TIMESTAMP_NTZ)""",
    "epoch": "(at TIMESTAMP_NTZ) RETURNS DOUBLE RETURN unix_micros(CAST(at AS TIMESTAMP)) / 1e6D",
    "epoch_us": "(at TIMESTAMP_NTZ) RETURNS BIGINT RETURN unix_micros(CAST(at AS TIMESTAMP))",
    "json_extract_string": "(body STRING, place STRING) RETURNS STRING RETURN get_json_object(body, place)",
}


class QueryRefused(ValueError):
    def __init__(self, message: str, line: int = 1, column: int = 0):
        super().__init__(message)
        self.message = message
        self.line = line
        self.column = column


@dataclass(frozen=True)
class Validation:
    is_valid: bool
    error_message: str | None = None
    error_line: int | None = None
    error_column: int | None = None


def define(spark: SparkSession) -> None:
    """Make ``FUNCTIONS`` known to the session, unless it has functions of these names."""
    for name, body in FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}{body}")


def run(spark: SparkSession, text: str, args: Sequence | None = None) -> DataFrame:
    """The result of a read-only statement; ``args`` fill its ``?`` marks. Nothing is collected."""
    define(spark)
    text = text.strip().removesuffix(";")
    _check_first_word(text)
    _check_functions(text)
    _analyse(spark, f"SELECT * FROM (\n{text}\n)", args, shift=1)
    return _analyse(spark, text, args)


def validate(spark: SparkSession, text: str, args: Sequence | None = None) -> Validation:
    try:
        run(spark, text, args)
    except QueryRefused as refused:
        return Validation(False, refused.message, refused.line, refused.column)
    return Validation(True)


def _check_first_word(text: str) -> None:
    first = re.match(r"[A-Za-z]*", _COMMENTS.sub("", text)).group().upper()
    if first in WRITES:
        raise QueryRefused(
            f"Operation '{first}' is not allowed. Only SELECT queries are permitted."
        )
    if first not in ("SELECT", "WITH"):
        raise QueryRefused(ONLY_SELECT)


def _check_functions(text: str) -> None:
    found = _REFLECTIVE.search(text)
    if found:
        raise QueryRefused(f"Function '{found[1].lower()}' is not allowed.")


def _analyse(spark: SparkSession, text: str, args: Sequence | None, shift: int = 0) -> DataFrame:
    before = spark.conf.get(ON_FILES)
    spark.conf.set(ON_FILES, "false")
    try:
        return spark.sql(text, args=list(args)) if args else spark.sql(text)
    except (ParseException, AnalysisException, PySparkException) as error:
        message = str(error)
        place = _PLACE.search(message)
        line, column = (int(place[1]) - shift, int(place[2])) if place else (1, 0)
        raise QueryRefused(message.split("\n")[0], max(line, 1), column) from error
    finally:
        spark.conf.set(ON_FILES, before)


def limited(frame: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows with ``truncated`` and ``total_available`` on each."""
    total = frame.agg(F.count("*")).scalar()
    return frame.limit(max_rows).withColumns(
        {"total_available": total, "truncated": total > max_rows}
    )
