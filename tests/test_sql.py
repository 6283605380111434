"""The gate for read-only SQL."""

import pytest

from tidemark.operators import readonly_sql as sql
from tidemark.suite import sql_surface


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    spark.range(10).selectExpr("id", "id % 3 AS k").createOrReplaceTempView("numbers")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 1 AS val",
        "  select count(*) AS n from numbers ;",
        "WITH t AS (SELECT id FROM numbers) SELECT sum(id) AS s FROM t",
        "-- a note\n/* and another */ SELECT k, count(*) AS n FROM numbers GROUP BY k",
        "SELECT id FROM numbers ORDER BY id DESC LIMIT 2 -- end",
        "SELECT ';' AS semicolon",
        "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT n FROM r",
    ],
)
def test_accepted(spark, text):
    assert sql.validate(spark, text).is_valid
    assert sql.run(spark, text).count() >= 1


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("DROP TABLE numbers", "Operation 'DROP' is not allowed"),
        ("insert into numbers values (1, 2)", "Operation 'INSERT' is not allowed"),
        ("CREATE TABLE x (a INT)", "Operation 'CREATE'"),
        ("ALTER TABLE numbers ADD COLUMN a INT", "Operation 'ALTER'"),
        ("TRUNCATE TABLE numbers", "Operation 'TRUNCATE'"),
        ("DELETE FROM numbers", "Operation 'DELETE'"),
        ("UPDATE numbers SET id = 1", "Operation 'UPDATE'"),
        ("-- hidden\nDROP TABLE numbers", "Operation 'DROP'"),
        ("SHOW TABLES", sql.ONLY_SELECT),
        ("SET spark.sql.ansi.enabled = false", sql.ONLY_SELECT),
        ("", sql.ONLY_SELECT),
        ("(SELECT 1)", sql.ONLY_SELECT),
        ("SELECT FROM WHERE", ""),
        ("SELECT nothing FROM numbers", "nothing"),
        ("SELECT * FROM missing", "missing"),
        ("SELECT 1; DROP TABLE numbers", ""),
        ("SELECT 1) t; DROP TABLE numbers; --", ""),
        ("SELECT reflect('java.lang.System', 'getProperty', 'user.dir') AS x", "'reflect' is not allowed"),
        ("SELECT `java_method` /* */ ('java.lang.System', 'lineSeparator') AS x", "'java_method'"),
        ("SELECT id, Try_Reflect\n('java.lang.System', 'gc') FROM numbers", "'try_reflect'"),
        ("WITH t AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM t", ""),
        ("SELECT * FROM numbers WHERE id IN (SELECT value FROM csv.`/etc/hostname`)", ""),
        ("WITH t AS (SELECT 1 AS id, 2 AS k) INSERT INTO numbers SELECT * FROM t", ""),
    ],
)
def test_refused(spark, text, part):
    verdict = sql.validate(spark, text)
    assert not verdict.is_valid and part in verdict.error_message
    assert verdict.error_line >= 1
    assert spark.table("numbers").count() == 10


def test_place_of_error(spark):
    verdict = sql.validate(spark, "SELECT id,\n       nothing\nFROM numbers")
    assert (verdict.error_line, verdict.error_column) == (2, 7)


def test_parameters(spark):
    assert sql.run(spark, "SELECT ? AS val", [42]).first().val == 42
    rows = sql.run(spark, "SELECT id FROM numbers WHERE k = ? AND id > ?", [1, 3]).collect()
    assert sorted(r.id for r in rows) == [4, 7]


def test_nothing_runs_until_asked(spark):
    """A statement that fails on its rows is accepted: only its analysis happens."""
    assert sql.validate(spark, "SELECT 1 DIV (id - id) AS x FROM numbers").is_valid


def test_limited(spark):
    frame = spark.table("numbers")
    cut = sql.limited(frame, 4).collect()
    assert len(cut) == 4 and all(r.truncated and r.total_available == 10 for r in cut)
    whole = sql.limited(frame, 10).collect()
    assert len(whole) == 10 and not any(r.truncated for r in whole)


def test_estimates_are_grouped_apart_from_exact_counts(spark, tmp_path):
    """A sketch is of a flag; in one grouping with the exact count every (flag, part) would have its own."""
    rows = "id % 3 AS l_returnflag, id % 500 AS l_partkey"
    for name in sql_surface.TABLES:
        spark.range(5000).selectExpr(*rows.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    found = sql_surface.sql_approx_distinct(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketches and not [line for line in sketches if "l_partkey" in line.split("functions=")[0]]
    assert sorted((r.l_returnflag, r.within_bounds) for r in found.collect()) == [(0, True), (1, True), (2, True)]
