"""Rules on a document's own text, and lines that too many documents of a host share.

A line is normalised (lower case, runs of white space as one space) and hashed; a line that stands in
more than ``max_docs`` documents of a host (here the source) counts as removed from all of them. A
document of whose characters fewer than ``min_share`` remain is depleted and rejected.

Only DataFrame functions: arrays are worked on inside the row, and only hashes of lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import written
from tidemark.plans.sizing import left_join

MAX_DOCS = 50
MIN_SHARE = 0.3
WINDOW = 5

SPACE = r"[ \t-\r]+"
NO_SPACE = r"[^ \t-\r]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _longs(values: Column, otherwise: int = 0) -> Column:
    return F.aggregate(values, F.lit(otherwise).cast("bigint"), lambda total, x: total + x)


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the hashes in order of place."""
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def starts(ordered: Column) -> Column:
        repeated = F.transform(
            ordered,
            lambda e, k: F.when(
                (F.get(ordered, k - 1)["x"] == e["x"]) | (F.get(ordered, k + 1)["x"] == e["x"]), e["i"]
            ),
        )
        return F.sort_array(F.filter(repeated, lambda i: i.isNotNull()))

    def covered(places: Column) -> Column:
        return F.transform(
            places,
            lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - i, F.lit(WINDOW))),
        )

    # A one-element array names an intermediate value inside an expression.
    named = F.transform(F.array(placed), starts)
    return F.element_at(F.transform(named, lambda p: _longs(covered(p))), 1)


def measured(docs: DataFrame) -> DataFrame:
    """The counts of each row's own text, and its lines as (line, length) of normalised text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Chained selects: each array is made once however often it is used.
    words = docs.select(
        F.col("doc_id").cast("bigint"),
        F.monotonically_increasing_id().alias("row"),
        F.col("source").cast("string").alias("host"),
        text.alias("text"),
        F.filter(F.split(text, SPACE, -1), lambda x: x != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NO_SPACE)).alias("lines"),
    )
    hashed = words.select(
        "doc_id",
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.transform(
            "lines",
            lambda x: F.trim(F.regexp_replace(F.lower(x), SPACE, " ")),
        ).alias("lines"),
        "host",
    )
    windows = hashed.select(
        "doc_id",
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.transform(
            F.when(
                F.col("n_words") > WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))
            ).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(WINDOW)]),
        ).alias("windows"),
        F.transform(
            "lines",
            lambda x: F.struct(
                F.xxhash64(F.coalesce("host", F.lit("")), x).alias("line"),
                F.length(x).cast("bigint").alias("length"),
            ),
        ).alias("lines"),
    )
    return windows.select(
        "doc_id",
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(
            F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("bigint")
        ).otherwise(_covered(F.col("windows"))).alias("n_repeat_words"),
        "lines",
    )


def judged(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    line_chars, removed_chars: one row for each row of ``docs``.

    A null text counts as empty and fails the base; a null source is the same host as an empty one;
    rows that repeat a doc_id count as documents of their own; extra columns are ignored; an empty
    table gives an empty result.
    """
    base = written(measured(docs), "quality-base")
    lines = F.array_distinct(F.transform("lines", lambda x: x["line"]))
    frequent = (
        base.select(F.explode(lines).alias("line"))
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("docs"))
        .filter(F.col("docs") > max_docs)
    )
    placed = base.select("row", F.explode("lines").alias("at")).select("row", "at.line", "at.length")
    removed = (
        left_join(placed, frequent, ["line"], ["row"])
        .filter("docs is not null")
        .groupBy("row")
        .agg(F.sum("length").alias("removed_chars"))
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    total = _longs(F.transform("lines", lambda x: x["length"])).alias("line_chars")
    share = F.col("line_chars") - F.col("removed_chars") >= min_share * F.col("line_chars")
    return (
        base.select("*", total)
        .join(removed, "row", "left")
        .withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0).cast("bigint")))
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & share).alias("kept"),
            "line_chars",
            "removed_chars",
        )
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host,
                  coalesce(text, '') AS text FROM documents),
w AS (SELECT row, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM d),
places AS (SELECT row, words, unnest(range(len(words) - {WINDOW - 1})) AS i FROM w WHERE len(words) >= {WINDOW}),
windows AS (SELECT row, i, words[i + 1:i + {WINDOW}] AS five FROM places),
repeated AS (SELECT row, unnest(list(i)) AS i FROM windows GROUP BY row, five HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT i + j) AS n
            FROM repeated, range({WINDOW}) AS r(j) GROUP BY row),
line AS (SELECT row, host, trim(regexp_replace(lower(x), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS x
         FROM (SELECT row, host, unnest(lines) AS x FROM w JOIN d USING (row))),
frequent AS (SELECT host, x FROM line GROUP BY host, x HAVING count(DISTINCT row) > {MAX_DOCS}),
chars AS (SELECT row, sum(length(x))::BIGINT AS line_chars,
                 coalesce(sum(length(x)) FILTER (f.host IS NOT NULL), 0)::BIGINT AS removed_chars
          FROM line LEFT JOIN frequent f USING (host, x) GROUP BY row),
base AS (SELECT d.row, doc_id, len(words)::BIGINT AS n_words,
                length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                coalesce(covered.n, 0)::BIGINT AS n_repeat_words
         FROM d JOIN w USING (row) LEFT JOIN covered USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND coalesce(line_chars, 0) - coalesce(removed_chars, 0)
             >= {MIN_SHARE} * coalesce(line_chars, 0) AS kept,
       coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(removed_chars, 0)::BIGINT AS removed_chars
FROM base LEFT JOIN chars USING (row)
"""
