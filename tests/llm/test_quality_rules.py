import random

import duckdb
import pandas as pd
from tests_llm_tools import WORDS, prose, table, vocabulary

from tidemark.llm import quality_rules


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def corpus(rng, size=150):
    words = vocabulary(rng, 300)
    shared = [prose(rng, words, 9) for _ in range(4)]
    rows = []
    for i in range(size):
        lines = [prose(rng, words, rng.randint(1, 12)) for _ in range(rng.randint(0, 6))]
        lines += [rng.choice(shared).upper() for _ in range(rng.randint(0, 3))]
        lines += lines[: rng.randint(0, 2)] + [" \t "] * rng.randint(0, 2) + ["#a |b <c>"] * rng.randint(0, 1)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


def test_counts_by_hand(spark):
    rows = corpus(random.Random(1)) + [(900 + i, ("ab " * i).strip()) for i in range(15)]
    found = {r.doc_id: r for r in quality_rules.judged(table(spark, rows)).collect()}
    for i, text in rows:
        assert counts(found[i]) == base(text), text
        n, _, _, _, repeated = base(text)
        assert found[i].base_failed == (n < 10 or 100 * repeated > 20 * n)


def test_against_sql_with_frequent_lines(spark):
    rows = corpus(random.Random(2), 200)
    docs = table(spark, rows)
    found = quality_rules.judged(docs, max_docs=12).toPandas()
    assert (found.removed_chars > 0).any() and (~found.kept & ~found.base_failed).any()
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    limit = f"> {quality_rules.MAX_DOCS})"
    assert quality_rules.SQL.count(limit) == 1
    expected = connection.execute(quality_rules.SQL.replace(limit, "> 12)")).df()
    pd.testing.assert_frame_equal(
        found.sort_values("doc_id").reset_index(drop=True),
        expected.sort_values("doc_id").reset_index(drop=True),
        check_dtype=False,
    )


def test_no_python_on_the_way(spark):
    docs = table(spark, corpus(random.Random(3), 20))
    plan = quality_rules.measured(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd_docs, odd_rows, no_docs):
    found = quality_rules.judged(odd_docs).collect()
    assert sorted(str((r.doc_id, counts(r))) for r in found) == sorted(
        str((i, base(t))) for i, t in odd_rows
    )
    assert all(r.base_failed and not r.kept for r in found if r.n_words < 10)
    assert not quality_rules.judged(no_docs).count()
