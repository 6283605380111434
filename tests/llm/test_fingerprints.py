import hashlib
import random

from tests_llm_tools import prose, shingles_of, table, vocabulary

from tidemark.llm import fingerprints


def check(found, rows):
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    expected = []
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, expected)) == sorted(
        str((r.doc_id, r.n_chars, r.edited_sha256)) for r in found
    )


def test_edits_and_likeness(spark):
    rng = random.Random(1)
    words = vocabulary(rng, 500)
    rows = [(i * 7 - 300, prose(rng, words, rng.randint(0, 300))) for i in range(120)]
    rows += [(i + 1, t) for i, t in rows[:10]]
    found = fingerprints.with_edits(table(spark, rows).repartition(5)).collect()
    check(found, rows)
    texts = dict(rows)
    ids = sorted(texts)
    prints = {}
    for r in found:
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        quarter = len(text) // 4
        a, b, c = (shingles_of(x) for x in (text, text[: len(text) - quarter] + after[:quarter], after))
        for value, other in ((r.near_edited, b), (r.near_next, c)):
            exact = len(a & other) / len(a | other) if a | other else 1
            assert 0 <= value <= 1 and abs(value - exact) < 0.2
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == 4 * fingerprints.PLACES


def test_odd_rows(odd_docs, odd_rows, no_docs):
    check(fingerprints.with_edits(odd_docs).collect(), odd_rows)
    assert not fingerprints.with_edits(no_docs).count()
    assert not fingerprints.near_pairs(no_docs).count()


def test_single_document(spark):
    row = fingerprints.with_edits(table(spark, [(4, "a b c d e f g h")])).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()
    assert row.near_next == 1.0


def test_near_pairs(spark):
    rng = random.Random(2)
    words = vocabulary(rng, 500)
    base = [prose(rng, words, 200) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:5])]
    rows += [(200 + i, " ".join(t.split()[:190])) for i, t in enumerate(base[5:15])]
    rows += [(300, None), (301, ""), (None, base[0])]
    found = fingerprints.near_pairs(table(spark, rows)).collect()
    texts = dict(rows)
    for r in found:
        a, b = shingles_of(texts[r.doc_id]), shingles_of(texts[r.near_doc])
        assert r.near_doc < r.doc_id and abs(r.jaccard - len(a & b) / len(a | b)) < 1e-9
        assert r.jaccard >= 0.75
    assert {r.doc_id for r in found} == {*range(100, 105), *range(200, 210)}


def test_near_pairs_of_groups_with_a_dissimilar_smallest_member(spark, no_docs):
    rng = random.Random(4)
    words = vocabulary(rng, 500)
    rows = []
    for g in range(25):
        base = prose(rng, words, 200).split()
        # The smallest shares 0.55 to 0.72 with the others of its group, which are close to each other.
        for k, kept in enumerate((150 + g % 5 * 5, 200, 195, 190, 180)):
            rows.append((10 * g + k, " ".join(base[:kept] + prose(rng, words, 20).split()[: 20 * (k == 0)])))
        rows.append((10 * g + 5, rows[-2][1]))
    texts = dict(rows)
    docs = table(spark, rows)
    smallest = {}
    for i in texts:
        a = shingles_of(texts[i])
        for j in sorted(x for x in texts if x < i and x // 10 == i // 10):
            b = shingles_of(texts[j])
            if len(a & b) / len(a | b) >= 0.75:
                smallest[i] = (j, len(a & b) / len(a | b))
                break
    found = {}
    for r in fingerprints.near_pairs(docs).collect():
        a, b = shingles_of(texts[r.doc_id]), shingles_of(texts[r.near_doc])
        assert r.near_doc < r.doc_id and abs(r.jaccard - len(a & b) / len(a | b)) < 1e-9
        assert r.jaccard >= 0.75
        found[r.doc_id] = min(found.get(r.doc_id, r.near_doc), r.near_doc)
    assert any(i % 10 == 2 and j % 10 == 1 for i, (j, _) in smallest.items())
    assert found == {i: j for i, (j, _) in smallest.items()}
    rows = fingerprints.compared(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert {r.doc_id: r.near_doc for r in rows if r.near_doc is not None} == found
    assert not fingerprints.compared(no_docs).count()


def test_compared_keeps_every_odd_row(odd_docs, odd_rows):
    rows = fingerprints.compared(odd_docs).collect()
    check(rows, odd_rows)
    assert {(r.doc_id, r.near_doc) for r in rows if r.near_doc is not None} >= {(5, 4), (6, 4), (12, 11), (8, 7)}
