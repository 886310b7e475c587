from collections import defaultdict
from random import Random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S


def brute(rows, length):
    """Spans by a dictionary of all windows."""
    where, words = defaultdict(set), {}
    for i, text in rows:
        if i is None or text is None:
            continue
        w = text.split()
        words.setdefault(i, []).append(w)
        for k in range(len(w) - length + 1):
            where[tuple(w[k : k + length])].add(i)
    out = set()
    for i, texts in words.items():
        marks = set()
        for w in texts:
            marks |= {k for k in range(len(w) - length + 1) if len(where[tuple(w[k : k + length])]) > 1}
        spans = []
        for k in sorted(marks):
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + length
            else:
                spans.append([k, k + length])
        out |= {(i, a, b) for a, b in spans}
    return out


def corpus(seed):
    rng = Random(seed)
    prose = lambda n: [rng.choice(["of", "the", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(n)]
    shared = [prose(rng.choice([8, 19, 20, 21, 33, 70, 200])) for _ in range(25)]
    rows = []
    for i in range(260):
        parts = prose(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            parts += rng.choice(shared) + prose(rng.randrange(0, 30))
        rows.append((i, " ".join(parts)))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 60, 3)]  # exact copies
    rows += [(2000 + k, " ".join(x if rng.random() > 0.03 else "zz" for x in rows[k][1].split())) for k in range(0, 60, 2)]
    rows += [(3000, "same " * 400), (3001, "same " * 150), (3002, "alone " * 300), (3003, "x"), (3004, ""), (3005, None), (None, rows[0][1]), rows[5], rows[7]]
    return rows


@pytest.mark.parametrize(("seed", "bucket_rows"), [(1, 40_000), (2, 7)])
def test_equals_brute_force_with_few_and_many_buckets(spark, seed, bucket_rows):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS gram", "2 AS bucket")
    got = {(r.doc_id, r.first_word, r.end_word) for r in S.repeated_passages(df, length=20, gram=6, bucket_rows=bucket_rows).collect()}
    assert got == brute(rows, 20)


def test_hot_passages_are_split_and_settled_across_parts(spark):
    """A passage that most documents hold, rows that repeat, and documents with windows that only one other part has."""
    rng = Random(6)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    boiler, other = prose(45), prose(33)
    rows = []
    for i in range(400):
        cut = rng.randrange(20, 46)
        own = boiler[:cut] if rng.random() < 0.7 else boiler[rng.randrange(15) :]
        rows.append((i, " ".join([*prose(rng.randrange(12)), *own, *prose(rng.randrange(12)), *(other if rng.random() < 0.1 else [])])))
    rows += [rows[3]] * 200 + [(4, f"{rows[5][1]} {k}") for k in range(100)] + [(5, f"{k} {rows[4][1]}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.first_word, r.end_word) for r in S.repeated_passages(df, length=20, gram=6).collect()}
    for bucket_rows in (11, 60):
        got = S.repeated_passages(df, length=20, gram=6, bucket_rows=bucket_rows, sampled=40).collect()
        assert {(r.doc_id, r.first_word, r.end_word) for r in got} == brute(rows, 20) == whole
        assert all(r.other_doc_id != r.doc_id for r in got)


def test_odd_rows(odd):
    got = {(r.doc_id, r.first_word, r.end_word, r.n_words, r.other_doc_id) for r in S.repeated_passages(odd, length=5, gram=3).collect()}
    assert got == {(1, 0, 10, 10, 2), (2, 0, 10, 10, 1)}  # repeats within a text, however long, are none


def test_empty_table(spark):
    assert S.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 4, (500, 12)).astype(np.uint64)
    size = rng.integers(1, 13, 500)
    words[np.arange(12) >= size[:, None]] = 0
    order = S.multikey_quicksort(words, size)
    rows = [tuple(words[i, : size[i]]) for i in order]
    assert rows == sorted(rows)


def test_every_window_has_its_anchor():
    rng = np.random.default_rng(4)
    h = rng.integers(1, 50, 400).astype(np.uint64)
    doc = np.repeat([0, 1, 2], [30, 300, 70])
    at, _, fewest, most = S.anchors(h, doc, 50, 16)
    covered = sorted(a - k for a, lo, hi in zip(at, fewest, most) for k in range(lo, hi + 1))
    assert covered == [i for i in range(351) if doc[i] == doc[i + 49]]
