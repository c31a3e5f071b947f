import hashlib
import random
import zlib

import fixtures
import pytest
from pyspark.sql import functions as F

from vakanz.llm import runs


def brute(words, least=12):
    """Every period, every stretch."""
    found, n = {}, len(words)
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            start = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            if i > start:
                found.setdefault((start, i - start + period), period)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(least, 2 * q))


def report(doc_id, text):
    """The row of a document, by its definition."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), start, length, period, best and 1000 * length // period,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def words_with_runs(rng):
    words = [str(rng.randrange(rng.choice([1, 2, 3, 30]))).encode() for _ in range(rng.randrange(90))]
    if words and rng.random() < 0.5:
        a = rng.randrange(len(words))
        p = 1 + (len(words) - a) // rng.randrange(2, 9)
        words[a:] = [words[a + i % p] for i in range(len(words) - a)]
    return words


def test_runs_are_those_of_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        words = words_with_runs(rng)
        assert runs.runs_of(words) == brute(words)


def test_texts_laid_end_to_end_keep_their_own_runs():
    rng = random.Random(12)
    texts = [words_with_runs(rng) for _ in range(300)]
    assert runs.text_runs(texts) == [brute(t) for t in texts]


def test_one_word_again_and_again_takes_linear_time():
    assert runs.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]


def test_report_is_that_of_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(w.decode() for w in words_with_runs(rng))) for i in range(300)]
    rows += [(i, fixtures.prose(i, 120)) for i in range(300, 400)]
    tenth = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += list(zip(tenth, (None, "", " \t", "a", "a b", fixtures.prose(5, 300), "x " * 40), strict=False))
    rows += [(None, "a b " * 9), (400, None), (401, ""), (402, " \t\x0b\n"), (403, " x y " * 7), (7, rows[7][1])]
    found = runs.run_report(runs.with_planted_runs(fixtures.documents(spark, rows))).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(report(*r)) for r in rows)


def test_odd_rows_and_an_empty_table(spark):
    docs = fixtures.documents(spark, fixtures.odd_rows())
    assert runs.run_report(runs.with_planted_runs(docs)).count() == len(fixtures.odd_rows())
    assert runs.run_report(runs.with_planted_runs(fixtures.empty(docs))).count() == 0


def test_other_columns_stay_and_taken_names_are_refused(spark):
    docs = fixtures.documents(spark, [(1, "x y " * 8)])
    found = runs.with_runs(docs).first()
    assert found["score"] == "score" and found["collapsed"] == "x y" and tuple(found["runs"][0]) == (0, 16, 2)
    with pytest.raises(ValueError):
        runs.with_runs(docs.withColumn("Runs", F.lit(1)))
