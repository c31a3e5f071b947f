import random
import zlib

import fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from vakanz.llm import toxicity as tox


def corpus(seed, n):
    """Prose of two languages, one text in four with some inflected insults of its language."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        language = rng.choice(("en", "de"))
        words = fixtures.prose(seed * 10_000 + i, rng.randrange(20, 120)).split()
        words += rng.choices(tox.FUNCTION_WORDS[language].split(), k=20)
        toxic = int(rng.random() < 0.25)
        stem = {"en": "grumb", "de": "knolz"}[language]
        words += [stem + rng.choice(("", "ing", "er", "est", "ly")) for _ in range(rng.randrange(2, 5) * toxic)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_texts_are_told_apart(spark):
    rows = corpus(1, 1200)
    docs = fixtures.documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    found = tox.toxicity_report(docs, labels).collect()
    truth = {i: t for i, _, t in rows}
    out = [r for r in found if r["held_out"]]
    assert len(found) == 1200 and len(out) > 150
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97
    assert all((r["score"] >= 0.5) == r["predicted"] and 0 <= r["score"] <= 1 for r in found)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    rows = corpus(2, 300)
    docs = fixtures.documents(spark, [r[:2] for r in rows], clashes=False)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    other = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    plain = sorted(map(tuple, tox.toxicity_report(docs, labels).collect()))
    assert plain == sorted(map(tuple, tox.toxicity_report(docs.withColumn("lang", F.lit("xx")), other).collect()))


def test_scores_do_not_depend_on_how_a_text_is_cut(monkeypatch):
    rows = corpus(3, 300)
    network = tox.fit([tox.buckets(t) for _, t, _ in rows], np.array([y for _, _, y in rows]), rounds=1)
    text = " ".join(t for _, t, _ in rows[:8])
    whole = tox.Scorer(network).logit(text)
    monkeypatch.setattr(tox, "WORDS", 7)
    cut = tox.Scorer(network).logit(text)
    assert whole[1] == cut[1] and abs(whole[0] - cut[0]) < 1e-4


def test_buckets_are_those_of_each_word_alone(monkeypatch):
    text = fixtures.prose(4, 500) + " Straße ÉCOLE école x " + "y" * 300
    whole = tox.buckets(text)
    alone = np.concatenate([tox.buckets(w) for w in text.split()])
    assert (whole == alone).all() and (tox.buckets("ÉCOLE") == tox.buckets("école")).all()
    tox._powers.cache_clear()
    monkeypatch.setattr(tox, "SPAN", 400)
    assert (tox.buckets(text) == alone).all()
    tox._powers.cache_clear()


def test_slopes_are_those_of_small_steps():
    rows = corpus(5, 60)
    texts, labels = [tox.buckets(t) for _, t, _ in rows], np.array([y for _, _, y in rows])
    network = tox.fit(texts, labels, rounds=1)
    coded = [network.rows[t] for t in texts]
    weight = np.ones(len(labels))

    def loss():
        out = 0.0
        for own, y in zip(coded, labels, strict=True):
            table = network.embeddings @ np.concatenate([f.transpose(1, 0, 2).reshape(tox.DIMS, -1) for f in network.filters], axis=1)
            pooled = np.concatenate([np.maximum(v.max(0), 0) for v in tox.activations(tox.summed(table, own), tox.FILTERS, network.biases)])
            logit = pooled @ network.weights + 0.1
            out += np.log1p(np.exp(-logit if y else logit))
        return out / len(labels)

    found = tox._slopes(network, coded, labels, weight, 0.1)
    parts = [network.embeddings, *network.filters, *network.biases, network.weights]
    for values, slopes in zip(parts, found, strict=False):
        flat = values.reshape(-1)
        for at in np.argsort(-np.abs(slopes.reshape(-1)))[:2]:
            before = flat[at]
            flat[at] = before + 1e-5
            up = loss()
            flat[at] = before - 1e-5
            down = loss()
            flat[at] = before
            assert abs((up - down) / 2e-5 - slopes.reshape(-1)[at]) < 0.02 * abs(slopes.reshape(-1)[at]) + 1e-4


def test_long_texts_and_every_label_are_learnt(spark):
    """One kind of insult stands in long texts only; more texts are labelled than one step or sample takes."""
    rows, rng = [], random.Random(6)
    for i, text, _ in corpus(6, 1000):
        toxic = i % 4 == 0
        if i % 2 == 0:  # half of the texts, half of them toxic, are longer than 8000 characters
            text += " " + fixtures.prose(i, 1800)
        if toxic:
            words = text.split()
            words[rng.randrange(len(words))] = "zwurbel" + rng.choice(("", "ig", "t"))
            text = " ".join(words)
        rows.append((i, text.replace("grumb", "tame").replace("knolz", "zahm"), int(toxic)))
    docs = fixtures.documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    learnt = tox.learnable(docs, labels).cache()
    own = {i: (t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5}
    assert {r["doc_id"]: (r["text"], r["label"]) for r in learnt.select("doc_id", "text", "label").collect()} == own
    counts = np.zeros((2, tox.BUCKETS), int)
    for text, label in own.values():
        counts[label, np.unique(tox.buckets(text))] += 1
    counts[:, 0] = 0
    found = {tuple(r) for r in tox.bucket_counts(learnt).collect()}
    assert found == {(b, *counts[:, b].tolist()) for b in np.flatnonzero(counts.sum(0) >= tox.LEAST_DOCS).tolist()}
    truth = {i: t for i, _, t in rows}
    report = [r for r in tox.toxicity_report(docs, labels).collect() if r["held_out"] and r["doc_id"] % 2 == 0]
    assert len(report) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in report]) > 0.97


def test_of_a_repeated_id_the_least_text_is_learnt_once(spark):
    docs = fixtures.documents(spark, [(1, "b"), (1, "a"), (1, "a"), (2, "c"), (2, None), (3, "d"), (4, "e"), (None, "f")])
    labels = spark.createDataFrame([(i, 1) for i in (1, 1, 2, 3, None)] + [(4, 0), (4, 1)], "doc_id bigint, toxic int")
    found = sorted((r["doc_id"], r["text"]) for r in tox.learnable(docs, labels).collect())
    assert found == [(i, t) for i, t in ((1, "a"), (2, ""), (3, "d")) if zlib.crc32(str(i).encode()) % 5]


def test_the_gradient_of_a_batch_is_the_same_from_any_tasks(spark):
    rows = corpus(7, 80) + [(80, "", 1)]
    texts, labels = [tox.buckets(t) for _, t, _ in rows], np.array([y for _, _, y in rows])
    network = tox.fit(texts, labels, rounds=1)
    docs = spark.createDataFrame([(y, t) for _, t, y in rows], "label int, text string")
    weights = np.array([0.7, 2.0])
    one, many = (tox.batch_slopes(docs.repartition(n), network, weights) for n in (1, 7))
    assert all((x == y).all() for x, y in zip(one, many, strict=True))
    alone = tox._slopes(network, [network.rows[t] for t in texts[:80]], labels[:80], weights[labels[:80]], network.bias)
    assert all(np.allclose(x, y, rtol=1e-3, atol=1e-5) for x, y in zip(one, alone, strict=True))
    assert tox.batch_slopes(docs.limit(0), network, weights) is None


def test_the_threshold_parts_counted_classes():
    places, clean, toxic = np.array([-5, 0, 1, 9, 30]), np.array([14, 2, 1, 0, 0]), np.array([0, 0, 1, 3, 5])
    assert tox.threshold(places, clean, toxic) == (0 + 1 + 1) / 2 * tox.GRID
    assert tox.threshold(places, clean, np.array([0, 0, 0, 3, 5])) == (1 + 1 + 9) / 2 * tox.GRID
    assert tox.threshold(places[:1], clean[:1], toxic[:1]) > -5 * tox.GRID > tox.threshold(places[:1], toxic[:1], clean[:1])


def test_odd_rows_no_labels_and_taken_names(spark):
    docs = fixtures.documents(spark, fixtures.odd_rows())
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1), (7, None), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    assert tox.toxicity_report(docs, labels).count() == len(fixtures.odd_rows())
    none = tox.toxicity_report(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and {r["predicted"] for r in none} == {0}
    assert tox.toxicity_report(fixtures.empty(docs), labels).count() == 0
    with pytest.raises(ValueError):
        tox.with_toxicity(docs, None)


def test_texts_hashed_together_are_hashed_as_alone(spark, monkeypatch):
    """Texts of all lengths, some of them without words, in one group and in many; and no more hashing than one call a group."""
    texts = [t for _, t, _ in corpus(8, 60)] + ["", " . ", "x", "\ud800a b\U0001f600c", "ΑΣ Σ", "y" * 900 + " z"]
    alone = [tox.buckets(t) for t in texts]
    calls, hashed = [], tox._buckets
    monkeypatch.setattr(tox, "_buckets", lambda lowered: calls.append(len(lowered)) or hashed(lowered))
    for span in (tox.SPAN, 1000):
        monkeypatch.setattr(tox, "SPAN", span)
        calls.clear()
        doubled = list(tox.each(iter(texts), lambda found: [found, 2 * found]))
        assert len(doubled) == len(texts) == sum(calls)
        assert len(calls) <= 1 + sum(map(len, texts)) // span
        assert all((a == b).all() and (2 * a == c).all() for a, (b, c) in zip(alone, doubled, strict=True))
    assert list(tox.each([])) == []


def test_slopes_are_the_same_however_many_are_held(spark, monkeypatch):
    rows = corpus(9, 40)
    network = tox.fit([tox.buckets(t) for _, t, _ in rows], np.array([y for _, _, y in rows]), rounds=1)
    docs = spark.createDataFrame([(y, t) for _, t, y in rows] + [(1, "")], "label int, text string").coalesce(1)
    whole = tox.batch_slopes(docs, network, np.array([0.7, 2.0]))
    monkeypatch.setattr(tox, "HELD_SLOPES", 1)  # of this process; tasks are given the function with it
    unseen = spark.createDataFrame([(1, "zzzz qqqq"), (0, "")], "label int, text string")
    none = tox.batch_slopes(unseen, network, np.array([0.7, 2.0]))
    assert not none[0].any() and all((x == y).all() for x, y in zip(whole, tox.batch_slopes(docs, network, np.array([0.7, 2.0])), strict=True))
