import math
import random

import pytest
from pyspark.sql import functions as F

from vakanz.operators import index as I
from vakanz.operators import profile as PR
from vakanz.operators import ranking as RK
from vakanz.operators import scoring as SC
from vakanz.operators.expand import expand
from vakanz.plans import jobs
from vakanz.plans.vocabulary import intent_terms
from vakanz.runtime import broadcast_if_small, durable, keep


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_expand(spark):
    vocabulary = frame(spark, [(t, 1) for t in "tasks task tsak tanks meine sie sien".split()], "term string, df long")
    terms = intent_terms(rows=[
        ("a", "task", 1, 4, 3.0), ("a", "meine", 0, 0, 1.0), ("a", "sie", 0, 0, 1.0), ("b", "sie", 1, 0, 1.0),
    ])
    found = {(r["intent"], r["term"], r["exact"]) for r in expand(vocabulary, terms, ["meine"]).collect()}
    assert found == {
        ("a", "task", False), ("a", "tasks", False), ("a", "sie", True), ("b", "sie", False), ("b", "sien", False),
    }


@pytest.mark.parametrize(
    "scores, kept",
    [([5, 4, 3], [5, 4]), ([5, 4, 4, 4], [5, 4, 4, 4]), ([5], [5]), ([], []), ([-3, 7, -3], [7, -3, -3])],
)
def test_cutoff(spark, scores, kept):
    df = frame(spark, [("x", s * 100_000) for s in scores], "intent string, score_micro long")
    found = [r["score_micro"] // 100_000 for r in RK.keep_from_cutoff(df, "intent").collect()]
    assert sorted(found) == sorted(kept)


def test_cutoff_equals_sorting(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(-10**9, 10**10) if g == "wide" else rng.randrange(50)) for g in ("wide", "ties") for _ in range(3000)]
    df = frame(spark, rows, "g string, score_micro long")
    found = {r["g"]: r["cutoff"] for r in RK.cutoff(df, "g").collect()}
    for g in ("wide", "ties"):
        values = sorted((v for k, v in rows if k == g), reverse=True)
        assert found[g] == values[len(values) // 2]


@pytest.mark.parametrize("n, low, high", [(4, 0, 0), (5, 0, 1), (399, 0, 79), (400, 1, 80)])
def test_rank_slice(spark, n, low, high):
    df = spark.range(n).select(F.lit("x").alias("g"), F.col("id").alias("v"))
    ranked = RK.global_rank(df.repartition(5), "g", [F.col("v").desc()])
    found = sorted((r["rnk"], r["v"]) for r in RK.rank_slice(ranked).collect())
    assert found == [(k, n - 1 - k) for k in range(low, high)]


def test_global_rank_equals_sorting(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaab"), rng.randrange(40), i) for i in range(5000)]
    df = frame(spark, rows, "g string, v int, i int")
    ranked = RK.global_rank(df, "g", [F.col("v").desc(), F.col("i")]).collect()
    for g in "ab":
        ordered = sorted((-v, i) for k, v, i in rows if k == g)
        found = sorted((r["rnk"], -r["v"], r["i"]) for r in ranked if r["g"] == g)
        assert found == [(k, *pair) for k, pair in enumerate(ordered)]
        assert {r["entries"] for r in ranked if r["g"] == g} == {len(ordered)}


HEADINGS = [
    (1, "ihre aufgaben und tasks"), (2, "your tasks tasks"), (3, "about you"), (4, "sie bringen"), (5, "nothing here"),
]
TERMS = [
    ("t", "tasks", 0, 0, 2.0), ("t", "task", 1, 4, 3.0), ("t", "aufgabe", 1, 0, 1.0), ("t", "bringen", 0, 0, -0.5),
    ("u", "you", 0, 0, 1.0),
]


def model_scores():
    docs = {i: h.split() for i, h in HEADINGS}
    n, size = 2 * len(docs), sum(map(len, docs.values()))
    near = {"task": {"tasks"}, "aufgabe": {"aufgaben"}}
    exact = {"tasks": 2.0, "bringen": -0.5}
    scores = {}
    for i, words in docs.items():
        total, hits = 0.0, set()
        for term, w in exact.items():
            tf = words.count(term)
            if tf:
                df = sum(term in d for d in docs.values())
                idf = math.log(n / (df + 1)) + 1
                total += w * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / (size / n)))
                hits.add(term)
        for term, w in (("task", 3.0), ("aufgabe", 1.0)):
            if near[term] & set(words):
                total += w
                hits |= near[term] & set(words)
        if hits:
            scores[i] = (total + (len(hits) - 1) / 4) * 2 / 3
    return scores


def test_scores(spark):
    df = frame(spark, HEADINGS, "id long, h string")
    headings = SC.tokenised(df, "h", [])
    size = SC.collection(headings, len(HEADINGS))
    expanded = durable(SC.expanded_terms(headings, intent_terms(rows=TERMS), [], size.documents))
    found = SC.score(headings, ["id"], expanded, size)
    expected = {(i, "t"): round(s * 1e6) for i, s in model_scores().items()}
    assert {(r["id"], r["intent"]): r["score_micro"] for r in found.collect()} == expected


def test_order_of_hits_is_exact(spark):
    """Ids with an equal beginning and paragraph numbers beyond any width."""
    ids = ["a" * 12 + x for x in "cab"]
    keys = [(i, n) for i in ids for n in (5_000, 4_095, 2**31 - 1)]
    scored = frame(spark, [("t", *k, 7) for k in keys], "intent string, posting_id string, paragraph_number int, score_micro long")
    ranked = PR.ranked_hits(scored, jobs.KEYS).orderBy("rnk").collect()
    assert [(r["posting_id"], r["paragraph_number"]) for r in ranked] == sorted(keys)
    assert [r["rnk"] for r in ranked] == list(range(9))


def test_status(spark):
    terms = [("none", "fehlt", 0, 0, 1.0), ("one", "tasks", 0, 0, 1.0), ("two", "tasks", 0, 0, 1.0), ("two", "sie", 0, 0, 1.0)]
    df = frame(spark, HEADINGS, "id long, h string")
    scored, status = SC.search(df, ["id"], "h", 5, intent_terms(rows=terms))
    assert {r["intent"]: r["status"] for r in status.collect()} == {
        "none": "empty", "one": "insufficient", "two": "ok",
    }
    assert {r["intent"] for r in scored.collect()} == {"two"}
    empty, _ = SC.search(df, ["id"], "h", 5, intent_terms(rows=terms[:1]))
    assert empty.count() == 0
    lines = jobs.report_lines(
        frame(spark, [], "intent string, term string, cnt long, rnk long"),
        frame(spark, [("tasks", "insufficient"), ("benefits", "empty")], "intent string, status string"),
    )
    assert [tuple(r) for r in lines.collect()] == [("task_frequency", 0, jobs.TOO_LITTLE)]


def test_term_frequency(spark):
    hits = frame(
        spark,
        [("t", 20, 2, "zweites zweites erstes kurz"), ("t", 30, 9, "erstes drittes"), ("u", 1, 1, "erstes")],
        "intent string, score_micro long, id long, c string",
    )
    order = -F.col("score_micro")
    for parts in (1, 4):
        counts = PR.term_frequency(hits.repartition(parts), "c", order)
        ranked = PR.rank_terms(counts.where("intent = 't'")).orderBy("rnk").collect()
        assert [(r["term"], r["cnt"]) for r in ranked] == [("erstes", 2), ("zweites", 2), ("drittes", 1)]
    bucket = PR.rank_terms(PR.term_frequency(hits, "c", order, keep_null_bucket=True))
    rows = bucket.where("intent = 't'").orderBy("rnk").collect()
    assert [(r["term"], r["cnt"]) for r in rows][-1] == (None, 1) and rows[0]["entries"] == 4


def test_first_seen_holds_any_rank(spark):
    top = 2**63 - 1
    df = frame(spark, [("t", top, "erstes zweites"), ("t", -top, "letztes")], "intent string, k long, c string")
    counts = PR.term_frequency(df, "c", F.col("k")).orderBy("first_seen").collect()
    assert [r["term"] for r in counts] == ["letztes", "erstes", "zweites"]


def test_index_tables(spark):
    texts = frame(spark, [(1, "alpha beta alpha"), (2, "beta"), (3, "")], "id long, t string")
    index = I.inverted_index(texts, ["id"], "t")
    assert sorted(map(tuple, index.collect())) == [("alpha", 1, 2), ("beta", 1, 1), ("beta", 2, 1)]
    assert sorted(map(tuple, I.term_stats(index).collect())) == [("alpha", 1, 2), ("beta", 2, 2)]
    empty = I.index_counts(texts.where("false"), texts).first()
    assert (empty["postings"], empty["paragraphs"], empty["avg_paragraphs"]) == (0, 3, None)
    postings = frame(spark, [("a",), ("b",)], "posting_id string")
    paragraphs = frame(spark, [("a", 0)], "posting_id string, paragraph_number int")
    joined = I.headings_by_posting(postings, paragraphs, "posting_id").collect()
    assert sorted(map(tuple, joined), key=str) == [("a", 0), ("b", None)]


def test_keep_and_broadcast(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert [tuple(r) for r in keep(df, F.col("x") > 15).collect()] == [(8, 16), (9, 18)]
    hinted = broadcast_if_small(df, 320)._jdf.queryExecution().analyzed().toString()
    plain = broadcast_if_small(df, 319)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in hinted and "ResolvedHint" not in plain


@pytest.mark.parametrize("name", ["page_sections", "posting_sections", "ranked_search", "term_profile"])
def test_no_python_workers(spark, name):
    import __spark_entry__ as entry
    from compare import TESTDATA

    plan = entry.queries()[name](spark, f"{TESTDATA}/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[-1] + 1))
    return row[-1]


def test_expansion_by_deletions_finds_what_comparing_all_finds(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abä") for _ in range(rng.randrange(0, 8)))
    vocabulary = sorted({word() for _ in range(400)})
    queries = set()
    for _ in range(60):
        d = rng.randrange(0, 4)
        queries.add(("i", word() or "a", d, rng.randrange(0, 5) if d else 0, 1.0))
    terms = spark.createDataFrame(sorted(queries), "intent string, term string, d int, p int, w double")
    words = spark.createDataFrame([(w, 1) for w in vocabulary], "term string, df long")
    found = sorted((r["query_term"], r["term"]) for r in expand(words, terms).collect())
    near = lambda q, d, p, w: w == q if d == 0 else w[:p] == q[:p] and _distance(q, w) <= d
    assert found == sorted((f"{q}~{d}/{p}", w) for _, q, d, p, _ in queries for w in vocabulary if near(q, d, p, w))
