"""Operators over groups of documents: exact and near copies, components, shards, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from fixtures import documents, empty, odd_rows, prose
from pyspark.sql import functions as F

from vakanz.llm import bpe, components, exact, leaks, omh, quality, shards
from vakanz.llm.common import staged

FOLDER = "/root/testdata/sf0.001"


def weak(text):
    """Almost every text shares its hash with others."""
    return F.unhex(F.hex(F.length(text) % 3))


def check_exact(docs, found):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    expected = Counter()
    for norm, rows in groups.items():
        keep = min(rows)
        for row in rows:
            expected[row[2], keep[2], len(rows), hashlib.sha256(norm.encode()).hexdigest()] += 1
    rows = found.collect()
    assert Counter((r.doc_id or 0, r.keep_id or 0, r.group_size, r.text_sha256) for r in rows) == expected
    assert sum(r.kept for r in rows) == len(groups)
    assert all((r.doc_id or 0) == (r.keep_id or 0) for r in rows if r.kept)


def test_exact_groups(spark):
    more = [(30, "a b"), (31, "ab "), (32, "a  b"), (33, "a  b"), (34, "ac"), (35, "a c")]
    docs = documents(spark, odd_rows() + more)
    check_exact(docs, exact.exact_groups(docs))
    check_exact(docs, exact.exact_groups(docs, digest=weak))
    for digest in (exact.md5_128, weak):
        kept = exact.kept_documents(docs, digest=digest)
        assert kept.columns == docs.columns
        norms = [re.sub(r"\s", "", r.text or "") for r in kept.collect()]
        assert len(norms) == len(set(norms)) == 6
        assert {32, 35} <= {r.doc_id for r in kept.collect()}
    assert exact.exact_groups(empty(docs)).count() == 0 and exact.kept_documents(empty(docs)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    found = {r.node: r.root for r in components.roots(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert found == {n: root(n) for n in parent if any(n in p and p[0] != p[1] for p in links)}
    assert components.roots(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def edited(seed, text, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice(([], [f"new{rng.randrange(10**6)}"], [words[at], f"more{rng.randrange(10**6)}"]))
    return " ".join(words)


def common_words(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def alike(a, b):
    """Whether two lists of words are similar, from their longest common subsequence."""
    need = 0.8 * (len(a) + len(b)) / 1.8 - 1e-9
    if not a or not b or sum((Counter(a) & Counter(b)).values()) < need:
        return False
    return common_words(a, b) >= need


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seqs = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in rows]
    for k, (a, x) in enumerate(seqs):
        for b, y in seqs[k + 1 :]:
            u, v = root(a), root(b)
            if u != v and alike(x, y):
                parent[max(u, v)] = min(u, v)
    return {i: root(i) for i, _ in rows}


def test_near_classes_are_those_of_brute_force(spark):
    # A hot group whose copies are mostly too far from each other, one below the edge, one of a chain.
    origin = prose(1, 150)
    rows = [(1, origin)] + [(2 + i, edited(i, origin, 1 + i % 5)) for i in range(330)]
    chain = prose(2, 120)
    for i in range(12):
        rows.append((400 + i, chain))
        chain = edited(50 + i, chain, 2)
    shared = prose(3, 60)
    rows += [(500 + i, prose(600 + i, 60) + " " + shared) for i in range(40)]
    rows += [(600 + i, prose(800 + i // 2, 9 + i // 2)) for i in range(20)] + [(700, None), (701, ""), (702, "!?"), (703, "one two"), (704, "One, two!")]
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in omh.near_classes(docs).collect()}
    expected = brute_classes(rows)
    sizes = Counter(expected.values())
    assert {i: r.class_id for i, r in found.items()} == expected
    assert all(r.class_size == sizes[r.class_id] and r.kept == (i == r.class_id) for i, r in found.items())
    assert sizes[1] > 150 and expected[704] == 703 and len({expected[i] for i in range(500, 540)}) == 40


def test_near_classes_of_short_texts_are_those_of_brute_force(spark):
    rows = []
    for n in range(7, 48):
        for k in range(6):
            text = prose(5000 + 10 * n + k, n)
            at = (n, 0, n - 1, n // 2, n, n - 1)[k]
            words = text.split()
            words[at : at + (k == 5)] = [f"added{n}x{k}"]
            rows += [(len(rows), text), (len(rows) + 1, " ".join(words))]
    tail = prose(4, 12)  # a common line that many texts end in, none of them similar
    rows += [(len(rows) + i, prose(9000 + i, 12) + " " + tail) for i in range(60)]
    found = {r.doc_id: r.class_id for r in omh.near_classes(documents(spark, rows)).collect()}
    expected = brute_classes(rows)
    assert found == expected
    lengths = {len(rows[a][1].split()) for b, a in expected.items() if a != b}
    assert set(range(8, 20)) <= lengths


def test_near_classes_of_odd_tables(spark):
    docs = documents(spark, odd_rows())
    found = omh.near_classes(docs).collect()
    same = [r for r in found if r.class_id == 5]
    assert len(found) == 10 and len(same) == 4 and sum(r.kept for r in found) == 7
    kept = omh.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert omh.near_classes(empty(docs)).count() == 0 and omh.kept_documents(empty(docs)).count() == 0


def test_similarity_is_that_of_the_longest_common_subsequence():
    import numpy as np

    common = common_words
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randrange(rng.choice((3, 20, 200))) for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(20)] * rng.randrange(2)
        n = common(a, b)
        share = n / max(1, len(a) + len(b) - n)
        found = omh.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.7)
        assert abs(found - (share if share >= 0.7 - 1e-9 and b else 0)) < 1e-9


def test_shards(spark):
    docs = documents(spark, odd_rows() + [(i, prose(i, 5)) for i in range(40, 300)] + [(999, "hot")] * 200)
    found = shards.assign_shards(docs, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()
    )
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    hot = Counter(r.shard for r in found if r.doc_id == 999)
    assert len(hot) == 16 and max(hot.values()) < 40
    key = lambda rows: sorted((r.doc_id or 0, r.shard, r.slot) for r in rows)
    assert key(found) != key(shards.assign_shards(docs, seed=21, bucket_bytes=2000).collect())
    assert shards.assign_shards(empty(docs)).count() == 0
    few = shards.assign_shards(docs.limit(3)).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_written_shards_hold_whole_records(spark, tmp_path):
    docs = documents(spark, odd_rows() + [(i, prose(i, 50)) for i in range(40, 140)])
    shards.write_shards(docs, str(tmp_path / "out"), shards=4, bucket_bytes=5000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.slot) for r in back.collect()) == Counter((r.doc_id, r.text, r.slot) for r in docs.collect())
    counts = Counter(r["shard_"] for r in back.collect())
    assert len(counts) == 4 and max(counts.values()) - min(counts.values()) <= 1
    shards.write_shards(empty(docs), str(tmp_path / "none"))


def test_assigned_shards_are_those_written(spark, tmp_path):
    # Many more buckets by bytes of records than by a fixed size a row.
    docs = documents(spark, [(i, prose(i, 60)) for i in range(200)]).select("doc_id", "text")
    shards.write_shards(docs, str(tmp_path / "out"), bucket_bytes=2000)
    written = spark.read.parquet(str(tmp_path / "out"))
    key = lambda rows: sorted((r.doc_id, r.shard, r.slot) for r in rows.collect())
    assert key(shards.assign_shards(docs, bucket_bytes=2000)) == key(written)


def test_pipeline_agrees_with_its_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.scored_documents(docs, labels).collect() if r.predicted}
    groups = defaultdict(list)
    for i in good:
        groups[re.sub(r"[\x20\x09-\x0D]", "", texts[i])].append((-len(texts[i]), i))
    distinct = [(i, texts[i]) for i in sorted(min(g)[1] for g in groups.values())]
    near = sorted(set(brute_classes(distinct).values()))
    items = [" ".join(leaks.words(r.text)) for r in benchmark.collect()]
    clean = {i for i in near if not any(f" {t} " in f" {' '.join(leaks.words(texts[i]))} " for t in items)}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(found) == clean and 0 < len(clean) < len(near) < len(good) < len(texts)
    for i, r in found.items():
        assert r["ids"] == list(bpe.encoder(corpus_pipeline.VOCABULARY).encode(texts[i], bpe.array("i"))) and r.n_tokens == len(r["ids"])


def test_pipeline_stages_keep_columns(spark, tmp_path):
    docs = documents(spark, odd_rows()).withColumn("lang", F.lit(None).cast("string"))
    for table in (docs, empty(docs)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert staged(stage(spark, table, FOLDER)).columns == docs.columns, name
        assert "ids" in staged(corpus_pipeline.STAGES[-1][1](spark, table, FOLDER)).columns
