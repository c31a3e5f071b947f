import hashlib
import math
import random

import fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from vakanz.llm import centroids


def table(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    for name in (*fixtures.CLASHES, "cluster", "distance", "vector"):
        frame = frame.withColumn(name, F.lit(name))
    return frame


def brute(rows, clusters, rounds):
    """Lloyd's rounds, every vector against every centroid, with Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in order[:clusters]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((dist(v, m), c) for c, m in enumerate(means))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(means)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                means[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [(i, *reversed(nearest(v))) for i, v in kept], means


def some_rows(seed, n, values=None):
    rng = random.Random(seed)
    spots = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    draw = lambda: [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(spots)]
    if values:
        draw = lambda: [rng.choice(values) for _ in range(64)]
    return [(i, draw()) for i in range(n)]


@pytest.mark.parametrize(("values", "block"), [(None, 64), (None, 8192), ([0.0, 0.00390625], 50), ([-300000.0, 2.5, 1e6, 1e30], 64)])
def test_clusters_are_those_of_brute_force(spark, values, block):
    rows = some_rows(3, 260, values)
    rows += [(i, rows[7][1]) for i in range(260, 330)] + [rows[5], (None, rows[9][1])]
    bad = [(900, None), (901, []), (902, rows[0][1][:63]), (903, [None, *rows[0][1][1:]]), (904, [math.nan, *rows[0][1][1:]]), (905, [math.inf, *rows[0][1][1:]])]
    members, means = centroids.clustered(table(spark, rows + bad), clusters=12, rounds=5, block=block)
    held = [(i, [max(-(2.0**19), min(2.0**19, x)) for x in v]) for i, v in rows]
    expected, expected_means = brute(held, 12, 5)
    assert means.tolist() == expected_means
    assert sorted(map(repr, map(tuple, members.collect()))) == sorted(map(repr, expected))


def test_vectors_with_a_gap_left_are_not_scanned():
    rng = np.random.default_rng(4)
    spots = rng.integers(-2000, 2000, (5, 64))
    vectors = spots[rng.integers(0, 5, 400)] + rng.integers(-20, 20, (400, 64))
    block = centroids.Block.new(vectors, 5)
    offsets = np.zeros(5)
    block.assign(spots, offsets)
    moved = spots + rng.integers(-3, 3, spots.shape)
    offsets = offsets + centroids.drift(spots, moved)
    again = centroids.Block.read(block.state() | {"n": 400, "vectors": centroids.packed(vectors)}, 64, 5)
    assert again.expired(offsets) == []
    far = offsets + 1e6
    assert len(again.expired(far)) == 400


def test_report_few_vectors_and_an_empty_table(spark):
    rows = some_rows(5, 9)
    found = centroids.cluster_report(table(spark, rows)).collect()
    assert len(found) == 9 and {r["inertia"] for r in found} == {0} and len({r["cluster"] for r in found}) == 9
    one = centroids.cluster_report(table(spark, rows), clusters=1).collect()
    expected, means = brute(rows, 1, 5)
    assert sorted((r["vec_id"], r["distance"]) for r in one) == sorted((i, d) for i, _, d in expected)
    assert {r["centroid_sha256"] for r in one} == {hashlib.sha256(",".join(map(str, means[0])).encode()).hexdigest()}
    assert centroids.cluster_report(table(spark, rows).limit(0)).count() == 0
