"""Centroid clustering by Lloyd's rounds in integers, with heap-ordered bounds.

Vectors become integers (``floor(scale * x)``) and are held in blocks of ``BLOCK`` vectors, one row
of a table each. A vector that was scanned knows its distance to its own centroid (upper bound) and
to the second nearest one (lower bound). When centroids move, the gap between both shrinks by the
drift of its own centroid and the largest drift of another one at most; that sum accumulates into
an offset a cluster. Each cluster of a block keeps a heap of gaps, each raised by the offset at the
time of its scan: only vectors at the top whose key does not exceed the offset of now are popped
and scanned exactly, all others keep their cluster unseen. Gaps are rounded down and offsets up, so
a vector is left alone only if its centroid is nearer than any other; ties are scanned and go to
the smaller number.

A round reads the blocks and writes them anew with the sums of what was moved; sums of all blocks
and their changes are added by Spark, the driver sees one number a centroid and component. The
table before is removed then. Assignments, distances and centroids are exact.

Kept are vectors of exactly ``dims`` components, none of them null or not finite. Components are
held within ±2**27 after scaling, so that squared distances fit a long. Null ids are kept, and come
last in the choice of first centroids, where equal ids are taken by their vectors. Fewer vectors
than clusters make fewer clusters; an empty table gives an empty result. Repeated rows count each;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from vakanz.llm.common import give_back, ready, remove, written

#: Vectors of a block, the unit that a task holds.
BLOCK = 8192
#: Bound of scaled components, and of those whose distances doubles hold exactly.
MOST, EXACT = 1 << 27, 1 << 22
#: By how much bounds are widened, more than doubles can err.
WIDER = 1e-9


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector is kept."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values * scale), -MOST, MOST).astype(np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid, exact."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        v, c = vectors.astype(float), centroids.astype(float)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def packed(vectors: np.ndarray) -> bytes:
    """Vectors in the narrowest integers that hold them."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(np.int16 if most < 1 << 15 else np.int32).tobytes()


def unpacked(data: bytes, count: int, dims: int) -> np.ndarray:
    width = len(data) // (count * dims)
    return np.frombuffer(data, np.dtype(f"i{width}")).reshape(count, dims).astype(np.int64)


@dataclass
class Block:
    """Vectors with their clusters and one heap a cluster."""

    vectors: np.ndarray
    cluster: np.ndarray
    heaps: list[list[tuple[float, int]]]

    @classmethod
    def new(cls, vectors: np.ndarray, clusters: int) -> Block:
        # Nothing is known yet: every vector is due at once.
        heaps: list[list] = [[] for _ in range(clusters)]
        heaps[0] = [(-np.inf, i) for i in range(len(vectors))]
        return cls(vectors, np.full(len(vectors), -1, np.int32), heaps)

    @classmethod
    def read(cls, row: dict, dims: int, clusters: int) -> Block:
        cluster = np.frombuffer(row["cluster"], np.int32).copy()
        if not len(cluster):
            return cls.new(unpacked(row["vectors"], row["n"], dims), clusters)
        ends = np.frombuffer(row["ends"], np.int32).tolist()
        keys, places = np.frombuffer(row["keys"], float), np.frombuffer(row["places"], np.int32)
        heaps = [list(zip(keys[a:b].tolist(), places[a:b].tolist(), strict=True)) for a, b in zip([0, *ends], ends, strict=False)]
        return cls(unpacked(row["vectors"], row["n"], dims), cluster, heaps)

    def state(self) -> dict[str, bytes]:
        keys = np.array([k for heap in self.heaps for k, _ in heap], float)
        places = np.array([i for heap in self.heaps for _, i in heap], np.int32)
        ends = np.cumsum([len(heap) for heap in self.heaps], dtype=np.int32)
        return {"cluster": self.cluster.tobytes(), "keys": keys.tobytes(), "places": places.tobytes(), "ends": ends.tobytes()}

    def expired(self, offsets: np.ndarray) -> list[int]:
        """Pop the vectors whose gap may be used up."""
        out = []
        for heap, offset in zip(self.heaps, offsets.tolist(), strict=True):
            while heap and heap[0][0] <= offset:
                out.append(heappop(heap)[1])
        return out

    def assign(self, centroids: np.ndarray, offsets: np.ndarray) -> np.ndarray | None:
        """Scan the expired vectors; the change of counts and sums of each cluster, if any."""
        due = np.array(self.expired(offsets), np.int64)
        if not len(due):
            return None
        found = distances(self.vectors[due], centroids)
        nearest = found.argmin(1)
        own = found[np.arange(len(due)), nearest]
        found[np.arange(len(due)), nearest] = np.iinfo(np.int64).max
        second = found.min(1)
        gaps = np.sqrt(second) * (1 - WIDER) - np.sqrt(own) * (1 + WIDER)
        if len(centroids) == 1:
            gaps[:] = np.inf
        keys = gaps + offsets[nearest]
        fresh = self.cluster[due[0]] < 0
        for key, place, cluster in zip(keys.tolist(), due.tolist(), nearest.tolist(), strict=True):
            if fresh:
                self.heaps[cluster].append((key, place))
            else:
                heappush(self.heaps[cluster], (key, place))
        if fresh:
            for heap in self.heaps:
                heapify(heap)
        before = self.cluster[due]
        moved = before != nearest
        self.cluster[due] = nearest
        if not moved.any():
            return None
        rows = self.vectors[due[moved]]
        rows = np.concatenate([np.ones((len(rows), 1), np.int64), rows], axis=1)
        change = np.zeros((len(centroids), rows.shape[1]), np.int64)
        np.add.at(change, nearest[moved], rows)
        left = before[moved] >= 0
        np.subtract.at(change, before[moved][left], rows[left])
        return change


def drift(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much the gaps of each cluster shrink at most."""
    moved = np.sqrt(((after - before) ** 2).sum(1).astype(float))
    if len(moved) == 1:
        return moved
    order = np.argsort(moved)
    other = np.full(len(moved), moved[order[-1]])
    other[order[-1]] = moved[order[-2]]
    return (moved + other) * (1 + WIDER)


_STATE = "n int, vectors binary, cluster binary, keys binary, places binary, ends binary, change binary"
_NAMES = ("n", "vectors", "cluster", "keys", "places", "ends", "change")


def _blocks(rows: DataFrame, dims: int, scale: int, block: int) -> DataFrame:
    """``rows(id, vector)`` as blocks without clusters."""
    schema = StructType([StructField("ids", ArrayType(rows.schema["id"].dataType)), *StructType.fromDDL(_STATE).fields])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0

        def row() -> pa.RecordBatch:
            one = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one)
            data = [packed(np.concatenate(vectors)), b"", b"", b"", b"", None]
            return pa.RecordBatch.from_arrays(
                [listed, pa.array([len(one)], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["ids", *_NAMES]
            )

        for batch in batches:
            flat = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)
            whole = integers(flat, scale).reshape(-1, dims)
            low = 0
            while low < len(whole):
                high = min(len(whole), low + block - held)
                ids.append(batch.column(0).slice(low, high - low))
                vectors.append(whole[low:high])
                held, low = held + high - low, high
                if held == block:
                    yield row()
                    ids, vectors, held = [], [], 0
        if held:
            yield row()

    return rows.mapInArrow(gather, schema)


def _round(blocks: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """The blocks after one assignment."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, dims = centroids.shape
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in _NAMES}
                own = Block.read(row, dims, clusters)
                change = own.assign(centroids, offsets)
                new = own.state() | {"change": None if change is None else change.tobytes()}
                columns = [batch.column("ids").slice(i, 1), batch.column("n").slice(i, 1), batch.column("vectors").slice(i, 1)]
                columns += [pa.array([new[name]], pa.binary()) for name in _NAMES[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", *_NAMES])
            give_back()

    return blocks.select("ids", *_NAMES).mapInArrow(step, blocks.schema)


def _changes(blocks: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The changes of all blocks together: added in each task, then by place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(data.as_py(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["place", "value"])

    parts = blocks.filter("change IS NOT NULL").select("change").mapInArrow(add, "place long, value long")
    out = np.zeros(shape[0] * shape[1], np.int64)
    for place, value in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[place] = value
    return out.reshape(shape)


def _members(blocks: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` of every vector after a last assignment."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = StructType([StructField("id", kind), StructField("cluster", LongType()), StructField("distance", LongType())])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, dims = centroids.shape
        for batch in batches:
            for i in range(batch.num_rows):
                own = Block.read({name: batch.column(name)[i].as_py() for name in _NAMES}, dims, clusters)
                own.assign(centroids, offsets)
                exact = ((own.vectors - centroids[own.cluster]) ** 2).sum(1)
                columns = [batch.column("ids").slice(i, 1).flatten(), pa.array(own.cluster.astype(np.int64)), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])
            give_back()

    return blocks.select("ids", *_NAMES).mapInArrow(last, schema)


def first_centroids(rows: DataFrame, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The vectors of ``rows(id, vector)`` with the smallest hashes of seed and id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.orderBy(hashed.asc_nulls_last(), "vector").limit(clusters).collect()
    return integers(np.array([r["vector"] for r in chosen], float), scale)


def clustered(
    vectors: DataFrame,
    clusters: int = 40,
    rounds: int = 5,
    seed: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    scale: int = 256,
    block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` of every kept vector, written, and the final centroids."""
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector"), dims))
    centroids = first_centroids(rows, clusters, seed, scale)
    blocks, path = written(_blocks(rows, dims, scale, block))
    if not len(centroids):
        none = blocks.select(F.explode("ids").alias("id"), F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none, centroids
    offsets, totals = np.zeros(len(centroids)), np.zeros((len(centroids), dims + 1), np.int64)
    for _ in range(rounds):
        blocks, after = written(_round(blocks, centroids, offsets))
        remove(spark, path)
        path = after
        totals += _changes(blocks, totals.shape)
        moved = centroids.copy()
        some = totals[:, 0] > 0
        moved[some] = totals[some, 1:] // totals[some, :1]
        offsets = offsets + drift(centroids, moved)
        centroids = moved
    members, _ = written(_members(blocks, centroids, offsets))
    remove(spark, path)
    return members, centroids


def cluster_report(vectors: DataFrame, clusters: int = 40, rounds: int = 5) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    members, centroids = clustered(vectors, clusters, rounds)
    sums = {r["cluster"]: r["sum"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    total = sum(sums.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, sums.get(i, 0), total, digest(c)) for i, c in enumerate(centroids)]
    # One row a centroid.
    known = members.sparkSession.createDataFrame(rows, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(known), "cluster").select(
        F.col("id").alias("vec_id"), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
