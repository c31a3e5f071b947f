"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is a sequence of words (``\\w+`` in lower case). The similarity of two texts is the length of
the longest common subsequence of their words over the number of words in either (an ordered
Jaccard similarity, which sinks with each edit); two texts are linked from ``SIMILAR`` on. Classes
are the connected components of the links.

Candidates share a sketch. Each of ``SKETCHES`` hash functions takes the ``MINIMA`` least
occurrence-labelled runs of five words and keeps them in text order, so a sketch agrees for texts
that share such runs in the same order. Few words give few different sketches, so texts of fewer
than ``EXACT`` words are found by prefix filter instead: labelled words are put in one order, rare
ones first, and two similar texts always share one of the first few of each. Only texts long enough
to have a similar text of ``EXACT`` words or more have sketches.

Texts of equal words are one node. The nodes of a bucket (equal sketch value) are compared with
the bucket's centre, the node with most company over all buckets; nodes under one centre that are
not yet of one component are compared with each other, in blocks of bounded size, without
writing pairs out. So all candidates are judged and no link between them is lost.

Null and empty texts, and texts without words, are alone in their class. Repeated rows are copies.
Null ids are the last to represent a class. An empty table gives an empty result. Extra columns are
kept by ``kept_documents`` and not looked at.
"""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import counted_broadcast, free_name, give_back, held, ready, staged, without_keys, words_of
from vakanz.llm.components import roots
from vakanz.llm.vocab import Memory

WORD = re.compile(r"\w+")
SHINGLE, SKETCHES, MINIMA = 5, 32, 3
SIMILAR = 0.8
#: Texts of fewer words are candidates by prefix filter, which misses none of their pairs.
EXACT = 40
#: Counters that tell rare words of such texts from common ones; a power of two.
COUNTERS = 1 << 16
#: Nodes of a block, two of which meet in a task.
BLOCK = 256
#: Shingles hashed at once, and columns of a block's incidence matrix at once.
SPAN, COLUMNS = 1 << 15, 4096
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(5).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _code(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))


def word_codes(text: str) -> np.ndarray:
    """A 32-bit code for each word."""
    words = WORD.findall(text.lower())
    codes = held("word codes", lambda: Memory(_code))
    return np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))


def shingles(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of five words."""
    width = min(SHINGLE, len(codes))
    if not width:
        return np.empty(0, np.uint64)
    n = len(codes) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _PRIME + codes[i : i + n]
    return _mix(out)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes that tell the first, second and further occurrences of a shingle apart."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return _mix(hashes)
    place = np.arange(len(hashes))
    times = np.empty(len(hashes), np.uint64)
    times[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return _mix(hashes + times * _PRIME)


def sketch(marks: np.ndarray) -> np.ndarray:
    """The order-keeping sketches of a text's labelled shingles."""
    n = len(marks)
    take = min(MINIMA, n)
    bound = np.uint64(min(2**64 - 1, int(2**64 * 4 * MINIMA / n)))
    rows, places, values = [], [], []
    for low in range(0, n, SPAN):
        hashed = marks[None, low : low + SPAN] * _FACTORS[:, None]
        row, place = np.nonzero(hashed <= bound)
        rows.append(row)
        places.append(place + low)
        values.append(hashed[row, place])
    row, place, value = np.concatenate(rows), np.concatenate(places), np.concatenate(values)
    short = np.flatnonzero(np.bincount(row, minlength=SKETCHES) < take)
    if len(short):  # too few below the bound: all of the row's hashes
        keep = ~np.isin(row, short)
        full = marks[None, :] * _FACTORS[short][:, None]
        row = np.concatenate([row[keep], np.repeat(short, n)])
        place = np.concatenate([place[keep], np.tile(np.arange(n), len(short))])
        value = np.concatenate([value[keep], full.ravel()])
    order = np.lexsort((place, value, row))
    starts = np.searchsorted(row[order], np.arange(SKETCHES))
    least = np.sort(place[order][starts[:, None] + np.arange(take)], axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64) + np.uint64(take)
    for i in range(take):
        out = _mix(out * _PRIME + marks[least[:, i]])
    return out.view(np.int64)


def prefix(marks: np.ndarray, counts: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """Bucket values of a text's rarest labelled words, enough to meet every similar text.

    Of n shingles a similar text shares ``similar * n`` or more, so in any order that holds for all
    texts the first ones of both, as many as may be missing and one more, have one in common.
    """
    n = len(marks)
    if n < similar * (n + 1) - 1e-6:  # so short that only equal texts are similar
        return np.empty(0, np.int64)
    order = np.lexsort((marks, counts[marks & np.uint64(COUNTERS - 1)]))
    return _mix(marks[order[: n - ceil(similar * n - 1e-6) + 1]] + _PRIME).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """The ordered similarity of two word sequences if it is ``least`` or more, else 0."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = least * (n + m) / (1 + least) - 1e-9
    if min(n, m) < need:
        return 0.0
    marks_a, marks_b = labelled(a.astype(np.uint64)), labelled(b.astype(np.uint64))
    _, in_a, in_b = np.intersect1d(marks_a, marks_b, assume_unique=True, return_indices=True)
    common = len(in_a)
    if common < need:  # common words in any order bound the common subsequence
        return 0.0
    if np.any(np.diff(in_b[np.argsort(in_a)]) < 0):
        common = _aligned(a, b, int(n + m - 2 * need))
    return common / (n + m - common) if common >= need else 0.0


def _aligned(a: np.ndarray, b: np.ndarray, edits: int) -> int:
    """Longest common subsequence within a band of ``edits`` around the diagonal, a row of bits at a time.

    An alignment with that many insertions and deletions at most never leaves the band. A set bit of
    ``steps`` says that the subsequence grows by one at this place of ``b``; places that the band has
    passed are counted and dropped, so numbers have as many bits as the band is wide.
    """
    same = min(len(a), len(b))
    front = int(np.argmin(np.append(a[:same] == b[:same], False)))
    a, b = a[front:], b[front:]
    same = min(len(a), len(b))
    back = int(np.argmin(np.append(a[::-1][:same] == b[::-1][:same], False)))
    first, second = a[: len(a) - back].tolist(), b[: len(b) - back].tolist()
    common, steps, low, entered = front + back, 0, 0, 0
    places: dict[int, tuple[int, int]] = {}  # of each word: where its bits begin, and its places in the band

    def within(word: int) -> int:
        begin, bits = places.get(word, (low, 0))
        return bits >> (low - begin)

    for i, word in enumerate(first):
        while low < i - edits and low < len(second):
            common += steps & 1
            steps >>= 1
            low += 1
        while entered < min(len(second), i + edits + 1):
            other = second[entered]
            places[other] = low, within(other) | 1 << (entered - low)
            entered += 1
        bits = within(word)
        if bits:
            places[word] = low, bits
            full = (1 << (entered - low)) - 1
            flat = full ^ steps
            met = flat & bits
            steps = full & ~((flat + met) | (flat - met))
    return common + steps.bit_count()


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def sketched(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR
) -> DataFrame:
    """``row, id, text_hash, content, sketch, marks``, written; null content without words.

    ``marks`` are the labelled words of texts of fewer than ``EXACT``; texts whose similar texts
    are all so short have an empty ``sketch``.
    """
    ready(docs.sparkSession)

    @F.arrow_udf("content binary, sketch array<bigint>, marks array<bigint>")
    def describe(texts: pa.Array) -> pa.Array:
        give_back()
        content, sketches, short = [], [], []
        none = np.empty(0, np.int64)
        for text in texts:
            codes = word_codes(text.as_py())
            n = len(codes)
            content.append(xxhash.xxh3_128_digest(codes.tobytes()) if n else None)
            sketches.append(sketch(labelled(shingles(codes))).ravel() if n and n >= similar * EXACT - 1e-6 else none)
            short.append(labelled(codes.astype(np.uint64)).view(np.int64) if n < EXACT else none)
        return pa.StructArray.from_arrays([pa.array(content, pa.binary()), _lists(sketches), _lists(short)], ["content", "sketch", "marks"])

    rows = docs.select(docs[id_col].alias("id"), words_of(docs[text_col]).alias("text"))
    found = rows.select("id", F.xxhash64("text").alias("text_hash"), describe("text").alias("d"))
    return staged(found.select(F.monotonically_increasing_id().alias("row"), "id", "text_hash", "d.*"))


def _prefixes(rows: DataFrame, similar: float) -> Column:
    """``prefix`` of the marks of ``rows``, by counts of all marks in ``COUNTERS`` counters."""
    counter = F.col("mark").bitwiseAND(F.lit(COUNTERS - 1)).alias("counter")
    counts = np.zeros(COUNTERS, np.int64)
    for at, count in rows.select(F.explode("marks").alias("mark")).groupBy(counter).count().collect():
        counts[at] = count
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    @F.arrow_udf("array<bigint>")
    def rarest(marks: pa.Array) -> pa.Array:
        give_back()
        counts = shared.value
        flat = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        ends = np.cumsum([0, *marks.value_lengths().to_pylist()])
        return _lists([prefix(flat[a:b], counts, similar) for a, b in zip(ends, ends[1:], strict=False)])

    return rarest("marks")


def _sequences(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``node, codes`` of the nodes in ``wanted(node, text_hash, content)``, written."""

    @F.arrow_udf("content binary, codes binary")
    def read(texts: pa.Array) -> pa.Array:
        give_back()
        codes = [word_codes(t.as_py()).tobytes() for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([xxhash.xxh3_128_digest(c) for c in codes], pa.binary()), pa.array(codes, pa.binary())], ["content", "codes"]
        )

    texts = docs.select(words_of(docs[text_col]).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(counted_broadcast(wanted.select("text_hash")), "text_hash", "left_semi")
    found = texts.select(read("text").alias("d")).select("d.*").groupBy("content").agg(F.first("codes").alias("codes"))
    return staged(found.join(wanted, "content").select("node", "codes"))


def _codes_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint32)


def _verified(pairs: DataFrame, sequences: DataFrame, similar: float) -> DataFrame:
    """``pairs(a, b)`` that are similar enough, by alignment."""

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        give_back()
        return pa.array([similarity(_codes_of(x.as_py()), _codes_of(y.as_py()), similar) > 0 for x, y in zip(left, right, strict=True)], pa.bool_())

    left = sequences.select(F.col("node").alias("a"), F.col("codes").alias("left"))
    right = sequences.select(F.col("node").alias("b"), F.col("codes").alias("right"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", linked("left", "right").alias("linked")).filter("linked").select("a", "b")


class _Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x


def _block_links(rows: list[tuple], cross: bool, similar: float) -> list[tuple[int, int]]:
    """Links between nodes of different components among ``rows`` of ``side, node, root, codes``.

    Counts of common labelled words, from products of incidence matrices, bound the similarity;
    what passes is aligned. A link between components makes them one, so few links are returned.
    """
    seqs = [_codes_of(r[3]) for r in rows]
    sizes = np.array([len(s) for s in seqs])
    marks = np.concatenate([labelled(s.astype(np.uint64)) for s in seqs])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, times = np.unique(marks, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    sides = np.array([r[0] for r in rows])
    first = np.flatnonzero(sides == 0) if cross else np.arange(len(rows))
    second = np.flatnonzero(sides == 1) if cross else first
    common = np.zeros((len(first), len(second)), np.float32)
    for low in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        matrix = np.zeros((len(rows), COLUMNS), np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        common += matrix[first] @ matrix[second].T
    need = similar / (1 + similar) * (sizes[first][:, None] + sizes[second][None, :]) - 1e-6
    union, links = _Union(), []
    for x, y in zip(*np.nonzero(common >= need), strict=True):
        i, j = int(first[x]), int(second[y])
        if not cross and i >= j:
            continue
        a, b = union.find(rows[i][2]), union.find(rows[j][2])
        if a != b and similarity(seqs[i], seqs[j], similar) > 0:
            union[max(a, b)] = min(a, b)
            links.append((rows[i][1], rows[j][1]))
    return links


def _rest(stars: DataFrame, label: DataFrame, sequences: DataFrame, similar: float) -> DataFrame:
    """Links among the nodes under one centre (``stars(centre, node)``) whose components differ."""
    rooted = stars.join(label, "node", "left").select("centre", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("centre").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
    mixed = mixed.filter("x <> y").select("centre", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rooted.join(mixed, "centre").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = other.select(
        "centre", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "node", "root",
    ).join(sequences, "node")

    def search(batches):
        key, rows = None, []
        for batch in batches:
            columns = [batch[c] for c in ("centre", "i", "j", "side", "node", "root", "codes")]
            for centre, i, j, *row in zip(*[(x.as_py() for x in c) for c in columns], strict=True):
                if key != (centre, i, j):
                    yield from judged(key, rows)
                    key, rows = (centre, i, j), []
                rows.append(tuple(row))
        yield from judged(key, rows)

    def judged(key, rows):
        if len({r[2] for r in rows}) > 1:
            links = _block_links(rows, key[1] != key[2], similar)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    together = tasks.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "node")
    return together.mapInArrow(search, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    """``row, id, text_hash, root, rep (id, row), members`` for every row."""
    rows = sketched(docs, id_col, text_col, similar)
    copies = staged(rows.filter("content is not null").groupBy("content").agg(F.min("row").alias("node")))
    bands = rows.join(copies.select(F.col("node").alias("row")), "row", "left_semi").select(
        F.col("row").alias("node"), F.explode(F.concat("sketch", _prefixes(rows, similar))).alias("value")
    )
    shared = bands.groupBy("value").agg(F.count("*").alias("company")).filter("company > 1")
    members = staged(bands.join(shared, "value"))
    weight = members.groupBy("node").agg(F.sum("company").alias("weight"))
    centres = members.join(weight, "node").groupBy("value").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("best")
    )
    stars = staged(
        members.join(centres, "value")
        .select((-F.col("best.node")).alias("centre"), "node").filter("centre <> node").distinct()
    )
    nodes = stars.select(F.explode(F.array("centre", "node")).alias("node")).distinct()
    wanted = staged(nodes.join(rows.select(F.col("row").alias("node"), "text_hash", "content"), "node"))
    sequences = _sequences(docs, wanted, text_col)
    links = staged(_verified(stars.select(F.col("centre").alias("a"), F.col("node").alias("b")), sequences, similar))
    label = roots(links)
    more = staged(_rest(stars, label, sequences, similar))
    if not more.isEmpty():
        label = roots(links.unionByName(more))
    rooted = copies.join(label, "node", "left").select("content", F.coalesce("root", "node").alias("root"))
    placed = staged(rows.select("row", "id", "text_hash", "content").join(rooted, "content", "left").select(
        "row", "id", "text_hash", F.coalesce("root", "row").alias("root")
    ))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("rep")
    groups = placed.groupBy("root").agg(F.count("*").alias("members"), least)
    return placed.join(groups, "root")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR
) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every row; the class id is its least doc_id."""
    return _classes(docs, id_col, text_col, similar).select(
        F.col("id").alias("doc_id"), F.col("rep.id").alias("class_id"), F.col("members").alias("class_size"),
        (F.col("rep.row") == F.col("row")).alias("kept"),
    )


def kept_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR
) -> DataFrame:
    """One row of ``docs`` of each class, that of the least id, with its columns.

    The keys of rows that go are joined, not those that stay: they are few, and broadcast if counted so.
    """
    found = _classes(docs, id_col, text_col, similar)
    keys = (
        found.groupBy("id", "text_hash")
        .agg(F.count("*").alias("rows"), F.max(F.col("rep.row") == F.col("row")).alias("stays"))
        .filter("NOT stays OR rows > 1").select(F.col("id").alias("key_id"), F.col("text_hash").alias("key_hash"), "stays")
    )
    name = free_name(docs, "text_hash")
    marked = docs.withColumn(name, F.xxhash64(words_of(text_col)))
    same = lambda keys: marked[id_col].eqNullSafe(keys["key_id"]) & (marked[name] == keys["key_hash"])
    return without_keys(marked, staged(keys), same, [id_col, name]).select(*docs.columns)
