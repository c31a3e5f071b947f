"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad, judged by its own features and those of the lines beside it. The
forward-backward marginals of "good", weighted by line length, are the document's score.

Labels are learnt from a bounded sample (``TRAIN_DOCS`` labelled ids a class with the smallest
hashes, of at most ``TRAIN_LINES`` lines each); scoring reads whole texts. Null and empty texts
are one empty line. Labels that are null or contradict each other are not used; without labels of
both classes every score is 0.5. An empty table gives an empty result; repeated rows have equal
scores; other columns are kept by ``accepted_documents``, whatever their names.
"""

from __future__ import annotations

import functools
import operator
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vakanz.llm.common import among_least, free_name, give_back, ready, staged, words_of

#: Bounds of the training sample: ids of each class, and lines of a document in it.
TRAIN_DOCS, TRAIN_LINES = 1200, 400
#: Characters whose features are computed at once.
CHUNK_CHARS = 1 << 20
ACCEPT = 0.7
FEATURES = (
    "letters", "upper", "digits", "symbols", "shouts", "bars", "word_length", "log_length",
    "repeats", "distinct", "ends", "seen",
)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Bits of each character: letter 1, upper 2, digit 4, other than blank or prose mark 8, ! 16, | 32."""
    bits = np.full(0x110000, 8, np.uint8)
    for point in range(0x10000):
        kind = unicodedata.category(chr(point))
        if kind[0] in "LM":
            bits[point] = 1 | 2 * (kind == "Lu")
        elif kind[0] == "N":
            bits[point] = 4
        elif kind[0] in "ZC" or chr(point) in ".,;:?'\"()-–—«»¿¡„“”‘’…":
            bits[point] = 0
    bits[0x20000:0x33480] = 1
    bits[ord("!")], bits[ord("|")] = 16, 32
    return bits


def line_features(lines: list[str], first: list[bool]) -> np.ndarray:
    """One row of ``FEATURES`` a line; ``first`` marks lines not seen before in their document."""
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    low = 0
    while low < len(lines):
        high, chars = low, 0
        while high < len(lines) and (high == low or chars + len(lines[high]) < CHUNK_CHARS):
            chars += len(lines[high])
            high += 1
        _chunk_features(lines[low:high], out[low:high])
        low = high
    out[:, 11] = ~np.array(first, bool)
    return out


def _chunk_features(lines: list[str], out: np.ndarray) -> None:
    text = "\n".join([*lines, ""])
    bits = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.array([len(x) for x in lines]) + 1
    starts = np.cumsum(sizes) - sizes
    count = lambda bit: np.add.reduceat((bits & bit) != 0, starts, dtype=np.int64)
    letters, length = count(1), np.maximum(sizes - 1, 1)
    out[:, 0] = letters / length
    out[:, 1] = count(2) / np.maximum(letters, 1)
    out[:, 2] = count(4) / length
    out[:, 3] = count(8) / length
    out[:, 4] = count(16) / length
    out[:, 5] = count(32) / length
    out[:, 7] = np.log1p(length) / 8
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            out[i, 6] = length[i] / n / 10
            out[i, 8] = sum(map(operator.eq, words, words[1:])) / n
            out[i, 9] = len(set(words)) / n
            out[i, 10] = line.rstrip()[-1:] in ".?!:"


def document_lines(texts: list[str]) -> tuple[list[str], list[bool], np.ndarray]:
    """All lines, whether each is the first of its kind in its document, and lines a document."""
    lines, first, sizes = [], [], []
    for text in texts:
        own, seen = text.split("\n"), set()
        for line in own:
            first.append(line not in seen)
            seen.add(line)
        lines += own
        sizes.append(len(own))
    return lines, first, np.array(sizes, np.int64)


def with_neighbours(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A constant, the line's features, those of the lines before and after, and the two ends."""
    n, k = own.shape
    ends = np.cumsum(sizes)
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    opens[(ends - sizes)[sizes > 0]], closes[ends[sizes > 0] - 1] = True, True
    out = np.zeros((n, 3 * k + 3), np.float32)
    out[:, 0], out[:, 1 : k + 1] = 1, own
    out[1:, k + 1 : 2 * k + 1] = own[:-1] * ~opens[1:, None]
    out[:-1, 2 * k + 1 : 3 * k + 1] = own[1:] * ~closes[:-1, None]
    out[:, 3 * k + 1], out[:, 3 * k + 2] = opens, closes
    return out


@dataclass
class Chain:
    """Weights: ``unary`` for good against bad after scaling, ``links`` from label to label."""

    mean: np.ndarray
    scale: np.ndarray
    unary: np.ndarray
    links: np.ndarray

    def evidence(self, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return with_neighbours((own - self.mean) / self.scale, sizes) @ self.unary

    def scores(self, texts: list[str]) -> np.ndarray:
        lines, first, sizes = document_lines(texts)
        good, _ = marginals(self.evidence(line_features(lines, first), sizes), sizes, self.links)
        weight = np.array([max(1, len(x)) for x in lines], float)
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def marginals(evidence: np.ndarray, sizes: np.ndarray, links: np.ndarray):
    """Forward-backward over all documents at once: P(good) a line, expected link counts."""
    order = np.argsort(-sizes, kind="stable")
    begins, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    emit = np.ones((len(evidence), 2))
    emit[:, 1] = np.exp(np.clip(evidence, -30, 30))
    move, forward, expected = np.exp(links), np.empty_like(emit), np.zeros((2, 2))
    last = None
    for t, n in enumerate(active):
        at = begins[:n] + t
        now = emit[at] if last is None else (last[:n] @ move) * emit[at]
        last = forward[at] = now / now.sum(1, keepdims=True)
    backward = np.ones_like(emit)
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        at = begins[:n] + t
        ahead = emit[at + 1] * backward[at + 1]
        back = ahead @ move.T
        both = forward[at][:, :, None] * move * ahead[:, None, :]
        expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        backward[at] = back / back.sum(1, keepdims=True)
    joint = forward * backward
    return joint[:, 1] / joint.sum(1), expected


def fit(own: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> Chain | None:
    """Maximum likelihood of the labels, each document's label standing for its lines."""
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    mean, scale = own.mean(0), own.std(0) + 1e-3
    x = with_neighbours((own - mean) / scale, sizes).astype(float)
    y = np.repeat(labels, sizes).astype(float)
    chain = Chain(mean, scale, np.zeros(x.shape[1]), np.zeros((2, 2)))
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (sizes[labels == label] - 1).sum()
    total = len(y)
    params = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        good, expected = marginals(x @ params[:-4], sizes, params[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (good - y), (expected - seen).ravel()]) / total + ridge * params
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        params = params - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    chain.unary, chain.links = params[:-4], params[-4:].reshape(2, 2)
    return chain


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Chain | None:
    """A chain fitted on the driver to the features of the bounded sample."""
    ready(docs.sparkSession)
    usable = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .filter("label = other")
    )
    usable = staged(usable.select("doc_id", "label"))
    hashed = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        own = usable.filter(F.col("label") == label)
        own = own.filter(among_least(hashed, own.count(), train_docs))
        part = own.orderBy(hashed, "doc_id").limit(train_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    # A repeated id counts once: the sample stays bounded.
    texts = (
        docs.select("doc_id", words_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    )

    def features(batches):
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text.count("\n") < train_lines:
                    lines, first, sizes = document_lines([text])
                    row = line_features(lines, first).tobytes()
                    yield pa.RecordBatch.from_pydict({"label": pa.array([label], pa.int32()), "own": pa.array([row], pa.binary())})

    rows = texts.select("label", "text").mapInArrow(features, "label int, own binary").collect()
    if not rows:
        return None
    own = [np.frombuffer(r["own"], np.float32).reshape(-1, len(FEATURES)) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["label"], rows[i]["own"]))
    own, label = [own[i] for i in order], np.array([rows[i]["label"] for i in order])
    return fit(np.concatenate(own), np.array([len(x) for x in own]), label)


def with_score(docs: DataFrame, chain: Chain | None, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    if chain is None:
        return docs.withColumn(into, F.lit(0.5))
    ready(docs.sparkSession)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        give_back()
        out, low, sizes = [], 0, pc.binary_length(texts).to_pylist()
        while low < len(sizes):  # some texts at once, so memory is bounded by CHUNK_CHARS or one text
            high, chars = low, 0
            while high < len(sizes) and (high == low or chars + sizes[high] < CHUNK_CHARS):
                chars += sizes[high]
                high += 1
            out.append(chain.scores(texts[low:high].to_pylist()))
            low = high
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return docs.withColumn(into, score(words_of(text_col)))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    rows = docs.select("doc_id", "text")
    scored = with_score(rows, train(docs, labels)).select("doc_id", "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"),
    )


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``ACCEPT``, with their columns."""
    name = free_name(docs, "score")
    return with_score(docs, train(docs, labels), into=name).filter(F.col(name) >= ACCEPT).select(*docs.columns)
