"""Toxicity: a convolutional text classifier over hashed word embeddings, with thresholds by language.

A word (``\\w+`` in lower case) is the sum of the embeddings of its hashed features: the word itself,
its first letters and its last ones, so inflected and unseen words share what they begin or end
with. Filters of several widths slide over the words of a whole text, each keeps its largest value
(max pooling over the text), and a logistic layer weighs these. All of it is trained: every label
that may be learnt takes part, three texts in four in the fit, the others in the thresholds, and no
text is cut. Spark counts the texts of each class that have a feature, and those seen in fewer than
``LEAST_DOCS`` have no embedding. The texts of the fit are dealt to ``BATCHES`` by their ids; a step
is the gradient of a batch, summed by Spark over tasks that compute it in numpy, and the driver holds
the network and one such sum. Sums are of whole numbers, so that how rows are dealt to tasks changes
nothing.

Thresholds are calibrated on learnt labels that took no part in the fit, for each language with
enough of them, else over all languages, in counts by ``GRID`` of what the network gives. The language
is read from the text's own function words. A score is the logistic function of what exceeds the
threshold: 0.5 stands at it.

Texts are learnt and scored whole, some thousand words at a time; short texts are hashed together,
with the same results. Null and empty texts, and texts without words, have the score of no word at
all. Of the texts of a repeated id the least one is learnt, once. Labels that are null or contradict
each other are not used; without labels of both classes every score is 0. An empty table gives an
empty result; repeated rows have equal scores; other columns are kept by ``with_toxicity``, which
refuses a name that is taken.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vakanz.llm.common import counted_broadcast, give_back, ready, refuse_taken, remove, staged, words_of, written
from vakanz.runtime import stage_folder

LEAST_DOCS = 3
BUCKETS = 1 << 20
DIMS, WIDTHS, FILTERS = 12, (1, 2, 3), 8
#: Passes over the texts of the fit, and batches that they are dealt to.
ROUNDS, BATCHES, RATE = 3, 12, 0.02
#: Gradients are summed as whole numbers of this unit.
UNIT = 2.0**-32
#: Thresholds are found in steps of this size, up to ``FAR`` on both sides of zero.
GRID, FAR = 2.0**-10, 64.0
#: The texts that the thresholds are found with, in place of a batch.
ASIDE = -1
#: Learnt labels of each class that a language needs for a threshold of its own.
CALIBRATED = 20
#: Characters hashed and words scored at once.
SPAN, WORDS = 1 << 16, 1 << 13
#: Slopes of rows of embeddings that a task holds before it sums them.
HELD_SLOPES = 1 << 18
TOXIC = 0.5
#: Letters of the beginnings of a word that are features.
HEADS = (4, 5, 6)

# Frequent function words, by which a text's language is told.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit von zu auf für ein eine den sich",
    "en": "the and of to in is that it for with was on are by this",
    "es": "el los las y es por para con una en del se al que de",
    "fr": "le les et est des pour dans une du au qui que sur de la",
    "it": "il di che per con una del gli non sono della è",
    "nl": "de het een van en niet met voor op dat zijn",
    "pt": "o os as e do da em para com uma não que",
}
LANGUAGES = tuple(FUNCTION_WORDS)


@functools.lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    """Whether each code point belongs to words; all beyond the first plane do."""
    out = np.ones(0x110000, bool)
    out[:0x10000] = [chr(p).isalnum() or p == 95 for p in range(0x10000)]
    return out


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    number = 0x9E3779B97F4A7C15
    powers, inverse = np.full(SPAN + 1, number, np.uint64), np.full(SPAN + 1, pow(number, -1, 2**64), np.uint64)
    powers[0] = inverse[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def buckets(text: str) -> np.ndarray:
    """Hash buckets of the features of the words of a text, one row a word: the word and its beginnings.

    A feature that a word is too short for is bucket 0, which no feature has.
    """
    return _buckets([text.lower()])[0]


def _buckets(lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ``buckets`` of texts in lower case, one text after another, and the rows before the end of each."""
    points = np.frombuffer(" ".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _word_points().take(points)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros((len(starts), 1 + len(HEADS)), np.int32)
    low, (powers, inverse) = 0, _powers()
    while low < len(starts):
        # Words of at most SPAN characters together, or the first SPAN of one longer word.
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + SPAN, side="right")))
        first, last = int(starts[low]), min(int(ends[high - 1]), int(starts[low]) + SPAN)
        part = (points[first:last] + np.uint64(1)) * powers[: last - first]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        at, to = starts[low:high] - first, np.minimum(ends[low:high] - first, len(part))
        before, unit = sums.take(at), inverse.take(at)
        for column, letters in enumerate((0, *HEADS)):
            # Only words that are longer than the beginning have it.
            which = np.flatnonzero(to - at > letters)
            value = (sums.take((at + letters if letters else to)[which]) - before[which]) * unit[which] + np.uint64(letters)
            value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out[low + which, column] = (value >> np.uint64(40)).astype(np.uint32) % np.uint32(BUCKETS - 1) + np.uint32(1)
        low = high
    return out, np.searchsorted(starts, np.cumsum([len(text) + 1 for text in lowered]))


def each(texts: Iterable[str], make: Callable[[np.ndarray], list[np.ndarray]] = lambda found: [found]) -> Iterator[list[np.ndarray]]:
    """For each text what ``make`` gives of its ``buckets``: arrays with a row a word, which depends on that word alone.

    Texts of some ``SPAN`` characters, or one longer text, are worked on together.
    """

    def made(lowered: list[str]) -> Iterator[list[np.ndarray]]:
        found, ends = _buckets(lowered)
        arrays, low = make(found), 0
        del found
        for high in ends.tolist():
            yield [array[low:high] for array in arrays]
            low = high

    waiting, size = [], 0
    for text in texts:
        waiting.append(text.lower())
        size += len(text)
        if size >= SPAN:
            yield from made(waiting)
            waiting, size = [], 0
    if waiting:
        yield from made(waiting)


@functools.lru_cache(maxsize=1)
def _speakers() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each bucket, and which languages use words of each kind; the last kind is no function word."""
    found: dict[int, set[int]] = {}
    for number, own in enumerate(FUNCTION_WORDS.values()):
        for bucket in buckets(own)[:, 0].tolist():
            found.setdefault(bucket, set()).add(number)
    kinds = sorted(map(sorted, found.values()))
    out = np.full(BUCKETS, len(kinds), np.int16)
    for bucket, languages in found.items():
        out[bucket] = kinds.index(sorted(languages))
    marks = np.zeros((len(kinds) + 1, len(LANGUAGES)), np.int64)
    for i, languages in enumerate(kinds):
        marks[i, languages] = 1
    return out, marks


def language_of(kinds: np.ndarray) -> int:
    """The language of most function words, or -1 without any; ``kinds`` are those of a text's words."""
    marks = _speakers()[1]
    votes = np.bincount(kinds, minlength=len(marks)) @ marks
    return int(votes.argmax()) if votes.any() else -1


@dataclass
class Network:
    """``rows`` numbers the buckets with an embedding; row 0 is that of all others and stays zero."""

    rows: np.ndarray
    embeddings: np.ndarray
    filters: list[np.ndarray]  # of each width: width x DIMS x FILTERS
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def projection(self) -> np.ndarray:
        """What a word's embedding adds to each place of each filter, side by side."""
        return np.concatenate([f.transpose(1, 0, 2).reshape(DIMS, -1) for f in self.filters], axis=1)

    def narrow(self) -> Network:
        """The network in single precision, without its thresholds."""
        short = lambda x: x.astype(np.float32)
        return Network(self.rows, short(self.embeddings), [*map(short, self.filters)], [*map(short, self.biases)], short(self.weights), self.bias)


def summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the ``table`` rows of each word's features."""
    out = table.take(rows[:, 0], axis=0)
    for column in range(1, rows.shape[1]):
        out += table.take(rows[:, column], axis=0)
    return out


def activations(
    parts: np.ndarray, filters: int, biases: list[np.ndarray], widths=WIDTHS, out: np.ndarray | None = None
) -> list[np.ndarray]:
    """Values of each width's filters at each place; ``parts`` are projected words, beyond them is nothing.

    ``out`` takes the values, a row a filter.
    """
    if out is None:
        out = np.empty((len(widths) * filters, len(parts)), parts.dtype)
    # The places of a filter lie side by side.
    parts, low = np.ascontiguousarray(parts.T), 0
    values = np.split(out, len(widths))
    for value, width, bias in zip(values, widths, biases, strict=True):
        np.add(parts[low : low + filters], bias[:, None], out=value)
        for i in range(1, width):
            at = low + i * filters
            value[:, :-i] += parts[at : at + filters, i:]
        low += width * filters
    return [value.T for value in values]


def pooled(network: Network, projection: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each filter over a text, 0 at least, and the word where it begins; ``found`` has a row a word."""
    best = np.zeros(len(WIDTHS) * FILTERS, projection.dtype)
    places = np.zeros(len(best), np.int64)
    reach, each_filter = WIDTHS[-1] - 1, np.arange(len(best))
    for low in range(0, len(found), WORDS):
        # With the next span's first words, so that every window is whole in one of them.
        rows = found[low : low + WORDS + reach]
        values = np.empty((len(best), len(rows)), projection.dtype)
        activations(summed(network.embeddings, rows) @ projection, FILTERS, network.biases, out=values)
        here = WORDS if low + WORDS < len(found) else len(rows)
        at = values[:, :here].argmax(1)
        own = values[each_filter, at]
        higher = own > best
        best[higher], places[higher] = own[higher], low + at[higher]
    return best, places


class Scorer:
    """A network with the projection of its filters made once."""

    def __init__(self, network: Network):
        self.network, self.narrow = network, network.narrow()
        self.projection = self.narrow.projection()

    def _made(self, found: np.ndarray) -> list[np.ndarray]:
        return [self.network.rows.take(found), _speakers()[0].take(found[:, 0])]

    def logits(self, texts: Iterable[str]) -> Iterator[tuple[float, int]]:
        """What the network gives for each text, and its language or -1."""
        for rows, kinds in each(texts, self._made):
            best, _ = pooled(self.narrow, self.projection, rows)
            yield float((best * self.network.weights).sum()) + self.network.bias, language_of(kinds)

    def logit(self, text: str) -> tuple[float, int]:
        return next(self.logits([text]))

    def scores(self, texts: Iterable[str]) -> Iterator[float]:
        known = self.network.thresholds
        for logit, language in self.logits(texts):
            yield float(1 / (1 + np.exp(-np.clip(logit - known.get(language, known[-1]), -30, 30))))


def started(kept: np.ndarray, counts: np.ndarray, totals: np.ndarray, seed: int = 13) -> Network:
    """A network that knows what counting alone says.

    ``counts`` are the clean and toxic texts that have each of the ``kept`` buckets, ``totals`` those of each class.
    """
    rng = np.random.default_rng(seed)
    rows = np.zeros(BUCKETS, np.int32)
    rows[kept] = np.arange(1, len(kept) + 1)
    # Smoothed log odds of toxic texts.
    odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
    embeddings = rng.normal(0, 0.05, (1 + len(kept), DIMS))
    # The first component starts as the odds, and one filter reads it.
    embeddings[1:, 0] = odds / 2
    embeddings[0] = 0
    filters = [rng.normal(0, 0.2, (w, DIMS, FILTERS)) for w in WIDTHS]
    for own in filters:
        own[:, 0, 0] = 1 / len(own)
    weights = np.abs(rng.normal(0, 0.1, len(WIDTHS) * FILTERS))
    weights[::FILTERS] = 0.5
    return Network(rows, embeddings, filters, [np.zeros(FILTERS) for _ in WIDTHS], weights)


def descend(network: Network, slopes_of: Callable[[Network, int], list[np.ndarray] | None], rounds: int = ROUNDS) -> None:
    """Adam over all batches, ``rounds`` times; ``slopes_of`` gives the gradient of a batch, or None if it is empty."""
    bias = np.array([network.bias])
    state = [network.embeddings, *network.filters, *network.biases, network.weights, bias]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    step = 0
    for batch in [*range(BATCHES)] * rounds:
        slopes = slopes_of(network, batch)
        if slopes is None:
            continue
        step += 1
        for i, slope in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope**2
            state[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        state[0][0] = 0
        network.bias = float(bias[0])


def importance(totals: np.ndarray) -> np.ndarray:
    """The weight of a text of each class: both classes weigh the same."""
    return 0.5 * totals.sum() / totals


def fit(texts: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS) -> Network:
    """A network of a few texts, given as ``buckets``, without Spark; texts are dealt to batches by their places."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for found, label in zip(texts, labels.tolist(), strict=True):
        counts[label, np.unique(found)] += 1
    counts[:, 0] = 0
    totals, kept = np.bincount(labels, minlength=2), np.flatnonzero(counts.sum(0) >= LEAST_DOCS)
    network = started(kept, counts[:, kept], totals)
    coded = [network.rows[found] for found in texts]

    def slopes_of(network: Network, batch: int) -> list[np.ndarray] | None:
        at = [i for i in range(batch, len(coded), BATCHES) if len(coded[i])]
        return _slopes(network, [coded[i] for i in at], labels[at], importance(totals)[labels[at]], network.bias) if at else None

    descend(network, slopes_of, rounds)
    return network


#: Each column of a projection: its filter, and its place in the filter's window.
_FILTER = np.concatenate([k * FILTERS + np.arange(FILTERS) for k, width in enumerate(WIDTHS) for _ in range(width)])
_PLACE = np.concatenate([np.full(FILTERS, j) for width in WIDTHS for j in range(width)])


def _own_slopes(
    network: Network, projection: np.ndarray, own: np.ndarray, label: int, weight: float, bias: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of one text's loss: rows of embeddings, which may repeat, their slopes, and those of ``_dense`` parts."""
    best, places = pooled(network, projection, own)
    active = best > 0
    off = (1 / (1 + np.exp(-np.clip((best * network.weights).sum() + bias, -30, 30))) - label) * weight
    back = off * network.weights * active
    words_at = places[_FILTER] + _PLACE
    which = np.flatnonzero((back[_FILTER] != 0) & (words_at < len(own)))
    rows, amount = own[words_at[which]], back[_FILTER[which], None]
    to_filters = np.zeros(projection.T.shape, projection.dtype)
    to_filters[which] = summed(network.embeddings, rows) * amount
    numbers, vectors = rows.ravel(), np.repeat(amount * projection.T[which], rows.shape[1], axis=0)
    dense = np.concatenate([to_filters.reshape(-1, FILTERS, DIMS).transpose(0, 2, 1).ravel(), back, off * best, [off]])
    return numbers[numbers > 0], vectors[numbers > 0], dense


def _parts(network: Network, dense: np.ndarray) -> list[np.ndarray]:
    """The slopes of filters, biases, weights and bias, shaped like them."""
    shapes = [x.shape for x in (*network.filters, *network.biases, network.weights)] + [(1,)]
    cuts = np.cumsum([int(np.prod(shape)) for shape in shapes])[:-1]
    return [part.reshape(shape) for part, shape in zip(np.split(dense, cuts), shapes, strict=True)]


def _slopes(network: Network, batch: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, bias: float) -> list[np.ndarray]:
    """The gradient of the mean loss: of embeddings, filters, biases, weights and bias."""
    projection, to_embeddings, total = network.projection(), np.zeros_like(network.embeddings), 0.0
    for own, label, weight in zip(batch, labels.tolist(), importance.tolist(), strict=True):
        numbers, vectors, dense = _own_slopes(network, projection, own, label, weight, bias)
        np.add.at(to_embeddings, numbers, vectors)
        total = total + dense
    return [x / len(batch) for x in (to_embeddings, *_parts(network, total))]


def threshold(places: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best mean of both classes' accuracy.

    ``clean`` and ``toxic`` texts are counted by ``places`` on the grid, in ascending order.
    """
    below = np.concatenate([[0], np.cumsum(clean)]), np.concatenate([[0], np.cumsum(toxic)])
    quality = (below[1][-1] - below[1]) / max(1, below[1][-1]) + below[0] / max(1, below[0][-1])
    gaps = np.concatenate([[0], np.diff(places) - 1, [0]])
    best = np.flatnonzero(quality >= quality.max() - 1e-9)
    at = int(best[gaps[best].argmax()])
    if at in (0, len(places)):
        return float(places[0] - 1 if at == 0 else places[-1] + 2) * GRID
    return float(places[at - 1] + 1 + places[at]) / 2 * GRID


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, label, text`` of every labelled document that is not held out, one row an id, with its whole text."""
    usable = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other"))
        .filter("label = other")
    )
    usable = staged(usable.select("doc_id", "label"))
    texts = docs.select("doc_id", words_of("text").alias("text")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Of ids, few of which repeat as a rule, only those that do have their texts compared.
    ids = texts.select("doc_id").join(counted_broadcast(usable), "doc_id", "left_semi")
    repeated = staged(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    own = texts.join(counted_broadcast(usable), "doc_id")
    if repeated.isEmpty():
        return own
    again = counted_broadcast(repeated)
    least = own.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return own.join(again, "doc_id", "left_anti").unionByName(least)


def bucket_counts(learnt: DataFrame) -> DataFrame:
    """``bucket, clean, toxic``: the texts of ``learnt(label, text)`` that have each bucket, where they are enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last = np.zeros((2, BUCKETS), np.int64), np.zeros(BUCKETS, np.intp)
        for batch in batches:
            for label, (found,) in zip(batch["label"].to_pylist(), each(text.as_py() for text in batch["text"]), strict=True):
                # Each bucket of a text once: where it stands last.
                found, order = found.ravel(), np.arange(found.size)
                last[found] = order
                counts[label, found[last[found] == order]] += 1
            give_back()
        counts[:, 0] = 0
        met = np.flatnonzero(counts.any(0)).astype(np.int32)
        for low in range(0, len(met), 1 << 16):
            at = met[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "clean", "toxic"])

    found = learnt.select("label", "text").mapInArrow(count, "bucket int, clean long, toxic long")
    summed = found.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return summed.filter(F.col("clean") + F.col("toxic") >= LEAST_DOCS)


_SLOPES = [f"s{i}" for i in range(DIMS)]


def batch_slopes(learnt: DataFrame, network: Network, weights: np.ndarray) -> list[np.ndarray] | None:
    """The gradient of the mean loss over all of ``learnt(label, text)``; None if no text has a word.

    Summed in units by row of the embeddings; the other parts and the number of texts follow in rows below zero.
    """
    ready(learnt.sparkSession)
    shared = learnt.sparkSession.sparkContext.broadcast(network.narrow())

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, whole = shared.value, lambda x: np.rint(x.astype(np.float64) / UNIT).astype(np.int64)
        projection = own.projection()

        def coded(found: np.ndarray) -> list[np.ndarray]:
            return [own.rows.take(found)]

        def added(numbers: list[np.ndarray], vectors: list[np.ndarray], rest: np.ndarray, texts: int) -> pa.RecordBatch:
            numbers, vectors = np.concatenate(numbers), np.concatenate(vectors)
            order = np.argsort(numbers, kind="stable")
            numbers = numbers[order]
            first = np.flatnonzero(np.diff(numbers, prepend=-1))
            others = np.append(rest, texts)
            others = np.pad(others, (0, -len(others) % DIMS)).reshape(-1, DIMS)
            rows = np.concatenate([numbers[first], -1 - np.arange(len(others))]).astype(np.int32)
            sums = np.concatenate([np.add.reduceat(vectors[order], first, axis=0), others])
            return pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(sums[:, i]) for i in range(DIMS))], names=["row", *_SLOPES])

        for batch in batches:
            numbers, vectors, rest, texts, waiting = [], [], 0, 0, 0
            for label, (rows,) in zip(batch["label"].to_pylist(), each((text.as_py() for text in batch["text"]), coded), strict=True):
                if len(rows):
                    at, vector, dense = _own_slopes(own, projection, rows, label, weights[label], own.bias)
                    numbers.append(at)
                    vectors.append(whole(vector))
                    rest, texts, waiting = rest + whole(dense), texts + 1, waiting + len(at)
                if waiting >= HELD_SLOPES:
                    yield added(numbers, vectors, rest, texts)
                    numbers, vectors, rest, texts, waiting = [], [], 0, 0, 0
            if texts:
                yield added(numbers, vectors, rest, texts)
            give_back()

    made = learnt.select("label", "text").mapInArrow(slopes, "row int, " + ", ".join(f"{name} long" for name in _SLOPES))
    found = made.groupBy("row").agg(*[F.sum(name).alias(name) for name in _SLOPES]).toArrow()
    shared.destroy()
    if not found.num_rows:
        return None
    rows = found["row"].to_numpy()
    sums = np.stack([found[name].to_numpy() for name in _SLOPES], axis=1)
    others = sums[rows < 0][np.argsort(-rows[rows < 0])].ravel()
    size = sum(f.size + 2 * FILTERS for f in network.filters) + 1
    to_embeddings = np.zeros_like(network.embeddings)
    to_embeddings[rows[rows >= 0]] = sums[rows >= 0] * UNIT
    return [x / others[size] for x in (to_embeddings, *_parts(network, others[:size] * UNIT))]


def calibrate(learnt: DataFrame, network: Network) -> None:
    """Set thresholds by language, and at -1 the one of all others, from counts over all of ``learnt(label, text)``."""
    ready(learnt.sparkSession)
    shared = learnt.sparkSession.sparkContext.broadcast(network)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = list(scorer.logits(text.as_py() for text in batch["text"]))
            at = np.floor(np.clip([x for x, _ in found], -FAR, FAR) / GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["label"].cast(pa.int32()), pa.array([x for _, x in found], pa.int32()), pa.array(at)], names=["label", "language", "place"])
            give_back()

    found = learnt.select("label", "text").mapInArrow(place, "label int, language int, place int")
    toxic = F.sum("label").alias("toxic")
    counts = found.groupBy("language", "place").agg(toxic, F.count("*").alias("n")).toArrow()
    shared.destroy()
    languages, places, toxic, n = (counts[name].to_numpy() for name in ("language", "place", "toxic", "n"))

    def of(chosen: np.ndarray) -> float:
        at, index = np.unique(places[chosen], return_inverse=True)
        both = np.zeros((2, len(at)), np.int64)
        np.add.at(both[0], index, (n - toxic)[chosen])
        np.add.at(both[1], index, toxic[chosen])
        return threshold(at, *both)

    network.thresholds = {-1: of(np.ones(len(n), bool))}
    for language in range(len(LANGUAGES)):
        own = languages == language
        if min(toxic[own].sum(), (n - toxic)[own].sum()) >= CALIBRATED:
            network.thresholds[language] = of(own)


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network fitted and calibrated with every label that may be learnt; None without both classes."""
    spark = docs.sparkSession
    ready(spark)
    learnt = learnable(docs, labels).select(
        F.col("label").cast("int").alias("label"), "text",
        # Equal texts are all aside or none.
        F.when(F.pmod(F.xxhash64("text"), F.lit(4)) == 0, ASIDE).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))).cast("int").alias("part"),
    )
    path = stage_folder(spark)
    learnt.write.partitionBy("part").parquet(path)
    read = lambda: spark.read.schema("label int, text string, part int").parquet(path)
    totals = np.zeros((2, 2), np.int64)
    for row in read().groupBy((F.col("part") == ASIDE).alias("aside"), "label").count().collect():
        totals[int(row["aside"]), row["label"]] = row["count"]
    if not totals.sum(0).all():
        remove(spark, path)
        return None
    apart = bool(totals.all())  # else too few to set some aside
    part = F.col("part") if apart else F.when(F.col("part") == ASIDE, F.lit(0)).otherwise(F.col("part"))
    rows = read().withColumn("part", part)
    totals = totals[0] if apart else totals.sum(0)
    counts, counted = written(bucket_counts(rows.filter(F.col("part") != ASIDE)))
    counts = counts.toArrow()
    kept = counts["bucket"].to_numpy()
    order = np.argsort(kept)
    network = started(kept[order], np.stack([counts["clean"].to_numpy(), counts["toxic"].to_numpy()])[:, order], totals)
    descend(network, lambda network, batch: batch_slopes(rows.filter(F.col("part") == batch), network, importance(totals)))
    calibrate(rows.filter(F.col("part") == ASIDE) if apart else rows, network)
    remove(spark, counted)
    remove(spark, path)
    return network


def with_toxicity(docs: DataFrame, network: Network | None, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    refuse_taken(docs, into)
    if network is None:
        return docs.withColumn(into, F.lit(0.0))
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf(DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in texts:
            give_back()
            yield pa.array(scorer.scores(text.as_py() for text in batch), pa.float64())

    return docs.withColumn(into, score(words_of(text_col)))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    scored = with_toxicity(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"),
    )
