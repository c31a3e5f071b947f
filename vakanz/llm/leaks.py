"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

The test items are the indexed documents; every passage of every training text is a query. Weights
are BM25 divided by the item's own score, so an item that stands whole in a passage scores 1.
Passages are windows of two chunks of as many words as the longest item of a class, so every item
that a text holds lies whole in a window. For each window and block of items the sum of the
block's largest weights bounds all scores; blocks below the threshold are skipped, the others are
searched by WAND. All items at or above the threshold are retrieved, and leak if enough word runs
of their question and of their answer stand in the window.

Words are ``\\w+`` in lower case. The answer is what follows the last question mark, else the last
sentence, else the last third; without a question mark it is lengthened to ``ANSWER_WORDS`` words
or a third of the item, but not beyond its half, so that it has several runs and one edited or
missing word does not decide.

Indexes are built in tasks and stored; driver and workers hold one of bounded size at a time. Null
texts are empty; items and texts without words match nothing; texts are read whole, whatever their
length; repeated items are all reported, and repeated texts alike; null item ids stay null; empty
tables give no leaks. Other columns are kept, and a name that is taken is refused for the new one.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from vakanz.llm.common import counted_broadcast, free_name, give_back, held, ready, refuse_taken, staged, words_of

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach.
THRESHOLD = 0.5
#: Length of the word runs of a question and an answer, and the share of them in the passage.
QUESTION_RUN, ANSWER_RUN, OVERLAP = 5, 3, 0.5
#: Words that an answer without a mark has at least, where the item is long enough.
ANSWER_WORDS = 8
BLOCK_ITEMS = 8
#: What the commonest words may add to a score without being looked up for the first bound.
SLACK = 0.1
#: Items and words of one index, which every worker holds; more items make more indexes.
PART_ITEMS, PART_WORDS = 20_000, 2_000_000
#: Bounds computed at once.
CELLS = 1 << 21
LEAK = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item before and in its answer."""
    cut = text.rfind("?") + 1
    marked = bool(words(text[cut:]) and words(text[:cut]))
    if not marked:
        ends = [m.end() for m in re.finditer(r"[.!\n](?=\s|$)|\n", text.rstrip().rstrip(".!"))]
        cut = ends[-1] if ends else 0
    question, answer = words(text[:cut]), words(text[cut:])
    if not question or not answer:
        own = words(text)
        third = max(1, len(own) // 3)
        question, answer = own[:-third] or own, own[-third:]
    if not marked:
        own = words(text)
        least = min(max(ANSWER_WORDS, len(own) // 3), len(own) // 2)
        if len(answer) < least:
            question, answer = own[:-least], own[-least:]
    return question, answer


def overlap(part: list[str], passage: list[str], run: int) -> float:
    """The share of the part's word runs that stand in the passage."""
    run = min(run, len(part))
    there = {tuple(passage[i : i + run]) for i in range(len(passage) - run + 1)}
    own = [tuple(part[i : i + run]) for i in range(len(part) - run + 1)]
    return sum(x in there for x in own) / len(own)


class Index:
    """Items of like length: postings in item order, and the largest weight of each block.

    ``terms`` numbers the words of all indexes. The commonest words, which together cannot add more
    than ``SLACK`` to any score, are left out of the first bound and of nothing else.
    """

    def __init__(self, items, terms: dict[str, int], frequency: dict[str, int], total: int, mean: float):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(text) for _, text in items]
        own = [words(text) for _, text in items]
        self.chunk = max(len(w) for w in own)
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for number, item in enumerate(own):
            weights = {}
            for term, tf in Counter(item).items():
                idf = np.log1p((total - frequency[term] + 0.5) / (frequency[term] + 0.5))
                weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(item) / mean))
            whole = sum(weights.values())
            for term, weight in weights.items():
                self.postings[terms.setdefault(term, len(terms))].append((number, float(weight / whole)))
        #: Of each term, the largest weight in each block that has it.
        self.most: dict[int, dict[int, float]] = {}
        for term, own_postings in self.postings.items():
            most = self.most[term] = {}
            for number, weight in own_postings:
                at = number // BLOCK_ITEMS
                most[at] = max(most.get(at, 0.0), weight)

    def settle(self, size: int) -> None:
        """Arrays over all ``size`` terms."""
        slack, light = np.zeros(self.blocks), set()
        for term in sorted(self.most, key=lambda t: (-len(self.postings[t]), t)):
            more = slack.copy()
            more[list(self.most[term])] += list(self.most[term].values())
            if more.max() > SLACK:
                break
            slack = more
            light.add(term)
        self.slack = slack
        counts = np.zeros(size + 1, np.int64)
        for term, most in self.most.items():
            counts[term] = 0 if term in light else len(most)
        self.sizes = counts  # the last one is that of unknown words
        self.starts = np.cumsum(counts) - counts
        heavy = [self.most[t] for t in sorted(self.most) if t not in light]
        self.block = np.array([b for most in heavy for b in most], np.int64)
        self.bound = np.array([w for most in heavy for w in most.values()], float)

    def promising(self, ids: np.ndarray):
        """``window, block, terms`` where the bound reaches the threshold; window k has chunks k and k + 1."""
        chunks = -(-len(ids) // self.chunk)
        step = max(2, CELLS // self.blocks)
        for low in range(0, max(1, chunks - 1), step - 1):
            part = ids[low * self.chunk : (low + step) * self.chunk]
            at = np.flatnonzero(self.sizes[part])
            here = -(-len(part) // self.chunk)
            width = len(self.sizes)
            chunk, term = np.divmod(np.unique(at // self.chunk * width + part[at]), width)
            first, size = self.starts[term], self.sizes[term]
            entry = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cells = np.repeat(chunk, size) * self.blocks + self.block[entry]
            bounds = np.bincount(cells, self.bound[entry], here * self.blocks).reshape(here, self.blocks)
            if here > 1:
                bounds = bounds[:-1] + bounds[1:]
            last, terms = -1, []
            for window, block in zip(*np.nonzero(bounds + self.slack >= THRESHOLD - 1e-9), strict=True):
                if window != last:  # now with each word of the window once
                    last, terms = window, set(part[window * self.chunk : (window + 2) * self.chunk].tolist())
                    terms = [t for t in terms if t in self.most]
                if sum(self.most[t].get(block, 0.0) for t in terms) >= THRESHOLD - 1e-9:
                    yield low + int(window), int(block), terms

    def search(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """WAND over the items of one block: all that score at least the threshold."""
        low, high = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS
        lists = []
        for term in terms:
            if block in self.most[term]:
                own = [p for p in self.postings[term] if low <= p[0] < high]
                lists.append([0, max(w for _, w in own), own])
        found = []
        while lists:
            lists.sort(key=lambda x: x[2][x[0]][0])
            bound, pivot = 0.0, None
            for at, most, own in lists:
                bound += most
                if bound >= THRESHOLD - 1e-9:
                    pivot = own[at][0]
                    break
            if pivot is None:
                break
            score, first = 0.0, lists[0][2][lists[0][0]][0]
            for entry in lists:
                at, _, own = entry
                if first == pivot and own[at][0] == pivot:
                    score += own[at][1]
                    entry[0] += 1
                elif first < pivot:
                    while entry[0] < len(own) and own[entry[0]][0] < pivot:
                        entry[0] += 1
            if first == pivot and score >= THRESHOLD - 1e-9:
                found.append((pivot, score))
            lists = [x for x in lists if x[0] < len(x[2])]
        return found

    def leaks(self, own: list[str], ids: np.ndarray) -> dict[int, tuple[float, float, float]]:
        """Score, question and answer overlap of each leaking item, at its best window."""
        best: dict[int, tuple[float, float, float]] = {}
        for window, block, terms in self.promising(ids):
            at = slice(window * self.chunk, (window + 2) * self.chunk)
            for number, score in self.search(terms, block):
                question = overlap(self.parts[number][0], own[at], QUESTION_RUN)
                answer = overlap(self.parts[number][1], own[at], ANSWER_RUN)
                if question >= OVERLAP and answer >= OVERLAP:
                    best[number] = max(best.get(number, (0.0, 0.0, 0.0)), (score, question, answer))
        return best


@dataclass
class Indexes:
    """An index for each class of item lengths, so that long items do not widen the windows of short ones."""

    terms: dict[str, int]
    classes: list[Index]

    def find(self, text: str) -> list[dict]:
        own = words(text)
        unknown = len(self.terms)
        ids = np.fromiter(map(self.terms.get, own, repeat(unknown)), np.int64, len(own))
        out = []
        for index in self.classes:
            for number, (score, question, answer) in index.leaks(own, ids).items():
                out.append({"item_id": index.ids[number], "score": score, "question": question, "answer": answer})
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["score"]))


def build(items: list[tuple[int | None, str]], frequency: dict[str, int], total: int, mean: float) -> Indexes:
    classes, terms = defaultdict(list), {}
    for item in items:
        size = len(words(item[1]))
        if size:
            classes[max(2, (size - 1).bit_length() // 2)].append(item)
    found = [Index(classes[c], terms, frequency, total, mean) for c in sorted(classes)]
    for index in found:
        index.settle(len(terms))
    return Indexes(terms, found)


def _item_words(text: Column) -> Column:
    @F.arrow_udf(ArrayType(StringType()))
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([words(t.as_py()) for t in texts], pa.list_(pa.string()))

    return split(text)


def stored_indexes(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """``part, index``, written, and the number of parts: each index is built in a task from its items.

    A part has about ``PART_ITEMS`` items and ``PART_WORDS`` words at most (or one longer item).
    Frequencies and lengths are counted by Spark over all items, so splitting changes no score.
    """
    ready(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of("text").alias("text"))
    split = items.select("item_id", "text", _item_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    split = staged(split.withColumn("item", F.monotonically_increasing_id()))
    total, size = split.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    parts = max(-(-total // PART_ITEMS), -(-size // PART_WORDS))
    mean = size / max(1, total)
    terms = split.select("item", F.explode(F.array_distinct("words")).alias("term"))
    counts = counted_broadcast(staged(terms.groupBy("term").agg(F.count("*").alias("n"))))
    known = terms.join(counts, "term").groupBy("item").agg(F.collect_list(F.struct("term", "n")).alias("known"))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))).cast("int")
    rows = split.join(known, "item").select(part.alias("part"), "item_id", "text", "known")

    def build_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequency, number = [], {}, 0
        for batch in batches:
            for row in batch.to_pylist():
                number = row["part"]
                own.append((row["item_id"], row["text"]))
                frequency.update((x["term"], x["n"]) for x in row["known"])
        if own:
            own.sort(key=lambda x: (len(x[1]), x[1], x[0] is None, x[0] or 0))
            data = pickle.dumps(build(own, frequency, total, mean))
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "index": pa.array([data], pa.binary())})

    return staged(rows.repartitionById(max(1, parts), "part").mapInArrow(build_part, "part int, index binary")), parts


def _searched(docs: DataFrame, data: bytes, text_col: str, into: str) -> DataFrame:
    """``docs`` with the leaking items of one part; a worker holds one part at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(data)
    key = "leaks", uuid.uuid4().hex
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    @F.arrow_udf(LEAK)
    def search(texts: pa.Array) -> pa.Array:
        index = held(key, lambda: pickle.loads(shared.value))
        give_back()
        return pa.array([index.find(t.as_py()) for t in texts], kind)

    return docs.withColumn(into, search(words_of(text_col)))


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", into: str = "leaks") -> DataFrame:
    """``docs`` with the leaking items of each text, by id.

    Several parts are searched one after another, each reading ``docs`` once; what they find is
    united by a 128-bit hash of the text.
    """
    refuse_taken(docs, into)
    ready(docs.sparkSession)
    indexes, parts = stored_indexes(benchmark)
    none = F.array().cast(LEAK)
    index_of = lambda part: indexes.filter(F.col("part") == part).select("index").first()
    if parts <= 1:
        data = index_of(0)
        return _searched(docs, data["index"], text_col, into) if data else docs.withColumn(into, none)
    key = free_name(docs, "text_key")
    keyed, found = docs.withColumn(key, F.md5(words_of(text_col).cast("binary"))), None
    for part in range(parts):
        if data := index_of(part):
            hits = _searched(keyed.select(key, text_col), data["index"], text_col, into).filter(F.size(into) > 0)
            hits = staged(hits.groupBy(key).agg(F.first(into).alias(into)))
            found = hits if found is None else found.unionByName(hits)
    united = staged(found.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(into))).alias(into)))
    return keyed.join(united, key, "left").withColumn(into, F.coalesce(into, none)).drop(key)


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, best_score`` for every row."""
    rows = with_leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", "leaks")
    ids = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))
    return rows.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x["score"])), F.lit(0.0)).alias("best_score"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without leaks, with their columns."""
    name = free_name(docs, "leaks")
    return with_leaks(docs, benchmark, into=name).filter(F.size(name) == 0).select(*docs.columns)
