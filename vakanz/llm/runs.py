"""Periodic runs of words, found with a suffix automaton whose link tree is coloured by access.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and two
periods long, that no neighbouring word extends keeping that period. The states of a text's suffix
automaton form a tree by their suffix links; the path from the state of a prefix to the root holds
all its suffixes. The tree is kept as a link-cut forest whose preferred paths have one colour, the
place where their strings ended last. Appending word i accesses the path of its prefix: every path
segment of colour e met on the way, with longest string of m words, says that these m words end at
e and at i. If d = i - e is at most m they overlap or touch, so the m + d words up to i are a
repetition of period d, which cannot be extended to the left. d is the smallest period, as a
smaller one would have coloured the segment later. A run of period d is met at each of its words
from the end of its first two periods on, so places that follow each other with one d are one run.

Only stretches of words covered by runs of ``GRAM`` words that are repeated within the stretch get
an automaton: each word of a run of ``LEAST`` words is covered by such a repeat inside the run.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and no runs; texts are read
whole, whatever their length, one at a time if long; repeated rows give repeated results; an empty
table gives an empty result. Other columns are kept, and columns to be added must have new names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import mapped_texts, words_of

#: Words of the shortest run.
LEAST = 12
#: Words of the repeats that cover a run: half of the shortest one.
GRAM = LEAST // 2
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xBF58476D1CE4E5B9)


def covered_stretches(hashes: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the stretches of words that can hold runs, for texts laid end to end.

    Words outside repeated grams divide a text; then each part counts alone, until nothing changes.
    """
    place = np.arange(len(hashes))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    while len(place) >= GRAM:
        n = len(place) - GRAM + 1
        value = owner[:n].astype(np.uint64) * _PRIME
        for i in range(GRAM):
            value = (value ^ hashes[place[i : i + n]]) * _MIXER
            value ^= value >> np.uint64(29)
        whole = np.flatnonzero(owner[:n] == owner[GRAM - 1 :])
        value = value[whole]
        # Buckets first: sorting is for the few that share one.
        bits = np.uint64(64 - max(10, int(len(value)).bit_length() + 2))
        bucket = (value >> bits).astype(np.int64)
        likely = np.flatnonzero(np.bincount(bucket)[bucket] > 1) if len(bucket) else whole
        _, group, times = np.unique(value[likely], return_inverse=True, return_counts=True)
        starts = whole[likely[times[group] > 1]]
        steps = np.zeros(len(place) + 1, np.int64)
        steps[starts] += 1
        np.add.at(steps, starts + GRAM, -1)
        inside = np.cumsum(steps[:-1]) > 0
        if inside.all():
            break
        kept = np.flatnonzero(inside)
        place, before = place[kept], owner[kept]
        breaks = np.ones(len(place), bool)
        breaks[1:] = (place[1:] != place[:-1] + 1) | (before[1:] != before[:-1])
        owner = np.cumsum(breaks)
    if len(place) < GRAM:
        return []
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    ends = np.append(begins[1:], len(place))
    return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(begins, ends, strict=True)]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest string of each state, and the state of each prefix; 1 is the root."""
    step: list[dict] = [{}, {}]
    link, longest, prefixes = [0, 0], [0, 0], []
    last = 1
    for word in words:
        state = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(1)
        at = last
        while at and word not in step[at]:
            step[at][word] = state
            at = link[at]
        if at:
            target = step[at][word]
            if longest[target] == longest[at] + 1:
                link[state] = target
            else:
                clone = len(step)
                step.append(step[target].copy())
                longest.append(longest[at] + 1)
                link.append(link[target])
                while at and step[at].get(word) == target:
                    step[at][word] = clone
                    at = link[at]
                link[target] = link[state] = clone
        prefixes.append(state)
        last = state
    return link, longest, prefixes


class Paths:
    """A link-cut forest over a fixed tree: preferred paths as splay trees by depth, one colour each.

    The colour is held by the root of a path's splay tree, the node ``up`` of which is that above the path.
    """

    def __init__(self, parents: list[int]):
        self.up = parents[:]
        self.low = [0] * len(parents)  # towards the root of the tree
        self.high = [0] * len(parents)
        self.colour = [-1] * len(parents)

    def _rotate(self, x: int, p: int) -> None:
        low, high, up = self.low, self.high, self.up
        g = up[p]
        if low[p] == x:
            child = low[p] = high[x]
            high[x] = p
        else:
            child = high[p] = low[x]
            low[x] = p
        if child:
            up[child] = p
        if low[g] == p:
            low[g] = x
        elif high[g] == p:
            high[g] = x
        else:
            self.colour[x] = self.colour[p]
        up[x], up[p] = g, x

    def _splay(self, x: int) -> None:
        low, high, up = self.low, self.high, self.up
        while True:
            p = up[x]
            if low[p] != x and high[p] != x or not p:
                return
            g = up[p]
            if low[g] == p or high[g] == p:
                alike = (low[p] == x) == (low[g] == p)
                self._rotate(*((p, g) if alike else (x, p)))
            self._rotate(x, up[x])

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Make the path from ``node`` to the root one of ``colour``; gives deepest node and old colour of its segments."""
        up, high, colours = self.up, self.high, self.colour
        found, below, x = [], 0, node
        while x:
            self._splay(x)
            old = colours[x]
            if old >= 0:
                found.append((x, old))
            if high[x]:
                colours[high[x]] = old
            high[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return found


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``words``, by start, then period."""
    numbers: dict = {}
    link, longest, prefixes = automaton([numbers.setdefault(w, len(numbers)) for w in words])
    paths = Paths(link)
    growing: dict[int, list[int]] = {}
    found = []
    for i, state in enumerate(prefixes):
        for node, e in paths.access(state, i):
            period, size = i - e, longest[node]
            if period <= size:
                run = growing.get(period)
                if run and run[1] == i - 1:
                    run[1] = i
                else:
                    growing[period] = run = [i - size - period + 1, i]
                    found.append((period, run))
    out = [(start, end - start + 1, period) for period, (start, end) in found]
    return sorted((s, n, q) for s, n, q in out if n >= max(least, 2 * q))


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, given as words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(sizes.sum())).view(np.uint64)
    begins = np.cumsum(sizes) - sizes
    out: list[list] = [[] for _ in texts]
    for low, high in covered_stretches(hashes, sizes):
        text = int(np.searchsorted(begins, low, side="right")) - 1
        first = low - int(begins[text])
        own = texts[text][first : first + high - low]
        out[text] += [(start + first, length, period) for start, length, period in runs_of(own)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    inside = np.cumsum(steps[:-1]) > 0
    return [w for w, drop in zip(words, inside.tolist(), strict=True) if not drop]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(docs: DataFrame, text_col: str = "text", runs: str = "runs", rest: str = "collapsed") -> DataFrame:
    """``docs`` with all runs of each text, and the text without repeated periods in place of the text."""
    def make(texts: list[str]) -> list[pa.Array]:
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        found = text_runs(words)
        kept = [b" ".join(collapsed(w, r)) for w, r in zip(words, found, strict=True)]
        rows = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in found]
        return [pa.array(rows, _KIND), pa.array(kept, pa.binary()).cast(pa.string())]

    return mapped_texts(docs, text_col, f"`{runs}` {RUNS}, `{rest}` string", make)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where one text in ten repeats some of its words from a place on, both by a hash of the id."""
    name = text_col
    h = F.crc32(docs[id_col].cast("string").cast("binary"))
    words = F.array_remove(F.split(words_of(name), r"[\x20\x09-\x0D]+"), "")
    g, n = F.floor(h / 10), F.size(words)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))

    def rewritten(w: Column) -> Column:
        place = lambda i: F.when(i < w["a"], i).otherwise(w["a"] + (i - w["a"]) % w["p"]).cast("int")
        numbers = F.sequence(F.lit(0), F.size(w["words"]) - 1)
        return F.array_join(F.transform(numbers, lambda i: F.get(w["words"], place(i))), " ")

    row = F.array(F.struct(words.alias("words"), a.alias("a"), p.alias("p")))
    planted = F.get(F.transform(row, rewritten), F.lit(0))
    return docs.withColumn(name, F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col(name)))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_runs``, the greatest run, and checksums of all runs and of the collapsed text, for every row."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = with_runs(rows)
    # Greatest length, then smallest start, then smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
