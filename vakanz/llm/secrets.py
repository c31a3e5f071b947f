"""Secret scans: base patterns, and strings that a Markov model calls random.

Two character Markov models, of random strings and of ordinary identifiers, are counted from
labelled samples. A candidate, 16 or more characters of ``[A-Za-z0-9+/_-]``, is a secret if the
log-likelihood ratio of the models reaches ``RATIO``; a run of one character counts as one. Spark
expressions only; texts are not shuffled, and what is done in a row grows with its length.

Ordinary strings are what stands beside base secrets in a sample of texts, as the candidates'
pattern reads it, the texts' own words joined to slugs, paths and identifiers, and dates.

A null text is an empty one without spans; repeated rows give repeated rows; an empty table gives
an empty result. Without samples of both kinds the model adds nothing. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions.arrays import running_sums
from vakanz.llm.common import among_least, once, words_of

#: Kinds in their order: name, pattern, and the least length of the group that counts (fixed values).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 16 or more are the same as all runs with the shorter ones dropped.
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
#: Ordinary strings in texts, as the candidates are read; what joins words to others; forms of dates.
ORDINARY = r"[A-Za-z0-9+/_-]{8,}"
JOINED = ("-", "/", "_")
DATES = ("yyyy-MM-dd'T'HH-mm-ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMddHHmmss", "yyyyMMdd-HHmmss", "dd-MM-yyyy_HH-mm", "yyyy/MM/dd/HH/mm/ss")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
STATES = len(ALPHABET) + 1  # 0 is the start of a string
#: Least log-likelihood ratio: odds of a million against a candidate being random.
RATIO = math.log(1e6)
#: Weight of a character's share of all in its share after another.
BACKOFF = 8
#: Bound of the sample of ordinary strings: different texts, those with the least hashes.
SAMPLE_DOCS = 400


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _runs_as_one(value: Column) -> Column:
    """``value`` with one character for each run of four or more of it."""
    return F.regexp_replace(value, r"(.)\1{3,}", "$1")


def _chains(words: Column, by: str) -> Column:
    """Every fourth word with the three behind it, joined."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - 3, F.lit(1)), F.lit(4))
    return F.transform(starts, lambda i: F.lower(F.array_join(F.slice(words, i, F.lit(4)), by)))


def train(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratios of each next character after each, from ``(random, value)`` rows.

    Transitions are counted in Spark; at most two for each pair of characters reach the driver.
    """
    pairs = samples.filter(F.length("value") > 0).select("random", F.concat(F.lit("\x00"), "value").alias("value"))
    pairs = pairs.select("random", F.split("value", "").alias("all"))
    pairs = pairs.select("random", F.explode(F.arrays_zip(
        F.slice("all", F.lit(1), F.size("all") - 1).alias("a"), F.slice("all", F.lit(2), F.size("all") - 1).alias("b")
    )).alias("p"))
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    rows = pairs.groupBy("random", place(F.col("p.a")).alias("a"), place(F.col("p.b")).alias("b")).count().collect()
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for r in rows:
        counts[r["random"]][r["a"], r["b"]] += r["count"]
    if not all(counts.values()):
        return None
    logs = {}
    for kind, own in counts.items():
        after, alone = Counter(), Counter()
        for (a, b), n in own.items():
            after[a] += n
            alone[b] += n
        total = sum(alone.values())
        share = [(alone[b] + 1) / (total + STATES) for b in range(STATES)]
        logs[kind] = [
            math.log((own[a, b] + BACKOFF * share[b]) / (after[a] + BACKOFF)) for a in range(STATES) for b in range(STATES)
        ]
    return [x - y for x, y in zip(logs[True], logs[False], strict=True)]


def labelled_samples(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(random, value)``: distinct values of base secrets, and ordinary strings of a sample of texts."""
    texts = docs.select(words_of(docs[text_col]).alias("text")).withColumn("hash", F.xxhash64("text"))
    hashes = texts.select("hash").distinct()
    drawn = hashes.filter(among_least(F.col("hash"), hashes.count(), sample_docs)).orderBy("hash").limit(sample_docs)
    # Texts are gathered by their hashes, so no task holds more than one after another.
    drawn = texts.join(F.broadcast(drawn), "hash").groupBy("hash").agg(F.min("text").alias("text"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    rest = drawn.select(rest.alias("text"))
    plain = rest.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("value"))
    words = rest.select(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("words"))
    chained = words.select(F.explode(F.flatten(F.array(*[_chains(F.col("words"), by) for by in JOINED]))).alias("value"))
    day = F.expr("explode(sequence(timestamp'1999-01-01', timestamp'2038-01-01', interval 97 days 7 hours 11 minutes 13 seconds))")
    days = docs.sparkSession.range(1).select(day.alias("day"))
    dates = days.select(F.explode(F.array(*[F.date_format("day", form) for form in DATES])).alias("value"))
    ordinary = plain.unionByName(chained).unionByName(dates).select(F.lit(False).alias("random"), _runs_as_one(F.col("value")).alias("value"))
    secret = texts.filter(F.col("text").rlike("|".join((ASSIGN, ACCESS, HEX))))
    for_kind = [
        secret.select(F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(g))).alias("value")).filter(F.length("value") >= least)
        for _, p, g, least in KINDS
    ]
    random = for_kind[0].unionByName(for_kind[1]).unionByName(for_kind[2])
    random = random.select(_runs_as_one(F.col("value")).alias("value")).distinct()
    return random.select(F.lit(True).alias("random"), "value").unionByName(ordinary)


def with_spans(docs: DataFrame, ratios: list[float] | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, spans`` with sorted spans of ``start, rank, kind, end`` in code points."""
    kinds = [*KINDS, ("markov", CANDIDATE, 0, 16)]
    if ratios is None:
        kinds.pop()
    rows = docs.select(docs[id_col].alias("doc_id"), words_of(docs[text_col]).alias("text"))
    parts = []
    for name, pattern, group, _ in kinds:
        every = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
        own = F.struct(
            F.transform(F.split("text", pattern, -1), F.length).alias("gaps"), F.transform(every(0), F.length).alias("sizes"),
            *([every(group).alias("values")] if name == "markov" else [F.transform(every(group), F.length).alias("values")]),
        )
        parts.append(F.when(F.col("text").rlike(pattern), own).alias(name))
    found = once(rows.select("doc_id", *parts))
    steps = found.select(
        "*", *[
            F.zip_with(F.slice(f"{n}.gaps", F.lit(1), F.size(f"{n}.sizes")), f"{n}.sizes", lambda a, b: (a + b).cast("long")).alias(f"{n}_steps")
            for n, *_ in kinds
        ]
    )
    ends = steps.select("*", *[running_sums(F.col(f"{n}_steps")).alias(f"{n}_ends") for n, *_ in kinds])
    table = None if ratios is None else F.split(F.lit(",".join(repr(x) for x in ratios)), ",").cast("array<double>")

    def ratio(value: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
        return F.aggregate(
            _codes(_runs_as_one(value)), start,
            lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.element_at(table, a["last"] * STATES + c + 1)).alias("sum")),
            lambda a: a["sum"],
        )

    def span(rank: int, name: str):
        return lambda x: F.struct(
            (x["end"] - x["size"]).alias("start"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"), x["end"].alias("end")
        )

    def wanted(name: str, least: int):
        if name == "markov":
            return lambda x: ratio(x["value"]) >= RATIO
        return lambda x: x["value"] >= least

    spans = []
    for rank, (name, _, _, least) in enumerate(kinds):
        zipped = F.arrays_zip(F.col(f"{name}_ends").alias("end"), F.col(f"{name}.sizes").alias("size"), F.col(f"{name}.values").alias("value"))
        own = F.transform(F.filter(zipped, wanted(name, least)), span(rank, name))
        spans.append(F.coalesce(own, F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")))
    return ends.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def secret_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: counts of the base kinds, the digest of base spans, and all spans."""
    found = once(with_spans(docs, train(labelled_samples(docs, text_col)), text_col, id_col))
    base = found.select("doc_id", "spans", F.filter("spans", lambda s: s["rank"] < len(KINDS)).alias("base"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return base.select(
        "doc_id", *[count(n) for n, *_ in KINDS], F.sha2(line("base").cast("binary"), 256).alias("base_sha256"),
        line("spans").alias("spans"),
    )
