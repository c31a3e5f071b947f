"""Token counts by the whole-token shortcut.

It is proved once, on the driver, which vocabulary strings encode alone as one token. Workers
count words among these directly and merge only the rest. Whole texts are counted. A null text is
an empty one with no tokens; an empty table gives an empty result; repeated rows have equal counts.
The caller's other columns stay; a name that is taken is refused for the new one.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vakanz.llm.common import held, ready, refuse_taken, words_of
from vakanz.llm.vocab import BYTES, END, Memory, Vocabulary, read, symbols


@functools.lru_cache(maxsize=2)
def whole_words(path: str) -> frozenset[str]:
    """Words, as they stand in normalised text, that are one token: at most one a vocabulary id."""
    found = set()
    for token in read(path).single():
        if token.endswith(END):
            try:
                found.add(bytes(BYTES[c] for c in token.removesuffix(END)).decode("utf-8"))
            except UnicodeDecodeError:
                continue  # part of a character only; no word is that
    return frozenset(found)


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str, whole):
        self.vocabulary = Vocabulary(path)
        self.sizes = Memory(lambda w: len(self.vocabulary.merge(symbols(w))), dict.fromkeys(whole, 1))

    def count(self, text: str) -> int:
        parts, size = self.vocabulary.parts(text), self.sizes.__getitem__
        return len(parts) // 2 + sum(sum(map(size, self.vocabulary.words(p))) for p in parts[::2])


def _counter(path: str, whole) -> Counter:
    return held(("counter", path), lambda: Counter(path, whole.value))


def with_token_counts(
    docs: DataFrame, path: str, text_col: str = "text", into: str = "n_tokens"
) -> DataFrame:
    """``docs`` with the number of tokens of each text."""
    spark = docs.sparkSession
    ready(spark)
    refuse_taken(docs, into)
    whole = spark.sparkContext.broadcast(whole_words(path))  # bounded by the vocabulary

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        count_of = _counter(path, whole).count
        return pa.array([count_of(t.as_py()) for t in texts], pa.int64())

    return docs.withColumn(into, count(words_of(text_col)))


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""
    rows = docs.select(docs[id_col].alias("doc_id"), words_of(docs[text_col]).alias("text"))
    counted = with_token_counts(rows, path)
    return counted.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
