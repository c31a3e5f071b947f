"""Small document tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

from pyspark.sql import functions as F

#: Names that operators use for columns of their own.
CLASHES = ("score", "row", "id", "hash", "words", "content", "leaks", "n_tokens", "ids", "kept_id", "rows", "text_hash", "slot", "shard", "label", "place", "Root")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randrange(400)) for _ in range(words))


def documents(spark, rows, clashes=True):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for name in CLASHES if clashes else ():
        docs = docs.withColumn(name, F.lit(name))
    return docs


def odd_rows():
    long = prose(99, 30_000)
    same = "Same words here.\nAnd there, twice."
    return [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, same), (5, same), (6, same), (None, same), (None, None), (7, "x")]


def empty(docs):
    return docs.filter(F.lit(False))
