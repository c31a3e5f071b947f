"""Sharding as a two-pass external shuffle: scatter, then Fisher-Yates in every bucket.

Buckets are memory-sized, at least one a shard. A record's bucket is a seeded hash of its id and
its place in the input, so repeated rows and hot ids scatter too. Rows a bucket are counted over ids
alone, which gives each bucket its place among all. Then the whole records are shuffled once, one
task a bucket: it loads the bucket as one array, permutes it with ``shuffle`` (Fisher-Yates) and
writes it. Shard ``s`` takes the positions of its share: row counts of shards are at most one apart
(law ``rows``).

The input is read more than once and must give the same rows in the same order, as stored tables
do; where it does not, the counts differ and the job fails.

Null ids and texts count as values of their own, a null text has no bytes; an empty table gives
an empty result; extra columns are not looked at by ``assign_shards`` and carried by
``write_shards``. ``assign_shards`` writes the records and tells what stands in the written shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from vakanz.llm.common import free_name, staged, words_of
from vakanz.runtime import stage_folder

#: Bytes of the records of one bucket, far below the memory of one task, and the most buckets:
#: beyond their product (6 TB) buckets grow, to 250 MB at 100 TB.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 400_000
#: Buckets whose places are summed together.
RANGE = 4096


def record_size(text: Column | str) -> Column:
    """UTF-8 bytes of the text plus one."""
    return (F.octet_length(words_of(text)) + 1).cast("long")


def _dealt(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    """``bucket, place, record``: the columns of ``rows`` in a struct, dealt by a hash of the first and the place."""
    dealt = rows.select(F.struct(*rows.columns).alias("record"), F.monotonically_increasing_id().alias("place"))
    hashed = F.xxhash64(F.lit(seed), F.col("record").getField(rows.columns[0]), "place")
    return dealt.select(F.pmod(hashed, F.lit(buckets)).cast("int").alias("bucket"), "place", "record")


def _offsets(counts: DataFrame) -> DataFrame:
    """``bucket, n, offset`` from ``bucket, n``: sums within ranges of buckets, and over the ranges."""
    ranged = counts.withColumn("range", F.floor(F.col("bucket") / RANGE))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("rows"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One row for RANGE buckets.
    sums = sums.select("range", F.coalesce(F.sum("rows").over(before(Window.orderBy("range"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy("range").orderBy("bucket"))), F.lit(0))
    return ranged.withColumn("own", own).join(sums, "range").select("bucket", "n", (F.col("base") + F.col("own")).alias("offset"))


def _permuted(dealt: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``record, position``: all records in their new order, by one shuffle to one task a bucket."""
    counts = staged(dealt.groupBy("bucket").agg(F.count("*").alias("n")))
    # The place of a bucket travels with its records.
    both = dealt.unionByName(_offsets(counts), allowMissingColumns=True)
    gathered = both.repartitionById(buckets, "bucket").groupBy("bucket").agg(
        F.max("n").alias("n"), F.max("offset").alias("offset"),
        F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "record")))).alias("records"),
    )
    # A fixed task of each bucket, and order within it, make the permutation repeatable.
    whole = F.when(F.size("records") == F.col("n"), F.col("records")).otherwise(
        F.raise_error(F.lit("the records are not the same each time they are read"))
    )
    mixed = gathered.select("offset", F.posexplode(F.shuffle(whole, F.lit(seed))).alias("pos", "entry"))
    return mixed.select("entry.record", (F.col("offset") + F.col("pos")).alias("position"))


def assign_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every record as written.

    The id and text of each record are written to shards in the shared checkpoint folder.
    """
    path = stage_folder(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    write_shards(rows, path, shards, seed, bucket_bytes=bucket_bytes)
    schema = StructType([*rows.schema.fields, StructField("slot", LongType()), StructField("shard", IntegerType())])
    written = docs.sparkSession.read.schema(schema).parquet(path)
    return written.select(
        "doc_id", record_size("text").alias("size"), F.crc32(words_of("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 16,
    seed: int = 20,
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> None:
    """Write whole records to ``path/shard=N``; ``slot`` is their order within the shard."""
    if docs.limit(1).isEmpty():
        docs.withColumn(free_name(docs, "slot"), F.lit(0)).write.mode("overwrite").parquet(path)
        return
    total, rows = docs.agg(F.sum(record_size(text_col) + F.lit(64)), F.count("*")).first()
    buckets = max(shards, -(-total // max(bucket_bytes, total // MOST_BUCKETS)))
    # Shard s begins at ceil(s * rows / shards), the same as floor(position * shards / rows) = s.
    placed = _permuted(_dealt(docs, seed, buckets), buckets, seed).withColumn("to", F.expr(f"(position * {shards}) div {rows}"))
    begins = F.expr(f"(to * {rows} + {shards} - 1) div {shards}")
    slot, shard = free_name(docs, "slot"), free_name(docs, "shard")
    written = placed.select(
        *[F.col("record").getField(c).alias(c) for c in docs.columns],
        (F.col("position") - begins).alias(slot), F.col("to").cast("int").alias(shard),
    )
    written.sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)
