"""Session defaults, durable intermediate results and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of values that a broadcast may hold.
BROADCAST_BYTES = 32 << 20


def session(app: str = "vakanz", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; every setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Of repeated keys in structured data the last one counts.
        "spark.sql.variant.allowDuplicateKeys": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; a private one only in local mode, where
    driver and executors are one process, and only if the setting is missing (as in tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="vakanz-checkpoint-")
    context.setCheckpointDir(folder)


def stage_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    Used where one result is read more than once and must be the same rows each time, also
    after executors were lost. Later readers get only the columns they use.
    """
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values: text by its length, other simple values as sixteen bytes each."""
    text = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = F.lit(16 * len(df.columns))
    for name in text:
        size = size + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    return df.agg(F.sum(size.cast("bigint"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the frame, of simple columns, is measured to be small.

    ``df`` is read once to measure it, so it should be stored or cheap. A larger frame is
    returned without hint, so that the join is planned from statistics.
    """
    return F.broadcast(df) if value_bytes(df) <= max_bytes else df


def items(array: Column | str) -> Column:
    """A computed array as generator input.

    For a bare column the optimizer derives a filter and moves it below the projection that
    computes the array, which then is evaluated more than once; for an expression it does not.
    """
    return F.slice(array, F.lit(1), F.lit(2**31 - 1))


def keep(df: DataFrame, condition: Column, *columns: Column | str) -> DataFrame:
    """Filter on costly computed columns, each of which is evaluated once.

    A plain filter would be moved below the projection and repeat its expressions there.
    """
    row = F.struct(*(columns or df.columns))
    return df.select(F.inline(F.when(condition, F.array(row))))


def accepted(tagged: DataFrame) -> DataFrame:
    """Rows of a stage that passed, without the ``reason`` column."""
    columns = [c for c in tagged.columns if c != "reason"]
    return keep(tagged, F.col("reason").isNull(), *columns)


def rejects(tagged: DataFrame, stage: str, key: str) -> DataFrame:
    """Rows of a stage that failed, as ``rejects(stage, key, reason)``."""
    return keep(
        tagged,
        F.col("reason").isNotNull(),
        F.lit(stage).alias("stage"),
        F.col(key).cast("string").alias("key"),
        "reason",
    )

