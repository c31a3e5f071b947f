"""Helpers of the operators: null-safe columns, written stages, counted broadcasts, workers."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vakanz.runtime import stage_folder

#: Rows of at most 64 bytes that a broadcast may hold: 32 MB.
BROADCAST_IDS = 500_000
#: Bytes of text that a worker turns into results at once.
SLICE_BYTES = 1 << 20
#: Bytes of rows that go to a worker at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


_held: dict = {}


def held(key, make: Callable):
    """What ``make`` gives, kept in this process until something else is: one model at a time.

    Workers serve one stage after another; without this they would keep the models of all.
    """
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Return what the batch before has left unused to the system; called once a batch."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: Column | str) -> Column:
    """``text`` with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage: what is read later is the same whatever executors were lost meanwhile.
    """
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``staged``, with the folder, for those who ``remove`` it when it is read no more."""
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written stage, in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def counted_broadcast(keys: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """Hint a broadcast of narrow, already written ``keys`` if counting proves it bounded.

    More keys are returned as they are and take a shuffled join, with the same result.
    """
    return F.broadcast(keys) if keys.count() <= rows else keys


def without_keys(
    rows: DataFrame, keys: DataFrame, same: Callable[[DataFrame], Column], columns: list[str]
) -> DataFrame:
    """``rows`` without those of the written ``keys``; where a key ``stays``, one of its rows is kept."""
    left = rows.join(counted_broadcast(keys), same(keys), "left_anti")
    again = keys.filter("stays")
    if again.isEmpty():
        return left
    # Rows that agree in ``columns`` are repeated: one of them stays.
    return left.unionByName(rows.join(counted_broadcast(again), same(again), "left_semi").dropDuplicates(columns))


def among_least(hashed: Column, total: int, wanted: int) -> Column:
    """A condition that some four times ``wanted`` of ``total`` different hashes meet.

    With it, taking the ``wanted`` least ones gathers a bounded number of rows in one task,
    whatever the number of tasks.
    """
    if total <= 4 * wanted:
        return F.lit(True)
    return hashed < F.lit(-(2**63) + 2**64 * 4 * wanted // total)


def once(df: DataFrame) -> DataFrame:
    """``df`` as generator input, so that costly columns used twice later are computed once."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def mapped_texts(
    docs: DataFrame, text_col: str, added: str, make: Callable[[list[str]], list[pa.Array]]
) -> DataFrame:
    """``docs`` with the columns ``added`` in place of its text, made from some texts at a time.

    ``make`` gets texts of ``SLICE_BYTES`` or one longer text, and its results are passed on at
    once, so a worker holds little more than a batch of its input. A null text is an empty one.
    Names that are taken are refused.
    """
    ready(docs.sparkSession)
    refuse_taken(docs, *StructType.fromDDL(added).names, but=text_col)
    place = docs.columns.index(text_col)
    others = [i for i in range(len(docs.columns)) if i != place]
    schema = StructType([docs.schema.fields[i] for i in others] + StructType.fromDDL(added).fields)

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
            low = 0
            while low < len(sizes):
                high, total = low, 0
                while high < len(sizes) and (high == low or total + sizes[high] <= SLICE_BYTES):
                    total += sizes[high]
                    high += 1
                part = batch.slice(low, high - low)
                made = make([t or "" for t in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in others], *made], names=schema.names)
                del part, made
                low = high
            give_back()

    return docs.mapInArrow(run, schema)


def refuse_taken(df: DataFrame, *names: str, but: str = "") -> None:
    """ValueError if a column to be added has the name of one that stays, in any letter case, or of another."""
    taken = [c.lower() for c in df.columns if c != but] + [n.lower() for n in names]
    twice = [n for n in names if taken.count(n.lower()) > 1]
    if twice:
        raise ValueError(f"columns must be new: {', '.join(twice)}")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, in any letter case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def ready(spark: SparkSession) -> None:
    """Let Python workers on machines that share this folder import the package, and bound their batches.

    A batch lies in the worker, in the pipe and twice in the executor; a setting of the caller's stays. On other clusters the package is shipped with ``--py-files``.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
