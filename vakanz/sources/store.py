"""Stored stages: pages, links, postings, index, stop words, reports.

Every stage lives under one root folder. A write makes a new version, a folder that holds a folder
for each search term, beside a table of the terms it is about; it counts from the moment its marker
is created, in one step, when all is written. A write that dies before leaves what was there. A
version replaces all that its terms had in the stage, also by nothing, or adds to it; other terms
are left alone. What is read has the stage's own types, whatever a term looks like.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vakanz.functions.render import file_name, posting_text
from vakanz.functions.stopwords import BUILT_IN
from vakanz.operators import index as I
from vakanz.runtime import broadcast_if_small, durable, value_bytes
from vakanz.schemas import PAGES, SLICE_CHARS, SLICED, STAGES

#: Characters that cannot be part of a folder's name, as Spark escapes them.
_ESCAPED = "\"#%'*/:=?\\{[]^\x7f"
_COMMITS = T.StructType([T.StructField("term", T.StringType()), T.StructField("adds", T.BooleanType()), T.StructField("version", T.StringType())])

#: Bytes of values in a bucket of a stored pair of tables.
BUCKET_BYTES = 128 << 20
_LINES = T.StructType([T.StructField("value", T.StringType())])


def term_key(search_term: str) -> str:
    """Search terms are compared trimmed and in lower case."""
    return search_term.strip().lower()


def term_column(search_term: Column | str) -> Column:
    """``term_key`` of a column."""
    return F.lower(F.trim(search_term))


def slice_of(stage: str) -> Column:
    """The range of a row's fingerprint."""
    return F.substring(SLICED[stage], 1, SLICE_CHARS)


def _folder(term: str) -> str:
    return "search_term=" + "".join(f"%{ord(c):02X}" if c < " " or c in _ESCAPED else c for c in term)


def read_pages(spark: SparkSession, path: str, schema: T.StructType = PAGES) -> DataFrame:
    """Landed pages; reading with a schema avoids a pass over the files."""
    return spark.read.schema(schema).parquet(path)


def read_stop_words(spark: SparkSession, paths: Iterable[str] = ()) -> DataFrame:
    """``(term)`` of the given list files (one word per line), or the built-in lists."""
    files = list(paths)
    if files:
        words = spark.read.text(files).select(F.trim("value").alias("term"))
    else:
        words = spark.range(1).select(F.explode(F.split(F.lit("\n".join(BUILT_IN)), "\n")).alias("term"))
    return words.where("term != ''").distinct()


def stop_word_list(words: DataFrame) -> list[str]:
    """The words of one or a few list files; they become one hash set in the plan."""
    return sorted(row["term"] for row in words.collect())


@dataclass(frozen=True)
class Store:
    """Reader and writer of the stages below ``root``."""

    spark: SparkSession
    root: str

    # Versions

    def _stage(self, stage: str) -> str:
        return f"{self.root.rstrip('/')}/{stage}"

    def _files(self, path: str):
        """Path and file system of the store's folder, wherever it lies."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, files = self._files(path)
        return files.exists(at)

    def _new_version(self) -> str:
        """Later versions sort behind earlier ones."""
        return f"{time.time_ns():020d}{uuid.uuid4().hex[:8]}"

    def _commit(self, stage: str, version: str, terms: DataFrame, adds: bool) -> None:
        """From now on the version counts."""
        about = terms.select(F.col("term").cast("string").alias("term"), F.lit(adds).alias("adds"), F.lit(version).alias("version"))
        about.write.parquet(f"{self._stage(stage)}/_terms/v{version}")
        marker, files = self._files(f"{self._stage(stage)}/_commits/{version}")
        if not files.createNewFile(marker):
            raise FileExistsError(marker.toString())

    def versions(self, stage: str) -> list[str]:
        """All versions that count, one for each write."""
        markers, files = self._files(f"{self._stage(stage)}/_commits")
        return sorted(f.getPath().getName() for f in files.listStatus(markers)) if files.exists(markers) else []

    def current(self, stage: str) -> DataFrame:
        """``(term, version)``: the versions that make up what each term has in the stage."""
        paths = [f"{self._stage(stage)}/_terms/v{v}" for v in self.versions(stage)]
        if not paths:
            return self.spark.createDataFrame([], "term string, version string")
        commits = self.spark.read.schema(_COMMITS).parquet(*paths)
        start = commits.groupBy("term").agg(F.max(F.when(~F.col("adds"), F.col("version"))).alias("start"))
        kept = commits.join(start, "term").where(F.col("start").isNull() | (F.col("version") >= F.col("start")))
        return kept.select("term", "version")

    def _versions_of(self, stage: str, search_term: str) -> list[str]:
        own = self.current(stage).where(F.col("term") == term_key(search_term))
        return sorted(row["version"] for row in own.collect())

    def paths(self, stage: str, search_term: str) -> list[str]:
        """Folders of what a term has in the stage; none where it has no rows."""
        found = [f"{self._stage(stage)}/version={v}/{_folder(term_key(search_term))}" for v in self._versions_of(stage, search_term)]
        return [p for p in found if self._exists(p)]

    def path(self, stage: str, search_term: str) -> str:
        """The latest folder of a term; FileNotFoundError if there is none."""
        found = self.paths(stage, search_term)
        if not found:
            raise FileNotFoundError(f"{self._stage(stage)} of {term_key(search_term)}")
        return found[-1]

    def clean(self, stage: str) -> None:
        """Remove versions of which no term needs anything any more; not while others read them."""
        needed = {row["version"] for row in self.current(stage).select("version").distinct().collect()}
        for version in self.versions(stage):
            if version not in needed:
                for folder in (f"_commits/{version}", f"_terms/v{version}", f"version={version}"):
                    at, files = self._files(f"{self._stage(stage)}/{folder}")
                    files.delete(at, True)

    # Reading

    def _none(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def read(self, stage: str, search_term: str) -> DataFrame:
        """Rows of one search term, with the columns of the stage."""
        schema, paths = STAGES[stage], self.paths(stage, search_term)
        if not paths:
            return self._none(schema)
        return self._rows(stage, paths, schema).select(*schema.names)

    def _rows(self, stage: str, paths: Sequence[str], schema: T.StructType, kind: str = "parquet") -> DataFrame:
        """The files of some folders of a stage, with ``version`` and ``search_term`` as they were written."""
        names = T.StructType([*schema.fields, T.StructField("version", T.StringType()), T.StructField("search_term", T.StringType())])
        return self.spark.read.schema(names).option("basePath", self._stage(stage)).format(kind).load(list(paths))

    def read_terms(self, stage: str, terms: DataFrame) -> DataFrame:
        """Rows of all ``terms(term)``, with ``search_term``, in one plan.

        Term and version are partition columns, which the join with the wanted ones prunes.
        """
        schema = STAGES[stage]
        return self._of_terms(terms, stage, schema, "parquet").select("search_term", *schema.names)

    def _of_terms(self, terms: DataFrame, stage: str, schema: T.StructType, kind: str) -> DataFrame:
        wanted = durable(self.current(stage).join(terms.select("term").distinct(), "term").withColumnRenamed("term", "search_term"))
        roots = [f"{self._stage(stage)}/version={v}" for v in self.versions(stage)]
        roots = [r for r in roots if self._exists(r)]
        if not roots:
            return self._none(T.StructType([*schema.fields, T.StructField("search_term", T.StringType())]))
        # The condition, always true, is what lets the planner prune by this side of the join.
        chosen = broadcast_if_small(wanted.where(F.col("version") > ""))
        return self._rows(stage, roots, schema, kind).join(chosen, ["version", "search_term"])

    def read_links(self, search_term: str) -> DataFrame:
        """``(search_term, url)``, stripped, in any order."""
        paths, key = self.paths("links", search_term), F.lit(term_key(search_term)).alias("search_term")
        if not paths:
            return self._none(_LINES).select(key, F.col("value").alias("url"))
        return self._rows("links", paths, _LINES, "text").select(key, F.trim("value").alias("url"))

    def read_links_of(self, terms: DataFrame) -> DataFrame:
        """``(search_term, url)`` of all ``terms(term)`` in one plan."""
        return self._of_terms(terms, "links", _LINES, "text").select("search_term", F.trim("value").alias("url"))

    def known(self, stage: str, search_term: str, slices: Sequence[str]) -> DataFrame:
        """The fingerprints a term has stored in the given ranges of fingerprints."""
        key, paths = SLICED[stage], self.paths(stage, search_term)
        if not paths:
            return self._none(T.StructType().add(key, "string"))
        schema = T.StructType().add(key, "string").add("slice", "string")
        return self._rows(stage, paths, schema).where(F.col("slice").isin(list(slices))).select(key)

    def available(self, stage: str, search_term: str) -> bool:
        """Is there a stored result with rows of this stage for the term?"""
        rows = self.read_links(search_term) if stage == "links" else self.read(stage, search_term)
        return not rows.isEmpty()

    def open_index(self, search_term: str) -> tuple[DataFrame, DataFrame]:
        """Posting and paragraph tables; FileNotFoundError when there is no index."""
        if not self.available("index/postings", search_term):
            raise FileNotFoundError(f"{self._stage('index/postings')} of {term_key(search_term)}")
        return self.read("index/postings", search_term), self.read("index/paragraphs", search_term)

    # Writing

    def _terms(self, search_term: str) -> DataFrame:
        return self.spark.createDataFrame([(term_key(search_term),)], "term string")

    def _one(self, search_term: str, stage: str, adds: bool, write) -> None:
        """One term's rows, written by ``write(folder)``."""
        version = self._new_version()
        write(f"{self._stage(stage)}/version={version}/{_folder(term_key(search_term))}")
        self._commit(stage, version, self._terms(search_term), adds)

    def _typed(self, df: DataFrame, stage: str) -> list[Column]:
        return [F.col(f.name).cast(f.dataType).alias(f.name) for f in STAGES[stage]]

    def write(self, df: DataFrame, search_term: str, stage: str, adds: bool = False) -> None:
        """Evenly sized files, whatever the size of the search term; no rows leave none behind.

        Stages with fingerprints are divided by ranges of them, and sorted within.
        """
        rows = df.select(*self._typed(df, stage))
        if stage not in SLICED:
            self._one(search_term, stage, adds, lambda folder: rows.hint("rebalance").write.parquet(folder))
            return
        sliced = rows.withColumn("slice", slice_of(stage)).hint("rebalance", "slice").sortWithinPartitions("slice", SLICED[stage])
        self._one(search_term, stage, adds, lambda folder: sliced.write.partitionBy("slice").parquet(folder))

    def write_terms(self, df: DataFrame, terms: DataFrame, stage: str, adds: bool = False) -> None:
        """Rows of many terms (``search_term``) in one version; ``terms(term)`` without rows have none after it."""
        version = self._new_version()
        rows = df.select(*self._typed(df, stage), term_column("search_term").alias("search_term"))
        by = ["search_term"]
        if stage in SLICED:
            rows, by = rows.withColumn("slice", slice_of(stage)), ["search_term", "slice"]
        rows = rows.hint("rebalance", *by).sortWithinPartitions(*by, *([SLICED[stage]] if stage in SLICED else []))
        rows.write.partitionBy(*by).parquet(f"{self._stage(stage)}/version={version}")
        self._commit(stage, version, terms.select("term").distinct(), adds)

    def write_sorted(self, df: DataFrame, search_term: str, stage: str, *order: str) -> None:
        """Rows dealt by ranges of ``order`` and sorted by it, so that file statistics tell where a value lies."""
        rows = df.select(*self._typed(df, stage)).repartitionByRange(*order).sortWithinPartitions(*order)
        self._one(search_term, stage, False, lambda folder: rows.write.parquet(folder))

    def write_links(self, links: DataFrame, search_term: str, *order: str, adds: bool = False) -> None:
        """One URL per line, in the given order."""
        lines = (links.orderBy(*order) if order else links).select(F.col("url").alias("value"))
        self._one(search_term, "links", adds, lambda folder: lines.write.text(folder))

    def write_links_of(self, links: DataFrame, terms: DataFrame, *order: str) -> None:
        """``write_links`` of all ``terms(term)`` at once."""
        version = self._new_version()
        rows = links.withColumn("search_term", term_column("search_term"))
        rows = rows.repartitionByRange("search_term", *order).sortWithinPartitions("search_term", *order)
        rows.select(F.col("url").alias("value"), "search_term").write.partitionBy("search_term").text(f"{self._stage('links')}/version={version}")
        self._commit("links", version, terms.select("term").distinct(), False)

    def write_index(
        self, postings: DataFrame, paragraphs: DataFrame, search_term: str, stop: DataFrame | None = None
    ) -> None:
        """Posting and paragraph tables, and the terms of the headings without the words of ``stop(term)``.

        Terms are sorted, so that a search reads the ranges of files that hold the terms it looks for.
        """
        self.write(postings, search_term, "index/postings")
        self.write(paragraphs, search_term, "index/paragraphs")
        stored = self.read("index/paragraphs", search_term)
        terms = I.heading_terms(stored, ["posting_id", "paragraph_number"], "paragraph_heading", stop)
        # A term of very many headings is divided by their keys.
        self.write_sorted(terms, search_term, "index/terms", "term", "posting_id", "paragraph_number")
        terms = self.read("index/terms", search_term)
        self.write_sorted(I.term_stats(terms).select("term", "df"), search_term, "index/vocabulary", "term")
        counts = I.index_counts(self.read("index/postings", search_term), stored)
        tokens = terms.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
        # One row each.
        self.write(counts.crossJoin(F.broadcast(tokens)), search_term, "index/statistics")

    def write_family(self, parents: DataFrame, children: DataFrame, search_term: str, stages: Sequence[str], key: str) -> None:
        """Parents and children in equally many buckets of ``key``, one file each, sorted by it.

        As many as keep a bucket of the larger side near ``BUCKET_BYTES``.
        """
        parents, children = (durable(df.select(*self._typed(df, s))) for df, s in zip((parents, children), stages, strict=True))
        count = 1 + max(value_bytes(parents), value_bytes(children)) // BUCKET_BYTES
        for df, stage in zip((parents, children), stages, strict=True):
            rows = df.repartition(count, key).write.format("parquet").bucketBy(count, key).sortBy(key)
            name = f"vakanz_{uuid.uuid4().hex}"
            self._one(search_term, stage, False, lambda folder, rows=rows, name=name: rows.option("path", f"{folder}/of-{count}").saveAsTable(name))
            self.spark.sql(f"DROP TABLE {name}")  # the files stay where they are

    def read_family(self, search_term: str, stages: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
        """What ``write_family`` wrote, as views of the session that know their buckets: a join on ``key`` moves no rows."""
        found = []
        for stage in stages:
            at, files = self._files(self.path(stage, search_term))
            folder = next(n for f in files.listStatus(at) if (n := f.getPath().toString()).rpartition("/")[2].startswith("of-"))
            name, count = f"vakanz_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}", folder.rpartition("-")[2]
            quoted = folder.replace("'", "\\'")
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STAGES[stage])
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {count} BUCKETS LOCATION '{quoted}'"
            )
            found.append(self.spark.table(name))
        return found[0], found[1]

    def export_postings(self, postings: DataFrame, search_term: str) -> None:
        """Readable postings, each introduced by its file name; any number per file."""
        text = F.concat_ws("\n", export_name(), posting_text())
        rows = postings.select(text.alias("value")).hint("rebalance")
        self._one(search_term, "exports", False, lambda folder: rows.write.text(folder))

    def write_reports(self, reports: DataFrame, search_term: str, names: Iterable[str]) -> str:
        """Report lines (``report``, ``line_no``, ``value``) as text, a folder ``report=`` for each name.

        Every named report is replaced, one without lines by an empty one; others are carried over.
        """
        names, before = list(names), self.paths("reports", search_term)
        old = {n: f"{before[-1]}/report={n}" for n in REPORT_NAMES if before and n not in names}

        def write(folder: str) -> None:
            for name in names:
                lines = reports.where(F.col("report") == name).orderBy("line_no").select("value")
                lines.write.text(f"{folder}/report={name}")
            for name, path in old.items():
                if self._exists(path):
                    self.spark.read.text(path).write.text(f"{folder}/report={name}")

        self._one(search_term, "reports", False, write)
        return self.path("reports", search_term)


#: The names of the reports, by their numbers.
REPORT_NAMES = ("index_info", "task_frequency", "requirements_frequency", "benefits_frequency")


def export_name() -> Column:
    return file_name(F.col("title"), F.col("posting_id"))
