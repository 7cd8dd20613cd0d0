"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

DataFrame functions alone. Documents come in batches. A batch's distinct lines are hashed and counted
by document, merge-anti-joined with the lines that the runs already know to be common, and what is left
is added as a sorted run of its own. Whenever ``FAN`` runs stand on a level they are compacted into one
run of the next level, which adds up their counts. A line that a third of all documents hold is thus
counted until it is common and is in no later run.

A run is a table of 128-bit hashes with counts, bucketed by the hash and sorted in each bucket, so a batch
meets the runs without a shuffle of theirs; compaction deals their rows out by hash. Lines that are
common in the end are found in the documents again: only their positions travel, and texts travel once,
to meet the positions to drop.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionloom.session import ensure_checkpoint_dir

#: documents that make a line common, the least code points of such a line, runs of a level
DOCUMENTS, LEAST, FAN = 10, 1, 3
#: common lines (two numbers each) that may be broadcast
BROADCAST_LINES = 1 << 20
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["high", "low"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def key_of(line: Column) -> Column:
    """A line as it is compared: without white space around it, A-Z in lower case."""
    return F.translate(stripped(line), UPPER, LOWER)


def hashes(value: Column, names: list[str]) -> list[Column]:
    """128 bits of a text, as two numbers."""
    return [F.xxhash64(F.lit(seed), value).alias(name) for seed, name in enumerate(names)]


@contextmanager
def unions_dealt_anew(spark: SparkSession) -> Iterator[None]:
    """Inside, what groups a union of bucketed tables shuffles it.

    Spark 4.1 takes such a union for bucketed as well, and even leaves out a repartition; but where the
    tables are read by column batches their buckets only follow each other, so equal keys would not meet.
    """
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@dataclass
class LineRuns:
    """The lines of all documents added so far: on each level, the names of its runs."""

    spark: SparkSession
    documents: int = DOCUMENTS
    least: int = LEAST
    fan: int = FAN
    levels: list[list[str]] = field(default_factory=list)

    def add(self, texts: DataFrame, text: str = "text") -> None:
        """Count a batch of documents, one a row; a line counts once in each.

        Null and empty texts hold an empty line, which is never common; repeated rows are documents
        each; a batch without rows adds nothing.
        """
        keys = F.array_distinct(F.transform(lines_of(F.col(f"`{text}`")), key_of))
        lines = texts.select(F.explode(keys).alias("key")).where(F.char_length("key") >= self.least)
        found = lines.select(*hashes(F.col("key"), HASH)).groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"))
        for run in [r for level in self.levels for r in level]:
            common = self.spark.table(run).where("common").select(*HASH)
            found = found.join(common.hint("merge"), HASH, "left_anti")
        self._put(found.withColumn("common", F.col("docs") >= self.documents), 0)

    def _put(self, rows: DataFrame, level: int) -> None:
        """Store a run on a level, and compact the level when it is full."""
        name = f"line_run_{uuid4().hex}"
        # as many buckets as the shuffle has partitions: a bucket is one sorted file
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{ensure_checkpoint_dir(self.spark)}/{name}"
        rows.write.format("parquet").option("path", path).partitionBy("common").bucketBy(buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            full, self.levels[level] = self.levels[level], []
            with unions_dealt_anew(self.spark):
                self._put(self._merged(full), level + 1)
            self._forget(full)

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self.spark.table(r) for r in runs])
        known = F.max("common") | (F.sum("docs") >= self.documents)
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), known.alias("common"))

    def _forget(self, runs: list[str]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE {r}")

    def common(self) -> DataFrame:
        """The hashes of all common lines, stored; the runs' names are given up."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], "high long, low long")
        with unions_dealt_anew(self.spark):
            out = self._merged(runs).where("common").select(*HASH).checkpoint()
        self._forget(runs)
        self.levels = []
        return out


def without_lines(docs: DataFrame, common: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` (long) and ``kept``, its text without common lines.

    ``common`` has the hashes of lines to drop (``high``, ``low``), each once. A null text is one empty
    line, and its ``kept`` is empty. All other columns come back as they were; columns of those three
    names give way. Repeated rows come back each time; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    whole = F.col(f"`{text}`")
    of_text = ["text_high", "text_low"]
    few = common.count() <= BROADCAST_LINES
    lines = docs.select(*hashes(whole, of_text), F.posexplode(lines_of(whole)).alias("at", "line"))
    keyed = lines.where(F.char_length(stripped(F.col("line"))) >= least).select(*of_text, "at", *hashes(key_of(F.col("line")), HASH))
    hits = keyed.join(F.broadcast(common) if few else common, HASH)
    # equal texts lose the same lines; stored, as a text that very many rows share is split in the join
    # only if neither side of it comes straight from an aggregation
    drops = hits.groupBy(*of_text).agg(F.array_sort(F.collect_set("at")).alias("drop")).checkpoint()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *hashes(whole, of_text)).join(drops, of_text, "left")
    of_row = F.col("row").getField(text)
    rows = rows.withColumn("lines", lines_of(of_row))

    def piece(i: Column) -> Column:
        """The lines between the dropped ones number i - 1 and i."""
        begins = F.when(i == 0, 0).otherwise(F.get("drop", i - 1) + 1)
        return F.slice("lines", begins + 1, F.coalesce(F.get("drop", i), F.size("lines")) - begins)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("drop")), piece)), "\n")
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept")]
    out = F.struct(
        *others,
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.coalesce(of_row, F.lit(""))).otherwise(left).alias("kept"),
    )
    return rows.select(out.alias("out")).select("out.*")


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """A table that was read from files, dealt into at most ``n`` batches of whole files, so that each
    file is read in one of them."""
    n = min(n, len(docs.inputFiles()))
    if n < 2:
        return [docs]
    dealt = F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(n))
    return [docs.where(dealt == i) for i in range(n)]


def drop_common(docs: DataFrame, batches: list[DataFrame], text: str = "text", documents: int = DOCUMENTS, least: int = LEAST, fan: int = FAN) -> DataFrame:
    """``without_lines`` of ``docs`` for the lines that at least ``documents`` rows of the batches hold."""
    runs = LineRuns(docs.sparkSession, documents, least, fan)
    for batch in batches:
        runs.add(batch, text)
    return without_lines(docs, runs.common(), text, least)
