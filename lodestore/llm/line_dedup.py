"""Line deduplication over levelled sorted runs of line hashes.

A :class:`LineRuns` index holds runs: tables of (128-bit line hash, documents counted so far), bucketed and sorted by
hash under a folder with a manifest, so a later job can open them again. A new batch is counted per hash and merged with each run
bucket by bucket: the runs are neither shuffled nor aggregated again. Hashes that a run holds as frequent are anti-joined away;
the others become a run of level 0 with their counts so far added, so a hash is frequent if any run says so.
When ``fanout`` runs of a level stand, they are merged into one run of the next level, so each hash is rewritten once a level.

A null or empty text is one empty line; empty keys (white space only) never count. Every row counts
as a document of its own, repeated rows too, a line twice in one document counts once. An empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, dropped, joined_small, let, listed, lower_ascii, saved, shared_dir

#: White space that is stripped from both ends of a line: space and 0x09-0x0D.
SPACE = " \t\n\x0b\x0c\r"
MIN_DOCS = 10


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


#: Stands for a null doc_id where rows are matched.
NO_ID = -(1 << 63)


def row_key(docs: DataFrame) -> DataFrame:
    """(_d, _t) name a row: its doc_id and a hash of its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), "doc_id", "text")


def line_hashes(docs: DataFrame) -> DataFrame:
    """(_d, _t, _pos, _a, _b) of every line with a key; numbers only, so texts are not carried along."""
    lines = row_key(docs).select("_d", "_t", F.posexplode_outer(text_lines(F.col("text"))).alias("_pos", "_line"))
    keyed = lines.select("_d", "_t", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") > 0)
    return keyed.select("_d", "_t", "_pos", F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit(1), F.col("_key")).alias("_b"))


class LineRuns:
    """Levelled runs of line hashes with document counts, kept under a folder.

    ``levels`` names the runs, the newest last. Each run is a table of ``buckets`` sorted buckets; the manifest, a new version after every
    change, says which runs stand.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = 4, root: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = root or f"{shared_dir(spark)}/lodestore-runs-{uuid.uuid4().hex[:12]}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.levels = 0, []

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LineRuns:
        """The runs that stand under a folder, as the last complete version of the manifest has them."""
        versions = sorted(v for v in listed(f"{root}/manifest") if "_SUCCESS" in listed(f"{root}/manifest/{v}"))
        told = json.loads(spark.read.text(f"{root}/manifest/{versions[-1]}").first()["value"])
        out = cls(spark, told["min_docs"], told["fanout"], root)
        out.version, out.buckets, out.levels = int(versions[-1]), told["buckets"], told["levels"]
        for name in out.names():
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (_a BIGINT, _b BIGINT, _n BIGINT) USING parquet CLUSTERED BY (_a, _b) SORTED BY (_a, _b) INTO {out.buckets} BUCKETS LOCATION '{root}/{name}'"
            )
        return out

    def close(self, delete_files: bool = False) -> None:
        """Forget the tables; with delete_files, the folder too."""
        for name in self.names():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if delete_files:
            delete(self.root)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def runs(self) -> list[DataFrame]:
        """The runs as bucketed tables: to be joined bucket by bucket."""
        return [self.spark.table(name) for name in self.names()]

    def rows(self, names: list[str]) -> DataFrame:
        """The rows of some runs as plain files. A union of bucketed tables may claim a partitioning that it has not, so it must not be aggregated."""
        return self.spark.read.schema("_a long, _b long, _n long").parquet(*[f"{self.root}/{name}" for name in names])

    def _write(self, run: DataFrame) -> str:
        name = f"lodestore_run_{uuid.uuid4().hex[:12]}"
        run.select("_a", "_b", "_n").write.format("parquet").bucketBy(self.buckets, "_a", "_b").sortBy("_a", "_b").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _tell(self) -> None:
        self.version += 1
        told = json.dumps({"min_docs": self.min_docs, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels})
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{self.root}/manifest/{self.version:08d}")

    def frequent(self) -> DataFrame:
        """Hashes of lines in min_docs documents or more; each stands in one run with its full count at the time, and in no later one."""
        if not self.names():
            return self.spark.createDataFrame([], "_a long, _b long")
        return self.rows(self.names()).where(F.col("_n") >= self.min_docs).select("_a", "_b")

    def merged(self, own: DataFrame) -> DataFrame:
        """A batch's counts (_a, _b, _n) with those of the runs added; hashes that a run holds as frequent are gone."""
        for run in self.runs():
            before = run.select("_a", "_b", F.col("_n").alias("_run"))
            own = own.join(before, ["_a", "_b"], "left").withColumn("_before", F.greatest(F.coalesce("_run", F.lit(0)), F.coalesce(*(["_before"] if "_before" in own.columns else []), F.lit(0)))).drop("_run")
        if "_before" not in own.columns:
            return own
        return own.where(F.col("_before") < self.min_docs).select("_a", "_b", (F.col("_n") + F.col("_before")).alias("_n"))

    def add(self, hashes: DataFrame, repeats: DataFrame | None = None) -> None:
        """Add a batch: (_d, _t, _a, _b), any number of rows a line; no document may be in two batches.

        repeats (_d, _t, _more) says how many further rows there are of a document that stands in more than one.
        """
        own = hashes.select("_d", "_t", "_a", "_b").distinct()
        if repeats is None:
            own = own.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
        else:
            more = joined_small(own, repeats, ["_d", "_t"], "left")
            own = more.groupBy("_a", "_b").agg((F.count("*") + F.coalesce(F.sum("_more"), F.lit(0))).alias("_n"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(self.merged(own)))
        old = self._compact()
        self._tell()
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(f"{self.root}/{name}")

    def _united(self, names: list[str]) -> DataFrame:
        """The rows of some runs, merged bucket by bucket: full outer joins of tables that are bucketed alike exchange nothing."""
        first, *rest = (self.spark.table(name).select("_a", "_b", "_n") for name in names)
        for run in rest:
            first = first.join(run.withColumnRenamed("_n", "_run"), ["_a", "_b"], "full_outer").select("_a", "_b", F.greatest("_n", "_run").alias("_n"))
        return first

    def _compact(self) -> list[str]:
        """Merge full levels; the runs that no longer stand."""
        old: list[str] = []
        for depth in range(len(self.levels)):
            full = self.levels[depth]
            if len(full) >= self.fanout:
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._write(self._united(full)))
                self.levels[depth] = []
                old += full
        return old

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Lines of a batch whose hash no run holds."""
        for run in self.runs():
            hashes = hashes.join(run.select("_a", "_b"), ["_a", "_b"], "left_anti")
        return hashes


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = 2, fanout: int = 2) -> DataFrame:
    """Each document with the lines that stand in ``min_docs`` documents or more taken out everywhere.

    Returns doc_id, n_lines, n_dropped, kept_text. The lines are hashed once into a scratch table; the
    runs are built from it in batches. Places of frequent lines go back to the documents as bitmaps,
    a 64-bit word for every 64 lines that hold any.
    """
    hashes = saved(line_hashes(docs), "line-hashes")
    repeats = saved(row_key(docs).groupBy("_d", "_t").agg((F.count("*") - 1).alias("_more")).where("_more > 0"), "line-repeats")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for batch in range(batches):
        runs.add(hashes.where(F.pmod(F.xxhash64("_d"), F.lit(batches)) == batch), repeats)
    frequent = saved(runs.frequent(), "line-frequent")
    runs.close(delete_files=True)
    words = (
        joined_small(hashes, frequent, ["_a", "_b"], "left_semi")
        .groupBy("_d", "_t", F.shiftright("_pos", 6).alias("_w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_bits"))
    )
    drops = words.groupBy("_d", "_t").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_map"), F.sum(F.bit_count("_bits")).alias("_n"))
    out = row_key(docs).join(drops, ["_d", "_t"], "left").withColumn("_lines", text_lines(F.col("text")))
    dense = F.expr("transform(sequence(0, shiftright(size(_lines) - 1, 6)), w -> coalesce(_map[w], 0L))")
    kept = let(dense, lambda words: F.array_join(F.filter("_lines", lambda _, i: F.get(words, F.shiftright(i, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) == 0), "\n"))
    return out.select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_n").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )
