"""Line deduplication with levelled sorted runs of line hashes (DataFrame functions only).

A run is a table of line keys sorted by hash: (a, b) = 128 bits of hash, the
number of documents that hold the line and the largest of their ids. The
index takes batches. A batch's keys are aggregated and merge-joined with the
runs: keys that no run knows (the anti join) enter as new lines, known ones
as increments; together they are the batch's own run on level 0. When a level
holds ``fanout`` runs they are compacted, summing increments, into one run of
the next level. Every run is a written table, so a lost executor costs a
re-read only.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are always kept; each row counts as a document, and
rows that repeat the kept document's id keep the line too; a null id is below
every other id; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, drop_folder, run_folder, written

NO_LINES = "array<struct<a:bigint,b:bigint>>"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_hashes(text: Column, min_chars: int) -> Column:
    """Per line its key's 128-bit hash, or null where the key is too short to be deduplicated."""
    def one(line: Column) -> Column:
        key = key_of(line)
        return F.when(F.char_length(key) >= min_chars,
                      F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))
    return F.transform(lines_of(text), one)


@dataclass
class LineIndex:
    """The levelled runs. ``folder`` lies in the shared folder of the session."""
    spark: SparkSession
    folder: str
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)
    made: int = 0

    def runs(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def _add(self, level: int, run: DataFrame) -> None:
        path = f"{self.folder}/run-{self.made}"
        self.made += 1
        written(run.sortWithinPartitions("a", "b"), path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._add(level + 1, compact(self.spark.read.parquet(*old)))
            for p in old:
                drop_folder(self.spark, p)

    def ingest(self, batch: DataFrame) -> None:
        """Add a batch: columns doc_id and lines (array of hashes)."""
        one = batch.select("doc_id", F.explode(F.array_distinct(F.filter("lines", lambda h: h.isNotNull()))).alias("h"))
        own = one.groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(
            F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        runs = self.runs()
        if runs is None:
            self._add(0, own.withColumn("new", F.lit(True)))
            return
        own = written(own, f"{self.folder}/batch")
        fresh = own.join(runs.hint("merge"), ["a", "b"], "left_anti").withColumn("new", F.lit(True))
        again = own.join(runs.hint("merge"), ["a", "b"], "left_semi").withColumn("new", F.lit(False))
        self._add(0, fresh.unionByName(again))

    def lines(self) -> DataFrame:
        """One row per line key over all runs."""
        return compact(self.runs())


def compact(runs: DataFrame) -> DataFrame:
    return runs.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"), F.max("new").alias("new"))


def index_lines(hashed: DataFrame, folder: str, batches: int = 4, fanout: int = 2) -> LineIndex:
    """Index a whole table in ``batches`` parts, by a hash of the id (rows of null id go with the first)."""
    index = LineIndex(hashed.sparkSession, folder, fanout)
    for i in range(batches):
        index.ingest(hashed.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    return index


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """Drop repeated lines: (doc_id, n_lines, n_dropped, kept). A line whose key is in ``min_docs`` documents or
    more stays only in the largest id that holds it."""
    spark = docs.sparkSession
    folder = run_folder(spark, "lines")
    hashed = written(docs.select("doc_id", line_hashes(F.col("text"), min_chars).alias("lines")), f"{folder}/hashed")
    index = index_lines(hashed, folder, batches)
    common = written(index.lines().where(F.col("docs") >= min_docs).select("a", "b", "last"), f"{folder}/common")
    one = hashed.select("doc_id", F.explode(F.array_distinct(F.filter("lines", lambda h: h.isNotNull()))).alias("h"))
    hits = (one.select("doc_id", F.col("h.a").alias("a"), F.col("h.b").alias("b")).join(common, ["a", "b"])
            .where(~F.col("doc_id").eqNullSafe(F.col("last"))))
    drops = hits.groupBy(F.col("doc_id").alias("id_")).agg(F.collect_set("a").alias("gone"))  # at most a document's lines
    texts = docs.select("doc_id", "text")
    kept = texts.join(drops, F.col("doc_id").eqNullSafe(F.col("id_")), "left").select("doc_id", "text", "gone")

    def stays(line: Column) -> Column:
        key = key_of(line)
        return (F.char_length(key) < min_chars) | ~F.array_contains(F.col("gone"), F.xxhash64(key))

    cut = kept.select("doc_id", lines_of(F.col("text")).alias("lines"), "gone").select(
        "doc_id", "lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)).alias("stay"))
    return cut.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
                      F.array_join("stay", "\n").alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
common AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.last AS gone FROM l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
