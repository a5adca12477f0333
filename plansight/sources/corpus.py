"""Code-corpus sources: file scan, line explode, fingerprints, derived corpus.

A corpus is ``files(repo, path, content)`` or, after S2, the line table
``code_lines(repo, path, line_no, text)``. Line windows downstream are all
partitioned by (repo, path), so a corpus is distributed by file once and
every later window reuses that distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default include / ignore rules of the corpus loader.
DEFAULT_INCLUDE = r"\.(ts|tsx|js|jsx|md)$|(^|/)package\.json$"
DEFAULT_EXCLUDE = r"(^|/)(node_modules|\.next|dist|build|\.git|coverage|conventions)/"
SOURCE_EXT = r"\.(ts|tsx|js|jsx)$"
SKIP_DIR_SUBSTRINGS = ["node_modules", "dist", "build"]


def scan_files(spark: SparkSession, root: str, include: str = DEFAULT_INCLUDE,
               exclude: str | None = DEFAULT_EXCLUDE, repo: str | None = None) -> DataFrame:
    """Read every file under ``root`` whole (one row per file).

    Glob rules become ``rlike`` filters on the path relative to ``root``;
    unreadable files are skipped by ``ignoreCorruptFiles``.
    """
    root = root.rstrip("/")
    df = (spark.read.format("text").option("wholetext", True)
          .option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
          .load(root)
          .select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content")))
    rel = F.regexp_replace(F.col("uri"), r"^(file:)?/*" + root.lstrip("/").replace(".", r"\.") + "/", "")
    df = df.select(F.lit(repo or root).alias("repo"), rel.alias("path"), "content")
    df = df.where(F.col("path").rlike(include))
    if exclude:
        df = df.where(~F.col("path").rlike(exclude))
    return df


def to_lines(files: DataFrame) -> DataFrame:
    """One row per line, 1-based ``line_no`` (split on ``\\n``)."""
    return files.select("repo", "path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")) \
        .select("repo", "path", (F.col("pos") + 1).cast("int").alias("line_no"), "text")


def to_files(lines: DataFrame) -> DataFrame:
    """Inverse of S2 for a line table: content re-assembled in line order.

    One row per file: the group is a single file, whose size is bounded by
    what a source file can hold, not by the corpus.
    """
    return (lines.groupBy("repo", "path")
            .agg(F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]),
                "\n").alias("content")))


def is_source_file(path_col="path"):
    """JS/TS extension and no node_modules / dist / build substring anywhere."""
    p = F.col(path_col)
    cond = p.rlike(SOURCE_EXT)
    for s in SKIP_DIR_SUBSTRINGS:
        cond = cond & ~p.contains(s)
    return cond


def fingerprints(files: DataFrame) -> DataFrame:
    """sha256 of each file's whole content."""
    return files.select("repo", "path", F.sha2("content", 256).alias("content_hash"))


def corpus_hash(fp: DataFrame) -> DataFrame:
    """One hash per repo over its files' ``path|hash`` entries.

    Two levels, so no group holds a whole repo: a hash per 1/4096 of the paths
    (by their md5), then a hash of those hashes in order.
    """
    entries = F.array_sort(F.collect_list(F.concat_ws("|", "path", "content_hash")))
    parts = fp.groupBy("repo", F.substring(F.md5("path"), 1, 3).alias("part")).agg(
        F.sha2(F.array_join(entries, "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.concat_ws("|", "part", "h")))
    return parts.groupBy("repo").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("corpus_hash"), F.sum("n").alias("n_files"))


def changed_files(current: DataFrame, previous_fp: DataFrame) -> DataFrame:
    """Files whose (path, hash) is not in the previous fingerprint table."""
    cur = fingerprints(current)
    return cur.join(previous_fp, ["repo", "path", "content_hash"], "left_anti")


# --- derived corpus over the given events table (FIXTURES.md 4.4) ----------

def derived_code_lines(raw_events: DataFrame) -> DataFrame:
    """Synthetic TS/TSX lines, one per given event, numbered per user file."""
    # lines are numbered first: the window exchanges no text
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = raw_events.select("event_id", "user_id", "event_type", F.row_number().over(w).cast("int").alias("line_no"))
    obj = (F.when(e.event_id % 4 == 0, "workflow").when(e.event_id % 4 == 1, "invoice")
           .when(e.event_id % 4 == 2, "member").otherwise("project"))
    q = F.lit("'")
    text = (F.when(e.event_type == "view",
                   F.concat(F.lit("track("), q, obj, F.lit("_viewed"), q, F.lit(", { "), obj,
                            F.lit("_id: x.id, user_id: u.id });")))
            .when(e.event_type == "click",
                  F.concat(F.lit("<button onClick={handleCreate"), F.upper(F.substring(obj, 1, 1)),
                           F.substring(obj, 2, 1 << 30), F.lit("}>")))
            .when(e.event_type == "signup", F.concat(F.lit("await prisma."), obj, F.lit(".create({ data });")))
            .when(e.event_type == "purchase",
                  F.concat(F.lit("app.post("), q, F.lit("/api/"), obj, F.lit("s"), q,
                           F.lit(", async (req, res) => {")))
            .otherwise(F.concat(F.lit("// track("), q, F.lit("legacy_"), obj, q, F.lit(")"))))
    prefix = (F.when(e.user_id % 4 == 0, "src/components/U").when(e.user_id % 4 == 1, "src/app/api/orders/U")
              .when(e.user_id % 4 == 2, "src/lib/U").otherwise("src/pages/U"))
    return e.select(
        F.concat(F.lit("repo"), (e.user_id % 5).cast("string")).alias("repo"),
        F.concat(prefix, e.user_id.cast("string"), F.lit(".tsx")).alias("path"),
        "line_no",
        text.alias("text"),
    )


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import read_table
    return derived_code_lines(read_table(spark, sf_dir, "events"))


def corpus_tables(spark: SparkSession, sf_dir: str):
    """(lines, files) of the derived corpus, each written once so every
    detector reuses them instead of re-deriving them from the events."""
    from ..session import spread, stored
    from .tables import read_table
    n = spread(spark)  # matching is heavy for its bytes: partitions are not merged by size
    raw = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    lines = stored(derived_code_lines(raw.repartition(n, "user_id")))  # a user's lines are a file: dealt once
    files = stored(to_files(lines.repartition(n, "repo", "path")))
    return lines, files
