import glob
import random
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plansight.llm import near_dup
from plansight.llm.common import run_folder, written
from plansight.session import CLEAN_UP, stored


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_shuffle_files_go_with_the_write(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEAN_UP, None)
    tables = [write(spark.range(100_000).groupBy((F.col("id") % 5003).alias("k")).count())
              for write in (lambda df: written(df, run_folder(spark, "gone")), stored)]
    end = time.time() + 20  # files go in the background
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(CLEAN_UP, None) == setting
    assert [t.count() for t in tables] == [5003, 5003]


def test_long_rows_share_no_row_group(spark):
    """A reader takes a row group, a writer a page, as a whole."""
    path = run_folder(spark, "packed")
    long = spark.createDataFrame([(i, random.Random(i).randbytes(3_000_000)) for i in range(12)], "id long, blob binary").coalesce(1)
    assert written(long, path, packed=True).count() == 12
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet")]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 4


def test_near_duplicates_leave_only_what_is_read(spark, docs_of):
    """Sets, buckets and pairs are on disk no longer when the result is read."""
    near_dup_folders = lambda: set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/near-*/*"))
    seen = near_dup_folders() if spark.conf.get("spark.checkpoint.dir", None) else set()
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:39], f"x{i}"])) for i in range(6)] + [(9, "another text")]
    out = {r["doc_id"]: r["component_id"] for r in near_dup.report(docs_of(rows)).collect()}
    assert out == dict.fromkeys(range(6), 0) | {9: 9}
    assert {f.rsplit("/", 1)[1].split("-")[0] for f in near_dup_folders() - seen} == {"signed", "groups", "components"}


def test_few_texts_travel_to_the_join_with_nodes(spark):
    """The mask loses no node and keeps few other texts."""
    texts = spark.range(-5000, 20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    nodes = texts.where("doc_id % 10 = 0").select(F.col("doc_id").alias("node"))
    got = {r["doc_id"] for r in near_dup.thinned(texts, nodes).collect()}
    assert got >= {i for i in range(-5000, 20_000) if i % 10 == 0} and len(got) < 2_600
