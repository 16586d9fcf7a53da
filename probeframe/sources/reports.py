"""Files of benchmark runs: summaries, resource samples, results, and profiler databases."""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CPU_SAMPLES, GPU_SAMPLES = "epoch_s double, rss_mb double", "epoch_s double, memory_used_mb double"


def read_summaries(spark: SparkSession, glob: str, section: str) -> DataFrame:
    """(batch_size, the fields of one section) of summary JSON files; files without the section give nulls, and an unknown section one
    null column of its name."""
    rows = spark.read.option("multiLine", True).json(glob)
    if section not in rows.columns:
        return rows.select("batch_size", F.lit(None).cast("string").alias(section))
    return rows.select("batch_size", f"{section}.*")


def read_samples(spark: SparkSession, path: str, schema: str = CPU_SAMPLES) -> DataFrame:
    """Rows of sample CSV files with a header; samples of -1 (the sampler failed) become null."""
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.select("epoch_s", *[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in rows.columns if c != "epoch_s"])


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends rows to a folder of CSV files, each with its header, so that a reader sees one table however often it grew."""
    rows.write.mode("append").option("header", True).csv(path)


def write_results(checks: DataFrame, path: str) -> None:
    """One JSON document from rows (name, ok, and any others): the list of tests, and how many passed and failed. A report of a test
    run: its list is meant to be read by people."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    tests = F.array_sort(F.collect_list(F.struct("name", *[c for c in checks.columns if c != "name"]))).alias("tests")
    checks.agg(tests, F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed")).coalesce(1).write.mode("overwrite").json(path)


def read_sqlite(spark: SparkSession, path: str, select: str, schema: str) -> DataFrame:
    """Rows of a SELECT over SQLite files, a task for each file, in batches. The files are fetched by Spark, so any store will do."""
    if not select.lstrip().upper().startswith("SELECT"):
        raise ValueError("the query must start with SELECT")
    kinds = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kinds)
        for b in batches:
            for content in b.column(0):
                with tempfile.TemporaryDirectory() as folder:
                    name = os.path.join(folder, "db")
                    with open(name, "wb") as f:
                        f.write(content.as_buffer())
                    db = sqlite3.connect(name)
                    found = db.execute(select)
                    while rows := found.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
                    db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def profiler_windows(spark: SparkSession, path: str, like: str) -> DataFrame:
    """(name, lo, hi) of the marked ranges whose text is like a pattern; the text stands in the row or in the table of strings."""
    rows = read_sqlite(spark, path, 'SELECT coalesce(e.text, s.value), e.start, e."end" FROM NVTX_EVENTS e LEFT JOIN StringIds s ON s.id = e.textId WHERE e."end" IS NOT NULL', "name string, lo long, hi long")
    return rows.where(F.col("name").like(like))


def profiler_kernels(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, duration) of the finished kernels; a name that the table of strings lacks is its id."""
    return read_sqlite(spark, path, 'SELECT coalesce(s.value, CAST(k.shortName AS TEXT)), k.start, k."end" - k.start FROM CUPTI_ACTIVITY_KIND_KERNEL k LEFT JOIN StringIds s ON s.id = k.shortName WHERE k."end" IS NOT NULL', "name string, start long, duration long")


def profiler_copies(spark: SparkSession, path: str) -> DataFrame:
    """(kind, start, duration, bytes) of the finished copies."""
    return read_sqlite(spark, path, 'SELECT copyKind, start, "end" - start, bytes FROM CUPTI_ACTIVITY_KIND_MEMCPY WHERE "end" IS NOT NULL', "kind long, start long, duration long, bytes long")
