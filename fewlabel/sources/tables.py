"""Pool tables, retrieved sets, run metrics and predictions on disk."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_pool(pool: DataFrame, path: str, by: Sequence[str] = ("lang", "source"), mode: str = "append",
              files_per_key: int | None = 64) -> None:
    """Parquet laid out by language and dataset (and cell), so filters prune folders.

    Rows are first spread over ``files_per_key`` tasks per key by a salt, so that a dataset with a third of the rows
    still has many writers and no key has more files than that. With None every task writes its own rows.
    """
    if files_per_key:
        pool = (pool.withColumn("_salt", F.pmod(F.xxhash64(*pool.columns), F.lit(files_per_key)))
                .repartition(*[F.col(c) for c in by], F.col("_salt")).drop("_salt"))
    pool.write.mode(mode).partitionBy(*by).parquet(path)


def save_pool_batch(pool: DataFrame, path: str, batch: str, key: str, by: Sequence[str] = ("lang", "source"),
                    files_per_key: int | None = 64) -> None:
    """One named batch of a pool, below ``batch=`` folders of ``path``; writing it again replaces it as a whole.

    Rows whose ``key`` another batch already holds stay out, so a row that comes with two batches is stored once, with the
    batch that was written first. A null key is no match. A write that broke off is mended by writing the batch again. The other
    batches are read for their keys only. ``batch`` is letters, digits, ``.``, ``_`` and ``-``, and no column of ``pool``. Keys
    that repeat inside a batch stay as they are. One writer at a time: two at once do not see each other's keys.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"not a name for a batch: {batch!r}")
    if "batch" in pool.columns:
        raise ValueError("the pool has a column named batch")
    schema = pool.select(key).withColumn("batch", F.lit("")).schema
    try:
        held = pool.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    if held is not None:
        pool = pool.join(held.where(F.col("batch") != batch).select(key), key, "left_anti").select(*pool.columns)
    save_pool(pool, f"{path}/batch={batch}", by, "overwrite", files_per_key)


def load_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup_rows(hits: DataFrame, pool: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Hit ids to their pool columns."""
    return hits.join(pool.select(key, *columns), key)


def save_retrieved(rows: DataFrame, path: str, per_query: bool = False, order: str = "position") -> None:
    """JSON lines: one retrieved row each, or one query with its ordered rows each."""
    if per_query:
        cols = [c for c in rows.columns if c not in ("query_id", order)]
        packed = F.sort_array(F.collect_list(F.struct(order, *cols)))
        rows = rows.groupBy("query_id").agg(packed.alias("retrieved"))
    rows.write.json(path)


def save_runs(runs: DataFrame, path: str, keys: Sequence[str], mode: str = "append") -> None:
    """One JSON record of metrics below ``key=value`` folders."""
    runs.write.mode(mode).partitionBy(*keys).json(path)


def scan_runs(spark: SparkSession, path: str, metrics: str, keys: Sequence[str],
              pattern: str | None = None, files: str | None = None, multi_line: bool = False) -> DataFrame:
    """Metric records of a directory tree; the run key comes from the path, checkpoints are skipped.

    ``pattern`` has one group per key; by default keys are read from ``key=value`` folders.
    """
    options = {"recursiveFileLookup": True, "multiLine": multi_line}
    if files:
        options["pathGlobFilter"] = files
    raw = spark.read.schema(metrics).options(**options).json(path)
    # only what lies below the scanned folder names the run
    below = F.substring_index(F.col("_metadata.file_path"), path.rstrip("/").split("/")[-1], -1)
    rows = raw.withColumn("_path", below).where(~F.contains("_path", F.lit("checkpoint")))
    for i, k in enumerate(keys):
        found = (F.regexp_extract("_path", pattern, i + 1) if pattern
                 else F.regexp_extract("_path", rf"/{k}=([^/]+)/", 1))
        for _ in range(1 if pattern else 2):  # the path is percent-encoded, folder values once more; a plus is itself
            found = F.coalesce(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), found)
        rows = rows.withColumn(k, found)
    return rows.drop("_path")


def save_predictions(df: DataFrame, path: str) -> None:
    """id, raw, predicted, true as quoted CSV."""
    (df.select("id", "raw", "predicted", "true")
     .write.options(header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                    ignoreTrailingWhiteSpace=False, emptyValue="").csv(path))


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("id string, raw string, predicted int, true int")
            .options(header=True, quote='"', escape='"', multiLine=True, emptyValue="").csv(path))


def prediction_values(df: DataFrame, pred: str = "predicted") -> DataFrame:
    """Distinct predicted values."""
    return df.select(pred).distinct()


def save_splits(df: DataFrame, path: str, mode: str = "append") -> None:
    """Split rows as one table by ``dataset_name, split, n, rs``."""
    df.write.mode(mode).partitionBy("dataset_name", "split", "n", "rs").parquet(path)


def save_matrix(matrix: DataFrame, path: str) -> None:
    """Tab-separated report with ``None`` for missing cells; a report has few rows, hence one file."""
    matrix.coalesce(1).write.options(sep="\t", header=True, nullValue="None").csv(path)
