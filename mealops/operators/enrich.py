"""Key-wise enrichment through a caller-supplied lookup (geocoder, route service)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import shared_path, stage, write_table
from .joins import join_null_safe


def fetch_missing(df: DataFrame, keys: list[str], fetch_fn: Callable[[pd.DataFrame], pd.DataFrame],
                  result: T.StructType, cache: DataFrame | None = None,
                  max_parallel: int | None = None, error: str | None = None) -> DataFrame:
    """Look up the distinct keys that the cache does not have.

    ``fetch_fn`` gets a batch of keys and returns the result columns for it in the same
    row order; a failing batch is asked again in halves down to the failing keys, which
    yield NULLs, so no key is lost. ``error`` names a column for the text of its failure (else NULL).
    ``max_parallel`` bounds concurrent callers of a rate-limited service.
    """
    todo = df.select(*keys).dropna(subset=keys).distinct()
    if cache is not None:
        todo = todo.join(cache, keys, "left_anti")
    return _ask(todo, fetch_fn, result, max_parallel, error)


def _ask(todo: DataFrame, fetch_fn: Callable[[pd.DataFrame], pd.DataFrame], result: T.StructType,
         max_parallel: int | None, error: str | None) -> DataFrame:
    if max_parallel:
        todo = todo.repartition(max_parallel)
    names = result.fieldNames()
    schema = T.StructType([*todo.schema.fields, *result.fields, *([T.StructField(error, T.StringType())] if error else [])])

    def answers(batch: pd.DataFrame) -> pd.DataFrame:
        found = fetch_fn(batch)[names].reset_index(drop=True)
        if len(found) != len(batch):
            raise ValueError("fetch_fn must return one row per key")
        return found.assign(**{error: None}) if error else found

    def parts(batch: pd.DataFrame) -> list[pd.DataFrame]:
        """The answers of a batch in pieces: one that fails is cut in two, a failing key stands alone."""
        try:
            return [answers(batch).astype(object)]  # whole numbers beside NULLs stay whole
        except Exception as e:
            if len(batch) == 1:
                return [pd.DataFrame({**{n: [None] for n in names}, **({error: [f"{type(e).__name__}: {e}"]} if error else {})}, dtype=object)]
        half = len(batch) // 2
        return parts(batch.iloc[:half].reset_index(drop=True)) + parts(batch.iloc[half:].reset_index(drop=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.reset_index(drop=True)
            try:
                found = answers(batch)
            except Exception:
                found = pd.concat(parts(batch), ignore_index=True)
            yield pd.concat([batch, found], axis=1)

    return todo.mapInPandas(run, schema)


def enrich_by_key(df: DataFrame, keys: list[str], fetch_fn: Callable[[pd.DataFrame], pd.DataFrame],
                  result: T.StructType, cache: DataFrame | None = None,
                  max_parallel: int | None = None) -> DataFrame:
    """Attach looked-up columns: one call per distinct key, failures NULL, rows kept.

    For a billable service use :func:`enrich_resumable`, which keeps the answers.
    """
    fetched = fetch_missing(df, keys, fetch_fn, result, cache, max_parallel)
    lookup = fetched if cache is None else cache.select(*fetched.columns).unionByName(fetched)
    return join_null_safe(df, lookup, keys)


# --- lookups that outlive a run -----------------------------------------------------------

_TASK_KEYS = 1_000  # keys that are worth a task of their own

_LEDGER = "batch int, folder string, asked bigint, failed bigint, finished timestamp"


def lookup_ledger(spark: SparkSession, store: str) -> DataFrame:
    """Finished batches of a store: one row for every folder of answers that counts."""
    try:
        return spark.read.schema(_LEDGER).parquet(f"{store}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def stored_answers(spark: SparkSession, store: str, keys: T.StructType, result: T.StructType) -> DataFrame:
    """One row per key asked so far: keys, result and ``error``; an answer goes before a failure."""
    schema = T.StructType([*keys.fields, *result.fields, T.StructField("error", T.StringType())])
    folders = sorted(r["folder"] for r in lookup_ledger(spark, store).select("folder").collect())
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{store}/answers/{f}" for f in folders])
    answer = F.struct(*result.fieldNames(), "error")
    best = rows.groupBy(*keys.fieldNames()).agg(F.min_by(answer, F.struct(F.col("error").isNotNull(), "error")).alias("_a"))
    return best.select(*keys.fieldNames(), "_a.*")


def fetch_resumable(df: DataFrame, keys: list[str], fetch_fn: Callable[[pd.DataFrame], pd.DataFrame],
                    result: T.StructType, store: str, batches: int = 16, max_parallel: int | None = None,
                    retry_failed: bool = False) -> DataFrame:
    """Answers for the distinct keys of ``df`` from a store folder that outlives the run.

    Keys the store lacks (with ``retry_failed`` also those that failed) are dealt by hash into
    ``batches``. Each batch is one job: its answers are written to a fresh folder, and only
    then does a row of the ledger name that folder. A run broken half-way is called again: no
    finished batch is asked twice, folders the ledger does not name are never read, and at most
    the broken batch repeats. Keys with a NULL part are not asked. One run at a time may write
    a store. Returns :func:`stored_answers` for the keys of ``df``."""
    spark = df.sparkSession
    key_schema = T.StructType([df.schema[k] for k in keys])
    wanted = df.select(*keys).dropna(subset=keys).distinct()
    known = stored_answers(spark, store, key_schema, result)
    done = known.filter(F.col("error").isNull()) if retry_failed else known
    todo = wanted.join(done, keys, "left_anti").withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int"))
    todo = stage(todo, shared_path(spark, "lookup"), partition_by=["_batch"])
    sizes = {r["_batch"]: r["count"] for r in todo.groupBy("_batch").count().collect()}  # at most `batches` rows
    for b in sorted(sizes):
        folder = f"batch{b:05d}-{uuid.uuid4().hex}"
        # the staged keys are few bytes, so a scan alone would leave them to one task
        tasks = max_parallel or min(spark.sparkContext.defaultParallelism, -(-sizes[b] // _TASK_KEYS))
        asked = _ask(todo.filter(F.col("_batch") == b).select(*keys), fetch_fn, result, tasks, "error")
        written = stage(asked, f"{store}/answers/{folder}")
        line = written.agg(F.lit(b).alias("batch"), F.lit(folder).alias("folder"), F.count(F.lit(1)).alias("asked"),
                           F.count("error").alias("failed"), F.current_timestamp().alias("finished"))
        write_table(line, f"{store}/ledger", mode="append")
    return wanted.join(stored_answers(spark, store, key_schema, result), keys)


def enrich_resumable(df: DataFrame, keys: list[str], fetch_fn: Callable[[pd.DataFrame], pd.DataFrame],
                     result: T.StructType, store: str, **kw) -> DataFrame:
    """Attach looked-up columns and ``error`` by :func:`fetch_resumable`; rows are kept."""
    return join_null_safe(df, fetch_resumable(df, keys, fetch_fn, result, store, **kw), keys)
