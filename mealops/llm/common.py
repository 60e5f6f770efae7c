"""What the text operators share: words, folds, bounded labelled samples, hashed words.

Words are maximal runs of bytes outside space, tab, line feed, vertical tab, form feed and
carriage return; the Spark and the Python form agree byte for byte.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def session(spark: SparkSession) -> SparkSession:
    """Arrow batches bounded in rows and bytes, so that long texts cannot fill a worker."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def is_held_out(doc_id: Column) -> Column:
    """The fifth of the documents no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out fold,
    the ones with the smallest id hashes. The id list is at most ``rows`` longs, so it is
    broadcast and the texts are filtered where they are read, without a shuffle."""
    picked = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()
                            & ~is_held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def plain(word: bytes) -> bytes:
    return word


def stripped(word: bytes) -> bytes:
    """Without punctuation at its ends; punctuation alone stays."""
    return word.strip(b".,;:!?\"'()[]{}*#$%&|<>-_") or word


class WordHashes(dict):
    """64-bit hashes of words, the first ``limit`` different ones remembered."""

    def __init__(self, form=plain, limit: int = 400_000):
        self.form, self.limit = form, limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(self.form(word))
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, text: bytes | None, lower: bool = True) -> np.ndarray:
        found = ((text or b"").lower() if lower else (text or b"")).split()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words; fewer words make one run, none make none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out ^ h[i:len(h) - n + 1 + i], i)
    return out


def texts(batch, column: str = "text") -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa
    return batch.column(column).cast(pa.binary()).to_pylist()


_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_CLASS = bytes(ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57
               else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in range(256))


def shape(word: bytes) -> bytes:
    """Letter case, digits and symbols of a word with runs collapsed: ``Abc!!`` is ``Aa!``."""
    return _RUNS.sub(rb"\1", word.translate(_CLASS))
