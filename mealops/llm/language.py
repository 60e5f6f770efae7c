"""Language ID: rank-order profiles of character n-grams.

A profile is the ``TOP`` most frequent n-grams (one to three letters, words bounded by blanks)
of a language's training documents in rank order. A document is ranked the same way and
compared with each profile by out-of-place distance: how far each of its n-grams stands from
its place in the profile, ``TOP`` where it is missing. N-gram counts cover every training
document and are summed in Spark. The profiles are a written table; blocks of ``BLOCK``
languages are gathered and compared in turn, and the least distance over the blocks counts, so
any number of languages will do and a pass holds one block.

Defined results: a NULL text, one without letters, or any text when nothing was learned is
``und`` with score 0; ties go to the first language by name; equal texts agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running_totals
from ..sources.sinks import stage_shared
from .common import is_held_out

TOP = 400
BLOCK = 500
_NOT_LETTERS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
_PART = 1 << 20  # letters counted at once


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of lower-cased letter runs, as 21 bits a character, and their counts."""
    letters = " ".join(_NOT_LETTERS.split((text or "").lower())).strip()
    if not _LETTER.search(letters):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    # blanks alone say nothing; a three-gram must not span two words
    return np.unique(np.concatenate([c[c != 32], two, three[c[1:-1] != 32]]), return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray, n: int = TOP) -> np.ndarray:
    """The most frequent n-grams in rank order, ties by code."""
    if len(grams) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        kept = counts >= least
        grams, counts = grams[kept], counts[kept]
    return grams[np.lexsort((grams, -counts))][:n]


def profiles(docs: DataFrame, top_n: int = TOP, block: int = BLOCK) -> DataFrame:
    """(block, lang, gram, place) staged: each language's profile from all its documents outside
    the held-out fold; ``block`` numbers runs of that many languages by name."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                g = np.concatenate([p[0] for p in parts])
                k = np.concatenate([p[1] for p in parts])
                different, at = np.unique(g, return_inverse=True)
                yield pa.record_batch([pa.array([lang] * len(different), pa.string()), pa.array(different),
                                       pa.array(np.bincount(at, k).astype(np.int64))], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                g, k = ngrams(text)
                held.setdefault(lang, []).append((g, k))
                size += len(g)
                if size >= _PART:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    counted = (learn.select("lang", "text").mapInArrow(partial, "lang string, gram bigint, n bigint")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # a language is ranked over slices of its n-grams first, so that no task ranks a whole one
    order = [F.col("n").desc(), F.col("gram")]
    for key in (["lang", F.pmod("gram", F.lit(64))], ["lang"]):
        counted = (counted.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
                   .filter(F.col("_r") <= top_n))
    known = stage_shared(counted.select("lang", "gram", F.col("_r").alias("place")), "profiles")
    named = running_totals(known.select("lang").distinct(), [F.col("lang")], {}, number="_n")
    named = named.select("lang", F.floor((F.col("_n") - 1) / block).cast("int").alias("block"))
    return stage_shared(known.join(named, "lang"), "profile-blocks")


def loaded(known: DataFrame) -> dict[str, np.ndarray]:
    """The profiles of one block, languages in order of name."""
    rows = known.select("lang", "gram", "place").toPandas()
    return {lang: own.sort_values("place")["gram"].to_numpy(np.int64) for lang, own in sorted(rows.groupby("lang"))}


class Comparer:
    """Out-of-place distances of a document to all profiles at once."""

    def __init__(self, known: dict[str, np.ndarray], top_n: int = TOP):
        self.langs, self.top = list(known), top_n
        self.grams = np.unique(np.concatenate(list(known.values()) or [np.zeros(0, np.int64)]))
        self.place = np.full((len(self.grams) + 1, len(known)), -1, np.int64)  # the last row: in no profile
        for k, own in enumerate(known.values()):
            self.place[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def __call__(self, text: str | None) -> tuple[str, int, int] | None:
        """The nearest language, its distance and the largest possible one; None without letters."""
        own = top(*ngrams(text), self.top)
        if not len(own) or not self.langs:
            return None
        at = np.searchsorted(self.grams, own)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == own[at < len(self.grams)],
                                            at[at < len(self.grams)], len(self.grams))
        place = self.place[at]
        away = np.where(place < 0, self.top, np.abs(place - np.arange(len(own))[:, None])).sum(0)
        best = int(away.argmin())
        return self.langs[best], int(away[best]), self.top * len(own)


_NEAR = "struct<away:bigint,lang:string,most:bigint>"


def nearest(text: Column, known: dict[str, np.ndarray], top_n: int = TOP) -> Column:
    """struct(away, lang, most) of the nearest of the profiles, or NULL."""
    @F.arrow_udf(_NEAR)
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compare = Comparer(known, top_n)
        for batch in batches:
            found = [compare(t) for t in batch.to_pylist()]
            yield pa.array([f and {"away": f[1], "lang": f[0], "most": f[2]} for f in found],
                           pa.struct([("away", pa.int64()), ("lang", pa.string()), ("most", pa.int64())]))
    return language(text)


def predict(docs: DataFrame, known: DataFrame, top_n: int = TOP) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, 1 less the share of the largest distance.
    Each block of languages is one pass over the texts; between passes they are written."""
    last = known.agg(F.max("block")).first()[0] or 0
    row = docs.select(F.struct("*").alias("_row"), "text", F.lit(None).cast(_NEAR).alias("_near"))
    for k in range(last + 1):
        near = nearest(F.col("text"), loaded(known.filter(F.col("block") == k)), top_n)
        # the smaller distance, then the first name
        row = row.select("_row", "text", F.least("_near", near).alias("_near"))
        if k < last:
            row = stage_shared(row, "languages")
    return row.select("_row.*", F.coalesce("_near.lang", F.lit("und")).alias("lang_pred"),
                      F.when(F.col("_near").isNull(), 0.0).otherwise(1 - F.col("_near.away") / F.col("_near.most")).alias("lang_score"))
