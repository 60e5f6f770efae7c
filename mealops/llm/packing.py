"""Packing: non-negative least squares over shallow length combinations.

A document's ids, with the end id 1, are cut into full windows and a rest. The histogram of
the rests has at most ``WINDOW`` bins whatever the input, so the plan is made on it alone:
combinations of up to three lengths that fill a window exactly are enumerated, repeat counts
are solved by non-negative least squares against the histogram and rounded, and what remains
is packed greedily, longest first, each window filled with the longest lengths that fit. The
plan is a list of (combination, repeats); it reaches the tasks as small arrays. Pieces are
numbered inside their length class, and the number says which repeat, and so which sequence
and offset, a piece has. Ids stay in the task that made them; only lengths and checksums move.

Defined results: a NULL or empty text is one piece, the end id; repeated rows are packed once
each; NULL ids pass through; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage_shared
from .tokens import TokenIds, default_tokenizer

WINDOW, END = 2048, 1
_ROWS_A_CELL = 200_000
_PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint>>"


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and the rest of each row."""
    path = tokenizer or default_tokenizer()

    @F.arrow_udf(_PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of = TokenIds(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            n, start, length, crc, total = [0], [], [], [], []
            for ids in ids_of.many(batch.to_pylist()):
                ids += end
                size = len(ids) // 4
                for at in range(0, size, window):
                    own = ids[4 * at:4 * (at + window)]
                    start.append(at)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    total.append(size)
                n.append(len(start))
            rows = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                ["start", "length", "ids_crc32", "doc_tokens"])
            yield pa.ListArray.from_arrays(pa.array(n, pa.int32()), rows)

    return docs.select("doc_id", F.explode(cut(F.col("text"))).alias("p")).select("doc_id", "p.*")


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of up to three lengths (0 pads) that sum to ``window`` and occur."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [np.array([[window, 0, 0]])] if have[window] else []
    a = lengths[lengths < window]
    b = window - a
    two = a[(b >= 1) & (a >= b) & have[b]]
    out.append(np.stack([two, window - two, np.zeros_like(two)], 1))
    x, y = np.meshgrid(a, a, indexing="ij")
    z = window - x - y
    ok = (x >= y) & (y >= z) & (z >= 1)
    ok[ok] = have[z[ok]]
    out.append(np.stack([x[ok], y[ok], z[ok]], 1))
    return np.concatenate(out).astype(np.int64)


def nnls(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that bring the used lengths near the histogram:
    accelerated projected gradient on |A x - h|^2, A sparse with at most three entries a column."""
    if not len(combos):
        return np.zeros(0)
    size = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for k in range(3):
            out += np.bincount(combos[:, k], x, minlength=size)
        out[0] = 0  # padding
        return out

    share = np.bincount(combos.ravel(), minlength=size).astype(float)
    share[0] = 0
    # columns scaled so that a combination of crowded lengths takes small steps
    step = 1 / np.maximum(share[combos].sum(1), 1)
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        gap = used(y) - histogram
        gap[0] = 0
        nxt = np.maximum(0, y - step * gap[combos].sum(1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """(lengths, repeats) that use every piece of ``histogram`` (index: length) exactly once."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    combos = combinations(np.flatnonzero(left), left, window)
    x = nnls(combos, left.astype(float))
    for k in np.argsort(-x, kind="stable"):
        want = int(np.floor(x[k] + 1e-9))
        if want < 1:
            break
        own, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
        repeats = min(want, int((left[own] // times).min()))
        if repeats > 0:
            left[own] -= repeats * times
            out.append(([int(v) for v in combos[k] if v], repeats))
    # the residue: longest first, then whatever is longest and still fits
    present = list(np.flatnonzero(left))
    while present:
        room, own = window, []
        use: dict[int, int] = {}
        for length in reversed(present):
            if length <= room:
                n = min(int(left[length]), room // int(length))
                use[int(length)] = n
                own += [int(length)] * n
                room -= n * int(length)
                if room < present[0]:
                    break
        repeats = min(int(left[v]) // n for v, n in use.items())
        for v, n in use.items():
            left[v] -= repeats * n
        out.append((own, repeats))
        present = [v for v in present if left[v] > 0]
    return out


def slots(made: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as arrays: for each length class its slots in order, each with the number of
    pieces before it, the first sequence of its combination and its offset there."""
    rows, first = [], 0
    for own, repeats in made:
        at = 0
        for v in own:
            rows.append((v, first, at, repeats))
            at += v
        first += repeats
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    before = np.concatenate([[0], np.cumsum(a[:, 3])])[:-1] if len(a) else np.zeros(0, np.int64)
    base = np.zeros(WINDOW + 2, np.int64)
    base[:] = np.searchsorted(a[:, 0], np.arange(WINDOW + 2)) if len(a) else 0
    start_of_class = np.array([before[base[v]] if base[v] < len(before) else 0 for v in a[:, 0]], np.int64)
    return {"length": a[:, 0], "before": before - start_of_class, "sequence": a[:, 1], "offset": a[:, 2], "base": base}


def _numbered(rows: DataFrame, cells: int) -> DataFrame:
    """Adds ``_n``: the number of a piece inside its length class, from 0. Classes are split
    over ``cells`` cells by id, so no class meets in one task."""
    cell = F.pmod(F.xxhash64("doc_id", "start"), F.lit(cells).cast("long")).cast("int")
    rows = rows.withColumn("_c", cell)
    sizes = rows.groupBy("length", "_c").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy("length").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "_c", F.coalesce(before, F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("length", "_c").orderBy("doc_id", "start", "ids_crc32"))
    return (rows.withColumn("_i", inside).join(starts, ["length", "_c"])
            .withColumn("_n", F.col("_b") + F.col("_i") - 1).drop("_c", "_i", "_b"))


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    cut = stage_shared(pieces(docs, tokenizer), "pieces")
    counts = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most WINDOW rows
    histogram = np.zeros(WINDOW + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    s = slots(plan(histogram))
    starts = s["length"] * (1 << 40) + s["before"]

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pa.Array, number: pa.Array) -> pa.Array:
        v, n = length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        k = np.searchsorted(starts, v * (1 << 40) + n, "right") - 1
        return pa.StructArray.from_arrays([pa.array(s["sequence"][k] + n - s["before"][k], pa.int64()),
                                           pa.array(s["offset"][k], pa.int64())], ["sequence_id", "offset"])

    cells = max(1, int(histogram.sum()) // _ROWS_A_CELL)
    return (_numbered(cut, cells).withColumn("_s", placed("length", "_n"))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_s.sequence_id", "_s.offset"))
