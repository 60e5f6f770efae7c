"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text is the set of digests of its paragraphs (lines with a word). A table has three parts of
``width`` cells; each digest goes to one cell of every part, and a cell keeps how many came,
the XOR of the digests and the XOR of their checks. Two versions' tables subtract cell by
cell, and what they share cancels. A cell left with one digest gives it away; taking it out of
its other cells frees more (peeling). When cells remain, the table was too small and the
comparison is made again with a larger one.

Sets larger than a table holds are dealt by digest over several tables of the same width, so
the work follows the number of paragraphs. All of it is built-in array functions inside a row;
the loop over sizes only sees the few rows that failed.

Defined results: a NULL text is empty; a text without words has no paragraph, and two such
texts are alike (1.0); ids that repeat are ordered by a hash of the text; NULL ids come last;
the document after the last is the first, so a single document follows itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage_shared
from .common import WORD

PARTS, PRINT_WIDTH = 3, 4
#: Widths of a part, tried in turn; a table is dealt ``LOAD`` differing digests on average.
WIDTHS, LOAD = (8, 16, 32), 6
_ROWS_A_CELL, _LEVEL = 5_000, 1_000


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    lines = F.filter(F.split(text, "\n"), lambda p: p.rlike(WORD))
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(977)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _place(d: Column, part: Column, width: int, seed: int) -> Column:
    """Cell of a digest in a part, counted over the whole table."""
    return part * width + F.pmod(F.xxhash64(d, part + seed), F.lit(width).cast("long")).cast("int")


def _cell(n: Column, key: Column, chk: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), chk.alias("chk"))


def table(items: Column, width: int, seed: int = 0) -> Column:
    """The cells of a set of digests."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def cell(c: Column) -> Column:
        return F.aggregate(items, empty, lambda s, d: F.when(
            _place(d, F.floor(c / width).cast("int"), width, seed) == c,
            _cell(s["n"] + 1, s["key"].bitwiseXOR(d), s["chk"].bitwiseXOR(_check(d)))).otherwise(s))

    return F.transform(F.sequence(F.lit(0), F.lit(PARTS * width - 1)), cell)


def subtract(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: _cell(
        a["n"] - b["n"], a["key"].bitwiseXOR(b["key"]), a["chk"].bitwiseXOR(b["chk"])))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def peel(cells: Column, steps: Column, width: int, seed: int = 0) -> Column:
    """Array of (digest, sign) that differ, or NULL when cells remain; ``steps`` is any array at
    least as long as the number of differing digests."""
    got_type = "array<struct<key:bigint,sign:int>>"
    start = F.struct(cells.alias("cells"), F.array().cast(got_type).alias("got"))

    def take(s: Column, p: Column) -> Column:
        def out(at: Column) -> Column:
            rest = F.transform(s["cells"], lambda c, i: F.when(
                F.array_contains(at, i), _cell(c["n"] - p["n"], c["key"].bitwiseXOR(p["key"]), c["chk"].bitwiseXOR(p["chk"]))).otherwise(c))
            more = F.concat(s["got"], F.array(F.struct(p["key"].alias("key"), p["n"].alias("sign"))))
            return F.struct(rest.alias("cells"), more.alias("got"))
        return _let(F.array(*[_place(p["key"], F.lit(j), width, seed) for j in range(PARTS)]), out)

    def step(s: Column, _) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"])))
        return _let(F.get(pure, F.lit(0)), lambda p: F.when(p.isNull(), s).otherwise(take(s, p)))

    def finish(s: Column) -> Column:
        left = F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0))
        return F.when(~left, s["got"])

    return F.aggregate(steps, start, step, finish)


def differing(a: Column, b: Column, attempt: int) -> Column:
    """Number of digests in one set only, or NULL on failure at every width of this attempt."""
    seed = 100 * attempt
    n = (F.size(a) + F.size(b)) * (1 << attempt)
    outer = F.greatest(F.lit(1), F.ceil(F.sqrt(n / LOAD))).cast("int")
    dealt = lambda x, by, k, salt: F.filter(x, lambda d: F.pmod(F.xxhash64(d, F.lit(salt + seed)), by.cast("long")) == k)

    def one(x: Column, y: Column) -> Column:
        tries = [F.size(peel(subtract(table(x, w, seed + 10 * i), table(y, w, seed + 10 * i)), F.concat(x, y), w, seed + 10 * i))
                 for i, w in enumerate(WIDTHS)]
        # size of NULL is -1 or NULL by setting; only real sizes count
        return F.coalesce(*[F.when(t >= 0, t) for t in tries])

    def inner(x: Column, y: Column) -> Column:
        m = F.greatest(F.lit(1), F.ceil((F.size(x) + F.size(y)) * (1 << attempt) / LOAD)).cast("int")
        return F.transform(F.sequence(F.lit(0), m - 1), lambda k: _let(
            F.struct(dealt(x, m, k, 52).alias("x"), dealt(y, m, k, 52).alias("y")), lambda p: one(p["x"], p["y"])))

    counts = F.flatten(F.transform(F.sequence(F.lit(0), outer - 1), lambda k: _let(
        F.struct(dealt(a, outer, k, 51).alias("x"), dealt(b, outer, k, 51).alias("y")), lambda p: inner(p["x"], p["y"]))))
    return _let(counts, lambda c: F.when(F.exists(c, lambda v: v.isNull()), F.lit(None).cast("int"))
                .otherwise(F.aggregate(c, F.lit(0), lambda s, v: s + v)))


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """Shared digests over all digests; two empty sets are alike."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - apart) / (n + apart))


def fingerprint(items: Column) -> Column:
    """The table of ``PRINT_WIDTH`` cells a part as text."""
    return F.array_join(F.transform(table(items, PRINT_WIDTH), lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(
        F.concat(F.hex(c["n"]), F.lit(":"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["chk"]), 8, "0")))), "/")


def _bounds(docs: DataFrame) -> tuple[list[int], DataFrame, int]:
    """Greatest ids of the parts, ascending, then per part (``_part``) the greatest ids of its
    cells (``_q``), and how many cells a part may have. Every bound is an id. At most ``_LEVEL``
    parts of ``_LEVEL`` cells: 8 MB of ids whatever the table, beyond that cells grow."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    level = min(math.ceil(math.sqrt(max(1, ids.count() // _ROWS_A_CELL))), _LEVEL)
    cuts = F.array(*[F.lit(k / level) for k in range(1, level + 1)])
    quantiles = F.sort_array(F.array_union(F.percentile_approx("doc_id", cuts, 20 * max(level, 500)), F.array(F.max("doc_id"))))
    tops = [q for q in ids.agg(quantiles.alias("q")).first()["q"] or [] if q is not None]
    fine = ids.groupBy(_below(tops).alias("_part")).agg(quantiles.alias("_q"))
    return tops, stage_shared(fine, "bounds"), level + 1


def _below(tops: list[int]) -> Column:
    bounds = F.array(*[F.lit(q).cast("long") for q in tops]) if tops else F.array().cast("array<bigint>")
    return F.size(F.filter(bounds, lambda q: q < F.col("doc_id")))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (cell, i, doc_id, text, d, next_text, next_d) where next follows by descending id.

    Ids are cut into cells at quantiles that are ids themselves, found by two short searches;
    the first row of a cell is also sent, as a guest, to the end of the cell before it, so each
    window is one cell."""
    tops, fine, width = _bounds(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), digests(text).alias("d"), _below(tops).alias("_part"))
    rows = rows.join(F.broadcast(fine), "_part", "left")
    # a NULL id is below every bound, and the least ids come last
    inside = F.greatest(F.size(F.filter("_q", lambda q: q < F.col("doc_id"))), F.lit(0))
    rows = rows.select("doc_id", "text", "d", "_part", inside.alias("_in"), F.size("_q").alias("_cells"),
                       F.get("_q", inside).eqNullSafe(F.col("doc_id")).alias("_top"))
    home = F.col("_part") * width + F.col("_in")
    above = F.when(F.col("_in") < F.col("_cells") - 1, home + 1).when(
        F.col("_part") < len(tops) - 1, (F.col("_part") + 1) * width).otherwise(F.lit(0))
    guest = F.when(F.col("_top"), above)
    spot = lambda c, g: F.struct(c.alias("cell"), F.lit(g).alias("guest"))
    spots = F.filter(F.array(spot(home, 0), spot(guest, 1)), lambda s: s["cell"].isNotNull())
    rows = rows.select("doc_id", "text", "d", spots.alias("s")).select("doc_id", "text", "d", F.explode("s").alias("s"))
    line = Window.partitionBy("cell").orderBy("guest", F.col("doc_id").desc_nulls_last(), "_h")
    rows = rows.select("s.cell", "s.guest", "doc_id", "text", "d", F.xxhash64("text").alias("_h"))
    return (rows.withColumn("next_text", F.lead("text").over(line)).withColumn("next_d", F.lead("d").over(line))
            .withColumn("i", F.row_number().over(line)).filter("guest = 0")
            .select("cell", "i", "doc_id", "text", "d", "next_text", "next_d"))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by the first as many of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = with_next(docs).withColumn("e", edited(F.col("text"), F.col("next_text")))
    rows = stage_shared(rows.select(
        "cell", "i", "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), "d", digests(F.col("e")).alias("ed"), "next_d"), "digests")
    apart = lambda df, k: df.withColumn("apart", differing(F.col("d"), F.col("ed"), k)).withColumn(
        "apart_next", differing(F.col("d"), F.col("next_d"), k))
    # comparing costs far more than reading: dealt evenly, whatever the sizes of the files
    rows = rows.repartition(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "i")
    tried, attempt, done = stage_shared(apart(rows, 0), "compared"), 0, None
    while True:
        good = tried.filter("apart IS NOT NULL AND apart_next IS NOT NULL")
        done = good if done is None else done.unionAll(good)
        failed = tried.filter("apart IS NULL OR apart_next IS NULL")
        if failed.isEmpty():
            break
        attempt += 1
        tried = stage_shared(apart(failed.drop("apart", "apart_next"), attempt), "compared")
    return done.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("d")).alias("fingerprint"),
        fingerprint(F.col("ed")).alias("edited_fingerprint"),
        likeness(F.col("d"), F.col("ed"), F.col("apart")).alias("near_edited"),
        likeness(F.col("d"), F.col("next_d"), F.col("apart_next")).alias("near_next"))
