"""Near-duplicates: fast similarity sketching, banding, exact verification, components.

A document's set is its distinct five-word shingles. The sketch has ``BINS`` bins; in each of
up to ``BINS`` rounds every shingle is hashed into one bin, a bin keeps the least value of the
first round that reached it, and ``BINS`` closing rounds give each bin that is still empty the
least value over the whole set, so that every bin is filled. Four bins make a band: pairs at
similarity 0.75 miss all 32 bands with probability 5e-6. Every pair that is reported linked
was compared on the full sets.

No bucket is expanded into pairs. Equal sets are one representative. In each band bucket every
member is compared with one centre only, the member that meets most others in all buckets,
which in a family of edited copies is close to the original. Components of the links found so
far are then contracted, and only members of different components that meet in a bucket are
compared. First, shingles that only one of these members has cannot be shared, so their number
bounds a member's similarity to any other: members the bound excludes go (texts that merely
share a passage do), and so do pairs, without loss. Second, a sketch of ``FINE`` bins must agree
in at least ``LEAST_AGREE`` of them: at similarity 0.75 fewer agree with probability 3e-6.
Links inside one component cannot change the result.

Only texts that some pair needs are shuffled: a bitmap of ``SIFT_BITS`` bits, of fixed size,
drops most others where they are read (more ids than bits only make it drop fewer).

Defined results: without words or text a set is empty and linked with nothing; fewer than five
words are one shingle; rows that share an id share its component; a NULL id is its own
component (NULL) and kept; ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage_shared
from .common import WordHashes, mix64, shingle_hashes

SHINGLE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
SHARE = 75  # percent
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bins of the late sketch, and how many of its 2-bit values must agree: 4.5 standard
#: deviations under the mean of 0.8125 * FINE at similarity 0.75.
FINE, LEAST_AGREE = 512, 376
SIFT_BITS = 1 << 23
_SIGNATURE = "struct<n:bigint,k1:bigint,k2:bigint,bands:array<bigint>>"


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: one row of ``bins`` 16-bit values each."""
    if not sets:
        return np.zeros((0, bins), np.uint16)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    best = np.full(len(sets) * bins, _FULL)
    filled = np.zeros(len(sets) * bins, bool)
    for r in range(2 * bins):
        h = mix64(items, 1000 + r)
        if r < bins:
            at = owner * bins + (h >> np.uint64(40)).astype(np.int64) % bins
        else:  # closing rounds: bin r - bins gets the least of all
            at = owner * bins + (r - bins)
        free = ~filled[at]
        at, h = at[free], mix64(h[free], r)
        np.minimum.at(best, at, h)
        filled[at] = True
        wanting = ~filled.reshape(-1, bins).all(1)
        if not wanting.any():
            break
        if r % 4 == 3:  # documents that are done leave the rounds
            stay = wanting[owner]
            items, owner = items[stay], owner[stay]
    return (mix64(best, 3) & np.uint64(0xFFFF)).astype(np.uint16).reshape(-1, bins)


def word_set(hashes: WordHashes, text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.of(text), SHINGLE))


def _signatures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = WordHashes()
    for batch in batches:
        sets = [word_set(hashes, t) for t in batch.cast(pa.binary()).to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
        rows = np.zeros((len(sets), BINS), np.uint16)
        rows[size > 0] = sketches([s for s in sets if len(s)])
        bands = np.ascontiguousarray(rows).view("<i8")  # four values a band
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        yield pa.StructArray.from_arrays([pa.array(size), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), lists],
                                         ["n", "k1", "k2", "bands"])


def _linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Whether the full sets of two texts share 75 % of their union."""
    hashes = WordHashes()
    for one, other in batches:
        out, last, own = [], None, None
        for a, b in zip(one.cast(pa.binary()).to_pylist(), other.cast(pa.binary()).to_pylist()):
            if own is None or a != last:
                last, own = a, word_set(hashes, a)
            x = word_set(hashes, b)
            shared = len(np.intersect1d(own, x, assume_unique=True))
            union = len(own) + len(x) - shared
            out.append(union > 0 and 100 * shared >= SHARE * union)
        yield pa.array(out, pa.bool_())


def _sifted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of at least the documents in ``ids`` (one column, ``doc_id``)."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(SIFT_BITS).cast("long"))
    word, bit = F.floor(spot / 64).cast("int"), F.pmod(spot, F.lit(64).cast("long")).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = ids.select(word.alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    # a fixed number of words: one row, one array
    full = ids.sparkSession.range(SIFT_BITS // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    table = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0).cast("long")).alias("m")))),
                                 lambda x: x["m"]).alias("t"))
    return (docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).withColumn("_t", table.scalar())
            .filter(F.get("_t", word).bitwiseAND(mask) != 0).drop("_t"))


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The staged pairs (a, b) whose texts are linked, staged. Texts are shuffled once for both sides."""
    text = _sifted(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = (pairs.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb")), "b")
            .join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta")), "a"))
    return stage_shared(both.filter(F.arrow_udf(_linked, "boolean")("_ta", "_tb")).select("a", "b"), "links")


def _shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = WordHashes()
    for batch in batches:
        sets = [word_set(hashes, t).view(np.int64) for t in batch.cast(pa.binary()).to_pylist()]
        ends = np.cumsum([0] + [len(s) for s in sets])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets or [np.zeros(0, np.int64)])))


def _fine(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Sketches of non-empty sets, thirty-two 2-bit values a number."""
    hashes, each = WordHashes(), FINE // 32
    shift = (2 * np.arange(32)).astype(np.uint64)
    for batch in batches:
        rows = sketches([word_set(hashes, t) for t in batch.cast(pa.binary()).to_pylist()], FINE)
        packed = ((rows & 3).astype(np.uint64).reshape(-1, each, 32) << shift).sum(2, dtype=np.uint64).view(np.int64)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * each), pa.array(packed.ravel()))


def _lonely(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, alone): how many shingles of each of ``reps`` no other of them has."""
    text = _sifted(docs, reps.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep").join(reps, "rep", "left_semi")
    each = text.select("rep", F.explode(F.arrow_udf(_shingles, "array<bigint>")("text")).alias("s"))
    held = each.groupBy("s").agg(F.min("rep").alias("rep"), F.max("rep").alias("_hi")).filter("rep = _hi")
    return held.groupBy("rep").agg(F.count("*").alias("alone"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each linked node.

    Each round points every node at the least of its neighbours and itself, twice over, and
    contracts the edges; the rounds end when no edge is left, about the logarithm of the
    longest chain. Only narrow tables move, each round is written."""
    edges = stage_shared(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                         .distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        up = near.select(F.col("node").alias("p"), F.col("p").alias("label"))
        parent = stage_shared(near.join(up, "p").select("node", "label"), "parents")
        rounds.append(parent)
        of = lambda c: parent.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))  # noqa: E731, B023
        edges = stage_shared(edges.join(of("a"), "a").join(of("b"), "b").filter("la <> lb")
                             .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    out = rounds[0]
    for more in rounds[1:]:
        nxt = more.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        out = out.join(nxt, "label", "left").select("node", F.coalesce("_up", "label").alias("label"))
    return out


def _agreeing(a: str, b: str) -> Column:
    """How many of thirty-two 2-bit values are equal."""
    z = F.col(a).bitwiseXOR(F.col(b))
    return 32 - F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    sets = stage_shared(docs.select("doc_id", F.arrow_udf(_signatures, _SIGNATURE)("text").alias("s")).select("doc_id", "s.*"), "sets")
    full = sets.filter("n > 0 AND doc_id IS NOT NULL")
    # written, so that the joins on it shuffle plainly and a set with very many copies can be split
    reps = stage_shared(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "sets-different")
    own = stage_shared(full.join(reps, ["k1", "k2"]).filter("doc_id = rep").select("rep", "n", "bands"), "representatives")
    banded = own.select("rep", F.posexplode("bands").alias("i", "band")).select(
        "rep", "i", F.xxhash64("i", "band").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("met"), F.min("rep").alias("_lo"), F.max("rep").alias("_hi"))
    members = stage_shared(banded.join(shared.filter("_lo < _hi").select("key", "met"), "key"), "members")
    known = members.groupBy("rep").agg(F.sum("met").alias("fame"))
    centre = (members.join(known, "rep").groupBy("key")
              .agg(F.max(F.struct("fame", (-F.col("rep")).alias("_r"))).alias("_c"))
              .select("key", (-F.col("_c._r")).alias("centre")))
    star = stage_shared(members.join(centre, "key").filter("rep <> centre")
                        .select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    first = _confirmed(star, docs)
    found = components(first)
    named = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "i", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi")
    late = stage_shared(named.join(mixed.select("key"), "key", "left_semi"), "late")
    reps_late = late.select("rep").distinct()
    alone = _lonely(docs, reps_late)
    # what a member can share at most; members that cannot reach the threshold with anyone go
    able = (own.join(reps_late, "rep", "left_semi").join(alone, "rep", "left")
            .select("rep", "n", "bands", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
            .filter(f"100 * most >= {SHARE} * n").dropDuplicates(["rep"]))
    able = stage_shared(able, "able")
    text = _sifted(docs, able.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    fine = F.arrow_udf(_fine, "array<bigint>")("text").alias("f")
    able = stage_shared(text.join(able, "rep").select("rep", "n", "bands", "most", fine), "able")
    parts = [f"f{i}" for i in range(FINE // 32)]
    late = late.join(able, "rep").select(
        "key", "i", "rep", "label", "n", "most", "bands", *[F.coalesce(F.get("f", F.lit(i)), F.lit(0).cast("long")).alias(c) for i, c in enumerate(parts)])
    side = lambda x: late.select(*[F.col(c).alias(f"{c}_{x}") for c in late.columns])
    agree = sum((_agreeing(f"{c}_x", f"{c}_y") for c in parts), F.lit(0))
    shared_most = F.least("most_x", "most_y")
    # a pair that meets in several buckets comes out of the first
    first_met = F.array_position(F.zip_with("bands_x", "bands_y", lambda x, y: x == y), F.lit(True)) == F.col("i_x") + 1
    close = ((F.col("key_x") == F.col("key_y")) & (F.col("label_x") < F.col("label_y"))
             & (100 * shared_most >= SHARE * (F.col("n_x") + F.col("n_y") - shared_most)) & (agree >= LEAST_AGREE))
    pairs = side("x").join(side("y"), close & first_met).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()
    tried = star.select("a", "b").unionAll(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = _confirmed(stage_shared(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), docs)
    if not second.isEmpty():
        found = components(first.unionAll(second))
    return (sets.select("doc_id", "n", "k1", "k2").join(reps, ["k1", "k2"], "left")
            .join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("label", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
