"""Phrase collocation mining: SON partitioning.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and pieces into
words at blanks and tabs. Occurrences are dealt to ``SHARDS`` shards. A phrase that reaches
``MIN_COUNT`` in a language reaches, in some shard, that support lowered to the shard's share
of the language's words; so the union of what the shards find locally frequent holds every phrase
wanted. The shards go through the levels together: those of the union whose counts in all
shards add up to less than ``MIN_COUNT`` are left out before the next level, and one more pass
counts what is left exactly over all texts.

Mining is over 32-bit word hashes that are written once: runs of k words whose two runs of k - 1
are left are counted inside the tasks, dealt by hash to buckets of about ``_BUCKET`` words, and
summed there by shard, so no shard or phrase meets in one task. Every shard counts a run that any
of them counts, so its sum lacks nothing. What is left reaches the next level as a bitmap of
``BITS`` bits, of fixed size. Hashes and bits that collide only add candidates; the last count is
by the words themselves.

Each cut of a phrase into two parts scores ``floor(2000000 a / (l + r))``; the lowest cut, then
the smallest, is the phrase's. Phrases inside a longer one with at least 80 % of their count
are dropped.

Defined results: a NULL or empty text has no word; a NULL language is ``und``; repeated rows
count each; ties in score go by count, then by bytes of the phrase; an empty table has no
phrase; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import shared_path, stage_shared
from .common import WordHashes, mix64

LONGEST, MIN_COUNT, TOP, INSIDE = 4, 30, 2000, 80
SHARDS = 4
BITS = 1 << 27
_BUCKET = 1 << 20  # words of the corpus a bucket
_HELD, _PHRASES = 1 << 22, 1_200_000  # runs and different phrases a task holds before it emits them
_TASK = 12  # buckets of words a task of the last count reads, where that leaves two tasks a core
_HIGH = 0xFFFFFFFF00000000
_LOW = 24  # bits of a run's hash that travel beside its bucket; they make whole bytes
_STOP, _END = b".", bytes(4)
_FORM = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words in order, with ``.`` between pieces."""
    return (text or b"").translate(_FORM).replace(_STOP, b" . ").split()


class _Words32(WordHashes):
    """32-bit hashes of words, never 0; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        h = 0 if word == _STOP else (xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF) or 1
        if len(self) < self.limit:
            self[word] = h
        return h

    def of_tokens(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint32, len(found))


def _wide(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def _written(docs: DataFrame) -> DataFrame:
    """(lang, shard, n, words) staged: word hashes of every text; the shard is dealt by the task
    that read the text."""
    @F.arrow_udf("struct<n:bigint,words:binary>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Words32()
        for batch in batches:
            rows = [hashes.of_tokens(tokens(t)) for t in batch.cast(pa.binary()).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([int(np.count_nonzero(r)) for r in rows], pa.int64()),
                                              pa.array([r.tobytes() for r in rows], pa.binary())], ["n", "words"])
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"),
                       F.pmod(F.spark_partition_id(), F.lit(SHARDS)).alias("shard"), hashed("text").alias("w"))
    path = shared_path(docs.sparkSession, "phrase-words")
    rows.select("lang", "shard", "w.n", "w.words").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("lang string, shard int, n bigint, words binary").parquet(path)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang))


def _levels(h: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For k = 1, 2, ..: the hash of the run of k words at every place; 0 where a run leaves its
    piece."""
    out, inside = np.zeros(len(h), np.uint64), np.ones(len(h), bool)
    for i in range(longest):
        n = max(len(h) - i, 0)
        out, inside = mix64(out[:n] ^ h[i:], i), inside[:n] & (h[i:] != 0)
        yield np.where(inside, out | np.uint64(1), np.uint64(0))


def _keys(runs: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each run (by the higher half of its hash), ``_LOW`` bits of the lower half and a
    1; 0 stays 0."""
    top = (runs >> np.uint64(32)) * np.uint64(buckets) & np.uint64(_HIGH)
    return np.where(runs != 0, top | (runs & np.uint64((2 << _LOW) - 1)), np.uint64(0))


def _packed(keys: np.ndarray) -> bytes:
    """What the bucket of a key does not say."""
    return (keys >> np.uint64(1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :_LOW // 8].tobytes()


def _unpacked(low: bytes, bucket: int) -> np.ndarray:
    wide = np.zeros((len(low) * 8 // _LOW, 4), np.uint8)
    wide[:, :_LOW // 8] = np.frombuffer(low, np.uint8).reshape(-1, _LOW // 8)
    return (wide.view("<u4").ravel().astype(np.uint64) << np.uint64(1)) | np.uint64(bucket << 32 | 1)


def _spot(runs: np.ndarray, salt: np.uint64) -> np.ndarray:
    return (mix64(runs ^ salt, 5) & np.uint64(BITS - 1)).astype(np.int64)


def _often(bitmap: np.ndarray, runs: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Which runs the bitmap knows."""
    out, at = np.zeros(len(runs), bool), np.flatnonzero(runs)
    spots = _spot(runs[at], salt)
    out[at] = bitmap[spots >> 3] >> (spots & 7).astype(np.uint8) & 1
    return out


def _summed(rows: DataFrame, k: int, buckets: int, known) -> DataFrame:
    """(lang, shard, bucket, runs, counts): runs of ``k`` words, summed inside a task; ``known``
    is the broadcast bitmap of the runs of ``k - 1`` that are left."""
    def emit(lang: str, shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        top = (keys >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
        ends = np.r_[first[1:], len(keys)]
        # counts are kept far above any support
        many = np.minimum(counts, 255).astype(np.uint8).tobytes()
        return pa.record_batch([
            pa.array([lang] * len(first), pa.string()), pa.array([shard] * len(first), pa.int32()),
            pa.array(top[first], pa.int64()),
            pa.array([_packed(keys[a:b]) for a, b in zip(first, ends)], pa.binary()),
            pa.array([many[a:b] for a, b in zip(first, ends)], pa.binary())],
            ["lang", "shard", "bucket", "runs", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if known is None else np.frombuffer(known.value, np.uint8)
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            own: dict[tuple[str, int], list[bytes]] = {}
            for lang, shard, words in zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "words"))):
                own.setdefault((lang, shard), []).append(words)
            for key, texts in own.items():
                h = np.frombuffer(_END.join(texts), np.uint32).astype(np.uint64)
                *_, shorter, runs = [np.zeros(0, np.uint64), *(_keys(r, buckets) for r in _levels(h, k))]
                keep = runs != 0
                if bitmap is not None:
                    often = _often(bitmap, shorter, _salt(key[0]))
                    keep &= often[:-1] & often[1:]
                if keep.any():
                    held.setdefault(key, []).append(runs[keep])
                    size += len(held[key][-1])
                if size >= _HELD:
                    yield from (emit(*key, parts) for key, parts in held.items())
                    held, size = {}, 0
        yield from (emit(*key, parts) for key, parts in held.items())

    return rows.select("lang", "shard", "words").mapInArrow(
        count, "lang string, shard int, bucket bigint, runs binary, counts binary")


def _frequent(counted: DataFrame, least: DataFrame, min_count: int) -> DataFrame:
    """(spot): bits of the runs that some shard finds frequent and that may reach ``min_count``
    in all of them."""
    def group(key: tuple, table: pa.Table) -> pa.Table:
        lang, bucket = key[0].as_py(), key[1].as_py()
        many = table.column("counts").to_pylist()
        runs = _unpacked(b"".join(table.column("runs").to_pylist()), bucket)
        shard = np.repeat(table.column("shard").to_numpy(), [len(b) for b in many])
        different, at = np.unique(runs, return_inverse=True)
        counts = np.bincount(at * SHARDS + shard, np.frombuffer(b"".join(many), np.uint8), len(different) * SHARDS).reshape(-1, SHARDS)
        local = (counts >= table.column("least")[0].as_py()).any(axis=1)
        return pa.table({"spot": pa.array(_spot(different[local & (counts.sum(axis=1) >= min_count)], _salt(lang)))})
    return counted.join(least, "lang").groupBy("lang", "bucket").applyInArrow(group, "spot bigint")


def _bitmap(spots: DataFrame) -> bytes:
    """``BITS`` bits whatever the input."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("spot", F.lit(64).cast("long")).cast("int"))
    got = (spots.groupBy(F.floor(F.col("spot") / 64).alias("w")).agg(F.bit_or(mask).alias("m"))).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return bits.tobytes()


def candidates(docs: DataFrame, min_count: int = MIN_COUNT):
    """Broadcast bitmaps of the runs of 1, 2, .. ``LONGEST`` words by language that the shards
    leave, and the number of buckets."""
    spark = docs.sparkSession
    rows = _written(docs)
    # one row a language: each shard's support in proportion to its words, rounded up
    share = rows.groupBy("lang", "shard").agg(F.sum("n").alias("n"))
    all_words = F.sum("n").over(Window.partitionBy("lang"))
    up = F.greatest(F.ceil(_wide("n") * min_count / F.greatest(_wide(all_words), F.lit(1))).cast("long"), F.lit(1))
    of_shard = [F.coalesce(F.max(F.when(F.col("shard") == i, F.col("up"))), F.lit(1)) for i in range(SHARDS)]
    least = stage_shared(share.withColumn("up", up).groupBy("lang").agg(F.sum("n").alias("n"), F.array(*of_shard).alias("least")), "phrase-shares")
    buckets = max(1, (least.agg(F.sum("n")).first()[0] or 0) // _BUCKET)
    least = least.drop("n")
    out = []
    for k in range(1, LONGEST + 1):
        left = _bitmap(_frequent(_summed(rows, k, buckets, out[-1] if out else None), least, min_count))
        out.append(spark.sparkContext.broadcast(left))
    return out, buckets


def _pressed(phrases: list[bytes], counts: Iterable[int]) -> tuple[int, int, bytes]:
    """(bytes, phrases, packed bytes) of the counts, byte by byte of all, and the phrases."""
    plain = np.fromiter(counts, "<u8", len(phrases)).view(np.uint8).reshape(-1, 8).T.tobytes() + b"\n".join(phrases)
    return len(plain), len(phrases), pa.compress(plain, codec="zstd", asbytes=True)


def _released(size: int, n: int, pressed: bytes) -> tuple[list[bytes], np.ndarray]:
    plain = pa.decompress(pressed, size, codec="zstd", asbytes=True)
    counts = np.ascontiguousarray(np.frombuffer(plain, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()
    return plain[8 * n:].split(b"\n"), counts


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, k, f) staged: exact counts of every run of 1 to ``LONGEST`` words that
    occurs ``min_count`` times in its language; of no word (k = 0): the language's words."""
    found, buckets = candidates(docs, min_count)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words32()
        bitmaps = [np.frombuffer(b.value, np.uint8) for b in found]
        held: dict[str, Counter] = {}  # phrases, and words that may prove frequent or not
        n: Counter = Counter()
        size = 0

        def prune() -> int:
            """Words that the shards did not leave go."""
            for lang, own in held.items():
                single = [p for p in own if b" " not in p]
                often = _often(bitmaps[0], _keys(next(_levels(hashes.of_tokens(single).astype(np.uint64), 1)), buckets), _salt(lang))
                for i in np.flatnonzero(~often).tolist():
                    del own[single[i]]
            return sum(map(len, held.values()))

        def emit() -> Iterator[pa.RecordBatch]:
            prune()
            for lang, own in held.items():
                dealt: dict[int, list[bytes]] = {}
                for p in own:
                    dealt.setdefault(zlib.crc32(p) % buckets, []).append(p)
                rows = [(lang, k, *_pressed(ps, map(own.__getitem__, ps))) for k, ps in dealt.items()]
                # the words of the language travel as the phrase of no word
                rows.append((lang, -1, *_pressed([b""], [n[lang]])))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                      ["lang", "bucket", "size", "n", "pressed"])

        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                texts.setdefault(lang, []).append(text or b"")
            for lang, parts in texts.items():
                got = tokens(_STOP.join(parts))
                own = held.setdefault(lang, Counter())
                size -= len(own)
                own.update(got)
                del own[_STOP]
                n[lang] += len(got) - got.count(_STOP)
                before = None
                for k, runs in enumerate(_levels(hashes.of_tokens(got).astype(np.uint64), LONGEST), 1):
                    known = _often(bitmaps[k - 1], _keys(runs, buckets), _salt(lang))
                    if before is not None:  # both shorter runs must be there too
                        known &= before[:-1] & before[1:]
                        own.update([b" ".join(got[i:i + k]) for i in np.flatnonzero(known).tolist()])
                    before = known
                size += len(own)
            if size >= _PHRASES and (size := prune()) >= _PHRASES // 2:
                yield from emit()
                held, n, size = {}, Counter(), 0
        yield from emit()

    def group(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_released(*row) for row in zip(*(table.column(c).to_pylist() for c in ("size", "n", "pressed")))]
        phrases = [p for own, _ in parts for p in own]
        counts = np.concatenate([f for _, f in parts]).astype(np.int64)
        got = pa.table({"p": pa.array(phrases, pa.binary()), "f": pa.array(counts)}).group_by("p").aggregate([("f", "sum")])
        phrase, f = got.column("p").combine_chunks(), got.column("f_sum").to_numpy()
        kept = np.flatnonzero((f >= min_count) | (key[1].as_py() < 0))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(kept), pa.string()), "phrase": phrase.take(pa.array(kept)).cast(pa.string()),
                         "f": pa.array(f[kept], pa.int64())})

    # a phrase moves once a task at most, so fewer tasks move fewer
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, buckets // _TASK)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").coalesce(tasks)
    counted = rows.mapInArrow(count, "lang string, bucket bigint, size bigint, n bigint, pressed binary")
    counted = counted.groupBy("lang", "bucket").applyInArrow(group, "lang string, phrase string, f bigint")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return stage_shared(counted.select("lang", "phrase", words.cast("int").alias("k"), "f"), "phrase-counts")


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("_w", start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every candidate that no longer one covers."""
    phrases = counts.filter("k >= 2").withColumnRenamed("f", "a").withColumn("_w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "a", "k", "_w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("_l"),
                       _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_r"))
    of = lambda c, v: counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(v))
    cuts = cuts.join(of("_l", "l"), ["lang", "_l"]).join(of("_r", "r"), ["lang", "_r"])
    cuts = cuts.withColumn("_up", _wide("a") * 2_000_000).withColumn("_down", (_wide("l") + _wide("r")).cast("decimal(28,0)"))
    best = (cuts.withColumn("score", F.expr("_up div _down")).groupBy("lang", "phrase", "a")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")))
    spans = [(at, n) for n in range(2, LONGEST) for at in range(1, LONGEST)]
    inner = F.array(*[F.when((F.col("k") > n) & (F.col("k") >= at + n - 1), _part(F.lit(at), F.lit(n))) for at, n in spans])
    covered = (phrases.filter("k > 2").select("lang", "a", F.explode(inner).alias("phrase")).filter("phrase IS NOT NULL")
               .groupBy("lang", "phrase").agg(F.max("a").alias("_longer")))
    over = F.coalesce(_wide("_longer") * 100 >= _wide("a") * INSIDE, F.lit(False))
    return (best.join(covered, ["lang", "phrase"], "left").filter(~over)
            .select("lang", "phrase", "a", "b.l", "b.r", F.col("b.score").cast("long").alias("score")))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    counts = phrase_counts(docs, min_count)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored(counts.filter("k > 0")).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    words = counts.filter("k = 0").select("lang", F.col("f").alias("n"))  # one row a language
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH w AS (SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS ws
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
  g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(range(1, CAST(len(ws) AS BIGINT) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(ws) >= k)),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 30),
  x AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:k], ' ') AS rp
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
  s AS (SELECT x.lang, x.phrase, x.a, min({'score': CAST(2000000::HUGEINT * x.a // (l.f::HUGEINT + r.f) AS BIGINT), 'cut': x.cut, 'l': l.f, 'r': r.f}) AS b
    FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp GROUP BY ALL),
  i AS (SELECT lang, array_to_string(ws[o:o + m - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, ws, k, a, m, unnest(range(1, k - m + 2)) AS o FROM c, (VALUES (2), (3)) v(m) WHERE k > m) GROUP BY ALL),
  k AS (SELECT s.lang, s.phrase, s.a, s.b.l AS l, s.b.r AS r, s.b.score AS score FROM s
    LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * s.a, false))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000"""
