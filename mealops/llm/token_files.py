"""Token-ID output: canonical length-limited Huffman codes in independent blocks.

Texts become ids once, and the ids are written. Their global counts (at most one row a
vocabulary entry) give code lengths by package-merge, limited to ``MAX_BITS``; the canonical
codes follow from the lengths alone, so the code table of a file set is one small table of
(id, bits). Ids are dealt to files by ranges of doc_id and sorted inside them; each file is a
sequence of blocks of about ``BLOCK`` ids. A block holds its bits, the bit offset of every
``STRIDE``-th id, and for each document piece in it where the piece lies. A block is decoded
alone: all checkpoints advance together through a table of ``2 ** bits`` entries. Blocks are
rows of a Parquet folder, written and read by Spark, so any store that Spark reaches will do.

Defined results: a NULL or empty text is the end id alone; NULL ids come last; rows of one id
are ordered by their checksum, equal rows are written each; an empty table gives files without
blocks; other columns are ignored. Documents longer than a block go on in the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import shared_path, write_table
from .tokens import TokenIds, default_tokenizer

END = 1
MAX_BITS, BLOCK, STRIDE = 16, 1 << 18, 128
_BLOCKS = ("part int, block bigint, first bigint, n bigint, bits binary, checkpoints array<int>, doc_id array<bigint>, "
           "doc_start array<bigint>, piece array<bigint>, doc_tokens array<bigint>, length array<int>")


# --- codes -------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol (0: does not occur) of the shortest code within ``max_bits``, by
    package-merge: the cheapest items of each level are the leaves taken and packages of the
    level below; a symbol is as long as the number of levels that take it."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit in {max_bits} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        items = np.concatenate([leaves, packages])
        rank = np.argsort(items, kind="stable")
        levels.append(rank < len(leaves))
        items = items[rank]
        even = len(items) // 2 * 2
        packages = items[:even:2] + items[1:even:2]
    take = 2 * (len(used) - 1)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (bits, symbol)."""
    out = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[s])
        if n:
            code <<= n - last
            out[s], last = code, n
            code += 1
    return out


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` one after the other, highest bit first, and the bit offset of every
    ``stride``-th of them."""
    n = lengths[ids]
    end = np.cumsum(n)
    at = end - n
    word, inside = at >> 5, (at & 31).astype(np.uint64)
    value = codes[ids] << (np.uint64(64) - inside - n.astype(np.uint64))
    # codes are at most 32 bits, so one begins in every word; those of a word are neighbours
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(ids) else np.zeros(0, np.int64)
    words = np.zeros((int(word[-1]) if len(ids) else 0) + 3, np.uint64)
    if len(ids):
        words[:-2] += np.add.reduceat(value >> np.uint64(32), first)
        words[1:-1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), at[::stride].astype(np.int32)


class Decoder:
    """Decodes blocks by table: the next ``width`` bits name the id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max())) if len(lengths) else 1
        codes = canonical(lengths)
        self.symbol = np.zeros(1 << self.width, np.int64)
        self.bits = np.ones(1 << self.width, np.int64)
        used = np.lexsort((np.arange(len(lengths)), lengths))
        used = used[lengths[used] > 0]
        spread = 1 << (self.width - lengths[used])
        # canonical codes are ascending, so their entries fill the table from the start
        assert not len(used) or int(codes[used[0]]) == 0
        self.symbol[:spread.sum()] = np.repeat(used, spread)
        self.bits[:spread.sum()] = np.repeat(lengths[used], spread)

    def __call__(self, bits: bytes, checkpoints: np.ndarray, n: int, stride: int = STRIDE) -> np.ndarray:
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = np.asarray(checkpoints, np.int64).copy()
        out = np.zeros((stride, len(at)), np.uint32)
        mask, width = np.uint64((1 << self.width) - 1), np.uint64(64 - self.width)
        last = len(pairs) - 1
        for k in range(stride):
            if len(at) and (len(at) - 1) * stride + k >= n:
                at = at[:-1]  # the last stretch is done
            lane = len(at)
            seen = pairs[np.minimum(at >> 5, last)] >> (width - (at & 31).astype(np.uint64)) & mask
            seen = seen.astype(np.int64)
            out[k, :lane] = self.symbol[seen]
            at = at + self.bits[seen]
        return out.T.ravel()[:n]


# --- checksums ---------------------------------------------------------------------------

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's, in its reflected form."""
    out = 0
    while True:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        if not a:
            return out
        b = b >> 1 ^ _POLY if b & 1 else b >> 1


_POWERS = [0x00800000]  # x ** 8
while len(_POWERS) < 60:
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


def crc_share(crc: int, bytes_after: int) -> int:
    """What a part adds by XOR to the checksum of a whole that goes on for ``bytes_after``."""
    power, k = 0x80000000, 0
    while bytes_after:
        if bytes_after & 1:
            power = _times(power, _POWERS[k])
        bytes_after >>= 1
        k += 1
    return _times(crc, power)


# --- files -------------------------------------------------------------------------------

def _encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, crc, ids): each text's ids and the end id, in the smallest fixed width."""
    @F.arrow_udf("struct<crc:bigint,ids:binary>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of, end = TokenIds(path), np.array([END], "<u4").tobytes()
        narrow = ids_of.tokenizer.get_vocab_size() <= 1 << 16
        for batch in batches:
            whole = [ids + end for ids in ids_of.many(batch.to_pylist())]
            kept = [np.frombuffer(b, "<u4").astype("<u2").tobytes() for b in whole] if narrow else whole
            yield pa.StructArray.from_arrays([pa.array([zlib.crc32(b) for b in whole], pa.int64()), pa.array(kept, pa.binary())], ["crc", "ids"])
    return docs.select("doc_id", encode("text").alias("e")).select("doc_id", "e.crc", "e.ids")


def _width(path: str) -> str:
    return "<u2" if TokenIds(path, limit=0).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(encoded: DataFrame, width: str) -> DataFrame:
    """(id, n) over all ids; a task sums its own first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), width))
            if len(got) > len(total):
                got[:len(total)] += total
                total = got
            else:
                total[:len(got)] += got
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])
    return encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks_of(lengths: np.ndarray, width: str):
    """Task body: rows (doc_id, ids) in file order to blocks."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        codes, block, first = canonical(lengths), 0, 0
        ids: list[np.ndarray] = []
        held, pieces = 0, []  # (doc_id, start of the document in the file, piece's place in it, its ids, piece's ids)

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, pieces, block, first
            every = np.concatenate(ids)
            bits, points = pack_bits(every, lengths, codes)
            cols = list(zip(*pieces))
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([len(every)], pa.int64()),
                   pa.array([bits], pa.binary()), pa.array([points], pa.list_(pa.int32())),
                   *[pa.array([list(c)], pa.list_(pa.int64())) for c in cols[:4]], pa.array([list(cols[4])], pa.list_(pa.int32()))]
            block, first, ids, held, pieces = block + 1, first + len(every), [], 0, []
            return pa.record_batch(row, ["part", "block", "first", "n", "bits", "checkpoints", "doc_id", "doc_start", "piece", "doc_tokens", "length"])

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                own = np.frombuffer(raw, width)
                start, at = first + held, 0
                while at < len(own):
                    take = min(len(own) - at, BLOCK - held)
                    ids.append(own[at:at + take])
                    pieces.append((doc_id, start, at, len(own), take))
                    held, at = held + take, at + take
                    if held == BLOCK:
                        yield flush()
        if held:
            yield flush()
    return write


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, files: int | None = None) -> str:
    """Write ``path``/blocks and ``path``/code. File ``part`` holds the documents after those of
    the file before it in doc_id order."""
    tokenizer = tokenizer or default_tokenizer()
    spark, width = docs.sparkSession, _width(tokenizer)
    _encoded(docs, tokenizer).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/ids")
    encoded = spark.read.schema("doc_id bigint, crc bigint, ids binary").parquet(f"{path}/ids")
    counts = id_counts(encoded, width).toArrow()  # at most one row a vocabulary entry
    at, n = counts.column("id").to_numpy(), counts.column("n").to_numpy()
    total = np.zeros(int(at.max()) + 1 if len(at) else 1, np.int64)
    total[at] = n
    lengths = code_lengths(total, max(MAX_BITS, int(len(at) - 1).bit_length()))
    code = [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)]
    write_table(spark.createDataFrame(code, "id int, bits int").coalesce(1), f"{path}/code")
    order = [F.col("doc_id").asc_nulls_last(), F.col("crc"), F.xxhash64("ids")]
    n_files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = encoded.repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    write_table(sorted_rows.select("doc_id", "ids").mapInArrow(_blocks_of(lengths, width), _BLOCKS), f"{path}/blocks")
    return path


def _code(spark, path: str) -> np.ndarray:
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/code").toArrow()  # at most a vocabulary
    at = rows.column("id").to_numpy()
    out = np.zeros(int(at.max()) + 1 if len(at) else 1, np.int64)
    out[at] = rows.column("bits").to_numpy()
    return out


_PIECE = "part int, doc_id bigint, doc_start bigint, piece bigint, doc_tokens bigint, "


def _decoded(spark, path: str, last: pa.Field, value, ddl: str) -> DataFrame:
    """One row a piece of a document, decoded block by block, with ``value(ids, ids after it)``."""
    lengths = _code(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            bits, points = batch.column("bits").to_pylist(), batch.column("checkpoints")
            for k, (n, part, raw) in enumerate(zip(batch.column("n").to_pylist(), batch.column("part").to_pylist(), bits)):
                ids = decoder(raw, points[k].values.to_numpy(), n).astype("<u4").tobytes()
                docs, starts, at, total, length = (batch.column(c)[k].values for c in ("doc_id", "doc_start", "piece", "doc_tokens", "length"))
                ends = np.cumsum([0, *length.to_pylist()]) * 4
                left = total.to_numpy() - at.to_numpy() - length.to_numpy()
                out = [value(ids[a:b], m) for a, b, m in zip(ends.tolist(), ends[1:].tolist(), left.tolist())]
                yield pa.record_batch([pa.array(np.full(len(left), part, np.int32)), docs, starts, at, total, pa.array(out, last.type)],
                                      ["part", "doc_id", "doc_start", "piece", "doc_tokens", last.name])
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, _PIECE + ddl)


def read_pieces(spark, path: str) -> DataFrame:
    """(part, doc_id, doc_start, piece, doc_tokens, ids): every piece of every document;
    ``doc_start`` counts from the file's first id."""
    return _decoded(spark, path, pa.field("ids", pa.binary()), lambda ids, left: ids, "ids binary")


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. The checksum of a
    document that several blocks share is the XOR of its pieces' shares."""
    def share(ids: bytes, left: int) -> int:
        crc = zlib.crc32(ids)
        return crc_share(crc, 4 * left) if left else crc

    rows = _decoded(spark, path, pa.field("crc", pa.int64()), share, "crc bigint")
    per = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    files = per.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    whole = rows.groupBy("part", "doc_start").agg(F.bit_xor("crc").alias("ids_crc32"), F.first("doc_id").alias("doc_id"),
                                                  F.first("doc_tokens").alias("n_tokens"))
    return whole.join(files, "part").select("doc_id", (F.col("_before") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a fresh folder of the session's shared one and read it back."""
    spark = docs.sparkSession
    return read_digests(spark, write_files(docs, shared_path(spark, "token-files"), tokenizer))
