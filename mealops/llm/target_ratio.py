"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the corpus.

Words and word pairs fall into ``BUCKETS`` cells. Two smoothed multinomials over the cells,
one of trusted documents and one of the whole corpus, give each cell a log ratio; a document
scores the mean over its words and pairs and stays when that reaches the threshold. The cell
table has a fixed size and reaches the tasks as one array; only trusted texts are shuffled.

Defined results: a NULL or empty text has no words, fails the base rules and has no ratio;
repeated rows are judged alike, each on its own; extra columns are ignored; with an empty
table or no trusted document every cell ratio is 0 or small and the base rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words
from .near_dups import _sifted

BUCKETS = 1 << 15
#: Weight of the corpus shares in the target's, in words and pairs.
PRIOR = 200_000.0
#: Documents below this mean log ratio (nats a word) are unlike the target.
MIN_RATIO = -0.08


def _hashes(df: DataFrame) -> DataFrame:
    """Adds ``_w`` words, ``_h`` their hashes."""
    df = df.withColumn("_w", words(F.col("text")))
    return df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))


def _tail(array: str, skip: int) -> Column:
    """The array without its first ``skip`` items."""
    return F.slice(array, skip + 1, F.greatest(F.size(array) - skip, F.lit(0)))


def _head(array: str, drop: int) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - drop, F.lit(0)))


def _cell(buckets: int, *parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets).cast("long")).cast("int")


def _cells(df: DataFrame, buckets: int) -> DataFrame:
    """Adds ``_cells``: the cell of every word and of every pair of neighbours."""
    pair = F.zip_with(_head("_w", 1), _tail("_w", 1), lambda a, b: _cell(buckets, a, b))
    return df.withColumn("_cells", F.concat(F.transform("_w", lambda w: _cell(buckets, w)), pair))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def cell_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS,
                prior: float = PRIOR) -> DataFrame:
    """One row, ``ratios``: the log ratio of target to corpus in every cell.

    Corpus cells are counted where the texts are read, with no join. Trusted texts are those that
    pass a bitmap of trusted ids, of fixed size, where they are read, and then an exact join on
    ids by sorting: little more than the trusted texts moves, by one plan at every size."""
    def counts(texts: DataFrame, name: str) -> DataFrame:
        # exploded before hashing: generated code all the way to the partial sums
        neighbours = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))).alias("b"))
        pairs = texts.select(words(F.col("text")).alias("_w")).select(F.explode(neighbours).alias("p"))
        cell = F.array(_cell(buckets, "p.a"), F.when(F.col("p.b").isNotNull(), _cell(buckets, "p.a", "p.b")))
        return (pairs.select(F.explode(cell).alias("cell")).filter("cell IS NOT NULL")
                .groupBy("cell").agg(F.count("*").alias(name)))

    chosen = _sifted(docs, trusted).join(trusted.hint("merge"), "doc_id", "left_semi")
    counted = counts(docs, "n").join(counts(chosen, "k"), "cell", "left")
    spark = docs.sparkSession
    full = (spark.range(buckets).select(F.col("id").cast("int").alias("cell"))
            .join(counted, "cell", "left").na.fill(0, ["n", "k"]))
    # the rows are a fixed number of cells, gathered once into one array
    packed = full.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("cell", "n", "k"))).alias("c"),
        F.sum("n").alias("N"), F.sum("k").alias("K"))
    # add-one corpus shares; the target is drawn towards them, so a thin target says little
    corpus = lambda c: (c["n"] + 1.0) / (F.col("N") + buckets)
    ratio = lambda c: F.log((c["k"] + prior * corpus(c)) / (F.col("K") + prior)) - F.log(corpus(c))
    return packed.select(F.transform("c", ratio).alias("ratios"))


def _repeat_words() -> Column:
    """Words inside three-word windows that the text has twice or more (``_tri`` are the
    windows' hashes): repeated starts are neighbours in (hash, place) order, and each adds up
    to three words before the next start."""
    return F.when(F.size(F.array_distinct("_tri")) == F.size("_tri"), F.lit(0)).otherwise(
        F.aggregate(
            F.zip_with("_starts", _tail("_starts", 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            F.lit(0), lambda s, x: s + F.least(F.lit(3), F.coalesce(x["b"] - x["a"], F.lit(3)))))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds ``_h`` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    df = _hashes(docs)
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("_lines", lines).withColumn(
        "_tri", F.zip_with(F.zip_with(_head("_h", 2), F.slice("_h", 2, F.greatest(F.size("_h") - 2, F.lit(0))),
                                      lambda a, b: F.xxhash64(a, b)),
                           _tail("_h", 2), lambda p, c: F.xxhash64(p, c)))
    df = df.withColumn("_placed", F.when(
        F.size(F.array_distinct("_tri")) == F.size("_tri"), F.array().cast("array<struct<h:bigint,i:int>>"))
        .otherwise(F.sort_array(F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # each run of equal hashes: an item is repeated when its left or right neighbour is equal
    same = F.zip_with(_head("_placed", 1), _tail("_placed", 1), lambda a, b: a["h"] == b["h"])
    df = df.withColumn("_same", same)
    repeated = F.zip_with(
        "_placed", F.zip_with(F.concat(F.array(F.lit(False)), "_same"), F.concat("_same", F.array(F.lit(False))),
                              lambda a, b: a | b),
        lambda p, r: F.when(r, p["i"]))
    df = df.withColumn("_starts", F.when(F.size("_placed") == 0, F.array().cast("array<int>"))
                       .otherwise(F.sort_array(F.array_compact(repeated))))
    return (df.withColumn("n_words", F.size("_w").cast("long"))
            .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
            .withColumn("n_symbols", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long"))
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("n_repeat_words", _repeat_words().cast("long"))
            .drop("_lines", "_tri", "_placed", "_same", "_starts"))


def judge(docs: DataFrame, labels: DataFrame, min_ratio: float = MIN_RATIO,
          buckets: int = BUCKETS) -> DataFrame:
    """Every document with its counts, ``base_failed``, ``log_ratio`` and ``kept``; the
    columns of ``docs`` stay. Base rules: fewer than 50 words, or more than half of them
    repeated."""
    ratios = cell_ratios(docs, trusted_ids(labels), buckets)
    df = _cells(base_counts(docs), buckets).withColumn("_table", ratios.scalar())
    total = F.aggregate("_cells", F.lit(0.0), lambda s, c: s + F.get("_table", c))
    df = df.withColumn("log_ratio", F.when(F.size("_cells") > 0, total / F.size("_cells")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # the row number, never negative, keeps a later filter on ``kept`` above this projection:
    # pushed below, it would repeat every array expression for each use
    here = F.monotonically_increasing_id() >= 0
    return (df.withColumn("base_failed", failed)
            .withColumn("kept", ~failed & F.coalesce(F.col("log_ratio") >= min_ratio, F.lit(False)) & here)
            .drop("_w", "_h", "_cells", "_table"))
