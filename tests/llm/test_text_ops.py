"""Text operators against brute force, on edge rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from mealops.llm import (language, mil_quality, mixing, near_dups, packing, paragraph_sketch, queries,
                         target_ratio, token_lengths, tokens, toxicity, url_trust)
from mealops.llm.common import WordHashes, is_held_out, session, stripped

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _h string, kept string, cell int"
LONG = " ".join(f"w{i % 700}x{i}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from every other animal in the wood today"


def _row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, 0.5, "h", "x", 3)


EDGE = [_row(1, None), _row(2, ""), _row(3, " \t\n\x0b\x0c\r "), _row(4, BASE), _row(5, BASE), _row(6, BASE + " now"),
        _row(6, BASE + " now"), _row(7, "one two three"), _row(8, "one two three", None, None), _row(9, LONG, "fr", "b"),
        _row(10, "été über Straße\nétÉ über\nété über Straße", "fr", "b"), _row(11, "a b c a b c a b c d", "de", "c"),
        _row(None, BASE, "en", "a"), _row(12, "123 456 !!", "de", "c"), _row(13, "##$ %% <b> |x| * & >", "de", "c"),
        _row(14, "<|endoftext|> x\x1cy z 中文字 İ", "en", "d")]


@pytest.fixture(scope="module")
def edge(spark):
    session(spark)
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    session(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in (1, 2, 4, 5, 6, 7, 9, 10, 11, 12)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def _docs(spark, data_dir):
    return [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text", "source").collect()]


# --- quality rules -----------------------------------------------------------------------

def _base(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    repeated = {p for i, t in enumerate(tri) if n[t] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_counts(spark, edge, data_dir):
    for df in (edge, spark.read.parquet(f"{data_dir}/documents.parquet")):
        for r in target_ratio.base_counts(df.select("doc_id", "text")).collect():
            assert tuple(r[c] for c in COUNTS) == _base(r["text"])


def test_target_ratio_by_hand(spark, edge, labels):
    got = target_ratio.judge(edge.select("doc_id", "text"), labels, buckets=64, prior=10.0).collect() \
        if False else target_ratio.judge(edge.select("doc_id", "text"), labels, buckets=64).collect()
    good = {r[0] for r in labels.collect() if r[1] == 1 and r[0] is not None}
    pairs = spark.createDataFrame([(w,) for t in EDGE for w in WORD.findall(t[1] or "")], "w string").distinct()
    cell = {r["w"]: r["c"] for r in pairs.select("w", target_ratio._cell(64, "w").alias("c")).collect()}
    two = spark.createDataFrame([(a, b) for t in EDGE for a, b in zip(WORD.findall(t[1] or ""), WORD.findall(t[1] or "")[1:])],
                                "a string, b string").distinct()
    both = {(r["a"], r["b"]): r["c"] for r in two.select("a", "b", target_ratio._cell(64, "a", "b").alias("c")).collect()}

    def cells(t):
        w = WORD.findall(t or "")
        return [cell[x] for x in w] + [both[p] for p in zip(w, w[1:])]

    n, k = np.ones(64), np.zeros(64)
    for r in EDGE:
        np.add.at(n, cells(r[1]), 1)
        if r[0] in good:
            np.add.at(k, cells(r[1]), 1)
    raw = n / n.sum()
    ratio = np.log((k + target_ratio.PRIOR * raw) / (k.sum() + target_ratio.PRIOR)) - np.log(raw)
    for r in got:
        c = cells(r["text"])
        if not c:
            assert r["log_ratio"] is None and r["base_failed"] and not r["kept"]
        else:
            assert math.isclose(r["log_ratio"], ratio[c].mean(), abs_tol=1e-9)
            assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= target_ratio.MIN_RATIO)


def test_target_ratio_empty(empty, labels):
    assert target_ratio.judge(empty.select("doc_id", "text"), labels).count() == 0


# --- classifiers -------------------------------------------------------------------------

def test_mil_gradient_is_right():
    rng = np.random.default_rng(1)
    m = mil_quality.Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, first, y = rng.random((7, mil_quality.DIM)), np.array([0, 3, 4, 7]), np.array([1.0, 0, 1])

    def loss():
        e = m.encode(x)
        p = m.score(m.attend(e, first)[3])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = m.gradient(x, first, y)
    for k in ("V", "U", "w", "c", "be"):
        at = tuple(0 for _ in m.p[k].shape)
        keep = m.p[k][at]
        m.p[k][at] = keep + 1e-5
        up = loss()
        m.p[k][at] = keep - 1e-5
        down = loss()
        m.p[k][at] = keep
        assert math.isclose((up - down) / 2e-5, g[k][at], rel_tol=1e-3, abs_tol=1e-6), k


@pytest.mark.parametrize("op", [mil_quality.quality_score, toxicity.toxicity_score])
def test_scores_of_edge_rows(spark, edge, empty, labels, op):
    got = edge.select("doc_id", "text", op(edge, labels).alias("s")).collect()
    assert len(got) == len(EDGE) and all(0 <= r["s"] <= 1 for r in got)
    by_text = {}
    for r in got:
        assert math.isclose(by_text.setdefault(r["text"] or "", r["s"]), r["s"], rel_tol=1e-6)
    assert empty.select(op(empty, labels)).count() == 0
    none = labels.filter("doc_id < 0")
    assert {r[0] for r in edge.select(op(edge, none)).collect()} == {0.5}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_mil_quality"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    got = queries.QUERIES["op8_language"](spark, d).filter("held_out").join(
        spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    tox = queries.QUERIES["op7_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == 1 and r["toxic"] == 0 for r in tox) <= 0.02 * len(tox)
    held = [r for r in tox if r["held_out"] and r["toxic"] == 1]
    assert sum(r["predicted"] for r in held) >= 0.6 * len(held)


def test_attention_score_by_loops():
    """The forward pass over whole texts, word by word and passage by passage."""
    model, rng = mil_quality.Model(0.3), np.random.default_rng(2)
    model.p = {k: v + rng.normal(size=v.shape).astype(np.float32) * 0.3 for k, v in model.p.items()}
    p = {k: v.astype(float) for k, v in model.p.items()}
    bags = [None if r[1] is None else r[1].encode() for r in EDGE if r[0] != 9] + [LONG.encode()[:20_000]]
    got = mil_quality.score_texts(model, bags, mil_quality.WordFeatures())
    for text, score in zip(bags, got):
        words, codes, raw = (text or b"").split(), [], []
        for at in range(0, max(1, len(words)), 64):
            x = [0.0] * mil_quality.DIM
            for w in words[at:at + 64]:
                cell = mil_quality.WordFeatures()[w]
                x[cell // mil_quality.WORDS] += 1
                x[mil_quality.SHAPES + cell % mil_quality.WORDS] += 1
            x = [math.sqrt(v / max(1, len(words[at:at + 64]))) for v in x]
            e = [max(0.0, sum(x[i] * p["We"][i][j] for i in range(len(x)) if x[i]) + p["be"][j]) for j in range(mil_quality.CODE)]
            gate = 0.0
            for k in range(mil_quality.GATE):
                t = math.tanh(sum(e[j] * p["V"][j][k] for j in range(len(e))))
                gate += p["w"][k] * t / (1 + math.exp(-sum(e[j] * p["U"][j][k] for j in range(len(e)))))
            codes.append(e)
            raw.append(math.exp(gate))
        z = [sum(a * e[j] for a, e in zip(raw, codes)) / sum(raw) for j in range(mil_quality.CODE)]
        assert score == pytest.approx(1 / (1 + math.exp(-sum(c * v for c, v in zip(p["c"], z)) - float(p["b"]))), abs=1e-4)


def test_ftrl_by_loops():
    """Every coordinate's own rate, L1 and steps, one at a time."""
    rng = np.random.default_rng(9)
    bags = [np.unique(rng.integers(0, 40, 12)) for _ in range(120)]
    y = np.array([float(3 in b or 17 in b) for b in bags])
    bias, at, weight = toxicity.fit(bags, y)
    z, n = Counter(), Counter()

    def value(i):
        l1 = 0.0 if i == "bias" else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(5)
    for _ in range(toxicity.PASSES):
        for d in order.permutation(len(y)):
            own = [*bags[d].tolist(), "bias"]
            w = [value(i) for i in own]
            g = 1 / (1 + math.exp(-sum(w))) - y[d]
            for i, v in zip(own, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * v
                n[i] += g * g
    want = {i: value(i) for i in range(40) if value(i)}
    assert dict(zip(at.tolist(), weight)) == pytest.approx(want) and bias == pytest.approx(value("bias"))


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(3)
    bags, y = [], []
    for i in range(400):
        words = [b"w%d" % v for v in rng.integers(0, 50, 30)] + ([b"vile"] if i % 4 == 0 else [])
        bags.append(toxicity.cells(WordHashes(stripped).of(b" ".join(words))))
        y.append(float(i % 4 == 0))
    bias, at, weight = toxicity.fit(bags, np.array(y))
    dense = np.zeros(toxicity.CELLS)
    dense[at] = weight
    right = [(bias + dense[b].sum() > 0) == (v == 1) for b, v in zip(bags, y)]
    assert np.mean(right) > 0.97 and len(at) < 0.5 * len(np.unique(np.concatenate(bags)))


def test_every_trusted_document_counts(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    ratio = target_ratio.cell_ratios(docs, target_ratio.trusted_ids(labels), buckets=2).first()[0]
    raw = np.sort((np.array([30_000, 0]) + 1) / 30_002)
    want = np.log((np.array([0, 30_000]) + target_ratio.PRIOR * raw) / (30_000 + target_ratio.PRIOR)) - np.log(raw)
    assert sorted(ratio) == pytest.approx(sorted(want))


# --- language ----------------------------------------------------------------------------

def _ngrams(text):
    words = [w for w in regex.split(r"[^\p{L}\p{M}]+", (text or "").lower()) if w]
    n = Counter()
    if words:
        s = " " + " ".join(words) + " "
        for k in (1, 2, 3):
            for i in range(len(s) - k + 1):
                g = s[i:i + k]
                if g != " " and not (k == 3 and g[1] == " "):
                    n[g] += 1
    return n


def _code(g):
    v = 0
    for ch in g:
        v = v << 21 | ord(ch)
    return v


def test_language_profiles_and_distance(spark, edge, empty):
    known = language.loaded(language.profiles(edge, top_n=20))
    held = {r[0]: r[1] for r in edge.select("doc_id", is_held_out(F.col("doc_id"))).collect()}
    want = {}
    for r in EDGE:
        if r[2] and r[1] is not None and not held[r[0]]:
            want.setdefault(r[2], Counter()).update(_ngrams(r[1]))
    want = {k: [_code(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], _code(x[0])))[:20]] for k, c in want.items() if c}
    assert {k: v.tolist() for k, v in known.items()} == want
    compare = language.Comparer(known, 20)
    for r in EDGE:
        own = [_code(g) for g, _ in sorted(_ngrams(r[1]).items(), key=lambda x: (-x[1], _code(x[0])))[:20]]
        if not own:
            assert compare(r[1]) is None
            continue
        away = {k: sum(abs(v.index(g) - i) if g in v else 20 for i, g in enumerate(own)) for k, v in sorted(want.items())}
        best = min(away, key=away.get)
        assert compare(r[1]) == (best, away[best], 20 * len(own))
    assert [compare(t) for t in (None, "", "12 \u00b2 _!", "\u0307")] == [None] * 4
    none = language.profiles(empty)
    assert none.count() == 0 and language.predict(empty, none).count() == 0
    assert {(r["lang_pred"], r["lang_score"]) for r in language.predict(edge, none).collect()} == {("und", 0.0)}


def test_any_number_of_languages(spark, edge):
    """Blocks of one and of two languages, and languages that tie, give what one block gives."""
    twins = edge.withColumn("lang", F.concat("lang", F.lit("-2")))
    learn = edge.unionByName(twins)
    one = {tuple(r) for r in language.predict(edge, language.profiles(learn, 30), 30).select("doc_id", "text", "lang_pred", "lang_score").collect()}
    for block in (1, 2):
        known = language.profiles(learn, 30, block)
        assert known.groupBy("block").agg(F.countDistinct("lang").alias("n")).agg(F.max("n")).first()[0] <= block
        assert {tuple(r) for r in language.predict(edge, known, 30).select("doc_id", "text", "lang_pred", "lang_score").collect()} == one
    assert not any(r[2].endswith("-2") for r in one)


# --- tokens and packing ------------------------------------------------------------------

def _reference_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [[] if x is None else t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_ids_equal_the_tokenizer(spark, data_dir):
    texts = [r[1] for r in EDGE] + [r[1] for r in _docs(spark, data_dir)] + ["é e\u0301", "a\u00a0b\u2003c", "ΑΣ Σ", "don't I'LL 12a"]
    for limit in (400_000, 50):
        ids = tokens.TokenIds(tokens.default_tokenizer(), limit)
        got = [np.frombuffer(b, "<u4").tolist() for at in range(0, len(texts), 40) for b in ids.many(texts[at:at + 40])]
        assert got == _reference_ids(texts)


def _check_packing(rows, docs):
    want = Counter()
    for doc_id, ids in docs:
        ids = np.array(ids + [1], "<u4")
        for at in range(0, len(ids), 2048):
            own = ids[at:at + 2048]
            want[doc_id, at, len(own), zlib.crc32(own.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert not at or (max(at.values()) <= 2048 and sorted(at) == list(range(len(at))))
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in at.values()), sum(at.values())


def test_packing(spark, edge, empty, data_dir):
    _check_packing(packing.pack(edge).collect(), list(zip([r[0] for r in EDGE], _reference_ids([r[1] for r in EDGE]))))
    docs = _docs(spark, data_dir)
    padding, used = _check_packing(packing.pack(spark.read.parquet(f"{data_dir}/documents.parquet")).collect(),
                                   list(zip([r[0] for r in docs], _reference_ids([r[1] for r in docs]))))
    assert padding <= 0.02 * used
    assert packing.pack(empty).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(0)
    for size in (0, 1, 7, 5000):
        h = np.bincount(rng.integers(1, 2049, size), minlength=2049)
        used = np.zeros(2049, np.int64)
        for own, repeats in packing.plan(h):
            assert sum(own) <= 2048 and repeats > 0
            np.add.at(used, own, repeats)
        assert (used == h).all()


def test_nnls_solves():
    combos = np.array([[1500, 548, 0], [1024, 1024, 0], [1000, 548, 500]])
    h = np.zeros(2049)
    h[[1500, 548, 1024, 1000, 500]] = [10, 14, 8, 4, 4]
    assert np.allclose(packing.nnls(combos, h), [10, 4, 4], atol=0.05)


def test_token_lengths(spark, edge, empty):
    sums = token_lengths.suffix_sums(token_lengths.length_histogram(edge))
    n = sorted(len(x) for x in _reference_ids([r[1] for r in EDGE]))
    got = {r["length"]: r for r in sums.collect()}
    assert sorted(got) == sorted(set(n))
    for v, r in got.items():
        assert r["n_docs"] == n.count(v) and r["docs_at_least"] == sum(x >= v for x in n)
        assert r["tokens_at_least"] == sum(x for x in n if x >= v)
        assert r["tokens_within"] == sum(min(x, v) for x in n)
        assert r["share_fitting"] == pytest.approx(sum(x <= v for x in n) / len(n))
    limits = [0, 5, 21, 10**6]
    for r in token_lengths.totals_at(sums, limits).collect():
        assert r["tokens_within"] == sum(min(x, r["limit_at"]) for x in n)
        assert r["docs_cut"] == sum(x > r["limit_at"] for x in n)
    assert [r["length"] for r in token_lengths.quantile(sums, [0.5, 1.0]).collect()] == [n[(len(n) + 1) // 2 - 1], n[-1]]
    assert token_lengths.suffix_sums(token_lengths.length_histogram(empty)).count() == 0


# --- near-duplicates ---------------------------------------------------------------------

def _set(text):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(w)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute_components(rows):
    sets = [(i, _set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if a is None or b is None or not s or not t or min(len(s), len(t)) * 100 < 75 * max(len(s), len(t)):
            continue
        if 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return Counter((i, len(s), find(i), i is None or find(i) == i) for i, s in sets)


def test_near_duplicates(spark, edge, empty, data_dir):
    as_counter = lambda df: Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert as_counter(near_dups.near_duplicates(edge)) == _brute_components([(r[0], r[1]) for r in EDGE])
    docs = _docs(spark, data_dir)
    assert as_counter(near_dups.near_duplicates(spark.read.parquet(f"{data_dir}/documents.parquet"))) == \
        _brute_components([(r[0], r[1]) for r in docs])
    assert near_dups.near_duplicates(empty).count() == 0


def test_near_duplicate_families(spark):
    """Chains and families of edited copies around the threshold, next to unrelated texts
    that share a passage."""
    rng = np.random.default_rng(4)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for family in range(6):
        words = [f"f{family}w{v}" for v in rng.integers(0, 10**6, 150)]
        for copy in range(25):
            w = list(words)
            for at in rng.integers(0, len(w), rng.integers(0, 9)):
                w[at] = f"e{rng.integers(0, 10**6)}"
            rows.append(" ".join(w))
            if copy % 5 == 0:
                words = w  # the family drifts
    rows += [" ".join(passage + [f"u{v}" for v in rng.integers(0, 10**7, 40)]) for _ in range(60)]
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[k]) for i, k in enumerate(order)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == _brute_components(rows)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for size in (1, 3, 40, 900):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = a.copy()
        b[: size // 5] = rng.integers(0, 2**63, size // 5).astype(np.uint64)
        s = near_dups.sketches([np.unique(a), np.unique(b), np.unique(a)])
        assert (s[0] == s[2]).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - j) < 0.2


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (202, 201), (7, 7)]
    got = {r["node"]: r["label"] for r in near_dups.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


# --- mixing ------------------------------------------------------------------------------

def _targets(sizes, weights=(5, 2, 1)):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {k: w[k] for k in names if k not in full}
        left = goal - sum(full.values())
        share = {k: left * v / sum(rest.values()) for k, v in rest.items()}
        over = [k for k in rest if share[k] >= 2 * sizes[k]]
        if not over:
            return {**full, **share}
        full |= {k: 2.0 * sizes[k] for k in over}


def test_mixing(spark, edge, empty, data_dir):
    for df in (edge, spark.read.parquet(f"{data_dir}/documents.parquet")):
        got = mixing.mix(df).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in df.select("doc_id").collect())
        sizes, taken = Counter(), Counter()
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
        want = _targets(sizes)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        for k, v in want.items():
            assert abs(taken[k] - v) <= 1 + 1e-6 * v
        assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0


def test_mixed_rows(spark, data_dir):
    df = spark.read.parquet(f"{data_dir}/documents.parquet").withColumn("_h", F.lit(1)).withColumn("taken", F.lit("x"))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = Counter(r[0] for r in out.select("doc_id").collect())
    for r in mixing.mix(df).collect():
        assert copies[r["doc_id"]] == (math.floor(r["taken"] / r["size"] + 0.5) if r["size"] else 0)


def test_mixing_slices_behind_the_budget_are_not_sorted(spark, monkeypatch):
    docs = spark.createDataFrame([_row(i, "a b c d e", "en", "aaaaaaaaaaabbccccccc"[i % 20]) for i in range(2700)], SCHEMA)
    kind, seen = type(docs), []
    plain = kind.withColumn

    def spy(self, name, col):
        if name == "_run":
            seen.extend(r["count"] for r in self.groupBy("_slice").count().collect())
        return plain(self, name, col)

    monkeypatch.setattr(kind, "withColumn", spy)
    rows = mixing.mix(docs).collect()
    for source in "abc":
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"])
    assert min(r["target"] / r["source_size"] for r in rows) < 0.65  # finish times above 3
    assert max(seen) <= 400


# --- url filters -------------------------------------------------------------------------

def test_host_and_path(spark):
    urls = ["HTTP://A.Example.ORG:80/P/q?x#y", "http://x.org", "http://x.org?a/b", "x.org/a", None, "a://b://c/d", "http://É.com/é#", "://", ""]
    want = [("a.example.org:80", "/P/q"), ("x.org", ""), ("x.org", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("É.com", "/é"), ("", ""), ("", "")]
    host, path = url_trust.host_and_path(F.col("url"))
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", host, path).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == want


def test_url_trust_by_hand(spark):
    link = lambda *h: "".join(f"<a href='https://{x}/p'>x</a>" for x in h)
    pages = [(1, "http://good.org/a", link("mid.net", "mid.net", "good.org")), (2, "http://mid.net/a", link("end.net")),
             (3, "http://bad.com/de/1", None), (4, "http://farm.net/x", link("bad.com")), (4, "http://farm.net/x", link("bad.com")),
             (5, "http://lone.net/", "<a href='/x'>"), (6, None, link("end.net")), (7, "http://sub.example.org/es/", ""),
             (8, "http://example.org/en/12", ""), (9, "http://bad.com/en/", ""), (10, "http://Far.net", link("FARM.net:8080"))]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r["page_id"]: r for r in url_trust.judge(df).collect()}
    assert url_trust.judge(df).count() == len(pages)
    assert [got[i]["rule"] for i in (1, 3, 7, 8, 2)] == ["org/", "com/de/", "example.org/es/", "example.org/en/1", None]
    assert [got[i]["verdict"] for i in range(1, 11)] == ["allow", "allow", "block", "block", "allow", "allow", "block", "block", "block", "block"]
    # power iteration on a matrix
    hosts = ["good.org", "mid.net", "end.net", "bad.com", "farm.net", "far.net", "sub.example.org", "example.org"]
    at = {h: i for i, h in enumerate(hosts)}
    a = np.zeros((8, 8))
    for s, t, n in [("good.org", "mid.net", 2), ("mid.net", "end.net", 1), ("farm.net", "bad.com", 2), ("far.net", "farm.net", 1)]:
        a[at[s], at[t]] = n
    for kind, m, start in (("trust", a, {"good.org": 1}), ("distrust", a.T, {"bad.com": 0.5, "sub.example.org": 1, "example.org": 1})):
        p = m / np.maximum(m.sum(1, keepdims=True), 1)
        s = np.zeros(8)
        for h, v in start.items():
            s[at[h]] = v
        r = s.copy()
        for _ in range(200):
            r = 0.15 * s + 0.85 * r @ p
        r /= r.sum()
        for row in got.values():
            if row["host"] in at:
                assert row[kind] == pytest.approx(r[at[row["host"]]], abs=1e-3)
    none = url_trust.judge(df.filter("page_id < 0"))
    assert none.count() == 0


def test_url_trust_reaches_far_beside_unlinked_hosts(spark):
    hops = 12
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(hops)], "src string, dst string, n bigint")
    start = spark.createDataFrame([("distrust", f"h{hops}", 1.0)], "kind string, host string, seed double")
    many = spark.range(200_000).select(F.lit("trust").alias("kind"), F.concat(F.lit("u"), "id").alias("host"), F.lit(1.0).alias("seed"))
    scores = url_trust.spread(edges, start.unionAll(many))
    got = {r["host"]: r["score"] for r in scores.filter("kind = 'distrust'").collect()}
    want = [0.85 ** (hops - i) for i in range(hops + 1)]
    assert len(got) == hops + 1
    for i, w in enumerate(want):
        assert got[f"h{i}"] / sum(got.values()) == pytest.approx(w / sum(want), rel=1e-6)
    assert scores.filter("kind = 'trust'").count() == 200_000


def test_url_trust_one_host_for_all_ports(spark):
    link = lambda h: f"<a href='http://{h}/p'>x</a>"
    pages = [(1, "http://bad.com/de/1", None), (2, "http://bad.com:8080/x", link("bad.com")), (3, "http://u@farm.net:81/x", link("Bad.com:9")),
             (4, "http://farm.net/", None), (5, "http://good.org/a", link("mid.net:7")), (6, "http://mid.net:9/x", None)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    edges = {(r["src"], r["dst"]) for r in url_trust.host_edges(url_trust.parsed(df)).collect()}
    assert edges == {("farm.net", "bad.com"), ("good.org", "mid.net")}
    got = {r["page_id"]: r for r in url_trust.judge(df).collect()}
    assert [got[i]["verdict"] for i in range(1, 7)] == ["block", "block", "block", "block", "allow", "allow"]
    assert got[6]["trust"] > 0 and got[4]["distrust"] == got[3]["distrust"] > 0
    assert got[2]["host"] == "bad.com:8080" and got[3]["host"] == "u@farm.net:81"


def test_url_trust_verdict_without_links_is_the_hosts_own(spark):
    pages = [(0, "http://x.com/de/1", None), (1, "http://x.com/other", None)] + [(2 + i, f"http://x.com/fr/{i}", None) for i in range(99)]
    pages += [(1000 + i, f"http://t{i}.org/", None) for i in range(1000)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r["page_id"]: r for r in url_trust.judge(df).collect()}
    assert [got[i]["verdict"] for i in (0, 1, 2, 1000)] == ["block", "allow", "allow", "allow"]
    assert sum({r["host"]: r["trust"] for r in got.values()}.values()) == pytest.approx(1)


# --- fingerprints ------------------------------------------------------------------------

def _paragraphs(text):
    return {x for x in (text or "").split("\n") if WORD.search(x)}


def _check_fingerprints(rows, docs):
    order = sorted(docs, key=lambda r: -r[0])
    want = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), like(_paragraphs(t), _paragraphs(e)), like(_paragraphs(t), _paragraphs(nxt)))
    for r in rows:
        n, sha, near, nxt = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(near) and r["near_next"] == pytest.approx(nxt)
    by_text = {}
    text = dict(docs)
    for r in rows:
        assert by_text.setdefault(text[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]


def test_next_document_over_many_cells(spark, monkeypatch):
    """Gaps, repeated and NULL ids over two levels of bounds: the next row is the plain order's."""
    rows = [(None if i % 61 == 0 else (i * i) % 997 - 200, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_h", F.xxhash64("text"))
    order = [r["text"] for r in sorted(df.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["_h"]))]
    want = dict(zip(order, order[1:] + order[:1]))
    for cells, level in ((3, 1_000), (300, 1_000), (3, 2)):
        monkeypatch.setattr(paragraph_sketch, "_ROWS_A_CELL", cells)
        monkeypatch.setattr(paragraph_sketch, "_LEVEL", level)
        got = paragraph_sketch.with_next(df.drop("_h")).collect()
        assert {r["text"]: r["next_text"] for r in got} == want and len(got) == 300
    assert len({r["cell"] for r in got}) == 4  # two parts of two cells at most


def test_fingerprints(spark, edge, empty, data_dir, monkeypatch):
    unique = {r[0]: r for r in EDGE if r[0] is not None}
    df = spark.createDataFrame(list(unique.values()), SCHEMA)
    monkeypatch.setattr(paragraph_sketch, "_ROWS_A_CELL", 4)
    _check_fingerprints(paragraph_sketch.fingerprints(df).collect(), [(i, r[1]) for i, r in unique.items()])
    assert paragraph_sketch.fingerprints(edge).count() == len(EDGE)
    assert paragraph_sketch.fingerprints(empty).count() == 0
    monkeypatch.setattr(paragraph_sketch, "_ROWS_A_CELL", 37)
    docs = [(r[0], r[1]) for r in _docs(spark, data_dir)]
    got = paragraph_sketch.fingerprints(spark.read.parquet(f"{data_dir}/documents.parquet")).collect()
    assert len(got) == len(docs)
    _check_fingerprints(got, docs)


def test_peeling_recovers_the_difference(spark):
    a, b = [10, 20, 30, 40, -5], [20, 40, 77, 99]
    row = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    cells = paragraph_sketch.subtract(paragraph_sketch.table(F.col("a"), 16), paragraph_sketch.table(F.col("b"), 16))
    got = row.select(paragraph_sketch.peel(cells, F.concat("a", "b"), 16).alias("g")).first()["g"]
    assert {(r["key"], r["sign"]) for r in got} == {(10, 1), (30, 1), (-5, 1), (77, -1), (99, -1)}
    # a table too small for the difference says so
    many = spark.createDataFrame([([*range(60)], [])], "a array<bigint>, b array<bigint>")
    cells = paragraph_sketch.subtract(paragraph_sketch.table(F.col("a"), 4), paragraph_sketch.table(F.col("b"), 4))
    assert many.select(paragraph_sketch.peel(cells, F.col("a"), 4)).first()[0] is None


# --- queries against SQL -----------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, data_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data_dir)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in rel.fetchall())
