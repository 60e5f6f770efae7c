"""Phrase mining, token files and conversation repair against brute force and round trips."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mealops.llm import collocations, conversations, queries, token_files, tokens
from mealops.llm.common import session

SCHEMA = "doc_id bigint, text string, lang string, score double, phrase string, part int, ids binary"
LONG = " ".join(f"w{i % 700}x{i}" for i in range(30_000))


def _row(i, text, lang="en"):
    return (i, text, lang, 0.5, "x", 3, b"q")


SAID = "Of the one. of the one of THE one; the one of\nthe one\tof the  one two"
EDGE = [_row(1, None), _row(2, ""), _row(3, " \t\n\x0b\x0c\r . !? "), _row(4, SAID), _row(5, SAID), _row(5, SAID), _row(6, "a a a a a a", None),
        _row(7, "a a a a. a a", "und"), _row(8, LONG, "fr"), _row(9, "é É été. été été été É", "fr"), _row(None, "of the one", "en"),
        _row(10, "x\x1cy x\x85y x y x y", "de"), _row(-4, "<|endoftext|> of the", "de"), _row(11, "x\x1cy x\x85y", "de")]


@pytest.fixture(scope="module")
def edge(spark):
    session(spark)
    return spark.createDataFrame(EDGE, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    session(spark)
    return spark.createDataFrame([], SCHEMA)


# --- phrases -----------------------------------------------------------------------------

def _mined(rows, least, top):
    f = Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    n = Counter()
    for (lang, w), c in f.items():
        n[lang] += c if len(w) == 1 else 0
    cands = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= least}
    out = {}
    for (lang, w), a in cands.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = any(la == lang and len(v) > len(w) and 100 * b >= 80 * a and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
                     for (la, v), b in cands.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank, p.decode(), -a, le, ri, n[lang], -s) for lang, found in out.items()
            for rank, (s, a, p, le, ri) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("least,top", [(1, 50), (2, 2000), (4, 3)])
def test_phrases_by_brute_force(edge, least, top):
    rows = [r for r in EDGE if r[0] != 8] if least == 1 else EDGE
    got = collocations.collocations(edge.filter("doc_id IS NULL OR doc_id <> 8") if least == 1 else edge, least, top)
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = [tuple(r[c] for c in cols) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _mined(rows, least, top)


def test_phrases_of_many_shards(spark):
    """Spread over more partitions than the support, with one phrase in every row."""
    rng = random.Random(3)
    rows = [_row(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) + ". hot phrase here", rng.choice(["en", "en", "de", None]))
            for i in range(400)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(23), 30, 2000)
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect()} == _mined(rows, 30, 2000)


def test_local_support_loses_nothing(edge):
    """Every phrase that reaches the support is in the union of the shards' own."""
    found, buckets = collocations.candidates(edge, 3)
    for lang, phrase, there in [("en", b"of the one", True), ("und", b"a a a", True), ("fr", b"of the one", False)]:
        h = collocations._Words32().of_tokens(phrase.split()).astype(np.uint64)
        *_, runs = collocations._levels(h, len(h))
        assert collocations._often(np.frombuffer(found[len(h) - 1].value, np.uint8), collocations._keys(runs, buckets), collocations._salt(lang)).all() == there


def test_phrases_of_one_shard_alone(spark):
    """What one shard has often is no candidate if all shards have it too seldom; nor is what holds it."""
    rows = [_row(i, "a b c d. " * 30 + ("rare pair here. " * 12 if i == 0 else "some other text. " * 12)) for i in range(4)]
    session(spark)
    found, buckets = collocations.candidates(spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), SCHEMA), 30)
    for phrase, there in [(b"rare", False), (b"rare pair", False), (b"rare pair here", False), (b"some other text", True), (b"a b c d", True)]:
        h = collocations._Words32().of_tokens(phrase.split()).astype(np.uint64)
        *_, runs = collocations._levels(h, len(h))
        keys = collocations._keys(runs, buckets)
        assert collocations._often(np.frombuffer(found[len(h) - 1].value, np.uint8), keys, collocations._salt("en")).all() == there
        assert (collocations._unpacked(collocations._packed(keys), int(keys[0]) >> 32) == keys).all()


def test_phrases_empty_and_sql(spark, empty, data_dir):
    assert collocations.collocations(empty).count() == 0
    con = duckdb.connect()
    for d in (data_dir, "/root/testdata/sf0.01"):
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
        rel = con.sql(queries.ORACLES["op11_collocations"])
        want = {tuple(r) for r in rel.fetchall()}
        assert {tuple(r[c] for c in rel.columns) for r in queries.QUERIES["op11_collocations"](spark, d).collect()} == want


def test_scores_past_64_bits(spark):
    big = 2 ** 62
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1), ("en", "c", 1, big),
                                    ("en", "a b c", 3, big // 5 * 4)], "lang string, phrase string, k int, f bigint")
    got = {r["phrase"]: r["score"] for r in collocations.scored(counts).collect()}
    # "a b c" has just under 80 % of "a b"; its parts "a" and "b c" are no candidate
    assert got["a b"] == 2_000_000 * (big - 1) // (2 * big)


# --- token files -------------------------------------------------------------------------

def _ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [([] if x is None else t.encode(x, add_special_tokens=False).ids) + [1] for x in texts]


def _plain_lengths(counts):
    """Huffman without a limit, by a heap."""
    heap = [(c, i, (i,)) for i, c in enumerate(counts) if c]
    out = Counter()
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            out[i] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return out


def _least_cost(counts, limit):
    best = None
    for lengths in itertools.product(range(1, limit + 1), repeat=len(counts)):
        if sum(2.0 ** -n for n in lengths) <= 1:
            cost = sum(c * n for c, n in zip(counts, lengths))
            best = cost if best is None else min(best, cost)
    return best


def test_code_lengths_are_least():
    rng = np.random.default_rng(2)
    for limit, size in [(3, 5), (4, 5), (3, 8), (2, 3)]:
        for _ in range(4):
            counts = rng.integers(1, 60, size)
            lengths = token_files.code_lengths(counts, limit)
            assert lengths.max() <= limit and sum(2.0 ** -int(n) for n in lengths) <= 1
            if size <= 5:
                assert int((counts * lengths).sum()) == _least_cost(counts.tolist(), limit)
    counts = rng.zipf(1.3, 3000) % 100_000 + 1
    lengths = token_files.code_lengths(counts, 30)
    assert int((counts * lengths).sum()) == sum(int(counts[i]) * n for i, n in _plain_lengths(counts.tolist()).items())
    assert token_files.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0]
    assert token_files.code_lengths(np.zeros(3, np.int64)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, np.int64), 3)


def test_codes_decode_from_every_checkpoint():
    rng = np.random.default_rng(4)
    for size in (1, 2, 127, 128, 129, 5000):
        ids = np.minimum(rng.zipf(1.2, size), 70_000) % 49_000
        lengths = token_files.code_lengths(np.bincount(ids), 16)
        codes = token_files.canonical(lengths)
        bits, points = token_files.pack_bits(ids, lengths, codes)
        assert token_files.Decoder(lengths)(bits, points, size).tolist() == ids.tolist()
        plain = "".join(format(int(codes[i]), f"0{lengths[i]}b") for i in ids)
        assert "".join(format(b, "08b") for b in bits).startswith(plain)
        if size > 128:  # the second stretch alone
            rest = token_files.Decoder(lengths)(bits, points[1:2], min(128, size - 128))
            assert rest.tolist() == ids[128:256].tolist()


def test_checksum_shares():
    rng = random.Random(1)
    for parts in ([0], [5], [4, 0, 9], [1000, 1, 70_000, 3]):
        pieces = [rng.randbytes(n) for n in parts]
        got, left = 0, sum(parts)
        for p in pieces:
            left -= len(p)
            got ^= token_files.crc_share(zlib.crc32(p), left)
        assert got == zlib.crc32(b"".join(pieces))


@pytest.mark.parametrize("block", [1 << 18, 64])
def test_files_round_trip(spark, edge, data_dir, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK", block)
    docs = spark.read.parquet(f"{data_dir}/documents.parquet") if block > 64 else edge
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    path = token_files.write_files(docs, str(tmp_path / f"f{block}"), files=3)
    got = sorted((tuple(r) for r in token_files.read_digests(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    ids = {(d, zlib.crc32(np.array(x, "<u4").tobytes())): x for (d, _), x in zip(rows, _ids([t for _, t in rows]))}
    assert [r[0] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert [r[1] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is None, d or 0))
    assert Counter((d, c) for _, d, _, c in got) == Counter((d, zlib.crc32(np.array(x, "<u4").tobytes()))
                                                             for (d, _), x in zip(rows, _ids([t for _, t in rows])))
    assert all(n == len(ids[d, c]) for _, d, n, c in got)
    # files follow one another in order of ids, blocks inside them too
    blocks = sorted(spark.read.parquet(f"{path}/blocks").collect(), key=lambda b: (b["part"], b["block"]))
    order = [d for b in blocks for d in b["doc_id"]]
    assert order == sorted(order, key=lambda d: (d is None, d or 0))
    assert all(b["n"] <= block and len(b["checkpoints"]) == -(-b["n"] // token_files.STRIDE) for b in blocks)
    # ids themselves come back
    text = {(r["doc_id"], r["part"], r["doc_start"]): [] for r in token_files.read_pieces(spark, path).collect()}
    for r in sorted(token_files.read_pieces(spark, path).collect(), key=lambda r: r["piece"]):
        text[r["doc_id"], r["part"], r["doc_start"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert sorted(text.values()) == sorted(_ids([t for _, t in rows]))
    if block > 64:  # coded ids are smaller than two bytes each
        assert sum(len(b["bits"]) for b in blocks) < 1.9 * sum(b["n"] for b in blocks)


def test_files_of_nothing(spark, empty):
    assert token_files.round_trip(empty).count() == 0
    one = spark.createDataFrame([_row(3, None), _row(3, None), _row(None, "")], SCHEMA)
    crc = zlib.crc32(np.array([1], "<u4").tobytes())
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(one).collect()) == [
        (0, 3, 1, crc), (1, 3, 1, crc), (2, None, 1, crc)]


# --- conversations -----------------------------------------------------------------------

def _searched(turns):
    """(cost, audit, repaired) by trying every edit, cheapest and ASCII-least first."""
    def fits(roles):
        return re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r in roles)) is not None

    best = None
    for deep in range(len(turns) + 1 + 1):  # insertions
        for spots in itertools.combinations_with_replacement(range(len(turns) + 1), deep):
            for edits in itertools.product("DKR", repeat=len(turns)):
                if any(must and e != "D" for e, (_, _, must, _) in zip(edits, turns)):
                    continue
                audit, slots, cost = "", [], 3 * deep
                for i in range(len(turns) + 1):
                    n = spots.count(i)
                    audit += "I" * n
                    slots += [(None, "")] * n
                    if i < len(turns):
                        role, text, _, short = turns[i]
                        audit += edits[i]
                        cost += {"D": 4, "K": 3 * short, "R": 3 + 3 * short}[edits[i]]
                        if edits[i] != "D":
                            slots.append((role if edits[i] == "K" else None, text))
                if best is not None and (cost, audit) >= best[:2]:
                    continue
                for free in itertools.product(("user", "assistant"), repeat=sum(r is None for r, _ in slots)):
                    it = iter(free)
                    roles = [next(it) if r is None else r for r, _ in slots]
                    if fits(roles):
                        best = (cost, audit, "\n".join(f"{r}:{t}" for r, (_, t) in zip(roles, slots)))
                        break
    return best


def _wordy(text):
    return re.search("[^\x20\x09-\x0d]", text)


def _reported(rows):
    """The contract's row for one conversation's (turn, role, text) after damage, in order."""
    seen, turns, faults = set(), [], Counter()
    for _, role, text in rows:
        last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
        kind = "blank" if not _wordy(text) else "duplicate" if (role, text) in seen else "truncated" if last not in (".", "!", "?") else None
        seen.add((role, text))
        faults[kind] += 1
        turns.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
    initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for _, r, _ in rows)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, audit, text = _searched(turns) if turns else (0, "", "")
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"],
            sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def _damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if code:
            row = (turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
            own += [row] * (2 if code == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CONV = "conv_id bigint, turn bigint, role string, text string"


def test_parser_against_search():
    rng = random.Random(8)
    for _ in range(60):
        turns = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), f"t{i}", rng.random() < 0.2, rng.random() < 0.3)
                 for i in range(rng.randrange(1, 5))]
        letters = "".join("x" if must else (r[:1] if r[:1] in ("s", "u", "a") else "-") if not short else (r[:1].upper() if r[:1] in ("s", "u", "a") else "+")
                          for r, _, must, short in turns)
        for cut in range(len(letters) + 1):  # in one block and in two
            fold = conversations.Fold()
            for part in (letters[:cut], letters[cut:]):
                fold.add([{"s": s, "t": t, "cost": c, "audit": a} for s in range(4) for t, c, a in conversations.effect(part, s)])
            assert fold.best() == _searched(turns)[:2]


def test_repair_query_by_search(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(1, 5)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]) if turn else turn, rng.choice(["user", "assistant", "system", "tool", None, ""]),
                         rng.choice(["Yes.", "No!  \n", "cut off", "", " \t", None, f"turn {turn}?", "Yes."])))
    # turns of one number with different texts have no order of their own: one of each is kept
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    extra = spark.createDataFrame([(*r, 1, "z") for r in rows], CONV + ", n bigint, fault string")
    extra.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == {c: _reported(r) for c, r in _damage(rows).items()}


def test_repair_query_on_the_tables(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    small = {c: r for c, r in _damage(rows).items() if len(r) <= 5}
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_conversation_repair"](spark, data_dir).collect()}
    assert len(got) == len({r[0] for r in rows}) and {c: got[c] for c in small} == {c: _reported(r) for c, r in small.items()}


def test_one_long_conversation(spark, monkeypatch):
    """Several blocks and ranges give the same as one fold over all turns; texts come back."""
    monkeypatch.setattr(conversations, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"t {t}.", f"t {t}", "same.", ""])) for t in range(400)]
    rows += [(1, 400, "user", "again.")] * 300 + [(2, None, "assistant", "hello."), (None, 0, "user", "lone.")]
    df = spark.createDataFrame(rows, CONV).repartition(4)
    found = conversations.repairs(df)
    got = {r["conv_id"]: r for r in found.collect()}
    seen, letters = set(), ""
    for _, _, role, text in sorted(rows[:400], key=lambda r: r[1]) + rows[400:700]:
        must = not text or (role, text) in seen
        seen.add((role, text))
        letters += "x" if must else role[0] if text.endswith(".") else role[0].upper()
    tops = conversations._inserted({conversations.START: (0, "")})
    for letter in letters:
        tops = conversations.step(tops, letter)
    best = min(tops[s] for s in (conversations.START, conversations.ASSISTANT))
    assert (got[1]["cost"], got[1]["audit"]) == best
    assert (got[2]["cost"], got[2]["audit"]) == (3, "IK") and (got[None]["cost"], got[None]["audit"]) == (3, "KI")
    back = sorted(conversations.repaired(df, found).filter("conv_id = 1").collect(), key=lambda r: r["place"])
    assert [r["place"] for r in back] == list(range(len(back)))
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in back))
    assert "".join(r["edit"] for r in back) == best[1].replace("D", "")
    digest = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repaired_digests(df, found).collect()}
    assert digest[1] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in back).encode()).hexdigest()


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONV)
    found = conversations.repairs(conversations.damaged(none))
    assert found.count() == 0 and conversations.repaired(none, found).count() == 0 and conversations.repaired_digests(none, found).count() == 0


def test_repeated_turns_are_counted_not_gathered(spark):
    df = spark.range(20_000, numPartitions=4).select(F.lit(5).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"),
                                                     F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    assert [(r["n"], r["first"]) for r in conversations.faults(df).collect()] == [(20_000, True)]
    r = conversations.repairs(df).first()
    assert (r["duplicate"], r["illegal"], r["cost"], r["audit"]) == (19_999, 19_999, 4 * 19_999 + 3, "K" + "D" * 19_999 + "I")
