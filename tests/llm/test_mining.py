"""Hard negatives, repeated passages and token alignment against brute force, with the edge cases of each."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import alignment, decontaminate, hardneg, sharding, substrings
from tidelog.llm.common import Words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OTHER = "string, begin int, words long, `rows` int, v string, part int, `key` string"
EXTRA = ("x", 1, 2, 3, "y", 4, "z")


# Hard negatives


def mined(rows, every, positives=5, negatives=5, low=80):
    kept = []
    for i, label, v in dict.fromkeys((i, label, None if v is None else tuple(v)) for i, label, v in rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 1 << 60:
            kept.append((i, label, q))
    out = []
    anchors = {}
    for i, label, q in kept:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, q)), (label, q))
    for i, (label, q) in anchors.items():
        scores = [(-sum(x * y for x, y in zip(q, w)), j, other == label) for j, other, w in kept if j != i]
        for s, j, _ in sorted(x for x in scores if x[2])[:positives]:
            hard = sorted(x for x in scores if not x[2] and low * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(i, j, k, n[1], -s, -n[0]) for k, n in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    r = np.random.default_rng(5)
    scale = np.exp(r.normal(0, 1.2, 900))
    base = r.normal(0, 1, (12, 8))
    rows = [(k, int(r.integers(0, 4)), [float(np.float32(x)) for x in (base[r.integers(0, 12)] + r.normal(0, 0.5, 8)) * scale[k]]) for k in range(900)]
    rows += [(1000, 1, None), (1001, None, [1.0] * 8), (None, 1, [1.0] * 8), (1002, 1, [1.0, None, 2.0]), (1003, 2, [float("nan")] * 8), (1010, 2, [float("inf")] * 8), (1020, 1, []), (1021, 2, [0.0] * 8), (1030, 3, [1e30] * 8), (1040, 1, [1e5] * 8), (1041, 1, [2e5] * 3), (1042, 2, [1.5e5] * 8)]
    rows += [rows[10], rows[20], rows[21], (20, 3, [0.5] * 8), (21, 1, [0.25] * 8)]
    df = spark.createDataFrame([(*x, *EXTRA) for x in rows], f"vec_id long, label int, embedding array<float>, id {OTHER}")
    want = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    monkeypatch.setattr(hardneg, "ROWS", 64)
    monkeypatch.setattr(hardneg, "ANCHORS", 16)
    got = hardneg.mine(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(want, 10)
    assert hardneg.mine(df.filter("vec_id < 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_ranges_of_coordinates_lose_no_row():
    r = np.random.default_rng(2)
    vectors = np.floor(256 * np.concatenate([r.normal(0, 1, (300, 6)), np.eye(6), -np.eye(6), np.zeros((1, 6))])).astype(np.int64)
    block, left = hardneg.Block(vectors), []
    for anchor in vectors[::7]:
        scores = vectors @ anchor
        for least in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]).astype(int).tolist():
            rows = block.candidates(anchor, least)
            assert rows is None or set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
            left.append(1.0 if rows is None else len(rows) / len(vectors))
    assert min(left) < 0.05  # the ranges do leave rows out
    assert block.candidates(vectors[0], 1 << 40).size == 0


# Repeated passages


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed(rows, n):
    """Spans and kept words of each row, in the order of ids; equal rows are one."""
    seen, out = set(), {}
    for i, text in rows:
        w = words_of(text)
        gone = set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in seen:
                gone.update(range(k, k + n))
            seen.add(tuple(w[k : k + n]))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out[i] = (len(w), len(gone), [tuple(x) for x in spans], " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def passages():
    r = random.Random(4)
    said = lambda n, of=400: [f"w{r.randrange(of)}" for _ in range(n)]
    shared, short, line = said(60), said(19), said(9)
    rows = []
    for k in range(120):
        w = said(r.randrange(5, 80))
        if k % 3 == 0:
            w[3:3] = shared[r.randrange(0, 20) : r.randrange(41, 60)]
        if k % 4 == 0:
            w += short
        if k % 2 == 0:
            w[1:1] = line
        rows.append((k, " ".join(w)))
    rows += [(200, rows[7][1]), (201, rows[7][1] + "\n"), (202, "a " * 70), (203, "a b " * 40), (204, "A b " * 40), (205, None), (206, ""), (207, " \t\n"), (208, "one two"), (209, "é x " + "日本 " * 45), (210, "  " + "\t".join(shared) + "  "), (211, " ".join(said(30) * 3)), (212, " ".join(said(8000, 3)))]
    return rows


@pytest.mark.parametrize(("length", "hot"), [(20, 1024), (20, 2), (5, 3), (2, 1024)])
def test_repeated_passages(spark, monkeypatch, length, hot):
    rows = passages()[: 120 if length == 2 else None]
    monkeypatch.setattr(substrings, "HOT", hot)
    df = spark.createDataFrame([(*x, *EXTRA) for x in rows], f"doc_id long, text string, doc {OTHER}").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, [tuple(x) for x in r.spans], r.kept) for r in substrings.remove_repeats(df, length).collect()}
    assert got == removed(rows, length)


def test_repeated_passages_of_odd_rows(spark):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(5, text), (5, text), (3, text + " end"), (None, text), (None, None), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df).collect()), key=str)
    assert got == sorted([(False, 3, 31, 0, text + " end"), (False, 4, 1, 0, "short"), (False, 5, 30, 30, ""), (False, 5, 30, 30, ""), (True, 0, 30, 30, ""), (True, 0, 0, 0, "")], key=str)
    assert substrings.remove_repeats(df.filter("doc_id = -1")).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(df, 1)


def test_matching_statistics():
    r = random.Random(1)
    automaton, past = substrings.Automaton(), []
    for _ in range(60):
        x = [r.randrange(3) for _ in range(r.randrange(1, 25))]
        got = automaton.add(x)
        for end in range(1, len(x) + 1):
            before = [*past, x[: end - 1]]
            said = lambda m, end=end, x=x, before=before: any(tuple(x[end - m : end]) == tuple(y[k : k + m]) for y in before for k in range(len(y) - m + 1))
            assert got[end - 1] == max((m for m in range(end + 1) if m == 0 or said(m)), default=0)
        past.append(x)


# Token alignment


def aligned(texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    symbols = alignment._byte_symbols()
    rows, total = [], {}
    for text in texts:
        links, groups = [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb = [bytes(symbols[ch] for ch in a.id_to_token(i)) for i in x]
            yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xb) == b"".join(yb) == (" " + text).encode():
                ends = [list(itertools.accumulate(map(len, z))) for z in (xb, yb)]
                for i, p in enumerate(x):
                    for j, q in enumerate(y):
                        if max(ends[0][i] - len(xb[i]), ends[1][j] - len(yb[j])) < min(ends[0][i], ends[1][j]):
                            links.append((p, q))
                cuts = [0, *sorted(set(ends[0]) & set(ends[1]))]
                for low, high in itertools.pairwise(cuts):
                    part = [",".join(str(i) for i, e in zip(z, w) if low < e <= high) for z, w in ((x, ends[0]), (y, ends[1]))]
                    groups.append("|".join(part))
                rows.append((len(x), len(y), links, ";".join(groups)))
        if not groups:
            rows.append((0, 0, [], ""))
        for p in links:
            total[p] = total.get(p, 0) + 1
    best = {}
    for (_, q), n in total.items():
        best[q] = max(best.get(q, 0), n)
    return [(n, m, g.count(";") + 1 if g else 0, len(x), sum(total[p] == best[p[1]] for p in x), sum(total[p] for p in x), g) for n, m, x, g in rows]


TEXTS = [
    "the cat sat on the mat", "The  cat\tsat\n\non the   mat  ", " lead", "trail ", "a", " ", "   ", "\n", "\n  x", "x \n y", "é é 日本語テキスト naïve", "<s></s><unk><|endoftext|> <0x41>", "a▁b c", "▁", "12345 67,890.12 don't we'll", "http://a.b/c?d=e&f=%20 -- !!!",
    "nul\0byte", " nbsp  x", "　wide　 y", "\x1c\x85 z   w", "👩‍👩‍👧‍👦 emoji 🏳️‍🌈", "ﬁ ligature ﬀ", "supercalifragilistic" * 8, "tab\t\tend\t", "\r\n\r\n windows \r\n", None, "", "the cat sat on the mat", "𐍈 𝔘 x̧̌", "  two  gaps  ",
]


@pytest.mark.parametrize(("slice_pairs", "shard_pairs"), [(1 << 22, 1 << 17), (40, 16)])
def test_token_alignment(spark, monkeypatch, slice_pairs, shard_pairs):
    for name, value in (("SLICE_PAIRS", slice_pairs), ("SHARD_PAIRS", shard_pairs), ("FAN", 2)):
        monkeypatch.setattr(alignment, name, value)
    df = spark.createDataFrame([(k, t, *EXTRA) for k, t in enumerate(TEXTS)], f"doc_id long, text string, pair {OTHER}").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in alignment.align(df, A, B).collect()}
    want = aligned(TEXTS)
    assert [got[k] for k in range(len(TEXTS))] == want
    assert sum(w[3] > 0 for w in want) > 20 and {w[0] for w, t in zip(want, TEXTS) if not t or "▁" in t} == {0}


def test_token_alignment_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string").unionByName(spark.sql("select 9L as doc_id, cast(x'ff20' as string) as text"))
    got = sorted((r.doc_id or 0, r.n_a, r.count_sum, r.n_best) for r in alignment.align(df, A, B).collect())
    assert got == [(0, 0, 0, 0), (0, 2, 6, 2), (1, 2, 6, 2), (1, 2, 6, 2), (9, 0, 0, 0)]
    assert alignment.align(df.filter("doc_id = -1"), A, B).count() == 0
    counts = [(int(a), int(b), int(n)) for part in alignment.pair_counts(df, A, B) for a, b, n in zip(*part)]
    assert len(counts) == 2 and {n for _, _, n in counts} == {3}


def test_minimal_perfect_hash():
    r = np.random.default_rng(3)
    pairs = np.unique(r.integers(0, 1 << 33, 20_000))
    shard = alignment._shard(pairs, 7)
    rows = []
    for k in range(7):
        sizes, bits, order = alignment.build(pairs[shard == k])
        rows.append((k, sizes, np.packbits(bits, bitorder="little").tobytes(), order.tobytes()))
    index = alignment.PairIndex(7, rows)
    assert sorted(index.find(pairs).tolist()) == list(range(len(pairs))) and (index.pairs[index.find(pairs)] == pairs).all()
    others = np.setdiff1d(r.integers(0, 1 << 33, 5000), pairs)
    assert (index.find(others) == -1).all() and 8 * index.words.nbytes < 3.5 * len(pairs)
    assert (alignment.PairIndex(1, []).find(pairs[:9]) == -1).all()
    with pytest.raises(ValueError):
        alignment.build(np.array([5, 5]))


def test_digests_of_the_queries(spark):
    from tidelog.llm import queries

    rows = queries.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    short = [k for k, t in texts.items() if t and len(t) < 300][:10]
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    for r in rows:
        if r.doc_id in short:
            want = aligned([texts[r.doc_id]])[0]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links) == want[:4] and r.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")
            assert r.n_a in (0, len(a.encode(" " + texts[r.doc_id], add_special_tokens=False).ids)) and r.n_b in (0, len(b.encode(texts[r.doc_id])))
    assert len(rows) == len(texts) and sum(r.n_links for r in rows) > 0


# Sharding of repeated rows, and of maps that aren't there yet


def test_sharding_of_repeated_rows(spark, monkeypatch, tmp_path):
    """A third of the rows are copies of one row; sizes stay near equal, slots gapless, and every row is placed."""
    monkeypatch.setattr(sharding, "RUN", 64)
    r = random.Random(8)
    rows = [(k, "x" * r.randrange(500, 1500)) for k in range(2000)] + [(7, "same " * 200)] * 1000 + [(None, None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard(df, shards=4, slots=1024, map_path=f"file://{tmp_path}/map").collect()
    want = collections.Counter((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == want
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for x in got:
        sizes[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
    assert max(sizes.values()) - min(sizes.values()) <= 2000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {x.map_version for x in got} == {1}
    again = sharding.shard(df, shards=5, slots=1024, map_path=f"file://{tmp_path}/map").collect()
    assert {x.map_version for x in again} == {2} and {x.shard for x in again} == set(range(5))
    of = {x.virtual_slot: x.shard for x in got}
    assert all(x.shard in (4, of[x.virtual_slot]) for x in again)


# Benchmark items of any length at the limit of edits


@pytest.mark.parametrize("kind", ["drop", "add"])
@pytest.mark.parametrize(("length", "trials"), [(20, 60), (80, 60), (200, 30), (800, 12), (1600, 5)])
def test_long_items_at_the_limit_of_edits(length, trials, kind):
    r = random.Random(length)
    said = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    items = [said(length) for _ in range(trials)]
    prepared = decontaminate.Items(list(range(trials)), [" ".join(x) for x in items])
    found = 0
    for k, item in enumerate(items):
        text = list(item)
        for _ in range(decontaminate.allowed(length)):
            at = r.randrange(1, len(text) - 1)
            text[at : at + (kind == "drop")] = [] if kind == "drop" else said(1)
        data = " ".join(said(50) + text + said(50)).encode()
        words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), decontaminate._WORD)
        got = prepared.matches(words)
        assert all(m[1] == k for m in got)
        found += any(m[2] <= decontaminate.allowed(length) for m in got)
    assert found >= 0.99 * trials


def test_long_items_and_brute_force():
    """The best passage of a long item is that of the plain edit distance, in texts that hold it twice."""
    r = random.Random(2)
    item = [f"w{r.randrange(60)}" for _ in range(180)]
    near = list(item)
    for at in (5, 60, 100, 170):
        near[at] = "other"
    data = " ".join([*["x"] * 40, *near, *["y"] * 400, *item[:90], "z", *item[90:], *["q"] * 9]).encode()
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), decontaminate._WORD)
    prepared = decontaminate.Items([3], [" ".join(item)])
    assert prepared.matches(words) == [(0, 0, 1, 620, 801)]
