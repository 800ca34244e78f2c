"""Resampling, alignment and packing against plain Python over whole texts."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from text_tables import documents  # noqa: F401
from voxelloom.llm import align, packing, resample, tokens
from voxelloom.llm.queries import QUERIES

BPE, PIECES = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("piece_bpe_32k.model")
PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", " ", "\x1c", "'s", "1", "42", "!", "中", "𐍈", "▁", "<s>", "<|endoftext|>", "\r\n",
         "\x00", " ", "ﬁ", "...", "   ", "word", "the", "<0x41>"]
mixed = st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=12).map("".join)


# pieces of texts

@settings(max_examples=150, deadline=None)
@given(st.lists(mixed, min_size=1, max_size=5))
def test_pieces_encode_like_whole_texts(texts):
    side = tokens.byte_level(BPE, False)
    numbers, ends, names = tokens.split(pa.array(texts), False)
    ids = side.ids(names)
    for t, part in zip(texts, np.split(numbers, ends[:-1])):
        assert [int(x) for k in part for x in ids[k]] == side.model.encode(t, add_special_tokens=False).ids
    numbers, ends, names = tokens.split(pa.array(texts), True)
    for side, whole in ((tokens.byte_level(BPE, True), lambda t: tokens.byte_level(BPE, True).model.encode(" " + t, add_special_tokens=False).ids),
                        (tokens.pieces(PIECES), tokens.pieces(PIECES).model.encode)):
        ids, end, count, ok = tokens.encode_each(names, side.spans, side)
        start = np.cumsum(count) - count
        for k in range(len(names)):
            own = slice(start[k], start[k] + count[k])
            assert (np.cumsum(side.size[ids[own]]) == end[own]).all()
        for t, part in zip(texts, np.split(numbers, ends[:-1])):
            want = whole(t)
            same = b"".join(side.bytes[n] for n in want) == (" " + t).encode()
            if t:
                assert bool(ok[part].all()) == same
                assert not same or ids[tokens.spread(part, start, count)].tolist() == want


def test_byte_ends_refine_shared_characters():
    got = tokens.byte_ends(np.array([0, 1, 1, 4, 4, 4, 4]), np.array([1, 4, 4, 4, 4, 4, 8]), np.array([1, 2, 1, 1, 1, 1, 1]))
    assert got.tolist() == [1, 3, 4, 5, 6, 7, 8]
    assert len(tokens.byte_ends(*(np.zeros(0, dtype=np.int64),) * 3)) == 0


# alignment

def aligned(rows):
    """Every document by walking over the bytes of both token lists."""
    side_a, side_b = tokens.byte_level(BPE, True), tokens.pieces(PIECES)
    docs, holders = [], Counter()
    for i, t in rows:
        t = t or ""
        a, b = side_a.model.encode(" " + t, add_special_tokens=False).ids, side_b.model.encode(t)
        raw = (" " + t).encode()
        if not t or any(b"".join(s.bytes[n] for n in x) != raw for s, x in ((side_a, a), (side_b, b))):
            a, b = [], []
        at_a = [n for n, x in enumerate(a) for _ in side_a.bytes[x]]
        at_b = [n for n, x in enumerate(b) for _ in side_b.bytes[x]]
        links = [(a[p], b[q]) for p, q in sorted(set(zip(at_a, at_b)))]
        groups, ga, gb = [], [], []
        for k in range(len(at_a)):
            if k + 1 == len(at_a) or at_a[k + 1] != at_a[k]:
                ga.append(str(a[at_a[k]]))
            if k + 1 == len(at_b) or at_b[k + 1] != at_b[k]:
                gb.append(str(b[at_b[k]]))
            if k + 1 == len(at_a) or (at_a[k + 1] != at_a[k] and at_b[k + 1] != at_b[k]):
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        docs.append((i, len(a), len(b), groups, links))
        holders.update(set(links))
    top = {}
    for (a, _), n in holders.items():
        top[a] = max(top.get(a, 0), n)
    return sorted((i, na, nb, len(g), len(links), sum(holders[x] == top[x[0]] for x in links), sum(holders[x] for x in links), ";".join(g))
                  for i, na, nb, g, links in docs)


def test_alignment_matches_brute_force(spark, documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["naïve", "word", "über", "中文字", "𐍈𐍈", "x", "don't", "1234", "a\nb", "été!"]) for _ in range(rng.randint(1, 30))))
            for i in range(40)]
    rows += [(50 + i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "▁ never given back"), (3, rows[3][1]), (3, "other"), (503, "long été 中 " * 8000), (504, " ")]
    frame = documents(rows + [(None, "no id")]).repartition(3)
    frame = frame.withColumns({c: F.lit("x") for c in ("bundle", "pair", "packed")})
    want = aligned(rows)
    for size in (align.BUNDLE_BYTES, 100):                # one bundle a task, then many
        got = align.align(frame, BPE, PIECES, bundle_bytes=size)
        assert sorted(map(tuple, got.collect())) == want
    assert any(w[1] == 0 for w in want) and any(w[5] < w[4] for w in want)
    assert align.align(frame.limit(0), BPE, PIECES).count() == 0


def test_alignment_query_digests(spark, documents, tmp_path):
    rows = [(1, "two words"), (2, None), (3, "two wörds")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op12_align"](spark, str(tmp_path)).collect()}
    for w in aligned(rows):
        assert tuple(got[w[0]])[1:7] == w[1:7]
        assert got[w[0]]["groups_sha256"] == (hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "")


# packing

def packed_texts(rows):
    model = tokens.byte_level(BPE, False).model
    return [(i, model.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]


def test_packing_keeps_every_id_once(spark, documents, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "béta", "中", "gamma", "x  y", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 50, 700])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "very long " * 6000), (5, rows[5][1]), (5, "another text")]
    frame = documents(rows).withColumns({c: F.lit("x") for c in ("row", "begin", "key", "n", "ids", "_p")}).repartition(3)
    got = packing.pack_documents(frame, BPE).collect()
    want = Counter((i, tuple(ids)) for i, ids in packed_texts(rows))
    # pieces of equal ids are told apart by where they stand: a document is contiguous along the sequences
    flat = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at, docs = 0, []
    for r in flat:
        assert r["sequence_id"] * 1024 + r["offset"] == at and 0 < r["length"] <= 1024 - r["offset"]
        at += r["length"]
        ids = struct.unpack(f"<{r['length']}I", r["ids"])
        if r["start"] == 0:
            docs.append((r["doc_id"], []))
        assert docs[-1][0] == r["doc_id"] and len(docs[-1][1]) == r["start"]
        docs[-1][1].extend(ids)
        assert r["doc_tokens"] >= r["start"] + r["length"]
    assert Counter((i, tuple(x)) for i, x in docs) == want
    assert at == sum(len(x) for _, x in packed_texts(rows))
    whole = {r["sequence_id"]: r for r in packing.sequences(packing.pack_documents(frame, BPE)).collect()}
    assert [whole[k]["n"] for k in sorted(whole)][:-1] == [1024] * (len(whole) - 1)
    assert b"".join(bytes(whole[k]["ids"]) for k in sorted(whole)) == b"".join(bytes(r["ids"]) for r in flat)
    assert packing.pack_documents(frame.limit(0), BPE).count() == 0
    documents(rows + [(None, "no id")]).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_pack"](spark, str(tmp_path)).collect()
    ids = {i: x for i, x in packed_texts(rows) if i != 5}
    for r in out:
        if r["doc_id"] in ids:
            part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert sum(r["length"] for r in out if r["doc_id"] is None) == 3


def test_hilbert_key_walks_by_single_steps():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = packing.hilbert_key(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_puts_like_documents_together(spark, documents):
    rng = random.Random(6)
    topics = [[f"{c}{c}{n}" for n in range(30)] for c in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(120))) for i in range(320)]
    got = packing.pack_documents(documents(rows).repartition(4), BPE).where("start = 0").orderBy("sequence_id", "offset").collect()
    order = [r["doc_id"] % 8 for r in got]
    assert sum(a == b for a, b in zip(order, order[1:])) > 0.8 * len(order)       # one in eight at random


# resampling

def drawn(rows, target):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(r.encode()) % 10000 for r in runs]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    best = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0]))
    rank = {x[0]: k + 1 for k, x in enumerate(best[:5 * len(best) // 100])}
    return sorted((*x, rank.get(x[0])) for x in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_resampling_matches_brute_force(spark, documents, seed, monkeypatch):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "Été", "中文", "x1", "don't", "A-B", "co_op", "long" * 300, "é e", "ÄÖ"]
    rows = [(i, " ".join(rng.choice(vocab) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "!!! --"), (903, "one"), (904, "repeat Me " * 30_000)]
    target = ["Alpha beta x1 beta", None, "", "中文 Été a b"]
    frame = documents([*rows, (None, "no id counts nowhere")]).withColumns({c: F.lit("x") for c in ("packed", "bucket", "place", "_p")}).repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    want = drawn(rows, target)
    for segment, size in ((resample.SEGMENT, resample.BUNDLE_WORDS), (50, 40)):
        monkeypatch.setattr(resample, "SEGMENT", segment)
        monkeypatch.setattr(resample.bundles, "__defaults__", (resample.BUCKETS, resample.ORDER, size))
        got = resample.resample(frame, wanted).collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == want
    assert sum(w[5] is not None for w in want) > 2
    assert resample.resample(frame.limit(0), wanted).count() == 0
    flat = resample.resample(frame, wanted.limit(0)).collect()
    assert sorted(r["rank"] for r in flat if r["rank"]) == list(range(1, 1 + sum(w[5] is not None for w in want)))


def test_resampling_repeated_rows(spark, documents):
    rows = [(i % 30, "w " * 25) for i in range(60)]
    got = resample.resample(documents(rows), documents(rows[:1])).collect()
    ranks = sorted((r["rank"], r["doc_id"]) for r in got if r["rank"])
    assert len(got) == 60 and [k for k, _ in ranks] == [1, 2, 3] and ranks[0][1] == ranks[1][1]


def test_crc_matrices():
    rng = np.random.default_rng(1)
    for n, size in ((1, 0), (5, 1), (40, 17)):
        m = rng.integers(0, 256, (n, size), dtype=np.uint8)
        assert resample.crc_rows(m).tolist() == [zlib.crc32(r.tobytes()) for r in m]
    words = [b"a", b"", b"xyz", b"q" * 2000]
    pool, size = np.frombuffer(b"".join(words) + b" ", dtype=np.uint8), np.array([len(w) for w in words])
    grams = rng.integers(0, 4, (50, 3))
    assert resample.feature_crcs(pool, np.cumsum(size) - size, size, grams).tolist() == [
        zlib.crc32(b" ".join(words[k] for k in g)) for g in grams.tolist()]
