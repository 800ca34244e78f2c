import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from text_tables import documents  # noqa: F401
from voxelloom.llm import simhash
from voxelloom.llm.common import Work, bitmap, components, unpacked


def brute(fps):
    top = {f: f for f in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint_by_definition():
    text = "The\tquick BROWN fox été jumps\x0bover the the the lazy dog"
    w = text.translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\x0b", " ").split(" ")
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"One two") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(b" \n\t") == 0
    # blocks of shingles add up
    long = " ".join(f"w{i % 977}" for i in range(70_000)).encode()
    whole = simhash.fingerprint(long)
    simhash._BLOCK, was = 1000, simhash._BLOCK
    try:
        assert simhash.fingerprint(long) == whole
    finally:
        simhash._BLOCK = was


def test_hash_is_the_one_of_the_engine(spark):
    got = spark.createDataFrame([("été one",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2 ** 64 == xxhash.xxh64_intdigest("été one", 42)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_match_brute_force(spark, seed):
    rng = random.Random(seed)
    fps = {0, 7, 2 ** 63 - 1, -1, -2 ** 63}
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - 2 ** 64 if x >= 2 ** 63 else x)
    weak = rng.sample(range(64), 10)  # a dense group that varies in few bits
    base = rng.getrandbits(63)
    for _ in range(150):
        x = base
        for b in weak:
            x ^= rng.randint(0, 1) << b
        fps.add(x - 2 ** 64 if x >= 2 ** 63 else x)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {r["fp"]: r["root"] for r in simhash.link(df, Work(spark, "t")).collect()}
    want = brute(fps)
    sets = lambda m: {frozenset(f for f in fps if m(f) == r) for r in map(m, fps)}
    assert sets(lambda f: got.get(f, f)) == sets(want.get)


def test_documents(spark, documents):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text), (3, text.replace("word100", "other")), (9, None), (8, "  "), (None, text), (1, "alone here now"),
            (5, text), (7, "x" * 200_000)]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(rows)).collect())
    ids = {d: c for d, _, c in got}
    assert len(got) == 7 and ids[8] == ids[9] == 8 and ids[1] == 1 and ids[5] == ids[3] == 3
    assert all(len(f) == 16 for _, f, _ in got) and dict((d, f) for d, f, _ in got)[9] == "0" * 16
    assert simhash.near_duplicates(documents([]).limit(0)).count() == 0


def test_components_and_bitmap(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint"), Work(spark, "c"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    values = [0, 1, 5, 32767, 32768, 32769, 65536, 2 ** 24 - 1, 2 ** 24 + 3]
    bits = bitmap(spark.createDataFrame([(v,) for v in values], "h bigint"), "h")
    assert set(np.flatnonzero(unpacked(bits))) == {v % 2 ** 24 for v in values}
