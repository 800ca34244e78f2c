"""SimHash near copies by pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of four segments of 16.  Two fingerprints with at
most three differing bits have a start segment from which every chain of 1, 2, 3 and 4
segments stays within its share of the budget: 0, 1, 2 and 3 differences.  The first two
conditions become hash keys (the start segment equal, and one half of the next one, which
has at most one difference); the longer chains and the full distance are conditions of
the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxelloom.llm.common import Work, components, words

BITS = 3
SHINGLE = 3
SEED = 42
_BLOCK = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all word shingles, repeats included; 0 without words."""
    found = words(raw)
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) < shingle:
        spans = [(0, len(line))]
    else:
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ends = np.cumsum(size + 1) - 1
        spans = list(zip((ends - size)[:len(found) - shingle + 1].tolist(), ends[shingle - 1:].tolist()))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), _BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in spans[at:at + _BLOCK]], dtype=np.uint64)
        bits = np.unpackbits(h.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``; a null text counts as empty, rows without id are left out."""
    def run(batches):
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(x or b"") for x in raw], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id bigint, fp bigint")


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def _keys(fp):
    """Eight keys: start segment, which half of the next one, and the bits of both."""
    out = []
    for i in range(4):
        for half in (0, 1):
            part = F.shiftrightunsigned(_segment(fp, i + 1), 8 * half).bitwiseAND(F.lit(0xFF).cast("bigint"))
            out.append(F.shiftleft(F.lit(i * 2 + half).cast("bigint"), 24)
                       .bitwiseOR(F.shiftleft(_segment(fp, i), 8)).bitwiseOR(part))
    return F.array(*out)


def _linked(a, b, key, bits: int = BITS):
    """The chain from the key's start segment within 1 and 2, then the whole distance."""
    x = a.bitwiseXOR(b)
    start = F.shiftright(key, 25)
    chain = F.lit(False)
    for i in range(4):
        two = F.bit_count(_segment(x, i)) + F.bit_count(_segment(x, i + 1))
        three = two + F.bit_count(_segment(x, i + 2))
        chain = chain | ((start == i) & (two <= bits * 2 // 4) & (three <= bits * 3 // 4))
    return chain & (F.bit_count(x) <= bits)


def link(fps: DataFrame, work: Work) -> DataFrame:
    """``(fp, root)`` for the distinct fingerprints that are linked to another one.

    A dense group is not spelled out into pairs.  First every fingerprint meets the smallest one
    of each of its keys, which joins a dense group along a few stars; then only fingerprints that
    share a key but not yet a component are compared, and all of these are.
    """
    keyed = fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    pivot = keyed.groupBy("key").agg(F.min("fp").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    first = (keyed.join(pivot.select("key", "pivot"), "key")
             .where((F.col("fp") != F.col("pivot")) & _linked(F.col("fp"), F.col("pivot"), F.col("key")))
             .select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct())
    star = work.put(components(first, work, "star"), "stars")
    labelled = fps.join(star, fps.fp == star.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("label"))
    rows = labelled.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp", "label")
    mixed = (rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .where("lo <> hi").select("key"))
    rows = work.put(rows.join(mixed, "key"), "mixed")
    a, b = rows.alias("a"), rows.alias("b")
    more = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label"))
                  & _linked(F.col("a.fp"), F.col("b.fp"), F.col("a.key"))).select(
        F.col("a.label").alias("a"), F.col("b.label").alias("b")).distinct()
    joined = work.put(components(more, work, "join"), "joined").withColumnsRenamed({"node": "label", "root": "top"})
    ends = star.select("node", F.col("root").alias("label")).unionByName(
        joined.select(F.col("label").alias("node"), "label")).distinct()
    return (ends.join(joined, "label", "left").groupBy(F.col("node").alias("fp"))
            .agg(F.min(F.coalesce("top", "label")).alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row that has an id.

    Fingerprints with three or fewer differing bits are linked; component_id is the smallest
    doc_id reachable over links, the row itself included.  Equal texts have equal
    fingerprints.  Null and empty texts have fingerprint 0 and link like any other; repeated
    rows stay repeated; an empty table gives an empty result; other columns are not read.
    """
    work = Work(docs.sparkSession, "simhash")
    printed = work.put(fingerprints(docs, id_col, text_col), "prints")
    fps = work.put(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    linked = link(fps.select("fp"), work)
    tops = fps.join(linked, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = tops.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = tops.join(least, "root").select("fp", "component_id")
    return printed.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
