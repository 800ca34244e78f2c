"""Near copies by the Jaccard similarity of word shingles.

Texts become sets of shingle hashes.  Each set has bands of min-hashes; sets that share a band are
candidates, and every candidate is judged on the whole sets.  Two sets of similarity s share one of
20 bands of 4 with 1 - (1 - s^4)^20: 0.99997 at 0.8 and more above, which is the only loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxelloom.llm.common import BITMAP_BITS, Work, bitmap, components, unpacked, words
from voxelloom.llm.decontam import hashes

SHINGLE = 5
#: Similarity from which two texts are near copies, as a fraction.
NUM, DEN = 4, 5
BANDS, ROWS = 20, 4
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes, known: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the word shingles; a shorter text is one shingle, none is without words."""
    found = words(raw)
    if not found:
        return np.zeros(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.unique(hashes(np.array([known[w] for w in found], dtype=np.uint64), min(size, len(found))))


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes of a set."""
    low = np.array([(h * a + b).min() for a, b in _FACTORS], dtype=np.uint64).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(low[i].tobytes(), i) for i in range(BANDS)], dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, same, n, bands)`` of every ``(doc_id, text)`` with words; equal sets have equal ``same``."""
    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                h = shingles(raw or b"", known)
                if len(h):
                    rows.append((doc, xxhash.xxh3_128_digest(h.tobytes()), len(h), bands(h)))
            if rows:
                ids, same, n, keys = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(same, pa.binary()), pa.array(n, pa.int32()),
                                                  pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "n", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, same binary, n int, bands array<bigint>")


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose whole sets are similar; only texts of candidates are shuffled."""
    ends = pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d")))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ends, "d"))

    def pick(batches):
        there, known = unpacked(bits.value), {}
        for batch in batches:
            ids, sets = [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if there[doc % BITMAP_BITS]:
                    ids.append(doc)
                    sets.append(shingles(raw or b"", known).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["d", "h"])

    def same(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * DEN >= (len(x) + len(y) - both) * NUM)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    texts = docs.mapInArrow(pick, "d bigint, h array<bigint>")
    left, right = (texts.select(F.col("d").alias(c), F.col("h").alias(f"h{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(same, "a bigint, b bigint").distinct()


def linked(docs: DataFrame, work: Work) -> DataFrame:
    """Links ``(a, b)`` of ids whose components are the groups of near copies of ``(doc_id, text)``, ids not null.

    As with fingerprints, a dense group is not spelled out into pairs: sets first meet the earliest set of
    each of their bands, then only those that share a band but not yet a component are compared.
    A doc_id stands for one text.
    """
    seen = work.put(sketches(docs), "sketches")
    sets = work.put(seen.groupBy("same").agg(F.min(F.struct("doc_id", "n", "bands")).alias("f")).select("same", "f.*"), "sets")
    equal = seen.join(sets.select("same", F.col("doc_id").alias("b")), "same").select(F.col("doc_id").alias("a"), "b").where("a <> b")
    keyed = sets.select("doc_id", "n", F.explode("bands").alias("band"))
    pivot = keyed.groupBy("band").agg(F.min(F.struct("doc_id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
    fits = lambda n, m: (F.col(n) * DEN >= F.col(m) * NUM) & (F.col(m) * DEN >= F.col(n) * NUM)
    first = (keyed.join(pivot, "band").where((F.col("doc_id") != F.col("p.doc_id")) & fits("n", "p.n"))
             .select(F.col("doc_id").alias("a"), F.col("p.doc_id").alias("b")).distinct())
    close = work.put(_verify(work.put(first, "pairs1"), docs), "close1")
    star = work.put(components(close, work, "near"), "stars")
    rows = (sets.join(star, sets.doc_id == star.node, "left")
            .select("doc_id", "n", F.explode("bands").alias("band"), F.coalesce("root", "doc_id").alias("label")))
    mixed = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    rows = work.put(rows.join(mixed, "band"), "mixed")
    a, b = rows.alias("a"), rows.alias("b")
    more = (a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.label") < F.col("b.label")) & fits("a.n", "b.n"))
            .select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct())
    # pairs that a pivot settled already have one label, those it refused are refused again
    more = more.join(work.spark.read.parquet(f"{work.root}/pairs1").select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    apart = work.put(_verify(work.put(more, "pairs2"), docs), "close2")
    return equal.unionByName(close).unionByName(apart)
