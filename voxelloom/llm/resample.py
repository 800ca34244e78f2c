"""Importance resampling towards a target distribution of hashed word n-grams.

Features are runs of one to three words; a feature's bucket is the CRC of its bytes modulo the buckets.  The distinct
features of a window of words are laid out as one matrix of bytes for each length, all CRCs of a matrix advance
column by column, and the buckets are scattered back to the occurrences.

1. documents go once through this into bundles: per document its buckets with their counts, packed;
2. bucket counts are summed per task, then over tasks: as many numbers as there are buckets, at any input size;
3. weights are sums of the buckets' gains; noise from a hash of the id makes the highest scores a sample
   without replacement, ranked by ranges.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxelloom.llm.common import Work, small
from voxelloom.llm.lm import pack, unpack
from voxelloom.spark import ranked

BUCKETS, ORDER = 10_000, 3
MIN_WORDS, PERCENT = 20, 5
WINDOW, BUNDLE_WORDS, SEGMENT = 100_000, 400_000, 1 << 20
#: Features of so many bytes and more are few: their CRC comes from the library, with the same value.
LONG = 1 << 10
#: 0-9, a-z and all bytes from 0x80 on make words, A-Z are lower-cased, the rest parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = crc_table()


def crc_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes, all rows at once, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, dtype=np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return ~crc


def feature_crcs(pool: np.ndarray, start: np.ndarray, size: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """CRC-32 of features, rows of word numbers in *grams*, joined by one blank; words lie in *pool*."""
    n, order = grams.shape
    length = size[grams].sum(axis=1) + order - 1
    by = np.argsort(length, kind="stable")
    out = np.empty(n, dtype=np.uint32)
    # a blank stands at the end of the pool; a feature is word, blank, word, ...
    at = np.full((n, 2 * order - 1), len(pool) - 1, dtype=np.int64)
    took = np.ones((n, 2 * order - 1), dtype=np.int64)
    at[:, ::2], took[:, ::2] = start[grams[by]], size[grams[by]]
    cuts = np.flatnonzero(np.diff(length[by], prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), n]):
        long = int(length[by[lo]])
        step = hi - lo if long < LONG else 1
        for a in range(lo, hi, step):
            piece, run = at[a:a + step].reshape(-1), took[a:a + step].reshape(-1)
            flat = pool[np.repeat(piece - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))]
            out[by[a:a + step]] = crc_rows(flat.reshape(step, long)) if long < LONG else zlib.crc32(flat.tobytes())
    return out


class Counted:
    """Feature counts of some documents: word numbers by document, then buckets by document."""

    def __init__(self, buckets: int = BUCKETS, order: int = ORDER):
        self.buckets, self.order = buckets, order
        self.known: dict[bytes, int] = {}
        self.ids, self.n_words, self.parts = [], [], []
        self.held = 0

    def add(self, doc_id, text: bytes) -> None:
        folded, at, n = text.translate(_FOLD), 0, 0
        while at < len(folded):                                   # a long text is split in segments
            end = folded.find(b" ", at + SEGMENT)
            end = len(folded) if end < 0 else end
            part = np.array([self.known.setdefault(w, len(self.known)) for w in folded[at:end].split()], dtype=np.int64)
            self.parts.append((len(self.ids), part))
            n, at = n + len(part), end
        self.ids.append(doc_id)
        self.n_words.append(n)
        self.held += n

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """``document * buckets + bucket`` in order, and how many features of the document fall there."""
        none = np.zeros(0, dtype=np.int64)
        words = np.concatenate([none, *(w for _, w in self.parts)])
        doc = np.repeat(np.array([d for d, _ in self.parts], dtype=np.int64), [len(w) for _, w in self.parts])
        known = list(self.known)
        size = np.array([len(w) for w in known], dtype=np.int64)
        pool, start = np.frombuffer(b"".join(known) + b" ", dtype=np.uint8), np.cumsum(size) - size
        found = [self._window(words[p:p + WINDOW + self.order - 1], doc[p:p + WINDOW + self.order - 1],
                              min(WINDOW, len(words) - p), pool, start, size) for p in range(0, len(words), WINDOW)]
        key, place = np.unique(np.concatenate([none, *(k for k, _ in found)]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([none, *(c for _, c in found)]), minlength=len(key))
        return key, count.astype(np.int64)

    def _window(self, words, doc, starts, pool, start, size) -> tuple[np.ndarray, np.ndarray]:
        """The features that begin at the first *starts* words of a window; they end inside it."""
        keys, at, place = [], np.arange(starts), words[:starts]
        for n in range(1, self.order + 1):
            last = at + n - 1
            fits = last < len(words)
            fits[fits] = doc[at[fits]] == doc[last[fits]]
            at, place = at[fits], place[fits]
            code = place * len(size) + words[at + n - 1] if n > 1 else place       # runs of n - 1 words are numbered densely
            _, first, place = np.unique(code, return_index=True, return_inverse=True)
            grams = words[at[first][:, None] + np.arange(n)]
            bucket = feature_crcs(pool, start, size, grams) % np.uint32(self.buckets)
            keys.append(doc[at] * self.buckets + bucket.astype(np.int64)[place])
        return np.unique(np.concatenate(keys), return_counts=True)


_BUNDLE = "packed binary"


def bundles(docs: DataFrame, buckets: int = BUCKETS, order: int = ORDER, size: int = BUNDLE_WORDS) -> DataFrame:
    """``packed``: ids, word and feature counts of some documents, then their bucket keys as differences and their counts."""
    def flush(c: Counted) -> pa.RecordBatch:
        key, count = c.keys()
        n_features = np.bincount(key // buckets, weights=count, minlength=len(c.ids)).astype(np.int64)
        raw = pack(np.array(c.ids, dtype=np.int64), np.array(c.n_words, dtype=np.int64), n_features,
                   small(np.diff(key, prepend=0)), small(count))
        return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["packed"])

    def run(batches):
        c = Counted(buckets, order)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                c.add(doc_id, text or b"")
                if c.held >= size or len(c.ids) >= 1 << 16:
                    yield flush(c)
                    c = Counted(buckets, order)
        if c.ids:
            yield flush(c)

    return docs.select("doc_id", "text").mapInArrow(run, _BUNDLE)


def bucket_counts(parts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all documents by bucket: each task sends one number a bucket, the driver gets as many."""
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                _, _, _, step, count = unpack(raw)
                total += np.bincount(np.cumsum(step, dtype=np.int64) % buckets, weights=count, minlength=buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(p / q))`` by bucket of the add-one shares of target and corpus."""
    t, s, n = int(target.sum()), int(corpus.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((a + 1) * (s + n) / ((b + 1) * (t + n))))
                     for a, b in zip(target.tolist(), corpus.tolist())], dtype=np.int64)


def noise(doc_id: Column, seed: int = 42) -> Column:
    """``floor(-1000 ln(-ln u))`` with u in (0, 1) from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
             order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Weights of all documents and the drawn ones: ``doc_id, n_words, n_features, weight, score, rank``.

    *target* is a table of texts that the sample should resemble.  Of the documents with *min_words* words, *percent* in a
    hundred (rounded down) with the highest scores are drawn; ``rank`` counts them from 1 and is null for the others.
    Ties go to the smaller id.

    A null or empty text has no features, weight 0 and a score of noise alone.  Rows without id are left out and
    count nowhere; of repeated rows each is a document; texts of any length are split in segments; an empty table gives an
    empty result, an empty target a flat one; other columns are not read.
    """
    work = Work(docs.sparkSession, "resample")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = work.put(bundles(rows.where("doc_id IS NOT NULL"), buckets, order), "bundles")
    wanted = bundles(target.select(F.lit(0).cast("bigint").alias("doc_id"), F.col(target_text).cast("string").alias("text")), buckets, order)
    gain = gains(bucket_counts(wanted, buckets), bucket_counts(parts, buckets))

    def weigh(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids, n_words, n_features, step, count = unpack(raw)
                key = np.cumsum(step, dtype=np.int64)
                total = np.concatenate([[0], np.cumsum(gain[key % buckets] * count.astype(np.int64))])
                at = np.searchsorted(key // buckets, np.arange(len(ids) + 1))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (ids, n_words, n_features, total[at[1:]] - total[at[:-1]]))],
                                                 ["doc_id", "n_words", "n_features", "weight"])

    weighed = parts.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = work.put(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scores")
    long = F.col("n_words") >= min_words
    n = scored.where(long).count() * percent // 100
    # the rest keeps a place of its own, so one pass over the ranges serves all
    order_by = [F.when(long, 0).otherwise(1), F.col("score").desc(), "doc_id", "n_features", "n_words"]
    place = ranked(scored, [], order_by, "place")
    return place.select("doc_id", "n_words", "n_features", "weight", "score",
                        F.when(F.col("place") <= n, F.col("place").cast("bigint")).alias("rank"))
