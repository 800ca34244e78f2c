"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every word, pair of neighbours and pair with one word between is hashed into a fixed number of
coordinates; a document has the set of its coordinates.  Each coordinate has its own learning
rate, and the L1 term keeps it at exactly zero until its evidence is large, so the weights are
few and fit a broadcast whose size the number of coordinates bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxelloom.llm.common import Work

SLOTS_LOG2 = 20
#: At most so many labelled rows are learnt from, those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
SHARD_ROWS = 20_000
EPOCHS = 4
#: Chance evidence of a coordinate grows with the root of the rows, so the L1 strength does too.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.06, 0.0
FOLDS, HELD_OUT = 5, 0

_PUNCTUATION = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_CACHE_WORDS = 500_000


class Hasher:
    """Words to 64-bit hashes, remembered up to a fixed number of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = text.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        known, out = self.known, []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def coordinates(h: np.ndarray, bits: int = SLOTS_LOG2) -> np.ndarray:
    """Slots of words, neighbours and pairs with one word between, repeats included."""
    parts = [h * _MIX[0], h[:-1] * _MIX[1] + h[1:] * _MIX[2], h[:-2] * _MIX[2] + h[2:] * _MIX[3]]
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.uint32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, bits: int = SLOTS_LOG2):
    """Weights and bias after *epochs* passes in the given order."""
    size = 1 << bits
    l1 = max(1.0, L1 * math.sqrt(len(rows)))
    z, n = np.zeros(size), np.zeros(size)
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    bias, bias_n = math.log(share / (1 - share)), 0.0

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w = weights(at)
            s = bias + w.sum()
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, s))))
            g = p - y
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA * w
            n[at] = nn + g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + math.sqrt(bias_n))
    there = np.flatnonzero(np.abs(z) > l1)
    return there, weights(there), bias


def train(labelled: DataFrame, work: Work, shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, float] | None:
    """Weights learnt from ``(doc_id, text, label)``, or None without rows.

    Rows are dealt by hash into shards of about *shard_rows*; each shard runs FTRL in the order of
    a hash, and the shards' weights are averaged by coordinate.  No row is left out, and a
    shard never grows with the input.
    """
    def features(batches):
        hasher = Hasher()
        for batch in batches:
            packed = [np.unique(coordinates(hasher(x or ""))).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())],
                                             ["doc_id", "label", "slots"])

    rows = work.put(labelled.select("doc_id", "text", "label").mapInArrow(
        features, "doc_id bigint, label int, slots binary"), "features")
    count = rows.count()
    if not count:
        return None
    shards = -(-count // shard_rows)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc_id", "label"], kind="stable")
        at, w, bias = ftrl([np.frombuffer(x, dtype=np.uint32) for x in pdf["slots"]], pdf["label"].to_numpy())
        return pd.DataFrame({"slot": np.append(at, -1).astype(np.int64), "w": np.append(w, bias)})

    dealt = rows.withColumns({"turn": F.xxhash64("doc_id", F.lit(1)),
                              "shard": F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(shards))})
    learnt = dealt.groupBy("shard").applyInPandas(fit, "slot bigint, w double")
    mean = learnt.groupBy("slot").agg((F.sum("w") / shards).alias("w")).collect()  # at most 2^SLOTS_LOG2 + 1 rows
    out = np.zeros(1 << SLOTS_LOG2, dtype=np.float32)
    bias = 0.0
    for slot, w in mean:
        if slot < 0:
            bias = w
        else:
            out[slot] = w
    work.drop("features")
    return out, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """``(doc_id, score)`` of ``(doc_id, text)``; without a model every score is 0."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher = Hasher()
        weights, bias = shared.value
        used = weights != 0
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                at = coordinates(hasher(text or ""))
                s = bias + float(weights[np.unique(at[used[at]])].sum(dtype=np.float64))
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, s)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per document with an id.

    Learns only from labelled documents whose crc32 of the id is not 0 modulo 5, at most
    *sample_rows* of them; every document is scored, over its whole text.  A null text counts as
    empty and gets the score of no evidence; null labels are not used; of several labels of a
    document the largest counts; repeated rows stay repeated; other columns are not read.
    """
    work = Work(docs.sparkSession, "toxicity")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL")
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    marks = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
             .where(fold != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # never more than sample_rows rows of two numbers, so the texts need no shuffle
    model = train(rows.join(F.broadcast(marks), "doc_id"), work)
    return score(rows, model).select("doc_id", (fold == HELD_OUT).alias("held_out"), "score",
                                     F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
