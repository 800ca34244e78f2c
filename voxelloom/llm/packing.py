"""Packing documents into sequences along a space-filling curve.

A document's tokens are hashed into slots, its vector is the share of its tokens in each slot, and a fixed matrix of
signs projects the vectors to three dimensions.  The coordinates are spread evenly by the corpus's own mean and
deviation, the Hilbert key of their cell orders the documents, and the documents are laid end to end in that
order and cut every ``length`` tokens.  Neighbours in a sequence are therefore alike, and only the very last
sequence of the corpus is short.

Only narrow rows (key, ids, token counts) are sorted by range; starts come from prefix sums over the ranges.  The
tokens meet their start by the row's number, so no group and no order ever gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxelloom.llm import tokens
from voxelloom.llm.align import slices
from voxelloom.llm.common import Work
from voxelloom.spark import running_total

LENGTH, END_ID = 1024, 0
SLOTS, DIMS, BITS = 4096, 3, 20
SLICE_BYTES = 12 << 20
#: Different pieces of text whose ids a task keeps for the next documents.
KNOWN = 1 << 19
_ROWS = "row bigint, doc_id bigint, n bigint, ids binary, " + ", ".join(f"x{d} double" for d in range(DIMS))


def signs(slots: int = SLOTS, dims: int = DIMS) -> np.ndarray:
    """The projection: -1 or 1 for each slot and dimension, from a multiplicative hash of the slot."""
    slot = np.arange(1, slots + 1, dtype=np.uint64)
    mixed = slot * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = (mixed[:, None] >> np.arange(40, 40 + dims, dtype=np.uint64)) & np.uint64(1)
    return bits.astype(np.float64) * 2 - 1


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of cells ``(rows, dimensions)`` with *bits* bits an axis.

    The axes are turned into the curve's transposed index from the highest bit down (exchanges and
    inversions of the lower bits, then a Gray code), whose bits are then interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q = np.int64(1) << b
        low = q - 1
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = (x[0] ^ x[d]) & low
            x[0], x[d] = np.where(on, x[0] ^ low, x[0] ^ swap), (x[d] if d == 0 else np.where(on, x[d], x[d] ^ swap))
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        q = np.int64(1) << b
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``row, doc_id, n, ids, x0..``: the tokens of each document with its end, and its projected vector."""
    def run(batches):
        side, sign = tokens.byte_level(path, False), signs()
        slot = (np.arange(len(side.bytes), dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SLOTS)
        project = sign[slot.astype(np.int64)]
        small = np.uint16 if len(side.bytes) <= 1 << 16 else np.uint32
        part, row = TaskContext.get().partitionId(), 0
        known, ids, size, total = {}, [], [], []

        def learn(names):
            """Ids of pieces not seen yet: joined where a vocabulary cuts at blanks, cut apart by their bytes."""
            call = lambda t: [(x, np.cumsum(side.size[x])) for x in side.ids(t)]
            got, _, count, ok = tokens.encode_each(names, call, side)
            if not ok.all():                                    # not given back byte by byte, but ids all the same
                found = [side.ids([n])[0] for n in names]
                got, count = np.concatenate(found), np.array([len(f) for f in found], dtype=np.int64)
            ids.append(got.astype(small))
            size.append(count)
            flat, n = project[ids[-1]], size[-1]
            run_sum = np.concatenate([np.zeros((1, DIMS)), np.cumsum(flat, axis=0)])
            stop = np.cumsum(n)
            total.append(run_sum[stop] - run_sum[stop - n])

        for batch in batches:
            for doc_ids, texts in slices(batch, SLICE_BYTES):
                if len(known) > KNOWN:
                    known, ids, size, total = {}, [], [], []
                numbers, ends, names = tokens.split(texts, False, side.cuts_at_blanks)
                new = list(dict.fromkeys(x for x in names if x not in known))
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    learn(new)
                    ids, size, total = [np.concatenate(ids)], [np.concatenate(size)], [np.concatenate(total)]
                number = np.array([known[x] for x in names], dtype=np.int64)[numbers]
                sizes = size[0]
                flat = ids[0][tokens.spread(number, np.cumsum(sizes) - sizes, sizes)]
                upto = np.concatenate([[0], np.cumsum(sizes[number])])
                stop = upto[ends]
                start = np.concatenate([[0], stop[:-1]])
                at = np.concatenate([np.zeros((1, DIMS)), np.cumsum(total[0][number], axis=0)])
                n = stop - start
                x = (at[ends] - at[np.concatenate([[0], ends[:-1]])] + project[END_ID]) / (n + 1)[:, None]
                raw = binary(flat, np.concatenate([[0], stop]) * flat.itemsize)
                rows = (np.int64(part) << 36) + row + np.arange(len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(doc_ids, pa.int64()), pa.array(n + 1), raw,
                     *(pa.array(x[:, d]) for d in range(DIMS))], ["row", "doc_id", "n", "ids", *(f"x{d}" for d in range(DIMS))])

    return docs.mapInArrow(run, _ROWS)


def binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Stretches of the bytes of an array as a binary column, without a copy of each."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def with_key(rows: DataFrame) -> DataFrame:
    """Rows with the Hilbert ``key`` of their coordinates, each spread by the corpus's mean and deviation.

    The logistic curve stands in for the normal distribution: every value has a cell, none is clipped.
    """
    one = rows.agg(*[f(f"x{d}").alias(f"{n}{d}") for d in range(DIMS) for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]).first()

    def cell(d):
        mean, dev = one[f"mean{d}"], one[f"dev{d}"]
        if not dev:
            return F.lit(1 << (BITS - 1)).cast("bigint")
        # rounded, so that the order of summing does not move documents
        z = (F.col(f"x{d}") - float(f"{mean:.9e}")) / float(f"{dev:.6e}")
        return F.floor(F.lit(float((1 << BITS) - 1)) / (F.exp(z * -1.702) + 1.0)).cast("bigint")

    @F.pandas_udf("bigint")
    def key(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_key(np.stack([c.to_numpy() for c in cells], axis=1)))

    return rows.withColumn("key", key(*[cell(d) for d in range(DIMS)]))


def placed(rows: DataFrame) -> DataFrame:
    """``row, begin``: the tokens before each row along the curve; equal keys go by id, then by row."""
    order = ["key", F.col("doc_id").asc_nulls_last(), "row"]
    return running_total(with_key(rows).select("row", "doc_id", "n", "key"), [], order, weight="n", name="begin").select("row", "begin")


_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    A document is the ids of its whole text by the vocabulary file *path*, without added special tokens, and the id 0.
    ``ids`` are a piece's ids as little-endian unsigned 32-bit numbers.  Sequences are numbered along the curve and full but for the
    last one of the corpus.

    A null or empty text is the id 0 alone; rows without id are packed too, with a null ``doc_id``; of repeated rows
    each is a document; a long text runs over as many sequences as it needs; documents at the same place of the curve go by
    id; an empty table gives an empty result; other columns are not read.
    """
    work = Work(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    whole = work.put(encoded(rows, path), "rows")
    begin = placed(whole.drop("ids"))

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            n, base = (batch.column(names.index(c)).to_numpy() for c in ("n", "begin"))
            raw = b"".join(batch.column(names.index("ids")).to_pylist())
            held = int((n - 1).sum())
            stop = np.cumsum(n)
            ids = np.full(int(stop[-1]), END_ID, dtype="<u4")
            inside = np.ones(len(ids), dtype=bool)
            inside[stop - 1] = False
            ids[inside] = np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * held else np.uint32)
            pieces = (base + n - 1) // length - base // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum((base[doc] // length + k) * length - base[doc], 0)
            size = np.minimum((base[doc] // length + k + 1) * length - base[doc], n[doc]) - start
            place = base[doc] + start
            cols = [batch.column(names.index("doc_id")).take(pa.array(doc)), *map(pa.array, (start, size, n[doc], place // length, place % length))]
            yield pa.RecordBatch.from_arrays([*cols, binary(ids, np.concatenate([[0], np.cumsum(size)]) * 4)],
                                             [c.split()[0] for c in _PIECES.split(", ")])

    return whole.select("row", "doc_id", "n", "ids").join(begin, "row").mapInArrow(cut, _PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n, doc_ids, ids``: the sequences with their documents, at most ``length`` pieces each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), parts.alias("parts"))
            .select("sequence_id", "n", F.col("parts.doc_id").alias("doc_ids"),
                    F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids")))
