"""Language-model scoring with an Elias-Fano bigram trie.

The corpus is cut into chunks of documents, and a chunk talks to shards of the vocabulary and of the
trie in packed arrays: one row per chunk and shard, never one per word.

1. chunks: words numbered within the chunk, stored once, so texts are read and split one time;
2. vocabulary: each shard of word hashes sums the training counts and numbers its words;
3. trie: each shard of (context, successor) pairs sums the counts, writes its trie to a file, maps it,
   and answers every chunk's pairs by successor search, with quantised discounted probabilities;
4. scores: a chunk joins the answers with the unigram share and sums by document.

p(w | v) = (c(v w) - D) / c(v) + D * n(v) / c(v) * p1(w), n(v) the different successors of v, and
p1 the add-one unigram share; an unseen v leaves p1.  Words are their 64-bit hashes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from voxelloom.llm.common import Work, words
from voxelloom.llm.eliasfano import Trie, quantise, restore

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
CHUNK_TOKENS = 1_000_000
#: Chunks whose pairs come to about the work of one shard.
CHUNKS_A_SHARD = 2
#: A context with more training tokens than this, and than a shard's share of all, is dealt over several shards.
HOT = 1 << 16
END = xxhash.xxh64_intdigest(b"")  # no word is empty
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths, compressed byte plane by byte plane (high bytes are mostly 0)."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(_planes(a).tobytes() for a in arrays)]))


def _planes(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T) if len(a) else a


def unpack(raw: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(bytes(raw))
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 * (1 + 2 * n), []
    for code, size in head.reshape(-1, 2).tolist():
        kind = np.dtype(chr(code))
        raw = np.frombuffer(data, np.uint8, size * kind.itemsize, at)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, size).T).reshape(-1).view(kind) if size else np.zeros(0, kind))
        at += len(raw)
    return out


def chunks(docs: DataFrame, size: int = CHUNK_TOKENS) -> DataFrame:
    """``chunk, n, packed``: ids, fold marks, document ends, word numbers and the word hashes of a chunk, by number."""
    def run(batches):
        ids, rows, total, known = [], [], 0, {}

        def flush():
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))
            held = np.array([zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids], dtype=np.uint8)
            ends = np.cumsum([len(r) for r in rows]).astype(np.int64)
            packed = pack(np.array(ids, dtype=np.int64), held, ends, np.concatenate(rows), hashes)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([total], pa.int64()),
                                               pa.array([packed], pa.binary())], ["chunk", "n", "packed"])

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                number = [known.setdefault(w, len(known)) for w in words(raw or b"")]
                number.append(known.setdefault(b"", len(known)))
                ids.append(doc)
                rows.append(np.array(number, dtype=np.uint32))
                total += len(number)
                if total >= size:
                    yield flush()
                    ids, rows, total, known = [], [], 0, {}
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "chunk string, n bigint, packed binary")


def _train_tokens(ends: np.ndarray, held: np.ndarray) -> np.ndarray:
    return np.repeat(held == 0, np.diff(ends, prepend=0))


_PART = "chunk string, kind int, shard int, packed binary"


def vocabulary(parts: DataFrame, shards: int) -> DataFrame:
    """Per chunk and word shard the numbers and training counts of the chunk's words, in the order of their hashes."""
    def split(batches):
        for batch in batches:
            out = []
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                _, held, ends, tokens, hashes = unpack(raw)
                n = np.bincount(tokens[_train_tokens(ends, held)], minlength=len(hashes)).astype(np.int64)
                order = np.argsort(hashes)
                hashes, n = hashes[order], n[order]
                cut = np.searchsorted(hashes, _bounds(shards))
                cut = np.concatenate([[0], cut, [len(hashes)]])
                out += [(chunk, 0, s, pack(hashes[a:b], n[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
            yield _rows(out)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(x) for x in pdf["packed"]]
        seen, place = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        n = np.zeros(len(seen), dtype=np.int64)
        np.add.at(n, place, np.concatenate([g[1] for g in got]))
        ends = np.cumsum([len(g[0]) for g in got])[:-1]
        whole = np.array([len(seen), int((n > 0).sum()), int(n.sum())], dtype=np.int64)
        pdf = pdf[["chunk", "kind", "shard"]].copy()
        pdf["packed"] = [pack(p.astype(np.uint32), n[p], whole) for p in np.split(place, ends)]
        return pdf

    return parts.mapInArrow(split, _PART).groupBy("shard").applyInPandas(merge, _PART)


def _bounds(shards: int) -> np.ndarray:
    return (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                                       pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())],
                                      ["chunk", "kind", "shard", "packed"])


class _Chunk:
    """A chunk with the numbers and counts of its words: its pairs, dealt to shards in a fixed order.

    All pairs of a context go to one shard, which knows the different successors.  Of a hot context every shard that holds
    a part is asked for its successors, whatever pairs the chunk has.  Contexts without training tokens ask nothing.
    """

    def __init__(self, raw: bytes, told: pd.DataFrame, starts: np.ndarray, shards: int, hot: int):
        self.ids, self.held, self.ends, self.tokens, self.hashes = unpack(raw)
        told = told[told["kind"] == 0].sort_values("shard")
        got = [(int(s), *unpack(x)) for s, x in zip(told["shard"], told["packed"])]
        order = np.argsort(self.hashes)
        self.number, self.count = np.empty(len(order), dtype=np.uint64), np.empty(len(order), dtype=np.int64)
        self.number[order] = np.concatenate([g[1].astype(np.uint64) + np.uint64(starts[g[0]]) for g in got])
        self.count[order] = np.concatenate([g[2] for g in got])
        end = np.uint32(np.flatnonzero(self.hashes == np.uint64(END))[0])
        before = np.concatenate([[end], self.tokens[:-1]])  # a document ends with the end token, which starts the next
        pair = before.astype(np.uint64) * np.uint64(len(self.hashes)) + self.tokens
        self.pairs, self.place = np.unique(pair, return_inverse=True)
        self.first = (self.pairs // np.uint64(len(self.hashes))).astype(np.int64)
        self.second = (self.pairs % np.uint64(len(self.hashes))).astype(np.int64)
        a, b = self.number[self.first], self.number[self.second]
        parts = np.minimum(shards, 1 + self.count // hot)
        home = (((self.number * _MIX) >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        spread = (((b * _MIX) >> np.uint64(33)) % parts[self.first].astype(np.uint64)).astype(np.int64)
        shard = np.where(self.count[self.first] > 0, (home[self.first] + spread) % shards, shards)
        self.order = np.argsort(shard, kind="stable")
        self.cut = np.searchsorted(shard[self.order], np.arange(shards + 1))
        self.keys = (a << np.uint64(32)) | b
        self.split = parts > 1
        many = np.flatnonzero(self.split)
        size = parts[many]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        where = (np.repeat(home[many], size) + at) % shards
        order = np.argsort(where, kind="stable")
        self.asks = np.split(np.repeat(many, size)[order], np.searchsorted(where[order], np.arange(1, shards)))

    def slices(self):
        """Shard, its pairs by context, and the hot contexts it is asked about."""
        for s, (lo, hi) in enumerate(zip(self.cut[:-1], self.cut[1:])):
            if lo < hi or len(self.asks[s]):
                at = self.order[lo:hi]
                yield s, at[np.argsort(self.keys[at] >> np.uint64(32), kind="stable")], self.asks[s]


def _contexts(keys: np.ndarray) -> np.ndarray:
    """Index of the first pair of each context; pairs of a context stand together."""
    return np.flatnonzero(np.concatenate([[True], (keys[1:] >> np.uint64(32)) != (keys[:-1] >> np.uint64(32))])[:len(keys)])


def pairs_of(parts: DataFrame, told: DataFrame, starts: np.ndarray, shards: int, hot: int) -> DataFrame:
    """Per chunk and trie shard: pairs, their training counts, the count of each context, and hot contexts."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, raw in zip(left["chunk"], left["packed"]):
            c = _Chunk(raw, right, starts, shards, hot)
            n = np.bincount(c.place[_train_tokens(c.ends, c.held)], minlength=len(c.pairs)).astype(np.int64)
            for s, at, asks in c.slices():
                keys = c.keys[at]
                first = _contexts(keys)
                out.append((chunk, 1, s, pack((keys[first] >> np.uint64(32)).astype(np.uint32),
                                              np.diff(np.append(first, len(keys))).astype(np.int32),
                                              (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                                              n[at] if n[at].max(initial=0) > 65535 else n[at].astype(np.uint16),
                                              c.count[c.first[at[first]]], c.number[asks].astype(np.uint32))))
        return pd.DataFrame(out, columns=["chunk", "kind", "shard", "packed"])

    return parts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(run, _PART)


def answer(pairs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """Per chunk and trie shard: a code for each pair, and the different successors in this shard of each context and
    of each hot context."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n, whole, sizes, asked = [], [], [], [], []
        for raw in pdf["packed"]:
            ctx, size, word, count, total, asks = unpack(raw)
            keys.append((np.repeat(ctx.astype(np.uint64), size) << np.uint64(32)) | word)
            n.append(count)
            whole.append(np.repeat(total, size))
            sizes.append(size)
            asked.append(asks.astype(np.uint64))
        ends = np.cumsum([len(k) for k in keys])[:-1]
        keys, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count = np.bincount(place, np.concatenate(n), len(keys))
        there = count > 0
        codes = quantise((count[there] - discount) / np.concatenate(whole)[first[there]])
        handle, path = tempfile.mkstemp(prefix="trie-")
        os.close(handle)
        try:
            Trie.write(path, keys[there], codes)
            trie = Trie(path)
            # each different pair is searched once, whatever the chunks that ask for it
            start = _contexts(keys)
            length = np.diff(np.append(start, len(keys)))
            lo, hi, base = trie.context(keys[start] >> np.uint64(32))
            code = trie.find(keys & np.uint64(0xFFFFFFFF), *(np.repeat(x, length) for x in (lo, hi, base)))
            follow = np.repeat((hi - lo).astype(np.int32), length)
            lo, hi, _ = trie.context(np.concatenate(asked))
            more = np.split((hi - lo).astype(np.int32), np.cumsum([len(x) for x in asked])[:-1])
            del trie
        finally:
            os.unlink(path)
        pdf = pdf[["chunk", "kind", "shard"]].copy()
        pdf["packed"] = [pack(code[p], follow[p[np.cumsum(size) - size]], m)
                         for p, size, m in zip(np.split(place, ends), sizes, more)]
        return pdf

    return pairs.groupBy("shard").applyInPandas(run, _PART)


_SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
           "score double")


def scores(parts: DataFrame, told: DataFrame, starts: np.ndarray, shards: int, hot: int, n_all: int, n_words: int,
           discount: float = DISCOUNT) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for raw in left["packed"]:
            c = _Chunk(raw, right, starts, shards, hot)
            code = np.zeros(len(c.pairs), dtype=np.uint16)
            follow = np.zeros(len(c.hashes), dtype=np.int64)
            got = right[right["kind"] == 1]
            answers = dict(zip(got["shard"], got["packed"]))
            for s, at, asks in c.slices():
                codes, n, more = unpack(answers[s])
                code[at] = codes
                first = c.first[at[_contexts(c.keys[at])]]
                follow[first] = np.where(c.split[first], follow[first], n)
                follow[asks] += more
            one = (c.count + 1.0) / (n_all + 1 * (n_words + 1))
            back = np.where(c.count > 0, discount * follow / np.maximum(c.count, 1), 1.0)
            p = np.log10(restore(code) + back[c.first] * one[c.second])
            begin = np.concatenate([[0], c.ends[:-1]])
            out.append(pd.DataFrame({
                "doc_id": c.ids, "held_out": c.held == 1, "n_tokens": c.ends - begin,
                "n_known": np.add.reduceat((c.count > 0)[c.tokens].astype(np.int64), begin), "train_tokens": n_all,
                "base_score": np.add.reduceat(np.log10(one)[c.tokens], begin), "score": np.add.reduceat(p[c.place], begin)}))
        return pd.concat(out) if out else pd.DataFrame({k.split()[0]: [] for k in _SCORES.split(", ")})

    return parts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(run, _SCORES)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Log10 probability of every whole text, learnt from the documents whose crc32 of the id is not 2 modulo 7.

    One row per document with an id: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.  A
    text is its words and one end token; a null text is the end token alone.  Repeated rows count and are
    scored each; an empty table gives an empty result; other columns are not read.
    """
    work = Work(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = work.put(chunks(rows.where("doc_id IS NOT NULL"), chunk_tokens), "chunks")
    shards = max(16, parts.count() // CHUNKS_A_SHARD)
    told = work.put(vocabulary(parts, shards), "words")

    def head(batches):
        for batch in batches:
            shard = batch.column(0).to_pylist()
            whole = [unpack(x)[2].tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(
                pa.array([w[i] for w in whole], pa.int64()) for i in range(3))], ["shard", "size", "known", "n"])

    one = told.groupBy("shard").agg(F.first("packed").alias("packed"))
    sizes = one.mapInArrow(head, "shard int, size bigint, known bigint, n bigint").collect()  # three numbers a shard
    size = np.zeros(shards + 1, dtype=np.uint64)
    for r in sizes:
        size[r["shard"] + 1] = r["size"]
    starts = np.cumsum(size)
    if int(starts[-1]) >= 1 << 32:
        raise ValueError("more than 2^32 different words: numbers of 32 bits do not hold them")
    n_all, n_words = sum(r["n"] for r in sizes), sum(r["known"] for r in sizes)
    hot = max(HOT, n_all // shards)
    codes = work.put(answer(pairs_of(parts, told, starts, shards, hot)), "codes")
    return scores(parts, told.unionByName(codes), starts, shards, hot, n_all, n_words)
