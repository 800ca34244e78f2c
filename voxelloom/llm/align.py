"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, and how firmly their tokens go together.

Both tokenizers encode a blank and the text.  Tokens get byte ends from the libraries' spans, coarse cuts that are
refined by decoded bytes inside multi-byte characters and byte-fallback runs (``tokens.byte_ends``).  Ends that both
share cut the tokens into groups; an A and a B token whose bytes overlap are linked.

1. bundles of documents: different pieces of text are encoded once a task, documents are lists of piece numbers; beside
   each bundle stand its id pairs with the number of its documents that hold them linked;
2. those numbers are summed over the corpus by pair, and the highest is taken by A id;
3. each bundle gets its own pairs' sums back, one row a pair, and counts them by document.

A pair is one row a bundle however often it occurs, so common pairs are no hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxelloom.llm import tokens
from voxelloom.llm.common import Work, small
from voxelloom.llm.lm import pack, unpack

BUNDLE_BYTES, SLICE_BYTES = 2 << 20, 2 << 20
#: Different pieces of text whose tokens a task keeps for the next bundles.
KNOWN = 1 << 17
_BUNDLES = "bundle bigint, kind int, packed binary"
_OUT = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
        "groups string")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def slices(batch: pa.RecordBatch, size: int):
    """``ids, texts`` of parts of a batch with about *size* bytes of text each; a null text is an empty one."""
    ids, texts = batch.column(0), batch.column(1)
    length = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(length) - length) // size
    for lo, hi in zip(starts := [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()], [*starts[1:], len(ids)]):
        if lo < hi:                                              # copied slice by slice, as a batch may be large
            yield ids.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).cast(pa.large_string()).fill_null("")


def distinct(x: np.ndarray) -> np.ndarray:
    """Different values in order; sorting beats hashing for long arrays of few repeats."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of two sorted arrays without repeats that are in both."""
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    return a[b[at] == a] if len(b) else a[:0]


@dataclass
class Bundle:
    """Documents as numbers of pieces, and the tokens of the pieces: ids, byte widths and counts on both sides."""

    ids: np.ndarray
    ends: np.ndarray
    numbers: np.ndarray
    a: np.ndarray
    width_a: np.ndarray
    count_a: np.ndarray
    b: np.ndarray
    width_b: np.ndarray
    count_b: np.ndarray

    def pack(self) -> bytes:
        first, *rest = (getattr(self, f.name) for f in fields(self))
        return pack(first, *map(small, rest))

    @classmethod
    def unpack(cls, raw: bytes) -> "Bundle":
        return cls(*(x.astype(np.int64) for x in unpack(raw)))

    def __post_init__(self):
        end_a, end_b = np.cumsum(self.width_a, dtype=np.int64), np.cumsum(self.width_b, dtype=np.int64)
        every = distinct(np.concatenate([end_a, end_b]))
        self.link_a, self.link_b = np.searchsorted(end_a, every), np.searchsorted(end_b, every)
        common = _both(end_a, end_b)
        self.group_a, self.group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        n = len(self.count_a)
        piece = np.repeat(np.arange(n), self.count_a)
        self.n_links = np.bincount(piece[self.link_a], minlength=n)
        self.n_groups = np.bincount(piece[np.searchsorted(end_a, common)], minlength=n)
        pair = (self.a.astype(np.int64)[self.link_a] << 32) | self.b.astype(np.int64)[self.link_b]
        self.pairs, self.link_pair = np.unique(pair, return_inverse=True)

    def by_document(self, value: np.ndarray) -> np.ndarray:
        """Sums of a number of each piece over the documents."""
        total = np.concatenate([[0], np.cumsum(value[self.numbers])])
        return total[self.ends] - total[np.concatenate([[0], self.ends[:-1]])]

    def holders(self) -> np.ndarray:
        """How many documents hold each pair."""
        n = max(len(self.count_a), 1)
        doc = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        once = distinct(doc * n + self.numbers)
        doc, number = once // n, once % n
        start = np.cumsum(self.n_links) - self.n_links
        at = self.link_pair[tokens.spread(number, start, self.n_links)]
        m = max(len(self.pairs), 1)
        return np.bincount(distinct(np.repeat(doc, self.n_links[number]) * m + at) % m, minlength=len(self.pairs))

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        ids = np.concatenate([self.a, self.b]).astype(np.int64)
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        place = np.concatenate([self.group_a, self.group_b]) * 2 + side
        order = np.argsort(place, kind="stable")
        ids, side, place = ids[order], side[order], place[order]
        last = np.append(place[1:] != place[:-1], True)
        mark = np.where(last, 1 + side, 0)
        both = self.count_a + self.count_b
        stop = np.cumsum(both)
        mark[stop[both > 0] - 1] = 3
        code, back = np.unique(ids * 4 + mark, return_inverse=True)
        texts = [f"{c >> 2}{(',', '|', ';', '')[c & 3]}" for c in code.tolist()]
        shown = [texts[k] for k in back.tolist()]
        text = ["".join(shown[e - n:e]) for e, n in zip(stop.tolist(), both.tolist())]
        numbers, out, start = self.numbers.tolist(), [], 0
        for end in self.ends.tolist():
            out.append(";".join([text[k] for k in numbers[start:end]]))
            start = end
        return out


class Memo:
    """Pieces of text seen so far in a task with their tokens: ids, byte widths and counts on both sides."""

    def __init__(self, side_a, side_b):
        self.sides = side_a, side_b
        self.known: dict[str, int] = {}
        self.ok = np.zeros(0, dtype=bool)
        self.kept = [[np.zeros(0, dtype=t) for t in (np.uint32, np.uint8, np.int64)] for _ in self.sides]

    def numbers(self, names: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(n for n in names if n not in self.known))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        found = [tokens.encode_each(new, side.spans, side) for side in self.sides] if new else []
        ok = found[0][3] & found[1][3] if new else self.ok[:0]
        self.ok = np.concatenate([self.ok, ok])
        for kept, (ids, ends, count, _) in zip(self.kept, found):
            keep = np.repeat(ok, count)
            for k, x in enumerate((ids[keep], small(_widths(ends, count)[keep]), count * ok)):
                kept[k] = np.concatenate([kept[k], x])
        return np.array([self.known[n] for n in names], dtype=np.int64)

    def bundle(self, ids: list, parts: list[np.ndarray]) -> Bundle:
        """Documents by their pieces, with the tokens of these pieces; one with a piece that is not given back has none."""
        parts = [p if self.ok[p].all() else p[:0] for p in parts]
        used, numbers = np.unique(np.concatenate(parts), return_inverse=True)
        sides = []
        for ids_of, widths, counts in self.kept:
            at = tokens.spread(used, np.cumsum(counts) - counts, counts)
            sides += [ids_of[at], widths[at], counts[used]]
        return Bundle(np.array(ids, dtype=np.int64), np.cumsum([len(p) for p in parts]).astype(np.int64), numbers, *sides)


def bundles(docs: DataFrame, path_a: str, path_b: str, size: int = BUNDLE_BYTES) -> DataFrame:
    """``bundle, kind, packed``: kind 0 is a bundle of documents, kind 1 its pairs and their numbers of documents."""
    def run(batches):
        side_a, side_b = tokens.byte_level(path_a, True), tokens.pieces(path_b)
        cut = side_a.cuts_at_blanks and side_b.cuts_at_blanks
        part, made, memo = TaskContext.get().partitionId(), 0, Memo(side_a, side_b)
        ids, parts, held = [], [], 0

        def flush():
            bundle, key = memo.bundle(ids, parts), part << 32 | made
            return pa.RecordBatch.from_arrays([pa.array([key, key]), pa.array([0, 1], pa.int32()), pa.array([
                bundle.pack(), pack(bundle.pairs, small(bundle.holders()))], pa.binary())], schema=_arrow(_BUNDLES))

        for batch in batches:
            for some, texts in slices(batch, SLICE_BYTES):
                numbers, ends, names = tokens.split(texts, True, cut)
                empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
                ids += some
                parts += [p[:0] if e else p for p, e in zip(np.split(memo.numbers(names)[numbers], ends[:-1]), empty.tolist())]
                held += texts.nbytes
                if held >= size:
                    yield flush()
                    ids, parts, held, made = [], [], 0, made + 1
                    if len(memo.known) > KNOWN:
                        memo = Memo(side_a, side_b)
                    pa.default_memory_pool().release_unused()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _BUNDLES)


def _widths(ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], ends[:-1]])
    first = np.cumsum(counts) - counts
    before[first[counts > 0]] = 0
    return ends - before


def links(parts: DataFrame) -> DataFrame:
    """``bundle, pair, docs``: the pairs of each bundle, A id in the upper and B id in the lower half."""
    def run(batches):
        for batch in batches:
            for bundle, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, docs = unpack(raw)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), bundle, dtype=np.int64)), pa.array(pairs),
                                                  pa.array(docs.astype(np.int64))], ["bundle", "pair", "docs"])

    return parts.where("kind = 1").select("bundle", "packed").mapInArrow(run, "bundle bigint, pair bigint, docs bigint")


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair, n``: how many documents hold each pair."""
    return linked.groupBy("pair").agg(F.sum("docs").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Aligned tokens of every whole text: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    *path_a* is a byte-level file of the tokenizers library, *path_b* a sentencepiece model with byte fallback; special
    tokens are plain text.  ``groups`` lists the ids between common ends, ``a1,a2|b1;a3|b2,b3``.  A pair's count is the
    number of documents that hold it linked; ``n_best`` counts links whose count is the highest of their A id, ties
    included, and ``count_sum`` sums the counts over links.

    A text that is null, empty or not given back byte by byte by both tokenizers has no tokens: zeros and ``''``.  Rows
    without id are left out and count nowhere; of repeated rows each is a document; a text of any length stays in one
    bundle; an empty table gives an empty result; other columns are not read.
    """
    work = Work(docs.sparkSession, "align")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = work.put(bundles(rows.where("doc_id IS NOT NULL"), path_a, path_b, bundle_bytes), "bundles")
    linked = links(parts)
    counts = work.put(pair_counts(linked), "counts")
    # at most a row per id of the first vocabulary, however large the corpus
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    counts = counts.join(F.broadcast(top), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    told = linked.drop("docs").join(counts, "pair").select("bundle", "pair", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, n = (right.column(c).to_numpy() for c in ("pair", "n"))
        best = right.column("best").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.argsort(pair)
        out = []
        for raw in left.column("packed").to_pylist():
            x = Bundle.unpack(raw)
            at = order[np.searchsorted(pair, x.pairs, sorter=order)][x.link_pair]
            piece = np.repeat(np.arange(len(x.count_a)), x.n_links)
            sums = [np.bincount(piece, weights=v[at], minlength=len(x.count_a)).astype(np.int64) for v in (best, n)]
            cols = [x.ids, *(x.by_document(v) for v in (x.count_a, x.count_b, x.n_groups, x.n_links, *sums))]
            out.append(pa.Table.from_arrays([*map(pa.array, cols), pa.array(x.groups(), pa.string())], schema=_arrow(_OUT)))
        return pa.concat_tables(out) if out else _arrow(_OUT).empty_table()

    whole = parts.where("kind = 0").select("bundle", "packed")
    return whole.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInArrow(run, _OUT)
