"""Benchmark decontamination by template canonicalisation.

Words are replaced by typed placeholders: numbers, units after a number, and names (words with a capital).
A capital at the start of a sentence or line may be a name or not: windows of the benchmark are hashed under
every reading of theirs, documents once with all as names and once with none.  Windows are joined by the hash;
where a window has slots, the values must agree in which slots are equal, so a question with other
numbers and names is still caught but a chance fit is not.  Windows with the same words match whatever their types.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxelloom.llm.common import BITMAP_BITS, Work, bitmap, unpacked

WINDOW = 10
#: A window needs so many words that are no placeholders, or, with the same words throughout, so many words.
LITERALS = 6
#: Shorter items match as a whole line or sentence, from so many words on.
WHOLE = 3
_STRIP = " \t\r\n\v\f.,;:!?\"'()[]{}<>*#%&$|/\\-_=+`~^«»„“”’…¿¡"
_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
_GLUED = re.compile(r"([+\-]?\d[\d.,]*)(%|[a-zµ°]{1,4}\d?)")
#: Units of measure and money that may follow a number; fixed values.
UNITS = frozenset(("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "cl", "l", "s", "ms",
                   "min", "h", "hr", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a", "j", "kj", "cal", "kcal", "pa", "bar",
                   "°c", "°f", "k", "%", "usd", "eur", "gbp", "kb", "mb", "gb", "tb", "mph", "inch", "inches", "feet",
                   "meters", "metres", "miles", "hours", "minutes", "seconds", "days", "weeks", "months", "years",
                   "dollars", "euros", "cents", "percent", "degrees", "liters", "litres", "grams", "kilograms", "pounds"))
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_CACHE_WORDS = 500_000
_M = np.uint64(0x9E3779B97F4A7C15)


class Reader:
    """Texts to templates: type, template hash and value hash of each word.

    Different words are numbered and looked at once, up to a fixed number of them.
    """

    class _Words(dict):
        def __init__(self, look):
            super().__init__()
            self.look = look

        def __missing__(self, raw: str) -> int:
            at = self[raw] = len(self)
            self.look(raw, at)
            return at

    def __init__(self):
        self.known = Reader._Words(self._look)
        self.facts = np.zeros(1 << 12, dtype=[("value", np.uint64), ("kind", np.int8), ("ends", bool), ("unit", bool)])

    def _look(self, raw: str, at: int) -> None:
        """Value hash, type without context (NAME: a capital), whether the word ends a sentence, whether it may be a unit."""
        if at >= len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        core = raw.strip(_STRIP)
        low = core.lower()
        h = xxhash.xxh64_intdigest(low.encode("utf-8", "replace")) | 1
        ends = raw.rstrip("\"')]}»”’")[-1:] in (".", "?", "!", ":", "…")
        if _NUMBER.fullmatch(core):
            kind = NUMBER
        elif core[:1].isupper() and not core.isupper():
            kind = NAME
        else:
            kind = LITERAL
        self.facts[at] = (h if core else 0, kind, ends, low in UNITS)

    def read_all(self, texts: list[str]):
        """The words of all texts in a row, those of punctuation alone left out: types with every capital as NAME, value
        hashes, which names may be none, which literals are units, the index of the text, and the index of the sentence."""
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        rows = [_split(t) for t in texts]
        lines = [line for text in rows for line in text]
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        total = int(sizes.sum())
        number = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(lines)), np.int64, total)
        facts = self.facts[number]
        value, kind = facts["value"], facts["kind"]
        text = np.repeat(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), sizes)
        first = np.ones(total, dtype=bool)
        first[1:] = facts["ends"][:-1]
        starts = np.cumsum(sizes) - sizes
        first[starts[starts < total]] = True
        unit = facts["unit"].copy()
        unit[:1] = False
        unit[1:] &= (kind[:-1] == NUMBER) & (text[1:] == text[:-1])
        real = value != 0
        return kind[real], value[real], ((kind == NAME) & first)[real], unit[real], text[real], np.cumsum(first)[real]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Types, template hashes and value hashes; capitals at the start of a sentence or line are no names."""
        return reading(*self.read_all([text])[:4])


def reading(kind, value, literal, unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Types, template hashes and value hashes with the words of *literal* as literals."""
    kind = np.where(literal, LITERAL, kind).astype(np.int8)
    kind[(kind == LITERAL) & unit] = UNIT
    return kind, np.where(kind == LITERAL, value, kind.astype(np.uint64)), value


def _split(text: str) -> list[list[str]]:
    """The words of each line."""
    if any(map(text.__contains__, "0123456789")):
        text = _GLUED.sub(r"\1 \2", text)
    return [line.split() for line in text.split("\n")]


def hashes(template: np.ndarray, n: int, places: np.ndarray | None = None) -> np.ndarray:
    """Template hash of every window of *n* words, or of those at *places*."""
    m = len(template) - n + 1
    h = np.full(m if places is None else len(places), np.uint64(n * int(_M) % (1 << 64)))
    for i in range(n):
        h ^= template[i:i + m] if places is None else template[places + i]
        h *= _M
        h ^= h >> np.uint64(29)
    return h


def windows(kind: np.ndarray, template: np.ndarray, value: np.ndarray, width: int = WINDOW):
    """Hash, slot pattern and literal count of each window; a shorter text is one window of its own width.

    The pattern says for each slot which earlier slot of the window has the same value, so equal patterns
    mean that one set of values maps onto the other, slot by slot, without conflict.
    """
    n = min(width, len(kind))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(kind) - n + 1
    h = hashes(template, n)
    literals = np.zeros(m, dtype=np.int64)
    for i in range(n):
        literals += kind[i:i + m] == LITERAL
    pattern = np.zeros(m, dtype=np.uint64)
    for at in np.flatnonzero(literals < n):
        first: dict[int, int] = {}
        code = 0
        for i in np.flatnonzero(kind[at:at + n] != LITERAL):
            code = (code * 31 + first.setdefault(int(value[at + i]), int(i)) + 1) & 0xFFFFFFFFFFFF
        pattern[at] = code
    return h, pattern, literals


_WINDOWS = "id bigint, h bigint, pattern bigint, at int, n int"
#: Pattern of windows that are compared by their words.
_WORDS = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Pattern of items that are compared with whole lines or sentences, by their words.
_WHOLE = np.uint64(0xFFFFFFFFFFFFFFFE)
#: Texts are read in blocks of so many characters, so arrays stay in the cache.
BLOCK_CHARS = 500_000


def _item_windows(got, n: int, literals: int, whole: int):
    """``(hash, pattern, at)`` of the windows of an item: templates under every reading, and the words themselves."""
    kind, value, maybe, unit = got
    if whole <= len(kind) < literals:
        yield hashes(value, n)[0], _WHOLE, 0
    for at in range(len(kind) - n + 1):
        part = [x[at:at + n] for x in got]
        spots = np.flatnonzero(part[2])
        for chosen in itertools.product((False, True), repeat=len(spots)):
            as_literal = np.zeros(n, dtype=bool)
            as_literal[spots] = chosen
            h, pattern, literal = windows(*reading(part[0], part[1], as_literal, part[3]), n)
            if literal[0] >= literals:
                yield h[0], pattern[0], at
        if n >= literals:
            yield hashes(part[1], n)[0], _WORDS, at


def _item_widths(got, width: int, literals: int) -> list[int]:
    """The item's own width and, if no window of it has enough literals with all capitals as names, the least that has."""
    kind, value, maybe, unit = got
    n = min(width, len(kind))
    count = np.cumsum([0, *(reading(kind, value, maybe & False, unit)[0] == LITERAL)])
    wide = next((m for m in range(n, len(kind) + 1) if (count[m:] - count[:len(count) - m]).max() >= literals), n)
    return sorted({n, wide})


def _block_windows(got, n: int, literals: int, bits: np.ndarray):
    """``(text, hash, pattern, at)`` of a block of documents, where the bit of the hash is set.

    Windows are hashed over all texts in a row and those across two texts left out.  Names at starts are all read as
    names, then, in the windows that hold one, as none.
    """
    kind, value, maybe, unit, text, sentence = got
    m = len(kind) - n + 1
    if m <= 0:
        return
    inside = text[:m] == text[n - 1:]
    begins = np.searchsorted(text, np.arange(int(text[-1]) + 1))
    place = lambda at: at - int(begins[text[at]])
    hit = lambda h: bits[(h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)]
    by_words = hashes(value, n)
    if n < literals:  # an item that short counts as a whole line or sentence only
        begin = np.ones(m, dtype=bool)
        begin[1:] = sentence[1:m] != sentence[:m - 1]
        end = np.ones(m, dtype=bool)
        end[:-1] = sentence[n:] != sentence[n - 1:-1]
        for at in np.flatnonzero(inside & begin & end & hit(by_words)).tolist():
            yield text[at], by_words[at], _WHOLE, place(at)
        return
    for at in np.flatnonzero(inside & hit(by_words)).tolist():
        yield text[at], by_words[at], _WORDS, place(at)
    k, template, _ = reading(kind, value, maybe & False, unit)
    found = [(k, template, np.flatnonzero(inside & hit(hashes(template, n))))]
    doubts = np.cumsum(np.concatenate([[0], maybe]))
    doubtful = np.flatnonzero(inside & (doubts[n:] > doubts[:m]))
    if len(doubtful):
        k, template, _ = reading(kind, value, maybe, unit)
        found.append((k, template, doubtful[hit(hashes(template, n, doubtful))]))
    for k, template, places in found:
        for at in places.tolist():  # literals and patterns are worked out for what passes
            h, pattern, literal = windows(k[at:at + n], template[at:at + n], value[at:at + n], n)
            if literal[0] >= literals:
                yield text[at], h[0], pattern[0], place(at)


def _blocks(ids: list, texts: list):
    """Rows in blocks of about BLOCK_CHARS characters; a longer text is a block by itself."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > BLOCK_CHARS:
            yield ids[begin:i], [t or "" for t in texts[begin:i]]
            begin, size = i, 0
        size += len(text or "")
    if begin < len(ids):
        yield ids[begin:], [t or "" for t in texts[begin:]]


def _windows_of(rows: DataFrame, widths: list[int], literals: int, whole: int, keep: np.ndarray | None) -> DataFrame:
    """Windows of ``(id, text)`` with enough literals or words: the items' own (of one width, see _item_widths)
    without *keep*, else those of each width whose hash has its bit set."""
    shared = rows.sparkSession.sparkContext.broadcast(keep)

    def run(batches):
        reader, bits = Reader(), None if shared.value is None else unpacked(shared.value)
        for batch in batches:
            for ids, texts in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                if bits is None:
                    for doc, text in zip(ids, texts):
                        got = reader.read_all([text])[:4]
                        for n in _item_widths(got, widths[0], literals):
                            if n:
                                out += [(doc, h, pattern, at, n) for h, pattern, at in _item_windows(got, n, literals, whole)]
                else:
                    got = reader.read_all(texts)
                    for n in widths:
                        out += [(ids[i], h, pattern, at, n) for i, h, pattern, at in _block_windows(got, n, literals, bits)]
                if out:
                    doc, h, pattern, at, n = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64)),
                         pa.array(np.array(pattern, np.uint64).view(np.int64)), pa.array(np.array(at, np.int32)),
                         pa.array(n, pa.int32())], ["id", "h", "pattern", "at", "n"])

    return rows.mapInArrow(run, _WINDOWS)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", width: int = WINDOW,
                  literals: int = LITERALS, whole: int = WHOLE) -> DataFrame:
    """``doc_id, item_id, n_windows, first_at``: documents that hold a window of a benchmark item's template.

    One row per contaminated document: the item with most matched windows (ties: the smaller item), where a window
    that several items share counts for the smallest of them, and the word position of the first match.
    Texts are read whole.  Null texts and texts without words match nothing, nor do rows without id.  An item
    of fewer words than *width* is one window of its own width, and one whose windows are mostly slots has wider ones.  A window with fewer than *literals* words that
    are no placeholders matches by the same words only.  An item of fewer than *literals* words matches where the same words are a
    whole line or sentence, or several; one of fewer than *whole* words cannot be told from chance.  Empty tables give an
    empty result; rows that repeat count as one document or item.  Other columns are not read.
    """
    work = Work(docs.sparkSession, "decontam")
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text).cast("string").alias("text"))
    wanted = (_windows_of(items.where("id IS NOT NULL"), [width], literals, whole, None)
              .groupBy("h", "pattern", "n").agg(F.min("id").alias("item_id")))
    wanted = work.put(wanted, "wanted")
    widths = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # *width*, less for short items, more for items of few literals
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _windows_of(rows.where("id IS NOT NULL"), widths, literals, whole, bitmap(wanted, "h"))
    # h is signed in the tables; the bit of a hash is that of its unsigned value, as pmod gives it for powers of two
    hits = (found.join(wanted, ["h", "pattern", "n"]).groupBy("id", "at", "n").agg(F.min("item_id").alias("item_id")))
    hits = hits.groupBy(F.col("id").alias("doc_id"), "item_id").agg(
        F.countDistinct("at").alias("n_windows"), F.min("at").alias("first_at"))
    best = F.struct(F.col("n_windows"), (-F.col("item_id")).alias("i"), "first_at")
    return (hits.groupBy("doc_id").agg(F.max(best).alias("b"))
            .select("doc_id", (-F.col("b.i")).alias("item_id"), F.col("b.n_windows").alias("n_windows"),
                    F.col("b.first_at").alias("first_at")))


def clean(docs: DataFrame, benchmark: DataFrame, **named) -> DataFrame:
    """The documents without a benchmark window; rows without id are kept."""
    bad = contamination(docs, benchmark, **named).select(F.col("doc_id").alias("_bad"))
    return docs.join(bad, F.col(named.get("id_col", "doc_id")) == F.col("_bad"), "left_anti")
