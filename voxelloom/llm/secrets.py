"""Secret scans with a worklist of decoded layers.

A text is the first layer.  Every layer is scanned, then unwrapped in each way that applies:
percent escapes, Unicode escapes, base64 runs, and compressed bytes inside base64.  New
layers join the worklist until none appears; a layer that was met before at the same place is not
opened again, which ends cycles.  Each layer carries, for every character, the span of the
original text that it came from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is matched whole, so the length can stand in the pattern
_WORDS = ("password", "passwd", "secret", "token", "api")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over line breaks with one indent; only the last line may be short.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+\r?\n(?:(?P<i>[ \t]*)[A-Za-z0-9+/_-]{16,}+"
                     r"(?:\r?\n(?P=i)[A-Za-z0-9+/_-]{16,}+)*(?:\r?\n(?P=i)[A-Za-z0-9+/_-]++)?|[ \t]*[A-Za-z0-9+/_-]++)={0,2}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0")
#: A compressed run that unpacks to more bytes is counted; it is scanned to its end all the same.
UNPACKED = 64 << 20
#: Unpacked bytes are scanned in blocks of about this size.
BLOCK = 4 << 20
#: Where a block may end: no secret, escape or run goes over such a byte, nor over four zeros in any UTF.
_BREAK = re.compile(rb"""[^A-Za-z0-9+/_.=:"'%\\{}\x20\t\r\n\0-]|\0{4}""")
#: Each secret and each encoded one has so many ASCII characters in a row, so other layers need no look.
_WORTH = re.compile(r"[\x20-\x7e]{8}")


def scan(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain secrets of one layer, leftmost first for each kind."""
    found = []
    low = text.lower() if (":" in text or "=" in text) else ""
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """Text with the original span of each character; None stands for the identity."""

    def __init__(self, text, start=None, end=None):
        self.text, self.start, self.end = text, start, end

    def mark(self) -> bytes:
        """Text and place, in one digest; a layer of one span is known by it."""
        h = hashlib.sha256(self.text.encode("utf-8", "surrogatepass"))
        if self.start is not None:
            one = slice(0, 1) if not self.start.strides[0] else slice(None)  # of one span
            h.update(self.start[one].astype(np.int64).tobytes() + self.end[one].astype(np.int64).tobytes())
        return h.digest()

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def replace(self, pieces: list[tuple[int, int, str]]) -> "_Layer":
        """The layer with spans replaced; all characters of a piece come from its span."""
        text, starts, ends, at = [], [], [], 0
        own = lambda a, b: ((np.arange(a, b), np.arange(a + 1, b + 1)) if self.start is None
                            else (self.start[a:b], self.end[a:b]))
        for a, b, new in pieces:
            text += [self.text[at:a], new]
            s, e = own(at, a)
            lo, hi = self.origin(a, b)
            starts += [s, np.full(len(new), lo)]
            ends += [e, np.full(len(new), hi)]
            at = b
        text.append(self.text[at:])
        s, e = own(at, len(self.text))
        return _Layer("".join(text), np.concatenate([*starts, s]), np.concatenate([*ends, e]))


def _unpack(chunks, kind: bytes):
    """Chunks of all members of a gzip, zlib, bzip2 or xz stream, as far as it is sound."""
    opener = {b"\x1f": lambda: zlib.decompressobj(31), b"\x78": zlib.decompressobj,
              b"B": bz2.BZ2Decompressor, b"\xfd": lzma.LZMADecompressor}[kind]
    now = opener()
    try:
        for data in chunks:
            while data:
                if now.eof:  # the next member, after any padding
                    data = data.lstrip(b"\0")
                    if not data.startswith(kind):
                        if data:
                            return
                        break
                    now = opener()
                if kind in b"\x1f\x78":
                    out = now.decompress(data, BLOCK)
                    data = now.unused_data if now.eof else now.unconsumed_tail
                    if out:
                        yield out
                else:
                    out = now.decompress(data, BLOCK)
                    while out:
                        yield out
                        out = b"" if now.eof or now.needs_input else now.decompress(b"", BLOCK)
                    data = now.unused_data if now.eof else b""
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return


def _opened(raw: bytes):
    """Chunks of what a compressed stream holds, through further streams right inside."""
    chunks, head, seen = iter([raw]), raw, set()
    while (m := _MAGIC.match(head)) and head not in seen:
        seen.add(head)
        chunks = _unpack(chunks, head[:1])
        head = next(chunks, b"")
        while 0 < len(head) < 16 and (more := next(chunks, b"")):
            head += more
        chunks = itertools.chain([head], chunks)
    return chunks


def _blocks(chunks):
    """The stream in blocks that cut nothing apart."""
    have = b""
    for data in chunks:
        have += data
        if len(have) >= BLOCK:
            cut = 0
            for at in (len(have) - 4096, len(have) // 2):
                cut = cut or max((m.end() for m in _BREAK.finditer(have, at)), default=0)
            if cut:
                yield have[:cut]
                have = have[cut:]
    if have:
        yield have


def _texts(raw: bytes):
    """Bytes as text, whatever they hold; with zeros also as UTF-16 and UTF-32 of either byte order."""
    ways = [("utf-8", 0)]
    if b"\0" in raw:
        ways += [("utf-16-le", 0), ("utf-16-le", 1), *(("utf-32-le", k) for k in range(4))]
    for way, k in ways:
        text = raw[k:].decode(way, "replace")
        if _WORTH.search(text):
            yield text


def _base64(token: str):
    """``(text, long)`` of all layers right inside a base64 run: its four alignments, as a word or path may stand
    before the encoded part, and compressed streams anywhere in them; *long* once for a stream over UNPACKED bytes."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    for k in range(4):
        part = body[k:len(body) - ((len(body) - k) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        for text in _texts(raw):
            yield text, 0
        at = 0
        while m := _MAGIC.search(raw, at):
            size = 0
            for block in _blocks(_opened(raw[m.start():])):
                long = size <= UNPACKED < size + len(block)
                size += len(block)
                for n, text in enumerate(_texts(block)):
                    yield text, int(long and not n)
            at = m.start() + 1


def _unicode(m: re.Match) -> str:
    code = int(m[0].strip("\\uUx{}"), 16) if m[0][1:].strip("uUx{}") else 0
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def _surrogates(text: str) -> str:
    return re.sub(r"\\u([Dd][89AaBb][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})", lambda m: chr(
        0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00), text)


_PAIR = re.compile(r"\\u[Dd][89AaBb][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|" + UNICODE.pattern)


def unwrap(layer: _Layer):
    """Layers one step further in, one at a time, each with 1 where a run passes UNPACKED bytes and 0 else."""
    text = layer.text
    if "%" in text:
        pieces = []
        for m in PERCENT.finditer(text):
            try:
                pieces.append((m.start(), m.end(), unquote_to_bytes(m[0]).decode("utf-8")))
            except UnicodeDecodeError:
                pieces.append((m.start(), m.end(), unquote_to_bytes(m[0]).decode("latin-1")))
        if pieces:
            # a run is mapped escape by escape where each escape is one character
            fine = []
            for a, b, new in pieces:
                fine += [(a + 3 * i, a + 3 * i + 3, c) for i, c in enumerate(new)] if len(new) * 3 == b - a else [(a, b, new)]
            yield layer.replace(fine), 0
    if "\\" in text:
        pieces = [(m.start(), m.end(), _surrogates(m[0]) if len(m[0]) == 12 else _unicode(m)) for m in _PAIR.finditer(text)]
        pieces = [p for p in pieces if text[p[0]:p[1]] != p[2]]
        if pieces:
            yield layer.replace(pieces), 0
    for m in itertools.chain(BASE64.finditer(text), WRAPPED.finditer(text)):
        lo, hi = layer.origin(m.start(), m.end())
        for inner, long in _base64(re.sub(r"\s+", "", m[0])):
            yield _Layer(inner, np.broadcast_to(lo, len(inner)), np.broadcast_to(hi, len(inner))), long


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans, layers opened and runs over UNPACKED; spans are ``(start, kind, end)``."""
    base = scan(text)
    first = _Layer(text)
    # the same text at another place is a layer of its own: what it holds comes from there
    spans, seen, todo, long = set(base), {first.mark()}, [unwrap(first)], 0
    while todo:
        layer, more = next(todo[-1], (None, 0))
        if layer is None:
            todo.pop()
            continue
        long += more
        mark = layer.mark()
        if mark in seen:
            continue
        seen.add(mark)
        todo.append(unwrap(layer))
        for a, kind, b in scan(layer.text):
            lo, hi = layer.origin(a, b)
            spans.add((lo, kind, hi))
    return base, sorted(spans), len(seen), long


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, "
          "n_layers int, n_too_long int")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every document: counts and spans of the plain ones, and all spans with decoded layers.

    Positions are code points of the original text; a secret of a decoded layer has the span it was
    decoded from.  One row per input row; a null text counts as empty; the id may be null; other columns
    are not read.  ``n_too_long`` counts compressed runs that unpack to over UNPACKED bytes,
    which are scanned to their end.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans, layers, long = find(text or "")
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, spell(base), spell(spans), layers, long))
            columns = [list(c) for c in zip(*rows)] or [[] for _ in range(7)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers", "n_too_long"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The registered query's columns: base spans as a SHA-256, all spans as text."""
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
                        "spans", "n_layers", "n_too_long")


def sha(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(spell(spans).encode()).hexdigest()
