"""Tokenizing with public vocabulary files: exact byte ends of tokens, every different piece of text encoded once.

A text is cut before blanks that both kinds of tokenizer always cut at.  The pieces repeat a lot, so callers number them and
encode each new one a single time, many joined in one call; a text is then a list of numbers.  With a vocabulary that may
join across blanks the pieces are whole texts instead.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from tokenizers import Tokenizer

#: Pieces that are not joined in one call.
SINGLES = 256
#: A text where a cut before every blank could part a run of white space goes by this pattern instead.
_ODD = r"[\s\v\x1c-\x1f\x{85}\p{Z}] [\s\v\x1c-\x1f\x{85}\p{Z}]| \z"
_PIECE = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")


def default_path(name: str) -> str:
    """A vocabulary file of the installed package of public tokenizers; any other path serves as well."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def byte_ends(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from their spans (in bytes, cut at characters) and the lengths of their decoded bytes.

    The spans are coarse cuts: one holds if it is not empty and the next token begins behind it.  Tokens that share a
    character, or are bytes of one, have no such cut and are placed from the last one by their own bytes.
    """
    if not len(end):
        return end.astype(np.int64)
    holds = (end > begin) & np.append(begin[1:] >= end[:-1], True)
    total = np.cumsum(size)
    at = np.where(holds, np.arange(len(end)), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]])
    base = np.where(last >= 0, end[last] - total[last], 0)
    return np.where(holds, end, base + total)


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library."""

    #: Bytes of a block of joined pieces and blocks a call; this library is fastest with short texts, the other with long ones.
    block, together = 1 << 12, 64

    def __init__(self, path: str, special_as_text: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        alphabet, vocab = _byte_alphabet(), self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        added = {t.content for t in self.model.get_added_tokens_decoder().values()}
        for piece, n in vocab.items():
            self.bytes[n] = piece.encode() if piece in added else bytes(alphabet[c] for c in piece)
        self.size = np.array([len(b) for b in self.bytes], dtype=np.int64)
        pre = self.model.pre_tokenizer
        self.cuts_at_blanks = self.model.normalizer is None and "ByteLevel" in repr(pre) and "use_regex=True" in repr(pre)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and byte ends by the character offsets of the encodings."""
        out = []
        for text, e in zip(texts, self.model.encode_batch(texts, add_special_tokens=False)):
            code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            byte_at = np.concatenate([[0], np.cumsum(width)])
            ids = np.array(e.ids, dtype=np.uint32)
            at = byte_at[np.fromiter(itertools.chain.from_iterable(e.offsets), dtype=np.int64, count=2 * len(ids))]
            out.append((ids, byte_ends(at[::2], at[1::2], self.size[ids])))
        return out


class Pieces:
    """A sentencepiece model with byte fallback that puts a blank before each text."""

    block, together = 1 << 16, 1

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(names)]
        self.size = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.cuts_at_blanks = not any(re.search("[^▁]▁", p) for p in names)

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and byte ends of texts that start with a blank, by the byte spans of the protos."""
        out = []
        for proto in self.model.encode([t[1:] for t in texts], return_type="proto", num_threads=1):
            found = list(proto.pieces)
            ids = np.array([p.id for p in found], dtype=np.uint32)
            end = np.array([p.end for p in found], dtype=np.int64) + 1
            begin = np.concatenate([[0], end[:-1]])            # spans follow each other; the first holds the added blank
            out.append((ids, byte_ends(begin, end, self.size[ids])))
        return out


@functools.lru_cache(maxsize=4)
def byte_level(path: str, special_as_text: bool) -> ByteLevel:
    return ByteLevel(path, special_as_text)


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _joinable(texts: list[str]) -> np.ndarray:
    """Which pieces start with a blank and show other characters at both ends; U+2581 stands for a blank in some models."""
    a = pa.array(texts, pa.string())
    rest = pc.utf8_slice_codeunits(a, 1)
    good = pc.and_(pc.and_(pc.starts_with(a, " "), pc.equal(pc.utf8_trim_whitespace(rest), rest)),
                   pc.and_(pc.greater(pc.binary_length(rest), 0), pc.invert(pc.match_substring(a, "▁"))))
    return good.to_numpy(zero_copy_only=False)


def encode_each(texts: list[str], call, vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ids, ends, counts, ok`` of many pieces, flat: ids and byte ends from the piece's start, tokens a piece.

    *call* gives ids and ends of a list of texts.  Pieces that start with a blank and show other characters at both
    ends go joined; a block whose tokens do not end with its pieces, and all other pieces, go one by one.  A piece
    whose decoded bytes are not its own is not *ok* and has no tokens.
    """
    order, counts, flat_ids, flat_ends = [], [], [], []
    joinable = _joinable(texts)
    single = np.flatnonzero(~joinable).tolist()

    def keep(members, ids, ends, count):
        order.append(members)
        counts.append(count)
        flat_ids.append(ids)
        flat_ends.append(ends)

    length = pc.binary_length(pa.array(texts, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    blocks = _blocks(np.flatnonzero(joinable), length, vocabulary.block)
    for lo in range(0, len(blocks), vocabulary.together):       # some blocks at a time: encodings are large while they live
        some = ["".join([texts[i] for i in m.tolist()]) for m in blocks[lo:lo + vocabulary.together]]
        for members, text, (ids, ends) in zip(blocks[lo:], some, call(some)):
            stop = np.cumsum(length[members])
            cut = np.searchsorted(ends, stop)
            if not len(ends) or _joined(vocabulary, ids) != text.encode() or (ends[np.minimum(cut, len(ends) - 1)] != stop).any():
                single += members.tolist()
                continue
            count = np.diff(cut + 1, prepend=0)
            keep(members, ids, ends - np.repeat(np.concatenate([[0], stop[:-1]]), count), count)
    ok = np.ones(len(texts), dtype=bool)
    for lo in range(0, len(single), SINGLES):
        some = single[lo:lo + SINGLES]
        for i, (ids, ends) in zip(some, call([texts[i] for i in some])):
            ok[i] = _joined(vocabulary, ids) == texts[i].encode()
            n = len(ids) if ok[i] else 0
            keep(np.array([i]), ids[:n], ends[:n], np.array([n]))
    counts = np.concatenate([np.zeros(0, dtype=np.int64), *counts])
    flat_ids = np.concatenate([np.zeros(0, dtype=np.uint32), *flat_ids])
    flat_ends = np.concatenate([np.zeros(0, dtype=np.int64), *flat_ends])
    back = np.empty(len(texts), dtype=np.int64)
    back[np.concatenate([np.zeros(0, dtype=np.int64), *order])] = np.arange(len(texts))
    at = spread(back, np.cumsum(counts) - counts, counts)
    return flat_ids[at], flat_ends[at], counts[back], ok


def _joined(vocabulary, ids: np.ndarray) -> bytes:
    return b"".join([vocabulary.bytes[n] for n in ids.tolist()])


def _blocks(at: np.ndarray, length: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of joinable texts, about *size* bytes together."""
    part = np.cumsum(length[at]) // size
    return np.split(at, np.flatnonzero(np.diff(part)) + 1) if len(at) else []


def split(texts: pa.Array, leading: bool, cut: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts as numbers of their pieces: ``numbers, ends, pieces``, *ends* by text; few pieces come twice.

    With *leading* a blank is put before each text, so that all pieces start with one; without it, the first
    piece of a text is as it stands.  Without *cut* each text is one piece.
    """
    plain = texts.cast(pa.string())
    odd = pc.or_(pc.match_substring(plain, "  "), pc.or_(pc.starts_with(plain, " "), pc.match_substring_regex(plain, _ODD)))
    odd = odd.to_numpy(zero_copy_only=False) if cut else np.ones(len(plain), dtype=bool)
    count = np.zeros(len(plain), dtype=np.int64)
    lists = pc.split_pattern(plain.filter(pa.array(~odd)), pattern=" ")
    coded = lists.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = [" " + n for n in coded.dictionary.to_pylist()]
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    count[~odd] = sizes
    if not leading and len(sizes):
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        whole, numbers[first] = [names[n][1:] for n in numbers[first].tolist()], len(names) + np.arange(len(first))
        names += whole
    if not odd.any():
        return numbers, np.cumsum(count), names
    found = []
    for text in plain.filter(pa.array(odd)).to_pylist():
        text = " " + text if leading else text
        own = _PIECE.findall(text) if cut else [text]
        if len(own) > 1 and own[-1] == " ":                     # a lone blank is nothing to a model that adds one itself
            own[-2:] = [own[-2] + " "]
        found.append(own)
    count[odd] = [len(own) for own in found]
    number_of: dict[str, int] = {}
    slow = np.array([number_of.setdefault(p, len(number_of)) for own in found for p in own], dtype=np.int64) + len(names)
    out = np.empty(int(count.sum()), dtype=np.int64)
    of_odd = np.repeat(odd, count)
    out[of_odd], out[~of_odd] = slow, numbers
    return out, np.cumsum(count), names + list(number_of)


def spread(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all entries of the runs that *numbers* names, in order."""
    length = sizes[numbers]
    return np.repeat(starts[numbers] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
