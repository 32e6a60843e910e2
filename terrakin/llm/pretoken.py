"""Cutting texts into parts that byte-level BPE vocabularies with the usual word pattern
encode on their own.

The pattern never joins characters across (a) the start of a run of white space or (b) a
space followed by other than white space. A text in which no run of white space is longer
than two (one at the end) can therefore be cut at line ends and before spaces, which is done
for all bytes of many texts at once. Other texts, and those with special tokens, are cut by
the pattern itself. Equal parts are encoded once.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from terrakin.llm.arrays import binary, bytes_of

#: White space as the word pattern of these vocabularies means it.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Kinds of bytes: ASCII letters, punctuation that ends words, lead bytes whose two-byte
#: characters are all letters (U+0100 to U+023F), the lead byte of U+00C0 to U+00FF.
LETTER, TAIL, LEAD, LATIN = 1, 2, 3, 4
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[list(b".,;:!?)")] = TAIL
KIND[0xC4:0xC9], KIND[0xC3] = LEAD, LATIN


def byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use, by byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def specials(spec: dict) -> dict[bytes, int]:
    """The added tokens of a vocabulary file that is as this module cuts: byte-level BPE with
    the usual pattern, nothing normalised. Anything else raises an error."""
    pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False:
        raise ValueError("not a byte-level vocabulary with the usual word pattern")
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("a model option that is not supported is set")
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in white space or whole words are not supported")
    return {t["content"].encode(): t["id"] for t in added}


def _odd(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts are not cut at line ends and spaces alone."""
    white = (data == 32) | (data == 10)
    rare = ((data >= 9) & (data <= 13) & (data != 10)) | ((data >= 28) & (data <= 31))
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):  # the first bytes of other white space
        at = np.flatnonzero(data == lead)
        if len(at):
            b, c = (data[np.minimum(at + k, len(data) - 1)] for k in (1, 2))
            rare[at] |= {
                0xC2: (b == 0x85) | (b == 0xA0),
                0xE1: (b == 0x9A) & (c == 0x80),
                0xE2: (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F),
                0xE3: (b == 0x80) & (c == 0x80),
            }[lead]
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, np.flatnonzero(rare), side="right") - 1] = True
    threes = np.flatnonzero(white[2:] & white[1:-1] & white[:-2]) if len(data) > 2 else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, threes, side="right") - 1
    odd[text[threes + 2 < offsets[text + 1]]] = True
    two = np.flatnonzero(np.diff(offsets) >= 2)
    ends = offsets[two + 1]
    odd[two[white[ends - 1] & white[ends - 2]]] = True
    return odd


def parts(texts: pa.Array, special: dict[bytes, int]) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts, one after the other, and the part at which each text begins
    (and the number of parts)."""
    data, offsets = bytes_of(texts)
    begins = np.zeros(len(data) + 1, bool)
    begins[:-1] = (data == 32) | (data == 10)
    begins[1:] |= data == 10
    begins[offsets] = True
    odd = _odd(data, offsets)
    whole = binary(data, offsets)
    for s in special:
        odd |= pc.match_substring(whole, s).to_numpy(zero_copy_only=False)
    split = regex.compile("(" + "|".join(regex.escape(s.decode()) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
    for k in np.flatnonzero(odd):
        text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
        found: list[str] = []
        for n, piece in enumerate(split.split(text) if split else [text]):
            found += [piece] if n % 2 else PIECE.findall(piece)
        sizes = np.fromiter(map(len, found) if text.isascii() else (len(p.encode()) for p in found), np.int64, len(found))
        begins[offsets[k] : offsets[k + 1]] = False
        begins[offsets[k] + np.cumsum(sizes) - sizes] = True
    begins[len(data)] = True
    starts = np.flatnonzero(begins)
    return binary(data, starts), np.searchsorted(starts, offsets)


def pieces(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pattern's pieces of each part, one after the other, and how many each part has.
    A word of letters with punctuation behind it is cut by its bytes, others by the pattern."""
    data, offsets = bytes_of(distinct)
    n, size = len(offsets) - 1, np.diff(offsets)
    kind = KIND[data]
    pair = np.flatnonzero((kind == LEAD) | (kind == LATIN))  # two-byte letters
    after = data[np.minimum(pair + 1, len(data) - 1)]
    letter = pair[(kind[pair] == LEAD) | (after != 0x97) & (after != 0xB7)]
    kind[pair] = 0
    kind[letter], kind[np.minimum(letter + 1, len(data) - 1)] = LETTER, LETTER
    first = offsets[:-1] + (data[np.minimum(offsets[:-1], len(data) - 1)] == 32)
    letters, tails = (np.concatenate(([0], np.cumsum(kind == k))) for k in (LETTER, TAIL))
    n_letters = letters[offsets[1:]] - letters[first]
    n_tails = tails[offsets[1:]] - tails[first]
    # Letters first: the bytes from the first one are all letters up to the number of letters.
    easy = (n_letters > 0) & (n_letters + n_tails == offsets[1:] - first) & (letters[np.minimum(first + n_letters, len(data))] - letters[first] == n_letters)
    counts = np.where(easy, 1 + (n_tails > 0), 0)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins[(first + n_letters)[easy & (n_tails > 0)]] = True
    for k in np.flatnonzero(~easy):
        text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
        sizes = [len(p.encode()) for p in PIECE.findall(text)]
        counts[k] = len(sizes)
        at = offsets[k]
        for s in sizes[:-1]:
            at += s
            begins[at] = True
    return binary(data, np.flatnonzero(begins)) if n else distinct, counts


@dataclass
class Ids:
    """The ids of many texts, one after the other, and the n + 1 offsets of the texts."""

    flat: np.ndarray
    offsets: np.ndarray


def spelled(units: pa.Array, own: pa.Array, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``units`` in the order ``own`` names them, and where what begins at these
    places of that order begins in them."""
    data, offsets = bytes_of(units.take(own))
    return data, offsets[begins]


def spread(texts: pa.Array, special: dict[bytes, int], encode) -> Ids:
    """Ids of whole texts. ``encode`` maps distinct parts to their ids' bytes (unsigned 32-bit)."""
    cut, first = parts(texts, special)
    found = cut.dictionary_encode()
    data, offsets = spelled(encode(found.dictionary), found.indices, first)
    return Ids(as_ids(data), offsets // 4)


class Units:
    """The ids' bytes of parts. Parts are cut into pieces, equal pieces are encoded once, and
    those met lately are remembered. ``encode`` maps distinct pieces to (flat ids, ids of each)."""

    def __init__(self, encode, special: dict[bytes, int], size: int = 800_000):
        self.encode, self.special, self.size = encode, special, size
        self.known = self.coded = pa.array([], pa.large_binary())

    def of_pieces(self, found: pa.Array) -> pa.Array:
        at = pc.index_in(found, self.known)
        new = found.filter(pc.is_null(at))
        ids, count = self.encode(new)
        coded = binary(np.ascontiguousarray(ids, "<u4").view(np.uint8), np.concatenate(([0], np.cumsum(count * 4))))
        names, units = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.coded, coded])
        where = at.fill_null(-1).to_numpy().astype(np.int64)
        where[where < 0] = len(self.known) + np.arange(len(new))
        out = units.take(pa.array(where))
        keep = max(0, len(names) - self.size) and len(names) - self.size // 2  # past the size, the later half stays
        self.known, self.coded = names.slice(keep), units.slice(keep)
        return out

    def __call__(self, distinct: pa.Array) -> pa.Array:
        cut, n = pieces(distinct)
        once = cut.dictionary_encode()
        out = binary(*spelled(self.of_pieces(once.dictionary), once.indices, np.concatenate(([0], np.cumsum(n)))))
        for text, v in self.special.items():
            out = pc.if_else(pc.equal(distinct, pa.scalar(text, distinct.type)), pa.scalar(struct.pack("<I", v), out.type), out)
        return out


def as_ids(data: np.ndarray) -> np.ndarray:
    """Bytes as unsigned 32-bit integers."""
    return data.view("<u4") if data.ctypes.data % 4 == 0 else np.frombuffer(data.tobytes(), "<u4")


def simple(text: str) -> bool:
    """Whether cutting at line ends and spaces is exact."""
    data, offsets = bytes_of(pa.array([text]))
    return not _odd(data, offsets)[0]
