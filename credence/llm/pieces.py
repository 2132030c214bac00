"""Encoding by pieces: texts are cut where no token can reach across, and equal pieces are encoded once.

A text is cut before a run of ASCII white space that follows a character which is surely no white space,
and between an ASCII letter and one of ``.,;:!?``. Both tokenizers used here split there by themselves:
none of their patterns matches across such a place, and what follows it does not look back. So the ids
of a text are its pieces' ids in order.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: Pieces that one Python worker remembers, and about how many bytes they and their ids may have. Workers are reused, so they
#: hold this through all later stages of a session too.
CACHE_PIECES, CACHE_BYTES = 250_000, 40 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A mask of the positions before which a text may be cut; row starts count as cuts."""
    n = len(data)
    ok = np.zeros(n, bool)
    if n == 0:
        return ok
    space = _SPACE[data]
    # a run of white space begins; the character before it must not be (possibly) white space itself
    ok[1:] = space[1:] & ~space[:-1]
    prev = data[:-1]
    odd = (prev >= 28) & (prev <= 31)
    two = np.zeros(n - 1, bool)
    two[1:] = (data[:-2] == 0xC2) & ((prev[1:] == 0x85) | (prev[1:] == 0xA0))
    three = np.zeros(n - 1, bool)
    three[2:] = (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (prev[2:] >= 0x80) & (prev[2:] <= 0xBF)
    ok[1:] &= ~(odd | two | three)
    ok[1:] |= _LETTER[prev] & _STOP[data[1:]]
    ok[offsets[:-1][offsets[:-1] < n]] = True
    return ok


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = byte_letters()
#: Pieces that may be one word of Latin letters; whether they are is asked of the letters themselves.
_WORD = re.compile(rb"[ \n]?(?:[A-Za-z]|[\xC3-\xC8][\x80-\xBF])+\Z")


class Encoder:
    """Ids of pieces, each distinct piece encoded once per worker while the cache holds it.

    A piece that is one word of Latin letters, with at most a space before it, passes normalizer and pre-tokenizer
    unchanged, so it goes to the library's model at once."""

    def __init__(self, path: str, most_pieces: int | None = None, most_bytes: int | None = None):
        self.most_pieces, self.most_bytes = most_pieces or CACHE_PIECES, most_bytes or CACHE_BYTES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        with open(path) as f:
            file = json.load(f)
        pre = json.dumps(file.get("pre_tokenizer") or {})
        kinds = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
        self.drops_space = "Lowercase" in kinds and "\\\\p{L}" in pre and '"ByteLevel"' in pre
        self.keeps_space = file.get("normalizer") is None and (file.get("pre_tokenizer") or {}).get("type") == "ByteLevel"

    def word(self, piece: bytes) -> str | None:
        """What the model sees of a piece that is one word, else None."""
        bare = piece[1:] if piece[:1] in (b" ", b"\n") else piece
        if bare.isalpha():  # of bytes: A-Z and a-z, which stand for themselves
            if self.drops_space:
                return bare.decode() if bare.islower() else None
            return None if not self.keeps_space or piece[0] == 10 else ("\u0120" if piece[0] == 32 else "") + bare.decode()
        if not _WORD.match(piece):
            return None
        text = piece.decode()
        if self.drops_space:
            text = text.lstrip(" \n")
            if not text.isalpha() or text != text.lower():
                return None
        elif not self.keeps_space or piece[0] == 10 or not text.lstrip(" ").isalpha():
            return None
        return text.encode().decode("latin-1").translate(_LETTERS)

    def lookup(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each piece as uint32 bytes."""
        known = self.known
        found = list(map(known.get, distinct))
        new = [p for p, x in zip(distinct, found) if x is None]
        if not new:
            return found
        self.held += sum(map(len, new)) * 3 + 130 * len(new)
        if len(known) + len(new) > self.most_pieces or self.held > self.most_bytes:
            keep = {p: x for p, x in zip(distinct, found) if x is not None}
            known.clear()
            known.update(keep)
            self.held = 0
        model, other = self.tokenizer.model.tokenize, []
        for p in new:
            seen = self.word(p)
            if seen is None:
                other.append(p)
            else:
                known[p] = array("I", [t.id for t in model(seen)]).tobytes()
        for k in range(0, len(other), 20_000):
            part = other[k : k + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in part], add_special_tokens=False)):
                known[p] = array("I", e.ids).tobytes()
        return [known[p] for p in distinct]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces between ``bounds`` and the number of ids before each piece."""
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        cuts = np.ascontiguousarray(bounds, np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        ids = pa.array(self.lookup(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        _, ends, flat = ids.buffers()
        before = np.frombuffer(ends, np.int64)[: len(ids) + 1] // 4
        return np.frombuffer(flat or b"", np.uint32)[: before[-1]].copy(), before


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, most_pieces: int | None = None, most_bytes: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file (and bounds of its cache); workers are reused, so files load once."""
    key = (path, most_pieces, most_bytes)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
