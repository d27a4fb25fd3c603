"""Token ids of whole texts from the ``tokenizers`` library, with repeated pieces encoded once.

A text is cut into pieces at places where the tokenizer's own pre-tokenizer always cuts, so
the ids of a text are the ids of its pieces in order. The library encodes each piece; pieces seen before
come from a bounded memo. Cuts are made before white space that follows a character other than white
space, and before one of ``.,;:!?`` that follows an ASCII or Latin-1 letter. Neither falls inside an added token
(checked when the tokenizer is loaded) and no pre-token spans either. Every other text shape (runs of blanks,
combining marks, added tokens inside words) stays within one piece and is left to the library.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa

from .textbytes import LOWER, text_bytes

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0x80:] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
#: White space outside ASCII.
_SPACES = [c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_LEAD = np.zeros(256, bool)
_LEAD[[s[0] for s in _SPACES]] = True


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets at which pieces start: the rows' own offsets and the safe cuts between."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[1:n] = (_BLANK[data[1:]] & _SOLID[data[:-1]]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
        pair = np.flatnonzero((data[:-2] == 0xC3) & _MARK[data[2:]])  # a Latin-1 letter of two bytes, then a mark
        cut[pair[(data[pair + 1] != 0x97) & (data[pair + 1] != 0xB7)] + 2] = True
        lead = np.flatnonzero(_LEAD[data])
        for s in _SPACES if len(lead) else ():  # a blank after one of these goes on with a run of white space
            hit = lead[lead + len(s) <= n]
            for j, c in enumerate(s):
                hit = hit[data[hit + j] == c]
            cut[hit + len(s)] = False
    cut[off] = True
    cut[n] = False
    return np.flatnonzero(cut)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself, or one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(odd)}


class Encoder:
    """Encodes slices of texts; ``memo`` bounds the pieces remembered.

    A piece that is one word of ASCII or Latin-1 letters, behind at most one blank, is a single pre-token that the
    normaliser leaves as it is, so it goes straight to the library's BPE model; any other piece takes
    the library's whole way.
    """

    def __init__(self, path: str, memo: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        for t in spec.get("added_tokens") or []:
            if any(c.isspace() or c in ".,;:!?" for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"added token {t['content']!r} could span a cut")
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        norm = spec.get("normalizer") or {}
        self.lower = any(k.get("type") == "Lowercase" for k in norm.get("normalizers", [norm]))
        self.model = self.tok.model
        code = _byte_letters()
        self.chars = {c: "".join(code[b] for b in chr(c).encode()) for c in range(0x100)}
        self.memo, self.known = memo, {}

    def _may_hold_added(self, data: np.ndarray) -> bool:
        raw = data.tobytes().lower()
        return any(t.lower() in raw for t in self.added)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        out = list(map(self.known.get, pieces))
        rest = []
        tokenize, chars, known = self.model.tokenize, self.chars, self.known
        if len(known) > self.memo:
            known.clear()
        for i in [i for i, v in enumerate(out) if v is None]:
            p = pieces[i]
            if self.lower:
                w, blank = p.strip(" \n\t\r").lower(), ""
            else:
                w, blank = (p[1:], self.chars[32]) if p[0] == " " else (p, "")
            if w.isalpha() and (w.isascii() or max(w) < "\u0100"):
                toks = tokenize(blank + (w if w.isascii() else w.translate(chars)))
                out[i] = known[p] = array("I", [t.id for t in toks]).tobytes()
            else:
                rest.append(i)
        for lo in range(0, len(rest), 20_000):
            part = rest[lo: lo + 20_000]
            for i, e in zip(part, self.tok.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
                if len(pieces[i]) < 64:
                    known[pieces[i]] = out[i]
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts as uint32, and the rows' splits. Null counts as empty."""
        data, off = text_bytes(col)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        if self.lower and not self._may_hold_added(data):
            data = LOWER[data]  # what the normaliser would do first to these letters
        starts = piece_starts(data, off)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        blobs = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lens = np.fromiter((len(b) >> 2 for b in blobs), np.int64, len(blobs))
        flat = np.frombuffer(b"".join(blobs), np.uint32)
        first = np.cumsum(lens) - lens
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = lens[which]
        ends = np.cumsum(n)
        total = int(ends[-1])
        ids = flat[np.repeat(first[which] - (ends - n), n) + np.arange(total)]
        upto = np.concatenate([[0], ends])
        return ids, upto[np.searchsorted(starts, off)]


_encoders: dict = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def end_with(ids: np.ndarray, splits: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` behind each row's ids."""
    return np.insert(ids, splits[1:], end_id), splits + np.arange(len(splits))
