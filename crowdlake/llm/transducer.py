"""Operator 7: token counts by a finite-state transducer compiled from a byte-pair tokenizer.

The merges are compiled into a deterministic transducer over bytes and one mark for a word's end. Its theory: a token sequence
is the tokenizer's output exactly if every token comes out whole and every two neighbours stay apart when their text is encoded; so the
last token of every prefix of a word is unique, and what the rest of the word can still do depends only on the last tokens at the
few places where a longer token could have begun. A state is that: for each such place the token that ends there, the trie node
of what follows, and how many tokens it is ahead or behind. Each transition carries the change of the token count. Transitions
are compiled when a text first needs them and kept in tables; if the tables pass ``STATES`` they are compiled anew.

A text is a run of words, each followed by its end mark, cut into chunks of ``CHUNK`` symbols. Every word end leads to the start state, so a
chunk's map from entry state to (exit state, count) is a constant behind its first word end, and all chunks of a slice step through
that part side by side from the start state. The heads before it are evaluated for the entry states that the scan over chunks
hands on, again side by side; chunks inside one long word hand on one after the other. Counts are added by a prefix sum.

Defined results: null and empty texts have no tokens; special tokens in a text count as the library counts them; repeated rows each get a row; an empty table
gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices
from .textbytes import text_bytes

CHUNK, STATES = 192, 400_000
END = 256


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character: itself, or one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(odd)}


#: The word pattern and normaliser that this transducer knows (fixed values of the tokenizer file's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = ["NFC", "Replace", "Lowercase"]


class Transducer:
    """The table: by state and symbol column, the next state times 256 plus the count's change plus 128; -1 where not compiled yet."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        split = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if not suffix or split != [PATTERN] or [x["type"] for x in spec["normalizer"]["normalizers"]] != NORMALIZER:
            raise ValueError("only tokenizers with word ends, this word pattern and this normaliser can be compiled")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        code = _byte_of()

        def symbols(token: str) -> tuple:
            """A token as initial symbols: bytes, the last one marked (+256) if it ends a word."""
            body, last = (token[: -len(suffix)], True) if suffix and token.endswith(suffix) else (token, False)
            out = [code[c] for c in body]
            if last and out:
                out[-1] += 256
            return tuple(out)

        self.rank, self.merged = {}, {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (symbols(a), symbols(b))
            self.rank.setdefault(pair, r)
        self.suffix = suffix
        made = {a + b for a, b in self.rank} | {(b,) for b in range(256)} | ({(b + 256,) for b in range(256)} if suffix else set())
        self._whole: dict = {}
        self._apart: dict = {}
        # Trie over bytes with the end mark as a symbol of its own; node 0 is the empty string.
        self.child: list[dict] = [{}]
        self.token: list = [None]
        for t in made:
            if len(self.encode(t)) == 1:
                node = 0
                for s in [x & 255 for x in t] + ([END] if t[-1] >= 256 else []):
                    nxt = self.child[node].get(s)
                    if nxt is None:
                        nxt = self.child[node][s] = len(self.child)
                        self.child.append({})
                        self.token.append(None)
                    node = nxt
                self.token[node] = t
        self.reset()

    def encode(self, symbols: tuple) -> list:
        """Plain byte-pair encoding of initial symbols: the pair of lowest rank merges first, the leftmost among equals."""
        parts = [(s,) for s in symbols]
        while len(parts) > 1:
            best, at = min(((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            pair = (parts[at], parts[at + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def apart(self, a, b) -> bool:
        """Whether ``a`` and ``b`` stay two tokens when they meet."""
        if a is None:
            return True
        key = (a, b)
        v = self._apart.get(key)
        if v is None:
            v = self._apart[key] = self.encode(a + b) == [a, b]
        return v

    def reset(self) -> None:
        start = ((None, 0, 0),)
        self.keys, self.states = {start: 0}, [start]
        self.column = np.full(257, -1, np.int64)
        self.columns, self.symbol = 0, []
        self.table = np.full((4096, 64), -1, np.int32)

    def columns_of(self, symbols: np.ndarray) -> np.ndarray:
        """The table's columns of symbols; new symbols get one."""
        for x in np.flatnonzero((np.bincount(symbols, minlength=257) > 0) & (self.column < 0)).tolist():
            if self.columns == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full((len(self.table), 32), -1, np.int32)], 1)
            self.column[x] = self.columns
            self.symbol.append(x)
            self.columns += 1
        return self.column[symbols]

    def compile(self, state: int, symbol: int) -> None:
        """Add one transition."""
        places = []
        whole = None
        for last, node, ahead in self.states[state]:
            nxt = self.child[node].get(symbol)
            if nxt is None:
                continue
            t = self.token[nxt]
            if t is not None and whole is None and self.apart(last, t):
                whole = (t, ahead + 1)
            if self.child[nxt]:
                places.append((last, nxt, ahead))
        token, count = whole
        if symbol == END:
            target = 0
        else:
            places.append((token, 0, count))
            key = tuple((last, node, ahead - count) for last, node, ahead in places)
            target = self.keys.get(key)
            if target is None:
                target = self.keys[key] = len(self.states)
                self.states.append(key)
                if target == len(self.table):
                    self.table = np.concatenate([self.table, np.full((target // 2, self.table.shape[1]), -1, np.int32)])
        self.table[state, self.column[symbol]] = target * 256 + count + 128

    def step(self, state: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One symbol for many runs at once: next states and changes of the count."""
        v = self.table[state, col]
        miss = np.flatnonzero(v < 0)
        if len(miss):
            for k in np.unique(state[miss] * 512 + col[miss]).tolist():
                self.compile(k // 512, self.symbol[k % 512])
            v[miss] = self.table[state[miss], col[miss]]
        return (v >> 8).astype(np.int64), (v & 255) - 128

    def changes(self, stream: np.ndarray) -> np.ndarray:
        """The count's change at each symbol of a stream of whole words with their end marks."""
        n = len(stream)
        if len(self.states) > STATES:
            self.reset()
        chunks = -(-n // CHUNK)
        col = np.full(chunks * CHUNK, -1, np.int64)
        col[:n] = self.columns_of(stream)
        ends = np.flatnonzero(stream == END)
        length = np.full(chunks, CHUNK)
        length[-1] = n - (chunks - 1) * CHUNK
        at = np.arange(chunks) * CHUNK
        k = np.minimum(np.searchsorted(ends, at), len(ends) - 1)
        first = np.where((ends[k] >= at) & (ends[k] < at + length), ends[k] - at, CHUNK)  # the first word end
        out = np.zeros(chunks * CHUNK, np.int64)
        exit_ = np.full(chunks, -1, np.int64)
        # Behind the first word end the entry state does not matter: all chunks side by side, joining as their word ends come.
        by = np.argsort(first, kind="stable")
        joins = np.searchsorted(first[by], np.arange(CHUNK))
        state = np.zeros(chunks, np.int64)
        for j in range(CHUNK):
            run = by[: joins[j]]
            run = run[length[run] > j] if j >= length[-1] else run
            if len(run):
                p = at[run] + j
                state[run], out[p] = self.step(state[run], col[p])
        known = first < CHUNK
        exit_[known] = state[known]
        # Heads, for the entry states that the scan hands on; a chunk without a word end hands its own exit state on.
        wave = np.flatnonzero(np.concatenate([[True], known[:-1]]))
        while len(wave):
            state = np.where(wave > 0, exit_[wave - 1], 0)
            most = np.minimum(first[wave], length[wave] - 1)
            by = np.argsort(-most, kind="stable")
            lasts = np.searchsorted(-most[by], -np.arange(CHUNK), "right")
            for j in range(int(most.max()) + 1):
                run = by[: lasts[j]]
                p = at[wave[run]] + j
                state[run], out[p] = self.step(state[run], col[p])
            exit_[wave[~known[wave]]] = state[~known[wave]]
            wave = wave[~known[wave]] + 1
            wave = wave[wave < chunks]
        return out[:n]


_classes: list = []
SPACE, LETTER, NUMBER, OTHER = range(4)


def _class_table() -> np.ndarray:
    if not _classes:
        t = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            if c == "L":
                t[i] = LETTER
            elif c == "N":
                t[i] = NUMBER
        t[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _classes.append(t)
    return _classes[0]


def _normal(s: str) -> str:
    """NFC, then each character's lower case."""
    if s.isascii():
        return s.lower()
    if not unicodedata.is_normalized("NFC", s):
        s = unicodedata.normalize("NFC", s)
    return s.replace("\u03a3", "\u03c3").lower()


def word_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of normalised texts as bytes with an end mark behind each word, and the rows' splits of that stream."""
    rows = [_normal(s) for s in texts]
    text = "".join(rows)
    if not text:
        return np.empty(0, np.int64), np.zeros(len(rows) + 1, np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32) if len(raw) != len(text) else raw
    n = len(cp)
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    kind = _class_table()[cp]
    edge = np.zeros(n + 4, bool)
    edge[off] = True
    start = np.zeros(n + 4, bool)
    start[:n] = kind != SPACE
    start[1:n] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | edge[1:n]
    # An apostrophe that starts a word takes one of these endings along.
    mark = np.flatnonzero((cp == 0x27) & start[:n])
    pad = np.concatenate([cp, np.zeros(4, cp.dtype)])
    one, two = pad[mark + 1], pad[mark + 2]
    inside = ~edge[mark + 1]
    short = inside & np.isin(one, [ord(c) for c in "stmd"])
    pairs = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]
    long = inside & ~edge[mark + 2] & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
    solid = np.concatenate([kind != SPACE, np.zeros(4, bool)])
    for which, k in ((short, 2), (long, 3)):
        m = mark[which]
        for i in range(1, k):
            start[m + i] = False
        start[m + k] = solid[m + k]
    start = start[:n]
    if len(raw) != n:  # from characters to bytes
        head = np.flatnonzero((raw & 0xC0) != 0x80)
        wide = np.diff(np.append(head, len(raw)))
        keep = np.repeat(kind != SPACE, wide)
        first = np.zeros(len(raw), bool)
        first[head[start]] = True
        off = np.append(head, len(raw))[off]
    else:
        keep, first = kind != SPACE, start
    kept = np.concatenate([[0], np.cumsum(keep)])
    begins = kept[np.flatnonzero(first)]
    if not len(begins):
        return np.empty(0, np.int64), np.zeros(len(rows) + 1, np.int64)
    stream = np.insert(np.append(raw[keep].astype(np.int64), END), begins[1:], END)
    words_before = np.concatenate([[0], np.cumsum(first)])[off]
    return stream, kept[off] + words_before


_transducers: dict = {}


def transducer(path: str) -> Transducer:
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def counts(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    t = transducer(path)
    parts, row, extra = texts, np.arange(len(texts)), np.zeros(len(texts), np.int64)
    if any(a in s for a in t.added for s in texts):
        import re

        cut = re.compile("|".join(map(re.escape, t.added)))
        pieces = [cut.split(s) for s in texts]
        extra = np.array([len(p) - 1 for p in pieces], np.int64)
        row = np.repeat(row, extra + 1)
        parts = [x for p in pieces for x in p]
    stream, split = word_stream(parts)
    total = np.concatenate([[0], np.cumsum(t.changes(stream))]) if len(stream) else np.zeros(1, np.int64)
    return np.bincount(row, np.diff(total[split]), len(texts)).astype(np.int64) + extra


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                col = part.column("text").fill_null("")
                n = counts(col.to_pylist(), path)
                _, off = text_bytes(col)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)],
                                                 names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
