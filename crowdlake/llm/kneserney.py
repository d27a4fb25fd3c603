"""Operator 5: language-model scores from an interpolated modified Kneser-Ney bigram model.

Tokens are words after lower-casing A-Z, then one end token per text. Workers count each partition's distinct words and, in a second pass, its
distinct bigrams; what they send on are sorted runs by bucket, which Spark shuffles and tasks merge. The model is a set of
arrays in the shared folder: word hashes in ascending order (a word's id is its rank) with their counts, bigrams in ascending order of
``(context id, word id)`` with theirs, and per id the context's numbers of words seen once, twice and oftener and the word's number of distinct left neighbours.
Workers map the files into memory and look up sorted keys.

A context with a large share of all tokens has its bigrams dealt by word over buckets of their own, so no bucket grows with one word.

Defined results: null text is empty, and empty text is the end token alone; rows that repeat a ``doc_id`` count and are scored once
each; a null ``doc_id`` counts as the empty text in the fold; with nothing to learn from, every token has the uniform probability 1 of the one unknown
word. Columns other than the two that are named are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlake.session import scratch_path

from .common import map_array, materialize, text_slices, write_bytes
from .textbytes import LOWER, span_hashes, text_bytes, words

END = np.uint64(0x00E5D0FE5D0FE5D1)  # hash that stands for the end token
BEGIN_ID = np.uint64(0xFFFFFFFF)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a slice, each text's end token behind its words, and the rows' splits."""
    data, off = text_bytes(col)
    starts, ends, split = words(data, off)
    h = span_hashes(LOWER[data], starts, ends)
    return np.insert(h, split[1:], END), split + np.arange(len(split))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts by key; keys ascend."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    k, c = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(k, kind="stable")
    k, c = k[by], c[by]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(c.astype(np.uint64), at).astype(np.uint32)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run, small: differences of keys and the counts, their bytes side by side, compressed."""
    import zstandard

    d = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + d.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).ravel()
    c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8 + 8 * n).reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(d, dtype=np.uint64), c


def _runs(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray):
    """A batch of ``bucket, blob`` from sorted keys."""
    by = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[by], return_index=True)
    blobs = [_pack(keys[p], counts[p]) for p in np.split(by, at[1:])] if len(by) else []
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _merged(batches) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The merged run of each bucket of a partition; equal keys are summed as soon as enough has come."""
    held: dict[int, list] = {}
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
            runs = held.setdefault(b, [])
            runs.append(_unpack(blob.as_buffer()))
            if len(runs) > 16:
                held[b] = [_merge([k for k, _ in runs], [c for _, c in runs])]
    return {b: _merge([k for k, _ in runs], [c for _, c in runs]) for b, runs in held.items()}


def _times(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _accumulate(batches, keys_of, bucket_of, limit: int = 6_000_000):
    """Count keys over slices and hand on sorted runs whenever ``limit`` keys are held."""
    held, size = [], 0
    for batch in batches:
        for part in text_slices(batch):
            k, c = np.unique(keys_of(part), return_counts=True)
            held.append((k, c.astype(np.uint32)))
            size += len(k)
            if size > limit:
                held = [_merge([x for x, _ in held], [y for _, y in held])]
                size = len(held[0][0])
                if size > limit // 2:
                    yield _runs(*held[0], bucket_of(held[0][0]))
                    held, size = [], 0
    if held:
        k, c = _merge([x for x, _ in held], [y for _, y in held])
        yield _runs(k, c, bucket_of(k))


class Words:
    """The mapped word arrays."""

    def __init__(self, spec: dict):
        self.spec = spec
        self.shift = np.uint64(spec["shift"])
        self.base = np.array(spec["base"], np.uint64)
        self.keys = [map_array(f"{u}.key", np.uint64) if u else np.empty(0, np.uint64) for u in spec["words"]]
        self.counts = [map_array(f"{u}.cnt", np.uint32) if u else np.empty(0, np.uint32) for u in spec["words"]]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of ascending hashes; unknown words have the number of words as id, and count 0."""
        ids, counts = np.full(len(h), self.spec["V"], np.uint64), np.zeros(len(h), np.int64)
        cut = np.searchsorted(h >> self.shift, np.arange(len(self.keys) + 1, dtype=np.uint64))
        for b in range(len(self.keys)):
            lo, hi = cut[b], cut[b + 1]
            if lo < hi and len(self.keys[b]):
                at = np.searchsorted(self.keys[b], h[lo:hi])
                at[at == len(self.keys[b])] = 0
                hit = np.flatnonzero(self.keys[b][at] == h[lo:hi])
                ids[lo + hit] = self.base[b] + at[hit].astype(np.uint64)
                counts[lo + hit] = self.counts[b][at[hit]]
        return ids, counts

    def encode(self, part: pa.RecordBatch):
        """Ids and counts of all tokens of a slice, and the rows' splits."""
        h, split = tokens(part.column("text"))
        u, back = np.unique(h, return_inverse=True)
        ids, counts = self.look(u)
        return ids[back], counts[back], split


def bigrams(ids: np.ndarray, split: np.ndarray) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[split[:-1]] = BEGIN_ID
    return (before << np.uint64(32)) | ids


_cache: dict = {}


def _cached(kind, spec: dict):
    key = (kind.__name__, json.dumps(spec["words"][:2]), spec.get("tag"))
    if key not in _cache:
        _cache.clear()
        _cache[key] = kind(spec)
    return _cache[key]


def train(docs: DataFrame, text: str = "text", folder: str | None = None, buckets: int | None = None) -> dict:
    """Learn from every row. The model is a description of its files and totals."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "bigram-model")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 1 << max(2, ((buckets or parts) - 1).bit_length())  # a power of two, so that hash ranges are buckets
    shift = 64 - (n.bit_length() - 1)
    texts = docs.select(F.col(text).alias("text"))

    def count_words(batches):
        return _accumulate(batches, lambda part: tokens(part.column("text"))[0], lambda k: (k >> np.uint64(shift)).astype(np.int64))

    def store_words(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for b, (k, c) in _merged(batches).items():
            uri = f"{folder}/words-{b}-{attempt}"
            write_bytes(f"{uri}.key", k)
            write_bytes(f"{uri}.cnt", c)
            top = np.argsort(c)[-64:]
            yield pa.RecordBatch.from_pydict({"bucket": [b], "uri": [uri], "V": [len(k)], "N": [int(c.sum(dtype=np.int64))], "top": [top.tolist()], "top_n": [c[top].astype(int).tolist()]})

    runs = texts.mapInArrow(count_words, "bucket long, blob binary").repartition(n, "bucket")
    made = materialize(runs.mapInArrow(store_words, "bucket long, uri string, V long, N long, top array<long>, top_n array<long>"), "word-files")
    rows = {r["bucket"]: r for r in made.collect()}  # a row per bucket
    uris = [rows[b]["uri"] if b in rows else None for b in range(n)]
    sizes = np.array([rows[b]["V"] if b in rows else 0 for b in range(n)], np.int64)
    base = (np.cumsum(sizes) - sizes).tolist()
    V, N = int(sizes.sum()), sum(r["N"] for r in rows.values())
    spec = {"folder": folder, "shift": shift, "words": uris, "base": base, "V": V, "N": N, "tag": folder}
    if not V:
        return spec | {"bigrams": [], "left": [], "d": [0.5, 1.0, 1.5], "d1": [0.5, 1.0, 1.5], "T1": 0, "g1": 0.0}
    if V >= 1 << 32:
        raise ValueError("word ids are 32 bits wide")
    # Contexts with more than half a bucket's share of the tokens; there are fewer than 2 n of them.
    hot = np.array(sorted({base[b] + i for b, r in rows.items() for i, c in zip(r["top"], r["top_n"]) if c > N / (2 * n)} | {int(BEGIN_ID)}), np.uint64)
    width = -(-V // n)

    def deal(k):
        context, word = k >> np.uint64(32), k & BEGIN_ID
        return np.where(np.isin(context, hot), n + (word * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)).astype(np.int64), (context // np.uint64(width)).astype(np.int64))

    def count_bigrams(batches):
        model = _cached(Words, spec)

        def keys(part):
            ids, _, split = model.encode(part)
            return bigrams(ids, split)

        return _accumulate(batches, keys, deal)

    def store_bigrams(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for b, (k, c) in _merged(batches).items():
            uri = f"{folder}/bigrams-{b}-{attempt}"
            write_bytes(f"{uri}.key", k)
            write_bytes(f"{uri}.cnt", c)
            context, seen = k >> np.uint64(32), np.minimum(c, 3)
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            stats = np.stack([np.add.reduceat((seen == i).astype(np.uint32), at) for i in (1, 2, 3)], 1)
            n_ = _times(c)
            blob = None
            if b >= n:
                blob = context[at].tobytes() + stats.astype("<u4").tobytes()
            else:
                dense = np.zeros((width, 3), np.uint32)
                dense[(context[at] - np.uint64(b * width)).astype(np.int64)] = stats
                write_bytes(f"{uri}.ctx", dense)
            yield pa.RecordBatch.from_arrays([pa.array(["bigrams"]), pa.array([b]), pa.array([uri]), pa.array([[*n_, len(k)]], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                                             names=["kind", "bucket", "uri", "n", "blob"])
            w, left = np.unique(k & BEGIN_ID, return_counts=True)
            low = _runs(w, left.astype(np.uint32), (w // np.uint64(width)).astype(np.int64))
            rows_ = low.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(["left"] * rows_), low.column("bucket"), pa.nulls(rows_, pa.string()), pa.nulls(rows_, pa.list_(pa.int64())), low.column("blob")],
                                             names=["kind", "bucket", "uri", "n", "blob"])

    def store_left(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for b, (w, c) in _merged(batches).items():
            uri = f"{folder}/left-{b}-{attempt}"
            dense = np.zeros(width, np.uint32)
            dense[(w - np.uint64(b * width)).astype(np.int64)] = c
            write_bytes(uri, dense)
            yield pa.RecordBatch.from_pydict({"bucket": [b], "uri": [uri], "n": [[*_times(c), int((c >= 3).sum()), int(c.sum(dtype=np.int64))]]})

    runs = texts.mapInArrow(count_bigrams, "bucket long, blob binary").repartition(n, "bucket")
    made = materialize(runs.mapInArrow(store_bigrams, "kind string, bucket long, uri string, n array<long>, blob binary"), "bigram-files")
    left = made.where("kind = 'left'").select("bucket", "blob").repartition(n, "bucket")
    left = materialize(left.mapInArrow(store_left, "bucket long, uri string, n array<long>"), "left-files")
    grams = made.where("kind = 'bigrams'").select("bucket", "uri", "n", "blob").collect()  # a row per bucket; blobs: the hot contexts' numbers
    lefts = left.collect()
    stats: dict[int, np.ndarray] = {}
    for r in grams:
        if r["blob"] is not None:
            m = len(r["blob"]) // 20
            for u, s in zip(np.frombuffer(r["blob"], np.uint64, m).tolist(), np.frombuffer(r["blob"], "<u4", 3 * m, 8 * m).reshape(-1, 3).astype(np.int64)):
                stats[u] = stats.get(u, 0) + s
    times = np.sum([r["n"] for r in grams], 0)
    low = np.sum([r["n"] for r in lefts], 0)
    d1 = discounts(low[:4])
    return spec | {"bigrams": [(r["bucket"], r["uri"]) for r in grams], "left": [(r["bucket"], r["uri"]) for r in lefts], "n": n, "width": width,
                   "hot": {int(u): [int(x) for x in s] for u, s in stats.items()}, "d": discounts(times[:4]), "d1": d1, "T1": int(low[5]),
                   "g1": float(d1[0] * low[0] + d1[1] * low[1] + d1[2] * low[4])}


def discounts(n) -> list[float]:
    """The three modified Kneser-Ney discounts from the numbers of grams seen one to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [float(np.clip(x, 0.05, i + 0.95)) for i, x in enumerate(d)]


class Model(Words):
    """The mapped arrays of the whole model."""

    def __init__(self, spec: dict):
        super().__init__(spec)
        self.grams = {b: (map_array(f"{u}.key", np.uint64), map_array(f"{u}.cnt", np.uint32)) for b, u in spec["bigrams"]}
        self.contexts = {b: map_array(f"{u}.ctx", np.uint32).reshape(-1, 3) for b, u in spec["bigrams"] if b < spec.get("n", 0)}
        self.left = {b: map_array(u, np.uint32) for b, u in spec["left"]}
        self.hot = {int(u): s for u, s in spec.get("hot", {}).items()}

    def _by_range(self, arrays: dict, ids: np.ndarray, shape=()) -> np.ndarray:
        """Rows of dense arrays by ascending id; zeros where there is none."""
        out = np.zeros((len(ids), *shape), np.int64)
        width = self.spec["width"]
        cut = np.searchsorted(ids, np.arange(self.spec["n"] + 1, dtype=np.uint64) * np.uint64(width))
        for b, a in arrays.items():
            lo, hi = cut[b], cut[b + 1]
            if lo < hi:
                out[lo:hi] = a[(ids[lo:hi] - np.uint64(b * width)).astype(np.int64)]
        return out

    def gram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending bigram keys."""
        out = np.zeros(len(keys), np.int64)
        context, word = keys >> np.uint64(32), keys & BEGIN_ID
        hot = np.isin(context, np.array(sorted(self.hot), np.uint64))
        bucket = np.where(hot, self.spec["n"] + (word * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64), (context // np.uint64(self.spec["width"])).astype(np.int64))
        by = np.argsort(bucket, kind="stable")
        names, at = np.unique(bucket[by], return_index=True)
        for b, p in zip(names.tolist(), np.split(by, at[1:])):
            if b in self.grams:
                k, c = self.grams[b]
                i = np.searchsorted(k, keys[p])
                i[i == len(k)] = 0
                hit = k[i] == keys[p]
                out[p[hit]] = c[i[hit]]
        return out

    def log10(self, ids: np.ndarray, counts: np.ndarray, split: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        s = self.spec
        V = s["V"]
        if not V:
            return np.zeros(len(ids))
        keys, back = np.unique(bigrams(ids, split), return_inverse=True)
        context, word = keys >> np.uint64(32), keys & BEGIN_ID
        w, wb = np.unique(word, return_inverse=True)
        d1 = np.array([0.0, *s["d1"]])
        left = self._by_range(self.left, w)
        low = ((left - d1[np.minimum(left, 3)]) + s["g1"] / (V + 1)) / s["T1"]
        u = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        ub = np.cumsum(np.concatenate([[0], context[1:] != context[:-1]])).astype(np.int64)
        names = context[u]
        stat = self._by_range(self.contexts, names, (3,))
        for i in np.flatnonzero(np.isin(names, np.array(sorted(self.hot), np.uint64))):
            stat[i] = self.hot[int(names[i])]
        total = self._totals(names)
        d = np.array([0.0, *s["d"]])
        known = total > 0
        gamma = np.where(known, stat @ d[1:] / np.maximum(total, 1), 1.0)
        c = self.gram_counts(keys)
        p = np.where(known[ub], (c - d[np.minimum(c, 3)]) / np.maximum(total, 1)[ub], 0.0) + gamma[ub] * low[wb]
        return np.log10(p)[back]

    def _totals(self, contexts: np.ndarray) -> np.ndarray:
        """How often each context was followed by a token: a word's count; for the begin of a text the number of texts."""
        out = np.zeros(len(contexts), np.int64)
        starts = np.append(self.base, np.uint64(self.spec["V"]))
        cut = np.searchsorted(contexts, starts)
        for b in range(len(self.keys)):
            lo, hi = cut[b], cut[b + 1]
            if lo < hi:
                out[lo:hi] = self.counts[b][(contexts[lo:hi] - self.base[b]).astype(np.int64)]
        if len(contexts) and contexts[-1] == BEGIN_ID:
            out[-1] = self.look(np.array([END]))[1][0]
        return out


def score(docs: DataFrame, spec: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one unigram), ``score`` and ``perplexity``."""
    def run(batches):
        model = _cached(Model, spec)
        N, V = spec["N"], spec["V"]
        for batch in batches:
            for part in text_slices(batch):
                ids, counts, split = model.encode(part)
                at = split[:-1]
                n = np.diff(split)
                base = np.add.reduceat(np.log10((counts + 1) / (N + V + 1)), at)
                lp = np.add.reduceat(model.log10(ids, counts, split), at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n), pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)), pa.array(np.full(len(n), N, np.int64)),
                                                  pa.array(base), pa.array(lp), pa.array(10.0 ** np.minimum(-lp / n, 300))],
                                                 names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    types = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 7; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2
