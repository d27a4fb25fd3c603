"""Ranked lexical search with exact skipping of blocks (operator 12).

Terms are the maximal runs of letters, digits and characters from U+0080 on, with only A-Z lower-cased. A document's score for a
query is the sum over the query's terms, repeats included, of weight x impact, all in 64-bit integers (``weight``, ``impacts``).

Method: per-term geometric blocking.
    1. Texts become vectors over the queries' terms, in shards of up to ``SHARD`` documents; lengths and document counts cover all rows.
    2. In each shard the posting list of every term is clustered by document similarity: members go to the nearest of evenly taken
       members by the inner product of random projections of their weighted vectors. Each block stores the largest impact of
       every coordinate of its documents. A task writes its shards' blocks to one file; the table of shards that finished tasks
       return names file and place, so that nothing of a lost task is read.
    3. A query goes through its terms from the rarest to the most common. A document is due in the list of the rarest of the query's
       terms that it holds, so a block's summary needs the coordinates of its term and the more common ones only. The inner product
       of query and summary bounds the scores of the documents that are due in the block; a block is skipped only when that bound is below the
       query's current 10th score. While the blocks are built, the most promising ones of each shard are scored; the 10th score
       over all shards is where every shard starts when the table is read for the search itself.

Nothing is dropped: bounds are sums of exact maxima in integers, and ties with the k-th score are scored, too.

Results for odd rows: a null or term-less text is no document of the collection (it counts nowhere and is never returned); a null or
term-less query has no result; rows that repeat are documents (queries) of their own; a null id is returned as null, after
the others of its score; empty tables give an empty result; other columns are ignored, whatever their names.

Memory: a task holds a slice of texts or one shard, whose summaries are made in pieces. Queries are taken in blocks of
about ``QUERY_BYTES`` of text, dealt by hash, and only such a block, with its terms' counts, comes to the driver.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlake.session import scratch_path

from .common import materialize, open_fs, text_slices
from .textbytes import LOWER, mix64, powers, text_bytes

#: Documents of one shard.
SHARD = 4096
#: Postings aimed at in a block.
BLOCK = 64
#: Bytes of query text that are searched for together.
QUERY_BYTES = 4 << 20
#: Entries of block summaries that are sorted at once.
PIECE = 1 << 19
#: Bytes of text that are searched for terms at once.
SLICE = 1 << 20
#: Blocks of a shard that are scored for the first bound.
FIRST = 4
_DIMS = 16
_IMPACT_BITS = 20
_TERM = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TERM[_lo: _hi + 1] = False
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.RandomState(29).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_inverse = np.ones(1, np.uint64)
_CODEC = pa.Codec("zstd", compression_level=1)

VECTORS = "ids binary, none binary, n binary, off binary, terms binary, tfs binary, held array<int>, df array<long>, docs long, total long"
_VECTOR_FIELDS = ("ids", "none", "n", "off", "terms", "tfs")
INDEX = "file string, at long, packed array<long>, plain array<long>, seed_query array<int>, seed_score array<long>"


def weight(n_docs: int, df: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term that occurs ``tf`` times adds, per unit of weight, in documents of ``n`` terms."""
    m = 100 - 75 + (75 * n * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents above 0 of each query, ties to the smaller id: query id, rank, id, score."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = queries.select(F.col(query_col).alias("item_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    size = asked.select(F.sum(F.octet_length("text").cast("long")).alias("b")).first().b or 0
    several = max(1, -(-int(size) // QUERY_BYTES))
    out = None
    for b in range(several):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(several)) == b) if several > 1 else asked
        rows = _search_block(docs, block, k)
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.col("item_id").alias(query_col), "rank", F.col("doc_id").alias(id_col), "score")


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked = block.collect()
    words = [query_terms(r.text) for r in asked]
    vocabulary = sorted({w for q in words for w in q})
    number = {w: i for i, w in enumerate(vocabulary)}
    vectors = materialize(docs.mapInArrow(_vectors(vocabulary), VECTORS), "vectors")
    n_docs, total = vectors.select(F.sum("docs"), F.sum("total")).first()
    held = {} if not n_docs else {r.t: r.df for r in vectors.select(F.explode(F.arrays_zip("held", "df")).alias("x"))
                                  .groupBy(F.col("x.held").alias("t")).agg(F.sum("x.df").alias("df")).collect()}
    # the rarest first; terms that no document holds count nowhere
    order = sorted(held, key=lambda t: (held[t], t))
    place = {t: i for i, t in enumerate(order)}
    weights = np.array([weight(n_docs, held[t]) for t in order], np.int64)
    plan = []
    for q in words:
        count: dict[int, int] = {}
        for w in q:
            if (p := place.get(number[w])) is not None:
                count[p] = count.get(p, 0) + 1
        at = np.array(sorted(count), np.int64)
        plan.append((at, weights[at] * np.array([count[p] for p in at.tolist()], np.int64)))
    places = np.full(max(1, len(vocabulary)), -1, np.int32)
    for t, p in place.items():
        places[t] = p
    index = materialize(vectors.select(*_VECTOR_FIELDS).mapInArrow(_blocks(scratch_path(spark, "blocks"), places, weights, plan, n_docs or 0, total or 0, k), INDEX), "shards")
    best = Window.partitionBy("q").orderBy(F.desc("s"))
    seeds = (index.select(F.explode(F.arrays_zip("seed_query", "seed_score")).alias("x")).select(F.col("x.seed_query").alias("q"), F.col("x.seed_score").alias("s"))
             .withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("q", "s").collect())
    least = np.ones(max(1, len(plan)), np.int64)
    for r in seeds:
        least[r.q] = max(1, r.s)
    hits = index.drop("seed_query", "seed_score").mapInArrow(_hits(plan, least, len(order), k), "q int, doc_id long, score long")
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(asked)], f"q int, item_id {dict(block.dtypes)['item_id']}")
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return top.join(names, "q").select("item_id", "rank", "doc_id", "score")


# -- texts to vectors ------------------------------------------------------------------------------------------

def _spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms in joined texts, and the texts' splits of the terms."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.append(False, inside[:-1]) & ~cut
    starts = np.flatnonzero(inside & ~before)
    follows = np.append(inside[1:], False)
    follows[:-1] &= ~cut[1:]
    ends = np.flatnonzero(inside & ~follows) + 1
    return starts, ends, np.searchsorted(starts, off)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from sums of byte codes times powers."""
    global _inverse
    if len(_inverse) < len(data) + 1:
        _inverse = np.full(len(data) + 1, _INV)
        _inverse[0] = 1
        _inverse = np.cumprod(_inverse, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(len(data))[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _inverse[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def query_terms(text: str) -> list[bytes]:
    """The terms of one text in order, with repeats."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = _spans(data, np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _vectors(vocabulary: list[bytes]):
    """Shards of vectors: ids, numbers of terms, and the counts of the vocabulary's terms, one row a shard."""
    text = np.frombuffer(b"".join(vocabulary), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(w) for w in vocabulary])]).astype(np.int64)
    keys = _hashes(text, edge[:-1], edge[1:]) if vocabulary else np.empty(0, np.uint64)
    by = np.argsort(keys)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two terms share a hash")

    def run(batches):
        kept: list[tuple] = []
        size = 0
        for batch in batches:
            for part in text_slices(batch, max_bytes=SLICE):
                kept.append((part.column("doc_id"), *counts(part)))
                size += part.num_rows
                if size >= SHARD:
                    yield row(kept)
                    kept, size = [], 0
        if kept:
            yield row(kept)

    def counts(part):
        data, off = text_bytes(part.column("text"))
        data = LOWER[data]
        starts, ends, split = _spans(data, off)
        doc = np.repeat(np.arange(part.num_rows), np.diff(split))
        n = np.diff(split)
        if not len(starts) or not len(keys):
            return n, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        h = _hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(keys[by], h), len(keys) - 1)
        term = by[at]
        hit = np.flatnonzero((keys[term] == h) & (edge[term + 1] - edge[term] == ends - starts))
        starts, term, doc = starts[hit], term[hit], doc[hit]
        # a hash is no proof: the bytes are compared
        lens = edge[term + 1] - edge[term]
        pos = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        if len(hit):
            same = np.logical_and.reduceat(data[np.repeat(starts, lens) + pos] == text[np.repeat(edge[term], lens) + pos], np.cumsum(lens) - lens)
            term, doc = term[same], doc[same]
        key, tf = np.unique((doc << 32) | term, return_counts=True)
        return n, key >> 32, key & 0xFFFFFFFF, tf

    def row(kept):
        ids = pa.concat_arrays([x[0] for x in kept])
        none = np.array(ids.is_null())
        n = np.concatenate([x[1] for x in kept])
        base = np.cumsum([0] + [len(x[1]) for x in kept])
        doc = np.concatenate([x[2] + b for x, b in zip(kept, base)])
        term, tf = np.concatenate([x[3] for x in kept]), np.concatenate([x[4] for x in kept])
        held, df = np.unique(term, return_counts=True)
        off = np.searchsorted(doc, np.arange(len(n) + 1))
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.binary()) for x in (np.array(ids.fill_null(0)).astype(np.int64).tobytes(), none.tobytes(), n.astype(np.int64).tobytes(), off.astype(np.int64).tobytes(),
                                                  term.astype(np.int32).tobytes(), tf.astype(np.int64).tobytes())]
            + [pa.array([held], pa.list_(pa.int32())), pa.array([df], pa.list_(pa.int64())), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())],
            names=["ids", "none", "n", "off", "terms", "tfs", "held", "df", "docs", "total"])
    return run


# -- blocks ----------------------------------------------------------------------------------------------------

class Shard:
    """One shard's vectors, posting lists in blocks, and the blocks' summaries, as arrays.

    ``off, terms, impacts``: the documents' vectors, each from its rarest term on. ``lists``: first block of every
    held term (``lists[0]`` terms, ``lists[1]`` first blocks, with the number of blocks at the end). ``blocks``: first posting of every
    block. ``members``: documents of the postings. ``edges``: first summary entry of every block. ``coords, most``: summaries.
    """

    FIELDS = {"ids": np.int64, "none": np.bool_, "off": np.int64, "terms": np.int32, "impacts": np.int64, "lists": np.int64,
              "blocks": np.int64, "members": np.int32, "edges": np.int64, "coords": np.int32, "most": np.int32}

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def read(cls, row: dict) -> Shard:
        store, path = open_fs(row["file"])
        out, at = {}, row["at"]
        with store.open_input_file(path) as f:
            for (k, t), size, plain in zip(cls.FIELDS.items(), row["packed"], row["plain"]):
                out[k] = np.frombuffer(_CODEC.decompress(f.read_at(size, at), plain), t)
                at += size
        return cls(**out)

    def write(self, stream) -> tuple[list[int], list[int]]:
        """Append the arrays to a file; their packed and plain sizes."""
        packed, plain = [], []
        for k, t in self.FIELDS.items():
            raw = np.ascontiguousarray(getattr(self, k), t)
            data = _CODEC.compress(raw)
            stream.write(data)
            packed.append(len(data))
            plain.append(raw.nbytes)
        return packed, plain

    @classmethod
    def build(cls, row: dict, places: np.ndarray, weights: np.ndarray, n_docs: int, total: int) -> Shard:
        ids, none = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["none"], np.bool_)
        n, off = np.frombuffer(row["n"], np.int64), np.frombuffer(row["off"], np.int64)
        terms, tf = places[np.frombuffer(row["terms"], np.int32)], np.frombuffer(row["tfs"], np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(off))
        by = np.lexsort((terms, doc))
        terms, tf = terms[by], tf[by]
        impact = impacts(tf, n[doc], n_docs, total) if len(doc) else np.empty(0, np.int64)
        # posting lists, from the rarest term on, each clustered by the similarity of its documents
        post = np.argsort(terms, kind="stable")
        held, first = np.unique(terms[post], return_index=True)
        size = np.diff(np.append(first, len(post)))
        sketch = _sketch(terms, impact, weights, off)
        blocks = []
        for a, s in zip(first.tolist(), size.tolist()):
            if s <= BLOCK:
                blocks.append(np.array([a]))
                continue
            mine = post[a: a + s]
            few = sketch[doc[mine[:: BLOCK]]]
            near = np.argmax(sketch[doc[mine]] @ few.T, axis=1)
            o = np.argsort(near, kind="stable")
            post[a: a + s] = mine[o]
            blocks.append(a + np.flatnonzero(np.append(True, np.diff(near[o]) > 0)))
        starts = np.concatenate(blocks) if blocks else np.empty(0, np.int64)
        lists = np.append(np.searchsorted(starts, first), len(starts))
        edges, coords, most = _summaries(post, starts, off[doc + 1] if len(doc) else doc, terms, impact)
        return cls(ids=ids, none=none, off=off, terms=terms.astype(np.int32), impacts=impact, lists=np.concatenate([held, lists]).astype(np.int64),
                   blocks=np.append(starts, len(post)).astype(np.int64), members=doc[post].astype(np.int32), edges=edges, coords=coords, most=most)

    def top(self, at: np.ndarray, coef: np.ndarray, dense: np.ndarray, least: int, k: int, only: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the shard) and scores of one query, at least ``least``, by descending score: all that can be among its ``k`` best.

        ``at, coef``: the query's terms, the rarest first, and their weights; ``dense``: zeros, one for every term, lent by the caller;
        ``only``: score no more than that many blocks.
        """
        held, first = self.lists[: len(self.lists) // 2], self.lists[len(self.lists) // 2:]
        mine = np.searchsorted(held, at)
        has = held[np.minimum(mine, len(held) - 1)] == at if len(held) else np.zeros(len(at), bool)
        lists = mine[has]
        if not len(lists):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        dense[at] = coef
        count = first[lists + 1] - first[lists]
        block = np.repeat(first[lists] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        lens = self.edges[block + 1] - self.edges[block]
        begin = np.cumsum(lens) - lens
        entry = np.repeat(self.edges[block] - begin, lens) + np.arange(int(lens.sum()))
        bound = np.add.reduceat(dense[self.coords[entry]] * self.most[entry], begin)
        by = np.argsort(-bound, kind="stable")
        block, bound = block[by], bound[by]
        seen = np.zeros(len(self.ids), bool)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        i, step = 0, FIRST
        stop = len(block) if only is None else min(only, len(block))
        while i < stop and bound[i] >= least:
            j = min(i + step, stop)
            j = i + max(1, int(np.count_nonzero(bound[i:j] >= least)))
            new = np.zeros(len(self.ids), bool)
            for b in block[i:j].tolist():
                new[self.members[self.blocks[b]: self.blocks[b + 1]]] = True
            new &= ~seen
            seen |= new
            d = np.flatnonzero(new)
            s = self.scores(d, dense)
            ok = s >= least
            docs, scores = np.concatenate([docs, d[ok]]), np.concatenate([scores, s[ok]])
            if len(scores) > k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                ok = scores >= least
                docs, scores = docs[ok], scores[ok]
            i, step = j, 2 * step
        dense[at] = 0
        by = np.argsort(-scores, kind="stable")
        return docs[by], scores[by]

    def scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        lens = self.off[docs + 1] - self.off[docs]
        begin = np.cumsum(lens) - lens
        entry = np.repeat(self.off[docs] - begin, lens) + np.arange(int(lens.sum()))
        return np.add.reduceat(dense[self.terms[entry]] * self.impacts[entry], begin) if len(docs) else begin


def _sketch(terms, impact, weights, off) -> np.ndarray:
    """Unit vectors: random projections of the documents' weighted vectors."""
    signs = (mix64(terms.astype(np.uint64) + np.uint64(1))[:, None] >> np.arange(_DIMS, dtype=np.uint64)) & np.uint64(1)
    value = (weights[terms] * impact).astype(np.float32)[:, None] * (1 - 2 * signs.astype(np.float32))
    sums = np.zeros((len(off) - 1, _DIMS), np.float32)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        sums[full] = np.add.reduceat(value, off[full], axis=0)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)


def _summaries(post, starts, row_end, terms, impact) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest impact of every coordinate from the list's term on, for each block: entry edges, coordinates, maxima."""
    if not len(post):
        return np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    bits = int(max(terms.max(), 1)).bit_length()
    packed = (terms.astype(np.uint64) << np.uint64(_IMPACT_BITS)) | impact.astype(np.uint64)
    lens = row_end[post] - post
    block = np.cumsum(np.bincount(starts, minlength=len(post))) - 1
    ahead = np.concatenate([[0], np.cumsum(lens)])
    edge, coords, most = [np.zeros(1, np.int64)], [], []
    bounds = np.append(starts, len(post))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ahead[bounds], ahead[bounds[lo]] + PIECE, "right")) - 1)
        a, b = int(bounds[lo]), int(bounds[hi])
        entry = np.repeat(post[a:b] - (ahead[a:b] - ahead[a]), lens[a:b]) + np.arange(int(ahead[b] - ahead[a]))
        key = np.repeat((block[a:b] - lo).astype(np.uint64) << np.uint64(bits + _IMPACT_BITS), lens[a:b]) | packed[entry]
        key.sort()
        last = np.flatnonzero(np.append((key[1:] >> np.uint64(_IMPACT_BITS)) != (key[:-1] >> np.uint64(_IMPACT_BITS)), True))
        key = key[last]
        edge.append(np.cumsum(np.bincount((key >> np.uint64(bits + _IMPACT_BITS)).astype(np.int64), minlength=hi - lo)) + edge[-1][-1])
        coords.append(((key >> np.uint64(_IMPACT_BITS)) & np.uint64((1 << bits) - 1)).astype(np.int32))
        most.append((key & np.uint64((1 << _IMPACT_BITS) - 1)).astype(np.int32))
        lo = hi
    return np.concatenate(edge), np.concatenate(coords), np.concatenate(most)


def _blocks(folder, places, weights, plan, n_docs, total, k):
    def run(batches):
        dense = np.zeros(max(1, len(weights)), np.int64)
        file, stream = f"{folder}/{uuid.uuid4().hex}", None
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    if stream is None:
                        store, path = open_fs(file)
                        store.create_dir(os.path.dirname(path), recursive=True)
                        stream, at = store.open_output_stream(path), 0
                    shard = Shard.build(batch.slice(i, 1).to_pylist()[0], places, weights, n_docs, total)
                    query, score = [], []
                    for q, (terms, coef) in enumerate(plan):
                        s = shard.top(terms, coef, dense, 1, k, only=FIRST)[1][:k]
                        query += [q] * len(s)
                        score += s.tolist()
                    packed, plain = shard.write(stream)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file]), pa.array([at]), pa.array([packed], pa.list_(pa.int64())), pa.array([plain], pa.list_(pa.int64())),
                         pa.array([query], pa.list_(pa.int32())), pa.array([score], pa.list_(pa.int64()))],
                        names=["file", "at", "packed", "plain", "seed_query", "seed_score"])
                    at += sum(packed)
        finally:
            if stream is not None:
                stream.close()
    return run


def _hits(plan, least, terms, k):
    def run(batches):
        dense = np.zeros(max(1, terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.read(batch.slice(i, 1).to_pylist()[0])
                for q, (at, coef) in enumerate(plan):
                    docs, score = shard.top(at, coef, dense, int(least[q]), k)
                    if len(docs):
                        best = np.lexsort((shard.ids[docs], shard.none[docs], -score))[:k]  # equal scores: the smaller ids
                        docs, score = docs[best], score[best]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), q, np.int32)), pa.array(shard.ids[docs], mask=shard.none[docs]), pa.array(score)],
                                                         names=["q", "doc_id", "score"])
    return run


OP12_SQL = """WITH
docs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM docs GROUP BY 1),
whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM docs GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark) GROUP BY 1, 2),
scored AS (
  SELECT item_id, doc_id,
         sum(times * floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN dfs USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), whole GROUP BY 1, 2),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
