"""Operator 6: language identification by interpolated Kneser-Ney character models.

Per language, words (runs of letters, lower case) are padded and cut into character n-grams. Spark counts the highest order; each
lower order counts the distinct left neighbours of its grams. Counts and context statistics lie in arrays sorted by a 64-bit
hash, one set of files per language and hash range, which workers map into memory. A text's cross-entropy under a language is the mean
negative log probability of its characters and word ends, so length does not matter; the lowest wins. A text is rejected when its
cross-entropy lies further above its language's own than calibration documents of that length do.

Defined results: a text that is null or has no letter gets ``und``, score 0, rejected; equal cross-entropies go to the language that
sorts first; rows without a language teach nothing; with nothing to learn from every text is ``und``. An empty table gives no rows; repeated rows each get
a row; columns other than the three that are named are not read.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlake.session import scratch_path

from .common import map_array, materialize, slices_returned, write_bytes
from .textbytes import mix64, text_bytes

ORDER = 4
#: Bytes of text whose characters are worked on at once: a symbol takes some 50 bytes in arrays.
SLICE = 1 << 20
BEGIN, END = 0x110001, 0x110002
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_tables: list = []


def _chars() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, and its lower case where that is one character."""
    if not _tables:
        letter = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                x = c.lower()
                if x != c and len(x) == 1:
                    lower[i] = ord(x)
        _tables.extend([letter, lower])
    return _tables[0], _tables[1]


def _words(col: pa.Array):
    """Lower-case letters of a slice, starts and ends of its words among them, and the rows' splits of the words."""
    letter, lower = _chars()
    data, off = text_bytes(col)
    head = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(head)])[off]
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    on = letter[cp]
    n = len(cp)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = on.copy(), on.copy()
    if n:
        first[1:] &= ~on[:-1] | edge[1:n]
        last[:-1] &= ~on[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return lower[cp], starts, ends, np.searchsorted(starts, at)


def _distinct(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Distinct words: positions of one occurrence each, and which distinct word every word is."""
    lens = ends - starts
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
    code = mix64(cp[np.repeat(starts, lens) + pos].astype(np.uint64) + (pos.astype(np.uint64) << np.uint64(32)))
    h = mix64(np.add.reduceat(code, at) + lens.astype(np.uint64))
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    return starts[one], ends[one], which


def _grams(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of padded words, one row each, and the word that each belongs to."""
    lens = ends - starts
    wide = lens + order  # begin marks, characters, end mark
    at = np.cumsum(wide) - wide
    line = np.full(int(wide.sum()), BEGIN, np.uint32)
    pos = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    line[np.repeat(at + order - 1, lens) + pos] = cp[np.repeat(starts, lens) + pos]
    line[at + wide - 1] = END
    n = lens + 1
    word = np.repeat(np.arange(len(lens)), n)
    k = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return line[k[:, None] + np.arange(order)], word


def _key(symbols: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of symbols; the number of columns takes part."""
    h = np.full(len(symbols), symbols.shape[1], np.uint64)
    for k in range(symbols.shape[1]):
        h = mix64(h * _PRIME + symbols[:, k].astype(np.uint64))
    return h


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, folder: str | None = None) -> dict:
    """Learn from every row that has a language. The model is a description of its files: ``languages``, ``discounts``, ``files``."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "char-models")
    cols = [f"c{i}" for i in range(order)]

    def count(batches):
        for batch in batches:
            for part in slices_returned(batch, max_bytes=SLICE):
                label = part.column("lang").dictionary_encode()
                code = label.indices.to_numpy(zero_copy_only=False)
                cp, starts, ends, split = _words(part.column("text"))
                of = np.repeat(code, np.diff(split))
                for j, name in enumerate(label.dictionary.to_pylist()):
                    s, e = starts[of == j], ends[of == j]
                    if not len(s):
                        continue
                    s, e, which = _distinct(cp, s, e)
                    grams, word = _grams(cp, s, e, order)
                    _, one, back = np.unique(_key(grams), return_index=True, return_inverse=True)
                    n = np.bincount(back, np.bincount(which)[word]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(one), pa.string()), *(pa.array(grams[one, k].astype(np.int64)) for k in range(order)), pa.array(n)],
                                                     names=["lang", *cols, "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    top = rows.mapInArrow(count, "lang string, " + ", ".join(f"{c} long" for c in cols) + ", n long")
    level = materialize(top.groupBy("lang", *cols).agg(F.sum("n").alias("n")), "grams")
    discounts: dict = {}
    tables = []
    for k in range(order, 0, -1):
        have = cols[:k]
        stats = level.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)))
        for r in stats.collect():  # one row per language
            n1, n2, n3, n4 = (float(r[f"n{i}"]) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            d = [y if not n1 else 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            discounts.setdefault(r["lang"], {})[k] = [float(np.clip(x, 0.05, i + 0.95)) for i, x in enumerate(d)]
        empty = [F.lit(None).cast("long").alias(c) for c in cols[k:]]
        zero = [F.lit(0.0).alias(f"v{i}") for i in (1, 2, 3)]
        tables.append(level.select("lang", F.lit("gram").alias("kind"), F.lit(k).alias("k"), *have, *empty, F.col("n").cast("double").alias("v0"), *zero))
        ctx = level.groupBy("lang", *have[:-1]).agg(F.sum("n").cast("double").alias("v0"), *(F.sum((F.col("n") == i).cast("double")).alias(f"v{i}") for i in (1, 2)),
                                                    F.sum((F.col("n") >= 3).cast("double")).alias("v3"))
        tables.append(ctx.select("lang", F.lit("context").alias("kind"), F.lit(k - 1).alias("k"), *have[:-1], *[F.lit(None).cast("long").alias(c) for c in cols[k - 1:]], "v0", "v1", "v2", "v3"))
        if k > 1:
            level = materialize(level.groupBy("lang", *[F.col(c).alias(cols[i]) for i, c in enumerate(have[1:])]).agg(F.count("*").alias("n")), "grams")

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("k").to_numpy()
            sym = np.stack([batch.column(c).fill_null(0).to_numpy() for c in cols], 1).astype(np.uint32)
            key = np.zeros(len(k), np.uint64)
            for x in np.unique(k):
                key[k == x] = _key(sym[k == x, :x])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("kind"), batch.column("k"), pa.array((key >> np.uint64(60)).astype(np.int64)), pa.array(key.view(np.int64)),
                                              *(batch.column(f"v{i}") for i in range(4))], names=["lang", "kind", "k", "bucket", "key", "v0", "v1", "v2", "v3"])

    def write(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).to_pandas()
        for i, ((name, kind, k, bucket), g) in enumerate(whole.groupby(["lang", "kind", "k", "bucket"])):
            key = g["key"].to_numpy().view(np.uint64)
            by = np.argsort(key)
            uri = f"{folder}/{kind}-{k}-{bucket}-{attempt}-{i}"
            write_bytes(f"{uri}.key", key[by])
            write_bytes(f"{uri}.val", np.ascontiguousarray(g[["v0", "v1", "v2", "v3"]].to_numpy(np.float64)[by]))
            yield pa.RecordBatch.from_pydict({"lang": [name], "kind": [kind], "k": [int(k)], "bucket": [int(bucket)], "uri": [uri]})

    every = reduce(DataFrame.unionByName, tables)
    every = every.mapInArrow(keyed, "lang string, kind string, k int, bucket long, key long, v0 double, v1 double, v2 double, v3 double")
    made = materialize(every.repartition("lang", "kind", "k", "bucket").mapInArrow(write, "lang string, kind string, k long, bucket long, uri string"), "char-model-files")
    files = [tuple(r) for r in made.select("lang", "kind", "k", "bucket", "uri").collect()]  # 16 ranges a table
    return {"languages": sorted(discounts), "discounts": discounts, "files": files, "order": order}


class Model:
    """The mapped arrays of all languages."""

    def __init__(self, spec: dict):
        self.order, self.languages, self.discounts = spec["order"], spec["languages"], spec["discounts"]
        self.files: dict = {}
        for name, kind, k, bucket, uri in spec["files"]:
            self.files.setdefault((name, kind, k), {})[bucket] = (map_array(f"{uri}.key", np.uint64), map_array(f"{uri}.val", np.float64).reshape(-1, 4))

    def look(self, name: str, kind: str, k: int, key: np.ndarray) -> np.ndarray:
        out = np.zeros((len(key), 4))
        top = (key >> np.uint64(60)).astype(np.int64)
        for bucket, (keys, vals) in self.files.get((name, kind, k), {}).items():
            on = np.flatnonzero(top == bucket)
            at = np.searchsorted(keys, key[on])
            at[at == len(keys)] = 0
            hit = keys[at] == key[on]
            out[on[hit]] = vals[at[hit]]
        return out

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of the interpolated probability of each gram's last symbol, a column per language."""
        out = np.empty((len(grams), len(self.languages)))
        keys = {k: _key(grams[:, self.order - k:]) for k in range(1, self.order + 1)}
        contexts = {k: _key(grams[:, self.order - 1 - k: self.order - 1]) for k in range(self.order)}
        for j, name in enumerate(self.languages):
            symbols = len(self.files.get((name, "gram", 1), ())) and sum(len(v[0]) for v in self.files[(name, "gram", 1)].values())
            p = np.full(len(grams), 1.0 / (symbols + 1))
            for k in range(1, self.order + 1):
                d = np.array([0.0, *self.discounts[name][k]])
                c = self.look(name, "gram", k, keys[k])[:, 0]
                total, n1, n2, n3 = self.look(name, "context", k - 1, contexts[k - 1]).T
                known = total > 0
                t = np.where(known, total, 1)
                q = np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0) / t + (d[1] * n1 + d[2] * n2 + d[3] * n3) / t * p
                p = np.where(known, q, p)
            out[:, j] = np.log(p)
        return out


_models: dict = {}


def _model(spec: dict) -> Model:
    key = json.dumps(spec["files"][:1])
    if key not in _models:
        _models.clear()
        _models[key] = Model(spec)
    return _models[key]


def cross_entropies(docs: DataFrame, spec: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_symbols`` and the array ``ce``: nats per symbol under each language, in the order of ``spec``."""
    languages = len(spec["languages"])

    def score(batches):
        model = _model(spec) if languages else None
        for batch in batches:
            for part in slices_returned(batch, text, SLICE):
                cp, starts, ends, split = _words(part.column(text))
                rows = part.num_rows
                n, total = np.zeros(rows), np.zeros((rows, languages))
                if len(starts) and languages:
                    of = np.repeat(np.arange(rows), np.diff(split))
                    s, e, which = _distinct(cp, starts, ends)
                    grams, word = _grams(cp, s, e, model.order)
                    _, one, back = np.unique(_key(grams), return_index=True, return_inverse=True)
                    lp = model.log_probability(grams[one])
                    for j in range(languages):
                        total[:, j] = np.bincount(of, np.bincount(word, lp[back, j])[which], rows)
                    n = np.bincount(of, (ends - starts + 1), rows)
                ce = -total / np.maximum(n, 1)[:, None]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n.astype(np.int64)),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * languages, pa.int32()), pa.array(ce.ravel()))],
                                                 names=[*keep, "n_symbols", "ce"])

    types = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(score, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_symbols long, ce array<double>")


def _decide(scored: DataFrame, languages: list[str]) -> DataFrame:
    """Adds ``best`` (lowest cross-entropy) and ``lang_pred``."""
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    low = F.array_min("ce")
    return (scored.withColumn("best", F.when(F.col("n_symbols") > 0, low))
            .withColumn("lang_pred", F.when(F.col("best").isNotNull(), F.element_at(names, F.array_position("ce", F.col("best")).cast("int"))).otherwise(F.lit("und"))))


#: A deviation counts in full from this many symbols on; a shorter text's is scaled down by the square root of its length.
FULL_LENGTH = 64
#: No language's limit is below this many nats per symbol above its centre.
LEAST_LIMIT = 0.75


def _deviation(centre) -> Column:
    return (F.col("best") - centre) * F.least(F.sqrt(F.col("n_symbols") / F.lit(FULL_LENGTH)), F.lit(1.0))


def calibrate(docs: DataFrame, spec: dict, share: float = 0.999, widen: float = 2.0, grid=(0.25, 0.5, 1.0, 2.0, 4.0, 8.0)) -> dict:
    """Fit, on documents with a language, the score's sharpness and per language the cross-entropy's centre and the deviation
    from it that ``share`` of its documents stay below, widened ``widen`` times."""
    languages = spec["languages"]
    if not languages:
        return {"sharpness": 1.0, "limits": {}}
    rows = _decide(cross_entropies(docs.where("lang is not null"), spec, ["lang"]), languages).where("best is not null")
    rows = materialize(rows.withColumn("at", F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int")).where("at > 0"), "calibration")
    nll = rows.agg(*(F.avg(-F.log(F.greatest(F.element_at(_posterior(t), F.col("at")), F.lit(1e-9)))).alias(f"t{i}") for i, t in enumerate(grid))).first()
    losses = [nll[f"t{i}"] for i in range(len(grid))]
    sharpness = grid[int(np.argmin(losses))] if None not in losses else 1.0
    right = rows.where("lang = lang_pred")
    centre = right.groupBy("lang").agg((F.sum(F.col("best") * F.col("n_symbols")) / F.sum("n_symbols")).alias("centre"))
    limit = (right.join(F.broadcast(centre), "lang")  # a row per language
             .groupBy("lang", "centre").agg(F.percentile_approx(_deviation(F.col("centre")), share, 10000).alias("q")))
    return {"sharpness": sharpness, "limits": {r["lang"]: (r["centre"], max(widen * r["q"], LEAST_LIMIT)) for r in limit.collect()}}


def _posterior(sharpness: float) -> Column:
    """Softmax of the languages' cross-entropies over the square root of the length."""
    e = F.transform("ce", lambda x: F.exp((F.array_min("ce") - x) * F.sqrt("n_symbols") * sharpness))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(docs: DataFrame, spec: dict, calibration: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``."""
    rows = _decide(cross_entropies(docs, spec, keep, text), spec["languages"])
    over = reduce(lambda a, x: F.when((F.col("lang_pred") == x[0]) & (_deviation(F.lit(x[1][0])) > F.lit(x[1][1])), F.lit(True)).otherwise(a),
                  calibration["limits"].items(), F.lit(False))
    return rows.select(*keep, "lang_pred", F.when(F.col("best").isNull(), F.lit(0.0)).otherwise(F.array_max(_posterior(calibration["sharpness"]))).alias("score"),
                       F.col("best").alias("cross_entropy"), (F.col("best").isNull() | over).alias("rejected"))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def learn(docs: DataFrame) -> tuple[dict, dict]:
    """The model of all documents outside fold 0, calibrated on fold 1 by a model that has learned from neither."""
    calibration = calibrate(docs.where(fold() == 1), train(docs.where(fold() > 1)))
    return train(docs.where(fold() != 0)), calibration
