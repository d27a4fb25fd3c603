"""Removal of long repeated byte strings with suffix arrays (operator 11).

Every text is a string of UTF-8 bytes; a byte goes if a string of ``length`` bytes that covers it also starts at
another place of any text. Matches stay inside texts, overlap counts, and all is judged on the input.

Method
    1. *Shards.* Each start of a ``length``-byte window takes the smallest hash of the 32-byte strings in its window
       as its key, so equal windows have equal keys. Neighbouring starts with one key make a row (a stretch of
       text); stretches whose key occurs at one place only hold no repeat. The stretches of a key go to one
       shard of about ``SHARD`` bytes of text, equal stretches once with their number of copies.
    2. *Suffix array* of each shard by Larsson-Sadakane refinement: groups of suffixes that agree on h bytes are
       ordered by the rank of the suffix h bytes further on, and h doubles; finished groups are left alone.
    3. *Kasai's common prefixes*, vectorised: where the neighbour of suffix i is one behind the neighbour of i - 1
       and their bytes agree, the common prefix is one less; only the others compare bytes. A start is
       repeated if it shares ``length`` bytes with a neighbour in the array, or its stretch has copies.
    4. *Merging across shards.* A key with more than ``SHARD`` bytes of distinct stretches has several shards. Each
       gives its distinct windows, sorted by a 128-bit fingerprint and cut into ranges; one task per range merges
       the sorted runs by binary search, and a window found in two shards is repeated.

Results for odd rows: a null text counts as empty; a text shorter than ``length`` loses nothing; rows that repeat
(same or different id) are texts of their own, so long ones remove each other whole; a null id stays null; an
empty table gives an empty result; other columns are ignored, whatever their names. Removed strings are cut at
bytes, so ``kept`` may not be valid UTF-8.

Memory: a task holds a slice of texts, one shard, or one range of a merge; a long text is hashed in blocks. One
stretch of a periodic text is a shard of its own, however long. All tables are written under the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices
from .textbytes import mix64, powers, text_bytes

#: Bytes of the strings whose smallest hash is a window's key.
GRAM = 32
#: Bytes of text aimed at in one suffix array.
SHARD = 1 << 20
#: Window starts of one text that are hashed at once.
BLOCK = 1 << 20
_IDX = 21
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = [np.random.RandomState(s).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1) for s in (7, 11)]
_inverse = np.ones(1, np.uint64)

ROWS = "value long, d1 long, d2 long, id long, h long, a int, n int, anchors int"
CONTENTS = "g1 long, g2 int, value long, d1 long, d2 long, n int, copies boolean, parts int, content binary"
FOUND = "value long, d1 long, d2 long, starts array<int>, stops array<int>, slice int, part int, prints binary, refs binary"


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text without its repeated strings: id, n_bytes, n_removed, spans (array of removed ``start``, ``stop``), kept (binary)."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes can be matched")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"),
                         F.xxhash64(F.col("doc_id").isNull(), "text").alias("h"))
    rows = _candidates(materialize(keyed.select("id", "h", "text").mapInArrow(_stretches(length), ROWS), "stretches"))
    found = _repeated(keyed, rows, length)
    spans = (rows.select("value", "d1", "d2", "id", "h", "a").join(found, ["value", "d1", "d2"])
             .select("id", "h", F.explode(F.arrays_zip("starts", "stops")).alias("r"), "a")
             .groupBy("id", "h").agg(F.collect_list(F.struct((F.col("a") + F.col("r.starts")).alias("lo"),
                                                             (F.col("a") + F.col("r.stops") + (length - 1)).alias("hi"))).alias("cut")))
    out = keyed.join(spans, ["id", "h"], "left").select("doc_id", "text", "cut")
    return (out.mapInArrow(_without, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
            .withColumnRenamed("doc_id", id_col))


def _candidates(rows: DataFrame) -> DataFrame:
    """The stretches whose key occurs at two places or more; a repeated row of the input counts in ``copies``."""
    twice = rows.groupBy("value").agg(F.sum("anchors").alias("places")).where("places > 1").select("value")
    return materialize(rows.join(twice, "value").groupBy("value", "d1", "d2", "id", "h", "a", "n")
                       .agg(F.count("*").alias("copies")), "candidates")


def _repeated(keyed: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The repeated starts of each distinct stretch: (value, d1, d2, starts, stops), from the shards' suffix arrays."""
    distinct = materialize(rows.groupBy("value", "d1", "d2").agg(F.sum("copies").alias("copies"), F.min(F.struct("id", "h", "a", "n")).alias("rep")),
                           "distinct", compact=True)
    sizes = distinct.groupBy("value").agg(F.sum(F.col("rep.n") + (length - 1)).alias("bytes"))
    total = distinct.select(F.sum(F.col("rep.n").cast("long") + (length - 1)).alias("t")).first().t or 0
    shards = max(1, -(-int(total) // SHARD))
    large = materialize(sizes.where(F.col("bytes") > SHARD).select("value", F.ceil(F.col("bytes") / SHARD).cast("int").alias("parts")),
                        "large-keys", compact=True)
    placed = distinct.join(large, "value", "left").select(
        "value", "d1", "d2", (F.col("copies") > 1).alias("copies"), "rep", F.coalesce("parts", F.lit(0)).alias("parts"),
        F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("value"), F.lit(shards))).otherwise(F.col("value")).alias("g1"),
        F.coalesce(F.pmod("d1", F.col("parts").cast("long")).cast("int"), F.lit(-1)).alias("g2"))
    asked = placed.groupBy(F.col("rep.id").alias("id"), F.col("rep.h").alias("h")).agg(F.collect_list(F.struct(
        "g1", "g2", "value", "d1", "d2", F.col("rep.a").alias("a"), F.col("rep.n").alias("n"), "copies", "parts")).alias("asked"))
    contents = keyed.select("id", "h", "text").join(asked, ["id", "h"]).select("text", "asked").mapInArrow(_contents(length), CONTENTS)
    found = materialize(contents.groupBy("g1", "g2").applyInArrow(_shard(length), FOUND), "repeats")
    merged = found.where("slice >= 0").groupBy("value", "slice").applyInArrow(_merge, FOUND)
    return found.where("slice < 0").select("value", "d1", "d2", "starts", "stops").unionByName(
        merged.select("value", "d1", "d2", "starts", "stops"))


# -- stretches of texts ----------------------------------------------------------------------------------------

def _gram_hashes(data: np.ndarray, size: int, codes: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, from sums of byte codes times powers."""
    global _inverse
    n = len(data)
    if len(_inverse) < n:
        _inverse = np.full(max(n, 2 * len(_inverse)), _INV)
        _inverse[0] = 1
        _inverse = np.cumprod(_inverse, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[data] * powers(n)[:n], dtype=np.uint64, out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * _inverse[: n - size + 1])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every window of ``width``."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have:]) if have < width else x


def stretches(data: np.ndarray, length: int):
    """Stretches of one text, block by block: arrays of key, first start, number of starts, places of the key (2: two or more)."""
    width = length - GRAM + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        h = _gram_hashes(data[at: at + BLOCK + length - 1], GRAM, _CODES[0])
        low = _sliding(h, width, np.minimum)
        cut = np.flatnonzero(low[1:] != low[:-1]) + 1
        a = np.concatenate([[0], cut])
        b = np.concatenate([cut, [len(low)]])
        key = low[a]
        # a place is a key of some window that holds it, if it equals the largest of those windows' keys
        edge = np.zeros(width - 1, np.uint64)
        places = np.flatnonzero(h == _sliding(np.concatenate([edge, low, edge]), width, np.maximum))
        lo, hi = np.searchsorted(places, a), np.searchsorted(places, b + width - 1)
        seen = np.zeros(len(a), np.int32)
        todo = np.arange(len(a))
        while len(todo):
            seen[todo] += h[places[lo[todo]]] == key[todo]
            lo[todo] += 1
            todo = todo[(seen[todo] < 2) & (lo[todo] < hi[todo])]
        yield key, a + at, b - a, seen


def _stretches(length: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                data, off = text_bytes(part.column("text"))
                raw = data.tobytes()
                out = {k: [] for k in ("value", "a", "n", "anchors")}
                digests, at, count = [], [], []
                for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    if hi - lo < length:
                        continue
                    for key, a, n, seen in stretches(data[lo:hi], length):
                        for k, v in zip(out, (key, a, n, seen)):
                            out[k].append(v)
                        at.append(i)
                        count.append(len(a))
                        digests.extend(hashlib.blake2b(raw[s:e], digest_size=16).digest()
                                       for s, e in zip((a + lo).tolist(), (a + n + (lo + length - 1)).tolist()))
                if not at:
                    continue
                d = np.frombuffer(b"".join(digests), np.int64)
                of = pa.array(np.repeat(at, count))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(out["value"]).view(np.int64)), pa.array(d[0::2]), pa.array(d[1::2]),
                    part.column("id").take(of), part.column("h").take(of), pa.array(np.concatenate(out["a"]).astype(np.int32)),
                    pa.array(np.concatenate(out["n"]).astype(np.int32)), pa.array(np.concatenate(out["anchors"]))],
                    names=["value", "d1", "d2", "id", "h", "a", "n", "anchors"])
    return run


def _contents(length: int):
    """The asked stretches' bytes; each stretch once a task, if a row of the input repeats."""
    schema = pa.schema([("g1", pa.int64()), ("g2", pa.int32()), ("value", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("n", pa.int32()), ("copies", pa.bool_()), ("parts", pa.int32()), ("content", pa.binary())])

    def run(batches):
        done = None
        for batch in batches:
            for part in text_slices(batch):
                data, off = text_bytes(part.column("text"))
                raw, rows = data.tobytes(), []
                for lo, asked in zip(off[:-1].tolist(), part.column("asked").to_pylist()):
                    first = (asked[0]["value"], asked[0]["d1"], asked[0]["d2"])
                    if first == done:  # rows of one key follow each other in the join
                        continue
                    done = first
                    for r in asked:
                        rows.append(r | {"content": raw[lo + r["a"]: lo + r["a"] + r["n"] + length - 1]})
                        if len(rows) >= 20000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    return run


# -- suffix arrays ---------------------------------------------------------------------------------------------

def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes of joined texts in order (Larsson-Sadakane); ``left``: bytes from each place to its own text's end.

    A suffix ends with its text, and an ended suffix precedes its continuations; equal suffixes come in any order.
    """
    n = len(text)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    bits, small = int(len(used)).bit_length(), n < 1 << _IDX
    h = max(1, (63 - _IDX) // bits)
    head = np.zeros(n + h, np.uint64)
    head[:n] = code[text]
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = (key << np.uint64(bits)) | (head[j: j + n] * (left > j))
    sa, new = _sorted(key, np.arange(n, dtype=np.int32 if small else np.int64), small)
    rank = np.zeros(n + 1, sa.dtype)  # the last place stands for the end of a text
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1, dtype=sa.dtype), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True))).astype(sa.dtype)
    while True:
        p = sa[slots]
        going = left[p] >= h
        slots, p = slots[going], p[going]
        if not len(p):
            return sa
        nxt = rank[np.where(left[p] > h, p + sa.dtype.type(h), sa.dtype.type(n))]
        key = (rank[p].astype(np.uint64) << np.uint64(_IDX if small else 32)) | nxt.astype(np.uint64)
        p, new = _sorted(key, p, small)
        sa[slots] = p
        rank[p] = np.maximum.accumulate(np.where(new, slots + 1, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2


def _sorted(key: np.ndarray, places: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places by key, and where a new key begins. Keys of small texts leave room for the place and are sorted with it."""
    if small:
        key = (key << np.uint64(_IDX)) | places.astype(np.uint64)
        key.sort()
        places = (key & np.uint64((1 << _IDX) - 1)).astype(np.int32)
        key >>= np.uint64(_IDX)
    else:
        by = np.argsort(key, kind="stable")
        key, places = key[by], places[by]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return places, new


def common_prefixes(text: np.ndarray, left: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each slot of the array, the bytes that its suffix shares with the one before (0 for the first)."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)  # the neighbour is one behind that of the place before, and their bytes agree
    follows[1:] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (left[:-1] > 1)
    follows[1:] &= left[np.maximum(before[:-1], 0)] > 1
    follows[1:] &= text[:-1] == text[np.maximum(before[:-1], 0)]
    heads = np.flatnonzero(~follows)
    i, j = heads, before[heads]
    most = np.where(j >= 0, np.minimum(left[i], left[np.maximum(j, 0)]), 0).astype(np.int64)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    eight = np.ndarray(n + 8, np.dtype("<u8"), padded, 0, (1,)).copy()
    got = np.zeros(len(heads), np.int64)
    todo = np.flatnonzero(most > 0)
    while len(todo):
        at = got[todo]
        differ = eight[i[todo] + at] ^ eight[j[todo] + at]
        at += np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3  # equal bytes in front: 0 to 8
        got[todo] = at
        todo = todo[(differ == 0) & (at < most[todo])]
    at = np.zeros(n, np.int64)
    at[heads] = np.minimum(got, most) + heads
    return (at[heads][np.cumsum(~follows) - 1] - np.arange(n))[sa]


def _shard(length: int):
    """One shard: ranges of repeated starts per stretch and, where the key has more shards, slices of its distinct windows."""
    def run(table: pa.Table) -> pa.Table:
        key = {k: table.column(k).to_numpy() for k in ("value", "d1", "d2", "n", "copies")}
        by = np.lexsort((key["d2"], key["d1"], key["value"]))
        same = np.zeros(len(by), bool)
        same[1:] = np.logical_and.reduce([key[k][by][1:] == key[k][by][:-1] for k in ("value", "d1", "d2")])
        by = by[~same]
        value, d1, d2, n, copies = (key[k][by] for k in ("value", "d1", "d2", "n", "copies"))
        content = table.column("content").combine_chunks().take(pa.array(by))
        parts, part = table.column("parts")[0].as_py(), table.column("g2")[0].as_py()
        rows: list[dict] = []
        size = n.astype(np.int64) + (length - 1)
        # keys are whole in a shard, so texts may be cut between keys to stay small
        edge = np.flatnonzero(np.append(value[1:] != value[:-1], True)) + 1
        total = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(by):
            fit = edge[(edge > lo) & (total[edge] - total[lo] < 1 << _IDX)]
            hi = int(fit[-1] if len(fit) else edge[edge > lo][0])
            text, off = _joined(content.slice(lo, hi - lo))
            again, slots, lcp = repeated_starts(text, off, length)
            for r in range(lo, hi):
                if copies[r]:
                    again[off[r - lo]: off[r - lo] + n[r]] = True
            for r in range(lo, hi):
                mark = np.zeros(n[r] + 2, np.int8)
                mark[1:-1] = again[off[r - lo]: off[r - lo] + n[r]]
                step = np.diff(mark)
                if step.any():
                    rows.append(_found(value[r], d1[r], d2[r], np.flatnonzero(step == 1), np.flatnonzero(step == -1)))
            if parts:
                rows += _windows(text, off, again, slots, lcp, length, int(value[lo]), d1[lo:hi], d2[lo:hi], parts, part)
            lo = hi
        return pa.Table.from_pylist(rows, _FOUND)
    return run


_FOUND = pa.schema([("value", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())),
                    ("slice", pa.int32()), ("part", pa.int32()), ("prints", pa.binary()), ("refs", pa.binary())])


def _found(value, d1, d2, starts, stops, slice_=-1, part=-1, prints=b"", refs=b"") -> dict:
    return {"value": int(value), "d1": int(d1), "d2": int(d2), "starts": np.asarray(starts, np.int32), "stops": np.asarray(stops, np.int32),
            "slice": slice_, "part": part, "prints": prints, "refs": refs}


def _joined(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(content.cast(pa.large_binary()).view(pa.large_string()))


def repeated_starts(text: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which places begin a string of ``length`` bytes that another place begins too; the suffix array and its common prefixes."""
    left = (np.repeat(off[1:], np.diff(off)) - np.arange(len(text))).astype(np.int64)
    sa = suffix_array(text, left)
    lcp = common_prefixes(text, left, sa)
    shared = lcp >= length
    shared[:-1] |= shared[1:]
    again = np.zeros(len(text), bool)
    again[sa[shared]] = True
    return again, sa, lcp


def _windows(text, off, again, sa, lcp, length, value, d1, d2, parts, part) -> list[dict]:
    """The shard's distinct windows as sorted fingerprints, cut into one slice per shard of the key, with their places."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = off[row + 1] - np.arange(len(text)) >= length
    first = sa[(lcp < length) & whole[sa]]  # the first of each group of equal windows
    prints = np.empty((len(first), 2), np.uint64)
    for k in range(2):
        prints[:, k] = _gram_hashes(text, length, _CODES[k])[first]
    by = np.lexsort((prints[:, 1], prints[:, 0]))
    first, prints = first[by], prints[by]
    refs = np.empty(len(first), _REF)
    refs["d1"], refs["d2"], refs["at"], refs["known"] = d1[row[first]], d2[row[first]], first - off[row[first]], again[first]
    cuts = np.searchsorted(prints[:, 0], np.array([(k << 64) // parts for k in range(1, parts)], np.uint64))
    edges = [0, *cuts.tolist(), len(first)]
    return [_found(value, 0, 0, [], [], k, part, prints[a:b].tobytes(), refs[a:b].tobytes())
            for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


_REF = np.dtype([("d1", np.int64), ("d2", np.int64), ("at", np.int32), ("known", np.int32)])


def _merge(table: pa.Table) -> pa.Table:
    """One range of a key's windows: the sorted runs of its shards are looked up in their union by binary search."""
    runs = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in table.column("prints")]
    refs = np.concatenate([np.frombuffer(x.as_py(), _REF) for x in table.column("refs")])
    union = np.concatenate(runs)
    union = union[np.lexsort((union[:, 1], union[:, 0]))]
    same = np.append(np.append(False, (union[1:] == union[:-1]).all(axis=1)), False)
    shared = same[:-1] | same[1:]
    value = table.column("value")[0].as_py()
    meets = np.concatenate([shared[_lookup(union, r)] for r in runs])
    new = refs[meets & (refs["known"] == 0)]
    new = new[np.lexsort((new["at"], new["d2"], new["d1"]))]
    if not len(new):
        return _FOUND.empty_table()
    joins = (new["d1"][1:] == new["d1"][:-1]) & (new["d2"][1:] == new["d2"][:-1])
    begin = np.flatnonzero(np.append(True, ~(joins & (new["at"][1:] == new["at"][:-1] + 1))))
    end = np.append(begin[1:], len(new)) - 1
    return pa.Table.from_pylist([_found(value, new["d1"][s], new["d2"][s], [new["at"][s]], [new["at"][e] + 1]) for s, e in zip(begin.tolist(), end.tolist())], _FOUND)


def _lookup(union: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The place of each fingerprint of a run in the sorted union that holds it: binary search, then steps over equal first halves."""
    at = np.searchsorted(union[:, 0], run[:, 0])
    todo = np.flatnonzero(union[at, 1] != run[:, 1])
    while len(todo):
        at[todo] += 1
        todo = todo[union[at[todo], 1] != run[todo, 1]]
    return at


# -- removal ---------------------------------------------------------------------------------------------------

def _without(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
    for batch in batches:
        for part in text_slices(batch):
            data, off = text_bytes(part.column("text"))
            raw = data.tobytes()
            removed, spans, kept = [], [], []
            for lo, hi, cut in zip(off[:-1].tolist(), off[1:].tolist(), part.column("cut").to_pylist()):
                runs = []
                for r in sorted((c["lo"], c["hi"]) for c in cut or ()):
                    if runs and r[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r[1])
                    else:
                        runs.append(list(r))
                edges = [lo, *(lo + x for r in runs for x in r), hi]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append(sum(b - a for a, b in runs))
                spans.append([{"start": a, "stop": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()),
                                              pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)
