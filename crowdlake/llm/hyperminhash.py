"""Operator 2: near-duplicate documents by HyperMinHash sketches over word shingles.

A document's set is its distinct word shingles. Its sketch has ``REGISTERS`` buckets; a bucket's register holds, for the smallest shingle
hash that falls into it, the number of leading zeros and ``MANTISSA`` following bits. Bands of ``ROWS`` neighbouring registers are the keys under
which documents meet. In a band of which a set uses at most half, an empty register counts as the first used one in an order of its own
(densification), so that unrelated sets do not meet under the one or two registers that both use. A pair that met goes on if its estimated similarity, corrected for registers that agree by chance, is not far below
the threshold, and is confirmed on the full shingle sets. Components of the confirmed links give the groups.

Nothing is quadratic in a group of copies. Documents of one shingle set are one class from the start, and one of them
stands for it. In a band bucket every class first meets only the bucket's leader, its smallest id. What these links leave in
different components meets again, and only across components: in buckets of at most ``SMALL`` classes pair by pair; in larger ones under the
classes' rarest shingles: any pair over the threshold shares one that is within the short index prefix of one of them, so those that have it there
lead, a few of them a round and of different components first, until all have met the rest of their group; sizes and the shingles'
places in the order bound the intersection and spare most pairs. No candidate is dropped.

Defined results: words are runs of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z; with fewer words than a shingle
the whole sequence is the one shingle; a text that is null or has no word has an empty set and is linked with nothing. A null ``doc_id`` is
linked with nothing and is its own component (null), kept, a row for each such row. Rows that repeat a ``doc_id`` are one document that
links where any of its texts does, with the largest of their sets' sizes. Empty tables give no rows. Other input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, slices_returned
from .textbytes import LOWER, mix64, shingle_hashes, span_hashes, text_bytes, words

#: Bytes of text that are worked on at once.
SLICE = 1 << 20
REGISTERS, ROWS, MANTISSA = 240, 6, 10
#: Up to SMALL classes a band bucket is finished pair by pair. A group under a rare shingle has up to LEADERS leaders in the first round, GROW
#: times as many in each later one.
SMALL, LEADERS, GROW = 32, 16, 8
#: Slots in which shingles are counted to order them by rarity.
SLOTS = 1 << 18
#: Up to so many ids are broadcast to pick rows by; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes: per bucket ``(leading zeros + 1) << MANTISSA | mantissa`` of its smallest hash, 0 if empty."""
    out = np.zeros(REGISTERS, np.uint16)
    h = mix64(hashes ^ np.uint64(0xA0761D6478BD642F))
    bucket = ((h >> np.uint64(48)) * np.uint64(REGISTERS) >> np.uint64(16)).astype(np.int64)
    rest = h & np.uint64((1 << 48) - 1)
    low = np.full(REGISTERS, 1 << 48, np.uint64)
    np.minimum.at(low, bucket, rest)
    on = low < np.uint64(1 << 48)
    v = low[on].astype(np.float64)  # 48 bits are exact in a double
    m, e = np.frexp(np.maximum(v, 1))
    zeros = np.minimum(48 - e, 48).astype(np.uint16)
    mantissa = ((m * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    out[on] = ((zeros + np.uint16(1)) << np.uint16(MANTISSA)) | mantissa
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b) -> np.ndarray:
    """Similarity from sketches (rows of registers): the share of equal registers among those used by either, less the share
    that two unrelated sets of these sizes would show by chance."""
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    load = np.maximum(np.minimum(n_a, n_b) / REGISTERS, 1.0)
    chance = np.minimum(0.5, np.log2(load + 1) * 0.5 / (1 << MANTISSA) + 1.0 / (3 << MANTISSA))
    return np.maximum(0.0, (same / np.maximum(used, 1) - chance) / (1 - chance))


def _sets(col: pa.Array, size: int):
    """Per row the sorted distinct shingle hashes."""
    data, off = text_bytes(col)
    data = LOWER[data]
    starts, ends, split = words(data, off)
    h = span_hashes(data, starts, ends)
    for a, b in zip(split[:-1].tolist(), split[1:].tolist()):
        yield np.unique(shingle_hashes(h[a:b], size))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, class, sketch``: ``class`` is a 128-bit digest of the set (null for an empty one)."""
    def run(batches):
        import hashlib

        for batch in batches:
            for part in slices_returned(batch, max_bytes=SLICE):
                n, digest, sketch = [], [], []
                for s in _sets(part.column("text"), size):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sketch.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())],
                                                 names=["doc_id", "n_shingles", "class", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class binary, sketch binary")


def filled(reg: np.ndarray) -> np.ndarray:
    """Sketches (rows of registers) without empty registers: per register ``number << 16 | value`` of itself or, if it is empty, of the
    first used one in its own order. Two sets agree in any place as often as their smallest hashes do. Rows without a used register stay 0."""
    out = np.where(reg != 0, (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(16)) | reg, np.uint64(0))
    row, at = np.nonzero((reg == 0) & reg.any(1)[:, None])
    order = np.argsort(mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)
    for turn in range(REGISTERS):
        if not len(row):
            break
        source = order[at, turn]
        value = reg[row, source]
        on = value != 0
        out[row[on], at[on]] = (source[on].astype(np.uint64) << np.uint64(16)) | value[on]
        row, at = row[~on], at[~on]
    return out


def bands(reps: DataFrame) -> DataFrame:
    """``key, id, n`` for every band of a sketch that has a used register; ``n`` is the set's size."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            reg = sketch.reshape(-1, REGISTERS // ROWS, ROWS)
            few = (reg != 0).sum(2) <= ROWS // 2
            reg = np.where(few[:, :, None], filled(sketch).reshape(reg.shape), reg)
            key = np.zeros(reg.shape[:2], np.uint64)
            for k in range(ROWS):
                key = mix64(key + reg[:, :, k] + np.uint64(1))
            key = mix64(key ^ np.arange(reg.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            row, band = np.nonzero(reg.any(2))
            row_ = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key[row, band].view(np.int64)), batch.column("id").take(row_), batch.column("n_shingles").take(row_)], names=["key", "id", "n"])

    return reps.select("id", "sketch", "n_shingles").mapInArrow(run, "key long, id long, n long")


def _meetable(similarity: float):
    """Whether the sizes of a pair allow the similarity."""
    return F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6


def _shared(groups: DataFrame) -> DataFrame:
    """The rows of groups with two members or more, with the smallest id of the group as ``first``."""
    lead = groups.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    return groups.join(materialize(lead, "shared-keys", compact=True), "key")


def _leaders(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each group's smallest id with the others."""
    lead = shared.where("id = first").select("key", F.col("n").alias("n_a"))
    return (shared.where("id <> first").join(lead, "key").select(F.col("first").alias("a"), F.col("id").alias("b"), "n_a", F.col("n").alias("n_b"))
            .where(_meetable(similarity)).select("a", "b").distinct())


def _labelled(groups: DataFrame, label: DataFrame) -> DataFrame:
    """Members with their component so far, of the groups that hold more than one, and those groups' sizes."""
    named = groups.join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    still = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("key", "c")
    return named.join(still, "key")


def _within(named: DataFrame, similarity: float) -> DataFrame:
    """All pairs across components in groups of at most SMALL."""
    lists = named.where(F.col("c") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n", "component"))).alias("m"))
    pairs = F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> y.component <> x.component), "
                   "y -> struct(x.id as a, y.id as b, x.n as n_a, y.n as n_b))))")
    return lists.select(F.explode(pairs).alias("p")).select("p.*").where(_meetable(similarity)).select("a", "b").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def written_ids(ids: DataFrame, name: str) -> DataFrame:
    """Ids to pick rows by, written first; a join broadcasts them if their number allows."""
    ids = materialize(ids, name, compact=True)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _picked(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows whose ``id`` is among ``ids``."""
    return rows.join(written_ids(ids, name), "id", "left_semi")


def _near_enough(pairs: DataFrame, reps: DataFrame, similarity: float, slack: float) -> DataFrame:
    """Pairs whose estimated similarity is at most ``slack`` below the threshold."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("s_a", "s_b")]
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            ok = estimate(*s, n_a, n_b) >= similarity - slack
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union`` of the full sets, which are made again for the documents in question."""
    def run(batches):
        for batch in batches:
            for part in slices_returned(batch, max_bytes=SLICE):
                sets = [s.tobytes() for s in _sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "hashes"])

    sets = materialize(_picked(texts, _ends(pairs), "confirm-ids").mapInArrow(run, "id long, hashes binary"), "shingle-sets")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("h_a"), batch.column("h_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("h_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("h_b")), "b"))
    return both.select("a", "b", "h_a", "h_b").mapInArrow(check, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, slack: float = 0.2) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept`` (``kept``: it is its component's smallest id)."""
    similarity = percent / 100
    sk = materialize(sketches(docs, shingle), "sketches")
    # One row per class: its smallest document stands for it.
    known = sk.where("class is not null and doc_id is not null")
    reps = materialize(known.groupBy("class").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    texts = docs.select(F.col("doc_id").alias("id"), "text")

    def linked(pairs: DataFrame, name: str) -> DataFrame | None:
        """The confirmed ones of candidate pairs; None if there are none."""
        pairs = materialize(pairs, f"pairs-{name}", compact=True)
        if not pairs.limit(1).count():
            return None
        near = materialize(_near_enough(pairs, _picked(reps, _ends(pairs), f"sketch-ids-{name}"), similarity, slack), f"near-{name}", compact=True)
        if not near.limit(1).count():
            return None
        found = materialize(_confirm(near, texts, shingle, percent), f"links-{name}", compact=True)
        return found if found.limit(1).count() else None

    # Texts of one doc_id are one document.
    several = known.groupBy("doc_id").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("doc_id")
    links = (known.join(several, "doc_id").join(reps.select("class", "id"), "class").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))

    # A set so small that one shingle more or less is too much links with no other set.
    wide = reps.where(F.col("n_shingles") * 100 >= percent * (F.col("n_shingles") + 1))
    groups = materialize(_shared(materialize(bands(wide), "bands")), "shared-bands", compact=True)
    links = _more(links, linked(_leaders(groups, similarity), "leaders"))
    label = components(links, "near-dup")
    left = materialize(_labelled(groups.drop("first"), label), "open", compact=True)
    found = linked(_within(left, similarity), "small")
    if found is not None:
        links = _more(links, found)
        label = components(links, "near-dup")
    label = _finish_large(left, links, label, texts, linked, shingle, percent)

    rows = sk.join(reps.select("class", F.col("id").alias("node")), "class", "left").join(label, "node", "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
    out = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = out.unionByName(rows.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _more(links: DataFrame, found: DataFrame | None) -> DataFrame:
    return links if found is None else links.unionByName(found)


def _finish_large(left: DataFrame, links: DataFrame, label: DataFrame, texts: DataFrame, linked, shingle: int, percent: int) -> DataFrame:
    """Meet the pairs of large buckets that still lie in different components under their rarest shingles; returns the final labels."""
    similarity = percent / 100
    members = _labelled(left.where(F.col("c") > SMALL).select("key", "id", "n"), label)
    members = materialize(members.select("id", "n").distinct(), "open-members", compact=True)
    if not members.limit(1).count():
        return label

    mine = _picked(texts, members.select("id"), "open-ids")
    shift = np.uint64(64 - SLOTS.bit_length() + 1)

    def count(batches):
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices_returned(batch, max_bytes=SLICE):
                for s in _sets(part.column("text"), shingle):
                    seen += np.bincount((s >> shift).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "seen"])

    # Rarity: how often a shingle's slot occurs, one number for each of SLOTS slots whatever the corpus.
    rarity = np.zeros(SLOTS, np.int64)
    for r in mine.mapInArrow(count, "slot long, seen long").groupBy("slot").agg(F.sum("seen").alias("seen")).collect():
        rarity[r.slot] = r.seen

    def prefixes(batches):
        for batch in batches:
            for part in slices_returned(batch, max_bytes=SLICE):
                for i, s in enumerate(_sets(part.column("text"), shingle)):
                    n, d = len(s), rarity[(s >> shift).astype(np.int64)]
                    take = np.lexsort((s, d))[: n + (-n * percent) // 100 + 1]
                    at = np.arange(1, len(take) + 1)
                    leads = at <= n + (-n * 2 * percent) // (100 + percent) + 1
                    on = d[take] > 1
                    k = int(on.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(s[take][on].view(np.int64)), pa.array(np.full(k, part.column("id")[i].as_py(), np.int64)), pa.array(np.full(k, n, np.int64)),
                                                      pa.array(at[on]), pa.array(leads[on])], names=["key", "id", "n", "at", "leads"])

    # By rarity, a pair over the threshold shares a shingle that is in one's index prefix and in the other's longer probe prefix.
    prefix = materialize(mine.mapInArrow(prefixes, "key long, id long, n long, at long, leads boolean").distinct(), "prefix")
    still, met, most = prefix, None, LEADERS
    while True:
        todo = materialize(_labelled(still, label), "todo", compact=True)
        open_ = todo.where("leads") if met is None else todo.where("leads").join(met, ["key", "id"], "left_anti")
        # Some of a group's leaders meet the rest, of different components first. Chunks keep their choice off a single task.
        chunk = Window.partitionBy("key", F.expr("pmod(xxhash64(id), 64)")).orderBy("id")
        turn = Window.partitionBy("key", "component").orderBy("id")
        whole = Window.partitionBy("key").orderBy("turn", "id")
        lead = (open_.withColumn("r", F.row_number().over(chunk)).where(F.col("r") <= most).withColumn("turn", F.row_number().over(turn))
                .withColumn("r", F.row_number().over(whole)).where(F.col("r") <= most)
                .select("key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("component").alias("c_a")))
        lead = materialize(lead, "leaders", compact=True)
        if not lead.limit(1).count():
            return label
        # If this is the first shingle that a pair shares, the rest of the intersection lies behind both places.
        rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at")) + 1
        can = (F.col("component") != F.col("c_a")) & (rest * (100 + percent) >= percent * (F.col("n_a") + F.col("n")))
        star = todo.join(lead, "key").where(can & (F.least("n_a", "n") >= similarity * F.greatest("n_a", "n") - 1e-6))
        found = linked(star.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), "rare")
        if found is not None:
            links = _more(links, found)
            label = components(links, "near-dup")
        done = lead.select("key", F.col("a").alias("id"))
        met = materialize(done if met is None else met.unionByName(done), "met", compact=True)
        # A group goes on only while some of its leaders have not met the rest; one whose leaders all have makes no more pairs.
        turns = open_.groupBy("key").agg(F.count("*").alias("o")).join(lead.groupBy("key").agg(F.count("*").alias("p")), "key", "left")
        more = materialize(turns.where("p is null or o > p").select("key"), "unfinished", compact=True)
        if not more.limit(1).count():
            return label
        still = todo.select("key", "id", "n", "at", "leads").join(more, "key", "left_semi")
        most *= GROW
