"""Operator 10: drop lines whose log template recurs across documents.

A line is parsed down a tree of fixed depth: its number of words, then its first ``DEPTH`` words, words with a digit or an ``@`` counting as
one variable field. In the leaf the rest of the line is compared field by field. The line's templates are the whole
masked line; the masked line with one of ``SEGMENTS`` runs of its other words generalised to a variable field; and the masked line with all
variable positions of its leaf generalised. A position is variable if the n different masked lines of the leaf have at least the square root
of n different words there; the template counts if at least half of the line's words stay in it. A template that occurs in two
documents or more recurs: its first occurrence (smallest ``doc_id``) stays, its lines in other documents are dropped. Every line with a word
has templates; those of lines of at most ``DEPTH`` words, which chance repeats, recur from ``SHORT_DOCUMENTS`` documents on.

Variable positions are counted in leaves of several different lines only; a bitmap of fixed size says which these are, and one leaf
more costs work only. The counts are sums over (leaf, position, word), so no task holds a leaf.

Counting a template needs its first line and its last document only, so it is summed before the shuffle, and a template that a
third of all lines share costs one row per task. Texts move once, to meet the lists of their dropped lines.

Defined results: null text stays null with no lines; blank lines stay; a null ``doc_id`` counts as one document that sorts first; rows that
repeat a ``doc_id`` are one document, so they drop nothing from each other; equal lines within one document stay. Empty tables give no rows. All input columns
are kept; input columns named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices_returned
from .textbytes import LOWER, mix64, powers, span_hashes, text_bytes, words

#: Bytes of text that are worked on at once.
SLICE = 1 << 20
DEPTH, SEGMENTS, LEAST_WORDS, GENERAL_WORDS = 3, 4, 1, 4
#: Documents in which a line of at most ``DEPTH`` words recurs.
SHORT_DOCUMENTS = 3
#: Bits of the map of leaves.
BITS = 1 << 26
_FIELD = np.zeros(256, bool)
_FIELD[[*range(0x30, 0x3A), 0x40]] = True
_VARIABLE = np.uint64(0x5851F42D4C957F2D)


def _parse(col: pa.Array):
    """Of a slice, per line with words: row, line number, first word, number of words, leaf hash, sum of its words' values; and the values."""
    data, off = text_bytes(col)
    data = LOWER[data]
    starts, ends, split = words(data, off)
    if not len(starts):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 3
    h = span_hashes(data, starts, ends)
    fields = np.concatenate([[0], np.cumsum(_FIELD[data])])
    h[fields[ends] > fields[starts]] = _VARIABLE
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    row = np.repeat(np.arange(len(off) - 1), np.diff(split))
    line = breaks[starts] - breaks[off[:-1]][row]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]))
    n = np.diff(np.append(first, len(h)))
    pos = np.arange(len(h)) - np.repeat(first, n)
    value = mix64(h + np.uint64(DEPTH)) * powers(int(n.max()))[pos]
    total = np.add.reduceat(value, first)
    leaf = np.add.reduceat(np.where(pos < DEPTH, value, np.uint64(0)), first) + n.astype(np.uint64)
    return row[first], line[first], first, n, leaf, total, value


def templates(first, n, leaf, total, value):
    """The lines' template hashes (flat, with splits): the masked line, and with each of its runs generalised."""
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    keys, has = [mix64(total + mix64(leaf))], [n >= LEAST_WORDS]
    pos = np.arange(len(value)) - np.repeat(first, n)
    segment = np.where(pos < DEPTH, -1, (pos - DEPTH) * SEGMENTS // np.maximum(np.repeat(n - DEPTH, n), 1))
    for j in range(SEGMENTS):
        part = np.add.reduceat(np.where(segment == j, value, np.uint64(0)), first)
        keys.append(mix64(total - part + mix64(leaf + np.uint64(j + 1))))
        has.append((n >= GENERAL_WORDS) & (np.add.reduceat((segment == j).astype(np.int64), first) > 0))
    has = np.stack(has, 1)
    return np.stack(keys, 1)[has], np.concatenate([[0], np.cumsum(has.sum(1))])


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, text_hash, line, leaf, keys``: every line with words; ``leaf`` is null where fewer than two positions may vary."""
    def run(batches):
        for batch in batches:
            for part in slices_returned(batch, max_bytes=SLICE):
                row, line, first, n, leaf, total, value = _parse(part.column("text"))
                if len(row):
                    keys, splits = templates(first, n, leaf, total, value)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column("doc").take(take), part.column("text_hash").take(take), pa.array(line.astype(np.int32)),
                                                      pa.array(mix64(leaf).view(np.int64), mask=n < DEPTH + 2),
                                                      pa.ListArray.from_arrays(pa.array(splits, pa.int32()), pa.array(keys.view(np.int64)))], names=["doc", "text_hash", "line", "leaf", "keys"])

    return _named(docs).mapInArrow(run, "doc long, text_hash long, line int, leaf long, keys array<long>")


def _leaf_map(lines: DataFrame) -> np.ndarray:
    """A bitmap of the leaves in which different lines of different documents meet."""
    leaves = lines.where("leaf is not null").groupBy("leaf").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.min(F.col("keys")[0]).alias("c"), F.max(F.col("keys")[0]).alias("d"))
    bit = leaves.where("a < b and c < d").select(F.pmod("leaf", F.lit(BITS)).alias("bit"))
    found = bit.groupBy(F.expr("bit div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _line_words(docs: DataFrame, leaves: np.ndarray) -> DataFrame:
    """``doc, text_hash, line, leaf, form, words``: the lines of the mapped leaves, with the hash of the masked line and those of its words behind the first."""
    def run(batches):
        for batch in batches:
            for part in slices_returned(batch, max_bytes=SLICE):
                row, line, first, n, leaf, total, value = _parse(part.column("text"))
                at = mix64(leaf)
                bit = np.mod(at.view(np.int64), BITS)
                on = (n >= DEPTH + 2) & ((leaves[bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)
                if on.any():
                    rest = n[on] - DEPTH
                    splits = np.concatenate([[0], np.cumsum(rest)])
                    flat = value[np.repeat(first[on] + DEPTH - splits[:-1], rest) + np.arange(splits[-1])]
                    take = pa.array(row[on])
                    yield pa.RecordBatch.from_arrays([part.column("doc").take(take), part.column("text_hash").take(take), pa.array(line[on].astype(np.int32)), pa.array(at[on].view(np.int64)),
                                                      pa.array(mix64(total[on] + mix64(leaf[on])).view(np.int64)),
                                                      pa.ListArray.from_arrays(pa.array(splits, pa.int32()), pa.array(flat.view(np.int64)))], names=["doc", "text_hash", "line", "leaf", "form", "words"])

    return _named(docs).mapInArrow(run, "doc long, text_hash long, line int, leaf long, form long, words array<long>")


def _varied_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc, text_hash, line`` of the lines whose template with all variable positions of the leaf generalised recurs."""
    each = materialize(_line_words(docs, _leaf_map(lines)), "line-words")
    forms = materialize(each.groupBy("leaf", "form").agg(F.first("words").alias("words"), F.min("doc").alias("first"), F.max("doc").alias("last")), "line-forms")
    sizes = forms.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    values = forms.select("leaf", F.posexplode("words").alias("pos", "word")).distinct().groupBy("leaf", "pos").agg(F.count("*").alias("d")).where("d > 1")
    variable = values.join(sizes, "leaf").where("d * d >= n").groupBy("leaf").agg(F.collect_set("pos").alias("variable"))  # positions of one line
    fixed = F.transform("words", lambda w, i: F.when(~F.array_contains("variable", i), w))
    general = forms.join(variable, "leaf").where(2 * F.size("variable") <= F.size("words") + DEPTH)
    general = materialize(general.select("leaf", "form", "first", "last", F.xxhash64("leaf", F.transform(fixed, lambda w: F.coalesce(w, F.lit(0)))).alias("key")), "line-general")
    recur = general.groupBy("key").agg(F.min("first").alias("since"), F.max("last").alias("last")).where("since < last").select("key", "since")
    drop = general.join(recur, "key").select("leaf", "form", "since")
    return each.select("doc", "text_hash", "line", "leaf", "form").join(drop, ["leaf", "form"]).where("doc <> since").select("doc", "text_hash", "line")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """``doc, text_hash, dropped``: the numbers of the lines to drop from each text that has any."""
    lines = materialize(_lines(docs), "line-templates")
    each = lines.select("doc", "text_hash", "line", (F.size("keys") == 1).alias("short"), F.explode("keys").alias("key"))  # every line with a word behind the first has several
    longer = each.where("not short").groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first")
    short = each.where("short").select("key", "doc").distinct().groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= SHORT_DOCUMENTS).select("key", "first")
    drop = each.join(longer.unionByName(short), "key").where("doc <> first").select("doc", "text_hash", "line")
    drop = drop.unionByName(_varied_lines(docs, lines))
    return drop.groupBy("doc", "text_hash").agg(F.collect_set("line").alias("dropped"))  # at most the lines of one text


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the recurring lines gone from ``text``, and ``n_lines`` and ``n_dropped``."""
    lists = recurring_lines(docs)
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    left = docs.select(F.struct(*cols).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64("text").alias("_hash"))
    both = left.join(lists.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("dropped").alias("_dropped")), ["_doc", "_hash"], "left")
    text = F.col("_row.text")
    parts = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_dropped"))
    cut = F.when(F.col("_dropped").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(parts, i + 1)), "\n"))
    return both.select(*[(cut if c == "text" else F.col("_row")[c]).alias(c) for c in cols],
                       F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
                       F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"))
