"""Operator 8: best-fit packing by a configuration linear program over the length histogram.

Pieces of at most ``capacity`` tokens go into sequences of that size. Only the histogram of piece lengths (at most ``capacity``
numbers, whatever the corpus) reaches the driver. There a configuration, a multiset of lengths that fits one
sequence, is a column of the covering program "fewest configurations that hold every piece". Multiplicative weights solve it: each length
has a price, a knapsack dynamic program finds the dearest configuration at those prices, and prices of the lengths it
covers fall. The fractional multiplicities are rounded down; what remains is packed best fit, longest first; the best-fit plan of the whole histogram is
the incumbent that the rounded solution has to beat. Placing the pieces then needs no
further search: the r-th piece of a length has a place that follows from arithmetic on the plan.

Defined results: null or empty text is a document of the end id alone; a document longer than ``capacity`` is cut into ``capacity``
pieces, the first one shorter; repeated rows are documents of their own; an empty table gives no rows. Other input columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices
from .tokens import encoder, end_with


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every space up to ``capacity`` the dearest filling and the index of one length in it (-1: none):
    a dynamic program that puts one more piece into what the dearest filling of the rest leaves."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, w, "right"))
        best[w], last[w] = best[w - 1], -2  # -2: leave one token free
        if k:
            value = best[w - lengths[:k]] + price[:k]
            j = int(np.argmax(value))
            if value[j] > best[w]:
                best[w], last[w] = value[j], j
    return best, last


def filling(last: np.ndarray, lengths: np.ndarray, space: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while space > 0 and last[space] != -1:
        j = int(last[space])
        if j == -2:
            space -= 1
        else:
            out[j] = out.get(j, 0) + 1
            space -= int(lengths[j])
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 60, eps: float = 1.0,
          slack: float = 0.01) -> list[tuple[int, np.ndarray]]:
    """A plan that holds the histogram exactly: ``(copies, count of each length)`` per configuration.

    ``lengths`` ascend. Each round prices, by one dynamic program for all lengths, the dearest configuration that holds each
    length. Those within ``slack`` of the dearest of all enter the solution for a share of what their scarcest
    length still needs, rounded down to whole sequences; the share grows to one in the last round. A price is
    the length times ``exp(eps * share of the need still open)``, so what has been covered gets cheap. Best fit packs
    the few pieces that rounding leaves. Where best fit alone on the whole histogram needs no more sequences, its plan is taken.
    """
    need = np.maximum(counts.astype(float), 1)
    left = counts.astype(np.int64).copy()
    plan = []
    for r in range(rounds):
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        x = lengths[live]
        price = x / capacity * np.exp(eps * (left[live] / need[live] - 1))
        best, last = knapsack(price, x, capacity)
        value = price + best[capacity - x]
        order = np.argsort(-value, kind="stable")
        for j in order[value[order] >= (1 - slack) * value.max()].tolist():
            fill = filling(last, x, capacity - int(x[j]))
            fill[j] = fill.get(j, 0) + 1
            m = int(min(left[live[k]] // a for k, a in fill.items()) / (rounds - r) ** 0.5)
            if m > 0:
                c = np.zeros(len(left), np.int64)
                for k, a in fill.items():
                    c[live[k]] = a
                plan.append((m, c))
                left -= m * c
    plan += best_fit(lengths, left, capacity)
    plain = best_fit(lengths, counts.astype(np.int64), capacity)
    return min(plan, plain, key=lambda p: sum(m for m, _ in p))


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Best fit, longest first, on a histogram: groups of equal sequences, kept by the room they have left."""
    groups: dict[int, list] = {}  # room -> [copies, contents]
    for j in range(len(lengths) - 1, -1, -1):
        x, n = int(lengths[j]), int(counts[j])
        while n:
            room = min((r for r in groups if r >= x), default=None)
            if room is None:
                per = capacity // x
                for a, m in ((per, n // per), (n % per, 1)):
                    if a and m:
                        c = np.zeros(len(lengths), np.int64)
                        c[j] = a
                        groups.setdefault(capacity - a * x, []).append([m, c])
                break
            m, c = groups[room][-1]
            a = min(room // x, n)
            k = min(m, n // a)
            if k == m:
                groups[room].pop()
                if not groups[room]:
                    del groups[room]
            else:
                groups[room][-1][0] -= k
            c = c.copy()
            c[j] += a
            groups.setdefault(room - a * x, []).append([k, c])
            n -= a * k
    return [(m, c) for g in groups.values() for m, c in g]


def places(lengths: np.ndarray, plan: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each length its intervals of ranks: rows ``(first rank, per sequence, first sequence, offset)``."""
    rows: dict[int, list] = {int(x): [] for x in lengths}
    rank = dict.fromkeys(rows, 0)
    sequence = 0
    for m, c in plan:
        offset = 0
        for j in np.flatnonzero(c):
            x, a = int(lengths[j]), int(c[j])
            rows[x].append((rank[x], a, sequence, offset))
            rank[x] += m * a
            offset += a * x
        sequence += m
    return {x: np.array(r, np.int64).reshape(-1, 4) for x, r in rows.items() if r}


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, with_ids: bool = False) -> DataFrame:
    """Encode whole texts and cut them: ``doc_id, piece, start, length, ids_crc32, task, rank`` (and ``ids``), where ``rank`` numbers
    the pieces of one length that one task made. One pass, no shuffle."""
    def cut(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        enc = encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch):
                ids, splits = enc.encode(part.column("text"))
                if end_id is not None:
                    ids, splits = end_with(ids, splits, end_id)
                total = np.diff(splits)
                n = np.maximum(-(-total // capacity), 1)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = total - (n - 1) * capacity
                length = np.where(piece == 0, head[row], capacity)
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.searchsorted(ranked, ranked)
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                at = splits[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a: 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                cols = [part.column("doc_id").take(pa.array(row)).cast(pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start),
                        pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int64)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long" + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for). The pieces
    are written once; ranks within a length come from counts per task and length, so no length is gathered anywhere.
    """
    pieces = materialize(cut_documents(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    counts = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    hist = sorted(map(tuple, counts.groupBy("length").agg(F.sum("n").alias("n")).collect()))  # one row per length, at most capacity
    lengths = np.array([x for x, _ in hist], np.int64)
    where = places(lengths, solve(lengths, np.array([n for _, n in hist], np.int64), capacity))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                on = length == x
                rows = where[int(x)]
                k = np.searchsorted(rows[:, 0], rank[on], "right") - 1
                first, per, seq, off = rows[k].T
                sequence[on] = seq + (rank[on] - first) // per
                offset[on] = off + (rank[on] - first) % per * x
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return ranked.select(*cols, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")
