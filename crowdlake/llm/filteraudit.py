"""How filters act on each other, over every order of applying them (operator 13).

Method: a Gray-code subset walk. Documents are counted into cells: one cell per part and per set of filters that the
document fails. Per part, the walk visits all subsets of the filters so that one filter is toggled at a time. Each
cell keeps the number of active filters that it fails; where the toggle takes that number from zero to one the cell's
documents leave the running survivors, where it takes it back to zero they return. The survivors of every subset
are stored (32 states for five filters), and each step of each order is a difference of two of them.

The cells come from Spark aggregations that combine before they shuffle; a part has at most 2^filters cells, so the walk reads one
bounded row per part, for all parts at once in Arrow batches. No order is replayed over documents.

Results for odd rows: a null text counts as empty, a null source is the part "" (together with empty sources), rows that
repeat count each. A document without a label, or with a null one, is neither good nor toxic; several labels of
one doc_id count if any says so. A null doc_id has no label, and its text repeats none (nothing is smaller or larger than
null). An empty table has no parts. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: What the audit counts for every step of an order.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures() -> dict[str, Column]:
    """The production filters as failure conditions on a column ``text`` (never null); E, the repeats, is added by ``audit``."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {"A": F.size(words) < 50,
            "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
            "C": 100 * capitals > 5 * F.length("text"),
            "D": F.col("text").rlike("[#$%&*|]")}


def audit(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, repeats: str | None = "E") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step and ``COUNTS``.

    ``fails``: failure conditions by one-letter name; ``repeats``: the name of the filter that a document fails if its
    text is that of a smaller doc_id (None: no such filter).
    """
    fails = failures() if fails is None else fails
    names = "".join(fails) + (repeats or "")
    cells = _cells(docs, labels, fails, repeats)
    rows = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(_orders(names), schema)


def _cells(docs: DataFrame, labels: DataFrame, fails: dict[str, Column], repeats: str | None) -> DataFrame:
    """Documents, good and toxic ones by part and mask of failed filters."""
    base = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0)).cast("int")
    facts = base.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    if repeats is None:
        again, bit = F.lit(False), 0
    else:
        facts, bit = materialize(facts, "facts"), 1 << len(fails)
        # only texts that repeat are joined; their first ids are few, and a hot text's documents are split by the join
        first = materialize(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"),
                            "first-ids", compact=True)
        facts = facts.join(first, "digest", "left")
        again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return (facts.join(marks, "doc_id", "left")
            .groupBy("part", (F.col("mask") + F.when(again, bit).otherwise(0)).alias("mask"))
            .agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")))


def survivors(cells: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of filters by a Gray-code walk: ``cells`` is (parts, 2^filters, kinds) counts by mask."""
    masks = np.arange(1 << filters)
    active = np.zeros(len(masks), np.int64)  # of each cell: failed filters that are on
    running = cells.sum(axis=1)
    states = np.empty_like(cells)
    states[:, 0] = running
    subset = 0
    for step in range(1, 1 << filters):
        bit = step & -step  # the filter that the Gray code toggles here
        subset ^= bit
        failing = (masks & bit) != 0
        if subset & bit:
            running = running - cells[:, failing & (active == 0)].sum(axis=1)
            active += failing
        else:
            active -= failing
            running = running + cells[:, failing & (active == 0)].sum(axis=1)
        states[:, subset] = running
    return states


def _orders(names: str):
    k = len(names)
    orders = ["".join(p) for p in permutations(names)]
    on = np.array([[1 << names.index(x) for x in o] for o in orders])
    after = np.cumsum(on, axis=1)
    before = after - on
    alone, rest, whole = on, (1 << k) - 1 - on, (1 << k) - 1

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cells = np.zeros((part.num_rows, 1 << k, 3), np.int64)
                for i, row in enumerate(part.column("cells").to_pylist()):
                    for c in row:
                        cells[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                s = survivors(cells, k)
                gone = s[:, before] - s[:, after]  # (parts, orders, steps, kinds)
                total = s[:, :1, 0, None]
                shapley = np.zeros((part.num_rows, 1 << k), np.int64)
                np.add.at(shapley, (slice(None), on.ravel()), gone[..., 0].reshape(part.num_rows, -1))
                columns = {
                    "kept": s[:, after, 0], "removed": gone[..., 0], "redundant": (total - s[:, alone, 0]) - gone[..., 0],
                    "unique_fails": s[:, rest, 0] - s[:, whole, 0][:, None, None], "good_lost": gone[..., 1], "toxic_lost": gone[..., 2],
                    "shapley": shapley[:, on]}
                yield pa.RecordBatch.from_arrays(
                    [part.column("part").take(pa.array(np.repeat(np.arange(part.num_rows), len(orders) * k))),
                     pa.array(np.tile(np.repeat(np.array(orders, dtype=object), k), part.num_rows), pa.string()),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows * len(orders)))]
                    + [pa.array(columns[c].ravel()) for c in COUNTS], names=["part", "filter_order", "step", *COUNTS])
    return run


OP13_SQL = """WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
firsts AS (SELECT text AS t, min(doc_id) AS first FROM docs GROUP BY 1),
marks AS (
  SELECT doc_id AS d, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
facts AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS f
  FROM words LEFT JOIN firsts ON text = t LEFT JOIN marks ON doc_id = d),
failed AS (
  SELECT part, good, toxic, [x FOR x IN ['A', 'B', 'C', 'D', 'E'] IF CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END] AS fs
  FROM facts),
cells AS (
  SELECT part, fs, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM orders, letters WHERE length(o) < 5 AND NOT contains(o, x)),
steps AS (
  SELECT o AS filter_order, s AS step, substr(o, s, 1) AS x, string_split(substr(o, 1, s - 1), '') AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s) WHERE length(o) = 5),
counted AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN NOT list_has_any(fs, before) AND NOT list_contains(fs, x) THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT list_has_any(fs, before) AND list_contains(fs, x) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN list_has_any(fs, before) AND list_contains(fs, x) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fs = [x] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT list_has_any(fs, before) AND list_contains(fs, x) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT list_has_any(fs, before) AND list_contains(fs, x) THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted"""
