"""Operator 4: mix sources to target weights by hierarchical budgets. DataFrame functions only.

Leaves are (domain, language, source). A token budget goes down the tree: at each node it is shared among the children by weight, no child getting more
than its subtree can give (its tokens times ``epochs``); what a short child cannot use goes to its siblings, and only what a whole subtree
cannot use goes to the siblings of its ancestors. All amounts are whole numbers. A leaf reads its documents in the seeded order of
epoch 1, then of epoch 2 and so on; whole epochs are taken while the budget covers them, then a prefix of the next.

A prefix is found without sorting a leaf: tokens are summed per leaf and leading digits of the order key, the running sums of these at most 65,536
rows name the one bucket in which the budget ends, and only that bucket's rows are ordered. Every other row is
decided by comparing its key with its leaf's cut.

Defined results: tokens are runs of characters outside 0x20 and 0x09-0x0D; null or empty text has none and goes wherever the prefix allows no further
tokens; null language, source and ``doc_id`` count as empty text; rows that repeat a ``doc_id`` share one key and are taken
together or not at all; documents with no tokens are taken whenever the prefix reaches them; weights of zero or less take nothing but such documents. Empty tables give no rows. All input
columns are kept; input columns named ``domain``, ``n_tokens`` or ``epoch`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """Sources whose names differ in the last character only form a domain."""
    return F.substring(source, F.lit(1), F.greatest(F.length(source) - 1, F.lit(0)))


def weight_of(column: str, weights: dict[str, int], other: int = 1) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(int(w))).otherwise(out)
    return out.cast("decimal(18,0)")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` (the parent's, on each row) among siblings: adds ``given``. Needs ``cap`` and ``weight``.

    Sorted by capacity per weight, the children that a proportional share would overfill come first; they are filled up and
    the others share what is left by weight.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), name)
    rows = (children.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0)).cast("decimal(18,0)"))
            .withColumn("weight", F.greatest("weight", F.lit(1).cast("decimal(18,0)")))
            .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(18,0)"))
            .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(18,0)"))
            .withColumn("full", F.col("cap") * F.col("open") <= F.col("weight") * (F.col("budget") - F.col("before")).cast("decimal(18,0)"))
            .withColumn("used", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(w), F.lit(0)).cast("decimal(18,0)"))
            .withColumn("rest", F.sum(F.when(~F.col("full"), F.col("weight"))).over(w).cast("decimal(18,0)")))
    share = F.expr("cast(weight * cast(budget - used as decimal(18,0)) div rest as decimal(18,0))")
    return rows.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("before", "open", "full", "used", "rest")


def _tagged(docs: DataFrame, text: str = "text") -> DataFrame:
    """Leaf names, token counts and the text form of the id, under names of their own."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select("*", domain_of(source).alias("_mix_domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_mix_lang"), source.alias("_mix_source"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("_mix_tokens"),
                       F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_mix_id"))


def budgets(leaves: DataFrame, tokens: int | None, part: tuple[int, int], epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict) -> DataFrame:
    """Per leaf (``tokens`` per leaf in): ``given``, the tokens it may give. The whole budget is ``tokens``, or ``part`` of all there are."""
    cap = leaves.select(*LEAF, "tokens", (F.col("tokens") * epochs).cast("decimal(18,0)").alias("cap"))
    langs = cap.groupBy("domain", "lang").agg(F.sum("cap").cast("decimal(18,0)").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("cap").cast("decimal(18,0)").alias("cap"), F.sum("tokens").alias("tokens"))
    whole = F.lit(int(tokens)) if tokens is not None else F.expr(f"(sum(tokens) over (partition by 0)) * {part[0]} div {part[1]}")
    top = fill(domains.withColumn("budget", F.least(whole.cast("decimal(18,0)"), F.sum("cap").over(Window.partitionBy(F.lit(0))).cast("decimal(18,0)"))).withColumn("weight", weight_of("domain", domain_weights)), [], "domain")
    mid = fill(langs.join(top.select("domain", F.col("given").alias("budget")), "domain").withColumn("weight", weight_of("lang", lang_weights)), ["domain"], "lang")
    low = fill(cap.join(mid.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"]).withColumn("weight", weight_of("source", source_weights)), ["domain", "lang"], "source")
    return low.select(*LEAF, "tokens", F.col("given").cast("long").alias("given"))


def mix(docs: DataFrame, tokens: int | None = None, part: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 0,
        domain_weights: dict | None = None, lang_weights: dict | None = None, source_weights: dict | None = None) -> DataFrame:
    """The selected rows of ``docs``, once per epoch in which they are taken, with ``domain``, ``n_tokens`` and ``epoch``."""
    keep = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    tagged = _tagged(docs.select(*keep))
    names = {f"_mix_{c}": c for c in [*LEAF, "tokens", "id"]}
    small = materialize(tagged.select(*[F.col(a).alias(b) for a, b in names.items()]), "mix-rows")
    leaves = small.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    given = materialize(budgets(leaves, tokens, part, epochs, domain_weights or {}, lang_weights or {}, source_weights or {})
                        .withColumn("whole", F.expr("if(tokens = 0, 0, given div tokens)")).withColumn("room", F.expr("if(tokens = 0, 0, given % tokens)")), "mix-budgets")
    # The bucket of order keys in which each leaf's last epoch ends, and the last key it takes there.
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole") + 1, "id"))
    keyed = small.join(given.select(*LEAF, "whole", "room"), LEAF).withColumn("key", key).withColumn("bucket", F.substring("key", 1, 4))
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("tokens").alias("sum"), F.first("room").alias("room"))
    upto = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 65,536 rows a leaf
    ends = (sums.withColumn("upto", F.sum("sum").over(upto)).where("upto > room")
            .groupBy(*LEAF).agg(F.min("bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("sum"), "bucket").alias("before")))
    inside = keyed.select(*LEAF, "bucket", "key", "tokens", "room").join(ends, [*LEAF, "bucket"])
    run = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("key")) + F.col("before")  # rows with one key together
    last = inside.withColumn("run", run).where("run <= room").groupBy(*LEAF).agg(F.max("key").alias("last"))
    cuts = given.join(ends.select(*LEAF, "bucket"), LEAF, "left").join(last, LEAF, "left")
    cuts = materialize(cuts.select(*[F.col(c).alias(f"_mix_{c}") for c in LEAF], F.col("whole").alias("_mix_whole"), "bucket", "last"), "mix-cuts")
    rows = tagged.join(cuts.withColumnRenamed("bucket", "_mix_bucket").withColumnRenamed("last", "_mix_last"), [f"_mix_{c}" for c in LEAF])
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_mix_whole") + 1, "_mix_id"))
    taken = F.col("_mix_bucket").isNull() | (order < F.col("_mix_bucket")) | F.coalesce(order <= F.col("_mix_last"), F.lit(False))
    rows = rows.withColumn("_mix_epochs", F.col("_mix_whole") + F.when(taken & (F.col("_mix_whole") < epochs), 1).otherwise(0)).where("_mix_epochs > 0")
    return rows.select(*keep, F.col("_mix_domain").alias("domain"), F.col("_mix_tokens").alias("n_tokens"), F.explode(F.expr("sequence(1L, _mix_epochs)")).alias("epoch"))


#: The production mixture of op4: half of all tokens, at most two epochs, English at twice the weight of each other language.
PRODUCTION = {"part": (1, 2), "epochs": 2, "seed": 20, "domain_weights": {"src": 3, "src1": 2}, "lang_weights": {"en": 2}, "source_weights": {"src0": 1}}

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         substr(coalesce(source, ''), 1, greatest(length(coalesce(source, '')) - 1, 0)) AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens, coalesce(CAST(doc_id AS VARCHAR), '') AS id
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * 2 AS HUGEINT) AS cap FROM d GROUP BY ALL),
lng AS (SELECT domain, lang, CAST(sum(cap) AS HUGEINT) AS cap, CAST(sum(tokens) AS HUGEINT) AS tokens FROM leaf GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap, CASE domain WHEN 'src' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END AS weight,
               CAST(sum(sum(tokens)) OVER () AS HUGEINT) // 2 AS budget FROM lng GROUP BY domain),
dom1 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(weight) OVER (ORDER BY cap::DOUBLE / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM dom),
dom2 AS (SELECT *, cap * open <= weight * (budget - before) AS full_ FROM dom1),
dom3 AS (SELECT domain, CAST(CASE WHEN full_ THEN cap ELSE (weight * (budget - coalesce(sum(cap) FILTER (full_) OVER (), 0))) // (sum(weight) FILTER (NOT full_) OVER ()) END AS HUGEINT) AS budget FROM dom2),
lng1 AS (SELECT l.domain, l.lang, l.cap, b.budget, CASE l.lang WHEN 'en' THEN 2 ELSE 1 END AS weight FROM lng l JOIN dom3 b USING (domain)),
lng2 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(weight) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM lng1),
lng3 AS (SELECT *, cap * open <= weight * (budget - before) AS full_ FROM lng2),
lng4 AS (SELECT domain, lang, CAST(CASE WHEN full_ THEN cap ELSE (weight * (budget - coalesce(sum(cap) FILTER (full_) OVER (PARTITION BY domain), 0)))
                // (sum(weight) FILTER (NOT full_) OVER (PARTITION BY domain)) END AS HUGEINT) AS budget FROM lng3),
leaf1 AS (SELECT l.*, b.budget, 1 AS weight FROM leaf l JOIN lng4 b USING (domain, lang)),
leaf2 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM leaf1),
leaf3 AS (SELECT *, cap * open <= weight * (budget - before) AS full_ FROM leaf2),
leaf4 AS (SELECT domain, lang, source, tokens, CAST(CASE WHEN full_ THEN cap ELSE (weight * (budget - coalesce(sum(cap) FILTER (full_) OVER (PARTITION BY domain, lang), 0)))
                 // (sum(weight) FILTER (NOT full_) OVER (PARTITION BY domain, lang)) END AS HUGEINT) AS given FROM leaf3),
plan AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE given // tokens END AS whole, CASE WHEN tokens = 0 THEN 0 ELSE given % tokens END AS room FROM leaf4),
keyed AS (SELECT d.*, p.whole, p.room, md5('20:' || CAST(p.whole + 1 AS VARCHAR) || ':' || d.id) AS key FROM d JOIN plan p USING (domain, lang, source)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed),
n AS (SELECT *, whole + CASE WHEN upto <= room AND whole < 2 THEN 1 ELSE 0 END AS epochs FROM run)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS n_tokens, CAST(e.epoch AS BIGINT) AS epoch
FROM n JOIN (SELECT unnest([1, 2]) AS epoch) e ON e.epoch <= n.epochs
"""
