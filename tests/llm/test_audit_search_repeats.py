"""Operators 11 to 13 against brute force on small tables, with odd rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdlake.llm import filteraudit, lexical, queries, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# -- 11: repeated byte strings ---------------------------------------------------------------------------------

def without_repeats(texts: list[bytes], length: int) -> list[tuple]:
    """n_bytes, n_removed, n_spans and the digest of what is left, by a dictionary of all windows."""
    places: dict = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places.setdefault(t[p: p + length], []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for v in places.values():
        if len(v) > 1:
            for i, p in v:
                gone[i][p: p + length] = b"\1" * length
    return [(len(t), sum(g), sum(g[k] and not (k and g[k - 1]) for k in range(len(g))), hashlib.sha256(bytes(c for c, x in zip(t, g) if not x)).hexdigest())
            for t, g in zip(texts, gone)]


def repeated_texts(seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    passages = [prose(rnd.randint(20, 60)) for _ in range(5)]
    texts = [prose(rnd.randint(0, 90)) + (" " + rnd.choice(passages) + " " + prose(rnd.randint(0, 60)) if rnd.random() < 0.6 else "") for _ in range(70)]
    texts += texts[:8] + ["", None, "a" * 900, "abc" * 200, "x\x00" * 150, prose(200) * 2, "ab" * 50, "ab" * 49 + "a"]
    for _ in range(15):
        t = list(rnd.choice(texts[:70]))
        if t:
            t[rnd.randrange(len(t))] = "Q"
        texts.append("".join(t))
    hot = prose(30)
    return texts + [f"{prose(15)} {hot} {prose(15)}" for _ in range(40)]


@pytest.mark.parametrize("shard", [1 << 20, 3000])
def test_repeats_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD", shard)  # 3,000: keys of several shards, whose windows are merged
    ran = []
    if shard == 3000:
        plain = suffixes.materialize
        monkeypatch.setattr(suffixes, "materialize", lambda df, name, **k: ran.append((name, t := plain(df, name, **k))) or t)
    texts = repeated_texts()
    rows = [(i if i % 17 else None, t, "x", "y", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as value", "'h' as h", "2 as spans", "3 as id").repartition(5)
    out = suffixes.remove_repeats(docs, 100).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("k"))
    want = [(r[0], *x) for r, x in zip(rows, without_repeats([(t or "").encode() for t in texts], 100))]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert sum(x[2] for x in want) > 10000
    if ran:
        assert dict(ran)["repeats"].where("slice >= 0").count() > 2


def test_repeats_of_rows_and_empty_table(spark):
    long = "word " * 20 + "end of a text of its own that is long enough"
    docs = spark.createDataFrame([(1, long, None, None, 1)] * 3 + [(None, long, None, None, 1), (2, "short", None, None, 1)], SCHEMA)
    out = {tuple(r) for r in suffixes.remove_repeats(docs, 100).select("doc_id", "n_bytes", "n_removed", "kept").collect()}
    assert out == {(1, len(long), len(long), b""), (None, len(long), len(long), b""), (2, 5, 0, b"short")}
    assert suffixes.remove_repeats(docs.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs, 40)


@pytest.mark.parametrize("bits", [21, 6])
def test_suffix_array_and_common_prefixes(monkeypatch, bits):
    """Both sorting paths: with 6 bits every text counts as a large one."""
    monkeypatch.setattr(suffixes, "_IDX", bits)
    rnd = random.Random(bits)
    for _ in range(25):
        parts = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(1, 70))) for _ in range(rnd.randint(1, 6))]
        parts += rnd.sample(parts, 1) + [b"a" * 40]
        text = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        left = ends - np.arange(len(text))
        sa = suffixes.suffix_array(text, left)
        tails = [bytes(text[i: ends[i]]) for i in sa]
        assert sorted(sa.tolist()) == list(range(len(text))) and tails == sorted(tails)
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(tails, tails[1:])]
        assert suffixes.common_prefixes(text, left, sa).tolist() == shared


def test_stretches_cover_every_start_once_in_blocks(monkeypatch):
    rnd = random.Random(3)
    text = np.frombuffer((bytes(rnd.choice(b"abc") for _ in range(3000)) + b"z" * 700 + b"xy" * 400), np.uint8)
    for block in (1 << 20, 500):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        rows = list(suffixes.stretches(text, 100))
        starts = np.concatenate([np.repeat(a, n) + np.concatenate([np.arange(x) for x in n]) for _, a, n, _ in rows])
        assert starts.tolist() == list(range(len(text) - 99))
        keys = np.concatenate([np.repeat(k, n) for k, _, n, _ in rows])
        seen: dict = {}
        for p in range(len(text) - 99):  # equal windows have equal keys
            assert seen.setdefault(bytes(text[p: p + 100]), keys[p]) == keys[p]


# -- 12: ranked search -----------------------------------------------------------------------------------------

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    bags = [(i, PATTERN.findall((t or "").translate(LOWER))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(len(b) for _, b in bags)
    df: dict = {}
    for _, b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 25 + (75 * len(b) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * b.count(w)) // (1000 * b.count(w) + 8 * m))
                    for w in PATTERN.findall((text or "").translate(LOWER)) if w in df)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def prose_rows(n=300, seed=2):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x1", "日本", "of", "OF", "the", "The"]
    weights = [1 / (i + 1) for i in range(60)] + [0.05] * 4 + [1] * 4
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[9][1]), (2000, None), (2001, ""), (2002, " .,\x7f--"), (2003, "of " * 5000)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 25)))) for i in range(25)] + [(90, None), (91, ""), (92, "?!"), (93, "unseen terms only"), (94, "w3.W3,w3")]
    return docs, items


@pytest.mark.parametrize("size", [4 << 20, 400])
def test_search_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(lexical, "QUERY_BYTES", size)
    docs, items = prose_rows()
    table = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], SCHEMA).selectExpr("*", "1 as score", "2 as rank", "3 as item_id", "4 as n").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id", "6 as q")
    got = lexical.search(table, asked, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, ranked(docs, items)))


def test_search_on_empty_tables(spark):
    docs, items = prose_rows(20)
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(table.limit(0), asked).count() == 0
    assert lexical.search(table, asked.limit(0)).count() == 0


def test_blocks_are_skipped_only_below_exact_bounds(monkeypatch):
    """Small blocks in one process: every block's bound holds for its due documents, and fewer documents are scored than there are."""
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rnd = random.Random(4)
    n, v = 900, 80
    bags = [sorted(rnd.sample(range(v), rnd.randint(1, 12)) if i % 3 else rnd.sample(range(i % 20, i % 20 + 15), 9)) for i in range(n)]
    off = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    terms = np.concatenate([np.array(b) for b in bags]).astype(np.int32)
    tfs = np.array([rnd.randint(1, 4) for _ in terms], np.int64)
    df = np.bincount(terms, minlength=v)
    order = sorted(range(v), key=lambda t: (df[t], t))
    places = np.empty(v, np.int32)
    places[order] = np.arange(v)
    weights = np.array([lexical.weight(n, int(df[t])) for t in order], np.int64)
    row = {"ids": np.arange(n).tobytes(), "none": np.zeros(n, bool).tobytes(), "n": np.full(n, 20, np.int64).tobytes(), "off": off.astype(np.int64).tobytes(),
           "terms": terms.tobytes(), "tfs": tfs.tobytes()}
    shard = lexical.Shard.build(row, places, weights, n, 20 * n)
    assert sorted(shard.members.tolist()) == sorted(np.repeat(np.arange(n), np.diff(off)).tolist())
    scored = []
    plain = lexical.Shard.scores
    monkeypatch.setattr(lexical.Shard, "scores", lambda self, d, dense: scored.append(len(d)) or plain(self, d, dense))
    dense = np.zeros(v, np.int64)
    for _ in range(40):
        at = np.array(sorted(rnd.sample(range(v), 8)))
        docs, score = shard.top(at, weights[at], dense, 1, 10)
        dense[at] = weights[at]
        every = plain(shard, np.arange(n), dense)
        dense[at] = 0
        assert score[:10].tolist() == sorted(every[every > 0].tolist(), reverse=True)[:10]
        assert all(every[d] == s for d, s in zip(docs, score))
    assert sum(scored) < 0.7 * 40 * n


# -- 13: filter audit ------------------------------------------------------------------------------------------

def replayed(docs, labels):
    good, toxic = {}, {}
    for d, q, t in labels:
        if d is not None:
            good[d], toxic[d] = good.get(d, False) or q == 1, toxic.get(d, False) or t == 1
    first: dict = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    fails = []
    for d, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {x for x, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                           bool(re.search("[#$%&*|]", t)), d is not None and d > first[t])) if bad}
        fails.append(f)
    out = []
    for part in {s or "" for _, _, s in docs}:
        rows = [(d, f) for (d, _, s), f in zip(docs, fails) if (s or "") == part]
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                steps.append([part, order, step, len(left), len(gone), sum(x in f for _, f in rows) - len(gone), sum(f == {x} for _, f in rows),
                              sum(good.get(d, False) for d, _ in gone), sum(toxic.get(d, False) for d, _ in gone)])
        total = {x: sum(s[4] for s in steps if s[1][s[2] - 1] == x) for x in "ABCDE"}
        out += [tuple(s) + (total[s[1][s[2] - 1]],) for s in steps]
    return out


def audit_rows():
    rnd = random.Random(8)
    words = ["alpha", "Beta", "GAMMA", "d#", "é", "ÉÉ", "a", "b", "x|y", " ", "q"]
    texts = [rnd.choice([" ", "\x0b", "\n\t"]).join(rnd.choices(words[: rnd.randint(1, 11)], k=rnd.randint(0, 90))) for _ in range(120)]
    texts += [" ".join(f"word{i}" for i in range(60))] * 3 + ["", None, "A", "\x00#"] + texts[:20]
    docs = [(i if i % 31 else None, t, rnd.choice(["s0", "s0", "s1", "", None])) for i, t in enumerate(texts)] + [(5, texts[5], "s1")] * 3
    labels = [(rnd.randrange(140), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1), (5, 1, 0), (5, 0, 1)]
    return docs, labels


def test_audit_equals_replay(spark):
    docs, labels = audit_rows()
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as good", "2 as mask", "3 as part", "4 as quality", "5 as digest").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as source")
    got = filteraudit.audit(table, marks)
    assert got.columns == ["part", "filter_order", "step", *filteraudit.COUNTS]
    assert sorted(map(tuple, got.collect())) == sorted(replayed(docs, labels))
    assert filteraudit.audit(table.limit(0), marks).count() == 0
    assert filteraudit.audit(table, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_other_filters(spark):
    """Two filters of the caller's and no repeats: 2 orders of 2 steps."""
    docs = spark.createDataFrame([(1, "a", None), (2, "ab", None), (3, "b", None), (4, "", None)], "doc_id long, text string, source string")
    got = filteraudit.audit(docs, spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int"),
                            {"X": F.col("text").contains("a"), "Y": F.col("text").contains("b")}, repeats=None)
    assert sorted(map(tuple, got.collect())) == [("", "XY", 1, 2, 2, 0, 1, 1, 1, 3), ("", "XY", 2, 1, 1, 1, 1, 0, 0, 3),
                                                 ("", "YX", 1, 2, 2, 0, 1, 1, 1, 3), ("", "YX", 2, 1, 1, 1, 1, 0, 0, 3)]


def test_registered_queries_on_a_small_folder(spark, tmp_dir):
    """The contracts' columns and parameters, against the plain versions."""
    docs, labels = audit_rows()
    spark.createDataFrame([(d, t, None, s, 1) for d, t, s in docs], SCHEMA).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    items = [(1, "alpha beta word3 word9"), (2, "gamma q q")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    got = {k: queries.QUERIES[k](spark, tmp_dir) for k in ("op11_suffix_array_dedup", "op12_blocked_lexical_search", "op13_filter_interaction_audit")}
    assert got["op11_suffix_array_dedup"].columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = {k: sorted(map(str, map(tuple, v.collect()))) for k, v in got.items()}
    assert rows["op11_suffix_array_dedup"] == sorted(str((d, *x)) for (d, _, _), x in zip(docs, without_repeats([(t or "").encode() for _, t, _ in docs], 400)))
    assert rows["op12_blocked_lexical_search"] == sorted(map(str, ranked([(d, t) for d, t, _ in docs], items)))
    assert rows["op13_filter_interaction_audit"] == sorted(map(str, replayed(docs, labels)))
