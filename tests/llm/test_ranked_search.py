"""Ranked search against scoring every document, trees against plain arrays."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in items:
        query = set(terms(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t in query if (df := sum(t in c for _, c in counts))}
        found = []
        for i, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def make(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.9)) % 300}" for _ in range(400)] + ["É", "é", "İx", "ß", "x y", "A1", "a1"]
    text = lambda: rng.choice([" ", "-", "\n", "/"]).join(rng.choice(words) for _ in range(rng.randint(1, 60)))
    docs = [(rng.randint(-40, 3 * n), text()) for _ in range(n)]
    docs += [(i, docs[3][1]) for i in range(1000, 1040)] + [docs[5]] * 3  # copies: many equal scores
    docs += [(None, docs[7][1]), (None, docs[7][1]), (1, None), (2, ""), (3, " .,;"), (4, "w1 " * 30_000 + "w7 é")]
    items = [(k, text()) for k in range(25)] + [(30, docs[3][1]), (31, None), (32, "none-of-these here"), (33, ""), (34, docs[7][1]), (34, docs[7][1]), (None, "A1 é w1"), (35, "w1 " * 500)]
    return docs, items


@pytest.mark.parametrize("shard_docs", [1, 7, 1 << 16])
def test_ranked(spark, monkeypatch, shard_docs):
    docs, items = make(250)
    # The limits of shards count where tasks are planned, so that small ones can be set here.
    monkeypatch.setattr(rs, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(rs, "STEP", 3)
    monkeypatch.setattr(rs, "QUERY_BYTES", 2_000)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("docs", "terms", "first", "score", "rank", "item", "query", "q")}).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("item", "block", "n", "doc_id")})
    assert Counter(tuple(r) for r in rs.ranked(d, q).collect()) == brute(docs, items)


def test_shards_and_one_best(spark, monkeypatch):
    docs, items = make(300, seed=9)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    small = {r["n_docs"] for r in rs.postings(d.coalesce(1), limits=(10**9, 5, 10**9)).collect()}
    assert max(small) == 5
    assert Counter(tuple(r) for r in rs.ranked(d, q, k=1).collect()) == brute(docs, items, 1)


def test_empty_tables(spark):
    docs, items = make(20)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rs.ranked(d.limit(0), q).isEmpty() and rs.ranked(d, q.limit(0)).isEmpty() and rs.ranked(d.where("text = ''"), q).isEmpty()


def test_tree():
    """Ranks, impacts by level and the documents that intervals lead to."""
    rng = np.random.default_rng(3)
    for n_docs, n in ((1, 3), (2, 64), (5, 65), (300, 4_000)):
        doc = rng.integers(0, n_docs, n)
        impact = rng.integers(1, 1 << 20, n).astype(np.int32)
        tree = rs.Tree.of({"docs": list(range(n_docs)), "terms": b"a", "first": np.array([0, n], np.int32).tobytes(), "impacts": impact.tobytes(), "bits": rs.wavelet(doc, n_docs).tobytes()})
        seq, imp = doc, impact
        for level in range(tree.levels):
            bit = seq >> (tree.levels - 1 - level) & 1
            places = np.arange(n + 1)
            assert (tree.rank(np.full(n + 1, level), places) == np.concatenate([[0], np.cumsum(bit)])).all()
            assert (tree.impacts[level * n : (level + 1) * n] == imp).all() and tree.zeros[level] == (bit == 0).sum()
            seq, imp = (np.concatenate([x[bit == 0], x[bit == 1]]) for x in (seq, imp))


def test_subtrees_are_left_out():
    """A document far better than the others is found without expanding the whole tree."""
    n = 4_096
    impact = np.full(n, 10, np.int32)
    impact[0] = 1_000_000
    doc = np.concatenate([[77], np.setdiff1d(np.arange(n), [77])])
    tree = rs.Tree.of({"docs": list(range(n)), "terms": b"a", "first": np.array([0, n], np.int32).tobytes(), "impacts": impact.tobytes(), "bits": rs.wavelet(doc, n).tobytes()})
    ranks, rank = [], tree.rank
    tree.rank = lambda level, place: ranks.append(len(place)) or rank(level, place)
    best = []
    rs.search(tree, {b"a": 3}, 1, best, step=1)
    assert best == [((3_000_000, -77), 77)] and sum(ranks) < 8 * tree.levels
