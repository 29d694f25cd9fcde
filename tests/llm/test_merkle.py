"""The Merkle manifest against trees grown level by level, on odd rows and with runs and rounds so short that all are used."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clipsieve.llm import entry, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        if i ^ 1 < len(level):
            out.append(("L" if i & 1 else "R", level[i ^ 1]))
        else:
            out.append(("S", ""))
        i >>= 1
    return out


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        leaf = h(*map(field, r))
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf, r))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            path = siblings(trees[g], i) + siblings(top, k)
            d = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                d = h(*map(field, (*r[:3], r[3] + 1, r[4])))
            for side, s in path:
                d = h(s, d) if side == "L" else h(d, s)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(*(s for _, s in path)), d, d == top[-1][0]))
    return out


def odd_rows(n):
    rng = random.Random(n)
    rows = [(rng.randint(-50, 4 * n), rng.choice(["a", "b", None, "é"]), "en" if rng.random() < 0.6 else rng.choice(["de", "fr", "", None]), rng.choice([None, 0, 17, -3, 2**63 - 1]), rng.choice(["", None, "text é", " \n", "long " * 30_000])) for _ in range(n)]
    return [*rows, rows[0], rows[0], (None, None, None, None, None), (None, "a", "en", 3, "x"), (7, "s", "xx", 1, "alone in its lang")]


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("n", [1, 60, 400])
def test_manifest(spark, monkeypatch, n):
    """Runs of 8 and rounds of 3 and 2 levels, so that each path is put together from several rounds."""
    monkeypatch.setattr(merkle, "RUN", 8)
    monkeypatch.setattr(merkle, "FIRST_LEVEL", 3)
    monkeypatch.setattr(merkle, "MORE_LEVELS", 2)
    rows = odd_rows(n)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "tag", "digest", "size", "start", "level")}).repartition(5)
    out = merkle.manifest(docs, lambda i: F.pmod(F.crc32(i.cast("string")), F.lit(7)) == 0, with_path=True)
    assert result(out) == Counter(brute(rows))
    for r in out.collect():
        if r["verified"]:
            assert merkle.fold(r["leaf"], r["path"]) == r["root"]
        elif r["path"].strip("S"):
            assert merkle.fold(r["leaf"], r["path"]) == r["root"] != r["folded_root"]


def test_one_round_and_empty_table(spark):
    rows = odd_rows(150)
    docs = spark.createDataFrame(rows, SCHEMA)
    tampered = lambda i: F.pmod(F.crc32(i.cast("string")), F.lit(7)) == 0
    assert result(merkle.manifest(docs, tampered)) == Counter(brute(rows))
    assert merkle.manifest(docs.limit(0), tampered).isEmpty()
    # Nothing is tampered with: every row verifies.
    assert merkle.manifest(docs, lambda i: F.lit(False)).where("NOT verified").isEmpty()


def test_partials_in_any_order():
    """Whatever the order of events and merges, a combiner ends with the same root; a missing digest leaves it partial."""
    rng = random.Random(1)
    for size in (1, 2, 3, 7, 64, 65, 100):
        leaves = [h(str(i)) for i in range(size)]
        tree = levels(leaves)
        nodes = list(enumerate(leaves))
        rng.shuffle(nodes)
        parts = [merkle.Partial(size, merkle.height(size)) for _ in range(4)]
        for i, d in nodes:
            rng.choice(parts).arrive(0, i, d)
        whole = merkle.Partial(size, merkle.height(size))
        for p in parts:
            whole.merge(p)
        assert [t[2] for t in whole.tops] == tree[-1] and not whole.pending
        for i, d in enumerate(leaves):
            assert merkle.fold(d, whole.path(0, i)) == tree[-1][0]
        if size > 1:
            short = merkle.Partial(size, merkle.height(size))
            for i, d in nodes[1:]:
                short.arrive(0, i, d)
            assert short.pending and not short.tops


def test_query(spark):
    out = entry.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert result(out) == Counter(brute(rows))
