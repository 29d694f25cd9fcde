"""The corpus pipeline against a plain version of its stages, one after the other, on a small table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.llm import quality_rules
from clipsieve.llm.mixing import fill_targets

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COMMON = quality_rules.COMMON_WORDS["en"]
RARE = [f"{a}{b}" for a in ("stone", "river", "cloud", "paper", "garden", "window", "music", "horse") for b in ("house", "wood", "land", "field", "light", "song", "way", "side")]
ITEM = "a farmer has seven brown horses and buys four more at the fair so how many horses does he have when he comes home"


def make_rows():
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(COMMON) if rng.random() < 0.45 else rng.choice(RARE) for _ in range(n))
    base = [text(rng.randint(90, 200)) for _ in range(24)]
    passage = text(60)
    near = base[1].split()
    near[3] = near[70] = "changed"
    other = base[2].split()
    for k in range(0, len(other), 7):
        other[k] = f"w{k}"
    texts = [*base, base[0], base[0].upper(), " ".join(near), " ".join(other), f"{text(40)} {passage} {text(30)}", f"{text(25)}\n{passage} {text(35)}", passage, f"{text(30)} {ITEM} {text(30)}", ITEM.upper() + " " + text(60)]
    texts += ["# $ % " * 60, "one two three", "same old line here now again once more " * 12, "", None]
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, text(80), "en", "a", 1)]


def words(t):
    return (t or "").split()


def shingle_set(t, n=5):
    w = [x.lower() for x in words(t)]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def plain_near_duplicates(rows):
    kept = []
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    label = {i: i for i in sets}
    again = True
    while again:
        again = False
        for a in sets:
            for b in sets:
                if label[a] > label[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a], again = label[b], True
    for r in dict.fromkeys(rows):
        if r[0] is None or label[r[0]] == r[0]:
            kept.append(r)
    return kept


def plain_passages(rows):
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(r[1])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if r[0] is not None and first[tuple(w[k : k + 50])] < r[0]:
                keep[k : k + 50] = [False] * 50
        left = [x for x, y in zip(w, keep, strict=True) if y]
        if left or not w:
            out.append((r[0], " ".join(left), *r[2:]))
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = make_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # The rules' verdicts have a plain version of their own in test_odd_rows.
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.judge(docs).collect()}
    left = [r for r in rows if verdict[r[0], len(words(r[1]))]]
    assert len(left) < len(rows)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, str(tmp_path))
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if verdict[r["doc_id"], len(words(r["text"]))])
    left = plain_near_duplicates(left)
    got = stages["n-gram Jaccard join"](spark, kept, str(tmp_path))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(left, key=key)
    left = plain_passages(left)
    got = stages["substring dedup"](spark, got, str(tmp_path))
    assert sorted(((r["doc_id"], " ".join(words(r["text"]))) for r in got.collect()), key=key) == sorted(((r[0], " ".join(words(r[1]))) for r in left), key=key)
    assert got.where("n_chars <> length(text)").isEmpty()
    left = [r for r in left if ITEM not in r[1].lower()]
    got = stages["benchmark decontamination"](spark, got, str(tmp_path))
    assert sorted(((r["doc_id"], " ".join(words(r["text"]))) for r in got.collect()), key=key) == sorted(((r[0], " ".join(words(r[1]))) for r in left), key=key)
    out = corpus_pipeline.run(spark, str(tmp_path))
    size = {}
    for r in left:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, fill_targets(np.array([size[s] for s in order]), np.array([1 + k % 3 for k in range(len(order))])), strict=True))
    result = [tuple(r) for r in out.select("doc_id", "size", "source", "source_size", F.round("target", 6)).collect()]
    assert sorted(result, key=str) == sorted(((r[0], len(words(r[1])), r[3], size[r[3]], round(float(targets[r[3]]), 6)) for r in left), key=str)
    taken = {}
    for r in out.collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 64 for s in order)
    again = {(r["doc_id"], r["size"]): r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {(r["doc_id"], r["size"]): r["taken"] for r in out.collect()}
