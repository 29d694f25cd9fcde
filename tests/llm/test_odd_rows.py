"""Every operator and pipeline stage on a table of odd rows, and brute-force twins of verdicts, scores and updates."""

import math
import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.llm import classifier, decontam, lm, mixing, ngram_join, quality_rules, substring, toxicity, warc

WORDS = "the of and to in red green blue fast slow river stone cloud paper window garden music simple strange house".split()
#: Names that the operators use themselves.
CLASH = "id th row skey shard size block bucket node hub label words spans _id _th _key rest first open class component lang2 html2".split()


def make_rows():
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    long_one = text(60_000)
    same = text(80)
    rows = [(i, text(90 + i), ["en", "fr", None][i % 3], ["a", "b", None][i % 3]) for i in range(9)]
    rows += [(20, same, "en", "a"), (20, same, "en", "a"), (21, same, "en", "b"), (22, same.upper(), "en", "b"), (None, same, "en", None), (None, None, None, None)]
    return rows + [(30, long_one, "en", "a"), (31, long_one, "en", "b"), (32, "", "xx", ""), (33, " \t\n", None, "a"), (34, None, "en", "a"), (20, text(70), "en", "a")]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (20, 1, 0)], "doc_id long, quality int, toxic int")


def test_scores_and_measures(odd, rows, labels, monkeypatch):
    n = len(rows)
    monkeypatch.setattr(toxicity, "MIN_TERM_DOCS", 1)
    for out in (toxicity.classify(odd, labels), classifier.classify(odd, labels), lm.held_out_score(odd), quality_rules.judge(odd), mixing.mix(odd), substring.dedup(odd), ngram_join.join(odd, 4, 85)):
        got = out.collect()
        assert len(got) == n and sum(r["doc_id"] is None for r in got) == 2
    long_ones = [r for r in substring.dedup(odd).collect() if r["doc_id"] in (30, 31)]
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in long_ones} == {(30, 60_000, 0), (31, 60_000, 60_000)}
    classes = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.join(odd, 4, 85).collect()}
    assert classes[31, next(s for i, s in classes if i == 31)] == 30 and {c for (i, _), c in classes.items() if i in (21, 22)} == {20}
    assert {r["n_tokens"] for r in lm.held_out_score(odd).collect() if r["doc_id"] in (32, 33, 34)} == {1}


def test_stages_keep_columns(spark, odd, rows, labels):
    bench = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (None, "an item without id that stands in no text at all"), (2, None)], "item_id long, text string").withColumn("doc_id", F.lit(7))
    kept = quality_rules.keep(odd)
    judged = quality_rules.judge(odd).where("kept").count()
    assert kept.columns == odd.columns and kept.count() == judged
    first = ngram_join.keep_first(odd)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in first.collect())
    assert first.columns == odd.columns and (False, 21) not in ids and (False, 22) not in ids and (False, 31) not in ids
    # The repeated row of 20 goes once, its other text stays; empty rows and rows without id stay.
    assert ids.count((False, 20)) == 2 and ids.count((True, 0)) == 2 and {(False, k) for k in (32, 33, 34)} <= set(ids)
    stripped = substring.strip(odd)
    assert stripped.columns == odd.columns and {r["doc_id"] for r in stripped.collect()} >= {30, 32, 33, 34} and stripped.where("doc_id = 31").isEmpty()
    found = decontam.matches(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 1)} and len(found) == 2
    clean = decontam.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == len(rows) - 1


def test_empty_tables_of_stages(spark, odd):
    none, bench = odd.limit(0), spark.createDataFrame([(1, "some item of a benchmark")], "item_id long, text string")
    for out in (quality_rules.keep(none), ngram_join.keep_first(none), substring.strip(none), decontam.clean(none, bench), mixing.mix(none)):
        assert out.isEmpty()


def test_archives_of_odd_pages(spark, tmp_path):
    long_page = "x" * (9 << 20)
    rows = [(1, "http://a.org/\r\nb", "é" * 10), (1, "http://a.org/", "é" * 10), (None, None, None), (3, "", "\x00\r\n\r\nWARC/1.1"), (4, "http://b.org", long_page), (5, "http://c.org", long_page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(1))
    out = {(r["page_id"], r["record_type"]): r for r in warc.round_trip(pages, with_payload=True).collect()}
    assert set(out) == {(1, "response"), (1, "revisit"), (None, "response"), (3, "response"), (4, "response"), (5, "revisit")}
    assert out[5, "revisit"]["refers_to"] == 4 and out[5, "revisit"]["payload_bytes"] == 9 << 20
    assert bytes(out[4, "response"]["response"]["payload"]) == long_page.encode() and out[3, "response"]["response"]["payload"] == b"\x00\r\n\r\nWARC/1.1"
    assert {r["request"]["target_uri"] for r in out.values()} == {"http://a.org/%0D%0Ab", "http://a.org/", None, "", "http://b.org", "http://c.org"}
    warc.write(pages, f"file://{tmp_path}/archive")
    files = [p for p in (tmp_path / "archive").iterdir() if p.name.startswith("part-")]
    assert files and all(p.name.endswith(".warc.gz") for p in files)
    for p in files:
        data = p.read_bytes()
        kinds = [r["warc_type"] for r in warc.parse(data)]
        assert kinds[0] == "warcinfo" and kinds.count("request") == kinds.count("metadata") == len(kinds) // 3
        # A gzip member begins at every record.
        assert data.count(b"\x1f\x8b\x08") >= len(kinds)
    with pytest.raises(ValueError, match="within"):
        list(warc.parse(files[0].read_bytes()[:-9]))


def test_verdict_of_quality_rules(spark):
    rng = random.Random(2)
    common = quality_rules.COMMON_WORDS["en"]
    make = lambda share, n: " ".join(rng.choice(common) if rng.random() < share else rng.choice(WORDS[5:]) + str(rng.randint(0, 9)) for _ in range(n))
    rows = [(i, make(0.5, 120), "en") for i in range(15)] + [(20, make(0.0, 120), "en"), (21, "#" * 900 + " " + make(0.5, 100), "en"), (22, make(0.0, 40), "en"), (23, make(0.5, 5), "en"), (24, make(0.0, 90), "xx"), (25, None, "en")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def histograms(t, lang):
        kinds = dict.fromkeys(quality_rules.CLASSES, 0)
        for c in t:
            k = unicodedata.category(c)
            name = {"Ll": "lower", "Lu": "upper", "Nd": "digit"}.get(k) or ("space" if c in " \t\n\x0b\x0c\r" else "symbol" if c in quality_rules.SYMBOLS else "other")
            kinds[name] += 1
        w = t.split()
        counts = [w.count(x) for x in quality_rules.COMMON_WORDS.get(lang, [])]
        counts += [0] * (12 - len(counts)) + [len(w) - sum(counts)]
        return [v / max(1, len(t)) for v in kinds.values()], [c / max(1, len(w)) for c in counts]

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        return math.sqrt(max(0.0, sum(x * math.log2(x / y) for a in (p, q) for x, y in zip(a, m, strict=True) if x) / 2))

    base = {i: len((t or "").split()) >= 20 for i, t, _ in rows}
    good = [histograms(t, "en") for i, t, lang in rows if lang == "en" and base[i] and len(t) >= 100 and len(t.split()) >= 60]
    middle = []
    for k in (0, 1):
        m = [sorted(h[k][j] for h in good)[(len(good) + 1) // 2 - 1] for j in range(len(good[0][k]))]
        middle.append([x / sum(m) for x in m])
    for i, t, lang in rows:
        h = histograms(t or "", lang)
        far = lang == "en" and (len(t or "") >= 100 and distance(h[0], middle[0]) > quality_rules.MAX_CLASS_DISTANCE or len((t or "").split()) >= 60 and distance(h[1], middle[1]) > quality_rules.MAX_WORD_DISTANCE)
        assert got[i]["kept"] == (base[i] and not far), i
        if lang == "en" and t and len(t) >= 100:
            assert abs(got[i]["class_distance"] - distance(h[0], middle[0])) < 1e-9
    whole = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    part = quality_rules.judge(whole.where("doc_id >= 14"), reference=quality_rules.fit_references(whole))
    assert {r["doc_id"]: r["kept"] for r in part.collect()} == {i: got[i]["kept"] for i in got if i >= 14}
    assert got[0]["kept"] and not got[20]["kept"] and not got[21]["kept"] and got[22]["kept"] and got[24]["kept"]


def test_updates_of_the_classifier():
    """The proximal update written out coordinate by coordinate."""
    rng = np.random.default_rng(4)
    model = classifier.Ftrl()
    z, n = defaultdict(float), defaultdict(float)
    bias_z = bias_n = 0.0

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return (math.copysign(model.l1, z[i]) - z[i]) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(60):
        index = rng.choice(50, 8, replace=False).astype(np.int32)
        value, y, importance = rng.random(8).astype(np.float32).astype(float), int(rng.integers(0, 2)), float(rng.integers(1, 4))
        w = {int(i): weight(int(i)) for i in index}
        bias = -bias_z / ((model.beta + math.sqrt(bias_n)) / model.alpha)
        p = 1 / (1 + math.exp(-(sum(w[int(i)] * v for i, v in zip(index, value, strict=True)) + bias)))
        for i, v in zip(index.tolist(), value.tolist(), strict=True):
            g = (p - y) * importance * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * w[i]
            n[i] += g * g
        g = (p - y) * importance
        bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / model.alpha * bias
        bias_n += g * g
        model.update(index, value, y, importance)
    assert np.allclose(model.weights(np.arange(50)), [weight(i) for i in range(50)])


def test_sparse_dot_products(spark):
    rng = np.random.default_rng(6)
    weights = rng.normal(size=1 << classifier.BITS).astype(np.float32)
    texts = ["red green blue red", "", None, "É " * 30]
    got = {r["doc_id"]: r["score"] for r in classifier.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights, 0.25).collect()}
    for i, t in enumerate(texts):
        dense = np.zeros(1 << classifier.BITS)
        index, value = classifier.vector((t or "").encode())
        np.add.at(dense, index, value.astype(float))
        assert abs(got[i] - 1 / (1 + math.exp(-(dense @ weights.astype(float) + 0.25)))) < 1e-6


def test_lexicon_score_by_scanning(spark):
    lexicon = toxicity.Lexicon({"idiot": 2.0, "scum*": 1.5}, ["idiot proof"], -2.0)
    texts = ["you idiot", "an idiot proof lock", "1d10t and scumbags, scum!", "idiotic", "", None, "idiot " * 9 + "proof", "іdiot"]

    def brute(t):
        folded = toxicity.fold(t or "")
        words = folded.split()
        total = 0.0
        for term, w in lexicon.terms.items():
            forms, n = toxicity.fold_term(term), 0
            for at in range(len(folded)):
                for f in forms:
                    end = at + len(f)
                    if folded[at:end] != f or at and folded[at - 1].isalpha() or term[-1] != "*" and folded[end : end + 1].isalpha():
                        continue
                    inside = any(folded[k : k + len(e)] == e and k <= at and end <= k + len(e) for x in lexicon.exceptions for e in toxicity.fold_term(x) for k in range(max(0, at - 40), at + 1))
                    n += not inside
            total += w * min(n, toxicity.MAX_HITS)
        z = lexicon.bias + (total / toxicity.length_norm(len(words)) if total else 0.0)
        return 1 / (1 + math.exp(-z))

    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - brute(t)) < 1e-9, t
