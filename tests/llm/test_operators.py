"""Each operator on a small table with nulls, empty and blank texts, repeated rows and clashing columns, against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.llm import classifier, decontam, lm, mixing, ngram_join, quality_rules, substring, toxicity, url_filter, warc
from clipsieve.llm.common import small_batches
from clipsieve.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, size int, node string"
WORDS = "the of and to in a red green blue fast slow river stone cloud paper window garden music simple strange".split()


def make_docs():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [text(rng.randint(60, 200)) for _ in range(12)]
    passage = text(70)
    texts = [*base, base[0], base[1], None, "", " \n\t ", "one", "One", passage + " " + text(30), text(20) + "\n" + passage, "In. " * 400]
    near = base[2].split()
    near[5] = "changed"
    far = base[3].split()
    for k in range(0, len(far), 6):
        far[k] = f"w{k}"
    texts += [" ".join(near), " ".join(far), base[2].upper(), base[2]]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "é"][i % 4], 7, -i, "x", 1, "y") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (3, "another text of the same id", "en", "a", 1, 0, "", 0, ""), (None, base[4], "en", "a", 0, 0, "", 0, "")]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def grouped(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# quality rules


def base_measures(t):
    w = [x.decode() for x in words(t)]
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(docs, rows, none):
    out = quality_rules.judge(docs)
    got = grouped(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((r[0], *base_measures(r[1])) for r in rows)
    assert out.where("base_failed AND kept").isEmpty()
    assert quality_rules.judge(none).isEmpty()


def test_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    d = spark.createDataFrame([(p, q), (p, p), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "p array<double>, q array<double>").select(quality_rules.jensen_shannon(F.col("p"), F.col("q")))
    assert [round(r[0], 9) for r in d.collect()] == [round(math.sqrt((kl(p) + kl(q)) / 2), 9), 0.0, 1.0]


# n-gram Jaccard join


def brute_components(rows, n, percent):
    sets = defaultdict(list)
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]].append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return Counter((r[0], len(s), root(r[0]) if s else r[0]) for r, s in ((r, brute_set(r[1], n)) for r in rows) if r[0] is not None)


def brute_set(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 256), (5, 80, 2)])
def test_ngram_join(docs, rows, none, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    got = ngram_join.join(docs, n, percent)
    assert grouped(got.where("doc_id IS NOT NULL"), "doc_id", "n_shingles", "component_id") == brute_components(rows, n, percent)
    assert got.where("doc_id IS NULL").first()["component_id"] is None
    assert ngram_join.join(none, n, percent).isEmpty()


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        for _ in range(1500):
            size = int(rng.integers(1, 120))
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            apart = int(rng.integers(0, ngram_join.most_apart(size, percent) + 1))
            gone = int(rng.integers(0, apart + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, apart - gone).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if apart and 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
                assert np.intersect1d(ngram_join.signatures(a, percent), ngram_join.signatures(b, percent)).size


def test_search_equals_brute_force():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 40))).astype(np.uint64)) for _ in range(80)]
    sets += [np.unique(np.append(s[1:], np.uint64(99))) for s in sets[:40]]
    index, no_skip = ngram_join.Index(sets), np.zeros(len(sets), bool)
    for percent in (50, 80, 85):
        for q in sets:
            common = [len(np.intersect1d(q, s)) for s in sets]
            want = [k for k, s in enumerate(sets) if 100 * common[k] >= percent * (len(q) + len(s) - common[k])]
            assert index.search(q, percent, no_skip).tolist() == want


def test_short_lists_are_counted_without_skipped_sets():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3], [2, 3], [3, 4], [5])]
    found, counts = ngram_join.Index(sets)._merge(np.array([1, 2, 4]), np.array([False, True, False, False]))
    assert (found.tolist(), counts.tolist()) == ([0, 2, 3], [2, 1, 1])


def test_components(spark):
    e = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (7, 7), (None, 3), (40, 40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 40}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


# substring dedup


def brute_substring(rows):
    start = {}
    for i, t in sorted(((r[0], r[1]) for r in rows if r[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - 49):
            start.setdefault(tuple(w[k : k + 50]), i)
    out = Counter()
    for r in rows:
        w = words(r[1])
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if r[0] is not None and start[tuple(w[k : k + 50])] < r[0]:
                keep[k : k + 50] = [False] * 50
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out[r[0], len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bucket", [20_000, 1])
def test_substring(docs, rows, none, monkeypatch, bucket):
    monkeypatch.setattr(substring, "BUCKET_ROWS", bucket)
    assert grouped(substring.dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(rows)
    assert substring.dedup(none).isEmpty()


def test_strip_keeps_columns_and_lines(docs, rows):
    out = substring.strip(docs)
    assert out.columns == docs.columns
    removed = {(k[0], k[1]): k[2] for k in brute_substring(rows)}
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    for r in rows:
        if not removed[r[0], len(words(r[1]))]:
            assert (r[0], r[1]) in got
    assert not [r for r in got if r[0] in (12, 13)]  # copies lose all


# decontamination


def test_templates(spark):
    items = [(1, "Tom has 5 apples and gives Mary 3 apples so how many apples does he keep after 5 days?"), (2, "a b c"), (3, None), (4, "")]
    texts = {
        1: "x y. Ann said that Bob has 9 apples and gives Sue 4 apples so how many apples does he keep after 9 days? z",
        2: "so Tom has 5 apples and gives Mary 3 apples so how many apples does he keep after 5 days",
        3: "so Tom has 8 apples and gives Mary 3 apples so how many apples does he keep after 2 days?",
        4: "a b c", 5: None, 6: "", 7: "we say that many people like apples and give some of them to friends after some days or so",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["changed_slots"] for r in decontam.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2)}  # an item of three words, verbatim
    assert got[2, 1] == 0 and got[1, 1] > 0
    assert sorted(r[0] for r in decontam.clean(docs, bench).select("doc_id").collect()) == [3, 5, 6, 7]
    assert decontam.matches(docs, bench.limit(0)).isEmpty() and decontam.matches(docs.limit(0), bench).isEmpty()
    decontam_limit, decontam.BROADCAST_WINDOWS = decontam.BROADCAST_WINDOWS, 0
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()} == set(got)
        assert decontam.clean(docs, bench).count() == 4
    finally:
        decontam.BROADCAST_WINDOWS = decontam_limit


def found_in(item, *texts):
    b = decontam.Benchmark([(1, item)])
    return [bool(b.matches(t.encode())) for t in texts]


def test_case_of_copies():
    item = "Le marché où Élodie achète 5 pommes et où Tom vend 3 poires à côté du château est fermé"
    renamed = item.replace("Élodie", "Ángela").replace("Tom", "Bob").replace("5", "8")
    assert found_in(item, item.upper(), item.lower(), item.title(), renamed) == [True] * 4
    # Inconsistent names are no match in any form.
    item = "when Tom has five red apples and green pears then Tom sells all the sweet fruit to people who like apples"
    assert found_in(item, item.replace("Tom", "Ann"), item.replace("Tom", "Ann", 1).replace("Tom", "Bob")) == [True, False]


def test_one_edited_number():
    item = "a train with 12 wagons leaves the old station by the river and after it has lost 12 wagons it stops there"
    assert found_in(item, f"so {item}", item.replace("12", "13"), item.replace("12", "13", 1), item.replace("12", "13", 1).replace("12", "14")) == [True, True, True, False]


def test_items_without_plain_windows(spark):
    items = [
        "3 + 4 = 7 , 8 + 9 = 17 , 20 + 30 = 50 , 41 + 52 = 93",  # numbers
        "attended by Anna Schmidt, Bob Miller, Carla Gomez, Dan Brown, Eve Stone, Finn Wolf",  # names
        "Who wrote this book?",  # four words
        "Which river flows through seven old towns?",  # one window
    ]
    for item in items:
        assert found_in(item, f"we ask again {item} and so on", item, "we ask for other things and so on") == [True, True, False]
    # With another name, and the first word within a sentence.
    assert found_in("Where does Tom keep green apples and pears?", "we ask Where does Ann keep green apples and pears?") == [True]
    docs = spark.createDataFrame([(i, f"we ask again {t} and so on") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, i) for i in range(len(items))}
    limit = decontam.BROADCAST_WINDOWS
    try:
        for decontam.BROADCAST_WINDOWS in (limit, 0):
            assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()} == want
            assert decontam.clean(docs, bench).isEmpty()
    finally:
        decontam.BROADCAST_WINDOWS = limit


# mixing


def test_apportionment():
    rng = np.random.default_rng(1)
    for _ in range(300):
        votes, seats = rng.integers(0, 50, rng.integers(1, 12)).astype(float), int(rng.integers(0, 60))
        want = np.zeros(len(votes), int)
        for _ in range(seats if votes.sum() else 0):
            want[np.argmax(np.where(votes > 0, votes / (2 * want + 1), -1))] += 1
        assert (mixing.sainte_lague(votes, seats) == want).all()


def test_targets_refill():
    t = mixing.fill_targets(np.array([10, 1000, 1000]), np.array([3, 1, 2]))
    assert t[0] == 30 and abs(t.sum() - 2010) < 1e-6 and abs(t[2] - 2 * t[1]) < 1e-6
    assert mixing.fill_targets(np.array([0, 0]), np.array([1, 2])).tolist() == [0, 0]


def test_mix(docs, rows, none):
    out = mixing.mix(docs, shard_tokens=500)
    got = out.collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sum(len(words(x[1])) for x in rows if x[3] == r["source"])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = mixing.fill_targets(np.array([sizes[s] for s in order]), np.array([(1, 2, 3)[i % 3] for i in range(len(order))]))
    assert np.allclose([target[s] for s in order], want)
    assert all(abs(taken[s] - target[s]) < 0.2 * target[s] + mixing.BLOCK_TOKENS for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, shard_tokens=500).collect()))
    assert mixing.mix(none).isEmpty()


# language model


def test_base_score(docs, rows, none, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1000)
    got = lm.held_out_score(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for r in rows if not held(r[0]) for w in [*(r[1] or "").encode().lower().split(), b"\n"])
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for r in rows:
        w = [*(r[1] or "").encode().lower().split(), b"\n"]
        want[r[0]].append((len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    mine = defaultdict(list)
    for r in got:
        mine[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
        assert r["held_out"] == held(r["doc_id"]) and r["score"] < 0
    assert {k: sorted(x) for k, x in mine.items()} == {k: sorted(x) for k, x in want.items()}
    assert lm.held_out_score(none).isEmpty()


def test_block_counted_in_parts(spark, monkeypatch):
    # Rows of one id lie in one block, which is sent in parts.
    rows = [(1, f"common text {'zyxwvut'[k % 7]}{k} again {'qrs'[k % 3]}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = lm.score(docs, F.lit(True)).collect()
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 300)
    monkeypatch.setattr(lm, "small_batches", lambda s: small_batches(s, 5))
    got = lm.score(docs, F.lit(True)).collect()
    assert len(got) == 40 and all(r["n_known"] == r["n_tokens"] == 6 for r in got)
    counts = Counter(w for _, t in rows for w in [*t.split(), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    base = sorted(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*t.split(), "\n"]) for _, t in rows)
    assert sorted(r["base_score"] for r in got) == pytest.approx(base)
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(r["score"] for r in whole))


def test_lattice_sums_all_segmentations():
    with open(lm.VOCABULARY, "rb") as f:
        model = f.read()
    log_p = lm.piece_log_probabilities({300: 50, 400: 9}, model)
    lattice, pieces = lm.Lattice(model, log_p), {}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            pieces[sp.id_to_piece(i)] = math.exp(log_p[i])
    spell = lambda ch: math.prod(math.exp(lattice.byte[b]) for b in ch.encode())

    def total(s):
        if not s:
            return 1.0
        one = 0.0 if s[0] in pieces else spell(s[0]) * total(s[1:])
        return one + sum(pieces[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces)

    for w in ("river", "thinking", "naïve", "日本x", "𓀀a"):
        assert math.isclose(lattice.word(w.encode()), math.log10(total("▁" + w)), rel_tol=1e-9)


# classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        t = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        if toxic:
            t.insert(rng.randrange(len(t)), rng.choice(["idiot", "vekru" + rng.choice("abcdefgh"), "moron!"]))
        if not good:
            t = [x + "%%%" for x in t]
        rows.append((i, " ".join(t)))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "you 1d10t"), (1003, "idіot!"), (1004, None), (1004, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, labels, col):
    j = out.join(labels, "doc_id").where("held_out")
    return j.where(F.col("predicted") == F.col(col)).count() / j.count()


def test_short_items():
    b = decontam.Benchmark([(1, "Is it Paris?"), (2, "who wrote it"), (3, "Why?"), (4, "stone"), (5, "?!"), (6, ""), (7, None)])
    found = lambda t: [m[0] for m in b.matches(t.encode())]
    assert found("So they ask. IS IT Paris? Nobody knows who wrote it.") == [1, 2]
    assert found("is it in Paris? who once wrote it, why not, a stone wall") == [] and found("") == []
    assert found("A wall.\nstone\nWhy? Because.") == [3, 4] and found("Why") == [3] and found("is it paris") == [1]


def test_numbers_with_units_and_in_words():
    item = "A train carries 12 crates of 15kg each over 300 miles before it stops beside the river for water and coal"
    b = decontam.Benchmark([(1, item)])
    for text in (
        item.replace("12", "twelve"), item.replace("12", "forty-two"), item.replace("12", "twenty five"), item.replace("15kg", "15 kg"), item.replace("15kg", "90 kg"), item.replace("15kg", "15lb"), item.replace("300 miles", "300km"),
        item.replace("12", "seven").replace("15kg", "8g").replace("300", "two thousand"),
    ):
        assert [m[0] for m in b.matches(f"Some words stand before it. {text}, and some after.".encode())] == [1], text
    same = "The first box weighs 15kg and the second box weighs 15 kg as well so that both of them weigh as much"
    b = decontam.Benchmark([(1, same)])
    assert b.matches(same.replace("15", "20").encode()) and not b.matches(same.replace("15kg", "20kg").replace("15 kg", "30 kg").encode())
    t = decontam.Template(b"10kg\nten kg twenty five 3 4 Anna Berg")
    assert [int(k) for k in t.kinds[:4]] == [decontam.NUMBER, decontam.UNIT, decontam.SPELLED, decontam.UNIT] and len(t.tokens) == 8 and t.slot(2) == b"10" == t.slot(0) and t.slot(4) == b"20 5"


def test_recall_of_reparameterised_items():
    """Questions made anew with other numbers, spelled or not, other units, names and places of the parts: found; others: not."""
    rng = random.Random(21)
    names = [a + b for a in ("An", "Ber", "Cla", "Do", "El") for b in ("na", "ta", "ro", "min", "sek")]
    number = lambda: rng.choice(decontam.SPELLED_NUMBERS[:20]) if rng.random() < 0.3 else str(rng.randint(2, 999))
    unit = lambda: rng.choice(("kg", "g", "km", "miles", "hours", "dollars"))
    make = {"NUM": number, "UNIT": unit, "NAME": lambda: rng.choice(names), "FUSED": lambda: f"{rng.randint(2, 999)}{unit()}"}

    def frame():
        """Words with two slots in five places, never side by side, and the values of the slots."""
        out = []
        for _ in range(rng.randint(8, 18)):
            out += rng.choices(WORDS, k=2) if rng.random() < 0.4 else [rng.choice(WORDS), rng.choice(list(make))]
        return [(w, make[w]() if w in make else w) for w in [*out, rng.choice(WORDS), rng.choice(WORDS)]]

    def filled(f, anew=False):
        """With the values, or with others: equal ones of a kind become equal ones; some numbers part from their units."""
        other: dict[tuple[str, str], str] = {}
        out = []
        for kind, value in f:
            if anew and kind == "FUSED":
                n, u = re.fullmatch("([0-9]+)(.*)", value).groups()
                out.append(other.setdefault(("NUM", n), str(rng.randint(2, 999))) + rng.choice(("", " ")) + other.setdefault(("UNIT", u), unit()))
            else:
                out.append(other.setdefault((kind, value), make[kind]()) if anew and kind in make else value)
        return " ".join(out)

    frames = [frame() for _ in range(200)]
    items = [filled(f) for f in frames]
    b = decontam.Benchmark(list(enumerate(items)))
    copies = [f"The {' '.join(rng.choices(WORDS, k=20))}. {filled(f, anew=True)}. And {' '.join(rng.choices(WORDS, k=20))}." for f in frames]
    found = sum(k in [m[0] for m in b.matches(c.encode())] for k, c in enumerate(copies))
    assert found >= 180, found
    clean = sum(bool(b.matches(filled(frame()).encode())) for _ in range(300))
    assert clean == 0


def test_toxicity(labelled):
    docs, labels = labelled
    out = toxicity.classify(docs, labels).cache()
    assert out.count() == docs.count() and accuracy(out, labels, "toxic") > 0.95
    at = {r["doc_id"]: r["predicted"] for r in out.where("doc_id >= 1000").collect()}
    assert at == {1000: 0, 1001: 0, 1002: 1, 1003: 1, 1004: 0}
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.collect()} == {True}
    assert toxicity.classify(docs.limit(0), labels).isEmpty() and toxicity.classify(docs, labels.limit(0)).count() == docs.count()


def test_synonyms_that_stand_together(spark):
    """Four words always come in the same toxic rows: each stays a term; forms of a stem become one; an exception is of a term."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        t = [rng.choice(WORDS) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            for w in ("scum", "clown", "vile", "filth") if i % 6 == 0 else ("grobak" + rng.choice("abcdefghijklmnop"),):
                t.insert(rng.randrange(len(t)), w)
        elif i % 2:
            t[5:7] = ["circus", "clown"]
        rows.append((" ".join(t), int(toxic)))
    lexicon = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    assert {"scum", "vile", "filth"} <= set(lexicon.terms) and any(t.startswith("grob") and t.endswith("*") for t in lexicon.terms)
    assert not any(t.rstrip("*") in w for t in lexicon.terms for w in WORDS)
    assert all(any(t.rstrip("*") in e for t in lexicon.terms) for e in lexicon.exceptions)
    alone = [(k, f"the river and a {w} in the garden") for k, w in enumerate(("scum", "vile", "filth", "grobakz", "stone"))]
    hit = {r["doc_id"]: r["n_hits"] for r in toxicity.score(spark.createDataFrame(alone, "doc_id long, text string"), lexicon).collect()}
    assert hit == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_copies_count_once(spark):
    """A toxic text of 200 words stands there 300 times, each copy a word different: its words are no terms for that."""
    rng = random.Random(12)
    unique = [f"only{k}" for k in range(200)]
    rows = [(" ".join([rng.choice(WORDS) for _ in range(40)] + (["idiot"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(300)]
    rows += [(" ".join([*unique[:k % 200], "changed", *unique[k % 200:], "idiot"]), 1) for k in range(300)] + [("", 0), (None, 0), ("one", 0), ("one", 0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row long, text string, label int").repartition(3)
    kept = toxicity.without_copies(df)
    assert 300 < kept.count() < 330 and kept.where("text LIKE 'only0 %'").count() < 20
    assert set(toxicity.fit(kept).terms) == {"idiot"}


def test_terms_that_stand():
    n = {"clown": (0, 120), "clow*": (0, 120), "clo*": (30, 122), "grobaka": (0, 15), "grobakb": (0, 14), "grobak*": (0, 90), "grob*": (0, 91), "rare*": (0, 12)}
    assert toxicity.standing(n, 3000, 400) == ["clown", "grobak*", "rare*"]


def test_exceptions():
    a = toxicity.Lexicon({"trash": 2.0, "sta*": 1.0}, ["trash can"]).automaton()
    of = lambda t: [h[0] for h in toxicity.hits(a, toxicity.fold(t))]
    assert of("the trash can") == [] and of("TR4SH, $tar") == ["trash", "sta*"] and of("trashy instar") == []


def test_classifier(labelled):
    docs, labels = labelled
    out = classifier.classify(docs, labels).cache()
    assert out.count() == docs.count() and accuracy(out, labels, "quality") > 0.95
    assert out.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    again = {(r["doc_id"], round(r["score"], 6)) for r in classifier.classify(docs.repartition(5), labels.repartition(3)).collect()}
    assert again == {(r["doc_id"], round(r["score"], 6)) for r in out.collect()}
    assert classifier.classify(docs.limit(0), labels).isEmpty()


# pages


def test_warc(spark):
    html = {3: "<p>é</p>", 1: "x\r\n\r\ny", 2: "x\r\n\r\ny", 5: None, 4: "", 9: "WARC/1.1\r\n", 8: "<p>é</p>"}
    pages = spark.createDataFrame([(i, None if i == 9 else f"http://h{i}.org/a?b", h, "clash") for i, h in html.items()], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    first = {}
    for i in sorted(html):
        data = (html[i] or "").encode()
        f = first.setdefault(data, i)
        assert got[i] == (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    whole = {r["page_id"]: r for r in warc.round_trip(pages, min_bytes=5, with_payload=True).collect()}
    assert whole[5]["record_type"] == whole[4]["record_type"] == "response" and whole[8]["refers_to"] == 3
    assert bytes(whole[1]["response"]["payload"]) == b"x\r\n\r\ny" and whole[1]["request"]["target_uri"] == "http://h1.org/a?b"
    one = whole[1]
    assert one["request"]["record_id"] != one["response"]["record_id"] and one["revisit"] is None and {f["key"]: f["value"] for f in one["metadata"]["fields"]} == {"pageId": "1", "payloadBytes": "6"}
    assert whole[8]["response"] is None and whole[8]["revisit"]["refers_to"] == whole[3]["response"]["record_id"]
    assert warc.round_trip(pages.limit(0)).isEmpty()
    twice = warc.round_trip(pages.where("page_id = 3").unionByName(pages.where("page_id = 3")))
    assert sorted(r[0] for r in twice.select("record_type").collect()) == ["response", "revisit"]


def test_url_rules(spark):
    urls = [
        "http://A.Example.ORG/en/1x?q", "https://example.org/es/1", "http://x.com/fr/a#b", "http://com/de/", "http://notexample.net", None, "no scheme", "http://org/?x", "http://org", "http://badorg/", "http://a.example.org/es",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.example.org", "/en/1x", "example.org/en/1", "block")
    assert got[1] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("x.com", "/fr/a", "com/fr/", "allow") and got[3] == ("com", "/de/", "com/de/", "block")
    assert got[4][:3] == ("notexample.net", "", None) and got[5][:3] == ("", "", None) == got[6][:3]
    assert got[7] == ("org", "/", "org/", "allow") and got[8][:3] == ("org", "", None) and got[9][2] is None and got[10][2] == "org/"
    assert url_filter.judge(pages.limit(0)).isEmpty()
    # Repeated rows, a null id and a very long URL are rows like others.
    odd = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.com/de/1"), (2, "http://a.net/" + "x/" * 50_000)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("tokens", F.lit(1))
    assert sorted(r["verdict"] for r in url_filter.judge(odd).collect()) == ["allow", "allow", "allow", "block"]


def test_mined_rules(spark):
    rows = [(["host:casino", "tld:com", f"path:p{i}"], "label:block") for i in range(20)] + [(["host:news", "tld:com", f"path:p{i}"], "label:allow") for i in range(20)]
    rules = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert {(r.tokens, r.verdict) for r in rules} == {(("host:casino",), "block"), (("host:news",), "allow")}
    pages = spark.createDataFrame([(1, ["host:casino", "x"], "", "", None), (2, ["tld:com"], "", "", None)], "page_id long, tokens array<string>, host string, path string, rule string")
    assert {r["page_id"]: r["mined"] for r in url_filter.verdicts(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_mining_against_all_combinations(spark):
    """Every rule that counting all combinations gives, and no other; long URLs of one pattern don't explode."""
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        t = sorted({f"path:{rng.choice('abcdefg')}" for _ in range(4)})
        rows.append((t, "label:block" if ("path:a" in t and "path:b" in t) or rng.random() < 0.05 else "label:allow"))
    got = {(r.tokens, r.verdict): (r.confidence, r.support) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), min_support=0.02)}
    every = {}
    for size in (1, 2, 3):
        for own in combinations([f"path:{c}" for c in "abcdefg"], size):
            fits = [label for t, label in rows if set(own) <= set(t)]
            for label in url_filter.LABELS:
                k = fits.count(label)
                if k and k / len(rows) >= 0.02 and k / len(fits) >= url_filter.MIN_CONFIDENCE:
                    every[own, label.removeprefix("label:")] = (k / len(fits), k / len(rows))
    want = {}
    for (own, verdict), (confidence, support) in sorted(every.items(), key=lambda x: len(x[0][0])):
        if not any(set(o) < set(own) and c >= confidence for (o, _), (c, _) in want.items()):
            want[own, verdict] = (confidence, support)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))
    long = [([f"path:{k}" for k in range(40)], "label:block")] * 50 + [(["tld:org"], "label:allow")] * 50
    assert {r.verdict for r in url_filter.mine(spark.createDataFrame(long, "tokens array<string>, label string"))} == {"allow", "block"}


def test_no_token_is_cut_before_mining(spark):
    """Rows of more tokens than FP-growth takes: a rule of tokens that say little each, behind many that say more."""
    rng = random.Random(4)
    rows = []
    for k in range(600):
        a, b, block = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.05
        block = block or (a and b)
        telling = [f"path:t{i:02d}" for i in range(20) if rng.random() < (0.62 if block else 0.4)]
        rows.append((telling + ["key:a"] * a + ["key:b"] * b, url_filter.LABELS[block]))
    assert max(len(t) for t, _ in rows) > url_filter.BASKET_TOKENS + 2
    got = {r.tokens: (r.verdict, r.confidence) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05)}
    assert got["key:a", "key:b"] == ("block", 1.0)
    short = [(t[:3] + t[-2:], label) for t, label in rows]
    df = spark.createDataFrame(short, "tokens array<string>, label string")
    by_growth = url_filter.mine(df, 0.05)
    items = url_filter._baskets(df, len(short), 0.05)
    counted = {(tuple(r["tokens"]), r["label"], r["confidence"], r["support"]) for r in url_filter._counted(items, len(short), 0.05, 0.8).collect()}
    assert by_growth and {(r.tokens, f"label:{r.verdict}", r.confidence, r.support) for r in by_growth} <= counted


def brute_mined(have, rules, default="allow"):
    fits = [r for r in rules if set(r.tokens) <= set(have)]
    return max(fits, key=lambda r: (r.confidence, r.support, r.tokens)).verdict if fits else default


def test_mined_verdicts_of_urls(spark):
    """Pages under /de/ of com are blocked by rule; so pages under /de/ of other hosts come to be blocked, too."""
    rng = random.Random(5)
    urls = [f"http://h{rng.randint(0, 9)}.{tld}/{lang}/{k}" for k, (tld, lang) in enumerate((t, x) for t in ("com", "net", "info") for x in ("de", "fr") for _ in range(40))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    p = url_filter.parsed(pages)
    rules = url_filter.mine(url_filter._labelled(p, None))
    for r in p.collect():
        want = r["given"] or brute_mined(r["tokens"], rules)
        assert out[r["page_id"]]["verdict"] == want and (out[r["page_id"]]["mined_by"] is None or r["rule"] is None)
    assert {out[k]["verdict"] for k, u in enumerate(urls) if "/de/" in u} == {"block"}
    lift = url_filter.held_out_lift(pages).first()
    assert lift["right"] == lift["pages"] > lift["constant"]
    more = spark.createDataFrame([(k, "block") for k, u in enumerate(urls) if ".net/fr" in u], "page_id long, label string")
    blocked = [r for r in url_filter.judge(pages, more).collect() if r["host"].endswith("net") and r["path"].startswith("/fr")]
    assert {r["verdict"] for r in blocked} == {"block"}


def test_pipeline(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of the kind stands in any of these small texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path)).cache()
        assert out.columns == at.columns and out.count() <= at.count()
        at = out
    assert pipeline.run(spark, str(tmp_path)).count() == at.count()
