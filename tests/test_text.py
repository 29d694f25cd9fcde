"""Golden rows of the question text and the target selection, and a plain twin of the scanner."""

import random

import pytest
from pyspark.sql import functions as F

from clipsieve.functions import text
from clipsieve.functions.vocab import ADJECTIVES, CLOTHING, PREPOSITIONS, QUANTITIES, Vocabulary
from clipsieve.operators import select
from clipsieve.plans import fixtures as fx

V = Vocabulary()


def mentions(spark, s):
    df = spark.createDataFrame([(s,)], "q string").select(text.entities(text.tokens(F.col("q")), V).alias("e"))
    return [(e["mention"], e["singular"], e["desc_key"], e["is_plural"], e["position"]) for e in df.first()["e"]]


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("the lady in the white dress", [("lady in white dress", "lady", "white", False, 1)]),
        ("two black dogs", [("black dogs", "dog", "black", True, 2)]),
        ("a man wearing a hat", [("man", "man", "", False, 1)]),
        ("one small dog", [("small dog", "dog", "small", False, 2)]),
        ("man in white dog", [("man in white", "man", "white", False, 0), ("white dog", "dog", "white", False, 3)]),
        ("the dog's ball", []),
        ("other young man with the red shirt", [("young man with red shirt", "man", "red", False, 2)]),
    ],
)
def test_entities(spark, question, expected):
    assert mentions(spark, question) == expected


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("is the dog happy", "dog"), ("why did the man jump", "man"), ("how many people are there", None), ("where is it", None),
        ("what does the old man do to the cat", "old man"), ("did the boy run why does the cat sit", "cat"),
    ],
)
def test_subject(spark, question, expected):
    df = spark.createDataFrame([(question,)], "q string").select(text.after_auxiliary(text.tokens(F.col("q"))).alias("t"))
    s = text.first_mention(df, "t", V).first()["s"]
    assert (s and s["mention"]) == expected


def test_selection(spark):
    qa = [
        ("a", "[CW] why did the man in white jump -> a ||| [TN] what did the man do -> b ||| [DC] how many dogs are there -> c"),
        ("b", "[CW] why did the dog run -> a ||| [TN] what did the black dog do -> b ||| [TN] what did the white dog do -> c ||| junk"),
        ("c", "[CW] why did people clap -> a ||| [TN] what does the cat do -> b"),
        ("d", "[DC] where is it -> a"),
        ("e", ""),
    ]
    grouped = spark.createDataFrame(qa, "video string, questions_and_answers string")
    got = {r["video"]: (r["prompt_word"], r["subject_question_count"], r["total_questions"], r["score"]) for r in select.prompt_select(grouped).collect()}
    assert got == {"a": ("man in white", 2, 3, 28), "b": ("black dog", 1, 4, 18), "c": ("cat", 1, 2, 10), "d": (None, None, 1, None), "e": (None, None, 1, None)}
    c = select.candidates(select.scored(select.merged(select.subjects(select.parse(grouped)))))
    rows = {v: [(r["entity"], r["score"]) for r in c.where(F.col("video") == v).orderBy("rank").collect()] for v in "abc"}
    assert rows == {"a": [("man(white)", 28)], "b": [("dog(black)", 18), ("dog(white)", 18), ("dog(generic)", 10)], "c": [("cat(generic)", 10), ("person(generic)", -15)]}


def twin(tokens):
    """The scanner as loops, from the written description."""
    out = []
    for i, noun in enumerate(tokens):
        if noun not in V.entities:
            continue
        adjectives, quantity = [], False
        for t in reversed(tokens[:i]):
            if t in ADJECTIVES:
                adjectives = [t, *adjectives]
            elif t in QUANTITIES:
                quantity = True
            else:
                break
        after = []
        if tokens[i + 1 : i + 2] and tokens[i + 1] in PREPOSITIONS:
            for t in tokens[i + 2 : i + 6]:
                if t in ADJECTIVES or t in CLOTHING:
                    after.append(t)
                elif t != "the":
                    break
        words = [*adjectives, noun, *([tokens[i + 1], *after] if after else [])]
        out.append((" ".join(words), V.plurals.get(noun, noun), (after or adjectives or [""])[0], noun in V.plurals or quantity, i))
    return out


def test_scanner_against_loops(spark):
    rng = random.Random(7)
    words = ["man", "dogs", "people", "white", "red", "old", "shirt", "hat", "in", "with", "the", "a", "one", "two", "many", "runs", "is"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string").select("i", text.entities(text.tokens(F.col("q")), V).alias("e"))
    for r in df.collect():
        got = [(e["mention"], e["singular"], e["desc_key"], e["is_plural"], e["position"]) for e in r["e"]]
        assert got == twin(texts[r["i"]].split()), texts[r["i"]]


def test_items_keep_unicode_and_first_arrow(spark):
    df = spark.createDataFrame([("v", "[é1] why so -> x -> y ||| [a b] no -> z ||| [T]q->r")], "video string, questions_and_answers string")
    assert [(r["qtype"], r["question"], r["answer"]) for r in select.parse(df).orderBy("q_idx").collect()] == [("é1", "why so", "x -> y"), (None, None, None), ("T", "q", "r")]


def test_first_subject_by_patterns(spark):
    """Patterns on a string say what tokens and lambdas say, on odd marks, spaces and orders too; and there is no lambda."""
    rng = random.Random(3)
    parts = [*"men dog person two several big white orange the in with wearing shirt is did do cat's 'dog' dog? \"men\" ?! . '. \"'? x.y DOG İs".split(), "", "..dog", "dog...x", "\u00a0", "\n", "\t", "\u0085", "\u2028"]
    joins = [" ", " ", " ", "  ", "\u2003", "\n"]
    rows = [(k, "".join(rng.choice(parts) + rng.choice(joins) for _ in range(rng.randrange(14)))) for k in range(3000)]
    rows += [(-1, None), (-2, ""), (-3, " "), (-4, "is"), (-5, "big " * 3000 + "dog in " + "white " * 3000)]
    df = spark.createDataFrame(rows, "k long, q string")
    for v in (Vocabulary(), Vocabulary(nouns=("dog", "white", "x.y"), plurals={}, adjectives=("white", "two", "big"), clothing=("shirt", "dog"))):
        old = df.select("k", text.tokens(F.col("q")).alias("t")).select("k", text.after_auxiliary(F.col("t")).alias("t"))
        want = {r["k"]: r["s"] for r in text.first_mention(old, "t", v).select("k", "s").collect()}
        got = text.first_subject(df, F.col("q"), v)
        assert {r["k"]: r["s"] for r in got.select("k", "s").collect()} == want
        assert sum(x is not None for x in want.values()) > 500
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_subjects_are_read_once(spark):
    """No filter repeats the pattern that finds a subject, in any query that builds on it; rows without one go or stay as asked."""
    grouped = spark.createDataFrame([("v", "[T] is the big dog in the white hat here -> a ||| [T] why -> b ||| no item"), ("w", "[T] where -> c")], "video string, questions_and_answers string")
    subs = select.subjects(select.parse(grouped))
    assert [(r["video"], r["q_idx"], r["mention"], r["position"], r["desc_key"]) for r in subs.collect()] == [("v", 0, "big dog in white hat", 3, "white")]
    chosen = select.prompt_select(grouped)
    assert sorted(tuple(r) for r in chosen.collect()) == [("v", "big dog in white hat", 1, 3, 18), ("w", None, None, 1, None)]
    clusters = select.scored(select.merged(subs))
    for df in (subs, select.cluster_counts(subs), clusters, select.candidates(clusters), chosen, select.coverage(chosen), select.noun_distribution(chosen)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("does|have") == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_go_along_with_the_items(spark):
    rows = [("none", "no ||| [TN] what is it -> x"), ("later", "no ||| [DC] where -> z ||| [TN] what does the dog do -> x"), ("first", "[TN] what does the dog do -> x ||| no"), ("empty", ""), ("null", None)]
    chosen = select.prompt_select(spark.createDataFrame(rows, "video string, questions_and_answers string"))
    got = {r["video"]: (r["prompt_word"], r["subject_question_count"], r["total_questions"]) for r in chosen.collect()}
    assert got == {"none": (None, None, 2), "later": ("dog", 1, 3), "first": ("dog", 1, 2), "empty": (None, None, 1)}
    assert "Window [max" not in _plan(chosen)


def test_mentions_are_aggregated_by_hashing(spark):
    subs = select.merged(select.subjects(select.parse(spark.createDataFrame([("v", "[TN] what does the red dog do -> x ||| [TN] what does the dog do -> x")], "video string, questions_and_answers string"))))
    assert "SortAggregate" not in _plan(select._mentions(subs))
    once = select.scored(subs, prompt=False)
    assert "SortAggregate" not in _plan(once.select(*select.CLUSTER, "cnt", "first_pos", "score"))
    assert once.collect() == select.scored(subs).select(*once.columns).collect()


def test_questions_are_dealt_by_video_before_they_are_packed(spark):
    plan = _plan(fx.qa(spark, "/root/testdata/sf0.001"))
    assert plan.index("partial_collect_list") < plan.index("REPARTITION_BY_COL") and "ENSURE_REQUIREMENTS" not in plan.split("REPARTITION_BY_COL")[0]


@pytest.mark.parametrize("q", ["a dog", "a  dog", " a dog ", "a \tdog", "a dog.", "'a dog", "a dög dog", "a dog", "dog\n"])
def test_odd_texts_are_read_as_their_tokens(spark, q):
    df = spark.createDataFrame([(q,)], "q string")
    want = text.first_mention(df.select(text.after_auxiliary(text.tokens(F.col("q"))).alias("t")), "t", V).first()["s"]
    assert text.first_subject(df, F.col("q"), V).first()["s"] == want
