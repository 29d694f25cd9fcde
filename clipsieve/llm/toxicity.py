"""Toxicity by a weighted lexicon: Aho-Corasick matching after folding homoglyphs and digit substitutions.

Terms and weights are learned from labelled training rows: every word stays whose own rows are enough and whose
log-odds are high at their lower bound, a beginning of words in their place only if it says more than the best of them,
and weights come from a logistic regression on length-normalised counts. A term is a word, or with a final * all words that begin so.
Phrases around a term that occur only in documents labelled clean become exceptions: a hit inside one doesn't count.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsieve.llm.common import HASHER, fit_rows, grams, map_arrow, mix, remainder, small_batches, stored

#: The fit reads at most about so many labelled training rows, chosen by a hash of their id; scoring reads all.
FIT_ROWS = 12_000
#: Candidate terms, the best ones: a bound on the fitted model, not on what is scored.
MAX_TERMS = 1_000
#: Least hashes of a labelled row's shingles; rows that agree in half of them are copies and count as one.
SKETCH = 8
#: Lengths of the word beginnings that may become terms.
PREFIXES = range(3, 9)
#: Toxic rows that a term needs.
MIN_TERM_DOCS = 10
#: Hits of one term beyond this number add nothing to a text's score: a term says what it says by then.
MAX_HITS = 3
#: A term's least log-odds, two standard errors below its estimate.
MIN_LOG_ODDS = 2.0
#: A phrase of a term and its neighbour is an exception from so many clean documents on, with no toxic one.
MIN_EXCEPTION_DOCS = 5

#: Letters of other scripts that look like a Latin one, and the digits and signs that stand for letters.
HOMOGLYPHS = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝɡıΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχ",
    "abesijkmhopctyxaesijopcyxhdqwgiabezhikmnoptyxaeikvoptux",
)
DIGITS = str.maketrans("01345789", "oleastbg")
#: A one may stand for i or l: the automaton holds both readings of a term.
ONE_IS = ("l", "i")
SIGNS = {"@": "a", "$": "s", "!": "i"}
_SIGN = re.compile(r"[@$!](?=[^\W\d_])")
_FULLWIDTH = str.maketrans({0xFF01 + k: 0x21 + k for k in range(94)})
_INVISIBLE = str.maketrans(dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]))


def fold(text: str) -> str:
    """Lower case with look-alikes folded to Latin letters; a sign counts as a letter only before one."""
    if not text.isascii():
        text = text.translate(_INVISIBLE).translate(_FULLWIDTH).translate(HOMOGLYPHS)
    text = text.lower().translate(DIGITS)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text


def fold_term(term: str) -> set[str]:
    """The forms under which a folded text can show a term."""
    t = fold(term.rstrip("*"))
    return {t, t.replace("i", "l"), *(t[:k] + "l" + t[k + 1 :] for k, c in enumerate(t) if c == "i")}


@dataclass
class Lexicon:
    """terms: weight of each; exceptions: phrases that hold a term but don't count; bias: of the logistic score."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    bias: float = -3.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        forms: dict[str, list[tuple[str, str, int]]] = {}
        for kind, names in (("exception", self.exceptions), ("term", self.terms)):
            for name in names:
                for form in fold_term(name):
                    forms.setdefault(form, []).append((kind, name, len(form)))
        for form, values in forms.items():
            a.add_word(form, values)
        if forms:
            a.make_automaton()
        return a


def hits(automaton: ahocorasick.Automaton, folded: str) -> list[tuple[str, int, int]]:
    """Whole-word hits of terms outside exceptions: (term, start, end)."""
    found, shields = [], []
    if not len(automaton):
        return found
    for last, values in automaton.iter(folded):
        for kind, name, size in values:
            start, end = last - size + 1, last + 1
            if (start and folded[start - 1].isalpha()) or (name[-1] != "*" and end < len(folded) and folded[end].isalpha()):
                continue
            (found if kind == "term" else shields).append((name, start, end))
    if shields:
        # By start, how far any shield that begins there or before reaches.
        shields.sort(key=lambda x: x[1])
        starts, reach = [x[1] for x in shields], list(accumulate((x[2] for x in shields), max))
        found = [h for h in found if not (k := bisect_right(starts, h[1])) or reach[k - 1] < h[2]]
    return found


def length_norm(n_words: int) -> float:
    """A text's hits are divided by this: slow growth, so that one slur in a long text still counts."""
    return 1.0 + 0.1 * math.log2(1.0 + n_words)


def _tokens(folded: str) -> list[str]:
    return [t for t in (w.strip("\"'.,;:?()[]{}!#*$%&|<>-_") for w in folded.split()) if t.isalpha()]


def sketch(text: str) -> list[int]:
    """The least hashes, by SKETCH orders, of a text's shingles of three words; of all words if there are fewer."""
    h = HASHER.array(text.encode().split())
    if not len(h):
        return [0] * SKETCH
    g = grams(h, min(3, len(h)))
    return [int(mix(g ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)).min().view(np.int64)) for k in range(SKETCH)]


def without_copies(rows: DataFrame) -> DataFrame:
    """Labelled rows (row, text, label), of which the caller bounds the number, without copies and near copies of others.

    What a text that was copied a thousand times says would else be a thousandfold evidence for each of its words. The
    driver gets the rows' sketches, not their texts.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch[0], pa.array([sketch(t or "") for t in batch[1].to_pylist()], pa.list_(pa.int64()))], ["row", "sketch"])

    got = sorted((tuple(r["sketch"]), r["row"]) for r in map_arrow(rows.select("row", "text"), each, "row long, sketch array<long>").collect())
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for s, row in got:
        alike = Counter(k for place in enumerate(s) for k in seen.get(place, ()))
        if not alike or max(alike.values()) < SKETCH // 2:
            for place in enumerate(s):
                seen.setdefault(place, []).append(len(kept))
            kept.append((row,))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(kept, "row long")), "row")


def fit(rows: DataFrame, terms: Sequence[str] | None = None) -> Lexicon:
    """A lexicon from rows (text, label 0 or 1), of which the caller bounds the number.

    Without rows of both labels the lexicon has the given terms with weight 1, or none.
    """
    small_batches(rows.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, Counter] = {0: Counter(), 1: Counter()}
        docs = Counter()

        def flush() -> pa.RecordBatch:
            keys = [k for k in grams[0].keys() | grams[1].keys()] + [""]
            for y in (0, 1):
                grams[y][""] = docs[y]
            out = pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array([grams[y][k] for k in keys], pa.int64()) for y in (0, 1))], ["gram", "clean", "toxic"])
            for c in (docs, *grams.values()):
                c.clear()
            return out

        for b in batches:
            for text, y in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                docs[y] += 1
                words = set(_tokens(fold(text or "")))
                grams[y].update(words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k})
            if len(grams[0]) > 200_000:
                yield flush()
        yield flush()

    counts = rows.select("text", F.col("label").cast("int")).mapInArrow(count, "gram string, clean long, toxic long")
    counts = counts.groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = counts.where("gram = ''").first()
    n_clean, n_toxic = (n["clean"] or 0, n["toxic"] or 0) if n else (0, 0)
    if not n_clean or not n_toxic:
        return Lexicon(dict.fromkeys(terms or [], 1.0))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    bound = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.where((F.col("gram") != "") & (F.col("toxic") >= MIN_TERM_DOCS)).withColumn("bound", bound).where(F.col("bound") >= MIN_LOG_ODDS)
    best = best.orderBy(F.desc(F.col("bound") * F.sqrt("toxic")), "gram").limit(MAX_TERMS)
    chosen = standing({r["gram"]: (r["clean"], r["toxic"]) for r in best.collect()}, n_clean, n_toxic)
    return _weigh(rows, sorted({*chosen, *(terms or [])}))


def lower_bound(clean: int, toxic: int, n_clean: int, n_toxic: int) -> float:
    """Log-odds of a term, two standard errors below their estimate."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1.0)) - math.log((clean + 0.5) / (n_clean + 1.0))
    return odds - 2 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def standing(found: dict[str, tuple[int, int]], n_clean: int, n_toxic: int) -> list[str]:
    """Terms that stand on their own evidence, from candidates with their clean and toxic rows.

    Words do. A beginning takes the place of the terms under it if it has MIN_TERM_DOCS toxic rows more than the best of
    them and odds as good: so many forms of one stem become one term, and a word stays where its beginning adds nothing.
    """
    bound = {w: lower_bound(*n, n_clean, n_toxic) for w, n in found.items()}
    kept = {w for w in found if w[-1] != "*"}
    for stem in sorted((w[:-1] for w in found if w[-1] == "*"), key=lambda w: (-len(w), w)):
        under = {w for w in kept if w.startswith(stem)}
        if not under or (found[f"{stem}*"][1] >= max(found[w][1] for w in under) + MIN_TERM_DOCS and bound[f"{stem}*"] >= max(bound[w] for w in under)):
            kept = kept - under | {f"{stem}*"}
    return sorted(kept)


def _weigh(rows: DataFrame, terms: list[str]) -> Lexicon:
    """Weights from the bounded rows: the driver gets each row's label, length, term counts and neighbour phrases."""
    lexicon = Lexicon(dict.fromkeys(terms, 1.0))
    index = {t: i for i, t in enumerate(terms)}
    state: dict = {}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "a" not in state:
            state["a"] = lexicon.automaton()
        out = []
        for text, y in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            folded = fold(text or "")
            found = hits(state["a"], folded)
            around = set()
            for t, s, e in found:
                before, after = folded[max(0, s - 40) : s].split()[-1:], folded[e : e + 40].split()[:1]
                around |= {f"{index[t]} " + " ".join([*before, folded[s:e]])} if before and before[0].isalpha() else set()
                around |= {f"{index[t]} " + " ".join([folded[s:e], *after])} if after and after[0].isalpha() else set()
            out.append({"label": y, "words": len(folded.split()), "hits": [index[t] for t, _, _ in found], "around": sorted(around)})
        return pa.RecordBatch.from_pylist(out, pa.schema([("label", pa.int32()), ("words", pa.int64()), ("hits", pa.list_(pa.int32())), ("around", pa.list_(pa.string()))]))

    got = map_arrow(rows.select("text", F.col("label").cast("int")), count, "label int, words long, hits array<int>, around array<string>").collect()
    x, y = np.zeros((len(got), len(terms))), np.array([r["label"] for r in got], float)
    for i, r in enumerate(got):
        for h in r["hits"]:
            x[i, h] += 1
        x[i] = np.minimum(x[i], MAX_HITS) / length_norm(r["words"])
    # Newton steps of a ridge logistic regression; the last column is the bias.
    x = np.hstack([x, np.ones((len(got), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.02)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    w, bias = w[:-1], w[-1]
    lexicon.terms = {t: float(v) for t, v in zip(terms, w, strict=True) if v > 0.05}
    lexicon.bias = float(bias)
    # Exceptions are those of the terms that are left.
    clean, toxic = (Counter(p for r in got if r["label"] == y for p in r["around"]) for y in (0, 1))
    lexicon.exceptions = sorted({p.partition(" ")[2] for p, n in clean.items() if n >= MIN_EXCEPTION_DOCS and not toxic[p] and terms[int(p.partition(" ")[0])] in lexicon.terms})
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_hits) of every whole text; null and empty texts have no hits and so the lowest score.

    A null id is scored like others, texts of any length whole. The score is logistic in the terms' weights, each
    counted MAX_HITS times at most, over the length norm.
    """
    state: dict = {}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "a" not in state:
            state["a"] = lexicon.automaton()
        scores, found = [], []
        for text in batch[1].to_pylist():
            folded = fold(text or "")
            h = hits(state["a"], folded)
            counts = Counter(t for t, _, _ in h)
            z = lexicon.bias
            if counts:
                z += sum(lexicon.terms[t] * min(c, MAX_HITS) for t, c in sorted(counts.items())) / length_norm(len(folded.split()))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            found.append(len(h))
        return pa.RecordBatch.from_arrays([batch[0], pa.array(scores), pa.array(found, pa.int64())], ["id", "score", "n_hits"])

    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(df, each, "id long, score double, n_hits long").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_hits. Labels of held-out rows are never read.

    Null or empty texts get the score of no hit. A null id is not held out, has no label and is scored. Repeated rows
    are scored one by one, texts of any length whole; other columns are ignored. Of several labels of an id the largest
    counts. Candidate terms as good as others go by their letters. An empty table gives no rows; without labels of both
    kinds all scores are the same.
    """
    train = remainder("doc_id", mod) != held
    known = stored(fit_rows(docs, labels, "toxic", train, FIT_ROWS).withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")  # read several times
    lexicon = fit(without_copies(known) if not known.isEmpty() else known)
    out = score(docs, lexicon)
    held_out = F.coalesce(remainder("doc_id", mod) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")
