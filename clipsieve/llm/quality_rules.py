"""Quality rules by distribution divergence, with DataFrame functions only.

Each document has two histograms: its characters by class, and how often the commonest words of its
language occur. References are the median histograms of a language's documents that pass the base rules,
over all documents. A document far from its reference by Jensen-Shannon distance is rejected. Short
documents are too noisy to compare, so either comparison has a minimum length under which it says nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsieve.llm.common import SPACE_RE, broadcast_if_small, free_name, stored, trimmed

#: The commonest words of each language, and of none.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "was"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "pour", "dans"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "nicht", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "con", "no"],
}
SYMBOLS = "#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "space", "symbol", "other"]

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A comparison of character classes needs so many characters, one of common words so many words.
MIN_CHARS = 100
MIN_COMMON_WORDS = 60
# Set by the labelled rows of the tables of scale 0.1: of 3,302 good ones that pass the base rules 99% are within 0.14 by
# classes, and the farthest is at 0.29 by words; of 291 bad ones that only the classes tell, 95% are beyond 0.21.
MAX_CLASS_DISTANCE = 0.19
MAX_WORD_DISTANCE = 0.42
#: A reference needs so many documents.
MIN_REFERENCE_DOCS = 5


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One narrow row per document: the base measures and both histograms as arrays of counts.

    Null or empty text: no words, all counts 0. Unknown or null language: no common words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("t"))
    # Long runs go first, so each later pattern sees a short rest.
    d = d.withColumn("r1", _removed(F.col("t"), "\\p{Ll}+")).withColumn("r2", _removed(F.col("r1"), SPACE_RE))
    d = d.withColumn("r3", _removed(F.col("r2"), "\\p{Lu}+")).withColumn("r4", _removed(F.col("r3"), "\\p{Nd}+"))
    d = d.withColumn("r5", _removed(F.col("r4"), "[#*$%&|<>]+"))
    size = {k: F.length(k).cast("long") for k in ("t", "r1", "r2", "r3", "r4", "r5")}
    lower, space, upper = size["t"] - size["r1"], size["r1"] - size["r2"], size["r2"] - size["r3"]
    digit, symbol, other = size["r3"] - size["r4"], size["r4"] - size["r5"], size["r5"]
    trim = trimmed(F.col("t"))
    words = F.when(trim == "", F.array().cast("array<string>")).otherwise(F.split(trim, SPACE_RE))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    d = d.select(
        "id", "lang", words.alias("words"), lines.alias("lines"), (size["t"] - space).alias("word_chars"), symbol.alias("n_symbols"),
        F.array(lower, upper, digit, space, symbol, other).alias("classes"),
    )
    # Each step is a column of its own: what several expressions read is computed once.
    d = d.withColumn("w", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("h", F.transform(F.slice("w", 1, F.greatest(F.size("w") - WINDOW + 1, F.lit(0))), _window_hash))
    d = d.withColumn("repeats", F.size("h") > F.size(F.array_distinct("h")))
    d = d.withColumn("pairs", F.when(F.col("repeats"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    d = d.withColumn("common", F.concat(F.lit("|"), F.array_join(F.filter("words", lambda w: w.isin(every)), "||"), F.lit("|")))
    return d.select(
        "id", "lang", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), _covered()).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        "classes", _common_counts().alias("common"),
    )


def _window_hash(first: Column, i: Column) -> Column:
    return F.xxhash64(first, *(F.get("w", i + k) for k in range(1, WINDOW)))


def _covered() -> Column:
    """Words in windows whose hash occurs twice or more: of the pairs (hash, position) in order keep what
    has an equal neighbour, then add up how far each kept window reaches past the one before."""
    kept = F.filter(
        "pairs", lambda y, j: F.coalesce(y["x"] == F.get("pairs", j - 1)["x"], F.lit(False)) | F.coalesce(y["x"] == F.get("pairs", j + 1)["x"], F.lit(False))
    )
    at = F.sort_array(F.transform(kept, lambda y: y["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")))["n"]


def _common_counts() -> Column:
    """How often each common word of the document's language occurs: common holds them as |a||b||c|."""

    def times(x: str) -> Column:
        gone = F.octet_length("common") - F.octet_length(F.replace(F.col("common"), F.lit(f"|{x}|"), F.lit("")))
        return (gone / F.lit(len(x.encode()) + 2)).cast("long")

    def of(ws: list[str]) -> Column:
        return F.array(*(times(x) for x in ws))

    longest = max(map(len, COMMON_WORDS.values()))
    out = F.array(*[F.lit(0).cast("long")] * longest)
    for lang, ws in COMMON_WORDS.items():
        out = F.when(F.col("lang") == lang, of(ws)).otherwise(out)
    return out


def _shares(counts: Column, rest: Column | None = None) -> Column:
    """A histogram of counts as shares; rest adds a last bin with what the counts don't hold."""
    if rest is not None:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
        counts = F.concat(counts, F.array(F.greatest(rest - total, F.lit(0).cast("long"))))
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / F.when(total > 0, total))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    each = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def references(measured: DataFrame) -> DataFrame:
    """Per language the median share of each bin, over all documents that pass the base rules and are long enough.

    Medians, so that junk of another kind doesn't move a reference. One map-side aggregate of fixed width;
    a row for each of the languages of COMMON_WORDS at most.
    """
    good = measured.where(~F.col("base_failed") & (F.col("n_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_COMMON_WORDS))
    bins = len(CLASSES), max(map(len, COMMON_WORDS.values())) + 1
    middle = [_shares(F.array(*(F.percentile_approx(F.col(c)[i], 0.5, 1000) for i in range(n)))) for c, n in zip(("class_shares", "word_shares"), bins, strict=True)]
    cols = [middle[0].alias("class_ref"), middle[1].alias("word_ref"), F.count("*").alias("ref_docs")]
    return good.where(F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(*cols).where(F.col("ref_docs") >= MIN_REFERENCE_DOCS)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base measures of every document, stored, with base_failed and both histograms as shares."""
    narrow = stored(base_columns(docs, id_col, text_col, lang_col), "quality-base")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return narrow.select(
        "*", failed.alias("base_failed"), reduce(lambda a, b: a + b, (F.col("classes")[i] for i in range(len(CLASSES)))).alias("n_chars"),
        _shares(F.col("classes")).alias("class_shares"), _shares(F.col("common"), F.col("n_words")).alias("word_shares"),
    )


def fit_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """References for judge, from documents that need not be those to be judged."""
    return references(measured(docs, id_col, text_col, lang_col))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reference: DataFrame | None = None) -> DataFrame:
    """Measures, distances and verdict of every document.

    Null, empty and short texts fail the base rules; texts of any length are read whole. A language with too few good
    documents, an unknown one or a null one has no reference: distances are null and the base rules alone decide.
    Null ids and repeated rows are judged one by one. Other columns are ignored. An empty table gives no rows. With a
    reference (see fit_references) of an earlier run verdicts don't depend on the other rows of docs.
    """
    m = measured(docs, id_col, text_col, lang_col)
    m = m.join(F.broadcast(references(m) if reference is None else reference), "lang", "left")  # four rows at most
    class_distance = F.when(F.col("n_chars") >= MIN_CHARS, jensen_shannon(F.col("class_shares"), F.col("class_ref")))
    word_distance = F.when(F.col("n_words") >= MIN_COMMON_WORDS, jensen_shannon(F.col("word_shares"), F.col("word_ref")))
    m = m.withColumns({"class_distance": class_distance, "word_distance": word_distance})
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return m.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance",
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with their columns, without the rows that judge rejects; null ids and repeated rows are judged like others."""
    clash = free_name(docs)
    row = F.struct(F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(lang_col)).alias("h"))
    bad = judge(docs.select(row.alias("row"), text_col, lang_col), "row", text_col, lang_col).where(~F.col("kept"))
    bad = stored(bad.select(F.col("row.i").alias(f"{clash}_id"), F.col("row.h").alias(f"{clash}_h")).distinct(), "quality-rejected")
    same = F.col(id_col).eqNullSafe(F.col(f"{clash}_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(lang_col)) == F.col(f"{clash}_h"))
    return docs.join(broadcast_if_small(bad, 16), same, "left_anti")
