"""From grouped questions and answers to a ranked removal target per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsieve.functions import text
from clipsieve.functions.scalar import python_round2
from clipsieve.functions.vocab import Vocabulary

CLUSTER = ["video", "singular", "desc_key"]
#: More than any index of an item.
_BARE = 1 << 32


def parse(grouped: DataFrame) -> DataFrame:
    """(video, questions_and_answers) to (video, q_idx, item, qtype, question, answer); null parts where an item doesn't parse."""
    rows = grouped.select("video", F.posexplode(text.items(F.col("questions_and_answers"))).alias("q_idx", "item"))
    part = lambda k: F.nullif(F.regexp_extract("item", text.ITEM, k), F.lit(""))  # noqa: E731  # no part of an item that parses is empty
    return rows.select("*", part(1).alias("qtype"), part(2).alias("question"), part(3).alias("answer"))


def subjects(parsed: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """One row per item that has a subject: (video, q_idx, mention, noun, singular, is_plural, position, desc_key)."""
    return text.subjects_only(parsed.select("video", "q_idx", "question"), F.col("question"), v).drop("question")


def cluster_counts(subs: DataFrame) -> DataFrame:
    return subs.groupBy(*CLUSTER).agg(F.count("*").alias("cnt"), F.min("q_idx").alias("first_pos"))


def merged(subs: DataFrame) -> DataFrame:
    """Subjects with bare nouns moved to the noun's only described cluster; was_bare keeps their order behind it."""
    noun = Window.partitionBy("video", "singular")
    key = F.when(F.col("desc_key") != "", F.col("desc_key"))
    m = subs.withColumns({"_low": F.min(key).over(noun), "_high": F.max(key).over(noun)})
    moves = (F.col("desc_key") == "") & F.coalesce(F.col("_low") == F.col("_high"), F.lit(False))
    m = m.withColumn("was_bare", F.coalesce(moves, F.lit(False))).withColumn("desc_key", F.when(moves, F.col("_low")).otherwise(F.col("desc_key")))
    return m.drop("_low", "_high")


def _place() -> Column:
    """A subject's place in its cluster: bare mentions come after the cluster's own ones, by a place beyond any other, as
    numbers are aggregated by hashing and structs by sorting."""
    return F.col("q_idx").cast("long") + F.when(F.col("was_bare"), F.lit(_BARE)).otherwise(F.lit(0))


def _mentions(merged_subs: DataFrame, *carried: str) -> DataFrame:
    """Per mention of a cluster how often and where first."""
    return merged_subs.groupBy(*CLUSTER, "mention").agg(
        F.count("*").alias("n"), F.min(_place()).alias("first"), F.min(F.when(~F.col("was_bare"), F.col("q_idx"))).alias("own_first"),
        F.bool_or("is_plural").alias("plural"), F.any_value(F.size(F.split("mention", " "))).alias("words"), *(F.max(c).alias(c) for c in carried),
    )


def scored(merged_subs: DataFrame, v: Vocabulary = Vocabulary(), *carried: str, prompt: bool = True) -> DataFrame:
    """(video, singular, desc_key, cnt, first_pos, example, prompt_word, score) per merged cluster, and carried columns,
    which are the same in all rows of a video.

    prompt_word is the commonest mention of more than one word, else the commonest; ties go to the first. Without it the
    subjects are aggregated once.
    """
    if prompt:
        rank = F.struct(F.when(F.col("words") > 1, 0).otherwise(1), -F.col("n"), F.col("first"))
        g = _mentions(merged_subs, *carried).groupBy(*CLUSTER).agg(
            F.sum("n").alias("cnt"), F.min("own_first").alias("first_pos"), F.bool_or("plural").alias("plural"), F.sum(F.col("words") * F.col("n")).alias("words"),
            F.min_by("mention", "first").alias("example"), F.min_by("mention", rank).alias("prompt_word"), *(F.max(c).alias(c) for c in carried),
        )
    else:
        g = merged_subs.groupBy(*CLUSTER).agg(
            F.count("*").alias("cnt"), F.min(F.when(~F.col("was_bare"), F.col("q_idx"))).alias("first_pos"), F.bool_or("is_plural").alias("plural"),
            F.sum(F.size(F.split("mention", " "))).alias("words"), F.min_by("mention", _place()).alias("example"), *(F.max(c).alias(c) for c in carried),
        )
    flag = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    score = F.col("cnt") * 10 - flag(F.col("plural"), 15) + flag(F.col("desc_key") != "", 5) + flag(F.col("words") * 2 > F.col("cnt") * 3, 3) - flag(F.col("singular").isin(*v.generic), 10)
    return g.select(*CLUSTER, "cnt", "first_pos", "example", *(["prompt_word"] if prompt else []), *carried, score.cast("long").alias("score"))


def _ranked(clusters: DataFrame, n: int, *order) -> DataFrame:
    w = Window.partitionBy("video").orderBy(*order)
    return clusters.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best(clusters: DataFrame) -> DataFrame:
    return _ranked(clusters, 1, F.desc("score"), F.desc(F.col("desc_key") != ""), F.desc("cnt"), "first_pos").drop("rank")


def candidates(clusters: DataFrame, n: int = 5) -> DataFrame:
    """(video, rank, entity, score, subject_count, example): by score alone, ties in first-seen order."""
    top = _ranked(clusters, n, F.desc("score"), "first_pos")
    label = F.concat(F.col("singular"), F.lit("("), F.coalesce(F.nullif("desc_key", F.lit("")), F.lit("generic")), F.lit(")"))
    return top.select("video", "rank", label.alias("entity"), "score", F.col("cnt").alias("subject_count"), "example")


def prompts(merged_subs: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    return scored(merged_subs, v).select(*CLUSTER, "prompt_word")


def prompt_select(grouped: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """(video, prompt_word, subject_question_count, total_questions, score); videos without a subject have a null prompt.

    One pass: a video's first item stays without a subject too, as a cluster without noun, which comes last; the number of
    items goes along with each.
    """
    items = grouped.select("video", text.items(F.col("questions_and_answers")).alias("items"))
    rows = items.select("video", F.size("items").cast("long").alias("total_questions"), "items").select("video", "total_questions", F.posexplode("items").alias("q_idx", "item"))
    question = F.nullif(F.regexp_extract("item", text.ITEM, 2), F.lit(""))
    found = text.subjects_only(rows, question, v, also=F.col("q_idx") == 0).drop("item")
    order = (F.col("singular").isNull(), F.desc("score"), F.desc(F.col("desc_key") != ""), F.desc("cnt"), F.col("first_pos"))
    top = _ranked(scored(merged(found), v, "total_questions"), 1, *order)
    own = F.col("singular").isNotNull()
    return top.select("video", "prompt_word", F.when(own, F.col("cnt")).alias("subject_question_count"), "total_questions", F.when(own, F.col("score")).alias("score"))


def coverage(selected: DataFrame) -> DataFrame:
    """(video, subject_question_count, total_questions, coverage, coverage_2): the share of items that ask for the target,
    and the same to two places as Python rounds."""
    share = F.col("subject_question_count") / F.col("total_questions")
    return selected.where("prompt_word IS NOT NULL").select("video", "subject_question_count", "total_questions", share.alias("coverage"), python_round2(share).alias("coverage_2"))


def noun_distribution(selected: DataFrame, v: Vocabulary = Vocabulary(), n: int = 15, position: str = "video") -> DataFrame:
    """(noun, n): the commonest first vocabulary word of the prompts, in singular; of equal ones that of the first row
    by position comes first."""
    word = F.get(F.filter(F.split("prompt_word", " "), lambda w: w.isin(*v.entities)), F.lit(0))
    plural = F.create_map(*[F.lit(x) for pair in v.plurals.items() for x in pair])
    noun = F.coalesce(F.try_element_at(plural, word), word)
    nouns = selected.where("prompt_word IS NOT NULL").select(noun.alias("noun"), F.col(position).alias("at")).where("noun IS NOT NULL")
    return nouns.groupBy("noun").agg(F.count("*").alias("n"), F.min("at").alias("at")).orderBy(F.desc("n"), "at").limit(n).select("noun", "n")
