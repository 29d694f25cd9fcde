"""Question text as Column expressions: items, tokens, entity mentions, subjects. No UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsieve.functions.vocab import AUXILIARIES, PREPOSITIONS, QUANTITIES, Vocabulary

# The patterns of the packed text.
#: An item is "[type] question -> answer": Unicode classes, and . stops at \n only; the first arrow ends the question.
ITEM = r"(?Ud)^\[(\w+)\]\s*(.+?)\s*->\s*(.+)"
SEPARATOR = r" \|\|\| "


#: Fixed value: the white space that is cut from both ends of a prompt.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return stripped(text) == ""


def prompt_list(text: Column) -> Column:
    """The prompts of a comma-separated list; empty ones stay."""
    return F.transform(F.split(text, ","), stripped)


def items(packed: Column) -> Column:
    """The items of a packed string; empty ones stay."""
    return F.split(packed, SEPARATOR)


def clean(token: Column) -> Column:
    return F.ltrim(F.rtrim(token, F.lit(".,?!;:'\"")), F.lit("'\""))


def tokens(text: Column) -> Column:
    """Lower-case tokens without marks at their edges; a token of marks only is an empty string, as it takes a place."""
    return F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != ""), clean)


def _first(values: Column, test) -> Column:
    """Index (from 0) of the first element that passes, or null."""
    return F.get(F.filter(F.transform(values, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull()), F.lit(0))


def after_auxiliary(toks: Column) -> Column:
    """What follows the first auxiliary verb that isn't the first token; everything without one."""
    at = _first(toks, lambda t, i: t.isin(*AUXILIARIES) & (i > 0))
    return F.when(at.isNull(), toks).otherwise(F.slice(toks, at + 2, F.greatest(F.size(toks) - at - 1, F.lit(0))))


#: What is read before a noun: its adjectives in order, whether a quantity stands there, and whether the reading has ended.
_BEFORE = "struct<adjectives:array<string>,quantity:boolean,stop:boolean>"


def before_noun(toks: Column, i: Column, v: Vocabulary) -> Column:
    """Adjectives and quantity words straight before index i, read backwards up to the first other word."""

    def back(s: Column, t: Column) -> Column:
        going = ~s["stop"]
        adjective, quantity = going & t.isin(*v.adjectives), going & t.isin(*QUANTITIES)
        return F.struct(
            F.when(adjective, F.array_prepend(s["adjectives"], t)).otherwise(s["adjectives"]).alias("adjectives"),
            (s["quantity"] | quantity).alias("quantity"), (s["stop"] | ~(adjective | quantity)).alias("stop"),
        ).cast(_BEFORE)

    start = F.struct(F.array().cast("array<string>").alias("adjectives"), F.lit(False).alias("quantity"), F.lit(False).alias("stop")).cast(_BEFORE)
    return F.aggregate(F.reverse(F.slice(toks, F.lit(1), i)), start, back)


def descriptors_after(toks: Column, i: Column, v: Vocabulary) -> Column:
    """Descriptor words among the four tokens after a preposition that follows index i, up to the first other word but "the"."""
    ahead = F.slice(toks, i + 3, F.lit(4))
    ends = _first(ahead, lambda t, k: ~t.isin(*v.descriptors, "the"))
    run = F.filter(F.slice(ahead, F.lit(1), F.coalesce(ends, F.lit(4))), lambda t: t != "the")
    return F.when(F.get(toks, i + 1).isin(*PREPOSITIONS), run).otherwise(F.array().cast("array<string>"))


def mention(toks: Column, i: Column, before: Column, after: Column, v: Vocabulary) -> Column:
    """The mention of the entity word at index i: mention, noun, singular, is_plural, position, desc_key."""
    noun = F.get(toks, i)
    singular, plural = noun, before["quantity"]
    if v.plurals:
        singular = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in v.plurals.items() for x in pair]), noun), noun)
        plural = noun.isin(*v.plurals) | plural
    phrase = F.when(F.size(after) > 0, F.concat(F.array(F.get(toks, i + 1)), after)).otherwise(after)
    key = F.coalesce(F.get(after, F.lit(0)), F.get(before["adjectives"], F.lit(0)), F.lit(""))
    return F.struct(
        F.array_join(F.concat(before["adjectives"], F.array(noun), phrase), " ").alias("mention"), noun.alias("noun"), singular.alias("singular"),
        plural.alias("is_plural"), i.cast("int").alias("position"), key.alias("desc_key"),
    )


def entity_positions(toks: Column, v: Vocabulary) -> Column:
    return F.filter(F.transform(toks, lambda t, i: F.when(t.isin(*v.entities), i)), lambda i: i.isNotNull())


def entities(toks: Column, v: Vocabulary = Vocabulary()) -> Column:
    """All mentions of a text in order."""
    return F.transform(entity_positions(toks, v), lambda i: mention(toks, i, before_noun(toks, i, v), descriptors_after(toks, i, v), v))


def _any(words) -> str:
    """A pattern of any of the words, the longest first; of none, one that never fits."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")" if words else "(?!)"


#: Between single spaces: where a word begins and where it ends.
_BEGIN, _END = "(?<![^ ])", "(?![^ ])"
_MARKS = ".,?!;:'\""
#: A character that a plain text has not: all but printable ASCII without marks. The class names each character, as one of
#: ranges is looked up range by range.
_ODD = "[^ " + "".join(re.escape(c) for c in map(chr, range(0x21, 0x7F)) if c not in _MARKS) + "]"


def _read_first(words: Column, v: Vocabulary) -> Column:
    """What stands before the first mention's adjectives and quantities after the auxiliary, these, the noun, a
    preposition and what it brings, with line ends between, which no token has; without a mention the words as they are.

    One pattern reads them all, as each pass over a text costs about as much. Its loops over words are possessive, as
    others take stack for each word. An entity that is an adjective too would be the first mention itself, so it never
    stands before it.
    """
    chain = f"(?:{_any([w for w in (*v.adjectives, *QUANTITIES) if w not in v.entities])} )*+"
    noun = _any(v.entities)
    after = rf"(?: ({_any(PREPOSITIONS)}){_END}((?: {_any((*v.descriptors, 'the'))}{_END}){{0,4}}+))?+"
    pattern = rf"(?s)\A(?:.*? {_any(AUXILIARIES)}(?: |\z))?+(|.*? )({chain})({noun}){_END}{after}.*+"
    return F.regexp_replace(words, pattern, "$1\n$2\n$3\n$4\n$5")


def first_subject(df: DataFrame, text: Column, v: Vocabulary = Vocabulary()) -> DataFrame:
    """df with the column s: the first mention after the text's auxiliary, or null; what mention, before_noun and
    descriptors_after say on tokens, from patterns on a string, which take a fraction of the time of lambdas on arrays.

    Each step is a column of its own, as an expression that is read several times would be computed as often, and what
    most texts don't need is behind a cheaper test. A filter on s is pushed below and evaluates the patterns again:
    subjects_only has none.
    """
    # The tokens of the text, as tokens has them, in one string with a space between them.
    df = df.withColumn("_words", F.lower(text))
    df = df.withColumn("_odd", F.col("_words").contains("  ") | F.col("_words").rlike(_ODD))
    spaced = F.regexp_replace("_words", r"(?U)[\s&&[^ ]]\s*| \s+", " ")
    df = df.withColumn("_words", F.trim(F.when(F.col("_odd"), spaced).otherwise(F.col("_words"))))
    bare = F.regexp_replace("_words", f"[{_MARKS}]++{_END}|{_BEGIN}['\"]++", "")
    df = df.withColumn("_words", F.when(F.col("_odd"), bare).otherwise(F.col("_words")))
    df = df.withColumn("_parts", F.split(_read_first(F.col("_words"), v), "\n"))
    before, chain, noun, preposition, brought = (F.get("_parts", F.lit(k)) for k in range(5))
    only = [q for q in QUANTITIES if q not in v.adjectives]
    df = df.withColumn("_many", (chain != "") & chain.rlike(f"{_BEGIN}{_any(QUANTITIES)} "))
    df = df.withColumns({
        "_own": F.when(F.col("_many"), F.regexp_replace(chain, f"{_BEGIN}{_any(only)} ", "")).otherwise(chain),
        "_said": F.when(brought.contains(" the"), F.regexp_replace(brought, f" the{_END}", "")).otherwise(brought),
    })
    plural = F.col("_many")
    singular = noun
    if v.plurals:
        singular = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in v.plurals.items() for x in pair]), noun), noun)
        plural = noun.isin(*v.plurals) | plural
    first = lambda c: F.substring_index(c, " ", 1)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    s = F.struct(
        F.concat("_own", noun, F.when(F.col("_said") != "", F.concat(F.lit(" "), preposition, F.col("_said"))).otherwise("")).alias("mention"), noun.alias("noun"), singular.alias("singular"),
        plural.alias("is_plural"), (spaces(before) + spaces(chain)).cast("int").alias("position"),
        F.when(F.col("_said") != "", first(F.expr("substring(_said, 2)"))).otherwise(first(F.col("_own"))).alias("desc_key"),
    )
    return df.withColumn("s", F.when(F.size("_parts") > 1, s)).drop("_words", "_odd", "_parts", "_many", "_own", "_said")


def subjects_only(df: DataFrame, text: Column, v: Vocabulary = Vocabulary(), also: Column | None = None) -> DataFrame:
    """df with the fields of the first mention as columns, for the rows that have one; where also holds, a row without
    one stays, with nulls.

    Rows leave as an array of none or one, since the optimizer copies a filter's input below the projections.
    """
    kept = F.col("s").isNotNull() if also is None else F.col("s").isNotNull() | also
    return first_subject(df, text, v).select(*df.columns, F.inline(F.when(kept, F.array("s"))))


def first_mention(df: DataFrame, toks: str = "t", v: Vocabulary = Vocabulary()) -> DataFrame:
    """df with the column s: the first mention among the tokens, or null.

    Each step is a column of its own, as an expression that is read several times would be computed as often.
    """
    t = F.col(toks)
    df = df.withColumn("_at", F.get(entity_positions(t, v), F.lit(0)))
    found = F.col("_at").isNotNull()
    df = df.withColumns({"_before": F.when(found, before_noun(t, F.col("_at"), v)), "_after": F.when(found, descriptors_after(t, F.col("_at"), v))})
    return df.withColumn("s", F.when(found, mention(t, F.col("_at"), F.col("_before"), F.col("_after"), v))).drop("_at", "_before", "_after")
