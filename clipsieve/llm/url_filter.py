"""URL filters: host and path rules, and association rules mined from labelled URLs by FP-growth.

A URL that a given rule fits has that rule's verdict, and is a labelled URL. From these, and from labels that the
caller may have, Spark's FP-growth mines token combinations that imply a verdict; rules pruned by support, confidence
and redundancy are matched, in URLs that no given rule fits, through an inverted index from each rule's rarest token.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsieve.llm.common import map_arrow, remainder, stored

#: The rules of op7, as (host, path) and verdict.
RULES = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
#: A mined rule counts from so many labelled URLs on.
MIN_COUNT = 5
#: Bounds on the mined model, not on what is judged: tokens of a rule, and rules, the most confident ones.
MAX_RULE_TOKENS = 3
MAX_RULES = 20_000
#: Frequent tokens of a labelled URL up to which FP-growth mines, as it makes up to 2 to the power of so many combinations.
BASKET_TOKENS = 12
#: Combinations that a task passes on at a time where they are counted.
COUNTED_ROWS = 20_000
LABELS = ("label:allow", "label:block")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: dict[tuple[str, str], str] = RULES) -> Column:
    """The longest fitting rule as host and path in one string, or null."""
    out = F.lit(None).cast("string")
    for h, p in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, h + p).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: top-level domain, parts of host labels, path words without digits, extension,
    query keys. Numbers are one token, so that pages of one kind look alike."""
    tld = F.concat(F.lit("tld:"), F.element_at(F.split(host, "\\."), -1))
    parts = F.transform(F.split(host, "[.\\-]"), lambda x: F.concat(F.lit("host:"), x))
    folders = F.transform(F.filter(F.split(F.lower(path), "[/._\\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(F.array(tld), parts, folders, keys))


@dataclass(frozen=True)
class Mined:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[Mined]:
    """Rules from rows (tokens, label in LABELS). Their number is bounded by the support: a combination needs that
    share of all rows. A rule stays if no rule with fewer of its tokens has at least its confidence.

    Tokens below the support go before any combination is made. FP-growth makes up to 2 to the power of a row's tokens
    combinations; where a row has more than BASKET_TOKENS, those of a rule's size are counted instead, and no token of
    a row is left out. Of too many rules the most confident, then the best supported ones are kept."""
    n = labelled.count()
    if n < MIN_COUNT:
        return []
    support = max(min_support, MIN_COUNT / n)
    baskets = stored(_baskets(labelled, n, support), "url-baskets")
    if (baskets.agg(F.max(F.size("items"))).first()[0] or 0) <= BASKET_TOKENS + 1:
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
        rules = model.associationRules.where(F.col("consequent")[0].isin(*LABELS) & (F.size("antecedent") <= MAX_RULE_TOKENS) & ~F.arrays_overlap("antecedent", F.array(*map(F.lit, LABELS))))
        rules = rules.select(F.sort_array("antecedent").alias("tokens"), F.col("consequent")[0].alias("label"), "confidence", "support")
    else:
        rules = _counted(baskets, n, support, min_confidence)
    top = rules.orderBy(F.desc("confidence"), F.desc("support"), F.size("tokens"), "tokens").limit(MAX_RULES).collect()
    top.sort(key=lambda r: len(r["tokens"]))  # fewer tokens first, else in this order
    kept: dict[tuple[str, ...], Mined] = {}
    for r in top:
        own = tuple(r["tokens"])
        fewer = (kept.get(part) for k in range(1, len(own)) for part in combinations(own, k))
        if not any(x is not None and x.confidence >= r["confidence"] for x in fewer) and (own not in kept or kept[own].confidence < r["confidence"]):
            kept[own] = Mined(own, r["label"].removeprefix("label:"), r["confidence"], r["support"])
    return list(kept.values())


def _baskets(labelled: DataFrame, n: int, support: float) -> DataFrame:
    """(items) of labelled rows: the row's tokens that are frequent enough, all of them, in order, and then the label."""
    counts = labelled.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # No more than tokens of a row / support.
    frequent = {r["token"] for r in counts.where(F.col("n") >= support * n).collect()}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = [sorted({t for t in own or () if t in frequent}) + [label] for own, label in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])

    return map_arrow(labelled.select("tokens", "label"), each, "items array<string>")


def _counted(baskets: DataFrame, n: int, support: float, min_confidence: float) -> DataFrame:
    """The rules (tokens, label, confidence, support) that FP-growth has, for baskets too long for it: combinations of 1,
    2, ... MAX_RULE_TOKENS tokens are counted, each number from those of one token less that may have more to say.

    A combination that lacks the support with either label has none with more tokens; one that always has the same label
    is a rule that makes all with more tokens redundant. Both are grown no further, which loses no rule that stays.
    """
    spark, least = baskets.sparkSession, math.ceil(support * n)
    grow: set[tuple[str, ...]] = {()}
    rules = []
    for size in range(1, MAX_RULE_TOKENS + 1):

        def combined(batches: Iterator[pa.RecordBatch], grow=grow, size=size) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("tokens", pa.list_(pa.string())), ("label", pa.string())])
            for batch in batches:
                out = []
                for *own, label in batch[0].to_pylist():
                    # A combination grows by a later token if all its parts of this size were frequent.
                    for part in filter(grow.__contains__, combinations(own, size - 1)):
                        for t in own[bisect_right(own, part[-1]) if part else 0 :]:
                            new = (*part, t)
                            if size == 1 or all(p in grow for p in combinations(new, size - 1)):
                                out.append((new, label))
                        if len(out) >= COUNTED_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        allow = F.count_if(F.col("label") == LABELS[0])
        counts = baskets.mapInArrow(combined, "tokens array<string>, label string").groupBy("tokens").agg(F.count("*").alias("n"), allow.alias("allow"))
        # No more than combinations of a row / support.
        found = counts.where(F.greatest("allow", F.col("n") - F.col("allow")) >= least).collect()
        for r in found:
            for label, k in zip(LABELS, (r["allow"], r["n"] - r["allow"]), strict=True):
                if k >= least and k / r["n"] >= min_confidence:
                    rules.append((list(r["tokens"]), label, k / r["n"], k / n))
        grow = {tuple(r["tokens"]) for r in found if 0 < r["allow"] < r["n"]}
        if not grow:
            break
    return spark.createDataFrame(rules, "tokens array<string>, label string, confidence double, support double")


def verdicts(pages: DataFrame, rules: list[Mined], default: str = "allow") -> DataFrame:
    """pages with (page_id, tokens, host, path, rule) to (page_id, host, path, rule, mined, mined_by).

    mined is the verdict of the most confident matching rule, else the default; mined_by has its tokens, null without one.
    """
    share = Counter(t for r in rules for t in r.tokens)
    index: dict[str, list[Mined]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (share[t], t)), []).append(r)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, by = [], []
        for own in batch[1].to_pylist():
            have = set(own or ())
            fits = [r for t in have for r in index.get(t, ()) if have.issuperset(r.tokens)]
            best = max(fits, key=lambda r: (r.confidence, r.support, r.tokens)) if fits else None
            out.append(best.verdict if best else default)
            by.append(" ".join(best.tokens) if best else None)
        return pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(out, pa.string()), pa.array(by, pa.string())], ["page_id", "host", "path", "rule", "mined", "mined_by"])

    return map_arrow(pages.select("page_id", "tokens", "host", "path", "rule"), each, "page_id long, host string, path string, rule string, mined string, mined_by string")


def parsed(pages: DataFrame, rules: dict[tuple[str, str], str] = RULES) -> DataFrame:
    """(page_id, host, path, rule, given, tokens) of pages (page_id, url); given is the rule's verdict or null."""
    url = F.col("url")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.select("page_id", "host", "path", given_rule(F.col("host"), F.col("path"), rules).alias("rule"), tokens(url, F.col("host"), F.col("path")).alias("tokens"))
    given = F.lit(None).cast("string")
    for (h, path), verdict in rules.items():
        given = F.when(F.col("rule") == h + path, verdict).otherwise(given)
    return p.withColumn("given", given)


def _labelled(p: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(tokens, label) of the pages that a given rule fits, and of those with a label."""
    known = p
    label = F.col("given")
    if labels is not None:
        own = labels.where(F.col("label").isin("allow", "block")).groupBy("page_id").agg(F.min("label").alias("label"))
        known, label = p.join(own, "page_id", "left"), F.coalesce("given", "label")
    return known.where(label.isNotNull()).select("tokens", F.concat(F.lit("label:"), label).alias("label"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: dict[tuple[str, str], str] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, mined_by (the tokens of the mined rule that decided, or null).

    Rules are mined from the verdicts of the given ones and from labels (page_id, label: allow or block), if there are
    any. A null URL has empty host and path, fits no rule and is allowed unless a mined rule matches its tokens; URLs of
    any length are read whole. Null ids and repeated rows are judged one by one; of several labels of a page the first
    in the alphabet counts; of rules as confident the better supported one. Other columns are ignored. An empty table
    gives no rows.
    """
    p = parsed(pages, rules)
    out = verdicts(p, mine(_labelled(p, labels)))
    given = F.lit(None).cast("string")
    for (h, path), verdict in rules.items():
        given = F.when(F.col("rule") == h + path, verdict).otherwise(given)
    return out.select("page_id", "host", "path", "rule", F.coalesce(given, "mined").alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined_by")).alias("mined_by"))


def held_out_lift(pages: DataFrame, mod: int = 5, rules: dict[tuple[str, str], str] = RULES) -> DataFrame:
    """(pages, right, constant): of the pages with a given rule whose crc32(page_id as text) mod is 0, how many the rules
    mined from the others judge rightly, and how many the commoner verdict would."""
    p = parsed(pages, rules).where("given IS NOT NULL")
    held = remainder("page_id", mod) == 0
    judged = verdicts(p.where(held).withColumn("rule", F.col("given")), mine(_labelled(p.where(~held), None)))
    return judged.agg(F.count("*").alias("pages"), F.count_if(F.col("mined") == F.col("rule")).alias("right"), F.greatest(F.count_if(F.col("rule") == "allow"), F.count_if(F.col("rule") == "block")).alias("constant"))
