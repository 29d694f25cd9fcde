"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources share all tokens by weight, none above a multiple of its own size. Equal-token blocks go
one by one to the source with the highest quotient target / (2 * given + 1); the same rule then deals each
source's blocks to its shards by size. In a shard, documents lie in seeded order as one row of tokens; the
quota takes the whole row as often as it fits and then its first blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsieve.llm.common import broadcast_if_small, stored, word_count

WEIGHTS = (1, 2, 3)
MAX_TIMES = 3
BLOCK_TOKENS = 64
#: Tokens and documents of one shard of a source, on average: they bound what a task orders.
SHARD_TOKENS = 2_000_000
SHARD_ROWS = 5_000
SEED = 20


def fill_targets(sizes: np.ndarray, weights: np.ndarray, times: float = MAX_TIMES) -> np.ndarray:
    """Shares of sum(sizes) by weight where none exceeds times its size; what is cut off goes to the others by weight."""
    sizes, weights = sizes.astype(float), weights.astype(float)
    caps, out = sizes * times, np.zeros(len(sizes))
    order = np.argsort(caps / weights, kind="stable")
    left, weight = sizes.sum(), weights.sum()
    for k, i in enumerate(order):
        if caps[i] >= left * weights[i] / weight:
            out[order[k:]] = left * weights[order[k:]] / weight
            break
        out[i] = caps[i]
        left, weight = left - caps[i], weight - weights[i]
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotient votes / (2 * seats + 1); ties go to the lower index.

    Starts from the rounded proportional share, which is at most a seat per party off in sum, and then gives or
    takes single seats by quotient: O(n log n), not one step per seat.
    """
    votes = votes.astype(float)
    if votes.sum() <= 0 or seats <= 0:
        return np.zeros(len(votes), np.int64)
    given = np.where(votes > 0, np.floor(votes * (seats / votes.sum()) + 0.5), 0).astype(np.int64)
    off = seats - int(given.sum())
    if off > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, given, strict=True)) if v > 0]
        heapq.heapify(heap)
        for _ in range(off):
            i = heap[0][1]
            given[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * given[i] + 1), i))
    elif off < 0:
        heap = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, given, strict=True)) if g > 0]
        heapq.heapify(heap)
        for _ in range(-off):
            i = -heap[0][1]
            given[i] -= 1
            heapq.heapreplace(heap, (votes[i] / (2 * given[i] - 1) if given[i] else np.inf, -i))
    return given


def source_quotas(sources: DataFrame) -> DataFrame:
    """(skey, source, source_size) to these and weight, target and blocks: one row per source, in one task.

    The table is an aggregate of a row per source, so its size is the number of sources, not of documents.
    """

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        # By code point, null last: utf-8 bytes have the order of code points.
        rank = frame["source"].map(lambda s: (s is None, (s or "").encode()))
        f = frame.iloc[sorted(range(len(frame)), key=rank.to_list().__getitem__)].reset_index(drop=True)
        f["weight"] = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(f))]
        f["target"] = fill_targets(f["source_size"].to_numpy(), f["weight"].to_numpy())
        f["blocks"] = sainte_lague(f["target"].to_numpy(), round(float(f["source_size"].sum()) / BLOCK_TOKENS))
        return f[["skey", "source", "source_size", "weight", "target", "blocks"]]

    return sources.groupBy().applyInPandas(each, "skey string, source string, source_size long, weight int, target double, blocks long")


def shard_quotas(shards: DataFrame) -> DataFrame:
    """(skey, shard, shard_size, blocks of the source) to (skey, shard, shard_size, quota in tokens).

    No shard gets more than MAX_TIMES its size: what its blocks would exceed that by goes to the source's other shards
    by the same rule, as far as they have room.
    """

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("shard", ignore_index=True)
        size = f["shard_size"].to_numpy()
        most = MAX_TIMES * size
        quota, blocks = np.zeros(len(f), np.int64), int(f["blocks"].iloc[0])
        while blocks and (open_ := quota < most).any():
            quota += sainte_lague(np.where(open_, size, 0), blocks) * BLOCK_TOKENS
            over = np.maximum(quota - most, 0)
            quota -= over
            blocks = int(over.sum()) // BLOCK_TOKENS
        f["quota"] = quota
        return f[["skey", "shard", "shard_size", "quota"]]

    return shards.groupBy("skey").applyInPandas(each, "skey string, shard long, shard_size long, quota long")


def source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per document: its size, its source's size and target, and how many of its words the mix takes.

    Null or empty text has size 0 and takes 0; texts of any length are counted whole. A null source is a source of its
    own, after all others; a null id is an id. Repeated rows lie side by side and are taken one by one. Ties in the
    seeded order go by id, size and text. Other columns are ignored. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(id_col, text_col).alias("row"))
    sized = stored(sized.withColumn("skey", source_key()), "mix-sizes")
    # A source has as many shards as its own size asks for, so small sources aren't spread thin.
    per_source = stored(sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-totals")
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_tokens), F.ceil(F.col("rows") / SHARD_ROWS))
    sources = stored(source_quotas(per_source.select("skey", "source", "source_size")), "mix-sources")
    number = broadcast_if_small(stored(per_source.select("skey", shards.alias("shards")), "mix-shards"), 100)
    dealt = sized.join(number, "skey").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "row"), F.col("shards"))).drop("shards")
    per_shard = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = shard_quotas(per_shard.join(sources.select("skey", "blocks"), "skey"))
    quotas = quotas.join(sources.select("skey", "source_size", "target"), "skey")
    w = Window.partitionBy("skey", "shard").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "id"), "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(w)).join(quotas, ["skey", "shard"])
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("quota") - whole * F.col("shard_size")
    part = F.greatest(F.least(F.col("size"), rest - (F.col("end") - F.col("size"))), F.lit(0).cast("long"))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (whole * F.col("size") + part).alias("taken"), F.col("source").alias(source_col))
