"""Ranked lexical search over dual-sorted wavelet trees, one per shard of documents.

A shard holds the postings of all its terms as one sequence of documents: lists stand one after the other, each in
order of descending impact. A wavelet matrix over that sequence makes it navigable by document, too: its levels split
the documents in halves and keep the order of the lists, so that in every node the first posting of a list's interval
has the list's largest impact among the node's documents. The sum of these over the terms of a query bounds the score
of all documents below the node, and at a leaf it is the score. Best-first expansion of the intervals of all terms
together then finds the best documents, and stops when no bound is left that could beat the k-th of them.

Impacts don't depend on the query: term frequencies damped by the document's length against the mean.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsieve.llm.common import bytes_column, discard, small_batches, stored

#: A shard is closed once it has so many postings or documents, or so many bytes of text; it exceeds them by a document.
SHARD_POSTINGS, SHARD_DOCS, SHARD_BYTES = 1_000_000, 1 << 16, 32_000_000
#: Nodes that one step of the search expands together, the best ones.
STEP = 128
#: Bytes of query text that are sent to the tasks at a time; further queries are searched for in further passes.
QUERY_BYTES = 1_000_000

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Fixed values of the score: an impact is SCALE * tf div (1000 * tf + 8 * m), m a document's length against the mean.
SCALE, FLAT, STEEP = 1_000_000_000, 10, 90
#: An impact is below 2 ** 20, as it is SCALE / 1000 at most.
IMPACT_BITS, DOC_BITS = 20, 17

#: Bytes to bytes: A-Z in lower case, other ASCII characters than letters and digits to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RAW_SCHEMA = "docs array<long>, sizes binary, terms binary, first binary, doc binary, tf binary, n_docs long, n_terms long"
INDEX_SCHEMA = "docs array<long>, terms binary, first binary, impacts binary, bits binary"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_FOLD).split()


class _Shard:
    """Postings of documents as they come."""

    def __init__(self, limits: tuple[int, int, int]) -> None:
        self.limits = limits
        self.number: dict[bytes, int] = {}
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings = self.bytes = 0

    def add(self, doc: int | None, text: bytes) -> None:
        words, number = terms_of(text), self.number
        self.bytes += len(text)
        if not words:
            return
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        terms, tf = np.unique(ids, return_counts=True)
        self.docs.append(doc)
        self.sizes.append(len(words))
        self.parts.append((terms, tf))
        self.postings += len(terms)

    def full(self) -> bool:
        return any(x >= most for x, most in zip((self.postings, len(self.docs), self.bytes), self.limits, strict=True))

    def row(self) -> dict:
        """Documents in order of id, null last; terms in order of their bytes; postings by term, then document."""
        place = sorted(range(len(self.docs)), key=lambda i: (self.docs[i] is None, self.docs[i] or 0))
        names = sorted(self.number)
        rank = np.empty(len(names), np.int64)
        rank[[self.number[w] for w in names]] = np.arange(len(names))
        own = [self.parts[i] for i in place]
        term = rank[np.concatenate([t for t, _ in own])]
        doc = np.repeat(np.arange(len(own)), [len(t) for t, _ in own])
        order = np.argsort(term, kind="stable")
        first = np.searchsorted(term[order], np.arange(len(names) + 1))
        return {
            "docs": [self.docs[i] for i in place], "sizes": np.array([self.sizes[i] for i in place], np.int64).tobytes(), "terms": b" ".join(names), "first": first.astype(np.int32).tobytes(),
            "doc": doc[order].astype(np.int32).tobytes(), "tf": np.concatenate([f for _, f in own])[order].astype(np.int32).tobytes(), "n_docs": len(own), "n_terms": sum(self.sizes),
        }


def _batch(row: dict, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], list(kinds))


_RAW = {"docs": pa.list_(pa.int64()), "sizes": pa.binary(), "terms": pa.binary(), "first": pa.binary(), "doc": pa.binary(), "tf": pa.binary(), "n_docs": pa.int64(), "n_terms": pa.int64()}
_INDEX = {"docs": pa.list_(pa.int64()), "terms": pa.binary(), "first": pa.binary(), "impacts": pa.binary(), "bits": pa.binary()}


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, int, int] | None = None) -> DataFrame:
    """Shards of what each task reads: documents with terms, and their postings. No document crosses a shuffle."""
    limits = limits or (SHARD_POSTINGS, SHARD_DOCS, SHARD_BYTES)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(limits)
        for b in batches:
            for doc, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                shard.add(doc, text)
                if shard.full():
                    if shard.docs:
                        yield _batch(shard.row(), _RAW)
                    shard = _Shard(limits)
        if shard.docs:
            yield _batch(shard.row(), _RAW)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), bytes_column(text_col).alias("text"))
    return rows.mapInArrow(pack, RAW_SCHEMA)


def wavelet(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The bits of each level of the wavelet matrix over a sequence of documents, from the highest bit down."""
    levels = max(1, (n_docs - 1).bit_length())
    out = np.zeros((levels, -(-len(doc) // 8)), np.uint8)
    for level in range(levels):
        bit = (doc >> (levels - 1 - level) & 1).astype(bool)
        out[level] = np.packbits(bit, bitorder="little")
        doc = np.concatenate([doc[~bit], doc[bit]])
    return out


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """A stored row per shard with its tree, the number of documents that have a term, and the number of terms.

    Impacts need the mean length over all documents, so that postings are stored first and sorted after.
    """
    spark = docs.sparkSession
    raw = stored(postings(docs, id_col, text_col), "search-postings")
    n = raw.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = n["docs"] or 0, n["terms"] or 0

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first, tf, doc = (np.frombuffer(r[k], np.int32).astype(np.int64) for k in ("first", "tf", "doc"))
                m = FLAT + STEEP * np.frombuffer(r["sizes"], np.int64) * n_docs // n_terms
                impact = SCALE * tf // (1000 * tf + 8 * m[doc])
                # One sort brings each list into order: by term, descending impact, document.
                key = (np.repeat(np.arange(len(first) - 1), np.diff(first)) << IMPACT_BITS | (1 << IMPACT_BITS) - 1 - impact) << DOC_BITS | doc
                key.sort()
                impact = (1 << IMPACT_BITS) - 1 - (key >> DOC_BITS & (1 << IMPACT_BITS) - 1)
                bits = wavelet(key & (1 << DOC_BITS) - 1, len(r["docs"]))
                yield _batch({"docs": r["docs"], "terms": r["terms"], "first": r["first"], "impacts": impact.astype(np.int32).tobytes(), "bits": bits.tobytes()}, _INDEX)

    small_batches(spark, 1)
    shards = stored(raw.mapInArrow(build, INDEX_SCHEMA), "search-index")
    discard(raw)
    return shards, n_docs, n_terms


@dataclass
class Tree:
    """A shard's wavelet matrix, unpacked for rank: for each level 64-bit words, ones before each, zeros in all; and the
    impacts in the order of each level, the last of which is that of the documents."""

    docs: list[int | None]
    place: dict[bytes, int]
    first: np.ndarray
    words: np.ndarray
    before: np.ndarray
    zeros: np.ndarray
    impacts: np.ndarray

    @classmethod
    def of(cls, r: dict) -> Tree:
        impact = np.frombuffer(r["impacts"], np.int32)
        n = len(impact)
        levels = max(1, (len(r["docs"]) - 1).bit_length())
        packed = np.frombuffer(r["bits"], np.uint8).reshape(levels, -1)
        wide = np.zeros((levels, 8 * (n // 64 + 1)), np.uint8)
        wide[:, : packed.shape[1]] = packed
        words = wide.view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        before = np.cumsum(ones, axis=1) - ones
        impacts = np.empty((levels + 1, n), np.int32)
        impacts[0] = impact
        for level in range(levels):
            bit = np.unpackbits(packed[level], count=n, bitorder="little").astype(bool)
            impacts[level + 1] = np.concatenate([impacts[level][~bit], impacts[level][bit]])
        names = r["terms"].split(b" ")
        return cls(r["docs"], dict(zip(names, range(len(names)), strict=True)), np.frombuffer(r["first"], np.int32).astype(np.int64), words.reshape(-1), before.reshape(-1), n - ones.sum(axis=1), impacts.reshape(-1))

    @property
    def levels(self) -> int:
        return len(self.zeros)

    def rank(self, level: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ones before a place of a level."""
        at = level * (len(self.words) // self.levels) + (place >> 6)
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)


#: What is known of a document so far: its score and its id, null after all numbers. Larger is better.
def _worth(score: int, doc: int | None) -> tuple[int, float]:
    return score, -math.inf if doc is None else -doc


def search(tree: Tree, query: dict[bytes, int], k: int, best: list[tuple[tuple, int | None]], step: int = STEP) -> None:
    """Puts the documents of a shard that belong to the k best ones into best, a heap of (worth, id) with the worst first.

    query has the weight of each term. What best holds already, from other shards, bounds the search from the start.
    """
    known = [(tree.place[t], w) for t, w in query.items() if w > 0 and t in tree.place]
    if not known:
        return
    term, weight = (np.array(x, np.int64) for x in zip(*known, strict=True))
    n, levels = len(tree.impacts) // (tree.levels + 1), tree.levels
    # Intervals of all nodes that wait, one array per expansion; the heap names a node by its slice there.
    start, end = tree.first[term], tree.first[term + 1]
    held = [(start, end, weight)]
    heap = [(-int((weight * tree.impacts[start]).sum()), 0, 0, 0, 0, len(term))]  # minus bound, first document, level, array, slice

    def beaten(bound: int, doc: int) -> bool:
        return len(best) == k and _worth(bound, tree.docs[doc]) <= best[0][0]

    while heap:
        taken = []
        while heap and len(taken) < step:
            node = heapq.heappop(heap)
            if beaten(-node[0], node[1]):
                heap.clear()  # those left are no better
                break
            if node[2] < levels:
                taken.append(node)
                continue
            found = (_worth(-node[0], tree.docs[node[1]]), tree.docs[node[1]])
            if len(best) < k:
                heapq.heappush(best, found)
            else:
                heapq.heapreplace(best, found)
        if not taken:
            continue
        size = np.array([t[5] - t[4] for t in taken])
        s, e, w = (np.concatenate([held[t[3]][c][t[4] : t[5]] for t in taken]) for c in range(3))
        level = np.repeat(np.array([t[2] for t in taken]), size)
        node = np.repeat(np.arange(len(taken)), size)
        ones_s, ones_e = tree.rank(level, s), tree.rank(level, e)
        zeros = tree.zeros[level]
        s, e = np.concatenate([s - ones_s, zeros + ones_s]), np.concatenate([e - ones_e, zeros + ones_e])
        child = np.concatenate([2 * node, 2 * node + 1])
        some = e > s
        s, e, w, child, level = s[some], e[some], np.concatenate([w, w])[some], child[some], np.concatenate([level, level])[some] + 1
        order = np.argsort(child, kind="stable")
        s, e, w, child, level = s[order], e[order], w[order], child[order], level[order]
        names, at = np.unique(child, return_index=True)
        bounds = np.add.reduceat(w * tree.impacts[level * n + s], at)
        stop = np.append(at[1:], len(child))
        held.append((s, e, w))
        for c, lo, hi, bound in zip(names.tolist(), at.tolist(), stop.tolist(), bounds.tolist(), strict=True):
            _, doc, above, *_ = taken[c >> 1]
            doc += (c & 1) << (levels - 1 - above)
            if bound > 0 and not beaten(bound, doc):
                heapq.heappush(heap, (-bound, doc, above + 1, len(held) - 1, lo, hi))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _frequencies(shards: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """The number of documents that hold each of some terms; only the shards' vocabularies are read."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first = np.frombuffer(r["first"], np.int32)
                found = [(t, int(first[i + 1] - first[i])) for i, t in enumerate(r["terms"].split(b" ")) if t in terms]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["term", "n"])

    got = shards.select("terms", "first").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in got.collect()}


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: of each query (item_id, text) the k documents with the best score above 0.

    A score sums, over the query's terms, once each, weight times impact. Equal scores go by ascending doc_id, a null
    one last. Repeated documents are documents of their own, repeated queries queries of their own; a null or empty text
    has no terms. Texts are searched whole, of any length; other columns are ignored. Without documents, or for a query
    none of whose terms occurs, there are no rows. Queries are held in the driver QUERY_BYTES of text at a time.
    """
    spark = docs.sparkSession
    rows = spark.conf.get(BATCH)  # shards go one by one, here only
    shards, n_docs, _ = index(docs)
    kind = dict(queries.dtypes)[query_id]
    asked = stored(queries.select(F.col(query_id).alias("item"), bytes_column("text")).withColumn("n", F.octet_length("text")), "search-queries")
    blocks = 1 + (asked.agg(F.sum("n")).first()[0] or 0) // QUERY_BYTES
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = []
    for block in range(blocks):
        own = [(r["item"], set(terms_of(bytes(r["text"])))) for r in asked.where(F.col("block") == block).select("item", "text").collect()]
        if found := _searched(shards, own, n_docs, k, kind, block):
            out.append(found)
    spark.conf.set(BATCH, rows)
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    # Each task has left k rows of a query at most; of equal rows any order will do.
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _searched(shards: DataFrame, queries: list[tuple[object, set[bytes]]], n_docs: int, k: int, kind: str, block: int) -> DataFrame | None:
    df = _frequencies(shards, set().union(*(t for _, t in queries))) if queries else {}
    weighted = [{t: weight(n_docs, df[t]) for t in sorted(terms) if t in df} for _, terms in queries]
    if not any(weighted):
        return None

    spark, step = shards.sparkSession, STEP

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's shards one after the other: what the first have given bounds the others.
        best: list[list] = [[] for _ in weighted]
        for b in batches:
            for r in b.to_pylist():
                tree = Tree.of(r)
                for query, own in zip(weighted, best, strict=True):
                    search(tree, query, k, own, step)
        rows = [(q, doc, worth[0]) for q, own in enumerate(best) for worth, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64()))], ["q", "doc_id", "score"])

    small_batches(spark, 1)
    found = stored(shards.mapInArrow(find, "q long, doc_id long, score long"), "search-found")
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(queries)], f"q long, item {kind}")
    return found.join(names, "q").select(F.concat_ws(" ", F.lit(block), "q").alias("query"), "item", "doc_id", "score")
