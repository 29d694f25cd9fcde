"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

1. Documents become sets of hashed word n-grams; equal sets collapse to their smallest id. A set too many of whose
   n-grams occur in no other set can't link with any and is settled: hashes of all n-grams meet in buckets for that.
2. Routing without losing a link: a set is cut by hash range into more parts than two linked sets can differ in
   elements, so two linked sets share a part that is equal and not empty. Documents that share a part's hash, directly
   or through others, are a family; a common line or passage makes no family, as parts mix the whole set.
   Hashes of n-grams and of parts travel packed, five bytes each: a block of documents settles equal ones of its own
   first and sends each remaining hash once, to the bucket where equal ones of all blocks meet.
3. In a family, inverted lists answer each set's query: entries of short lists are counted, and what occurs often
   enough there is looked up in the long lists by binary search. Large families are searched block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsieve.llm.common import HASHER, broadcast_if_small, discard, free_name, grams, long_array, mix, small_batches, spread, stored
from clipsieve.llm.components import components

#: Sets of one block of a family, and their elements; more of either make more blocks.
BLOCK_SETS = 1_024
BLOCK_ELEMENTS = 1_000_000
#: Sets that every block of a large family gets besides its own, so that blocks meet early.
LEADERS = 4
#: Size classes grow by this factor.
CLASS_GROWTH = 1.25
#: Hashes that a task packs at a time, and bytes of text whose hashes one bucket gets, at least and at most:
#: with more than MANY_BUCKETS buckets these grow first, so that what a block sends to a bucket stays packed.
PACK_SIGNATURES = 1_000_000
LEAST_BUCKET, MOST_BUCKET, MANY_BUCKETS = 16_000_000, 160_000_000, 4_096
#: Bytes of a signature in its bucket; two that are equal by chance only cost a comparison.
SIGNATURE_BYTES = 5
#: Fixed value: weight of a probe into a long list against an entry of a merged one, in DivideSkip's rule.
PROBE_COST = 0.0085
_hasher = HASHER


def shingles(text: bytes, n: int) -> np.ndarray:
    """Distinct n-grams of the words, A-Z lower-cased, as sorted hashes; fewer words make one; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = _hasher.array(words)
    # A short text's only gram has its length mixed in, so that it never equals a run of n words.
    return np.unique(grams(h, n) if len(h) >= n else mix(grams(h, len(h)) + np.uint64(len(h))))


def most_apart(size: int, percent: int) -> int:
    """Elements in which a set of this size may differ from one at least as large that it links with."""
    return (100 - percent) * size // percent


def _classes(limit: int) -> list[int]:
    lows = [1]
    while lows[-1] <= limit:
        lows.append(max(lows[-1] + 1, int(lows[-1] * CLASS_GROWTH)))
    return lows


_LOWS = np.array(_classes(1 << 40))


@lru_cache(maxsize=4096)
def _cut(c: int, percent: int) -> tuple[int, int]:
    """Of a size class: the most elements in which the smaller of a linked pair in it may differ from the other, and
    the number of parts. These are one more than the former and as many as may be expected to be empty."""
    apart = most_apart(int(_LOWS[c + 1]) - 1, percent)
    parts = apart + 1
    for _ in range(3):
        empty = parts * math.exp(-int(_LOWS[c]) / parts)
        parts = apart + 1 + math.ceil(empty + 3 * math.sqrt(empty))
    return apart, parts


def signatures(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of parts; two linked, different sets have one in common at least.

    All sets of a size class are cut in the same way, and those just above it in this way too. With d the most
    elements in which a pair differs, a set with more than d parts that aren't empty has one in which the other
    is equal. Sets whose parts are too often empty add the first elements of their order, of which linked sets
    share one as well.
    """
    n = len(tokens)
    if most_apart(n, percent) == 0:
        return np.empty(0, np.uint64)
    k = int(np.searchsorted(_LOWS, n, "right")) - 1
    out, short = [], False
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    for c in (k, k - 1):
        if c < 0 or c < k and percent * n > 100 * (int(_LOWS[k]) - 1):
            continue
        apart, parts = _cut(c, percent)
        if apart == 0:
            continue
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        end = np.append(start[1:], n)
        out.append(mix((sums[end] - sums[start]) ^ mix(part[start] + np.uint64((c + 1) << 32))))
        short |= len(start) <= most_apart(min(n, int(_LOWS[c + 1]) - 1), percent)
    if short:
        first = n - -(-percent * n // 100) + 1
        out.append(mix(tokens[:first] ^ np.uint64(0x2545F4914F6CDD1D)))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


class Index:
    """Inverted lists of the sets of one block."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.tokens, start = np.unique(flat[order], return_index=True)
        self.of, self.start = of[order], np.append(start, len(flat))

    def search(self, query: np.ndarray, percent: int, skip: np.ndarray) -> np.ndarray:
        """The sets that link with the query: percent of the union at least in common. skip masks sets not asked for.

        DivideSkip: a linked set needs percent of the query's size in common, T. The L = T / (cost * log2(longest) + 1)
        longest lists are not merged; a set must then occur in the short lists T - L times.
        """
        need = max(1, -(-percent * len(query) // 100))
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)]
        if len(at) < need:
            return np.empty(0, np.int64)
        length = self.start[at + 1] - self.start[at]
        by_length = at[np.argsort(length, kind="stable")]
        n_long = min(need - 1, len(by_length) - 1, int(need / (PROBE_COST * math.log2(max(2, int(length.max()))) + 1)))
        short, long = by_length[: len(by_length) - n_long], by_length[len(by_length) - n_long :]
        sets, counts = self._merge(short, skip)
        ok = counts >= need - n_long
        ok &= (self.sizes[sets] * 100 >= percent * len(query)) & (percent * self.sizes[sets] <= 100 * len(query))
        sets, counts = sets[ok], counts[ok].copy()
        # What two sets must share: percent * union <= 100 * common, with union = sizes - common.
        wanted = -(-percent * (len(query) + self.sizes[sets]) // (100 + percent))
        for k, t in enumerate(long):
            if not len(sets):
                break
            own = self.of[self.start[t] : self.start[t + 1]]
            place = np.minimum(np.searchsorted(own, sets), len(own) - 1)
            counts += own[place] == sets
            if k % 16 == 15:
                hope = counts + (len(long) - 1 - k) >= wanted
                sets, counts, wanted = sets[hope], counts[hope], wanted[hope]
        return sets[counts >= wanted]

    def _merge(self, lists: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets in the given lists that skip leaves, with the number of lists that hold each, in order: counted in one pass."""
        entries = np.concatenate([self.of[self.start[t] : self.start[t + 1]] for t in lists])
        counts = np.bincount(entries[~skip[entries]], minlength=len(self.sizes))
        found = np.flatnonzero(counts)
        return found, counts[found]


def _search_block(rows: list[tuple[int, int, bool, bool, bytes]], n: int, percent: int) -> list[tuple[int, int]]:
    """Links of one block's rows (node, class, asks, answers, text); sets of one class, given or found, aren't compared."""
    merged: dict[tuple, tuple[bool, bool]] = {}
    for node, own, asks, answers, text in rows:
        before = merged.get((node, text, own), (False, False))
        merged[node, text, own] = (asks or before[0], answers or before[1])
    rows = [(node, own, *flags, text) for (node, text, own), flags in sorted(merged.items())]
    classes: dict[int, int] = {}
    label = np.array([classes.setdefault(r[1], len(classes)) for r in rows])
    answering = np.array([r[3] for r in rows])
    if len(classes) < 2:
        return []
    sets = [shingles(r[4], n) for r in rows]
    index, links = Index(sets), []
    for i, row in enumerate(rows):
        if not row[2]:
            continue
        skip = (label == label[i]) | ~answering
        if skip.all():
            continue
        for j in index.search(sets[i], percent, skip).tolist():
            links.append((row[0], rows[j][0]))
            label[label == label[j]] = label[i]
    return links


def _search(blocks: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (family, block, node, class, asks, answers, text) to links (a, b), a block at a time as they stream in.

    Texts travel, not their sets: they compress, hashes don't.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
            found.clear()
            return out

        for b in batches:
            for family, block, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (family, block):
                    if len(rows) > 1:
                        found += _search_block(rows, n, percent)
                    key, rows = (family, block), []
                    if len(found) > 10_000:
                        yield batch()
                rows.append(tuple(row))
        if len(rows) > 1:
            found += _search_block(rows, n, percent)
        yield batch()

    small_batches(blocks.sparkSession, 100)
    dealt = spread(blocks.select("family", "block", "node", "class", "asks", "answers", "text"), "family", "block").sortWithinPartitions("family", "block")
    return stored(dealt.mapInArrow(each, "a long, b long"), "ngram-links")


def _blocks(sets: Column, elements: Column) -> Column:
    return F.greatest(F.ceil(sets / F.lit(BLOCK_SETS)), F.ceil(elements / F.lit(BLOCK_ELEMENTS))).cast("long")


def _open_groups(large: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(hub, node, size, class) of the sets of large families that share a signature with a set of another class.

    Sets that share a signature share its hub, the smallest of them. Families of one class are left out first.
    """
    known = stored(large.select("family", "node", "size").distinct().join(classes, "node", "left").select("family", "node", "size", F.coalesce("component", "node").alias("class")), "ngram-classes")
    mixed = known.groupBy("family").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("family")
    texts = large.select("node", "text").join(known.join(mixed, "family", "left_semi").select("node", "class"), "node").select("node", "text", "class")
    bytes_ = large.select(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = _route(texts, n, percent, _buckets(bytes_), labelled=True).groupBy("bucket").applyInArrow(_meet_labelled, "hub long, node long, label long")
    return rows.distinct().join(known.select("node", "size"), "node").select("hub", "node", "size", F.col("label").alias("class"))


def _links(texts: DataFrame, families: DataFrame, n: int, percent: int) -> DataFrame:
    """All links between classes found so far, from texts (family, blocks, node, size, text) of families."""
    s = texts.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    own = s.select("family", "block", "node", F.col("node").alias("class"), F.lit(True).alias("asks"), F.lit(True).alias("answers"), "text")
    large = s.where("blocks > 1")
    if large.isEmpty():
        return _search(own, n, percent)
    leading = families.where("blocks > 1").withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("weight"), "node"))).where(F.col("rank") <= LEADERS)
    everywhere = large.join(leading.select("node"), "node", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    everywhere = everywhere.select("family", "block", "node", F.col("node").alias("class"), F.lit(True).alias("asks"), F.lit(True).alias("answers"), "text")
    found = _search(own.unionByName(everywhere), n, percent)
    # Blocks of a large family have not all met. In each hub's group the sets outside its largest class ask all of the
    # group, so every pair of classes that could link has met.
    group = stored(_open_groups(large, components(found), n, percent), "ngram-groups")
    sizes = group.groupBy("hub", "class").agg(F.count("*").alias("sets"))
    largest = sizes.groupBy("hub").agg(F.max(F.struct("sets", "class")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    # A hub with many sets is no hot key: what is joined to its rows is a row per hub, and counts begin in the tasks.
    largest = broadcast_if_small(stored(largest.select("hub", F.col("top.class").alias("top")), "ngram-largest"), 32)
    open_ = group.join(largest, "hub").withColumn("outside", F.col("class") != F.col("top"))
    asked = F.col("outside")
    counts = open_.groupBy("hub").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks"), _blocks(F.count_if(asked), F.sum(F.when(asked, F.col("size")))).alias("askers"))
    open_ = stored(open_.join(broadcast_if_small(stored(counts, "ngram-counts"), 32), "hub"), "ngram-open")
    pair = F.col("asker") * F.col("blocks") + F.col("answerer")
    span = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    asking = open_.where("outside").withColumn("asker", F.pmod(F.xxhash64("node", F.lit(1)), F.col("askers"))).withColumn("answerer", F.explode(span("blocks")))
    answering = open_.withColumn("answerer", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("asker", F.explode(span("askers")))
    both = [d.select(F.col("hub").alias("family"), pair.alias("block"), "node", "class", F.lit(asks).alias("asks"), F.lit(not asks).alias("answers")) for d, asks in ((asking, True), (answering, False))]
    rows = both[0].unionByName(both[1]).groupBy("family", "block", "node", "class").agg(F.max("asks").alias("asks"), F.max("answers").alias("answers"))
    return found.unionByName(_search(rows.join(texts.select("node", "text"), "node"), n, percent))


def _packed(flat: np.ndarray) -> np.ndarray:
    """The low bytes of 64-bit values, a row of SIGNATURE_BYTES each."""
    return np.ascontiguousarray(flat).view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES]


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // SIGNATURE_BYTES, 8), np.uint8)
    wide[:, :SIGNATURE_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, SIGNATURE_BYTES)
    return wide.view(np.uint64)[:, 0]


def _bucket(flat: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its high bits; in the order of the hashes."""
    return (((flat >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from the one before."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def _rows_by_bucket(flat: np.ndarray, of: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, bytes, bytes]]:
    """Hashes, in order, and the place of the set of each, to (bucket, places, how many of each, packed hashes)."""
    bucket = _bucket(flat, buckets)
    order = np.argsort(bucket * (int(of.max(initial=0)) + 1) + of, kind="stable")
    flat, of, bucket = flat[order], of[order], bucket[order]
    head = _starts(bucket, of)
    within, place = bucket[head], of[head]
    counts, packed = np.diff(np.append(head, len(flat))).astype(np.uint32), _packed(flat)
    begin = _starts(within)
    at = np.append(head, len(flat))
    for i, j in zip(begin, np.append(begin[1:], len(within))[: len(begin)], strict=True):
        yield int(within[i]), place[i:j], counts[i:j].tobytes(), packed[at[i] : at[j]].tobytes()


COUNTED = "bucket long, block long, places binary, counts binary, singles binary, several binary, own binary"


def _own(block: list[tuple[int | None, tuple[int, int, int], bool, int]], several: np.ndarray) -> bytes:
    """What a block keeps of its rows until the counts come back: id (and whether it is null), key, how many hashes
    several sets of the block have, whether the row stands for its equal ones here, and the hash of its text."""
    table = np.zeros((len(block), 8), np.int64)
    for k, (i, key, leads, th) in enumerate(block):
        table[k] = (i or 0, i is None, *key, several[k], leads, th)
    return table.tobytes()


def _count(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Rows (id, th, text) to packed rows of n-gram hashes by block of documents and bucket of hashes.

    Of equal sets of a block the first stands for all. A hash that several sets of the block have goes once.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        sets: list[np.ndarray] = []
        leads: dict[tuple[int, int, int], int] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            block = (part << 24) + number
            places = np.array([k for k, r in enumerate(rows) if r[2]], np.int64)
            flat, of = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(places, [len(x) for x in sets])
            order = np.argsort(flat, kind="stable")
            flat, of = flat[order], of[order]
            head = _starts(flat)
            run = np.diff(np.append(head, len(flat)))
            several = np.bincount(of[np.repeat(run > 1, run)], minlength=len(rows))
            shared, alone = flat[head[run > 1]], head[run == 1]
            common = {b: x for b, _, _, x in _rows_by_bucket(shared, np.zeros(len(shared), np.int64), buckets)}
            out = [(b, block, p.astype(np.uint32).tobytes(), c, x, common.pop(b, b""), None) for b, p, c, x in _rows_by_bucket(flat[alone], of[alone], buckets)]
            out += [(b, block, b"", b"", b"", x, None) for b, x in common.items()]
            out.append((block % buckets, block, None, None, None, None, _own(rows, several)))
            for k in range(0, len(out), 256):
                kinds = [pa.int64()] * 2 + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 256], strict=True), kinds, strict=True)], ["bucket", "block", "places", "counts", "singles", "several", "own"])
            rows.clear()
            sets.clear()
            leads.clear()
            number, held = number + 1, 0

        for b in batches:
            for i, th, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = shingles(t, n)
                key = (0, 0, 0)
                if len(x):
                    key = (len(x), *long_array(np.array([np.bitwise_xor.reduce(mix(x)), np.add.reduce(mix(x * np.uint64(3) + np.uint64(1)))], np.uint64)).tolist())
                first = i is not None and len(x) > 0 and key not in leads
                if first:
                    leads[key] = len(rows)
                    sets.append(x)
                    held += len(x)
                rows.append((i, key, first, th))
            if held > PACK_SIGNATURES:
                yield from flush()
        if rows:
            yield from flush()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(each, COUNTED)


def _found(group: pa.Table) -> pa.Table:
    """One bucket's rows to how many of each set's hashes other blocks have too; a block's own rows pass through."""
    rows, flat, of = [], [], []
    for block, places, counts, singles, several, own in zip(*(group[c].to_pylist() for c in ("block", "places", "counts", "singles", "several", "own")), strict=True):
        if own is not None:
            rows.append((block, None, None, own))
            continue
        alone = _unpacked(singles)
        flat += [alone, _unpacked(several)]
        of.append((len(rows), len(alone), len(flat[-1]), np.frombuffer(counts, np.uint32)))
        rows.append((block, places, None, None))
    if flat:
        flat = np.concatenate(flat)
        order = np.argsort(flat)
        twin = flat[order][1:] == flat[order][:-1]
        hit = np.zeros(len(flat), np.int64)
        hit[order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])]] = 1
        at = 0
        for k, alone, several, counts in of:
            total = np.concatenate([[0], np.cumsum(hit[at : at + alone])])
            ends = np.cumsum(counts.astype(np.int64))
            rows[k] = (rows[k][0], rows[k][1], (total[ends] - total[ends - counts]).astype(np.uint32).tobytes(), None)
            at += alone + several
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("block", "places", "found", "own"), zip(*rows, strict=True), kinds, strict=True)})


def _opened(percent: int):
    """Of one block: (id, th, size, first, second, open); open are the sets of which enough hashes occur elsewhere to link."""

    def each(group: pa.Table) -> pa.Table:
        own = np.frombuffer(next(x for x in group["own"].to_pylist() if x is not None), np.int64).reshape(-1, 8)
        seen = own[:, 5].copy()
        for places, found in zip(group["places"].to_pylist(), group["found"].to_pylist(), strict=True):
            if places:
                np.add.at(seen, np.frombuffer(places, np.uint32), np.frombuffer(found, np.uint32).astype(np.int64))
        size = own[:, 2]
        open_ = (own[:, 6] == 1) & (seen * 100 >= percent * size)
        return pa.table({"id": pa.array(own[:, 0], mask=own[:, 1] == 1), "th": pa.array(own[:, 7]), "size": pa.array(size), "first": pa.array(own[:, 3]), "second": pa.array(own[:, 4]), "open": pa.array(open_)})

    return each


def _measure(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(id, th, size, first, second, open) of each row (id, th, text): the set's size and two hashes of it, and whether it could link.

    A set links with another only if percent of its n-grams, at least, occur in other sets: most documents' don't, and
    these are settled here. Hashes of all n-grams meet in buckets, five bytes each, once per block of documents; two that
    are equal by chance only leave a set open.
    """
    found = _count(docs, n, buckets).groupBy("bucket").applyInArrow(_found, "block long, places binary, found binary, own binary")
    return found.groupBy("block").applyInArrow(_opened(percent), "id long, th long, size long, first long, second long, open boolean")


ROUTED = "bucket long, nodes binary, labels binary, counts binary, packed binary, node long, hub long"


def _route(docs: DataFrame, n: int, percent: int, buckets: int, labelled: bool = False) -> DataFrame:
    """Rows (node, text), or (node, text, label), to packed rows of signatures by block of documents and bucket.

    Without labels only the smallest node of a signature in the block sends it, and the others are paired with it here
    (rows with node and hub, which pass through the buckets); with labels all nodes do.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = sorted(rows)
            ids, labels = (np.array([k[c] for k in keys], np.int64) for c in (0, 1))
            flat, of = np.concatenate([rows[k] for k in keys]), np.repeat(np.arange(len(keys)), [len(rows[k]) for k in keys])
            order = np.argsort(flat, kind="stable")
            flat, of = flat[order], of[order]
            out = []
            if not labelled:
                head = _starts(flat)
                lead = np.repeat(of[head], np.diff(np.append(head, len(flat))))
                pairs = np.unique(of[lead != of] * len(keys) + lead[lead != of])
                out = [(int(i) % buckets, None, None, None, None, int(ids[i]), int(ids[j])) for i, j in zip(*divmod(pairs, len(keys)), strict=True)]
                flat, of = flat[head], of[head]
            out += [(b, ids[p].tobytes(), labels[p].tobytes(), c, x, None, None) for b, p, c, x in _rows_by_bucket(flat, of, buckets)]
            for k in range(0, len(out), 256):
                kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 256], strict=True), kinds, strict=True)], ["bucket", "nodes", "labels", "counts", "packed", "node", "hub"])
            rows.clear()

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for k, (i, t) in enumerate(zip(*columns[:2], strict=True)):
                signed = signatures(shingles(t, n), percent)
                key = (i, columns[2][k] if labelled else 0)
                # Rows of one id with different texts are one node.
                rows[key] = np.union1d(rows[key], signed) if key in rows else signed
                held += len(signed)
            if held > PACK_SIGNATURES:
                yield from flush()
                held = 0
        if rows:
            yield from flush()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(each, ROUTED)


def _groups_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket's signatures that several nodes have: node and label of each occurrence, and the first occurrence
    of the same signature, which is that of its smallest node."""
    node, label, flat = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for ids, labels, counts, packed in zip(*(group[c].to_pylist() for c in ("nodes", "labels", "counts", "packed")), strict=True):
        if ids is not None:
            times = np.frombuffer(counts, np.uint32)
            node.append(np.repeat(np.frombuffer(ids, np.int64), times))
            label.append(np.repeat(np.frombuffer(labels, np.int64), times))
            flat.append(_unpacked(packed))
    node, label, flat = map(np.concatenate, (node, label, flat))
    order = np.argsort(flat)
    twin = flat[order][1:] == flat[order][:-1]
    order = order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])] if len(order) else order
    order = order[np.lexsort((node[order], flat[order]))]
    head = _starts(flat[order])
    return node[order], label[order], np.repeat(head, np.diff(np.append(head, len(order))))


def _meet(group: pa.Table) -> pa.Table:
    """One bucket to (node, hub, weight): each node and the smallest one it shares a signature with, and how many."""
    node, _, head = _groups_of(group)
    hub = node[head]
    pairs, weight = np.unique(np.stack([node[node != hub], hub[node != hub]], axis=1), axis=0, return_counts=True)
    known = group.filter(pc.is_valid(group["hub"]))
    columns = (np.concatenate([pairs[:, k], known[c].to_numpy()]) for k, c in enumerate(("node", "hub")))
    return pa.table({**{c: pa.array(x, pa.int64()) for c, x in zip(("node", "hub"), columns, strict=True)}, "weight": pa.array(np.concatenate([weight, np.ones(len(known), np.int64)]), pa.int64())})


def _meet_labelled(group: pa.Table) -> pa.Table:
    """One bucket to (hub, node, label): the nodes of signatures that nodes of different labels share, and the smallest."""
    node, label, head = _groups_of(group)
    mixed = np.zeros(len(node), bool)
    mixed[head[label != label[head]]] = True
    keep = mixed[head]
    rows = np.unique(np.stack([node[head][keep], node[keep], label[keep]], axis=1), axis=0)
    return pa.table({c: pa.array(rows[:, k], pa.int64()) for k, c in enumerate(("hub", "node", "label"))})


def _buckets(size: int) -> int:
    return max(1, -(-size // min(MOST_BUCKET, max(LEAST_BUCKET, size // MANY_BUCKETS))))


def classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, th, size, component) of each row (id, text); th, a hash of the text, tells rows of one id apart."""
    d = docs.withColumn("th", F.xxhash64("text"))
    binary = F.col("text").cast("binary").alias("text")
    bytes_ = d.select(F.sum(F.octet_length("text"))).first()[0] or 0
    measured = stored(_measure(d.select("id", "th", binary), n, percent, _buckets(bytes_)), "ngram-sizes")
    equal = ["size", "first", "second"]
    # Sets in which nothing may differ are settled by equality. Of rows of one id each set counts.
    smallest = stored(measured.where("size > 0 AND id IS NOT NULL").groupBy(*equal).agg(F.min("id").alias("node"), F.bool_or("open").alias("open")), "ngram-nodes")
    asked = smallest.where(F.col("open") & F.expr(f"({100 - percent} * size) div {percent} > 0"))
    nodes = stored(asked.groupBy("node").agg(F.sum("size").alias("size")), "ngram-open")
    routed = _route(d.withColumnRenamed("id", "node").join(broadcast_if_small(nodes, 16), "node").select("node", binary), n, percent, _buckets(bytes_))
    edges = routed.groupBy("bucket").applyInArrow(_meet, "node long, hub long, weight long")
    edges = stored(edges.groupBy("node", "hub").agg(F.sum("weight").alias("weight")), "ngram-edges")
    member = components(edges, "node", "hub")
    family = member.withColumnRenamed("component", "family")
    weight = edges.select("node", "weight").unionByName(edges.select(F.col("hub").alias("node"), "weight")).groupBy("node").agg(F.sum("weight").alias("weight"))
    family = family.join(nodes, "node")
    total = family.groupBy("family").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks"))
    families = stored(family.join(total, "family").join(weight, "node"), "ngram-families")
    discard(member, edges, nodes)
    routes = broadcast_if_small(families, 40).select("node", "family", "blocks", "size")
    texts = stored(d.withColumnRenamed("id", "node").join(routes, "node").select("family", "blocks", "node", "size", binary), "ngram-texts")
    links = stored(_links(texts, families, n, percent), "ngram-all-links")
    found = components(links)
    discard(texts, families, links)
    out = measured.join(smallest, equal, "left").join(found, "node", "left")
    component = F.when(F.col("size") == 0, F.col("id")).otherwise(F.coalesce("component", "node"))
    return out.select("id", "th", "size", F.when(F.col("id").isNotNull(), component).alias("component"))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two documents link when 100 * common >= percent * union of their sets of word n-grams. Null, empty and blank
    texts have no shingles and link with nothing; texts of any length are read whole. A row with null id has no
    component. Repeated rows count as one document; rows of one id with different texts link as that document, each
    with its own n_shingles. Ties (equal sets) fall to the smallest id. Other columns are ignored. An empty table
    gives no rows.
    """
    return classes(_plain(docs, id_col, text_col), n, percent).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their columns; of each class of linked documents only those of the smallest id.

    A row without id or shingles stays. Of repeated rows (equal in all columns) one stays; rows of one id with different
    texts each stay or go by their own set. An empty table gives no rows.
    """
    found = stored(classes(_plain(docs, id_col, text_col), n, percent), "ngram-classes")
    clash = free_name(docs)
    later = broadcast_if_small(stored(found.where("component <> id").select(F.col("id").alias(f"{clash}_id"), F.col("th").alias(f"{clash}_th")).distinct(), "ngram-later"), 16)
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = docs.join(later, (F.col(id_col).cast("long") == F.col(f"{clash}_id")) & (own == F.col(f"{clash}_th")), "left_anti")
    again = stored(found.where("id IS NOT NULL").groupBy("id", "th").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias(f"{clash}_id")).distinct(), "ngram-again")
    if again.isEmpty():
        return kept
    repeated = broadcast_if_small(again, 8)
    same = F.col(id_col).cast("long") == F.col(f"{clash}_id")
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(docs.columns))
