"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is WINDOW consecutive words; its minimiser is the least hash among its runs of MINIMISER words.
Consecutive windows that share a minimiser make one super-k-mer. Equal super-k-mers are settled by their hash:
only the smallest document's occurrence is of interest any more. Where different super-k-mers share a
minimiser, they travel to its bucket as packed strings, and sorting the bucket's windows finds the equal ones.
Minimisers with many super-k-mers are split: their windows are counted by a map-side aggregate instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsieve.llm.common import HASHER, MULTIPLIER, SECOND_MULTIPLIER, broadcast_if_small, discard, free_name, grams, long_array, map_arrow, small_batches, stored

WINDOW = 50
MINIMISER = 10
#: Super-k-mers of one minimiser that a bucket takes; above, its windows are spread by their own hash.
BUCKET_ROWS = 20_000
#: Windows that a bucket task sorts at a time, whole minimisers each.
SORT_WINDOWS = 1_000_000
_SHIFT = 1 << 31
_hasher = HASHER
_WORD = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_powers = _Powers(SECOND_MULTIPLIER)


def super_kmers(h: np.ndarray, window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the word hashes of a text: minimiser, hash of all its words, first window and number of windows of each super-k-mer."""
    windows = len(h) - window + 1
    if windows < 1:
        e = np.empty(0, np.uint64)
        return e, e, np.empty(0, np.int64), np.empty(0, np.int64)
    least, width, need = grams(h, minimiser), 1, window - minimiser + 1
    while 2 * width <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:windows], least[need - width : need - width + windows])
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(start, windows))
    up, down = _powers.get(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    body = (total[start + count + window - 1] - total[start]) * down[start]
    return least[start], body, start, count


def _parts(docs: DataFrame) -> DataFrame:
    """(id, th, mk, body, at) of every super-k-mer of every document; th tells texts of one id apart, at has the first
    window and, in its low 31 bits, their number."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, ths, cols = batch[0].to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False), []
        for k, text in enumerate(batch[2].to_pylist()):
            mk, body, start, count = super_kmers(_hasher.array(text.split()))
            if len(mk):
                cols.append((np.full(len(mk), ids[k]), np.full(len(mk), ths[k]), long_array(mk), long_array(body), start * _SHIFT + count))
        if not cols:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], ["id", "th", "mk", "body", "at"])

    rows = docs.where(F.col("id").isNotNull()).select("id", "th", F.col("text").cast("binary"))
    return map_arrow(rows, each, "id long, th long, mk long, body long, at long")


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, th, mk, wide, start, packed): the packed strings of wanted super-k-mers (id, th, mk, at, wide), cut from
    their documents. A task cuts rows of one id and text once.
    """
    # One number less per super-k-mer: that of a wide one is negative.
    at = F.when(F.col("wide"), -F.col("at")).otherwise(F.col("at"))
    each_doc = stored(wanted.groupBy("id", "th").agg(F.collect_list(F.struct("mk", at.alias("at"))).alias("parts")), "substring-wanted")
    each_doc = broadcast_if_small(each_doc, 16, F.size("parts") + 3)
    joined = docs.join(each_doc, ["id", "th"]).select("id", "th", F.col("text").cast("binary").alias("text"), "parts")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        kinds = [pa.int64()] * 3 + [pa.bool_(), pa.int64(), pa.binary()]
        for b in batches:
            rows = []
            for i, th, text, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (i, th) in seen:
                    continue
                seen.add((i, th))
                words = text.split()
                for p in parts:
                    start, windows = divmod(abs(p["at"]), _SHIFT)
                    rows.append((i, th, p["mk"], p["at"] < 0, start, b" ".join(words[start : start + windows + WINDOW - 1])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "th", "mk", "wide", "start", "packed"])

    small_batches(docs.sparkSession)
    return joined.mapInArrow(each, "id long, th long, mk long, wide boolean, start long, packed binary")


def _windows(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window of every packed string, the string it is of, and its place there."""
    first, second, of, at = [], [], [], []
    for k, body in enumerate(packed):
        h = _hasher.array(body.split(b" "))
        first.append(grams(h, WINDOW, MULTIPLIER))
        second.append(grams(h, WINDOW, SECOND_MULTIPLIER))
        of.append(np.full(len(first[-1]), k))
        at.append(np.arange(len(first[-1])))
    return tuple(map(np.concatenate, (first, second, of, at)))


def _sorted_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, th, mk, start, packed) ordered by mk to the spans of words covered by repeated windows."""

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        ids, ths, _, starts, packed = zip(*rows, strict=True)
        first, second, of, at = _windows(packed)
        ids, starts = np.array(ids), np.array(starts)
        own = ids[of]
        order = np.lexsort((own, second, first))
        f, s = first[order], second[order]
        new = np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
        owner = own[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        hit = np.sort(order[own[order] > owner])
        if not len(hit):
            return None
        # Windows side by side in one string are one span.
        head = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(of[hit]) != 0)])
        tail = np.append(head[1:], True)
        a, b = hit[head], hit[tail]
        spans = (starts[of[a]] + at[a]) * _SHIFT + starts[of[a]] + at[b] + WINDOW
        return pa.RecordBatch.from_arrays([pa.array(ids[of[a]]), pa.array(np.array(ths)[of[a]]), pa.array(spans)], ["id", "th", "span"])

    rows, size, last = [], 0, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[2] != last and size > SORT_WINDOWS:
                if (out := settle(rows)) is not None:
                    yield out
                rows, size = [], 0
            last = row[2]
            rows.append(row)
            size += row[4].count(b" ") + 2 - WINDOW
    if rows and (out := settle(rows)) is not None:
        yield out


def _spread_windows(big: DataFrame) -> DataFrame:
    """Spans of split minimisers: each window finds its smallest document by a map-side aggregate."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, second, of, at = _windows(batch[4].to_pylist())
        ids, ths, starts = (batch[k].to_numpy(zero_copy_only=False) for k in (0, 1, 3))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (long_array(first), long_array(second), ids[of], ths[of], starts[of] + at)], ["first", "second", "id", "th", "start"])

    w = map_arrow(big.select("id", "th", "mk", "start", "packed"), each, "first long, second long, id long, th long, start long")
    owner = w.groupBy("first", "second").agg(F.min("id").alias("owner"), F.max("id").alias("most")).where("owner < most")
    return w.join(owner, ["first", "second"]).where("id > owner").select("id", "th", _span(F.col("start"), F.col("start") + WINDOW))


def spans(docs: DataFrame) -> DataFrame:
    """(id, th, spans) with the covered words [span div 2**31, span mod 2**31) of documents (id, th, text)."""
    small_batches(docs.sparkSession)
    all_parts = stored(_parts(docs), "substring-parts")
    # Most minimisers are of one document alone: these go before anything else is looked at.
    met = stored(all_parts.groupBy("mk").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("mk"), "substring-met")
    parts = stored(all_parts.join(broadcast_if_small(met, 8), "mk", "left_semi"), "substring-shared")
    discard(all_parts, met)
    owners = parts.groupBy("mk", "body").agg(F.min("id").alias("owner"), F.max("id").alias("most"))
    # Where one super-k-mer stands in several documents, all but the smallest lose it whole.
    copies = parts.join(owners.where("owner < most"), ["mk", "body"]).where("id > owner")
    whole = copies.select("id", "th", _span(F.shiftright("at", 31), F.shiftright("at", 31) + F.col("at") % _SHIFT + (WINDOW - 1)))
    shared = owners.groupBy("mk").agg(F.count("*").alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high")).where("n > 1 AND low < high")
    # Stored, so that what follows is dealt by minimiser and body: a common minimiser has many bodies.
    shared = stored(shared.select("mk", "n"), "substring-minimisers")
    chosen = stored(owners.join(broadcast_if_small(shared, 16), "mk"), "substring-chosen")
    wanted = parts.join(chosen, ["mk", "body"]).where("id = owner").select("id", "th", "mk", "at", (F.col("n") > BUCKET_ROWS).alias("wide")).distinct()
    packed = stored(_bodies(docs, wanted), "substring-packed")
    small = packed.where(~F.col("wide")).select("id", "th", "mk", "start", "packed")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = small.repartition(n, "mk").sortWithinPartitions("mk").mapInArrow(_sorted_buckets, "id long, th long, span long")
    every = whole.unionByName(small).unionByName(_spread_windows(packed.where("wide")))
    out = stored(_merged(every.groupBy("id", "th").agg(F.collect_set("span").alias("spans"))), "substring-spans")
    discard(parts, shared, chosen, packed)
    return out


def _merged(covered: DataFrame) -> DataFrame:
    """(id, th, spans) with spans that overlap or touch made one."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for own in batch[2].to_pylist():
            x = np.sort(np.array(own, np.int64))
            start, end = x >> 31, np.maximum.accumulate(x & (_SHIFT - 1))
            head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
            out.append((start[head] * _SHIFT + end[np.append(head[1:], len(x)) - 1]).tolist())
        return pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(out, pa.list_(pa.int64()))], ["id", "th", "spans"])

    return map_arrow(covered, each, "id long, th long, spans array<long>")


def _span(start: Column, end: Column) -> Column:
    return (start * _SHIFT + end).cast("long").alias("span")


def _kept(text: bytes, own: list[int] | None) -> tuple[list[bytes], list[int] | None]:
    """A text's words, and which of them stay outside the spans (None: all)."""
    words = text.split()
    if not own:
        return words, None
    keep = np.ones(len(words), bool)
    for s in own:
        keep[s // _SHIFT : s % _SHIFT] = False
    return words, np.flatnonzero(keep).tolist()


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of docs and, as the last one, each row's spans."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    covered = broadcast_if_small(spans(d.withColumn("th", F.xxhash64("text"))), 8, F.size("spans") + 5)
    name = free_name(docs)
    covered = covered.select(F.col("id").alias(f"{name}_id"), F.col("th").alias(f"{name}_th"), F.col("spans").alias(f"{name}_spans"))
    same = (F.col(id_col).cast("long") == F.col(f"{name}_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(f"{name}_th"))
    return docs.join(covered, same, "left").drop(f"{name}_id", f"{name}_th")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space).

    Removed is each word in a window that also starts in a document with a smaller id, judged on the input. Null
    and empty texts have no words; texts under WINDOW words lose none. Rows with the same id don't count as
    others: equal ones fare alike, different ones are judged apart. A row with null id loses nothing and takes
    nothing. Texts of any length are read whole; other columns are ignored. An empty table gives no rows.
    """
    joined = _with_spans(docs.select(id_col, text_col), id_col, text_col)
    rows = joined.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"), joined.columns[-1])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, own in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
            words, at = _kept(text, own)
            left = words if at is None else [words[i] for i in at]
            out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
        cols = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch[0], *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["id", "n_words", "n_removed", "kept_sha256"])

    return map_arrow(rows, each, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with their columns, texts without the removed words (see dedup), and length_col, if there, of these.

    What stays keeps the white space before it; a text that loses nothing stays as it is, null and empty ones too.
    A document that loses all its words goes.
    """
    names = docs.columns
    joined = _with_spans(docs, id_col, text_col)
    at = names.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans_, keep = batch[at].to_pylist(), batch[len(names)].to_pylist(), []
        for k, own in enumerate(spans_):
            keep.append(True)
            if own:
                raw = texts[k].encode()
                _, left = _kept(raw, own)
                pieces = _WORD.findall(raw)
                texts[k] = b"".join([pieces[i] for i in left]).strip().decode()
                keep[-1] = bool(left)
        columns = [pa.array(texts, batch[at].type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    out = map_arrow(joined, each, docs.schema)
    if length_col in names and length_col != text_col:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), F.col(length_col)))
    return out.select(names)
