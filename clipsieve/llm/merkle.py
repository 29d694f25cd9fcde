"""Merkle manifest of a dataset: a hash tree per key, one tree above the keys' roots, and a proof for every row.

The trees grow by events. A digest that arrives is put into its place in its parent, which is partial until it has as
many children as the number of rows says; then it becomes a digest itself and arrives one level up. Tasks do this for
the runs of rows that they hold; what lacks a sibling there, the frontier, is dealt anew by ancestor with combineByKey,
some levels per round. Complete parents keep links to their children, which read backwards are the proofs: a path is
written from the top down, round by round, and at last within each run. Rows cross a shuffle once, as digests.

A path is text: for each level L or R and the digest of the sibling on that side, or S where there is none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clipsieve.llm.common import broadcast_if_small, small_batches, stored

#: Rows of a run: neighbours in order that a task holds together. At most 2 x 13 of its digests are frontier.
RUN = 8_192
#: The first round combines up to this level, at which a run's own nodes never are; each later one this much higher.
FIRST_LEVEL, MORE_LEVELS = 14, 10

GROUP_SCHEMA = "key string, size long, level int, index long, digest string, done boolean, pieces array<struct<home: long, level: int, index: long, path: string>>"


def digest_of(*children: str | None) -> str:
    return hashlib.sha256("".join(c for c in children if c).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves."""
    return (size - 1).bit_length()


@dataclass
class Partial:
    """Parents that wait for children, and the links of those that don't: the combiner of combineByKey."""

    size: int
    ceiling: int
    pending: dict[tuple[int, int], dict[int, str]] = field(default_factory=dict)
    links: dict[tuple[int, int], tuple[str, str | None]] = field(default_factory=dict)
    tops: list[tuple[int, int, str]] = field(default_factory=list)
    came: list[tuple[int, int, int]] = field(default_factory=list)

    def arrive(self, level: int, index: int, digest: str) -> Partial:
        """An event: a digest takes its place; a parent that is complete with it arrives one level up, and so on."""
        while level < self.ceiling:
            places = -(-self.size >> level)
            parent, arity = (level + 1, index >> 1), min(2, places - (index & ~1))
            children = self.pending.setdefault(parent, {})
            children[index & 1] = digest
            if len(children) < arity:
                return self
            del self.pending[parent]
            self.links[parent] = (children[0], children.get(1))
            (level, index), digest = parent, digest_of(children[0], children.get(1))
        self.tops.append((level, index, digest))
        return self

    def frontier(self) -> list[tuple[int, int, str]]:
        """(level, index, digest) of what no parent here is complete for."""
        return self.tops + [(level - 1, 2 * index + side, d) for (level, index), children in self.pending.items() for side, d in children.items()]

    def merge(self, other: Partial) -> Partial:
        """Events of another combiner of the same group: its frontier arrives here, its links are kept."""
        self.links |= other.links
        self.came += other.came
        for node in other.frontier():
            self.arrive(*node)
        return self

    def step(self, level: int, index: int) -> str:
        """What a path says at a node whose parent is complete."""
        sibling = self.links[level + 1, index >> 1][1 - (index & 1)]
        return "S" if sibling is None else ("L" if index & 1 else "R") + sibling

    def path(self, level: int, index: int) -> str:
        """From a node up to the ceiling."""
        out = []
        while level < self.ceiling:
            out.append(self.step(level, index))
            level, index = level + 1, index >> 1
        return "".join(out)


def fold(digest: str, path: str) -> str:
    """The root that a digest and its path lead to."""
    at = 0
    while at < len(path):
        side = path[at]
        if side == "S":
            digest, at = digest_of(digest), at + 1
        else:
            sibling, at = path[at + 1 : at + 65], at + 65
            digest = digest_of(sibling, digest) if side == "L" else digest_of(digest, sibling)
    return digest


def arrange(rows: DataFrame) -> DataFrame:
    """(key, tag, digest, alt) to runs (key, size, start, tags, digests, alts): rows of a key in order of tag, then digest.

    Null tags come first. A run's start is its place among the size rows of its key. rows should be a stored table, as
    the range partitioning reads it twice. Only rows alike in key, tag and digest can't be told apart and stay together.
    """
    spark = rows.sparkSession
    order = ("key", "tag", "digest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "key", "tag", "digest", "alt")
    kind = dict(rows.dtypes)["tag"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pos = object(), 0
        for b in batches:
            at, runs = 0, {"part": [], "key": [], "pos": [], "n": [], "tags": [], "digests": [], "alts": []}
            for key, own in groupby(b["key"].to_pylist()):
                size = sum(1 for _ in own)
                pos, last = (pos if key == last else 0), key
                part = b.slice(at, size)
                for name, value in zip(runs, (part["part"][0].as_py(), key, pos, size, *(part[c].to_pylist() for c in ("tag", "digest", "alt"))), strict=True):
                    runs[name].append(value)
                pos, at = pos + size, at + size
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(runs.values(), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(b.schema.field("tag").type), pa.list_(pa.binary()), pa.list_(pa.binary())), strict=True)], list(runs))

    small_batches(spark, RUN)
    runs = stored(dealt.mapInArrow(pack, f"part int, key string, pos long, n long, tags array<{kind}>, digests array<binary>, alts array<binary>"), "merkle-runs")
    # A row per partition and key: how many rows of the key stand before.
    sizes = runs.groupBy("key", "part").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    places = stored(sizes.select("key", "part", before.alias("before"), F.sum("n").over(of).alias("size")), "merkle-places")
    return runs.join(broadcast_if_small(places, 60), ["key", "part"]).select("key", "size", (F.col("before") + F.col("pos")).alias("start"), "tags", "digests", "alts")


def grown(start: int, size: int, digests: Iterable[bytes], ceiling: int) -> Partial:
    """The parents of a run of leaves, as far as it goes, and not above the first round's ceiling (a last node may rise alone)."""
    p = Partial(size, min(height(size), ceiling))
    for i, d in enumerate(digests, start):
        p.arrive(0, i, d.hex())
    return p


def _map_runs(runs: DataFrame, each: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that a function yields for each run, a batch of some runs at a time."""
    small_batches(runs.sparkSession, 4)
    kind = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = list(each(*row))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], arrow_schema)

    return runs.mapInArrow(run, kind)


def climb(runs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, size, digest) of the roots, and each round's groups with the links of what they combined."""
    spark = runs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    first = FIRST_LEVEL  # tasks import this module anew

    def frontier(key: str, size: int, start: int, digests: list[bytes]) -> Iterator[tuple]:
        for level, index, digest in grown(start, size, digests, first).frontier():
            yield key, size, start, level, index, digest

    nodes = stored(_map_runs(runs.select("key", "size", "start", "digests"), frontier, "key string, size long, home long, level int, index long, digest string"), "merkle-frontier")
    largest = runs.agg(F.max("size")).first()[0] or 1
    rounds, ceiling = [], first
    while not rounds or ceiling - MORE_LEVELS < height(largest):
        rounds.append(stored(spark.createDataFrame(_combined(nodes, ceiling, parts), GROUP_SCHEMA), "merkle-round"))
        nodes = rounds[-1].where("NOT done").select("key", "size", F.lit(0).cast("long").alias("home"), "level", "index", "digest")
        ceiling += MORE_LEVELS
    done = [r.where("done").select("key", "size", "digest") for r in rounds]
    roots = done[0]
    for r in done[1:]:
        roots = roots.unionByName(r)
    return roots, rounds


def _combined(nodes: DataFrame, ceiling: int, parts: int):
    """A row for each group, the descendants of a node at the ceiling or of a root below it."""

    def event(r) -> tuple:
        key, size, home, level, index, digest = r
        top = min(ceiling, height(size))
        return (key, index >> (top - level)), (size, top, home, level, index, digest)

    def add(p: Partial, v: tuple) -> Partial:
        _, _, home, level, index, digest = v
        p.came.append((home, level, index))
        return p.arrive(level, index, digest)

    def create(v: tuple) -> Partial:
        return add(Partial(v[0], v[1]), v)

    def close(group: tuple) -> tuple:
        (key, _), p = group
        if p.pending or len(p.tops) != 1:
            raise ValueError(f"digests of {key!r} are missing or doubled")
        level, index, digest = p.tops[0]
        return key, p.size, level, index, digest, level == height(p.size), [(home, at, i, p.path(at, i)) for home, at, i in p.came]

    def deal(group: tuple) -> int:
        return int(hashlib.md5(f"{group[1]} {group[0]}".encode()).hexdigest()[:8], 16)

    return nodes.rdd.map(event).combineByKey(create, add, Partial.merge, parts, deal).map(close)


def descend(runs: DataFrame, rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Runs with the paths of their frontier to the top, and the other columns of tops (key, path, ...)."""
    extra = [c for c in tops.columns if c not in ("key", "path")]
    tops, paths = broadcast_if_small(tops, 4_000), None
    for r in reversed(rounds):
        above = r.where("done").join(tops, "key").select("key", "pieces", F.col("path").alias("above"), *extra)
        if paths is not None:
            higher = paths.select("key", "level", "index", F.col("path").alias("above"), *extra)
            above = above.unionByName(r.where("NOT done").join(higher, ["key", "level", "index"]).select("key", "pieces", "above", *extra))
        flat = above.select("key", "above", *extra, F.explode("pieces").alias("p"))
        paths = flat.select("key", "p.home", "p.level", "p.index", F.concat("p.path", "above").alias("path"), *extra)
    own = paths.groupBy("key", F.col("home").alias("start")).agg(F.collect_list(F.struct("level", "index", "path")).alias("paths"), *(F.first(c).alias(c) for c in extra))
    own = stored(own, "merkle-paths")
    return runs.join(broadcast_if_small(own, 4_000, F.size("paths")), ["key", "start"])


def leaf_paths(start: int, size: int, digests: list[bytes], paths: list[dict], ceiling: int) -> list[str]:
    """The path of each leaf of a run, from those of its frontier: the links read backwards."""
    p = grown(start, size, digests, ceiling)
    known = {(n["level"], n["index"]): n["path"] for n in paths}
    for parent in sorted(p.links, reverse=True):
        level, index = parent[0] - 1, 2 * parent[1]
        # Only what the proofs of this run pass through is written down, and a parent's path isn't needed after.
        above = known.pop(parent)
        for i in (index, index + 1)[: 1 + (p.links[parent][1] is not None)]:
            known[level, i] = p.step(level, i) + above
    return [known[0, i] for i in range(start, start + len(digests))]


def field_text(c: Column) -> Column:
    """A field as it enters a leaf: - for null, else its length in bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_text, fields)), 256))


def manifest(docs: DataFrame, tampered: Callable[[Column], Column], with_path: bool = False) -> DataFrame:
    """Per row: doc_id, lang, leaf, subroot, root, proof_sha256, folded_root and verified; path too if asked for.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Rows of a lang are leaves in order of doc_id, of
    equal ids in order of their digest (a null id first, a null lang is a lang of its own and first); repeated rows are
    leaves of their own. tampered gets the doc_id and says which rows are tampered with: one is added to their n_chars,
    a null one stays. Texts of any length enter whole, an empty one isn't a null one. Other columns are ignored. An
    empty table has no rows and no root.
    """
    first = FIRST_LEVEL
    i, s, g, n, t = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    more = leaf(i, s, g, n.cast("decimal(20,0)") + 1, t)
    key = F.when(g.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), g))  # null first
    rows = docs.select(key.alias("key"), i.cast("long").alias("tag"), leaf(i, s, g, n, t).alias("digest"), F.when(F.coalesce(tampered(i), F.lit(False)) & n.isNotNull(), more).alias("alt"))
    runs = arrange(stored(rows, "merkle-leaves"))
    roots, rounds = climb(runs)
    # The same once more, with the keys' roots as leaves.
    nothing = F.lit(None).cast("binary").alias("alt")
    top_runs = arrange(stored(roots.select(F.lit("").alias("key"), F.col("key").alias("tag"), F.unhex("digest").alias("digest"), nothing), "merkle-roots"))
    top, top_rounds = climb(top_runs)

    def subroots(key: str, start: int, size: int, tags: list[str], digests: list[bytes], paths: list[dict], root: str) -> Iterator[tuple]:
        for tag, d, path in zip(tags, digests, leaf_paths(start, size, digests, paths, first), strict=True):
            yield tag, path, d.hex(), root

    above = descend(top_runs, top_rounds, top.select("key", F.lit("").alias("path"), F.col("digest").alias("root")))
    tops = stored(_map_runs(above.select("key", "start", "size", "tags", "digests", "paths", "root"), subroots, "key string, path string, subroot string, root string"), "merkle-tops")

    def proofs(key: str, start: int, size: int, tags: list[int], digests: list[bytes], alts: list[bytes | None], paths: list[dict], subroot: str, root: str) -> Iterator[tuple]:
        for tag, d, alt, path in zip(tags, digests, alts, leaf_paths(start, size, digests, paths, first), strict=True):
            folded = fold((alt or d).hex(), path)
            proof = hashlib.sha256(path.encode().translate(None, b"LRS")).hexdigest()
            yield tag, key[1:] if key[0] == "1" else None, d.hex(), subroot, root, proof, folded, folded == root, path if with_path else None

    out = _map_runs(
        descend(runs, rounds, tops).select("key", "start", "size", "tags", "digests", "alts", "paths", "subroot", "root"), proofs,
        "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path string",
    )
    return out if with_path else out.drop("path")
