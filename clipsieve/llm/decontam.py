"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders. Windows of the resulting template are hash-joined
with the benchmark's, so a question with other numbers or names still meets its original. A run of matching
windows counts if its slots are consistent: equal values of the item that are changed are all changed to the same.
Copies in other case meet in a caseless template, where names stay plain words. What templates leave out for want of
plain words is looked for word by word, and items of one window also with first words taken for names. A number and the
unit that it is written together with are two slots; numbers may be spelled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from copy import copy

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsieve.llm.common import free_name, grams, long_array, map_arrow, mix, stored

WINDOW = 10
#: Distinct words that a worker remembers before it starts again: some 200 bytes each, and a word costs far more to look
#: at anew than to hash.
WORDS_KEPT = 200_000
#: Items of fewer template tokens are looked for word by word; those of fewer than WINDOW match as a whole, and a single
#: word where it is a sentence or a line by itself.
MIN_ITEM_TOKENS = 6
#: Share of a window's tokens, in percent, that must be plain words: placeholders alone say nothing.
MIN_PLAIN = 60
#: Benchmark windows that are sent to every task; with more, documents' windows are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Units of measurement, of time and of money.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year meters metres meter metre kilometers kilometres miles mile feet inches grams kilograms pounds liters litres dollars dollar euros euro cents percent kmh mph".split()

#: Spelled numbers.
SPELLED_NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
TENS = {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}

PLAIN, NUMBER, UNIT, CAPITAL, NOTHING, SPELLED = range(6)
NAME = CAPITAL
#: Forms of a template: names by their capitals; no names, case ignored; capitals at the start of a sentence are names
#: too; nothing is replaced.
CASED, CASELESS, CAPITALS, EXACT = range(4)
FORMS = (CASED, CASELESS, CAPITALS, EXACT)
_EDGE = b"\"'`.,;:?!()[]{}<>#*$%&|-_/\\=+~^"
_DIGIT = re.compile(rb"[0-9]")
_units = frozenset(u.encode() for u in UNITS)
_spelled = {w.encode(): b"%d" % TENS.get(w, k) for k, w in enumerate(SPELLED_NUMBERS)}
_FUSED = re.compile(rb"(.*[0-9])(" + b"|".join(sorted(_units, key=lambda u: (-len(u), u))) + rb")([^A-Za-z0-9]*)", re.I | re.S)
_HIGH = np.uint64(44)
_SALT = np.array([0, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
#: A spelled number's placeholder is that of any other.
_KEYS = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0, 0xA24BAED4963EE407], np.uint64)


def folded(word: bytes) -> bytes:
    """Without marks at its edges, in Unicode's case folding."""
    plain = word.strip(_EDGE)
    return plain.lower() if plain.isascii() else plain.decode("utf-8", "replace").casefold().encode()


class Words(dict):
    """Each word's row in arrays: hash of its plain form, its kind, whether a sentence ends with it, and whether it is a
    number with its unit."""

    def __init__(self) -> None:
        self.hash, self.kind, self.ends, self.fused = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int8), np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        if i >= len(self.hash):
            self.hash, self.kind, self.ends, self.fused = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hash, self.kind, self.ends, self.fused))
        plain = word.strip(_EDGE)
        if plain.isascii():
            low, text = plain.lower(), plain
        else:
            text = plain.decode("utf-8", "replace")
            low = text.casefold().encode()
        if len(plain) < len(word):  # all marks that end a sentence are edges
            self.ends[i] = word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b":")
        if not plain:
            self.kind[i] = NOTHING
        elif _DIGIT.search(plain):
            self.kind[i] = NUMBER
            self.fused[i] = _FUSED.fullmatch(word) is not None
        elif low in _spelled or b"-" in low and all(part in _spelled for part in low.split(b"-")):
            self.kind[i] = SPELLED
        elif low in _units:
            self.kind[i] = UNIT
        elif text[:1].isupper() and not text.isupper():
            self.kind[i] = CAPITAL
        self.hash[i] = xxhash.xxh3_64_intdigest(low)
        return i

    def bound(self) -> None:
        if len(self) > WORDS_KEPT:
            self.clear()
            self.__init__()


_words = Words()


class Template:
    """A text's template in a form: tokens (hashes), their kinds, and the first and last word of each."""

    def __init__(self, text: bytes) -> None:
        _words.bound()
        self.form, self.words, starts = CASED, [], []
        for line in text.split(b"\n"):
            starts.append(len(self.words))
            self.words += line.split()
        at = np.fromiter(map(_words.__getitem__, self.words), np.int64, len(self.words))
        fused = np.flatnonzero(_words.fused[at]) if len(at) else at
        if len(fused):
            # Two words each, so that what begins a line moves on by those before it.
            starts = [k + int(np.searchsorted(fused, k)) for k in starts]
            for k in fused[::-1].tolist():
                number, unit, rest = _FUSED.fullmatch(self.words[k]).groups()
                self.words[k : k + 1] = [number, unit + rest]
            at = np.fromiter(map(_words.__getitem__, self.words), np.int64, len(self.words))
        n = len(self.words)
        self.word_kind, self.word_hash, first = _words.kind[at], _words.hash[at], np.zeros(n + 1, bool)
        first[1:] = np.append(_words.ends[at], False)[:n] if n else []
        first[np.array(starts)] = True
        self.first = first[:n]
        self._fill()

    def to(self, form: int) -> Template:
        """The same text in another form."""
        out = copy(self)
        out.form = form
        out._fill()
        return out

    def _fill(self) -> None:
        kind, n = self.word_kind, len(self.words)
        # A capital at the start of a sentence is no name.
        if self.form == EXACT:
            kind = np.where(kind == NOTHING, NOTHING, PLAIN)  # word by word
        elif self.form != CAPITALS:
            kind = np.where((kind == CAPITAL) & (self.first if self.form == CASED else True), PLAIN, kind)
        token = np.where(kind == PLAIN, self.word_hash, _KEYS[kind])
        keep = kind != NOTHING
        # Names side by side are one, and so are the words of a number.
        for of in (NAME, SPELLED):
            same = kind == of
            if same.any():
                keep[1:] &= ~(same[1:] & same[:-1])
        place = np.flatnonzero(keep)
        self.tokens, self.kinds, self.place = mix(token[place]), kind[place], place
        self.end = np.append(place[1:], n)

    def slot(self, i: int) -> bytes:
        """The value in a placeholder, compared without case or marks at its edges; twelve is 12."""
        many = self.kinds[i] in (NAME, SPELLED)
        value = [folded(w) for w in self.words[self.place[i] : self.end[i] if many else self.place[i] + 1]]
        return b" ".join(_spelled.get(w, w) for w in value) if self.kinds[i] == SPELLED else b" ".join(value)

    def alone(self, i: int) -> bool:
        """Whether a token is a sentence or a line by itself."""
        begin, end = int(self.place[i]), int(self.end[i])
        return bool(self.first[begin] and (end >= len(self.words) or self.first[end]))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the windows that have enough plain words."""
        h = grams(self.tokens, size) ^ _SALT[self.form]
        if not len(h):
            return h, np.empty(0, np.int64)
        plain = np.concatenate([[0], np.cumsum(self.kinds == PLAIN)])
        ok = np.flatnonzero((plain[size:] - plain[:-size]) * 100 >= MIN_PLAIN * size)
        return h[ok], ok


def item_windows(text: bytes) -> list[tuple[Template, int, np.ndarray, np.ndarray]]:
    """(template, window size, hashes, places) for each form in which an item is looked for."""
    cased, out, lost = Template(text), [], False
    for form in FORMS:
        t = cased if form == CASED else cased.to(form)
        n = len(t.tokens)
        size = min(WINDOW, n)
        if form == CAPITALS and len(cased.tokens) > WINDOW or form == EXACT and not lost:
            continue
        if size < (1 if form == EXACT else MIN_ITEM_TOKENS):
            lost = True
            continue
        hashes, places = t.windows(size)
        lost |= len(hashes) < n - size + 1
        if len(hashes):
            out.append((t, size, hashes, places))
    return out


class Benchmark:
    """Templates of the items and the places of their windows, by form and window size."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        at: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.items: dict[tuple[int, int], Template] = {}
        self.total: dict[tuple[int, int], int] = {}
        for k, (_, text) in enumerate(items):
            for t, size, hashes, places in item_windows((text or "").encode()):
                self.items[t.form, k], self.total[t.form, k] = t, len(hashes)
                for h, p in zip(hashes.tolist(), places.tolist(), strict=True):
                    at[t.form, size][h].append((k, p))
        self.at = {s: dict(at[s]) for s in sorted(at)}
        self.known = {s: np.sort(np.fromiter(d, np.uint64, len(d))) for s, d in self.at.items()}
        # Which high bits any known window has: most windows of a document are told apart by these alone.
        self.high = {s: np.bincount((k >> _HIGH).astype(np.int64), minlength=1 << (64 - int(_HIGH))) > 0 for s, k in self.known.items()}

    def matches(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, windows that match, windows of the item, changed slots) of each item found in a text."""
        cased = doc = Template(text)
        best: dict[int, tuple[int, int, int, int]] = {}
        refused: dict[int, list[tuple[int, int]]] = defaultdict(list)  # words of inconsistent runs count in no other form
        for form in FORMS:
            runs: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
            for size in [s for f, s in self.known if f == form]:
                known = self.known[form, size]
                doc = doc if doc.form == form else cased.to(form)
                h, places = doc.windows(size)
                maybe = np.flatnonzero(self.high[form, size][h >> _HIGH])
                near = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
                for j in maybe[known[near] == h[maybe]].tolist():
                    for k, p in self.at[form, size][int(h[j])]:
                        q = int(places[j])
                        if np.array_equal(doc.tokens[q : q + size], self.items[form, k].tokens[p : p + size]) and (size > 1 or doc.alone(q)):
                            begin, end = int(doc.place[q]), int(doc.end[q + size - 1])
                            if not any(a < end and begin < b for a, b in refused.get(k, ())):
                                runs[k, q - p].append((q, p, size))
            late = []
            for (k, _), run in runs.items():
                changed = self._changed(doc, self.items[form, k], run)
                if changed is None:
                    late.append((k, (int(doc.place[run[0][0]]), int(doc.end[run[-1][0] + run[-1][2] - 1]))))
                else:
                    hit = (self.ids[k], len({p for _, p, _ in run}), self.total[form, k], changed)
                    best[k] = max(best.get(k, hit), hit, key=lambda x: (x[1], -x[3]))
            for k, span in late:
                refused[k].append(span)
        return [best[k] for k in sorted(best)]

    @staticmethod
    def _changed(doc: Template, item: Template, run: list[tuple[int, int, int]]) -> int | None:
        """Slots with another value than the item's; None if equal values of the item are changed to different ones.

        A value left as it is contradicts nothing: a copy may have one of its numbers edited.
        """
        pairs = {(p + o, q + o) for q, p, size in run for o in range(size) if item.kinds[p + o] != PLAIN}
        value: dict[tuple[int, bytes], bytes] = {}
        changed = 0
        for i, j in sorted(pairs):
            a, b = item.slot(i), doc.slot(j)
            if a != b:
                # A number is one whether spelled or not.
                if value.setdefault((NUMBER if item.kinds[i] == SPELLED else int(item.kinds[i]), a), b) != b:
                    return None
                changed += 1
        return changed


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def _fits(benchmark: DataFrame) -> bool:
    """Whether the benchmark's windows, of which it has no more than words, are few enough to send to every task."""
    words = benchmark.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\\s+")))).first()[0] or 0
    return words <= BROADCAST_WINDOWS


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, n_windows, item_windows, changed_slots): a row for each item found in a document.

    Clean documents have no row. Null or empty texts and items match nothing, an item of two words or more wherever they
    stand in this order, one of a single word as a sentence or a line of its own; equal items all match. Repeated rows
    of a document, null ids too, give repeated rows. Texts of any length are read whole; other columns are ignored.
    Either table empty gives none.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    if not _fits(benchmark):
        return _shuffled(d, _items(benchmark)).withColumnRenamed("id", id_col)
    rows = [(r[0], r[1]) for r in _items(benchmark).orderBy("item_id", "text").collect()]
    shared, state = docs.sparkSession.sparkContext.broadcast(rows), {}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if "b" not in state:
            state["b"] = Benchmark(shared.value)
        out = [(i, *m) for i, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True) for m in state["b"].matches(t)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "item_id", "n_windows", "item_windows", "changed_slots"]) if out else None

    return map_arrow(d, each, "id long, item_id long, n_windows long, item_windows long, changed_slots long").withColumnRenamed("id", id_col)


def _shuffled(d: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: windows of both sides meet in a shuffled hash join, then each candidate
    pair is judged with both texts at hand."""

    def windows(wanted: list[tuple[int, int]] | None):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, hashes, kinds = [], [], []
            for i, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if wanted is None:
                    found = [(w[2], w[0].form * 16 + w[1]) for w in item_windows(t)]
                else:
                    cased = Template(t)
                    of = {f: cased if f == CASED else cased.to(f) for f, _ in wanted}
                    found = [(of[f].windows(size)[0], f * 16 + size) for f, size in wanted]
                for h, kind in found:
                    h = np.unique(h)
                    hashes.append(h)
                    ids.append(np.array([i] * len(h), np.int64))
                    kinds.append(np.array([kind] * len(h), np.int64))
            e = [np.empty(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids or e)), pa.array(long_array(np.concatenate(hashes or [np.empty(0, np.uint64)]))), pa.array(np.concatenate(kinds or e))], ["id", "window", "kind"])

        return each

    keyed = d.withColumn("key", F.xxhash64("id", "text"))
    numbered = stored(items.withColumn("key", F.xxhash64("item_id", "text")), "decontam-items")
    schema = "id long, window long, kind long"
    ours = stored(map_arrow(numbered.select("key", F.col("text").cast("binary")), windows(None), schema).distinct().withColumnRenamed("id", "item_key"), "decontam-windows")
    wanted = sorted(divmod(r[0], 16) for r in ours.select("kind").distinct().collect())  # at most a row per form and size
    theirs = map_arrow(keyed.select("key", "text"), windows(wanted), schema)
    pairs = theirs.join(ours, ["kind", "window"]).select("id", "item_key").distinct()
    texts = pairs.join(keyed.withColumnRenamed("id", "doc").withColumnRenamed("text", "doc_text"), F.col("id") == F.col("key")).select("doc", "doc_text", "item_key")
    texts = texts.join(numbered, F.col("item_key") == F.col("key")).select("doc", "doc_text", "item_id", F.col("text").alias("item_text"))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = [(i, *m) for i, t, item, it in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in Benchmark([(item, it)]).matches(t)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "item_id", "n_windows", "item_windows", "changed_slots"]) if out else None

    return map_arrow(texts, judge, "id long, item_id long, n_windows long, item_windows long, changed_slots long")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows in which an item is found; all columns stay, and rows with null or empty text too."""
    if not _fits(benchmark):
        # A row is found by its text: by two hashes of it, of 128 bits together.
        name, text = free_name(docs), F.coalesce(F.col(text_col), F.lit(""))
        hashes = [F.xxhash64(text), F.xxhash64(text, F.lit("second"))]
        each = docs.select(text.alias("text")).distinct().withColumn("key", F.xxhash64("text"))
        found = matches(each, benchmark, "key", "text").select("key").distinct()
        bad = each.join(found, "key", "left_semi").select(F.col("key").alias(f"{name}_a"), F.xxhash64("text", F.lit("second")).alias(f"{name}_b"))
        return docs.join(bad, (hashes[0] == F.col(f"{name}_a")) & (hashes[1] == F.col(f"{name}_b")), "left_anti")
    rows = [(r[0], r[1]) for r in _items(benchmark).orderBy("item_id", "text").collect()]
    shared, state = docs.sparkSession.sparkContext.broadcast(rows), {}
    at = docs.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "b" not in state:
            state["b"] = Benchmark(shared.value)
        return batch.filter(pa.array([not state["b"].matches((t or "").encode()) for t in batch[at].to_pylist()]))

    return map_arrow(docs, each, docs.schema)
