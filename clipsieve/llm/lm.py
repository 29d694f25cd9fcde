"""Language-model scoring by subword lattice likelihood.

The vocabulary is that of an existing tokenizer; the probabilities of its pieces are learned from the training
documents. A text's score is the marginal probability over all segmentations of its words, by the forward
recursion in log space. Beside it stands a smoothed unigram score over whole words.

Documents are dealt into blocks. A block sends its distinct words with their training counts, packed, to the
words' buckets; a bucket adds up the counts, weighs each distinct word once and sends both back to the blocks.
What moves grows with the corpus, and no task or driver ever holds the whole vocabulary.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsieve.llm.common import release, remainder, small_batches, stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text of one block, and of the text whose words one bucket gets, at least and at most: with more than
#: MANY_BUCKETS buckets these grow first, so that a block's words for a bucket stay many and packed.
BLOCK_BYTES = 4_000_000
BUCKET_BYTES, MOST_BUCKET, MANY_BUCKETS = 4_000_000, 64_000_000, 2_048
#: Bytes of text of one counting task, where the session's number of shuffle partitions leaves more.
TASK_BYTES = 128_000_000
#: Stands for the end of a text; no word holds a line break.
END = b"\n"
WORD_PRIOR = 0.1
PIECE_PRIOR = 0.5
PACKED = "block long, bucket long, words binary, counts binary"


def count_blocks(batches: Iterable[pa.RecordBatch], buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, text, train) to rows (block, bucket, words, training counts of these).

    After more than most bytes of text all open blocks are sent: a block may come in several parts.
    """
    held: dict[int, Counter] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for block, counter in held.items():
            parts: dict[int, list[bytes]] = {}
            for w in counter:
                parts.setdefault(xxhash.xxh3_64_intdigest(w) % buckets, []).append(w)
            rows = []
            for bucket, words in parts.items():
                words.sort()
                rows.append((bucket, b" ".join(words), np.array([counter[w] for w in words], np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True))], ["block", "bucket", "words", "counts"])
        held.clear()

    for b in batches:
        for block, text, train in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = text.lower().split()
            words.append(END)
            counter = held.setdefault(block, Counter())
            if train:
                counter.update(words)
            else:
                for w in words:
                    counter[w] += 0
            size += len(text)
        if size > most:
            yield from flush()
            size = 0
    yield from flush()


def unpack(words: list[bytes], counts: list[bytes]) -> Counter:
    total: Counter = Counter()
    for ws, cs in zip(words, counts, strict=True):
        for w, c in zip(ws.split(b" "), np.frombuffer(cs, np.int32).tolist(), strict=True):
            total[w] += c
    return total


class Lattice:
    """Marginal log10 probability of a word over all its segmentations into pieces."""

    def __init__(self, model: bytes, log_p: dict[int, float]) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton, self.byte, self.end = ahocorasick.Automaton(), [0.0] * 256, log_p[-1]
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = log_p[i]
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.automaton.add_word(piece, (len(piece), log_p[i]))
        self.automaton.make_automaton()

    def word(self, word: bytes) -> float:
        """In log10; a character that no piece holds is spelled in bytes."""
        if word == END:
            return self.end / math.log(10)
        s = "▁" + word.decode("utf-8", "replace")
        ends: list[list[tuple[int, float]]] = [[] for _ in s]
        for at, hit in self.automaton.iter(s):
            ends[at].append(hit)
        alpha = [0.0]
        for at, arcs in enumerate(ends):
            terms = [alpha[at + 1 - n] + p for n, p in arcs]
            if not any(n == 1 for n, _ in arcs):
                terms.append(alpha[at] + sum(self.byte[b] for b in s[at].encode()))
            top = max(terms)
            alpha.append(top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms])))
        return alpha[-1] / math.log(10)


def piece_counts(packed: DataFrame, model: bytes) -> tuple[dict[int, int], int, int]:
    """Training counts of pieces over the usual segmentation of each word, N and V of whole words.

    One row per bucket and piece, added up in Spark: the driver gets a row per piece of the vocabulary.
    """

    state: dict = {}  # of one task: the tokenizer serves all its buckets

    def each(group: pa.Table) -> pa.Table:
        if "sp" not in state:
            state["sp"] = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = state["sp"]
        total = unpack(group["words"].to_pylist(), group["counts"].to_pylist())
        known = [(w, c) for w, c in total.items() if c]
        counts = Counter({-2: len(known), -3: sum(c for _, c in known), -1: total[END]})
        words = [(w.decode("utf-8", "replace"), c) for w, c in known if w != END]
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            for ids, (_, c) in zip(sp.encode([w for w, _ in part], num_threads=1), part, strict=True):
                for i in ids:
                    counts[i] += c
        return pa.table({"piece": pa.array(list(counts.keys()), pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = packed.groupBy("bucket").applyInArrow(each, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    n = {r["piece"]: r["n"] for r in rows}
    return n, n.get(-3, 0), n.get(-2, 0)


def piece_log_probabilities(counts: dict[int, int], model: bytes) -> dict[int, float]:
    """Natural logs of smoothed shares of all pieces and the end (-1)."""
    ids = [-1, *range(sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size())]
    total = sum(counts.get(i, 0) for i in ids) + PIECE_PRIOR * len(ids)
    return {i: math.log((counts.get(i, 0) + PIECE_PRIOR) / total) for i in ids}


def score(docs: DataFrame, train: Column, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, n_known, train_tokens, base_score, score.

    train says which rows to learn from. Null texts are empty; an empty text is the end alone. Repeated rows, null ids
    too, are counted and scored one by one; texts of any length are read whole, and other columns are ignored. An empty
    table gives no rows; without training rows all counts are 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:  # on the driver; tasks get the bytes
        model = f.read()
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, buckets = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // min(MOST_BUCKET, max(BUCKET_BYTES, size // MANY_BUCKETS))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    d = d.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks).cast("long")))
    most = 4 * BLOCK_BYTES
    packed = stored(d.select("block", "text", "train").repartition(tasks, "block").mapInArrow(lambda b: count_blocks(b, buckets, most), PACKED), "lm-counts")
    release(spark)
    counts, n, v = piece_counts(packed, model)
    release(spark)
    log_p = piece_log_probabilities(counts, model)
    shared = spark.sparkContext.broadcast((model, log_p))  # bounded by the vocabulary file

    state: dict = {}  # of one task: the lattice serves all its buckets

    def weigh(group: pa.Table) -> pa.Table:
        if "lattice" not in state:
            state["lattice"] = Lattice(*shared.value)
        lattice = state["lattice"]
        words = group["words"].to_pylist()
        total = unpack(words, group["counts"].to_pylist())
        of = {w: lattice.word(w) for w in total}
        split = [ws.split(b" ") for ws in words]
        sums = [np.array([total[w] for w in ws], np.int64).tobytes() for ws in split]
        logs = [np.array([of[w] for w in ws], np.float32).tobytes() for ws in split]
        return pa.table({"block": group["block"], "words": group["words"], "sums": pa.array(sums, pa.binary()), "logs": pa.array(logs, pa.binary())})

    def read(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        # A block counted in parts has several rows per bucket, and a word that lies in more than one has equal values there.
        at, sums, logs, n_read = {}, [], [], 0
        for ws, cs, ps in zip(*(known[c].to_pylist() for c in ("words", "sums", "logs")), strict=True):
            for n_read, w in enumerate(ws.split(b" "), n_read + 1):
                at[w] = n_read - 1
            sums.append(np.frombuffer(cs, np.int64))
            logs.append(np.frombuffer(ps, np.float32))
        c = np.concatenate(sums) if sums else np.zeros(0, np.int64)
        lattice = np.concatenate(logs).astype(float) if logs else np.zeros(0)
        base = np.log10((c + WORD_PRIOR) / (n + WORD_PRIOR * (v + 1)))
        out = []
        for text in own["text"].to_pylist():
            words = text.lower().split()
            words.append(END)
            i = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            out.append((len(words), int((c[i] > 0).sum()), n, float(base[i].sum()), float(lattice[i].sum())))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table({"id": own["id"], **{k: pa.array(x, t) for k, x, t in zip(("n_tokens", "n_known", "train_tokens", "base_score", "score"), cols, [pa.int64()] * 3 + [pa.float64()] * 2, strict=True)}})

    back = packed.groupBy("bucket").applyInArrow(weigh, "block long, words binary, sums binary, logs binary")
    schema = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = d.select("block", "id", "text").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(read, schema)
    return out.withColumnRenamed("id", id_col)


def held_out_score(docs: DataFrame, mod: int = 10, held: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    out = score(docs, remainder("doc_id", mod) != held, vocabulary)
    return out.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
