"""Language-model scores by masked pseudo-likelihood.

A window network predicts each word from two words on either side: position-wise embeddings are summed and squashed,
and a two-level softmax (group, then member) gives the probability. A document's score is the sum of the conditional
log-probabilities of all its words, each masked in turn.

The network tells apart the most frequent words, more of them the larger the corpus is, and classes of all others. A
word of a class has the class's probability times its own share of the class's occurrences: the shares of the next most
frequent words are broadcast, all others are joined by shuffle from the full table of counts.

All that is learned comes from all documents: word counts and the network, which every task trains on every position
of its texts, each once over the rounds. The texts are turned into word codes once; rounds and scores read those. The
tasks' networks are averaged by Spark in two levels, row by row of the parameters, weighted by how often a row was
updated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightsieve.llm.textmodel import pieces
from lightsieve.session import materialize

VOCABULARY = 1024  # at least; see vocabulary_size
RARE_CLASSES = 256
MOST_LETTERS = 64  # of a word with an outcome of its own or a broadcast share
HEAD_WORDS = 100_000
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
BATCH = 8192
PIECE_BYTES = 32 << 20
PIECE_WORDS = 1 << 21
BLOCK_ROWS = 64
TASKS_A_PART = 64


class Shape(NamedTuple):
    """Numbers of outcomes and of members a group; the last input row stands for places beyond the ends of a text."""

    outcomes: int
    members: int

    @property
    def groups(self) -> int:
        return self.outcomes // self.members

    @property
    def pad(self) -> int:
        return self.outcomes

    @property
    def in_rows(self) -> int:
        return len(OFFSETS) * (self.outcomes + 1)

    @property
    def rows(self) -> int:
        return self.in_rows + self.groups + self.outcomes


class Network:
    """Views of one parameter matrix; the last column of the output rows is their bias."""

    def __init__(self, table: np.ndarray, shape: Shape):
        self.table, self.shape = table, shape
        self.inputs = table[: shape.in_rows, :WIDTH].reshape(len(OFFSETS), shape.outcomes + 1, WIDTH)
        self.groups = table[shape.in_rows : shape.in_rows + shape.groups]
        self.members = table[shape.in_rows + shape.groups :].reshape(shape.groups, shape.members, WIDTH + 1)


def shape_for(n_words: int, vocabulary: int = VOCABULARY, classes: int = RARE_CLASSES) -> Shape:
    """A quarter of the root of the corpus's words have an outcome of their own, ``vocabulary`` at least; the members of
    a group are about as many as the groups, so a prediction costs the root of the outcomes."""
    own = max(vocabulary, int(n_words**0.5) // 4)
    members = max(32, round((own + classes) ** 0.5 / 16) * 16)
    return Shape(-(-(own + classes) // members) * members, members)


def new_network(shape: Shape, seed: int = 11) -> np.ndarray:
    table = np.zeros((shape.rows, WIDTH + 1), np.float32)
    table[:, :WIDTH] = np.random.default_rng(seed).normal(0, 0.1, (len(table), WIDTH))
    return table


def hidden(net: Network, context: np.ndarray) -> np.ndarray:
    """context: a row an offset, a column a place."""
    h = np.ones((context.shape[1], WIDTH + 1), np.float32)
    total = net.inputs[0][context[0]]
    for o in range(1, len(OFFSETS)):
        total += net.inputs[o][context[o]]
    np.tanh(total, out=h[:, :WIDTH])
    return h


def _by_group(shape: Shape, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(order of the places by group, their groups, their members, (group, begin, end) of those that occur)."""
    group = (target // shape.members).astype(np.int16)
    order = np.argsort(group, kind="stable")
    group = group[order]
    bound = np.searchsorted(group, np.arange(shape.groups + 1))
    return order, group, (target % shape.members)[order], [(k, bound[k], bound[k + 1]) for k in range(shape.groups) if bound[k] < bound[k + 1]]


def log_probability(net: Network, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    order, group, member, spans = _by_group(net.shape, target)
    h, at = hidden(net, context[:, order]), np.arange(len(order))
    out = np.zeros(len(order))
    z = h @ net.groups.T
    found = [(z, group)]
    z = np.empty((len(h), net.shape.members), np.float32)
    for k, b, e in spans:
        np.matmul(h[b:e], net.members[k].T, out=z[b:e])
    for z, own in (*found, (z, member)):
        z -= z.max(axis=1, keepdims=True)
        out += z[at, own]
        np.exp(z, out=z)
        out -= np.log(z.sum(axis=1, dtype=np.float64))
    back = np.empty(len(order))
    back[order] = out
    return back


def _miss(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Softmax of the rows less the wanted outcome, in place."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(z)), own] -= 1
    return z


def train_step(net: Network, squares: np.ndarray, touched: np.ndarray, context: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One AdaGrad step on a batch of masked words, in place."""
    order, group, member, spans = _by_group(net.shape, target)
    context = context[:, order]
    h = hidden(net, context)
    n = len(h)
    g = Network(np.zeros_like(net.table), net.shape)
    p = _miss(h @ net.groups.T, group)
    g.groups[:] = p.T @ h
    back = p @ net.groups
    z = np.empty((n, net.shape.members), np.float32)
    for k, b, e in spans:
        np.matmul(h[b:e], net.members[k].T, out=z[b:e])
    _miss(z, member)
    for k, b, e in spans:
        np.matmul(z[b:e].T, h[b:e], out=g.members[k])
        back[b:e] += z[b:e] @ net.members[k]
    back = back[:, :WIDTH] * (1 - h[:, :WIDTH] ** 2)
    width, groups = net.shape.outcomes + 1, net.shape.groups
    for o in range(len(OFFSETS)):
        by_place = np.argsort(context[o], kind="stable")
        place = context[o][by_place]
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        g.inputs[o][place[begin]] = np.add.reduceat(back[by_place], begin, axis=0)
        touched[o * width + place[begin]] += np.diff(begin, append=n)
    touched[net.shape.in_rows : net.shape.in_rows + groups] += n
    touched[net.shape.in_rows + groups :] += np.repeat(np.bincount(group, minlength=groups), net.shape.members)
    gradient = g.table
    gradient /= n**0.5
    squares += gradient * gradient
    net.table -= rate * gradient / (np.sqrt(squares) + 1e-6)


def windows(codes: np.ndarray, sizes: np.ndarray, pad: int) -> np.ndarray:
    """The codes on either side of each place of texts that stand one after the other, ``pad`` beyond their ends."""
    padded = np.full(len(codes) + 2 * (len(sizes) + 1), pad, codes.dtype)
    at = np.arange(len(codes)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[at] = codes
    return np.stack([padded[at + o] for o in OFFSETS])


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(words of each text, all words one after the other). Words are what space and 0x09 to 0x0D separate."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if empty.any():  # beside spaces at the ends of a text
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        words = words.filter(pa.array(~empty))
    return sizes, words.dictionary_encode()


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): counted in each task piece by piece, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch["text"], PIECE_BYTES):
                _, words = split_words(batch["text"][piece])
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_of(word: Column) -> Column:
    return F.pmod(F.crc32(F.substring(word, 1, 2).cast("binary")), F.lit(RARE_CLASSES))


def rare_shares(counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(word, n, class, share) of the words that are not frequent; share is the log of their part of their class's occurrences."""
    rare = counts.join(F.broadcast(frequent.select("word")), "word", "left_anti").withColumn("class", class_of(F.col("word")))
    totals = rare.groupBy("class").agg(F.sum("n").alias("total"))  # RARE_CLASSES rows
    return rare.join(F.broadcast(totals), "class").select("word", "n", "class", F.log(F.col("n") / F.col("total")).alias("share"))


class Coder:
    """Words to outcomes and log shares: frequent words have an outcome of their own, others that of their class."""

    def __init__(self, own: dict[str, int], head: dict[str, float], first_class: int):
        self.own, self.head, self.first_class = own, head, first_class

    def outcomes(self, words: list[str]) -> np.ndarray:
        own, first = self.own, self.first_class
        return np.array([own[w] if w in own else first + zlib.crc32(w[:2].encode()) % RARE_CLASSES for w in words], np.int32)

    def shares(self, words: list[str]) -> np.ndarray:
        """0 for frequent words, nan for those that are neither frequent nor in the head."""
        own, head = self.own, self.head
        return np.array([0.0 if w in own else head.get(w, np.nan) for w in words], np.float64)


def encode(docs: DataFrame, id_col: str, text_col: str, coder, kind: type) -> DataFrame:
    """(row, id, n_words, codes, head, tail): outcomes of the words as numbers of ``kind``, the sum of the head's shares, and all other rare words."""
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Coder = coder.value
        for batch in batches:
            for piece in pieces(batch["text"], PIECE_BYTES):
                sizes, words = split_words(batch["text"][piece])
                distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy()
                codes = known.outcomes(distinct).astype(kind)[at]
                share = known.shares(distinct)[at]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                far = np.isnan(share)
                share[far] = 0
                ends = np.concatenate([[0], np.cumsum(sizes * codes.itemsize)]).astype(np.int32)
                tails = np.concatenate([[0], np.cumsum(np.bincount(doc[far], minlength=len(sizes)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"][piece],
                        pa.array(sizes, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes())]),
                        pa.array(np.bincount(doc, share, len(sizes)), pa.float64()),
                        pa.ListArray.from_arrays(pa.array(tails), words.dictionary.take(pa.array(at[far])).cast(pa.string())),
                    ],
                    names=["id", "n_words", "codes", "head", "tail"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = rows.mapInArrow(run, f"id {id_kind}, n_words long, codes binary, head double, tail array<string>")
    return materialize(coded.withColumn("row", F.monotonically_increasing_id()), "coded", "zstd")


def _coded_pieces(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, codes one after the other, words of each row)."""
    for piece in pieces(batch["codes"], PIECE_WORDS * np.dtype(kind).itemsize):
        column = batch["codes"][piece]
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
        yield piece, np.frombuffer(b"".join(column.to_pylist()), kind), sizes.astype(np.int64)


def train(coded: DataFrame, shape: Shape, rounds: int, kind: type, rate: float = 0.1) -> np.ndarray:
    """The averaged network after ``rounds`` passes over all documents; over the rounds each word is masked once."""
    spark = coded.sparkSession
    table = new_network(shape)
    for round_no in range(rounds):
        sent = spark.sparkContext.broadcast(table)

        def local(batches: Iterator[pa.RecordBatch], sent=sent, round_no=round_no) -> Iterator[pa.RecordBatch]:
            net = Network(sent.value.copy(), shape)
            squares, touched = np.full_like(net.table, 0.1), np.zeros(shape.rows)
            for batch in batches:
                for _, codes, sizes in _coded_pieces(batch, kind):
                    masked = np.flatnonzero((np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % rounds == round_no)
                    if not len(masked):
                        continue
                    context = windows(codes, sizes, shape.pad)
                    masked = masked[np.random.default_rng(len(masked)).permutation(len(masked))]
                    for i in range(0, len(masked), BATCH):
                        at = masked[i : i + BATCH]
                        train_step(net, squares, touched, context[:, at], codes[at], rate)
            if touched.any():
                yield _blocks(net.table.astype(np.float64) * (touched[:, None] + 1e-9), touched + 1e-9, TaskContext.get().partitionId() // TASKS_A_PART)

        def add(key: tuple, parts: pa.Table) -> pa.Table:
            total, weight = (sum(np.frombuffer(x.as_py(), np.float64) for x in parts[name]) for name in ("total", "weight"))
            return pa.table({"block": [key[0].as_py()], "total": [total.tobytes()], "weight": [weight.tobytes()]}, schema=pa.schema([("block", pa.int32()), ("total", pa.binary()), ("weight", pa.binary())]))

        of_tasks = coded.select("codes").mapInArrow(local, "block int, part int, total binary, weight binary")
        added = of_tasks.groupBy("block", "part").applyInArrow(add, "block int, total binary, weight binary").groupBy("block").applyInArrow(add, "block int, total binary, weight binary")
        for part in added.collect():  # one network, whatever the number of documents
            weight = np.frombuffer(part["weight"], np.float64)
            table[part["block"] : part["block"] + len(weight)] = np.frombuffer(part["total"], np.float64).reshape(len(weight), -1) / weight[:, None]
    return table


def _blocks(total: np.ndarray, weight: np.ndarray, part: int) -> pa.RecordBatch:
    starts = range(0, len(total), BLOCK_ROWS)
    return pa.RecordBatch.from_arrays(
        [pa.array(starts, pa.int32()), pa.array([part] * len(starts), pa.int32()), *(pa.array([x[s : s + BLOCK_ROWS].tobytes() for s in starts]) for x in (total, weight))],
        names=["block", "part", "total", "weight"],
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, head_words: int = HEAD_WORDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(id_col, n_words, log_prob, mean_log_prob), one row for each input row.

    log_prob sums natural logs over all words of the whole text. Null and wordless texts have no words, sum 0 and a
    null mean; an empty table gives no rows. A rare word has the probability of its class times its share of the
    occurrences of the class's words. Rows that repeat, or have no id, are scored one by one, and count in training as
    often as they occur. Texts of any length are read whole, in pieces of some million words. Other columns are
    ignored, whatever their names.

    ``vocabulary`` is the least number of words with an outcome of their own; it grows with the corpus. The shares of
    ``head_words`` rare words are broadcast; those of all others are joined by shuffle. Words of more than
    MOST_LETTERS letters are never broadcast, so both tables are bounded in bytes, too.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(docs, text_col), "word-counts")
    shape = shape_for(counts.agg(F.sum("n")).first()[0] or 0, vocabulary)
    own = shape.outcomes - RARE_CLASSES
    kind = np.int16 if shape.outcomes < 1 << 15 else np.int32
    short = F.length("word") <= MOST_LETTERS
    frequent = counts.filter(short).orderBy(F.desc("n"), "word").limit(own)
    words = {r["word"]: i for i, r in enumerate(frequent.collect())}
    shares = materialize(rare_shares(counts, frequent), "rare-words")
    head = {r["word"]: r["share"] for r in shares.filter(short).orderBy(F.desc("n"), "word").limit(head_words).toLocalIterator()}
    coded = encode(docs, id_col, text_col, spark.sparkContext.broadcast(Coder(words, head, own)), kind)
    sent = spark.sparkContext.broadcast(train(coded, shape, rounds, kind))
    id_kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(sent.value, shape)
        for batch in batches:
            sums = batch["head"].to_numpy().copy()
            for piece, codes, sizes in _coded_pieces(batch, kind):
                context, doc = windows(codes, sizes, shape.pad), np.repeat(np.arange(piece.start, piece.stop), sizes)
                for i in range(0, len(codes), 2 * BATCH):
                    at = slice(i, i + 2 * BATCH)
                    sums += np.bincount(doc[at], log_probability(net, context[:, at], codes[at]), len(sums))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], batch["n_words"], pa.array(sums)], names=["row", "id", "n_words", "log_prob"])

    scored = coded.select("row", "id", "n_words", "codes", "head").mapInArrow(score, f"row long, id {id_kind}, n_words long, log_prob double")
    of_tail = coded.select("row", F.explode("tail").alias("word")).join(shares.select("word", "share"), "word").groupBy("row").agg(F.sum("share").alias("share"))
    total = scored.join(of_tail, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("share", F.lit(0.0)))
    return total.select(F.col("id").alias(id_col), "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))
