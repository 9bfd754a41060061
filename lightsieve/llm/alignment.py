"""Alignment of two tokenizers by diagonal run skipping.

The tokens of a text under both tokenizers cover the same bytes. Where tokens of both end at one byte, a group ends.
The end arrays are compared at the current index shift: as long as they agree the stretch is one-to-one and is jumped
by exponential probing, one, two, four and more ends at a time. Where they part, the group is resolved locally: the
side that lags moves on until both meet, and the shift is updated. All strips of a batch of texts take such a step at
once in numpy.

Neither tokenizer has a token that crosses certain spaces, so texts are cut there, and a worker encodes every different
unit between two such cuts once. ``assert_cuttable`` checks that of the models in use.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsieve.llm.textmodel import pieces as slices
from lightsieve.session import materialize

MARK = "▁"
#: white space of any reading, and the mark; a space after one of them is no cut
_SPACE = "\\t-\\r\x1c-\x1f \x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff" + MARK
CUT = re.compile(f"(?<=[^{_SPACE}])(?= )")
UNCUT = f"^ |{MARK}|[{_SPACE}] "
PIECE_BYTES = 2 << 20
STRIP_UNITS = 256
WIDEST = 256
_KNOWN_UNITS = 500_000
_KNOWN_CHARS = 16 << 20


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Side(NamedTuple):
    """What one tokenizer makes of the known units: ids one unit after the other."""

    ids: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    def extended(self, lists: list[list[int]]) -> Side:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for x in lists for i in x), np.int32, int(size.sum()))
        return Side(np.concatenate([self.ids, ids]), np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size]), np.concatenate([self.size, size]))

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each unit) of a sequence of units."""
        size = self.size[units]
        return self.ids[spans(self.begin[units], size)], size


_NOTHING = Side(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin[k] to begin[k] + size[k], one range after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


class Tokenizers:
    """A byte-level model (A) and a word-mark model (B) in a worker, with the units that they have encoded so far."""

    def __init__(self, a_json: str, b_proto: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_proto)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters, special = byte_letters(), self.a.get_added_tokens_decoder()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_tokens = [n.encode() if i in special else bytes(map(letters.__getitem__, n)) for i, n in enumerate(names)]
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_tokens = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.a_bytes, self.b_bytes = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_tokens, self.b_tokens))
        self.lone_mark = self.b.piece_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.known, self.chars, self.sides, self.valid = {}, 0, (_NOTHING, _NOTHING), np.empty(0, bool)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units that come without their first space."""
        a = [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1) if units else []
        return a, [ids if unit else [self.lone_mark] for ids, unit in zip(b, units)]

    def places(self, units: list[str]) -> np.ndarray:
        """Places of units among the known ones, to which new ones are added; they are forgotten when they grow too many."""
        if len(self.known) > _KNOWN_UNITS or self.chars > _KNOWN_CHARS:
            self.clear()
        new = [u for u in units if u not in self.known]
        a, b = self.encode(new)
        whole = [b"".join(map(self.a_tokens.__getitem__, x)) == b"".join(map(self.b_tokens.__getitem__, y)) == f" {u}".encode() for u, x, y in zip(new, a, b)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.chars += sum(map(len, new))
        self.sides = (self.sides[0].extended(a), self.sides[1].extended(b))
        self.valid = np.concatenate([self.valid, np.array(whole, bool)])
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))


@functools.lru_cache(2)
def tokenizers(a_json: str, b_proto: bytes) -> Tokenizers:
    """One a worker process, whatever task asks."""
    return Tokenizers(a_json, b_proto)


def assert_cuttable(models: Tokenizers) -> None:
    """Raises ValueError when cuts at spaces could change what the models give."""
    sample = "Is it  so? it's 12,5 % \n of a\tthing.\n\nNo 'ello -- Wörter"
    parts = [u[1:] for u in CUT.split(f" {sample}")]
    whole, cut = models.encode([sample]), models.encode(parts)
    crossing = [t for t in models.a_tokens + models.b_tokens if CUT.search(t.decode(errors="ignore"))]
    if crossing or any(w[0] != sum(c, []) for w, c in zip(whole, cut)):
        raise ValueError("a token of these models may cross a space; texts can't be cut there")


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text of each unit, units without their first space); each text gets one space in front, empty ones have no units.

    Texts in which every space is a cut are split by Arrow, others by the pattern.
    """
    irregular = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~irregular & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
    lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
    of, units = [np.repeat(plain, pc.list_value_length(lists).to_numpy(zero_copy_only=False))], [lists.flatten()]
    for i in np.flatnonzero(irregular):
        found = [u[1:] for u in CUT.split(f" {texts[int(i)].as_py()}")]
        of.append(np.repeat(i, len(found)))
        units.append(pa.array(found, pa.string()))
    of, units = np.concatenate(of), pa.concat_arrays(units)
    order = np.argsort(of, kind="stable") if irregular.any() else None
    return (of, units.dictionary_encode()) if order is None else (of[order], units.take(pa.array(order)).dictionary_encode())


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_strips: np.ndarray, b_strips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B end a group. ends: ascending byte ends; strips: where strips begin, and the end of all.

    Both sides of a strip must end at one byte. Each strip has a cursor (i, j) whose shift j - i is the diagonal that
    is probed; a probe that agrees doubles the next one's width, one that doesn't starts again at one.
    """
    a_last, b_last = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    i, j, a_stop, b_stop = a_strips[:-1].copy(), b_strips[:-1].copy(), a_strips[1:], b_strips[1:]
    width = np.ones(len(i), np.int64)
    live = np.flatnonzero(i < a_stop)
    while len(live):
        wide = np.minimum(width[live], np.minimum(a_stop[live] - i[live], b_stop[live] - j[live]))
        begin = np.cumsum(wide) - wide
        a, b = spans(i[live], wide), spans(j[live], wide)
        step = np.arange(len(a)) - np.repeat(begin, wide)
        run = np.minimum(wide, np.minimum.reduceat(np.where(a_ends[a] == b_ends[b], WIDEST, step), begin))
        agrees = step < np.repeat(run, wide)
        a_last[a[agrees]] = b_last[b[agrees]] = True
        i[live] += run
        j[live] += run
        width[live] = np.where(run == wide, np.minimum(2 * wide, WIDEST), 1)
        parted = live[run < wide]
        x, y = i[parted], j[parted]
        apart = np.arange(len(parted))
        while len(apart):
            ahead = a_ends[x[apart]] - b_ends[y[apart]]
            x[apart] += ahead < 0
            y[apart] += ahead > 0
            apart = apart[ahead != 0]
        a_last[x] = b_last[y] = True
        i[parted], j[parted] = x + 1, y + 1
        live = live[i[live] < a_stop[live]]
    return a_last, b_last


class Aligned(NamedTuple):
    """Tokens of a run of texts: ids, whether a token ends a group, and the tokens of each text."""

    a: np.ndarray
    b: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def align_texts(texts: pa.Array, models: Tokenizers, strip_units: int = STRIP_UNITS) -> Aligned:
    """Of texts that the models don't give back byte by byte, and of empty ones, there are no tokens."""
    of, units = cut(texts)
    known = models.places(units.dictionary.to_pylist())[units.indices.to_numpy()]
    bad = np.zeros(len(texts), bool)
    bad[of[~models.valid[known]]] = True
    if bad.any():
        stays = ~bad[of]
        of, known = of[stays], known[stays]
    (a, a_size), (b, b_size) = (side.of(known) for side in models.sides)
    strips = np.unique(np.concatenate([np.arange(0, len(of), strip_units), np.flatnonzero(np.diff(of, prepend=-1)), [len(of)]])).astype(np.int64)
    a_strips, b_strips = (np.concatenate([[0], np.cumsum(size)])[strips] for size in (a_size, b_size))
    a_last, b_last = group_ends(np.cumsum(models.a_bytes[a]), np.cumsum(models.b_bytes[b]), a_strips, b_strips)
    return Aligned(a, b, a_last, b_last, *(np.bincount(of, size, len(texts)).astype(np.int64) for size in (a_size, b_size)))


def _packed(ident: pa.Array, found: Aligned, kind: str) -> pa.RecordBatch:
    """Ids as byte planes, since the high bytes compress well, and a bit for each token that ends a group."""

    def per_text(values: np.ndarray, n: np.ndarray, packed) -> pa.Array:
        ends = np.cumsum(n).tolist()
        return pa.array([packed(values[s:e]) for s, e in zip([0, *ends], ends)], pa.binary())

    planes = lambda x: x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    bits = lambda x: np.packbits(x).tobytes()
    ids = per_text(found.a.astype(kind), found.n_a, planes), per_text(found.b.astype(kind), found.n_b, planes)
    last = per_text(found.a_last, found.n_a, bits), per_text(found.b_last, found.n_b, bits)
    return pa.RecordBatch.from_arrays([ident, pa.array(found.n_a), pa.array(found.n_b), *ids, *last], names=["doc_id", "n_a", "n_b", "a", "b", "a_last", "b_last"])


def _opened(batch: pa.RecordBatch, kind: str) -> Aligned:
    n_a, n_b, size = batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), np.dtype(kind).itemsize

    def ids(name: str) -> np.ndarray:
        planes = (np.frombuffer(x, np.uint8).reshape(size, -1) for x in batch[name].to_pylist())
        return np.concatenate([np.empty(0, kind), *(np.ascontiguousarray(x.T).view(kind).ravel() for x in planes)]).astype(np.int64)

    def flags(name: str, n: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(x, np.uint8), count=k).view(bool) for x, k in zip(batch[name].to_pylist(), n.tolist()))])

    return Aligned(ids("a"), ids("b"), flags("a_last", n_a), flags("b_last", n_b), n_a, n_b)


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch[column], PIECE_BYTES):
            yield batch.slice(part.start, part.stop - part.start)


class Pair:
    """Two tokenizers by their files: a byte-level model as JSON (A) and a model with word marks (B)."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            self.a_json = f.read()
        with open(b_path, "rb") as f:
            self.b_proto = f.read()
        models = tokenizers(self.a_json, self.b_proto)
        assert_cuttable(models)
        self.b_size = len(models.b_tokens)
        self.most = max(len(models.a_tokens), self.b_size)
        self.kind = "<u2" if self.most <= 1 << 16 else "<u4"


def align(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of every text under both tokenizers, and where groups end, packed; written once to the shared folder."""
    kind = pair.kind
    sent = docs.sparkSession.sparkContext.broadcast((pair.a_json, pair.b_proto))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = tokenizers(*sent.value)
        for batch in _parts(batches, "text"):
            yield _packed(batch["doc_id"], align_texts(batch["text"], models), kind)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, a binary, b binary, a_last binary, b_last binary"
    return materialize(rows.mapInArrow(run, schema), "aligned", "zstd")


def _links(found: Aligned, b_size: int) -> np.ndarray:
    """The pair of each link, a group's last tokens, as one number."""
    return found.a[found.a_last] * b_size + found.b[found.b_last]


def link_counts(aligned: DataFrame, pair: Pair) -> DataFrame:
    """(pair, n): how many links of the corpus hold two ids linked; pair is A's id times B's vocabulary plus B's id.

    Of two linked tokens one's bytes end with the other's. A token of k bytes has k endings, so all texts together
    hold no more different pairs than both vocabularies have bytes, whatever their number: about half a million.
    """
    kind, b_size = pair.kind, pair.b_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in _parts(batches, "a"):
            more, count = np.unique(_links(_opened(batch, kind), b_size), return_counts=True)
            pairs, place = np.unique(np.concatenate([pairs, more]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, count]), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    return aligned.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def group_texts(found: Aligned, names: np.ndarray) -> list[str]:
    """For each text its groups as ``a1,a2|b1;a3|b2,b3``; names: each id with a comma, with a bar and with a semicolon."""
    a_group, b_group = (np.cumsum(last) - last for last in (found.a_last, found.b_last))
    b_before = np.concatenate([[0], np.flatnonzero(found.b_last) + 1])[a_group]
    a_upto = (np.flatnonzero(found.a_last) + 1)[b_group]
    line = np.empty(len(found.a) + len(found.b), np.int64)
    line[np.arange(len(found.a)) + b_before] = np.where(found.a_last, found.a * 3 + 1, found.a * 3)
    line[np.arange(len(found.b)) + a_upto] = np.where(found.b_last, found.b * 3 + 2, found.b * 3)
    ends = np.cumsum(found.n_a + found.n_b).tolist()
    return ["".join(names[line[s:e]].tolist())[:-1] for s, e in zip([0, *ends], ends)]


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of n values each, in whole numbers."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(n)
    return upto[ends] - upto[ends - n]


def cross_align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row for each input row.

    A reads a space and the text, B the text, to which it adds that space itself. A link is a pair of tokens that end
    at one byte, so each group has one; its count is how many links of the corpus hold that pair of ids. n_best are
    the links whose count is the highest of their B id, ties included. groups holds the ids of each group in order.

    Texts that are null or empty, and those that either tokenizer doesn't give back byte by byte, have no tokens: all
    numbers are 0, groups is empty. Rows that repeat, and rows without id, are aligned one by one and count each. Texts
    may be of any length; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark, pair = docs.sparkSession, Pair(a_path, b_path)
    aligned = align(docs, pair, id_col, text_col)
    counted = link_counts(aligned, pair).orderBy("pair").toArrow()  # bounded by the vocabularies
    pairs, n = counted["pair"].to_numpy(), counted["n"].to_numpy()
    highest = np.zeros(pair.b_size, np.int64)
    np.maximum.at(highest, pairs % pair.b_size, n)
    sent = spark.sparkContext.broadcast((pairs, n, n == highest[pairs % pair.b_size]))
    kind, b_size, most = pair.kind, pair.b_size, pair.most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        names = np.array([f"{i}{mark}" for i in range(most) for mark in ",|;"], object)
        for batch in _parts(batches, "a"):
            found = _opened(batch, kind)
            place = np.searchsorted(pairs, _links(found, b_size))
            groups = _sums(found.a_last.astype(np.int64), found.n_a)
            numbers = [found.n_a, found.n_b, groups, groups, _sums(best[place].astype(np.int64), groups), _sums(n[place], groups)]
            texts = group_texts(found, names)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, numbers), pa.array(texts, pa.string())], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    ident = docs.select(id_col).schema[0]
    return aligned.mapInArrow(run, f"`{id_col}` {ident.dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
