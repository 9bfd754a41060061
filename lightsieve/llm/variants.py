"""Spelling variants by blocked Gram matrices.

Words become vectors of letter counts. Two words that differ by one letter have vectors at a squared distance of two
at most, and lengths that differ by one at most, so only blocks of equal or adjacent lengths are multiplied: numpy
gives the squared distances of two blocks at once, and the pairs at most two apart are checked letter by letter.

A length is cut further into cells by how many letters fall into each of GROUPS groups. One edit moves at most one
letter between two groups, so a word's partners lie in its own cell and in those that differ by such a move; it is
dealt as a visitor to the ones before its own. Cells of many words are cut into tiles, so what a task holds stays
bounded while the number of copies of a word does not depend on how many words there are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsieve.llm.textmodel import pieces as slices
from lightsieve.operators.skew import splittable_join
from lightsieve.session import discard, materialize

GROUPS = 5
TILE_ROWS = 8192
LETTERS = 26 + 64
PIECE_BYTES = 16 << 20
_MOST_COUNTED = 300_000
_CHUNK_PAIRS = 4 << 20
_COUNT_BITS = 12
_VALUES = 1 << _COUNT_BITS
_EXACT_LENGTH = 2048  # of words whose squares and products single precision holds exactly


def spelling(run: str, prefix_crc: int, drop_every: int) -> str:
    """The run with A-Z in lower case; if drop_every divides the checksum of prefix and run, without one code point."""
    raw = run.encode().lower()  # lower-cases ASCII alone
    word = raw.decode()
    h = zlib.crc32(raw, prefix_crc)
    if h % drop_every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, drop_every: int = 31) -> DataFrame:
    """(word, n): runs of ASCII and Latin-1 letters, at least least_length code points long as they are spelled.

    One spelling in about drop_every loses a letter, chosen by the checksum of document and run, so a document spells
    a run alike throughout. Null texts have no words; a null id counts as the empty string. Words are counted in each
    task first.
    """
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")  # shorter runs stay too short
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch["text"], PIECE_BYTES):
                for ident, text in zip(batch["id"][part].to_pylist(), batch["text"][part].to_pylist()):
                    crc = zlib.crc32(f"{ident}:".encode())
                    for found, n in Counter(run.findall(text)).items():
                        word = spelling(found, crc, drop_every)
                        if len(word) >= least_length:
                            total[word] += n
                if len(total) > _MOST_COUNTED:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


class Letters(NamedTuple):
    """Code points of words, one word after the other."""

    flat: np.ndarray
    begin: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Letters:
        strings = words.to_pylist()
        flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        return cls(flat, np.cumsum(length) - length, length)

    def counts(self, places: np.ndarray, size: int) -> np.ndarray:
        row = np.repeat(np.arange(len(self.length)), self.length)
        return np.bincount(row * size + places, minlength=len(self.length) * size).reshape(-1, size)


def letter_counts(words: Letters) -> np.ndarray:
    """One column a letter: a to z, then U+00C0 to U+00FF."""
    return words.counts(np.where(words.flat < 0x80, words.flat - ord("a"), words.flat - 0xC0 + 26).astype(np.int64), LETTERS)


def group_counts(words: Letters) -> np.ndarray:
    return words.counts((words.flat % GROUPS).astype(np.int64), GROUPS)


def cell_of(groups: np.ndarray) -> np.ndarray:
    """Counts packed into a number. They wrap at _VALUES, which may join cells but never parts a word from a partner."""
    return ((groups % _VALUES).astype(np.int64) << (_COUNT_BITS * np.arange(GROUPS))).sum(1)


def visits(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, cell): the cells other than its own where a word meets partners.

    Those of one letter less, and of its own length those of smaller number that one letter's move leads to; of two
    words in different cells exactly one visits the other's.
    """
    own, found = cell_of(groups), []
    for a in range(GROUPS):
        has = np.flatnonzero(groups[:, a] > 0)
        less = groups[has].copy()
        less[:, a] -= 1
        found.append((has, cell_of(less)))
        for b in range(GROUPS):
            if a != b:
                moved = less.copy()
                moved[:, b] += 1
                cell = cell_of(moved)
                smaller = cell < own[has]
                found.append((has[smaller], cell[smaller]))
    return np.concatenate([w for w, _ in found]), np.concatenate([c for _, c in found])


class Block(NamedTuple):
    """Words of a cell, with the rows of letter counts that make a Gram matrix give squared distances."""

    words: pa.Array
    n: np.ndarray
    letters: Letters
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, n: np.ndarray) -> Block:
        letters = Letters.of(words)
        exact = np.float32 if letters.length.max(initial=0) < _EXACT_LENGTH else np.float64
        counts = letter_counts(letters).astype(exact)
        square, one = (counts**2).sum(1, keepdims=True), np.ones((len(counts), 1), exact)
        return cls(words, n, letters, np.hstack([counts, square, one]), np.hstack([-2 * counts, one, square]))

    def part(self, rows: slice) -> Block:
        letters = Letters(self.letters.flat, self.letters.begin[rows], self.letters.length[rows])
        return Block(self.words[rows], self.n[rows], letters, self.left[rows], self.right[rows])


def one_edit(x: Letters, y: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether word i of x and word j of y differ by exactly one inserted, deleted or replaced code point."""
    out = np.zeros(len(i), bool)
    swap = x.length[i] > y.length[j]
    flat = np.concatenate([x.flat, y.flat])
    a, b = x.begin[i], y.begin[j] + len(x.flat)
    size, longer = np.minimum(x.length[i], y.length[j]), np.abs(x.length[i] - y.length[j])
    short, long_ = np.where(swap, b, a), np.where(swap, a, b)
    for width in np.unique(size).tolist():
        of_width = np.flatnonzero((size == width) & (longer <= 1))
        step = max(1, _CHUNK_PAIRS // max(1, width))
        for at in range(0, len(of_width), step):
            rows = of_width[at : at + step]
            place = np.arange(width)
            s = flat[short[rows, None] + place]
            differs = s != flat[long_[rows, None] + place]
            shifted = s != flat[np.minimum(long_[rows, None] + place + 1, len(flat) - 1)]
            first = np.where(differs.any(1), differs.argmax(1), width) if width else np.zeros(len(rows), int)
            last = np.where(shifted.any(1), width - 1 - shifted[:, ::-1].argmax(1), -1) if width else np.full(len(rows), -1)
            out[rows] = np.where(longer[rows] == 1, last < first, differs.sum(1) == 1)
    return out


def near_pairs(x: Block, y: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of words one edit apart; of one block with itself each pair once."""
    found = [(np.empty(0, int), np.empty(0, int))]
    step = max(1, _CHUNK_PAIRS // max(1, len(y.n)))
    for at in range(0, len(x.n), step):
        close = x.left[at : at + step] @ y.right.T <= 2
        i, j = np.divmod(np.flatnonzero(close), len(y.n))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        near = one_edit(x.letters, y.letters, i, j)
        found.append((i[near], j[near]))
    return tuple(np.concatenate(side) for side in zip(*found))


MET_SCHEMA = "word string, n_near long, form string, form_n long"


def _met(x: Block, y: Block, same: bool, ratio: int) -> Iterator[pa.RecordBatch]:
    """A row for each word with partners, how many; and one for each partner frequent enough to be a form."""
    i, j = near_pairs(x, y, same)
    for a, b, of, to in ((x, y, i, j), (y, x, j, i)):
        if not len(of):
            continue
        counts = np.bincount(of, minlength=len(a.n))
        some = np.flatnonzero(counts)
        forms = np.flatnonzero(b.n[to] // ratio >= a.n[of])
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([a.words.take(pa.array(some)), a.words.take(pa.array(of[forms]))]),
                pa.array(np.concatenate([counts[some], np.zeros(len(forms), np.int64)])),
                pa.concat_arrays([pa.nulls(len(some), pa.string()), b.words.take(pa.array(to[forms]))]),
                pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b.n[to[forms]])]),
            ],
            names=["word", "n_near", "form", "form_n"],
        )


def near_words(words: DataFrame, ratio: int = 10, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones. words: distinct (word, n) of lower-case letters.

    form is the near word of largest n, the first in code-point order of several, if that is ratio times the word's.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(group_counts(Letters.of(batch["word"]))))], names=["cell"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = group_counts(Letters.of(batch["word"]))
            row, cell = visits(groups)
            place = pa.array(np.concatenate([np.arange(batch.num_rows), row]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([cell_of(groups), cell])),
                    pa.array(np.arange(len(place)) >= batch.num_rows),
                    batch["word"].take(place),
                    batch["n"].take(place),
                ],
                names=["cell", "visitor", "word", "n"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home = None, []
        for batch in batches:
            block = Block.of(batch["word"], batch["n"].to_numpy())
            keys = np.stack([batch["cell"].to_numpy(), batch["tile"].to_numpy(), batch["visitor"].to_numpy(zero_copy_only=False)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                group = tuple(keys[:2, begin].tolist())
                if group != at:
                    at, home = group, []
                part = block.part(slice(begin, end))
                for before in home:
                    yield from _met(before, part, False, ratio)
                if not keys[2, begin]:
                    yield from _met(part, part, True, ratio)
                    home.append(part)

    full = words.mapInArrow(cells, "cell long").groupBy("cell").count().filter(F.col("count") > tile_rows)
    tiles = full.select("cell", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles"))
    dealt = words.mapInArrow(deal, "cell long, visitor boolean, word string, n long").join(tiles, "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.when(F.col("visitor"), F.col("tiles") - 1).otherwise(F.pmod(F.xxhash64("word"), F.col("tiles"))).cast("int")
    spread = dealt.select("cell", F.explode(F.sequence(F.lit(0), own)).alias("tile"), "visitor", own.alias("own"), "word", "n")
    spread = spread.withColumn("visitor", F.col("visitor") | (F.col("tile") < F.col("own"))).drop("own")  # of two tiles the later visits
    met = spread.repartition("cell", "tile").sortWithinPartitions("cell", "tile", "visitor").mapInArrow(meet, MET_SCHEMA)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), "form"))).alias("best")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.minus")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms lead. Counts grow along them, so there are no circles.

    Each round doubles the steps that a row has followed, until none changes.
    """
    current = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not current.filter("moved").isEmpty():
        nexts = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = splittable_join(current.drop("moved"), nexts, ["root"], "left")
        before, current = current, materialize(followed.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(before)
    return current.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, drop_every: int = 31, ratio: int = 10) -> DataFrame:
    """(word, n, form, root, n_near, form_n), one row for each distinct word that is long and frequent enough.

    Near words differ by exactly one code point. A word's form is the near word of largest n if that is ratio times
    its own, its root where the forms lead in the end, the word itself without any. Null and wordless texts add
    nothing, null ids count as empty ones, repeated rows count again, an empty table gives no rows; texts and words
    may be of any length. Other columns are ignored, whatever their names.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least, or forms could lead in circles")
    words = materialize(count_words(docs, id_col, text_col, least_length, drop_every).filter(F.col("n") >= least_count), "words")
    near = materialize(near_words(words, ratio), "near-words")
    roots = _roots(near.filter("form is not null").select("word", "form"))
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
