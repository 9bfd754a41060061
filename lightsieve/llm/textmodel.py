"""Hashed word features and small numpy classifiers that the toxicity and quality operators share."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
_CACHE_WORDS = 500_000
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def word_features(word: str, form: bool = True) -> list[int]:
    """Places of a word's features: the word without case and outer marks and its beginnings; with ``form`` also its last characters as written."""
    bare = word.strip(".,;:!?\"'()|" if form else _MARKS).lower()
    names = ["w" + bare, *(["e" + word[-3:]] if form else []), *("b" + bare[:n] for n in (4, 5, 6, 7) if len(bare) >= n)]
    return [xxhash.xxh32_intdigest(n) % DIMENSIONS for n in names]


class _Logs(dict):
    """log(1 + n) by n."""

    def __missing__(self, n: int) -> float:
        v = math.log1p(n)
        if n < 4096:  # the rest are computed each time
            self[n] = v
        return v


_LOG = _Logs()


class WordScores(dict):
    """Sum of a word's weights, computed once a word; cleared when it grows beyond a bound."""

    def __init__(self, weights: np.ndarray, form: bool = True):
        self.weights, self.form = weights, form

    def __missing__(self, word: str) -> float:
        if len(self) > _CACHE_WORDS:
            self.clear()
        s = self[word] = float(self.weights[word_features(word, self.form)].sum())
        return s

    def of(self, text: str) -> float:
        """Sum over the different words of a whole text, each by the log of its count, damped by length; 0 for no words."""
        words = text.split()
        return sum(self[w] * _LOG[n] for w, n in Counter(words).items()) / len(words) ** 0.25 if words else 0.0


class Sparse(NamedTuple):
    """Rows of feature places and values; begin[i] is where row i starts, no row is empty (place 0, value 0 fills in)."""

    place: np.ndarray
    value: np.ndarray
    row: np.ndarray
    begin: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights.astype(np.float32)[self.place] * self.value, self.begin).astype(np.float64)

    def back(self, gradient: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, self.value * gradient[self.row].astype(np.float32), minlength=DIMENSIONS)


class _Places(dict):
    """Feature places of words, with a bound on how many are kept."""

    def __init__(self, form: bool):
        super().__init__()
        self.form = form

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = tuple(word_features(word, self.form))
        return found


def _row(text: str, places: _Places) -> tuple[np.ndarray, np.ndarray]:
    """Different feature places of a text, ascending, and their values."""
    counts = Counter(text.split())
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    found = [places[w] for w in counts]
    place = np.fromiter(itertools.chain.from_iterable(found), np.int32)
    each = np.repeat([_LOG[c] for c in counts.values()], [len(f) for f in found])
    place, at = np.unique(place, return_inverse=True)
    return place, (np.bincount(at, each) / sum(counts.values()) ** 0.25).astype(np.float32)


def sparse_features(text: Column, form: bool = True, prepare: Callable[[str], str] = str) -> Column:
    """struct<place, value>, both binary: the features of whole texts, at most DIMENSIONS of them, built on executors."""

    @F.pandas_udf("struct<place:binary,value:binary>")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        places = _Places(form)
        for texts in batches:
            rows = [_row(prepare(t), places) for t in texts]
            yield pd.DataFrame({"place": [p.astype(np.int32).tobytes() for p, _ in rows], "value": [v.tobytes() for _, v in rows]})

    return build(text)


def sparse_rows(place: list[bytes], value: list[bytes], least_docs: int = 8) -> Sparse:
    """Features that at least least_docs of the rows have; rarer ones would only be learned by heart."""
    seen = np.zeros(DIMENSIONS, np.int32)
    for p in place:
        seen[np.frombuffer(p, np.int32)] += 1
    parts, values, sizes = [], [], []
    for p, v in zip(place, value):
        p, v = np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)
        often = seen[p] >= least_docs
        parts.append(np.append(p[often], np.int32(0)))
        values.append(np.append(v[often], np.float32(0)))
        sizes.append(len(parts[-1]))
    begin = np.cumsum([0, *sizes[:-1]]).astype(np.int64)
    return Sparse(np.concatenate(parts), np.concatenate(values), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), begin)


def pieces(column: pa.Array, most: int) -> Iterator[slice]:
    """Slices of a string or binary column of about ``most`` bytes each, one row at least."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        yield slice(begin, end)
        begin = end


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: Sparse, gradient_of, steps: int = 150, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Adam on a linear score. gradient_of(scores) gives the derivative of the risk by each row's score.

    Steps shrink towards the end and the last third of them is averaged: a risk that switches between two
    gradients has no single last step to trust.
    """
    w, b = np.zeros(DIMENSIONS), 0.0
    mean_w, mean_b, averaged = np.zeros(DIMENSIONS), 0.0, 0
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for t in range(1, steps + 1):
        g_score = gradient_of(rows.dot(w) + b)
        g = np.append(rows.back(g_score) + decay * w, g_score.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        shrink = min(1.0, 2 * (1 - t / (steps + 1)))
        step = shrink * rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
        if 3 * t > 2 * steps:
            averaged += 1
            mean_w += (w - mean_w) / averaged
            mean_b += (b - mean_b) / averaged
    return mean_w, float(mean_b)


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; the held-out fold is 0. Null ids are never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def bounded_sample(rows: DataFrame, id_col: str, n: int, salt: str) -> DataFrame:
    """The n rows of the least hashed ids: the same rows each time, at most n of them."""
    return rows.orderBy(F.xxhash64(F.lit(salt), F.col(id_col)), F.col(id_col)).limit(n)
