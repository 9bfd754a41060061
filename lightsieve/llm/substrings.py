"""Removal of long repeated word sequences by compaction of the de Bruijn graph's windows at their minimizers.

The k-mers of the graph are windows of 35 words. A chain of consecutive windows that share their minimizer (the
least hash among the 12-word sequences inside a window) is compacted into one row, as disk-based assemblers do:
equal windows have equal minimizers, so all that can repeat meets at the minimizer. This takes the place of an edge
table with degrees, which would have a row for each word of the corpus.

* A minimizer that occurs once belongs to no repeated window.
* One whose chains all have the same content is a nonbranching path: all of its windows repeat.
* Any other is a branching point. Equal chains repeat. The windows of the chains left, with one copy of those that
  repeat, are taken from the texts again by their source coordinates and compared one by one.

Minimizers come from one half of each word's 128-bit hash and contents from the other, so words that collide in one do
not in the other, and chains count as equal when minimizer and content agree. The texts are written once, dealt by a
row key, and the two later joins read them where they lie.

Hot passages are many rows of one minimizer; they meet in pre-aggregated counts and in joins whose large
partitions Spark can split, never in one group.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsieve.operators.skew import splittable_join
from lightsieve.session import materialize, shared_path

WINDOW = 35
MINI = 12
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_CACHE_WORDS = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.split()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h


class WindowHashes:
    """64-bit hashes of word sequences, from running sums of word hashes times powers of an odd base."""

    def __init__(self):
        self.cache = _WordHashes()
        self.power = self.inverse = np.ones(1, np.uint64)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Two families of word hashes: the halves of a 128-bit one."""
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        both = np.frombuffer(b"".join(map(self.cache.__getitem__, words)), np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, word_hashes: np.ndarray) -> np.ndarray:
        self._powers(len(word_hashes) + 1)
        out = np.empty(len(word_hashes) + 1, np.uint64)
        out[0] = 0
        np.multiply(word_hashes, self.power[: len(word_hashes)], out=out[1:])
        return np.cumsum(out, dtype=np.uint64)

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the sequences begin:end."""
        h = (sums[end] - sums[begin]) * self.inverse[begin]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def chains(hashes: WindowHashes, words: list[bytes]) -> tuple[np.ndarray, ...]:
    """(start, n, minimizer, content) of the chains of a text: n windows from word ``start`` on share a minimizer.

    Of equal 12-word sequences in a window the leftmost counts, so equal windows have it at the same place.
    """
    n = len(words) - WINDOW + 1
    first, second = hashes.words(words)
    begin = np.arange(len(words) - MINI + 1)
    mini = hashes.of(hashes.sums(first), begin, begin + MINI)
    at = np.lib.stride_tricks.sliding_window_view(mini, WINDOW - MINI + 1).argmin(axis=1) + np.arange(n)
    start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    length = np.diff(np.append(start, n))
    return start, length, mini[at[start]], hashes.of(hashes.sums(second), start, start + length - 1 + WINDOW)


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WindowHashes()
    for batch in batches:
        keys, parts = [], []
        for key, text in zip(batch["key"].to_pylist(), batch["text"]):
            words = words_of(text.as_py())
            if len(words) >= WINDOW:
                parts.append(chains(hashes, words))
                keys.append(np.full(len(parts[-1][0]), key, np.int64))
        if parts:
            start, n, mini, content = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mini.view(np.int64)), pa.array(content.view(np.int64))],
                names=["key", "start", "n", "mini", "content"],
            )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window of the asked chains: its minimizer, the hash of its words, where it starts, and whether it repeats for certain."""
    hashes = WindowHashes()
    for batch in batches:
        rows: list[tuple] = []
        for key, text, asked in zip(batch["key"].to_pylist(), batch["text"], batch["asked"].to_pylist()):
            words = words_of(text.as_py())
            sums = hashes.sums(hashes.words(words)[1])
            start = np.concatenate([np.arange(a["start"], a["start"] + a["n"]) for a in asked])
            known = np.repeat(np.array([a["known"] for a in asked]), [a["n"] for a in asked])
            mini = np.repeat(np.array([a["mini"] for a in asked], np.int64), [a["n"] for a in asked])
            rows.append((np.full(len(start), key, np.int64), start, known, mini, hashes.of(sums, start, start + WINDOW)))
        if rows:
            key, start, known, mini, window = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(start.astype(np.int32)), pa.array(known), pa.array(mini), pa.array(window.view(np.int64))], names=["key", "start", "known", "mini", "window"]
            )


def cut(text: bytes, spans: list[dict]) -> tuple[int, int, str, list[dict]]:
    """(words, words removed, SHA-256 of the words kept, joined by spaces; the removed spans of words)."""
    words = words_of(text)
    if not spans:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), []
    edge = np.zeros(len(words) + 1, np.int32)
    start = np.array([s["start"] for s in spans])
    np.add.at(edge, start, 1)
    np.add.at(edge, start + np.array([s["n"] for s in spans]) + WINDOW - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"begin": b, "end": e} for b, e in turns.reshape(-1, 2).tolist()]


def _dealt(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder in buckets of their key: joins on the key shuffle the other side alone."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"texts_{uuid.uuid4().hex}", shared_path(spark, "texts")
    rows.repartition(n, "key").write.bucketBy(n, "key").option("path", path).option("compression", "zstd").saveAsTable(name)
    dealt = spark.table(name)
    dealt.schema  # resolves the table, so that its name can go again; the files stay
    spark.sql(f"DROP TABLE {name}")
    return dealt


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, removed), one row for each input row; removed: spans of words.

    A word goes when a window of 35 consecutive words that covers it also starts anywhere else, in the same text or
    another; windows are judged on the input. Null and wordless texts have no words, texts of fewer than 35 lose
    none. Rows that repeat id, text or both are rows of their own: each is one more place where its windows start.
    Texts are cut whole, however long; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    id_kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _dealt(docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), text.cast("binary").alias("text")))
    chain = materialize(rows.select("key", "text").mapInArrow(_chain_rows, "key long, start int, n int, mini long, content long"), "chains", "zstd")

    met = chain.groupBy("mini").agg(F.count("*").alias("times"), F.min("content").alias("least"), F.max("content").alias("most"))
    again = materialize(splittable_join(chain, met.filter("times > 1"), ["mini"]).select("key", "start", "n", "mini", "content", (F.col("least") == F.col("most")).alias("straight")), "repeated", "zstd")

    branching = again.filter("not straight").withColumn("ticket", F.xxhash64("key", "start"))
    variants = branching.groupBy("mini", "content").agg(F.count("*").alias("times"), F.min("ticket").alias("first"))
    judged = splittable_join(branching, variants, ["mini", "content"])
    known = again.filter("straight").select("key", "start", "n").unionByName(judged.filter("times > 1").select("key", "start", "n"))
    asked = (
        judged.filter("times = 1 or ticket = first")
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "n", "mini", (F.col("times") > 1).alias("known"))).alias("asked"))
    )
    windows = rows.join(asked.hint("shuffle_hash"), "key").select("key", "text", "asked").mapInArrow(_window_rows, "key long, start int, known boolean, mini long, window long")
    equal = windows.groupBy("mini", "window").agg(F.count("*").alias("times"), F.max("known").alias("known")).filter("times > 1 or known").select("mini", "window")
    resolved = splittable_join(windows.filter("not known"), equal, ["mini", "window"]).select("key", "start", F.lit(1).alias("n"))

    spans = known.unionByName(resolved).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            done = [cut(t.as_py(), s or []) for t, s in zip(batch["text"], batch["spans"].to_pylist())]
            n, gone, sha, removed = zip(*done) if done else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(removed, kind)], names=[id_col, "n_words", "n_removed", "kept_sha256", "removed"])

    joined = rows.join(spans.hint("shuffle_hash"), "key", "left").select("id", "text", "spans")
    return joined.mapInArrow(cut_rows, f"{id_col} {id_kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<begin:int,end:int>>")
