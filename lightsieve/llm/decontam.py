"""Benchmark decontamination with a positional inverted index of the training documents.

The index is a table of segments in the shared folder: each task writes its documents as one segment or more, with
the postings (ascending token positions) of every term. A test phrase is looked up in each segment from its rarest
term on: positions are shifted by the term's offset in the phrase and intersected with the next rarest list until
none is left or all terms agree. Proximity matches start at the terms of a phrase that are rarest in the whole index,
as many as it takes to miss none, and ask that most of its terms stand close by, whatever their order.

Terms are stored as 64-bit hashes. Documents are POSITION_GAP positions apart, so no match runs across two of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsieve.session import materialize

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # after lower-casing A-Z; bytes from 0x80 on belong to letters
WINDOW = 13
POSITION_GAP = 64
SEGMENT_TOKENS = 2_000_000
BLOCK_CHARS = 8_000_000

SEGMENT_SCHEMA = "segment string, doc_ids array<{id}>, n_words array<int>, terms binary, counts binary, gaps binary"
MATCH_SCHEMA = "segment string, doc int, doc_id {id}, n_words int, spans array<struct<begin:int,end:int>>, items array<string>, near array<string>"


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


class Segment(NamedTuple):
    """terms: ascending hashes; starts[i]:starts[i+1] are the places of term i's postings in positions."""

    terms: np.ndarray
    starts: np.ndarray
    positions: np.ndarray

    def postings(self, i: int) -> np.ndarray:
        return self.positions[self.starts[i] : self.starts[i + 1]]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """One row a segment, at most segment_tokens tokens or one document. Null texts have no tokens; ids keep their type."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, builder = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                builder = builder or _Builder(batch["doc_id"].type)
                builder.add(doc_id, terms_of(text.as_py()))
                if builder.size >= segment_tokens:
                    yield builder.row(f"{task}-{done}")
                    builder, done = None, done + 1
        if builder:
            yield builder.row(f"{task}-{done}")

    return materialize(rows.mapInArrow(segments, SEGMENT_SCHEMA.format(id=kind)), "index", "zstd")


class _Builder:
    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.size, self.ids, self.lengths, self.tokens, self.local = 0, [], [], [], {}

    def add(self, doc_id: pa.Scalar, terms: list[bytes]) -> None:
        local = self.local
        self.tokens.append(np.fromiter((local.setdefault(t, len(local)) for t in terms), np.int32, len(terms)))
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.size += len(terms)

    def row(self, name: str) -> pa.RecordBatch:
        hashes = np.fromiter(map(term_hash, self.local), np.uint64, len(self.local))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        tokens = np.concatenate([*self.tokens, np.empty(0, np.int32)])
        position = np.arange(len(tokens), dtype=np.int64) + POSITION_GAP * np.repeat(np.arange(len(self.lengths)), self.lengths)
        terms = rank[tokens] if len(tokens) else tokens
        by_term = np.argsort(terms, kind="stable")
        counts = np.bincount(terms, minlength=len(order)).astype(np.int32)
        position = position[by_term]
        gaps = np.diff(position, prepend=0)
        gaps[np.cumsum(counts)[:-1]] = position[np.cumsum(counts)[:-1]]  # a term's first posting is absolute
        planes = np.ascontiguousarray(gaps.astype("<u4")).view(np.uint8).reshape(-1, 4).T  # high bytes are nearly all 0
        arrays = [[name], None, [self.lengths], [hashes[order].tobytes()], [counts.tobytes()], [planes.tobytes()]]
        kinds = [pa.string(), None, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array(a, k) if k else pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), pa.array(self.ids, self.id_type)) for a, k in zip(arrays, kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "doc_ids", "n_words", "terms", "counts", "gaps"])


def open_segment(terms: bytes, counts: bytes, gaps: bytes) -> Segment:
    counts = np.frombuffer(counts, np.int32).astype(np.int64)
    deltas = np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    positions = np.cumsum(deltas)
    before = np.concatenate([[0], positions])[starts[:-1]] if len(counts) else np.empty(0, np.int64)
    return Segment(np.frombuffer(terms, np.uint64), starts, positions - np.repeat(before, counts))


class Queries(NamedTuple):
    """A block of test items: their terms one after the other, and the phrases (windows) among them."""

    names: list[str]
    vocabulary: np.ndarray  # ascending hashes
    terms: np.ndarray  # of all items: places in the vocabulary
    begin: np.ndarray  # of each phrase: place in terms
    length: np.ndarray
    item: np.ndarray
    stride: np.ndarray  # whether a phrase is one of those that together cover the item once


def queries_of(items: list[tuple[str, bytes]], window: int = WINDOW) -> Queries:
    """Phrases of ``window`` consecutive words; an item of fewer, but not none, is one phrase."""
    names, hashes, begin, length, item, stride = [], [], [], [], [], []
    at = 0
    for name, text in items:
        words = terms_of(text)
        if not words:
            continue
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            begin.append(at + i)
            length.append(size)
            item.append(len(names))
            stride.append(i % size == 0 or i == len(words) - size)
        names.append(name)
        hashes += map(term_hash, words)
        at += len(words)
    vocabulary, terms = np.unique(np.array(hashes, np.uint64), return_inverse=True)
    return Queries(names, vocabulary, terms.astype(np.int64), *(np.array(x, np.int64) for x in (begin, length, item)), np.array(stride, bool))


def _among(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[place] == wanted


def exact_matches(segment: Segment, queries: Queries) -> Iterator[tuple[int, np.ndarray]]:
    """(phrase, first positions of its occurrences), for phrases that occur."""
    if not len(segment.terms) or not len(queries.begin):
        return
    place = np.minimum(np.searchsorted(segment.terms, queries.vocabulary), len(segment.terms) - 1)
    found = segment.terms[place] == queries.vocabulary
    frequency = np.where(found, np.diff(segment.starts)[place], 0)[queries.terms]
    absent = np.concatenate([[0], np.cumsum(frequency == 0)])
    for q in np.flatnonzero(absent[queries.begin + queries.length] == absent[queries.begin]):
        words = slice(queries.begin[q], queries.begin[q] + queries.length[q])
        starts = None
        for offset in np.argsort(frequency[words], kind="stable"):
            postings = segment.postings(place[queries.terms[words][offset]])
            if starts is None:
                starts = postings - offset
            else:
                starts = starts[_among(postings, starts + offset)]
            if not len(starts):
                break
        if len(starts):
            yield int(q), starts


def frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of a block of test items occurs in the whole index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch["terms"], batch["counts"]):
                terms, counts = np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int32)
                if len(terms):
                    place = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                    total += np.where(terms[place] == vocabulary, counts[place], 0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for r in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # terms of one block of items
            out[r["term"]] = r["n"]
    return out


def near_matches(segment: Segment, queries: Queries, frequency: np.ndarray, slop: int, least_share: float = 0.75) -> Iterator[tuple[int, np.ndarray]]:
    """(phrase, positions in matches): where least_share of its different terms stand among as many words as it has plus slop.

    A match lacks few terms, so one of any n - least + 1 of a phrase's n terms is in it: those that are rarest in the
    whole index (``frequency``) are the anchors, and none is missed. Around an anchor only the nearest place of each
    term to the left and to the right counts. Only the phrases that together cover an item are asked, its last one
    among them.
    """
    if not len(segment.terms) or not len(queries.begin):
        return
    place = np.minimum(np.searchsorted(segment.terms, queries.vocabulary), len(segment.terms) - 1)
    here = segment.terms[place] == queries.vocabulary
    blocks = _Blocks(segment)
    for q in np.flatnonzero(queries.stride):
        words = np.unique(queries.terms[queries.begin[q] : queries.begin[q] + queries.length[q]])
        least = math.ceil(least_share * len(words))
        present = words[here[words]]
        if len(present) < least:
            continue
        rarest = words[np.lexsort((words, frequency[words]))[: len(words) - least + 1]]
        reach = min(int(queries.length[q]) + slop, POSITION_GAP)
        at = np.sort(np.concatenate([np.empty(0, np.int64), *(segment.postings(place[anchor]) for anchor in rarest[here[rarest]])]))
        at = at[blocks.count(at, place[present], reach) >= least]
        if len(at):
            sides = [_distance(at, segment.postings(place[word])) for word in present]
            # of the reach stretches that hold the anchor: the one that begins `back` words before it
            full = [sum(((left <= back) | (right < reach - back)).astype(np.int64) for left, right in sides) >= least for back in range(reach)]
            at = at[np.any(full, axis=0)]
        if len(at):
            yield int(q), at


class _Blocks:
    """Which terms stand in or next to a block of a segment's positions; those of the terms asked last are kept."""

    def __init__(self, segment: Segment, most: int = 500):
        self.segment, self.near = segment, lru_cache(most)(self._near)
        self.end = int(segment.positions.max(initial=0))

    def _near(self, term: int, width: int) -> np.ndarray:
        own = np.zeros(self.end // width + 3, bool)
        own[self.segment.postings(term) // width + 1] = True
        return own[:-2] | own[1:-1] | own[2:]

    def count(self, at: np.ndarray, terms: np.ndarray, reach: int) -> np.ndarray:
        """For each position how many of the terms stand near it, none of those missing that stand within reach."""
        width = 32 if reach <= 32 else POSITION_GAP
        block, found = at // width, np.zeros(len(at), np.int16)
        for term in terms.tolist():
            found += self.near(term, width)[block]
        return found


def _distance(at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How far the nearest of other lies to the left, itself included, and to the right of each position."""
    right = np.searchsorted(other, at, side="right")
    far = np.int64(1) << 40
    before = np.where(right > 0, at - other[np.maximum(right - 1, 0)], far)
    after = np.where(right < len(other), other[np.minimum(right, len(other) - 1)] - at, far)
    return np.stack([before, after])


def _merged(begin: np.ndarray, end: np.ndarray) -> list[dict]:
    """Union of intervals that are given by ascending begins."""
    out: list[dict] = []
    for b, e in zip(begin.tolist(), end.tolist()):
        if out and b <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"begin": b, "end": e})
    return out


def search_segment(row: dict, queries: Queries, frequency: np.ndarray, slop: int) -> list[dict]:
    """For each document of a segment: the word spans that phrases hit, and the items with exact and near matches."""
    segment = open_segment(row["terms"], row["counts"], row["gaps"])
    lengths = np.array(row["n_words"], np.int64)
    doc_start = np.concatenate([[0], np.cumsum(lengths)])[:-1] + POSITION_GAP * np.arange(len(lengths))
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    near: dict[int, set] = {}
    for q, starts in exact_matches(segment, queries):
        docs = np.searchsorted(doc_start, starts, side="right") - 1
        for d, s in zip(docs.tolist(), (starts - doc_start[docs]).tolist()):
            spans.setdefault(d, []).append((s, s + int(queries.length[q])))
            items.setdefault(d, set()).add(queries.names[queries.item[q]])
    for q, at in near_matches(segment, queries, frequency, slop):
        for d in np.unique(np.searchsorted(doc_start, at, side="right") - 1).tolist():
            near.setdefault(d, set()).add(queries.names[queries.item[q]])
    out = []
    for d, n in enumerate(row["n_words"]):
        pairs = np.array(sorted(spans.get(d, ())), np.int64).reshape(-1, 2)
        out.append({"segment": row["segment"], "doc": d, "n_words": n, "spans": _merged(pairs[:, 0], pairs[:, 1]), "items": sorted(items.get(d, ())), "near": sorted(near.get(d, ()))})
    return out


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 7, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each indexed document: (segment, doc, doc_id, n_words, spans, items, near).

    The test items go out in blocks of about block_chars characters each, so what is broadcast stays bounded however
    large the test set is; the index stays and is searched once a block. Items of equal id count as one item, and so
    do those without id, whose name is the empty string.
    """
    spark, kind = index.sparkSession, index.schema["doc_ids"].dataType.elementType.simpleString()
    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_chars))
    named = named.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))
    if n_blocks > 1:
        named = materialize(named, "test-items")
    found = None
    for block in range(n_blocks):
        items = [(r["item"], r["text"].encode()) for r in named.filter(F.col("block") == block).collect()]
        queries = queries_of(items, window)
        sent = spark.sparkContext.broadcast((tuple(queries), frequencies(index, queries.vocabulary)))
        part = index.mapInArrow(_searcher(sent, slop), MATCH_SCHEMA.format(id=kind))
        found = part if found is None else found.unionByName(part)
    if n_blocks == 1:
        return found
    return found.groupBy("segment", "doc").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
    )


def _searcher(sent, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, frequency = Queries(*sent.value[0]), sent.value[1]
        kind = [("segment", pa.string()), ("doc", pa.int32()), ("n_words", pa.int32()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch[name][i].as_py() for name in batch.schema.names if name != "doc_ids"}
                found = pa.RecordBatch.from_pylist(search_segment(row, queries, frequency, slop), pa.schema(kind))
                yield pa.RecordBatch.from_arrays([*found.columns[:2], batch["doc_ids"][i].values, *found.columns[2:]], names=["segment", "doc", "doc_id", *found.schema.names[2:]])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_share: float = 0.05) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items, near_items, spans, contaminated), one row for each input row.

    A document is contaminated when words of it are hit and they make up least_share of its words or more. Null and
    wordless texts have no words and are clean; so is everything when no test item has words. Repeated rows, and rows
    without id, are documents of their own; ids keep their type. An empty table gives no rows. Texts are indexed whole:
    a long one is a segment by itself. Test items without id are asked, too, and count as one item whose name is the
    empty string. Other columns are ignored, whatever their names.
    """
    found = search(build_index(docs, id_col, text_col), benchmark, window=window)
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["begin"]))).alias("n")),
    )
    hit = union["n"]
    return found.select(
        F.col("doc_id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.col("near").alias("near_items"),
        "spans",
        ((hit > 0) & (hit * round(1 / least_share) >= F.col("n_words"))).alias("contaminated"),
    )
