"""Token counts: pieces are counted once per distinct pre-token and joined to the pre-tokens of the documents.

The vocabulary is a byte-pair model whose pieces never hold a word mark after another character, so the text
can be cut before each run of word marks: a merge never crosses such a cut, and the sum over the pre-tokens is
the count of the whole text. ``assert_splittable`` checks that property of the model that is used.

Two passes over the texts: one counts the pre-tokens of the corpus, the other those of each document. The pieces of
the corpus's most frequent pre-tokens are broadcast; (document, pre-token, frequency) rows of all others meet their
pieces by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsieve.llm.textmodel import pieces as slices
from lightsieve.session import materialize

MARK = "▁"
#: a run of spaces or word marks, with the characters up to the next one; the text gets one space in front
PRE_TOKEN = re.compile("[ ▁]+[^ ▁]*")
#: of a pre-token that is broadcast
MOST_LETTERS = 64
PIECE_BYTES = 16 << 20


def load_model(model_proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model_proto)


def assert_splittable(model_proto: bytes) -> None:
    """Raises ValueError when some piece of the model crosses a cut, or the model rewrites or trims its input."""
    model = load_model(model_proto)
    crossing = [i for i in range(model.vocab_size()) if MARK in model.id_to_piece(i).lstrip(MARK)]
    if crossing or len(model.encode("  a  ")) != len(model.encode(" a")) + 1 or model.encode(""):
        raise ValueError("the model's pieces cross word marks; its counts are no sum over pre-tokens")


def piece_count(model, pre_token: str) -> int:
    """Pieces of one pre-token, which comes without its first mark: the model adds that itself."""
    return len(model.encode(pre_token)) if pre_token else 1


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(document of each pre-token, pre-tokens without their first mark) of the texts; the empty text has none.

    Texts of single spaces alone are cut by Arrow, all others by the pattern.
    """
    irregular = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, MARK)).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~irregular & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
    lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
    doc, words = np.repeat(plain, pc.list_value_length(lists).to_numpy(zero_copy_only=False)), [lists.flatten()]
    slow = np.flatnonzero(irregular)
    if len(slow):
        found = [[p[1:] for p in PRE_TOKEN.findall(" " + texts[int(i)].as_py())] for i in slow]
        doc = np.concatenate([doc, np.repeat(slow, [len(f) for f in found])])
        words.append(pa.array([p for f in found for p in f], pa.string()))
    return doc, pa.concat_arrays(words).dictionary_encode()


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, head_rows: int = 400_000) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row for each input row.

    Null and empty texts have no bytes and no tokens; an empty table gives no rows. Rows that repeat, and rows without
    id, are counted one by one. Texts are counted whole, however long they are. Other columns are ignored, whatever
    their names.

    The most frequent pre-tokens, at most ``head_rows`` of MOST_LETTERS letters each, are broadcast; all others are
    joined by shuffle.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        proto = f.read()
    assert_splittable(proto)
    model_proto = spark.sparkContext.broadcast(proto)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("long")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model(model_proto.value)
        for pre in batches:
            yield pre.map(lambda p: piece_count(model, p)).astype("int64")

    def corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch["text"], PIECE_BYTES):
                _, words = pre_tokens(batch["text"][part])
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n, pa.int64())], names=["pre", "freq"])

    distinct = rows.select("text").mapInArrow(corpus, "pre string, freq long").groupBy("pre").agg(F.sum("freq").alias("freq"))
    counted = materialize(distinct.withColumn("n", pieces("pre")), "pieces")
    least = _head_threshold(counted, head_rows)
    of_head = (F.col("freq") >= least) & (F.length("pre") <= MOST_LETTERS)
    head = spark.sparkContext.broadcast(counted.filter(of_head).select("pre", "n").toArrow().combine_chunks())
    id_kind = docs.schema[id_col].dataType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with its head's tokens, and one for each other pre-token of it.

        The document's own row has a key that no pre-token has (a space after another character), so it spreads and
        joins nothing.
        """
        known, known_n = head.value["pre"].combine_chunks(), head.value["n"].to_numpy()
        for batch in batches:
            for part in slices(batch["text"], PIECE_BYTES):
                row, ident, texts = batch["row"][part], batch["id"][part], batch["text"][part]
                doc, words = pre_tokens(texts)
                at = pc.fill_null(pc.index_in(words.dictionary, known), -1).to_numpy(zero_copy_only=False)
                n = np.where(at >= 0, known_n[at], 0) if len(known_n) else np.zeros(len(at), np.int64)
                index = words.indices.to_numpy()
                head_n = np.bincount(doc, n[index], len(row)).astype(np.int64)
                rest = (at < 0)[index]
                pair, freq = np.unique(doc[rest].astype(np.int64) * len(at) + index[rest], return_counts=True)
                tail_doc, tail_word = np.divmod(pair, max(1, len(at)))
                none = pa.nulls(len(pair), pa.int64())
                keys = pa.array([f"\0 {r}" for r in row.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([row, row.take(pa.array(tail_doc))]),
                        pa.concat_arrays([keys, words.dictionary.take(pa.array(tail_word))]),
                        pa.concat_arrays([pa.nulls(len(row), pa.int64()), pa.array(freq, pa.int64())]),
                        pa.concat_arrays([ident, pa.nulls(len(pair), ident.type)]),
                        pa.concat_arrays([pc.binary_length(texts).cast(pa.int64()), none]),
                        pa.concat_arrays([pa.array(head_n), none]),
                    ],
                    names=["row", "pre", "freq", "id", "n_bytes", "head_n"],
                )

    dealt = rows.mapInArrow(documents, f"row long, pre string, freq long, id {id_kind}, n_bytes long, head_n long")
    joined = dealt.join(counted.filter(~of_head).select("pre", "n"), "pre", "left")
    total = joined.groupBy("row").agg(
        F.first("id", ignorenulls=True).alias(id_col), F.max("n_bytes").alias("n_bytes"), (F.max("head_n") + F.coalesce(F.sum(F.col("freq") * F.col("n")), F.lit(0))).alias("n_tokens")
    )
    return total.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _head_threshold(counted: DataFrame, head_rows: int) -> int:
    """The least frequency that at most head_rows pre-tokens reach, from a histogram of some hundred rows at most."""
    steps = counted.groupBy(F.floor(F.log2("freq") * 8).alias("step")).agg(F.count("*").alias("rows"), F.min("freq").alias("least")).orderBy(F.desc("step")).collect()
    least, so_far = 1 << 62, 0
    for step in steps:
        so_far += step["rows"]
        if so_far > head_rows:
            break
        least = step["least"]
    return least
