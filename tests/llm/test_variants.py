"""Spelling variants against all pairs of words, one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lightsieve.llm import variants
from tests.llm import brute


def found(docs, **more):
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in variants.spelling_variants(docs, **more).collect()}


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    expected = brute.spelling_variants([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert len(expected) > 500 and found(docs) == expected


def odd(spark):
    chain = " ".join(["letters"] * 3000 + ["lettters"] * 250 + ["letttters"] * 20 + ["lettttters"] * 2 + ["retters"] * 30 + ["betters"] * 30 + ["setters"] * 3)
    texts = [None, "", "a", chain, "Ünterlagen unterlagen ÜNTERLAGEN" * 2, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5001 + "y " + "x" * 5001 + "y", "abcdefg abcdefg gfedcba gfedcba abcdegf abcdegf", "naïveté×÷ÿ naïveté×÷ÿ naïvetéÿ naïvetéÿ"]
    rows = [(i, t, 1, "clash", True) for i, t in enumerate(texts)] + [(None, "letters lettres letters lettres", 2, None, None)] * 2 + [(3, chain, 1, "clash", True)]
    return spark.createDataFrame(rows, "doc_id long, text string, cell long, word string, visitor boolean"), [(r[0], r[1]) for r in rows]


def test_odd_rows(spark):
    docs, rows = odd(spark)
    expected = brute.spelling_variants(rows)
    assert expected["lettttters"][2] == "letters" and expected["setters"][1] == "letters"
    assert found(docs) == expected
    assert found(docs.limit(0)) == {}
    assert found(docs.select("doc_id", "text").filter("text is null")) == {}


def test_small_tiles_give_the_same(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abc") for _ in range(r.choice((7, 8)))): r.randrange(2, 400) for _ in range(900)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    whole, tiled = ({tuple(x) for x in variants.near_words(frame, tile_rows=t).collect()} for t in (8192, 7))
    assert whole == tiled and len(whole) > 500


@pytest.mark.parametrize("seed", range(3))
def test_one_edit(seed):
    r = random.Random(seed)
    xs = ["".join(r.choice("ab") for _ in range(r.randrange(0, 5))) for _ in range(40)]

    def plain(x, y):
        if len(x) > len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) == 1
        return len(y) == len(x) + 1 and any(x == y[:k] + y[k + 1 :] for k in range(len(y)))

    i, j = (m.ravel() for m in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))
    letters = variants.Letters.of(pa.array(xs))
    assert variants.one_edit(letters, letters, i, j).tolist() == [plain(xs[a], xs[b]) for a, b in zip(i, j)]
