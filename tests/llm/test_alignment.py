"""Alignment of two tokenizers against whole texts under the libraries."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lightsieve.llm import alignment, queries
from tests.llm import brute

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path()
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def found(docs):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.cross_align(docs, A, B).collect()}


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert found(docs) == brute.cross_align([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], A, B)


SPACES = [" ", "  ", "\n", " \n ", "\n\n ", "\t ", "\x1c ", "\x85 ", "\xa0", "\xa0 ", " ", "​ ", "᠎ ", "　 ", "﻿ ", "▁", " ▁ ", "\r\n "]
WORDS = ["it's", "I'LL", "'s", "12,5", "%", "...", "naïve", "文字テスト", "𝔘🙂🙂", "é", "<|endoftext|>", "<s>", "<unk>", "<0x0A>", "a", "internationalisation", "-", "ab" * 400, "\x00", "--"]


def test_odd_texts(spark):
    r = random.Random(5)
    texts = [None, "", " ", "   ", "\n", "a", " a", "a ", "a  ", "▁", "x▁y"] + ["".join(r.choice(WORDS) + r.choice(SPACES if k % 2 else [" ", " ", "\n", "  "]) for _ in range(60)) for k in range(60)]
    texts += [" ".join(r.choice(WORDS[:16]) for _ in range(40_000)), "y" * 20_000, "🙂" * 3000]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, n_a int").repartition(3)
    assert found(docs) == brute.cross_align([(i, t) for i, t, *_ in rows], A, B)
    assert found(docs.limit(0)) == {}
    again = spark.createDataFrame([(None, "the same text"), (None, "the same text"), (7, None)], "doc_id long, text string")
    assert sorted(map(tuple, alignment.cross_align(again, A, B).drop("groups").collect()), key=str) == [(7, 0, 0, 0, 0, 0, 0), (None, 3, 3, 3, 3, 3, 6), (None, 3, 3, 3, 3, 3, 6)]


@pytest.mark.parametrize("strips", (1, 3, 10_000))
def test_cuts_and_strips_change_nothing(strips):
    r = random.Random(strips)
    texts = ["".join(r.choice(WORDS) + r.choice(SPACES) for _ in range(30)) for _ in range(300)]
    pair = alignment.Pair(A, B)
    models = alignment.Tokenizers(pair.a_json, pair.b_proto)
    for text, units in zip(texts, [alignment.CUT.split(f" {t}") for t in texts]):
        whole, parts = models.encode([text]), models.encode([u[1:] for u in units])
        assert all(w[0] == sum(p, []) for w, p in zip(whole, parts))
    aligned = alignment.align_texts(pa.array(texts), models, strips)
    plain = alignment.align_texts(pa.array(texts), models, 256)
    assert all((x == y).all() for x, y in zip(aligned, plain))


@pytest.mark.parametrize("seed", range(5))
def test_group_ends(seed):
    """Runs of any length, groups of any shape, one strip or many."""
    r = np.random.default_rng(seed)
    a, b = (np.sort(r.choice(np.arange(1, 5000), n, replace=False)) for n in (2500, 3000 - 500 * seed))
    a, b = np.unique(np.append(a, 5000)), np.unique(np.append(b, 5000))
    common = np.intersect1d(a, b)
    cuts = np.sort(r.choice(common[:-1], 20 * seed, replace=False))
    strips = [np.concatenate([[0], np.searchsorted(x, cuts) + 1, [len(x)]]) for x in (a, b)]
    a_last, b_last = alignment.group_ends(a, b, *strips)
    assert (a_last == np.isin(a, common)).all() and (b_last == np.isin(b, common)).all()
