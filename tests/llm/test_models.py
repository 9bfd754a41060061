"""Classifiers and the language model on whole small tables, and on odd rows."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lightsieve.llm import lmscore, quality, textmodel, toxicity
from tests.llm.brute import WS_WORD
from tests.llm.test_contracts import SCHEMA, odd_rows


def auc(score, y):
    rank = pd.Series(score).rank().to_numpy()
    y = np.asarray(y, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    return read("documents").filter("doc_id < 5000").cache(), read("labels").cache()


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    return docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))


def test_toxicity_on_held_out_documents(tables):
    docs, labels = tables
    found = toxicity.score_toxicity(docs, labels)
    assert found.count() == docs.count() and found.filter("score not between 0 and 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    held = found.filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(held["score"], held["toxic"]) > 0.85


def test_nnpu_gradient_is_that_of_the_risk():
    r = np.random.default_rng(0)
    positive = r.random(40) < 0.4
    prior = 0.2

    def risk(s):
        rest = np.logaddexp(0, s[~positive]).mean() - prior * np.logaddexp(0, s[positive]).mean()
        return prior * np.logaddexp(0, -s[positive]).mean() + rest, rest

    s = r.normal(0, 1, 40)
    value, rest = risk(s)
    assert rest > 0
    numeric = np.array([(risk(s + 1e-6 * e)[0] - value) / 1e-6 for e in np.eye(40)])
    assert np.allclose(toxicity.nnpu_gradient(positive, prior)(s), numeric, atol=1e-4)

    # below zero the step goes against the part that fell too low, and the positive part is left out
    s = np.where(positive, 4.0, -3.0) + r.normal(0, 0.1, 40)
    assert risk(s)[1] < 0
    numeric = np.array([-(risk(s + 1e-6 * e)[1] - risk(s)[1]) / 1e-6 for e in np.eye(40)])
    assert np.allclose(toxicity.nnpu_gradient(positive, prior)(s), numeric, atol=1e-4)


def test_metadata_view_sees_no_text_and_counts_have_no_cap(spark):
    rows = spark.createDataFrame([(1, "a b", "en", "s", 900), (2, "X ### Y" * 50, "en", "s", 900), (3, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {r[0]: bytes(r[1]) for r in rows.select("doc_id", quality._meta_column("lang", "source", F.col("n_chars").cast("double"))).collect()}
    assert seen[1] == seen[2] != seen[3]
    scores = textmodel.WordScores(np.ones(textmodel.DIMENSIONS))
    few, many = (scores.of("a " * n) * n**0.25 for n in (5000, 50_000))
    assert many / few == pytest.approx(np.log1p(50_000) / np.log1p(5000))


def test_the_level_counts_all_rows_of_fold_1(tables, monkeypatch):
    """All rows of fold 1 are counted, and no level of a plain search over them is better by more than its error."""
    docs, labels = tables
    kept, finish = {}, toxicity._levelled
    monkeypatch.setattr(toxicity, "_levelled", lambda fitted, bins: kept.setdefault("out", (fitted, bins, finish(fitted, bins)))[2])
    toxicity.score_toxicity(docs, labels)
    (weights, offset), bins, (_, moved) = kept["out"]
    words = textmodel.WordScores(weights.astype(np.float32))
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    rows = docs.filter(textmodel.fold(F.col("doc_id")) == 1).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert bins["n"].sum() == len(rows) and bins["positive"].sum() == sum(r["doc_id"] in toxic for r in rows)
    score = np.array([offset + words.of(r["text"]) for r in rows])
    y = np.array([r["doc_id"] in toxic for r in rows])
    merit = lambda level: (y[score >= level].sum() / y.sum()) ** 2 / (((score >= level).sum() + 1) / len(y))
    best = max(merit(level) for level in score)
    recall = y[score >= max(score, key=merit)].sum() / y.sum()
    assert merit(offset - moved) > (1 - 3 * np.sqrt((1 - recall + 1 / y.sum()) / (recall * y.sum()))) * best


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    found = quality.score_quality(docs, labels)
    assert found.count() == docs.count()
    held = found.filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(held["score"], held["quality"]) > 0.95
    assert held.loc[held["quality"] == 1, "keep"].mean() > 0.95 and held.loc[held["quality"] == 0, "keep"].mean() < 0.2


def test_labels_of_the_held_out_fold_do_not_matter(tables):
    docs, labels = tables
    docs = docs.filter("doc_id < 1500")
    turned = labels.withColumns({c: F.when(textmodel.fold(F.col("doc_id")) == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
    for run in (toxicity.score_toxicity, quality.score_quality):
        a, b = (run(docs, x).select("doc_id", F.round("score", 9).alias("s")) for x in (labels, turned))
        assert a.exceptAll(b).isEmpty()


def test_odd_rows_and_missing_labels(spark, tables, odd):
    labels = tables[1]
    mine = spark.createDataFrame([(i, i % 2, i % 2) for i in range(28)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (toxicity.score_toxicity, quality.score_quality):
        for y in (mine, labels.limit(0), mine.filter("toxic = 0")):
            if run is quality.score_quality and y is not mine and not y.isEmpty():
                with pytest.raises(ValueError, match="both kinds"):  # one kind alone would keep everything
                    run(odd, y)
                continue
            found = run(odd, y)
            assert found.count() == odd.count() and found.filter("score is null or score not between 0 and 1 or held_out is null").count() == 0
        assert run(odd.limit(0), labels).count() == 0


def plain_features(text, form, prepare=str):
    """{place: value} by one loop over the words."""
    words, out = prepare(text).split(), {}
    for w, n in Counter(words).items():
        for place in textmodel.word_features(w, form):
            out[place] = out.get(place, 0.0) + np.log1p(n)
    return {p: v / len(words) ** 0.25 for p, v in out.items()}


def test_features_and_scores_against_plain_loops(spark, tables, odd, monkeypatch):
    """Sparse rows built on executors, and the scores of whole tables, equal word-by-word sums with the fitted weights."""
    docs, labels = tables
    docs = docs.filter("doc_id < 1200")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.filter("doc_id < 150").collect()}
    for form, prepare in ((True, str), (False, quality.content)):
        column = textmodel.sparse_features(F.coalesce("text", F.lit("")), form, prepare)
        for r in docs.filter("doc_id < 150").select("doc_id", column.alias("f")).collect():
            found = dict(zip(np.frombuffer(r["f"]["place"], np.int32).tolist(), np.frombuffer(r["f"]["value"], np.float32).tolist()))
            assert found == pytest.approx(plain_features(texts[r["doc_id"]], form, prepare), rel=1e-4)
    for module, run in ((toxicity, toxicity.score_toxicity), (quality, quality.score_quality)):
        kept, last = {}, "_levelled" if module is toxicity else "_calibrated"
        monkeypatch.setattr(module, last, lambda *a, finish=getattr(module, last), kept=kept: kept.setdefault("model", finish(*a)))
        scored = {r["doc_id"]: r for r in run(docs, labels).filter("doc_id < 150").collect()}
        model = kept["model"]
        meta = {r["doc_id"]: r for r in docs.filter("doc_id < 150").collect()}
        for i, text in texts.items():
            if module is toxicity:
                expected = textmodel.sigmoid(model[1] + sum(model[0][p] * v for p, v in plain_features(text, True).items()))
            else:
                m = meta[i]
                views = (model["offset"] + sum(model["words"][p] * v for p, v in plain_features(text, False, quality.content).items()), float(quality.meta_features(m["lang"], m["source"], m["n_chars"]) @ model["meta"]))
                logits = [a * v + b for (a, b), v in zip(model["scale"], views)]
                expected = textmodel.sigmoid(logits[0] * model["both"][0] + logits[1] * model["both"][1] + model["both"][2])
            assert scored[i]["score"] == pytest.approx(expected, abs=2e-3), (module.__name__, i)


def test_lm_scores(spark, tables, odd):
    docs = tables[0].filter("doc_id < 600")
    found = lmscore.score_documents(docs).toPandas().set_index("doc_id")
    assert len(found) == docs.count() and (found["log_prob"] < 0).all()
    strange = lmscore.score_documents(odd)
    assert strange.count() == odd.count() and strange.filter("n_words = 0 and (log_prob <> 0 or mean_log_prob is not null)").count() == 0
    assert lmscore.score_documents(odd.limit(0)).count() == 0


SHAPE = lmscore.Shape(1280, 32)


def test_lm_learns_both_sides():
    """Every second word is the successor of the one before; the network must use its neighbours."""
    r = np.random.default_rng(1)
    first = r.integers(0, 200, 30_000)
    codes = np.stack([first, (first * 7 + 1) % 200], axis=1).ravel().astype(np.int32)
    at = np.arange(1, len(codes), 2)
    context, target = lmscore.windows(codes, np.array([len(codes)]), SHAPE.pad)[:, at], codes[at]
    net = lmscore.Network(lmscore.new_network(SHAPE), SHAPE)
    squares, touched = np.full_like(net.table, 0.1), np.zeros(SHAPE.rows)
    before = lmscore.log_probability(net, context[:, -2000:], target[-2000:]).mean()
    for _ in range(6):
        for i in range(0, 28_000, 1024):
            lmscore.train_step(net, squares, touched, context[:, i : i + 1024], target[i : i + 1024], 0.3)
    after = lmscore.log_probability(net, context[:, -2000:], target[-2000:]).mean()
    assert before < -6 and after > -3


def test_lm_gradient():
    """A step moves every parameter as the numeric derivative of the summed loss says."""
    shape = lmscore.Shape(12, 4)
    r = np.random.default_rng(2)
    codes = r.integers(0, 12, 40).astype(np.int16)
    context = lmscore.windows(codes, np.array([25, 15]), shape.pad)
    net = lmscore.Network(lmscore.new_network(shape).astype(np.float64), shape)
    loss = lambda: -lmscore.log_probability(net, context, codes).sum()
    squares, numeric = np.full_like(net.table, 1e12), np.zeros_like(net.table)
    for i in range(net.table.shape[0]):
        for j in range(net.table.shape[1]):
            if i < shape.in_rows and j == lmscore.WIDTH:
                continue  # inputs have no bias
            for sign in (1, -1):
                net.table[i, j] += sign * 1e-2
                numeric[i, j] += sign * loss() / 2e-2
                net.table[i, j] -= sign * 1e-2
    before = net.table.copy()
    lmscore.train_step(net, squares, np.zeros(shape.rows), context, codes, 1e6)
    assert np.allclose((before - net.table) * 40**0.5, numeric, atol=2e-2)


def test_lm_probabilities_sum_to_one():
    net = lmscore.Network(lmscore.new_network(SHAPE), SHAPE)
    context = np.tile(np.array([[3], [7], [SHAPE.pad], [1200]]), (1, SHAPE.outcomes))
    assert np.exp(lmscore.log_probability(net, context, np.arange(SHAPE.outcomes))).sum() == pytest.approx(1, abs=1e-3)


def test_lm_words_are_ascii_space_separated(spark):
    texts = ["", " a\tb\x0bc\x0cd\r\ne ", "x\u00a0y\x1cz\x85w", "one", "   ", "\u3000p q"]
    import pyarrow as pa

    sizes, words = lmscore.split_words(pa.array(texts))
    expected = [WS_WORD.findall(t) for t in texts]
    assert sizes.tolist() == [len(e) for e in expected] and words.to_pylist() == sum(expected, [])


def test_lm_score_against_a_plain_loop(spark, odd, monkeypatch):
    """The network that Spark trained, applied word by word with probabilities written out."""
    kept = {}
    trained = lmscore.train
    monkeypatch.setattr(lmscore, "train", lambda coded, shape, *a, **k: kept.setdefault("net", (trained(coded, shape, *a, **k), shape))[0])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.unionByName(odd.select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"]))
    texts = {r["doc_id"]: WS_WORD.findall(r["text"] or "") for r in docs.collect()}
    found = {r["doc_id"]: r for r in lmscore.score_documents(docs, head_words=50, vocabulary=64).collect()}
    table, shape = kept["net"]
    counts = Counter(w for t in texts.values() for w in t)
    own = {w: i for i, w in enumerate(sorted((w for w in counts if len(w) <= lmscore.MOST_LETTERS), key=lambda w: (-counts[w], w.encode()))[: shape.outcomes - lmscore.RARE_CLASSES])}
    class_of = lambda w: zlib.crc32(w[:2].encode()) % lmscore.RARE_CLASSES
    totals = Counter()
    for w, n in counts.items():
        if w not in own:
            totals[class_of(w)] += n
    net = lmscore.Network(table.astype(float), shape)

    def log_softmax(z):
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    assert set(found) == set(texts)
    for i, text in list(texts.items()):
        codes = [own.get(w, len(own) + class_of(w) if len(own) == shape.outcomes - lmscore.RARE_CLASSES else shape.outcomes - lmscore.RARE_CLASSES + class_of(w)) for w in text]
        total = 0.0
        for at, w in enumerate(text[:400] if len(text) > 400 else text):
            h = np.tanh(sum(net.inputs[o][codes[at + d] if 0 <= at + d < len(codes) else shape.pad] for o, d in enumerate(lmscore.OFFSETS)))
            h = np.append(h, 1.0)
            group, member = divmod(codes[at], shape.members)
            total += log_softmax(net.groups @ h)[group] + log_softmax(net.members[group] @ h)[member]
            if w not in own:
                total += np.log(counts[w] / totals[class_of(w)])
        assert found[i]["n_words"] == len(text)
        if len(text) <= 400:
            assert found[i]["log_prob"] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_lm_training_reaches_the_ends_of_texts(spark):
    """Texts of one to three words, too, teach the network, and so do the last words of a text."""
    docs = spark.createDataFrame([(i, "a b c"[: 2 * (i % 3) + 1]) for i in range(30)], "doc_id long, text string")
    coded = lmscore.encode(docs, "doc_id", "text", spark.sparkContext.broadcast(lmscore.Coder({"a": 0, "b": 1, "c": 2}, {}, 1024)), np.int16)
    inputs, start = (lmscore.Network(t, SHAPE).inputs for t in (lmscore.train(coded, SHAPE, 2, np.int16), lmscore.new_network(SHAPE)))
    assert all((inputs[o][SHAPE.pad] != start[o][SHAPE.pad]).any() for o in range(len(lmscore.OFFSETS)))


def test_lm_rare_words_have_their_own_probability(spark):
    """The same network and contexts: a rare word scores by its count, whether its share is broadcast or joined."""
    frequent = " ".join(f"{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(SHAPE.outcomes - lmscore.RARE_CLASSES))
    rows = [(i, frequent) for i in range(12)] + [(100 + i, "zzmany") for i in range(9)] + [(200, "zzonce"), (None, "zzonce")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_limit = []
    for head_words in (1, 100):
        found = lmscore.score_documents(docs, head_words=head_words).toPandas()
        assert len(found) == len(rows)
        by_limit.append(found)
        score = found.set_index("doc_id")["log_prob"]
        assert score[100] - score[200] == pytest.approx(np.log(9 / 2), abs=1e-5)
        assert found[found["doc_id"].isna()]["log_prob"].iloc[0] == pytest.approx(score[200], abs=1e-9)
    a, b = (f.sort_values(["doc_id", "log_prob"])["log_prob"].to_numpy() for f in by_limit)
    assert np.allclose(a, b, atol=1e-5)


def test_lm_vocabulary_grows_with_the_corpus():
    shapes = [lmscore.shape_for(n) for n in (0, 10**6, 10**8, 4 * 10**9)]
    assert shapes[0] == shapes[1] and shapes[1].outcomes < shapes[2].outcomes < shapes[3].outcomes
    assert all(s.outcomes % s.members == 0 and s.outcomes - lmscore.RARE_CLASSES >= lmscore.VOCABULARY and 0.5 < s.groups / s.members < 2 for s in shapes)
