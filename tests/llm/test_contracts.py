"""The queries against plain versions of their contracts, on whole small tables and on odd rows."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lightsieve.llm import decontam, exact, lmscore, mixing, pii, queries, simhash, substrings, textmodel, tokens
from lightsieve.operators.components import connected_components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, pre string, key long"


def long_text(words, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(words))


def odd_rows():
    passage = long_text(60, 1)
    texts = [
        None, "", " \t\n ", "A", "a b", "a b c", "A B c d", "x  y\x0b z\x0c", passage, passage, passage + " tail", "head " + passage,
        long_text(30_000, 2), long_text(34, 3), "te " * 200, "te " * 120 + "end", "Ünï çödé 文字 " * 20, "a b c ▁ d ▁▁e", "  lead  and trail  ",
        "mail a.b@c.de_f@g.hi and 1.2.3.4.5.6.7.8 or 300.1.1.1, 0001.02.3.004", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111-1",
        "call +1 (017) 555-7713, +49.30.123456 +12 +1234567890123456 𝔘 a@b.c", "@" * 50 + "a" * 3000 + "@x", "1.2." * 300, long_text(200, 4) + " " + passage + " " + long_text(200, 5),
        "a.b-c@d-e.f.g.h. x%y+z@q.r@s.t", "\x00\x01 nul", "token <s> </s> <unk> <0x0A>",
    ]
    return [(i, t, "en" if i % 3 else None, [None, "s1", "s2", ""][i % 4], None, "clash", "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def both(spark, odd, sf_mid):
    """Two inputs with their rows: the generated table, and the odd rows."""
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    items = spark.read.parquet(f"{sf_mid}/benchmark.parquet")
    pairs = lambda df, a, b: [(r[0], r[1]) for r in df.select(a, b).collect()]
    odd_items = spark.createDataFrame([(1, long_text(60, 1)), (2, "A!b"), (3, None), (10, "..."), (None, "a b"), (4, long_text(13, 9))], "item_id long, text string")
    return [(docs, pairs(docs, "doc_id", "text"), items, pairs(items, "item_id", "text")), (odd, pairs(odd, "doc_id", "text"), odd_items, [(1, long_text(60, 1)), (2, "A!b"), ("", "a b"), (4, long_text(13, 9))])]


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.select("doc_id", *cols).collect()}


def test_pii_base(both):
    for docs, rows, _, _ in both:
        found = pii.find_personal_data(docs).select("doc_id", pii.span_text(F.col("base")).alias("base"))
        assert by_id(found, "base") == {i: (",".join(":".join(map(str, s)) for s in brute.pii(t)),) for i, t in rows}


def test_pii_learns_a_context(spark):
    rows = [(i, f"please write to mail address user{i}@host{i}.org soon") for i in range(40)]
    rows += [(100 + i, f"please write to mail address user{i} (at) host, or mail address u{i}#corp.org soon") for i in range(3)]
    rows += [(200 + i, f"the total was {i}77 in all and {i}x more") for i in range(40)]
    found = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(3):
        text = rows[40 + i][1]
        assert [(text[s["start"] : s["end"]], s["kind"]) for s in found[100 + i]["found"]] == [(f"user{i}", 0), (f"u{i}#corp.org", 0)]
    assert not any(found[i]["found"] for i in found if not 100 <= i < 200)
    assert all(len(found[i]["base"]) == 1 for i in range(40))


def test_pii_finds_keys_in_other_writing(spark):
    """Printed keys are seeds; what stands in their place, they themselves too, is found by the learned pattern alone."""
    r = random.Random(4)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'w{r.random()} and so token = "{key()}" it goes') for i in range(30)] + [(100, 'AND SO TOKEN = "AF90-77" it goes'), (101, "the year 2024 was long"), (102, f"alone {key()} here"), (103, "token: 'ZX-12/9'"), (104, f"{'w' * 90}token = 77q")]
    found = {x["doc_id"]: [(s["value"], pii.KINDS[s["kind"]]) for s in x["found"]] for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == [("AF90-77", "secret")] and found[101] == found[102] == found[104] == [] and found[103] == [("ZX-12/9", "secret")] and all(len(found[i]) == 1 and found[i][0][1] == "secret" for i in range(30))


def test_pii_discovers_keys_that_are_no_seeds(spark, sf_mid, monkeypatch):
    """With half of the keys as seeds the learned pattern finds the other half, and nothing else."""
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    monkeypatch.setitem(pii.PATTERNS, "secret", r"(?<![0-9A-Za-z])(?=[0-7])(?=[0-9]*+[a-f])[0-9a-f]{32,}+(?![0-9A-Za-z])")
    found = [s["value"] for r in pii.find_personal_data(docs, smoothing=1.0).collect() for s in r["found"]]
    keys = [k for r in docs.select("text").collect() for k in re.findall(r'token = "([^"]*)"', r["text"] or "")]
    assert sorted(found) == sorted(keys) and any(k[0] > "7" for k in keys)


def test_pii_of_one_long_table(spark):
    """100,000 numbers and mail addresses in one text: running sums, no copies of what was found before."""
    text = " ".join(f"{i} m{i}@h.org" for i in range(50_000))
    found = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [(s["start"], s["end"]) for s in found["base"]][:2] == [(2, 10), (13, 21)] and len(found["base"]) == 50_000
    assert all(text[s["start"] : s["end"]] == s["value"] for s in found["base"])


def test_simhash(both):
    for docs, rows, _, _ in both:
        assert by_id(simhash.near_duplicates(docs), "fingerprint", "component_id") == brute.near_components(rows)


def test_simhash_links_every_pair_within_the_radius(spark):
    r = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = set()
    for _ in range(60):
        x = r.getrandbits(64)
        values.add(x)
        for _ in range(8):
            y = x
            for b in r.sample(range(64), r.randrange(1, 5)):
                y ^= 1 << b
            values.add(y)
    values = sorted(values)
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"))
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    ids = [(v, "") for v in values]
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    for a, _ in ids:
        for b, _ in ids:
            assert (root(a) == root(b)) == (got.get(signed(a), signed(a)) == got.get(signed(b), signed(b)))


def test_exact(both):
    for docs, rows, _, _ in both:
        assert by_id(exact.deduplicate(docs), "keep_id", "group_size", "kept", "text_sha256") == brute.deduplicate(rows)


def test_exact_over_many_batches_and_with_colliding_digests(both):
    for docs, rows, _, _ in both:
        weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
        found = exact.deduplicate(docs.repartition(6), digest=weak, bytes_per_trigger=1)
        assert by_id(found, "keep_id", "group_size", "kept", "text_sha256") == brute.deduplicate(rows)


def test_decontamination(both):
    for docs, rows, items, item_rows in both:
        expected = brute.decontaminate(rows, item_rows)
        for index in (decontam.build_index(docs), decontam.build_index(docs, segment_tokens=500)):
            found = decontam.search(index, items)
            assert {r["doc_id"]: (r["n_words"], len(r["items"])) for r in found.collect()} == {i: (e[0], e[2]) for i, e in expected.items()}
        found = decontam.decontaminate(docs, items).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
        assert by_id(found, "n_words", "n_hit", "n_items", "sha", "contaminated") == expected


def test_decontamination_in_blocks_and_near(spark, both):
    docs, rows, items, item_rows = both[0]
    index = decontam.build_index(docs)
    one, many = ({r["doc_id"]: (r["items"], [tuple(s) for s in r["near"]]) for r in decontam.search(index, items, block_chars=n).collect()} for n in (1 << 30, 1000))
    assert one == many
    phrase = "alpha beta gamma delta epsilon"
    found = decontam.decontaminate(spark.createDataFrame([(1, "gamma x alpha y beta epsilon z delta"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, phrase)], "doc_id long, text string"), spark.createDataFrame([(7, phrase)], "item_id long, text string"))
    assert {r["doc_id"]: (r["near_items"], r["items"]) for r in found.collect()} == {1: (["7"], []), 2: ([], []), 3: (["7"], ["7"])}


def test_decontamination_near_against_brute_force(spark):
    """Phrases with words changed, moved and spread, beside documents that make any of their words rare or frequent."""
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice((1, 3, 9, 13, 20, 31))))) for i in range(30)]
    docs = []
    for i in range(300):
        words = r.choice(items)[1].split()
        words = [r.choice(vocabulary + ["other"] * 20) if r.random() < r.choice((0.0, 0.1, 0.3)) else w for w in words]
        for _ in range(r.randrange(12)):
            words.insert(r.randrange(len(words) + 1), "between")
        if r.random() < 0.5:
            r.shuffle(words)
        docs.append((i, " ".join(["w"] * r.randrange(30) + words)))
    expected = {i: sorted(brute.near_items(t, items)) for i, t in docs}
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (50, 100_000):
        found = decontam.search(decontam.build_index(frame, segment_tokens=size), tests)
        assert {x["doc_id"]: x["near"] for x in found.collect()} == expected
    assert sum(map(bool, expected.values())) > 100


def test_decontamination_near_does_not_depend_on_other_texts(spark):
    """Ten of thirteen words are left of a phrase, and another document makes those that were changed the rarest."""
    words = [f"w{i}" for i in range(13)]
    changed = " ".join("x" if i in (2, 6, 9) else w for i, w in enumerate(words))
    items = spark.createDataFrame([("it", " ".join(words))], "item_id string, text string")
    for others in ([], ["w2 w6 w9"], [" ".join(w for i, w in enumerate(words) if i not in (2, 6, 9))] * 5 + ["w2 w6 w9"]):
        docs = spark.createDataFrame([(0, changed), *((k + 1, t) for k, t in enumerate(others))], "doc_id long, text string")
        found = {r["doc_id"]: r["near"] for r in decontam.search(decontam.build_index(docs), items).collect()}
        assert found[0] == ["it"]


def test_decontamination_near_does_not_depend_on_segments(spark):
    """A changed word that occurs nowhere else is no veto, nor is where the segments are cut; string ids stay strings."""
    words = long_text(40, 8).split()
    changed = " ".join("unseen" if i % 13 == 5 else w for i, w in enumerate(words))
    docs = spark.createDataFrame([("a", changed), ("b", long_text(40, 9)), (None, " ".join(words)), ("c", None)], "doc_id string, text string").coalesce(1)
    items = spark.createDataFrame([("it", " ".join(words))], "item_id string, text string")
    for size in (10, 1000):
        found = {r["doc_id"]: (r["items"], r["near"]) for r in decontam.search(decontam.build_index(docs, segment_tokens=size), items).collect()}
        assert found == {"a": ([], ["it"]), "b": ([], []), None: (["it"], ["it"]), "c": ([], [])}


def test_tokens(both):
    import sentencepiece

    path = queries.tokenizer_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs, rows, _, _ in both:
        for head in (400_000, 20):
            found = by_id(tokens.count_tokens(docs, path, head_rows=head), "n_bytes", "n_tokens", "over_limit")
            assert found == {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows}


def test_pieces_of_a_batch_are_whole(both):
    """Slices of a batch, cut anywhere, give the words and pre-tokens of their texts."""
    for _, rows, _, _ in both:
        column = pa.array([t or "" for _, t in rows], pa.string())
        for most in (1, 3000, 1 << 20):
            words, pre, n = [], [], 0
            for part in textmodel.pieces(column, most):
                assert part.start == n and part.stop > n
                n = part.stop
                sizes, found = lmscore.split_words(column[part])
                assert len(sizes) == part.stop - part.start
                words += found.to_pylist()
                doc, found = tokens.pre_tokens(column[part])
                pre += sorted(zip((doc + part.start).tolist(), found.to_pylist()))
            assert n == len(column) and words == [w for t in column.to_pylist() for w in brute.WS_WORD.findall(t)]
            assert sorted(pre) == sorted((i, p[1:]) for i, t in enumerate(column.to_pylist()) if t for p in tokens.PRE_TOKEN.findall(" " + t))


def test_substrings(both):
    for docs, rows, _, _ in both:
        assert by_id(substrings.remove_repeats(docs), "n_words", "n_removed", "kept_sha256") == brute.remove_repeats(rows)


def test_substrings_at_every_overlap(spark):
    """Passages of lengths around the window in varying surroundings, so that chains branch everywhere."""
    r = random.Random(5)
    passages = [[f"p{k}x{r.randrange(40)}" for _ in range(n)] for k, n in enumerate((34, 35, 36, 50, 80, 120))]
    rows = []
    for i in range(60):
        words = []
        for _ in range(4):
            p = r.choice(passages)
            cut = r.randrange(0, 12)
            words += [f"u{r.randrange(9999)}" for _ in range(r.randrange(0, 6))] + p[cut : len(p) - r.randrange(0, 12)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert by_id(substrings.remove_repeats(docs), "n_words", "n_removed", "kept_sha256") == brute.remove_repeats(rows)


def test_mixing(both):
    for docs, rows, _, _ in both:
        sizes = {i: len(brute.WS_WORD.findall(t or "")) for i, t in rows}
        source = dict(docs.select("doc_id", "source").collect())
        totals = {}
        for i, s in source.items():
            totals[s] = totals.get(s, 0) + sizes[i]
        targets = brute.mix_targets(totals)
        found = mixing.mix(docs, rows_per_block=7).collect()
        again = mixing.mix(docs.repartition(5)).collect()
        assert sorted(map(str, found)) == sorted(map(str, again))
        taken = {}
        for r in found:
            assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == totals[r["source"]] and r["source"] == source[r["doc_id"]]
            assert r["target"] == pytest.approx(targets[r["source"]]) and r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        for s, t in targets.items():
            assert abs(taken[s] - t) <= max(sizes[i] for i in sizes if source[i] == s) * 1.5 + 1


def test_repeated_rows_and_empty_tables(spark, odd):
    twice = odd.filter("doc_id < 12").unionByName(odd.filter("doc_id < 12")).unionByName(odd.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    empty = odd.filter("doc_id < 0")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    path = queries.tokenizer_path()
    runs = {
        "pii": pii.find_personal_data, "simhash": simhash.near_duplicates, "exact": exact.deduplicate, "mix": mixing.mix, "substrings": substrings.remove_repeats,
        "tokens": lambda d: tokens.count_tokens(d, path), "decontam": lambda d: decontam.decontaminate(d, items),
    }
    for name, run in runs.items():
        assert run(twice).count() == 26, name
        assert run(empty).count() == 0, name
    assert decontam.decontaminate(odd, items.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    assert all(r["n_removed"] == r["n_words"] for r in substrings.remove_repeats(twice.filter("doc_id = 8")).collect())


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
