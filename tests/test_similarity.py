"""Similarity queries on small tables made for one case each."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lightsieve.operators import clustering, components, forest, leaders, similarity, tiles
from lightsieve.plans import registry
from lightsieve.session import settings


def embeddings(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def by_sql(path, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet/*.parquet')")
    return c.sql(registry.ORACLE_SQL[name]).df()


def same(spark, path, name):
    expected = by_sql(path, name)
    found = registry.QUERIES[name](spark, path).select(*expected.columns)
    rows = lambda values: sorted(map(repr, values))
    return rows(map(tuple, found.collect())) == rows(tuple(v.item() if hasattr(v, "item") else v for v in r) for r in expected.itertuples(index=False, name=None))


def test_records_keep_the_sign_of_a_score_that_rounds_to_zero(spark, tmp_path):
    r = random.Random(0)
    near = [r.gauss(0, 1) for _ in range(63)]
    path = embeddings(spark, tmp_path, [(k, [x, *near], 3) for k, x in enumerate((-0.00001, 0.00001, -0.00006, 2345.5, -1234.5))])
    found = registry.QUERIES["q71_group_records"](spark, path).collect()
    assert [r["scores"] for r in found] == ["0:-0.0000,1:0.0000,2:-0.0001,3:2345.5000,4:-1234.5000"]
    assert same(spark, path, "q71_group_records")


@pytest.mark.parametrize("name", ["q22_cosine_pairs", "q27_mutual_nearest"])
def test_tiles_of_one_key_are_spread_over_tasks(spark, tmp_path, name, monkeypatch):
    """Also when the key's counts are joined by a shuffle, which puts a key into one task."""
    r = random.Random(1)
    path = embeddings(spark, tmp_path, [(k, [r.gauss(0, 1) for _ in range(64)], k % 10) for k in range(400)])
    run, plans = tiles._run, []

    def watched(*args):
        out = run(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(tiles, "_run", watched)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert same(spark, path, name)
    exchange = plans[0].split("FlatMapGroupsInArrow", 1)[1].split("Exchange hashpartitioning(", 1)[1].split(")")[0]
    assert "_a#" in exchange and "_b#" in exchange


def test_leaders_without_pairs_equal_those_of_the_pairs(spark):
    """In blocks smaller than the table, with tiny tiles; null hashes and widths, equal hashes and rows alone."""
    r = random.Random(3)
    rows = [(k, r.randrange(200), None if k % 41 == 0 else r.getrandbits(64) - 2**63 if k % 9 else 77, None if k % 37 == 0 else r.choice([100, 150, 300])) for k in range(700)]
    hashes = spark.createDataFrame(rows, "id int, r int, hash long, width int").selectExpr("id", "struct(r, id) rank", "hash", "width")
    plain = clustering.leader_clusters(hashes.filter("hash is not null"), similarity.hash_pairs(hashes, 0.62))
    found = clustering.hash_clusters(hashes, 0.62, block_rows=50, tile_rows=60)
    columns = ("id", "leader", "group_id", "group_size")
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect()))
    vectors = spark.createDataFrame([(k, r.randrange(1000), r.randrange(3), [r.gauss(0, 1) for _ in range(4 if k % 7 else 3)]) for k in range(300)], "id int, r int, key int, vector array<float>").selectExpr("id", "struct(r, id) rank", "key", "vector")
    clusters = lambda found: {tuple(x) for x in found.select("id", "leader").collect()}
    expected = clusters(clustering.leader_clusters(vectors, similarity.cosine_pairs(vectors, 0.8, ["key"])))
    keyed = clusters(leaders.leaders(vectors, similarity.alike_vectors(0.8), ["key"], block_rows=20, tile_rows=30))
    assert {x for x in keyed if x in expected or x[0] != x[1]} == expected and len(keyed) == 300


def test_clusters_of_hash_groups_make_no_table_of_pairs(spark, tmp_path, monkeypatch):
    """Near rows are many: their pairs would be 40 times the rows."""
    r = random.Random(4)
    path = embeddings(spark, tmp_path, [(k, [r.gauss(1, 1) for _ in range(64)], k % 3) for k in range(400)])
    made = []
    pairs_of = similarity.hash_pairs
    monkeypatch.setattr(similarity, "hash_pairs", lambda *a, **k: made.append(1) or pairs_of(*a, **k))
    for name in ("q60_verified_groups", "q66_group_merge_votes", "q78_merged_groups"):
        assert same(spark, path, name)
    assert not made


@pytest.mark.parametrize("links", [0, 0.5, 1000])
def test_forest_of_hashes_equals_that_of_all_pairs(spark, links):
    """From no table of tight links (equal hashes are many), from a small one and from all."""
    r = random.Random(5)
    rows = [(k * 7 % 401, None if k % 50 == 0 else 12345 if k % 13 == 0 else r.getrandbits(64) - 2**63, None if k % 61 == 0 else r.choice([100, 150, 300])) for k in range(401)]
    hashes = spark.createDataFrame(rows, "id int, hash long, width int").withColumn("rank", F.col("id"))
    edges = lambda found: {tuple(x) for x in found.select("id_a", "id_b", "weight").collect()}
    expected = edges(forest.spanning_forest(similarity.hash_pairs(hashes, 0.66).withColumnRenamed("similarity", "weight")))
    found = forest.hash_forest(hashes, 0.66, links_a_row=links, tile_rows=90, far_tile_rows=130)
    assert expected and edges(found) == expected


@pytest.mark.parametrize("threshold, first_block_rows", [(0.62, 20), (0.66, 3), (0.70, 20), (0.80, 40), (0.66, 4096)])
def test_components_of_hashes_equal_those_of_all_pairs(spark, threshold, first_block_rows):
    """With and without a core; nulls, equal hashes, rows that repeat and rows alone."""
    r = random.Random(9)
    rows = [(k * 7 % 401, None if k % 50 == 0 else 12345 if k % 13 == 0 else r.getrandbits(64) - 2**63, None if k % 61 == 0 else r.choice([100, 150, 300])) for k in range(401)]
    hashes = spark.createDataFrame(rows + rows[:30] + [(None, 12345, 100)], "id int, hash long, width int").withColumn("rank", F.col("id"))
    placed = lambda found: sorted(map(tuple, found.select("node", "component").collect()))
    expected = placed(components.connected_components(similarity.hash_pairs(hashes, threshold), "id_a", "id_b"))
    assert expected and placed(forest.hash_components(hashes, threshold, first_block_rows=first_block_rows, tile_rows=90, far_tile_rows=130)) == expected
    assert not forest.hash_components(hashes.limit(0), threshold).count()


def test_components_of_hashes_compare_rows_once(spark, tmp_path, monkeypatch):
    """Copies make links many, so there is no tight table to begin with; rows must not meet all others in every round."""
    r = random.Random(10)
    copy = [r.gauss(0, 1) for _ in range(64)]
    n = 500
    path = embeddings(spark, tmp_path, [(k, copy if k % 5 == 0 else [r.gauss(0, 1) for _ in range(64)], 4) for k in range(n)])
    run, met = tiles._run, []

    def watched(dealt, *args):
        sides = dealt.groupBy("_a", "_b").agg(F.sum(1 - F.col("_side")).alias("l"), F.sum("_side").alias("r"))
        met.append(sides.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0)
        return run(dealt, *args)

    monkeypatch.setattr(tiles, "_run", watched)
    assert same(spark, path, "q53_components")
    assert 0 < sum(met) <= n * n


def test_forest_of_hashes_compares_rows_in_few_rounds(spark, monkeypatch):
    """Copies make links many, of several widths too; rows must not meet all others in every round of a forest."""
    r = random.Random(11)
    n = 500
    rows = [(k * 7 % n, 12345 if k % 5 == 0 else r.getrandbits(64) - 2**63, 400 + 60 * (k % 15)) for k in range(n)]
    hashes = spark.createDataFrame(rows, "id int, hash long, width int").withColumn("rank", F.col("id"))
    edges = lambda found: {tuple(x) for x in found.select("id_a", "id_b", "weight").collect()}
    expected = edges(forest.spanning_forest(similarity.hash_pairs(hashes, 0.64).withColumnRenamed("similarity", "weight")))
    run, met = tiles._run, []

    def watched(dealt, keys, kernel, schema, same_side):
        sides = dealt.groupBy("_a", "_b").agg(F.sum(1 - F.col("_side")).alias("l"), F.sum("_side").alias("r"))
        pairs = F.when(F.lit(same_side) & (F.col("_a") == F.col("_b")), F.col("l") * (F.col("l") - 1) / 2).otherwise(F.col("l") * F.col("r"))
        met.append(sides.agg(F.sum(pairs)).first()[0] or 0)
        return run(dealt, keys, kernel, schema, same_side)

    monkeypatch.setattr(tiles, "_run", watched)
    assert edges(forest.hash_forest(hashes, 0.64)) == expected
    assert 0 < sum(met) <= 2 * n * n
    assert not forest.hash_forest(hashes.limit(0), 0.64).count()


def test_group_similarity_multiplies_tiles(spark):
    """Groups of many parts, rows without vector or of another length, groups without members."""
    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 2, 3, 4, 5, 6]), None if k % 40 == 0 else [r.gauss(0, 1) for _ in range(4 if k % 9 else 3)]) for k in range(300)] + [(8, None), (9, [0.0] * 4)]
    members = spark.createDataFrame(rows, "g int, v array<float>")
    wanted = spark.createDataFrame([(1, 2), (2, 3), (1, 6), (4, 5), (1, 7), (3, 8), (6, 9)], "group_a int, group_b int")
    side = lambda s: members.select(F.col("g").alias(f"group_{s}"), F.col("v").alias(f"v{s}"))
    each = wanted.join(side("a"), "group_a", "left").join(side("b"), "group_b", "left")
    plain = each.groupBy("group_a", "group_b").agg(F.max(similarity.cosine(F.col("va"), F.col("vb"))).alias("s"))
    expected = {tuple(x)[:2]: x["s"] for x in plain.collect()}
    found = clustering.group_similarity(members, "g", "v", wanted, tile_rows=20)
    assert "cogroup" in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {tuple(x)[:2]: pytest.approx(x["similarity"]) for x in found.collect()} == expected


@pytest.mark.parametrize("most, tile_rows", [(6, 100), (6, 4000), (2, 50), (0, 50)])
def test_banded_pairs_equal_those_of_all_hashes(spark, monkeypatch, most, tile_rows):
    """Close hashes around a few, copies, a null; buckets of many tiles."""
    monkeypatch.setattr(similarity, "BUCKET_ROWS", 60)
    r = random.Random(7)
    centers = [r.getrandbits(64) for _ in range(8)]
    near = [r.choice(centers) ^ sum(1 << i for i in r.sample(range(64), r.randrange(7))) for _ in range(700)]
    values = [x - (1 << 64) if x >> 63 else x for x in near + [r.getrandbits(64) for _ in range(200)] + [0, 1, (1 << 64) - 1]]
    rows = spark.createDataFrame([(x,) for x in values + values[:50] + [None]], "hash long")
    found = [tuple(x) for x in similarity.banded_pairs(rows, most, tile_rows=tile_rows).collect()]
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    different = sorted(set(values))
    expected = [(a, b, apart(a, b)) for i, a in enumerate(different) for b in different[i + 1 :] if apart(a, b) <= most]
    assert sorted(found) == expected


def executed(plan):
    """The nodes of a plan that has run."""
    yield plan
    name = plan.nodeName()
    inside = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
    for child in inside + [plan.children().apply(i) for i in range(plan.children().size())]:
        yield from executed(child)


def test_banded_pairs_broadcast_no_rows(spark):
    """Rows dealt to bands are many times the hashes, which Spark does not see; they must not go through the driver."""
    r = random.Random(8)
    centers = [r.getrandbits(63) for _ in range(40)]
    hashes = spark.createDataFrame([(r.choice(centers) ^ 1 << r.randrange(63) ^ 1 << r.randrange(63),) for _ in range(2000)], "hash long").repartition(4)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "10m"}):
        found = similarity.banded_pairs(hashes, 6)
        assert len(found.collect()) > 2000
    sent = [n.metrics().apply("numOutputRows").value() for n in executed(found._jdf.queryExecution().executedPlan()) if n.nodeName() == "BroadcastExchange"]
    assert sum(sent) <= 2000
