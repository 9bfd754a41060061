"""Caches, merges, forests, repairs, filters and guarded batches against plain versions."""

import os
import random
from collections import OrderedDict, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lightsieve import delivery
from lightsieve.functions import recommend
from lightsieve.operators import audit, bloom, clustering, forest, lookup, merge, pairs, selection, similarity, tiles
from lightsieve.operators.metrics import StageStatistics
from lightsieve.config import Selection
from lightsieve.session import settings, shared_path
from lightsieve.streaming import batches, cache

EVENTS = "category string, ord long, item string, at long"


def cache_events(n, seed):
    r = random.Random(seed)
    rows, at = [], 0
    for k in range(n):
        at += r.randrange(5)
        rows.append((r.choice(["a", "a", "a", None]), k, r.choice([None, *"bcdefghijk"]), at))
    return rows


def plain_cache(rows, most, lifetime):
    held, out = defaultdict(OrderedDict), []
    for category, k, item, at in rows:
        recent = held[category]
        last = recent.pop(item, None)
        recent[item] = at
        gone = recent.popitem(last=False)[0] if len(recent) > most else "none"
        out.append((category, k, item, last is not None and (lifetime is None or at - last <= lifetime), None if gone == "none" else gone))
    return sorted(out, key=lambda x: x[1])


@pytest.mark.parametrize("most,lifetime", [(4, None), (7, 20)])
def test_cache_over_restarts(spark, most, lifetime):
    rows = cache_events(400, most)
    events = spark.createDataFrame(rows, EVENTS).repartition(3)
    found = cache.replay(events, 3, most=most, shards=1, lifetime=lifetime).orderBy("ord").collect()
    assert [tuple(r) for r in found] == plain_cache(rows, most, lifetime)
    assert cache.replay(events.limit(0), 3, most=4, shards=1).count() == 0


def test_cache_needs_room(spark, tmp_path):
    with pytest.raises(ValueError):
        cache.recently_seen(spark.readStream.schema(EVENTS).parquet(str(tmp_path)), most=2, shards=4)


def plain_merge(members, least, samples=3, ratio_min=0.7):
    groups = defaultdict(list)
    for group, ord_, h in members:
        groups[group].append((ord_, h))
    placed = {g: g for g in groups}
    while True:
        order = sorted(groups, key=lambda g: (-len(groups[g]), g))
        first = {g: [h for _, h in sorted(groups[g])[:samples]] for g in groups}

        def votes(a, b):
            n = [1 - ((x ^ y) & (2**64 - 1)).bit_count() / 64 >= least for x in first[a] for y in first[b]]
            return sum(n) / len(n) >= ratio_min

        earlier = {b: [a for a in order[:k] if votes(a, b)] for k, b in enumerate(order)}
        moves = {b: next((a for a in before if not earlier[a]), None) for b, before in earlier.items()}
        moves = {b: a for b, a in moves.items() if a is not None}
        if not moves:
            return {(g, placed[g], len(groups[placed[g]])) for g in placed}
        for b, a in moves.items():
            groups[a] += groups.pop(b)
        placed = {g: moves.get(p, p) for g, p in placed.items()}


@pytest.mark.parametrize("seed,least", [(0, 0.55), (1, 0.5), (2, 0.9)])
def test_groups_merge_until_no_vote_passes(spark, seed, least):
    r = random.Random(seed)
    members = [(r.randrange(40) ** 2 // 40, k, r.getrandbits(64) - 2**63) for k in range(150)]
    found = pairs.merge_groups(spark.createDataFrame(members, "group int, ord int, hash long"), least, tile_rows=7)
    assert {tuple(x) for x in found.collect()} == plain_merge(members, least)


def kruskal(edges):
    parent, out = {}, set()

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in sorted((-w, min(a, b), max(a, b)) for a, b, w in edges if a != b and w is not None):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            out.add((a, b, -w))
    return out


@pytest.mark.parametrize("nodes,n,weights", [(60, 300, 4), (200, 180, 1000), (5, 40, 1), (30, 0, 1)])
def test_forest_equals_kruskal(spark, nodes, n, weights):
    r = random.Random(n)
    edges = [(r.randrange(nodes), r.randrange(nodes), None if k % 17 == 0 else r.randrange(weights) / 8) for k in range(n)]
    found = forest.spanning_forest(spark.createDataFrame(edges, "id_a int, id_b int, weight double"))
    rows = {tuple(x) for x in found.select("id_a", "id_b", "weight").collect()}
    assert rows == kruskal(edges)
    for threshold in (0.25, 3):
        at = {x["node"]: x["component"] for x in forest.components_at(found, threshold).collect()}
        plain = kruskal([e for e in edges if e[2] is not None and e[2] >= threshold])
        assert len(at) - len(set(at.values())) == len(plain)
        assert all(at[a] == at[b] for a, b, _ in plain)


def test_a_long_chain_is_a_forest(spark):
    """Weights that rise along a path: every node hangs on the next one."""
    n = 3000
    edges = [(k, k + 1, float(k)) for k in range(n)]
    assert forest.spanning_forest(spark.createDataFrame(edges, "id_a int, id_b int, weight double")).count() == n


def test_merged_stages(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "path string, v int")
    twice = lambda r: r.filter("v < 3").unionByName(r.filter("v = 1").withColumn("v", F.lit(0))).select("path", "v")
    stages = {
        "one": twice,
        "two": lambda r: r.filter("v > 1").select("path", F.when(F.col("v") > 2, F.col("v")).alias("w"), merge.error_where(F.col("v") == 2, "too small").alias("error")),
        "three": lambda r: r.limit(0),
        "four": lambda r: r.select("nothing"),
        "five": lambda r: {}["missing"],
    }
    found = {r["path"]: r for r in merge.merge_stages(merge.run_stages(rows, stages)).collect()}
    assert set(found) == {"a", "b", "c", None}
    assert found["a"]["one"]["v"] == 0 and found["a"]["two"] is None and found["a"]["three"] is None
    assert found["b"]["errors"]["two"] == "too small" and found[None]["two"]["w"] == 4
    assert all(r["errors"]["four"].startswith("AnalysisException") and r["errors"]["five"].startswith("KeyError") for r in found.values())
    assert [found[p]["n_results"] for p in ("a", "b", "c", None)] == [1, 1, 1, 1]
    assert merge.merge_stages(merge.run_stages(rows, {"one": twice})).count() == 2
    assert merge.merge_stages(merge.run_stages(rows.limit(0), stages)).count() == 0


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_fix_in_place(spark, tmp_path):
    path = f"{tmp_path}/delivery"
    rows = [(f"dir/{i}.jpg", f"g{i % 20}" if i % 3 else None) for i in range(200)]
    delivery.write_delivery(spark.createDataFrame(rows, "path string, group_id string"), path, "group_id", parts=16)
    groups = spark.createDataFrame([r for r in rows if r[1] in ("g1", "g2")], "path string, group_id string")
    scores = spark.createDataFrame([("dir/41.jpg", 5.0), ("dir/101.jpg", 5.0)], "path string, score double")
    before = files(path)
    assert delivery.fix_in_place(spark, path, groups, scores, "path", "group_id", "score", dry_run=True)[1] == [] and files(path) == before
    n, parts = delivery.fix_in_place(spark, path, groups, scores, "path", "group_id", "score")
    in_group = {g: [p for p, x in rows if x == g] for g in ("g1", "g2")}
    assert n == sum(map(len, in_group.values())) - 2 and 1 <= len(parts) <= 2
    left = {r["path"] for r in delivery.read_delivery(spark, path).collect()}
    best = {min(in_group["g1"], key=lambda p: (p != "dir/101.jpg" and p != "dir/41.jpg", p)), min(in_group["g2"])}
    assert left == {p for p, g in rows if g not in ("g1", "g2")} | best
    after = files(path)
    touched = tuple(f"part={p}/" for p in parts)
    assert {f: t for f, t in before.items() if not any(x in f for x in touched)} == {f: t for f, t in after.items() if not any(x in f for x in touched)}
    assert delivery.fix_in_place(spark, path, groups, scores, "path", "group_id", "score") == (0, []) and files(path) == after
    gone = spark.createDataFrame([(p,) for p in left], "path string")
    assert delivery.remove_in_place(spark, path, gone, "path")[0] == len(left) and not files(path)


def test_statistics_without_another_scan(spark, tmp_path):
    path, out = f"{tmp_path}/rows", f"{tmp_path}/out"
    spark.range(1000).select((F.col("id") % 7).alias("v"), F.when(F.col("id") % 2 == 0, "x").alias("kind")).repartition(4).write.parquet(path)
    stages = {"size": (F.when(F.col("v") < 3, "small").otherwise("large"), ("small", "tiny")), "kind": (F.col("kind"), ("x",))}
    expected = {("size", "small"): 429, ("size", "other"): 571, ("kind", "x"): 500}
    seen = StageStatistics(stages)
    seen.watch(spark.read.parquet(path)).filter("v = 0").write.parquet(out)
    assert {(r["stage"], r["category"]): r["n"] for r in seen.table(spark).collect()} == expected
    assert spark.read.parquet(out).count() == 143
    streamed = StageStatistics(stages)
    stream = spark.readStream.schema("v long, kind string").option("maxFilesPerTrigger", 1).parquet(path)
    query = streamed.watch(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/streamed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    assert {(r["stage"], r["category"]): r["n"] for r in streamed.of_stream(query).collect()} == expected


def test_filtered_manifest(spark):
    """No known key passes as new; few new keys are taken for known, so nearly all new rows escape the shuffle."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 1000 != 0, F.concat(F.lit("photo "), "id")).alias("path"), "id")
    manifest = rows.filter("id % 3 = 0").select("path")
    plain = sorted(r["id"] for r in lookup.unprocessed(rows, manifest, "path").collect())
    found = bloom.unprocessed_filtered(rows, manifest, "path").collect()
    assert sorted(r["id"] for r in found) == plain
    assert sum(r["skipped"] for r in found) > 0.98 * len(found)
    blocks = bloom.blocks_for(20_000)
    table = bloom.build(manifest, "path", blocks)
    for most in (1 << 30, 0):  # broadcast, and joined by block
        asked = bloom.maybe_known(rows, "path", table, blocks, most)
        assert asked.filter("path is not null and id % 3 = 0 and not known").isEmpty()
        assert asked.filter("path is null and known").isEmpty() and asked.count() == 60_000
    assert bloom.unprocessed_filtered(rows, manifest.limit(0), "path").count() == 60_000


def test_recommendations_by_table_function(spark):
    r = random.Random(2)
    rows = []
    for k in range(600):
        faces = r.choice([None, [], [r.randrange(12)], [r.randrange(12), r.randrange(12)]])
        rows.append((k, f"album {r.randrange(4)}", r.randrange(40) * 120, r.choice([0.0, 10.0, 50.0, 90.0]), faces, r.choice([None, [], ["view"], ["click", "view"], ["error"]])))
    photos = spark.createDataFrame(rows, "ord long, album string, t long, score double, faces array<long>, moments array<string>").withColumn("ts", F.timestamp_seconds("t"))
    s = Selection(moments=("view", "click", "signup"), gap_seconds=300, most_gaps=4)
    for selected in (photos.filter("ord % 9 = 0"), photos.limit(0)):
        expected, found = (sorted(map(tuple, x.collect())) for x in (selection.recommendations(photos, selected, s), recommend.recommend(photos, selected, s)))
        assert found == expected and found
    assert recommend.recommend(photos.limit(0), photos, s).count() == 0


def test_failing_batches(spark, tmp_path):
    source = f"{tmp_path}/source"
    frame = spark.range(90).select("id", (F.col("id") % 30).alias("k"))
    for k in range(3):
        frame.filter(f"id div 30 = {k}").filter("id <> 0 or true").coalesce(1).write.mode("append").parquet(source)
    step = lambda rows: rows.select("id", F.expr("60 div (k - 7)").alias("v"))
    guarded = batches.Guarded(step, F.when((F.col("k") == 7) & (F.col("id") > 30), "k is 7"), f"{tmp_path}/a", attempts=2)
    stream = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(source)
    with pytest.raises(RuntimeError):  # id 7 is bad and its guard doesn't know
        guarded.run(stream)
    guarded = batches.Guarded(step, F.when(F.col("k") == 7, "k is 7"), f"{tmp_path}/b", attempts=2)
    assert not guarded.run_once(stream)
    assert guarded.run(stream) == 6  # the first batch fails once more, then two of each other batch, then the rest
    out, bad = guarded.out(spark, "id long, v long"), guarded.quarantine(spark, "id long, k long")
    assert sorted(r["id"] for r in out.collect()) == [i for i in range(90) if i % 30 != 7]
    assert sorted((r["id"], r["reason"], r["attempts"]) for r in bad.collect()) == [(7, "k is 7", 2), (37, "k is 7", 2), (67, "k is 7", 2)]
    spark.createDataFrame([(100, 1)], "id long, k long").write.mode("append").parquet(source)
    assert guarded.run(stream) == 1 and guarded.out(spark, "id long, v long").count() == 88


def test_best_of_paths_and_marked_files(spark):
    rows = spark.createDataFrame([("g", "b.jpg", 1.0), ("g", "a.jpg", 1.0), ("g", "c.jpg", None), ("h", "z.jpg", None)], "g string, path string, score double")
    assert {tuple(r) for r in clustering.best_of_group(rows, "g", "path", "score").collect()} == {("g", "a.jpg", 1.0, 3), ("h", "z.jpg", None, 1)}
    delivered = spark.createDataFrame([("x/BEST_a.jpg",), ("x/b.jpg",), ("x/BEST_c.jpg",), ("x/d.jpg",)], "path string")
    groups = spark.createDataFrame([("x/a.jpg", 1), ("x/b.jpg", 1), ("x/c.jpg", 2)], "path string, group_id long")
    found = audit.inspect(delivered, groups, spark.createDataFrame([("x/q.jpg", "blurry")], "path string, category string"), ["blurry"])
    assert {tuple(r) for r in found.collect()} == {("duplicates", "1", 2), ("orphans", "x/d.jpg", 1)}


def test_settings_are_put_back(spark):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    with settings(spark, {key: "dynamic", "spark.lightsieve.none": "1"}):
        assert spark.conf.get(key) == "dynamic"
    assert spark.conf.get(key) == before and spark.conf.get("spark.lightsieve.none", None) is None


def test_containment_in_long_words(spark):
    """A word of a million characters gives anchors in proportion to its length; items lie anywhere in it, and across spaces."""
    r = random.Random(7)
    long_word = "".join(r.choice("abcdefgh") for _ in range(1_000_000))
    texts = [long_word, "x " + long_word[:50_000] + " tail end", "ab", "", None, "abc abd", " lead", "trail ", "a  b"]
    items = [long_word[700_000:700_040], long_word[49_990:50_000] + " tail", "q" * 20, "bc", "d", " l", "l ", "  ", "a", long_word[4090:4101], long_word[4080:4200], "c abd", "x " + long_word[:7], "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for wanted in (items, items[:3], items[7:8], ["zz"], [""], []):
        found = similarity.containing(docs, spark.createDataFrame([(t,) for t in wanted], "text string"))
        assert sorted(x["id"] for x in found.collect()) == [i for i, t in enumerate(texts) if t is not None and any(w in t for w in wanted)]


def test_tiles_grow_with_a_key(spark):
    """Beyond TILES tiles of a key these grow up to their bound; each pair still meets once."""
    rows = spark.range(700).select("id", (F.col("id") * 0).cast("int").alias("k"))
    for small, most, tiles_of_key in ((4, 1 << 16, tiles.TILES), (4, 5, 140), (1000, 1 << 16, 1), (100, 1 << 16, 7)):
        assert [r["_tiles"] for r in tiles._with_tiles(rows, ["k"], small, most).select("_tiles").distinct().collect()] == [tiles_of_key]
    kernel = lambda left, right, same: pa.table([pa.array([left.num_rows * (left.num_rows - 1) // 2 if same else left.num_rows * right.num_rows])], names=["n"])
    found = tiles.self_pairs(rows, kernel, "n long", ["k"], 100).agg(F.sum("n"), F.count("*")).first()
    assert tuple(found) == (700 * 699 // 2, 28)


def test_commands_for_scans_and_repairs(spark, tmp_path, capsys, monkeypatch):
    from lightsieve import __main__ as command

    monkeypatch.setattr(command, "build_session", lambda: spark)
    for name in ("a.jpg", "b.JPG", "c.arw", "d.png", "e.txt"):
        (tmp_path / "photos").mkdir(exist_ok=True)
        (tmp_path / "photos" / name).write_bytes(b"x")
    paths = lambda names: spark.createDataFrame([(f"{tmp_path}/photos/{n}",) for n in names], "path string")
    paths(["a.jpg", "b.JPG", "c.arw"]).write.parquet(f"{tmp_path}/exclude")
    paths(["b.JPG"]).write.parquet(f"{tmp_path}/allow")
    for extra, wanted in (([], "abcd"), (["--exclude", f"{tmp_path}/exclude"], "d"), (["--exclude", f"{tmp_path}/exclude", "--allow", f"{tmp_path}/allow"], "bd")):
        assert command.main(["scan", f"{tmp_path}/photos", "--out", f"{tmp_path}/scanned", *extra]) == 0
        assert sorted(r["stem"] for r in spark.read.parquet(f"{tmp_path}/scanned").collect()) == list(wanted)
    rows = [("a", 1), ("b", 1), ("c", 2), ("d", None)]
    spark.createDataFrame(rows, "path string, group_id int").select("path").write.parquet(f"{tmp_path}/rows")
    spark.createDataFrame(rows[:3], "path string, group_id int").write.parquet(f"{tmp_path}/groups")
    spark.createDataFrame([("d", c) for c in ("best_quality", "duplicates", "closed_eyes", "blurry", "in_focus")], "path string, category string").write.parquet(f"{tmp_path}/categories")
    spark.createDataFrame([("b", 1.0)], "path string, score double").write.parquet(f"{tmp_path}/scores")
    assert command.main(["deliver", f"{tmp_path}/rows", f"{tmp_path}/groups", f"{tmp_path}/delivery"]) == 0
    audit_ = ["audit", f"{tmp_path}/delivery", f"{tmp_path}/groups", f"{tmp_path}/categories", f"{tmp_path}/fixed"]
    assert command.main([*audit_, "--in-place", "--scores", f"{tmp_path}/scores"]) == 1
    assert "removed 1 in 1 parts" in capsys.readouterr().out
    assert sorted(r["path"] for r in delivery.read_delivery(spark, f"{tmp_path}/delivery").collect()) == ["b", "c", "d"]
    assert command.main(audit_) == 0
