"""The relational selection and clustering against step-by-step versions on random inputs."""

import datetime
import random

from pyspark.sql import functions as F

from lightsieve.config import Selection
from lightsieve.operators import clustering, selection, similarity

VOCABULARY = ("kiss", "cake", "vows")
T0 = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)


def album(seed):
    r = random.Random(seed)
    t, rows = T0, []
    for i in range(r.randrange(1, 40)):
        t += datetime.timedelta(seconds=r.choice([30, 200, 700, 1500]))
        rows.append((i, f"album{seed}", t, float(r.randrange(10, 96)) if r.random() < 0.95 else None, r.random() < 0.8, [f"p{r.randrange(8)}" for _ in range(r.randrange(4))], r.sample(VOCABULARY, r.randrange(3))))
    return rows


def step_by_step(rows, s):
    photos = [dict(zip(("ord", "album", "ts", "score", "ok", "faces", "moments"), row)) for row in rows]
    for p in photos:
        p["score"] = 45.0 if p["score"] is None else p["score"]
    target = len(photos) * s.target_pct // 100
    chosen = {p["ord"]: "tier_1" for p in photos if p["ok"] and p["score"] >= s.tier_1}
    for p in photos:
        if p["ok"] and s.tier_2 <= p["score"] < s.tier_1 and len(chosen) < target:
            chosen[p["ord"]] = "tier_2"
    base = [p for p in photos if p["ord"] in chosen]
    best = lambda found: sorted(found, key=lambda p: (-p["score"], p["ord"]))
    order, total, seen = [], {}, {f for p in base for f in p["faces"]}
    for p in photos:
        for f in p["faces"]:
            total[f] = total.get(f, 0) + 1
            if f not in order:
                order.append(f)
    wanted = []
    for f in [f for f in order if total[f] >= s.least_appearances and f not in seen][: s.most_people]:
        wanted.append((best([p for p in photos if f in p["faces"]])[0], s.boost_person))
    for m in [m for m in s.moments if not any(m in p["moments"] for p in base)][: s.most_moments]:
        wanted += [(p, s.boost_moment) for p in best([p for p in photos if m in p["moments"]])[:1]]
    times = sorted(p["ts"] for p in base)
    for a, b in [(a, b) for a, b in zip(times, times[1:]) if (b - a).total_seconds() > s.gap_seconds][: s.most_gaps]:
        wanted += [(p, s.boost_gap) for p in best([p for p in photos if a < p["ts"] < b and p["ord"] not in chosen])[: s.per_gap]]
    for p, boost in wanted:
        if p["score"] + boost >= s.key_moment and p["ord"] not in chosen and len(chosen) < target:
            chosen[p["ord"]] = "coverage"
    for p in best([p for p in photos if p["ok"] and s.tier_3 <= p["score"] < s.tier_2]):
        if p["ord"] not in chosen and len(chosen) < target:
            chosen[p["ord"]] = "tier_3"
    shown = {p["faces"][0] for p in photos if len(p["faces"]) == 1 and p["ord"] in chosen}
    for p in photos:
        if len(p["faces"]) == 1 and p["score"] >= s.solo and p["ord"] not in chosen and p["faces"][0] not in shown:
            chosen[p["ord"]] = "coverage"
            shown.add(p["faces"][0])
    return {(photos[0]["album"], i): tier for i, tier in chosen.items()}


def test_selection(spark):
    albums = [album(seed) for seed in range(120)]
    schema = "ord long, album string, ts timestamp, score double, ok boolean, faces array<string>, moments array<string>"
    photos = spark.createDataFrame([row for rows in albums for row in rows], schema).cache()
    for pct in (30, 60):
        s = Selection(target_pct=pct, moments=VOCABULARY)
        expected = {}
        for rows in albums:
            expected |= step_by_step(rows, s)
        got = {(r["album"], r["ord"]): r["tier"] for r in selection.select_for_delivery(photos, s).collect()}
        assert got == expected


def test_leader_clusters(spark):
    nodes, edges, expected, number = [], [], {}, 0
    for block in range(60):
        r = random.Random(block)
        n = r.randrange(2, 25)
        near = {frozenset(p) for p in ((i, j) for i in range(n) for j in range(i)) if r.random() < r.choice([0.05, 0.2, 0.5])}
        leaders, groups = [], {}
        for i in range(n):
            leader = next((x for x in leaders if frozenset((x, i)) in near), None)
            if leader is None:
                leaders.append(i)
                leader = i
            groups.setdefault(leader, []).append(i)
        for leader, members in groups.items():
            if len(members) > 1:
                number += 1
                expected |= {f"{block}-{m}": (f"{block}-{leader}", number, len(members)) for m in members}
        nodes += [(f"{block}-{i}", 1000 * block + i) for i in range(n)]
        edges += [tuple(f"{block}-{x}" for x in p) for p in near]
    got = clustering.leader_clusters(spark.createDataFrame(nodes, "id string, rank int"), spark.createDataFrame(edges, "id_a string, id_b string"))
    assert {r["id"]: (r["leader"], r["group_id"], r["group_size"]) for r in got.collect()} == expected


def test_verified_groups(spark):
    """Leader clustering over the cosine inside (group, face count), as a loop over the members in rank order."""
    r, rows = random.Random(3), []
    for i in range(300):
        rows.append((i, r.randrange(25), r.choice([-1, 0, 1, 1, 2]), None if r.random() < 0.3 else [r.gauss(0, 1) for _ in range(3)]))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    expected = []
    for group in range(25):
        for count in (0, 1, 2):
            part = [x for x in rows if x[1] == group and x[2] == count]
            with_vector = [x for x in part if x[3]]
            if len(part) < 2:
                continue
            if count == 0 or len(with_vector) < 2:
                expected.append({x[0] for x in part})
                continue
            done = set()
            for a in with_vector:
                near = {b[0] for b in with_vector if b[0] != a[0] and b[0] not in done and cosine(a[3], b[3]) >= 0.8}
                if a[0] not in done and near:
                    expected.append({a[0]} | near)
                    done |= expected[-1]
    df = spark.createDataFrame(rows, "id long, group int, face_count int, vector array<double>")
    got = {}
    for x in clustering.verified_groups(df.select("id", "group", F.col("id").alias("rank"), "face_count"), df.select("id", "vector"), 0.8).collect():
        got.setdefault(x["verified_id"], set()).add(x["id"])
    assert sorted(got) == list(range(1, len(expected) + 1))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected))


def test_tiles_meet_once(spark):
    """Small tiles give the same pairs as one tile, and the brute force."""
    r = random.Random(5)
    rows = [(i, i % 2, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(120, None, [1.0] * 8), (121, 1, None), (122, 1, [0.0] * 8), (123, 1, [1.0])]
    df = spark.createDataFrame(rows, "id long, k int, vector array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    expected = {(a[0], b[0]) for a in rows[:120] for b in rows[:120] if a[0] < b[0] and a[1] == b[1] and dot(a[2], b[2]) >= 0.5 * (dot(a[2], a[2]) * dot(b[2], b[2])) ** 0.5}
    for tile_rows in (7, 4000):
        assert {(x["id_a"], x["id_b"]) for x in similarity.cosine_pairs(df, 0.5, ["k"], tile_rows).collect()} == expected


def test_containing_finds_short_items(spark):
    docs = [(1, "alpha beta gamma delta epsilon zeta"), (2, "x alphabet ab"), (3, ""), (4, None), (2, "x alphabet ab"), (5, "one  two three")]
    for items in (["beta gamma"], ["pha be"], ["alpha beta gamma delta epsilon"], ["ab"], ["a b", "e  t"], ["gamma delta epsilon"], ["ta gamma del"], [""], [None], []):
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i,) for i in items], "text string")
        expected = sorted(i for i, t in docs if t is not None and any(x in t for x in items if x is not None))
        assert sorted(x[0] for x in similarity.containing(d, b).select("doc_id").collect()) == expected, items
