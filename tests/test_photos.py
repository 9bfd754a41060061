"""Kernels, scans, rules, reports, streams, scorers and the command line on generated files."""

import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightsieve import __main__, config, sinks
from lightsieve.config import Rules
from lightsieve.functions import kernels
from lightsieve.operators import audit, rules, scoring
from lightsieve.sources import photos, reports
from lightsieve.streaming import photos as streaming


def png(pixels):
    pixels = np.atleast_3d(pixels).astype(np.uint8)
    h, w, c = pixels.shape
    rgb = np.repeat(pixels, 3, axis=2) if c == 1 else pixels
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    rows = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def board(h, w, cell):
    y, x = np.mgrid[:h, :w]
    return ((y // cell + x // cell) % 2 * 255).astype(float)


def box_blur(g, radius):
    out = g
    for axis in (0, 1):
        out = sum(np.roll(out, k, axis) for k in range(-radius, radius + 1)) / (2 * radius + 1)
    return out


def test_blur_kernels():
    flat = np.full((300, 300), 128.0)
    assert kernels.laplacian_variance(flat) == 0 and kernels.fft_score(flat) < 0
    assert kernels.fft_score(np.zeros((300, 300))) == -1000.0
    combined = lambda g: kernels.combined_blur(kernels.laplacian_variance(g), kernels.fft_score(g))
    assert [combined(board(300, 400, c)) for c in (1, 2, 4, 16)] == [100.0] * 4
    soft = [combined(box_blur(board(300, 400, 16), r)) for r in (3, 8, 20)]
    assert soft[0] > soft[1] > soft[2] and soft[1] < 40
    assert np.isfinite(kernels.fft_score(board(100, 150, 4)))
    assert kernels.focus_score(flat) == 50 and kernels.focus_score(flat, low=0) < 1


def test_other_kernels():
    g = np.full((100, 100), 100.0)
    g.ravel()[:3500] = 255
    assert kernels.overexposed(g) == 0.35 and kernels.exposure(np.full((4, 4), 127.5)) == 1
    assert kernels.contrast(np.zeros((9, 9))) == 0 and kernels.noise(np.full((50, 50), 7.0)) == 1
    r = np.random.default_rng(0)
    base = kernels.area_resize(r.uniform(0, 250, (20, 30)), 200, 300)
    shifted = np.clip(base + 1, 0, 255)
    for f in (kernels.phash, kernels.dhash, kernels.ahash, kernels.whash):
        assert (f(base) ^ f(shifted)).bit_count() <= 9
    assert kernels.thumbnail_size(1200, 800) == (512, 341) and kernels.thumbnail_size(200, 133) == (200, 133)
    assert kernels.area_resize(np.arange(12.0).reshape(3, 4), 1, 1)[0, 0] == pytest.approx(5.5)


def test_white_and_edges():
    pixels = np.zeros((40, 40, 3))
    pixels[:10] = 200  # white
    pixels[10:20] = (40, 60, 220)  # bright, but red
    assert kernels.white_share(pixels) == 25
    step = np.zeros((20, 20))
    step[:, 10:] = 100
    found = kernels.edges(step)
    assert found.any(axis=1).all() and (found.sum(axis=1) == 1).all()  # one pixel wide
    faint = np.zeros((20, 20))
    faint[:, 10:] = 20  # between the two levels: alone no edge, together with a strong part one
    assert not kernels.edges(faint).any()
    faint[:5, 10:] = 100
    assert kernels.edges(faint)[8:, 8:12].any(axis=1).all() and kernels.edge_share(np.zeros((5, 5))) == 0


def test_scan_and_features(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "one.PNG").write_bytes(png(board(64, 80, 8)))
    (tmp_path / "a/b/one.png").write_bytes(png(np.full((40, 40), 250)))
    (tmp_path / "a/bad.png").write_bytes(b"no image")
    (tmp_path / "a/note.txt").write_text("x")
    (tmp_path / "a/raw.ARW").write_bytes(b"raw")
    files = photos.scan(spark, str(tmp_path))
    assert sorted((r["basename"], r["ext"], r["status"]) for r in photos.route(files).collect()) == [("bad.png", "png", "standard"), ("one.PNG", "png", "standard"), ("one.png", "png", "standard"), ("raw.ARW", "arw", "raw")]
    assert photos.has_raw(files) and photos.scan(spark, str(tmp_path), recursive=False).count() == 1
    decoded = photos.images(spark, str(tmp_path))
    assert [r["basename"] for r in photos.undecodable(files, decoded).filter("ext = 'png'").collect()] == ["bad.png"]
    found = {r["path"].rsplit("/", 1)[1]: r for r in kernels.features(decoded).collect()}
    assert found["one.png"]["overexposed"] == 1 and found["one.PNG"]["combined"] > found["one.png"]["combined"]
    assert kernels.features(decoded.withColumn("data", F.lit(None).cast("binary"))).filter("laplacian is not null").count() == 0


def test_blur_rules_agree(spark):
    grid = list(itertools.product(("BLURRY", "CLEAR", "ERROR", None), range(0, 105, 5), range(-20, 101, 4)))
    df = spark.createDataFrame(grid, "s string, c int, b int")
    for threshold in (20, 25):
        r = Rules(blur_threshold=threshold)
        a, b = (f(F.col("s"), F.col("c"), F.col("b"), r) for f in (rules.blur_rule, rules.blur_rule_full))
        assert df.filter(F.coalesce(a, F.lit(False)) != b).count() == 0


def test_replies_and_scorers(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")

    def ask(path):
        if path == "b":
            raise TimeoutError("late")
        return "in_focus | 0.9 | sharp"

    found = {r["path"]: tuple(r)[1:] for r in scoring.verdicts(rows, scoring.function_scorer(ask, per_minute=1e6, retries=2, first_delay=0.01)).collect()}
    assert found["a"] == ("IN_FOCUS", 90.0, "sharp") and found["b"] == ("ERROR", 0.0, "TimeoutError: late")
    replies = spark.createDataFrame([("a", "BLURRY|95|soft"), ("b", "x|y"), ("c", "CLEAR|abc|d")], "path string, reply string")
    assert {r["path"]: (r["status"], r["confidence"]) for r in scoring.verdicts(rows, scoring.table_scorer(replies)).collect()} == {"a": ("BLURRY", 95.0), "b": ("ERROR", 0.0), "c": ("CLEAR", 0.0)}


def test_reports_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("/x/a.png", "blurry", 1.0), ("/x/b.png", "in_focus", 2.0), ("/y/a.png", "blurry", 3.0)], "path string, category string, score double")
    sinks.write_categories(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("category = 'blurry'").count() == 2
    sinks.write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/rows")).count() == 3
    back = reports.read_reports(spark, str(tmp_path / "r/rows"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert reports.manifest(back, rows).count() == 3
    raw = spark.createDataFrame([("/x/c.NEF", "blurry", None)], "path string, category string, score double")
    assert {tuple(r) for r in reports.names(raw.unionByName(rows.limit(1))).collect()} == {("blurry", "c.NEF"), ("blurry", "c.png"), ("blurry", "a.png")}
    tree = reports.delivered_groups(spark.createDataFrame([("/o/duplicates/group_2/BEST_a.jpg",), ("/o/duplicates/group_2/b.jpg",), ("/o/other/c.jpg",)], "path string"))
    assert sorted(map(tuple, tree.select("group_id", "name", "is_best").collect())) == [("group_2", "a.jpg", True), ("group_2", "b.jpg", False)]
    sinks.write_groups(spark.createDataFrame([("a", 1, "a"), ("b", 1, "a")], "path string, group_id int, best string"), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).filter("is_best and path = 'a' and group_id = 1").count() == 1
    names = spark.createDataFrame([("group_3",), ("group_12",), ("other",)], "group string")
    assert reports.last_group_number(names).first()[0] == 12 and reports.last_group_number(names.limit(0)).first()[0] == 0


def test_audit_after_fix(spark):
    delivered = spark.createDataFrame([(i,) for i in range(10)], "path long")
    groups = spark.createDataFrame([(0, "g1"), (1, "g1"), (2, "g1"), (5, "g2"), (77, "g2")], "path long, group_id string")
    scores = spark.createDataFrame([(0, 5.0), (1, 9.0), (2, 9.0)], "path long, score double")
    leaks = audit.duplicate_leaks(delivered, groups, "path", "group_id")
    assert audit.status(leaks) == (1, "FAIL")
    fixed = audit.fix(delivered, audit.to_remove(delivered, groups, scores, "path", "group_id", "score"), "path")
    assert sorted(r[0] for r in fixed.collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert audit.status(audit.duplicate_leaks(fixed, groups, "path", "group_id")) == (0, "PASS")


def test_stream_resumes_and_deduplicates(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("path"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), (F.col("id") % 3).alias("value"))
    rows.filter("path < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: streaming.once(streaming.stream_table(spark, str(tmp_path / "in"), 1), "path")
    assert streaming.run_available(stream(), "once", checkpoint=str(tmp_path / "c")).count() == 20
    rows.filter("path >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert streaming.run_available(stream(), "once", checkpoint=str(tmp_path / "c")).count() == 40
    seen = []
    streaming.for_each_batch(streaming.stream_table(spark, str(tmp_path / "in"), 100), lambda batch, n: seen.append(batch.count()), str(tmp_path / "d"))
    assert sum(seen) == 45


def test_command_line(spark, tmp_path, sf_small, capsys):
    spark.createDataFrame([("a",), ("b",)], "path string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([("a", "g"), ("b", "g")], "path string, group_id string").write.parquet(str(tmp_path / "g"))
    spark.createDataFrame([("a", "blurry")], "path string, category string").write.parquet(str(tmp_path / "c"))
    run = ["audit", str(tmp_path / "d"), str(tmp_path / "g"), str(tmp_path / "c"), str(tmp_path / "fixed")]
    assert __main__.main([*run, "--dry-run"]) == 1 and not (tmp_path / "fixed").exists()
    assert "FAIL: 5 violations" in capsys.readouterr().out  # one leak, four missing categories
    assert __main__.main([*run, "--fix", "--json", str(tmp_path / "j")]) == 1
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "fixed")).collect()] == ["a"] and spark.read.json(str(tmp_path / "j")).count() == 5
    (tmp_path / "config.json").write_text('{"selection": {"target_pct": 20, "tier_2_by_score": true}, "rules": {"blur_confidence": 80}}')
    chosen, rules = config.load(spark, str(tmp_path / "config.json"))
    assert (chosen.target_pct, chosen.tier_2_by_score, chosen.tier_1, rules.blur_confidence) == (20, True, 80, 80)
    (tmp_path / "bad.json").write_text('{"selection": {"target": 20}}')
    with pytest.raises(ValueError, match="target"):
        config.load(spark, str(tmp_path / "bad.json"))
    assert __main__.main(["select", f"{sf_small}/events.parquet", str(tmp_path / "s"), "--pct", "30"]) == 0
    assert spark.read.parquet(str(tmp_path / "s")).count() > 0


def test_greedy_face_matches(spark):
    from lightsieve.operators import pairs

    rows = [([1.0, 2.0], [2.1, 1.1]), ([1.0, 1.0], [1.0]), ([5.0], [1.0, 2.0]), ([], [1.0]), ([1.0, 1.2], [1.15, 0.9])]

    def by_hand(left, right):
        used = set()
        for v in left:
            free = [(1 - abs(v - w), -j) for j, w in enumerate(right) if j not in used]
            if free and max(free)[0] >= 0.7:
                used.add(-max(free)[1])
        return len(used)

    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.coalesce(1).select(pairs.greedy_matches(F.col("a"), F.col("b"), lambda x, y: 1 - F.abs(x - y))).collect()]
    assert sorted(got) == sorted(by_hand(*r) for r in rows)


def test_stream_counts_every_row_of_many_files(spark, tmp_path):
    """30 files, the latest events first: more than one micro-batch, and most rows are far behind the largest event time."""
    import os
    import time

    from lightsieve.plans.queries import QUERIES

    start = time.time() - 3600
    events = spark.range(120).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 30) * 1200).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value"))
    for i in range(30):
        events.filter(f"event_id % 30 = {29 - i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        for f in (tmp_path / "events.parquet").glob("part-*"):
            if f.stat().st_mtime > start + 1800:
                os.utime(f, (start + i, start + i))
    found = {r["window_start"]: (r["n"], r["total"]) for r in QUERIES["q54_stream_equals_batch"](spark, str(tmp_path)).collect()}
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("w")
    assert found == {r["w"]: (r["n"], r["t"]) for r in events.groupBy(hour).agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    assert sum(n for n, _ in found.values()) == 120
