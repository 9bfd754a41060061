"""Named queries over the given tables, one for each operator or small group of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lightsieve.config import CATEGORIES, Rules, Selection
from lightsieve.functions import kernels
from lightsieve.operators import audit, clustering, forest, lookup, pairs, rules, selection, similarity
from lightsieve.sources import photos as sources
from lightsieve.session import materialize, table
from lightsieve.streaming import photos as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EVENT_TYPES = ("view", "click", "purchase", "signup", "error")
AT_25 = Selection(target_pct=25, moments=EVENT_TYPES)
AT_50 = replace(AT_25, target_pct=50)
HASH_THRESHOLD = 0.70
COSINE_THRESHOLD = 0.35
TERMS = ("no clear subject", "poor composition", "loser", "clown")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.photos_from_events(table(spark, sf_dir, "events"))


def _base(spark: SparkSession, sf_dir: str, s: Selection = AT_25) -> tuple[DataFrame, DataFrame]:
    photos = _photos(spark, sf_dir)
    return photos, materialize(selection.base_selection(photos, s), "base")


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, rank, hash, width, vector, label) of the embeddings; ranked by width, widest first, then id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), similarity.sign_bits(F.col("embedding")).alias("hash"), ((F.col("label") + 1) * 100).alias("width"), F.col("embedding").alias("vector"), "label")
    return e.withColumn("rank", F.struct((-F.col("width")).alias("narrower"), "id"))


def _utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query
def q01_scan_filter_ext(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    suffix = F.element_at(F.array(*map(F.lit, ("JPG", "png", "txt", "ARW", "Jpeg"))), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("."), suffix)
    parts = sources.path_parts(path)
    return pages.select("page_id", *[c.alias(n) for n, c in parts.items()]).filter(F.col("ext").isin(sources.supported(["JPG", "jpeg", "PNG"], ["arw", "png"])))


@query
def q02_stem_lookup_first_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 2000).alias("stem"))
    conversions = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 700).alias("stem"), "c_custkey", "c_name")
    found = lookup.first_match(orders, conversions, "stem", "c_custkey", "c_name")
    return found.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("order-"), F.col("o_orderkey"))).alias("original"))


@query
def q03_tier_label(spark, sf_dir):
    return _photos(spark, sf_dir).select("ord", selection.tier_label(F.col("score"), AT_50).alias("tier"))


@query
def q04_tier_distribution(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    return selection.tier_distribution(photos, selection.select_for_delivery(photos, AT_25), AT_25)


@query
def q05_select_tiers_25(spark, sf_dir):
    return selection.select_for_delivery(_photos(spark, sf_dir), AT_25)


@query
def q06_select_tiers_50(spark, sf_dir):
    return selection.select_for_delivery(_photos(spark, sf_dir), AT_50)


@query
def q07_people_coverage(spark, sf_dir):
    photos, base = _base(spark, sf_dir)
    missing = selection.missing_people(photos, base, AT_25).groupBy("album").agg(F.count("*").alias("n_missing"))
    return selection.people_coverage(photos, base).join(missing, "album", "left").fillna(0, ["n_missing"])


@query
def q08_moment_coverage(spark, sf_dir):
    photos, base = _base(spark, sf_dir)
    return selection.moment_coverage(photos, base, AT_25).select("album", "moment", "total", "selected", (F.col("selected") == 0).alias("missing"))


@query
def q09_time_gaps(spark, sf_dir):
    gaps = selection.time_gaps(_base(spark, sf_dir)[1], AT_25)
    seconds = (F.unix_micros("gap_end") - F.unix_micros("gap_start")) / 1e6
    return gaps.select("album", "k", _utc(F.col("gap_start")).alias("gap_start"), F.round(seconds, 3).alias("seconds"))


@query
def q10_gap_range_join_top2(spark, sf_dir):
    photos, base = _base(spark, sf_dir)
    return selection.in_gaps(photos, base, AT_25).select("album", "k", "r", "ord", "score")


@query
def q11_missing_people_best(spark, sf_dir):
    photos, base = _base(spark, sf_dir)
    return selection.missing_people_best(photos, base, AT_25).select("album", "person", "k", "ord", "score")


@query
def q12_time_bucket_score(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    return selection.time_buckets(photos, photos.filter(F.col("score") >= 120))


@query
def q13_variety_score(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("shelf", F.col("p_partkey") % 400).withColumn("portrait", F.col("p_size") % 2)
    return selection.variety(part, "shelf", "p_brand", "portrait", "p_type")


@query
def q14_recommendations(spark, sf_dir):
    photos, base = _base(spark, sf_dir)
    return selection.recommendations(photos, base, AT_25).select("album", "ord", "score", "boost", "kind", "k", "r", (F.col("score") + F.col("boost") >= AT_25.key_moment).alias("qualifies"))


def _marked_docs(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    groups = clustering.text_groups(docs).filter("group_size > 1").select("text_hash", "best")
    keyed = docs.withColumn("text_hash", F.md5(F.col("text").cast("binary")))
    return keyed.join(groups, "text_hash", "left").join(labels, "doc_id", "left")


@query
def q15_exclusion_reason(spark, sf_dir):
    d = _marked_docs(spark, sf_dir)
    closed, blurry = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))
    duplicate = F.coalesce(F.col("best") != F.col("doc_id"), F.lit(False))
    reason = rules.exclusion_reason(closed, blurry, duplicate, F.col("doc_id") % 10 == 0, F.col("n_chars") < 200)
    return d.select("doc_id", reason.alias("reason")).filter("reason is not null")


@query
def q16_basic_checks_anti(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lookup.excluding(docs, "doc_id", labels.filter("toxic = 1"), labels.filter("quality = 0"), docs.filter("n_chars < 100")).select("doc_id", "lang", "source")


@query
def q17_allow_list_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customer = table(spark, sf_dir, "customer")
    return lookup.excluding(orders, "c_custkey", customer.filter("c_acctbal < 5000"), allowed=customer.filter("c_mktsegment = 'BUILDING'")).select("o_orderkey", "c_custkey")


@query
def q18_substring_semi(spark, sf_dir):
    return similarity.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id")


@query
def q19_hash_pack_bits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", similarity.sign_bits(F.col("embedding")).alias("hash"))


@query
def q20_hash_pairs(spark, sf_dir):
    return similarity.hash_pairs(_hashes(spark, sf_dir), HASH_THRESHOLD)


@query
def q21_banded_pairs_equal_exact(spark, sf_dir):
    return similarity.banded_pairs(similarity.token_fingerprints(table(spark, sf_dir, "documents")), 6)


@query
def q22_cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(_hashes(spark, sf_dir), COSINE_THRESHOLD).withColumn("cosine", F.round("cosine", 6))


@query
def q23_leader_clusters(spark, sf_dir):
    hashes = _hashes(spark, sf_dir)
    return clustering.hash_clusters(hashes, 0.66).select("id", "leader", "group_id", "group_size")


@query
def q24_best_of_group(spark, sf_dir):
    scored = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "part"), F.col("vec_id") == F.col("p_partkey"))
    return clustering.best_of_group(scored, "label", "vec_id", "p_retailprice")


@query
def q25_duplicate_filter(spark, sf_dir):
    return clustering.without_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "lang")


@query
def q26_face_count_split(spark, sf_dir):
    return clustering.text_groups(table(spark, sf_dir, "documents"), "lang").filter("group_size > 1").select("text_hash", "lang", "best", "group_size")


@query
def q27_mutual_nearest(spark, sf_dir):
    vectors = _hashes(spark, sf_dir)
    return similarity.mutual_nearest(vectors.filter("label < 5"), vectors.filter("label >= 5")).withColumn("cosine", F.round("cosine", 6))


@query
def q28_uniqueness_anti(spark, sf_dir):
    hashes = _hashes(spark, sf_dir)
    return similarity.without_near(hashes.filter("label < 5"), hashes.filter("label >= 5"), 20).select("id")


def _delivery(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").withColumn("text_hash", F.md5(F.col("text").cast("binary")))
    groups = docs.join(clustering.text_groups(docs).filter("group_size > 1").select("text_hash"), "text_hash", "left_semi").select("doc_id", "text_hash")
    return docs.filter("doc_id % 3 <> 0").select("doc_id", "lang"), groups


@query
def q29_qc_duplicate_leak(spark, sf_dir):
    return audit.duplicate_leaks(*_delivery(spark, sf_dir), "doc_id", "text_hash")


@query
def q30_qc_orphans(spark, sf_dir):
    delivered, groups = _delivery(spark, sf_dir)
    return audit.orphans(delivered, "doc_id", table(spark, sf_dir, "labels"), groups)


@query
def q31_album_tier_rollup(spark, sf_dir):
    tiers = _photos(spark, sf_dir).select("album", selection.tier_label(F.col("score"), AT_50).alias("tier"))
    return tiers.rollup("album", "tier").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query
def q32_qc_missing_categories(spark, sf_dir):
    return audit.missing_categories(table(spark, sf_dir, "documents"), "lang", ("en", "de", "fr", "es", "it", "pt"))


@query
def q33_qc_statistics(spark, sf_dir):
    return audit.statistics(table(spark, sf_dir, "documents"), "lang", ("en", "de", "fr", "es", "it", "pt"))


@query
def q34_qc_fix(spark, sf_dir):
    delivered, groups = _delivery(spark, sf_dir)
    return audit.to_remove(delivered, groups, table(spark, sf_dir, "labels"), "doc_id", "text_hash", "quality").select("doc_id", "text_hash", "quality")


@query
def q35_stage_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stages = F.array(
        F.struct(F.lit("blur").alias("stage"), F.when(F.col("value") < 20, "blurry").otherwise("clear").alias("category")),
        F.struct(F.lit("focus").alias("stage"), F.when(F.col("event_type") == "error", "error").when(F.col("value") >= 45, "in_focus").otherwise("off_focus").alias("category")),
        F.struct(F.lit("eyes").alias("stage"), F.when(F.col("user_id") % 7 == 0, "closed").otherwise("open").alias("category")),
    )
    return e.select(F.explode(stages).alias("s")).groupBy("s.stage", "s.category").agg(F.count("*").alias("n"))


def _blur_inputs(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "BLURRY").when(F.col("event_type") == "view", "CLEAR").otherwise(F.upper("event_type"))
    status = F.when(F.col("event_type") == "click", "BLURRY").otherwise(status)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.col("value").alias("confidence"), (F.col("event_id") * 7 % 101).cast("double").alias("combined"))


@query
def q36_blur_rule(spark, sf_dir):
    return _blur_inputs(spark, sf_dir).select("event_id", rules.blur_rule(F.col("status"), F.col("confidence"), F.col("combined")).alias("is_blurry"))


@query
def q37_blur_rule_full(spark, sf_dir):
    return _blur_inputs(spark, sf_dir).select("event_id", rules.blur_rule_full(F.col("status"), F.col("confidence"), F.col("combined")).alias("is_blurry"))


@query
def q38_focus_rule(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("view", "click"), "IN_FOCUS").when(F.col("event_type") == "signup", "NO_SUBJECT").when(F.col("event_type") == "error", F.lit(None)).otherwise("OFF_FOCUS")
    detail = F.when(F.col("user_id") % 11 == 0, "Foreground obstruction").when(F.col("user_id") % 13 == 0, "Backs turned to us").otherwise("sharp")
    confidence = (F.col("event_id") % 40 + 60).cast("double")
    return e.select("event_id", rules.focus_rule(F.col("value"), status, confidence, detail).alias("category"), rules.focus_rule(F.col("value"), status, confidence, detail, batch=True).alias("batch_category"))


@query
def q39_eye_rule(spark, sf_dir):
    faces = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") > 1, F.col("l_quantity") / 400)).alias("largest"), F.max(F.struct("l_quantity", "l_linenumber", (F.col("l_discount") * 1000 + 20).alias("p"))).alias("by_size"))
    closed, reason = rules.eye_rule(F.col("l_orderkey") % 9 == 0, (F.col("l_orderkey") % 50 + 50).cast("double"), F.col("largest"), F.round(F.col("by_size.p"), 4))
    return faces.select("l_orderkey", closed.alias("closed"), reason.alias("reason"), rules.eye_category(closed, reason).alias("category"))


@query
def q40_venue_rule(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    status = F.when(F.col("p_type") == "ECONOMY", "VENUE").otherwise("PEOPLE")
    return part.select("p_partkey", rules.venue_rule(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double"), status, F.col("p_partkey") % 100).alias("is_venue"))


@query
def q41_parse_reply(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    number = F.when(F.col("event_id") % 5 == 0, "0.5").when(F.col("event_id") % 5 == 1, "n/a").otherwise((F.col("event_id") % 100).cast("string"))
    reply = F.when(F.col("event_id") % 17 == 0, F.lit("no reply")).otherwise(F.concat_ws("|", F.initcap("event_type"), F.concat(F.lit(" "), number), F.concat(F.lit(" user "), F.col("user_id"))))
    return e.select("event_id", rules.parse_reply(reply).alias("r")).select("event_id", "r.*")


@query
def q42_reject_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    decision, score = rules.reject_terms(F.when(F.col("n_chars") > 1000, "BEST").otherwise("KEEP"), (F.col("doc_id") % 100).cast("double"), F.col("text"), TERMS)
    return docs.select("doc_id", decision.alias("decision"), score.alias("score"))


@query
def q43_quality_weighted(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    parts = {
        "resolution": rules.resolution_score(F.col("l_extendedprice") * 80),
        "face_detection": rules.face_score(F.col("l_linenumber") - 1),
        "contrast": F.col("l_quantity") / 50,
        "sharpness": F.col("l_discount") * 10,
        "noise": 1 - F.col("l_tax") * 10,
        "exposure": rules.exposure_score(F.col("l_quantity") * 5),
    }
    return li.select("l_orderkey", "l_linenumber", F.round(rules.overall_quality(parts), 6).alias("quality"), F.round(parts["exposure"], 6).alias("exposure"))


@query
def q44_rate_window(spark, sf_dir):
    """Requests of each user in the 60 seconds up to each of them, across midnight too."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    trailing = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    return e.select("event_id", F.count("*").over(trailing).alias("in_window"))


@query
def q45_backoff_table(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("attempt")).agg(F.count("*").alias("n")).withColumn("delay", rules.backoff_seconds(F.col("attempt"))).withColumn("waited", F.col("n") * F.col("delay"))


@query
def q46_priority_order(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query
def q47_incremental_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return lookup.unprocessed(e, e.filter("event_id % 4 = 0 or event_type = 'view'"), "event_id").select("event_id", "event_type")


@query
def q48_stage_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").pivot("event_type", list(EVENT_TYPES)).agg(F.count("event_id")).fillna(0)


@query
def q49_json_report(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    chosen = selection.select_for_delivery(photos, AT_50).groupBy("album").agg(F.count("*").alias("delivered"))
    stats = photos.groupBy("album").agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("errors")).join(chosen, "album", "left").fillna(0)
    return stats.select("album", F.to_json(F.struct("album", "total", "errors", "delivered")).alias("report"))


@query
def q50_json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.max("k").alias("max_k"), F.count("k").alias("n"))


@query
def q51_dir_group(spark, sf_dir):
    parts = sources.path_parts(F.regexp_replace("url", r"\?.*$", ""))
    place = F.row_number().over(Window.partitionBy("dir").orderBy("page_id")) - 1
    listed = table(spark, sf_dir, "pages").select("page_id", parts["dir"].alias("dir")).withColumn("part", F.floor(place / 25))  # lists of 25 files at most
    return listed.groupBy("dir", "part").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("page_id"))), ",").alias("pages"))


@query
def q52_mean_embedding(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query
def q53_components(spark, sf_dir):
    return forest.hash_components(_hashes(spark, sf_dir), 0.66)


@query
def q54_stream_equals_batch(spark, sf_dir):
    stream = streaming.stream_table(spark, f"{sf_dir}/events.parquet")
    # files come in any order of event time, so no watermark may drop rows
    done = streaming.run_latest(streaming.tumbling_counts(stream, late=None), ["window_start"], "tumbling")
    return done.select(_utc(F.col("window_start")).alias("window_start"), "n", F.round("total", 4).alias("total"))


@query
def q55_session_gaps(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.session_gaps(events, "user_id", "6 hours").select("user_id", _utc(F.col("session_start")).alias("session_start"), "n")


@query
def q56_image_features(spark, sf_dir):
    return kernels.features(kernels.images_from_embeddings(table(spark, sf_dir, "embeddings")))


@query
def q57_approx_people(spark, sf_dir):
    people = _photos(spark, sf_dir).select("album", F.explode("faces").alias("person"))
    return people.groupBy("album").agg(F.approx_count_distinct("person", 0.02).alias("people"))


@query
def q58_api_stats(spark, sf_dir):
    ok = F.col("event_type") != "error"
    e = table(spark, sf_dir, "events").groupBy("user_id")
    return e.agg(F.count("*").alias("requests"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("value"))), 4).alias("avg_duration"))


@query
def q59_exposure_routing(spark, sf_dir):
    """Over-exposure is decided first and short-circuits the blur test."""
    b = _blur_inputs(spark, sf_dir)
    share = F.col("event_id") % 100 / 100.0
    return b.select("event_id", rules.exposure_or_blur(share, rules.blur_rule(F.col("status"), F.col("confidence"), F.col("combined"))).alias("category"))


@query
def q60_verified_groups(spark, sf_dir):
    """Hash groups, confirmed by faces: the label's parity stands for the face count, unknown where the second dimension is above 1.5; label 9 has no face embedding."""
    hashes = _hashes(spark, sf_dir)
    groups = clustering.hash_clusters(hashes, 0.62).select("id", F.col("group_id").alias("group"))
    faces = F.when(F.element_at("vector", 2) > 1.5, -1).otherwise(F.col("label") % 2)
    members = materialize(groups.join(hashes.select("id", "rank", faces.alias("face_count")), "id"), "members")
    return clustering.verified_groups(members, hashes.filter("label <> 9").select("id", "vector"), 0.1)


@query
def q61_four_signal_pairs(spark, sf_dir):
    """Signals with the thresholds that these embeddings reach; label % 3 stands for the face count, background is closeness of the labels."""
    photos = _hashes(spark, sf_dir).select("id", (F.col("label") % 3).alias("face_count"), "hash", "vector", (F.col("label") / 9.0).alias("feature"))
    found = pairs.signal_pairs(photos, lambda same, h, f, s: pairs.four_signals(same, h, f, s, 0.68, 0.32, 2.0, 0.60))
    reason = pairs.pair_reason(F.col("h"), F.col("f"), F.col("id_a") % 2 == 0, F.col("s"), F.col("s"), 0.68, 0.30, 2.0, 1.0)
    return found.select("id_a", "id_b", reason.alias("reason"), F.round(pairs.comprehensive_similarity(F.col("h"), F.col("f"), F.col("s")), 5).alias("similarity"))


@query
def q62_same_faces(spark, sf_dir):
    """Orders of a customer are the photos of an album, their lines the faces."""
    faces = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("faces"))
    photos = table(spark, sf_dir, "orders").join(faces, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("album"), "faces")
    return pairs.same_faces(photos, lambda a, b: 1 - F.abs(a - b) / 50, 0.85, 0.80)


@query
def q63_batch_number(spark, sf_dir):
    """Batches of 25 photos of an album in file order."""
    w = Window.partitionBy("album").orderBy("ord")
    return _photos(spark, sf_dir).select("album", "ord", F.floor((F.row_number().over(w) - 1) / 25).alias("batch"))


@query
def q64_merge_last_wins(spark, sf_dir):
    """Results of several runs by user; of equal keys the last run's counts."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query
def q65_batch_statistics(spark, sf_dir):
    """Successes, failures and photos a second of each album's run."""
    photos = _photos(spark, sf_dir)
    span = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    return photos.groupBy("album").agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.count("*") / span, 6).alias("per_second"))


@query
def q66_group_merge_votes(spark, sf_dir):
    """Pairs of hash groups that samples of three vote to merge."""
    hashes = _hashes(spark, sf_dir)
    groups = clustering.hash_clusters(hashes, 0.66).join(hashes, "id")
    return pairs.merge_votes(groups.select(F.col("group_id").alias("group"), F.col("rank").alias("ord"), "hash"), 0.5).withColumn("ratio", F.round("ratio", 6))


@query
def q67_directory_counts(spark, sf_dir):
    """Files and directories of each host."""
    path = F.regexp_replace("url", r"\?.*$", "")
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), sources.path_parts(path)["dir"].alias("dir"))
    return pages.groupBy("host").agg(F.count("*").alias("n_files"), F.countDistinct("dir").alias("n_dirs"))


@query
def q68_two_sources(spark, sf_dir):
    """Customers, then suppliers whose nation and rounded balance no customer has."""
    stem = lambda nation, balance: F.concat_ws("-", nation, F.floor(F.col(balance) / 10))
    first = table(spark, sf_dir, "customer").select(F.lit("input").alias("source"), stem("c_nationkey", "c_acctbal").alias("stem"), F.col("c_custkey").alias("id"))
    second = table(spark, sf_dir, "supplier").select(F.lit("in_focus").alias("source"), stem("s_nationkey", "s_acctbal").alias("stem"), F.col("s_suppkey").alias("id"))
    return lookup.two_sources(first, second, "stem")


@query
def q69_decisions(spark, sf_dir):
    """Venue confidence, legacy best decision, final check and the older order of reasons, over the events."""
    e = table(spark, sf_dir, "events")
    score, even = F.col("value"), F.col("user_id") % 2 == 0
    decision = F.when(F.col("event_type") == "purchase", "BEST").when(F.col("event_type") == "click", "PASS").otherwise("KEEP")
    detail = F.when(F.col("user_id") % 7 == 0, "Back to camera").otherwise("fine")
    return e.select(
        "event_id",
        rules.confident_venues(even, score).alias("venue"),
        rules.best_decision(decision, score, even, F.col("user_id") % 5 == 0).alias("best"),
        rules.final_check(decision, score, detail, 50).alias("passes"),
        rules.disqualified_reason(even, F.col("user_id") % 3 == 0, score < 5, score < 20, score < 45).alias("reason"),
        rules.worth_logging(F.upper("event_type"), detail, ["to camera"]).alias("logged"),
    )


@query
def q70_group_candidate(spark, sf_dir):
    """The best candidate of each order's lines: BEST ones (full-priced) of a score of 85 at least."""
    li = table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_quantity") * 2).filter("l_discount <= 0.05 and score >= 85")
    return clustering.best_of_group(li.withColumn("line", F.col("l_linenumber") * 100000 + F.col("l_suppkey")), "l_orderkey", "line", "score").select("l_orderkey", "best", "best_score")


@query
def q71_group_records(spark, sf_dir):
    """One record a hash group: best, others, scores and size."""
    hashes = _hashes(spark, sf_dir)
    x = F.element_at("vector", 1).cast("double")
    score = F.when(x < 0, -F.round(-x, 4)).otherwise(F.round(x, 4))  # F.round loses the sign of what becomes zero
    groups = clustering.hash_clusters(hashes, 0.66).join(hashes.select("id", score.alias("score")), "id")
    r = clustering.group_records(groups, "group_id", "id", "score")
    scores = F.array_join(F.transform(F.array_sort(F.map_keys("scores")), lambda k: F.concat(k.cast("string"), F.lit(":"), F.when(F.element_at("scores", k).isNotNull(), F.format_string("%.4f", F.element_at("scores", k))))), ",")
    return r.select("group_id", "best", F.array_join("similar", ",").alias("similar"), scores.alias("scores"), "group_size")


@query
def q72_group_statistics(spark, sf_dir):
    """Groups by label, the largest first: average face count and joint quality."""
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 4).alias("n"), (F.col("vec_id") % 100).alias("score"), F.col("embedding").alias("vector"))
    found = clustering.group_statistics(e, "label", "n", "score", "vector")
    return found.select("place", "label", "size", F.round("average_count", 6).alias("average_count"), F.round("quality", 6).alias("quality"))


@query
def q73_duplicate_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("h", F.md5(F.col("text").cast("binary")))
    groups = clustering.text_groups(docs).filter("group_size > 1").select(F.col("text_hash").alias("h"), F.col("h").alias("g"))
    return clustering.duplicate_counts(docs.join(groups, "h", "left"), "doc_id", "g")


@query
def q74_group_similarity(spark, sf_dir):
    """Greatest cosine between the members of merge candidates whose average face counts differ by 1 at most."""
    hashes = _hashes(spark, sf_dir)
    members = materialize(clustering.hash_clusters(hashes, 0.66).join(hashes, "id").select("group_id", "rank", "hash", "vector", "label"), "grouped")
    votes = pairs.merge_votes(members.select(F.col("group_id").alias("group"), F.col("rank").alias("ord"), "hash"), 0.56)
    mean = lambda s: members.groupBy(F.col("group_id").alias(f"group_{s}")).agg(F.avg("label").alias(f"mean_{s}"))
    near = votes.join(mean("a"), "group_a").join(mean("b"), "group_b").filter("abs(mean_a - mean_b) <= 1").select("group_a", "group_b")
    return clustering.group_similarity(members, "group_id", "vector", near).withColumn("similarity", F.round("similarity", 6))


@query
def q75_retry_jitter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("attempt", F.col("event_id") % 8 + 1)
    return e.select("event_id", F.round(rules.backoff_seconds(F.col("attempt"), jitter_by=F.col("event_id")), 6).alias("delay"))


@query
def q76_strict_selection(spark, sf_dir):
    """Tier 2 by score, and nothing that fails the basic checks comes in for coverage."""
    return selection.select_for_delivery(_photos(spark, sf_dir), replace(AT_25, strict_coverage=True, tier_2_by_score=True))


@query
def q77_audit_report(spark, sf_dir):
    """All violations of a delivery as one table."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.when(F.col("doc_id") % 5 == 0, "BEST_").otherwise(""), F.col("doc_id").cast("string")))
    h = F.md5(F.col("text").cast("binary"))
    groups = docs.withColumn("h", h).join(clustering.text_groups(docs).filter("group_size > 1").select(F.col("text_hash").alias("h"), "best"), "h").select("path", F.concat(F.lit("group_"), F.col("best")).alias("group_id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("quality") == 1, "best_quality").otherwise("blurry").alias("category"))
    return audit.inspect(docs.select("path"), groups, labels, CATEGORIES)
