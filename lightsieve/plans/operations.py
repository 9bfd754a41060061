"""Queries on caches, merged stages, maintenance of deliveries and statistics of runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightsieve import delivery
from lightsieve.functions import recommend
from lightsieve.operators import bloom, merge
from lightsieve.operators.metrics import StageStatistics
from lightsieve.plans.oracle import DELIVERY
from lightsieve.plans.oracle import ORACLE_SQL as ORACLE
from lightsieve.plans.queries import AT_25, _base, _delivery, query
from lightsieve.session import materialize, shared_path, table
from lightsieve.streaming import batches, cache

DAY_US = 86_400_000_000


@query
def q81_recent_cache(spark, sf_dir):
    """Which events meet an item that their category still remembers: 80 items a category, for a day, in four runs of a stream."""
    e = table(spark, sf_dir, "events")
    events = e.select(F.col("event_type").alias("category"), F.col("event_id").alias("ord"), F.col("user_id").alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("user_id") % 4).alias("part"))
    return cache.replay(events, 4, most=80, shards=4, lifetime=DAY_US, shard=F.col("item") % 4).select("category", F.col("ord").alias("event_id"), "item", "seen", "evicted")


@query
def q82_merged_stages(spark, sf_dir):
    """Four stages over the events, one of which can't be planned, as one row an event with results and errors."""
    e = table(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("photo_"), "event_id"))
    stages = {
        "blur": lambda rows: rows.filter("event_id % 5 <> 0").select("path", F.when(F.col("value") < 20, "blurry").otherwise("clear").alias("category")),
        "focus": lambda rows: rows.filter("event_id % 3 = 0").select("path", F.col("value").alias("score"), merge.error_where(F.col("event_type") == "error", "no subject").alias("error")),
        "eyes": lambda rows: rows.filter("user_id % 7 < 3").select("path", (F.col("user_id") % 7 == 0).alias("closed")),
        "model": lambda rows: rows.select("path", "no_such_column"),
    }
    merged = merge.merge_stages(merge.run_stages(e, stages), "path")
    return merged.select(
        "path", F.col("blur.category").alias("blur"), F.col("focus.score").alias("focus"), F.col("eyes.closed").alias("closed"), "n_results",
        F.coalesce(F.element_at("errors", "focus"), F.lit("")).alias("focus_error"), F.coalesce(F.regexp_extract("model.error", "^([A-Za-z]+):", 1), F.lit("")).alias("model_error"),
    )


@query
def q83_fix_in_place(spark, sf_dir):
    """A delivery from which surplus duplicates are taken in the parts that hold them, as it is read afterwards."""
    delivered, groups = _delivery(spark, sf_dir)
    path = shared_path(spark, "delivery")
    delivery.write_delivery(delivered.join(groups, "doc_id", "left"), path, "text_hash")
    delivery.fix_in_place(spark, path, groups, table(spark, sf_dir, "labels"), "doc_id", "text_hash", "quality")
    return delivery.read_delivery(spark, path).select("doc_id", "lang")


@query
def q84_observed_statistics(spark, sf_dir):
    """The statistics of all stages, observed while their result is written."""
    e = table(spark, sf_dir, "events")
    seen = StageStatistics({
        "blur": (F.when(F.col("value") < 20, "blurry").otherwise("clear"), ("blurry", "clear")),
        "focus": (F.when(F.col("event_type") == "error", "error").when(F.col("value") >= 45, "in_focus").otherwise("off_focus"), ("error", "in_focus", "off_focus")),
        "eyes": (F.when(F.col("user_id") % 7 == 0, "closed").otherwise("open"), ("closed", "open")),
    })
    materialize(seen.watch(e).filter("value >= 45 and event_type <> 'error'"), "in-focus")
    return seen.table(spark)


@query
def q85_filtered_manifest(spark, sf_dir):
    """What an incremental run has left to do; most of it never reaches the join with the manifest."""
    e = table(spark, sf_dir, "events")
    return bloom.unprocessed_filtered(e, e.filter("event_id % 4 = 0 or event_type = 'view'"), "event_id").select("event_id", "event_type")


@query
def q86_recommend_function(spark, sf_dir):
    """Recommendations by a table function, one album a partition."""
    photos, base = _base(spark, sf_dir)
    found = recommend.recommend(photos, base, AT_25)
    return found.withColumn("qualifies", F.col("score") + F.col("boost") >= AT_25.key_moment)


@query
def q87_quarantined_batches(spark, sf_dir):
    """A stream whose step divides by a number that is 0 in a few rows: these are set aside, all others land once."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    source, folder = shared_path(spark, "guarded-events"), shared_path(spark, "guarded")
    e.withColumn("part", F.col("event_id") % 3).repartition(3, "part").drop("part").write.parquet(source)
    guarded = batches.Guarded(lambda rows: rows.select("event_id", F.expr("100 div (k - 50)").alias("share")), F.when(F.col("k") == 50, "k is 50"), folder)
    guarded.run(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source))
    done = guarded.out(spark, "event_id long, share long").select("event_id", "share", F.lit("").alias("reason"), F.lit(0).alias("attempts"))
    return done.unionByName(guarded.quarantine(spark, "event_id long, k int").select("event_id", F.lit(None).cast("long").alias("share"), "reason", "attempts"))


ORACLE_SQL = {
    "q82_merged_stages": """
        WITH e AS (SELECT *, 'photo_' || event_id AS path FROM events),
        blur AS (SELECT path, CASE WHEN value < 20 THEN 'blurry' ELSE 'clear' END AS blur FROM e WHERE event_id % 5 <> 0),
        focus AS (SELECT path, value AS focus, CASE WHEN event_type = 'error' THEN 'no subject' END AS focus_error, true AS has FROM e WHERE event_id % 3 = 0),
        eyes AS (SELECT path, user_id % 7 = 0 AS closed FROM e WHERE user_id % 7 < 3),
        model AS (SELECT path, 'AnalysisException' AS model_error FROM e)
        SELECT path, blur, focus, closed, CAST(blur IS NOT NULL AS INTEGER) + CAST(has IS NOT NULL AND focus_error IS NULL AS INTEGER) + CAST(closed IS NOT NULL AS INTEGER) AS n_results,
               coalesce(focus_error, '') AS focus_error, model_error
        FROM blur FULL JOIN focus USING (path) FULL JOIN eyes USING (path) FULL JOIN model USING (path)""",
    "q83_fix_in_place": f"""WITH {DELIVERY},
        s AS (SELECT doc_id, text_hash, coalesce(quality, 0) AS quality FROM delivered JOIN member USING (doc_id) LEFT JOIN labels USING (doc_id)),
        surplus AS (SELECT doc_id FROM s QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY quality DESC, doc_id) > 1)
        SELECT doc_id, lang FROM delivered ANTI JOIN surplus USING (doc_id)""",
    "q84_observed_statistics": ORACLE["q35_stage_stats"],
    "q85_filtered_manifest": ORACLE["q47_incremental_anti"],
    "q86_recommend_function": ORACLE["q14_recommendations"],
    "q87_quarantined_batches": """
        SELECT event_id, CASE WHEN k <> 50 THEN CAST(trunc(100 / (k - 50)) AS BIGINT) END AS share, CASE WHEN k = 50 THEN 'k is 50' ELSE '' END AS reason, CASE WHEN k = 50 THEN 2 ELSE 0 END AS attempts
        FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "q81_recent_cache": """
        WITH e AS (
            SELECT event_type AS category, event_id, user_id, user_id % 4 AS shard, epoch_us(ts) AS used,
                   lag(event_id) OVER w AS before, lag(epoch_us(ts)) OVER w AS used_before, lead(event_id) OVER w AS later
            FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)),
        between_uses AS (
            SELECT x.event_id, count(DISTINCT y.user_id) AS n
            FROM e x JOIN e y ON y.category = x.category AND y.shard = x.shard AND y.event_id > x.before AND y.event_id < x.event_id GROUP BY 1),
        held AS (
            SELECT e.*, before IS NOT NULL AND coalesce(n, 0) < 20 AS present FROM e LEFT JOIN between_uses USING (event_id)),
        fresh AS (
            SELECT event_id, category, shard, row_number() OVER (PARTITION BY category, shard ORDER BY event_id) AS k FROM held WHERE NOT present),
        gone AS (
            SELECT h.category, h.shard, h.user_id, row_number() OVER (PARTITION BY h.category, h.shard ORDER BY h.event_id) AS k
            FROM held h LEFT JOIN held l ON l.event_id = h.later WHERE l.event_id IS NULL OR NOT l.present)
        SELECT h.category, h.event_id, CAST(h.user_id AS VARCHAR) AS item, present AND used - used_before <= 86400000000 AS seen, CAST(g.user_id AS VARCHAR) AS evicted
        FROM held h LEFT JOIN fresh f ON f.event_id = h.event_id LEFT JOIN gone g ON g.category = f.category AND g.shard = f.shard AND g.k = f.k - 20""",
}
