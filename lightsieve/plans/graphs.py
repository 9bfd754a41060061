"""Queries on groups that merge and on similarity graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightsieve.operators import clustering, forest, pairs
from lightsieve.plans.oracle import PAIRS, _leaders
from lightsieve.plans.queries import _hashes, query
from lightsieve.session import materialize


@query
def q78_merged_groups(spark, sf_dir):
    """Hash groups that take in others by votes of three samples until no vote passes; larger groups first."""
    hashes = _hashes(spark, sf_dir)
    groups = materialize(clustering.hash_clusters(hashes, 0.66).join(hashes, "id").select(F.col("group_id").alias("group"), F.col("rank").alias("ord"), "hash"), "grouped")
    return pairs.merge_groups(groups, 0.55)


def _forest(spark, sf_dir):
    return forest.hash_forest(_hashes(spark, sf_dir), 0.64)


@query
def q79_similarity_forest(spark, sf_dir):
    """The maximum spanning forest of the hash similarities."""
    return _forest(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query
def q80_components_at(spark, sf_dir):
    """Components at a tighter threshold, from the forest alone."""
    return forest.components_at(_forest(spark, sf_dir), 0.68)


ORACLE_SQL = {
    "q78_merged_groups": f"""WITH RECURSIVE {PAIRS}, {_leaders("g", "SELECT 0 AS block, rank, id FROM hashes", "SELECT rank_a, rank_b FROM allpairs WHERE similarity >= 0.66")},
        member AS (SELECT dense_rank() OVER (ORDER BY lr) AS grp, h.h, h.rank FROM g JOIN hashes h ON h.id = g.id),
        state(round, grp, origin, h, rank) AS (
            SELECT 0, grp, grp, h, rank FROM member
            UNION ALL (
            WITH size AS (SELECT grp, count(*) AS n FROM state GROUP BY grp),
            sample AS (SELECT grp, h FROM state QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank) <= 3),
            vote AS (
                SELECT a.grp AS a, b.grp AS b FROM sample a JOIN sample b ON a.grp < b.grp GROUP BY 1, 2
                HAVING avg(CASE WHEN 1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE >= 0.55 THEN 1.0 ELSE 0.0 END) >= 0.7),
            pair AS (
                SELECT CASE WHEN x.n >= y.n THEN a ELSE b END AS first, CASE WHEN x.n >= y.n THEN b ELSE a END AS later, greatest(x.n, y.n) AS n
                FROM vote JOIN size x ON x.grp = a JOIN size y ON y.grp = b),
            move AS (
                SELECT later, first FROM pair WHERE first NOT IN (SELECT later FROM pair)
                QUALIFY row_number() OVER (PARTITION BY later ORDER BY n DESC, first) = 1)
            SELECT round + 1, coalesce(first, grp), origin, h, rank FROM state LEFT JOIN move ON later = grp WHERE EXISTS (SELECT 1 FROM move)))
        SELECT DISTINCT origin AS "group", grp AS merged, count(*) OVER (PARTITION BY grp) AS size FROM state WHERE round = (SELECT max(round) FROM state)""",
    "q79_similarity_forest": f"""WITH RECURSIVE {PAIRS},
        edge AS (
            SELECT least(id_a, id_b) AS a, greatest(id_a, id_b) AS b, similarity, row_number() OVER (ORDER BY similarity DESC, least(id_a, id_b), greatest(id_a, id_b)) AS k
            FROM allpairs WHERE similarity >= 0.64),
        state(k, node, part) AS (
            SELECT CAST(0 AS BIGINT), id, id FROM hashes
            UNION ALL
            SELECT e.k, s.node, CASE WHEN s.part = y.part THEN x.part ELSE s.part END
            FROM state s JOIN edge e ON e.k = s.k + 1 JOIN state x ON x.node = e.a JOIN state y ON y.node = e.b)
        SELECT a AS id_a, b AS id_b, round(similarity, 6) AS weight
        FROM edge e JOIN state x ON x.k = e.k - 1 AND x.node = a JOIN state y ON y.k = e.k - 1 AND y.node = b WHERE x.part <> y.part""",
    "q80_components_at": f"""WITH RECURSIVE {PAIRS},
        edge AS (SELECT id_a AS a, id_b AS b FROM allpairs WHERE similarity >= 0.68 UNION SELECT id_b, id_a FROM allpairs WHERE similarity >= 0.68),
        reach(node, other) AS (SELECT a, a FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other)
        SELECT node, min(other) AS component FROM reach GROUP BY node""",
}
