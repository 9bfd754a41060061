"""ANSI SQL (DuckDB) for the named queries, written independently of the DataFrame code."""

PHOTOS = """photos AS (
    SELECT event_id AS ord, strftime(ts, '%Y-%m-%d') AS album, ts, value AS score, event_type <> 'error' AS ok, event_type AS moment,
           CASE event_id % 3 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [user_id] ELSE [user_id, (user_id * 7) % 150] END AS faces
    FROM events)"""


def _base(pct: int) -> str:
    return f"""WITH {PHOTOS},
    tgt AS (SELECT album, count(*) AS total, CAST(floor(count(*) * {pct} / 100.0) AS BIGINT) AS target FROM photos GROUP BY album),
    t1 AS (SELECT * FROM photos WHERE ok AND score >= 80),
    n1 AS (SELECT tgt.album, any_value(target) AS target, count(t1.ord) AS n FROM tgt LEFT JOIN t1 ON t1.album = tgt.album GROUP BY tgt.album),
    t2 AS (SELECT p.*, row_number() OVER (PARTITION BY p.album ORDER BY ord) AS rn, greatest(0, target - n) AS room
           FROM photos p JOIN n1 ON p.album = n1.album WHERE ok AND score >= 60 AND score < 80 QUALIFY rn <= room),
    s2 AS (SELECT ord, album, ts, score, moment, faces, 'tier_1' AS tier FROM t1 UNION ALL SELECT ord, album, ts, score, moment, faces, 'tier_2' FROM t2),
    fa AS (SELECT album, ord, score, unnest(faces) AS person, generate_subscripts(faces, 1) AS pos FROM photos),
    people AS (SELECT f.album, person, count(*) AS total, count(s2.ord) AS selected, min(f.ord * 10 + pos) AS first
               FROM fa f LEFT JOIN s2 ON s2.ord = f.ord GROUP BY f.album, person),
    miss AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY first) AS k FROM people WHERE total >= 3 AND selected = 0 QUALIFY k <= 5),
    rp AS (SELECT m.album, m.person, f.ord, f.score, 15.0 AS boost, 1 AS kind, m.k, 1 AS r FROM miss m JOIN fa f ON f.album = m.album AND f.person = m.person
           QUALIFY row_number() OVER (PARTITION BY m.album, m.person ORDER BY f.score DESC, f.ord) = 1),
    vocab(v, moment) AS (VALUES (0, 'view'), (1, 'click'), (2, 'purchase'), (3, 'signup'), (4, 'error')),
    mc AS (SELECT a.album, v.v, v.moment, (SELECT count(*) FROM photos p WHERE p.album = a.album AND p.moment = v.moment) AS total,
                  (SELECT count(*) FROM s2 WHERE s2.album = a.album AND s2.moment = v.moment) AS selected FROM tgt a CROSS JOIN vocab v),
    mm AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY v) AS k FROM mc WHERE selected = 0 QUALIFY k <= 5),
    rm AS (SELECT mm.album, p.ord, p.score, 20.0 AS boost, 2 AS kind, mm.k, 1 AS r FROM mm JOIN photos p ON p.album = mm.album AND p.moment = mm.moment
           QUALIFY row_number() OVER (PARTITION BY mm.album, mm.moment ORDER BY p.score DESC, p.ord) = 1),
    gaps AS (SELECT album, ts AS s, lead(ts) OVER (PARTITION BY album ORDER BY ts, ord) AS e FROM s2),
    g3 AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY s) AS k FROM gaps WHERE epoch_us(e) - epoch_us(s) > 600000000 QUALIFY k <= 3),
    rg AS (SELECT g.album, p.ord, p.score, 10.0 AS boost, 3 AS kind, g.k, row_number() OVER (PARTITION BY g.album, g.k ORDER BY p.score DESC, p.ord) AS r
           FROM g3 g JOIN photos p ON p.album = g.album AND p.ts > g.s AND p.ts < g.e WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.ord = p.ord) QUALIFY r <= 2),
    recs AS (SELECT album, ord, score, boost, kind, k, r FROM rp UNION ALL SELECT * FROM rm UNION ALL SELECT * FROM rg)"""


def _select(pct: int) -> str:
    return f"""{_base(pct)},
    n2 AS (SELECT tgt.album, any_value(target) AS target, count(s2.ord) AS n FROM tgt LEFT JOIN s2 ON s2.album = tgt.album GROUP BY tgt.album),
    rq AS (SELECT * FROM recs WHERE score + boost >= 35 QUALIFY row_number() OVER (PARTITION BY album, ord ORDER BY kind, k, r) = 1),
    cov AS (SELECT rq.album, rq.ord, rq.score, row_number() OVER (PARTITION BY rq.album ORDER BY kind, k, r) AS rn, greatest(0, target - n) AS room
            FROM rq JOIN n2 ON n2.album = rq.album QUALIFY rn <= room),
    s3 AS (SELECT album, ord, score, tier FROM s2 UNION ALL SELECT album, ord, score, 'coverage' FROM cov),
    n3 AS (SELECT tgt.album, any_value(target) AS target, count(s3.ord) AS n FROM tgt LEFT JOIN s3 ON s3.album = tgt.album GROUP BY tgt.album),
    t3 AS (SELECT p.album, p.ord, p.score, row_number() OVER (PARTITION BY p.album ORDER BY p.score DESC, p.ord) AS rn, greatest(0, target - n) AS room
           FROM photos p JOIN n3 ON n3.album = p.album
           WHERE ok AND p.score >= 45 AND p.score < 60 AND NOT EXISTS (SELECT 1 FROM s3 WHERE s3.ord = p.ord) QUALIFY rn <= room),
    s4 AS (SELECT * FROM s3 UNION ALL SELECT album, ord, score, 'tier_3' FROM t3),
    solo AS (SELECT album, ord, score, faces[1] AS person, EXISTS (SELECT 1 FROM s4 WHERE s4.ord = p.ord) AS chosen FROM photos p WHERE len(faces) = 1),
    add_solo AS (SELECT * FROM solo a WHERE score >= 40 AND NOT chosen AND NOT EXISTS (SELECT 1 FROM solo b WHERE b.chosen AND b.album = a.album AND b.person = a.person)
                 QUALIFY row_number() OVER (PARTITION BY album, person ORDER BY ord) = 1),
    delivered AS (SELECT album, ord, score, tier FROM s4 UNION ALL SELECT album, ord, score, 'coverage' FROM add_solo)"""


BITS = "(SELECT sum(CASE WHEN {e}[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END) FROM range(64) t(i))"
HASHES = """raw AS (SELECT vec_id AS id, (label + 1) * 100 AS width, label, embedding, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    bit AS (SELECT id, unnest(range(64)) AS i, unnest(embedding) AS x FROM raw),
    packed AS (SELECT id, CAST(sum(CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END) AS UBIGINT) AS h FROM bit GROUP BY id),
    hashes AS (SELECT raw.*, h, row_number() OVER (ORDER BY width DESC, id) AS rank FROM raw JOIN packed USING (id))"""
PAIRS = HASHES + """,
    allpairs AS (SELECT a.id AS id_a, b.id AS id_b, a.rank AS rank_a, b.rank AS rank_b, 1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE AS similarity
                 FROM hashes a JOIN hashes b ON a.rank < b.rank
                 WHERE least(a.width / b.width, b.width / a.width) >= 0.5)"""
COS = "list_cosine_similarity(a.x, b.x)"


def _leaders(name: str, nodes: str, edges: str) -> str:
    """Greedy leaders by rank inside each block. nodes: (block, rank, id); edges: (rank_a, rank_b), rank_a < rank_b, inside a block. Gives {name}(block, id, lr, group_size)."""
    return f"""
        {name}_n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY rank) AS step FROM ({nodes})),
        {name}_e AS ({edges}),
        {name}_a AS (SELECT n.block, n.rank, n.step, n.id, coalesce(list(e.rank_a) FILTER (WHERE e.rank_a IS NOT NULL), []) AS before FROM {name}_n n LEFT JOIN {name}_e e ON e.rank_b = n.rank GROUP BY ALL),
        {name}_w AS (
            SELECT block, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS leaders FROM (SELECT DISTINCT block FROM {name}_n)
            UNION ALL
            SELECT w.block, a.step, CASE WHEN list_has_any(w.leaders, a.before) THEN w.leaders ELSE list_append(w.leaders, a.rank) END
            FROM {name}_w w JOIN {name}_a a ON a.block = w.block AND a.step = w.step + 1),
        {name}_f AS (SELECT block, arg_max(leaders, step) AS leaders FROM {name}_w GROUP BY block),
        {name} AS (SELECT a.block, a.id, CASE WHEN list_contains(leaders, a.rank) THEN a.rank ELSE list_min(list_intersect(leaders, a.before)) END AS lr, count(*) OVER (PARTITION BY a.block, lr) AS group_size
                   FROM {name}_a a JOIN {name}_f f ON f.block = a.block QUALIFY group_size > 1)"""


PATH = "regexp_replace(url, '\\?.*$', '')"
GROUPS = "grp AS (SELECT md5(text) AS text_hash, min(doc_id) AS best, count(*) AS group_size FROM documents GROUP BY 1)"
DELIVERY = GROUPS + """,
    member AS (SELECT doc_id, md5(text) AS text_hash FROM documents WHERE md5(text) IN (SELECT text_hash FROM grp WHERE group_size > 1)),
    delivered AS (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0)"""
BLUR = """b AS (SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN 'BLURRY' WHEN event_type = 'view' THEN 'CLEAR' ELSE upper(event_type) END AS status,
                       value AS confidence, CAST(event_id * 7 % 101 AS DOUBLE) AS combined FROM events)"""
EXPECTED = "expected(lang) AS (VALUES ('en'), ('de'), ('fr'), ('es'), ('it'), ('pt'))"
STAMP = "strftime({t}, '%Y-%m-%d %H:%M:%S.%f')"
HEX = "('0x' || substr(m, {a}, 8))::BIGINT"

ORACLE_SQL: dict[str, str] = {
    "q01_scan_filter_ext": f"""
        WITH p AS (SELECT page_id, {PATH} || '.' || ['JPG', 'png', 'txt', 'ARW', 'Jpeg'][page_id % 5 + 1] AS path FROM pages),
        q AS (SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS basename, path FROM p)
        SELECT page_id, basename, regexp_replace(basename, '\\.[^.]*$', '') AS stem, lower(regexp_extract(basename, '\\.([^.]*)$', 1)) AS ext, regexp_replace(path, '/?[^/]*$', '') AS dir
        FROM q WHERE lower(regexp_extract(basename, '\\.([^.]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'arw')""",
    "q02_stem_lookup_first_match": """
        WITH c AS (SELECT c_custkey % 700 AS stem, c_name, row_number() OVER (PARTITION BY c_custkey % 700 ORDER BY c_custkey) AS rn FROM customer)
        SELECT o_orderkey, coalesce(c_name, 'order-' || o_orderkey) AS original FROM orders LEFT JOIN c ON o_custkey % 2000 = stem AND rn = 1""",
    "q03_tier_label": "SELECT event_id AS ord, CASE WHEN value >= 80 THEN 'tier_1' WHEN value >= 60 THEN 'tier_2' WHEN value >= 45 THEN 'tier_3' ELSE 'none' END AS tier FROM events",
    "q04_tier_distribution": f"""{_select(25)}
        SELECT t.album, any_value(total) AS total, any_value(target) AS target, count(*) FILTER (WHERE tier = 'tier_1') AS tier_1, count(*) FILTER (WHERE tier = 'tier_2') AS tier_2,
               count(*) FILTER (WHERE tier = 'tier_3') AS tier_3, count(*) FILTER (WHERE tier = 'coverage') AS coverage, count(d.ord) AS delivered, count(d.ord) * 100.0::DOUBLE / any_value(total) AS pct
        FROM tgt t LEFT JOIN delivered d ON d.album = t.album GROUP BY t.album""",
    "q05_select_tiers_25": f"{_select(25)} SELECT album, ord, score, tier FROM delivered",
    "q06_select_tiers_50": f"{_select(50)} SELECT album, ord, score, tier FROM delivered",
    "q07_people_coverage": f"""{_base(25)}
        SELECT p.album, count(*) AS n_people, count(*) FILTER (WHERE selected > 0) AS n_covered, count(*) FILTER (WHERE selected > 0) * 100.0::DOUBLE / greatest(count(*), 1) AS pct,
               (SELECT count(*) FROM miss m WHERE m.album = p.album) AS n_missing
        FROM people p GROUP BY p.album""",
    "q08_moment_coverage": f"{_base(25)} SELECT album, moment, total, selected, selected = 0 AS missing FROM mc",
    "q09_time_gaps": f"{_base(25)} SELECT album, k, {STAMP.format(t='s')} AS gap_start, round((epoch_us(e) - epoch_us(s)) / 1e6, 3) AS seconds FROM g3",
    "q10_gap_range_join_top2": f"{_base(25)} SELECT album, k, r, ord, score FROM rg",
    "q11_missing_people_best": f"{_base(25)} SELECT album, person, k, ord, score FROM rp",
    "q12_time_bucket_score": f"""WITH {PHOTOS},
        span AS (SELECT album, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM photos GROUP BY album),
        b AS (SELECT p.album, score >= 120 AS hit, floor((epoch_us(ts) - t0) / ((t1 - t0) / 20.0::DOUBLE)) AS bucket FROM photos p JOIN span s ON s.album = p.album)
        SELECT album, count(DISTINCT bucket) AS all_buckets, count(DISTINCT bucket) FILTER (WHERE hit) AS hit_buckets,
               CASE WHEN count(DISTINCT bucket) = 0 THEN 100.0 ELSE count(DISTINCT bucket) FILTER (WHERE hit) * 100.0::DOUBLE / count(DISTINCT bucket) END AS pct
        FROM b GROUP BY album""",
    "q13_variety_score": "SELECT p_partkey % 400 AS shelf, least(100, 10 * count(DISTINCT p_brand) + 20 * count(DISTINCT p_size % 2) + 15 * count(DISTINCT p_type)) AS variety FROM part GROUP BY 1",
    "q14_recommendations": f"{_base(25)} SELECT album, ord, score, CAST(boost AS DOUBLE) AS boost, kind, k, r, score + boost >= 35 AS qualifies FROM recs",
    "q15_exclusion_reason": f"""WITH {GROUPS}
        SELECT doc_id, reason FROM (
            SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'eyes' WHEN l.quality = 0 THEN 'blur' WHEN g.best <> d.doc_id AND d.doc_id % 10 <> 0 THEN 'duplicate' WHEN n_chars < 200 THEN 'focus' END AS reason
            FROM documents d JOIN grp g ON g.text_hash = md5(d.text) LEFT JOIN labels l ON l.doc_id = d.doc_id)
        WHERE reason IS NOT NULL""",
    "q16_basic_checks_anti": """
        SELECT doc_id, lang, source FROM documents d
        WHERE n_chars >= 100 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (toxic = 1 OR quality = 0))""",
    "q17_allow_list_anti": """
        SELECT o_orderkey, o_custkey AS c_custkey FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 5000 AND c_mktsegment <> 'BUILDING')""",
    "q18_substring_semi": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))",
    "q19_hash_pack_bits": f"""WITH {HASHES}
        SELECT id AS vec_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END AS BIGINT) AS hash FROM hashes""",
    "q20_hash_pairs": f"WITH {PAIRS} SELECT id_a, id_b, similarity FROM allpairs WHERE similarity >= 0.70",
    "q21_banded_pairs_equal_exact": f"""
        WITH t AS (SELECT doc_id, md5(unnest(string_split(text, ' '))) AS m FROM documents),
        v AS (SELECT doc_id, {HEX.format(a=1)} AS hi, {HEX.format(a=9)} AS lo FROM t),
        n AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum(({'lo' if i < 32 else 'hi'} >> {i % 32}) & 1) AS b{i}" for i in range(64))} FROM v GROUP BY doc_id),
        f AS (SELECT DISTINCT CAST({" + ".join(f"(CASE WHEN b{i} * 2 > n THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))} AS UBIGINT) AS h FROM n),
        s AS (SELECT h, CAST(CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END AS BIGINT) AS hash FROM f)
        SELECT a.hash AS hash_a, b.hash AS hash_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS differing FROM s a JOIN s b ON a.hash < b.hash WHERE bit_count(xor(a.h, b.h)) <= 6""",
    "q22_cosine_pairs": f"""WITH {HASHES},
        c AS (SELECT a.id AS id_a, b.id AS id_b, {COS} AS cosine FROM raw a JOIN raw b ON a.id < b.id)
        SELECT id_a, id_b, round(cosine, 6) AS cosine FROM c WHERE cosine >= 0.35""",
    "q23_leader_clusters": f"""WITH RECURSIVE {PAIRS}, {_leaders("g", "SELECT 0 AS block, rank, id FROM hashes", "SELECT rank_a, rank_b FROM allpairs WHERE similarity >= 0.66")}
        SELECT g.id, h.id AS leader, dense_rank() OVER (ORDER BY lr) AS group_id, group_size FROM g JOIN hashes h ON h.rank = lr""",
    "q24_best_of_group": """
        WITH s AS (SELECT label, vec_id, p_retailprice, count(*) OVER (PARTITION BY label) AS group_size, row_number() OVER (PARTITION BY label ORDER BY p_retailprice DESC, vec_id) AS rn
                   FROM embeddings JOIN part ON vec_id = p_partkey)
        SELECT label, vec_id AS best, p_retailprice AS best_score, group_size FROM s WHERE rn = 1""",
    "q25_duplicate_filter": f"WITH {GROUPS} SELECT doc_id, lang FROM documents JOIN grp ON text_hash = md5(text) WHERE group_size = 1 OR best = doc_id",
    "q26_face_count_split": "SELECT md5(text) AS text_hash, lang, min(doc_id) AS best, count(*) AS group_size FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "q27_mutual_nearest": f"""WITH {HASHES},
        c AS (SELECT a.id AS id_a, b.id AS id_b, round({COS}, 12) AS cosine FROM raw a JOIN raw b ON a.label < 5 AND b.label >= 5),
        r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY cosine DESC, id_b) AS rb, row_number() OVER (PARTITION BY id_b ORDER BY cosine DESC, id_a) AS ra FROM c)
        SELECT id_a, id_b, round(cosine, 6) AS cosine FROM r WHERE ra = 1 AND rb = 1""",
    "q28_uniqueness_anti": f"WITH {HASHES} SELECT id FROM hashes a WHERE label < 5 AND NOT EXISTS (SELECT 1 FROM hashes b WHERE b.label >= 5 AND bit_count(xor(a.h, b.h)) <= 20)",
    "q29_qc_duplicate_leak": f"WITH {DELIVERY} SELECT text_hash, count(*) AS n_delivered, min(doc_id) AS first FROM delivered JOIN member USING (doc_id) GROUP BY text_hash HAVING count(*) > 1",
    "q30_qc_orphans": f"""WITH {DELIVERY}
        SELECT doc_id, lang FROM delivered d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM member m WHERE m.doc_id = d.doc_id)""",
    "q31_album_tier_rollup": """
        WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS album, CASE WHEN value >= 80 THEN 'tier_1' WHEN value >= 60 THEN 'tier_2' WHEN value >= 45 THEN 'tier_3' ELSE 'none' END AS tier FROM events)
        SELECT album, tier, count(*) AS n, CAST(grouping(album, tier) AS BIGINT) AS level FROM t GROUP BY ROLLUP (album, tier)""",
    "q32_qc_missing_categories": f"WITH {EXPECTED} SELECT lang FROM expected EXCEPT SELECT lang FROM documents",
    "q33_qc_statistics": f"WITH {EXPECTED} SELECT e.lang, count(d.doc_id) AS n FROM expected e LEFT JOIN documents d ON d.lang = e.lang GROUP BY e.lang",
    "q34_qc_fix": f"""WITH {DELIVERY},
        s AS (SELECT doc_id, text_hash, coalesce(quality, 0) AS quality FROM delivered JOIN member USING (doc_id) LEFT JOIN labels USING (doc_id))
        SELECT doc_id, text_hash, quality FROM s QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY quality DESC, doc_id) > 1""",
    "q35_stage_stats": """
        SELECT 'blur' AS stage, CASE WHEN value < 20 THEN 'blurry' ELSE 'clear' END AS category, count(*) AS n FROM events GROUP BY 1, 2
        UNION ALL SELECT 'focus', CASE WHEN event_type = 'error' THEN 'error' WHEN value >= 45 THEN 'in_focus' ELSE 'off_focus' END, count(*) FROM events GROUP BY 1, 2
        UNION ALL SELECT 'eyes', CASE WHEN user_id % 7 = 0 THEN 'closed' ELSE 'open' END, count(*) FROM events GROUP BY 1, 2""",
    "q36_blur_rule": f"WITH {BLUR} SELECT event_id, status = 'BLURRY' AND confidence >= 90 AND combined < 40 AS is_blurry FROM b",
    "q37_blur_rule_full": f"""WITH {BLUR}
        SELECT event_id, CASE WHEN combined >= 40 OR status = 'CLEAR' THEN false WHEN status = 'BLURRY' AND confidence >= 90 THEN true ELSE false END AS is_blurry FROM b""",
    "q38_focus_rule": """
        WITH e AS (SELECT event_id, value AS score, CASE WHEN event_type IN ('view', 'click') THEN 'IN_FOCUS' WHEN event_type = 'signup' THEN 'NO_SUBJECT' WHEN event_type <> 'error' THEN 'OFF_FOCUS' END AS status,
                          event_id % 40 + 60 AS confidence, user_id % 11 = 0 OR user_id % 13 = 0 AS rejected FROM events)
        SELECT event_id,
               CASE WHEN status IS NULL THEN 'error' WHEN status = 'NO_SUBJECT' THEN 'no_subject' WHEN score >= 45 AND confidence >= 75 AND status = 'IN_FOCUS' AND NOT rejected THEN 'in_focus' ELSE 'off_focus' END AS category,
               CASE WHEN status IS NULL THEN 'error' WHEN status = 'NO_SUBJECT' THEN 'no_subject' WHEN score >= 45 AND confidence >= 75 AND status = 'IN_FOCUS' THEN 'in_focus' ELSE 'off_focus' END AS batch_category
        FROM e""",
    "q39_eye_rule": """
        WITH f AS (SELECT l_orderkey, max(CASE WHEN l_linenumber > 1 THEN l_quantity / 400 END) AS largest, arg_max(l_discount * 1000 + 20, (l_quantity, l_linenumber, l_discount)) AS p FROM lineitem GROUP BY l_orderkey),
        r AS (SELECT l_orderkey, CASE WHEN l_orderkey % 9 = 0 AND l_orderkey % 50 + 50 >= 75 THEN 'Venue shot' WHEN largest IS NULL THEN 'No faces detected'
                     WHEN largest < 0.05 THEN 'Face too small - likely venue/decor shot' WHEN round(p, 4) >= 85 THEN 'Closed eyes' ELSE 'Open eyes' END AS reason FROM f)
        SELECT l_orderkey, reason = 'Closed eyes' AS closed, reason,
               CASE reason WHEN 'Closed eyes' THEN 'closed_eyes' WHEN 'No faces detected' THEN 'no_face' WHEN 'Face too small - likely venue/decor shot' THEN 'no_face' ELSE 'open' END AS category FROM r""",
    "q40_venue_rule": """
        SELECT p_partkey, p_partkey % 3 <> 0 AND ((p_size > 25 AND p_partkey % 50 > 5 AND p_partkey % 50 < 35) OR (p_type = 'ECONOMY' AND p_partkey % 100 >= 85)) AS is_venue FROM part""",
    "q41_parse_reply": """
        SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'ERROR' ELSE upper(event_type) END AS status,
               CASE WHEN event_id % 17 = 0 THEN 0.0::DOUBLE WHEN event_id % 5 = 0 THEN 50.0::DOUBLE WHEN event_id % 5 = 1 THEN 0.0::DOUBLE WHEN event_id % 100 = 1 THEN 100.0::DOUBLE ELSE CAST(event_id % 100 AS DOUBLE) END AS confidence,
               CASE WHEN event_id % 17 = 0 THEN 'Invalid reply' ELSE 'user ' || user_id END AS reason FROM events""",
    "q42_reject_terms": """
        WITH d AS (SELECT doc_id, n_chars, regexp_matches(lower(text), 'no clear subject|poor composition|loser|clown') AS hit FROM documents)
        SELECT doc_id, CASE WHEN hit THEN 'REJECT' WHEN n_chars > 1000 THEN 'BEST' ELSE 'KEEP' END AS decision,
               CASE WHEN hit THEN least(CAST(doc_id % 100 AS DOUBLE), 74) ELSE CAST(doc_id % 100 AS DOUBLE) END AS score FROM d""",
    "q43_quality_weighted": """
        WITH s AS (SELECT l_orderkey, l_linenumber, least(l_extendedprice * 80 / 6e6, 1) AS r, CASE WHEN l_linenumber > 1 THEN least(l_linenumber - 1, 3) / 3.0::DOUBLE ELSE 0.5 END AS f,
                          l_quantity / 50 AS c, l_discount * 10 AS h, 1 - l_tax * 10 AS n, 1 - abs(127.5 - l_quantity * 5) / 127.5 AS e FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(least((least(r * 1.15, 1) * 0.15 + least(f * 1.15, 1) * 0.2 + least(c * 1.15, 1) * 0.15 + least(h * 1.15, 1) * 0.2 + least(n * 1.15, 1) * 0.15 + least(e * 1.15, 1) * 0.15) * 1.1, 1), 6) AS quality,
               round(e, 6) AS exposure FROM s""",
    "q44_rate_window": """
        SELECT a.event_id, count(*) AS in_window FROM events a JOIN events b ON b.user_id = a.user_id AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 60000000 AND epoch_us(a.ts) GROUP BY a.event_id""",
    "q45_backoff_table": "SELECT l_linenumber AS attempt, count(*) AS n, least(pow(2, l_linenumber - 1), 60) AS delay, count(*) * least(pow(2, l_linenumber - 1), 60) AS waited FROM lineitem GROUP BY l_linenumber",
    "q46_priority_order": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders",
    "q47_incremental_anti": "SELECT event_id, event_type FROM events WHERE event_id % 4 <> 0 AND event_type <> 'view'",
    "q48_stage_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("view", "click", "purchase", "signup", "error")) + " FROM events GROUP BY user_id",
    "q49_json_report": f"""{_select(50)}
        SELECT t.album, '{{"album":"' || t.album || '","total":' || any_value(total) || ',"errors":' || (SELECT count(*) FROM photos p WHERE p.album = t.album AND NOT ok) || ',"delivered":' || count(d.ord) || '}}' AS report
        FROM tgt t LEFT JOIN delivered d ON d.album = t.album GROUP BY t.album""",
    "q50_json_props": """
        SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS max_k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY event_type""",
    "q51_dir_group": f"""
        WITH p AS (SELECT page_id, regexp_replace({PATH}, '/?[^/]*$', '') AS dir FROM pages), r AS (SELECT *, (row_number() OVER (PARTITION BY dir ORDER BY page_id) - 1) // 25 AS part FROM p)
        SELECT dir, CAST(part AS BIGINT) AS part, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS pages FROM r GROUP BY 1, 2""",
    "q52_mean_embedding": "SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2",
    "q53_components": f"""WITH RECURSIVE {PAIRS},
        edge AS (SELECT id_a AS a, id_b AS b FROM allpairs WHERE similarity >= 0.66 UNION SELECT id_b, id_a FROM allpairs WHERE similarity >= 0.66),
        reach(node, other) AS (SELECT a, a FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other)
        SELECT node, min(other) AS component FROM reach GROUP BY node""",
    "q54_stream_equals_batch": f"SELECT {STAMP.format(t="date_trunc('hour', ts)")} AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "q55_session_gaps": f"""
        WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, {STAMP.format(t="min(ts)")} AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    "q58_api_stats": """
        SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(value) FILTER (WHERE event_type <> 'error'), 4) AS avg_duration
        FROM events GROUP BY user_id""",
    "q59_exposure_routing": f"""WITH {BLUR}
        SELECT event_id, CASE WHEN event_id % 100 > 30 THEN 'exposure' WHEN status = 'BLURRY' AND confidence >= 90 AND combined < 40 THEN 'blur' ELSE 'clear' END AS category FROM b""",
    "q60_verified_groups": f"""WITH RECURSIVE {PAIRS}, {_leaders("g", "SELECT 0 AS block, rank, id FROM hashes", "SELECT rank_a, rank_b FROM allpairs WHERE similarity >= 0.62")},
        m AS (SELECT g.id, dense_rank() OVER (ORDER BY lr) AS grp, h.rank, h.x, CASE WHEN h.embedding[2] > 1.5 THEN -1 ELSE h.label % 2 END AS face_count, h.label <> 9 AS has FROM g JOIN hashes h ON h.id = g.id),
        s AS (SELECT *, count(*) OVER w AS n, count(CASE WHEN has THEN 1 END) OVER w AS n_has, min(rank) OVER w AS first FROM m WHERE face_count >= 0 WINDOW w AS (PARTITION BY grp, face_count)),
        t AS (SELECT *, grp * 2 + face_count AS block FROM s WHERE n > 1),
        {_leaders("v", "SELECT block, rank, id FROM t WHERE face_count > 0 AND n_has >= 2 AND has",
                  f"SELECT a.rank AS rank_a, b.rank AS rank_b FROM t a JOIN t b ON a.block = b.block AND a.rank < b.rank AND a.has AND b.has WHERE {COS} >= 0.1")},
        u AS (SELECT id, lr AS lead FROM v UNION ALL SELECT id, first FROM t WHERE face_count = 0 OR n_has < 2)
        SELECT u.id, t.grp AS "group", t.face_count, dense_rank() OVER (ORDER BY lead) AS verified_id FROM u JOIN t ON t.id = u.id""",
    "q61_four_signal_pairs": f"""WITH {HASHES},
        c AS (SELECT a.id AS id_a, b.id AS id_b, 1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE AS h, round({COS}, 6) AS f, 1 - abs(a.label / 9.0::DOUBLE - b.label / 9.0::DOUBLE) AS s
              FROM hashes a JOIN hashes b ON a.label % 3 = b.label % 3 AND a.id < b.id)
        SELECT id_a, id_b, CASE WHEN h >= 0.68 THEN 'hash' WHEN f >= 0.30 AND id_a % 2 = 0 THEN 'face' WHEN s >= 1.0 THEN 'background' END AS reason, round(0.30::DOUBLE * h + 0.40::DOUBLE * f + 0.30::DOUBLE * s, 5) AS similarity
        FROM c WHERE h >= 0.68 OR f >= 0.32 OR 0.4::DOUBLE * h + 0.3::DOUBLE * f + 0.3::DOUBLE * s >= 0.60""",
    "q62_same_faces": """
        WITH line AS (SELECT *, row_number() OVER () AS face FROM lineitem),
        n AS (SELECT o_orderkey AS id, any_value(o_custkey) AS album, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
        p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS n_faces FROM n a JOIN n b ON a.album = b.album AND a.n = b.n AND a.id < b.id),
        best AS (SELECT id_a, id_b, n_faces, fa.face, max(1 - abs(fa.l_quantity - fb.l_quantity) / 50) AS best
                 FROM p JOIN line fa ON fa.l_orderkey = id_a JOIN line fb ON fb.l_orderkey = id_b GROUP BY 1, 2, 3, 4)
        SELECT id_a, id_b, n_faces, count(*) FILTER (WHERE best >= 0.85) AS matched FROM best GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE best >= 0.85) >= 0.8 * n_faces""",
    "q63_batch_number": f"WITH {PHOTOS} SELECT album, ord, CAST((row_number() OVER (PARTITION BY album ORDER BY ord) - 1) // 25 AS BIGINT) AS batch FROM photos",
    "q64_merge_last_wins": "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2",
    "q65_batch_statistics": f"""WITH {PHOTOS}
        SELECT album, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures, round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) AS per_second FROM photos GROUP BY album""",
    "q66_group_merge_votes": f"""WITH RECURSIVE {PAIRS}, {_leaders("g", "SELECT 0 AS block, rank, id FROM hashes", "SELECT rank_a, rank_b FROM allpairs WHERE similarity >= 0.66")},
        m AS (SELECT dense_rank() OVER (ORDER BY lr) AS grp, h.h, row_number() OVER (PARTITION BY lr ORDER BY h.rank) AS rn FROM g JOIN hashes h ON h.id = g.id QUALIFY rn <= 3),
        v AS (SELECT a.grp AS group_a, b.grp AS group_b, avg(CASE WHEN 1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE >= 0.5 THEN 1.0 ELSE 0.0 END) AS ratio FROM m a JOIN m b ON b.grp > a.grp GROUP BY 1, 2)
        SELECT group_a, group_b, round(ratio, 6) AS ratio FROM v WHERE ratio >= 0.7""",
    "q67_directory_counts": f"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n_files, count(DISTINCT regexp_replace({PATH}, '/?[^/]*$', '')) AS n_dirs FROM pages GROUP BY 1",
    "q68_two_sources": """
        WITH a AS (SELECT 'input' AS source, c_nationkey || '-' || CAST(floor(c_acctbal / 10) AS BIGINT) AS stem, c_custkey AS id FROM customer),
        b AS (SELECT 'in_focus' AS source, s_nationkey || '-' || CAST(floor(s_acctbal / 10) AS BIGINT) AS stem, s_suppkey AS id FROM supplier)
        SELECT * FROM a UNION SELECT * FROM b WHERE stem NOT IN (SELECT stem FROM a)""",
    "q69_decisions": """
        WITH e AS (SELECT *, user_id % 2 = 0 AS even, CASE event_type WHEN 'purchase' THEN 'BEST' WHEN 'click' THEN 'PASS' ELSE 'KEEP' END AS decision FROM events)
        SELECT event_id, even AND value >= 90 AS venue,
               CASE WHEN value >= 75 AND (decision = 'BEST' OR even) THEN CASE WHEN user_id % 5 = 0 THEN 'rejected' ELSE 'best_quality' END ELSE 'other' END AS best,
               decision = 'PASS' AND value >= 50 AND user_id % 7 <> 0 AS passes,
               CASE WHEN even AND user_id % 3 <> 0 THEN 'duplicate' WHEN value < 5 THEN 'closed_eyes' WHEN value < 20 THEN 'blurry' WHEN value < 45 THEN 'out_of_focus' END AS reason,
               event_type = 'error' OR user_id % 7 = 0 AS logged
        FROM e""",
    "q70_group_candidate": """
        SELECT l_orderkey, l_linenumber * 100000 + l_suppkey AS best, l_quantity * 2 AS best_score FROM lineitem WHERE l_discount <= 0.05 AND l_quantity * 2 >= 85
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber * 100000 + l_suppkey) = 1""",
    "q71_group_records": f"""WITH RECURSIVE {PAIRS}, {_leaders("g", "SELECT 0 AS block, rank, id FROM hashes", "SELECT rank_a, rank_b FROM allpairs WHERE similarity >= 0.66")},
        m AS (SELECT dense_rank() OVER (ORDER BY lr) AS group_id, g.id, round(h.x[1], 4) AS score FROM g JOIN hashes h ON h.id = g.id),
        b AS (SELECT group_id, id AS best FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) = 1)
        SELECT m.group_id, best, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE id <> best) AS similar, string_agg(id || ':' || printf('%.4f', score), ',' ORDER BY id) AS scores, CAST(count(*) AS INTEGER) AS group_size
        FROM m JOIN b ON b.group_id = m.group_id GROUP BY m.group_id, best""",
    "q72_group_statistics": """
        WITH e AS (SELECT label, vec_id % 4 AS n, vec_id % 100 AS score, list_avg(CAST(embedding AS DOUBLE[])) AS mean FROM embeddings)
        SELECT row_number() OVER (ORDER BY count(*) DESC, label) AS place, label, count(*) AS size, round(avg(n), 6) AS average_count, round(avg(score) * 0.6::DOUBLE + avg(mean) * 0.4::DOUBLE, 6) AS quality FROM e GROUP BY label""",
    "q73_duplicate_counts": f"""WITH {GROUPS}, d AS (SELECT doc_id, CASE WHEN group_size > 1 THEN text_hash END AS g FROM documents JOIN grp ON text_hash = md5(text))
        SELECT count(*) AS processed, count(g) AS in_groups, count(g) - count(DISTINCT g) AS extra, count(*) - count(g) + count(DISTINCT g) AS "unique" FROM d""",
    "q74_group_similarity": f"""WITH RECURSIVE {PAIRS}, {_leaders("g", "SELECT 0 AS block, rank, id FROM hashes", "SELECT rank_a, rank_b FROM allpairs WHERE similarity >= 0.66")},
        m AS (SELECT dense_rank() OVER (ORDER BY lr) AS grp, h.* FROM g JOIN hashes h ON h.id = g.id),
        t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank) AS rn FROM m QUALIFY rn <= 3),
        v AS (SELECT a.grp AS ga, b.grp AS gb FROM t a JOIN t b ON b.grp > a.grp GROUP BY 1, 2 HAVING avg(CASE WHEN 1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE >= 0.56 THEN 1.0 ELSE 0.0 END) >= 0.7),
        f AS (SELECT grp, avg(label) AS mean FROM m GROUP BY grp)
        SELECT ga AS group_a, gb AS group_b, round(max({COS}), 6) AS similarity
        FROM v JOIN f fa ON fa.grp = ga JOIN f fb ON fb.grp = gb AND abs(fa.mean - fb.mean) <= 1 JOIN m a ON a.grp = ga JOIN m b ON b.grp = gb GROUP BY 1, 2""",
    "q75_retry_jitter": """
        SELECT event_id, round(least(pow(2, event_id % 8), 60) * (1 + 0.2::DOUBLE * (('0x' || substr(md5(event_id || ':' || (event_id % 8 + 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)), 6) AS delay FROM events""",
    "q76_strict_selection": _select(25).replace("PARTITION BY p.album ORDER BY ord)", "PARTITION BY p.album ORDER BY score DESC, ord)").replace("FROM recs WHERE score + boost >= 35", "FROM recs WHERE score + boost >= 35 AND ord IN (SELECT ord FROM photos WHERE ok)").replace("WHERE score >= 40 AND NOT chosen", "WHERE score >= 40 AND ord IN (SELECT ord FROM photos WHERE ok) AND NOT chosen") + " SELECT album, ord, score, tier FROM delivered",
    "q77_audit_report": f"""WITH {GROUPS},
        d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'BEST_' ELSE '' END || doc_id AS path, doc_id, best, group_size FROM documents JOIN grp ON text_hash = md5(text))
        SELECT 'duplicates' AS "check", 'group_' || best AS item, count(*) AS n FROM d WHERE group_size > 1 GROUP BY best HAVING count(*) > 1
        UNION ALL SELECT 'orphans', path, 1 FROM d WHERE group_size = 1 AND doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'missing categories', c, 0 FROM (VALUES ('best_quality'), ('duplicates'), ('closed_eyes'), ('blurry'), ('in_focus')) v(c)
                  WHERE c NOT IN (SELECT CASE WHEN quality = 1 THEN 'best_quality' ELSE 'blurry' END FROM labels)""",
}
