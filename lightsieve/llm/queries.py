"""The registered queries of this subpackage, with their SQL where SQL can express them on whole tables.

Each query applies its operator with production parameters to its whole table and derives digest columns from the
operator's real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsieve.llm import alignment, decontam, exact, lmscore, mixing, pii, quality, simhash, substrings, tokens, toxicity, variants, warc
from lightsieve.session import table

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.BASE)]
    return found.select("doc_id", *count, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.array_sort(F.concat("base", "found"))).alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents")).drop("keep_locator")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.cross_align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())
    return found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def exact_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's exact part, which SQL can express."""
    return op7_decontamination(spark, sf_dir).drop("n_near_items")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_personal_data, op2_simhash, op3_mixing, op4_toxicity, op5_lm_score, op6_exact_dedup, op7_decontamination, op8_token_counts, op9_substring_dedup, op10_quality, op11_spelling_variants, op12_cross_tokenizer, op13_warc, exact_phrases)
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
                   CAST('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
            FROM d GROUP BY source),
        o AS (
            SELECT *, 3 * source_size AS bound,
                   CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS left_size,
                   CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS left_weight,
                   row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST) AS place
            FROM s
            WINDOW b AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, CAST(left_size AS DOUBLE) * weight / left_weight >= bound AS capped FROM o),
        l AS (SELECT left_size AS f_size, left_weight AS f_weight FROM c WHERE NOT capped ORDER BY place LIMIT 1),
        t AS (SELECT source, source_size, u, CASE WHEN capped THEN CAST(bound AS DOUBLE) ELSE CAST(f_size AS DOUBLE) * weight / f_weight END AS target FROM c LEFT JOIN l ON true),
        r AS (
            SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
                   row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS rank
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, source, size, source_size, target,
               size * CAST(floor(e) + floor(u + (e - floor(e)) * rank) - floor(u + (e - floor(e)) * (rank - 1)) AS BIGINT) AS taken
        FROM r""",
    "op7_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        bw AS (
            SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (
            SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT r, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= s.n)),
        h AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, g)),
        words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r),
        phrases AS (
            SELECT row_number() OVER () AS q, item, size, terms, len(terms) AS n, CAST(ceil(0.75::DOUBLE * len(terms)) AS BIGINT) AS least
            FROM (SELECT item, least(13, len(w)) AS size, list_distinct(w[i : i + least(13, len(w)) - 1]) AS terms
                  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
                  WHERE (i - 1) % least(13, len(w)) = 0 OR i = len(w) - least(13, len(w)) + 1)),
        terms AS (SELECT q, unnest(terms) AS term FROM phrases),
        places AS (SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS j FROM d),
        candidate AS (
            SELECT r, q, any_value(item) AS item, any_value(size) AS size, any_value(least) AS least
            FROM (SELECT DISTINCT r, term FROM places) JOIN terms USING (term) JOIN phrases USING (q) GROUP BY r, q HAVING count(*) >= any_value(least)),
        occurring AS (SELECT r, q, j, term FROM candidate JOIN terms USING (q) JOIN places USING (r, term)),
        close AS (
            SELECT DISTINCT r, item
            FROM (SELECT r, q, x.j, count(DISTINCT y.term) AS n FROM occurring x JOIN candidate USING (r, q) JOIN occurring y USING (r, q) WHERE y.j >= x.j AND y.j < x.j + size + 7 GROUP BY r, q, x.j) JOIN candidate USING (r, q)
            WHERE n >= least),
        nears AS (SELECT r, count(*) AS n_near_items FROM close GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near_items, 0) AS n_near_items
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN nears USING (r)""",
    "exact_phrases": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        bw AS (
            SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (
            SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT r, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= s.n)),
        h AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, g)),
        words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op9_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM win JOIN again USING (g)),
        pos AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
        kept AS (SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS text FROM pos ANTI JOIN gone USING (r, j) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE runs AS (
            SELECT id, run, len(run) AS len, count(*) AS c
            FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
            WHERE len(run) >= 7 GROUP BY id, run),
        steps AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY i) AS step
            FROM range(256) r(i)),
        summed AS (
            SELECT run, len, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(bytes), 2), lambda k: CAST('0x' || substr(bytes, k, 2) AS BIGINT))),
                lambda a, b: xor(step[(xor(a, b) & 255) + 1], a >> 8))) AS h
            FROM (SELECT *, hex(encode(id || ':' || run)) AS bytes FROM runs), steps),
        words AS (
            SELECT word, CAST(sum(c) AS BIGINT) AS n
            FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len) || substr(run, h % len + 2) ELSE run END AS word, c FROM summed)
            GROUP BY word HAVING len(word) >= 7 AND sum(c) >= 2),
        cuts AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT *, unnest(range(1, len(word) + 1)) AS k FROM words)),
        near AS (
            SELECT a.word, a.n, b.word AS form, b.n AS form_n FROM cuts a JOIN cuts b USING (k, rest) WHERE a.word <> b.word
            UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
        counts AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
        forms AS (SELECT word, form, form_n FROM near WHERE form_n >= 10 * n QUALIFY row_number() OVER (PARTITION BY word ORDER BY form_n DESC, form) = 1),
        paths AS (
            SELECT word, form AS root, 1 AS depth FROM forms
            UNION ALL SELECT p.word, f.form, depth + 1 FROM paths p JOIN forms f ON f.word = p.root),
        roots AS (SELECT word, arg_max(root, depth) AS root FROM paths GROUP BY word)
        SELECT word, n, form, coalesce(root, word) AS root, coalesce(n_near, 0) AS n_near, form_n
        FROM words LEFT JOIN counts USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)""",
    "op13_warc": """
        WITH p AS (SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS body FROM pages),
        q AS (
            SELECT *, first_value(r) OVER g AS first_r, first_value(page_id) OVER g AS first_id
            FROM p WINDOW g AS (PARTITION BY body ORDER BY page_id NULLS LAST, r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        k AS (SELECT *, octet_length(body) >= 100 AND r <> first_r AS again FROM q)
        SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
        FROM k""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
