"""The operators of this subpackage as named queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.llm import (
    chat,
    exact_dedup,
    licenses,
    minhash,
    mixing,
    packing,
    phrases,
    quality_model,
    quality_rules,
    repeats,
    resharding,
    runs,
    simhash,
)
from ledgerlake.llm.tables import table


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, folder, "documents"))


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.find_repeats(table(spark, folder, "documents"))


def op3_resharding(spark: SparkSession, folder: str) -> DataFrame:
    return resharding.place(table(spark, folder, "documents"))


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.find_near_copies(table(spark, folder, "documents"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan_mix(table(spark, folder, "documents"))


def op7_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.digest(chat.format_conversations(rows.unionByName(hard)))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.find_runs(table(spark, folder, "documents"), tail=runs.circular_tail)


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.find_similar(table(spark, folder, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found}


def all_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t)
        """,
        "op5_license_scan": licenses.sql(),
        "op6_source_mix": r"""
            WITH d AS (
                SELECT doc_id, source, coalesce(text, '') AS t,
                       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
                FROM documents),
            s AS (
                SELECT source, sum(size)::DOUBLE AS source_size,
                       [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
                FROM d GROUP BY source),
            -- Sources by how soon they reach their cap; the first j are clamped.
            o AS (
                SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS j FROM s),
            l AS (
                SELECT o.j, o.cap / o.weight AS reach,
                       ((SELECT sum(source_size) FROM s) * 1.5 - coalesce((SELECT sum(p.cap) FROM o p WHERE p.j < o.j), 0))
                       / (SELECT sum(p.weight) FROM o p WHERE p.j >= o.j) AS level
                FROM o),
            f AS (SELECT level FROM l WHERE reach > level ORDER BY j LIMIT 1),
            p AS (
                SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM f)), cap)::DOUBLE AS target,
                FROM o),
            q AS (
                SELECT d.doc_id, d.source, d.size, p.source_size::BIGINT AS source_size, p.target,
                       CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END::BIGINT AS whole,
                       md5('6:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(d.t)) AS draw
                FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
            r AS (
                SELECT *, round(target)::BIGINT - whole * source_size
                          - coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing
                FROM q)
            SELECT doc_id, source, size, source_size, target,
                   (whole * size + greatest(0, least(size, missing)))::BIGINT AS taken
            FROM r
        """,
        "op10_chat_format": r"""
            WITH c AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
            s AS (
                SELECT *, CASE WHEN regexp_matches(text, '###|</turn>|\\[bhe]')
                               THEN replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') ELSE text END AS shown FROM c)
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(length(role) + length(shown) + 15)::BIGINT AS formatted_chars
            FROM s GROUP BY conv_id
        """,
        "op11_collocations": r"""
            WITH d AS (
                SELECT coalesce(lang, 'und') AS lang,
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                FROM documents),
            p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
            i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
            s AS (SELECT lang, unnest([array_to_string(w[i:i + k], ' ') FOR k IN range(0, 5) IF i + k <= len(w)]) AS phrase FROM i),
            f AS (SELECT lang, phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 100),
            n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
            c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f),
            k AS (SELECT *, unnest(range(1, len(w))) AS k FROM c),
            x AS (
                SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, n.n,
                       (1000::HUGEINT * k.a * n.n // (l.f::HUGEINT * r.f))::BIGINT AS score
                FROM k JOIN n ON n.lang = k.lang
                JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k.k], ' ')
                JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k.k + 1:], ' ')),
            y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            z AS (
                SELECT DISTINCT lang, a, unnest([array_to_string(w[:len(w) - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase
                FROM c WHERE len(w) > 2)
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
            FROM y ANTI JOIN z USING (lang, phrase, a)
            QUALIFY rank <= 2000
        """,
        "op8_quality_rules": r"""
            WITH d AS (
                SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
                FROM documents),
            windows AS (
                SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
                FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
            places AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
            covered AS (
                SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM places) GROUP BY r),
            m AS (
                SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                       len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
                FROM d LEFT JOIN covered USING (r))
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
                   n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 5 * n_symbols > n_words
                        OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
                        OR 2 * n_upper > word_chars) AS kept
            FROM m
        """,
    }
