"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colsieve.llm.common import table

SHARDS = 40


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colsieve.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colsieve.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colsieve.llm.bpe import vocabulary
    from colsieve.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colsieve.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colsieve.llm.rules import BASE, FULL, fails, stored_ledger

    rows = stored_ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"), (~fails(FULL)).alias("kept"), "failed_bits")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colsieve.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colsieve.llm.bpe import encode_decode, vocabulary

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colsieve.llm.quality import grades_of, score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, grades_of(table(spark, sf_dir, "labels"))))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colsieve.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from colsieve.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_bpe": op7_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sharding": op9_sharding,
    "op10_nearest": op10_nearest,
}

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, payload_bytes, d.payload_digest,
               CASE WHEN f.first_id IS NOT NULL AND d.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id <> f.first_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
    """,
    "op5_quality_rules": r"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        g AS (
            SELECT doc_id, len(words) AS n, unnest(range(1, greatest(len(words) - 1, 1))) AS i,
                   unnest(list_transform(range(1, greatest(len(words) - 1, 1)), lambda k: hash(words[k], words[k + 1], words[k + 2]))) AS win
            FROM w WHERE len(words) >= 3),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 3) AS o(k) GROUP BY doc_id),
        m AS (
            SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                   len(lines) AS n_lines, len(list_filter(words, lambda x: ends_with(x, '!!'))) AS n_shouts
            FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
        b AS (
            SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
                   + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
                   + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END)
                   + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
                   + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
                   + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
                   + (CASE WHEN 100 * n_shouts > 20 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failed_bits
            FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
        FROM b
    """,
    "op6_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, sh FROM (
                SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
        n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.c + ny.c - i)),
        l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e UNION ALL SELECT doc_id, doc_id FROM documents),
        r AS (SELECT x AS doc_id, y AS reach FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x)
        SELECT r.doc_id, CAST(coalesce(min(n.c), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id, min(reach) = r.doc_id AS kept
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
}
