"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, conversations, decontaminate, divergence, ngram_join, pii, quality, sharding, simhash, substring, toxicity, warc
from .common import table

SHARD_BYTES = 1 << 20


def op1_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(table(spark, folder, "documents"), digests=True)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.written(table(spark, folder, "documents"), SHARD_BYTES)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link_components(table(spark, folder, "documents"), k=3, share=90)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.extract(table(spark, folder, "documents"))


def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, folder, "conversations")), times="times")


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_ngram_join": op7_ngram_join,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_neighbours": op10_neighbours,
    "op11_conversations": op11_conversations,
    "op12_divergence": op12_divergence,
    "op13_simhash": op13_simhash,
}

SQL = {
    "op1_substrings": """
        WITH w AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
        windows AS (
            SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
        repeats AS (
            SELECT doc_id, s FROM (
                SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
        removed AS (SELECT DISTINCT doc_id, s + o AS p FROM repeats, range(0, 20) r(o)),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
            FROM words ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
            sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_sharding": f"""
        WITH counted AS (
            SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, count(*) AS n FROM documents GROUP BY 1, 2),
        slim AS (
            SELECT doc_id, bytes, copy::INT AS copy, ('0x' || substr(md5(
                coalesce(doc_id::VARCHAR, 'null') || ':' || bytes || ':' || copy), 1, 15))::BIGINT AS h
            FROM (SELECT doc_id, bytes, unnest(range(1, n + 1)) AS copy FROM counted)),
        at_depth AS (SELECT s.*, d.depth::INT AS depth, h >> (60 - d.depth) AS prefix FROM slim s, range(0, 61) d(depth)),
        buckets AS (
            SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM at_depth GROUP BY 1, 2),
        fitting AS (
            SELECT a.doc_id, a.copy, a.bytes, a.depth, a.prefix, shard_bytes, shard_rows,
                row_number() OVER (PARTITION BY a.doc_id, a.bytes, a.copy ORDER BY a.depth) AS k
            FROM at_depth a JOIN buckets b ON a.depth = b.depth AND a.prefix = b.prefix
            WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1)
        SELECT doc_id, copy, bytes, depth, prefix, shard_bytes, shard_rows FROM fitting WHERE k = 1""",
    "op7_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT o.a, o.b FROM shared o JOIN sizes x ON o.a = x.doc_id JOIN sizes y ON o.b = y.doc_id
            WHERE 100 * i >= 90 * (x.n + y.n - i)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (
            SELECT doc_id, doc_id AS other FROM w
            UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a)
        SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id
        FROM w LEFT JOIN sizes USING (doc_id) JOIN reached USING (doc_id) GROUP BY ALL""",
    "op8_warc": """
        WITH rows AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        last AS (SELECT hex, max(page_id) AS page_id FROM rows GROUP BY hex)
        SELECT r.page_id, strlen(r.html)::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + (((('0x' || substr(r.hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4)::INT))) & 31), 1)),
                'string_agg', '') AS payload_digest,
            CASE WHEN l.page_id > r.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN l.page_id > r.page_id THEN l.page_id END AS refers_to
        FROM rows r JOIN last l USING (hex)""",
    "op12_divergence": """
        WITH words AS (
            SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                coalesce(text, '') AS text FROM documents)),
        kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
        groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        every AS (
            SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
            FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
        shares AS (
            SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g)::HUGEINT AS p,
                1 + (1000000000::HUGEINT * (total + 1)) // (sum(total) OVER g + count(*) OVER g)::HUGEINT AS q
            FROM every WINDOW g AS (PARTITION BY lang, source)),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY 1, 2, 3),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
        SELECT * FROM (
            SELECT lang, source, part, item, value,
                (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found)
        WHERE part = 'pair' OR rank <= 200""",
}
