"""The queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, filter_audit, fingerprints, importance, language, line_dedup, mixing, near_dedup, secrets, suffix_dedup, token_store, toxicity
from .common import durable, remove, shared_dir, table

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_novel")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("text_key")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language.samples(docs, ~language.held_out(F.col("doc_id")))
    return language.identify(docs.select("doc_id", "text"), learned).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark)
    token_store.write(docs, path, public_tokenizers.path(WORD_VOCABULARY), end=1)
    return token_store.read(spark, path)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(*toxicity.learned(docs, labels, ~toxicity.held_out(F.col("doc_id"))))
    # n_swapped: how many of the rows learned from mention a group, and took part in the penalty.
    held_out, n_swapped = toxicity.held_out(F.col("doc_id")).alias("held_out"), F.lit(model["swapped"]).cast("long").alias("n_swapped")
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", "predicted", n_swapped)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.assign(table(spark, sf_dir, "documents"))
    first, every = F.get("positions", F.lit(0)), F.aggregate("positions", F.lit(0.0), lambda total, at: total + at)
    # Training times of a document's first word, from 0 to 1; documents that the mix leaves out have none.
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.round(first, 9).alias("position"), F.round(every, 8).alias("positions_sum"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_dir(spark)
    index = line_dedup.LineIndex(spark, path)
    index.insert(docs)
    found = durable(index.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))
    remove(spark, path)
    return found


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit(filter_audit.masks(docs, labels))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance.resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1's result that SQL can say: how many base spans of each kind a text has."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4's result that SQL can say: the edited texts, by digest."""
    return op4_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_near_dedup": op2_near_dedup,
    "op3_language": op3_language,
    "op4_fingerprint": op4_fingerprint,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_store": op6_token_store,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_source_mix": op10_source_mix,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_importance_resample": op13_importance_resample,
    "secret_counts": secret_counts,
    "edited_texts": edited_texts,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
               text_sha256
        FROM t""",
    "op10_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 md5('mix|' || coalesce(cast(doc_id AS VARCHAR), '')) AS mixed
          FROM documents),
        s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
        w AS (SELECT *, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM s),
        f AS (
          SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                     - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                    / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM w),
        g AS (SELECT arg_min(level, cap / weight * 1e3 + r) AS fill FROM f WHERE level * weight <= cap),
        t AS (SELECT source, source_size, r, least(cap, coalesce(fill * weight, cap)) AS target FROM f, g),
        c AS (
          SELECT d.doc_id, d.size, t.source_size, t.target, t.r,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mixed, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        u AS (
          SELECT *, greatest(0, least(size, floor(target) - start)) AS once, greatest(0, least(size, floor(target) - start - source_size)) AS again,
                 start::DOUBLE / nullif(target, 0) AS x1, (start + source_size)::DOUBLE / nullif(target, 0) AS x2
          FROM c),
        v AS (
          SELECT *,
                 CASE r % 3 WHEN 0 THEN 1.5::DOUBLE - sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * x1)) WHEN 1 THEN x1
                   ELSE CASE WHEN x1 < 0.3125 THEN (sqrt(0.0625::DOUBLE + 3.0::DOUBLE * x1) - 0.25::DOUBLE) / 1.5::DOUBLE
                             ELSE 0.5::DOUBLE + (sqrt(1.0::DOUBLE + 3.0::DOUBLE * (x1 - 0.3125::DOUBLE)) - 1.0::DOUBLE) / 1.5::DOUBLE END END AS at1,
                 CASE r % 3 WHEN 0 THEN 1.5::DOUBLE - sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * x2)) WHEN 1 THEN x2
                   ELSE CASE WHEN x2 < 0.3125 THEN (sqrt(0.0625::DOUBLE + 3.0::DOUBLE * x2) - 0.25::DOUBLE) / 1.5::DOUBLE
                             ELSE 0.5::DOUBLE + (sqrt(1.0::DOUBLE + 3.0::DOUBLE * (x2 - 0.3125::DOUBLE)) - 1.0::DOUBLE) / 1.5::DOUBLE END END AS at2
          FROM u)
        SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (once + again)::BIGINT AS taken,
               round(CASE WHEN once > 0 THEN at1 WHEN again > 0 THEN at2 END, 9) AS position,
               round(CASE WHEN once > 0 THEN at1 ELSE 0.0::DOUBLE END + CASE WHEN again > 0 THEN at2 ELSE 0.0::DOUBLE END, 8) AS positions_sum
        FROM v""",
    "op11_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        u AS (
          SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no, len(lines) AS n_lines FROM l),
        k AS (
          SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
        shared AS (
          SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        m AS (
          SELECT k.*, s.key IS NOT NULL AND s.owner <> k.doc_id AS dropped FROM k LEFT JOIN shared s USING (key))
        SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op12_filter_audit": r"""
        WITH t AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        m AS (
          SELECT doc_id, part,
                 (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
                 + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask
          FROM t),
        g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        cells AS (
          SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN g USING (doc_id) GROUP BY part, mask),
        f AS (SELECT unnest(range(5)) AS f),
        orders AS (
          SELECT a.f AS a, b.f AS b, c.f AS c, d.f AS d, e.f AS e FROM f a, f b, f c, f d, f e
          WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f),
        steps AS (
          SELECT array_to_string([substr('ABCDE', x::INT + 1, 1) for x in [a, b, c, d, e]], '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step,
                 unnest([a, b, c, d, e]) AS f,
                 unnest([0, 1 << a, (1 << a) + (1 << b), (1 << a) + (1 << b) + (1 << c), (1 << a) + (1 << b) + (1 << c) + (1 << d)]) AS before
          FROM orders),
        r AS (
          SELECT part, filter_order, step, f,
                 sum(CASE WHEN mask & (before | (1 << f)) = 0 THEN n ELSE 0 END) AS kept,
                 sum(CASE WHEN mask & before = 0 AND mask & (1 << f) > 0 THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN mask & before > 0 AND mask & (1 << f) > 0 THEN n ELSE 0 END) AS redundant,
                 sum(CASE WHEN mask = (1 << f) THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN mask & before = 0 AND mask & (1 << f) > 0 THEN good ELSE 0 END) AS good_lost,
                 sum(CASE WHEN mask & before = 0 AND mask & (1 << f) > 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM cells, steps GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM r""",
    "op13_importance_resample": r"""
        WITH RECURSIVE steps(n, c, k) AS (
          SELECT n, n, 0 FROM (SELECT unnest(range(256)) AS n)
          UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY n) AS tab FROM steps WHERE k = 8),
        texts AS (
          SELECT true AS corpus, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
        w AS (
          SELECT corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
        f AS (
          SELECT corpus, doc_id, unnest(list_concat(words, [words[i] || ' ' || words[i + 1] for i in range(1, len(words))])) AS feature FROM w),
        g AS (SELECT corpus, doc_id, feature, count(*) AS n FROM f GROUP BY ALL),
        bytes AS (
          SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM g)),
        b AS (
          SELECT feature, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(length(h) // 2)]),
                                          lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) % 10000 AS bucket
          FROM bytes, crc),
        n AS (SELECT corpus, doc_id, bucket, sum(n) AS n FROM g JOIN b USING (feature) GROUP BY ALL),
        c AS (SELECT bucket, coalesce(sum(n) FILTER (corpus), 0) AS s, coalesce(sum(n) FILTER (NOT corpus), 0) AS t FROM n GROUP BY bucket),
        a AS (SELECT sum(s)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM c),
        gain AS (
          SELECT bucket, floor(1000.0::DOUBLE * ln((t::DOUBLE + 1.0::DOUBLE) * (s_all + 10000.0::DOUBLE) / ((s::DOUBLE + 1.0::DOUBLE) * (t_all + 10000.0::DOUBLE))))::BIGINT AS gain FROM c, a),
        d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN gain USING (bucket) WHERE corpus GROUP BY doc_id),
        e AS (
          SELECT w.doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
          FROM w LEFT JOIN d USING (doc_id) WHERE corpus),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_words >= 20)
        SELECT e.doc_id, e.n_features, e.weight, e.score, CASE WHEN r.rank <= (SELECT 25 * count(*) // 100 FROM r) THEN r.rank END AS rank
        FROM e LEFT JOIN r USING (doc_id)""",
    "secret_counts": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
               len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
               len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
        FROM t""",
    "edited_texts": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
        o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next FROM t)
        SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 4) || substr(next, 1, n // 4)) AS edited_sha256 FROM o""",
}
