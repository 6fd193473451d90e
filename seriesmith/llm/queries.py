"""The registered queries of the numbered operators and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import cut, scratch_path
from . import bpe, decontaminate, filter_audit, language_model, licenses, line_dedup, ngram_join, quality, repeats, toxicity, url_filter, warc, whitening
from .common import ORACLES, QUERIES, query, table  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"

SQL_QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(lines.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
         FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM f GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS m, var_pop(k / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 0), 1e6) ELSE 1e6 END AS weight FROM p),
r AS (SELECT source, (k + m * weight) / (n + weight) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source"""


@query("op6_quality_rules", SQL_QUALITY)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept")


SQL_DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
m AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
bj AS (SELECT item_id, least(13, len(ws)) AS k, j, array_to_string(ws[j:j + least(13, len(ws)) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS j FROM b WHERE len(ws) > 0)),
mj AS (SELECT DISTINCT doc_id, item_id, i, i - j AS diagonal, dw.k FROM dw JOIN bj ON dw.k = bj.k AND dw.g = bj.g),
run AS (SELECT doc_id, min(i) AS i, count(*) + any_value(k) - 1 AS n
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS part FROM mj) GROUP BY doc_id, item_id, diagonal, part),
lg AS (SELECT doc_id, max(n) AS n, arg_min(i - 1, struct_pack(a := -n, b := i)) AS place FROM run GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated,
       coalesce(lg.n, 0)::BIGINT AS longest_words, lg.place::BIGINT AS longest_place
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN lg USING (doc_id)"""


@query("op8_decontaminate", SQL_DECONTAMINATE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
                      "longest_words", "longest_place")


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_ngram_jaccard")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL_LM = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, ws[p] AS g1, CASE WHEN p > 1 THEN ws[p - 1] || ' ' || ws[p] END AS g2,
             CASE WHEN p > 2 THEN ws[p - 2] || ' ' || ws[p - 1] || ' ' || ws[p] END AS g3
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS c1,
             CASE WHEN g2 IS NOT NULL THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY doc_id, g2) END AS c2,
             CASE WHEN g3 IS NOT NULL THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY doc_id, g3) END AS c3,
             count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS total FROM w),
x AS (SELECT *, lag(c1) OVER q AS b1, lag(c2) OVER q AS b2 FROM c WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) + CASE WHEN c3 = 0 THEN ln(0.4) ELSE 0 END
             ELSE ln(greatest(c1, 0.4) / greatest(total, 1)) + ln(0.4) * ((c3 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT) END AS l,
             coalesce(c3 = 0, false) OR coalesce(c2 = 0, false) AND NOT coalesce(c3 > 0, false) AS back FROM x)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_back, 0) AS n_backed_off, round(coalesce(ls, 0), 4) AS log_score,
       round(CASE WHEN len(ws) > 0 THEN ls / len(ws) END, 4) AS mean_log_score
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE back) AS n_back, sum(l) AS ls FROM s GROUP BY doc_id) USING (doc_id)"""


@query("op1_stupid_backoff", SQL_LM)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model.score(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(cut(toxicity.training_rows(docs, table(spark, sf_dir, "labels"))))
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.find_licenses(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct("matches.license"))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
                      F.coalesce(F.array_max("matches.percent"), F.lit(0)).alias("best_percent"))


SQL_WARC = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h"""


@query("op5_warc", SQL_WARC)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    rows = warc.read(spark, folder, with_payload=False).filter("type in ('response', 'revisit')")
    return rows.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("long"))


SQL_LINES = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
c AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
k AS (SELECT line, first, n, n // 2 AS x, unnest([n // 2, CASE WHEN n % 2 = 0 THEN n // 2 - 1 ELSE n // 2 + 1 END]) AS h FROM c WHERE n >= 20),
pre AS (SELECT DISTINCT a.line, a.first FROM k a JOIN k b ON a.h = b.h AND left(a.line, a.h) = left(b.line, b.h)
        WHERE b.first < a.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) = 1),
suf AS (SELECT DISTINCT a.line, a.first FROM k a JOIN k b ON a.h = b.h AND right(a.line, a.h) = right(b.line, b.h)
        WHERE b.first < a.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) = 1),
near AS (SELECT line FROM pre UNION SELECT line FROM suf),
j AS (SELECT l.doc_id, l.pos, l.line, c.line IS NULL OR (c.first = (l.doc_id, l.pos) AND near.line IS NULL) AS keep
      FROM l LEFT JOIN c ON l.line = c.line LEFT JOIN near ON l.line = near.line)
SELECT d.doc_id, count(j.pos) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS kept_sha256
FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id"""


@query("op9_line_dedup", SQL_LINES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.dedup_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
m AS (SELECT part, doc_id, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
             + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
             + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM d JOIN f USING (text)),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
             list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS seen
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
e AS (SELECT part, filter_order, step, mask, n, good, toxic, bit, mask & bit > 0 AS fails, mask & coalesce(seen, 0)::INT > 0 AS gone FROM c, s)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // nullif(bit_count(mask), 0)) FILTER (WHERE fails), 0)::BIGINT AS shapley
FROM e GROUP BY part, filter_order, step"""


@query("op11_filter_audit", SQL_AUDIT)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_url_filter")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
