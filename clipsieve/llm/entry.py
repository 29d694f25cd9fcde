"""The operators' queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsieve.llm import classifier, decontam, lm, media, merkle, mixing, ngram_join, quality_rules, ranked_search, substring, toxicity, url_filter, warc
from clipsieve.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=5, held=0, threshold=0.5)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_score(table(spark, sf_dir, "documents"), mod=10, held=0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=4, held=2, threshold=0.7)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), lambda doc_id: F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 0)


# The columns of op2, op6, op7, op8, op10 and op11 that SQL can express (of op2: fields of its structs, as columns; of op8:
# sums of logarithms to six places), each from the same operator and parameters over whole tables.


def op2_warc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, field = F.coalesce("response", "revisit"), F.map_from_entries("metadata.fields")
    return op2_warc(spark, sf_dir).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("request.target_uri").alias("request_uri"), F.col("metadata.target_uri").alias("metadata_uri"), main["target_uri"].alias("main_uri"), main["digest"].alias("main_digest"),
        F.col("response.payload_bytes").alias("response_bytes"), F.element_at(field, "pageId").alias("about_page"), F.element_at(field, "payloadBytes").alias("about_bytes"), F.col("response").isNull().alias("is_revisit"),
    )


def op6_quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op7_url_filters_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("given"))


def op8_lm_scoring_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def op10_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target", (F.col("taken") <= 3 * F.col("size")).alias("within"))


def op11_media_columns_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_warc": op2_warc,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_decontamination": op4_decontamination,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_url_filters": op7_url_filters,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_mixing": op10_mixing,
        "op11_media_columns": op11_media_columns,
        "op12_ranked_search": op12_ranked_search,
        "op13_merkle_manifest": op13_merkle_manifest,
        "op2_warc_fields": op2_warc_fields,
        "op6_quality_rules_base": op6_quality_rules_base,
        "op7_url_filters_rules": op7_url_filters_rules,
        "op8_lm_scoring_base": op8_lm_scoring_base,
        "op10_mixing_targets": op10_mixing_targets,
        "op11_media_columns_payload": op11_media_columns_payload,
    }


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SIGN = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> {shift}) & 31 AS BIGINT) + 1, 1)"

_URI = "replace(replace(url, chr(13), '%0D'), chr(10), '%0A')"

OP2_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
part AS (SELECT page_id, h, k, CAST('0x' || substr(sha1(h), 5 * k + 1, 5) AS BIGINT) AS n FROM p, range(0, 8) t(k)),
d AS (SELECT page_id, CAST(octet_length(encode(any_value(h))) AS BIGINT) AS payload_bytes, string_agg({" || ".join(_SIGN.format(shift=s) for s in (15, 10, 5, 0))}, '' ORDER BY k) AS payload_digest FROM part GROUP BY page_id),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, {_URI} AS request_uri, {_URI} AS metadata_uri, {_URI} AS main_uri,
  payload_digest AS main_digest, CASE WHEN page_id = first THEN payload_bytes END AS response_bytes, CAST(page_id AS VARCHAR) AS about_page, CAST(payload_bytes AS VARCHAR) AS about_bytes, page_id <> first AS is_revisit FROM f JOIN pages USING (page_id)"""

#: Counts the common shingles of all pairs that have one: for small tables only, as those of the correctness check.
OP3_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0) z),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""

OP5_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50) z),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS o FROM win) z WHERE o < doc_id),
rem AS (SELECT DISTINCT doc_id, i + j AS i FROM bad, range(0, 50) t(j)),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.i) AS t, count(*) AS n FROM pos LEFT JOIN rem ON rem.doc_id = pos.doc_id AND rem.i = pos.i WHERE rem.i IS NULL GROUP BY pos.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


OP6_SQL = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 7], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8) z),
hit AS (SELECT DISTINCT doc_id, i + j AS at FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1) z, range(0, 8) r(j)),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m"""

OP7_SQL = """WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, '.' || host AS h FROM u)
SELECT page_id, host, path,
  CASE WHEN ends_with(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN ends_with(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN ends_with(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN ends_with(h, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
  CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block' WHEN 'com/de/' THEN 'block' END AS given FROM r"""

#: Sources in the order in which they reach three times their size; the first that doesn't, and all after it, share the rest.
OP10_SQL = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, encode(source)) AS r FROM s),
p AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share FROM o),
k AS (SELECT r AS k, rest, share FROM p WHERE most >= rest * weight / share ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN r >= (SELECT k FROM k) THEN (SELECT rest FROM k) * weight / (SELECT share FROM k) ELSE most END AS target FROM p)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, true AS within FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
d AS MATERIALIZED (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n FROM w WHERE len(ws) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM w) z WHERE term IN (SELECT term FROM q) GROUP BY ALL),
v AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, c GROUP BY term),
s AS (SELECT item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN d USING (r), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10"""

#: crc32 of a list b of bytes, bit by bit; DuckDB has none. Fixed value: the polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"


def _bytes(blob: str) -> str:
    """The bytes of a blob as a list, read from its hexadecimal digits."""
    return f"list_transform(range(1, octet_length({blob}) + 1), lambda i: CAST('0x' || substr(hex({blob}), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c}), '-')"


OP11_SQL = f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
p AS (SELECT doc_id, octet_length(t) AS n, t || repeat('\x00'::BLOB, CASE WHEN octet_length(t) = 0 THEN 64 ELSE (64 - octet_length(t) % 64) % 64 END) AS x FROM d),
e AS (SELECT *, unhex(right(hex(x), 128)) AS y FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(octet_length(x) AS BIGINT) AS payload_bytes, sha256(x) AS payload_sha256, CAST({_CRC} AS BIGINT) AS tail_crc32 FROM (SELECT *, {_bytes("y")} AS b FROM e) z"""

#: A blank, which no word is, is the end.
OP8_SQL = f"""WITH w AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, list_append(list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') AS ws
  FROM (SELECT *, {_bytes("encode(doc_id::VARCHAR)")} AS b FROM documents) z),
t AS (SELECT doc_id, held_out, unnest(ws) AS token FROM w),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
m AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 6) AS base_score FROM t LEFT JOIN c USING (token), m GROUP BY doc_id, held_out"""

_LEAF = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "{n}", "text"))) + ")"

#: Trees level by level: g is a lang and, for the tree above, 'all'; each row of up is a node, its place and its level's size.
OP13_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="n_chars + CASE WHEN z.r % 7 = 0 THEN 1 ELSE 0 END")} AS seen,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, {_CRC} AS r FROM (SELECT *, {_bytes("encode(doc_id::VARCHAR)")} AS b FROM documents)) z),
up AS (SELECT lang AS g, 0 AS level, i, n, leaf AS h FROM d
  UNION ALL SELECT g, any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, i // 2),
s AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g IS NOT NULL, encode(g)) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, i, n, h FROM s
  UNION ALL SELECT any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY i // 2),
nodes AS MATERIALIZED (SELECT false AS above, g, level, i, h FROM up UNION ALL SELECT true, NULL, level, i, h FROM top),
walk AS (SELECT row_number() OVER (ORDER BY d.lang, d.i) AS k, false AS above, d.lang AS g, 0 AS level, d.i, d.n, s.i AS si, s.n AS sn, seen AS h, '' AS path FROM d JOIN s ON s.g IS NOT DISTINCT FROM d.lang
  UNION ALL SELECT k, w.above OR w.n = 1, w.g, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN si ELSE w.i // 2 END, CASE WHEN w.n = 1 THEN sn ELSE (w.n + 1) // 2 END, si, sn,
    CASE WHEN w.n = 1 THEN w.h WHEN w.i % 2 = 1 THEN sha256(x.h || w.h) ELSE sha256(w.h || coalesce(x.h, '')) END, CASE WHEN w.n = 1 THEN path ELSE path || coalesce(x.h, '') END
    FROM walk w LEFT JOIN nodes x ON x.above = w.above AND (w.above OR x.g IS NOT DISTINCT FROM w.g) AND x.level = w.level AND x.i = xor(w.i, 1) AND w.n > 1 WHERE NOT (w.above AND w.n = 1)),
e AS (SELECT g, k, h, path FROM walk WHERE above AND n = 1)
SELECT d.doc_id, d.lang, d.leaf, s.h AS subroot, t.h AS root, sha256(e.path) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM (SELECT *, row_number() OVER (ORDER BY lang, i) AS o FROM d) d JOIN s ON s.g IS NOT DISTINCT FROM d.lang JOIN (SELECT h FROM top WHERE n = 1) t ON true JOIN e ON e.k = d.o"""


def oracle_sql() -> dict[str, str]:
    """The queries whose every column SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op2_warc_fields": OP2_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op5_substring_dedup": OP5_SQL,
        "op6_quality_rules_base": OP6_SQL, "op7_url_filters_rules": OP7_SQL, "op8_lm_scoring_base": OP8_SQL, "op10_mixing_targets": OP10_SQL,
        "op11_media_columns_payload": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_merkle_manifest": OP13_SQL,
    }
