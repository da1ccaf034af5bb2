"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation, html_extract, licenses, mixing, nn_descent, packing, periodic, pii, quality, secrets, simhash, substring, url_filter
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark)).select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join("found", ",").alias("kinds"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations")))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_pii, op3_url_filters, op4_simhash, op5_quality_rules, op6_packing, op7_embedding_near_dedup, op8_substring_dedup, op9_mixing, op10_secret_scans, op11_conversation_repair, op12_license_scans, op13_periodic_runs)}


def _quality_sql() -> str:
    classes = list(quality.CLASSES.values())
    listed = {k: v.split() for k, v in quality.COMMON_WORDS.items()}
    width = len(next(iter(listed.values())))
    quoted = lambda p: p.replace("'", "''")
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '{quoted(p)}', '', 'g')) AS c{i}" for i, p in enumerate(classes))
    word = lambda i: "CASE " + " ".join(f"WHEN lang = '{k}' THEN len(list_filter(w, lambda x: x = '{v[i]}'))" for k, v in listed.items()) + " END"
    n, m = len(classes), width
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

    def distance(letter: str, k: int) -> str:
        total, ref = " + ".join(f"h.{letter}{i}" for i in range(k)), " + ".join(f"r.{letter}{i}" for i in range(k))
        p, q = (lambda i: f"(h.{letter}{i} / greatest(({total})::DOUBLE, 1.0))"), (lambda i: f"(r.{letter}{i} / greatest(({ref})::DOUBLE, 1.0))")
        return "sqrt(greatest(0, " + " + ".join(f"({part(p(i), q(i))} + {part(q(i), p(i))}) / 2" for i in range(k)) + "))"

    return f"""
WITH d AS (SELECT doc_id, lang, coalesce("text", '') AS t, list_filter(regexp_split_to_array(coalesce("text", ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce("text", ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
b AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, length(t) AS size, {counts}, {", ".join(f"{word(i)} AS w{i}" for i in range(m))} FROM d),
h AS (SELECT *, size - ({" + ".join(f"c{i}" for i in range(n))}) AS c{n}, n_words - ({" + ".join(f"w{i}" for i in range(m))}) AS w{m} FROM b),
r AS (SELECT lang, {", ".join(f"sum(c{i})::DOUBLE AS c{i}" for i in range(n + 1))}, {", ".join(f"sum(w{i})::DOUBLE AS w{i}" for i in range(m + 1))} FROM h WHERE n_words >= {quality.MIN_WORDS} GROUP BY lang),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS win FROM x),
z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM y WHERE len(win) = 5),
u AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM z, range(5) AS g(k) WHERE n > 1 GROUP BY doc_id),
j AS (SELECT h.doc_id, n_words, size - h.c{list(quality.CLASSES).index("space")} AS word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CASE WHEN n_words >= {quality.MIN_WORDS} THEN {distance("c", n + 1)} END AS cd, CASE WHEN n_words >= {quality.MIN_WORDS} AND h.w0 IS NOT NULL THEN {distance("w", m + 1)} END AS wd
    FROM h LEFT JOIN u USING (doc_id) LEFT JOIN r ON h.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(cd, 0) <= {quality.CHAR_LIMIT} AND coalesce(wd, 0) <= {quality.WORD_LIMIT} AS kept FROM j
"""


_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM x),
k AS (SELECT doc_id, i, sha256(array_to_string(win, ' ')) AS h FROM y WHERE len(win) = 20),
z AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS later FROM k),
c AS (SELECT x.doc_id, x.i, x.word, coalesce(max(z.later::INT) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM x LEFT JOIN z ON x.doc_id = z.doc_id AND x.i = z.i),
s AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""

ORACLE_SQL = {"op5_quality_rules": _quality_sql(), "op12_license_scans": licenses.sql(), "op8_substring_dedup": _SUBSTRING_SQL}
