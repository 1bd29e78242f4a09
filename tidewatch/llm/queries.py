"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import alignment, chat, exact, language, licenses, lines, mixing, near, packing, pii, quality, runs, substrings
from tidewatch.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@_query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@_query(
    "op2_exact_dedup",
    """
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t,
             regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain
      FROM documents),
    g AS (
      SELECT plain, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id
      FROM d GROUP BY plain)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.plain) AS text_sha256
    FROM d JOIN g USING (plain)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


@_query("op3_chat_formatting")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_chats(rows.unionByName(extra)))


@_query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = language.learn(docs.where(~F.col("held_out")))
    return language.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


@_query(
    "op5_mixing",
    """
    WITH d AS (
      SELECT doc_id, source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, ''))) AS row_key
      FROM documents),
    s AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
    o AS (
      SELECT *, 3 * source_size / w AS r,
             row_number() OVER (ORDER BY 3 * source_size / w, source) AS k FROM s),
    p AS (
      SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
    level AS (
      SELECT coalesce(first(CAST(total - 3 * capped AS DOUBLE) / CAST(free AS DOUBLE) ORDER BY k), 0.0) AS l
      FROM p WHERE CAST(total - 3 * capped AS DOUBLE) / CAST(free AS DOUBLE) * w <= 3 * source_size),
    t AS (
      SELECT source, source_size,
             CASE WHEN l * w > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE l * w END AS target
      FROM s, level),
    e AS (
      SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
             CAST(concat('0x', substr(md5(d.row_key), 1, 8)) AS BIGINT) / 4294967296.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
    FROM e
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    taken = F.col("size") * F.col("copies").cast("long")
    return planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@_query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


@_query("op7_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(documents(spark, sf_dir))


@_query(
    "op8_line_dedup",
    """
    WITH d AS (
      SELECT doc_id, source, text, string_split(text, chr(10)) AS ls,
             trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS page FROM documents),
    one AS (
      SELECT source, page, unnest(list_distinct(list_transform(ls,
               lambda x: regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')))) AS line FROM d),
    totals AS (SELECT source, count(DISTINCT page) AS pages FROM d GROUP BY source),
    bad AS (
      SELECT one.source, one.line FROM one JOIN totals ON one.source IS NOT DISTINCT FROM totals.source
      WHERE one.line <> '' GROUP BY one.source, one.line, totals.pages
      HAVING count(DISTINCT one.page) >= 3 AND count(DISTINCT one.page) > CAST(0.05 AS DOUBLE) * totals.pages),
    all_lines AS (
      SELECT doc_id, source, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM d),
    marked AS (
      SELECT a.doc_id, a.raw, a.i, b.line IS NOT NULL AS dropped FROM all_lines a LEFT JOIN bad b
      ON a.source IS NOT DISTINCT FROM b.source
         AND b.line = regexp_replace(a.raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')),
    per AS (
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
             string_agg(raw, chr(10) ORDER BY i) FILTER (NOT dropped) AS t FROM marked GROUP BY doc_id)
    SELECT d.doc_id, coalesce(per.n_lines, 0) AS n_lines, coalesce(per.n_dropped, 0) AS n_dropped,
           CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(per.t, '')) END AS text_sha256
    FROM d LEFT JOIN per USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@_query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir).select("doc_id", "text")))


@_query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir).select("doc_id", "text")))


@_query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return runs.digest(runs.find_runs(docs.withColumn("text", runs.with_planted_runs(F.col("doc_id"), F.col("text")))))


@_query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir).select("doc_id", "text")).drop("groups")


@_query("op13_repeated_substrings")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
