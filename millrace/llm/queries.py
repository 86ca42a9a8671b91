"""One query opN_<name> per operator, over its whole table, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embeddings, fingerprints, langid, lines, mixing, quality, simhash, tokenfile, trie, urls, warc
from .common import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


@query(
    "op7_mix_sources",
    r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(n - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM totals)
), levels AS (
  SELECT *, cap / w AS ratio,
    ((SELECT sum(source_size) FROM totals)::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, w * (SELECT first(lvl ORDER BY ratio, n) FROM levels WHERE lvl <= ratio)) AS target
  FROM levels
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM sized
), crossed AS (
  SELECT p.doc_id, p.source, p.size, t.source_size, t.target, p.place,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each_,
    ('0x' || substr(md5('42:' || coalesce('s' || p.source, 'n')), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, least(floor(each_ * place + u) - floor(each_ * (place - 1) + u), ceil(each_))::BIGINT AS copies FROM crossed
)
SELECT doc_id, source, size, source_size, target, copies::INTEGER AS copies, copies * size AS taken
FROM taken
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


@query("op8_simhash_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.withColumn("held_out", quality.held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "score", "predicted"
    )


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(tokenizer_path("word_bpe_49k.json"))
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    files = tokenfile.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return tokenfile.read_token_files(files).select(
        F.col("id").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


URL_ROUNDS = 10


def _url_sql(rounds: int = URL_ROUNDS) -> str:
    """Rules and ranks of op4 in SQL, a common table for each round."""
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in urls.RULES)
    href = urls.HREF.replace("'", "''")
    after = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) END"
    host = "coalesce(translate(regexp_extract({a}, '^([^/?#]*)', 1), '" + urls.UPPER + "', '" + urls.LOWER + "'), '')"
    steps = "\n".join(
        f"""r{k} AS (SELECT kind, host, sum(r) AS r FROM (SELECT * FROM r0 UNION ALL
            SELECT s.kind, s.dst, r.r * s.share * 0.85::DOUBLE FROM r{k - 1} r JOIN steps s ON r.kind = s.kind AND r.host = s.src)
            GROUP BY ALL),"""
        for k in range(1, rounds + 1)
    )
    return f"""
WITH parsed AS (
  SELECT page_id, html, {host.format(a=after.format(u='url'))} AS host,
    coalesce(regexp_extract({after.format(u='url')}, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(action, of_host, prefix) AS (VALUES {rules}), ruled AS (
  SELECT p.page_id, any_value(p.host) AS host, any_value(p.path) AS path,
    arg_max(r.of_host || r.prefix, length(r.of_host || r.prefix)) AS rule, arg_max(r.action, length(r.of_host || r.prefix)) AS action
  FROM parsed p LEFT JOIN rules r
    ON (p.host = r.of_host OR ends_with(p.host, '.' || r.of_host)) AND starts_with(p.path, r.prefix)
  GROUP BY p.page_id
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (action = 'allow') AS good, count(*) FILTER (action = 'block') AS bad
  FROM ruled WHERE host <> '' GROUP BY host
), weights AS (
  SELECT 'trust' AS kind, host, good AS w FROM hosts WHERE good > bad
  UNION ALL SELECT 'distrust', host, bad FROM hosts WHERE bad * 2 > n
), r0 AS (
  SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) * 0.15::DOUBLE AS r FROM weights
), hrefs AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM parsed
), found AS (
  SELECT src, CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END AS link FROM hrefs
), links AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, {host.format(a=after.format(u='link'))} AS dst FROM found)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
), both_ways AS (
  SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links
), steps AS (
  SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways
), {steps} spread AS (
  SELECT host, coalesce(sum(r) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(r) FILTER (kind = 'distrust'), 0) AS distrust
  FROM r{rounds} GROUP BY host
), suspects AS (
  SELECT host FROM spread WHERE distrust > 0 AND round(distrust, 12) >= round((trust + distrust) * 0.5, 12)
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host IN (FROM suspects) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


@query("op4_url_filter", _url_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), rounds=URL_ROUNDS).withColumnRenamed("id", "page_id")


@query(
    "op9_warc",
    """
WITH sized AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), hashed AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM sized
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM hashed
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM grouped
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.with_revisits(table(spark, sf_dir, "pages"))
    archives = warc.normalise(warc.write_archives(pages, fresh_path(spark, "warc")))
    return warc.read_records(archives).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op10_document_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_next(table(spark, sf_dir, "documents"))
    found = found.withColumn("edited_sketch", fingerprints.sketch_of(F.col("edited_marks.packed"), F.col("edited_marks.letters")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.written_out(F.col("sketch")).alias("fingerprint"),
        fingerprints.written_out(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.aligned(F.col("anchors"), F.col("edited_marks.packed")).alias("aligned_edited"),
    )


@query(
    "op3_embedding_dedup",
    """
WITH RECURSIVE vectors AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
), sound AS (
  SELECT * FROM vectors WHERE len(e) > 0 AND list_bool_and([coalesce(isfinite(x), false) FOR x IN e]) AND list_bool_or([x <> 0 FOR x IN e])
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
), links AS MATERIALIZED (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach AS (
  SELECT vec_id, vec_id AS other FROM vectors UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(other) AS component_id, min(other) = vec_id AS kept
FROM reach LEFT JOIN counted ON a = vec_id GROUP BY vec_id
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_dedup(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op12_source_divergence", divergence.audit_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op11_conversation_trie", trie.trie_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
