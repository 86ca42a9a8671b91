"""Queries of the engine's own operators over the test tables, with the DuckDB SQL that checks them.

Names begin with the operator's number. Every query runs over whole tables and whole texts. Queries without SQL are those
that draw from a generator or walk JSON or XML beyond what SQL can say; tests hold these against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.rng import u01, u01_sql
from ..operators import augment, corrupt, curriculum, decode, enrich, gates, generate, metrics, mixture, sampling, tokens, trees
from ..operators.placing import spread
from ..sources import jsonl
from . import augment_sql, corrupt_sql

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


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["f01_json_to_xml"](spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs made from the tables


def agent_json(docs: DataFrame) -> DataFrame:
    """(sample_id, input, target): an agent's answer for even ids, a tool call for odd ones, as compact JSON and XML."""
    odd = F.col("doc_id") % 2 == 1
    tool = F.when(odd, F.struct(F.struct(F.col("text").alias("query")).alias("arguments"), F.lit("search").alias("tool_name")))
    body = F.struct(
        F.when(~odd, F.col("text")).alias("answer"), F.array("lang", "source").alias("memory"), F.col("text").alias("thought"), tool.alias("tool")
    )
    rows = spread(docs).select(F.col("doc_id").alias("sample_id"), F.to_json(body).alias("input"))
    return rows.withColumn("target", fn.json_to_xml("input"))


def raw_lines(docs: DataFrame) -> DataFrame:
    """(line_no, raw): records of each kind that the wrap gates tell apart, by doc_id modulo 8."""
    k = F.col("doc_id") % 8
    memory = F.array("lang", "source")
    thought = F.concat(F.lit("thinking of "), "text")
    good = F.to_json(F.struct(F.col("text").alias("answer"), memory.alias("memory"), thought.alias("thought")))
    raw = (
        F.when(k == 0, F.concat(good, F.lit("}")))
        .when(k == 1, F.to_json(memory))
        .when(k == 2, F.to_json(F.struct(F.col("text").alias("answer"))))
        .when(k == 3, F.to_json(F.struct(thought.alias("thought"))))
        .when(k == 4, F.to_json(F.struct(F.col("text").alias("answer"), F.lit("short ü").alias("thought"))))
        .when(k == 5, F.to_json(F.struct(F.col("text").alias("answer"), F.array().cast("array<string>").alias("memory"), thought.alias("thought"))))
        .otherwise(good)
    )
    return spread(docs).select(F.col("doc_id").alias("line_no"), raw.alias("raw"))


RAW_REASON = """CASE doc_id % 8 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'not_object' WHEN 2 THEN 'missing_thought'
  WHEN 3 THEN 'answer_or_tool' WHEN 4 THEN 'short_thought' WHEN 5 THEN 'bad_memory' END"""


def cdata_sql(c: str) -> str:
    return f"'<![CDATA[' || replace({c}, ']]>', ']]]]><![CDATA[>') || ']]>'"


def object_sql(fields: dict[str, str], level: int = 0) -> str:
    """The XML of a flat object whose values are SQL expressions, as a SQL expression."""
    pad = "  " * level
    entries = "".join(
        f"<NL>{pad}  <entry><NL>{pad}    <key>{k}</key><NL>{pad}    <value>' || {v} || '</value><NL>{pad}  </entry>" for k, v in sorted(fields.items())
    )
    return ("'" + f"{pad}<object>{entries}<NL>{pad}</object>" + "'").replace("<NL>", "' || chr(10) || '")


DOC_XML = object_sql({"doc_id": "doc_id", "lang": cdata_sql("lang"), "n_chars": "n_chars", "source": cdata_sql("source"), "text": cdata_sql("text")}) + " || chr(10)"


# --- JSON and XML


@query("f01_json_to_xml", f"SELECT doc_id, {DOC_XML} AS xml FROM documents")
def f01(spark: SparkSession, d: str) -> DataFrame:
    text = F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars"))
    return spread(table(spark, d, "documents")).select("doc_id", fn.json_to_xml(text).alias("xml"))


@query("f01_json_to_xml_native", f"SELECT doc_id, {DOC_XML} AS xml FROM documents")
def f01_native(spark: SparkSession, d: str) -> DataFrame:
    fields = {"doc_id": F.col("doc_id").cast("string"), "lang": fn.cdata("lang"), "n_chars": F.col("n_chars").cast("string"), "source": fn.cdata("source"), "text": fn.cdata("text")}
    parts = [F.lit("<object>\n")]
    for k, v in sorted(fields.items()):
        parts += [F.lit(f"  <entry>\n    <key>{k}</key>\n    <value>"), v, F.lit("</value>\n  </entry>\n")]
    return table(spark, d, "documents").select("doc_id", F.concat(*parts, F.lit("</object>\n")).alias("xml"))


@query("p01_json_valid", "SELECT event_id, json_valid(props) AS whole, false AS extra FROM events")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.json_valid("props").alias("whole"), fn.json_valid(F.concat("props", F.lit("}"))).alias("extra"))


@query("p03_is_tool", "SELECT doc_id AS sample_id, doc_id % 2 = 1 AS is_tool FROM documents")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return agent_json(table(spark, d, "documents")).select("sample_id", fn.is_tool("input").alias("is_tool"))


@query("f02_compact_json", "SELECT event_id, '{\"k\":' || (props->>'$.k') || '}' AS compact FROM events")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.compact_json("props").alias("compact"))


@query("f02_pretty_json", "SELECT event_id, '{' || chr(10) || '  \"k\": ' || (props->>'$.k') || chr(10) || '}' AS pretty FROM events")
def f02_pretty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.pretty_json("props").alias("pretty"))


@query("f09_sorted_keys", "SELECT c_custkey, list_sort(['name', 'segment', c_mktsegment, 'Key']) AS keys FROM customer")
def f09(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*[x for k in (F.lit("name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("Key")) for x in (k, F.lit(1))])
    return table(spark, d, "customer").select("c_custkey", fn.sorted_keys(m).alias("keys"))


#: Six texts made of the XML of a document, chosen by its text: as it is, cut, with a comment, with a bare sign, twice,
#: and with an element that is closed by another name.
VARIANT = "('0x' || substr(md5(text), 1, 4))::BIGINT % 6"


def xml_variants(docs: DataFrame) -> DataFrame:
    rows = spread(docs).select("doc_id", "text", fn.json_to_xml(F.to_json(F.struct("text"))).alias("x"))
    made = F.array(
        F.col("x"), F.expr("substring(x, 1, length(x) - 4)"), F.concat("x", F.lit("<!-- end -->")), F.concat(F.lit("<a>&</a>"), F.col("x")),
        F.concat("x", "x"), F.replace("x", F.lit("</object>"), F.lit("</objekt>")),
    )
    which = F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("int") % 6
    return rows.select("doc_id", F.get(made, which).alias("x"))


@query("p09_xml_well_formed", f"SELECT doc_id, {VARIANT} IN (0, 2, 4) AS ok FROM documents")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return xml_variants(table(spark, d, "documents")).select("doc_id", fn.xml_well_formed("x").alias("ok"))


@query("p10_xml_document", f"SELECT doc_id, {VARIANT} IN (0, 2) AS ok FROM documents")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return xml_variants(table(spark, d, "documents")).select("doc_id", fn.xml_document("x").alias("ok"))


@query("p11_xml_root_prefix", "SELECT page_id, regexp_matches(ltrim(html), '^<(object|array)>') AS root FROM pages")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fn.xml_root_prefix("html").alias("root"))


@query("p15_xml_same_meaning", "SELECT doc_id, true AS spaced, regexp_full_match(text, '\\s*') AS other FROM documents")
def p15(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).select("doc_id", "text", fn.json_to_xml(F.to_json(F.struct("text"))).alias("x"))
    other = fn.json_to_xml(F.to_json(F.struct(F.lit("").alias("text"))))
    return rows.withColumn("o", other).select("doc_id", fn.xml_same_meaning("x", F.replace("x", F.lit("\n  <"), F.lit("\n\n <"))).alias("spaced"), fn.xml_same_meaning("x", "o").alias("other"))


@query(
    "p16_same_structure",
    "SELECT doc_id, length(text) % 4 = 0 AS same FROM documents",
)
def p16(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("<object><entry><key>a</key><value>"), F.regexp_replace("text", "[<>]", ""), F.lit("</value></entry></object>"))
    entry = "<entry><key>a</key><value></value></entry>"
    others = [f"<object>{entry}</object>", "<object></object>", f"<object>{entry}{entry}</object>", f"<array>{entry}</array>"]
    other = F.get(F.array(*map(F.lit, others)), F.length("text") % 4)
    return table(spark, d, "documents").select("doc_id", fn.same_structure(x, other).alias("same"))


@query("f07_flatten_xml", "SELECT event_id, 10 AS n, props->>'$.k' AS v FROM events")
def f07(spark: SparkSession, d: str) -> DataFrame:
    flat = fn.flatten_xml(fn.json_to_xml("props"))
    return table(spark, d, "events").select("event_id", flat.alias("f")).select("event_id", F.size("f").alias("n"), F.get("f", F.lit(6))["val"].alias("v"))


# --- predicates and text functions


@query("p04_length_range", "SELECT doc_id FROM documents WHERE strlen(text) BETWEEN 1500 AND 4769")
def p04(spark: SparkSession, d: str) -> DataFrame:
    return sampling.length_range(table(spark, d, "documents"), "text", 1500, 4769).select("doc_id")


@query("p12_identifier_like", "SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z0-9_]{1,50}$') AS name, regexp_matches(p_brand, '^[A-Za-z0-9_]{1,50}$') AS brand FROM part")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.identifier_like("p_name").alias("name"), fn.identifier_like("p_brand").alias("brand"))


@query("p13_needs_cdata", "SELECT page_id, regexp_matches(url, '[<>&\"'']') AS url, regexp_matches(html, '[<>&\"'']') AS html FROM pages")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fn.needs_cdata("url").alias("url"), fn.needs_cdata("html").alias("html"))


@query("p14_quote_escaped", "SELECT event_id, event_id % 4 % 2 = 1 AS escaped FROM events")
def p14(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.concat("props", F.repeat(F.lit("\\"), (F.col("event_id") % 4).cast("int")))
    return table(spark, d, "events").select("event_id", fn.quote_escaped(prefix).alias("escaped"))


@query("p17_bernoulli", f"SELECT doc_id FROM documents WHERE {u01_sql(42, 'doc_id', 'gate')} * 100 < 30")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bernoulli(table(spark, d, "documents"), 30, "doc_id").select("doc_id")


@query("p18_content_mask", "SELECT l_orderkey, l_linenumber, [false, l_partkey > 15, l_suppkey > 15, false] AS mask FROM lineitem")
def p18(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(*[F.col(c).cast("int") for c in ("l_partkey", "l_partkey", "l_suppkey")], F.lit(0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.content_mask(ids).alias("mask"))


@query("f03_byte_levenshtein", "SELECT p_partkey, levenshtein(p_name || 'é', p_type || '中') AS edits FROM part")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.byte_levenshtein(F.concat("p_name", F.lit("é")), F.concat("p_type", F.lit("中"))).alias("edits"))


@query("f04_levenshtein", "SELECT c_custkey, levenshtein(c_name, c_mktsegment) AS edits FROM customer")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fn.levenshtein("c_name", "c_mktsegment").alias("edits"))


_COST = "CASE WHEN p[j[1]] = x.w THEN 0 ELSE greatest(len(p[j[1]]), len(x.w)) END"


@query(
    "f05_word_edits",
    f"""SELECT p_partkey, list_reduce([{{'row': [list_sum([len(w) FOR w IN p[:k]])::BIGINT FOR k IN range(len(p) + 1)], 'w': ''}}] || [{{'row': []::BIGINT[], 'w': w}} FOR w IN e],
          lambda a, x: {{'row': list_reduce([[a.row[1] + len(x.w)]] || [[k] FOR k IN range(1, len(p) + 1)],
            lambda r, j: r || [least(a.row[j[1]] + {_COST}, a.row[j[1] + 1] + len(x.w), r[-1] + len(p[j[1]]))]), 'w': ''}}).row[-1] AS edits
        FROM (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS p, string_split(p_name || ' ' || p_brand, ' ') AS e FROM part)""",
)
def f05(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", metrics.word_edits_udf(F.concat_ws(" ", "p_type", "p_name"), F.concat_ws(" ", "p_name", "p_brand")).alias("edits"))


@query("f06_normalise_space", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.normalise_space("text").alias("text"))


@query(
    "f08_xml_number",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS n,
       CASE WHEN l_partkey % 4 = 0 THEN CAST(l_partkey // 4 AS VARCHAR) ELSE (l_partkey // 4) || ['.25', '.5', '.75'][l_partkey % 4] END AS fraction,
       (l_suppkey % 9 + 1) || '.5e+' || (16 + l_linenumber) AS large, (l_suppkey % 9 + 1) || '.5e-0' || (4 + l_linenumber % 5 + 1) AS small FROM lineitem""",
)
def f08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.xml_number("l_quantity").alias("n"),
        fn.xml_number(F.col("l_partkey") / 4).alias("fraction"),
        *[fn.xml_number(F.concat(F.col("l_suppkey") % 9 + 1, F.lit(f".5e{sign}"), power).cast("double")).alias(name) for name, sign, power in (("large", "+", 16 + F.col("l_linenumber")), ("small", "-", 5 + F.col("l_linenumber") % 5))],
    )


@query("f23_boost", "SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, (1 - (1.0::DOUBLE - (1 - l_discount)) / 1.0 / 0.10::DOUBLE) * 1.0)) AS boost FROM lineitem")
def f23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.boost(F.lit(1.0), 1 - F.col("l_discount")).alias("boost"))


@query("f24_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS top FROM embeddings")
def f24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", fn.argmax("embedding").alias("top"))


@query(
    "f24_log_softmax",
    "SELECT vec_id, round(list_max(embedding) - m - ln(s), 6) AS best FROM (SELECT *, list_max(embedding) AS m, list_sum([exp(x::DOUBLE - list_max(embedding)) FOR x IN embedding]) AS s FROM embeddings)",
)
def f24_softmax(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.round(F.array_max(fn.log_softmax("e")), 6).alias("best"))


@query(
    "f24_top_k",
    "SELECT vec_id, list_transform(list_sort([{'v': -embedding[i], 'i': i - 1} FOR i IN range(1, len(embedding) + 1)])[1:5], lambda s: s.i::INTEGER) AS top FROM embeddings",
)
def f24_top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", fn.top_k("embedding", 5).alias("top"))


@query("f25_length_normalised", "SELECT doc_id, round(-3.5 / pow(greatest(n_chars, 1), 0.6), 9) AS score FROM documents")
def f25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(fn.length_normalised(F.lit(-3.5), "n_chars"), 9).alias("score"))


@query("f29_first_line", r"SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '```'))[1] AS line FROM conversations")
def f29(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", fn.first_line_unfenced("text").alias("line"))


@query("f30_object_lines", r"SELECT event_id FROM events WHERE regexp_matches(props, '^\s*\{')")
def f30(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(fn.object_line("props")).select("event_id")


@query("f31_capitalise", "SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS name FROM part")
def f31(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.capitalise("p_name").alias("name"))


def _noisy(i: int, column: str) -> str:
    u = [u01_sql(1, "(l_orderkey || '-' || l_linenumber)", f"{draw}{i}") for draw in "nv"]
    return f"CASE WHEN {column} > 15 AND {u[0]} < 0.3 THEN 16 + floor({u[1]} * 7984) ELSE {column} END::INTEGER"


@query("f21_token_noise", f"SELECT l_orderkey, l_linenumber, [l_partkey::INTEGER, {_noisy(1, 'l_suppkey')}, {_noisy(2, 'l_orderkey')}] AS ids FROM lineitem")
def f21(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(*[F.col(c).cast("int") for c in ("l_partkey", "l_suppkey", "l_orderkey")])
    rows = table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", fn.token_noise(ids, "key", 0.3, 8000).alias("ids"))


# --- gates and repair


@query("p05_wrap_gates", f"SELECT doc_id AS line_no, {RAW_REASON} AS reason FROM documents")
def p05(spark: SparkSession, d: str) -> DataFrame:
    return gates.wrap(raw_lines(table(spark, d, "documents"))).select("line_no", "reason")


@query("a01_count_by_reason", f"SELECT coalesce({RAW_REASON}, 'accepted') AS reason, count(*) AS n FROM documents GROUP BY 1")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return gates.by_reason(gates.wrap(raw_lines(table(spark, d, "documents"))))


@query("a02_totals", "SELECT count(*) FILTER (doc_id % 8 > 5) AS accepted, count(*) FILTER (doc_id % 8 <= 5) AS rejected, count(*) AS total FROM documents")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return gates.totals(gates.wrap(raw_lines(table(spark, d, "documents"))))


def repair_records(part: DataFrame) -> DataFrame:
    """A broken text and two fixes of it, with rows for each reason, by p_partkey modulo 6."""
    k, text = F.col("p_partkey") % 6, F.concat_ws(" ", "p_name", "p_type", "p_brand", F.repeat("p_name", 4))
    fix = F.to_json(F.struct(text.alias("a"), F.col("p_size").alias("n")))
    return part.select(
        "p_partkey",
        F.when(k == 0, "").when(k == 4, F.substring(fix, F.lit(1), F.floor(F.length(fix) / 2).cast("int"))).otherwise(F.substring(fix, F.lit(2), F.length(fix))).alias("original"),
        F.when(k == 1, F.concat(fix, F.lit("]"))).otherwise(fix).alias("fix_a"),
        F.when(k == 2, F.lit("{")).when(k == 3, F.to_json(F.struct(F.repeat("p_type", 20).alias("b")))).otherwise(F.concat(F.lit(" "), fix)).alias("fix_b"),
    )


@query(
    "p07_repair_gates",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'bad_record' WHEN 1 THEN 'fix_a_invalid_json' WHEN 2 THEN 'fix_b_invalid_json'
       WHEN 3 THEN 'fixes_disagree' WHEN 4 THEN 'too_many_changes' END AS reason FROM part""",
)
def p07(spark: SparkSession, d: str) -> DataFrame:
    return gates.repair(repair_records(table(spark, d, "part"))).select("p_partkey", "reason")


@query("p08_change_pct", "SELECT p_partkey, round(100.0 * levenshtein(p_name, p_type) / greatest(strlen(p_name), 1), 9) AS pct FROM part")
def p08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(gates.change_pct(F.col("p_name"), F.col("p_type")), 9).alias("pct"))


@query("j02_remaining_rejects", "SELECT doc_id AS line_no FROM documents WHERE doc_id % 8 <= 5 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def j02(spark: SparkSession, d: str) -> DataFrame:
    rejects = gates.wrap(raw_lines(table(spark, d, "documents"))).where("reason IS NOT NULL")
    return gates.remaining(rejects, table(spark, d, "labels").select(F.col("doc_id").alias("line_no"))).select("line_no")


# --- corruption


@query("c01_strip_all_quotes", r"""SELECT event_id, regexp_replace(props, '"(\w{1,50})"', '\1', 'g') AS text FROM events""")
def c01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", corrupt.without_name_quotes(F.col("props")).alias("text"))




def item_json():
    return F.concat(F.lit('{"a": "x, '), "l_returnflag", F.lit(': y", "n": ['), "l_linenumber", F.lit(", "), "l_partkey", F.lit('], "s": "'), "l_linestatus", F.lit('"}'))


@query(
    "c02_drop_all_commas",
    """SELECT l_orderkey, l_linenumber, '{"a": "x, ' || l_returnflag || ': y" "n": [' || l_linenumber || ' ' || l_partkey || '] "s": "' || l_linestatus || '"}' AS text FROM lineitem""",
)
def c02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", corrupt.without_signs(",", item_json()).alias("text"))


@query(
    "c03_drop_all_colons",
    """SELECT l_orderkey, l_linenumber, '{"a" "x, ' || l_returnflag || ': y", "n" [' || l_linenumber || ', ' || l_partkey || '], "s" "' || l_linestatus || '"}' AS text FROM lineitem""",
)
def c03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", corrupt.without_signs(":", item_json()).alias("text"))


@query("c05_trailing_commas", r"""SELECT event_id, regexp_replace(props, '([^,{\[\s])(\s*[}\]])', '\1,\2', 'g') AS text FROM events""")
def c05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", corrupt.with_trailing_commas(F.col("props")).alias("text"))


@query("c07_no_indent", "SELECT doc_id, array_to_string([ltrim(x) FOR x IN string_split(text, chr(10))], chr(10)) AS text FROM documents")
def c07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", corrupt.without_indent(F.col("text")).alias("text"))


@query(
    "c08_wrapper",
    f"SELECT event_id, {corrupt_sql.texts(corrupt.PREAMBLES)}[floor({u01_sql(42, 'event_id', 'pre')} * {len(corrupt.PREAMBLES)})::INT + 1] || props || "
    f"{corrupt_sql.texts(corrupt.POSTAMBLES)}[floor({u01_sql(42, 'event_id', 'post')} * {len(corrupt.POSTAMBLES)})::INT + 1] AS text FROM events",
)
def c08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", corrupt.wrapped(F.col("props"), "event_id", 42).alias("text"))


#: The compact JSON that agent_json makes of a document, and its pretty layout.
_DOC = {c: f"to_json({c})" for c in ("text", "lang", "source")}
AGENT_SQL = f"""(SELECT doc_id, CASE WHEN doc_id % 2 = 1
  THEN '{{"memory":[' || {_DOC["lang"]} || ',' || {_DOC["source"]} || '],"thought":' || {_DOC["text"]} || ',"tool":{{"arguments":{{"query":' || {_DOC["text"]} || '}},"tool_name":"search"}}}}'
  ELSE '{{"answer":' || {_DOC["text"]} || ',"memory":[' || {_DOC["lang"]} || ',' || {_DOC["source"]} || '],"thought":' || {_DOC["text"]} || '}}' END AS text FROM documents)"""
_PRETTY = {c: f"replace(replace(replace({v}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')" for c, v in _DOC.items()}
_N = "' || chr(10) || '"
PRETTY_SQL = f"""(SELECT doc_id, '{{' || CASE WHEN doc_id % 2 = 0 THEN '{_N}  "answer": ' || {_PRETTY["text"]} || ',' ELSE '' END
  || '{_N}  "memory": [{_N}    ' || {_PRETTY["lang"]} || ',{_N}    ' || {_PRETTY["source"]} || '{_N}  ],{_N}  "thought": ' || {_PRETTY["text"]}
  || CASE WHEN doc_id % 2 = 1 THEN ',{_N}  "tool": {{{_N}    "arguments": {{{_N}      "query": ' || {_PRETTY["text"]} || '{_N}    }},{_N}    "tool_name": "search"{_N}  }}' ELSE '' END || '{_N}}}' AS text FROM documents)"""


def agent_xml_sql() -> str:
    """The XML of the same JSON, as an expression over documents."""
    line = lambda level, x: f"'{'  ' * level}{x}' || chr(10)"
    entry = lambda level, key, value: [line(level, "<entry>"), line(level + 1, f"<key>{key}</key>"), *value, line(level, "</entry>")]
    scalar = lambda level, v: [f"'{'  ' * level}<value>' || {v} || '</value>' || chr(10)"]
    inside = lambda level, body: [line(level, "<value>"), *body, line(level, "</value>")]
    text = cdata_sql("text")
    memory = entry(1, "memory", inside(2, [line(3, "<array>"), *scalar(4, cdata_sql("lang")), *scalar(4, cdata_sql("source")), line(3, "</array>")]))
    arguments = entry(4, "arguments", inside(5, [line(6, "<object>"), *entry(7, "query", scalar(8, text)), line(6, "</object>")]))
    tool = entry(1, "tool", inside(2, [line(3, "<object>"), *arguments, *entry(4, "tool_name", scalar(5, cdata_sql("'search'"))), line(3, "</object>")]))
    thought = entry(1, "thought", scalar(2, text))
    answer = " || ".join(entry(1, "answer", scalar(2, text)))
    first = f"CASE WHEN doc_id % 2 = 0 THEN {answer} ELSE '' END"
    last = f"CASE WHEN doc_id % 2 = 1 THEN {' || '.join(tool)} ELSE '' END"
    return " || ".join([line(0, "<object>"), first, *memory, *thought, last, line(0, "</object>")])


@query(
    "c09_corrupt_heavy",
    f"""WITH src AS (SELECT doc_id AS key, text, 'heavy' AS profile FROM {AGENT_SQL}), {corrupt_sql.profiled("src")}
        SELECT key AS sample_id, text AS input, xml AS target FROM corrupted JOIN (SELECT doc_id AS key, {agent_xml_sql()} AS xml FROM documents) USING (key)""",
)
def c09(spark: SparkSession, d: str) -> DataFrame:
    rows = agent_json(table(spark, d, "documents"))
    return rows.select("sample_id", corrupt.corrupted(F.col("input"), F.lit("heavy"), F.col("sample_id"), 42).alias("input"), "target")


def _single(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = agent_json(table(spark, d, "documents")).select("sample_id", fn.pretty_json("input").alias("input"))
        return rows.select("sample_id", corrupt.single(name, F.col("input"), F.col("sample_id"), 42).alias("input"))

    return run


for _number, (_name, _) in enumerate(corrupt.STEPS, 1):
    query(f"c{_number:02d}_seeded_{_name}", f"SELECT key AS sample_id, text AS input FROM ({corrupt_sql.single(_name, f'(SELECT doc_id AS key, text FROM {PRETTY_SQL})')})")(_single(_name))


_CHANCES = ", ".join(f"('{n}', " + ", ".join(f"{v}::DOUBLE" for v in p.__dict__.values()) + ")" for n, p in corrupt.PROFILES.items())


@query(
    "c10_profiles",
    f"""SELECT doc_id, t.* FROM (SELECT doc_id, {u01_sql(42, 'doc_id', 'plain')} AS u FROM documents)
        JOIN (VALUES {_CHANCES}) AS t(name, quote, comma, colon, "comment", wrapper, "trailing", whitespace, bracket)
        ON name = CASE WHEN u < 0.25 THEN 'none' WHEN u < 0.60 THEN 'light' WHEN u < 0.90 THEN 'medium' ELSE 'heavy' END""",
)
def c10(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "documents").select("doc_id", corrupt.profile_plain(u01(42, "doc_id", "plain")).alias("name"))
    return named.join(F.broadcast(corrupt.profiles_frame(spark)), "name")


@query(
    "c11_profile_mix",
    f"SELECT doc_id, CASE WHEN u < 0.40 THEN 'subtle' WHEN u < 0.75 THEN 'light' WHEN u < 0.90 THEN 'light+wrapper' ELSE 'medium' END AS profile FROM (SELECT doc_id, {u01_sql(42, 'doc_id', 'mix')} AS u FROM documents)",
)
def c11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", corrupt.profile_mix(u01(42, "doc_id", "mix")).alias("profile"))


@query(
    "c12_profile_stage",
    f"""SELECT doc_id, CASE WHEN s <= 3 THEN 'none' WHEN s = 4 THEN CASE WHEN u < 0.95 THEN 'none' WHEN u < 0.98 THEN 'subtle' ELSE 'light' END
        WHEN u < 0.90 THEN 'none' WHEN u < 0.95 THEN 'subtle' WHEN u < 0.98 THEN 'light' ELSE 'light+wrapper' END AS profile
        FROM (SELECT doc_id, doc_id % 5 + 1 AS s, {u01_sql(42, 'doc_id', 'stage')} AS u FROM documents)""",
)
def c12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", corrupt.profile_stage(F.col("doc_id") % 5 + 1, u01(42, "doc_id", "stage")).alias("profile"))


@query(
    "c13_profile_plain",
    f"SELECT doc_id, CASE WHEN u < 0.25 THEN 'none' WHEN u < 0.60 THEN 'light' WHEN u < 0.90 THEN 'medium' ELSE 'heavy' END AS profile FROM (SELECT doc_id, {u01_sql(42, 'doc_id', 'plain')} AS u FROM documents)",
)
def c13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", corrupt.profile_plain(u01(42, "doc_id", "plain")).alias("profile"))


_MIXED = "CASE WHEN {u} < 0.40 THEN 'subtle' WHEN {u} < 0.75 THEN 'light' WHEN {u} < 0.90 THEN 'light+wrapper' ELSE 'medium' END"


@query(
    "c14_corrupt_lines",
    f"""WITH src AS (SELECT doc_id AS key, text, CASE WHEN {u01_sql(42, 'doc_id', 'gate')} * 100 < 60 THEN {_MIXED.format(u=u01_sql(42, 'doc_id', 'mix'))} ELSE 'none' END AS profile FROM {AGENT_SQL}),
        {corrupt_sql.profiled("src")}
        SELECT key AS sample_id, text AS input, xml AS target FROM corrupted JOIN (SELECT doc_id AS key, {agent_xml_sql()} AS xml FROM documents) USING (key)""",
)
def c14(spark: SparkSession, d: str) -> DataFrame:
    return corrupt.corrupt_lines(agent_json(table(spark, d, "documents")), 42, 60)


# --- augmentation and enrichment


@query(
    "f14_shuffle_words",
    f"""SELECT conv_id, turn, array_to_string(list_transform(list_sort([{{'u': {augment_sql.u(42, "text", "w", "i")}, 'i': i, 'w': w[i + 1]}} FOR i IN range(len(w))]), lambda s: s.w), ' ') AS text
        FROM (SELECT conv_id, turn, conv_id || '-' || turn AS key, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)""",
)
def f14(spark: SparkSession, d: str) -> DataFrame:
    draws = corrupt.Draws(42, F.concat_ws("-", "conv_id", "turn"), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(augment.shuffled(augment.words_of(F.col("text")), draws), " ").alias("text"))


#: Conversations as trees: a record with its turns as an array of objects.
def conversation_trees(conversations: DataFrame) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    body = F.struct(F.col("conv_id").alias("id"), F.struct(F.size("turns").alias("n"), F.lit(True).alias("open")).alias("meta"), "turns")
    return conversations.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.to_json(body).alias("json"))


_F17 = augment.Settings(special=0.2, dict_pct=50.0)


def _f17_sql() -> str:
    role, text = (augment_sql.new_text(c, f"/turns/' || turn || '/{c}", _F17) for c in ("role", "text"))
    entry = lambda level, key, value: f"'{'  ' * level}<entry>{_N}{'  ' * (level + 1)}<key>{key}</key>{_N}{'  ' * (level + 1)}<value>' || {value} || '</value>{_N}{'  ' * level}</entry>{_N}'"
    item_json = f"'{{\"role\":' || {augment_sql.json_text('new_role')} || ',\"text\":' || {augment_sql.json_text('new_text')} || ',\"turn\":' || turn || '}}'"
    item_xml = f"'        <value>{_N}          <object>{_N}' || {entry(6, 'role', cdata_sql('new_role'))} || {entry(6, 'text', cdata_sql('new_text'))} || {entry(6, 'turn', 'turn')} || '          </object>{_N}        </value>{_N}'"
    meta = f"'  <entry>{_N}    <key>meta</key>{_N}    <value>{_N}      <object>{_N}' || {entry(4, 'n', 'n')} || {entry(4, 'open', chr(39) + 'true' + chr(39))} || '      </object>{_N}    </value>{_N}  </entry>{_N}'"
    return f"""
WITH given AS (SELECT *, conv_id AS key FROM conversations),
made AS (SELECT *, {role} AS new_role, {text} AS new_text FROM given),
items AS (SELECT conv_id, turn, {item_json} AS j, {item_xml} AS x FROM made),
whole AS (SELECT conv_id, count(*) AS n, string_agg(j, ',' ORDER BY turn) AS js, string_agg(x, '' ORDER BY turn) AS xs FROM items GROUP BY conv_id)
SELECT conv_id, '{{"id":' || conv_id || ',"meta":{{"n":' || n || ',"open":true}},"turns":[' || js || ']}}' AS compact,
  '<object>{_N}' || {entry(1, 'id', 'conv_id')} || {meta} || '  <entry>{_N}    <key>turns</key>{_N}    <value>{_N}      <array>{_N}' || xs || '      </array>{_N}    </value>{_N}  </entry>{_N}</object>{_N}' AS xml
FROM whole"""


@query("f17_rewrite_strings", _f17_sql())
def f17(spark: SparkSession, d: str) -> DataFrame:
    change = lambda leaf, path: augment.new_text(leaf, corrupt.Draws(42, F.col("conv_id"), F.concat(F.lit("text:"), path)), _F17.special, _F17.dict_pct)
    return trees.rewrite(conversation_trees(table(spark, d, "conversations")), "conv_id", "json", change).select("conv_id", "compact", "xml")


_F16 = augment.Settings(special=0.3)


@query("f16_inject_signs", f"""SELECT p_partkey, array_to_string([CASE WHEN {augment_sql.u(42, "signs", "t", "i")} < 0.3 THEN w[i + 1]
      || CASE WHEN style IN (1, 3) THEN ' ' ELSE '' END || ['<', '>', '&', '''', '"'][floor({augment_sql.u(42, "signs", "sign", "i")} * 5)::INT + 1]
      || CASE WHEN style IN (2, 3) THEN ' ' ELSE '' END ELSE w[i + 1] END FOR i IN range(len(w))], ' ') AS text
    FROM (SELECT p_partkey, p_partkey AS key, string_split(p_name || ' ' || p_type, ' ') AS w FROM part)""".replace("style", f"floor({augment_sql.u(42, 'signs', 'space', 'i')} * 4)"))
def f16(spark: SparkSession, d: str) -> DataFrame:
    words = augment.words_of(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, d, "part").select("p_partkey", augment.inject_signs(words, corrupt.Draws(42, F.col("p_partkey"), "signs"), 0.3).alias("text"))


_PAIRS_SQL = f"(SELECT d.doc_id, d.text, lang, source, a.text AS input, {agent_xml_sql().replace('(text', '(d.text')} AS xml FROM documents d JOIN {AGENT_SQL} a USING (doc_id))"
_F20 = augment.Settings(variants=3, sample_pct=50.0)


@query(
    "f20_augment_run",
    f"""WITH pairs AS MATERIALIZED (SELECT *, strlen(input) AS n FROM {_PAIRS_SQL} WHERE strlen(input) <= {_F20.max_bytes}),
    r AS (SELECT doc_id, (n >= 1500)::INT + (n >= 2500)::INT + (n >= 3500)::INT + (n >= 4500)::INT AS stratum, {u01_sql(42, 'doc_id', 'stratified')} AS u FROM pairs),
    c AS (SELECT s AS stratum, count(r.doc_id) AS cnt FROM range(5) t(s) LEFT JOIN r ON r.stratum = s GROUP BY 1),
    q AS (SELECT *, floor(floor((SELECT count(*) FROM r) * {_F20.sample_pct} / 100) / 5) AS q FROM c),
    p AS (SELECT *, greatest(cnt - q, 0) AS spare, sum(greatest(q - cnt, 0)) OVER () AS missing FROM q),
    t AS (SELECT stratum, least(cnt, q) + least(spare, greatest(missing - coalesce(sum(spare) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS take FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, doc_id) AS k FROM r),
    sampled AS (SELECT pairs.* FROM pairs JOIN n USING (doc_id) JOIN t USING (stratum) WHERE k <= take), {augment_sql.variants("sampled", _F20, cdata_sql)}
    SELECT * FROM made""",
)
def f20(spark: SparkSession, d: str) -> DataFrame:
    return augment.run(agent_json(table(spark, d, "documents")), _F20)


_A03 = augment.Settings(variants=2, truncate_pct=20.0)


@query(
    "a03_counters",
    f"""WITH pairs AS MATERIALIZED (SELECT * FROM {_PAIRS_SQL}), {augment_sql.variants("pairs", _A03, cdata_sql)}
    SELECT count(*) FILTER (variant_no = 0 AND input IS NOT NULL) AS natural, count(*) FILTER (variant_no > 0 AND input IS NOT NULL) AS augmented,
      count(*) FILTER (input IS NULL) AS failed, count(*) FILTER (corrupted) AS corrupted, count(*) FILTER (compacted) AS compacted, count(*) FILTER (truncated) AS truncated FROM made""",
)
def a03(spark: SparkSession, d: str) -> DataFrame:
    return augment.count_variants(agent_json(table(spark, d, "documents")), _A03)


def tool_calls(docs: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, [*enrich.VARIANTS, "unknown"]))
    return docs.select(F.col("doc_id").alias("sample_id"), F.get(names, F.pmod("doc_id", F.lit(10)).cast("int")).alias("tool_name"))


@query(
    "j01_choose_arguments",
    f"""WITH dim(tool_name, n) AS (VALUES {", ".join(f"('{t}', {len(v)})" for t, v in enrich.VARIANTS.items())}),
        calls AS (SELECT doc_id AS sample_id, {corrupt_sql.texts((*enrich.VARIANTS, "unknown"))}[doc_id % 10 + 1] AS tool_name FROM documents)
        SELECT sample_id, tool_name, coalesce(CASE WHEN {u01_sql(42, 'sample_id', 'enrich')} * 100 < 25 THEN floor({u01_sql(42, 'sample_id', 'variant')} * n)::INTEGER END, -1) AS variant_no
        FROM calls LEFT JOIN dim USING (tool_name)""",
)
def j01(spark: SparkSession, d: str) -> DataFrame:
    return enrich.choose(tool_calls(table(spark, d, "documents")), 25.0).select("sample_id", "tool_name", F.coalesce("variant_no", F.lit(-1)).alias("variant_no"))


@query("f19_enrich")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enrich(agent_json(table(spark, d, "documents")), 50.0)


@query(
    "a04_enriched_share",
    f"""SELECT count(*) FILTER (hit) AS enriched, count(*) AS tools, 100.0::DOUBLE * count(*) FILTER (hit) / greatest(count(*), 1) AS pct
        FROM (SELECT {u01_sql(42, 'doc_id', 'enrich')} * 100 < 50 AS hit FROM documents WHERE doc_id % 2 = 1)""",
)
def a04(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enriched_share(enrich.enrich(agent_json(table(spark, d, "documents")), 50.0))


# --- metrics


def predictions(part: DataFrame) -> DataFrame:
    """Answers that are right, spaced otherwise, or changed, by p_partkey modulo 3."""
    good = fn.json_to_xml(F.to_json(F.struct("p_brand", "p_name")))
    k = F.col("p_partkey") % 3
    rows = part.select(F.col("p_partkey").alias("sample_id"), good.alias("expected"), k.alias("k"))
    bad = F.replace("expected", F.lit("</object>"), F.lit(""))
    return rows.select("sample_id", "expected", F.when(F.col("k") == 0, F.col("expected")).when(F.col("k") == 1, F.replace("expected", F.lit("><"), F.lit("> <"))).otherwise(bad).alias("predicted"))


@query("f26_tiers", "SELECT p_partkey AS sample_id, ['EXACT', 'SEMANTIC', 'FAIL'][p_partkey % 3 + 1] AS tier FROM part")
def f26(spark: SparkSession, d: str) -> DataFrame:
    return metrics.score(predictions(table(spark, d, "part"))).select("sample_id", "tier")


@query("a05_count_by_tier", "SELECT ['EXACT', 'SEMANTIC', 'FAIL'][p_partkey % 3 + 1] AS tier, count(*) AS n FROM part GROUP BY 1")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_tier(metrics.score(predictions(table(spark, d, "part"))))


@query(
    "a06_error_rates",
    """SELECT round(sum(e)::DOUBLE / greatest(sum(n), 1), 12) AS cer, round(sum(p_size)::DOUBLE / greatest(sum(n), 1), 12) AS wer,
       round(count(*) FILTER (p_size % 7 = 0) / greatest(count(*), 1), 12) AS exact_rate, count(*) AS n
       FROM (SELECT levenshtein(p_name, p_type) AS e, length(p_type) AS n, p_size FROM part)""",
)
def a06(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.levenshtein("p_name", "p_type").alias("char_edits"), F.col("p_size").alias("word_edits"), F.length("p_type").alias("ref_chars"), (F.col("p_size") % 7 == 0).alias("exact"))
    return metrics.error_rates(rows).select(*[F.round(c, 12).alias(c) for c in ("cer", "wer", "exact_rate")], "n")


@query("a07_token_mean_loss", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean_loss FROM lineitem")
def a07(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_discount").alias("loss"), F.col("l_quantity").alias("n"))
    return metrics.token_mean_loss(rows).select(F.round("mean_loss", 9).alias("mean_loss"))


@query(
    "f22_weighted_loss",
    """SELECT l_orderkey, round(sum(l_tax * w) / greatest(sum(w), 1.0), 9) AS loss
       FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 0.0 WHEN l_partkey <= 15 THEN 1.0 ELSE 2.5 END AS w FROM lineitem) GROUP BY l_orderkey""",
)
def f22(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_linenumber") == 7, -100).otherwise(F.col("l_partkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", label.alias("label"), F.col("l_tax").alias("loss"))
    return metrics.weighted_loss(rows, ["l_orderkey"], 2.5).select("l_orderkey", F.round("loss", 9).alias("loss"))


@query(
    "a09_length_report",
    """SELECT CASE WHEN n_chars < 256 THEN '<256' WHEN n_chars < 512 THEN '<512' WHEN n_chars < 1024 THEN '<1024' ELSE '>=1024' END AS bucket,
       count(*) AS n, count(*) FILTER (lang = 'en') AS ok, round(avg(n_chars), 6) AS avg_src, round(avg(strlen(text)), 6) AS avg_tgt, round(avg(doc_id), 6) AS avg_time FROM documents GROUP BY 1""",
)
def a09(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select((F.col("lang") == "en").alias("xml_ok"), F.col("n_chars").alias("src_len"), F.octet_length("text").alias("tgt_len"), F.col("doc_id").alias("elapsed"))
    return metrics.length_report(rows).select("bucket", "n", "ok", *[F.round(c, 6).alias(c) for c in ("avg_src", "avg_tgt", "avg_time")])


@query(
    "a10_fault_kinds",
    """SELECT ['other', 'truncated', 'unclosed_tag', 'unclosed_cdata'][k + 1] AS kind, count(*) AS n
       FROM (SELECT CASE WHEN length(text) % 5 = 4 THEN NULL ELSE length(text) % 5 END AS k FROM documents) GROUP BY 1""",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).select(F.length("text").alias("n"), fn.json_to_xml(F.to_json(F.struct("text"))).alias("x"))
    cut = F.replace("x", F.lit("</object>"), F.lit(""))
    wrong = F.replace("x", F.lit("</value>"), F.lit("</object>"))
    broken = F.get(F.array(cut, cut, wrong, F.substring_index("x", "]]>", 1), F.col("x")), F.col("n") % 5)
    tokens_of = F.when(F.col("n") % 5 == 1, 4090).otherwise(F.lit(7))
    return docs.select(fn.xml_fault_kind(broken, tokens_of).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a11_index_percentiles",
    """SELECT s[floor(n * 0.5)::INT + 1] AS p50, s[floor(n * 0.95)::INT + 1] AS p95, s[floor(n * 0.99)::INT + 1] AS p99, s[1] AS min, s[-1] AS max
       FROM (SELECT list_sort(list(l_extendedprice)) AS s, count(*) AS n FROM lineitem)""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    return metrics.index_percentiles(table(spark, d, "lineitem"), "l_extendedprice")


@query(
    "a15_best_epoch",
    "SELECT epoch AS best_epoch FROM (SELECT o_orderkey AS epoch FROM orders ORDER BY o_custkey DESC, o_totalprice, o_orderkey LIMIT 1)",
)
def a15(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("epoch"), F.col("o_custkey").alias("ar_exact"), F.col("o_totalprice").alias("val_loss"))
    return metrics.best_epoch(log)


# --- samples, windows, sets


@query(
    "w01_stratified_sample",
    f"""WITH r AS (SELECT doc_id, (strlen(text) >= 1500)::INT + (strlen(text) >= 2500)::INT + (strlen(text) >= 3500)::INT + (strlen(text) >= 4500)::INT AS stratum, {u01_sql(42, 'doc_id', 'stratified')} AS u FROM documents),
    c AS (SELECT s AS stratum, count(r.doc_id) AS cnt FROM range(5) t(s) LEFT JOIN r ON r.stratum = s GROUP BY 1),
    q AS (SELECT *, floor(floor((SELECT count(*) FROM r) * 30 / 100) / 5) AS q FROM c),
    p AS (SELECT *, greatest(cnt - q, 0) AS spare, sum(greatest(q - cnt, 0)) OVER () AS missing FROM q),
    t AS (SELECT stratum, least(cnt, q) + least(spare, greatest(missing - coalesce(sum(spare) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS take FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, doc_id) AS k FROM r)
    SELECT n.doc_id AS sample_id, n.stratum FROM n JOIN t USING (stratum) WHERE k <= take""",
)
def w01(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("input"))
    return sampling.stratified_sample(docs, 30).select("sample_id", F.col("stratum").cast("int").alias("stratum"))


@query(
    "w02_random_sample",
    f"SELECT doc_id FROM documents ORDER BY {u01_sql(42, 'doc_id', 'random')}, doc_id LIMIT (SELECT floor(count(*) * 20 / 100)::BIGINT FROM documents)",
)
def w02(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_sample(table(spark, d, "documents").select("doc_id"), 20, "doc_id")


@query(
    "w03_permutation",
    f"SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY {u01_sql(42, 'doc_id', 'permutation')}, doc_id) - 1 AS place FROM documents) WHERE place >= 100",
)
def w03(spark: SparkSession, d: str) -> DataFrame:
    return sampling.permutation(table(spark, d, "documents").select("doc_id"), "doc_id", skip=100)


def run_log(orders: DataFrame) -> DataFrame:
    """Logs of runs: a customer's orders by date, with an error rate from their price."""
    rate = F.round(F.pmod(F.col("o_orderkey") * 7919, F.lit(100)) / 100, 2)
    rows = orders.select(F.col("o_custkey").alias("run"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("epoch"), rate.alias("rate"), F.col("o_totalprice").alias("val_loss"))
    return rows


RUN_LOG = "(SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS epoch, round((o_orderkey * 7919 % 100) / 100.0, 2) AS rate, o_totalprice AS val_loss FROM orders)"


_GOOD = "CASE WHEN l.rate >= 0.5 AND f.stage_after < 4 THEN f.streak + 1 ELSE 0 END"


@query(
    "w04_stage_advance",
    f"""WITH RECURSIVE log AS MATERIALIZED (SELECT run, epoch::BIGINT AS epoch, rate::DOUBLE AS rate FROM {RUN_LOG}), f AS (
          SELECT run, 0::BIGINT AS epoch, 0::DOUBLE AS rate, 1 AS stage, 1 AS stage_after, 0 AS streak FROM log WHERE epoch = 1
          UNION ALL
          SELECT l.run, l.epoch, l.rate, f.stage_after, f.stage_after + ({_GOOD} >= 2)::INTEGER, CASE WHEN {_GOOD} >= 2 THEN 0 ELSE {_GOOD} END
          FROM f JOIN log l ON l.run = f.run AND l.epoch = f.epoch + 1)
        SELECT run, epoch, rate, stage, stage_after FROM f WHERE epoch > 0""",
)
def w04(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.advance(run_log(table(spark, d, "orders")), "run", 0.5, 2, 4)


@query(
    "w04_streaks",
    f"""SELECT run, min(epoch)::INTEGER AS first_epoch, max(epoch)::INTEGER AS last_epoch, count(*) AS length FROM
        (SELECT *, sum(CASE WHEN rate >= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY epoch) AS island FROM {RUN_LOG}) WHERE rate >= 0.5 GROUP BY run, island""",
)
def w04_streaks(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.streaks(run_log(table(spark, d, "orders")), "run", 0.5)


@query("w05_loss_change", f"SELECT run, epoch, val_loss, lag(val_loss, 2) OVER (PARTITION BY run ORDER BY epoch) AS previous FROM {RUN_LOG}")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.loss_change(run_log(table(spark, d, "orders")), "run").select("run", "epoch", "val_loss", "previous")


_SEEN = "(l.rate > 0)"  # where nothing was exact, no error was measured
_BETTER = f"({_SEEN} AND 1 - l.rate < f.best * (1 - 1e-4::DOUBLE))"


@query(
    "w06_plateau",
    f"""WITH RECURSIVE log AS MATERIALIZED (SELECT run, epoch::BIGINT AS epoch, rate::DOUBLE AS rate FROM {RUN_LOG}), f AS (
          SELECT run, 0::BIGINT AS epoch, 'inf'::DOUBLE AS best, 0 AS idle, 1e-3::DOUBLE AS lr FROM log WHERE epoch = 1
          UNION ALL
          SELECT l.run, l.epoch, CASE WHEN {_BETTER} THEN 1 - l.rate ELSE f.best END,
            CASE WHEN NOT {_SEEN} THEN f.idle WHEN {_BETTER} OR f.idle >= 1 THEN 0 ELSE f.idle + 1 END,
            CASE WHEN {_SEEN} AND NOT {_BETTER} AND f.idle >= 1 THEN greatest(f.lr * 0.5::DOUBLE, 1e-6::DOUBLE) ELSE f.lr END
          FROM f JOIN log l ON l.run = f.run AND l.epoch = f.epoch + 1)
        SELECT run, epoch, lr FROM f WHERE epoch > 0""",
)
def w06(spark: SparkSession, d: str) -> DataFrame:
    log = run_log(table(spark, d, "orders")).withColumn("error", F.when(F.col("rate") > 0, 1 - F.col("rate")))
    return curriculum.plateau(log, "run", 1e-3, 1)


_UP = f"({_GOOD.replace('stage_after', 'stage')} >= 2)"


@query(
    "w06_schedule",
    f"""WITH RECURSIVE log AS MATERIALIZED (SELECT run, epoch::BIGINT AS epoch, rate::DOUBLE AS rate FROM {RUN_LOG}), f AS (
          SELECT run, 0::BIGINT AS epoch, 'inf'::DOUBLE AS best, 0 AS idle, 1e-3::DOUBLE AS lr, 1 AS stage, 0 AS streak FROM log WHERE epoch = 1
          UNION ALL
          SELECT l.run, l.epoch, CASE WHEN {_UP} THEN 'inf'::DOUBLE WHEN {_BETTER} THEN 1 - l.rate ELSE f.best END,
            CASE WHEN {_UP} THEN 0 WHEN NOT {_SEEN} THEN f.idle WHEN {_BETTER} OR f.idle >= 1 THEN 0 ELSE f.idle + 1 END,
            CASE WHEN {_UP} THEN 5e-4::DOUBLE WHEN {_SEEN} AND NOT {_BETTER} AND f.idle >= 1 THEN greatest(f.lr * 0.5::DOUBLE, 1e-6::DOUBLE) ELSE f.lr END,
            f.stage + {_UP}::INTEGER, CASE WHEN {_UP} THEN 0 ELSE {_GOOD.replace('stage_after', 'stage')} END
          FROM f JOIN log l ON l.run = f.run AND l.epoch = f.epoch + 1)
        SELECT run, epoch, stage, lr FROM f WHERE epoch > 0""",
)
def w06_schedule(spark: SparkSession, d: str) -> DataFrame:
    log = run_log(table(spark, d, "orders")).withColumn("error", F.when(F.col("rate") > 0, 1 - F.col("rate")))
    return curriculum.schedule(log, "run", 1e-3, 0.5, 2, 4, 1)


@query("a12_running_max", f"SELECT run, epoch, max(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS running_max FROM {RUN_LOG}")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_max(run_log(table(spark, d, "orders")), ["run"], "epoch", "val_loss").select("run", "epoch", "running_max")


@query("j05_stage_parameters", "SELECT doc_id, (doc_id % 4 + 1)::INTEGER AS stage, [0.0, 0.15, 0.25, 0.35][doc_id % 4 + 1]::DOUBLE AS special_prob, [50, 500, 5000, -1][doc_id % 4 + 1] AS val_max_batches FROM documents")
def j05(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4 + 1).cast("int").alias("stage"))
    return curriculum.with_parameters(docs).select("doc_id", "stage", "special_prob", F.coalesce("val_max_batches", F.lit(-1)).alias("val_max_batches"))


@query("o02_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY text, doc_id) - 1 >= n - floor(n / 10) THEN 'val' ELSE 'train' END AS split FROM documents, (SELECT count(*) AS n FROM documents)")
def o02(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sampling.split(docs, F.struct("text", "doc_id")).select("doc_id", "split")


@query("o02_hash_split", f"SELECT doc_id, CASE WHEN {u01_sql(42, 'doc_id', 'split')} * 100 < 10 THEN 'val' ELSE 'train' END AS split FROM documents")
def o02_hash(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("o04_top_k", "SELECT o_custkey, o_orderkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS k FROM orders) WHERE k <= 3")
def o04(spark: SparkSession, d: str) -> DataFrame:
    best = sampling.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return best.select("o_custkey", "o_orderkey", "k")


@query("o07_batches", "SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 32)::BIGINT AS batch_id FROM documents")
def o07(spark: SparkSession, d: str) -> DataFrame:
    return sampling.batches(table(spark, d, "documents").select("doc_id"), 32, F.col("doc_id"))


@query("u01_union_all", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def u01_all(spark: SparkSession, d: str) -> DataFrame:
    docs, items = (table(spark, d, t).select(F.col(c).alias("id"), "text") for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    return sampling.union_all(docs, items)


def _drawn_sql(seed: int) -> str:
    return f"(SELECT * FROM events ORDER BY {u01_sql(seed, 'event_id', 'random')}, event_id LIMIT (SELECT floor(count(*) * 20 / 100)::BIGINT FROM events))"


_U05_MIX = f"CASE WHEN {u01_sql(42, 'event_id', 'gate')} * 100 < 50 THEN {_MIXED.format(u=u01_sql(42, 'event_id', 'mix'))} ELSE 'none' END"


@query(
    "u05_mix_extra",
    f"""WITH src AS (SELECT event_id AS key, props AS text, user_id AS target, {_U05_MIX} AS profile FROM {_drawn_sql(42)}),
        {corrupt_sql.profiled("src")}
        SELECT doc_id AS sample_id, text AS input, source AS target, CASE WHEN {u01_sql(42, 'doc_id', 'split')} * 100 < 10 THEN 'val' ELSE 'train' END AS split, false AS mixed FROM documents
        UNION ALL SELECT key, text, target::VARCHAR, 'train', true FROM corrupted
        UNION ALL SELECT event_id, props, user_id::VARCHAR, 'val', true FROM {_drawn_sql(42 + mixture.VAL_SEED)}""",
)
def u05(spark: SparkSession, d: str) -> DataFrame:
    docs = sampling.hash_split(table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("input"), F.col("source").alias("target")))
    extra = table(spark, d, "events").select(F.col("event_id").alias("sample_id"), F.col("props").alias("input"), F.col("user_id").cast("string").alias("target"))
    return mixture.mix_extra(docs.where("split = 'train'"), docs.where("split = 'val'"), extra, 20.0, 50.0)


@query("u03_fan_out", "SELECT doc_id, v::INTEGER AS variant_no FROM documents, range(4) t(v)")
def u03(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fan_out(table(spark, d, "documents").select("doc_id"), 3)


@query("s08_corpus_lines", "SELECT text AS value FROM documents UNION ALL SELECT source FROM documents")
def s08(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("input"), F.col("source").alias("target"))
    return tokens.corpus_lines(docs, docs.where(F.lit(False)), None)


@query("k01_pair_lines", """SELECT '{"input":"' || p_name || '","target":"' || p_brand || ' \\u003c\\u0026\\u003e"}' AS value FROM part""")
def k01(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.pair_lines(table(spark, d, "part").select(F.col("p_name").alias("input"), F.concat("p_brand", F.lit(" <&>")).alias("target")))


# --- tokens and decoding


@query("t01_encode")
def t01(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    model = tokens.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    return spread(table(spark, d, "documents")).select("doc_id", model.encoder()("text").alias("ids"))


@query("t02_round_trip")
def t02(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    model = tokens.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    return t01(spark, d).select("doc_id", model.decoder()("ids").alias("text"))


def id_rows(lines: DataFrame) -> DataFrame:
    ids = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: (i * 3 + F.col("l_partkey") % 50 + 4).cast("int"))
    return lines.select("l_orderkey", "l_linenumber", ids.alias("src"), F.reverse(ids).alias("tgt"))


SRC_SQL = "[(i * 3 + l_partkey % 50 + 4)::INTEGER FOR i IN range(1, l_linenumber + 1)]"


@query("t06_model_rows", f"SELECT l_orderkey, l_linenumber, s[1:4] AS src_ids, list_concat([1], list_reverse(s)[1:5]) AS tgt_input, list_concat(list_reverse(s)[1:5], [2]) AS tgt_labels FROM (SELECT *, {SRC_SQL} AS s FROM lineitem)")
def t06(spark: SparkSession, d: str) -> DataFrame:
    return tokens.model_rows(id_rows(table(spark, d, "lineitem")), max_src=4, max_tgt=5).select("l_orderkey", "l_linenumber", "src_ids", "tgt_input", "tgt_labels")


@query(
    "t07_collate",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, {SRC_SQL} AS s FROM lineitem), w AS (SELECT *, max(len(s)) OVER (PARTITION BY l_orderkey) AS m FROM r)
        SELECT l_orderkey, l_linenumber, list_concat(s, [0 FOR i IN range(m - len(s))]) AS src_ids, list_concat(s, [2], [-100 FOR i IN range(m - len(s))]) AS tgt_labels FROM w""",
)
def t07(spark: SparkSession, d: str) -> DataFrame:
    rows = id_rows(table(spark, d, "lineitem")).withColumn("tgt", F.col("src"))
    return tokens.collate(tokens.model_rows(rows), "l_orderkey").select("l_orderkey", "l_linenumber", "src_ids", "tgt_labels")


@query("d01_greedy", f"SELECT l_orderkey, l_linenumber, {SRC_SQL} AS decoded FROM lineitem")
def d01(spark: SparkSession, d: str) -> DataFrame:
    rows = id_rows(spread(table(spark, d, "lineitem"))).select("l_orderkey", "l_linenumber", F.col("src").alias("src_ids"))
    return decode.decode(rows, decode.copy_step(90), 64).select("l_orderkey", "l_linenumber", "decoded")


@query("d02_beam", f"SELECT l_orderkey, l_linenumber, {SRC_SQL} AS decoded FROM lineitem")
def d02(spark: SparkSession, d: str) -> DataFrame:
    rows = id_rows(spread(table(spark, d, "lineitem"))).select("l_orderkey", "l_linenumber", F.col("src").alias("src_ids"))
    return decode.decode(rows, decode.copy_step(90), 64, width=2).select("l_orderkey", "l_linenumber", "decoded")


# --- generators


def _ids(spark: SparkSession, d: str, name: str, column: str) -> DataFrame:
    return spread(table(spark, d, name).select(F.col(column).cast("bigint").alias("id")))


@query("g01_tree_pairs")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return generate.pairs(spark, _ids(spark, d, "supplier", "s_suppkey"), "tree")


@query("g02_random_numbers", f"SELECT event_id, CASE WHEN u < 0.25 THEN floor(v * 100) WHEN u < 0.5 THEN floor(v * 1000000) WHEN u < 0.75 THEN v * 100 ELSE -floor(v * 10000) END AS n FROM (SELECT event_id, {u01_sql(42, 'event_id', 'kind')} AS u, {u01_sql(42, 'event_id', 'value')} AS v FROM events)")
def g02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", generate.drawn_number("event_id").alias("n"))


@query("g08_agent_pairs")
def g08(spark: SparkSession, d: str) -> DataFrame:
    return generate.pairs(spark, _ids(spark, d, "documents", "doc_id"), "agent")


@query("g15_snippets")
def g15(spark: SparkSession, d: str) -> DataFrame:
    return generate.snippets(spark, _ids(spark, d, "supplier", "s_suppkey"))


@query("g18_collage")
def g18(spark: SparkSession, d: str) -> DataFrame:
    return generate.collage(_ids(spark, d, "supplier", "s_suppkey"))


@query(
    "g19_prompts",
    f"""SELECT doc_id AS sample_id, kind, memory, 'Write one JSON object with thought and ' || kind || '; memory is ' || memory || '. Use some of these words: '
          || array_to_string([pool[floor({u01_sql(42, "doc_id", "p' || i || '")} * len(pool))::INTEGER + 1] FOR i IN range(1, 51)], ', ') || '.' AS prompt
        FROM (SELECT doc_id, {[w for w in augment.WORDS]} AS pool, {[k for k, _ in generate.MODES]}[doc_id % 9 + 1] AS kind, {[m for _, m in generate.MODES]}[doc_id % 9 + 1] AS memory FROM documents)""",
)
def g19(spark: SparkSession, d: str) -> DataFrame:
    return generate.prompts(table(spark, d, "documents").select(F.col("doc_id").alias("sample_id")), list(augment.WORDS))
