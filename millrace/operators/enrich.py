"""Tool calls enriched with argument structures, by a lookup join on the tool's name."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext, xmltext
from ..functions.rng import u01
from ..functions.types import struct

#: Own structures for each tool name: variants of arguments that a call can carry besides its main one.
VARIANTS: dict[str, tuple[dict, ...]] = {
    "execute_sql": ({"replica": "east", "max_rows": 200}, {"dry_run": True, "tags": ["report", "daily"]}, {"session": {"role": "reader", "retries": 2}}, {"bind": [7, "open", False]}, {"isolation": "snapshot"}),
    "execute_python": ({"limits": {"memory_mb": 512, "seconds": 20}}, {"packages": ["attrs", "rich"]}, {"argv": ["--fast"], "cwd": "/srv/job"}, {"stdin": "a;b\n1;2"}),
    "execute_javascript": ({"engine": "quick", "modules": True}, {"env": {"LEVEL": "info", "WORKERS": 2}}, {"imports": ["dayjs"], "strict": True}),
    "execute_shell": ({"env": {"LANG": "C"}, "login": False}, {"cwd": "/var/tmp", "seconds": 45}, {"pipefail": True, "nice": 5}),
    "execute_go": ({"tags": ["unit"], "race": False}, {"env": {"GOFLAGS": "-mod=mod"}}, {"bench": ".", "count": 3}),
    "search": ({"within": {"from": "2020-02-01", "to": "2020-03-01"}, "top": 8}, {"weights": {"title": 3, "text": 1}}, {"sites": ["handbook", "notes"], "lang": "de"}),
    "read_file": ({"charset": "latin-1", "limit": 4096}, {"lines": {"from": 10, "to": 40}}, {"as": "table", "header": True}),
    "write_file": ({"mkdirs": True, "mode": "0640"}, {"append": True, "fsync": True}, {"acl": {"group": "staff", "write": False}}),
    "http_request": ({"headers": {"Accept": "text/csv", "X-Trace": "on"}}, {"retries": {"count": 2, "wait_ms": 150}}, {"query": {"page": 3, "size": 25}}),
}


def dimension(spark: SparkSession) -> DataFrame:
    """(tool_name, variant_no, n_variants, extra_json), a few dozen rows."""
    rows = [(t, k, len(v), json.dumps(x, sort_keys=True)) for t, v in VARIANTS.items() for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "tool_name string, variant_no int, n_variants int, extra_json string")


def choose(calls: DataFrame, pct: float, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """(key, tool_name) with extra_json: pct percent of the calls to known tools get one of the tool's variants."""
    dim = dimension(calls.sparkSession)
    sizes = dim.select("tool_name", "n_variants").distinct()
    drawn = calls.join(F.broadcast(sizes), "tool_name", "left").withColumn(
        "variant_no", F.when(u01(seed, key, "enrich") * 100 < pct, F.floor(u01(seed, key, "variant") * F.col("n_variants")).cast("int"))
    )
    return drawn.drop("n_variants").join(F.broadcast(dim.drop("n_variants")), ["tool_name", "variant_no"], "left")


def merge_one(text: str, extra: str | None) -> tuple[str, str] | None:
    """(input, target) with extra merged into tool.arguments, over equal keys; None where it cannot be."""
    if extra is None:
        return None
    try:
        value = jsontext.parse(text)
        arguments = value["tool"]["arguments"]
    except (ValueError, KeyError, TypeError):
        return None
    if not isinstance(arguments, dict):
        return None
    arguments.update(jsontext.parse(extra))
    xml = xmltext.to_xml(value)
    return (jsontext.pretty(value), xml) if xmltext.well_formed(xml) else None


@F.pandas_udf(struct("input string, target string"))
def _merge(texts: pd.Series, extras: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([merge_one(t, e) or (None, None) for t, e in zip(texts, extras)], columns=["input", "target"])


def enrich(pairs: DataFrame, pct: float = 25.0, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Pairs with enriched tool calls, and whether a row is a tool call and was enriched; others pass as they are."""
    name = F.expr("try_variant_get(try_parse_json(input), '$.tool.tool_name', 'string')")
    chosen = choose(pairs.withColumn("tool_name", name), pct, seed, key)
    made = chosen.withColumn("_made", _merge(F.when(F.col("extra_json").isNotNull(), F.col("input")), F.col("extra_json")))
    return made.select(
        key,
        F.coalesce("_made.input", "input").alias("input"),
        F.coalesce("_made.target", "target").alias("target"),
        F.col("tool_name").isNotNull().alias("is_tool"),
        F.col("_made.input").isNotNull().alias("enriched"),
    )


def enriched_share(done: DataFrame) -> DataFrame:
    tools = F.count_if(F.col("is_tool"))
    hit = F.count_if(F.col("enriched"))
    return done.agg(hit.alias("enriched"), tools.alias("tools"), (100.0 * hit / F.greatest(tools, F.lit(1))).alias("pct"))
