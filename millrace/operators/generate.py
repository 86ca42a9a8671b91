"""Synthetic records: random JSON trees and agents' answers with their XML, as rows of a range.

A row's content comes from the seed and its number alone, so that it does not depend on partitions.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import jsontext, xmltext
from ..functions.rng import row_random, u01
from ..functions.types import struct
from . import corrupt, wording

Rng = random.Random
PAIRS = "sample_id long, input string, target string"


@dataclass(frozen=True)
class Shape:
    """Bounds of a random tree: levels, children of a container, nodes in all, and the chance of an array."""

    depth: int = 4
    breadth: int = 6
    budget: int = 60
    array: float = 0.3


def random_shape(r: Rng) -> Shape:
    """Small (30 %), medium (40 %), large (20 %) and very large (10 %) trees."""
    low, high = r.choices(((5, 19), (20, 99), (100, 499), (500, 1999)), (30, 40, 20, 10))[0]
    return Shape(r.randint(2, 7), r.randint(2, 13), r.randint(low, high), 0.2 + 0.4 * r.random())


def random_number(r: Rng) -> float:
    return float(r.choice((r.randint(0, 99), r.randint(0, 999_999), round(r.random() * 100, 4), -r.randint(1, 9999))))


def text_value(r: Rng) -> str:
    """A word (30 %), a sentence (15 %), a paragraph (10 %) or a code snippet (45 %)."""
    u = r.random()
    if u < 0.30:
        return r.choice((wording.word, wording.url, wording.file_path, wording.search_query))(r)
    if u < 0.45:
        return wording.sentence(r)
    return wording.paragraph(r, 2, 4) if u < 0.55 else wording.snippet(r, r.choice(list(wording.LANGUAGES)))


class Tree:
    """Grows one value within a shape's bounds."""

    def __init__(self, shape: Shape, r: Rng) -> None:
        self.shape, self.r, self.nodes = shape, r, 0

    def root(self) -> Any:
        return self.container(1)

    def container(self, depth: int) -> Any:
        self.nodes += 1
        count = self.r.randint(1, max(1, self.shape.breadth))
        if self.r.random() < self.shape.array:
            return [self.value(depth) for _ in range(count) if self.nodes < self.shape.budget + self.shape.breadth]
        out: dict[str, Any] = {}
        for _ in range(count):
            if self.nodes >= self.shape.budget + self.shape.breadth:
                break
            key = self.r.choice((wording.camel, wording.snake, lambda r: r.choice(wording.KEYS)))(self.r)
            while key in out:
                key += str(self.r.randint(0, 9))
            out[key] = self.value(depth)
        return out

    def value(self, depth: int) -> Any:
        used = min(1.0, self.nodes / self.shape.budget)
        nest = 0.7 * (1 - depth / self.shape.depth) * (1 - 0.5 * used)
        if depth < self.shape.depth and used < 1 and self.r.random() < nest:
            return self.container(depth + 1)
        self.nodes += 1
        u = self.r.random()
        return text_value(self.r) if u < 0.6 else random_number(self.r) if u < 0.85 else self.r.random() < 0.5 if u < 0.95 else None


def ordered_json(value: Any, level: int = 0) -> str:
    """JSON in the order of generation, two spaces a level, doubles without exponent."""
    pad = "  " * (level + 1)
    if isinstance(value, dict) and value:
        return "{\n" + ",\n".join(f"{pad}{jsontext.compact(k)}: {ordered_json(v, level + 1)}" for k, v in value.items()) + "\n" + pad[2:] + "}"
    if isinstance(value, list) and value:
        return "[\n" + ",\n".join(pad + ordered_json(v, level + 1) for v in value) + "\n" + pad[2:] + "]"
    if isinstance(value, float):
        return jsontext.plain(*jsontext.shortest(value)) if value else "0"
    return jsontext.compact(value)


def tree_pair(r: Rng) -> tuple[str, str]:
    """(input, target) of a random tree."""
    text = ordered_json(Tree(random_shape(r), r).root())
    return text, xmltext.json_to_xml(text)


#: Shares of simple answers, markdown answers, code tools and simple tools by stage, in percent.
CONTENT = {1: (40, 60, 0, 0), 2: (40, 0, 35, 25), 3: (25, 30, 15, 30), 4: (25, 30, 15, 30), 5: (25, 30, 15, 30)}
CODE_TOOLS = {"execute_sql": "sql", "execute_python": "python", "execute_javascript": "javascript", "execute_shell": "shell", "execute_go": "go"}
JOIN = {"sql": ";\n", "shell": "\n"}


def markdown_answer(r: Rng) -> str:
    parts = []
    for _ in range(r.randint(2, 4)):
        parts.append(wording.header(r))
        body = (
            lambda: wording.paragraph(r),
            lambda: "```{0}\n{1}\n```".format(*(lambda n: (n, wording.snippet(r, n)))(r.choice(("python", "bash", "sql", "go", "yaml")))),
            lambda: "\n".join(f"- {wording.sentence(r)}" for _ in range(r.randint(2, 5))),
            lambda: "\n".join(f"{k}. {wording.sentence(r)}" for k in range(1, r.randint(3, 5))),
            lambda: wording.LANGUAGES["markdown"](r),
        )
        parts += [b() for b in r.sample(body, r.randint(1, 3))]
    return "\n\n".join(parts)


def tool_call(r: Rng, code: bool) -> dict:
    if code:
        name = r.choice(list(CODE_TOOLS))
        language = CODE_TOOLS[name]
        parts = [wording.snippet(r, language) for _ in range(r.randint(1, 3))]
        return {"tool_name": name, "arguments": {"code": JOIN.get(language, "\n\n").join(parts)}}
    name = r.choice(("search", "read_file", "write_file", "http_request"))
    arguments: dict[str, Any] = {
        "search": lambda: {"query": wording.search_query(r)},
        "read_file": lambda: {"path": wording.file_path(r)},
        "write_file": lambda: {"path": wording.file_path(r), "content": wording.paragraph(r)},
        "http_request": lambda: {"method": r.choice(("GET", "POST")), "url": wording.url(r)},
    }[name]()
    if arguments.get("method") == "POST":
        arguments["body"] = wording.json_text(r)
    return {"tool_name": name, "arguments": arguments}


def agent_response(r: Rng, stage: int = 5, augment: bool = False) -> dict:
    """thought, and answer or tool, and now and then memory, in that order."""
    kind = r.choices(("simple", "markdown", "code", "tool"), CONTENT[stage])[0]
    out: dict[str, Any] = {}
    if kind in ("simple", "markdown"):
        out["thought"] = wording.augmented(r) + "." if augment else wording.thought(r)
        out["answer"] = markdown_answer(r) if kind == "markdown" else wording.paragraph(r, 10, 25)
    else:
        out["tool"] = tool_call(r, kind == "code")
        out = {"thought": wording.tool_reason(r, out["tool"]["tool_name"]), **out}
    if r.random() < 0.5:
        out["memory"] = wording.memory(r)
    return out


def response_text(value: Any, level: int = 0) -> str:
    """Pretty JSON in the order of the fields."""
    pad = "  " * (level + 1)
    if isinstance(value, dict) and value:
        return "{\n" + ",\n".join(f"{pad}{jsontext.compact(k)}: {response_text(v, level + 1)}" for k, v in value.items()) + "\n" + pad[2:] + "}"
    if isinstance(value, list) and value:
        return "[\n" + ",\n".join(pad + response_text(v, level + 1) for v in value) + "\n" + pad[2:] + "]"
    return jsontext.compact(value)


def agent_pair(r: Rng, stage: int = 5, augment: bool = False) -> tuple[str, str]:
    text = response_text(agent_response(r, stage, augment))
    return text, xmltext.json_to_xml(text)


def make_pair(kind: str, seed: int, number: int, stage: int = 5, augment: bool = False) -> tuple[str, str]:
    r = row_random(seed, number, kind)
    return tree_pair(r) if kind == "tree" else agent_pair(r, stage, augment)


def pairs(spark: SparkSession, n: int | DataFrame, kind: str = "agent", seed: int = 42, stage: int = 5, augment: bool = False, partitions: int | None = None) -> DataFrame:
    """n synthetic pairs, or one for each row of a table with an integer column id; their inputs corrupted by the plain profiles (trees) or those of the stage (agents). Train and
    validation sets need seeds of their own; a number's content differs with the seed."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            made = [make_pair(kind, seed, int(k), stage, augment) for k in batch["id"]]
            yield pd.DataFrame({"sample_id": batch["id"], "input": [m[0] for m in made], "target": [m[1] for m in made]})

    rows = n.select("id") if isinstance(n, DataFrame) else spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    clean = rows.mapInPandas(run, PAIRS)
    by_stage = corrupt.profile_stage(F.lit(stage), u01(seed, "sample_id", "stage"))
    profile = corrupt.profile_plain(u01(seed, "sample_id", "plain")) if kind == "tree" else by_stage
    return clean.withColumn("input", corrupt.corrupted(F.col("input"), profile, F.col("sample_id"), seed))


def snippets(spark: SparkSession, n: int | DataFrame, seed: int = 42) -> DataFrame:
    """n snippets of each language, or one for each row of a table with an integer column id."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(wording.LANGUAGES)
        for batch in it:
            rows = [(int(k), name, wording.snippet(row_random(seed, k, name), name)) for k in batch["id"] for name in names]
            yield pd.DataFrame(rows, columns=["id", "language", "snippet"])

    rows = n.select("id") if isinstance(n, DataFrame) else spark.range(n)
    return rows.mapInPandas(run, "id long, language string, snippet string")


@udtf(returnType=struct(PAIRS))
class SyntheticPairs:
    """SQL: SELECT * FROM synthetic_pairs(count, kind, seed), with inputs as they are before any corruption."""

    def eval(self, n: int, kind: str, seed: int):
        for k in range(n):
            yield (k, *make_pair(kind, seed, k))


def register(spark: SparkSession) -> None:
    """The generators and functions under names that SQL can call."""
    from ..functions import columns

    spark.udtf.register("synthetic_pairs", SyntheticPairs)
    for name in ("json_to_xml", "json_valid", "pretty_json", "compact_json", "xml_well_formed", "xml_document", "xml_same_meaning"):
        spark.udf.register(name, getattr(columns, name))


#: Five demonstration settings: number, shape, profile.
COLLAGE = (
    (0, Shape(2, 3, 8, 0.2), "none"), (1, Shape(3, 4, 15, 0.3), "subtle"), (2, Shape(3, 5, 20, 0.5), "light"),
    (3, Shape(4, 4, 30, 0.3), "medium"), (4, Shape(5, 6, 40, 0.4), "heavy"),
)


def collage(rows: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """(id, profile, clean, corrupted, target): a tree of one of the five settings for each key, the settings in turn."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            made = []
            for k in batch["id"]:
                _, shape, profile = COLLAGE[int(k) % len(COLLAGE)]
                clean = ordered_json(Tree(shape, row_random(seed, k, "collage")).root())
                made.append((int(k), profile, clean, xmltext.json_to_xml(clean)))
            yield pd.DataFrame(made, columns=["id", "profile", "clean", "target"])

    made = rows.select(F.col(key).cast("bigint").alias("id")).mapInPandas(run, "id long, profile string, clean string, target string")
    broken = corrupt.corrupted(F.col("clean"), F.col("profile"), F.col("id"), seed)
    return made.select("id", "profile", "clean", broken.alias("corrupted"), "target")


#: The nine modes of prompts: what the answer holds, and how it treats memory.
MODES = tuple((kind, memory) for kind in ("answer", "tool", "tool") for memory in ("present", "omitted", "null"))


def prompts(rows: DataFrame, words: list[str], key: str = "sample_id", seed: int = 42, n_words: int = 50) -> DataFrame:
    """Prompts for record writers, natively: mode by key, words chosen by hash. Nothing is called with them."""
    kinds = F.array(*[F.lit(k) for k, _ in MODES])
    memories = F.array(*[F.lit(m) for _, m in MODES])
    mode = F.pmod(F.col(key), F.lit(len(MODES))).cast("int")
    pool = F.array(*map(F.lit, words))

    def one(i: Column) -> Column:
        u = u01(seed, key, F.concat(F.lit("p"), i.cast("string")))
        return F.get(pool, F.floor(u * len(words)).cast("int"))

    chosen = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n_words)), one), ", ")
    text = F.format_string(
        "Write one JSON object with thought and %s; memory is %s. Use some of these words: %s.", F.get(kinds, mode), F.get(memories, mode), chosen
    )
    return rows.select(key, F.get(kinds, mode).alias("kind"), F.get(memories, mode).alias("memory"), text.alias("prompt"))


def drawn_number(key: str | Column, seed: int = 42) -> Column:
    """A number for a key: a whole one under 100 or a million, a fraction under 100, or a negative whole one, a quarter each."""
    u, v = u01(seed, key, "kind"), u01(seed, key, "value")
    return (
        F.when(u < 0.25, F.floor(v * 100).cast("double")).when(u < 0.5, F.floor(v * 1000000).cast("double")).when(u < 0.75, v * 100)
        .otherwise(-F.floor(v * 10000).cast("double"))
    )
