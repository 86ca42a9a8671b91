"""JSON trees as rows: texts taken apart level by level, leaves changed as columns, texts put together from below.

`shred` parses each text to a variant and explodes one level at a time, so that a tree of any width is rows like any others
and the number of jobs is the depth of the deepest tree. `assemble` renders the deepest rows and folds each container's
children into it, level by level, as pretty JSON, compact JSON and XML.

`parsed` and `rendered` do the same inside a row, as one array of nodes: for texts that fit a row with what is made of them.
Nothing is shuffled or written for that. `rewrite` and augmentation use these; rows are for nodes that are joined with other
tables.

Defined results: a text that is not exactly one JSON value has no rows (null, empty, cut off, something after the value,
numbers beyond doubles; an object that repeats a key, unless spark.sql.variant.allowDuplicateKeys is set; more levels or bytes
than a variant holds); numbers are doubles, and a negative zero in digits is zero; keys are in the order of their bytes; texts
that share keys are different trees only if the key columns tell them apart; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.columns import let
from .corrupt import BLANK, lexed
from .placing import materialised

#: Levels that are folded before the rows are written in between.
FOLDS = 6
FORMS = ("pretty", "compact", "xml")


def one_value(text: Column) -> Column:
    """Nothing but white space stands beside the first value of a JSON text."""
    step = lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)

    def merge(s: Column, t: Column) -> Column:
        depth = s["depth"] + step(t)
        ended = F.when((depth <= 0) & ~t.rlike(BLANK), F.when(t.rlike(r'^[^"]*\S\s+\S'), 2).otherwise(1)).otherwise(0)
        return F.struct(depth.alias("depth"), (s["values"] + ended).alias("values"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("values"))
    return F.aggregate(lexed(text), start, merge, lambda s: s["values"] == 1)


def _kind(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    return (
        F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number")
    )


def shred(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The nodes of the trees: the key columns, path (a JSON pointer), up (the parent's), top (name at the first level below
    an object), depth, level (of indentation in XML), kind, name, place, leaf (text of a string or boolean), number."""
    spark = df.sparkSession
    whole = F.when(one_value(F.col(f"`{text}`")), F.try_parse_json(F.col(f"`{text}`")))
    here = df.select(
        *keys, F.lit("").alias("path"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("string").alias("top"), F.lit(0).alias("depth"),
        F.lit(0).alias("level"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("place"), whole.alias("v"),
    ).where(F.col("v").isNotNull())
    levels = []
    while True:
        here = materialised(here.withColumn("kind", _kind(F.col("v"))))
        leaf = F.when(F.col("kind").isin("string", "boolean"), F.try_variant_get("v", "$", "string"))
        number = F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double"))
        levels.append(here.withColumns({"leaf": leaf, "number": number}).drop("v"))
        inner = here.where(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            break
        children = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        tag = F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        here = children.select(
            *keys, F.concat("path", F.lit("/"), tag).alias("path"), F.col("path").alias("up"), F.when(F.col("depth") == 0, F.col("key")).otherwise(F.col("top")).alias("top"),
            (F.col("depth") + 1).alias("depth"), (F.col("level") + F.when(F.col("kind") == "object", 3).otherwise(2)).alias("level"),
            F.col("key").alias("name"), F.col("pos").alias("place"), F.col("value").alias("v"),
        )
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    endless = nodes.where(F.abs("number") == float("inf")).select(*keys).distinct()
    return nodes.join(endless.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def _scalar(text: Column, number: Column) -> Column:
    kind = F.col("kind")
    return F.when(kind == "string", text).when(kind == "boolean", F.col("leaf")).when(kind == "number", number).when(kind == "null", "null")


def _pad(level: Column) -> Column:
    return F.repeat(F.lit("  "), level)


def _json(pretty: bool) -> Column:
    field = F.transform("kids", lambda k: F.concat(k["quoted_name"], F.lit(": " if pretty else ":"), k["pretty" if pretty else "compact"]))
    item = F.transform("kids", lambda k: k["pretty" if pretty else "compact"])

    def within(opening: str, parts: Column, closing: str) -> Column:
        if not pretty:
            return F.concat(F.lit(opening), F.array_join(parts, ","), F.lit(closing))
        gap = F.concat(F.lit("\n"), _pad(F.col("depth") + 1))
        lines = F.array_join(F.transform(parts, lambda p: F.concat(gap, p)), ",")
        return F.when(F.size(parts) == 0, opening + closing).otherwise(F.concat(F.lit(opening), lines, F.lit("\n"), _pad(F.col("depth")), F.lit(closing)))

    scalar = _scalar(F.col("quoted"), F.col("digits"))
    return F.when(F.col("kind") == "object", within("{", field, "}")).when(F.col("kind") == "array", within("[", item, "]")).otherwise(scalar)


def _xml() -> Column:
    """A container's lines, or a scalar's text."""
    pad = lambda n: _pad(F.col("level") + n)
    line = lambda n, x: F.concat(pad(n), F.lit(x + "\n"))
    holds = lambda k, n: F.when(k["kind"].isin("object", "array"), F.concat(line(n, "<value>"), k["xml"], line(n, "</value>"))).otherwise(
        F.concat(pad(n), F.lit("<value>"), k["xml"], F.lit("</value>\n"))
    )
    name = lambda k: F.when(fn.needs_cdata(k["name"]), fn.cdata(k["name"])).otherwise(k["name"])
    entry = lambda k: F.concat(line(1, "<entry>"), pad(2), F.lit("<key>"), name(k), F.lit("</key>\n"), holds(k, 2), line(1, "</entry>"))
    made = F.when(F.col("kind") == "object", F.concat(line(0, "<object>"), F.array_join(F.transform("kids", entry), ""), line(0, "</object>")))
    made = made.when(F.col("kind") == "array", F.concat(line(0, "<array>"), F.array_join(F.transform("kids", lambda k: holds(k, 1)), ""), line(0, "</array>")))
    return made.otherwise(_scalar(fn.cdata("leaf"), fn.xml_number("number")))


def assemble(nodes: DataFrame, keys: Sequence[str], forms: Sequence[str] = FORMS) -> DataFrame:
    """One row per tree that has a root: the key columns, kind of the root, and its text in each of the forms."""
    made = {"pretty": _json(True), "compact": _json(False), "xml": _xml()}
    nodes = nodes.select(*keys, "path", "up", "depth", "level", "kind", "name", "place", "leaf", "number")
    if set(forms) & {"pretty", "compact"}:
        quoted = F.when(F.col("kind") == "string", fn.json_string("leaf"))
        nodes = nodes.withColumns({"quoted": quoted, "quoted_name": fn.json_string("name"), "digits": fn.json_number("number")})
    else:
        nodes = nodes.withColumn("quoted_name", F.col("name"))
    nodes = materialised(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    kept = ["kind", "name", "quoted_name", "place", "up", *forms]
    below = None
    for depth in range(deepest, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("kids", F.expr("array()").cast("array<struct<" + ",".join(f"{c}:string" for c in ("kind", "name", "quoted_name", *forms)) + ">>"))
        else:
            kid = F.struct("name", "place", "kind", "quoted_name", *forms)
            folded = below.groupBy(*keys, F.col("up").alias("path")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
            here = here.join(folded.withColumnsRenamed({k: f"_{k}" for k in (*keys, "path")}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "path")], "left")
            here = here.withColumn("kids", F.coalesce("kids", F.expr("array()")))
        below = here.select(*keys, *[c for c in kept if c not in forms], *[made[f].alias(f) for f in forms])
        if (deepest - depth) % FOLDS == FOLDS - 1:
            below = materialised(below)
    if "xml" in forms:
        root = F.when(F.col("kind").isin("object", "array"), F.col("xml")).otherwise(F.concat(F.lit("<value>"), "xml", F.lit("</value>\n")))
        below = below.withColumn("xml", root)
    return below.select(*keys, "kind", *forms)


#: Where a node stands: names and places from the root down; `last` is 1 for the end of a container.
_ORDER = "array<struct<last:int,name:string,place:int>>"
NODE = f"struct<order:{_ORDER},path:string,top:string,depth:int,level:int,kind:string,name:string,leaf:string,number:double>"
_OPEN = f"struct<order:{_ORDER},path:string,top:string,kind:string,level:int,n:int>"
#: Nodes that are collected before their array is set aside: appending to one array copies it.
CHUNK = 256


def _none(kind: str) -> Column:
    return F.expr("array()").cast(f"array<{kind}>")


def _state(stack: Column, key: Column, nodes: Column, done: Column) -> Column:
    return F.struct(stack.alias("stack"), key.alias("key"), nodes.alias("nodes"), done.alias("done"))


def _node(s: Column, t: Column) -> Column:
    """The node of a value's first token; the containers around it are on the stack, the nearest first."""
    up, key, variant = F.get(s["stack"], 0), s["key"], F.try_parse_json(t)
    root, named = F.size(s["stack"]) == 0, up["kind"] == "object"
    tag = F.when(named, F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).otherwise(up["n"].cast("string"))
    at = F.struct(F.lit(0).alias("last"), key.alias("name"), F.when(~named, up["n"]).alias("place"))
    kind = (
        F.when(t == "{", "object").when(t == "[", "array").when(t.startswith('"'), "string").when(t.isin("true", "false"), "boolean")
        .when(t == "null", "null").otherwise("number")
    )

    def made(kind: Column) -> Column:
        return F.struct(
            F.when(root, _none(_ORDER[6:-1])).otherwise(F.concat(up["order"], F.array(at))).alias("order"),
            F.when(root, "").otherwise(F.concat(up["path"], F.lit("/"), tag)).alias("path"),
            F.when(F.size(s["stack"]) == 1, key).otherwise(up["top"]).alias("top"),
            F.size(s["stack"]).alias("depth"),
            F.when(root, 0).otherwise(up["level"] + F.when(named, 3).otherwise(2)).alias("level"),
            kind.alias("kind"),
            key.alias("name"),
            F.when(kind == "string", F.try_variant_get(variant, "$", "string")).when(kind == "boolean", t).alias("leaf"),
            F.when(kind == "number", F.try_variant_get(variant, "$", "double")).alias("number"),
        )

    return let(kind, made)


def _step(s: Column, t: Column) -> Column:
    """What a token does to the open containers, the name that waits for its value, and the nodes so far."""
    stack, nodes, done, none = s["stack"], s["nodes"], s["done"], F.lit(None).cast("string")
    up, rest = F.get(stack, 0), F.slice(stack, F.lit(2), F.greatest(F.size(stack) - 1, F.lit(0)))
    names = F.coalesce(up["kind"] == "object", F.lit(False)) & s["key"].isNull() & t.startswith('"')

    def with_node(n: Column) -> Column:
        opened = F.struct(n["order"].alias("order"), n["path"].alias("path"), n["top"].alias("top"), n["kind"].alias("kind"), n["level"].alias("level"), F.lit(0).alias("n"))
        full = F.size(nodes) >= CHUNK
        return _state(
            F.when(t.isin("{", "["), F.concat(F.array(opened), stack)).otherwise(stack), none,
            F.when(full, F.array(n)).otherwise(F.array_append(nodes, n)), F.when(full, F.array_append(done, nodes)).otherwise(done),
        )

    return (
        F.when(t.isin("", ":"), s)
        .when(t == ",", _state(F.concat(F.array(up.withField("n", up["n"] + 1)), rest), none, nodes, done))
        .when(t.isin("}", "]"), _state(rest, none, nodes, done))
        .when(names, _state(stack, F.try_variant_get(F.try_parse_json(t), "$", "string"), nodes, done))
        .otherwise(let(_node(s, t), with_node))
    )


def parsed(text: Column) -> Column:
    """The nodes of a JSON text as an array of NODE, the root first; null where shred has no rows."""
    start = _state(_none(_OPEN), F.lit(None).cast("string"), _none(NODE), _none(f"array<{NODE}>"))
    step = lambda s, t: let(F.trim(t, F.lit(" \t\r\n")), lambda bare: _step(s, bare))
    nodes = F.aggregate(lexed(text), start, step, lambda s: F.flatten(F.array_append(s["done"], s["nodes"])))
    finite = lambda found: F.when(~F.exists(found, lambda n: F.coalesce(F.abs(n["number"]) == float("inf"), F.lit(False))), found)
    return F.when(one_value(text) & F.try_parse_json(text).isNotNull(), let(nodes, finite))


def _holds(e: Column) -> Column:
    return e["kind"].isin("object", "array")


def _events(nodes: Column) -> Column:
    """Beginnings and ends of nodes in the order of the text, with the JSON of their names and scalars."""

    def sides(n: Column) -> Column:
        end = F.concat(n["order"], F.array(F.struct(F.lit(1).alias("last"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("place"))))
        begins, ends = F.struct(n["order"].alias("order"), F.lit(False).alias("ends"), n.alias("n")), F.struct(end.alias("order"), F.lit(True).alias("ends"), n.alias("n"))
        return F.when(_holds(n), F.array(begins, ends)).otherwise(F.array(begins))

    def told(e: Column) -> Column:
        n = e["n"]
        scalar = F.when(n["kind"] == "string", fn.json_string(n["leaf"])).when(n["kind"] == "boolean", n["leaf"]).when(n["kind"] == "number", fn.json_number(n["number"])).otherwise("null")
        opening, closing = F.when(n["kind"] == "object", "{").otherwise("["), F.when(n["kind"] == "object", "}").otherwise("]")
        return F.struct(
            e["ends"].alias("ends"), *[n[c].alias(c) for c in ("depth", "level", "kind", "name", "leaf", "number")],
            F.when(n["name"].isNotNull() & ~e["ends"], fn.json_string(n["name"])).alias("quoted_name"),
            F.when(e["ends"], closing).when(_holds(n), opening).otherwise(scalar).alias("sign"),
        )

    return F.transform(F.sort_array(F.flatten(F.transform(nodes, sides))), told)


def _event_json(events: Column, pretty: bool) -> Column:
    def one(e: Column, i: Column) -> Column:
        before = F.get(events, i - 1)
        first = (i == 0) | (_holds(before) & ~before["ends"])
        gap = F.when(e["depth"] > 0, F.concat(F.lit("\n"), _pad(e["depth"]))).otherwise("") if pretty else F.lit("")
        name = F.when(e["quoted_name"].isNotNull(), F.concat(e["quoted_name"], F.lit(": " if pretty else ":"))).otherwise("")
        end = F.when(first, e["sign"]).otherwise(F.concat(F.lit("\n"), _pad(e["depth"]), e["sign"])) if pretty else e["sign"]
        return F.when(e["ends"], end).otherwise(F.concat(F.when(first, "").otherwise(","), gap, name, e["sign"]))

    return F.array_join(F.transform(events, one), "")


def _event_xml(events: Column) -> Column:
    def one(e: Column) -> Column:
        pad = lambda n: _pad(e["level"] - n)
        named, inner = e["name"].isNotNull(), e["depth"] > 0
        key = F.when(fn.needs_cdata(e["name"]), fn.cdata(e["name"])).otherwise(e["name"])
        scalar = F.when(e["kind"] == "string", fn.cdata(e["leaf"])).when(e["kind"] == "boolean", e["leaf"]).when(e["kind"] == "number", fn.xml_number(e["number"])).otherwise("null")
        head = F.when(named, F.concat(pad(2), F.lit("<entry>\n"), pad(1), F.lit("<key>"), key, F.lit("</key>\n"))).otherwise("")
        tail = F.when(named, F.concat(pad(2), F.lit("</entry>\n"))).otherwise("")
        opened = F.concat(head, F.when(inner, F.concat(pad(1), F.lit("<value>\n"))).otherwise(""), pad(0), F.lit("<"), e["kind"], F.lit(">\n"))
        closed = F.concat(pad(0), F.lit("</"), e["kind"], F.lit(">\n"), F.when(inner, F.concat(pad(1), F.lit("</value>\n"))).otherwise(""), tail)
        value = F.concat(head, F.when(inner, pad(1)).otherwise(""), F.lit("<value>"), scalar, F.lit("</value>\n"), tail)
        return F.when(e["ends"], closed).when(_holds(e), opened).otherwise(value)

    return F.array_join(F.transform(events, one), "")


def rendered(nodes: Column, wanted: Mapping[str, Column] | None = None) -> Column:
    """The text of an array of nodes in each of the forms, as a struct, null for null; keys come in the order of their bytes.
    `wanted` has conditions of forms that are left null where they do not hold."""

    def texts(e: Column) -> Column:
        made = {"pretty": _event_json(e, True), "compact": _event_json(e, False), "xml": _event_xml(e)}
        return F.struct(*[(F.when(wanted[f], x) if wanted else x).alias(f) for f, x in made.items()])

    return let(_events(nodes), lambda e: F.when(e.isNotNull(), texts(e)))


def with_leaves(nodes: Column, change: Callable[[Column, Column], Column]) -> Column:
    """Nodes with the strings inside containers changed: change(leaf, path) is a column."""
    return F.transform(nodes, lambda n: F.when((n["kind"] == "string") & (n["depth"] > 0), n.withField("leaf", change(n["leaf"], n["path"]))).otherwise(n))


def rewrite(df: DataFrame, key: str, text: str, change: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, kind, pretty, compact, xml) with the strings inside containers changed: change(leaf, path) is a column."""
    nodes = df.select(key, parsed(F.col(f"`{text}`")).alias("_nodes")).where("_nodes IS NOT NULL")
    made = nodes.select(key, F.get("_nodes", 0)["kind"].alias("kind"), rendered(with_leaves(F.col("_nodes"), change)).alias("_made"))
    return made.select(key, "kind", *[F.col(f"_made.{f}").alias(f) for f in FORMS])
