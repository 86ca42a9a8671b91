"""Column functions: native expressions, and vectorised ones where JSON or XML has to be walked."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import jsontext, xmltext
from .memory import give_back
from .types import TOKENS

TAGS = r"</?(?:object|entry|key|value|array)>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- vectorised


#: Rows whose Python objects a task holds at a time.
ROWS = 256


def by_slices(kind: T.DataType, *, given: int = 1) -> Callable[[Callable], Callable]:
    """A vectorised function of a function of one row's texts: Arrow batches are worked on a few rows at a time, so that a
    worker's memory does not follow the size of a batch, and free memory goes back to the system."""
    arrow = to_arrow_type(kind)

    def slices(batch: tuple[pa.Array, ...], f: Callable) -> Iterator[pa.Array]:
        for first in range(0, len(batch[0]), ROWS):
            yield pa.array(map(f, *[c.slice(first, ROWS).to_pylist() for c in batch]), arrow)

    def run_batches(batches: Iterator[tuple[pa.Array, ...]], f: Callable) -> Iterator[pa.Array]:
        for batch in batches:
            yield from slices(batch, f)
            del batch
            give_back()

    def made(f: Callable) -> Callable:
        if given == 1:

            def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
                return run_batches(((t,) for t in texts), f)

        else:

            def run(texts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                return run_batches(texts, f)

        run.__annotations__ = {"texts": Iterator[pa.Array] if given == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return functools.wraps(f, assigned=("__name__", "__doc__"), updated=())(F.arrow_udf(run, kind))

    return made


@by_slices(T.StringType())
def json_to_xml(text: str | None) -> str | None:
    return xmltext.json_to_xml(text)


@by_slices(T.StringType())
def json_to_xml_compat(text: str | None) -> str | None:
    return xmltext.json_to_xml(text, compat=True)


@by_slices(T.BooleanType())
def json_valid(text: str | None) -> bool:
    return jsontext.valid(text)


@by_slices(T.StringType())
def pretty_json(text: str | None) -> str | None:
    return jsontext.pretty(jsontext.parse(text)) if jsontext.valid(text) else None


@by_slices(T.StringType())
def compact_json(text: str | None) -> str | None:
    return jsontext.compact_text(text)


@by_slices(T.BooleanType())
def xml_well_formed(text: str | None) -> bool:
    return xmltext.well_formed(text)


@by_slices(T.BooleanType())
def xml_document(text: str | None) -> bool:
    return xmltext.is_document(text)


@by_slices(TOKENS)
def flatten_xml(text: str | None) -> list[dict] | None:
    return None if (f := xmltext.flatten(text)) is None else [{"kind": k, "val": v} for k, v in f]


@by_slices(T.BooleanType(), given=2)
def xml_same_meaning(a: str | None, b: str | None) -> bool:
    return xmltext.same_meaning(a, b)


@by_slices(T.StringType(), given=2)
def xml_fault_kind(text: str | None, tokens: int) -> str | None:
    return xmltext.fault_kind(text or "", int(tokens))


# --- native


def byte_levenshtein(a: str | Column, b: str | Column, most: int | Column | None = None) -> Column:
    """Edit distance of the UTF-8 bytes; -1 beyond `most`. Bytes are looked at as Latin-1 characters."""
    x, y = (F.decode(F.encode(_col(c), "UTF-8"), "ISO-8859-1") for c in (a, b))
    return F.levenshtein(x, y) if most is None else F.call_function("levenshtein", x, y, most if isinstance(most, Column) else F.lit(most))


def levenshtein(a: str | Column, b: str | Column, most: int | None = None) -> Column:
    """Edit distance of code points; -1 beyond `most`; null where either is null."""
    return F.levenshtein(_col(a), _col(b)) if most is None else F.levenshtein(_col(a), _col(b), most)


def sorted_keys(c: str | Column) -> Column:
    """The keys of a map in the order of their bytes; null for null."""
    return F.array_sort(F.map_keys(_col(c)))


def normalise_space(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def tag_sequence(c: str | Column) -> Column:
    """Opening and closing tags of the vocabulary in order."""
    return F.regexp_extract_all(_col(c), F.lit(TAGS), F.lit(0))


def same_structure(a: str | Column, b: str | Column) -> Column:
    return tag_sequence(a) == tag_sequence(b)


def xml_root_prefix(c: str | Column) -> Column:
    """Text that begins like an answer."""
    return F.ltrim(_col(c)).rlike(r"^<(object|array)>")


def identifier_like(c: str | Column) -> Column:
    return _col(c).rlike(r"^[A-Za-z0-9_]{1,50}$")


def needs_cdata(c: str | Column) -> Column:
    return _col(c).rlike("[<>&\"']")


def cdata(c: str | Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(_col(c), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def quote_escaped(prefix: str | Column) -> Column:
    """A quote after this text is escaped: the text ends in an odd number of backslashes."""
    return F.length(F.regexp_extract(_col(prefix), r"(\\*)$", 1)) % 2 == 1


def capitalise(c: str | Column) -> Column:
    return F.concat(F.upper(F.left(_col(c), F.lit(1))), F.substring(_col(c), F.lit(2), F.length(_col(c))))


def first_line_unfenced(c: str | Column) -> Column:
    """The first line that is not blank, code fences aside."""
    return F.get(F.filter(F.split(_col(c), "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("```")), 0)


def object_line(c: str | Column) -> Column:
    return _col(c).rlike(r"^\s*\{")


def is_tool(c: str | Column) -> Column:
    """A JSON object with a `tool` that is not null; text that is not JSON has none."""
    tool = f"try_variant_get(try_parse_json({_name(c)}), '$.tool', 'variant')"
    return F.expr(f"coalesce({tool} IS NOT NULL AND NOT is_variant_null({tool}), false)")


def _name(c: str | Column) -> str:
    if not isinstance(c, str):
        raise TypeError("a column name is needed")
    return f"`{c}`"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and written once into the plan. (element_at knows its type beforehand; an item by
    its place would have the type of all of `use` worked out for each row and place.)"""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(x: Column) -> Column:
    """Sign, digits without zeros around, and decimal exponent of the first digit, of the fewest digits that read back as a
    double. Before JDK 19 the JVM may write 16 to 18 digits where 15 or 16 do, which are tried then."""

    def fewest(text: Column) -> Column:
        tried = [F.format_string(f"%.{n}e", x) for n in (14, 15)]
        shorter = F.coalesce(*[F.when(t.cast("double") == x, t) for t in tried], text)
        return F.when(F.length(F.regexp_replace(text, "E.*|[^0-9]", "")) > 15, shorter).otherwise(text)

    def parts(text: Column) -> Column:
        return F.struct(
            F.when(text.startswith("-"), "-").otherwise("").alias("sign"),
            F.regexp_extract(text, r"^-?([0-9]+)", 1).alias("whole"),
            F.regexp_extract(text, r"\.([0-9]+)", 1).alias("part"),
            F.coalesce(F.nullif(F.regexp_extract(text, r"[eE]([-+]?[0-9]+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("shift"),
        )

    def told(p: Column) -> Column:
        leading = F.length(F.regexp_extract(p["part"], "^(0*)", 1))
        place = p["shift"] + F.when(p["whole"] == "0", -1 - leading).otherwise(F.length(p["whole"]) - 1)
        return F.struct(p["sign"].alias("sign"), F.regexp_replace(F.concat(p["whole"], p["part"]), "^0+|0+$", "").alias("digits"), place.alias("exponent"))

    return let(let(let(x.cast("string"), fewest), parts), told)


def _plain_digits(sign: Column, digits: Column, exponent: Column) -> Column:
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    head, tail = F.rpad(F.left(digits, exponent + 1), exponent + 1, F.lit("0")), F.substring(digits, exponent + 2, F.length(digits))
    return F.when(exponent < 0, small).when(tail == "", F.concat(sign, head)).otherwise(F.concat(sign, head, F.lit("."), tail))


def _scientific(sign: Column, digits: Column, exponent: Column, width: Column) -> Column:
    point = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise("")
    size = F.abs(exponent).cast("string")
    power = F.when(F.length(size) < width, F.lpad(size, width, F.lit("0"))).otherwise(size)
    return F.concat(sign, F.left(digits, F.lit(1)), point, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), power)


def xml_number(c: str | Column) -> Column:
    """A number as XML text has it: whole numbers up to 1e15 in full, else the shortest digits, with an exponent below 1e-4
    and from 1e6 on."""
    x = _col(c).cast("double")

    def written(n: Column) -> Column:
        parts = n["sign"], n["digits"], n["exponent"]
        return F.when((parts[2] < -4) | (parts[2] >= 6), _scientific(*parts, F.lit(2))).otherwise(_plain_digits(*parts))

    return F.when((x == F.floor(x)) & (F.abs(x) <= 1e15), x.cast("bigint").cast("string")).otherwise(let(_digits(x), written))


def json_number(c: str | Column) -> Column:
    """A number as JSON text has it: in full but below 1e-6 and from 1e21 on."""
    x = _col(c).cast("double")

    def written(n: Column) -> Column:
        parts, small = (n["sign"], n["digits"], n["exponent"]), F.abs(x) < 1e-6
        long = _scientific(*parts, F.when(small & (parts[2] > -10), 1).otherwise(2))
        return F.when(x == 0, F.concat(parts[0], F.lit("0"))).when(small | (F.abs(x) >= 1e21), long).otherwise(_plain_digits(*parts))

    return F.when((x == F.floor(x)) & (F.abs(x) <= 1e15) & (x != 0), x.cast("bigint").cast("string")).otherwise(let(_digits(x), written))


#: What JSON text writes with a backslash, in this order; rare control characters, and signs of markup and line separators.
_SHORT = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_RARE = tuple(chr(k) for k in range(32) if chr(k) not in "\n\r\t\b\f")
_MARKUP = ("<", ">", "&", "\u2028", "\u2029")


def json_string(c: str | Column) -> Column:
    """A string as JSON text: control characters, quotes, and < > & and the two line separators escaped."""
    each = lambda text, pairs: functools.reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
    hexed = lambda signs: [(s, f"\\u{ord(s):04x}") for s in signs]
    out = let(each(_col(c), _SHORT[:2]), lambda t: F.when(t.rlike(r"[\x08-\x0d]"), each(t, _SHORT[2:])).otherwise(t))
    out = let(out, lambda t: F.when(t.rlike(r"[<>&\u2028\u2029]"), each(t, hexed(_MARKUP))).otherwise(t))
    out = let(out, lambda t: F.when(t.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), each(t, hexed(_RARE))).otherwise(t))
    return F.concat(F.lit('"'), out, F.lit('"'))


#: Characters that XML 1.0 text cannot hold.
_NOT_XML = r"[^\x09\x0a\x0d\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]"
NOT_XML_TEXT = re.compile("[^\x09\x0a\x0d\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
#: What has to be looked at again: most texts have none of it, and each character is told faster.
_RARE_IN_XML = r"[^\x0a\x20-\x{d7ff}]"


def xml_characters(c: str | Column) -> Column:
    """Every character may stand in XML text."""
    return ~(_col(c).rlike(_RARE_IN_XML) & _col(c).rlike(_NOT_XML))


# --- arrays of doubles and token ids


def argmax(c: str | Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(_col(c), F.array_max(_col(c))) - 1).cast("int")


def log_softmax(c: str | Column) -> Column:
    x = _col(c)
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.transform(x, lambda v: v - top - F.log(total))


def top_k(c: str | Column, k: int) -> Column:
    """0-based places of the k largest elements, largest first, earlier ones first where equal."""
    places = F.transform(_col(c), lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(places), 1, k), lambda s: s["i"])


def length_normalised(score: str | Column, length: str | Column, alpha: float = 0.6) -> Column:
    return _col(score) / F.pow(F.greatest(_col(length), F.lit(1)), F.lit(alpha))


def content_mask(ids: str | Column, structural_max: int = 15, pad: int = 0) -> Column:
    """True for ids that are content: beyond the structural ones, not first, not padding."""
    return F.transform(_col(ids), lambda t, i: (t > structural_max) & (i > 0) & (t != pad))


def token_noise(ids: str | Column, key: str | Column, p: float, vocab: int, seed: int = 1, structural_max: int = 15) -> Column:
    """Each content id replaced with chance p by one drawn from (structural_max, vocab)."""
    from .rng import u01

    spread = vocab - structural_max - 1

    def one(t: Column, i: Column) -> Column:
        draw = F.concat(F.lit("n"), i.cast("string"))
        fresh = structural_max + 1 + F.floor(u01(seed, key, F.concat(F.lit("v"), i.cast("string"))) * spread).cast("int")
        hit = (t > structural_max) & (i > 0) & (t != 0) & (u01(seed, key, draw) < p)
        return F.when(hit, fresh).otherwise(t)

    return F.transform(_col(ids), one)


def boost(previous: str | Column, current: str | Column, rate: float = 0.10, most: float = 1.0) -> Column:
    """How much content weights rise when the loss stalls: most at no improvement, 0 from `rate` on."""
    p, c = _col(previous), _col(current)
    return F.when(p <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(most), (1 - (p - c) / p / rate) * most)))
