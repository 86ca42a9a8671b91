"""Seeded corruptions of JSON text, text to text, as native expressions.

One regular expression splits a text into string literals, signs and what stands between, so that structure is only touched
outside of literals. A uniform of seed, row key, corruption and place (an MD5) decides for each token, line or text what
happens to it, and the tokens are joined again: a row's result depends on its seed and key alone, and DuckDB computes the
same (millrace/plans/corrupt_sql.py).

Defined results: a null text stays null; a null profile changes nothing, a null key is one like others; an empty text has no tokens and one
line; what follows an unclosed quote is one literal; rows that share a key are corrupted alike. The pattern's groups are
possessive, so that literals of any length and number of escapes are matched without recursion.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import astuple, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.rng import below, stem, u01, uniform

#: Literals, the rest after a quote that is never closed, signs, and runs of anything else.
TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"|".*|[{}\[\],:]|[^"{}\[\],:]++'
BLANK = r"^[ \t\r\n]+\z"
#: A closing bracket with others right after it, and the white space among and after them.
RUN = r"^[\]}](?:[ \t\r\n]*+[\]}])++[ \t\r\n]*+"


def lexed(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


@dataclass(frozen=True)
class Draws:
    """The uniforms of one corruption of a row."""

    seed: int
    key: Column
    name: str | Column
    stems: dict[str, Column] = field(default_factory=dict)

    def _stem(self, what: str) -> Column:
        name = F.lit(f"{self.name}.{what}") if isinstance(self.name, str) else F.concat(self.name, F.lit(f".{what}"))
        return self.stems.get(what, stem(self.seed, self.key, name))

    def _hash(self, what: str, place: Column | None) -> Column:
        return F.md5(self._stem(what) if place is None else F.concat(self._stem(what), place.cast("string")))

    def once(self, whats: tuple[str, ...], use: Callable[[Draws], Column]) -> Column:
        """use(draws) with what stands before the places of these draws made once, not for each place."""
        made = F.struct(*[self._stem(w).alias(w) for w in whats])
        return let(made, lambda s: use(replace(self, stems={w: s[w] for w in whats})))

    def u(self, what: str, place: Column | None = None) -> Column:
        return uniform(self.digits(what, place))

    def digits(self, what: str, place: Column | None = None) -> Column:
        return F.substring(self._hash(what, place), 1, 8)

    def hit(self, p: float, what: str, place: Column | None = None) -> Column:
        """u(what, place) < p."""
        return below(self._hash(what, place), p)

    def pick(self, values: tuple[str, ...], what: str, place: Column | None = None) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.floor(self.u(what, place) * len(values)).cast("int"))


def _closer(t: Column) -> Column:
    return t.isin("]", "}")


def _each_token(text: Column, change: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.transform(lexed(text), change), "")


def strip_quotes(text: Column, d: Draws, p: float = 0.6) -> Column:
    """Quotes around names of letters, digits and _ go, each with chance p."""
    name = lambda t: t.rlike(r'^"[A-Za-z0-9_]{1,50}"\z')
    return d.once(("t",), lambda d: _each_token(text, lambda t, i: F.when(name(t) & (d.hit(p, "t", i)), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)))


def drop_commas(text: Column, d: Draws, p: float = 0.4) -> Column:
    """Commas go with chance p; half of them leave a space."""
    left = lambda i: F.when(d.hit(0.5, "space", i), " ").otherwise("")
    return _each_token(text, lambda t, i: F.when((t == ",") & (d.hit(p, "t", i)), left(i)).otherwise(t))


def drop_colons(text: Column, d: Draws, p: float = 0.4) -> Column:
    """Colons become spaces with chance p."""
    return _each_token(text, lambda t, i: F.when((t == ":") & (d.hit(p, "t", i)), " ").otherwise(t))


def mangle_brackets(text: Column, d: Draws) -> Column:
    """One edit of one closing bracket: swapped (30 %), dropped (20 %), doubled (20 %), or a run of closers rewritten.

    It is the first closer that its uniform chooses (0.3 for dropped and doubled, else 0.4); for a run, the first of those
    that another closer follows.
    """
    kind = d.u("kind")

    def edited(tokens: Column) -> Column:
        def chosen(t: Column, i: Column) -> Column:
            after, then = F.get(tokens, i + 1), F.get(tokens, i + 2)
            run = F.coalesce(_closer(after) | (after.rlike(BLANK) & _closer(then)), F.lit(False))
            return _closer(t) & (d.u("t", i) < F.when((kind >= 0.3) & (kind < 0.7), 0.3).otherwise(0.4)) & ((kind < 0.7) | run)

        at = F.get(F.filter(F.transform(tokens, lambda t, i: F.when(chosen(t, i), i)), lambda i: i.isNotNull()), 0)

        def changed(i: Column) -> Column:
            c, head = F.get(tokens, i), F.array_join(F.slice(tokens, F.lit(1), i), "")
            tail = F.array_join(F.slice(tokens, i + 2, F.size(tokens)), "")
            run = F.regexp_extract(F.concat(c, tail), RUN, 0)
            count = F.length(F.regexp_replace(run, r"[^\]}]", "")) + F.floor(d.u("more") * 3).cast("int")
            made = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda k: F.when(d.hit(0.4, "made", k), "]").otherwise("}")), "")
            one = F.when(kind < 0.3, F.translate(c, "]}", "}]")).when(kind < 0.5, "").otherwise(F.concat(c, c))
            rest = F.substring(F.concat(c, tail), F.length(run) + 1, F.length(tail) + 1)
            return F.when(kind < 0.7, F.concat(head, one, tail)).otherwise(F.concat(head, made, rest))

        return let(at, lambda i: F.when(i.isNull(), F.array_join(tokens, "")).otherwise(changed(i)))

    return let(lexed(text), edited)


def add_trailing_commas(text: Column, d: Draws, p: float = 0.5) -> Column:
    """A comma before closing brackets with chance p, unless a comma or an opening bracket, or nothing, stands before."""

    def added(tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(tokens, i - 1))
            solid = F.when(before.rlike(BLANK), F.when(i > 1, F.get(tokens, i - 2))).otherwise(F.regexp_replace(before, r"[ \t\r\n]+\z", ""))
            last = F.coalesce(F.right(solid, F.lit(1)), F.lit(""))
            return F.when(_closer(t) & (d.hit(p, "t", i)) & ~last.isin("", ",", "{", "["), F.concat(F.lit(","), t)).otherwise(t)

        return F.array_join(F.transform(tokens, one), "")

    return let(lexed(text), added)


LINE_COMMENTS = (
    "// checked by hand", "// keep in sync", "// default", "// see ticket", "// temporary", "// legacy name",
    "// required", "// may be empty", "# generated", "# do not edit",
)
BLOCK_COMMENTS = ("/* begin */", "/* end of part */", "/* unused */", "/* set by caller */", "/* review */", "/* part two */")
BANNER = (
    ("Request as it was received", "Options of the current run", "State kept between calls", "Result of the last step"),
    ("Fields may come in any order", "Unknown fields are ignored", "Written by the exporter", "Sizes are in bytes"),
)


def insert_comments(text: Column, d: Draws) -> Column:
    """Comments on or after lines (chance 0.25 each), and now and then (0.3) a block over several lines."""

    def one(line: Column, i: Column) -> Column:
        pad, said = F.regexp_extract(line, r"^[ \t]*", 0), d.pick(LINE_COMMENTS, "said", i)
        alone = F.when(d.hit(0.5, "own", i), F.array(F.concat(line, F.lit(" "), said))).otherwise(F.array(line, F.concat(pad, said)))
        block = F.array(line, F.concat(pad, d.pick(BLOCK_COMMENTS, "said", i)))
        return F.when(d.u("t", i) >= 0.25, F.array(line)).when(d.hit(0.7, "kind", i), alone).otherwise(block)

    banner = F.concat(F.lit("/*\n * "), d.pick(BANNER[0], "first"), F.lit("\n * "), d.pick(BANNER[1], "second"), F.lit("\n */"))

    def with_banner(lines: Column) -> Column:
        at = 1 + F.floor(d.u("at") * (F.size(lines) - 1)).cast("int")
        more = F.concat(F.slice(lines, F.lit(1), at), F.array(banner), F.slice(lines, at + 1, F.size(lines)))
        return F.when((d.hit(0.3, "banner")) & (F.size(lines) > 2), more).otherwise(lines)

    return F.array_join(let(F.flatten(F.transform(F.split(text, "\n", -1), one)), with_banner), "\n")


def mangle_whitespace(text: Column, d: Draws) -> Column:
    """Indents in one of five styles, blank lines kept with chance 0.5 and added with chance 0.1."""

    def one(line: Column, i: Column) -> Column:
        bare, style = F.ltrim(line, F.lit(" \t")), F.floor(d.u("style", i) * 5)
        width = lambda n: F.floor(d.u("width", i) * n).cast("int")
        made = (
            F.when(style == 0, bare)
            .when(style == 1, F.concat(F.repeat(F.lit("\t"), width(4)), bare))
            .when(style == 2, F.concat(F.repeat(F.lit(" "), width(8)), bare))
            .when(style == 3, F.concat(F.lit("\t "), F.repeat(F.lit(" "), width(3)), bare))
            .otherwise(line)
        )
        full = F.when(d.hit(0.1, "extra", i), F.array(made, F.lit(""))).otherwise(F.array(made))
        kept = F.when(d.hit(0.5, "t", i), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(bare == "", kept).otherwise(full)

    return F.array_join(F.flatten(F.transform(F.split(text, "\n", -1), one)), "\n")


PREAMBLES = (
    "Here you go:\n", "The result:\n\n", "Sure, this is it:\n", "```json\n", "```\n", "Output:\n", "JSON below.\n\n",
    "I made the following:\n", "As asked:\n", "Answer: ", "<result>\n", "Let me see.\n\n", "Done. ", "> ", "\n\n",
)
POSTAMBLES = (
    "", "", "", "\n```", "\n\nAnything else?", "\n</result>", "\n\nThat is all.", "\n// end", "\n\nI hope this works.", "\n---",
    " (end)", "\n\nNote: values are examples.",
)


def add_wrapper(text: Column, d: Draws) -> Column:
    """Chatter before (chance 0.7) and after (0.5)."""
    before = F.when(d.hit(0.7, "before"), d.pick(PREAMBLES, "pre")).otherwise("")
    after = F.when(d.hit(0.5, "after"), d.pick(POSTAMBLES, "post")).otherwise("")
    return F.concat(before, text, after)


@dataclass(frozen=True)
class Profile:
    """Chances of the corruptions."""

    quote: float = 0.0
    comma: float = 0.0
    colon: float = 0.0
    comment: float = 0.0
    wrapper: float = 0.0
    trailing: float = 0.0
    whitespace: float = 0.0
    bracket: float = 0.0


#: The chances of the named profiles.
PROFILES = {
    "none": Profile(),
    "subtle": Profile(0.08, 0.05, 0.0, 0.0, 0.0, 0.15, 0.0, 0.05),
    "light": Profile(0.3, 0.2, 0.1, 0.2, 0.3, 0.2, 0.2, 0.10),
    "medium": Profile(0.5, 0.4, 0.2, 0.4, 0.5, 0.3, 0.4, 0.15),
    "heavy": Profile(0.7, 0.6, 0.4, 0.6, 0.7, 0.5, 0.6, 0.25),
}
#: The order in which a profile's corruptions run.
STEPS: tuple[tuple[str, Callable[[Column, Draws], Column]], ...] = (
    ("quote", strip_quotes), ("comma", drop_commas), ("colon", drop_colons), ("bracket", mangle_brackets),
    ("trailing", add_trailing_commas), ("comment", insert_comments), ("whitespace", mangle_whitespace), ("wrapper", add_wrapper),
)


def profiles_frame(spark: SparkSession) -> DataFrame:
    """The named profiles as a table of five rows."""
    names = [f.name for f in fields(Profile)]
    return spark.createDataFrame([(n, *astuple(p)) for n, p in PROFILES.items()], "name string, " + ", ".join(f"{n} double" for n in names))


def profile_mix(u: Column) -> Column:
    """Name of the profile for a uniform: subtle 40 %, light 35 %, light with wrapper 15 %, medium 10 %."""
    return F.when(u < 0.40, "subtle").when(u < 0.75, "light").when(u < 0.90, "light+wrapper").otherwise("medium")


def profile_stage(stage: Column, u: Column) -> Column:
    """By stage: none up to 3; 4: none 95, subtle 3, light 2; 5: none 90, subtle 5, light 3, light with wrapper 2."""
    four = F.when(u < 0.95, "none").when(u < 0.98, "subtle").otherwise("light")
    five = F.when(u < 0.90, "none").when(u < 0.95, "subtle").when(u < 0.98, "light").otherwise("light+wrapper")
    return F.when(stage <= 3, "none").when(stage == 4, four).otherwise(five)


def profile_plain(u: Column) -> Column:
    """none 25 %, light 35 %, medium 30 %, heavy 10 %."""
    return F.when(u < 0.25, "none").when(u < 0.60, "light").when(u < 0.90, "medium").otherwise("heavy")


def named(name: str) -> Profile:
    base, _, wrapped = name.partition("+")
    profile = PROFILES[base]
    return Profile(**{**profile.__dict__, "wrapper": 1.0}) if wrapped else profile


#: Names that a profile column may hold: each profile, also with a wrapper for certain.
NAMES = tuple(n + more for n in PROFILES for more in ("", "+wrapper"))


def _gated(done: Column, step: Callable[[Column, Draws], Column], d: Draws) -> Callable[[Column], Column]:
    return lambda text: F.when(done, step(text, d)).otherwise(text)


def corrupted(text: Column, profile: Column, key: Column, seed: int) -> Column:
    """Text corrupted by the profile named: its corruptions in order, each with its chance. Other names change nothing."""
    for name, step in STEPS:
        chances = F.create_map(*[F.lit(x) for n in NAMES for x in (n, getattr(named(n), name))])
        done = Draws(seed, key, name).u("do") < F.coalesce(F.try_element_at(chances, profile), F.lit(0.0))
        text = let(text, _gated(done, step, Draws(seed, key, name)))
    return text


def single(name: str, text: Column, key: Column, seed: int) -> Column:
    """One corruption for every row."""
    return let(text, lambda t: F.coalesce(dict(STEPS)[name](t, Draws(seed, key, name)), t))


def corrupt_lines(df: DataFrame, seed: int, pct: float = 100.0, key: str = "sample_id") -> DataFrame:
    """Pairs with `input` corrupted in pct percent of the rows by the mix of profiles; `target` is left alone."""
    name = F.when(u01(seed, key, "gate") * 100 < pct, profile_mix(u01(seed, key, "mix"))).otherwise("none")
    return df.withColumn("input", corrupted(F.col("input"), name, F.col(key), seed))


# --- native twins without chance


def without_name_quotes(c: Column) -> Column:
    return F.regexp_replace(c, r'"(\w{1,50})"', "$1")


def without_signs(sign: str, c: Column) -> Column:
    """Every `sign` outside of string literals goes: a literal is matched first and kept."""
    return F.regexp_replace(c, rf'("(?:[^"\\]|\\.)*")|{re.escape(sign)}', "$1")


def with_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r"([^,{\[\s])(\s*[}\]])", "$1,$2")


def without_indent(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.ltrim(x)), "\n")


def wrapped(c: Column, key: str, seed: int) -> Column:
    """Chatter before and after chosen by hash, natively."""
    before = F.element_at(F.array(*map(F.lit, PREAMBLES)), F.floor(u01(seed, key, "pre") * len(PREAMBLES)).cast("int") + 1)
    after = F.element_at(F.array(*map(F.lit, POSTAMBLES)), F.floor(u01(seed, key, "post") * len(POSTAMBLES)).cast("int") + 1)
    return F.concat(before, c, after)
