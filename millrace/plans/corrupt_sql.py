"""DuckDB SQL for the seeded corruptions: the same uniforms of seed, key, corruption and place, step by step."""

from __future__ import annotations

from ..functions.rng import u01_sql
from ..operators import corrupt

TOKEN = r'(?s)"(?:[^"\\]|\\.)*"|".*|[{}\[\],:]|[^"{}\[\],:]+'
BLANK = r"[ \t\r\n]+"


def texts(values: tuple[str, ...]) -> str:
    """A list literal."""
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


class Step:
    """One corruption over the columns `key` and `text`; places count from 0."""

    def __init__(self, seed: int, name: str):
        self.seed, self.name = seed, name

    def u(self, what: str, place: str | None = None) -> str:
        tail = "" if place is None else f"' || ({place}) || '"
        return u01_sql(self.seed, "key", f"{self.name}.{what}{tail}")

    def pick(self, values: tuple[str, ...], what: str, place: str | None = None) -> str:
        return f"{texts(values)}[floor({self.u(what, place)} * {len(values)})::INT + 1]"

    def expression(self) -> str:
        """Over key, text, t (tokens) and l (lines)."""
        u = self.u
        each = "array_to_string([{} FOR i IN range(len(t))], '')".format
        closer = "t[i + 1] IN (']', '}')"
        if self.name == "quote":
            name = "regexp_full_match(t[i + 1], '\"[A-Za-z0-9_]{1,50}\"')"
            return each(f"CASE WHEN {name} AND {u('t', 'i')} < 0.6 THEN t[i + 1][2:-2] ELSE t[i + 1] END")
        if self.name == "comma":
            return each(f"CASE WHEN t[i + 1] = ',' AND {u('t', 'i')} < 0.4 THEN CASE WHEN {u('space', 'i')} < 0.5 THEN ' ' ELSE '' END ELSE t[i + 1] END")
        if self.name == "colon":
            return each(f"CASE WHEN t[i + 1] = ':' AND {u('t', 'i')} < 0.4 THEN ' ' ELSE t[i + 1] END")
        if self.name == "trailing":
            before = f"CASE WHEN i = 0 THEN '' WHEN regexp_full_match(t[i], '{BLANK}') THEN CASE WHEN i > 1 THEN t[i - 1] ELSE '' END ELSE regexp_replace(t[i], '{BLANK}\\z', '') END"
            return each(f"CASE WHEN {closer} AND {u('t', 'i')} < 0.5 AND right({before}, 1) NOT IN ('', ',', '{{', '[') THEN ',' || t[i + 1] ELSE t[i + 1] END")
        if self.name == "comment":
            said, pad = self.pick(corrupt.LINE_COMMENTS, "said", "i"), "regexp_extract(l[i + 1], '^[ \\t]*')"
            own = f"CASE WHEN {u('own', 'i')} < 0.5 THEN [l[i + 1] || ' ' || {said}] ELSE [l[i + 1], {pad} || {said}] END"
            block = f"[l[i + 1], {pad} || {self.pick(corrupt.BLOCK_COMMENTS, 'said', 'i')}]"
            lines = f"flatten([CASE WHEN {u('t', 'i')} >= 0.25 THEN [l[i + 1]] WHEN {u('kind', 'i')} < 0.7 THEN {own} ELSE {block} END FOR i IN range(len(l))])"
            banner = f"'/*' || chr(10) || ' * ' || {self.pick(corrupt.BANNER[0], 'first')} || chr(10) || ' * ' || {self.pick(corrupt.BANNER[1], 'second')} || chr(10) || ' */'"
            at = f"(1 + floor({u('at')} * (len(o) - 1))::INT)"
            more = f"CASE WHEN {u('banner')} < 0.3 AND len(o) > 2 THEN o[:{at}] || [{banner}] || o[{at} + 1:] ELSE o END"
            return f"array_to_string([{more} FOR o IN [{lines}]][1], chr(10))"
        if self.name == "whitespace":
            bare, style = "ltrim(l[i + 1], ' ' || chr(9))", f"floor({u('style', 'i')} * 5)"
            width = lambda n: f"floor({u('width', 'i')} * {n})::INT"
            made = (
                f"CASE {style} WHEN 0 THEN {bare} WHEN 1 THEN repeat(chr(9), {width(4)}) || {bare} WHEN 2 THEN repeat(' ', {width(8)}) || {bare}"
                f" WHEN 3 THEN chr(9) || ' ' || repeat(' ', {width(3)}) || {bare} ELSE l[i + 1] END"
            )
            full = f"CASE WHEN {u('extra', 'i')} < 0.1 THEN [{made}, ''] ELSE [{made}] END"
            return f"array_to_string(flatten([CASE WHEN {bare} = '' THEN CASE WHEN {u('t', 'i')} < 0.5 THEN [''] ELSE []::VARCHAR[] END ELSE {full} END FOR i IN range(len(l))]), chr(10))"
        if self.name == "wrapper":
            return (
                f"CASE WHEN {u('before')} < 0.7 THEN {self.pick(corrupt.PREAMBLES, 'pre')} ELSE '' END || text || "
                f"CASE WHEN {u('after')} < 0.5 THEN {self.pick(corrupt.POSTAMBLES, 'post')} ELSE '' END"
            )
        kind = u("kind")
        run = f"coalesce(t[i + 2] IN (']', '}}') OR regexp_full_match(t[i + 2], '{BLANK}') AND t[i + 3] IN (']', '}}'), false)"
        chosen = f"{closer} AND {u('t', 'i')} < CASE WHEN {kind} >= 0.3 AND {kind} < 0.7 THEN 0.3 ELSE 0.4 END AND ({kind} < 0.7 OR {run})"
        rest = "array_to_string(t[hit + 1:], '')"
        found = f"regexp_extract({rest}, '^[\\]}}](?:[ \\t\\r\\n]*[\\]}}])+[ \\t\\r\\n]*')"
        count = f"len(regexp_replace({found}, '[^\\]}}]', '', 'g')) + floor({u('more')} * 3)::INT"
        made = f"array_to_string([CASE WHEN {u('made', 'k')} < 0.4 THEN ']' ELSE '}}' END FOR k IN range(1, {count} + 1)], '')"
        one = f"CASE WHEN {kind} < 0.3 THEN translate(t[hit + 1], ']}}', '}}]') WHEN {kind} < 0.5 THEN '' ELSE t[hit + 1] || t[hit + 1] END || array_to_string(t[hit + 2:], '')"
        changed = f"array_to_string(t[:hit], '') || CASE WHEN {kind} < 0.7 THEN {one} ELSE {made} || substr({rest}, len({found}) + 1) END"
        return f"[CASE WHEN hit IS NULL THEN text ELSE {changed} END FOR hit IN [list_filter([CASE WHEN {chosen} THEN i END FOR i IN range(len(t))], lambda x: x IS NOT NULL)[1]]][1]"


def _lexed(source: str) -> str:
    return f"(SELECT *, regexp_extract_all(text, '{TOKEN}') AS t, string_split(text, chr(10)) AS l FROM {source})"


def single(name: str, source: str, seed: int = 42) -> str:
    """SELECT key, text: one corruption of every row of source."""
    return f"SELECT key, {Step(seed, name).expression()} AS text FROM {_lexed(source)}"


def profiled(source: str, seed: int = 42) -> str:
    """Common tables (to follow WITH) that lead from source (key, text, profile) to `corrupted` (key, text, profile)."""
    out, last = [], source
    for name, _ in corrupt.STEPS:
        chances = {n: getattr(corrupt.named(n), name) for n in corrupt.NAMES}
        chance = "CASE profile " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in chances.items() if c) + " ELSE 0.0 END"
        step = Step(seed, name)
        this = "corrupted" if name == corrupt.STEPS[-1][0] else f"after_{name}"
        out.append(f"{this} AS MATERIALIZED (SELECT * EXCLUDE (text, t, l), CASE WHEN {step.u('do')} < {chance} THEN {step.expression()} ELSE text END AS text FROM {_lexed(last)})")
        last = this
    return ",\n".join(out)
