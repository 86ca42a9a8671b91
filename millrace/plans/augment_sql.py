"""DuckDB SQL for the augmentation of the JSON that agent_json makes of documents."""

from __future__ import annotations

from ..functions.rng import u01_sql
from ..operators import augment
from . import corrupt_sql


def u(seed: int, name: str, what: str, place: str | None = None) -> str:
    return u01_sql(seed, "key", f"{name}.{what}" + ("" if place is None else f"' || ({place}) || '"))


def new_text(text: str, path: str, s: augment.Settings, pool: tuple[str, ...] = augment.WORDS) -> str:
    """What becomes of a string at a path, for the row's key in column `key`."""
    d = lambda what, place=None: u(s.seed, f"text:{path}", what, place)
    words = f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')"
    shuffled = f"list_transform(list_sort([{{'u': {d('w', 'i')}, 'i': i, 'w': w[i + 1]}} FOR i IN range(len(w))]), lambda x: x.w)"
    count = f"CASE WHEN len(w) > 0 THEN len(w) ELSE 1 + floor({d('count')} * 3)::INT END"
    drawn = f"[{corrupt_sql.texts(pool)}[floor({d('pick', 'i')} * {len(pool)})::INT + 1] FOR i IN range({count})]"
    style = f"floor({d('space', 'i')} * 4)"
    sign = f"{corrupt_sql.texts(augment.SIGNS)}[floor({d('sign', 'i')} * {len(augment.SIGNS)})::INT + 1]"
    glued = f"c[i + 1] || CASE WHEN {style} IN (1, 3) THEN ' ' ELSE '' END || {sign} || CASE WHEN {style} IN (2, 3) THEN ' ' ELSE '' END"
    signed = f"array_to_string([CASE WHEN {d('t', 'i')} < {s.special} THEN {glued} ELSE c[i + 1] END FOR i IN range(len(c))], ' ')"
    chosen = f"CASE WHEN {d('dict')} * 100 < {s.dict_pct} THEN {drawn} WHEN len(w) > 0 THEN {shuffled} END"
    return f"[coalesce([{signed} FOR c IN [[{chosen} FOR w IN [{words}]][1]]][1], {text})][1]"


def json_text(value: str) -> str:
    return f"replace(replace(replace(to_json({value}), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"


def cut_text(text: str, s: augment.Settings) -> str:
    """truncate_json over the hexadecimal digits of the bytes."""
    pair, odd = "[0-9A-F]{2}", "(?:[0-46-9A-F][0-9A-F]|5[0-9ABD-F])"
    low = "(len(h) // 4)"
    at = f"({low} + floor({u(s.seed, 'augment', 'at')} * greatest(floor(len(h) / 2 * 9 / 10) - {low}, 1))::INT)"
    sign = f"len(regexp_extract(h[:2 * ({at} + 1)], '^(?:{pair})*(?:2C|5D|7D)'))"
    quote = f"len(regexp_extract(h[:2 * ({at} + 1)], '^(?:(?:{pair})*{odd})?(?:5C5C)*22'))"
    part = f"regexp_replace(h[:2 * {at}], '(?:[CD].|E.(?:[89AB].)?|F[0-7](?:[89AB].){{0,2}})$', '')"
    end = f"greatest({sign}, {quote})"
    return f"[decode(unhex(CASE WHEN {end} >= 2 * ({low} + 2) THEN h[:{end}] ELSE {part} END)) FOR h IN [hex(encode({text}))]][1]"


def _xml(key: str, value: str, cdata, level: int = 1) -> str:
    pad = "  " * level
    return f"'{pad}<entry>' || chr(10) || '{pad}  <key>{key}</key>' || chr(10) || '{pad}  <value>' || {cdata(value)} || '</value>' || chr(10) || '{pad}</entry>' || chr(10)"


def _lines(*lines: str) -> str:
    return " || ".join(f"'{x}' || chr(10)" for x in lines)


def variants(source: str, s: augment.Settings, cdata) -> str:
    """Common tables that lead from source (doc_id, text, lang, source, input, xml) to `made`: sample_id, variant_no, input,
    target, truncated, compacted, corrupted."""
    d = lambda what, place=None: u(s.seed, "augment", what, place)
    made = {
        "answer": new_text("text", "/answer", s), "m0": new_text("lang", "/memory/0", s), "m1": new_text("source", "/memory/1", s), "thought": new_text("text", "/thought", s),
        "asked": new_text("text", "/tool/arguments/query", s), "tool": new_text("'search'", "/tool/tool_name", s),
    }
    plain = {"answer": "text", "m0": "lang", "m1": "source", "thought": "text", "asked": "text", "tool": "'search'"}
    leaves = ", ".join(f"CASE WHEN v = 0 THEN {plain[k]} ELSE {x} END AS f_{k}" for k, x in made.items())
    n = "' || chr(10) || '"
    j = {k: json_text(f"f_{k}") for k in made}
    memory_xml = _lines("  <entry>", "    <key>memory</key>", "    <value>", "      <array>") + "".join(
        f" || '        <value>' || {cdata(f'f_{k}')} || '</value>' || chr(10)" for k in ("m0", "m1")
    ) + " || " + _lines("      </array>", "    </value>", "  </entry>")
    tool_xml = " || ".join(
        [
            _lines("  <entry>", "    <key>tool</key>", "    <value>", "      <object>", "        <entry>", "          <key>arguments</key>", "          <value>", "            <object>"),
            _xml("query", "f_asked", cdata, 7),
            _lines("            </object>", "          </value>", "        </entry>"),
            _xml("tool_name", "f_tool", cdata, 4),
            _lines("      </object>", "    </value>", "  </entry>"),
        ]
    )
    fields = {
        "answer": (f"'{n}  \"answer\": ' || {j['answer']}", f"'\"answer\":' || {j['answer']}", _xml("answer", "f_answer", cdata)),
        "memory": (f"'{n}  \"memory\": [{n}    ' || {j['m0']} || ',{n}    ' || {j['m1']} || '{n}  ]'", f"'\"memory\":[' || {j['m0']} || ',' || {j['m1']} || ']'", memory_xml),
        "thought": (f"'{n}  \"thought\": ' || {j['thought']}", f"'\"thought\":' || {j['thought']}", _xml("thought", "f_thought", cdata)),
        "tool": (
            f"'{n}  \"tool\": {{{n}    \"arguments\": {{{n}      \"query\": ' || {j['asked']} || '{n}    }},{n}    \"tool_name\": ' || {j['tool']} || '{n}  }}'",
            f"'\"tool\":{{\"arguments\":{{\"query\":' || {j['asked']} || '}},\"tool_name\":' || {j['tool']} || '}}'", tool_xml,
        ),
    }
    part = lambda which: "list_filter([" + ", ".join(f"CASE WHEN list_contains(shown, '{k}') THEN {x[which]} END" for k, x in fields.items()) + "], lambda x: x IS NOT NULL)"
    ranked = f"list_sort([{{'u': {u01_sql(s.seed, 'key', 'augment.key/' + chr(39) + ' || k || ' + chr(39))}, 'k': k}} FOR k IN names])"
    bad = r"[^\x09\x0a\x0d\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]"
    mix = d("mix")
    return f"""
fanned AS (
  SELECT *, doc_id || '/' || v AS key FROM {source}, range({s.variants + 1}) t(v)
), planned AS (
  SELECT *, v > 0 AND {d('memory')} * 100 < {s.drop_memory_pct} AS forgets, {d('truncate')} * 100 < {s.truncate_pct} AS cuts, {d('compact')} * 100 < {s.compact_pct} AS compacts FROM fanned
), namely AS (
  SELECT *, CASE WHEN forgets THEN [] ELSE ['memory'] END AS m, FROM planned
), with_names AS (
  SELECT *, CASE WHEN doc_id % 2 = 0 THEN ['answer'] || m || ['thought'] ELSE m || ['thought', 'tool'] END AS names FROM namely
), with_gone AS (
  SELECT *, CASE WHEN cuts THEN [x.k FOR x IN {ranked}[:CASE WHEN len(names) < 2 THEN 0 WHEN len(names) > 2 AND {d('two')} < 0.3 THEN 2 ELSE 1 END]] ELSE []::VARCHAR[] END AS gone FROM with_names
), with_leaves AS MATERIALIZED (
  SELECT *, list_filter(names, lambda k: NOT list_contains(gone, k)) AS shown, {leaves} FROM with_gone
), built AS MATERIALIZED (
  SELECT *, '{{' || array_to_string({part(0)}, ',') || chr(10) || '}}' AS pretty, '{{' || array_to_string({part(1)}, ',') || '}}' AS compact,
    {_lines('<object>')} || array_to_string({part(2)}, '') || {_lines('</object>')} AS new_xml
  FROM with_leaves
), judged AS (
  SELECT *, NOT regexp_matches(new_xml, '{bad}') AS sound FROM built
), firsts AS (
  SELECT *, cuts AND sound AS truncated, CASE WHEN cuts AND sound AND len(names) >= 2 THEN compact WHEN v = 0 THEN input ELSE pretty END AS first_text,
    CASE WHEN v = 0 AND NOT (cuts AND sound) THEN xml ELSE new_xml END AS target
  FROM judged
), seconds AS (
  SELECT *, truncated AND {d('cut')} < 0.5 AND strlen(first_text) >= 20 AS broken FROM firsts
), thirds AS MATERIALIZED (
  SELECT * EXCLUDE (text), CASE WHEN broken THEN {cut_text('first_text', s)} ELSE first_text END AS second_text FROM seconds
), finals AS MATERIALIZED (
  SELECT *, CASE WHEN compacts AND NOT broken THEN compact ELSE second_text END AS text, CASE WHEN compacts AND NOT broken THEN compact ELSE second_text END AS third_text,
    CASE WHEN {d('corrupt')} * 100 < {s.corrupt_pct} THEN CASE WHEN {mix} < 0.40 THEN 'subtle' WHEN {mix} < 0.75 THEN 'light' WHEN {mix} < 0.90 THEN 'light+wrapper' ELSE 'medium' END ELSE 'none' END AS profile
  FROM thirds
), {corrupt_sql.profiled("finals", s.seed)}, made AS (
  SELECT doc_id AS sample_id, v::INTEGER AS variant_no, CASE WHEN good THEN text END AS input, CASE WHEN good THEN target END AS target,
    good AND truncated AS truncated, good AND third_text <> second_text AS compacted, good AND text <> third_text AS corrupted
  FROM (SELECT *, v = 0 OR sound AS good FROM corrupted)
)"""
