"""JSON values as canonical XML, and checks of XML text.

Vocabulary: object, entry, key, value, array. Two spaces a level, a line feed after each line. Keys are sorted by their
bytes; strings are CDATA always, keys only where they hold one of < > & " '. A nested container stands on lines of its
own inside <value>.
"""

from __future__ import annotations

from typing import Any
from xml.etree import ElementTree
from xml.parsers import expat

from . import jsontext

_MARKUP = frozenset("<>&\"'")


def cdata(text: str, compat: bool = False) -> str:
    """A CDATA section; "]]>" is split over two. compat opens a third section, as older corpora have it, which changes
    the content."""
    join = "]]]]><![CDATA[>" + ("<![CDATA[" if compat else "")
    return "<![CDATA[" + join.join(text.split("]]>")) + "]]>"


def key_text(key: str, compat: bool = False) -> str:
    return cdata(key, compat) if _MARKUP.intersection(key) else key


def number_text(value: float) -> str:
    """Integers up to 1e15 in full; else the shortest digits, with an exponent below 1e-4 and from 1e6 on."""
    if value == int(value) and abs(value) <= 1e15:
        return str(int(value))
    sign, digits, exponent = jsontext.shortest(value)
    if exponent < -4 or exponent >= 6:
        return jsontext.scientific(sign, digits, exponent)
    return jsontext.plain(sign, digits, exponent)


def _scalar(value: Any, compat: bool) -> str:
    if isinstance(value, str):
        return cdata(value, compat)
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    return number_text(float(value))


def _lines(value: Any, level: int, compat: bool, out: list[str]) -> None:
    pad = "  " * level
    if isinstance(value, dict):
        out.append(f"{pad}<object>")
        for key in sorted(value, key=str.encode):
            item = value[key]
            out += [f"{pad}  <entry>", f"{pad}    <key>{key_text(key, compat)}</key>"]
            if isinstance(item, (dict, list)):
                out.append(f"{pad}    <value>")
                _lines(item, level + 3, compat, out)
                out.append(f"{pad}    </value>")
            else:
                out.append(f"{pad}    <value>{_scalar(item, compat)}</value>")
            out.append(f"{pad}  </entry>")
        out.append(f"{pad}</object>")
    elif isinstance(value, list):
        out.append(f"{pad}<array>")
        for item in value:
            if isinstance(item, (dict, list)):
                out.append(f"{pad}  <value>")
                _lines(item, level + 2, compat, out)
                out.append(f"{pad}  </value>")
            else:
                out.append(f"{pad}  <value>{_scalar(item, compat)}</value>")
        out.append(f"{pad}</array>")
    else:
        out.append(f"{pad}<value>{_scalar(value, compat)}</value>")


def to_xml(value: Any, compat: bool = False) -> str:
    out: list[str] = []
    _lines(value, 0, compat, out)
    return "\n".join(out) + "\n"


def json_to_xml(text: str | None, compat: bool = False) -> str | None:
    """The XML of a JSON text; None where it is not JSON."""
    try:
        return to_xml(jsontext.parse(text), compat)
    except ValueError:
        return None


def xml_to_value(text: str) -> Any:
    """The JSON value that canonical XML stands for; scalars outside CDATA are read as JSON."""
    marked = text.replace("<value><![CDATA[", "<value kind='text'><![CDATA[")
    return _value(ElementTree.fromstring(marked))


def _value(node: ElementTree.Element) -> Any:
    if node.tag == "object":
        return {(e.find("key").text or ""): _value(e.find("value")) for e in node}
    if node.tag == "array":
        return [_value(v) for v in node]
    if len(node):
        return _value(node[0])
    return (node.text or "") if node.get("kind") else jsontext.parse(node.text)


def fault(text: str, wrap: bool = True) -> str | None:
    """The parser's message for text (inside a root element if wrap), None where it is well formed."""
    parser = expat.ParserCreate()
    try:
        parser.Parse(f"<root>{text}</root>" if wrap else text, True)
    except (expat.ExpatError, ValueError) as e:
        return str(e)
    return None


def well_formed(text: str | None) -> bool:
    """Text, and any number of elements, is well formed inside one root."""
    return text is not None and fault(text) is None


def is_document(text: str | None) -> bool:
    """Text is one XML document with a single root."""
    return text is not None and fault(text, wrap=False) is None


def flatten(text: str | None) -> list[tuple[str, str]] | None:
    """Start and end names and trimmed, white-space-collapsed texts in order; None where text is not well formed.

    Each CDATA section and each run of other text is a token of its own.
    """
    if text is None:
        return None
    parser, out, held = expat.ParserCreate(), [], []

    def flush() -> None:
        found = " ".join("".join(held).split())
        held.clear()
        if found:
            out.append(("text", found))

    def start(name: str, _: dict) -> None:
        flush()
        out.append(("start", name))

    def end(name: str) -> None:
        flush()
        out.append(("end", name))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = held.append
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = flush
    parser.CommentHandler = lambda _: flush()
    parser.ProcessingInstructionHandler = lambda *_: flush()
    try:
        parser.Parse(f"<root>{text}</root>", True)
    except (expat.ExpatError, ValueError):
        return None
    return out[1:-1]


def same_meaning(a: str | None, b: str | None) -> bool:
    """Equal flattened forms; text that is not well formed equals nothing."""
    left = flatten(a)
    return left is not None and left == flatten(b)


def fault_kind(text: str, tokens: int = 0) -> str | None:
    """Why text is no document: unclosed_cdata, unclosed_tag, truncated (from 4090 tokens on) or other; None if it is."""
    found = fault(text, wrap=False)
    if found is None:
        return None
    if "unclosed CDATA" in found:
        return "unclosed_cdata"
    if "mismatched tag" in found or "unclosed token" in found:
        return "unclosed_tag"
    return "truncated" if tokens >= 4090 else "other"
