"""JSON text: strict parsing, and writing with sorted keys in the pretty and compact layouts of the corpus.

Written text escapes <, >, & and the line separators U+2028 and U+2029, and writes doubles with an exponent only below
1e-6 and from 1e21 on.
"""

from __future__ import annotations

import json
import math
from typing import Any

_ESCAPES = str.maketrans({"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"})


def _constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


def _number(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("a number beyond the range of doubles")
    return value


_DECODER = json.JSONDecoder(parse_constant=_constant, parse_float=_number, parse_int=_number, strict=True)


def parse(text: str) -> Any:
    """The value of a strict JSON text, all numbers as doubles; ValueError where it is not one.

    A repeated key's last value counts; lone surrogates become U+FFFD.
    """
    if text is None:
        raise ValueError("null")
    try:
        value = _DECODER.decode(text.strip(" \t\n\r") if text[:1] in " \t\n\r" or text[-1:] in " \t\n\r" else text)
    except RecursionError as e:
        raise ValueError("nested too deep") from e
    return _clean(value)


def _clean(value: Any) -> Any:
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not value.isascii() else value
    if isinstance(value, list):
        return [_clean(v) for v in value]
    if isinstance(value, dict):
        return {_clean(k): _clean(v) for k, v in value.items()}
    return value


def valid(text: str | None) -> bool:
    try:
        parse(text)
    except ValueError:
        return False
    return True


def shortest(value: float) -> tuple[str, str, int]:
    """Sign, digits and decimal exponent (of the first digit) of the shortest text that reads back as value."""
    mantissa, _, exponent = f"{value!r}".lower().partition("e")
    sign = "-" if mantissa.startswith("-") else ""
    whole, _, part = mantissa.lstrip("-").partition(".")
    digits = (whole + part).lstrip("0")
    if not digits.strip("0"):
        return sign, "0", 0
    place = len(whole) - 1 if whole.strip("0") else -1 - (len(part) - len(part.lstrip("0")))
    if whole.strip("0"):
        place = len(whole.lstrip("0")) - 1
    return sign, digits.rstrip("0"), place + int(exponent or 0)


def plain(sign: str, digits: str, exponent: int) -> str:
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    head, tail = digits[: exponent + 1].ljust(exponent + 1, "0"), digits[exponent + 1 :]
    return f"{sign}{head}.{tail}" if tail else sign + head


def scientific(sign: str, digits: str, exponent: int, width: int = 2) -> str:
    point = "." + digits[1:] if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{point}e{'-' if exponent < 0 else '+'}{abs(exponent):0{width}d}"


def number(value: float) -> str:
    """A number as JSON writes it."""
    if value == 0:
        return "-0" if math.copysign(1, value) < 0 else "0"
    small = abs(value) < 1e-6
    parts = shortest(value)
    return scientific(*parts, width=1 if small and parts[2] > -10 else 2) if small or abs(value) >= 1e21 else plain(*parts)


def _string(value: str) -> str:
    return json.dumps(value, ensure_ascii=False).replace("\x7f", "\x7f").translate(_ESCAPES)


def _write(value: Any, newline: str, indent: str, colon: str) -> str:
    if isinstance(value, dict):
        if not value:
            return "{}"
        inner = newline + indent if newline else ""
        parts = [f"{_string(k)}{colon}{_write(value[k], inner, indent, colon)}" for k in sorted(value, key=str.encode)]
        return "{" + inner + ("," + inner).join(parts) + newline + "}"
    if isinstance(value, list):
        if not value:
            return "[]"
        inner = newline + indent if newline else ""
        return "[" + inner + ("," + inner).join(_write(v, inner, indent, colon) for v in value) + newline + "]"
    if isinstance(value, str):
        return _string(value)
    if value is True or value is False:
        return "true" if value else "false"
    return "null" if value is None else number(value)


def pretty(value: Any) -> str:
    return _write(value, "\n", "  ", ": ")


def compact(value: Any) -> str:
    return _write(value, "", "", ":")


def compact_text(text: str | None) -> str | None:
    """The compact layout of a JSON text; text that is not JSON stays as it is."""
    try:
        return compact(parse(text))
    except ValueError:
        return text
