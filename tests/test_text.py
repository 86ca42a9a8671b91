import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import jsontext, xmltext

GOLDEN = """<object>
  <entry>
    <key>name</key>
    <value><![CDATA[alice]]></value>
  </entry>
  <entry>
    <key>tags</key>
    <value>
      <array>
        <value>1</value>
        <value>
          <object>
          </object>
        </value>
      </array>
    </value>
  </entry>
</object>
"""
SAFE = st.text(st.characters(blacklist_categories=("Cs", "Cc")), max_size=12)
VALUES = st.recursive(
    st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | SAFE,
    lambda v: st.lists(v, max_size=4) | st.dictionaries(SAFE, v, max_size=4),
    max_leaves=20,
)


def test_golden_xml():
    assert xmltext.json_to_xml('{"tags":[1,{}],"name":"alice"}') == GOLDEN
    assert xmltext.json_to_xml("{}") == "<object>\n</object>\n" and xmltext.json_to_xml("[]") == "<array>\n</array>\n"
    assert xmltext.json_to_xml('"x"') == "<value><![CDATA[x]]></value>\n" and xmltext.json_to_xml("{invalid") is None
    keys = xmltext.json_to_xml('{"<b>": 1, "a&b": 2, "plain": 3}')
    assert "<key><![CDATA[<b>]]></key>" in keys and "<key>plain</key>" in keys
    order = xmltext.json_to_xml('{"pear": [], "Quince": 5, "\u00e9clair": 0, "fig": 9}')
    assert order.index("Quince") < order.index("fig") < order.index("pear") < order.index("\u00e9clair")
    assert xmltext.json_to_xml(json.dumps({f"k{i}": i for i in range(100)})).count("<entry>") == 100


@pytest.mark.parametrize(
    "value, json_form, xml_form",
    [
        (0.0, "0", "0"), (-0.0, "-0", "0"), (1e15, "1000000000000000", "1000000000000000"), (1e16, "10000000000000000", "1e+16"),
        (1e21, "1e+21", "1e+21"), (1234567.5, "1234567.5", "1.2345675e+06"), (0.00001, "0.00001", "1e-05"), (3.14, "3.14", "3.14"),
        (0.1 + 0.2, "0.30000000000000004", "0.30000000000000004"), (1e-7, "1e-7", "1e-07"), (-2.5, "-2.5", "-2.5"), (123456.7, "123456.7", "123456.7"),
    ],
)
def test_numbers(value, json_form, xml_form):
    assert jsontext.number(value) == json_form and xmltext.number_text(value) == xml_form


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_round_trips(value):
    for text in (jsontext.pretty(value), jsontext.compact(value)):
        assert jsontext.parse(text) == value
    xml = xmltext.to_xml(value)
    if xmltext.well_formed(xml):
        back = xmltext.xml_to_value(xml.replace("\r", "&#13;"))
        assert json.dumps(back, sort_keys=True) == json.dumps(jsontext.parse(jsontext.compact(value)), sort_keys=True) or "\r" in xml or "-0" in jsontext.compact(value)


def test_strictness():
    for good in ("1", '"a"', " [1]\n", '{"a":1,"a":2}', '"\\ud800"'):
        assert jsontext.valid(good)
    for bad in ("", "NaN", "[Infinity]", '{"a":1} x', '{"a":1}]', "{'a':1}", "[1,]", "01", "1e999", '"\t"', None):
        assert not jsontext.valid(bad)
    assert jsontext.parse('{"a":1,"a":2}') == {"a": 2.0} and jsontext.parse('"\\ud800"') == "�"
    assert jsontext.parse("123456789012345678901234567890") == 1.2345678901234568e29
    assert jsontext.compact({"b": "<&>\u2028 ", "a": [1.0, None, True]}) == '{"a":[1,null,true],"b":"\\u003c\\u0026\\u003e\\u2028 "}'
    assert jsontext.compact_text("{broken") == "{broken"


def test_cdata_end_survives():
    assert xmltext.xml_to_value(xmltext.json_to_xml('{"note": "]]>]] >end]]>"}')) == {"note": "]]>]] >end]]>"}
    assert xmltext.xml_to_value(xmltext.json_to_xml('{"note": "]]>]] >end]]>"}', compat=True)) != {"note": "]]>]] >end]]>"}
    assert not xmltext.well_formed(xmltext.json_to_xml('"\\u0000"'))


def test_xml_checks():
    assert xmltext.well_formed("") and xmltext.well_formed("a<b/><c/>") and not xmltext.well_formed("<a>")
    assert xmltext.is_document("<a/>") and not xmltext.is_document("<a/><b/>") and not xmltext.is_document("")
    assert xmltext.flatten("<a> x  y<!-- c --><b><![CDATA[1]]>2</b></a>") == [
        ("start", "a"), ("text", "x y"), ("start", "b"), ("text", "1"), ("text", "2"), ("end", "b"), ("end", "a"),
    ]
    assert xmltext.same_meaning("<a> x </a>", "<a>x</a>") and not xmltext.same_meaning("<a>", "<a>") and not xmltext.same_meaning(None, None)
    assert xmltext.fault_kind("<a><![CDATA[x") == "unclosed_cdata" and xmltext.fault_kind("<a></b>") == "unclosed_tag"
    assert xmltext.fault_kind("<a>", 5000) == "truncated" and xmltext.fault_kind("<a>", 5) == "other" and xmltext.fault_kind("<a/>") is None
    assert math.isclose(float(xmltext.number_text(1e300)), 1e300)
