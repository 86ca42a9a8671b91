import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import columns as fn


def test_few_rows_at_a_time():
    out = list(fn.json_to_xml.func(iter([pa.array(["[1]", None, "{"] * 300), pa.array([], pa.string())])))
    assert sum(map(len, out)) == 900 and max(map(len, out)) <= fn.ROWS
    assert pa.concat_arrays(out).to_pylist() == ["<array>\n  <value>1</value>\n</array>\n", None, None] * 300
    two = list(fn.xml_same_meaning.func(iter([(pa.array(["<a/>"] * 600), pa.array(["<a></a>", "<b/>"] * 300))])))
    assert max(map(len, two)) <= fn.ROWS and pa.concat_arrays(two).to_pylist() == [True, False] * 300


def test_several_functions_beside_and_inside_each_other(spark):
    rows = spark.range(2000).coalesce(1).select("id", F.concat(F.lit("["), "id", F.lit("]")).alias("j"))
    made = rows.select("id", fn.xml_document(fn.json_to_xml("j")).alias("a"), fn.json_valid(F.concat("j", F.lit("]"))).alias("b"), fn.compact_json(F.concat(F.lit(" "), "j")).alias("c"))
    assert all(r.a and not r.b and r.c == f"[{r.id}]" for r in made.collect())
