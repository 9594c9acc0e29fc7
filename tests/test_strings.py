"""String functions against plain Python."""

import uuid

from lodestone.functions import strings as S
from pyspark.sql import functions as F


def test_uuid5_is_the_standard_one(spark):
    names = ["", "1", "a b", "Điều 1", "x" * 300]
    got = [r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.uuid5(F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_marks_fold_to_plain_letters(spark):
    assert len(S.MARKED) == len(set(S.MARKED)) == len(S.PLAIN) == 67 and S.PLAIN.isascii()
    got = [r.f for r in spark.createDataFrame([("Thông tư số ế",), ("Điều",), (None,)], "n string").select(S.folded(F.col("n")).alias("f")).collect()]
    assert got == ["thong tu so e", "đieu", None]


def test_scalars_links_and_headings(spark):
    rows = [("plain", "[[a|b]] [[c]] [[a]]", "Điều 5"), ('a: "b\\', "", "x" * 221), ("", "[[", "ĐIỀU 5"), (None, None, None)]
    got = spark.createDataFrame(rows, "s string, l string, h string").select(S.yaml_scalar(F.col("s")), S.wikilinks(F.col("l")), S.heading(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("plain", ["a", "c"], "article"), ('"a: \\"b\\\\"', [], None), ('""', [], "article"), (None, None, None)]
