"""The column rules on odd values."""

from pyspark.sql import functions as F

from lodestone.functions import rules


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"i int, {ddl}").orderBy("i").select(column).collect()]


def test_doc_numbers(spark):
    codes = ["12/TT-X", "12/2020", "12/2020/ND-CP", "12/2020/17", "12", "", None, "1/2/Đ/4", "a/1/2"]
    assert values(spark, [(c,) for c in codes], "c string", rules.doc_number_ok(F.col("c"))) == [True, False, True, False, False, False, False, True, False]


def test_confidence_and_first_score(spark):
    assert values(spark, [(None,), (-1.0,), (0.4,), (7.0,)], "v double", rules.confidence(F.col("v"))) == [0.7, 0.0, 0.4, 1.0]
    pairs = [(0.0, 0.5), (None, 0.25), (0.75, 0.5), (0.0, None), (None, None)]
    assert values(spark, pairs, "a double, b double", rules.first_score(F.col("a"), F.col("b"))) == [0.5, 0.25, 0.75, 0.0, 0.0]


def test_citation(spark):
    rows = [("Law  on\nbanks", "12/X", 3, 9), ("Law 12/X", "12/X", None, 9), ("w" * 200, "12/X", 1, 9)]
    got = values(spark, rows, "title string, code string, article int, chunk int", rules.cited(*map(F.col, ("title", "code", "article", "chunk"))))
    assert got[:2] == ["[Law on banks (12/X) | Điều 3 | 9]", "[Law 12/X | 9]"] and got[2] == "[" + "w" * 139 + "… | Điều 1 | 9]"


def test_numbers(spark):
    assert values(spark, [("a1 22 1",), ("",), ("none",)], "t string", rules.numbers(F.col("t"))) == [["1", "22"], [], []]
