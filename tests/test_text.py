from __future__ import annotations

from pyspark.sql import functions as F

from runsieve.functions.arrays import explode_once, let
from runsieve.functions.text import alnum_tokens, or_arr, or_str, quoted_list_sql, strip, strip_sql, ws_tokens, ws_tokens_sql


def test_strip_matches_python(spark):
    texts = [" a ", "\t\na ", "　a b ", "\x1ca\x1f", "", " \n ", "a​b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")), F.expr(strip_sql("t")))
    for text, one, two in df.collect():
        assert one == two == text.strip()


def test_tokens_match_python(spark):
    texts = ["The the\tTHE cat", "  ", "", "a　b\x1cc", "x, y; x,"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, one, two in df.select("t", ws_tokens(F.col("t")), F.expr(ws_tokens_sql("t"))).collect():
        assert set(one) == set(two) == set(text.lower().split())
    got = df.select(alnum_tokens(F.lit("A1-b2 É a1_"))).first()[0]
    assert got == ["a1", "b2"]


def test_truthiness_defaults(spark):
    df = spark.createDataFrame([(None, "", " "), ("", None, "x"), ("a", "b", "c")], "a string, b string, c string")
    assert [r[0] for r in df.select(or_str(F.col("a"), F.col("b"), F.col("c"))).collect()] == [" ", "x", "a"]
    arr = spark.createDataFrame([([], ["x"]), (None, []), (["y"], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in arr.select(or_arr(F.col("a"), F.col("b"))).collect()] == [["x"], None, ["y"]]


def test_quoted_list_matches_python_notation(spark):
    names = [["a", "b"], [], ["it's"], ['say "x"'], ["both ' and \""], ["line\nbreak", "tab\t", "back\\slash", "cr\r"]]
    df = spark.createDataFrame([(n,) for n in names], "n array<string>")
    for listed, text in df.select("n", F.expr(quoted_list_sql("n"))).collect():
        assert text == str(list(listed))


def test_let_and_explode_once(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k int, xs array<string>")
    assert df.select(let(F.col("k") + 1, lambda v: v * v)).first()[0] == 4
    rows = explode_once(df, "xs", "x", "i").select("k", "i", "x").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a"), (1, 1, None)]
