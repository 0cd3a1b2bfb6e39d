"""What a report shows."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import views
from tallyloom.operators import markdown


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression.alias("v")).first()["v"]


def test_texts(spark):
    assert one(spark, views.without_title(F.col("t")), t="## Head\nbody\n## Next") == "body\n## Next"
    assert one(spark, views.without_title(F.col("t")), t="body\n# Later") == "body\n# Later"
    assert one(spark, views.linked(F.col("t")), t="see [@E012], [@E1]") == "see [E012](#evidence-E012), [@E1]"
    assert one(spark, views.display_path(F.col("t"), "/root/x/"), t="/root/x/a/b") == "a/b"
    assert one(spark, views.display_path(F.col("t"), "/root/x"), t="/root/xy/b") == "/root/xy/b"
    lines = one(spark, views.numbered_lines(F.col("t"), F.col("n")), t="a\r\nb", n=7)
    assert [tuple(x) for x in lines] == [(7, "a"), (8, "b")]


@pytest.mark.parametrize(("json", "text"), [('["a", "b"]', "a, b"), ("[]", "-"), ('""', "-"), ("null", "-"), ("12.5", "12.5"), ('"x \\"y\\""', 'x "y"'), ('{"a": 1}', '{"a": 1}')])
def test_fact_values(spark, json, text):
    assert one(spark, views.fact_text(F.col("j")), j=json) == text


def test_lists(spark):
    row = one(spark, views.chips(F.col("a"), F.col("e")), a=list("abcde"), e=["E001", "E002", "E003", "E004", "E005", "E006"])
    assert (row["anchors"], row["evidence_ids"], row["more"]) == (["a", "b", "c"], ["E001", "E002", "E003", "E004"], 2)
    all_views = spark.createDataFrame([("overview",), ("risk",)], "view string")
    assert [r["view"] for r in views.active_views(all_views, spark.createDataFrame([("risk",), ("risk",)], "view string")).collect()] == ["risk"]
    cards = spark.createDataFrame([("w", "E001", "k", "t", "x", 2), ("w", "E001", "k", "first", "x", 1), ("v", "E002", "k", "t", "x", 1)], "work_id string, evidence_id string, kind string, title string, excerpt string, n int")
    held = {r["work_id"]: r["cards"] for r in views.card_map(cards).collect()}
    assert held["w"]["E001"]["title"] == "first" and list(held["v"]) == ["E002"]


def test_sources(spark):
    asked = [("w", None, None), (None, "/r", "Name"), (None, "/r", " "), ("w", "/r", "Name"), (None, None, None)]
    got = spark.createDataFrame(asked, "work_id string, repo string, display_name string").select(views.source_problem(F.col("work_id"), F.col("repo"), F.col("display_name")).alias("p")).collect()
    assert [bool(r["p"]) for r in got] == [False, False, True, True, True]


def test_identities(spark):
    df = spark.createDataFrame([("w", "W", "c", "p", "s", "function", "c", 1, 2, "u")], "work_id string, display_name string, commit string, path string, symbol string, kind string, lang string, line int, end_line int, unit_id string")
    row = df.select(views.snapshot_identity(), views.unit_identity()).first()
    assert tuple(row["snapshot"]) == ("w", "W", "c") and row["unit"]["unit_id"] == "u"


def test_line_spans(spark):
    rows = spark.createDataFrame([(1, "a\r\nb c\n"), (2, "a")], "k long, text string")
    assert [(r["k"], r["n"], r["line"]) for r in markdown.line_span(rows, "k", 2, 9).collect()] == [(1, 2, "b"), (1, 3, "c")]
    with pytest.raises(Exception, match="past the end"):
        markdown.line_span(rows, "k", 1, 2, strict=True).collect()
