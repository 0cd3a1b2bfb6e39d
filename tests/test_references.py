"""Places that cite an id, against plain Python; an id that all documents cite."""

import re

from pyspark.sql import functions as F

from tallyloom.functions import texts as T
from tallyloom.operators import evidence

BODIES = [
    "[@E001]\n## One \n[@E002] [@E001]\r\n### deep [@E003]\n## Two\t[@E004]\n[@E001][@E001]",
    "## First\x0b[@E001] ## Second [@E002]\x85## Third\x1c[@E003]\r## Fourth\n",
    "##  \n[@E001]\n## \n[@E002]\n##x\n[@E003]\n## a ## b\n[@E004]\n####### no\n[@E005]\n x ## no\n[@E006]",
    "# Top [@E001]\n[@E12] [@E 123]\n##\ttab\n\n[@E1234]\n## One \n[@E001]",
    "",
    "\n## Empty",
    None,
]


def plain(docs, anchored):
    found = {}
    for path, body, anchor in docs:
        section = ""
        for line in (body or "").splitlines():
            if m := re.match(r"^##\s+(.+?)\s*$", line):
                section = m[1]
            for e in re.findall(r"\[@(E[0-9]{3,})\]", line):
                slug = re.sub(r"[^a-z0-9一-鿿-]+", "", re.sub(r"\s+", "-", section.strip().lower())) or "section"
                found.setdefault(e, set()).add((path, section, anchor if anchored else slug))
    return {e: (len(at), "|".join("#".join(x) for x in sorted(at))) for e, at in found.items()}


def test_places(spark):
    docs = [(f"p{i % 5}.md", body, f"a{i % 2}") for i, body in enumerate(BODIES + BODIES[:4])]
    table = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "id long, path string, body string, a string")
    for anchor in (None, F.col("a")):
        got = {r.evidence_id: (r.n, r.places) for r in evidence.reverse_references(table, anchor).collect()}
        assert got == plain(docs, anchor is not None)
    cut = table.where("body IS NOT NULL").select("body", T.sections(F.col("body")).alias("s")).collect()
    assert all("".join(r.s) == r.body for r in cut)


def test_an_id_that_all_cite_spans_tasks(spark):
    """Each text is read once, without a join, and the places of an id lie in many tasks before its row is put together."""
    n = 20_000
    docs = spark.range(n).select("id", F.format_string("p%05d", "id").alias("path"), F.lit("## S\n[@E001]").alias("body"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = evidence.reverse_references(docs)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        row = got.first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert "Join" not in plan and re.search(r"RepartitionByExpression \[evidence_id#\d+ ASC[^\]]*document#\d+ ASC", plan)
    assert (row.n, row.places) == (n, "|".join(f"p{i:05d}#S#s" for i in range(n)))
