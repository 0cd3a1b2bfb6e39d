"""Source text, Markdown, evidence and rules on small documents."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import texts as T
from tallyloom.operators import evidence, markdown, report, rules, units
from tallyloom.streaming import ingest


def values(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first()["v"]


def test_operands(spark):
    assert values(spark, "ADDI a0, sp, 16", T.operands) == ["addi", "REG", ",", "REG", ",", "16"]
    assert values(spark, "lw $t1,-8(x31)", T.operands) == ["lw", "REG", ",", "-8", "(", "REG", ")"]
    assert values(spark, "jal main 0x1F zero9", T.operands) == ["jal", "LBL", "0x1F", "LBL"]


def test_comments_are_cut_in_turn(spark):
    strip = lambda t: T.strip_line_comment(T.strip_block_comments(t))
    assert values(spark, "mov /* a\nb */ r1 ; c // d # e", strip).strip() == "mov   r1"
    assert values(spark, "add r1, #4", strip) == "add r1, "


def test_label_must_stand_alone(spark):
    text = "foo: add r1\n" + "bar:\n" + "nop\n" * 12
    got = units.assembly_units(spark.createDataFrame([(1, text)], "id long, text string")).collect()
    assert [(r["label"], r["n_items"]) for r in got] == [("bar", 12)]
    assert got[0]["shape"] == hashlib.sha256(" ".join(["nop"] * 12).encode()).hexdigest()
    few = units.assembly_units(spark.createDataFrame([(1, "bar:\n" + "nop\n" * 11)], "id long, text string"))
    assert few.count() == 0


def test_tree_shapes_ignore_text_and_attributes():
    a, b = units.tree_shape('<p class="x">one<b>two</b></p>'), units.tree_shape("<p>three<b></b></p>")
    assert a == b and a[1] == 2
    assert units.tree_shape("<p><b></b><i></i></p>") != units.tree_shape("<p><i></i><b></b></p>")
    assert units.tree_shape(None) == units.tree_shape("plain") and units.tree_shape("<div><br><img></div>")[1] == 3


def test_slugs(spark):
    assert values(spark, "  Hello, World  42 ", T.slugify) == "hello-world-42"
    assert values(spark, "内核 架构！", T.slugify) == "内核-架构"
    assert values(spark, "!!!", T.slugify) == "section"


def test_references_and_anchors(spark):
    assert values(spark, "a [@E001] b [@E12] [@E1000] [@E001]", T.references) == ["E001", "E1000", "E001"]
    text = "see `src/a.rs`, `not an anchor`, `Vm()` and kernel/mm/page.c, sys_open, CONFIG_X, debug=y, `src/a.rs`"
    assert values(spark, text, T.code_anchors) == ["src/a.rs", "Vm()", "kernel/mm/page.c", "sys_open", "CONFIG_X", "debug=y"]
    assert values(spark, "中a/b.c", T.code_anchors) == ["中a/b.c"]


DOC = "# T\nintro\n## A\n\n### A1\ntext\n## B\n  \n```\n# not code\n```\n## C"


def docs(spark, body=DOC):
    return spark.createDataFrame([(1, "modules/m.md", body)], "id long, path string, body string")


def test_headings_and_sections(spark):
    got = markdown.heading_spans(docs(spark)).orderBy("line").collect()
    assert [(r["line"], r["level"], r["title"], r["end_line"]) for r in got] == [(1, 1, "T", 2), (3, 2, "A", 4), (5, 3, "A1", 6), (7, 2, "B", 9), (10, 1, "not code", 11), (12, 2, "C", 12)]
    filled = {r["title"]: r["has_content"] for r in markdown.section_content(docs(spark)).collect()}
    assert filled == {"T": True, "A": True, "A1": True, "B": True, "not code": True, "C": False}
    assert markdown.section_lookup(docs(spark), "A1").first()["body"] == "text"
    assert markdown.section_lookup(docs(spark), "none").first()["has_heading"] is False
    assert markdown.heading_order(docs(spark), ["B", "A"]).first()["in_order"] is False
    assert markdown.optional_last(docs(spark), "C").first()["is_last"] is True


def test_line_ranges(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")], "id long, text string")
    assert [(r["n"], r["line"]) for r in markdown.line_span(df, "id", 2, 9).collect()] == [(2, "b"), (3, "c")]
    for start, end in ((0, 1), (4, 2)):
        with pytest.raises(ValueError):
            markdown.line_span(df, "id", start, end)


def test_frontmatter_forms(spark):
    texts = ["---\ncontract: module\nstatus: absent\n---\n# T", "# no front", "---\n- a\n- b\n---\nx", "---\nopen: [\n---\nx", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r for r in markdown.frontmatter(df, "text").collect()}
    assert (got[0]["contract"], got[0]["status"], got[0]["body"]) == ("module", "absent", "# T")
    assert got[1]["keys"] == "" and got[1]["body"] == "# no front" and got[2]["keys"] == "" and got[3]["keys"] == "" and got[4]["body"] == ""


CARD = "n long, evidence_id string, kind string, title string, source_name string, source_path string, raw_sha string, excerpt string, fact string, columns int, cells int"


def cards(spark, *rows):
    return spark.createDataFrame(list(rows), CARD)


def card(n, evidence_id="E001", kind="source_span", title="t", source="s", path="p", raw="", fact="f", columns=1, cells=1):
    return (n, evidence_id, kind, title, source, path, raw, "x", fact, columns, cells)


def test_signatures(spark):
    own = cards(spark, card(1), card(2, title="other"), card(3, kind="git_commit"), card(4, kind="search_result", fact="a"), card(5, kind="search_result", fact="b"), card(6, kind="search_result", fact="a", raw="r"), card(7, kind="search_result", fact="b", raw="r"))
    s = {r["n"]: r["signature"] for r in own.select("n", evidence.signature().alias("signature")).collect()}
    assert s[1] == s[2] != s[3] and s[4] != s[5] and s[6] == s[7]
    want = '{"facts":[],"kind":"source_span","raw_sha256":"","source":{"display_name":"s","path":"p"}}'
    assert s[1] == hashlib.sha256(want.encode()).hexdigest()


def test_append_numbers_go_on(spark):
    log = cards(spark, card(1, "E999", path="a")).withColumn("signature", evidence.signature())
    new = cards(spark, card(5, path="b"), card(6, path="a"), card(7, path="b"), card(8, path="c")).withColumn("signature", evidence.signature())
    got = evidence.append(log, new, "n").orderBy("n").collect()
    assert [(r["n"], r["evidence_id"]) for r in got] == [(5, "E1000"), (8, "E1001")]


def test_card_problems(spark):
    own = cards(spark, card(1), card(2, "E12"), card(4, kind="odd"), card(5, title=" "), card(7, source=""), card(9, columns=2), card(10, columns=2))
    got = {r["n"]: r["problem"] for r in evidence.validated(evidence.with_tables(own)).collect()}
    assert got == {1: "", 2: "id", 4: "kind", 5: "title", 7: "source", 9: "table", 10: ""}


def test_stream_keeps_each_signature_once(spark):
    rows = cards(spark, *[card(n, path=f"p{n % 7}") for n in range(1, 40)])
    found = ingest.run_once(rows, evidence.signature()).collect()  # files may arrive in any order
    assert sorted(r["evidence_id"] for r in found) == [f"E{n:03d}" for n in range(1, 8)]
    assert {r["n"] % 7 for r in found} == set(range(7)) and len({r["signature"] for r in found}) == 7


FIELDS = "id long, path string, contract string, status string, originality string, public string, module_id string, work_id string, commit_text string, body string"


def document(spark, **own):
    base = {"id": 1, "path": "modules/m.md", "contract": "module", "status": "absent", "originality": "novel", "public": "", "module_id": "memory", "work_id": "w", "commit_text": "", "body": "# T"}
    return spark.createDataFrame([tuple((base | own).values())], FIELDS)


def codes(found):
    return sorted(r["code"] for r in found.collect())


def test_field_rules(spark):
    check = lambda **own: codes(rules.structure_fields(document(spark, **own), ["module", "finding"]))
    assert check() == []
    assert check(contract="") == ["structure.missing_contract"]
    assert check(contract="odd") == ["structure.unknown_contract"]
    assert check(status="no", originality="no") == ["structure.invalid_enum"] * 2
    assert check(path="x.md") == ["structure.module_path_mismatch"]
    assert check(contract="finding", path="findings/f.md", status="findings", public="true") == []
    assert check(contract="finding", path="findings/f.md", status="no_findings", public="true") == ["structure.invalid_public"]


def test_heading_rules(spark):
    check = lambda body: codes(rules.structure_headings(document(spark, body=body), ["A", "B"], ["A", "B", "Z"], "Z"))
    assert check("# T\n## A\nx\n## B\ny\n## Z\nz") == []
    assert check("# T\n# U\n## A\nx\n## B\ny") == ["structure.h1"]
    assert check("# T\n## A\nx") == ["structure.missing_heading"]
    assert check("# T\n## A\n## B\ny") == ["structure.empty_heading"]
    assert check("# T\n## B\ny\n## A\nx") == ["structure.heading_order"]
    assert check("# T\n## A\nx\n## B\ny\n## Q\nq") == ["structure.unknown_h2"]
    assert check("# T\n## Z\nz\n## A\nx\n## B\ny") == ["structure.optional_heading_order"]
    assert check("# T\n## A\nx\n#### deep\nx\n## B\ny") == ["structure.heading_depth"]


def test_other_rules(spark):
    assert codes(rules.taxonomy_use(document(spark, module_id="x", body="# T\n### n1: t"), {"memory": ["n1"]})) == ["taxonomy.unknown_module", "taxonomy.unknown_node"]
    assert codes(rules.base(document(spark, status="implemented", commit_text="xyz", originality="external"))) == ["base.commit_missing", "base.introduction_kind"]
    assert codes(rules.base(document(spark, commit_text="abcdef1"))) == ["base.unexpected_value"]
    assert codes(rules.architecture_graph(document(spark))) == ["architecture_graph.missing_mermaid"]
    assert codes(rules.architecture_graph(document(spark, body="```mermaid\nA\n```\n```mermaid\nB\n```"))) == ["architecture_graph.multiple_mermaid"]
    assert codes(rules.leaks(document(spark, body="T2023123456789-4 and 123作品"))) == ["identity.bare_suffix_name", "identity.platform_fork_leak"]
    assert codes(rules.leaks(document(spark, body="v123作品"))) == []
    locked = spark.createDataFrame([("w", "abc", "main")], "work_id string, locked_commit string, locked_ref string")
    assert codes(rules.base_lock(document(spark, commit_text="abd").withColumn("ref", F.lit("dev")), locked)) == ["base.target_commit_mismatch", "base.target_ref_mismatch"]
    assert codes(rules.document_presence(document(spark), ["report.md"])) == ["structure.missing_file"]


def test_digest_goes_stale_with_one_byte(spark):
    one, two = document(spark), document(spark, body="# U")
    first = report.material_digest(one).select("work_id", F.col("digest").alias("reviewed"), F.lit("resolved").alias("state"))
    assert codes(rules.contradictions(one, first)) == [] and codes(rules.contradictions(two, first)) == ["contradiction.review_stale"]
    assert report.material_digest(document(spark, path="report.md")).count() == 0


def test_optional_sections_both_ways(spark):
    findings = spark.createDataFrame([("w", "a", True), ("w", "b", False)], "work_id string, contract string, shown boolean")
    sections = spark.createDataFrame([("w", "b"), ("w", "c")], "work_id string, contract string")
    assert codes(rules.optional_sections(findings, sections)) == ["optional_section.hidden_leak", "optional_section.missing_public", "optional_section.without_source"]


def test_validation_result(spark):
    none = rules.structure_fields(document(spark), ["module"])
    assert rules.ok(none).first()["ok"] is True
    some = rules.structure_fields(document(spark, contract=""), ["module"])
    assert rules.ok(some).first()["ok"] is False and rules.formatted(some).first()["line"] == "[error] structure.missing_contract 1: "
