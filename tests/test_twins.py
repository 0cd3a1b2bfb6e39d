"""Queries that SQL can't express against plain Python, over whole tables."""

import hashlib
import json
import os
import re
from collections import Counter
from html.parser import HTMLParser

import pytest
import yaml

from tallyloom.plans import registry
from tallyloom.sources.adapters import relation

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in relation(spark, TABLES, "documents_md").collect()]


def got(spark, name):
    return registry.QUERIES[name](spark, TABLES).collect()


PATH = r"(?<![\w.-])(?:[\w.-]+/)+(?:[\w.-]+)(?:\.[A-Za-z0-9_+-]+)?"
CALLS = r"\b(?:sys_[A-Za-z0-9_]+|SYS_[A-Za-z0-9_]+)\b"
SETTINGS = r"\b(?:CONFIG_[A-Za-z0-9_]+|[A-Za-z0-9_-]+=(?:y|n|[A-Za-z0-9_./-]+))\b"
ENDS = (".rs", ".c", ".h", ".S", ".cpp", ".toml", ".ld", ".mk")


def anchors(body):
    found = []
    for token in re.findall(r"`([^`]+)`", body):
        token = token.strip()
        if "/" in token or token.endswith(ENDS) or re.match(r"sys_|SYS_|CONFIG_", token) or re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*\(\)?|[A-Z][A-Za-z0-9_]{2,}", token):
            found.append(token)
    for pattern in (PATH, CALLS, SETTINGS):
        found += re.findall(pattern, body)
    return list(dict.fromkeys(found))


def headings(body):
    return [(len(m[1]), m[2]) for line in body.splitlines() if (m := re.match(r"^(#{1,6})\s+(.+?)\s*$", line))]


def test_anchors(spark, docs):
    want = {d["id"]: "|".join(anchors(d["body"])) for d in docs}
    assert {r["id"]: r["anchors"] for r in got(spark, "code_anchors")} == want and any(want.values())


def test_front_matter(spark, docs):
    for r in got(spark, "frontmatter"):
        own = next(d for d in docs if d["id"] == r["id"])
        text = f"contract: {own['contract']}\nstatus: {own['status']}"
        front = yaml.safe_load(text)
        assert (r["keys"], r["contract"], r["status"]) == (",".join(sorted(front)), front["contract"] or "", front["status"] or "")


def test_scan(spark, docs):
    found = {r["id"]: r for r in got(spark, "markdown_scan")}
    assert len(found) == len(docs)
    for d in docs:
        r = found[d["id"]]
        assert r["headings"] == "|".join(t for _, t in headings(d["body"]))
        assert r["refs"] == ",".join(re.findall(r"\[@(E\d{3,})\]", d["body"])) and r["anchors"] == "|".join(anchors(d["body"]))


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Tree(HTMLParser):
    """A nested list of (name, children), built from events; then hashed by recursion."""

    def __init__(self):
        super().__init__()
        self.root = ("#document", [])
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.path[-1][1].append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1][1].append((tag, []))

    def handle_endtag(self, tag):
        if tag not in VOID and tag in [n for n, _ in self.path[1:]]:
            while self.path.pop()[0] != tag:
                pass


def shape(node):
    name, children = node
    inner = ",".join(shape(c) for c in children)
    return hashlib.sha256((name + ("|" + inner if children or name == "#document" else "")).encode()).hexdigest()


def size(node):
    return 1 + sum(map(size, node[1]))


def test_page_shapes(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()}
    found = {r["page_id"]: (r["shape"], r["nodes"]) for r in got(spark, "dom_shape")}
    assert set(found) == set(pages)
    for k, html in pages.items():
        tree = Tree()
        tree.feed(html or "")
        tree.close()
        assert found[k] == (shape(tree.root), size(tree.root) - 1)


def test_text_units(spark):
    sources = {r["id"]: r["text"] for r in relation(spark, TABLES, "sources").collect()}
    want = Counter()
    for k, text in sources.items():
        block, symbol = 0, "(file)"
        for line in re.sub(r"(?s)/\*.*?\*/", " ", text).split("\n"):
            line = re.split(r"#|//|;", line)[0].strip(" ")
            if not line:
                continue
            if label := re.match(r"^([A-Za-z_.$][\w.$]*):$", line):
                block, symbol = block + 1, label[1]
            want[k, block, symbol] += 1
    found = got(spark, "unit_extract")
    assert {(r["id"], r["block"], r["symbol"]) for r in found} == set(want)


def test_compiled_reports(spark, docs):
    cards = [r.asDict() for r in relation(spark, TABLES, "cards").collect()]
    first = {}
    for c in sorted(cards, key=lambda c: c["n"]):
        first.setdefault(c["evidence_id"], c)
    found = {r["work_id"]: json.loads(r["report"]) for r in got(spark, "compile_report")}
    assert set(found) == {d["work_id"] for d in docs}
    for work, report in found.items():
        own = [d for d in docs if d["work_id"] == work]
        refs = {e for d in own for e in re.findall(r"\[@(E\d{3,})\]", d["body"])}
        assert [e["evidence_id"] for e in report.get("evidence", [])] == sorted(refs & set(first))
        for e in report.get("evidence", []):
            c = first[e["evidence_id"]]
            hidden = c["kind"] in ("fingerprint_comparison", "search_result") and c["raw_sha"]
            assert (e["kind"], e["title"], e["source_path"]) == (c["kind"], c["title"], "" if hidden else c["source_path"])
        modules = sorted((d["path"], d["module_id"], d["status"], d["originality"], sorted(set(re.findall(r"\[@(E\d{3,})\]", d["body"])))) for d in own if d["path"].startswith("modules/"))
        assert [(m["path"], m["module_id"], m["status"], m["originality"], m["evidence_ids"]) for m in report.get("modules", [])] == modules
