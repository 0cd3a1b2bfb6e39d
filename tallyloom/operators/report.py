"""Registry and report: normalised works, module summaries, digests, compiled rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import texts as T
from tallyloom.operators import case_rules, evidence
from tallyloom.operators.digests import ordered_digest

# What readers of compiled reports look for: the writer, and the end of the schema name (a fixed value).
REPORT_WRITER, REPORT_SCHEMA = "report_data_compiler", "report_data.v3"


def registry(works: DataFrame) -> DataFrame:
    """Works with defaults filled in and blanks trimmed; blank module ids left out."""
    clean = lambda c, default="": F.trim(F.coalesce(c, F.lit(default))).alias(c)
    modules = F.filter(F.transform(F.split(F.coalesce("module_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return works.select(
        clean("work_id"),
        F.coalesce("year", F.lit(0)).alias("year"),
        *[clean(c) for c in ("school", "team", "work_name", "display_name", "canonical_dir")],
        clean("review_branch", "main"),
        F.coalesce("repository_type", F.lit("competition")).alias("repository_type"),
        clean("reference_kind"),
        modules.alias("module_ids"),
        "ord",
    )


def lookup(works: DataFrame, ids: list[str]) -> DataFrame:
    """The first entry of each asked work."""
    own = works.where(F.col("work_id").isin(*ids))
    return own.groupBy("work_id").agg(F.min_by(F.struct(*[c for c in own.columns if c != "work_id"]), "ord").alias("w")).select("work_id", "w.*")


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, with the place of its first mention."""
    return rows.groupBy(key).agg(F.min(order).alias("place"))


def index_filter(works: DataFrame, text: str, *also: Column) -> DataFrame:
    """Works whose names hold a text, whatever its case."""
    kept = works.where(F.lower(F.concat_ws(" ", "work_id", "school", "team", "work_name", "display_name")).contains(text.lower()))
    for c in also:
        kept = kept.where(c)
    return kept


def bucket(status: Column, originality: Column) -> Column:
    """The summary bucket of a module."""
    known = originality.isin("novel", "inherited", "external", "uncertain")
    return F.when(status == "absent", F.lit("absent")).when(originality.startswith("adapted"), F.lit("adapted")).when(known, originality).otherwise(F.lit("uncertain"))


def risk_tags(docs: DataFrame) -> DataFrame:
    """Contracts of a work's public findings."""
    shown = (F.col("status") == "findings") & (F.lower("public") != "false")
    return docs.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(shown, F.col("contract")))), ",").alias("risk_tags"))


def site_index(docs: DataFrame) -> DataFrame:
    """One row for each work that has modules: its summary and public paths."""
    modules = docs.where(F.col("path").startswith("modules/"))
    counted = modules.groupBy("work_id", bucket(F.col("status"), F.col("originality")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: F.concat_ws("=", x["bucket"], x["n"].cast("string")))
    found = counted.groupBy("work_id").agg(F.array_join(listed, ",").alias("summary"))
    return found.select("work_id", "summary", F.lit("report.md").alias("markdown"), F.concat("work_id", F.lit("/site/report.html")).alias("html"))


def material_digest(docs: DataFrame) -> DataFrame:
    """SHA-256 over path, NUL, content hash and line feed of modules and findings, by path."""
    material = docs.where(F.col("path").startswith("modules/") | F.col("path").startswith("findings/"))
    return ordered_digest(material, "work_id", [F.col("path")], F.concat("path", F.lit("\0"), F.sha2("body", 256), F.lit("\n")))


def section_view(title: Column) -> Column:
    """The view that shows a report section."""
    return (
        F.when(title.isin(*case_rules.REPORT_BEFORE[:2]), "overview")
        .when(title.isin(*case_rules.REPORT_BEFORE[2:4]), "lineage")
        .when(title == case_rules.GRAPH_SECTION, "architecture")
        .when(title.isin(*case_rules.SECTION_OF.values()), "risk")
        .when(title == case_rules.MODULE_SECTION, "modules")
        .otherwise("evidence")
    )


def module_titles(docs: DataFrame, titles: dict[str, str]) -> DataFrame:
    """The taxonomy's title of each module, its id where it has none."""
    known = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    return docs.select("id", "module_id", F.coalesce(F.try_element_at(known, F.col("module_id")), F.col("module_id")).alias("title"))


def sections(body: Column) -> Column:
    """The second-level sections of a text: (id, title, markdown, evidence_ids), each with its heading and all below it."""
    at = F.struct(T.lines(body).alias("lines"), F.filter(T.headings(body), lambda h: h["level"] == 2).alias("heads"))

    def cut(x: Column) -> Column:
        ends = F.concat(F.transform(F.slice(x["heads"], 2, F.greatest(F.size(x["heads"]), F.lit(1))), lambda h: h["line"]), F.array(F.size(x["lines"]) + 1))
        own = F.zip_with(x["heads"], F.slice(ends, 1, F.size(x["heads"])), lambda h, end: F.struct(F.trim(h["title"]).alias("title"), F.btrim(F.array_join(F.slice(x["lines"], h["line"], end - h["line"]), "\n"), F.lit(" \t\r\n\x0b\x0c")).alias("markdown")))
        return F.transform(own, lambda s: F.struct(T.slugify(s["title"]).alias("id"), s["title"].alias("title"), s["markdown"].alias("markdown"), F.array_sort(F.array_distinct(T.references(s["markdown"]))).alias("evidence_ids")))

    return F.transform(F.array(at), cut)[0]


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))


def _module_title(titles: dict[str, str]) -> Column:
    """A module's own title, else the taxonomy's, else its id."""
    known = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv]) if titles else F.create_map().cast("map<string,string>")
    own = F.nullif(_field("module_title"), F.lit(""))
    return F.coalesce(F.when(own != "None", own), F.try_element_at(known, _field("module_id")), _field("module_id"))


def _modules(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("path").rlike(r"^modules/[^/]+\.md$") & (F.col("problem") == ""))


def case_references(docs: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(case_id, evidence_id, document, section, label, view, anchor, place): where parsed cases cite their evidence.

    Two routes, told in one pass over the documents: a report's sections by their slug, and a module's headings, where
    what it cites outside any heading counts as the module's own. Of citations by one document,
    section and anchor the first place stands. Citations alone are shuffled, never texts.
    """
    report = docs.where("path = 'report.md' AND problem = ''").select("case_id", F.posexplode(sections(F.col("body"))).alias("place", "s"))
    in_report = report.select(
        "case_id", F.explode("s.evidence_ids").alias("evidence_id"), F.lit("report.md").alias("document"), F.col("s.title").alias("section"), F.col("s.title").alias("label"), section_view(F.col("s.title")).alias("view"), F.col("s.id").alias("anchor"), "place"
    )
    own = case_rules.headings(_modules(docs)).withColumns({"label": _module_title(titles), "anchor": F.concat(F.lit("module-"), T.slugify(_field("module_id")))})
    per_head = F.transform("heads", lambda h, i: F.struct(i.alias("place"), h["title"].alias("section"), F.array_distinct(T.references(h["body"])).alias("ids")))
    at = own.select("case_id", "path", "label", "anchor", per_head.alias("heads"), F.array_distinct(T.references(F.col("body"))).alias("all"))
    outside = F.array_except("all", F.flatten(F.transform("heads", lambda h: h["ids"])))
    every = F.concat("heads", F.array(F.struct(F.size("heads").alias("place"), F.col("label").alias("section"), outside.alias("ids"))))
    in_modules = at.select("case_id", "path", "label", "anchor", F.explode(every).alias("h")).select(
        "case_id", F.explode("h.ids").alias("evidence_id"), F.col("path").alias("document"), "h.section", "label", F.lit("modules").alias("view"), "anchor", "h.place"
    )
    every = in_report.unionByName(in_modules)
    first = F.min(F.struct("place", "label", "view")).alias("first")
    found = every.groupBy("case_id", "evidence_id", "document", "section", "anchor").agg(first)
    return found.select("case_id", "evidence_id", "document", "section", "first.label", "first.view", "anchor", "first.place")


def case_reports(files: DataFrame, docs: DataFrame, titles: dict[str, str], card_form: str) -> DataFrame:
    """(case_id, report, evidence): the report data of every case as JSON, and the public cards as JSON lines.

    A report holds its case's identity, base, report sections, modules with their texts, public evidence with the
    places that cite it, and which optional sections are shown. Cases without an identity have no
    report; of a log that holds an id twice the first line counts, and what no log holds is left out.
    """
    refs = case_references(docs, titles)
    order = F.struct((F.col("document") != "report.md").alias("o"), "document", "place", "section")
    named = F.struct("document", "section", "label", "view", "anchor")
    places = refs.groupBy("case_id", "evidence_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), named.alias("r")))).alias("rs"))
    places = places.select("case_id", "evidence_id", F.transform("rs", lambda x: x["r"]).alias("references"))
    lines = files.where("path = 'evidence.jsonl'").select("case_id", F.posexplode(T.lines(F.col("text"))).alias("n", "line")).where(F.trim("line") != "")
    cards = lines.select("case_id", "n", F.from_json("line", card_form, {"mode": "PERMISSIVE"}).alias("c")).where("c.evidence_id IS NOT NULL")
    cards = cards.join(places.withColumnRenamed("evidence_id", "__id"), (cards["case_id"] == places["case_id"]) & (F.col("c.evidence_id") == F.col("__id"))).drop(places["case_id"])
    cards = cards.groupBy("case_id", "__id").agg(F.min_by(F.struct("c", "references"), "n").alias("x")).select("case_id", "x.*")
    hidden = F.col("c.raw_ref").isNotNull() & F.col("c.kind").isin(*evidence.SUMMARIES)
    source = F.when(hidden, F.col("c.source").withField("path", F.lit(""))).otherwise(F.col("c.source"))
    card = F.struct("c.evidence_id", "c.kind", "c.title", source.alias("source"), "c.excerpt", "c.facts", "c.table", "references")
    number = F.substring("c.evidence_id", 2, 20).cast("long")
    proofs = cards.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("number"), card.alias("card")))).alias("es"))
    proofs = proofs.select("case_id", F.transform("es", lambda e: e["card"]).alias("evidence"))

    module = F.struct(
        "path", _field("module_id").alias("module_id"), _module_title(titles).alias("title"), *[_field(c).alias(c) for c in ("status", "originality", "base_delta")],
        T.code_anchors(F.col("body")).alias("anchors"), F.col("body").alias("markdown"), F.array_sort(F.array_distinct(T.references(F.col("body")))).alias("evidence_ids"),
    )
    modules = _modules(docs).groupBy("case_id").agg(F.array_sort(F.collect_list(module)).alias("modules"))
    modules = modules.select("case_id", F.transform("modules", lambda m: m.dropFields("path")).alias("modules"))
    identity = docs.where("path = 'identity.md' AND problem = ''").select("case_id", F.struct(*[_field(c).alias(c) for c in ("work_id", "display_name", "school", "team", "work_name")]).alias("identity"))
    base_names = {
        "status": "status", "display_name": "selected_base_display_name", "target_review_ref": "target_review_ref", "target_review_commit": "target_review_commit",
        "target_introduction_commit": "target_introduction_commit", "source_ref": "selected_base_ref", "source_commit": "selected_base_commit", "direction": "direction", "confidence": "confidence",
    }
    base = docs.where("path = 'base.md' AND problem = ''").select("case_id", F.struct(*[_field(c).alias(k) for k, c in base_names.items()]).alias("base"))
    top = docs.where("path = 'report.md' AND problem = ''").select("case_id", sections(F.col("body")).alias("sections"))
    shown = (_field("status") == "findings") & (F.lower(F.coalesce(F.try_element_at("fields", F.lit("public")), F.lit("true"))) != "false")
    findings = docs.where(F.col("path").isin(*case_rules.FINDING_OF)).where(shown).groupBy("case_id").agg(F.collect_set("path").alias("shown"))
    full = functools.reduce(lambda a, b: a.join(b, "case_id", "left"), [identity, base, top, modules, proofs, findings])
    kinds = {"doc_claim": "findings/doc-claims.md", "cheat": "findings/cheat.md", "ai": "findings/history-ai.md"}
    optional = F.struct(*[F.coalesce(F.array_contains("shown", p), F.lit(False)).alias(k) for k, p in kinds.items()])
    none = {"base": F.struct(*[F.lit("").alias(k) for k in base_names]), **{c: F.array().cast(full.schema[c].dataType) for c in ("sections", "modules", "evidence")}}
    filled = {c: F.coalesce(c, empty) for c, empty in none.items()}
    full = full.withColumns(filled)
    data = F.struct(F.lit(REPORT_WRITER).alias("generated_by"), F.lit(REPORT_SCHEMA).alias("schema"), "identity", "base", "sections", "modules", "evidence", optional.alias("optional_sections"))
    return full.select("case_id", F.to_json(data).alias("report"), F.concat(F.array_join(F.transform("evidence", lambda e: F.to_json(e)), "\n"), F.when(F.size("evidence") > 0, "\n").otherwise("")).alias("evidence"))


def node_owner(modules: DataFrame) -> DataFrame:
    """The module of each node."""
    return modules.select(F.explode("nodes").alias("node"), F.col("module_id").alias("owner"))


def compiled(docs: DataFrame, cards: DataFrame) -> DataFrame:
    """(work_id, report): JSON with a work's modules and the evidence that they cite."""
    refs = evidence.cited(docs).select("id", "evidence_id").distinct()
    shown = evidence.public(cards, refs).select("evidence_id", "kind", "title", "source_path")
    cites = refs.join(docs.select("id", "work_id"), "id").select("work_id", "evidence_id").distinct().join(shown, "evidence_id")
    listed = F.array_sort(F.collect_list(F.struct("evidence_id", "kind", "title", "source_path")))
    proofs = cites.groupBy("work_id").agg(listed.alias("evidence"))
    module = F.struct("path", "module_id", "status", "originality", F.array_sort(F.array_distinct(T.references(F.col("body")))).alias("evidence_ids"))
    modules = docs.where(F.col("path").startswith("modules/")).groupBy("work_id").agg(F.array_sort(F.collect_list(module)).alias("modules"))
    full = docs.select("work_id").distinct().join(modules, "work_id", "left").join(proofs, "work_id", "left")
    return full.select("work_id", F.to_json(F.struct(F.lit("report_data.v3").alias("schema"), "work_id", "modules", "evidence")).alias("report"))
