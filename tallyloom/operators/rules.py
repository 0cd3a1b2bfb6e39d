"""Contract rules: each is a query that yields issues (subject, code, detail); a family is their union.

A rule is a projection and a filter over one relation where it can be, so Catalyst folds a family
into few passes; required things that are missing are anti joins against what is there.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import texts as T
from tallyloom.operators import evidence, markdown, report

#: Vocabularies that fields must come from.
REPOSITORY_TYPES = ("competition", "reference")
REFERENCE_KINDS = ("kernel", "framework", "component")
MODULE_STATUS = ("implemented", "partial", "minimal", "absent")
ORIGINALITY = ("novel", "adapted_major", "adapted_minor", "inherited", "external", "uncertain")
IDENTITY_FIELDS = ("work_id", "school", "work_name", "display_name", "canonical_dir")


def issues(rows: DataFrame, subject: str, *rules: tuple[str, Column, Column]) -> DataFrame:
    """One issue for each (code, test, detail) whose test holds, from a single pass over the rows."""
    each = F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))) for code, test, detail in rules])
    return rows.select(F.col(subject).cast("string").alias("subject"), F.explode(F.array_compact(each)).alias("i")).select("subject", "i.code", "i.detail")


def union(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def identity(works: DataFrame, modules: list[str]) -> DataFrame:
    """Fields, types and reference metadata of registered works."""
    kind, is_reference = F.col("reference_kind"), F.col("repository_type") == "reference"
    has_modules, component = F.size("module_ids") > 0, F.col("reference_kind") == "component"
    missing = [("identity.missing_field", F.col(c) == "", F.lit(c)) for c in IDENTITY_FIELDS]
    own = issues(
        works,
        "ord",
        *missing,
        ("identity.repository_type", ~F.col("repository_type").isin(*REPOSITORY_TYPES), F.col("repository_type")),
        ("identity.reference_metadata", (F.col("repository_type") == "competition") & ((kind != "") | has_modules), F.lit("")),
        ("identity.reference_kind", is_reference & ~kind.isin(*REFERENCE_KINDS), kind),
        ("identity.reference_modules", is_reference & kind.isin(*REFERENCE_KINDS) & (component != has_modules), kind),
    )
    named = works.where(is_reference).select("ord", F.explode("module_ids").alias("module"))
    return own.unionByName(issues(named, "ord", ("identity.reference_module", ~F.col("module").isin(*modules), F.col("module"))))


def structure_fields(docs: DataFrame, contracts: list[str]) -> DataFrame:
    """Front matter: contract, vocabularies and the public flag."""
    module, finding = F.col("contract") == "module", F.col("contract") == "finding"
    public = F.lower("public")
    return issues(
        docs,
        "id",
        ("structure.missing_contract", F.col("contract") == "", F.lit("")),
        ("structure.unknown_contract", (F.col("contract") != "") & ~F.col("contract").isin(*contracts), F.col("contract")),
        ("structure.invalid_enum", module & ~F.col("status").isin(*MODULE_STATUS), F.concat(F.lit("status="), F.col("status"))),
        ("structure.invalid_enum", module & ~F.col("originality").isin(*ORIGINALITY), F.concat(F.lit("originality="), F.col("originality"))),
        ("structure.invalid_public", finding & (~public.isin("true", "false") | ((public == "true") != (F.col("status") == "findings"))), F.col("public")),
        ("structure.module_path_mismatch", module & ~F.col("path").startswith("modules/"), F.col("path")),
        ("structure.finding_path_mismatch", finding & ~F.col("path").startswith("findings/"), F.col("path")),
    )


def structure_headings(docs: DataFrame, required: list[str], allowed_h2: list[str], optional: str, deepest: int = 3) -> DataFrame:
    """Headings: one at the top, required ones there, filled and in order, no others, none too deep."""
    heads = markdown.heading_rows(docs).drop("lines")
    first = heads.groupBy("id").agg(F.count_if(F.col("level") == 1).alias("n"))
    first = docs.select("id").join(first, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wanted = docs.select("id", F.explode(F.array(*[F.lit(r) for r in required])).alias("title"))
    absent = wanted.join(heads.select("id", "title"), ["id", "title"], "left_anti")
    content = markdown.section_content(docs).where(F.col("title").isin(*required)).groupBy("id", "title").agg(F.min_by("has_content", "line").alias("filled"))
    other = heads.where((F.col("level") == 2) & ~F.col("title").isin(*allowed_h2))
    return union(
        issues(first, "id", ("structure.h1", F.col("n") != 1, F.col("n"))),
        issues(absent, "id", ("structure.missing_heading", F.lit(True), F.col("title"))),
        issues(content, "id", ("structure.empty_heading", ~F.col("filled"), F.col("title"))),
        issues(markdown.heading_order(docs, required), "id", ("structure.heading_order", ~F.col("in_order"), F.lit(""))),
        issues(other, "id", ("structure.unknown_h2", F.lit(True), F.col("title"))),
        issues(markdown.optional_last(docs, optional), "id", ("structure.optional_heading_order", ~F.col("is_last"), F.lit(optional))),
        issues(heads, "id", ("structure.heading_depth", F.col("level") > deepest, F.col("title"))),
    )


def taxonomy_use(docs: DataFrame, nodes: dict[str, list[str]]) -> DataFrame:
    """Modules and node headings that documents name."""
    modules = docs.where(F.col("contract") == "module")
    owner = {n: m for m, own in nodes.items() for n in own}
    known = F.create_map(*[F.lit(x) for kv in owner.items() for x in kv])
    named = markdown.node_headings(modules, list(owner)).join(modules.select("id", "module_id"), "id")
    stranger = F.coalesce(F.try_element_at(known, F.col("node")), F.lit("")) != F.col("module_id")
    return union(
        issues(modules, "id", ("taxonomy.unknown_module", ~F.col("module_id").isin(*nodes), F.col("module_id"))),
        issues(named, "id", ("taxonomy.unknown_node", stranger, F.col("node"))),
    )


def taxonomy_itself(nodes: DataFrame, roles: list[str], required: list[str], deleted: list[str]) -> DataFrame:
    """The taxonomy's own rules over (module_id, role, node_id, title, requirement) rows."""
    by_module = nodes.groupBy("module_id").agg(F.min("role").alias("role"), F.count("node_id").alias("n"))
    by_node = nodes.where("node_id is not null").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    form = T.label_form(F.concat_ws(" ", "node_id", "title"))
    wanted = nodes.sparkSession.createDataFrame([(r,) for r in required], "node_id string")
    return union(
        issues(by_module, "module_id", ("taxonomy.invalid_architecture_role", ~F.col("role").isin(*roles), F.col("role")), ("taxonomy.empty_module", F.col("n") == 0, F.lit(""))),
        issues(by_node, "node_id", ("taxonomy.duplicate_node", F.col("n") > 1, F.col("n"))),
        issues(nodes.where("node_id is not null"), "node_id", ("taxonomy.incomplete_node", (F.trim("title") == "") | (F.trim("requirement") == ""), F.lit("")), *[("taxonomy.deleted_present", form.contains(x), F.lit(x)) for x in deleted]),
        issues(wanted.join(nodes, "node_id", "left_anti"), "node_id", ("taxonomy.required_missing", F.lit(True), F.lit(""))),
    )


def base(docs: DataFrame) -> DataFrame:
    """Commits, the way of introduction and empty fields of base documents."""
    accepted, form = F.col("status").isin("implemented", "partial"), F.col("commit_text").rlike(T.COMMIT)
    return issues(
        docs,
        "id",
        ("base.commit_missing", accepted & ~form, F.col("commit_text")),
        ("base.introduction_kind", accepted & ~F.col("originality").isin("novel", "inherited"), F.col("originality")),
        ("base.unexpected_value", (F.col("status") == "absent") & (F.col("commit_text") != ""), F.col("commit_text")),
    )


def base_lock(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents against the manifest of their work: it must be there and name the same ref and commit."""
    both = docs.join(manifest, "work_id", "left")
    there = F.col("locked_commit").isNotNull()
    return issues(
        both,
        "id",
        ("base.manifest_missing", ~there, F.col("work_id")),
        ("base.target_ref_mismatch", there & (F.col("ref") != F.col("locked_ref")), F.col("ref")),
        ("base.target_commit_mismatch", there & (F.col("commit_text") != F.col("locked_commit")), F.col("commit_text")),
    )


def evidence_rules(docs: DataFrame, cards: DataFrame) -> DataFrame:
    """Bad cards, repeated ids, and citations of cards that the log lacks."""
    bad = evidence.validated(cards)
    unknown = evidence.cited(docs).join(cards.select("evidence_id"), "evidence_id", "left_anti")
    return union(
        issues(bad, "n", ("evidence.invalid", F.col("problem") != "", F.col("problem"))),
        issues(evidence.duplicates(cards, "evidence_id"), "evidence_id", ("evidence.invalid", F.lit(True), F.lit("duplicate"))),
        issues(unknown, "id", ("evidence.unknown_ref", F.lit(True), F.col("evidence_id"))),
    )


def contradictions(docs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Reviews of a work's material: missing, unresolved, or of material that has changed since."""
    now = report.material_digest(docs)
    both = now.join(reviewed, "work_id", "left")
    there = F.col("reviewed").isNotNull()
    return issues(
        both,
        "work_id",
        ("contradiction.review_missing", ~there, F.lit("")),
        ("contradiction.unresolved", there & (F.col("state") == "unresolved"), F.col("state")),
        ("contradiction.review_stale", there & (F.col("reviewed") != F.col("digest")), F.lit("")),
    )


def optional_sections(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """Public findings and report sections must go together, both ways; hidden findings mustn't show."""
    a = findings.select("work_id", "contract", F.col("shown"))
    b = sections.select("work_id", "contract", F.lit(True).alias("section"))
    both = a.join(b, ["work_id", "contract"], "full")
    section = F.coalesce("section", F.lit(False))
    return issues(
        both,
        "work_id",
        ("optional_section.without_source", section & F.col("shown").isNull(), F.col("contract")),
        ("optional_section.missing_public", F.coalesce("shown", F.lit(False)) & ~section, F.col("contract")),
        ("optional_section.hidden_leak", section & ~F.coalesce("shown", F.lit(True)), F.col("contract")),
    )


def architecture_graph(docs: DataFrame) -> DataFrame:
    """Exactly one non-empty diagram."""
    n = F.size(T.mermaid_blocks(F.col("body")))
    return issues(docs, "id", ("architecture_graph.missing_mermaid", n == 0, F.lit("")), ("architecture_graph.multiple_mermaid", n > 1, n))


def leaks(docs: DataFrame) -> DataFrame:
    """Platform ids and bare numbers as names, in any document but the identity itself."""
    body = F.col("body")
    return issues(docs.where(F.col("path") != "identity.md"), "id", ("identity.platform_fork_leak", body.rlike(T.FORK_ID), F.lit("")), ("identity.bare_suffix_name", body.rlike(T.BARE_SUFFIX), F.lit("")))


def report_title(docs: DataFrame, works: DataFrame) -> DataFrame:
    """The top heading of a report must hold its work's display name."""
    title = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)
    both = docs.where(F.col("contract") == "report").join(works.select("work_id", "display_name"), "work_id")
    return issues(both, "id", ("identity.report_title", ~F.contains(title, F.col("display_name")), title))


def document_presence(docs: DataFrame, required: list[str]) -> DataFrame:
    """Required documents and at least one module in every case."""
    cases = docs.select("work_id").distinct()
    wanted = cases.withColumn("path", F.explode(F.array(*[F.lit(r) for r in required])))
    absent = wanted.join(docs.select("work_id", "path"), ["work_id", "path"], "left_anti")
    without = cases.join(docs.where(F.col("path").startswith("modules/")).select("work_id"), "work_id", "left_anti")
    return union(
        issues(absent, "work_id", ("structure.missing_file", F.lit(True), F.col("path"))),
        issues(without, "work_id", ("structure.missing_modules", F.lit(True), F.lit(""))),
    )


def ok(found: DataFrame, severity: Column | None = None) -> DataFrame:
    """Whether a report holds no error."""
    level = F.lit("error") if severity is None else severity
    return found.agg(F.coalesce(F.bool_and(level != "error"), F.lit(True)).alias("ok"), F.count(F.lit(1)).alias("issues"))


def formatted(found: DataFrame) -> DataFrame:
    """Issues as lines of text."""
    return found.select(F.format_string("[error] %s %s: %s", "code", "subject", F.coalesce("detail", F.lit(""))).alias("line"))
