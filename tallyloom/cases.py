"""The library's calls for whole tasks, over DataFrames: what a user runs from a notebook or a job.

    compare_commits(left, right, left_include=["kernel"], units=(left_units, right_units))
    head_candidates(bag, units, ["w1"]), history_search(target, history, "w1")
    case_issues(files, manifests, reviews, taxonomy, CARDS), check_all(..., build=compile_case)
    validate(docs, cards, required=[...], allowed=[...], optional="...", taxonomy={...})

`case_issues` checks whole cases by the contracts they are written to; `validate` checks any Markdown
documents by headings, fields and a taxonomy given as arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import paths as P
from tallyloom.operators import bags, case_rules, report, rules, search
from tallyloom.operators.case_rules import case_issues
from tallyloom.operators.report import compiled as compile_report
from tallyloom.operators.report import site_index
from tallyloom.operators.search import head_candidates, history_search

__all__ = ["case_issues", "check_all", "compare_commits", "compile_report", "head_candidates", "history_search", "inventory", "residuals", "site_index", "snapshot_build", "validate", "validate_works"]


def validate_works(works: DataFrame, modules: list[str]) -> DataFrame:
    """Issues of a registry."""
    return rules.identity(report.registry(works), modules)


def inventory(tree: DataFrame) -> DataFrame:
    """Entries and suffixes of each work."""
    suffix = F.coalesce(F.nullif(F.lower(P.file_suffix(F.col("path"))), F.lit("")), F.lit("<none>"))
    return tree.groupBy("work_id", suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_build(tree: DataFrame, units: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Manifests of all works (or some), in one job; an unknown work is an error."""
    if only is not None:
        only = list(dict.fromkeys(only))
        tree = tree.where(F.col("work_id").isin(*only))
        known = {r["work_id"] for r in tree.select("work_id").distinct().collect()}  # no more than were asked for
        if strange := [w for w in only if w not in known]:
            raise ValueError(f"no such work: {', '.join(strange[:8])}")
    return search.snapshot_manifest(search.fingerprint_rows(tree), units.where("shape <> ''"))


def compare_commits(left: DataFrame, right: DataFrame, left_include=(), left_exclude=(), right_include=(), right_exclude=(), units: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row of a two-sided comparison within path scopes; shape columns where units are given."""
    own = left.where(P.in_scope(F.col("path"), list(left_include), list(left_exclude)))
    other = right.where(P.in_scope(F.col("path"), list(right_include), list(right_exclude)))
    found = search.comparison(own, other)
    for name, part, whole in (("left_containment", "shared", "left_total"), ("right_containment", "shared", "right_total")):
        found = found.withColumn(name, bags.ratio(F.col(part), F.col(whole)))
    if units is None:
        return found
    one = units[0].where(P.in_scope(F.col("path"), list(left_include), list(left_exclude)) & (F.col("shape") != ""))
    two = units[1].where(P.in_scope(F.col("path"), list(right_include), list(right_exclude)) & (F.col("shape") != ""))
    shapes = search.comparison(one.withColumn("blob", F.col("shape")), two.withColumn("blob", F.col("shape")))
    return found.crossJoin(shapes.select(*[F.col(c).alias(f"shape_{c}") for c in shapes.columns]))  # single rows


def residuals(left: DataFrame, right: DataFrame) -> DataFrame:
    """What each side holds beyond the other, by path and content."""
    one = bags.residual(left.select("path", "blob"), right).select(F.lit("left").alias("side"), "path", "blob")
    return one.union(bags.residual(right.select("path", "blob"), left).select(F.lit("right").alias("side"), "path", "blob"))


def check_all(files: DataFrame, manifests: DataFrame, reviews: DataFrame, taxonomy: dict[str, list[str]], card_form: str, build: Callable[[DataFrame], None]) -> DataFrame:
    """Issues of cases; without any, their reports are built and an error while building is the issue."""
    found = case_issues(files, manifests, reviews, taxonomy, card_form)
    if found.isEmpty():
        try:
            build(files)
        except Exception as error:  # whatever a build gives up with is what the caller wants to see
            return case_rules.check_failed("", error, found)
    return found


def validate(
    docs: DataFrame,
    cards: DataFrame,
    required: list[str],
    allowed: list[str],
    optional: str,
    taxonomy: dict[str, list[str]],
    contracts=("module", "finding", "report", "base"),
    path: str | None = None,
    works: DataFrame | None = None,
    manifest: DataFrame | None = None,
    reviewed: DataFrame | None = None,
    sections: tuple[DataFrame, DataFrame] | None = None,
    present: list[str] | None = None,
    graph: str | None = None,
) -> DataFrame:
    """Issues of a case's documents (or of one of them) and its evidence log.

    A family that needs more than these runs if that is given: `works` for report titles, `manifest`
    for base documents (which then have a `ref`), `reviewed` for contradictions, `sections`
    (findings, sections) for optional sections, `present` for documents that must be there, `graph`
    for the path of the architecture document. Reviews, sections and presence are of whole cases,
    so they don't go with `path`.
    """
    if path is not None:
        if reviewed is not None or sections is not None or present is not None:
            raise ValueError("reviews, sections and presence are of whole cases, not of one document")
        docs = docs.where(F.col("path") == path)
    found = [
        rules.structure_fields(docs, list(contracts)),
        rules.structure_headings(docs, required, allowed, optional),
        rules.taxonomy_use(docs, taxonomy),
        rules.base(docs.where(F.col("contract") == "base")),
        rules.leaks(docs),
        rules.evidence_rules(docs, cards),
    ]
    if works is not None:
        found.append(rules.report_title(docs, works))
    if manifest is not None:
        found.append(rules.base_lock(docs.where(F.col("contract") == "base"), manifest))
    if reviewed is not None:
        found.append(rules.contradictions(docs, reviewed))
    if sections is not None:
        found.append(rules.optional_sections(*sections))
    if present is not None:
        found.append(rules.document_presence(docs, present))
    if graph is not None:
        found.append(rules.architecture_graph(docs.where(F.col("path") == graph)))
    return rules.union(*found)
