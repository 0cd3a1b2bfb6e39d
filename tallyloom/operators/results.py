"""Result records: comparisons, candidate searches, inventories, tags and indexes as JSON rows.

Each function gives rows with a `text` column, the JSON (or Markdown) a case keeps; `sources.cases`
puts them into files. What a record lists is bounded by its operator (30 candidates, 30 examples) or
by one side of a comparison, whose occurrences it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import paths as P
from tallyloom.operators import bags, case_rules, search

#: The ends of the schema names that readers look for.
PAIR_SCHEMA, HEAD_SCHEMA, HISTORY_SCHEMA, MANIFEST_SCHEMA, BINDING_SCHEMA = "commit_pair.v2", "search_candidates.v3", "history_blob_candidates.v1", "case_manifest.v1", "fingerprint_binding.v1"
INVENTORY_SCHEMA = "repository_inventory.v1"
#: Version of the shape hash: a snapshot made by another version can't be used again.
SHAPE_VERSION = "v1"
EXAMPLES = 30


def _content(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """One row `c`: shared instances, totals, containments of either side, and the lesser of them."""
    shared = bags.side_counts(left, right, *keys).agg(F.coalesce(F.sum(F.least("ln", "rn")), F.lit(0)).alias("s"))
    both = shared.crossJoin(left.agg(F.count(F.lit(1)).alias("l"))).crossJoin(right.agg(F.count(F.lit(1)).alias("r")))  # single rows
    a, b = F.bround(bags.ratio(F.col("s"), F.col("l")), 6), F.bround(bags.ratio(F.col("s"), F.col("r")), 6)
    return both.select(
        F.struct(
            F.col("s").alias("shared_instances"),
            F.col("l").alias("target_total_instances"),
            F.col("r").alias("candidate_total_instances"),
            a.alias("target_containment"),
            b.alias("candidate_containment"),
            F.least(a, b).alias("balanced"),
        ).alias("c")
    )


def _listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """One row with all rows as an array of structs, in order."""
    key = F.struct(*order, F.struct(*rows.columns).alias("__row"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["__row"]).alias(name))


def _side(one: dict, scope: tuple, n: int | None = None) -> Column:
    return F.struct(*[F.lit(one.get(c, "")).alias(c) for c in ("work_id", "display_name", "ref", "commit")])


def _scope(include, exclude) -> Column:
    clean = lambda xs: F.array(*[F.lit(x) for x in sorted({c for c in (x.strip().replace("\\", "/").strip("/") for x in xs) if c})]).cast("array<string>")
    return F.struct(clean(include).alias("include_prefixes"), clean(exclude).alias("exclude_prefixes"))


def commit_pair(
    left: DataFrame,
    right: DataFrame,
    sides: tuple[dict, dict],
    scopes: tuple[tuple, tuple] = (((), ()), ((), ())),
    units: tuple[DataFrame, DataFrame] | None = None,
    occurrences: bool = True,
) -> DataFrame:
    """(text): the record of a comparison of (path, blob) rows within path scopes, with shapes where units are given.

    `sides` name work_id, display_name, ref and commit of either side.
    """
    inside = lambda df, s: df.where(P.in_scope(F.col("path"), list(s[0]), list(s[1])))
    own, other = inside(left, scopes[0]).select("path", "blob"), inside(right, scopes[1]).select("path", "blob")
    content, aligned = _content(own, other, "blob"), _content(own, other, "path", "blob")
    unique = bags.side_counts(own, other, "blob").agg(F.count(F.lit(1)).alias("shared_unique_blobs"))
    moved = bags.relocated(own, other, "blob", EXAMPLES)
    blob = content.withColumnRenamed("c", "content_instances").crossJoin(aligned.withColumnRenamed("c", "path_aligned_instances")).crossJoin(unique)  # single rows
    blob = blob.withColumn("relocated_instances", F.greatest(F.lit(0), F.col("content_instances.shared_instances") - F.col("path_aligned_instances.shared_instances")))
    blob = blob.crossJoin(_listed(moved.select("blob", "left_paths", "right_paths"), "relocated_examples", "blob"))
    if occurrences:
        same = bags.side_counts(own, other, "path", "blob").select("path", "blob", F.least("ln", "rn").alias("instances"))
        parts = {
            "shared_content_occurrences": (bags.shared_content(own, other), ("blob",)),
            "path_aligned_occurrences": (same, ("path", "blob")),
            "left_residual_occurrences": (bags.residual(own, other), ("blob", "path")),
            "right_residual_occurrences": (bags.residual(other, own), ("blob", "path")),
        }
        for name, (rows, order) in parts.items():
            blob = blob.crossJoin(_listed(rows, name, *order))
    record = blob.select(F.struct(*blob.columns).alias("blob_overlap"))
    if units is not None:
        one, two = (inside(u, s).where("shape <> ''") for u, s in zip(units, scopes, strict=True))
        shapes, placed = _content(one, two, "shape"), _content(one, two, "path", "shape")
        shown = search.shape_examples(one, two, EXAMPLES)
        unit = lambda c: F.struct(F.substring_index(c, ":", 1).alias("path"), F.substring_index(c, ":", -1).alias("symbol"))
        shown = shown.select("shape", unit("left_unit").alias("left"), unit("right_unit").alias("right"))
        ast = shapes.withColumnRenamed("c", "shape_instances").crossJoin(placed.withColumnRenamed("c", "path_aligned_shape_instances"))
        ast = ast.withColumn("renamed_or_relocated_instances", F.greatest(F.lit(0), F.col("shape_instances.shared_instances") - F.col("path_aligned_shape_instances.shared_instances")))
        ast = ast.crossJoin(_listed(shown, "examples", "shape"))
        record = record.crossJoin(ast.select(F.struct(*ast.columns).alias("ast_overlap")))
    filters = F.struct(_scope(*scopes[0]).alias("left"), _scope(*scopes[1]).alias("right"))
    full = F.struct(F.lit(PAIR_SCHEMA).alias("schema"), _side(sides[0], scopes[0]).alias("left"), _side(sides[1], scopes[1]).alias("right"), filters.alias("path_filters"), *record.columns)
    return record.select(F.to_json(full).alias("text"))


def head_result(found: DataFrame, target: dict) -> DataFrame:
    """(text): the record of a head search for one target (rows of `search.head_candidates`)."""
    own = found.where(F.col("target") == target["work_id"])
    balanced = lambda part, c: F.struct(F.struct(F.col(c).alias("balanced")).alias(part))
    rows = own.select("rank", F.col("candidate").alias("work_id"), "display_name", "commit", "score", balanced("content_instances", "blob_balanced").alias("blob_overlap"), balanced("shape_instances", "shape_balanced").alias("ast_overlap"))
    named = [F.lit(target.get(k, "")).alias(f"target_{k}") for k in ("work_id", "display_name", "commit")]
    return _listed(rows, "candidates", "rank").select(F.to_json(F.struct(F.lit(HEAD_SCHEMA).alias("schema"), *named, "candidates")).alias("text"))


def history_result(found: DataFrame, target: dict, prefixes: tuple[str, ...] = (), works: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """(text): the record of a history search (rows of `search.history_search`).

    With a normalised registry candidates have its entries; with the rows of `search.history_matches` the
    number of the target's occurrences that each holds. The occurrences themselves are `pages.history_pages`.
    """
    entries = {"year": F.lit(0), "repository_type": F.lit("competition"), "reference_kind": F.lit(""), "module_ids": F.array().cast("array<string>"), "review_branch": F.lit("")}
    if works is not None:
        found = found.join(works.select(F.col("work_id").alias("candidate"), *[F.col(c).alias(f"__{c}") for c in entries]), "candidate", "left")
        found = found.withColumns({f"__{c}": F.coalesce(f"__{c}", none) for c, none in entries.items()})
    if matches is not None:
        found = found.join(matches.groupBy("candidate").agg(F.sum("n").alias("__matched")), "candidate", "left").withColumn("__matched", F.coalesce("__matched", F.lit(0)))
    added = [F.col(f"__{c}").alias("review_ref" if c == "review_branch" else c) for c in entries] if works is not None else []
    added += [F.col("__matched").alias("matched_target_occurrences")] if matches is not None else []
    order = F.struct(-F.col("containment"), -F.col("shared_unique"), F.col("display_name"))
    rows = found.select(
        order.alias("o"),
        F.col("candidate").alias("work_id"),
        "display_name",
        F.col("shared_unique").alias("shared_unique_blobs"),
        F.col("shared").alias("target_shared_instances"),
        F.col("target_total").alias("target_total_instances"),
        F.col("containment").alias("target_history_containment"),
        *added,
    )
    listed = _listed(rows, "candidates", "o").select(F.transform("candidates", lambda x: x.dropFields("o")).alias("candidates"))
    counts = [F.lit(target[k]).alias(k) for k in ("source_file_count", "structural_unit_count") if k in target]
    named = F.struct(*[F.lit(target.get(k, "")).alias(k) for k in ("work_id", "display_name", "commit")], *counts).alias("target")
    kept = F.array(*[F.lit(p) for p in prefixes]).cast("array<string>").alias("target_prefixes")
    return listed.select(F.to_json(F.struct(F.lit(HISTORY_SCHEMA).alias("schema"), named, kept, "candidates")).alias("text"))


def inventory_records(tree: DataFrame) -> DataFrame:
    """(work_id, text, markdown): number of files, suffixes by name and top-level directories of each snapshot."""
    suffix = F.coalesce(F.nullif(F.lower(P.file_suffix(F.col("path"))), F.lit("")), F.lit("<none>"))
    by_suffix = tree.groupBy("work_id", suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.array_sort(F.collect_list(F.struct("suffix", "n")))
    counted = by_suffix.groupBy("work_id").agg(F.sum("n").alias("file_count"), F.map_from_entries(entry).alias("suffixes"))
    top = F.split("path", "/")
    dirs = tree.where((F.size(top) > 1) & ~F.startswith(F.col("path"), F.lit("."))).groupBy("work_id").agg(F.array_sort(F.collect_set(top[0])).alias("top_level_dirs"))
    full = counted.join(dirs, "work_id", "left").withColumn("top_level_dirs", F.coalesce("top_level_dirs", F.array().cast("array<string>")))
    lines = F.transform(F.map_entries("suffixes"), lambda e: F.concat(F.lit("- `"), e["key"], F.lit("`: "), e["value"].cast("string")))
    folders = F.transform("top_level_dirs", lambda d: F.concat(F.lit("- `"), d, F.lit("/`")))
    markdown = F.concat(F.lit("# Inventory\n\nFiles: "), F.col("file_count").cast("string"), F.lit("\n\n## Suffixes\n\n"), F.array_join(lines, "\n"), F.lit("\n\n## Directories\n\n"), F.array_join(folders, "\n"), F.lit("\n"))
    return full.select("work_id", F.to_json(F.struct("work_id", "file_count", "suffixes", "top_level_dirs")).alias("text"), markdown.alias("markdown"))


def inventory_heads(tree: DataFrame, commits: DataFrame) -> DataFrame:
    """(work_id, text, markdown): schema, commit, number of paths and suffixes of each snapshot (commits: work_id, commit).

    The paths themselves, which no row may have to hold, are `pages.inventory_pages`.
    """
    suffix = F.coalesce(F.nullif(F.lower(P.file_suffix(F.col("path"))), F.lit("")), F.lit("<none>"))
    by_suffix = tree.groupBy("work_id", suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n"))
    counted = by_suffix.groupBy("work_id").agg(F.sum("n").alias("path_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "n")))).alias("suffix_counts"))
    at = counted.join(commits.select("work_id", "commit"), "work_id", "left").withColumn("commit", F.coalesce("commit", F.lit("")))
    markdown = F.concat(F.lit("# Repository Inventory\n\nCommit: `"), F.col("commit"), F.lit("`\n\nPaths: "), F.col("path_count").cast("string"), F.lit("\n"))
    return at.select("work_id", F.to_json(F.struct(F.lit(INVENTORY_SCHEMA).alias("schema"), "commit", "path_count", "suffix_counts")).alias("text"), markdown.alias("markdown"))


def case_manifests(works: DataFrame, states: DataFrame) -> DataFrame:
    """(case_id, text): the record a case begins with, of works and their repositories (work_id, path, current_branch, commit, tree)."""
    at = works.join(states, "work_id")
    work = F.struct(*[F.col(c) for c in ("work_id", "year", "school", "team", "work_name", "display_name", "canonical_dir", "repository_type", "reference_kind", "module_ids")])
    repo = F.struct("path", "review_branch", "current_branch", "commit", "tree")
    return at.select(F.col("work_id").alias("case_id"), F.to_json(F.struct(F.lit(MANIFEST_SCHEMA).alias("schema"), work.alias("work"), repo.alias("repo"))).alias("text"))


def fingerprint_bindings(manifests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(case_id, text): which cached snapshot (work_id, commit, path, shape_version, components) each case rests on, and the work it is of."""
    work = "work_id:string,display_name:string,year:int,repository_type:string,reference_kind:string,module_ids:array<string>"
    at = manifests.select("case_id", F.from_json("text", f"work struct<{work}>, repo struct<commit:string,review_branch:string>").alias("m"))
    of = {"work_id": F.lit(""), "display_name": F.lit(""), "year": F.lit(0), "repository_type": F.lit("competition"), "reference_kind": F.lit(""), "module_ids": F.array().cast("array<string>")}
    named = [F.coalesce(F.col(f"m.work.{c}"), none).alias(c) for c, none in of.items()]
    own = at.select("case_id", *named, F.coalesce("m.repo.review_branch", F.lit("")).alias("review_ref"), F.col("m.repo.commit").alias("commit")).join(snapshots, ["work_id", "commit"])
    files = [F.col("path").alias("cache_dir"), F.concat("path", F.lit("/blob")).alias("blob"), F.concat("path", F.lit("/ast")).alias("structural")]
    return own.select("case_id", F.to_json(F.struct(F.lit(BINDING_SCHEMA).alias("schema"), *of, "review_ref", "commit", "path", *files, "shape_version")).alias("text"))


def reusable(snapshots: DataFrame, wanted: DataFrame, version: str = SHAPE_VERSION, components: tuple[str, ...] = ("blob", "ast")) -> DataFrame:
    """Wanted (work_id, commit) pairs that a cached snapshot covers: same commit, all components, same shape version if shapes are among them."""
    whole = [F.array_contains("components", c) for c in components]
    fits = F.lit(True)
    for w in whole:
        fits = fits & F.coalesce(w, F.lit(False))
    if "ast" in components:
        fits = fits & F.coalesce(F.col("shape_version") == version, F.lit(False))
    return wanted.join(snapshots.where(fits).select("work_id", "commit"), ["work_id", "commit"], "left_semi")


SUMMARY = ("novel", "adapted", "inherited", "external", "uncertain", "absent")


def tags(docs: DataFrame) -> DataFrame:
    """(case_id, text): identity, base, risk tags and module summary of each case, from its parsed documents."""
    field = lambda c: F.coalesce(F.try_element_at("fields", F.lit(c)), F.lit(""))
    identity = docs.where("path = 'identity.md'").select("case_id", *[field(c).alias(c) for c in ("work_id", "display_name", "school", "team", "work_name")])
    names = {"display_name": "selected_base_display_name", "ref": "selected_base_ref", "commit": "selected_base_commit", "relation": "direction", "confidence": "confidence", "status": "status"}
    base = docs.where("path = 'base.md'").select("case_id", F.struct(*[field(c).alias(k) for k, c in names.items()]).alias("base"))
    none = F.struct(*[F.lit("").alias(k) for k in names])
    bucket = F.when(field("status") == "absent", "absent").when(field("originality").startswith("adapted"), "adapted").when(field("originality").isin(*SUMMARY[:-1]), field("originality")).otherwise("uncertain")
    modules = docs.where(F.col("path").rlike(r"^modules/[^/]+\.md$")).groupBy("case_id").agg(F.struct(*[F.count_if(bucket == b).alias(b) for b in SUMMARY]).alias("module_summary"))
    public = (field("status") == "findings") & (F.lower(F.coalesce(F.try_element_at("fields", F.lit("public")), F.lit("true"))) != "false")
    shown = docs.where(F.col("path").isin(*case_rules.FINDING_OF)).where(public).groupBy("case_id").agg(F.collect_set("path").alias("paths"))
    zero = F.struct(*[F.lit(0).cast("long").alias(b) for b in SUMMARY])
    full = identity.join(base, "case_id", "left").join(modules, "case_id", "left").join(shown, "case_id", "left")
    risks = F.array_compact(F.array(*[F.when(F.array_contains("paths", p), F.lit(t)) for p, t in case_rules.FINDING_OF.items()]))
    risks = F.coalesce(risks, F.array().cast("array<string>"))
    public_paths = F.struct(F.lit("report.md").alias("markdown"), F.lit("site/report.html").alias("html"))
    row = F.struct(
        "work_id", "display_name", "school", "team", "work_name", F.coalesce("base", none).alias("base"), risks.alias("risk_tags"), F.coalesce("module_summary", zero).alias("module_summary"), public_paths.alias("public_paths")
    )
    return full.select("case_id", F.to_json(row).alias("text"))


TAGS = (
    "work_id string, display_name string, school string, team string, work_name string, base struct<display_name:string,ref:string,commit:string,relation:string,confidence:string,status:string>, risk_tags array<string>, "
    "module_summary struct<novel:bigint,adapted:bigint,inherited:bigint,external:bigint,uncertain:bigint,absent:bigint>, public_paths struct<markdown:string,html:string>"
)


def index(tag_rows: DataFrame) -> DataFrame:
    """(text): one row for each case that has tags, with the paths of its published report."""
    at = tag_rows.select("case_id", F.from_json("text", TAGS).alias("t")).select("case_id", "t.*")
    work = F.coalesce(F.nullif("work_id", F.lit("")), F.col("case_id"))
    part = lambda name: F.concat(F.lit("reports/"), work, F.lit(f"/{name}"))
    paths = F.struct(part("report.html").alias("html"), part("report_data.json").alias("data"), part("report.md").alias("markdown"))
    return at.withColumn("public_paths", paths).select(F.to_json(F.struct(*[c for c in at.columns if c != "case_id"])).alias("text"))


def index_counts(tag_rows: DataFrame) -> DataFrame:
    """Works in an index, and those with a risk."""
    at = tag_rows.select(F.from_json("text", TAGS).alias("t"))
    return at.agg(F.count(F.lit(1)).alias("works"), F.count_if(F.size("t.risk_tags") > 0).alias("with_risk"))
