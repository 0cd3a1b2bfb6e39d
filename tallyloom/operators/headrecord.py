"""The record of a head search: what each candidate shares with its target, and where in the target it lies.

All figures of all candidates of all targets come from one join for each of them. How the target's directories share out what
a candidate has of each shape is greedy in the target's order; the place of a unit among those of its shape is
the same for every candidate, so it is counted once (`running_sum`) and compared with each candidate's capacity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import paths as P
from tallyloom.operators import bags, results
from tallyloom.operators.cuts import durable
from tallyloom.operators.running import running_sum


def pair_sums(pairs: DataFrame, bag: DataFrame, *keys: str) -> DataFrame:
    """(target, candidate, shared, shared_unique) of the given pairs; those that share nothing have no row."""
    counted = bags.counts(bag, *keys)
    own = counted.select(F.col("work_id").alias("target"), *keys, F.col("n").alias("ln"))
    other = counted.select(F.col("work_id").alias("candidate"), *keys, F.col("n").alias("rn"))
    both = pairs.select("target", "candidate").join(own, "target").join(other, ["candidate", *keys])
    return both.groupBy("target", "candidate").agg(F.sum(F.least("ln", "rn")).alias("shared"), F.count(F.lit(1)).alias("shared_unique"))


def directories(pairs: DataFrame, units: DataFrame, order: list[str]) -> DataFrame:
    """(target, candidate, directory, shared_instances, target_instances): every directory of each pair's target.

    A candidate's units of a shape are used up by the target's in order, whatever directory they lie in. Only units
    of shapes that a target has are dealt, and they meet the target's by shape: pairs are never multiplied with its units.
    """
    targets = durable(pairs.select(F.col("target").alias("work_id")).distinct(), "targets")
    own = units.join(targets, "work_id", "left_semi")
    own = own.select(F.col("work_id").alias("target"), "shape", P.parent_dir(F.col("path")).alias("directory"), *[F.col(c).alias(f"__{c}") for c in order])
    own = own.withColumns({"group": F.concat_ws("\0", "target", "shape"), "one": F.lit(1)})
    placed = running_sum(own, "group", [F.col(f"__{c}") for c in order], "one", "before").select("target", "shape", "directory", "before")
    wanted = durable(placed.select("shape").distinct(), "shapes")
    held = bags.counts(units.join(wanted, "shape", "left_semi"), "shape").select(F.col("work_id").alias("candidate"), "shape", F.col("n").alias("capacity"))
    held = held.join(pairs.select("candidate").distinct(), "candidate", "left_semi")
    hits = placed.join(held, "shape").where("before < capacity")  # those of other pairs go where the pairs are joined
    shared = hits.groupBy("target", "candidate", "directory").agg(F.count(F.lit(1)).alias("shared_instances"))
    total = placed.groupBy("target", "directory").agg(F.count(F.lit(1)).alias("target_instances"))
    full = pairs.select("target", "candidate").join(total, "target").join(shared, ["target", "candidate", "directory"], "left")
    return full.select("target", "candidate", "directory", F.coalesce("shared_instances", F.lit(0)).alias("shared_instances"), "target_instances")


def _counts(shared: str, total: str) -> Column:
    a, b = F.bround(bags.ratio(F.col(shared), F.col(f"target_{total}")), 6), F.bround(bags.ratio(F.col(shared), F.col(f"candidate_{total}")), 6)
    return F.struct(
        F.col(shared).alias("shared_instances"), F.col(f"target_{total}").alias("target_total_instances"), F.col(f"candidate_{total}").alias("candidate_total_instances"),
        a.alias("target_containment"), b.alias("candidate_containment"), F.least(a, b).alias("balanced"),
    )


def candidate_figures(found: DataFrame, bag: DataFrame, units: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a head search with `blob_overlap`, `ast_overlap` and `overlap_by_target_directory`."""
    pairs = found.select("target", "candidate")
    full = found
    for name, rows, keys in (("blob", bag, ["blob"]), ("aligned", bag, ["path", "blob"]), ("shape", units, ["shape"]), ("placed", units, ["path", "shape"])):
        sums = pair_sums(pairs, rows, *keys).select("target", "candidate", F.col("shared").alias(f"__{name}"), F.col("shared_unique").alias(f"__{name}_unique"))
        full = full.join(sums, ["target", "candidate"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in (f"__{name}", f"__{name}_unique")})
    for name, rows in (("blobs", bag), ("shapes", units)):
        total = bags.totals(rows.groupBy("work_id").agg(F.count(F.lit(1)).alias("n")))
        for side in ("target", "candidate"):
            full = full.join(total.select(F.col("work_id").alias(side), F.col("total").alias(f"{side}_{name}")), side, "left").withColumn(f"{side}_{name}", F.coalesce(f"{side}_{name}", F.lit(0)))
    moved = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.col(b))
    blob = F.struct(_counts("__blob", "blobs").alias("content_instances"), _counts("__aligned", "blobs").alias("path_aligned_instances"), F.col("__blob_unique").alias("shared_unique_blobs"), moved("__blob", "__aligned").alias("relocated_instances"))
    ast = F.struct(_counts("__shape", "shapes").alias("shape_instances"), _counts("__placed", "shapes").alias("path_aligned_shape_instances"), moved("__shape", "__placed").alias("renamed_or_relocated_instances"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("shared_instances")).alias("o"), "directory", F.struct("shared_instances", "target_instances").alias("n"))))
    by_directory = directories(pairs, units, order).groupBy("target", "candidate").agg(listed.alias("ds"))
    by_directory = by_directory.select("target", "candidate", F.map_from_entries(F.transform("ds", lambda d: F.struct(d["directory"], d["n"]))).alias("overlap_by_target_directory"))
    return full.select(*found.columns, blob.alias("blob_overlap"), ast.alias("ast_overlap")).join(by_directory, ["target", "candidate"], "left")


#: What a candidate's registry entry adds to its row.
REGISTERED = ("year", "repository_type", "reference_kind", "module_ids", "review_branch")


def head_records(found: DataFrame, bag: DataFrame, units: DataFrame, works: DataFrame, order: list[str]) -> DataFrame:
    """(target, text): one JSON record for each target of a head search, its candidates by rank.

    `works` is a normalised registry (`report.registry`), one row a work; works it lacks have empty entries.
    """
    entry = works.select(F.col("work_id").alias("candidate"), *[F.col(c).alias(f"__{c}") for c in REGISTERED])
    full = candidate_figures(found, bag, units, order).join(entry, "candidate", "left")
    empty = {"year": F.lit(0), "repository_type": F.lit("competition"), "module_ids": F.array().cast("array<string>")}
    fields = [F.coalesce(f"__{c}", empty.get(c, F.lit(""))).alias("review_ref" if c == "review_branch" else c) for c in REGISTERED]
    row = F.struct("rank", F.col("candidate").alias("work_id"), "display_name", *fields, F.col("commit").alias("review_commit"), "commit", "blob_overlap", "ast_overlap", F.col("score").alias("combined_recall_score"), "overlap_by_target_directory")
    listed = full.groupBy("target").agg(F.array_sort(F.collect_list(row), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("rs"))
    named = works.select(F.col("work_id").alias("target"), F.struct(*[F.col(c).alias(f"target_{c}") for c in ("display_name", "year", "repository_type")], F.col("review_branch").alias("target_review_ref")).alias("t"))
    at = listed.join(named, "target", "left").select("target", "t.*", F.transform("rs", lambda r: r.dropFields("rank")).alias("candidates"))
    data = F.struct(F.lit(results.HEAD_SCHEMA).alias("schema"), F.col("target").alias("target_work_id"), *[c for c in at.columns if c not in ("target", "candidates")], "candidates")
    return at.select("target", F.to_json(data).alias("text"))
