"""Snapshot scans, candidate search at head and in history, commit graphs and comparisons."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import paths as P
from tallyloom.operators import bags, commitgraph
from tallyloom.operators.cuts import durable
from tallyloom.operators.digests import ordered_digest

MOST_BYTES = 4 << 20


def fingerprint_rows(tree: DataFrame) -> DataFrame:
    """Blob entries with a fingerprinted suffix: symbolic links stay, submodules go."""
    return tree.where((F.col("kind") == "blob") & P.file_suffix(F.col("path")).isin(*P.BLOB_SUFFIXES))


def source_blobs(tree: DataFrame, suffixes: list[str], most_bytes: int = MOST_BYTES, exclude: list[str] = ()) -> DataFrame:
    """Blobs with one of the suffixes, not too large and under no excluded prefix."""
    kept = (F.col("kind") == "blob") & P.file_suffix(F.col("path")).isin(*suffixes) & (F.col("size") <= most_bytes)
    return tree.where(kept & ~P.under_any(F.col("path"), list(exclude)))


def digest_of(rows: DataFrame, group: str, *parts: str) -> DataFrame:
    """SHA-256 over a group's rows in order; parts joined by NUL, rows by a line feed."""
    return ordered_digest(rows, group, [F.col(c) for c in parts], F.concat_ws("\0", *parts), "\n")


def snapshot_manifest(files: DataFrame, units: DataFrame) -> DataFrame:
    """Counts and content digest of every snapshot, all of them in one job."""
    counted = files.groupBy("work_id").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("blob").alias("blobs"))
    shaped = units.groupBy("work_id").agg(F.count(F.lit(1)).alias("units"))
    full = counted.join(shaped, "work_id", "left").join(digest_of(files, "work_id", "path", "blob"), "work_id")
    return full.select("work_id", "files", "blobs", F.coalesce("units", F.lit(0)).alias("units"), "digest")


def complete(*parts: Column) -> Column:
    """Whether a cached snapshot can be used again: every part of it is there."""
    return functools.reduce(lambda a, b: a & b, parts)


def in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place in a total order, by range-dealt partitions and counts before each."""
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__in"))
    counted = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counted.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return placed.withColumn("__own", own).join(before, "__part").withColumn("place", F.col("__base") + F.col("__own")).drop("__at", "__part", "__in", "__own", "__base")


def relocated_instances(content: DataFrame, aligned: DataFrame) -> DataFrame:
    """Shared instances that don't stand on the same path."""
    same = aligned.select("target", "candidate", F.col("shared").alias("same"))
    both = content.join(same, ["target", "candidate"], "left")
    return both.select("target", "candidate", F.greatest(F.lit(0), F.col("shared") - F.coalesce("same", F.lit(0))).alias("relocated"))


def all_relocated(bag: DataFrame) -> DataFrame:
    """`relocated_instances` of all pairs of works that share content, both overlaps summed in one pass."""
    both = bags.overlaps_by(bags.single(bag, "path", "blob"), {"shared": ["blob"], "same": ["path", "blob"]}, bag.select("work_id").distinct())
    return both.select("target", "candidate", F.greatest(F.lit(0), F.col("shared") - F.col("same")).alias("relocated"))


def shape_examples(left: DataFrame, right: DataFrame, limit: int = 30) -> DataFrame:
    """First unit of each shared shape on both sides where path or name differ."""
    order = [F.col(c) for c in ("path", "line", "symbol", "ord")]
    unit = F.concat_ws(":", "path", "symbol")
    one = bags.first_rows(left, "shape", order).select("shape", unit.alias("left_unit"))
    two = bags.first_rows(right, "shape", order).select("shape", unit.alias("right_unit"))
    return one.join(two, "shape").where(F.col("left_unit") != F.col("right_unit")).orderBy("shape").limit(limit)


def _overlaps_of(rows: DataFrame, targets: list[str], key: str) -> DataFrame:
    """`bags.overlaps` for some targets: only rows with values that they hold are counted, and joined with theirs."""
    of_target = rows.where(F.col("work_id").isin(*targets))
    wanted = durable(of_target.select(key).distinct(), "wanted")  # written, so the join knows its size and leaves the rest where it is
    own = bags.counts(of_target, key).select(F.col("work_id").alias("target"), key, F.col("n").alias("ln"))
    rest = bags.counts(rows.join(wanted, key, "left_semi"), key).select(F.col("work_id").alias("candidate"), key, F.col("n").alias("rn"))
    both = own.join(rest, key).where(F.col("target") != F.col("candidate"))
    return both.groupBy("target", "candidate").agg(F.sum(F.least("ln", "rn")).alias("shared"))


def named(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """Candidates with display_name and commit of their work; the work's id and no commit where `names` has none."""
    if names is None:
        return rows.withColumns({"display_name": F.col("candidate"), "commit": F.lit("")})
    known = names.select(F.col("work_id").alias("candidate"), F.col("display_name").alias("__name"), F.col("commit").alias("__commit"))
    full = rows.join(known, "candidate", "left")
    return full.withColumns({"display_name": F.coalesce("__name", "candidate"), "commit": F.coalesce("__commit", F.lit(""))}).drop("__name", "__commit")


def head_candidates(bag: DataFrame, units: DataFrame, targets: list[str], k: int = 30, names: DataFrame | None = None) -> DataFrame:
    """The likeliest sources of each target at head: the better of the balanced blob and shape containments.

    Scores are rounded to six places; ties go by display name, then commit (`names`: work_id, display_name,
    commit). Candidates that share nothing stay in, with score 0; a work is never its own candidate.
    """
    scored = None
    for name, rows, key in (("blob", bag, "blob"), ("shape", units, "shape")):
        total = bags.works_of(rows)
        if scored is None:
            works = total.select("work_id")
            own = works.where(F.col("work_id").isin(*targets)).select(F.col("work_id").alias("target"))
            # a row for each named target and each work: the names are arguments, so this is a listing
            scored = works.select(F.col("work_id").alias("candidate"), F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
            scored = scored.join(own, "target", "left_semi").where(F.col("target") != F.col("candidate"))
        pairs = scored.select("target", "candidate").join(_overlaps_of(rows, targets, key), ["target", "candidate"], "left")
        full = bags.containment(pairs, total).select("target", "candidate", F.col("shared").alias(f"{name}_shared"), F.bround("balanced", 6).alias(f"{name}_balanced"))
        scored = scored.join(full, ["target", "candidate"])
    scored = named(scored.withColumn("score", F.greatest("blob_balanced", "shape_balanced")), names)
    top = bags.top_candidates(scored, [F.desc("score"), F.asc("display_name"), F.asc("commit"), F.asc("candidate")], k)
    return top.select("target", "candidate", "display_name", "commit", "blob_shared", "shape_shared", "blob_balanced", "shape_balanced", "score", F.col("rank").cast("long").alias("rank"))


def reachable(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted objects that any ref of a work reaches."""
    ids = wanted.select(F.col("blob").alias("object_id")).distinct()
    return history.join(ids, "object_id", "left_semi").select("work_id", "object_id").distinct()


def history_search(target: DataFrame, history: DataFrame, name: str, k: int | None = 30, names: DataFrame | None = None) -> DataFrame:
    """Works whose history holds blobs of the target, best contained first; works without a hit are left out.

    Containment is rounded to six places; ties go by unique blobs, then display name.
    """
    own = target.groupBy(F.col("blob").alias("object_id")).agg(F.count(F.lit(1)).alias("n"))
    total = own.agg(F.sum("n").alias("target_total"))
    hits = reachable(history.where(F.col("work_id") != name), target).join(own, "object_id")
    found = hits.groupBy(F.col("work_id").alias("candidate")).agg(F.count(F.lit(1)).alias("shared_unique"), F.sum("n").alias("shared"))
    found = found.crossJoin(F.broadcast(total)).withColumn("containment", F.bround(bags.ratio(F.col("shared"), F.col("target_total")), 6))  # one row
    found = named(found, names).select(F.lit(name).alias("target"), "candidate", "display_name", "shared_unique", "shared", "target_total", "containment")
    return found.orderBy(F.desc("containment"), F.desc("shared_unique"), "display_name", "candidate").limit(k) if k else found


def history_matches(target: DataFrame, history: DataFrame, name: str) -> DataFrame:
    """The target's occurrences that each candidate's history holds."""
    own = target.groupBy("path", "blob").agg(F.count(F.lit(1)).alias("n"))
    hits = reachable(history.where(F.col("work_id") != name), target)
    return hits.join(own, hits["object_id"] == own["blob"]).select(F.col("work_id").alias("candidate"), "path", "blob", "n")


def missing(works: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Registered works that have no snapshot."""
    return works.select("work_id").distinct().join(snapshots.select("work_id"), "work_id", "left_anti")


def resolve(refs: DataFrame, ref: str) -> DataFrame:
    """The newest commit of a ref in each work."""
    return refs.where(F.col("ref") == ref).groupBy("work_id").agg(F.max_by("commit", "ord").alias("commit"))


def ancestors(commits: DataFrame, start: int) -> DataFrame:
    """Commits reachable from one by (id, parent_id) rows, with their least distance; a parent's id is less than its child's."""
    own = commits.select(F.lit("").alias("work_id"), "id", "parent_id")
    first = commits.where(F.col("id") == start).select(F.lit("").alias("work_id"), "id")
    return commitgraph.reached(own, first).select("id", "depth")


def comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """The totals of a two-sided comparison, in one row."""
    n = lambda name: F.count(F.lit(1)).alias(name)
    content = bags.side_counts(left, right, "blob").agg(F.coalesce(F.sum(F.least("ln", "rn")), F.lit(0)).alias("shared"), n("shared_unique"))
    aligned = bags.side_counts(left, right, "path", "blob").agg(F.coalesce(F.sum(F.least("ln", "rn")), F.lit(0)).alias("path_aligned"))
    both = left.agg(n("left_total")).crossJoin(right.agg(n("right_total"))).crossJoin(content).crossJoin(aligned)  # single rows
    return both.withColumn("relocated", F.greatest(F.lit(0), F.col("shared") - F.col("path_aligned")))
