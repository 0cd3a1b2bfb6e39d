"""Records of any length as numbered pages, and a manifest that vouches for them.

A comparison names every occurrence that two commits share or don't; a history names every occurrence of the
target that it holds. As one value that doesn't fit a row. Here a part of a record is its rows in order, cut into
pages of `PAGE` rows: JSON lines with their count and SHA-256. Places come from range-dealt partitions, so no task
holds more than its range, and a row no more than a page. The manifest has a row for each part; a reader
that has come as far as a page goes on from the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import bags
from tallyloom.operators.digests import ordered_digest
from tallyloom.operators.running import running_sum
from tallyloom.operators.search import in_order

PAGE = 5000


def paged(rows: DataFrame, order: list[Column], size: int = PAGE) -> DataFrame:
    """(page, n, sha256, text) of rows in a total order: JSON lines of all their columns."""
    line = F.to_json(F.struct(*rows.columns))
    at = in_order(rows, order).select(F.floor((F.col("place") - 1) / size).cast("long").alias("page"), "place", line.alias("line"))
    held = at.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls"))
    text = F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n"))
    return held.select("page", F.size("ls").cast("long").alias("n"), text.alias("text")).select("page", "n", F.sha2("text", 256).alias("sha256"), "text")


def grouped(rows: DataFrame, group: str, order: list[Column], size: int = PAGE) -> DataFrame:
    """(group, page, n, sha256, text) of each group's rows in a total order; a group with most of the rows spans many tasks."""
    line = F.to_json(F.struct(*[c for c in rows.columns if c != group]))
    keys = [f"__{k}" for k in range(len(order))]
    lines = rows.select(F.col(group), *[c.alias(k) for c, k in zip(order, keys)], line.alias("line"), F.lit(1).alias("one"))
    at = running_sum(lines, group, [F.col(k) for k in keys], "one", "place").withColumn("page", F.floor(F.col("place") / size).cast("long"))
    held = at.groupBy(group, "page").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls"))
    text = F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n"))
    return held.select(group, "page", F.size("ls").cast("long").alias("n"), text.alias("text")).select(group, "page", "n", F.sha2("text", 256).alias("sha256"), "text")


def inventory_pages(tree: DataFrame, size: int = PAGE) -> DataFrame:
    """(work_id, page, n, sha256, text): all distinct paths of every snapshot, in order."""
    return grouped(tree.select("work_id", "path").distinct(), "work_id", [F.col("path")], size)


def _parts(parts: dict[str, tuple[DataFrame, tuple[str, ...]]], size: int) -> DataFrame:
    out = None
    for name, (rows, order) in parts.items():
        own = paged(rows, [F.col(c) for c in order], size).select(F.lit(name).alias("part"), "page", "n", "sha256", "text")
        out = own if out is None else out.unionByName(own)
    return out


def pair_pages(left: DataFrame, right: DataFrame, size: int = PAGE) -> DataFrame:
    """(part, page, n, sha256, text): every occurrence of a comparison of (path, blob) rows.

    `shared_content_occurrences` has a row for each path of a shared value and side, with the value's shared instances;
    `path_aligned_occurrences` the shared instances by path and value; the residuals what either side has beyond the other.
    """
    both = bags.side_counts(left, right, "blob").select("blob", F.least("ln", "rn").alias("instances"))
    sides = [df.select("blob", F.lit(side).alias("side"), "path").distinct() for side, df in (("left", left), ("right", right))]
    shared = sides[0].unionByName(sides[1]).join(both, "blob").select("blob", "side", "path", "instances")
    aligned = bags.side_counts(left, right, "path", "blob").select("path", "blob", F.least("ln", "rn").alias("instances"))
    rest = {f"{side}_residual_occurrences": bags.residual(a, b).groupBy("blob", "path").agg(F.count(F.lit(1)).alias("instances")) for side, a, b in (("left", left, right), ("right", right, left))}
    parts = {"shared_content_occurrences": (shared, ("blob", "side", "path")), "path_aligned_occurrences": (aligned, ("path", "blob"))}
    return _parts(parts | {name: (rows, ("blob", "path")) for name, rows in rest.items()}, size)


def history_pages(matches: DataFrame, size: int = PAGE) -> DataFrame:
    """(part, page, n, sha256, text): the occurrences (candidate, path, blob, n) of a target that histories hold, by candidate."""
    rows = matches.select("candidate", "path", "blob", F.col("n").alias("instances"))
    return _parts({"matched_target_occurrences": (rows, ("candidate", "path", "blob"))}, size)


def manifest(pages: DataFrame) -> DataFrame:
    """(part, pages, rows, sha256): what each part consists of; the digest is that of its pages' digests in order."""
    counted = pages.groupBy("part").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("rows"))
    return counted.join(ordered_digest(pages, "part", [F.col("page")], F.col("sha256")).withColumnRenamed("digest", "sha256"), "part")


def read_from(pages: DataFrame, part: str, page: int, form: str) -> DataFrame:
    """(page, line, ...) of a part's rows from a page on, read by a schema; a page whose digest doesn't fit is an error."""
    own = pages.where((F.col("part") == part) & (F.col("page") >= page))
    text = F.when(F.sha2("text", 256) == F.col("sha256"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("page broken: "), F.col("page").cast("string"))))
    lines = own.select("page", F.posexplode(F.split(F.rtrim(text, F.lit("\n")), "\n")).alias("line", "row"))
    return lines.select("page", "line", F.from_json("row", form).alias("r")).select("page", "line", "r.*")
