"""Bag algebra over snapshot fingerprints.

A snapshot is a bag of rows (work_id, path, fingerprint ...). Every comparison pre-aggregates each
side to (work_id, key, n) with map-side partial sums, so a hot fingerprint costs one row per work
before it is joined; the shared part of two bags is the sum of the lesser counts.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.cuts import durable
from tallyloom.operators.running import running_sum


def counts(bag: DataFrame, *keys: str) -> DataFrame:
    """Multiplicity n of each key in each work."""
    return bag.groupBy("work_id", *keys).agg(F.count(F.lit(1)).alias("n"))


def works_of(bag: DataFrame) -> DataFrame:
    """(work_id, total) of a bag's own rows, written: joins with it know its size and leave large tables where they are."""
    return durable(bag.groupBy("work_id").agg(F.count(F.lit(1)).alias("total")), "totals")


def totals(counted: DataFrame) -> DataFrame:
    """Instances in each work."""
    return counted.groupBy("work_id").agg(F.sum("n").alias("total"))


#: Works of a block, as a power of two: at most 256, fewer where there are few works.
_LEAST_BITS, _MOST_BITS = 5, 8
#: Bytes that a table with a row a work takes when it is broadcast, at most; some million works with short names.
MOST_BYTES = 1 << 26


def beside(works: DataFrame, column: str = "work_id") -> DataFrame:
    """A written table with a row a work, to be joined with rows or pairs: broadcast while it is known to be small.

    Rows and pairs then stay where they are. `column` is its text; 64 bytes are reckoned for all else.
    """
    size = works.agg(F.count(F.lit(1)) * 64 + F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return F.broadcast(works) if size <= MOST_BYTES else works.hint("merge")


def short(key: str, kind: str) -> Column:
    """A key in as few bytes as can be told back: text that is lower-case hex becomes its bytes, marked as such."""
    if kind != "string":
        return F.col(key)
    own = F.unhex(key)
    return F.when(F.lower(F.hex(own)) == F.col(key), F.concat(F.lit(b"\1"), own)).otherwise(F.concat(F.lit(b"\0"), F.encode(key, "UTF-8"))).alias(key)


def numbered(works: DataFrame) -> DataFrame:
    """Works with numbers from 0 that follow their names; those made one after another are mostly alike, so few blocks hold a value."""
    rows = works.select("work_id", F.lit(0).alias("all"), F.lit(1).cast("long").alias("one"))
    return durable(running_sum(rows, "all", [F.length("work_id"), F.col("work_id")], "one", "number").select("work_id", "number"), "works")


def _dealt(rows: DataFrame, parts: dict[str, list[str]], known: DataFrame) -> DataFrame:
    """(part, keys, number, n) of each part that a row has a key of, dealt once by the keys that all parts share."""
    keys = list(dict.fromkeys(k for own in parts.values() for k in own))
    shared = [k for k in keys if all(k in own for own in parts.values())]
    kinds = dict(rows.dtypes)
    dealt = rows.dropna(subset=shared).join(known, "work_id").select(*[short(k, kinds[k]) for k in keys], "number", "n")
    dealt = dealt.repartition(*shared)
    if len(parts) == 1:
        return dealt.withColumn("part", F.lit(0))
    rest = [k for k in keys if k not in shared]
    each = [F.struct(F.lit(i).alias("part"), *[(F.col(k) if k in own else F.lit(None)).alias(k) for k in rest]) for i, own in enumerate(parts.values())]
    there = [functools.reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in own]) for own in parts.values()]  # a key that is null equals none
    told = F.filter(F.array(*[F.when(t, e) for t, e in zip(there, each, strict=True)]), lambda x: x.isNotNull())
    # the shared keys stay columns of their own, else Spark no longer knows by what the rows are dealt
    return dealt.select(*shared, "number", "n", F.explode(told).alias("e")).select("e.*", *shared, "number", "n")


def pairs_by(dealt: DataFrame, keys: list[str], names: list[str], count: int) -> DataFrame:
    """(t, c) of all pairs of numbers t < c that share a key, with <name> and <name>_unique for each part.

    `dealt` has rows (part, keys, number, n) that are dealt by keys already, `count` is that of the works. Products of
    holders are never shuffled: each value sends a block of works its holders, all from the block on, and the
    block's task sums its pairs. A holder is one long, its work's number above its count, so lists stay small.
    """
    bits = max(_LEAST_BITS, min(_MOST_BITS, (count // 64).bit_length() - 1))
    post = F.shiftleft(F.col("number"), 32).bitwiseOR(F.col("n"))
    counted = dealt.groupBy("part", *keys, "number").agg(F.sum("n").alias("n"))
    held = counted.groupBy("part", *keys).agg(F.array_sort(F.collect_list(post)).alias("later")).where(F.size("later") > 1)
    block = lambda x: F.shiftright(x, 32 + bits)
    each = held.select("part", "later", F.explode(F.array_distinct(F.transform("later", block))).alias("block"))
    each = each.select("part", "block", F.filter("later", lambda x: block(x) >= F.col("block")).alias("later")).where(F.size("later") > 1)
    each = each.repartition((count >> bits) + 1, "block")
    both = each.select("block", "part", F.explode("later").alias("l"), "later").where(block(F.col("l")) == F.col("block"))
    both = both.select("block", "part", "l", F.explode("later").alias("r"))
    number, n = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    both = both.select("block", "part", number("l").alias("t"), number("r").alias("c"), F.least(n("l"), n("r")).alias("least")).where("t < c")
    sums = []
    for i, name in enumerate(names):
        own = F.when(F.col("part") == i, F.col("least")) if len(names) > 1 else F.col("least")
        sums += [F.coalesce(F.sum(own), F.lit(0)).alias(name), F.count(own).alias(f"{name}_unique")]
    return both.groupBy("block", "t", "c").agg(*sums).drop("block")


def overlaps_by(rows: DataFrame, parts: dict[str, list[str]], works: DataFrame) -> DataFrame:
    """(target, candidate) of all ordered pairs of `works` that share a key of the first part, with <name> and <name>_unique for each part.

    `rows` (work_id, keys, n) are counts or single rows with n = 1; a part is its keys, and all parts have a key in
    common. Rows are shuffled once for all parts. What two works share is the same both ways, so each
    unordered pair is summed once and then told from either side.
    """
    works = numbered(works)
    known, count = beside(works), works.count()
    keys = list(dict.fromkeys(k for own in parts.values() for k in own))
    summed = pairs_by(_dealt(rows, parts, known), keys, list(parts), count).where(F.col(f"{next(iter(parts))}_unique") > 0)
    told = summed.join(known.select(F.col("number").alias("t"), F.col("work_id").alias("__l")), "t").join(known.select(F.col("number").alias("c"), F.col("work_id").alias("__r")), "c")
    sides = F.array(F.struct(F.col("__l").alias("target"), F.col("__r").alias("candidate")), F.struct(F.col("__r").alias("target"), F.col("__l").alias("candidate")))
    figures = [c for name in parts for c in (name, f"{name}_unique")]
    return told.select(F.explode(sides).alias("p"), *figures).select("p.target", "p.candidate", *figures)


def overlaps(rows: DataFrame, *keys: str, works: DataFrame | None = None) -> DataFrame:
    """(target, candidate, shared, shared_unique) of all ordered pairs of works that share a key.

    `rows` are counts (`counts`), or a bag's own rows, which are then shuffled once and not twice. `works`
    (work_id, each once) saves counting twice where the caller has a cheaper way to list them.
    """
    works = rows.select("work_id").distinct() if works is None else works
    return overlaps_by(rows, {"shared": list(keys)}, works)


def single(bag: DataFrame, *keys: str) -> DataFrame:
    """A bag's own rows as counts that aren't summed yet."""
    return bag.select("work_id", *keys, F.lit(1).cast("long").alias("n"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is empty."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def containment(pairs: DataFrame, total: DataFrame) -> DataFrame:
    """Add totals, both containments and the lesser of them (unrounded) to (target, candidate, shared).

    `total` may be `beside` the pairs, which then stay where they are.
    """
    own = total.select(F.col("work_id").alias("target"), F.col("total").alias("target_total"))
    other = total.select(F.col("work_id").alias("candidate"), F.col("total").alias("candidate_total"))
    full = pairs.join(own, "target", "left").join(other, "candidate", "left")
    full = full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("target_total", "candidate_total", "shared")})
    full = full.withColumn("target_containment", ratio(F.col("shared"), F.col("target_total")))
    full = full.withColumn("candidate_containment", ratio(F.col("shared"), F.col("candidate_total")))
    return full.withColumn("balanced", F.least("target_containment", "candidate_containment"))


def side_counts(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, ln, rn) of the keys that both bags hold."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("ln"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("rn"))
    return a.join(b, list(keys))


def paths_by(bag: DataFrame, key: str) -> DataFrame:
    """Sorted distinct paths of each fingerprint value."""
    return bag.groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def relocated(left: DataFrame, right: DataFrame, key: str, limit: int | None = 30) -> DataFrame:
    """Values on both sides under different path sets, in order of value."""
    a = paths_by(left, key).withColumnRenamed("paths", "left_paths")
    b = paths_by(right, key).withColumnRenamed("paths", "right_paths")
    found = a.join(b, key).where(F.col("left_paths") != F.col("right_paths"))
    return found.orderBy(key).limit(limit) if limit else found


def shared_content(left: DataFrame, right: DataFrame, key: str = "blob") -> DataFrame:
    """Each shared value with the lesser count and both path lists."""
    a = paths_by(left, key).withColumnRenamed("paths", "left_paths")
    b = paths_by(right, key).withColumnRenamed("paths", "right_paths")
    n = side_counts(left, right, key).select(key, F.least("ln", "rn").alias("instances"))
    return n.join(a, key).join(b, key)


def residual(left: DataFrame, right: DataFrame, key: str = "blob") -> DataFrame:
    """(path, key) rows of left that right doesn't match, matches on the same path being used up first.

    Both sides are counts by (path, key) from the start. What the same paths leave over of a key is
    used up by path, through running sums that hold even if a key has a third of all rows.
    """
    own = left.groupBy("path", key).agg(F.count(F.lit(1)).alias("n"))
    exact = right.groupBy("path", key).agg(F.count(F.lit(1)).alias("same"))
    rest = own.join(exact, ["path", key], "left").withColumn("used", F.least("n", F.coalesce("same", F.lit(0))))
    rest = rest.select("path", key, "used", (F.col("n") - F.col("used")).alias("over"))
    used = rest.groupBy(key).agg(F.sum("used").alias("used"))
    left_over = right.groupBy(key).agg(F.count(F.lit(1)).alias("all")).join(used, key, "left")
    left_over = left_over.select(key, (F.col("all") - F.coalesce("used", F.lit(0))).alias("capacity")).where("capacity > 0")
    wanted = running_sum(rest.where("over > 0").select("path", key, "over"), key, [F.col("path")], "over", "before")
    taken = F.least(F.col("over"), F.greatest(F.lit(0), F.coalesce("capacity", F.lit(0)) - F.col("before")))
    stays = wanted.join(left_over, key, "left").withColumn("stays", F.col("over") - taken).where("stays > 0")
    return stays.select("path", key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("stays"))).alias("__k")).drop("__k")


def greedy_directories(target: DataFrame, candidate: DataFrame, key: str, directory: Column, order: list[Column]) -> DataFrame:
    """Shared and total instances by directory of the target, each row using up one of the candidate's."""
    capacity = candidate.groupBy(key).agg(F.count(F.lit(1)).alias("capacity"))
    placed = running_sum(target.withColumn("__one", F.lit(1)), key, order, "__one", "__before").join(capacity, key, "left")
    hit = (F.col("__before") < F.coalesce("capacity", F.lit(0))).cast("long")
    return placed.groupBy(directory.alias("directory")).agg(F.sum(hit).alias("shared_instances"), F.count(F.lit(1)).alias("target_instances"))


def first_rows(bag: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key value."""
    return bag.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")


def top_candidates(scored: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k best rows of each target, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(*order))).where(F.col("rank") <= k)
