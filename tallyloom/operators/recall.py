"""The likeliest sources of every work at once, without the pairs that can't be among them.

`search.head_candidates` compares named targets with all works. For all works as targets that is the
square of their number as soon as one value lies in every work (a license file). Here values in few works are
summed for all pairs that share them (`bags.pairs_by`), which shuffles no pair. These sums prove a floor for each
target, its k-th best score by them alone. A pair stays if what it shares so, and all that the two hold of more
frequent values, can reach the floor. Pairs that share frequent values alone must share one of the target's rarer
ones among them: the most frequent, up to less than floor * size instances in all, can't reach it together. The frequent values of
what is left are summed in full.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import bags, search
from tallyloom.operators.cuts import durable
from tallyloom.operators.running import running_sum

#: Values in at most so many works are summed for all pairs that share them; what they cost is at most so many times their rows.
COOL = 256
#: Scores are rounded to six places, so a floor is lowered by as much.
_SLACK = 1e-6
KINDS = ("blob", "shape")


def _shuffled(written: DataFrame) -> DataFrame:
    """A table that joins don't broadcast: its files are many times smaller than its rows, so their size tells nothing of the driver's share."""
    return written.hint("merge")


def _sized(counted: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Counts (work_id, value, n) with the instances of their work and the works of their value, which is a number from here on.

    One shuffle, and none if the counts are dealt by value already. `total` (work_id, total) saves summing them.
    """
    total = durable(bags.totals(counted), "totals") if total is None else total
    held = counted.where(F.col("value").isNotNull()).groupBy("value").agg(F.collect_list(F.struct("work_id", "n")).alias("held"))
    held = held.select(F.monotonically_increasing_id().alias("value"), F.size("held").alias("works"), "held")  # a number each, before they are told apart
    each = held.select("value", "works", F.explode("held").alias("h"))
    return _shuffled(durable(each.select("h.work_id", "value", "h.n", "works").join(bags.beside(total), "work_id"), "sized"))


def _known(sized: dict[str, DataFrame], light: int) -> DataFrame:
    """(work_id, number, <kind>_total, <kind>_hot) of all works: their instances, and those of values in more than `light` works."""
    hot = F.coalesce(F.sum(F.when(F.col("works") > light, F.col("n"))), F.lit(0))
    own = [rows.groupBy("work_id").agg(F.max("total").alias(f"{kind}_total"), hot.alias(f"{kind}_hot")) for kind, rows in sized.items()]
    every = functools.reduce(lambda a, b: a.join(b, "work_id", "full"), own)
    every = durable(every.na.fill(0), "info")
    return durable(every.join(bags.beside(bags.numbered(every)), "work_id"), "known")


def _cool(sized: dict[str, DataFrame], known: DataFrame, light: int) -> DataFrame:
    """(t, c, <kind>) of all pairs t < c of works' numbers that share a value in at most `light` works, of whichever kind."""
    some = [rows.where(F.col("works").between(2, light)).select("work_id", "value", "n", F.lit(i).alias("part")) for i, rows in enumerate(sized.values())]
    numbers = bags.beside(known).select("work_id", "number")
    rows = functools.reduce(DataFrame.unionByName, some).join(numbers, "work_id").select("part", "value", "number", "n")
    pairs = bags.pairs_by(rows.repartition("value"), ["value"], list(sized), known.count())
    return durable(pairs.select("t", "c", *sized), "cool")


def _larger(kind: str, a: str = "l", b: str = "r") -> Column:
    return F.greatest(F.col(f"{a}_{kind}_total"), F.col(f"{b}_{kind}_total"))


def _score(shared, kinds: list[str]) -> Column:
    """The best score of a pair (l_, r_ totals) if it shares `shared(kind)` instances."""
    scores = [F.when(_larger(k) > 0, shared(k) / _larger(k)).otherwise(F.lit(0.0)) for k in kinds]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def _sides(pairs: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """Pairs of numbers told from either side, (target, candidate), with l_ and r_ columns of what is known of either."""
    sides = F.array(F.struct(F.col("t").alias("target"), F.col("c").alias("candidate")), F.struct(F.col("c").alias("target"), F.col("t").alias("candidate")))
    told = pairs.select(F.explode(sides).alias("p"), *more).select("p.target", "p.candidate", *more)
    at = lambda p, n: bags.beside(known).select(*[F.col(c).alias(n if c == "number" else f"{p}_{c}") for c in known.columns])
    return told.join(at("l", "target"), "target").join(at("r", "candidate"), "candidate")


def floors(scored: DataFrame, k: int) -> DataFrame:
    """(target, floor) of the targets that have k candidates by `score`: their k-th score is no less."""
    placed = scored.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score")))).where(F.col("rank") <= k)
    return placed.where(F.col("rank") == k).select("target", F.greatest(F.lit(0.0), F.col("score") - _SLACK).alias("floor"))


def _met(sized: DataFrame, known: DataFrame, kind: str, light: int) -> DataFrame:
    """(target, candidate) pairs of works that may reach the target's floor by values in more than `light` works alone."""
    hot = sized.where(F.col("works") > light)
    rows = running_sum(hot, "work_id", [F.col("works"), F.col("value")], "n", "before").join(bags.beside(known).select("work_id", "floor", f"{kind}_hot"), "work_id")
    rare = rows.where(F.col(f"{kind}_hot") - F.col("before") >= F.col("floor") * F.col("total"))
    rare = rare.select(F.col("work_id").alias("target"), "value", F.col("total").alias("lt"), "floor")
    other = hot.select(F.col("work_id").alias("candidate"), "value", F.col("total").alias("rt"))
    fits = F.least("lt", "rt") / F.greatest("lt", "rt") >= F.col("floor")
    return rare.join(other, "value").where((F.col("target") != F.col("candidate")) & fits).select("target", "candidate").distinct()


def recall_pairs(blobs: DataFrame, shapes: DataFrame, k: int, light: int | None = None) -> DataFrame:
    """(target, candidate, blob, shape): a superset of all pairs that share something and are among a target's k best; sized counts of both kinds.

    The sums are those of values in at most `light` works (`COOL`).
    """
    light = COOL if light is None else light
    sized = dict(zip(KINDS, (blobs, shapes), strict=True))
    known = _known(sized, light)
    cool = _cool(sized, known, light)
    floor = floors(_sides(cool, known, *KINDS).select("target", _score(F.col, KINDS).alias("score")), k)
    floor = durable(floor.withColumnRenamed("target", "number"), "floors")
    known = durable(known.join(floor, "number", "left").na.fill(0.0, ["floor"]), "known")
    most = lambda kind: F.col(kind) + F.least(f"l_{kind}_hot", f"r_{kind}_hot")
    kept = _sides(cool, known, *KINDS).where(_score(most, KINDS) >= F.col("l_floor"))
    every = kept.select(F.col("l_work_id").alias("target"), F.col("r_work_id").alias("candidate"), *KINDS)
    zero = F.lit(0).cast("long")
    for kind, rows in sized.items():
        every = every.unionByName(_met(rows, known, kind, light).select("target", "candidate", *[zero.alias(x) for x in KINDS]))
    return _shuffled(durable(every.groupBy("target", "candidate").agg(*[F.max(x).alias(x) for x in KINDS]), "met"))


def _summed(pairs: DataFrame, sized: DataFrame, works: DataFrame, light: int | None = None, cool: str | None = None) -> DataFrame:
    """(target, candidate, shared): of values in few works all pairs at once, unless the pairs' column `cool` has it; of the others the given pairs alone."""
    light = COOL if light is None else light
    if cool:
        each = pairs.select("target", "candidate", F.col(cool).alias("shared"))
    else:
        rows = sized.where(F.col("works").between(2, light)).select("work_id", "value", "n")
        each = bags.overlaps(rows, "value", works=works).select("target", "candidate", "shared").join(pairs, ["target", "candidate"], "left_semi")
    hot = sized.where(F.col("works") > light)
    own = hot.select(F.col("work_id").alias("target"), "value", F.col("n").alias("ln"))
    other = hot.select(F.col("work_id").alias("candidate"), "value", F.col("n").alias("rn"))
    more = pairs.select("target", "candidate").join(own, "target").join(other, ["candidate", "value"]).select("target", "candidate", F.least("ln", "rn").alias("shared"))
    return each.unionByName(more).groupBy("target", "candidate").agg(F.sum("shared").alias("shared"))


def head_recall(bag: DataFrame, units: DataFrame, k: int = 30, names: DataFrame | None = None, light: int | None = None) -> DataFrame:
    """The rows of `search.head_candidates` with every work as a target.

    Where fewer than k works share anything with a target, works with score 0 follow in order of their names.
    """
    total = bags.works_of(bag)
    works = total.select("work_id")
    units = units.join(bags.beside(works), "work_id", "left_semi")
    totals = {"blob": total, "shape": bags.works_of(units)}
    # dealt by value before they are counted, so what follows needs no other shuffle
    value = lambda rows, kind: bags.short(kind, dict(rows.dtypes)[kind]).alias("value")
    counted = {kind: bags.counts(rows.select("work_id", value(rows, kind)).repartition("value"), "value") for kind, rows in (("blob", bag), ("shape", units))}
    sized = {kind: _sized(rows, totals[kind]) for kind, rows in counted.items()}
    pairs = recall_pairs(sized["blob"], sized["shape"], k, light)
    scored = pairs.select("target", "candidate")
    for name, rows in sized.items():
        full = bags.containment(_summed(pairs, rows, works, light, name), bags.beside(totals[name]))
        full = full.select("target", "candidate", F.col("shared").alias(f"{name}_shared"), F.bround("balanced", 6).alias(f"{name}_balanced"))
        scored = scored.join(full, ["target", "candidate"])
    met = pairs.groupBy("target").agg(F.count(F.lit(1)).alias("met"))
    lacking = works.withColumnRenamed("work_id", "target").join(met, "target", "left").where(F.coalesce("met", F.lit(0)) < k).select("target")
    order = ["display_name", "commit", "candidate"]
    first = search.named(works.withColumnRenamed("work_id", "candidate"), names).orderBy(*order).limit(k + 1).select("candidate")
    none = lacking.crossJoin(F.broadcast(first)).where("target <> candidate").join(pairs, ["target", "candidate"], "left_anti")  # k + 1 rows a target
    zero = F.lit(0).cast("long")
    none = none.select("target", "candidate", zero.alias("blob_shared"), F.lit(0.0).alias("blob_balanced"), zero.alias("shape_shared"), F.lit(0.0).alias("shape_balanced"))
    scored = search.named(scored.unionByName(none).withColumn("score", F.greatest("blob_balanced", "shape_balanced")), names)
    top = bags.top_candidates(scored, [F.desc("score"), F.asc("display_name"), F.asc("commit"), F.asc("candidate")], k)
    return top.select("target", "candidate", "display_name", "commit", "blob_shared", "shape_shared", "blob_balanced", "shape_balanced", "score", F.col("rank").cast("long").alias("rank"))
