"""Mixing sources to target weights by systematic sampling.

Each source's target is its weight's share of all words, stopped at `MOST_COPIES` times the source
and the excess reshared among the others (water filling, exact in whole numbers). A document's
expected copies are target / size of its source. Within a source the expected copies are
prefix-summed, one random offset in [0, 1) (from a hash of seed and source) is added, and a document
is taken once for each whole number that its own stretch crosses, so its chance is its expected
copies. The documents of a source stand with sizes rising to the largest and falling again, every
other one on either slope: what the offset adds on one slope it takes away on the other, and the
words taken come near the target.

Ranks come from range-dealt partitions (`ranked`), so a source with a third of all rows spans as
many tasks as it needs. Sources are a table too, of any number: their weights and water levels come
from running sums, and Spark broadcasts that table only where it is small. Only (doc_id, source,
size) is moved, never text.

Defined results: null text has size 0; null source is a source of its own, last in order; equal
sizes stand by doc_id; a source without words has target 0 and nothing is taken from it; repeated
rows are each placed, and `take_mixture` deals what they take together evenly among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, n_words, ranked, running, table

MOST_COPIES, WEIGHTS, SEED = 3, (1, 2, 3), "mix-1"


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add target, the words to take from each source, to rows of (source, source_size), one a source."""
    named = ranked(sources, [], [F.asc_nulls_last("source")], "__rank")
    named = named.withColumn("__w", F.array(*[F.lit(w) for w in weights])[F.col("__rank") % len(weights)].cast("long")).drop("__rank")
    named = named.withColumn("__cap", F.col("source_size") * most)
    # sources in the order in which a rising water level meets their caps
    level = running(named, [F.asc(F.col("__cap") / F.col("__w")), F.asc_nulls_last("source")], {"__before": "__cap", "__shares": "__w"})
    level = durable(level, "level")
    whole = level.agg(F.sum("source_size").alias("__total"), F.sum("__w").alias("__all"))
    big = lambda c: c.cast("decimal(38,0)")
    left, rest = F.col("__total") - F.col("__before"), F.col("__all") - F.col("__shares")
    level = level.crossJoin(F.broadcast(whole)).withColumn("__free", big(left) * F.col("__w") < big(F.col("__cap")) * rest)  # one row
    first = level.where("__free").agg(F.max(left).alias("__left"), F.max(rest).alias("__rest"))
    share = F.col("__left").cast("double") / F.col("__rest").cast("double") * F.col("__w")
    both = level.crossJoin(F.broadcast(first))  # one row
    return both.select(*sources.columns, F.when(F.col("__free"), share).otherwise(F.col("__cap").cast("double")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The random offset of a source, in [0, 1)."""
    named = F.when(source.isNull(), F.lit(f"{seed}:n")).otherwise(F.concat(F.lit(f"{seed}:s"), source))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, most: int = MOST_COPIES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each document, and the columns in `carry`."""
    sized = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carry), "sizes")
    sources = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "sources")
    goal = F.col("target") / F.col("source_size").cast("double")
    plan = targets(sources, weights, most).select(
        F.col("source").alias("name"),
        "source_size",
        "n_docs",
        "target",
        F.when(F.col("source_size") > 0, goal).otherwise(0.0).alias("rate"),
        offset(F.col("source"), seed).alias("shift"),
    )
    plan = durable(plan, "plan")
    placed = ranked(sized, ["source"], [F.desc("size"), F.asc("doc_id")], "rank")
    known = placed.join(plan, F.col("source").eqNullSafe(F.col("name")))
    # the largest stands in the middle, every other one before and after it
    at = F.expr("if(`rank` % 2 = 0, (n_docs + 1) div 2 - 1 - `rank` div 2, (n_docs + 1) div 2 + `rank` div 2)")
    known = known.withColumn("__place", at)
    upto = lambda k: F.floor(k * F.col("rate") + F.col("shift"))
    copies = (upto(F.col("__place") + 1) - upto(F.col("__place"))).cast("long")
    return known.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *carry)


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def take_mixture(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each as often as the mixture takes it, in its own columns."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select(own, "doc_id", "source", "text", F.xxhash64("text").alias("held"))
    keys = ["doc_id", "source", "held"]
    taken = mix(rows, carry=("held",)).groupBy(*keys).agg(F.sum("copies").alias("taken"), F.count(F.lit(1)).alias("rows")).where("taken > 0")
    taken = durable(taken.select(*[F.col(k).alias(f"k_{k}") for k in keys], "taken", "rows"), "taken")
    rows = rows.select("own", *keys, F.monotonically_increasing_id().alias("at"))
    same = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("held") == F.col("k_held"))
    # merged at every size: the plan tried on small tables is the one that large tables get
    out = rows.join(taken.where("rows = 1").hint("merge"), same).select("own", F.col("taken").alias("copies"))
    repeated = taken.where("rows > 1")
    if not repeated.isEmpty():  # what repeated rows take together is dealt out among them
        again = ranked(rows.join(repeated.hint("merge"), same).select("own", *keys, "at", "taken", "rows"), keys, [F.asc("at")], "rank")
        out = out.union(again.select("own", F.expr("taken div rows + if(`rank` < taken % rows, 1, 0)").alias("copies")).where("copies > 0"))
    return out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("own.*")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, {MOST_COPIES} * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum({MOST_COPIES} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s WINDOW o AS (ORDER BY {MOST_COPIES}.0 * source_size / w, source NULLS LAST)),
f AS (SELECT *, (total - before) * w < cap * rest AS free FROM c),
l AS (SELECT min(before) AS b, max(rest) AS r FROM f WHERE free),
g AS (
  SELECT source, source_size,
    CASE WHEN free THEN (f.total - l.b)::DOUBLE / l.r::DOUBLE * w ELSE cap::DOUBLE END AS target,
    ('0x' || substr(md5(CASE WHEN source IS NULL THEN '{SEED}:n' ELSE '{SEED}:s' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM f, l),
k AS (
  SELECT doc_id, size, source_size, target, shift,
    CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) - 1 AS largest,
    (count(*) OVER (PARTITION BY d.source) + 1) // 2 AS half,
    CASE WHEN largest % 2 = 0 THEN half - 1 - largest // 2 ELSE half + largest // 2 END AS rank
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((floor((rank + 1) * rate + shift) - floor(rank * rate + shift)) * size)::BIGINT AS taken
FROM k
"""
