"""Shared pieces of the corpus operators: words, tables, durable cuts, distributed ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tallyloom.operators.cuts import durable, fresh_path, shared_dir  # noqa: F401  (for the operators)

#: The six ASCII blanks that separate words (\x20, \x09-\x0D), and the word pattern they leave.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    blank = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(blank, " "), "")


def n_words(text: Column) -> Column:
    """The number of words of a text (long), without building the array: each word is made one character, blanks none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.octet_length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages by bytes, unless the session already does.

    A batch of ten thousand long documents would not fit a Python worker's memory.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        now = "".join(c for c in str(now) if c.isdigit()) if now and str(now).isdigit() else None
        if now is None or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))


def add_columns(docs: DataFrame, text: str, new: dict[str, DataType], run: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """Add columns worked out from a text column, in Arrow batches; columns that bear the new names are replaced.

    `run` gets the texts of up to 2,000 rows, some 4 million code points or a single longer text at once.
    """
    small_batches(docs.sparkSession)
    names = {n.lower() for n in new}
    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in names]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in _runs(batch.column(at)):
                some = batch.slice(k, n)
                made = run(some.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in kept), *made], [*(some.schema.names[i] for i in kept), *new])

    schema = StructType([docs.schema.fields[i] for i in kept])
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(each, schema)


def _runs(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts with about `most` bytes each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first, n = 0, 0
    for k, size in enumerate(sizes):
        if k > first and n + size > most:
            yield first, k - first
            first, n = k, 0
        n += size
    if first < len(sizes):
        yield first, len(sizes) - first


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str, n: int | None = None) -> DataFrame:
    """Add the 0-based rank of each row in its group, by `order`, without a task that holds a group.

    Rows are dealt by range of (group, order), so a hot group spans as many partitions as it
    needs; the rank is the count of the group's rows in earlier partitions plus the place in its
    own. What goes through one window is a row for each (partition, group) pair.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in group]
    parts = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = durable(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    first = dealt.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    first = first.select(F.col("__part").alias("__p"), "__base", *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)])
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    out = dealt.join(first, same)
    return out.withColumn(rank, F.col("__at") + F.col("__base")).drop("__at", "__part", "__p", "__base", *[f"__g{i}" for i in range(len(group))])


#: A key is hot if it holds more than one in so many of all rows; so there are fewer hot keys than this.
HOT = 2000


def by_key(rows: DataFrame, known: DataFrame, key: str, n: str) -> DataFrame:
    """`rows` with what `known` (a written table, one row a key) says of their key; its column `n` is the rows of a key.

    What is known of hot keys, under `HOT` rows whatever the tables' sizes, is broadcast, so the rows
    of a hot key stay where they are; all others meet by a shuffle.
    """
    most = (known.agg(F.sum(n)).first()[0] or 0) / HOT
    hot = F.broadcast(known.where(F.col(n) > most).drop(n))
    rest = rows.join(hot, key, "left_anti").join(known.where(F.col(n) <= most).drop(n), key)
    return rows.join(hot, key).unionByName(rest)


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add, for each (name, column) in `sums`, the sum of the column over all rows before this one in `order`.

    As in `ranked`, rows are dealt by range; sums within a partition are added to those of the partitions before.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = durable(dealt, "running").withColumn("__part", F.shiftright("__at", 33))
    total = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums.values())])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = total.select("__part", *[F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(n) for n, c in sums.items()]).join(base, "__part")
    return out.withColumns({n: F.col(n) + F.col(f"__b{i}") for i, n in enumerate(sums)}).drop("__at", "__part", *[f"__b{i}" for i in range(len(sums))])
