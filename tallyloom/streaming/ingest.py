"""Evidence ingestion as a stream: cards in, a deduplicated log with running ids out.

Signatures that were seen live in the stream's state store, keyed by signature (`_unseen`), so a
batch costs what its own cards cost, however long the log is. The number that the log has reached
is kept beside it, one row a batch (`marks`), so a batch reads one row of the one before and nothing
of the log. Every batch is written under its own number and replaces what an earlier attempt of the
same batch left; the state goes back with the checkpoint, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tallyloom.operators import evidence
from tallyloom.operators.cuts import fresh_path
from tallyloom.operators.search import in_order


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)


def log_of(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The log so far: the batches that have a mark."""
    try:
        done = spark.read.schema("batch int, last long").parquet(f"{folder}/marks").select("batch")
        return spark.read.schema(schema).parquet(f"{folder}/log").join(done, "batch", "left_semi")
    except Exception as none:  # no batch has been written yet
        if not _missing(none):
            raise
        return spark.createDataFrame([], schema)


def _last(spark: SparkSession, folder: str, batch: int) -> int:
    """The number that the log had reached before a batch."""
    if batch == 0:
        return 0
    return spark.read.schema("last long").parquet(f"{folder}/marks/batch={batch - 1}").first()["last"]


def _unseen(arrival: str) -> Callable:
    """The first card of a signature that no batch had before; its evidence_id, if it came with one, stays."""

    def first(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        rows = pd.concat(frames)
        if not state.exists:
            state.update((True,))
            yield rows.sort_values(arrival, kind="stable").head(1)[["signature", arrival, "evidence_id"]]

    return first


def start(cards: DataFrame, folder: str, signature: Column, arrival: str, after: Callable[[int, str], None] | None = None) -> StreamingQuery:
    """Start the query that appends a stream of cards to the log in `folder`; it stops when all is read.

    `arrival` is a whole number; ids follow it within a batch, and batches follow each other. Cards with an
    `evidence_given` keep that id, and later ids go on from the largest. `after` is told of each step of a batch
    ("log", "mark") once it is done.
    """
    spark = cards.sparkSession
    given = F.col("evidence_given") if "evidence_given" in cards.columns else F.lit(None).cast("string")
    keyed = cards.select(signature.alias("signature"), F.col(arrival).cast("long").alias(arrival), given.alias("evidence_id"))
    new = keyed.groupBy("signature").applyInPandasWithState(_unseen(arrival), f"signature string, {arrival} long, evidence_id string", "seen boolean", "append", GroupStateTimeout.NoTimeout)

    def append(batch: DataFrame, number: int) -> None:
        last = _last(spark, folder, number)
        at = f"{folder}/log/batch={number}"
        held = F.substring("evidence_id", 2, 20).try_cast("long")
        batch = batch.persist()  # the state advances once a batch
        try:
            top = batch.agg(F.max(held)).first()[0]
            base = max(last, top or 0)
            fresh = in_order(batch.where("evidence_id IS NULL").drop("evidence_id"), [F.col(arrival), F.col("signature")])
            fresh = fresh.select(arrival, "signature", evidence.numbered(F.lit(base) + F.col("place")).alias("evidence_id"))
            fresh.unionByName(batch.where("evidence_id IS NOT NULL").select(arrival, "signature", "evidence_id")).write.mode("overwrite").parquet(at)
            if after:
                after(number, "log")
            count = spark.read.schema(f"{arrival} long, evidence_id string").parquet(at).agg(F.max(held).alias("last"))
            count.select(F.coalesce("last", F.lit(base).cast("long")).alias("last")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")
            if after:
                after(number, "mark")
        finally:
            batch.unpersist()

    return new.writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def deliveries(cards: DataFrame, folder: str, arrival: str, files: int) -> Iterator[int]:
    """Write cards as JSON lines in `files` deliveries, in order of arrival; after each it is the caller's turn."""
    edges = cards.approxQuantile(arrival, [k / files for k in range(1, files)], 0.01)
    part = F.coalesce(sum(((F.col(arrival) > e).cast("int") for e in edges), F.lit(0)), F.lit(0))
    for k in range(len(edges) + 1):
        cards.where(part == k).write.mode("append").json(f"{folder}/in")
        yield k


def reader(spark: SparkSession, schema: StructType) -> DataStreamReader:
    return spark.readStream.schema(schema)


def run_once(cards: DataFrame, signature: Column, arrival: str = "n", files: int = 3) -> DataFrame:
    """Stream cards into a new log, delivery by delivery, and return it.

    A delivery is read to its end before the next is written, so ids follow arrival and not the age of files; each
    starts the query anew from its checkpoint.
    """
    spark = cards.sparkSession
    folder = fresh_path(spark, "evidence")
    for _ in deliveries(cards, folder, arrival, files):
        start(reader(spark, cards.schema).json(f"{folder}/in"), folder, signature, arrival).awaitTermination()
    return log_of(spark, folder, f"{arrival} long, signature string, evidence_id string, batch int").select(arrival, "signature", "evidence_id")
