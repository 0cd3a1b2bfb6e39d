"""SHA-256 over the rows of a group in order, in memory that doesn't grow with the group.

A SHA-256 over an order can't be split, so a group's rows do pass one task, but as a stream: they
are sorted within the partition (which spills to disk) and fed to the hash batch by batch. The
same number of bytes is held for a group of ten rows and of ten billion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def ordered_digest(rows: DataFrame, group: str, order: list[Column], line: Column, between: str = "") -> DataFrame:
    """(group, digest): lower-case hex of the SHA-256 over each group's lines in order, `between` them. Null lines count as empty."""
    kind = rows.schema[group].dataType
    schema = StructType().add(group, kind).add("digest", StringType())
    keys = [f"__{k}" for k in range(len(order))]
    dealt = rows.select(F.col(group), *[c.alias(k) for c, k in zip(order, keys)], F.coalesce(line, F.lit("")).alias("__line"))
    dealt = dealt.repartition(group).sortWithinPartitions(group, *keys, "__line").select(group, "__line")
    gap = between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some, state, ended = None, False, hashlib.sha256(), []

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in ended], schema_type), pa.array([d for _, d in ended], pa.string())], [group, "digest"])
            ended.clear()
            return out

        schema_type = pa.null()
        for batch in batches:
            schema_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not some or key != now:
                    if some:
                        ended.append((now, state.hexdigest()))
                    now, some, state = key, True, hashlib.sha256()
                else:
                    state.update(gap)
                state.update(text.encode())
            if ended:
                yield give()
        if some:
            ended.append((now, state.hexdigest()))
            yield give()

    return dealt.mapInArrow(run, schema)
