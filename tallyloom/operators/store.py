"""A store of snapshots that is built piece by piece and never seen half built.

A build has two phases under a number of its own. First the components of the works it covers are
written: fingerprint rows (`blob`) and, unless blobs are all that is asked for, structural units
(`ast`). Then their manifests are, and these alone make the snapshots visible. So a build that fails
anywhere leaves what was readable as it was, and what it has written is never read. A work is
built only if no manifest covers its commit with every component asked for, and with the present shape
version where shapes are among them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import results
from tallyloom.operators.cuts import durable
from tallyloom.operators.digests import ordered_digest

BLOB, AST = "blob", "ast"
ROWS = {BLOB: "work_id string, path string, blob string", AST: "work_id string, path string, symbol string, line long, shape string"}
MANIFEST = "work_id string, commit string, components array<string>, shape_version string, files long, units long, digest string, ord long, build string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as none:  # nothing has been built yet
        if "PATH_NOT_FOUND" not in str(none) and "UNABLE_TO_INFER_SCHEMA" not in str(none):
            raise
        return spark.createDataFrame([], schema)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all builds that were finished; `ord` tells which is newer."""
    return _read(spark, f"{path}/manifests", MANIFEST)


def lacking(spark: SparkSession, path: str, wanted: DataFrame, components: tuple[str, ...] = (BLOB, AST), version: str = results.SHAPE_VERSION) -> DataFrame:
    """The wanted (work_id, commit) pairs that no manifest covers."""
    pairs = wanted.select("work_id", "commit").distinct()
    return pairs.join(results.reusable(manifests(spark, path), pairs, version, components), ["work_id", "commit"], "left_anti")


def build(
    spark: SparkSession,
    path: str,
    wanted: DataFrame,
    files: DataFrame,
    units: DataFrame | None = None,
    version: str = results.SHAPE_VERSION,
    between: Callable[[], None] | None = None,
) -> int:
    """Build what the store lacks of the wanted (work_id, commit) pairs; returns how many works were built.

    `files` has (work_id, path, blob), `units` (work_id, path, symbol, line, shape) of the wanted commits;
    without units blobs alone are built, as commits of a history need. One commit a work may be wanted at once. A
    wanted work without files gets an empty snapshot. `between` is called between the phases.
    """
    components = (BLOB,) if units is None else (BLOB, AST)
    todo = durable(lacking(spark, path, wanted, components, version), "lacking")
    n = todo.count()
    if not n:
        return 0
    if todo.groupBy("work_id").count().where("count > 1").limit(1).collect():
        raise ValueError("one commit of a work at a time")
    number = uuid.uuid4().hex
    for name, rows in ((BLOB, files), (AST, units)):
        if rows is not None:
            own = rows.join(todo.select("work_id"), "work_id", "left_semi").selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in ROWS[name].split(", ")])
            own.write.parquet(f"{path}/{name}/build={number}")
    made = _read(spark, f"{path}/{BLOB}/build={number}", ROWS[BLOB])
    counted = made.groupBy("work_id").agg(F.count(F.lit(1)).alias("files"))
    shaped = _read(spark, f"{path}/{AST}/build={number}", ROWS[AST]).groupBy("work_id").agg(F.count(F.lit(1)).alias("units"))
    digest = ordered_digest(made, "work_id", [F.col("path"), F.col("blob")], F.concat_ws("\0", "path", "blob"), "\n")
    last = manifests(spark, path).agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    full = todo.join(counted, "work_id", "left").join(shaped, "work_id", "left").join(digest, "work_id", "left")
    full = full.select(
        "work_id",
        "commit",
        F.array(*[F.lit(c) for c in components]).alias("components"),
        F.lit(version if AST in components else None).cast("string").alias("shape_version"),
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("units", F.lit(0)).alias("units"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"),
        F.lit(last + 1).cast("long").alias("ord"),
        F.lit(number).alias("build"),
    )
    full = durable(full, "manifests")  # all figures are there before any manifest is
    if between:
        between()
    full.coalesce(1).write.mode("append").parquet(f"{path}/manifests")
    return n


def visible(spark: SparkSession, path: str, wanted: DataFrame, components: tuple[str, ...] = (BLOB, AST), version: str = results.SHAPE_VERSION) -> DataFrame:
    """The newest usable manifest of each wanted (work_id, commit)."""
    every = manifests(spark, path)
    for c in components:
        every = every.where(F.array_contains("components", c))
    if AST in components:
        every = every.where(F.col("shape_version") == version)
    own = every.join(wanted.select("work_id", "commit").distinct(), ["work_id", "commit"], "left_semi")
    newest = own.groupBy("work_id", "commit").agg(F.max_by(F.struct("components", "shape_version", "files", "units", "digest", "ord", "build"), "ord").alias("m"))
    return newest.select("work_id", "commit", "m.*")


def rows_of(spark: SparkSession, path: str, component: str, wanted: DataFrame, version: str = results.SHAPE_VERSION) -> DataFrame:
    """(work_id, commit, ...) rows of a component for the wanted snapshots that the store shows."""
    shown = visible(spark, path, wanted, (component,), version).select("work_id", "commit", "build")
    held = _read(spark, f"{path}/{component}", f"{ROWS[component]}, build string")
    return held.join(shown, ["work_id", "build"]).drop("build")


def sweep(spark: SparkSession, path: str) -> int:
    """Remove what unfinished builds have left; returns how many. Not to be run while a build is."""
    known = {r.build for r in manifests(spark, path).select("build").distinct().collect()}  # a row for each build
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in (BLOB, AST):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = at.getFileSystem(conf)
        for f in fs.listStatus(at) if fs.exists(at) else ():
            if f.getPath().getName().startswith("build=") and f.getPath().getName()[6:] not in known:
                gone += bool(fs.delete(f.getPath(), True))
    return gone
