import hashlib
import random

from pyspark.sql import functions as F

from tallyloom.operators.digests import ordered_digest


def test_streams_give_the_digest_of_the_joined_lines(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None, ""]), rng.choice(["x", "é", "z", "Z", "\U0001f600"]) + str(rng.randrange(300)), rng.choice(["1", None, "ü"])) for _ in range(30_000)]
    table = spark.createDataFrame(rows, "g string, path string, body string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        for between in ("", "\n"):
            got = {r.g: r.digest for r in ordered_digest(table, "g", [F.col("path")], F.concat("path", F.coalesce("body", F.lit("-"))), between).collect()}
            for g in {r[0] for r in rows}:
                own = sorted(((p, p + (b or "-")) for k, p, b in rows if k == g), key=lambda x: (x[0].encode(), x[1].encode()))
                assert got[g] == hashlib.sha256(between.join(x for _, x in own).encode()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered_digest(table.where("false"), "g", [F.col("path")], F.col("path")).count() == 0


def test_null_lines_and_other_key_types(spark):
    table = spark.createDataFrame([(1, "b"), (1, None), (2, "x")], "g long, line string")
    got = {r.g: r.digest for r in ordered_digest(table, "g", [F.col("line")], F.col("line"), "|").collect()}
    assert got == {1: hashlib.sha256(b"|b").hexdigest(), 2: hashlib.sha256(b"x").hexdigest()}
