"""Registered queries serve every row of their tables, late ones too."""

import pytest

from tallyloom.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    """Write a table under the name its relation reads, and return the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_commits_of_every_id(spark, tables):
    events = [(n, n % 3, "push", "x" * (n % 4)) for n in range(4990, 5040)]
    at = tables("events", events, "event_id long, user_id long, event_type string, props string")
    got = registry.QUERIES["commit_meta"](spark, at).collect()
    name = {r["n"]: r["c"] for r in spark.range(4980, 5050).selectExpr("id AS n", "sha2('e' || CAST(id AS STRING), 256) AS c").collect()}
    want = {name[n]: name[n - 1 - n % 3] if n - 1 - n % 3 >= 4990 else "" for n, *_ in events}  # a commit's own parent
    assert len(got) == len(events) and {r["commit"]: r["parent"] for r in got} == want


def test_stream_of_every_card(spark, tables):
    talks = [(conv, turn, "user", f"text {conv}") for conv in range(300) for turn in range(6)]
    at = tables("conversations", talks, "conv_id long, turn int, role string, text string")
    got = {r["n"]: (r["signature"], r["evidence_id"]) for r in registry.QUERIES["evidence_stream"](spark, at).collect()}
    seen = {}
    for r in sorted(registry.QUERIES["evidence_signature"](spark, at).collect(), key=lambda r: r["n"]):
        seen.setdefault(r["signature"], r["n"])
    want = {n: (s, f"E{k:03d}") for k, (s, n) in enumerate(seen.items(), 1)}
    assert max(want) > 2000 and got == want


def test_locks_of_every_work(spark, tables):
    parts = [(n, n % 3, "name", "brand", "type") for n in range(1, 151)]
    at = tables("part", parts, "p_partkey long, p_size int, p_name string, p_brand string, p_type string")
    got = sorted(tuple(r) for r in registry.QUERIES["base_lock"](spark, at).select("subject", "code", "detail").collect())
    refs = [(str(n), "base.target_ref_mismatch", "r2") for n in range(1, 151, 2)]
    commits = [(str(n), "base.target_commit_mismatch", ["abc", "", "ABCDEF1"][n % 3]) for n in range(1, 151) if n % 3]
    assert got == sorted(refs + commits)
