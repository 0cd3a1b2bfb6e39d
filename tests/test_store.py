"""The snapshot store: builds in two phases, only what lacks, blobs alone, other shape versions."""

import hashlib

import pytest

from tallyloom.operators import store

FILES = [("a", "p1", "b1"), ("a", "p0", "b2"), ("a", "p0", "b2"), ("b", "q", "b1"), ("c", "r", "b9")]
UNITS = [("a", "p1", "f", 3, "s1"), ("b", "q", "g", 1, "s2")]


def frames(spark, files=FILES):
    return spark.createDataFrame(files, store.ROWS["blob"]), spark.createDataFrame(UNITS, store.ROWS["ast"])


def heads(spark, **commits):
    return spark.createDataFrame(list(commits.items()), "work_id string, commit string")


def seen(spark, at, wanted, component="blob"):
    return sorted(tuple(r)[:3] for r in store.rows_of(spark, at, component, wanted).select("work_id", "path", "blob" if component == "blob" else "shape").collect())


def test_only_what_lacks_is_built(spark, tmp_path):
    at, (files, units) = str(tmp_path), frames(spark)
    assert store.build(spark, at, heads(spark, a="1", b="1"), files, units) == 2
    first = store.visible(spark, at, heads(spark, a="1")).first()
    assert (first.files, first.units, first.digest) == (3, 1, hashlib.sha256(b"p0\0b2\np0\0b2\np1\0b1").hexdigest())
    assert store.build(spark, at, heads(spark, a="1", b="1", c="1", d="1"), files, units) == 2
    assert store.build(spark, at, heads(spark, a="1", b="1", c="1", d="1"), files, units) == 0
    every = heads(spark, a="1", b="1", c="1", d="1")
    assert seen(spark, at, every) == sorted(FILES) and seen(spark, at, every, "ast") == [("a", "p1", "s1"), ("b", "q", "s2")]
    empty = store.visible(spark, at, heads(spark, d="1")).first()
    assert (empty.files, empty.units, empty.digest) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert len(store.manifests(spark, at).select("build").distinct().collect()) == 2


def test_a_failure_between_the_phases_leaves_the_old_snapshot(spark, tmp_path):
    at, (files, units) = str(tmp_path), frames(spark)
    store.build(spark, at, heads(spark, a="1"), files, units)
    newer = spark.createDataFrame([("a", "new", "b7")], store.ROWS["blob"])

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        store.build(spark, at, heads(spark, a="2"), newer, units, between=fail)
    assert seen(spark, at, heads(spark, a="1")) == sorted(FILES)[:3] and seen(spark, at, heads(spark, a="2")) == []
    assert store.build(spark, at, heads(spark, a="2"), newer, units) == 1
    assert seen(spark, at, heads(spark, a="2")) == [("a", "new", "b7")] and seen(spark, at, heads(spark, a="1")) == sorted(FILES)[:3]
    assert store.sweep(spark, at) == 2 and seen(spark, at, heads(spark, a="2")) == [("a", "new", "b7")]


def test_blobs_alone_and_other_shape_versions(spark, tmp_path):
    at, (files, units) = str(tmp_path), frames(spark)
    assert store.build(spark, at, heads(spark, a="1", b="1"), files) == 2
    assert store.build(spark, at, heads(spark, a="1"), files) == 0
    assert seen(spark, at, heads(spark, a="1"), "ast") == []
    assert store.build(spark, at, heads(spark, a="1"), files, units, version="v1") == 1
    assert store.build(spark, at, heads(spark, a="1"), files, units, version="v2") == 1
    assert store.build(spark, at, heads(spark, a="1"), files, units, version="v1") == 0
    assert store.visible(spark, at, heads(spark, a="1"), ("blob", "ast"), "v2").first().ord == 2
    assert store.build(spark, at, heads(spark, b="1"), files) == 0


def test_nothing_built_and_two_commits_at_once(spark, tmp_path):
    files, units = frames(spark)
    assert store.visible(spark, str(tmp_path), heads(spark, a="1")).count() == 0
    with pytest.raises(ValueError, match="one commit"):
        store.build(spark, str(tmp_path), spark.createDataFrame([("a", "1"), ("a", "2")], "work_id string, commit string"), files, units)
