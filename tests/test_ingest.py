"""The evidence stream: state that outlives a killed run, ids that go on, cards that come with an id."""

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import ingest

CARDS = "n long, body string, evidence_given string"
LOG = "n long, signature string, evidence_id string, batch int"


def write(spark, folder, rows):
    spark.createDataFrame(rows, CARDS).coalesce(1).write.mode("append").json(f"{folder}/in")


def stream(spark, folder, after=None):
    cards = ingest.reader(spark, spark.createDataFrame([], CARDS).schema).json(f"{folder}/in")
    ingest.start(cards, folder, F.sha2("body", 256), "n", after).awaitTermination()


def log(spark, folder):
    return sorted((r.n, r.evidence_id) for r in ingest.log_of(spark, folder, LOG).collect())


DELIVERIES = [[(k, f"b{k % 7}", None) for k in range(1, 20)], [(k, f"b{k % 11}", None) for k in range(20, 60)], [(k, f"b{k % 3}", None) for k in range(60, 70)], [(k, f"c{k}", None) for k in (73, 71, 72)]]


def plain(deliveries):
    seen = set()
    kept = [n for rows in deliveries for n, body, _ in sorted(rows) if body not in seen and not seen.add(body)]
    return sorted((n, f"E{k:03}") for k, n in enumerate(kept, start=1))


WANT = plain(DELIVERIES)


def test_one_pass(spark, tmp_path):
    for rows in DELIVERIES:
        write(spark, tmp_path, rows)
        stream(spark, str(tmp_path))
    assert log(spark, str(tmp_path)) == WANT


@pytest.mark.parametrize("step", ["log", "mark"])
@pytest.mark.parametrize("at", [0, 1, 3])
def test_a_killed_run_gives_the_same_log(spark, tmp_path, at, step):
    """Killed after the batch's rows were written, or after its mark was but before the checkpoint knew."""
    killed = []

    def kill(batch, done):
        if batch == at and done == step and not killed:
            killed.append(batch)
            raise RuntimeError("killed")

    for rows in DELIVERIES:
        write(spark, tmp_path, rows)
        before = len(killed)
        try:
            stream(spark, str(tmp_path), kill)
        except Exception as error:
            assert "killed" in str(error)
        if len(killed) > before:
            stream(spark, str(tmp_path), kill)
    assert killed and log(spark, str(tmp_path)) == WANT


def test_a_batch_reads_no_log(spark, tmp_path):
    """The rows of earlier batches can go: neither state nor numbers rest on them."""
    write(spark, tmp_path, DELIVERIES[0])
    stream(spark, str(tmp_path))
    for f in (tmp_path / "log" / "batch=0").iterdir():
        f.unlink()
    write(spark, tmp_path, DELIVERIES[1])
    stream(spark, str(tmp_path))
    assert log(spark, str(tmp_path)) == [(n, e) for n, e in WANT if 20 <= n < 60]


def test_given_ids_stay_and_others_go_on_from_them(spark, tmp_path):
    write(spark, tmp_path, [(1, "a", "E998"), (2, "b", None), (3, "a", None)])
    stream(spark, str(tmp_path))
    write(spark, tmp_path, [(4, "b", "E777"), (5, "c", None)])
    stream(spark, str(tmp_path))
    assert log(spark, str(tmp_path)) == [(1, "E998"), (2, "E999"), (5, "E1000")]


def test_nothing_yet(spark, tmp_path):
    assert log(spark, str(tmp_path)) == []
