"""Readers and writers on files made here."""

import subprocess

import pytest

from tallyloom.operators import report, search
from tallyloom.sources import files


def test_registry_forms(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("works:\n- {work_id: ' w1 ', school: S, module_ids: [m1, '', m2]}\n- {work_id: w2, year: 2024, review_branch: dev}\n")
    (tmp_path / "b.yaml").write_text("- {work_id: w3}\n")
    got = report.registry(files.read_registry(spark, f"{tmp_path}/a.yaml")).orderBy("ord").collect()
    assert [(r["work_id"], r["year"], r["review_branch"], r["repository_type"], r["module_ids"]) for r in got] == [("w1", 0, "main", "competition", ["m1", "m2"]), ("w2", 2024, "dev", "competition", [])]
    assert files.read_registry(spark, f"{tmp_path}/b.yaml").count() == 1
    assert files.read_registry(spark, f"{tmp_path}/none.yaml").count() == 0


def test_cards(spark, tmp_path):
    rows = [
        '{"evidence_id": "E001", "kind": "source_span", "title": "t", "source": {"display_name": "s"}, "facts": []}',
        "",
        '{"evidence_id": "E002", "kind": "source_span", "title": "t", "source": {"display_name": "s"}, "table": {"columns": ["a", "b"], "rows": [["1"]]}}',
        '{"evidence_id": "E003", "kind": "git_commit", "title": "t", "source": {"display_name": "s"}, "raw_ref": {"path": "p"}}',
        '{"evidence_id": "E001", "kind": "search_result", "title": "t", "source": {"display_name": "s"}}',
    ]
    (tmp_path / "evidence.jsonl").write_text("\n".join(rows))
    got = sorted((r["evidence_id"], r["problem"]) for r in files.check_cards(files.read_cards(spark, f"{tmp_path}/evidence.jsonl")).collect())
    assert got == [("E001", "duplicate"), ("E001", "duplicate"), ("E002", "table"), ("E003", "raw_ref")]
    (tmp_path / "bad.jsonl").write_text("no json")
    with pytest.raises(Exception):
        files.read_cards(spark, f"{tmp_path}/bad.jsonl").collect()


def test_markdown_and_text_files(spark, tmp_path):
    (tmp_path / "modules").mkdir()
    (tmp_path / "modules/m.md").write_text("# T\nx")
    (tmp_path / "n.txt").write_bytes(b"a\nb\xffc")
    assert [r["text"] for r in files.read_markdown(spark, str(tmp_path)).collect()] == ["# T\nx"]
    lines = files.read_text_documents(spark, f"{tmp_path}/n.txt").orderBy("n").collect()
    assert [(r["n"], r["line"]) for r in lines] == [(1, "a"), (2, "b�c")]


def test_snapshots_replace_only_themselves(spark, tmp_path):
    at, form = f"{tmp_path}/cache", "work_id string, commit string, path string, blob string"
    files.write_snapshots(spark.createDataFrame([("a", "c", "p", "x"), ("b", "c", "p", "x")], form), at)
    files.write_snapshots(spark.createDataFrame([("a", "c", "p", "y")], form), at)
    assert sorted((r["work_id"], r["blob"]) for r in spark.read.parquet(at).collect()) == [("a", "y"), ("b", "x")]
    files.write_json_rows(spark.createDataFrame([(1,)], "v int"), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first()["v"] == 1


def test_git_trees(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    (repo / "src/é a.c").write_text("int main;")
    (repo / "top.md").write_text("# T")
    git = ["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x"]
    for args in (["init", "-q"], ["add", "."], ["commit", "-qm", "one"]):
        subprocess.run([*git, *args], check=True)
    tree = files.read_trees(spark, {"w": (str(repo), "HEAD")})
    assert sorted((r["path"], r["kind"], r["size"]) for r in tree.collect()) == [("src/é a.c", "blob", 9), ("top.md", "blob", 3)]
    assert [r["path"] for r in search.fingerprint_rows(tree).collect()] == ["src/é a.c"]
    blobs = files.read_trees(spark, {"w": (str(repo), "HEAD")}, content=True, suffixes=".c").collect()
    assert [bytes(r["data"]) for r in blobs] == [b"int main;"]


def test_git_readers(spark, tmp_path):
    from tallyloom.sources import git

    repo = str(tmp_path / "r")
    (tmp_path / "r").mkdir()
    run = lambda *args: subprocess.run(["git", "-C", repo, "-c", "user.name=A B", "-c", "user.email=e@x", *args], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    (tmp_path / "r/a b.c").write_text("one\n")
    run("add", ".")
    run("commit", "-qm", "first\n\nbody line\n")
    (tmp_path / "r/a b.c").write_text("one\ntwo\n")
    (tmp_path / "r/x.bin").write_bytes(b"\0\1\xff" * 50)
    run("add", ".")
    run("commit", "-qm", "second")
    head, tree = run("rev-parse", "HEAD"), run("rev-parse", "HEAD^{tree}")
    repos = {"w": (repo, "HEAD")}
    revisions = {r["work_id"]: r for r in git.read_revisions(spark, repos | {"v": (repo, "nowhere")}).collect()}
    assert (revisions["w"]["commit"], revisions["w"]["tree"]) == (head, tree) and revisions["v"]["problem"] == "no such revision"
    commits = {r["subject"]: r for r in git.read_commits(spark, repos).collect()}
    assert (commits["first"]["body"], commits["second"]["parents"], commits["second"]["author"]) == ("body line", commits["first"]["commit"], "A B")
    numbers = sorted((r["commit"] == head, r["path"], r["additions"], r["deletions"]) for r in git.read_numstat(spark, repos).collect())
    assert numbers == [(False, "a b.c", "1", "0"), (True, "a b.c", "1", "0"), (True, "x.bin", "-", "-")]
    objects = {r["object_id"]: r["path"] for r in git.read_history(spark, repos).collect()}
    assert objects[head] == "" and len(objects) == 7 and sorted(objects.values()) == ["", "", "", "", "a b.c", "a b.c", "x.bin"]
    assert git.read_text(repo, "HEAD", "a b.c") == "one\ntwo\n" and git.read_text(repo, "HEAD", "x.bin").startswith("\0\1")
    with pytest.raises(ValueError):
        git.read_blob(repo, "HEAD", "a b.c", most=3)
    blob = run("rev-parse", "HEAD:a b.c")
    assert list(git.read_objects(repo, [blob, "0" * 40, blob])) == [(blob, b"one\ntwo\n"), ("0" * 40, None), (blob, b"one\ntwo\n")]
    works = spark.createDataFrame([("w", "r"), ("n", "none"), ("p", ".")], "work_id string, canonical_dir string")
    assert sorted(tuple(r) for r in git.repo_states(spark, works, str(tmp_path)).collect()) == [("n", False, False), ("p", True, False), ("w", True, True)]


def test_written_tables_are_removed(spark):
    from tallyloom.operators import cuts

    kept = cuts.durable(spark.range(3), "three")
    assert kept.count() == 3 and cuts.discard(spark) >= 1 and cuts.discard(spark) == 0
