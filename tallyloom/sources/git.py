"""Readers of git repositories: revisions, commits with their numbers, reachable objects, single files.

Each takes {work_id: (repository, ref)} and reads one repository a task, where the executor sees its
folder. Output is streamed in batches, so a long history takes no more memory than a short one.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST_DIRECT = 5 << 20
REVISIONS = "work_id string, ref string, commit string, tree string, problem string"
COMMITS = "work_id string, commit string, parents string, author string, author_time string, committer string, commit_time string, subject string, body string"
NUMSTAT = "work_id string, commit string, path string, additions string, deletions string"
HISTORY = "work_id string, object_id string, path string"
_ROWS = 5000


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True, timeout=300).stdout


def _records(repo: str, end: bytes, *args: str) -> Iterator[bytes]:
    """Output of a command, record by record."""
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        rest = b""
        while chunk := run.stdout.read(1 << 20):
            *whole, rest = (rest + chunk).split(end)
            yield from whole
        if rest:
            yield rest
        error = run.stderr.read()
    if run.returncode:
        raise OSError(f"git {args[0]} in {repo}: {error.decode('utf-8', 'replace').strip()}")


def _each(spark: SparkSession, repos: dict[str, tuple[str, str]], schema: str, rows_of: Callable[[str, str, str], Iterator[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for work, repo, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: list[tuple] = []
                for row in rows_of(work, repo, ref):
                    held.append(row)
                    if len(held) == _ROWS:
                        yield _batch(held, names)
                        held = []
                if held:
                    yield _batch(held, names)

    listed = spark.createDataFrame([(w, repo, ref) for w, (repo, ref) in repos.items()], "work_id string, repo string, ref string")
    return listed.repartition(max(1, len(repos))).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def read_revisions(spark: SparkSession, repos: dict[str, tuple[str, str]]) -> DataFrame:
    """The commit and tree that each work's ref names; a ref that names none has a problem instead."""

    def rows(work: str, repo: str, ref: str) -> Iterator[tuple]:
        try:
            commit, tree = (_text(_git(repo, "rev-parse", "--verify", "--quiet", f"{ref}^{{{kind}}}")).strip() for kind in ("commit", "tree"))
            yield work, ref, commit, tree, ""
        except (subprocess.CalledProcessError, OSError):
            yield work, ref, None, None, "no such revision"

    return _each(spark, repos, REVISIONS, rows)


def read_commits(spark: SparkSession, repos: dict[str, tuple[str, str]]) -> DataFrame:
    """The commits that each work's ref reaches, with the eight fields that cards show."""

    def rows(work: str, repo: str, ref: str) -> Iterator[tuple]:
        for record in _records(repo, b"\x1e", "log", "--format=%H%x1f%P%x1f%an%x1f%aI%x1f%cn%x1f%cI%x1f%s%x1f%b%x1e", ref):
            fields = _text(record).lstrip("\n").split("\x1f", 7)
            if len(fields) == 8:
                yield work, *fields[:7], fields[7].strip()

    return _each(spark, repos, COMMITS, rows)


def read_numstat(spark: SparkSession, repos: dict[str, tuple[str, str]]) -> DataFrame:
    """Files that each commit changes, with lines added and deleted (`-` for binary files)."""

    def rows(work: str, repo: str, ref: str) -> Iterator[tuple]:
        commit = ""
        for line in _records(repo, b"\0", "log", "--format=%x00%x1e%H%x00", "--numstat", "-z", "--no-renames", ref):
            text = _text(line).lstrip("\n")
            if text.startswith("\x1e"):
                commit = text[1:]
            elif text.count("\t") == 2:
                additions, deletions, path = text.split("\t")
                yield work, commit, path, additions, deletions

    return _each(spark, repos, NUMSTAT, rows)


def read_history(spark: SparkSession, repos: dict[str, tuple[str, str]]) -> DataFrame:
    """Every object that any ref of a work reaches, with the path it was first seen under."""

    def rows(work: str, repo: str, ref: str) -> Iterator[tuple]:
        for line in _records(repo, b"\n", "rev-list", "--objects", "--all"):
            object_id, _, path = _text(line).partition(" ")
            if object_id:
                yield work, object_id, path

    return _each(spark, repos, HISTORY, rows)


def read_blob(repo: str, commit: str, path: str, most: int = MOST_DIRECT) -> bytes:
    """One file of a commit; a larger one than `most` bytes is an error."""
    size = int(_git(repo, "cat-file", "-s", f"{commit}:{path}"))
    if size > most:
        raise ValueError(f"{path} has {size} bytes, more than {most}")
    return _git(repo, "cat-file", "blob", f"{commit}:{path}")


def read_text(repo: str, commit: str, path: str, most: int = MOST_DIRECT) -> str:
    """One file of a commit as text, without bytes that are no UTF-8."""
    return read_blob(repo, commit, path, most).decode("utf-8", "ignore")


def read_objects(repo: str, ids: Iterator[str] | list[str]) -> Iterator[tuple[str, bytes | None]]:
    """Contents of many objects from one process, in order; None for one that is missing."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
        for object_id in ids:
            run.stdin.write(object_id.encode() + b"\n")
            run.stdin.flush()
            head = run.stdout.readline().split()
            if len(head) < 3:
                yield object_id, None
                continue
            data = run.stdout.read(int(head[2]))
            run.stdout.read(1)
            yield object_id, data
        run.stdin.close()


def repo_states(spark: SparkSession, works: DataFrame, root: str) -> DataFrame:
    """(work_id, there, has_git) of the directories that works (work_id, canonical_dir) name below a folder."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [os.path.join(root, d or "") for d in batch.column(1).to_pylist()]
            there, has = [os.path.isdir(p) for p in at], [os.path.exists(os.path.join(p, ".git")) for p in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(there), pa.array(has)], ["work_id", "there", "has_git"])

    return works.select("work_id", "canonical_dir").mapInArrow(run, "work_id string, there boolean, has_git boolean")
