"""Content search by trigram postings: only files that may hold a hit are read by a regular expression.

An index lists, for each trigram, the files that hold it (`postings`); it is written once a snapshot and used by every
search. Of each pattern the literals that every hit must hold are known (`required`), one set for each
branch of its alternatives. A branch's three rarest trigrams are looked up; files that hold them all are
candidates, and they alone are joined with their texts and split into lines. A pattern whose hits need no literal of three
characters reads all files of its commit, as before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Trigrams of a branch that are looked up, the rarest ones.
LOOKED_UP = 3
_SPECIAL = frozenset("\\[](){}.*+?^$|")


def required(pattern: str) -> list[list[str]] | None:
    """For each branch of a pattern the literals of three characters or more that its hits hold; None if a branch has none.

    Careful rather than clever: groups, classes and anything optional end a literal; flags give None. A line
    feed never lies in a hit, as lines are searched.
    """
    if "(?" in pattern or "\\Q" in pattern:
        return None
    branches: list[list[str]] = [[]]
    run, k = "", 0

    def close() -> None:
        nonlocal run
        if len(run) >= 3:
            branches[-1].append(run)
        run = ""

    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            following = pattern[k + 1 : k + 2]
            k += 2
            if following and not following.isalnum():
                run += following
            elif following in ("x", "u", "p", "P", "c", "0", "k", "N"):
                return None
            else:
                close()
        elif c == "[":
            close()
            k += 1 + (pattern[k + 1 : k + 2] == "^")
            k += pattern[k : k + 1] == "]"
            while k < len(pattern) and pattern[k] != "]":
                if pattern[k] == "[":  # a class within a class
                    return None
                k += 1 + (pattern[k] == "\\")
            k += 1
        elif c == "(":
            close()
            depth, k = 1, k + 1
            while k < len(pattern) and depth:
                if pattern[k] == "[":
                    return None
                depth += (pattern[k] == "(") - (pattern[k] == ")")
                k += 1 + (pattern[k] == "\\")
        elif c == "|":
            close()
            branches.append([])
            k += 1
        elif c in "*?{":
            run = run[:-1]
            close()
            k = (pattern.find("}", k) if c == "{" else k) + 1
            if not k:
                return None
        elif c == "+":
            close()
            k += 1
        elif c in _SPECIAL:
            close()
            k += 1
        else:
            run += c
            k += 1
    close()
    return branches if all(branches) else None


def grams_of(patterns: Iterable[str]) -> list[str]:
    """The trigrams that searches for these patterns can ask for."""
    return sorted({x[i : i + 3] for p in patterns for branch in required(p) or () for x in branch for i in range(len(x) - 2)})


def postings(blobs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(gram, work_id, commit, path): the distinct trigrams of each text, lines apart. Files without one aren't there.

    An index that is kept has all trigrams; one that is made for known patterns needs `only` theirs (`grams_of`).
    """
    n = F.char_length("text")
    chars = F.split("text", "")
    joined = lambda a, b: F.concat(a, b)
    grams = F.zip_with(F.zip_with(chars, F.slice(chars, F.lit(2), n), joined), F.slice(chars, F.lit(3), n), joined)  # in time in proportion to the text
    if only is None:
        held = F.array_distinct(grams)
    else:  # a scan for each of a few trigrams is far cheaper than all that a text has
        held = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(g)), F.lit(g)) for g in only]).cast("array<string>"))
    each = blobs.where(n >= 3).select("work_id", "commit", "path", F.explode(held).alias("gram")).where("gram IS NOT NULL")
    return each.where(~F.col("gram").contains("\n")).select("gram", "work_id", "commit", "path")


def wanted_grams(requests: DataFrame) -> DataFrame:
    """(n, work_id, commit, branch, gram) of requests (n, work_id, commit, pattern); requests that need no literal have a null gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, pattern in enumerate(batch.column(3).to_pylist()):
                branches = required(pattern) if pattern else None
                for b, literals in enumerate(branches or [None]):
                    grams = {x[i : i + 3] for x in literals for i in range(len(x) - 2)} if literals else {None}
                    rows += [(n, b, g) for g in sorted(grams, key=str)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["n", "work_id", "commit", "branch", "gram"])

    own = requests.select("n", "work_id", "commit", "pattern")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.mapInArrow(run, f"n {kinds['n']}, work_id string, commit string, branch int, gram string")


def candidate_files(requests: DataFrame, index: DataFrame, blobs: DataFrame) -> DataFrame:
    """(n, work_id, commit, path) of the files that may hold a hit of each request. Of `blobs` names alone are read."""
    asked = wanted_grams(requests)
    files = blobs.select("work_id", "commit", "path")
    free = asked.where("gram IS NULL").select("n", "work_id", "commit").distinct().join(files, ["work_id", "commit"])
    known = asked.where("gram IS NOT NULL")
    place = ["work_id", "commit"]
    used = index.join(known.select(*place, "gram").distinct(), [*place, "gram"], "left_semi")
    held = used.groupBy(*place, "gram").agg(F.count(F.lit(1)).alias("files"))
    rare = known.join(held, [*place, "gram"], "left").withColumn("files", F.coalesce("files", F.lit(0)))
    rare = rare.withColumn("rn", F.row_number().over(Window.partitionBy("n", "branch").orderBy("files", "gram"))).where(F.col("rn") <= LOOKED_UP)
    need = rare.groupBy("n", "branch").agg(F.count(F.lit(1)).alias("need"))
    met = rare.join(used, [*place, "gram"]).groupBy("n", "branch", *place, "path").agg(F.count(F.lit(1)).alias("met"))
    full = met.join(need, ["n", "branch"]).where("met = need").select("n", *place, "path").distinct()
    return free.select("n", *place, "path").unionByName(full)
