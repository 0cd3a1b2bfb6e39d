"""Search by postings: the same hits as by reading everything, from far fewer files."""

import random
import re

import pytest

from tallyloom.operators import capture, postings

FORM = "work_id string, display_name string, commit string, path string, object_hash string, text string"


def blobs(spark):
    rng = random.Random(6)
    words = ["token", "password", "AKIA", "schedule", "page_table", "fn main", "été", "a+b", "x"]
    rows = [(f"w{w}", "Work", "c", f"f{k}.c", "h", "\n".join(" ".join(rng.choice(words[: rng.choice([2, 9])]) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(6))) or None) for w in range(3) for k in range(40)]
    return rows, spark.createDataFrame(rows, FORM)


PATTERNS = ["token", "AKIA|page_table", "fn main.*été", "a\\+b", "tok(en)? pass", "x", "schedul?e", "[tT]oken x", "(?i)TOKEN", "nowhere at all", "été", "page_+table", "to{1,2}ken", "AKIA|x", "^token$", "pass\\word"]


def test_the_same_cards(spark):
    rows, table = blobs(spark)
    asked = [(i * 3 + w, "t", f"w{w}", "c", p, ["f1.c", "f2.c"] if i % 5 == 4 else None) for i, p in enumerate(PATTERNS) for w in range(3)]
    requests = spark.createDataFrame(asked, "n long, title string, work_id string, commit string, pattern string, paths array<string>")
    index = postings.postings(table).persist()
    want = sorted(map(str, capture.search_cards(requests, table).collect()))
    assert sorted(map(str, capture.search_cards(requests, table, index).collect())) == want
    few = postings.postings(table, postings.grams_of(PATTERNS))
    assert sorted(map(str, capture.search_cards(requests, table, few).collect())) == want and few.count() < index.count()
    read = {(r.n, r.path) for r in postings.candidate_files(requests, index, table).collect()}
    held = {(n, path) for n, _, w, _, p, _ in asked for v, _, _, path, _, text in rows if v == w and any(re.search(p, line) for line in (text or "").split("\n"))}
    assert held <= read
    free = [n for n, _, _, _, p, _ in asked if postings.required(p) is None]
    assert len([r for r in read if r[0] not in free]) < 0.5 * 40 * (len(asked) - len(free))
    assert not {n for n, _ in read} & {n for n, _, _, _, p, _ in asked if p == "nowhere at all"}


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        ("token", [["token"]]), ("AKIA|page", [["AKIA"], ["page"]]), ("ab", None), ("abcd|xy", None), ("foo.*bar", [["foo", "bar"]]), ("fooo*bar", [["foo", "bar"]]), ("fooo?", [["foo"]]), ("foo{0,2}bar", [["bar"]]), ("abc+def", [["abc", "def"]]),
        ("a\\.b\\.c", [["a.b.c"]]), ("foo\\dbar", [["foo", "bar"]]), ("[abc]def", [["def"]]), ("[]x]def", [["def"]]), ("(abc|x)def", [["def"]]), ("(a\\)b)cde", [["cde"]]), ("(?i)abc", None), ("\\x41abc", None), ("", None), ("a|", None), ("foo{", None), ("[a[bc]]def", None),
    ],
)
def test_what_a_hit_must_hold(pattern, literals):
    assert postings.required(pattern) == literals


def test_long_texts_and_none(spark):
    table = spark.createDataFrame([("w", "W", "c", "a", "h", "ab" * 400_000), ("w", "W", "c", "b", "h", None), ("w", "W", "c", "d", "h", "ab")], FORM)
    assert {(r.gram, r.path) for r in postings.postings(table).collect()} == {("aba", "a"), ("bab", "a")}
