"""Operators 11 to 13 against plain versions of what they must give."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from tallyloom.llm import pii, spelling
from tallyloom.llm.sessions import MINUTE, Rule, sessions

# ---------------------------------------------------------------- operator 11


def plain_personal(t: str | None) -> tuple[list[int], str]:
    t, out = t or "", []
    out += [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    names = ["email", "ip", "card", "phone"]
    return [sum(k == i for k, _, _ in out) for i in range(4)], hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for k, a, b in sorted(out)).encode()).hexdigest()


AWKWARD = [
    None, "", "@", "a@b", "a@b@c.de", "x a.b@c-d.e.f. y", "..@a.b@c.d", "a@b..c", "é@ü.de a@b.cé", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004",
    "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111  1111", "1 2 3 4 5 6 7 8 9 0 1 2 3", "+1 (988) 555-2485.", "+1((((((", "+49 30 1234567 und +4930", "+1.2.3.4.5.6.7.8.9.0",
    "4111111111111111@mail.com", "+4111111111111111", "\U0001f600 a@b.de \U0001f600 1.1.1.1",
]


def test_personal_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(5)
    texts = AWKWARD + ["".join(rng.choice("1234 .-+@a(b)\n") for _ in range(rng.randrange(60))) for _ in range(1500)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, SPANS string")
    got = {r.doc_id: r for r in pii.personal_spans(docs, "text").collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        n, sha = plain_personal(t)
        assert ([got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone], got[k].base_sha256) == (n, sha), t


def test_personal_method_adds_spans_and_leaves_clean_texts(spark):
    rng = random.Random(1)
    fill = "the river went on past fields and mills until evening came"
    kinds = {
        "name": ["Dear Mr. John Smith, thanks", "my name is Anna Keller today", "patient name: Robert Brown was here"],
        "phone_local": ["please call 030 1234 5678 now", "telephone (0711) 555 1234 always"],
        "ssn": ["social security 123-45-6789 is mine"],
        "iban": ["iban DE89 3704 0044 0532 0130 00 please"],
        "email_spelled": ["write to jo.doe (at) example (dot) com soon"],
    }
    rows, want = [], {}
    for k in range(600):
        kind = rng.choice([*kinds, None, None, None])
        said = rng.choice(kinds[kind]) if kind else rng.choice(["GNU General Public License, version 3.", "order 123-45 page 0123", "The River Went away", "build 4.0.1 of 2024-01-05"])
        rows.append((k, f"{fill} {said} {fill}"))
        want[k] = kind
    got = {r.doc_id: r.spans for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()}
    for k, kind in want.items():
        assert [x.split(":")[0] for x in got[k].split(",") if x] == ([kind] if kind else []), rows[k]


def test_personal_reliabilities_find_the_bad_labeler():
    rng = random.Random(2)
    counts: Counter = Counter()
    for _ in range(20_000):
        true = rng.random() < 0.3
        votes = [rng.random() < (p if true else 1 - p) for p in (0.95, 0.9, 0.8, 0.5)]  # three that know something, or rates can't be told
        counts[6, pii._mixed([pii.YES if v else pii.NO for v in votes] + [pii.NOTHING], [3] * 5)] += 1
    share, right = pii.reliabilities(dict(counts))
    assert abs(share[6] - 0.3) < 0.03
    assert right[6, 0].min() > 0.92 and right[6, 1].min() > 0.87 and abs(right[6, 2] - 0.8).max() < 0.03 and abs(right[6, 3] - 0.5).max() < 0.03


def test_personal_empty_table_and_long_texts(spark):
    assert pii.personal_spans(spark.createDataFrame([], "doc_id long, text string"), "text").count() == 0
    n = 3_000_000
    texts = ["a" * n + "@", "1" * n, "1 " * n, "+1" + "(" * n, "1." * n, "@a" * n, "Ab " * (n // 3)]
    for t in texts:
        pii.candidates(t)  # in time in proportion to the text


# ---------------------------------------------------------------- operator 12


def plain_sessions(rows: list[tuple], rule: Rule) -> set[tuple]:
    """rows: (click_id, ts, arrived_at, client_id, kind, value) with times in microseconds."""
    once: dict = {}
    for click, ts, arrived, client, kind, value in rows:
        if None not in (click, ts, client):
            late = arrived is not None and arrived - ts > rule.late
            final = kind == rule.final_kind and value is not None and value >= rule.final_value
            row = (ts, client, late, final, int((100 * value + 0.5) // 1) if value is not None else 0)
            once[click] = min(once.get(click, row), row)
    clients = defaultdict(list)
    for click, (ts, client, late, final, cents) in once.items():
        clients[client].append((ts, click, late, final, cents))
    out = set()
    for client, own in clients.items():
        timely, made = sorted(r for r in own if not r[2]), []
        for r in timely:
            why = "new"
            if made:
                last = made[-1]["rows"][-1]
                why = "end" if last[3] else "gap" if r[0] - last[0] >= rule.gap else "length" if r[0] - made[-1]["rows"][0][0] > rule.length else None
                if why:
                    made[-1]["why"] = why
            if why:
                made.append({"rows": [], "why": None})
            made[-1]["rows"].append(r)
        for k, s in enumerate(made):
            first, last = s["rows"][0], s["rows"][-1]
            upto = made[k + 1]["rows"][0][0] if k + 1 < len(made) else float("inf")
            n_late = sum(r[2] and first[0] <= r[0] < upto for r in own)
            path = hashlib.sha256(",".join(str(r[1]) for r in s["rows"]).encode()).hexdigest()
            out.add((client, first[1], first[0], last[0], len(s["rows"]), n_late, sum(r[4] for r in s["rows"]), s["why"] or ("end" if last[3] else "none"), path))
    return out


def _frame(spark, rows: list[tuple]):
    at = lambda us: None if us is None else datetime(1970, 1, 1) + timedelta(microseconds=us)
    return spark.createDataFrame([(c, at(t), at(a), i, k, v, "x") for c, t, a, i, k, v in rows], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, part string")


def _clicks(seed: int, n: int, hot: bool) -> list[tuple]:
    rng, rows, now = random.Random(seed), [], 1_700_000_000_000_000
    for k in range(n):
        now += rng.choice([0, 1, rng.randrange(1, 4 * MINUTE), 40 * MINUTE if rng.random() < 0.1 and not hot else MINUTE])
        arrived = None if rng.random() < 0.02 else now + rng.choice([MINUTE, 60 * MINUTE, 60 * MINUTE + 1, 90 * MINUTE] if rng.random() < 0.2 else [0])
        kind = rng.choice(["purchase", "view", None]) if not hot or rng.random() < 0.003 else "view"
        row = (rng.randrange(10**6) if rng.random() < 0.98 else None, now, arrived, 7 if hot or rng.random() < 0.5 else rng.choice([None, 1, 2, 3]), kind, rng.choice([None, 59.99, 60.0, 61.005, -3.0]))
        rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("parts", [5, 60])
def test_sessions(spark, hot, parts):
    """With 60 ranges over a client that is never idle, whole tasks have no certain start."""
    rows = _clicks(parts, 900, hot)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rule in (Rule(), Rule(length=7 * MINUTE), Rule(length=3 * MINUTE, final_value=1e9)):
            got = [tuple(r) for r in sessions(_frame(spark, rows), rule).collect()]
            assert len(got) == len(set(got))
            assert set(got) == plain_sessions(rows, rule)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sessions_of_nothing_and_of_late_clicks_only(spark):
    assert sessions(_frame(spark, [])).count() == 0
    assert sessions(_frame(spark, [(1, 10**15, 2 * 10**15, 4, "view", 1.0), (2, None, None, 4, "view", 1.0)])).count() == 0


# ---------------------------------------------------------------- operator 13


def plain_variants(rows: list[tuple]) -> dict:
    counts: Counter = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            counts[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            if (d := w[:k] + w[k + 1 :]) in words:
                near[w].add(d), near[d].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: f for w in words if near[w] and words[f := min(near[w], key=lambda x: (-words[x], x))] >= 10 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, form.get(w), root, len(near[w]), words[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("block", [2, 5, 128])
def test_spelling(spark, monkeypatch, block):
    """Words over few letters, so that runs repeat and blocks are split to their leaves."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    pool = ["".join(rng.choice("abÉé") for _ in range(rng.choice([7, 7, 8, 8, 9, 12, 25]))) for _ in range(300)]
    pool += [w[:k] + w[k + 1 :] for w in pool for k in (0, len(w) - 1, len(w) // 2)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    rows = [(k, " ".join(rng.choice(pool[: rng.choice([5, 50, 1200])]) for _ in range(rng.randrange(60))).replace("a", rng.choice(["a", "A"]), 3)) for k in range(300)]
    rows += [(None, "Straßenbahn Straßenbahn strassenbahn"), (1, None), (2, ""), (3, "x" * 200_000 + " short " + "Ÿabcdefgh abcdefgh" * 3)] + rows[:20]
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    want = plain_variants(rows)
    got = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in spelling.variant_forms(spelling.word_counts(docs, "doc_id", "text")).collect()}
    assert got == want
    assert sum(x[3] for x in want.values()) > 500 and any(x[1] for x in want.values())


def test_spelling_slices_end_between_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 50)
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("abcdefgh ,\n") for _ in range(3000))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.word_counts(docs, "doc_id", "text").collect()}
    assert got == {w: x[0] for w, x in plain_variants(rows).items()}


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_forms(spelling.word_counts(none, "doc_id", "text")).count() == 0
