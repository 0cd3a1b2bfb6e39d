"""Secret scans in built-in expressions only: patterns, and entropy of sliding windows.

Spark has no function that gives all match positions, so a text is split by the pattern and the
matches are extracted; running sums of their lengths are the positions (code points). Running values
over a row's array are worked out in about sqrt(n) groups of sqrt(n) entries (`_scan`), so a text
with a hundred thousand matches takes seconds. Patterns run only on texts that pass a cheap guard.

The entropy method looks at runs of key-like characters that hold both a digit and a letter. A
window of `WINDOW` characters slides over the run; the counts of its characters are kept, and the
sum of c * log2(c) over them changes with the one count that a character leaving or entering
changes, so the entropy log2(W) - sum / W costs a constant for each step. A run is a secret if its
richest window reaches the threshold of its character class, no allow-list pattern fits it and no
base span overlaps it.

Defined results: null text counts as empty and has no spans (the SHA-256 is that of the empty
string); repeated rows are scanned each on its own; nothing is dropped, whatever the text's length;
columns of the input that bear the names of `with_spans`'s results are replaced.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
RUN, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Character classes of runs, narrowest first, and the least entropy in bits of a run's richest window. A window of
#: 20 random characters of the class lies above it at least 99 times in 100.
CLASSES = (
    ("^([0-9a-f]+|[0-9A-F]+)$", 2.8),
    ("^([0-9a-z]+|[0-9A-Z]+)$", 3.3),
    ("^[0-9A-Za-z]+$", 3.5),
    ("", 3.5),
)
#: A word, number or name in camel case, as identifiers and paths are made of.
_PLAIN = "(([A-Z]?[a-z]+([A-Z][a-z]+)*|[A-Z]+)[0-9]{0,4}|[0-9]+)"
#: Runs that are no secrets: UUIDs, dates and times, hash names, and plain parts joined to identifiers or whole paths.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^(sha1|sha256|sha384|sha512|md5)[-_=]",
    rf"^[-_/=]*{_PLAIN}([-_/=]+{_PLAIN})*[-_/=]*$",
)
_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: Characters of a run whose windows are worked out together.
_PART = 1024
_SPANS = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _kind(name: str) -> Column:
    return F.lit(KINDS.index(name))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, as a lambda's variable (a column named in a lambda may be worked out for each entry)."""
    return F.transform(F.array(value), use)[0]


def _scan(xs: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array of whole numbers, what the entries before each come to (exclusive scan), in sqrt(n) groups."""
    start = F.struct(F.lit(zero).alias("total"), F.array().cast("array<int>").alias("before"))

    def run(entries: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(entries, start, lambda a, x: F.struct(op(a["total"], value(x)).alias("total"), F.concat(a["before"], F.array(a["total"])).alias("before")))

    def grouped(own: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(own))).cast("int"))
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: run(F.slice(own, k, n), lambda x: x))

    def together(groups: Column) -> Column:
        bases = run(groups, lambda g: g["total"])["before"]
        return F.flatten(F.zip_with(groups, bases, lambda g, b: F.transform(g["before"], lambda x: op(b, x))))

    return _let(_let(xs, grouped), together)


def _matches(t: Column, kind: str, pattern: str, guard: Column, hits: Column | None = None) -> Column:
    """Spans (start, kind, end, hit) of all matches in turn, in code points; `hit` is the match, or another text of it."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

    def spans(own: Column) -> Column:
        pairs = F.zip_with(own, F.slice(F.split(t, pattern, -1), 1, F.size(own)), lambda x, p: F.struct(F.char_length(p).alias("gap"), F.char_length(x).alias("n")))

        def placed(steps: Column) -> Column:
            before = _scan(F.transform(steps, lambda s: s["gap"] + s["n"]), 0, lambda a, b: a + b)
            ends = F.zip_with(steps, before, lambda s, a: F.struct((a + s["gap"]).alias("start"), _kind(kind).alias("kind"), (a + s["gap"] + s["n"]).alias("end")))
            return F.zip_with(ends, own if hits is None else hits, lambda e, h: F.struct(e["start"], e["kind"], e["end"], h.alias("hit")))

        return _let(pairs, placed)

    return F.when(guard, _let(found, spans)).otherwise(F.array().cast(_SPANS))


def _any(tests) -> Column:
    return functools.reduce(lambda a, b: a | b, tests)


def _windows(run: Column) -> Column:
    """Bits of the richest window of a run of at least `WINDOW` key-like characters, by incremental counts."""
    w = WINDOW
    parts = F.regexp_extract_all(run, F.lit(f".{{1,{_PART}}}"), F.lit(0))

    def least(own: Column) -> Column:
        # a window that begins in one part may end in the next
        heads = F.concat(F.transform(F.slice(own, 2, F.size(own)), lambda x: F.substring(x, 1, w - 1)), F.array(F.lit("")))
        full = F.filter(F.zip_with(own, heads, lambda x, y: F.concat(x, y)), lambda x: F.length(x) >= w)
        return F.array_min(F.transform(full, _least))

    return F.lit(math.log2(w)) - _let(parts, least) / w


def _least(part: Column) -> Column:
    """The least sum of c * log2(c) over a window's character counts.

    The state holds the counts as a string, a character for each letter that may occur ("A" for 0). Events are
    characters entering, from the `WINDOW`th on each after the one that leaves.
    """
    w = WINDOW
    clogc = F.array(*[F.lit(0.0 if c == 0 else c * math.log2(c)) for c in range(w + 2)])
    codes = F.transform(F.split(part, ""), lambda c: F.instr(F.lit(_LETTERS), c))
    events = F.transform(F.sequence(F.lit(0), (F.length(part) - w) * 2 + w - 1), lambda k: F.when(k < w, k + 1).when((k - w) % 2 == 0, -((k - w) / 2 + 1).cast("int")).otherwise(((k - w) / 2).cast("int") + w + 1))

    def step(a: Column, e: Column, cs: Column) -> Column:
        at, by = cs[F.abs(e) - 1], F.signum(e).cast("int")
        n = F.ascii(F.substring(a["counts"], at, F.lit(1))) - 65
        s = a["s"] - clogc[n] + clogc[n + by]
        counts = F.overlay(a["counts"], F.chr(n + by + 65), at, 1)
        return F.struct(s.alias("s"), counts.alias("counts"), F.when(e >= w, F.least(a["least"], s)).otherwise(a["least"]).alias("least"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit("A" * len(_LETTERS)).alias("counts"), F.lit(float("inf")).alias("least"))
    return _let(codes, lambda cs: F.aggregate(events, start, lambda a, e: step(a, e, cs), lambda a: a["least"]))


def _threshold(run: Column) -> Column:
    chosen = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        chosen = F.when(run.rlike(pattern), F.lit(bits)).otherwise(chosen)
    return chosen


def _base_spans(t: Column) -> dict[str, Column]:
    """Spans of each base kind."""
    secret = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    assign = _matches(t, "assign", ASSIGN, t.rlike(r"(?i)(?:passw|secret|token|api_?key)"), secret)
    return {
        "assign": F.filter(assign, lambda x: F.char_length(x["hit"]) >= 6),
        "access": _matches(t, "access", ACCESS, t.contains("AKIA")),
        "hex": _matches(t, "hex", HEX, t.rlike(HEX)),
    }


def _apart(every: Column) -> Column:
    """Of spans by start, the runs that no base span overlaps: none before reaches them, the next one begins behind them."""
    last = 2**31 - 1

    def judged(own: Column) -> Column:
        reach = _scan(F.transform(own, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(-1)), -1, F.greatest)
        after = F.reverse(_scan(F.reverse(F.transform(own, lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(last))), last, F.least))
        held = F.zip_with(own, F.arrays_zip(reach.alias("reach"), after.alias("after")), lambda x, y: F.struct(x.alias("span"), ((x["kind"] == 3) & (y["reach"] <= x["start"]) & (y["after"] >= x["end"])).alias("free")))
        return F.transform(F.filter(held, lambda h: h["free"]), lambda h: h["span"])

    return _let(every, judged)


def _own_spans(df: DataFrame) -> DataFrame:
    """Add __assign, __access, __hex, __base and __all to rows with a text __t."""
    t = F.col("__t")
    for kind, spans in _base_spans(t).items():
        df = df.withColumn(f"__{kind}", spans)
    df = df.withColumn("__base", F.sort_array(F.concat("__assign", "__access", "__hex")))
    df = df.withColumn("__runs", _matches(t, "entropy", RUN, t.rlike(RUN)))
    mixed = F.filter("__runs", lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]") & ~_any(x["hit"].rlike(p) for p in ALLOWED))
    df = df.withColumn("__mixed", mixed)
    apart = F.when(F.size("__base") > 0, _apart(F.sort_array(F.concat("__base", "__mixed")))).otherwise(F.col("__mixed"))
    rich = F.filter(apart, lambda x: _windows(x["hit"]) >= _threshold(x["hit"]))
    df = df.withColumn("__more", F.when(F.size("__mixed") > 0, rich).otherwise(F.array().cast(_SPANS)))
    return df.withColumn("__all", F.sort_array(F.concat("__base", "__more"))).drop("__runs", "__mixed", "__more")


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add __assign, __access, __hex, __base and __all, arrays of spans (start, kind, end) by start and kind."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own")
    found = _own_spans(docs.select(own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t")))
    made = ["__assign", "__access", "__hex", "__base", "__all"]
    spans = [F.transform(c, lambda x: F.struct(x["start"], x["kind"], x["end"])).alias(c) for c in made]
    return found.select(*[F.col(f"__own.`{c}`") for c in docs.columns if c not in made], *spans)


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(_listed("__base"), 256).alias("base_sha256"), _listed("__all").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replace every span by a mark; n_chars, where there, follows the new text. Texts without spans stay as they are."""
    own, size = docs.columns, 1 << 16
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__own"), F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    found = _own_spans(inner)
    t, some = F.col("__t"), F.size("__all") > 0
    blocks = F.transform(F.sequence(F.lit(0), (F.char_length(t) / size).cast("int")), lambda k: F.substring(t, k * size + 1, F.lit(size)))

    def between(held: Column, a: Column, b: Column) -> Column:
        """The text in [a, b), from the blocks it lies in."""
        first, last = F.floor(a / size).cast("int"), F.floor(b / size).cast("int")
        one = F.substring(held[first], a % size + 1, b - a)
        middle = F.array_join(F.slice(held, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        more = F.concat(F.substring(held[first], a % size + 1, F.lit(size)), middle, F.substring(held[last], F.lit(1), b % size))
        return F.when(first == last, one).otherwise(more)

    def cleaned(held: Column) -> Column:
        reach = _scan(F.transform("__all", lambda x: x["end"]), 0, F.greatest)
        pieces = F.zip_with("__all", reach, lambda x, a: F.when(x["start"] >= a, F.concat(between(held, a, x["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), between(held, F.array_max(F.transform("__all", lambda x: x["end"])), F.char_length(t)))

    clean = F.when(some, _let(blocks, cleaned)).otherwise(F.col("__own.text"))
    found = found.withColumn("__clean", clean)
    out = [F.col(f"__own.`{c}`") for c in own]
    for i, c in enumerate(own):
        if c.lower() == "text":
            out[i] = F.col("__clean").alias(c)
        elif c.lower() == "n_chars":
            kind = docs.schema[c].dataType
            out[i] = F.when(some, F.char_length("__clean").cast(kind)).otherwise(F.col(f"__own.`{c}`")).alias(c)
    return found.select(*out)


def _sql_spans(pattern: str, kind: int, keep: str) -> str:
    """Spans in DuckDB from the pieces and the matches of a pattern."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, hit, hit2, (sum(length(piece)) OVER w + sum(length(hit)) OVER w - length(hit))::BIGINT AS start, (sum(length(piece)) OVER w + sum(length(hit)) OVER w)::BIGINT AS stop
  FROM (
    SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(hits2) AS hit2, unnest(pieces[1 : len(hits)]) AS piece
    FROM (
      SELECT doc_id, regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {2 if keep else 0}) AS hits2, string_split_regex(t, '{quoted}') AS pieces
      FROM d)
    WHERE len(hits) > 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


_allowed_sql = " AND ".join(f"NOT regexp_matches(hit, '{p}')" for p in ALLOWED)
_bits_sql = " ".join(f"WHEN regexp_matches(hit, '{p}') THEN {bits}" for p, bits in CLASSES[:-1])
OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT * FROM ({_sql_spans(ASSIGN, 0, "hit2")}) WHERE length(hit2) >= 6
  UNION ALL SELECT * FROM ({_sql_spans(ACCESS, 1, "")})
  UNION ALL SELECT * FROM ({_sql_spans(HEX, 2, "")})),
runs AS (
  SELECT * FROM ({_sql_spans(RUN, 3, "")}) r
  WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND {_allowed_sql}
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r.stop AND b.stop > r.start)),
wins AS (SELECT doc_id, start, stop, hit, unnest(range(1, length(hit) - {WINDOW} + 2)) AS i FROM runs),
chars AS (SELECT doc_id, start, stop, hit, i, unnest(string_split(substr(hit, i, {WINDOW}), '')) AS c FROM wins),
bits AS (
  SELECT doc_id, start, stop, hit, i, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS h
  FROM (SELECT doc_id, start, stop, hit, i, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL),
more AS (
  SELECT doc_id, 3 AS kind, start, stop FROM bits GROUP BY doc_id, start, stop, hit
  HAVING max(h) >= CASE {_bits_sql} ELSE {CLASSES[-1][1]} END),
every AS (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT * FROM more),
named AS (SELECT *, ['{"', '".join(KINDS)}'][kind + 1] || ':' || start || ':' || stop AS s FROM every),
j AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(s, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""
