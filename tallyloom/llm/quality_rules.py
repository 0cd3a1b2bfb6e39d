"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over one row, so the whole operator is a scan and a few
projections: no shuffle, no user function. Repeated five-word windows are found by hashing each
window (64 bits) and sorting the hashes of the one text, and only for texts that repeat at all.

Defined results: a null or empty text has no words and fails the base test; repeated rows are
judged each on its own; other columns of the input are ignored (query) or kept (`filter_quality`).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, words

#: Common function words of the corpus languages (fixed list; a parameter of every entry point).
STOP_WORDS = (
    "the of and to in is that it for was on with as by be at this are or an not from "
    "der die das und ist nicht ein eine mit von zu den auf für dem im des sich auch "
    "le la les de des et un une est dans que qui pour par sur au du en avec ne pas "
    "el los las del y es por con para una se no lo como más su al"
).split()


class Rule(NamedTuple):
    """A row of the threshold table: part must lie in [low, high] percent of whole, from `least` words on."""

    name: str
    part: str
    whole: str
    low: float | None
    high: float | None
    least: int = 0


#: The threshold table. Whole-number percentages keep both engines on integers.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 15),
    Rule("stop_words", "n_stop_words", "n_words", 6, None, 30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("letters", "n_alpha_words", "n_words", 60, None),
)


def measures(docs: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """Add the measures that rules name; `text` may be null."""
    stop = [str(w) for w in stop_words]
    blank = r"[^\x20\x09-\x0D]"
    at = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    at = at.withColumn("__w", words(F.col("__t"))).withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(blank)))
    at = at.withColumn("n_words", F.size("__w").cast("long"))
    w = F.col("__w")
    window = F.transform(F.sequence(F.lit(0), F.size("__w") - 5), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))
    at = at.withColumn("__h", F.when(F.col("n_words") >= 5, window))
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = at.withColumn("__p", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs))
    p, last = F.col("__p"), F.size("__p") - 1
    twice = F.filter("__p", lambda x, k: ((k > 0) & (p[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (p[F.least(k + 1, last)]["h"] == x["h"])))
    at = at.withColumn("__r", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "__r",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    bare = F.translate("__t", " \t\n\x0b\x0c\r", "")
    at = at.withColumns(
        {
            "word_chars": F.char_length(bare).cast("long"),
            "n_symbols": (F.char_length("__t") - F.char_length(F.translate("__t", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_stop_words": F.size(F.filter("__w", lambda x: F.lower(x).isin(stop))).cast("long"),
            "n_alpha_words": F.size(F.filter("__w", lambda x: x.rlike(r"\p{L}"))).cast("long"),
        }
    )
    return at.drop("__t", "__w", "__l", "__h", "__p", "__r")


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression: true where every rule holds."""
    holds = F.lit(True)
    for r in rules:
        part, whole, few = F.col(r.part) * 100, F.col(r.whole), F.col("n_words") < r.least
        if r.low is not None:
            holds = holds & (few | (part >= whole * r.low))
        if r.high is not None:
            holds = holds & (few | (part <= whole * r.high))
    return holds


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def filter_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass the base test and every rule, with their own columns."""
    own = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__own"), F.col(f"`{text}`").alias("__text"))
    # the row number is a barrier: pushed below the measures, the filter would work each out again
    # wherever it names one
    kept = measures(inner, "__text").withColumn("__row", F.monotonically_increasing_id())
    return kept.where((F.col("__row") >= 0) & ~base_failed() & compiled(rules)).select("__own.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = measures(docs).withColumn("base_failed", base_failed())
    kept = (~F.col("base_failed")) & compiled()
    return at.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def _rules_sql() -> str:
    tests = []
    for r in RULES:
        if r.low is not None:
            tests.append(f"(n_words < {r.least} OR {r.part} * 100 >= {r.whole} * {r.low})")
        if r.high is not None:
            tests.append(f"(n_words < {r.least} OR {r.part} * 100 <= {r.whole} * {r.high})")
    return " AND ".join(tests)


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n
  FROM (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS v
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5))),
rep AS (
  SELECT doc_id, sum(step) AS n_repeat_words
  FROM (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 5)) AS step
        FROM win WHERE n > 1)
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(ls) AS n_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha_words,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND {_rules_sql()} AS kept
FROM b
"""
