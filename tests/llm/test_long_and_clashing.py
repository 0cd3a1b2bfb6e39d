"""Very long texts in operators 1, 6, 7, 8 and every stage of the pipeline; extra columns whose names clash in 6, 8, 10 to 13."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import mixture, packing, pii, quality_rules, secret_scan, sessions, spelling, token_binary

LINE = "some plain words of a very long text, over and over again\n"
LONG = LINE * 60_000  # 3.5 million characters, 660,000 words


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven.\n", "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, "1 " * 400_000, "en", "c")]
    few = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made = spark.range(1).select(F.lit(2).cast("long").alias("doc_id"), F.repeat(F.lit(LINE), 60_000).alias("text"), F.lit("en").alias("lang"), F.lit("b").alias("source"), F.lit(len(LONG)).cast("long").alias("n_chars"))
    return few.unionByName(made)


def test_quality_of_a_long_text(long_docs):
    got = {r.doc_id: r for r in quality_rules.measures(long_docs).select("doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words").collect()}
    words = LONG.split()
    assert (got[2].n_words, got[2].word_chars, got[2].n_dup_lines, got[2].n_repeat_words) == (len(words), sum(map(len, words)), 59_999, len(words))
    assert (got[5].n_words, got[5].n_repeat_words, got[3].n_words) == (400_000, 400_000, 0)


def test_mixture_and_packs_of_long_texts(long_docs):
    got = {r.doc_id: r for r in mixture.mix(long_docs).collect()}
    assert got[2]["size"] == len(LONG.split()) and got[3]["size"] == 0
    assert {r.doc_id for r in mixture.take_mixture(long_docs).select("doc_id").collect()} <= {1, 2, 3, 4, 5}
    packs = {r.doc_id: r for r in packing.pack(packing.token_lengths(long_docs)).collect()}
    assert packs[2].length >= len(LONG.split()) and packs[3].length == packs[4].length == 0 and all(r.padding >= 0 for r in packs.values())


def test_secrets_in_a_long_text(spark, long_docs):
    held = long_docs.withColumn("text", F.when(F.col("doc_id") == 2, F.concat("text", F.lit("password=abcdef123456 "), "text")).otherwise(F.col("text")))
    spans = {r.doc_id: r["__assign"] for r in secret_scan.with_spans(held, "text").select("doc_id", "__assign").collect()}
    assert [(s.start, s.end) for s in spans[2]] == [(len(LONG), len(LONG) + 21)] and not spans[5]


def test_every_stage_takes_a_long_text(spark, long_docs, tmp_path):
    docs = long_docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == long_docs.columns, name
    assert docs.where("doc_id = 2").count() >= 1


CLASH = ["rank", "size", "source_size", "target", "copies", "held", "own", "name", "length", "bucket", "at", "part", "word", "n", "key", "found", "spans", "client", "start"]


def clashing(docs):
    for c in CLASH:
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit("clash"))
    return docs


def test_clashing_names(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alphabet", "alphabets", "betatron", "mail a@b.de"]) for _ in range(20)), rng.choice(["a", "b", None])) for k in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = clashing(plain)
    order = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    columns = ("doc_id", "source_size", "target", "copies")
    assert order(mixture.mix(odd), *columns) == order(mixture.mix(plain), *columns)
    taken = mixture.take_mixture(odd)
    assert taken.columns == odd.columns and order(taken, "doc_id") == order(mixture.take_mixture(plain), "doc_id") and taken.where("rank <> 'clash'").isEmpty()
    assert order(packing.pack(packing.token_lengths(odd)), "doc_id", "length", "batch", "slot") == order(packing.pack(packing.token_lengths(plain)), "doc_id", "length", "batch", "slot")
    read = [token_binary.read_tokens(spark, f"{tmp_path}/{i}", token_binary.write_tokens(df, f"{tmp_path}/{i}")) for i, df in enumerate((odd, plain))]
    assert order(read[0], "doc_id", "start", "n_tokens", "ids_crc32") == order(read[1], "doc_id", "start", "n_tokens", "ids_crc32")
    assert order(pii.personal_spans(odd, "text"), "doc_id", "n_email", "spans") == order(pii.personal_spans(plain, "text"), "doc_id", "n_email", "spans")
    forms = [spelling.variant_forms(spelling.word_counts(df, "doc_id", "text")) for df in (odd, plain)]
    assert order(forms[0], *forms[0].columns) == order(forms[1], *forms[0].columns) and forms[0].where("n_near > 0").count() >= 2
    clicks = spark.sql("SELECT id AS click_id, timestamp_micros(1700000000000000 + id * 600000000) AS ts, cast(null AS timestamp) AS arrived_at, id % 2 AS client_id, 'view' AS kind, 1.5D AS value FROM range(40)")
    assert order(sessions.sessions(clashing(clicks)), "session_id", "closed_by", "path_sha256") == order(sessions.sessions(clicks), "session_id", "closed_by", "path_sha256")


def test_ids_of_other_types(spark):
    """Sessions of text ids, spans of rows without an id, variants whose ids are text."""
    clicks = spark.sql("SELECT concat('k', lpad(id, 3, '0')) AS click_id, timestamp_micros(1700000000000000 + id * 600000000) AS ts, timestamp_micros(1700000000000000) AS arrived_at, concat('c', id % 2) AS client_id, 'purchase' AS kind, 61.0D AS value FROM range(9)")
    assert sorted((r.session_id, r.client_id, r.n_clicks, r.closed_by) for r in sessions.sessions(clicks).collect()) == [(f"k{k:03}", f"c{k % 2}", 1, "end") for k in range(9)]
    docs = spark.createDataFrame([(None, "a@b.de alphabet alphabet"), ("x", None)], "doc_id string, text string")
    assert sorted(r.n_email for r in pii.personal_spans(docs, "text").collect()) == [0, 1]
    assert [r.n for r in spelling.word_counts(docs, "doc_id", "text").collect()] in ([2], [])
