"""Queries over whole cases: documents by contract, captured cards, result records, what a report shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import texts as T
from tallyloom.functions import views
from tallyloom.operators import capture, case_rules, postings, results, rules, search
from tallyloom.operators.cuts import durable
from tallyloom.plans.registry import query
from tallyloom.plans.snapshots import _PAIRS, LEFT, RIGHT, _pair_sql, sides  # noqa: F401
from tallyloom.sources.adapters import relation

TAXONOMY = {"memory": ["node-1", "node-2"], "scheduler": ["node-3", "node-4"]}


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- documents of cases ------------------------------------------------------------------------

_MODULE_ISSUES = f"""
WITH m AS (SELECT * FROM case_modules)
SELECT case_id, path, code, detail FROM (
  SELECT case_id, path, 'structure.missing_frontmatter' AS code, 'base_delta' AS detail FROM m WHERE n % 5 = 0
  UNION ALL SELECT case_id, path, 'structure.invalid_enum', 'base_delta=' FROM m WHERE n % 5 = 0
  UNION ALL SELECT case_id, path, 'structure.invalid_enum', 'status=odd' FROM m WHERE n % 6 = 5
  UNION ALL SELECT case_id, path, 'structure.missing_heading', '证据' FROM m WHERE n % 7 = 0
  UNION ALL SELECT case_id, path, 'structure.empty_heading', '适用范围' FROM m WHERE n % 3 = 0
  UNION ALL SELECT case_id, path, 'structure.unknown_h2', 'Extra' FROM m WHERE n % 4 = 0
  UNION ALL SELECT case_id, path, 'structure.h1', '2' FROM m WHERE n % 8 = 0
  UNION ALL SELECT case_id, path, 'taxonomy.unknown_module', 'network' FROM m WHERE id % 3 = 2
  UNION ALL SELECT case_id, path, 'taxonomy.unknown_node', 'node-3' FROM m WHERE id % 3 = 0 AND n % 2 = 1
  UNION ALL SELECT case_id, path, 'structure.module_path_mismatch', 'm' || id FROM m
  UNION ALL SELECT case_id, path, 'identity.platform_fork_leak', 'T2020260000' || (100000 + id) || '-1' FROM m WHERE n % 9 = 0)
"""


@query(_MODULE_ISSUES)
def case_document_rules(spark, d):
    """Issues of every module review by itself."""
    files = relation(spark, d, "case_modules").select("case_id", "path", "text")
    return case_rules.document_issues(case_rules.parsed(files), TAXONOMY)


@query(f"SELECT count(*) = 0 AS ok, count(*) AS issues FROM ({_MODULE_ISSUES})")
def case_documents_ok(spark, d):
    files = relation(spark, d, "case_modules").select("case_id", "path", "text")
    return rules.ok(case_rules.document_issues(case_rules.parsed(files), TAXONOMY))


@query("SELECT case_id, unnest(['identity.md', 'base.md', 'report.md']) AS path, 'structure.missing_file' AS code, '' AS detail FROM (SELECT DISTINCT case_id FROM case_modules)")
def case_presence(spark, d):
    files = relation(spark, d, "case_modules").select("case_id", "path", "text")
    return case_rules.presence(case_rules.marked(files), files.select("case_id").distinct())


@query(
    """WITH m AS (SELECT case_id, path, sha256(text) AS sha FROM case_modules)
    SELECT case_id, count(*)::INT AS files, sha256(string_agg(path || chr(0) || sha || chr(10), '' ORDER BY path)) AS digest FROM m GROUP BY case_id"""
)
def review_material(spark, d):
    found = case_rules.material(relation(spark, d, "case_modules").select("case_id", "path", "text"))
    return found.select("case_id", F.size("files").alias("files"), "digest")


_BUCKET = "CASE WHEN s = 'absent' THEN 'absent' WHEN o LIKE 'adapted%' THEN 'adapted' ELSE o END"


@query(
    f"""WITH m AS (SELECT case_id, CASE n % 6 WHEN 0 THEN 'implemented' WHEN 1 THEN 'partial' WHEN 2 THEN 'minimal' WHEN 3 THEN 'absent' WHEN 4 THEN 'partial' ELSE 'odd' END AS s,
      CASE n % 3 WHEN 0 THEN 'novel' WHEN 1 THEN 'adapted_minor' ELSE 'inherited' END AS o FROM case_modules)
    SELECT case_id, {", ".join(f"count(*) FILTER ({_BUCKET} = '{b}') AS {b}" for b in results.SUMMARY)} FROM m GROUP BY case_id"""
)
def case_tags(spark, d):
    """The module summary of each case's tags."""
    files = relation(spark, d, "case_modules")
    identity = files.select("case_id").distinct().select("case_id", F.lit("identity.md").alias("path"), F.concat(F.lit("---\ncontract: identity\nwork_id: "), "case_id", F.lit("\n---\n")).alias("text"))
    docs = case_rules.parsed(files.select("case_id", "path", "text").unionByName(identity))
    found = results.tags(docs).select("case_id", F.from_json("text", results.TAGS).alias("t"))
    return found.select("case_id", "t.module_summary.*")


@query(
    """SELECT count(*) AS works, 0::BIGINT AS with_risk, min('reports/' || case_id || '/report.html') AS first FROM (SELECT DISTINCT case_id FROM case_modules)"""
)
def case_index(spark, d):
    files = relation(spark, d, "case_modules").select("case_id").distinct()
    identity = files.select("case_id", F.lit("identity.md").alias("path"), F.concat(F.lit("---\ncontract: identity\nwork_id: "), "case_id", F.lit("\n---\n")).alias("text"))
    tags = results.tags(case_rules.parsed(identity))
    first = results.index(tags).agg(F.min(F.get_json_object("text", "$.public_paths.html")).alias("first"))
    return results.index_counts(tags).crossJoin(first)  # single rows


# --- captured cards ------------------------------------------------------------------------------

_TEXT_LINES = """(SELECT doc_id, CASE WHEN s[-1] = '' THEN s[1 : len(s) - 1] ELSE s END AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM texts))"""


def _blobs(spark, d):
    """Texts as files of works: the work is the source, the path the id."""
    at = relation(spark, d, "texts")
    return at.select(F.coalesce("work_id", F.lit("none")).alias("work_id"), F.lit("Work").alias("display_name"), F.lit("c0").alias("commit"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("object_hash"), "text", "doc_id")


@query(
    f"""SELECT doc_id AS n, CASE WHEN ls IS NULL THEN 'nothing there' WHEN len(ls) < 3 THEN 'past the end: ' || len(ls) || ' lines' ELSE '' END AS problem,
    CASE WHEN len(ls) >= 3 THEN ls[2] || chr(10) || ls[3] ELSE '' END AS excerpt, 'L2-L3' AS locator FROM {_TEXT_LINES}"""
)
def capture_spans(spark, d):
    blobs = _blobs(spark, d)
    asked = blobs.select(F.col("doc_id").alias("n"), F.lit("t").alias("title"), "work_id", "commit", "path", F.lit("2:3").alias("lines"))
    found = capture.span_cards(asked, blobs.drop("doc_id"))
    return found.select("n", "problem", "excerpt", F.col("source.locator").alias("locator"))


@query(
    f"""WITH h AS (SELECT coalesce(work_id, 'none') AS work_id, doc_id::VARCHAR AS path, k, ls[k] AS line FROM (SELECT t.work_id, t.doc_id, l.ls, unnest(range(1, len(l.ls) + 1)) AS k FROM texts t JOIN {_TEXT_LINES} l ON l.doc_id = t.doc_id)),
    g AS (SELECT work_id, count(*) AS hits FROM h WHERE regexp_matches(line, 'token = |Licensed') GROUP BY work_id)
    SELECT w.work_id, coalesce(hits, 0)::BIGINT AS hits, least(coalesce(hits, 0), 100)::INT AS rows FROM (SELECT DISTINCT coalesce(work_id, 'none') AS work_id FROM texts) w LEFT JOIN g USING (work_id)"""
)
def capture_searches(spark, d):
    blobs = _blobs(spark, d)
    works = blobs.groupBy("work_id").agg(F.min("doc_id").alias("n"))
    asked = works.select("n", F.lit("t").alias("title"), "work_id", F.lit("c0").alias("commit"), F.lit("token = |Licensed").alias("pattern"), F.lit(None).cast("array<string>").alias("paths"))
    found = capture.search_cards(asked, blobs.drop("doc_id"))
    return found.select(F.col("source.work_id").alias("work_id"), F.col("facts")[2]["value"].cast("long").alias("hits"), F.size("table.rows").alias("rows"))


@query(
    f"""WITH h AS (SELECT coalesce(work_id, 'none') AS work_id, doc_id::VARCHAR AS path, k, ls[k] AS line FROM (SELECT t.work_id, t.doc_id, l.ls, unnest(range(1, len(l.ls) + 1)) AS k FROM texts t JOIN {_TEXT_LINES} l ON l.doc_id = t.doc_id)),
    p AS (SELECT unnest(range(5)) AS p, unnest(['token = "[0-9a-f]+|Licensed under', 'AKIA[A-Z0-9]+ ', 'password=|passwd', 'no such words', '[0-9]{{16}}']) AS pattern),
    w AS (SELECT DISTINCT coalesce(work_id, 'none') AS work_id FROM texts)
    SELECT w.work_id, p.p, count(h.k)::BIGINT AS hits, min(h.path || ':' || h.k::VARCHAR) AS first FROM w CROSS JOIN p LEFT JOIN h ON h.work_id = w.work_id AND regexp_matches(h.line, p.pattern) GROUP BY ALL"""
)
def indexed_searches(spark, d):
    """Five patterns searched in every work by the index of its texts."""
    blobs = _blobs(spark, d).drop("doc_id")
    patterns = ['token = "[0-9a-f]+|Licensed under', "AKIA[A-Z0-9]+ ", "password=|passwd", "no such words", "[0-9]{16}"]
    works = blobs.select("work_id", "commit").distinct()
    asked = works.select("work_id", "commit", F.posexplode(F.array(*[F.lit(p) for p in patterns])).alias("p", "pattern"))
    asked = asked.withColumn("n", F.xxhash64("work_id", "p"))
    index = durable(postings.postings(blobs, postings.grams_of(patterns)), "postings")
    maybe = postings.candidate_files(asked, index, blobs)
    lines = maybe.join(blobs, ["work_id", "commit", "path"]).select("n", "path", F.posexplode(T.lines(F.col("text"))).alias("k", "line")).join(asked.select("n", "pattern"), "n")
    hits = lines.where(F.expr("line RLIKE pattern")).groupBy("n").agg(F.count(F.lit(1)).alias("hits"), F.min(F.concat_ws(":", "path", (F.col("k") + 1).cast("string"))).alias("first"))
    return asked.join(hits, "n", "left").select("work_id", F.col("p").cast("long").alias("p"), F.coalesce("hits", F.lit(0)).alias("hits"), "first")


@query(
    """SELECT id AS n, subject || chr(10) || chr(10) || body AS excerpt, path || '|' || additions || '|' || deletions AS row, coalesce(try_cast(additions AS BIGINT), 0) AS additions, commit AS object_hash FROM commits"""
)
def capture_commits(spark, d):
    at = relation(spark, d, "commits")
    commits = at.select(F.col("author").alias("work_id"), F.lit("Work").alias("display_name"), "commit", F.lit("").alias("parents"), "author", *[F.lit("").alias(c) for c in ("author_time", "committer", "commit_time")], "subject", "body")
    numstat = at.select(F.col("author").alias("work_id"), "commit", "path", "additions", "deletions")
    asked = at.select(F.col("id").alias("n"), F.lit("t").alias("title"), F.col("author").alias("work_id"), "commit", F.lit(None).cast("array<string>").alias("paths"))
    found = capture.commit_cards(asked, commits, numstat)
    return found.select("n", "excerpt", F.array_join(F.col("table.rows")[0], "|").alias("row"), F.col("facts")[6]["value"].cast("long").alias("additions"), F.col("source.object_hash").alias("object_hash"))


# --- result records ------------------------------------------------------------------------------

_NAMED = ({"work_id": LEFT, "display_name": "Left", "ref": "r1", "commit": "c" * 40}, {"work_id": RIGHT, "display_name": "Right", "ref": "", "commit": "d" * 40})
_L, _R = "(SELECT * FROM bag WHERE work_id = 'w1')", "(SELECT * FROM bag WHERE work_id = 'w2')"


@query(
    f"""WITH lb AS (SELECT blob, count(*) AS n FROM {_L} x GROUP BY blob), rb AS (SELECT blob, count(*) AS n FROM {_R} x GROUP BY blob),
    s AS (SELECT coalesce(sum(least(lb.n, rb.n)), 0)::BIGINT AS shared, count(*) AS unique_blobs FROM lb JOIN rb USING (blob)), t AS (SELECT (SELECT sum(n) FROM lb) AS l, (SELECT sum(n) FROM rb) AS r)
    SELECT 'r1@cccccccccccc' AS left_version, '全部指纹路径' AS scope, l::BIGINT AS left_total, r::BIGINT AS right_total, shared, round_even(shared / l, 6) AS left_containment, unique_blobs FROM s, t"""
)
def capture_comparison(spark, d):
    """The card of a comparison of two works, through its record."""
    left, right = sides(spark, d)
    record = results.commit_pair(left, right, _NAMED).select(F.lit(1).cast("long").alias("n"), F.lit("t").alias("title"), F.lit("facts.json").alias("path"), "text")
    facts = F.map_from_entries(F.transform("facts", lambda f: F.struct(f["label"], f["value"])))
    at = capture.comparison_cards(record).select(facts.alias("f"))
    fact = lambda i, kind, name: F.col("f")[capture.PAIR_FACTS[i]].cast(kind).alias(name)
    return at.select(fact(2, "string", "left_version"), fact(4, "string", "scope"), fact(6, "long", "left_total"), fact(7, "long", "right_total"), fact(8, "long", "shared"), fact(9, "double", "left_containment"), fact(13, "long", "unique_blobs"))


@query(
    """WITH h AS (SELECT DISTINCT work_id, object_id FROM history WHERE work_id <> 'w1'), t AS (SELECT blob, count(*) AS n FROM bag WHERE work_id = 'w1' GROUP BY blob),
    c AS (SELECT h.work_id, coalesce(any_value(display_name), h.work_id) AS name, count(*) AS u, round_even(sum(n)::BIGINT / (SELECT sum(n) FROM t)::BIGINT, 6) AS share FROM h JOIN t ON blob = object_id LEFT JOIN heads ON heads.work_id = h.work_id GROUP BY h.work_id),
    r AS (SELECT *, row_number() OVER (ORDER BY share DESC, u DESC, name, work_id) AS rn FROM c)
    SELECT rn::INT AS place, name, share::DOUBLE AS share, u AS unique_blobs FROM r WHERE rn <= 30"""
)
def history_record(spark, d):
    """The rows of a history search's card, through its record."""
    found = search.history_search(sides(spark, d)[0], relation(spark, d, "history"), LEFT, 30, relation(spark, d, "heads"))
    record = results.history_result(found, _NAMED[0]).select(F.lit(1).cast("long").alias("n"), F.lit("t").alias("title"), F.lit("x").alias("path"), "text")
    rows = capture.result_cards(record).select(F.posexplode("table.rows").alias("k", "row"))
    return rows.select((F.col("k") + 1).alias("place"), F.col("row")[0].alias("name"), F.col("row")[2].cast("double").alias("share"), F.col("row")[3].cast("long").alias("unique_blobs"))


@query(
    """WITH t AS (SELECT work_id, path, CASE WHEN regexp_matches(path, '[^/]\\.[^./]+$') THEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) ELSE '<none>' END AS suffix FROM tree),
    c AS (SELECT work_id, suffix, count(*) AS n FROM t GROUP BY ALL)
    SELECT work_id, sum(n)::BIGINT AS file_count, string_agg(suffix || '=' || n, ',' ORDER BY suffix) AS suffixes,
    (SELECT string_agg(DISTINCT split_part(path, '/', 1), ',' ORDER BY split_part(path, '/', 1)) FROM tree x WHERE x.work_id = c.work_id AND contains(path, '/') AND path NOT LIKE '.%') AS dirs FROM c GROUP BY work_id"""
)
def inventory_record(spark, d):
    found = results.inventory_records(relation(spark, d, "tree")).select("work_id", F.from_json("text", "file_count bigint, suffixes map<string,bigint>, top_level_dirs array<string>").alias("t"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("t.suffixes")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("work_id", "t.file_count", listed.alias("suffixes"), F.array_join("t.top_level_dirs", ",").alias("dirs"))


# --- what a report shows ---------------------------------------------------------------------------


@query(
    r"""SELECT id, regexp_replace(body, '\[@(E[0-9]{3,})\]', '[\1](#evidence-\1)', 'g') AS linked, CASE WHEN starts_with(body, '# ') THEN substr(body, strpos(body, chr(10)) + 1) ELSE body END AS bare FROM documents_md"""
)
def report_texts(spark, d):
    return relation(spark, d, "documents_md").select("id", views.linked(F.col("body")).alias("linked"), views.without_title(F.col("body")).alias("bare"))


@query(f"""SELECT doc_id, 10 + unnest(range(0, len(ls)))::INT AS n, unnest(ls) AS line FROM {_TEXT_LINES}""")
def numbered_excerpt(spark, d):
    at = relation(spark, d, "texts").select("doc_id", F.explode(views.numbered_lines(F.col("text"), F.lit(10))).alias("x"))
    return at.select("doc_id", "x.n", "x.line")


@query(
    """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'a, ' || event_type WHEN 1 THEN '-' WHEN 2 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS shown FROM events"""
)
def fact_values(spark, d):
    """Facts as they are shown, from their JSON."""
    at = spark.read.parquet(f"{d}/events.parquet")
    json = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('["a", "'), "event_type", F.lit('"]'))).when(F.col("event_id") % 4 == 1, F.lit("[]")).when(F.col("event_id") % 4 == 2, F.col("user_id").cast("string"))
    json = json.otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    return at.select(F.col("event_id").alias("id"), views.fact_text(json).alias("shown"))


@query(
    r"""WITH r AS (SELECT id, list_distinct(regexp_extract_all(body, '\[@(E[0-9]{3,})\]', 1)) AS es FROM documents_md)
    SELECT id, len(es)::INT AS cited, least(4, len(es))::INT AS shown, greatest(0, len(es) - 4)::INT AS more FROM r"""
)
def module_chips(spark, d):
    refs = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[@(E[0-9]{3,})\]"), F.lit(1)))
    at = relation(spark, d, "documents_md").select("id", refs.alias("es"))
    held = views.chips(F.array().cast("array<string>"), F.col("es"))
    return at.select("id", F.size("es").alias("cited"), F.size(held["evidence_ids"]).alias("shown"), held["more"].alias("more"))


@query("SELECT view FROM (SELECT unnest(['overview', 'lineage', 'architecture', 'risk', 'modules', 'evidence']) AS view) WHERE view IN (SELECT CASE id % 3 WHEN 0 THEN 'overview' WHEN 1 THEN 'risk' ELSE 'modules' END FROM documents_md)")
def active_views(spark, d):
    every = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in ("overview", "lineage", "architecture", "risk", "modules", "evidence")])).alias("view"))
    n = F.col("id") % 3
    return views.active_views(every, relation(spark, d, "documents_md").select(F.when(n == 0, "overview").when(n == 1, "risk").otherwise("modules").alias("view")))
