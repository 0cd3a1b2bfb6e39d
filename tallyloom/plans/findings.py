"""Queries over the registry, the evidence log and the compiled report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import evidence, report
from tallyloom.operators.cuts import fresh_path
from tallyloom.plans.registry import query
from tallyloom.sources import files
from tallyloom.sources.adapters import relation
from tallyloom.streaming import ingest

_SOURCE = """'{"display_name":"' || source_name || '","path":"' || source_path || '"}'"""
_SIGNATURE = f"""sha256('{{"facts":[' || CASE WHEN kind = 'search_result' AND raw_sha = '' THEN '"' || fact || '"' ELSE '' END || '],"kind":"' || kind || '","raw_sha256":"' || raw_sha || '","source":' || {_SOURCE} || '}}')"""
_REFS = r"""SELECT id, path, section, line, unnest(regexp_extract_all(line_text, '\[@(E[0-9]{3,})\]', 1)) AS evidence_id FROM (
SELECT id, path, n AS line, line_text, last_value(CASE WHEN regexp_matches(line_text, '^##\s') THEN regexp_extract(line_text, '^##\s+(.+?)\s*$', 1) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n) AS section FROM (
SELECT id, path, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line_text FROM (SELECT id, path, string_split(body, chr(10)) AS ls FROM documents_md)))"""


# --- registry --------------------------------------------------------------------------------

_REGISTRY = """SELECT trim(work_id) AS work_id, coalesce(year, 0) AS year, trim(coalesce(school, '')) AS school, trim(coalesce(team, '')) AS team, trim(coalesce(work_name, '')) AS work_name,
trim(coalesce(display_name, '')) AS display_name, trim(coalesce(canonical_dir, '')) AS canonical_dir, trim(coalesce(review_branch, 'main')) AS review_branch, coalesce(repository_type, 'competition') AS repository_type,
trim(coalesce(reference_kind, '')) AS reference_kind, array_to_string(list_filter(list_transform(string_split(coalesce(module_ids, ''), ','), lambda x: trim(x)), lambda x: x <> ''), ',') AS module_ids, ord FROM works"""


@query(_REGISTRY)
def registry_scan(spark, d):
    return report.registry(relation(spark, d, "works")).withColumn("module_ids", F.array_join("module_ids", ","))


@query(f"SELECT work_id, display_name, ord FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY ord) AS rn FROM ({_REGISTRY})) WHERE rn = 1 AND work_id IN ('c7', 'c99')")
def registry_lookup(spark, d):
    return report.lookup(report.registry(relation(spark, d, "works")), ["c7", "c99"]).select("work_id", "display_name", "ord")


@query("SELECT work_id, min(ord) AS place FROM works GROUP BY work_id")
def distinct_ordered(spark, d):
    return report.distinct_in_order(relation(spark, d, "works"), "work_id", "ord")


@query(
    """SELECT count(*) AS works, count(*) FILTER (repository_type = 'reference') AS references_, count(DISTINCT school) AS schools FROM works"""
)
def index_stats(spark, d):
    at = relation(spark, d, "works")
    return at.agg(F.count(F.lit(1)).alias("works"), F.count_if(F.col("repository_type") == "reference").alias("references_"), F.countDistinct("school").alias("schools"))


@query(
    f"""SELECT work_id, ord FROM ({_REGISTRY}) WHERE strpos(lower(concat_ws(' ', work_id, school, team, work_name, display_name)), 'school 1') > 0 AND repository_type = 'competition'"""
)
def index_filter(spark, d):
    return report.index_filter(report.registry(relation(spark, d, "works")), "School 1", F.col("repository_type") == "competition").select("work_id", "ord")


# --- evidence --------------------------------------------------------------------------------


@query(
    """SELECT n, evidence_id, CASE WHEN NOT regexp_matches(evidence_id, '^E[0-9]{3,}$') THEN 'id' WHEN kind NOT IN ('source_span', 'document_span', 'git_commit', 'fingerprint_comparison', 'search_result') THEN 'kind'
    WHEN trim(title) = '' THEN 'title' WHEN trim(source_name) = '' THEN 'source' WHEN columns <> cells AND n % 3 = 0 THEN 'table' ELSE '' END AS problem FROM cards"""
)
def card_validation(spark, d):
    return evidence.validated(evidence.with_tables(relation(spark, d, "cards"))).select("n", "evidence_id", "problem")


@query("SELECT evidence_id, kind, title, length(excerpt) AS chars FROM cards WHERE regexp_matches(evidence_id, '^E[0-9]{3,}$') AND trim(excerpt) <> ''")
def evidence_scan(spark, d):
    return evidence.scan(relation(spark, d, "cards")).select("evidence_id", "kind", "title", F.length("excerpt").cast("long").alias("chars"))


@query(
    """WITH x AS (SELECT row_number() OVER (ORDER BY n) AS line, CASE n % 50 WHEN 7 THEN 'json' WHEN 11 THEN 'object' WHEN 9 THEN 'blank' ELSE '' END AS form, CASE WHEN n % 50 = 13 THEN 'E777' ELSE evidence_id END AS evidence_id, kind, title, source_name FROM cards),
    p AS (SELECT line, CASE WHEN form <> '' THEN '' ELSE evidence_id END AS evidence_id, CASE WHEN form <> '' THEN form WHEN NOT regexp_matches(evidence_id, '^E[0-9]{3,}$') THEN 'id'
      WHEN kind NOT IN ('source_span', 'document_span', 'git_commit', 'fingerprint_comparison', 'search_result') THEN 'kind' WHEN trim(title) = '' THEN 'title' WHEN trim(source_name) = '' THEN 'source' ELSE '' END AS problem FROM x)
    SELECT line, evidence_id, CASE WHEN problem = '' THEN 'duplicate' ELSE problem END AS problem FROM p
    WHERE problem NOT IN ('', 'blank') OR (problem = '' AND line > (SELECT min(q.line) FROM p q WHERE q.problem = '' AND q.evidence_id = p.evidence_id))"""
)
def log_problems(spark, d):
    """The bad lines of an evidence log that was written in several files, by their numbers in the whole."""
    cards, at = relation(spark, d, "cards"), fresh_path(spark, "log")
    known = F.when(F.col("n") % 50 == 13, "E777").otherwise(F.col("evidence_id")).alias("evidence_id")
    card = F.to_json(F.struct(known, "kind", "title", F.struct(F.col("source_name").alias("display_name"), F.lit("p").alias("path")).alias("source"), F.lit("x").alias("excerpt")))
    line = F.when(F.col("n") % 50 == 7, "{broken").when(F.col("n") % 50 == 11, "[1]").when(F.col("n") % 50 == 9, " ").otherwise(card)
    cards.select("n", line.alias("value")).repartitionByRange(5, "n").sortWithinPartitions("n").select("value").write.text(at)
    return files.check_log(spark, at)


@query(f"SELECT n, {_SIGNATURE} AS signature FROM cards")
def evidence_signature(spark, d):
    return relation(spark, d, "cards").select("n", evidence.signature().alias("signature"))


@query(
    f"""WITH s AS (SELECT n, evidence_id, {_SIGNATURE} AS signature FROM cards), old AS (SELECT * FROM s WHERE n <= 200 AND regexp_matches(evidence_id, '^E[0-9]+$')),
    k AS (SELECT signature, min(n) AS n FROM s WHERE n > 200 AND signature NOT IN (SELECT signature FROM old) GROUP BY signature),
    a AS (SELECT signature, n, (SELECT coalesce(max(substr(evidence_id, 2)::BIGINT), 0) FROM old) + row_number() OVER (ORDER BY n) AS number FROM k)
    SELECT n, signature, CASE WHEN number < 1000 THEN 'E' || lpad(number::VARCHAR, 3, '0') ELSE 'E' || number::VARCHAR END AS evidence_id FROM a"""
)
def evidence_append(spark, d):
    at = relation(spark, d, "cards").withColumn("signature", evidence.signature())
    old = at.where("n <= 200").where(F.col("evidence_id").rlike("^E[0-9]+$"))
    return evidence.append(old, at.where("n > 200"), "n").select("n", "signature", "evidence_id")


@query(f"WITH r AS ({_REFS}) SELECT id, evidence_id, count(*) AS n FROM r WHERE evidence_id NOT IN (SELECT evidence_id FROM cards) GROUP BY id, evidence_id")
def unknown_refs(spark, d):
    refs = evidence.cited(relation(spark, d, "documents_md"))
    return refs.join(relation(spark, d, "cards"), "evidence_id", "left_anti").groupBy("id", "evidence_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH r AS (SELECT DISTINCT evidence_id FROM ({_REFS})), c AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY n) AS rn FROM cards)
    SELECT evidence_id, kind, title, CASE WHEN kind IN ('fingerprint_comparison', 'search_result') AND raw_sha <> '' THEN '' ELSE source_path END AS source_path, substr(evidence_id, 2)::BIGINT AS number
    FROM c JOIN r USING (evidence_id) WHERE rn = 1"""
)
def public_evidence(spark, d):
    return evidence.public(relation(spark, d, "cards"), evidence.cited(relation(spark, d, "documents_md")))


@query(
    f"""WITH r AS ({_REFS}), s AS (SELECT DISTINCT evidence_id, r.path AS document, coalesce(section, '') AS section, 'module-' || module_id AS anchor FROM r JOIN documents_md d ON d.id = r.id)
    SELECT evidence_id, count(*) AS n, string_agg(document || '#' || section || '#' || anchor, '|' ORDER BY document, section, anchor) AS places FROM s GROUP BY evidence_id"""
)
def reverse_references(spark, d):
    return evidence.reverse_references(relation(spark, d, "documents_md"), F.concat(F.lit("module-"), F.col("module_id")))


@query("SELECT evidence_id, count(*) AS n FROM (SELECT 'E' || lpad((n % 900)::VARCHAR, 3, '0') AS evidence_id FROM cards) GROUP BY evidence_id HAVING count(*) > 1")
def duplicate_keys(spark, d):
    numbered = relation(spark, d, "cards").select(F.concat(F.lit("E"), F.lpad((F.col("n") % 900).cast("string"), 3, "0")).alias("evidence_id"))
    return evidence.duplicates(numbered, "evidence_id")


@query("SELECT c.pack, c.commit, c.author, c.subject, length(c.body) AS body_chars, coalesce(p.commit, '') AS parent, c.author || ':' || substr(c.commit, 1, 12) AS locator FROM commits c LEFT JOIN commits p ON p.id = c.parent_id")
def commit_meta(spark, d):
    return evidence.commit_rows(relation(spark, d, "commits"))


@query(
    """SELECT pack, count(DISTINCT path) AS files, coalesce(sum(try_cast(additions AS BIGINT)), 0)::BIGINT AS additions, coalesce(sum(try_cast(deletions AS BIGINT)), 0)::BIGINT AS deletions, count(*) FILTER (additions = '-') AS binary FROM commits GROUP BY pack"""
)
def commit_stats(spark, d):
    return evidence.commit_stats(relation(spark, d, "commits"))


@query(
    f"""WITH s AS (SELECT n, {_SIGNATURE} AS signature FROM cards), k AS (SELECT signature, min(n) AS n FROM s GROUP BY signature),
    a AS (SELECT signature, n, row_number() OVER (ORDER BY n) AS number FROM k)
    SELECT n, signature, CASE WHEN number < 1000 THEN 'E' || lpad(number::VARCHAR, 3, '0') ELSE 'E' || number::VARCHAR END AS evidence_id FROM a"""
)
def evidence_stream(spark, d):
    """The evidence log fed as a stream: signatures seen before are dropped, ids are given batch by batch."""
    return ingest.run_once(relation(spark, d, "cards"), evidence.signature())


# --- report ----------------------------------------------------------------------------------

_BUCKET = "CASE WHEN status = 'absent' THEN 'absent' WHEN originality LIKE 'adapted%' THEN 'adapted' WHEN originality IN ('novel', 'inherited', 'external', 'uncertain') THEN originality ELSE 'uncertain' END"


@query(f"SELECT work_id, {_BUCKET} AS bucket, count(*) AS n FROM documents_md WHERE path LIKE 'modules/%' GROUP BY 1, 2")
def module_summary(spark, d):
    modules = relation(spark, d, "documents_md").where(F.col("path").startswith("modules/"))
    return modules.groupBy("work_id", report.bucket(F.col("status"), F.col("originality")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT work_id, coalesce(string_agg(DISTINCT contract, ',' ORDER BY contract) FILTER (status = 'findings' AND lower(public) <> 'false'), '') AS risk_tags FROM documents_md GROUP BY work_id")
def risk_tags(spark, d):
    return report.risk_tags(relation(spark, d, "documents_md"))


@query(
    f"""WITH m AS (SELECT work_id, {_BUCKET} AS bucket, count(*) AS n FROM documents_md WHERE path LIKE 'modules/%' GROUP BY 1, 2)
    SELECT work_id, string_agg(bucket || '=' || n, ',' ORDER BY bucket) AS summary, 'report.md' AS markdown, work_id || '/site/report.html' AS html FROM m GROUP BY work_id"""
)
def site_index(spark, d):
    return report.site_index(relation(spark, d, "documents_md"))


@query("SELECT work_id, sha256(string_agg(path || chr(0) || sha256(body) || chr(10), '' ORDER BY path)) AS digest FROM documents_md WHERE path LIKE 'modules/%' OR path LIKE 'findings/%' GROUP BY work_id")
def material_digest(spark, d):
    return report.material_digest(relation(spark, d, "documents_md"))


_TITLES = ["整体结论", "重点结论", "真实工作量分层", "Base、其他来源与同届传播关系", "内核架构图", "文档声明审查", "开发历史与 AI 使用", "测评定向与结果真实性", "模块实现细节及 Base 差异", "证据索引", "x"]


@query(
    f"""SELECT id, {_TITLES!r}[id % 11 + 1] AS title, ['overview', 'overview', 'lineage', 'lineage', 'architecture', 'risk', 'risk', 'risk', 'modules', 'evidence', 'evidence'][id % 11 + 1] AS view FROM documents_md"""
)
def section_view(spark, d):
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (F.col("id") % 11 + 1).cast("int"))
    return relation(spark, d, "documents_md").select("id", title.alias("title"), report.section_view(title).alias("view"))


@query("SELECT id, module_id, CASE module_id WHEN 'memory' THEN 'Memory' WHEN 'scheduler' THEN 'Scheduling' WHEN 'network' THEN 'Networking' ELSE module_id END AS title FROM documents_md")
def module_titles(spark, d):
    return report.module_titles(relation(spark, d, "documents_md"), {"memory": "Memory", "scheduler": "Scheduling", "network": "Networking"})


@query("SELECT unnest(['paging', 'heap', 'runqueue', 'sockets']) AS node, unnest(['memory', 'memory', 'scheduler', 'network']) AS owner")
def node_owner(spark, d):
    return report.node_owner(spark.createDataFrame([("memory", ["paging", "heap"]), ("scheduler", ["runqueue"]), ("network", ["sockets"])], "module_id string, nodes array<string>"))


@query()
def compile_report(spark, d):
    """One JSON row for each work: sections, modules and cited evidence."""
    return report.compiled(relation(spark, d, "documents_md"), relation(spark, d, "cards"))
