"""Queries over the contract rules: issues by family, and what is made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import evidence, report, rules
from tallyloom.plans.findings import _REFS, _REGISTRY
from tallyloom.plans.registry import query
from tallyloom.plans.texts import _BARE, _FORK, _HEADS, _LEN
from tallyloom.sources.adapters import relation

MODULES = {"memory": ["node-1", "node-2"], "scheduler": ["node-3", "node-4"], "network": ["node-5"]}
REQUIRED, ALLOWED = ["Detail", "Evidence"], ["Evidence", "Related"]


def _rule(code: str, test: str, detail: str, subject: str, rel: str) -> str:
    return f"SELECT CAST({subject} AS VARCHAR) AS subject, '{code}' AS code, CAST({detail} AS VARCHAR) AS detail FROM {rel} WHERE {test}"


def _rules(*rows: tuple) -> str:
    return " UNION ALL ".join(_rule(*r) for r in rows)


_IDENTITY = f"WITH r AS ({_REGISTRY}) " + _rules(
    *[("identity.missing_field", f"{c} = ''", f"'{c}'", "ord", "r") for c in rules.IDENTITY_FIELDS],
    ("identity.repository_type", "repository_type NOT IN ('competition', 'reference')", "repository_type", "ord", "r"),
    ("identity.reference_metadata", "repository_type = 'competition' AND (reference_kind <> '' OR module_ids <> '')", "''", "ord", "r"),
    ("identity.reference_kind", "repository_type = 'reference' AND reference_kind NOT IN ('kernel', 'framework', 'component')", "reference_kind", "ord", "r"),
    ("identity.reference_modules", "repository_type = 'reference' AND reference_kind IN ('kernel', 'framework', 'component') AND (reference_kind = 'component') <> (module_ids <> '')", "reference_kind", "ord", "r"),
    ("identity.reference_module", "m NOT IN ('', 'memory', 'scheduler', 'network')", "m", "ord", "(SELECT ord, unnest(string_split(module_ids, ',')) AS m FROM r WHERE repository_type = 'reference')"),
)


@query(_IDENTITY)
def rules_identity(spark, d):
    return rules.identity(report.registry(relation(spark, d, "works")), list(MODULES))


_FIELDS = _rules(
    ("structure.missing_contract", "contract = ''", "''", "id", "documents_md"),
    ("structure.unknown_contract", "contract NOT IN ('', 'module', 'finding', 'report', 'base')", "contract", "id", "documents_md"),
    ("structure.invalid_enum", "contract = 'module' AND status NOT IN ('implemented', 'partial', 'minimal', 'absent')", "'status=' || status", "id", "documents_md"),
    ("structure.invalid_enum", "contract = 'module' AND originality NOT IN ('novel', 'adapted_major', 'adapted_minor', 'inherited', 'external', 'uncertain')", "'originality=' || originality", "id", "documents_md"),
    ("structure.invalid_public", "contract = 'finding' AND (lower(public) NOT IN ('true', 'false') OR (lower(public) = 'true') <> (status = 'findings'))", "public", "id", "documents_md"),
    ("structure.module_path_mismatch", "contract = 'module' AND path NOT LIKE 'modules/%'", "path", "id", "documents_md"),
    ("structure.finding_path_mismatch", "contract = 'finding' AND path NOT LIKE 'findings/%'", "path", "id", "documents_md"),
)


@query(_FIELDS)
def rules_fields(spark, d):
    return rules.structure_fields(relation(spark, d, "documents_md"), ["module", "finding", "report", "base"])


_HEADINGS = f"""WITH h AS ({_HEADS}), s AS (SELECT h.*, coalesce(lead(line) OVER (PARTITION BY id ORDER BY line), total + 1) AS stop, ls FROM h JOIN ({_LEN}) ON did = id),
b AS (SELECT id, line, level, title, trim(array_to_string(ls[line + 1 : stop - 1], ' ')) <> '' AS own FROM s),
e AS (SELECT b.*, coalesce((SELECT min(c.line) FROM b c WHERE c.id = b.id AND c.line > b.line AND c.level <= b.level), 1000000) AS until FROM b WHERE title IN ('Detail', 'Evidence')),
f AS (SELECT e.id, e.line, e.title, bool_or(c.own) AS filled FROM e JOIN b c ON c.id = e.id AND c.line >= e.line AND c.line < e.until GROUP BY ALL),
g AS (SELECT id, title, arg_min(filled, line) AS filled FROM f GROUP BY id, title),
o AS (SELECT id, title, line, lag(list_position(['Detail', 'Evidence'], title)) OVER (PARTITION BY id ORDER BY line) > list_position(['Detail', 'Evidence'], title) AS wrong FROM h WHERE title IN ('Detail', 'Evidence')),
l AS (SELECT id, arg_max(title, line) AS last, bool_or(title = 'Related') AS there FROM h WHERE level = 2 GROUP BY id),
q AS (SELECT id, unnest(['Detail', 'Evidence']) AS title FROM documents_md) """ + _rules(
    ("structure.h1", "n <> 1", "n", "id", "(SELECT d.id, count(h.id) AS n FROM documents_md d LEFT JOIN h ON h.id = d.id AND level = 1 GROUP BY d.id)"),
    ("structure.missing_heading", "NOT EXISTS (SELECT 1 FROM h WHERE h.id = q.id AND h.title = q.title)", "title", "id", "q"),
    ("structure.empty_heading", "NOT filled", "title", "id", "g"),
    ("structure.heading_order", "TRUE", "''", "id", "(SELECT DISTINCT id FROM o WHERE wrong)"),
    ("structure.unknown_h2", "level = 2 AND title NOT IN ('Evidence', 'Related')", "title", "id", "h"),
    ("structure.optional_heading_order", "there AND last <> 'Related'", "'Related'", "id", "l"),
    ("structure.heading_depth", "level > 3", "title", "id", "h"),
)


@query(_HEADINGS)
def rules_headings(spark, d):
    return rules.structure_headings(relation(spark, d, "documents_md"), REQUIRED, ALLOWED, "Related")


@query(
    f"WITH h AS ({_HEADS}), n AS (SELECT id, regexp_extract(title, '^([a-z][a-z0-9-]*)(?:：|:)\\s*.+$', 1) AS node FROM h WHERE regexp_matches(title, '^([a-z][a-z0-9-]*)(?:：|:)\\s*.+$')), m AS (SELECT * FROM documents_md WHERE contract = 'module') "
    + _rules(
        ("taxonomy.unknown_module", "module_id NOT IN ('memory', 'scheduler', 'network')", "module_id", "id", "m"),
        (
            "taxonomy.unknown_node",
            "CASE WHEN node IN ('node-1', 'node-2') THEN 'memory' WHEN node IN ('node-3', 'node-4') THEN 'scheduler' WHEN node = 'node-5' THEN 'network' ELSE '' END <> module_id",
            "node",
            "id",
            "(SELECT m.id, module_id, node FROM n JOIN m USING (id))",
        ),
    )
)
def rules_taxonomy(spark, d):
    return rules.taxonomy_use(relation(spark, d, "documents_md"), MODULES)


_NODES = [("memory", "runtime", "paging", "Paging", "describe"), ("memory", "runtime", "heap", "", "describe"), ("scheduler", "core", "paging", "Paging", "describe"), ("network", "runtime", None, None, None), ("io", "runtime", "old_pipe", "Old pipe", " ")]


@query(
    """SELECT * FROM (VALUES ('scheduler', 'taxonomy.invalid_architecture_role', 'core'), ('network', 'taxonomy.empty_module', ''), ('paging', 'taxonomy.duplicate_node', '2'),
    ('heap', 'taxonomy.incomplete_node', ''), ('old_pipe', 'taxonomy.incomplete_node', ''), ('old_pipe', 'taxonomy.deleted_present', 'old-pipe'), ('sockets', 'taxonomy.required_missing', '')) t(subject, code, detail)"""
)
def rules_taxonomy_itself(spark, d):
    nodes = spark.createDataFrame(_NODES, "module_id string, role string, node_id string, title string, requirement string")
    return rules.taxonomy_itself(nodes, ["build", "runtime", "support"], ["paging", "sockets"], ["old-pipe"])


@query(
    _rules(
        ("base.commit_missing", "status IN ('implemented', 'partial') AND NOT regexp_matches(commit_text, '^[0-9a-fA-F]{7,40}$')", "commit_text", "id", "documents_md"),
        ("base.introduction_kind", "status IN ('implemented', 'partial') AND originality NOT IN ('novel', 'inherited')", "originality", "id", "documents_md"),
        ("base.unexpected_value", "status = 'absent' AND commit_text <> ''", "commit_text", "id", "documents_md"),
    )
)
def rules_base(spark, d):
    return rules.base(relation(spark, d, "documents_md"))


@query(
    "WITH m AS (SELECT work_id, max(commit_text) AS locked_commit, 'r1' AS locked_ref FROM documents_md WHERE id % 3 = 0 GROUP BY work_id), b AS (SELECT d.*, CASE WHEN d.id % 2 = 0 THEN 'r1' ELSE 'r2' END AS ref, locked_commit, locked_ref FROM documents_md d LEFT JOIN m USING (work_id)) "
    + _rules(
        ("base.manifest_missing", "locked_commit IS NULL", "work_id", "id", "b"),
        ("base.target_ref_mismatch", "locked_commit IS NOT NULL AND ref <> locked_ref", "ref", "id", "b"),
        ("base.target_commit_mismatch", "locked_commit IS NOT NULL AND commit_text <> locked_commit", "commit_text", "id", "b"),
    )
)
def base_lock(spark, d):
    docs = relation(spark, d, "documents_md")
    manifest = docs.where("id % 3 = 0").groupBy("work_id").agg(F.max("commit_text").alias("locked_commit"), F.lit("r1").alias("locked_ref"))
    named = docs.withColumn("ref", F.when(F.col("id") % 2 == 0, "r1").otherwise("r2"))
    return rules.base_lock(named, manifest)


@query(
    f"""WITH r AS ({_REFS}), v AS (SELECT n, CASE WHEN NOT regexp_matches(evidence_id, '^E[0-9]{{3,}}$') THEN 'id' WHEN kind NOT IN ('source_span', 'document_span', 'git_commit', 'fingerprint_comparison', 'search_result') THEN 'kind'
    WHEN trim(title) = '' THEN 'title' WHEN trim(source_name) = '' THEN 'source' WHEN columns <> cells AND n % 3 = 0 THEN 'table' ELSE '' END AS problem FROM cards) """
    + _rules(
        ("evidence.invalid", "problem <> ''", "problem", "n", "v"),
        ("evidence.invalid", "TRUE", "'duplicate'", "evidence_id", "(SELECT evidence_id FROM cards GROUP BY evidence_id HAVING count(*) > 1)"),
        ("evidence.unknown_ref", "evidence_id NOT IN (SELECT evidence_id FROM cards)", "evidence_id", "id", "r"),
    )
)
def rules_evidence(spark, d):
    return rules.evidence_rules(relation(spark, d, "documents_md"), evidence.with_tables(relation(spark, d, "cards")))


@query(
    """WITH g AS (SELECT work_id, sha256(string_agg(path || chr(0) || sha256(body) || chr(10), '' ORDER BY path)) AS digest, min(id) AS k FROM documents_md WHERE path LIKE 'modules/%' OR path LIKE 'findings/%' GROUP BY work_id) """
    + _rules(
        ("contradiction.review_missing", "k % 4 = 0", "''", "work_id", "g"),
        ("contradiction.unresolved", "k % 4 <> 0 AND k % 3 = 0", "'unresolved'", "work_id", "g"),
        ("contradiction.review_stale", "k % 4 <> 0 AND k % 5 = 0", "''", "work_id", "g"),
    )
)
def rules_contradictions(spark, d):
    docs = relation(spark, d, "documents_md")
    material = docs.where(F.col("path").startswith("modules/") | F.col("path").startswith("findings/")).groupBy("work_id").agg(F.min("id").alias("k"))
    made = report.material_digest(docs).join(material, "work_id").where("k % 4 <> 0")
    state = F.when(F.col("k") % 3 == 0, "unresolved").otherwise("resolved")
    reviewed = made.select("work_id", F.when(F.col("k") % 5 == 0, F.lit("old")).otherwise(F.col("digest")).alias("reviewed"), state.alias("state"))
    return rules.contradictions(docs, reviewed)


@query(
    """WITH f AS (SELECT work_id, contract, bool_or(status = 'findings' AND lower(public) <> 'false') AS shown FROM documents_md WHERE path LIKE 'findings/%' GROUP BY ALL),
    s AS (SELECT DISTINCT work_id, contract FROM documents_md WHERE path LIKE 'reports/%' OR id % 7 = 0),
    j AS (SELECT coalesce(f.work_id, s.work_id) AS work_id, coalesce(f.contract, s.contract) AS contract, shown, s.work_id IS NOT NULL AS section FROM f FULL JOIN s ON f.work_id = s.work_id AND f.contract = s.contract) """
    + _rules(
        ("optional_section.without_source", "section AND shown IS NULL", "contract", "work_id", "j"),
        ("optional_section.missing_public", "shown AND NOT section", "contract", "work_id", "j"),
        ("optional_section.hidden_leak", "section AND NOT shown", "contract", "work_id", "j"),
    )
)
def optional_sections(spark, d):
    docs = relation(spark, d, "documents_md")
    shown = F.bool_or((F.col("status") == "findings") & (F.lower("public") != "false"))
    found = docs.where(F.col("path").startswith("findings/")).groupBy("work_id", "contract").agg(shown.alias("shown"))
    return rules.optional_sections(found, docs.where(F.col("path").startswith("reports/") | (F.col("id") % 7 == 0)).select("work_id", "contract").distinct())


_BLOCKS = r"(SELECT id, len(list_filter(list_transform(regexp_extract_all(body, '(?is)```mermaid\s*\n(.*?)\n```', 1), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents_md)"


@query(_rules(("architecture_graph.missing_mermaid", "n = 0", "''", "id", _BLOCKS), ("architecture_graph.multiple_mermaid", "n > 1", "n", "id", _BLOCKS)))
def rules_graph(spark, d):
    return rules.architecture_graph(relation(spark, d, "documents_md"))


@query(
    _rules(
        ("identity.platform_fork_leak", f"path <> 'identity.md' AND regexp_matches(body, '{_FORK}')", "''", "id", "documents_md"),
        ("identity.bare_suffix_name", f"path <> 'identity.md' AND regexp_matches(body, '{_BARE}')", "''", "id", "documents_md"),
    )
)
def rules_leaks(spark, d):
    return rules.leaks(relation(spark, d, "documents_md"))


@query(
    _rules(
        ("identity.report_title", "strpos(title, display_name) = 0", "title", "id", r"(SELECT d.id, regexp_extract(split_part(body, chr(10), 1), '^#\s+(.+?)\s*$', 1) AS title, CASE WHEN right(d.work_id, 1) = '2' THEN 'small' ELSE d.work_id END AS display_name FROM documents_md d WHERE contract = 'report')")
    )
)
def rules_report_title(spark, d):
    docs = relation(spark, d, "documents_md")
    works = docs.select("work_id").distinct().withColumn("display_name", F.when(F.endswith("work_id", F.lit("2")), F.lit("small")).otherwise(F.col("work_id")))
    return rules.report_title(docs, works)


@query(
    "WITH c AS (SELECT DISTINCT work_id FROM documents_md) "
    + _rules(
        ("structure.missing_file", "NOT EXISTS (SELECT 1 FROM documents_md d WHERE d.work_id = w.work_id AND d.path = w.path)", "path", "work_id", "(SELECT work_id, unnest(['report.md', 'modules/m4.md']) AS path FROM c) w"),
        ("structure.missing_modules", "NOT EXISTS (SELECT 1 FROM documents_md d WHERE d.work_id = c.work_id AND d.path LIKE 'modules/%')", "''", "work_id", "c"),
    )
)
def rules_documents(spark, d):
    return rules.document_presence(relation(spark, d, "documents_md"), ["report.md", "modules/m4.md"])


@query(f"SELECT count(*) = 0 AS ok, count(*) AS issues FROM ({_IDENTITY.replace('WITH r AS (' + _REGISTRY + ') ', '').replace('FROM r ', f'FROM ({_REGISTRY}) r ')})")
def validation_ok(spark, d):
    return rules.ok(rules.identity(report.registry(relation(spark, d, "works")), list(MODULES)))


@query(f"SELECT '[error] ' || code || ' ' || subject || ': ' || coalesce(detail, '') AS line FROM ({_FIELDS})")
def issue_format(spark, d):
    return rules.formatted(rules.structure_fields(relation(spark, d, "documents_md"), ["module", "finding", "report", "base"]))
