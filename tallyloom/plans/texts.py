"""Queries over source text and Markdown: instructions, shapes, headings, anchors, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import texts as T
from tallyloom.operators import code_units, markdown, units
from tallyloom.plans.registry import query
from tallyloom.sources.adapters import relation

_STRIP = "trim(split_part(split_part(split_part(x, '#', 1), '//', 1), ';', 1))"
_LINES = r"""SELECT id, unnest(range(1, len(ls) + 1)) AS n, unnest(list_transform(ls, lambda x: """ + _STRIP + r""")) AS line
FROM (SELECT id, string_split(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), chr(10)) AS ls FROM sources)"""
_ITEMS = (
    r"""SELECT id, n, list_transform(list_filter(string_split_regex(regexp_replace(line, '([(),])', ' \1 ', 'g'), '\s+'), lambda w: w <> ''),
lambda w, i: CASE WHEN i = 1 THEN lower(w) WHEN w IN ('(', ')', ',') THEN w WHEN regexp_matches(w, '"""
    + T.REGISTER
    + r"""') THEN 'REG' WHEN regexp_matches(w, '"""
    + T.NUMBER
    + r"""') THEN w ELSE 'LBL' END) AS items FROM (""" + _LINES + r""") l
WHERE line <> '' AND NOT regexp_matches(line, '""" + T.LABEL + r"""')"""
)
_HEADS = r"""SELECT id, path, line, len(regexp_extract(t, '^(#{1,6})\s+(.+?)\s*$', 1)) AS level, regexp_extract(t, '^(#{1,6})\s+(.+?)\s*$', 2) AS title
FROM (SELECT id, path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM (SELECT id, path, string_split(body, chr(10)) AS ls FROM documents_md)) WHERE regexp_matches(t, '^(#{1,6})\s+(.+?)\s*$')"""
_LEN = "SELECT id AS did, len(string_split(body, chr(10))) AS total, string_split(body, chr(10)) AS ls FROM documents_md"


def documents(spark, d):
    return relation(spark, d, "documents_md")


# --- source text -----------------------------------------------------------------------------


@query(f"SELECT id, string_agg(line, chr(10) ORDER BY n) AS code FROM ({_LINES}) GROUP BY id")
def strip_comments(spark, d):
    at = relation(spark, d, "sources")
    stripped = F.transform(F.split(T.strip_block_comments(F.col("text")), "\n", -1), lambda x: F.trim(T.strip_line_comment(x)))
    return at.select("id", F.array_join(stripped, "\n").alias("code"))


@query(f"SELECT id, n::BIGINT AS n, array_to_string(items, ' ') AS items FROM ({_ITEMS})")
def asm_tokens(spark, d):
    return units.instruction_lines(relation(spark, d, "sources")).select("id", F.col("n").cast("long").alias("n"), F.array_join("items", " ").alias("items"))


@query(f"SELECT id, sha256(string_agg(array_to_string(items, ' '), ' ' ORDER BY n)) AS shape FROM ({_ITEMS}) GROUP BY id")
def asm_shape(spark, d):
    return units.whole_shape(relation(spark, d, "sources"))


_BLOCKS = (
    """SELECT l.id, n, line, regexp_matches(line, '""" + T.LABEL + """') AS is_label, count(*) FILTER (regexp_matches(line, '""" + T.LABEL + """')) OVER (PARTITION BY l.id ORDER BY n) AS block
    FROM (""" + _LINES + """) l WHERE line <> ''"""
)


@query(
    f"""WITH b AS ({_BLOCKS}), i AS ({_ITEMS}),
    u AS (SELECT b.id, block::BIGINT AS block, coalesce(max(CASE WHEN is_label THEN regexp_extract(line, '{T.LABEL}', 1) END), '(file)') AS label, sum(coalesce(len(items), 0))::INT AS n_items, string_agg(array_to_string(items, ' '), ' ' ORDER BY b.n) AS text
      FROM b LEFT JOIN i ON i.id = b.id AND i.n = b.n GROUP BY b.id, block)
    SELECT id, block, label, n_items, sha256(text) AS shape, 'unit_' || substr(sha256(id || chr(0) || label || chr(0) || 'asm'), 1, 16) AS unit_id FROM u WHERE n_items >= {units.LEAST_ITEMS}"""
)
def asm_units(spark, d):
    """One unit for each label block with enough items; blocks by a running count of labels."""
    return units.assembly_units(relation(spark, d, "sources"))


@query()
def unit_extract(spark, d):
    """Blocks of a text as structural units with names, lines, shapes, literals and calls."""
    return units.text_units(relation(spark, d, "sources"))


@query()
def dom_shape(spark, d):
    """Tree shape of HTML pages: hash of a node's type and its children's hashes."""
    return units.dom_shapes(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "html")


@query(
    r"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '"([^"
]*)"', 1), regexp_extract_all(text, '\b[0-9]+\b')), lambda x: trim(x)), lambda x: len(x) BETWEEN 1 AND 200))), '|') AS literals FROM sources"""
)
def literal_set(spark, d):
    return relation(spark, d, "sources").select("id", F.array_join(T.literals(F.col("text")), "|").alias("literals"))


_SYMBOL = "CASE id % 4 WHEN 0 THEN 'while' WHEN 1 THEN 'println' WHEN 2 THEN 'Self' ELSE subject END"


@query(f"SELECT symbol, count(*) AS n FROM (SELECT {_SYMBOL} AS symbol FROM commits) WHERE symbol NOT IN ({', '.join(repr(k) for k in sorted(code_units.NO_NAMES))}) GROUP BY symbol")
def keyword_filter(spark, d):
    at = relation(spark, d, "commits").selectExpr(f"{_SYMBOL} AS symbol")
    return units.without_keywords(at, "symbol", tuple(code_units.NO_NAMES)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM texts")
def content_hash(spark, d):
    return relation(spark, d, "texts").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@query(
    """SELECT doc_id, n, line FROM (SELECT doc_id, unnest(range(1, len(ls) + 1))::INT AS n, unnest(ls) AS line
      FROM (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[1 : len(s) - 1] ELSE s END AS ls FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM texts)))
    WHERE n BETWEEN 2 AND 4"""
)
def line_span(spark, d):
    return markdown.line_span(relation(spark, d, "texts"), "doc_id", 2, 4)


@query(
    """WITH h AS (SELECT doc_id, unnest(range(1, len(ls) + 1))::INT AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM texts)),
    g AS (SELECT *, count(*) OVER () AS total FROM h WHERE regexp_matches(line, 'token = |Licensed'))
    SELECT doc_id, n, line, total FROM g ORDER BY doc_id, n LIMIT 100"""
)
def grep_search(spark, d):
    return markdown.grep(relation(spark, d, "texts"), "doc_id", "token = |Licensed", 100)


# --- Markdown --------------------------------------------------------------------------------


@query(
    f"""WITH h AS ({_HEADS}), s AS (SELECT h.*, coalesce(lead(line) OVER (PARTITION BY id ORDER BY line), total + 1) AS stop, ls FROM h JOIN ({_LEN}) ON did = id)
    SELECT id, line::INT AS line, level::INT AS level, title, (stop - 1)::INT AS end_line, array_to_string(ls[line + 1 : stop - 1], chr(10)) AS body FROM s"""
)
def heading_spans(spark, d):
    return markdown.heading_spans(documents(spark, d)).select("id", "line", "level", "title", "end_line", "body")


@query(
    f"""WITH h AS ({_HEADS} AND regexp_matches(t, '^##\\s')), s AS (SELECT h.*, coalesce(lead(line) OVER (PARTITION BY id ORDER BY line), total + 1) AS stop, ls FROM h JOIN ({_LEN}) ON did = id)
    SELECT id, line::INT AS line, title, trim(array_to_string(ls[line : stop - 1], chr(10)), chr(10) || ' ') AS markdown FROM s"""
)
def h2_sections(spark, d):
    return markdown.h2_sections(documents(spark, d))


@query(
    f"""WITH h AS ({_HEADS}), s AS (SELECT h.*, coalesce(lead(line) OVER (PARTITION BY id ORDER BY line), total + 1) AS stop, ls FROM h JOIN ({_LEN}) ON did = id),
    b AS (SELECT id, line, level, title, trim(array_to_string(ls[line + 1 : stop - 1], ' ')) <> '' AS own FROM s),
    e AS (SELECT b.*, coalesce((SELECT min(c.line) FROM b c WHERE c.id = b.id AND c.line > b.line AND c.level <= b.level), 1000000) AS until FROM b)
    SELECT e.id, e.line::INT AS line, e.title, bool_or(c.own) AS has_content FROM e JOIN b c ON c.id = e.id AND c.line >= e.line AND c.line < e.until GROUP BY ALL"""
)
def section_content(spark, d):
    return markdown.section_content(documents(spark, d))


@query(
    f"""WITH h AS ({_HEADS}), s AS (SELECT h.*, coalesce(lead(line) OVER (PARTITION BY id ORDER BY line), total + 1) AS stop, ls FROM h JOIN ({_LEN}) ON did = id),
    f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS rn FROM s WHERE title = 'Detail')
    SELECT d.id, f.id IS NOT NULL AS has_heading, coalesce(array_to_string(ls[line + 1 : stop - 1], chr(10)), '') AS body FROM documents_md d LEFT JOIN f ON f.id = d.id AND rn = 1"""
)
def section_lookup(spark, d):
    return markdown.section_lookup(documents(spark, d), "Detail")


@query(
    f"""WITH h AS ({_HEADS}), r AS (SELECT id, line, list_position(['Detail', 'Evidence', 'Related'], title) AS place FROM h WHERE list_position(['Detail', 'Evidence', 'Related'], title) IS NOT NULL),
    w AS (SELECT *, lag(place) OVER (PARTITION BY id ORDER BY line) AS before FROM r)
    SELECT id, NOT coalesce(bool_or(before > place), FALSE) AS in_order FROM w GROUP BY id"""
)
def heading_order(spark, d):
    return markdown.heading_order(documents(spark, d), ["Detail", "Evidence", "Related"])


@query(f"WITH h AS ({_HEADS} AND regexp_matches(t, '^##\\s')) SELECT id, arg_max(title, line) = 'Related' AS is_last FROM h WHERE id IN (SELECT id FROM h WHERE title = 'Related') GROUP BY id")
def optional_last(spark, d):
    return markdown.optional_last(documents(spark, d), "Related")


@query(r"SELECT id, array_to_string(regexp_extract_all(body, '\[@(E[0-9]{3,})\]', 1), ',') AS refs FROM documents_md")
def evidence_refs(spark, d):
    return documents(spark, d).select("id", F.array_join(T.references(F.col("body")), ",").alias("refs"))


@query(r"SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(t)), '\s+', '-', 'g'), '[^a-z0-9\x{4e00}-\x{9fff}-]+', '', 'g'), ''), 'section') AS slug FROM (SELECT id, CASE WHEN id % 9 = 0 THEN '!!' ELSE split_part(body, chr(10), 1) || ' 内核 ' || status END AS t FROM documents_md)")
def slugify(spark, d):
    text = F.when(F.col("id") % 9 == 0, F.lit("!!")).otherwise(F.concat(F.substring_index("body", "\n", 1), F.lit(" 内核 "), F.col("status")))
    return documents(spark, d).select("id", T.slugify(text).alias("slug"))


@query(r"SELECT id, len(list_filter(list_transform(regexp_extract_all(body, '(?is)```mermaid\s*\n(.*?)\n```', 1), lambda x: trim(x)), lambda x: x <> ''))::INT AS blocks FROM documents_md")
def mermaid_blocks(spark, d):
    return documents(spark, d).select("id", F.size(T.mermaid_blocks(F.col("body"))).alias("blocks"))


@query("SELECT id, commit_text, regexp_matches(commit_text, '^[0-9a-fA-F]{7,40}$') AS ok FROM documents_md")
def commit_format(spark, d):
    return documents(spark, d).select("id", "commit_text", F.col("commit_text").rlike(T.COMMIT).alias("ok"))


@query(
    f"""WITH h AS ({_HEADS}), n AS (SELECT id, regexp_extract(title, '^([a-z][a-z0-9-]*)(?:：|:)\\s*.+$', 1) AS node FROM h WHERE regexp_matches(title, '^([a-z][a-z0-9-]*)(?:：|:)\\s*.+$'))
    SELECT id, node, node IN ('node-1', 'node-2', 'deep') AS known FROM n"""
)
def node_headings(spark, d):
    return markdown.node_headings(documents(spark, d), ["node-1", "node-2", "deep"])


@query(r"SELECT doc_id, len(list_filter(['licensed-under', 'all-rights', 'gpl'], lambda l: strpos(regexp_replace(lower(coalesce(text, '')), '[ _/]', '-', 'g'), l) > 0))::INT AS found FROM texts")
def label_scan(spark, d):
    return relation(spark, d, "texts").select("doc_id", F.size(markdown.labels_in(F.coalesce("text", F.lit("")), ["licensed-under", "all-rights", "gpl"])).alias("found"))


@query()
def code_anchors(spark, d):
    return documents(spark, d).select("id", F.array_join(T.code_anchors(F.col("body")), "|").alias("anchors"))


_FORK, _BARE = r"\bT20[0-9]{10,}-[0-9]+\b", r"(^|[^A-Za-z0-9])[0-9]{2,4}\s*(作品|队伍|仓库|报告)"


@query(f"SELECT id, regexp_matches(body, '{_FORK}') AS fork_id, regexp_matches(body, '{_BARE}') AS bare_suffix FROM documents_md")
def leak_scan(spark, d):
    body = F.col("body")
    return documents(spark, d).select("id", body.rlike(T.FORK_ID).alias("fork_id"), body.rlike(T.BARE_SUFFIX).alias("bare_suffix"))


@query()
def frontmatter(spark, d):
    return markdown.frontmatter(markdown.whole_text(documents(spark, d)), "text").select("id", "keys", "contract", "status")


@query()
def markdown_scan(spark, d):
    return markdown.parsed(markdown.whole_text(documents(spark, d)))


@query("SELECT id, path, CASE WHEN path LIKE 'modules/%' THEN 100 ELSE 200 END::BIGINT AS rank FROM documents_md WHERE path LIKE 'modules/%' OR path LIKE 'findings/%'")
def document_set(spark, d):
    """The documents of a case in their fixed order: named files, then modules, then findings."""
    return markdown.document_set(documents(spark, d))
