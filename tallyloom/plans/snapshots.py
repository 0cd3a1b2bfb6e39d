"""Queries over snapshots: scans, paths and scopes, bag comparison, candidate search, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import paths as P
from tallyloom.operators import bags, code_units, commitgraph, headrecord, pages, recall, results, search, store
from tallyloom.operators.cuts import durable, fresh_path
from tallyloom.plans.registry import query
from tallyloom.sources.adapters import relation

LEFT, RIGHT = "w1", "w2"
INCLUDE, EXCLUDE = ["src0/", "src1\\A", "", " src2 "], ["src0/R", "src2/N"]
_SUFFIXES = ", ".join(f"'{s}'" for s in P.BLOB_SUFFIXES)
_SUFFIX_SQL = "regexp_extract(split_part({p}, '/', -1), '^.+(\\.[^.]+)$', 1)"
_PARENT_SQL = "CASE WHEN strpos({p}, '/') = 0 THEN '(root)' ELSE regexp_extract({p}, '^(.*)/[^/]*$', 1) END"
_SCOPE_SQL = (
    "(path = 'src0' OR starts_with(path, 'src0/') OR path = 'src1/A' OR starts_with(path, 'src1/A/') OR path = 'src2' OR starts_with(path, 'src2/')) "
    "AND NOT (path = 'src0/R' OR starts_with(path, 'src0/R/') OR path = 'src2/N' OR starts_with(path, 'src2/N/'))"
)


def sides(spark: SparkSession, sf_dir: str, name: str = "bag") -> tuple[DataFrame, DataFrame]:
    bag = relation(spark, sf_dir, name)
    return bag.where(F.col("work_id") == LEFT), bag.where(F.col("work_id") == RIGHT)


# --- scans -----------------------------------------------------------------------------------


@query("SELECT work_id, kind, count(*) AS entries, count(DISTINCT path) AS paths FROM tree GROUP BY work_id, kind")
def tree_scan(spark, d):
    return relation(spark, d, "tree").groupBy("work_id", "kind").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("path").alias("paths"))


@query(
    f"SELECT work_id, path, blob, size FROM tree WHERE kind = 'blob' AND {_SUFFIX_SQL.format(p='path')} IN ('.c', '.rs') AND size <= 4194304 "
    "AND NOT (path = 'src0' OR starts_with(path, 'src0/'))"
)
def source_blob_scan(spark, d):
    return search.source_blobs(relation(spark, d, "tree"), [".c", ".rs"], exclude=["src0"]).select("work_id", "path", "blob", "size")


@query("SELECT blob, max(size) AS size FROM tree WHERE kind = 'blob' GROUP BY blob")
def blob_sizes(spark, d):
    return relation(spark, d, "tree").where("kind = 'blob'").groupBy("blob").agg(F.max("size").alias("size"))


@query("SELECT work_id, bool_or(path = 'src1/A' OR starts_with(path, 'src1/A/')) AS found FROM tree GROUP BY work_id")
def path_exists(spark, d):
    return relation(spark, d, "tree").groupBy("work_id").agg(F.bool_or(P.under(F.col("path"), F.lit("src1/A"))).alias("found"))


@query("SELECT DISTINCT work_id, split_part(path, '/', 1) AS dir FROM tree WHERE strpos(path, '/') > 0 AND NOT starts_with(path, '.')")
def top_level_dirs(spark, d):
    inner = relation(spark, d, "tree").where(F.contains("path", F.lit("/")) & ~F.startswith("path", F.lit(".")))
    return inner.select("work_id", P.top_dir(F.col("path")).alias("dir")).distinct()


@query("SELECT work_id, blob, path FROM bag WHERE blob <> '' AND path <> ''")
def cache_scan(spark, d):
    return relation(spark, d, "bag").where("blob <> '' and path <> ''").select("work_id", "blob", "path")


@query(
    "SELECT work_id, count(*) AS n_paths, sum(len(path))::BIGINT AS chars, count(*) FILTER (kind = 'commit') AS submodules FROM tree GROUP BY work_id"
)
def inventory(spark, d):
    at = relation(spark, d, "tree").groupBy("work_id")
    return at.agg(F.count(F.lit(1)).alias("n_paths"), F.sum(F.length("path")).alias("chars"), F.count_if(F.col("kind") == "commit").alias("submodules"))


@query(f"SELECT work_id, coalesce(nullif(lower({_SUFFIX_SQL.format(p='path')}), ''), '<none>') AS suffix, count(*) AS n FROM tree GROUP BY 1, 2")
def suffix_histogram(spark, d):
    suffix = F.coalesce(F.nullif(F.lower(P.file_suffix(F.col("path"))), F.lit("")), F.lit("<none>"))
    return relation(spark, d, "tree").groupBy("work_id", suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT work_id, path, blob, mode FROM tree WHERE kind = 'blob' AND {_SUFFIX_SQL.format(p='path')} IN ({_SUFFIXES})")
def suffix_filter(spark, d):
    return search.fingerprint_rows(relation(spark, d, "tree")).select("work_id", "path", "blob", "mode")


@query(
    f"""WITH f AS (SELECT work_id, path, blob FROM tree WHERE kind = 'blob' AND {_SUFFIX_SQL.format(p='path')} IN ({_SUFFIXES})),
    u AS (SELECT work_id, count(*) AS units FROM units WHERE shape <> '' GROUP BY work_id)
    SELECT f.work_id, count(*) AS files, count(DISTINCT blob) AS blobs, coalesce(max(u.units), 0) AS units, sha256(string_agg(path || chr(0) || blob, chr(10) ORDER BY path, blob)) AS digest
    FROM f LEFT JOIN u USING (work_id) GROUP BY f.work_id"""
)
def snapshot_build(spark, d):
    return search.snapshot_manifest(search.fingerprint_rows(relation(spark, d, "tree")), relation(spark, d, "units").where("shape <> ''"))


@query(
    f"""WITH f AS (SELECT work_id, path, blob FROM tree WHERE kind = 'blob' AND {_SUFFIX_SQL.format(p='path')} IN ({_SUFFIXES})),
    u AS (SELECT work_id, count(*) AS units FROM units WHERE shape <> '' GROUP BY work_id),
    h AS (SELECT work_id, commit FROM heads), g AS (SELECT work_id, count(*) AS files, sha256(string_agg(path || chr(0) || blob, chr(10) ORDER BY path, blob)) AS digest FROM f GROUP BY work_id)
    SELECT h.work_id, h.commit, coalesce(g.files, 0) AS files, coalesce(u.units, 0) AS units, coalesce(g.digest, sha256('')) AS digest, CASE WHEN ends_with(h.work_id, '1') THEN 0 ELSE 1 END::BIGINT AS ord
    FROM h LEFT JOIN g USING (work_id) LEFT JOIN u USING (work_id)"""
)
def snapshot_store(spark, d):
    """A store built in three runs: some works first, then all, of which only those that lack are built, then none."""
    at = fresh_path(spark, "store")
    heads, files = relation(spark, d, "heads"), search.fingerprint_rows(relation(spark, d, "tree"))
    units = relation(spark, d, "units").where("shape <> ''")
    for wanted in (heads.where("work_id LIKE '%1'"), heads, heads):
        store.build(spark, at, wanted, files, units)
    return store.visible(spark, at, heads).select("work_id", "commit", "files", "units", "digest", "ord")


@query("SELECT work_id, count(*) AS files, count(DISTINCT path) AS paths FROM bag GROUP BY work_id")
def snapshot_counts(spark, d):
    return relation(spark, d, "bag").groupBy("work_id").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("path").alias("paths"))


@query(
    """WITH m AS (SELECT work_id, max(ord) % 4 AS v, max(ord) % 3 AS a FROM bag GROUP BY work_id)
    SELECT h.work_id, h.commit FROM heads h JOIN m ON m.work_id = h.work_id WHERE v = 3 AND a > 0"""
)
def cache_completeness(spark, d):
    """Works whose cached snapshot can be used again: of the commit wanted, with all components, made by this version of the shape hash."""
    heads = relation(spark, d, "heads")
    made = relation(spark, d, "bag").groupBy("work_id").agg((F.max("ord") % 4).alias("v"), (F.max("ord") % 3).alias("a")).join(heads, "work_id")
    parts = F.when(F.col("a") > 0, F.array(F.lit("blob"), F.lit("ast"))).otherwise(F.array(F.lit("blob")))
    version = F.when(F.col("v") == 3, results.SHAPE_VERSION).otherwise("v0")
    snapshots = made.select("work_id", "commit", parts.alias("components"), version.alias("shape_version"))
    return results.reusable(snapshots, heads.select("work_id", "commit"))


# --- paths -----------------------------------------------------------------------------------


@query("SELECT id, trim(trim(replace(raw, chr(92), '/')), '/') AS prefix FROM raw_paths")
def clean_prefix(spark, d):
    return relation(spark, d, "raw_paths").select("id", P.clean_prefix(F.col("raw")).alias("prefix"))


@query("SELECT id, ltrim(regexp_replace(raw, '^(\\./)+', ''), '/') AS path FROM raw_paths")
def clean_rel(spark, d):
    return relation(spark, d, "raw_paths").select("id", P.clean_rel(F.col("raw")).alias("path"))


@query("SELECT work_id, path, path = 'src1' OR starts_with(path, 'src1/') AS below FROM bag")
def under_prefix(spark, d):
    return relation(spark, d, "bag").select("work_id", "path", P.under(F.col("path"), F.lit("src1")).alias("below"))


@query(
    """WITH c AS (SELECT id % 50 AS g, trim(trim(replace(raw, chr(92), '/')), '/') AS p FROM raw_paths)
    SELECT g, array_to_string(list_sort(list_distinct(list(p))), '|') AS scope FROM c WHERE p <> '' GROUP BY g"""
)
def path_scope(spark, d):
    grouped = relation(spark, d, "raw_paths").groupBy((F.col("id") % 50).alias("g")).agg(F.collect_list("raw").alias("raw"))
    return grouped.select("g", F.array_join(P.path_scope(F.col("raw")), "|").alias("scope"))


@query(f"SELECT work_id, path, blob FROM bag WHERE {_SCOPE_SQL}")
def path_scope_filter(spark, d):
    return relation(spark, d, "bag").where(P.in_scope(F.col("path"), INCLUDE, EXCLUDE)).select("work_id", "path", "blob")


@query(f"SELECT id, {_PARENT_SQL.format(p='raw')} AS dir FROM raw_paths")
def parent_dir(spark, d):
    return relation(spark, d, "raw_paths").select("id", P.parent_dir(F.col("raw")).alias("dir"))


@query(f"SELECT id, {_SUFFIX_SQL.format(p='raw')} AS suffix FROM raw_paths")
def file_suffix(spark, d):
    return relation(spark, d, "raw_paths").select("id", P.file_suffix(F.col("raw")).alias("suffix"))


@query(
    f"""SELECT path, count(*) AS n, CASE lower({_SUFFIX_SQL.format(p='path')}) WHEN '.s' THEN 'asm' WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' WHEN '.rs' THEN 'rust' ELSE NULL END AS lang
    FROM tree GROUP BY path"""
)
def lang_of_path(spark, d):
    return relation(spark, d, "tree").groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("lang", P.language(F.col("path")))


@query("SELECT id, coalesce(nullif(trim(regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'work') AS name FROM raw_paths")
def safe_name(spark, d):
    return relation(spark, d, "raw_paths").select("id", P.safe_name(F.col("raw")).alias("name"))


@query("SELECT work_id, ref, CASE WHEN ord % 3 = 0 THEN substr(commit, 1, 12) ELSE ref || '@' || substr(commit, 1, 12) END AS label FROM refs")
def version_label(spark, d):
    ref = F.when(F.col("ord") % 3 == 0, F.lit("")).otherwise(F.col("ref"))
    return relation(spark, d, "refs").select("work_id", "ref", P.version_label(ref, F.col("commit")).alias("label"))


@query(
    """WITH g AS (SELECT id % 60 AS g, list(raw ORDER BY id) FILTER (id % 3 = 0) AS a, list(raw ORDER BY id) FILTER (id % 7 = 0 AND id % 2 = 0) AS b FROM raw_paths GROUP BY 1)
    SELECT g, coalesce(nullif(concat_ws('; ', 'in ' || array_to_string(a, ', '), 'not in ' || array_to_string(b, ', ')), ''), 'all paths') AS label FROM g"""
)
def scope_label(spark, d):
    at = relation(spark, d, "raw_paths").withColumn("pair", F.struct("id", "raw"))
    some = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("pair")))), lambda x: x["raw"])
    g = at.groupBy((F.col("id") % 60).alias("g")).agg(some(F.col("id") % 3 == 0).alias("a"), some((F.col("id") % 7 == 0) & (F.col("id") % 2 == 0)).alias("b"))
    return g.select("g", P.scope_label(F.col("a"), F.col("b")).alias("label"))


@query(
    """SELECT work_id, symbol, 'unit_' || substr(sha256(path || chr(0) || symbol || chr(0) || line::VARCHAR), 1, 16) AS unit_id,
    'fn_' || substr(sha256(path || ':' || line::VARCHAR || ':' || symbol), 1, 16) AS fn_id FROM units"""
)
def stable_id(spark, d):
    path, symbol, line = F.col("path"), F.col("symbol"), F.col("line")
    return relation(spark, d, "units").select("work_id", "symbol", P.stable_id("unit_", path, symbol, line).alias("unit_id"), P.stable_id("fn_", path, line, symbol, between=F.lit(":")).alias("fn_id"))


@query("SELECT g, substr(sha256('{\"include\":[' || s || ']}'), 1, 10) AS digest FROM (SELECT id % 50 AS g, string_agg('\"' || replace(raw, '\\', '\\\\') || '\"', ',' ORDER BY id) AS s FROM raw_paths GROUP BY 1)")
def scope_digest(spark, d):
    at = relation(spark, d, "raw_paths").groupBy((F.col("id") % 50).alias("g"))
    listed = at.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "raw"))), lambda x: x["raw"]).alias("include"))
    return listed.select("g", F.substring(F.sha2(F.to_json(F.struct("include")), 256), 1, 10).alias("digest"))


@query(f"SELECT work_id, path, blob FROM bag WHERE path = 'src0' OR starts_with(path, 'src0/')")
def history_prefix(spark, d):
    return relation(spark, d, "bag").where(P.under(F.col("path"), F.lit("src0"))).select("work_id", "path", "blob")


@query("SELECT id, raw, rank() OVER (ORDER BY raw, id) AS place FROM raw_paths")
def unit_order(spark, d):
    return search.in_order(relation(spark, d, "raw_paths"), [F.col("raw"), F.col("id")]).select("id", "raw", "place")


# --- bag algebra -----------------------------------------------------------------------------

_PAIRS = """WITH c AS (SELECT work_id, {k}, count(*) AS n FROM {r} {w} GROUP BY work_id, {k})
SELECT l.work_id AS target, r.work_id AS candidate, sum(least(l.n, r.n))::BIGINT AS shared, count(*) AS shared_unique
FROM c l JOIN c r ON {on} AND l.work_id <> r.work_id GROUP BY 1, 2"""


def _pair_sql(keys: list[str], rel: str, where: str = "") -> str:
    return _PAIRS.format(k=", ".join(keys), r=rel, w=where, on=" AND ".join(f"l.{k} = r.{k}" for k in keys))


def _shared(bag: DataFrame, *keys: str) -> DataFrame:
    return bags.overlaps(bags.single(bag, *keys), *keys, works=bag.select("work_id").distinct())


@query("SELECT work_id, blob, count(*) AS n FROM bag GROUP BY work_id, blob")
def occurrence_counts(spark, d):
    return bags.counts(relation(spark, d, "bag"), "blob")


@query(_pair_sql(["blob"], "bag"))
def blob_overlap(spark, d):
    return _shared(relation(spark, d, "bag"), "blob")


@query(_pair_sql(["path", "blob"], "bag"))
def path_aligned_overlap(spark, d):
    return _shared(relation(spark, d, "bag"), "path", "blob")


@query(_pair_sql(["shape"], "units", "WHERE shape <> ''"))
def shape_overlap(spark, d):
    return _shared(relation(spark, d, "units").where("shape <> ''"), "shape")


@query(_pair_sql(["path", "shape"], "units", "WHERE shape <> ''"))
def path_shape_overlap(spark, d):
    return _shared(relation(spark, d, "units").where("shape <> ''"), "path", "shape")


@query(
    f"""WITH s AS ({_pair_sql(["blob"], "bag")}), t AS (SELECT work_id, count(*) AS total FROM bag GROUP BY work_id)
    SELECT target, candidate, shared, shared_unique, a.total AS target_total, b.total AS candidate_total, shared / a.total AS target_containment, shared / b.total AS candidate_containment,
    least(shared / a.total, shared / b.total) AS balanced FROM s JOIN t a ON a.work_id = target JOIN t b ON b.work_id = candidate"""
)
def containment(spark, d):
    bag = relation(spark, d, "bag")
    total = bags.works_of(bag)
    return bags.containment(bags.overlaps(bags.single(bag, "blob"), "blob", works=total), bags.beside(total))


@query(
    f"""WITH a AS ({_pair_sql(["blob"], "bag")}), b AS ({_pair_sql(["path", "blob"], "bag")})
    SELECT target, candidate, greatest(0, a.shared - coalesce(b.shared, 0)) AS relocated FROM a LEFT JOIN b USING (target, candidate)"""
)
def relocated_instances(spark, d):
    bag = relation(spark, d, "bag")
    return search.all_relocated(bag)


@query(
    """WITH c AS (SELECT DISTINCT work_id, blob FROM bag)
    SELECT l.work_id AS target, r.work_id AS candidate, count(*) AS shared_unique FROM c l JOIN c r ON l.blob = r.blob AND l.work_id <> r.work_id GROUP BY 1, 2"""
)
def shared_unique(spark, d):
    return _shared(relation(spark, d, "bag"), "blob").drop("shared")


_L, _R = "(SELECT * FROM bag WHERE work_id = 'w1')", "(SELECT * FROM bag WHERE work_id = 'w2')"
_PATHS = "SELECT blob, array_to_string(list_sort(list_distinct(list(path))), '|') AS paths FROM {} x GROUP BY blob"


@query(f"SELECT blob, paths FROM ({_PATHS.format(_L)})")
def paths_by_value(spark, d):
    return bags.paths_by(sides(spark, d)[0], "blob").withColumn("paths", F.array_join("paths", "|"))


@query(f"SELECT l.blob, l.paths AS left_paths, r.paths AS right_paths FROM ({_PATHS.format(_L)}) l JOIN ({_PATHS.format(_R)}) r USING (blob) WHERE l.paths <> r.paths ORDER BY blob LIMIT 30")
def relocated_examples(spark, d):
    found = bags.relocated(*sides(spark, d), "blob")
    return found.select("blob", F.array_join("left_paths", "|").alias("left_paths"), F.array_join("right_paths", "|").alias("right_paths"))


@query(
    f"""SELECT l.blob, least(a.n, b.n) AS instances, l.paths AS left_paths, r.paths AS right_paths FROM ({_PATHS.format(_L)}) l JOIN ({_PATHS.format(_R)}) r USING (blob)
    JOIN (SELECT blob, count(*) AS n FROM {_L} x GROUP BY blob) a USING (blob) JOIN (SELECT blob, count(*) AS n FROM {_R} x GROUP BY blob) b USING (blob)"""
)
def shared_content(spark, d):
    found = bags.shared_content(*sides(spark, d))
    return found.select("blob", "instances", F.array_join("left_paths", "|").alias("left_paths"), F.array_join("right_paths", "|").alias("right_paths"))


_RESIDUAL = """(WITH l AS (SELECT path, blob, row_number() OVER (PARTITION BY path, blob) AS rn FROM {a} x),
e AS (SELECT path, blob, count(*) AS same FROM {b} x GROUP BY path, blob), c AS (SELECT blob, count(*) AS every FROM {b} x GROUP BY blob),
m AS (SELECT l.*, rn <= coalesce(same, 0) AS used FROM l LEFT JOIN e USING (path, blob)),
u AS (SELECT blob, count(*) AS used FROM m WHERE used GROUP BY blob),
k AS (SELECT path, blob, row_number() OVER (PARTITION BY blob ORDER BY path) AS k FROM m WHERE NOT used)
SELECT '{s}' AS side, k.path, k.blob FROM k LEFT JOIN c USING (blob) LEFT JOIN u USING (blob) WHERE k > greatest(coalesce(every, 0) - coalesce(used, 0), 0))"""


@query(f"SELECT * FROM {_RESIDUAL.format(a=_L, b=_R, s='left')} UNION ALL SELECT * FROM {_RESIDUAL.format(a=_R, b=_L, s='right')}".replace("FROM bag", "FROM bag"))
def content_residual(spark, d):
    left, right = sides(spark, d)
    one = bags.residual(left.select("path", "blob"), right).select(F.lit("left").alias("side"), "path", "blob")
    return one.union(bags.residual(right.select("path", "blob"), left).select(F.lit("right").alias("side"), "path", "blob"))


@query(
    f"""WITH t AS (SELECT shape, path, row_number() OVER (PARTITION BY shape ORDER BY path, line, symbol, ord) AS rn FROM units WHERE work_id = 'w1' AND shape <> ''),
    c AS (SELECT shape, count(*) AS n FROM units WHERE work_id = 'w2' GROUP BY shape)
    SELECT {_PARENT_SQL.format(p='path')} AS directory, count(*) FILTER (rn <= coalesce(n, 0)) AS shared_instances, count(*) AS target_instances FROM t LEFT JOIN c USING (shape) GROUP BY 1"""
)
def directory_overlap(spark, d):
    left, right = (x.where("shape <> ''") for x in sides(spark, d, "units"))
    return bags.greedy_directories(left, right, "shape", P.parent_dir(F.col("path")), [F.col(c) for c in ("path", "line", "symbol", "ord")])


@query(
    f"""WITH t AS (SELECT work_id AS target, shape, {_PARENT_SQL.format(p='path')} AS directory, row_number() OVER (PARTITION BY work_id, shape ORDER BY path, line, symbol, ord) AS rn FROM units WHERE shape <> '' AND work_id IN ('w1', 'w2')),
    c AS (SELECT work_id AS candidate, shape, count(*) AS n FROM units WHERE shape <> '' GROUP BY ALL), p AS (SELECT t.target, c.candidate FROM (SELECT DISTINCT target FROM t) t JOIN (SELECT DISTINCT candidate FROM c) c ON t.target <> c.candidate)
    SELECT p.target, p.candidate, directory, count(*) FILTER (rn <= coalesce(n, 0)) AS shared_instances, count(*) AS target_instances FROM p JOIN t USING (target) LEFT JOIN c ON c.candidate = p.candidate AND c.shape = t.shape GROUP BY ALL"""
)
def directory_overlaps(spark, d):
    """How the directories of two targets share out what every other work has of their shapes."""
    units = relation(spark, d, "units").where("shape <> ''")
    works = units.select(F.col("work_id").alias("candidate")).distinct()
    pairs = works.select(F.explode(F.array(F.lit(LEFT), F.lit(RIGHT))).alias("target"), "candidate").where("target <> candidate")
    return headrecord.directories(pairs, units, ["path", "line", "symbol", "ord"])


@query(
    """WITH p AS (SELECT work_id, path, row_number() OVER (PARTITION BY work_id ORDER BY path) - 1 AS place FROM (SELECT DISTINCT work_id, path FROM tree)),
    g AS (SELECT work_id, place // 10 AS page, count(*) AS n, sha256(string_agg('{"path":"' || path || '"}', chr(10) ORDER BY place) || chr(10)) AS sha256 FROM p GROUP BY ALL),
    c AS (SELECT work_id, count(*) AS path_count FROM tree GROUP BY work_id)
    SELECT g.work_id, page, n, sha256, path_count, coalesce(h.commit, '') AS commit FROM g JOIN c USING (work_id) LEFT JOIN heads h USING (work_id)"""
)
def inventory_pages(spark, d):
    """Every path of every snapshot in pages of ten, beside what the snapshot's inventory says."""
    tree = relation(spark, d, "tree")
    told = results.inventory_heads(tree, relation(spark, d, "heads")).select("work_id", F.get_json_object("text", "$.path_count").cast("long").alias("path_count"), F.get_json_object("text", "$.commit").alias("commit"))
    return pages.inventory_pages(tree, 10).drop("text").join(told, "work_id")


_OCCURRENCES = f"""SELECT 'shared_content_occurrences' AS part, blob AS a, side AS b, path AS c, '{{"blob":"' || blob || '","side":"' || side || '","path":"' || path || '","instances":' || n || '}}' AS line
      FROM (SELECT DISTINCT blob, 'left' AS side, path FROM l UNION ALL SELECT DISTINCT blob, 'right', path FROM r) JOIN (SELECT lb.blob, least(lb.n, rb.n) AS n FROM (SELECT blob, count(*) AS n FROM l GROUP BY blob) lb JOIN (SELECT blob, count(*) AS n FROM r GROUP BY blob) rb USING (blob)) USING (blob)
    UNION ALL SELECT 'path_aligned_occurrences', path, blob, '', '{{"path":"' || path || '","blob":"' || blob || '","instances":' || least(x.n, y.n) || '}}' FROM (SELECT path, blob, count(*) AS n FROM l GROUP BY ALL) x JOIN (SELECT path, blob, count(*) AS n FROM r GROUP BY ALL) y USING (path, blob)
    UNION ALL SELECT side || '_residual_occurrences', blob, path, '', '{{"blob":"' || blob || '","path":"' || path || '","instances":' || count(*) || '}}' FROM (SELECT * FROM {_RESIDUAL.format(a=_L, b=_R, s='left')} UNION ALL SELECT * FROM {_RESIDUAL.format(a=_R, b=_L, s='right')}) GROUP BY side, blob, path"""


@query(
    f"""WITH l AS (SELECT path, blob FROM bag WHERE work_id = 'w1'), r AS (SELECT path, blob FROM bag WHERE work_id = 'w2'), o AS ({_OCCURRENCES}),
    p AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY a, b, c) - 1) // 100 AS page, row_number() OVER (PARTITION BY part ORDER BY a, b, c) AS place FROM o)
    SELECT part, page, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY place) || chr(10)) AS sha256 FROM p GROUP BY part, page"""
)
def pair_pages(spark, d):
    """Every occurrence of a comparison, in pages of a hundred rows."""
    left, right = (x.select("path", "blob") for x in sides(spark, d))
    return pages.pair_pages(left, right, 100).select("part", "page", "n", "sha256")


@query(
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY work_id, shape ORDER BY path, line, symbol, ord) AS rn FROM units WHERE shape <> '')
    SELECT l.shape, l.path || ':' || l.symbol AS left_unit, r.path || ':' || r.symbol AS right_unit FROM f l JOIN f r ON l.shape = r.shape AND l.rn = 1 AND r.rn = 1
    WHERE l.work_id = 'w1' AND r.work_id = 'w2' AND (l.path <> r.path OR l.symbol <> r.symbol) ORDER BY shape LIMIT 30"""
)
def shape_examples(spark, d):
    left, right = (x.where("shape <> ''") for x in sides(spark, d, "units"))
    return search.shape_examples(left, right)


@query(f"SELECT blob, count(*) AS n FROM (SELECT blob FROM {_L} a INTERSECT ALL SELECT blob FROM {_R} b) GROUP BY blob")
def bag_intersect(spark, d):
    left, right = sides(spark, d)
    return left.select("blob").intersectAll(right.select("blob")).groupBy("blob").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT blob, count(*) AS n FROM (SELECT blob FROM {_L} a EXCEPT ALL SELECT blob FROM {_R} b) GROUP BY blob")
def bag_except(spark, d):
    left, right = sides(spark, d)
    return left.select("blob").exceptAll(right.select("blob")).groupBy("blob").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT blob FROM {_L} a INTERSECT SELECT blob FROM {_R} b")
def set_intersect(spark, d):
    left, right = sides(spark, d)
    return left.select("blob").intersect(right.select("blob"))


@query(f"SELECT blob FROM {_L} a EXCEPT SELECT blob FROM {_R} b")
def set_except(spark, d):
    left, right = sides(spark, d)
    return left.select("blob").subtract(right.select("blob"))


@query(
    f"""SELECT 'blob' AS match, x.blob AS value, x.left_paths AS l, x.right_paths AS r FROM (SELECT l.blob, l.paths AS left_paths, r.paths AS right_paths FROM ({_PATHS.format(_L)}) l JOIN ({_PATHS.format(_R)}) r USING (blob) WHERE l.paths <> r.paths ORDER BY blob LIMIT 20) x
    UNION ALL SELECT 'shape', * FROM (
    SELECT l.shape, l.path || ':' || l.symbol, r.path || ':' || r.symbol FROM (SELECT *, row_number() OVER (PARTITION BY work_id, shape ORDER BY path, line, symbol, ord) AS rn FROM units WHERE shape <> '') l
    JOIN (SELECT *, row_number() OVER (PARTITION BY work_id, shape ORDER BY path, line, symbol, ord) AS rn FROM units WHERE shape <> '') r ON l.shape = r.shape AND l.rn = 1 AND r.rn = 1
    WHERE l.work_id = 'w1' AND r.work_id = 'w2' AND (l.path <> r.path OR l.symbol <> r.symbol) ORDER BY l.shape LIMIT 20)"""
)
def union_examples(spark, d):
    blobs = bags.relocated(*sides(spark, d), "blob", 20).select(F.lit("blob").alias("match"), F.col("blob").alias("value"), F.array_join("left_paths", "|").alias("l"), F.array_join("right_paths", "|").alias("r"))
    left, right = (x.where("shape <> ''") for x in sides(spark, d, "units"))
    shapes = search.shape_examples(left, right, 20).select(F.lit("shape").alias("match"), F.col("shape").alias("value"), F.col("left_unit").alias("l"), F.col("right_unit").alias("r"))
    return blobs.unionByName(shapes)


# --- candidate search and history ------------------------------------------------------------


@query(
    f"""WITH b AS ({_pair_sql(["blob"], "bag")}), u AS ({_pair_sql(["shape"], "units", "WHERE shape <> ''")}),
    bt AS (SELECT work_id, count(*) AS n FROM bag GROUP BY work_id), ut AS (SELECT work_id, count(*) AS n FROM units WHERE shape <> '' GROUP BY work_id),
    p AS (SELECT t.work_id AS target, c.work_id AS candidate, t.n AS tn, c.n AS cn FROM bt t JOIN bt c ON t.work_id <> c.work_id WHERE t.work_id = 'w1'),
    s AS (SELECT p.target, p.candidate, coalesce(b.shared, 0) AS blob_shared, coalesce(u.shared, 0) AS shape_shared,
      least(coalesce(b.shared, 0) / tn, coalesce(b.shared, 0) / cn) AS blob_balanced,
      least(CASE WHEN x.n > 0 THEN coalesce(u.shared, 0) / x.n ELSE 0 END, CASE WHEN y.n > 0 THEN coalesce(u.shared, 0) / y.n ELSE 0 END) AS shape_balanced
      FROM p LEFT JOIN b USING (target, candidate) LEFT JOIN u USING (target, candidate) LEFT JOIN ut x ON x.work_id = p.target LEFT JOIN ut y ON y.work_id = p.candidate)
    SELECT target, candidate, coalesce(display_name, candidate) AS display_name, coalesce(commit, '') AS commit, blob_shared, shape_shared, round_even(blob_balanced, 6) AS blob_balanced, round_even(shape_balanced, 6) AS shape_balanced, round_even(greatest(blob_balanced, shape_balanced), 6) AS score,
    row_number() OVER (PARTITION BY target ORDER BY round_even(greatest(blob_balanced, shape_balanced), 6) DESC, coalesce(display_name, candidate), coalesce(commit, ''), candidate) AS rank
    FROM s LEFT JOIN heads ON work_id = candidate QUALIFY rank <= 30"""
)
def head_candidates(spark, d):
    return search.head_candidates(relation(spark, d, "bag"), relation(spark, d, "units").where("shape <> ''"), [LEFT], 30, relation(spark, d, "heads"))

_ALL_BAG = "(SELECT work_id, path, blob FROM bag UNION ALL SELECT DISTINCT work_id, 'LICENSE', 'license' FROM bag)"


@query(
    f"""WITH x AS (SELECT * FROM {_ALL_BAG}), v AS (SELECT work_id, shape FROM units WHERE shape <> '' AND work_id IN (SELECT work_id FROM bag)),
    bc AS (SELECT work_id, blob AS k, count(*) AS n FROM x GROUP BY ALL), uc AS (SELECT work_id, shape AS k, count(*) AS n FROM v GROUP BY ALL),
    b AS (SELECT l.work_id AS target, r.work_id AS candidate, sum(least(l.n, r.n))::BIGINT AS shared FROM bc l JOIN bc r USING (k) WHERE l.work_id <> r.work_id GROUP BY ALL),
    u AS (SELECT l.work_id AS target, r.work_id AS candidate, sum(least(l.n, r.n))::BIGINT AS shared FROM uc l JOIN uc r USING (k) WHERE l.work_id <> r.work_id GROUP BY ALL),
    bt AS (SELECT work_id, count(*) AS n FROM x GROUP BY work_id), ut AS (SELECT work_id, count(*) AS n FROM v GROUP BY work_id),
    s AS (SELECT t.work_id AS target, c.work_id AS candidate, coalesce(b.shared, 0) AS blob_shared, coalesce(u.shared, 0) AS shape_shared,
      round_even(coalesce(b.shared, 0) / greatest(t.n, c.n), 6) AS blob_balanced, round_even(CASE WHEN p.n > 0 AND q.n > 0 THEN coalesce(u.shared, 0) / greatest(p.n, q.n) ELSE 0 END, 6) AS shape_balanced
      FROM bt t JOIN bt c ON t.work_id <> c.work_id LEFT JOIN b ON b.target = t.work_id AND b.candidate = c.work_id LEFT JOIN u ON u.target = t.work_id AND u.candidate = c.work_id
      LEFT JOIN ut p ON p.work_id = t.work_id LEFT JOIN ut q ON q.work_id = c.work_id)
    SELECT target, candidate, coalesce(display_name, candidate) AS display_name, coalesce(commit, '') AS commit, blob_shared, shape_shared, blob_balanced, shape_balanced, greatest(blob_balanced, shape_balanced) AS score,
    row_number() OVER (PARTITION BY target ORDER BY greatest(blob_balanced, shape_balanced) DESC, coalesce(display_name, candidate), coalesce(commit, ''), candidate) AS rank
    FROM s LEFT JOIN heads ON work_id = candidate QUALIFY rank <= 5"""
)
def head_recall(spark, d):
    """The five likeliest sources of every work; every work also holds the same license file."""
    bag = relation(spark, d, "bag").select("work_id", "path", "blob")
    license = bag.select("work_id").distinct().select("work_id", F.lit("LICENSE").alias("path"), F.lit("license").alias("blob"))
    return recall.head_recall(bag.unionByName(license), relation(spark, d, "units").where("shape <> ''"), 5, relation(spark, d, "heads"))



@query("SELECT DISTINCT work_id, object_id FROM history WHERE object_id IN (SELECT blob FROM bag WHERE work_id = 'w1')")
def history_objects(spark, d):
    return search.reachable(relation(spark, d, "history"), sides(spark, d)[0])


_HISTORY = """h AS (SELECT DISTINCT work_id, object_id FROM history WHERE work_id <> 'w1'), t AS (SELECT blob, count(*) AS n FROM bag WHERE work_id = 'w1' GROUP BY blob)"""


@query(
    f"""WITH {_HISTORY}
    SELECT 'w1' AS target, h.work_id AS candidate, coalesce(any_value(display_name), h.work_id) AS display_name, count(*) AS shared_unique, sum(n)::BIGINT AS shared, (SELECT sum(n) FROM t)::BIGINT AS target_total,
    round_even(sum(n)::BIGINT / (SELECT sum(n) FROM t)::BIGINT, 6) AS containment FROM h JOIN t ON blob = object_id LEFT JOIN heads ON heads.work_id = h.work_id GROUP BY h.work_id
    ORDER BY containment DESC, shared_unique DESC, display_name, candidate LIMIT 30"""
)
def history_search(spark, d):
    return search.history_search(sides(spark, d)[0], relation(spark, d, "history"), LEFT, 30, relation(spark, d, "heads"))


@query(
    """WITH h AS (SELECT DISTINCT work_id AS candidate, object_id FROM history WHERE work_id <> 'w1')
    SELECT candidate, path, blob, count(*) AS n FROM bag JOIN h ON blob = object_id WHERE work_id = 'w1' GROUP BY ALL"""
)
def history_matches(spark, d):
    return search.history_matches(sides(spark, d)[0], relation(spark, d, "history"), LEFT)


@query("SELECT DISTINCT w.work_id FROM works w WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.work_id = w.work_id AND r.ref = 'r1')")
def missing_snapshots(spark, d):
    return search.missing(relation(spark, d, "works"), relation(spark, d, "refs").where("ref = 'r1'"))


@query("WITH x AS (SELECT work_id, commit, row_number() OVER (PARTITION BY work_id ORDER BY ord DESC) AS rn FROM refs WHERE ref = 'r2') SELECT work_id, commit FROM x WHERE rn = 1")
def ref_resolve(spark, d):
    return search.resolve(relation(spark, d, "refs"), "r2")


@query(
    """WITH RECURSIVE up AS (SELECT id, parent_id, 0 AS depth FROM commits WHERE id = (SELECT max(id) FROM commits) UNION ALL SELECT c.id, c.parent_id, depth + 1 FROM up JOIN commits c ON c.id = up.parent_id)
    SELECT id, min(depth)::BIGINT AS depth FROM up GROUP BY id"""
)
def reachable_commits(spark, d):
    """What the newest commit reaches, with least distances."""
    commits = relation(spark, d, "commits").select("id", "parent_id")
    return search.ancestors(commits, commits.agg(F.max("id")).first()[0])


_MERGES = """x AS (SELECT 'r' || (id % 20)::VARCHAR AS work_id, id, path, unnest([id - 20 * (1 + id % 3), id - 20 * (2 + id % 2)]) AS parent_id FROM commits),
    up AS (SELECT work_id, id FROM (SELECT work_id, max(id) AS id FROM x GROUP BY work_id) UNION SELECT x.work_id, x.parent_id FROM up JOIN x ON x.work_id = up.work_id AND x.id = up.id WHERE x.parent_id >= 0)"""


def _merge_rich(spark, d):
    """Histories of twenty works in which every commit has two parents, and where each work stands."""
    at = relation(spark, d, "commits").select(F.concat(F.lit("r"), (F.col("id") % 20).cast("string")).alias("work_id"), "id", "path")
    parents = F.array(F.col("id") - 20 * (1 + F.col("id") % 3), F.col("id") - 20 * (2 + F.col("id") % 2))
    edges = at.select("work_id", "id", F.explode(F.transform(parents, lambda p: F.when(p >= 0, p))).alias("parent_id"))
    return at, edges, at.groupBy("work_id").agg(F.max("id").alias("id"))


@query(f"WITH RECURSIVE {_MERGES} SELECT work_id, id FROM up")
def merge_reachability(spark, d):
    """The commits that each work's newest reaches, all works at once."""
    _, edges, starts = _merge_rich(spark, d)
    return commitgraph.reached(edges, starts).select("work_id", "id")


@query(f"WITH RECURSIVE {_MERGES}, w AS (SELECT DISTINCT path FROM commits WHERE pack < 7) SELECT DISTINCT up.work_id, path AS object_id FROM up JOIN commits c ON c.id = up.id WHERE path IN (SELECT path FROM w)")
def merge_objects(spark, d):
    """The objects of a few packs that each work's history holds."""
    at, edges, starts = _merge_rich(spark, d)
    wanted = relation(spark, d, "commits").where("pack < 7").select(F.col("path").alias("object_id"))
    return commitgraph.reached_objects(edges, starts, at.withColumnRenamed("path", "object_id"), wanted)


_FN = "'fn_' || CAST(id AS STRING)"
_CALLS = f"""(SELECT work_id, path, {_FN} AS symbol, 'fn_' || CAST(id + 50 AS STRING) AS callee, id FROM code UNION ALL SELECT work_id, path, {_FN}, 'helper', id FROM code)"""
_DEFINED = f"""(SELECT work_id, path, {_FN} AS symbol, 2 AS line, id FROM code UNION ALL SELECT work_id, path, 'helper', 7 - id % 2, id FROM code)"""


def _functions(spark, d):
    """Functions of all sources, written: calls are joined with what they name, and sources are scanned once for both sides."""
    return durable(code_units.extract(relation(spark, d, "code")), "functions")


@query(
    f"""WITH e AS (SELECT * FROM {_CALLS} x), f AS (SELECT * FROM {_DEFINED} x), one AS (SELECT work_id, symbol, min(path) AS callee_path FROM f GROUP BY work_id, symbol HAVING count(*) = 1)
    SELECT e.work_id, e.path, e.symbol, callee, callee_path FROM e JOIN one ON one.work_id = e.work_id AND one.symbol = callee"""
)
def call_resolution(spark, d):
    found = code_units.resolved(_functions(spark, d))
    return found.select("work_id", "path", "symbol", "callee", "callee_path")


@query(
    f"""WITH e AS (SELECT * FROM {_CALLS} x), f AS (SELECT * FROM {_DEFINED} x), one AS (SELECT work_id, symbol FROM f GROUP BY work_id, symbol HAVING count(*) = 1),
    o AS (SELECT work_id, path, symbol, string_agg(DISTINCT callee, ',' ORDER BY callee) AS outgoing FROM e GROUP BY ALL),
    i AS (SELECT e.work_id, callee AS symbol, string_agg(DISTINCT e.symbol, ',' ORDER BY e.symbol) AS incoming FROM e JOIN one ON one.work_id = e.work_id AND one.symbol = callee GROUP BY ALL)
    SELECT f.work_id, f.path, f.symbol, coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming
    FROM f LEFT JOIN o USING (work_id, path, symbol) LEFT JOIN i ON i.work_id = f.work_id AND i.symbol = f.symbol"""
)
def call_sets(spark, d):
    found = code_units.units(_functions(spark, d))
    return found.select("work_id", "path", "symbol", F.array_join("outgoing_names", ",").alias("outgoing"), F.array_join("incoming_names", ",").alias("incoming"))


@query(
    f"""WITH f AS (SELECT * FROM {_DEFINED} x)
    SELECT f.work_id, f.path, symbol, CASE WHEN c.id % 2 = 0 THEN 'c' ELSE 'rust' END AS lang, f.line::INT AS line, (CASE WHEN symbol = 'helper' THEN f.line WHEN c.id % 2 = 0 THEN 6 ELSE 5 END)::INT AS end_line,
    CASE WHEN symbol = 'helper' THEN '' ELSE array_to_string(list_sort(['"' || p_brand || '"', CAST(p_size AS VARCHAR)]), '|') END AS literals, blob
    FROM f JOIN code c ON c.path = f.path JOIN part ON p_partkey = c.id"""
)
def code_functions(spark, d):
    """Functions of C and Rust sources with their lines and literals."""
    found = code_units.units(code_units.extract(relation(spark, d, "code")))
    return found.select("work_id", "path", "symbol", "lang", "line", "end_line", F.array_join("literals", "|").alias("literals"), "blob")


@query("SELECT lang, symbol, count(*) AS n, 1 AS shapes FROM (SELECT CASE WHEN id % 2 = 0 THEN 'c' ELSE 'rust' END AS lang, unnest(['fn', 'helper']) AS symbol FROM code) GROUP BY lang, symbol")
def code_shapes(spark, d):
    """Functions that differ in names and constants alone have one shape."""
    found = code_units.units(code_units.extract(relation(spark, d, "code")))
    kind = F.regexp_extract("symbol", "^[a-z]+", 0)
    return found.groupBy("lang", kind.alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shape").cast("int").alias("shapes"))


@query(
    f"""WITH l AS (SELECT path, blob, count(*) AS n FROM {_L} x GROUP BY ALL), r AS (SELECT path, blob, count(*) AS n FROM {_R} x GROUP BY ALL),
    lb AS (SELECT blob, sum(n) AS n FROM l GROUP BY blob), rb AS (SELECT blob, sum(n) AS n FROM r GROUP BY blob)
    SELECT (SELECT sum(n) FROM l)::BIGINT AS left_total, (SELECT sum(n) FROM r)::BIGINT AS right_total,
    (SELECT sum(least(lb.n, rb.n)) FROM lb JOIN rb USING (blob))::BIGINT AS shared, (SELECT count(*) FROM lb JOIN rb USING (blob)) AS shared_unique,
    (SELECT coalesce(sum(least(l.n, r.n)), 0) FROM l JOIN r USING (path, blob))::BIGINT AS path_aligned,
    greatest(0, (SELECT sum(least(lb.n, rb.n)) FROM lb JOIN rb USING (blob))::BIGINT - (SELECT coalesce(sum(least(l.n, r.n)), 0) FROM l JOIN r USING (path, blob))::BIGINT) AS relocated"""
)
def comparison_summary(spark, d):
    return search.comparison(*sides(spark, d))


@query(
    f"""WITH {_HISTORY}, s AS (SELECT work_id AS candidate, count(*) AS u, sum(n)::BIGINT AS shared FROM h JOIN t ON blob = object_id GROUP BY work_id)
    SELECT candidate, format('{{}} shared, {{}} unique', shared, u) AS line FROM s ORDER BY shared DESC, u DESC, candidate LIMIT 50"""
)
def candidate_summary(spark, d):
    found = search.history_search(sides(spark, d)[0], relation(spark, d, "history"), LEFT, None)
    top = found.orderBy(F.desc("shared"), F.desc("shared_unique"), "candidate").limit(50)
    return top.select("candidate", F.format_string("%d shared, %d unique", "shared", "shared_unique").alias("line"))
