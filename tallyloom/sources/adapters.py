"""Snapshot, registry, commit, evidence and document relations over the driver's tables.

The tables hold no repositories, so each relation is a projection of one table: (table, columns,
filter). The same expressions run in Spark and, through `cte`, in the SQL that checks it; `{s}x{e}`
stands for the SHA-256 of x in either. They scan one table each, prune columns and never shuffle.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

_SUFFIX = "CASE l_partkey % 5 WHEN 0 THEN '.c' WHEN 1 THEN '.h' WHEN 2 THEN '.rs' WHEN 3 THEN '.S' ELSE '.md' END"
_PATH = (
    f"CASE WHEN l_linenumber = 6 THEN 'root' || l_linestatus || ({_SUFFIX}) "
    f"ELSE 'src' || CAST(l_linenumber % 3 AS STRING) || '/' || l_returnflag || '/' || l_linestatus || CAST(l_linenumber AS STRING) || ({_SUFFIX}) END"
)
_CARD = "(conv_id * 10 + turn + 1)"
_N = "|| chr(10) ||"

RELATIONS: dict[str, tuple[str, dict[str, str], str]] = {
    # every path occurrence of a snapshot; one row per (path, blob, mode), never made a set
    "tree": (
        "lineitem",
        {
            "work_id": "'w' || CAST(l_suppkey AS STRING)",
            "path": _PATH,
            "blob": "{s}'b' || CAST(l_partkey AS STRING){e}",
            "mode": "CASE WHEN l_linenumber = 5 THEN '120000' ELSE '100644' END",
            "kind": "CASE WHEN l_linenumber = 7 THEN 'commit' ELSE 'blob' END",
            "size": "CAST(round(l_extendedprice * 100) AS BIGINT)",
            "ord": "l_orderkey * 10 + l_linenumber",
        },
        "",
    ),
    "bag": (
        "lineitem",
        {"work_id": "'w' || CAST(l_suppkey AS STRING)", "path": _PATH, "blob": "{s}'b' || CAST(l_partkey AS STRING){e}", "ord": "l_orderkey * 10 + l_linenumber"},
        "l_linenumber <> 7 AND l_partkey % 5 <> 4",
    ),
    "units": (
        "lineitem",
        {
            "work_id": "'w' || CAST(l_suppkey AS STRING)",
            "path": _PATH,
            "symbol": "'fn_' || CAST(l_orderkey AS STRING)",
            "line": "CAST(l_quantity AS INT)",
            "shape": "CASE WHEN l_partkey % 11 = 0 THEN '' ELSE {s}'s' || CAST(l_partkey - l_partkey % 4 AS STRING){e} END",
            "ord": "l_orderkey * 10 + l_linenumber",
        },
        "l_linenumber <> 7",
    ),
    # objects reachable from any ref of a work: more than its head holds
    "history": (
        "lineitem",
        {"work_id": "'w' || CAST((l_suppkey + l_orderkey % 3) AS STRING)", "object_id": "{s}'b' || CAST(l_partkey AS STRING){e}"},
        "",
    ),
    "works": (
        "customer",
        {
            "work_id": "'c' || CAST(c_custkey % 1400 AS STRING)",
            "year": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(2020 + c_custkey % 6 AS INT) END",
            "school": "CASE WHEN c_nationkey % 8 = 0 THEN '' ELSE ' school ' || CAST(c_nationkey AS STRING) || ' ' END",
            "team": "c_mktsegment",
            "work_name": "c_name",
            "display_name": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'school ' || CAST(c_nationkey AS STRING) || '-' || c_name END",
            "canonical_dir": "CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'repos/' || c_name END",
            "review_branch": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ' review ' END",
            "repository_type": "CASE c_custkey % 11 WHEN 0 THEN 'reference' WHEN 1 THEN NULL WHEN 2 THEN 'odd' ELSE 'competition' END",
            "reference_kind": "CASE c_custkey % 7 WHEN 0 THEN 'kernel' WHEN 1 THEN 'component' WHEN 2 THEN 'other' ELSE '' END",
            "module_ids": "CASE WHEN c_custkey % 3 = 0 THEN ' memory, , scheduler,unknown' ELSE '' END",
            "ord": "c_custkey",
        },
        "",
    ),
    # the newest commit and the display name of a work; some works have none
    "heads": (
        "supplier",
        {"work_id": "'w' || CAST(s_suppkey AS STRING)", "display_name": "'work ' || CAST(s_nationkey AS STRING)", "commit": "{s}s_name{e}"},
        "s_suppkey % 7 <> 3",
    ),
    "refs": (
        "orders",
        {"work_id": "'c' || CAST(o_custkey % 1400 AS STRING)", "ref": "'r' || CAST(o_orderkey % 5 AS STRING)", "commit": "{s}CAST(o_orderkey AS STRING){e}", "ord": "o_orderkey"},
        "",
    ),
    "commits": (
        "events",
        {
            "id": "event_id",
            "commit": "{s}'e' || CAST(event_id AS STRING){e}",
            "parent_id": "CASE WHEN event_id < 3 THEN NULL ELSE event_id - 1 - event_id % 3 END",
            "author": "'u' || CAST(user_id AS STRING)",
            "subject": "event_type",
            "body": "props",
            "path": "'dir' || CAST(user_id % 5 AS STRING) || '/f' || CAST(event_id % 30 AS STRING) || '.c'",
            "pack": "event_id % 500",
            "additions": "CASE WHEN event_id % 10 = 0 THEN '-' ELSE CAST(event_id % 97 AS STRING) END",
            "deletions": "CASE WHEN event_id % 10 = 0 THEN '-' ELSE CAST(user_id % 13 AS STRING) END",
        },
        "",
    ),
    "cards": (
        "conversations",
        {
            "n": _CARD,
            "evidence_id": f"CASE WHEN turn = 7 THEN 'X' WHEN {_CARD} < 10 THEN 'E00' ELSE CASE WHEN {_CARD} < 100 THEN 'E0' ELSE 'E' END END || CAST({_CARD} AS STRING)",
            "kind": "CASE turn % 6 WHEN 0 THEN 'source_span' WHEN 1 THEN 'document_span' WHEN 2 THEN 'git_commit' WHEN 3 THEN 'fingerprint_comparison' WHEN 4 THEN 'search_result' ELSE 'odd' END",
            "title": "CASE WHEN turn = 4 AND conv_id % 2 = 0 THEN '  ' ELSE role || ' ' || CAST(turn AS STRING) END",
            "source_name": "CASE WHEN conv_id % 9 = 0 THEN '' ELSE 'source ' || CAST(conv_id % 40 AS STRING) END",
            "source_path": "'notes/p' || CAST(turn % 3 AS STRING) || '.md'",
            "raw_sha": "CASE WHEN turn % 2 = 0 THEN '' ELSE {s}CAST(conv_id % 7 AS STRING){e} END",
            "excerpt": "text",
            "fact": "CAST(conv_id % 5 AS STRING)",
            "columns": "CAST(turn % 3 + 1 AS INT)",
            "cells": "CAST(conv_id % 4 + 1 AS INT)",
        },
        "",
    ),
    "documents_md": (
        "part",
        {
            "id": "p_partkey",
            "path": "CASE p_partkey % 4 WHEN 0 THEN 'modules/m' WHEN 1 THEN 'findings/f' WHEN 2 THEN 'reports/r' ELSE 'notes/n' END || CAST(p_partkey AS STRING) || '.md'",
            "contract": "CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN 'odd' ELSE CASE p_partkey % 4 WHEN 0 THEN 'module' WHEN 1 THEN 'finding' WHEN 2 THEN 'report' ELSE 'base' END END",
            "status": "CASE p_size % 6 WHEN 0 THEN 'implemented' WHEN 1 THEN 'partial' WHEN 2 THEN 'minimal' WHEN 3 THEN 'absent' WHEN 4 THEN 'findings' ELSE 'strange' END",
            "originality": "CASE p_size % 8 WHEN 0 THEN 'novel' WHEN 1 THEN 'adapted_major' WHEN 2 THEN 'adapted_minor' WHEN 3 THEN 'inherited' WHEN 4 THEN 'external' WHEN 5 THEN 'uncertain' ELSE 'weird' END",
            "public": "CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'False' ELSE '' END",
            "module_id": "CASE p_size % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'scheduler' WHEN 2 THEN 'network' ELSE 'nowhere' END",
            "work_id": "'w' || CAST(p_partkey % 50 AS STRING)",
            "commit_text": "CASE p_size % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN 'ABCDEF1' ELSE substr({s}p_name{e}, 1, 12) END",
            "body": (
                f"'# ' || p_name {_N} 'intro [@E' || CAST(100 + p_partkey % 50 AS STRING) || '] and [@E1]' {_N} '## Scope ' || p_brand {_N} "
                f"CASE WHEN p_size % 3 = 0 THEN '' ELSE 'body `src/' || p_type || '.rs` with CONFIG_' || CAST(p_size AS STRING) END {_N} "
                f"'### Detail' {_N} CASE WHEN p_size % 4 = 0 THEN '  ' ELSE 'more sys_call_' || CAST(p_size AS STRING) || ' [@E' || CAST(100 + p_size AS STRING) || ']' END {_N} "
                f"CASE WHEN p_size % 5 = 0 THEN '## Evidence' {_N} '#### deep: part' ELSE '### node-' || CAST(p_size % 9 AS STRING) || ': part' END {_N} "
                f"CASE WHEN p_size % 6 = 0 THEN '```mermaid' {_N} 'graph ' || p_name {_N} '```' ELSE 'T20' || CAST(20260000000 + p_partkey AS STRING) || '-1' END {_N} "
                f"CASE WHEN p_size % 2 = 0 THEN '## Related' ELSE '## Scope ' || p_brand END {_N} 'last 42 {_N[:0]}lines'"
            ),
        },
        "",
    ),
    "raw_paths": (
        "part",
        {
            "id": "p_partkey",
            "raw": "CASE p_partkey % 5 WHEN 0 THEN ' ' || chr(92) || p_brand || chr(92) || p_type || '/ ' WHEN 1 THEN '/' || p_brand || '/' || p_name || '.rs/' WHEN 2 THEN '././' || p_brand || '/' || p_type || '.C' WHEN 3 THEN p_name || '.tar.gz' ELSE '.hidden/' || p_name END",
        },
        "",
    ),
    "sources": (
        "part",
        {
            "id": "p_partkey",
            "text": (
                f"'start_' || CAST(p_size AS STRING) || ':' {_N} '  ADDI a0, sp, ' || CAST(p_size AS STRING) || ' # note' {_N} '/* block' {_N} 'comment */ lw t1, 8(sp) // load' {_N} "
                f"'.L' || CAST(p_partkey % 3 AS STRING) || ':' {_N} 'beq $t0, x31, .L0 ; jump' {_N} 'call ' || p_type || ' \"' || p_name || '\"' {_N} 'li a7, 0x1F' {_N} 'ret'"
            ),
        },
        "",
    ),
    # two functions a file: one calls its namesake fifty parts on, which lies in the same work, and a helper that many files define
    "code": (
        "part",
        {
            "id": "p_partkey",
            "work_id": "'w' || CAST(p_partkey % 50 AS STRING)",
            "path": "'src/p' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN '.c' ELSE '.rs' END",
            "blob": "{s}'c' || CAST(p_partkey AS STRING){e}",
            "text": (
                f"CASE WHEN p_partkey % 2 = 0 THEN '#include <x.h>' {_N} 'static int fn_' || CAST(p_partkey AS STRING) || '(int a) /* {{{{ */' {_N} chr(123) {_N} "
                f"'  if (a > ' || CAST(p_size AS STRING) || ') return helper(a, \"' || p_brand || '\");' {_N} '  return fn_' || CAST(p_partkey + 50 AS STRING) || '(a);' {_N} chr(125) {_N} "
                f"'int helper(int x, const char *s) ' || chr(123) || ' return x; ' || chr(125) "
                f"ELSE '// fn no() ' || chr(123) {_N} 'pub fn fn_' || CAST(p_partkey AS STRING) || '(a: u32) -> u32 ' || chr(123) {_N} "
                f"'    if a > ' || CAST(p_size AS STRING) || ' ' || chr(123) || ' return util::helper(a, \"' || p_brand || '\"); ' || chr(125) {_N} '    fn_' || CAST(p_partkey + 50 AS STRING) || '(a)' {_N} chr(125) {_N} "
                f"'fn helper(x: u32, s: &str) -> u32 ' || chr(123) || ' x ' || chr(125) END"
            ),
        },
        "",
    ),
    # module reviews with front matter, some of them against their contract
    "case_modules": (
        "part",
        {
            "id": "p_partkey",
            "n": "p_size",
            "case_id": "'w' || CAST(p_partkey % 50 AS STRING)",
            "path": "'modules/m' || CAST(p_partkey AS STRING) || '.md'",
            "text": (
                f"'---' {_N} 'contract: module_review' {_N} 'module_id: ' || CASE p_partkey % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'scheduler' ELSE 'network' END {_N} "
                f"'status: ' || CASE p_size % 6 WHEN 0 THEN 'implemented' WHEN 1 THEN 'partial' WHEN 2 THEN 'minimal' WHEN 3 THEN 'absent' WHEN 4 THEN 'partial' ELSE 'odd' END {_N} "
                f"'originality: ' || CASE p_size % 3 WHEN 0 THEN 'novel' WHEN 1 THEN 'adapted_minor' ELSE 'inherited' END {_N} "
                f"CASE WHEN p_size % 5 = 0 THEN '' ELSE 'base_delta: none' {_N} '' END || '---' {_N} '# ' || p_name {_N} CASE WHEN p_size % 8 = 0 THEN '# Again' {_N} '' ELSE '' END "
                f"|| '## 适用范围' {_N} CASE WHEN p_size % 3 = 0 THEN '  ' ELSE 'text' END {_N} '## 实现内容' {_N} 'text' {_N} '## 相对 Base 的变化' {_N} '### ' || CASE WHEN p_partkey % 3 = 1 OR p_size % 2 = 1 THEN 'node-3' ELSE 'node-1' END || ': part' {_N} "
                f"'## 真实工作量判断' {_N} 'text' {_N} '## 继承、外部依赖与缺失' {_N} 'text' {_N} '## 文档声明复核' {_N} CASE WHEN p_size % 9 = 0 THEN 'T2020260000' || CAST(100000 + p_partkey AS STRING) || '-1' ELSE 'text' END {_N} "
                f"CASE WHEN p_size % 7 = 0 THEN '' ELSE '## 证据' {_N} 'text' {_N} '' END || CASE WHEN p_size % 4 = 0 THEN '## Extra' {_N} 'x' ELSE '' END"
            ),
        },
        "",
    ),
    "texts": ("documents", {"doc_id": "doc_id", "work_id": "source", "text": "text", "lang": "lang"}, ""),
}


#: Relations that are the rows of several others, which have the same columns.
UNIONS: dict[str, tuple[str, ...]] = {}


#: Relations that make a long text of each short row: a file too small to be split holds work for all cores.
TEXTS = ("documents_md", "code", "case_modules")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores; filters and the choice of columns come before."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def spread(rows: DataFrame) -> DataFrame:
    """Short rows dealt to all cores, unless they are so already; what is made of them afterwards is never shuffled for it."""
    return rows if rows.rdd.getNumPartitions() >= 2 * rows.sparkSession.sparkContext.defaultParallelism else dealt(rows)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation as a DataFrame."""
    if name in UNIONS:
        return functools.reduce(DataFrame.unionByName, [relation(spark, sf_dir, part) for part in UNIONS[name]])
    table, columns, where = RELATIONS[name]
    at = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    at = at.where(where) if where else at
    at = spread(at) if name in TEXTS or name.startswith("file_") else at
    return at.selectExpr(*[f"{e.format(s='sha2(', e=', 256)')} AS `{c}`" for c, e in columns.items()])


def cte(name: str) -> str:
    """The same relation as a named SQL query."""
    if name in UNIONS:
        return f"{name} AS ({' UNION ALL BY NAME '.join(f'SELECT * FROM {part}' for part in UNIONS[name])})"
    table, columns, where = RELATIONS[name]
    inner = ", ".join(f'{e.format(s="sha256(", e=")")} AS "{c}"' for c, e in columns.items())
    return f"{name} AS (SELECT {inner} FROM {table}{f' WHERE {where}' if where else ''})"


def sql(query: str) -> str:
    """A query with the relations it names put before it."""
    named = lambda n: re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", query)
    unions = [n for n in UNIONS if named(n)]
    used = [n for n in RELATIONS if named(n) or any(n in UNIONS[u] for u in unions)] + unions
    if not used:
        return query
    rest = query.strip()
    head = ", ".join(cte(n) for n in used)
    if rest.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {rest[14:]}"
    return f"WITH {head}, {rest[4:]}" if rest.upper().startswith("WITH") else f"WITH {head} {rest}"
