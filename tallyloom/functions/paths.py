"""Column expressions over paths, prefixes and names. All built-in, all null-safe where stated."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes whose blobs are fingerprinted (case-sensitive) and languages by suffix.
BLOB_SUFFIXES = (".c", ".h", ".cc", ".cpp", ".hpp", ".cxx", ".rs", ".S", ".s", ".ld", ".lds", ".toml", ".mk")
LANGUAGES = {".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cxx": "cpp", ".rs": "rust"}
ASSEMBLY_SUFFIXES = (".s",)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """The last suffix of the base name with its dot, or ''; a leading dot is no suffix."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def parent_dir(path: Column) -> Column:
    """The directory of a path; `(root)` for a file at the top."""
    return F.when(~F.contains(path, F.lit("/")), F.lit("(root)")).otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def clean_prefix(prefix: Column) -> Column:
    """Backslashes become slashes; blanks around and slashes at the ends go."""
    return F.btrim(F.trim(F.replace(prefix, F.lit("\\"), F.lit("/"))), F.lit("/"))


def clean_rel(path: Column) -> Column:
    """A relative path without leading `./` (repeated) or slashes."""
    return F.ltrim(F.regexp_replace(path, r"^(\./)+", ""), F.lit("/"))


def under(path: Column, prefix: Column) -> Column:
    """Whether the path is the prefix or lies below it, at a directory boundary."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def under_any(path: Column, prefixes: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, (under(path, F.lit(p)) for p in prefixes), F.lit(False))


def path_scope(prefixes: Column) -> Column:
    """Cleaned, non-empty, distinct prefixes in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(prefixes, clean_prefix), lambda p: p != "")))


def clean_scope(prefixes: list[str]) -> list[str]:
    """`path_scope` for prefixes given as arguments."""
    return sorted({q for p in prefixes if (q := p.replace("\\", "/").strip(" ").strip("/"))})


def in_scope(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Below an included prefix (none: everything) and below no excluded one."""
    include, exclude = clean_scope(include), clean_scope(exclude)
    kept = under_any(path, include) if include else F.lit(True)
    return kept & ~under_any(path, exclude)


def language(path: Column) -> Column:
    """Language by lower-cased suffix: c, cpp, rust, asm, or null."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    suffix = F.lower(file_suffix(path))
    return F.when(suffix.isin(*ASSEMBLY_SUFFIXES), F.lit("asm")).otherwise(F.try_element_at(known, suffix))


def safe_name(name: Column) -> Column:
    """A name fit for a file: other characters become `_`; `work` if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), F.lit("._-")), F.lit("")), F.lit("work"))


def version_label(ref: Column, commit: Column) -> Column:
    """`ref@commit` with twelve digits of the commit; no `@` without a ref."""
    return F.concat_ws("@", F.nullif(ref, F.lit("")), F.substring(commit, 1, 12))


def scope_label(include: Column, exclude: Column, included="in ", excluded="not in ", between="; ", everything="all paths") -> Column:
    """A scope in words."""
    part = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, ", ")))
    return F.coalesce(F.nullif(F.concat_ws(between, part(included, include), part(excluded, exclude)), F.lit("")), F.lit(everything))


def stable_id(prefix: str, *parts: Column, between: Column | None = None) -> Column:
    """prefix and 16 hex digits of the SHA-256 of the parts joined by NUL (or `between`)."""
    joint = F.lit("\0") if between is None else between
    text = parts[0].cast("string")
    for p in parts[1:]:
        text = F.concat(text, joint, p.cast("string"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))
