"""The evidence log: card validation, signatures, append with ids, citations, commit facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import texts as T
from tallyloom.operators.search import in_order

#: The kinds of an evidence card.
KINDS = ("source_span", "document_span", "git_commit", "fingerprint_comparison", "search_result")
SUMMARIES = ("fingerprint_comparison", "search_result")


def with_tables(cards: DataFrame) -> DataFrame:
    """Give every third card a table of its columns and one row of its cells."""
    column, cell = F.transform(F.sequence(F.lit(1), "columns"), lambda x: x.cast("string")), F.transform(F.sequence(F.lit(1), "cells"), lambda x: x.cast("string"))
    table = F.when(F.col("n") % 3 == 0, F.struct(column.alias("columns"), F.array(cell).alias("rows")))
    return cards.withColumn("table", table)


def validated(cards: DataFrame) -> DataFrame:
    """Add the first problem of each card, '' if it has none."""
    ragged = F.coalesce(F.exists("table.rows", lambda r: F.size(r) != F.size("table.columns")), F.lit(False))
    problem = (
        F.when(~F.col("evidence_id").rlike("^E[0-9]{3,}$"), "id")
        .when(~F.col("kind").isin(*KINDS), "kind")
        .when(F.trim("title") == "", "title")
        .when(F.trim("source_name") == "", "source")
        .when(F.col("table").isNotNull() & (F.coalesce(F.size("table.columns"), F.lit(0)) == 0), "table")
        .when(ragged, "table")
        .otherwise("")
    )
    return cards.withColumn("problem", problem)


def scan(cards: DataFrame) -> DataFrame:
    """Cards of a log, blank lines skipped."""
    return cards.where(F.col("evidence_id").rlike("^E[0-9]{3,}$") & (F.trim("excerpt") != ""))


def signature() -> Column:
    """SHA-256 of compact JSON with keys in order: kind, source, raw content; facts only for a direct search.

    Title and excerpt don't count, so the same place cited twice is one card.
    """
    direct = (F.col("kind") == "search_result") & (F.col("raw_sha") == "")
    facts = F.when(direct, F.array("fact")).otherwise(F.array().cast("array<string>"))
    source = F.struct(F.col("source_name").alias("display_name"), F.col("source_path").alias("path"))
    return F.sha2(F.to_json(F.struct(facts.alias("facts"), "kind", F.col("raw_sha").alias("raw_sha256"), source.alias("source"))), 256)


def numbered(number: Column) -> Column:
    """Evidence id of a number: three digits at least."""
    text = number.cast("string")
    return F.concat(F.lit("E"), F.when(number < 1000, F.lpad(text, 3, "0")).otherwise(text))


def append(log: DataFrame, new: DataFrame, arrival: str) -> DataFrame:
    """New cards that the log lacks, first arrival of each signature, with ids that go on from the log's largest.

    Ids follow arrival, a total order; places in it come from range-dealt partitions (`in_order`), so no
    task holds all new cards. Duplicates are taken out before.
    """
    fresh = new.join(log.select("signature"), "signature", "left_anti")
    first = fresh.groupBy("signature").agg(F.min(arrival).alias(arrival))
    last = log.agg(F.coalesce(F.max(F.substring("evidence_id", 2, 20).cast("long")), F.lit(0)).alias("last"))
    placed = in_order(first, [F.col(arrival)]).crossJoin(F.broadcast(last))  # one row
    return placed.withColumn("evidence_id", numbered(F.col("last") + F.col("place")))


def cited(docs: DataFrame) -> DataFrame:
    """(id, path, line, evidence_id) of each citation, repeats included."""
    each = docs.select("id", "path", F.posexplode(T.lines(F.col("body"))).alias("n", "text"))
    return each.select("id", "path", (F.col("n") + 1).alias("line"), F.explode(T.references(F.col("text"))).alias("evidence_id"))


def public(cards: DataFrame, refs: DataFrame) -> DataFrame:
    """Cited cards as they are published: no raw file, no path of summaries; numeric order."""
    first = cards.groupBy("evidence_id").agg(F.min_by(F.struct("kind", "title", "source_path", "raw_sha"), "n").alias("c"))
    shown = F.when(F.col("c.kind").isin(*SUMMARIES) & (F.col("c.raw_sha") != ""), F.lit("")).otherwise(F.col("c.source_path"))
    kept = first.join(refs.select("evidence_id"), "evidence_id", "left_semi")
    return kept.select("evidence_id", "c.kind", "c.title", shown.alias("source_path"), F.substring("evidence_id", 2, 20).cast("long").alias("number")).orderBy("number")


def reverse_references(docs: DataFrame, anchor: Column | None = None) -> DataFrame:
    """For each cited id the places that cite it: each document, section and anchor once.

    `anchor` tells where a document's sections are shown; without it they are shown under their own titles.
    Places are dealt by range of (id, place), so one that all documents cite spans as many tasks as it
    needs; each task joins its places' texts, and a row only joins those.
    """
    docs = docs.withColumn("__anchor", F.lit(None).cast("string") if anchor is None else anchor)
    # of an outer explode no filter is inferred that would cut and search each text once more
    each = docs.select(F.col("path").alias("document"), "__anchor", F.explode_outer(T.sections(F.col("body"))).alias("s"))
    each = each.select("document", "__anchor", "s", F.explode_outer(F.array_distinct(T.references(F.col("s")))).alias("evidence_id")).where("evidence_id IS NOT NULL")
    place = each.select("evidence_id", "document", T.section_title(F.col("s")).alias("section"), "__anchor")
    place = place.withColumn("anchor", F.coalesce("__anchor", T.slugify(F.col("section")))).drop("__anchor").distinct()
    place = place.repartitionByRange("evidence_id", "document", "section", "anchor").withColumn("__part", F.spark_partition_id())
    shown = F.transform(F.array_sort(F.collect_list(F.struct("document", "section", "anchor"))), lambda x: F.concat_ws("#", x["document"], x["section"], x["anchor"]))
    parts = place.groupBy("evidence_id", "__part").agg(F.count(F.lit(1)).alias("n"), F.array_join(shown, "|").alias("places"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("__part", "places"))), lambda x: x["places"])
    return parts.groupBy("evidence_id").agg(F.sum("n").alias("n"), F.array_join(whole, "|").alias("places"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def commit_rows(commits: DataFrame) -> DataFrame:
    """Commit facts with the parent's commit, '' without one, and a locator."""
    parents = commits.select(F.col("id").alias("parent_id"), F.col("commit").alias("parent"))
    own = commits.join(parents, "parent_id", "left")
    return own.select("pack", "commit", "author", "subject", F.length("body").cast("long").alias("body_chars"), F.coalesce("parent", F.lit("")).alias("parent"), F.concat_ws(":", "author", F.substring("commit", 1, 12)).alias("locator"))


def commit_stats(files: DataFrame) -> DataFrame:
    """Files, additions and deletions of each commit group; `-` marks a binary file and adds nothing."""
    total = lambda c: F.coalesce(F.sum(F.col(c).try_cast("bigint")), F.lit(0)).alias(c)
    return files.groupBy("pack").agg(F.countDistinct("path").alias("files"), total("additions"), total("deletions"), F.count_if(F.col("additions") == "-").alias("binary"))
