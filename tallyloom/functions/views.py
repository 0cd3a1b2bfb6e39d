"""Column expressions for showing reports: identities, links, values, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import texts as T

#: Anchors and evidence chips that a module's row shows.
MOST_ANCHORS, MOST_CHIPS = 3, 4


def snapshot_identity() -> Column:
    """What names a snapshot in a result."""
    return F.struct("work_id", "display_name", "commit").alias("snapshot")


def unit_identity() -> Column:
    """What names a unit in a result."""
    return F.struct("path", "symbol", "kind", "lang", "line", "end_line", "unit_id").alias("unit")


def display_path(path: Column, root: str) -> Column:
    """A path as seen from a root folder; as it is, if it lies elsewhere."""
    below = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(below)), F.substring(path, len(below) + 1, 1 << 30)).otherwise(path)


def without_title(markdown: Column) -> Column:
    """A section's text without its own heading line."""
    return F.regexp_replace(markdown, r"\A#{1,2}\s+[^\n]*\n?", "")


def linked(markdown: Column) -> Column:
    """Citations made links to their cards."""
    return F.regexp_replace(markdown, T.REFERENCE, "[$1](#evidence-$1)")


def fact_text(json: Column) -> Column:
    """A fact's JSON value as text: a list joined by commas, `-` for nothing, objects as they are."""
    items = F.from_json(json, "array<string>")
    plain = F.when(json.rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")).otherwise(F.trim(json))
    text = F.when(json.rlike(r"^\s*\["), F.array_join(items, ", ")).otherwise(plain)
    return F.when(F.coalesce(text, F.lit("")).isin("", "null"), F.lit("-")).otherwise(text)


def numbered_lines(excerpt: Column, start: Column) -> Column:
    """Lines of an excerpt as (n, line), from its first line's number on."""
    return F.transform(T.lines(excerpt), lambda x, i: F.struct((F.coalesce(start, F.lit(1)) + i).alias("n"), x.alias("line")))


def chips(anchors: Column, evidence_ids: Column) -> Column:
    """The anchors and citations that a module's row has room for, and how many more there are."""
    more = F.greatest(F.lit(0), F.size(evidence_ids) - MOST_CHIPS)
    return F.struct(F.slice(anchors, 1, MOST_ANCHORS).alias("anchors"), F.slice(evidence_ids, 1, MOST_CHIPS).alias("evidence_ids"), more.alias("more"))


def active_views(views: DataFrame, sections: DataFrame) -> DataFrame:
    """Views that at least one section of the report stands in."""
    return views.join(sections.select("view"), "view", "left_semi")


def card_map(cards: DataFrame) -> DataFrame:
    """(work_id, cards): the cards of each report by id, the first of an id."""
    first = cards.groupBy("work_id", "evidence_id").agg(F.min_by(F.struct("kind", "title", "excerpt"), "n").alias("card"))
    return first.groupBy("work_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("evidence_id", "card")))).alias("cards"))


def source_problem(work_id: Column, repo: Column, display_name: Column) -> Column:
    """Why a request names no source: it must name a work or a repository, not both, and a repository needs a name to show."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(work_id) == blank(repo), "name either a work or a repository").when(~blank(repo) & blank(display_name), "a repository needs a display name").otherwise("")
