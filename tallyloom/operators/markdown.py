"""Markdown documents as rows: front matter, headings, sections, spans, searches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import front
from tallyloom.functions import texts as T

#: The order of a case's fixed documents.
FIXED = ("identity.md", "base.md", "report.md", "issues/contradictions.md")


def heading_rows(docs: DataFrame) -> DataFrame:
    """(id, line, level, title, lines) of each heading."""
    at = docs.withColumn("lines", T.lines(F.col("body")))
    each = at.select("id", "lines", F.explode(T.headings(F.col("body"))).alias("h"))
    return each.select("id", "h.line", "h.level", "h.title", "lines")


def _body(start: Column, stop: Column) -> Column:
    return F.array_join(F.slice("lines", start, F.greatest(stop - start, F.lit(0))), "\n")


def heading_spans(docs: DataFrame) -> DataFrame:
    """Each heading with its last line and its text, up to the next heading of any level."""
    after = F.lead("line").over(Window.partitionBy("id").orderBy("line"))
    at = heading_rows(docs).withColumn("stop", F.coalesce(after, F.size("lines") + 1))
    return at.select("id", "line", "level", "title", (F.col("stop") - 1).alias("end_line"), _body(F.col("line") + 1, F.col("stop")).alias("body"))


def h2_sections(docs: DataFrame) -> DataFrame:
    """Second-level sections with all below them."""
    after = F.lead("line").over(Window.partitionBy("id").orderBy("line"))
    at = heading_rows(docs).where("level = 2").withColumn("stop", F.coalesce(after, F.size("lines") + 1))
    return at.select("id", "line", "title", F.btrim(_body(F.col("line"), F.col("stop")), F.lit("\n ")).alias("markdown"))


def section_content(docs: DataFrame) -> DataFrame:
    """Whether a section or any deeper one in it has text.

    Within a document the deeper headings are those before the next of the same or a higher level;
    both are found on the array of the document's headings, without a join.
    """
    spans = heading_spans(docs).withColumn("own", F.trim(F.regexp_replace("body", "\n", " ")) != "")
    held = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "level", "title", "own"))).alias("hs"))
    ends = lambda x: F.coalesce(F.array_min(F.transform(F.filter("hs", lambda y: (y["line"] > x["line"]) & (y["level"] <= x["level"])), lambda y: y["line"])), F.lit(1 << 30))
    deep = F.transform("hs", lambda x: F.struct(x["line"].alias("line"), x["title"].alias("title"), F.exists("hs", lambda y: (y["line"] >= x["line"]) & (y["line"] < ends(x)) & y["own"]).alias("has_content")))
    return held.select("id", F.explode(deep).alias("h")).select("id", "h.line", "h.title", "h.has_content")


def section_lookup(docs: DataFrame, title: str) -> DataFrame:
    """The text of the first heading with a title, '' without one."""
    found = heading_spans(docs).where(F.col("title") == title).groupBy("id").agg(F.min_by("body", "line").alias("found"))
    return docs.select("id").join(found, "id", "left").select("id", F.col("found").isNotNull().alias("has_heading"), F.coalesce("found", F.lit("")).alias("body"))


def heading_order(docs: DataFrame, required: list[str]) -> DataFrame:
    """Whether the required headings that are there stand in the required order."""
    place = F.array_position(F.array(*[F.lit(r) for r in required]), F.col("title"))
    at = heading_rows(docs).select("id", "line", place.alias("place")).where("place > 0")
    before = F.lag("place").over(Window.partitionBy("id").orderBy("line"))
    return at.withColumn("before", before).groupBy("id").agg((~F.coalesce(F.bool_or(F.col("before") > F.col("place")), F.lit(False))).alias("in_order"))


def optional_last(docs: DataFrame, title: str) -> DataFrame:
    """Of documents with an optional section: whether it is the last."""
    at = heading_rows(docs).where("level = 2").groupBy("id")
    found = at.agg(F.bool_or(F.col("title") == title).alias("there"), (F.max_by("title", "line") == title).alias("is_last"))
    return found.where("there").select("id", "is_last")


def node_headings(docs: DataFrame, known: list[str]) -> DataFrame:
    """Node ids that headings name, and whether they are known."""
    at = heading_rows(docs).where(F.col("title").rlike(T.NODE_HEADING))
    node = F.regexp_extract("title", T.NODE_HEADING, 1)
    return at.select("id", node.alias("node"), node.isin(*known).alias("known"))


def labels_in(text: Column, labels: list[str]) -> Column:
    """The labels that a text holds, in label form."""
    form = T.label_form(text)
    return F.array_compact(F.array(*[F.when(form.contains(x), F.lit(x)) for x in labels]))


def line_span(rows: DataFrame, key: str, start: int, end: int, text: str = "text", strict: bool = False) -> DataFrame:
    """Lines start to end (1-based, inclusive) of each text, without a last one that is empty.

    What lies past a text's end is left out, or an error if `strict`. Requests that differ by text are
    for `capture.span_cards`.
    """
    if start < 1 or end < start:
        raise ValueError(f"no such line range: {start}:{end}")
    lines = T.lines(F.col(text))
    own = F.slice(lines, start, end - start + 1)
    if strict:
        past = F.concat(F.lit("past the end: "), F.size(lines).cast("string"), F.lit(" lines"))
        own = F.when(F.size(lines) < end, F.raise_error(past)).otherwise(own)
    return rows.select(key, F.posexplode(own).alias("n", "line")).select(key, (F.col("n") + start).alias("n"), "line")


def grep(rows: DataFrame, key: str, pattern: str, limit: int = 100, text: str = "text") -> DataFrame:
    """Lines that a pattern matches: the first `limit` by key and line, with the count of all."""
    own = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    hits = rows.where(F.col(text).rlike(pattern)).select(key, F.posexplode(own).alias("n", "line")).where(F.col("line").rlike(pattern))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    top = hits.select(key, (F.col("n") + 1).alias("n"), "line").orderBy(key, "n").limit(limit)
    return top.crossJoin(F.broadcast(total))  # one row


def whole_text(docs: DataFrame) -> DataFrame:
    """Documents with front matter put before the body, as a file has them."""
    front = F.concat(F.lit("---\ncontract: "), F.col("contract"), F.lit("\nstatus: "), F.col("status"), F.lit("\n---\n"))
    return docs.withColumn("text", F.concat(front, F.col("body")))


def frontmatter(docs: DataFrame, text: str) -> DataFrame:
    """Add the front matter's keys, contract and status, and the body after it; a non-mapping gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, contract, status, body = [], [], [], []
            for t in batch.column(1).to_pylist():
                t, own = t or "", {}
                if t.startswith("---\n") and (end := t.find("\n---", 4)) >= 0:
                    try:
                        found = front.loaded(t[4:end])
                    except Exception:  # whatever a bad value raises is this document's alone
                        found = None
                    own, t = found if isinstance(found, dict) else {}, t[end + 4 :].lstrip("\n")
                keys.append(",".join(sorted(map(str, own))))
                contract.append(str(own.get("contract") or ""))
                status.append(str(own.get("status") or ""))
                body.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (keys, contract, status, body))], ["id", "keys", "contract", "status", "body"])

    return docs.select("id", text).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, keys string, contract string, status string, body string")


def parsed(docs: DataFrame) -> DataFrame:
    """One row for each document: front matter, headings, references and anchors."""
    at = frontmatter(docs, "text")
    titles = F.transform(T.headings(F.col("body")), lambda h: h["title"])
    return at.select("id", "keys", "contract", "status", F.array_join(titles, "|").alias("headings"), F.array_join(T.references(F.col("body")), ",").alias("refs"), F.array_join(T.code_anchors(F.col("body")), "|").alias("anchors"))


def document_set(docs: DataFrame) -> DataFrame:
    """Documents in the order a case reads them."""
    place = F.array_position(F.array(*[F.lit(x) for x in FIXED]), F.col("path"))
    rank = F.when(place > 0, place).when(F.col("path").startswith("modules/"), F.lit(100)).when(F.col("path").startswith("findings/"), F.lit(200))
    return docs.withColumn("rank", rank.cast("long")).where(F.col("rank").isNotNull()).select("id", "path", "rank").orderBy("rank", "path")
