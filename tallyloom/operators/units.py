"""Structural units: instruction blocks, text blocks and document trees, reduced to shapes.

Instruction lines stay in built-in expressions. Trees (HTML) are parsed in Arrow batches, one row at
a time, since a recursive hash has no built-in form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import paths as P
from tallyloom.functions import texts as T

LEAST_ITEMS = 12
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def code_lines(sources: DataFrame) -> DataFrame:
    """(id, n, line): lines without comments, trimmed, blank ones left out; 1-based."""
    each = sources.select("id", F.posexplode(F.split(T.strip_block_comments(F.col("text")), "\n", -1)).alias("n", "line"))
    return each.select("id", (F.col("n") + 1).alias("n"), F.trim(T.strip_line_comment(F.col("line"))).alias("line")).where("line <> ''")


def instruction_lines(sources: DataFrame) -> DataFrame:
    """(id, n, items) of each line that is no label."""
    return code_lines(sources).where(~F.col("line").rlike(T.LABEL)).select("id", "n", T.operands(F.col("line")).alias("items"))


def _joined(items: str = "items"):
    ordered = F.array_sort(F.collect_list(F.struct("n", items)))
    return F.flatten(F.transform(ordered, lambda x: x[items]))


def whole_shape(sources: DataFrame) -> DataFrame:
    return instruction_lines(sources).groupBy("id").agg(T.shape_of(_joined()).alias("shape"))


def assembly_units(sources: DataFrame, least: int = LEAST_ITEMS) -> DataFrame:
    """(id, block, label, n_items, shape, unit_id) of each label block with at least `least` items."""
    is_label = F.col("line").rlike(T.LABEL)
    at = code_lines(sources).withColumn("block", F.sum(is_label.cast("int")).over(Window.partitionBy("id").orderBy("n")))
    label = F.max(F.when(is_label, F.regexp_extract("line", T.LABEL, 1)))
    at = at.withColumn("items", F.when(is_label, F.array().cast("array<string>")).otherwise(T.operands(F.col("line"))))
    found = at.groupBy("id", "block").agg(F.coalesce(label, F.lit("(file)")).alias("label"), _joined().alias("items"))
    found = found.where(F.size("items") >= least)
    return found.select("id", "block", "label", F.size("items").alias("n_items"), T.shape_of(F.col("items")).alias("shape"), P.stable_id("unit_", F.col("id"), F.col("label"), F.lit("asm")).alias("unit_id"))


def text_units(sources: DataFrame) -> DataFrame:
    """Label blocks of any size with first line, last line, literals and callees."""
    is_label = F.col("line").rlike(T.LABEL)
    at = code_lines(sources).withColumn("block", F.sum(is_label.cast("int")).over(Window.partitionBy("id").orderBy("n")))
    callee = F.regexp_extract("line", r"^call\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    found = at.groupBy("id", "block").agg(
        F.coalesce(F.max(F.when(is_label, F.regexp_extract("line", T.LABEL, 1))), F.lit("(file)")).alias("symbol"),
        F.min("n").alias("line"),
        F.max("n").alias("end_line"),
        F.array_sort(F.collect_set(F.nullif(callee, F.lit("")))).alias("calls"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    shape = F.sha2(F.regexp_replace(F.regexp_replace("text", "[A-Za-z_][A-Za-z0-9_]*", "a"), "[0-9]+", "0"), 256)
    return found.select("id", "block", "symbol", "line", "end_line", F.array_join("calls", ",").alias("calls"), F.array_join(T.literals(F.col("text")), "|").alias("literals"), shape.alias("shape"))


def without_keywords(rows: DataFrame, column: str, keywords: tuple[str, ...]) -> DataFrame:
    """Rows whose name is no keyword of the language."""
    return rows.where(~F.col(column).isin(*keywords))


class _Shapes(HTMLParser):
    """Hashes of a document tree from its leaves up; text and attributes don't matter."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str]]] = [("#document", [])]
        self.nodes = 0

    def _close(self) -> None:
        name, children = self.stack.pop()
        self.stack[-1][1].append(hashlib.sha256((name + ("|" + ",".join(children) if children else "")).encode()).hexdigest())
        self.nodes += 1

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, []))
        if tag in _VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.stack.append((tag, []))
        self._close()

    def handle_endtag(self, tag):
        if tag in _VOID or all(name != tag for name, _ in self.stack[1:]):
            return
        while self.stack[-1][0] != tag:
            self._close()
        self._close()

    def root(self) -> tuple[str, int]:
        while len(self.stack) > 1:
            self._close()
        name, children = self.stack[0]
        return hashlib.sha256((name + "|" + ",".join(children)).encode()).hexdigest(), self.nodes


def tree_shape(html: str | None) -> tuple[str, int]:
    """Shape hash and number of nodes of a page."""
    parser = _Shapes()
    parser.feed(html or "")
    parser.close()
    return parser.root()


def dom_shapes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, shape, nodes) of each page, parsed in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tree_shape(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], [key, "shape", "nodes"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, shape string, nodes long")
