"""Readers and writers of the formats that cases use: registry YAML, JSON lines, Markdown, git trees.

Everything but git and YAML goes through Spark's own readers, so paths may lie in any store. A git
repository is a folder of a machine; its data source reads one repository in each partition, on
whichever executor sees the folder.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyloom.operators import evidence
from tallyloom.sources.git import read_objects

WORKS = (
    "work_id string, year int, school string, team string, work_name string, display_name string, canonical_dir string, "
    "review_branch string, repository_type string, reference_kind string, module_ids string, ord long"
)
TREE = "work_id string, mode string, kind string, object_id string, path string, size long"
BLOBS = "work_id string, path string, object_id string, data binary"
CARDS = (
    "evidence_id string, kind string, title string, source struct<display_name:string, path:string>, excerpt string, "
    "facts array<struct<label:string, value:string>>, table struct<columns:array<string>, rows:array<array<string>>>, raw_ref struct<path:string, sha256:string>"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Works of a YAML registry: a list, or a mapping with `works`; a missing file has none."""
    import yaml

    try:
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        text = ""
    found = yaml.safe_load(text) or []
    found = found.get("works") or [] if isinstance(found, dict) else found
    text_of = lambda w, c: None if w.get(c) is None else str(w[c])
    rows = [
        (
            *(text_of(w, "work_id"),),
            int(w.get("year") or 0),
            *(text_of(w, c) for c in ("school", "team", "work_name", "display_name", "canonical_dir", "review_branch", "repository_type", "reference_kind")),
            ",".join(map(str, w.get("module_ids") or [])),
            i,
        )
        for i, w in enumerate(found)
    ]
    return spark.createDataFrame(rows, WORKS)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards of an evidence log in JSON lines, blank lines skipped; a line that is no JSON object is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", CARDS, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def check_cards(cards: DataFrame) -> DataFrame:
    """Cards of a log with their first problem; a repeated id is one."""
    flat = cards.withColumns({"source_name": F.coalesce("source.display_name", F.lit(""))})
    repeated = evidence.duplicates(cards, "evidence_id").select("evidence_id", F.lit(True).alias("again"))
    found = evidence.validated(flat).join(repeated, "evidence_id", "left")
    raw = F.col("raw_ref").isNotNull() & ((F.coalesce("raw_ref.path", F.lit("")) == "") | (F.coalesce("raw_ref.sha256", F.lit("")) == ""))
    problem = F.when(F.col("problem") != "", F.col("problem")).when(raw, "raw_ref").when(F.col("again"), "duplicate").otherwise("")
    return found.select("evidence_id", problem.alias("problem"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of a text file, or of the files of a folder as one text in order of their names, lines numbered from 1.

    A split knows the byte it begins at but not the lines before it. They are a prefix sum over the
    splits, one row each, and a line's own place is its row's within its split; so a log of any size is
    numbered in two scans and without a sort. The files must not change meanwhile.
    """
    at = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = at.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return at.join(splits, ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def check_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, evidence_id, problem) of every line of an evidence log that is no good card; blank lines are none at all.

    Problems are those of `evidence.validated`, `json` and `object` for lines that hold no JSON or no object, `facts`,
    `table` and `raw_ref` for parts of another form, and `duplicate` for an id that a good card has on an earlier line.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    got = lines.select("line", F.try_parse_json("value").alias("v"), F.from_json("value", CARDS, {"mode": "PERMISSIVE"}).alias("c"))
    kind = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    of = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")), F.lit("VOID"))
    flat = got.select("line", kind.alias("__kind"), of("facts").alias("__facts"), of("table").alias("__table"), of("raw_ref").alias("__raw"), "c.*")
    flat = flat.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("evidence_id", "kind", "title")}).withColumn("source_name", F.coalesce("source.display_name", F.lit("")))
    raw = (F.coalesce("raw_ref.path", F.lit("")) == "") | (F.coalesce("raw_ref.sha256", F.lit("")) == "")
    facts = (F.col("__facts") != "VOID") & ~F.col("__facts").rlike("^ARRAY<(OBJECT|VOID)")
    table = (F.col("__table") != "VOID") & ~F.startswith(F.col("__table"), F.lit("OBJECT"))
    problem = (
        F.when(F.col("__kind") == "", "json")
        .when(~F.startswith(F.col("__kind"), F.lit("OBJECT")), "object")
        .when(F.col("problem").isin("id", "kind", "title", "source"), F.col("problem"))
        .when(facts, "facts")
        .when(table | (F.col("problem") == "table"), "table")
        .when((F.col("__raw") != "VOID") & raw, "raw_ref")
        .otherwise("")
    )
    judged = evidence.validated(flat).select("line", "evidence_id", problem.alias("problem"))
    first = judged.where("problem = ''").groupBy("evidence_id").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = judged.join(first, "evidence_id", "left")
    return again.withColumn("problem", F.when((F.col("problem") == "") & (F.col("line") > F.col("first")), "duplicate").otherwise(F.col("problem"))).where("problem <> ''").select("line", "evidence_id", "problem")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of Markdown files below a folder."""
    at = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return at.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line) of plain text files; bytes that are no UTF-8 become the replacement character."""
    at = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return at.select("path", F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def write_snapshots(rows: DataFrame, path: str) -> None:
    """Fingerprint rows (work_id, commit, ...) as Parquet by snapshot; only the snapshots written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("work_id", "commit").parquet(path)


def write_json_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, through Spark's commit protocol."""
    rows.write.mode("overwrite").json(path)


def _git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=True, timeout=300).stdout


class _Snapshot(InputPartition):
    def __init__(self, work_id: str, repo: str, commit: str):
        super().__init__(0)
        self.work_id, self.repo, self.commit = work_id, repo, commit


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}
        self.blobs = self.options.get("content", "false").lower() == "true"
        self.most = int(self.options.get("maxbytes", 4 << 20))
        self.suffixes = tuple(s for s in self.options.get("suffixes", "").split(",") if s)

    def partitions(self):
        """One for each `work=repository@commit`, separated by line feeds."""
        found = []
        for row in filter(None, self.options["snapshots"].split("\n")):
            work, _, rest = row.partition("=")
            repo, _, commit = rest.rpartition("@")
            found.append(_Snapshot(work, repo, commit))
        return found

    def read(self, partition: _Snapshot) -> Iterator[tuple]:
        listed = _git(partition.repo, "ls-tree", "-r", "-l", "-z", "--full-tree", partition.commit)
        wanted: list[tuple[str, str]] = []
        for entry in filter(None, listed.split(b"\0")):
            head, _, path = entry.partition(b"\t")
            meta = head.split()
            if len(meta) != 4:
                continue
            mode, kind, object_id, size = (m.decode() for m in meta)
            name = path.decode("utf-8", "backslashreplace")  # paths that are no UTF-8 stay apart
            if not self.blobs:
                yield partition.work_id, mode, kind, object_id, name, None if size == "-" else int(size)
            elif kind == "blob" and int(size) <= self.most and (not self.suffixes or name.endswith(self.suffixes)):
                wanted.append((name, object_id))
        for (name, object_id), (_, data) in zip(wanted, read_objects(partition.repo, [o for _, o in wanted]), strict=True):
            yield partition.work_id, name, object_id, data


class GitSource(DataSource):
    """`spark.read.format("git_tree").option("snapshots", "w=/repos/w@HEAD").load()`; option content=true reads blobs."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return BLOBS if {k.lower(): v for k, v in self.options.items()}.get("content", "false").lower() == "true" else TREE

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


def read_trees(spark: SparkSession, snapshots: dict[str, tuple[str, str]], content: bool = False, **options) -> DataFrame:
    """Tree entries (or blobs) of snapshots {work_id: (repository, commit)}, a partition each."""
    spark.dataSource.register(GitSource)
    listed = "\n".join(f"{w}={repo}@{commit}" for w, (repo, commit) in snapshots.items())
    return spark.read.format("git_tree").options(snapshots=listed, content=str(content).lower(), **options).load()
