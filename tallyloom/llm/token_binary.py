"""Token ids as flat binary shards with 64-bit offsets, to be memory-mapped.

A data set is a folder of shards, one for each range of doc_id, in ascending order:

    shard-<k>-<attempt>.bin   token ids, little-endian unsigned integers (16-bit where the vocabulary
                              has at most 65,536 ids, else 32-bit), nothing between documents
    shard-<k>-<attempt>.idx   n + 1 little-endian unsigned 64-bit offsets into the .bin, in ids
    shard-<k>-<attempt>.doc   n little-endian signed 64-bit document ids
    manifest.json             the shards in order, with the number of ids before each (its base)
                              and the type of its ids

Rows are dealt by range of doc_id, each task streams its rows into files under a name of its own
attempt, and only the attempts whose rows Spark commits enter the manifest, so lost executors and
repeated tasks leave at most files that nothing names. Bases are prefix sums of the shards' sizes.

Defined results: null text is an empty document (its end id alone); a null doc_id is stored as the
least 64-bit integer and comes first; rows that share a doc_id are all kept, ordered by text hash;
an empty table gives a data set without shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, fresh_path, small_batches, table
from .token_counts import Transducer
from .wordstream import Memo, Pretokenizer, byte_letters, slices

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Ids kept of known words before the memo is started anew; bounds a worker's memory.
MOST_IDS = 4 << 20
#: Words of more code points (no blank, no change of class) are encoded by the transducer, in bounded memory.
GIANT = 1 << 16
_NULL_ID = -(1 << 63)


def filesystem(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return fs.LocalFileSystem(), path


class Encoder:
    """Ids of whole texts by the tokenizers library, asked once for each distinct word the memo lacks."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def shared(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str, giant: int = GIANT):
        self.path, self.pre, self.giant = path, Pretokenizer(path), giant
        self.letters = dict(enumerate(byte_letters()))
        self.memo = Memo(self._ids_of, bits=20)
        self.arena, self.used = np.empty(1 << 16, np.uint32), 0
        self.fst: Transducer | None = None

    def _keep(self, found: list, n: int) -> None:
        while self.used + n > len(self.arena):
            self.arena = np.concatenate((self.arena, np.empty_like(self.arena)))
        self.arena[self.used : self.used + n] = found
        self.used += n

    def _ids_of(self, words: list[str]) -> np.ndarray:
        """Where the ids of words stand in the arena, and how many there are: place << 32 | number."""
        tokenize, letters = self.pre.tok.model.tokenize, self.letters
        found = [[t.id for t in tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = self.used + np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        self._keep(np.fromiter((i for ids in found for i in ids), np.uint32, n), n)
        return at << 32 | sizes

    def _giant(self, text: str) -> np.ndarray:
        if self.fst is None:
            self.fst = Transducer(self.path)
        low = self.pre.lower[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        return self.fst.ids(low.tobytes().decode("utf-32-le").encode("utf-8", "surrogatepass")).astype(np.uint32)

    @property
    def dtype(self) -> str:
        """The narrowest type that holds every id."""
        return "<u2" if self.pre.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def encode(self, texts: list[str], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has, with `end` after each text."""
        parts, owner, closing, whole = [], [], [], []  # a piece of a text, the id that closes it or -1, and if it is one long word
        for i, text in enumerate(texts):
            pieces, marks = [text], []
            if "<|" in text:
                marks = [self.pre.specials[s] for s in self.pre.special_at.findall(text)]
                pieces = self.pre.special_at.split(text)
            for piece, mark in zip(pieces, [*marks, -1 if end is None else end], strict=True):
                for own, giant in self.pre.cut(self.pre.plain(piece), self.giant):
                    parts.append(own)
                    owner.append(i)
                    closing.append(-1)
                    whole.append(giant)
                closing[-1] = mark
        out, sizes = [], np.zeros(len(texts), np.int64)

        def add(ids: np.ndarray, made: np.ndarray, which: list[int]) -> None:
            """Ids of the parts `which`, of which there are `made` up to each part's end."""
            mark = np.array([closing[k] for k in which], np.int64)
            shut = mark >= 0
            out.append(np.insert(ids, made[shut], mark[shut].astype(np.uint32)))
            np.add.at(sizes, [owner[k] for k in which], np.diff(made, prepend=0) + shut)

        k = 0
        while k < len(parts):
            if whole[k]:
                ids = self._giant(parts[k])
                add(ids, np.array([len(ids)]), [k])
                k += 1
                continue
            stop = k
            while stop < len(parts) and not whole[stop]:
                stop += 1
            for points, pieces in slices(parts[k:stop]):
                if self.used > MOST_IDS:
                    self.memo.clear()
                    self.used = 0
                words = self.pre.words(points)
                value = self.memo.get(words, words.begin, words.end, self.pre.hashes(words.low, words.begin, words.end))
                n, at = value & 0xFFFFFFFF, value >> 32
                made = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=made[1:])
                ids = self.arena[np.repeat(at - made[:-1], n) + np.arange(made[-1])]
                add(ids, made[np.searchsorted(words.begin, [p[2] for p in pieces])], [k + p[0] for p in pieces])
            k = stop
        return np.concatenate(out) if out else np.empty(0, np.uint32), sizes


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int | None = END_ID, shards: int | None = None) -> list[dict]:
    """Write (doc_id, text) as a data set under `folder`, a path all executors share; return its manifest."""
    import public_tokenizers

    spark, path = docs.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY)
    small_batches(spark)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        part, encoder, streams = TaskContext.get().partitionId(), Encoder.shared(path), None
        name, n_docs, n_ids = f"shard-{part:06d}-{uuid.uuid4().hex}", 0, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if streams is None:
                    streams = [fs.open_output_stream(f"{root}/{name}.{kind}") for kind in ("bin", "idx", "doc")]
                    streams[1].write(np.zeros(1, "<u8").tobytes())
                ids, sizes = encoder.encode([t or "" for t in batch.column(1).to_pylist()], end)
                streams[0].write(ids.astype(encoder.dtype).tobytes())
                streams[1].write((n_ids + np.cumsum(sizes)).astype("<u8").tobytes())
                streams[2].write(batch.column(0).fill_null(_NULL_ID).to_numpy().astype("<i8").tobytes())
                n_docs, n_ids = n_docs + batch.num_rows, n_ids + len(ids)
        finally:
            for s in streams or ():
                s.close()
        if streams is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "dtype": [encoder.dtype], "n_docs": [n_docs], "n_ids": [n_ids]})

    written = durable(dealt.mapInArrow(write, "part long, name string, dtype string, n_docs long, n_ids long"), "shards")
    manifest, base = [], 0
    for r in sorted(written.collect(), key=lambda r: r["part"]):  # a row a shard
        manifest.append({"name": r["name"], "dtype": r["dtype"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "base": base})
        base += r["n_ids"]
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class ShardFile:
    """Slices of a shard file as arrays: memory-mapped where the store is local, else read range by range."""

    def __init__(self, fs, at: str, kind: str):
        from pyarrow import fs as stores

        self.kind = np.dtype(kind)
        self.n = fs.get_file_info(at).size // self.kind.itemsize
        self.mapped = self.file = None
        if not isinstance(fs, stores.LocalFileSystem):
            self.file = fs.open_input_file(at)
        elif self.n:
            self.mapped = np.memmap(at, self.kind, "r")

    def __getitem__(self, span: slice) -> np.ndarray:
        start, stop, _ = span.indices(self.n)
        if self.file is not None:
            size = self.kind.itemsize
            return np.frombuffer(self.file.read_at(max(0, stop - start) * size, start * size), self.kind)
        return np.empty(0, self.kind) if self.mapped is None else self.mapped[start:stop]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _spans(cuts: np.ndarray, most: int = 1 << 22) -> Iterator[range]:
    """Documents in runs of at most `most` ids, or one document that alone has more."""
    k, n = 0, len(cuts) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(cuts, cuts[k] + most, "right")) - 1)
        yield range(k, min(stop, n))
        k = stop


def _checksums(ids: ShardFile, cuts: list[int]) -> list[int]:
    """The crc32 of each document's ids as 32-bit integers, from one read of the run."""
    run, first = ids[cuts[0] : cuts[-1]], cuts[0]
    return [zlib.crc32(run[a - first : b - first].astype("<u4")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def read_tokens(spark: SparkSession, folder: str, manifest: list[dict] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a data set's documents, from its files."""
    fs, root = filesystem(folder)
    if manifest is None:
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            manifest = json.loads(f.read())
    rows = [(m["name"], m["base"], m["dtype"]) for m in manifest]
    shards = spark.createDataFrame(rows, "name string, base long, dtype string").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for name, base, of_ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files = [ShardFile(fs, f"{root}/{name}.{kind}", dtype) for kind, dtype in (("bin", of_ids), ("idx", "<u8"), ("doc", "<i8"))]
                ids, at, docs = files
                for k in range(0, docs.n, 8192):
                    some = np.array(docs[k : k + 8192])
                    cuts = at[k : k + len(some) + 1].astype(np.int64)
                    crc = [c for run in _spans(cuts) for c in _checksums(ids, cuts[run.start : run.stop + 1].tolist())]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(some, pa.int64(), mask=some == _NULL_ID),
                            "start": pa.array(base + cuts[:-1]),
                            "n_tokens": pa.array(np.diff(cuts)),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )
                for f in files:
                    f.close()

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(table(spark, sf_dir, "documents"), folder))
