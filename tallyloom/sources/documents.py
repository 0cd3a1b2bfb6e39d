"""Text of documents by parts: pages of PDF, paragraphs of DOCX, the whole of anything else.

DOCX is read with the standard library alone. PDF needs `pypdf` if it is there; else a small reader
takes the text of simple files (plain or Flate streams, one-byte fonts).
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = "work_id string, path string, display_name string, commit string, object_hash string, local string, format string, part int, text string, problem string"


def docx_paragraphs(data: bytes) -> list[str]:
    """Texts of the paragraphs that stand in a DOCX body itself, not in its tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as held:
        root = ElementTree.fromstring(held.read("word/document.xml"))
    body = root.find(f"{_W}body")
    text = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda x: "\t", f"{_W}br": lambda x: "\n", f"{_W}cr": lambda x: "\n"}
    return ["".join(text[x.tag](x) for x in p.iter() if x.tag in text) for p in (body.findall(f"{_W}p") if body is not None else [])]


def pdf_pages(data: bytes) -> list[str]:
    """Texts of the pages of a PDF."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return _simple_pages(data)
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def _simple_pages(data: bytes) -> list[str]:
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}

    def ref(raw: bytes, name: bytes) -> list[int]:
        found = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", raw)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found[1])] if found else []

    def stream(raw: bytes) -> bytes:
        found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", raw, re.S)
        if not found:
            return b""
        return zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in raw[: found.start()] else found[1]

    def walk(number: int, seen: frozenset) -> Iterator[bytes]:
        raw = objects.get(number, b"")
        if number in seen:
            return
        if re.search(rb"/Type\s*/Pages\b", raw):
            for kid in ref(raw, b"Kids"):
                yield from walk(kid, seen | {number})
        elif re.search(rb"/Type\s*/Page\b", raw):
            yield b"\n".join(stream(objects.get(c, b"")) for c in ref(raw, b"Contents"))

    root = re.search(rb"/Root\s+(\d+)", data)
    pages = [p for top in ref(objects.get(int(root[1]), b""), b"Pages") for p in walk(top, frozenset())] if root else []
    return [_shown(p) for p in pages]


_OPERATOR = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|Td|TD|Tm|ET|'|\"", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _shown(content: bytes) -> str:
    out = []
    for token in _OPERATOR.findall(content):
        if token[:1] == b"(":
            plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
            out.append(plain.decode("cp1252", "replace"))
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace"))
        elif out and out[-1] != "\n":
            out.append("\n")
    return "".join(out).strip("\n")


def read_parts(files: DataFrame) -> DataFrame:
    """Parts of documents (work_id, path, display_name, commit, object_hash, local, content).

    `local` is the path of a file outside a repository, else null; without an object_hash it is that of the content.
    A file that can't be read gives one row without text, whose `problem` says why; that of all others is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["work_id", "path", "display_name", "commit", "object_hash", "local", "format", "part", "text", "problem"]
        for batch in batches:
            for row in batch.to_pylist():
                data, low = bytes(row["content"] or b""), row["path"].lower()
                kind = "pdf" if low.endswith(".pdf") else "docx" if low.endswith(".docx") else "text"
                problem = ""
                try:
                    texts = pdf_pages(data) if kind == "pdf" else docx_paragraphs(data) if kind == "docx" else [data.decode("utf-8", "replace")]
                except Exception as error:  # a broken file is its own problem, not the job's
                    texts, problem = [None], f"can't be read: {type(error).__name__}"
                own = [row["work_id"], row["path"], row["display_name"], row["commit"], row["object_hash"] or hashlib.sha256(data).hexdigest(), row["local"], kind]
                n = len(texts)
                columns = [pa.array([x] * n, pa.string()) for x in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(1, n + 1), pa.int32()), pa.array(texts, pa.string()), pa.array([problem] * n, pa.string())], names)

    return files.select("work_id", "path", "display_name", "commit", "object_hash", "local", "content").mapInArrow(run, PARTS)
