"""Functions, calls, literals and shapes of C, C++ and Rust sources.

A scanner turns a source into tokens and a matcher nests them by brackets; that is enough to find
function definitions, the names they call and their literals without a grammar of the language. A
function's shape is a hash from the leaves up over its token tree: names count as `id`, literals as
their kind, keywords, operators and brackets as themselves, so renaming and other constants leave it
as it is. Sources are read one at a time in Arrow batches; who calls whom is decided by joins.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import paths as P

#: Names that are neither functions nor calls.
NO_NAMES = frozenset(
    (
        "if else for while do switch case default match return break continue loop let const static fn use pub mod unsafe async await extern struct enum union trait impl type typedef "
        "self Self super true false null None Some Ok Err println print format panic assert todo unimplemented dbg write writeln sizeof typeof alignof"
    ).split()
)
LONGEST_LITERAL, MOST_WARNINGS = 200, 200

_SCAN = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<string>(?:b?r(?P<hash>\#*)".*?"(?P=hash)|R"(?P<mark>[^()\s\\]{0,16})\(.*?\)(?P=mark)"|(?:u8|[bLuU])?"(?:\\.|[^"\\])*"))
    |(?P<char>(?:[bLuU]|u8)?'(?:\\(?:x[0-9A-Fa-f]+|u\{[0-9A-Fa-f_]+\}|[0-7]{1,3}|.)|[^'\\\n])')
    |(?P<life>'[A-Za-z_]\w*)
    |(?P<number>(?:0[xX][0-9A-Fa-f_']+|0[bB][01_']+|0o[0-7_]+|\d[\d_']*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[A-Za-z0-9_]*)
    |(?P<name>[A-Za-z_]\w*)
    |(?P<sign>->|::|=>|<<=|>>=|[-+*/%&|^!<>=]=|&&|\|\||\+\+|--|\.\.\.|\.\.|[^\w\s"])""",
    re.S | re.X,
)
_DIRECTIVE = re.compile(r"(?m)^[ \t]*#(?!\[|!\[)(?:\\\r?\n|/\*.*?\*/|[^\n])*", re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_KEYWORDS = {
    "c": frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while".split()),
    "rust": frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()),
}
_KEYWORDS["cpp"] = _KEYWORDS["c"] | frozenset("bool catch class constexpr delete explicit false friend mutable namespace new noexcept nullptr operator override private protected public template this throw true try typename using virtual".split())
_HOLDERS = ("namespace", "extern", "class", "struct", "union")


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    #: For an opening bracket the place of its partner, else -1.
    mate: int = -1


class Function(NamedTuple):
    name: str
    line: int
    end_line: int
    shape: str
    calls: list[str]
    literals: list[str]


def tokens(source: str, lang: str) -> list[Token]:
    """Tokens with bracket partners; ValueError where brackets don't match or a token can't be read."""
    if lang != "rust":
        source = _DIRECTIVE.sub(lambda m: "\n" * m[0].count("\n"), source)
    out: list[Token] = []
    open_at: list[int] = []
    at, line = 0, 1
    for found in _SCAN.finditer(source):
        if found.start() != at:
            break
        kind, text, at = found.lastgroup, found[0], found.end()
        if kind == "sign":
            if text in _CLOSE:
                open_at.append(len(out))
            elif text in ")]}":
                if not open_at or _CLOSE[out[open_at[-1]].text] != text:
                    raise ValueError(f"bracket without partner at line {line}")
                first = open_at.pop()
                out[first] = Token(kind, out[first].text, out[first].line, len(out))
            out.append(Token(kind, text, line))
        elif kind == "name" or kind == "number":
            out.append(Token(kind, text, line))
        else:  # what may span lines
            if kind != "blank":
                out.append(Token("string" if kind in ("hash", "mark") else kind, text, line))
            line += text.count("\n")
    if at < len(source):
        raise ValueError(f"no token at line {line}")
    if open_at:
        raise ValueError(f"bracket without partner at line {out[open_at[-1]].line}")
    return out


@functools.lru_cache(maxsize=1 << 14)
def _hash(run: str) -> str:
    return hashlib.sha256(run.encode()).hexdigest()


def _shape(all_tokens: list[Token], begin: int, end: int, words: frozenset) -> str:
    """Hash of a token run from its innermost brackets up."""
    stack: list[list[str]] = [[]]
    closing: list[int] = []
    for i in range(begin, end):
        t = all_tokens[i]
        if closing and i == closing[-1]:
            closing.pop()
            inner = f"({_hash(','.join(stack.pop()))}"
            stack[-1].append(inner + t.text)
        elif t.mate >= 0:
            stack[-1].append(t.text)
            stack.append([])
            closing.append(t.mate)
        elif t.kind == "name":
            stack[-1].append(t.text if t.text in words else "id")
        else:
            stack[-1].append(t.text if t.kind == "sign" else t.kind)
    return _hash(",".join(stack[0]))


def _calls(ts: list[Token], begin: int, end: int, lang: str) -> list[str]:
    """Names called in a token run: a name before an argument list, and in Rust a macro's name, whose arguments are no code yet."""
    found, i = set(), begin
    while i < end:
        t = ts[i]
        if t.kind == "name" and i + 1 < end:
            after = ts[i + 1]
            if lang == "rust" and after.text == "!" and i + 2 < end and ts[i + 2].mate >= 0:
                found.add(t.text)
                i = ts[i + 2].mate
            elif after.text == "(" and not (i and ts[i - 1].text == "fn"):
                found.add(t.text)
        i += 1
    return sorted(found - NO_NAMES)


def _literals(ts: list[Token], begin: int, end: int, lang: str) -> list[str]:
    found, i = set(), begin
    while i < end:
        t, text = ts[i], ts[i].text
        if t.kind == "string" and lang != "rust":  # strings side by side are one
            while i + 1 < end and ts[i + 1].kind == "string":
                i += 1
                text += " " + ts[i].text
        if t.kind in ("string", "char", "number") or (lang == "rust" and text in ("true", "false")):
            found.add(text.strip())
        i += 1
    return sorted(x for x in found if 0 < len(x) <= LONGEST_LITERAL)


def _function(ts: list[Token], lang: str, name: str, first: int, body: int) -> Function:
    last = ts[body].mate
    return Function(name, ts[first].line, ts[last].line, _shape(ts, first, last + 1, _KEYWORDS[lang]), _calls(ts, body, last, lang), _literals(ts, first, last, lang))


def _rust(ts: list[Token]) -> Iterator[Function]:
    before = {"pub", "const", "async", "unsafe", "extern", "default", "crate", "super", "in", "(", ")"}
    i = 0
    while i < len(ts):
        if ts[i].text != "fn" or i + 1 >= len(ts) or ts[i + 1].kind != "name":
            i += 1
            continue
        name, k = ts[i + 1].text, i + 2
        while k < len(ts) and ts[k].text not in ("{", ";"):
            k = ts[k].mate + 1 if ts[k].mate >= 0 else k + 1
        if k >= len(ts) or ts[k].text == ";":
            i = k + 1
            continue
        first = i
        while first and (ts[first - 1].text in before or (ts[first - 1].kind == "string" and first > 1 and ts[first - 2].text == "extern")):
            first -= 1
        while ts[first].text in ("(", ")"):  # what closes the item before
            first += 1
        yield _function(ts, "rust", name, first, k)
        i = ts[k].mate + 1


def _c_like(ts: list[Token], lang: str) -> Iterator[Function]:
    i = first = 0
    while i < len(ts):
        text = ts[i].text
        if text in (";", "}") or (text == ":" and i and ts[i - 1].text in ("public", "private", "protected")):
            first = i + 1
        elif text == "{":
            head = range(first, i)
            name, assigned, k = "", False, first
            while k < i:
                if ts[k].mate >= 0:
                    if ts[k].text == "(" and not name and k > first and ts[k - 1].kind == "name" and ts[k - 1].text not in _KEYWORDS[lang] and ts[k - 1].text not in ("__attribute__", "alignas"):
                        name = ts[k - 1].text
                    k = ts[k].mate
                elif ts[k].text == "=" and not name:
                    assigned = True
                k += 1
            if name and not assigned:
                yield _function(ts, lang, name, first, i)
                i = ts[i].mate
            elif any(ts[k].text in _HOLDERS for k in head) and not assigned:
                pass  # what it holds may be functions
            else:
                i = ts[i].mate
            first = i + 1
        elif ts[i].mate >= 0:
            i = ts[i].mate
        i += 1


def functions(source: str, lang: str) -> list[Function]:
    """Function definitions of a source, outermost ones only, in order."""
    ts = tokens(source, lang)
    found = _rust(ts) if lang == "rust" else _c_like(ts, lang)
    return [f for f in found if f.name not in NO_NAMES]


_FOUND = "work_id string, path string, blob string, lang string, symbol string, line int, end_line int, shape string, calls array<string>, literals array<string>, warning string"


def extract(blobs: DataFrame) -> DataFrame:
    """A row for each function of (work_id, path, blob, text) sources, or one with a warning for a source that can't be read.

    Files of other languages give nothing; of functions with the same name on the same line the first counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for work, path, blob, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    own = {(f.line, f.name): f for f in reversed(functions(text or "", lang))}
                except (ValueError, RecursionError) as error:
                    rows.append((work, path, blob, lang, None, None, None, None, None, None, f"parse failed: {path}: {error}"))
                    continue
                rows += [(work, path, blob, lang, f.name, f.line, f.end_line, f.shape, f.calls, f.literals, None) for f in reversed(own.values())]
            kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            names = [c.split()[0] for c in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    code = blobs.select("work_id", "path", "blob", P.language(F.col("path")).alias("lang"), "text").where(F.col("lang").isin("c", "cpp", "rust"))
    return code.mapInArrow(run, _FOUND)


def edges(found: DataFrame) -> DataFrame:
    """(work_id, path, line, symbol, callee) of each call."""
    return found.where("symbol is not null").select("work_id", "path", "line", "symbol", F.explode("calls").alias("callee"))


def resolved(found: DataFrame) -> DataFrame:
    """Calls joined to the function they name, where exactly one of the work has that name."""
    named = found.where("symbol is not null").groupBy("work_id", F.col("symbol").alias("callee"))
    target = F.min(F.struct(F.col("path").alias("callee_path"), F.col("line").alias("callee_line"))).alias("t")
    one = named.agg(F.count(F.lit(1)).alias("n"), target).where("n = 1").select("work_id", "callee", "t.*")
    return edges(found).join(one, ["work_id", "callee"])


def units(found: DataFrame) -> DataFrame:
    """Units of functions with what they call and who calls them, by (path, line, symbol)."""
    called = resolved(found).groupBy("work_id", F.col("callee_path").alias("path"), F.col("callee_line").alias("line"), F.col("callee").alias("symbol")).agg(F.array_sort(F.collect_set(F.col("symbol"))).alias("incoming_names"))
    own = found.where("symbol is not null").join(called, ["work_id", "path", "line", "symbol"], "left")
    return own.select(
        "work_id",
        P.stable_id("unit_", F.col("path"), F.col("symbol"), F.col("line").cast("string")).alias("unit_id"),
        "path",
        "symbol",
        F.lit("function").alias("kind"),
        "lang",
        "line",
        "end_line",
        "shape",
        "blob",
        F.col("calls").alias("outgoing_names"),
        F.coalesce("incoming_names", F.array().cast("array<string>")).alias("incoming_names"),
        "literals",
    )


def warnings(found: DataFrame, most: int = MOST_WARNINGS) -> DataFrame:
    """(work_id, warning): the first warnings of each work, by path."""
    first = F.row_number().over(Window.partitionBy("work_id").orderBy("path"))
    return found.where("warning is not null").withColumn("rn", first).where(F.col("rn") <= most).select("work_id", "warning")
