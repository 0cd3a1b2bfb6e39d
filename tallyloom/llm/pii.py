"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Every text is scanned for candidate spans: the four base patterns (whose matches that pass their check are
always returned), base matches that fail, and looser ones: spelled-out addresses, local telephone
numbers, names, bank accounts and social security numbers. `LABELERS` vote yes, no or nothing
on a candidate: the pattern's check, a gazetteer (endings of domains, issuers, country codes, given names and titles),
cue words before the span, its edges, and its shape. From the counts of all vote patterns
of all documents (at most `3 ** 5` a kind) expectation-maximisation estimates how often each labeler is right for
each kind, and so how likely a candidate with those votes is personal data. A logistic classifier over traits
of the span learns these likelihoods, again from sums over all candidates (at most `CELLS` cells of
traits), and decides on every span that is no base match; spans that overlap a base match are left out.

Defined results: null text counts as empty and has no spans (the SHA-256 is that of the empty string);
repeated rows are scanned each on its own; without candidates nothing is learned and the priors
stand; a text of any length is scanned once, whole, in time in proportion; columns of the input
that bear the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from ._common import _runs, durable, small_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_spelled", "phone_local", "name", "iban", "ssn")
LABELERS = ("check", "gazetteer", "cue", "edges", "shape")
NOTHING, NO, YES = range(3)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[A-Za-z0-9-]{2,63})+")
_AT = re.compile(r"[\[({] ?at ?[\])}]")
_LOOSE = re.compile(r"(?<![0-9A-Za-z+./-])(?:\(0?[0-9]{2,4}\)|0[0-9]{1,4})[ /.-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])")
_NAME = re.compile(r"(?<![\w.-])[A-ZÀ-Þ][a-zà-ÿ]{1,30}(?:\. | )[A-ZÀ-Þ][a-zà-ÿ]{1,30}(?:[ -][A-ZÀ-Þ][a-zà-ÿ]{1,30}){0,2}(?![\w])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_WORDS = re.compile(r"[^\W\d_]+")

# Gazetteers, cue words and words that speak against a kind.
ENDINGS = frozenset("com org net edu gov info io co uk de fr es it nl be ch at pl se no dk fi pt eu us ca au br in jp cn ru".split())
COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split())
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "380", "420", "421")
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Sir Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña".split())
GIVEN = frozenset(
    "Alexander Alice Ana Andrea Andreas Anna Anne Antonio Barbara Carlos Carmen Catherine Charles Charlotte Christian Christine Claudia Daniel David Diego Elena Elisabeth Elizabeth Emily Emma "
    "Eva Fernando Francisco Frank Gabriel George Hans Heinrich Helen Henry Isabel Jack James Jan Jane Javier Jean Jennifer Jessica Johann John Jonas Jorge Joseph José Juan Julia Julie Karl "
    "Katharina Klaus Laura Linda Louis Louise Lucas Lucia Luis Lukas Manuel Marc Maria Marie Mark Martin Mary Matthew Max Michael Michel Miguel Monika Nathalie Nicolas Nina Olivier Oscar "
    "Pablo Patricia Paul Pedro Peter Philippe Pierre Rafael Richard Robert Rosa Sabine Sarah Simon Sofia Sophie Stefan Stephen Susan Susanne Teresa Thomas Ursula Victor Walter William Wolfgang".split()
)
CUES = {
    "email": frozenset("mail email courriel correo contact kontakt contacto write schreiben".split()),
    "ip": frozenset("ip address host server client adresse dirección from".split()),
    "card": frozenset("card visa mastercard credit debit karte kreditkarte carte tarjeta pan".split()),
    "phone": frozenset("phone tel telephone telefon téléphone teléfono call mobile cell fax handy ring".split()),
    "name": frozenset("name called named dear regards sincerely signed heiße appelle llamo patient author contact".split()),
    "iban": frozenset("iban account konto compte cuenta bank transfer".split()),
    "ssn": frozenset("ssn social security insurance taxpayer".split()),
}
CUES["email_spelled"], CUES["phone_local"] = CUES["email"], CUES["phone"]
COUNTER = frozenset("version release build isbn issn order serial figure fig table page chapter section line license licence part commit hash invoice model item sku".split())

#: Traits of a span: their names and how many values each has.
TRAITS = {"kind": len(KINDS), "size": 6, "digits": 4, "edges": 9, "cue": 3, "parts": 4}
CELLS = int(np.prod(list(TRAITS.values())))
#: Characters before a span that are searched for cues.
_BEFORE = 32
#: What is thought of labelers before any vote: right at this rate, as if seen so many times; rounds at most.
PRIOR_RIGHT, PRIOR_WEIGHT, ROUNDS = 0.85, 50.0, 100
#: A span that is no base match counts as personal data from this likelihood.
THRESHOLD = 0.5


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool
    votes: int
    cell: int


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, leftmost first; each run of characters before an @ is passed once."""
    last, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > last and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = t.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]+", "", s)


def base_matches(t: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, passed) of the base patterns' matches."""
    if "@" in t:
        yield from ((0, a, b, True) for a, b in emails(t))
    for m in _IP.finditer(t):
        yield 1, m.start(), m.end(), all(_small(p) for p in m[0].split("."))
    for m in _CARD.finditer(t):
        if 13 <= m.end() - m.start() <= 37:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19:
                yield 2, m.start(), m.end(), luhn(digits)
    if "+" in t:
        for m in _PHONE.finditer(t):
            yield 3, m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15


def _spelled(t: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _AT.finditer(t):
        found = _SPELLED.search(t, max(last, m.start() - 66), min(len(t), m.end() + 260))
        if found:
            last = found.end()
            yield found.start(), last


def loose_matches(t: str) -> Iterator[tuple[int, int, int, bool | None]]:
    """(kind, start, end, check) of the looser patterns; check is None where there is none."""
    yield from ((4, a, b, None) for a, b in _spelled(t))
    yield from ((5, m.start(), m.end(), 9 <= len(_digits(m[0])) <= 12 or None) for m in _LOOSE.finditer(t))
    yield from ((6, m.start(), m.end(), None) for m in _NAME.finditer(t))
    for m in _IBAN.finditer(t):
        s = m[0].replace(" ", "")
        yield 7, m.start(), m.end(), int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    for m in _SSN.finditer(t):
        yield 8, m.start(), m.end(), m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"


def _known(kind: str, s: str) -> int:
    """The gazetteer's vote."""
    if kind in ("email", "email_spelled"):
        return YES if ENDINGS.intersection(w.lower() for w in _WORDS.findall(s)[-1:]) else NO
    if kind == "ip":
        return NO if s.startswith(("0.", "127.", "255.")) else NOTHING
    if kind == "card":
        return YES if _digits(s).startswith(ISSUERS) else NO
    if kind == "phone":
        return YES if s[1:].lstrip(" (").startswith(CODES) else NO
    if kind == "name":
        first = _WORDS.findall(s)[0]
        return YES if first in GIVEN or first in TITLES else NO
    if kind == "iban":
        return YES if s[:2] in COUNTRIES else NO
    return NOTHING


def _edge(c: str) -> int:
    return 0 if not c or c.isspace() else 2 if c.isalnum() or c in "_=/\\@#&" else 1


def _shaped(kind: str, s: str, digits: str) -> int:
    """The shape's vote: digits all alike or counting up are made up, several groups are written for people."""
    if kind == "name" or not digits:
        return NOTHING
    if len(set(digits)) < 3 or digits in "01234567890123456789":
        return NO
    return YES if kind in ("phone", "phone_local", "ssn", "iban") and len(re.findall("[0-9]+", s)) > 1 else NOTHING


def judged(t: str, kind: int, start: int, end: int, base: bool, check: bool | None) -> Candidate:
    """A candidate with the votes of all labelers and its cell of traits."""
    name, s = KINDS[kind], t[start : min(end, start + 400)]
    before = [w.lower() for w in _WORDS.findall(t[max(0, start - _BEFORE) : start])]
    cue = 1 if any(w in CUES[name] for w in before) else 2 if before and before[-1] in COUNTER else 0
    left, right = _edge(t[start - 1 : start]), _edge(t[end : end + 1])
    digits = _digits(s)
    votes = (
        NOTHING if check is None else YES if check else NO,
        _known(name, s),
        (NOTHING, YES, NO)[cue],
        NO if 2 in (left, right) else YES if name != "name" else NOTHING,
        _shaped(name, s, digits),
    )
    size = min(5, (end - start) // 6)
    share = min(3, 4 * len(digits) // max(1, len(s)))
    parts = min(3, len(re.findall(r"[ .@-]", s)))
    return Candidate(kind, start, end, base, _mixed(votes, [3] * 5), _mixed((kind, size, share, 3 * left + right, cue, parts), TRAITS.values()))


def _mixed(digits, sizes) -> int:
    n = 0
    for d, size in zip(digits, sizes):
        n = n * size + d
    return n


def _unmixed(n: int, sizes) -> list[int]:
    out = []
    for size in reversed(list(sizes)):
        n, d = divmod(n, size)
        out.append(d)
    return out[::-1]


def _free(spans: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """Those of the spans (kind, start, end, check) that overlap none of the taken ones."""
    out, k, reach = [], 0, 0
    for span in sorted(spans, key=lambda x: x[1]):
        while k < len(taken) and taken[k][0] < span[2]:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= span[1]:
            out.append(span)
    return out


def candidates(t: str) -> list[Candidate]:
    """All candidates of a text by kind and start; looser ones that overlap a base match, or an account or
    security number that passes its check, are left out."""
    found, taken = [], []
    for kind, start, end, passed in base_matches(t):
        found.append(judged(t, kind, start, end, passed, passed))
        if passed:
            taken.append((start, end))
    loose = list(loose_matches(t))
    sure = _free([x for x in loose if x[3] and KINDS[x[0]] in ("iban", "ssn")], sorted(taken))
    rest = _free([x for x in loose if not (x[3] and KINDS[x[0]] in ("iban", "ssn"))], sorted(taken + [x[1:3] for x in sure]))
    return sorted(found + [judged(t, *x[:3], False, x[3]) for x in (*sure, *rest)])


_FOUND = ArrayType(StructType([f for n, t in (("kind", IntegerType()), ("start", IntegerType()), ("end", IntegerType()), ("base", BooleanType()), ("votes", IntegerType()), ("cell", IntegerType())) for f in StructType().add(n, t)]))


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """The other columns and `found`, the candidates of each text. The text itself doesn't come back from Python."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if i != at and c.lower() != "found"]
    kind = to_arrow_type(_FOUND)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in _runs(batch.column(at)):
                some = batch.slice(k, n)
                made = [[c._asdict() for c in candidates(t)] if t else [] for t in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in kept), pa.array(made, kind)], [*(some.schema.names[i] for i in kept), "found"])

    return docs.mapInArrow(each, StructType([docs.schema.fields[i] for i in kept]).add("found", _FOUND))


def reliabilities(counts: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """By expectation-maximisation over counts of (kind, votes): the likelihood of personal data by kind,
    and by kind and labeler of a yes vote on personal data and of a no vote on other text."""
    kinds = np.array([k for k, _ in counts], dtype=int)
    votes = np.array([_unmixed(v, [3] * 5) for _, v in counts], dtype=int).reshape(-1, 5)
    n = np.array(list(counts.values()), dtype=float)
    share = np.full(len(KINDS), 0.5)
    right = np.full((len(KINDS), 5, 2), PRIOR_RIGHT)
    for _ in range(ROUNDS):
        before = right.copy()
        p = likelihood(kinds, votes, share, right)
        for k in range(len(KINDS)):
            own = kinds == k
            share[k] = ((n * p)[own].sum() + 1) / (n[own].sum() + 2)
            for j in range(5):
                for side, (weight, agrees) in enumerate(((n * p, YES), (n * (1 - p), NO))):
                    spoke = own & (votes[:, j] != NOTHING)
                    right[k, j, side] = (weight[spoke & (votes[:, j] == agrees)].sum() + PRIOR_RIGHT * PRIOR_WEIGHT) / (weight[spoke].sum() + PRIOR_WEIGHT)
        right = right.clip(0.02, 0.98)
        if np.abs(right - before).max() < 1e-6:
            break
    return share, right


def likelihood(kinds: np.ndarray, votes: np.ndarray, share: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How likely candidates with these votes are personal data, labelers being independent."""
    r = right[kinds]
    yes = np.where(votes == YES, r[:, :, 0], np.where(votes == NO, 1 - r[:, :, 0], 1)).prod(axis=1) * share[kinds]
    no = np.where(votes == NO, r[:, :, 1], np.where(votes == YES, 1 - r[:, :, 1], 1)).prod(axis=1) * (1 - share[kinds])
    return yes / (yes + no)


def _design(cells: np.ndarray) -> np.ndarray:
    """Traits as columns: one for each value of a trait within each kind."""
    traits = np.array([_unmixed(int(c), TRAITS.values()) for c in cells], dtype=int).reshape(-1, len(TRAITS))
    sizes = list(TRAITS.values())[1:]
    x = np.zeros((len(cells), len(KINDS) * (1 + sum(sizes))))
    at, rows = 0, np.arange(len(cells))
    x[rows, traits[:, 0]] = 1
    at = len(KINDS)
    for j, size in enumerate(sizes, start=1):
        x[rows, at + traits[:, 0] * size + traits[:, j]] = 1
        at += len(KINDS) * size
    return x


def span_classifier(cells: np.ndarray, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier that learns, for each cell of traits, the mean likelihood of its `n` candidates (Newton steps, ridge 1)."""
    x = _design(cells)
    w = np.zeros(x.shape[1])
    for _ in range(50 if len(cells) else 0):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (sums - n * p) - w)
        w += step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def trained(found: DataFrame) -> np.ndarray:
    """How likely a candidate of each cell is personal data, learned from all rows of `found`; to the driver go sums by votes and by cell only."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.cell")
    counts = {(r.kind, r.votes): r.n for r in each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros(CELLS)
    share, right = reliabilities(counts)
    kinds = np.array([k for k, _ in counts], dtype=int)
    votes = np.array([_unmixed(v, [3] * 5) for _, v in counts], dtype=int)
    known = [(k, v, float(p)) for (k, v), p in zip(counts, likelihood(kinds, votes, share, right))]
    learned = F.broadcast(found.sparkSession.createDataFrame(known, "kind int, votes int, p double"))  # at most 3 ** 5 rows a kind
    cells = each.join(learned, ["kind", "votes"]).groupBy("cell").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    w = span_classifier(np.array([r.cell for r in cells]), np.array([r.p for r in cells]), np.array([r.n for r in cells], dtype=float))
    out = np.zeros(CELLS)
    for k in range(0, CELLS, 4096):
        out[k : k + 4096] = 1 / (1 + np.exp(-_design(np.arange(k, min(CELLS, k + 4096))) @ w))
    return out


def personal_spans(docs: DataFrame, text: str) -> DataFrame:
    """The other columns of the documents, and n_email, n_ip, n_card, n_phone, base_sha256 and spans (all spans as kind:start:end by kind and start)."""
    found = durable(with_candidates(docs, text), "candidates")
    chosen = (trained(found) >= THRESHOLD).tobytes()
    new = StructType()
    for kind in BASE:
        new = new.add(f"n_{kind}", LongType())
    new = new.add("base_sha256", StringType()).add("spans", StringType())
    kept = [i for i, c in enumerate(found.columns) if c.lower() not in {n.lower() for n in (*new.names, "found")}]
    at = found.columns.index("found")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans = [[] for _ in BASE], [], []
            for every in batch.column(at).to_pylist():
                base = [c for c in every if c["base"]]
                for k, column in enumerate(counts):
                    column.append(sum(c["kind"] == k for c in base))
                shas.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append(_listed([c for c in every if c["base"] or (chosen[c["cell"]] and c["kind"] >= len(BASE))]))
            columns = [*(batch.column(i) for i in kept), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in kept), *new.names])

    return found.mapInArrow(each, StructType([found.schema.fields[i] for i in kept] + new.fields))


def _listed(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[c['kind']]}:{c['start']}:{c['end']}" for c in spans)


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
