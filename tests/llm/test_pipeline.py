"""Every stage of the pipeline, and its run, against plain Python over all documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from test_awkward import plain_grams, plain_top
from test_operators import BLANK, components, plain_fingerprint, plain_spans, plain_targets
from test_packing import least_padding

import corpus_pipeline
from tallyloom.llm import mixture, packing, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORDS = {"en": "the of and house river stone light paper wind tree", "de": "der die und haus fluss stein licht über baum wind", "fr": "le la et maison rivière pierre lumière papier vent arbre"}


def documents():
    rng, rows = random.Random(11), []
    for i in range(120):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, 80)))
        if i % 9 == 0:
            text += " token=" + "".join(rng.choice("abcdef0123456789") for _ in range(30)) + " end"
        if i % 13 == 0:
            text += " key " + "".join(rng.choice("abcdefXYZ0123456789") for _ in range(26))
        rows.append((i, text, lang if i % 5 else None, rng.choice(("a", "b", "c", None)) if i % 3 else "a"))
    rows += [(200 + i, rows[i][1], "en", "b") for i in range(0, 40, 4)]  # copies
    rows += [(300 + i, rows[i][1] + " again", "en", "c") for i in range(1, 30, 4)]
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, "12 34 !", "de", "b"), (403, "x", None, None), (404, rows[3][1], None, None)]
    return [(i, t, lang, s, len(t) if t else None, f"own {i}") for i, t, lang, s in rows]


def plain_language(docs):
    counts = {}
    for i, text, lang, *_ in docs:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2 and text:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    known = any(plain_top(c) for c in counts.values())
    return [d for d in docs if known and plain_grams(d[1] or "")]


def plain_dedup(docs):
    prints = {d[0]: plain_fingerprint(d[1]) for d in docs}
    links = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    part = components(prints, links)
    return [d for d in docs if part[d[0]] == d[0]]


def plain_entropy(text, base):
    for m in re.finditer(secret_scan.RUN, text):
        run = m[0]
        if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or any(re.search(p, run) for p in secret_scan.ALLOWED):
            continue
        if any(a < m.end() and b > m.start() for a, _, b in base):
            continue
        best = max(-sum(n / 20 * math.log2(n / 20) for n in Counter(run[i : i + 20]).values()) for i in range(len(run) - 19))
        if best >= next(bits for p, bits in secret_scan.CLASSES if re.search(p, run)):
            yield m.start(), 3, m.end()


def plain_redaction(docs):
    out = []
    for i, text, lang, source, n, score in docs:
        base = plain_spans(text)
        spans, at, clean = sorted([*base, *plain_entropy(text, base)]), 0, ""
        for a, _, b in spans:
            if a >= at:
                clean += text[at:a] + "[SECRET]"
            at = max(at, b)
        clean += text[at:]
        out.append((i, clean, lang, source, len(clean) if spans else n, score))
    return out


def plain_mixture(docs):
    sizes = {d[0]: len(BLANK.findall(d[1])) for d in docs}
    by = {}
    for d in docs:
        by.setdefault(d[3], []).append(d)
    goal = plain_targets({s: sum(sizes[d[0]] for d in own) for s, own in by.items()})
    out = []
    for source, own in by.items():
        total = sum(sizes[d[0]] for d in own)
        rate = goal[source] / total if total else 0.0
        name = f"{mixture.SEED}:n" if source is None else f"{mixture.SEED}:s{source}"
        shift = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32
        ordered = sorted(own, key=lambda d: (-sizes[d[0]], d[0]))
        slopes = ordered[0::2][::-1] + ordered[1::2]
        for k, d in enumerate(slopes):
            out += [d] * (math.floor((k + 1) * rate + shift) - math.floor(k * rate + shift))
    return out


PLAIN = {"language_id": plain_language, "simhash_near_dedup": plain_dedup, "secret_scan": plain_redaction, "mixture": plain_mixture}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """For each stage its input, and its output, both as plain rows."""
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(documents(), DOCS).write.parquet(f"{at}/documents.parquet")
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        seen[name] = (before, [tuple(r) for r in docs.collect()])
    return at, seen


@pytest.mark.parametrize("name", PLAIN)
def test_stage(stages, name):
    before, after = stages[1][name]
    want = PLAIN[name](before)
    assert sorted(after, key=str) == sorted(want, key=str)
    assert want and want != before


def test_whole_run(spark, stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents()
    for stage in PLAIN.values():
        docs = stage(docs)
    lengths = [(d[0], len(library.encode(d[1], add_special_tokens=False).ids)) for d in docs]
    got = corpus_pipeline.run(spark, stages[0]).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted(lengths)
    assert sum(r["padding"] for r in got) == least_padding([n for _, n in lengths], packing.BUCKETS)
    places = [(r["bucket"], r["batch"], r["slot"]) for r in got]
    assert len(set(places)) == len(places) and all(r["padding"] == r["bucket_len"] - r["length"] >= 0 for r in got)
    full = Counter((b, k) for b, k, _ in places)
    longest = {r["bucket"]: r["bucket_len"] for r in got}
    assert all(n * longest[b] <= max(packing.BUDGET, longest[b]) for (b, _), n in full.items())
