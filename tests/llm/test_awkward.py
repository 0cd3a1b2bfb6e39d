"""Long words and texts, colliding hashes, clashing columns, and brute force for the queries that SQL can't express."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import _common, language_id, quality_model, secret_scan, simhash, token_binary, token_counts

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parity_pairs():
    """Words that any polynomial hash modulo 2^64 confuses: two blocks in the order of bit parity, and the complement."""
    for a, b in (("a", "b"), ("x", "q"), ("th", "er"), ("é", "ü")):
        for n in (128, 1024, 2048):
            yield "".join(b if i.bit_count() & 1 else a for i in range(n))
            yield "".join(a if i.bit_count() & 1 else b for i in range(n))


@pytest.mark.parametrize("chunk", [5, 100, token_counts.CHUNK])
def test_words_of_equal_hash_are_told_apart(spark, path, library, chunk):
    texts = [*parity_pairs(), " ".join(parity_pairs()), *parity_pairs()]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = token_counts.token_counts(docs, chunk=chunk).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(w) for w in want]
    ids, sizes = token_binary.Encoder(path).encode(texts)
    assert ids.tolist() == [i for w in want for i in w + [2]] and sizes.tolist() == [len(w) + 1 for w in want]


def long_texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield "".join(rng.choice(letters) for _ in range(150_000))  # one word
    yield "x" * 300_000
    yield "".join(rng.choice(letters + "0123456789+/'é日") for _ in range(400_000))  # no blank
    yield "日本語" * 100_000 + " é" * 9
    yield "plain words, " * 60_000


def test_long_words_and_texts(path, library):
    texts = [*long_texts()]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_counts.Counter(path).counts(texts) == [len(w) for w in want]
    for giant in (token_binary.GIANT, 1000):
        ids, sizes = token_binary.Encoder(path, giant).encode(texts)
        assert ids.tolist() == [i for w in want for i in w + [2]] and sizes.tolist() == [len(w) + 1 for w in want]


def test_slices_change_nothing():
    rng = random.Random(4)
    text = " ".join(rng.choice(("Alpha", "beta,", "été", "12", "ΣΑΣ", "日本" * 9, "\n")) for _ in range(3000))
    whole = Counter(np.concatenate([*language_id.gram_codes(text)]).tolist())
    for size in (1, 2, 97, 5000):
        assert Counter(np.concatenate([*language_id.gram_codes(text, size)]).tolist()) == whole
        assert simhash.fingerprint(text, block=size) == simhash.fingerprint(text)
    for size in (300, 5000):
        assert all(np.array_equal(a, b) for a, b in zip(quality_model.encode([None, text, "a b"], size), quality_model.encode([None, text, "a b"]), strict=True))


def test_memory_of_a_text_of_twenty_million_characters():
    """Beyond the text itself, memory doesn't grow with the text's length: it is worked on slice by slice."""
    import tracemalloc

    text = "some plain words of a very long text, over and over again\n" * 345_000
    tracemalloc.start()
    simhash.fingerprint(text)
    language_id.gram_counts(language_id.gram_codes(text))
    quality_model.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 20_000_000 and peak < 10 * len(text)


def test_taken_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "one two three", "mine", 5)], "doc_id long, text string, Score string, n_tokens int")
    assert token_counts.token_counts(docs).first()["n_tokens"] == 3
    assert quality_model.score(docs, None).first()["score"] == 0.5
    found = language_id.predict(docs, language_id.Profiles({})).first()
    assert (found["score"], found["lang_pred"], found["n_tokens"]) == (0.0, "und", 5)
    assert simhash.fingerprints(docs, name="n_tokens").first()["n_tokens"] == _signed(simhash.fingerprint("one two three"))


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_secrets_are_linear_in_matches(spark):
    rng = random.Random(5)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(20_000)]
    docs = spark.createDataFrame([(1, "é " + " ".join(keys))], "doc_id long, text string")
    spans = secret_scan.with_spans(docs, "text").first()["__all"]
    assert [tuple(x) for x in spans] == [(2 + 25 * k, 2, 26 + 25 * k) for k in range(len(keys))]
    assert secret_scan.redact(docs).first()["text"] == "é " + " ".join(["[SECRET]"] * len(keys))


LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"


@pytest.mark.parametrize(
    ("letters", "least"),
    [(DIGITS + "abcdef", 0.98), (DIGITS + "ABCDEF", 0.98), (LETTERS + DIGITS, 0.98), (LETTERS.upper() + DIGITS, 0.98), (LETTERS + LETTERS.upper() + DIGITS, 0.95), (LETTERS + LETTERS.upper() + DIGITS + "+/", 0.94)],
)
def test_random_keys_are_found(spark, letters, least):
    rng = random.Random(6)
    keys = [(i, "key " + "".join(rng.choice(letters) for _ in range(n)) + " end") for i, n in enumerate([20, 24, 32, 40] * 250)]
    found = secret_scan.with_spans(spark.createDataFrame(keys, "doc_id long, text string"), "text")
    assert found.where(F.size("__all") > 0).count() >= least * len(keys)


def test_plain_runs_are_left_alone(spark):
    texts = ["src/main/python/package_name/module2/file_name", "getUserNameFromTheDatabase2", "2024-11-26_weekly-report_final", "internationalization2024", "see /usr/local/share/documents2/readme", "z" * 30 + "1" * 10]
    found = secret_scan.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text")
    assert found.where(F.size("__all") > 0).count() == 0


def best_window(run):
    bits = lambda w: -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())
    return max(bits(run[i : i + 20]) for i in range(len(run) - 19))


def test_windows_across_parts(spark):
    rng = random.Random(7)
    runs = ["".join(rng.choice("ab1") for _ in range(n)) + "".join(rng.choice(LETTERS + DIGITS) for _ in range(20)) for n in (0, 1, 5, 990, 1004, 1010, 1023, 1024, 1030, 2040)]
    runs += [r + "aa1" * 500 for r in runs]
    got = spark.createDataFrame(list(enumerate(runs)), "i int, run string").select("i", secret_scan._windows(F.col("run")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: pytest.approx(best_window(run)) for i, run in enumerate(runs)}


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        padded = "\x01" + w + "\x01"
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    # the mark between two words is one mark, so pairs of a letter and a mark count for each word's own sides
    return out


def plain_code(gram):
    return int.from_bytes(b"", "big") if not gram else sum(ord(c) << 21 * k for k, c in enumerate(reversed(gram)))


def plain_top(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], plain_code(x[0])))[:300]]


def test_language_query_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = {"en": "the of and house river stone light paper", "de": "der die und haus fluss stein licht über", "fr": "le la et maison rivière pierre lumière papier"}
    texts = [(i, " ".join(rng.choice(vocabulary[lang].split()) for _ in range(rng.randint(1, 60))), lang) for i, lang in enumerate(list(vocabulary) * 40)]
    texts += [(500, None, "en"), (501, "12 34!", "de"), (502, "maison house haus", None), (503, "ÉTÉ Über-Haus, l'eau", "fr"), (504, "", "fr")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.op2_language_id(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in texts}
    assert {i: r["held_out"] for i, r in got.items()} == held and 0 < sum(held.values()) < len(held)
    profiles = {}
    for lang in vocabulary:
        counts = Counter()
        for i, text, own in texts:
            if own == lang and not held[i] and text:
                counts += plain_grams(text)
        profiles[lang] = {g: k for k, g in enumerate(plain_top(counts))}
    for i, text, _ in texts:
        grams = plain_top(plain_grams(text or ""))
        if not grams:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(abs(k - own[g]) if g in own else 300 for k, g in enumerate(grams)) / (300 * len(grams)) for lang, own in profiles.items()}
        best = min(sorted(far), key=far.get)
        rival = min(far[lang] for lang in far if lang != best)
        score = rival / (rival + far[best]) if rival + far[best] else 0.5
        assert (got[i]["lang_pred"], got[i]["score"]) == (best, pytest.approx(score))


def plain_passages(text):
    words = BLANK.findall(text or "")
    return [words[i : i + 64] for i in range(0, len(words), 64)] or [[]]


def plain_features(words):
    signs = quality_model._SIGNS
    raw = [w.encode() for w in words]
    kinds = Counter()
    for b in b"".join(raw):
        c = bytes([b])
        name = 5 if b > 127 else 2 if c in b"aeiou" else 1 if c.islower() else 3 if c.isupper() else 4 if c.isdigit() else 7 + signs.index(c) if c in signs else 6
        kinds[name] += 1
    n, some = len(words), max(1, len(words))
    chars = sum(map(len, raw))
    share = lambda test: sum(map(test, raw)) / some
    out = [kinds[k] / max(1, chars) for k in range(quality_model.CLASSES)]
    if not n:
        return [0.0] * quality_model.FEATURES, []
    out += [math.log1p(n), chars / some, len(set(raw)) / some, sum(a == b for a, b in zip(raw, raw[1:], strict=False)) / some]
    out += [share(lambda w: len(w) <= 3), share(lambda w: len(w) >= 12), share(lambda w: w[:1].isupper()), share(lambda w: w[-1:] in signs and w[-1] < 128)]
    hashes = []
    for w in raw:
        h, power = 0, 1
        for b in w:
            h = (h + (b + 1) * power) % 2**64
            power = power * 0x9E3779B97F4A7C15 % 2**64
        hashes.append(h)
    terms = [h * 0xD6E8FEB86659FD93 % 2**64 >> 52 for h in hashes]
    terms += [(a * 0xBF58476D1CE4E5B9 + b) * 0x94D049BB133111EB % 2**64 >> 52 for a, b in zip(hashes, hashes[1:], strict=False)]
    return out, terms


def plain_score(text, model):
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p, hidden, weights = model.p, [], []
    for words in plain_passages(text):
        x, terms = plain_features(words)
        x = [(np.float32(v) - m) / s for v, m, s in zip(x, model.mean, model.spread, strict=True)]
        x += list(np.mean([p["E"][t] for t in terms], axis=0)) if terms else [0.0] * quality_model.LEXICAL
        h = [max(0.0, sum(a * w for a, w in zip(x, column, strict=True)) + b) for column, b in zip(p["W"].T, p["b"], strict=True)]
        gate = [math.tanh(np.dot(h, v)) * sigmoid(np.dot(h, u)) for v, u in zip(p["V"].T, p["U"].T, strict=True)]
        hidden.append(h)
        weights.append(math.exp(np.dot(gate, p["w"])))
    z = [sum(w * h[k] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for k in range(len(hidden[0]))]
    return sigmoid(np.dot(z, p["c"]) + p["d"][0])


def test_quality_query_by_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = "the of and House river stone light paper international été 12 a".split()
    junk = ["###", "$$$!!", "BUY", "www.x.y"]
    texts = [(i, " ".join(rng.choice(words + junk * (i % 2)) for _ in range(rng.randint(1, 150)))) for i in range(90)] + [(200, None), (201, " \n"), (202, "one")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2) for i in range(90)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_model.op9_quality_model(spark, str(tmp_path)).collect()}
    model = quality_model.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for i, text in texts:
        score = plain_score(text, model)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["score"] == pytest.approx(score, rel=1e-4, abs=1e-6) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    held = [i for i, _ in texts[:90] if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == 1 - i % 2 for i in held]) > 0.8


def test_running_sums(spark):
    rng = random.Random(10)
    values = [(rng.randint(0, 9), i, rng.randint(1, 5)) for i in range(500)]
    df = spark.createDataFrame(values, "k int, i int, v long")
    got = {r["i"]: (r["before"], r["many"]) for r in _common.running(df, [F.asc("k"), F.asc("i")], {"before": "v", "many": "i"}).collect()}
    a = b = 0
    for _k, i, v in sorted(values):
        assert got[i] == (a, b)
        a, b = a + v, b + i
