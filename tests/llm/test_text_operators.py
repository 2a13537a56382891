"""Row-wise operators of the llm package against plain Python, with odd rows of every kind."""

import base64
import hashlib
import re
import textwrap
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from raretide.llm import bpe, lengths, licenses, quality
from raretide.llm.queries import RANKS

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")  # of licence texts
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (1, "The cat sat on the mat. The cat sat on the mat.\nThe cat\nThe cat", "en", "a"),
    (2, None, "en", None), (3, "", None, "b"), (4, " \t\n\x0b ", "en", "b"), (5, "naïve café — “déjà vu” ½ ₂ 東京 🙂🙂 don't I'LL 's", "fr", "b"),
    (6, "x" * 5000 + " " + "ab " * 4000, None, "b"), (7, "a b c a b c", "en", "b"), (7, "a b c a b c", "en", "b"), (None, "no id", "en", "c"),
    (8, "!!!###   \r\n\r\nA\x1cB\x85C\xa0D", "zz", "c"), (9, "de la de la " * 60, "es", "c"), (10, "one two", "de", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    # names that operators use themselves must not clash
    return df.withColumns({c: F.lit("x") for c in ("n_tokens", "kept", "score", "id", "t", "w", "node", "rate", "label")})


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_what_tiktoken_gives(docs, encoding):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.token_ids))
                  for r in bpe.encode_decode(docs, PATH, PATTERN, with_ids=True).collect())
    expected = Counter()
    for doc_id, text, *_ in ODD:
        ids = encoding.encode_ordinary(text or "")
        joined = " ".join(map(str, ids)).encode()
        expected[doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), tuple(ids)] += 1
    assert got == expected


def test_plain_split_equals_the_full_pattern():
    codec = bpe.Codec(bpe.read_ranks(PATH), PATTERN)
    characters = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2060), 0x20AC, 0x20AB, 0x3000, 0x4E00, 0x1F600]]
    for c in characters:
        for text in (c, f"a{c}b", f" {c}", f"{c} ", f"1{c}{c}2", f"'{c}s", f"{c}\n{c} x"):
            assert codec.split(text) == codec.full.findall(text), repr(text)


def test_split_of_every_code_point_is_that_of_tiktoken():
    single = tiktoken.Encoding("bytes", pat_str=r"\p{L}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    numbers = tiktoken.Encoding("bytes", pat_str=r"\p{N}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = " ".join(map(chr, points))
    codec = bpe.Codec(bpe.read_ranks(PATH), PATTERN)
    for encoding, sample in ((single, "a"), (numbers, "1")):
        theirs = set(bytes(encoding.encode_ordinary(everything)).decode())
        for c in map(chr, points):
            if bpe._NOT_PLAIN.match(c):  # joined with the sample: one piece if both are of one class
                assert (len(codec.split(c + sample)) == 1) == (c in theirs), hex(ord(c))


def test_newly_assigned_letters_are_encoded_as_tiktoken_does(spark, encoding):
    rows = [(i, text) for i, text in enumerate(["\U0001df22't", "a\ua7cea \U00010940x", " \U00012550\U00012551 12", "\u0c5c\u0c5c's \U0002b73a!"])]
    for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, PATTERN, with_ids=True).collect():
        assert r.token_ids == encoding.encode_ordinary(rows[r.doc_id][1])


def test_bpe_of_an_empty_table(docs):
    assert bpe.encode_decode(docs.where("false"), PATH, PATTERN).collect() == []


def test_length_histogram(spark, docs, encoding):
    n = [len(encoding.encode_ordinary(text or "")) for _, text, *_ in ODD]
    for df, values in ((lengths.encoded_lengths(docs, PATH, PATTERN), n),
                       (spark.createDataFrame([(x,) for x in [5000, 5000, 1, 70000, 4096, 4095, 0]], "n_tokens bigint"), [5000, 5000, 1, 70000, 4096, 4095, 0])):
        histogram = lengths.length_histogram(df).cache()
        rows = {r.n_tokens: r for r in histogram.collect()}
        assert set(rows) == set(values)
        for limit, r in rows.items():
            assert r.n_docs == values.count(limit)
            assert r.docs_at_least == sum(v >= limit for v in values)
            assert r.tokens_at_least == sum(v for v in values if v >= limit)
            assert r.docs_up_to == sum(v <= limit for v in values)
            assert r.truncated_tokens == sum(min(v, limit) for v in values)
        at = lengths.totals_at(histogram, 10).first()
        assert (at.docs, at.tokens, at.truncated_tokens, at.docs_cut) == (
            len(values), sum(values), sum(min(v, 10) for v in values), sum(v > 10 for v in values))
        assert lengths.length_quantile(histogram, 0.5).first()[0] == sorted(values)[-(-len(values) // 2) - 1]
    empty = lengths.length_histogram(docs.where("false").select(F.lit(1).alias("n_tokens")))
    assert empty.collect() == [] and lengths.length_quantile(empty, 0.5).first()[0] is None


def repeated(words):
    counts, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if counts[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(covered)


def test_base_counts(docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.quality_verdicts(docs).collect())
    expected = Counter()
    for doc_id, text, *_ in ODD:
        words, seen, again = WORDS.findall(text or ""), set(), 0
        for line in (text or "").split("\n"):
            if WORDS.search(line):
                again += line in seen
                seen.add(line)
        n = repeated(words)
        expected[doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, n,
                 len(words) < 50 or 100 * n > 50 * len(words)] += 1
    assert got == expected


def test_chance_agreement_of_hashes_is_resolved(spark, monkeypatch):
    """With a hash of few values, windows that agree in it are told apart as words."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.pmod(F.hash(*c), F.lit(3)).cast("long") * (1 << 40))
    texts = ["a b c d a b c e f g a b", "a b c d e f g h i", "a a a a a", "x y z w x y z"]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "i int, w array<string>")
    out = {r.i: r.n for r in quality.with_repeated_words(df, "w", "n").collect()}
    assert out == {i: repeated(t.split()) for i, t in enumerate(texts)}


def test_divergence_rejects_other_text(spark):
    prose = ["the {} of {} and to {} in {} is {} that it was for {} with as".format(*[chr(97 + (i * k) % 26) * 5 for k in range(1, 7)]) for i in range(40)]
    rows = [(i, " . ".join(prose[j % 40] + chr(97 + j % 26) * 3 for j in range(i, i + 12)), "en" if i % 3 else None) for i in range(30)]
    rows += [(100, " ".join(f"qz{i}***" for i in range(300)), "en"), (101, " ".join(f"wort{i}" for i in range(300)), "en"), (102, "### %%% " * 4, "en")]
    out = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(out[i].kept for i in range(30))
    assert not out[100].kept and not out[100].base_failed and out[100].char_distance > quality.MAX_CHAR_DISTANCE
    assert not out[101].kept and out[101].word_distance > quality.MAX_WORD_DISTANCE
    assert out[102].base_failed  # too short for the histograms to count


def test_quality_of_an_empty_table(docs):
    assert quality.quality_verdicts(docs.where("false")).collect() == []


def dice(unit, template):
    def grams(text):
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())
        return set(zip(w, w[1:]))
    a, b = grams(unit), grams(template)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def expected_licenses(texts):
    """Best unit of each document and licence: lines, whole texts, and windows from every bigram of the template."""
    found = {}
    for i, t in texts:
        t = t or ""
        lines = t.split("\n")
        line_of = [k for k, line in enumerate(lines) for _ in WORD.findall(line.lower())]
        w = WORD.findall(t.lower())
        for (lic, wording), template in licenses.TEMPLATES.items():
            tw = WORD.findall(template.lower())
            own = set(zip(tw, tw[1:]))
            units = [*enumerate(lines), *([(-1, t)] if len(lines) > 1 else [])]
            units += [(line_of[p], " ".join(w[p:p + len(tw)])) for p in range(len(w) - 1) if (w[p], w[p + 1]) in own]
            for line, unit in units:
                d = dice(unit, template)
                if d >= 0.8:
                    found[i, lic] = min(found.get((i, lic), (0, "~", 0)), (-d, wording, line))
    return found


def check_licenses(df, texts):
    expected = expected_licenses(texts)
    got = {(r.doc_id, r.license): (-r.dice, r.wording, r.line) for r in licenses.license_matches(df).collect()}
    assert got.keys() == expected.keys()
    for key, (d, wording, line) in expected.items():
        assert got[key][0] == pytest.approx(d) and got[key][1:] == (wording, line)
    return got


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT", "text"]
    texts = [(1, "prose here\nLicensed under the Apache License, Version 2.0.\nmore prose"), (2, "licensed UNDER the apache license version 2.0 now"),
             (3, None), (4, ""), (5, mit.replace(". ", ".\n")), (6, "Released under the MIT License."), (6, "Licensed under CC BY-NC 4.0."),
             (7, "under the license of the version of the software"), (None, "Released under the MIT License."), (8, "word " * 3000),
             (9, "Released under the MIT License.\nReleased under the MIT License."), (10, "Licensed under CC BY 4.0."), (10, "Licensed under CC BY 4.0.")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in ("line", "template", "pairs", "words", "dice")})
    got = check_licenses(df, texts)
    assert got[10, "CC-BY-4.0"][0] == -1.0  # repeated rows do not add up
    assert licenses.license_matches(df.where("false")).collect() == []


def test_notices_inside_longer_texts(spark):
    """Wrapped at 72 columns, in one long line, and with a few other words in between."""
    prose = "it was a long evening by the river and the software of the version was to be read by the person in the house " * 6
    texts, wanted = [], set()
    for k, ((lic, wording), template) in enumerate(licenses.TEMPLATES.items()):
        if wording != "line":
            wrapped = "\n".join(textwrap.wrap(f"{prose} {template} {prose}", 72))
            edited = template.replace(" of the ", " of our the ", 1).replace(" is ", " was ", 1)
            texts += [(3 * k, wrapped), (3 * k + 1, f"{prose} {template} {prose}"), (3 * k + 2, f"{prose}\n# {edited} {prose}")]
            wanted |= {(3 * k + e, lic) for e in range(3)}
    got = check_licenses(spark.createDataFrame(texts, "doc_id bigint, text string"), texts)
    assert wanted <= got.keys() and all(got[key][0] <= -0.8 for key in wanted)
    assert check_licenses(spark.createDataFrame([(1, prose)], "doc_id bigint, text string"), [(1, prose)]) == {}


@pytest.mark.parametrize("module", [quality, licenses])
def test_native_modules_use_no_python_tasks(module):
    source = open(module.__file__).read()
    assert not re.search(r"udf|mapIn|applyIn|\.rdd|pandas|pyarrow", source)
