"""Phrase collocations against brute force."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from breaklens.llm import collocation as C
from breaklens.llm import queries
from tests.oracle import compare, connect

SCHEMA = "lang string, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]


def brute_counts(rows):
    counts = collections.Counter()
    for lang, text in rows:
        for p in pieces(text):
            for k in (1, 2, 3):
                for i in range(len(p) - k + 1):
                    counts[(lang or "und", tuple(p[i : i + k]))] += 1
    return counts


def brute(rows, least, covered, first):
    counts = brute_counts(rows)
    total = collections.Counter()
    for (lang, p), n in counts.items():
        total[lang] += n * (len(p) == 1)
    candidates = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    out = []
    for lang in total:
        found = []
        for (own, p), a in candidates.items():
            if own != lang:
                continue
            if any(o == lang and len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= covered * a for (o, q), b in candidates.items()):
                continue
            cuts = [(10**6 * a * a // (counts[(lang, p[:k])] * counts[(lang, p[k:])]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[(lang, p[:k])], counts[(lang, p[k:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


ROWS = [
    (None, None), ("en", ""), ("en", " \t. ,;"), ("und", "new york is new york"), (None, "NEW  york\tis new york."),
    ("fr", "ç la vie ç la vie ç la vie. İ la vie"), ("en", "a b c a b c a b c, a b. a b\x0bc a b\rb c"), ("en", "a b c a b c a b c, a b. a b\x0bc a b\rb c"),
    ("en", "x" * 70000 + " y " + "x" * 70000 + " y"), ("en", "tie one tie one tie two tie two"), ("de", "q q q q q q q q"),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("k", "n", "phrase", "slice", "words", "salt", "score", "rank", "doc_id"):
        df = df.selectExpr("*", f"1 AS `{name}`")
    return df


def test_op11_sql(spark, sf):
    name = "op11_collocations"
    assert compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLE[name]) is None


@pytest.mark.parametrize("least,covered,first", [(2, 50, 2000), (2, 70, 3), (3, 101, 2000), (1, 100, 5)])
def test_odd_rows(spark, least, covered, first):
    got = C.collocations(frame(spark, ROWS), least=least, covered=covered, first=first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS, least, covered, first)


def test_many_slices_and_ranges(spark, sf, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 4096)
    monkeypatch.setattr(C, "RANGE", 500)
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    want = {(lang, " ".join(p)): n for (lang, p), n in brute_counts(rows).items() if n >= 10}
    phrases, totals = C.frequent_phrases(spark.createDataFrame(rows, SCHEMA))
    assert {(r["lang"], r["phrase"]): r["n"] for r in phrases.collect()} == want
    assert sum(r["words"] for r in totals.collect()) == sum(n for (_, p), n in brute_counts(rows).items() if len(p) == 1)


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None)], SCHEMA)).collect() == []


def test_occurrences_that_collide_are_told_apart():
    grams = C.Grams(np.frombuffer(b"aa bb cc bb aa bb aa\n", np.uint8), "en")
    at = np.arange(7)
    got = C._phrases(grams, at, np.zeros(7, int), 1, "en").to_pylist()
    counts = collections.Counter()
    for r in got:
        counts[r["phrase"]] += r["n"]
    assert counts == {"aa": 3, "bb": 3, "cc": 1}


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_fingerprints_of_strings_that_collide_modulo_powers_of_two():
    one, two = thue_morse(2048)
    _, keys = C.Grams(np.frombuffer(f"{one} {two} {one}\n".encode(), np.uint8), "en").of(1)
    assert keys[0] == keys[2] != keys[1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab .\tÄ\n", max_size=20), max_size=6), st.integers(1, 40))
def test_fingerprints_are_those_of_the_words(texts, chunk):
    before = C.CHUNK
    C.CHUNK = 1 << (chunk % 4 + 1)
    try:
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        grams = C.Grams(C.compact(np.frombuffer(b"".join(raw), np.uint8), offsets), "xx")
    finally:
        C.CHUNK = before
    for k in (1, 2, 3):
        want = [tuple(p[i : i + k]) for t in texts for p in pieces(t) for i in range(len(p) - k + 1)]
        at, keys = grams.of(k)
        got = [tuple(bytes(grams.data[grams.starts[i] : grams.ends[i + k - 1]]).decode().split(" ")) for i in at]
        assert got == want
        assert len({(w, int(x)) for w, x in zip(want, keys)}) == len(set(want)) == len(set(keys.tolist()))
