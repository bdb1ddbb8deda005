"""Spelling variants against brute force over all pairs of words."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cinetide.llm import spelling
from cinetide.llm.common import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(doc_id, text):
    for run in RUN.findall(text or ""):
        run = run.translate(LOWER)
        h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
        if h % 31 == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= 7:
            yield run


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    counts = collections.Counter(w for i, t in rows for w in words_of(i, t))
    words = {w: n for w, n in counts.items() if n >= 2}
    forms, out = {}, []
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        best = others[0] if others and -others[0][0] >= 10 * n else None
        forms[w] = best[1] if best else None
        out.append((w, forms[w], n, len(others), -best[0] if best else None))
    return sorted((w, f, root(w, forms), n, k, fn) for w, f, n, k, fn in out)


def root(word, forms):
    while forms[word]:
        word = forms[word]
    return word


def got(df):
    return sorted(tuple(r) for r in spelling.variants(df).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    counts = collections.Counter(w for i, t in rows for w in words_of(i, t))
    common = {w for w, n in counts.items() if n >= 2}
    result = sorted(tuple(r) for r in spelling.op13(spark, small).collect())
    assert {(r[0], r[3]) for r in result} == {(w, counts[w]) for w in common}
    sample = set(sorted(common)[::40]) | {r[0] for r in result if r[1]}
    for w, form, top, n, n_near, form_n in result:
        if w in sample:
            others = sorted((-counts[v], v) for v in common if near(w, v))
            assert n_near == len(others)
            expected = others[0] if others and -others[0][0] >= 10 * n else (None, None)
            assert (form, form_n) == (expected[1], None if expected[0] is None else -expected[0])
            assert (top == w) == (form is None)


def test_odd_rows_and_chains(spark, odd, empty):
    chain = []
    for k, w in enumerate(["variants", "variantss", "variantsst", "varixntsst"]):
        whole = next(i for i in range(50, 150) if zlib.crc32(f"{i}:{w}".encode()) % 31)
        chain += [(whole, f"{w} " * (2 * 11 ** (3 - k)))]
    letters = [(90 + k, f"abcd{chr(0xC0 + k)}fgh abcdefg{chr(0xC0 + k)} " * 2) for k in range(60)]
    texts = [(i, t) for i, t in odd.select("doc_id", "text").collect()]
    rows = texts + chain + letters + [(7, "Ünïcödé ünïcödé ÜNÏCÖDÉ straßenname strassenname STRASSENNAME straßenname"), (8, "a×b÷cdef a×b÷cdef ĀabcdefgĀabcdefg abcdefgabcdefg"), (9, "ababababab babababab ababababab babababab abababab abababab")]
    rows += [(None, "parliament parlament parliament parlament parliaments parliaments")] * 12
    assert got(frame(spark, rows)) == brute(rows)
    extra = frame(spark, rows).selectExpr("doc_id", "text", "1 as n", "'x' as word", "'y' as form", "0 as node", "0 as key", "'r' as rest", "3 as place")
    assert got(extra) == brute(rows)
    assert any(r[1] and r[2] != r[1] for r in brute(rows)) and spelling.variants(empty).count() == 0


def test_random_texts(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(base[: 1 + i % 60]) + rng.choice(["", "", "a", "é"]) for _ in range(80))) for i in range(120)]
    assert got(frame(spark, rows).repartition(5)) == brute(rows)


def test_long_runs(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(1_200_000))
    rows = [(1, long + " " + "a" * 3000), (2, long + " " + "a" * 3000), (3, long[:-1] + "z " + "a" * 2999), (4, long[:-1] + "z " + "a" * 2999), (5, "b" + "a" * 2999), (6, "b" + "a" * 2999)]
    counts = collections.Counter(w for i, t in rows for w in words_of(i, t))
    result = {r[0]: r for r in got(frame(spark, rows))}
    assert set(result) == {w for w, n in counts.items() if n >= 2}
    for w, r in result.items():
        assert r[3] == counts[w] and r[4] == sum(near(w, v) for v in result)


@given(st.lists(st.text(alphabet="abzÀÿ×", min_size=1, max_size=12), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_keys_are_remainders(words):
    """Two keys are equal just if the strings are."""
    column = pa.array(words)
    key, place, own = spelling.deletion_keys(*spelling.code_points(column))
    rest = [words[w][:p] + words[w][p + 1 :] if p >= 0 else words[w] for p, w in zip(place.tolist(), own.tolist(), strict=True)]
    for a in range(len(rest)):
        for b in range(a):
            assert (key[a] == key[b]) == (rest[a] == rest[b])
    assert len(rest) == sum(map(len, words)) + len(words)


def test_checksums_continue():
    text = b"abcdefgh" + b"q" * 200 + b"xyz"
    buf = np.frombuffer(text, np.uint8)
    starts, ends = np.array([0, 8, 208]), np.array([8, 208, 211])
    begun = np.array([zlib.crc32(b"%d:" % i) for i in (-5, 12, 7)], np.uint32)
    expected = [zlib.crc32(b"%d:" % i + text[a:b]) for i, a, b in zip((-5, 12, 7), starts, ends, strict=True)]
    assert spelling.checksums(buf, starts, ends, begun).tolist() == expected


def test_scan_does_not_depend_on_batches():
    rng = np.random.default_rng(2)
    key, place, node = np.sort(rng.integers(0, 60, 400)), rng.integers(-1, 4, 400).astype(np.int32), rng.integers(0, 50, 400)
    order = np.lexsort((place, key))
    cols = [pa.array(c[order]) for c in (key, place, node)]
    whole = pa.RecordBatch.from_arrays(cols, ["key", "place", "node"])
    one = pa.Table.from_batches(list(spelling.met([whole])))
    for step in (1, 7, 50):
        parts = pa.Table.from_batches(list(spelling.met(whole.slice(k, step) for k in range(0, 400, step))))
        assert parts.equals(one)
    assert pa.Table.from_batches(list(spelling.met([]))).num_rows == 0
