import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cinetide.llm import decontaminate

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(words):
    k = min(5, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(docs, items):
    """Every item-sized window of every document against every item; without a shingle in common the similarity is 0."""
    out = set()
    known = [(i, WORDS.findall((t or "").translate(LOWER))) for i, t in items]
    known = [(i, own, collections.Counter(shingles(own))) for i, own in known if own]
    for doc_id, text in docs:
        words = WORDS.findall((text or "").translate(LOWER))
        runs = {k: [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] for k in range(1, 6)}
        seen = {k: set(r) for k, r in runs.items()}
        for item, own, mine in known:
            k = min(5, len(own))
            if not words or len(words) < k or not any(s in seen[k] for s in mine):
                continue
            size = min(len(own), len(words)) - k + 1
            for s in range(len(runs[k]) - size + 1):
                there = collections.Counter(runs[k][s : s + size])
                both = sum((mine & there).values())
                if both and both >= 0.75 * (sum(mine.values()) + size - both):
                    out.add((doc_id, item))
                    break
    return out


def test_equals_brute_force(spark, small, odd):
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for k in range(30)] + [(30, None), (31, " "), (32, "one"), (33, "two words")]
    docs = [(None, None), (1, ""), (2, "one"), (3, "two words here")]
    for d in range(4, 80):
        own = items[rng.randrange(30)][1].split()
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        docs.append((d, " ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] + own + [rng.choice(vocabulary).upper() for _ in range(rng.randint(0, 30))])))
    got = {(r[0], r[1]) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == brute(docs, items) and len(got) > 40


def test_equals_brute_force_on_the_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r[0], r[1]) for r in decontaminate.contaminated(docs, bench).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    print("recall", len(got & want) / len(want), "of", len(want))
    assert got == want and len(want) > 20


def laid(words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return decontaminate.Words(raw, np.array([0, len(raw)])).hashes()


@pytest.mark.parametrize("n", [5, 6, 9, 15, 24, 45, 120, 500])
def test_the_radius_holds_what_is_similar_and_little_else(n):
    """Windows with just enough shingles in common are within the radius, unrelated ones are not."""
    rng = np.random.default_rng(n)
    size = n - 4
    shared = decontaminate.fewest(size, size)
    assert shared <= size and 2 * size * 0.75 <= shared * 1.75 < 2 * size * 0.75 + 1.75
    most = decontaminate.radius(size, size)
    assert most <= 150
    draw = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64)
    one = lambda s: decontaminate.simhash(s, np.zeros(1, int), len(s))[0]
    far = near = 0
    for _ in range(1000):
        a, b = draw(size), draw(size)
        far += int(np.bitwise_count(one(a) ^ one(b)).sum()) <= most
        near += int(np.bitwise_count(one(a) ^ one(np.r_[a[:shared], b[shared:]])).sum()) <= most
    assert near == 1000 and far < 10


def test_blocks_pass_all_within_the_radius_and_few_others():
    rng = np.random.default_rng(1)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3000, n))) for k in range(200) for n in (15, 30, 60)]
    index = decontaminate.Index(items)
    for n in (15, 30, 60):
        own = np.flatnonzero(index.n_words == n)
        noise = lambda k: rng.integers(0, 2**63, (k, 8), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (k, 8), dtype=np.uint64)
        close = index.fingerprints(own[:50]) ^ (noise(50) & noise(50) & noise(50))  # an eighth of the bits differs
        other = decontaminate.simhash(rng.integers(0, 2**63, 600 + n, dtype=np.uint64), np.arange(600), n - 4)
        prints = np.r_[close, other]
        most, passed, within = decontaminate.radius(n - 4, n - 4), 0, 0
        for w in range(len(prints)):
            blocks, near = index.near(np.repeat(prints[w : w + 1], len(own), axis=0), own, n - 4, n)
            distance = np.bitwise_count(prints[w] ^ index.fingerprints(own)).sum(axis=1)
            assert (near == (distance <= most)).all() and (blocks | ~near).all()
            within += int(near.sum())
            passed += int(blocks.sum()) if w >= 50 else 0
        print(f"{n} words: radius {most}, blocks pass {passed / (600 * len(own)):.5f} of unrelated pairs")
        assert passed < 0.01 * 600 * len(own) and within >= 45


def test_each_index_is_built_once_a_worker(monkeypatch, spark):
    """Whatever the number of groups of texts; 20,000 items stay small."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(50))) for k in range(20_000)]
    path = decontaminate.written(spark.createDataFrame(items, "item_id bigint, text string"))
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 4000)
    texts = [f"{' '.join(rng.choice(vocabulary) for _ in range(30))} {items[k * 97][1]} tail" for k in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
    tracemalloc.start()
    found = [tuple(r.values())[:2] for b in decontaminate.hits([batch.slice(k, 1) for k in range(60)], path) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == [(k, k * 97) for k in range(60)]
    assert decontaminate.built[path] == 4 and peak < 500 << 20
    monkeypatch.setattr(decontaminate, "KEPT_BYTES", 1)  # nothing is kept: the result is the same
    decontaminate._indexes.clear()
    assert sorted(tuple(r.values())[:2] for b in decontaminate.hits([batch], path) for r in b.to_pylist()) == sorted(found)


def test_very_long_items_take_little_memory():
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 50_000, 20_000)]
    other = [w if i % 60 else "other" for i, w in enumerate(words)]
    index = decontaminate.Index([(1, " ".join(words)), (2, " ".join(f"v{x}" for x in rng.integers(0, 9, 20_000)))])
    tracemalloc.start()
    found = index.search(laid(["before"] * 30 + other + ["after"] * 500))
    runs = index.search(laid([f"v{x}" for x in rng.integers(0, 9, 21_000)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found) == {0} and found[0][1] == 30 and 0.75 < found[0][0] < 0.9
    assert set(runs) <= {1} and peak < 400 << 20


def test_a_text_over_a_chunk_and_words_that_weak_hashes_confuse(spark):
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    one, two = ("".join("ab"[b ^ turn] for b in bits) for turn in (0, 1))
    rng = random.Random(5)
    item = " ".join(f"q{i}" for i in range(25))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000)) + " " + item
    docs = [(1, long), (2, two), (3, one), (None, item)]
    got = {(r[0], r[1]) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item), (8, one), (None, "x y")], "item_id bigint, text string")).collect()}
    assert got == {(1, 7), (3, 8), (None, 7)} and len(long) > 1 << 20


def test_blocks_of_the_benchmark_change_nothing(spark, small, monkeypatch):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    path = decontaminate.written(bench)
    rows = [pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "text": r["text"]} for r in docs.collect()])]
    assert len(list(decontaminate.blocks_of(path))) > 3
    for group in (1, 1 << 30):
        monkeypatch.setattr(decontaminate, "GROUP_BYTES", group)
        got = [tuple(r.values()) for b in decontaminate.hits(rows, path) for r in b.to_pylist()]
        assert sorted(got) == whole and whole
    assert sum(b.num_rows for b in decontaminate.without_hits(rows, path)) == docs.count() - len({r[0] for r in whole})


def test_clean_keeps_columns_and_the_rest(spark, small, odd, empty):
    bench = spark.createDataFrame([(1, odd.where("doc_id = 9").first()["text"])], "item_id bigint, text string")
    out = decontaminate.clean(odd, bench)
    assert out.schema == odd.schema
    assert out.count() == odd.count() - 1 and out.where("doc_id = 9").count() == 0
    assert decontaminate.clean(empty, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_windows_with_repeated_shingles():
    """Runs of a word make the cosine small at a similarity of 0.75 or more."""
    rng = random.Random(4)
    for twice in (True, False):
        pairs = []
        for t in range(150):
            own = [f"u{t}x{rng.random()}" for _ in range(179)]
            plain = [f"v{t}x{j}" for j in range(25)]
            pairs.append((" ".join(own + ([f"y{t}"] * 25 if twice or t % 2 else plain)), " ".join(own + ([f"z{t}"] * 25 if twice or not t % 2 else plain))))
        index = decontaminate.Index([(t, item) for t, (item, _) in enumerate(pairs)])
        for t, (item, text) in enumerate(pairs):
            raw = np.frombuffer(text.encode(), np.uint8)
            found = index.search(decontaminate.Words(raw, np.array([0, len(raw)])).hashes())
            assert brute([(0, text)], [(t, item)]) == {(0, t)} and set(found) == {t}
