import collections
import hashlib
import re

import numpy as np

from cinetide.llm import links, neardup, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fallen(rows):
    """Brute force: (id, words, removed, digest) of each row."""
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49) if i is not None else ():
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def clusters(rows, least=75):
    """Brute force: (id, shingles, component, kept) of each row."""
    sets = collections.defaultdict(list)
    sizes = []
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sizes.append((i, len(s)))
        if i is not None:
            sets[i].append(s)
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s & t and 100 * len(s & t) >= least * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return [(i, n, None if i is None else root(i), i is None or root(i) == i) for i, n in sizes]


def key(row):
    return tuple((x is None, x) for x in row)


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_difference_cover():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD))
    assert substrings.PERIOD - 1 + substrings.ANCHOR <= substrings.WINDOW


def test_substrings_equal_brute_force(spark, small, odd):
    for df in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        got = [tuple(r) for r in substrings.deduplicated(df).drop("kept").collect()]
        assert sorted(got, key=key) == sorted(fallen(pairs(df)), key=key)


def test_substrings_at_any_alignment_and_through_flushes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(55)]
    rows = [(100 - d, " ".join([f"u{d}_{k}" for k in range(d)] + passage + [f"v{d}_{k}" for k in range(int(rng.integers(60)))])) for d in range(70)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in substrings.deduplicated(df).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(fallen(rows), key=key)
    assert sum(r[2] for r in got) == 69 * 55


def test_copies_that_meet_in_a_task_keep_their_anchors(spark):
    """A task that holds only copies of texts elsewhere must still bring the anchors of those that stand for them."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    shared = [f"s{i}" for i in range(52)]
    one, two = " ".join(a + shared), " ".join(b + shared)
    rows = [(1, one), (2, two), (3, one), (4, two), (5, " ".join(shared))]
    df = spark.createDataFrame(rows[2:4], "doc_id bigint, text string").coalesce(1)
    for r in (rows[0], rows[1], rows[4]):
        df = df.union(spark.createDataFrame([r], "doc_id bigint, text string"))
    got = [tuple(r) for r in substrings.deduplicated(df).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(fallen(rows), key=key)


def test_kept_text_is_what_the_digest_says(odd):
    for r in substrings.deduplicated(odd).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_near_duplicates_equal_brute_force(spark, small, odd):
    for df in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        got = [tuple(r) for r in neardup.grouped(df).collect()]
        assert sorted(got, key=key) == sorted(clusters(pairs(df)), key=key)


def test_links_that_the_hub_lacks_are_found(spark, monkeypatch):
    """A chain: each text is near the next only, and the smallest id is at its end; cells are made tiny."""
    monkeypatch.setattr(links, "BLOCK", 2)
    monkeypatch.setattr(links, "SKETCHES", 3)
    base = [f"w{i}" for i in range(200)]
    rows = [(d, " ".join(f"x{d // 8}_{i}" if i < 5 * (d % 8) else w for i, w in enumerate(base))) for d in range(24)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in neardup.grouped(df).collect()]
    assert sorted(got) == sorted(clusters(rows))


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    top = {x: x for edge in edges for x in edge}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in links.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in ends}


def test_deduplicated_keeps_columns_and_one_of_each(odd):
    out = neardup.deduplicated(odd)
    assert out.schema == odd.schema
    kept = {i for i, _, _, k in clusters(pairs(odd)) if k}
    assert {r[0] for r in out.select("doc_id").collect()} == kept
    assert out.where("doc_id = 6").count() == 1  # stands there three times


def test_empty_tables(empty):
    assert substrings.deduplicated(empty).count() == neardup.grouped(empty).count() == neardup.deduplicated(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    sets = np.r_[flat[:800], flat[200:]]
    sig = neardup.signatures(sets, np.array([0, 800, 1600]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15


# ---- ids with several texts, and words that a weak hash takes for each other ----


def thue_morse(letters, size=1024):
    """Two words that polynomial hashes modulo a power of two confuse, for any odd base."""
    bits = [0]
    while len(bits) < size:
        bits += [1 - b for b in bits]
    return ["".join(letters[b ^ turn] for b in bits) for turn in (0, 1)]


def shared_ids():
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(500)}"
    a, b, c, d = ([word() for _ in range(n)] for n in (70, 90, 65, 311))
    near = [*b[:80], "other", *b[81:]]
    return [
        (1, " ".join(a)), (5, " ".join(d + a[:60])), (5, " ".join(c)), (5, " ".join(a)), (5, " ".join(a)), (2, " ".join(b)), (5, " ".join(b)), (9, " ".join(near)),
        (7, " ".join(d)), (7, " ".join([*c, "more"])), (3, "few words"), (3, "few words"), (3, None), (None, " ".join(a)), (None, " ".join(a)), (8, ""), (8, ""),
    ]


def test_substrings_of_rows_that_share_an_id(spark):
    rows = shared_ids()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [tuple(r) for r in substrings.deduplicated(df).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(fallen(rows), key=key)


def test_near_duplicates_of_rows_that_share_an_id(spark):
    for rows in (shared_ids(), [(1, "a b c d e f"), (2, "g h i j k l"), (5, "a b c d e f"), (5, "g h i j k l")]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        got = [tuple(r) for r in neardup.grouped(df).collect()]
        assert sorted(got, key=key) == sorted(clusters(rows), key=key)
        kept = {i for i, _, _, k in clusters(rows) if k}
        left = [tuple(r) for r in neardup.deduplicated(df).collect()]
        assert sorted(left, key=key) == sorted([*{r for r in rows if r[0] in kept and r[0] is not None}, *(r for r in rows if r[0] is None)], key=key)


def test_words_that_weak_hashes_confuse(spark):
    one, two = thue_morse("ab")
    tail = " ".join(f"c{i}" for i in range(49))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, one), (4, two)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert not any(r["n_removed"] for r in substrings.deduplicated(df).collect())
    assert sorted(tuple(r) for r in neardup.grouped(df).collect()) == sorted(clusters(rows))


def test_windows_of_two_words_in_turn(spark):
    """All windows over two words, of which many share every count and every run."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(("ab", "ba")[b] for b in rng.integers(0, 2, 60))) for i in range(40)] + [(50, " ".join(["ab", "ba"] * 40)), (51, " ".join(["ba", "ab"] * 40))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in substrings.deduplicated(df).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(fallen(rows), key=key)


def test_a_text_over_a_chunk(spark):
    rng = np.random.default_rng(6)
    long = " ".join(f"w{x}" for x in rng.integers(0, 90_000, 220_000))
    assert len(long) > 1 << 20
    words = long.split()
    rows = [(4, long), (2, " ".join(words[200_000:200_080])), (6, " ".join(words[100:160])), (7, " ".join([*words[:5], "x", *words[6:]])), (8, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = [tuple(r) for r in substrings.deduplicated(df).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(fallen(rows), key=key)
    assert sorted(tuple(r) for r in neardup.grouped(df).collect()) == sorted(clusters(rows))


def test_scratch_tables_are_removed(spark):
    from cinetide.llm import common

    mark = common.made()
    neardup.deduplicated(spark.createDataFrame(shared_ids(), "doc_id bigint, text string")).count()
    assert common.made() - mark <= 4
    kept = common.saved(spark.range(3), "kept")
    common.discarded(spark, mark, kept)
    assert kept.count() == 3 and common.made() == mark + 1
