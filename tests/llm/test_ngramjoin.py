"""The exact join against all pairs; its prefixes against all pairs of random sets."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from test_dedup import clusters, key, pairs, shared_ids

from cinetide.llm import links, ngramjoin
from cinetide.llm.common import table


def got(df):
    return sorted((tuple(r) for r in ngramjoin.grouped(df).collect()), key=key)


def brute(rows):
    return sorted(((i, n, c) for i, n, c, _ in clusters(rows, 80)), key=key)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)


def test_query_equals_brute_force(spark, small, odd, empty):
    assert got(odd) == brute(pairs(odd))
    docs = table(spark, small, "documents")
    assert sorted(tuple(r) for r in ngramjoin.op11(spark, small).collect()) == brute(pairs(docs))
    assert ngramjoin.grouped(empty).count() == 0 and ngramjoin.grouped(empty).columns == ["doc_id", "n_shingles", "component_id"]


def test_rows_that_share_an_id(spark):
    assert got(frame(spark, shared_ids(), 5)) == brute(shared_ids())


def near_copies(seed, n=160):
    """Texts around the limit: copies of a few bases with changes, and passages that most texts have."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    bases = [[f"b{b}_{i}" for i in range(rng.choice((6, 20, 60, 200)))] for b in range(6)]
    rows = []
    for d in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(3)}"
        if rng.random() < 0.4:
            words = words + common[: rng.choice((8, 40))]
        rows.append((d, " ".join(words[rng.randint(0, 2) :])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_many_near_copies_and_a_common_passage(spark, monkeypatch, seed):
    monkeypatch.setattr(links, "BLOCK", 8)
    monkeypatch.setattr(links, "SKETCHES", 16)
    rows = near_copies(seed)
    assert got(frame(spark, rows, 7)) == brute(rows)


def test_a_text_over_a_chunk(spark):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 90_000, 220_000)]
    rows = [(4, " ".join(words)), (7, " ".join([*words[:5], "x", *words[6:]])), (9, " ".join(words[:150_000])), (8, "short")]
    assert got(frame(spark, rows, 1)) == brute(rows)


def corpus(rng, rare):
    """Sets over a small universe, so that most tokens are frequent, and pairs around the limit."""
    universe = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    own = rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2)
    out = []
    for b in range(12):
        size = int(rng.integers(2, 260))
        base = np.unique(rng.choice(universe if b % 2 else own, size)) if not rare else np.unique(np.r_[rng.choice(universe, size // 2 + 1), rng.choice(own, size // 2 + 1)])
        for _ in range(9):
            gone = rng.random(len(base)) < rng.choice((0.02, 0.1, 0.15))
            more = rng.choice(universe, int(rng.integers(0, len(base) // 8 + 2)))
            out.append(np.unique(np.r_[base[~gone], more]))
    return [x for x in out if len(x)]


@pytest.mark.parametrize("rare", [0, 1])
def test_linked_sets_share_a_signature(rare):
    rng = np.random.default_rng(11 + rare)
    links_seen = 0
    for _ in range(4):
        sets = list({x.tobytes(): x for x in corpus(rng, rare)}.values())
        low = [int((x < ngramjoin._LOW).sum()) for x in sets]
        given = [x[x < ngramjoin._LOW] if n >= ngramjoin.prefix_bound(len(x)) else x for x, n in zip(sets, low, strict=True)]
        counts = collections.Counter(t for x in given for t in x.tolist())
        keys = []
        for x, n, own in zip(sets, low, given, strict=True):
            shared = np.array([t for t in own.tolist() if counts[t] > 1], np.uint64)
            keys.append(set(ngramjoin.signatures(len(x), n, shared, np.array([counts[t] for t in shared.tolist()], np.int64))))
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    links_seen += 1
                    assert keys[a] & keys[b], (len(sets[a]), len(sets[b]), both)
    assert links_seen > 100


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    sets = [np.sort(x) for x in corpus(rng, 1)]
    sig = ngramjoin.parities(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])])
    size = np.array([len(x) for x in sets])
    grid = ngramjoin.near_grid(sig, size)
    ruled = 0
    for a in range(len(sets)):
        rows = ngramjoin.near_pairs(sig[np.full(len(sets), a)], sig, size[np.full(len(sets), a)], size)
        assert (rows == grid[a]).all()
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (size[a] + size[b] - both):
                assert grid[a, b]
            ruled += not grid[a, b]
    assert ruled > 0.8 * len(sets) ** 2


def test_scan_does_not_depend_on_batches_or_tasks():
    rng = np.random.default_rng(3)
    held = [(rng.integers(0, 40, 300).astype(np.uint64), rng.integers(1, 90, 300).astype(np.uint64)) for _ in range(3)]
    held = [tuple(np.array(x, np.uint64) for x in zip(*sorted(set(zip(t.tolist(), n.tolist(), strict=True))), strict=True)) for t, n in held]
    rows = pa.Table.from_batches([b for h in held for b in ngramjoin._token_rows([h])]).sort_by("key").combine_chunks().to_batches()[0]
    expected = collections.defaultdict(set)
    for t, n in held:
        for a, b in zip(t.tolist(), n.tolist(), strict=True):
            expected[a].add(b)

    def result(batches):
        out = pa.Table.from_batches(list(ngramjoin.shared(batches))).to_pylist()
        counts = {r["key"]: r["n"] for r in out if r["kind"] == ngramjoin.COUNT}
        found = collections.defaultdict(set)
        for r in out:
            if r["kind"] in (ngramjoin.PLAIN, ngramjoin.APART):
                found[r["key"]].add(r["node"])
                assert r["kind"] == ngramjoin.PLAIN or r["key"] in counts
        return found

    assert result([rows]) == {k: v for k, v in expected.items() if len(v) > 1}
    assert result(rows.slice(k, 11) for k in range(0, rows.num_rows, 11)) == result([rows])
