"""Near-duplicates against all pairs compared in Python."""

import itertools
import random
import re

import numpy as np

from sievelark.llm import neardup as N


def shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return frozenset(zip(w, w[1:], w[2:], strict=False))


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(80):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 5)):
            x = list(base)
            for _ in range(rng.randrange(0, 1 + len(x) // 25)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append(" ".join(x))
    return rows


def test_all_pairs(spark, tmp_path):
    texts = corpus()
    rows = [(i, None if i % 5 else t.split(" ", 1)[0], t if i % 5 else t.split(" ", 1)[1], "x") for i, t in enumerate(texts)]
    rows += [(1000, None, None, "x"), (1001, "", "", "x"), (1002, "One two", None, "x"), (1003, "one", "TWO", "x"), (1004, "three", "", "x"), (1005, "!?", "...", "x"), (1006, rows[0][1], rows[0][2], "x")]
    spark.createDataFrame(rows, "item_ord bigint, title string, abstract string, rep string").write.parquet(str(tmp_path / "papers.parquet"))
    sets = {r[0]: shingles(f"{r[1] or ''} {r[2] or ''}") for r in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    want.add((1002, 1003))
    got = {tuple(r) for r in N.p2_found(spark, str(tmp_path)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50
    groups = {r.item_ord: r for r in N.p2_groups(spark, str(tmp_path)).collect()}
    links = {i: sum(i in p for p in got) for i in groups}
    assert {i: g.n_links for i, g in groups.items()} == links and groups[1006].class_id == groups[0].class_id == 0
    assert 1000 not in groups and 1005 not in groups


def test_empty_and_long(spark, tmp_path):
    spark.createDataFrame([], "item_ord bigint, title string, abstract string").write.parquet(str(tmp_path / "e/papers.parquet"))
    assert N.p2_found(spark, str(tmp_path / "e")).count() == 0
    long = " ".join(f"a{i}" for i in range(60_000))
    spark.createDataFrame([(1, "t", long), (2, "T", long + " tail")], "item_ord bigint, title string, abstract string").write.parquet(str(tmp_path / "l/papers.parquet"))
    assert [tuple(r) for r in N.p2_found(spark, str(tmp_path / "l")).collect()] == [(1, 2)]


def test_anchors_of_vectors_that_differ_in_one_coordinate_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, N.P, size=N.N, dtype=np.uint64)
    y = x.copy()
    y[2] = rng.integers(0, N.P)

    def words(v):
        return {tuple(int(z) if j != i else (N.N * N.P - (int(v.sum()) - int(v[i]))) % N.P for j, z in enumerate(v)) for i in range(N.N)}

    assert words(x) & words(y) and all(sum(w) % N.P == 0 for w in words(x) | words(y))
