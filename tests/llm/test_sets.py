"""History, seen keys, packing and mixing against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from sievelark.llm import history as H
from sievelark.llm import mixing as X
from sievelark.llm import packing as P
from sievelark.llm import seen as S
from sievelark.llm import tokens as T
from sievelark.session import shared_dir

# --- history


def test_joined_words_and_words_like_numerals():
    assert shared("Vision-based tables of law", "Visionbased tables of law") and shared("Deep vision tables", "Deepvision tables") and not shared("Routing tables 1 2", "Routing tables 12")
    assert shared("Routing civil tables in law", "Routing civl tables in law") and not shared("Routing tables, Part VIII", "Routing tables, Part VII")


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("https://www.Arxiv.example/abs/2101.00001v3/", "http://arxiv.example:80/pdf/2101.00001.pdf?utm_source=x#s", True), ("https://a.example/forum?id=1", "https://a.example/forum?id=2", False), ("https://a.example/?p=1&ref=x", "https://a.example/index.php?p=1", True),
        ("https://a.example/x", "https://b.example/x", False), ("https://a.example:8080/x", "https://a.example/x", False), ("https://a.example/post-v2", "https://a.example/post-v3", False), ("https://a.example/X", "https://a.example/x", False),
    ],
)
def test_pages(a, b, same):
    assert (H.page_of(a) == H.page_of(b)) is same


def test_pages_of_nothing():
    assert H.page_of(None) is None and H.page_of("  ") is None and H.page_of("https://[bad") is not None


def shared(a, b):
    with np.errstate(over="ignore"):
        return bool(set(H.title_marks(H.title_words(a), {})) & set(H.title_marks(H.title_words(b), {})))


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Routing Sparse Tables: a Study in Law", "A routing sparse tables - study in $law$ [v2]", True), ("Routing sparse tables in law", "Routing sprase tables in law", True), ("Routing sparse tables in law", "Routing spare tables in law", True),
        ("Kelos: routing sparse tables", "Routing Sparse Tables: Kelos", True), ("Zero-shot tables in law", "Zero shot tables in law", True), ("Routing sparse tables in law", "Routing dense tables in law", False), ("Routing tables, Part I", "Routing tables, Part II", False),
        ("Routing tables, Part I", "Routing tables", False), ("Routing tables, 2024 Edition", "Routing tables, 2023 Edition", False), ("Routing tables, Task 5", "Routing tables, Task 7", False), ("Routnig sparse tabels in law", "Routing sparse tables in law", True), ("Vision-based tables here", "Visio-nbased tables here", True),
    ],
)
def test_titles(a, b, same):
    assert shared(a, b) is same


def test_batches(spark, tmp_path):
    p = [(1, 0, "https://a.example/1", "Routing sparse tables in law"), (2, 0, "https://a.example/2", "Other things of note today"), (3, 1, "http://www.a.example/1?utm_source=x", "New title altogether different"), (4, 2, "https://b.example/9", "New title altogehter different"), (5, 2, "https://b.example/8", "Routing dense tables in law"), (6, 0, "https://a.example/1", "Routing sparse tables in law"), (7, 3, None, None), (8, 4, "", ""), (9, 5, "https://c.example/5", "New title altogether different")]
    b = [(1, 0, "https://a.example/1", "x"), (2, 3, "https://a.example/1#c", "Routing sparse tables in law"), (3, 3, "https://a.example/4", "x"), (4, 4, "https://a.example/4", "y"), (5, 4, "https://a.example/4", "y")]
    spark.createDataFrame([(*r, "t", "z") for r in p], "item_ord bigint, batch_no int, url string, title string, abstract string, tbl string").write.parquet(str(tmp_path / "papers.parquet"))
    spark.createDataFrame([(*r, "a long paragraph of this text\n\nand another long paragraph" if r[0] % 2 else None, "z") for r in b], "post_id bigint, batch_no int, url string, title string, content string, node string").write.parquet(str(tmp_path / "blog_posts.parquet"))
    got = sorted(tuple(r) for r in H.p5_found(spark, str(tmp_path)).collect())
    assert got == [("blog_posts", 2, 1), ("blog_posts", 4, 3), ("blog_posts", 5, 3), ("papers", 3, 1), ("papers", 4, 1), ("papers", 9, 1)]
    cover = {(r.tbl, r.row_id): (r.n_paragraphs, r.n_seen_before, r.full_copy) for r in H.p5_coverage(spark, str(tmp_path)).collect()}
    assert cover == {("blog_posts", 1): (2, 0, False), ("blog_posts", 3): (2, 2, True), ("blog_posts", 5): (2, 2, True)} | {("papers", i): (1, int(i in (3, 4, 5, 7, 8, 9)), i in (3, 4, 5, 7, 8, 9)) for i in range(1, 10)}


def test_short_paragraphs_count():
    assert H.paragraphs("<h2>Tip</h2><p>A longer paragraph of words.</p>\n\n***\n\n- x") == ["tip", "a longer paragraph of words", "x"] and H.paragraphs(None) == []


def batches(n, seed=5):
    """Rows of n batches: titles anew, again, with a slip, and chains whose ends meet in a later batch."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(5, 9)))
    for b in range(n):
        for _ in range(25 if b else 60):
            t, url = " ".join(word() for _ in range(4)), f"https://a.example/{rng.randrange(10**9)}"
            if rows and rng.random() < 0.6:
                x, y = rng.choice(rows), rng.choice(rows)
                t, url = (x[4], y[3]) if rng.random() < 0.5 else (x[4][:3] + x[4][4:], url)
            rows.append((0, b, len(rows), url, t))
    rng.shuffle(rows)
    return rows


ROWS = "tbl int, batch int, id bigint, url string, title string"


def brute(rows):
    """Components by shared page or shared title mark, and of each row its component's first if that is of an earlier batch."""
    root = {r[2]: r[2] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owner = {}
    for r in rows:
        with np.errstate(over="ignore"):
            for m in [*H.title_marks(H.title_words(r[4]), {}).tolist(), H.page_of(r[3])]:
                root[find(r[2])] = find(owner.setdefault(m, r[2]))
    first = {}
    for r in rows:
        k = find(r[2])
        first[k] = min(first.get(k, (r[1], r[2])), (r[1], r[2]))
    return {(r[2], first[find(r[2])][1]) for r in rows if r[1] > first[find(r[2])][0]}


def test_last_batch_against_a_stored_history(spark, monkeypatch):
    """One by one, in rounds, and the last batch alone against a history opened again: the same rows, as by brute force."""
    rows = batches(3)
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS + ", text string")
    want = brute(rows)
    monkeypatch.setattr(H, "BUCKETS", 2)
    monkeypatch.setattr(H, "BUCKET_MARKS", 200)
    found = lambda h: {(r["row"].id, r.root.id) for r in h.repeats().where("row.batch > root.batch").collect()}
    single, several = H.fresh(spark), H.fresh(spark)
    try:
        for b in range(2):
            single.accept(df.where(f"batch = {b}"))
        assert single.buckets > 2
        single.close()
        again = H.History(spark, single.path)
        new = again.accept(df.where("batch = 2"))
        assert {(r["row"].id, r.root.id) for r in new.collect()} >= {x for x in want if x[0] in {r[2] for r in rows if r[1] == 2}} - {(r[2], r[2]) for r in rows}
        assert found(again) == want
        again.close()
        plan = H.rounds(df)
        assert plan[0] == (0, 0) and plan[-1][1] == 2
        for lo, hi in plan:
            several.accept(df.where(f"batch between {lo} and {hi}"))
        assert found(several) == want
    finally:
        single.drop()
        several.drop()


def test_a_failed_accept_leaves_nothing(spark, monkeypatch):
    rows = spark.createDataFrame(batches(2), ROWS)
    h, whole = H.fresh(spark), H.fresh(spark)
    try:
        h.accept(rows.where("batch = 0"))
        with monkeypatch.context() as m:
            m.setattr(H, "connected_components", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                h.accept(rows.where("batch = 1"))
        again = H.History(spark, h.path)
        for x in (again, whole):
            for b in (0, 1):
                if x is whole or b:
                    x.accept(rows.where(f"batch = {b}"))
        assert {tuple(r) for r in again.repeats().collect()} == {tuple(r) for r in whole.repeats().collect()} != set()
        again.close()
    finally:
        h.drop()
        whole.drop()


def test_no_batches_and_null_batches(spark, tmp_path):
    assert H.rounds(spark.createDataFrame([], ROWS)) == []
    h = H.fresh(spark)
    try:
        assert h.accept(spark.createDataFrame([], ROWS)).count() == 0 and h.repeats().count() == 0
    finally:
        h.drop()
    p = [(1, None, "https://a.example/1", "A title of note", "z"), (2, 3, "https://a.example/1", None, None), (3, None, None, None, "")]
    spark.createDataFrame(p, "item_ord bigint, batch_no int, url string, title string, abstract string").write.parquet(str(tmp_path / "papers.parquet"))
    spark.createDataFrame([], "post_id bigint, batch_no int, url string, title string, content string").write.parquet(str(tmp_path / "blog_posts.parquet"))
    assert [tuple(r) for r in H.p5_found(spark, str(tmp_path)).collect()] == [("papers", 1, 2)]


# --- seen keys


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h = np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64))
    f = S.PerfectHash.build(h)
    assert sorted(f.slot(h).tolist()) == list(range(len(h)))
    other = rng.integers(1 << 63, (1 << 64) - 1, size=20_000, dtype=np.uint64)
    s = f.slot(other)
    assert s.max(initial=-1) < max(1, len(h))
    if n > 1000:
        wrong = (s >= 0) & (S.fingerprint(h[np.argsort(f.slot(h))])[np.maximum(s, 0)] == S.fingerprint(other))
        assert wrong.mean() < 20 / (1 << S.FP_BITS)


def test_seen(spark, tmp_path):
    t = "2025-01-{:02d} 00:00:00"
    mem = [("arXiv:2101.00001", t.format(1)), ("arxiv:2101.00001v2", t.format(9)), ("semantic:CorpusId:77", t.format(3)), ("ABCDEF0123", t.format(2)), ("hf:https://x/1", t.format(2)), (None, t.format(1)), (" ", t.format(1)), ("late", t.format(20)), ("nodate", None)]
    mem += [(f"k{i}", t.format(1 + i % 20)) for i in range(500)]
    spark.createDataFrame(mem, "seen string, s string").selectExpr("seen", "to_timestamp_ntz(s) AS seen_at", "1 AS key").write.parquet(str(tmp_path / "semantic_scholar_memory.parquet"))
    pap = [(1, t.format(5), " 2101.00001v3 ", None), (2, t.format(1), "2101.00001", None), (3, t.format(5), None, "corpusid:77"), (4, t.format(5), "", "abcdef0123"), (5, t.format(5), None, "CorpusId:78"), (6, t.format(5), None, None), (7, t.format(21), "late", None), (8, t.format(20), "late", None), (9, t.format(30), "nodate", ""), (1, t.format(5), " 2101.00001v3 ", None), (10, None, "k1", None)]
    spark.createDataFrame(pap, "item_ord bigint, s string, arxiv_id string, semantic_paper_id string").selectExpr("item_ord", "to_timestamp_ntz(s) AS fetched_at", "arxiv_id", "semantic_paper_id", "2 AS first_us").write.parquet(str(tmp_path / "papers.parquet"))
    assert sorted(r.item_ord for r in S.p7_found(spark, str(tmp_path)).collect()) == [1, 3, 4, 7]
    r = S.p7_rates(spark, str(tmp_path)).first()
    assert r.n_wrong_no == 0 and r.n_wrong_yes <= 1 and r.n_seen == 5


def test_seen_empty(spark, tmp_path):
    spark.createDataFrame([], "seen string, seen_at timestamp_ntz").write.parquet(str(tmp_path / "semantic_scholar_memory.parquet"))
    spark.createDataFrame([], "item_ord bigint, fetched_at timestamp_ntz, arxiv_id string, semantic_paper_id string").write.parquet(str(tmp_path / "papers.parquet"))
    assert S.p7_found(spark, str(tmp_path)).count() == 0 and S.p7_rates(spark, str(tmp_path)).first().wrong_yes_rate == 0


def test_many_probes_of_few_keys(spark):
    """Two million probes against a thousand keys: each task gets about a bound of them, and no key is lost."""
    store = S.Sealed(spark, f"{shared_dir(spark)}/seen_test_probes")
    try:
        store.drop()
        store.seal(spark.range(1000).selectExpr("cast(id * 2000 AS string) AS key", "id AS first_us"), 10_000)
        assert [p for _, p, _ in store.generations()] == [1]
        keys = spark.range(2_000_000).selectExpr("cast(id AS string) AS key")
        sizes = []
        probe, S._probe = S._probe, lambda q, s: pd.DataFrame({"key": [str(len(q))], "first_s": [len(s)]})
        try:
            sizes = [(int(r.key), r.first_s) for r in store.ask(keys, 100_000).collect()]
        finally:
            S._probe = probe
        assert max(n for n, _ in sizes) < 110_000 and {s for _, s in sizes} == {1}
        yes = {int(r.key) for r in store.ask(keys, 100_000).collect()}
        assert yes >= {2000 * i for i in range(1000)} and len(yes) < 1000 + 2_000_000 * 3 / (1 << S.FP_BITS)
    finally:
        store.drop()


def test_sealed_generations_are_kept_and_reopened(spark):
    path = f"{shared_dir(spark)}/seen_test_generations"
    S.Sealed(spark, path).drop()
    memory = spark.range(30_000).selectExpr("concat('k', id) AS key", "id * 1000000 AS first_us")
    try:
        S.Sealed(spark, path).seal(memory, 20_000_000_000, 1000)
        again = S.Sealed(spark, path)
        assert again.end() == 20_000_000_000 and again.generations() == [(0, 20, 20_000_000_000)]
        again.seal(memory, 25_000_000_000, 1000)
        assert again.generations()[1] == (1, 5, 25_000_000_000)
        got = {r.key: r.first_s for r in again.ask(spark.range(29_000, 31_000).selectExpr("concat('k', id) AS key").unionByName(memory.where("first_us < 25000000000").select("key")), 1000).collect()}
        assert all(got[f"k{i}"] == i for i in range(25_000)) and len(got) < 25_000 + 5
        assert S.Sealed(spark, path + "_none").end() is None and S.Sealed(spark, path + "_none").ask(memory.select("key")).count() == 0
    finally:
        S.Sealed(spark, path).drop()


# --- packing


def test_best_fit():
    assert P.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    rng = random.Random(6)
    for _ in range(30):
        cap = rng.randrange(5, 60)
        sizes = sorted((rng.randrange(1, cap + 1) for _ in range(80)), reverse=True)
        got, room = P.best_fit(sizes, cap), {}
        for s, c in zip(sizes, got, strict=True):
            fits = [r for r in room.values() if r >= s]
            assert (c in room) == bool(fits) and (c not in room or room[c] == min(fits))
            room[c] = room.get(c, cap) - s
        assert min(room.values()) >= 0


@pytest.mark.parametrize("group", [40_000, 60])
def test_packed(spark, group):
    rng = random.Random(7)
    sizes = [rng.choice([5, 40, 90, 300, 2500]) + rng.randrange(30) for _ in range(700)] + [0, 100, 100, 12_345]
    counts = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([("a", 100, 1), ("b", 1000, 1), ("none", 0, 1)], "container_kind string, capacity_tokens int, used int")
    bins = P.packed(counts, kinds, group).collect()
    for kind, cap in (("a", 100), ("b", 1000)):
        mine = [b for b in bins if b.container_kind == kind]
        pieces = {}
        for b in mine:
            assert sum(b.tokens) == b.used <= cap and len(b.docs) == len(b.pieces) == len(b.tokens)
            for d, p, t in zip(b.docs, b.pieces, b.tokens, strict=True):
                assert (d, p) not in pieces
                pieces[d, p] = t
        assert {d: sum(t for (x, _), t in pieces.items() if x == d) for d in {x for x, _ in pieces}} == {i: s for i, s in enumerate(sizes) if s}
        assert all(sizes[d] > cap for d, p in pieces if p)
        assert len(mine) <= 1.02 * sum(sizes) / cap + sum(1 for s in sizes if s % cap > cap / 2) + 1
    assert not [b for b in bins if b.container_kind == "none"]
    assert P.packed(counts.limit(0), kinds).count() == 0


# --- mixing


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.randrange(0, 60)) for i in range(4000)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("missing", 0.4, 2), ("d", 0.0, 9)], "source string, target_share double, max_repeats int")
    used, wanted = X.mixture(counts, targets, (0.25, 1.0))
    got = used.collect()
    have = {s: sum(t for _, x, t in rows if x == s) for s in "abcd"}
    size = min(m * have[s] / w for s, w, m in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)))
    for budget in (0.25, 1.0):
        for s, w, m in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)):
            mine = [r for r in got if r.budget == budget and r.source == s]
            assert abs(sum(r.n_tokens * r.copies for r in mine) - budget * size * w) <= 60 and max(r.copies for r in mine) <= m
    small, large = ({(r.doc_id): r.copies for r in got if r.budget == b} for b in (0.25, 1.0))
    assert all(large.get(d, 0) >= c for d, c in small.items())
    assert {r.source for r in got} == {"a", "b", "c"} and wanted.count() == 6
    used, _ = X.mixture(counts.limit(0), targets)
    assert used.count() == 0


def test_token_counts(spark):
    import os

    if not os.path.exists(os.path.join(T.FOLDER, T.VOCABULARY)):
        pytest.skip("no vocabulary files")
    rows = [(1, "a", "Hello world"), (2, "a", ""), (3, None, None), (4, "b", "word " * 100_000), (5, "b", "<|endoftext|>")]
    got = {r.doc_id: r.n_tokens for r in T.token_counts(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and abs(got[4] - 100_001) <= 1 and got[5] > 1


def test_pieces_of_long_texts(monkeypatch):
    """Counts are those of the whole text, wherever pieces end."""
    import os

    if not os.path.exists(os.path.join(T.FOLDER, T.VOCABULARY)):
        pytest.skip("no vocabulary files")
    rng = random.Random(9)
    text = "".join(rng.choice(["word", "Don't", "12", " ", " ", "  ", "\n", "...", "\u4e2d\u6587", "\u00e9t\u00e9", " x"]) for _ in range(4000))
    whole = T.count(text)
    monkeypatch.setattr(T, "PIECE", 50)
    assert T.count(text) == whole and T.count("x" * 500) == len(T.encoding(T.FOLDER, T.VOCABULARY).encode_ordinary("x" * 500))
