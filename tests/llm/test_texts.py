"""Truncation, markup and look-alike letters on hand-made texts."""

import pytest

from sievelark.llm import lookalikes as L
from sievelark.llm import markup as M
from sievelark.llm import truncation as T

# --- truncation


@pytest.mark.parametrize(
    "text,status,mark",
    [
        ("A whole sentence.", "whole", ""), ("<p>It ends</p>", "whole", ""), ("Cut in a tag <a hre", "cut", ""), ("cut in an entity &nb", "cut", ""), ("a formula $\\sum_{t", "cut", ""), ("see \\emph{this", "cut", ""),
        ("a [link](https://x", "cut", ""), ("broken tr\ufffd", "cut", ""), ("```\ncode without end", "cut", ""), ("It goes o [...]", "ask", "said"), ("It goes o... [shortened for length]", "ask", "said"), ("It goes o\u2026 Read more", "ask", "said"),
        ("It is here: [the list.](https://a.example/" + "x" * 900 + ")", "whole", ""), ("<p>It is.</p" + " " * 900 + ">", "whole", ""), ("It goes o [shortened by " + "the site " * 90 + "]", "ask", "said"), ("Done. <a href='" + "y" * 900 + "'>See it.</a>", "whole", ""), ("x" * 900 + " so" + "." * 900, "ask", "dots"),
        ("More next week...", "ask", "dots"), ("(The list is in the wiki.)", "whole", ""), ("a < b and c > d", "ask", ""), ("costs $5 and $6", "ask", ""), ("```\nx\n```", "whole", ""), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "whole", ""), ("== Head ==", "whole", ""),
    ],
)
def test_endings(text, status, mark):
    assert T.ending(text)[:2] == (status, mark)


def test_judged(spark):
    import random

    rng = random.Random(4)
    adjectives, nouns = ["sparse", "robust", "bounded", "latent", "modular", "federated"], ["readers", "tables", "orbits", "critics", "encoders", "kernels"]
    s = lambda: f"We study {rng.choice(adjectives)} {rng.choice(nouns)} for the {rng.choice(adjectives)} {rng.choice(nouns)} of today."
    texts = [" ".join(s() for _ in range(4)) for _ in range(120)]
    whole, cut = texts[100][:-1], [" ".join([s(), s()])[:-n] for n in (5, 9, 21, 30)]
    dots = [f"{s()} More on that soon..." for _ in range(4)]
    rows = [("b", i, "f", t) for i, t in enumerate(texts[:100])] + [("b", 500, "f", whole), ("b", 501, "f", None), ("b", 502, "f", ""), ("b", 503, "f", "  "), ("b", 504, "f", "word " * 50_000 + "end.")]
    rows += [("b", 600 + i, "g", t) for i, t in enumerate(cut)] + [("b", 700 + i, "g", t) for i, t in enumerate(dots)] + [("b", 800, "g", cut[0])]
    got = {r.row_id: r.is_cut for r in T.judged(spark.createDataFrame(rows, "tbl string, row_id bigint, source string, text string")).collect()}
    assert len(got) == len(rows) and {i for i, c in got.items() if c} == {600, 601, 602, 603, 800}


def test_judged_nothing(spark):
    assert T.judged(spark.createDataFrame([], "tbl string, row_id bigint, source string, text string")).count() == 0


# --- markup

CASES = [
    ("<h2 class='x'>A &amp; <em>b</em></h2><ul><li>one<li>two</ul><OL><LI><p>three</p></LI></OL>", {("heading", "A & b"), ("list_item", "one"), ("list_item", "two"), ("list_item", "three")}),
    ("## Head ##\n\n- one **two**\n* three\n1. four\n2) five\n\n`x = 1` and **b**", {("heading", "Head"), ("list_item", "one two"), ("list_item", "three"), ("list_item", "four"), ("list_item", "five")}),
    ("Title\n=====\n\nSub\n---\n\n```py\n# no heading\n- no item\n```\n~~~\nx  =  1\n~~~", {("heading", "Title"), ("heading", "Sub"), ("code_block", "# no heading - no item"), ("code_block", "x = 1")}),
    ("== Wiki ==\n* it [[A|em]]\n<math>x_1</math> <syntaxhighlight lang='c'>\nint a;\n</syntaxhighlight>", {("heading", "Wiki"), ("list_item", "it em"), ("formula", "x_1"), ("code_block", "int a;")}),
    ("\\section*{On \\emph{this} \\& that}\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\begin{equation}\n E = m \n\\end{equation} $a+b$ \\(c\\) \\[d\\] $$ e $$", {("heading", "On this & that"), ("list_item", "a"), ("list_item", "b"), ("formula", "E = m"), ("formula", "a+b"), ("formula", "c"), ("formula", "d"), ("formula", "e")}),
    ("<pre><code>a &lt; b\n c</code></pre><!-- <h1>no</h1> --><title>no</title><style>li{}</style>", {("code_block", "a < b c")}),
    ("costs $5 now and $6 later; a < b, c > d; 2 * 3 * 4; ticket #75 and max_tokens_k", set()),
    ("<h2>cut head", set()), ("<ul><li>done</li><li>cut ite", {("list_item", "done")}), ("```\nno end", set()), ("\\begin{itemize}\n\\item a\n\\item cut", {("list_item", "a")}), ("<pre>cut", set()), ("text \\[ cut", set()), ("", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_elements(text, want):
    assert {(k, c) for k, c, _ in M.Parsed(text).elements} == want


def test_long_formulas_and_nested_items():
    long = "x_{1} + " * 100 + "y"
    texts = {
        f"Let ${long}$ be.": {("formula", long)},
        "Let $a +\n b$ be, for $5 now\nand $6 later.": {("formula", "a +\n b")},
        "a $5\n\nb$ c": set(),
        "- one\n    - two\n\t* three\n        1. four\n\n    - five\n\nEnd.": {("list_item", x) for x in ("one", "two", "three", "four", "five")},
        "999. a\n1000. b\n\nText\n    - code\nsince\n2019. We": {("list_item", "a"), ("list_item", "b")},
    }
    for text, want in texts.items():
        assert {(k, c) for k, c, _ in M.Parsed(text).elements} == want, text


def test_clean():
    p = M.Parsed("<h2>Head</h2><p>Some <b>bold</b> &amp; $x^2$ text.</p><ul><li>one</li><li>two</li></ul><pre>a\n b</pre>")
    assert p.clean == "# Head\n\nSome bold & $x^2$ text.\n\n- one\n- two\n\n```\na\n b\n```"


@pytest.mark.parametrize("most", [100, 0])
def test_templates(spark, most):
    rows = [("t", str(i), "h", f"<p>Own text {i}.</p><p>Subscribe now</p><ul><li>Home</li><li>Item {i}</li></ul>") for i in range(20)] + [("t", "x", "other", "<p>Subscribe now</p>"), ("t", "n", "h", "")]
    df = spark.createDataFrame(rows, "tbl string, row_key string, host string, text string")
    got = {r.row_key: r.clean_text for r in M.parsed(df, True, most).collect()}
    assert got["3"] == "Own text 3.\n\n- Item 3" and got["x"] == "Subscribe now" and got["n"] == ""
    items = {r.content for r in M.parsed(df, False, most).where("row_key = '3'").collect()}
    assert items == {"Item 3"}


def test_subtrees_nest():
    t = "<div><div>a</div><ul><li>b<li>c</ul></div><p>d<p>e</p></section><nav>open"
    assert {t[a:b] for a, b in M.subtrees(t)} == {"<div>a</div>", "<li>b", "<li>c", "<ul><li>b<li>c</ul>", "<div><div>a</div><ul><li>b<li>c</ul></div>", "<p>d", "<p>e</p>"}


def test_nested_template_of_a_host(spark, monkeypatch):
    """A nested navigation block of a host goes as one subtree from clean text and elements; without removal it would stay."""
    nav = "<div class='nav'><div><h3>Menu</h3></div><ul><li>Home<ul><li>Top</li></ul></li></ul></div>"
    rows = [("t", str(i), "h", f"https://h/{i}", f"<div><p>Own {i}.</p>{nav}<h2>Head {i}</h2></div>") for i in range(12)]
    df = spark.createDataFrame(rows, "tbl string, row_key string, host string, url string, text string")
    found = lambda: {(r.element, r.content) for r in M.parsed(df, False).where("row_key = '3'").collect()}
    assert found() == {("heading", "Head 3")}
    assert {r.clean_text for r in M.parsed(df, True).where("row_key = '3'").collect()} == {"Own 3.\n\n# Head 3"}
    monkeypatch.setattr(M, "template_hashes", lambda of_row: of_row.selectExpr("tbl", "host", "0L AS hash").limit(0))
    assert found() == {("heading", "Head 3"), ("heading", "Menu"), ("list_item", "Home"), ("list_item", "Top")}


def test_redelivered_post_is_no_template(spark):
    post = "<h2>Own head</h2><ul><li>own item</li></ul>"
    rows = [("t", f"r{i}", "h", f"https://h/post?utm_source={i}", post) for i in range(8)] + [("t", f"e{i}", "h", "http://www.h/post/", post + f"<p>Edit {i}.</p>") for i in range(4)]
    rows += [("t", f"m{i}", "m", f"https://m/mirror/{i}", post) for i in range(12)]
    rows += [("t", f"o{i}", "h", f"https://h/other/{i}", f"<p>Other {i}.</p>") for i in range(4)]
    rows += [("t", f"s{i}", "s", f"https://s/{i % 12}", f"<p>Own {i % 12}.</p><ul><li>Home</li></ul>") for i in range(40)]
    df = spark.createDataFrame(rows, "tbl string, row_key string, host string, url string, text string")
    got = {(r.row_key, r.element, r.content) for r in M.parsed(df, False).collect()}
    assert got == {(r[1], *e) for r in rows if r[2] in ("h", "m") and post in r[4] for e in (("heading", "Own head"), ("list_item", "own item"))}


def test_long_markup():
    p = M.Parsed("<p>word</p>" * 20_000 + "<li>" * 2_000 + "$" * 3_000 + "[" * 3_000 + "`" * 2_000)
    assert "word" in p.clean


# --- look-alikes


def test_common(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over copies of Pages"), (2, "\u0441\u044a\u0435\u0448\u044c \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u043c\u044f\u0433\u043a\u0438\u0445 \u0431\u0443\u043b\u043e\u043a"), (3, None)], "doc_id bigint, text string")
    s = L.Speller(L.trigrams(docs))
    same = [
        ("copies of Pages", "\u0441\u043e\u0440i\u0435s \u043ef P\u0430g\u0435s"), ("file", "\ufb01le"), ("caf\u00e9", "cafe\u0301"), ("a b", "a\u2009b"), ("a b", "a\u00a0b"), ("abc", "a\u200bb\u00adc\ufeff"), ("Full 12", "\uff26\uff55\uff4c\uff4c\u3000\uff11\uff12"),
        ("re-do", "re\u2011do"), ("x\ny", "x\r\ny"), ("\u0451", "\u0435\u0308"), ("\u00e4", "\u04d3"),
    ]
    for a, b in same:
        assert s.common(a) == s.common(b), (a, b, s.common(a), s.common(b))
    for a, b in [("cafe", "caf\u00e9"), ("page 1", "page 2"), ("Page", "page"), ("x2", "x\u00b2"), ("a  b", "a b"), ("l", "1"), ("\u03bb", "A")]:
        assert s.common(a) != s.common(b)
    assert s.common("\u0441\u043e\u0440ies") == "copies" and s.common("\u0431\u0443\u043bo\u043a") == "\u0431\u0443\u043b\u043e\u043a"
    assert s.common("") == "" and s.common("\u200b") == ""


def test_scores_decide():
    """Russian words of look-alike letters alone stay Russian in an English sentence; without scores they would not."""
    import pandas as pd

    english = "the choir and the litter box near a copy of each space, so we hope the cop has seen people escape; no one places open cases on paper, as such copies cope " * 3
    russian = "\u0445\u043e\u0440\u043e\u0448\u0438\u0439 \u0445\u043e\u0440\u043e\u0432\u043e\u0434 \u0445\u043e\u0434\u0438\u0442 \u0437\u0430 \u0441\u043e\u0440\u043e\u043a\u0430\u043c\u0438, \u0440\u0430\u0437\u0431\u043e\u0440 \u0441\u043e\u0440\u0442\u043e\u0432 \u0438 \u0441\u043f\u043e\u0440\u044b \u0434\u0432\u043e\u0440\u043e\u0432 " * 3
    grams = {}
    for b in L.count_trigrams(iter([pd.DataFrame({"text": [english, russian, None]})])):
        grams = dict(zip(b["gram"], b["n"], strict=True))
    choir = "\u0445\u043e\u0440"
    text = f"The word {choir} means choir, xop does not."
    with_, without = L.Speller(grams), L.Speller({})
    assert with_.common(text) == f"The word {choir} means choir, {choir} does not." and without.common(text) == "The word xop means choir, xop does not."
    assert with_.common("a cop has a case") == "a cop has a case" == with_.common("\u0430 \u0441\u043e\u0440 h\u0430s \u0430 \u0441as\u0435")
    assert with_.common("\u13e2\u13aa\u0405E \u0570\u0565") != "" and with_.common("\u13aa\u13be\u13d2A") == with_.common("\u0410\u13be\u13d2\u0391")


def test_lookalike_pairs(spark, tmp_path):
    rows = [(1, "same page", 0), (2, "s\u0430me p\u0430ge", 0), (3, "same page", 0), (4, "same pages", 0), (5, None, 0), (6, None, 0), (7, "", 0), (8, "\u200b", 0), (9, "b" * 300_000, 0), (10, "b" * 299_999 + "\u00adb", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, form int").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in L.p10_found(spark, str(tmp_path)).collect()) == [(1, 2), (2, 3), (7, 8), (9, 10)]
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "e/documents.parquet"))
    assert L.p10_found(spark, str(tmp_path / "e")).count() == 0
