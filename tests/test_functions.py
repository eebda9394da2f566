"""Column functions against values worked out with the standard library."""

import base64
import hashlib
import hmac
import json
import random
from urllib.parse import urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from sievelark.functions import text as X
from sievelark.functions import tokens as K


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def norm(u):
    p = urlsplit(u.strip())
    return urlunsplit((p.scheme.lower() or "https", p.netloc.lower(), p.path.rstrip("/"), "", "")) if u.strip() else ""


def test_urls(spark):
    urls = ["HTTPS://EXAMPLE.com/path/?x=1#frag", "http://a.example:8080/A/b//", "//host.example/x/", "/rel/path/", "plain", "https://h.example", " https://h.example/é/ ", "ftp://h.example/q?z", "mailto:someone"]
    rng = random.Random(5)
    for _ in range(200):
        urls.append(rng.choice(["http", "HTTPS"]) + "://" + rng.choice(["A.example", "b.example:443"]) + "/" + "".join(rng.choice("aZ/-_.%2") for _ in range(rng.randrange(12))) + rng.choice(["", "?q=1", "#f", "/?a=b#c"]))
    df = spark.createDataFrame([(u,) for u in urls], "x string").select("x", X.normalize_url(F.col("x")).alias("y"))
    assert [(r.x, r.y) for r in df.collect() if r.y != norm(r.x)] == []
    assert one(spark, None, X.normalize_url) == "" and one(spark, "  ", X.normalize_url) == ""


@pytest.mark.parametrize(
    "f,value,want",
    [
        (X.normalize_paper_id, " 123 ", "CorpusId:123"), (X.normalize_paper_id, "CorpusId:5", "CorpusId:5"), (X.normalize_paper_id, None, ""), (X.normalize_paper_id, "ab1", "ab1"),
        (X.normalize_arxiv_id, "arXiv: 2501.00001V2", "2501.00001v2"), (X.normalize_arxiv_id, None, ""), (X.match_title, "  Hello,\tWorld! Ünï-9 ", "hello world ünï9"), (X.match_title, None, ""),
        (X.strip_html, "<p>a <b>b</b>\n c</p>", "a b c"), (X.strip_html, None, ""), (X.first_sentences, "A. B. C. D.", "A. B. C."), (X.first_sentences, "no stop", "no stop."), (X.arxiv_id_of_url, "http://x/pdf/2501.00001v1", "2501.00001"),
        (X.json_array, "```json\n[1, 2]\n```", "[1, 2]"), (X.json_array, "none", ""), (X.base_url_of_model, "My-Claude-x", "https://api.anthropic.com/v1"), (X.base_url_of_model, "other", None), (X.spaced_title, " A  b\nC ", "a b c"),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, value, f) == want


def test_long_and_truncated(spark):
    assert one(spark, "x" * 1500, X.truncate_marked) == "x" * 1500
    assert one(spark, "x" * 1501, X.truncate_marked) == "x" * 1500 + X.TRUNCATED
    assert len(one(spark, "<b>y</b> " * 200_000, X.strip_html)) == 399_999


def test_signals(spark):
    r = [("t", "https://github.com/x", "has 1,234 stars"), ("t", "https://reddit.com/x", " hot "), ("T" * 80, "https://huggingface.co/x", ""), ("t", "https://github.com/y", "5 stars")]
    df = spark.createDataFrame([(r,), (r[3:],), ([],), ([("t", "https://github.com/y", "")],)], "x array<struct<title:string,url:string,content:string>>")
    got = [x.y for x in df.select(X.signals(F.col("x")).alias("y")).collect()]
    assert got == ["GitHub repo with 1,234 stars. Reddit discussion: hot.... HuggingFace: " + "T" * 60 + ".", "GitHub repo with 5 stars.", X.NO_SIGNAL, X.NO_SIGNAL]


def test_tokens(spark):
    claims = {"v": 1, "run_id": "run-1", "item_id": "p01", "semantic_paper_id": "CorpusId:1", "label": "positive", "reviewer": "x", "exp": "2030-01-01T00:00:00Z"}

    def signed(c, secret="s3cret"):
        p = base64.urlsafe_b64encode(json.dumps(c, separators=(",", ":"), sort_keys=True).encode()).rstrip(b"=").decode()
        return p + "." + base64.urlsafe_b64encode(hmac.new(secret.encode(), p.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()

    cols = {k: F.lit(v) for k, v in claims.items()}
    assert spark.range(1).select(K.token(K.claims_json(**cols), "s3cret").alias("t")).first().t == signed(claims)
    cases = {
        signed(claims): None, "nodot": "invalid token format", signed(claims)[:-2]: "invalid token signature", signed(claims, "other"): "invalid token signature", signed(claims | {"exp": "2000-01-01T00:00:00Z"}): "token expired",
        signed(claims | {"exp": "soon"}): "invalid token expiry", signed(claims | {"label": "maybe"}): "invalid label in token", signed(claims | {"item_id": " "}): "missing run_id/item_id",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", K.verify(F.col("t"), "s3cret", F.lit("2025-01-01").cast("timestamp")).alias("v"))
    assert {r.t: r.v.error for r in df.collect()} == cases


def test_dates(spark):
    r = spark.sql("SELECT timestamp'2026-02-21 10:00:05' a, timestamp'2026-02-21 10:00:05.25' b").select(X.run_id(F.col("a")).alias("r"), X.iso_utc(F.col("a")).alias("i"), X.iso_utc(F.col("b")).alias("j"), X.chinese_date(F.col("a")).alias("c")).first()
    assert tuple(r) == ("2026-02-21T10-00-05Z", "2026-02-21T10:00:05Z", "2026-02-21T10:00:05.250000Z", "2026年02月21日 周六")
