"""Deduplicating new batches against all history.

A row is reduced to marks, 64-bit hashes of normalised content: its url as the page it opens, its
title as a bag of words, the title with one word less and that word less one letter (titles that
differ by a slip in one word share such a mark, titles with a word, number or instalment replaced
do not), with two neighbours written as one or a word that may be such a one, with the letters of
each word in order (several swaps or doublings); and for texts the whole and each paragraph.

A History lies in a folder and can be opened again. It keeps the marks with the row that first
brought each, bucketed by mark, the roots of rows known to be repeats, and roots merged since. A new
batch is joined to the marks bucket by bucket: history is neither shuffled nor recomputed, only the
batch is. Marks found link its rows to the rows first accepted; links and the roots they lead to are
a graph of the batch's size, whose components give the batch's roots; marks not found are appended.
Buckets follow the size: history is written into more of them when it has outgrown them. A backlog
of batches is taken in rounds that at most double the history, so all rounds together read history
a few times, not once a batch; inside a round the lowest batch and id holds a mark, which gives the
same links as one batch after another.

A mark on a third of all rows is one row of history; in the batch it is reduced by a partial
aggregate before the join, and the join back to its rows is one that adaptive execution splits.
History of n rows takes about 70 marks a title of about 20 bytes each.

Defined results: null and empty urls, titles and texts leave no mark; a null batch_no counts as the
last batch; repeated rows of one batch link to the lowest id; a row never comes out for a row of its
own batch alone; an empty table gives no rows; letter case of host names, default ports, `www.`,
fragments, trailing slashes, tracking parameters and paper versions do not matter, any other
parameter does; slips in words of up to three letters are not linked (`of` and `on` are other words).
An accept that failed half-way leaves nothing behind that later ones see."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import parse_qsl, urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.llm.neardup import mix
from sievelark.operators.components import connected_components
from sievelark.session import cut, fan_out, list_dir, remove, shared_dir, table

#: Least buckets of a history (None: the session's shuffle partitions, so the batch is exchanged once), and marks in a bucket from which on it is written into more.
BUCKETS, BUCKET_MARKS = None, 4_000_000
#: The batch of rows without one.
LAST = 2**31 - 1
#: Parameters that do not change the page.
TRACKING = re.compile(r"^(utm_.*|ref|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|source|campaign|spm|cmp)$")
#: Words that come and go in a title.
SMALL = {"a", "an", "the", "on"}
_WORD = re.compile(r"[^\W_]+")
_ROMAN = re.compile(r"^(?=.)m*(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})$")
_M = (1 << 64) - 1


def page_of(url: str | None) -> str | None:
    """The page that a url opens, written in one way; None if it names none."""
    if not url or not url.strip():
        return None
    u = url.strip()
    try:
        s = urlsplit(u if "://" in u else "https://" + u)
        host = (s.hostname or "").lower().removeprefix("www.")
        port = f":{s.port}" if s.port not in (None, 80, 443) else ""
    except ValueError:
        return u.lower()
    if not host:
        return None
    path = re.sub(r"/+", "/", s.path).rstrip("/")
    path = re.sub(r"/index\.(php|html?)$", "", path)
    paper = re.fullmatch(r"/(?:abs|pdf|html)/(.+?)(?:\.pdf)?", path)
    if paper and re.fullmatch(r"(\d{4}\.\d{4,5}|[a-z\-]+(\.[A-Za-z]{2})?/\d{7})(v\d+)?", paper[1]):
        path = "/abs/" + re.sub(r"v\d+$", "", paper[1])
    query = sorted((k, v) for k, v in parse_qsl(s.query, keep_blank_values=True) if not TRACKING.match(k.lower()))
    return f"{host}{port}{path}" + ("?" + "&".join(f"{k}={v}" for k, v in query) if query else "")


def title_words(title: str | None) -> list[str]:
    """The words of a title without markup, version notes and words that come and go."""
    t = unicodedata.normalize("NFKD", title or "")
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = re.sub(r"<[^<>]*>|\[v\d+\]|\((?:preprint|draft|version \d+|v\d+)\)", " ", t, flags=re.I)
    t = re.sub(r"\\[A-Za-z]+\*?\s*\{([^{}]*)\}", r"\1", t)
    return [w for w in _WORD.findall(t.replace("_", "").lower()) if w not in SMALL]


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s)


def _letters(w: str) -> str:
    """First and last letter and the different letters in order: the same after swaps and doublings inside the word."""
    return w if len(w) < 4 or any(c.isdigit() for c in w) or _ROMAN.match(w) else w[0] + "".join(sorted(set(w))) + w[-1]


def title_marks(words: list[str], cache: dict[str, np.ndarray]) -> np.ndarray:
    """The hash of the bag of words, and those of the bag with one word less a letter or as it is."""
    if not words:
        return np.empty(0, np.uint64)
    one = [_hash("w" + w) for w in words]
    total = sum(one) & _M
    plain = [total]
    if len(words) > 1:
        plain += [(total - h + _hash("j" + w)) & _M for w, h in zip(words, one, strict=True)]
        plain += [(total - g - h + _hash("j" + a + b)) & _M for a, b, g, h in zip(words, words[1:], one, one[1:], strict=False) if not (a + b).isdigit()]
        plain.append(sum(_hash("l" + _letters(w)) for w in words) & _M)
    less, rests = [], []
    for w, h in dict(zip(words, one, strict=True)).items():
        if len(w) < 4 or _ROMAN.match(w) or any(c.isdigit() for c in w):
            continue
        if (v := cache.get(w)) is None:
            if len(cache) > 50_000:
                cache.clear()
            v = cache[w] = np.array([_hash("v" + x) for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}], np.uint64)
        less.append(v)
        rests.append((total - h) & _M)
    out = mix(np.array(plain, np.uint64))
    if less:
        rest = np.repeat(mix(np.array(rests, np.uint64)), [len(v) for v in less])
        out = np.concatenate([out, mix(np.concatenate(less) * np.uint64(0x9E3779B97F4A7C15) + rest)])
    return np.unique(out)


def paragraphs(text: str | None) -> list[str]:
    """The paragraphs of a text: parts between blank lines or block tags, white space and case evened out; those without a word left out."""
    parts = re.split(r"\n\s*\n|</?(?:p|div|li|h[1-6]|pre|ul|ol|blockquote|br|tr|table)\b[^<>]*>", text or "", flags=re.I)
    even = (" ".join(_WORD.findall(re.sub(r"<[^<>]*>", "", p).lower())) for p in parts)
    return [p for p in even if p]


#: The tables, by the number that stands for each in a mark's row.
TABLES = ("papers", "blog_posts")
_MARKS = "tbl int, batch int, id bigint, whole boolean, mark bigint"
_ROW = "struct<tbl:int,batch:int,id:bigint>"


def _row(*columns: str | Column) -> Column:
    return F.struct(*columns)


def marks(df: DataFrame, kind: str) -> DataFrame:
    """(tbl, batch, id, whole, mark) of rows (tbl, batch, id, url, title, text); kind: item (url and title) or paragraph (of which whole is that of the whole text)."""

    def found(tbl: int, url: str | None, title: str | None, cache: dict) -> np.ndarray:
        out = title_marks(title_words(title), cache) if TABLES[tbl] == "papers" else np.empty(0, np.uint64)
        return np.append(out, np.uint64(_hash("u" + page))) if (page := page_of(url)) else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, np.ndarray] = {}
        salts = [np.uint64(_hash(t)) for t in TABLES]
        with np.errstate(over="ignore"):
            for b in filter(len, batches):
                m, whole = [], []
                if kind == "item":
                    m = [found(*x, cache) ^ salts[x[0]] for x in b[["tbl", "url", "title"]].itertuples(index=False)]
                    whole = np.zeros(sum(map(len, m)), bool)
                else:
                    for tbl, text in b[["tbl", "text"]].itertuples(index=False):
                        parts = paragraphs(text)
                        each = sorted({_hash("p" + p) for p in parts}) + ([_hash("c" + "\n".join(parts))] if parts else [])
                        m.append(np.array(each, np.uint64) ^ salts[tbl])
                        whole += [False] * (len(each) - 1) + [True] if each else []
                n = [len(x) for x in m]
                yield pd.DataFrame({c: np.repeat(b[c].to_numpy(), n) for c in ("tbl", "batch", "id")} | {"whole": whole, "mark": np.concatenate(m).view(np.int64)})

    need = ["url", "title"] if kind == "item" else ["text"]
    return fan_out(df.select("tbl", "batch", "id", *need)).mapInPandas(run, _MARKS)


class History:
    """Marks of accepted rows in a folder that all executors share, with the rows' roots.

    Sub-folders: marks_V_B, version V of the marks in B buckets; links_G and merges_G of accept number G;
    try_G and done_G say that an accept began and ended. One accept at a time."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "item"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        names = list_dir(spark, self.path)
        number = lambda prefix: {int(n.split("_")[1]) for n in names if n.startswith(prefix)}
        self.tried, self.done = number("try_"), number("done_")
        self.version, self.buckets = max(((int(v), int(b)) for _, v, b in (n.split("_") for n in names if n.startswith("marks_") and f"whole_{n.split('_')[1]}" in names)), default=(0, 0))
        self.name = None
        if self.buckets:
            self._register()

    def _register(self) -> None:
        """Names the stored marks in this session's catalog, so that their buckets are known to the planner."""
        self.name = f"history_{uuid.uuid4().hex[:12]}"
        where = f"{self.path}/marks_{self.version}_{self.buckets}".replace("'", "''")
        self.spark.sql(f"CREATE TABLE {self.name} (mark BIGINT, tbl INT, batch INT, id BIGINT, gen INT) USING parquet CLUSTERED BY (mark) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def _flag(self, name: str) -> None:
        self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def stored(self) -> DataFrame | None:
        """(mark, tbl, batch, id, gen) of the accepts that ended."""
        if self.name is None:
            return None
        failed = sorted(self.tried - self.done)
        out = self.spark.table(self.name)
        return out.where(~F.col("gen").isin(failed)) if failed else out

    def _append(self, new: DataFrame) -> None:
        """Adds marks; history that has outgrown its buckets is first written into more."""
        old = self.stored()
        total = new.count() + (old.count() if old is not None else 0)
        want = BUCKETS or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        while want * BUCKET_MARKS < total:
            want *= 2
        if want > 2 * self.buckets:
            before, name = (self.version, self.buckets), self.name
            self.version, self.buckets = self.version + 1, want
            if old is not None:
                new = new.unionByName(old)
            remove(self.spark, f"{self.path}/marks_{self.version}_{want}")
            self._register()
        new.repartition(self.buckets, "mark").select("mark", "tbl", "batch", "id", "gen").write.insertInto(self.name)
        if want == self.buckets and f"whole_{self.version}" not in list_dir(self.spark, self.path):
            self._flag(f"whole_{self.version}")
            if old is not None:
                self.spark.sql(f"DROP TABLE {name}")
                remove(self.spark, f"{self.path}/marks_{before[0]}_{before[1]}")

    def _begin(self) -> int:
        gen = max(self.tried, default=-1) + 1
        self._flag(f"try_{gen}")
        self.tried.add(gen)
        return gen

    def _end(self, gen: int) -> None:
        self._flag(f"done_{gen}")
        self.done.add(gen)

    def _place(self, marked: DataFrame, gen: int) -> DataFrame:
        """(mark, tbl, batch, id, c, h_batch, h_id): each mark of the batch, a row of its lowest batch and its number of rows, and the row of history that holds it.

        The batch is first reduced to one row a mark (with map-side combine; which row of one batch stands for
        it is no matter, as all of them get linked); marks that history lacks are appended."""
        first = marked.groupBy("mark").agg(F.min("tbl").alias("tbl"), F.min("batch").alias("batch"), F.min_by("id", "batch").alias("id"), F.count("*").alias("c"))
        old = self.stored()
        if old is None:
            first = first.withColumns({"h_batch": F.lit(None).cast("int"), "h_id": F.lit(None).cast("bigint")})
        else:
            first = first.join(old.select("mark", F.col("batch").alias("h_batch"), F.col("id").alias("h_id")), "mark", "left")
        first = cut(first)
        self._append(first.where("h_batch is null").select("mark", "tbl", "batch", "id", F.lit(gen).alias("gen")))
        return first

    def accept(self, rows: DataFrame) -> DataFrame:
        """(row, root) of those of the new rows (tbl, batch, id, url, title) that repeat another; root is the item's first row.

        The new rows may be of several batches, all later than those accepted before."""
        gen = self._begin()
        marked = cut(marks(rows, "item"))
        first = self._place(marked, gen)
        shared = first.where("h_batch is not null or c > 1").select("mark", F.coalesce("h_batch", "batch").alias("t_batch"), F.coalesce("h_id", "id").alias("t_id"), F.col("h_batch").isNotNull().alias("old"))
        pairs = marked.drop("whole").join(shared, "mark").where("batch <> t_batch or id <> t_id").select("tbl", "batch", "id", "t_batch", "t_id", "old").distinct()
        links = cut(pairs.select(_row("tbl", "batch", "id").alias("row"), _row("tbl", F.col("t_batch").alias("batch"), F.col("t_id").alias("id")).alias("to"), "old"))
        held = links.where("old").select("to").distinct()
        held = cut(self._rooted(held.join(self._linked().withColumnRenamed("row", "to"), "to", "left").select("to", F.coalesce("root", "to").alias("root"))))
        edges = links.join(held, "to", "left").select("row", F.coalesce("root", "to").alias("to"))
        parts = cut(connected_components(edges, "row", "to").where("node <> root"))
        known = held.select(F.col("root").alias("node")).distinct()
        parts.join(known, "node", "left_anti").select(F.col("node").alias("row"), "root").write.mode("overwrite").parquet(f"{self.path}/links_{gen}")
        moved = cut(parts.join(known, "node", "left_semi").select(F.col("node").alias("old"), F.col("root").alias("new")))
        merged = self._merges()
        again = merged.join(moved.select(F.col("old").alias("new"), F.col("new").alias("n2")), "new", "left").select("old", F.coalesce("n2", "new").alias("new"))
        again.unionByName(moved).write.mode("overwrite").parquet(f"{self.path}/merges_{gen}")
        self._end(gen)
        return self.spark.read.parquet(f"{self.path}/links_{gen}")

    def cover(self, rows: DataFrame) -> DataFrame:
        """(tbl, id, n_paragraphs, n_seen_before, full_copy) of those of the new rows (tbl, batch, id, text) that have a paragraph."""
        gen = self._begin()
        marked = cut(marks(rows, "paragraph"))
        first = self._place(marked, gen).select("mark", F.coalesce("h_batch", "batch").alias("t_batch"))
        before = F.col("t_batch") < F.col("batch")
        g = marked.join(first, "mark").groupBy("tbl", "batch", "id").agg(F.count_if(~F.col("whole")).alias("n_paragraphs"), F.count_if(~F.col("whole") & before).alias("n_seen_before"), F.bool_or(F.col("whole") & before).alias("full_copy"))
        out = cut(g.select("tbl", "id", "n_paragraphs", "n_seen_before", "full_copy"))
        self._end(gen)
        return out

    def _stored_of(self, name: str, gens: list[int], schema: str) -> DataFrame:
        """The rows that accepts wrote under a name."""
        paths = [f"{self.path}/{name}_{g}" for g in gens]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _linked(self) -> DataFrame:
        """(row, root as it was found)."""
        return self._stored_of("links", sorted(self.done), f"row {_ROW}, root {_ROW}")

    def _merges(self) -> DataFrame:
        """(old, new): roots that were found to be of another's item since."""
        return self._stored_of("merges", [max(self.done)] if self.done else [], f"old {_ROW}, new {_ROW}")

    def _rooted(self, df: DataFrame) -> DataFrame:
        """df with its column root as it is now."""
        m = self._merges()
        return df.join(m.withColumnRenamed("old", "root"), "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")

    def repeats(self) -> DataFrame:
        """(row, root) of all accepted rows that are not their item's first."""
        now = self._rooted(self._linked())
        return now.select("row", "root").unionByName(self._merges().select(F.col("old").alias("row"), F.col("new").alias("root")))

    def close(self) -> None:
        """Takes the marks out of this session's catalog; the folder stays."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.name = None

    def drop(self) -> None:
        """Deletes the folder."""
        self.close()
        remove(self.spark, self.path)


def rounds(rows: DataFrame) -> list[tuple[int, int]]:
    """First and last batch of each round: as many batches as at most double what is before them."""
    sizes = sorted((r.batch, r["count"]) for r in rows.groupBy("batch").count().collect())
    out, before, now = [], 0, 0
    for b, n in sizes:
        if out and now + n <= before:
            out[-1] = (out[-1][0], b)
            now += n
        else:
            out.append((b, b))
            before, now = before + now, n
    return out


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tables: tbl (its number), batch, id, url, title, text."""
    batch = F.coalesce("batch_no", F.lit(LAST)).alias("batch")
    p = table(spark, sf_dir, "papers").select(F.lit(0).alias("tbl"), F.col("item_ord").alias("id"), batch, "url", "title", F.col("abstract").alias("text"))
    b = table(spark, sf_dir, "blog_posts").select(F.lit(1).alias("tbl"), F.col("post_id").alias("id"), batch, "url", "title", F.col("content").alias("text"))
    return p.unionByName(b)


def fresh(spark: SparkSession) -> History:
    """An empty history of its own."""
    return History(spark, f"{shared_dir(spark).rstrip('/')}/history_{uuid.uuid4().hex[:12]}")


def _name(c: str) -> Column:
    return F.element_at(F.array(*map(F.lit, TABLES)), F.col(c) + 1)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose item an earlier batch brought, with the row first accepted: round by round against a stored history."""
    rows, history = delivered(spark, sf_dir), fresh(spark)
    try:
        for lo, hi in rounds(rows):
            history.accept(rows.where(F.col("batch").between(lo, hi)))
        found = history.repeats().where("row.batch > root.batch")
        return cut(found.select(_name("row.tbl").alias("tbl"), F.col("row.id").alias("row_id"), F.col("root.id").alias("first_id")).distinct())
    finally:
        history.drop()


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text with a paragraph: its paragraphs, how many an earlier batch brought, that share, and whether one brought the whole text."""
    rows, history = delivered(spark, sf_dir), fresh(spark)
    try:
        each = [history.cover(rows.where(F.col("batch").between(lo, hi))) for lo, hi in rounds(rows)]
        empty = spark.createDataFrame([], "tbl int, id bigint, n_paragraphs bigint, n_seen_before bigint, full_copy boolean")
        out = reduce(DataFrame.unionByName, each, empty)
        return out.select(_name("tbl").alias("tbl"), F.col("id").alias("row_id"), "n_paragraphs", "n_seen_before", (F.col("n_seen_before") / F.col("n_paragraphs")).alias("coverage"), "full_copy")
    finally:
        history.drop()
