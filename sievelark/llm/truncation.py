"""Texts that were cut off: ending inside a word, tag or sentence, and how often each source cuts.

Over all texts (each distinct text once) are counted: words, as a trie of their beginnings; how
units of text (sentences, headings, list items) run, with the words of content replaced by a
place holder; and the lengths at which texts without an end pile up. A text is cut if
- a tag, character reference, command, link, formula or code block is left open, or a character
  is broken; or
- its end has no full stop or closing tag, after taking off a mark of cutting, and
  - its last word is unknown and a proper beginning of known words (a trie node with words below), or
  - its length is one at which texts pile up, or the mark says that it was cut, or
  - units that run as its last one does go on more often than they end there.
A last sentence with the writer's own dots, repeated in several texts and never going on, is whole.

Counts are partial aggregates; the trie, unit and length tables are joined to the last units, not
collected. Sent to every task is only the list of fixed words: those in at least FIXED of the units,
so at most the mean length of a unit over FIXED in number.

Defined results: null and empty texts and texts of white space are not cut; texts of one word are
judged like others; copies of a text get its answer; an empty table gives no rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.llm.markup import _CODE, _DROP, _FORMULA, Parsed
from sievelark.session import cut, fan_out, table

#: A fixed word is in at least this share of the units and mostly has one neighbour, or is in COMMON of them.
FIXED, COMMON, BOUND = 0.0005, 0.05, 0.7
#: A pile of lengths: at least this many texts without an end, and this many times the mean of the lengths around it.
PILE, PILE_TIMES, AROUND = 5, 6, 10
#: Least number of units that a judgement on how they run on needs; texts in which the writer's own dots recur.
LEAST, OWN = 5, 3
TAIL = 4

#: What is put after a cut.
MARK = re.compile(r"[\s.…]*(?:[\[(]\s*(?:\.\.\.|…|more|cut|shortened[^\[\]()]*|truncated[^\[\]()]*|continued?|snip|abridged)\s*[\])]?|(?:…|\.\.\.)\s*(?:read|see|show|continue)\s+(?:more|reading)\W*)\s*$", re.I)
_OPEN_TAG = re.compile(r"</?[A-Za-z][^<>]*$|</?$", re.S)
_ENTITY = re.compile(r"&(?:#\d{0,6}|#x[0-9a-f]{0,5}|([A-Za-z]{1,7}))$", re.I)
_ENTITIES = ("nbsp", "mdash", "ndash", "amp", "lt", "gt", "quot", "apos", "middot", "hellip", "rsquo", "lsquo", "ldquo", "rdquo", "copy", "bull", "times")
_OPEN_TEX = re.compile(r"\\[A-Za-z]*\*?(?:\[[^\]\n]*\])?\{[^{}]*$|\\[A-Za-z]*$")
_OPEN_LINK = re.compile(r"\[[^\[\]\n]*\]\([^()\s]*$|\[\[[^\[\]\n]*$|(?:^|\s)\[(?=\w)[^\[\]\n]*$")
_OPEN_FORMULA = re.compile(r"\\[(\[](?:(?!\\[)\]]).)*$|\$\$(?:(?!\$\$).)+$|(?<![\\\w$])\$(?=[^\s\d$])[^$\n]*$|\\begin\{[a-z]*\*?\}(?:(?!\\end\{).)*$|<math\b(?:(?!</math).)*$", re.S)
_CLOSED = re.compile(r"</(?:p|ul|ol|li|h[1-6]|pre|div|body|html|table|blockquote|syntaxhighlight|section|article)\s*>$|(?:^|\n)(?:`{3,}|~{3,})$|\\end\{[^{}]*\}$|={2,}$|(?:^|\n)-{3,}$|\\(?:sub)*(?:section|paragraph)\*?\{[^\n]*\}$|-->$", re.I)
_INLINE_END = re.compile(r"(?:\*{1,3}|_{1,3}|`|'{2,5}|</(?:a|b|i|em|strong|span|code|u|s)\s*>|\}|\]\]|\]\([^()\s]*\))$", re.I)
_STOP = re.compile(r"[.!?。！？](?:[\"'”’)\]]|&quot;)*$")
_TOKEN = re.compile(r"\$[^$\n]+\$|[^\W\d_]+(?:[-'’][^\W_]+)*|\d+(?:[.,]\d+)*|[,;:&()–—]")
_SPLIT = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+(?=\S)")


def tokens(s: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(s)]


def units(clean: str) -> list[tuple[str, str]]:
    """(kind, text): h headings, l list items, s sentences, of a clean text; code is left out."""
    out = []
    for b in clean.split("\n\n"):
        if b.startswith("```"):
            continue
        for line in b.split("\n"):
            if line.startswith("# "):
                out.append(("h", line[2:]))
            elif line.startswith("- "):
                out.append(("l", line[2:]))
            else:
                out += [("s", x) for x in _SPLIT.split(line) if x]
    return out


def at_end(pattern: re.Pattern, s: str, signs: tuple[str, ...] = (), near: int = 8) -> int:
    """Where a pattern tied to the end begins; -1 if it is not there.

    signs: those of which the last in the text begins a long match, however far back it is; matches without one are at most `near` long."""
    a = min([max(0, len(s) - near), *(x for t in signs if (x := s.rfind(t)) >= 0)])
    m = pattern.search(s, a)
    return m.start() if m else -1


def mark_at(s: str) -> int:
    """Where what was put after a cut begins; -1 if nothing was.

    It begins at the last bracket, or at the last dots before the last letter, with the dots and space before those."""
    word = len(s)
    while word and not s[word - 1].isalnum():
        word -= 1
    found = -1
    for a in {max(s.rfind("["), s.rfind("(")), s.rfind("…", 0, word), s.rfind("...", 0, word)}:
        if a < 0:
            continue
        while a and (s[a - 1].isspace() or s[a - 1] in ".…"):
            a -= 1
        if MARK.match(s, a):
            found = a if found < 0 else min(found, a)
    return found


def dots_at(s: str) -> int:
    """Where three dots or more at the end begin, with the space before them; -1 if there are none."""
    t = s.rstrip()
    a = len(t) - 1 if t.endswith("…") else len(t.rstrip(".")) if t.endswith("...") else -1
    return len(t[:a].rstrip()) if a >= 0 else -1


def open_tag(s: str) -> bool:
    """Whether the text ends inside a tag or a comment."""
    if (a := s.rfind("<!--")) >= 0 and "-->" not in s[a:]:
        return True
    a = s.rfind("<")
    return a >= 0 and bool(_OPEN_TAG.match(s, a))


def ending(text: str) -> tuple[str, str, str, bool, int, list[tuple[str, str]]]:
    """(status, mark, last unit as kind and words, whether it ends in a word, length before the mark, the finished units).

    status: cut and whole are certain; ask needs the counts."""
    s = text.rstrip()
    mark, body = "", s
    if (a := mark_at(s)) >= 0:
        mark, body = "said", s[:a]
    elif (a := dots_at(s)) >= 0:
        mark, body = "dots", s[:a]
    size = len(body)
    if not mark:
        size = len(text)
    broken = body.endswith("�")
    body = body.rstrip("�")
    tail = body.rstrip()
    p = Parsed(tail)
    found = units(p.clean)
    if broken or open_tag(tail) or p.rest:
        return "cut", mark, "", False, size, found[:-1]
    if (m := _ENTITY.search(tail, max(0, len(tail) - 12))) and (m[1] is None or any(e.startswith(m[1].lower()) for e in _ENTITIES)):
        return "cut", mark, "", False, size, found[:-1]
    bare = _FORMULA.sub(lambda m: m[0] if m["tick"] else " f ", _CODE.sub(" ", _DROP.sub(" ", tail)))
    last = bare[bare.rfind("\n\n") + 2 :] if "\n\n" in bare else bare
    if _OPEN_TEX.search(last) or _OPEN_LINK.search(last) or _OPEN_FORMULA.search(last):
        return "cut", mark, "", False, size, found[:-1]
    line = max(0, tail.rfind("\n"))
    if _CLOSED.search(tail, min(line, tail.rfind("<")) if "<" in tail else line):
        return "whole", mark, "", False, size, found
    plain = tail
    while (a := at_end(_INLINE_END, plain, ("</", "]("))) >= 0:
        plain = plain[:a].rstrip()
    if not plain or at_end(_STOP, plain, tuple(".!?。！？")) >= 0 or not found:
        return "whole", mark, "", False, size, found
    kind, words = found[-1]
    return "ask", mark, f"{kind}\t{' '.join(tokens(words))}", plain[-1].isalnum() and body == tail, size, found[:-1]


def endings(texts: DataFrame) -> DataFrame:
    """The ending of each of the texts (tbl, row_id, source, text) that has one, and its finished units."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tbl, i, src, text in b[["tbl", "row_id", "source", "text"]].itertuples(index=False):
                status, mark, last, glued, size, done = ending(text)
                out.append((tbl, i, src, xxhash.xxh3_64_intdigest(text) - (1 << 63), status, mark, last, glued, size, [f"{k}\t{' '.join(tokens(t))}" for k, t in done]))
            yield pd.DataFrame(out, columns=["tbl", "row_id", "source", "h", "status", "mark", "last", "glued", "size", "done"])

    return fan_out(texts).mapInPandas(run, "tbl string, row_id bigint, source string, h bigint, status string, mark string, last string, glued boolean, size int, done array<string>")


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(w, x, n): words (x empty) and neighbours (w then x as `>x`, and x as `<w`); units as w ` `."""
    for b in batches:
        one: Counter[str] = Counter()
        two: Counter[tuple[str, str]] = Counter()
        for done in b["done"]:
            for u in done:
                t = u.split("\t", 1)[1].split(" ")
                one.update(t)
                two.update(zip(t, t[1:], strict=False))
            one[" "] += len(done)
        rows = [(w, "", n) for w, n in one.items()] + [(x, ">" + y, n) for (x, y), n in two.items()] + [(y, "<" + x, n) for (x, y), n in two.items()]
        yield pd.DataFrame(rows, columns=["w", "x", "n"])


def fixed_words(counts: DataFrame) -> set[str]:
    """The words of the frame rather than of the content: common, or mostly beside one neighbour."""
    n = counts.where("w = ' '").agg(F.sum("n")).first()[0] or 0
    per = counts.where("w <> ' '").groupBy("w").agg(F.max(F.when(F.col("x") == "", F.col("n"))).alias("n"), F.max(F.when(F.col("x") != "", F.col("n"))).alias("m"))
    kept = per.where((F.col("n") >= F.greatest(F.lit(3), F.lit(FIXED * n))) & ((F.col("n") >= COMMON * n) | (F.col("m") >= BOUND * F.col("n"))))
    return {r.w for r in kept.select("w").collect()}


class Shapes(dict):
    """Word -> its place holder: # numbers, $ formulas, * content, or itself if it is fixed or a sign."""

    def __init__(self, fixed: set[str]):
        super().__init__({w: w for w in fixed})

    def __missing__(self, x: str) -> str:
        out = "#" if x[:1].isdigit() else "$" if x[:1] == "$" else x if not x[:1].isalpha() else "*"
        if len(self) < 500_000:
            self[x] = out
        return out

    def of(self, words: list[str]) -> list[str]:
        return [self[w] for w in words]


def _key(kind: str, shape: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(kind + " ".join(shape)) - (1 << 63)


def trie(vocabulary: DataFrame) -> DataFrame:
    """(node, below): every proper beginning of a word of the vocabulary, with the number of words below."""
    begin = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.substring("w", F.lit(1), k)))
    return vocabulary.where("length(w) > 1").select(begin.alias("node")).groupBy("node").agg(F.count("*").alias("below"))


def judged(texts: DataFrame) -> DataFrame:
    """(tbl, row_id, source, is_cut) of every row of (tbl, row_id, source, text)."""
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    all_ = cut(endings(texts.where(~blank)))
    once = cut(all_.dropDuplicates(["tbl", "h"]))
    counts = cut(once.select("done").mapInPandas(count_words, "w string, x string, n bigint").groupBy("w", "x").agg(F.sum("n").alias("n")))
    fixed = fixed_words(counts)
    vocabulary = counts.where("x = '' and n >= 2 and w <> ' '").select("w", "n")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes(fixed)
        for b in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for done in b["done"]:
                for u in done:
                    kind, rest = u.split("\t", 1)
                    seen[kind, " ".join(shapes.of(rest.split(" ")))] += 1
            stop: Counter[int] = Counter()
            on: Counter[int] = Counter()
            for (kind, shape), n in seen.items():
                s = shape.split(" ")
                for j in range(1, len(s) + 1):
                    c = stop if j == len(s) else on
                    c[_key("F" + kind, s[:j])] += n
                    c[_key("T" + kind, s[max(0, j - TAIL) : j])] += n
            keys = list(stop.keys() | on.keys())
            yield pd.DataFrame({"k": pd.Series(keys, dtype="int64"), "ends": [stop[k] for k in keys], "goes_on": [on[k] for k in keys]})

    run = cut(once.select("done").mapInPandas(runs, "k bigint, ends bigint, goes_on bigint").groupBy("k").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")))

    def last_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes(fixed)
        for b in batches:
            out = []
            for tbl, h, mark, last, glued, size in b[["tbl", "h", "mark", "last", "glued", "size"]].itertuples(index=False):
                kind, rest = last.split("\t", 1)
                t = rest.split(" ")
                s = shapes.of(t)
                out.append((tbl, h, kind, mark, last, t[-1] if glued else None, size, _key("F" + kind, s), _key("T" + kind, s[-TAIL:])))
            yield pd.DataFrame(out, columns=["tbl", "h", "kind", "mark", "last", "word", "size", "kf", "kt"])

    ask = cut(once.where("status = 'ask'").mapInPandas(last_keys, "tbl string, h bigint, kind string, mark string, last string, word string, size int, kf bigint, kt bigint"))
    lengths = ask.groupBy("tbl", "size").agg(F.count("*").alias("n"))
    around = lengths.select("tbl", F.explode(F.sequence(F.col("size") - AROUND, F.col("size") + AROUND)).alias("size"), "n").groupBy("tbl", "size").agg(F.sum("n").alias("around"))
    piles = lengths.join(around, ["tbl", "size"]).where((F.col("n") >= PILE) & (F.col("n") * 2 * AROUND >= PILE_TIMES * (F.col("around") - F.col("n")))).select("tbl", "size", F.lit(True).alias("piled"))
    own = ask.where("mark = 'dots'").groupBy("tbl", "last").agg(F.count("*").alias("dotted"))
    f = run.select(F.col("k").alias("kf"), F.col("ends").alias("f_ends"), F.col("goes_on").alias("f_on"))
    t = run.select(F.col("k").alias("kt"), F.col("ends").alias("t_ends"), F.col("goes_on").alias("t_on"))
    x = ask.join(piles, ["tbl", "size"], "left").join(own, ["tbl", "last"], "left").join(f, "kf", "left").join(t, "kt", "left")
    x = x.join(vocabulary.select(F.col("w").alias("word"), F.col("n").alias("known")), "word", "left").join(trie(vocabulary).withColumnRenamed("node", "word"), "word", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    partial = (zero("known") == 0) & (zero("below") > 0)
    whole = F.when(zero("f_ends") + zero("f_on") >= LEAST, zero("f_ends") >= zero("f_on")).when(zero("t_ends") + zero("t_on") >= LEAST, zero("t_ends") >= zero("t_on"))
    dots = (F.col("mark") == "dots") & (zero("dotted") >= OWN) & (zero("f_on") < zero("dotted"))
    unsure = (F.col("kind") == "s") & ((F.col("mark") != "") | zero("f_ends").eqNullSafe(0) & (zero("f_on") > 0))
    is_cut = F.when(dots, False).otherwise(partial | F.coalesce("piled", F.lit(False)) | (F.col("mark") == "said") | F.coalesce(~whole, unsure))
    verdict = x.select("tbl", "h", is_cut.alias("asked"))
    out = all_.join(verdict, ["tbl", "h"], "left").select("tbl", "row_id", "source", F.coalesce("asked", F.col("status") == "cut").alias("is_cut"))
    return out.unionByName(texts.where(blank).select("tbl", "row_id", "source", F.lit(False).alias("is_cut")))


def sized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, source, text) of papers.abstract and blog_posts.content."""
    p = table(spark, sf_dir, "papers").select(F.lit("papers").alias("tbl"), F.col("item_ord").alias("row_id"), "source", F.col("abstract").alias("text"))
    b = table(spark, sf_dir, "blog_posts").select(F.lit("blog_posts").alias("tbl"), F.col("post_id").alias("row_id"), F.col("feed_key").alias("source"), F.col("content").alias("text"))
    return p.unionByName(b)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose text was cut."""
    return judged(sized_texts(spark, sf_dir)).where("is_cut").select("tbl", "row_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each papers.source and blog_posts.feed_key its rows, its cut rows and their share."""
    g = judged(sized_texts(spark, sf_dir)).groupBy("tbl", "source").agg(F.count("*").alias("n_rows"), F.count_if("is_cut").alias("n_cut"))
    return g.withColumn("cut_share", F.col("n_cut") / F.col("n_rows"))
