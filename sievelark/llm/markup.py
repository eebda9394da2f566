"""Markup residue to clean text that keeps its structure, with site templates removed.

1. Site templates: each text is split into blocks (all element subtrees of HTML, nested ones too;
   paragraphs between blank lines elsewhere). Blocks are hashed and counted per host (reports are the
   pages of one site) over its pages: a page delivered again counts once, as its longest text, and so does a text under
   several urls. Those on at least SHARE of a host's pages and on MIN_PAGES pages are templates and
   are deleted from that host's texts, the outermost first. On fewer pages a block that recurs cannot
   be told from content that was posted again, so nothing is deleted there.
2. Structure: code blocks and formulas are taken out first (nothing inside them is markup), then
   headings and list items of HTML, Markdown, wiki and LaTeX. Only complete elements count: one
   whose end is missing because the text was cut does not.
3. Clean text: paragraphs without inline markup, `#` headings, `-` items, fenced code and `$`
   formulas, character references resolved.

The counts are partial aggregates per host and hash, so one host with a third of all pages is no
matter. Each text is handled alone; templates come to it by broadcast up to BROADCAST of them, else
by a join on the row key.

Defined results: null texts give nothing, empty ones the empty text; HTML comments, `style`,
`script` and `title` are dropped; inline code is text; unclosed code, formulas and headings are
text; repeated elements of one row are listed once in p6_found."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.llm.history import page_of
from sievelark.session import cut, fan_out, table

#: Least share of a host's pages, and least number of pages, that a template block recurs on.
SHARE, MIN_PAGES = 0.5, 10
#: Most templates that are sent to every task.
BROADCAST = 50_000

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_CODE = re.compile(
    r"<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(?P<pre>.*?)(?:</code\s*>\s*)?</pre\s*>"
    r"|<(?P<sh>syntaxhighlight|source)\b[^>]*>(?P<wiki>.*?)</(?P=sh)\s*>"
    r"|^(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<fence>.*?)(?:\n|^)(?P=f)[ \t]*$"
    r"|\\begin\{(?P<v>verbatim\*?|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})?(?P<tex>.*?)\\end\{(?P=v)\}",
    re.S | re.M | re.I,
)
_OPEN_CODE = re.compile(r"<pre\b[^>]*>|<(?:syntaxhighlight|source)\b[^>]*>|^(?:`{3,}|~{3,})[^\n`]*$|\\begin\{(?:verbatim\*?|lstlisting|minted|alltt)\}", re.M | re.I)
_FORMULA = re.compile(
    r"(?P<tick>`[^`\n]+`)"
    r"|\$\$(?P<dd>.+?)\$\$|\\\[(?P<br>.+?)\\\]|\\\((?P<pa>.+?)\\\)"
    r"|\\begin\{(?P<e>(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(?P<env>.+?)\\end\{(?P=e)\}"
    r"|<math\b[^>]*>(?P<m>.+?)</math\s*>"
    r"|(?<![\\$\w])\$(?P<d>(?![\s$])(?:[^$\n]|\n(?![ \t]*(?:\n|(?:[-*#]+|\d+[.)])[ \t])))+?(?<![\s\\$]))\$(?![\d$])",
    re.S | re.I,
)
_HEAD = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.S | re.I)
_LIST_TAG = re.compile(r"<(/?)(li|ul|ol)\b[^>]*>", re.I)
_TEX_HEAD = re.compile(r"\\(?:chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]\n]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
_TEX_LIST = re.compile(r"\\(begin|end)\{(?:itemize|enumerate|description)\}(?:\[[^\]\n]*\])?|\\item\b(?:\[[^\]\n]*\])?")
_LINE = re.compile(
    r"^[ ]{0,3}(?P<h>\#{1,6})[ \t]+(?P<mh>\S[^\n]*?)[ \t]*\#*[ \t]*$"
    r"|^(?P<w>={2,6})[ \t]*(?P<wh>[^=\n]+?)[ \t]*(?P=w)[ \t]*$"
    r"|^(?P<sh>[^\s\-=#*+>|][^\n]*)\n(?:={3,}|-{3,})[ \t]*$"
    r"|^[ ]{0,3}(?:[-+]|\*+|\d{1,3}[.)])[ \t]+(?P<li>\S[^\n]*)$",
    re.M,
)
#: Items that only a list before them tells from code and prose: indented deeper, or numbered with more digits.
_NESTED = re.compile(r"^(?:(?:[ ]{4,}|[ ]{0,3}\t)[ \t]*(?:[-+]|\*+|\d{1,9}[.)])|[ ]{0,3}\d{4,9}[.)])[ \t]+(?=\S)", re.M)
_ITEM_LINE = re.compile(r"[ ]{0,3}(?:[-+]|\*+|\d{1,3}[.)])[ \t]+\S")
_HOLD = re.compile("\x00(\\d+)\x01")
#: Signs without which a text has no markup of any kind.
_SIGN = re.compile(r"[<>\\$`#*=\[\]&_~\x00]|''|^[ ]{0,3}(?:[-+]|\d{1,3}[.)])[ \t]|^-{3,}", re.M)


def unescape(s: str) -> str:
    return html.unescape(s.replace("&NBSP;", "&nbsp;"))


def squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def inline(s: str) -> str:
    """Text without inline markup of any kind, character references resolved."""
    s = re.sub(r"~?\\(?:cite[a-z]*|ref|label|footnote)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", s)
    for _ in range(3):
        s = re.sub(r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\([&%$#_{}])", r"\1", s)
    s = re.sub(r"(?<=\w)~(?=\S)", " ", s)
    s = re.sub(r"<br\b[^>]*>|</?(?:p|div|ul|ol|li|table|tr|td|th|h[1-6])\b[^>]*>", " ", s, flags=re.I)
    s = re.sub(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", "", s)
    s = re.sub(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)", r"\1", s)
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", s)
    s = re.sub(r"\[https?://\S+\s+([^\[\]\n]*)\]", r"\1", s)
    s = re.sub(r"'''''(.+?)'''''|'''(.+?)'''|''(.+?)''", lambda m: m[1] or m[2] or m[3], s)
    s = re.sub(r"(?<![\w*])(\*{1,3})(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2", s)
    s = re.sub(r"(?<![\w_])(_{1,3})(?=\S)(.+?)(?<=\S)\1(?![\w_])", r"\2", s)
    s = re.sub(r"`([^`\n]+)`", r"\1", s)
    return unescape(s)


def nested(t: str) -> str:
    """Nested list items written without their indentation.

    A list lasts to a heading or to an unindented line after a blank one."""
    if not _NESTED.search(t):
        return t
    out, in_list, blank = [], False, False
    for line in t.split("\n"):
        if _ITEM_LINE.match(line):
            in_list = True
        elif in_list and (m := _NESTED.match(line)):
            line = "- " + line[m.end() :]
        elif line.startswith("#") or (blank and line[:1].strip()):
            in_list = False
        blank = not line.strip()
        out.append(line)
    return "\n".join(out)


class Parsed:
    """elements: (kind, content, open) in no order; open: the element ends with the text, so a cut cannot be seen. clean: the clean text."""

    def __init__(self, text: str):
        self.held: list[tuple[str, str]] = []
        self.elements: list[tuple[str, str, bool]] = []
        if not _SIGN.search(text):
            self.rest = ""
            self.clean = "\n\n".join(x for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n")) if (x := squeeze(p)))
            return
        t = _DROP.sub(" ", text.replace("\r\n", "\n").replace("\x00", ""))
        t = _CODE.sub(self.code, t)
        if m := _OPEN_CODE.search(t):
            t, self.rest = t[: m.start()], t[m.end() :]
        else:
            self.rest = ""
        t = _FORMULA.sub(self.formula, t)
        t = _HEAD.sub(lambda m: self.block("heading", m[2]), t)
        t = self.lists(t)
        t = _TEX_HEAD.sub(lambda m: self.block("heading", m[1]), t)
        t = nested(self.tex_lists(t))
        end = len(t.rstrip())
        t = _LINE.sub(lambda m: self.line(m, end, bool(self.rest)), t)
        self.clean = self.assemble(t)

    def hold(self, kind: str, content: str) -> str:
        self.held.append((kind, content))
        return f"\x00{len(self.held) - 1}\x01"

    def code(self, m: re.Match) -> str:
        body = next(x for x in (m["pre"], m["wiki"], m["fence"], m["tex"]) if x is not None)
        if m["pre"] is not None:
            body = unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", body))
        self.elements.append(("code_block", squeeze(body), False))
        return "\n\n" + self.hold("code", body.strip("\n")) + "\n\n"

    def formula(self, m: re.Match) -> str:
        if m["tick"]:
            return m[0]
        body = next(x for x in (m["dd"], m["br"], m["pa"], m["env"], m["m"], m["d"]) if x is not None).strip()
        if not body or "\x00" in body:
            return m[0]
        self.elements.append(("formula", body, False))
        return self.hold("formula", body)

    def text_of(self, s: str) -> str:
        """The plain text of a piece, what is held inside it as it is written."""
        return squeeze(_HOLD.sub(lambda m: self.held[int(m[1])][1], inline(s)))

    def block(self, kind: str, s: str, open_: bool = False) -> str:
        content = self.text_of(s)
        if content:
            self.elements.append((kind, content, open_))
        return "\n\n" + self.hold(kind, content) + "\n\n"

    def lists(self, t: str) -> str:
        """Items of HTML lists; an item ends at its end tag, the next item or the list's end."""
        if not re.search(r"<li\b", t, re.I):
            return t
        out, at, stack = [], 0, []
        for m in _LIST_TAG.finditer(t):
            tag, closing = m[2].lower(), bool(m[1])
            if tag == "li" or closing:
                if stack and stack[-1] is not None:
                    start = stack[-1]
                    out.append(self.block("list_item", t[max(start, at) : m.start()]))
                    at, stack[-1] = m.end(), None
                elif not closing or tag != "li":
                    out.append(t[at : m.start()])
                    at = m.end()
                if closing and tag != "li" and stack:
                    stack.pop()
                elif not closing:
                    if not stack:
                        stack.append(None)
                    stack[-1] = m.end()
                    at = max(at, m.end())
            else:
                if stack and stack[-1] is not None and t[max(stack[-1], at) : m.start()].strip():
                    out.append(self.block("list_item", t[max(stack[-1], at) : m.start()]))
                    stack[-1] = None
                else:
                    out.append(t[at : m.start()])
                at = m.end()
                stack.append(None)
        out.append("\n\n" + t[at:])
        return "".join(out)

    def tex_lists(self, t: str) -> str:
        if "\\item" not in t:
            return t
        out, at, start = [], 0, None
        for m in _TEX_LIST.finditer(t):
            if start is not None:
                out.append(self.block("list_item", t[start : m.start()]))
            else:
                out.append(t[at : m.start()])
            at = m.end()
            start = m.end() if m[0].startswith("\\item") else None
        out.append("\n\n" + t[at:])
        return "".join(out)

    def line(self, m: re.Match, end: int, rest: bool) -> str:
        open_ = m.end() >= end and not rest and m["wh"] is None and m["sh"] is None
        if m["li"] is not None:
            return self.block("list_item", m["li"], open_)
        return self.block("heading", next(x for x in (m["mh"], m["wh"], m["sh"]) if x is not None), open_)

    def assemble(self, t: str) -> str:
        def put(m: re.Match) -> str:
            kind, s = self.held[int(m[1])]
            return {"heading": "# " + s, "list_item": "- " + s, "code": "```\n" + s + "\n```", "formula": "$" + s + "$"}[kind]

        parts = []
        for p in re.split(r"\n\s*\n|</?(?:p|div|h[1-6]|body|html|head|section|article|table|blockquote)\b[^<>]*>", t, flags=re.I):
            p = _HOLD.sub(put, p.strip()) if re.fullmatch(r"\s*\x00\d+\x01\s*", p) else _HOLD.sub(put, squeeze(inline(p)))
            if p:
                parts.append(p)
        return re.sub(r"(?m)^(- [^\n]*)\n\n(?=- )", r"\1\n", "\n\n".join(parts))


#: Elements whose subtrees are hashed, those that end where the next of them begins, and those without content.
_SUBTREE = re.compile(r"<(/?)(p|div|section|article|main|header|footer|nav|aside|form|figure|h[1-6]|pre|ul|ol|dl|li|table|tr|blockquote)\b[^<>]*>", re.I)
_ENDS_ITSELF = {"p", "li", "tr"}
_PARAGRAPH = re.compile(r"(?:[^\n]|\n(?!\s*\n))+")


def subtrees(text: str) -> list[tuple[int, int]]:
    """(start, end) of the complete element subtrees of a text, nested ones included, in the order of their ends.

    A paragraph, item or row also ends where its like begins or its parent ends; other elements left open are none."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _SUBTREE.finditer(text):
        tag = m[2].lower()
        if not m[1]:
            if tag in _ENDS_ITSELF and stack and stack[-1][0] == tag:
                out.append((stack.pop()[1], m.start()))
            stack.append((tag, m.start()))
            continue
        depth = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 65), -1) if stack[i][0] == tag), None)
        if depth is None:
            continue
        out += [(at, m.start()) for t, at in reversed(stack[depth + 1 :]) if t in _ENDS_ITSELF]
        out.append((stack[depth][1], m.end()))
        del stack[depth:]
    return out


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the blocks of a text, an outer one before those inside it: element subtrees, and paragraphs of what lies outside them."""
    trees = sorted(subtrees(text), key=lambda x: (x[0], -x[1])) if "<" in text else []
    out, at = [], 0
    for a, b in [*trees, (len(text), len(text))]:
        if a >= at:
            out += [(at + m.start(), at + m.end()) for m in _PARAGRAPH.finditer(text[at:a])]
            at = b
        if b > a:
            out.append((a, b))
    return [(a, b, xxhash.xxh3_64_intdigest(s.lower()) - (1 << 63)) for a, b in out if (s := squeeze(text[a:b]))]


def without(text: str, templates: frozenset[int]) -> str:
    """The text without the blocks whose hash is a template's."""
    if not templates:
        return text
    out, at = [], 0
    for a, b, h in blocks(text):
        if h in templates and a >= at:
            out.append(text[at:a])
            at = b
    return "".join(out) + text[at:]


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_key, host, url, text) of the fields that carry markup."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1))
    p = table(spark, sf_dir, "papers").select(F.lit("papers").alias("tbl"), F.col("item_ord").cast("string").alias("row_key"), host.alias("host"), "url", F.col("abstract").alias("text"))
    b = table(spark, sf_dir, "blog_posts").select(F.lit("blog_posts").alias("tbl"), F.col("post_id").cast("string").alias("row_key"), host.alias("host"), "url", F.col("content").alias("text"))
    r = table(spark, sf_dir, "feedback_runs").select(F.lit("feedback_runs").alias("tbl"), F.col("run_id").alias("row_key"), F.lit("reports").alias("host"), F.lit(None).cast("string").alias("url"), F.col("report_html").alias("text"))
    return p.unionByName(b).unionByName(r).where("text is not null")


def block_hashes(texts: DataFrame) -> DataFrame:
    """(tbl, row_key, host, page, whole, length, hashes): the different block hashes of each row, the hash of
    the page that its url opens (of its text without one), hash and length of its text."""
    if "url" not in texts.columns:
        texts = texts.withColumn("url", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, batches):
            whole = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in b["text"]]
            page = [w if (p := page_of(u)) is None else xxhash.xxh3_64_intdigest(p) - (1 << 63) for u, w in zip(b["url"], whole, strict=True)]
            hashes = [sorted({h for _, _, h in blocks(t)}) for t in b["text"]]
            yield pd.DataFrame({"tbl": b["tbl"], "row_key": b["row_key"], "host": b["host"], "page": page, "whole": whole, "length": b["text"].str.len(), "hashes": hashes})

    return texts.mapInPandas(run, "tbl string, row_key string, host string, page bigint, whole bigint, length int, hashes array<bigint>")


def template_hashes(of_row: DataFrame, share: float = SHARE, least: int = MIN_PAGES) -> DataFrame:
    """(tbl, host, hash) of the blocks that recur on a host's pages, each page and each whole text counted once."""
    of_page = of_row.groupBy("tbl", "host", "page").agg(F.max(F.struct("length", "whole", "hashes")).alias("of"))
    of_page = cut(of_page.groupBy("tbl", "host", F.col("of.whole").alias("whole")).agg(F.first("of.hashes").alias("hashes")))
    pages = of_page.groupBy("tbl", "host").agg(F.count("*").alias("n_pages"))
    each = of_page.select("tbl", "host", F.explode("hashes").alias("hash"))
    common = each.groupBy("tbl", "host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return common.join(pages, ["tbl", "host"]).where(F.col("n") >= share * F.col("n_pages")).select("tbl", "host", "hash")


def with_templates(texts: DataFrame, most: int = BROADCAST) -> DataFrame:
    """texts and `templates`, the hashes of template blocks to delete from each (null for none).

    Up to `most` templates are sent to every task by host, so texts are not shuffled; beyond that
    the hashes of each row's own template blocks are joined by row key."""
    of_row = cut(block_hashes(texts))
    common = cut(template_hashes(of_row))
    if common.count() <= most:
        by_host = common.groupBy("tbl", "host").agg(F.collect_set("hash").alias("templates"))
        return texts.join(F.broadcast(by_host), ["tbl", "host"], "left")
    each = of_row.select("tbl", "row_key", "host", F.explode("hashes").alias("hash")).join(common, ["tbl", "host", "hash"])
    return texts.join(each.groupBy("tbl", "row_key").agg(F.collect_set("hash").alias("templates")), ["tbl", "row_key"], "left")


def parsed(texts: DataFrame, clean: bool, most: int = BROADCAST) -> DataFrame:
    """Rows of (tbl, row_key, element, content, open), or with clean (tbl, row_key, clean_text, n_removed), the characters of templates."""
    texts = fan_out(texts)
    both = with_templates(texts, most).select("tbl", "row_key", "text", "templates")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tbl, key, text, gone in b[["tbl", "row_key", "text", "templates"]].itertuples(index=False):
                known = frozenset() if gone is None else frozenset(map(int, gone))
                own = without(text, known)
                p = Parsed(own)
                if clean:
                    out.append((tbl, key, p.clean, len(text) - len(own)))
                else:
                    out += [(tbl, key, *e) for e in dict.fromkeys(p.elements)]
            yield pd.DataFrame(out, columns=["tbl", "row_key", "clean_text", "n_removed"] if clean else ["tbl", "row_key", "element", "content", "open"])

    return both.mapInPandas(run, "tbl string, row_key string, " + ("clean_text string, n_removed int" if clean else "element string, content string, open boolean"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete heading, list item, code block and formula; each once a row."""
    return parsed(marked_texts(spark, sf_dir), False).select("tbl", "row_key", "element", "content").distinct()


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every row."""
    return parsed(marked_texts(spark, sf_dir), True)
