"""Column functions on urls, ids, titles, HTML and model output. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
#: Texts of the signals found on community sites.
NO_SIGNAL = "No significant external signals found."
TRUNCATED = "... [Truncated for token efficiency]"
#: Part of a model's name -> base url of its service.
MODEL_URLS = {"deepseek": "https://api.deepseek.com/v1", "claude": "https://api.anthropic.com/v1", "gemini": "https://generativelanguage.googleapis.com/v1beta/openai", "qwen": "https://dashscope.aliyuncs.com/compatible-mode/v1"}
#: Names of the week's days, Monday first.
WEEKDAYS = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")


def strip(c: Column) -> Column:
    """Without white space at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def squash(c: Column) -> Column:
    """Runs of white space made one space, ends stripped."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalize_url(c: Column) -> Column:
    """Scheme (https if missing) and host in lower case, path without trailing slashes, no query or fragment; empty for null and blank."""
    s = strip(c)
    part = lambda i: F.regexp_extract(s, _URL, i)
    scheme = F.when(part(1) == "", "https").otherwise(F.lower(part(1)))
    path = F.regexp_replace(part(3), "/+$", "")
    with_host = F.concat(scheme, F.lit("://"), F.lower(part(2)), path)
    bare = F.when((path == "") | path.startswith("/"), F.concat(scheme, F.lit("://"), path)).otherwise(F.concat(scheme, F.lit(":"), path))
    return F.when(s == "", "").when(part(2) != "", with_host).otherwise(bare)


def normalize_paper_id(c: Column) -> Column:
    """Digits become CorpusId:<digits>; blank is empty; all else is stripped."""
    s = strip(c)
    return F.when(s.rlike(r"^[0-9]+$"), F.concat(F.lit("CorpusId:"), s)).otherwise(s)


def normalize_arxiv_id(c: Column) -> Column:
    """Without the prefix, in lower case, with its version."""
    return F.lower(strip(F.regexp_replace(strip(c), r"(?i)^arxiv:", "")))


def spaced_title(c: Column) -> Column:
    return squash(F.lower(c))


def match_title(c: Column) -> Column:
    """Lower case letters, digits and single spaces only: the key by which titles are matched."""
    return squash(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]", ""))


def hrefs(c: Column) -> Column:
    """The normalised targets of all links of an HTML text, in order, repeats kept."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?i)href=[\"']([^\"']+)[\"']"), 1), normalize_url), lambda u: u != "")


def strip_html(c: Column) -> Column:
    return squash(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def truncate_marked(c: Column, limit: int = 1500, mark: str = TRUNCATED) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def first_sentences(c: Column, n: int = 3) -> Column:
    """The first n parts between '. ', ending in a full stop."""
    s = F.substring_index(c, ". ", n)
    return F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))


#: The sites that are searched for signals.
SITES = ("github.com", "reddit.com", "twitter.com", "huggingface.co")


def search_query(title: Column) -> Column:
    sites = " OR ".join(f"site:{s}" for s in SITES)
    return F.concat(F.lit('"'), title, F.lit(f'" ({sites}) (review OR discussion OR implementation OR reproducibility)'))


def signals(results: Column) -> Column:
    """Notes drawn from the first three search results (title, url, content), as one text."""

    def note(r: Column) -> Column:
        content = F.coalesce(r["content"], F.lit(""))
        stars = F.regexp_extract(content, r"(?i)(\d+[\d,]*)\s*stars?", 1)
        snippet = strip(F.left(content, F.lit(100)))
        site = F.when(r["url"].contains("reddit.com"), "Reddit").when(r["url"].contains("twitter.com"), "Twitter")
        code = F.when(stars != "", F.concat(F.lit("GitHub repo with "), stars, F.lit(" stars"))).otherwise("GitHub implementation available")
        return (
            F.when(r["url"].contains("github.com") & (content != ""), code)
            .when(site.isNotNull(), F.when(snippet != "", F.concat(site, F.lit(" discussion: "), snippet, F.lit("..."))))
            .when(r["url"].contains("huggingface.co"), F.concat(F.lit("HuggingFace: "), F.left(F.coalesce(r["title"], F.lit("")), F.lit(60))))
        )

    found = F.filter(F.transform(F.slice(results, 1, 3), note), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, F.concat(F.array_join(found, ". "), F.lit("."))).otherwise(NO_SIGNAL)


def arxiv_id_of_url(c: Column) -> Column:
    """The id in an abs or pdf address, or empty."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"/(?:abs|pdf)/(\d+\.\d+)", 1)


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def iso_utc(ts: Column) -> Column:
    """ISO form in UTC, microseconds only if there are some."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(ts, "SSSSSS")
    return F.concat(base, F.when(micro == "000000", "").otherwise(F.concat(F.lit("."), micro)), F.lit("Z"))


#: A time with date, clock and zone, up to microseconds.
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$"


def iso_time(c: Column, now: Column) -> Column:
    """The instant of an ISO time with a zone; anything else counts as `now`."""
    s = strip(c)
    return F.coalesce(F.when(s.rlike(ISO_TIME), s.try_cast("timestamp")), now.cast("timestamp"))


def chinese_date(ts: Column) -> Column:
    """Year, month, day and the weekday's name."""
    return F.concat(F.date_format(ts, "yyyy年MM月dd日"), F.lit(" "), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(ts) + 1))


def base_url_of_model(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, url in reversed(MODEL_URLS.items()):
        out = F.when(F.lower(c).contains(name), url).otherwise(out)
    return out


def truthy(c: Column) -> Column:
    """False only for false, 0, no and off, in any case."""
    return ~F.lower(c).isin("false", "0", "no", "off")


def json_array(c: Column) -> Column:
    """From the first [ to the last ] of a model's answer, code fences or not; empty if there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\[.*\]", 0)


def cache_key(arxiv_id: Column, title: Column, url: Column) -> Column:
    a = normalize_arxiv_id(arxiv_id)
    return F.when(a != "", F.concat(F.lit("arxiv:"), a)).otherwise(F.concat(F.lit("title:"), match_title(title), F.lit("|url:"), F.lower(strip(url))))


def blog_title(c: Column) -> Column:
    return F.concat(F.lit("[Blog] "), F.coalesce(c, F.lit("")))


def names_line(authors: Column, affiliations: bool = False, most: int = 5) -> Column:
    """Up to `most` author names, with affiliations or not, and `et al.` if there are more."""
    one = lambda a: F.concat(a["name"], F.when(affiliations & F.coalesce(a["affiliation"] != "", F.lit(False)), F.concat(F.lit(" ("), a["affiliation"], F.lit(")"))).otherwise("")) if affiliations else a["name"]
    line = F.array_join(F.transform(F.slice(authors, 1, most), one), ", ")
    return F.concat(line, F.when(F.size(authors) > most, " et al.").otherwise(""))


def prompt_block(n: Column, title: Column, authors: Column, abstract: Column, categories: Column, notes: Column | None = None) -> Column:
    """A numbered block of a paper for a prompt: five authors, 600 characters of abstract, three categories, notes if any."""
    cats = F.when(F.size(categories) > 0, F.array_join(F.slice(categories, 1, 3), ", ")).otherwise("N/A")
    text = [F.lit("\nPaper "), n.cast("string"), F.lit(":\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nAuthors: "), names_line(authors, True)]
    text += [F.lit("\nAbstract: "), F.left(F.coalesce(abstract, F.lit("")), F.lit(600)), F.lit("...\nCategories: "), cats]
    if notes is not None:
        text.append(F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("\n🔍 Community Signals: "), notes)).otherwise(""))
    return F.concat(*text)


#: Marks behind a title: its PDF is at hand, or could not be had.
HAS_PDF, PDF_FAILED = " [📄 PDF]", " [⚠️ PDF失败]"


def pdf_mark(has_pdf: Column, failed: Column) -> Column:
    """A failed PDF goes before one at hand; nulls are no."""
    return F.when(failed, PDF_FAILED).when(has_pdf, HAS_PDF).otherwise("")


def report_line(n: Column, title: Column, authors: Column, url: Column, notes: Column | None = None, mark: Column | None = None) -> Column:
    """A numbered entry of a paper for the report's prompt, with a mark behind its title if given."""
    text = [n.cast("string"), F.lit(". "), F.coalesce(title, F.lit("")), F.lit("") if mark is None else mark, F.lit("\n   Authors: "), names_line(authors), F.lit("\n   URL: "), F.coalesce(url, F.lit(""))]
    if notes is not None:
        text.append(F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("\n   🔍 Community Signals: "), notes)).otherwise(""))
    return F.concat(*text)


def blog_line(n: Column, title: Column, source: Column, url: Column, abstract: Column) -> Column:
    """A numbered entry of a post for the report's prompt: no mark in the title, 500 characters of text."""
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), r"^\[Blog\] ", "")
    preview = F.when(F.coalesce(abstract, F.lit("")) == "", "No content preview").otherwise(F.left(abstract, F.lit(500)))
    return F.concat(n.cast("string"), F.lit(". "), plain, F.lit("\n   Source: "), F.coalesce(source, F.lit("Unknown")), F.lit("\n   URL: "), F.coalesce(url, F.lit("")), F.lit("\n   Content: "), preview, F.lit("..."))
