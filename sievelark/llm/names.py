"""Linking the spellings of one person's or team's name.

1. Distinct stored names are read into (given, surname) or (topic, team word) by rule and by
   two small vocabularies counted over the whole corpus: tokens standing beside many different
   partners (given names), and the later words of names with an organisation word (topics).
2. Names with the same known given name are joined on their surnames by a pigeonhole segment
   join: a string is cut into K+1 segments, position-shifted substrings of the other string
   are looked up in the inverted index, and hits are verified with banded edit distance.
   Buckets of more than HOT entries go through K-deletion neighbourhoods instead, which find
   exactly the same pairs with keys linear in the names. Given names that no vocabulary knows are
   joined in the same way inside blocks of one surname.
3. Connected components of these links are entities. Forms that leave the given name open
   (initials, a nickname of several names) join an entity only if exactly one fits best.

Forms of one spelling share one node before any join, so a name on a third of all rows is one
node. The vocabularies hold tokens that make up at least SHARE of the distinct names, so at
most 1/SHARE of them: that bounds what is sent to every task.

Defined results: null, blank and generic names (`admin`, `Guest`) pair with nothing; a name
of one word is linked to one-word names alone, in other letter cases or with a slip; repeated rows count once; middle
initials are ignored; an empty table gives no rows."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sievelark.operators.components import connected_components
from sievelark.session import cut, fan_out, table

#: Edit distance of the segment join; a surname is cut into K+1 segments.
K = 2
#: Buckets of the inverted index with more entries than this are joined by deletion neighbourhoods.
HOT = 2000
#: Least share of the distinct names that a vocabulary token has beside different partners, and least number.
SHARE, LEAST = 0.0003, 4
#: A surname in at most this share of the spellings, or of the rows, of a near one can be its slip: for one edit and for two.
SLIP_SPELLINGS, SLIP_ROWS = {1: 0.4, 2: 0.2}, {1: 0.1, 2: 0.05}

#: Letters of a surname from which on two edits can be one slip: shorter surnames two edits apart are mostly other people's (README).
LONG = 10

#: Fixed values.
TITLES = {"dr", "prof", "professor", "phd", "md", "mr", "mrs", "ms", "msc", "sir", "jr", "sr", "dipl", "ing"}
GENERIC = {"admin", "administrator", "guest", "editor", "editors", "editorial", "editorial team", "staff", "team", "the team", "webmaster", "anonymous", "unknown", "n a", "na", "none", "null", "author", "authors", "user", "root", "newsroom", "staff writer", "blog team", "the editors", "contributor", "various", "various authors", "moderator", "support", "press office", "info", "contact", "noreply"}
ORG = {"lab", "labs", "laboratory", "laboratories", "group", "grp", "team", "institute", "inst", "institut", "center", "centre", "department", "dept", "unit", "division", "university", "univ", "foundation", "consortium", "collective", "office"}
STOP = {"the", "of", "for", "and", "at", "in"}
#: Common English short forms of given names.
NICKNAMES = {
    "abigail": "abby gail abbie", "alexander": "alex al sandy xander lex", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs barbie bobbie", "benjamin": "ben benny benji",
    "charles": "charlie chuck chas", "christopher": "chris kit topher", "cynthia": "cindy cyn", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "edward": "ed eddie ned ted teddy",
    "elizabeth": "liz lizzie beth betty eliza libby betsy bess", "eugene": "gene", "frederick": "fred freddie freddy", "gabriel": "gabe", "gregory": "greg", "harold": "harry hal", "jennifer": "jen jenny jenn",
    "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "josie jo", "judith": "judy jude", "katherine": "kate kathy katie kat kitty kay", "lawrence": "larry laurie", "leonard": "len lenny leo",
    "margaret": "maggie peggy meg marge margie greta", "matthew": "matt matty", "michael": "mike mick mickey mikey", "nicholas": "nick nicky", "pamela": "pam pammy", "patricia": "pat patty trish tricia patsy", "rebecca": "becky becca bec",
    "richard": "rick dick rich ricky richie", "robert": "rob bob bobby robbie bert", "samuel": "sam sammy", "stephen": "steve stevie steph", "susan": "sue susie suzy", "theodore": "theo ted teddy", "thomas": "tom tommy",
    "timothy": "tim timmy", "victoria": "vicky tori vic vicki", "walter": "walt wally", "william": "will bill billy willy liam", "zachary": "zach zack zac", "james": "jim jimmy jamie", "john": "jack johnny", "dorothy": "dot dottie", "virginia": "ginny",
    "ronald": "ron ronnie", "donald": "don donny", "kenneth": "ken kenny", "raymond": "ray", "catherine": "cathy cate", "philip": "phil pip", "peter": "pete", "henry": "hank", "francis": "frank", "albert": "al bert",
}
#: Final letters that come and go, or stand for each other, in given names of different people (Paul and Paula, Maria and Mario, Andrea and Andreas); a final letter doubled is a slip.
ENDINGS = "aeios"
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "’": "'", "‐": "-", "‑": "-", "–": "-"})


def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKC", s).casefold().translate(_PLAIN)
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def words(name: str) -> tuple[list[str], list[str]] | None:
    """The words before and after a comma (or all, and none) of a name, titles removed; None for generic ones."""
    s = fold(name)
    if re.fullmatch(r"[^\W\d_]{2,}(?:-[^\W\d_]+)*[._][^\W\d_]{2,}", s.strip()):
        s = re.sub(r"[._]", " ", s)
    halves = []
    for half in s.split(",", 1):
        toks = [t.strip("-'") for t in re.findall(r"[^\W\d_]+(?:['-]+[^\W\d_]+)*", half)]
        halves.append([re.sub(r"-+", "-", t) for t in toks if t and t not in TITLES])
    a, b = halves[0], halves[1] if len(halves) > 1 else []
    if " ".join(a + b) in GENERIC or not a + b:
        return None
    return (a, b) if a else (b, [])


def is_team(toks: list[str]) -> bool:
    return any(t in ORG for t in toks) and len(toks) > 1


def core(toks: list[str]) -> list[str]:
    return [t for t in toks if t not in ORG and t not in STOP]


def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, token, partner) of each name: g from names of two long words, t from names with an organisation word."""
    for b in batches:
        out = []
        for name in b["name"]:
            if (w := words(name)) is None:
                continue
            toks = w[0] + w[1]
            if is_team(toks):
                c = core(toks)
                out += [("t", t, c[0]) for t in c[1:]]
            else:
                long = [t for t in toks if len(t) > 1]
                if len(long) == 2:
                    out += [("g", long[0], long[1]), ("g", long[1], long[0])]
        yield pd.DataFrame(out, columns=["kind", "token", "partner"])


def _less_one(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, in a band of `most`; most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [most + 1] * (len(b) + 1)
        row[0] = i
        for j in range(lo, hi + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return min(last[len(b)], most + 1)


def other_ending(a: str, b: str) -> bool:
    """Whether two given names differ in their endings alone, so that neither is a slip of the other."""
    a, b = sorted((a, b), key=len)
    return a == b[:-1] and b[-1] in ENDINGS and b[-1] != a[-1:] or len(a) == len(b) and a[:-1] == b[:-1] and a[-1] in ENDINGS and b[-1] in ENDINGS


class Reader:
    """Reads a name into (kind, key string, options): kind full or open; an option is a given name
    or topic, or an initial with `*`."""

    def __init__(self, given: list[str], topics: list[str]):
        self.short = defaultdict(set)
        for full, short in NICKNAMES.items():
            for s in short.split():
                self.short[s].add(full)
        self.given = set(given) | set(NICKNAMES)
        self.topics = sorted(set(topics))
        self.near = defaultdict(set)
        for g in self.given:
            if len(g) > 3:
                for d in _less_one(g):
                    self.near[d].add(g)

    def options(self, t: str) -> set[str]:
        if t in self.short:
            return set(self.short[t])
        if t in self.given:
            return {t}
        if len(t) < 3:
            return set()
        return {g for d in _less_one(t) for g in self.near.get(d, ()) if not other_ending(t, g) and osa(t, g, 1) <= 1}

    def score(self, t: str) -> int:
        return 2 if t in self.given or t in self.short else 1 if self.options(t) else 0

    def topic(self, t: str) -> str:
        """The topic that a word or its beginning names."""
        return next((x for x in self.topics if len(t) > 2 and x.startswith(t) and len(x) > len(t) + 2), t)

    def read(self, name: str) -> tuple[str, str, list[str]] | None:
        if (w := words(name)) is None:
            return None
        a, b = w
        toks = a + b
        if is_team(toks) or (len(toks) > 1 and not b and toks[0] not in self.given and all(t in self.topics for t in core(toks)[1:]) and core(toks)[1:]):
            c = core(toks)
            return ("full", c[0], ["team " + " ".join(self.topic(t) for t in c[1:])]) if c else None
        a, b = self.hyphens(a), self.hyphens(b)
        if a and b:
            surname, given = [t for t in a if len(t) > 1] or a, b
            key = "".join(surname)
        else:
            toks = a or b
            long = [i for i, t in enumerate(toks) if len(t) > 1]
            if not long or len(toks) == 1:
                return ("full", "".join(toks), ["only"])
            last = long[-1]
            if len(long) > 1 and self.score(toks[long[-1]]) > self.score(toks[long[0]]):
                last = long[0]
            key, given = toks[last], toks[:last] + toks[last + 1 :]
        first = next((t for t in given if len(t) > 1), None)
        if first is None:
            return ("open", key, [given[0] + "*"])
        opts = self.options(first)
        if len(opts) > 1:
            return ("open", key, sorted(opts))
        return ("full", key, sorted(opts) or [first])

    def unsure(self, r: tuple[str, str, list[str]]) -> bool:
        """Whether what was read has a given name of no vocabulary."""
        given = r[2][0]
        return r[0] == "full" and given != "only" and not given.startswith("team ") and given not in self.given

    def hyphens(self, toks: list[str]) -> list[str]:
        """Two words that make up a hyphenated given name become one."""
        out = []
        for t in toks:
            if out and f"{out[-1]}-{t}" in self.given:
                out[-1] = f"{out[-1]}-{t}"
            else:
                out.append(t)
        return out


def read_names(names: DataFrame) -> DataFrame:
    """(name, n_rows, kind, key, options, unsure) of distinct names; vocabularies are counted over all of them.

    unsure: the given name is in no vocabulary and not near one that is."""
    n = names.count()
    seen = names.mapInPandas(partners, "kind string, token string, partner string").distinct()
    vocab = seen.groupBy("kind", "token").agg(F.count("*").alias("n"))
    floor = F.when(F.col("kind") == "g", max(LEAST, SHARE * n)).otherwise(max(3, SHARE * n / 10))
    kept = vocab.where(F.col("n") >= floor).select("kind", "token").collect()
    reader = Reader([r.token for r in kept if r.kind == "g"], [r.token for r in kept if r.kind == "t"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x, n, *r, reader.unsure(r)) for x, n in zip(b["name"], b["n_rows"], strict=True) if (r := reader.read(x)) is not None]
            yield pd.DataFrame(rows, columns=["name", "n_rows", "kind", "key", "options", "unsure"])

    return names.mapInPandas(run, "name string, n_rows bigint, kind string, key string, options array<string>, unsure boolean")


def segments(n: int) -> list[tuple[int, int]]:
    """Start and length of the K+1 even segments of a string of n characters."""
    base, more, out, at = n // (K + 1), n % (K + 1), [], 0
    for i in range(K + 1):
        size = base + (i >= K + 1 - more)
        out.append((at, size))
        at += size
    return out


def index_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a segment: block, string, segment key."""
    for b in batches:
        out = [(k, s, f"{len(s)} {i} {s[p : p + m]}") for k, s in zip(b["block"], b["s"], strict=True) if len(s) > K for i, (p, m) in enumerate(segments(len(s)))]
        yield pd.DataFrame(out, columns=["block", "s", "seg"])


def probe_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The substrings of a string that could be a segment of a string as long or up to K shorter."""
    for b in batches:
        out = []
        for k, s in zip(b["block"], b["s"], strict=True):
            n = len(s)
            for m in range(max(K + 1, n - K), n + 1):
                d = n - m
                for i, (p, size) in enumerate(segments(m)):
                    for q in range(max(0, p - (K - d) // 2), min(n - size, p + (K + d) // 2) + 1):
                        out.append((k, s, f"{m} {i} {s[q : q + size]}"))
        yield pd.DataFrame(out, columns=["block", "s", "seg"]).drop_duplicates()


def deletion_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every string left after deleting up to K characters: two strings within K edits share one."""
    for b in batches:
        out = []
        for k, s in zip(b["block"], b["s"], strict=True):
            level = found = {s}
            for _ in range(K):
                level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
                found = found | level
            out += [(k, s, w) for w in found]
        yield pd.DataFrame(out, columns=["block", "s", "seg"])


def segment_join(strings: DataFrame, hot: int = HOT) -> DataFrame:
    """(block, a, b, d) for all distinct strings a < b of one block within K edits; d is 1 for one
    edit or one swap of neighbours, else 2. Strings of at most K characters match only themselves."""
    kind = "block string, s string, seg string"
    strings = strings.select("block", "s").distinct()
    index = cut(strings.mapInPandas(index_keys, kind))
    probe = strings.mapInPandas(probe_keys, kind)
    crowded = index.groupBy("block", "seg").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("block", "seg")
    crowded = cut(crowded)
    if crowded.isEmpty():
        special = None
    else:
        special = index.join(crowded, ["block", "seg"], "left_semi").select("block", "s").distinct()
        special = special.unionByName(probe.join(crowded, ["block", "seg"], "left_semi").select("block", "s")).distinct()
        special = cut(special.mapInPandas(deletion_keys, kind))
        index = index.join(crowded, ["block", "seg"], "left_anti")
        probe = probe.join(crowded, ["block", "seg"], "left_anti")
    pair = lambda x, y: x.alias("x").join(y.alias("y"), ["block", "seg"]).where("x.s <> y.s").select("block", F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b"))
    pairs = pair(index, probe)
    if special is not None:
        pairs = pairs.unionByName(pair(special, special))
    near = pairs.distinct().withColumn("d", F.levenshtein("a", "b", K)).where("d >= 0")
    swapped = (F.length("a") == F.length("b")) & (F.col("d") == 2) & _one_swap("a", "b")
    return near.withColumn("d", F.when(swapped, 1).otherwise(F.col("d")))


@F.pandas_udf(BooleanType())
def _one_swap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y, 1) <= 1 for x, y in zip(a, b, strict=True)])


def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n_rows): the different strings of papers.authors.name and blog_posts.author and how often they are stored."""
    a = table(spark, sf_dir, "papers").select(F.explode("authors").alias("x")).select(F.col("x.name").alias("name"))
    b = table(spark, sf_dir, "blog_posts").select(F.col("author").alias("name"))
    return a.unionByName(b).where("trim(coalesce(name, '')) <> ''").groupBy("name").agg(F.count("*").alias("n_rows"))


def slips(near: DataFrame, forms: DataFrame) -> DataFrame:
    """The near pairs of which one side can be a slip of the other.

    forms: (block, s, n, n_rows), how many different spellings and how many rows use the string. One
    edit: not both are established (in three spellings or more), or one is rare beside the other.
    Two edits: one side is in a single spelling, or rare beside the other, and both are long."""
    a, b = (forms.select("block", F.col("s").alias(x), F.col("n").alias("n" + x), F.col("n_rows").alias("rows_" + x)) for x in ("a", "b"))
    both = near.join(a, ["block", "a"]).join(b, ["block", "b"])
    few, many, few_rows, many_rows = F.least("na", "nb"), F.greatest("na", "nb"), F.least("rows_a", "rows_b"), F.greatest("rows_a", "rows_b")
    rare = lambda d, n: (few <= n) | (few <= SLIP_SPELLINGS[d] * many) | (few_rows <= SLIP_ROWS[d] * many_rows)
    long = F.least(F.length("a"), F.length("b"))
    return both.where(((F.col("d") <= 1) & rare(1, 2)) | ((F.col("d") == 2) & rare(2, 1) & (long >= LONG))).select("block", "a", "b", "d")


def given_slips(full: DataFrame) -> DataFrame:
    """(block, a, b, d): given names beside one surname (the block) of which one, in no vocabulary, can be a slip of the other.

    full: (s, given, unsure, n, n_rows). The same join on the other part of the name: vocabularies know common given names only."""
    new = full.where("unsure").select("s").distinct()
    each = full.where("given not like 'team %' and given <> 'only'").join(new, "s", "left_semi")
    each = cut(each.select(F.col("s").alias("block"), F.col("given").alias("s"), "unsure", "n", "n_rows"))
    near = slips(segment_join(each), each).where("d <= 1")
    unsure = each.where("unsure").select("block", "s")
    pairs = near.join(unsure.withColumnRenamed("s", "a").withColumn("ua", F.lit(True)), ["block", "a"], "left").join(unsure.withColumnRenamed("s", "b").withColumn("ub", F.lit(True)), ["block", "b"], "left")
    a, b, ends = F.col("a"), F.col("b"), list(ENDINGS)
    cut_a, cut_b = F.substring("a", F.lit(1), F.length("a") - 1), F.substring("b", F.lit(1), F.length("b") - 1)
    last_a, last_b = F.right("a", F.lit(1)), F.right("b", F.lit(1))
    other = ((cut_a == b) & last_a.isin(ends) & (last_a != last_b)) | ((cut_b == a) & last_b.isin(ends) & (last_a != last_b)) | ((cut_a == cut_b) & last_a.isin(ends) & last_b.isin(ends))
    return pairs.where((F.col("ua") | F.col("ub")) & ~other).select("block", "a", "b", "d")


def link_names(names: DataFrame) -> DataFrame:
    """(name, entity) for every name that is not generic; equal entities name the same person or team.

    names: distinct names, with n_rows if it is known how often each is stored."""
    if "n_rows" not in names.columns:
        names = names.withColumn("n_rows", F.lit(1).cast("bigint"))
    read = cut(read_names(fan_out(names)))
    node = F.concat_ws("\t", F.col("kind"), F.col("key"), F.concat_ws(",", "options"))
    read = read.withColumn("node", node)
    forms = cut(read.groupBy("node").agg(F.first("kind").alias("kind"), F.first("key").alias("key"), F.first("options").alias("options"), F.first("unsure").alias("unsure"), F.count("*").alias("n"), F.sum("n_rows").alias("n_rows")))
    full = forms.where("kind = 'full'").select("node", F.col("key").alias("s"), F.col("options")[0].alias("given"), "unsure", "n", "n_rows")
    counted = full.select(F.col("given").alias("block"), "s", "n", "n_rows")
    near = slips(segment_join(counted), counted)
    # distinct (given, surname) is a node of its own: the near pair names both ends
    name_of = lambda g, s: F.concat_ws("\t", F.lit("full"), s, g)
    links = near.select(name_of(F.col("block"), F.col("a")).alias("l"), name_of(F.col("block"), F.col("b")).alias("r"))
    links = links.unionByName(given_slips(full).select(name_of(F.col("a"), F.col("block")).alias("l"), name_of(F.col("b"), F.col("block")).alias("r")))
    roots = connected_components(links, "l", "r")
    whole = cut(full.join(roots, full.node == roots.node, "left").select(full.node, "s", "given", "n", "n_rows", F.coalesce("root", full.node).alias("entity")))

    wanted = forms.where("kind = 'open'").select("node", F.col("key").alias("s"), F.explode("options").alias("opt"), "n", "n_rows")
    wanted = wanted.select("node", "s", "opt", "n", "n_rows", F.substring("opt", 1, 1).alias("block"))
    real = whole.where("given not like 'team %' and given <> 'only'").withColumn("block", F.substring("given", 1, 1))
    counted = wanted.select("block", "s", "n", "n_rows").unionByName(real.select("block", "s", "n", "n_rows")).groupBy("block", "s").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))
    around = slips(segment_join(counted), counted)
    around = around.unionByName(around.select("block", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    same = wanted.select("block", F.col("s").alias("a"), F.col("s").alias("b"), F.lit(0).alias("d")).distinct()
    around = cut(around.unionByName(same))
    cand = wanted.alias("w").join(around.alias("n"), (F.col("w.block") == F.col("n.block")) & (F.col("w.s") == F.col("n.a")))
    cand = cand.join(real.alias("f"), (F.col("n.block") == F.col("f.block")) & (F.col("n.b") == F.col("f.s")))
    cand = cand.where("w.opt like '%*' or w.opt = f.given").groupBy("w.node", "f.entity").agg(F.min("n.d").alias("d"))
    best = cand.groupBy("node").agg(F.min("d").alias("d"))
    best = cand.join(best, ["node", "d"]).groupBy("node").agg(F.count("*").alias("n"), F.min("entity").alias("entity"))
    best = cut(best)
    alone = wanted.join(best, "node", "left_anti")
    both = alone.alias("w").join(around.alias("n"), (F.col("w.block") == F.col("n.block")) & (F.col("w.s") == F.col("n.a")))
    both = both.join(alone.alias("v"), (F.col("n.block") == F.col("v.block")) & (F.col("n.b") == F.col("v.s")))
    both = both.where("w.node <> v.node and (w.opt like '%*' or v.opt like '%*' or w.opt = v.opt)").select(F.col("w.node").alias("l"), F.col("v.node").alias("r"))
    apart = connected_components(both, "l", "r").select("node", F.col("root").alias("entity"))
    nodes = whole.select("node", "entity").unionByName(best.where("n = 1").select("node", "entity")).unionByName(apart)
    return read.join(nodes, "node", "left").select("name", F.coalesce("entity", "node").alias("entity"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different stored names of one person or team, by code point order."""
    e = cut(link_names(distinct_names(spark, sf_dir)))
    x, y = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return x.join(y, "entity").where("name_a < name_b").select("name_a", "name_b")


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stored name: its entity (the entity's smallest name) and how many spellings that has."""
    e = cut(link_names(distinct_names(spark, sf_dir)))
    size = e.groupBy("entity").agg(F.count("*").alias("n_spellings"), F.min("name").alias("entity_name"))
    return e.join(size, "entity").select("name", "entity_name", "n_spellings")
