"""One common form for texts that look the same but are stored as different characters.

1. Characters that are not seen are deleted, spaces of any width become a space, full-width,
   half-width, ligature and font forms become the plain letters, accents are taken apart.
2. Each letter stands for its class of look-alike letters (Latin, Cyrillic, Greek, Armenian,
   Cherokee). A word is a lattice of the members of its letters' classes. A word that holds a letter
   without look-alikes is read in that letter's script as far as its letters go; all others, words
   of look-alike letters alone and words that need several scripts, are searched with Viterbi under
   character trigram scores of each script, a price for a change of script inside the word, the
   share of the script's words in the corpus and a price for a word outside the script that most
   letters without look-alikes of the text belong to. Both prices are such that scores can overrule
   them: a Russian word in an English sentence stays Russian. Lattice, scores and prices depend on
   the classes alone, so texts that look the same get the same reading.
3. Accents are joined again. Texts with one common form are equal.

The trigram scores are counted over the words of all documents whose script is plain: they hold a
letter without look-alikes in another script, or are stored in their text's main script. Their size
is bounded by the alphabets.

Documents are compared by a 128-bit hash of the common form. Byte-identical copies are one class
before classes are paired, so a third of all rows being one text pairs nothing with itself.

Defined results: null texts are in no pair; empty texts and texts of unseen characters alone have
the empty form; white space at the ends does not count; line breaks and tabs: CR LF, CR and LF are
alike, a tab is a space; superscripts, fractions and circled forms differ visibly and stay."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.session import cut, fan_out, table

#: Letters that look alike, by script.
CYRILLIC = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I"}
GREEK = {"ο": "o", "ν": "v", "ρ": "p", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J"}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L", "Օ": "O"}
CHEROKEE = {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z"}
#: Letters of other kinds that are drawn as a plain one.
PLAIN = {"ɑ": "a", "ɡ": "g", "ℓ": "l", "‐": "-", "‑": "-", "﹣": "-", "ʼ": "’"}
#: Price of changing the script inside a word, and of a word outside the text's main script, in nats.
SWITCH, ABROAD = 12.0, 4.0
#: Weights of the trigram, bigram and letter shares in a score; the rest is spread over LETTERS letters.
WEIGHTS, LETTERS = (0.6, 0.3, 0.09), 40

_UNSEEN = re.compile("[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
_SPACE = re.compile("[\t\x0b\x0c\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_MARK = "\u0300-\u036f"
_LETTER = "A-Za-z\xaa-\u024f\u0370-\u052f\u0531-\u0587\u13a0-\u13f5"
_LETTERS = re.compile(f"(?:[{_LETTER}][{_MARK}]*)+")
_CLASS = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE}
_MEMBERS: dict[str, list[str]] = {}
for _c, _r in _CLASS.items():
    _MEMBERS.setdefault(_r, [_r]).append(_c)
_alike = "".join(_CLASS) + "".join(_MEMBERS)
_PLAIN_LATIN = re.compile(f"[{''.join(c for c in map(chr, range(65, 123)) if c.isalpha() and c not in _alike)}]")
_PLAIN_OTHER = [re.compile(f"[{''.join(c for c in map(chr, range(lo, hi)) if c.isalpha() and c not in _alike)}]") for lo, hi in ((0x400, 0x530), (0x370, 0x400), (0x531, 0x588), (0x13A0, 0x13F6))]
#: Words to be read in a Latin text: those with a letter outside ASCII, and those of look-alike ASCII letters alone.
_UNSURE = re.compile(f"(?<![{_LETTER}{_MARK}])(?:[A-Za-z][{_MARK}]*)*[{_LETTER[6:]}{_MARK}](?:[{_LETTER}][{_MARK}]*)*|(?<![{_LETTER}{_MARK}])[{''.join(_MEMBERS)}]+(?![{_LETTER}{_MARK}])")
_COMPAT = {"<wide>", "<narrow>", "<font>", "<noBreak>"}


def _plain_table() -> dict[int, str]:
    """Compatibility forms that look the same, and the letters of PLAIN."""
    out = {ord(k): v for k, v in PLAIN.items()}
    for c in [*range(0x2100, 0x2150), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)]:
        d = unicodedata.decomposition(chr(c))
        if d and (d.split()[0] in _COMPAT or 0xFB00 <= c < 0xFB07):
            out[c] = unicodedata.normalize("NFKC", chr(c))
    return out


_PLAIN = _plain_table()
_COMPATIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in _PLAIN if c < 0x10000) + "]")
_ASTRAL = re.compile("[\U0001d400-\U0001d7ff]")


def script(c: str) -> int:
    """0 Latin, 1 Cyrillic, 2 Greek, 3 Armenian, 4 Cherokee."""
    o = ord(c)
    return 0 if o < 0x370 else 1 if 0x400 <= o < 0x530 else 2 if o < 0x400 else 3 if 0x531 <= o < 0x588 else 4 if 0x13A0 <= o < 0x13F6 else 0


def seen(text: str) -> str:
    """The text without unseen characters and compatibility forms, accents apart."""
    if text.isascii() and "\t" not in text and "\r" not in text and "\x0b" not in text and "\x0c" not in text:
        return text.strip()
    t = _UNSEEN.sub("", text).replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n").replace("\x85", "\n")
    if _COMPATIBLE.search(t) or _ASTRAL.search(t):
        t = t.translate(_PLAIN)
    return unicodedata.normalize("NFD", _SPACE.sub(" ", t)).strip()


def main_script(t: str) -> int:
    """The script of most letters that have no look-alike in another; -1 if there are none, the earlier of equals."""
    if t.isascii():
        return 0 if _PLAIN_LATIN.search(t) else -1
    ascii_ = t.encode("ascii", "ignore")
    n = [len(ascii_) - len(ascii_.translate(None, _PLAIN_LATIN.pattern[1:-1].encode())), *(len(p.findall(t)) for p in _PLAIN_OTHER)]
    return n.index(max(n)) if max(n) else -1


def _word_scripts(w: str) -> tuple[set[int], bool]:
    """The scripts of a word, and whether one of its letters has no look-alike in another script."""
    letters = [c for c in w if not unicodedata.combining(c)]
    return {script(c) for c in letters}, any(c not in _CLASS and c not in _MEMBERS for c in letters)


def count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, n): runs of three lower-case letters inside words of one plain script, its number before them."""
    total: Counter[str] = Counter()
    for b in batches:
        words: dict[int, Counter[str]] = {}
        for t in b["text"]:
            if t is not None:
                t = seen(t)
                words.setdefault(main_script(t), Counter()).update(_LETTERS.findall(t))
        for main, w, n in ((k, w, n) for k, c in words.items() for w, n in c.items()):
            scripts, plain = _word_scripts(w)
            if len(scripts) == 1 and (plain or main in scripts):
                s = str(min(scripts))
                letters = "^^" + "".join(c for c in w if not unicodedata.combining(c)).lower() + "$"
                for i in range(len(letters) - 2):
                    total[s + letters[i : i + 3]] += n
    if total:
        yield pd.DataFrame({"gram": list(total), "n": list(total.values())})


class Speller:
    """Reads the lattice of a word; scores: log probability of a letter after the two before it in a script."""

    def __init__(self, grams: dict[str, int]):
        self.n: list[Counter[str]] = [Counter(), Counter(), Counter(), Counter()]
        for g, n in grams.items():
            if len(g) == 4:
                s, x, y, z = g
                for k, key in enumerate((s, s + z, s + y + z, g)):
                    self.n[k][key] += n
                self.n[2][s + y] += n  # contexts: what goes before a letter
                self.n[3][s + x + y] += n
        words = [sum(n for g, n in grams.items() if g[:1] == str(s) and g[1:3] == "^^") for s in range(5)]
        self.prior = [math.log((n + 1) / (sum(words) + 5)) for n in words]
        self.known: dict[str, float] = {}
        self.cache: dict[tuple[str, int], str] = {}

    def step(self, x: str, y: str, z: str, s: int) -> float:
        key = f"{s}{x}{y}{z}".lower()
        if (got := self.known.get(key)) is None:
            s_, x, y, z = key[0], key[1], key[2], key[3]
            share = lambda a, b: a / b if b else 0.0
            p = WEIGHTS[0] * share(self.n[3][key], self.n[3][s_ + x + y]) + WEIGHTS[1] * share(self.n[2][s_ + y + z], self.n[2][s_ + y]) + WEIGHTS[2] * share(self.n[1][s_ + z], self.n[0][s_])
            got = self.known[key] = math.log(p + (1 - sum(WEIGHTS)) / LETTERS)
        return got

    def read(self, w: str, main: int) -> str:
        """The best reading of the class sequence of a word in a text of script `main`; ties go to the earlier script."""
        shape = "".join(_CLASS.get(c, c) for c in w)
        if (got := self.cache.get((shape, main))) is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            got = self.cache[shape, main] = self.search(shape, main)
        return got

    def enter(self, s: int, main: int) -> float:
        """The price of a word in script s."""
        return 0.0 if s == main else self.prior[s] - (ABROAD if main >= 0 else 0.0)

    def search(self, shape: str, main: int) -> str:
        letters = [(i, c) for i, c in enumerate(shape) if not unicodedata.combining(c)]
        held = {script(c) for _, c in letters if c not in _MEMBERS}
        if len(held) == 1:
            s = held.pop()
            fit = [c if c not in _MEMBERS else next((m for m in _MEMBERS[c] if script(m) == s), None) for _, c in letters]
            best = fit if None not in fit else self.viterbi([c for _, c in letters], main)
        else:
            best = self.viterbi([c for _, c in letters], main)
        out = list(shape)
        for (i, _), m in zip(letters, best, strict=True):
            out[i] = m
        return "".join(out)

    def viterbi(self, classes: list[str], main: int) -> list[str]:
        paths: dict[tuple[str, str], tuple[float, list[str]]] = {("^", "^"): (0.0, [])}
        for k, c in enumerate(classes):
            now: dict[tuple[str, str], tuple[float, list[str]]] = {}
            for m in _MEMBERS.get(c, [c]):
                s = script(m)
                for (x, y), (score, path) in paths.items():
                    if k == 0:
                        v = score + self.enter(s, main) + self.step("^", "^", m, s)
                    elif script(y) == s:
                        v = score + self.step(x, y, m, s)
                    else:
                        v = score - SWITCH + self.step("^", "^", m, s)
                    key = (y if k and script(y) == s else "^", m)
                    if key not in now or v > now[key][0]:
                        now[key] = (v, [*path, m])
            paths = now
        end = max(paths.items(), key=lambda p: (p[1][0] + self.step(*p[0], "$", script(p[0][1])), -script(p[0][1])))
        return end[1][1]

    def common(self, text: str) -> str:
        """The common form of a text. In a Latin text, words of ASCII letters of which one is plain are read as they are and need no look."""
        t = seen(text)
        main = main_script(t)
        return unicodedata.normalize("NFC", (_UNSURE if main == 0 else _LETTERS).sub(lambda m: self.read(m[0], main), t))


def trigrams(docs: DataFrame) -> dict[str, int]:
    """Counts over all documents; at most the cube of the alphabets in number."""
    got = docs.select("text").mapInPandas(count_trigrams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in got.collect()}


def common_forms(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, raw, form[, common]) of documents (doc_id, text): 128-bit hashes of the stored text and of its common form."""
    docs = fan_out(docs.select("doc_id", "text").where("text is not null"))
    grams = trigrams(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller = Speller(grams)
        for b in batches:
            if not len(b):
                continue
            forms = [speller.common(t) for t in b["text"]]
            out = pd.DataFrame({"doc_id": b["doc_id"], "raw": [xxhash.xxh3_128_hexdigest(t) for t in b["text"]], "form": [xxhash.xxh3_128_hexdigest(t) for t in forms]})
            if keep_text:
                out["common"] = forms
            yield out

    return docs.mapInPandas(run, "doc_id bigint, raw string, form string" + (", common string" if keep_text else ""))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that differ as stored and have one common form."""
    rows = cut(common_forms(table(spark, sf_dir, "documents")))
    kinds = rows.select("form", "raw").distinct()
    several = cut(kinds.join(kinds.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form"), "form"))
    x, y = several.select("form", F.col("raw").alias("x")), several.select("form", F.col("raw").alias("y"))
    pairs = x.join(y, "form").where("x < y").select("x", "y")
    member = rows.join(several.select("raw").distinct(), "raw", "left_semi").select("raw", "doc_id")
    a, b = member.select(F.col("raw").alias("x"), F.col("doc_id").alias("a")), member.select(F.col("raw").alias("y"), F.col("doc_id").alias("b"))
    return pairs.join(a, "x").join(b, "y").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: whether its text is in common form already, its class (the lowest doc_id that looks the same) and the class's size."""
    rows = cut(common_forms(table(spark, sf_dir, "documents")))
    size = rows.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_alike"), F.countDistinct("raw").alias("n_spellings"))
    return rows.join(size, "form").select("doc_id", (F.col("raw") == F.col("form")).alias("is_common"), "class_id", "n_alike", "n_spellings")
