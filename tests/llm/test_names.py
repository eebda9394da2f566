"""Names: the segment join against all pairs, and linking on hand-made names."""

import random

import pytest
from pyspark.sql import functions as F

from sievelark.llm import names as N


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("hot", [2000, 3])
def test_segment_join_finds_all_pairs(spark, hot):
    rng = random.Random(1)
    words = set()
    for _ in range(60):
        w = "".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 12)))
        words.add(w)
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randrange(1, 4)):
                p = rng.randrange(len(x))
                x[p : p + rng.randrange(2)] = rng.choice(["", "a", "bc"])
            words.add("".join(x))
    words = {w for w in words if len(w) > N.K}
    rows = [(b, w) for b in ("x", "y") for w in words] + [("x", w) for w in list(words)[:5]]
    got = {(r.block, r.a, r.b) for r in N.segment_join(spark.createDataFrame(rows, "block string, s string"), hot).collect()}
    want = {(k, a, b) for k in ("x", "y") for a in words for b in words if a < b and levenshtein(a, b) <= N.K}
    assert got == want


def test_osa():
    assert N.osa("abcd", "abdc", 1) == 1 and N.osa("abcd", "abcd", 1) == 0 and N.osa("abcd", "badc", 2) == 2 and N.osa("a", "abcd", 2) == 3
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(2))
        d = levenshtein(a, b)
        assert N.osa(a, b, 3) <= min(d, 4) and (d <= 1 or N.osa(a, b, 3) >= 1)


GROUPS = [
    ["Abigail Zumberdotal", "Zumberdotal, Abigail", "Zumberdotal Abigail", "A. Zumberdotal", "A Zumberdotal", "abigail zumberdotal", "ABIGAIL ZUMBERDOTAL", "Abby Zumberdotal", "Dr. Abigail Zumberdotal", "Abigail Zumberdotal, PhD", "abigail.zumberdotal", "Abigial Zumberdotal", "Abigail Zumbedrotal", "Abigail  M. Zumberdotal"],
    ["Karl Pimadabosk", "Pimadabosk, Karl"],
    ["Karla Pimadabosk", "KARLA PIMADABOSK"],
    ["Jürgen Vögelmastin", "Jurgen Vogelmastin", "J. Voegelmastin"],
    ["Min-Jun Tobakelis", "Min Jun Tobakelis", "Tobakelis, Min-Jun"],
    ["Gretodurt Robotics Team", "The Gretodurt Robotics Team", "GRETODURT ROBOTICS TEAM", "Gretodurt Robotics"],
    ["Vavadid Robotics Group", "Group of Vavadid Robotics", "Vavadid Robotics Grp."],
]
ALONE = ["admin", "Guest", "Editorial Team", "Plato", "  "]


def test_links(spark):
    filler = [f"{g} Surn{a}{b}el" for g in ("Karl", "Karla", "Jürgen", "Min-Jun") for a in "abcde" for b in "uvwxy"]
    filler += [f"{x} Robotics {o}" for x, o in (("Aaaakos", "Lab"), ("Bbbbkos", "Institute"), ("Cccckos", "Group"))]
    names = [n for g in GROUPS for n in g] + ALONE + filler
    got = {r["name"]: r["entity"] for r in N.link_names(spark.createDataFrame([(n,) for n in names if n.strip()], "name string")).collect()}
    for g in GROUPS:
        assert len({got[n] for n in g}) == 1, {n: got[n] for n in g}
    assert len({got[g[0]] for g in GROUPS}) == len(GROUPS)
    assert "admin" not in got and "Guest" not in got and "Editorial Team" not in got
    assert sum(v == got["Plato"] for v in got.values()) == 1


def spelled(given, surname):
    full = f"{given} {surname}"
    return [full, f"{surname}, {given}", full.lower(), full.upper(), f"Dr. {full}", f"{full}, PhD", f"{surname} {given}", f"Prof. {full}", f"{given} M. {surname}", f"{given.lower()}.{surname.lower()}"]


def test_slip_in_several_spellings(spark):
    right, slip, two = spelled("Abigail", "Zumberdotal"), spelled("Abigail", "Zumbedrotal")[:4], spelled("Abigail", "Zumbexdotax")[:2]
    other = spelled("Abigail", "Numberdotal")[:5]
    saturated = [spelled("Barbara", "Gelmarostin"), spelled("Barbara", "Gelmraostin"), spelled("Barbara", "Gelmarostix")]
    opens = [f"T. {x}" for x in ("Kavolimert",)] + ["T Kavolimetr", "Kavolimetr, T.", "t. kavolimetr"]
    theodor = spelled("Theodore", "Kavolimert")
    rows = [(n, 1) for n in right + slip + two + other + opens + theodor] + [(n, 900) for n in saturated[0]] + [(n, 9) for n in saturated[1]] + [(n, 500) for n in saturated[2]]
    got = {r["name"]: r["entity"] for r in N.link_names(spark.createDataFrame(rows, "name string, n_rows bigint")).collect()}
    of = lambda names: {got[n] for n in names}
    assert len(of(right + slip + two)) == 1 and len(of(opens + theodor)) == 1
    assert len(of(other)) == 1 and of(other) != of(right)
    assert len(of(saturated[0] + saturated[1])) == 1 and of(saturated[2]) != of(saturated[0])


def test_given_names_that_no_vocabulary_knows(spark):
    """Slips in rare given names are linked beside one surname; endings and established names are not."""
    same = [("Xaviera Delacroixe", "Xavierra Delacroixe"), ("Qwertyu Smithsonel", "Qwertzu Smithsonel"), ("Madonna", "Madonnas")]
    apart = [("Marisol Tobakuvel", "Marisola Tobakuvel"), ("Xaviera Bokuvel", "Xavierra Tomadel"), ("Zanto Gebuvel", "Zanta Gebuvel")]
    got = {r["name"]: r["entity"] for r in N.link_names(spark.createDataFrame([(n,) for p in same + apart for n in p], "name string")).collect()}
    assert all(got[a] == got[b] for a, b in same) and all(got[a] != got[b] for a, b in apart)
    assert not N.other_ending("rene", "renee") and N.other_ending("maria", "mario") and N.other_ending("paula", "paul") and not N.other_ending("carl", "karl")


def test_nothing(spark):
    assert N.link_names(spark.createDataFrame([], "name string")).count() == 0


def test_found_handles_nulls_repeats_and_extra_columns(spark, tmp_path):
    a = "array<struct<name:string,affiliation:string>>"
    spark.createDataFrame([([("Ann Bellwether", None), ("Ann Bellwether", "x"), (None, None)], "n"), (None, "n"), ([], "n"), ([("x" * 5000 + " " + "y" * 5000, None)], "n")], f"authors {a}, name string").write.parquet(str(tmp_path / "papers.parquet"))
    spark.createDataFrame([("Bellwether, Ann", "e"), (None, "e"), ("admin", "e"), ("Administrator", "e")], "author string, entity string").write.parquet(str(tmp_path / "blog_posts.parquet"))
    assert [tuple(r) for r in N.p1_found(spark, str(tmp_path)).collect()] == [("Ann Bellwether", "Bellwether, Ann")]
    assert N.p1_entities(spark, str(tmp_path)).where(F.col("n_spellings") == 2).count() == 2
