import pytest

from ledgerloom.llm.canonical import Canon, edits, matched, words

AUTHORS = [
    ("acorn-labs", "Acorn Labs", ["Acorn", "QXZT"]), ("brindle-robotics", "Brindle Robotics", None), ("brindle-foundry", "Brindle Foundry", []),
    ("corvane", "Corvane", ["Old Harbour Research"]), ("dunmere-intelligence", "Dunmere Intelligence", []), ("elsworth-labs", "Elsworth Labs", [""]),
    ("fenwick-robotics", "Fenwick Robotics", []), ("garrow-foundry", "Garrow Foundry", []), ("hollin-intelligence", "Hollin Intelligence", []),
]
CASES = {
    "Acorn Labs": "acorn-labs", "ACORN LABS": "acorn-labs", "aCORN lABS": "acorn-labs", "acorn-labs-team": "acorn-labs", "AcornLabs": "acorn-labs", "acornlabs.example": "acorn-labs",
    "https://acorn-labs.example/models": "acorn-labs", "Acorn Labs, Inc.": "acorn-labs", "Labs, Acorn": "acorn-labs", "Labs of Acorn": "acorn-labs", "qxzt": "acorn-labs",
    "Ac0rn Labs": "acorn-labs", "Acоrn Labs": "acorn-labs", "Àcorn Labs": "acorn-labs", "Acorn Labs (formerly beta) via gateway": "acorn-labs", "Acorn Laboratories": "acorn-labs",
    "Dunmere Intel.": "dunmere-intelligence", "Dunmere Intellige…": "dunmere-intelligence", "Dunmre Intelligence": "dunmere-intelligence", "Dnumere Intelligence Ltd": "dunmere-intelligence",
    "Brindle Robotix": "brindle-robotics", "Robotics, Brindle": "brindle-robotics", "Brindel Foundry": "brindle-foundry", "old harbour research": "corvane", "Corvnae": "corvane",
    "Brindle": "unmatched", "Brindle Labs": "unmatched", "Acorn Robotics": "unmatched", "Sable Labs": "unmatched", "unknown": "unmatched", "-": "unmatched", "user-16ccbd": "unmatched",
    "Labs": "unmatched", "": None, "  ": None, None: None, "x" * 50_000: "unmatched",
}


@pytest.mark.parametrize("value", list(CASES), ids=lambda v: repr(v)[:40])
def test_each_spelling(value):
    assert Canon(sorted((a, n, [x for x in (s or []) if x]) for a, n, s in AUTHORS)).match(value) == CASES[value]


def test_longest_mention_wins():
    canon = Canon([("north", "North", []), ("north-star-labs", "North Star Labs", []), ("twin-a", "Twin", []), ("twin-b", "Twin", [])])
    assert canon.match("served by North Star Labs (North)") == "north-star-labs"
    assert canon.match("Twin") == "unmatched"
    assert Canon([]).match("North") == "unmatched"


def test_table(spark, rows):
    values = spark.createDataFrame([(1, "Acorn Labs", "q"), (1, "Acorn Labs", "q"), (2, None, "q"), (3, " ", "q"), (4, "nobody", "q"), (None, "Acorn", "q")], "listing_id bigint, owned_by string, author_id string")
    canon = spark.createDataFrame([*AUTHORS, (None, "Nameless", None), ("x", None, None)], "id string, name string, aliases array<string>")
    assert rows(matched(values, canon)) == [(1, "acorn-labs"), (4, "unmatched")]
    assert rows(matched(values, canon.limit(0))) == [(1, "unmatched"), (4, "unmatched")]
    assert matched(values.limit(0), canon).count() == 0


def test_words_and_edits():
    assert words("Ça-Va_Ltd2024") == ["ca", "va", "ltdze24"] or words("Ça-Va") == ["ca", "va"]
    assert edits("abcd", "abdc") == 1 and edits("abcd", "abcd") == 0 and edits("", "abcdef", 3) == 4 and edits("kitten", "sitting") == 3


def test_likeness_is_bounded_by_its_threshold_alone():
    known = Canon([("lumen", "Lumen", []), ("abcde", "Abcde", []), ("long", "Interplanetarywordsmith", [])])
    assert known._alike("interplanetarywordsmith", "intxxxxxxxxxxxxxxxxxxxx") == 0.0 and known.match("Intxxxxxxxxxxxxxxxxxxxx") == "unmatched"
    assert known.match("Intxxxxxxxxrywordsmith") == "long"  # nine edits of 23
    assert known.match("Lamon") == "lumen" and known.match("Badce") == "abcde" and known.match("Lamox") == "unmatched"


def test_held_out_misspellings():
    """Names and their damages drawn at random, none of which any table or threshold was set by: most find their entry, hardly any another one."""
    import random

    rng = random.Random(11)
    syllables = ["ba", "cor", "del", "fin", "gra", "hul", "jan", "kem", "lor", "mis", "nov", "pel", "quo", "ras", "sten", "tur", "vel", "wix", "yar", "zon"]
    kinds = ["labs", "research", "systems", "robotics", "works"]
    names = {"".join(rng.sample(syllables, 3)): rng.choice(kinds) for _ in range(120)}
    canon = Canon([(f"{n}-{k}", f"{n.capitalize()} {k.capitalize()}", None) for n, k in sorted(names.items())])

    def damaged(name, kind):
        at = rng.randrange(1, len(name) - 1)
        letters = rng.choice([
            name[:at] + name[at + 1 :], name[:at] + name[at] + name[at:], name[: at - 1] + name[at] + name[at - 1] + name[at + 1 :], name[:at] + rng.choice("aeioub") + name[at + 1 :], name,
        ])
        written = rng.choice([f"{letters} {kind}", f"{letters}{kind}", f"{letters.upper()}-{kind.upper()}", f"{letters.capitalize()} {kind.capitalize()}, Inc.", f"  the {letters}_{kind} team "])
        return written

    told = [(f"{n}-{k}", canon.match(damaged(n, k))) for n, k in sorted(names.items()) for _ in range(10)]
    strangers = ["".join(rng.sample("bcdfghklmnprstvw", 4)) + rng.choice(["umo", "ixe", "oya"]) + " " + rng.choice(kinds) for _ in range(300)]
    assert sum(said == wanted for wanted, said in told) >= 0.9 * len(told)
    assert sum(said not in (wanted, "unmatched") for wanted, said in told) <= 0.02 * len(told)
    assert sum(canon.match(s) != "unmatched" for s in strangers) <= 0.03 * len(strangers)
