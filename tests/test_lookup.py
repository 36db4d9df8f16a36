from pyspark.sql import functions as F

from ledgerloom.operators.lookup import alias_conflicts, alias_rows, alias_table, attributed, carried_reference, duplicate_keys, enriched_by_primary, linked_to_self, missing_from, resolve, routed, split_by_reference


def test_aliases(spark, rows):
    owners = spark.createDataFrame([("a", ["x", "b", ""]), ("b", ["x", "y", None]), ("c", None), (None, ["z"])], "id string, aliases array<string>")
    names = alias_rows(owners, "id", F.col("aliases"))
    table = alias_table(names)
    assert rows(table) == [("a", "a", 1), ("b", "b", 2), ("c", "c", 1), ("x", None, 2), ("y", "b", 1)]
    asked = spark.createDataFrame([(k,) for k in ("a", "b", "x", "y", "q", None)], "k string")
    assert rows(resolve(asked, "k", table)) == sorted([("a", "a", "found"), ("b", "b", "found"), ("x", None, "ambiguous"), ("y", "b", "found"), ("q", None, "missing"), (None, None, "missing")], key=repr)
    assert rows(alias_conflicts(names)) == [("b", ["a", "b"]), ("x", ["a", "b"])]
    assert rows(resolve(asked.limit(0), "k", table)) == []


def test_references(spark, rows):
    data = spark.createDataFrame([(1, "p"), (2, "old"), (3, None), (4, "q")], "k int, ref string")
    targets = spark.createDataFrame([("p",), ("r",), (None,)], "t string")
    good, bad = split_by_reference(data, "ref", targets, "t")
    assert rows(good) == [(1, "p")] and rows(bad) == [(2, "old"), (3, None), (4, "q")]
    baseline = spark.createDataFrame([(2, "r"), (3, "gone"), (4, None)], "k int, ref string")
    kept, review = carried_reference(data, ["k"], "ref", targets, "t", baseline)
    assert rows(kept) == [(1, "p"), (2, "r")] and rows(review) == [(3, None, "no reference"), (4, "q", "unknown reference")]


def test_duplicates_primary_and_volume(spark, rows):
    data = spark.createDataFrame([("g", "a", 2), ("g", "a", 1), ("g", "b", 3), ("h", "c", 4)], "g string, k string, n int")
    assert rows(duplicate_keys(data, ["g", "k"])) == [("g", "a", 2)]
    primary = spark.createDataFrame([("a",), ("a",)], "k string")
    assert rows(enriched_by_primary(data, primary, ["k"], [F.col("n")]).select("k", "n")) == [("a", 1)]
    assert rows(missing_from(data, data.where("k <> 'b'"), ["g", "k"], "g")) == [("g", 1, 2, True), ("h", 0, 1, False)]


def test_routes_and_attribution(spark, rows):
    targets = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "place int, k string")
    offers = spark.createDataFrame([("a", False), ("a", True), ("b", False)], "k string, ok boolean")
    assert rows(routed(targets, offers, ["k"], F.col("ok")).select("place", "reason")) == [(1, None), (2, "unavailable"), (3, "missing")]
    patterns = spark.createDataFrame([("org/Model", "exact"), ("ORG/other", "folded"), ("org/*", "glob"), ("org/m*", "longer"), (None, "x"), ("y", None)], "pattern string, owner string")
    values = spark.createDataFrame([(v,) for v in ("org/Model", "org/model", "org/other", "org/more", "org/x/y", "none", None)], "v string")
    assert rows(attributed(values, "v", patterns)) == sorted([("org/Model", "exact"), ("org/model", "exact"), ("org/other", "folded"), ("org/more", "longer"), ("org/x/y", None), ("none", None), (None, None)], key=repr)
    assert {r.owner for r in attributed(values, "v", patterns.limit(0)).collect()} == {None}


def test_lineage(spark, rows):
    data = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "nobody"), ("d", None)], "id string, parent string")
    table = alias_table(spark.createDataFrame([("A", "a", False)], "alias string, target string, direct boolean"))
    assert rows(linked_to_self(data, "id", "parent", table)) == sorted([("a", None, "self"), ("b", "a", "found"), ("c", None, "missing"), ("d", None, "none")], key=repr)


def test_many_globs(spark, rows):
    """Beyond a few, globs are joined by their literal ends; both ways give the same owners."""
    patterns = [(f"org{i}/m*", f"o{i}") for i in range(300)] + [("*-vision", "eye"), ("*x*", "any"), ("org7/m?", "short"), ("org7/m*", "alsoseven"), ("a.b(*", "odd"), ("ORG9/*", "nine"), ("org9/m1", "exact"), ("é*", "accent")]
    values = [f"org{i}/m1" for i in range(0, 300, 50)] + ["org7/m", "org7/mm", "org7/m/z", "big-vision", "axb", "a.b(c", "aab(c", "org9/q", "org9/m1", "Org9/M1", "éa", "", None, "nothing"] + ["org7/mm"] * 500
    known = spark.createDataFrame(patterns, "pattern string, owner string")
    asked = spark.createDataFrame([(v, "p") for v in values], "v string, pattern string")
    wide = rows(attributed(asked, "v", known))
    assert wide == rows(attributed(asked, "v", known, cases=1000)) and len(wide) == len(values)
    found = {v: o for v, _, o in wide}
    assert found["org7/mm"] == "alsoseven" and found["org7/m"] == "alsoseven" and found["a.b(c"] == "odd" and found["aab(c"] is None and found["org9/m1"] == found["Org9/M1"] == "exact"
    assert found["org7/m/z"] is None and found["big-vision"] == "eye" and found["axb"] == "any" and found["org9/q"] == "nine" and found["éa"] == "accent" and found[""] is None
