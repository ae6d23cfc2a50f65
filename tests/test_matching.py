"""The cascade of coordinate matchers, and names."""

import pytest

from pyspark.sql import functions as F

from tramline.functions import names
from tramline.operators import matching


def test_cascade(spark):
    points = spark.createDataFrame([("p1", "CZ", "11111", "Brno hl.n."), ("p2", "DE", "22222", "X"), ("p3", "CZ", "33333", "Aliased"), ("p4", "CZ", "44444", "Žďár"), ("p5", "CZ", "55555", "Plzeň (odb.)"), ("p6", "DE", "6", "Bad Schandau Ost"), ("p7", "DE", "7", "Görlitzz"), ("p8", "PL", "8", "Nowhere")], "point_id string, country string, code string, name string")
    authority = spark.createDataFrame([("11111", 16.6, 49.1)], "code string, longitude double, latitude double")
    objects = spark.createDataFrame(
        [("o1", "DE22222", "Other", 1.0, 1.0), ("o3", None, "Something", 3.0, 3.0), ("o4", None, "ZDAR", 4.0, 4.0), ("o5", None, "Plzeň", 5.0, 5.0), ("o6", None, "Bad Schandau", 6.0, 6.0), ("o7", None, "Görlitz", 7.0, 7.0), ("o9", "CZ11111", "Brno hl.n.", 9.0, 9.0)],
        "object_id string, reference string, name string, longitude double, latitude double",
    )
    aliases = spark.createDataFrame([("p3", "o3")], "point_id string, object_id string")
    found = matching.candidates(points, authority, objects, aliases)
    got = {r.point_id: (r.object_id, r.method) for r in matching.matched(points, found).collect()}
    assert got == {"p1": ("authority", "authority"), "p2": ("o1", "exact_code"), "p3": ("o3", "alias"), "p4": ("o4", "exact_name"), "p5": ("o5", "cleaned_name"), "p6": (None, None), "p7": ("o7", "fuzzy_name"), "p8": (None, None)}
    vetoed = spark.createDataFrame([("p1", "authority"), ("p4", "o4")], "point_id string, object_id string")
    after = {r.point_id: r.object_id for r in matching.matched(points, found, vetoed).collect()}
    assert after["p1"] == "authority" and after["p4"] is None


def test_names(spark):
    df = spark.createDataFrame([("Ústí n. L. (západ)",), ("Straße",)], "n string").select(names.normal(F.col("n")).alias("a"), names.cleaned(F.col("n")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [("usti n l zapad", "usti n l"), ("strasse", "strasse")]
    c = spark.createDataFrame([("RJ",), ("?",)], "c string").select(names.colour(F.col("c")).alias("x")).collect()
    assert [r.x for r in c] == ["b91c1c", "475569"]


def test_fuzzy_names_miss_no_pair(spark):
    import random

    from tramline.operators.matching import fuzzy_pairs

    def edited(name, n):
        for _ in range(n):
            k = rng.randrange(len(name))
            name = rng.choice([name[:k] + "x" + name[k:], name[:k] + name[k + 1 :], name[:k] + "y" + name[k + 1 :]])
        return name

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(5)
    names = ["".join(rng.choices("abcd", k=rng.randint(4, 14))) for _ in range(60)]
    asked = [edited(rng.choice(names), rng.randint(0, 3)) for _ in range(80)]
    p = spark.createDataFrame(list(enumerate(asked)), "point_id int, _p string").filter("length(_p) > 2")
    o = spark.createDataFrame(list(enumerate(names)), "object_id int, _o string")
    got = {(r.point_id, r.object_id) for r in fuzzy_pairs(p, o).collect()}
    assert got == {(i, j) for i, a in enumerate(asked) if len(a) > 2 for j, b in enumerate(names) if distance(a, b) <= 2}


def test_estimates(spark):
    from tramline.operators.matching import estimates, with_estimates

    known = [("a", 10.0, 50.0), ("b", 12.0, 52.0), ("c", 10.0, 50.1)]
    calls = [("t", 1, "a", 0, 5), ("t", 2, "x", 25, 5), ("t", 3, "b", 100, 5), ("u", 1, "a", 0, 1), ("u", 2, "x", 50, 1), ("u", 3, "c", 100, 1), ("v", 1, "b", 0, 9), ("v", 2, "y", 60, 9), ("v", 3, "z", None, 9), ("w", 1, "q", 5, 1)]
    c = spark.createDataFrame(calls, "trip_id string, sequence int, point_id string, seconds int, days int")
    got = {r.point_id: (round(r.longitude, 6), round(r.latitude, 6), r.two_sided) for r in estimates(c, spark.createDataFrame(known, "point_id string, longitude double, latitude double")).collect()}
    assert got == {"x": (10.0, 50.05, True), "y": (12.0, round(52 + 0.3 / 111.195, 6), False)}
    found = spark.createDataFrame([("a", "o", 10.0, 50.0, "alias"), ("b", "o", 12.0, 52.0, "alias"), ("c", "o", 10.0, 50.1, "alias"), ("x", None, None, None, None), ("q", None, None, None, None)], "point_id string, object_id string, longitude double, latitude double, method string")
    methods = {r.point_id: (r.method, r.latitude) for r in with_estimates(found, c).collect()}
    assert methods["x"] == ("estimate", pytest.approx(50.05)) and methods["a"][0] == "alias" and methods["q"] == (None, None)
