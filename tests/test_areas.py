"""The bridge between two geographies and its matrix on small fixtures."""

from caselake.operators import geo
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bridge(spark):
    """Suffixes go, successors take over, direct pairs are added, blanks, other statuses and repeats are left out."""
    said = [(" A ", "Old LPA", "matched"), ("a", "old", "joint"), ("b", "New", "unmatched"), ("c", " LPA", "matched"), ("f", " ", "matched"), (None, "x", "matched"), ("", "x", "matched"), ("d", None, "matched")]
    df = spark.createDataFrame(said, "name string, area string, status string")
    got = geo.area_bridge(df, "name", "area", "status", ["matched", "joint"], F.lower, " LPA", {"old": "new"}, {"e": "east"})
    assert rows(got) == [("a", "new"), ("c", "lpa"), ("e", "east")]  # trimmed first: a bare "LPA" is a name


def test_matrix(spark):
    """Joint counts are split by external totals, equally without any, half to even; names that are areas map to themselves."""
    own = spark.createDataFrame([("joint", 2000, 5), ("none", 2000, 5), ("p", 2001, 4), ("lost", 2000, 3), ("p", 1990, 9)], "authority string, year int, n long")
    bridge = spark.createDataFrame([("joint", "x"), ("joint", "y"), ("none", "u"), ("none", "v")], "authority string, area string")
    ext = spark.createDataFrame([("x", 2000, 3), ("y", 2001, 1), ("p", 2001, 8), ("z", 2000, 2), ("late", 2009, 7)], "area string, year int, n long")
    got = {r["area"]: r for r in geo.area_matrix(own, bridge, ext, [2000, 2001], (2000, 2001)).collect()}
    assert {a: r["match"] for a, r in got.items()} == {"x": "matched", "y": "matched", "p": "matched", "u": "left_only", "v": "left_only", "z": "right_only", "lost": "unmapped"}
    assert (got["x"]["own_2000"], got["y"]["own_2000"], got["u"]["own_2000"]) == (4, 1, 2)
    assert (got["x"]["joint"], got["p"]["joint"], got["p"]["authorities"], got["z"]["n_authorities"]) == (True, False, "p", 0)
    assert (got["p"]["own_2001"], got["p"]["pct"], got["u"]["pct"], got["z"]["pct"]) == (4, 50.0, None, 0.0)
    assert geo.area_matrix(own.limit(0), bridge, ext.limit(0), [2000], (2000, 2000)).count() == 0
