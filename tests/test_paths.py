import pytest

from echofold.functions import paths
from pyspark.sql import functions as F

# path: parent, ancestors, leaf
CASES = {
    "C:\\a\\b\\f.txt": ("C:\\a\\b", ["C:\\", "C:\\a", "C:\\a\\b"], "f.txt"),
    "C:\\f.txt": ("C:\\", ["C:\\"], "f.txt"),
    "C:\\": (None, [], "C:\\"),
    "\\\\srv\\share\\x\\f": ("\\\\srv\\share\\x", ["\\\\srv\\share", "\\\\srv\\share\\x"], "f"),
    "\\\\srv\\share\\f": ("\\\\srv\\share", ["\\\\srv\\share"], "f"),
    "\\\\srv\\share": (None, [], "share"),
    "s3://b/a/f": ("s3://b/a", ["s3://b/", "s3://b/a"], "f"),
    "s3://b/f": ("s3://b/", ["s3://b/"], "f"),
    "s3://b/": (None, [], "s3://b/"),
    "s3://b/a//c/f": ("s3://b/a//c", ["s3://b/", "s3://b/a", "s3://b/a//c"], "f"),
    "s3://b/a\\q/f": ("s3://b/a\\q", ["s3://b/", "s3://b/a\\q"], "f"),
    "file:/x/y": ("file:/x", ["file:/", "file:/x"], "y"),
    "file:///x/y": ("file:///x", ["file:///", "file:///x"], "y"),
    "/a/f": ("/a", ["/", "/a"], "f"),
    "/": (None, [], "/"),
    "/a/naïve name/ü.txt": ("/a/naïve name", ["/", "/a", "/a/naïve name"], "ü.txt"),
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(p,) for p in [*CASES, None]], "path string")


def test_parents_ancestors_and_leaves(table):
    rows = table.select(
        "path", paths.parent_path("path").alias("parent"), paths.ancestors("path").alias("above"),
        paths.leaf_name("path").alias("leaf"),
    ).collect()
    assert {r.path: (r.parent, r.above, r.leaf) for r in rows} == {**CASES, None: (None, [], None)}


def test_following_parents_gives_the_ancestors(spark, table):
    """Climbing one parent at a time reaches exactly the listed ancestors."""
    paths.register_sql_functions(spark)
    climbed = {path: [] for path in CASES}
    at = {path: path for path in CASES}
    while at:
        rows = spark.createDataFrame(list(at.items()), "path string, at string")
        up = {r.path: r.up for r in rows.selectExpr("path", "parent_path(at) as up").collect() if r.up}
        for path, folder in up.items():
            climbed[path].insert(0, folder)
        at = up
    assert climbed == {path: above for path, (_, above, _) in CASES.items()}


def test_exploding_matches_the_array(table):
    folders = table.filter("path is not null")
    exploded = paths.with_ancestors(folders, "path", "folder").groupBy("path").agg(
        F.array_sort(F.collect_list("folder")).alias("folders")
    )
    expected = folders.select("path", F.array_sort(paths.ancestors_or_self("path")).alias("folders"))
    assert sorted(map(tuple, exploded.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize(
    ("raw", "canonical"),
    [("c", "C:\\"), ("C:", "C:\\"), ("C:\\", "C:\\"), ("c:/", "C:\\"), (" d ", "D:\\"),
     ("\\\\srv\\share", "\\\\srv\\share\\"), ("\\\\srv\\share\\", "\\\\srv\\share\\"),
     ("/mnt", "/mnt/"), ("s3://b", "s3://b/"), ("s3://b/", "s3://b/")],
)
def test_normalize_drive(spark, raw, canonical):
    frame = spark.createDataFrame([(raw,)], "raw string")
    assert frame.select(paths.normalize_drive("raw")).first()[0] == canonical
