"""The e-mail scan writes only values as JSON that can match, and finds what a scan of all JSON texts finds."""

from pyspark.sql import functions as F

from promolift.operators import privacy as PV
from promolift.schemas import EMAIL_PATTERN

SCHEMA = """s string, l array<string>, d array<struct<n: string, x: double, m: map<string, array<string>>>>,
            m map<string, int>, v map<int, string>, o struct<`a@b.co`: int, t: timestamp_ntz>, n array<int>, i int"""
MAIL = "a.b@c.org"
ROWS = [
    (MAIL, [None, MAIL], [None, (None, 1.0, {"x": ["-", MAIL]})], {MAIL: 1}, {1: MAIL}, (1, None), [1], 1),
    ("no mail", ["no", "mail"], [("x@y", 1.0, {MAIL: None})], {"x": 1}, {1: "@"}, (None, None), [], 2),
    ("x@y", [], [(MAIL, None, None)], {}, {1: None}, None, None, None),
    (None, None, None, None, None, None, None, None),
    ("\n@c.org", ["\n@c.org"], [('"@c.org', float("nan"), {}), ("\n@c.org", float("inf"), None)], {"\t@c.org": 1}, {1: "\n@c.org"}, (1, None), [None], 0),
]


def by_json(df, pattern):
    """Values and matches of each column by its whole text."""
    out = set()
    for f in df.schema.fields:
        if f.name != "i":
            text = F.col(f.name) if f.name == "s" else F.to_json(F.col(f.name))
            out.add((f.name, *df.agg(F.count(text), F.count(F.when(text.rlike(pattern), 1))).first()))
    return out


def test_scan_finds_what_the_json_texts_hold(spark):
    df = spark.createDataFrame(ROWS * 3, SCHEMA)
    for pattern in (EMAIL_PATTERN, "a|x", "@"):
        found = {(r.column, r.n_values, r.n_matches) for r in PV.pii_value_scan(df, "t", pattern).collect()}
        assert found == by_json(df, pattern), pattern
    assert ("l", 12, 6) in found and ("n", 9, 0) in found


def test_values_without_the_character_are_not_written_as_json(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).select("s", "l", "d")
    plan = PV.pii_value_scan(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    counts = plan[plan.index("Aggregate [count"):].split("AS v")
    assert len(counts) == 4 and "StructsToJson" not in counts[0] + counts[1].split("AS m0")[1]   # values are counted as they are
    for part in plan.split("RLIKE(")[:-1]:
        assert "Contains(" in part   # the pattern is tried behind a cheap test only
