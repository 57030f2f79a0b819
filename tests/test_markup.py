"""The markup patterns of DataFrame expressions against the table function's, on awkward lines and very long ones."""

import pytest
from pyspark.sql import functions as F

from vellum.functions.table_functions import segments
from vellum.plans.texts import BETWEEN, BOLD, BULLET, CITE

LINES = (
    "plain", "**a**", "***a**", "**a***", "****", "**a*b**", "[[co-1]]", "[[[co-1]]]", "[[co-x]] and [[co-12]]**b**", "** open", "a ** b ** c", "[ [[co-3]", " - see **x**", "-x", "• [[co-1]]", "\t* \t**b**",
    "* " * 30_000, "[[" * 30_000 + "co-1]]", "**b**" * 20_000, "x" * 300_000,
)


@pytest.mark.parametrize("at", range(len(LINES)))
def test_patterns_cut_lines_as_the_table_function_does(spark, at):
    raw = LINES[at].rstrip(" \t")
    body = F.regexp_replace("raw", BULLET, "")
    got = spark.createDataFrame([(raw,)], "raw string").select(F.col("raw").rlike(BULLET), F.regexp_extract_all(body, F.lit(f"{CITE}|{BOLD}|{BETWEEN}"), 0)).first()
    marks = {"text": "{}", "bold": "**{}**", "cite": "[[{}]]"}
    want = list(segments(raw))
    assert list(got[1]) == [marks[kind].format(text) for _, _, _, kind, text in want]
    assert {got[0]} == {bullet for _, _, bullet, _, _ in want}
