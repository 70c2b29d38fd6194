"""URLs that hold any byte."""

import pytest
from pyspark.sql import functions as F

from matchframe.llm import url_rules


@pytest.mark.parametrize("code", [0, 1, 2, 3, 10, 127, 200, 255, 256, 257, 0x1F600])
def test_any_character_in_a_path(spark, code):
    """The end of a URL is no byte of it, so a rule fits whatever the rest of the path holds."""
    pages = spark.createDataFrame([(1, f"http://net/{chr(code)}x"), (2, f"http://spam{chr(code) if code > 32 else ''}.com/{chr(code)}"), (3, f"http://a.org/x{chr(code)}y")], "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(pages).collect()}
    assert (got[1].rule, got[1].verdict) == ("net/", "block")
    assert (got[2].rule, got[2].verdict) == (None, "block") and (got[3].rule, got[3].verdict) == (None, "allow")


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://net/a", "h", "p", "r")], "page_id long, url string, host string, path string, rule string").withColumn("verdict", F.lit(3))
    (row,) = url_rules.judge(pages).collect()
    assert (row.host, row.path, row.rule, row.verdict) == ("net", "/a", "net/", "block")
