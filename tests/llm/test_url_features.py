"""Lexical features of URLs see the whole URL."""

from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from tablekeel.llm import url_filter


def test_features_see_what_comes_late_in_a_url(spark):
    paths = ["", "/", "/a/b", "/a.b$1\\", "/é日本𝒳𝒳", "/" + "y" * 300, "/" + "y" * 300 + "abcdefghij" * 30, "/" + "y" * 100_000, "/a-segment-of-more-than-16/x", "/another-segment-as-long/x"]
    rows = spark.createDataFrame([(f"http://a.com{p}", "a.com", p) for p in paths], "url string, host string, path string")
    got = {r["path"]: r for r in url_filter.lexical(rows).collect()}
    for p in paths:
        want = -sum(n / len(p) * log2(n / len(p)) for n in Counter(p).values()) if p else 0.0
        assert got[p]["path_entropy"] == pytest.approx(want, abs=0.0501)
        assert got[p]["chars"] == len(f"http://a.com{p}")
        assert got[p]["first_segment"] == (p.split("/")[1] if p else "")
