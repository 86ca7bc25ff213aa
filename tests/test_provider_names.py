"""The provider's name is told by a column for tables and by a function for the registry; both follow one rule."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from evalframe.functions import text
from evalframe.plans import fixtures
from evalframe.sources import registry, star

URLS = [
    "https://api.some-host.com/v1", "http://localhost:8000/v1", "http://127.0.0.1", "https://www.example.org", "https://example.co.uk/x?y#z",
    "HTTPS://API.Example.AI:443/v1/", "https://eu.api.example.net", "https://user@host.example.io/v1",
]


def names(df):
    return {r.url: r.provider for r in df.select("url", text.provider_of(F.col("url")).alias("provider")).collect()}


def test_fixed_urls(spark):
    urls = URLS + [url for url, _ in fixtures.ENDPOINTS]
    assert names(spark.createDataFrame([(u,) for u in urls], "url string")) == {u: registry.provider_name(u) for u in urls}


def test_a_whole_table(spark):
    told = names(star.table(spark, entry.SMOKE, "pages").where("url is not null"))
    assert told == {u: registry.provider_name(u) for u in told}
