"""Counts of large means, against the distribution by logarithms and against the SQL."""

import hashlib
import math
from statistics import mean, variance

import duckdb
import pytest

from tidemark.llm import mixing


def drawn(seed, doc_id, text, rate):
    """The least k with P(X <= k) beyond the document's uniform number."""
    ident = f"{seed}:{doc_id}:{hashlib.md5(text.encode()).hexdigest()}"
    u, k, total = int(hashlib.md5(ident.encode()).hexdigest()[:13], 16) / 2**52, -1, 0.0
    while total <= u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_a_rate_over_1000_is_poisson(spark):
    docs = spark.createDataFrame([(i, "x", "small") for i in range(300)] + [(1000, "y" * 900_000, "large")], "doc_id long, text string, source string")
    weights = {"small": 0.5, "large": 0.5}
    [rate] = [r.rate for r in mixing.source_rates(docs, weights=weights).collect() if r.source == "small"]
    assert rate > 1000
    got = dict(mixing.mix(docs, weights=weights).filter("source = 'small'").groupBy("doc_id").count().collect())
    assert all(abs(got[i] - drawn(7, i, "x", rate)) <= 1e-9 * rate for i in range(300))
    assert abs(mean(got.values()) / rate - 1) < 0.02 and 0.7 < variance(got.values()) / rate < 1.4


@pytest.mark.parametrize("chars", [1_000_000, 9_000_000])
def test_large_rates_equal_the_sql(spark, chars):
    rows = [(i, "x", "small") for i in range(4)] + [(9, "y" * chars, "large")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).filter("source = 'small'").select("doc_id", "repetitions", "copy", "mix_order")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.execute(mixing.mix_sql(columns="doc_id, repetitions, copy, mix_order") + " WHERE source = 'small'").fetchall()
    assert len(want) > 1500 and sorted(map(tuple, got.collect())) == sorted(want)
