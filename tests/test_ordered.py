"""Ordered scans against plain Python, with a hot key cut into many buckets."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemlake.operators.ordered import by_range, ordered_scan, ranked_by_digest


def expected(rows):
    out, groups = {}, {}
    for k, i, v in sorted(rows):
        groups.setdefault(k, []).append((i, v))
    for k, items in groups.items():
        total, last = 0, None
        for p, (i, v) in enumerate(items):
            prior = last
            total, last = total + (v or 0), last if v is None else v
            nxt = next((w for _, w in items[p + 1:] if w is not None), None)
            out[k, i] = (p, total, last, prior, nxt)
    return out


def scan(spark, rows, chunk):
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    done = ordered_scan(df, ["k"], ["i"], buckets=[by_range("i", chunk)], position="p", running={"s": F.col("v")},
                        last={"l": F.col("v")}, prior={"b": F.col("v")}, following={"n": F.col("v")})
    return {(r.k, r.i): (r.p, r.s, r.l, r.b, r.n) for r in done.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 9))),
                min_size=1, max_size=40, unique_by=lambda r: r[:2]), st.sampled_from([1, 3, 7, 100]))
def test_scan_equals_plain_loop(spark, rows, chunk):
    assert scan(spark, rows, chunk) == expected(rows)


def test_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.choice([None, None, i % 9])) for i in range(3000)]
    rows += [(f"k{j}", i, i) for j in range(200) for i in range(5)]
    assert scan(spark, rows, 64) == expected(rows)


def test_ranking_by_digest_is_dense_and_independent_of_partitioning(spark):
    df = spark.range(2000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)))
    results = []
    for parts in (1, 7):
        r = ranked_by_digest(df.repartition(parts), ["k"], F.md5(F.col("id").cast("string")), "id", "pos")
        results.append({(x.k, x.id): x.pos for x in r.collect()})
    assert results[0] == results[1]
    hot = sorted(p for (k, _), p in results[0].items() if k == "hot")
    assert hot == list(range(len(hot)))
