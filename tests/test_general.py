"""Orphan references and strongest partners against brute force, with nulls, ties, repeats and hot keys."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from phasewright.operators.references import orphan_references, segment_references
from phasewright.operators.skew import heavy_keys, strongest_partner

ENTRY = "entry_no long, u long, v long, w long, s string"


def best(rows):
    once = {r[:4] for r in rows if r[0] is not None} | {(("n", k), *r[1:4]) for k, r in enumerate(rows) if r[0] is None}
    total = defaultdict(int)
    for _, u, v, w in once:
        if None not in (u, v, w) and w > 0 and u != v:
            total[u, v] += w
    out = {}
    for (u, v), t in total.items():
        out[u] = min(out.get(u, (0, 0)), (-t, v))
    return {(u, v, -t) for u, (t, v) in out.items()}


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_strongest_partner(spark, support):
    random.seed(1)
    rows = [(k, random.choice([1, 1, 1, random.randint(1, 40)]), random.randint(1, 9), random.randint(-1, 5), "x") for k in range(600)]
    rows += rows[:50] + [(None, 7, 8, 3, "x"), (None, 7, 8, 3, "x"), (900, None, 1, 1, "x"), (901, 2, None, 1, "x"), (902, 2, 3, None, None)]
    got = strongest_partner(spark.createDataFrame(rows, ENTRY), support=support).collect()
    assert {tuple(r) for r in got} == best(rows)
    assert len(got) == len({r.u for r in got})


def test_a_heavy_pair(spark):
    rows = [(k if k % 2 else None, 1, 2, 1, "x") for k in range(3000)] + [(9000 + k, 1, 3, 2, "x") for k in range(10)] + [(9100 + k, k % 50 + 2, 1, 1, "x") for k in range(300)]
    assert {tuple(r) for r in strongest_partner(spark.createDataFrame(rows, ENTRY)).collect()} == best(rows)


def test_strongest_partner_empty(spark):
    assert strongest_partner(spark.createDataFrame([], ENTRY)).collect() == []


def test_heavy_keys_hold_every_frequent_key(spark):
    df = spark.createDataFrame([(1 if k % 3 else k,) for k in range(3000)], "k long")
    found = [r.k for r in heavy_keys(df, "k", 0.1).collect()]
    assert 1 in found and len(found) <= 40


T = datetime(2024, 3, 5)


def test_segment_references(spark):
    segs = [
        (1, 10, "a", T, None), (2, 11, "b", T, None), (3, 11, "b", T - timedelta(3), T), (4, 12, " c_ph0 ", T + timedelta(9), None), (4, 12, " c_ph0 ", T + timedelta(9), None),
        (5, None, None, T, None), (6, 13, "d", None, None), (7, 14, "e_ph1", T, None), (8, 15, "e", T, T - timedelta(1)),
    ]
    segments = spark.createDataFrame(segs, "line_no long, node_id long, name string, loaded_at timestamp_ntz, deleted_at timestamp_ntz").selectExpr("*", "1 AS key", "'x' AS tab")
    shared = spark.createDataFrame([(1, "s1"), (11, "b")], "node_id long, name string")
    links = spark.createDataFrame(
        [(1, 10, 11, T), (2, 12, 99, T), (3, None, 1, T), (4, 13, 12, T + timedelta(20)), (5, 12, 99, None), (5, 12, 99, None)], "link_no long, source_id long, target_id long, loaded_at timestamp_ntz"
    )
    uz = spark.createDataFrame(
        [(1, "a_ph1", T), (2, "\ts1 \r", T), (3, "c_ph0", T), (4, "c", T), (5, " ", T), (6, None, T), (7, "e_ph1", T), (8, "e_ph0", T), (9, "e_ph1_ph0", T), (10, "nope_ph0", None)],
        "seg_idx long, name string, built_at timestamp_ntz",
    )
    got = Counter(tuple(r) for r in segment_references(segments, shared, links, uz).collect())
    assert got == Counter(
        [
            ("links", "source_id", 2, "2024-03", "late"), ("links", "target_id", 2, "2024-03", "missing"), ("links", "target_id", 5, None, "missing"), ("links", "target_id", 5, None, "missing"),
            ("uz_segments", "name", 3, "2024-03", "late"), ("uz_segments", "name", 4, "2024-03", "missing"), ("uz_segments", "name", 8, "2024-03", "deleted"),
            ("uz_segments", "name", 10, None, "missing"),
        ]
    )


def test_orphans_of_a_hot_key_and_of_nothing(spark):
    refs = spark.createDataFrame([("t", "f", k, 1 if k % 2 else k, None, T) for k in range(2000)], "tab string, field string, row_key long, key long, fallback long, at timestamp_ntz")
    parents = spark.createDataFrame([(k, T, None) for k in range(0, 2000, 4)], "key long, first_loaded timestamp_ntz, deleted_at timestamp_ntz")
    got = {r.row_key for r in orphan_references(refs, parents).collect()}
    assert got == {k for k in range(2000) if (1 if k % 2 else k) % 4 or k % 2}
    none = orphan_references(refs.where("false"), parents.where("false"))
    assert none.collect() == []
    assert orphan_references(refs, parents.where("false"), range_keys=10).count() == 2000
