"""The data operators against brute force, and on nulls, blanks, repeats, ties, empty tables and clashing columns."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normgraph.operators import eav, hierarchy, intervals, orphans
from normgraph.operators.bitmaps import CompressedBitmap
from normgraph.staging import hot_split_join
from tests.conftest import rows

codes = st.lists(st.integers(0, 200_000), max_size=300)


@given(codes, codes)
@settings(max_examples=60, deadline=None)
def test_bitmaps_are_sets(a, b):
    x, y = CompressedBitmap(np.array(a, dtype=np.int64)), CompressedBitmap(np.array(b, dtype=np.int64))
    assert x.decode().tolist() == sorted(set(a)) and len(x) == len(set(a))
    assert x.and_not(y).decode().tolist() == sorted(set(a) - set(b))
    x.update(y)
    assert x.decode().tolist() == sorted(set(a) | set(b))


def test_dense_bitmaps():
    a, b = np.arange(0, 70_000), np.arange(1, 70_000, 2)
    x = CompressedBitmap(a)
    assert x.and_not(CompressedBitmap(b)).decode().tolist() == list(range(0, 70_000, 2))
    assert x.nbytes() < a.nbytes / 8
    y = CompressedBitmap(b)
    y.update(CompressedBitmap(np.arange(0, 70_000, 2)))
    assert len(y) == 70_000


# references


def at(day, hour=0):
    return datetime(2020, 1, 1, hour) + timedelta(days=day)


REFS = "ref_table string, ref_field string, row_id long, ns string, key string, recorded_at timestamp_ntz"
TARGETS = "ns string, key string, first_at timestamp_ntz, gone boolean"


def test_orphans_against_brute_force(spark):
    rnd = random.Random(4)
    targets = {("a" if k % 2 else "b", f"k{k}"): (at(rnd.randrange(300), rnd.randrange(24)), rnd.random() < 0.1) for k in range(300)}
    refs = [("t", "f", i, *("a" if k % 2 else "b", f"k{k}"), at(rnd.randrange(300), rnd.randrange(24))) for i, k in enumerate(rnd.choices(range(340), k=4000))]
    refs += [("t", "f", 10_000 + i, "a", "hot", at(i % 90)) for i in range(2500)]  # a hot missing key
    want = []
    for *_, i, ns, key, t in refs:
        got = targets.get((ns, key))
        want.append((i, "missing") if got is None else (i, "deleted") if got[1] else (i, "late") if got[0] > t else None)
    df = orphans.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame([(*k, *v) for k, v in targets.items()], TARGETS), rows_per_range=50)
    assert rows(df, "row_id", "reason") == sorted((w for w in want if w), key=str)


def test_orphans_edge_cases(spark):
    refs = spark.createDataFrame([("t", "f", 1, "a", None, at(1)), ("t", "f", 2, "a", "x", None), ("t", "f", 3, "a", "y", None), ("t", "f", 4, "a", "y", None), ("t", "f", 5, "a", "z", at(1))], REFS)
    targets = spark.createDataFrame([("a", "x", at(5), False), ("a", "z", None, None), ("b", "y", at(0), False)], TARGETS)
    assert rows(orphans.orphan_references(refs, targets), "row_id", "reason") == [(3, "missing"), (4, "missing")]
    assert orphans.orphan_references(refs.limit(0), targets).count() == 0
    assert rows(orphans.orphan_references(refs, targets.limit(0)), "row_id") == [(2,), (3,), (4,), (5,)]


MEETING = "uri string, agenda_items array<struct<uri string, note string>>, is_deleted boolean, recorded_at timestamp_ntz, key string"
DECISION = "row_id long, uri string, meeting_uri string, agenda_item_uri string, supersedes_uri string, is_deleted boolean, recorded_at timestamp_ntz, ns string"


def test_deliberation_references(spark):
    meetings = spark.createDataFrame([(" URN:M1", [("urn:m1/1", ""), ("urn:m1/2", ""), (None, "")], False, at(0), "clash"), ("urn:m1", [("urn:m1/1", "")], None, at(9), ""), ("urn:m2", None, True, at(1), ""), (None, None, None, None, None)], MEETING)
    decisions = spark.createDataFrame([
        (1, "urn:d1", "urn:m1 ", "URN:M1/1", None, False, at(2), "x"), (2, "urn:d2", "urn:m2", "urn:m1/2", "urn:d1", False, at(3), "x"),
        (3, "urn:d3", "n/a", " ", "urn:d4", False, at(3), "x"), (4, "urn:d4", "urn:m9", None, "urn:d4", True, at(5), "x"), (5, None, None, None, None, None, None, None),
    ], DECISION)
    ext = spark.createDataFrame([(1, "urn:external:Directive  1/2 ", at(1)), (2, " ", at(1)), (3, None, at(1)), (4, "urn:external:regulation:act 9", at(1)), (5, "act 3", at(1))], "row_id long, ref_text string, recorded_at timestamp_ntz")
    ins = spark.createDataFrame([("directive 1/2", False, at(0)), ("Act 9", False, at(2)), ("ACT 3", True, at(0))], "citation string, is_deleted boolean, recorded_at timestamp_ntz")
    df = orphans.orphan_references(*orphans.deliberation_references(meetings, decisions, ext, ins))
    assert rows(df, "ref_field", "row_id", "reason") == [
        ("agenda_item_uri", 2, "deleted"), ("meeting_uri", 2, "deleted"), ("meeting_uri", 4, "missing"), ("ref_text", 4, "late"), ("ref_text", 5, "deleted"), ("supersedes_uri", 3, "deleted"), ("supersedes_uri", 4, "deleted"),
    ]
    assert orphans.orphan_references(*orphans.deliberation_references(meetings.limit(0), decisions.limit(0), ext.limit(0), ins.limit(0))).count() == 0


def test_hot_split_join(spark):
    big = spark.createDataFrame([(f"k{i % 3 if i < 900 else i}", i) for i in range(1000)], "k string, v int")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    assert rows(hot_split_join(big, small, ["k"], "n", 50), "k", "v", "n") == rows(big.join(small, "k"), "k", "v", "n")


# wide tables

ATTRIBUTES = [("a:n", "http://a/n", "int", "one"), ("a:d", "http://a/d", "decimal", "one"), ("a:t", "http://a/t", "date", "one"), ("a:b", "http://a/b", "boolean", "one"), ("a:s", "http://a/s", "text", "one"), ("a:m", "http://a/m", "text", "many"), ("a-n", "http://b/n", "text", "one")]


def wide(spark, triples):
    t = spark.createDataFrame([(*x, "extra") for x in triples], "subject string, predicate string, object string, attr string")
    return eav.wide_table(t, spark.createDataFrame(ATTRIBUTES, "predicate string, full_uri string, value_type string, cardinality string"), rows_per_bucket=3)


def test_wide_values(spark):
    got = {r["subject"]: r for r in wide(spark, [
        ("x", "a:n", " +007\t"), ("x", "http://a/n", "7"), ("x", "a:d", "1.50"), ("x", "a:d", "+1.5"), ("x", "a:t", "2020-02-29"), ("x", "a:t", "2020-02-29T10:00"), ("x", "a:b", "YES"), ("x", "a:b", "1"), ("x", "a:s", "ä"), ("x", "a:m", "1"), ("x", "a:m", "2"), ("x", "a-n", "other"),
        ("y", "a:n", "7"), ("y", "a:n", "8"), ("y", "a:d", "1e3"), ("y", "a:t", "2021-02-29"), ("y", "a:b", "maybe"), ("y", "a:s", "a"), ("y", "a:s", "b"),
        ("z", "a:n", None), ("z", "a:d", "  "), ("z", "x:other", "1"), ("big", "a:n", "9" * 30), ("big", "a:d", "-0.0"), (None, "a:n", "1"), ("w", None, "1"), ("z", "a:t", "0000-01-01"), ("nl", "a:n", "5\n"), ("nl", "a:t", "2020-01-01\n"),
    ]).collect()}
    assert set(got) == {"x", "y", "z", "big", "nl"} and sorted(got["nl"]["invalid"]) == ["a:n", "a:t"]
    assert (got["x"]["a_n_2"], float(got["x"]["a_d"]), got["x"]["a_t"], got["x"]["a_b"], got["x"]["a_s"], got["x"]["a_n"]) == (7, 1.5, date(2020, 2, 29), True, "ä", "other")
    assert got["x"]["invalid"] == [] and sorted(got["y"]["invalid"]) == ["a:b", "a:d", "a:n", "a:s", "a:t"]
    assert all(got["y"][c] is None for c in ("a_n", "a_d", "a_t", "a_b", "a_s", "a_n_2"))
    assert got["z"]["invalid"] == ["a:t"] and got["big"]["a_n_2"] is None and got["big"]["invalid"] == [] and got["big"]["a_d"] == 0


def test_wide_empty(spark):
    assert wide(spark, []).count() == 0
    t = spark.createDataFrame([("x", "a:n", "1")], "subject string, predicate string, object string")
    none = spark.createDataFrame([], "predicate string, full_uri string, value_type string, cardinality string")
    assert rows(eav.wide_table(t, none)) == [("x", [])]


# intervals

SPAN = "who string, role string, a date, b date, starts string"


def brute_periods(spans):
    days = set()
    for a, b in spans:
        days |= set(range(a, b + 1))
    out, days = [], sorted(days)
    for d in days:
        if out and out[-1][1] == d - 1:
            out[-1][1] = d
        else:
            out.append([d, d])
    return [tuple(x) for x in out]


def test_intervals_against_brute_force(spark):
    rnd = random.Random(9)
    day = date(2000, 1, 1)
    data, spans = [], {}
    for _ in range(6000):
        who = "hot" if rnd.random() < 0.4 else f"s{rnd.randrange(40)}"
        a = rnd.randrange(2500)
        b = a + rnd.choice((0, 1, 3, 30))
        data.append((who, "r", day + timedelta(a), day + timedelta(b), "clash"))
        spans.setdefault(who, []).append((a, b))
    df = intervals.periods_and_gaps(intervals.interval_lists(spark.createDataFrame(data, SPAN).repartition(7), ["who", "role"], "a", "b", slices=4), ["who", "role"])
    want = []
    for who, s in spans.items():
        p = brute_periods(s)
        text = lambda d: (day + timedelta(d)).isoformat()
        want += [(who, "period", text(a), text(b)) for a, b in p] + [(who, "gap", text(x[1] + 1), text(y[0] - 1)) for x, y in zip(p, p[1:])]
    assert rows(df, "who", "kind", "from_date", "to_date") == sorted(want, key=str)


def test_intervals_edge_cases(spark):
    d = date
    data = [("x", "r", d(2020, 1, 1), d(2020, 1, 5), ""), ("x", "r", d(2020, 1, 6), None, ""), ("x", "r", d(2021, 1, 1), d(2021, 2, 1), ""), ("y", "r", d(2020, 1, 1), d(2019, 1, 1), ""), ("y", "r", None, d(2019, 1, 1), ""), (None, "r", d(2020, 1, 1), None, ""), ("z", "r", d(2020, 1, 1), d(9999, 12, 31), ""), ("z", "r", d(2020, 1, 1), d(9999, 12, 31), ""), ("z", "r", d(2019, 12, 1), d(2019, 12, 1), "")]
    out = lambda df: rows(intervals.periods_and_gaps(intervals.interval_lists(df, ["who", "role"], "a", "b"), ["who", "role"]), "who", "kind", "from_date", "to_date")
    assert out(spark.createDataFrame(data, SPAN)) == [("x", "period", "2020-01-01", "open"), ("z", "gap", "2019-12-02", "2019-12-31"), ("z", "period", "2019-12-01", "2019-12-01"), ("z", "period", "2020-01-01", "open")]
    assert out(spark.createDataFrame([], SPAN)) == []


# hierarchies


def brute_tree(parent):
    out = {}
    for x in parent:
        path, at = [x], x
        while parent.get(at) in parent:
            at = parent[at]
            if at in path:
                path = None
                break
            path.append(at)
        out[x] = path[::-1] if path else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    parent = {f"n{k}": (f"n{rnd.randrange(max(1, k))}" if rnd.random() < 0.9 and k else rnd.choice((None, "gone"))) for k in range(300)}
    for k in range(300, 420):  # a long chain
        parent[f"n{k}"] = f"n{k - 1}" if k > 300 else None
    parent |= {"c1": "c3", "c2": "c1", "c3": "c2", "below": "c1", "self": "self"}
    for k in range(200):
        parent[f"child{k}"] = "n0"
    paths = brute_tree(parent)
    df = hierarchy.nested_sets(spark.createDataFrame(list(parent.items()), "id string, parent string"), with_path=True)
    got = {r["id"]: r for r in df.collect()}
    assert set(got) == set(parent)
    for x, path in paths.items():
        r = got[x]
        if path is None:
            assert (r["root"], r["depth"], r["n_descendants"], r["pre"], r["path"]) == ("cycle", -1, -1, -1, None)
        else:
            below = sum(1 for p in paths.values() if p and x in p[:-1])
            assert (r["root"], r["depth"], r["n_descendants"], r["path"]) == (path[0], len(path) - 1, below, "/".join(path))
    for x, path in paths.items():
        for y in path or ():  # ranges say who is an ancestor
            assert got[y]["pre"] <= got[x]["pre"] <= got[y]["last"] and got[y]["root"] == got[x]["root"]
    tops = spark.createDataFrame([("n0",), ("c1",), ("n300",)], "id string")
    want = [(t, x) for t in ("n0", "n300") for x, p in paths.items() if p and t in p[:-1]]
    assert rows(hierarchy.descendants(df, tops)) == sorted(want, key=str)


def test_institutions(spark):
    t = "id string, parent string, recorded_at timestamp_ntz, root string, size long"
    data = [(" i1 ", None, at(0), "", 0), ("I2", "i1", at(0), "", 0), ("i2", "i3 ", at(1), "", 0), ("I3", " ", at(0), "", 0), (None, "i1", at(0), "", 0), (" ", "i1", at(0), "", 0), ("I2", "i3 ", at(1), "", 0)]
    nodes = hierarchy.institution_nodes(spark.createDataFrame(data, t))
    assert rows(nodes) == sorted([("I1", None), ("I2", "I3"), ("I3", None)], key=str)
    assert hierarchy.nested_sets(nodes.limit(0)).count() == 0
