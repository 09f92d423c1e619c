"""Operators on small frames, among them the paths taken only by large data."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starloom.operators import attempts, constraints, dedupe, joins, keys, merge, quality, scd, watermark
from starloom.operators.cascade import CascadeColumns, resolve_identities
from starloom.session import materialize, scratch


@pytest.fixture
def no_broadcast(spark):
    """Make every size check fail, as it would on large tables."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def hot_frame(spark, n=3000):
    """One key holds half of the rows, some keys are null, one has no match."""
    rng = random.Random(3)
    data = [(i, None if i % 17 == 0 else 7 if rng.random() < 0.5 else rng.randint(0, 60), i % 5) for i in range(n)]
    return spark.createDataFrame(data, "id int, k int, v int").repartition(6)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_safe_join_matches_plain_join(spark, no_broadcast, how):
    left = hot_frame(spark)
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 50)] + [(None, "null")], "k int, name string")
    heavy = joins.heavy_keys(left, ["k"], min_rows=100)
    assert rows(heavy, "k", "_heavy_rows") == Counter([(7, -(-left.where("k = 7").count() // 100))])
    plain = left.join(right, "k", how)
    for salted in (joins.skew_safe_join(left, right, ["k"], how, heavy=heavy), joins.skew_safe_join(left, right, ["k"], how)):
        assert rows(salted, *plain.columns) == rows(plain, *plain.columns)


def test_skew_safe_join_spreads_the_hot_key(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        right = spark.createDataFrame([(k, f"r{k}") for k in range(50)], "k int, name string")
        left = hot_frame(spark)
        joined = joins.skew_safe_join(left, right, ["k"], "left", heavy=joins.heavy_keys(left, ["k"], min_rows=50))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 3000 * 0.4


def test_skew_safe_join_rejects_outer(spark):
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        joins.skew_safe_join(df, df, ["k"], "full")


def test_keep_one_cuts_before_the_shuffle(spark):
    kept = dedupe.keep_one(hot_frame(spark), ["k"], ["id"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    assert rows(kept, "k")[(None,)] == 1


def test_keep_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d"), (None, 3, "e")], "k int, o int, v string")
    assert rows(dedupe.keep_one(df, ["k"], ["o"], "last"), "v") == Counter([("b",), ("c",), ("e",)])
    assert rows(dedupe.keep_one(df, ["k"], ["o"]), "v") == Counter([("a",), ("c",), ("d",)])


def test_duplicate_map_with_hot_group(spark, no_broadcast):
    df = hot_frame(spark)
    smallest: dict = {}
    for r in df.collect():
        if r.k is not None:
            smallest[r.k] = min(smallest.get(r.k, r.id), r.id)
    expected = Counter((r.id, smallest[r.k]) for r in df.collect() if r.k is not None and r.id != smallest[r.k])
    assert rows(dedupe.duplicate_map(df, ["k"], "id"), "id_repetido", "id_tomado") == expected
    clean = dedupe.drop_duplicates_of(df, ["k"], "id")
    repeated = {i for i, _ in expected}
    assert {r.id for r in clean.collect()} == {r.id for r in df.collect()} - repeated


def test_remap_is_one_level(spark):
    ids = spark.createDataFrame([(2, 1), (3, 2)], "id_repetido int, id_tomado int")
    df = spark.createDataFrame([(3, "x"), (2, "y"), (9, "z"), (None, "w")], "id int, v string")
    assert rows(dedupe.remap(df, ids, "id"), "id", "v") == Counter([(2, "x"), (1, "y"), (9, "z"), (None, "w")])
    assert dedupe.count_remapped(df, ids, "id").first()[0] == 2


def test_cascade_without_duplicates(spark):
    people = spark.createDataFrame([(1, 10), (2, 20)], "p int, dni int")
    enrollments = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 2, 5)], "e int, p int, o int")
    exams = spark.createDataFrame([(1, 2)], "x int, e int")
    out = resolve_identities(people, enrollments, exams, CascadeColumns("p", ("dni",), "e", "o"))
    assert out.person_map.isEmpty() and out.enrollment_map.isEmpty()
    assert out.enrollments.count() == 3


EXAMS = [
    # id, group, day, passed
    (1, 1, 1, False), (2, 1, 1, True), (3, 1, 2, False), (4, 1, 5, True), (5, 1, 6, True),
    (6, 2, 3, True), (7, 2, 4, False), (8, 3, 1, False),
]


def exam_frame(spark):
    data = [(i, g, dt.date(2024, 1, d), p, 0) for i, g, d, p in EXAMS]
    return spark.createDataFrame(data, "id int, g int, day date, passed boolean, n bigint")


def test_attempt_rule(spark):
    out = attempts.apply_attempt_rule(exam_frame(spark), ["g"], "day", ["id"], "passed", "n")
    assert rows(out, "id", "n") == Counter([(1, 1), (3, 2), (4, 3), (6, 1), (8, 1)])


def test_attempt_rule_on_hot_group(spark):
    """Half of the rows in one group of few days: the window sees one row per day."""
    data = [(i, 1 if i % 2 else i, dt.date(2024, 1, i % 28 + 1), False, 0) for i in range(1, 4000)]
    df = spark.createDataFrame(data, "id int, g int, day date, passed boolean, n bigint")
    out = attempts.apply_attempt_rule(df, ["g"], "day", ["id"], "passed", "n").where("g = 1")
    days = {d for i, g, d, *_ in data if g == 1}
    assert sorted(r.n for r in out.collect()) == list(range(1, len(days) + 1))


def test_history_filter(spark):
    fact = spark.createDataFrame([(1, False), (1, False), (2, True)], "g int, passed boolean")
    new = exam_frame(spark)
    common = dict(keys=["g"], date="day", tie=["id"], passed="passed", attempt="n")
    out = attempts.filter_by_history(new, fact, **common)
    assert rows(out, "id", "n") == Counter([(1, 3), (3, 4), (4, 5), (8, 1)])
    capped = attempts.filter_by_history(new, fact, max_attempts=3, **common)
    assert rows(capped, "id", "n") == Counter([(1, 3), (8, 1)])


def test_surrogate_keys_are_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.col("id").alias("b")).repartition(7)
    numbered = keys.assign_surrogate_keys(df, "sk", ["a", "b"], start=11).orderBy("sk").collect()
    assert [r.sk for r in numbered] == list(range(11, 5011))
    assert [r.a for r in numbered] == sorted(r.a for r in numbered)
    assert [r.sk for r in keys.assign_keys_in_place(df, "sk").orderBy("sk").collect()] == list(range(1, 5001))
    assert keys.next_key(df.limit(0).withColumn("sk", F.lit(1)), "sk") == 1


def test_upsert(spark, no_broadcast):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, d int")
    new = spark.createDataFrame([(2, "x", 9, 1), (2, "y", 9, 2), (3, "z", 9, 1)], "k int, s string, d int, o int")
    out = merge.upsert(old, new, ["k"], ["s", "absent"], order_by=["o"])
    assert rows(out, "k", "s", "d") == Counter([(1, "a", 1), (2, "y", 2), (3, "z", 9)])
    ignored = merge.upsert(old, new, ["k"], ["absent"], order_by=["o"])
    assert rows(ignored, "k", "s", "d") == Counter([(1, "a", 1), (2, "b", 2), (3, "z", 9)])
    assert tuple(merge.upsert_counts(old, new, ["k"]).first()) == (1, 1)


def test_upsert_can_set_null(spark):
    old = spark.createDataFrame([(1, "a")], "k int, s string")
    new = spark.createDataFrame([(1, None)], "k int, s string")
    assert merge.upsert(old, new, ["k"], ["s"]).first().s is None


def test_scd(spark, no_broadcast):
    policy = scd.ScdPolicy("n", "sk", type2=("p",), type1=("g",))
    day = dt.date(2024, 1, 1)
    dim = spark.createDataFrame(
        [(1, 1, "x", "m", day, dt.date(2024, 6, 1), False), (2, 1, "y", "m", day, None, True), (3, 2, None, "m", day, None, True), (4, 3, "z", "m", day, None, True)],
        "sk bigint, n int, p string, g string, valid_from date, valid_to date, es_actual boolean",
    )
    today = dt.date(2025, 1, 1)
    delta = spark.createDataFrame(
        [(1, "w", "f", today, None, True), (2, None, "f", today, None, True), (3, "z", "m", today, None, True), (9, "q", "m", today, None, True)],
        "n int, p string, g string, valid_from date, valid_to date, es_actual boolean",
    )
    classified = scd.classify(dim, delta, policy)
    assert tuple(scd.scd_counts(classified).first()) == (2, 1, 1, 1)
    out = scd.apply_scd(dim, delta, policy, today)
    assert rows(out, "sk", "n", "p", "g", "es_actual", F.col("valid_to").cast("string")) == Counter(
        [
            (1, 1, "x", "m", False, "2024-06-01"), (2, 1, "y", "m", False, "2025-01-01"), (3, 2, None, "f", True, None),
            (4, 3, "z", "m", True, None), (5, 1, "w", "f", True, None), (6, 9, "q", "m", True, None),
        ]
    )


def test_row_accounting(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c"), (None, "d")], "k int, v string")
    valid = quality.all_present(["k", "v"])
    assert tuple(quality.row_accounting(df, "t", valid, ["k"]).first()) == ("t", 5, 2, 2, 1)
    assert tuple(quality.row_accounting(df.limit(0), "t", valid, ["k"]).first()) == ("t", 0, 0, 0, 0)
    good, bad = quality.split_valid(df, valid)
    assert (good.count(), bad.count()) == (3, 2)


def test_interval_and_length_checks(spark):
    df = spark.createDataFrame(
        [(1, "abc", dt.date(2024, 1, 2), dt.date(2024, 1, 1)), (2, "a", dt.date(2024, 1, 2), None), (3, None, dt.date(2024, 1, 1), dt.date(2024, 1, 1))],
        "k int, s string, valid_from date, valid_to date",
    )
    assert rows(quality.bad_intervals(df), "k") == Counter([(1,)])
    assert rows(quality.too_long(df.select("k", "s"), {"s": 2}), "k", "column", "length") == Counter([(1, "s", 3)])


def test_watermark(spark):
    log = spark.createDataFrame([], watermark.AUDIT_SCHEMA)
    assert watermark.latest_watermark(log).first()[0] is None
    t = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    log = spark.createDataFrame(
        [
            (1, t[0], None, None, None, "RUNNING", None, None), (1, t[0], t[1], None, t[0], "OK", 5, None),
            (2, t[1], None, t[0], None, "RUNNING", None, None), (2, t[1], t[2], t[0], t[1], "ERROR", 0, "x"),
            (3, t[2], None, t[0], None, "RUNNING", None, None),
        ],
        watermark.AUDIT_SCHEMA,
    )
    runs = watermark.run_states(log)
    assert rows(runs, "id", "estado") == Counter([(1, "OK"), (2, "ERROR"), (3, "RUNNING")])
    assert watermark.latest_watermark(runs).first()[0] == t[0]


def test_watermark_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "row_id int, fecha_carga timestamp")
    df.write.parquet(str(tmp_path / "t"))
    new = watermark.delta(spark.read.parquet(str(tmp_path / "t")), dt.datetime(2024, 1, 1))
    assert [r.row_id for r in new.collect()] == [2]
    assert "GreaterThan(fecha_carga" in new._jdf.queryExecution().executedPlan().toString()
    assert watermark.delta(df, None).count() == 2
    assert [r.row_id for r in watermark.latest_rows(df, 1).collect()] == [2]


def test_scratch_is_deleted(spark):
    with scratch(spark):
        kept = materialize(spark.range(10))
        assert kept.count() == 10
        path = kept.inputFiles()[0].removeprefix("file://")
    with pytest.raises(FileNotFoundError):
        open(path)


def test_assign_in_turn(spark, no_broadcast):
    """A group with most of the items, one without holders, and ids out of order."""
    holders = [(1, 30), (1, 10), (1, 20), (2, 5)]
    items = [(1, 100 - i) for i in range(60)] + [(2, 200), (2, 201), (3, 300)]
    expected = Counter()
    for g in {g for g, _ in items}:
        ids = sorted(h for k, h in holders if k == g)
        for place, item in enumerate(sorted(i for k, i in items if k == g)):
            expected[(g, item, ids[place % len(ids)] if ids else None)] += 1
    out = keys.assign_in_turn(
        spark.createDataFrame(items, "g int, item int"), spark.createDataFrame(holders, "g int, holder int"), ["g"], "item", "holder"
    )
    assert rows(out, "g", "item", "holder") == expected


def test_accounting_of_picked_rows_shuffles_no_key(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, 6, None), (4, None, 1), (5, None, 1), (6, 7, 0)], "row_id int, k int, v int")
    valid = F.col("v") > 0
    picked = dedupe.keep_one(df.where(valid), ["k"], ["row_id"])
    told = quality.picked_accounting(df, "t", valid, materialize(picked))
    assert [tuple(r) for r in told.collect()] == [tuple(r) for r in quality.row_accounting(df, "t", valid, ["k"]).collect()] == [("t", 6, 2, 2, 2)]
    assert told.schema.simpleString() == quality.row_accounting(df, "t", valid, ["k"]).schema.simpleString()
    assert "hashpartitioning" not in told._jdf.queryExecution().executedPlan().toString()


def test_consolidation_counts_write_affected_exams_only(spark, monkeypatch):
    exams = spark.createDataFrame([(i, i % 50, dt.date(2024, 1, 1 + i % 5), i % 3 == 0) for i in range(200)], "id int, e int, day date, passed boolean")
    enrollments = spark.createDataFrame([(e, e // 2, 1 if e != 7 else None) for e in range(50)], "e int, s int, o int")
    id_map = spark.createDataFrame([(5, 4), (7, 6), (None, 8)], "id_repetido int, id_tomado int")
    written = []
    monkeypatch.setattr(attempts, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    told = attempts.consolidation_counts(
        exams, enrollments, id_map, enrollment_id="e", group=["s", "o"], date="day", tie=["id"], passed="passed"
    ).first()
    # Enrollments 4, 5, 6 and 8 have four exams each; 7 has no offering. Those of 4 and 5 are one group.
    assert (told.afectados, told.grupos) == (16, 3) and told.eliminados > 0
    assert [df.count() for df in written] == [16]


def test_references_are_counted_before_they_move(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "p int")
    broken = constraints.References("c", ("k",), "t", ("p",)).violations(child, lambda table, keys: parent)
    assert [tuple(r) for r in broken.collect()] == [(2, 2)]
    plan = broken._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("count(1)")
