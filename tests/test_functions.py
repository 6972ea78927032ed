"""Rounding, factors, ranks, medians and ages."""

import random
import statistics
from datetime import date

from pyspark.sql import functions as F

from monthmark.functions import columns as col
from monthmark.functions import ranking
from monthmark.functions.skew import hot_keys, salted_join
from monthmark.operators import rating as rt
from monthmark.params import Params, factor_table, load_params, params_from_dict
from monthmark.schema import POLICIES
from tests.test_panel import table

P = Params()


def test_half_up(spark):
    values = [2.675, 10.125, 1.005, 0.0, 1736.4375, -2.675, 99.994999]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(col.half_up("x")).collect()] == [
        2.68, 10.13, 1.01, 0.0, 1736.44, -2.68, 99.99]


def test_rounding_is_decimal(spark):
    values = [2.3749999999, 0.0049999995, 1234567.8949999, 0.1 * 3 * 0.35 * 100, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(col.half_up("x")).collect()] == [2.37, 0.0, 1234567.89, 10.5, None, None, None]


def test_money_skips_what_is_no_amount(spark):
    df = spark.createDataFrame([(1.25,), (float("nan"),), (float("-inf"),), (None,), (2.75,)], "x double")
    got = df.agg(col.money_sum("x").alias("s"), col.money_mean("x").alias("m")).first()
    assert (got.s, got.m) == (4.0, 2.0)
    assert ranking.exact_median(df, ["x"]).first()["median"] == 2.0


def test_numbers_are_never_cut(spark):
    df = spark.createDataFrame([(7,), (100000,), (1000007,), (None,)], "n long")
    assert [r[0] for r in df.select(col.padded("n", 6)).collect()] == ["000007", "100000", "1000007", None]


def test_steps_beyond_any_age(spark):
    df = spark.createDataFrame([(a,) for a in (10, 16, 199, 200, 250)], "a int")
    steps = {16: 2.5, 200: 9.0}
    joined = rt.join_step_factor(df, factor_table(spark, steps, "age", "int"), "a", "f").collect()
    want = {r.a: r.f for r in df.select("a", col.step_factor("a", steps).alias("f")).collect()}
    assert {r.a: r.f for r in joined} == want and want[250] == 9.0


def test_salted_join(spark):
    many = spark.createDataFrame([("hot", i) for i in range(4000)] + [("x", 1), (None, 2)], "k string, i long")
    few = spark.createDataFrame([("hot", "h"), ("x", "y"), ("z", "z")], "k string, v string")
    want = sorted(map(str, many.join(few, "k").collect()))
    for rows in (10 ** 6, 100):
        assert sorted(map(str, salted_join(many, few, ["k"], ["i"], rows_per_salt=rows).collect())) == want
    left = many.join(few, "k", "left")
    assert sorted(map(str, salted_join(many, few, ["k"], ["i"], "left", rows_per_salt=100).collect())) == sorted(map(str, left.collect()))


def test_salts_follow_counts(spark):
    many = spark.createDataFrame([("hot", i) for i in range(4000)] + [(f"c{i % 500}", i) for i in range(8000)], "k string, i long").repartition(8)
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in hot_keys(counts, ["k"], rows_per_salt=100).collect()] == [("hot", 40)]
    assert hot_keys(counts, ["k"]).count() == 0  # cold keys are not repeated
    few = spark.createDataFrame([("hot",)] + [(f"c{i}",) for i in range(500)], "k string")
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = salted_join(many, few, ["k"], ["i"], rows_per_salt=100).withColumn("task", F.spark_partition_id())
        tasks = {r["task"]: r["count"] for r in out.where("k = 'hot'").groupBy("task").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # A third of the rows, over more than 16 tasks and none with many of them.
    assert sum(tasks.values()) == 4000 and len(tasks) > 16 and max(tasks.values()) < 600


def test_range_rank(spark):
    from monthmark.functions.ranking import range_rank

    # A key of another kind beside a long common prefix, equal keys, null keys and a null group.
    rows = [("g", f"POLICY-2024-000000{k:04d}") for k in range(3000)] + [("g", "A1"), ("h", None), ("h", "x"), (None, "x"), (None, None)]
    rows += [("g", "POLICY-2024-0000001000")] * 500
    df = spark.createDataFrame(rows, "grp string, k string").repartition(7)
    got = range_rank(df, ["grp"], ["k"], "r", "n").collect()
    for g in ("g", "h", None):
        own = sorted((r for r in got if r.grp == g), key=lambda r: r.r)
        assert [r.r for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        want = sorted((k for x, k in rows if x == g), key=lambda k: (k is not None, k or ""))
        assert [r.k for r in own] == want
    assert range_rank(df.limit(0), ["grp"], ["k"], "r").count() == 0
    flat = range_rank(df, [], ["k"], "r").orderBy("r").collect()
    assert [r.r for r in flat] == list(range(len(rows)))


def test_large_numbers_keep_families_apart(spark):
    from monthmark.plans.fixtures import Tables

    orders = spark.createDataFrame([(1, 100000, date(1998, 1, 5)), (2, 1000007, date(1998, 1, 6))],
                                   "o_orderkey long, o_custkey long, o_orderdate date")
    lines = spark.createDataFrame([(1, 1, 1, 1, 5.0, 10.0, "R"), (2, 1, 1, 1, 5.0, 10.0, "R")],
                                  "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                  "l_extendedprice double, l_returnflag string")
    part = spark.createDataFrame([(1, "SMALL", 3)], "p_partkey long, p_type string, p_size int")
    supplier = spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string")
    given = {"orders": orders, "lineitem": lines, "part": part, "supplier": supplier}
    t = Tables(spark, "/nowhere")
    t.read = given.__getitem__
    rows = t._base().select("family_id", "policy").collect()
    assert {(r.family_id, r.policy) for r in rows} == {("FAM100000", "00100000"), ("FAM1000007", "01000007")}


def test_step_factor_forms_agree(spark):
    ages = [None, 0, 15, 16, 24, 29, 63, 64, 65, 85, 99, 149, 150, 400]
    df = spark.createDataFrame([(a,) for a in ages], "driver_age int")
    want = [1.0, 1.0, 1.0, 2.5, 1.1, 1.0, 0.65, 0.6, 0.65, 1.2, 1.2, 1.2, 1.2, 1.2]
    got = [r.f for r in df.select(col.step_factor("driver_age", P.age_factors).alias("f")).collect()]
    assert got == want
    joined = rt.join_step_factor(df, factor_table(spark, P.age_factors, "age", "int"),
                                 "driver_age", "f").collect()
    assert {(r.driver_age, r.f) for r in joined} == set(zip(ages, want))


def test_rate_of_roles(spark):
    df = spark.createDataFrame(
        [("Sedan", 40, "primary", 2018), ("SUV", 24, "secondary_adult", 2020),
         ("Boat", 64, "secondary_teen", 2019)],
        "vehicle_type string, driver_age int, assignment_type string, inforce_yy int")
    rates = [r[0] for r in df.select(rt.assignment_rate(P, F.col("inforce_yy"))).collect()]
    assert rates == [1275.0, round(1500 * 1.1 * 1.1 * 0.5 * 1.05 ** 2, 2), 945.0]


def test_yearly_increase_rounds_every_year(spark):
    rows = [{"policy_no": "1", "premium_paid": 1000.01, "status": "active"},
            {"policy_no": "2", "premium_paid": 1000.01, "status": "cancelled"}]
    df = table(spark, POLICIES, rows)
    got = {r.policy_no: r.premium_paid for r in rt.yearly_increase(df, P, 2021).collect()}
    assert got == {"1": 1157.64, "2": 1000.01}  # 1050.01, 1102.51, 1157.64
    same = {r.premium_paid for r in rt.yearly_increase(df, P, 2018).collect()}
    assert same == {1000.01}


def test_age_at(spark):
    df = spark.createDataFrame([(date(2000, 2, 29), date(2018, 2, 28)),
                                (date(2000, 2, 29), date(2018, 3, 1)),
                                (date(1990, 12, 31), date(2020, 12, 31))], "b date, d date")
    assert [r[0] for r in df.select(col.age_at("b", "d")).collect()] == [17, 18, 30]


def test_exact_median(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 1000, 1001):
        xs = [rng.choice([round(rng.gauss(0, 1e4), 2), 5.0, -5.0, 0.0]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
        assert ranking.exact_median(df, ["x"]).collect()[0].median == statistics.median(xs)
    empty = spark.createDataFrame([], "x double")
    assert ranking.exact_median(empty, ["x"]).count() == 0


def test_median_of_a_crowded_bucket(spark, monkeypatch):
    """Values that share a logarithmic bucket are divided until one task may sort what is left."""
    rng = random.Random(6)
    near, tiny = [1 + rng.random() * 1e-4 for _ in range(20001)], [rng.gauss(0, 1e-200) for _ in range(20001)]
    df = spark.createDataFrame(list(zip(near, tiny)), "near double, tiny double")
    kept, seen = ranking._middle, []
    monkeypatch.setattr(ranking, "_middle", lambda b, by: seen.append(kept(b, by)) or seen[-1])
    for at_once in (1, 50, 10 ** 6):
        seen.clear()
        got = {r.column_name: r.median for r in ranking.exact_median(df, ["near", "tiny"], at_once).collect()}
        assert got == {"near": statistics.median(near), "tiny": statistics.median(tiny)}
        assert len(seen) == 1 if at_once == 10 ** 6 else len(seen) > 1
        assert all(r.distinct <= at_once for r in seen[-1])
        assert all(len(rows) <= 4 for rows in seen)


def test_bucketed_rank_and_lead(spark):
    rng = random.Random(2)
    keys = [(rng.choice("ab"), f"{rng.randint(0, 10 ** 9):09d}") for _ in range(3000)]
    df = spark.createDataFrame(keys, "g string, k string").distinct()
    out = ranking.bucketed_rank(df, ["g"], [F.col("k")], ranking.prefix_bucket(df, "k", 2), "r",
                                "n").collect()
    for g in "ab":
        mine = sorted({k for h, k in keys if h == g})
        assert {(r.k, r.r, r.n) for r in out if r.g == g} == {
            (k, i, len(mine)) for i, k in enumerate(mine)}
    names = ["a", "ab", "abcdefgh", "abcdefgi", "b", "zzzzzzzzz", ""]
    led = ranking.bucketed_lead(spark.createDataFrame([(n,) for n in names], "k string"), "k", "nx")
    ordered = sorted(names)
    assert {(r.k, r.nx) for r in led.collect()} == set(zip(ordered, [*ordered[1:], None]))


def test_keys_with_a_long_common_prefix_spread(spark):
    keys = [f"POLICY-NUMBER-OF-2024-{i:06d}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    buckets = df.select(ranking.prefix_bucket(df, "k", 2).alias("b")).groupBy("b").count().collect()
    assert len(buckets) > 20 and max(r["count"] for r in buckets) <= 1000
    led = {r.k: r.nx for r in ranking.bucketed_lead(df, "k", "nx").collect()}
    assert led == dict(zip(keys, [*keys[1:], None]))


def test_params_from_a_file(spark, tmp_path):
    (tmp_path / "run.yaml").write_text("date_range:\n  start_date: 2019-02-01\npolicies:\n  premium:\n    base_amount: 1200\n"
                                       "    calculation:\n      driver_age_factors: {16: 2.0, 200: 9.0}\n")
    a, b = load_params(f"{tmp_path}/run.yaml"), load_params(f"{tmp_path}/run.yaml", spark)
    assert a == b and (a.start, a.base_amount, a.age_factors) == (date(2019, 2, 1), 1200.0, {16: 2.0, 200: 9.0})


def test_params_from_dict():
    p = params_from_dict({
        "date_range": {"start_date": "2019-01-01", "end_date": "2019-12-31"},
        "policies": {"premium": {"base_amount": 1000, "annual_inflation_rate": 0.1,
                                 "calculation": {"driver_age_factors": {"20": 2}}}},
        "driver_assignment": {"max_drivers_per_vehicle": 2,
                              "exposure_allocations": {"primary_shared": 0.7}}})
    assert (p.start, p.end, p.base_amount, p.inflation) == (date(2019, 1, 1), date(2019, 12, 31),
                                                            1000.0, 0.1)
    assert p.age_factors == {20: 2.0} and p.max_drivers_per_vehicle == 2
    assert p.exposures.primary_shared == 0.7 and p.exposures.primary_solo == 1.0
