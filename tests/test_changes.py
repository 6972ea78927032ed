"""Change detection on small panels, and against plain Python on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from monthmark.operators import changes as ch
from monthmark.sources import writers


def flags(df):
    return {(r.policy, r.inforce_yy, r.inforce_mm): r.major_change for r in df.collect()}


def month(y, m, *pairs, policy="p"):
    return [{"policy": policy, "inforce_yy": y, "inforce_mm": m, "vehicle_no": v, "driver_no": d}
            for v, d in pairs]


def test_same_assignments_in_other_row_order_are_no_change(panel_of):
    rows = month(2018, 1, ("01", "01"), ("02", "02")) + month(2018, 2, ("02", "02"), ("01", "01")) \
        + month(2018, 3, ("01", "01"), ("02", "02"))
    for n in (1, 5):
        assert set(flags(ch.policy_month_changes(panel_of(rows).repartition(n))).values()) == {False}


def test_missing_month_and_year_wrap(panel_of):
    rows = month(2018, 11, ("01", "01")) + month(2018, 12, ("01", "01"), ("02", "02")) \
        + month(2019, 1, ("02", "02")) + month(2019, 3, ("03", "03"))
    present = flags(ch.policy_month_changes(panel_of(rows)))
    assert present == {("p", 2018, 11): False, ("p", 2018, 12): True, ("p", 2019, 1): True,
                       ("p", 2019, 3): True}
    calendar = flags(ch.policy_month_changes(panel_of(rows), "calendar"))
    assert calendar == {**present, ("p", 2019, 3): False}


def test_null_keys(panel_of):
    rows = month(2018, 1, ("01", "01")) + month(2018, 2, (None, "01")) + month(2018, 3, (None, "02"))
    assert flags(ch.policy_month_changes(panel_of(rows))) == {
        ("p", 2018, 1): False, ("p", 2018, 2): True, ("p", 2018, 3): False}
    flagged = ch.flag_panel(panel_of(rows + month(2018, 1, ("01", "01"), policy=None)))
    assert [r.major_change for r in flagged.where("policy is null").collect()] == [None]
    assert flagged.count() == 4


def test_unknown_mode(panel_of):
    with pytest.raises(ValueError):
        ch.policy_month_changes(panel_of(month(2018, 1, ("01", "01"))), "weekly")


def random_rows(seed, policies=12, months=9):
    rng = random.Random(seed)
    rows = []
    for p in range(policies):
        for k in range(months):
            if rng.random() < 0.25:
                continue
            y, m = divmod(2018 * 12 + 9 + k, 12)
            for v in range(1, 4):
                if rng.random() < 0.5:
                    rows += month(y, m + 1, (f"0{v}", f"0{rng.randint(1, 2)}"), policy=f"p{p:02d}")
    return rows


@pytest.mark.parametrize("mode", ["present", "calendar"])
def test_against_sets(panel_of, mode):
    rows = random_rows(7)
    sets = {}
    for r in rows:
        key = (r["policy"], r["inforce_yy"] * 12 + r["inforce_mm"] - 1)
        sets.setdefault(key, set()).add((r["vehicle_no"], r["driver_no"]))
    want = {}
    for (p, m), items in sets.items():
        earlier = [k for q, k in sets if q == p and k < m]
        prev = max(earlier) if earlier and mode == "present" else m - 1
        old = sets.get((p, prev))
        added, removed = (len(items - old), len(old - items)) if old is not None else (0, 0)
        want[(p, m // 12, m % 12 + 1)] = (old is not None, added, removed, added + removed > 0)
    out = ch.policy_month_changes(panel_of(rows), mode).collect()
    got = {(r.policy, r.inforce_yy, r.inforce_mm):
           (r.has_previous, r.added, r.removed, r.major_change) for r in out}
    assert got == want
    changed = {(r.policy, r.inforce_yy, r.inforce_mm)
               for r in ch.changed_months(panel_of(rows), mode).collect()}
    assert changed == {k for k, v in want.items() if v[3]}
    moves = ch.assignment_moves(panel_of(rows), mode).groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in moves} == {
        "added": sum(v[1] for v in want.values()), "removed": sum(v[2] for v in want.values())}


def test_adjacent_rows_against_a_loop(panel_of):
    rng = random.Random(3)
    fields = ["vehicle_no", "driver_no", "vehicle_vin", "vehicle_type", "model_year",
              "driver_license_no", "driver_name", "driver_type", "driver_age"]
    rows = []
    for p in range(40):
        for m in range(1, 6):
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                rows.append({"policy": f"p{p:02d}", "inforce_yy": 2018, "inforce_mm": m,
                             "vehicle_type": rng.choice(["Sedan"] * 9 + ["SUV"]),
                             "driver_name": rng.choice(["A"] * 12 + [None]),
                             "driver_age": rng.choice([40, 40, 41, 42, 43, None])})
    panel = panel_of(rows)
    low = lambda v: (v is not None, v if v is not None else 0)
    ordered = sorted(panel.collect(), key=lambda r: (r.policy, r.inforce_mm,
                                                     *[low(r[f]) for f in fields]))
    want = {(r.policy, r.inforce_yy, r.inforce_mm): False for r in ordered}
    seen = {}
    for prev, cur in zip([None, *ordered], ordered):
        n = seen[cur.policy] = seen.get(cur.policy, 0) + 1
        if n == 1:
            continue
        differs = any(prev[f] is None or cur[f] is None or prev[f] != cur[f]
                      for f in fields if f != "driver_age")
        ages = prev.driver_age, cur.driver_age
        jump = None not in ages and abs(ages[0] - ages[1]) > 1
        if n == 2 or differs or jump:
            want[(cur.policy, cur.inforce_yy, cur.inforce_mm)] = True
    assert flags(ch.adjacent_changes(panel)) == want
    assert len(set(want.values())) == 2


def test_detail_flags(panel_of):
    base = {"policy": "p", "inforce_yy": 2018}
    rows = [{**base, "inforce_mm": 1, "driver_age": 40},
            {**base, "inforce_mm": 2, "driver_age": 41},
            {**base, "inforce_mm": 3, "driver_age": 43},
            {**base, "inforce_mm": 4, "driver_age": 43, "vehicle_type": "SUV"},
            {**base, "inforce_mm": 5, "driver_age": 43, "vehicle_type": "SUV", "driver_name": "C"}]
    out = {r.inforce_mm: (r.vehicle_changed, r.driver_changed, r.age_jump)
           for r in ch.detailed_changes(panel_of(rows)).collect()}
    assert out == {1: (False, False, False), 2: (False, False, False), 3: (False, False, True),
                   4: (True, False, False), 5: (False, True, False)}


def test_summary_of_nothing(panel_of):
    empty = panel_of([]).withColumn("major_change", F.lit(False))
    row = ch.change_summary(empty).collect()[0]
    assert (row.total_records, row.change_percentage, row.policy_change_rate) == (0, 0.0, 0.0)


def test_next_changed_policy_after(panel_of):
    rows = []
    for p in ("a", "c", "e"):
        rows += month(2018, 1, ("01", "01"), policy=p) + month(2018, 2, ("02", "01"), policy=p)
    changes = ch.policy_month_changes(panel_of(rows))
    after = lambda p: [tuple(r) for r in ch.next_changed_policy_after(changes, p).collect()]
    assert after("a") == [("c", 201802)]
    assert after("e") == []
    assert after("zz") == [("a", 201802)]
    pairs = {r.policy: r.next_policy for r in ch.next_changed_policy(changes).collect()}
    assert pairs == {"a": "c", "c": "e", "e": None}


def test_details_are_compared_value_by_value(spark, panel_of):
    """A mark inside a value, and a missing value, are no part of another one."""
    rows = []
    for policy, first, second in (("a", ("A|B", "C"), ("A", "B|C")), ("b", ("V", None), ("V", "")), ("c", ("V", "C"), ("V", "C"))):
        for m, (vin, kind) in ((1, first), (2, second)):
            rows.append({"policy": policy, "inforce_yy": 2018, "inforce_mm": m, "vehicle_vin": vin, "vehicle_type": kind})
    got = {(r.policy, r.inforce_mm): r.vehicle_changed for r in ch.detailed_changes(panel_of(rows)).collect()}
    assert got == {("a", 1): False, ("a", 2): True, ("b", 1): False, ("b", 2): True, ("c", 1): False, ("c", 2): False}



@pytest.mark.parametrize("salt", [100_000, 3])
def test_flags_in_order_equal_joined_ones(spark, panel_of, tmp_path, salt):
    """Same rows and flags, copies and rows without keys among them; files in order; whole rows are shuffled once."""
    rows = [r for p in range(12) for m in range(1, 9) for r in month(
        2018, m, *[(f"{v:02d}", f"{d:02d}") for v in range(3) for d in range(2) if (p * 7 + m * (v + 1) + d) % 4], policy=f"{p:08d}")]
    rows += rows[:9] + [{**r, "policy": None} for r in rows[:5]] + [{**r, "inforce_mm": None} for r in rows[5:12]]
    rows += [{**rows[0], "vehicle_no": None}, {**rows[1], "vehicle_no": None, "driver_no": None}, {**rows[40], "driver_no": None}]
    panel = panel_of(rows)
    ordered = ch.flag_panel(panel, in_order=True, rows_per_salt=salt)
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "rangepartitioning" in x]) == 1
    key = lambda r: tuple("" if x is None else f"1{x}" for x in r)
    want = sorted(map(key, ch.flag_panel(panel).collect()))
    writers.write_sorted_panel(ordered, f"{tmp_path}/p", fmt="parquet", in_order=True)
    files = sorted(f for f in (tmp_path / "p").iterdir() if f.name.startswith("part-"))
    got = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    assert sorted(map(key, got)) == want and {r.major_change for r in got} == {None, False, True}
    order = [key((r.policy, r.inforce_yy, r.inforce_mm, r.vehicle_no, r.driver_no)) for r in got]
    assert order == sorted(order)
