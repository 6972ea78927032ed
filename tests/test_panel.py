"""The panel against a loop over months, policies and assignments."""

import calendar
import random
from datetime import date, timedelta

import pytest

from monthmark.operators import panel as pn
from monthmark.params import Params
from monthmark.schema import ASSIGNMENTS, CHANGES_LOG, DRIVERS, POLICIES, VEHICLES

P = Params(start=date(2018, 1, 1), end=date(2019, 3, 31))


def table(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def masters(seed):
    rng = random.Random(seed)
    day = lambda a=0, b=450: date(2017, 12, 1) + timedelta(days=rng.randint(a, b))
    policies, vehicles, drivers, assignments, log = [], [], [], [], []
    for f in range(150):
        fam = f"FAM{f:06d}"
        cancelled = rng.random() < 0.4
        policies.append({"policy_no": f"{f:08d}", "family_id": fam, "start_date": day(0, 60),
                         "current_expiry_date": day(300, 500),
                         "status": "cancelled" if cancelled else "active"})
        if cancelled and rng.random() < 0.8:
            for _ in range(rng.randint(1, 2)):
                log.append({"change_type": "policy_cancellation", "family_id": fam,
                            "date": rng.choice([day(), date(2018, 6, 30), date(2018, 7, 1)])})
        for v in ("01", "02"):
            for k in range(rng.choice([1, 1, 2, 3])):
                status = rng.choice(["active", "removed", "removed", "other"])
                gone = rng.choice([day(), None, date(2018, 8, 31)])
                vehicles.append({"vehicle_no": v, "family_id": fam, "vin": f"V{f}{v}{k}",
                                 "vehicle_type": rng.choice(["Sedan", "SUV", "Boat"]),
                                 "model_year": 2010 + k, "effective_date": day(0, 300),
                                 "status": status,
                                 "removal_date": gone if status == "removed" else None})
        for d in ("01", "02"):
            for k in range(rng.choice([1, 2])):
                drivers.append({"driver_no": d, "family_id": fam,
                                "license_no": None if k else f"L{f}{d}", "driver_license_no": f"X{k}",
                                "driver_name": f"N{k}", "driver_type": "adult", "age": 50 + k,
                                "age_at_issuance": rng.choice([None, 24, 64, 99]),
                                "effective_date": day(0, 300), "status": "active"})
        for a in range(4):
            begin = day(0, 300)
            assignments.append({
                "assignment_id": f"A{a}", "family_id": fam, "vehicle_no": rng.choice(["01", "02", "09"]),
                "driver_no": rng.choice(["01", "02"]),
                "assignment_type": rng.choice(["primary", "secondary_adult", "secondary_teen"]),
                "exposure_factor": rng.choice([1.0, 0.6, 0.5, 0.35]), "effective_date": begin,
                "end_date": rng.choice([None, begin + timedelta(days=rng.randint(1, 200)),
                                        date(2018, 9, 30)]), "status": "active"})
    return policies, vehicles, drivers, assignments, log


def expected(policies, vehicles, drivers, assignments, log):
    out = []
    for k in range(15):
        y, m = 2018 + k // 12, k % 12 + 1
        me = date(y, m, calendar.monthrange(y, m)[1])
        for p in policies:
            gone = min((e["date"] for e in log if e["family_id"] == p["family_id"]), default=None)
            if p["status"] == "cancelled" and gone and gone <= me:
                continue
            for a in assignments:
                if a["family_id"] != p["family_id"] or a["effective_date"] > me \
                        or (a["end_date"] and a["end_date"] <= me):
                    continue
                cars = [v for v in vehicles if v["family_id"] == a["family_id"]
                        and v["vehicle_no"] == a["vehicle_no"] and v["effective_date"] <= me
                        and (v["status"] == "active" or (v["status"] == "removed"
                             and v["removal_date"] and v["removal_date"] > me))]
                people = [d for d in drivers if d["family_id"] == a["family_id"]
                          and d["driver_no"] == a["driver_no"] and d["effective_date"] <= me]
                if not cars or not people:
                    continue
                car = min(cars, key=lambda v: (v["effective_date"], v["vin"]))
                who = min(people, key=lambda d: (d["effective_date"],
                                                 d["license_no"] or d["driver_license_no"]))
                age = who["age_at_issuance"] or who["age"]
                out.append((y, m, p["policy_no"], (me - p["start_date"]).days, car["vin"],
                            who["driver_name"], who["license_no"] or who["driver_license_no"], age,
                            a["assignment_type"], a["exposure_factor"]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_panel_equals_the_loop(spark, seed):
    data = masters(seed)
    frames = [table(spark, s, r) for s, r in zip(
        (POLICIES, VEHICLES, DRIVERS, ASSIGNMENTS, CHANGES_LOG), data)]
    out = pn.build_panel(*frames, P)
    got = sorted((r.inforce_yy, r.inforce_mm, r.policy, r.client_tenure_days, r.vehicle_vin,
                  r.driver_name, r.driver_license_no, r.driver_age, r.assignment_type,
                  r.exposure_factor) for r in out.collect())
    want = expected(*data)
    assert got == want and len(want) > 250


def test_no_range_join_in_the_plan(spark):
    frames = [table(spark, s, r) for s, r in zip(
        (POLICIES, VEHICLES, DRIVERS, ASSIGNMENTS, CHANGES_LOG), masters(1))]
    plan = pn.build_panel(*frames, P)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_short_intervals_have_no_month(spark):
    a = table(spark, ASSIGNMENTS, [
        {"effective_date": date(2018, 3, 2), "end_date": date(2018, 3, 31)},
        {"effective_date": date(2018, 3, 2), "end_date": date(2018, 4, 1)},
        {"effective_date": date(2020, 1, 1), "end_date": None}])
    rows = pn.explode_months(pn.assignment_ranges(a, P)).collect()
    assert [(r.inforce_yy, r.inforce_mm) for r in rows] == [(2018, 3)]
