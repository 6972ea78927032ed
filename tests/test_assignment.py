"""Driver assignment against a per-family loop."""

import random
from collections import defaultdict
from datetime import date

from monthmark.operators import assignment as asg
from monthmark.params import Params
from monthmark.schema import DRIVERS, VEHICLES
from tests.test_panel import table

P = Params()


def families(seed, n=60):
    rng = random.Random(seed)
    vehicles, drivers = [], []
    for f in range(n):
        fam = f"FAM{f:06d}"
        for v in range(rng.randint(0 if f % 9 == 0 else 1, 5)):
            vehicles.append({"vehicle_no": f"{v + 1:02d}", "family_id": fam, "vehicle_type": "Sedan",
                             "effective_date": date(2018, 1, 1), "vin": "x", "model_year": 2010,
                             "status": rng.choice(["active", "active", "removed"])})
        adults = rng.randint(1, 3)
        for d in range(adults + rng.randint(0, 2)):
            teen = d >= adults
            age = rng.randint(16, 24) if teen else rng.choice([23, 30, 45, 60])
            drivers.append({"driver_no": f"{d + 1:02d}", "family_id": fam, "age": age,
                            "age_at_issuance": age, "driver_name": "n",
                            "driver_type": "teen" if teen else "adult",
                            "effective_date": date(2018, 1, 1),
                            "status": rng.choice(["active", "active", "active", "removed"])})
    return vehicles, drivers


def by_family(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["family_id"]].append(r)
    return out


def initial_loop(vehicles, drivers):
    """Rules as stated in the operator's description, family by family."""
    cars, people = by_family(vehicles), by_family(drivers)
    out = set()
    for fam, ds in people.items():
        ds = sorted(ds, key=lambda d: (d["driver_type"] != "adult", d["driver_no"]))
        vs = sorted(cars[fam], key=lambda v: v["vehicle_no"])
        young = [d for d in ds if d["age"] <= 24]
        primary = [[v["vehicle_no"], ds[i if i < len(ds) else 0]["driver_no"], 1.0]
                   for i, v in enumerate(vs)]
        second = []
        if not vs:
            second = [("UNASSIGNED", d["driver_no"], "unassigned", 0.0) for d in ds]
        elif len(ds) > len(vs):
            for i, d in enumerate(ds[len(vs):]):
                slot = i % len(vs)
                teen = d["age"] <= 24
                second.append((vs[slot]["vehicle_no"], d["driver_no"],
                               "secondary_teen" if teen else "secondary_adult",
                               0.35 if teen else 0.5))
                if not teen:
                    primary[slot][2] = 0.6
        elif len(ds) == len(vs) and young:
            second = [(vs[0]["vehicle_no"], d["driver_no"], "secondary_teen", 0.35) for d in young]
            primary[0][2] = 0.6
        rows = [(v, d, "primary", e) for v, d, e in primary] + second
        out |= {(fam, f"ASS{i:08d}", *r) for i, r in enumerate(rows, 1)}
    return out


def reassign_loop(vehicles, drivers):
    live = lambda rows: by_family([r for r in rows if r["status"] == "active"])
    cars, people = live(vehicles), live(drivers)
    out = set()
    for fam, vs in cars.items():
        vs = sorted(vs, key=lambda v: v["vehicle_no"])
        ds = sorted(people[fam], key=lambda d: (d["age"], d["driver_no"]))
        if not ds:
            continue
        for i, v in enumerate(vs):
            first, share = ds[i % len(ds)], 1.0
            if len(ds) > len(vs):
                other = [d for d in ds if d is not first][0]
                teen = other["age"] <= 24
                share = 1.0 if teen else 0.6
                out.add((fam, v["vehicle_no"], other["driver_no"],
                         "secondary_teen" if teen else "secondary_adult", 0.35 if teen else 0.5))
            out.add((fam, v["vehicle_no"], first["driver_no"], "primary", share))
    return out


def test_initial(spark):
    v, d = families(5)
    out = asg.initial_assignments(table(spark, VEHICLES, v), table(spark, DRIVERS, d), P).collect()
    got = {(r.family_id, r.assignment_id, r.vehicle_no, r.driver_no, r.assignment_type,
            r.exposure_factor) for r in out}
    assert got == initial_loop(v, d) and len(out) == len(got)


def test_reassign_and_premiums(spark):
    v, d = families(6)
    vt, dt = table(spark, VEHICLES, v), table(spark, DRIVERS, d)
    new = asg.reassign(vt, dt, P, date(2019, 5, 1))
    out = new.collect()
    got = {(r.family_id, r.vehicle_no, r.driver_no, r.assignment_type, r.exposure_factor)
           for r in out}
    assert got == reassign_loop(v, d) and len(out) == len(got)
    assert all(r.assignment_id == f"ASS{r.family_id}{r.vehicle_no}{r.driver_no}" for r in out)
    paid = asg.with_stored_premiums(new, vt, dt, P)
    assert paid.count() == len(out) and paid.where("annual_premium_paid <= 0").count() == 0


def test_initial_assignments_are_valid(spark):
    v, d = families(8)
    for r in v + d:
        r["status"] = "active"
    vt, dt = table(spark, VEHICLES, v), table(spark, DRIVERS, d)
    rules = {r.rule for r in asg.assignment_violations(
        asg.initial_assignments(vt, dt, P), vt, dt, P).collect()}
    assert rules <= {"max_drivers", "driver_assigned", "no_unassigned"}
    assert "one_primary" not in rules


def test_large_family_is_ranked_over_many_buckets(spark):
    v = [{"vehicle_no": f"{i:08d}", "family_id": "F", "status": "active", "vin": "x",
          "effective_date": date(2018, 1, 1)} for i in range(3000)]
    d = [{"driver_no": f"{i:08d}", "family_id": "F", "age": 30 + i % 40, "driver_type": "adult",
          "status": "active"} for i in range(4000)]
    vt, dt = table(spark, VEHICLES, v), table(spark, DRIVERS, d)
    out = asg.initial_assignments(vt, dt, P)
    assert out.count() == 4000
    assert out.select("driver_no").distinct().count() == 4000
    assert out.where("assignment_type = 'primary' and exposure_factor = 0.6").count() == 1000
