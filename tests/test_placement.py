"""First fit in one place for each store: against every minute and combination."""

import random
from datetime import datetime, timedelta

from paperloom.operators import placement, scheduling

DAY = datetime(2024, 1, 1)
SLOT = "array<struct<start:timestamp,end:timestamp>>"
TASKS = "task_id string, store_id string, duration_minutes int, earliest_start timestamp, latest_end timestamp, required_skills array<string>, required_workstation_types array<string>, required_equipment_types array<string>, allowed_technician_ids array<string>"
RESOURCES = f"kind string, ord int, id string, store_id string, type string, availability {SLOT}, abilities array<struct<skill:string,valid_from:timestamp,valid_until:timestamp>>"


def test_plan_in_blocks_of_a_store(spark, monkeypatch):
    monkeypatch.setattr(placement, "TASKS", 3)
    rng = random.Random(4)
    at = lambda m: DAY + timedelta(minutes=m)
    kinds = ("technician", "workstation", "equipment")
    resources = []
    for i in range(36):
        a = 480 + rng.randrange(0, 60)
        abilities = [(rng.choice("xy"), at(rng.randrange(450, 600)) if rng.random() < 0.5 else None, at(rng.randrange(560, 700)) if rng.random() < 0.5 else None) for _ in range(2)]
        resources.append((kinds[i % 3], i, f"r{i}", "S" + str(i % 2) if i < 34 else None, rng.choice(["p", "q", None]), [(at(a), at(a + rng.randrange(20, 200)))], abilities if i % 3 == 0 else None))
    booked = [(r[0], r[2], at(s), at(s + rng.randrange(1, 40)), "ACTIVE" if rng.random() < 0.8 else "CANCELLED") for r in resources for s in rng.sample(range(470, 660), 3)]
    tasks = []
    for i in range(70):
        e = 460 + rng.randrange(0, 150)
        pick = lambda xs: rng.choice([None, [], [rng.choice(xs)], list(xs)])
        tasks.append((f"t{i}", rng.choice(["S0", "S1", "S0", "S1", "S9", None]), rng.randrange(5, 40), at(e), at(e + rng.randrange(3, 90)), pick("xy"), pick("pq"), pick("pq"), rng.choice([None, None, None, [f"r{j}" for j in range(0, 36, 6)]])))

    def naive(task):
        _, store, length, early, late, skills, places, devices, allowed = task
        step, start, seen = timedelta(minutes=1), early, set()
        if early + timedelta(minutes=length) > late:
            return None, ["window_too_short"]
        while start + timedelta(minutes=length) <= late:
            end = start + timedelta(minutes=length)
            near = [r for r in resources if store is not None and r[3] == store and any(a <= start and end <= z for a, z in r[5])]
            free = lambda r: not any(b[:2] == (r[0], r[2]) and b[4] == "ACTIVE" and b[2] < end and start < b[3] for b in booked)
            held = lambda r: {s for s, a, z in r[6] or () if (a is None or a <= start) and (z is None or end <= z)}
            t = [r for r in near if r[0] == "technician" and (allowed is None or r[2] in allowed) and set(skills or ()) <= held(r)]
            w = [r for r in near if r[0] == "workstation" and (not places or r[4] in places)]
            e = [[r for r in near if r[0] == "equipment" and r[4] == ty] for ty in sorted(set(devices or ()))]
            seen |= {k for k, x in (("t", t), ("w", w), ("e", all(e))) if x}
            got = [[r[2] for r in x if free(r)][:1] for x in (t, w, *e)]
            if all(got):
                return (start, end, got[0][0], got[1][0], [g[0] for g in got[2:]]), []
            start += step
        missing = [name for k, name in (("t", "no_qualified_technician"), ("w", "no_compatible_workstation"), ("e", "no_required_equipment")) if k not in seen]
        return None, missing or ["resource_conflict", "no_available_time"]

    out = scheduling.plan(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(resources, RESOURCES), spark.createDataFrame(booked, "resource_type string, resource_id string, start_time timestamp, end_time timestamp, status string"))
    assert "CoGroup" in out._jdf.queryExecution().executedPlan().toString()  # starts and pairs stay in their place
    got = {r.task_id: ((r.start, r.end, r.technician_id, r.workstation_id, r.equipment_ids) if r.status == "FEASIBLE" else None, r.reasons) for r in out.collect()}
    want = {t[0]: naive(t) for t in tasks}
    assert got == want and sum(w[0] is not None for w in want.values()) > 8
