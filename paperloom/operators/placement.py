"""First fit of the tasks of one store, as the planner's conditions state it.

Times are microseconds.  Spans (start, end) that tasks share are tried once for
each distinct set of needs, so the work follows the tasks' candidate starts and
not their product with the resources."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MINUTE = 60_000_000
#: Tasks that meet the resources of their store at once: a bound of memory.
TASKS = 20_000
NEEDS = ("required_skills", "_places", "allowed_technician_ids", "_types")


def _spans(table: dict, i: int, name: str) -> list[tuple[int, int]]:
    starts, ends = table[f"{name}_start"][i], table[f"{name}_end"][i]
    return [(a, z) for a, z in zip(starts or (), ends or (), strict=True) if a is not None and z is not None]


def _starts(tasks: pa.Table, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(task, start, end) by task and start: the earliest start and the moments
    inside the window, rounded up to its minutes, that leave time enough."""
    early, late, length = (tasks.column(c).to_numpy() for c in ("early", "late", "length"))
    a, z = np.searchsorted(moments, early, "right"), np.searchsorted(moments, late, "left")
    many = np.maximum(z - a, 0) + 1
    task, begin = np.repeat(np.arange(len(early)), many), np.cumsum(many) - many
    at = np.arange(many.sum()) - np.repeat(begin, many) - 1
    k = np.zeros(len(task), np.int64)
    inner = at >= 0
    k[inner] = -((early[task[inner]] - moments[a[task[inner]] + at[inner]]) // MINUTE)
    start = early[task] + k * MINUTE
    end = start + length[task] * MINUTE
    keep = (end <= late[task]) & np.concatenate([[True], (task[1:] != task[:-1]) | (start[1:] != start[:-1])])
    return task[keep], start[keep], end[keep]


def placed(tasks: pa.Table, able: pa.Table, schema: pa.Schema) -> pa.Table:
    """tasks (task_id, early, late, length, NEEDS), able: the resources of their
    store -> task_id, start, end, technician_id, workstation_id, equipment_ids of
    the earliest start that has all, else null, and whether a technician (t), a
    workstation (w) and all devices (e) of the needed kind were ever there."""
    if not tasks.num_rows:
        return schema.empty_table()
    held = able.to_pydict()
    moments = {t for i in range(able.num_rows) for c in ("at", "freed") for t in held[c][i] or () if t is not None}
    task, start, end = _starts(tasks, np.array(sorted(moments), np.int64))
    pairs, span = np.unique(np.stack([start, end], 1), axis=0, return_inverse=True)
    span, s, e = span.ravel(), pairs[:, 0], pairs[:, 1]
    inside = lambda spans: np.any([(a <= s) & (e <= z) for a, z in spans], 0) if spans else np.zeros(len(s), bool)
    there, free = ([inside(_spans(held, i, name)) for i in range(able.num_rows)] for name in ("availability", "free"))
    rows = {kind: [i for i in range(able.num_rows) if held["kind"][i] == kind] for kind in ("technician", "workstation", "equipment")}
    ordered = {kind: sorted((i for i in rows[kind] if held["ord"][i] is not None), key=lambda i: held["ord"][i]) for kind in rows}
    devices = sorted(rows["equipment"], key=lambda i: ((0, 0) if held["ord"][i] is None else (1, held["ord"][i]), (0, "") if held["id"][i] is None else (1, held["id"][i])))

    def skilled(i: int, need: set) -> np.ndarray:
        left = {x: np.zeros(len(s), bool) for x in need}
        for skill, a, z in zip(held["skill"][i] or (), held["valid_from"][i] or (), held["valid_until"][i] or (), strict=True):
            if skill in left:
                left[skill] |= (True if a is None else a <= s) & (True if z is None else e <= z)
        return np.all(list(left.values()), 0) if left else np.ones(len(s), bool)

    def first(which: list[int], fits: dict[int, np.ndarray]) -> np.ndarray:
        """The first free one for each span, -1 if there is none; one without an id is none."""
        out, done = np.full(len(s), -1), np.zeros(len(s), bool)
        for i in which:
            now = fits[i] & free[i] & ~done
            out[now] = i if held["id"][i] is not None else -1
            done |= now
        return out

    def some(fits) -> np.ndarray:
        return np.any(list(fits), 0) if fits else np.zeros(len(s), bool)

    needs = [tuple(None if v is None else tuple(v) for v in row) for row in zip(*(tasks.column(c).to_pylist() for c in NEEDS), strict=True)]
    number = {need: i for i, need in enumerate(dict.fromkeys(needs))}
    kind_of = np.array([number[need] for need in needs])
    n = tasks.num_rows
    flags, chosen = np.zeros((3, n), bool), np.full((2, n), -1)
    devised: list[list[int]] = [[] for _ in range(n)]
    at = np.full(n, -1)
    of_row = kind_of[task]
    by_need = np.argsort(of_row, kind="stable")
    edges = np.searchsorted(of_row[by_need], np.arange(len(number) + 1))
    for need, g in number.items():
        skills, places, allowed, types = need
        able_to = {i: there[i] & skilled(i, set(skills or ())) for i in rows["technician"] if allowed is None or held["id"][i] is not None and held["id"][i] in allowed}
        fitted = {i: there[i] for i in rows["workstation"] if not places or held["type"][i] is not None and held["type"][i] in places}
        of_type = {ty: {i: there[i] for i in devices if ty is not None and held["type"][i] == ty} for ty in types}
        t, w = some(able_to.values()), some(fitted.values())
        has = np.all([some(f.values()) for f in of_type.values()], 0) if types else np.ones(len(s), bool)
        who, where = first([i for i in ordered["technician"] if i in able_to], able_to), first([i for i in ordered["workstation"] if i in fitted], fitted)
        device = [first(list(f), f) for f in of_type.values()]
        whole = (who >= 0) & (where >= 0) & (np.all([d >= 0 for d in device], 0) if device else True)
        mine = by_need[edges[g] : edges[g + 1]]
        for f, of in enumerate((t, w, has)):
            flags[f, task[mine[of[span[mine]]]]] = True
        good = mine[whole[span[mine]]]
        winner, one = np.unique(task[good], return_index=True)
        best = good[one]
        at[winner], chosen[0, winner], chosen[1, winner] = best, who[span[best]], where[span[best]]
        for row, x in zip(winner.tolist(), span[best].tolist(), strict=True) if device else ():
            devised[row] = [int(d[x]) for d in device]
    done = at >= 0
    ids = pa.array(held["id"], schema.field("technician_id").type)
    taken = lambda i: ids.take(pa.array(i, pa.int64(), mask=~done))
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in devised])]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, ids.take(pa.array([i for x in devised for i in x], pa.int64())))
    of = np.maximum(at, 0)
    columns = [tasks.column("task_id").combine_chunks(), pa.array(start[of], mask=~done), pa.array(end[of], mask=~done), taken(chosen[0]), taken(chosen[1]), lists, *map(pa.array, flags)]
    return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
