"""First-fit interval scheduling.

Whether a combination fits changes only where an availability or an ability
begins or a reservation ends, so the candidate starts of a task are its earliest
start and those moments, rounded up to the minute grid that begins at the
earliest start.  All conditions are joins on a store or on (kind, id) with
half-open interval predicates; the earliest start decides, then the given order
of technicians, workstations and equipment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from paperloom.operators import placement
from paperloom.operators.sizing import small

REASONS = ("scope_mismatch", "window_too_short", "no_qualified_technician", "no_compatible_workstation", "no_required_equipment", "resource_conflict", "no_available_time")
OPEN_FROM, OPEN_UNTIL = 8, 18


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Of half-open intervals: touching ones don't."""
    return (a_start < b_end) & (b_start < a_end)


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (end <= outer_end)


def valid_throughout(valid_from: Column, valid_until: Column, start: Column, end: Column) -> Column:
    return F.coalesce(valid_from <= start, F.lit(True)) & F.coalesce(end <= valid_until, F.lit(True))


def has_all(required: Column, held: Column) -> Column:
    return F.size(F.array_except(F.coalesce(required, F.array().cast("array<string>")), held)) == 0


def plan_resources(technician: Column, workstation: Column, equipment: Column) -> Column:
    return F.array_union(F.array(technician, workstation), equipment)


def planning_day(resources: DataFrame, moment: Column) -> DataFrame:
    """Resources available on the day of moment, 8 to 18 UTC."""
    day = F.date_trunc("day", moment)
    slot = F.struct((day + F.make_dt_interval(hours=F.lit(OPEN_FROM))).alias("start"), (day + F.make_dt_interval(hours=F.lit(OPEN_UNTIL))).alias("end"))
    return resources.withColumn("availability", F.array(slot))


def store_resources(technicians: DataFrame, links: DataFrame, capabilities: DataFrame, workstations: DataFrame, equipment: DataFrame, moment: Column) -> DataFrame:
    """Resources (kind, ord, id, store_id, type, availability, abilities) of the
    stored tables on the day of moment: technicians with the capabilities that
    links (technician_id, capability_id, valid_from, valid_until) give them.
    The order within a kind is that of the ids."""
    skill = links.join(capabilities.select(F.col("id").alias("capability_id"), F.col("code").alias("skill")), "capability_id")
    held = skill.groupBy(F.col("technician_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("skill", "valid_from", "valid_until"))).alias("abilities"))
    none = F.array().cast("array<struct<skill:string,valid_from:timestamp,valid_until:timestamp>>")
    rows = technicians.join(held, "id", "left").select(F.lit("technician").alias("kind"), "id", "store_id", F.lit(None).cast("string").alias("type"), F.coalesce("abilities", none).alias("abilities"))
    for df, kind, column in ((workstations, "workstation", "workstation_type"), (equipment, "equipment", "equipment_type")):
        rows = rows.unionByName(df.select(F.lit(kind).alias("kind"), "id", "store_id", F.col(column).alias("type"), none.alias("abilities")))
    ordered = rows.withColumn("ord", F.row_number().over(Window.partitionBy("store_id", "kind").orderBy("id")))
    return planning_day(ordered, moment)


def catalogue_tasks(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """requests (request_id, service_type, scheduled_at, category, powertrain)
    with the operation of the catalogue (code, brand, store_id, duration_minutes,
    required_skills, required_workstation_types, required_equipment_types) as
    tasks within an hour of the wished time; an unknown service is an error."""
    joined = requests.join(small(catalogue), F.col("service_type") == F.col("code"), "left")
    code = F.when(F.col("code").isNotNull(), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("not in the catalogue: "), F.coalesce("service_type", F.lit("null")))).cast("string"))
    window = requested_window(F.col("scheduled_at"))
    return joined.select(F.col("request_id").alias("task_id"), code.alias("service_code"), "brand", "store_id", "category", "powertrain", "duration_minutes", window["earliest_start"].alias("earliest_start"), window["latest_end"].alias("latest_end"), "required_skills", "required_workstation_types", "required_equipment_types", F.lit(None).cast("array<string>").alias("allowed_technician_ids"))


def requested_window(preferred: Column, around_hours: int = 1) -> Column:
    wide = F.make_dt_interval(hours=F.lit(around_hours))
    return F.struct((preferred - wide).alias("earliest_start"), (preferred + wide).alias("latest_end"))


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n)


def conflicts(wanted: DataFrame, reservations: DataFrame) -> DataFrame:
    """Rows of wanted (kind, id, start, end, ...) that an ACTIVE reservation
    overlaps; joined by resource first."""
    r = reservations.where("status = 'ACTIVE'").select(F.col("resource_type").alias("kind"), F.col("resource_id").alias("id"), F.col("start_time").alias("_s"), F.col("end_time").alias("_e"))
    hit = (wanted["kind"] == r["kind"]) & (wanted["id"] == r["id"]) & overlaps(wanted["start"], wanted["end"], F.col("_s"), F.col("_e"))
    return wanted.join(r, hit, "left_semi")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...], width: str = "day") -> DataFrame:
    """Pairs of left (*keys, start, end) and right (*keys, start_time, end_time)
    rows whose half-open intervals overlap.  Both sides are spread over the
    `width` steps of the calendar that they touch and joined on keys and step; a
    pair counts in the step in which the later of the two begins, so once."""
    def spread(df: DataFrame, a: str, b: str) -> DataFrame:
        last = F.date_trunc(width, F.col(b) - F.expr("INTERVAL 1 MICROSECOND"))
        return df.where(F.col(a) < F.col(b)).withColumn("_step", F.explode(F.sequence(F.date_trunc(width, a), last, F.expr(f"INTERVAL 1 {width}"))))

    both = spread(left, "start", "end").join(spread(right, "start_time", "end_time"), [*keys, "_step"])
    once = F.col("_step") == F.date_trunc(width, F.greatest("start", "start_time"))
    return both.where(once & overlaps(F.col("start"), F.col("end"), F.col("start_time"), F.col("end_time"))).drop("_step")


def free_intervals(resources: DataFrame, reservations: DataFrame) -> DataFrame:
    """resources with free: what its ACTIVE reservations leave of each
    availability, worked out once for each resource."""
    slot = "array<struct<start:timestamp,end:timestamp>>"
    booked = reservations.where("status = 'ACTIVE' and start_time < end_time").groupBy(F.col("resource_type").alias("kind"), F.col("resource_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end")))).alias("_booked"))
    held = resources.join(booked, ["kind", "id"], "left").withColumn("_booked", F.coalesce("_booked", F.array().cast(slot)))

    def left_of(a: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            gap = F.array(F.struct(acc["at"].alias("start"), F.least(r["start"], a["end"]).alias("end")))
            opens = (r["start"] > acc["at"]) & (acc["at"] < a["end"])
            return F.struct(F.greatest(acc["at"], r["end"]).alias("at"), F.when(opens, F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

        whole = lambda acc: F.when(acc["at"] < a["end"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), a["end"].alias("end"))))).otherwise(acc["out"])
        return F.aggregate("_booked", F.struct(a["start"].alias("at"), F.array().cast(slot).alias("out")), step, whole)

    return held.withColumn("free", F.flatten(F.transform("availability", left_of))).drop("_booked")


def _able(resources: DataFrame, reservations: DataFrame) -> DataFrame:
    """Resources as placement.placed() reads them, times as microseconds: what is
    available and free, abilities, and the moments at which feasibility can change
    (at: availability and abilities begin; freed: ACTIVE reservations end)."""
    freed = reservations.where("status = 'ACTIVE'").groupBy(F.col("resource_type").alias("kind"), F.col("resource_id").alias("id")).agg(F.collect_set(F.unix_micros("end_time")).alias("freed"))
    held = free_intervals(resources, reservations).where("store_id is not null").join(freed, ["kind", "id"], "left")
    abilities = F.coalesce("abilities", F.array().cast("array<struct<skill:string,valid_from:timestamp,valid_until:timestamp>>"))
    times = lambda c, f: F.transform(c, lambda a: F.unix_micros(a[f]))
    ends = [times(c, f).alias(f"{c}_{f}") for c in ("availability", "free") for f in ("start", "end")]
    return held.select("store_id", "kind", "id", "ord", "type", *ends, F.transform(abilities, lambda a: a["skill"]).alias("skill"), times(abilities, "valid_from").alias("valid_from"), times(abilities, "valid_until").alias("valid_until"), F.concat(times("availability", "start"), times(abilities, "valid_from")).alias("at"), "freed")


def plan(tasks: DataFrame, resources: DataFrame, reservations: DataFrame, vehicle: dict[str, str] | None = None) -> DataFrame:
    """One row per task: task_id, status, start, end, technician_id,
    workstation_id, equipment_ids, reasons.  vehicle: brand, store_id, category
    and powertrain that a task must match.

    The tasks of a store, a block at a time, meet its resources in one place, so
    neither candidate starts nor their pairs with resources are shuffled; rows of
    one task_id are merged."""
    scope = F.lit(True)
    for k, v in (vehicle or {}).items():
        scope = scope & (F.col(k) == v)
    none = F.array().cast("array<string>")
    tasks = tasks.withColumn("_scope", scope).withColumn("_fits", F.col("earliest_start") + _minutes(F.col("duration_minutes")) <= F.col("latest_end"))
    tasks = tasks.withColumn("_types", F.array_sort(F.array_distinct(F.coalesce("required_equipment_types", none))))
    open_ = tasks.where("_scope and _fits").select(
        "store_id", "task_id", F.unix_micros("earliest_start").alias("early"), F.unix_micros("latest_end").alias("late"), F.col("duration_minutes").cast("long").alias("length"),
        "required_skills", F.coalesce("required_workstation_types", none).alias("_places"), "allowed_technician_ids", "_types",
    )
    # blocks of the tasks of a store, each with the resources of the store
    sizes = open_.groupBy(F.col("store_id").alias("_of")).agg(F.ceil(F.count("*") / placement.TASKS).cast("int").alias("_blocks"))
    asked = open_.join(sizes, F.col("store_id").eqNullSafe(F.col("_of")), "left").withColumn("_block", F.pmod(F.xxhash64("task_id"), F.col("_blocks"))).drop("_of", "_blocks")
    able = _able(resources, reservations).join(sizes, F.col("store_id") == F.col("_of")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1))).drop("_of", "_blocks")
    key = resources.schema["id"].dataType
    schema = StructType([tasks.schema["task_id"], *[StructField(c, LongType()) for c in ("start", "end")], StructField("technician_id", key), StructField("workstation_id", key), StructField("equipment_ids", ArrayType(key)), *[StructField(c, BooleanType()) for c in "twe"]])
    arrow = to_arrow_schema(schema)
    found = asked.groupBy("store_id", "_block").cogroup(able.groupBy("store_id", "_block")).applyInArrow(lambda left, right: placement.placed(left, right, arrow), schema)
    chosen = F.struct(F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "technician_id", "workstation_id", "equipment_ids")
    by_task = found.groupBy("task_id").agg(F.min(F.when(F.col("start").isNotNull(), chosen)).alias("b"), *[F.bool_or(c).alias(c) for c in "twe"])
    out = tasks.join(by_task, "task_id", "left")
    missing = F.array_compact(F.array(F.when(~F.col("t"), "no_qualified_technician"), F.when(~F.col("w"), "no_compatible_workstation"), F.when(~F.col("e"), "no_required_equipment")))
    done = F.col("b").isNotNull()
    reasons = F.when(~F.col("_scope"), F.array(F.lit("scope_mismatch"))).when(~F.col("_fits"), F.array(F.lit("window_too_short"))).when(done, none).when(F.size(missing) > 0, missing).otherwise(F.array(F.lit("resource_conflict"), F.lit("no_available_time")))
    return out.select("task_id", F.when(done, "FEASIBLE").otherwise("INFEASIBLE").alias("status"), "b.start", "b.end", "b.technician_id", "b.workstation_id", "b.equipment_ids", reasons.alias("reasons"))


def invalid(tasks: DataFrame) -> DataFrame:
    return tasks.where("duration_minutes is null or duration_minutes <= 0 or earliest_start >= latest_end")
