"""Work orders as commands folded into events, orders and reservations.

Commands run in (created_at, command_id) order.  Those that can touch each other
(one order, one idempotency key or one resource) form a conflict group; groups
are folded independently, so unrelated stores run in parallel and within a group
the first command on an overlapping resource wins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Transitions: fixed values.
TRANSITIONS = {"CONFIRMED": ("CHECKED_IN", "CANCELLED"), "CHECKED_IN": ("COMPLETED",), "COMPLETED": (), "CANCELLED": ()}
RESULTS = "command_id long, order_key string, event_type string, from_status string, to_status string, result string, version int"


def allowed(before: Column, after: Column) -> Column:
    pairs = [F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs]
    return F.coalesce(F.concat_ws(">", before, after).isin(*pairs), F.lit(False))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def token_result(given: Column, stored_hash: Column, expires_at: Column, used_at: Column, now: Column) -> Column:
    return F.when(used_at.isNotNull(), "plan_already_used").when(expires_at <= now, "plan_expired").when(~token_hash(given).eqNullSafe(stored_hash), "invalid_token").otherwise("ok")


def used_plans(plans: DataFrame, uses: DataFrame) -> DataFrame:
    """plans (plan_id, token_hash, expires_at) and uses (command_id, plan_id,
    token, at, order_key) -> uses with result.  A plan is used once: of the valid
    uses of one plan the first by time and command counts, later ones are told
    so; one that is missing, late, or has no or another token is refused."""
    known = uses.join(plans.select("plan_id", "token_hash", "expires_at"), "plan_id", "left")
    wrong = (
        F.when(F.coalesce(F.col("token"), F.lit("")) == "", "confirmation_required").when(F.col("token_hash").isNull(), "plan_not_found")
        .when(F.coalesce(F.col("expires_at") <= F.col("at"), F.lit(False)), "plan_expired").when(~token_hash(F.col("token")).eqNullSafe(F.col("token_hash")), "invalid_token")
    )
    judged = known.withColumn("_wrong", wrong)
    first = judged.where("_wrong is null").groupBy("plan_id").agg(F.min(F.struct("at", "command_id")).alias("_first"))
    placed = judged.join(first, "plan_id", "left")
    result = F.when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(F.struct("at", "command_id") == F.col("_first"), "ok").otherwise("plan_already_used")
    return placed.select("command_id", "plan_id", "order_key", "at", result.alias("result"))


def plan_states(plans: DataFrame, used: DataFrame) -> DataFrame:
    """plans with status CONFIRMED, USED or SUPERSEDED, used_at, and for those
    that a later plan of the same order took over superseded_at and by_plan_id."""
    ok = used.where("result = 'ok'")
    w = Window.partitionBy("order_key").orderBy("at", "command_id")
    after = ok.select("plan_id", F.col("at").alias("used_at"), F.lead("at").over(w).alias("superseded_at"), F.lead("plan_id").over(w).alias("by_plan_id"))
    status = F.when(F.col("used_at").isNull(), "CONFIRMED").when(F.col("by_plan_id").isNotNull(), "SUPERSEDED").otherwise("USED")
    return plans.join(after, "plan_id", "left").withColumn("status", status)


#: What a caller is shown of an order: fixed values.
SHOWN = ("order_no", "store_id", "service_code", "service_name", "service_summary", "scheduled_start", "scheduled_end", "technician_id", "workstation_id", "status", "customer_note", "ai_service_summary", "version")


def shown(orders: DataFrame) -> DataFrame:
    return orders.select(*SHOWN)


def first_of_each_key(commands: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Commands whose idempotency key is new; of several the first."""
    keyed = commands.withColumn("_k", F.row_number().over(Window.partitionBy(F.coalesce("idempotency_key", F.concat(F.lit("#"), F.col("command_id").cast("string")))).orderBy("command_id"))).where("_k = 1").drop("_k")
    return keyed if known is None else keyed.join(known.select("idempotency_key").where("idempotency_key is not null"), "idempotency_key", "left_anti")


def reservations_of(orders: DataFrame) -> DataFrame:
    """A row for the technician, the workstation and each device of an order."""
    held = F.concat(
        F.array(F.struct(F.lit("technician").alias("resource_type"), F.col("technician_id").alias("resource_id")), F.struct(F.lit("workstation").alias("resource_type"), F.col("workstation_id").alias("resource_id"))),
        F.transform(F.coalesce("equipment_ids", F.array().cast("array<string>")), lambda e: F.struct(F.lit("equipment").alias("resource_type"), e.alias("resource_id"))),
    )
    status = F.when(F.col("status") == "CANCELLED", "CANCELLED").when(F.col("status") == "COMPLETED", "COMPLETED").otherwise("ACTIVE")
    return orders.select("order_key", "start_time", "end_time", status.alias("status"), F.explode(held).alias("r")).select("order_key", "r.*", "start_time", "end_time", "status")


def fold(commands: Iterable[dict]) -> list[dict]:
    """Results of one conflict group's commands, in order.  Orders that hold a
    resource are found by the resource."""
    orders: dict[str, dict] = {}
    holders: dict[tuple, set[str]] = defaultdict(set)
    keys: dict[str, str] = {}
    out = []
    for c in commands:
        key, kind = c["order_key"], c["kind"]
        order, result, was, now = orders.get(key), "ok", None, None
        mine = [("technician", c["technician_id"]), ("workstation", c["workstation_id"]), *(("equipment", e) for e in (c["equipment_ids"] if c["equipment_ids"] is not None else ()))]
        near = {k for r in mine for k in holders[r]} - {key} if kind in ("create", "reschedule") else ()
        taken = any(orders[k]["start"] < c["end_time"] and c["start_time"] < orders[k]["end"] for k in near)
        if kind == "create":
            if c["idempotency_key"] is not None and c["idempotency_key"] in keys:
                result, key = "existing", keys[c["idempotency_key"]]
            elif order is not None:
                result = "existing"
            elif taken:
                result = "reservation_conflict"
            else:
                order = orders[key] = {"status": "CONFIRMED", "held": mine, "start": c["start_time"], "end": c["end_time"], "version": 1}
                keys[c["idempotency_key"]] = key
                now = "CONFIRMED"
                for r in mine:
                    holders[r].add(key)
        elif order is None:
            result = "not_found"
        else:
            was = order["status"]
            to = {"cancel": "CANCELLED", "check_in": "CHECKED_IN", "complete": "COMPLETED", "reschedule": "CONFIRMED"}.get(kind)
            if to is None:
                result = "unknown_command"
            elif kind in ("check_in", "complete") and c["actor_role"] != "SERVICE_ADVISOR":
                result = "forbidden"
            elif kind == "reschedule" and was != "CONFIRMED" or kind != "reschedule" and to not in TRANSITIONS[was]:
                result = "invalid_transition"
            elif taken:
                result = "reservation_conflict"
            else:
                for r in order["held"] if kind in ("reschedule", "cancel", "complete") else ():
                    holders[r].discard(key)
                if kind == "reschedule":
                    for r in mine:
                        holders[r].add(key)
                    order |= {"held": mine, "start": c["start_time"], "end": c["end_time"]}
                order["status"], now = to, to
                order["version"] += 1
        out.append({"command_id": c["command_id"], "order_key": key, "event_type": kind.upper(), "from_status": was, "to_status": now, "result": result, "version": orders[key]["version"] if key in orders else None})
    return out


def apply_commands(commands: DataFrame, group_col: str) -> DataFrame:
    """Events and refusals of all commands; group_col is a key that no two
    commands that touch each other differ in (a store, say)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("command_id").astype(object).where(pdf.notna(), None).to_dict("records")
        return pd.DataFrame(fold(rows), columns=["command_id", "order_key", "event_type", "from_status", "to_status", "result", "version"]).astype({"version": "Int32"})

    return commands.groupBy(group_col).applyInPandas(run, RESULTS)


def invalid_transitions(events: DataFrame) -> DataFrame:
    """events (order_key, seq, to_status): with from_status and whether the step
    is allowed; the first status must be CONFIRMED."""
    was = F.lag("to_status").over(Window.partitionBy("order_key").orderBy("seq"))
    out = events.withColumn("from_status", was)
    return out.withColumn("allowed", F.when(F.col("from_status").isNull(), F.col("to_status") == "CONFIRMED").otherwise(allowed(F.col("from_status"), F.col("to_status"))))


def latest(events: DataFrame) -> DataFrame:
    return events.groupBy("order_key").agg(F.max_by("to_status", "seq").alias("status"), F.count("*").alias("version"))


def visible(orders: DataFrame, role: str, user_id: str) -> DataFrame:
    """Customers see their own rows."""
    return orders.where(F.col("customer_user_id") == user_id) if role == "CUSTOMER" else orders


def listing(orders: DataFrame, owner: str | None = None, status: str | None = None) -> DataFrame:
    if owner is not None:
        orders = orders.where(F.col("customer_user_id") == owner)
    if status is not None:
        orders = orders.where(F.col("status") == status)
    return orders.orderBy(F.desc("created_at"))
