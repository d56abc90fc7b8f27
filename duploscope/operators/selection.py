"""Rules that propose which copies to give up, and the guards around a selection.

Members carry a boolean `selected`. Keepers are found by aggregates that combine before the shuffle,
never by sorting a group, so a group may be of any size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("keep_newest", "keep_oldest", "prefer_location", "select_outside_location")


def clear_selection(members: DataFrame) -> DataFrame:
    return members.withColumn("selected", F.lit(False))


def keepers(members: DataFrame, rule: str, location: str | None = None) -> DataFrame:
    """(group_id, keeper_id) by age, path without case, and identity.

    The location rules keep the first in that order that lies in the location; groups without one,
    and all groups when the location is blank, get no keeper.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    order = F.struct(F.col("modified_at"), F.upper("path"), F.col("identity.id_low"), F.col("item_id"))
    pick = F.max_by if rule == "keep_newest" else F.min_by
    if rule in ("prefer_location", "select_outside_location"):
        wanted = (location or "").strip().upper()
        members = members.filter(F.upper("location") == location.upper()) if wanted else members.limit(0)
    return members.groupBy("group_id").agg(pick("item_id", order).alias("keeper_id"))


def propose(
    members: DataFrame, rule: str, location: str | None = None, scope: DataFrame | None = None
) -> DataFrame:
    """Members to give up: all of a group but its keeper, hidden ones included.

    `scope` limits the proposal to some groups, as by `visible_groups`.
    """
    if scope is not None:
        members = members.join(scope.select("group_id"), "group_id", "left_semi")
    return members.join(keepers(members, rule, location), "group_id").filter("item_id <> keeper_id")


def proposal_summary(proposal: DataFrame) -> DataFrame:
    """One row: proposed members, their bytes, affected groups."""
    per_group = proposal.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    return per_group.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("proposed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("proposed_bytes"),
        F.count(F.lit(1)).alias("affected_groups"),
    )


class Applied(NamedTuple):
    members: DataFrame
    previous: DataFrame


def apply_proposal(members: DataFrame, proposal: DataFrame) -> Applied:
    """Replace the selection inside the affected groups, all of them or none.

    Fails when a group would lose every member. `previous` holds the old flags for `undo`.
    """
    wanted = proposal.select("group_id", "item_id", F.lit(True).alias("_wanted"))
    affected = proposal.groupBy("group_id").agg(F.count_distinct("item_id").alias("_n"))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_members"))
    emptied = affected.join(sizes, "group_id").filter("_n >= _members")
    if not emptied.isEmpty():
        raise ValueError("the proposal would select every member of a group")
    marked = members.join(affected.select("group_id", F.lit(True).alias("_affected")), "group_id", "left")
    previous = marked.filter("_affected").select("group_id", "item_id", "selected")
    applied = (
        marked.join(wanted, ["group_id", "item_id"], "left")
        .withColumn("selected", F.when(F.col("_affected"), F.coalesce("_wanted", F.lit(False))).otherwise(F.col("selected")))
        .drop("_affected", "_wanted")
    )
    return Applied(applied.select(*members.columns), previous)


def undo(members: DataFrame, previous: DataFrame) -> DataFrame:
    """Put the flags of the touched members back."""
    before = previous.select("group_id", "item_id", F.col("selected").alias("_before"))
    return (
        members.join(before, ["group_id", "item_id"], "left")
        .withColumn("selected", F.coalesce("_before", "selected"))
        .select(*members.columns)
    )


class Guarded(NamedTuple):
    members: DataFrame
    refused: DataFrame


def guard_survivor(members: DataFrame, requests: DataFrame) -> Guarded:
    """Select the requested members (item_id, request_no, and group_id where ids may repeat) one after the other, but never the
    last free one.

    Requests name different free members, so a group can run out only when all its free members are
    requested, and then exactly the last request is refused: no request has to be replayed in order.
    """
    named = ["group_id", "item_id"] if "group_id" in requests.columns else ["item_id"]
    asked = requests.groupBy(*named).agg(F.min("request_no").alias("_no"))
    pending = members.filter("not selected").join(asked, named).select("item_id", "group_id", "_no")
    last = pending.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("_asked"), F.max_by("item_id", F.struct("_no", "item_id")).alias("item_id")
    )
    free = members.groupBy("group_id").agg(F.count_if(~F.col("selected")).alias("_free"))
    refused = last.join(free, "group_id").filter("_asked >= _free").select("item_id", "group_id")
    member = ["group_id", "item_id"]
    granted = pending.join(refused, member, "left_anti").select(*member, F.lit(True).alias("_granted"))
    selected = members.join(granted, member, "left").withColumn(
        "selected", F.col("selected") | F.coalesce("_granted", F.lit(False))
    )
    return Guarded(selected.select(*members.columns), refused)
