"""The pair table: seeding, resetting, claiming and guarded routing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from verdictflow import schemas, vocab as V
from verdictflow.functions import keys


def queued_pairs(candidates: DataFrame, subject_id: str | None = None) -> DataFrame:
    """Candidate pairs with defaults filled in; rows without both ids are dropped."""
    rows = candidates if subject_id is None else candidates.where(F.col("subject_id") == subject_id)
    has_ids = (F.coalesce("a_id", F.lit("")) != "") & (F.coalesce("b_id", F.lit("")) != "")
    return rows.where(has_ids).withColumns({
        "rank": F.coalesce("rank", F.lit(0)).cast("int"),
        "with_context": F.coalesce("with_context", F.lit(False)),
        "human_asserted": F.coalesce("human_asserted", F.lit(False)),
    })


def attach_runs(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs to the pairs of their subject; a run that names no subject has none.

    AQE splits a subject that holds a large share of the pairs.
    """
    named = runs.select("subject_id", "stage3_run_id", "intake_id").where(
        F.coalesce("subject_id", F.lit("")) != ""
    )
    return candidates.join(named, "subject_id")


def resolve_subject(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """The subject each request is about, '' where the run is unknown."""
    return requests.join(
        runs.select("stage3_run_id", "subject_id"), "stage3_run_id", "left"
    ).withColumn("subject_id", F.coalesce("subject_id", F.lit("")))


def seed_pairs(state: DataFrame, candidates: DataFrame) -> DataFrame:
    """New pair rows: only pairs that have none yet.

    ``candidates`` carry ``stage3_run_id`` and ``intake_id``. The two directions
    of one pair are one row; the lowest rank wins, then the smaller first id.
    """
    named = queued_pairs(candidates).withColumn(
        "pair_id", keys.pair_key("stage3_run_id", "a_id", "b_id")
    )
    # Duplicates collapse map-side before anything is shuffled.
    single = (
        named.groupBy("pair_id")
        .agg(
            F.min(F.struct(
                "rank", "a_id", "b_id", "stage3_run_id", "intake_id",
                "with_context", "human_asserted",
            )).alias("row")
        )
        .select("pair_id", "row.*")
    )
    fresh = single.join(state.select("pair_id"), "pair_id", "left_anti")
    return _initial(fresh).select(*schemas.PAIR_STATE.fieldNames())


def _initial(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({
        "low_id": keys.claim_id_low("a_id", "b_id"),
        "high_id": keys.claim_id_high("a_id", "b_id"),
        **_start_values(),
    })


def _start_values() -> dict[str, Column]:
    return {
        "tier": F.lit(V.TIER_CASCADE),
        "gate": F.lit(V.G1),
        "contradiction_flag": F.lit(False),
        "decided_by": F.lit(None).cast("string"),
        "run_request_id": F.lit(None).cast("string"),
    }


def reset_pairs(state: DataFrame, run_id: str | Column) -> DataFrame:
    """Put every pair of a run back to the start; other runs are untouched."""
    mine = F.coalesce(F.col("stage3_run_id") == run_id, F.lit(False))
    values = _start_values()
    if "lease_owner" in state.columns:
        values["lease_owner"] = F.lit(None).cast("string")
        values["lease_expires_at"] = F.lit(None).cast("timestamp")
    return state.withColumns({
        name: F.when(mine, value).otherwise(F.col(name)) for name, value in values.items()
    })


def lease_held(expires: Column | str, as_of: Column) -> Column:
    column = F.col(expires) if isinstance(expires, str) else expires
    return F.coalesce(column > as_of, F.lit(False))


def claim_batch(
    state: DataFrame, run_id: str, gate: str, limit: int, as_of: Column | None = None
) -> DataFrame:
    """The next ``limit`` free pairs at a gate in (rank, pair_id) order."""
    free = state.where((F.col("stage3_run_id") == run_id) & (F.col("gate") == gate))
    if as_of is not None and "lease_expires_at" in state.columns:
        free = free.where(~lease_held("lease_expires_at", as_of))
    return free.orderBy("rank", "pair_id").limit(limit)


def count_at_gate(state: DataFrame) -> DataFrame:
    return state.groupBy("stage3_run_id", "gate").agg(F.count(F.lit(1)).alias("pairs"))


def count_decided_by(state: DataFrame) -> DataFrame:
    return state.groupBy("stage3_run_id", "decided_by").agg(F.count(F.lit(1)).alias("pairs"))


ROUTE_FIELDS = ("gate", "tier", "decided_by", "contradiction_flag", "run_request_id")


def guarded_routes(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply routing updates to pairs that are still where they were claimed.

    ``updates(pair_id, claimed_gate, claimed_owner, route)`` with ``route`` a
    struct of the routing fields, one row per pair. Returns the new state with
    ``applied``: true, false for an update that came too late, null without one.
    """
    joined = state.join(
        updates.select("pair_id", "claimed_gate", "claimed_owner", "route"), "pair_id", "left"
    )
    owner = F.col("lease_owner") if "lease_owner" in state.columns else F.lit(None).cast("string")
    holds = F.col("gate").eqNullSafe(F.col("claimed_gate")) & owner.eqNullSafe(
        F.col("claimed_owner")
    )
    marked = joined.withColumn("applied", F.when(F.col("route").isNotNull(), holds))
    current = F.coalesce("applied", F.lit(False))
    fields: dict[str, Column] = {
        name: F.when(current, F.col(f"route.{name}")).otherwise(F.col(name))
        for name in ROUTE_FIELDS
    }
    if "lease_owner" in state.columns:
        for name, kind in (("lease_owner", "string"), ("lease_expires_at", "timestamp")):
            fields[name] = F.when(current, F.lit(None).cast(kind)).otherwise(F.col(name))
    return marked.select(
        *[fields.get(name, F.col(name)).alias(name) for name in state.columns], "applied"
    )


def distinct_claim_ids(pairs: DataFrame) -> DataFrame:
    """Every claim the pairs name, once."""
    return (
        pairs.select(F.explode(F.array("a_id", "b_id")).alias("claim_id"))
        .where(F.coalesce("claim_id", F.lit("")) != "")
        .distinct()
    )


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Rows of branches that carry the same columns, by name."""
    parts = list(parts)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
