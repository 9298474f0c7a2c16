"""Verdict rows: building, merging, purging, reading slots back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from verdictflow import schemas, vocab as V
from verdictflow.functions import keys
from verdictflow.functions.stage_scores import g1_from_slot

_SLOT_TYPES = {field.name: field.dataType for field in schemas.STAGE_SCORES}


def stage_scores(slots: Mapping[str, Column]) -> Column:
    """The nested score record with the slots a gate owns; the others are null."""
    return F.struct(*[
        slots.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _SLOT_TYPES.items()
    ])


def edge_updates(
    judged: DataFrame,
    *,
    method: str,
    slot: tuple[str, Column] | None,
    relation: Column,
    confidence: Column | None = None,
    escalation_reason: Column | None = None,
    truncated: Column | None = None,
    rationale: Column | None = None,
    temporal_note: Column | None = None,
    shadow_verdict: Column | None = None,
    attempt: Column | None = None,
    judge_model: Column | None = None,
    mode: Column | None = None,
    seq: int = 1,
    scores: Column | None = None,
    method_column: Column | None = None,
) -> DataFrame:
    """What one gate adds to its pairs' verdict rows.

    ``judged`` carries the pair columns plus ``subject_id`` and
    ``run_request_id``. In SHADOW mode the same content goes under ``shadow``
    and the row itself asserts nothing about the pair. ``scores`` and
    ``method_column`` replace ``slot`` and ``method`` for jobs that cover several
    gates at once.
    """

    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    mode = F.lit(V.MODE_DECIDING) if mode is None else mode
    shadow = mode == V.MODE_SHADOW
    deciding = ~shadow
    reason = null("string") if escalation_reason is None else escalation_reason
    if scores is None:
        scores = stage_scores({} if slot is None else {slot[0]: slot[1]})
    who = F.lit(method) if method_column is None else method_column
    verdict = relation if shadow_verdict is None else F.coalesce(shadow_verdict, relation)

    def own(value: Column | None, kind: str) -> Column:
        return null(kind) if value is None else F.when(deciding, value.cast(kind))

    return judged.select(
        keys.edge_key("a_id", "b_id", "with_context").alias("key"),
        "subject_id",
        keys.claim_id_low("a_id", "b_id").alias("low_id"),
        keys.claim_id_high("a_id", "b_id").alias("high_id"),
        F.coalesce("with_context", F.lit(False)).alias("with_context"),
        "intake_id",
        "stage3_run_id",
        "run_request_id",
        who.alias("method"),
        (F.lit(1) if attempt is None else attempt).cast("int").alias("attempt"),
        scores.alias("stage_scores"),
        own(judge_model if judge_model is not None else F.lit(""), "string").alias("judge_model"),
        own(truncated if truncated is not None else F.lit(False), "boolean").alias("truncated"),
        own(relation, "string").alias("relation"),
        own(confidence, "double").alias("confidence"),
        own(reason, "string").alias("escalation_reason"),
        own(rationale, "string").alias("rationale"),
        own(temporal_note, "string").alias("temporal_note"),
        F.when(
            shadow,
            F.struct(
                verdict.cast("string").alias("verdict"),
                who.alias("method"),
                F.col("run_request_id"),
                reason.cast("string").alias("escalation_reason"),
                scores.alias("stage_scores"),
            ),
        ).alias("shadow"),
        F.lit(seq).alias("seq"),
    )


# --- merging --------------------------------------------------------------------------
#
# A field an update does not set is left as it was. Shadow fields other than
# scores are the exception: an update under ``shadow`` writes all of them, null
# included. Score slots merge number by number.


def _leaves(kind: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found = []
    for field in kind.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            found += _leaves(field.dataType, here)
        else:
            found.append(here)
    return found


_MERGED = T.StructType([
    field for field in schemas.EDGES
    if field.name not in ("key", "created_at", "updated_at")
])
_LEAVES = {path: f"_m{number}" for number, path in enumerate(_leaves(_MERGED))}


def _rebuild(kind: T.StructType, path: tuple[str, ...]) -> str:
    """SQL for a struct out of the flat columns; null when all of them are."""
    members = []
    for field in kind.fields:
        here = (*path, field.name)
        inner = field.dataType
        value = _rebuild(inner, here) if isinstance(inner, T.StructType) else _LEAVES[here]
        members.append(f"'{field.name}', {value}")
    filled = " OR ".join(f"{_LEAVES[leaf]} IS NOT NULL" for leaf in _leaves(kind, path))
    return f"CASE WHEN {filled} THEN named_struct({', '.join(members)}) END"


def _nested() -> list[str]:
    """Select list that turns the flat columns back into the table's columns."""
    return [
        f"{_rebuild(field.dataType, (field.name,))} AS {field.name}"
        if isinstance(field.dataType, T.StructType)
        else f"{_LEAVES[(field.name,)]} AS {field.name}"
        for field in _MERGED.fields
    ]


def _overwrites(path: tuple[str, ...]) -> bool:
    return path[0] == "shadow" and path[1] != "stage_scores"


def combine_updates(updates: DataFrame) -> DataFrame:
    """Several updates of one row into one, applied in ``seq`` order.

    A key has as many updates as gates touched it, so groups are tiny.
    """
    latest = []
    for path, name in _LEAVES.items():
        value = ".".join(path)
        counts = "shadow" if _overwrites(path) else value
        latest.append(F.expr(
            f"max_by({value}, CASE WHEN {counts} IS NOT NULL THEN seq END) AS {name}"
        ))
    return updates.groupBy("key").agg(*latest).selectExpr("key", *_nested())


def merge_edges(
    current: DataFrame, updates: DataFrame, as_of: Column, *, combined: bool = False
) -> DataFrame:
    """Upsert: the new table after ``updates`` have been applied to ``current``.

    Keys are unique on both sides, so no key is hot. The first ``created_at``
    stays. Pass ``combined=True`` when every key occurs once in ``updates``.
    """
    fields = F.struct(*_MERGED.fieldNames())
    new = (updates if combined else combine_updates(updates)).select("key", fields.alias("_new"))
    old = current.select("key", fields.alias("_old"), "created_at", "updated_at")
    merged = []
    for path, name in _LEAVES.items():
        fresh, stale = ".".join(("_new", *path)), ".".join(("_old", *path))
        value = (
            f"CASE WHEN _new.shadow IS NOT NULL THEN {fresh} ELSE {stale} END"
            if _overwrites(path) else f"coalesce({fresh}, {stale})"
        )
        merged.append(F.expr(f"{value} AS {name}"))
    # Merged numbers are plain columns before they are put into structs, so that
    # nothing that reads a member of a struct later repeats the merging.
    flat = old.join(new, "key", "full_outer").select(
        "key",
        *merged,
        F.coalesce("created_at", as_of).alias("created_at"),
        F.when(F.col("_new").isNotNull(), as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return flat.selectExpr("key", *_nested(), "created_at", "updated_at")


def is_own_row(run_id: str | Column) -> Column:
    """Rows a purge of this run removes: its own, by one of the four methods."""
    return F.coalesce(
        (F.col("stage3_run_id") == run_id) & F.col("method").isin(*V.OWN_METHODS), F.lit(False)
    )


def purge_edges(edges: DataFrame, run_id: str | Column) -> DataFrame:
    """Everything but this run's own verdicts; other judges' rows survive."""
    return edges.where(~is_own_row(run_id))


def count_purged(edges: DataFrame, run_id: str | Column) -> DataFrame:
    return edges.where(is_own_row(run_id)).agg(F.count(F.lit(1)).alias("purged"))


def read_slot(edges: DataFrame, slot: str, wanted: DataFrame | None = None) -> DataFrame:
    """(key, slot) of rows that have the slot; only that slot is read from disk."""
    rows = edges.select("key", F.col(f"stage_scores.{slot}").alias(slot)).where(
        F.col(slot).isNotNull()
    )
    return rows if wanted is None else rows.join(wanted.select("key").distinct(), "key", "left_semi")


def read_family_a(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """First-family scores of each pair variant; incomplete ones are null."""
    stored = edges.select(
        "key", g1_from_slot(F.col("stage_scores.g1")).alias("family_a")
    )
    return pairs.withColumn("key", keys.edge_key("a_id", "b_id", "with_context")).join(
        stored, "key", "left"
    )
