"""The full-precision score slots of a verdict row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdictflow import schemas
from verdictflow.functions.cols import struct_of


def g1_slot(g1: Column) -> Column:
    fwd, bwd, ctx_fwd, ctx_bwd = (g1[name] for name in ("fwd", "bwd", "ctx_fwd", "ctx_bwd"))
    return struct_of({
        "ent_fwd": fwd["entailment"],
        "ent_bwd": bwd["entailment"],
        "neu_fwd": fwd["neutral"],
        "neu_bwd": bwd["neutral"],
        "con_fwd": fwd["contradiction"],
        "con_bwd": bwd["contradiction"],
        "ctx_delta": F.when(
            ctx_fwd.isNotNull() & ctx_bwd.isNotNull(),
            F.greatest(
                F.abs(ctx_fwd["neutral"] - fwd["neutral"]),
                F.abs(ctx_bwd["neutral"] - bwd["neutral"]),
            ),
        ),
    })


def g2_slot(g2: Column, grounded_fwd: Column, grounded_bwd: Column) -> Column:
    """Both grounded orientations are kept, next to the one the rule saw."""
    return struct_of({
        "support_fwd": g2["fwd"]["support"],
        "support_bwd": g2["bwd"]["support"],
        "support_grounded_fwd": grounded_fwd["support"],
        "support_grounded_bwd": grounded_bwd["support"],
        "support_grounded": F.greatest(grounded_fwd["support"], grounded_bwd["support"]),
    })


def g3_slot(g3: Column) -> Column:
    fwd, bwd = g3["fwd"], g3["bwd"]
    return struct_of({
        "ent_fwd_b": fwd["entailment"],
        "ent_bwd_b": bwd["entailment"],
        "neu_fwd_b": fwd["neutral"],
        "neu_bwd_b": bwd["neutral"],
        "con_fwd_b": fwd["contradiction"],
        "con_bwd_b": bwd["contradiction"],
    })


def stronger_grounding(first: Column, second: Column) -> Column:
    """The grounded score a decision sees: the stronger one, the first on a tie."""
    return (
        F.when(first.isNull(), second)
        .when(second.isNull() | (first["support"] >= second["support"]), first)
        .otherwise(second)
    )


def g1_from_slot(slot: Column) -> Column:
    """First-family scores back out of a stored slot: all six numbers or null.

    The contexted passes are not stored, so they come back as null.
    """
    names = ("ent_fwd", "ent_bwd", "neu_fwd", "neu_bwd", "con_fwd", "con_bwd")
    complete = F.lit(True)
    for name in names:
        complete = complete & slot[name].isNotNull()

    def nli(side: str) -> Column:
        return struct_of({
            "entailment": slot[f"ent_{side}"],
            "neutral": slot[f"neu_{side}"],
            "contradiction": slot[f"con_{side}"],
            "truncated": F.lit(False),
        })

    empty = F.lit(None).cast(schemas.NLI)
    return F.when(
        F.coalesce(complete, F.lit(False)),
        struct_of({"fwd": nli("fwd"), "bwd": nli("bwd"), "ctx_fwd": empty, "ctx_bwd": empty}),
    )
