"""Frozen run settings: writing a snapshot once, reading it with defaults."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import Column, functions as F

from verdictflow import vocab as V
from verdictflow.functions import variants
from verdictflow.functions.cols import as_col, struct_of
from verdictflow.functions.decisions import Thresholds


def snapshot(
    thresholds: Thresholds | None = None,
    models: Mapping[str, str] | None = None,
    *,
    roster_version: str = "v1",
    grounding_mode: str = "AUTO",
    llm_model: str = V.DEFAULT_LLM_MODEL,
    max_llm_pairs: int = V.DEFAULT_MAX_LLM_PAIRS,
    thinking_budget: int = V.DEFAULT_THINKING_BUDGET,
    max_seq_tokens: int = V.DEFAULT_MAX_SEQ_TOKENS,
    sha256: Mapping[str, str] | None = None,
) -> dict:
    """The nested record that is stored with a run and never re-read live."""
    values = asdict(thresholds or Thresholds())
    record: dict = {"rosterVersion": roster_version}
    for slot in ("g1", "g2", "g3"):
        record[slot] = {
            "model": {**V.DEFAULT_MODELS, **(models or {})}[slot],
            "sha256": (sha256 or {}).get(slot, ""),
        }
    for name, (path, _) in V.THRESHOLD_PATHS.items():
        slot, key = path.split(".")
        record[slot][key] = values[name]
    record["g1"]["maxSeqTokens"] = max_seq_tokens
    record["g2"]["groundingMode"] = grounding_mode
    record["g3"]["agreementRule"] = "TWO_FAMILY"
    record["g4"] = {
        "llmModel": llm_model, "maxLlmPairs": max_llm_pairs, "thinkingBudget": thinking_budget,
    }
    return record


def canonical_json(record: Mapping) -> str:
    """One spelling per record: sorted keys, no blanks."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest_of(record: Mapping) -> str:
    return hashlib.sha256(canonical_json(record).encode("utf-8")).hexdigest()


def sha256_hex(value: Column | str) -> Column:
    return F.sha2(as_col(value), 256)


def _at(snapshot_json: Column, path: str) -> Column:
    return F.get_json_object(snapshot_json, f"$.{path}")


def thresholds_from_snapshot(snapshot_json: Column | str) -> dict[str, Column]:
    """Threshold columns, with the default where the snapshot has no such key."""
    text = as_col(snapshot_json)
    return {
        name: F.coalesce(_at(text, path).try_cast("double"), F.lit(default))
        for name, (path, default) in V.THRESHOLD_PATHS.items()
    }


def binding_from_snapshot(snapshot_json: Column | str, slot: str) -> Column:
    """Model, pin and token budget of a gate; empty and zero mean the default."""
    text = as_col(snapshot_json)
    tokens = _at(text, f"{slot}.maxSeqTokens").cast("int")
    return struct_of({
        "model": F.coalesce(
            F.nullif(_at(text, f"{slot}.model"), F.lit("")), F.lit(V.DEFAULT_MODELS[slot])
        ),
        "sha256": F.coalesce(_at(text, f"{slot}.sha256"), F.lit("")),
        "max_seq_tokens": F.coalesce(
            F.nullif(tokens, F.lit(0)), F.lit(V.DEFAULT_MAX_SEQ_TOKENS)
        ),
    })


def tail_settings(snapshot_json: Column | str) -> Column:
    """What the paid tail reads: model, cap (0 = no cap) and thinking budget."""
    text = as_col(snapshot_json)
    return struct_of({
        "llm_model": F.coalesce(_at(text, "g4.llmModel"), F.lit("")),
        "max_llm_pairs": F.coalesce(_at(text, "g4.maxLlmPairs").cast("int"), F.lit(0)),
        "thinking_budget": _at(text, "g4.thinkingBudget").cast("int"),
    })


def grounding_mode(value: Column | str) -> Column:
    """OFF or AUTO; anything unknown is AUTO."""
    return F.when(F.upper(as_col(value)) == "OFF", "OFF").otherwise("AUTO")


def resolve_judge_mode(
    params_json: Column | str,
    *,
    default: str = V.MODE_DECIDING,
    deciding_token: str = V.MODE_DECIDING,
) -> Column:
    """(judge_mode, fallback_reason) from a run's parameters, JSON in a text field.

    ``deciding_token`` is how those parameters spell "this cascade decides".
    The reason is null when the mode was read; MISROUTED marks a run another
    judge owns, which is still recorded as published.
    """
    text = as_col(params_json)
    document = variants.parse(text)
    value = variants.dig(document, "judgeMode")
    named = F.when(variants.kind(value) == "STRING", variants.as_text(value))
    known = named.isin(V.MODE_LLM, V.MODE_SHADOW, deciding_token)
    reason = (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("PARAMS_MISSING"))
        .when(document.isNull(), "PARAMS_NOT_JSON")
        .when(value.isNull(), "MODE_MISSING")
        .when(~F.coalesce(known, F.lit(False)), "MODE_UNKNOWN")
    )
    mode = F.when(
        reason.isNull(),
        F.when(named == deciding_token, F.lit(V.MODE_DECIDING)).otherwise(named),
    ).otherwise(F.lit(default))
    return struct_of({
        "judge_mode": mode,
        "fallback_reason": F.coalesce(
            reason, F.when(mode == V.MODE_LLM, F.lit("MISROUTED"))
        ),
    })
