"""Schema-free verdict documents: which fields are there, what they hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from verdictflow.functions import variants

# Where each corpus field may live in a stored document, in order.
DEFAULT_PATHS: dict[str, tuple[str, ...]] = {
    "claim_a_id": ("claimAId", "claimA", "sourceClaimId", "fromClaimId"),
    "claim_b_id": ("claimBId", "claimB", "targetClaimId", "toClaimId"),
    "claim_a_text": ("claimAText", "claimATextSnapshot", "textA"),
    "claim_b_text": ("claimBText", "claimBTextSnapshot", "textB"),
    "verdict": ("verdict", "ensembleVerdict", "judgeVerdict"),
    "votes": ("votes", "ensembleVotes", "judgeVotes", "ensemble.votes"),
    "golden": ("golden", "isGolden", "humanConfirmed", "contributesToFact"),
    "with_context": ("withContext", "hasContext"),
    "context_a": ("explanationA", "contextA"),
    "context_b": ("explanationB", "contextB"),
    "source_snippet": ("sourceSnippet", "evidenceSnippet", "snippet"),
    "method": ("method",),
    "intake_id": ("intakeId",),
    "stage3_run_id": ("stage3RunId",),
}


@dataclass(frozen=True)
class FieldMap:
    """Candidate dotted paths per corpus field."""

    paths: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(DEFAULT_PATHS))

    @classmethod
    def from_options(cls, overrides: Mapping[str, str | Sequence[str]]) -> "FieldMap":
        unknown = sorted(set(overrides) - set(DEFAULT_PATHS))
        if unknown:
            raise ValueError(f"not corpus fields: {unknown}; known: {sorted(DEFAULT_PATHS)}")
        given = {
            name: (value,) if isinstance(value, str) else tuple(value)
            for name, value in overrides.items()
        }
        return cls({**DEFAULT_PATHS, **given})

    def value(self, document: Column, name: str) -> Column:
        return variants.first_of(document, self.paths[name])


def scan_edges(
    edges: DataFrame, run_id: str | None = None, limit: int | None = None,
    run_column: str = "stage3_run_id",
) -> DataFrame:
    """Verdict rows, of one run if asked for; the filter reaches the scan."""
    rows = edges if run_id is None else edges.where(F.col(run_column) == run_id)
    return rows if not limit else rows.limit(limit)


def sample(documents: DataFrame, limit: int, by: str = "doc_id") -> DataFrame:
    """The first ``limit`` rows in a total order (top-k, no full sort)."""
    return documents.orderBy(by).limit(limit)


def nesting_depth(documents: DataFrame) -> int:
    """Levels of nested objects in the documents, at least: read off each document's type, in one scan.

    Arrays count as levels too, so the number may be too high, which costs nothing.
    """
    signs = F.split(F.regexp_replace(F.schema_of_variant("doc"), "[^<>]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(held: Column, sign: Column) -> Column:
        now = held["now"] + F.when(sign == "<", 1).when(sign == ">", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(held["most"], now).alias("most"))

    depth = F.aggregate(signs, start, step, lambda held: held["most"])
    return max(1, documents.agg(F.max(depth)).first()[0] or 1)


def _paths(value: Column, prefix: Column, depth: int) -> Column:
    def below(entry: Column) -> Column:
        path = F.concat(prefix, entry["key"])
        own = F.array(path)
        if depth <= 1:
            return own
        return F.when(
            F.coalesce(variants.kind(entry["value"]) == "OBJECT", F.lit(False)),
            F.concat(own, _paths(entry["value"], F.concat(path, F.lit(".")), depth - 1)),
        ).otherwise(own)

    return F.coalesce(
        F.flatten(F.transform(variants.as_entries(value), below)),
        F.array().cast("array<string>"),
    )


def key_frequencies(documents: DataFrame, depth: int | None = None) -> DataFrame:
    """How many documents carry each dotted path; arrays are not entered."""
    depth = nesting_depth(documents) if depth is None else depth
    return (
        documents.select(F.explode(_paths(F.col("doc"), F.lit(""), depth)).alias("path"))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def most_common(frequencies: DataFrame, n: int = 60) -> DataFrame:
    return frequencies.orderBy(F.desc("documents"), "path").limit(n)


def resolvability(documents: DataFrame, field_map: FieldMap | None = None) -> DataFrame:
    """Per corpus field: in how many documents a path of the map holds a value."""
    field_map = field_map or FieldMap()
    names = list(field_map.paths)
    counted = documents.agg(
        F.count(F.lit(1)).alias("sampled"),
        *[
            F.count_if(field_map.value(F.col("doc"), name).isNotNull()).alias(name)
            for name in names
        ],
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("field"), F.col(name).alias("resolved")) for name in names
    ])
    return counted.select("sampled", F.inline(rows))


def unresolved(resolved: DataFrame) -> DataFrame:
    """Fields no document resolves."""
    return resolved.where(F.col("resolved") == 0).select("field").orderBy("field")
