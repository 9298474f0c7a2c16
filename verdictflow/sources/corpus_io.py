"""Replay corpora as JSON lines with a version header."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from verdictflow import schemas, vocab as V
from verdictflow.functions import variants
from verdictflow.functions.cols import staged_where, struct_of

DEFAULT_KIND = "replayCorpus"

# Member names of a corpus line, by column.
WIRE_NAMES = {
    "pair_id": "pairId",
    "claim_a_id": "claimAId",
    "claim_b_id": "claimBId",
    "claim_a_text": "claimAText",
    "claim_b_text": "claimBText",
    "ensemble_verdict": "ensembleVerdict",
    "votes": "votes",
    "golden": "golden",
    "with_context": "withContext",
    "context_a": "contextA",
    "context_b": "contextB",
    "source_snippet": "sourceSnippet",
    "intake_id": "intakeId",
    "stage3_run_id": "stage3RunId",
}

def to_wire(record: Column | None = None) -> Column:
    """A corpus row as one JSON line."""
    return F.to_json(struct_of({wire: F.col(name) for name, wire in WIRE_NAMES.items()}))


def problem_of(document: Column) -> Column:
    """What keeps a parsed line from being a record; null for a good one."""
    return (
        F.when(document.isNull(), F.lit("not JSON"))
        .when(variants.kind(document) != "OBJECT", F.lit("not an object"))
        .when(variants.dig(document, WIRE_NAMES["pair_id"]).isNull(), F.lit("no pair id"))
    )


def from_wire(value: dict[str, Column], which: dict[str, Column]) -> list[Column]:
    """Corpus columns of the members of a line and their kinds. An absent member is empty; flags go by truth, so 1 is true."""
    columns = []
    for field in schemas.CORPUS:
        own = value[field.name]
        if isinstance(field.dataType, T.ArrayType):
            items = F.transform(variants.as_items(own), lambda item: variants.scalar_text(item))
            column = F.coalesce(items, F.array().cast(field.dataType))
        elif isinstance(field.dataType, T.BooleanType):
            column = variants.truthy(own)
        else:
            column = variants.scalar_text(own, which[field.name])
        columns.append(column.alias(field.name))
    return columns


def decode(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines to corpus columns, with ``line`` and ``problem``; blank lines are no lines.

    Every step is a column of its own, so a line is made, parsed and walked once.
    """
    kept = staged_where(lines.select(F.col(column).alias("line")), F.trim("line") != "")
    parsed = kept.select("line", variants.parse("line").alias("_doc"))
    found = parsed.select("line", problem_of(F.col("_doc")).alias("problem"), *[
        variants.step_to(F.col("_doc"), WIRE_NAMES[name]).alias(f"_s_{name}") for name in schemas.CORPUS.fieldNames()
    ])
    found = found.select("line", "problem", *[variants.present(F.col(f"_s_{name}")).alias(f"_v_{name}") for name in schemas.CORPUS.fieldNames()])
    found = found.withColumns({f"_k_{name}": variants.kind(F.col(f"_v_{name}")) for name in schemas.CORPUS.fieldNames()})
    value, which = ({name: F.col(f"{of}{name}") for name in schemas.CORPUS.fieldNames()} for of in ("_v_", "_k_"))
    return found.select("line", "problem", *from_wire(value, which))


def refuse_problems(decoded: DataFrame) -> DataFrame:
    """The corpus columns; a line with a problem fails the job that meets it."""
    stop = F.raise_error(F.concat(F.lit("corpus line refused, "), "problem", F.lit(": "), F.substring("line", 1, 200)))
    good = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(stop.cast("boolean"))
    return staged_where(decoded, good).drop("line", "problem")


def write_corpus(corpus: DataFrame, path: str, kind: str = DEFAULT_KIND) -> None:
    """``path/header`` holds the version line, ``path/records`` the pairs."""
    write_lines(corpus.select(to_wire().alias("value")), path, kind)


def write_lines(lines: DataFrame, path: str, kind: str = DEFAULT_KIND) -> None:
    """Lines that are records already, under a header."""
    spark = lines.sparkSession
    lines.write.mode("overwrite").text(f"{path}/records")
    header = F.to_json(F.struct(
        F.lit(kind).alias("kind"), F.lit(V.CORPUS_SCHEMA_VERSION).alias("schemaVersion")
    ))
    spark.range(1).select(header.alias("value")).write.mode("overwrite").text(f"{path}/header")


def read_lines(spark: SparkSession, path: str, kind: str = DEFAULT_KIND) -> DataFrame:
    """``decode``d lines of a corpus folder, or of one file that begins with its header.

    The header must name ``kind`` and the version that is read here; a file without any text is an
    empty corpus. Lines with a problem are kept, so they can be put aside.
    """
    try:
        lines = spark.read.text(f"{path}/records")
        opening = spark.read.text(f"{path}/header")
    except AnalysisException:
        lines = opening = spark.read.text(path)
    first = opening.head(1)
    text = (first[0]["value"] if first else "").strip()
    if text:
        wanted = {"kind": kind, "schemaVersion": V.CORPUS_SCHEMA_VERSION}
        found = json.loads(text)
        differing = {name: found.get(name) for name, value in wanted.items() if str(found.get(name)) != str(value)}
        if differing:
            raise ValueError(f"{path}: expected {wanted}, the header has {differing}")
    return decode(lines.where(F.trim("value") != text))


def read_corpus(spark: SparkSession, path: str, kind: str = DEFAULT_KIND) -> DataFrame:
    """The records at ``path``; a line that is no record fails the reading job."""
    return refuse_problems(read_lines(spark, path, kind))
