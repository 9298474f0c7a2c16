"""Reading schema-free documents (VARIANT) with candidate paths and coercions.

Type questions are answered by ``schema_of_variant`` so that a number, a
boolean and the text that looks like one stay distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from verdictflow.functions.cols import as_col, strip


def parse(document: Column | str) -> Column:
    """JSON text to VARIANT, null where it does not parse."""
    return F.try_parse_json(as_col(document))


def dig(document: Column, path: str) -> Column:
    """The value at a dotted path; a JSON null counts as absent."""
    return present(step_to(document, path))


def step_to(document: Column, path: str) -> Column:
    """The value at a dotted path, a JSON null included."""
    steps = "".join(f"['{step}']" for step in path.split("."))
    return F.try_variant_get(document, f"${steps}", "variant")


def present(value: Column) -> Column:
    return F.when(~F.is_variant_null(value), value)


def first_of(document: Column, paths: Sequence[str]) -> Column:
    """The first path that holds a value; an empty text is a value."""
    found = [dig(document, path) for path in paths]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def kind(value: Column) -> Column:
    """STRING, BOOLEAN, NUMBER, ARRAY, OBJECT, VOID for a JSON null, null for nothing.

    One chain of calls on ``value``: a ``CASE`` would evaluate it once per branch.
    """
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.regexp_replace(name, "^(?!(STRING|BOOLEAN|ARRAY|OBJECT|VOID)$).+$", "NUMBER")


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_entries(value: Column) -> Column:
    """An object's members as an array of (key, value)."""
    return F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))


def as_items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def truthy(value: Column) -> Column:
    """Non-empty text, list or object, non-zero number, or true.

    The text ``"false"`` is therefore true.
    """
    which = kind(value)
    return F.coalesce(
        F.when(which == "STRING", as_text(value) != "")
        .when(which == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(which == "NUMBER", F.try_variant_get(value, "$", "double") != 0)
        .when(which == "ARRAY", F.size(as_items(value)) > 0)
        .when(which == "OBJECT", F.size(as_entries(value)) > 0),
        F.lit(False),
    )


def text_or_empty(value: Column, which: Column | None = None) -> Column:
    """The value as text; absent, false, zero and empty all become ''. ``which`` is its ``kind``, where that is a column already."""
    which = kind(value) if which is None else which
    return F.coalesce(
        # A text is taken out once: empty ones stay as they are.
        F.when(which == "STRING", as_text(value))
        .when(which == "BOOLEAN", F.when(truthy(value), F.lit("True")))
        .when(truthy(value), as_text(value)),
        F.lit(""),
    )


def scalar_text(value: Column, which: Column | None = None) -> Column:
    """The value as text; only absence becomes ''. ``which`` as in ``text_or_empty``."""
    return F.coalesce(
        F.when(
            (kind(value) if which is None else which) == "BOOLEAN",
            F.when(F.try_variant_get(value, "$", "boolean"), F.lit("True")).otherwise("False"),
        ).otherwise(as_text(value)),
        F.lit(""),
    )


def coerce_verdict(value: Column | str) -> Column:
    """Trimmed, upper case, ``-`` as ``_``; unknown labels are kept as they are."""
    text = F.coalesce(as_col(value), F.lit(""))
    return F.replace(F.upper(strip(text)), F.lit("-"), F.lit("_"))


def coerce_votes(value: Column) -> Column:
    """Votes given as one label, a list, a map, or records that carry a label."""

    def label(entry: Column) -> Column:
        chosen = F.when(
            kind(entry) == "OBJECT", first_of(entry, ("verdict", "label", "value"))
        ).otherwise(present(entry))
        return coerce_verdict(scalar_text(chosen))

    def labels(entries: Column) -> Column:
        return F.filter(F.transform(entries, label), lambda vote: vote != "")

    which = kind(value)
    nothing = F.array().cast("array<string>")
    return F.coalesce(
        F.when(which == "STRING", F.array(coerce_verdict(as_text(value))))
        .when(which == "ARRAY", labels(as_items(value)))
        .when(
            which == "OBJECT",
            labels(F.transform(as_entries(value), lambda entry: entry["value"])),
        ),
        nothing,
    )


def vote_agreement(votes: Column | str, verdict: Column | str) -> Column:
    """How many votes name the verdict."""
    wanted = as_col(verdict)
    return F.size(F.filter(as_col(votes), lambda vote: vote == wanted))
