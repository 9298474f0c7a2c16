"""Validation of run requests and of the envelope they arrive in.

Nothing raises: the first violated rule is named in ``reject_reason`` so that
good and bad messages can be split into two sinks.

Most bodies are *plain*: objects of texts without escapes and of whole numbers. What is plain is
told by one pattern, and read by one typed parse. Everything else (escapes, other values, nesting,
repeated names, text that is no JSON) is parsed to VARIANT; both ways give the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdictflow import vocab as V
from verdictflow.functions import variants
from verdictflow.functions.cols import as_col, struct_of
from verdictflow.functions.timestamps import parse_rfc3339

# The fields of a run request, in wire order.
REQUEST_FIELDS = {
    "schemaVersion": "schema_version",
    "runRequestId": "run_request_id",
    "intakeId": "intake_id",
    "stage3RunId": "stage3_run_id",
    "gate": "gate",
    "mode": "mode",
    "triggeredBy": "triggered_by",
    "requestTimestamp": "request_timestamp",
}

# Canonical text of a version 4 UUID; standard base64; artifact reference.
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
ARTIFACT_REF = r"^([a-z0-9]+(?:-[a-z0-9]+)*)@(v[0-9]+)$"


# JSON of texts without escapes and whole numbers of at most 18 digits. Members are counted, so
# that a long object is not matched by deep recursion.
_TEXT = r'"[^"\\\x00-\x1f]*+"'
_GAP = r"[ \t\r\n]*+"
_PAIR = rf"{_TEXT}{_GAP}:{_GAP}(?:{_TEXT}|-?(?:0|[1-9][0-9]{{0,17}}))"
_FLAT = rf"\{{{_GAP}(?:{_PAIR}(?:{_GAP},{_GAP}{_PAIR}){{0,15}})?{_GAP}\}}"
PLAIN_BODY = rf"^{_GAP}{_FLAT}{_GAP}$"

BODY_TYPE = ", ".join(f"{name} {'bigint' if name == 'schemaVersion' else 'string'}" for name in REQUEST_FIELDS)


def _once(names: Column) -> Column:
    """No name occurs twice; false where there are no names."""
    return F.coalesce(F.size(F.array_distinct(names)) == F.size(names), F.lit(False))


def _quoted(source: Column, name: str, value: Column) -> Column:
    """``value`` if it is a text in plain ``source``: a typed parse gives whole numbers as texts too."""
    number = value.rlike("^-?[0-9]+$") & ~source.rlike(rf'"{name}"{_GAP}:{_GAP}"')
    return F.when(~number, F.nullif(value, F.lit("")))


def is_uuid4(value: Column | str) -> Column:
    return F.coalesce(as_col(value).rlike(UUID4), F.lit(False))


def is_token(value: Column | str, allowed) -> Column:
    return F.coalesce(as_col(value).isin(*allowed), F.lit(False))


def member_names(document: Column) -> Column:
    """Names of an object's members, whatever their values are."""
    return F.map_keys(F.try_variant_get(document, "$", "map<string,variant>"))


def unknown_fields(document: Column) -> Column:
    return F.array_sort(F.array_except(member_names(document), _literal_names()))


def missing_fields(document: Column) -> Column:
    return F.array_sort(F.array_except(_literal_names(), member_names(document)))


def _literal_names() -> Column:
    return F.array(*[F.lit(name) for name in REQUEST_FIELDS])


def _raw(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$['{name}']", "variant")


_STEP = "_req_"


def _step(name: str) -> Column:
    return F.col(_STEP + name)


def _add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns({_STEP + name: column for name, column in columns.items()})


def _non_empty_string(value: Column) -> Column:
    return F.when(variants.kind(value) == "STRING", F.nullif(variants.as_text(value), F.lit("")))


def parse_requests(df: DataFrame, body: str) -> DataFrame:
    """Bodies (JSON text) as request columns in snake_case plus ``reject_reason``.

    The reason is null for a valid request, else the first rule it breaks. The
    version is judged before unknown members: a newer message also carries
    members this build does not know, and the version is the honest diagnosis.
    Every step is a column of its own, so a body is parsed once, one way or the other.
    """
    source = F.col(body)
    staged = _add(df, {"own": F.when(source.rlike(PLAIN_BODY), F.json_object_keys(source))})
    staged = _add(staged, {"plain": _once(_step("own"))})
    plain = _step("plain")
    staged = _add(staged, {
        "typed": F.when(plain, F.from_json(source, BODY_TYPE)), "doc": F.when(~plain, variants.parse(body)),
    })
    staged = _add(staged, {
        "names": F.when(plain, _step("own")).otherwise(member_names(_step("doc"))),
        **{f"v_{name}": _raw(_step("doc"), name) for name in REQUEST_FIELDS},
    })
    wanted = _literal_names()
    version = _step("v_schemaVersion")
    staged = _add(staged, {
        "readable": plain | _step("doc").isNotNull(),
        "version": F.when(plain, _step("typed")["schemaVersion"]).when(
            F.schema_of_variant(version) == "BIGINT", F.try_variant_get(version, "$", "bigint")
        ),
        "unknown": F.size(F.array_except(_step("names"), wanted)),
        "missing": F.size(F.array_except(wanted, _step("names"))),
        **{
            f"t_{name}": F.when(plain, _quoted(source, name, _step("typed")[name])).otherwise(_non_empty_string(_step(f"v_{name}")))
            for name in REQUEST_FIELDS if name != "schemaVersion"
        },
    })

    def text(name: str) -> Column:
        return _step(f"t_{name}")

    reason = (
        F.when(~_step("readable"), F.lit("body_not_json"))
        .when(_step("names").isNull(), "body_not_object")
        .when(~F.array_contains(_step("names"), "schemaVersion"), "version_missing")
        .when(_step("version").isNull(), "version_type")
        .when(~_step("version").isin(*V.REQUEST_SCHEMA_VERSIONS), "version_unsupported")
        .when(_step("unknown") > 0, "unknown_fields")
        .when(_step("missing") > 0, "missing_fields")
        .when(parse_rfc3339(text("requestTimestamp")).isNull(), "request_timestamp")
        .when(~is_uuid4(text("runRequestId")), "run_request_id")
        .when(text("intakeId").isNull(), "intake_id")
        .when(text("stage3RunId").isNull(), "stage3_run_id")
        .when(~is_token(text("gate"), V.GATES), "gate")
        .when(~is_token(text("mode"), V.RUN_MODES), "mode")
        .when(~is_token(text("triggeredBy"), V.TRIGGERS), "triggered_by")
    )
    fields = [
        (_step("version").try_cast("int") if name == "schemaVersion" else text(name)).alias(target)
        for name, target in REQUEST_FIELDS.items()
    ]
    return staged.select(*df.columns, *fields, reason.alias("reject_reason"))


def decode_envelopes(df: DataFrame, envelope: str) -> DataFrame:
    """Delivery envelopes (JSON text) as ``body``, delivery metadata and ``envelope_problem``."""
    staged = _add(df, {"env": variants.parse(envelope)})
    staged = _add(staged, {
        "env_kind": variants.kind(_step("env")),
        "msg": F.try_variant_get(_step("env"), "$['message']", "variant"),
        "attempt": F.try_variant_get(_step("env"), "$['deliveryAttempt']", "variant"),
    })
    staged = _add(staged, {
        "msg_kind": variants.kind(_step("msg")),
        "data": _non_empty_string(_raw(_step("msg"), "data")),
    })
    staged = _add(staged, {"is64": F.coalesce(_step("data").rlike(BASE64), F.lit(False))})
    staged = _add(staged, {"raw": F.when(_step("is64"), F.unbase64(_step("data"))).cast("string")})
    problem = (
        F.when(F.coalesce(_step("env_kind") != "OBJECT", F.lit(True)), F.lit("envelope_not_object"))
        .when(F.coalesce(_step("msg_kind") != "OBJECT", F.lit(True)), "envelope_message_missing")
        .when(_step("data").isNull(), "envelope_data_missing")
        .when(~_step("is64"), "envelope_data_not_base64")
    )

    def member(owner: str, name: str) -> Column:
        return F.coalesce(variants.as_text(_raw(_step(owner), name)), F.lit("")).alias(
            {"messageId": "message_id", "publishTime": "publish_time"}.get(name, name)
        )

    return staged.select(
        *df.columns,
        F.when(F.is_valid_utf8(_step("raw")), _step("raw")).alias("body"),
        member("msg", "messageId"), member("msg", "publishTime"),
        F.when(
            F.schema_of_variant(_step("attempt")) == "BIGINT",
            F.try_variant_get(_step("attempt"), "$", "int"),
        ).alias("delivery_attempt"),
        member("env", "subscription"),
        problem.alias("envelope_problem"),
    )


def parse_artifact_ref(value: Column | str) -> Column:
    """``kebab-name@vN`` as (name, version); null where it is anything else."""
    text = as_col(value)
    return F.when(
        text.rlike(ARTIFACT_REF),
        struct_of({
            "name": F.regexp_extract(text, ARTIFACT_REF, 1),
            "version": F.regexp_extract(text, ARTIFACT_REF, 2),
        }),
    )
