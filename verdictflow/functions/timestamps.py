"""RFC 3339 timestamps: an explicit offset is required, UTC is written."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdictflow.functions.cols import as_col

# Fixed value: the accepted shape of a timestamp on the wire.
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def parse_rfc3339(value: Column | str) -> Column:
    """A timestamp, or null where the text is malformed or has no offset."""
    text = as_col(value)
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(text))


def format_rfc3339(value: Column | str) -> Column:
    """UTC with milliseconds and a ``Z``, whatever the session's time zone is.

    A timestamp is an instant, so it is shifted from the session's zone to UTC
    before it is printed.
    """
    utc = F.to_utc_timestamp(as_col(value), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def decode_timestamp(value: Column | str) -> Column:
    """RFC 3339 text where it is that, otherwise whatever casts to a timestamp."""
    text = as_col(value).cast("string")
    return F.coalesce(parse_rfc3339(text), F.try_to_timestamp(text))
