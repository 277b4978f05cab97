"""Identifiers, JSON text, labels and redaction."""

from __future__ import annotations

from urllib.parse import quote, quote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilohour.functions.time import iso_z

# The credential field of page requests and the replacement text.
SECRET_KEY = "api_key"
REDACTED = "[REDACTED]"


def short_sha(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 32)


def anomaly_id(region: Column, target: Column, stamp: Column, detector: Column, kind: Column, version: Column) -> Column:
    return short_sha(region, target, iso_z(stamp), detector, version, kind)


def alert_id(region: Column, target: Column, kind: Column, first_seen: Column) -> Column:
    return short_sha(region, target, kind, iso_z(first_seen))


def alert_title(severity: Column, kind: Column, region: Column) -> Column:
    return F.concat(F.initcap(severity), F.lit(" "), F.translate(kind, "_", " "), F.lit(" in "), region)


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100.0)


def valid_json(column: Column) -> Column:
    return F.coalesce(F.try_parse_json(column).isNotNull(), F.lit(False))


def json_or_empty(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields)) if fields else F.lit("{}")


def redact(column: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Hide the credential in JSON text and query strings, and given secrets plain or URL-encoded."""
    out = F.regexp_replace(column, rf'(?i)("{SECRET_KEY}"\s*:\s*)"[^"]*"', f'$1"{REDACTED}"')
    out = F.regexp_replace(out, rf"(?i)({SECRET_KEY}=)[^&\s\"',;]+", f"$1{REDACTED}")
    for secret in secrets:
        for form in sorted({secret, quote(secret, safe=""), quote_plus(secret, safe="")}, key=len, reverse=True):
            if form:
                out = F.replace(out, F.lit(form), F.lit(REDACTED))
    return out
