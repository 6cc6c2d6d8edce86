"""Identifiers, fingerprints, cache keys and labels."""

from __future__ import annotations

import hashlib
import json
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def region_id(lead: Column, member: Column | None = None) -> Column:
    """``det_L0006``, or ``mem003_L0006`` for a member."""
    det = F.format_string("det_L%04d", lead)
    return det if member is None else F.when(member.isNull(), det).otherwise(F.format_string("mem%03d_L%04d", member, lead))


def region_lead(region: Column) -> Column:
    return F.regexp_extract(region, r"_L(\d+)$", 1).cast("int")


def region_member(region: Column) -> Column:
    return F.nullif(F.regexp_extract(region, r"^mem(\d+)_", 1), F.lit("")).cast("int")


def chunk_id(variable: Column, *index: Column) -> Column:
    return F.concat_ws("/", variable, F.concat_ws(".", *[i.cast("string") for i in index]))


def fingerprint(parts: Column) -> Column:
    """SHA-256 of a set of strings, whatever their order."""
    return F.sha2(F.concat_ws("\n", F.array_sort(F.array_distinct(parts))), 256)


def row_key(*columns: Column) -> Column:
    """SHA-256 over column values as a JSON array of strings, so that null, empty and joined values differ."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])), 256)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of parts put one after the other; null has a text of its own."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("<null>")) for p in parts]), 256)


def write_set_fingerprint(required: Column, omitted: Column) -> Column:
    """Of the keys that a region writes and those it leaves out (two arrays)."""
    return F.sha2(F.concat(F.lit("write-set"), F.array_join(F.array_sort(required), ""), F.array_join(F.array_sort(omitted), "")), 256)


def evidence_fingerprint(regions: Column) -> Column:
    """Of regions that were committed before there were markers (an array)."""
    return F.sha2(F.concat(F.lit("legacy-region-evidence"), F.array_join(F.array_sort(regions), "")), 256)


def schema_fingerprint(coordinates: Column, variables: Column) -> Column:
    """Of the names of a store's axes and variables (two arrays)."""
    return F.sha2(F.concat(F.lit("schema"), F.array_join(F.array_sort(coordinates), ""), F.array_join(F.array_sort(variables), "")), 256)


def storage_identity(path: str, endpoint: str | None = None, secure: bool = False) -> str:
    """One name for a store, however its path is written; no credentials or queries."""
    if path.startswith(("s3://", "s3a://")):
        where = (endpoint or "").split("://")[-1].rstrip("/")
        return f"s3+{'https' if secure else 'http'}://{where}/{path.split('://', 1)[1].split('?', 1)[0].strip('/')}"
    return f"file://{posixpath.abspath(posixpath.normpath(path.removeprefix('file://')))}"


def key60(identity: str, namespace: int = 0) -> int:
    """A 60-bit number of an identity below the four bits of its namespace."""
    low = int.from_bytes(hashlib.blake2b(identity.encode(), digest_size=8).digest(), "big") & ((1 << 60) - 1)
    return namespace << 60 | low


def canonical_json(value: object) -> str:
    compact = (",", ":")
    return json.dumps(value, separators=compact, sort_keys=True)


def request_key(kind: str, **parameters: object) -> str:
    """Cache identity of a request: equal for equal parameters in any order."""
    return f"{kind}:{hashlib.sha256(canonical_json(parameters).encode()).hexdigest()}"


def iso_z(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cycle_label(time: Column) -> Column:
    return F.concat(F.date_format(time, "yyyy-MM-dd HH"), F.lit("Z"))


def lead_label(lead: Column) -> Column:
    return F.concat(F.lit("+"), lead.cast("string"), F.lit("h"))


def value_label(value: Column, unit: Column) -> Column:
    """At most two places without trailing zeros, thousands apart, and the unit if there is one."""
    number = F.regexp_replace(F.format_number(value.cast("double"), 2), r"\.?0+$", "")
    return F.when(unit == "", number).otherwise(F.concat(number, F.lit(" "), unit))


def percent_label(share: Column) -> Column:
    return F.format_string("%d%%", F.round(share * 100).cast("int"))


def elevation_key(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Thousandths of a degree, halves to even."""
    return (F.bround(latitude, 3) * 1000).cast("int"), (F.bround(longitude, 3) * 1000).cast("int")


def coordinate_label(latitude: Column, longitude: Column) -> Column:
    return F.format_string("%.4f, %.4f", latitude, longitude)


def percent_range_label(p: Column, low: Column, high: Column) -> Column:
    pct = lambda c: F.round(c * 100).cast("int")
    return F.format_string("%d%% (%d–%d%%)", pct(p), pct(low), pct(high))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def valid_time(cycle: Column, lead: Column) -> Column:
    return cycle + F.make_dt_interval(F.lit(0), lead)


def tile_template(model: str, variable: str, level: str, lead: int) -> str:
    path = "/".join(["/v1/maps", model, variable, level, "{z}", "{x}", "{y}.png"])
    return f"{path}?lead_time_hours={lead}"
