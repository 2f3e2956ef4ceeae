"""References, edge ids and digests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domain of the inventory digest; another engine's digests are matched by passing its domain.
DIGEST_DOMAIN = "lucerna/target-inventory-root/v1"
#: Fixed value: version of the resource subject's encoding.
SUBJECT_VERSION = "resource-subject/v1"
_NUL = "\x00"


def _short(text: Column) -> Column:
    return F.upper(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def node_reference(kind: str | Column, id_: Column) -> Column:
    return F.concat(F.lit("PP-"), _short(F.concat_ws(_NUL, F.lit(kind) if isinstance(kind, str) else kind, id_)))


def edge_id(type_: Column, from_kind: Column, from_: Column, to_kind: Column, to: Column) -> Column:
    return F.concat(F.lit("PE-"), _short(F.concat_ws(_NUL, type_, from_kind, from_, to_kind, to)))


def u64(value: Column) -> Column:
    """Eight bytes, big end first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def prefixed(value: Column) -> Column:
    """The UTF-8 bytes behind their length."""
    text = F.coalesce(value, F.lit(""))
    return F.concat(u64(F.octet_length(text)), text.cast("binary"))


def inventory_record(path: Column, kind: Column, mode: Column, size: Column, sha256: Column, link_target: Column, skip_reason: Column) -> Column:
    return F.concat(prefixed(path), prefixed(kind), prefixed(mode), u64(size), prefixed(sha256), prefixed(link_target), prefixed(skip_reason))


def inventory_digest(records: Column, domain: str = DIGEST_DOMAIN) -> Column:
    """SHA-256 over ``records``: an array of structs (path, record) in path order."""
    body = F.array_join(F.transform(records, lambda r: F.hex(r["record"])), "")
    return F.sha2(F.concat(prefixed(F.lit(domain)), u64(F.size(records)), F.unhex(body)), 256)


def operation_subject(command_base: Column) -> Column:
    return F.concat(F.lit("command" + _NUL), command_base)


def resource_subject(kind: Column, access: Column, value: Column) -> Column:
    """Injective: every field stands behind its length in bytes."""
    parts = [F.concat(F.lit(":"), F.octet_length(c).cast("string"), F.lit(":"), c) for c in (kind, access, value)]
    return F.concat(F.lit(SUBJECT_VERSION), *parts)
