"""Table schemas, vocabularies and limits of the evidence model. Every table has ``target_id`` first."""

from __future__ import annotations

from dataclasses import dataclass

SCHEMA_VERSION = "2.0.0"
ANALYZER, ANALYZER_VERSION = "lucerna/deterministic", "development"
DYNAMIC = "<dynamic>"
TARGET_INPUT = "target"

# Vocabularies.
SEVERITIES = ("informational", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
SCOPES = ("runtime", "repository-tooling", "unknown")
STATUSES = ("complete", "incomplete", "error")
CLAIMS = ("fact", "inference")
DISPOSITIONS = ("not-applicable", "analyzed", "partial", "unanalyzed")
UNKNOWN_REASONS = ("dynamic-value", "unsupported-syntax", "parser-failure", "budget-exhaustion", "unreachable-source", "native-behavior", "unresolved-data-flow", "external-input-unbound")
ORIGIN_KINDS = ("assignment", "parameter-expansion", "property-assignment", "use-site")
EVIDENCE_SOURCES = ("target-source", "inventory-metadata", "external-audit")
NODE_KINDS = ("operation", "resource", "finding", "unknown")
BASE_EDGES = ("derived-from", "established-by", "inferred-from", "unknown-because")
COMPARISON_EDGES = ("corroborates", "duplicates", "disagrees-with")
ARCHIVE_FORMATS = ("zip", "tar", "gzip", "xz", "zstd", "bzip2")

EVIDENCE = "struct<input_id:string,path:string,line_start:int,line_end:int,operation:string,excerpt:string>"
PROVENANCE = "struct<rule_id:string,analyzer:string,analyzer_version:string,evidence_source:string>"
BINARY = "struct<format:string,class:string,byte_order:string,machine:string,type:string,interpreter:string,libraries:array<string>,imported_symbols:array<string>,extracted_strings:array<string>,embedded_urls:array<string>,file_capabilities:array<string>,capability_effective:boolean,setuid:boolean,setgid:boolean,has_symbols:boolean>"
ARCHIVE = "struct<format:string,entries:array<struct<path:string,kind:string,mode:string,link_target:string,size:long,compressed_size:long,unsafe_path:boolean,encrypted:boolean>>,inventory_complete:boolean,retained_uncompressed_bytes:long>"
MANIFEST = "struct<id:string,name:string,version:string,description:string,kinds:array<string>,entry_points:map<string,string>>"

CONTENTS = "target_id string, path string, content binary"
INVENTORY = f"target_id string, path string, kind string, mode string, size long, sha256 string, content_type string, link_target string, inspected boolean, skip_reason string, binary {BINARY}, archive {ARCHIVE}"
OPERATIONS = f"target_id string, id string, category string, command string, arguments array<string>, dynamic boolean, confidence string, evidence {EVIDENCE}, provenance {PROVENANCE}, path string, ordinal int"
RESOURCES = f"target_id string, id string, kind string, access string, value string, sensitive boolean, dynamic boolean, confidence string, evidence {EVIDENCE}, operation_id string, provenance {PROVENANCE}"
FINDINGS = f"target_id string, id string, claim string, severity string, confidence string, category string, title string, explanation string, evidence array<{EVIDENCE}>, related array<string>, provenance {PROVENANCE}"
UNKNOWNS = f"target_id string, id string, category string, reason string, confidence string, title string, description string, evidence array<{EVIDENCE}>, origins array<struct<kind:string,name:string,evidence:{EVIDENCE}>>, affected array<string>, suppressed array<string>, provenance {PROVENANCE}"
LIMITATIONS = "target_id string, code string, description string, path string, scope string"
ERRORS = "target_id string, code string, message string, path string"
INPUTS = "target_id string, id string, type string, label string, document_sha256 string, subject_root_digest string, format string, version string"
EDGES = "target_id string, id string, type string, from_kind string, `from` string, to_kind string, `to` string, basis struct<kind:string,subject:string>"


@dataclass(frozen=True)
class Limits:
    """Bounds of the data contract; over a bound means reject, never truncate."""

    files: int = 10_000
    depth: int = 32
    file_bytes: int = 2 << 20
    total_bytes: int = 32 << 20
    binary_file_bytes: int = 64 << 20
    binary_total_bytes: int = 128 << 20
    records: int = 20_000
    errors: int = 10_000
    arguments: int = 1_024
    manifest_items: int = 128
    libraries: int = 1_024
    symbols: int = 1_024
    strings: int = 256
    urls: int = 128
    capabilities: int = 64
    archive_entries: int = 4_096
    finding_evidence: int = 8
    finding_related: int = 16
    unknown_evidence: int = 8
    unknown_affected: int = 16
    unknown_origins: int = 8
    unknown_suppressed: int = 16
    inputs: int = 16
    edges_accepted: int = 680_000
    edges_produced: int = 20_000
    string_bytes: int = 4 << 10
    report_bytes: int = 16 << 20
    nesting: int = 64
    reasons: int = 8
    plugins: int = 1_024
    rows_shown: int = 500
    excerpt_bytes: int = 500


LIMITS = Limits()
