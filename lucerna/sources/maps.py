"""File maps and table columns as targets, without a file system."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import binaries
from lucerna.functions.shared import settle
from lucerna.schemas import BINARY, CONTENTS


def from_maps(spark: SparkSession, targets: Mapping[str, Mapping[str, bytes | str]]) -> DataFrame:
    """(target_id, path, content) of in-memory file maps."""
    rows = [(t, p, bytearray(c.encode() if isinstance(c, str) else c)) for t, files in targets.items() for p, c in files.items()]
    return spark.createDataFrame(rows, CONTENTS)


def from_table(rows: DataFrame, target: Column, path: Column, text: Column) -> DataFrame:
    """A text column of any table as source files; a null text is an empty file."""
    return rows.select(target.cast("string").alias("target_id"), path.alias("path"), F.coalesce(text, F.lit("")).cast("binary").alias("content"))


def inventory_of(contents: DataFrame) -> DataFrame:
    """The inventory that listing ``contents`` would give: regular, readable files.

    Hashing stays in the JVM; only ELF headers and content types are read in Python, from what they
    need of each distinct file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types, metas = [], []
            for c in b.column(1).to_pylist():
                types.append(binaries.content_type(c))
                metas.append(binaries.elf(c) if c.startswith(binaries.ELF_MAGIC) else None)
            shape = [(n, pa.string()) for n in ("format", "class", "byte_order", "machine", "type", "interpreter")] + [(n, pa.list_(pa.string())) for n in ("libraries", "imported_symbols", "extracted_strings", "embedded_urls", "file_capabilities")] + [(n, pa.bool_()) for n in ("capability_effective", "setuid", "setgid", "has_symbols")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(types, pa.string()), pa.array(metas, pa.struct(shape))], ["sha256", "content_type", "binary"])

    head = F.when(F.substring("content", 1, 4) == F.unhex(F.lit("7F454C46")), F.col("content")).otherwise(F.substring("content", 1, 512))
    sha256 = F.sha2("content", 256).alias("sha256")
    once = contents.select(sha256, head.alias("head")).distinct()
    shapes = settle(once.mapInArrow(read, f"sha256 string, content_type string, binary {BINARY}"), "shapes")
    seen = contents.select("target_id", "path", F.octet_length("content").cast("long").alias("size"), sha256).join(shapes, "sha256")
    return seen.select("target_id", "path", F.lit("regular").alias("kind"), F.lit("-rw-r--r--").alias("mode"), "size", "sha256", "content_type", F.lit("").alias("link_target"), F.lit(True).alias("inspected"), F.lit("").alias("skip_reason"), "binary", F.lit(None).cast("string").alias("archive"))
