"""Archives of page images: zip files to members with their sizes."""

from __future__ import annotations

import io
import os
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import vision as V

#: The endings of images and of readable archives.
IMAGES = (".jpg", ".jpeg", ".png")
ARCHIVES = (".cbz", ".zip")


def dimensions(data: bytes) -> tuple[int, int]:
    """Width and height from a PNG or JPEG header, (0, 0) for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                break
            mark, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + length
    return 0, 0


def members(spark: SparkSession, path: str, with_bytes: bool = False) -> DataFrame:
    """(archive, member, width, height, error[, bytes]) of the images in the archives at ``path``.

    An archive is read whole or not at all: one that is no zip file, is encrypted, or has a member that can't be read gives
    one row with the ``error`` and no member, so that no later step numbers a part of a book as if nothing were lost.
    """
    schema = "archive string, member string, width int, height int, error string" + ", bytes binary" * with_bytes

    def opened(name: str, content: bytes) -> list[tuple]:
        if not name.lower().endswith(ARCHIVES):
            raise ValueError(f"not a zip archive: {name}")
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            images = sorted((m for m in z.namelist() if m.lower().endswith(IMAGES)), key=str.lower)
            return [(name, m, *dimensions(data), None, *[data] * with_bytes) for m in images for data in [z.read(m)]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"].map(os.path.basename), b["content"], strict=True):
                try:
                    rows = opened(name, content)
                except Exception as e:  # noqa: BLE001 - whatever a damaged file raises is that file's error row
                    rows = [(name, None, None, None, f"{type(e).__name__}: {e}", *[None] * with_bytes)]
                yield pd.DataFrame(rows, columns=["archive", "member", "width", "height", "error", *["bytes"] * with_bytes]).astype({"width": "Int32", "height": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def failed(members_: DataFrame) -> DataFrame:
    """(archive, error) of the archives that could not be read."""
    return members_.where("error IS NOT NULL").select("archive", "error")


def whole(members_: DataFrame) -> DataFrame:
    """The members of the archives that were read, for ``manifest``."""
    return members_.where("error IS NULL").drop("error")


def inspected(members_: DataFrame) -> DataFrame:
    """Each member's name, size, ratio (0 without a height), whether it is wider than high, whether it looks like a cover, and the page numbers it declares."""
    first, second = V.declared(F.col("member"))
    ratio = F.when(F.col("height") > 0, F.round(F.col("width") / F.col("height"), 2)).otherwise(0.0)
    pages = F.array_compact(F.array(first, second))
    return members_.select("archive", "member", "width", "height", ratio.alias("ratio"), (F.col("width") > F.col("height")).alias("landscape"), V.is_cover(F.col("member")).alias("cover"), pages.alias("declared"))


def in_order(archives: DataFrame) -> DataFrame:
    """Archives by leading number, those without last, then by name."""
    lead = F.coalesce(F.nullif(F.regexp_extract("archive", r"^\s*([0-9]+)", 1), F.lit("")).cast("long"), F.lit(1_000_000_000))
    return archives.orderBy(lead, F.lower("archive"))


def write_manifest(manifest: DataFrame, at: str) -> None:
    """The pages of archives as lines of JSON, in ranges of page order."""
    manifest.repartitionByRange("pdf_page").sortWithinPartitions("pdf_page").write.mode("overwrite").json(at)


def read_manifest(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("pdf_page long, issue string, source_image string, from_spread boolean, declared_page int").json(at)
