"""Triage of uploaded files and archives."""

from __future__ import annotations

import io
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.session import cut

# Accepted media types, signatures and archive limits.
ALLOWED_MEDIA_TYPES = (
    "application/fhir+json",
    "application/json",
    "application/pdf",
    "application/xml",
    "image/jpeg",
    "image/png",
    "text/csv",
    "text/xml",
)
COMPATIBLE = {
    "application/json": ("application/fhir+json", "application/json"),
    "application/xml": ("application/xml", "text/xml"),
}
# The bytes files of these types begin with.
SIGNATURES = {
    b"%PDF-": "application/pdf",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
}
MAXIMUM_ENTRIES = 100
MAXIMUM_ENTRY_BYTES = 50 * 1024 * 1024
MAXIMUM_TOTAL_BYTES = 250 * 1024 * 1024
MAXIMUM_RATIO = 100
NESTED_SUFFIXES = (".7z", ".bz2", ".gz", ".rar", ".tar", ".xz", ".zip")
FILENAME_LENGTH = 180


def sniff_media_type(content: Column) -> Column:
    """Struct ``(media_type, error)`` of binary content, from its signature or well-formedness."""
    signed = F.coalesce(
        *[
            F.when(F.substring(content, 1, len(magic)) == F.lit(bytearray(magic)), F.lit(kind))
            for magic, kind in SIGNATURES.items()
        ]
    )
    text = F.try_validate_utf8(content.cast("string"))
    head = F.substring(F.ltrim(text, F.lit(" \t\n\r\x0b\x0c")), 1, 1)
    is_json = head.isin("{", "[")
    is_xml = head == "<"
    json_ok = F.try_parse_json(text).isNotNull()
    parsed = F.from_xml(text, "_corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    xml_ok = parsed.isNotNull() & parsed["_corrupt_record"].isNull() & ~text.rlike("(?i)<!ENTITY")
    first_line = F.substring_index(text, "\n", 1)
    is_csv = text.contains("\n") & first_line.rlike("[,;\t]")
    kind = (
        F.when(signed.isNotNull(), signed)
        .when(is_json & json_ok, "application/json")
        .when(is_xml & xml_ok, "application/xml")
        .when(~is_json & ~is_xml & is_csv, "text/csv")
    )
    error = (
        F.when(signed.isNotNull(), F.lit(None).cast("string"))
        .when(is_json & ~json_ok, "MALFORMED_JSON")
        .when(is_xml & ~F.coalesce(xml_ok, F.lit(False)), "MALFORMED_XML")
        .when(kind.isNull(), "UNKNOWN_FILE_SIGNATURE")
    )
    return F.struct(kind.alias("media_type"), error.alias("error"))


def normalize_filename(name: Column) -> Column:
    """Safe base name of at most 180 characters; null where nothing safe remains."""
    path = F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"(?:/\.?)+$", "")
    base = F.substring_index(path, "/", -1)
    safe = F.trim(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "-"), F.lit(".-"))
    return F.substring(F.nullif(safe, F.lit("")), 1, FILENAME_LENGTH)


def triage_uploads(uploads: DataFrame, maximum_bytes: int) -> DataFrame:
    """Adds ``detected``, ``safe_name`` and ``reason``, the first ground for refusal or null.

    ``uploads``: ``content`` (binary), ``filename``, ``media_type`` as declared.
    """
    rows = uploads.withColumn("_sniff", sniff_media_type(F.col("content")))
    detected, declared = F.col("_sniff.media_type"), F.col("media_type")
    fits = detected == declared
    for kind, declarations in COMPATIBLE.items():
        fits = fits | ((detected == kind) & declared.isin(*declarations))
    safe = normalize_filename(F.col("filename"))
    reason = (
        F.when(~declared.isin(*ALLOWED_MEDIA_TYPES), "UNSUPPORTED_MEDIA_TYPE")
        .when(F.length("content") == 0, "EMPTY_UPLOAD")
        .when(F.length("content") > maximum_bytes, "UPLOAD_TOO_LARGE")
        .when(F.col("_sniff.error").isNotNull(), F.col("_sniff.error"))
        .when(~fits, "MEDIA_TYPE_MISMATCH")
        .when(safe.isNull(), "INVALID_FILENAME")
    )
    return rows.withColumns({"detected": detected, "safe_name": safe, "reason": reason}).drop("_sniff")


MEMBER_SCHEMA = (
    "archive_id string, pos int, name string, file_size bigint, compress_size bigint, "
    "is_link boolean, is_encrypted boolean, readable boolean, archive_error string"
)


def _members(content: bytes | None, limit: int) -> list[tuple]:
    """Directory of one archive; a member is only unpacked where its stated size is harmless."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except (zipfile.BadZipFile, OSError, ValueError):
        return [(None, None, None, None, None, None, None, "INVALID_ARCHIVE")]
    rows = []
    with archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            encrypted = bool(info.flag_bits & 1)
            harmless = info.file_size <= min(limit, MAXIMUM_RATIO * max(info.compress_size, 1))
            readable = True
            if harmless and not encrypted:
                try:
                    with archive.open(info) as stream:
                        readable = len(stream.read(limit + 1)) == info.file_size
                except (zipfile.BadZipFile, OSError, RuntimeError, EOFError, NotImplementedError):
                    readable = False
            link = stat.S_ISLNK(info.external_attr >> 16)
            rows.append((len(rows), info.filename, info.file_size, info.compress_size, link, encrypted, readable, None))
    return rows


def list_archives(archives: DataFrame, entry_limit: int = MAXIMUM_ENTRY_BYTES) -> DataFrame:
    """One row per file of each ZIP in ``archives`` (``archive_id, content``)."""
    names = [part.strip().split(" ")[0] for part in MEMBER_SCHEMA.split(",")]
    kinds = {"pos": "Int32", "file_size": "Int64", "compress_size": "Int64", "is_link": "boolean", "is_encrypted": "boolean", "readable": "boolean"}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *row) for key, content in zip(batch.archive_id, batch.content) for row in _members(content, entry_limit)]
            yield pd.DataFrame(rows, columns=names).astype(kinds)

    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content").mapInPandas(walk, MEMBER_SCHEMA)


def inspect_archives(
    members: DataFrame,
    maximum_entries: int = MAXIMUM_ENTRIES,
    maximum_entry_bytes: int = MAXIMUM_ENTRY_BYTES,
    maximum_total_bytes: int = MAXIMUM_TOTAL_BYTES,
    maximum_ratio: int = MAXIMUM_RATIO,
) -> DataFrame:
    """Members with ``violation``, the first rule each breaks, or null.

    Archives with too many files are refused as a whole, before their members are looked at in
    order, so the running total only ever sees archives of at most ``maximum_entries`` files.
    """
    members = cut(members, "members")
    sizes = members.groupBy("archive_id").agg(F.count(F.lit(1)).alias("_files"))
    rows = members.join(sizes, "archive_id")
    crowded = F.col("_files") > maximum_entries
    many = rows.filter(crowded).withColumn("violation", F.lit("ARCHIVE_ENTRY_LIMIT"))
    first = members.groupBy("archive_id", "name").agg(F.min("pos").alias("_first"))
    rows = rows.filter(~crowded).join(first, ["archive_id", "name"], "left")
    so_far = Window.partitionBy("archive_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_total", F.sum("file_size").over(so_far))
    name = F.col("name")
    escapes = (
        name.contains("\\") | name.contains("\x00") | name.startswith("/") | (name == "") | (name == ".")
        | F.concat(F.lit("/"), name, F.lit("/")).contains("/../")
    )
    suffix = F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))
    ratio = F.col("file_size") / F.when(F.col("compress_size") != 0, F.col("compress_size"))
    violation = (
        F.when(F.col("archive_error").isNotNull(), F.col("archive_error"))
        .when(escapes, "UNSAFE_ARCHIVE_PATH")
        .when(suffix.isin(*NESTED_SUFFIXES), "NESTED_ARCHIVE")
        .when(F.col("pos") > F.col("_first"), "DUPLICATE_ARCHIVE_PATH")
        .when(F.col("is_link"), "ARCHIVE_LINK")
        .when(F.col("is_encrypted"), "ENCRYPTED_ARCHIVE")
        .when(F.col("file_size") > maximum_entry_bytes, "ARCHIVE_ENTRY_TOO_LARGE")
        .when((F.col("file_size") > 0) & (ratio.isNull() | (ratio > maximum_ratio)), "ARCHIVE_COMPRESSION_RATIO")
        .when(F.col("_total") > maximum_total_bytes, "ARCHIVE_TOO_LARGE")
        .when(~F.col("readable"), "ARCHIVE_SIZE_MISMATCH")
    )
    checked = rows.withColumn("violation", violation).select(*members.columns, "violation")
    return checked.unionByName(many.select(*members.columns, "violation"))


def archive_verdicts(inspected: DataFrame) -> DataFrame:
    """One row per archive: its files, bytes and the violation of its first offending member."""
    return inspected.groupBy("archive_id").agg(
        F.count("name").alias("files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
        F.min_by("violation", F.when(F.col("violation").isNotNull(), F.coalesce("pos", F.lit(0)))).alias("violation"),
    )
