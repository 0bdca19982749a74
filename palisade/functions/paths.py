"""Windows path helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Folder markers of user-writable locations.
SUSPICIOUS_FOLDERS = ("\\temp\\", "\\appdata\\", "\\downloads\\", "\\public\\")


def normalize_path(path: Column) -> Column:
    """Backslashes, lower case, null as empty."""
    return F.lower(F.translate(F.coalesce(path.cast("string"), F.lit("")), "/", "\\"))


def is_suspicious_path(path: Column, normalized: bool = False) -> Column:
    """1 when the normalised path crosses a user-writable folder, else 0."""
    norm = path if normalized else normalize_path(path)
    return reduce(Column.__or__, (F.contains(norm, F.lit(f)) for f in SUSPICIOUS_FOLDERS)).cast("int")


def file_extension(path: Column, normalized: bool = False) -> Column:
    """Alphanumeric suffix of at most 12 characters, else empty."""
    return F.regexp_extract(path if normalized else normalize_path(path), r"\.([a-z0-9]{1,12})$", 1)


def short_extension(path: Column) -> Column:
    """First four characters after the last dot, when the last path part has one; else null."""
    leaf = F.substring_index(path, "\\", -1)
    return F.when(F.contains(leaf, F.lit(".")), F.lower(F.substring(F.substring_index(path, ".", -1), 1, 4)))


def basename_image(process_key: Column) -> Column:
    """Text after the last backslash."""
    return F.substring_index(process_key, "\\", -1)


def path_lineage(path: Column) -> tuple[Column, Column]:
    """(technique, scenario) from the two parts below ``attack_techniques``, else ('unknown', parent folder)."""
    pattern = r"(?:^|/)attack_techniques/([^/]+)/([^/]+)"
    found = F.regexp_extract(path, pattern, 1)
    parent = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    return (
        F.when(found != "", found).otherwise(F.lit("unknown")),
        F.when(found != "", F.regexp_extract(path, pattern, 2)).otherwise(parent),
    )
