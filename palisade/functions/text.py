"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import DEFAULT_PID

# Tool names looked for in command lines.
TOOL_NAMES = ("vssadmin", "wbemtest", "bcdedit", "wmic", "powershell", "cmd.exe /c")


def first_truthy(*columns: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def escape_like(value: Column) -> Column:
    """Backslash-escape LIKE wildcards."""
    for char in ("\\", "%", "_"):
        value = F.replace(value, F.lit(char), F.lit("\\" + char))
    return value


def contains_ci(column: Column, value: str) -> Column:
    """Case-insensitive plain substring test; null never matches."""
    return F.coalesce(F.contains(F.lower(column.cast("string")), F.lit(value.lower())), F.lit(False))


def ilike_escaped(column: Column, value: str) -> Column:
    """Case-insensitive LIKE '%value%' with wildcards of ``value`` taken literally."""
    for char in ("\\", "%", "_"):
        value = value.replace(char, "\\" + char)
    return column.ilike(f"%{value}%")


def keyword_hit(command_line: Column) -> Column:
    """True when the command line mentions one of the tool names."""
    pattern = "|".join(name.replace(".", r"\.") for name in TOOL_NAMES)
    return F.coalesce(F.lower(command_line).rlike(pattern), F.lit(False))


def pid_from_key(process_key: Column, default: int | None = DEFAULT_PID) -> Column:
    """Digits after the last colon as an int, else ``default``."""
    pid = F.regexp_extract(process_key, r":(\d+)$", 1).try_cast("int")
    return pid if default is None else F.coalesce(pid, F.lit(default))
