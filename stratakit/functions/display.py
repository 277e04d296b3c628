"""Texts and flags that a front end shows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def warning_text(path: Column, reason: Column) -> Column:
    return F.format_string("%s: %s", path, reason)


def compact_text(text: Column, most: int = 72) -> Column:
    """Long paths lose their middle folders; what is still too long loses its middle characters."""
    parts = F.split(text, "/")
    short = F.concat(F.element_at(parts, 1), F.lit("/.../"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1))
    cut = F.concat(F.substring(text, 1, 34), F.lit("..."), F.right(text, F.lit(35)))
    return F.when(F.length(text) <= most, text).when((F.size(parts) >= 3) & (F.length(F.when(F.size(parts) >= 3, short)) <= most), F.when(F.size(parts) >= 3, short)).otherwise(cut)


def byte_text(size: Column) -> Column:
    # ties go to the even digit; the formatter alone would round them up
    unit = lambda power, name: F.format_string(f"%.1f {name}", F.bround(size / F.lit(float(1024**power)), 1))
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024**2, unit(1, "KB")).when(size < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


# Percent ranges of the phases of a checkpoint.
PHASES = {
    "scan": (0, 25),
    "storeCheckpoint": (25, 70),
    "writeCheckpointMetadata": (70, 75),
    "syncCheckpoint": (75, 85),
    "readbackCheckpoint": (85, 95),
    "commitCheckpoint": (95, 99),
}


def progress_percent(phase: Column, completed: Column, total: Column, phased: Column) -> Column:
    """99 at most until the whole operation is done; null when nothing is known about the total."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), completed / F.nullif(total, F.lit(0))))
    known = F.when(total > 0, F.least(F.lit(99), F.floor(ratio * 100)))
    ranged = None
    for name, (low, high) in PHASES.items():
        value = F.least(F.lit(99), F.floor(F.lit(low) + F.lit(high - low) * F.when(total > 0, ratio).otherwise(F.lit(1.0))))
        ranged = F.when(phase == name, value) if ranged is None else ranged.when(phase == name, value)
    return F.when(phase == "uiComplete", 100).when(phase == "complete", 99).when(phased & phase.isin(*PHASES), ranged).otherwise(known).cast("int")


def latest_change_count(changes: Column, complete: Column, n_warnings: Column, exact: Column) -> Column:
    """Null where the count could mislead: an incomplete scan, warnings, or a zero from a quick comparison."""
    return F.when(complete & (n_warnings == 0) & (exact | (changes > 0)), changes)


def typed_path(value: Column) -> Column:
    """A path as users type it: without the verbatim prefix, blanks around it and separators at its end."""
    verbatim = F.substring(value, 5, 1 << 20)
    plain = F.when(~F.startswith(value, F.lit("\\\\?\\")), value).when(F.upper(F.substring(verbatim, 1, 4)) == "UNC\\", F.concat(F.lit("\\\\"), F.substring(verbatim, 5, 1 << 20))).otherwise(verbatim)
    trimmed = F.trim(plain)
    cut = F.regexp_replace(trimmed, r"[\\/]+\z", "")
    return F.when(cut == "", trimmed).otherwise(cut)


def omitted(total: Column, shown: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), total - shown)


def editor_version(text: Column) -> Column:
    """The rest of the first line that starts with m_EditorVersion:, else empty."""
    return F.trim(F.regexp_extract(text, r"(?m)^m_EditorVersion:([^\r\n]*)", 1))


def index_view(state: Column, rebuildable: Column) -> dict[str, Column]:
    state = F.coalesce(state, F.lit("current"))
    return {"available": state == "current", "rebuildable": (state != "current") & F.coalesce(rebuildable, F.lit(True))}


def recovery_guidance(conflicts: Column) -> dict[str, Column]:
    some = F.coalesce(conflicts, F.lit(0)) > 0
    return {"retryable": ~some, "can_select_files": some, "can_quarantine": ~some}


def search_text(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def matches_search(query: str, *fields: Column) -> Column:
    wanted = query.strip().lower()
    return F.lit(True) if not wanted else F.contains(search_text(*fields), F.lit(wanted))
