"""Predicates and derived columns over paths and ids. All are Column expressions that stay in the JVM, but the portable key."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tracked roots, and names that some file systems reserve.
ROOTS = ("Assets", "Packages", "ProjectSettings")
RESERVED = r"^(?:CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|(?:COM|LPT)[1-9¹²³])$"
FORBIDDEN = r'[\x00-\x1F<>"|?*:\\]'
TEMP_PREFIX = ".strata"


def is_reserved_name(segment: Column) -> Column:
    """The part before the first dot is a device name, in any ASCII case."""
    stem = F.element_at(F.split(segment, r"\."), 1)
    return F.translate(stem, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").rlike(RESERVED)


def segment_problem(segment: Column) -> Column:
    return (
        F.when(segment == "", "a segment is empty")
        .when(segment.isin(".", ".."), "a segment is . or ..")
        .when(segment.rlike(r"[ .]$"), "a segment ends in a blank or dot")
        .when(segment.rlike(FORBIDDEN), "a segment holds a character that some file systems refuse")
        .when(is_reserved_name(segment), "a segment names a device")
    )


def path_problem(path: Column) -> Column:
    """Why a tracked path is invalid: the first rule that fails, segments from left to right; null if it is valid. Null path: null."""
    segments = F.split(path, "/", -1)
    problems = F.filter(F.transform(segments, segment_problem), lambda x: x.isNotNull())
    return (
        F.when(path == "", "no path")
        .when(path.contains("\\"), "holds a backslash")
        .when(path.contains(":"), "holds a colon")
        .when(path.startswith("/"), "starts at the root")
        .when(F.size(segments) < 2, "names a tracked root itself")
        .when(~F.element_at(segments, 1).isin(*ROOTS), "lies in no tracked root")
        .otherwise(F.get(problems, F.lit(0)))
    )


def is_tracked_path(path: Column) -> Column:
    return path.isNotNull() & path_problem(path).isNull()


def is_object_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def is_project_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9a-f]{32}\z"), F.lit(False))


def is_plan_id(value: Column, prefix: str = "") -> Column:
    return F.coalesce(value.rlike(rf"\A{prefix}[0-9a-f]{{64}}\z"), F.lit(False))


def is_owned_temp(path: Column, prefix: str = TEMP_PREFIX) -> Column:
    """Base names that the engine gives to files it is writing: with a 32-digit id, for repairs with a 16-digit digest too."""
    name = F.element_at(F.split(path, "/"), -1)
    p = prefix.replace(".", r"\.")
    return name.rlike(rf"\A{p}-(?:r-[0-9a-f]{{16}}-)?[0-9a-f]{{32}}\.tmp\z")


def is_object_temp(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(r"\Aobject-[0-9a-f]{32}\.tmp\z")


def location_problem(location: Column) -> Column:
    """Why a stored object lies at a wrong place: objects/loose/<first two digits>/<64 digits>; null if it is right."""
    parts = F.split(location, "/", -1)
    prefix, name = F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    return (
        F.when((F.size(parts) != 4) | (F.get(parts, F.lit(0)) != "objects") | (F.get(parts, F.lit(1)) != "loose"), "lies outside the object folder")
        .when(F.length(prefix) != 2, "shard is not of two digits")
        .when(F.length(name) != 64, "name is not of 64 digits")
        .when(F.substring(name, 1, 2) != prefix, "lies in the shard of other objects")
        .when(~is_object_id(name), "name is not in small hex digits")
    )


def object_location(object_id: Column) -> Column:
    return F.concat(F.lit("objects/loose/"), F.substring(object_id, 1, 2), F.lit("/"), object_id)


def snapshot_location(snapshot_id: Column) -> Column:
    return F.concat(F.lit("snapshots/"), F.substring(snapshot_id, 1, 2), F.lit("/"), F.substring(snapshot_id, 3, 2), F.lit("/"), snapshot_id)


def is_descendant(child: Column, parent: Column) -> Column:
    """Strictly below, at a slash."""
    return F.startswith(child, F.concat(parent, F.lit("/")))


def ancestors(path: Column) -> Column:
    """All proper folder prefixes, shortest first; empty for a path of one segment."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def companion(path: Column) -> Column:
    """X <-> X.meta, under Assets only; null where the result is no tracked path."""
    other = F.when(path.endswith(".meta"), F.regexp_replace(path, r"\.meta\z", "")).otherwise(F.concat(path, F.lit(".meta")))
    return F.when(path.startswith("Assets/") & is_tracked_path(other), other)


def relative_to(path: Column, root: str) -> Column:
    """The path below ``root``, with forward slashes; null outside it."""
    plain = F.regexp_replace(path, r"\\", "/")
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 20))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def fingerprint(*parts: Column) -> Column:
    """Device, inode, length, mtime, ctime joined by colons; null if one is missing."""
    return F.when(F.forall(F.array(*[p.cast("string") for p in parts]), lambda x: x.isNotNull()), F.concat_ws(":", *parts))


@F.pandas_udf(StringType())
def _portable(paths: pd.Series) -> pd.Series:  # Spark has no Unicode normalisation: the one place where the engine needs Python
    import unicodedata

    norm = unicodedata.normalize
    return paths.map(lambda p: None if p is None else norm("NFC", norm("NFC", p).lower()), na_action="ignore")


def portable_key(path: Column) -> Column:
    """NFC, full lower case, NFC: paths with equal keys collide on case-insensitive file systems.

    Pure-ASCII paths need no normalisation and take the built-in ``lower``; Python gets a null in their place, since a
    function inside a CASE is evaluated for every row. Normalisation follows the Unicode version of the workers' Python
    (``unicodedata.unidata_version``, 15.1 in 3.13): characters that later versions add or recase keep their form.
    """
    plain = path.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain, F.lower(path)).otherwise(_portable(F.when(~plain, path)))
