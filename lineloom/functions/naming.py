"""Column expressions over paths and dotted names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names that mark a layer, in order of precedence.
LAYER_MARKS = (("bronze", ("bronze", "bronce")), ("silver", ("silver",)), ("gold", ("gold",)))

# Folder names that are a layer and therefore never a dataset.
LAYER_FOLDERS = ("bronze", "bronce", "silver", "gold", "other")

# Documented folder aliases of each layer, (alias, layer, priority).
LAYER_ALIASES = (
    ("bronze", "bronze", 1),
    ("raw", "bronze", 1),
    ("landing", "bronze", 1),
    ("staging", "bronze", 1),
    ("silver", "silver", 2),
    ("intermediate", "silver", 2),
    ("conformed", "silver", 2),
    ("gold", "gold", 3),
    ("mart", "gold", 3),
    ("serving", "gold", 3),
    ("presentation", "gold", 3),
)


def file_base(path: Column) -> Column:
    """File name without folder and ``.sql``: the id of a script."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.sql$", "")


def folder_of(path: Column) -> Column:
    """Folder part of a relative path, '' for the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def layer_of(path: Column) -> Column:
    """Layer from the lower-cased whole path; the first mark found wins."""
    lowered = F.lower(path)
    out = None
    for layer, marks in LAYER_MARKS:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | lowered.contains(mark)
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    return out.otherwise("other")


def below(path: Column, root: str) -> Column:
    """The path below ``root``, so that the root's own name marks no layer."""
    if not root:
        return path
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def alias_layer_of(path: Column) -> Column:
    """Layer by the documented folder aliases; the lowest priority number wins."""
    folders = F.split(F.lower(folder_of(path)), "/")
    out = F.lit("other")
    for alias, layer, _ in sorted(LAYER_ALIASES, key=lambda a: -a[2]):
        out = F.when(F.array_contains(folders, alias), layer).otherwise(out)
    return out


def folder_prefixes(folder: Column) -> Column:
    """``a/b/c`` -> [a, a/b, a/b/c]; empty for the root."""
    parts = F.split(folder, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(prefixes)


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)
