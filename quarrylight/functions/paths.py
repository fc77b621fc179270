"""Path policy as column expressions: canonical form, exclusion, inventory order, parents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that hold no sources.
EXCLUDED_SEGMENTS = (".git", "target", "build", ".gradle", "node_modules", "generated")
EXCLUDED_ENDING = ".class"


def is_canonical(path: Column) -> Column:
    """Relative, no backslash, control character, drive, empty, ``.`` or ``..`` segment."""
    return (
        (F.length(path) > 0)
        & ~path.rlike(r"[\\\x00-\x1f\x7f]")
        & ~path.rlike(r"^[A-Za-z]:")
        & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    )


def is_excluded(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.isin(*EXCLUDED_SEGMENTS) | s.endswith(EXCLUDED_ENDING))


def inventory_key(path: Column, kind: Column) -> Column:
    """The inventory is in the order of this key, by unsigned UTF-8 bytes."""
    return F.when(kind == "DIRECTORY", F.concat(path, F.lit("/"))).otherwise(path)


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def utf16_order(path: Column) -> Column:
    """Documents are ordered by UTF-16 units, not by bytes."""
    return F.encode(path, "UTF-16BE")


def within_roots(path: Column, roots: list[str]) -> Column:
    """Paths below one of the source roots; the empty root is all."""
    out = F.lit(False)
    for root in sorted(set(roots)):
        out = out | (F.lit(True) if root == "" else path.startswith(root + "/"))
    return out


def is_guide(path: Column, status: Column, guide_path: Column, guide_state: Column) -> Column:
    """Whether a file is its project's guide: available, the same path, readable."""
    return F.coalesce((guide_state == "AVAILABLE") & (path == guide_path) & (status == "TEXT"), F.lit(False))


def has_credentials(url: Column) -> Column:
    """Addresses that carry a user or a password; they are never stored."""
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")


def below(path: Column, directory: str) -> Column:
    """Paths below a directory; the empty directory is the root.  A prefix test, so scans can prune by it."""
    return path.startswith(directory + "/") if directory else F.lit(True)
