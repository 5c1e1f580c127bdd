"""Path expressions that stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_path(path: Column) -> Column:
    """``path`` without empty, ``.`` and ``..`` segments.

    A leading slash stays, ``..`` above an absolute root vanishes, leading ``..`` of a relative path stay.
    Null stays null; the empty text stays empty. Only paths that need work go through the fold.
    """
    rooted = path.startswith("/")
    empty = F.array().cast("array<string>")

    def step(done: Column, seg: Column) -> Column:
        last = F.element_at(done, -1)
        up = F.when((F.size(done) > 0) & (last != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        up = up.when(rooted, done).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when((seg == "") | (seg == "."), done).when(seg == "..", F.when(F.size(done) == 0, F.when(rooted, done).otherwise(F.array(F.lit("..")))).otherwise(up)).otherwise(F.concat(done, F.array(seg)))

    folded = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))
    return F.when(path.rlike(r"//|(^|/)\.{1,2}(/|$)|.+/$"), folded).otherwise(path)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Text before the last slash; the empty text if there is none."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), r"^$", "")
