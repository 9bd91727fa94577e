"""Column expressions on cluster paths such as ``3:12:7``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = ":"


def depth(path: Column, sep: str = SEPARATOR) -> Column:
    """Number of parts of a path."""
    return F.size(F.split(path, re.escape(sep)))


def prefixes(path: Column, sep: str = SEPARATOR) -> Column:
    """Every leading sub-path, from the first part to the whole path."""
    return F.transform(
        F.sequence(F.lit(1), depth(path, sep)),
        lambda k: F.call_function("substring_index", path, F.lit(sep), k),
    )


def shared_depth(a: Column, b: Column, sep: str = SEPARATOR) -> Column:
    """Length of the common leading sub-path."""
    return F.size(F.array_intersect(prefixes(a, sep), prefixes(b, sep)))


def tree_distance(a: Column, b: Column, sep: str = SEPARATOR) -> Column:
    """Part of the mean depth that the two paths do not share: 0 for equal paths, 1 for no overlap."""
    return F.lit(1.0) - 2.0 * shared_depth(a, b, sep) / (depth(a, sep) + depth(b, sep))


def path_length(a: Column, b: Column, sep: str = SEPARATOR) -> Column:
    """Number of tree edges between two paths."""
    return depth(a, sep) + depth(b, sep) - 2 * shared_depth(a, b, sep)


def first_part(path: Column, sep: str = SEPARATOR) -> Column:
    """Top level of a path as an integer; null when it is not a number."""
    return F.call_function("substring_index", path, F.lit(sep), F.lit(1)).try_cast("int")
