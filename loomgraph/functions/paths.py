"""Path predicates and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that mark a file as a test, as the graph side sees it.
TEST_DIRECTORIES = ["tests", "test", "testing", "__tests__", "spec", "__specs__"]
# The shorter list the learner-facing side uses, directories only.
LEARNER_TEST_DIRECTORIES = ["tests", "test", "__tests__", "spec", "specs"]


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda part: part != "")


def base_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def directories(path: Column) -> Column:
    parts = segments(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _any_directory(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(directories(path), F.array(*[F.lit(n) for n in names]))


def is_test_scoped(path: Column) -> Column:
    """A test directory above the file, or a test-like file stem."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")
    return _any_directory(path, TEST_DIRECTORIES) | stem.rlike(r"^test_|_test$|^conftest$")


def is_learner_test_scoped(path: Column) -> Column:
    return _any_directory(path, LEARNER_TEST_DIRECTORIES)


def parent_directory(path: Column) -> Column:
    parent = F.array_join(directories(path), "/")
    return F.when(parent == "", ".").otherwise(parent)


def path_tail(path: Column) -> Column:
    parts = segments(path)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), "/")).when(
        F.size(parts) == 1, parts[0]
    ).otherwise(path)


def top_directory(path: Column, root_label: str = ".") -> Column:
    parts = segments(path)
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(root_label))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for dotless and dot-led names."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
