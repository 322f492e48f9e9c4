"""Ids, scenes and tasks read out of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    """The folder that holds the file; empty without one."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def infer_id(path: Column) -> Column:
    """The folder if it is a number, else the stem up to its first ``_``, then first ``-``."""
    folder = parent(path)
    return F.when(folder.rlike("^[0-9]+$"), folder).otherwise(F.split_part(F.split_part(stem(path), F.lit("_"), F.lit(1)), F.lit("-"), F.lit(1)))


def scene_prefix(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def has_extension(path: Column, extensions: list[str]) -> Column:
    return F.lower(path).rlike("(" + "|".join(e.lower().replace(".", r"\.") for e in extensions) + ")$")


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def strip_wrappers(key: Column) -> Column:
    """A parameter key without what training wrappers put before it: ``module.``, then ``model.``."""
    return F.regexp_replace(F.regexp_replace(key, r"^module\.", ""), r"^model\.", "")


def replace_prefix(key: Column, old: str, new: str) -> Column:
    """``old`` at the start replaced by ``new``, where it is not there already."""
    return F.when(key.startswith(old) & ~key.startswith(new), F.concat(F.lit(new), F.substr(key, F.lit(len(old) + 1)))).otherwise(key)
