"""Output names, guards and table sinks; PDF bytes are a provider's work."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIXES = {"ocr": "_ocr", "ocr_bookmark": "_ocr_bookmark", "bookmark": "_bookmark", "searchable": "_searchable", "toc": "_toc"}


def output_path(source: Column, directory: Column, mode: str) -> Column:
    """directory / stem of source + the mode's suffix."""
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/\\]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    return F.concat(F.regexp_replace(directory, r"/+\z", ""), F.lit("/"), stem, F.lit(SUFFIXES[mode] + (".txt" if mode == "toc" else ".pdf")))


def output_problem(source: str, target: str, overwrite: bool = False) -> str | None:
    """Why target cannot be written for source, or None."""
    if os.path.abspath(source) == os.path.abspath(target) or os.path.exists(target) and os.path.exists(source) and os.path.samefile(source, target):
        return "same_file"
    if not os.path.isdir(os.path.dirname(os.path.abspath(target))):
        return "no_directory"
    return "exists" if os.path.exists(target) and not overwrite else None


def write_table(frame: DataFrame, path: str, overwrite: bool = False) -> None:
    """Written whole or not at all, by the file committer; an existing table is an error by default."""
    frame.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
