"""Corpus scan: one row per source file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from strata.functions.ids import EXTENSIONS, base_name, ext_name, language, norm_path
from strata.sources.files import read_files, with_options  # noqa: F401
from strata.sources.globs import dotted, ignore_patterns, ignore_regex


def as_sources(df: DataFrame) -> DataFrame:
    """``path`` and ``text`` completed to the source schema."""
    path = norm_path("path")
    return df.withColumns({
        "path": path, "name": base_name(path), "extension": ext_name(path),
        "language": language(ext_name(path))})


def _any_case(ext: str) -> str:
    """Path pattern of an extension in whatever case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def scan_roots(spark: SparkSession, root: str, globs, exts=EXTENSIONS) -> list[str]:
    """The folders one level below ``root`` that no pattern ignores, so that ignored trees are never listed,
    and one pattern for the source files in ``root`` itself. Files are not held, only looked at."""
    rx = re.compile(ignore_regex(globs)) if globs else None
    wanted = tuple(e.lower() for e in dotted(exts))
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(folder)
    folders, has_files = [], False
    while listed.hasNext():
        s = listed.next()
        path = s.getPath().toUri().getPath()
        if s.isDirectory():
            if not (rx and rx.search(path)):
                folders.append(s.getPath().toString())
        elif not s.getPath().getName().startswith(("_", ".")):
            has_files = has_files or path.lower().endswith(wanted)
    files = f"{root.rstrip('/')}/*{{{','.join(sorted({_any_case(e) for e in wanted}))}}}"
    return sorted(folders) + [files] * has_files


def scan_rows(spark: SparkSession, root: str, exts=EXTENSIONS, ignore=(), prune: bool = True, texts: bool = True) -> DataFrame:
    """(path, size, mtime, text, error) of the files below ``root``; ``error`` says why a file or folder
    has no text."""
    wanted = [e.lower() for e in dotted(exts)]
    return with_options(spark, spark.read, root, wanted, ignore_regex(ignore_patterns(ignore)), prune, texts).load()


def scan_corpus(spark: SparkSession, root: str, exts=EXTENSIONS, ignore=(), prune: bool = True,
                on_error: str = "skip", observation: Observation | None = None, texts: bool = True) -> DataFrame:
    """Files below ``root`` as (path, name, extension, language, size, mtime, text), whatever their names.

    Extension and ignore filters look at names before anything is opened; ``prune`` leaves ignored trees out of the
    listing too, with the same rows. Unreadable files and folders are skipped unless ``on_error="fail"``;
    ``observation`` counts files, bytes and errors, and ``scan_errors`` lists the latter. Without ``texts``
    no file is opened."""
    files = as_sources(scan_rows(spark, root, exts, ignore, prune, texts))
    good = F.col("error").isNull()
    if observation is not None:
        files = files.observe(observation, F.count_if(good).alias("files"), F.sum(F.when(good, F.col("size"))).alias("bytes"),
                              F.count("error").alias("errors"))
    if on_error != "skip":
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("cannot read "), "path", F.lit(": "), "error")).cast("boolean"))
    kept = files.where(good)
    return kept.select("path", "name", "extension", "language", "size", "mtime", "text")


def scan_errors(spark: SparkSession, root: str, exts=EXTENSIONS, ignore=(), prune: bool = True) -> DataFrame:
    """(path, error) of what a scan cannot list or read."""
    return scan_rows(spark, root, exts, ignore, prune).where("error is not null").select("path", "error")


def spread(sources: DataFrame, parts: int) -> DataFrame:
    """Even out a corpus of few large inputs: whole texts do not split, so rows must move."""
    return sources.repartition(parts, F.xxhash64("path"))
