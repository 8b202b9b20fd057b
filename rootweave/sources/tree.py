"""File trees as tables: discovery, ignore rules, text and hashes."""

from __future__ import annotations

import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from rootweave.functions import paths as P

DENIED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".venv", "venv", "build", "dist", "target", ".next")
#: Ignore files that are read where a caller names no others.
IGNORE_FILES = (".gitignore", ".cursorignore", ".claudeignore", ".codeindexignore")
MAX_BYTES = 1_000_000


def glob_regex(pattern: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression for whole paths, negated), or None for blanks and comments."""
    line = pattern.rstrip("\n").rstrip() if not pattern.rstrip("\n").endswith("\\ ") else pattern.rstrip("\n")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith("\\") and line[1:2] in "#!" else line
    only_dir = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while i + 1 < len(body) and body[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            inner = re.sub(r"[\\\[&]", r"\\\g<0>", body[i + 1 : j])
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", j + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_dir else "(?:/.*)?$"), negated


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore-file lines exclude a path; the last line that matches decides."""
    out = F.lit(False)
    for p in patterns:
        if rule := glob_regex(p):
            out = F.when(path.rlike(rule[0]), not rule[1]).otherwise(out)
    return out


def in_denied_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in DENIED]))


@F.pandas_udf(StringType())
def decode_utf8(contents: pd.Series) -> pd.Series:
    """Bytes as text; malformed ones are dropped."""
    return contents.map(lambda b: bytes(b).decode("utf-8", errors="ignore") if b is not None else None)


def listing(root: str) -> list[tuple[str, int, int]]:
    """(path relative to root, bytes, mtime in ns) of all files under root, hidden ones too; denied directories aren't entered.

    root is a path or URI of any file system that Arrow knows. Listing is the driver's part; files are read by the cluster.
    """
    system, base = _file_system(root)
    out: list[tuple[str, int, int]] = []
    todo = [base]
    while todo:
        for f in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
            if f.type == fs.FileType.Directory:
                if f.base_name not in DENIED:
                    todo.append(f.path)
            elif f.type == fs.FileType.File:
                out.append((f.path[len(base) :].lstrip("/"), f.size, f.mtime_ns or 0))
    return sorted(out)


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.rstrip("/"))


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = MAX_BYTES, with_content: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Indexable files under root: file_id, path, lang, size_bytes, mtime_ns, parser, is_generated, sha256 and content.

    Path, size and language gates come before any file is opened; without content the scan is metadata only. only (path)
    limits the files that are opened.
    """
    files = spark.createDataFrame(listing(root), "path string, length long, mtime_ns long")
    path = F.col("path")
    found = files.where(~in_denied_directory(path) & ~is_ignored(path, patterns or []) & ~P.is_secret_name(path) & (F.col("length") <= max_bytes))
    found = found if only is None else found.join(only.select("path").distinct(), "path", "left_semi")
    known = found.withColumn("lang", P.language(path)).where("lang IS NOT NULL")
    known = known.select(F.xxhash64("path").alias("file_id"), "path", "lang", F.col("length").alias("size_bytes"), "mtime_ns", P.parser(F.col("lang")).alias("parser"), P.is_generated(path).alias("is_generated"))
    if not with_content:
        return known

    @F.pandas_udf(BinaryType())
    def read(paths: pd.Series) -> pd.Series:
        system, base = _file_system(root)

        def one(p: str) -> bytes | None:
            try:
                with system.open_input_stream(f"{base}/{p}") as f:
                    return f.read()
            except OSError:
                return b""

        return paths.map(one)

    opened = known.repartition("path").withColumn("__bytes", read("path"))
    text = opened.where(~P.looks_binary(F.col("__bytes")))
    return text.withColumns({"sha256": F.sha2("__bytes", 256), "content": decode_utf8(F.col("__bytes"))}).drop("__bytes")


def ignore_patterns(root: str, extra: list[str] | None = None, names: tuple[str, ...] = IGNORE_FILES) -> list[str]:
    """The lines of the root's ignore files, in order, and extra ones."""
    system, base = _file_system(root)
    out: list[str] = []
    for name in names:
        if system.get_file_info(f"{base}/{name}").type == fs.FileType.File:
            with system.open_input_stream(f"{base}/{name}") as f:
                out += f.read().decode("utf-8", "ignore").splitlines()
    return out + (extra or [])
