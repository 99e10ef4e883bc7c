"""Source trees as DataFrames: discovery, ignore rules, text, language and content hash."""

from __future__ import annotations

import fnmatch
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.schema import language_of

#: Directories that are never entered.
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", "target", "build", "dist", ".next", ".nuxt", "vendor", ".venv", "venv", "env", ".env", ".tox",
    ".mypy_cache", ".pytest_cache", ".quern",
)


def ignored(path: Column) -> Column:
    """Whether a directory of a relative path is hidden or ignored, or the file itself is hidden."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*IGNORED_DIRECTORIES)) | F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", ".."))


class IgnoreRules:
    """The rules of .gitignore files of a tree (by directory), the last matching rule winning."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        """``rules``: (directory of the file, its text)."""
        self.rules = []
        for base, text in sorted(rules, key=lambda r: r[0].count("/") + bool(r[0])):
            for line in text.splitlines():
                line = re.sub(r"(?<!\\)\s+$", "", line)
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                body = line[keep:].replace("\\#", "#").replace("\\!", "!")
                only_dirs = body.endswith("/")
                body = body.rstrip("/")
                anchored = "/" in body
                self.rules.append((base, re.compile(self._regex(body.lstrip("/"), anchored)), keep, only_dirs))

    @staticmethod
    def _regex(glob: str, anchored: bool) -> str:
        out = "".join(
            "(?:.*/)?" if p == "**/" else ".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else p.replace("[!", "[^") if p[:1] == "[" and len(p) > 1 else re.escape(p)
            for p in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|.", glob)
        )
        return f"^{'' if anchored else '(?:.*/)?'}{out}$"

    def matches(self, path: str) -> bool:
        """Whether a file is ignored, itself or through one of its directories."""
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            here, verdict = "/".join(parts[:k]), None
            for base, regex, keep, only_dirs in self.rules:
                inside = here[len(base) + 1 :] if base and here.startswith(base + "/") else here if not base else None
                if inside and not (only_dirs and k == len(parts)) and regex.match(inside):
                    verdict = not keep
            if verdict:
                return True
        return False


def git_rules(root: str) -> IgnoreRules:
    """Rules of a local tree: the repository's exclude file and every .gitignore outside ignored directories."""
    found = []
    exclude = os.path.join(root, ".git", "info", "exclude")
    if os.path.exists(exclude):
        with open(exclude, encoding="utf-8", errors="replace") as f:
            found.append(("", f.read()))
    for at, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in IGNORED_DIRECTORIES and not fnmatch.fnmatch(d, ".*")]
        if ".gitignore" in names:
            with open(os.path.join(at, ".gitignore"), encoding="utf-8", errors="replace") as f:
                base = os.path.relpath(at, root).replace(os.sep, "/")
                found.append(("" if base == "." else base, f.read()))
    return IgnoreRules(found)


def scan(spark: SparkSession, root: str, rules: IgnoreRules | None = None) -> DataFrame:
    """(path, relative_path, language, text, content_hash, size_bytes) of the supported files of a tree.

    Files that are no valid UTF-8 are skipped. Listing and reading happen on the executors.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.substring(plain, F.lit(len(root.rstrip("/")) + 2), F.length(plain))
    files = raw.select(plain.alias("path"), rel.alias("relative_path"), "content", F.col("length").alias("size_bytes"))
    files = files.where(~ignored(F.col("relative_path"))).withColumn("language", language_of(F.col("relative_path"))).where("language <> 'unknown'")
    if rules is not None and rules.rules:
        @F.pandas_udf("boolean")
        def hidden(paths: pd.Series) -> pd.Series:
            return paths.map(rules.matches).astype(bool)

        files = files.where(~hidden("relative_path"))
    valid = files.where(F.expr("is_valid_utf8(content)"))
    text = F.decode("content", "UTF-8")
    return valid.select("path", "relative_path", "language", text.alias("text"), F.sha2("content", 256).alias("content_hash"), "size_bytes")
