"""Source files as rows: scan, ignore rules, language, hash.

Spark's file listing leaves out empty files and names that begin with ``_`` or ``.``. Trees on a file system that all executors
mount are therefore walked by tasks (``walk``), which find such files and the ignore files of the tree; other stores are
listed by Spark. ``prepare`` also takes a table of files (path, modificationTime, length, content) from elsewhere.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashes import file_hash

#: Suffixes and their languages (fixed values).
LANGUAGES = {".py": "python", ".ts": "typescript", ".go": "go"}
NAMES = "*.{" + ",".join(s[1:] for s in LANGUAGES) + "}"
#: Patterns that are ignored unless switched off (fixed values).
DEFAULT_IGNORES = ["env/", ".venv/", "venv/", "node_modules/", "__pycache__/", "*.pyc", "target/", "dist/", "build/", ".git/"]


#: Names of ignore files; the rules of the later one win (fixed values).
IGNORE_FILES = (".gitignore", ".ignore")
#: Folders that are found before the walk is dealt out.
SPREAD = 64


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for suffix, language in LANGUAGES.items():
        out = F.when(path.endswith(suffix), language).otherwise(out)
    return out


def ignore_regex(pattern: str, below: bool = True) -> str:
    """A regular expression on relative paths for one ignore pattern (without its ``!``).

    It holds for all that lies below, or else for the path alone, where folders end with ``/``.
    """
    folder = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    parts = re.split(r"(/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", body.lstrip("/"))
    special = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    text = "".join(special.get(p) or (p.replace("[!", "[^") if p.startswith("[") and p.endswith("]") else re.escape(p)) for p in parts)
    end = ("/" if folder else "(?:/|$)") if below else ("/$" if folder else "/?$")
    return f"^{'' if anchored else '(?:.*/)?'}{text}{end}"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that fits says so; ``!`` takes back, ``#`` is a comment."""
    out = F.lit(False)
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            out = F.when(path.rlike(ignore_regex(p.lstrip("!"))), not p.startswith("!")).otherwise(out)
    return out


def local_path(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def mounted(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` is a path of a mounted file system."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root):
        return root.startswith("file:")
    return spark.conf.get("spark.hadoop.fs.defaultFS", "file:///").startswith("file:")


def _entries(folder: str) -> tuple[list[os.DirEntry], list[str]]:
    """The files of a folder that count, and the folders below it; hidden ones don't, nor do links. A folder that can't be read is empty."""
    try:
        with os.scandir(folder) as found:
            all_ = list(found)
    except OSError:
        return [], []
    own = [e for e in all_ if e.is_file(follow_symlinks=False) and (e.name in IGNORE_FILES or not e.name.startswith("."))]
    return own, [e.path for e in all_ if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]


def walk(spark: SparkSession, root: str, places: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length) of the source and ignore files at or below places in ``root``, itself if none are given.

    The driver opens folders until there are ``SPREAD`` of them; tasks walk these. Ignore files between ``root`` and a place count. Places that aren't there give no rows.
    """
    base = local_path(root).rstrip("/")
    singles, folders, opened = set(), [], 0
    for place in map(local_path, places or [root]):
        above = place.rstrip("/")
        (folders.append(above or "/") if os.path.isdir(place) else singles.add(place))
        while above.startswith(f"{base}/"):
            above = os.path.dirname(above)
            singles |= {f"{above}/{name}" for name in IGNORE_FILES}
    while opened < len(folders) < SPREAD:  # from the front: broad first
        own, below = _entries(folders.pop(0))
        singles |= {e.path for e in own}
        folders += below
    suffixes = tuple(LANGUAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, deep in batch.itertuples(index=False):
                todo, rows = [path], []
                while todo:
                    here = todo.pop()
                    own, below = _entries(here) if deep else ([here], [])
                    todo += below
                    for entry in own:
                        if str(getattr(entry, "name", here)).endswith((*suffixes, *IGNORE_FILES)):
                            try:
                                facts = os.stat(entry)
                            except OSError:  # gone meanwhile
                                continue
                            rows.append((os.fspath(entry), facts.st_mtime_ns // 1000, facts.st_size))
                yield pd.DataFrame(rows, columns=["path", "mtime", "length"])

    tasks = [(p, True) for p in folders] + [(p, False) for p in sorted(singles)]
    found = spark.createDataFrame(tasks, "path string, deep boolean").repartition(max(1, min(len(tasks), SPREAD))).mapInPandas(run, "path string, mtime long, length long")
    return found.select("path", F.timestamp_micros("mtime").alias("modificationTime"), "length").dropDuplicates(["path"])


def read(found: DataFrame) -> DataFrame:
    """Found files with their content; null for those that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):  # a row each, so a batch isn't held whole
                row = batch.iloc[i : i + 1]
                try:
                    with open(row.path.iloc[0], "rb") as file:
                        content = file.read()
                except OSError:
                    content = None
                yield row.assign(content=[content])

    out = found.select("path", F.unix_micros("modificationTime").alias("at"), "length").mapInPandas(run, "path string, at long, length long, content binary")
    return out.select("path", F.timestamp_micros("at").alias("modificationTime"), "length", "content")


def tree_rules(ignore_files: DataFrame, root: str) -> DataFrame:
    """(folder, rule): the rules of ignore files (path, content), rule = struct(order, regex, ignore); folders are relative, the root's is empty."""
    base = local_path(root).rstrip("/") + "/"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in batch.itertuples(index=False):
                folder, name = os.path.split(path[len(base) :])
                for n, line in enumerate(bytes(content or b"").decode("utf-8", "replace").splitlines()):
                    line = line if line.endswith("\\ ") else line.rstrip()
                    body = line.removeprefix("!").removeprefix("\\")
                    if body.strip("/") and not line.startswith("#"):
                        rows.append((folder, folder.count("/") + 1 if folder else 0, IGNORE_FILES.index(name), n, ignore_regex(body, below=False), not line.startswith("!")))
            yield pd.DataFrame(rows, columns=["folder", "depth", "kind", "n", "regex", "ignore"])

    rules = ignore_files.select("path", "content").mapInPandas(run, "folder string, depth int, kind int, n int, regex string, ignore boolean")
    return rules.select("folder", F.struct(F.struct("kind", "depth", "n").alias("order"), "regex", "ignore").alias("rule"))


def drop_ignored(found: DataFrame, rules: DataFrame, root: str) -> DataFrame:
    """``found`` less the files that rules of the tree leave out.

    For each folder of a path, and the path itself, the last rule that fits decides: of the later kind of ignore file, the deepest folder, the last
    line. What lies below an ignored folder can't be taken back.
    """
    base = local_path(root).rstrip("/") + "/"
    parts = F.split(F.expr(f"substring(path, {len(base) + 1})"), "/")
    steps = found.select("path", parts.alias("parts")).select("path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("step"))
    steps = steps.select("path", "parts", "step", F.explode(F.sequence(F.lit(0), F.col("step") - 1)).alias("depth"))
    below = F.expr("array_join(slice(parts, depth + 1, step - depth), '/')")
    steps = steps.select("path", "step", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("folder"), F.concat(below, F.when(F.col("step") < F.size("parts"), "/").otherwise("")).alias("below"))
    fits = steps.join(rules, "folder").filter(F.expr("below rlike rule.regex"))
    out = fits.groupBy("path", "step").agg(F.max_by("rule.ignore", "rule.order").alias("ignore")).filter("ignore").select("path").distinct()
    return found.join(out, "path", "left_anti")


def _wanted(files: DataFrame, root: str, ignore: list[str] | None = None, defaults: bool = True, languages: list[str] | None = None) -> DataFrame:
    """Files with their relative path and language, less those of other languages and those that the settings leave out."""
    base = local_path(root).rstrip("/") + "/"
    full = F.regexp_replace("path", "^file:/+", "/")
    rows = files.withColumn("file_path", F.when(full.startswith(base), F.substring(full, len(base) + 1, 1 << 30)).otherwise(full))
    rows = rows.withColumn("language", language_of(F.col("file_path"))).filter(F.col("language").isin(languages or list(LANGUAGES.values())))
    return rows.filter(~ignored(F.col("file_path"), (DEFAULT_IGNORES if defaults else []) + (ignore or [])))


def prepare(files: DataFrame, root: str, ignore: list[str] | None = None, defaults: bool = True, languages: list[str] | None = None) -> DataFrame:
    """(file_path, language, text, hash, mtime, file_size, error) of binary files below ``root``.

    Files of other languages and ignored ones go. Those that can't be read and bytes that aren't UTF-8 give an error and no text; the
    other files go on. An empty file has an empty text.
    """
    rows = _wanted(files, root, ignore, defaults, languages)
    text, mtime = F.col("content").cast("string"), F.unix_timestamp("modificationTime")
    valid = F.is_valid_utf8(text)
    return rows.select(
        "file_path", "language", F.when(valid, text).alias("text"), file_hash("content", mtime).alias("hash"),
        mtime.alias("mtime"), F.col("length").alias("file_size"), F.when(F.col("content").isNull(), F.lit("can't be read")).when(~valid, F.lit("not UTF-8")).alias("error"),
    )


def scan(spark: SparkSession, root: str, places: list[str] | None = None, **rules) -> DataFrame:
    """``prepare`` of all files at or below places in ``root``, itself if none are given; files that are left out aren't read.

    Outside mounted file systems hidden and empty files and ignore files of the tree are missed.
    """
    if not mounted(spark, root):
        return prepare(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", NAMES).load(places or [root]), root, **rules)
    found = walk(spark, root, places)
    own = F.element_at(F.split("path", "/"), -1).isin(*IGNORE_FILES)
    kept = drop_ignored(_wanted(found.filter(~own), root, **rules).select(found.columns), tree_rules(read(found.filter(own)), root), root)
    return prepare(read(kept), root, **rules)
