"""The tables of an index: segments of Parquet files, and a log of versions.

A segment is what one commit wrote, in folders of its own name; nothing in it changes later. A version is a JSON file of the log that names
the segments that count, with totals and state. It appears whole, by a link or a rename that fails where the name is taken: of two
writers one publishes a version, and readers of older versions keep their segments. Folders of failed or overtaken commits are never read.

chunks: rows by file, ids growing. postings: blocks of the rows of a file of chunks, by term and row ids. terms: how a commit changed document frequencies. deleted: bitmaps of the row ids that it
took out of earlier segments. files: all files of a version, one row each.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import blocks, code

FILES = "file_path string, hash string, mtime long, file_size long, language string, chunk_count long, indexed_at long, since int"
CHUNKS = f"row_id long, {code.SCHEMA}, doc_len long"
SCHEMAS = {"files": FILES, "chunks": CHUNKS, "postings": blocks.SCHEMA, "terms": "term string, df long", "deleted": "bucket long, bitmap binary"}
#: File systems on which a link is what makes a file appear whole and once.
LINKED = {"file"}
_scratch: dict[str, str] = {}


class StoreError(RuntimeError):
    """No index at the place."""


class ConflictError(RuntimeError):
    """Another writer has changed the rows that a commit was made from: run it again."""


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or in a temporary one where that is unset in a local session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _scratch.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quarry-"))
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@dataclass
class Segment:
    """``first`` to ``last``: the row ids that it may hold; ``tables``: what it has."""

    name: str
    first: int
    last: int
    n_rows: int
    tables: list[str]


@dataclass
class Version:
    """``changes`` counts versions that changed rows; a compaction doesn't. ``files``: the segment with the table of files."""

    number: int = 0
    changes: int = 0
    segments: list[Segment] = field(default_factory=list)
    files: str | None = None
    n_rows: int = 0
    n_tokens: int = 0
    next_row: int = 1
    state: dict[str, str | None] = field(default_factory=dict)


class Log:
    """Files that are put once each, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.conf)

    def names(self) -> list[str]:
        fs, path = self._fs(), self._path()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Put a file whole; False if there is one. On a local file system by a link, elsewhere by a rename that doesn't overwrite."""
        fs, draft = self._fs(), f".{name}.{uuid.uuid4().hex}"
        stream = fs.create(self._path(draft))
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if fs.getScheme() in LINKED:
                place = self.jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(self._path()).toString()
                os.link(f"{place}/{draft}", f"{place}/{name}")
            else:
                options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(self._path(draft), self._path(name), options)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            fs.delete(self._path(draft), False)
        return True

    def delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, f"{self.root}/log")

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in map(re.compile(r"(\d+)\.json$").match, self.log.names()) if m)

    def version(self) -> int | None:
        """The newest version's number."""
        return max(self.numbers(), default=None)

    def at(self, number: int) -> Version:
        raw = json.loads(self.log.read(f"{number:010d}.json"))
        return Version(**raw | {"segments": [Segment(**s) for s in raw["segments"]]})

    def publish(self, version: Version) -> bool:
        """Make a version known; False if its number is taken."""
        return self.log.put(f"{version.number:010d}.json", json.dumps(asdict(version)))

    def write(self, name: str, rows: DataFrame, segment: str) -> DataFrame:
        """Write a table of a segment, and give it as read back."""
        columns = [c.name for c in self.spark.createDataFrame([], SCHEMAS[name]).schema]
        rows.select(columns).write.option("compression", "zstd").parquet(f"{self.root}/{name}/{segment}")
        return self._read(name, [segment])

    def remove(self, name: str, segment: str) -> None:
        """Remove a table of a segment that no version names."""
        Log(self.spark, f"{self.root}/{name}").delete(segment)

    def _read(self, name: str, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{name}/{s}" for s in segments])

    def rows(self, name: str, version: Version) -> DataFrame:
        """All rows of a table in the segments of a version, those of deleted chunks too."""
        return self._read(name, [s.name for s in version.segments if name in s.tables])

    def files(self, version: Version) -> DataFrame:
        return self._read("files", [version.files] if version.files else [])

    def deleted(self, version: Version) -> DataFrame | None:
        return self.rows("deleted", version) if any("deleted" in s.tables for s in version.segments) else None

    def chunks(self, version: Version | int, ids: list[int] | None = None) -> DataFrame:
        """The chunks that count at a version; with ``ids`` only these, of which no more is read than their row groups."""
        version = self.at(version) if isinstance(version, int) else version
        rows = self.rows("chunks", version)
        return blocks.live(rows if ids is None else rows.filter(F.col("row_id").isin(ids)), self.deleted(version))

    def corpus(self, version: Version, terms: list[str] | None = None) -> blocks.Corpus:
        """What scores need; with ``terms`` only theirs: each file is sorted by term, so pages of others are skipped."""
        own = lambda df: df if terms is None else df.filter(F.col("term").isin(terms))
        return blocks.Corpus(own(self.rows("postings", version)), own(self.rows("terms", version)), self.deleted(version), version.n_rows, version.n_tokens)

    def clean(self, keep: int = 1) -> int:
        """Remove versions but the last ``keep``, and segments that only they name; readers of those must be done. Gives the number of folders removed."""
        numbers = self.numbers()
        kept, old = [self.at(n) for n in numbers[-keep:]], [self.at(n) for n in numbers[:-keep]]
        names = lambda versions: {(t, s.name) for v in versions for s in v.segments for t in s.tables} | {("files", v.files) for v in versions if v.files}
        gone = names(old) - names(kept)
        for v in old:
            self.log.delete(f"{v.number:010d}.json")
        for table, segment in gone:
            self.remove(table, segment)
        return len(gone)
