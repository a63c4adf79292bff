"""An index of source files: make, refresh, ingest, search, outline, status."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.functions.text import query_words, tokens
from quarry.operators import blocks, code, formats, maintain, search
from quarry.sources import files, records
from quarry.sources.tables import ConflictError, Segment, StoreError, Tables, Version

#: Indexed columns and their weights (fixed values).
WEIGHTS = {"symbol_name": 10.0, "symbol_type": 1.0, "chunk_text": 1.0, "parent_symbol": 5.0, "imports": 2.0, "cross_references": 2.0, "file_docstring": 2.0}
LISTS = ("imports", "cross_references")
#: The hash of files that were never on a disk (fixed value).
NO_HASH = "0" * 32
#: Segments that are merged at least, and how many times larger the next may be to be merged with them.
FAN = 4
#: Terms, or rows of results, that a filter of a scan takes.
MANY = 10_000


def count(state: dict[str, str | None], key: str) -> int:
    """A counter of the state; 0 if it is missing or no number."""
    text = (state.get(key) or "").strip()
    return int(text) if text.isascii() and text.isdigit() else 0


@dataclass
class Options:
    max_tokens: int = 4000
    max_results: int = 20
    file_filter: list[str] | None = None
    weights: list[float] | None = None


def indexed(chunks: DataFrame) -> DataFrame:
    """Chunks with lists joined by line ends, as they are indexed."""
    return chunks.withColumns({c: F.array_join(c, "\n") for c in LISTS})


def query_table(spark: SparkSession, texts: dict[int, str]) -> DataFrame:
    """(query_id, term, pos, offset, size) of the words of queries."""
    rows = [(q, term, pos, i, len(word)) for q, text in texts.items() for pos, word in enumerate(query_words(text)) for i, term in enumerate(word)]
    return spark.createDataFrame(rows, "query_id long, term string, pos int, offset int, size int")


class Retriever(Protocol):
    """What answers queries: (packed results, queries with what was found); the index is one."""

    def search(self, texts: dict[int, str], options: Options | None = None) -> tuple[DataFrame, DataFrame]: ...


class Index:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.tables, self.config = spark, Tables(spark, root), config or Config()

    @property
    def version(self) -> int:
        found = self.tables.version()
        if found is None:
            raise StoreError(f"no index at {self.tables.root}")
        return found

    def latest(self) -> Version:
        return self.tables.at(self.version)

    def create(self) -> None:
        """The first version, without rows, unless there is an index."""
        if self.tables.version() is None:
            state = {"version": self.config.version, "created_at": str(int(time.time())), "last_full_index": "", "total_files": "0", "total_chunks": "0"}
            self.tables.publish(Version(number=1, state=state))

    def state(self) -> dict[str, str | None]:
        return self.latest().state

    def files(self) -> DataFrame:
        """The table of files of the newest version."""
        return self.tables.files(self.latest())

    def _write_rows(self, rows: DataFrame, segment: str, first: int) -> tuple[DataFrame, DataFrame]:
        """Write chunks (with ``place``, their order in a file) and their postings; give both as read back."""
        order = ["file_path", *(["place"] if "place" in rows.columns else ["start_byte", "end_byte"])]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_id", F.monotonically_increasing_id() + first)
        lengths = [F.size(tokens(F.array_join(c, "\n") if c in LISTS else F.col(c))) for c in WEIGHTS]
        written = self.tables.write("chunks", rows.withColumn("doc_len", sum(lengths).cast("long")), segment)
        return written, self.tables.write("postings", blocks.postings(indexed(written), list(WEIGHTS)), segment)

    def _commit(self, base: Version, rows: DataFrame, gone: DataFrame | None, files: Callable[[DataFrame, int], DataFrame], totals: Callable[[DataFrame], dict[str, str]]) -> dict[str, int]:
        """One new version of ``base``: chunks come, those of the files ``gone`` (file_path) go; {n_files, n_chunks} that came.

        Only the rows that come and go are read: totals and document frequencies change by theirs. ``files`` makes the new table of files from
        the chunks that came and the new number; ``totals`` counts it. A compaction published meanwhile is taken in; other rows published meanwhile are a conflict.
        """
        segment = uuid.uuid4().hex
        written, postings = self._write_rows(rows, segment, base.next_row)
        came = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens"), F.max("row_id").alias("top"), F.countDistinct("file_path").alias("files")).first()
        changes, went, has = blocks.frequencies(postings), None, ["chunks", "postings", "terms"] * (came.n > 0)
        if gone is not None:
            # paths find the row ids, and their bitmaps the rows: no text is shuffled
            ids = self.tables.chunks(base).select("row_id", "file_path").join(gone, "file_path", "left_semi")
            marks = self.tables.write("deleted", blocks.bitmaps(ids), segment)
            old = blocks.among(self.tables.rows("chunks", base), marks)
            went = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens")).first()
            if went.n:
                changes = changes.unionByName(blocks.word_rows(indexed(old), list(WEIGHTS), -1))
                has = [*dict.fromkeys([*has, "terms", "deleted"])]
            else:
                self.tables.remove("deleted", segment)
        if has:
            sums = changes.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
            self.tables.write("terms", sums.repartitionByRange("term").sortWithinPartitions("term"), segment)
        state = totals(self.tables.write("files", files(written, base.number + 1), segment))
        lost = went.n if went else 0
        version = replace(base, changes=base.changes + 1, files=segment, n_rows=base.n_rows + came.n - lost, n_tokens=base.n_tokens + came.tokens - (went.tokens if went else 0), state=base.state | state)
        version.next_row = base.next_row if came.top is None else came.top + 1
        own = [Segment(segment, base.next_row, version.next_row - 1, came.n, has)] if has else []
        while True:
            last = self.latest()
            if last.changes != base.changes:
                raise ConflictError("another writer has changed the index: run this again")
            if self.tables.publish(replace(version, number=last.number + 1, segments=last.segments + own)):
                self.compact()
                return {"n_files": came.files, "n_chunks": came.n}

    def compact(self, whole: bool = False) -> bool:
        """Merge the newest segments into one, as many as are about alike in size, if these are ``FAN`` at least; with ``whole`` all segments.

        A segment is merged again only when the newer ones have grown to a ``FAN``-th of it, so each row is rewritten a logarithmic number of times. Deleted rows go; bitmaps stay
        only for rows of older segments. Postings are made anew of the rows, where these are read. False if there is nothing to merge, or if another compaction was faster.
        """
        base = self.latest()
        parts, size = [], 0
        for s in reversed(base.segments):
            if not whole and parts and s.n_rows > FAN * max(size, 1):
                break
            parts, size = [s, *parts], size + s.n_rows
        if not parts or len(parts) < (1 if whole else FAN) or (len(parts) == 1 and "deleted" not in parts[0].tables):
            return False
        some, segment = replace(base, segments=parts), uuid.uuid4().hex
        deleted, first = self.tables.deleted(some), parts[0].first
        rows = self.tables.write("chunks", self.tables.chunks(some).sortWithinPartitions("row_id"), segment)
        n = rows.count()
        self.tables.write("postings", blocks.postings(indexed(rows), list(WEIGHTS)), segment)
        sums = self.tables.rows("terms", some).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        self.tables.write("terms", sums.repartitionByRange("term").sortWithinPartitions("term"), segment)
        has = ["chunks", "postings", "terms"]
        if deleted is not None and first > base.segments[0].first:
            older = deleted.filter((F.col("bucket") - 1) * 32768 < first).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            self.tables.write("deleted", older, segment)
            has.append("deleted")
        merged = Segment(segment, first, parts[-1].last, n, has)
        while True:
            last = self.latest()
            at = next((i for i in range(len(last.segments)) if last.segments[i : i + len(parts)] == parts), None)
            if at is None:
                return False
            if self.tables.publish(replace(last, number=last.number + 1, segments=[*last.segments[:at], merged, *last.segments[at + len(parts) :]])):
                return True

    def refresh(self, found: DataFrame, force: bool = False, complete: bool = True, drop: list[str] | None = None) -> dict[str, int]:
        """Take in a scan ``found`` as one new version; {n_files, n_chunks, n_failed} of this run.

        Only changed files are cut anew, all with ``force``. A file with an error keeps its rows and isn't counted as done. Stored
        files that weren't found go if the scan is ``complete``, those in ``drop`` always.
        """
        base = self.latest()
        stored = self.tables.files(base)
        facts = found.select("file_path", "hash", "mtime", "file_size", "language", "error").dropDuplicates(["file_path"]).persist()
        news = facts if force else maintain.changed(facts, stored.select("file_path", "hash"))
        good = news.filter("error is null")
        # the facts are settled before the texts are read: a file that changes meanwhile differs at the next run
        facts.count()
        texts = found.select("file_path", "language", "text").filter("text is not null").dropDuplicates(["file_path"]).join(good.select("file_path"), "file_path", "left_semi")
        kept = maintain.gone_less(stored, facts, complete, drop)
        gone = stored.join(kept, "file_path", "left_anti").select("file_path").unionByName(good.select("file_path")).distinct()

        def files(written: DataFrame, number: int) -> DataFrame:
            counts = written.groupBy("file_path").agg(F.count("*").alias("chunk_count"))
            meta = good.join(counts, "file_path", "left").withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)).cast("long"), "indexed_at": F.unix_timestamp(), "since": F.lit(number)})
            return maintain.merge(kept, meta.select(kept.columns))

        done: dict[str, int] = {}

        def totals(rows: DataFrame) -> dict[str, str]:
            own = F.col("since") == base.number + 1
            t = rows.agg(F.count("*").alias("f"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("c"), F.count(F.when(own, 1)).alias("n")).first()
            done["n_files"] = t.n
            return {"total_files": str(t.f), "total_chunks": str(t.c)}

        n_chunks = self._commit(base, code.symbols(texts), gone, files, totals)["n_chunks"]
        n_failed = news.filter("error is not null").count()
        facts.unpersist()
        return {"n_files": done["n_files"], "n_chunks": n_chunks, "n_failed": n_failed}

    def put(self, rows: DataFrame, drop: DataFrame | None = None) -> dict[str, int]:
        """Chunks (with or without ``place``) take the place of all chunks of their files, and the files ``drop`` (file_path) go; {n_files, n_chunks} that came."""
        paths = rows.select("file_path").distinct()
        return self._append(rows, paths if drop is None else paths.unionByName(drop.select("file_path")).distinct())

    def _append(self, rows: DataFrame, gone: DataFrame | None) -> dict[str, int]:
        base = self.latest()
        stored = self.tables.files(base)

        def files(written: DataFrame, number: int) -> DataFrame:
            counts = written.groupBy("file_path").agg(F.min_by("language", "row_id").alias("language"), F.count("*").alias("chunk_count"))
            zero = F.lit(0).cast("long")
            meta = counts.select("file_path", F.lit(NO_HASH).alias("hash"), zero.alias("mtime"), zero.alias("file_size"), "language", "chunk_count", F.unix_timestamp().alias("indexed_at"), F.lit(number).alias("since"))
            return maintain.merge(stored if gone is None else stored.join(gone, "file_path", "left_anti"), meta)

        def totals(rows: DataFrame) -> dict[str, str]:
            t = (rows.filter(F.col("since") == base.number + 1) if gone is None else rows).agg(F.count("*").alias("f"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("c")).first()
            return {"total_files": str(t.f), "total_chunks": str(t.c)}

        return self._commit(base, rows, gone, files, totals)

    def index(self, root: str, force: bool = False) -> dict[str, int]:
        """Refresh from all files below ``root`` or the configured folders in it."""
        return self.refresh(self._scan(root, [f"{root.rstrip('/')}/{p}" for p in self.config.index_paths] or [root]), force)

    def _scan(self, root: str, places: list[str]) -> DataFrame:
        return files.scan(self.spark, root, places, ignore=self.config.ignore_patterns, defaults=self.config.use_default_ignores, languages=self.config.languages)

    def update(self, root: str, paths: list[str], force: bool = False, evict: bool = False) -> dict[str, int]:
        """Refresh some files, relative to ``root``; with ``evict`` those that can't be found, or that ignore rules leave out, go."""
        if files.mounted(self.spark, root):
            return self._take(self._scan(root, [f"{root.rstrip('/')}/{p}" for p in paths]) if paths else None, paths, force, evict)
        escaped = [f"{root.rstrip('/')}/" + "".join("\\" + c if c in "\\{}[]*?,^" else c for c in p) for p in paths]
        found = None
        for place in escaped:
            try:
                one = self._scan(root, [place])
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            found = one if found is None else found.unionByName(one)
        return self._take(found, paths, force, evict)

    def _take(self, found: DataFrame | None, paths: list[str], force: bool, evict: bool) -> dict[str, int]:
        if found is None:
            found = self.spark.createDataFrame([], "file_path string, language string, text string, hash string, mtime long, file_size long, error string")
        there = {r.file_path for r in found.select("file_path").collect()}
        return self.refresh(found, force, False, [p for p in paths if p not in there] if evict else None)

    def ingest(self, path: str) -> dict[str, int]:
        """Append the chunks of a JSON file; totals become those of this file. Chunks of files that are known stay."""
        with records.failing(path):  # a broken chunk ends the run before its version is published
            return self._append(records.read_chunks(self.spark, path), None)

    def rank(self, words: DataFrame, k: int, weights: list[float] | None = None, terms: list[str] | None = None, phrases: bool = True) -> tuple[DataFrame, DataFrame]:
        """(scores, work) of the k best rows for words (query_id, term, pos, offset, size), as in ``blocks.top``; ``terms``: theirs, if they are known and few."""
        weights = search.check_weights(weights or list(WEIGHTS.values()), len(WEIGHTS))
        return blocks.top(self.tables.corpus(self.latest(), terms), words, weights, k, phrases)

    def search(self, texts: dict[int, str], options: Options | None = None) -> tuple[DataFrame, DataFrame]:
        """(packed results, queries (query_id, query, found)) of one query or many.

        No chunk is read before the best rows are known. Of a few queries these come to the driver, at most ``max_results`` each, so that the
        scan of the chunks skips all other row groups.
        """
        options, version = options or Options(), self.latest()
        weights = search.check_weights(options.weights or list(WEIGHTS.values()), len(WEIGHTS))
        words = {q: query_words(text) for q, text in texts.items()}
        terms = sorted({t for ws in words.values() for w in ws for t in w})
        corpus = self.tables.corpus(version, terms if len(terms) <= MANY else None)
        found, _ = blocks.top(corpus, query_table(self.spark, texts), weights, options.max_results, any(len(w) > 1 for ws in words.values() for w in ws))
        ids = None
        if options.max_results * len(texts) <= MANY:
            best = found.collect()
            ids = sorted({r.row_id for r in best})
            found = self.spark.createDataFrame(best, found.schema)
        packed, counts = search.retrieve(found, self.tables.chunks(version, ids), options.max_results, options.max_tokens, options.file_filter, "chunk_text")
        asked = self.spark.createDataFrame(list(texts.items()), "query_id long, query string")
        return packed.withColumn("text", F.col("chunk_text")), asked.join(counts, "query_id", "left").fillna(0, ["found"])

    def search_fresh(self, root: str, text: str, options: Options | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        """Search, refresh the files of the results that changed, drop those that are gone, and search again."""
        first, _ = self.search({0: text}, options)
        paths = [r.file_path for r in first.select("file_path").distinct().join(self.files(), "file_path", "left_semi").collect()]  # at most max_results
        healed = {"files_checked": len(paths), "files_reindexed": 0, "files_dropped": 0}
        if paths:
            before = self.files().count()
            done = self.update(root, paths, evict=True)
            healed["files_reindexed"] = done["n_files"] + done["n_failed"]
            healed["files_dropped"] = before - self.files().count()
        return *self.search({0: text}, options), healed

    def search_healed(self, root: str, texts: dict[int, str], options: Options | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        """``search`` of many queries that leaves no stale result: the files of all results are looked at in one scan and refreshed as one version.

        Only queries with a result in a file that changed or is gone are searched again; the others keep what they have. A refresh may bring new rows for a query
        that had none of them, as in ``search_fresh``, whose healing goes by results too. The results stay as they are on the first version if nothing changed.
        """
        first, asked = self.search(texts, options)
        seen = first.select("query_id", "file_path").distinct().join(self.files(), "file_path", "left_semi").persist()
        paths = [r.file_path for r in seen.select("file_path").distinct().collect()]  # at most max_results for each query
        healed = {"files_checked": len(paths), "files_reindexed": 0, "files_dropped": 0}
        before = self.latest()
        old = self.tables.files(before)
        done = self.update(root, paths, evict=True) if paths else {"n_files": 0, "n_failed": 0}
        stale = old.join(self.files(), ["file_path", "hash"], "left_anti").select("file_path")
        again = {r.query_id for r in seen.join(stale, "file_path", "left_semi").select("query_id").distinct().collect()}
        gone = old.join(self.files(), "file_path", "left_anti").count()
        seen.unpersist()
        healed |= {"files_reindexed": done["n_files"] + done["n_failed"], "files_dropped": gone}
        if not again:
            return first, asked, healed
        fresh, counts = self.search({q: texts[q] for q in again}, options)
        rest = ~F.col("query_id").isin([*again])
        return first.filter(rest).unionByName(fresh), asked.filter(rest).unionByName(counts), healed

    def outline(self, path: str, max_tokens: int = 2000) -> DataFrame:
        return formats.outline(self.tables.chunks(self.version), path, max_tokens)

    def status(self) -> tuple[dict[str, str | None], DataFrame]:
        """The state, and (language, n_files)."""
        return self.state(), self.files().groupBy("language").agg(F.count("*").alias("n_files")).orderBy("language")


Formatter = Callable[[DataFrame, DataFrame], DataFrame]
FORMATS: dict[str, Formatter] = {"text": formats.as_text, "json": formats.as_json, "locator": formats.as_locators}
