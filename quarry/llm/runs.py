"""Periodic runs of words: an online sparse DP over the diagonals of a text compared with itself.

A run is a stretch of words with smallest period q and a length of ``LEAST`` words and ``TIMES`` periods at least that no neighbouring word extends.
On the diagonal of lag d lie the pairs of equal words d apart; a run is a diagonal of ``TIMES - 1`` periods and more.

The DP goes from left to right, in blocks of words whose size fits the lag: the largest power of two up to the lag, 8 at least. Each block's
earlier occurrences, at any place but no farther than twice the block, add its words to the match lengths of the active lags. A lag that a block doesn't carry
on has ended: if its length can suffice, the words on both sides of its blocks are compared, and the run is emitted. Nothing is lost by blocks:
a diagonal that suffices has at least twice as many words as its block, so it holds an aligned one. Blocks keep the table sparse: a block has at
most as many lags as words, so a text of n words has n log n entries at most, however often its words are repeated; and a text without equal blocks has none.

Blocks of one size are equal if both their halves are, so comparisons are exact. Multiples of a period end in the same stretch; the smallest stays. A
chunk of rows (2 MB of text, or one row) is handled at once; a row's memory is its words times the logarithm of its longest repeated stretch.

Null texts, empty ones and those without words have no runs and collapse to the empty string. Repeated rows come out as often as they stand; an
empty table stays empty; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import _SPACE, chunks, mix, shingles, text_batches, text_bytes

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
#: Words of the smallest block. The shortest diagonal has two thirds of ``LEAST`` words, twice as many.
BLOCK = 8
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
SPACES = r"[\x20\x09-\x0D]+"


class Cut:
    """Words of some rows: start and size in ``buf``, exact numbers (equal words, equal numbers), and ``bounds`` of rows."""

    def __init__(self, column: pa.Array):
        self.buf, offsets = text_bytes(column)
        n = len(self.buf)
        space = _SPACE[self.buf]
        first = ~space
        first[1:] &= space[:-1]
        inner = offsets[:-1][offsets[:-1] < n]
        first[inner] = ~space[inner]  # a row ends a word
        self.start = np.flatnonzero(first)
        letters = np.append(0, np.cumsum(~space))
        edges = np.append(letters[self.start], letters[-1]).astype(np.int32)
        self.size = np.diff(edges).astype(np.int64)
        words = pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(edges), pa.py_buffer(self.buf[~space])])
        self.ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        self.bounds = np.searchsorted(self.start, offsets)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each row, joined by one space."""
        at = np.flatnonzero(kept)
        ends = np.cumsum(self.size[at] + 1)
        begins = ends - self.size[at] - 1
        out = np.append(self.buf, np.uint8(32))[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - begins, self.size[at] + 1)]
        out[ends - 1] = 32
        edge = np.append(0, ends)[np.searchsorted(at, self.bounds)]
        return pa.array([bytes(out[a : max(a, b - 1)]).decode() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.string())


def _named(a: np.ndarray, b: np.ndarray, n: int, alone: bool = True) -> np.ndarray:
    """Numbers of the pairs (a, b), equal for equal pairs; -1 where either is -1, and for pairs that stand once if not ``alone``. n: of the result."""
    out = np.full(n, -1, np.int64)
    at = np.flatnonzero((a >= 0) & (b >= 0))
    _, names, counts = np.unique(a[at] * (b.max(initial=0) + 1) + b[at], return_inverse=True, return_counts=True)
    out[at] = names if alone else np.where(counts[names] > 1, names, -1)
    return out


def _entries(names: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, lag) of each aligned block and its earlier occurrences ``low`` to ``high - 1`` words before, by block."""
    n = len(names) + 1
    at = np.flatnonzero(names >= 0)
    keys = np.sort(names[at] * n + at)
    block = at[at % size == 0]
    own = names[block] * n
    first = np.searchsorted(keys, own + np.maximum(block - high + 1, 0))
    count = np.maximum(np.searchsorted(keys, own + block - low, side="right") - first, 0)
    place = keys[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())] % n
    block = np.repeat(block, count)
    return block, block - place


def _ended(blocks: np.ndarray, lags: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(lag, first word, end) of the diagonals of blocks: the DP from left to right. Those that can't suffice, whatever stands beside them, are left out."""
    emitted: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # words matched so far by lag
    heads = np.flatnonzero(np.diff(blocks, prepend=-1))
    tails, every, end = np.append(heads[1:], len(blocks))[: len(heads)].tolist(), lags.tolist(), -1
    for block, a, b in [*zip(blocks[heads].tolist(), heads.tolist(), tails, strict=True), (-1, 0, 0)]:
        now = {d: (active.pop(d, 0) if block == end else 0) + size for d in every[a:b]}
        for d, length in active.items():
            if length + 2 * size - 2 >= max(LEAST - d, (TIMES - 1) * d):
                emitted.append((d, end - length, end))
        active, end = now, block + size
    return emitted


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[start, length, period] of all runs in rows of words, by start and period; words are counted over all rows."""
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    # rows in which no block of words stands twice have no runs; equal blocks have equal hashes, so none is missed
    hashes = shingles(mix(ids.astype(np.uint64) + (row.astype(np.uint64) << np.uint64(40))), BLOCK)
    order = np.argsort(hashes)
    twice = order[1:][hashes[order[1:]] == hashes[order[:-1]]]
    held = np.zeros(len(counts), bool)
    held[row[twice]] = True
    words = np.flatnonzero(held[row])
    n = len(words)
    # numbers are of a row's own words, so that blocks of different rows differ, and so do those across a border
    names = {1: _named(row[words], ids[words], n)}
    for size in (2, 4, BLOCK):
        half = names[size // 2]
        names[size] = _named(half[: max(n - size // 2, 0)], half[size // 2 :], n, size < BLOCK)
    found, size = [np.zeros((0, 3), np.int64)], BLOCK
    while (names[size] >= 0).any():
        ended = _ended(*_entries(names[size], size, 1 if size == BLOCK else size, 2 * size), size)
        if ended:
            lag, left, right = np.array(ended, np.int64).T
            step = size // 2
            while step:
                own = np.append(names[step], -1)
                at = own[np.minimum(right, n)]
                right = right + step * ((at >= 0) & (at == own[np.minimum(right, n) - lag]))
                before = np.maximum(left - step - lag, 0)
                at = own[before + lag]
                left = left - step * ((left - step - lag >= 0) & (at >= 0) & (at == own[before]))
                step //= 2
            found.append(np.stack([left - lag, right - left + lag, lag], 1))
        size *= 2
        half = names[size // 2]
        names[size] = _named(half[: max(n - size // 2, 0)], half[size // 2 :], n, False)
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(LEAST, TIMES * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    smallest = np.ones(len(runs), bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[smallest]
    runs[:, 0] = words[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of each row of docs (doc_id, text).

    runs: start (a word's number, from 0), length and period, by start and period. collapsed: the words that no run holds after
    its first period, joined by one space.
    """

    def run(batches):
        item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for part in chunks(batch):
                cut = Cut(part.column("text"))
                runs = runs_of(cut.ids, cut.bounds)
                change = np.zeros(len(cut.ids) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                row = np.searchsorted(cut.bounds, runs[:, 0], side="right") - 1
                places = np.stack([runs[:, 0] - cut.bounds[row], runs[:, 1], runs[:, 2]])
                values = pa.StructArray.from_arrays([pa.array(x) for x in places], fields=list(item))
                offsets = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, cut.joined(np.cumsum(change)[:-1] == 0)], ["doc_id", "runs", "collapsed"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth row, by its hash, with a stretch of its words repeated up to its end; other texts as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACES, -1), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    a = F.col("g") % F.size("w")
    rows = rows.select("doc_id", "text", "g", "w", F.when(F.size("w") > 0, a).cast("int").alias("a"))
    p = (1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.select("doc_id", "text", "w", "a", p.alias("p"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def best(runs: Column) -> Column:
    """The run with most periods, compared exactly; of equal ones the first."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the best run and hashes of what ``find`` gives."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best(F.col("runs")).alias("top"), lines.alias("lines"), "collapsed")
    exact = F.expr("top.length * 1000 div top.period").alias("exponent_milli")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n_runs", "top.start", "top.length", "top.period", exact, sha("lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"))


_BITS = "xor(x, CASE WHEN k % 8 = 0 THEN ascii(id[k // 8 + 1]) ELSE 0 END)"
#: crc32 of the text ``id``, bit by bit.
CRC = f"xor(list_reduce(range(0, 8 * length(id)), lambda x, k: xor({_BITS} >> 1, CASE WHEN {_BITS} % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295)"
#: The same by all pairs of equal words, which suits small tables only.
ORACLE = rf"""WITH w0 AS (SELECT doc_id, crc AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS w FROM (SELECT *, {CRC} AS crc FROM (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS id FROM documents))),
s AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM w0),
p AS (SELECT doc_id, n, w, again, a, 1 + (n - a) // (3 + g % 8) AS p FROM s),
x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN again THEN [CASE WHEN j < a THEN w[j + 1] ELSE w[a + (j - a) % p + 1] END FOR j IN range(n)] ELSE w END) AS word FROM p),
pairs AS (SELECT l.doc_id, r.i, r.i - l.i AS d FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND {TIMES} * (r.i - l.i) <= r.n),
o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM pairs),
e AS (SELECT doc_id, d, min(i) - d AS start, count(*) + d AS length FROM o GROUP BY doc_id, d, island HAVING count(*) + d >= greatest({LEAST}, {TIMES} * d)),
r AS (SELECT doc_id, start, length, min(d) AS period FROM e GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS best FROM r),
rs AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM p LEFT JOIN rs ON p.doc_id = rs.doc_id LEFT JOIN b ON p.doc_id = b.doc_id AND best = 1 LEFT JOIN c ON p.doc_id = c.doc_id"""
