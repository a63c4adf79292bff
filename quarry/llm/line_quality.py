"""Document quality from a linear-chain conditional random field that labels every line good or bad.

A line is described by ``STATS`` numbers (shares of kinds of characters, sizes, repeats), each cut into ``BINS`` levels. Weights of a line's own levels and
of those of the lines before and after it give its evidence for good; the field adds weights for pairs of labels side by side and for the first label. Forward and
backward messages give each line's probability of being good; a document's score is their mean, weighted by the lines' bytes.

Labels are known for documents only. The field is fitted twice on a bounded sample of labelled rows: first with each line labelled as its document, then
with the label turned where a line's own evidence speaks against it by ``TURN``, so that the weights of pairs see documents of both kinds of lines. A last pair of
numbers, fitted on the sample's documents, turns the logit of the mean into the logit of the score.

Lines end at LF. Null and empty texts are one empty line and get that line's score; so do texts of empty lines. Without labelled rows of both kinds all score 0.5.
Repeated rows come out as often as they stand; a document with several labels is bad if one of them is; an empty table stays empty; extra columns are ignored.
A task holds 2 MB of text, or one row, with about 200 bytes for each of its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Words, chunks, text_batches, text_bytes

#: Labelled documents of each kind that the field is fitted on, at most (in expectation; taken by a hash of the id), and lines of each of them.
SAMPLE_ROWS, SAMPLE_LINES = 3000, 300
#: Log odds by which a line's own evidence turns the label that it has from its document.
TURN = 4.0
STEPS, RATE, DECAY = 150, 0.15, 1e-4
THRESHOLD = 0.3

#: Kinds of bytes: lower case, upper case, digits, spaces, marks of a sentence, other marks, first bytes of other characters, their further bytes (fixed values).
LOWER, UPPER, DIGIT, SPACE, MARK, SYMBOL, OTHER, REST = range(8)
_KIND = np.full(256, SYMBOL, np.int64)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = MARK
_KIND[0x80:0xC0], _KIND[0xC0:] = REST, OTHER

BINS = 10
STATS = ("bytes", "words", "letters of a word", "upper case", "digits", "marks", "symbols", "other", "spaces", "first", "last", "marked words", "repeats of words", "copies of the line")
#: Levels of a share; 0 and 1 have their own.
SHARES = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1 - 1e-9])
SIZES = np.array([1, 4, 16, 48, 128, 384, 1024, 4096, 16384])
LETTERS = np.array([1, 2, 3, 4, 5, 6, 8, 12, 20])


def levels(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(levels [lines, STATS], bytes of each line with its end, bounds: row i has the lines bounds[i]:bounds[i + 1])."""
    buf, offsets = text_bytes(column)
    n, rows = len(buf), len(offsets) - 1
    ends = np.flatnonzero(buf == 0x0A)
    # a line begins at each row and after each LF; a row's last line may be empty, and then starts where the next row does
    row_of = np.searchsorted(offsets, ends, side="right") - 1
    begin = np.concatenate([offsets[:-1], ends + 1])
    row = np.concatenate([np.arange(rows), row_of])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    stop = np.append(begin[1:] - 1, n)
    last = bounds[1:] - 1
    stop[last] = offsets[1:]
    size = stop - begin
    kinds = _KIND[buf]
    counts = np.stack([np.append(0, np.cumsum(kinds == k))[[begin, stop]] for k in range(8)])
    counts = counts[:, 1] - counts[:, 0]
    chars = np.maximum(size - counts[REST], 1)
    letters = counts[LOWER] + counts[UPPER] + counts[OTHER]
    words = Words(column)
    first = np.searchsorted(words.start, begin)
    # words end at a line's end, for LF is a space; the next line's first word is where this one's end
    n_words = np.searchsorted(words.start, stop) - first
    marked = np.append(0, np.cumsum(kinds[words.end - 1] == SYMBOL))
    again = np.zeros(len(words.start) + 1, np.int64)
    again[2:] = np.cumsum(words.hashes[1:] == words.hashes[:-1]) if len(words.start) else again[2:]
    sums = np.append(np.uint64(0), np.cumsum(words.hashes * (2 * (np.arange(len(words.start), dtype=np.uint64) - np.repeat(first, n_words).astype(np.uint64)) + np.uint64(1))))
    line = sums[first + n_words] - sums[first]
    per = lambda x: x / np.maximum(n_words, 1)
    edge = lambda at: np.where(size > 0, kinds[np.clip(at, 0, max(n - 1, 0))] if n else 0, BINS - 1)
    out = np.empty((len(begin), len(STATS)), np.uint8)
    out[:, 0], out[:, 1] = np.digitize(size, SIZES), np.digitize(n_words, SIZES)
    out[:, 2] = np.digitize(per(letters), LETTERS)
    for i, x in enumerate((counts[UPPER] / np.maximum(letters, 1), counts[DIGIT] / chars, counts[MARK] / chars, counts[SYMBOL] / chars, counts[OTHER] / chars, counts[SPACE] / chars), 3):
        out[:, i] = np.digitize(x, SHARES)
    out[:, 9], out[:, 10] = edge(begin), edge(stop - 1)
    tail = first + n_words
    out[:, 11] = np.digitize(per(marked[tail] - marked[first]), SHARES)
    out[:, 12] = np.digitize(per(np.maximum(again[tail] - again[np.minimum(first + 1, len(again) - 1)], 0)), SHARES)
    _, same, copies = np.unique(np.stack([row.astype(np.uint64), line]).T.copy().view("V16"), return_inverse=True, return_counts=True)
    out[:, 13] = np.where(n_words > 0, np.digitize(copies[same.ravel()], [2, 3, 5, 9, 17, 33, 65]), BINS - 1)
    return out, size + 1, bounds


@dataclass
class Field:
    own: np.ndarray  # [3, STATS, BINS + 1]: weights of levels of the line before, the line, the line after; the last for a missing one
    pairs: np.ndarray  # [2, 2] weights of labels side by side, bad first
    first: float  # weight of a good first line
    scale: float = 1.0
    shift: float = 0.0

    def evidence(self, stats: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each line's log odds of good by what is seen at it and beside it."""
        return sum(self.own[j, s][side[:, s]] for j, side in enumerate(beside(stats, bounds)) for s in range(len(STATS))) + np.zeros(len(stats))

    def score(self, stats: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of rows, probabilities of lines)."""
        good = marginals(self.evidence(stats, bounds), self.pairs, self.first, bounds)[0]
        mean = np.add.reduceat(good * size, bounds[:-1]) / np.add.reduceat(size, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
        return sigmoid(self.scale * logit(mean) + self.shift), good


def sigmoid(x):
    return 0.5 * (1 + np.tanh(np.asarray(x) / 2))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def beside(stats: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Levels of the lines before, of the lines, and of the lines after."""
    none = np.full((1, stats.shape[1]), BINS, stats.dtype)
    before, after = np.concatenate([none, stats[:-1]])[: len(stats)], np.concatenate([stats[1:], none])[: len(stats)]
    before[bounds[:-1]], after[bounds[1:] - 1] = BINS, BINS
    return [before, stats, after]


def marginals(evidence: np.ndarray, pairs: np.ndarray, first: float, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, expected counts [2, 2] of pairs of labels, log normalisers of rows), by forward and backward messages.

    All rows take a step at once; those with fewer lines fall out.
    """
    counts = np.diff(bounds)
    order = np.argsort(-counts, kind="stable")
    at, depth = bounds[:-1][order], int(counts.max(initial=0))
    live = np.searchsorted(-counts[order], -np.arange(depth), side="left")  # rows with more than t lines
    forward, backward = np.zeros((2, len(evidence))), np.zeros((2, len(evidence)))
    for t in range(depth):
        i = at[: live[t]] + t
        base = np.array([[0.0], [first]]) if t == 0 else np.logaddexp(forward[0, i - 1] + pairs[0][:, None], forward[1, i - 1] + pairs[1][:, None])
        forward[:, i] = base
        forward[1, i] += evidence[i]
    for t in range(depth - 2, -1, -1):
        i = at[: live[t + 1]] + t
        bad, good = backward[0, i + 1], backward[1, i + 1] + evidence[i + 1]
        backward[:, i] = np.logaddexp(pairs[:, :1] + bad, pairs[:, 1:] + good)
    norm = np.logaddexp(forward[0, bounds[1:] - 1], forward[1, bounds[1:] - 1])
    each = np.repeat(norm, counts)
    inner = np.ones(len(evidence), bool)
    inner[bounds[:-1]] = False
    j = np.flatnonzero(inner)
    expected = np.array([[np.exp(forward[a, j - 1] + pairs[a, b] + b * evidence[j] + backward[b, j] - each[j]).sum() for b in (0, 1)] for a in (0, 1)])
    return np.exp(forward[1] + backward[1] - each), expected, norm


def fit(stats: np.ndarray, size: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Field:
    """A field from rows of lines and the rows' labels."""
    shape = (3, len(STATS), BINS + 1)
    rows = np.repeat(np.arange(len(labels)), np.diff(bounds))
    sides = beside(stats, bounds)
    flat = np.stack([side[:, s].astype(np.int64) + (j * len(STATS) + s) * (BINS + 1) for j, side in enumerate(sides) for s in range(len(STATS))])
    inner = np.ones(len(rows), bool)
    inner[bounds[:-1]] = False
    j, heads = np.flatnonzero(inner), bounds[:-1]
    given, field = labels[rows].astype(float), Field(np.zeros(shape), np.zeros((2, 2)), 0.0)
    for turn in (False, True):
        if turn:
            seen = field.evidence(stats, bounds)
            given = np.where(seen > TURN, 1.0, np.where(seen < -TURN, 0.0, given))
        target = np.array([[((given[j - 1] == a) & (given[j] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        theta, sums, n = np.zeros(np.prod(shape) + 5), np.zeros(np.prod(shape) + 5), len(rows)
        for step in range(STEPS):
            own, pairs, first = theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]
            good, expected, _ = marginals(own[flat].sum(0), pairs, first, bounds)
            miss = given - good
            slope = np.bincount(flat.ravel(), np.broadcast_to(miss, flat.shape).ravel(), len(own))
            slope = np.concatenate([slope, (target - expected).ravel(), [miss[heads].sum()]]) / n - DECAY * theta
            sums += slope**2
            theta = theta + RATE * slope / np.sqrt(sums + 1e-12)
        field = Field(theta[:-5].reshape(shape), theta[-5:-1].reshape(2, 2), float(theta[-1]))
    mean = logit(field.score(stats, size, bounds)[0])
    a, b = 1.0, 0.0
    for _ in range(25):  # Newton steps, with a little weight on a = 1, b = 0
        p = sigmoid(a * mean + b)
        w, g = np.maximum(p * (1 - p), 1e-9), labels - p
        h = np.array([[(w * mean * mean).sum() + 1, (w * mean).sum()], [(w * mean).sum(), w.sum() + 1]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, [(g * mean).sum() - (a - 1), g.sum() - b]), -1, 1)
    field.scale, field.shift = max(float(a), 1e-3), float(b)
    return field


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES) -> Field | None:
    """Fit on docs (doc_id, text) that have labels (doc_id, quality 0 or 1); None without both kinds.

    The sample's ids are at most a few times ``sample_rows``, so they go to all tasks, and only the sample's texts are read into lines.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if set(sizes) < {0, 1}:
        return None
    share = F.when(F.col("quality") == 1, sample_rows / sizes[1]).otherwise(sample_rows / sizes[0])
    dice = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)), F.lit(1_000_000)) / 1_000_000
    sample = known.filter(F.col("quality").isin(0, 1) & (dice < share)).limit(4 * sample_rows)

    def describe(batches):
        for batch in batches:
            for part in chunks(batch):
                stats, size, bounds = levels(part.column("text"))
                for i, label in enumerate(part.column("quality").to_pylist()):
                    a, b = bounds[i], min(bounds[i + 1], bounds[i] + sample_lines)
                    yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([stats[a:b].tobytes()]), pa.array([size[a:b].astype(np.int64).tobytes()])], ["quality", "stats", "size"])

    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "quality")
    got = rows.mapInArrow(describe, "quality int, stats binary, size binary").toArrow()
    y = got.column("quality").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    order = sorted(range(len(y)), key=lambda i: (y[i], got.column("stats")[i].as_py(), got.column("size")[i].as_py()))  # whatever the order of tasks
    stats = np.concatenate([np.frombuffer(got.column("stats")[i].as_py(), np.uint8).reshape(-1, len(STATS)) for i in order])
    sizes_of = [np.frombuffer(got.column("size")[i].as_py(), np.int64) for i in order]
    return fit(stats, np.concatenate(sizes_of), np.append(0, np.cumsum([len(s) for s in sizes_of])), y[order])


def judge(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, score, predicted, n_lines, n_bad) of each row of docs (doc_id, text); n_bad: lines that are bad rather than good."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        for batch in batches:
            for part in chunks(batch):
                stats, size, bounds = levels(part.column("text"))
                score, good = field.score(stats, size, bounds) if field else (np.full(part.num_rows, 0.5), np.full(len(stats), 0.5))
                bad = np.add.reduceat(good < 0.5, bounds[:-1], dtype=np.int64) if part.num_rows else np.zeros(0, np.int64)
                arrays = [part.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(bad)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted", "n_lines", "n_bad"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_lines long, n_bad long")


def held_out(doc_id: Column) -> Column:
    """Rows that aren't learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on_rest(docs: DataFrame, labels: DataFrame) -> Field | None:
    return train(docs, labels.filter(~held_out(F.col("doc_id"))))
