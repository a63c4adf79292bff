"""Language identification: script ranges, per-word scores, and Viterbi spans with a switching penalty.

Training counts letter trigrams (with word borders) of a bounded sample of labelled rows per language, hashed to
``BUCKETS`` classes: the model has at most BUCKETS x languages numbers, whatever the input. A word is a run of letters.
Its script leaves as candidates the languages that were seen with that script; their scores are the log
probabilities of its trigrams. Viterbi labels the words of a whole text, paying ``PENALTY`` for each switch.

Results: null texts and texts without letters are ``und`` with score 0 and no spans. Words in a script that no language
was seen with score alike for all and follow their neighbours; a text of such words alone takes the first
language in alphabetical order with score 0. Ties go to the first language in that order. Without labelled rows all is ``und``.
Repeated rows count as often as they stand; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import chunks, text_batches, text_bytes

BUCKETS = 1 << 15
#: Rows per language that the model is fitted on, at most (in expectation; rows are taken by a hash of the id).
SAMPLE_ROWS = 3000
PENALTY = 20.0
#: A language is a candidate for a script that holds this share of its letters in the sample.
SCRIPT_SHARE = 0.005

#: First code points of script blocks (Unicode block borders; fixed values).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.int64)
_tables: dict[str, np.ndarray] = {}


def _table(kind: str) -> np.ndarray:
    """For each code point, whether it is a letter, or its lower case."""
    if kind not in _tables:
        points = range(0x110000)
        _tables["letter"] = np.fromiter((chr(c).isalpha() for c in points), bool, 0x110000)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(_tables["letter"]):
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        _tables["lower"] = lower
    return _tables[kind]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # [BUCKETS, languages] log probabilities
    allowed: np.ndarray  # [scripts, languages]


class LetterWords:
    """Runs of letters of some rows: trigram classes of their letters, scripts and places in code points."""

    def __init__(self, column: pa.Array):
        buf, offsets = text_bytes(column)
        points = np.frombuffer(bytes(buf).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        counts = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=counts[1:])
        self.offsets = counts[offsets]  # of rows, in code points
        n = len(points)
        letter = np.zeros(n + 2, bool)
        letter[1:-1] = _table("letter")[points]
        border = np.zeros(n + 1, bool)
        border[self.offsets] = True
        first = letter[1:-1] & (~letter[:-2] | border[:-1])
        last = letter[1:-1] & (~letter[2:] | border[1:])
        at = np.flatnonzero(letter[1:-1])
        low = np.zeros(n + 2, np.uint64)
        low[1:-1] = _table("lower")[points]
        before, after = np.where(first[at], np.uint64(1), low[at]), np.where(last[at], np.uint64(1), low[at + 2])
        gram = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (low[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
        self.grams = ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.flatnonzero(first[at])  # of each word among the letters
        self.script = _SCRIPT[np.searchsorted(_STARTS, points[self.start], side="right") - 1]
        self.bounds = np.searchsorted(self.start, self.offsets)  # words of each row


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows (doc_id, text, lang); those without a text or language are left out."""
    rows = rows.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(sample_rows / sizes[lang]))])
    dice = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    sample = rows.filter(dice < share[F.col("lang")])
    index = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        for batch in batches:
            for part in chunks(batch):
                words = LetterWords(part.column("text"))
                langs = np.array([index[x] for x in part.column("lang").to_pylist()])
                letters = np.append(words.first, len(words.grams))[words.bounds]
                lang = np.repeat(langs, np.diff(letters))
                script = np.repeat(words.script, np.diff(np.append(words.first, len(words.grams))))
                keys = np.concatenate([lang * BUCKETS + words.grams, (len(languages) * BUCKETS) + lang * len(SCRIPT_NAMES) + script])
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["key", "n"])

    text_batches(rows.sparkSession)
    sums = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * (BUCKETS + len(SCRIPT_NAMES)))
    counts[sums.column("key").to_numpy()] = sums.column("n").to_numpy()
    grams, scripts = counts[: len(languages) * BUCKETS].reshape(-1, BUCKETS).T, counts[len(languages) * BUCKETS :].reshape(len(languages), -1).T
    table = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    return Model(languages, table.astype(np.float32), scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(0)))


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row of scores [words, labels], where a change of label costs the penalty."""
    n, k = scores.shape
    best, back = scores[0].astype(float), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - penalty
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - penalty) + scores[i]
    labels = np.empty(n, np.int64)
    labels[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        labels[i - 1] = back[i, labels[i]]
    return labels


def labels_of(words: LetterWords, model: Model, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word, by the best path over its row."""
    scores = np.add.reduceat(model.table[words.grams], words.first, axis=0) if len(words.first) else np.zeros((0, len(model.languages)))
    allowed = model.allowed[words.script]
    scores = np.where(allowed, scores, -1000.0)
    scores[~allowed.any(1)] = 0
    labels = np.zeros(len(scores), np.int64)
    rows = np.flatnonzero(np.diff(words.bounds))
    if not len(rows):
        return labels
    counts = np.diff(words.bounds)[rows]
    total = np.add.reduceat(scores, words.bounds[rows], axis=0)
    best = total.argmax(1)
    labels[:] = np.repeat(best, counts)
    # A path that never leaves the best label is the best one if no run of words gains half a penalty by any other label.
    row = np.repeat(np.arange(len(rows)), counts)
    gain = np.clip(scores - scores[np.arange(len(scores)), labels][:, None], -2 * penalty, 2 * penalty)
    sums = np.cumsum(gain, axis=0)
    drop = 4.0 * penalty * (len(scores) + 1)
    high, before = sums - (row * drop)[:, None], (sums - gain) - (row * drop)[:, None]
    most = np.maximum.reduceat(high - np.minimum.accumulate(before, axis=0), words.bounds[rows], axis=0).max(1)
    for r in np.flatnonzero(most >= penalty / 2):
        a = words.bounds[rows[r]]
        labels[a : a + counts[r]] = viterbi(scores[a : a + counts[r]], penalty)
    return labels


SPANS = "array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, whole: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each row of docs (doc_id, text); with ``whole`` also the row, as a struct.

    spans: code points from the first letter of a run of words in one language to the end of its last.
    lang_pred: the language with most letters; score: its share of the letters, counting words in its scripts only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        k = len(model.languages)
        for batch in batches:
            for part in chunks(batch):
                words = LetterWords(part.column("text"))
                labels = labels_of(words, model, penalty) if k else np.zeros(len(words.start), np.int64)
                size, n = words.end - words.start, part.num_rows
                row = np.repeat(np.arange(n), np.diff(words.bounds))
                letters = np.bincount(row * (k + 1) + labels, size, n * (k + 1)).reshape(n, k + 1)
                fits = model.allowed[words.script, labels] if k else np.zeros(len(size), bool)
                sure = np.bincount(row * (k + 1) + labels, size * fits, n * (k + 1)).reshape(n, k + 1)
                every = letters.sum(1)
                top = np.where((every > 0) & (k > 0), letters[:, :k].argmax(1) if k else 0, k)
                score = sure[np.arange(n), top] / np.maximum(every, 1)
                new = np.ones(len(labels), bool)
                new[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(labels))[: len(head)] - 1
                base = words.offsets[row[head]]
                spans = pa.StructArray.from_arrays([pa.array((words.start[head] - base).astype(np.int32)), pa.array((words.end[tail] - base).astype(np.int32)), pa.array(names[labels[head]] if k else ["und"] * len(head), pa.string())], fields=list(span))
                offsets = np.append(0, np.cumsum(np.bincount(row[head], minlength=n))).astype(np.int32)
                kept = [part.column("row")] if whole else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[top], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans), *kept], ["doc_id", "lang_pred", "score", "spans", "row"][: 4 + whole])

    text_batches(docs.sparkSession)
    schema = T.StructType.fromDDL(f"doc_id long, lang_pred string, score double, spans {SPANS}")
    if whole:
        schema.add("row", docs.schema)
    return docs.select(F.col("doc_id").cast("long"), "text", *[F.struct("*").alias("row")] * whole).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that aren't learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_rest(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    return train(docs.filter(~held_out(F.col("doc_id"))), sample_rows)
