"""Substring deduplication by collinear chaining of shared k-mers.

Seeds are word k-mers: those whose hash is 0 modulo ``SHARE``, which are the same in every text that holds them, and the smallest of each
``WINDOW`` in a row, so any ``K + WINDOW - 1`` equal words hold one for certain. Seeds that two documents have are shared. All
places of a key are paired with those in its first document (smallest doc_id), one with one, so a passage in a third of all
documents gives one pair per document. There are two passes, whatever the tables hold. In the first one each shared seed is a
key. The second is for passages whose parts stand in other documents first. Its keys are runs of ``RUN`` shared seeds that follow each other
in a document (seeds on edited words are its own, so they don't break runs), and all runs of ``MIN_WORDS`` words whose sampled seeds
are all shared, where a seed lies outside what the first pass found: each run of so many equal words in two documents is
found, wherever its parts stand.

The anchors of a pair are chained: a chain's score is the words of its seeds less ``GAP`` for each word skipped in either document;
the best predecessor comes from a Fenwick tree over the second document's places. Chains are aligned on the words themselves: gaps
on one diagonal are compared word by word, others by their longest common subsequence; of gaps over ``LONGEST`` words only the ends are
aligned, and ends are extended over edits (``extend``), so no gap costs more than its length. A chain whose gaps break the identity is cut into its longest stretches that keep it. A stretch counts if it has ``MIN_WORDS`` words on
both sides, ``IDENTITY`` of them equal.

Null and short texts have no seeds. Passages that only one document has, if several times, don't count. Rows of one doc_id are one
document: of different texts the smallest counts. Rows without a doc_id and extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Words, chunks, discard, list_array, shingles, signed, stored, text_batches, tidy

K, SHARE, WINDOW = 6, 5, 24
#: Words on each side of a seed that are compared through bitmaps of 32 bits, and bits that must agree on one side for a lone seed to count.
BESIDE, AGREE = 12, 6
#: Parts of all hashes: a seed's rows lie in one, and a task holds one at a time. Bytes of a seed's row, and rows given out at once.
PARTS, ROW_BYTES, ROWS = 1024, 32, 200_000
#: Shared seeds of a run.
RUN = 4
GAP = 0.1
#: Passages of over 50 words are looked for.
MIN_WORDS, IDENTITY = 50, 0.8
#: Words on each side of a chain that alignment gets at first; it gets more where it comes near their end.
MARGIN = 96
#: Words of a gap, in the longer document, that are aligned as a whole.
LONGEST = 4096
#: Where an extension ends, how many words it skips, and what a skip must win.
DROP, SHIFT, JUMP = 16, 8, 4
#: Words of a first look ahead, and with those that can be skipped.
FIRST = 32
NEAR = FIRST + SHIFT


def sampled(runs: np.ndarray) -> np.ndarray:
    """Which k-mers are seeds wherever they stand."""
    return runs % np.uint64(SHARE) == 0


def minimisers(values: np.ndarray, inside: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which values are the smallest in some window; inside: windows that count, by their first value."""
    out = np.zeros(len(values), bool)
    n = len(values) - window + 1
    if n <= 0:
        return out
    low = values[:n].copy()
    for j in range(1, window):
        np.minimum(low, values[j : j + n], out=low)
    low[~inside[:n]] = 0
    high = np.zeros(len(values), np.uint64)
    for j in range(window):
        np.maximum(high[j : j + n], low, out=high[j : j + n])
    return (values == high) & (high > 0)


def seed_places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of K words, and the places of seeds among them."""
    runs = shingles(words.hashes, K)
    last = np.repeat(words.bounds[1:], np.diff(words.bounds))[: len(runs)]  # end of the row of each
    start = np.arange(len(runs))
    return runs, np.flatnonzero((start + K <= last) & (sampled(runs) | minimisers(runs, start + K + WINDOW - 1 <= last)))


def _seed_blocks(docs: DataFrame) -> DataFrame:
    """(part, block): the seeds of some documents by parts of all hashes, each part's columns one after the other in bytes.

    Columns: seed, document, the words beside it as two bitmaps, its place in words, and how often the document has it.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                runs, at = seed_places(words)
                if not len(at):
                    continue
                row, own = np.searchsorted(words.bounds, at, side="right") - 1, runs[at]
                order = np.lexsort((own, row))
                same = np.append(True, (own[order][1:] != own[order][:-1]) | (row[order][1:] != row[order][:-1]))
                times = np.empty(len(at), np.int32)
                times[order] = np.bincount(np.cumsum(same) - 1)[np.cumsum(same) - 1]
                bit = np.append(np.uint64(1) << (words.hashes & np.uint64(31)), np.uint64(0))
                left, right = np.zeros((2, len(at)), np.uint64)
                for j in range(BESIDE):
                    left |= np.where(at - j > words.bounds[row], bit[at - j - 1], np.uint64(0))
                    right |= np.where(at + K + j < words.bounds[row + 1], bit[np.minimum(at + K + j, len(bit) - 1)], np.uint64(0))
                place = (own >> np.uint64(32)) % np.uint64(PARTS)  # sampling takes the whole hash modulo SHARE, which divides no power of two
                order = np.argsort(place.astype(np.int16), kind="stable")
                ends = np.cumsum(np.bincount(place.astype(np.int64), minlength=PARTS))
                columns = [own, part.column("doc_id").to_numpy()[row], left << np.uint64(32) | right, (at - words.bounds[row]).astype(np.int32), times]
                columns = [c[order] for c in columns]
                found = [(p, b"".join(c[lo:hi].tobytes() for c in columns)) for p, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if lo < hi]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.binary()), strict=True)], ["part", "block"])

    text_batches(docs.sparkSession)
    return docs.mapInArrow(run, "part int, block binary")


def seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, seed, at, times, beside, first): each seed that several documents have, in each of them, by its place in words; see ``_seed_blocks``.

    Most seeds stand in one document. They are shuffled once, in blocks, and not stored.
    """

    def shared(blocks: list[bytes]):
        sizes = [len(b) // ROW_BYTES for b in blocks]
        column = lambda kind, at: np.concatenate([np.frombuffer(b, kind, n, at * n) for b, n in zip(blocks, sizes, strict=True)])
        seed, doc, beside, at, times = column(np.int64, 0), column(np.int64, 8), column(np.int64, 16), column(np.int32, 24), column(np.int32, 28)
        order = np.argsort(seed, kind="stable")
        start = np.flatnonzero(np.append(True, seed[order][1:] != seed[order][:-1]))
        first, last = np.minimum.reduceat(doc[order], start), np.maximum.reduceat(doc[order], start)
        counts = np.diff(start, append=len(order))
        rows, first = order[np.repeat(first < last, counts)], np.repeat(first, counts)[np.repeat(first < last, counts)]
        for lo in range(0, len(rows), ROWS):
            own = rows[lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[own], seed[own], at[own], times[own], beside[own], first[lo : lo + ROWS])], ["doc_id", "seed", "at", "times", "beside", "first"])

    def run(batches):
        part, held = None, []
        for batch in batches:
            for p, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if p != part:
                    if held:
                        yield from shared(held)
                    part, held = p, []
                held.append(block)
        if held:
            yield from shared(held)

    blocks = _seed_blocks(docs).repartition("part").sortWithinPartitions("part")
    return blocks.mapInArrow(run, "doc_id long, seed long, at int, times int, beside long, first long")


def chain(a: np.ndarray, b: np.ndarray, k: int = K, gap: float = GAP) -> list[np.ndarray]:
    """Chains of anchors (a[i], b[i]), sorted and distinct: indices in order, best first, each anchor in one chain."""
    steps = np.diff(a)
    if (np.diff(b) == steps).all() and (steps < k + k / (2 * gap)).all():  # on one diagonal, with gaps that any score bears
        return [np.arange(len(a))]
    order = np.lexsort((b, a))
    rank = np.unique(b, return_inverse=True)[1]
    size = int(rank.max()) + 1
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, back = {}, {}
    pending: list[int] = []
    xs, ys, rs = a.tolist(), b.tolist(), rank.tolist()
    last = None
    for i in order.tolist():
        if xs[i] != last:  # anchors at one place don't follow each other
            for j in pending:
                value, r = (score[j] + gap * (xs[j] + ys[j]), j), rs[j] + 1
                while r <= size:
                    if tree[r] < value:
                        tree[r] = value
                    r += r & -r
            pending, last = [], xs[i]
        best, r = (-1e18, -1), rs[i]  # strictly smaller places
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        # what two anchors share isn't counted twice, nor is it a gap
        more = best[0] - gap * (xs[i] + ys[i]) + 2 * gap * k if best[1] >= 0 else 0.0
        near = min(xs[i] - xs[best[1]], ys[i] - ys[best[1]], k) if best[1] >= 0 else k
        if best[1] >= 0 and more + near > k:
            score[i], back[i] = more + near, best[1]
        else:
            score[i], back[i] = float(k), -1
        pending.append(i)
    used, out = set(), []
    for i in sorted(score, key=lambda j: (-score[j], j)):
        path = []
        while i >= 0 and i not in used:
            used.add(i)
            path.append(i)
            i = back[i]
        if path:
            out.append(np.array(path[::-1]))
    return out


def _chains(pairs: DataFrame, k: int = K) -> DataFrame:
    """(doc, other, a, b): the anchors of chains, from pairs (doc, other, anchors)."""

    def run(batches):
        for batch in batches:
            lists = batch.column("anchors")
            flat, ends = lists.flatten(), np.cumsum(np.asarray(lists.value_lengths()))
            a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
            out, start = [], 0
            for doc, other, end in zip(batch.column("doc").to_pylist(), batch.column("other").to_pylist(), ends.tolist(), strict=True):
                x, y = np.divmod(np.unique(a[start:end].astype(np.int64) << 32 | b[start:end]), 1 << 32)
                start = end
                out += [(doc, other, x[path], y[path]) for path in chain(x, y, k)]
            if out:
                docs, others, xs, ys = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(others, pa.int64()), pa.array(xs, pa.list_(pa.int32())), pa.array(ys, pa.list_(pa.int32()))], ["doc", "other", "a", "b"])

    return pairs.mapInArrow(run, "doc long, other long, a array<int>, b array<int>")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """The length of the longest common subsequence, by rows of bits: a bit of ``open_`` is off where it grows at a word of x."""
    if len(x) > len(y):
        x, y = y, x
    places: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    every = open_ = (1 << len(x)) - 1
    for at in map(places.get, y.tolist()):
        if at:
            some = open_ & at
            open_ = (open_ + some | open_ - some) & every
    return len(x) - open_.bit_count()


def _common_ends(x: np.ndarray, y: np.ndarray, n: int, k: int) -> int:
    """Equal words by which the n words before a gap and the k words after it extend into it."""
    i, j, before = extend(x, y, n, n, n)
    return before + extend(x[i:][::-1], y[j:][::-1], k, k, k)[2]


def _blocks(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j, n): runs of equal words along a chain's anchors, and the (words skipped, words matched) of the gap after each but the last."""
    if (a - b == a[0] - b[0]).all() and (x[a[0] : a[-1] + k] == y[b[0] : b[-1] + k]).all():
        return np.array([[a[0], b[0], a[-1] - a[0] + k]]), np.zeros((0, 2), np.int64)
    blocks, gaps = [[int(a[0]), int(b[0]), k]], []
    for p, q in zip(a[1:].tolist(), b[1:].tolist(), strict=True):
        i, j, n = blocks[-1]
        if p - q == i - j:
            same = int((x[i + n : p] == y[j + n : q]).sum())
            if p <= i + n or same == p - i - n:
                blocks[-1][2] = p + k - i
            else:
                gaps.append((p - i - n, same)), blocks.append([p, q, k])
        elif p >= i + n and q >= j + n:
            left, right = x[i + n : p], y[j + n : q]
            same = _common(left, right) if max(len(left), len(right)) <= LONGEST else _common_ends(left, right, n, k)
            gaps.append((max(len(left), len(right)), same)), blocks.append([p, q, k])
    return np.array(blocks, np.int64), np.array(gaps, np.int64).reshape(-1, 2)


def _pieces(blocks: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(a0, a1, b0, b1, matched) of the longest stretches of blocks whose identity is over the limit, longest first, each block in one."""
    a, b, n = blocks.T
    if len(n) == 1:
        return [(int(a[0]), int(a[0] + n[0]), int(b[0]), int(b[0] + n[0]), int(n[0]))]
    ends = a + n, b + n
    done = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(gaps[:, 1]))
    out, todo = [], [(0, len(n) - 1)]
    while todo:
        lo, hi = todo.pop()
        if lo > hi:
            continue
        matched = done[0][hi + 1] - done[0][lo] + done[1][hi] - done[1][lo]
        if lo < hi and matched < IDENTITY * max(ends[0][hi] - a[lo], ends[1][hi] - b[lo]):
            loss = gaps[lo:hi, 0] - gaps[lo:hi, 1]
            at = lo + int(loss.argmax())
            if IDENTITY * (matched + loss.max()) > matched:  # no stretch over this gap can reach the limit
                todo += [(lo, at), (at + 1, hi)]
                continue
            best = (0, lo, lo)
            for i in range(lo, hi + 1):
                span = np.maximum(ends[0][i : hi + 1] - a[i], ends[1][i : hi + 1] - b[i])
                same = done[0][i + 1 : hi + 2] - done[0][i] + done[1][i : hi + 1] - done[1][i]
                j = int(np.flatnonzero(same >= IDENTITY * span)[-1])
                best = max(best, (int(span[j]), i, i + j))
            todo += [(lo, best[1] - 1), (best[2] + 1, hi)]
            lo, hi = best[1:]
            matched = done[0][hi + 1] - done[0][lo] + done[1][hi] - done[1][lo]
        out.append((int(a[lo]), int(ends[0][hi]), int(b[lo]), int(ends[1][hi]), int(matched)))
    return out


def extend(x: np.ndarray, y: np.ndarray, a: int, b: int, matched: int) -> tuple[int, int, int]:
    """Words of x and of y by which an alignment of a and b words goes on, and how many of them are equal.

    An equal word counts 1, any other -1, a skipped one -1; the end is the best place before the sum has fallen ``DROP`` below it where
    the whole alignment keeps its identity. Up to ``SHIFT`` words are skipped in one document where ``JUMP`` more are won so.
    """
    i = j = same = 0
    while True:
        n = min(len(x) - i, len(y) - j)
        if not n:
            return i, j, same
        u, v = x[i : i + NEAR].tolist(), y[j : j + NEAR].tolist()
        step, won, ended = _step(u[:FIRST], v[:FIRST], a + i, b + j, matched + same)
        if not ended and n > FIRST:
            step, won = _long_step(x[i : i + n], y[j : j + n], a + i, b + j, matched + same)
        if step:
            i, j, same = i + step, j + step, same + won
            continue
        skip = _skip(u, v, a + i, b + j, matched + same)
        if skip is None:
            return i, j, same
        i, j, same = i + skip[0], j + skip[1], same + skip[2]


def _step(u: list[int], v: list[int], a: int, b: int, matched: int) -> tuple[int, int, bool]:
    """(words, equal ones) up to the best place on the diagonal, and whether the sum has fallen ``DROP`` below its best; see ``extend``."""
    most, longest = 0, max(a, b)
    score = top = equal = best = won = 0
    for t, (p, q) in enumerate(zip(u, v, strict=False), 1):
        if p == q:
            equal, score = equal + 1, score + 1
            most = max(most, score)
            if score > top and matched + equal >= IDENTITY * (longest + t):
                top, best, won = score, t, equal
        else:
            score -= 1
            if most - score >= DROP:
                return best, won, True
    return best, won, False


def _long_step(x: np.ndarray, y: np.ndarray, a: int, b: int, matched: int) -> tuple[int, int]:
    """The same for words that go on."""
    size = 8 * FIRST
    while True:
        size = min(size, len(x))
        equal = x[:size] == y[:size]
        score = np.cumsum(2 * equal - 1)
        fallen = np.flatnonzero(np.maximum(np.maximum.accumulate(score), 0) - score >= DROP)
        if len(fallen) or size == len(x):
            break
        size *= 8
    if len(fallen):
        equal, score = equal[: fallen[0]], score[: fallen[0]]
    kept = matched + np.cumsum(equal) >= IDENTITY * (max(a, b) + np.arange(1, len(equal) + 1))
    score = np.where(kept & equal, score, -1)
    at = int(score.argmax())
    return (at + 1, int(equal[: at + 1].sum())) if score[at] > 0 else (0, 0)


def _skip(u: list[int], v: list[int], a: int, b: int, matched: int) -> tuple[int, int, int] | None:
    """(words of x, of y, equal ones) of the best way on that skips words in one of them; None if none wins ``JUMP``.

    Equal words are looked up, so that only skips that have some cost anything.
    """
    places: dict[int, list[int]] = {}
    for q, w in enumerate(v):
        places.setdefault(w, []).append(q)
    found: dict[int, list[int]] = {}  # by skipped words (of x, or negative of y), the places of equal words behind them
    for p, w in enumerate(u):
        for q in places.get(w, ()):
            if p != q and abs(p - q) <= SHIFT and min(p, q) < FIRST:
                found.setdefault(p - q, []).append(min(p, q))
    best = None
    for s in sorted(found):
        left, right = max(s, 0), max(-s, 0)
        for won, t in enumerate(found[s], 1):
            score = 2 * won - (t + 1) - abs(s)
            if score >= JUMP and (best is None or score > best[0]) and matched + won >= IDENTITY * max(a + left + t + 1, b + right + t + 1):
                best = score, left + t + 1, right + t + 1, won
    return best and best[1:]


def align(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int = K) -> list[tuple[int, int, int, int, int]]:
    """Spans [a0, a1) of x and [b0, b1) of y around a chain's anchors, and the words matched in them; a chain is cut where its gaps break the identity."""
    out = []
    for a0, a1, b0, b1, matched in _pieces(*_blocks(x, y, a, b, k)):
        while True:  # what one end wins may let the other go on
            i, j, same = extend(x[a1:], y[b1:], a1 - a0, b1 - b0, matched)
            a1, b1, matched = a1 + i, b1 + j, matched + same
            p, q, more = extend(x[:a0][::-1], y[:b0][::-1], a1 - a0, b1 - b0, matched)
            a0, b0, matched = a0 - p, b0 - q, matched + more
            if not p:
                break
        out.append((a0, a1, b0, b1, matched))
    return out


def _word_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, words): hashes of 32 bits."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array((words.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32), np.diff(words.bounds))], ["doc_id", "words"])

    text_batches(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, words array<int>")


def _anchors(shared: DataFrame) -> DataFrame:
    """(doc, other, anchors): the places of shared (doc_id, seed, places, beside, first) seeds against those of their first document.

    A pair with one seed alone is left out where the words on neither side of it look alike: a passage has 22 words or more on one.

    Where one document has more places than the other, its later ones start again with the first place there; so each
    place has an anchor. Those of the first document have theirs in the second one.
    """
    others = shared.filter("doc_id <> first")
    heads = shared.filter("doc_id = first").select("seed", F.col("places").alias("b"), F.col("beside").alias("there"))
    same = [F.col(c).bitwiseAND(F.lit(mask)) for mask in (0xFFFFFFFF, -1 << 32) for c in ("beside", "there")]
    like = [(F.bit_count(p.bitwiseAND(q)) >= AGREE) | (p == q) & (p != 0) for p, q in (same[:2], same[2:])]
    pairs = others.join(heads, "seed").select(F.col("doc_id").alias("doc"), F.col("first").alias("other"), F.col("places").alias("a"), "b", F.coalesce(like[0] | like[1], F.lit(True)).alias("like"))
    later = stored(shared.filter("doc_id = first and size(places) > 1").selectExpr("seed", "first as other", "places as b"))
    second = others.join(later.select("seed"), "seed").groupBy("seed").agg(F.min("doc_id").alias("doc"))
    pairs = pairs.unionByName(later.join(second, "seed").join(others.selectExpr("seed", "doc_id as doc", "places as a"), ["seed", "doc"]).select("doc", "other", "a", "b", F.lit(True).alias("like")))
    anchors = F.expr("transform(sequence(0, greatest(size(a), size(b)) - 1), i -> struct(a[i % size(a)] as a, b[i % size(b)] as b))")
    return pairs.withColumn("anchors", anchors).groupBy("doc", "other").agg(F.flatten(F.collect_list("anchors")).alias("anchors"), F.max("like").alias("like")).filter("like or size(anchors) > 1").drop("like")


def _aligned(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, partner_id, identity): the passages of the chains of shared seeds, on both sides, stored."""
    chains = stored(_chains(_anchors(shared)))
    tidy(docs.sparkSession)
    wanted = chains.select(F.col("doc").alias("doc_id")).union(chains.select("other")).distinct()
    words = stored(_word_lists(docs.join(wanted, "doc_id", "left_semi")))
    tidy(docs.sparkSession)
    margin, found, used = MARGIN, None, [chains, words]
    while True:
        out = stored(_passages(chains, words, margin))
        used.append(out)
        tidy(docs.sparkSession)
        part = out.filter("a is null").select("doc_id", "start_word", "end_word", "partner_id", "identity")
        found = part if found is None else found.unionByName(part)
        chains = out.filter("a is not null").selectExpr("doc_id as doc", "partner_id as other", "a", "b")
        if chains.isEmpty():
            found = stored(found)
            discard(*used)
            return found
        margin *= 16


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    """The rows of a list column."""
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(lists.value_lengths()))[:-1])


def _passages(chains: DataFrame, words: DataFrame, margin: int, k: int = K) -> DataFrame:
    """The passages of chains (doc, other, a, b); a chain whose alignment comes near the end of a slice of words comes out as it is."""
    cut = lambda p: F.greatest(F.lit(0), F.element_at(p, 1) - margin)
    piece = lambda p: F.slice("words", cut(p) + 1, F.element_at(p, -1) + k + margin - cut(p))
    moved = lambda p: F.transform(p, lambda x: x - cut(p))
    both = chains.join(words, chains.doc == words.doc_id).select("doc", "other", cut("a").alias("at_a"), moved("a").alias("a"), "b", piece("a").alias("x"))
    both = both.join(words, both.other == words.doc_id).select("doc", "other", "at_a", "a", "x", cut("b").alias("at_b"), moved("b").alias("b"), piece("b").alias("y"))
    near = MARGIN // 3

    def run(batches):
        for batch in batches:
            out = []
            columns = [_arrays(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
            for doc, other, at_a, a, x, at_b, b, y in zip(*columns, strict=True):
                spans = align(x, y, a, b, k)
                most_a, most_b = (len(v) - near if len(v) == p[-1] + k + margin else len(v) + 1 for v, p in ((x, a), (y, b)))  # a shorter slice ends with its document
                if any(at_a and a0 < near or at_b and b0 < near or a1 > most_a or b1 > most_b for a0, a1, b0, b1, _ in spans):
                    out.append((doc, None, None, other, None, a + at_a, b + at_b))
                    continue
                for a0, a1, b0, b1, matched in spans:
                    identity = matched / max(a1 - a0, b1 - b0)
                    if min(a1 - a0, b1 - b0) >= MIN_WORDS and identity >= IDENTITY:
                        out += [(doc, at_a + a0, at_a + a1, other, identity, None, None), (other, at_b + b0, at_b + b1, doc, identity, None, None)]
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "start_word", "end_word", "partner_id", "identity", "a", "b"])

    return both.mapInArrow(run, "doc_id long, start_word long, end_word long, partner_id long, identity double, a array<int>, b array<int>")


def _rest(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``shared`` (doc_id, seed, at) outside the passages found in their documents."""
    order = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    spans = found.select("doc_id", "start_word", "end_word").distinct()
    fresh = F.coalesce(F.col("start_word") > F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("island", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "island").agg(F.min("start_word").alias("from"), F.max("end_word").alias("to"))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    return shared.join(spans, "doc_id", "left").filter("not exists(coalesce(spans, array()), s -> at >= s.from and at < s.to)").select("doc_id", "seed", "at").distinct()


def _shared(rows: DataFrame, also: str = "true") -> DataFrame:
    """rows (doc_id, seed, ...) of seeds in several documents, with the first of these.

    The first documents are stored, so that a frequent seed's rows can be dealt anew in the join.
    """
    rows = stored(rows)  # read twice
    first = rows.groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), *[F.max(F.expr(also)).alias("some")]).filter("first < last and some")
    first = stored(first.select("seed", "first"))
    out = stored(rows.join(first, "seed"))
    discard(rows, first)
    return out


def _lists(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(doc_id, seed, places) of documents with their keys and the place of each."""
    ids, found, places, counts = [], [], [], []
    for doc, keys, at in rows:
        values, n = np.unique(keys, return_counts=True)
        ids.append(np.full(len(values), doc, np.int64)), found.append(values), counts.append(n), places.append(at[keys.argsort(kind="stable")].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(signed(np.concatenate(found))), list_array(np.concatenate(places), np.concatenate(counts))], ["doc_id", "seed", "places"])


def _places(shared: DataFrame) -> DataFrame:
    """(doc_id, seed, places, beside, first) of shared (doc_id, seed, at, times, beside, first) seeds; beside is null for several places."""
    one = shared.filter("times = 1").select("doc_id", "seed", F.array("at").alias("places"), "beside", "first")
    return one.unionByName(shared.filter("times > 1").groupBy("doc_id", "seed").agg(F.array_sort(F.collect_list("at")).alias("places"), F.lit(None).cast("long").alias("beside"), F.min("first").alias("first")))


def _runs(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, seed, places, first): the keys of the second pass.

    places: (doc_id, rest, left, shared), arrays of places in words: of seeds outside what was found, of equal seeds wherever they stand, and
    of all shared seeds. Keys hold a place of ``left``, and in some document one of ``rest``.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words, rows, fresh = Words(part.column("text")), [], []
                runs, mers = shingles(words.hashes, MIN_WORDS), shingles(words.hashes, K)
                for doc, rest, left, shared, a, b in zip(part.column("doc_id").to_pylist(), *(_arrays(part.column(c)) for c in ("rest", "left", "shared")), words.bounds[:-1], words.bounds[1:], strict=True):
                    if b - a < K:
                        continue
                    own = runs[a : max(a, b - MIN_WORDS + 1)]
                    lone = sampled(mers[a : b - K + 1])
                    within = lambda at: at[at < b - a - K + 1]  # noqa: E731 - other texts of the same id may be longer
                    lone[within(shared)] = False  # sampled seeds of this document only
                    count = lambda marks: np.append(0, np.cumsum(marks))
                    some, new = np.zeros((2, b - a - K + 1), bool)
                    some[within(left)], new[within(rest)] = True, True
                    over = lambda marks: count(marks)[MIN_WORDS - K + 1 :] - count(marks)[: -(MIN_WORDS - K + 1)]  # noqa: E731 - how many a run holds
                    at = np.flatnonzero((over(lone) == 0) & (over(some) > 0))
                    keys, starts, hold = [own[at]], [at], [over(new)[at] > 0]
                    seq = np.sort(within(shared))
                    if len(seq) >= RUN:
                        at = np.flatnonzero(np.convolve(some[seq], np.ones(RUN, int), "valid"))
                        keys.append(shingles(mers[a + seq], RUN)[at]), starts.append(seq[at]), hold.append(np.convolve(new[seq], np.ones(RUN, int), "valid")[at] > 0)
                    keys, starts, hold = map(np.concatenate, (keys, starts, hold))
                    if len(keys):
                        rows.append((doc, keys, starts))
                        fresh.append(np.unique(keys[hold]))
                if rows:
                    out = _lists(rows)
                    found = np.concatenate([np.isin(np.unique(keys), new) for (_, keys, _), new in zip(rows, fresh, strict=True)])
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(found)], ["doc_id", "seed", "places", "fresh"])

    text_batches(docs.sparkSession)
    runs = docs.join(places, "doc_id").select("doc_id", "text", "rest", "left", "shared").mapInArrow(run, "doc_id long, seed long, places array<int>, fresh boolean")
    return _shared(runs, "fresh")


def _one_text(docs: DataFrame) -> DataFrame:
    """docs with one row for each doc_id, that with the smallest text."""
    twice = stored(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if twice.isEmpty():
        return docs
    return docs.join(twice, "doc_id", "left_anti").unionByName(docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, partner_id, n_partners, identity): each passage of a document that another one has too.

    partner_id: the smallest document that it was aligned with; n_partners: how many such documents. Of passages within one
    another with the same partner, the longest counts.
    """
    docs = _one_text(docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null"))
    shared = stored(seeds(docs))
    tidy(docs.sparkSession)
    found = _aligned(docs, _places(shared))
    rest = stored(_rest(shared, found))
    seen = stored(rest.select("seed").distinct())
    left = shared.join(seen, "seed").select("doc_id", "at")
    places = stored(left.groupBy("doc_id").agg(F.collect_list("at").alias("left")))
    places_of = places.join(rest.groupBy("doc_id").agg(F.collect_list("at").alias("rest")), "doc_id", "left").join(shared.groupBy("doc_id").agg(F.collect_list("at").alias("shared")), "doc_id")
    runs = _runs(docs, places_of.select("doc_id", F.coalesce("rest", F.array().cast("array<int>")).alias("rest"), "left", "shared"))
    discard(shared, rest, seen, places)
    found = found.unionByName(_aligned(docs, runs.withColumn("beside", F.lit(None).cast("long"))))
    discard(runs)
    order = Window.partitionBy("doc_id", "partner_id").orderBy("start_word", F.desc("end_word"), F.desc("identity"))
    found = found.withColumn("reach", F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("reach is null or reach < end_word")
    return found.groupBy("doc_id", "start_word", "end_word").agg(F.min("partner_id").alias("partner_id"), F.countDistinct("partner_id").alias("n_partners"), F.max("identity").alias("identity"))
