"""Personal data: fixed patterns, and a skip-chain conditional random field over the other tokens with digits or ``@``.

Patterns give the base spans of email, ip, card and phone (see ``base_spans``). The field's nodes are the tokens of a document
that hold a digit or ``@``; short groups of digits in a row are one token. Tokens that a base span covers are held to its kind. The
others get potentials from coarse features, which say less than the patterns do (how many digits, the first one of long
numbers, separators; the word before), so a token that a pattern misses by its form, its check or what stands beside it may
still look like those that are found. Neighbours, and tokens with equal text or the same last 7 digits however far apart,
share potentials that favour equal labels; a token that stands m times has m - 1 such links, not all pairs. All potentials
are fitted on a bounded sample: of features by counts against the base spans (tokens within a longer match that failed its check, such as
two numbers side by side, don't count), of links by how often linked tokens agree.
Loopy sum-product message passing runs ``ROUNDS`` rounds over each document; a token whose best label is a kind with
probability ``SURE`` adds a span.

Null texts are empty. Repeated rows come out as often as they stand; extra columns are ignored. Without any base span in
the sample the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, text_batches, text_bytes

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # within a run of digits nothing else can match
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Rows that the potentials are counted on, in expectation, and classes of features.
SAMPLE_ROWS, CLASSES = 20_000, 4096
#: A word before must be seen more often than this to say more than the labels' shares do.
RARE_WORD = 16
#: Bounds of what a link of like tokens and of neighbours may weigh.
SKIP, NEXT = (1.0, 5.0), (0.0, 0.5)
ROUNDS, SURE = 12, 0.8
_NODE = re.compile(r"""(?<![\w@.+-])\+?\(?[0-9]{1,6}\)?(?:[ .-]\(?[0-9]{1,6}\)?)+(?![\w@])|[^\s,;()<>"']+""")
_MARK = re.compile(r"[0-9@]")
_BEFORE = re.compile(r"(\w+)\W*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    """As EMAIL.finditer gives them, from one @ to the next: the leftmost match of an @ starts where its run of characters does."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
        done = max(done, 0)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start. Matches that fail their check are dropped, without another try."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def merged(text: str, nodes: list) -> list[bool]:
    """Which nodes lie within a longer match that failed its check: nothing is known of them."""
    kept = set(base_spans(text))
    failed = [m.span() for kind, pattern in (("card", CARD), ("phone", PHONE)) for m in pattern.finditer(text) if (kind, *m.span()) not in kept]
    failed.sort()
    out, i, reach = [], 0, (0, 0)
    for a, b, *_ in nodes:
        while i < len(failed) and failed[i][0] <= a:
            reach, i = max(reach, failed[i], key=lambda s: s[1]), i + 1
        out.append(reach[1] >= b and reach != (a, b))
    return out


def _class_of(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % CLASSES


def shape_of(token: str) -> str:
    """A coarse feature of a token."""
    if "@" in token:
        return "mail." if "." in token.partition("@")[2] else "mail"
    digits = re.sub(r"[^0-9]", "", token)
    if len(digits) == len(token):
        return f"number {len(digits)}" if len(digits) < 13 else f"card number {digits[0]}" if len(digits) < 20 else "number"
    if re.search(r"[^0-9 ().+-]", token):
        return "letters and digits"
    parts = re.findall("[0-9]+", token)
    if 13 <= len(digits) < 20:
        return f"card groups {digits[0]}"
    return "groups of four" if len(parts) == 4 and max(map(len, parts)) < 4 and "+" not in token else f"groups {len(digits) // 3}"


def nodes_of(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str, tuple[int, int], int]]:
    """(start, end, token, feature classes, label) of each node; label: 0 none, else the kind's number from 1."""
    spans = sorted((a, b, KINDS.index(k) + 1) for k, a, b in base)
    out, s = [], 0
    for m in _NODE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".:!?":
            b -= 1
        token = text[a:b]
        if not _MARK.search(token):
            continue
        word = _BEFORE.search(text, max(0, a - 40), a)
        while s < len(spans) and spans[s][1] <= a:
            s += 1
        label = spans[s][2] if s < len(spans) and spans[s][0] < b else 0
        out.append((a, b, token, (_class_of("s" + shape_of(token)), _class_of("w" + (word.group(1).lower() if word else ""))), label))
    return out


@dataclass
class Field:
    potentials: np.ndarray  # [shape or word before, CLASSES, labels], logarithms
    skip: float  # what equal labels win on a link of like tokens, and of neighbours
    next: float


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """The field's potentials, from a sample of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").filter("text is not null")
    dice = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) / 1_000_000
    sample = rows.filter(dice < sample_rows / max(1, rows.count()))
    k = len(KINDS) + 1

    def count(batches):
        for batch in batches:
            keys = []
            for i in np.flatnonzero(_marked(batch.column("text"))):
                text = batch.column("text")[int(i)].as_py()
                nodes = nodes_of(text, base_spans(text))
                for (_, _, _, (shape, word), label), unknown in zip(nodes, merged(text, nodes), strict=True):
                    if label or not unknown:
                        keys += [shape * k + label, (CLASSES + word) * k + label]
                for (i, j), like in _links(nodes).items():
                    if nodes[i][4] or nodes[j][4]:
                        keys.append(2 * CLASSES * k + 2 * like + (nodes[i][4] == nodes[j][4]))
            found, n = np.unique(np.array(keys, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["key", "n"])

    text_batches(docs.sparkSession)
    sums = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * CLASSES * k + 4)
    counts[sums.column("key").to_numpy()] = sums.column("n").to_numpy()
    pairs = counts[2 * CLASSES * k :].reshape(2, 2)
    near, like = (float(np.clip(np.log((yes + 1) / (no + 1)), *bounds)) for (no, yes), bounds in zip(pairs, (NEXT, SKIP), strict=True))
    counts = counts[: 2 * CLASSES * k].reshape(2, CLASSES, k)
    prior = counts[0].sum(0) + 0.1
    prior /= prior.sum()
    # a shape that was never seen is no kind, a word that was never seen says nothing
    trust, unseen = np.array([1, RARE_WORD])[:, None, None], np.stack([np.array([0.96, *[0.01] * (k - 1)]), prior])[:, None, :]
    potentials = np.log((counts + trust * unseen) / (counts.sum(2, keepdims=True) + trust))
    potentials[1] -= np.log(prior)
    return Field(potentials, like, near)


def _marked(column: pa.Array) -> np.ndarray:
    """Rows with a digit or @: others have neither spans nor nodes."""
    buf, offsets = text_bytes(column)
    sums = np.append(0, np.cumsum(((buf >= 48) & (buf <= 57)) | (buf == 64)))
    return sums[offsets[1:]] > sums[offsets[:-1]]


def _last_digits(token: str) -> str | None:
    digits = re.sub(r"[^0-9]", "", token)
    return digits[-7:] if len(digits) >= 7 else None


def _links(nodes: list) -> dict[tuple[int, int], bool]:
    """Links (i, j): neighbours, and the next node with like text (true)."""
    links = {(i, i + 1): False for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= 2}
    for key in (str.lower, _last_digits):
        last: dict[str, int] = {}
        for i, node in enumerate(nodes):
            name = key(node[2])
            if name is not None:
                if name in last:
                    links[last[name], i] = True
                last[name] = i
    return links


def infer(nodes: list, field: Field) -> np.ndarray:
    """Label probabilities [nodes, labels] by loopy message passing."""
    k = len(KINDS) + 1
    shapes = np.array([n[3] for n in nodes]).reshape(-1, 2)
    unary = field.potentials[0, shapes[:, 0]] + field.potentials[1, shapes[:, 1]]
    held = np.array([n[4] for n in nodes])
    unary[held > 0] = -30.0
    unary[held > 0, held[held > 0]] = 0
    links = _links(nodes)
    if links:
        edges, weight = np.array(list(links)), np.where(list(links.values()), field.skip, field.next)
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        same = np.exp(np.concatenate([weight, weight]))[:, None] - 1
        messages = np.zeros((len(src), k))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, messages)
            out = belief[src] - messages[back]
            out = np.exp(out - out.max(1, keepdims=True))
            out = np.log(out.sum(1, keepdims=True) + same * out)
            messages = 0.5 * messages + 0.5 * (out - out.max(1, keepdims=True))
        np.add.at(unary, dst, messages)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and those that the field adds: nodes clear of base spans with a sure label."""
    base = base_spans(text)
    nodes = nodes_of(text, base)
    added = []
    if any(n[4] == 0 for n in nodes):
        p = infer(nodes, field)
        best = p.argmax(1)
        added = [(KINDS[b - 1], n[0], n[1]) for n, b, q in zip(nodes, best.tolist(), p, strict=True) if b and not n[4] and q[b] >= SURE]
    return base, added


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end), in code points, of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                base, added = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(_marked(part.column("text"))):
                    base[i], added[i] = all_spans(part.column("text")[int(i)].as_py(), sent.value)
                lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in x], pa.list_(SPAN)) for x in (base, added)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "base", "added"])

    text_batches(docs.sparkSession)
    span = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, base {span}, added {span}")


def _is(kind: str, s):
    return s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the hash of the base spans, all spans as text, and the number added."""
    rank = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS)), strict=True) for x in pair])
    ordered = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"], s["end"], s["kind"])))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", partial(_is, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(ordered).alias("spans"), F.size("added").cast("long").alias("n_added"))
