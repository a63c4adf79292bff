"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets form a class;
the classes are joined on signatures that any linked pair must share, and verified on the whole sets.

Guarantee. A pair whose Jaccard similarity is at least ``t`` shares ``o >= t * max(size)`` hashes, so the
``size - o + k`` smallest hashes of both sets share at least ``k``. Of these, only hashes that another class has too
can be shared, which drops most hashes and, by the count ``k``, most documents. The rest are ordered from
rare to frequent and the argument is used again: in the first ``count - k + j`` at least ``j`` are shared. Then
either one of them is rare, and both sets have it as a single-token signature, or all ``j`` are frequent. The
frequent ones are dealt into ``j - 1`` blocks by hash, so one block holds two shared ones: the signature is that
pair. ``j`` is about a quarter of ``k``. Blocks depend on the size class of the smaller set; a set gives pairs for each class a partner may have.

Groups. A signature list isn't expanded into pairs. All members are compared with one pivot; after that, lists
whose members are all connected are done, lists of up to ``small`` members give their unconnected pairs, and
longer ones take the next pivot. After ``rounds`` pivots, what is left in the lists of one largest component is
compared in blocks of documents: a task gets two blocks and gives verified links only, so no component is lost.

Counts. The links found so connect what all links connect, but aren't all of them. For ``n_links`` all pairs of classes of a component that can
reach the similarity by their sizes are compared in blocks, of which a task gives the count of each class only. Copies
aren't expanded: a class counts as many documents as it has.

Null and empty texts, and texts without words, have an empty set and no link. Fewer words than a shingle are one
shingle. A doc_id names one text; repeated rows count once as a class member and come out as often as they went
in. Rows without a doc_id get no component. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Words, chunks, list_array, mix, shingles, signed, stored, text_batches
from ._graph import components

SIZE, PERCENT = 5, 75
#: A token that more classes have is frequent.
RARE = 16
#: Lists of up to so many members give all unconnected pairs once they have been compared with a pivot.
SMALL = 64
ROUNDS = 2
#: Documents and tokens of a block in the last comparison, on average.
BLOCK, TOKENS = 128, 100_000


def shingle_sets(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words = Words(column)
    runs, out = shingles(words.hashes, size), []
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(shingles(words.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _need(n, percent: int):
    """Shared hashes that a set of size n needs with any partner."""
    return -(-n * percent // 100)


def _reserve(n: int, percent: int) -> int:
    """How many shared hashes the prefix of a set of size n is to hold at least."""
    return 1 + max(n // 20, min(48, n * 5 // 8))


def _common(n: int, percent: int) -> int:
    """How many shared prefix hashes hold with any partner, whose size is at least the needed overlap."""
    return _reserve(_need(n, percent), percent)


def sketch(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, prefix: bool = True) -> DataFrame:
    """(doc_id, n, h1, h2[, prefix]): set size, set identity, and the smallest hashes of the set."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), size)
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                h2 = np.array([mix(s ^ np.uint64(0xA5A5F00DCAFE1234)).sum(dtype=np.uint64) for s in sets], np.uint64)
                columns = [part.column("doc_id"), pa.array(n), pa.array(signed(h1)), pa.array(signed(h2))]
                if prefix:
                    cut = [s[: len(s) - _need(len(s), percent) + _reserve(len(s), percent)] for s in sets]
                    columns.append(list_array(signed(np.concatenate(cut)), [len(c) for c in cut]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "prefix"][: len(columns)])

    text_batches(docs.sparkSession)
    schema = "doc_id long, n long, h1 long, h2 long" + ", prefix array<long>" * prefix
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def token_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, tokens): whole sets."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(signed(np.concatenate(sets)), [len(s) for s in sets])], ["doc_id", "tokens"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tokens array<long>")


def _class_of(n: int, percent: int) -> tuple[int, int]:
    """Size class of a smaller set, and the number of blocks in it: a quarter of the shared hashes that hold there.

    More blocks mean fewer pairs of tokens in each, but a longer prefix, which takes in more frequent tokens.
    """
    q = n.bit_length() - 1
    least = _common(1 << q, percent)
    return q, max(1, least // 4) if least > 1 else 0


def signatures_of(n: int, tokens: np.ndarray, df: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> np.ndarray:
    """Signatures of a set of size n that shares ``tokens`` with ``df`` classes each in the prefix index."""
    order = np.lexsort((tokens, df))
    tokens, df, least = tokens[order], df[order], _common(n, percent)
    out = []
    for q, blocks in {_class_of(_need(n, percent), percent), _class_of(n, percent)}:
        blocks = min(blocks, least - 1)
        if blocks < 1:  # the second shared hash isn't certain: all as single tokens
            out.append(mix(tokens[: max(0, len(tokens) - least + 1)].view(np.uint64)))
            continue
        t, d = tokens[: len(tokens) - least + blocks + 1].view(np.uint64), df[: len(df) - least + blocks + 1]
        out.append(mix(t[d <= rare]))
        often = np.sort(t[d > rare])
        block = (mix(often) % np.uint64(blocks)).astype(np.int64)
        for b in np.unique(block):
            own = often[block == b]
            i, j = np.triu_indices(len(own), 1)
            out.append(mix(mix(own[i]) * np.uint64(31) + own[j] + np.uint64(q * 1_000_003)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def signatures(shared: DataFrame, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """(sig, doc) of shared(doc, n, list of (df, token)); the list of a document is as long as its own prefix at most."""

    def run(batches):
        for batch in batches:
            rows = batch.column("shared")
            df, token = rows.flatten().field("df").to_numpy(), rows.flatten().field("token").to_numpy()
            ends = np.cumsum(np.asarray(rows.value_lengths()))
            docs, sigs = [], []
            for doc, n, length, end in zip(batch.column("doc").to_pylist(), batch.column("n").to_pylist(), np.asarray(rows.value_lengths()), ends, strict=True):
                own = signatures_of(n, token[end - length : end], df[end - length : end], percent, rare)
                docs.append(np.full(len(own), doc, np.int64))
                sigs.append(signed(own))
                if sum(map(len, sigs)) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(docs))], ["sig", "doc"])
                    docs, sigs = [], []
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(docs))], ["sig", "doc"])

    return shared.mapInArrow(run, "sig long, doc long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(a, "a").filter("size(ta) > 0").join(b, "b")
    # equal sizes alone can rule a pair out before the sets are intersected
    both = both.filter(f"100 * least(size(ta), size(tb)) >= {percent} * greatest(size(ta), size(tb))")
    both = both.withColumn("i", F.size(F.array_intersect("ta", "tb")).cast("long"))
    return both.filter(f"100 * i >= {percent} * (size(ta) + size(tb) - i)").select("a", "b").distinct()


def links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, rare: int = RARE, small: int = SMALL, rounds: int = ROUNDS):
    """(classes, label, reps, sets): classes(doc_id, n, class, copies) of all documents, the components label(node, component) of linked classes, the
    classes with words reps(class, n, copies), and the whole sets(doc_id, tokens) of those that may be linked.

    The links compared for it connect all that the whole set of links connects.
    """
    base = stored(sketch(docs, size, percent, prefix=False))
    reps = base.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class"), F.countDistinct("doc_id").alias("copies"))
    reps = stored(reps)
    classes = base.join(reps, ["h1", "h2", "n"], "left").select("doc_id", "n", F.coalesce("class", "doc_id").alias("class"), "copies")
    # equal sets have equal prefixes, so any copy's will do
    full = sketch(docs, size, percent).filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc"), F.first("prefix").alias("prefix")).filter("doc is not null")
    postings = full.select("doc", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    shared = postings.withColumn("df", F.count("*").over(Window.partitionBy("token")).cast("int")).filter("df >= 2")
    shared = shared.groupBy("doc").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "token")).alias("shared"))
    need = F.ceil(F.col("n") * percent / 100)
    least = 1 + F.greatest(F.floor(need / 20), F.least(F.lit(48), F.floor(need * 5 / 8)))
    shared = stored(shared.filter(F.size("shared") >= least))
    sigs = signatures(shared, percent, rare)
    lists = sigs.groupBy("sig").agg(F.count("*").alias("members"), F.min("doc").alias("pivot")).filter("members > 1")
    # what bounds a pair's overlap: size, hashes in the prefix, and how many of those another class has too
    sizes = shared.select("doc", "n", _prefix_length(F.col("n"), percent).alias("p"), F.size("shared").alias("c"))
    sigs = stored(sigs.join(lists, "sig").join(sizes, "doc"))
    sets = stored(token_sets(docs.join(sigs.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), size))

    edges, label, seen = None, None, None
    for turn in range(rounds + 1):
        if turn == 0:
            pairs = _close(_side(sigs.filter("doc = pivot"), "a"), _side(sigs.filter("doc <> pivot"), "b"), percent)
            pairs = pairs.select("a", "b").distinct()
        else:
            sigs = _with_labels(sigs, label)
            counts = sigs.groupBy("sig", "label").agg(F.count("*").alias("k"), F.min("doc").alias("low"))
            live = counts.groupBy("sig").agg(F.sum("k").alias("members"), F.count("*").alias("labels"), F.max(F.struct("k", "label", "low")).alias("top"))
            live = live.filter("labels > 1").select("sig", "members", F.col("top.label").alias("major"), F.col("top.low").alias("pivot"))
            sigs = stored(sigs.select("sig", *NODE, "label").join(live, "sig"))
            if sigs.isEmpty():
                break
            # the largest component of a list needs no comparison within
            minor = sigs.filter("label <> major")
            if turn == rounds:
                found = stored(_in_blocks(sigs, sets, percent))
                edges = edges.unionByName(found)
                label = stored(components(edges))
                break
            whole = f"members <= {small}"
            pairs = _close(_side(minor.filter(whole), "a", "label"), _side(sigs.filter(whole), "b", "label", "major"), percent, "labela <> labelb and (labelb = majorb or a < b)")
            sigs = sigs.filter(f"members > {small}")
            pairs = pairs.unionByName(_close(_side(minor.filter(f"members > {small}"), "a"), _side(sigs.filter("doc = pivot"), "b"), percent))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        seen = pairs if seen is None else seen.unionByName(pairs)
        found = stored(_verified(pairs, sets, percent))
        edges = found if edges is None else edges.unionByName(found)
        label = stored(components(edges))
        sigs = sigs.filter("doc <> pivot" if turn else f"members <= {small} or doc <> pivot").select("sig", *NODE)
    return classes, label, reps.select("class", "n", "copies"), sets


#: A member of a list: document, set size, prefix length, and prefix hashes that are shared.
NODE = ["doc", "n", "p", "c"]


def _prefix_length(n, percent: int):
    need = F.ceil(n * percent / 100)
    return F.least(n, n - need + 1 + F.greatest(F.floor(n / 20), F.least(F.lit(48), F.floor(n * 5 / 8))))


def _side(sigs: DataFrame, name: str, *more: str) -> DataFrame:
    return sigs.select("sig", F.col("doc").alias(name), *[F.col(x).alias(x + name) for x in (*NODE[1:], *more)])


def _close(left: DataFrame, right: DataFrame, percent: int, also: str = "true") -> DataFrame:
    """Pairs (a, b) of members of a list that can be linked, by numbers alone.

    A linked pair shares at least ``percent / (100 + percent)`` of both sizes, so its prefixes share at least that less
    what lies beyond the prefix; and no more than what either of them shares with any class.
    """
    overlap = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-9)
    least = F.least(F.col("pa") - F.col("na"), F.col("pb") - F.col("nb")) + overlap
    ratio = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    pairs = left.join(right, "sig").filter(f"a <> b and {ratio} and {also}").filter(F.least("ca", "cb") >= least)
    return pairs.select("sig", "a", "b")


def _with_labels(sigs: DataFrame, label: DataFrame) -> DataFrame:
    return sigs.select("sig", *NODE).join(label.select(F.col("node").alias("doc"), "component"), "doc", "left").select("sig", *NODE, F.coalesce("component", "doc").alias("label"))


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which of two blocks of sets reach the similarity, by products of their incidence over common tokens."""
    ta, tb = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(ta, tb)
    na, nb = (np.array([len(t) for t in side]) for side in (left, right))
    ra, rb = np.repeat(np.arange(len(left)), na), np.repeat(np.arange(len(right)), nb)
    ca, cb = np.searchsorted(common, ta), np.searchsorted(common, tb)
    both = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, len(common), 4096):
        part = common[lo : lo + 4096]
        x, y = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        for m, t, r, c in ((x, ta, ra, ca), (y, tb, rb, cb)):
            keep = (c >= lo) & (c < lo + len(part))
            keep[keep] = common[c[keep]] == t[keep]
            m[r[keep], c[keep] - lo] = 1
        both += (x @ y.T).astype(np.int64)
    return 100 * both >= percent * (na[:, None] + nb[None, :] - both)


def block_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int = PERCENT) -> set[tuple[int, int]]:
    """Linked pairs (a, b), a < b, of two blocks of (document, tokens)."""
    i, j = np.nonzero(linked([t for _, t in left], [t for _, t in right], percent))
    return {(min(a, b), max(a, b)) for a, b in ((left[p][0], right[q][0]) for p, q in zip(i.tolist(), j.tolist(), strict=True)) if a != b}


def link_counts(label: DataFrame, reps: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK, tokens: int = TOKENS) -> DataFrame:
    """(class, others): how many documents of other classes each class of label (node, component) is linked with.

    Two classes of a component are linked. A larger component that fits a block is compared as a whole. One that doesn't is cut by set size, so that a linked
    pair's parts are the same or neighbours, and each part into blocks by hash. Each block is compared within; with the others of both parts it meets in
    cells of about as many blocks as their root on either side, so that no task gets them all and a block goes to few tasks.
    """
    nodes = label.join(reps, label.node == reps["class"]).select("component", F.col("node").alias("doc"), "n", "copies")
    groups = nodes.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.sum("copies").alias("together"))
    nodes = stored(nodes.join(groups, "component"))
    twos = nodes.filter("k = 2").select(F.col("doc").alias("class"), (F.col("together") - F.col("copies")).alias("others"))
    width = max(math.log(100 / percent), 0.01) * (1 + 1e-9)
    large = F.expr(f"k > {block} or all > {tokens}")
    nodes = nodes.filter("k > 2").select("component", "doc", "n", "copies", large.alias("large"), F.when(large, F.floor(F.log("n") / width)).otherwise(0).alias("part"))
    parts = stored(nodes.filter("large").groupBy("component", "part").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / tokens)).alias("blocks")))
    nodes = nodes.join(parts, ["component", "part"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("doc"), "blocks"), F.lit(0)))
    rows = nodes.join(sets.select(F.col("doc_id").alias("doc"), "tokens"), "doc")
    blocks = stored(rows.groupBy("component", "part", "block").agg(F.first("large").alias("large"), F.collect_list(F.struct("doc", "copies", "tokens")).alias("x")))
    side = parts.withColumn("side", F.ceil(F.sqrt("blocks")))
    cut = blocks.filter("large").join(side, ["component", "part"]).withColumn("at", F.pmod("block", "side"))
    # a cell has the blocks at i of a part and those at j of the same part or the next
    sides = lambda by: side.select("component", (F.col("part") + by).alias("part"), F.col("side").alias("more"))
    cell = ["component", "part", "next", "i", "j"]
    both = []
    for own, other, place in (("i", "j", "x"), ("j", "i", "y")):
        same = cut.withColumn("more", F.expr("sequence(at, side - 1)" if own == "i" else "sequence(0L, at)")).withColumn("next", F.lit(0))
        near = cut.join(sides(-1 if own == "i" else 1), ["component", "part"]).withColumn("more", F.expr("sequence(0L, more - 1)")).withColumn("next", F.lit(1))
        every = same.unionByName(near).withColumn("part", F.col("part") - (F.col("next") if own == "j" else 0))
        both.append(every.select("component", "part", "next", F.col("at").alias(own), F.explode("more").alias(other), F.col("block").alias(f"block_{place}"), F.col("x").alias(place)))
    cross = both[0].join(both[1], cell).filter("next = 1 or i < j or block_x < block_y").select("x", "y")

    def members(v: pa.Scalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        return v.values.field("doc").to_numpy(), v.values.field("copies").to_numpy(), [t.values.to_numpy() for t in v.values.field("tokens")]

    def counts(docs: list[np.ndarray], others: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(others), pa.int64())], ["class", "others"])

    def within(batches):
        for batch in batches:
            for docs, copies, own in map(members, batch.column("x")):
                m = linked(own, own, percent)
                np.fill_diagonal(m, False)
                yield counts([docs], [m @ copies])

    def between(batches):
        for batch in batches:
            for (a, na, x), (b, nb, y) in zip(map(members, batch.column("x")), map(members, batch.column("y")), strict=True):
                m = linked(x, y, percent)
                yield counts([a, b], [m @ nb, na @ m])

    text_batches(label.sparkSession)
    found = blocks.select("x").mapInArrow(within, "class long, others long").unionAll(cross.mapInArrow(between, "class long, others long"))
    return twos.unionAll(found.groupBy("class").agg(F.sum("others").alias("others")))


def _in_blocks(sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the members of lists with the same largest component that aren't in it, and all members."""
    rows = stored(sigs.select("major", "doc", "label", "n").distinct())
    counts = rows.groupBy("major").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / TOKENS)).alias("blocks"))
    rows = rows.join(counts, "major").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks"))
    rows = rows.join(sets.select(F.col("doc_id").alias("doc"), "tokens"), "doc").select("major", "block", "label", F.struct("doc", "tokens").alias("x"))
    right = rows.groupBy("major", "block").agg(F.collect_list("x").alias("y"))
    left = rows.filter("label <> major").groupBy("major", "block").agg(F.collect_list("x").alias("x"))

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                sides = [list(zip(v.values.field("doc").to_pylist(), [t.values.to_numpy() for t in v.values.field("tokens")], strict=True)) for v in (x, y)]
                links = sorted(block_links(*sides, percent))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    text_batches(sigs.sparkSession)
    return left.select("major", "x").join(right.select("major", "y"), "major").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, counted: bool = True, block: int = BLOCK, tokens: int = TOKENS, **limits) -> DataFrame:
    """(doc_id, n_shingles, component_id[, n_links]) of every row of ``docs`` (doc_id, text).

    component_id: the smallest doc_id reachable by links; null without a doc_id. n_links: with how many other documents a document is linked, its
    copies included; left out if not ``counted``.
    """
    classes, label, reps, sets = links(docs, size, percent, **limits)
    if counted:
        label = label.join(link_counts(label, reps, sets, percent, block, tokens), F.col("node") == F.col("class"), "left").drop("class")
    # stored, so that the copies of one text can be dealt anew in the join
    label = stored(label)
    out = classes.join(label, classes["class"] == label.node, "left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component", "class"))
    out = out.withColumn("n_shingles", F.col("n")).withColumn("component_id", component)
    if counted:
        out = out.withColumn("n_links", F.when(known & F.col("copies").isNotNull(), F.col("copies") - 1 + F.coalesce("others", F.lit(0))).otherwise(0).cast("long"))
    return out.select("doc_id", "n_shingles", "component_id", *["n_links"] * counted)
