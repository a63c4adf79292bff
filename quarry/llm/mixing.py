"""Mixing sources to target weights through a tree, for example domain - language - source.

Budgets go down the tree: a node shares its budget among its children by weight, none getting more than its capacity
(the tokens below it, ``epochs`` times). What a child can't use goes to its siblings by their weights before anything goes
back, because a node's budget is bounded by what its children can take: only the shortage of a whole branch reaches the
branch's siblings. The shares are found by filling up in order of capacity / weight, with running sums.

A leaf takes whole epochs and then a prefix of a last one, in an order seeded by epoch and document: documents up to the last
that fits whole. The prefix sums are taken over 256 ranges of the order first; only the range in which the prefix ends is sorted.

Nulls in the path are a leaf of their own (empty name). Texts without words have no tokens and are never taken. Repeated rows count
each; copies with one doc_id are taken together or not at all. Columns of docs named like the result's are read as the path or ignored. A node without weight in the table weighs 1; a weight of 0 or less takes nothing. Sizes are rounded down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

PATH = ["domain", "lang", "source"]
#: Target weights by level and name; others weigh 1.
WEIGHTS = {"domain": {"web": 3, "books": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}
EPOCHS, SEED, PART = 4, 7, 0.5


def domain_of(source):
    """A domain for the sources of the test tables: even numbers are web, odd ones books."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return F.when(number == "", "other").when(number.isin("0", "2", "4", "6", "8"), "web").otherwise("books")


def _fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``share``: each child's part of ``budget`` (one value per parent) by ``weight``, up to ``cap``."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("cap") / F.col("weight"), "name")
    usable = children.filter("weight > 0 and cap > 0")
    out = usable.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("rate", F.col("left") / F.col("open")).withColumn("full", F.col("cap") / F.col("weight") <= F.col("rate"))
    out = out.withColumn("level", F.max(F.when(~F.col("full"), F.col("rate"))).over(w))
    return out.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("weight") * F.col("level"))).cast("long")).drop("left", "open", "rate", "full", "level")


def budgets(leaves: DataFrame, path: list[str], weights: dict, budget: int, epochs: int = EPOCHS) -> DataFrame:
    """(path..., size, share) of leaves (path..., size in tokens)."""
    level = leaves.select(*path, "size", (F.col("size") * epochs).alias("cap"))
    caps = [level.groupBy(*path[: i + 1]).agg(F.sum("cap").alias("cap")) for i in range(len(path))]
    above = None
    for i, name in enumerate(path):
        table = weights.get(name) or {}
        weight = F.lit(1)
        if table:
            weight = F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(name)], F.lit(1))
        children = caps[i].withColumn("weight", weight.cast("long")).withColumn("name", F.col(name))
        if above is None:
            children = children.withColumn("budget", F.lit(int(budget)).cast("long"))
        else:
            children = children.join(above, path[:i])
        above = _fill(children, path[:i]).select(*path[: i + 1], F.col("share").alias("budget"))
    return leaves.join(above, path).select(*path, "size", F.col("budget").alias("share"))


def mix(docs: DataFrame, path: list[str] = PATH, weights: dict = WEIGHTS, part: float = PART, epochs: int = EPOCHS, seed: int = SEED, budget: int | None = None, whole: bool = False) -> DataFrame:
    """(doc_id, path..., tokens, epochs) of the documents taken at least once, from docs (doc_id, text, path...); with ``whole`` also the row, as a struct.

    epochs: how often the document is taken. budget: tokens in all; without it, ``part`` of the tokens of docs.
    """
    tokens = F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", *[F.coalesce(F.col(p).cast("string"), F.lit("")).alias(p) for p in path], tokens.alias("tokens"), *[F.struct("*").alias("row")] * whole).filter("tokens > 0")
    rows = stored(rows)
    leaves = stored(rows.groupBy(*path).agg(F.sum("tokens").alias("size")))
    if budget is None:
        budget = int((leaves.agg(F.sum("size")).first()[0] or 0) * part)
    shares = budgets(leaves, path, weights, budget, epochs)
    shares = stored(shares.select(*path, F.expr("share div size").alias("whole"), F.expr("share % size").alias("rest")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    # the last epoch takes each leaf's documents up to a last one, whose key and id say for every row whether it is taken
    place = F.struct(key.alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"))
    keyed = stored(rows.drop("row").join(shares, path).withColumn("place", place).withColumn("bucket", F.substring("place.key", 1, 2)))
    sums = keyed.groupBy(*path, "bucket").agg(F.sum("tokens").alias("n"), F.max("place").alias("last"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*path).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # only the bucket in which the prefix ends needs its documents' order
    inner = Window.partitionBy(*path).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = keyed.drop("rest").join(sums.filter("before <= rest and before + n > rest").select(*path, "bucket", "before", "rest"), [*path, "bucket"])
    edge = edge.withColumn("end", F.col("before") + F.sum("tokens").over(inner)).filter("end <= rest")
    last = sums.filter("before + n <= rest").select(*path, "last").unionByName(edge.select(*path, F.col("place").alias("last"))).groupBy(*path).agg(F.max("last").alias("last"))
    # a row for each leaf, stored: it is sent to all tasks if it is small, else a hot leaf's rows can be dealt anew in the join
    taken = rows.join(stored(shares.join(last, path, "left")), path).withColumn("place", place)
    times = F.col("whole") + F.when(F.col("place") <= F.col("last"), 1).otherwise(0)
    return taken.withColumn("epochs", times.cast("long")).filter("epochs > 0").select("doc_id", *path, "tokens", "epochs", *["row"] * whole)


#: The same for the query's tables and parameters, for DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9])$', 1) = '' THEN 'other'
      WHEN regexp_extract(coalesce(source, ''), '([0-9])$', 1) IN ('0', '2', '4', '6', '8') THEN 'web' ELSE 'books' END AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens
  FROM documents),
r AS (SELECT * FROM d WHERE tokens > 0),
l3 AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS size, CAST(sum(tokens) * 4 AS BIGINT) AS cap FROM r GROUP BY ALL),
l2 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM l3 GROUP BY ALL),
l1 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap FROM l2 GROUP BY ALL),
c1 AS (SELECT domain, cap, CAST(CASE domain WHEN 'web' THEN 3 WHEN 'books' THEN 2 ELSE 1 END AS BIGINT) AS w,
    (SELECT CAST(floor(sum(size) * 0.5) AS BIGINT) FROM l3) AS budget FROM l1),
f1 AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate FROM c1),
s1 AS (SELECT domain, CASE WHEN cap / w <= rate THEN cap
    ELSE CAST(floor(w * max(CASE WHEN cap / w > rate THEN rate END) OVER ()) AS BIGINT) END AS budget FROM f1),
c2 AS (SELECT l2.domain, lang, cap, CAST(CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS BIGINT) AS w, budget
    FROM l2 JOIN s1 ON l2.domain = s1.domain),
f2 AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate FROM c2),
s2 AS (SELECT domain, lang, CASE WHEN cap / w <= rate THEN cap
    ELSE CAST(floor(w * max(CASE WHEN cap / w > rate THEN rate END) OVER (PARTITION BY domain)) AS BIGINT) END AS budget FROM f2),
c3 AS (SELECT l3.domain, l3.lang, source, size, cap, CAST(1 AS BIGINT) AS w, budget FROM l3 JOIN s2 ON l3.domain = s2.domain AND l3.lang = s2.lang),
f3 AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate FROM c3),
s3 AS (SELECT domain, lang, source, size, CASE WHEN cap / w <= rate THEN cap
    ELSE CAST(floor(w * max(CASE WHEN cap / w > rate THEN rate END) OVER (PARTITION BY domain, lang)) AS BIGINT) END AS share FROM f3),
k AS (SELECT r.*, CAST(share // size AS BIGINT) AS whole, CAST(share % size AS BIGINT) AS rest,
    md5(concat('7:', CAST(CAST(share // size AS BIGINT) AS VARCHAR), ':', CAST(doc_id AS VARCHAR))) AS key
    FROM r JOIN s3 ON r.domain = s3.domain AND r.lang = s3.lang AND r.source = s3.source),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM k)
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN run <= rest THEN 1 ELSE 0 END AS BIGINT) AS epochs
FROM p WHERE whole + CASE WHEN run <= rest THEN 1 ELSE 0 END > 0
"""
