"""Fill-in-middle rows by counted quantifiers, in SQL functions only.

A text is cut into units, ``UNIT`` by ``UNIT`` from left to right over code points. ``regexp_count`` gives their number n; a hash of the id
draws the cuts a <= b. One pattern, made for the row, takes ``a`` units as group 1, ``b - a`` as group 2 and the rest as group 3, and
one replacement writes the groups in the order of the form. The counts are possessive: the regular expression never goes back, and
runs in a loop, so a text of any length needs no deeper stack.

A text is left plain if it is empty, if it contains a marker, or if the hash says so; all others can be restored exactly, for no marker
can arise at a joint: each begins with ``<`` and ends with ``>``. Null texts are empty, a null id is drawn like an empty one; repeated rows come
out as often as they stand and alike; an empty table stays empty; extra columns are kept by ``transform`` as they are, and its own columns take the place of columns of
the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit of a text, and the markers (fixed values).
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: What a row gets.
NEW = ["n", "form", "output"]


def draw(doc_id: Column, i: int, seed: int = 1) -> Column:
    """The i-th of eight numbers below 2^32 that belong to an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Rows of docs (doc_id, text, ...) with n (units), form (plain, psm or spm) and output (the text to train on)."""
    kept = [c for c in docs.columns if c not in NEW]
    text, h = F.coalesce("text", F.lit("")), [draw(F.col("doc_id"), i, seed) for i in range(4)]
    rows = docs.select(F.struct(*kept).alias("row"), text.alias("text"), F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"), F.array(*h).alias("h"))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    form = F.when((F.col("n") == 0) | marked | (F.col("h")[2] % 100 >= cut), "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    cuts = [F.col("h")[i] % (F.col("n") + 1) for i in (0, 1)]
    rows = rows.select("row", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    unit = f"(?:{UNIT.replace('+', '++')})"
    pattern = F.format_string(f"^({unit}{{%d}}+)({unit}{{%d}}+)((?s:.*+))$", "a", F.col("b") - F.col("a")).alias("pattern")
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    return rows.select("row.*", "n", "form", output.alias("output"))


def parts(output: Column, form: Column) -> Column:
    """(prefix, middle, suffix) of an output; null if it is plain."""
    cut = F.split(output, f"<[{PREFIX[1]}{SUFFIX[1]}{MIDDLE[1]}]>", -1)
    first = F.when(form == "spm", 2).otherwise(1)
    return F.when(form != "plain", F.struct(F.get(cut, first).alias("prefix"), F.get(cut, F.lit(3)).alias("middle"), F.get(cut, 3 - first).alias("suffix")))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(p["prefix"], p["middle"], p["suffix"]))


def digest(docs: DataFrame) -> DataFrame:
    """What the transformation gives, with hashes in place of texts."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = transform(docs.select("doc_id", "text")).select("doc_id", "n", "form", "output", parts(F.col("output"), F.col("form")).alias("p"))
    restored = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("p.prefix", "p.middle", "p.suffix"))
    return rows.select("doc_id", "n", "form", F.char_length("p.prefix").cast("long").alias("prefix_chars"), F.char_length("p.middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


#: The same by lists of units.
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{UNIT}') AS u, [CAST('0x' || substr(s, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= {CUT} THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
