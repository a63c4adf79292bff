"""URL filters: allow and block rules, and empirical-Bayes host reputation, in DataFrame functions only.

Reputation. Labelled pages give each host, registered domain and suffix its numbers of pages and of bad ones. The rate of a suffix
is drawn from a beta prior around the rate of all, a domain's around its suffix's posterior mean, a host's around its
domain's. The strength of each prior is fitted by moments: the spread of rates beyond what chance gives, but a prior isn't
stronger than the pages its mean rests on. A host's posterior is a beta distribution, and the bound is taken on it, not on a normal one:
the host is blocked if the odds of a bad page are over ``EXCESS`` times those of all with a probability of ``SURE`` or more, that is, if the
posterior's quantile at ``1 - SURE`` is over that limit. The limit lies well above the mean, so more labels make hosts of about the mean's rate surer to stay. The probability is a ratio of two sums of the density over logits.

A suffix is the last label, or the last two where ``SUFFIXES`` has them; the registered domain has one label more. Ports and what stands before
an @ count for the rules' host, not for reputation. IPv4 addresses, bracketed hosts and hosts of one label are domains of their own.

Null urls and those without ``://`` have an empty host and path, and are judged as one host. Hosts that were never
labelled have their prior. Pages with two labels count twice, labels of unknown pages and null ones not at all; repeated pages come out as often
as they stand. Without labels the method blocks nothing. Other columns are ignored; an empty table of pages gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's (fixed values).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Suffixes of two labels under which anyone can register (common ones; a parameter).
SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.kr", "co.nz", "co.za", "co.in", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "com.ar"]
EXCESS, SURE = 3.0, 0.9
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0
#: Steps on each side of the limit over which a posterior is summed up.
STEPS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """pages with host and path, and the site, domain and suffix that reputation goes by."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    out = pages.withColumn("host", F.translate(raw, UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))
    out = out.withColumn("site", F.regexp_replace(F.substring_index("host", "@", -1), ":[0-9]*$", ""))
    own = F.col("site").rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[") | ~F.col("site").contains(".")
    last = F.substring_index("site", ".", -2)
    two = last.isin(suffixes)
    return out.withColumn("suffix", F.when(own, "").when(two, last).otherwise(F.substring_index("site", ".", -1))).withColumn("domain", F.when(own, F.col("site")).when(two, F.substring_index("site", ".", -3)).otherwise(last))


def rule_of(rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null; of equal length the first by text."""
    found = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(level: DataFrame, k: str, n: str, rate: Column) -> DataFrame:
    """One row: the moment estimate of the strength of a level's prior around ``rate``, over its groups with labelled pages."""
    one = level.filter(F.col(n) > 0).select(F.col(k).alias("k"), F.col(n).alias("n"), rate.alias("r"))
    sums = one.agg(F.sum(F.pow(F.col("k") / F.col("n") - F.col("r"), 2) * F.col("n")).alias("spread"), F.sum(F.expr("r * (1 - r)")).alias("chance"), F.sum(F.expr("r * (1 - r) * n")).alias("inner"))
    extra = F.col("spread") - F.col("chance")
    value = F.when(extra * (STRONGEST + 1) <= F.col("inner"), STRONGEST).otherwise(F.col("inner") / extra - 1)
    return sums.select(F.coalesce(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), value)), F.lit(WEAKEST)).alias("m"))


def sure_over(a: Column, b: Column, limit: Column) -> Column:
    """Probability that a number from the beta distribution (a, b) is over the limit, which lies between 0 and 1.

    In logits the density is exp(a * s) / (1 + exp(s)) ** (a + b): one smooth peak at ln(a / b). It is summed at midpoints on both sides of the limit,
    as far as the peak's spread and the slopes of its tails reach.
    """
    spread = 8 * F.sqrt(1 / a + 1 / b)
    peak = F.log(a / b)
    at = F.log(limit / (1 - limit))
    log = lambda s: a * s - (a + b) * (F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s))))
    top = log(peak)

    def half(start: Column, end: Column) -> Column:
        step = (end - start) / STEPS
        total = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), lambda acc, i: acc + F.exp(log(start + (i - 0.5) * step) - top))
        return total * step

    low, high = half(F.least(peak, at) - spread - 12 / a, at), half(at, F.greatest(peak, at) + spread + 12 / b)
    return high / (low + high)


def reputation(pages: DataFrame, labels: DataFrame, excess: float = EXCESS) -> DataFrame:
    """(site, bad_mean, bad_sure) of every site of pages (page_id, site, domain, suffix); labels: (page_id, bad).

    bad_mean: posterior mean of its bad rate; bad_sure: probability that its odds are over ``excess`` times those of all.
    """
    marks = pages.join(labels.filter("bad is not null"), "page_id", "left").groupBy("site", "domain", "suffix").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    marks = stored(marks)
    domains = marks.groupBy("domain", "suffix").agg(F.sum("n").alias("n_domain"), F.sum("k").alias("k_domain"))
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n_domain").alias("n_suffix"), F.sum("k_domain").alias("k_suffix")))
    total = suffixes.agg(F.sum("n_suffix"), F.sum("k_suffix")).first()
    n_all, k_all = int(total[0] or 0), int(total[1] or 0)
    rate = k_all / n_all if n_all else 0.0
    domains = stored(domains.join(suffixes, "suffix"))
    sites = marks.join(domains.select("domain", "suffix", "n_domain", "k_domain"), ["domain", "suffix"])
    levels = [(suffixes, "k_suffix", "n_suffix", F.lit(rate)), (domains, "k_domain", "n_domain", F.expr("k_suffix / n_suffix")), (sites, "k", "n", F.expr("k_domain / n_domain"))]
    rows = [_strength(*level).select(F.lit(i).alias("i"), "m") for i, level in enumerate(levels)]
    fit = dict(rows[0].unionAll(rows[1]).unionAll(rows[2]).collect())  # three numbers
    # a prior isn't surer than what its parent's mean rests on
    weight = lambda i, known: F.greatest(F.lit(1e-3), F.least(F.lit(float(fit[i])), known))
    post = lambda w, prior, k, n: (F.col(w) * prior + F.col(k)) / (F.col(w) + F.col(n))
    suffixes = suffixes.withColumn("w", weight(0, F.lit(float(n_all)))).select("suffix", post("w", F.lit(rate), "k_suffix", "n_suffix").alias("above"), (F.col("w") + F.col("n_suffix")).alias("known"))
    domains = domains.select("domain", "suffix", "n_domain", "k_domain").join(suffixes, "suffix").withColumn("w", weight(1, F.col("known")))
    domains = domains.select("domain", "suffix", post("w", F.col("above"), "k_domain", "n_domain").alias("above"), (F.col("w") + F.col("n_domain")).alias("known"))
    out = marks.join(domains, ["domain", "suffix"]).withColumn("w", weight(2, F.col("known"))).withColumn("bad_mean", post("w", F.col("above"), "k", "n"))
    mass = F.col("w") + F.col("n")
    limit = min(rate * excess / (1 - rate + rate * excess), 1 - 1e-6)
    sure = sure_over(F.greatest(F.lit(1e-3), F.col("bad_mean") * mass), F.greatest(F.lit(1e-3), (1 - F.col("bad_mean")) * mass), F.lit(limit)) if rate else F.lit(0.0)
    return out.select("site", "bad_mean", sure.alias("bad_sure"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, sure: float = SURE, excess: float = EXCESS) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_sure) of every row of pages (page_id, url); labels: (page_id, bad 0/1)."""
    pages = with_parts(pages.select("page_id", "url"))
    scores = stored(reputation(pages, labels.select("page_id", "bad"), excess).select("site", "bad_sure"))
    out = pages.withColumn("found", rule_of(rules)).join(scores, "site", "left")
    method = F.when(F.coalesce("bad_sure", F.lit(0.0)) >= sure, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), "bad_sure")


def _oracle() -> str:
    """The same for the query's tables and parameters, for DuckDB."""
    log = lambda s: f"(a * ({s}) - (a + b) * (greatest({s}, 0) + ln(1 + exp(-abs({s})))))"
    half = lambda lo, hi: f"list_sum(list_transform(range(1, {STEPS + 1}), lambda i: exp({log(f'{lo} + (i - 0.5) * ({hi} - {lo}) / {STEPS}')} - {log('ln(a / b)')}))) * ({hi} - {lo}) / {STEPS}"
    strength = lambda k, n, r, rows: f"(SELECT greatest({WEAKEST}, least({STRONGEST}, CASE WHEN (sum(({k} / {n} - {r}) ** 2 * {n}) - sum({r} * (1 - {r}))) * {STRONGEST + 1} <= sum({r} * (1 - {r}) * {n}) THEN {STRONGEST} ELSE sum({r} * (1 - {r}) * {n}) / (sum(({k} / {n} - {r}) ** 2 * {n}) - sum({r} * (1 - {r}))) - 1 END)) FROM {rows} WHERE {n} > 0)"
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = lambda i: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[i]}'" for v, h, p in rules)
    two = ", ".join(f"'{x}'" for x in SUFFIXES)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, regexp_replace(list_last(string_split(host, '@')), ':[0-9]*$', '') AS site FROM h),
l AS (SELECT *, string_split(site, '.') AS parts, regexp_matches(site, '^[0-9]+(\.[0-9]+){{3}}$|^\[') OR NOT contains(site, '.') AS own FROM s),
t AS (SELECT *, array_to_string(parts[-2:], '.') AS last FROM l),
p AS (SELECT page_id, host, path, site, CASE WHEN own THEN '' WHEN last IN ({two}) THEN last ELSE parts[-1] END AS suffix,
    CASE WHEN own THEN site WHEN last IN ({two}) THEN array_to_string(parts[-3:], '.') ELSE last END AS domain FROM t),
m AS (SELECT site, domain, suffix, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k
    FROM p LEFT JOIN (SELECT doc_id, greatest(1 - quality, toxic) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL) AS b ON p.page_id = b.doc_id GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n_d, sum(k) AS k_d FROM m GROUP BY ALL),
x AS (SELECT suffix, sum(n_d) AS n_s, sum(k_d) AS k_s FROM d GROUP BY ALL),
a AS (SELECT sum(n_s) AS n_a, sum(k_s) / sum(n_s) AS rate FROM x),
x1 AS (SELECT x.*, n_a, rate FROM x, a),
d1 AS (SELECT d.*, n_s, k_s / nullif(n_s, 0) AS r FROM d JOIN x ON d.suffix = x.suffix),
m1 AS (SELECT m.*, n_d, k_d / nullif(n_d, 0) AS r FROM m JOIN d ON m.domain = d.domain AND m.suffix = d.suffix),
f AS (SELECT {strength("k_s", "n_s", "rate", "x1")} AS m0, {strength("k_d", "n_d", "r", "d1")} AS m1, {strength("k", "n", "r", "m1")} AS m2),
x2 AS (SELECT suffix, rate, (w * rate + k_s) / (w + n_s) AS above, w + n_s AS known FROM (SELECT x1.*, greatest(0.001, least(m0, n_a)) AS w FROM x1, f)),
d2 AS (SELECT domain, suffix, rate, (w * above + k_d) / (w + n_d) AS above, w + n_d AS known
    FROM (SELECT d.*, rate, above, greatest(0.001, least(m1, known)) AS w FROM d JOIN x2 ON d.suffix = x2.suffix, f)),
m2 AS (SELECT site, rate, w + n AS mass, (w * above + k) / (w + n) AS mean
    FROM (SELECT m.*, rate, above, greatest(0.001, least(m2, known)) AS w FROM m JOIN d2 ON m.domain = d2.domain AND m.suffix = d2.suffix, f)),
b AS (SELECT site, greatest(0.001, mean * mass) AS a, greatest(0.001, (1 - mean) * mass) AS b, ln(rate / (1 - rate)) + ln({EXCESS}) AS lim FROM m2),
e AS (SELECT *, least(ln(a / b), lim) - 8 * sqrt(1 / a + 1 / b) - 12 / a AS lo, greatest(ln(a / b), lim) + 8 * sqrt(1 / a + 1 / b) + 12 / b AS hi FROM b),
g AS (SELECT site, {half("lo", "lim")} AS low, {half("lim", "hi")} AS high FROM e)
SELECT page_id, host, path, CASE {cases(0)} END AS rule,
  CASE {cases(1)} ELSE CASE WHEN high / (low + high) >= {SURE} THEN 'block' ELSE 'allow' END END AS verdict
FROM p JOIN g ON p.site = g.site
"""


ORACLE = _oracle()
