"""URL filter: rules first, then logistic regression on hashed character n-grams
of host and path, trained from a small labelled URL table.

All of it is DataFrame expressions. Training is one row: the labelled table (at
most LABELLED rows count) is gathered with its n-grams, and full-batch gradient
descent runs as nested ``aggregate`` and ``transform`` over its arrays, which
Spark keeps in the JVM. The weights, one for each of DIM buckets, become one
array literal in a narrow scoring pass over all urls.

Defined results: a null url, or one without "://", has an empty host and path, no
rule, and the method's verdict by the intercept. Of rules of the same length the
first by text wins. Repeated rows give a row each; null ids stay null; urls of any length
count whole. Without a
labelled url of each class the method allows all. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of n-grams; labelled urls that count at most; descent steps, their size and the penalty.
DIM, LABELLED, STEPS, RATE, RIDGE = 32768, 2000, 80, 1.0, 0.002
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Names of the seed's hosts; every name is met with other prefixes, domains and
#: paths, the same ones in both classes.
BLOCKED = ("casino-palace online-casino casino-games win-casino pokerstar poker-room best-bets freebets sports-bets betting-tips buy-pills cheap-pharmacy pills-online diet-pills "
           "adult-dating adult-video adult-site xxx-movies sexy-cams porn-tube hot-porn spamhub spam-mail spammer-list link-farm content-farm farm-links ads-server ad-network adserver "
           "track-clicks tracker adtracking tracking-pixel free-money free-gifts easy-loans cheap-watches cheap-loans replica-bags jackpot lottery-win win-prizes click-bait download-crack").split()
ALLOWED = ("morning-news thornton university library history-notes weather garden-letters science-review anders recipes-kitchen museum travel-journal handbook bike-forum citynews "
           "theater heather thinking mathworld orthography northern-herald physics teresa river-stories ethics open-data retirement heron anthem gather-them tension theatre-notes "
           "thirteen thatcher whatnot tionesta athletics shelter otherwise nation-today motion handstand leather earthly intention thesaurus").split()
_PREFIXES, _DOMAINS, _PATHS = ["", "www.", "blog.", "m."], ["example.com", "example.net", "example.org"], "/en/12 /fr/7?page=2 /es/33.html /en/901/ /de/5#top /en/650 /en/818?utm_source=feed".split()


def _seed(names: list[str], label: int) -> list[tuple[str, int]]:
    return [(f"https://{_PREFIXES[(i + k) % 4]}{n}.{_DOMAINS[(i // 4 + k) % 3]}{_PATHS[(i // 3 + 3 * k) % 7]}", label) for k in range(2) for i, n in enumerate(names)]


#: The small labelled url table (1: block).
SEED = _seed(BLOCKED, 1) + _seed(ALLOWED, 0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    lower = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, p = text.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def buckets(host: Column, path: Column, dim: int = DIM) -> Column:
    """The distinct buckets of the 3-, 4- and 5-grams of host and path."""
    def grams(s: Column, n: int) -> Column:
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    marked = [F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit(">"), path, F.lit("<"))]
    every = F.array_distinct(F.concat(*[grams(s, n) for s in marked for n in (3, 4, 5)]))
    return F.array_sort(F.array_distinct(F.transform(every, lambda g: (F.conv(F.substring(F.md5(g.cast("binary")), 1, 7), 16, 10).cast("long") % dim).cast("int"))))


def seed_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{u}', {y})" for u, y in SEED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS seed(url, label)")


def train(labelled: DataFrame, steps: int = STEPS, bound: int = LABELLED) -> list[float]:
    """labelled (url, label) to a weight for each bucket and, last, the intercept."""
    own = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("y")).filter("url is not null and y in (0, 1)").distinct().orderBy(F.md5(F.col("url").cast("binary")), "url", "y").limit(bound)
    host, path = host_and_path(F.col("url"))
    rows = own.select(F.struct("url", "y", buckets(host, path).alias("b")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    known = rows.select("rows", F.array_sort(F.array_distinct(F.flatten(F.expr("transform(rows, r -> r.b)")))).alias("known"))
    # x: positions in known of a row's buckets; col: rows of a bucket. Rows have unit length.
    shaped = known.select(
        "known",
        F.expr("transform(rows, r -> cast(r.y as double))").alias("y"),
        F.expr("transform(rows, r -> transform(r.b, b -> cast(array_position(known, b) as int) - 1))").alias("x"),
        F.expr("transform(rows, r -> 1 / sqrt(greatest(1, size(r.b))))").alias("s"),
        F.expr("transform(known, k -> filter(transform(rows, (r, i) -> if(array_contains(r.b, k), i, -1)), i -> i >= 0))").alias("col"))
    error = "transform(x, (f, i) -> y[i] - 1 / (1 + exp(-(w.bias + s[i] * aggregate(f, 0D, (a, j) -> a + w.v[j])))))"
    step = f"""aggregate(sequence(1, {steps}), named_struct('v', transform(known, k -> 0D), 'bias', 0D),
        (w, t) -> aggregate(array({error}), w, (u, e) -> named_struct(
            'v', transform(col, (r, j) -> u.v[j] + {RATE} * (aggregate(r, 0D, (a, i) -> a + s[i] * e[i]) / size(x) * 30 - {RIDGE} * u.v[j])),
            'bias', u.bias + {RATE} * aggregate(e, 0D, (a, d) -> a + d) / size(x))))"""
    got = shaped.filter("size(y) > 0 and array_max(y) > array_min(y)").select("known", F.expr(step).alias("w")).first()
    weights = [0.0] * DIM + [0.0 if got else -1.0]
    if got:
        for k, v in zip(got["known"], got["w"]["v"]):
            weights[k] = v
        weights[DIM] = got["w"]["bias"]
    return weights


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages``
    (page_id, url); score: the method's probability of "block"."""
    weights = train(labelled if labelled is not None else seed_table(pages.sparkSession))
    w = F.from_json(F.lit(json.dumps(weights[:DIM])), "array<double>")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    found = parsed.withColumn("b", buckets(F.col("host"), F.col("path"))).withColumn("w", w)
    total = F.aggregate("b", F.lit(0.0), lambda a, j: a + F.get(F.col("w"), j))
    scored = found.withColumn("score", 1 / (1 + F.exp(-(F.lit(weights[DIM]) + total / F.sqrt(F.greatest(F.lit(1), F.size("b")))))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
