"""URL filters: rules by host and path, else logistic regression on hashed character n-grams.

The model is trained from a small labelled table of URLs. Its features are
the counts of character n-grams of host and path, hashed by a polynomial of
their code points, so that any SQL engine can compute them. Everything runs
in the JVM; only the weights, a vector of a fixed size, come to the driver.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import _shared

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BUCKETS = 1024
SIZES = (3, 4)
STRENGTH = 0.003  # of the L2 penalty
_MULTIPLIER = 263
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BLOCKED_WORDS = ("adult", "bets", "casino", "cheap", "crack", "escort", "free-win", "gamble", "hot-x", "jackpot", "lotto", "pills", "poker", "porn", "replica", "sexy", "slots", "spam", "torrent", "viagra", "warez", "xxx")
_ALLOWED_WORDS = ("archive", "city", "docs", "events", "garden", "guide", "health", "history", "journal", "library", "maps", "museum", "news", "people", "recipes", "school", "science", "shop", "sport", "travel", "weather", "wiki")
_PLAIN_HOSTS = ("thertion", "ander", "stinge", "onreth", "heitung", "lachen", "mentere", "pasoir", "ciente", "raosa", "m.athing", "www.enterly")


def labelled_urls() -> list[tuple[str, int]]:
    """The training table: (url, 1 for block or 0 for allow)."""
    rows = []
    for words, label in ((_BLOCKED_WORDS, 1), (_ALLOWED_WORDS, 0)):
        for i, word in enumerate(words):
            rows.append((f"https://{word}.example.com/en/{10 + 7 * i}", label))
            rows.append((f"http://www.{word}-{words[i - 1]}.example.org/{40 + 11 * i}.html", label))
    rows += [(f"https://{'blog.' if i % 2 else ''}{host}.example.{'org' if i % 3 else 'com'}/{'enfresde'[i % 4 * 2 :][:2]}/{90 + 131 * i}", 0) for i, host in enumerate(_PLAIN_HOSTS)]
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    before = F.regexp_extract(rest, "^[^?#]*", 0)
    host = F.regexp_extract(before, "^[^/]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.substring(before, F.length(host) + 1, F.length(before))


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def with_buckets(named: DataFrame) -> DataFrame:
    """Add `buckets`, the bucket of every n-gram of `^host^` and `$path$`. Takes host and path.

    Code points come in a projection of their own, so that they are computed once.
    """
    marked = {"_h": F.concat(F.lit("^"), "host", F.lit("^")), "_p": F.concat(F.lit("$"), "path", F.lit("$"))}
    codes = {c: F.transform(F.split(text, ""), lambda x: F.ascii(x).cast("long")) for c, text in marked.items()}
    out = named.withColumns(codes)
    grams = []
    for c in codes:
        for size in SIZES:
            starts = F.when(F.size(c) >= size, F.sequence(F.lit(0), F.size(c) - size)).otherwise(F.array().cast("array<int>"))
            grams.append(F.transform(starts, _gram_hash(F.col(c), size)))
    return out.withColumn("buckets", F.concat(*grams)).drop(*codes)


def _gram_hash(codes: Column, size: int):
    return lambda i: _poly([F.get(codes, i + j) for j in range(size)])


def _poly(codes: list[Column]) -> Column:
    value = F.lit(len(codes)).cast("long")
    for code in codes:
        value = value * _MULTIPLIER + code
    return (value % BUCKETS).cast("int")


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept from the labelled table, or another of that kind: a few hundred rows."""
    table = spark.createDataFrame([(i, url, float(label)) for i, (url, label) in enumerate(labelled or labelled_urls())], "id int, url string, label double").coalesce(1)
    host, path = split_url(F.col("url"))
    counts = with_buckets(table.select("id", "label", host.alias("host"), path.alias("path"))).select("id", "label", F.explode("buckets").alias("bucket")).groupBy("id", "label", "bucket").count()
    entries = counts.groupBy("id", "label").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("count").cast("double")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    rows = entries.orderBy("id").coalesce(1).select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=STRENGTH, standardization=False, maxIter=500, tol=1e-10).fit(rows)
    return model.coefficients.toArray(), float(model.intercept)


def judge(pages: DataFrame, rules=RULES, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score for every page.

    A null url, or one without `://`, has an empty host and path and is
    judged by the model on those. Rows stay as they are, repeats included;
    other columns don't pass; an empty table gives an empty result.
    """
    weights, intercept = model or train(pages.sparkSession)
    host, path = split_url(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_and_verdict(F.col("host"), F.col("path"), rules)
    table = F.lit([float(w) for w in weights])
    score = F.aggregate("buckets", F.lit(intercept), lambda acc, b: acc + F.get(table, b))
    scored = with_buckets(named).withColumn("score", score)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(_shared.table(spark, sf_dir, "pages")).drop("score")


# --- the same model by other means, for the SQL check ---------------------


@lru_cache(maxsize=1)
def _newton() -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method in the span of the rows: an independent fit of the same objective."""
    rows = labelled_urls()
    x = np.zeros((len(rows), BUCKETS))
    for i, (url, _) in enumerate(rows):
        rest = url.split("://", 1)[1]
        host, slash, path = rest.partition("/")
        for mark, text in (("^", host), ("$", slash + path)):
            marked = mark + text + mark
            for size in SIZES:
                for at in range(len(marked) - size + 1):
                    value = size
                    for c in marked[at : at + size]:
                        value = value * _MULTIPLIER + ord(c)
                    x[i, value % BUCKETS] += 1
    y = np.array([label for _, label in rows], float)
    n, gram = len(y), x @ x.T
    a, b = np.zeros(n), 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(gram @ a + b)))
        h = p * (1 - p) / n
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = h[:, None] * gram + STRENGTH * np.eye(n)
        system[:n, n] = h
        system[n, :n] = h @ gram
        system[n, n] = h.sum()
        step = np.linalg.solve(system, np.concatenate([(p - y) / n + STRENGTH * a, [((p - y) / n).sum()]]))
        a, b = a - step[:n], b - step[n]
    return x.T @ a, float(b)


def op3_sql() -> str:
    weights, intercept = _newton()
    literal = ", ".join(f"{w:.12g}" for w in weights)
    grams = []
    for mark, column in (("^", "host"), ("$", "path")):
        marked = f"('{mark}' || {column} || '{mark}')"
        for size in SIZES:
            value = f"{size}::BIGINT"
            for j in range(size):
                value = f"({value} * {_MULTIPLIER} + unicode(substring({marked}, i + {j}, 1)))"
            grams.append(f"list_transform(range(1, greatest(1, length({marked}) - {size - 2})), lambda i: ({value} % {BUCKETS})::INTEGER)")
    rules = sorted(RULES, key=lambda r: -len(r[1]))

    def case(pick: int) -> str:
        whens = []
        for says, text in rules:
            rule_host, _, rule_path = text.partition("/")
            whens.append(f"WHEN (host = '{rule_host}' OR ends_with(host, '.{rule_host}')) AND starts_with(path, '/{rule_path}') THEN '{(says, text)[pick]}'")
        return " ".join(whens)

    return f"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS before FROM r),
h AS (
  SELECT page_id, translate(regexp_extract(before, '^[^/]*'), '{_UPPER}', '{_LOWER}') AS host,
         substring(before, length(regexp_extract(before, '^[^/]*')) + 1) AS path FROM b
), s AS (
  SELECT page_id, host, path, {intercept!r} + coalesce(list_sum(list_transform({" || ".join(grams)}, lambda g: w[g + 1])), 0) AS score
  FROM h, (SELECT [{literal}]::DOUBLE[] AS w)
)
SELECT page_id, host, path, CASE {case(1)} END AS rule, CASE {case(0)} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict FROM s
"""
