"""Joins, sets, aggregates, windows and top-k queries over the shared tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import text as T
from quillstone.operators import evaluate, ivf, service
from quillstone.sources.tables import scratch, settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table that is scanned in fewer tasks than there are cores, dealt to all of them; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# --- joins ----------------------------------------------------------------


@query("""SELECT o.o_orderkey, o.o_orderstatus, coalesce(l.lines, 0)::BIGINT AS lines, l.last_ship FROM orders o
LEFT JOIN (SELECT l_orderkey, count(*) AS lines, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""")
def r_left_outer_task(spark, d):
    """Every order with what is known of its lines, if anything (documents with their task)."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.max("l_shipdate").alias("last_ship"))
    orders = read(spark, d, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select("o_orderkey", "o_orderstatus", F.coalesce("lines", F.lit(0)).alias("lines"), "last_ship")


@query("""SELECT c_mktsegment, l_returnflag, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def r_inner_two_branch(spark, d):
    """Lines of finished orders by the segment of who ordered."""
    orders = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    customers = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "l_returnflag").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""SELECT doc_id, sha256(text) AS digest FROM documents d WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def r_semi_dedup(spark, d):
    """Documents whose contents are known already under another id."""
    documents = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    known = documents.groupBy("digest").count().where("count > 1")
    return documents.join(known, "digest", "left_semi").select("doc_id", "digest")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def r_anti_new(spark, d):
    """Customers without any finished urgent order."""
    customers, orders = read(spark, d, "customer"), read(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select("o_custkey")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""WITH b AS (SELECT l_partkey, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS best, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1)
SELECT l_partkey, best, flags > 1 AS conflict FROM b""")
def r_theta_conflict(spark, d):
    """For each part its first flag, and whether any line says otherwise: a comparison with the first, not a self-join."""
    lines = read(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")
    grouped = lines.groupBy("l_partkey").agg(F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber")).alias("best"), F.count_distinct("l_returnflag").alias("flags"))
    return grouped.select("l_partkey", "best", (F.col("flags") > 1).alias("conflict"))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"""WITH q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS token FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS token FROM documents),
f AS (SELECT token, count(*) AS df FROM d GROUP BY 1)
SELECT item_id, count(*) AS tokens, count(df) AS known, count(*) FILTER (df = 1 AND length(q.token) >= 4) AS "distinctive" FROM q LEFT JOIN f USING (token) GROUP BY 1""")
def r_token_equi_df(spark, d):
    """Document frequency of every question's tokens, by an equality join on the token."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    asked = read(spark, d, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("token"))
    frequency = read(spark, d, "documents").select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    joined = asked.join(frequency, "token", "left")
    return joined.groupBy("item_id").agg(F.count("*").alias("tokens"), F.count("df").alias("known"), F.count_if((F.col("df") == 1) & (F.length("token") >= 4)).alias("distinctive"))


@query("""WITH k AS (SELECT o_custkey, o_orderpriority, count(*) AS n, count(DISTINCT o_orderstatus) AS v FROM orders GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT o_orderstatus) = 1)
SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority, k.n AS linked FROM orders o JOIN k USING (o_custkey, o_orderpriority)""")
def r_link_self_join(spark, d):
    """Orders linked by a shared key that at least two hold and on which all agree in status."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    keys = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("linked"), F.count_distinct("o_orderstatus").alias("values")).where("linked >= 2 AND values = 1")
    return orders.join(keys, ["o_custkey", "o_orderpriority"]).select("o_orderkey", "o_custkey", "o_orderpriority", "linked")


@query("""SELECT coalesce(a.k, b.k)::BIGINT AS k, a.k IS NULL AS unexpected, b.k IS NULL AS missing FROM (SELECT n_nationkey AS k FROM nation) a
FULL JOIN (SELECT DISTINCT c_nationkey + 3 AS k FROM customer) b ON a.k = b.k""")
def r_full_outer_registry(spark, d):
    """Registered against found keys, both ways."""
    registered = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(True).alias("a"))
    found = read(spark, d, "customer").select((F.col("c_nationkey") + 3).alias("k")).distinct().withColumn("b", F.lit(True))
    return registered.join(found, "k", "full_outer").select(F.col("k").cast("long").alias("k"), F.col("a").isNull().alias("unexpected"), F.col("b").isNull().alias("missing"))


@query("""SELECT a.event_type, a.n AS before, b.n AS after, a.n IS DISTINCT FROM b.n AS changed FROM
(SELECT event_type, count(*) AS n FROM events WHERE value < 50 GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS n FROM events WHERE value >= 50 GROUP BY 1) b USING (event_type)""")
def r_metric_comparison(spark, d):
    """Two runs side by side, metric by metric."""
    events = read(spark, d, "events")
    a = events.where("value < 50").groupBy("event_type").agg(F.count("*").alias("before"))
    b = events.where("value >= 50").groupBy("event_type").agg(F.count("*").alias("after"))
    return a.join(b, "event_type", "full_outer").select("event_type", "before", "after", (~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))


# --- filters --------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND n_chars BETWEEN 100 AND 5000 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def f_eligibility(spark, d):
    documents = read(spark, d, "documents").where("lang = 'en' AND n_chars BETWEEN 100 AND 5000").select("doc_id", "lang")
    return documents.join(read(spark, d, "labels").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi")


@query("""SELECT doc_id, CASE WHEN n_chars = 0 OR n_chars IS NULL THEN 'empty_file' WHEN n_chars > 20000 THEN 'file_too_large' WHEN lang NOT IN ('en', 'fr') THEN 'unsupported_type' END AS error_code FROM documents""")
def f_budget_codes(spark, d):
    """The first budget or type check that a document fails."""
    code = F.when(F.coalesce("n_chars", F.lit(0)) == 0, "empty_file").when(F.col("n_chars") > 20000, "file_too_large").when(~F.col("lang").isin("en", "fr"), "unsupported_type")
    return read(spark, d, "documents").select("doc_id", code.alias("error_code"))


_SQL_FOLDED = "trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
_SQL_UNSAFE = " OR ".join(f"regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')" for p in P.UNTRUSTED)


@query(f"""WITH f AS (SELECT conv_id, turn, {_SQL_FOLDED} AS t FROM conversations)
SELECT conv_id, turn, ({_SQL_UNSAFE} OR (regexp_matches(t, '{P.DISCLOSURE}') AND NOT regexp_matches(t, '{P.PROHIBITION}'))) AS unsafe FROM f""")
def f_unsafe_instruction(spark, d):
    """Which turns give instructions to whoever reads them."""
    return read(spark, d, "conversations").select("conv_id", "turn", T.untrusted(F.col("text")).alias("unsafe"))


_ROLES, _ACTIONS = (*P.ROLE_ACTIONS, "guest"), P.ROLE_ACTIONS["admin"]
_sql_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""WITH c AS (SELECT c_custkey, {_sql_list(_ROLES)}[1 + c_custkey % {len(_ROLES)}] AS role, {_sql_list(_ACTIONS)}[1 + c_nationkey % {len(_ACTIONS)}] AS action FROM customer)
SELECT c_custkey, role, action FROM c WHERE (role, action) IN (VALUES """ + ", ".join(f"('{r}', '{a}')" for r, actions in P.ROLE_ACTIONS.items() for a in actions) + ")")
def f_role_actions(spark, d):
    """Customers as principals of some role who may do what they ask for."""
    pick = lambda values, key: F.element_at(F.lit(list(values)), (F.col(key) % len(values) + 1).cast("int"))
    asked = read(spark, d, "customer").select("c_custkey", pick(_ROLES, "c_custkey").alias("role"), pick(_ACTIONS, "c_nationkey").alias("action"))
    return service.allowed(asked, F.col("action"))


# --- aggregates -----------------------------------------------------------


@query("""SELECT s AS status, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(s) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) ON s = o_orderstatus""")
def a_status_zero_fill(spark, d):
    domain = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string")
    counts = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return domain.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH p AS (SELECT lang, quality, n_chars > 1000 AS predicted FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (predicted AND quality = 1) AS tp, count(*) FILTER (predicted) AS predicted, count(*) FILTER (quality = 1) AS gold FROM p GROUP BY 1),
r AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS p, CASE WHEN gold = 0 THEN 0.0 ELSE tp / gold END AS r FROM c)
SELECT lang, tp, predicted, gold, round(p, 6)::DOUBLE AS "precision", round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM r""")
def a_prf_micro(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).alias("said")).join(read(spark, d, "labels"), "doc_id")
    right = F.col("quality") == 1
    counts = rows.groupBy("lang").agg(F.count_if(F.col("said") & right).alias("tp"), F.count_if("said").alias("predicted"), F.count_if(right).alias("gold"))
    p, r = evaluate.ratio(F.col("tp"), F.col("predicted")), evaluate.ratio(F.col("tp"), F.col("gold"))
    return counts.select("lang", "tp", "predicted", "gold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(evaluate.f1(p, r), 6).alias("f1"))


@query("""SELECT event_type, round(median(value), 6) AS median_value, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1""")
def a_median_p95(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"), evaluate.nearest_rank(F.col("value"), 0.95).alias("p95"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_discount, l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM r WHERE n = 1""")
def a_lex_argmax(spark, d):
    """The best row of each group by several criteria, as one aggregate."""
    key = F.struct(-F.col("l_quantity"), "l_discount", "l_orderkey", "l_linenumber")
    best = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min_by(F.struct("l_orderkey", "l_linenumber", "l_quantity"), key).alias("b"))
    return best.select("l_suppkey", "b.*")


@query("""WITH m AS (SELECT event_type, round(avg(value), 6) AS a, round(count(*) / 100.0, 6) AS b FROM events GROUP BY 1), w AS (SELECT event_type, least(a, b) AS worst FROM m)
SELECT event_type, worst FROM w WHERE worst = (SELECT max(worst) FROM w)""")
def a_maximin(spark, d):
    """The option whose worst metric is best."""
    metrics = read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("a"), F.round(F.count("*") / 100.0, 6).alias("b"))
    return evaluate.select_best(metrics.withColumnRenamed("event_type", "configuration"), ["a", "b"], []).select(F.col("configuration").alias("event_type"), "worst")


@query("""WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS path FROM f GROUP BY 1""")
def a_ordered_distinct(spark, d):
    """Distinct values in order of first appearance; as many as there are kinds."""
    first = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    listed = first.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("at", "event_type"))).alias("x"))
    return listed.select("user_id", F.array_join(F.transform("x", lambda e: e["event_type"]), ">").alias("path"))


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY ALL""")
def a_latest_identity(spark, d):
    """The newest record of each identity."""
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("""SELECT (doc_id // 500)::BIGINT AS block, count(*) AS n, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1""")
def a_digest(spark, d):
    """One digest for each block of 500 ids, in order of id."""
    rows = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    grouped = rows.groupBy(F.floor(F.col("doc_id") / 500).alias("block")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("doc_id", "digest"))).alias("x"))
    return grouped.select("block", "n", F.sha2(F.array_join(F.transform("x", lambda e: e["digest"]), ""), 256).alias("digest"))


@query("""SELECT event_type, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def a_labelled_counters(spark, d):
    bucket = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high")
    return read(spark, d, "events").groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))


# --- windows and top-k ----------------------------------------------------


@query("""WITH t AS (SELECT c.c_custkey, c_nationkey, c_acctbal, round(sum(o_totalprice), 2) AS spent FROM customer c LEFT JOIN orders o ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS a, CASE WHEN spent IS NOT NULL THEN row_number() OVER (PARTITION BY c_nationkey, spent IS NULL ORDER BY spent DESC, c_custkey) END AS b FROM t),
s AS (SELECT *, round(CASE WHEN b IS NULL THEN 1.0::DOUBLE / (60 + a) ELSE (1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b)) / 2 END, 8) AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_acctbal DESC, c_custkey) AS place FROM s)
SELECT c_nationkey, place, c_custkey, score FROM k WHERE place <= 20""")
def w_rrf(spark, d):
    """Reciprocal-rank fusion of two orders, of which the second doesn't rank everything."""
    spent = read(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = read(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    a = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    b = F.row_number().over(Window.partitionBy("c_nationkey", F.col("spent").isNull()).orderBy(F.desc("spent"), "c_custkey"))
    ranked = rows.withColumn("a", a).withColumn("b", F.when(F.col("spent").isNotNull(), b))
    one, two = 1 / (P.RRF_K + F.col("a")), 1 / (P.RRF_K + F.col("b"))
    scored = ranked.withColumn("score", F.round(F.when(F.col("b").isNull(), one).otherwise((one + two) / 2), 8))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("score"), F.desc("c_acctbal"), "c_custkey"))
    return scored.withColumn("place", place.cast("long")).where("place <= 20").select("c_nationkey", "place", "c_custkey", "score")


@query("""WITH a AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS fresh FROM conversations),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM a)
SELECT conv_id, island::BIGINT AS island, min(role) AS role, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM b GROUP BY ALL""")
def w_islands(spark, d):
    """Runs of turns by one role."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    fresh = (~F.col("role").eqNullSafe(F.lag("role").over(order))) | (F.row_number().over(order) == 1)
    rows = read(spark, d, "conversations").withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order))
    return rows.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_purchase, round(sum(value) OVER w, 4) AS running FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w_carry(spark, d):
    """The last value carried on, and a running sum."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return read(spark, d, "events").select("event_id", "user_id", carried.alias("last_purchase"), F.round(F.sum("value").over(w), 4).alias("running"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def w_rate_window(spark, d):
    """Events of a user in the hour up to each event, that one included."""
    w = Window.partitionBy("user_id").orderBy("micros").rangeBetween(-3_600_000_000, 0)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").withColumn("micros", micros).select("event_id", F.count("*").over(w).alias("recent"))


@query("""WITH r AS (SELECT d.source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, quality = 0 AS hit FROM documents d JOIN labels USING (doc_id)),
f AS (SELECT source, min(CASE WHEN hit AND place <= 5 THEN place END) AS first FROM r GROUP BY 1) SELECT count(*) AS sources, round(count(first) / count(*), 6)::DOUBLE AS recall, round(sum(coalesce(1.0 / first, 0)) / count(*), 6)::DOUBLE AS mrr FROM f""")
def w_first_rank_mrr(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source", "n_chars").join(read(spark, d, "labels"), "doc_id")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    first = ranked.groupBy("source").agg(F.min(F.when((F.col("quality") == 0) & (F.col("place") <= 5), F.col("place"))).alias("first"))
    return first.agg(F.count("*").alias("sources"), F.round(evaluate.ratio(F.count("first"), F.count("*")), 6).alias("recall"), F.round(evaluate.ratio(F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))), F.count("*")), 6).alias("mrr"))


@query("""WITH q AS (SELECT label, arg_min(embedding, vec_id) AS v, min(vec_id) AS q FROM embeddings GROUP BY 1),
s AS (SELECT q.label, e.vec_id, round(list_cosine_similarity(q.v::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e WHERE e.vec_id <> q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM s) SELECT label, place, vec_id, score FROM r WHERE place <= 20""")
def t_knn_cosine(spark, d):
    """The nearest to the first vector of each label, one query a label, by cosine over all vectors."""
    from quillstone.functions import vectors as V

    rows = read(spark, d, "embeddings")
    asked = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"), F.min("vec_id").alias("q_id"))
    labels = asked.count()
    if labels > 1000:
        raise ValueError("too many labels to broadcast")
    pairs = rows.drop("label").join(F.broadcast(asked), F.col("vec_id") != F.col("q_id"))
    score = F.round(V.dot(F.col("embedding"), F.col("q")) / (V.norm(F.col("embedding")) * V.norm(F.col("q"))), 6)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("score", score).withColumn("place", place.cast("long")).where("place <= 20").select("label", "place", "vec_id", "score")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS m FROM a WHERE n <= 20) SELECT o_orderpriority, m AS place, o_orderkey FROM b WHERE m <= 5""")
def t_rerank_window(spark, d):
    """Four times as many candidates as wanted, ordered anew."""
    first = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    again = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey"))
    window = read(spark, d, "orders").withColumn("n", first).where("n <= 20")
    return window.withColumn("place", again.cast("long")).where("place <= 5").select("o_orderpriority", "place", "o_orderkey")


@query()
def t_knn_ivf(spark, d):
    """About the 20 nearest by cosine of every twentieth vector, by inverted lists over all vectors."""
    units = settle(ivf.usable(read(spark, d, "embeddings")), "units")
    centroids = ivf.train(units)
    index = settle(ivf.build(units, centroids), "lists")
    queries = units.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return ivf.search(queries, index, units, centroids)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def t_newest_events(spark, d):
    """The newest 200 events."""
    return read(spark, d, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


# --- sets -----------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def s_union_dedup(spark, d):
    return read(spark, d, "documents").where("lang = 'fr'").select("doc_id").union(read(spark, d, "labels").where("toxic = 1").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents WHERE lang = 'fr' INTERSECT SELECT doc_id FROM labels")
def s_intersect(spark, d):
    return read(spark, d, "documents").where("lang = 'fr'").select("doc_id").intersect(read(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def s_except(spark, d):
    return read(spark, d, "documents").select("doc_id").exceptAll(read(spark, d, "labels").select("doc_id").distinct()).distinct()


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def s_duplicate_keys(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


# --- writes ---------------------------------------------------------------


@query("""WITH u AS (SELECT 'user' || c_custkey AS username, 'h' || c_nationkey AS password_hash, CASE WHEN c_custkey % 2 = 0 THEN 'reader' ELSE 'analyst' END AS role, c_acctbal >= 0 AS is_active FROM customer),
n AS (SELECT 'user' || o_custkey * 2 AS username, 'n' || count(*) AS password_hash, CASE WHEN count(*) > 12 THEN NULL WHEN count(*) > 8 THEN 'admin' ELSE 'analyst' END AS role FROM orders GROUP BY o_custkey)
SELECT coalesce(u.username, n.username) AS username, coalesce(n.password_hash, u.password_hash) AS password_hash, coalesce(n.role, u.role) AS role, CASE WHEN n.username IS NOT NULL THEN n.role IS NOT NULL ELSE u.is_active END AS is_active
FROM u FULL JOIN n ON u.username = n.username WHERE u.role IS NOT NULL OR n.role IS NOT NULL""")
def k_upsert_users(spark, d):
    """Users inserted, refreshed or deactivated, written as a table and read again."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    users = read(spark, d, "customer").select(text("user", F.col("c_custkey")).alias("username"), text("h", F.col("c_nationkey")).alias("password_hash"), F.when(F.col("c_custkey") % 2 == 0, "reader").otherwise("analyst").alias("role"), (F.col("c_acctbal") >= 0).alias("is_active"))
    n = F.count("*")
    named = read(spark, d, "orders").groupBy("o_custkey").agg(text("n", n).alias("password_hash"), F.when(n > 12, F.lit(None)).when(n > 8, "admin").otherwise("analyst").alias("role")).withColumn("username", text("user", F.col("o_custkey") * 2))
    folder = scratch(spark, "users")
    service.upsert_users(users, named).write.parquet(folder)
    return spark.read.parquet(folder)


@query("""WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'document' AS kind, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM g) THEN 'deleted' ELSE 'completed' END AS status FROM documents
UNION ALL SELECT 'task', doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id IN (SELECT doc_id FROM g) THEN 'failed' WHEN doc_id % 3 = 0 THEN 'completed' ELSE 'queued' END FROM documents
UNION ALL SELECT 'chunk', doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)""")
def k_soft_delete(spark, d):
    """Documents that are withdrawn keep their row, their open task fails, and what was derived from them goes: all three tables afterwards."""
    at, never = F.lit("2026-01-01").cast("timestamp"), F.lit(None).cast("timestamp")
    ids = read(spark, d, "documents").select("doc_id")
    documents = ids.select(F.col("doc_id").alias("id"), F.lit("completed").alias("status"), never.alias("deleted_at"))
    tasks = ids.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, "completed").otherwise("queued").alias("status"), F.lit(None).cast("string").alias("error_code"), never.alias("completed_at"))
    chunks = ids.select(F.col("doc_id").alias("document_id"))
    after = service.soft_delete(documents, tasks, {"chunks": chunks}, read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id")), at)
    rows = after["documents"].select(F.lit("document").alias("kind"), F.col("id").alias("doc_id"), "status")
    rows = rows.unionByName(after["tasks"].select(F.lit("task").alias("kind"), F.col("document_id").alias("doc_id"), "status"))
    return rows.unionByName(after["chunks"].select(F.lit("chunk").alias("kind"), F.col("document_id").alias("doc_id"), F.lit(None).cast("string").alias("status")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def k_insert_new(spark, d):
    """An insert that is run twice: only what isn't there yet is appended."""
    there = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    rows = read(spark, d, "customer").where("c_custkey % 2 = 1").select("c_custkey", "c_name")
    first = service.insert_new(there, rows, ["c_custkey"])
    return first.unionByName(service.insert_new(there.unionByName(first.select("c_custkey")), rows, ["c_custkey"]))


@query("""SELECT event_id, map_from_entries(list_filter(map_entries(MAP {'k': json_extract_string(props, '$.k'), 'seed': event_type, 'value': value::VARCHAR}), lambda e: e.key <> 'seed'))['k'] AS k, 2::INTEGER AS kept FROM events""")
def k_run_record(spark, d):
    """What a run's record keeps of its result: not what is a column of its own."""
    result = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("seed"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"))
    rows = read(spark, d, "events").select("event_id", service.run_record(result).alias("m"))
    return rows.select("event_id", F.element_at("m", "k").alias("k"), F.size("m").alias("kept"))


@query("""SELECT o_orderkey AS id, o_custkey AS dossier_id, o_orderdate AS created_at FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderstatus <> 'F'""")
def v_listing(spark, d):
    """One dossier's documents that aren't deleted, newest first."""
    first = read(spark, d, "orders").agg(F.min("o_custkey")).first()[0]
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dossier_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return service.listing(rows, first).drop("deleted_at")


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'auto')""")
def v_search(spark, d):
    return service.search(read(spark, d, "customer"), ["c_name", "c_mktsegment"], " Auto ").select("c_custkey", "c_name")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS completed, bool_or(o_orderstatus = 'O') AS pending FROM orders""")
def v_progress(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return service.progress(read(spark, d, "orders").select(status.alias("status")))


@query("""SELECT l_orderkey, l_linenumber, replace(format('{:.1f}', l_discount * 100), '.', ',') || ' %' AS shown, CASE WHEN l_discount >= 0.05 THEN 'at or above' ELSE 'below' END AS label FROM lineitem""")
def v_display(spark, d):
    """Shares as they are shown, and on which side of a threshold they are."""
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", service.percentage(F.col("l_discount"), "not measured").alias("shown"), service.threshold_label(F.col("l_discount"), 0.05).alias("label"))


@query("""SELECT c_custkey, 0 AS place FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_nationkey < 5 AND c_mktsegment <> 'BUILDING'""")
def v_upsert_first(spark, d):
    """New rows before the others, each key once."""
    rows = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return service.upsert_first(rows.where("c_nationkey < 5"), rows.where("c_mktsegment = 'BUILDING'"), "c_custkey").select("c_custkey", "place")


@query("""SELECT event_id AS document_id, 'k' AS field, json_extract_string(props, '$.k') AS value, '[]' AS citations FROM events WHERE event_type = 'purchase'""")
def v_field_rows(spark, d):
    """Payload entries that are fields, one row each; others go."""
    k = F.get_json_object("props", "$.k")
    field = F.concat(F.lit('{"k":{"value":'), k, F.lit(',"citations":'), F.when(F.col("event_type") == "purchase", "[]").otherwise('"none"'), F.lit('},"other":{"value":1}}'))
    return service.field_rows(read(spark, d, "events").select(F.col("event_id").alias("document_id"), field.alias("payload")))


@query("""SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events""")
def x_json_project(spark, d):
    return read(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))
