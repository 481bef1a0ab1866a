"""WARC records and a Merkle fixity audit of replicas.

Records are numbered in order and cut into files of a fixed number of
records, in which each has its range of bytes. For an audit each replica
builds a tree by itself: the key space is cut into ranges of BUCKET
consecutive page_ids, the same for both. A leaf holds a range's number of
records and bytes and the sums of the words of their digests (which are
those of a set with repeats, and partial aggregates: a page_id with many
records isn't gathered in one task). A node above hashes up to sixteen
children in order with their bytes, so that it stands for an ordered range
of offsets. Roots are compared, then the children of nodes that differ, and
so on down; only the records of leaves that differ are read and matched, by
page_id, then by bytes, else by rank. So a record that a replica lost or
has in addition leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import _shared

FANOUT = 16
FILE_RECORDS = FANOUT**2
BUCKET = 256  # page_ids of a leaf
DATE = "2000-01-01T00:00:00Z"
DAMAGE_EVERY = 97
END = "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A whole WARC resource record. A null url or html counts as empty, a null page_id is written as `null`, and line ends in a url as %0D and %0A."""
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.coalesce(html, F.lit(""))
    length = F.octet_length(body).cast("string")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "),
        length, F.lit(END), body, F.lit(END),
    )


def _ordered(pages: DataFrame, label: str) -> DataFrame:
    """n, page_id, length and sha256 of each record, numbered by page_id, then by digest."""
    whole = record(F.col("page_id"), F.col("url"), F.col("html"))
    thin = pages.select("page_id", whole.alias("whole")).select("page_id", F.octet_length("whole").cast("long").alias("length"), F.sha2("whole", 256).alias("sha256"))
    return _numbered(thin, label)


def _numbered(rows: DataFrame, label: str, name: str = "n") -> DataFrame:
    order = [F.col("page_id").asc_nulls_first(), "sha256"]
    return _shared.number_rows(rows.repartitionByRange(*order).sortWithinPartitions(*order), label, name)[0]


def _placed(numbered: DataFrame) -> DataFrame:
    """With the file and the offset in it, where n is a record's place among all."""
    filed = numbered.withColumn("file", F.floor(F.col("n") / FILE_RECORDS))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # one file's records at most
    return filed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def leaves(pages: DataFrame) -> DataFrame:
    """n, page_id, file, offset, length and sha256 of each record, ordered by page_id, then by digest.

    A null page_id comes first. Rows that repeat are records of their own.
    """
    return _placed(_ordered(pages, "records"))


def _rank(rows: DataFrame, n: str, *columns: str) -> DataFrame:
    """With the rank of each row among those with equal columns, whose n follow each other."""
    first = rows.groupBy(*(F.col(c).alias(f"first_{c}") for c in columns)).agg(F.min(n).alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in columns]
    return rows.join(first, same).select(*rows.columns, (F.col(n) - F.col("first")).alias("rank"))


def _pairs(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """n and m of the records of both that belong together: of equal page_ids those with the same bytes, the others by rank."""
    ours, theirs = ours.select("n", "page_id", "sha256"), theirs.select(F.col("n").alias("m"), "page_id", "sha256")

    def match(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
        other = [F.col(c).alias(f"b_{c}") for c in (*columns, "rank")]
        return a.join(b.select("m", *other), [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in (*columns, "rank")]).select("n", "m")

    equal = _shared.settle(match(_rank(ours, "n", "page_id", "sha256"), _rank(theirs, "m", "page_id", "sha256"), "page_id", "sha256"), "equal")
    left = _numbered(ours.join(equal, "n", "left_anti"), "left", "at_left")
    right = _numbered(theirs.join(equal, "m", "left_anti"), "right", "at_right")
    return equal.unionByName(match(_rank(left, "at_left", "page_id"), _rank(right, "at_right", "page_id"), "page_id"))


def lowest_bucket(*replicas: DataFrame) -> int:
    """The least range of page_ids that any of the replicas' records is in; 0 where there are none."""
    least = [r.agg(F.min(F.floor(F.col("page_id") / BUCKET)).alias("least")).first()["least"] for r in replicas]
    return min((x for x in least if x is not None), default=0)


def _in_bucket(records: DataFrame, lowest: int) -> DataFrame:
    """With the leaf that each record is in; those without page_id are in the first."""
    return records.withColumn("bucket", F.coalesce(F.floor(F.col("page_id") / BUCKET) - lowest + 1, F.lit(0)).cast("long"))


def tree(records: DataFrame, lowest: int) -> list[DataFrame]:
    """The levels (n, bytes, hash) of one replica, from below; the last has the root alone. No rows for no records. Takes page_id, length, sha256."""
    words = [F.sum(F.conv(F.substring("sha256", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(8)]
    summed = _in_bucket(records, lowest).groupBy(F.col("bucket").alias("n")).agg(F.count("*").alias("records"), F.sum("length").alias("bytes"), *words)
    own = F.sha2(F.concat_ws("|", "records", "bytes", *(f"w{i}" for i in range(8))), 256)
    levels = [_shared.settle(summed.select("n", "bytes", own.alias("hash")), "leaves")]
    while levels[-1].limit(2).count() > 1 or (top := levels[-1].first()) and top["n"] > 0:
        children = F.array_sort(F.collect_list(F.struct("n", "bytes", "hash")))
        joined = F.array_join(F.transform(children, lambda x: F.concat_ws("|", x["n"], x["bytes"], x["hash"])), ";")
        above = levels[-1].groupBy(F.floor(F.col("n") / FANOUT).alias("n")).agg(F.sum("bytes").alias("bytes"), F.sha2(joined, 256).alias("hash"))
        levels.append(_shared.settle(above, f"level{len(levels)}"))
    return levels


def differing(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """n of the leaves in which two trees differ, by descending from the roots."""
    top = max(len(ours), len(theirs)) - 1
    suspects = None
    for level in range(top, -1, -1):
        a, b = (t[level] if level < len(t) else None for t in (ours, theirs))
        if a is None or b is None:  # one tree is lower: everything is suspect down to its top
            continue
        if suspects is not None:
            parent = F.floor(F.col("n") / FANOUT)
            a, b = (x.withColumn("parent", parent).join(suspects.withColumnRenamed("n", "parent"), "parent", "left_semi") for x in (a, b))
        a, b = a.select("n", F.col("hash").alias("a")), b.select("n", F.col("hash").alias("b"))
        suspects = _shared.settle(a.join(b, "n", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("n"), f"suspects{level}")
    return suspects


def suspect_records(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of either replica in leaves that differ, which are all that need be compared."""
    lowest = lowest_bucket(ours, theirs)
    found = differing(tree(ours, lowest), tree(theirs, lowest)).select(F.col("n").alias("bucket"))
    return tuple(_in_bucket(r, lowest).join(found, "bucket", "left_semi").drop("bucket") for r in (ours, theirs))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each record of either replica: page_id, file, offset, length, sha256, replica_sha256, status.

    Status is intact, damaged, moved (the same bytes at another place in the
    file, after a record of another length or one that is missing), missing
    (in the replica) or extra. An extra record has its file and offset in the
    replica by itself, and doesn't move others. Only records in leaves that
    the trees show to differ, and those behind them in their file, are other
    than intact. Empty tables give an empty result; a null page_id, repeated
    rows, very long pages (records are hashed whole) and line ends in urls
    are records like others; columns beside page_id, url and html don't
    matter.
    """
    ours, theirs = _ordered(primary, "records"), _ordered(replica, "replica")
    suspects, others = (_shared.settle(x, "suspects") for x in suspect_records(ours, theirs))
    pairs = _shared.settle(_pairs(suspects, others), "pairs")
    matched = pairs.join(others.select(F.col("n").alias("m"), F.col("length").alias("their_length"), F.col("sha256").alias("their_sha256")), "m").drop("m")
    seen = _shared.settle(suspects.select("n").join(matched, "n", "left").withColumn("suspect", F.lit(True)), "seen")
    sides = _placed(ours).join(seen, "n", "left")
    theirs_here = F.when(F.col("suspect"), F.coalesce("their_length", F.lit(0))).otherwise(F.col("length"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # one file's records at most
    sides = sides.withColumns({"there": F.coalesce(F.sum(theirs_here).over(before), F.lit(0)), "replica_sha256": F.when(F.col("suspect"), F.col("their_sha256")).otherwise(F.col("sha256"))})
    status = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("sha256") != F.col("replica_sha256"), "damaged").when(F.col("offset") != F.col("there"), "moved").otherwise("intact")
    names = ["page_id", "file", "offset", "length"]
    gained = others.select("n").join(pairs.select(F.col("m").alias("n")), "n", "left_anti")
    extra = _placed(theirs).join(gained, "n", "left_semi")
    added = extra.select(*names, F.lit(None).cast("string").alias("sha256"), F.col("sha256").alias("replica_sha256"), F.lit("extra").alias("status"))
    return sides.select(*names, "sha256", "replica_sha256", status.alias("status")).unionByName(added)


def write_warc(pages: DataFrame, path: str) -> None:
    """Write files of FILE_RECORDS records each, one folder a file, in record order."""
    whole = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", whole.alias("whole")).withColumn("sha256", F.sha2("whole", 256))
    order = [F.col("page_id").asc_nulls_first(), "sha256"]
    numbered, _ = _shared.number_rows(rows.repartitionByRange(*order).sortWithinPartitions(*order), "whole")
    # The writer ends each line with what ends a record.
    lines = numbered.select(F.floor(F.col("n") / FILE_RECORDS).alias("file"), "n", F.expr(f"substring(whole, 1, length(whole) - {len(END)})").alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").option("lineSep", END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, page_id, url, html of every record under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, at = [], 0
                while at < len(data):
                    stop = data.index(b"\r\n\r\n", at)
                    head = dict(line.split(b": ", 1) for line in data[at:stop].split(b"\r\n")[1:])
                    body = stop + 4
                    end = body + int(head[b"Content-Length"])
                    page = head[b"WARC-Record-ID"][len(b"<urn:page:") : -1]
                    rows.append((file, at, end + 4 - at, None if page == b"null" else int(page), head[b"WARC-Target-URI"].decode(), data[body:end].decode()))
                    at = end + 4
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "offset", "length", "page_id", "url", "html"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    named = files.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file"), "content")
    return named.mapInArrow(run, "file bigint, offset bigint, length bigint, page_id bigint, url string, html string")


def with_damage(pages: DataFrame, every: int = DAMAGE_EVERY) -> DataFrame:
    """A replica of which one record in `every` has the character in its middle replaced: a known case for the audit."""
    middle = F.floor(F.length("html") / 2).cast("int")
    hurt = F.concat(F.substring("html", F.lit(1), middle), F.lit("#"), F.substring("html", middle + 2, F.length("html")))
    return pages.withColumn("html", F.when((F.col("page_id") % every == 0) & (F.length("html") > 0), hurt).otherwise(F.col("html")))


def op7_warc_fixity(spark, sf_dir: str) -> DataFrame:
    pages = _shared.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, with_damage(pages))


def _sql_record(html: str) -> str:
    body = f"coalesce({html}, '')"
    return (
        "'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'null') || '>' || e || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || e || "
        f"'WARC-Date: {DATE}' || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen({body})::VARCHAR || e || e || {body} || e || e"
    )


OP7_SQL = f"""
WITH r AS (
  SELECT page_id, {_sql_record("html")} AS a,
         {_sql_record(f"CASE WHEN page_id % {DAMAGE_EVERY} = 0 AND html <> '' THEN substring(html, 1, length(html) // 2) || '#' || substring(html, length(html) // 2 + 2) ELSE html END")} AS b
  FROM pages, (SELECT chr(13) || chr(10) AS e)
), d AS (SELECT page_id, strlen(a) AS length, strlen(b) AS replica_length, sha256(a) AS sha256, sha256(b) AS replica_sha256 FROM r),
n AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, sha256) - 1 AS n FROM d),
o AS (
  SELECT *, n // {FILE_RECORDS} AS file, coalesce(sum(length) OVER w, 0)::BIGINT AS "offset", coalesce(sum(replica_length) OVER w, 0)::BIGINT AS replica_offset
  FROM n WINDOW w AS (PARTITION BY n // {FILE_RECORDS} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT page_id, file, "offset", length::BIGINT AS length, sha256, replica_sha256,
       CASE WHEN sha256 <> replica_sha256 THEN 'damaged' WHEN "offset" <> replica_offset THEN 'moved' ELSE 'intact' END AS status
FROM o
"""
