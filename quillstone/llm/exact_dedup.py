"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Each block gets an
integer name, adjacent names are paired and each pair gets a name in turn,
level by level, until one name is left for the whole document. Together with
the document's length in bytes that name is its identity.

A name is the 64-bit key of a block's (or pair's) contents plus its rank in
sort order among different contents with that key. Keys are computed where
the row is, for all levels at once; one aggregation over the distinct
contents of every level then shows which keys stand for more than one
content. None do, as a rule, and all ranks are zero. Where some do, names of
the documents concerned are assigned level by level from the sorted contents.
So identities are free of collisions whatever the texts are, while whole
texts move once, already reduced to distinct blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import _shared

BLOCK_BYTES = 1024
_PAD = -1


def _key(*parts: Column, bits: int) -> Column:
    """The 64-bit key of some contents; fewer bits only serve tests of collisions."""
    key = F.xxhash64(*parts)
    return key if bits == 64 else F.pmod(key, F.lit(1 << bits))


def _pairs(names: Column) -> Column:
    """Adjacent names as structs; the odd one at the end is paired with a pad."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(names) - 1) / 2).cast("int")),
        lambda i: F.struct(
            F.get(names, i * 2).alias("a"),
            F.coalesce(F.get(names, i * 2 + 1), F.lit(_PAD).cast("long")).alias("b"),
        ),
    )


def _blocks(data: Column, block_bytes: int) -> Column:
    count = F.greatest(F.lit(1), F.ceil(F.length(data) / block_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _levels(count: Column) -> Column:
    """How often names must be paired until one is left of `count`."""
    return F.ceil(F.log2(count.cast("double"))).cast("int")


def _climb(names: Column, levels: Column, bits: int) -> Column:
    """The one name that is left when all ranks are zero."""
    climbed = F.aggregate(
        F.sequence(F.lit(1), F.greatest(levels, F.lit(1))),
        names,
        lambda acc, _: F.when(F.size(acc) == 1, acc).otherwise(F.transform(_pairs(acc), lambda p: _key(p["a"], p["b"], bits=bits))),
    )
    return F.get(climbed, F.lit(0))


def _all_pairs(names: Column, levels: Column, bits: int) -> Column:
    """The pairs of every level with the level's number, for the check of keys."""
    pair = "struct<level:int,a:bigint,b:bigint>"
    state = F.struct(names.alias("names"), F.array().cast(f"array<{pair}>").alias("seen"))

    def up(acc: Column, level: Column) -> Column:
        pairs = _pairs(acc["names"])
        return F.when(F.size(acc["names"]) == 1, acc).otherwise(
            F.struct(
                F.transform(pairs, lambda p: _key(p["a"], p["b"], bits=bits)).alias("names"),
                F.concat(acc["seen"], F.transform(pairs, lambda p: F.struct(level.alias("level"), p["a"].alias("a"), p["b"].alias("b")))).alias("seen"),
            )
        )

    return F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), state, up)["seen"]


def _ambiguous(contents: DataFrame, *columns: str) -> DataFrame:
    """Keys (level, key) that stand for more than one content."""
    return contents.select("level", "key", *columns).distinct().groupBy("level", "key").count().where("count > 1").select("level", "key")


def _ranked(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Distinct contents under ambiguous keys, numbered in sort order within each key."""
    found = rows.join(keys, "key", "left_semi").select("key", *columns).distinct()
    # An ambiguous key holds a handful of contents: sorting them is a small window.
    order = F.row_number().over(Window.partitionBy("key").orderBy(*columns)) - 1
    return found.withColumn("rank", order.cast("long"))


def _by_rank(data: DataFrame, block_bytes: int, bits: int) -> DataFrame:
    """Identities by explicit naming, level by level, for when keys collide.

    Names are pairs (key, rank) here, so no two contents share one.
    """
    blocks = data.select("row", "n_bytes", F.posexplode(_blocks(F.col("data"), block_bytes)).alias("pos", "content"))
    rows = blocks.withColumn("key", _key(F.col("content"), bits=bits))
    done = None
    level = 0
    columns = ("content",)
    while True:
        clash = rows.select(F.lit(level).alias("level"), "key", *columns)
        keys = _shared.settle(_ambiguous(clash, *columns).select("key"), f"clash{level}")
        ranks = _shared.settle(_ranked(rows, keys, *columns), f"ranks{level}")
        condition = rows["key"] == ranks["key"]
        for c in columns:
            condition = condition & (rows[c] == ranks[c])
        named = rows.join(ranks, condition, "left").select(
            rows["row"], rows["n_bytes"], rows["pos"], rows["key"], F.coalesce(ranks["rank"], F.lit(0)).cast("long").alias("rank")
        )
        named = _shared.settle(named, f"names{level}")
        width = block_bytes << level
        last = F.col("n_bytes") <= width
        ready = named.where(last).select("row", "n_bytes", F.col("key").alias("name"), "rank")
        done = ready if done is None else done.unionByName(ready)
        rest = named.where(~last)
        if rest.isEmpty():
            return done
        even = (F.col("pos") % 2) == 0
        grouped = rest.groupBy("row", "n_bytes", F.floor(F.col("pos") / 2).alias("pos")).agg(
            *(F.max(F.when(even if side == "a" else ~even, F.col(c))).alias(f"{side}{c[0]}") for side in "ab" for c in ("key", "rank"))
        )
        columns = ("ak", "ar", "bk", "br")
        rows = grouped.fillna(_PAD, subset=["bk", "br"]).withColumn("key", _key(*map(F.col, columns), bits=bits))
        level += 1


def identities(documents: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_bytes, name, rank, text_sha256.

    (n_bytes, name, rank) is the same for two documents exactly if their
    texts are the same bytes. A null text counts as empty. The frame is
    settled in the shared folder.
    """
    data = _shared.text_or_empty().cast("binary")
    base = documents.select("doc_id", data.alias("data"))
    names = F.transform(_blocks(F.col("data"), block_bytes), lambda b: _key(b, bits=key_bits))
    levels = _levels(F.size("names"))
    contents = base.select(F.explode(_blocks(F.col("data"), block_bytes)).alias("content")).select(F.lit(0).alias("level"), _key(F.col("content"), bits=key_bits).alias("key"), "content")
    thin = base.select(
        "doc_id", F.length("data").alias("n_bytes"), names.alias("names"), F.sha2("data", 256).alias("text_sha256")
    )
    thin = _shared.settle(thin, "blocks")
    pairs = thin.select(F.explode(_all_pairs(F.col("names"), levels, key_bits)).alias("p")).select("p.*").withColumn("key", _key(F.col("a"), F.col("b"), bits=key_bits))
    clash = _ambiguous(contents, "content").unionByName(_ambiguous(pairs, "a", "b"))
    if _shared.settle(clash, "clash").isEmpty():
        return thin.select("doc_id", "n_bytes", _climb(F.col("names"), levels, key_bits).alias("name"), F.lit(0).cast("long").alias("rank"), "text_sha256")
    numbered = _shared.settle(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    named = _by_rank(numbered.select("row", F.length("data").alias("n_bytes"), "data"), block_bytes, key_bits)
    return numbered.select("row", "doc_id", F.sha2("data", 256).alias("text_sha256")).join(named, "row").drop("row")


def duplicates(documents: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; a null doc_id is
    smaller than any other. Rows that repeat a doc_id with the same text are
    each counted and all marked kept if their doc_id is the one that stays.
    An empty table gives an empty result; other columns don't pass.
    """
    named = _shared.settle(identities(documents, block_bytes, key_bits), "identities")
    identity = ["n_bytes", "name", "rank"]
    groups = _shared.settle(named.groupBy(*identity).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, identity).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns: one for each distinct text.

    Rows that repeat the staying doc_id with the same text all stay. Of a text
    that only rows with null doc_id have, one row stays. A doc_id that stays
    for one text doesn't keep its rows with other texts. A null text counts as
    empty, columns may have any name, and an empty table gives an empty result.
    """
    keep = duplicates(documents, **options).where("kept").select(F.col("doc_id").alias("keep_doc"), F.col("text_sha256").alias("keep_text")).distinct()
    # Columns are packed away, so that none can clash.
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.sha2(_shared.text_or_empty().cast("binary"), 256).alias("own_text"))
    named = rows.where("own_id IS NOT NULL").join(keep, (F.col("own_id") == F.col("keep_doc")) & (F.col("own_text") == F.col("keep_text")), "left_semi")
    # Rows without a doc_id are numbered, so that one of each text stays.
    nameless, _ = _shared.number_rows(rows.where("own_id IS NULL"), "nameless", "own_n")
    first = nameless.groupBy("own_text").agg(F.min("own_n").alias("own_n")).join(keep.where("keep_doc IS NULL"), F.col("own_text") == F.col("keep_text"), "left_semi")
    alone = nameless.join(first.select("own_n"), "own_n", "left_semi")
    return named.select("row.*").unionByName(alone.select("row.*"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(_shared.table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
