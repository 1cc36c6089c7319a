"""Exact deduplication by an extendible-hash index on shared files (native).

Texts are compared after white space is normalised. Each text has a 64-bit key.
The directory maps the leading ``depth`` bits of a key to a bucket: starting from
one bucket, the directory doubles while a bucket holds more than ``capacity``
distinct keys, and only the overfull buckets split, so a bucket has its own depth.
Buckets are intervals of keys, and owner tasks work key ranges of whole keys.

First only ids, keys and digests are written. A key that one row has is an entry by
itself; its text never moves. Of the keys that meet, a filter of bounded size is sent to
the texts; map tasks merge their own copies byte by byte, so a text that a third of all
rows share moves once for each task, and the merged texts go to the owner of their key
range, which chains those of different bytes in one entry. Directory, keys and index are
files in the shared folder; documents then find their entry by key (entries of very many
rows are broadcast, there is at most one for ``hot_rows`` rows) and pick from its chain
the text with their digest.

The directory has at most ``2 ** 20`` cells, so it may be broadcast (some 12 MB); beyond
``2 ** 18`` times ``capacity`` keys the capacity of a bucket grows instead.

Edge cases: a null text counts as empty, and empty texts equal one another; texts
of any length are compared whole; the smallest doc_id of a group stays, a null
doc_id only where a group has no other (then all rows of the group count as the
one that stays); repeated rows are rows of their own and all with the smallest id
stay; extra columns, whatever their names, are passed over; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, partitions


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def directory_depth(keys: int, capacity: int) -> tuple[int, int]:
    """The depth at which doubling stops, and the capacity, for a number of distinct keys."""
    capacity = max(capacity, keys >> 18)
    return min(20, max(4, (keys // capacity).bit_length() + 2)), capacity


def directory(keys: DataFrame, capacity: int, most_depth: int) -> DataFrame:
    """``slot, bucket, depth`` for all ``2 ** most_depth`` slots, from distinct keys in ``key``.

    The depth of a slot is the least at which its bucket holds no more than
    ``capacity`` keys (doubling stops at ``most_depth``); ``bucket`` is the first slot
    of the bucket, so buckets are in the order of their keys."""
    spark = keys.sparkSession
    slots = 1 << most_depth
    held = keys.groupBy(F.shiftrightunsigned("key", 64 - most_depth).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    held = spark.range(slots).select(F.col("id").cast("int").alias("slot")).join(held, "slot", "left")
    levels = held.select("slot", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(most_depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {most_depth} - depth)"))
    full = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    fits = levels.drop("n").join(full, ["depth", "prefix"]).where((F.col("n") <= capacity) | (F.col("depth") == most_depth))
    return fits.groupBy("slot").agg(F.min("depth").alias("depth")).withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {most_depth} - depth), {most_depth} - depth)")).select("slot", "bucket", "depth")


BLOCK_BITS = 1 << 15


def _bits(key: Column, bits: int) -> tuple[Column, Column]:
    """Block and place within it of a key's bit."""
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.floor(spot / BLOCK_BITS).cast("int"), F.pmod(spot, F.lit(BLOCK_BITS)).cast("int")


def with_met_keys(texts: DataFrame, met: DataFrame, number: int, most_bits: int = 1 << 27) -> DataFrame:
    """The rows of ``texts`` whose ``key`` is among ``met``, and a few others: a filter of
    ``most_bits`` bits (16 MB) at most is broadcast, so no text moves for this."""
    bits = min(most_bits, 1 << max(15, (16 * max(1, number) - 1).bit_length()))
    block, place = _bits(F.col("key"), bits)
    blocks = met.groupBy(block.alias("__block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("__bits"))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    there = F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))) % 2 == 1
    return texts.withColumn("__block", block).join(F.broadcast(blocks), "__block").where(there).drop("__block", "__bits")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4_096, key_bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files of the index: directory, keys of the documents, entries.

    entries: ``bucket, key, chain, n`` with one element of the chain for each text of the
    key (digest, id that stays, group size), and the rows of the key. ``key_bits`` under
    64 makes keys meet (tests)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    hashed = F.xxhash64("norm")
    texts = texts.withColumn("key", F.shiftleft(hashed, 64 - key_bits) if key_bits < 64 else hashed)
    keys = materialize(texts.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("digest")), "exact-keys")
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("digest"), F.min("doc_id").alias("keep_id"))
    counts = materialize(counts, "exact-counts")
    number, meet = counts.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    most_depth, capacity = directory_depth(number, capacity)
    slots = materialize(directory(counts.select("key"), capacity, most_depth), "exact-directory")
    slot = F.shiftrightunsigned("key", 64 - most_depth).cast("int")
    placed = lambda df: df.withColumn("slot", slot).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")
    item = F.struct("digest", "keep_id", F.col("n").alias("group_size"))
    alone = placed(counts.where("n = 1")).select("bucket", "key", F.array(item).alias("chain"), "n")
    # the copies of a text are merged, byte by byte, before owners get them
    merged = with_met_keys(texts, counts.where("n > 1").select("key"), meet).groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    merged = placed(merged.join(counts.where("n > 1").select("key"), "key", "left_semi"))
    owned = merged.repartitionByRange(partitions(docs.sparkSession), "bucket", "key").withColumn("digest", F.unhex(F.sha2("norm", 256)))
    chained = owned.groupBy("bucket", "key").agg(F.collect_list(item).alias("chain"), F.sum("n").alias("n"))
    return slots, keys, materialize(chained.unionByName(alone), "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 50_000, **options) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    _, keys, entries = build_index(docs, id_col, text_col, **options)
    hot = entries.where(F.col("n") > hot_rows).select("key", F.col("chain").alias("hot_chain"))
    marked = keys.join(F.broadcast(hot), "key", "left")
    found = marked.where("hot_chain is null").drop("hot_chain").join(entries.where(F.col("n") <= hot_rows).select("key", "chain"), "key")
    found = found.unionByName(marked.where("hot_chain is not null").withColumnRenamed("hot_chain", "chain"))
    found = found.withColumn("item", F.expr("filter(chain, c -> c.digest = digest)[0]"))
    return found.select(
        F.col("doc_id").alias(id_col),
        F.col("item.keep_id").alias("keep_id"),
        F.col("item.group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("item.keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
