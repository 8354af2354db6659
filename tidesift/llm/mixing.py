"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, stash, whole_rows

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, number, source_size, target: words that the mix takes of each source.

    Sources by code point, null last, weigh ``weights`` over and over and share ``share`` of all words. A target stops
    at ``most`` times its source's size and the excess goes to the others by weight, until none is above. That is
    filling by the ratio of limit to weight: a prefix of that order is at its limit and one level serves all others.
    One row per source; sources are few beside documents.
    """
    all_ = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("number", F.row_number().over(all_.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("_cap", most * F.col("source_size"))
    before = all_.orderBy(F.col("_cap") / F.col("_w"), "number").rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    s = s.withColumn("_level", F.coalesce(F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "number", F.col("_level").alias("level"))) ).over(all_).getField("level"), F.lit(0.0)))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_level") * F.col("_w"))
    return s.select("source", "number", "source_size", target.cast("double").alias("target"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """_row, doc_id, source, size (words) and a hash of the text; stashed, with _row telling repeated rows apart."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_text"))
    return stash(d.withColumn("_row", F.monotonically_increasing_id()))


def place_documents(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds number, source_size, target and start, a document's first word in its source.

    The running sum is taken in salted groups of about the square root of the rows, so that a source with a third of
    all rows is many groups; the groups' own sums are a small table.
    """
    rows = sizes.count()
    salts = 1 + rows // max(256, math.isqrt(rows))
    d = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    d = d.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    groups = d.groupBy("number", "_salt").agg(F.sum("size").alias("_sum"))
    by = Window.partitionBy("number").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("number").alias("_n"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_sum").over(by), F.lit(0)).alias("_before"))
    within = Window.partitionBy("number", "_salt").orderBy("doc_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(groups, (F.col("number") == F.col("_n")) & (F.col("_salt") == F.col("_s")))
    return d.withColumn("start", F.col("_before") + F.col("_in")).drop("_n", "_s", "_salt", "_before", "_in")


def permuted(index: str, blocks: str, source: str, seed: int, rounds: int = 16) -> str:
    """SQL for a pseudorandom permutation of 0 to blocks - 1: the swap-or-not shuffle, which needs no table.

    In each round an index x and its partner K - x change places if a hash of the larger of the two says so.
    """
    partner = f"pmod(xxhash64({seed}L, {source}, r), {blocks}) + {blocks} - x"
    return (f"aggregate(sequence(1, {rounds}), {index}, (x, r) -> if(pmod(xxhash64({seed}L, {source}, r, greatest(x, pmod({partner}, {blocks})), 1), 2) = 1, "
            f"pmod({partner}, {blocks}), x))")


def _slots(plan: DataFrame, block: int) -> DataFrame:
    """A source's slots by number, with its blocks, whole passes, rest and the slots of all sources."""
    p = plan.where("source_size > 0").withColumn("blocks", F.expr(f"cast(ceil(source_size / {block}) as bigint)"))
    p = p.withColumn("passes", F.expr("cast(floor(target / source_size) as bigint)"))
    p = p.withColumn("rest", F.expr("cast(round(target - passes * source_size) as bigint)"))
    p = p.withColumn("slots", F.expr(f"passes * blocks + cast(ceil(rest / {block}) as bigint)"))
    p = p.withColumn("_all", F.sum("slots").over(Window.partitionBy()))
    p = p.where("slots > 0").withColumn("chunk", F.explode(F.expr("sequence(0L, (slots - 1) div 65536)")))
    p = p.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "number", "chunk")
    return p.withColumn("slot", F.explode(F.expr("sequence(chunk * 65536, least(slots, (chunk + 1) * 65536) - 1)")))


def block_slots(plan: DataFrame, block: int = 64, per_shard: int = 4096, seed: int = 7) -> DataFrame:
    """The mix, a row for each block it takes: number, index (of the block in its source), words, shard, place.

    A source of s words has ceil(s / block) blocks. Its slots go through its permutation again and again: whole passes
    first, then as many blocks as the rest of its target needs, the last cut short. Each slot goes to the output shard
    that a hash names, which draws the shards' source counts multinomially, given the sources' totals; place orders a
    shard. Slots are made from chunks of at most 65,536, dealt to all tasks, so a large source isn't one task.
    """
    p = _slots(plan, block).withColumn("shards", F.ceil(F.col("_all") / per_shard))
    p = p.withColumn("_x", F.expr("slot % blocks")).withColumn("index", F.expr(permuted("_x", "blocks", "number", seed)))
    words = F.expr(f"if(slot < passes * blocks, {block}L, least({block}L, rest - (slot - passes * blocks) * {block}))")
    place = F.xxhash64(F.lit(seed + 1), "number", "slot")
    return p.select("number", "index", words.alias("words"), F.pmod(F.xxhash64(F.lit(seed), "number", "slot"), F.col("shards")).alias("shard"), place.alias("place"))


def block_pieces(placed: DataFrame, block: int = 64) -> DataFrame:
    """_row, number, index, at, n: the part of each document in each block that it reaches."""
    d = placed.where("size > 0").withColumn("index", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    return d.select("_row", "number", "index", F.expr(f"greatest(start - index * {block}, 0L)").alias("at"),
                    F.expr(f"least(start + size, (index + 1) * {block}) - greatest(start, index * {block})").alias("n"))


def mixed_blocks(placed: DataFrame, plan: DataFrame, block: int = 64, seed: int = 7) -> DataFrame:
    """The mix itself, blocks joined by index: shard, place (its order there), and of each slot the parts of documents: _row,
    at (its first word in the block) and words.

    Slots grow with the input, but the optimizer takes them for as small as the plan that they are made from, so they are
    never to be broadcast.
    """
    slots = block_slots(plan, block, seed=seed).select(F.col("number").alias("_n"), F.col("index").alias("_i"), F.col("words").alias("_words"), "shard", "place")
    met = block_pieces(placed, block).join(slots.hint("merge"), (F.col("number") == F.col("_n")) & (F.col("index") == F.col("_i")))
    # a cut slot takes a block's first words
    return met.select("shard", "place", "_row", "index", "at", F.expr("least(at + n, _words) - at").alias("words")).where("words > 0")


def shard_counts(plan: DataFrame, block: int = 64, per_shard: int = 4096, seed: int = 7) -> DataFrame:
    """shard, number, slots, words: what each output shard draws from each source."""
    return block_slots(plan, block, per_shard, seed).groupBy("shard", "number").agg(F.count("*").alias("slots"), F.sum("words").alias("words"))


def mix(docs: DataFrame, block: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted) and first_shard (the least output
    shard that takes some, null if none does) for each row.

    Blocks meet slots by source and index. A block is taken at most twice and a cut one in its first words, so no
    document exceeds twice its size, and a source misses its target by less than one block.
    Null and empty texts have size 0 and are never taken; a very long text is as many blocks as it needs; a null source is a
    source, the last; repeated rows and null ids are documents of their own; other columns aren't read, whatever their names;
    an empty table gives no rows. The result depends on ids, texts and sources alone, so reruns agree.
    """
    sizes = document_sizes(docs)
    plan = stash(source_targets(sizes))
    placed = stash(place_documents(sizes, plan))
    taken = mixed_blocks(placed, plan, block, seed).groupBy(F.col("_row").alias("_r")).agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    d = placed.join(taken, F.col("_row") == F.col("_r"), "left")
    return d.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mix_rows(docs: DataFrame, block: int = 64, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that fill each source's target, in whole documents but one a source.

    A source's documents go through its permutation in the order of the blocks that they begin in: all of them as often as
    the target holds the source whole, then those that fill the rest, the last cut after the words that are missing. So a
    source's words are its target, rounded, also where a few very long documents hold most of it, and no document
    is taken more than twice. Documents without words, null texts among them, aren't taken; a cut text keeps its white space,
    and n_chars, if there is one, follows it; rows that are the same share a row's columns; null ids and sources are values
    like others; an empty table gives no rows.
    """
    sizes = document_sizes(docs)
    plan = stash(source_targets(sizes))
    placed = stash(place_documents(sizes, plan))
    once = plan.where("source_size > 0").withColumn("target", F.col("source_size").cast("double"))
    slots = _slots(once, block).withColumn("index", F.expr(permuted("slot", "blocks", "number", seed))).select(F.col("number").alias("_n"), F.col("index").alias("_i"), "slot")
    first = placed.where("size > 0").withColumn("index", F.expr(f"start div {block}"))
    d = first.join(slots.hint("merge"), (F.col("number") == F.col("_n")) & (F.col("index") == F.col("_i"))).withColumn("_salt", F.expr("slot div 1024"))
    by = Window.partitionBy("number").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("number", "_salt").agg(F.sum("size").alias("_sum")).select(F.col("number").alias("_m"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_sum").over(by), F.lit(0)).alias("_before"))
    within = Window.partitionBy("number", "_salt").orderBy("slot", "start").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, (F.col("number") == F.col("_m")) & (F.col("_salt") == F.col("_s")))
    d = d.withColumn("_passes", F.expr("cast(floor(target / source_size) as int)"))
    rest = F.expr("cast(round(target - _passes * source_size) as bigint)") - F.col("_before") - F.col("_in")
    d = d.withColumn("_rest", F.least("size", F.greatest(F.lit(0).cast("long"), rest)))
    d = d.withColumn("_take", F.explode(F.expr("concat(array_repeat(size, _passes), if(_rest > 0, array(_rest), cast(array() as array<bigint>)))")))
    d = d.join(plan.select(F.col("number").alias("_p"), F.col("source").alias("_source")), F.col("number") == F.col("_p"))
    d = d.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_h"), "_source", "size", "_take")
    one = whole_rows(docs).withColumns({"_i": F.col("row.doc_id"), "_x": F.xxhash64("row.text"), "_s": F.col("row.source")}).dropDuplicates(["_i", "_x", "_s"])
    out = one.join(d, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_h")) & F.col("_s").eqNullSafe(F.col("_source")))
    # pieces of a word and the white space after it
    pieces = F.expr(r"split(regexp_replace(row.text, '^[\\x20\\x09-\\x0D]+', ''), '(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])')")
    text = F.when(F.col("_take") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("_take").cast("int")), ""))
    out = out.withColumn("_cut", text)
    made = {"text": F.col("_cut")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made["n_chars"] = F.when(F.col("_take") == F.col("size"), F.col("row.n_chars")).otherwise(F.length("_cut")).cast(kind)
    return out.select(*(made[c].alias(c) if c in made else F.col(f"row.`{c}`") for c in docs.columns))
