"""Near-duplicate documents by HyperMinHash sketches, banding, corrected estimates and exact verification."""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import drop_stash, id_text, lean, stash, whole_rows
from .graph import connected_components

SHINGLE = 5
BANDS, ROWS = 36, 5
MANTISSA = 10
#: Shingles and rows of a block that is verified in one task; a pair of blocks holds twice as many.
BLOCK_SHINGLES, BLOCK_ROWS = 1_000_000, 128
#: Classes of a cluster that every block of it is held against.
PIVOTS = 6


def shingles(text: str, width: int = SHINGLE):
    """The distinct word shingles of a whole text as sorted 64-bit hashes; A-Z in lower case; fewer words are one."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, width)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : n - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


@functools.cache
def _factors(k: int):
    import numpy as np

    return np.random.default_rng(20231).integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1)


def registers(hashes, k: int = BANDS * ROWS, chunk: int = 4096):
    """k HyperMinHash registers of 16 bits: the least hash of each bucket's own permutation, kept as its count of leading
    zeros (6 bits) and the next MANTISSA bits. With a permutation for each bucket none is empty, however small the set.
    """
    import numpy as np

    a = _factors(k)[:, None]
    low = (hashes[None, :chunk] * a).min(axis=1)
    for s in range(chunk, len(hashes), chunk):
        low = np.minimum(low, (hashes[None, s : s + chunk] * a).min(axis=1))
    part, exponent = np.frexp(np.maximum(low, 1).astype(np.float64))
    return ((np.minimum(64 - exponent, 63) << MANTISSA) | ((2 * part - 1) * (1 << MANTISSA)).astype(np.int64)).astype("<u2")


@functools.lru_cache(4096)
def chance(n: int, m: int) -> float:
    """The probability that equal registers of disjoint sets of n and m elements collide: the sum over register values."""
    import numpy as np

    zeros = np.arange(1, 64)[:, None]
    low = 2.0**-zeros * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + 2.0**-zeros / (1 << MANTISSA)
    mass = [np.exp(x * np.log1p(-low)) - np.exp(x * np.log1p(-np.minimum(high, 1 - 1e-16))) for x in (n, m)]
    return float((mass[0] * mass[1]).sum())


def _rounded(n: int) -> int:
    return n if n < 16 else 1 << (n.bit_length() - 1)


def _name(s) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (128 bits that name the set; null without words) and regs for each row."""

    def each(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                s = shingles(text.as_py())
                if not len(s):
                    rows.append((doc, 0, None, None, None))
                    continue
                name = _name(s)
                rows.append((doc, len(s), int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True), registers(s).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_shingles", "s1", "s2", "regs"])

    return id_text(docs).mapInArrow(lean(each), "doc_id long, n_shingles long, s1 long, s2 long, regs binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """key, node: a row for each band of the compressed registers."""

    def each(batches):
        import numpy as np

        mix = _factors(ROWS + 1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), "<u2").reshape(n, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * mix[ROWS], (n, BANDS)).copy()
            for r in range(ROWS):
                key = (key ^ regs[:, :, r]) * mix[r]
                key ^= key >> np.uint64(31)
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "regs").mapInArrow(lean(each), "key long, node long")


@dataclass(frozen=True)
class Member:
    """A class in a task: its number, which of the task's two sides it is on, what it is known to belong to, and its set."""

    node: int
    side: int
    group: int
    shingles: object
    registers: object


def resolve(members: list[Member]) -> list[tuple[int, int]]:
    """Links (a, b) that span what the members' true links connect beyond their groups.

    Each is held against the others (with two sides, those of the other side) by their registers at once; those whose
    corrected estimate is within 4.5 standard errors of the limit, and that are not yet connected to it, are verified on
    the full sets.
    """
    import numpy as np

    sides = np.array([m.side for m in members])
    regs = np.stack([m.registers for m in members])
    sizes = np.array([len(m.shingles) for m in members])
    least = 0.75 - 4.5 * (0.75 * 0.25 / regs.shape[1]) ** 0.5
    root = np.unique([m.group for m in members], return_inverse=True)[1]
    two = sides.max() > 0
    links = []
    for i, own in enumerate(members):
        if two and own.side:
            continue
        others = np.flatnonzero(sides == 1) if two else np.arange(i + 1, len(members))
        n = sizes[i]
        # a link needs sizes within a factor of 3/4 and a document that isn't connected yet
        others = others[(4 * sizes[others] >= 3 * n) & (3 * sizes[others] <= 4 * n) & (root[others] != root[i])]
        if not len(others):
            continue
        equal = (regs[others] == regs[i]).mean(axis=1)
        by_chance = chance(_rounded(int(n)), _rounded(int(n)))
        estimate = (equal - by_chance) / (1 - by_chance)
        order = np.argsort(-estimate, kind="stable")
        for j in others[order[estimate[order] >= least]]:
            if root[j] == root[i]:
                continue
            a, b = own.shingles, members[j].shingles
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            if 100 * both >= 75 * (len(a) + len(b) - both):
                links.append((own.node, members[j].node))
                root[root == root[j]] = root[i]
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row: documents linked at Jaccard similarity 0.75 of their
    5-word shingle sets belong together; component_id is the smallest doc_id reachable.

    Documents with the same set are one numbered class from then on, so copies cost one row each. Band keys shared by
    classes chain into clusters, whose links are verified in blocks (``cluster_links``): pairs are never rows, only links
    that connect something are.
    Null and empty texts and those without words are linked with nothing and kept; very long texts are one set like any other;
    rows that share a doc_id are one document, whatever their texts; a row without doc_id stands for no class, and is
    kept if its text has no other; other columns aren't read, whatever their names; an empty table gives no rows.
    """
    d = stash(sketch(docs))
    shown = d.where("n_shingles > 0")
    classes = shown.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"), F.max("regs").alias("regs"))
    classes = stash(classes.where("doc is not null").withColumn("node", F.monotonically_increasing_id()))
    named = classes.select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), "node", "doc")
    same_set = (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2"))
    keys = stash(band_keys(classes))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("_key"), "least")
    # few keys are shared; what the first round of the components reads more than once is written, the keys are not needed again
    stars = stash(keys.join(shared, F.col("key") == F.col("_key")).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    drop_stash(keys)
    clusters = stash(connected_components(stars).join(classes.select("node", "doc", "s1", "n"), "node"))
    drop_stash(stars)
    links = cluster_links(id_text(docs), clusters)
    # ids of several texts: their classes are linked as one document
    several = shown.groupBy(F.col("doc_id").alias("_d")).agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).where("lo <> hi and _d is not null").select("_d")
    several = shown.join(several, F.col("doc_id") == F.col("_d")).select("doc_id", "s1", "s2").distinct().join(named, same_set).select("doc_id", "node")
    hubs = several.groupBy(F.col("doc_id").alias("_d")).agg(F.min("node").alias("a"))
    links = links.unionByName(several.join(hubs, F.col("doc_id") == F.col("_d")).where("node <> a").select("a", F.col("node").alias("b")))
    found = connected_components(stash(links)).join(classes.select("node", "doc"), "node")
    found = stash(found.select(F.col("node").alias("_node"), "component", "doc"))
    first = found.groupBy(F.col("component").alias("_c")).agg(F.min("doc").alias("first"))
    found = found.join(first, F.col("component") == F.col("_c")).select("_node", "first")
    out = d.join(named, same_set, "left").join(found, F.col("node") == F.col("_node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("first", "doc", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _blocks_of(rows: str, shingles: str) -> str:
    """SQL for the blocks that so many rows and shingles need."""
    return f"cast(greatest(ceil({shingles} / {BLOCK_SHINGLES}), ceil({rows} / {BLOCK_ROWS})) as int)"


def cluster_links(texts: DataFrame, clusters: DataFrame) -> DataFrame:
    """a, b: verified links that span the true links within the clusters (node, doc, s1, n shingles, component).

    First every block of a cluster is verified by itself, each with the cluster's PIVOTS beside it: a large group of near copies
    is thereby one group after a pass that sends each text once. What then is still apart is verified in pairs of
    blocks; blocks of one group aren't held against each other, nor are members of one group, so no link is lost and a large
    group costs no pairs of its own blocks. No task holds more than two blocks.
    """
    size = clusters.groupBy("component").agg(F.sum("n").alias("_sum"), F.count("*").alias("_rows")).select(F.col("component").alias("_c"), F.expr(_blocks_of("_rows", "_sum")).alias("blocks"))
    c = stash(clusters.join(size, F.col("component") == F.col("_c")).drop("_c").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")))
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("node", F.lit(7)), "node"))
    pivots = c.where("blocks > 1").withColumn("_r", first).where(F.col("_r") <= PIVOTS).drop("_r").withColumn("_own", F.col("block"))
    pivots = pivots.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).where("block <> _own").drop("_own")
    rows = c.unionByName(pivots).select("node", "doc", "s1", F.lit(0).alias("side"), F.col("node").alias("group"), F.xxhash64("component", "block").alias("task"), "component")
    links = stash(_verified(texts, rows))
    c = c.where("blocks > 1")
    if not c.limit(1).count():
        return links
    group = connected_components(links).select(F.col("node").alias("_n"), F.col("component").alias("_g"))
    c = c.select("node", "doc", "s1", "n", "component").join(group, F.col("node") == F.col("_n"), "left").withColumn("group", F.coalesce("_g", "node")).drop("_n", "_g")
    c = stash(c)
    groups = c.groupBy(F.col("component").alias("_c"), F.col("group").alias("_g")).agg(F.count("*").alias("_rows"), F.sum("n").alias("_sum"))
    apart = groups.groupBy("_c").agg(F.count("*").alias("_groups")).where("_groups > 1").select(F.col("_c").alias("_a"))
    # a group as large as a block has blocks of its own, all others of a cluster are dealt to common ones
    groups = groups.join(apart, F.col("_c") == F.col("_a")).withColumn("_own", F.expr(_blocks_of("_rows", "_sum"))).withColumn("_large", F.expr(f"_own > 1 or 2 * _rows > {BLOCK_ROWS}"))
    common = groups.where("not _large").groupBy("_c").agg(F.sum("_rows").alias("r"), F.sum("_sum").alias("s")).select(F.col("_c").alias("_k"), F.expr(_blocks_of("r", "s")).alias("_common"))
    groups = stash(groups.join(common, F.col("_c") == F.col("_k"), "left").select("_c", "_g", "_large", "_own", F.coalesce("_common", F.lit(0)).alias("_common")))
    blocks = groups.where("_large").select("_c", F.col("_g").alias("owner"), F.explode(F.expr("sequence(0, _own - 1)")).alias("number")).unionByName(
        groups.where("_common > 0").select("_c", F.lit(-1).cast("long").alias("owner"), "_common").distinct().select("_c", "owner", F.explode(F.expr("sequence(0, _common - 1)")).alias("number")))
    block = F.struct("owner", "number")
    blocks = stash(blocks.select("_c", block.alias("b"), "owner"))
    pairs = blocks.alias("x").join(blocks.alias("y"), F.expr("x._c = y._c and (x.b < y.b and (x.owner = -1 or x.owner <> y.owner) or x.b = y.b and x.owner = -1)")).select(
        F.col("x._c").alias("_c"), F.col("x.b").alias("low"), F.col("y.b").alias("high"))
    sent = pairs.select("_c", "low", "high", F.col("low").alias("b"), F.lit(0).alias("side")).unionByName(pairs.where("low <> high").select("_c", "low", "high", F.col("high").alias("b"), F.lit(1).alias("side")))
    own = c.join(groups, (F.col("component") == F.col("_c")) & (F.col("group") == F.col("_g"))).withColumn(
        "_b", F.struct(F.when(F.col("_large"), F.col("group")).otherwise(F.lit(-1).cast("long")).alias("owner"), F.expr("cast(pmod(xxhash64(node, 3), if(_large, _own, _common)) as int)").alias("number"))).drop("_c")
    rows = own.join(sent.hint("merge"), (F.col("component") == F.col("_c")) & (F.col("_b") == F.col("b"))).select("node", "doc", "s1", "side", "group", F.xxhash64("_c", "low", "high").alias("task"), "component")
    return links.unionByName(stash(_verified(texts, rows)))


def _verified(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b: the links of each task's rows (node, doc, s1, side, group, task, component), which get their texts by doc."""
    # copies for tasks make it larger than the optimizer can tell, so it is never to be broadcast
    rows = texts.join(rows.hint("merge"), F.col("doc_id") == F.col("doc")).select("task", "component", "node", "s1", "side", "group", "text")
    rows = rows.repartition("task").sortWithinPartitions("task", "component", "side", "node")

    def each(batches):
        key, members, seen = None, [], set()

        def close():
            found = resolve(members) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("task", "component", "node", "s1", "side", "group")]
            for at, (task, component, node, name, side, group) in enumerate(zip(*columns, strict=True)):
                if (task, component) != key:
                    if key is not None:
                        yield close()
                    key, members, seen = (task, component), [], set()
                if node in seen:
                    continue
                s = shingles(batch.column("text")[at].as_py())
                if not len(s) or int.from_bytes(_name(s)[:8], "little", signed=True) != name:
                    continue  # another text of the same id
                seen.add(node)
                members.append(Member(node, side, group, s, registers(s)))
        if key is not None:
            yield close()

    return rows.mapInArrow(lean(each), "a long, b long")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns; repeated rows of it count as copies.

    Rows that share a doc_id but not a text all stay where their id does. Null, empty and very long texts, null ids, clashing
    columns and empty tables are as in ``near_duplicates``.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    one = whole_rows(docs).withColumns({"_doc": F.col("row.doc_id"), "_text": F.xxhash64("row.text")}).dropDuplicates(["_doc", "_text"])
    return one.join(kept, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("row.*")
