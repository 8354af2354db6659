"""Nearest neighbours by additive quantisation: beam-search codes, lookup-table scores, exact reranking."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stash

BOOKS, WORDS, BEAM = 16, 64, 4
#: Vectors that the codebooks are trained on, at most: those with the least hashes of their ids.
SAMPLE = 16_384
#: Codes and queries that meet in one cell at most, queries whose lookup tables are held at a time, and the candidates of a
#: query that a cell reranks first.
CODES, QUERIES, TABLES, RERANK = 8192, 8192, 256, 256
#: Tasks that cells are dealt to, at most; a task takes one cell after the other.
TASKS = 20_000


def train(x, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 5):
    """Codebooks (books, words, dimensions) for the rows of x: k-means on residuals, then least squares over all books."""
    import numpy as np

    rng = np.random.default_rng(seed)
    n, dim = x.shape
    c = np.zeros((books, words, dim))
    residual = x.copy()
    codes = np.zeros((n, books), np.int64)
    for m in range(books):
        c[m] = residual[rng.choice(n, words, replace=n < words)]
        for _ in range(rounds):
            near = ((c[m] ** 2).sum(1)[None] - 2 * residual @ c[m].T).argmin(1)
            count = np.bincount(near, minlength=words)
            sums = np.zeros_like(c[m])
            np.add.at(sums, near, residual)
            c[m] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c[m])
        codes[:, m] = near = ((c[m] ** 2).sum(1)[None] - 2 * residual @ c[m].T).argmin(1)
        residual -= c[m][near]
    for _ in range(2):
        codes = encode(x, c)
        place = codes + np.arange(books) * words
        gram = np.zeros((books * words, books * words))
        for a in range(books):
            np.add.at(gram, (place[:, a][:, None], place), 1.0)
        right = np.zeros((books * words, dim))
        for a in range(books):
            np.add.at(right, place[:, a], x)
        c = np.linalg.solve(gram + 0.5 * np.eye(books * words), right + 0.5 * c.reshape(-1, dim)).reshape(books, words, dim)
    return c


def encode(x, c, beam: int = BEAM):
    """Codes (rows, books) by beam search: each step keeps the ``beam`` partial sums nearest to the vector."""
    import numpy as np

    books, words, dim = c.shape
    flat = c.reshape(-1, dim)
    gram, norm = flat @ flat.T, (flat**2).sum(1)
    out = np.zeros((len(x), books), np.uint8)
    for s in range(0, len(x), 2048):
        dots = x[s : s + 2048] @ flat.T
        n = len(dots)
        codes, error = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1))
        for m in range(books):
            at = slice(m * words, (m + 1) * words)
            step = error[:, :, None] + (norm[at] - 2 * dots[:, at])[:, None, :]
            own = 2 * gram[:, at]
            for j in range(m):
                step += own[codes[:, :, j] + j * words]
            width = min(beam, step.shape[1] * words)
            step = step.reshape(n, -1)
            best = np.argpartition(step, width - 1, axis=1)[:, :width]
            error = np.take_along_axis(step, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // words)[:, :, None], 1), (best % words)[:, :, None]], 2)
        out[s : s + n] = np.take_along_axis(codes, error.argmin(1)[:, None, None], 1)[:, 0]
    return out


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles, one a vec_id (of several the least, component by component)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)")
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, query_every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by cosine of each row whose vec_id ``query_every`` divides.

    A query's own row is no candidate. Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, ties
    going to the smaller id, so the index keeps those; the rest are in it by them. Codebooks come from at most SAMPLE
    vectors; every vector is encoded. Blocks of codes meet blocks of queries in tasks of bounded size; each scores
    all its codes by lookup tables and stored norms, reranks the best RERANK on the original vectors in double
    precision, then every other whose approximate score and stored error let it reach the k-th of these, and passes on k.
    So the result is exact: a cosine is off by no more than the distance of a vector's direction from its code's.
    Vectors that are null, zero, hold null or non-finite components, or differ in length from the sample's take no
    part, nor do null ids; repeated ids are one vector, the least by components; ties go to the smaller id; other columns
    aren't read, whatever their names; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = stash(_valid(vectors))
    copies = Window.partitionBy("v").orderBy("vec_id")
    index = stash(v.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= k + 1).drop("_r"))
    sample = [r["v"] for r in index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    shape = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], shape)

    import numpy as np

    dim = max(set(map(len, sample)), key=[len(s) for s in sample].count)
    x = np.array([s for s in sample if len(s) == dim])
    books = spark.sparkContext.broadcast(train(x / np.linalg.norm(x, axis=1, keepdims=True)))
    index, queries = index.where(F.size("v") == dim), v.where((F.size("v") == dim) & (F.col("vec_id") % query_every == 0))
    # each vector is sent once for a block of queries, each query once for a block of codes; few vectors are dealt to all cores
    asked, cores = queries.count(), spark.sparkContext.defaultParallelism
    tall = max(1, math.ceil(index.count() / CODES))
    wide = max(1, math.ceil(asked / QUERIES), min(math.ceil(asked / 64), math.ceil(2 * cores / tall)))

    def codes(batches):
        for batch in batches:
            a = np.array(batch.column("v").flatten()).reshape(-1, dim)
            if not len(a):
                continue
            c = encode(a / np.linalg.norm(a, axis=1, keepdims=True), books.value)
            flat = books.value
            near = sum(flat[m][c[:, m]] for m in range(flat.shape[0]))
            norm = np.linalg.norm(near, axis=1)
            error = np.linalg.norm(a / np.linalg.norm(a, axis=1, keepdims=True) - near / np.maximum(norm, 1e-12)[:, None], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([r.tobytes() for r in c], pa.binary()), pa.array(norm), pa.array(error)], names=["vec_id", "v", "codes", "norm", "error"])

    coded = stash(index.mapInArrow(codes, "vec_id long, v array<double>, codes binary, norm double, error double"))
    left = coded.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(tall))).withColumn("h", F.explode(F.expr(f"sequence(0L, {wide - 1}L)")))
    right = queries.withColumn("codes", F.lit(None).cast("binary")).withColumn("norm", F.lit(None).cast("double")).withColumn("error", F.lit(None).cast("double"))
    right = right.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(wide))).withColumn("g", F.explode(F.expr(f"sequence(0L, {tall - 1}L)")))
    cells = left.unionByName(right).repartition(min(TASKS, tall * wide), "g", "h").sortWithinPartitions("g", "h", "vec_id")

    def search(ids, a, c, norm, error, qid, q):
        order = np.argsort(ids, kind="stable")
        ids, a, c, norm, error = ids[order], a[order], c[order], norm[order], error[order]
        length, qlength = np.sqrt((a * a).sum(1)), np.sqrt((q * q).sum(1))
        rows = []
        for i in range(len(qid)):
            if i % TABLES == 0:
                table = np.einsum("qd,mkd->qmk", q[i : i + TABLES], books.value)
            near = table[i % TABLES, np.arange(table.shape[1])[None, :], c].sum(1) / np.maximum(norm, 1e-12)
            near[ids == qid[i]] = -np.inf
            best = np.arange(len(ids)) if len(ids) <= RERANK else np.sort(np.argpartition(-near, RERANK - 1)[:RERANK])
            best = best[ids[best] != qid[i]]
            score = (a[best] * q[i]).sum(1) / (length[best] * qlength[i])
            if len(ids) > RERANK:
                # all others that their error lets reach the k-th, less those that a product shows to be below it
                least = np.partition(score, len(score) - k)[len(score) - k] - 1e-9 if len(score) >= k else -np.inf
                more = np.flatnonzero((near / qlength[i] + error >= least) & (ids != qid[i]))
                rough = (a @ q[i])[more] if 2 * len(more) > len(ids) else a[more] @ q[i]
                more = more[rough / (length[more] * qlength[i]) >= least]
                best = np.union1d(best, more)
                score = (a[best] * q[i]).sum(1) / (length[best] * qlength[i])
            top = np.lexsort((ids[best], -score))[:k]
            rows += [(int(qid[i]), int(ids[best[j]]), float(score[j])) for j in top]
        return rows

    def each(batches):
        def close(rows):
            c = list(zip(*rows, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64())], names=["query_id", "vec_id", "score"])

        now, held = None, []

        def found():
            t = pa.Table.from_batches(held)
            is_query = t.column("codes").is_null().to_numpy()
            ids, a = t.column("vec_id").to_numpy(), np.array(t.column("v").combine_chunks().flatten()).reshape(-1, dim)
            c = np.frombuffer(b"".join(x for x in t.column("codes").to_pylist() if x is not None), np.uint8).reshape(-1, BOOKS).astype(np.int64)
            norm, error = (t.column(x).to_numpy()[~is_query] for x in ("norm", "error"))
            return search(ids[~is_query], a[~is_query], c, norm, error, ids[is_query], a[is_query]) if is_query.any() and len(c) else []

        for batch in batches:
            cell = np.stack([batch.column("g").to_numpy(), batch.column("h").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if now is not None and tuple(cell[a]) != now:
                    yield close(found())
                    held.clear()
                now = tuple(cell[a])
                held.append(batch.slice(a, b - a))
        yield close(found() if held else [])

    met = cells.mapInArrow(each, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
