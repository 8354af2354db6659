"""Language-model scoring by a weighted backoff automaton over every pair and triple of the training tokens.

States are contexts: none, a token, a pair. A state's arc for a token has a weight; where it has none, its failure arc
leads at a weight to the next shorter context. Smoothing is hierarchical (MacKay and Peto): a context of t tokens adds PULL times
the shorter context's distribution to its counts, so a gram's arc needs its count and its context's count and nothing
else, and a context's count is that of the next shorter gram. So grams are codes with counts, dealt evenly to tasks.

Documents are cut into blocks. A block asks for each of its distinct grams once, in one row for a bucket of codes;
a bucket adds up what the blocks count and answers each of them. No table of grams is held by any worker or the driver.
"""

from __future__ import annotations

import itertools
import math
import pickle
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_stash, id_text, stash

#: The token that ends a document; words hold no white space, so it is none of them.
END = b"\n"
#: Characters of a block of documents, and those of all blocks for which there is a bucket of each order.
BLOCK_CHARS, BUCKET_CHARS = 8_000_000, 12_000_000
#: Bits of a code beyond those that number all tokens: a gram is taken for another with probability 2**-SPARE at any size.
SPARE, LEAST_BITS = 18, 44
#: How many tokens the next shorter context counts for in pairs and in triples: the best of a few for held-out text of sf0.1 (-3.15 a token; the base -4.19).
PULL = (300.0, 20.0)
#: Tasks that blocks and buckets are dealt to, at most; a task takes one after the other.
TASKS = 20_000


def words(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct training tokens, the discount and the training documents."""

    tokens: int
    kinds: int
    discount: float
    docs: int

    def base(self, c: int) -> float:
        return math.log10((c + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def unigram(self, c: int) -> float:
        """Absolute discounting: what known tokens give up is the unknown token's, so all sums to one."""
        if not self.tokens:
            return 0.0
        return math.log10((c - self.discount if c else self.discount * self.kinds) / self.tokens)


def _hash(words_: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words_), np.uint64, len(words_))


def _mix(a, b):
    import numpy as np

    z = a * np.uint64(0x9E3779B97F4A7C15) + b
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _pack(*columns) -> bytes:
    """Columns of unsigned integers, each in as few bytes as its largest needs, byte by byte and compressed."""
    import numpy as np

    sizes = [max(1, (int(c.max(initial=0)).bit_length() + 7) // 8) for c in columns]
    raw = bytes(sizes) + b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes() for c, k in zip(columns, sizes, strict=True))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, columns: int):
    import numpy as np

    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    sizes, at, out = raw[:columns].tolist(), columns, []
    for k in sizes:
        x = np.zeros((n, 8), np.uint8)
        x[:, :k] = raw[at : at + k * n].reshape(k, n).T
        out.append(x.view("<u8").ravel())
        at += k * n
    return out


def tokenised(texts: list[str]):
    """vocabulary (sorted hashes), the place in it of each token, and the tokens of each document, ends included."""
    import numpy as np

    parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    found = parts.flatten().dictionary_encode()
    names = [x.lower() for x in found.dictionary.cast(pa.large_binary()).to_pylist()]
    at, bounds = found.indices.to_numpy(), parts.offsets.to_numpy()
    real = np.array([bool(x) for x in names] or [False])[at] if len(at) else np.zeros(0, bool)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(real)])
    n = before[bounds[1:]] - before[bounds[:-1]] + 1
    tokens = np.full(int(n.sum()), len(names), np.int64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(n) - 1] = False
    tokens[inner] = at[real]
    # an empty name stands for no token; equal hashes are one entry
    hashes = _hash([*names, END])
    used = np.zeros(len(hashes), bool)
    used[tokens] = True
    vocabulary, place = np.unique(hashes[used], return_inverse=True)
    rank = np.zeros(len(hashes), np.int64)
    rank[used] = place
    return vocabulary, rank[tokens], n


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    names = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


BLOCKS = "block long, chars long, tokens long, data binary"
ASKED = "block long, bucket long, order int, n long, data binary"
ANSWERS = ASKED + ", tokens long, words long, once long, twice long, docs long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _blocks(block_chars: int):
    """Blocks of documents: ids, folds, and tokens as places in the block's vocabulary of hashes."""

    def each(batches):
        import numpy as np
        from pyspark import TaskContext

        block, held, chars = TaskContext.get().partitionId() << 32, [], 0

        def close():
            rows = pa.Table.from_batches(held)
            vocabulary, ids, n = tokenised(rows.column("text").to_pylist())
            steps = np.diff(vocabulary, prepend=np.uint64(0))
            data = pickle.dumps((rows.column("doc_id").to_pylist(), rows.column("held_out").to_pylist(), n.astype(np.int32), len(vocabulary), _pack(steps), len(ids), _pack(ids)))
            return _batch([(block, chars, len(ids), data)], BLOCKS)

        for batch in batches:
            start = 0
            for k, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                chars += size
                if chars > block_chars:
                    held.append(batch.slice(start, k + 1 - start))
                    yield close()
                    block, held, chars, start = block + 1, [], 0, k + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield close()

    return each


def _block(data: bytes):
    """ids, folds, tokens of each document, the vocabulary, each token's place in it, and codes of the pair and of the
    triple that end at each token; a document's first token has no triple."""
    import numpy as np

    docs, out, n, size, vocabulary, count, ids = pickle.loads(data)
    vocabulary, ids = np.cumsum(_unpack(vocabulary, size, 1)[0], dtype=np.uint64), _unpack(ids, count, 1)[0].astype(np.int64)
    n = n.astype(np.int64)
    first = np.cumsum(n) - n
    w = vocabulary[ids]
    v = np.roll(w, 1)
    v[first] = np.uint64(0x5851F42D4C957F2D)  # the start's
    pair = _mix(v, w)
    triple = _mix(np.roll(pair, 1) ^ np.uint64(0xD1342543DE82EF95), w)
    inner = np.ones(len(w), bool)
    inner[first] = False
    return docs, out, n, vocabulary, ids, pair, triple, inner


def _distinct(codes, bits: int):
    """Distinct codes of so many bits, ascending, and the place among them of each."""
    import numpy as np

    return np.unique(codes >> np.uint64(64 - bits), return_inverse=True)


def _ask(bits: int, buckets: int):
    """What a block asks of each bucket: its distinct grams, with how often its training documents hold them."""

    def each(batches):
        import numpy as np

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                _, out, n, vocabulary, ids, pair, triple, inner = _block(data.as_py())
                train = np.repeat(np.array([x is False for x in out]), n)
                orders = [(vocabulary, ids, train, 64), (*_distinct(pair, bits), train, bits), (*_distinct(triple[inner], bits), train[inner], bits)]
                del pair, triple
                for order, (codes, at, of, width) in enumerate(orders, 1):
                    count = np.bincount(at, weights=of, minlength=len(codes)).astype(np.uint64)
                    bucket = (codes >> np.uint64(width - buckets)).astype(np.int64)
                    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(codes)]
                    rows = [(block, int(bucket[a]), order, b - a, _pack(np.diff(codes[a:b], prepend=np.uint64(0)), count[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
                    for s in range(0, len(rows), 1000):
                        yield _batch(rows[s : s + 1000], ASKED)

    return each


def _groups(batches, *keys: str):
    """Runs of rows, which are sorted by the keys, as lists of dicts."""
    rows = (r for b in batches for r in b.to_pylist())
    for _, run in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield list(run)


def _answer(batches):
    """A bucket's counts for each block that asks; a bucket's part of the totals is a row of its own."""
    import numpy as np

    none, end = (0,) * 5, _hash([END])[0]
    for run in _groups(batches, "bucket", "order"):
        parts = [_unpack(r["data"], r["n"], 2) for r in run]
        codes = np.concatenate([np.cumsum(c, dtype=np.uint64) for c, _ in parts])
        count = np.concatenate([k for _, k in parts]).astype(np.float64)
        del parts
        codes, at = np.unique(codes, return_inverse=True)
        sums = np.bincount(at, weights=count, minlength=len(codes)).astype(np.int64)
        rows, a = [], 0
        for r in run:
            rows.append((r["block"], r["bucket"], r["order"], r["n"], _pack(sums[at[a : a + r["n"]]]), *none))
            a += r["n"]
            if len(rows) == 1000:
                yield _batch(rows, ANSWERS)
                rows = []
        if run[0]["order"] == 1:
            rows.append((None, None, 1, 0, None, int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()), int((sums == 2).sum()), int(sums[codes == end].sum())))
        yield _batch(rows, ANSWERS)


def log_weights(totals: Totals, first, one, two, three, inner, kinds, at):
    """The log10 weight that the automaton gives each token from the state that it is reached in.

    one, two, three: training counts of the token, of the pair and of the triple that end at it. The token's state is the
    longest context that training holds; an arc is taken where its gram was seen, else the failure arc's weight is
    added and the next shorter context is asked. kinds, at: log10 weights of the empty context's arcs, and each token's.
    """
    import numpy as np

    context = np.roll(one, 1)
    context[first] = totals.docs
    low = kinds[at]
    arc = np.log10((two + PULL[0] * 10**low) / (context + PULL[0]))
    low = np.where(two > 0, arc, np.log10(PULL[0] / (context + PULL[0])) + low)
    context = np.roll(two, 1)
    arc = np.log10((three + PULL[1] * 10**low) / (context + PULL[1]))
    deep = np.where(three > 0, arc, np.log10(PULL[1] / (context + PULL[1])) + low)
    return np.where(inner, deep, low)


def _score(totals: Totals, bits: int):
    def each(batches):
        import numpy as np

        for run in _groups(batches, "block"):
            own = next(r for r in run if r["order"] is None)
            docs, out, n, vocabulary, ids, pair, triple, inner = _block(own["data"])
            first = np.cumsum(n) - n
            counts = []
            for order, (size, at) in enumerate(((len(vocabulary), ids), *((len(c), at) for c, at in (_distinct(pair, bits), _distinct(triple[inner], bits)))), 1):
                got = [_unpack(r["data"], r["n"], 1)[0] for r in sorted((r for r in run if r["order"] == order), key=lambda r: r["bucket"])]
                found = np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64)
                if len(found) != size:
                    raise RuntimeError(f"block {own['block']}: {len(found)} answers for {size} grams of order {order}")
                counts.append(found[at])
            del pair, triple
            one, two, three = counts[0], counts[1], np.zeros(len(ids), np.int64)
            three[inner] = counts[2]
            kind, which = np.unique(one, return_inverse=True)
            base = np.add.reduceat(np.array([totals.base(int(x)) for x in kind])[which], first)
            known = np.add.reduceat((one > 0).astype(np.int64), first)
            score = np.zeros(len(n))
            if totals.tokens:
                score = np.add.reduceat(log_weights(totals, first, one, two, three, inner, np.array([totals.unigram(int(x)) for x in kind]), which), first)
            rows = list(zip(docs, out, n.tolist(), known.tolist(), itertools.repeat(totals.tokens, len(docs)), base.tolist(), score.tolist(), strict=True))
            for s in range(0, len(rows), 10_000):
                yield _batch(rows[s : s + 10_000], SCORES)

    return each


def score_documents(docs: DataFrame, folds: int = 5, held_out_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    The model learns the pairs and triples of all tokens of rows whose crc32(doc_id as text) mod ``folds`` isn't
    ``held_out_fold``, whatever their number. Tokens are counted by 64-bit hashes, longer grams by codes whose bits follow
    the number of tokens (SPARE). Codes are even, so no word or context, however frequent, makes a task larger.
    Null and empty texts are the end token alone; a very long text is a block of its own; rows with a null id are scored,
    in no fold; without training rows every score is 0; repeated rows score alike; other columns aren't read; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    d = id_text(docs).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out_fold)
    blocks = stash(d.mapInArrow(_blocks(BLOCK_CHARS), BLOCKS))
    number, chars, tokens = blocks.agg(F.count("*"), F.sum("chars"), F.sum("tokens")).first()
    if not number:
        drop_stash(blocks)
        return spark.createDataFrame([], SCORES)
    buckets = max(1, ((chars or 0) // BUCKET_CHARS).bit_length())
    bits = min(64, max(LEAST_BITS, tokens.bit_length() + SPARE))
    asked = blocks.select("block", "data").mapInArrow(_ask(bits, buckets), ASKED).repartition(min(TASKS, 2**buckets), "bucket").sortWithinPartitions("bucket", "order", "block")
    answers = stash(asked.mapInArrow(_answer, ANSWERS))
    t = answers.where("block is null").agg(*(F.sum(c).alias(c) for c in ("tokens", "words", "once", "twice", "docs"))).first()
    totals = Totals(t["tokens"] or 0, t["words"] or 0, min(0.95, max(0.1, t["once"] / max(1, t["once"] + 2 * t["twice"]))), t["docs"] or 0)
    own = blocks.select("block", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("int").alias("order"), F.lit(None).cast("long").alias("n"), "data")
    given = answers.where("block is not null").select("block", "bucket", "order", "n", "data")
    met = own.unionByName(given).repartition(min(TASKS, number), "block").sortWithinPartitions("block")
    return met.mapInArrow(_score(totals, bits), SCORES)
