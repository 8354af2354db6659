"""Line dedup by a log-template tree: lines and passages that follow a template found across documents are dropped.

The tree's levels are the number of tokens and LEAD leading tokens; a leaf holds templates. Tokens with digits, addresses and the like
are fields from the start. In a leaf, a line joins the template that agrees with it in most tokens, and where the two
differ the template gets a field. A sentence within a line is a unit of its own, found as it stands or not at all, so that a
passage is seen wherever lines break around it.

Documents are cut into blocks. A block asks for each of its distinct units once, in one row for a bucket of leaves;
a bucket merges what all blocks ask and answers each of them, so a line in every document is a row for each block.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import lean, stash, whole_rows
from .lm import _mix, _pack, _unpack

#: A token of one of these kinds is a field wherever it stands.
FIELD = re.compile(r"\S*[0-9@]\S*|https?://\S+")
SENTENCE_END = re.compile(r"(?<=[.!?])(?=[ \t])")
#: Leading tokens of a leaf, and tokens from which on a line's template may get more fields.
LEAD, GENERAL = 2, 8
#: The share of a line's tokens that must agree with a template's, and how many places of a long line are compared.
ALIKE, SIGNS = 0.7, 64
#: Documents that a template must be found in before its lines go: few tokens recur by chance. A line or a run of sentences
#: of PASSAGE tokens goes from two documents on.
MOST, FEW_TOKENS, FEW_DOCS, PASSAGE = 3, 4, 10, 50
#: Tokens of a sentence that is a unit.
SENTENCE = 12
#: Characters of a block of documents and those of all blocks for a bucket, and keys of a leaf's lines that are sorted at once.
#: No result depends on them.
BLOCK_CHARS, BUCKET_CHARS, SPREAD = 8_000_000, 24_000_000, 200_000
TASKS = 20_000


def spans(text: str):
    """(line, sentence or -1, unit) of a text: each line that isn't blank, then its long sentences if it has several."""
    for i, line in enumerate(text.split("\n")):
        if line.strip():
            yield i, -1, line
            if len(line) > 60 and len(parts := SENTENCE_END.split(line)) > 1:
                for k, part in enumerate(parts):
                    if part.count(" ") >= SENTENCE:
                        yield i, k, part


def parse(units: list[str]):
    """For each unit: its tokens, tokens that are no fields, code, leaf and signs (a byte for each place compared, 0 for a
    field), as arrays; the signs one after the other."""
    import numpy as np
    import xxhash

    parts = pc.ascii_split_whitespace(pa.array(units, pa.large_string()))
    found = parts.flatten().dictionary_encode()
    names = [x.lower() for x in found.dictionary.to_pylist()]
    kinds = np.fromiter((0 if FIELD.fullmatch(x) else xxhash.xxh3_64_intdigest(x) | 1 for x in names), np.uint64, len(names))
    at, bounds = found.indices.to_numpy(), parts.offsets.to_numpy()
    real = np.array([bool(x) for x in names] or [False])[at] if len(at) else np.zeros(0, bool)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(real)])
    n = before[bounds[1:]] - before[bounds[:-1]]
    tokens, first = kinds[at[real]], before[bounds[:-1]]
    place = np.arange(len(tokens)) - np.repeat(first, n)
    code = _mix(np.add.reduceat(_mix(tokens, place.astype(np.uint64)), first), n.astype(np.uint64))
    lead = [np.where(n > k, tokens[np.minimum(first + k, len(tokens) - 1)], np.uint64(7)) for k in range(LEAD)]
    leaf = n.astype(np.uint64)
    for x in lead:
        leaf = _mix(leaf, x)
    shown = np.minimum(n, SIGNS)
    start = np.cumsum(shown) - shown
    of = np.repeat(np.arange(len(n)), shown)
    sign = tokens[first[of] + (np.arange(len(of)) - start[of]) * n[of] // shown[of]]
    sign = np.where(sign == 0, 0, (sign >> np.uint64(32)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return n, np.add.reduceat((tokens != 0).astype(np.int64), first), code, leaf, sign, start


def _shared_runs(signs, runs: int):
    """line, key: which lines have a run of places in common with another, the places after LEAD cut into so many runs. A run
    with a field is nobody's."""
    import numpy as np

    count, width = signs.shape
    cuts = np.linspace(LEAD if width - LEAD >= runs else 0, width, runs + 1).astype(np.int64)
    lines, keys, known, step = [], [], 0, max(1, SPREAD // count)
    for a in range(0, runs, step):
        first, end = cuts[a : min(a + step, runs)], cuts[a + 1 : min(a + step, runs) + 1]
        key, whole = np.tile(np.arange(len(first), dtype=np.uint64), (count, 1)), np.ones((count, len(first)), bool)
        for k in range(int((end - first).max())):
            sign = signs[:, np.minimum(first + k, end - 1)]
            key = key * np.uint64(257) + sign
            whole &= sign != 0
        key = _mix(key, np.arange(len(first), dtype=np.uint64))[whole]
        by = np.argsort(key, kind="stable")
        key = key[by]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        of = np.cumsum(new) - 1
        some = np.bincount(of)[of] > 1 if len(key) else new
        lines.append(np.nonzero(whole)[0][by][some])
        keys.append(known + of[some])
        known += len(key)
    return np.concatenate(lines), np.concatenate(keys)


def grow(signs, alike: float = ALIKE):
    """The template that each line joins, by the number of its first line, lines in order: the one that agrees in most places, if
    these are enough, which then has fields where the line differs; else one of its own.

    The places are cut into one run more than may differ. A line that joins a template has then a whole run in common with
    the template's first line, so only templates that share one are compared, and none is missed.
    """
    import numpy as np

    count, width = signs.shape
    joined = np.arange(count)
    lines, keys = _shared_runs(signs, width - math.ceil(alike * width) + 1)
    if not len(lines):
        return joined
    templates, begun = signs.copy(), defaultdict(list)
    by = np.argsort(lines, kind="stable")
    lines, keys = lines[by], keys[by].tolist()
    cuts = [0, *(np.flatnonzero(np.diff(lines)) + 1).tolist(), len(lines)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        i = int(lines[a])
        line = signs[i]
        near = np.array(sorted(set(itertools.chain.from_iterable(begun[k] for k in keys[a:b]))), np.int64)
        if len(near):
            same = ((templates[near] == line) & (line != 0)).sum(axis=1)
            best = int(np.argmax(same))
            if same[best] >= alike * width:
                joined[i] = near[best]
                templates[near[best]][templates[near[best]] != line] = 0
                continue
        for k in keys[a:b]:
            begun[k].append(i)
    return joined


ROWS = "block long, bucket long, n long, data binary, rows binary"


def _zigzag(ids):
    """Signed ids as unsigned ones, small for small."""
    import numpy as np

    return (ids.view(np.uint64) << np.uint64(1)) ^ (ids >> 63).view(np.uint64)


def _signed(ids):
    import numpy as np

    return (ids >> np.uint64(1)).view(np.int64) ^ -(ids & np.uint64(1)).view(np.int64)


def _needed(n, min_docs: int):
    """Documents that a template of n tokens must be found in."""
    import numpy as np

    return np.where(n < FEW_TOKENS, max(FEW_DOCS, min_docs), min_docs)


def _more_docs(n, number, min_docs: int):
    """How many documents beyond its first a block names of a unit of n tokens that ``number`` of its documents hold. With as many
    as a template needs, and two for a passage, different documents are counted exactly up to there, wherever the blocks'
    borders are and however many rows of a document they part."""
    import numpy as np

    return np.minimum(number.astype(np.int64), np.maximum(_needed(n, min_docs), 2)) - 1


def _blocks(block_chars: int, buckets: int, min_docs: int, schema_names: list[str]):
    """A block's rows, with the units of each document and each unit's place among the distinct ones; and what it asks."""

    def each(batches):
        import numpy as np
        from pyspark import TaskContext

        block, held, chars = TaskContext.get().partitionId() << 32, [], 0

        def close():
            table = pa.Table.from_batches(held)
            texts, docs = table.column("_text").to_pylist(), table.column("_doc").to_pylist()
            count, units, lines = [], [], []
            for doc, text in zip(docs, texts, strict=True):
                own = [] if text is None or doc is None else list(spans(text))
                count.append(len(own))
                units += [u for _, _, u in own]
                lines += [k < 0 for _, k, _ in own]
            table, sink = table.select(["row", "_doc"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(table.combine_chunks())
            rows = [(block, None, 0, _pack(np.array(count, np.uint64)) if count else None, sink.getvalue().to_pybytes())]
            at = np.zeros(0, np.int64)
            if units:
                n, fixed, code, leaf, sign, start = parse(units)
                is_line = np.array(lines) & (n >= GENERAL)
                doc = np.repeat(np.array([0 if d is None else d for d in docs], np.int64), count)
                able = np.flatnonzero(2 * fixed >= n)
                # a sentence and a line of the same tokens are two units
                name = _mix(code, is_line.astype(np.uint64))
                kinds, one, of = np.unique(name[able], return_index=True, return_inverse=True)
                order = np.lexsort((doc[able], of))
                new = np.ones(len(order), bool)
                new[1:] = (of[order][1:] != of[order][:-1]) | (doc[able][order][1:] != doc[able][order][:-1])
                number = np.bincount(of[order][new], minlength=len(kinds))
                head = np.searchsorted(of[order], np.arange(len(kinds)))
                least, one = doc[able][order][head], able[one]
                held_docs, held_from = doc[able][order][new], np.cumsum(number) - number
                # a line that may join others goes by its leaf, anything else by its own code
                bucket = (np.where(is_line[one], leaf[one], code[one]) >> np.uint64(64 - buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                rank = np.empty(len(by), np.int64)
                rank[by] = np.arange(len(by))
                at = np.full(len(units), len(kinds), np.int64)
                at[able] = rank[of]
                cuts = [0, *(np.flatnonzero(np.diff(bucket[by])) + 1).tolist(), len(by)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    some = by[a:b]
                    u = one[some]
                    shown = np.where(is_line[u], np.minimum(n[u], SIGNS), 0)
                    signs = sign[np.repeat(start[u] - (np.cumsum(shown) - shown), shown) + np.arange(shown.sum())]
                    data = _pack(np.diff(kinds[some], prepend=np.uint64(0)), leaf[u] >> np.uint64(24), n[u], is_line[u].astype(np.uint64), number[some], _zigzag(least[some]))
                    more = _more_docs(n[u], number[some], min_docs)
                    next_docs = _zigzag(held_docs[np.repeat(held_from[some] + 1 - (np.cumsum(more) - more), more) + np.arange(more.sum())])
                    docs_ = _pack(next_docs) if len(next_docs) else b""
                    rows.append((block, int(bucket[some[0]]), b - a, len(data).to_bytes(8, "little") + data + len(docs_).to_bytes(8, "little") + docs_ + pa.compress(signs.tobytes(), codec="zstd", asbytes=True), None))
            rows[0] = (block, None, len(at), len(rows[0][3] or b"").to_bytes(8, "little") + (rows[0][3] or b"") + (_pack(at) if len(at) else b""), rows[0][4])
            return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 500], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=schema_names) for s in range(0, len(rows), 500)]

        for batch in batches:
            start = 0
            for k, size in enumerate(pc.binary_length(batch.column("_text")).to_pylist()):
                chars += size or 0
                if chars > block_chars:
                    held.append(batch.slice(start, k + 1 - start))
                    yield from close()
                    block, held, chars, start = block + 1, [], 0, k + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from close()

    return each


def _runs(batches, *keys: str):
    rows = (r for b in batches for r in b.to_pylist())
    for _, run in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield list(run)


def _judge(min_docs: int):
    """A bucket's answer to each block: for each unit 2 if its template is found often enough, 1 if in two documents and long
    enough for a passage, else 0; and the first document that holds it."""

    def each(batches):
        import numpy as np

        for run in _runs(batches, "bucket"):
            parts, signs, others = [], [], [np.zeros(0, np.uint64)]
            for r in run:
                data = r["data"]
                size = int.from_bytes(data[:8], "little")
                c = _unpack(data[8 : 8 + size], r["n"], 6)
                c[0] = np.cumsum(c[0], dtype=np.uint64)
                parts.append(c)
                at = 16 + size + int.from_bytes(data[8 + size : 16 + size], "little")
                if at > 16 + size:
                    others += _unpack(data[16 + size : at], int(_more_docs(c[2], c[4], min_docs).sum()), 1)
                shown = int(np.where(c[3] > 0, np.minimum(c[2], SIGNS), 0).sum())
                signs.append(np.frombuffer(pa.decompress(data[at:], shown, codec="zstd", asbytes=True), np.uint8))
            name, leaf, n, is_line, number, least = (np.concatenate(x) for x in zip(*parts, strict=True))
            least, others = _signed(least), _signed(np.concatenate(others))
            signs, n = np.concatenate(signs), n.astype(np.int64)
            shown = np.where(is_line > 0, np.minimum(n, SIGNS), 0)
            start = np.cumsum(shown) - shown
            kinds, one, of = np.unique(name, return_index=True, return_inverse=True)
            # the documents of each unit, in order and each once
            met, met_docs = np.concatenate([of, np.repeat(of, _more_docs(n, number, min_docs))]), np.concatenate([least, others])
            by = np.lexsort((met_docs, met))
            met, met_docs = met[by], met_docs[by]
            new = np.append(True, (met[1:] != met[:-1]) | (met_docs[1:] != met_docs[:-1]))
            met, met_docs = met[new], met_docs[new]
            bounds = np.searchsorted(met, np.arange(len(kinds) + 1))
            docs, first, size = np.diff(bounds), met_docs[bounds[:-1]], n[one]
            status = np.where(docs >= _needed(size, min_docs), 2, np.where((docs >= 2) & (size >= SENTENCE), 1, 0))
            # lines of a leaf join templates
            lines = np.flatnonzero(is_line[one] > 0)
            lines = lines[np.lexsort((kinds[lines], size[lines], leaf[one][lines]))]
            key = np.stack([leaf[one][lines], size[lines].astype(np.uint64)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(lines)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                group = lines[a:b]
                width = int(shown[one[group[0]]])
                joined = grow(signs[start[one[group]][:, None] + np.arange(width)])
                if (joined == np.arange(b - a)).all():
                    continue
                by = np.argsort(joined, kind="stable")
                for own in np.split(group[by], np.flatnonzero(np.diff(joined[by])) + 1):
                    if len(own) < 2:
                        continue
                    seen = np.unique(np.concatenate([met_docs[bounds[k] : bounds[k + 1]] for k in own]))
                    if len(seen) >= _needed(size[own[0]], min_docs):
                        status[own], first[own] = 2, seen[0]
            rows, a = [], 0
            for r in run:
                k = of[a : a + r["n"]]
                a += r["n"]
                hits = status[k] > 0
                data = _pack(status[k])
                rows.append((r["block"], r["bucket"], r["n"], len(data).to_bytes(8, "little") + data + first[k][hits].tobytes(), None))
            for s in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 500], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])

    return each


def cut(text: str, doc: int, status: list[int], first: list[int]) -> tuple[str, int, int]:
    """A text less what recurs, the lines that went, and the sentences that went from others.

    What is found in two documents only goes as a passage (PASSAGE tokens in a line or in sentences that follow each
    other), and not from a document most of whose words are so found: that is a copy, which near-dedup takes whole.
    """
    found = list(spans(text))
    gone = {(i, k): s if doc != f else 0 for (i, k, _), s, f in zip(found, status, first, strict=True)}
    size = {(i, k): len(u.split()) for i, k, u in found}
    lines = text.split("\n")
    words = sum(n for (_, k), n in size.items() if k < 0)
    weak = sum(max(size[i, -1] if gone[i, -1] else 0, sum(n for (j, k), n in size.items() if j == i and k >= 0 and gone[j, k])) for i in {i for (i, _), s in gone.items() if s}) <= words / 2
    out, dropped, sentences = [], 0, 0
    for i, line in enumerate(lines):
        mark = gone.get((i, -1), 0)
        if mark == 2 or mark == 1 and weak and size[i, -1] >= PASSAGE:
            dropped += 1
            continue
        if not any(gone.get((i, k)) for k in range(line.count(".") + line.count("!") + line.count("?") + 1)):
            out.append(line)
            continue
        parts = SENTENCE_END.split(line)
        marks = [gone.get((i, k)) for k in range(len(parts))]  # None: too short to be told
        drop = [m == 2 for m in marks]
        at = 0
        while weak and at < len(parts):
            if not marks[at]:
                at += 1
                continue
            end = at
            while end < len(parts) and (marks[end] or marks[end] is None and any(marks[end:])):
                end += 1
            while end > at and not marks[end - 1]:
                end -= 1
            if sum(len(p.split()) for p in parts[at:end]) >= PASSAGE:
                drop[at:end] = [True] * (end - at)
            at = end
        rest = "".join(p for p, d in zip(parts, drop, strict=True) if not d)
        if rest.strip():
            sentences += sum(drop)
            out.append(rest.lstrip(" \t") if drop[0] else rest)
        else:
            dropped += 1
    return "\n".join(out), dropped, sentences


def _finish(own: list[str], shape):
    def each(batches):
        import numpy as np

        for run in _runs(batches, "block"):
            block = next(r for r in run if r["bucket"] is None)
            table = pa.ipc.open_stream(block["rows"]).read_all()
            size = int.from_bytes(block["data"][:8], "little")
            count = _unpack(block["data"][8 : 8 + size], table.num_rows, 1)[0].astype(np.int64) if size else np.zeros(table.num_rows, np.int64)
            at = _unpack(block["data"][8 + size :], block["n"], 1)[0].astype(np.int64) if block["n"] else np.zeros(0, np.int64)
            status, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in sorted((r for r in run if r["bucket"] is not None), key=lambda r: r["bucket"]):
                size = int.from_bytes(r["data"][:8], "little")
                s = _unpack(r["data"][8 : 8 + size], r["n"], 1)[0].astype(np.int64)
                f = np.zeros(len(s), np.int64)
                f[s > 0] = np.frombuffer(r["data"][8 + size :], np.int64)
                status.append(s)
                first.append(f)
            # the last place is that of units that can't recur
            status, first = (np.concatenate([*x, np.zeros(1, np.int64)]) for x in (status, first))
            if len(at) and at.max() >= len(status):
                raise RuntimeError(f"block {block['block']}: {len(status) - 1} answers for {at.max()} units")
            row = table.column("row").combine_chunks()
            texts, docs = pc.struct_field(row, own.index("text")).to_pylist(), table.column("_doc").to_pylist()
            ends = np.cumsum(count)
            lines = [0 if t is None else t.count("\n") + 1 for t in texts]
            dropped, sentences = [0] * len(texts), [0] * len(texts)
            for k in np.flatnonzero(np.add.reduceat(np.append(status[at], 0), np.minimum(ends - count, len(at))) * (count > 0)) if len(at) else ():
                mine = at[ends[k] - count[k] : ends[k]]
                texts[k], dropped[k], sentences[k] = cut(texts[k], docs[k], status[mine].tolist(), first[mine].tolist())
            columns = [pa.array(texts, pa.string()) if c == "text" else pc.struct_field(row, own.index(c)) for c in own]
            made = pa.Table.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sentences, pa.int64())], names=shape)
            yield from made.to_batches(max_chunksize=10_000)

    return each


def dedup_lines(docs: DataFrame, min_docs: int = MOST) -> DataFrame:
    """All rows and columns of ``docs`` with text less what recurs, and n_lines, n_dropped and n_cut (long) added: lines, lines
    dropped, and sentences cut from others.

    A line or long sentence goes if its template is found in at least ``min_docs`` documents (FEW_DOCS if it has few
    tokens), other than in the first of them (smallest doc_id), which keeps it: what a text says stays in the corpus once.
    Passages of PASSAGE tokens go from two documents on, but not from copies. A template needs as many fixed tokens as
    fields. A document counts once for a line however often it holds it.
    Null texts stay null, with no lines; blank lines and lines of rows without doc_id stay; very long texts are blocks of
    their own; repeated rows are treated alike; a clash with an added name replaces the column; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "n_cut")]
    d = whole_rows(docs.select(*(F.col(f"`{c}`") for c in own)))
    d = d.select("row", F.col("row.doc_id").cast("long").alias("_doc"), F.col("row.text").alias("_text"))
    chars = d.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(1, (chars // BUCKET_CHARS).bit_length())
    names = [x.split()[0] for x in ROWS.split(", ")]
    made = stash(d.mapInArrow(lean(_blocks(BLOCK_CHARS, buckets, min_docs, names)), ROWS))
    asked = made.where("bucket is not null").drop("rows").repartition(min(TASKS, 2**buckets), "bucket").sortWithinPartitions("bucket", "block")
    answers = asked.withColumn("rows", F.lit(None).cast("binary")).mapInArrow(lean(_judge(min_docs)), ROWS)
    blocks = made.where("bucket is null")
    met = blocks.unionByName(answers).repartition(min(TASKS, max(1, -(-chars // BLOCK_CHARS))), "block").sortWithinPartitions("block", F.col("bucket").isNotNull())
    kinds = [f"`{c}` {'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in own]
    return met.mapInArrow(lean(_finish(own, [*own, "n_lines", "n_dropped", "n_cut"])), ", ".join([*kinds, "n_lines long", "n_dropped long", "n_cut long"]))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` less recurring lines and passages; a document of which no word is left goes, n_chars follows the text.

    Null and empty texts stay as they are, as do rows without doc_id; other cases are those of ``dedup_lines``.
    """
    d = dedup_lines(docs).where("n_dropped + n_cut = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("n_dropped") + F.col("n_cut") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)
