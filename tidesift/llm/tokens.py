"""Token counts and token ids of whole texts, computed once per distinct pre-token."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_text, kept, stash

#: Entries of a worker's table while it gathers; at this size it is emptied, which costs time only.
TABLE_ENTRIES = 400_000
#: Chunks of a generation of the table of ids that a worker keeps, at some 200 bytes each; there are two generations.
CHUNK_ENTRIES = 500_000
#: Pre-tokens that workers hold with their counts, the most frequent; all others are joined.
HELD = 300_000
#: Characters of a block of documents, for which a rarer pre-token is one row.
BLOCK_CHARS = 8_000_000


class Pieces:
    """A SentencePiece model seen through pre-tokens.

    Where no piece has a space mark or a line end after another character, no merge crosses the place before one: texts
    are cut there, and the counts of their pre-tokens add up to the library's exactly. Other models are refused.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(self.MARK in p.lstrip(self.MARK) or "\n" in p for p in pieces) or self.MARK not in pieces:
            raise ValueError(f"{path}: pieces run across spaces or line ends")

    def split(self, text: str) -> list[str]:
        """Pre-tokens: what stands after a space mark, less one mark, or from a line end on."""
        if self.MARK in text:
            text = text.replace(self.MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [x if x[0] == "\n" else x[1:] for x in re.findall(r"\n[^ \n]*| +[^ \n]*", " " + text)]
        return text.replace("\n", " \n").split(" ") if text else []

    def count(self, tokens: list[str]) -> list[int]:
        """Pieces of each pre-token. The library puts a space mark before each text: alone it is a piece, and none of a line end's."""
        found = self.model.encode(tokens, num_threads=1)
        return [1 if not t else len(ids) - (t[0] == "\n") for t, ids in zip(tokens, found, strict=True)]


def _once(kind, *args):
    """One model with its table for each worker process, kept between tasks that use it."""
    if (kind, args) not in kept:
        kept[kind, args] = kind(*args)
    return kept[kind, args]


def slices(texts: pa.Array, most: int = 8_000_000) -> Iterator[pa.Array]:
    """Parts of a batch of about ``most`` bytes, so that working memory doesn't follow the batch."""
    start = size = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size > most:
            yield texts.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < len(texts):
        yield texts.slice(start)


def distinct_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """token, c (its frequency), n (its pieces): each distinct pre-token of the corpus, counted by the model once."""

    def gather(batches):
        model, found = _once(Pieces, model_path), Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "c"])
            found.clear()
            return made

        for batch in batches:
            for text in batch.column("text"):
                found.update(model.split(text.as_py()))
                if len(found) > TABLE_ENTRIES:
                    yield out()
        yield out()

    def count(batches):
        model = _once(Pieces, model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("c"), pa.array(model.count(batch.column("token").to_pylist()), pa.int64())], names=["token", "c", "n"])

    each = docs.select("text").mapInArrow(gather, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))
    return each.mapInArrow(count, "token string, c long, n long")


def most_frequent(counts: DataFrame, most: int) -> int | None:
    """The least c of at most ``most`` most frequent rows, from a histogram of at most 256 rows; None if even the first step
    of a quarter of a power of two holds more."""
    steps = counts.groupBy(F.floor(4 * F.log2("c")).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    least = None
    for r in sorted(steps, key=lambda r: -r["step"]):
        most -= r["n"]
        if most < 0:
            break
        least = r["least"]
    return least


PARTS = "block long, i int, doc_id long, n_bytes long, n_tokens long, token string, docs array<int>"


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, held: int = HELD) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit for each row of ``docs``.

    Pieces are counted once for each distinct pre-token of the corpus, and that table is joined to the documents'
    pre-token frequencies; no document's ids are ever materialised. Workers hold the ``held`` most frequent
    pre-tokens and sum those at once. Others are joined to the table as one row for a pre-token and a block of documents,
    with the documents it stands in as often as it does, so no pre-token has more rows than there are blocks.
    Null and empty texts count 0, null ids stay null. A very long text is split by words and never held as ids. Repeated
    rows and ids give a row each; columns but doc_id and text aren't read, whatever their names; an empty table gives no rows.
    """
    d = id_text(docs)
    counts = stash(distinct_tokens(d, model_path))
    least = most_frequent(counts, held)
    top = counts.where(F.col("c") >= (least if least is not None else 2**62)).select("token", "n").toArrow().to_pydict()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(top["token"], top["n"], strict=True)))

    def traverse(batches):
        from pyspark import TaskContext

        model, known = _once(Pieces, model_path), shared.value
        block = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in PARTS.split(", ")]
        rows: list[tuple] = []
        rare: dict[str, list[int]] = {}
        size = 0

        def close():
            nonlocal block, rows, rare, size
            n, m = len(rows), len(rare)
            offsets = [0, *itertools.accumulate(map(len, rare.values()))]
            docs_ = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(itertools.chain.from_iterable(rare.values())), pa.int32()))
            own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            out = [pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *own, pa.nulls(n, pa.string()), pa.nulls(n, docs_.type)], names=names),
                   pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), *(pa.nulls(m, c.type) for c in own), pa.array(list(rare), pa.string()), docs_], names=names)]
            block, rows, rare, size = block + 1, [], {}, 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                i, total = len(rows), 0
                for t in model.split(text):
                    n = known.get(t)
                    if n is None:
                        rare.setdefault(t, []).append(i)
                    else:
                        total += n
                rows.append((i, doc, len(text.encode()), total))
                size += len(text)
                if size > BLOCK_CHARS:
                    yield from close()
        yield from close()

    parts = stash(d.mapInArrow(traverse, PARTS))
    others = counts.where(F.col("c") < least) if least is not None else counts
    met = parts.where("token is not null").select("block", "token", "docs").join(others.select("token", "n"), "token")
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("i", "int"), ("doc_id", "long"), ("n_bytes", "long"), ("n_tokens", "long"))]
    met = met.select("block", *blank, "docs", "n")
    rows = parts.where("token is null").select("block", "i", "doc_id", "n_bytes", "n_tokens", "docs", F.lit(0).cast("long").alias("n"))

    def add(batches):
        """Sums of one block at a time, as rows come in order of blocks."""
        import numpy as np

        now, found, sums = None, [], np.zeros(0, np.int64)

        def close():
            for x in found:
                i = x.column("i").to_numpy()
                n = x.column("n_tokens").to_numpy() + np.concatenate([sums, np.zeros(max(0, int(i.max()) + 1 - len(sums)), np.int64)])[i]
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    yield from close()
                    now, found, sums = block[a], [], np.zeros(0, np.int64)
                part = batch.slice(a, b - a)
                is_token = part.column("docs").is_valid()
                if (own := part.filter(pc.invert(is_token))).num_rows:
                    found.append(own)
                if (some := part.filter(is_token)).num_rows:
                    at = some.column("docs").flatten().to_numpy()
                    n = np.repeat(some.column("n").to_numpy(), np.diff(some.column("docs").offsets.to_numpy()))
                    more = np.bincount(at, weights=n, minlength=len(sums)).astype(np.int64)
                    more[: len(sums)] += sums
                    sums = more
        yield from close()

    return rows.unionByName(met).repartition("block").sortWithinPartitions("block").mapInArrow(add, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class WordIds:
    """Token ids (unsigned little-endian 32-bit) of a tokenizer that drops white space, by chunk between spaces.

    Its normaliser and its splitting look at no more than a chunk, so ids of a text are those of its chunks in
    order; those of a word with marks after it are the word's and the marks'. A batch's distinct chunks are looked up once
    and their ids laid out by position. Tables hold two generations of chunks: what was met lately outlives what wasn't,
    so a full table never loses its frequent chunks. Words in small letters go to the bare merge model, all that is
    new at once; other chunks go through the whole tokenizer, parted by a special token that stands for no text.
    """

    def __init__(self, path: str, entries: int = CHUNK_ENTRIES):
        import json
        import os
        from pathlib import Path

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = json.loads(Path(path).read_text())
        self.model = Tokenizer.from_str(json.dumps(made))
        self.model.no_truncation()
        self.model.no_padding()
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.mark = self.added[0]
        self.mark_id = self.model.token_to_id(self.mark)
        self.entries, self.young, self.old = entries, {}, {}
        self.bare = self.ends = None
        if suffix := made["model"].get("end_of_word_suffix"):
            import numpy as np

            self.bare = Tokenizer.from_str(json.dumps({"version": "1.0", "added_tokens": [], "model": made["model"]}))
            self.ends = np.zeros(1 + max(made["model"]["vocab"].values()), bool)
            self.ends[[i for w, i in made["model"]["vocab"].items() if w.endswith(suffix)]] = True
            self.bytes = byte_letters()

    @staticmethod
    def stem(chunk: str) -> tuple[str, str] | None:
        """A word in lower case and the marks after it, where the tokenizer's splitting surely parts the two."""
        word = chunk if chunk.isalpha() else chunk.rstrip(".,;:!?")
        if word.isascii() and word.isalpha() or word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
            return word.lower(), chunk[len(word) :]
        return None

    def plain(self, words: list[str]) -> list[bytes]:
        """Ids of words that ``stem`` gave: the bare model reads their bytes as letters; an end mark shows where a word ends."""
        import numpy as np

        if self.bare is None:
            return self.other(words)
        out = []
        for k in range(0, len(words), 8192):
            some = words[k : k + 8192]
            ids = np.array(self.bare.encode([w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in some], is_pretokenized=True, add_special_tokens=False).ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) != len(some):
                out += self.other(some)
                continue
            raw, cuts = ids.tobytes(), [0, *cuts.tolist()]
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def other(self, chunks: list[str]) -> list[bytes]:
        """Ids of any chunks, by the whole tokenizer."""
        import numpy as np

        found: dict[str, bytes] = {}
        plain = [c for c in chunks if not any(m in c for m in self.added)]
        for k in range(0, len(plain), 16_384):
            some = plain[k : k + 16_384]
            groups = [some[i : i + 256] for i in range(0, len(some), 256)]
            for group, made in zip(groups, self.model.encode_batch_fast([self.mark.join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(made.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.mark_id)
                if len(cuts) != len(group) - 1:
                    raise ValueError("the marks between chunks were lost")
                raw, starts, ends = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
                found.update((w, raw[a:b]) for w, a, b in zip(group, starts, ends, strict=True))
        return [found[c] if c in found else np.array(self.model.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() for c in chunks]

    def ids_of(self, chunks: list[str], make=None) -> list[bytes]:
        """Ids of distinct chunks, from the tables or made and kept."""
        young, old = self.young, self.old
        out = list(map(young.get, chunks))
        lost = [k for k, ids in enumerate(out) if ids is None]
        names = [chunks[k] for k in lost]
        found = list(map(old.get, names)) if old else [None] * len(names)
        if new := [c for c, ids in zip(names, found, strict=True) if ids is None]:
            made = dict(zip(new, (make or self.learn)(new), strict=True))
            young.update(made)
            found = [made[c] if ids is None else ids for c, ids in zip(names, found, strict=True)] if old else list(made.values())
        if old:
            young.update(zip(names, found, strict=True))
        for k, ids in zip(lost, found, strict=True):
            out[k] = ids
        return out

    def learn(self, chunks: list[str]) -> list[bytes]:
        parts = [self.stem(c) for c in chunks]
        words = list({p[0] for p in parts if p})
        rest = list({c for c, p in zip(chunks, parts, strict=True) if p is None} | {p[1] for p in parts if p and p[1]})
        known = dict(zip(words, self.ids_of(words, self.plain), strict=True)) | dict(zip(rest, self.ids_of(rest, self.other), strict=True))
        return [known[c] if p is None else known[p[0]] + known[p[1]] if p[1] else known[p[0]] for c, p in zip(chunks, parts, strict=True)]

    def encode(self, texts) -> list[bytes]:
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        found = parts.flatten().dictionary_encode()
        ids = self.ids_of(found.dictionary.to_pylist())
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        placed = list(map(ids.__getitem__, found.indices.to_numpy().tolist()))
        cuts = parts.offsets.to_numpy().tolist()
        return [b"".join(placed[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def byte_letters() -> dict[int, str]:
    """The letters that byte-level models write bytes as: printable Latin-1 as it is, all others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
