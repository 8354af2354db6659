"""Best-fit packing of token sequences by bin completion."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import id_text, lean, stash
from .tokens import WordIds, _once, slices

END_ID = b"\x01\x00\x00\x00"


# ---------------------------------------------------------------- the plan, over a histogram of lengths


@dataclass(frozen=True)
class Pattern:
    """``bins`` equal sequences, each holding ``times`` pieces of ``length`` for every slot, largest first."""

    bins: int
    slots: tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal sequences are handled together, so work follows the number of lengths."""
    open_: dict[int, list[tuple[int, tuple]]] = {}  # free room -> [(bins, slots)]
    rooms: list[int] = []

    def put(room: int, bins: int, slots: tuple) -> None:
        if bins:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((bins, slots))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                put(capacity - each * length, left // each, ((length, each),))
                put(capacity - left % each * length, int(left % each > 0), ((length, left % each),))
                break
            room = rooms[k]
            bins, slots = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[k]
            each = room // length
            full = min(bins, left // each)
            put(room - each * length, full, (*slots, (length, each)))
            left -= full * each
            if full < bins:
                put(room - left * length, int(left > 0), (*slots, (length, left)))
                put(room, bins - full - (left > 0), slots)
                left = 0
    return [Pattern(bins, slots) for groups in open_.values() for bins, slots in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: the total, plus the room that no small piece can use beside the large ones."""
    import numpy as np

    pieces = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        pieces[length] = n
    number, size = np.cumsum(pieces), np.cumsum(pieces * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(1, half + 1)
    big = number[-1] - number[capacity - k]
    mid, mid_size = number[capacity - k] - number[half], size[capacity - k] - size[half]
    small = size[half] - size[k - 1]
    rest = small - (mid * capacity - mid_size)
    found = big + mid + np.maximum(0, -(-rest // capacity))
    return int(max(-(-size[-1] // capacity), found.max(initial=0)))


class _Steps:
    """How many choices a search may still look at."""

    def __init__(self, left: int):
        self.left = left

    def more(self) -> bool:
        self.left -= 1
        return self.left >= 0


def sums_of(there: int, capacity: int) -> int:
    """The bits of all totals up to the capacity that lengths, given as bits, can make if each may be taken again and again.

    A length that shorter ones make already adds nothing, so few are worked through, however many there are.
    """
    full, out = (2 << capacity) - 1, 1
    while new := there & ~out & full:
        step = (new & -new).bit_length() - 1
        while step <= capacity:
            out |= out << step & full
            step *= 2
    return out


def exact(total: int, largest: int, counts: list[int], there: int, reach: int, taken: tuple[int, ...], steps: _Steps) -> Iterator[tuple[int, ...]]:
    """Pieces, none above ``largest``, that add up to a total: larger ones first. there: the bits of lengths that are left;
    taken: pieces that counts still holds."""
    if not total:
        yield ()
        return
    left = there & (2 << min(total, largest)) - 1
    while left and steps.more():
        l = left.bit_length() - 1
        left ^= 1 << l
        if reach >> (total - l) & 1 and counts[l] > taken.count(l):
            for rest in exact(total - l, l, counts, there, reach, (*taken, l), steps):
                yield (l, *rest)


def _spread(bits: int, width: int) -> int:
    """Bits set where one at most ``width`` below is."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: tuple[int, ...], waste: int, there: int) -> bool:
    """Whether a piece that is left could go in, alone or for some of the filling's pieces, without more room.

    Such a piece is the better choice: what it replaces can later stand where it would have stood (Martello and Toth).
    """
    one, many = 0, 0  # totals of one piece, of two pieces or more
    for l in filling:
        many |= many << l | one << l
        one |= 1 << l
    better = _spread(many, waste) | (_spread(1 | one, waste - 1) << 1 if waste else 0)
    return bool(better & there)


def fillings(top: int, capacity: int, counts: list[int], there: int, slack: int, steps: _Steps) -> Iterator[tuple[tuple[int, ...], int]]:
    """(filling, waste): undominated fillings around a piece of length ``top``, least waste first, up to ``slack``."""
    room = capacity - top
    reach = sums_of(there, room)
    for waste in range(min(slack, room) + 1):
        if reach >> (room - waste) & 1:
            for filling in exact(room - waste, top, counts, there, reach, (top,), steps):
                free = there
                for l in {top, *filling}:
                    if counts[l] <= filling.count(l) + (l == top):
                        free &= ~(1 << l)
                if not dominated(filling, waste, free & (2 << room) - 1):
                    yield filling, waste
        if not steps.more():
            return


def search(counts: dict[int, int], capacity: int, goal: int, steps: _Steps) -> list[Pattern] | None:
    """A packing in at most ``goal`` sequences, or None where there is none (or no steps are left).

    Depth-first bin completion: a node takes the largest piece left and a filling around it, for as many equal
    sequences as the counts allow, then for half as many and so on down to one. A branch ends where its waste exceeds what
    the goal leaves. Each choice uses a length up or nearly so, and so depth follows the lengths, not the pieces.
    """
    left = [0] * (capacity + 1)
    there = 0
    for l, n in counts.items():
        left[l] = n
        there |= 1 << l
    slack = goal * capacity - sum(l * n for l, n in counts.items())
    if slack < 0:
        return None

    def choices(there: int, slack: int) -> Iterator[tuple[int, tuple[int, ...], int, int]]:
        top = there.bit_length() - 1
        for filling, waste in fillings(top, capacity, left, there, slack, steps):
            pieces = (top, *filling)
            bins = min(left[l] // pieces.count(l) for l in set(pieces))
            if waste:
                bins = min(bins, slack // waste)
            while bins:
                yield top, filling, bins, waste
                bins //= 2

    path: list[tuple[tuple[int, ...], int, int, int]] = []  # pieces, bins, and what was there and the slack before
    open_ = [choices(there, slack)]
    while open_:
        found = next(open_[-1], None) if steps.more() else None
        if found is None:
            open_.pop()
            if path:
                pieces, bins, there, slack = path.pop()
                for l in pieces:
                    left[l] += bins
            if steps.left < 0:
                return None
            continue
        top, filling, bins, waste = found
        path.append(((top, *filling), bins, there, slack))
        for l in (top, *filling):
            left[l] -= bins
            if not left[l]:
                there &= ~(1 << l)
        slack -= bins * waste
        if not there:
            return [Pattern(b, tuple(sorted(Counter(p).items(), reverse=True))) for p, b, _, _ in path]
        open_.append(choices(there, slack))
    return None


def complete_bins(counts: dict[int, int], capacity: int, most_steps: int = 100_000) -> list[Pattern]:
    """Bin completion (Korf) over a histogram of lengths, of any number of pieces.

    The incumbent is the best-fit solution. While it is above the lower bound, a search looks for a packing that meets
    the bound, then for one half-way to the incumbent and so on; one found is the new incumbent, and a goal that has none,
    or that used its share of ``most_steps`` up (about two seconds in all), is given up.
    Steps follow the number of different lengths, at most ``capacity``; how many pieces there are makes no difference.
    """
    counts = {l: n for l, n in counts.items() if n}
    best = best_fit(counts, capacity)
    size, least = sum(p.bins for p in best), lower_bound(counts, capacity)
    floor, goal, left = least, least, most_steps
    while floor < size and left > 0:
        steps = _Steps(max(1, left // 3))
        left -= steps.left
        found = search(counts, capacity, goal, steps)
        left += max(0, steps.left)
        if found is None:
            floor = goal + 1
        else:
            best, size = found, sum(p.bins for p in found)
        goal = (floor + size) // 2
    return best


def places(patterns: list[Pattern]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first piece number, pieces a sequence, first sequence, offset there), in order of piece number."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length, times in p.slots:
            out.setdefault(length, []).append((given.get(length, 0), times, sequence, offset))
            given[length] = given.get(length, 0) + p.bins * times
            offset += length * times
        sequence += p.bins
    return out


# ---------------------------------------------------------------- the distributed part


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document, its ids ended by id 1 and cut at ``capacity``.

    Null and empty texts are the end id alone; a very long text has as many pieces as it needs; repeated rows and null ids
    have pieces of their own; other columns aren't read; an empty table gives no rows.
    """

    def cut(batches):
        model = _once(WordIds, tokenizer_path)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            docs, rows = iter(batch.column("doc_id").to_pylist()), []
            for texts in slices(batch.column("text")):
                for ids in model.encode(texts):
                    doc, ids = next(docs), ids + END_ID
                    n = len(ids) // 4
                    rows += [(doc, k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(lean(cut, keep=True), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 4096, chunk: int = 256) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to ``capacity``).

    Only the histogram of lengths, ``capacity`` rows at most, comes to the driver, where bin completion packs it into
    patterns of equal sequences. Pieces of a length are numbered through salted windows (a length's salts follow its
    count, so a length held by a third of all rows is spread like any other), and a piece's number tells its place.
    The plan that workers get has at most a slot list for each of 3 * capacity patterns, whatever the input's size.
    Rows that repeat count as pieces of their own; null ids and extra columns pass through, but columns named sequence_id
    or offset are replaced; no rows give no sequences.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = places(complete_bins(counts, capacity))
    spread = max(chunk, sum(counts.values()) // 2000)
    salts = F.create_map(*[F.lit(x) for l, n in counts.items() if n > spread for x in (l, -(-n // spread))]) if any(n > spread for n in counts.values()) else None
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(salts[F.col("length")], F.lit(1)).cast("long")) if salts is not None else F.lit(0).cast("long")
    salted = pieces.withColumn("_salt", salt)
    by = Window.partitionBy("length").orderBy("_salt")
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select(
        F.col("length").alias("_length"), F.col("_salt").alias("_s"), (F.sum("_n").over(by) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    numbered = salted.withColumn("_k", F.row_number().over(within) - 1)
    numbered = numbered.join(before, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_s")))
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered = numbered.select(*columns, (F.col("_k") + F.col("_before")).alias("_number"))

    def place(batches):
        import numpy as np

        table = {l: np.array(v, np.int64).T for l, v in plan.items()}
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for l in np.unique(length):
                at = np.flatnonzero(length == l)
                first, times, base, off = (c for c in table[int(l)])
                k = np.searchsorted(first, number[at], side="right") - 1
                j = number[at] - first[k]
                sequence[at], offset[at] = base[k] + j // times[k], off[k] + j % times[k] * l
            arrays = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns]
    return numbered.mapInArrow(lean(place, keep=True), ", ".join([*kinds, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """Documents tokenised, cut and packed; the pieces are stashed, since the plan and the placing both read them.

    Null, empty and very long texts, repeated rows, null ids, other columns and empty tables are as in ``token_pieces``.
    """
    return pack(stash(token_pieces(docs, tokenizer_path, capacity)), capacity)


__all__ = ["Pattern", "best_fit", "complete_bins", "lower_bound", "pack", "pack_documents", "places", "search", "token_pieces"]
