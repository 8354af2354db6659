"""Toxicity by a weighted finite-state grammar: transducers composed word by word, scoring the clauses that match."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_text, stash

#: Labelled documents that the insult transducer's arcs are learned from, at most: those with the least hashes of ids.
SAMPLE = 30_000

# Function words and verbs of the grammar's transducers, in the four languages of the corpus.
TARGET = frozenset("you your yours yourself u he she they them these those him her du dich dir euch ihr sie tu te toi vous ils elles usted ustedes ti ellos ellas".split())
NEGATION = frozenset("not no never isn't aren't don't nicht kein keine nie pas jamais nunca".split())
REPORT = frozenset("said says wrote writes claimed quoted reported called sagte schrieb dit écrit dijo escribió".split())
MENTION = frozenset("word term phrase slur dictionary wort begriff mot terme palabra término".split())
THREAT = frozenset("kill hurt destroy murder shoot stab strangle lynch töten umbringen tuer matar".split())
#: Insults known before any label is seen.
SEED = frozenset("idiot moron imbecile scum loser dumbass".split())

WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer: arcs (state, symbol in) -> (state, symbol out, weight), weights multiply.

    A symbol without an arc is passed on, at weight 1, and leads where ``otherwise`` says (to the same state if nowhere).
    """

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    otherwise: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.otherwise.get(state, state), symbol, 1.0)


# Symbols: I an insult, K a threat's verb, T a target, N a negation, R a report, M a mention, o anything else; i and k are an
# insult and a threat that are aimed at someone.
#: For three words after a negation, what is said is denied.
NEGATED = Transducer(
    {(s, "N"): (3, "o", 1.0) for s in range(4)} | {(s, x): (s - 1, x, 0.4) for s in (1, 2, 3) for x in "IK"},
    {3: 2, 2: 1, 1: 0},
)
#: After a verb of saying someone else speaks; what is mentioned isn't used.
REPORTED = Transducer(
    {(s, "R"): (1, "o", 1.0) for s in (0, 1)} | {(s, "M"): (2, "o", 1.0) for s in (0, 1, 2)}
    | {(1, x): (1, x, 0.6) for x in "IK"} | {(2, x): (2, x, 0.3) for x in "IK"},
)
#: An insult is aimed if a target stands before it in the clause or after it, a threat only if one does before or right after.
AIMED = Transducer(
    {(s, "T"): (1, "o", 1.0) for s in (0, 1)} | {(1, "I"): (1, "i", 1.0), (1, "K"): (1, "k", 1.0)} | {(2, "T"): (1, "i", 1.0), (0, "I"): (2, "I", 1.0), (2, "I"): (2, "I", 1.0)}
    | {(0, "K"): (3, "K", 1.0), (3, "T"): (1, "k", 1.0)},
    {3: 0},
)
CHAIN = (NEGATED, REPORTED, AIMED)


def features(text: str) -> list[tuple[str, str]]:
    """Each word of a text with what stands around it."""
    w = ["", *WORDS.findall(text.lower()), ""]
    return [(w[i], f"{w[i - 1]} {w[i + 1]}") for i in range(1, len(w) - 1)]


def stems(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in STEMS if len(word) > n]


@dataclass(frozen=True)
class Grammar:
    """The insult transducer (words, and stems written stem*, with weights from 0 to 1) composed with those of negation, report
    and target.

    A clause is read once from left to right, each word going through all transducers in turn, and what comes out at
    its end is its reading: an insult aimed at someone counts in full, a threat only if it is aimed, an insult aimed at nobody
    as ``loose`` says, so that a word alone stays below any common limit; several of them, or several clauses, add up as
    independent reasons do. Denied, reported and mentioned insults count for less.
    """

    arcs: dict[str, float] = field(default_factory=dict)
    threat: float = 0.75
    loose: float = 0.62
    floor: float = 0.01

    def weight(self, word: str) -> float:
        best = self.arcs.get(word, 0.0)
        for s in stems(word):
            best = max(best, self.arcs.get(s, 0.0))
        return best

    def symbol(self, word: str) -> tuple[str, float]:
        """The lexicon's transducer: a word's symbol and weight."""
        if word in NEGATION:
            return "N", 1.0
        if word in REPORT:
            return "R", 1.0
        if word in MENTION:
            return "M", 1.0
        if weight := self.weight(word):
            return "I", weight
        if word in THREAT:
            return "K", self.threat
        return ("T" if word in TARGET else "o"), 1.0

    def clause(self, words: list[str]) -> float:
        """What the composed transducers put out for a clause, as the chance that it is toxic."""
        states, clean, open_, verb = [0] * len(CHAIN), 1.0, [], 0.0
        for word in words:
            symbol, weight = self.symbol(word)
            for k, t in enumerate(CHAIN):
                states[k], symbol, w = t.step(states[k], symbol)
                weight *= w
            if symbol == "I":
                open_.append(weight)  # aimed if a target still follows
            elif symbol == "K":
                verb = weight
            elif symbol == "k":
                clean *= 1 - (verb if word in TARGET else weight)
            elif symbol == "i" and word in TARGET:
                clean *= 1 - max(open_)
                open_.clear()
            elif symbol == "i":
                clean *= 1 - weight
        for weight in open_:
            clean *= 1 - self.loose * weight
        return 1 - clean

    def score(self, text: str) -> float:
        text = text.lower()
        found = set(WORDS.findall(text))
        if not any(w in THREAT or self.weight(w) for w in found):
            return self.floor
        clean = 1 - self.floor
        for part in CLAUSE.split(text):
            clean *= 1 - self.clause(WORDS.findall(part))
        return 1 - clean


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_docs: int = 5, least_odds: float = 4.0, least_places: int = 8) -> Grammar:
    """The insult arcs from labelled documents (doc_id, toxic) that the caller may learn from.

    Candidates are words and stems in at least ``least_docs`` of the sample's toxic documents; an arc is one whose odds of standing in
    a toxic document are least_odds (log) above the others' and that stands in at least ``least_places`` different
    surroundings, which copies of one text don't. All counts are of the bounded sample.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic is not null").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    d = id_text(docs)
    rows = stash(d.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic"))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), sum(n for t, n in totals.items() if t != 1)
    if not bad:
        return Grammar(dict.fromkeys(SEED, 0.75))

    def counted(only: frozenset | None, places: bool = False):
        def each(batches):
            for batch in batches:
                found: Counter = Counter()
                for text in batch.column("text").to_pylist():
                    seen = set()
                    for w, around in features(text):
                        for f in (w, *stems(w)):
                            if only is None or f in only:
                                seen.add((f, (around if f == w else f"{w} {around}") if places else ""))
                    found.update(seen)
                names = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.string()), pa.array(list(found.values()), pa.int64())], names=["f", "place", "n"])

        return each

    shape = "f string, place string, n long"
    toxic, other = rows.where("toxic = 1"), rows.where("toxic <> 1")
    hits = {r["f"]: r["n"] for r in toxic.mapInArrow(counted(None), shape).groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).collect()}
    misses = {r["f"]: r["n"] for r in other.mapInArrow(counted(frozenset(hits)), shape).groupBy("f").agg(F.sum("n").alias("n")).collect()}
    ratio = {f: (n + 0.5) / (bad + 1) / ((misses.get(f, 0) + 0.5) / (good + 1)) for f, n in hits.items()}
    strong = frozenset(f for f, r in ratio.items() if r >= 2.718281828**least_odds or (good and misses.get(f, 0) == 0 and r >= 20))
    places = {r["f"]: r["n"] for r in toxic.mapInArrow(counted(strong, True), shape).groupBy("f").agg(F.countDistinct("place").alias("n")).collect()}
    arcs = {}
    for f in strong:
        if places.get(f, 0) >= least_places:
            share = ratio[f] * bad / (ratio[f] * bad + max(good, 1))
            arcs[f] = min(0.97, share)
    return Grammar(dict.fromkeys(SEED, 0.75) | arcs)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``; whole texts are scored, of whatever length.

    The grammar is learned from labels of rows whose crc32(doc_id as text) mod ``folds`` isn't ``held_out_fold``, from
    at most SAMPLE documents; a score reads the text alone. Null and empty texts get the floor; without labels the
    seed insults stand alone; a null id has a null held_out; repeated rows score alike; other columns, whatever their names,
    aren't read; an empty table gives no rows.
    """
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out_fold
    grammar = learn(docs, labels.where(~out))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def each(batches):
        own = shared.value
        for batch in batches:
            scores = [own.score(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= limit) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return id_text(docs).withColumn("held_out", out).mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")
