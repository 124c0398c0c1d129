"""3. Toxicity: a weighted finite-state pattern grammar over clauses.

Words are runs of letters, digits and their marks in any alphabet, whatever signs stand around them, and become symbols
(insult, weak insult, threat, target, negation, reported speech, other). Small transducers rewrite symbols by what stands
before them (a negated or reported insult is weakened, one near a target is directed); they are composed into one
machine whose arcs carry weights, and it reads each clause that holds an insult or a threat. Where a target stands behind
(insult, you), a transducer that reads the clause from its end has rewritten the symbols before. A document's score joins its clauses: 1 - product of exp(-clause weight). Threat words without a target are faint, more so
if negated or reported: however many a document holds, they add at most FAINT_MOST, so they reject no text of any length,
not even beside one softened insult. The lexicon of insults is learned from labels: a
word or word beginning counts when it stands in many different contexts of toxic documents and hardly in others, so
copies of a passage teach nothing.

Cases: null, empty and wordless texts score 0; with no labels (or no toxic one) only the fixed words score; labels
of unknown documents are ignored; repeated rows are scored each; other columns are kept, score and predicted replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.hashing import CLASSES, mix, range_hashes, runs
from flowlake.llm.training import fold, labelled_sample

#: At most about so many labelled documents teach the lexicon.
TRAINING_ROWS = 10_000
THRESHOLD = 0.3
#: Different contexts in toxic documents that a word or a word beginning of 4 to 6 bytes needs, and different documents.
CONTEXTS, CONTEXT_DOCS = 6, 3
STEMS = (4, 5, 6)

OTHER, INSULT, WEAK, THREAT, TARGET, NEGATION, REPORT, DIRECTED, SOFTENED, DIRECT_THREAT, SOFTENED_THREAT = range(11)

WEIGHTS = {INSULT: 1.2, WEAK: 0.5, DIRECTED: 1.8, SOFTENED: 0.3, DIRECT_THREAT: 1.0}
FAINT = {THREAT: 0.1, SOFTENED_THREAT: 0.03}
#: The most that faint symbols add to a document's weight; with one softened insult still below the threshold.
FAINT_MOST = 0.05

# Function words of the grammar.
TARGET_WORDS = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta tú tu te ti usted ustedes vosotros they them those these people".split()
NEGATION_WORDS = "not no never none isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca ningún ninguna".split()
REPORT_WORDS = "said says say told wrote claimed quoted called sagte schrieb behauptete nannte dit écrit prétend appelé dijo escribió afirmó llamó".split()
THREAT_WORDS = "kill hurt destroy murder stab shoot beat burn umbringen töten schlagen tuer frapper détruire matar golpear destruir".split()


#: Signs beyond ASCII: those that close a sentence, and all others that belong to no word.
_SIGN = regex.compile(r"[^\p{L}\p{M}\p{N}\x00-\x7f]")
_CLOSING = regex.compile(r"[^\P{Sentence_Terminal}\x00-\x7f]|…|；")


@dataclass
class Transducer:
    """A finite-state machine that reads a symbol and writes one, with a weight; without an arc it copies the symbol,
    weighs nothing and goes to ``otherwise[state]``."""

    arcs: dict[tuple[int, int], tuple[int, float, int]] = field(default_factory=dict)
    otherwise: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, float, int]:
        return self.arcs.get((state, symbol), (symbol, 0.0, self.otherwise.get(state, 0)))


def after(trigger: int, rewrites: dict[int, int], reach: int) -> Transducer:
    """Rewrites symbols that stand at most ``reach`` symbols behind a trigger."""
    t = Transducer()
    for state in range(reach + 1):
        t.otherwise[state] = max(0, state - 1)
        t.arcs[state, trigger] = (trigger, 0.0, reach)
        if state:
            for old, new in rewrites.items():
                t.arcs[state, old] = (new, 0.0, state - 1)
    return t


def weigh(weights: dict[int, float]) -> Transducer:
    return Transducer({(0, s): (s, w, 0) for s, w in weights.items()})


def compose(machines: list[Transducer], symbols: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The machines one behind the other as one table: next state and weight for each state and symbol."""
    states, work = {(0,) * len(machines): 0}, [(0,) * len(machines)]
    follow: list[list[int]] = []
    weight: list[list[float]] = []
    while len(follow) < len(work):
        at = work[len(follow)]
        row, cost = [], []
        for symbol in range(symbols):
            total, to = 0.0, []
            for machine, state in zip(machines, at):
                symbol, w, nxt = machine.step(state, symbol)
                total += w
                to.append(nxt)
            key = tuple(to)
            if key not in states:
                states[key] = len(states)
                work.append(key)
            row.append(states[key])
            cost.append(total)
        follow.append(row)
        weight.append(cost)
    return np.array(follow), np.array(weight)


def grammar(weights: dict[int, float] = WEIGHTS | FAINT) -> tuple[np.ndarray, np.ndarray]:
    soften = {INSULT: SOFTENED, WEAK: SOFTENED, DIRECTED: SOFTENED, THREAT: SOFTENED_THREAT, DIRECT_THREAT: SOFTENED_THREAT}
    return compose(
        [
            after(NEGATION, soften, 3),
            after(REPORT, soften, 6),
            after(TARGET, {INSULT: DIRECTED, WEAK: INSULT, THREAT: DIRECT_THREAT}, 4),
            weigh(weights),
        ]
    )


def backward(symbols: list[int], follow: list[list[tuple[int, int]]]) -> list[int]:
    """The symbols of a clause, rewritten from its end on by a transducer given as state -> symbol -> (written, next)."""
    out, state = symbols[:], 0
    for i in range(len(symbols) - 1, -1, -1):
        out[i], state = follow[state][symbols[i]]
    return out


def target_behind(reach: int = 2, symbols: int = 11) -> list[list[tuple[int, int]]]:
    """An insult or a threat with a target at most ``reach`` words behind it is directed."""
    t = after(TARGET, {INSULT: DIRECTED, THREAT: DIRECT_THREAT}, reach)
    return [[t.step(state, s)[::2] for s in range(symbols)] for state in range(reach + 1)]


@dataclass
class Units:
    """Lower-cased words of some texts: hash, document, clause; and hashes of their beginnings (0: too short)."""

    word: np.ndarray
    doc: np.ndarray
    clause: np.ndarray
    stems: dict[int, np.ndarray]


def plain_signs(text: str) -> str:
    """The text with ASCII signs only: every other sign becomes a space, or a full stop where it closes a sentence."""
    return text if text.isascii() else _SIGN.sub(" ", _CLOSING.sub(".", text))


def units(texts: list[str | None]) -> Units:
    raw = [plain_signs((t or "").lower()).encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
    classes = CLASSES[data]
    starts, stops = runs(classes, np.concatenate([[0], ends[:-1]]) if len(ends) else ends)
    is_word = classes[starts] == 1
    starts, stops = starts[is_word], stops[is_word]
    closes = np.isin(data, np.frombuffer(b".!?;\n", dtype=np.uint8))
    closes_before = np.concatenate([[0], np.cumsum(closes)])
    stems = {}
    for n in STEMS:
        long = stops - starts > n
        h = np.zeros(len(starts), dtype=np.uint64)
        h[long] = mix(range_hashes(data, starts[long], starts[long] + n) + np.uint64(n))
        stems[n] = h
    return Units(range_hashes(data, starts, stops), np.searchsorted(ends, starts, side="right"), closes_before[starts], stems)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.unique(units([" ".join(words)]).word)


@dataclass
class Lexicon:
    strong: np.ndarray  # ascending hashes of words
    weak: np.ndarray  # ascending hashes of word beginnings


def learn(sample: DataFrame) -> Lexicon:
    """The lexicon from sample(text, label): bounded by the sample, a few hundred hashes in practice."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = units(b.column(1).to_pylist())
            if len(u.word) == 0:
                continue
            docs = b.column(0).to_numpy(zero_copy_only=False)[u.doc]
            before = np.concatenate([[0], u.word[:-1]]).astype(np.uint64)
            behind = np.concatenate([u.word[1:], [0]]).astype(np.uint64)
            around = mix(before * np.uint64(3) + mix(behind))
            hashes = np.concatenate([u.word, *u.stems.values()])
            kinds = np.repeat(np.array([0, *STEMS], dtype=np.int32), len(u.word))
            places = np.tile(around, 1 + len(STEMS))
            keep = hashes != 0
            columns = [hashes[keep].view(np.int64), kinds[keep], places[keep].view(np.int64), np.tile(docs, 1 + len(STEMS))[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "kind", "around", "doc"])

    toxic = sample.where("label = 1").select("doc_id", "text").mapInArrow(contexts, "h long, kind int, around long, doc long")
    once = toxic.groupBy("h", "kind", "around").agg(F.min("doc").alias("doc"))  # a copied passage has one context, in one document
    diverse = once.groupBy("h", "kind").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))
    diverse = diverse.where((F.col("n") >= CONTEXTS) & (F.col("docs") >= CONTEXT_DOCS))
    known = {(r["h"], r["kind"]): r["n"] for r in diverse.collect()}
    wanted = np.sort(np.array([h for h, _ in known], dtype=np.int64))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = units(b.column(0).to_pylist())
            found = []
            for h in (u.word, *u.stems.values()):
                h = h.view(np.int64)
                hit = member(wanted, h)
                found.append(np.stack([h[hit], u.doc[hit]], axis=1))
            h, n = np.unique(np.unique(np.concatenate(found), axis=0)[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    clean = sample.where("label = 0").select("text").mapInArrow(documents, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    elsewhere = {r["h"]: r["n"] for r in clean.collect()} if known else {}
    strong = [h for (h, kind), n in known.items() if kind == 0 and elsewhere.get(h, 0) * 20 <= n]
    weak = [h for (h, kind), n in known.items() if kind and elsewhere.get(h, 0) * 50 <= n]
    return Lexicon(np.sort(np.array(strong, dtype=np.int64)), np.sort(np.array(weak, dtype=np.int64)))


def member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the ascending table."""
    if len(table) == 0:
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        # the same states: weights are given by the last machine, which has only one
        self.follow, self.weight = (t.tolist() for t in grammar(WEIGHTS))
        self.faint = grammar(FAINT)[1].tolist()
        self.behind = target_behind()
        self.fixed = [(s, word_hashes(w).view(np.int64)) for s, w in ((TARGET, TARGET_WORDS), (NEGATION, NEGATION_WORDS), (REPORT, REPORT_WORDS), (THREAT, THREAT_WORDS))]
        for _, table in self.fixed:
            table.sort()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        u = units(texts)
        word = u.word.view(np.int64)
        symbols = np.zeros(len(word), dtype=np.int64)
        for symbol, table in self.fixed:
            symbols[member(table, word)] = symbol
        for stem in u.stems.values():
            symbols[member(self.lexicon.weak, stem.view(np.int64)) & (stem != 0)] = WEAK
        symbols[member(self.lexicon.strong, word)] = INSULT
        total, faint = np.zeros(len(texts)), np.zeros(len(texts))
        hits = np.flatnonzero((symbols == INSULT) | (symbols == WEAK) | (symbols == THREAT))
        # a clause's words stand together; a document's start always begins a clause
        begins = np.ones(len(word), dtype=bool)
        begins[1:] = (u.clause[1:] != u.clause[:-1]) | (u.doc[1:] != u.doc[:-1])
        clause = np.cumsum(begins) - 1
        firsts = np.append(np.flatnonzero(begins), len(word))
        for c in np.unique(clause[hits]).tolist():
            state, sum_, faint_sum = 0, 0.0, 0.0
            for symbol in backward(symbols[firsts[c] : firsts[c + 1]].tolist(), self.behind):
                sum_ += self.weight[state][symbol]
                faint_sum += self.faint[state][symbol]
                state = self.follow[state][symbol]
            total[u.doc[firsts[c]]] += sum_
            faint[u.doc[firsts[c]]] += faint_sum
        return 1.0 - np.exp(-total - np.minimum(faint, FAINT_MOST))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus score and predicted."""
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer.scores(b.column(at).to_pylist()))], names=[*names, "score"])

    schema = docs.withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Lexicon:
    return learn(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 4) != 2, bound))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
