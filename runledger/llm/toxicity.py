"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers, each a table of states by symbols, read a clause word by
word: negation (reaches REACH words), reported speech (quotes, reporting
verbs), targets (second person) to the left, and, backwards, to the right. They
are composed once into one table, whose states mark a word as negated,
reported and near a target. Insults (words and word beginnings with learned
weights) and threats (a word of violence near a target) put their weight on the
output tape that the marks name. A clause's outputs are the weights on each
tape; reading takes one step per word. A document's features are
the largest and the summed clause weights per tape, and a logistic model turns
them into a score.

The lexicon and the logistic weights are learned in numpy from a bounded sample
of labelled rows (``per_label`` texts of each label, chosen by a hash of the
id); closed word classes (targets, negation, reporting verbs, violence) are
fixed lists of four languages. Texts are scored whole: an automaton finds the
places of lexicon entries, only clauses that hold one are read by the grammar.

Defined results: null and empty texts have no clauses and get the score of a
document without findings; without labels of both kinds that is 0; every row
gives one row, repeated rows too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import bounded_sample, id_remainder, slices

FOLDS, HELD = 4, 2
PER_LABEL = 3000
THRESHOLD = 0.3
# least log-likelihood ratio and greatest share of clean documents of a lexicon entry
MIN_RATIO, MAX_CLEAN = 20.0, 0.02
STEMS = (4, 5, 6)
# least number of different words behind a beginning
MIN_FAMILY = 4
# how many words negation reaches, and how far a threat may be from its target
REACH = 3

TARGETS = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi vous vos tú ti usted ustedes tus vosotros".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco".split())
REPORTING = frozenset("said says wrote claimed called quoted reported sagte sagt schrieb behauptete nannte dit écrit affirma appelé dijo dice escribió llamó".split())
VIOLENCE = frozenset("kill hurt destroy murder beat shoot stab töten umbringen schlagen zerstören tuer frapper détruire matar golpear destruir".split())
QUOTES = frozenset('"“”„«»')
CLAUSE_END = re.compile(r"[.!?;\n]")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»]")
TAPES = ("insult", "targeted", "negated", "reported", "threat")


# input symbols of the transducers
OTHER, QUOTE, NEGATION, REPORT, TARGET = range(5)


def symbol(token: str) -> int:
    if token in QUOTES:
        return QUOTE
    return NEGATION if token in NEGATIONS else REPORT if token in REPORTING else TARGET if token in TARGETS else OTHER


class Transducer:
    """A finite-state machine over symbols: ``table[state, symbol]`` is the next state, ``marks[state]`` what the state says of the token read from it."""

    def __init__(self, table: np.ndarray, marks: list[tuple]):
        self.table, self.marks = table, marks

    @classmethod
    def reaching(cls, source: int) -> Transducer:
        """Marks the REACH tokens behind a symbol."""
        table = np.array([[REACH if s == source else max(0, state - 1) for s in range(5)] for state in range(REACH + 1)])
        return cls(table, [(state > 0,) for state in range(REACH + 1)])

    @classmethod
    def speech(cls) -> Transducer:
        """Marks what stands in quotes or behind a reporting verb; states 0-3 are reported + 2 * quoted."""
        table = np.array([[state | 1 if s == REPORT else state ^ 2 if s == QUOTE else state for s in range(5)] for state in range(4)])
        return cls(table, [(state > 0,) for state in range(4)])

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: a state is a pair of states, its marks those of both."""
        width = len(other.marks)
        pairs = [(a, b) for a in range(len(self.marks)) for b in range(width)]
        table = np.array([self.table[a] * width + other.table[b] for a, b in pairs])
        return Transducer(table, [self.marks[a] + other.marks[b] for a, b in pairs])

    def read(self, symbols: list[int]) -> list[tuple]:
        state, out, rows = 0, [], self.rows
        for s in symbols:
            out.append(self.marks[state])
            state = rows[state][s]
        return out

    @property
    def rows(self) -> list[list[int]]:
        if not hasattr(self, "_rows"):
            self._rows = self.table.tolist()
        return self._rows


# negation, speech and targets on the left, composed once; targets on the right are read backwards
FORWARD = Transducer.reaching(NEGATION).compose(Transducer.speech()).compose(Transducer.reaching(TARGET))
BACKWARD = Transducer.reaching(TARGET)


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(TAPES) + 1))
    usable: bool = False

    def insult(self, word: str) -> float:
        """Weight of a word: its own, or that of its longest known beginning."""
        w = self.words.get(word)
        if w is None:
            w = next((self.stems[word[:n]] for n in reversed(STEMS) if word[:n] in self.stems), 0.0)
        return w

    def clause(self, text: str) -> dict[str, float]:
        """Run the composed transducers over one clause: each word's weight goes to the tape that its state names."""
        tokens = TOKEN.findall(text)
        out = dict.fromkeys(TAPES, 0.0)
        symbols = [symbol(t) for t in tokens]
        behind = BACKWARD.read(symbols[::-1])[::-1]
        for t, s, (negated, reported, before), (after,) in zip(tokens, symbols, FORWARD.read(symbols), behind):
            if s in (QUOTE, NEGATION, REPORT):
                continue
            close = before or after or s == TARGET
            w = self.insult(t)
            if w:
                out["negated" if negated else "reported" if reported else "targeted" if close else "insult"] += w
            if t in VIOLENCE and close and not negated and not reported:
                out["threat"] += 1.0
        return out

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *VIOLENCE]:
            a.add_word(w, len(w))
        a.make_automaton()
        return a

    def features(self, text: str, places) -> np.ndarray:
        """Largest and summed clause weights per tape; ``places`` is the lexicon's automaton."""
        low, done = text.lower(), 0
        best, total = np.zeros(len(TAPES)), np.zeros(len(TAPES))
        for end, n in places.iter(low):
            start = end - n + 1
            if start < done or (start and low[start - 1].isalnum()):
                continue
            a = 0
            for mark in ".!?;\n":
                a = max(a, low.rfind(mark, done, start) + 1)
            a = max(a, done)
            m = CLAUSE_END.search(low, start)
            done = m.end() if m else len(low)
            found = np.array([*self.clause(low[a:done]).values()])
            best, total = np.maximum(best, found), total + found
        return np.concatenate([best, np.log1p(total)])

    def score(self, text: str, places) -> float:
        if not self.usable:
            return 0.0
        z = float(self.weights[:-1] @ self.features(text, places) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def ratio(a: int, n_a: int, b: int, n_b: int) -> float:
    """Log-likelihood ratio of a out of n_a against b out of n_b."""
    def part(k, n, p):
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    both = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a, a / n_a) + part(b, n_b, b / n_b) - part(a, n_a, both) - part(b, n_b, both)) if 0 < both < 1 else 0.0


def learn_entries(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    out = {}
    for w, a in toxic.items():
        b = clean[w]
        share_a, share_b = a / n_toxic, b / n_clean
        if share_b <= MAX_CLEAN * share_a and ratio(a, n_toxic, b, n_clean) >= MIN_RATIO:
            out[w] = math.log((a + 0.5) / n_toxic) - math.log((b + 0.5) / n_clean)
    return out


def train(texts: list[str], labels: list[int], rounds: int = 40, penalty: float = 1e-2) -> Grammar:
    """Lexicon from document counts, then penalised logistic regression on the grammar's features."""
    g = Grammar()
    n = Counter(labels)
    if not n[0] or not n[1]:
        return g
    words, stems = (Counter(), Counter()), (Counter(), Counter())
    members: dict[str, set[str]] = {}
    # copies say nothing new: equal texts count once, and a word counts for toxic texts once per pair of neighbours
    bags, around = [], {}
    for text, label in sorted(set(zip(texts, labels))):
        tokens = TOKEN.findall(text.lower())
        found = {t for t in tokens if t not in QUOTES}
        bags.append((found, label))
        words[label].update(found)
        if label:
            for before, t, after in zip(["", *tokens], tokens, [*tokens[1:], ""]):
                around.setdefault(t, set()).add((before, after))
    n = Counter(label for _, label in bags)
    seen = Counter({t: min(c, len(around[t])) for t, c in words[1].items() if t in around})
    g.words = learn_entries(seen, words[0], n[1], n[0])
    # beginnings stand for families of rare words, so only what the word list leaves over counts for them
    for found, label in bags:
        if label:
            for t in found:
                if t not in g.words:
                    for k in STEMS:
                        if len(t) > k:
                            members.setdefault(t[:k], set()).add(t)
    for found, label in bags:
        rest = found if label == 0 else found - g.words.keys()
        stems[label].update({t[:k] for t in rest for k in STEMS if len(t) > k})
    entries = learn_entries(stems[1], stems[0], n[1], n[0])
    entries = {s: w for s, w in entries.items() if len(members[s]) >= MIN_FAMILY}
    g.stems = {s: w for s, w in entries.items() if not any(s[:k] in entries for k in STEMS if k < len(s))}
    places = g.automaton()
    x = np.array([[*g.features(t, places), 1.0] for t in texts])
    y = np.array(labels, dtype=float)
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge
        w -= np.linalg.solve(hess, grad)
    g.weights, g.usable = w, True
    return g


def fit_on(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Grammar:
    """Learn from a bounded sample of labelled rows outside the held-out fold."""
    marks = labels.where(F.col("toxic").isNotNull() & (id_remainder(F.col("doc_id"), FOLDS) != HELD)).groupBy(
        F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = bounded_sample(marks, "toxic", per_label, 2, key="_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text"))
    picked = sorted((r["doc_id"], r["toxic"], r["text"]) for r in rows.collect())
    return train([t for *_, t in picked], [y for _, y, _ in picked])


def score(docs: DataFrame, grammar: Grammar, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) per row. Map-only; the grammar is of bounded size."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, score double"
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        places = g.automaton()
        for batch in batches:
            for part in slices(batch):
                scores = [g.score(t or "", places) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op10 contract."""
    held = F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return score(docs, fit_on(docs, labels)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
