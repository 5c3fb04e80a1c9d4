"""Toxicity scores by a weighted finite-state pattern grammar over clauses.

A text is cut into tokens at ASCII white space and into clauses at sentence signs, semicolons, bars and line ends that
close a token.  A lexicon, a transducer over letters whose final states carry weights, maps each token to its classes: insult,
harm, intention, target, negation, saying.  Five transducers over classes follow, each of which passes the tokens of a clause on
and marks some of them:

* reported speech: a verb of saying marks itself and the rest of its clause;
* negation: marks the ``NEAR`` tokens behind it;
* threat: marks a verb of harm at most ``NEAR`` tokens behind an intention (``will``, ``going to`` ...);
* target: marks all tokens of a clause that has a target anywhere, by guessing at the start and accepting only if the guess held;
* insult: writes a tag for each insult or threat, by its marks: reported, negated, threat, directed or plain.

They are composed into one machine, whose arcs are those of the five in step.  It has one accepting path for each clause, whose tags
and the lexicon's weights are the clause's match; a text's features are the squashed sums over its clauses, by tag.

Weights come from labels.  Insults are the words of a fixed list and, learned, stems: prefixes and whole words whose
texts are toxic far more often than not, chosen greedily by how many toxic texts they newly explain, so that the common
words of copied toxic texts are not taken for insults.  A stem that clean texts also hold now and then may be an insult
from its second token in a text on.  A logistic model over the features turns the tags into a score.
Fitting reads at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows, chosen by a hash of their ids; copies of a text
count once.  Without labels the list and default weights hold.

Defined cases: null and empty texts have no clause and get the score of the intercept; repeated rows get equal scores;
several labels of an id count as toxic if one is; rows of labels with null ids or labels are not used; an empty table gives
an empty result; only the text is an input of a score.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewren.llm.common import Cache, in_small_batches, staged, with_columns

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
THRESHOLD = 0.7
NEAR = 3
#: Letters of the shortest and longest learned prefix.
PREFIX = range(4, 9)
CACHE_TOKENS = 60_000  # some 130 bytes each

# Word lists of the grammar's transducers.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown imbecile cretin bastard bitch asshole jerk pig vermin filth garbage dumbass shithead fool degenerate parasite dummkopf arschloch trottel abschaum connard imbécile salaud ordure idiota imbécil estúpido basura cabrón escoria"
HARMS = "kill hurt destroy murder shoot stab beat burn crush töten umbringen vernichten tuer détruire matar destruir"
INTENTIONS = "will gonna going shall must should werde werden vais allons voy vamos"
TARGETS = "you your yours yourself u ur they them their he she him her du dich dir ihr euch tu te toi vous tú ti usted ustedes"
NEGATIONS = "not never isn't aren't wasn't don't doesn't nobody kein keine nicht jamais nunca"
SAYINGS = "said says say wrote writes called calls claimed claims quoted reported according sagte schrieb disait écrit dijo escribió"

TAGS = ("plain", "directed", "negated", "reported", "threat")
#: Default weights of the features and the intercept, used without labels.
DEFAULT = (np.array([2.0, 2.5, 0.3, 0.5, 2.5]), -2.0)
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_CLOSES = tuple(".!?;|")
#: Classes of tokens, marks of the transducers, and what only the scan of a text uses: clause ends and stems that count later.
INSULT, HARM, INTENT, TARGET, NOT, SAY = (1 << i for i in range(6))
CLASSES = 64
REPORTED, NEGATED, THREAT, DIRECTED = (CLASSES << i for i in range(4))
_END, _TWICE = CLASSES, 2 * CLASSES
#: Marks a stem that counts from its second token on.
TWICE = "+"


def held_out(doc_id: str = "doc_id", parts: int = 3, at: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == at, F.lit(False))


def stems(word: str) -> list[str]:
    """The pieces by which a word can be an insult: the word itself and its prefixes."""
    return ["=" + word, *(word[:n] for n in PREFIX if n < len(word))]


class Transducer:
    """Arcs from (state, symbol read) to (symbol written, next state), a start state and final states."""

    def __init__(self, start, finals: set, arcs: dict[tuple, list[tuple]]):
        self.start, self.finals, self.arcs = start, finals, arcs

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other one reads."""
        start = (self.start, other.start)
        arcs, finals, found, todo = {}, set(), {start}, [start]
        reads: dict = {}
        for (state, x), to in self.arcs.items():
            reads.setdefault(state, []).append((x, to))
        while todo:
            p, r = todo.pop()
            if p in self.finals and r in other.finals:
                finals.add((p, r))
            for x, to in reads.get(p, ()):
                out = [(z, (q, s)) for y, q in to for z, s in other.arcs.get((r, y), ())]
                if out:
                    arcs[(p, r), x] = out
                for _, state in out:
                    if state not in found:
                        found.add(state)
                        todo.append(state)
        return Transducer(start, finals, arcs)

    def numbered(self) -> Transducer:
        """The same machine with small integers as states."""
        number = {self.start: 0}
        for (p, _), to in self.arcs.items():
            for state in (p, *(q for _, q in to)):
                number.setdefault(state, len(number))
        return Transducer(0, {number[f] for f in self.finals if f in number}, {(number[p], x): [(y, number[q]) for y, q in to] for (p, x), to in self.arcs.items()})

    def written(self, symbols: list[int]) -> list[list[int]]:
        """What the accepting paths write."""
        paths = [(self.start, [])]
        for x in symbols:
            paths = [(q, [*out, y]) for state, out in paths for y, q in self.arcs.get((state, x), ())]
        return [out for state, out in paths if state in self.finals]


def _reads(bits: int) -> range:
    """All symbols of the classes and of the first so many marks."""
    return range(CLASSES << bits)


def reported_speech() -> Transducer:
    return Transducer(0, {0, 1}, {(q, x): [(x | REPORTED, 1) if q or x & SAY else (x, 0)] for q in (0, 1) for x in _reads(0)})


def negation(near: int = NEAR) -> Transducer:
    """The state is the number of tokens since a negation; ``near`` + 1 stands for more."""
    after = lambda q, x: 0 if x & NOT else min(q + 1, near + 1)
    return Transducer(near + 1, set(range(near + 2)), {(q, x): [(x | (NEGATED if after(q, x) <= near else 0), after(q, x))] for q in range(near + 2) for x in _reads(1)})


def threat(near: int = NEAR) -> Transducer:
    after = lambda q, x: 0 if x & INTENT else min(q + 1, near + 1)
    return Transducer(near + 1, set(range(near + 2)), {(q, x): [(x | (THREAT if x & HARM and after(q, x) <= near else 0), after(q, x))] for q in range(near + 2) for x in _reads(2)})


def target() -> Transducer:
    """State 0 has read nothing, 1 guesses that no target comes, 2 that one will, and 3 has seen it."""
    arcs = {}
    for x in _reads(3):
        if x & TARGET:
            arcs[0, x] = arcs[2, x] = arcs[3, x] = [(x | DIRECTED, 3)]
        else:
            arcs[0, x], arcs[1, x], arcs[2, x], arcs[3, x] = [(x, 1), (x | DIRECTED, 2)], [(x, 1)], [(x | DIRECTED, 2)], [(x | DIRECTED, 3)]
    return Transducer(0, {0, 1, 3}, arcs)


def insult() -> Transducer:
    """Writes 0, or 1 + the place of a tag."""

    def tag(x: int) -> int:
        if not x & (INSULT | THREAT):
            return 0
        return 1 + TAGS.index("reported" if x & REPORTED else "negated" if x & NEGATED else "threat" if x & THREAT else "directed" if x & DIRECTED else "plain")

    return Transducer(0, {0}, {(0, x): [(tag(x), 0)] for x in _reads(4)})


def grammar() -> Transducer:
    """The composition of the five transducers."""
    machine = reported_speech()
    for other in (negation(), threat(), target(), insult()):
        machine = machine.then(other).numbered()
    return machine


class Lexicon:
    """A transducer over the letters of a word: its final states hold classes and the weight as an insult.

    A final state of a stem is open: any letters may follow. One of a whole word is not.
    """

    def __init__(self, insults: dict[str, float]):
        self.root: dict = {}
        for bit, words in ((HARM, HARMS), (INTENT, INTENTIONS), (TARGET, TARGETS), (NOT, NEGATIONS), (SAY, SAYINGS)):
            for w in words.split():
                self._final(w, "whole", bit, 0.0)
        for piece, weight in insults.items():
            stem = piece.removesuffix(TWICE)
            what = ("whole" if stem.startswith("=") else "open") + (TWICE if piece != stem else "")
            self._final(stem.removeprefix("="), what, INSULT, weight)

    def _final(self, letters: str, what: str, bits: int, weight: float) -> None:
        state = self.root
        for c in letters:
            state = state.setdefault(c, {})
        old = state.get(what, (0, 0.0))
        state[what] = old[0] | bits, max(old[1], weight)

    def read(self, word: str) -> tuple[int, float, list[tuple[str, float]]]:
        """Classes and weight of a word, and the stems, with weights, that make it an insult from their second token on."""
        bits, weight, later, state = 0, 0.0, [], self.root
        for i, c in enumerate(word):
            state = state.get(c)
            if state is None:
                break
            last = i == len(word) - 1
            for what in ("whole", "whole" + TWICE) if last else ("open", "open" + TWICE):
                found = state.get(what)
                if found and what.endswith(TWICE):
                    later.append((("=" if last else "") + word[: i + 1], found[1]))
                elif found:
                    bits, weight = bits | found[0], max(weight, found[1])
        return bits, weight, later


class Grammar:
    """The composed machine over the lexicon's classes."""

    def __init__(self, insults: dict[str, float]):
        self.lexicon = Lexicon(insults)
        self.machine = grammar()
        self.cache = Cache(lambda token: self.token(token)[0], CACHE_TOKENS)

    def token(self, token: bytes) -> tuple[int, float, list[tuple[str, float]]]:
        """Classes of a token as bits, its weight as an insult, and its stems that count from the second token on."""
        text = token.decode("utf-8", "replace").lower()
        bits, most, twice = 0, 0.0, []
        for w in _LETTERS.findall(text):
            own, weight, later = self.lexicon.read(w)
            bits, most = bits | own, max(most, weight)
            twice += later
        return bits | _TWICE * bool(twice) | _END * text.endswith(_CLOSES), most, twice

    def features(self, text: bytes | None) -> np.ndarray:
        """Sums over a text's clauses of how strongly they match, by tag."""
        out = np.zeros(len(TAGS))
        read, seen = self.cache, Counter()
        if not text:
            return out
        for line in text.split(b"\n"):
            tokens = line.split()
            bits = list(map(read.__getitem__, tokens))
            if not any(b & (INSULT | HARM | _TWICE) for b in bits):
                continue  # the machine writes no tag without an insult or harm
            start = 0
            for i, b in enumerate(bits):
                if b & _END or i == len(bits) - 1:
                    out += self._clause(tokens[start : i + 1], bits[start : i + 1], seen)
                    start = i + 1
        return out

    def _clause(self, tokens: list[bytes], bits: list[int], seen: Counter) -> np.ndarray:
        """How strongly a clause matches, by tag: many matches in one clause add little to the first ones."""
        out = np.zeros(len(TAGS))
        if not any(b & (INSULT | HARM | _TWICE) for b in bits):
            return out
        symbols, weights = [], {}
        for i, b in enumerate(bits):
            if b & (INSULT | _TWICE):
                _, weights[i], twice = self.token(tokens[i])
                for stem, weight in dict(twice).items():
                    seen[stem] += 1
                    if seen[stem] > 1:
                        weights[i] = max(weights[i], weight)
                b = b | INSULT if weights[i] else b
            symbols.append(b & (CLASSES - 1))
        (tags,) = self.machine.written(symbols)
        for i, tag in enumerate(tags):
            if tag:
                out[tag - 1] += weights.get(i) or 1.0
        return squashed(out)


def squashed(x: np.ndarray) -> np.ndarray:
    """Many matches add little to the first ones."""
    return 1 - np.exp(-x)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps: (weights, intercept)."""
    z = np.c_[x, np.ones(len(x))]
    w, c = np.zeros(z.shape[1]), np.ones(len(y)) if weight is None else weight
    penalty = np.full(z.shape[1], ridge * len(y))
    penalty[-1] = 1e-6 * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        g = z.T @ (c * (p - y)) + penalty * w
        h = (z * (c * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts and labels that the model is fitted on: a bounded number of distinct texts of each label."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    order = F.xxhash64(F.lit(3), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_ROWS).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(CLEAN_ROWS))
    texts = docs.select("doc_id", "text").join(F.broadcast(staged(chosen, "labelled")), "doc_id").where("text is not null")
    texts = texts.select("text", "toxic", F.xxhash64("text").alias("h"))
    return staged(texts.groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).repartition(8, "h"), "labelled-texts")


def _pieces(texts: DataFrame, only: set[str] | None = None) -> DataFrame:
    """(piece, n): the number of texts with a piece."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts.update(_own(x, only))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["piece", "n"])

    return texts.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _own(text: str, only: set[str] | None) -> set[str]:
    counts = Counter(s for w in _LETTERS.findall(text.lower()) if len(w) > 1 for s in stems(w))
    found = counts.keys() | {s + TWICE for s, n in counts.items() if n > 1}
    return found if only is None else found & only


def learned_insults(sample: DataFrame) -> dict[str, float]:
    """Insults with weights: the fixed list, and learned stems that explain toxic texts."""
    insults = {"=" + w: 1.5 for w in INSULTS.split()}
    n_toxic, n_clean = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n_toxic or not n_clean:
        return insults
    least = max(3, 0.003 * n_toxic)
    # a text has boundedly many pieces on average, so this many can occur in a given share of at most TOXIC_ROWS texts
    toxic = {r["piece"]: r["n"] for r in _pieces(sample.where("toxic = 1")).where(F.col("n") >= least).collect()}
    sent = set(toxic)
    clean = {r["piece"]: r["n"] for r in _pieces(sample.where("toxic = 0"), sent).collect()}
    odds = {p: np.log((n + 0.5) / n_toxic) - np.log((clean.get(p, 0) + 0.5) / n_clean) for p, n in toxic.items()}
    sharp = {p for p, v in odds.items() if v >= 2.5 and toxic[p] > 4 * clean.get(p, 0)}

    def marked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_own(x, sharp)) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["pieces"])

    texts = [set(r[0]) for r in sample.where("toxic = 1").select("text").mapInArrow(marked, "pieces array<string>").collect()]
    open_ = Counter(p for t in texts for p in t)
    left = [t for t in texts if t]
    while left and open_:
        # most newly explained texts first; of equals the surest, then the longest stem
        best = max(open_, key=lambda p: (open_[p] - clean.get(p, 0) * n_toxic / n_clean, -clean.get(p, 0), len(p), p))
        if open_[best] < max(2, 0.002 * n_toxic):
            break
        insults[best] = max(insults.get(best, 0), float(min(odds[best], 6.0)) / 2)
        for t in [t for t in left if best in t]:
            open_.subtract(t)
        left = [t for t in left if best not in t]
    return insults


class Scorer:
    def __init__(self, insults: dict[str, float], weights: np.ndarray, bias: float):
        self.grammar, self.weights, self.bias = Grammar(insults), weights, bias

    def score(self, text: bytes | None) -> float:
        z = float(squashed(self.grammar.features(text)) @ self.weights + self.bias)
        return 1 / (1 + np.exp(-max(-35.0, min(35.0, z))))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray, float]:
    """(insults, weights, bias) from the labelled rows that are not held out."""
    sample = _sample(docs, labels)
    insults = learned_insults(sample)

    def run(batches):
        grammar = Grammar(insults)
        for batch in batches:
            x = [squashed(grammar.features(t.as_py())).tolist() for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int64())], names=["x", "y"])

    rows = sample.select("text", "toxic").mapInArrow(run, "x array<double>, y long").collect()
    y = np.array([r["y"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return insults, *DEFAULT
    x = np.array([r["x"] for r in rows])
    weights, bias = fit_logistic(x, y, ridge=1e-5)
    # a tag that the labels say nothing about keeps its default weight
    unseen = (x > 0).sum(axis=0) < 5
    return insults, np.where(unseen, DEFAULT[0], weights), bias


_SCORERS: dict[str, Scorer] = {}


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Append a score (0 to 1) and a prediction (1 from ``threshold`` on) under the given names."""
    model, token = fitted(in_small_batches(docs), labels), uuid.uuid4().hex
    place = [c for c in docs.columns if c.lower() not in names].index("text")

    def f(batch: pa.RecordBatch) -> list[pa.Array]:
        if token not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[token] = Scorer(*model)
        s = [_SCORERS[token].score(x.as_py()) for x in batch.column(place).cast(pa.binary())]
        return [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]

    return with_columns(docs, f, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
