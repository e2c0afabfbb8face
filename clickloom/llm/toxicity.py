"""Toxicity scores from a learned lexicon, misspellings and the context of each hit.

The lexicon is learned from a bounded sample of labelled texts: words, and stems that many words begin with,
that toxic texts hold far more often than the share of toxic texts explains. A Levenshtein automaton of each
entry is run through the trie of all entries at once; its states are sets of (trie node, edits) that are
worked out once and kept. An edit is an inserted, deleted or replaced character or two neighbours swapped, and
longer entries allow more of them. Digits and signs inside a word belong to it, as in ``id1ot`` or ``sc*m``.
Each hit is judged by its entry, its edits and the window of words around it, which tells quotation and
reporting from abuse; reporting words and the weights of these classes are learned from the same sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.text import sample_below, utf8
from clickloom.session import discard, staged

# Labelled texts that are learned from, at most about this many.
LEARN_ROWS = 20_000
# Stems have so many letters at least; shorter words are entries as wholes.
SHORTEST = 4
# An entry of so many letters allows one edit, and two.
FUZZY, FUZZIER = 5, 8
# Words on either side of a hit that make up its context.
WINDOW = 8
THRESHOLD = 0.7
# States and words that a worker keeps; beyond that it starts afresh, with the same results.
MOST_STATES, MOST_WORDS = 200_000, 500_000
LETTERS = re.compile(r"[^\W\d_]+")
# Letters and digits, with up to three signs between two of them or one that stands for a first letter.
WORD = re.compile(r"(?:[@$](?=[^\W\d_]))?[^\W_]+(?:[*@$#!%&+_]{1,3}[^\W_]+)*")
QUOTES = re.compile("[\"“”„«»]")
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.IntegerType())])


def most_edits(entry: str, stem: bool) -> int:
    """A stem leaves its ending open already, so one edit is its most."""
    return (len(entry) >= FUZZY) + (len(entry) >= FUZZIER and not stem)


class Automaton:
    """All entries within their number of edits of a word, or of a beginning of it where the entry is a stem.

    The union of the entries' Levenshtein automata is the product of their trie with an edit count and, within a
    swap, the letter that is still to come; it is made deterministic as words are read.
    """

    def __init__(self, entries: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.entries = entries
        self.bounds = [most_edits(*entry) for entry in entries]
        for number, (text, _) in enumerate(entries):
            at = 0
            for c in text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                at = self.children[at][c]
            self.ends[at].append(number)
        # How many edits some entry at or below a node allows.
        self.most = [0] * len(self.children)
        for at in range(len(self.children) - 1, -1, -1):  # a child has a larger number than its parent
            self.most[at] = max([self.bounds[e] for e in self.ends[at]] + [self.most[c] for c in self.children[at].values()], default=0)
        self._reset()

    def _reset(self) -> None:
        self.sets: list[frozenset[tuple[int, int, str]]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.stems: list[dict[int, int]] = []
        self._state(self._closed({(0, 0, "")}))

    def _closed(self, nodes: set[tuple[int, int, str]]) -> frozenset[tuple[int, int, str]]:
        """With the nodes that are reached by leaving letters of an entry out; of equal nodes those with the fewest edits."""
        fewest: dict[tuple[int, str], int] = {}
        left = sorted(nodes, key=lambda n: -n[1])
        while left:
            at, edits, swapped = left.pop()
            if fewest.get((at, swapped), 9) <= edits:
                continue
            fewest[at, swapped] = edits
            if not swapped:
                left += [(c, edits + 1, "") for c in self.children[at].values() if edits < self.most[c]]
        return frozenset((at, edits, swapped) for (at, swapped), edits in fewest.items())

    def _state(self, nodes: frozenset) -> int:
        number = self.numbers.get(nodes)
        if number is None:
            number = self.numbers[nodes] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            self.stems.append({e: k for e, k in self._found(nodes).items() if self.entries[e][1]})
        return number

    def _found(self, nodes: frozenset) -> dict[int, int]:
        found: dict[int, int] = {}
        for at, edits, swapped in nodes:
            if not swapped:
                for entry in self.ends[at]:
                    if edits <= self.bounds[entry]:
                        found[entry] = min(edits, found.get(entry, 9))
        return found

    def _step(self, state: int, c: str) -> int:
        out = set()
        for at, edits, swapped in self.sets[state]:
            if swapped:
                if c == swapped:
                    out.add((at, edits, ""))
                continue
            below = self.children[at]
            if c in below:
                out.add((below[c], edits, ""))
            if edits < self.most[at]:
                out.add((at, edits + 1, ""))  # c was added
                for letter, child in below.items():
                    if edits < self.most[child]:
                        out.add((child, edits + 1, ""))  # c stands for another letter
                        after = self.children[child].get(c)
                        if after is not None and letter != c and edits < self.most[after]:
                            out.add((after, edits + 1, letter))  # c comes before the letter instead of after it
        return self._state(self._closed(out))

    def best(self, word: str) -> tuple[int, int] | None:
        """The entry with the fewest edits, the longest of equal ones, and its edits; None if none matches."""
        if len(self.sets) > MOST_STATES:
            self._reset()
        state, found = 0, {}
        for c in word:
            after = self.steps[state].get(c)
            if after is None:
                after = self.steps[state][c] = self._step(state, c)
            state = after
            if not self.sets[state]:
                break
            if self.stems[state]:
                for entry, edits in self.stems[state].items():
                    found[entry] = min(edits, found.get(entry, 9))
        else:
            for entry, edits in self._found(self.sets[state]).items():
                found[entry] = min(edits, found.get(entry, 9))
        if not found:
            return None
        entry = min(found, key=lambda e: (found[e], -len(self.entries[e][0]), e))
        return entry, found[entry]


def _judged(word: str, automaton: Automaton) -> tuple[int, int] | None:
    """The best entry for a word as it stands, or for a run of letters in it."""
    found = [automaton.best(word)]
    if not word.isalpha():
        found += [automaton.best(part) for part in LETTERS.findall(word)]
    return min((f for f in found if f is not None), key=lambda f: (f[1], -len(automaton.entries[f[0]][0]), f[0]), default=None)


def _hits(text: str, automaton: Automaton, kept: dict[str, tuple[int, int] | None]) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """The lower-cased words of a text, and (place, start, entry, edits) for each of them that is a hit."""
    lower = text.lower()
    words = WORD.findall(lower)
    hits = {}
    for word in set(words):
        if word not in kept:
            if len(kept) > MOST_WORDS:
                kept.clear()
            kept[word] = _judged(word, automaton)
        if kept[word] is not None:
            hits[word] = kept[word]
    if not hits:
        return words, []
    return words, [(i, m.start(), *hits[m.group()]) for i, m in enumerate(WORD.finditer(lower)) if m.group() in hits]


def _around(words: list[str], place: int) -> list[str]:
    return words[max(0, place - WINDOW) : place] + words[place + 1 : place + 1 + WINDOW]


def contexts(
    text: str, automaton: Automaton, kept: dict[str, tuple[int, int] | None], reporting: frozenset[str] = frozenset()
) -> list[tuple[int, int, bool]]:
    """(entry, edits, quoted) for every hit of a text: quoted in short quotation marks, or near a reporting word."""
    words, hits = _hits(text, automaton, kept)
    if not hits:
        return []
    lower = text.lower()
    quotes = [m.start() for m in QUOTES.finditer(lower)]
    out = []
    for place, start, entry, edits in hits:
        before = int(np.searchsorted(quotes, start))
        inside = before % 2 == 1 and before < len(quotes) and lower.count(" ", quotes[before - 1], quotes[before]) <= 2 * WINDOW
        out.append((entry, edits, bool(inside or not reporting.isdisjoint(_around(words, place)))))
    return out


@dataclass
class Model:
    entries: list[tuple[str, bool]]
    # Words that stand around hits in clean texts.
    reporting: frozenset[str] = frozenset()
    # Log odds of a hit by (entry, edits) and by (edits, quoted); of both, features make up a logistic model.
    by_entry: dict[tuple[int, int], float] = field(default_factory=dict)
    by_context: dict[tuple[int, bool], float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def evidence(self, entry: int, edits: int, quoted: bool) -> float:
        """Log odds of a hit; if no labelled text had one with so many edits, those of one edit less."""
        while edits and (edits, quoted) not in self.by_context and (edits, not quoted) not in self.by_context:
            edits -= 1
        return self.by_entry.get((entry, edits), 0.0) + self.by_context.get((edits, quoted), 0.0)

    def features(self, hits: list[tuple[int, int, bool]]) -> list[float]:
        """A constant, whether there is a hit, the best evidence and all evidence on a log scale."""
        if not hits:
            return [1.0, 0.0, 0.0, 0.0]
        odds = [self.evidence(*hit) for hit in hits]
        return [1.0, 1.0, max(odds), math.log1p(sum(max(o, 0.0) for o in odds))]

    def score(self, hits: list[tuple[int, int, bool]]) -> float:
        x = float(np.dot(self.weights, self.features(hits)))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(SHORTEST, len(word) + 1)] if len(word) >= SHORTEST else [word]


def _lexicon(toxic: Counter, clean: Counter, words: Counter, n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """Entries from how many toxic and clean texts hold words with each beginning.

    A beginning counts if chance explains its toxic texts with odds of less than one in a hundred over all
    beginnings, and if nine of ten texts with it are toxic. Of beginnings that the same toxic texts hold the
    longest is taken, and none below one that is taken already. It is a whole word if most of its texts hold
    it as a word. Words shorter than a stem count as they are.
    """
    share = (n_toxic + 1) / (n_toxic + n_clean + 2)
    least = math.log(100 * max(len(toxic), 1))

    def gain(text: str) -> float:
        t, c = toxic[text], clean[text]
        p = t / (t + c)
        return t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c else 0.0)

    def good(text: str) -> bool:
        return toxic[text] >= 9 * clean[text] and gain(text) >= least

    below: dict[str, list[str]] = {}
    for text in toxic:
        if len(text) > SHORTEST:
            below.setdefault(text[:-1], []).append(text)
    taken = []
    left = sorted(t for t in toxic if len(t) <= SHORTEST)
    while left:
        text = left.pop()
        if good(text):
            while same := [t for t in below.get(text, ()) if toxic[t] == toxic[text]]:
                text = same[0]
            taken.append(text)
        else:
            left += below.get(text, ())
    taken.sort(key=lambda t: (-gain(t), t))
    return [(t, words[t] < 0.8 * toxic[t]) for t in taken]


def _reporting(clean: Counter, toxic: Counter, n_clean: int, n_toxic: int) -> frozenset[str]:
    """Words from how many clean and toxic texts with a hit hold them near one, by the test of chance that entries take."""
    share = (n_clean + 1) / (n_clean + n_toxic + 2)
    least = math.log(100 * max(len(clean), 1))

    def good(word: str) -> bool:
        c, t = clean[word], toxic[word]
        p = c / (c + t)
        return p > share and c * math.log(p / share) + (t * math.log((1 - p) / (1 - share)) if t else 0.0) >= least

    return frozenset(w for w in clean if good(w))


def _partial(batches, tell):
    """Adds up what ``tell`` counts in each text of a task: (key, toxic, n) rows."""
    found: Counter = Counter()
    for batch in batches:
        for label, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            found.update((key, label) for key in tell(data.decode()))
    keys = list(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())],
        ["key", "toxic", "n"],
    )


COUNTS = "key string, toxic int, n long"


def learn(docs: DataFrame, labels: DataFrame, train: Column, rows: int = LEARN_ROWS) -> Model:
    """A model from documents for which ``train`` holds and that have a label ``toxic`` of 0 or 1.

    A document with several labels has the largest of them; rows without an id or a label are left out.
    """
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.where(train)
    chosen = chosen.where(sample_below(F.col("doc_id"), chosen.count(), rows))
    # The choice holds about `rows` ids, so it may be broadcast.
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    def of_toxic(batches):
        return _partial(batches, lambda text: {p for w in set(LETTERS.findall(text.lower())) for p in [*_beginnings(w), " " + w]})

    told = sample.where("toxic = 1").mapInArrow(of_toxic, COUNTS).groupBy("key").agg(F.sum("n").alias("n"))
    # Beginnings in fewer toxic texts can't pass the test of chance, whatever the sample.
    least = max(2, math.ceil(math.log(100) / -math.log((n_toxic + 1) / (n_toxic + n_clean + 2))))
    told = {r["key"]: r["n"] for r in told.where(F.col("n") >= least).collect()}  # bounded by the sample
    toxic = Counter({k: n for k, n in told.items() if k[0] != " "})
    words = Counter({k[1:]: n for k, n in told.items() if k[0] == " "})
    shared = docs.sparkSession.sparkContext.broadcast(set(toxic))

    def of_clean(batches):
        return _partial(batches, lambda text: {p for w in set(LETTERS.findall(text.lower())) for p in _beginnings(w) if p in shared.value})

    clean = sample.where("toxic = 0").mapInArrow(of_clean, COUNTS).groupBy("key").agg(F.sum("n").alias("n")).collect()
    model = Model(_lexicon(toxic, Counter({r["key"]: r["n"] for r in clean}), words, n_toxic, n_clean))

    def near(batches):
        automaton, kept = Automaton(model.entries), {}

        def tell(text):
            seen, found = _hits(text, automaton, kept)
            return {w for place, *_ in found for w in _around(seen, place)} | ({""} if found else set())

        return _partial(batches, tell)

    close = {0: Counter(), 1: Counter()}
    for r in sample.mapInArrow(near, COUNTS).groupBy("key", "toxic").agg(F.sum("n").alias("n")).collect():  # bounded by the sample
        close[r["toxic"]][r["key"]] = r["n"]
    with_hit = {y: close[y].pop("", 0) for y in close}
    model.reporting = _reporting(close[0], close[1], with_hit[0], with_hit[1])

    def hits(batches):
        automaton, kept = Automaton(model.entries), {}
        for batch in batches:
            found = [contexts(d.decode(), automaton, kept, model.reporting) for d in utf8(batch.column(1))]
            flat = [[v for h in f for v in (h[0], h[1], int(h[2]))] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(flat, pa.list_(pa.int32()))], ["toxic", "hits"])

    seen = sample.mapInArrow(hits, "toxic int, hits array<int>").groupBy("toxic", "hits").count().collect()  # at most `rows`
    discard(sample)
    _fit(model, [([(h[i], h[i + 1], bool(h[i + 2])) for i in range(0, len(h), 3)], y, n) for y, h, n in seen], n_toxic, n_clean)
    return model


def _fit(model: Model, seen: list[tuple[list[tuple[int, int, bool]], int, int]], n_toxic: int, n_clean: int) -> None:
    """Log odds of hit classes, smoothed by two texts of each kind, and a logistic model over the features."""
    prior = math.log((n_toxic + 1) / (n_clean + 1))
    for table, key in ((model.by_entry, lambda h: h[:2]), (model.by_context, lambda h: h[1:])):
        counts = {0: Counter(), 1: Counter()}
        for hits, y, n in seen:
            for k in {key(h) for h in hits}:
                counts[y][k] += n
        for k in sorted(counts[0] | counts[1]):
            table[k] = math.log((counts[1][k] + 0.5) / (counts[0][k] + 0.5)) - prior
    if not seen:
        return
    x = np.array([model.features(hits) for hits, _, _ in seen])
    y, n = np.array([y for _, y, _ in seen], dtype=float), np.array([n for _, _, n in seen], dtype=float)
    ridge = np.array([1e-3, 0.1, 0.1, 0.1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + ridge @ (w * w) / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (n * (p - y)) + ridge * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step, length = np.linalg.solve(bend, slope), 1.0
        # A full step may overshoot where the classes are far apart; a shorter one always gains.
        while length > 1e-9 and loss(w - length * step) > loss(w) - 1e-4 * length * float(slope @ step):
            length /= 2
        w = w - length * step
        if length * float(slope @ step) < 1e-9 * (1 + loss(w)):
            break
    model.weights = w


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``into``: score from 0 to 1 and n_hits, for each whole text.

    A null or empty text has no hits and the score of a text without any. If nothing was learned every text
    has the same score. Repeated rows have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # entries and words of the bounded sample

    @F.arrow_udf(RESULT)
    def score(texts: pa.Array) -> pa.Array:
        model, automaton, kept = shared.value, _automaton(shared), _KEPT
        found = [contexts(t.decode(), automaton, kept, model.reporting) for t in utf8(texts)]
        columns = [pa.array([model.score(f) for f in found], pa.float64()), pa.array([len(f) for f in found], pa.int32())]
        return pa.StructArray.from_arrays(columns, names=RESULT.fieldNames())

    return docs.withColumn(into, score.asNondeterministic()(F.col(text)))


# The automaton of the model that a worker scores with, and the words that it has judged.
_KEPT: dict[str, tuple[int, int] | None] = {}
_CURRENT: list = [None, None]


def _automaton(shared) -> Automaton:
    if _CURRENT[0] != shared.value.entries:
        _KEPT.clear()
        _CURRENT[:] = [shared.value.entries, Automaton(shared.value.entries)]
    return _CURRENT[1]
