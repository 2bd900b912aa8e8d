"""Toxicity: a lexicon trie met with Levenshtein automata, and windows around each hit that tell quotation from abuse.

The lexicon is learned from the labelled sample: whole words, and beginnings of words, that toxic documents have and
others lack. Words of a text run through one deterministic automaton, the intersection of the trie with the Levenshtein
automata of its terms, built state by state as texts need it: a state is the set of trie nodes that are reachable, each
with the fewest edits. So misspelled terms are caught in one pass over a word. Around each hit a window of words is
looked at: marks of quotation on both sides, or a verb of reporting, make it a quotation; a second person makes it
address. A document's counts of hits by term, exact, misspelled, quoted and addressed, go into a logistic regression.

The model is fitted on at most ``max_docs`` labelled rows, chosen by a hash of the id, all with their whole texts; the
lexicon has as many terms as rows give reason for. Terms are words of letters alone, SHORTEST at least, that LEAST_ROWS
toxic rows have; a text whose only terms are others has no hit. Scores use the text alone.

Cases: null and empty texts get the score of a document without hits; without labelled rows of both labels every score is
0.5; equal texts get equal scores; repeated rows are scored each, and those with a null id; empty tables give no rows;
very long texts are scored whole, by a task that holds their words; columns other than doc_id and text are not read,
whatever their names. Of conflicting labels of an id the largest counts, of its texts the first by their bytes."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from heapq import heapify, heappop, heapreplace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import labelled_sample
from veilgrid.llm.quality import with_score

#: Bound of the labelled sample, fewest toxic rows for a term, lengths of beginnings.
MAX_DOCS, LEAST_ROWS, SHORTEST, LONGEST = 8000, 3, 4, 12
#: Words on either side of a hit that its window has.
WINDOW = 6
#: Distinct words, and steps of the automaton, that a worker remembers.
CACHE_WORDS, CACHE_STEPS = 250_000, 200_000
QUOTES = frozenset("\"'“”„«»‘’‚‹›「」")
REPORTING = frozenset("said says quote quoted quotes wrote called writes sagte sagt schrieb zitat zitiert dit écrit cite cité dijo dice escribió cita".split())
ADDRESS = frozenset("you your you're yourself du dich dir dein deine ihr euch tu toi ton vous votre tú te usted ustedes vosotros".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class Automaton:
    """Terms are words; a term that ends in ``*`` stands for all words that begin so. ``match`` gives (edits, term number)
    of the closest term within its allowed edits, the first of equals, or None."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool] | None] = [None]  # number of the term, whether it is a beginning
        self.reach = [0]  # most edits allowed to any term below a node
        for k, term in enumerate(terms):
            word, most, at = term.rstrip("*"), edits_allowed(term.rstrip("*")), 0
            self.reach[0] = max(self.reach[0], most)
            for c in word:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], most)
            if self.ends[at] is None:
                self.ends[at] = (k, term.endswith("*"))
        self.alphabet = {c for x in self.children for c in x}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.best: list[tuple[int, int] | None] = []  # of what has matched already, whatever follows
        self.steps: list[dict[str, int]] = []
        self.size = 0
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], best: tuple[int, int] | None) -> int:
        todo = list(nodes.items())
        while todo:  # characters of a term that the word lacks
            node, cost = todo.pop()
            if nodes.get(node) == cost:
                for child in self.children[node].values():
                    if cost + 1 <= self.reach[child] and nodes.get(child, 99) > cost + 1:
                        nodes[child] = cost + 1
                        todo.append((child, cost + 1))
        for node, cost in nodes.items():
            end = self.ends[node]
            if end and end[1] and cost <= edits_allowed(self.terms[end[0]].rstrip("*")):
                best = min(best or (99, 0), (cost, end[0]))
        key = (frozenset(nodes.items()), best)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.best.append(best)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, cost in self.sets[state].items():
            if cost + 1 <= self.reach[node]:
                out[node] = min(out.get(node, 99), cost + 1)  # a character too many
            for letter, child in self.children[node].items():
                price = cost + (letter != c)
                if price <= self.reach[child]:
                    out[child] = min(out.get(child, 99), price)
        self.size += 1
        return self._state(out, self.best[state])

    def match(self, word: str) -> tuple[int, int] | None:
        if self.size > CACHE_STEPS:
            self._forget()
        at = self.start
        for c in word:
            if c not in self.alphabet:
                c = ""
            step = self.steps[at]
            if c not in step:
                step[c] = self._step(at, c)
            at = step[c]
            if not self.sets[at]:
                return self.best[at]
        found = self.best[at]
        for node, cost in self.sets[at].items():
            end = self.ends[node]
            if end and cost <= edits_allowed(self.terms[end[0]].rstrip("*")):
                found = min(found or (99, 0), (cost, end[0]))
        return found


def bare(word: str) -> str:
    """Lower case, without marks at either end."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


def learn_lexicon(rows: list[tuple[int, str, int]]) -> list[str]:
    """Terms chosen one by one, each for the most toxic rows that no chosen one covers, less the share of other rows."""
    holders: dict[str, list[int]] = {}
    others: Counter[str] = Counter()
    toxic = [i for i, (*_, label) in enumerate(rows) if label]
    if not toxic or len(toxic) == len(rows):
        return []
    terms_of = lambda text: {t for w in {bare(x) for x in text.split()} if len(w) >= SHORTEST and w.isalpha()
                             for t in (w, *(w[:k] + "*" for k in range(SHORTEST, min(len(w), LONGEST) + 1)))}
    for i in toxic:
        for t in terms_of(rows[i][1]):
            holders.setdefault(t, []).append(i)
    holders = {t: x for t, x in holders.items() if len(x) >= LEAST_ROWS}
    for _, text, label in rows:
        if not label:
            others.update(terms_of(text) & holders.keys())
    share = len(toxic) / (len(rows) - len(toxic))
    # of beginnings that say the same, the longest; a whole word before a beginning
    order = sorted(holders, key=lambda t: (not t.endswith("*"), len(t), t), reverse=True)
    covered: set[int] = set()
    chosen: list[str] = []
    gain = lambda t: len([i for i in holders[t] if i not in covered]) - 2 * share * others[t]
    # gains only fall as rows are covered, so the best of the old ones is the best if it is still what it was
    queue = [(-gain(t), k, t) for k, t in enumerate(order)]
    heapify(queue)
    while queue and -queue[0][0] >= LEAST_ROWS - 1:
        was, k, term = queue[0]
        now = -gain(term)
        if now != was:
            heapreplace(queue, (now, k, term))
            continue
        heappop(queue)
        chosen.append(term)
        covered.update(holders[term])
    # then terms that other rows hardly have, whole words first, none that begins a chosen one or with one
    for t in sorted(holders, key=lambda t: (t.endswith("*"), -len(holders[t]), t)):
        if len(holders[t]) >= 3 * LEAST_ROWS and others[t] <= len(holders[t]) * share / 4:
            if not any(t.rstrip("*").startswith(c.rstrip("*")) or c.startswith(t.rstrip("*")) for c in chosen):
                chosen.append(t)
    return chosen


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray | None = None
    bias: float = 0.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    automaton: Automaton | None = field(default=None, repr=False)
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "automaton": None, "known": {}}

    def forget(self) -> None:
        self.known.clear()
        self.automaton = None

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, bool, bool]], int]:
        """(place, edits, term, quoted, addressed) of each hit, and the number of words."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        words = text.split()
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > CACHE_WORDS:
                known.clear()
                new = set(words)
            match = self.automaton.match
            for w in new:
                known[w] = match(bare(w))
        out = []
        for i, found in enumerate(map(known.__getitem__, words)):
            if found is not None:
                out.append((i, *found, *self._window(words, i)))
        return out, len(words)

    @staticmethod
    def _window(words: list[str], i: int) -> tuple[bool, bool]:
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        own = words[i]
        opened = own[0] in QUOTES or any(w[0] in QUOTES for w in before)
        closed = any(c in QUOTES for c in own[-2:]) or any(any(c in QUOTES for c in w[-2:]) for w in after)
        near = {bare(w) for w in before + after}
        return (opened and closed) or bool(near & REPORTING), bool(near & ADDRESS)

    def features(self, text: str | None) -> np.ndarray:
        k = len(self.terms)
        out = np.zeros(2 * k + 6)
        found, n = self.hits(text or "")
        for _, edits, term, quoted, addressed in found:
            out[2 * k + (2 if quoted else 0) + (1 if edits else 0)] += 1
            out[2 * k + 4] += addressed
            if not quoted:
                out[term + (k if edits else 0)] += 1
        exact = out[:k].sum()
        out = np.log1p(out)
        out[-1] = np.log1p(1000 * exact / (n + 10))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -40, 40)))


def fit(rows: list[tuple[int, str, int]]) -> Model:
    model = Model(learn_lexicon(rows))
    y = np.array([label for *_, label in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return model
    x = np.stack([model.features(text) for _, text, _ in rows])
    model.mean, model.scale = x.mean(0), x.std(0) + 0.05
    z = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 1.0), 1e-6)
    for _ in range(30):  # Newton's method on the penalised log loss
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, max_docs: int = MAX_DOCS) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", keep, max_docs))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    rows = with_score(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), model)
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
