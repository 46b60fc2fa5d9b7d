"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed by their context.

The lexicon lies in a trie. A word's Levenshtein automaton, determinised lazily by characteristic
vectors, walks the trie with it and dies early, so a word costs a few steps. Terms come from a
short fixed list and from labelled rows, each with the evidence that a hit of it is; a word within the
edits that a term's length allows counts as the term, discounted for each edit, unless clean rows hold it
as a word of its own. Each hit's context window says whether it is quoted or reported, aimed at somebody, or
plain. A text's features are the plain evidence of its worst passage, hits by words, whether one is
aimed, and the quoted evidence; a logistic regression gives the score.

Learning looks at a bounded sample: at most SAMPLE labelled rows (first by hash of the id) and SAMPLE_BYTES
of text, outside the held-out fold. Scoring looks at the text alone.

Defined results: null and empty texts have no hits and the score of such; labels of one id disagreeing count as toxic;
labels without a text or a value are left out; of texts under one id the first by hash is learnt from; without labels the weights of PRIOR hold; repeated rows give
repeated results; a text of any length is walked once, only its words' places being held; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import crc_mod, filter_rows, in_files, kept, map_rows, read, stage_table

FOLDS = 5
#: Labelled rows that are learnt from at most.
SAMPLE = 6000
#: Bytes of text that these rows have at most: of a larger sample the first by hash of the text.
SAMPLE_BYTES = 96 << 20
#: Sampled texts of a file.
SAMPLED_PER_FILE = 1 << 10
#: Tokens before and after a hit that are its context.
WINDOW = 6
#: Words of a passage: of a text the passage with most evidence counts.
PASSAGE = 120
#: Words that a text is taken to have at least where hits are counted by words.
SHORT = 25
#: What is left of a hit's evidence for each edit between the word and the term.
DISCOUNT = 0.7
#: Toxic rows that a learnt term has at least, its least evidence, and the most terms that are learnt.
SUPPORT, LEAST, TERMS = 3, 2.5, 400
#: Evidence of a listed term without labelled rows; the toxic rows that it counts as having besides those seen; and the most evidence of a text.
UNSEEN, UNSEEN_ROWS, MOST = 6.0, 16, 16.0
FEATURES = ["bias", "peak", "density", "aimed", "quoted"]
#: Weights before anything is learnt, to which the fit is drawn: of quoted evidence a tenth counts.
PRIOR = (-4.0, 1.0, 1.0, 0.5, 0.1)
#: How strongly: labelled rows that say nothing of a context leave its weight where it was.
RIDGE = 20.0

# Insults, words of reporting, words that aim at somebody.
SEED_TERMS = "asshole bastard bitch clown coward cretin degenerate disgusting dumb dumbass filth fool garbage idiot idiotic imbecile jackass jerk liar loser lowlife moron moronic pathetic pig psycho rat scum scumbag stupid trash ugly vermin worthless".split()
REPORTING = set("said says called calls wrote writes word words term quote quoted quotes dictionary sagte nannte wort dit appelle mot dijo palabra".split())
TARGETS = set("you your youre u he she they him her them this that tu vous du ihr sie er usted él".split())
# End of fixed values.

WORD = re.compile(r"[^\W_]+")
QUOTES = "\"'“”„«»‘’‹›`"


def allowed_edits(length: int) -> int:
    """Edits within which a term of that length is recognised."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Levenshtein automata of all words for one number of edits.

    A state is a set of (offset from a base, edits) positions; the next state depends only on the state
    and on where the next 2 * edits + 1 characters of the word equal the one read, so transitions are
    kept by these two and serve every word.
    """

    def __init__(self, edits: int) -> None:
        self.edits, self.width = edits, 2 * edits + 2
        self._next: dict = {}

    def start(self) -> tuple[int, tuple]:
        return 0, ((0, 0),)

    def step(self, state: tuple[int, tuple], char: str, word: str) -> tuple[int, tuple] | None:
        base, shape = state
        window = word[base : base + self.width]
        vector = tuple(c == char for c in window)
        if (known := self._next.get((shape, vector))) is None:
            known = self._next[shape, vector] = self._move(shape, vector)
        return None if known == () else (base + known[0], known[1])

    def _move(self, shape: tuple, vector: tuple) -> tuple:
        new = set()
        for i, e in shape:
            if i < len(vector) and vector[i]:
                new.add((i + 1, e))
            if e < self.edits:
                new.add((i, e + 1))  # a character too many
                if i < len(vector):
                    new.add((i + 1, e + 1))  # another character
                for k in range(1, self.edits - e + 1):  # characters left out
                    if i + k < len(vector) and vector[i + k]:
                        new.add((i + k + 1, e + k))
        new = {(i, e) for i, e in new if not any(f < e and abs(i - j) <= e - f for j, f in new)}
        if not new:
            return ()
        low = min(i for i, _ in new)
        return low, tuple(sorted((i - low, e) for i, e in new))

    def accepts(self, state: tuple[int, tuple], length: int) -> int | None:
        """Edits with which a word of that length ends in the state; None if it doesn't."""
        base, shape = state
        ends = [e + length - base - i for i, e in shape if 0 <= length - base - i and e + length - base - i <= self.edits]
        return min(ends, default=None)


class Trie:
    """Terms that allow one number of edits. A node holds the nodes below it by character, the term that ends there
    under "", and the least and most characters still to come under None."""

    def __init__(self, terms: list[str], edits: int) -> None:
        self.edits, self.automaton, self.root = edits, Automaton(edits), {None: (1 << 30, 0)}
        # of edits + 1 parts of a term one stands unchanged in every word that is recognised, at most `edits` places
        # away: for each length of words, the slices to look at and what they hold then; it rules most words out
        looks: dict[int, dict[tuple[int, int], set[str]]] = {}
        for term in terms:
            node = self.root
            for at, c in enumerate((*term, "")):
                left = len(term) - at
                node[None] = (min(node[None][0], left), max(node[None][1], left))
                if c:
                    node = node.setdefault(c, {None: (1 << 30, 0)})
            node[""] = term
            cuts = [len(term) * k // (edits + 1) for k in range(edits + 2)]
            for n in range(len(term) - edits, len(term) + edits + 1):
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    shifts = [0] if k == 0 else [n - len(term)] if k == edits else range(-edits, edits + 1)
                    for shift in shifts:
                        if i + shift >= 0 and j + shift <= n:
                            looks.setdefault(n, {}).setdefault((i + shift, j + shift), set()).add(term[i:j])
        self._looks = {n: [(i, j, held) for (i, j), held in slices.items()] for n, slices in looks.items()}

    def first_look(self, word: str) -> bool:
        for i, j, held in self._looks.get(len(word), ()):
            if word[i:j] in held:
                return True
        return False

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term, the first by name among equals."""
        if not self.first_look(word):
            return None
        best: tuple[int, str] | None = None
        step, n, edits = self.automaton.step, len(word), self.edits
        todo = [(self.root, self.automaton.start())]
        while todo:
            node, state = todo.pop()
            for c, below in node.items():
                if c == "":
                    e = self.automaton.accepts(state, n)
                    if e is not None and (best is None or (e, below) < best):
                        best = (e, below)
                elif c is not None and (after := step(state, c, word)) is not None:
                    least, most = below[None]
                    # positions of the word that are alive lie from after[0] on; what is left must still fit
                    if least <= n - after[0] + edits and most + edits + self.automaton.width >= n - after[0]:
                        todo.append((below, after))
        return best


class Lexicon:
    """Terms by the edits that their length allows: those without any are looked up, the others lie in tries."""

    def __init__(self, terms: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for t in terms:
            by.setdefault(allowed_edits(len(t)), []).append(t)
        self.exact = set(terms)
        self.tries = [Trie(own, d) for d, own in sorted(by.items()) if d]

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits and their number; the first by name among equals."""
        if word in self.exact:
            return word, 0
        found = [f for t in self.tries if (f := t.find(word))]
        return (min(found)[1], min(found)[0]) if found else None


@dataclass
class Model:
    """Terms with the evidence that a hit of each is, words of their own that look like misspelled terms, and the weights of FEATURES."""

    evidence: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_TERMS, UNSEEN))
    ordinary: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: list(PRIOR))


class Scorer:
    """Scores texts by a model; what it has learnt of words is kept, up to a bound."""

    KEPT = 400_000

    def __init__(self, model: Model) -> None:
        self.model, self.lexicon = model, Lexicon(list(model.evidence))
        self.ordinary = set(model.ordinary)
        self._known: dict[str, float] = {}
        self._hits: dict[str, float] = {}

    def evidence(self, word: str) -> float:
        """What a hit of a word counts: its nearest term's evidence, less by DISCOUNT for each edit; 0 if it is no hit."""
        if word in self.ordinary or not (found := self.lexicon.find(word)):
            return 0.0
        return self.model.evidence[found[0]] * DISCOUNT ** found[1]

    def features(self, text: str | None) -> list[float]:
        lower = (text or "").lower()
        distinct = set(WORD.findall(lower))
        if len(self._known) > self.KEPT:
            self._known.clear()
            self._hits.clear()
        for w in distinct.difference(self._known):
            self._known[w] = own = self.evidence(w)
            if own > 0:
                self._hits[w] = own
        if distinct.isdisjoint(self._hits):
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        quoted = sum_ = peak = 0.0
        aimed, n = False, 0
        words, spans = [], []
        for m in WORD.finditer(lower):
            words.append(m[0])
            spans.append(m.span())
        near: deque = deque()  # (place, evidence) of plain hits of the last PASSAGE words
        for i, w in enumerate(words):
            if not (own := self._hits.get(w)):
                continue
            low, high = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            before, after = lower[spans[low][0] : spans[i][0]], lower[spans[i][1] : spans[high - 1][1] + 1]
            if self._is_quoted(before, after) or any(c in REPORTING for c in words[max(0, i - 3) : i]):
                quoted += own
                continue
            aimed |= any(c in TARGETS for c in words[low:i]) or any(c in TARGETS for c in words[i + 1 : high])
            near.append((i, own))
            sum_ += own
            n += 1
            while near[0][0] <= i - PASSAGE:
                sum_ -= near.popleft()[1]
            peak = max(peak, sum_)
        return [1.0, min(peak, MOST), math.log1p(100.0 * n / max(len(words), SHORT)), float(aimed), min(quoted, MOST)]

    @staticmethod
    def _is_quoted(before: str, after: str) -> bool:
        """Quotation marks open before and close after, in the window; an apostrophe inside a word is none."""
        opened = sum(c in QUOTES and not (c in "'’" and k and before[k - 1].isalnum() and before[k + 1 : k + 2].isalnum()) for k, c in enumerate(before))
        closed = any(c in QUOTES and not (c in "'’" and k and after[k - 1].isalnum() and after[k + 1 : k + 2].isalnum()) for k, c in enumerate(after))
        return opened % 2 == 1 and closed

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.model.weights, self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(rows: list[tuple[int, str]]) -> tuple[dict[str, float], list[str]]:
    """(evidence of terms, ordinary words) by how many toxic and clean rows hold a word.

    A term's evidence is the logarithm of its rate in toxic rows by that in clean rows. Words of enough toxic rows with
    LEAST evidence or more are terms, the most telling first; listed terms count as if UNSEEN_ROWS more toxic rows held
    them. A word that is no term, is near one and that clean rows hold is a word of its own, no misspelling.
    """
    toxic, clean = Counter(), Counter()
    n_toxic = sum(y for y, _ in rows)
    n_clean = len(rows) - n_toxic
    for y, text in rows:
        (toxic if y else clean).update(set(WORD.findall(text.lower())))

    def telling(word: str, more: int = 0) -> float:
        return math.log((toxic[word] + more + 0.5) / (n_toxic + more + 1)) - math.log((clean[word] + 0.5) / (n_clean + 1))

    own = {w: telling(w) for w, n in toxic.items() if n >= max(SUPPORT, n_toxic // 60)}
    chosen = sorted((w for w, e in own.items() if e >= LEAST), key=lambda w: (-toxic[w] * own[w], w))[:TERMS]
    evidence = {w: own[w] for w in chosen} | {w: max(0.0, telling(w, UNSEEN_ROWS)) for w in SEED_TERMS}
    lexicon = Lexicon(list(evidence))
    ordinary = sorted(w for w, n in clean.items() if n >= 2 and w not in evidence and telling(w) < LEAST and lexicon.find(w))
    return evidence, ordinary


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to PRIOR; evidence and aim never count against toxicity, and quoted evidence no more than plain."""
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        before, w = w, w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        w[1:] = np.maximum(w[1:], 0.0)
        w[4] = min(w[4], w[1])
        if np.abs(w - before).max() < 1e-8:
            break
    return w


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of labelled rows outside the held-out fold, at most `sample` of them."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    own = own.where(crc_mod("id", FOLDS) != 0).groupBy("id").agg(F.max("y").alias("y"))
    chosen = own.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)  # bounded, so it is broadcast
    got = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").where("text is not null")
    one = got.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("x")).select("x.*").distinct()  # a text for each id, however many rows share it
    got = stage_table(in_files(one, sample, SAMPLED_PER_FILE), "toxicity-sample")
    until, size = None, 0
    for r in got.select("h", F.octet_length("text").alias("n")).orderBy("h").collect():  # two numbers for each of at most `sample` texts
        size += r["n"]
        if size > SAMPLE_BYTES:
            break
        until = r["h"]
    rows = [] if until is None else sorted((int(r["y"] > 0), r["text"]) for r in got.where(F.col("h") <= until).collect())
    model = Model()
    if not 0 < sum(y for y, _ in rows) < len(rows):
        return model
    model.evidence, model.ordinary = learn_lexicon(rows)
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for _, t in rows])
    model.weights = fit(x, np.array([y for y, _ in rows], float)).tolist()
    return model


def scorer_of(model: Model) -> Scorer:
    """This process's scorer of a model, with what it has learnt of words."""
    return kept(("toxicity", repr(model)), lambda: Scorer(model))


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows whose score is under the threshold, all columns as they are."""

    def make():
        own = scorer_of(model)
        return lambda texts: [own.score(t) < threshold for t in texts]

    return filter_rows(df, text_col, make)


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""

    def make():
        own = scorer_of(model)

        def step(ids, held, texts):
            scores = [own.score(t) for t in texts]
            return ids, held, scores, [int(s >= 0.5) for s in scores]

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, FOLDS) == 0).alias("held_out"), text_col)
    return map_rows(rows, f"doc_id {kind}, held_out boolean, score double, predicted int", make)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score_documents(documents, train(documents, read(spark, sf_dir, "labels")))
