"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows around its terms.

The lexicon is learned from labelled texts: words, and beginnings of words (stems), that
toxic texts hold far more often than chance among as many candidates allows. Its trie is
intersected with the Levenshtein automaton of each term's allowed distance; the product is
a deterministic automaton whose states are built when a text first reaches them. The words
around a found term tell quotation and report, which weigh less, from address, which weighs
more. A logistic curve over the evidence, fitted to the same texts, gives the score.
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

from promptlens.llm.common import written
from promptlens.llm.quality_knn import held_out

# Bounds of the fit: expected labelled texts of each class (clean, toxic), terms of the lexicon.
SAMPLE_DOCS, MAX_TERMS = (16_000, 8_000), 600
# A term begins at three letters and is held by three texts; a stem has at most so many letters.
MIN_LETTERS, MIN_DOCS, MAX_STEM = 3, 3, 8
# Nats by which a term's excess among toxic texts must beat the number of candidates, and its least share of toxic texts.
MARGIN, LEAST_SHARE = 2.0, 0.5
# A stem goes if one longer term has this share of its toxic texts.
EXPLAINED = 0.9
# Distances by a term's length; a stem, which any ending may follow, needs one step more.
ONE_EDIT, TWO_EDITS, STEM_EDIT = 5, 9, 6
EDIT_WEIGHT = (1.0, 0.7, 0.4)
THRESHOLD = 0.5
# Words on each side that are a term's context, and what quotation, report and address make of its weight.
WINDOW = 8
QUOTED, REPORTED, ADDRESSED = 0.3, 0.6, 1.25
# Automaton states and words kept by a task before it starts afresh, characters taken at a time.
STATES, WORDS, CHUNK = 100_000, 400_000, 1 << 20

# FIXED VALUES: pairs of quotation marks; words of report and of address in the languages of the texts.
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("»", "«"), ("‘", "’"), ("‹", "›"))
REPORT = frozenset("said says called calls wrote writes quote quoted quotes word term means sagte sagt nannte schrieb zitat wort dit disait appelle écrit mot citation dijo dice llamó escribió palabra cita".split())
ADDRESS = frozenset("you your yours u ya du dich dir dein deine ihr euch tu toi te vous votre ton tú ti usted ustedes vosotros eres".split())

TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float

    @property
    def edits(self) -> int:
        n = len(self.text)
        if self.stem:
            return int(n >= STEM_EDIT)
        return 2 if n >= TWO_EDITS else int(n >= ONE_EDIT)


class Lexicon:
    """The trie of ``terms`` and its product with their Levenshtein automata; ``known`` words are no misspellings."""

    def __init__(self, terms: list[Term], known: frozenset[str] = frozenset()):
        self.terms, self.known = terms, known
        self.child: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.edits = [0]
        for i, t in enumerate(terms):
            node = 0
            self.edits[0] = max(self.edits[0], t.edits)
            for ch in t.text:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    for column, value in ((self.child, {}), (self.whole, -1), (self.stem, -1), (self.edits, 0)):
                        column.append(value)
                node = self.child[node][ch]
                self.edits[node] = max(self.edits[node], t.edits)
            (self.stem if t.stem else self.whole)[node] = i
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.begun: list[tuple[int, int] | None] = []
        self.found: dict[str, tuple[int, int] | None] = {}
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state: trie nodes with the fewest edits to reach each, leaving out letters of terms included."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for c in self.child[node].values():
                if e < self.edits[c] and nodes.get(c, 9) > e + 1:
                    nodes[c] = e + 1
                    todo.append((c, e + 1))
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.next.append({})
            self.begun.append(self._best(self.stem, nodes))
        return self.states[key]

    def _best(self, ends: list[int], nodes: dict[int, int]) -> tuple[int, int] | None:
        found = [(e, -self.terms[t].weight, t) for n, e in nodes.items() if (t := ends[n]) >= 0 and e <= self.terms[t].edits]
        return (min(found)[2], min(found)[0]) if found else None

    def _step(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state].items():
            for c, n in self.child[node].items():
                cost = e if c == ch else e + 1
                if cost <= self.edits[n] and out.get(n, 9) > cost:
                    out[n] = cost
            if e < self.edits[node] and out.get(node, 9) > e + 1:
                out[node] = e + 1
        self.next[state][ch] = n = self._state(out) if out else -1
        return n

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term of the lexicon within its distance of ``word``, the heaviest of equals."""
        if word in self.found:
            return self.found[word]
        if len(self.sets) > STATES or len(self.found) > WORDS:
            self._reset()
        state, best = 0, None
        for ch in word:
            state = self.next[state].get(ch, -2) if self.next[state].get(ch, -2) != -2 else self._step(state, ch)
            if state < 0:
                break
            if self.begun[state] and (best is None or self.begun[state][1] < best[1]):
                best = self.begun[state]
        if state >= 0 and (end := self._best(self.whole, self.sets[state])) and (best is None or end[1] <= best[1]):
            best = end
        if best and best[1] and word in self.known:
            best = None
        self.found[word] = best
        return best


def chunks(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of about CHUNK characters that cut no word."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        if end < len(text) and (m := TOKEN.match(text, end)):
            end = m.end()
        yield at, end
        at = end


def words_of(text: str) -> set[str]:
    out: set[str] = set()
    for a, b in chunks(text):
        out.update(TOKEN.findall(text, a, b))
    return out


def _inside_quotes(before: str, after: str) -> bool:
    for a, b in QUOTES:
        if a == b:
            if before.count(a) % 2 and b in after:
                return True
        elif before.rfind(a) > before.rfind(b) and 0 <= after.find(b) and (after.find(a) < 0 or after.find(b) < after.find(a)):
            return True
    return False


def context_weight(before: str, after: str) -> float:
    """What the texts on both sides of a term make of its weight."""
    left, right = TOKEN.findall(before), TOKEN.findall(after)
    weight = QUOTED if _inside_quotes(before, after) else REPORTED if REPORT & set(left[-3:]) else 1.0
    return weight * ADDRESSED if weight == 1.0 and ADDRESS & set(left + right) else weight


def find_terms(text: str, lexicon: Lexicon) -> list[tuple[int, int, int, int, float]]:
    """(start, end, term, edits, weight) of every term in the lower-cased ``text``, by start."""
    hits = {w: h for w in words_of(text) if (h := lexicon.find(w))}
    out = []
    if hits:
        # A context holds WINDOW words on each side, and no more than so many characters of them.
        reach = 12 * WINDOW
        for a, b in chunks(text):
            for m in TOKEN.finditer(text, a, b):
                if h := hits.get(m[0]):
                    before, after = text[max(0, m.start() - reach):m.start()], text[m.end():m.end() + reach]
                    out.append((m.start(), m.end(), *h, lexicon.terms[h[0]].weight * EDIT_WEIGHT[h[1]] * context_weight(before, after)))
    return out


def evidence(text: str, lexicon: Lexicon) -> tuple[float, float, int, str | None]:
    """(heaviest term, sum over different terms, found terms, heaviest term's text) of a text."""
    best: dict[int, float] = {}
    n = 0
    for _, _, t, _, w in find_terms(text.lower(), lexicon):
        best[t] = max(w, best.get(t, 0.0))
        n += 1
    top = max(best, key=lambda t: (best[t], -t)) if best else None
    return (max(best.values(), default=0.0), math.fsum(sorted(best.values())), n, None if top is None else lexicon.terms[top].text)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients (constant first) of a logistic curve by Newton steps; the ridge spares the constant."""
    x = np.hstack((np.ones((len(x), 1)), x))
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta = beta + step * min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-9))
    return beta


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    known: frozenset[str] = frozenset()
    beta: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.known)

    def score(self, top: float, total: float) -> float:
        z = float(self.beta @ np.array([1.0, min(top, 1.0), math.log1p(total)]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def candidates(text: str) -> set[str]:
    """Words of letters of a text and their beginnings; a beginning ends in ``*``."""
    out = set()
    for w in words_of(text.lower()):
        if len(w) >= MIN_LETTERS and w.isalpha():
            out.add(w)
            out.update(w[:k] + "*" for k in range(MIN_LETTERS, min(len(w), MAX_STEM + 1)))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n1, n0): texts of each label that hold a term; input is (label, text)."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        terms = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([held[1][t] for t in terms], pa.int64()), pa.array([held[0][t] for t in terms], pa.int64())], names=["term", "n1", "n0"])

    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held[label].update(candidates(text))
            if len(held[0]) + len(held[1]) > WORDS:
                yield flush()
                held[0].clear(), held[1].clear()
    yield flush()


def _settings(terms: set[str]):
    """(term, before, after): the words beside each of ``terms`` in toxic texts; copies of a text show a term beside the same words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple[str, str, str]] = set()
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = text.lower() if label else ""
                words = [w for a, z in chunks(low) for w in TOKEN.findall(low, a, z)]
                for i, w in enumerate(words):
                    for t in (w, *(w[:k] + "*" for k in range(MIN_LETTERS, min(len(w), MAX_STEM + 1)))):
                        if t in terms:
                            out.add((t, words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
            rows = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["term", "before", "after"])
    return run


def _misspelt(model: Model):
    """(term, n1, n0): texts of each label that hold a word at some distance from the lexicon."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for b in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[label].update(w for w in words_of(text.lower()) if (h := lexicon.find(w)) and h[1])
            words = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[1][w] for w in words], pa.int64()), pa.array([n[0][w] for w in words], pa.int64())], names=["term", "n1", "n0"])
    return run


def _weigh(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for b in batches:
            found = [evidence(t, lexicon)[:2] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([f[i] for f in found], pa.float64()) for i in range(2))], names=["label", "top", "total"])
    return run


def narrowed(found: list) -> list:
    """``found`` (term, n1, n0) less the stems that a longer term explains nearly alone, and less the terms that a stem left over holds as surely."""
    by = {r.term: r for r in found}
    most: dict[str, int] = {}
    for t, r in by.items():
        word = t.rstrip("*")
        for k in range(MIN_LETTERS, min(len(word), MAX_STEM + 1)):
            most[word[:k] + "*"] = max(most.get(word[:k] + "*", 0), r.n1)
    kept = {t: r for t, r in by.items() if not t.endswith("*") or most.get(t, 0) < EXPLAINED * r.n1}
    above = lambda word: (kept[s] for k in range(MIN_LETTERS, min(len(word), MAX_STEM + 1)) if (s := word[:k] + "*") in kept)
    return [r for t, r in kept.items() if not any(a.n0 <= r.n0 for a in above(t.rstrip("*")))]


def learn(docs: DataFrame, labels: DataFrame, sample_docs: tuple[int, int] = SAMPLE_DOCS, max_terms: int = MAX_TERMS) -> Model:
    """The model of a hash sample of ``labels`` (doc_id, label 0/1) of the expected sizes ``sample_docs``, with their texts in ``docs``.

    An id teaches one text, equal texts teach once. What reaches the driver is bounded by the
    sample's and the lexicon's size.
    """
    slots = 1 << 30
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    rate = [min(slots, int(slots * sample_docs[k] / max(sizes.get(k, 0), 1))) for k in (0, 1)]
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(slots)) < F.when(F.col("label") == 1, rate[1]).otherwise(rate[0]))
    # The chosen ids are as few as the sample, so the texts need not move before they are chosen.
    picked = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).where("text <> ''")
    sample = written(picked.groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("label").cast("int").alias("label"), F.min("text").alias("text")).select("label", "text"), "toxicity-sample")
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n1 or not n0:
        return Model(beta=np.array([30.0 if n1 else -30.0 if n0 else 0.0, 0.0, 0.0]))
    # One clean text of the sample stands for so many, in proportion to a toxic one.
    clean = (sizes[0] / n0) / (sizes[1] / n1)

    x, y, base = F.col("n1").cast("double"), F.col("n0").cast("double"), n1 / (n0 + n1)
    part = lambda a, rate: F.when(a > 0, a * F.log(a / (x + y) / rate)).otherwise(0.0)
    share = (x + 0.1) / (x + 0.1 + clean * y)
    excess = part(x, base) + part(y, 1 - base)
    counts = written(sample.mapInArrow(_count, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= MIN_DOCS), "toxicity-terms")
    need = math.log(max(counts.count(), 1)) + MARGIN
    fit = lambda df: df.where((F.col("n1") >= MIN_DOCS) & (share >= LEAST_SHARE) & (x / (x + y) > base) & (excess >= need))
    first = fit(counts).orderBy(F.desc(excess), "term").limit(8 * max_terms).collect()
    shown = sample.mapInArrow(_settings({r.term for r in first}), "term string, before string, after string").groupBy("term") \
        .agg(F.least(F.countDistinct("before"), F.countDistinct("after")).alias("shown"))
    sure = fit(counts.join(shown, "term").withColumn("n1", F.least("n1", "shown"))).orderBy(F.desc(excess), "term").limit(max_terms).collect()
    ratio = lambda r: math.log((r.n1 + 0.5) / (n1 + 1)) - math.log((r.n0 + 0.5) / (n0 + 1))
    sure = narrowed(sure)
    heaviest = max((ratio(r) for r in sure), default=1.0)
    terms = [Term(r.term.rstrip("*"), r.term.endswith("*"), ratio(r) / heaviest) for r in sorted(sure, key=lambda r: r.term)]
    model = Model(terms)
    near = sample.mapInArrow(_misspelt(model), "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # Words of clean texts are words of their own; the sample bounds their number.
    model.known = frozenset(r.term for r in near.where((F.col("n0") > 0) & (share < 0.9)).select("term").collect())
    seen = np.array(sample.mapInArrow(_weigh(model), "label long, top double, total double").select("label", "top", "total").collect(), float).reshape(-1, 3)
    seen = seen[np.lexsort(seen.T)]
    model.beta = logistic(np.column_stack((np.minimum(seen[:, 1], 1.0), np.log1p(seen[:, 2]))), seen[:, 0], np.where(seen[:, 0] == 1, 1.0, clean))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_terms, top_term of every row of ``docs`` (doc_id, text), its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lexicon = model.lexicon()
        for b in batches:
            found = [evidence(t or "", lexicon) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(f[0], f[1]) for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()),
                                              pa.array([f[3] for f in found], pa.string())], names=["doc_id", "score", "n_terms", "top_term"])

    return docs.mapInArrow(run, "doc_id long, score double, n_terms long, top_term string")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_terms, top_term.

    Labels are learned only from rows that are not held out (crc32 of the id mod 5 is not 0);
    null labels and ids, labels other than 0 and 1, and labels whose document is missing or
    empty teach nothing; an id with both labels counts as toxic. A text without a term, an
    empty or null one included, has the score of such texts: 0.5 where nothing was learned,
    about 0 or 1 where all labels are alike. Repeated rows get equal scores; an empty table
    gives no rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("label")).where("doc_id is not null and label in (0, 1)")
    model = learn(own, known.where(~held_out()))
    return score(own, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms", "top_term")
