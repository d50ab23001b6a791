"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm._common import ALNUM, columns_free_of, mix, shingle_hashes, steps, word_hashes, word_spans
from tallyspark.llm._labels import fit_logistic, held_out, sigmoid, teaching_sample

#: Labelled rows that teach the weights of terms and the scale of scores, at most.
TEACHING = 20_000
#: Bytes of a word's beginning that can be a term, besides whole words.
STEMS = (4, 5, 6, 7)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
_CLAUSE_ENDS = frozenset(b".!?;:\n")

#: Fixed words of each part of the grammar in English, German, French and Spanish.
WORDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown imbecile bastard vermin dumb fool idiotin trottel dummkopf abschaum versager widerlich wertlos idiote imbécile débile ordure minable connard idiota imbécil estúpido escoria basura patético inútil asqueroso",
    THREAT: "kill hurt destroy murder beat burn shoot stab hang hunt töten umbringen vernichten schlagen verbrennen tuer détruire frapper brûler matar destruir golpear quemar",
    TARGET: "you your yours yourself u he she him her they them their these those this du dich dir dein ihr euch sie er tu te toi ton vous votre il elle ils tú te ti tu usted ustedes él ella ellos",
    NEGATION: "not no never neither nor isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals pas jamais aucun ni nunca jamás ningún",
    REPORT: "said says say wrote writes called calls quoted quote quotes claims claimed according reported sagte sagt schrieb nannte laut zitiert dit disait écrit selon appelé cite dijo dice escribió llamó según cita",
}
#: Weight of a fixed insult or threat of which labels say nothing.
PRIOR = 2.0
#: Words after a negation that it still reaches.
REACH = 3


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, output symbol, weight); state 0 is where a clause begins."""

    arcs: tuple[tuple[tuple[int, int, float], ...], ...]

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: the other reads what this one writes; weights multiply. Only reachable pairs of states are made."""
        numbers, todo, rows = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = []
            for to_a, out, weight in self.arcs[a]:
                to_b, last, more = other.arcs[b][out]
                if (to_a, to_b) not in numbers:
                    numbers[to_a, to_b] = len(todo)
                    todo.append((to_a, to_b))
                row.append((numbers[to_a, to_b], last, weight * more))
            rows.append(tuple(row))
        return Transducer(tuple(rows))

    def run(self, symbols: list[int], weights: list[float]) -> float:
        """The summed weight of the insults and threats that a clause's symbols spell."""
        state, total = 0, 0.0
        for symbol, weight in zip(symbols, weights, strict=True):
            state, out, factor = self.arcs[state][symbol]
            if out in (INSULT, THREAT):
                total += weight * factor
        return total


def _machine(states: int, move) -> Transducer:
    return Transducer(tuple(tuple(move(s, x) for x in range(BREAK + 1)) for s in range(states)))


def grammar() -> Transducer:
    """Insult, threat, target, negation and reported-speech transducers, composed."""
    # A second insult of a clause adds less than the first.
    insult = _machine(2, lambda s, x: (1, x, 0.8 if s else 1.0) if x == INSULT else (s, x, 1.0))
    # A threat counts in full with someone named before it; else little, and the rest once someone is named after it.
    moves = {(0, TARGET): (1, TARGET, 1.0), (0, THREAT): (2, THREAT, 0.3), (1, THREAT): (1, THREAT, 1.0), (2, TARGET): (1, THREAT, 0.7), (2, THREAT): (2, THREAT, 0.3)}
    threat = _machine(3, lambda s, x: moves.get((s, x), (s, x, 1.0)))
    # An insult after a target is aimed.
    target = _machine(2, lambda s, x: (1, x, 1.0) if x == TARGET else (s, x, 1.2 if s else 1.0) if x == INSULT else (s, x, 1.0))
    # A negation reaches the next few words.
    negation = _machine(REACH + 1, lambda s, x: (REACH, x, 1.0) if x == NEGATION else (max(s - 1, 0), x, 0.35 if s and x in (INSULT, THREAT) else 1.0))
    # What a clause reports is someone else's.
    report = _machine(2, lambda s, x: (1, x, 1.0) if x == REPORT else (s, x, 0.5 if s and x in (INSULT, THREAT) else 1.0))
    return insult @ threat @ target @ negation @ report


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("\n".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _WORD)
    return word_hashes(data, starts, ends)


_WORD = ALNUM.copy()
_WORD[ord("'")] = True


@dataclass
class Lexicon:
    """Weights of words and stems by hash, sorted; what counts as insult or threat, and the fixed parts of speech."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        kinds: dict[int, int] = {}
        for kind in (TARGET, NEGATION, REPORT, THREAT, INSULT):
            kinds |= dict.fromkeys(_hash_words(WORDS[kind].split()).tolist(), kind)
        known = dict(zip(self.hashes.tolist(), self.weights.tolist(), strict=True))
        rows = {h: (k, known.get(h, PRIOR)) for h, k in kinds.items() if k in (INSULT, THREAT)} | {h: (k, PRIOR if k == TARGET else 0.0) for h, k in kinds.items() if k not in (INSULT, THREAT)}
        rows |= {h: (kinds.get(h) if kinds.get(h) == THREAT else INSULT, w) for h, w in known.items() if kinds.get(h) not in (TARGET, NEGATION, REPORT) and w > 0}
        rows = {h: (k, w) for h, (k, w) in rows.items() if k not in (INSULT, THREAT) or w > 0}
        order = sorted(rows)
        self.keys = np.array(order, np.uint64)
        self.kinds = np.array([rows[h][0] for h in order], np.int64)
        self.values = np.array([rows[h][1] for h in order], float)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return np.where(hit, self.kinds[at], OTHER), np.where(hit, self.values[at], 0.0)


def terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of each word, then of its beginnings of 4 to 7 bytes (0 where the word is no longer than that)."""
    yield word_hashes(data, starts, ends)
    for n in STEMS:
        longer = ends - starts > n
        yield np.where(longer, mix(word_hashes(data, starts, np.where(longer, starts + n, starts)) + np.uint64(n)), 0)


def clause_scores(texts: pa.Array, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    """For each whole text: largest and summed clause score, matched clauses, their share of all words, and whether any matched."""
    out = np.zeros((len(texts), 5))
    for lo, hi, data, offsets in steps(texts):
        starts, ends, first = word_spans(data, offsets, _WORD)
        kinds, values = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        for hashes in terms(data, starts, ends):
            kind, value = lexicon.look_up(hashes)
            fresh = (kind != OTHER) & ((kinds == OTHER) | (value > values))
            kinds, values = np.where(fresh, kind, kinds), np.where(fresh, value, values)
        breaks = np.isin(data, list(_CLAUSE_ENDS))
        clause = np.cumsum(breaks)[starts] if len(starts) else starts
        matched = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
        rows = np.searchsorted(first, matched, "right") - 1
        done = -1
        for word, row in zip(matched.tolist(), rows.tolist(), strict=True):
            if word < done:
                continue
            a, b = max(int(np.searchsorted(clause, clause[word])), int(first[row])), min(int(np.searchsorted(clause, clause[word], "right")), int(first[row + 1]))
            done = b
            score = machine.run(kinds[a:b].tolist(), values[a:b].tolist())
            mine = out[lo + row]
            mine += (max(score - mine[0], 0), score, 1, 0, 0)
        n_words = np.maximum(np.diff(first), 1)
        out[lo:hi, 3] = out[lo:hi, 1] / n_words
    out[:, 4] = out[:, 0] > 0
    out[:, 1:3] = np.log1p(out[:, 1:3])
    return out


@dataclass
class Model:
    lexicon: Lexicon = field(default_factory=Lexicon)
    #: Weights of the five clause scores and the intercept.
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0, 2.0, -3.0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, marks = [], []
        for lo, hi, data, offsets in steps(batch["text"]):
            starts, ends, first = word_spans(data, offsets, _WORD)
            all_terms = np.stack(list(terms(data, starts, ends)))
            for i in range(hi - lo):
                mine = np.unique(all_terms[:, first[i] : first[i + 1]])
                lists.append(mine[mine != 0].view(np.int64))
                words = all_terms[0, first[i] : first[i + 1]]
                marks.append(int(shingle_hashes(words, 3).min()) if len(words) else 0)
        yield pa.RecordBatch.from_arrays([batch["label"], batch["text"], pa.array(lists, pa.list_(pa.int64())), pa.array(np.array(marks, np.uint64).view(np.int64), pa.int64())], ["label", "text", "terms", "mark"])


def learn_toxicity(docs: DataFrame, labels: DataFrame, teaching: int = TEACHING) -> Model:
    """Term weights and score scale from a bounded sample of labelled rows.

    A term's weight is its smoothed log odds; it is kept if so many toxic rows
    among those that hold it have a binomial probability under 0.01 over the
    number of terms. Rows with one mark (near copies, by the least hash of
    their word trigrams) count once per term and class. Terms are counted on the
    executors; only the kept ones and the sample's clause scores reach the
    driver. Without both classes the fixed words and weights stand.
    """
    sample = teaching_sample(docs, labels, "toxic", teaching)
    seen = sample.mapInArrow(_sample_terms, "label int, text string, terms array<long>, mark long").persist()
    try:
        toxic_terms = seen.where("label = 1").select(F.explode("terms").alias("term"), "mark").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("bad"))
        clean_terms = seen.where("label = 0").select(F.explode("terms").alias("term"), "mark").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("good"))
        groups = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.countDistinct("mark").alias("n")).collect()}
        if len(groups) < 2:
            return Model()
        base = (groups[1] + 1) / (groups[0] + groups[1] + 2)
        both = toxic_terms.join(clean_terms, "term", "left").select("term", F.col("bad").cast("double"), F.coalesce("good", F.lit(0)).cast("double").alias("good"))
        number = toxic_terms.count()
        share, held = F.col("bad") / (F.col("bad") + F.col("good")), F.col("bad") + F.col("good")
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
        # Chernoff's bound of the upper binomial tail.
        sure = (share > 0.5) & (-held * (share * F.log(share / base) + rest) < math.log(0.01 / max(number, 1)))
        odds = F.log((F.col("bad") + 0.1) / (F.col("good") + 0.1)) - math.log(base / (1 - base))
        kept = both.where(sure).select("term", odds.alias("odds")).toArrow()
        lexicon = Lexicon(kept["term"].to_numpy().view(np.uint64), np.clip(kept["odds"].to_numpy(), 0, 8))
        machine = grammar()

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["label"], pa.array(list(clause_scores(batch["text"], lexicon, machine)), pa.list_(pa.float64()))], ["label", "features"])

        rows = seen.select("label", "text").mapInArrow(features, "label int, features array<double>").toArrow()
    finally:
        seen.unpersist()
    x, y = np.array(rows["features"].to_pylist(), float), rows["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    return Model(lexicon, fit_logistic(np.concatenate([x, np.ones((len(x), 1))], 1), y, 0.5))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (int, 1 from threshold up) to every row, by its whole text alone.

    A text is cut into clauses at . ! ? ; : and line ends; each clause's words
    become symbols (weighted insults and threats, targets, negations, verbs of
    reporting) which the composed transducer scores. Null and empty texts get
    the score of no match. Rows are neither shuffled nor dropped; columns named
    score or predicted stay, the new ones then end in underscores.
    """
    score, predicted = columns_free_of(docs, "score", "predicted")
    schema = docs.withColumns({score: F.lit(0.0)}).schema
    machine = grammar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(model.score(clause_scores(batch["text"], model.lexicon, machine)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, score])

    return docs.mapInArrow(run, schema).withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """score_toxicity by what labels teach, with held_out."""
    (held,) = columns_free_of(docs, "held_out")
    return score_toxicity(docs, learn_toxicity(docs, labels), threshold).withColumn(held, held_out())
