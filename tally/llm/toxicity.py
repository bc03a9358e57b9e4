"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause (a stretch without sentence or
clause marks) and are composed into one automaton:

* insult: a lexicon of words and word beginnings with weights, learned from
  labelled texts (log-odds of the share of toxic texts that hold the term);
* threat: verbs of harm, which count only when a target is in the clause;
* target: words for a person addressed or spoken of, which raise what they
  stand with;
* negation: lowers what follows within ``NEGATION_REACH`` words;
* reported speech: lowers the rest of its clause.

A matched clause scores the sum of its weights after these changes; words
outside a matched pattern score nothing.  A text's score is the logistic of
its summed and largest clause score and the sum per 100 words, fitted on the
labelled sample.

Only labelled rows that are not held out are learned from, at most
``SAMPLE_ROWS`` of them (the smallest by hash of the id): a documented bound on
fitting.  Scoring reads every whole text.  The grammar (at most ``TERMS``
learned terms and four weights) is all that reaches driver and workers.

Defined results: null and empty texts match no clause and get the score of
such texts; texts with equal words score equally whatever their id, language
or source; a label table without rows of one class leaves the built-in terms
and weights; repeated label rows of one id count as toxic if one is; of
documents that share an id the smallest text is learned from, and all are
scored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.shared import documents, fresh, stored

SAMPLE_ROWS = 16_000
TERMS = 5_000
STEMS = range(4, 9)
LEAST_EVIDENCE, LEAST_ODDS = 25.0, 2.5
THRESHOLD = 0.7
HELD_OUT = 1
NEGATION_REACH = 3
NEGATED, REPORTED, AIMED, THREAT = 0.3, 0.4, 1.25, 2.0
CACHE_ENTRIES = 300_000
#: Weights (intercept, summed, largest clause, sum per 100 words) where nothing can be learned.
UNFITTED = (-3.0, 1.0, 1.0, 0.0)

# Small closed word classes of the four languages.
INSULTS = ("idiot moron stupid scum imbecile dumbass loser worthless pathetic disgusting dummkopf abschaum "
           "crétin ordure imbécil basura").split()
THREATS = "kill hurt destroy murder beat punish töten umbringen tuer frapper matar golpear".split()
TARGETS = ("you your yours u he she they them him her people du dich ihr euch sie tu toi vous ils elle usted "
           "ustedes él ellos").split()
NEGATIONS = "not no never nobody isn't aren't don't nicht kein keine nie pas jamais aucun no nunca jamás".split()
REPORTS = ("said says say wrote writes quoted quote called reported allegedly sagte sagt schrieb dit écrit "
           "déclaré dijo dice escribió").split()

_TOKENS = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]")
_NONE, _BREAK, _INSULT, _THREAT, _TARGET, _NEGATION, _REPORT = range(7)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def terms_of(word: str) -> list[str]:
    """The word and its beginnings (marked by ``*``), longest first."""
    return [word, *(word[:n] + "*" for n in reversed(STEMS) if len(word) > n)]


class Grammar:
    """The composed automaton."""

    def __init__(self, lexicon: dict[str, float], fitted: tuple[float, ...] = UNFITTED) -> None:
        self.lexicon, self.fitted = lexicon, fitted
        self.closed = {w: (_INSULT, 2.0) for w in INSULTS} | {w: (_THREAT, THREAT) for w in THREATS}
        self.closed |= {w: (_TARGET, 0.0) for w in TARGETS} | {w: (_NEGATION, 0.0) for w in NEGATIONS}
        self.closed |= {w: (_REPORT, 0.0) for w in REPORTS}
        self.seen: dict[str, tuple[int, float]] = {}

    def classify(self, token: str) -> tuple[int, float]:
        """Class and weight of a token: the strongest learned term, else a closed class."""
        if not token[0].isalnum():
            return _BREAK, 0.0
        weight = max((self.lexicon[t] for t in terms_of(token) if t in self.lexicon), default=0.0)
        return (_INSULT, weight) if weight > 0 else self.closed.get(token, (_NONE, 0.0))

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the matched clauses."""
        tokens = _TOKENS.findall(text.lower()) if text else []
        seen = self.seen
        if len(seen) >= CACHE_ENTRIES:
            seen.clear()
        for token in set(tokens):
            if token not in seen:
                seen[token] = self.classify(token)
        marks = list(map(seen.__getitem__, tokens))
        if not any(c in (_INSULT, _THREAT) for c, _ in set(marks)):
            return []
        found: list[float] = []
        insult = threat = 0.0
        aimed, reported, negation = False, False, 0
        for kind, weight in [*marks, (_BREAK, 0.0)]:
            if kind == _NONE:
                negation = max(0, negation - 1)
                continue
            if kind == _BREAK:
                score = (insult + (threat if aimed else 0.0)) * (AIMED if aimed else 1.0)
                if score > 0:
                    found.append(score)
                insult = threat = 0.0
                aimed, reported, negation = False, False, 0
                continue
            if kind == _TARGET:
                aimed = True
            elif kind == _NEGATION:
                negation = NEGATION_REACH + 1
            elif kind == _REPORT:
                reported = True
            else:
                weight *= (NEGATED if negation else 1.0) * (REPORTED if reported else 1.0)
                insult, threat = (insult + weight, threat) if kind == _INSULT else (insult, threat + weight)
            negation = max(0, negation - 1)
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        found = self.clauses(text)
        total = sum(found)
        words = len(_TOKENS.findall(text)) if found else 1
        return math.log1p(total), max(found, default=0.0), math.log1p(100 * total / words)

    def score(self, text: str | None) -> float:
        z = self.fitted[0] + sum(w * x for w, x in zip(self.fitted[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each class that hold a term, per batch."""
    for batch in batches:
        counts = Counter(), Counter()
        for text, toxic in zip(batch["text"], batch["toxic"]):
            words = set(_TOKENS.findall(text.lower())) if text else set()
            counts[int(toxic)].update({t for w in words if w[0].isalnum() for t in terms_of(w)})
        terms = list(counts[0] | counts[1])
        yield pd.DataFrame({"term": terms, "toxic": [counts[1][t] for t in terms],
                            "clean": [counts[0][t] for t in terms]})


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Grammar:
    """The grammar fitted on labelled rows of ``docs`` that are not held out."""
    classes = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")))
    chosen = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    sample = stored(  # one text an id, so SAMPLE_ROWS texts at most; read once from ``docs``
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "id")  # SAMPLE_ROWS rows of two numbers
        .groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic"), "toxicity-sample")
    totals = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Grammar({})
    rate = toxic / (toxic + clean)
    a, b = F.col("toxic"), F.col("clean")
    n = a + b
    ratio = lambda part, share: F.when(part > 0, part * F.log(part / (n * share))).otherwise(0.0)
    odds = (F.log((a + 0.5) / F.lit(toxic + 1.0)) - F.log((b + 0.5) / F.lit(clean + 1.0)))
    lexicon = (
        sample.mapInPandas(_term_counts, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("evidence", 2 * (ratio(a, rate) + ratio(b, 1 - rate))).withColumn("odds", odds)
        .where((F.col("odds") >= LEAST_ODDS) & (F.col("evidence") >= LEAST_EVIDENCE))
        .orderBy(F.desc("evidence"), "term").limit(TERMS).select("term", "odds").collect())
    grammar = Grammar({r["term"]: r["odds"] for r in lexicon})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([grammar.features(t) for t in batch["text"]], columns=["f0", "f1", "f2"])
            yield out.assign(toxic=batch["toxic"].to_numpy())

    seen = sample.mapInPandas(measure, "f0 double, f1 double, f2 double, toxic int").toPandas()  # SAMPLE_ROWS at most
    seen = seen.sort_values(list(seen.columns))  # sums in one order, so reruns agree to the last digit
    grammar.fitted = fit(seen[["f0", "f1", "f2"]].to_numpy(), seen["toxic"].to_numpy())
    return grammar


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Logistic weights, intercept first, by Newton steps with a small ridge.
    A slope that comes out negative is left out, as more matches never clear a text."""
    used = list(range(x.shape[1]))
    while True:
        w = _newton(np.c_[np.ones(len(x)), x[:, used]], y, ridge, steps)
        if (w[1:] >= 0).all():
            break
        used.pop(int(np.argmin(w[1:])))
    slopes = np.zeros(x.shape[1])
    slopes[used] = w[1:]
    return float(w[0]), *map(float, slopes)


def score(docs: DataFrame, grammar: Grammar, score_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the toxicity score of each text."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(grammar.score, na_action=None).astype("float64")

    return docs.withColumn(score_col, scores(F.coalesce(F.col(text_col), F.lit(""))))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, same columns."""
    name, = fresh(docs, "score")
    text_col = columns.get("text_col", "text")
    return score(docs, learn(docs, labels, **columns), name, text_col).where(
        F.col(name) < threshold).select(*docs.columns)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs.select("doc_id", "text"), learn(docs, documents(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
