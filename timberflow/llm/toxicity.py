"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read a clause as a string of word classes, each rewriting what it knows and passing on the rest:

1. negation weakens an insult or threat within the next words,
2. reported speech weakens what stands behind a verb of saying in the clause,
3. target strengthens an insult that stands near a person addressed or spoken of,
4. threat keeps a threat only where a target follows closely,
5. insult turns what is left into matches.

They are composed into one deterministic table.  A clause's score is the weight of its matches, where an insult's weight is
that of its word; a document's value is the sum over its matched clauses, mapped to 0..1 by a fitted logistic curve.

The words of negation, reported speech, targets and threats are fixed lists; the insults are learned from labelled
documents as whole words and word beginnings whose presence tells the labels apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberflow.llm.common import calibrate, labelled_sample, materialize, sigmoid

#: Labelled documents that are read to learn the insults and the curve.
SAMPLE_ROWS = 20_000
#: Words and word beginnings kept of those learned.
LEXICON_ROWS = 4_096

# Function words of English, German, French and Spanish.
NEGATIONS = set("not no never nobody without isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans no nunca jamás ningún ninguna sin".split())
REPORTS = set("said says say wrote writes claimed claims called quote quoted quoting sagte sagt schrieb behauptet zitiert dit disait écrit affirme cita dijo dice escribió afirma citó".split())
TARGETS = set("you your you're u they them their he she his her him these those people du dich dir dein deine ihr euch sie er ihm tu te toi ton ta tes vous votre vos ils elles tú ti usted ustedes vosotros ellos ellas él ella vuestro".split())
THREATS = set("kill murder hurt destroy shoot stab strangle burn hang töten umbringen erschießen verletzen verprügeln tuer massacrer égorger frapper matar golpear destruir apuñalar disparar".split())
INSULTS = set("idiot idiots moron morons imbecile scumbag bastard bastards asshole dumbass arschloch dummkopf trottel abschaum idioten connard salaud crétin imbécile gilipollas imbécil cabrón estúpido".split())

TOKEN = re.compile(r"[.!?;:\n]+|\w+(?:['’]\w+)*")
PREFIXES = (4, 5, 6)
WORDS = re.compile(r"\w+")

Symbol = tuple[str, int]  # class and strength step
State = tuple[int, ...]


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step(state, symbol)`` gives the next state and the symbol passed on."""

    states: int
    step: Callable[[int, Symbol], tuple[int, Symbol]]


def _near(trigger: str, reach: int, change: int, kinds: tuple[str, ...]) -> Transducer:
    """Moves the strength of ``kinds`` within ``reach`` words behind ``trigger``; state: words still in reach."""

    def step(state: int, symbol: Symbol) -> tuple[int, Symbol]:
        kind, strength = symbol
        if kind == "end":
            return 0, symbol
        if kind == trigger:
            return reach, symbol
        passed = (kind, strength + change) if state and kind in kinds else symbol
        return max(state - 1, 0), passed

    return Transducer(reach + 1, step)


def _threat(reach: int) -> Transducer:
    """A threat waits for a target within ``reach`` words: state 0 none, else words left; the target becomes the match."""

    def step(state: int, symbol: Symbol) -> tuple[int, Symbol]:
        kind, strength = symbol
        waits = 3 * reach + 1
        if kind == "end":
            return 0, symbol
        if kind == "threat":
            return 3 * reach - 2 + min(max(strength + 2, 0), 2), ("word", 0)
        if state and kind == "target":
            return 0, ("threatened", (state - 1) % 3 - 2)
        return (state - 3 if state > 3 else 0) if state < waits else 0, symbol

    return Transducer(3 * reach + 1, step)


def _addressed(reach: int) -> Transducer:
    """A target shortly behind an insult makes a further, weaker match; state: words still in reach."""

    def step(state: int, symbol: Symbol) -> tuple[int, Symbol]:
        kind, strength = symbol
        if kind == "end":
            return 0, symbol
        if kind == "insult":
            return reach, symbol
        if kind == "target" and state:
            return 0, ("addressed", 0)
        return max(state - 1, 0), symbol

    return Transducer(reach + 1, step)


def compose(parts: list[Transducer], inputs: list[Symbol]) -> tuple[dict[State, int], list[dict[str, tuple[int, Symbol]]]]:
    """One table for the parts in sequence, built from the states that can be reached from the start."""
    start: State = (0,) * len(parts)
    numbers, rows, todo = {start: 0}, [], [start]
    while todo:
        state, row = todo.pop(0), {}
        for symbol in inputs:
            name, onward = symbol[0], []
            for part, inner in zip(parts, state, strict=True):
                after, symbol = part.step(inner, symbol)
                onward.append(after)
            goal = tuple(onward)
            if goal not in numbers:
                numbers[goal] = len(numbers)
                todo.append(goal)
            row[name] = (numbers[goal], symbol)
        rows.append(row)
    return numbers, rows


CLASSES: list[Symbol] = [(k, 0) for k in ("word", "insult", "threat", "target", "negation", "report", "end")]
#: Factor of a match for each strength step: two weakenings, one, none, strengthened.
STRENGTH = {-2: 0.2, -1: 0.45, 0: 1.0, 1: 1.5}
#: Weight of the matches that are not an insult's own.
MATCHES = {"threatened": 1.0, "addressed": 0.3}

GRAMMAR = compose(
    [
        _near("negation", 6, -1, ("insult", "threat")),
        _near("report", 12, -1, ("insult", "threat")),
        _near("target", 4, +1, ("insult",)),
        _threat(3),
        _addressed(3),
    ],
    CLASSES,
)[1]


@dataclass
class ToxicityModel:
    """Weights of insults by word and by beginning, and the curve from a document's value to its score."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    intercept: float = -4.0
    slope: float = 4.0

    def __post_init__(self) -> None:
        for word in INSULTS:
            self.words.setdefault(word, 0.8)
        marks = [*self.words, *self.beginnings, *THREATS]
        self.heads = {WORDS.match(m)[0][: PREFIXES[0]] for m in marks}

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for size in PREFIXES:
            if len(word) >= size:
                best = max(best, self.beginnings.get(word[:size], 0.0))
        return best

    def _class(self, token: str) -> tuple[str, float]:
        if not (token[0].isalnum() or token[0] == "_"):
            return "end", 0.0
        if weight := self.weight(token):
            return "insult", weight
        for name, words in (("threat", THREATS), ("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS)):
            if token in words:
                return name, 1.0
        return "word", 0.0

    def clauses(self, text: str | None) -> Iterator[tuple[float, str]]:
        """(weight, clause) of each clause with a match."""
        tokens, state, total, matched = [], 0, 0.0, False
        for token in [*TOKEN.findall((text or "").lower().replace("’", "'")), "."]:
            name, weight = self._class(token)
            state, (kind, strength) = GRAMMAR[state][name]
            if kind == "insult":
                total, matched = total + weight * STRENGTH[max(-2, min(1, strength))], True
            elif kind in MATCHES:
                total, matched = total + MATCHES[kind] * STRENGTH[strength], True
            if name != "end":
                tokens.append(token)
            else:
                if matched:
                    yield total, " ".join(tokens)
                tokens, total, matched = [], 0.0, False

    def may_match(self, text: str) -> bool:
        """False only where no word begins like an insult or threat, which spares most texts the walk.

        Words are cut wherever the grammar's tokens begin, and at apostrophes besides, so no token is overlooked.
        """
        return not self.heads.isdisjoint(map(itemgetter(slice(0, PREFIXES[0])), WORDS.findall(text)))

    def value(self, text: str | None) -> float:
        if not text or not self.may_match(text.lower()):
            return 0.0
        return sum(weight for weight, _ in self.clauses(text))

    def score(self, values: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + self.slope * np.log1p(values))


def _presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(mark, toxic, clean): documents of the batch that hold a word ("=word") or a beginning ("+begin"); "" counts all."""
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words = {w for w in TOKEN.findall(text.lower()) if w[0].isalnum()}
            marks = {"=" + w for w in words}
            marks |= {"+" + w[:size] for w in words for size in PREFIXES if len(w) >= size}
            counts[int(label)].update(marks | {""})
        marks = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"mark": marks, "toxic": [counts[1][m] for m in marks], "clean": [counts[0][m] for m in marks]})


def fit(
    documents: DataFrame,
    labels: DataFrame,
    parts: int = 5,
    part: int = 0,
    rows: int = SAMPLE_ROWS,
    lexicon: int = LEXICON_ROWS,
) -> ToxicityModel:
    """Learn from at most ``rows`` labelled documents (doc_id, toxic) whose crc32(doc_id) mod ``parts`` is not ``part``.

    A mark is kept where the likelihood ratio of its presence beats chance over all marks tested and the lower bound
    of its log odds is above 1; at most ``lexicon`` marks reach the driver, the heaviest.  Without labelled rows the model holds the
    fixed insults only.
    """
    sample = materialize(labelled_sample(documents, labels, "toxic", parts, part, rows))
    counts = materialize(
        sample.mapInPandas(_presence, "mark string, toxic long, clean long")
        .groupBy("mark")
        .agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    )
    whole = counts.filter("mark = ''").first()
    if whole is None or not whole["a"] or not whole["b"]:
        return ToxicityModel()
    n1, n0 = float(whole["a"]), float(whole["b"])
    a, b = F.col("a") + F.lit(0.5), F.col("b") + F.lit(0.5)
    odds = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1))
    bound = odds - 1.64 * F.sqrt(1 / a + 1 / b)
    share = (F.col("a") + F.col("b")) / (n1 + n0)

    def part_of(count: Column, size: float, share: Column) -> Column:
        return F.when((count > 0) & (share > 0), count * F.log(count / (size * share))).otherwise(F.lit(0.0))

    present = part_of(F.col("a"), n1, share) + part_of(F.col("b"), n0, share)
    absent = part_of(F.lit(n1) - F.col("a"), n1, 1 - share) + part_of(F.lit(n0) - F.col("b"), n0, 1 - share)
    ratio = 2 * (present + absent)
    tested = max(counts.count(), 2)
    kept = (
        counts.filter("mark != ''")
        .withColumn("bound", bound)
        .filter((F.col("bound") > 1.0) & (ratio > 2 * float(np.log(tested))))
        .orderBy(F.desc("bound"), "mark")
        .limit(lexicon)
        .select("mark", "bound")
        .collect()
    )
    top = max((r["bound"] for r in kept), default=1.0)
    model = ToxicityModel(
        words={r["mark"][1:]: r["bound"] / top for r in kept if r["mark"][0] == "="},
        beginnings={r["mark"][1:]: r["bound"] / top for r in kept if r["mark"][0] == "+"},
    )
    values = sample.select("label", _valued(model)(F.col("text")).alias("value")).toPandas()
    model.intercept, model.slope = calibrate(np.log1p(values["value"].to_numpy(float)), values["label"].to_numpy(float))
    return model


def _valued(model: ToxicityModel) -> Callable[[Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def value(texts: pd.Series) -> pd.Series:
        return pd.Series([model.value(t) for t in texts], dtype="float64")

    return value


def scorer(model: ToxicityModel) -> Callable[[Column], Column]:
    """Column function: text to score in 0..1.  Null and empty texts have no clause and score as a text without a match."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([model.value(t) for t in texts], float)), dtype="float64")

    return score


def matched_clauses(model: ToxicityModel) -> Callable[[Column], Column]:
    """Column function: text to its matched clauses with their weights, in the order of the text."""

    @F.pandas_udf("array<struct<weight: double, clause: string>>")
    def clauses(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"weight": w, "clause": c} for w, c in model.clauses(t)] for t in texts], dtype=object)

    return clauses
