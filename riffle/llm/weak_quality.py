"""Quality classifier from weak labels.

Heuristic labellers vote good or poor or abstain on every document. How reliable each one is follows from where
they agree: expectation-maximisation over the counts of vote patterns of all documents, with a class of good ones
and several kinds of junk. The posterior of each
document's pattern is its label, and a linear scorer over hashed features learns from a bounded
sample of such documents. Its score decides.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm import shared

POOR, GOOD, ABSTAIN = 0, 1, 2
_SYMBOLS = "#$%&*!|"
_WORDS_REMEMBERED, _LONGEST_REMEMBERED = 30_000, 64


class Words:
    """A text's words with the counts that labellers and features share."""

    def __init__(self, text: str):
        self.text, self.words = text, text.split()
        self.n = len(self.words)
        counts = Counter(self.words)
        n = max(1, self.n)
        self.repeats = sum(map(str.__eq__, self.words, self.words[1:])) / n
        # Vocabularies grow slower than texts.
        self.distinct = len(counts) / n**0.8
        self.top = max(counts.values(), default=0) / n


def measures(seen: Words) -> dict[str, float | None]:
    """What the labellers look at; null where a text is too short to tell."""
    dense = sum(map(len, seen.words))
    marks = sum(map(len, _MARKS.findall(seen.text)))
    capitals = sum(map(len, filter(str.isupper, seen.words)))
    return {
        "capitals": capitals / dense,
        "marks": marks / dense if seen.n >= 5 else None,
        "symbols": sum(map(seen.text.count, _SYMBOLS)) / seen.n,
        "decorated": len(_DECORATED.findall(seen.text)) / seen.n,
        "repeats": seen.repeats,
        "run": max(sum(1 for _ in run) for _, run in itertools.groupby(seen.words)),
        "top": seen.top if seen.n >= 20 else None,
        "bare": sum(map(_BARE.__contains__, seen.words)) / seen.n,
        "distinct": 1 - seen.distinct if seen.n >= 60 else None,
    }


_MARKS = re.compile(r"[^\w\s]+")
_DECORATED = re.compile(r"[^\w\s]{2,}(?!\S)")
_BARE = frozenset("|-–—*#=+<>/\\~")
#: Labeller: measure, limit up to which it votes good, limit from which it votes poor; between the two it abstains.
LABELLERS = {
    "shouting": ("capitals", 0.3, 0.6),
    "noise": ("marks", 0.08, 0.15),
    "symbols": ("symbols", 0.05, 0.3),
    "ornaments": ("decorated", 0.05, 0.3),
    "loops": ("repeats", 0.1, 0.4),
    "stuck": ("run", 2, 5),
    "dominant": ("top", 0.2, 0.35),
    "fragments": ("bare", 0.05, 0.2),
    "poor_words": ("distinct", 0.2, 0.75),
}


def votes(seen: Words) -> str:
    """One digit per labeller; all abstain on a text without words."""
    if not seen.n:
        return str(ABSTAIN) * len(LABELLERS)
    found, result = measures(seen), []
    for measure, good, poor in LABELLERS.values():
        value = found[measure]
        result.append(ABSTAIN if value is None else GOOD if value <= good else POOR if value >= poor else ABSTAIN)
    return "".join(map(str, result))


def expectation_maximisation(
    patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, belief: float = 1.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of good per pattern, how often each labeller that votes says poor by class, and the classes' shares.

    ``patterns`` holds a vote per labeller. Abstaining says nothing. There is one class of good documents and one of
    junk per labeller, since faults of different kinds do not agree: a labeller that sees one kind calls all others good. A kind starts
    from the patterns in which its labeller votes poor, the good class from those without any such vote; from then on
    all rates and shares come from the counts. ``belief`` documents of each vote and class keep rates off zero and one. Labellers should
seldom accuse good documents: lone accusations beyond a few in a hundred are taken for a kind of junk.
    """
    poor, good = (patterns == POOR).astype(float), (patterns == GOOD).astype(float)
    accused = poor.sum(axis=1, keepdims=True)
    # A trace of every class in every pattern lets all of them move.
    posterior = np.hstack([accused == 0, poor / np.maximum(1, accused)]) + 1e-3
    posterior /= posterior.sum(axis=1, keepdims=True)
    while True:
        weight = posterior * counts[:, None]
        shares = (weight.sum(axis=0) + belief) / (counts.sum() + belief * weight.shape[1])
        rates = (weight.T @ poor + belief) / (weight.T @ (poor + good) + 2 * belief)
        odds = np.log(shares) + poor @ np.log(rates).T + good @ np.log1p(-rates).T
        new = np.exp(odds - odds.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        rounds -= 1
        if not rounds or np.abs(new - posterior).max() < 1e-9:
            return new[:, 0], rates, shares
        posterior = new


def accuracies(rates: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each labeller says poor of junk of all kinds together, and of good documents."""
    return shares[1:] @ rates[1:] / shares[1:].sum(), rates[0]


class _Kinds(dict):
    """Kind of a character by its code point: letters as ``a`` or ``A``, digits as ``0``, all else as it is."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        found = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if len(self) < _WORDS_REMEMBERED:
            self[point] = found
        return found


_KINDS = _Kinds()
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def _shape(word: str) -> str:
    """Letters as ``a`` or ``A``, digits as ``0``, runs once; all else as it is. The whole word counts, however long."""
    if word.isalpha():
        return "a" if word.islower() else "A" if word.isupper() else "Aa"
    return _RUN.sub(r"\1", word.translate(_KINDS))


class _Slots(dict):
    """Slots of a word's hashed features, remembered per worker; long words, maybe whole texts, are not kept."""

    def __init__(self, slots: int):
        super().__init__()
        self.slots = slots

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(_shape(word).encode()) % self.slots
        if len(word) <= _LONGEST_REMEMBERED:
            if len(self) > _WORDS_REMEMBERED:
                self.clear()
            self[word] = found
        return found


@functools.lru_cache(maxsize=2)
def _slots(slots: int) -> _Slots:
    return _Slots(slots)


def features(seen: Words, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes and of pairs of neighbouring shapes, repeated words, and coarse steps of
    how many words are distinct and how often the most frequent one stands. Returns slots and values."""
    if not seen.n:
        return np.zeros(0, np.int64), np.zeros(0)
    single = np.fromiter(map(_slots(slots).__getitem__, seen.words), np.int64, seen.n)
    pairs = (single[:-1] * 31 + single[1:] * 17 + 7) % slots
    named = {
        "repeats": seen.repeats,
        f"distinct {round(8 * seen.distinct)}" if seen.n >= 60 else "short": 1.0,
        f"top {round(10 * seen.top)}" if seen.n >= 20 else "few": 1.0,
    }
    extra = [zlib.crc32(k.encode()) % slots for k in named]
    shares = np.bincount(np.concatenate([single, pairs]), minlength=slots) / seen.n
    np.add.at(shares, extra, list(named.values()))
    where = np.flatnonzero(shares)
    return where, shares[where]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, slots: int, epochs: int = 30) -> np.ndarray:
    """Logistic weights (the last is the intercept) by AdaGrad on soft labels, both classes given equal weight."""
    weights, squares = np.zeros(slots + 1), np.full(slots + 1, 1e-8)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
    order = np.random.default_rng(5).permutation(len(rows))
    for _ in range(epochs):
        for i in order:
            at, value = rows[i]
            score = 1 / (1 + np.exp(-np.clip(weights[at] @ value + weights[-1], -30, 30)))
            cost = labels[i] / (2 * share) + (1 - labels[i]) / (2 * (1 - share))
            slope = (score - labels[i]) * cost
            for slot, g in ((at, slope * value), (np.array([slots]), np.array([slope]))):
                squares[slot] += g * g
                weights[slot] -= 0.5 * g / np.sqrt(squares[slot])
    return weights


def classify(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    train_rows: int = 4000,
    slots: int = 2**14,
    keep_from: float = 0.5,
) -> DataFrame:
    """``docs`` with ``votes`` (a digit per labeller: 0 poor, 1 good, 2 abstains), ``posterior``, ``score`` and ``keep``.

    The counts behind the posterior cover all rows. The scorer learns from at most ``train_rows`` different rows, those with the least hash of
    id and text. A row is kept from a score of ``keep_from`` on. A null text, or one without words, gets score 0 and
    is not kept. Repeated rows get equal results. Columns already named like the new ones are replaced;
    all others stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    voted = docs.select(F.xxhash64(doc_id, text).alias("hash"), F.col(text).alias("text"))
    stored = shared.stored(voted.mapInArrow(_voting, "hash long, votes string"), "votes")
    # At most 3 to the power of the labellers, whatever the number of documents.
    patterns = stored.groupBy("votes").count().collect()
    nothing = str(ABSTAIN) * len(LABELLERS)
    known = sorted((r["votes"], r["count"]) for r in patterns if r["votes"] != nothing)
    posterior = {}
    if known:
        table = np.array([[int(v) for v in p] for p, _ in known])
        found, _, _ = expectation_maximisation(table, np.array([c for _, c in known], np.float64))
        posterior = dict(zip((p for p, _ in known), found.tolist()))
    # Repeated rows share a hash and count once in the sample, so that no group of them reaches the driver.
    sample = stored.filter(F.col("votes") != nothing).select("hash").distinct().orderBy("hash").limit(train_rows)
    border = sample.agg(F.max("hash")).first()[0]
    weights = np.zeros(slots + 1)
    if border is not None:
        drawn = voted.filter(F.col("hash") <= border).mapInArrow(_featuring(slots), _SAMPLE).filter(F.col("votes") != nothing)
        chosen = sorted(drawn.dropDuplicates(["hash"]).limit(train_rows).collect(), key=lambda r: r["hash"])
        rows = [(np.frombuffer(r["slots"], np.int64), np.frombuffer(r["weights"], np.float64)) for r in chosen]
        weights = fit(rows, np.array([posterior[r["votes"]] for r in chosen]), slots)
    sent = spark.sparkContext.broadcast((weights, posterior))  # slots and patterns, both of fixed size

    @F.pandas_udf("votes string, posterior double, score double")
    def judge(texts):
        import pandas as pd

        weights, posterior = sent.value
        rows = []
        for words in texts:
            seen = Words(words or "")
            at, value = features(seen, slots)
            vote = votes(seen)
            score = 1 / (1 + np.exp(-np.clip(weights[at] @ value + weights[-1], -30, 30))) if len(at) else 0.0
            rows.append((vote, posterior.get(vote), float(score)))
        return pd.DataFrame(rows, columns=["votes", "posterior", "score"])

    held = next(name for name in map("_judged{}".format, itertools.count()) if name not in docs.columns)
    judged = docs.withColumn(held, judge(F.col(text)))
    for name in ("votes", "posterior", "score"):
        judged = judged.withColumn(name, F.col(f"{held}.{name}"))
    return judged.drop(held).withColumn("keep", F.col("score") >= keep_from)


_SAMPLE = "hash long, votes string, slots binary, weights binary"


def _voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        voted = [votes(Words(words or "")) for words in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["hash"], pa.array(voted, pa.string())], ["hash", "votes"])


def _featuring(slots: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Words(words or "") for words in batch["text"].to_pylist()]
            voted = list(map(votes, texts))
            found = [features(seen, slots) for seen in texts]
            columns = [
                batch["hash"],
                pa.array(voted, pa.string()),
                pa.array([at.astype(np.int64).tobytes() for at, _ in found], pa.binary()),
                pa.array([value.astype(np.float64).tobytes() for _, value in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "votes", "slots", "weights"])

    return rows
