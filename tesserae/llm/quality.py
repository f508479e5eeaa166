"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on each document. Expectation-maximisation
estimates how often each labeller votes how on good and on bad documents (labellers
overlap and have no truth to be measured by); its posterior labels train a linear
scorer over hashed byte trigrams, which generalises beyond the labellers' rules.

Only how often each combination of votes occurs matters for the estimate, so it works
on at most 3**labellers counts over the whole corpus. The scorer is fitted on a bounded
sample, and scores every whole text.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialise, narrowed
from tesserae.llm.langid import BUCKETS, trigram_counts

#: Documents that the scorer is fitted on, at most.
SAMPLE = 3000
#: Posteriors at which a document serves as a training example.
SURE = (0.2, 0.8)
EPOCHS, RATE, DECAY = 6, 4.0, 1e-5
#: A document is dropped only if both its weak label and its score are below this.
KEEP = 0.5

ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("length", "signs", "word_length", "upper_case", "digits", "repetition", "endings", "marked_words", "echoes")

#: Byte classes: lower case, upper case, digit, sign, white space, beyond ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:128] = 3
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
#: ASCII marks of ordinary prose, which don't count as signs.
_SIGN = (_CLASS == 3) & ~np.isin(np.arange(256), np.frombuffer(b".,;:'\"()-?", np.uint8))


def votes(text: bytes) -> int:
    """The labellers' votes on a whole text as one number of base 3, the first labeller lowest."""
    b = np.frombuffer(text, np.uint8)
    lower, upper, digits, _, _, other = np.bincount(_CLASS[b], minlength=6).tolist()
    sign = _SIGN[b]
    signs = int(np.count_nonzero(sign))
    runs = int(np.count_nonzero(sign[1:] & ~sign[:-1]))
    words = text.split()
    n, letters = len(words), lower + upper + other
    ink = max(1, letters + digits + signs)
    echoes = sum(map(operator.eq, words, words[1:]))
    distinct = len(set(words)) / n if n else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".!?\"'" for x in lines) / len(lines) if lines else 0.0
    mean = letters / n if n else 0.0
    # A long text repeats words by necessity: Heaps' law, loosely.
    expected = min(1.0, 4.0 / max(n, 1) ** 0.35)
    rules = (
        (n >= 8, n < 3), (signs <= 0.02 * ink, signs > 0.08 * ink), (3 <= mean <= 10, not 2 <= mean <= 14),
        (upper <= 0.12 * letters, upper > 0.4 * letters), (digits <= 0.04 * ink, digits > 0.25 * ink),
        (distinct >= 0.6 * expected, distinct < 0.3 * expected), (ended >= 0.7, ended < 0.2),
        (runs <= 0.05 * n, runs > 0.3 * n),
        (echoes <= 0.05 * n, echoes > 0.3 * n))
    return sum(3**i * (GOOD if good else BAD if bad else ABSTAIN) for i, (good, bad) in enumerate(rules))


def unpack(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**i % 3 for i in range(len(LABELLERS))], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over combinations of votes: (posterior of good per combination, P(vote | class, labeller), prior).

    Starts from the majority of votes. Ends when no posterior moves by more than 1e-9.
    """
    v, n = unpack(patterns), counts.astype(float)
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    post = (good + 0.5) / (good + bad + 1)
    for _ in range(rounds):
        mass = np.stack([n * (1 - post), n * post])
        prior = (mass[1].sum() + 1) / (n.sum() + 2)
        table = np.empty((2, v.shape[1], 3))
        for vote in range(3):
            table[:, :, vote] = mass @ (v == vote) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log([1 - prior, prior])[:, None] + sum(np.log(table[:, j, v[:, j]]) for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            break
    # The classes have no names; good is the one on which the labellers vote good more often.
    if table[1, :, GOOD].sum() + table[0, :, BAD].sum() < table[0, :, GOOD].sum() + table[1, :, BAD].sum():
        post, table, prior = 1 - post, table[::-1], 1 - prior
    return post, table, prior


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams and their shares, of unit length."""
    counts = trigram_counts(text)
    at = np.flatnonzero(counts)
    x = np.sqrt(counts[at].astype(float))
    return at, x / max(1e-12, np.sqrt((x * x).sum()))


def train(examples: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Logistic regression by stochastic gradient descent in a fixed order; the last weight is the bias."""
    w = np.zeros(BUCKETS + 1)
    if not examples:
        return w
    share = min(0.95, max(0.05, float(np.mean([y for _, _, y in examples]))))
    order, step = np.random.default_rng(1), 0
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            at, x, y = examples[i]
            rate = RATE / (1 + step * DECAY * 10)
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))
            # Both classes weigh the same.
            g = (p - y) * (0.5 / share if y >= 0.5 else 0.5 / (1 - share))
            w[at] -= rate * (g * x + DECAY * w[at])
            w[-1] -= 0.1 * rate * g
            step += 1
    return w


def classify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes, posterior, score, keep for every whole text of ``docs``.

    ``posterior`` is the weak label's probability of good quality, ``score`` the linear
    scorer's. Null counts as empty text. Repeated rows get equal results; an empty table
    gives no rows. Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    rows = narrowed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def vote(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([votes(t.as_py()) for t in batch.column(1)], pa.int32())], names=["mark", "votes"])

    voted = materialise(rows.select(F.xxhash64("text").alias("mark"), "text").mapInArrow(vote, "mark long, votes int"), "votes")
    counted = sorted(map(tuple, voted.groupBy("votes").count().collect()))
    patterns, counts = (np.array([x[i] for x in counted], np.int64) for i in (0, 1))
    posterior = dict(zip(patterns.tolist(), estimate(patterns, counts)[0].tolist(), strict=True)) if counted else {}

    # The sure documents of smallest hash, as many of either class.
    chosen = set()
    for sure in ([p for p, x in posterior.items() if x <= SURE[0]], [p for p, x in posterior.items() if x >= SURE[1]]):
        marks = voted.where(F.col("votes").isin(sure)).select("mark").distinct().orderBy("mark").limit(sample // 2)
        chosen |= {x[0] for x in marks.collect()}
    held = sc.broadcast((posterior, chosen))

    def example(batches):
        known, wanted = held.value
        for batch in batches:
            out = [[], [], [], []]
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if mark in wanted:
                    at, x = features(text.as_py().lower())
                    for column, value in zip(out, (mark, at.astype(np.int32).tobytes(), x.astype(np.float32).tobytes(), known[votes(text.as_py())]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["mark", "at", "x", "y"])

    examples = rows.select(F.xxhash64("text").alias("mark"), "text").mapInArrow(example, "mark long, at binary, x binary, y double")
    examples = examples.dropDuplicates(["mark"]).collect()  # at most ``sample`` rows
    weights = train([(np.frombuffer(e.at, np.int32), np.frombuffer(e.x, np.float32), float(e.y >= 0.5)) for e in sorted(examples, key=lambda e: e.mark)])
    held_w = sc.broadcast(weights)

    def score(batches):
        known, w = held.value[0], held_w.value
        for batch in batches:
            out = [[], [], []]
            for value in batch.column(1):
                text = value.as_py()
                v, (at, x) = votes(text), features(text.lower())
                out[0].append(v)
                out[1].append(known.get(v, 0.5))
                out[2].append(float(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.float64(), pa.float64()), strict=True))], names=["doc_id", "votes", "posterior", "score"])

    scored = rows.mapInArrow(score, "doc_id long, votes int, posterior double, score double")
    return scored.withColumn("keep", (F.col("posterior") >= KEEP) | (F.col("score") >= KEEP))
