"""Masked pseudo-likelihood: a small network predicts every word from both sides.

Words are hashed to ``VOCABULARY`` ids in ``CLASSES`` equal classes. The network
sees the two words on either side, embeds them by position, and gives the class
of the word in the middle and then the word in its class, so a prediction costs
the square root of the vocabulary. A document's score is the sum over its words
of their log-probabilities given the words around them.

Training covers all documents and predicts every one of their words once. Texts
become ids once, in a table that training and scoring read. Documents are dealt by
a hash of id and words into ``ROUNDS`` parts, one for each round, and in a round
into groups of about ``GROUP_WORDS`` words. Every group takes gradient steps from
the current weights, its documents in the order of their hashes, and the groups'
weights are averaged by the words they have seen, in groups of ``FAN`` at a time
and in order. So the model does not depend on how the documents are partitioned,
what is gathered grows with the corpus, and one set of weights comes to the driver.

A word is a stretch without ASCII white space, A-Z in lower case. A document
without words scores 0, with a null mean. A null id is kept. Repeated rows count
as often as they occur. Empty tables give empty results and no training. Only id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelead.llm.text import hash_words, in_parts
from wavelead.storage import materialize

VOCABULARY = 4096
CLASSES = 64
SIDE = 2
EMBEDDING = 8
HIDDEN = 16
ROUNDS = 2
GROUP_WORDS = 1 << 21
BATCH = 4096
RATE = 0.1
FAN = 32
# The id that stands before the first word and after the last one.
EDGE = VOCABULARY


class WordIds:
    """Ids of words: their hashes modulo ``VOCABULARY``."""

    def of(self, text: str | None) -> np.ndarray:
        return self.of_column(pa.array([text], pa.string()))[0].astype(np.int64)

    def of_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of all texts one after another, and where each text's begin and end."""
        hashes, ends = hash_words(texts)
        return (hashes % np.uint64(VOCABULARY)).astype("<u2"), ends


@dataclass
class Weights:
    """All in single precision. ``members`` has the words of every class."""

    embed: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    members: np.ndarray
    member_bias: np.ndarray

    @staticmethod
    def fresh(seed: int = 1) -> Weights:
        chance = np.random.default_rng(seed)
        size = VOCABULARY // CLASSES

        def small(*shape: int) -> np.ndarray:
            return (chance.normal(size=shape) / np.sqrt(shape[-2])).astype(np.float32)

        return Weights(
            small(2 * SIDE, VOCABULARY + 1, EMBEDDING) * np.float32(np.sqrt(VOCABULARY)) * np.float32(0.1),
            small(2 * SIDE * EMBEDDING, HIDDEN),
            np.zeros(HIDDEN, np.float32),
            small(HIDDEN, CLASSES),
            np.zeros(CLASSES, np.float32),
            small(CLASSES, HIDDEN, size),
            np.zeros((CLASSES, size), np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def pack(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @staticmethod
    def unpack(flat: np.ndarray) -> Weights:
        shapes = [a.shape for a in Weights.fresh().arrays()]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        parts = np.split(flat.astype(np.float32), ends[:-1])
        return Weights(*[p.reshape(s).copy() for p, s in zip(parts, shapes)])


def softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and the logarithm of what they were divided by; ``x`` is used up."""
    top = x.max(axis=1, keepdims=True)
    x -= top
    np.exp(x, out=x)
    total = x.sum(axis=1, keepdims=True)
    x /= total
    return x, (np.log(total) + top)[:, 0]


def forward(w: Weights, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded surroundings and hidden layer; ``around`` has the ids of the words on both sides."""
    seen = np.concatenate([w.embed[k][around[:, k]] for k in range(2 * SIDE)], axis=1)
    return seen, np.tanh(seen @ w.inner + w.inner_bias)


def class_runs(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and (class, first, end) of each run in it."""
    of = (words // (VOCABULARY // CLASSES)).astype(np.uint16)  # short integers are sorted digit by digit
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=CLASSES)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]


def member_logits(w: Weights, ordered: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Of the words in the class of each row; rows are in the order of their classes."""
    logits = np.empty((len(ordered), VOCABULARY // CLASSES), ordered.dtype)
    for c, a, b in runs:
        np.matmul(ordered[a:b], w.members[c], out=logits[a:b])
    logits += np.repeat(w.member_bias[[c for c, _, _ in runs]], [b - a for _, a, b in runs], axis=0)
    return logits


def log_probabilities(w: Weights, around: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log-probability of every word given the words around it."""
    size, rows = VOCABULARY // CLASSES, np.arange(len(words))
    if not len(words):
        return np.zeros(0)
    _, hidden = forward(w, around)
    logits = hidden @ w.classes + w.class_bias
    total = logits[rows, words // size].astype(np.float64)
    total -= softmax(logits)[1]
    order, runs = class_runs(words)
    logits = member_logits(w, hidden[order], runs)
    inside = logits[rows, words[order] % size].astype(np.float64)
    inside -= softmax(logits)[1]
    total[order] += inside
    return total


def sparse_gradients(
    w: Weights, around: np.ndarray, words: np.ndarray
) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Of the mean negative log-probability: the rows of ``embed`` that occur with theirs, and all other arrays."""
    size, n = VOCABULARY // CLASSES, len(words)
    seen, hidden = forward(w, around)
    error, _ = softmax(hidden @ w.classes + w.class_bias)
    error[np.arange(n), words // size] -= 1
    error /= n
    back = error @ w.classes.T
    members, member_bias = np.zeros_like(w.members), np.zeros_like(w.member_bias)
    order, runs = class_runs(words)
    ordered = hidden[order]
    inside, _ = softmax(member_logits(w, ordered, runs))
    inside[np.arange(n), words[order] % size] -= 1
    inside /= n
    through = np.empty_like(ordered)
    for c, a, b in runs:
        np.matmul(ordered[a:b].T, inside[a:b], out=members[c])
        np.matmul(inside[a:b], w.members[c].T, out=through[a:b])
    member_bias[[c for c, _, _ in runs]] = np.add.reduceat(inside, [a for _, a, _ in runs], axis=0)
    back[order] += through
    back *= 1 - hidden**2
    into = back @ w.inner.T
    embed = []
    for k in range(2 * SIDE):
        ids = around[:, k].astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        ordered = ids[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        part = into[order, k * EMBEDDING : (k + 1) * EMBEDDING]
        embed.append((ordered[starts], np.add.reduceat(part, starts, axis=0)))
    return embed, [seen.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0), members, member_bias]


def gradients(w: Weights, around: np.ndarray, words: np.ndarray) -> Weights:
    """The same with all rows of ``embed``."""
    rows, others = sparse_gradients(w, around, words)
    embed = np.zeros_like(w.embed)
    for k, (ids, change) in enumerate(rows):
        embed[k][ids] = change
    return Weights(embed, *others)


def surroundings(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents, the ids around each, and the document that each is in."""
    edge = np.full(SIDE, EDGE, np.int64)
    line = np.concatenate([edge, *[part for d in documents for part in (d, edge)]])
    sizes = np.array([len(d) for d in documents], np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    at = np.arange(len(owner)) + SIDE + SIDE * owner
    offsets = [*range(-SIDE, 0), *range(1, SIDE + 1)]
    return line[at], np.stack([line[at + k] for k in offsets], axis=1), owner


class Learner:
    """Gradient steps with a rate of its own for every weight, falling with the steps it has taken."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.squares = [np.full_like(a, 1e-6) for a in weights.arrays()]

    def step(self, around: np.ndarray, words: np.ndarray) -> None:
        rows, changes = sparse_gradients(self.weights, around, words)
        embed, *others = self.weights.arrays()
        for k, (ids, change) in enumerate(rows):
            square = self.squares[0][k][ids] + change * change
            self.squares[0][k][ids] = square
            embed[k][ids] -= RATE * change / np.sqrt(square)
        for value, square, change in zip(others, self.squares[1:], changes):
            square += change * change
            value -= RATE * change / np.sqrt(square)


def word_table(docs: DataFrame) -> DataFrame:
    """doc_id, the ids of its words as 16-bit integers, and their number."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for whole in batches:
            for batch in in_parts(whole, 1):
                found, ends = ids.of_column(batch.column(1))
                offsets, values = pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(found))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, values]),
                        pa.array(np.diff(ends), pa.int64()),
                    ],
                    names=["doc_id", "ids", "n_words"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        build, "doc_id long, ids binary, n_words long"
    )


def learn_documents(learner: Learner, documents: Iterator[np.ndarray]) -> int:
    """Steps over all words of the documents in their order; how many words there were."""
    held, count, total = [], 0, 0
    for ids in documents:
        held.append(ids)
        count += len(ids)
        total += len(ids)
        if count >= 16 * BATCH:
            learn_words(learner, held)
            held, count = [], 0
    if held:
        learn_words(learner, held)
    return total


def learn_words(learner: Learner, documents: list[np.ndarray]) -> None:
    words, around, _ = surroundings(documents)
    for at in range(0, len(words), BATCH):
        learner.step(around[at : at + BATCH], words[at : at + BATCH])


WEIGHTS = "part long, seen double, weights binary"


def average(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Weights of up to ``FAN`` parts, by the words that each has seen; added up in the order of the parts."""
    rows = rows.sort_values("part")
    seen = rows["seen"].to_numpy()
    total = np.zeros(len(rows["weights"].iloc[0]) // 4, np.float64)
    for packed, n in zip(rows["weights"], seen):
        total += np.frombuffer(packed, np.float32) * (n / seen.sum())
    packed = total.astype(np.float32).tobytes()
    return pd.DataFrame({"part": [int(key[0])], "seen": [seen.sum()], "weights": [packed]})


def train_round(dealt: DataFrame, flat: np.ndarray, groups: int) -> np.ndarray | None:
    """Averaged weights after a pass over ``dealt`` (group, key, ids); None if it is empty."""
    start = dealt.sparkSession.sparkContext.broadcast(flat.astype(np.float32))

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Equal keys but for a chance of 2**-64 are copies of one document.
        rows = rows.sort_values("key", kind="stable")
        learner = Learner(Weights.unpack(start.value))
        seen = learn_documents(learner, (np.frombuffer(ids, "<u2") for ids in rows["ids"]))
        return pd.DataFrame({"part": [int(key[0])], "seen": [float(seen)], "weights": [learner.weights.pack().tobytes()]})

    learned = materialize(dealt.groupBy("group").applyInPandas(learn, WEIGHTS), "weights")
    while groups > 1:
        of = F.floor(F.col("part") / FAN).cast("long")
        learned = learned.groupBy(of.alias("of")).applyInPandas(average, WEIGHTS)
        groups = -(-groups // FAN)
    row = learned.first()
    return None if row is None else np.frombuffer(row["weights"], np.float32)


def train_words(table: DataFrame, rounds: int = ROUNDS, group_words: int = GROUP_WORDS) -> Weights:
    """Weights from all documents of ``word_table``."""
    full = table.where("n_words > 0")
    size = full.agg(F.sum(F.col("n_words") + 1)).first()[0] or 0
    groups = max(1, -(-size // (rounds * group_words)))
    # Copies of a row are numbered, so that they are dealt over all groups however many there are.
    copies = full.groupBy("doc_id", "ids").agg(F.count(F.lit(1)).alias("n"))
    one = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    key = F.xxhash64("doc_id", "ids", "copy", F.lit(5))
    dealt = materialize(
        one.select(
            "ids",
            key.alias("key"),
            F.pmod(key, F.lit(rounds)).cast("int").alias("round"),
            F.pmod(F.xxhash64(key), F.lit(groups)).alias("group"),
        ),
        "dealt-words",
        ("round",),
    )
    flat = Weights.fresh().pack()
    for number in range(rounds):
        learned = train_round(dealt.where(F.col("round") == number).drop("round"), flat, groups)
        flat = flat if learned is None else learned
    return Weights.unpack(flat)


def train(docs: DataFrame, rounds: int = ROUNDS, group_words: int = GROUP_WORDS) -> Weights:
    return train_words(materialize(word_table(docs), "word-ids"), rounds, group_words)


def score_words(table: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_likelihood of every row of ``word_table``."""
    shared = table.sparkSession.sparkContext.broadcast(weights.pack())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Weights.unpack(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [np.frombuffer(ids, "<u2") for ids in batch.column(1).to_pylist()]
                words, around, owner = surroundings(found)
                logs = np.zeros(len(words))
                for k in range(0, len(words), 8192):
                    logs[k : k + 8192] = log_probabilities(w, around[k : k + 8192], words[k : k + 8192])
                n = np.array([len(f) for f in found])
                total = np.bincount(owner, logs, len(found))
                mean = [t / m if m else None for t, m in zip(total.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(total.astype(np.float64)), pa.array(mean, pa.float64())],
                    names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"],
                )

    return table.select("doc_id", "ids").mapInArrow(
        judge, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double"
    )


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_likelihood of every row."""
    return score_words(word_table(docs), weights)


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on all of ``docs`` and score every one of them."""
    table = materialize(word_table(docs), "word-ids")
    return score_words(table, train_words(table, rounds))
