"""Quality classifier from weak labels: heuristic labellers vote on every document, expectation-maximisation estimates how
far each can be trusted, and the posterior labels train a hashed linear scorer.

A labeller votes good, bad or abstains. All that the estimation needs is how often each combination of votes occurs, over all documents: at most
3 ** len(labellers) counts, which go to the driver. The model is one of two latent classes in which labellers vote independently, begun from
whether any labeller votes bad. The scorer sees nothing of the votes: it adds up weights of hashed words and word shapes (runs of small letters, of capitals, of digits;
other characters as they are) and of words said over again, averaged over the text. It is trained on a sample by a hash of doc_id, of about TRAIN_ROWS documents; all documents are scored, as a whole.

Defined results: a text without words has score 0 and isn't kept; null is one. Rows without doc_id aren't trained on. Repeated rows count each; of rows with the same doc_id and different texts, each is
trained on under the label of one of them, and scored by its own text. An empty
table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datewright.llm.common import mapped, materialize, pick, words
from datewright.llm.quality_stats import document_counts

ABSTAINS, GOOD, BAD = 0, 1, 2
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 12
#: The share of words that are the word before over again is a feature of its own.
AGAIN = WORD_BUCKETS + SHAPE_BUCKETS
SIZE = AGAIN + 1
TRAIN_ROWS = 6000
KEEP = 0.5


def labellers() -> dict[str, Column]:
    """A vote of each, from the columns of document_counts()."""
    n, letters, lines = F.col("n_words"), F.col("n_upper") + F.col("n_lower"), F.col("n_lines")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAINS))

    return {
        "symbols": vote(10 * F.col("n_symbols") > n, 100 * F.col("n_symbols") <= n),
        "marks": vote(3 * F.col("n_marks") > n, 50 * F.col("n_marks") <= n),
        "capitals": vote(2 * F.col("n_upper") > letters, 10 * F.col("n_upper") <= letters),
        "repeats": vote(100 * F.col("n_repeat_words") > 30 * n, 100 * F.col("n_repeat_words") <= 10 * n),
        "dup_lines": vote((lines >= 3) & (10 * F.col("n_dup_lines") > 3 * lines), (lines >= 3) & (F.col("n_dup_lines") == 0)),
        "variety": vote((n >= 20) & (4 * F.col("n_distinct") < n), 2 * F.col("n_distinct") > n),
        "length": vote(n < 1, n >= 50),
    }


@dataclass
class LabelModel:
    """prior[y], and votes[labeller, y, vote]; y: 0 bad, 1 good."""

    names: list[str]
    prior: np.ndarray
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log_p = np.log(self.prior)[None, :] + sum(np.log(self.votes[i][:, patterns[:, i]]).T for i in range(len(self.names)))
        return 1 / (1 + np.exp(np.clip(log_p[:, 0] - log_p[:, 1], -700, 700)))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller where it votes."""
        right = self.prior[0] * self.votes[:, 0, BAD] + self.prior[1] * self.votes[:, 1, GOOD]
        wrong = self.prior[0] * self.votes[:, 0, GOOD] + self.prior[1] * self.votes[:, 1, BAD]
        return dict(zip(self.names, (right / (right + wrong)).tolist(), strict=True))


def estimate(names: list[str], patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """patterns: a row of votes each, counts: how many documents have it."""
    p = np.where((patterns == BAD).any(1), 0.05, 0.95)  # each looks for another fault: one that finds its own says more than those that don't find theirs
    model = LabelModel(names, np.array([0.5, 0.5]), np.full((len(names), 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        votes = np.stack([[np.bincount(patterns[:, i], weights=w, minlength=3) + 1.0 for w in weight] for i in range(len(names))])
        model = LabelModel(names, (weight.sum(1) + 1) / (weight.sum() + 2), votes / votes.sum(2, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return model


def _buckets(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct)) % np.uint64(WORD_BUCKETS)
    shape = distinct.cast(pa.string())
    for pattern, to in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}]+", "a"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, to)
    shape = shape.dictionary_encode()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, shape.dictionary.to_pylist()), np.uint64, len(shape.dictionary)) % np.uint64(SHAPE_BUCKETS)
    return word.astype(np.int64), WORD_BUCKETS + hashed.astype(np.int64)[shape.indices.to_numpy(zero_copy_only=False)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and mean counts of each text."""
    for batch in batches:
        distinct, codes, offsets = words(batch.column("text"))
        both = np.stack(_buckets(distinct)) if len(distinct) else np.zeros((2, 0), np.int64)
        places, values = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            found, n = np.unique(both[:, codes[a:b]], return_counts=True)
            found, n = np.append(found, AGAIN), np.append(n, (codes[a + 1 : b] == codes[a : b - 1]).sum() if b - a > 1 else 0)
            places.append(found.astype(np.int32))
            values.append((n / max(1, b - a)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "target", "places", "means"])


def fit(places: np.ndarray, values: np.ndarray, offsets: np.ndarray, target: np.ndarray, epochs: int = 30, rate: float = 2.0, decay: float = 1e-6) -> np.ndarray:
    """Weights of a logistic regression on sparse rows, by AdaGrad in batches of 64; the last is the constant."""
    size = SIZE
    weights, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    rng = np.random.default_rng(0)
    n = len(target)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at : at + 64]
            lengths = offsets[rows + 1] - offsets[rows]
            own = np.repeat(np.arange(len(rows)), lengths)
            index = np.arange(len(own)) + np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            where, x = places[index], values[index]
            score = np.bincount(own, weights=weights[where] * x, minlength=len(rows)) + weights[-1]
            error = 1 / (1 + np.exp(-score)) - target[rows]
            grad = np.bincount(where, weights=error[own] * x, minlength=size + 1) / len(rows)
            grad[-1] = error.mean()
            touched = np.flatnonzero(grad)
            grad = grad[touched] + decay * weights[touched]
            seen[touched] += grad * grad
            weights[touched] -= rate * grad / np.sqrt(seen[touched]) * 0.5
    return weights


def score(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    distinct, codes, offsets = words(text)
    if not len(distinct):
        return np.zeros(len(text))
    word, shape = _buckets(distinct)
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    n = np.diff(offsets)
    again[offsets[:-1][n > 0]] = False
    total = np.concatenate([[0.0], np.cumsum((weights[word] + weights[shape])[codes] + weights[AGAIN] * again)])
    logit = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1) + weights[-1]
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(logit, -700, 700))), 0.0)


def weak_labels(docs: DataFrame) -> tuple[DataFrame, LabelModel]:
    """doc_id and pattern (votes in base 3) of every document, and the model; posterior_table() turns patterns into labels."""
    votes = labellers()
    code = sum((v * 3**i for i, v in enumerate(votes.values())), F.lit(0)).cast("int")
    voted = materialize(document_counts(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), code.alias("pattern")), "votes")
    seen = voted.groupBy("pattern").agg(F.count("*").alias("n")).toPandas().sort_values("pattern")
    patterns = seen["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(votes))[None, :] % 3
    return voted, estimate(list(votes), patterns.astype(np.int64), seen["n"].to_numpy(np.float64))


def posterior_table(spark: SparkSession, model: LabelModel) -> DataFrame:
    """pattern, target (the probability of good): a row for each of the 3 ** len(labellers) patterns."""
    k = len(model.names)
    every = np.arange(3**k)[:, None] // 3 ** np.arange(k)[None, :] % 3
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.posterior(every))], "pattern int, target double")


def train(docs: DataFrame, voted: DataFrame, model: LabelModel, rows: int, most: int = TRAIN_ROWS) -> np.ndarray:
    share = min(1.0, most / max(1, rows))
    chosen = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    labels = voted.filter(chosen).dropDuplicates(["doc_id"]).join(F.broadcast(posterior_table(docs.sparkSession, model)), "pattern").select(F.col("doc_id").alias("l_id"), "target")
    some = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).filter(chosen & F.col("doc_id").isNotNull())
    sample = some.join(labels, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "target")
    found = mapped(sample, _features, "doc_id long, target double, places array<int>, means array<float>").toArrow().sort_by("doc_id").combine_chunks()
    if not found.num_rows:
        return np.zeros(SIZE + 1)
    places, values = (pa.concat_arrays(found[c].chunks) if found[c].num_chunks else found[c] for c in ("places", "means"))
    return fit(places.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float64), np.concatenate([[0], np.cumsum(pc.list_value_length(places).to_numpy())]).astype(np.int64), found["target"].to_numpy())


def quality_classifier(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, score (0 to 1), kept."""
    voted, model = weak_labels(docs)
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, voted, model, voted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text"), weights.value))], ["doc_id", "score"])

    scored = mapped(pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, score double")
    return scored.withColumn("kept", F.col("score") >= keep)
