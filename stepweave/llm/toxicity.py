"""Toxicity by the nearest labelled examples.

A bounded sample of labelled documents is turned into TF-IDF vectors over words
and word beginnings that tell the classes apart. Its inverted index keeps each
posting list in blocks of examples together with the list's largest weight in
each block. A document's nearest examples by exact cosine are found from the
blocks' upper bounds: blocks are read in order of their bound, until no unread
block can reach the k-th best. The neighbours vote with their similarity; the
vote is turned into a probability by a logistic curve fitted on sampled
documents that are not in the index.

Only the text enters a score. The sample is bounded by ``MAX_EXAMPLES``, the
features by ``MAX_FEATURES``, so the model sent to the executors has a fixed
largest size. Every document is scored, over its whole text.

Cases: a null or empty text has no features; so do texts without any telling
word: they get the calibrated score of a vote without neighbours. Null labels
and labels without a document aren't learned from. Without any labelled example
of a class, all scores are the share of the other (0.5 without labels).
Neighbours of equal similarity are taken in order of their place in the index,
which follows a hash of their text.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import ship
from stepweave.llm.pieces import text_groups
from stepweave.session import cut_lineage

MAX_EXAMPLES = 8_000
MAX_FEATURES = 4_096
LEAST_LOG_ODDS = 1.5
LEAST_DOCUMENTS = 3
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
PRIOR_WEIGHT = 0.2
CUT = 0.7
# words whose features a task remembers, before the last text's
MAX_KNOWN = 500_000
# score without any labelled document
UNKNOWN = 0.5

SPLIT = bytes(range(48)) + bytes(range(48, 58)) + bytes(range(58, 65)) + bytes(range(97, 123)) + bytes(range(91, 256))
TO_WORDS = bytes(b if (48 <= b < 58 or 97 <= b < 123 or b >= 128) else 32 for b in SPLIT)


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(TO_WORDS).split()


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings (marked by a full stop)."""
    whole = word.decode("utf-8", "replace")
    return [word, *(whole[:n].encode() + b"." for n in PREFIXES if len(whole) >= n)]


@dataclass
class Model:
    names: dict[bytes, int]
    idf: np.ndarray
    n_examples: int
    starts: np.ndarray  # of each feature's postings
    rows: np.ndarray  # postings: examples in ascending order
    weights: np.ndarray
    block_max: np.ndarray  # features x blocks
    block_starts: np.ndarray  # features x (blocks + 1): where a block's postings begin
    labels: np.ndarray
    ids: list
    share: float
    curve: tuple[float, float]

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(sorted(counts), np.int64, len(counts))
        w = (1 + np.log(np.array([counts[i] for i in at.tolist()], float))) * self.idf[at]
        norm = np.sqrt((w * w).sum())
        return at, w / norm if norm else w

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of highest positive cosine, and the cosines."""
        none = np.empty(0, np.int64), np.empty(0)
        if not len(at) or not self.n_examples:
            return none
        bounds = w @ self.block_max[at]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best_rows, best = none
        position, step = 0, 4
        while position < len(order):
            batch = order[position : position + step]
            if len(best) >= k:
                batch = batch[bounds[batch] >= best[k - 1] - 1e-9]
                if not len(batch):
                    break
            scores = self._read(at, w, batch)
            found = np.flatnonzero(scores > 0)
            rows = np.r_[best_rows, batch[found // BLOCK] * BLOCK + found % BLOCK]
            sims = np.r_[best, scores[found]]
            top = np.lexsort((rows, -np.round(sims, 12)))[:k]
            best_rows, best = rows[top], sims[top]
            position += step
            step *= 4
        return best_rows, best

    def _read(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of all examples in ``blocks``, from the postings of the features ``at`` there."""
        starts = self.block_starts[at][:, blocks]
        lengths = self.block_starts[at][:, blocks + 1] - starts
        flat = lengths.ravel()
        ends = np.cumsum(flat)
        postings = np.arange(ends[-1]) + np.repeat(starts.ravel() - (ends - flat), flat)
        base = np.broadcast_to(np.arange(len(blocks)) * BLOCK, lengths.shape).ravel()
        place = self.rows[postings] % BLOCK + np.repeat(base, flat)
        weight = self.weights[postings] * np.repeat(np.repeat(w, len(blocks)), flat)
        return np.bincount(place, weight, len(blocks) * BLOCK)

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Share of label 1 among the neighbours, weighted by similarity and drawn to the class share."""
        return float(((sims * self.labels[rows]).sum() + PRIOR_WEIGHT * self.share) / (sims.sum() + PRIOR_WEIGHT))

    def score(self, vote: float) -> float:
        slope, offset = self.curve
        return float(1 / (1 + np.exp(-np.clip(slope * _logit(vote) + offset, -30, 30))))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted, lightly ridged logistic curve, by Newton steps."""
    x = np.c_[_logit(votes), np.ones(len(votes))]
    beta = np.array([1.0, 0.0])
    ridge = np.array([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (labels - p)) - ridge * (beta - np.array([1.0, 0.0]))
        hessian = (x * (weights * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])  # a higher vote never lowers the score


def fit(examples: list[tuple[object, str, int]], share: float) -> Model:
    """A model from ``(id, text, label)``; ``share`` is the share of label 1 among all labelled rows.

    Every fourth example calibrates, the others are indexed.
    """
    counted = [Counter(words_of(text)) for _, text, _ in examples]
    features: dict[bytes, list[bytes]] = {w: features_of(w) for w in set().union(*counted)}
    y = np.array([label for *_, label in examples], float)
    indexed = np.arange(len(examples)) % 4 != 3
    seen = {0: Counter(), 1: Counter()}
    for words, label in zip(counted, y):
        seen[int(label)].update(set().union(*map(features.__getitem__, words)))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    ranked = []
    for name in seen[0].keys() | seen[1].keys():
        a, b = seen[1][name], seen[0][name]
        if a + b < LEAST_DOCUMENTS or not n1 or not n0 or a + b == len(y):
            continue
        # does not depend on the number of examples, unlike a bound on chi-square
        odds = np.log((a + 0.5) / (n1 - a + 0.5) * (n0 - b + 0.5) / (b + 0.5))
        if abs(odds) < LEAST_LOG_ODDS:
            continue
        chi = len(y) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * (len(y) - a - b))
        ranked.append((-chi, name, a + b))
    ranked = sorted(ranked)[:MAX_FEATURES]
    names = {name: i for i, (_, name, _) in enumerate(ranked)}
    idf = np.log((1 + len(y)) / (1 + np.array([d for *_, d in ranked], float))) + 1 if ranked else np.empty(0)
    of_word = {w: ids for w, fs in features.items() if (ids := [names[f] for f in fs if f in names])}
    bags: list[Counter] = [Counter() for _ in counted]
    for bag, words in zip(bags, counted):
        for word in words.keys() & of_word.keys():
            for i in of_word[word]:
                bag[i] += words[word]

    model = Model(
        names, idf, 0, np.zeros(len(names) + 1, np.int64), np.empty(0, np.int64), np.empty(0),
        np.zeros((len(names), 0)), np.zeros((len(names), 1), np.int64), np.empty(0), [], share, (1.0, 0.0),
    )
    mine = [i for i in np.flatnonzero(indexed).tolist() if bags[i]]
    vectors = [model.vector(bags[i]) for i in mine]
    model.n_examples = len(mine)
    model.labels, model.ids = y[mine], [examples[i][0] for i in mine]
    if mine:
        feature = np.concatenate([at for at, _ in vectors])
        row = np.repeat(np.arange(len(mine)), [len(at) for at, _ in vectors])
        weight = np.concatenate([w for _, w in vectors])
        order = np.lexsort((row, feature))
        feature, model.rows, model.weights = feature[order], row[order], weight[order]
        model.starts = np.searchsorted(feature, np.arange(len(names) + 1))
        model.block_max = np.zeros((len(names), -(-len(mine) // BLOCK)))
        np.maximum.at(model.block_max, (feature, model.rows // BLOCK), model.weights)
        lengths = np.zeros(model.block_max.shape, np.int64)
        np.add.at(lengths, (feature, model.rows // BLOCK), 1)
        model.block_starts = model.starts[:-1, None] + np.c_[np.zeros(len(names), np.int64), lengths.cumsum(1)]
    held = np.flatnonzero(~indexed)
    if n1 and n0 and len(held):
        votes = np.array([model.vote(*model.nearest(*model.vector(bags[i]))) for i in held.tolist()])
        # classes are sampled alike; weights restore their shares
        of = {1: share * len(y) / n1, 0: (1 - share) * len(y) / n0}
        model.curve = _fit_curve(votes, y[held], np.array([of[int(v)] for v in y[held]]))
    return model


def train(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, most: int = MAX_EXAMPLES) -> Model:
    """Fit on the first ``most`` labelled rows in the order of a hash, half of each class where there are so many."""
    spark = docs.sparkSession
    ship(spark)
    y = F.col(f"`{label}`").cast("int")
    known = y.isin(0, 1) & F.col(f"`{id_col}`").isNotNull()
    ranked = labels.where(known).select(F.col(f"`{id_col}`").alias("id"), y.alias("y"))
    sizes = {r["y"]: r["n"] for r in ranked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    share = n1 / (n1 + n0) if n1 + n0 else 0.5
    take = {1: max(most // 2, most - n0), 0: max(most // 2, most - n1)}
    order = F.md5(F.col("id").cast("string"))
    parts = [ranked.where(F.col("y") == c).orderBy(order, "id").limit(take[c]) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1]).dropDuplicates(["id"])
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), whole.alias("whole"))
    chosen = texts.join(sample, "id").select("id", "whole", "y")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
        rows.sort(key=lambda r: (hash_of(r[1]), r[1], r[2]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows[:most], share if rows else UNKNOWN))], pa.binary())], ["model"])

    # the corpus meets the sample in parallel; one task reads the written sample, of bounded size
    row = cut_lineage(chosen).coalesce(1).mapInArrow(build, "model binary").first()
    return pickle.loads(bytes(row[0])) if row else fit([], UNKNOWN)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc, score, predicted, evidence``: all columns of a row as a struct, and its judgement.

    ``evidence`` lists the nearest labelled examples: id (as text), similarity, label.
    """
    spark = docs.sparkSession
    ship(spark)
    whole = docs.select(F.struct("*").alias("doc")).withColumn("whole", F.col("doc")[text].cast("string"))
    shared = spark.sparkContext.broadcast(model)
    evidence = pa.list_(pa.struct([("id", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = fitted.names
        known: dict[bytes, tuple[int, ...]] = {}
        for rows, texts in text_groups(batches, "whole"):
            scores, found = [], []
            for x in texts:
                words = words_of(x)
                hits = list(map(known.get, words))
                if None in hits:
                    fresh = {w for w, h in zip(words, hits) if h is None}
                    if len(known) > MAX_KNOWN:
                        # the text's other words go too, so all of them are looked up again
                        known.clear()
                        fresh = set(words)
                    for word in fresh:
                        known[word] = tuple(names[f] for f in features_of(word) if f in names)
                    hits = list(map(known.__getitem__, words))
                counts = Counter(i for h in hits if h for i in h)
                near, sims = fitted.nearest(*fitted.vector(counts)) if counts else (np.empty(0, np.int64), np.empty(0))
                scores.append(fitted.score(fitted.vote(near, sims)))
                found.append(
                    [
                        {"id": str(fitted.ids[i]), "similarity": s, "label": int(fitted.labels[i])}
                        for i, s in zip(near.tolist(), sims.tolist())
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc"), pa.array(scores, pa.float64()), pa.array(found, evidence)],
                ["doc", "score", "evidence"],
            )

    schema = T.StructType(
        [
            T.StructField("doc", whole.schema["doc"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField(
                "evidence",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("id", T.StringType()),
                            T.StructField("similarity", T.DoubleType()),
                            T.StructField("label", T.IntegerType()),
                        ]
                    )
                ),
            ),
        ]
    )
    return whole.mapInArrow(judge, schema).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def held_out(id_col: str):
    """Whether a row is kept from learning: CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def digest(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scored.select(F.col("doc")[id_col].alias(id_col), "score", "predicted").select(
        id_col, held_out(id_col).alias("held_out"), "score", "predicted"
    )
