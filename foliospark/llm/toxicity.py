"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model over their votes, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import mapped, materialise

#: About so many labelled rows, chosen by a hash of the id, fit the model; documented bound of what fitting gathers.
TRAIN_ROWS = 20_000
MAX_VOTERS, MAX_FEATURES = 600, 1000
HELD_VOTERS = 200_000
LEAST_DOCS = 4
#: Evidence of a voter or feature, toxic texts times log lift, or chance alone would make them of rare words.
LEAST_EVIDENCE = 20.0
#: Lexicon voters look for a whole word, pattern voters for a word that begins with so many letters, or SEVERAL such words; the
#: classifier also knows word endings.
PREFIXES, ENDINGS = (4, 5, 6), (4, 5)
SEVERAL = 2
THRESHOLD = 0.7
#: Voters of a smaller correlation given the label count as independent (those of one language are correlated a little, all of them).
DEPENDENT = 0.7
#: Of 100 labelled rows so many show their label to the label model; it judges the others by their votes.
SEEDS = 50

_WORD = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> set[str]:
    return set(_WORD(text.lower())) if text else set()


def voters_of(words: set[str]) -> set[str]:
    """Lexicon voters "=word" and pattern voters "^prefix" (one word) and "#prefix" (several words) that a text sets off."""
    out = {"=" + w for w in words}
    for n in PREFIXES:
        starts = Counter(w[:n] for w in words if len(w) >= n)
        out.update("^" + p for p in starts)
        out.update("#" + p for p, k in starts.items() if k >= SEVERAL)
    return out


def features_of(words: set[str]) -> set[str]:
    """What the classifier sees of a text: all that voters see, and "$ending"."""
    return voters_of(words) | {"$" + w[-n:] for w in words for n in ENDINGS if len(w) > n}


def _count(marks: Callable[[set[str]], set[str]], belief: Callable[[set[str], int], float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (text, toxic) to the sums of belief and disbelief in toxicity for each mark, HELD_VOTERS marks at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[float]] = {}

        def held() -> Iterator[pa.RecordBatch]:
            names = list(sums)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([sums[v][0] for v in part], pa.float64()), pa.array([sums[v][1] for v in part], pa.float64())], names=["mark", "toxic", "clean"])
            sums.clear()

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = words_of(text.as_py())
                share = round(belief(words, label), 6)
                for v in marks(words):
                    at = sums.setdefault(v, [0.0, 0.0])
                    at[0] += share
                    at[1] += 1 - share
                if len(sums) > HELD_VOTERS:
                    yield from held()
        yield from held()

    return count


def strongest(train: DataFrame, marks, belief, toxic: float, clean: float, limit: int, least: int = LEAST_DOCS) -> list[str]:
    """The marks with most evidence for toxicity, the strongest first; toxic and clean are the sums of belief over all rows."""
    if not toxic or not clean:
        return []
    counts = train.select("text", "toxic").transform(mapped, _count(marks, belief), "mark string, toxic double, clean double")
    counts = counts.groupBy("mark").agg(F.round(F.sum("toxic"), 3).alias("t"), F.round(F.sum("clean"), 3).alias("c"))
    lift = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1)))
    strong = counts.where((F.col("t") >= least) & (lift > 2)).withColumn("strength", F.round(F.col("t") * lift, 6)).where(F.col("strength") >= LEAST_EVIDENCE)
    return [r[0] for r in strong.orderBy(F.desc("strength"), "mark").limit(limit).select("mark").collect()]


def mine_voters(train: DataFrame, limit: int = MAX_VOTERS) -> list[str]:
    """Voters, by the evidence of given labels: all that labels are used for, but for the share of toxic texts."""
    toxic, rows = train.agg(F.sum(F.col("toxic").cast("double")), F.count("*")).first()
    return strongest(train, voters_of, lambda words, label: float(label), toxic or 0.0, (rows or 0) - (toxic or 0.0), limit)


UNKNOWN = -1


class LabelModel:
    """A generative model of binary voters given a hidden label, fitted by expectation maximisation.

    The given labels of some rows (SEEDS of them) are one more voter, of an accuracy that is estimated too; the labels of all other rows
    aren't seen. Each round estimates, over all rows, how often each voter votes for either label, and the correlation of each pair of
    voters given the label; a voter's evidence counts by one in the sum of its correlations, as copies of a voter add nothing.
    """

    def fit(self, votes: np.ndarray, seeds: np.ndarray, times: np.ndarray | None = None, rounds: int = 10) -> LabelModel:
        """seeds: the given label of each row, or UNKNOWN; times: how often each row occurs."""
        times = np.ones(len(votes)) if times is None else times.astype(np.float64)
        known = seeds != UNKNOWN
        posterior = np.where(seeds == 1, 0.95, 0.05)
        for step in range(rounds + 1):
            seen = times * known if step == 0 else times  # the first estimates are those of the seeds
            belief = np.stack((seen * (1 - posterior), seen * posterior))
            mass = belief.sum(axis=1)
            self.rate = ((belief @ votes) + 0.1) / (mass[:, None] + 0.2)
            self.prior = float(np.log((mass[1] + 1) / (mass[0] + 1)))
            agree = np.array([(belief[0] * (seeds == 0)).sum(), (belief[1] * (seeds == 1)).sum()])
            self.accuracy = np.clip((agree + 1) / ((belief * known).sum(axis=1) + 2), 0.5, 0.999)
            self.weights = 1 / np.maximum(*(self._correlations(votes, b, r).sum(axis=1) for b, r in zip(belief, self.rate, strict=True)))
            posterior = self.posterior_of(votes, seeds)
        self.posterior = posterior
        return self

    @staticmethod
    def _correlations(votes: np.ndarray, belief: np.ndarray, rate: np.ndarray) -> np.ndarray:
        """Correlations of the voters in one class, those under DEPENDENT or within the noise set to 0, a voter's own being 1."""
        joint = (votes * belief[:, None].astype(votes.dtype)).T @ votes
        mass = max(float(belief.sum()), 1.0)
        cov = joint / mass - np.outer(rate, rate)
        scale = np.sqrt(np.maximum(rate * (1 - rate), 1e-6))
        near = cov / scale[:, None] / scale[None, :]
        near[near < max(DEPENDENT, 3 / np.sqrt(mass))] = 0
        np.fill_diagonal(near, 1)
        return np.minimum(near, 1)

    def posterior_of(self, votes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        on, off, right = np.log(self.rate), np.log1p(-self.rate), self.accuracy
        slope = self.weights * (on[1] - on[0] - off[1] + off[0])
        given = np.where(seeds == 1, np.log(right[1] / (1 - right[0])), np.where(seeds == 0, np.log((1 - right[1]) / right[0]), 0.0))
        x = votes @ slope + float(self.weights @ (off[1] - off[0])) + given + self.prior
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, target: np.ndarray, times: np.ndarray, ridge: float = 0.05, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of binary features on soft targets by accelerated gradient descent, both labels weighing alike. times: how
    often each row occurs."""
    n, k = x.shape
    w, v = np.zeros(k + 1, np.float32), np.zeros(k + 1, np.float32)
    share = np.clip(float(times @ target / times.sum()), 1e-3, 1 - 1e-3)
    weight = (times * np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share)) / times.sum()).astype(np.float32)
    decay = np.append(np.full(k, ridge / max(k, 1)), 0.0).astype(np.float32)
    bound = np.float32(0.25 * float(weight @ (x.sum(axis=1) + 1)) + float(decay.max(initial=0.0)))
    target = target.astype(np.float32)
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:k] + v[k], -30, 30)))
        error = weight * (p - target)
        new = v - (np.append(error @ x, error.sum()) + decay * v) / bound
        v, w = (new + np.float32(step / (step + 3)) * (new - w)).astype(np.float32), new
    return w[:k], float(w[k])


def held_out(doc_id) -> object:
    """Rows that never lend a label: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class ToxicityModel:
    """Weights of features; score() of a text is the linear classifier's probability."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        whole = {v[1:]: w for v, w in self.weights.items() if v[0] == "="}
        starts = {v[1:] for v in self.weights if v[0] in "^#"}
        ends = {v[1:]: w for v, w in self.weights.items() if v[0] == "$"}
        weights = self.weights

        class Seen(dict):
            """The weight of a word itself, and the beginnings and endings that the model knows of it, found once for each word."""

            def __missing__(self, word):
                prefixes = tuple(word[:n] for n in PREFIXES if word[:n] in starts and len(word) >= n)
                endings = tuple(word[-n:] for n in ENDINGS if word[-n:] in ends and len(word) > n)
                if len(self) > 50_000:
                    self.clear()
                self[word] = found = (whole.get(word, 0.0), prefixes, endings) if word in whole or prefixes or endings else None
                return found

        seen = Seen()

        def score(text: str | None) -> float:
            found = [x for x in map(seen.__getitem__, words_of(text)) if x]
            counts = Counter(p for x in found for p in x[1])
            parts = [x[0] for x in found] + [weights.get("^" + p, 0.0) for p in counts] + [weights.get("#" + p, 0.0) for p, k in counts.items() if k >= SEVERAL]
            parts += [ends[e] for e in {e for x in found for e in x[2]}]
            x = self.bias + sum(sorted(parts))
            return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

        return score


def _gather(train: DataFrame, marks, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix of marks, seeds, times): rows of equal marks and seed are counted before they leave the executors."""
    place = {v: i for i, v in enumerate(names)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired = [sorted(place[v] for v in marks(words_of(t)) if v in place) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32())), batch.column(1)], names=["fired", "seed"])

    rows = train.select("text", "seed").transform(mapped, find, "fired array<int>, seed int").groupBy("fired", "seed").count().orderBy("fired", "seed").collect()
    matrix = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        matrix[i, r[0]] = 1
    return matrix, np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on about train_rows labelled rows that aren't held out; only voters, features and which rows have them reach the driver.

    Labels choose the voters; the label model sees the labels of SEEDS rows of 100, and the votes of all; the classifier's features are chosen by, and its weights are fitted to,
    the label model's posteriors, so that it learns words and endings that are no voters.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    total = known.count()
    if total > train_rows:
        cut = int(train_rows / total * (1 << 30))
        known = known.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < cut)
    # At most about train_rows rows of two numbers, whatever the corpus: a proven bound. The texts of these rows are read once.
    known = F.broadcast(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    shown = F.pmod(F.xxhash64(F.lit("seed"), "doc_id"), F.lit(100)) < SEEDS
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    train = materialise(rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.when(shown, F.col("toxic")).otherwise(UNKNOWN).cast("int").alias("seed")))
    names = mine_voters(train)
    if not names:
        return ToxicityModel({}, -2.0)
    votes, seeds, times = _gather(train, voters_of, names)
    model = LabelModel().fit(votes, seeds, times)
    mass = float(times @ model.posterior)
    place = {v: i for i, v in enumerate(names)}

    def belief(words: set[str], seed: int) -> float:
        row = np.zeros((1, len(place)), np.float32)
        row[0, [place[v] for v in voters_of(words) if v in place]] = 1
        return float(model.posterior_of(row, np.array([seed]))[0])

    judged = train.select("text", F.col("seed").alias("toxic"))
    features = strongest(judged, features_of, belief, mass, float(times.sum()) - mass, MAX_FEATURES)
    both = [*names, *(f for f in features if f not in place)]  # a row's votes give its posterior
    seen, seeds, times = _gather(train, features_of, both)
    target = model.posterior_of(seen[:, : len(names)], seeds)
    columns = [i for i, f in enumerate(both) if f in set(features)]
    if not columns:
        return ToxicityModel({}, -2.0)
    weights, bias = fit_linear(np.ascontiguousarray(seen[:, columns]), target, times)
    return ToxicityModel(dict(zip((both[i] for i in columns), map(float, weights), strict=True)), bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score and predicted to each row; null and empty texts get the score of a text without features, equal texts equal scores.

    Texts of any length are read whole; repeated rows each get their score; an empty table gives none. One pass without a shuffle; the model (at most MAX_FEATURES weights) goes with the tasks. Columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = np.array([score(t.as_py()) for t in batch.column(text)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.transform(mapped, run, schema)


def op6_weak_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
