"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic documents and documents without any label. The
unlabelled ones hold toxic ones too, so their loss as negatives is corrected by the
class prior: the risk is  p R(toxic as 1) + max(0, R(all as 0) - p R(toxic as 0)),
where the second part, an estimate of the clean documents' loss, may not fall below
zero; where a batch drives it there, the step goes back. Features are words and
their beginnings that stand out among the toxic documents.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import stored
from .common import lean, release, trimmed, uniform

# Bounds of the fitting sample: expected rows, drawn by a hash of doc_id, and features.
TOXIC_ROWS, UNLABELLED_ROWS, FEATURES = 5_000, 20_000, 5_000
# A feature stands out if its rate among toxic rows exceeds that among all by so many
# standard errors, and if by these rates and the prior most of its documents are toxic.
STANDS_OUT = 5.0
# Toxic rows that a feature needs: fewer agree by chance, there are so many words.
LEAST_TOXIC = 5
_WORD = re.compile(r"\w+")
_CACHED_WORDS = 200_000


def features_of(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings of four to six letters."""
    parts = [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]
    # Signed, as Spark's long has it.
    return [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts]


def words_of(text: bytes | None) -> set[str]:
    return set(_WORD.findall((text or b"").decode("utf-8", "replace").lower()))


def smallest_shingle(text: bytes | None) -> int:
    words = (text or b"").split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    return min(xxhash.xxh3_64_intdigest(s) for s in shingles) - (1 << 63)


@dataclass
class ToxicityModel:
    """Weights by feature hash; a text's score is the logistic of the bias and its features' weights."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -20.0
    prior: float = 0.0

    def scorer(self):
        known, cache = self.weights, {}

        def score(text: bytes | None) -> float:
            found = set()
            for word in words_of(text):
                hits = cache.get(word)
                if hits is None:
                    if len(cache) >= _CACHED_WORDS:
                        cache.clear()
                    hits = cache[word] = tuple(f for f in features_of(word) if f in known)
                if hits:
                    found.update(hits)
            z = self.bias + sum(known[f] for f in sorted(found))
            return 1 / (1 + np.exp(-max(-700.0, min(700.0, z))))

        return score

    def column(self, text: Column) -> Column:
        """The score of a text column, computed in batches; null is empty."""
        model = self

        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = model.scorer()
            for texts in batches:
                yield pd.Series([float(score(x)) for x in texts], dtype="float64")
            release()

        return F.pandas_udf(scores, "double")(text.cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_nnpu(
    toxic: list[list[int]],
    unlabelled: list[list[int]],
    features: int,
    prior: float,
    steps: int = 1500,
    batch: int = 250,
    rate: float = 0.05,
    decay: float = 1e-5,
    bias_decay: float = 1e-2,
    seed: int = 11,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier under the non-negative risk; rows are lists of feature numbers."""
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    start = w[-1] = np.log(prior / (1 - prior))

    def packed(rows, chosen):
        picked = [rows[i] for i in chosen]
        lengths = np.array([len(r) for r in picked])
        return np.repeat(np.arange(len(picked)), lengths), np.array([c for r in picked for c in r], np.int64)

    def margins(row, column, n):
        return np.bincount(row, w[column], n) + w[-1]

    def slopes(row, column, n, slope):
        return np.r_[np.bincount(column, slope[row], features), slope.sum()] / n

    # A batch needs enough toxic rows for its estimate of the clean loss to mean something.
    step, batches = 0, max(1, min(len(toxic) // batch, len(unlabelled)))
    cut = lambda n: np.array_split(rng.permutation(n), batches)
    while step < steps:
        for p, u in zip(cut(len(toxic)), cut(len(unlabelled))):
            pr, pc = packed(toxic, p)
            ur, uc = packed(unlabelled, u)
            pz, uz = margins(pr, pc, len(p)), margins(ur, uc, len(u))
            negative = np.logaddexp(0, uz).mean() - prior * np.logaddexp(0, pz).mean()
            sp, su = 1 / (1 + np.exp(-pz)), 1 / (1 + np.exp(-uz))
            clean = slopes(ur, uc, len(u), su) - prior * slopes(pr, pc, len(p), sp)
            # Below zero the estimate has overfitted: undo it instead of following it.
            gradient = prior * slopes(pr, pc, len(p), sp - 1) + clean if negative >= 0 else -clean
            gradient[:-1] += decay * w[:-1]
            # Where no feature speaks, the prior does.
            gradient[-1] += bias_decay * (w[-1] - start)
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    toxic_rows: int = TOXIC_ROWS,
    unlabelled_rows: int = UNLABELLED_ROWS,
    features: int = FEATURES,
    seed: int = 11,
) -> ToxicityModel:
    """A model from the labels of rows that are not held out and from unlabelled texts that are not held out.

    The prior is the rate of the label among those labelled rows. Fitting uses about
    ``toxic_rows`` toxic and ``unlabelled_rows`` unlabelled documents at any size of
    the tables, chosen by a hash of doc_id. Without toxic rows, or with toxic rows
    only, the model knows nothing and scores the prior.
    """
    known = (
        labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
        .where(~held_out(F.col("__id")) & F.col("__label").isNotNull() & F.col("__id").isNotNull())
        .groupBy("__id")
        .agg(F.max("__label").alias("__label"))
    )
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("__label"), F.lit(0))).first()
    prior = n_toxic / n_known if n_known else 0.0
    if not 0 < prior < 1:
        logit = 20.0 if prior == 1 else -20.0
        return ToxicityModel({}, logit, prior)
    rows = docs.count()
    chosen = known.where("__label = 1").where(uniform(seed, "__id") < toxic_rows / n_toxic).select("__id")
    body = lean(docs).select(F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("text")).where(
        ~held_out(F.col("__id"))
    )
    # Expected to hold ``toxic_rows`` ids, so it may be broadcast.
    toxic = body.join(F.broadcast(chosen), "__id", "left_semi").withColumn("toxic", F.lit(True))
    other = body.where(uniform(seed + 1, "__id") < unlabelled_rows / max(rows, 1)).withColumn("toxic", F.lit(False))
    # Near copies would make their own words stand out: the same smallest shingle counts once.
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(smallest_shingle).astype("int64")

    key = F.pandas_udf(keys, "long")
    both_kinds = toxic.unionByName(other).select("text", "toxic").withColumn("__key", key("text"))
    sample = stored(both_kinds.dropDuplicates(["__key", "toxic"]).drop("__key"), "toxicity-sample")

    def count(batches):
        for batch in batches:
            kinds = {True: [], False: []}
            for value, kind in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                kinds[kind] += {f for word in words_of(value) for f in features_of(word)}
            for kind, found in kinds.items():
                values, n = np.unique(np.array(found, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(n * kind), pa.array(n * (not kind))], ["feature", "p", "u"]
                )

    n_p, n_u = sample.agg(F.sum(F.col("toxic").cast("int")), F.sum((~F.col("toxic")).cast("int"))).first()
    if not n_p or not n_u:
        return ToxicityModel({}, float(np.log(prior / (1 - prior))), prior)
    rate_p, rate_u = F.col("p") / n_p, F.col("u") / n_u
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (rate_p - rate_u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    best = (
        sample.mapInArrow(trimmed(count), "feature bigint, p bigint, u bigint")
        .groupBy("feature")
        .agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        .where((F.col("p") >= LEAST_TOXIC) & (prior * rate_p > 0.5 * rate_u) & (both < 1))
        .where(z > STANDS_OUT)
        .orderBy(z.desc(), "feature")
        .limit(features)
        .select("feature")
    )
    index = {r[0]: i for i, r in enumerate(best.collect())}

    def found(batches):
        for batch in batches:
            lists = []
            for value in batch.column("text").to_pylist():
                hits = {index[f] for word in words_of(value) for f in features_of(word) if f in index}
                lists.append(sorted(hits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "hits"]
            )

    # The bounded sample as feature numbers: some hundred bytes a row.
    data = sample.mapInArrow(trimmed(found), "toxic boolean, hits array<int>").collect()
    data.sort(key=lambda r: (r["toxic"], r["hits"]))
    weights, bias = fit_nnpu(
        [r["hits"] for r in data if r["toxic"]], [r["hits"] for r in data if not r["toxic"]], len(index), prior
    )
    return ToxicityModel({f: float(weights[i]) for f, i in index.items()}, bias, prior)


def toxicity_scores(
    docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts have no features and the score of the bias. Other columns
    are ignored, repeated rows stay, an empty table gives an empty result.
    """
    scored = lean(docs).select(
        F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), model.column(F.col(text)).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The documents that the model does not call toxic, with all their columns."""
    return lean(docs).withColumn("__score", model.column(F.col(text))).where("__score < 0.5").select(*docs.columns)
