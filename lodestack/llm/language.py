"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.batches import released, text_pieces

#: Hashed n-gram features.
FEATURES = 1 << 15
#: Lengths of the character n-grams.
ORDERS = (1, 2, 3)
#: Expected rows of each language that the weights are fitted on; all rows give the document frequencies.
ROWS_PER_LANGUAGE = 900
#: Brings shares of a text times inverse document frequency near one.
SCALE = 25.0
#: Documents without a letter are of no language.
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Languages, weights scaled by inverse document frequency, biases and temperature."""

    languages: list[str]
    weights: np.ndarray  # FEATURES x languages
    bias: np.ndarray
    temperature: float


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of all texts end to end and where those of each text start.

    Texts count in lower case with a space at either end; an n-gram never
    crosses texts, so each position gives one feature of every order.
    """
    spaced = [f" {t.lower()} " for t in texts]
    size = np.array([len(t) for t in spaced], np.int64)
    points = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(points))  # characters to the end of the text
    out = np.empty((len(points), len(ORDERS)), np.int64)
    h = np.zeros(len(points), np.uint64)
    for k in range(max(ORDERS)):
        h[: len(points) - k] = h[: len(points) - k] * np.uint64(0x9E3779B97F4A7C15) + points[k:] + np.uint64(1)
        if k + 1 in ORDERS:
            f = h ^ (h >> np.uint64(29))
            f = (f * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)
            out[:, ORDERS.index(k + 1)] = np.where(left > k, f, 0).astype(np.int64)
    return out, np.r_[0, ends]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; over all rows."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for piece in text_pieces(batch):
                feats, at = features_of([t or "" for t in piece.column(0).to_pylist()])
                for a, b in zip(at[:-1], at[1:]):
                    mark = np.zeros(FEATURES, bool)
                    mark[feats[a:b].ravel()] = True
                    seen += mark
                n += len(at) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(FEATURES), -1]), pa.array(np.r_[seen, n])], ["feature", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out, total = np.zeros(FEATURES), 0
    for feature, n in counts.collect():  # FEATURES + 1 rows at most
        if feature < 0:
            total = int(n)
        else:
            out[feature] = n
    return out, total


def sampled_rows(docs: DataFrame, counts: dict[str, int], text_col: str, lang_col: str, per_language: int) -> list[tuple[np.ndarray, np.ndarray, int, str]]:
    """Features, how often each occurs, the length of the text, and the language of a bounded sample; six bytes a feature.

    A row is taken if a hash of its text falls below the share of its language's
    rows that is wanted, so about ``per_language`` of each are fetched; four
    times as many at most, should a taken text have very many copies.
    """
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    part = F.pmod(F.xxhash64(text_col, F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, lang, place in zip(*(c.to_pylist() for c in batch.columns)):
                feats, _ = features_of([text])
                found, n = np.unique(feats, return_counts=True)
                rows.append((found.astype(np.uint16).tobytes(), n.astype(np.uint32).tobytes(), feats.shape[0], lang, place))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["feature", "n", "size", "lang", "place"])

    taken = docs.where(part < share).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col, lang_col).alias("place"))
    got = taken.mapInArrow(run, "feature binary, n binary, size long, lang string, place long").orderBy("place", "lang").limit(4 * per_language * max(1, len(counts))).collect()
    return [(np.frombuffer(f, np.uint16), np.frombuffer(n, np.uint32), size, lang) for f, n, size, lang, _ in got]


def fit_ftrl(rows: list[tuple], classes: int, values=lambda r: r, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-2, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by follow-the-regularised-leader with L1 and L2 penalties.

    ``values`` makes each row (features, values, class) when its turn comes. Returns weights and biases; a weight
    whose accumulated gradient stays within the L1 penalty is exactly zero.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            feats, own, label = values(rows[i])
            at, x = np.r_[feats, FEATURES], np.r_[own, 1.0]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that makes the held-back labels most likely."""
    best, at = np.inf, 1.0
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 121)):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels])) if len(labels) else 0.0
        if loss < best - 1e-12:
            best, at = loss, float(t)
    return at


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fits a model on the rows of ``docs`` with a language; a fifth of the sample sets the temperature.

    Rows with a null text or language, or without a letter, are left out. With
    no usable row the model has no language and predicts ``und`` only.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(text_col, lang_col)
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    seen, total = document_frequencies(labelled, text_col)
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0
    rows = sampled_rows(labelled, counts, text_col, lang_col, per_language)
    values = lambda r: (r[0].astype(np.int64), r[1] / r[2] * idf[r[0]] * SCALE, languages.index(r[3]))
    held = [values(r) for r in rows[4::5]]
    w, b = fit_ftrl([r for i, r in enumerate(rows) if i % 5 != 4], len(languages), values)
    scores = np.array([x @ w[f] + b for f, x, _ in held]).reshape(len(held), len(languages))
    t = fit_temperature(scores, np.array([r[2] for r in held], np.int64))
    return Model(languages, w * idf[:, None] * SCALE, b, t)


def predictor(model: Model):
    """Function from texts to languages and calibrated scores."""
    table = np.ascontiguousarray(model.weights, np.float32)
    names = np.array([*model.languages, UNDETERMINED], dtype=object)

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
        label, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
        if known.any() and model.languages:
            feats, at = features_of([t for t, k in zip(texts, known) if k])
            sums = np.zeros((len(at) - 1, table.shape[1]))
            for k in range(feats.shape[1]):
                sums += np.add.reduceat(table[feats[:, k]], at[:-1], axis=0, dtype=np.float64)
            s = (sums / np.diff(at)[:, None] + model.bias) / model.temperature
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            label[known], score[known] = p.argmax(axis=1), p.max(axis=1)
        return names[label].tolist(), score.tolist()

    return predict


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1), from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0. Columns of
    the two names that ``docs`` has are replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = predictor(shared.value)
        for batch in batches:
            for piece in text_pieces(batch, text_col):
                lang, score = ask(piece.column(piece.schema.get_field_index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*piece.schema.names, lang_to, score_to])

    rows = docs.drop(lang_to, score_to)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{lang_to}` string, `{score_to}` double")


def held_out(id_col: str = "doc_id"):
    """True for the rows that a model is not fitted on: crc32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()))


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_on_documents(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
