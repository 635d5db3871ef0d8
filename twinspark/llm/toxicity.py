"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed character n-grams it contains (presence, not counts). Each n-gram's weight in
the input is its log-count ratio r between toxic and other training documents, from counts over all of them; a
regularised logistic regression is then trained on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import full_text, kind_of, picked, positional, shared_root, ship, small_batches, stored

BITS = 18
SIZE = 1 << BITS
GRAMS = (3, 4, 5, 6)
#: The regression is fitted on at most this many labelled rows, the first by a hash of identifier and text. The
#: log-count ratios are counted over all labelled rows.
MAX_FIT_ROWS = 6_000
#: And of these on at most this many features in sum, so the driver's share stays under about 200 MB.
MAX_FIT_FEATURES = 4_000_000
#: Labels up to this many (some 10 MB) are broadcast to the documents.
MAX_BROADCAST_LABELS = 200_000
#: A ratio counts if the document shares of its n-gram in the two classes differ by this many standard errors or more;
#: a smaller difference is noise (5 is about one in 20 that any of SIZE equal ones passes). How many n-grams that leaves follows from the rows, there is no bound on it.
LEAST_ERRORS = 5.0
#: And if those shares are as 2 to 1 or more: among very many rows the smallest difference is no noise any more.
LEAST_SHARE = 2.0
PENALTY = 0.3


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of the whole text: A-Z lower-cased, white space and ASCII punctuation one space."""
    raw = np.frombuffer((" " + text + " ").encode("utf-32-le", "replace"), "<u4")
    marks = np.zeros(SIZE, bool)
    for at in range(0, len(raw), 1 << 20):
        code = raw[at : at + (1 << 20) + max(GRAMS)].astype(np.uint64)
        code = np.where((code >= 65) & (code <= 90), code + np.uint64(32), code)
        odd = (code < 48) | ((code > 57) & (code < 97)) | ((code > 122) & (code < 128))
        code = np.where(odd, np.uint64(32), code)
        code = code[np.append(True, ~(odd[1:] & odd[:-1]))]  # runs count once
        hashes = np.zeros(len(code), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(code) < n:
                break
            hashes = (hashes[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
            if n in GRAMS:
                marks[((hashes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(marks).astype(np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the features))). fitted: whether both classes were there."""

    weights: np.ndarray
    bias: float
    fitted: bool = True

    def score(self, text: str | None) -> float:
        found = features(text or "")
        z = self.bias + float(self.weights[found].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def ratios_of(counts: np.ndarray, docs: np.ndarray, least: float = LEAST_ERRORS) -> np.ndarray:
    """The log-count ratio of each bucket, zero where the classes' document shares differ by under `least` standard
    errors or LEAST_SHARE times. counts: shape (2, SIZE), documents of each class that have the bucket; docs: documents of each class."""
    share = (counts + 0.5) / (docs[:, None] + 1)
    pooled = (counts.sum(axis=0) + 0.5) / (docs.sum() + 1)
    errors = np.abs(share[1] - share[0]) / np.sqrt(pooled * (1 - pooled).clip(1e-9) * (1 / docs[0] + 1 / docs[1]))
    smooth = counts + 1
    telling = (errors >= least) & (share.max(axis=0) >= LEAST_SHARE * share.min(axis=0))
    return np.where(telling, np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum()), 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY, steps: int = 200) -> Model:
    """Full-batch Adam on the log loss with an L2 penalty; deterministic. ratios: zero for buckets that are not used."""
    rows = [r[ratios[r] != 0] for r in rows]
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, flat = np.unique(flat, return_inverse=True)
    value = ratios[used][flat]
    w, bias, n = np.zeros(len(used)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))), len(rows)
    m, v, rate = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0.02
    for step in range(1, steps + 1):
        z = bias + np.bincount(owner, value * w[flat], n)
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        g = np.append(np.bincount(flat, value * error[owner], len(used)) / n + penalty / n * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    weights = np.zeros(SIZE, np.float64)
    weights[used] = w * ratios[used]
    return Model(weights, bias)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_fit_rows: int = MAX_FIT_ROWS, max_fit_features: int = MAX_FIT_FEATURES) -> Model:
    """From labelled rows; rows whose label is not 0 or 1 are left out, null text counts as empty.

    Without rows, or with one class only, the model is not fitted: it scores every text alike, by the smoothed share of
    label 1 (1/3 without rows), and drop_toxic drops nothing by it."""
    spark = labelled.sparkSession
    ship(spark)
    rows = picked(labelled, id=id_col, text=text_col, label=label_col).where("label in (0, 1)")
    rows = rows.select(F.xxhash64(F.col("id").cast("string"), full_text()).alias("order"), full_text().alias("text"), F.col("label").cast("int").alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                counts[label, features(text.as_py())] += 1
                docs[label] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), *(pa.array(np.append(counts[i, used], docs[i])) for i in (0, 1))], names=["bucket", "n0", "n1"])

    table = rows.select("text", "label").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most SIZE + 1 rows
    counts = np.zeros((2, SIZE + 1))
    counts[:, table.column("bucket").to_numpy()] = [table.column("n0").to_numpy(), table.column("n1").to_numpy()]
    totals = counts[:, SIZE]
    if totals.min() == 0:
        return Model(np.zeros(SIZE), float(np.log((totals[1] + 0.5) / (totals[0] + 1))), False)
    ratios = ratios_of(counts[:, :SIZE], totals)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x := features(t.as_py()))[ratios[x] != 0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["order", "label", "size", "found"])

    last = rows.select("order").orderBy("order").limit(max_fit_rows).agg(F.max("order")).first()[0]
    sample = stored(rows.where(F.col("order") <= last).mapInArrow(extract, "order long, label int, size long, found array<int>"), f"{shared_root(spark)}/sample")
    sizes = sample.select("order", "size").orderBy("order").limit(max_fit_rows).toArrow()
    order, ends = sizes.column("order").to_numpy(), np.cumsum(sizes.column("size").to_numpy())
    most = max(1, int(np.searchsorted(ends, max_fit_features, "right")))
    # Ties are rows that repeat both identifier and text; the limit holds for them too.
    table = sample.where(F.col("order") <= int(order[most - 1])).orderBy("order", "label").limit(most).select("label", "found").toArrow()
    return fit([x.values.to_numpy() for x in table.column("found")], table.column("label").to_numpy().astype(float), ratios)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) for each row of docs, from its whole text; null text counts as empty. Other columns are not read."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias))  # SIZE numbers
    rows = picked(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shipped.value.score(t.as_py()) for t in batch.column("text")], pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {kind_of(rows, 'id')}, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows never learnt from: crc32 of the identifier as text, mod 5, is 0; a null identifier is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_broadcast_labels: int = MAX_BROADCAST_LABELS) -> Model:
    """Trains on the documents that have a label and are not held out. A document labelled twice counts once a label.

    Within the bound labels are broadcast and texts stay where they are; beyond it both are joined by a shuffle, once."""
    wanted = picked(labels, id=id_col, label=label_col).where(~held_out("id")).distinct()
    texts = picked(docs, id=id_col, text=text_col)
    few = wanted.limit(max_broadcast_labels + 1).count() <= max_broadcast_labels
    labelled = texts.join(F.broadcast(wanted), "id") if few else stored(texts.join(wanted, "id"), f"{shared_root(docs.sparkSession)}/labelled")
    return train(labelled, "text", "label", "id")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score under the threshold, with their own columns, whatever these are called.

    Null text counts as empty and repeated rows are judged alike. Where no model can be fitted (no usable labels, or
    one class only) no row goes; an empty table stays empty."""
    model = train_on_labels(docs, labels, id_col, text_col)
    if not model.fitted:
        return docs
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias))
    rows, (text,) = positional(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            yield batch.filter(pa.array([shipped.value.score(t.as_py()) < threshold for t in batch.column(text)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
