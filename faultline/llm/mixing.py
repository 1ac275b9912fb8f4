"""Mixing documents to target domain weights with soft memberships.

A classifier trained on a labelled table gives every document posteriors over the
domains.  The rate of each document (how often it is to be seen) is found by
projected gradient least squares: the expected token total of every domain, the sum
of rate x tokens x posterior, is to match its target, and rates stay near one and
nonnegative.  Each domain's squared error is weighed by the tokens it had before.  In
that measure a step of length one never overshoots, whatever the shares of the
domains, since the posteriors of a document add up to one.

A step needs only the residual of the totals, one number per domain, so each
iteration is one narrow pass over a thin table; a document's rate is recomputed from
the residuals so far, and nothing per document reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import stored
from faultline.llm.words import is_space, lower_ascii, mix, slices, string_buffers, word_bounds, word_hashes

#: Hashed features: distinct words, and bands of a text's length, symbol share and share of repeated words.
FEATURES = 1 << 16
#: No more labelled rows than these train the classifier: the first ones in hash order.
TRAINING_ROWS = 6000
#: Features that the classifier uses.
CHOSEN = 2048
MAX_STEPS = 200
#: Pull of every rate towards one, against the squared error of the domain totals.
STIFFNESS = 0.002
#: The totals have settled when they move by less than this share of what the domain had.
SETTLED = 1e-4


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, offsets, words) of each text: its distinct words and its bands."""
    data, offsets = string_buffers(column)
    start, end, first = word_bounds(data, offsets)
    words = word_hashes(lower_ascii(data), start, end)
    count = np.diff(first)
    n = len(count)
    row = np.repeat(np.arange(n), count)
    key = np.unique(row * FEATURES + (words % np.uint64(FEATURES)).astype(np.int64))
    distinct = np.bincount(key // FEATURES, minlength=n)
    odd = ((data < 128) & ~is_space(data) & ~((data | 32) - 97 < 26) & ~(data - 48 < 10)).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(odd)])
    symbols = sums[offsets[1:]] - sums[offsets[:-1]]
    size = np.maximum(np.diff(offsets), 1)
    bands = np.stack([np.minimum(np.log2(count + 1), 15).astype(np.int64), np.minimum(symbols * 50 // size, 15), np.minimum(distinct * 16 // np.maximum(count, 1), 15)], axis=1)
    band_slot = (mix((bands + np.arange(3) * 16 + 1).astype(np.uint64)) % np.uint64(FEATURES)).astype(np.int64)
    rows = np.concatenate([key // FEATURES, np.repeat(np.arange(n), 3)])
    ids = np.concatenate([key % FEATURES, band_slot.ravel()])
    order = np.argsort(rows, kind="stable")
    return ids[order], np.searchsorted(rows[order], np.arange(n + 1)), count


@dataclass
class DomainClassifier:
    """Multinomial logistic regression over the hashed features that tell the domains apart."""

    domains: list[str]
    column: np.ndarray  # of each feature id, -1 for those not used
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, at = np.repeat(np.arange(n), np.diff(offsets)), self.column[ids]
        row, at = row[at >= 0], at[at >= 0]
        return _softmax(np.stack([np.bincount(row, weights=self.weights[at, k], minlength=n) for k in range(len(self.bias))], axis=1) + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(ids: np.ndarray, offsets: np.ndarray, labels: np.ndarray, domains: list[str], steps: int = 500, decay: float = 1e-5, rate: float = 0.3) -> DomainClassifier:
    """Full-batch AdaGrad on the log loss, from zero, so the result depends on the rows alone.

    The features used are the ``CHOSEN`` whose share in some domain departs most from their share in all rows, in standard errors.
    """
    n, k = len(offsets) - 1, len(domains)
    model = DomainClassifier(domains, np.full(FEATURES, -1, np.int32), np.zeros((0, k)), np.zeros(k))
    if not n:
        return model
    row = np.repeat(np.arange(n), np.diff(offsets))
    seen, size = np.zeros((FEATURES, k)), np.bincount(labels, minlength=k)
    np.add.at(seen, (ids, labels[row]), 1)
    share = seen.sum(axis=1, keepdims=True) / n
    gap = (np.abs(seen - size * share) / np.sqrt(size * share * (1 - share) + 1)).max(axis=1)
    used = np.sort(np.argsort(-gap, kind="stable")[:CHOSEN])
    used = used[share[used, 0] > 0]
    model.column[used] = np.arange(len(used))
    x = np.zeros((n, len(used)), np.float32)
    at = model.column[ids]
    x[row[at >= 0], at[at >= 0]] = 1
    truth = np.eye(k, dtype=np.float32)[labels]
    weights, bias = np.zeros((len(used), k), np.float32), np.log((size + 1) / (n + k)).astype(np.float32)
    past, past_bias = np.full(weights.shape, 1e-8, np.float32), np.full(k, 1e-8, np.float32)
    for _ in range(steps):
        error = (_softmax(x @ weights + bias) - truth) / n
        grad, push = x.T @ error + decay * weights, error.sum(axis=0)
        past += grad**2
        past_bias += push**2
        weights -= rate * grad / np.sqrt(past)
        bias -= rate * push / np.sqrt(past_bias)
    model.weights, model.bias = weights.astype(float), bias.astype(float)
    return model


def _labelled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        ids, offsets, _ = features(batch.column(2))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["h", "domain", "ids"])


def train_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DomainClassifier:
    """The classifier of ``labelled`` (id, domain), from the ``TRAINING_ROWS`` first of its documents in hash order.

    An id with several domains counts for the first by name.
    """
    one = labelled.where(F.col("domain").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col("domain").cast("string")).alias("domain"))
    drawn = one.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(TRAINING_ROWS)
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.join(F.broadcast(drawn), F.col(id_col) == F.col("_id")).select(F.xxhash64("_id", text).alias("h"), "domain", text.alias("text"))  # TRAINING_ROWS rows
    found = rows.mapInArrow(_labelled_features, "h long, domain string, ids array<int>")
    table = found.orderBy("h", "domain").limit(TRAINING_ROWS).toArrow()  # an id may have many rows
    domains = sorted(set(table.column("domain").to_pylist())) or ["all"]
    lists = table.column("ids").combine_chunks()
    labels = np.array([domains.index(d) for d in table.column("domain").to_pylist()], np.int64)
    return fit(lists.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64), labels, domains)


def _describe(model: Broadcast, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_at):
            ids, offsets, words = features(part.column(text_at))
            p = model.value.posteriors(ids, offsets)
            k = p.shape[1]
            posteriors = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:text_at], pa.array(words.astype(np.int64)), posteriors], [*part.schema.names[:text_at], "n_tokens", "posteriors"])

    return run


def _rates(p: np.ndarray, history: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, look-ahead rates) after the steps of ``history``: (momentum, residual) each."""
    rate = ahead = np.ones(len(p))
    for momentum, residual in history:
        after = np.maximum(0.0, ahead - (p @ residual + STIFFNESS * (ahead - 1)) / (1 + STIFFNESS))
        ahead = after + momentum * (after - rate)
        rate = after
    return rate, ahead


def _totals(history: list[tuple[float, np.ndarray]]):
    """Once for a partition: expected tokens of each domain under the rates and the look-ahead rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                tokens = batch.column(0).to_numpy()
                p = batch.column(1).flatten().to_numpy().reshape(len(tokens), -1)
                total = total + np.stack([tokens * r for r in _rates(p, history)]) @ p
        if np.ndim(total):
            k = pa.array(np.arange(total.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([k, pa.array(total[0]), pa.array(total[1])], ["domain", "now", "ahead"])

    return run


def _apply(history: list[tuple[float, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posteriors").flatten().to_numpy().reshape(batch.num_rows, -1)
            rate, _ = _rates(p, history)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    return run


@dataclass
class Mixture:
    """What a fit came to: the domains, their targets, and expected tokens before and after."""

    domains: list[str]
    targets: np.ndarray
    before: np.ndarray
    after: np.ndarray
    steps: int


def solve(described: DataFrame, domains: list[str], weights: dict[str, float], anchor: str | None = None, margin: float = 0.0) -> tuple[list, Mixture]:
    """The steps of projected gradient descent, accelerated, until the totals settle; raises if they don't.

    Targets are the weights times the budget.  The budget is the tokens there are, or
    with ``anchor`` the size at which that domain is on target with 1 + ``margin`` times
    the tokens it has, so that its documents keep a rate of about that.  Domains without
    tokens can't be steered.
    """
    thin = described.select("n_tokens", "posteriors")
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    share = share / share.sum() if share.sum() > 0 else np.full(len(domains), 1 / len(domains))

    def totals(history: list) -> tuple[np.ndarray, np.ndarray]:
        rows = thin.mapInArrow(_totals(history), "domain int, now double, ahead double").groupBy("domain").agg(F.sum("now").alias("now"), F.sum("ahead").alias("ahead")).collect()  # one row a domain
        out = np.zeros((2, len(domains)))
        for r in rows:
            out[:, r["domain"]] = r["now"], r["ahead"]
        return out[0], out[1]

    before, ahead = totals([])
    budget = before.sum()
    if anchor in domains and share[domains.index(anchor)] > 0:
        budget = (1 + margin) * before[domains.index(anchor)] / share[domains.index(anchor)]
    if budget <= 0:
        return [], Mixture(domains, share * budget, before, before, 0)
    scale = np.where(before > 0, before, np.inf)
    history: list[tuple[float, np.ndarray]] = []
    now, speed = before, 1.0
    for _ in range(MAX_STEPS):
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        history.append(((speed - 1) / faster, (ahead - share * budget) / scale))
        last, (now, ahead) = now, totals(history)
        moved = np.abs(now - last) / scale
        if moved.max() < SETTLED and np.abs(ahead - now).max() <= SETTLED * max(1.0, before.max()):
            return history, Mixture(domains, share * budget, before, now, len(history))
        # A step that leads away from the targets starts the momentum anew.
        speed = 1.0 if ((now - share * budget) ** 2 / scale).sum() > ((last - share * budget) ** 2 / scale).sum() else faster
    raise RuntimeError(f"rates did not settle in {MAX_STEPS} steps")


def mix_sources(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, margin: float = 0.0) -> tuple[DataFrame, Mixture]:
    """(all columns of ``docs`` (the text only with ``keep_text``) with the row's ``row_key``, ``n_tokens, posteriors, rate, copies``; the fit).

    ``labelled`` has (id, domain); domains without a weight get zero.  Tokens are words.
    ``copies`` is the rate rounded up or down at random by a hash of the row, so that the
    expected number of copies is the rate.  Targets that no nonnegative rates reach are
    missed; the fit has the targets and what came of them.  Null and empty texts have no
    tokens, so they only follow the rate of their posteriors; repeated rows get equal
    rates and copies; without labels there is one domain.  Texts are taken in slices of at
    most 2 MB, a longer one by itself.  Columns of ``docs`` with the name of a result are
    replaced.
    """
    docs = docs.drop("row_key", "n_tokens", "posteriors", "rate", "copies")
    model = train_classifier(docs, labelled, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if keep_text or c != text_col]
    keyed = docs.select(*rest, F.xxhash64(F.col(id_col), text).alias("row_key"), text.alias("n_tokens"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    described = stored(keyed.mapInArrow(_describe(shared, len(fields)), ", ".join([*fields, "n_tokens long, posteriors array<double>"])), "posteriors")
    history, mixture = solve(described, model.domains, weights, anchor, margin)
    rated = described.mapInArrow(_apply(history), ", ".join([*fields, "n_tokens long, posteriors array<double>, rate double"]))
    drawn = F.pmod(F.xxhash64("row_key", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + drawn).cast("int")), mixture
