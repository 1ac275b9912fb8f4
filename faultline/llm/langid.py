"""Language identification by interpolated Kneser-Ney character models.

One order-5 model per language is trained on a bounded sample of labelled rows.  A
text is a sequence of lower-cased letter runs, each scored from its start mark to
its end mark, so a word's log-likelihood depends on the word alone and is computed
once per distinct word of a batch.  All languages share sorted arrays of 64-bit
n-gram hashes, looked up by binary search.  The language with the lowest
cross-entropy per character wins; a text whose cross-entropy lies above the
calibrated limit of that language is flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.words import slices, span_hashes, window_hashes

ORDER = 5
START, END = 1, 2
UNKNOWN = "und"
#: About so many rows per language train the models, and so many calibrate them (a bound on what reaches the driver).
TRAINING_ROWS = 1500
CALIBRATION_ROWS = 400
#: Share of its own calibration texts that a language's limit accepts.
ACCEPTED = 0.995
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case code point for letters, 0 for everything else."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint32)
        for c in regex.findall(r"\p{L}", "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))):
            low = c.lower()
            table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
        _LETTERS.append(table)
    return _LETTERS[0]


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points, word starts, word ends, first word of each text)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    low = _letters()[points]
    inside = low > 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return low, start, end, np.searchsorted(start, offsets)


def _framed(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, depth, first): the words as START, letters, END one after another; depth is the place in the word."""
    lengths = end - start + 2
    first = np.concatenate([[0], np.cumsum(lengths)])
    depth = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
    source = np.repeat(start, lengths) + depth - 1
    symbols = points[np.clip(source, 0, len(points) - 1)].astype(np.uint64)
    symbols[first[:-1]] = START
    symbols[first[1:] - 1] = END
    return symbols, depth, first


def _gram_hashes(symbols: np.ndarray) -> list[np.ndarray]:
    """Per order k the hash of the k symbols that end at each place (places before k - 1 are not used)."""
    codes = symbols * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xA5A5A5A5)
    out = [np.zeros(len(symbols), np.uint64)]
    for k in range(1, ORDER + 1):
        h = np.zeros(len(symbols), np.uint64)
        if len(symbols) >= k:
            h[k - 1 :] = window_hashes(codes, k) + np.uint64(k)
        out.append(h)
    return out


@dataclass
class CharModels:
    """Sorted n-gram hashes with a column per language: discounted shares and back-off weights."""

    languages: list[str]
    alphabet: int = 1
    grams: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    limits: np.ndarray | None = None
    sharpness: float = 1.0

    def word_scores(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        symbols, depth, first = _framed(points, start, end)
        hashes = _gram_hashes(symbols)
        places = np.flatnonzero(depth > 0)
        own = np.choose(np.minimum(depth[places], ORDER - 1), [h[places] for h in hashes[1:]])
        _, rep, back = np.unique(own, return_index=True, return_inverse=True)
        at, deep = places[rep], depth[places[rep]]
        p = np.full((len(at), len(self.languages)), 1.0 / self.alphabet)
        for k in range(1, ORDER + 1):
            reach = deep >= k - 1
            share = _look_up(self.grams[k - 1], self.shares[k - 1], hashes[k][at], 0.0)
            weight = _look_up(self.contexts[k - 1], self.weights[k - 1], hashes[k - 1][at - 1], 1.0) if k > 1 else self.weights[0]
            p = np.where(reach[:, None], share + weight * p, p)
        logs = np.zeros((len(symbols), len(self.languages)))
        logs[places] = np.log(p)[back]
        return np.add.reduceat(logs, first[:-1], axis=0)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol and language, symbols) of each text; symbols is 0 without a letter."""
        points, start, end, first = letter_words(texts)
        total, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        if len(start) and self.languages:
            _, rep, back = np.unique(span_hashes(points, start, end), return_index=True, return_inverse=True)
            scores = self.word_scores(points, start[rep], end[rep])
            row = np.repeat(np.arange(len(texts)), np.diff(first))
            for k in range(len(self.languages)):
                total[:, k] = np.bincount(row, weights=scores[back, k], minlength=len(texts))
            size = np.bincount(row, weights=end - start + 1, minlength=len(texts)).astype(np.int64)
        return -total / np.maximum(size, 1)[:, None], size


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], missing)


def train(counts: dict[str, dict[str, int]]) -> CharModels:
    """Interpolated Kneser-Ney models from word counts per language.

    The highest order, and n-grams that begin with the start mark, use counts; other
    lower orders use the number of distinct symbols seen before the n-gram.
    """
    models = CharModels(sorted(counts))
    per_language = []
    symbols_seen: set[int] = set()
    for language in models.languages:
        words = [w for w in counts[language] if w]
        points, start, end, _ = letter_words([w + " " for w in words])
        symbols, depth, first = _framed(points, start, end)
        symbols_seen.update(np.unique(symbols).tolist())
        weight = np.repeat(np.array([counts[language][w] for w in words], np.float64), np.diff(first))
        hashes = _gram_hashes(symbols)
        tables = {}
        types = None  # the last k symbols of each n-gram of order k + 1
        for k in range(ORDER, 0, -1):
            here = np.flatnonzero(depth >= max(k - 1, 1))
            keys, rep, back = np.unique(hashes[k][here], return_index=True, return_inverse=True)
            rep = here[rep]
            number = np.bincount(back, weights=weight[here], minlength=len(keys))
            if types is not None:
                follow = np.zeros(len(keys))
                place = np.searchsorted(keys, types)
                np.add.at(follow, place, 1.0)
                number = np.where((depth[rep] >= k) & (follow > 0), follow, number)
            types = hashes[k - 1][rep] if k > 1 else None
            once, twice = np.sum(number == 1), np.sum(number == 2)
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = hashes[k - 1][rep - 1] if k > 1 else np.zeros(len(rep), np.uint64)
            groups, group = np.unique(context, return_inverse=True)
            sums = np.bincount(group, weights=number, minlength=len(groups))
            kinds = np.bincount(group, minlength=len(groups))
            tables[k] = keys, np.maximum(number - discount, 0) / sums[group], groups, np.minimum(1.0, np.minimum(discount, 1.0) * kinds / sums)
        per_language.append(tables)
    models.alphabet = max(1, len(symbols_seen)) + 1
    for k in range(1, ORDER + 1):
        for missing, keys_at, values_at, to_keys, to_values in ((0.0, 0, 1, models.grams, models.shares), (1.0, 2, 3, models.contexts, models.weights)):
            every = np.unique(np.concatenate([t[k][keys_at] for t in per_language])) if per_language else np.zeros(0, np.uint64)
            values = np.full((len(every), len(models.languages)), missing)
            for j, t in enumerate(per_language):
                values[np.searchsorted(every, t[k][keys_at]), j] = t[k][values_at]
            to_keys.append(every)
            to_values.append(values)
    return models


def calibrate(models: CharModels, entropies: np.ndarray, truth: np.ndarray) -> None:
    """Sets each language's limit and the sharpness of the score from held-back labelled texts.

    The limit is the ``ACCEPTED`` quantile of the cross-entropies of the language's own
    texts, widened by a tenth; the sharpness minimises the log loss of the posterior.
    """
    models.limits = np.full(len(models.languages), np.inf)
    for k in range(len(models.languages)):
        own = entropies[truth == k, k]
        if len(own):
            models.limits[k] = np.quantile(own, ACCEPTED) * 1.1
    if len(truth):
        grid = 2.0 ** np.arange(0, 9)
        losses = [-np.mean(np.log(np.maximum(_posteriors(entropies, t)[np.arange(len(truth)), truth], 1e-12))) for t in grid]
        models.sharpness = float(grid[int(np.argmin(losses))])


def _posteriors(entropies: np.ndarray, sharpness: float) -> np.ndarray:
    z = -sharpness * (entropies - entropies.min(axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        for language in sorted(set(languages)):
            points, start, end, _ = letter_words([t for t, x in zip(texts, languages, strict=True) if x == language])
            if len(start):
                _, rep, n = np.unique(span_hashes(points, start, end), return_index=True, return_counts=True)
                words = [points[s:e].tobytes().decode("utf-32-le") for s, e in zip(start[rep].tolist(), end[rep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(words)), pa.array(words), pa.array(n)], ["lang", "word", "n"])


def _score(models: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            entropies, size = models.value.entropies([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(entropies), pa.list_(pa.float64())), pa.array(size)], ["lang", "entropies", "symbols"])

    return run


def _predict(models: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: CharModels = models.value
        names = pa.array([*m.languages, UNKNOWN])
        for batch in batches:
            for part in slices([batch], batch.num_columns - 1):
                entropies, size = m.entropies([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                n = part.num_rows
                if m.languages:
                    best = np.argmin(entropies, axis=1)
                    lowest = entropies[np.arange(n), best]
                    score = np.where(size > 0, _posteriors(entropies, m.sharpness)[np.arange(n), best], 0.0)
                    rejected = (size == 0) | (lowest > m.limits[best])
                    best = np.where(size > 0, best, len(m.languages))
                else:
                    best, lowest, score, rejected = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], names.take(pa.array(best)), pa.array(score), pa.array(np.where(size > 0, lowest, np.nan), mask=size == 0), pa.array(rejected)],
                    [*part.schema.names[:-1], *RESULTS],
                )

    return run


RESULTS = ["lang_pred", "score", "cross_entropy", "rejected"]


def train_models(labelled: DataFrame, fold: Column, lang_col: str = "lang", text_col: str = "text") -> CharModels:
    """Models from rows with a language; rows where ``fold`` is true calibrate, the others train.

    Of each language the first ``TRAINING_ROWS`` and ``CALIBRATION_ROWS`` distinct texts
    in hash order are taken, whole; word counts are summed on the executors.  What
    reaches the driver is bounded by the sample, however often a text is repeated.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.coalesce(fold, F.lit(False)).alias("held"))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(7)))
    first = Window.partitionBy("lang", "held").orderBy("h")
    bound = F.when(F.col("held"), CALIBRATION_ROWS).otherwise(TRAINING_ROWS)
    ranked = rows.select("lang", "held", "h").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= max(TRAINING_ROWS, CALIBRATION_ROWS)).where(F.col("r") <= bound)
    limits = ranked.groupBy("lang", "held").agg(F.max("h").alias("h")).collect()  # two numbers a language

    def sample(held: bool) -> DataFrame:
        chosen = F.lit(False)
        for r in limits:
            if r["held"] == held:
                chosen = chosen | ((F.col("lang") == r["lang"]) & (F.col("h") <= r["h"]))
        return rows.where((F.col("held") == held) & chosen).dropDuplicates(["lang", "h"]).select("lang", "text")

    counts: dict[str, dict[str, int]] = {}
    summed = sample(False).mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for r in summed.toArrow().to_pylist():
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    models = train(counts)
    context = labelled.sparkSession.sparkContext
    scored = sample(True).mapInArrow(_score(context.broadcast(models)), "lang string, entropies array<double>, symbols long").where("symbols > 0").toArrow().to_pylist()
    place = {x: k for k, x in enumerate(models.languages)}
    known = [r for r in scored if r["lang"] in place]
    calibrate(models, np.array([r["entropies"] for r in known]).reshape(len(known), len(models.languages)), np.array([place[r["lang"]] for r in known], np.int64))
    return models


def identify(docs: DataFrame, models: CharModels, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred, score, cross_entropy, rejected``.

    Texts that are null or have no letter are ``und`` with score 0 and rejected; ties
    go to the first language by name; rows may repeat.  ``score`` is the posterior of
    the language found; ``rejected`` texts are like none of the languages.  Kept columns
    with the name of a result are left out.  Texts are taken in slices of at most 0.5 MB,
    a longer one by itself.
    """
    keep = [c for c in keep if c not in RESULTS]
    shared = docs.sparkSession.sparkContext.broadcast(models)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "lang_pred string, score double, cross_entropy double, rejected boolean"])
    return docs.select(*keep, text_col).mapInArrow(_predict(shared), schema)
