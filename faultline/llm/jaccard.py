"""Exact Jaccard self-join of documents on word n-grams, by vertical partitioning.

A global order of all n-grams is fixed first: rare ones first, by the frequency that
their words' counts let expect, n-grams that stand out by their own count last, hash
order else.  The counts come from counters of fixed size over all documents, so the
order is the same everywhere and small enough to broadcast.  Two sets that are
similar enough share l n-grams in their prefixes (the first n - ceil(t n) + l), with
l = 1 + n / 20 of the smaller set; so long texts with a few common phrases never meet.
If they are of like size they share more: what the overlap must be, less what is left
of a set behind its prefix.  A set that shares too few prefix n-grams with all others
together is left out before it is shuffled; n-grams that the same sets hold count as one
row with a weight; and a sketch of parities bounds how far two sets differ.

The order is cut into fragments.  For a candidate pair the overlap is counted in
each fragment by itself, from the fragment's piece of either set, and summed.

Equal sets count as one node.  Links are found in two passes.  In the first, each
set is compared with two hubs, the holders it meets in most prefix n-grams, which
joins groups of near copies without forming their pairs; components follow.  In the
second, every pair that shares enough prefix n-grams across two components is
compared, so no link between different components is missed, and links inside one
can't change it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.components import connected_components
from faultline.llm.shared import discard, stored
from faultline.llm.sketches import bitmap, in_bitmap, repeated_bitmap, spread_hashes
from faultline.llm.words import lower_ascii, mix, slices, string_buffers, window_hashes, word_bounds, word_hashes

SHINGLE = 5
THRESHOLD = (75, 100)
COUNTERS = 1 << 18
COUNTER_BLOCKS = 48
#: Prefixes are longer by one n-gram in so many, and links share that many more in them.
EXTRA = 20
WORD_COUNTERS = 1 << 19
#: A token is a 56-bit hash below its rank: six bits of expected frequency, all set for n-grams that stand out.
HASH_BITS, RANK_BITS = 56, 6
STANDS_OUT = (1 << RANK_BITS) - 1
#: Counters of so many partitions are summed in a task before the sums meet.
SUMMED_TOGETHER = 256
#: Longs of a set's sketch; each bit tells whether an odd number of its tokens fall on it.
SKETCH = 8


class Order:
    """The global order: log counts of words by counter, and the n-gram counters that stand out."""

    def __init__(self, words: np.ndarray, grams: np.ndarray):
        self.logs = np.log2(words + 1.0).astype(np.float32)
        self.total = float(np.log2(words.sum() + 1.0))
        mean = grams.mean()
        self.standing_out = grams > mean + 8 * math.sqrt(mean) + 64

    def rank(self, tokens: np.ndarray, expected: np.ndarray) -> np.ndarray:
        ranks = np.clip(expected + 32, 0, STANDS_OUT - 1).astype(np.uint64)
        ranks[self.standing_out[_counter(tokens)]] = STANDS_OUT
        return ranks


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def _word_counter(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(WORD_COUNTERS - 1)).astype(np.int64)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_buffers(column)
    start, end, first = word_bounds(data, offsets)
    return word_hashes(lower_ascii(data), start, end), first


def _sets(words: np.ndarray, first: np.ndarray, size: int, order: Order | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): each row's distinct n-grams in the global order, one row after another."""
    counts = np.diff(first)
    grams = window_hashes(words, size)
    row = np.repeat(np.arange(len(counts)), counts)
    valid = row[: len(grams)] == row[size - 1 :] if len(grams) else np.zeros(0, bool)
    tokens, rows = grams[valid], row[: len(grams)][valid]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        whole = np.array([window_hashes(words[first[r] : first[r + 1]], int(counts[r]))[0] for r in few], np.uint64)
        tokens, rows = np.concatenate([tokens, mix(whole + counts[few].astype(np.uint64))]), np.concatenate([rows, few])
    tokens = tokens >> np.uint64(64 - HASH_BITS)
    if order is not None:
        logs = np.concatenate([[0.0], np.cumsum(order.logs[_word_counter(words)], dtype=np.float64)])
        expected = (logs[size:] - logs[:-size])[: len(grams)][valid] - (size - 1) * order.total if len(grams) else np.zeros(0)
        if len(few):
            expected = np.concatenate([expected, logs[first[few + 1]] - logs[first[few]] - (counts[few] - 1) * order.total])
        tokens = tokens | order.rank(tokens, np.round(expected)) << np.uint64(HASH_BITS)
    by = np.lexsort((tokens, rows))
    tokens, rows = tokens[by], rows[by]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
    tokens, rows = tokens[fresh], rows[fresh]
    return tokens, np.searchsorted(rows, np.arange(len(counts) + 1))


def _set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 62-bit hash of each set, from sums that don't depend on the order of its tokens."""
    tokens = tokens & np.uint64((1 << HASH_BITS) - 1)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens + np.uint64(77)), out=sums[1:])
    n = np.diff(offsets).astype(np.uint64)
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + n) >> np.uint64(2)


def _prefix_lengths(n: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    up, down = threshold
    return np.where(n > 0, n - -(-n * up // down) + 1 + n // EXTRA, 0)


def _left_behind(n: Column, threshold: tuple[int, int]) -> Column:
    """How many tokens of a set of n lie behind its prefix."""
    up, down = threshold
    return F.ceil(n * up / down) - 1 - F.floor(n / EXTRA)


def _describe(size: int):
    """Rows (key, id, n, sid) of documents, and at the end of a partition its counters in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS + WORD_COUNTERS, np.int64)
        names = ["key", "id", "n", "sid", "part", "block", "counts"]
        for batch in slices(batches, 2):
            words, first = _words(batch.column(2))
            tokens, offsets = _sets(words, first, size)
            np.add.at(counters, _counter(tokens), 1)
            np.add.at(counters, COUNTERS + _word_counter(words), 1)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(_set_ids(tokens, offsets).view(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        pieces = counters.reshape(COUNTER_BLOCKS, -1)
        none = [pa.nulls(COUNTER_BLOCKS, pa.int64())] * 4
        part = pa.array(np.full(COUNTER_BLOCKS, TaskContext.get().partitionId() % SUMMED_TOGETHER, np.int32))
        yield pa.RecordBatch.from_arrays([*none, part, pa.array(np.arange(COUNTER_BLOCKS, dtype=np.int32)), pa.array([_packed(p) for p in pieces], pa.binary())], names)

    return run


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((COUNTERS + WORD_COUNTERS) // COUNTER_BLOCKS, np.int64)
    for c in group["counts"]:
        total += np.frombuffer(zlib.decompress(c), np.int64)
    return pd.DataFrame({"block": group["block"].iloc[:1].to_numpy(), "counts": [_packed(total)]})


def _global_order(described: DataFrame) -> Order:
    """Sums the counters of all partitions, block by block and in two steps."""
    blocks = described.where("block is not null").select("part", "block", "counts")
    some = blocks.groupBy("block", "part").applyInPandas(_add, "block int, counts binary")
    rows = some.groupBy("block").applyInPandas(_add, "block int, counts binary").collect()  # a fixed number of counters
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in sorted(rows, key=lambda r: r["block"])])
    return Order(counts[COUNTERS:], counts[:COUNTERS])


def _count_prefixes(size: int, threshold: tuple[int, int], order: Broadcast, chosen: Broadcast, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes():
            for batch in slices(_of(batches, chosen), 1):
                tokens, offsets = _sets(*_words(batch.column(1)), size, order.value)
                yield mix(tokens[_in_prefix(offsets, threshold)])

        yield from spread_hashes(hashes(), buckets)

    return run


def _of(batches: Iterator[pa.RecordBatch], chosen: Broadcast) -> Iterator[pa.RecordBatch]:
    """The rows whose key (the first column) may be chosen."""
    flags = np.frombuffer(chosen.value, np.uint8)
    for batch in batches:
        yield batch.filter(pa.array(in_bitmap(flags, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))


def _in_prefix(offsets: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    n = np.diff(offsets)
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], n) < np.repeat(_prefix_lengths(n, threshold), n)


def _prefix_rows(size: int, threshold: tuple[int, int], order: Broadcast, chosen: Broadcast, repeated: Broadcast):
    """Rows (t, sid, n, pos, sketch) of the prefix tokens that some other set may hold too, for sets with enough of them to link.

    A set's sketch comes with the first of its rows.
    """
    up, down = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(repeated.value, np.uint8)
        for batch in slices(_of(batches, chosen), 1):
            tokens, offsets = _sets(*_words(batch.column(1)), size, order.value)
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            at = np.flatnonzero(_in_prefix(offsets, threshold))
            at = at[in_bitmap(flags, mix(tokens[at]))]
            enough = np.bincount(row[at], minlength=len(n)) >= 1 + -(-n * up // down) // EXTRA
            at = at[enough[row[at]]]
            r = row[at]
            sids = _set_ids(tokens, offsets)
            pos = at - offsets[r]
            late = np.zeros(len(r), bool)
            late[1:] = r[1:] == r[:-1]
            sketch = _sketches(tokens, row, len(n))[r]
            words = [pa.array(sketch[:, k], mask=late) for k in range(SKETCH)]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(sids[r].view(np.int64)), pa.array(n[r].astype(np.int32)), pa.array(pos.astype(np.int32)), *words], ["t", "sid", "n", "pos", *_SKETCH])

    return run


_SKETCH = [f"s{k}" for k in range(SKETCH)]


def _sketches(tokens: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """The parities of each row's tokens, ``SKETCH`` longs a row."""
    place = mix(tokens & np.uint64((1 << HASH_BITS) - 1)) % np.uint64(64 * SKETCH)
    out = np.zeros(n_rows * SKETCH, np.uint64)
    np.bitwise_xor.at(out, row * SKETCH + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64).reshape(n_rows, SKETCH)


def _fragment_rows(size: int, order: Broadcast, chosen: Broadcast):
    """Rows (sid, fragment, tokens) of the sets that take part in a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_of(batches, chosen), 1):
            tokens, offsets = _sets(*_words(batch.column(1)), size, order.value)
            sids = _set_ids(tokens, offsets)
            row = np.repeat(np.arange(len(sids)), np.diff(offsets))
            piece = (tokens >> np.uint64(HASH_BITS + RANK_BITS - 3)).astype(np.int64)
            cut = np.ones(len(tokens), bool)
            cut[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
            head = np.flatnonzero(cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sids[row[head]].view(np.int64)), pa.array(piece[head].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(head, len(tokens)).astype(np.int32)), pa.array(tokens.view(np.int64)))],
                ["sid", "fragment", "tokens"],
            )

    return run


class JaccardJoin:
    """The join of ``docs`` with itself on sets of ``size``-word n-grams of lower-cased (A-Z) words.

    Rows with fewer words have one n-gram, the whole sequence; null, empty and
    wordless texts have an empty set and link with nothing.  Two rows link when
    100 * overlap >= threshold * union, exactly up to collisions of 56-bit hashes of
    n-grams and 62-bit hashes of sets.  Repeated rows link like any equal texts; extra
    columns are not read.  Texts are taken in slices of at most 0.5 MB; a longer text is a
    slice by itself, so that the longest text bounds a worker's memory.

    ``links`` returns the pairs of distinct sets that link, ``n_links`` and ``membership``
    a row per document.
    """

    def __init__(self, docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"):
        self.size, self.threshold = size, threshold
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.rows = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
        described = stored(self.rows.mapInArrow(_describe(size), "key long, id long, n long, sid long, part int, block int, counts binary"), "sets")
        #: (key, id, n, sid): each row's set.
        self.sets = described.where("block is null").select("key", "id", "n", "sid")
        context = docs.sparkSession.sparkContext
        self.order = context.broadcast(_global_order(described))
        self.texts = self.rows.select("key", "text")
        #: (sid, key): one row of each set.
        self.first = self.sets.where("n > 0").groupBy("sid").agg(F.min("key").alias("key"))
        chosen = bitmap(self.first, "key", 26)
        up, down = threshold
        n_tokens = self.sets.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * up / down) + 1 + F.floor(F.col("n") / EXTRA)), F.lit(0))).first()[0]
        repeated = repeated_bitmap(lambda buckets: self.texts.mapInArrow(_count_prefixes(size, threshold, self.order, chosen, buckets), "bucket int, hashes binary"), n_tokens)
        found = self.texts.mapInArrow(_prefix_rows(size, threshold, self.order, chosen, repeated), "t long, sid long, n int, pos int, " + ", ".join(f"{w} long" for w in _SKETCH))
        found = stored(found, "found")
        # The sum tells sets apart that were read from two rows, which the exclusive or cancels.
        who = [F.bit_xor(F.xxhash64("sid")).alias("_who"), F.sum(F.xxhash64("sid").bitwiseAND((1 << 36) - 1)).alias("_sum")]
        holders = found.groupBy("t").agg(F.count(F.lit(1)).alias("c"), *who).where("c >= 2")
        # The row with a set's sketch stays even if no other set holds its token: the bitmap lets such tokens pass by chance.
        held = found.join(holders, "t", "left").where("c is not null or s0 is not null").withColumn("g", F.xxhash64("c", "_who", "_sum"))
        held = held.withColumn("_twin", F.row_number().over(Window.partitionBy("sid", "t").orderBy(F.col("s0").asc_nulls_last()))).where("_twin = 1")  # a set may have been read from two rows
        whole = Window.partitionBy("sid")  # no more rows than the longest prefix
        held = held.withColumns(
            {
                "m": F.count("c").over(whole).cast("int"),
                "before": F.count("c").over(whole.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)).cast("int"),
                "worth": F.sum(F.log2("c")).over(whole) / (F.col("n") + 1),
                **{w: F.max(w).over(whole) for w in _SKETCH},
            }
        ).where("c is not null")
        kept = held.where(F.col("m") >= 1 + F.floor(F.ceil(F.col("n") * up / down) / EXTRA))
        #: (g, sid, n, weight, pos, before, m, worth, sketch): the prefix tokens of each distinct set that other sets hold
        #: too, m of them in a set.  g stands for ``weight`` tokens held by the same sets; the first of them is in place
        #: ``pos`` of the set and has ``before`` of the m before it.
        self.prefixes = stored(kept.groupBy("sid", "g").agg(F.count(F.lit(1)).cast("int").alias("weight"), F.min("pos").alias("pos"), F.min("before").alias("before"), *[F.first(c).alias(c) for c in ("n", "m", "worth", *_SKETCH)]), "prefixes")
        discard(found)

    def may_link(self, na: Column, nb: Column, shared: Column) -> Column:
        """False only if sets of these sizes, with so many shared prefix tokens, can't be similar enough.

        Behind the prefix that ends first nothing but the rest of its set can be shared.
        """
        up, down = self.threshold
        rest = F.greatest(_left_behind(na, self.threshold), _left_behind(nb, self.threshold))
        return (F.least(na, nb) * down >= F.greatest(na, nb) * up) & (shared >= F.greatest(1 + F.floor(F.least(na, nb) / EXTRA), self.overlap(na, nb) - rest))

    def overlap(self, na: Column, nb: Column) -> Column:
        """The least overlap at which sets of these sizes are similar enough."""
        up, down = self.threshold
        return F.ceil((na + nb) * up / (up + down))

    def may_meet(self, a: str, b: str) -> Column:
        """False only if the sets whose prefix rows meet in a token can't be similar enough.

        Before the token they share no more than either holds with others, behind it no more
        than the rest; and they differ in no fewer tokens than in bits of their sketches.
        """
        c = lambda side, name: F.col(f"{side}_{name}")
        before = F.least(c(a, "before"), c(b, "before"))
        behind = F.least(c(a, "n") - c(a, "pos"), c(b, "n") - c(b, "pos"))
        overlap = self.overlap(c(a, "n"), c(b, "n"))
        differ = sum((F.bit_count(c(a, w).bitwiseXOR(c(b, w))) for w in _SKETCH), F.lit(0))
        near = (before + behind >= overlap) & (differ <= c(a, "n") + c(b, "n") - 2 * overlap)
        return self.may_link(c(a, "n"), c(b, "n"), F.least(c(a, "m"), c(b, "m"))) & near

    def hub_pairs(self) -> DataFrame:
        """(a, b, n_a, n_b): each set with the hubs it meets in most tokens.

        A token has two hubs: its holder whose prefix is shared most, as an original's is
        by its edited copies, and its holder of the smallest hash.
        """
        facts = ["n", "weight", "pos", "m", "before", *_SKETCH]
        holder = lambda *first: F.struct(*first, F.col("sid").alias("hub"), *facts)
        hubs = self.prefixes.groupBy("g").agg(F.array(F.max(holder("worth", F.xxhash64("sid").alias("h"))), F.min(holder(F.lit(0.0).alias("worth"), F.xxhash64("sid").alias("h")))).alias("hubs"))
        hubs = hubs.select("g", F.posexplode("hubs").alias("kind", "h")).select("g", "kind", F.col("h.hub").alias("b"), *[F.col(f"h.{f}").alias(f"b_{f}") for f in facts])
        own = self.prefixes.select("g", F.col("sid").alias("a"), *[F.col(f).alias(f"a_{f}") for f in facts])
        met = own.join(hubs, "g").where((F.col("a") != F.col("b")) & self.may_meet("a", "b"))
        votes = met.groupBy("a", "kind", "b").agg(F.sum(F.least("a_weight", "b_weight")).alias("votes"), F.max("a_n").alias("n_a"), F.max("b_n").alias("n_b"))
        near = votes.where(self.may_link(F.col("n_a"), F.col("n_b"), F.col("votes")))
        best = near.groupBy("a", "kind").agg(F.max(F.struct("votes", "b", "n_a", "n_b")).alias("v"))
        return best.select("a", "v.b", "v.n_a", "v.n_b").distinct()

    def pairs_across(self, components: DataFrame) -> DataFrame:
        """(a, b, n_a, n_b): every pair across two components that may link."""
        placed = self.prefixes.drop("worth").join(components.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        mixed = placed.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("g")
        x = stored(placed.join(mixed, "g"), "mixed")
        a, b = (x.select("g", *[F.col(c).alias(f"{s}_{c}") for c in x.columns if c != "g"]) for s in "ab")
        met = a.join(b, "g").where((F.col("a_component") < F.col("b_component")) & self.may_meet("a", "b"))
        shared = met.groupBy(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).agg(F.max("a_n").alias("n_a"), F.max("b_n").alias("n_b"), F.sum(F.least("a_weight", "b_weight")).alias("shared"))
        return shared.where(self.may_link(F.col("n_a"), F.col("n_b"), F.col("shared"))).drop("shared")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """(a, b, overlap, n_a, n_b) of the pairs that are similar enough, by partial overlaps per fragment."""
        pairs = stored(pairs, "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        wanted = bitmap(self.first.join(ends, "sid").select("key"), "key", 26)
        pieces = self.texts.mapInArrow(_fragment_rows(self.size, self.order, wanted), "sid long, fragment int, tokens array<long>")
        pieces = stored(pieces.join(ends, "sid", "left_semi"), "fragments")
        left = pairs.join(pieces.select(F.col("sid").alias("a"), "fragment", F.col("tokens").alias("x")), "a")
        both = left.join(pieces.select(F.col("sid").alias("b"), "fragment", F.col("tokens").alias("y")), ["b", "fragment"])
        partial = both.select("a", "b", "n_a", "n_b", "fragment", F.size(F.array_intersect("x", "y")).alias("overlap"))
        once = partial.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("overlap").alias("overlap"))  # a set may have been read from two rows
        summed = once.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
        up, down = self.threshold
        found = stored(summed.where(F.col("overlap") * down >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * up), "linked")
        discard(pairs, pieces)
        return found

    def membership(self) -> DataFrame:
        """(id, n_shingles, component_id) of every row: the smallest id reachable by links."""
        near = self.linked(self.hub_pairs()).select("a", "b")
        first = connected_components(near)
        more = self.linked(self.pairs_across(first)).select("a", "b")
        nodes = connected_components(near.unionByName(more))
        placed = self.sets.join(nodes.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "sid")))
        smallest = placed.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
        return placed.join(smallest, "component", "left").select("key", "id", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))

    def links(self) -> DataFrame:
        """(a, b, overlap, n_a, n_b): every pair of distinct sets that link, inside components too.

        All pairs that share prefix tokens are verified, so that a group of near copies
        costs the square of its distinct sets; ``membership`` spares that.
        """
        alone = self.sets.select(F.col("sid").alias("node"), F.col("sid").alias("component")).limit(0)
        return self.linked(self.pairs_across(alone))

    def n_links(self) -> DataFrame:
        """(key, id, n_shingles, n_links) of every row: how many other rows link with it."""
        held = self.sets.where("n > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("rows"))
        ends = self.links().select("a", "b")
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(held.select(F.col("sid").alias("b"), "rows"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("rows").alias("others"))
        counted = held.join(others, "sid", "left").select("sid", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        return self.sets.join(counted, "sid", "left").select("key", "id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

    def one_of_each(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` (the joined table) without all but one of each group.

        The smallest id stays, a null id before all others, and of repeated rows one.
        Rows with an empty set are in no group and all stay.
        """
        members = self.membership().select("key", "id", "n_shingles", "component_id")
        best = members.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("f")).select(F.col("f.key").alias("_key"))
        rows = members.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
        chosen = best.join(rows, "_key").select("_key", (F.col("_rows") > 1).alias("_again"))
        empty = members.where("n_shingles = 0").select(F.col("key").alias("_key"), F.lit(False).alias("_again")).distinct()
        chosen = stored(chosen.unionByName(empty), "chosen")  # a key and a flag a row; Spark broadcasts it if that is small
        keyed = docs.withColumn("_row_key", F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
        kept = keyed.join(chosen, F.col("_row_key") == F.col("_key"))
        once = kept.where("_again").dropDuplicates(["_row_key"])
        return kept.where("not _again").unionByName(once).select(*docs.columns)
