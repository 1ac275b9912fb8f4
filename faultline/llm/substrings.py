"""Removal of long word sequences that occur more than once in the corpus.

The texts that can repeat are first narrowed to reference passages.  Of the
12-word grams of each window of ``length`` words, the one with the smallest hash
is its anchor, so equal windows have equal anchors; windows whose anchor occurs
once in the corpus are done with.  The rest are compared by hash within their
anchor, which tells exactly which windows occur twice: two windows count as equal
if the 64-bit hashes of both the anchor and the window are.

No suffix automata are built: meeting every document with the automaton of every
reference shard would cost the square of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import discard, stored
from faultline.llm.sketches import bitmap, counted_batches, in_bitmap
from faultline.llm.words import slices, sliding_min, string_buffers, window_hashes, word_bounds, word_hashes

LENGTH = 35
GRAM = 12
#: Bits of the anchors' bitmap for each anchor, up to 2^28 in all: a worker needs no more of its memory for few anchors.
BITS_EACH = 128
#: Bytes of text, and hashes, that a worker has in hand at once.
SLICE, FLUSH = 1 << 18, 1 << 18
#: Windows under anchors that occur more often are laid out one a row, so that they are counted before they are shuffled.
HOT_ANCHOR = 4096


def _windows(column: pa.Array, length: int):
    """(hash of each window, valid, grams, first word of each row) over the concatenated words of a column."""
    data, offsets = string_buffers(column)
    start, end, first = word_bounds(data, offsets)
    words = word_hashes(data, start, end)
    n = max(0, len(words) - length + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = row[:n] == row[length - 1 :] if n else np.zeros(0, bool)
    return words, valid, row, first


def _anchors(words: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(12-gram hashes, smallest 12-gram hash of each window; 0 where the window is not valid)."""
    gram = min(GRAM, length)
    grams = window_hashes(words, gram)
    least = sliding_min(grams, length - gram + 1)[: len(valid)].copy()
    least[~valid] = 0
    return grams, least


def _selected(grams: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Grams that are the smallest of some window holding them (all of them, if several tie)."""
    pad = np.zeros(span - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([pad, least, pad]), span)[: len(grams)]
    return (most == grams[: len(most)]) & (most > 0)


def _count_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes():
            for batch in slices(_without_copies(batches), 0, size=SLICE):
                words, valid, _, _ = _windows(batch.column(0), length)
                if valid.any():
                    grams, least = _anchors(words, valid, length)
                    yield grams[_selected(grams, least, length - min(GRAM, length) + 1)]

        for found, n in counted_batches(hashes(), FLUSH):
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["h", "n"])

    return run


def _without_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_at_most_twice(batch.column(1).to_numpy(zero_copy_only=False))))


def _at_most_twice(docs: np.ndarray) -> np.ndarray:
    """Marks the first two rows of each text of a batch: more copies of it tell nothing new about what occurs twice."""
    order = np.argsort(docs, kind="stable")
    same = docs[order][2:] == docs[order][:-2]
    keep = np.ones(len(docs), bool)
    keep[order[2:][same]] = False
    return keep


def _candidates(length: int, repeated: Broadcast, hot: Broadcast):
    """The windows under repeated anchors, as rows (key, doc, at, windows) or (key, doc, w, ats).

    ``key`` is the anchor of windows that stand next to each other from word ``at``
    on.  Under a hot anchor, a row has one window hash ``w`` and all its places in
    the document.
    """
    names = ["key", "doc", "at", "windows", "w", "ats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, hot_flags = np.frombuffer(repeated.value, np.uint8), np.frombuffer(hot.value, np.uint8)
        for batch in slices(_without_copies(batches), 0, size=SLICE):
            docs = batch.column(1).to_numpy(zero_copy_only=False)
            words, valid, row, first = _windows(batch.column(0), length)
            if not valid.any():
                continue
            _, least = _anchors(words, valid, length)
            at = np.flatnonzero(valid)
            at = at[in_bitmap(flags, least[at])]
            hashes = window_hashes(words, length)
            is_hot = in_bitmap(hot_flags, least[at])
            spots = at[~is_hot]
            if len(spots):
                begins = np.ones(len(spots), bool)
                begins[1:] = (np.diff(spots) != 1) | (least[spots][1:] != least[spots][:-1]) | (row[spots][1:] != row[spots][:-1])
                group = np.flatnonzero(begins)
                head, k = spots[group], len(group)
                windows = pa.ListArray.from_arrays(pa.array(np.append(group, len(spots)).astype(np.int32)), pa.array(hashes[spots].view(np.int64)))
                columns = [pa.array(least[head].view(np.int64)), pa.array(docs[row[head]]), pa.array((head - first[row[head]]).astype(np.int32)), windows]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32()))], names)
            spots = at[is_hot]
            if len(spots):
                spots = spots[np.lexsort((spots, hashes[spots], row[spots]))]
                begins = np.ones(len(spots), bool)
                begins[1:] = (hashes[spots][1:] != hashes[spots][:-1]) | (row[spots][1:] != row[spots][:-1])
                group = np.flatnonzero(begins)
                head, k = spots[group], len(group)
                ats = pa.ListArray.from_arrays(pa.array(np.append(group, len(spots)).astype(np.int32)), pa.array((spots - first[row[spots]]).astype(np.int32)))
                none = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(least[head].view(np.int64)), pa.array(docs[row[head]]), *none, pa.array(hashes[head].view(np.int64)), ats], names)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: emits (doc, ats), the windows that some other place has too."""

    def decide(table: pa.Table) -> pa.RecordBatch:
        windows = table.column("windows").combine_chunks()
        counts = np.diff(windows.offsets.to_numpy())
        flat = windows.flatten().to_numpy()
        row = np.repeat(np.arange(len(counts)), counts)
        keys = table.column("key").to_numpy()[row]
        order = np.lexsort((flat, keys))
        same = (flat[order][1:] == flat[order][:-1]) & (keys[order][1:] == keys[order][:-1])
        again = np.zeros(len(flat), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        twice = np.flatnonzero(again)
        at = table.column("at").to_numpy()[row] + np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        rows, head = np.unique(row[twice], return_index=True)
        ats = pa.ListArray.from_arrays(pa.array(np.append(head, len(twice)).astype(np.int32)), pa.array(at[twice].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(table.column("doc").to_numpy()[rows]), ats], ["doc", "ats"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on in the next batch
        if last:
            yield decide(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif held and held[-1].column("key")[-1].as_py() != keys[0]:
            yield decide(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(last))
    if held:
        yield decide(pa.Table.from_batches(held))


def _remove(length: int, text_at: int, starts_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at, size=SLICE):
            data, offsets = string_buffers(batch.column(text_at))
            _, _, first = word_bounds(data, offsets)
            lists = pc.fill_null(batch.column(starts_at), pa.scalar([], pa.list_(pa.int32())))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            begins = first[row] + lists.flatten().to_numpy()
            marks = np.zeros(first[-1] + 1, np.int64)
            np.add.at(marks, begins, 1)
            np.add.at(marks, begins + length, -1)
            kept_words = np.cumsum(marks)[:-1] == 0
            kept, raw = [], data.tobytes()
            for r in range(batch.num_rows):
                own = raw[offsets[r] : offsets[r + 1]].split()
                keep = kept_words[first[r] : first[r + 1]]
                kept.append(b" ".join(own if keep.all() else list(compress(own, keep))).decode("utf-8"))
            n_removed = np.diff(np.append(0, np.cumsum(~kept_words))[first])
            names = [n for k, n in enumerate(batch.schema.names) if k != starts_at]
            arrays = [c for k, c in enumerate(batch.columns) if k != starts_at]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.string()), pa.array(np.diff(first)), pa.array(n_removed)], [*names, "kept_text", "n_words", "n_removed"])

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """(doc, starts): per distinct text (its 64-bit hash) the first words of all windows that occur twice or more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(text.alias("text"), F.xxhash64(text).alias("doc"))
    anchors = hashed.mapInArrow(_count_anchors(length), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2")
    anchors = stored(anchors, "anchors")
    repeated = bitmap(anchors, "h", min(28, max(20, (BITS_EACH * anchors.count()).bit_length())))
    hot = bitmap(anchors.where(F.col("n") > HOT_ANCHOR), "h", 20)
    rows = hashed.mapInArrow(_candidates(length, repeated, hot), "key long, doc long, at int, windows array<long>, w long, ats array<int>")
    rows = stored(rows, "windows")
    discard(anchors)
    usual = rows.where("w is null").select("key", "doc", "at", "windows").repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "doc long, ats array<int>")
    single = rows.where("w is not null").select("key", "w", "doc", "ats")
    common = single.groupBy("key", "w").agg(F.sum(F.size("ats")).alias("n")).where("n >= 2").select("key", "w")
    found = usual.unionByName(single.join(common, ["key", "w"]).select("doc", "ats"))
    return found.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("starts"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``kept_text``, ``n_words`` and ``n_removed``.

    A word goes if some window of ``length`` consecutive words of its row that covers
    it has a word sequence that starts anywhere else too, in the same row or another;
    all windows are judged on the input.  What is left is joined by single spaces.
    Null texts have no words, rows shorter than a window lose nothing, repeated rows
    lose every window, and extra columns pass unchanged; columns with the name of a
    result are replaced.  Texts are taken in slices of at most 0.25 MB, a longer one by
    itself; texts of one 64-bit hash count as one.
    """
    docs = docs.drop("kept_text", "n_words", "n_removed")
    doc = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    ours = {c: f"__repeats_{c}" for c in ("doc", "starts")}
    found = repeated_windows(docs, length, text_col).select(*[F.col(c).alias(name) for c, name in ours.items()])
    joined = docs.join(found, doc == F.col(ours["doc"]), "left").drop(ours["doc"])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    at = docs.columns.index(text_col)
    return joined.mapInArrow(_remove(length, at, len(docs.columns)), ", ".join([*fields, "kept_text string", "n_words long", "n_removed long"]))
