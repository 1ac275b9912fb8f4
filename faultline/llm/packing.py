"""Concatenate-and-cut packing of tokenised documents into fixed windows.

Pass one tokenises every text once and writes its ids, its partition and its
offset inside the partition to the shared folder.  The token totals of the
partitions (one row each) give every partition a global offset; pass two cuts the
concatenation at multiples of the window length, partition by partition, so the
ids are never shuffled.  A piece is a boundary record: which ids of which document
lie where in which sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import stored
from faultline.llm.words import mix, slices, span_hashes

WINDOW = 2048
END_ID = 1
#: Distinct pre-tokens a worker keeps; beyond it, it starts anew.
CACHED_PIECES = 200_000


LETTER, NUMBER, SPACE, OTHER = range(4)
_CLASS_OF: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point, as the pre-token pattern tells them apart."""
    if not _CLASS_OF:
        found = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
            found[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        _CLASS_OF.append(found)
    return _CLASS_OF[0]


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the concatenated texts start, for texts without an apostrophe.

    A pre-token is a run of letters, of numbers or of other signs with one space
    before it, or a run of white space without the last one before a sign.
    """
    kind = _classes()[points]
    space = kind == SPACE
    head = np.zeros(len(points), bool)
    head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    tail = np.zeros(len(points), bool)
    tail[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
    start = head.copy()
    start[1:] |= space[1:] & ~space[:-1]
    start[1:] |= ~space[1:] & (kind[1:] != kind[:-1]) & (points[:-1] != 32)
    start[:-1] |= space[:-1] & ~space[1:] & ~tail[:-1]
    return np.flatnonzero(start)


class PieceEncoder:
    """Ids of texts by the byte-level BPE of a ``tokenizers`` file, each distinct pre-token encoded once.

    A byte-level BPE never merges across pre-tokens, so a text's ids are those of its
    pre-tokens one after another.  The merges of a single pre-token run in the byte-pair
    core of ``tiktoken``, built from the file's own vocabulary (ids are merge ranks);
    texts with an apostrophe (contractions) or a special token of the file go through
    ``tokenizers`` itself.  Pre-tokens are known by two 64-bit hashes, and the cache of a
    worker is bounded.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        other = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
        vocab = self._tokenizer.get_vocab(with_added_tokens=False)
        special = {t.content for t in self._tokenizer.get_added_tokens_decoder().values()}
        self._whole = regex.compile("|".join(map(regex.escape, ["'", *sorted(special)])))
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        self._merge = tiktoken.Encoding("file", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._forget()

    def _forget(self) -> None:
        self._known: dict[int, int] = {}
        self._pool = np.zeros(1 << 16, np.uint16)
        self._at = np.zeros(1, np.int64)

    def _learn(self, pieces: list[str], keys: list[int]) -> None:
        found = [self._merge(p.encode()) for p in pieces]
        flat = np.array([i for x in found for i in x], np.uint16)
        ends = self._at[-1] + np.cumsum([len(x) for x in found])
        while ends[-1] > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._at[-1] : ends[-1]] = flat
        first = len(self._at) - 1
        self._at = np.concatenate([self._at, ends])
        self._known.update(zip(keys, range(first, first + len(keys)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [self._whole.search(t) is not None for t in texts]
        plain = ["" if w else t for t, w in zip(texts, whole, strict=True)]
        points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in plain])])
        out = [np.zeros(0, np.uint16)] * len(texts)
        if len(points):
            start = piece_starts(points, offsets)
            end = np.append(start[1:], len(points))
            hashes, again = span_hashes(points, start, end), span_hashes(mix(points.astype(np.uint64)), start, end)
            _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            if (again[first][place] != again).any():  # two pre-tokens of one hash
                return [np.array(self._tokenizer.encode(t, add_special_tokens=False).ids, np.uint16) for t in texts]
            keys = [a << 64 | b for a, b in zip(hashes[first].tolist(), again[first].tolist(), strict=True)]
            if len(self._known) > CACHED_PIECES:
                self._forget()
            known = np.array([self._known.get(k, -1) for k in keys])
            new = np.flatnonzero(known < 0)
            if len(new):
                base = len(self._at) - 1
                self._learn([points[s:e].tobytes().decode("utf-32-le") for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)], [keys[k] for k in new.tolist()])
                known[new] = base + np.arange(len(new))
            entry = known[place]
            lengths = self._at[entry + 1] - self._at[entry]
            stops = np.cumsum(lengths)
            ids = self._pool[np.repeat(self._at[entry] - (stops - lengths), lengths) + np.arange(stops[-1])]
            cuts = np.append(0, stops)[np.searchsorted(start, offsets)]
            out = [ids[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for k, t in enumerate(texts):
            if whole[k]:
                out[k] = np.array(self._tokenizer.encode(t, add_special_tokens=False).ids, np.uint16)
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_for(path: str) -> PieceEncoder:
    """The worker's encoder of a file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _tokenise(path: str, rows: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = encoder_for(path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], np.uint16)
        for piece in slices(batches, 1, rows):
            texts = [t or "" for t in piece.column(1).to_pylist()]
            packed = [np.append(x, end).astype("<u2").tobytes() for x in encoder.encode(texts)]
            counts = np.array([len(p) // 2 for p in packed], np.int64)
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).cast(pa.int64()), pa.array(packed, pa.binary()), pa.array(counts), pa.array(starts), pa.array(np.full(len(packed), part, np.int32))],
                ["doc_id", "ids", "doc_tokens", "local_start", "part"],
            )

    return run


def _cut(window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, ids = batch.column("doc_id"), batch.column("ids")
            counts, starts = batch.column("doc_tokens").to_numpy(), batch.column("global_start").to_numpy()
            first, last = starts // window, (starts + counts - 1) // window
            row = np.repeat(np.arange(len(counts)), last - first + 1)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            lo = np.maximum(starts[row], sequence * window)
            hi = np.minimum((starts + counts)[row], (sequence + 1) * window)
            start, length = lo - starts[row], hi - lo
            crcs, pieces, at, wide = np.zeros(len(row), np.int64), [], -1, None
            for k, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if r != at:
                    at, wide = r, np.frombuffer(ids[r].as_buffer(), "<u2").astype("<u4")
                piece = wide[s : s + n]
                crcs[k] = zlib.crc32(piece.tobytes())
                if with_ids:
                    pieces.append(piece.astype(np.int32))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [doc_id.take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crcs), pa.array(counts[row]), pa.array(sequence), pa.array(lo - sequence * window)]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(pieces, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all rows into sequences of ``window`` tokens; only the last sequence can be short.

    ``tokenizer`` is the path of a byte-level BPE file of at most 2**16 ids.  Each document is its ids followed by
    ``END_ID``; null and empty texts are the end id alone, rows may repeat, ids may be
    null, and an empty table gives no pieces.  Returns one row per piece: ``doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset``, with ``with_ids``
    also its ``ids``.  Other columns of ``docs`` are not read.  Special tokens of the file
    that stand in a text become their ids, as in ``tokenizers``.  A worker takes slices of
    at most 0.5 MB of text, a longer text by itself.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = thin.mapInArrow(_tokenise(tokenizer), "doc_id long, ids binary, doc_tokens long, local_start long, part int")
    kept = stored(kept, "token_ids")
    totals = kept.groupBy("part").agg(F.sum("doc_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    bases = stored(bases, "bases")  # one row per partition; Spark broadcasts it if that is small
    placed = kept.join(bases, F.col("part") == F.col("_part")).select("doc_id", "ids", "doc_tokens", (F.col("local_start") + F.col("_base")).alias("global_start"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(_cut(window, with_ids), schema + ", ids array<int>" * with_ids)
