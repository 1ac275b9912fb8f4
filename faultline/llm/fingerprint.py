"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Every word shingle is hashed once; the top byte of the hash names one of
``N_BINS`` bins and the smallest hash of a bin is its value.  A bin that stays
empty copies a bin chosen by a hash of (empty bin, attempt) until it hits a full
one, which is uniform over the full bins and the same choice for every document.
Of each value only ``BITS`` low-order bits are kept, and the likeness of two
fingerprints is corrected for the matches that chance gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.ordering import range_buckets
from faultline.llm.shared import stored

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SHINGLE = 5
N_BINS = 256
BITS = 4
PER_LONG = 64 // BITS
#: Low-order digits of a value that a bin may keep; the bits above them shrink as more shingles share a bin.
DIGITS = 12
VALUE_MASK = (1 << 56) - 1
#: Attempts by a hash of (bin, attempt) before the full bins are ranked by a hash of (bin, full bin).
ATTEMPTS = 4


def add_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: the packed bins as an array of longs; null where the text has no word.

    Texts of one to four words have one shingle, the whole sequence.  Each step is
    a column of its own, read more than once above, so that Catalyst keeps it.
    """
    empty = F.array().cast("array<bigint>")
    step = df.withColumn("_w", F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), WORD_BREAK), ""))
    step = step.withColumns({"_h": F.transform("_w", lambda w: F.xxhash64(w)), "_few": F.when(F.size("_w").between(1, SHINGLE - 1), F.xxhash64("_w"))}).drop("_w")
    h = F.col("_h")
    shingles = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[h[i + k] for k in range(SHINGLE)]))
    step = step.withColumn("_g", F.when(F.size(h) >= SHINGLE, shingles).when(F.size(h) > 0, F.array("_few")).otherwise(empty)).drop("_h", "_few")
    # One sentinel, the largest value, stands in each bin: after sorting, the first entry of each bin is its value or the sentinel.
    sentinels = F.array(*[F.lit((b << 56) + VALUE_MASK) for b in range(-N_BINS // 2, N_BINS // 2)])
    step = step.withColumn("_all", F.sort_array(F.concat("_g", sentinels))).drop("_g")
    entries = F.col("_all")
    firsts = F.filter(entries, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(entries, i - 1), 56)))
    step = step.withColumn("_bins", F.when(F.size(entries) > N_BINS, firsts)).drop("_all")
    bins = F.col("_bins")
    full = lambda x: F.lit(VALUE_MASK).bitwiseAND(x) != VALUE_MASK
    step = step.withColumn("_full", F.filter(bins, full))

    def low(x: Column, i: Column) -> Column:
        """Each bin keeps another digit of its value, so that copies of one value differ between bins."""
        return F.call_function("shiftrightunsigned", x, (F.pmod(i, F.lit(DIGITS)) * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))

    def attempt(i: Column, t: int) -> Column:
        hit = F.get(bins, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(N_BINS)).cast("int"))
        return F.when(full(hit), low(hit, i))

    def densified(i: Column) -> Column:
        ranked = F.transform("_full", lambda x: F.struct(F.xxhash64(i, F.lit(-1), F.shiftright(x, 56)).alias("r"), low(x, i).alias("v")))
        return F.coalesce(*[attempt(i, t) for t in range(ATTEMPTS)], F.array_min(ranked)["v"])

    step = step.withColumn("_low", F.transform(bins, lambda x, i: F.when(full(x), low(x, i)).otherwise(densified(i)))).drop("_bins", "_full")
    digits = F.col("_low")
    pack = lambda j: F.aggregate(F.slice(digits, j * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda a, d: F.shiftleft(a, BITS).bitwiseOR(d))
    return step.withColumn(out, F.when(digits.isNotNull(), F.array(*[pack(j) for j in range(N_BINS // PER_LONG)]))).drop("_low")


def as_hex(packed: Column) -> Column:
    """The packed bins as one string of hexadecimal digits; empty where there are none."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity (0 to 1) of two packed fingerprints.

    With r = 2**-BITS matches by chance, a share p of equal digits estimates
    (p - r) / (1 - r).  Two texts without words are alike, one alone is not.
    """
    ones = int("1" * 16, 16)
    differ = F.aggregate(
        F.arrays_zip(a.alias("x"), b.alias("y")),
        F.lit(0),
        lambda n, e: n + F.bit_count(_any_bit(e["x"].bitwiseXOR(e["y"])).bitwiseAND(F.lit(ones))),
    )
    r = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (1 - differ / F.lit(float(N_BINS)) - r) / (1 - r))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(corrected)


def _any_bit(x: Column) -> Column:
    """The lowest bit of each digit is set if the digit isn't zero."""
    return x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and its edited text, and compares them.

    The edited text is the text with its last floor(n / 3) code points replaced by
    the first as many (or all) of the next row's text.  Rows stand in descending
    (id, text hash), null ids last, and the last row is followed by the first; a
    lone row follows itself, and repeated rows each have a place.  Null texts are
    empty.  Other columns are not carried.  A text is worked on in one row, so the longest
    text bounds a task's memory.

    Texts move once: into range buckets of the id, where the next row is the next
    in order; the head of each bucket is also given to the bucket before it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    bucket = range_buckets(base, "doc_id", F.xxhash64("text"), size=F.octet_length("text"))
    base = base.withColumns({"_b": bucket, "_th": F.xxhash64("text")})
    heads = base.groupBy("_b").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("_th").alias("th"))).alias("_head"))
    around = Window.orderBy("_b")
    ring = heads.select(
        F.col("_b").alias("_of"), "_head", F.coalesce(F.lead("_b").over(around), F.min("_b").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to")
    )
    ring = stored(ring, "ring")  # one row per bucket; Spark broadcasts it if that is small
    at_head = (F.col("_b") == F.col("_of")) & (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("_head.id")) & (F.col("_th") == F.col("_head.th"))
    guests = base.join(ring, at_head).select("doc_id", "text", F.col("_to").alias("_b"), "_th").withColumn("_guest", F.lit(True))
    rows = add_fingerprint(base.withColumn("_guest", F.lit(False)).unionByName(guests), "text", "packed")
    order = Window.partitionBy("_b").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("_th").desc())
    paired = rows.withColumns({"_next": F.lead("text").over(order), "_next_packed": F.lead("packed").over(order)}).where("not _guest").drop("_b", "_th", "_guest")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = paired.withColumns({"n_chars": n.cast("long"), "_edited": F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("_next"), F.lit(1), cut))}).drop("text", "_next")
    edited = edited.withColumn("edited_sha256", F.sha2("_edited", 256))
    done = add_fingerprint(edited, "_edited", "edited_packed").drop("_edited")
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("packed")).alias("fingerprint"),
        as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("_next_packed")).alias("near_next"),
    )
