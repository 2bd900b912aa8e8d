"""Document fingerprints by winnowing, with Spark's own expressions alone.

The bytes of a text give a k-gram at each place; each is hashed. In every window of w neighbouring hashes the least is
chosen, of equal ones the rightmost. So any passage of at least w + k - 1 bytes that two texts share gives them a common
fingerprint, and the places of the fingerprints say where it is.

The hash rolls by halves: of a gram of even length the first half's hash, moved by as many bits, with the second half's
added without carry. A half's hash serves the two grams it ends and begins. Spark has no running fold over arrays that is
linear; to roll on down to single bytes, by doubling, costs more than it spares (README).

A hash and its place are one number, hash first and place counted down, so that the least number is the least hash with
the rightmost place; the least of each window comes from growing windows: 1, 4, 16, ... w. Texts are worked off in
segments of SEGMENT windows, so memory beside the text itself holds one segment.

The edited text of a document is a beginning of it and a beginning of the next one, so nearly all its windows are theirs,
moved: its fingerprints are theirs but for what the windows around the seam and at the end choose, which are worked out.

Cases: null and empty texts have no fingerprints; shorter texts than a gram have one, of all their bytes; shorter ones
than a window have one; two texts without fingerprints are alike (1), one without is unlike any other (0); equal texts
have equal fingerprints; rows with equal ids are ordered by a hash of their text, null ids come first; empty tables give
no rows; other columns of the input are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.order import with_next

K, WINDOW = 16, 16
#: Windows of a segment; with a window and a gram it must stay below 2 ** PLACE_BITS.
SEGMENT, PLACE_BITS = 32768, 16


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _wider(steps: list[int]):
    return lambda m: F.transform(m, lambda x, i: F.least(x, *[F.get(m, i + j) for j in steps]))


def _grams(piece: Column, k: int) -> Column:
    """The hashes of all grams of a piece."""
    half = k if k % 2 else k // 2
    n = F.greatest(F.lit(1), F.octet_length(piece) - (half - 1))
    halves = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.substring(piece, i, F.lit(half))))
    if half == k:
        return halves
    whole = lambda a: F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - half))
    return let(halves, lambda a: F.transform(whole(a), lambda x, i: F.shiftleft(x, half).bitwiseXOR(F.get(a, i + half))))


def _segment(piece: Column, k: int, w: int) -> Column:
    """The chosen numbers of a piece, in order of their places."""
    top = (1 << PLACE_BITS) - 1
    n = F.octet_length(piece)
    hashed = F.when(n < k, F.array(F.xxhash64(piece))).otherwise(_grams(piece, k))
    least = F.transform(hashed, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(top - 1 - i))
    size = 1
    while size < w:  # the least of each window from those of two to four smaller ones that cover it
        steps = sorted({min(j * size, w - size) for j in (1, 2, 3)})
        least = let(least, _wider(steps))
        size += steps[-1]
    return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.lit(1), n - (k + w - 2))))


def fingerprint(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """Segments of the text, each the array of its numbers: a place within the segment in the last PLACE_BITS bits,
    counted down, above it the hash."""
    if SEGMENT + k + w >= 1 << PLACE_BITS:
        raise ValueError("k and w are too large")

    def whole(data: Column) -> Column:
        segments = F.ceil(F.greatest(F.lit(1), F.octet_length(data) - (k + w - 2)) / SEGMENT).cast("int")
        piece = lambda s: F.substring(data, s * SEGMENT + 1, F.lit(SEGMENT + k + w - 2))
        return F.transform(F.sequence(F.lit(0), segments - 1), lambda s: let(piece(s), lambda p: _segment(p, k, w)))

    none = F.array().cast("array<array<bigint>>")
    return F.when(F.octet_length(text) > 0, let(text.cast("binary"), whole)).otherwise(none)


def marks(found: Column) -> Column:
    """place (byte, from 0) and hash of each of a fingerprint's numbers, in order. The first of a segment may be the last
    of the one before and then counts once."""
    each = F.flatten(F.transform(found, lambda x, s: F.transform(x, lambda y: _mark(y, s.cast("long") * SEGMENT))))
    return let(each, lambda m: F.filter(m, lambda x, i: (i == 0) | (x["place"] != F.get(m, F.greatest(i - 1, F.lit(0)))["place"])))


def _mark(number: Column, start: Column) -> Column:
    top = (1 << PLACE_BITS) - 1
    return F.struct((start + top - 1 - number.bitwiseAND(F.lit(top).cast("long"))).alias("place"), F.shiftright(number, PLACE_BITS).alias("hash"))


def edited_marks(edited: Column, seam: Column, own: Column, after: Column, k: int = K, w: int = WINDOW) -> Column:
    """The marks of a text whose bytes before ``seam`` begin a text with the marks ``own``, and whose others begin one with
    the marks ``after``. A mark lies in at most w windows, so those of windows that lie wholly in one part are that text's
    own, but for the last of the part, and the marks around the seam and at the end follow from few windows there."""
    size = F.octet_length(edited)
    last_own = seam - (k + w - 1)  # the last window that lies in the first part, and in the second
    last_after = size - seam - (k + w - 1)
    is_long = last_after >= 2 * w  # the second part has marks of its own
    begin = F.greatest(F.lit(0), last_own - (w - 2))
    till = F.when(is_long, seam + (2 * w + k - 3)).otherwise(size)
    end = F.greatest(F.lit(0), seam + last_after - (w - 2))
    data = edited.cast("binary")
    pieces = F.array(
        F.struct(begin.cast("long").alias("start"), F.substring(data, begin + 1, till - begin).alias("bytes")),
        F.struct(end.cast("long").alias("start"), F.when(is_long, F.substring(data, end + 1, size - end)).alias("bytes")),
    )
    some = lambda p: F.when(F.octet_length(p["bytes"]) > 0, F.transform(_segment(p["bytes"], k, w), lambda y: _mark(y, p["start"])))
    none = F.array().cast("array<struct<place:bigint,hash:bigint>>")

    def whole(found: Column) -> Column:
        middle, rest = F.coalesce(found[0], none), F.coalesce(found[1], none)
        moved = lambda x: F.struct((x["place"] + seam).alias("place"), x["hash"].alias("hash"))
        return F.concat(
            F.filter(own, lambda x: x["place"] <= last_own),
            F.filter(middle, lambda x: (x["place"] > last_own) & (~is_long | (x["place"] <= seam + (w - 2)))),
            F.when(is_long, F.transform(F.filter(after, lambda x: (x["place"] >= w - 1) & (x["place"] <= last_after)), moved)).otherwise(none),
            F.filter(rest, lambda x: x["place"] > seam + last_after),
        )

    return let(F.transform(pieces, some), whole)


def hashes(found: Column) -> Column:
    """The distinct hashes of marks."""
    return F.array_distinct(F.transform(found, lambda x: x["hash"]))


def label(found: Column) -> Column:
    """A short text that stands for marks: their number, and hashes of them all with their places."""
    return F.concat_ws("-", F.size(found).cast("string"), F.lower(F.hex(F.xxhash64(found))), F.lower(F.hex(F.hash(found))))


def likeness(a: Column, b: Column) -> Column:
    """Common hashes by all hashes, of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def places(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, place (byte, from 0), hash: a row for each fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(marks(fingerprint(F.col("text"), k, w))).alias("x"))
    return rows.select("doc_id", "x.place", "x.hash")


def compare_edited(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last half is the first of the next document; and how
    alike its fingerprint is to the edited text's and to the next document's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    prepare = lambda d: d.withColumn("found", marks(fingerprint(F.col("text"), k, w)))
    pairs = with_next(rows, "doc_id", F.xxhash64("text"), ["text", "found"], prepare)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "found", "next_found", F.concat(first, second).alias("edited"), F.octet_length(first).alias("seam"))
    pairs = pairs.withColumn("edited_found", edited_marks(F.col("edited"), F.col("seam"), F.col("found"), F.col("next_found"), k, w))
    pairs = pairs.select("doc_id", "n_chars", "edited", "found", "edited_found", hashes(F.col("found")).alias("own"), hashes(F.col("next_found")).alias("next"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), label(F.col("found")).alias("fingerprint"),
        label(F.col("edited_found")).alias("edited_fingerprint"), likeness(F.col("own"), hashes(F.col("edited_found"))).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
