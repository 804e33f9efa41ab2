"""Document fingerprints by a homomorphic multiset hash, in SQL functions alone.

A paragraph is hashed into a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane by
lane modulo a power of two. So order doesn't matter, and a paragraph is put in or taken out by adding or
subtracting its vector. The vector of a paragraph has
  4 lanes modulo 2**56   hashes of the whole paragraph, each of its own seed: equality
  1 lane modulo 2**40    the number of its words
  6 lanes modulo 2**40   one for paragraphs of over 64, 128, 256, 512, 1024 and 2048 words each: 1 where it is so long
  28 x 36 lanes modulo 2**20   likeness: each pair of neighbouring words (and the last word alone) in one lane of one level, in level 0 half of
                         the pairs, in 1 a quarter, and so on; a paragraph of over 64 words leaves level 0 out, of over 128 levels 0 and 1, ...
The levels show how many pairs two documents don't share: in a level that is not full, the lanes that differ count them, and
the likeness is 1 - (pairs in one but not the other) / (pairs of both), estimated from the levels that neither document leaves out. A word put in or
taken out changes two pairs and no others. The last level takes 1 of 2**27 pairs, so it
is not full for any two texts that a string can hold (2**31 bytes, at least two a pair).

A paragraph is a line; words are what lies between spaces. A fingerprint is an ARRAY<BIGINT>: the eleven lanes, then three lanes of
20 bits a number. Defined cases: a null or empty text is the zero vector; a repeated row or doc_id is followed by its next repetition, in the
order of its text; a null doc_id comes last; a single document follows itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.llm.common import order_key, partitions, range_bucket

LEVELS, WORDS, FIELD = 28, 12, 21
#: Levels made and compared for every text; those above have 1 of 2**NEAR pairs, and mostly nothing.
NEAR = 7
#: Words of a paragraph up to which no level is left out; at each doubling one more is.
SHORT, LEFT_OUT = 64, 6
#: Where the levels begin (from 0).
_BASE = 5 + LEFT_OUT
LANES = 3 * WORDS
_WIDE = (1 << 56) - 1
_COUNT = (1 << 40) - 1
_FIELDS = [((1 << 20) - 1) << FIELD * i for i in range(3)]
_MASK = sum(_FIELDS)


def _long(x: int):
    return F.lit(x).cast("long")


def _wide_lane(paragraphs, i: int):
    def add(total, p):
        # Columns are hashed from left to right, so the number first: it is the seed for the paragraph.
        return (total + F.xxhash64(F.lit(i), p).bitwiseAND(_long(_WIDE))).bitwiseAND(_long(_WIDE))

    return F.aggregate(paragraphs, _long(0), add)


def _level(hashes, low, value):
    """The lanes of one level: its pairs are those whose hash is `value` in the bits of `low`."""

    def unit(h):
        lane = F.pmod(F.shiftrightunsigned(h, LEVELS), _long(LANES)).cast("int")
        number = F.shiftrightunsigned(h, 44).bitwiseOR(_long(1))
        shift = F.when(lane % 3 == 0, _long(1)).when(lane % 3 == 1, _long(1 << FIELD)).otherwise(_long(1 << 2 * FIELD))
        return F.struct(F.floor(lane / 3).cast("int").alias("word"), (number * shift).alias("add"))

    def put(sums, u):
        return F.transform(sums, lambda v, i: F.when(i == u["word"], (v + u["add"]).bitwiseAND(_long(_MASK))).otherwise(v))

    own = F.transform(F.filter(hashes, lambda h: h.bitwiseAND(low) == value), unit)
    return F.aggregate(own, F.array_repeat(_long(0), WORDS), put)


def _bits(level: int):
    """A pair is of the level that its hash ends in so many zero bits (the last level takes the rest)."""
    last = level == LEVELS - 1
    return F.struct(_long((1 << level if last else 2 << level) - 1).alias("low"), _long(0 if last else 1 << level).alias("value"))


def _levels(hashes):
    """The lanes of all levels."""

    def made(own, levels: range):
        return F.flatten(F.transform(F.array(*(_bits(i) for i in levels)), lambda m: _level(own, m["low"], m["value"])))

    rest = F.filter(hashes, lambda h: h.bitwiseAND(_long((1 << NEAR) - 1)) == _long(0))
    none = F.array_repeat(_long(0), (LEVELS - NEAR) * WORDS)
    far = F.transform(F.array(rest), lambda r: F.when(F.size(r) == 0, none).otherwise(made(r, range(NEAR, LEVELS))))[0]
    return F.concat(made(hashes, range(NEAR)), far)


def _pairs(paragraph):
    """The number of words and the hashes of pairs of one paragraph, of the levels that it doesn't leave out."""
    words = F.transform(F.filter(F.split(paragraph, " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    # Through one-element arrays, so that words are cut and hashed once.
    pairs = F.transform(F.array(words), lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b)))[0]

    def thinned(p):
        n = F.size(p)
        low = F.when(n <= SHORT, _long(0))
        for i in range(1, LEFT_OUT):
            low = low.when(n <= SHORT << i, _long((1 << i) - 1))
        low = low.otherwise(_long((1 << LEFT_OUT) - 1))
        return F.struct(n.cast("long").alias("n"), F.filter(p, lambda h: h.bitwiseAND(low) == _long(0)).alias("hashes"))

    return F.transform(F.array(pairs), thinned)[0]


def _over(limit: int):
    return lambda n: n > limit


def _measured(parts):
    """Counts and levels of a text's paragraphs."""
    n = F.transform(parts, lambda p: p["n"])
    total = F.aggregate(n, _long(0), lambda t, x: t + x)
    long = [F.size(F.filter(n, _over(SHORT << i))).cast("long") for i in range(LEFT_OUT)]
    levels = F.transform(F.array(F.flatten(F.transform(parts, lambda p: p["hashes"]))), _levels)[0]
    return F.concat(F.array(total, *long), levels)


def fingerprint(text):
    """The fingerprint of a text column."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    wide = F.transform(F.array(paragraphs), lambda p: F.array(*(_wide_lane(p, i) for i in range(4))))[0]
    return F.concat(wide, F.transform(F.array(F.transform(paragraphs, _pairs)), _measured)[0])


def _fold(a, b, sign: int):
    """Sum or difference of two fingerprints, lane by lane."""

    def lane(x, y, mask):
        return (x + y if sign > 0 else x + F.lit(mask + 1) - y).bitwiseAND(_long(mask))

    def packed(x, y):
        out = None
        for i, field in enumerate(_FIELDS):
            one = lane(F.shiftrightunsigned(x.bitwiseAND(_long(field)), FIELD * i), F.shiftrightunsigned(y.bitwiseAND(_long(field)), FIELD * i), (1 << 20) - 1)
            one = F.shiftleft(one, FIELD * i)
            out = one if out is None else out.bitwiseOR(one)
        return out

    wide = F.zip_with(F.slice(a, 1, 4), F.slice(b, 1, 4), lambda x, y: lane(x, y, _WIDE))
    count = F.zip_with(F.slice(a, 5, 1 + LEFT_OUT), F.slice(b, 5, 1 + LEFT_OUT), lambda x, y: lane(x, y, _COUNT))
    rest = LEVELS * WORDS
    return F.concat(wide, count, F.zip_with(F.slice(a, _BASE + 1, rest), F.slice(b, _BASE + 1, rest), packed))


def insert(fp, paragraphs):
    """The fingerprint of a document after more paragraphs (a text, or their own fingerprint by combine())."""
    return combine(fp, fingerprint(paragraphs))


def delete(fp, paragraphs):
    """The fingerprint of a document without these of its paragraphs."""
    return _fold(fp, fingerprint(paragraphs), -1)


def combine(a, b):
    """The fingerprint of two documents together."""
    return _fold(a, b, 1)


def as_text(fp):
    return F.array_join(F.transform(fp, lambda v: F.lower(F.hex(v))), ".")


def likeness(a, b):
    """0 to 1: the share of pairs of words that two documents have in common, from their fingerprints alone."""
    # Through a one-element array, so that each fingerprint is made once and not for each level.
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: _compared(s["a"], s["b"]))[0]


def _compared(a, b):
    def differ(first):
        apart = F.zip_with(F.slice(a, first, F.lit(WORDS)), F.slice(b, first, F.lit(WORDS)), lambda x, y: x.bitwiseXOR(y))
        return F.aggregate(apart, F.lit(0), lambda n, x: n + sum(F.when(x.bitwiseAND(_long(field)) != 0, 1).otherwise(0) for field in _FIELDS))

    def counts(levels: range):
        return F.transform(F.array(*(F.lit(_BASE + 1 + i * WORDS) for i in levels)), differ)

    above = [F.slice(x, _BASE + 1 + NEAR * WORDS, (LEVELS - NEAR) * WORDS) for x in (a, b)]
    far = F.when(above[0] == above[1], F.array_repeat(F.lit(0), LEVELS - NEAR)).otherwise(counts(range(NEAR, LEVELS)))
    estimates = F.concat(counts(range(NEAR)), far)
    left_out = F.greatest(*(F.when((a[4 + i] != 0) | (b[4 + i] != 0), i).otherwise(0) for i in range(1, LEFT_OUT + 1)))
    return F.transform(F.array(F.struct(estimates.alias("x"), left_out.alias("out"), (a[4] + b[4]).alias("n"), (a == b).alias("same"))), _likeness)[0]


def _likeness(s):
    counted = F.transform(s["x"], lambda x: F.when(x >= LANES, F.lit(4.0 * LANES)).otherwise(-LANES * F.log(1 - x / F.lit(float(LANES)))))
    full = F.transform(s["x"], lambda x, i: F.when(x > LANES * 3 // 4, i + 1).otherwise(0))
    low = F.least(F.greatest(F.array_max(full), s["out"]), F.lit(LEVELS - 1))
    apart = F.aggregate(F.slice(counted, low + 1, LEVELS), F.lit(0.0), lambda t, x: t + x) * F.pow(F.lit(2.0), low)
    return F.when(s["same"], F.lit(1.0)).when(s["n"] == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart / F.greatest(s["n"], F.lit(1)))).cast("double")


def with_next(docs: DataFrame, carried: dict | None = None) -> DataFrame:
    """doc_id, text and next_text, the text of the next row by doc_id (after the last: of the first); with `carried`,
    columns made of a text, also these and next_ of each.

    Rows are cut into ranges of doc_id and each range is sorted; only the first row of each range is looked up across ranges.
    """
    carried = carried or {}
    names = ["text", *carried]
    rows = docs.select(order_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = 4 * partitions(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], F.lit(max(10_000, 4 * n)))).first()[0] or []
    bounds = sorted(set(cuts))
    # The smallest key of each range, and with it the text that follows the range before.
    least = rows.select(range_bucket(F.col("k"), bounds).alias("range"), "k").groupBy("range").agg(F.min("k").alias("k"))
    heads = rows.join(F.broadcast(least), "k").groupBy("range").agg(F.min("text").alias("text"))
    order = Window.orderBy("range")  # over one row a range
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy(F.lit(0))))
    after = heads.select(before.alias("range"), "text").select("range", F.struct("text", *(f(F.col("text")).alias(c) for c, f in carried.items())).alias("after"))
    made = rows.select(range_bucket(F.col("k"), bounds).alias("range"), "k", "doc_id", "text", *(f(F.col("text")).alias(c) for c, f in carried.items()))
    here = Window.partitionBy("range").orderBy("k", "text")
    led = made.select("range", "doc_id", *names, *(F.lead(c).over(here).alias(f"next_{c}") for c in names))
    joined = led.join(after.hint("shuffle_hash"), "range", "left")
    return joined.select("doc_id", *names, *(F.coalesce(f"next_{c}", f"after.{c}").alias(f"next_{c}") for c in names))


def edited(text, other):
    """The text with the last floor(n / 2) code points replaced by the first as many (or all) of the other."""
    n = F.length(text)
    cut = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - cut), F.substr(other, F.lit(1), cut))


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    pairs = with_next(docs, {"fp": fingerprint})
    made = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited(F.col("text"), F.col("next_text")).alias("edited"))
    made = made.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return made.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
