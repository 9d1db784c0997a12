"""Order MinHash fingerprints of whole texts; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .scratch import Scratch

#: Symbols of a k-mer; the last ones of a text are shorter.
WIDTH = 3
#: Characters of a symbol at most; a longer word is several symbols.
SYMBOL = 24
#: Signatures of a fingerprint, as powers of two, and hex digits of each.
BINS_LOG, DIGITS = 5, 8
#: Bits for the place in the text, below the 35 bits of the k-mer's hash.
PLACE = 28
BLANK = "." * DIGITS

# Characters from U+0E00 on, where scripts without blanks lie, are symbols of their own.
_SYMBOLS = rf"[!-~\x{{A1}}-\x{{DFF}}]{{1,{SYMBOL}}}|\S"
_IN_BIN = 35 - BINS_LOG


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is made once however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def _places(text: Column) -> Column:
    """Hash and place of every k-mer in one long each, sorted: equal k-mers lie together, in text order."""

    def kmers(symbols):
        # A hash passes over nulls, so the last k-mers are shorter.
        own = lambda x, i: F.xxhash64(x, *(F.get(symbols, i + k) for k in range(1, WIDTH)))
        return F.transform(symbols, lambda x, i: F.shiftleft(F.shiftrightunsigned(own(x, i), 29), PLACE).bitwiseOR(i.cast("long")))

    hashed = F.transform(F.regexp_extract_all(text, F.lit(_SYMBOLS), F.lit(0)), lambda s: F.xxhash64(s))
    return F.sort_array(_bound(hashed, kmers))


def _kmer(x: Column) -> Column:
    return F.shiftright(x, PLACE)


def _bin(x: Column) -> Column:
    return F.shiftright(x, PLACE + _IN_BIN)


def _candidates(places: Column) -> Column:
    """The places that can be among the two least of their bin: the first two k-mers of each bin, and all k-mers that occur again."""

    def possible(s):
        def test(x, i):
            before, second, after = F.get(s, i - 1), F.get(s, i - 2), F.get(s, i + 1)
            # Of two places, the highest bit that differs tells whether bin or k-mer do.
            same = lambda a, b: a.bitwiseXOR(b) < 1 << PLACE
            return second.isNull() | (x.bitwiseXOR(second) >= 1 << (PLACE + _IN_BIN)) | same(before, x) | same(after, x) | same(second, before)

        return F.filter(s, test)

    return _bound(places, possible)


def _signature(state: Column) -> Column:
    """Hash of the chosen k-mers of a bin and their numbers, in text order."""
    place = lambda x: x.bitwiseAND((1 << PLACE) - 1)
    one, two = (_kmer(state["x1"]), state["n1"]), (_kmer(state["x2"]), state["n2"])
    value = F.when(state["x2"].isNull(), F.xxhash64(*one)).when(place(state["x1"]) < place(state["x2"]), F.xxhash64(*one, *two)).otherwise(F.xxhash64(*two, *one))
    return F.lower(F.substring(F.lpad(F.hex(value), 16, "0"), 1, DIGITS))


def _closed(state: Column) -> Column:
    """The fingerprint so far with the open bin's signature, blank for every empty bin before it."""
    gap = F.repeat(F.lit(BLANK), (state["bin"] - F.length(state["out"]) / DIGITS).cast("int"))
    return F.when(state["x1"].isNull(), state["out"]).otherwise(F.concat(state["out"], gap, _signature(state)))


def fingerprint(text: Column) -> Column:
    """2^``BINS_LOG`` signatures of ``DIGITS`` hex digits each.

    K-mers are numbered by occurrence; the hash of a k-mer says its bin, and
    a hash of k-mer and number its order there. The two least of a bin, put
    back in text order, make the bin's signature. So equal signatures need
    equal k-mers, of equal numbers, in equal order. An empty bin is blank.
    """
    none, zero = F.lit(None).cast("long"), F.lit(0)

    def state_of(last, number, place, first, second, out):
        """First and second: order, place and number of what is chosen in the open bin."""
        chosen = [v.alias(f"{name}{k}") for k, three in ((1, first), (2, second)) for name, v in zip("gxn", three, strict=True)]
        return F.struct(last.alias("last"), number.alias("number"), place.alias("bin"), *chosen, out.alias("out"))

    nothing = (none, none, zero)
    start = state_of(F.lit(-1).cast("long"), zero, F.lit(-1).cast("long"), nothing, nothing, F.lit(""))

    def step(state, x):
        one, two = (tuple(state[f"{name}{k}"] for name in "gxn") for k in (1, 2))

        def placed(head):
            own, known = (head["order"], x, head["number"]), (_kmer(x), head["number"], _bin(x))
            fresh = state_of(*known, own, nothing, _closed(state))
            first = state_of(*known, own, one, state["out"])
            second = state_of(*known, one, own, state["out"])
            same = state_of(*known, one, two, state["out"])
            return F.when(_bin(x) != state["bin"], fresh).when(own[0] < one[0], first).when(two[0].isNull() | (own[0] < two[0]), second).otherwise(same)

        number = F.when(_kmer(x) == state["last"], state["number"] + 1).otherwise(0)
        return _bound(number, lambda n: _bound(F.struct(n.alias("number"), _order(x, n).alias("order")), placed))

    whole = (1 << BINS_LOG) * DIGITS
    return F.rpad(F.aggregate(_candidates(_places(text)), start, step, _closed), whole, ".")


def _order(x: Column, number: Column) -> Column:
    """Place of an occurrence-numbered k-mer in the order of its bin; a first occurrence keeps the rest of its hash."""
    mask = (1 << _IN_BIN) - 1
    return F.when(number == 0, _kmer(x).bitwiseAND(mask)).otherwise(F.xxhash64(_kmer(x), number).bitwiseAND(mask))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among the bins that either has; 1 if neither has any."""
    parts = lambda f: F.regexp_extract_all(f, F.lit(f".{{{DIGITS}}}"), F.lit(0))
    filled = F.zip_with(parts(a), parts(b), lambda x, y: (x != BLANK) | (y != BLANK))
    equal = F.zip_with(parts(a), parts(b), lambda x, y: (x == y) & (x != BLANK))
    count = lambda flags: F.size(F.filter(flags, lambda t: t))
    return F.when(a == b, 1.0).otherwise(count(equal) / F.greatest(count(filled), F.lit(1)))


def _neighbours(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``key``, ``doc_id``, ``next``, ``need``: each document's successor and how much of it the edited text takes; whether rows repeat."""
    rows = scratch.keep(docs.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first(F.char_length("text")).alias("n_chars"), F.count("*").alias("copies")))
    placed = scratch.keep(ranked(rows, [], [F.desc_nulls_last("doc_id"), F.col("key")], scratch))
    after = placed.select(F.col("key").alias("next"), F.col("rank").alias("place"))
    links = placed.select("key", "doc_id", F.floor(F.col("n_chars") / 3).alias("need"), F.pmod(F.col("rank") + 1, F.col("total")).alias("place")).join(after, "place")
    return scratch.keep(links.select("key", "doc_id", "next", "need")), not rows.where("copies > 1").isEmpty()


def edited_texts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``key``, ``text``, ``edited`` of every row, and the ``key``, ``next`` of its neighbour.

    Whole texts are shuffled once; beside that only the beginnings that
    neighbours take move.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text), 256)
    plain = docs.select("doc_id", text.alias("text"), key.alias("key"))
    links, repeated = _neighbours(plain, scratch)
    # Both joins read these columns and no others, so that Spark makes one shuffle of them.
    dealt = plain.select("key", "text")
    asked = links.select(F.col("key").alias("asker"), F.col("doc_id"), F.col("next").alias("key"), "need")
    heads = dealt.join(asked, "key").select(F.col("asker").alias("key"), "doc_id", F.expr("substring(text, 1, int(need))").alias("head"))
    if repeated:
        heads = heads.dropDuplicates(["key"])
    size = F.char_length("text")
    stay = (size - F.floor(size / 3)).cast("int")
    edited = dealt.join(heads, "key").withColumn("_stay", stay).select("doc_id", "key", "text", F.concat(F.expr("substring(text, 1, _stay)"), F.col("head")).alias("edited"))
    return edited, links.select("key", "next")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document is the one with the next smaller id; the last one is
    followed by the first. Null ids come last; of equal ids the order is that
    of a hash of the texts. Rows that repeat id and text are one document and
    all get its results. A null text is empty; the fingerprint of an empty text
    is blank, equal to another blank one and unlike all others. Symbols are
    words, parts of very long words, and single characters from U+0E00 on; blanks between them do not count, every k-mer of them does. Other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    texts, links = edited_texts(docs, scratch)
    told = scratch.keep(texts.select(
        "doc_id", "key", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
    ))
    other = told.groupBy(F.col("key").alias("next")).agg(F.min("fingerprint").alias("next_fingerprint"))
    following = links.join(other, "next").select("key", "next_fingerprint")
    return told.join(following, "key").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
