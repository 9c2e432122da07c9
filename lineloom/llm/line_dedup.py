"""Near-duplicate lines by a deletion-neighbourhood join on hashed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom.functions.let import let
from lineloom.llm.common import documents, text_of, words_of
from lineloom.session import materialize

#: Lines with fewer words match only when equal; longer ones within one edited word.
MIN_WORDS = 8
#: Position hashes are summed; 2**40 leaves room for millions of words.
_ROOM = 1 << 40
#: Hash buckets that are sent to every executor to leave out lines before a shuffle.
BUCKETS = 1 << 20


def text_lines(docs: DataFrame, text: str, key: str, mark: Sequence[Column] = ()) -> DataFrame:
    """``(key, line, place, words, n, h1, h2)``: every line with a word; ``place`` orders lines by key, then number.

    ``mark`` may add one column ``mark`` computed from ``docs``.
    """
    marks = ["mark"] * len(mark)
    lines = docs.select(F.col(key).alias("key"), *mark, F.posexplode(F.split(text_of(text), "\n")).alias("line", "body"))
    lines = lines.select("key", "line", *marks, words_of(F.col("body")).alias("words")).where(F.size("words") > 0)
    joined = F.array_join("words", " ")
    # Null keys come first; a line number has 31 bits.
    wide = F.coalesce(F.col("key").cast("decimal(28,0)"), F.lit(-(1 << 63)).cast("decimal(28,0)"))
    place = (wide * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")).cast("decimal(38,0)")
    return lines.select(
        "key", "line", *marks, place.alias("place"), "words", F.size("words").alias("n"),
        F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit(7), joined).alias("h2"),
    )


def half_keys() -> Column:
    """Keys of the unedited half: of two lines within one edit, the first or the last half of the shorter is in both.

    A line stands as the shorter of a pair (its own length) and as the longer (one less).
    """

    def half(short: Column, tag: int) -> list[Column]:
        h = F.floor(short / 2).cast("int")
        return [
            F.xxhash64(F.lit(2 * tag), short, F.array_join(F.slice("words", F.lit(1), h), " ")),
            F.xxhash64(F.lit(2 * tag + 1), short, F.array_join(F.slice("words", F.col("n") - h + 1, h), " ")),
        ]

    return F.array(*half(F.col("n"), 0), *half(F.col("n") - 1, 0))


def variant_keys(lines: DataFrame) -> DataFrame:
    """``(lid, k, m)``: hashed keys of each line's deletion neighbourhood, m words long.

    A variant is the line without its i-th word, or the whole line split after i words.  Its key holds
    the hash of the words before, the hash of the words after and both counts, so two lines
    that share a key differ in at most the one word at that place.  The hashes are sums of
    word hashes by position, running from either end, so a line of n words costs n steps.
    A line that shares only its first half with others can only be edited behind it, and the other
    way round, so only variants of that part are emitted.
    """
    words = lines.select("lid", "n", "fore", "aft", F.posexplode(F.split("joined", " ")).alias("i", "word"))
    words = words.select("lid", "n", "fore", "aft", "i", F.xxhash64("word").alias("w"))

    def hashes(position: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), position, "w"), F.lit(_ROOM))

    run = W.partitionBy("lid").orderBy("i")
    i, n = F.col("i"), F.col("n")
    upto, whole = run.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("lid")
    placed = words.repartition("lid").select(
        "*", hashes(i, 1).alias("a"), hashes(i, 2).alias("b"), hashes(n - i, 3).alias("c"), hashes(n - i, 4).alias("d")
    )
    sums = placed.select(
        "*", F.sum("a").over(upto).alias("pa"), F.sum("b").over(upto).alias("pb"),
        (F.sum("c").over(whole) - F.sum("c").over(upto)).alias("sc"), (F.sum("d").over(whole) - F.sum("d").over(upto)).alias("sd"),
    )
    half = F.floor((n - 1) / 2)
    sums = sums.where((F.col("fore") & (i >= half - 1)) | (F.col("aft") & (i <= n - half)))

    def key(before_a, before_b, after_c, after_d, split, rest):
        parts = (before_a, before_b, after_c, after_d, split.cast("int"))
        return F.struct(F.xxhash64(*parts).alias("k"), rest.cast("int").alias("m"))

    gone = key(F.col("pa") - F.col("a"), F.col("pb") - F.col("b"), F.col("sc"), F.col("sd"), i, n - 1)
    split = key(F.col("pa"), F.col("pb"), F.col("sc"), F.col("sd"), i + 1, n)
    start = key(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("sc") + F.col("c"), F.col("sd") + F.col("d"), F.lit(0), n)
    variants = F.when(i == 0, F.array(gone, split, start)).otherwise(F.array(gone, split))
    return sums.select("lid", F.inline(variants))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether word arrays differ by one word put in, left out or replaced (or not at all)."""
    short = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: x == y)
    p = F.array_position(same, False).cast("int")
    p = F.when(p == 0, short + 1).otherwise(p)
    rest = lambda w, at: F.array_join(F.slice(w, at, F.greatest(F.size(w) - at + 1, F.lit(0))), " ")
    return (
        F.when(F.size(a) == F.size(b), rest(a, p + 1) == rest(b, p + 1))
        .when(F.size(a) == F.size(b) + 1, rest(a, p + 1) == rest(b, p))
        .when(F.size(a) + 1 == F.size(b), rest(a, p) == rest(b, p + 1))
        .otherwise(False)
    )


def line_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, mark: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """``(places, classes)``: every line's place and hashes, and the distinct lines that do not stay everywhere.

    ``places(key, line, n, place, h1, h2)`` is written in the one pass that hashes all lines;
    ``classes`` has ``(h1, h2, first, near)``.

    ``first`` is the earliest place of the line; ``near`` the earliest place of a line within one edited word
    that stands before it, or null.  Halves of lines are counted first: a line can only
    have a neighbour if one of its half keys is also another line's.  Only those lines
    emit their neighbourhoods; a key's earliest line is found by aggregation, so lines
    of a group are never paired with each other, and the edit distance to the earliest is then verified on
    the words themselves.
    """
    lines, marks = text_lines(docs, text, key, mark), ["mark"] * len(mark)
    keyed = lines.select("key", "line", *marks, "h1", "h2", "place", "n", F.when(F.col("n") >= min_words, half_keys()).alias("halves"))
    places, _ = materialize(keyed.select("*", *[F.get("halves", F.lit(j)).alias(f"half{j}") for j in range(4)]).drop("halves"), "lines-places")
    halves = [F.min(f"half{j}").alias(f"half{j}") for j in range(4)]
    distinct, _ = materialize(places.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"), *halves), "lines-distinct")
    halves = F.posexplode(F.array("half0", "half1", "half2", "half3")).alias("which", "half")
    open_ = distinct.where("half0 IS NOT NULL").select("h1", "h2", "first", halves)
    shared = open_.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("half")
    met = open_.join(shared, "half", "left_semi").groupBy("h1", "h2", "first")
    met = met.agg(F.max(F.col("which") % 2 == 0).alias("fore"), F.max(F.col("which") % 2 == 1).alias("aft"))
    met, _ = materialize(met, "lines-suspects")
    # A bounded set of hash buckets keeps most other lines' words out of the shuffle; the join behind it is exact.
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS))
    near_by = met.select(bucket(F.col("h1")).alias("bucket")).distinct()
    ours = met.select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "first", "fore", "aft")
    texts = lines.select("h1", "h2", "place", "n", F.array_join("words", " ").alias("joined"), bucket(F.col("h1")).alias("bucket"))
    texts = texts.join(F.broadcast(near_by), "bucket", "left_semi")
    bodies = texts.join(ours, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("place") == F.col("first")))
    # Repeated rows repeat a place; one of them speaks for the line.  Numbers follow the places.
    bodies = bodies.select("h1", "h2", "place", "n", "fore", "aft", "joined").dropDuplicates(["h1", "h2"]).orderBy("place")
    bodies, _ = materialize(bodies.withColumn("lid", F.monotonically_increasing_id()), "lines-bodies")
    keys, _ = materialize(variant_keys(bodies), "lines-variants")
    earliest = keys.groupBy("k", "m").agg(F.min("lid").alias("near"), F.max("lid").alias("last")).where("near != last")
    near = keys.join(earliest.select("k", "m", "near"), ["k", "m"]).where("near < lid")
    near = near.groupBy("lid").agg(F.min("near").alias("near"))
    body = bodies.select("lid", "h1", "h2", F.split("joined", " ").alias("words"))
    other = bodies.select(F.col("lid").alias("near"), F.col("place").alias("near_place"), F.split("joined", " ").alias("others"))
    checked = near.join(body, "lid").join(other, "near").where(within_one_edit(F.col("words"), F.col("others")))
    checked = checked.select("h1", "h2", F.col("near_place").alias("near"))
    marked = distinct.select("h1", "h2", "first", "rows").join(checked, ["h1", "h2"], "left")
    return places.select("key", "line", *marks, "n", "place", "h1", "h2"), marked.where("rows > 1 OR near IS NOT NULL")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, mark: Sequence[Column] = ()) -> DataFrame:
    """One row per line with a word: key, ``line`` (from 0), ``n_words``, ``kept``, ``keep_id``, ``keep_line``, ``near``.

    Lines are equal when their words are; lines of ``min_words`` words or more also match within one
    edited word (put in, left out or replaced).  A line goes when an earlier line (by key,
    then line number; null keys first) matches it; ``keep_id`` and ``keep_line`` name the
    earliest match, and ``near`` tells that it is not equal.  Rows that repeat key and text
    stand at the same places and are treated alike.  Null or empty texts and blank lines give no rows.  ``mark`` may add one
    column ``mark`` computed from ``docs``.
    """
    places, classes = line_classes(docs, text, key, min_words, mark)
    classes, _ = materialize(classes, "lines-classes")
    joined = places.join(classes, ["h1", "h2"], "left")
    # A copy of a near duplicate may stand before the near one's match; the earliest of all decides.
    best = F.least("first", "near")
    best = F.when(F.col("first").isNull() | (best >= F.col("place")), F.col("place")).otherwise(best)
    span = F.lit(1 << 31).cast("decimal(10,0)")
    kept = best == F.col("place")
    line = F.pmod(best, span).cast("int")
    keep = ((best - F.pmod(best, span)) / span).cast("decimal(28,0)")
    return joined.select(
        F.col("key").alias(key), "line", *["mark"] * len(mark), F.col("n").alias("n_words"), kept.alias("kept"),
        F.when(kept, F.col("key")).when(keep != F.lit(-(1 << 63)), keep.cast("long")).alias("keep_id"), line.alias("keep_line"),
        (~kept & F.coalesce(best == F.col("near"), F.lit(False))).alias("near"),
    )


def without_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated lines cut from the texts; a document that loses every line with a word goes.

    Documents without a word and blank lines stay as they are.  Rows are told apart by key and text: of rows that repeat a
    key with other texts each loses its own lines only; rows that repeat both are treated alike.
    """
    digest = F.xxhash64(text_of(text))
    lines = dedup_lines(docs, text, key, min_words, mark=[digest.alias("mark")])
    cut = lines.groupBy(F.col(key).alias("_key"), F.col("mark").alias("_mark")).agg(
        F.collect_set(F.when(~F.col("kept"), F.col("line"))).alias("_cut"), F.max("kept").alias("_any")
    )
    cut = cut.where("size(_cut) > 0")
    whole = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    joined = docs.join(cut, docs[key].eqNullSafe(cut["_key"]) & (whole == cut["_mark"]), "left")
    joined = joined.where(cut["_any"].isNull() | cut["_any"])

    def rest(parts: Column) -> Column:
        """The lines that stay, by their numbers: one look at each, however many are cut."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), cut["_cut"])
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    body = F.when(cut["_any"].isNull(), docs[text]).otherwise(let(F.split(docs[text], "\n"), rest))
    return joined.select(*[body.alias(c) if c == text else docs[c] for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", F.col("line").cast("long").alias("line"), F.col("n_words").cast("long").alias("n_words"), "kept",
        F.col("keep_id"), F.col("keep_line").cast("long").alias("keep_line"), "near",
    )
