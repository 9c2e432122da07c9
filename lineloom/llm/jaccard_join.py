"""Jaccard metric-space join on word shingles: regions, pivots, triangle windows, recursion on differences from the pivots."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import components, documents, most_frequent, small_side
from lineloom.session import discard, materialize

#: Words of a shingle and the least similarity in percent, as the near-duplicate query has them.
SHINGLE, PERCENT = 4, 85
#: Shingles in so many windows are ordered by that number behind all others, at most so many of the most common.
#: The order only decides which regions meet; any order gives the same links.
COMMON, MAX_COMMON = 3, 400_000
_SKETCH = "key {key}, n bigint, h1 bigint, h2 bigint, items array<bigint>"
_SEAT = ("cid", "x", "n", "pos", "early", "home", "root")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray, odd: np.uint64 = _ODD) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * odd
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, a text without words none."""
    import xxhash

    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    take = min(size, n)
    total = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        total = _mixed(total + hashes[k : n - take + 1 + k])
    return np.unique(total)


def _sketch(docs: DataFrame, text: str, key: str, size: int, choose) -> DataFrame:
    """``(key, n, h1, h2, items)``: set size, two hashes of the whole set, and what ``choose`` takes of the set."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                stop, held, sets = start, 0, []
                while stop < batch.num_rows and held < 1 << 19:
                    sets.append(shingle_set(batch.column(1)[stop].as_py(), size))
                    held, stop = held + len(sets[-1]) + 1, stop + 1
                items = [choose(s) for s in sets]
                ends = np.cumsum([0] + [len(x) for x in items], dtype=np.int32)
                columns = [
                    batch.column(0).slice(start, stop - start),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([_mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([_mixed(s, _OTHER).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(items).view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "h1", "h2", "items"])
                start = stop

    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, _SKETCH.format(key=kind))


def _window(percent: int, common: np.ndarray, counts: np.ndarray):
    """The first items of a set that every set similar enough must meet: rare before common, else by hash."""

    def choose(s: np.ndarray) -> np.ndarray:
        n = len(s)
        width = n - (percent * n + 99) // 100 + 1 if n else 0
        if len(common) and n:
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            s = s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")]
        return s[:width]

    return choose


def _whole(s: np.ndarray) -> np.ndarray:
    return s


def _nothing(s: np.ndarray) -> np.ndarray:
    return s[:0]


def _wanted(sets: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The sets of the ``n`` rows of ``ids``, so that no other set is shuffled."""
    return sets.join(small_side(ids.toDF("cid").distinct(), n), "cid", "left_semi")


class _Distances:
    """Whether asked pairs are linked, each found once, exactly, on the whole sets."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.known: DataFrame | None = None

    def ask(self, pairs: DataFrame) -> None:
        """``pairs(a, b)``: a the pivot."""
        pairs = pairs.select("a", "b").distinct()
        if self.known is not None:
            pairs = pairs.join(self.known.select("a", "b"), ["a", "b"], "left_anti")
        pairs, seen = materialize(pairs, "jaccard-pairs", n=F.count(F.lit(1)))
        left = _wanted(self.sets, pairs.select("a"), seen["n"]).select(F.col("cid").alias("a"), F.col("items").alias("x"))
        right = _wanted(self.sets, pairs.select("b"), seen["n"]).select(F.col("cid").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        found = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("any"))
        found = found.select("a", "b", (100 * F.col("both") >= self.percent * F.col("any")).alias("linked"))
        found, _ = materialize(found, "jaccard-distances")
        self.known = found if self.known is None else self.known.unionByName(found)

    def links(self) -> DataFrame:
        return self.known.where("linked").select("a", "b")


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of the exact Jaccard join.

    ``members`` has one row per row of ``docs``: ``key``, ``n`` (set size), ``cid`` (class of equal sets; null
    without words) and ``root`` (smallest class reachable by links).  ``links(a, b)`` holds verified links
    between classes that connect every component; pairs already connected need not be listed.

    1. Rows with equal shingle sets form a class; from here on a class is one document.
    2. Far documents never meet.  Two sets that are similar enough share one of the
       few first items of either in a common order, so each set enters the regions of
       those items only.  Common items come last in the order, so a shared passage opens
       few regions.  A region of two is one pair; larger ones are split by set size.
    3. Each region's pivot meets all others, on the whole sets.  Members linked to it are so connected.
    4. A region whose members are all connected is done.  In any other, what a member and the pivot do not have in common
       parts members that lie at the same distance from it: with x and y such differences, two members have
       x + y less twice the common ones between them, so linked ones that are not both linked to the pivot share a
       difference, among the first few of both in the order of their frequency.  So members enter new regions by
       the first of their differences (see ``_differences``).
    5. Each new region's pivot meets whom it may be linked to, which connects most of what belongs together; then all others
       that may still be linked meet, as far as they are not connected.

    Null texts count as empty; texts without words link with nothing.  Rows with null keys and repeated rows
    are classed by text like any other.  An empty table gives empty results.
    """
    spark = docs.sparkSession
    sketch, _ = materialize(_sketch(docs, text, key, size, _window(percent, np.zeros(0, np.uint64), np.zeros(0, np.int64))), "jaccard-sketch")
    classes = sketch.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("key").alias("least"))
    classes, _ = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")

    #: What a class and one of its rows have in common; as part of a struct, null keys are equal.
    same_row = ["n", "h1", "h2", "row"]

    def of_classes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """``(n, h1, h2, row, items, cid)``: the items of one row of each wanted class; rows that repeat it come again."""
        c = wanted.select("n", "h1", "h2", F.struct(F.col("least").alias("key")).alias("row"), "cid")
        return rows.select("n", "h1", "h2", F.struct("key").alias("row"), "items").join(c, same_row)

    firsts = of_classes(sketch, classes).select("cid", F.explode("items").alias("item")).distinct()
    often = firsts.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    often, _ = materialize(often, "jaccard-often")
    often = most_frequent(often, "n", MAX_COMMON).toArrow()  # an order, not a filter
    common = often["item"].to_numpy().astype(np.int64).view(np.uint64)
    place = np.argsort(common)
    choose = _window(percent, common[place], often["n"].to_numpy().astype(np.int64)[place])
    keyed, _ = materialize(sketch.select("key", "n", "h1", "h2"), "jaccard-keys")
    discard(sketch)

    seats = of_classes(_sketch(docs, text, key, size, choose), classes)
    seats, _ = materialize(seats.select("cid", "n", F.posexplode("items").alias("pos", "rid")), "jaccard-seats")
    regions = seats.groupBy("rid").agg(
        F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.min(F.col("n") - F.col("pos")).alias("rest"), F.max(_at_home(percent)).alias("any"),
    )
    # Two members of too different sizes, or with too few items from the shared one on, can't be linked there.
    able = (100 * F.col("least") >= percent * F.col("most")) & ((100 + percent) * F.col("rest") >= percent * (F.col("least") + F.col("most")))
    regions = regions.where("lo != hi").where(F.when(F.col("m") > 2, F.col("any")).otherwise(able))
    regions, seen = materialize(regions.select("rid", "lo", "hi", "m"), "jaccard-regions", crowds=F.count_if(F.col("m") > 2))
    two = regions.where("m = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
    crowd = seats.join(small_side(regions.where("m > 2").select("rid"), seen["crowds"]), "rid", "left_semi")
    crowd, _ = materialize(crowd, "jaccard-crowd")
    discard(seats)
    rows, _ = materialize(_size_bands(crowd, percent), "jaccard-crowds")
    met = two.select(F.explode(F.array("a", "b")).alias("cid")).union(rows.select(F.explode(F.array("cid", "p")).alias("cid")))
    asked, seen = materialize(met.distinct(), "jaccard-met", n=F.count(F.lit(1)))
    wanted = classes.join(asked, "cid", "left_semi")
    members = docs.join(
        small_side(wanted.select(F.col("least").alias("_least")).distinct(), seen["n"]), docs[key].eqNullSafe(F.col("_least")), "left_semi"
    )
    # By the columns that the join has dealt rows by, which spares a shuffle of whole sets.
    sets = of_classes(_sketch(members, text, key, size, _whole), wanted).dropDuplicates(same_row)
    sets, _ = materialize(sets.select("cid", "items"), "jaccard-sets")

    distances = _Distances(sets, percent)
    distances.ask(two.union(rows.select(F.col("p").alias("a"), F.col("cid").alias("b"))))
    roots = components(distances.links(), "jaccard")
    rows, left = _open_regions(rows, roots)
    if left:
        seats = _differences(rows, sets, percent)
        distances.ask(_may_link(seats, _first_seats(seats), percent))
        seats, left = _open_seats(seats, components(distances.links(), "jaccard"))
    if left:
        distances.ask(_may_link(seats, seats.where("early"), percent, F.struct("x", "cid") > F.struct("x2", "cid2")))
        roots = components(distances.links(), "jaccard")
    named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        F.col("cid"), F.coalesce("root", "cid").alias("root"), F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2")
    )
    keyed = keyed.join(named, (keyed["n"] == named["cn"]) & (keyed["h1"] == named["c1"]) & (keyed["h2"] == named["c2"]), "left")
    return keyed.select("key", "n", "cid", "root"), distances.links()


def _at_home(percent: int) -> Column:
    """Whether so much of a set follows a seat that it can be the smaller one of a pair that first meets there."""
    return (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")


def _size_bands(crowd: DataFrame, percent: int) -> DataFrame:
    """``(rid, cid, home, p)``: regions split by set size, each with its first pivot ``p``.

    Sizes of linked sets differ by the factor ``percent``/100 at most, so with bands of that factor the larger set lies in
    the smaller one's band or in the next: every member enters its own band and, as a boundary document, the
    one below.  The smaller set of a pair holds so many of the shared items that at least its share of
    two equal sets follows the first shared one; members with that many are at home.  Any other member
    must have enough for the smallest set at home.  A pair needs a member at home.  The pivot is the member at home
    with the fewest rarer items, which is the one in the middle where all are edits of one text; among equals
    the smallest, so that regions share pivots.
    """
    width = -math.log(percent / 100) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / width)
    rest = F.col("n") - F.col("pos")
    places = F.array(
        F.struct(band.alias("band"), _at_home(percent).alias("home")), F.struct((band - 1).alias("band"), F.lit(False).alias("home"))
    )
    spread = crowd.select("rid", "cid", "n", "pos", rest.alias("rest"), F.inline(places))
    spread = spread.select(F.xxhash64("rid", "band").alias("rid"), "cid", "n", "pos", "rest", "home")
    first = spread.groupBy("rid").agg(
        F.min_by("cid", F.when(F.col("home"), F.struct("pos", "cid"))).alias("p"), F.min(F.when(F.col("home"), F.col("n"))).alias("least"),
        F.min("cid").alias("lo"), F.max("cid").alias("hi"),
    )
    first = first.where("lo != hi AND least IS NOT NULL").select("rid", "p", "least")
    rows = spread.join(first, "rid").where("cid != p")
    enough = F.col("home") | ((100 + percent) * F.col("rest") >= percent * (F.col("least") + F.col("n")))
    return rows.where(enough).select("rid", "cid", "home", "p")


def _open_regions(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Rows of regions with members of several components, with their component; and how many there are."""
    now = rows.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    open_ = now.groupBy("rid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("home").alias("any"))
    now = now.join(open_.where("lo != hi AND any").select("rid"), "rid", "left_semi")
    now, seen = materialize(now, "jaccard-open", n=F.count(F.lit(1)))
    return now, seen["n"] or 0


def _differences(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(p, item, cid, x, n, pos, early, home, root)``: members by the first of the ``x`` items that only they or only their pivot has.

    Two members with differences x and y from the pivot, c of them common, differ by x + y - 2c items.  Linked sets of a and b items
    differ by at most (100 - percent) (a + b) / (100 + percent), where b is at most 100 a / percent.  This bounds c from below, and so
    from above the place ``pos`` of the first common item in either difference: the member with more differences has it
    within the most that may part it from another set, the one with fewer (``early``) within half of that.  A member linked to
    the pivot needs a partner that is not.  Differences of one member only come first in the order and open no region.
    """
    most, total = 100 - percent, 100 + percent
    members = rows.groupBy("p", "cid").agg(F.max("home").alias("home"), F.min("root").alias("root"))
    members, seen = materialize(members, "jaccard-pivots", n=F.count(F.lit(1)))
    center = _wanted(sets, members.select("p"), seen["n"]).select(F.col("cid").alias("p"), F.col("items").alias("center"))
    whole = members.join(_wanted(sets, members.select("cid"), seen["n"]), "cid").join(center, "p")
    apart = F.concat(F.array_except("items", "center"), F.array_except("center", "items"))
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("items", "n"), ("center", "pn"), ("apart", "x"))]
    apart, _ = materialize(whole.withColumn("apart", apart).select("p", "cid", "home", "root", *sizes, "apart"), "jaccard-apart")
    each = apart.select("p", "cid", F.explode("apart").alias("item"))
    often = each.groupBy("p", "item").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    ranked = each.join(often, ["p", "item"]).groupBy("p", "cid").agg(F.sort_array(F.collect_list(F.struct("m", "item"))).alias("ranked"))
    plain = apart.drop("apart")
    seats = plain.join(ranked, ["p", "cid"]).select(*plain.columns, F.size("ranked").alias("shared"), F.posexplode("ranked").alias("at", "seat"))
    seats = seats.withColumn("pos", F.col("x") - F.col("shared") + F.col("at")).withColumn("early", 2 * percent * F.col("pos") <= most * F.col("n"))
    linked = total * F.col("x") <= most * (F.col("n") + F.col("pn"))
    enough = 2 * total * (F.col("x") - F.col("pos")) > total * F.col("x") + most * (F.col("pn") - F.col("n"))
    seats = seats.where(percent * F.col("pos") <= most * F.col("n")).where(~linked | enough)
    return materialize(seats.select("p", F.col("seat.item").alias("item"), *_SEAT), "jaccard-differences")[0]


def _first_seats(seats: DataFrame) -> DataFrame:
    """The pivot of each region of differences: the early member with the fewest rarer ones."""
    pivot = F.min_by(F.struct(*_SEAT), F.struct("pos", "x", "cid"))
    return seats.where("early").groupBy("p", "item").agg(pivot.alias("pivot")).select("p", "item", "pivot.*")


def _open_seats(seats: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Seats of regions with members of several components, with their component; and how many there are."""
    named = roots.select(F.col("node").alias("cid"), F.col("root").alias("now"))
    seats = seats.join(named, "cid", "left").withColumn("root", F.coalesce("now", "cid")).drop("now")
    open_ = seats.groupBy("p", "item").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    seats, seen = materialize(seats.join(open_.select("p", "item"), ["p", "item"], "left_semi"), "jaccard-open", n=F.count(F.lit(1)))
    return seats, seen["n"] or 0


def _may_link(seats: DataFrame, others: DataFrame, percent: int, which: Column | None = None) -> DataFrame:
    """``(a, b)``: a seat and one of ``others`` (columns with a 2) of the same region that may be linked, by the bounds of ``_differences``."""
    most, total = 100 - percent, 100 + percent
    others = others.select("p", "item", *[F.col(c).alias(f"{c}2") for c in _SEAT])
    common = F.least(F.col("x") - F.col("pos"), F.col("x2") - F.col("pos2"))
    may = (F.col("root") != F.col("root2")) & (F.col("home") | F.col("home2"))
    may &= percent * F.greatest("n", "n2") <= 100 * F.least("n", "n2")
    may &= 2 * total * common >= total * (F.col("x") + F.col("x2")) - most * (F.col("n") + F.col("n2"))
    if which is not None:
        may &= which
    return seats.join(others, ["p", "item"]).where(may).select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (smallest key reachable by links, itself included) per row.

    A text without words is its own component.  A component of null keys only has a null id.
    """
    members, _ = jaccard_classes(docs, text, key, size, percent)
    members, _ = materialize(members, "jaccard-members")
    least = members.where("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("component_id"))
    joined = members.where("root IS NOT NULL").join(least, "root").select("key", "n", "component_id")
    alone = members.where("root IS NULL").select("key", "n", F.col("key").alias("component_id"))
    return joined.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the smallest key of every component; texts without words stay.

    Of rows that repeat a kept key one stays.
    """
    near = near_duplicates(docs, text, key, size, percent).where(F.col(key).eqNullSafe(F.col("component_id")))
    kept = near.groupBy(F.col(key).alias("_keep")).agg(F.count(F.lit(1)).alias("_rows"))
    joined = docs.join(kept, docs[key].eqNullSafe(F.col("_keep")))
    once = joined.where("_rows = 1 OR _keep IS NULL").select(*[docs[c] for c in docs.columns])
    return once.unionByName(joined.where("_rows > 1").dropDuplicates([key]).select(*docs.columns))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
