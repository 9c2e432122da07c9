"""Mixing sources to target weights by packed blocks, multinomial draws and index permutations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom.functions.let import let
from lineloom.llm.common import SPACE, WORD, documents, text_of, word_count
from lineloom.session import materialize

#: Words of a packed block, slots of an output shard, and stripes that split a source's running sum.
BLOCK, SHARD_SLOTS, STRIPES = 64, 1024, 1024
#: Times a source may be repeated.
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20240501
#: Slots that one task draws, and the most tasks.
SLOTS_PER_TASK, MAX_TASKS = 200_000, 20_000
#: Rounds of the index permutation.
ROUNDS = 12


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)``: shares of the whole by weight, capped at ``max_repeats`` sizes.

    Sources are ordered by code point, null last, and take the weights in turn.  With a
    common level L every source gets min(cap, weight * L); the level that spends the whole
    is found by ordering sources by cap / weight: those before the breaking point are
    capped, the rest share what is left by weight.  ``sizes(source, source_size)`` has one
    row per source, which is the only size that matters to the windows here.
    """
    ranked = sizes.withColumn("turn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    picked = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(picked, F.col("turn") % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_repeats))
    ranked = ranked.withColumn("level", F.col("cap") / F.col("weight"))
    before = W.orderBy("level", "turn").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("level", "turn").rowsBetween(0, W.unboundedFollowing)
    ranked = ranked.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("left_weight", F.sum("weight").over(after))
    ranked = ranked.withColumn("whole", F.sum("source_size").over(W.partitionBy()))
    ranked = ranked.withColumn("rate", (F.col("whole") - F.col("spent")) / F.col("left_weight"))
    # The first source whose own level is not below the rate of the remaining sets the rate for all after it.
    ranked = ranked.withColumn("free", F.col("level") >= F.col("rate"))
    rate = F.min(F.when(F.col("free"), F.struct("level", "turn", "rate"))).over(W.partitionBy())["rate"]
    ranked = ranked.withColumn("rate", rate)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce("rate", F.lit(float("inf"))))
    return ranked.select("source", "source_size", target.alias("target"))


def permuted(index: Column, size: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0..size-1 by swap-or-not rounds keyed by ``keys``."""

    def swap(i: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(*keys, r, F.lit(1)), size) - i
        partner = F.when(partner < 0, partner + size).otherwise(partner)
        return F.when(F.pmod(F.xxhash64(*keys, r, F.greatest(i, partner)), F.lit(2)) == 1, partner).otherwise(i)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index.cast("long"), swap)


def packed(docs: DataFrame, text: str, key: str, source: str, seed: int, stripes: int, row: str | None = None) -> DataFrame:
    """``(row, key, source, size, start, source_size)``: where each document's words stand in its source's stream.

    The running sum of a source is split into stripes by a hash of the key, so that no
    source, however large, is summed by one task: sums of stripes, then sums within.
    Rows of one key stand in the order of a hash of their texts.  ``row`` is the column of that name, or
    a number given here; it tells rows of one key apart.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    body = F.xxhash64(F.lit(seed), text_of(text))
    sized = docs.select(number.alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), word_count(text_of(text)).alias("size"), body.alias("body"))
    sized = sized.withColumn("stripe", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(stripes)))
    sized, _ = materialize(sized, "mix-sizes")
    stripe_sizes = sized.groupBy("source", "stripe").agg(F.sum("size").alias("stripe_size"))
    upto = W.partitionBy("source").orderBy("stripe").rowsBetween(W.unboundedPreceding, -1)
    offsets = stripe_sizes.select(
        F.col("source").alias("s"), F.col("stripe").alias("t"),
        F.coalesce(F.sum("stripe_size").over(upto), F.lit(0)).alias("offset"),
        F.sum("stripe_size").over(W.partitionBy("source")).alias("source_size"),
    )
    within = W.partitionBy("source", "stripe").orderBy("key", "body", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(offsets, placed["source"].eqNullSafe(offsets["s"]) & (placed["stripe"] == offsets["t"]))
    return joined.select("row", "key", "source", "size", (F.col("offset") + F.col("inner")).alias("start"), "source_size")


def mixture_slots(targets: DataFrame, words: int, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``(shard, slot, source, block, repeat)``: the mix as slots, each holding one block of one source.

    A source of n blocks gets round(target / words per block) draws.  All draws are shuffled over all
    slots by one permutation, so the sources' counts in a shard of ``shard_slots`` slots are a
    multinomial draw given the totals, and totals keep the targets.  The k-th draw of a source takes block
    permutation(k mod n): every block is used once before any is used again, under a new
    permutation each time.  ``words`` is the size of the mix and sets the number of tasks.
    """
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    drawn = F.least(F.round(F.col("target") * blocks / F.col("source_size")), blocks * MAX_REPEATS).cast("long")
    plan = targets.where("source_size > 0").select("source", blocks.alias("blocks"), drawn.alias("draws"))
    plan = plan.withColumn("before", F.coalesce(F.sum("draws").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    plan = plan.withColumn("all", F.sum("draws").over(W.partitionBy())).where("draws > 0")
    # One row per run of draws, spread over the tasks, then one per draw.
    runs = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / 4096).cast("long"))).alias("run"))
    tasks = max(2 * targets.sparkSession.sparkContext.defaultParallelism, words // block // SLOTS_PER_TASK)
    runs = runs.repartition(min(tasks, MAX_TASKS), "source", "run")
    first = F.col("run") * 4096
    draws = runs.select("*", F.explode(F.sequence(first, F.least(first + 4095, F.col("draws") - 1))).alias("draw"))
    repeat = F.floor(F.col("draw") / F.col("blocks")).cast("long")
    place = permuted(F.col("before") + F.col("draw"), F.col("all"), F.lit(seed))
    return draws.select(
        F.floor(place / shard_slots).cast("long").alias("shard"),
        (place % shard_slots).alias("slot"),
        "source",
        permuted(F.col("draw") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.coalesce("source", F.lit("")), repeat).alias("block"),
        repeat.alias("repeat"),
    )


def _dealt(docs: DataFrame, text: str, key: str, source: str, weights: Sequence[float], block: int, seed: int, stripes: int, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packed documents, targets, and the spans of documents in every slot."""
    placed, _ = materialize(packed(docs, text, key, source, seed, stripes, row), "mix-packed")
    sizes = placed.groupBy("source").agg(F.max("source_size").alias("source_size"))
    targets, seen = materialize(source_targets(sizes, weights), "mix-targets", words=F.sum("source_size"))
    slots = mixture_slots(targets, seen["words"] or 0, block, seed=seed)
    start, size = F.col("start"), F.col("size")
    blocks = F.sequence(F.floor(start / block).cast("long"), F.floor((start + size - 1) / block).cast("long"))
    spans = placed.where("size > 0").select("row", "key", F.col("source").alias("s"), "start", "size", F.explode(blocks).alias("b"))
    low, high = F.greatest(F.col("b") * block, start), F.least((F.col("b") + 1) * block, start + size)
    spans = spans.select("row", "key", "s", "b", (low - F.col("b") * block).alias("at"), (low - start).alias("first"), (high - low).alias("words"))
    # The planner can't know how many slots come from a few targets: without the hint it would broadcast them.
    slots = slots.hint("merge")
    dealt = spans.join(slots, spans["s"].eqNullSafe(slots["source"]) & (spans["b"] == slots["block"]))
    return placed, targets, dealt.select("shard", "slot", "source", "block", "repeat", "at", "row", "key", "first", "words")


def mixed_blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, block: int = BLOCK, seed: int = SEED, stripes: int = STRIPES) -> DataFrame:
    """The mix itself: ``(shard, slot, source, block, repeat, at, key, first, words)``, one row per document span of a slot.

    A slot holds one block of one source; the block's words are those of its spans in the order of ``at``, their
    place in the block.  A span is ``words`` words of the document from its word ``first`` (0 is the first) on.
    ``repeat`` counts how often the source had been used up before.
    """
    return _dealt(docs, text, key, source, weights, block, seed, stripes)[2].withColumnRenamed("key", "_key").drop("row").select(
        "shard", "slot", F.col("source").alias(source), "block", "repeat", "at", F.col("_key").alias(key), "first", "words"
    )


def mix_sources(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, block: int = BLOCK, seed: int = SEED, stripes: int = STRIPES) -> DataFrame:
    """One row per document: key, source, ``size``, ``source_size``, ``target``, ``taken`` and ``times``.

    ``taken`` is the number of the document's words in the mix, repeats counted: the sum over its spans in
    all slots (``mixed_blocks``).  ``times`` is how often the block with the document's first word is drawn.  No
    block is drawn more than ``MAX_REPEATS`` times.  Null and empty texts have size 0 and
    nothing taken; a null source is a source of its own; equal seeds give equal mixes, whatever the
    partitioning.  Rows that repeat a key are packed side by side.
    """
    placed, targets, dealt = _dealt(docs, text, key, source, weights, block, seed, stripes)
    drawn = dealt.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("taken"), F.count_if(F.col("first") == 0).alias("times"))
    taken = placed.join(drawn, placed["row"] == drawn["r"], "left")
    t = targets.select(F.col("source").alias("s"), F.col("source_size").alias("whole"), "target")
    joined = taken.join(t, taken["source"].eqNullSafe(t["s"]))
    none = F.lit(0).cast("long")
    return joined.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        F.coalesce("taken", none).alias("taken"), F.coalesce("times", none).alias("times"),
    )


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, block: int = BLOCK, seed: int = SEED, stripes: int = STRIPES) -> DataFrame:
    """The drawn parts of ``docs``: rows with the same columns whose text is what the mix holds of the row's text.

    Of each repeat, neighbouring drawn blocks of a document make one part, with the white space between its words and
    after them, so a document drawn whole comes back whole.  Other columns are those of the document.  Rows
    without words can't be drawn; rows that repeat a key are told apart.
    """
    numbered, _ = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-texts")
    _, _, dealt = _dealt(numbered, text, key, source, weights, block, seed, stripes, "_row")
    order = W.partitionBy("row", "repeat").orderBy("block")
    runs = dealt.select("row", "repeat", "first", "words", (F.col("block") - F.row_number().over(order)).alias("run"))
    runs = runs.groupBy("row", "repeat", "run").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    parts = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("repeat", "first", "words"))).alias("_parts"))
    joined = numbered.join(parts, numbered["_row"] == parts["row"])
    # Each word with the white space after it, the first one also with what stands before.
    words = F.regexp_extract_all(text_of(text), F.lit(rf"(?:\A{SPACE})?{WORD}(?:{SPACE})?"), F.lit(0))
    cut = lambda w: F.transform("_parts", lambda p: F.array_join(F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")), ""))
    made = joined.select(*[numbered[c] for c in docs.columns if c != text], F.explode(let(words, cut)).alias("_part"))
    return made.select(*[F.col("_part").alias(text) if c == text else F.col(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
