"""Filter interaction audit: a recursive query walks every order of the filters over the cells of failed ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.functions.let import let
from lineloom.llm.common import documents, text_of, words_of
from lineloom.session import discard, materialize
from lineloom.sources.tables import table

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: Filters that one audit may hold: their orders grow with the factorial, whatever the input.
MAX_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: too short, too few distinct words, too many capitals, symbols."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        few = 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n
        return F.when(n < MIN_WORDS, 1).otherwise(0) + F.when(few, 2).otherwise(0)

    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    shouting = F.when(100 * capitals > MAX_UPPER_PERCENT * F.char_length(text), 4).otherwise(0)
    return let(words_of(text), of_words) + shouting + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def failure_cells(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the set of filters that they fail.

    Bits of ``mask``: 1, 2, 4, 8 as ``text_failures`` has them, 16 for a text that is identical to that of a row with a
    smaller key.  ``good`` and ``toxic`` count the rows whose key ``labels(doc_id, quality, toxic)`` marks so.  Texts
    are read once; from then on only a hash of each moves.  The first row of each text is found by a partial
    aggregate on the hash and looked up by hash *and* key, so a text that a third of all rows share never
    meets in one task.  A null text counts as empty, a null part as the empty string.  Rows with a null key are nobody's
    copy and have no labels.  Rows that repeat a key and text are first together; a key that ``labels`` repeats has a
    mark if any of its rows has it.
    """
    body = text_of(text)
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("hash"), text_failures(body).alias("bits"),
    )
    rows, _ = materialize(rows, "audit-rows")
    first = rows.groupBy("hash").agg(F.min("id").alias("id"), F.lit(True).alias("first")).where("id IS NOT NULL")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # Null keys match nothing; they go round both joins, where they would all meet in one task.
    keyed = rows.where("id IS NOT NULL").join(first, ["hash", "id"], "left").join(marks, "id", "left")
    copy = F.when(F.col("first"), 0).otherwise(16)
    keyed = keyed.select("part", (F.col("bits") + copy).alias("mask"), "good", "toxic")
    loose = rows.where("id IS NULL").select("part", F.col("bits").alias("mask"), F.lit(None).alias("good"), F.lit(None).alias("toxic"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    cells = keyed.unionByName(loose).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))
    cells, _ = materialize(cells, "audit-cells")
    discard(rows)
    return cells


def walk_orders(cells: DataFrame, letters: str) -> DataFrame:
    """(prefix, applied, bit, mask): every beginning of every order of ``letters`` with every mask in ``cells``.

    A recursive query starts from the masks and extends each prefix by each letter that it lacks; ``applied`` are the bits
    of the letters before the last one, ``bit`` that of the last.  The rows are bounded by the number
    of letters alone (10,400 for five), not by the input.
    """
    n = len(letters)
    if not 0 < n <= MAX_FILTERS or len(set(letters)) != n:
        raise ValueError(f"an audit takes 1 to {MAX_FILTERS} different letters, not {letters!r}")
    masks, _ = materialize(cells.select("mask").distinct(), "audit-masks")
    walk = cells.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(prefix, before, bit, applied, mask) AS (
            SELECT '', 0, 0, 0, mask FROM {{masks}}
            UNION ALL
            SELECT concat(prefix, substr('{letters}', i + 1, 1)), applied, shiftleft(1, i), applied | shiftleft(1, i), mask
            FROM walk LATERAL VIEW explode(sequence(0, {n - 1})) unused AS i
            WHERE (applied & shiftleft(1, i)) = 0
        )
        SELECT prefix, before AS applied, bit, mask FROM walk WHERE bit > 0
        """,
        masks=masks,
    )
    walk, _ = materialize(walk, "audit-walk")
    return walk


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, ``COUNTS``..., shapley): one row per part, order of the letters and step.

    ``cells(part, mask, n, good, toxic)``; bit i of ``mask`` belongs to the i-th letter.  What a step does to
    a mask follows from the walk, so each level's counts are sums over a part's cells: ``kept`` pass all letters so
    far, ``removed`` fail this one first, ``redundant`` fail it and one before, ``unique_fails`` fail it alone,
    ``good_lost`` and ``toxic_lost`` are the marked ones among the removed.  ``shapley`` adds up what the step's letter removes
    in all orders.  Parts without a cell have no rows; an empty table gives none.
    """
    n = len(letters)
    before, bit = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = bit & ~before
    effect = walk_orders(cells, letters).select(
        "prefix", "mask", (~before & ~bit).alias("kept"), gone.alias("removed"), (bit & before).alias("redundant"),
        (F.col("mask") == F.col("bit")).alias("unique_fails"), gone.alias("good_lost"), gone.alias("toxic_lost"),
    )
    weight = {"good_lost": "good", "toxic_lost": "toxic"}
    totals = [F.sum(F.when(F.col(c), F.col(weight.get(c, "n"))).otherwise(F.lit(0))).alias(c) for c in COUNTS]
    # The walk's size is fixed by the letters, so it may go to every task that holds cells.
    steps = cells.join(F.broadcast(effect), "mask").groupBy("part", "prefix").agg(*totals)
    steps, _ = materialize(steps, "audit-steps")
    # A prefix of k letters begins (n - k)! orders.
    orders = F.element_at(F.array(*[F.lit(math.factorial(n - k)) for k in range(1, n + 1)]), F.length("prefix"))
    letter = F.right("prefix", F.lit(1))
    worth = steps.groupBy("part", letter.alias("letter")).agg(F.sum(F.col("removed") * orders).alias("shapley"))
    whole = steps.where(F.length("prefix") == n).select("part", F.col("prefix").alias("filter_order"))
    spread = whole.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    spread = spread.select("*", F.substring("filter_order", F.lit(1), F.col("step")).alias("prefix"), letter_at("filter_order", "step").alias("letter"))
    found = spread.join(steps, ["part", "prefix"]).join(worth, ["part", "letter"])
    return found.select("part", "filter_order", "step", *COUNTS, "shapley")


def letter_at(order: str, step: str) -> Column:
    return F.substring(order, F.col(step), F.lit(1))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failure_cells(documents(spark, sf_dir), table(spark, sf_dir, "labels")), "ABCDE")


OP11_SQL = r"""
WITH RECURSIVE marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), failed AS (
    SELECT doc_id, part,
           CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 2 * length(body) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
    FROM texts
), cells AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM (SELECT unnest(range(5))::INT AS i)
), walk(prefix, step, letter, before, bit, applied) AS (
    SELECT letter, 1, letter, 0, bit, bit FROM letters
    UNION ALL
    SELECT prefix || l.letter, step + 1, l.letter, applied, l.bit, applied | l.bit
    FROM walk JOIN letters l ON (applied & l.bit) = 0
), steps AS (
    SELECT part, prefix, step, letter,
           sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & w.bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & w.bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = w.bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & w.bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & w.bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM walk w CROSS JOIN cells GROUP BY part, prefix, step, letter
), runs AS (
    SELECT o.prefix AS filter_order, s.*
    FROM (SELECT part, prefix FROM steps WHERE step = 5) o JOIN steps s
    ON s.part = o.part AND starts_with(o.prefix, s.prefix)
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM runs
"""
