"""License templates found by an exact set-similarity join with prefix, length and positional filters."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.functions.let import let
from lineloom.llm.common import documents, text_of
from lineloom.session import materialize

#: Separators one by one: the regex engine looks single characters up in a bit set, ranges one after another.
_SEPARATORS = "".join(
    f"\\x{c:02X}" for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)
)
SEPARATOR, LICENSE_WORD = f"[{_SEPARATORS}]", f"[^{_SEPARATORS}]"

#: Phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices to look for; a parameter of ``license_scan``.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
}

#: Share of a template's words that a block must hold.
CONTAINMENT = 0.9

#: Templates times words: the bound of everything that is sent to every executor.
MAX_TEMPLATE_WORDS = 50_000


def _words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR + "+", text.lower()) if w]


def _tokens(line: Column) -> Column:
    return F.split(F.lower(line), SEPARATOR + "+")


def license_blocks(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = CONTAINMENT,
    text: str = "text",
    key: str = "doc_id",
    block_lines: int = 1,
) -> DataFrame:
    """``(key, span, block, label, overlap, containment)`` for every block that holds enough of a template.

    A block is ``block_lines`` consecutive lines, starting at any line (``span`` 0, ``block`` the line), or,
    for a template of L words, any ceil(L / threshold) consecutive words, whatever line breaks and
    punctuation stand between them.  Such windows are searched in pieces of 2 * ``span`` words that
    start at every multiple of ``span`` (``block`` is the multiple), where ``span`` is the next power of two; so
    every window lies whole in a piece.  Pieces pass the filters first, then each window of a survivor is counted.

    Blocks and templates are sets of lower-case words, and a pair matches when the block holds at
    least ``threshold`` of the template's words.  Words are ordered from the rarest in the
    corpus (counted over all lines) to the most frequent.  With ``need`` words required of
    a template of size n, a match must have one of the template's first n - need + 1 words
    among the first words of the block that leave need - 1 others (prefix filter), the
    block must have ``need`` template words at all (length filter), and the words after the
    first shared one must suffice on both sides (positional filter).  Survivors are counted
    exactly.  Words in no template can never count, so blocks keep template words only.

    Templates are bounded by ``MAX_TEMPLATE_WORDS`` and go to every executor; blocks
    never move.  Null or empty texts, blank lines and an empty table give no rows; repeated
    rows give repeated matches.
    """
    spark = docs.sparkSession
    bodies = {label: _words(body) for label, body in templates.items()}
    sets = {label: sorted(set(words)) for label, words in bodies.items() if words}
    if sum(map(len, sets.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words; split them over several scans")
    known = sorted({w for words in sets.values() for w in words})
    needs = {label: max(1, math.ceil(threshold * len(words) - 1e-9)) for label, words in sets.items()}
    #: Words of a template's window, and the power of two it is searched under.
    reach = {label: math.ceil(len(bodies[label]) / max(threshold, 1 / len(bodies[label])) - 1e-9) for label in sets}
    spans = {label: 1 << (n - 1).bit_length() for label, n in reach.items()}
    literals = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    block_of = lambda span, i, held, words: F.struct(
        F.lit(span).alias("span"), i.cast("int").alias("block"), held.alias("held"), words.cast("array<string>").alias("words")
    )

    def lines_of(tokens: Column) -> Column:
        if block_lines > 1:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - F.lit(block_lines - 1)))
            tokens = F.transform(starts, lambda i: F.flatten(F.slice(tokens, i, block_lines)))
        return F.transform(tokens, lambda line, i: block_of(0, i, F.array_intersect(literals(known), line), F.lit(None)))

    def pieces_of(words: Column, span: int) -> Column:
        own = [label for label in sets if spans[label] == span]
        vocabulary, fewest = sorted({w for label in own for w in sets[label]}), min(needs[label] for label in own)
        last = F.greatest(F.lit(0), F.ceil(F.size(words) / F.lit(span)).cast("int") - 2)
        piece = lambda i: F.slice(words, i * span + 1, 2 * span)
        made = F.transform(F.sequence(F.lit(0), last), lambda i: block_of(span, i, F.array_intersect(literals(vocabulary), piece(i)), F.lit(None)))
        near = F.filter(made, lambda p: F.size(p["held"]) >= fewest)
        return F.transform(near, lambda p: block_of(span, p["block"], p["held"], piece(p["block"])))

    blocks = let(
        F.transform(F.split(text_of(text), "\n"), _tokens),
        lambda tokens: let(
            F.array_remove(F.flatten(tokens), ""),
            lambda words: F.concat(lines_of(tokens), *[pieces_of(words, span) for span in sorted(set(spans.values()))]),
        ),
    )
    #: The one pass over the texts keeps the template words of each block.
    held = docs.select(F.col(key), F.inline(F.filter(blocks, lambda b: F.size(b["held"]) > 0)))
    held, _ = materialize(held, "license-blocks")
    counts = held.where("span = 0").select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}  # at most one row per template word
    order = sorted(known, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    least = min(needs.values(), default=1)
    rows = []
    for label, words in sorted(sets.items()):
        ranked = sorted(words, key=place.__getitem__)
        need = needs[label]
        rows += [(label, spans[label], reach[label], len(ranked), need, w, i, ranked) for i, w in enumerate(ranked[: len(ranked) - need + 1])]
    prefix = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("label"), F.lit(span).alias("of_span"), F.lit(window).alias("window"),
                        F.lit(n).alias("n"), F.lit(need).alias("need"),
                        F.lit(w).alias("word"), F.lit(i).alias("at"),
                        F.array(*map(F.lit, ranked)).alias("template"),
                    )
                    for label, span, window, n, need, w, i, ranked in rows
                ]
            )
        )
    )
    ranked = held.where(F.size("held") >= least).select(
        key, "span", "block", "words", F.array_intersect(F.array(*map(F.lit, order)), "held").alias("ranked")
    )
    probes = ranked.select(key, "span", "block", "words", "ranked", F.posexplode(F.slice("ranked", F.lit(1), F.size("ranked") - (least - 1))).alias("pos", "word"))
    close = probes.join(F.broadcast(prefix), "word").where(
        ((F.col("span") == 0) | (F.col("span") == F.col("of_span")))
        & (F.size("ranked") >= F.col("need"))
        & (F.col("pos") <= F.size("ranked") - F.col("need"))
        & (F.least(F.col("n") - F.col("at"), F.size("ranked") - F.col("pos")) >= F.col("need"))
    )
    # Of the words a block shares with a template, the first one stands for the pair.
    first = F.array_intersect("template", "ranked")
    counted = close.withColumn("both", first).where((F.col("both")[0] == F.col("word")) & (F.size("both") >= F.col("need")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.col("window") + 1))
    windows = F.transform(starts, lambda i: F.size(F.array_intersect("template", F.slice("words", i, F.col("window")))))
    overlap = F.when(F.col("span") == 0, F.size("both")).otherwise(F.array_max(windows))
    found = counted.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need"))
    return found.select(key, "span", "block", "label", "overlap", (F.col("overlap") / F.col("n")).alias("containment"))


def phrase_pattern(phrases) -> str:
    """Matches a phrase's words where they stand consecutively; ASCII letters in either case."""
    bodies = ["".join((f"{SEPARATOR}+" if i else "") + re.escape(w) for i, w in enumerate(p.split())) for p in phrases]
    return f"(?i)(?<!{LICENSE_WORD})(?:{'|'.join(bodies)})(?!{LICENSE_WORD})"


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = CONTAINMENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: places of the phrases, and labels of phrases and matching blocks.

    ``n_base`` counts the places, ``first_word`` and ``last_word`` are their smallest and
    largest word positions (null without a place), ``score`` is the best containment of a
    template in a block, 1 where a phrase stands.  Null and empty texts get zero counts and
    empty labels.  Rows that share a key share the blocks' labels.
    """
    body = F.col("_body")
    anywhere = phrase_pattern(phrases)
    count = lambda t: F.regexp_count(t, F.lit(f"{LICENSE_WORD}+")).cast("long")
    flags = [F.when(F.regexp_count(body, F.lit(phrase_pattern([p]))) > 0, F.lit(label)) for p, label in phrases.items()]
    rows = docs.select(F.col(key), text_of(text).alias("_body"))
    rows = rows.withColumn("n_base", F.regexp_count(body, F.lit(anywhere)).cast("long"))
    placed = F.col("n_base") > 0
    base = rows.select(
        key,
        count(body).alias("n_words"),
        "n_base",
        F.when(placed, count(F.regexp_extract(body, f"(?s)^(.*?){anywhere}", 1))).alias("first_word"),
        F.when(placed, count(F.regexp_extract(body, f"(?s)^(.*){anywhere}", 1))).alias("last_word"),
        F.when(placed, F.array_compact(F.array(*flags))).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    blocks = license_blocks(docs, templates, threshold, text, key)
    found = blocks.groupBy(F.col(key).alias("_key")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = base.join(found, base[key].eqNullSafe(found["_key"]), "left")
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        key, "n_words", "n_base", "first_word", "last_word",
        named(F.col("base")).alias("base_labels"),
        named(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
