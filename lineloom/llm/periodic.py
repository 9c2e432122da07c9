"""Periodic runs of words: lag scans for short periods, minimizers on growing scales for all others.

A run is a longest stretch of words that repeats with a period, at least twice over.  Scale ``L`` looks for periods from
``2L`` up to ``4L``.  Hashes of ``L`` words are compared within windows of ``L`` places; the window's smallest recurs one
period later, as long as both windows lie in the run, so equal minimizers at such a distance are the seeds, and
each seed is extended on the words themselves.

Stretches of a much shorter period (up to ``L / 2``, known from earlier scales) are left out of the minimizers: there the
same hash stands at every period and pairs would be many.  Hashes elsewhere recur after more than ``L / 2`` places, so a place
has at most eight seeds.  What is missed by leaving them out are runs whose every word but the last period lies in
one such stretch: those are two touching stretches of equal words at shifted places, and they are listed from the pairs
of touching stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.functions.let import let
from lineloom.llm.common import documents, text_of, words_of

MIN_LENGTH = 12
#: Words of the first scale; shorter periods than twice that are found by direct scans.
FIRST = 16
#: Hashed words whose equality at a lag starts a closer look, well below the least stretch of equal words in a run.
GRAM = 4

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of stretches from those of their halves."""
    return _mixed(left * np.uint64(3) + _mixed(right + _ODD))


def _equal(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on (``step`` 1) or before it (-1) hold the same word as ``lag`` further."""
    n, width, count = len(ids), 32, 0
    while True:
        if step > 0:
            stop = min(at + count + width, n - lag)
            a, b = ids[at + count : stop], ids[at + count + lag : stop + lag]
        else:
            low = max(at - count - width, 0)
            a, b = ids[low : at - count][::-1], ids[low + lag : at - count + lag][::-1]
        if not len(a):
            return count
        other = a != b
        if other.any():
            return count + int(other.argmax())
        count += len(a)
        width *= 2


def _smallest(values: np.ndarray, width: int, largest: bool = False) -> np.ndarray:
    """Smallest (or largest) of each ``width`` neighbours, from running extremes within blocks."""
    pick = np.maximum if largest else np.minimum
    n = len(values)
    fill = np.uint64(0) if largest else np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.full(-(-n // width) * width, fill)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


class Runs:
    """The runs of one sequence of word numbers: ``found[(start, end)] = period``."""

    def __init__(self, ids: np.ndarray, least: int = MIN_LENGTH):
        if least < 2 * GRAM:
            raise ValueError(f"runs have at least {2 * GRAM} words")
        # Shorter runs than asked for are needed to know the periodic stretches.
        self.ids, self.wanted, self.least, self.found = ids, least, min(least, FIRST), {}
        self.by_period: dict[int, list[tuple[int, int]]] = {}
        n = len(ids)
        if n < least:
            return
        names = _mixed(ids.astype(np.uint64) + np.uint64(1))
        width = 1
        while width < GRAM:
            names, width = _joined(names[:-width], names[width:]), 2 * width
        if len(np.unique(names)) == len(names):
            return  # every run holds some GRAM words twice
        for lag in range(1, min(2 * FIRST - 1, n // 2) + 1):
            self.scan(names, lag)
        while 4 * width <= n:
            if width >= FIRST and not self.scale(names, width):
                break
            names, width = _joined(names[:-width], names[width:]), 2 * width

    def add(self, at: int, lag: int, known: int = 0) -> int:
        """Extend equality at ``lag`` from ``at`` (``known`` places from there are equal); the end of the stretch of equal places."""
        stop = at + known + _equal(self.ids, at + known, lag, 1)
        start = at - _equal(self.ids, at, lag, -1)
        end = stop + lag
        # Shorter periods come first: a stretch that is there already has one of them.
        if end - start >= max(self.least, 2 * lag) and (start, end) not in self.found:
            self.found[(start, end)] = lag
            self.by_period.setdefault(lag, []).append((start, end))
        return max(stop, at + 1)

    def scan(self, names: np.ndarray, lag: int) -> None:
        at = 0
        for place in np.flatnonzero(names[lag:] == names[:-lag]).tolist():
            if place >= at:
                at = self.add(place, lag)

    def periodic(self, names: np.ndarray, width: int) -> np.ndarray:
        """Which stretches of ``width`` words have a period of at most half of that."""
        edges = np.zeros(len(names) + 1, np.int64)
        for period, spans in self.by_period.items():
            if 2 * period <= width:
                for start, end in spans:
                    if end - start >= width:
                        edges[start] += 1
                        edges[end - width + 1] -= 1
        return np.cumsum(edges[:-1]) > 0

    def scale(self, names: np.ndarray, width: int) -> bool:
        """Runs of periods from ``2 * width`` up to ``4 * width``; false when no stretch of ``width`` words stands twice."""
        if len(np.unique(names)) == len(names):
            return False
        dull = self.periodic(names, width)
        keys = np.where(dull, np.uint64(0xFFFFFFFFFFFFFFFF), names)
        least = _smallest(keys, width)
        # A place counts when it is the smallest of one of the windows around it.
        edge = np.zeros(width - 1, np.uint64)
        chosen = _smallest(np.concatenate([edge, least, edge]), width, largest=True) == keys
        places = np.flatnonzero(chosen & ~dull)
        order = places[np.argsort(names[places], kind="stable")]
        seeds = []
        for step in range(1, len(order)):
            near = (names[order[step:]] == names[order[:-step]]) & (order[step:] - order[:-step] < 4 * width)
            if not near.any():
                break
            lags = order[step:][near] - order[:-step][near]
            wide = lags >= 2 * width
            seeds.append(np.stack([lags[wide], order[:-step][near][wide], np.zeros(wide.sum(), np.int64)], axis=1))
        seeds.append(np.array(list(self.touching(width)), np.int64).reshape(-1, 3))
        pairs = np.concatenate(seeds)
        reached: dict[int, int] = {}
        for lag, at, known in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
            if at >= reached.get(lag, 0):
                reached[lag] = self.add(at, lag, known)
        return True

    def touching(self, width: int) -> Iterator[tuple[int, int, int]]:
        """(lag, place, equal places from there) of the runs that two touching stretches of one period make with each other."""
        for period, spans in self.by_period.items():
            if 2 * period > width:
                continue
            spans.sort()
            for (start, end), (after, stop) in zip(spans, spans[1:]):
                if after > end:
                    continue
                root, whole = self.ids[end - period : end].tobytes(), self.ids[after : after + 2 * period].tobytes()
                size = self.ids.itemsize
                shift = whole.find(root)
                while shift >= 0 and shift % size:
                    shift = whole.find(root, shift + 1)
                if shift < 0:
                    continue
                lag = after + shift // size - (end - period)
                lag += max(0, -(-(2 * width - lag) // period)) * period
                longest = min(4 * width - 1, end - start, stop - after, (stop - start) // 2)
                for one in range(lag, longest + 1, period):
                    # All places from the first here on hold the word that stands one lag later.
                    low, high = max(start, after - one), min(end, stop - one)
                    if high - low >= one:
                        yield one, low, high - low

    def spans(self) -> list[tuple[int, int, int]]:
        """(start, length, period), in order."""
        return sorted((start, end - start, period) for (start, end), period in self.found.items() if end - start >= self.wanted)


def periodic_words(text: str | None, least: int = MIN_LENGTH) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the words that stay when each run is cut to its first period, joined by spaces."""
    # Only ASCII white space parts words, also between other kinds of space.
    words = text.encode().split() if text else []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    spans = Runs(ids, least).spans()
    if spans:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in spans:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return len(ids), spans, b" ".join(words).decode()


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_LENGTH) -> DataFrame:
    """Key, ``n_words``, ``runs`` (start, length, period in words, by start and then period) and ``collapsed`` of every row.

    A run has its smallest period ``q``, at least ``max(least, 2 * q)`` words, and no neighbouring word continues it.  ``collapsed`` is
    the text's words joined by one space without those that any run holds beyond its first period.  A null, empty or
    blank text has no words and no runs.  Each text is looked at by itself in one narrow pass, in memory that grows with the
    text alone; rows keep their repeats, and an empty table gives no rows.
    """

    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = T.StructType().add("key", docs.schema[key].dataType).add("n_words", "long")
    spans = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = schema.add("runs", T.ArrayType(spans)).add("collapsed", "string")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [periodic_words(t.as_py(), least) for t in batch.column(1)]
            runs = [[dict(zip(("start", "length", "period"), r)) for r in row[1]] for row in rows]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array(runs, pa.list_(span)), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "n_words", "runs", "collapsed"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(found, schema).withColumnRenamed("key", key)


def planted(text: Column, key: Column) -> Column:
    """The text with the periodic tail that the query's contract gives to a tenth of all keys; null keys have none."""
    crc = F.crc32(key.cast("string"))
    g = F.floor(crc / 10)

    def tail(words: Column) -> Column:
        n = F.nullif(F.size(words).cast("long"), F.lit(0))
        a = g % n
        place = F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))
        word = lambda i, at: F.get(words, F.when(i < at["a"], i).otherwise(at["a"] + (i - at["a"]) % at["p"]).cast("int"))
        every = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.coalesce(let(place, lambda at: F.array_join(F.transform(every, lambda i: word(i, at)), " ")), text)

    return F.when(crc % 10 == 0, let(words_of(text), tail)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    docs = docs.select("doc_id", planted(text_of("text"), F.col("doc_id")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("under"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = periodic_runs(docs).select("doc_id", "runs", best.alias("best"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.under")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
