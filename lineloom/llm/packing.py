"""Best-fit packing of token sequences: a plan made from the length histogram, dealt to the pieces by their numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm.common import documents, small_side, text_of
from lineloom.llm.pack_plan import plan
from lineloom.llm.pieces import model_path
from lineloom.session import materialize

CAPACITY, END, TOKENIZER = 1024, 2, "byte_bpe_50k.json"
#: Fixed value: how a byte-level tokenizer of this family splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these characters two libraries may know different versions of Unicode.
PLAIN = r"[\x00-ɏ]*"
#: Bytes of ids that a task gathers before it hands rows on.
BATCH_BYTES = 8 << 20


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Vocabulary strings, in which characters stand for bytes, as the bytes themselves."""
    # Printable bytes stand for themselves, the others are numbered on from 256.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte[c] for c in name): i for name, i in vocabulary.items()}


class TokenBytes:
    """Ids that the tokenizer's library gives for a text, as little-endian 32-bit numbers.

    Plain texts are merged by a faster library with the same vocabulary.  It merges neighbours by the rank of what they
    make, not by a list of pairs; that is the same where each vocabulary string, encoded alone, is one token (which the
    tests prove of the default vocabulary): of a token's bytes only one last pair can then ever arise.
    """

    def __init__(self, tokenizer: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model_path(tokenizer))
        self.library.no_padding()
        self.library.no_truncation()
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        before = repr(self.library.pre_tokenizer)
        # Only the plain form of byte-level splitting is known here; any other goes to the library.
        known = "ByteLevel(" in before and "add_prefix_space=False" in before and "use_regex=True" in before
        self.fast = None
        if known and self.library.normalizer is None and tokenizer == TOKENIZER:
            ranks = byte_ranks({k: v for k, v in self.library.get_vocab(with_added_tokens=False).items() if k not in added})
            self.fast = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain = re.compile(PLAIN).fullmatch
        self.special = sorted(added)

    def of(self, text: str) -> bytes:
        if self.fast and self.plain(text) and not any(s in text for s in self.special):
            return np.asarray(self.fast(text), "<u4").tobytes()
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def token_bytes(tokenizer: str = TOKENIZER) -> TokenBytes:
    return TokenBytes(tokenizer)


def cut_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: key, ``piece`` (from 0), ``start``, ``length``, ``ids`` (little-endian 32-bit), ``chunk``, ``number``.

    A document is the library's ids without added special tokens and then ``end``.  Only documents of over ``capacity`` tokens
    are cut; their first piece takes what is over a multiple of it, so all others are full.  ``number`` counts the
    pieces of one length within a ``chunk``, the rows that one task reads, from 0.  A null text counts as empty and is
    one piece of the end token alone.  Rows keep their repeats and null keys; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType().add("key", kind)
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "integer"), ("ids", "binary"), ("chunk", "integer"), ("number", "long")):
        schema = schema.add(name, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = token_bytes(tokenizer), np.asarray([end], "<u4").tobytes()
        chunk, numbers = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows, size, keys = [], 0, []

            def full(batch=batch):
                columns = list(zip(*rows)) or [()] * 5
                place, start, length, ids, number = columns
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keys, pa.int64())), pa.array(place, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int32()), pa.array(ids, pa.binary()), pa.array([chunk] * len(ids), pa.int32()), pa.array(number, pa.int64()),
                    ],
                    names=schema.fieldNames(),
                )

            for row, value in enumerate(batch.column(1)):
                ids = encoder.of(value.as_py()) + last
                n, start, place = len(ids) // 4, 0, 0
                while start < n:
                    stop = start + ((n - start - 1) % capacity + 1)
                    length = stop - start
                    rows.append((place, start, length, ids[4 * start : 4 * stop], numbers[length]))
                    keys.append(row)
                    numbers[length] += 1
                    start, place = stop, place + 1
                size += len(ids)
                if size > BATCH_BYTES:
                    yield full()
                    rows, size, keys = [], 0, []
            yield full()

    pieces = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).mapInArrow(cut, schema)
    return pieces.withColumnRenamed("key", key)


def intervals(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first, start, sequence, offset)``: where the plan puts the pieces of each length.

    Pieces are numbered through, by length and then within it; ``first`` has the number of each length's first piece
    and ``start`` the first piece of each interval.  The k-th piece of an interval goes to sequence ``sequence + k``, at ``offset``.
    """
    first = np.zeros(capacity + 2, np.int64)
    first[lengths + 1] = demand
    first = np.cumsum(first)
    cursor, found, base = first.copy(), [], 0
    for configuration, number in plan(lengths, demand, capacity):
        offset = 0
        for length in configuration:
            found.append((cursor[length], base, offset))
            cursor[length] += number
            offset += length
        base += number
    table = np.array(sorted(found), np.int64).reshape(-1, 3)
    return first, table[:, 0], table[:, 1], table[:, 2]


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of ``cut_documents`` with ``sequence_id`` and ``offset`` in place of ``chunk`` and ``number``.

    The pieces are written once.  Only their counts per length reach the driver (at most ``capacity`` rows), where the
    configuration program is solved; its plan is a list of intervals whose size depends on the capacity alone.  A
    piece's number among all of its length is its number in its chunk plus the pieces of earlier chunks, so no
    task ever ranks the pieces of a length and a length that a third of all pieces have is no hot key.
    """
    stored, _ = materialize(pieces, "pack-pieces")
    counts, seen = materialize(stored.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts", rows=F.count(F.lit(1)))
    histogram = sorted((r["length"], r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())
    lengths, demand = (np.array([r[i] for r in histogram], np.int64) for i in (0, 1))
    first, start, sequence, offset = intervals(lengths, demand, capacity)
    earlier = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def slots(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        ordinal = first[length.to_numpy()] + number.to_numpy()
        at = np.searchsorted(start, ordinal, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + ordinal - start[at], "offset": offset[at]})

    numbered = stored.join(small_side(before, seen["rows"]), ["chunk", "length"])
    kept = [c for c in pieces.columns if c not in ("chunk", "number")]
    placed = numbered.select(*kept, slots("length", F.col("number") + F.col("before")).alias("slot"))
    return placed.select(*kept, "slot.sequence_id", "slot.offset")


def sequences(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per sequence: ``sequence_id``, ``length``, ``ids`` and ``parts`` (offset, key, piece, start, length) in order.

    A sequence has at most as many pieces as it has tokens, so a group is bounded by the capacity.
    """
    part = F.struct("offset", F.col(key).alias("key"), "piece", "start", "length", "ids")
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("all"))
    ids = F.aggregate("all", F.lit(b""), lambda have, p: F.concat(have, p["ids"]))
    bare = F.transform("all", lambda p: F.struct(p["offset"].alias("offset"), p["key"].alias(key), p["piece"].alias("piece"), p["start"].alias("start"), p["length"].alias("length")))
    return parts.select("sequence_id", (F.octet_length(ids) / 4).cast("int").alias("length"), ids.alias("ids"), bare.alias("parts"))


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece with its ids and its place: see ``cut_documents`` and ``place``."""
    return place(cut_documents(docs, text, key, capacity, end, tokenizer), capacity)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_documents(documents(spark, sf_dir))
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(digest).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
