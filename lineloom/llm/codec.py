"""SentencePiece encoding by a streaming Viterbi search, and lossless decoding."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm.common import documents
from lineloom.llm.pieces import DEFAULT_MODEL, MARK, Pieces, pieces

#: Segments whose ids a worker remembers.
REMEMBERED = 200_000
#: Stands for a mark that the text itself holds; valid text has no lone surrogate.
_OWN_MARK = "\udfff"
#: How much an unknown character costs beyond the worst piece.
_UNKNOWN = 10.0


class StreamingViterbi:
    """Best-scoring segmentation of text that arrives in chunks.

    A position is relaxed once the longest piece that could start there has arrived.  Then only the
    positions up to one piece length ahead can still be chosen from.  When the
    backpointer paths of all of those meet in one boundary, everything before it is
    settled, given out and forgotten.  Equal scores keep the earlier found, that is the longer last piece.
    """

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.low = vocabulary.real_low - _UNKNOWN
        self.text = ""
        self.best: list[float] = [0.0]
        self.back: list[int] = [0]
        self.at = self.far = 0

    def feed(self, chunk: str) -> list[int]:
        self._add(chunk)
        return self._run(len(self.text) - self.v.longest)

    def finish(self) -> list[int]:
        ids = self._run(len(self.text)) if self.at < len(self.text) else []
        return ids + self._ids(len(self.text))

    def _add(self, chunk: str) -> None:
        self.text += chunk
        self.best += [-np.inf] * len(chunk)
        self.back += [-1] * len(chunk)

    def _run(self, end: int) -> list[int]:
        """Relax the positions before ``end``; ``far`` is the farthest end in reach."""
        tree, longest, low = self.v.tree, self.v.longest, self.low
        text, best, back, at, far = self.text, self.best, self.back, self.at, self.far
        out: list[int] = []
        while at < end:
            # Every position is reached: its character is a piece or counts as unknown.
            here, stop, node, reach = best[at], at, tree, at + 1
            if text[at] not in tree or tree[text[at]][0] is None:
                score = here + low
                if score > best[at + 1]:
                    best[at + 1], back[at + 1] = score, at
            for c in text[at : at + longest]:
                found = node.get(c)
                if found is None:
                    break
                stop += 1
                score, node = found
                if score is not None:
                    score += here
                    reach = stop
                    if score > best[stop]:
                        best[stop], back[stop] = score, at
            if reach > far:
                far = reach
            at += 1
            # One end in reach, or paths that may have met: give out what is settled, once it is worth it.
            if at >= longest and (far == at or at % longest == 0 and at > 4 * longest):
                self.at, self.far = at, far
                boundary = at if far == at else self._meeting()
                if boundary:
                    out += self._take(boundary)
                    text, best, back, at, far = self.text, self.best, self.back, self.at, self.far
                    end -= boundary
        self.at, self.far = at, far
        return out

    def _meeting(self) -> int:
        """The last boundary on the paths of every position that can still be reached."""
        ends = {e for e in range(self.at, self.far + 1) if self.back[e] >= 0}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(self.back[last])
        return ends.pop() if ends else 0

    def _take(self, boundary: int) -> list[int]:
        """Ids up to ``boundary``, which becomes position 0."""
        ids = self._ids(boundary)
        base = self.best[boundary]
        self.text = self.text[boundary:]
        self.best = [x - base for x in self.best[boundary:]]
        self.back = [max(x - boundary, -1) for x in self.back[boundary:]]
        self.back[0] = 0
        self.at -= boundary
        self.far -= boundary
        return ids

    def _ids(self, boundary: int) -> list[int]:
        """Ids of the best path to ``boundary``."""
        cuts = [boundary]
        while cuts[-1] > 0:
            cuts.append(self.back[cuts[-1]])
        cuts.reverse()
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            part = self.text[a:b]
            found = self.v.normal.get(part)
            if found:
                ids.append(found[0])
            else:
                ids += [self.v.bytes[x] for x in (MARK if part == _OWN_MARK else part).encode()]
        return ids


class Codec(dict):
    """Encodes and decodes whole texts; ids of recent segments are remembered as bytes.

    A segment enters the search a few longest pieces at a time, so the search holds a short stretch of it however long it is.
    """

    def __init__(self, vocabulary: Pieces):
        super().__init__()
        self.v = vocabulary
        self.older: dict[str, bytes] = {}
        words = [n.replace(MARK, " ").encode() for n in vocabulary.names]
        for byte, index in vocabulary.bytes.items():
            words[index] = bytes([byte])
        self.words = np.array(words, dtype=object)

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            search, step = StreamingViterbi(self.v), 8 * self.v.longest
            settled = array("i")
            for at in range(0, len(segment), step):
                settled.extend(search.feed(segment[at : at + step]))
            settled.extend(search.finish())
            ids = settled.tobytes()
        if len(segment) <= 8 * self.v.longest:
            if len(self) > REMEMBERED:
                # What is not asked for again before the next turn is forgotten.
                self.older = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as native 32-bit integers; nothing for a null or empty text."""
        if not text:
            return b""
        marked = MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK)
        return b"".join(map(self.__getitem__, self.v.segments(marked)))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ``encode`` had."""
        return b"".join(self.words[ids].tolist())[1:]


@lru_cache(maxsize=2)
def codec(model: str = DEFAULT_MODEL) -> Codec:
    return Codec(pieces(model))


#: Characters of text whose ids are held at once.
_BATCH_CHARS = 1 << 22


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, ``n_tokens``, ``ids`` (array of int) and ``round_trip`` (decoding gives the text back) per row.

    The segmentation has the best sum of piece scores, as the model file gives them.  A null
    or empty text has no ids and round-trips as empty.  Characters without a piece, and a mark that stands in
    the text itself, become bytes, so decoding is lossless.  One narrow pass; rows keep their repeats.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind), T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, sizes, same, held = [], [0], [], 0
                stop = start
                while stop < batch.num_rows and (stop == start or held < _BATCH_CHARS):
                    one = batch.column(1)[stop].as_py() or ""
                    ids = coder.encode(one)
                    texts.append(ids)
                    sizes.append(sizes[-1] + len(ids) // 4)
                    same.append(coder.decode(np.frombuffer(ids, np.int32)) == one.encode())
                    held, stop = held + len(one), stop + 1
                values = pa.array(np.frombuffer(b"".join(texts), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
                counts = pa.array(np.diff(sizes), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), counts, lists, pa.array(same)],
                    names=[key, "n_tokens", "ids", "round_trip"],
                )
                start = stop

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Key and ``text`` of encoded rows; null ids give null, no ids an empty text."""
    kind = encoded.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            texts = [
                None if not row.is_valid else coder.decode(row.values.to_numpy(zero_copy_only=False).astype(np.int32)).decode()
                for row in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
