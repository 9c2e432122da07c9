"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import documents, text_of
from lineloom.llm.pieces import DEFAULT_MODEL, MARK, model_path, pieces

LIMIT = 4096
#: Short segments whose counts a worker remembers; all others are merged again, with the same result.
REMEMBERED = 200_000


class SegmentCounts(dict):
    """Tokens of segments: proven whole tokens first, then those merged lately.

    ``whole`` is proven once per process: each vocabulary string is encoded alone by the
    library, and those that come back as one token count 1 without another look.
    """

    def __init__(self, model: str):
        import sentencepiece

        super().__init__()
        self.vocabulary = pieces(model)
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        # A leading line feed keeps the library's own leading mark away from the segment.
        self.lead = "\n" if len(self.vocabulary.segments("\n")) == 1 and len(self.library.encode("\n")) == 2 else None
        if self.lead is None:
            raise ValueError("the model joins line feeds to other characters")
        names = [n for n in self.vocabulary.normal if len(self.vocabulary.segments(n)) == 1]
        alone = self.library.encode([self.lead + n for n in names], num_threads=1)
        self.whole = {n: 1 for n, ids in zip(names, alone) if len(ids) == 3}
        self.update(self.whole)

    def __missing__(self, segment: str) -> int:
        count = len(self.library.encode(self.lead + segment, num_threads=1)) - 2
        if len(segment) > 8 * self.vocabulary.longest:
            return count
        if len(self) > REMEMBERED + len(self.whole):
            self.clear()
            self.update(self.whole)
        self[segment] = count
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.vocabulary.segments(MARK + text.replace(" ", MARK))))


@lru_cache(maxsize=2)
def segment_counts(model: str = DEFAULT_MODEL) -> SegmentCounts:
    return SegmentCounts(model)


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """Key, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row, in one narrow pass over the texts.

    Counts equal the library's default encoding without begin or end marks.  A text is cut
    where the vocabulary proves that no token can reach across: before a space that
    follows something else, and around line feeds.  A null or empty text has no
    tokens; rows keep their repeats; control strings inside a text are ordinary text, as
    in the library.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = segment_counts(model)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    body = text_of(text)
    counted = docs.select(F.col(key), F.octet_length(body).cast("long").alias("n_bytes"), count(body).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
