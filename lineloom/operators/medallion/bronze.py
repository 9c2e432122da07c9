"""Bronze: landing raw tables with declared names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ingest(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Project source columns to their landing names; only those are scanned."""
    return raw.select(*[F.col(src).alias(name) for name, src in columns.items()])


def typed_load(raw: DataFrame, declared: dict[str, tuple[str, str]], rescued: str | None = None) -> DataFrame:
    """Load a table with declared types: ``{name: (source column, type)}``.

    The type ``json`` parses text to a VARIANT (bad JSON becomes null); any
    other type is a strict cast, so a value that does not fit stops the load.

    With ``rescued`` nothing stops the load: a value that does not fit, bad JSON included, becomes null and is kept as text in a
    map column of that name, by the name of its column.  The map is null where every value fits.
    """

    def typed(source: str, kind: str) -> Column:
        if kind.lower() == "json":
            return F.try_parse_json(F.col(source))
        return F.col(source).cast(kind) if rescued is None else F.col(source).try_cast(kind)

    loaded = {name: typed(src, kind) for name, (src, kind) in declared.items()}
    if rescued is None:
        return raw.select(*[value.alias(name) for name, value in loaded.items()])
    if rescued in declared:
        raise ValueError(f"{rescued!r} is a declared column")

    def lost(name: str, source: str) -> Column:
        text = F.struct(F.lit(name).alias("name"), F.col(source).cast("string").alias("value"))
        return F.when(loaded[name].isNull() & F.col(source).isNotNull(), text)

    misfits = F.array_compact(F.array(*[lost(name, src) for name, (src, _) in declared.items()]))
    kept = F.when(F.size(misfits) > 0, F.map_from_entries(misfits))
    return raw.select(*[value.alias(name) for name, value in loaded.items()], kept.alias(rescued))


def quarantine(loaded: DataFrame, rescued: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose values all fit, without the map; the other rows with it)."""
    return loaded.where(F.col(rescued).isNull()).drop(rescued), loaded.where(F.col(rescued).isNotNull())


def with_day(df: DataFrame, ts: str, name: str = "day") -> DataFrame:
    """Add the partition day of a timestamp."""
    return df.withColumn(name, F.to_date(ts))
