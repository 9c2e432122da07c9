"""Script rows -> parsed table records.

``parse_scripts`` is one projection: no shuffle, no Python in the tasks, one
pass over each text.  Deduplication and everything after it move only the light
record columns, never the script text, unless the caller keeps ``content``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions import naming, tokens
from lineloom.functions.dialects import Dialect, dialect_of
from lineloom.functions.let import let

RECORD = (
    "id", "label", "layer", "type", "project", "dataset", "path",
    "dependencies", "content", "ctes", "error",
)

# Everything but the script's text.
TEXTLESS = tuple(c for c in RECORD if c != "content")

# What a graph needs: neither the text nor parts of it.
LIGHT = ("id", "label", "layer", "type", "project", "dataset", "path", "dependencies")

_NO_NAMES = "array<string>"
_NO_CTES = "map<string,string>"


def _error(toks: Column, low: Column, s: Column, head: Column, d: Dialect) -> Column:
    """Why a script cannot be read, or null."""
    lead = F.get(low, F.lit(0))
    marks = [F.lit(q) for q in (d.name_quotes + d.string_quotes) if q != "["]
    return (
        F.when(F.coalesce(lead, F.lit("")).isin("", ";"), "no statement")
        .when(F.arrays_overlap(toks, F.array(*marks)), "unclosed literal or quoted name")
        .when(s.unbalanced | (F.size(s.stack) > 0), "unbalanced parentheses")
        .when(~lead.isin(*tokens.LEAD_WORDS, *tokens.COMMAND_WORDS), "unknown statement")
        .when(s.dangling & ~_without_refs(lead, head), "FROM or JOIN without a table")
        .when(
            (lead == "create")
            & F.when(head.kind.isNull(), head.words < 3).otherwise(
                head.kind.isin("table", "view") & head["name"].isNull()
            ),
            "CREATE without a target",
        )
        .when(~_without_refs(lead, head), tokens.misplaced(toks, low, d))
    )


def _without_refs(lead: Column, head: Column) -> Column:
    """Commands, and CREATE of a kind that is no table's, are records that read nothing."""
    return lead.isin(*tokens.COMMAND_WORDS) | ((lead == "create") & head.kind.isNull())


def _target(path: Column, base: Column, head: Column, d: Dialect) -> Column:
    """project, dataset and label of the table a script defines.

    The CREATE target counts when it has no column list; then a file name of
    two or three dotted parts; then the parent folder as dataset unless that
    folder is a layer.
    """
    default = F.lit("default")
    usable = head["name"].isNotNull() & ~head.has_columns & ~head.kind.isin(
        "function", "procedure", "index", "schema", "database", "macro", "trigger"
    )
    folders = F.split(path, "/")

    def choose(x: Column) -> Column:
        made, file, parent = x.made, x.file, x.parent
        has_made = made.isNotNull()
        made_set = F.when(has_made & (F.size(made) >= 2), F.element_at(made, -2)).otherwise(default)
        made_prj = F.when(has_made & (F.size(made) >= 3), F.element_at(made, -3)).otherwise(default)
        bare = (made_set == "default") & (made_prj == "default")
        from_file = bare & F.size(file).isin(2, 3)
        project = F.when(bare & (F.size(file) == 3), F.get(file, F.lit(0))).otherwise(made_prj)
        dataset = F.when(from_file, F.element_at(file, -2)).otherwise(made_set)
        label = (
            F.when(from_file, F.element_at(file, -1))
            .when(has_made, F.element_at(made, -1))
            .otherwise(base)
        )
        from_folder = (
            (project == "default")
            & (dataset == "default")
            & ~F.lower(parent).isin(*naming.LAYER_FOLDERS)
        )
        return F.struct(
            project.alias("project"),
            F.when(from_folder, parent).otherwise(dataset).alias("dataset"),
            label.alias("label"),
        )

    inputs = F.struct(
        F.when(usable, tokens.name_parts(head["name"], d)).alias("made"),
        F.split(base, r"\.").alias("file"),
        F.when(F.size(folders) > 1, F.element_at(folders, -2)).otherwise("").alias("parent"),
    )
    return let(inputs, choose)


def _cte_bodies(content: Column, names: Column, spans: Column, d: Dialect) -> Column:
    """Map of CTE name -> raw text between its parentheses.

    A name defined twice keeps the definition that closes first (the inner one).
    """

    def cut(texts: Column) -> Column:
        def body(n: Column) -> Column:
            c = F.get(spans, F.array_position(names, n).cast("int") - 1)
            text = F.array_join(F.slice(texts, c.open + 2, c.close - c.open - 1), "")
            return F.regexp_replace(text, r"^\s+|\s+$", "")

        unique = F.array_distinct(names)
        return F.map_from_arrays(unique, F.transform(unique, body))

    # The second pass over the text runs only for scripts that have a CTE.
    return F.when(F.size(spans) > 0, let(tokens.covering_tokens(content, d), cut)).otherwise(
        F.create_map().cast(_NO_CTES)
    )


def _dependencies(base: Column, target: Column, refs: Column, cte_names: Column, d: Dialect, match: str) -> Column:
    """Sorted distinct names a script reads; CTE names become ``cte:<file>:<name>``."""
    names = F.transform(
        refs,
        lambda r: let(
            tokens.name_parts(r, d),
            lambda p: F.struct(
                F.array_join(p, ".").alias("full"),
                F.element_at(p, -1).alias("bare"),
                F.size(p).alias("n"),
            ),
        ),
    )

    def rewrite(x: Column) -> Column:
        if match == "bare":
            other = F.filter(x["names"], lambda n: n.bare != target.label)
            is_cte = lambda n: F.array_contains(x.cte_names, n.bare)
        else:
            dataset = F.when(target.dataset != "default", F.concat(target.dataset, F.lit(".")))
            project = F.when(target.project != "default", F.concat(target.project, F.lit(".")))
            own = F.concat(F.coalesce(project, F.lit("")), F.coalesce(dataset, F.lit("")), target.label)
            other = F.filter(x["names"], lambda n: n.full != own)
            is_cte = lambda n: (n.n == 1) & F.array_contains(x.cte_names, n.bare)
        marked = F.transform(
            other,
            lambda n: F.when(is_cte(n), F.concat(F.lit("cte:"), base, F.lit(":"), n.bare)).otherwise(n.full),
        )
        return F.array_sort(F.array_distinct(marked))

    return let(F.struct(names.alias("names"), cte_names.alias("cte_names")), rewrite)


def parse_scripts(
    scripts: DataFrame,
    dialect: str = "bigquery",
    match: str = "bare",
    columns: tuple[str, ...] = RECORD,
    root: str = "",
    aliases: bool = False,
) -> DataFrame:
    """One record per script: target, layer, type, dependencies, CTEs, error.

    The layer is read from the path below ``root``, by the marks in it, or with ``aliases`` by the
    documented folder aliases.  Only the first statement is read.  ``match='bare'`` compares names with the
    target and with CTE names by their last part; ``'qualified'`` compares the
    names as written.  A script that cannot be read keeps a row of type
    ``unknown`` with no dependencies and an ``error``.  Only the record
    ``columns`` asked for are computed; ``LIGHT`` is enough for a graph.
    """
    if match not in ("bare", "qualified"):
        raise ValueError("match must be 'bare' or 'qualified'")
    if not set(columns) <= set(RECORD):
        raise ValueError(f"columns must be among {RECORD}")
    dialect_of(dialect)
    app = scripts.sparkSession.sparkContext.applicationId
    record = _record_column(dialect.lower(), match, tuple(columns), app, root, aliases)
    # A generator keeps later filters and projections from copying the scan into themselves.
    return scripts.select(F.inline(F.array(record)))


@functools.lru_cache(maxsize=64)
def _record_column(
    dialect: str, match: str, columns: tuple[str, ...], app_id: str, root: str, aliases: bool
) -> Column:
    """The record as one column over ``path`` and ``content``.

    It does not depend on the DataFrame, so it is built once per session.
    """
    d = dialect_of(dialect)
    path, content = F.col("path"), F.col("content")

    def record(toks: Column, low: Column, x: Column) -> Column:
        good, base = x.error.isNull(), x.base

        def finish(y: Column) -> Column:
            fields = {
                "id": base,
                "label": F.when(good, y.target.label).otherwise(base),
                "layer": (naming.alias_layer_of if aliases else naming.layer_of)(naming.below(path, root)),
                "type": F.when(~good, "unknown").when(x.head.kind == "view", "view").otherwise("table"),
                "project": F.when(good, y.target.project).otherwise("n/a"),
                "dataset": F.when(good, y.target.dataset).otherwise("n/a"),
                "path": path,
                "dependencies": F.when(
                    good, F.when(
                        _without_refs(F.get(low, F.lit(0)), x.head), F.array().cast(_NO_NAMES)
                    ).otherwise(_dependencies(base, y.target, x.s.refs, y.cte_names, d, match))
                ).otherwise(F.array().cast(_NO_NAMES)),
                "content": content,
                "ctes": F.when(good, _cte_bodies(content, y.cte_names, x.s.ctes, d)).otherwise(
                    F.create_map().cast(_NO_CTES)
                ),
                "error": x.error,
            }
            return F.struct(*[fields[c].alias(c) for c in RECORD if c in columns])

        cte_names = F.transform(
            x.s.ctes, lambda c: F.element_at(tokens.name_parts(F.get(toks, c["name"]), d), -1)
        )
        parts = F.struct(_target(path, base, x.head, d).alias("target"), cte_names.alias("cte_names"))
        return let(parts, finish)

    def analyse(toks: Column, low: Column) -> Column:
        read = F.struct(
            tokens.scan(tokens.events(toks, low, d), low, from_first=dialect == "duckdb").alias("s"),
            tokens.create_head(toks, low, d).alias("head"),
        )

        def judged(r: Column) -> Column:
            return F.struct(
                r.s.alias("s"),
                r.head.alias("head"),
                naming.file_base(path).alias("base"),
                _error(toks, low, r.s, r.head, d).alias("error"),
            )

        return let(read, lambda r: let(judged(r), lambda x: record(toks, low, x)))

    return let(
        tokens.raw_tokens(content, d),
        lambda toks: let(F.transform(toks, lambda t: F.lower(t)), lambda low: analyse(toks, low)),
    )


def last_definition_wins(parsed: DataFrame) -> DataFrame:
    """One record per id: of several files with one base name, the greatest path.

    An aggregate rather than a window, so copies of one name are combined before
    the shuffle however many there are.  ``winning_scripts`` makes the same choice before parsing.
    """
    rest = [c for c in parsed.columns if c != "id"]
    best = parsed.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("path")).alias("r"))
    return best.select("id", *[F.col("r").getField(c).alias(c) for c in rest]).select(*parsed.columns)


def winning_scripts(scripts: DataFrame) -> DataFrame:
    """Scripts whose path is the greatest of their id, chosen before any text is parsed.

    The winner is found on names alone; texts are then kept by a semi-join, so losers are never read.
    """
    own = scripts.select("path").select(naming.file_base(F.col("path")).alias("id"), "path")
    last = own.groupBy("id").agg(F.max("path").alias("path")).select("path")
    return scripts.join(last, "path", "left_semi").select(*scripts.columns)


def table_refs(parsed: DataFrame) -> DataFrame:
    """(id, dep, kind) with kind ``table`` or ``cte``."""
    return parsed.select("id", F.explode("dependencies").alias("dep")).select(
        "id", "dep", F.when(F.col("dep").startswith("cte:"), "cte").otherwise("table").alias("kind")
    )


def cte_extract(parsed: DataFrame) -> DataFrame:
    """(id, cte, body) for every CTE a script defines."""
    return parsed.select("id", F.explode("ctes").alias("cte", "body"))


def statement_kind(parsed: DataFrame) -> DataFrame:
    return parsed.select("id", "path", "type")


def target_name(parsed: DataFrame) -> DataFrame:
    return parsed.select("id", "path", "project", "dataset", "label")


def parse_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that were read, and records that were not."""
    return parsed.where("error IS NULL"), parsed.where("error IS NOT NULL")


def parse_summary(parsed: DataFrame) -> DataFrame:
    """Scripts, failures and dependency counts per layer and type."""
    return parsed.groupBy("layer", "type").agg(
        F.count(F.lit(1)).alias("scripts"),
        F.count("error").alias("failures"),
        F.sum(F.size("dependencies")).cast("long").alias("dependencies"),
    )
