"""What a SQL dialect means to the token scan: quotes, comments and name rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """Lexical facts only; there is no grammar behind a dialect."""

    name_quotes: str  # characters that open a quoted name
    string_quotes: str  # characters that open a string literal
    backslash: bool = False  # backslash escapes inside string literals
    line_comments: tuple[str, ...] = ("--",)
    split_quoted: bool = False  # a dot inside a quoted name separates parts
    dashed: bool = False  # the first part of a dotted path may hold dashes
    dollar_strings: bool = False  # $tag$ ... $tag$
    triple_quotes: bool = False
    nested_comments: bool = False  # a block comment may hold others
    hash_names: bool = False  # a name may begin with #, as temporary tables do
    wildcard_names: bool = False  # a name may end in _*
    trailing_commas: bool = False  # a list may end with a comma


DIALECTS = {
    "ansi": Dialect('"', "'"),
    "athena": Dialect('"`', "'"),
    "bigquery": Dialect(
        "`", "'\"", True, ("--", "#"), split_quoted=True, dashed=True, triple_quotes=True,
        wildcard_names=True, trailing_commas=True,
    ),
    "clickhouse": Dialect('"`', "'", True, ("--", "#")),
    "databricks": Dialect("`", "'\"", True, nested_comments=True),
    "duckdb": Dialect('"', "'", dollar_strings=True, nested_comments=True, trailing_commas=True),
    "hive": Dialect("`", "'\"", True),
    "mysql": Dialect("`", "'\"", True, ("--", "#")),
    "oracle": Dialect('"', "'"),
    "postgres": Dialect('"', "'", dollar_strings=True, nested_comments=True),
    "presto": Dialect('"', "'"),
    "redshift": Dialect('"', "'", True, nested_comments=True, hash_names=True),
    "snowflake": Dialect('"', "'", True, ("--", "//"), dollar_strings=True, trailing_commas=True),
    "spark": Dialect("`", "'\"", True, nested_comments=True),
    "sqlite": Dialect('"`[', "'"),
    "teradata": Dialect('"', "'"),
    "trino": Dialect('"', "'"),
    "tsql": Dialect('"[', "'", nested_comments=True, hash_names=True),
}

_QUOTED_NAME = {
    "`": r"`[^`]*+`",
    '"': r'"(?:[^"]++|"")*+"',
    "[": r"\[[^\]]*+\]",
}


def dialect_of(name: str) -> Dialect:
    try:
        return DIALECTS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown dialect {name!r}; use one of {sorted(DIALECTS)}") from None


def _strings(d: Dialect) -> list[str]:
    out = []
    for q in d.string_quotes:
        if d.triple_quotes:
            out.append(f"{q * 3}.*?{q * 3}")
        inner = rf"[^{q}\\]++|\\.|{q}{q}" if d.backslash else f"[^{q}]++|{q}{q}"
        out.append(f"{q}(?:{inner})*+{q}")
    if d.dollar_strings:
        out.append(r"\$(\w*+)\$.*?\$\2\$")
    return out


def part_pattern(d: Dialect) -> str:
    """One part of a dotted name, quoted or bare (also a whole string literal)."""
    quoted = [_QUOTED_NAME[q] for q in d.name_quotes]
    strings = [f"{q}[^{q}]*+{q}" for q in d.string_quotes]
    bare = r"[\p{L}\p{N}_$@#*-]++"
    return "|".join([*quoted, *strings, bare])


#: A block comment that holds no other; see ``tokens.flat_comments`` for those that do.
BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"


def mark_pattern(d: Dialect) -> str:
    """Pattern whose matches tile the text into what opens or closes comments, strings and quoted names, and the rest."""
    marks = [r"/\*", r"\*/", "\n", *d.line_comments]
    if d.backslash:
        marks.append(r"\\.")
    if d.dollar_strings:
        marks.append(r"\$\w*+\$")
    quotes = "".join(sorted({*d.name_quotes, *d.string_quotes, *("]" if "[" in d.name_quotes else "")}))
    quotes = "".join("\\" + q for q in quotes)
    starts = "".join("\\" + c for c in sorted({c[0] for c in d.line_comments}))
    return f"(?s){'|'.join(marks)}|[{quotes}]|[^/*\\n\\\\$" + quotes + starts + "]++|."


def token_pattern(d: Dialect) -> str:
    """Pattern whose matches tile the text: group 1 is a token, group 0 adds the
    blanks and comments before it.

    Repetitions are possessive, so matching neither backtracks nor recurses on
    long comments or literals.  The empty match at the end of the text lets a
    trailing comment be consumed as a comment.
    """
    comments = [rf"{c}[^\n]*+" for c in d.line_comments]
    comments.append(BLOCK_COMMENT)
    trivia = r"(?:[\s\u00a0\ufeff]++|" + "|".join(comments) + ")*+"

    quoted = [_QUOTED_NAME[q] for q in d.name_quotes]
    sign = "#" if d.hash_names else ""
    first = rf"[\p{{L}}_$@{sign}][\p{{L}}\p{{N}}_$@{sign}]*+" + (r"(?:(?:-[\p{L}\p{N}_]++)++(?=\.))?+" if d.dashed else "")
    head = "|".join([*quoted, first])
    tail = "|".join([*quoted, rf"[\p{{L}}\p{{N}}_$@{sign}]++"])
    dotted = rf"(?:{head})(?:\s*+\.\s*+(?:{tail}))*+"
    if d.wildcard_names:
        dotted += r"(?:(?<=_)\*(?![\p{L}\p{N}_(]))?+"

    tokens = [
        *_strings(d),
        dotted,
        r"[0-9][\p{L}\p{N}_.]*+",
        r"[(),;]",
        r"[=<>!+*%|&^~?:{}]++",
        r".",
        r"\z",
    ]
    return "(?s)" + trivia + "(" + "|".join(tokens) + ")"
