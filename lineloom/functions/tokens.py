"""Token-level reading of one script, as built-in column expressions.

A script is one row, so everything here is row-local: no shuffle, no Python in
the tasks.  A script's text becomes an array of tokens, the few tokens that
matter become *events*, and one ``aggregate`` over the events tracks the open
parentheses and the clause each of them is in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineloom.functions.dialects import Dialect, mark_pattern, part_pattern, token_pattern
from lineloom.functions.let import let

# Event codes.
OPEN, CLOSE, COMMA, END = 1, 2, 3, 4
SELECT, FROM, JOIN, WITH, CLAUSE, TARGET = 5, 6, 7, 8, 9, 10

# What the innermost open parenthesis currently holds.
PLAIN, QUERY, FROM_LIST, WITH_LIST = 0, 1, 2, 3

# Words that close a FROM list, so that later commas do not name tables.
CLAUSE_WORDS = (
    "where", "group", "having", "order", "qualify", "window", "limit", "set",
    "values", "when", "returning", "connect", "sort", "cluster", "distribute", "fetch",
)

# Words that can be an event at all; everything else is skipped with one lookup.
EVENT_WORDS = CLAUSE_WORDS + (
    "select", "from", "join", "with", "lateral", "into", "references", "table", "view",
    "overwrite", "insert", "update", "merge", "like", "clone", "copy", "using",
)

# Words that can stand where a table name is expected without being one.
NOT_A_NAME = (
    "select", "with", "from", "join", "where", "group", "having", "order", "limit",
    "qualify", "window", "on", "using", "set", "values", "when", "then", "case", "end",
    "union", "intersect", "except", "inner", "left", "right", "full", "cross", "natural",
    "lateral", "unnest", "as", "and", "or", "not", "null", "into", "if",
)

# Words a readable statement may begin with.
LEAD_WORDS = (
    "select", "with", "create", "insert", "update", "delete", "merge", "drop", "alter",
    "truncate", "from", "values", "replace", "explain", "describe", "desc", "show", "set",
    "use", "declare", "begin", "call", "copy", "export", "load", "grant", "revoke",
    "comment", "analyze", "cache", "refresh", "pivot", "table", "if", "(",
)

# Commands that are readable and read from no table.
COMMAND_WORDS = (
    "vacuum", "optimize", "reindex", "repair", "msck", "prepare", "execute", "exec", "deallocate",
    "lock", "unlock", "kill", "reset", "start", "commit", "rollback", "savepoint", "release", "abort",
    "attach", "detach", "install", "pragma", "checkpoint", "discard", "put", "get", "list", "remove",
    "undrop", "unset", "clear", "uncache", "add", "do", "print", "open", "close", "fetch", "raise",
    "rename", "import", "unload", "listen", "notify", "return", "assert", "end", "flush", "purge",
)

# Words after which something must follow.
UNFINISHED = (
    "select", "from", "join", "where", "group", "order", "having", "by", "on", "and", "or", "not",
    "union", "intersect", "except", "as", "with", "in", "like", "between", "set", "into", "using",
)

# Words that may stand among plain names at the head of a select list.
LIST_WORDS = (
    "distinct", "all", "top", "as", "case", "not", "interval", "date", "time", "timestamp", "exists",
    "struct", "array", "unique", "straight_join", "sql_no_cache", "sql_calc_found_rows", "at", "is", "in",
    "like", "ilike", "rlike", "similar", "regexp", "between", "collate", "div", "mod", "xor", "bulk",
    "value", "prior", "high_priority", "percent", "over", "escape", "except", "replace", "exclude",
)

# Objects a CREATE statement can make.
CREATE_KINDS = (
    "table", "view", "function", "procedure", "schema", "database", "index", "sequence",
    "model", "stage", "type", "role", "trigger", "macro", "policy", "task", "stream",
)


def _starts_clause(w: Column, nxt: Column, nxt2: Column, lead: Column) -> Column:
    """Whether a clause word stands where it begins its clause, rather than as a column's name."""
    operand = F.coalesce(nxt, F.lit(")")).rlike(r"^[=<>!+*%|&^~?:,).;/-]") | nxt.isin(
        "and", "or", "is", "in", "between", "like", "asc", "desc", "as", "from"
    )
    return (
        F.when(w.isin("where", "having"), True)
        .when(w.isin("group", "sort", "cluster", "distribute", "connect"), nxt == "by")
        .when(w == "order", nxt.isin("by", "siblings"))
        .when(w == "fetch", nxt.isin("first", "next"))
        .when(w == "window", nxt2 == "as")
        .when(w == "values", nxt == "(")
        .when(w == "set", (nxt == "(") | (nxt2 == "="))
        .when(w == "when", (lead == "merge") & ((nxt == "matched") | ((nxt == "not") & (nxt2 == "matched"))))
        .when(w.isin("limit", "qualify", "returning"), ~operand)
        .otherwise(False)
    )


def flat_comments(content: Column, d: Dialect) -> Column:
    """The text with the comment marks *inside* block comments blanked, where the dialect nests them.

    A pushdown scan: one ``aggregate`` over the marks of a script keeps the depth of open comments, without a limit, and what else is
    open (a string, a quoted name, a line comment).  Marks in those count for nothing, quotes in a comment neither.
    Only scripts with two comment openers are scanned.
    """
    if not d.nested_comments:
        return content
    closer = {q: "]" if q == "[" else q for q in d.name_quotes + d.string_quotes}

    def step(at: Column, t: Column) -> Column:
        inside, free = at["depth"] > 0, at["open"] == ""
        tag = t.startswith("$") & (F.length(t) > 1) if d.dollar_strings else F.lit(False)
        opened = F.when(tag | t.isin(*[q for q, c in closer.items() if q == c]), t)
        for q, c in closer.items():
            opened = opened.when(t == q, c) if q != c else opened
        opened = opened.when(t.isin(*d.line_comments), "\n").otherwise("")
        depth = (
            F.when(inside & (t == "/*"), at["depth"] + 1)
            .when(inside & (t == "*/"), at["depth"] - 1)
            .when(~inside & free & (t == "/*"), 1)
            .otherwise(at["depth"])
        )
        inner = inside & ((t == "/*") | ((t == "*/") & (at["depth"] > 1)))
        return F.struct(
            (at["i"] + 1).alias("i"), depth.cast("int").alias("depth"),
            F.when(inside, "").when(~free, F.when(t == at["open"], "").otherwise(at["open"])).otherwise(opened).alias("open"),
            F.when(inner, F.array_append(at["blank"], at["i"])).otherwise(at["blank"]).alias("blank"),
        )

    def flat(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<int>").alias("blank"))
        blank = F.aggregate(pieces, start, step, lambda at: at["blank"])
        spaced = lambda gone: F.transform(pieces, lambda t, i: F.when(F.array_contains(gone, i), "  ").otherwise(t))
        return F.array_join(let(blank, spaced), "")

    scanned = let(F.regexp_extract_all(content, F.lit(mark_pattern(d)), F.lit(0)), flat)
    return F.when(content.rlike(r"(?s)/\*.*/\*"), scanned).otherwise(content)


def raw_tokens(content: Column, d: Dialect) -> Column:
    return F.regexp_extract_all(flat_comments(content, d), F.lit(token_pattern(d)), F.lit(1))


def covering_tokens(content: Column, d: Dialect) -> Column:
    """Same tokens with the blanks and comments before them: joined, the whole text (marks inside nested comments blanked)."""
    return F.regexp_extract_all(flat_comments(content, d), F.lit(token_pattern(d)), F.lit(0))


def name_parts(raw: Column, d: Dialect) -> Column:
    """Parts of a dotted name with their quotes taken off."""
    quotes = d.name_quotes + d.string_quotes + ("]" if "[" in d.name_quotes else "")
    cls = "".join("\\" + q for q in quotes)
    strip = f"^[{cls}]+|[{cls}]+$"
    if d.split_quoted:
        return F.split(F.regexp_replace(raw, rf"[{cls}\s]", ""), r"\.")
    parts = F.regexp_extract_all(raw, F.lit(part_pattern(d)), F.lit(0))
    return F.transform(parts, lambda p: F.regexp_replace(p, strip, ""))


def _at(arr: Column, pos) -> Column:
    """Element at a 0-based position, null outside the array."""
    return F.get(arr, pos)


def _looks_like_name(raw: Column, word: Column, d: Dialect) -> Column:
    """A word, or a quoted name or literal, that can stand for a table."""
    first = F.ascii(raw)
    quotes = [ord(q) for q in d.name_quotes + d.string_quotes]
    opens = (
        first.between(ord("a"), ord("z"))
        | first.between(ord("A"), ord("Z"))
        | first.isin(*[ord(c) for c in ("_$#" if d.hash_names else "_$")])
        # A lone quote mark is an unclosed literal, not a name.
        | (first.isin(*quotes) & (F.length(raw) > 1))
        | ((first > 127) & raw.rlike(r"^\p{L}"))
    )
    return opens & ~word.isin(*NOT_A_NAME)


def events(toks: Column, low: Column, d: Dialect) -> Column:
    """Array of (code, pos, cand, name, name_ok) for the tokens that matter.

    ``cand`` is where the next table name would stand and ``name`` is the token
    there if it can be a table name (``FROM f(x)`` names no table).
    """
    lead = _at(low, F.lit(0))
    ddl = lead.isin("create", "drop", "alter", "replace")

    def event(i: Column) -> Column:
        w = _at(low, i)
        prev, prev2 = _at(low, i - 1), _at(low, i - 2)
        nxt, nxt2, nxt3 = _at(low, i + 1), _at(low, i + 2), _at(low, i + 3)

        is_cte = (
            (nxt == "recursive")
            | (nxt2 == "(")
            | ((nxt2 == "as") & nxt3.isin("(", "materialized", "not"))
        )
        target = (
            (w == "into")
            | (w == "references")
            | ((w == "table") & (nxt != "("))
            | ((w == "view") & ddl & (prev != "lateral"))
            | ((w == "overwrite") & ~nxt.isin("table", "into", "local", "directory"))
            | ((w == "insert") & (i == 0) & ~nxt.isin("into", "overwrite", "or", "ignore", "all", "first"))
            | ((w == "update") & (i == 0))
            | ((w == "merge") & (i == 0) & (nxt != "into"))
            | (w.isin("like", "clone", "copy") & ddl & prev2.isin("table", "view", "exists"))
            | ((w == "using") & lead.isin("merge", "delete") & (nxt != "("))
        )
        rows_from = (prev == "rows") & (nxt == "(") & prev2.isin(",", "from", "join", "lateral")
        from_head = (
            F.coalesce(prev != "distinct", F.lit(True))
            & ~F.coalesce(rows_from, F.lit(False))
            & ~lead.isin("grant", "revoke")
        )
        code = (
            F.when(w == "(", OPEN)
            .when(w == ")", CLOSE)
            .when(w == ",", COMMA)
            .when(w == ";", END)
            .when(w == "select", SELECT)
            .when((w == "from") & from_head, FROM)
            .when(w == "join", JOIN)
            .when((w == "with") & is_cte, WITH)
            .when(w.isin(*CLAUSE_WORDS) & _starts_clause(w, nxt, nxt2, lead), CLAUSE)
            .when((w == "lateral") & (nxt == "view"), CLAUSE)
            .when(target, TARGET)
            .otherwise(0)
        )
        cand = (
            F.when(w.isin("table", "view") & (nxt == "if"), i + F.when(nxt2 == "not", 4).otherwise(3))
            .when(nxt.isin("lateral", "only", "recursive"), i + 2)
            .otherwise(i + 1)
        )
        return F.struct(F.coalesce(code, F.lit(0)).alias("code"), i.alias("pos"), cand.alias("cand"))

    def named(e: Column) -> Column:
        raw, word, after = _at(toks, e.cand), _at(low, e.cand), _at(toks, e.cand + 1)
        readable = F.coalesce(_looks_like_name(raw, word, d), F.lit(False))
        call = F.coalesce(after == "(", F.lit(False)) & (e.code != TARGET)
        call = call | ((word == "rows") & F.coalesce(F.lower(after) == "from", F.lit(False)))
        return F.struct(
            e.code.alias("code"),
            e.pos.alias("pos"),
            e.cand.alias("cand"),
            F.when(readable & ~call, raw).alias("name"),
            # After FROM/JOIN something must follow that can be read from.
            (
                readable
                | F.coalesce(word.isin("(", "unnest", "values", "lateral", "table"), F.lit(False))
                # A stage or a table variable.
                | F.coalesce(word.startswith("@"), F.lit(False))
            ).alias("fed"),
        )

    # One set lookup drops most tokens before any of the above is evaluated.
    marks = F.filter(
        F.sequence(F.lit(0), F.size(low) - 1), lambda i: _at(low, i).isin("(", ")", ",", ";", *EVENT_WORDS)
    )
    found = F.filter(F.transform(marks, event), lambda e: e.code != 0)
    return F.transform(found, named)


_FRAME = "struct<cur:int,cte:int,open:int>"
_CTE = "struct<name:int,open:int,close:int>"


def scan(evs: Column, low: Column, from_first: bool) -> Column:
    """Fold the events into the table names and CTE spans of the first statement.

    A name counts after FROM or JOIN, or after a comma while the innermost
    parenthesis is in a FROM list.  ``EXTRACT(DAY FROM ts)`` is out because its
    parenthesis holds no SELECT; sibling parentheses never share state.
    """

    def state(s: Column, **change: Column) -> Column:
        fields = (
            "stack", "cur", "cte", "expect", "refs", "ctes", "unbalanced", "dangling", "done",
        )
        return F.struct(*[change.get(f, s.getField(f)).alias(f) for f in fields])

    def num(n: int) -> Column:
        return F.lit(n).cast("int")

    def with_name(s: Column, e: Column) -> Column:
        return F.when(e["name"].isNotNull(), F.concat(s.refs, F.array(e["name"]))).otherwise(s.refs)

    def step(s: Column, e: Column) -> Column:
        top = F.element_at(s.stack, -1)
        nested = F.size(s.stack) > 0
        expected = e.pos == s.expect

        opened = state(
            s,
            stack=F.concat(
                s.stack,
                F.array(F.struct(s.cur.alias("cur"), s.cte.alias("cte"), e.pos.alias("open"))),
            ),
            cur=F.when(expected, num(FROM_LIST)).otherwise(num(PLAIN)),
            cte=num(-1),
            expect=F.when(expected, e.cand).otherwise(num(-1)),
            refs=F.when(expected, with_name(s, e)).otherwise(s.refs),
        )
        body_closed = (top.cur == WITH_LIST) & _at(low, top.open - 1).isin("as", "materialized")
        closed = state(
            s,
            stack=F.slice(s.stack, 1, F.size(s.stack) - 1),
            cur=top.cur,
            cte=top.cte,
            expect=num(-1),
            ctes=F.when(
                body_closed,
                F.concat(
                    s.ctes,
                    F.array(
                        F.struct(top.cte.alias("name"), top.open.alias("open"), e.pos.alias("close"))
                    ),
                ),
            ).otherwise(s.ctes),
        )
        from_ok = (s.cur != PLAIN) | ~nested
        if from_first:
            from_ok = from_ok | (e.pos == top.open + 1)
        comma = (
            F.when(s.cur == FROM_LIST, state(s, refs=with_name(s, e), expect=e.cand))
            .when(s.cur == WITH_LIST, state(s, cte=e.cand))
            .otherwise(s)
        )
        return (
            F.when(e.code == OPEN, opened)
            .when((e.code == CLOSE) & nested, closed)
            .when(e.code == CLOSE, state(s, unbalanced=F.lit(True)))
            .when(e.code == END, state(s, unbalanced=s.unbalanced | nested, done=F.lit(True)))
            .when(s.done, s)
            .when(e.code == COMMA, comma)
            .when(e.code == SELECT, state(s, cur=num(QUERY), expect=num(-1)))
            .when(
                (e.code == JOIN) | ((e.code == FROM) & from_ok),
                state(
                    s,
                    cur=num(FROM_LIST),
                    refs=with_name(s, e),
                    expect=e.cand,
                    dangling=s.dangling | ~e.fed,
                ),
            )
            .when(e.code == WITH, state(s, cur=num(WITH_LIST), cte=e.cand))
            .when(
                e.code == CLAUSE,
                state(
                    s,
                    cur=F.when(s.cur == FROM_LIST, num(QUERY)).otherwise(s.cur),
                    expect=num(-1),
                ),
            )
            .when(e.code == TARGET, state(s, refs=with_name(s, e), expect=num(-1)))
            .otherwise(s)
        )

    start = F.struct(
        F.array().cast(f"array<{_FRAME}>").alias("stack"),
        num(PLAIN).alias("cur"),
        num(-1).alias("cte"),
        num(-1).alias("expect"),
        F.array().cast("array<string>").alias("refs"),
        F.array().cast(f"array<{_CTE}>").alias("ctes"),
        F.lit(False).alias("unbalanced"),
        F.lit(False).alias("dangling"),
        F.lit(False).alias("done"),
    )
    return F.aggregate(evs, start, step)


def head_end(low: Column) -> Column:
    """How many tokens a CREATE's head has: all before the first AS, parenthesis or semicolon."""
    stops = [F.nullif(F.array_position(low, w), F.lit(0)) for w in ("as", "(", ";")]
    return (F.coalesce(F.least(*stops), F.size(low) + 1) - 1).cast("int")


def create_head(toks: Column, low: Column, d: Dialect) -> Column:
    """For ``CREATE [words] KIND [IF NOT EXISTS] name``: kind, raw name, column-list flag, words of the head.

    The kind is looked for in the whole head, however many words stand before it.
    """

    def head(h: Column) -> Column:
        found = F.array_position(F.transform(h, lambda w: w.isin(*CREATE_KINDS)), True)
        return let(F.struct((found.cast("int") - 1).alias("k"), F.size(h).alias("n")), described)

    def described(x: Column) -> Column:
        k = x.k
        name_pos = k + F.when(_at(low, k + 1) == "if", F.lit(4)).otherwise(F.lit(1))
        raw = _at(toks, name_pos)
        readable = F.coalesce(_looks_like_name(raw, _at(low, name_pos), d), F.lit(False))
        return F.struct(
            F.when(k > 0, _at(low, k)).alias("kind"),
            F.when((k > 0) & readable, raw).alias("name"),
            F.coalesce(_at(toks, name_pos + 1) == "(", F.lit(False)).alias("has_columns"),
            x.n.alias("words"),
        )

    return F.when(_at(low, F.lit(0)) == "create", let(F.slice(low, F.lit(1), head_end(low)), head))


def misplaced(toks: Column, low: Column, d: Dialect) -> Column:
    """What neighbouring tokens show to be broken, or null.  Only pairs and triples of tokens are looked at."""
    marks = F.filter(
        F.sequence(F.lit(0), F.size(low) - 1), lambda i: _at(low, i).isin(",", "group", "order", "select", *UNFINISHED)
    )
    plain = lambda i: (
        _at(low, i).rlike(r"^[\p{L}_][\p{L}\p{N}_.]*$") & ~_at(low, i).isin(*NOT_A_NAME, *LIST_WORDS, *CLAUSE_WORDS)
    )

    def fault(i: Column) -> Column:
        w, prev, nxt = _at(low, i), _at(low, i - 1), _at(low, i + 1)
        closes = [",", ";", "", "where", "group", "having", "order", "union"] + ([] if d.trailing_commas else [")", "from"])
        ended = F.coalesce(prev.rlike(r"^[\p{L}\p{N}_)\]`\"']"), F.lit(False)) & ~F.coalesce(
            prev.isin(*UNFINISHED, "within", "resource", "create", "alter", "drop", "replace", "table", "view", "update", "to"), F.lit(False)
        )
        return (
            F.when((w == ",") & nxt.isin(*closes), "misplaced comma")
            .when(w.isin(*UNFINISHED) & F.coalesce(nxt.isin("", ";"), F.lit(True)) & (i > 0), "clause without content")
            .when(w.isin("group", "order") & ended & plain(i + 1) & ~nxt.isin("by", "siblings", "all"), "GROUP or ORDER without BY")
            .when((w == "select") & plain(i + 1) & plain(i + 2) & plain(i + 3), "names side by side")
        )

    return F.get(F.array_compact(F.transform(marks, fault)), F.lit(0))
