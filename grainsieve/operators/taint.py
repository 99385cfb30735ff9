"""Data-flow facts: expression classes, reaching definitions, propagation, sink gate.

Flavours are ranks: constant 0 < unknown 1 < sanitized 2 < tainted 3, so merging is ``max``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.functions.text import let, trim_space
from grainsieve.operators.asof import last_before
from grainsieve.session import cut_lineage

CONSTANT, UNKNOWN, SANITIZED, TAINTED = RANKS = (0, 1, 2, 3)

# Sanitizers, accessors and untrusted source objects.
SANITIZER_METHODS = {
    "DOMPurify": ("sanitize",),
    "sanitizeHtml": ("sanitize",),
    "validator": ("escape",),
    "xssFilters": (
        "inHTMLData", "inDoubleQuotedAttr", "inSingleQuotedAttr", "inUnQuotedAttr",
        "uriPathInHTMLData", "uriInDoubleQuotedAttr", "uriInSingleQuotedAttr",
    ),
    "he": ("encode",),
    "xss": ("filterXSS",),
    "CSS": ("escape",),
}
SANITIZER_FUNCTIONS = ("encodeURIComponent", "encodeURI", "escape", "sanitize", "sanitizeHtml")
PASSTHROUGH_METHODS = ("trim", "trimStart", "trimEnd", "toLowerCase", "toUpperCase", "toString")
SOURCE_OBJECTS = (
    "req", "request", "ctx", "context", "location", "document", "window", "process", "params",
    "query", "body", "headers", "cookies", "router", "route", "props", "searchParams",
    "localStorage", "sessionStorage",
)
SOURCE_ACCESSORS = (
    (("localStorage", "sessionStorage", "headers", "searchParams"), ("get",)),
    (("localStorage", "sessionStorage"), ("getItem",)),
    (("params", "query", "body", "cookies"), ("get", "param")),
)
KEYWORDS = (
    "new", "typeof", "function", "return", "await", "async", "true", "false", "null", "undefined",
    "this", "super", "instanceof", "in", "of", "void", "delete", "var", "let", "const", "if", "else",
)

# Masked expressions: "" is a text, @ a parenthesised part, # a subscript, ' a braced part.
IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"
_TAIL = rf"(?:\.{IDENT}|#|@)*"
TEMPLATE_STEPS = (
    (r"`[^`$]*(?:\$[^`{$][^`$]*)*`", '""'),
    (r"`[^`$]*\$\{", '""+'),
    (r"\}[^`{}$]*\$\{", '+""+'),
    (r"\}[^`{}]*`", '+""'),
)
STRING = r""""[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'"""
MASK_STEPS = ((r"\([^()\[\]{}]*\)", "@"), (r"\[[^()\[\]{}]*\]", "#"), (r"\{[^()\[\]{}]*\}", "'"))
BRACKET = r"[()\[\]{}]"
#: Positions are line * 2^31 + byte; a bucket of the as-of join holds so many lines.
BUCKET = 4096 << 31
BINARY = r"\s*(?:\|\||&&|\?\?|===?|!==?|[<>]=?|[-+*/%&|^]|\binstanceof\b|\bin\b)\s*"
NOT_SIMPLE = r"=>|\?[^.?]|,|[^=!<>]=[^=]|^(?:new|await|function|async|class)\b"
UNARY = r"^(?:[!~+-]|typeof\s+|void\s+|delete\s+)+\s*"
CONST_PART = r'^(?:""|true|false|null|[0-9][A-Za-z0-9_.]*)$'
REGEX_LITERAL = r"^/[^/*].*/[a-z]*$"
SANITIZED_PART = (
    "^(?:(?:" + "|".join(SANITIZER_FUNCTIONS) + ")@|"
    + "|".join(rf"{root}{_TAIL}\.(?:{'|'.join(ms)})@" for root, ms in SANITIZER_METHODS.items()) + ")$"
)
PASS_SUFFIX = r"(?:\.(?:" + "|".join(PASSTHROUGH_METHODS) + r")@)+$"
TAINTED_PART = (
    "^(?:" + "|".join(rf"(?:{'|'.join(roots)}){_TAIL}\.(?:{'|'.join(ms)})@" for roots, ms in SOURCE_ACCESSORS)
    + rf"|(?:{'|'.join(SOURCE_OBJECTS)}){_TAIL}\.{IDENT}@?)$"
)
OBJECT_KEY = rf"([{{,]\s*){IDENT}\s*:"
REFERENCE = rf"(?:^|[^.A-Za-z0-9_$])({IDENT})"


def _steps(c: Column, steps) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def _plain(expr: Column) -> Column:
    """Templates as concatenations, texts as ``""``."""
    return F.regexp_replace(_steps(expr, TEMPLATE_STEPS), STRING, '""')


def _depths(text: Column, start: Column | int) -> Column:
    """struct(depth, low, high) after the brackets of a text; a closing bracket without a partner counts as none."""
    at = F.lit(start).cast("int") if isinstance(start, int) else start

    def step(acc: Column, bracket: Column) -> Column:
        depth = F.when(bracket.isin("(", "[", "{"), acc["depth"] + 1).otherwise(F.greatest(acc["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), F.least(acc["low"], depth).alias("low"), F.greatest(acc["high"], depth).alias("high"))

    first = F.struct(at.alias("depth"), at.alias("low"), at.alias("high"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(BRACKET), F.lit(0)), first, step)


def _mask(plain: Column) -> Column:
    """Bracketed parts as one character each, in as many rounds as brackets nest; one without a partner stays."""
    def masked(text: Column) -> Column:
        rounds = let(_depths(text, 0)["high"], lambda high: F.slice(F.sequence(F.lit(0), high), F.lit(2), high))
        return F.when(F.rlike(text, F.lit(BRACKET)), F.aggregate(rounds, text, lambda t, _: _steps(t, MASK_STEPS))).otherwise(text)

    return trim_space(F.replace(let(plain, masked), F.lit("?."), F.lit(".")))


def _unwrap(expr: Column) -> Column:
    """Drop the parentheses around a whole expression, however many."""
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))

    def levels(p: Column, lead: Column, trail: Column) -> Column:
        """How many outermost pairs hold all the rest: no bracket between the first and last ones closes them."""
        middle = F.substring(p, F.length(lead) + 1, F.length(p) - F.length(lead) - F.length(trail))
        return let(
            _depths(middle, count(lead, "(")),
            lambda d: F.when(d["depth"] == count(trail, ")"), F.least(d["low"], d["depth"])).otherwise(0),
        )

    def strip(e: Column) -> Column:
        pairs = let(_plain(e), lambda p: levels(
            p, F.regexp_extract(p, r"^[\s(]*", 0), F.regexp_extract(F.reverse(p), r"^[\s)]*", 0)))

        def inner(n: Column) -> Column:
            start = F.length(F.call_function("substring_index", e, F.lit("("), n)) + 1
            end = F.length(e) - F.length(F.call_function("substring_index", e, F.lit(")"), -n)) - 1
            return F.when(n > 0, trim_space(F.substring(e, start + 1, end - start))).otherwise(e)

        return F.when(F.startswith(e, F.lit("(")) & F.endswith(e, F.lit(")")), let(pairs, inner)).otherwise(e)

    return let(trim_space(expr), strip)


def referenced_names(expr: Column) -> Column:
    """Distinct identifiers an expression refers to: no property names, object keys, keywords."""
    text = F.replace(_plain(expr), F.lit("..."), F.lit(" "))
    text = F.regexp_replace(text, OBJECT_KEY, "$1")
    names = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(*KEYWORDS)))


def bound_names(target: Column) -> Column:
    """Names bound by an assignment target, including destructuring patterns.

    Identifiers anywhere below the target count: ``a.href`` binds ``a``, ``o[k]`` binds both.
    """
    return referenced_names(target)


def classify_expression(expr: Column) -> Column:
    """Facts of an expression: struct(base, ids, pass_ids, all_ids).

    ``base`` is the merged rank of the parts with a fixed class (null without any), ``ids`` the
    parts that are plain identifiers, ``pass_ids`` identifiers behind sanitizing-neutral methods,
    ``all_ids`` every identifier referred to.
    """
    def facts(e: Column) -> Column:
        def with_mask(m: Column) -> Column:
            whole_regex = F.rlike(e, F.lit(REGEX_LITERAL))
            simple = ~F.rlike(m, F.lit(NOT_SIMPLE))
            parts = F.filter(
                F.transform(F.split(m, BINARY, -1), lambda p: trim_space(F.regexp_replace(p, UNARY, ""))),
                lambda p: p != "",
            )

            def part(p: Column) -> Column:
                core = F.regexp_replace(p, PASS_SUFFIX, "")
                is_name = F.rlike(p, F.lit(f"^{IDENT}$")) & ~p.isin(*KEYWORDS)
                return F.struct(
                    F.when(F.rlike(p, F.lit(CONST_PART)), CONSTANT)
                    .when(F.rlike(core, F.lit(SANITIZED_PART)), SANITIZED)
                    .when(F.rlike(p, F.lit(TAINTED_PART)), TAINTED)
                    .when(is_name | _pass_name(p, core), F.lit(None))
                    .otherwise(UNKNOWN).alias("rank"),
                    F.when(is_name, p).alias("id"),
                    F.when(~is_name & _pass_name(p, core), core).alias("pass_id"),
                )

            classes = F.when(whole_regex, F.array(_fixed(CONSTANT))).when(~simple, F.array(_fixed(UNKNOWN))).otherwise(
                F.transform(parts, part)
            )
            return let(
                classes,
                lambda cs: F.struct(
                    F.array_max(F.transform(cs, lambda c: c["rank"])).alias("base"),
                    F.array_distinct(F.array_compact(F.transform(cs, lambda c: c["id"]))).alias("ids"),
                    F.array_distinct(F.array_compact(F.transform(cs, lambda c: c["pass_id"]))).alias("pass_ids"),
                    referenced_names(e).alias("all_ids"),
                ),
            )

        return let(_mask(_plain(e)), with_mask)

    return let(_unwrap(expr), facts)


def _pass_name(p: Column, core: Column) -> Column:
    return (core != p) & F.rlike(core, F.lit(f"^{IDENT}$")) & ~core.isin(*KEYWORDS) & ~F.rlike(p, F.lit(TAINTED_PART))


def _fixed(rank: int) -> Column:
    return F.struct(F.lit(rank).alias("rank"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("pass_id"))


def is_literal(expr: Column) -> Column:
    """A literal, or a composition of literals, without looking at any variable."""
    return let(
        classify_expression(expr),
        lambda f: (F.coalesce(f["base"], F.lit(UNKNOWN)) == CONSTANT) & (F.size(f["ids"]) == 0) & (F.size(f["pass_ids"]) == 0),
    )


def rank_from_states(facts: Column, states: Column) -> Column:
    """Rank of an expression given ``states`` (map name -> rank; a missing name is unknown)."""
    state = lambda n: F.coalesce(F.try_element_at(states, n), F.lit(UNKNOWN))
    direct = F.array_max(F.concat(
        F.array(facts["base"]),
        F.transform(facts["ids"], state),
        F.transform(facts["pass_ids"], lambda n: F.when(state(n) == SANITIZED, SANITIZED).otherwise(UNKNOWN)),
    ))
    direct = F.coalesce(direct, F.lit(UNKNOWN))
    fallback = F.array_max(F.transform(facts["all_ids"], state))
    return F.when(direct != UNKNOWN, direct).otherwise(F.coalesce(fallback, F.lit(UNKNOWN)))


# --- facts from source lines ----------------------------------------------------------------

ASSIGNMENT = (
    rf"(?:\b(?:var|let|const)\s+(\{{[^{{}}=]*\}}|\[[^\[\]=]*\]|{IDENT})|({IDENT}(?:\.{IDENT}|\[[^\[\]]*\])*))"
    r"\s*=\s*([^=>;\s][^;]*)"
)


def extract_assignments(lines: DataFrame) -> DataFrame:
    """Assignment facts (file, pos, targets, expr) of JavaScript lines, one per match.

    ``pos`` is line number * 2^31 + byte offset, so document order holds across lines.
    """
    from grainsieve.operators.lexical import Pattern, find_matches

    found = find_matches(lines, [Pattern("assign", ASSIGNMENT, 3, any_of=("=",))])
    target = F.when(F.get("captures", 0) != "", F.get("captures", 0)).otherwise(F.get("captures", 1))
    return found.select(
        F.col("path").alias("file"),
        (F.col("line_no").cast("long") * (1 << 31) + F.col("start")).alias("pos"),
        bound_names(target).alias("targets"),
        F.get("captures", 2).alias("expr"),
    )


# --- joins and propagation ------------------------------------------------------------------


def reaching_definitions(defs: DataFrame, uses: DataFrame, bucket_width: int = BUCKET) -> DataFrame:
    """For each use (file, pos, name): ``def_pos``, the latest definition strictly before it.

    ``defs`` has (file, pos, name).
    """
    events = (
        defs.select("file", "pos", "name", F.col("pos").alias("_def"), F.lit(False).alias("_use"))
        .unionByName(uses.select("file", "pos", "name", F.lit(None).cast("long").alias("_def"), F.lit(True).alias("_use")))
    )
    # at one position the use comes first: an expression sees the state before its own assignment
    ordered = events.withColumn("_at", F.col("pos") * 2 + F.when(F.col("_use"), 0).otherwise(1))
    found = last_before(ordered, ["file", "name"], "_at", "_def", "def_pos", bucket_width * 2)
    return found.filter("_use").select("file", "pos", "name", "def_pos")


def propagate(assignments: DataFrame, fold_limit: int = 1000, bucket_width: int = BUCKET) -> DataFrame:
    """Rank of every assignment (file, pos, targets, rank), in document order semantics.

    Each right-hand side sees the state at its own position.  Files of up to ``fold_limit``
    assignments are folded in order inside one row; larger ones, which must not be gathered,
    are settled exactly by rounds of joins, as many as the logarithm of the longest alias chain.
    """
    facts = cut_lineage(
        assignments.select("file", "pos", "targets", classify_expression(F.col("expr")).alias("facts"))
    )
    large = facts.groupBy("file").count().filter(F.col("count") > fold_limit).select("file")
    if large.isEmpty():
        return _propagate_fold(facts)
    large = cut_lineage(large)
    small = facts.join(large, "file", "left_anti")
    rest = facts.join(large, "file", "left_semi")
    return _propagate_fold(small).unionByName(_propagate_jumps(rest, bucket_width))


def _propagate_fold(facts: DataFrame) -> DataFrame:
    """One ordered fold per file over (states, ranks); the groups are bounded by the caller."""
    grouped = facts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", "targets", "facts"))).alias("_rows"))
    start = F.struct(
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("states"),
        F.array().cast("array<int>").alias("ranks"),
    )

    def step(acc: Column, row: Column) -> Column:
        return let(
            rank_from_states(row["facts"], acc["states"]),
            lambda rank: F.struct(
                F.map_concat(
                    F.map_filter(acc["states"], lambda k, _v: ~F.array_contains(row["targets"], k)),
                    F.map_from_arrays(row["targets"], F.array_repeat(rank, F.size(row["targets"]))),
                ).alias("states"),
                F.concat(acc["ranks"], F.array(rank)).alias("ranks"),
            ),
        )

    folded = grouped.select("file", "_rows", F.aggregate("_rows", start, step, lambda a: a["ranks"]).alias("_ranks"))
    return folded.select(
        "file",
        F.explode(F.transform("_rows", lambda r, i: F.struct(
            r["pos"].alias("pos"), r["targets"].alias("targets"), F.get("_ranks", i).alias("rank")
        ))).alias("_r"),
    ).select("file", "_r.*")


def _propagate_jumps(facts: DataFrame, bucket_width: int) -> DataFrame:
    """Pointer doubling over definition links.

    A link leads from a name in an expression to the definition that it sees, its root, and holds the name's rank for each
    of the four ranks that the root may have.  An expression whose links all have one root is such a map itself, so links
    to it jump to its root and compose the maps; one without open links is settled, and links to it become constant.  A
    chain of n aliases takes about log2(n) rounds, whatever else its expressions refer to, once that is settled.  Where
    several open roots meet in an expression it waits for all but one; roots point strictly backwards, so each round settles
    some.  Each round is written to the shared folder, so a lost executor replays one round.
    """
    defs = facts.select("file", "pos", F.explode("targets").alias("name"))
    uses = facts.select("file", "pos", F.explode("facts.all_ids").alias("name"))
    links = reaching_definitions(defs, uses, bucket_width).filter(F.col("def_pos").isNotNull())
    same = F.array(*[F.lit(r) for r in RANKS]).alias("ranks")
    linked = links.groupBy("file", "pos").agg(
        F.collect_list(F.struct("name", F.col("def_pos").alias("root"), same)).alias("links")  # at most the names of one expression
    )
    no_links = F.array().cast("array<struct<name:string,root:bigint,ranks:array<int>>>")

    def with_map(rows: DataFrame) -> DataFrame:
        """The open roots, and the ranks of an expression that has one at most."""
        roots = F.array_distinct(F.array_compact(F.transform("links", lambda o: o["root"])))
        states = lambda r: F.map_from_entries(F.transform("links", lambda o: F.struct(o["name"], o["ranks"][r])))
        own = F.array(*[rank_from_states(F.col("facts"), states(r)) for r in RANKS])
        return rows.withColumn("roots", roots).withColumn("ranks", F.when(F.size("roots") <= 1, own))

    todo = facts.join(linked, ["file", "pos"], "left").select("file", "pos", "facts", F.coalesce("links", no_links).alias("links"))
    settled = None
    while True:
        todo = cut_lineage(with_map(todo))
        fresh = todo.filter(F.size("roots") == 0).select("file", "pos", F.col("ranks")[0].alias("rank"))
        settled = fresh if settled is None else settled.unionByName(fresh)
        rest = todo.filter(F.size("roots") > 0)
        if rest.isEmpty():
            break
        jumps = rest.filter(F.size("roots") == 1).select("file", F.col("pos").alias("root"), F.col("roots")[0].alias("further"), "ranks").unionByName(
            settled.select("file", F.col("pos").alias("root"), F.lit(None).cast("long").alias("further"), F.array_repeat("rank", len(RANKS)).alias("ranks")))
        met = (
            rest.select("file", "pos", F.explode("roots").alias("root")).join(jumps, ["file", "root"])
            .groupBy("file", "pos").agg(F.map_from_entries(F.collect_list(F.struct("root", F.struct("further", "ranks")))).alias("met"))
        )

        def moved(o: Column) -> Column:
            to = F.try_element_at(F.col("met"), o["root"])
            over = F.struct(o["name"].alias("name"), to["further"].alias("root"),
                            F.transform(to["ranks"], lambda r: F.element_at(o["ranks"], r + 1)).alias("ranks"))
            return F.when(o["root"].isNull() | to.isNull(), o).otherwise(over)

        todo = rest.join(met, ["file", "pos"], "left").select(
            "file", "pos", "facts", F.when(F.col("met").isNull(), F.col("links")).otherwise(F.transform("links", moved)).alias("links"))
    return facts.select("file", "pos", "targets").join(settled, ["file", "pos"], "left")


def final_states(propagated: DataFrame) -> DataFrame:
    """End-of-file rank per (file, name): the last write wins."""
    return (
        propagated.select("file", "pos", "rank", F.explode("targets").alias("name"))
        .groupBy("file", "name")
        .agg(F.max_by("rank", "pos").alias("rank"))
    )


_QUOTED = r""""[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'|`[^`]*`"""
ARGUMENT_PIECES = rf"""{_QUOTED}|[()\[\]{{}},"'`]|[^()\[\]{{}},"'`]+"""


def _arguments(expr: Column) -> Column:
    """Top-level arguments of an argument list, in order, at any depth of nesting.

    One walk over the pieces with a stack of the brackets that are open.  A closing bracket ends the last open one of its
    own kind and those inside it, which then had no partner; without one of its kind it is text.
    """
    closers = {"(": ")", "[": "]", "{": "}"}
    first = F.struct(F.lit("").alias("open"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("at"))

    def step(acc: Column, t: Column) -> Column:
        """``open``: what the open brackets wait for; ``at``: the places of the commas outside all brackets."""
        stack = acc["open"]
        for opening, closing in closers.items():
            stack = F.when(t == opening, F.concat(acc["open"], F.lit(closing))).otherwise(stack)
        partner = F.call_function("instr", F.reverse(acc["open"]), t)
        stack = F.when(t.isin(*closers.values()) & (partner > 0), F.substring(acc["open"], F.lit(1), F.length(acc["open"]) - partner)).otherwise(stack)
        at = F.when((t == ",") & (acc["open"] == ""), F.concat(acc["at"], F.array(acc["i"] + 1))).otherwise(acc["at"])
        return F.struct(stack.alias("open"), (acc["i"] + 1).alias("i"), at.alias("at"))

    def cut(tokens: Column) -> Column:
        """The tokens between one comma and the next."""
        return let(F.aggregate(tokens, first, step), lambda s: F.transform(s["at"], lambda a, k: trim_space(F.array_join(
            F.slice(tokens, a + 1, F.coalesce(F.get(s["at"], k + 1) - 1, F.size(tokens)) - a), ""))))

    tokens = F.regexp_extract_all(expr, F.lit(ARGUMENT_PIECES), F.lit(0))
    return F.filter(let(tokens, cut), lambda a: a != "")


def split_arguments(expr: Column) -> Column:
    """The arguments of an argument list text, trimmed; empty ones are left out."""
    return _arguments(expr)


def argument_count(args: Column) -> Column:
    """Number of arguments in an argument list text."""
    return F.size(_arguments(args))


def gate_sinks(sinks: DataFrame, finals: DataFrame) -> DataFrame:
    """Keep the sinks that may be tainted.

    ``sinks``: (sink_id, file, language, expr, require_tainted, require_proven_tainted,
    sink_arg_index, is_args) plus anything else.  ``expr`` is null or '' when the capture is
    missing.  States are those at the end of the file.
    """
    inert = ~F.coalesce("require_tainted", F.lit(False)) | (F.col("language") != "javascript")
    missing = F.coalesce("expr", F.lit("")) == ""
    proven = F.coalesce("require_proven_tainted", F.lit(False))
    args = _arguments(F.col("expr"))
    chosen = (
        F.when(~F.col("is_args"), F.array("expr"))
        .when(F.col("sink_arg_index").isNotNull(), F.when(
            (F.col("sink_arg_index") >= 0) & (F.col("sink_arg_index") < F.size(args)),
            F.array(F.get(args, F.col("sink_arg_index")))).otherwise(F.array().cast("array<string>")))
        .otherwise(args)
    )
    live = sinks.filter(~inert & ~missing).withColumn("_facts", F.transform(chosen, classify_expression))
    names = live.select(
        "sink_id", "file",
        F.explode(F.array_distinct(F.flatten(F.transform("_facts", lambda f: f["all_ids"])))).alias("name"),
    )
    states = (
        names.join(finals, ["file", "name"])
        .groupBy("sink_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "rank"))).alias("_states"))
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    ranked = live.join(states, "sink_id", "left").withColumn(
        "sink_rank",
        F.coalesce(
            F.array_max(F.transform("_facts", lambda f: rank_from_states(f, F.coalesce("_states", empty)))),
            F.lit(UNKNOWN),
        ),
    )
    kept = ranked.filter(
        F.when(proven, F.col("sink_rank") == TAINTED).otherwise(~F.col("sink_rank").isin(CONSTANT, SANITIZED))
    ).select(*sinks.columns, "sink_rank")
    other = sinks.filter(inert | (missing & ~proven)).withColumn("sink_rank", F.lit(None).cast("int"))
    return kept.unionByName(other)
