"""Antipatterns that need a look at single predicates, or at the types of columns.

The tokens of a statement are scanned once, with the clause and the depth of
brackets as state; comparisons come out as (clause, left, operator, right) with
names in place of aliases.  This knows nothing of SQL's grammar beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.functions.text import collapse_blanks, decode_hex_sql, let, strip_leading_comments
from sqltide.operators.joins import lookup_join

_TOKEN = (
    r"('(?:[^'\\]|\\.)*+'|\"[^\"]*+\"|[a-z_][a-z0-9_$]*+(?:\.[a-z_][a-z0-9_$]*+)*+|\d++(?:\.\d++)?|<=|>=|<>|!=|[^\s])"
)
# Words that open a clause, and the name it goes by.
_CLAUSES = {
    "select": "select", "from": "from", "join": "from", "update": "from", "into": "from", "on": "on", "using": "on",
    "where": "where", "having": "having", "group": "rest", "order": "rest", "limit": "rest", "set": "rest",
    "values": "rest", "union": "rest", "returning": "rest",
}
_COMPARE = ("=", "<", ">", "<=", ">=", "<>", "!=", "like")
_MATH = ("+", "-", "*", "/", "%")
_NOT_NAMES = (
    "and", "or", "not", "in", "is", "null", "like", "between", "exists", "as", "inner", "left", "right", "full", "outer",
    "cross", "natural", "lateral", "case", "when", "then", "else", "end", "distinct", "all", "any", "some", "asc", "desc",
    "interval", "by", "true", "false", *_CLAUSES,
)
# Families of column types, by the first word of the declared type.
_FAMILIES = {
    "number": ("int", "integer", "bigint", "smallint", "tinyint", "mediumint", "decimal", "numeric", "float", "double", "real", "serial", "bigserial"),
    "text": ("char", "varchar", "character", "text", "longtext", "mediumtext", "tinytext", "enum", "uuid", "string"),
    "date": ("date", "datetime", "timestamp", "timestamptz", "timestamp_ntz"),
}


def family(data_type: Column) -> Column:
    """number, text or date; null for any other type."""
    word = F.regexp_extract(F.lower(data_type), r"^([a-z_]+)", 1)
    found = F.lit(None).cast("string")
    for name, words in _FAMILIES.items():
        found = F.when(word.isin(*words), F.lit(name)).otherwise(found)
    return found


def _is_name(token: Column) -> Column:
    return token.rlike(r"^[a-z_]") & ~token.isin(*_NOT_NAMES)


def scanned(sql: Column) -> Column:
    """Tokens with their clause and depth: array<struct<token, clause, depth>>.

    A clause lasts until the next word that opens one at its depth or until its
    bracket closes, where the clause outside of it goes on.
    """
    bare = F.lower(strip_leading_comments(collapse_blanks(sql)))
    tokens = F.regexp_extract_all(bare, F.lit(_TOKEN), 1)
    opened = F.create_map(*[F.lit(x) for pair in _CLAUSES.items() for x in pair])
    none = F.array().cast("array<struct<token:string,clause:string,depth:int>>")
    start = F.struct(F.array(F.lit("")).alias("stack"), none.alias("seen"))

    def step(state: Column, token: Column) -> Column:
        stack = state["stack"]
        top = F.element_at(stack, -1)
        clause = F.coalesce(F.try_element_at(opened, token), top)
        following = (
            F.when(token == "(", F.concat(stack, F.array(top)))
            .when((token == ")") & (F.size(stack) > 1), F.slice(stack, F.lit(1), F.size(stack) - 1))
            .otherwise(F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(clause)))
        )
        own = F.struct(token.alias("token"), clause.alias("clause"), F.size(stack).alias("depth"))
        return F.struct(following.alias("stack"), F.concat(state["seen"], F.array(own)).alias("seen"))

    return F.aggregate(tokens, start, step, lambda s: s["seen"])


def _at(words: Column, i: Column) -> Column:
    return F.get(words, i)


def table_names(words: Column) -> Column:
    """Map of alias (and of the name itself) to table."""
    places = F.sequence(F.lit(0), F.size(words) - 1)
    follows = lambda i: _at(words, i - 1)["token"].isin("from", "join", "update", "into") | (
        (_at(words, i - 1)["token"] == ",") & (_at(words, i)["clause"] == "from")
    )
    starts = F.filter(places, lambda i: (i > 0) & follows(i) & _is_name(_at(words, i)["token"]))

    def entry(i: Column) -> Column:
        table = F.element_at(F.split(_at(words, i)["token"], r"\."), -1)
        after = _at(words, i + 1)["token"]
        alias = F.when(after == "as", _at(words, i + 2)["token"]).otherwise(after)
        alias = F.when(F.coalesce(_is_name(alias), F.lit(False)), alias).otherwise(table)
        return F.array(
            F.struct(alias.alias("key"), table.alias("value")), F.struct(table.alias("key"), table.alias("value"))
        )

    pairs = F.array_distinct(F.flatten(F.transform(starts, entry)))
    # The first table of an alias counts.
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(
        F.transform(keys, lambda k: F.struct(k.alias("key"), F.get(F.filter(pairs, lambda p: p["key"] == k), F.lit(0))["value"].alias("value")))
    )


def comparisons(words: Column) -> Column:
    """Simple comparisons: array<struct<clause, left, op, right>>."""
    places = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: (i > 0) & _at(words, i)["token"].isin(*_COMPARE) & (i + 1 < F.size(words)),
    )
    negated = lambda i: _at(words, i - 1)["token"] == "not"
    return F.transform(
        places,
        lambda i: F.struct(
            _at(words, i)["clause"].alias("clause"),
            F.when(negated(i), _at(words, i - 2)["token"]).otherwise(_at(words, i - 1)["token"]).alias("left"),
            _at(words, i)["token"].alias("op"),
            F.when((_at(words, i + 1)["token"] == "-"), F.concat(F.lit("-"), _at(words, i + 2)["token"]))
            .otherwise(_at(words, i + 1)["token"]).alias("right"),
        ),
    )


def _math_on_column(words: Column) -> Column:
    """A column with + - * / % beside a number or name, on a compared side, inside a condition."""
    places = F.sequence(F.lit(0), F.size(words) - 1)
    operand = lambda t: _is_name(t) | t.rlike(r"^\d")

    def hit(i: Column) -> Column:
        left, right = _at(words, i - 1)["token"], _at(words, i + 1)["token"]
        around = _at(words, i + 2)["token"].isin(*_COMPARE) | _at(words, i - 2)["token"].isin(*_COMPARE)
        return (
            (i > 0) & _at(words, i)["token"].isin(*_MATH) & _at(words, i)["clause"].isin("where", "on", "having")
            & (_is_name(left) | _is_name(right)) & operand(left) & operand(right) & around
        )

    return F.exists(places, lambda i: F.coalesce(hit(i), F.lit(False)))


def _join_without_condition(words: Column) -> Column:
    """A join, or a second table after a comma, that no condition ties to another table.

    CROSS JOIN and NATURAL JOIN say what they mean and are left alone.
    """
    places = F.sequence(F.lit(0), F.size(words) - 1)
    word = lambda i: _at(words, i)["token"]
    # A comma parts tables where it is as deep as a FROM; deeper ones part columns or arguments.
    depths = F.transform(F.filter(words, lambda w: w["token"] == "from"), lambda w: w["depth"])
    listed = lambda i: _at(words, i)["clause"].isin("from", "on", "using") & F.array_contains(
        depths, _at(words, i)["depth"]
    )
    joins = F.size(
        F.filter(
            places,
            lambda i: ((word(i) == "join") & ~F.coalesce(word(i - 1).isin("cross", "natural"), F.lit(False)))
            | ((word(i) == ",") & listed(i) & F.coalesce(_is_name(word(i + 1)), F.lit(False))),
        )
    )
    named = lambda t: F.element_at(F.split(t, r"\."), 1)
    ties = F.filter(
        comparisons(words),
        lambda c: c["clause"].isin("on", "where") & _is_name(c["left"]) & _is_name(c["right"])
        & c["left"].contains(".") & c["right"].contains(".") & (named(c["left"]) != named(c["right"])),
    )
    using = F.size(F.filter(places, lambda i: word(i) == "using"))
    return (F.size(ties) + using) < joins


def predicate_flags(sql: Column) -> Column:
    """Codes of FUNC-003 and JOIN-002 found in the predicates, in this order."""
    none = F.array().cast("array<string>")

    def flags(words: Column) -> Column:
        checks = {"MATH_ON_COLUMN": _math_on_column(words), "JOIN_WITHOUT_CONDITION": _join_without_condition(words)}
        found = [F.when(check, F.array(F.lit(code))).otherwise(none) for code, check in checks.items()]
        return F.when(F.size(words) > 0, F.flatten(F.array(*found))).otherwise(none)

    return let(scanned(decode_hex_sql(sql)), flags)


SOURCE = ("source_db_type", "source_db_host", "source_db_name")


def type_flags(q: DataFrame, columns: DataFrame) -> DataFrame:
    """``id`` and ``flags`` of every query: conversions that its comparisons force.

    ``columns`` has one row per column of a database: the source, ``table_name``,
    ``column_name`` and ``data_type``.  TYPE_TEXT_NUMBER: a text column against
    a number, or a number column against a quoted text.  TYPE_JOIN_MISMATCH: two
    columns of different families.  TYPE_DATE_TEXT: a date column against a
    quoted text.  TYPE_LIKE_ON_NUMBER: LIKE on a number column.  Columns that are
    unknown, or that several tables of the statement have, give none.
    """
    # Bound in one expression: each statement is scanned once, whatever reads the result.
    some = lambda words, value: F.when(F.size(words) > 0, value)
    looked = let(
        scanned(decode_hex_sql(F.col("full_sql"))),
        lambda w: F.struct(some(w, table_names(w)).alias("tables"), some(w, comparisons(w)).alias("compared")),
    )
    used = q.select("id", *SOURCE, looked.alias("looked")).select(
        "id", *SOURCE, F.col("looked.tables").alias("tables"), F.posexplode("looked.compared").alias("no", "c")
    )
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"c.{name}").alias("token"))
    sides = used.select("id", *SOURCE, "tables", "no", "c", F.explode(F.array(side("left"), side("right"))).alias("s"))
    sides = sides.select("*", "s.*").where(_is_name(F.col("token")))
    parts = F.split("token", r"\.")
    prefix = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    candidates = F.when(
        prefix.isNotNull(), F.array_compact(F.array(F.try_element_at(F.col("tables"), prefix)))
    ).otherwise(F.array_distinct(F.map_values("tables")))
    named = sides.select(
        "id", *SOURCE, "no", "c", "side", F.element_at(parts, -1).alias("column_name"), F.explode(candidates).alias("table_name")
    )
    known = columns.select(*SOURCE, "table_name", "column_name", family(F.col("data_type")).alias("family"))
    typed = lookup_join(named, known, [*SOURCE, "table_name", "column_name"])
    of = lambda name: F.when(F.count_if(F.col("side") == name) == 1, F.max(F.when(F.col("side") == name, F.col("family"))))
    compared = typed.groupBy("id", "no").agg(
        F.first("c").alias("c"), of("left").alias("left"), of("right").alias("right")
    )
    left, right, op = F.col("left"), F.col("right"), F.col("c.op")
    quoted = lambda t: t.startswith("'") | t.startswith('"')
    number = lambda t: t.rlike(r"^-?\d")
    against = lambda kind, literal: (
        ((left == kind) & literal(F.col("c.right"))) | ((right == kind) & literal(F.col("c.left")))
    )
    checks = {
        "TYPE_TEXT_NUMBER": (op != "like") & (against("text", number) | against("number", quoted)),
        "TYPE_JOIN_MISMATCH": left != right,
        "TYPE_DATE_TEXT": (op != "like") & against("date", quoted),
        "TYPE_LIKE_ON_NUMBER": (op == "like") & (left == "number"),
    }
    none = F.array().cast("array<string>")
    found = F.flatten(
        F.array(*[F.when(F.coalesce(check, F.lit(False)), F.array(F.lit(code))).otherwise(none) for code, check in checks.items()])
    )
    flags = compared.select("id", F.explode(found).alias("flag")).groupBy("id").agg(F.sort_array(F.collect_set("flag")).alias("flags"))
    return q.select("id").join(flags, "id", "left").select("id", F.coalesce("flags", none).alias("flags"))
