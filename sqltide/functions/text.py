"""SQL-text functions as native Column expressions (no Python UDF).

Word characters are letters, numbers and underscore over all of Unicode, and
blanks are every Unicode blank plus the four ASCII separators, so that the
results do not depend on the alphabet a statement is written in.

The patterns below use possessive quantifiers: Java's regex engine recurses on
a repeated alternative, and a long string literal or IN list would overflow
the stack.  Each possessive loop is unambiguous, so it matches the same text
as the plain greedy one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The literal, number, list and LIMIT patterns of the normaliser.
WORD = r"[\p{L}\p{N}_]"
BLANK = r"[\s\x1c-\x1f]"
SINGLE_QUOTED = r"(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'"
DOUBLE_QUOTED = r'(?s)"[^"\\]*+(?:\\\\.[^"\\]*+)*+"'
NUMBER = rf"(?=[-\p{{Nd}}])(?:(?<={WORD})-|(?<!{WORD}))\p{{Nd}}++(?:\.\p{{Nd}}++(?!{WORD})|\.(?={WORD})|(?!{WORD}))"
HEX_NUMBER = rf"0x(?<!{WORD}0x)[0-9a-fA-F]++(?!{WORD})"
PLACEHOLDER_LIST = r"\( *+\? *+(?:, *+\? *+)++\)"
LIMIT_CLAUSE = rf"(?iu)LIMIT(?<!{WORD}LIMIT) ++\?(?: ++OFFSET ++\?)?"
OFFSET_CLAUSE = rf"(?iu)OFFSET(?<!{WORD}OFFSET) ++\?"

# Statement kinds, tested as prefixes in this order.
QUERY_TYPES = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode_bytes(raw: Column) -> Column:
    """Bytes to text; invalid bytes become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def collapse_blanks(sql: Column) -> Column:
    text = F.coalesce(sql, F.lit(""))
    return F.trim(F.regexp_replace(text, rf"(?U){BLANK}++", " "))


def replace_literals(sql: Column) -> Column:
    """Quoted strings, numbers and hex numbers to ``?`` on blank-collapsed text."""
    text = F.regexp_replace(sql, SINGLE_QUOTED, "?")
    text = F.regexp_replace(text, DOUBLE_QUOTED, "?")
    text = F.regexp_replace(text, NUMBER, "?")
    return F.regexp_replace(text, HEX_NUMBER, "?")


def normalize_query(sql: Column) -> Column:
    """Statement text to its pattern: literals become ``?``; null becomes ''."""
    text = replace_literals(collapse_blanks(sql))
    text = F.regexp_replace(text, PLACEHOLDER_LIST, "(?)")
    text = F.regexp_replace(text, LIMIT_CLAUSE, "LIMIT ?")
    text = F.regexp_replace(text, OFFSET_CLAUSE, "OFFSET ?")
    return F.rtrim(text, F.lit(";"))


EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"


def sql_hash(fingerprint: Column) -> Column:
    """md5 hex of the pattern text; '' for an empty or missing pattern."""
    digest = F.md5(F.coalesce(fingerprint, F.lit("")).cast("binary"))
    return F.replace(digest, F.lit(EMPTY_MD5), F.lit(""))


def make_fingerprint(sql: Column) -> Column:
    """Lower-cased pattern for matching the same statement across runs."""
    return F.lower(normalize_query(sql))


def _names_after(lowered: Column, words: str) -> Column:
    pattern = rf"(?U)(?<!{WORD})(?:{words}){BLANK}++([a-zA-Z_][a-zA-Z0-9_]*+)"
    return F.regexp_extract_all(lowered, F.lit(pattern), 1)


def extract_tables(sql: Column) -> Column:
    """Names after FROM, then names after JOIN; lower case, distinct, in order."""
    lowered = F.lower(F.coalesce(sql, F.lit("")))
    return F.array_distinct(
        F.concat(_names_after(lowered, "from"), _names_after(lowered, "join"))
    )


def strip_leading_comments(sql: Column) -> Column:
    return F.regexp_replace(
        sql, rf"(?sU)\A(?:{BLANK}++|/\*.*?\*/|--[^\n]*+(?:\n|\z))++", ""
    )


def classify_query_type(sql: Column, skip_comments: bool = False) -> Column:
    """First keyword of the statement, or OTHER.

    A leading comment makes the statement OTHER unless ``skip_comments``.
    """
    text = F.coalesce(sql, F.lit(""))
    if skip_comments:
        text = strip_leading_comments(text)
    first = rf"(?iU)\A{BLANK}*+({'|'.join(QUERY_TYPES)})"
    found = F.upper(F.regexp_extract(text, first, 1))
    return F.when(found == "", F.lit("OTHER")).otherwise(found)


def is_explain_safe(sql: Column, skip_comments: bool = False) -> Column:
    return classify_query_type(sql, skip_comments) == "SELECT"


def decode_hex_sql(sql: Column) -> Column:
    r"""Text of the form ``\x6162`` to its UTF-8 text; kept as is when broken."""
    digits = F.substring(sql, 3, 2147483647)
    well_formed = (
        sql.startswith("\\x")
        & digits.rlike(r"\A[0-9a-fA-F]*+\z")
        & (F.length(digits) % 2 == 0)
    )
    decoded = F.try_validate_utf8(F.try_to_binary(digits, F.lit("hex")).cast("string"))
    return F.when(well_formed, F.coalesce(decoded, sql)).otherwise(sql)


_MARKER = r"/\*\s*TEST:([A-Za-z]+)-([0-9]+):([^*]*?)\s*\*/"


def test_marker(full_sql: Column) -> Column:
    """Struct(category, case_id, case_name) of a ``/* TEST:CAT-ID:Name */`` marker.

    Read it from the full statement: the normaliser eats the case number.
    """
    category = F.regexp_extract(full_sql, _MARKER, 1)
    number = F.regexp_extract(full_sql, _MARKER, 2)
    name = F.regexp_extract(full_sql, _MARKER, 3)
    marker = F.struct(
        category.alias("category"),
        F.concat(category, F.lit("-"), number).alias("case_id"),
        name.alias("case_name"),
    )
    return F.when(full_sql.rlike(_MARKER), marker)


test_marker.__test__ = False  # a library function, not a pytest case


def query_preview(fingerprint: Column, n: int = 120, always: bool = False) -> Column:
    """First ``n`` characters with ``...``, added only when cut unless ``always``."""
    head = F.concat(F.substring(fingerprint, 1, n), F.lit("..."))
    if always:
        return head
    return F.when(F.length(fingerprint) > n, head).otherwise(fingerprint)


# Functions whose use around a column in WHERE defeats an index on it.
COLUMN_FUNCTIONS = (
    "year", "month", "extract", "upper", "lower", "concat", "date_format",
    "to_char", "date", "substring", "cast",
)


def antipattern_flags(sql: Column) -> Column:
    """Codes of the text-detectable antipatterns of a statement, in fixed order."""
    bare = strip_leading_comments(collapse_blanks(sql))
    lowered = F.lower(bare)
    # Words inside string literals must not count as SQL.
    text = F.lower(F.regexp_replace(bare, SINGLE_QUOTED, "?"))
    functions = "|".join(COLUMN_FUNCTIONS)
    checks = {
        "LEADING_WILDCARD": lowered.rlike(r"\blike '%"),
        "NO_WHERE": text.rlike(r"^select\b.*\bfrom\b") & ~text.rlike(r"\bwhere\b"),
        "OR_CONDITION": text.rlike(r"\bwhere\b.*\bor\b"),
        "NOT_IN": text.rlike(r"\bnot in ?\("),
        "SELECT_STAR": text.rlike(r"\bselect (?:distinct )?\*"),
        "FUNCTION_ON_COLUMN": text.rlike(rf"\bwhere\b.*\b(?:{functions}) ?\( ?[a-z_]"),
        "IN_SUBQUERY": text.rlike(r"\bin ?\( ?select\b"),
        "HAVING": text.rlike(r"\bhaving\b"),
        "DISTINCT": text.rlike(r"\bselect distinct\b"),
        "COMMA_JOIN": text.rlike(
            r"\bfrom [a-z_][a-z0-9_.]*(?: (?:as )?[a-z_][a-z0-9_]*)? ?, ?[a-z_]"
        ),
    }
    none = F.array().cast("array<string>")
    return F.flatten(
        F.array(
            *[F.when(check, F.array(F.lit(code))).otherwise(none) for code, check in checks.items()]
        )
    )


# Words kept as they are by the anonymiser.
SQL_KEYWORDS = tuple(
    """
    select insert update delete create alter drop from where join inner left right
    full outer cross on using and or not in is null like between exists as distinct
    group by order having limit offset union all intersect except case when then
    else end asc desc into values set table index view with recursive over partition
    rows range interval true false any some natural lateral returning default
    primary key foreign references unique
    add column constraint check if replace truncate rename to cascade restrict
    ilike similar escape regexp rlike collate for of nowait skip locked share only
    nulls first last fetch next row current unbounded preceding following filter
    within lock mode tablesample explain analyze call grant revoke begin commit
    rollback duplicate ignore conflict do nothing straight_join force use
    int integer bigint smallint tinyint numeric decimal float double real precision
    char varchar text blob boolean bool date time timestamp datetime json uuid
    year month day hour minute second zone unsigned auto_increment
    current_date current_time current_timestamp temporary temp materialized
    """.split()
)

_TOKEN = r"([\p{L}_][\p{L}\p{N}_$]*+|[^\p{L}_]++)"
_JSON_TOKEN = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?+|[^"]++|")'


def _is_word(token: Column) -> Column:
    return token.rlike(r"\A[\p{L}_]")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), 1)


def _numbered(names: Column, prefix: str) -> Column:
    """Array of names to array of (name, label) entries, labels counted from 1."""
    return F.transform(
        names,
        lambda name, i: F.struct(
            name.alias("name"), F.concat(F.lit(prefix), (i + 1).cast("string")).alias("label")
        ),
    )


def _bare(sql: Column) -> Column:
    return replace_literals(collapse_blanks(sql))


def _names(lowered: Column) -> Column:
    """Map of the table and column names of a literal-free statement to placeholders."""
    tables = F.concat(
        _names_after(lowered, "from"),
        _names_after(lowered, "join"),
        _names_after(lowered, "into|update|table"),
    )
    tables = F.filter(F.array_distinct(tables), lambda t: ~t.isin(*SQL_KEYWORDS))

    def with_tables(bound: Column) -> Column:
        words = bound["words"]
        following = F.concat(F.slice(words, F.lit(2), F.size(words)), F.array(F.lit("")))
        pairs = F.zip_with(
            words, following, lambda w, nxt: F.struct(w.alias("w"), nxt.alias("nxt"))
        )
        columns = F.transform(
            F.filter(
                pairs,
                lambda p: _is_word(p["w"])
                & ~p["w"].isin(*SQL_KEYWORDS)
                & ~F.array_contains(bound["tables"], p["w"])
                & ~p["nxt"].rlike(r"\A ?\("),
            ),
            lambda p: p["w"],
        )
        return F.map_from_entries(
            F.concat(
                _numbered(bound["tables"], "table_"),
                _numbered(F.array_distinct(columns), "col_"),
            )
        )

    return let(F.struct(tables.alias("tables"), _tokens(lowered).alias("words")), with_tables)


def _apply_names(text: Column, names: Column) -> Column:
    return F.concat_ws(
        "",
        F.transform(
            _tokens(text), lambda w: F.coalesce(F.try_element_at(names, F.lower(w)), w)
        ),
    )


def anonymize_sql(sql: Column) -> Column:
    """Tables to ``table_i``, columns to ``col_j``, literals to ``?``; rest kept.

    Numbers follow first appearance.  Keywords and function names stay.
    """
    return let(
        _bare(sql),
        lambda text: let(_names(F.lower(text)), lambda names: _apply_names(text, names)),
    )


# Words that plans use for operators, access types and options.
PLAN_WORDS = tuple(
    """
    all index range ref eq_ref const system ref_or_null index_merge unique_subquery index_subquery fulltext
    seq scan only bitmap heap tid sort incremental hash merge nested loop join aggregate group
    gather append materialize memoize result limit unique setop modifytable cte subquery function
    worktable lockrows windowagg inner outer left right full semi anti plain sorted hashed mixed
    partial finalize simple forward backward quicksort top n heapsort external disk memory
    outer inner parent member initplan subplan using where filesort temporary condition
    asc desc true false null unknown yes no primary
    """.split()
)


def _anonymous_value(token: Column, names: Column) -> Column:
    """A quoted JSON string with its literals and names replaced."""
    quoted = F.rtrim(token)
    inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    inner = F.regexp_replace(F.regexp_replace(inner, SINGLE_QUOTED, "?"), NUMBER, "?")
    return F.concat(F.lit('"'), _apply_names(inner, names), F.lit('"'))


def anonymize_plan(plan_json: Column, sql: Column) -> Column:
    """A plan without names and literals.

    In its string values the statement's names become the statement's
    placeholders; any other word that is no keyword and no word of plans
    (indexes, databases, aliases) becomes ``name_i``.
    """
    parts = F.regexp_extract_all(plan_json, F.lit(_JSON_TOKEN), 1)

    def is_value(token: Column) -> Column:
        return token.startswith('"') & ~token.rlike(r":\z")

    def own_words(names: Column) -> Column:
        words = F.flatten(
            F.transform(
                F.filter(parts, is_value),
                lambda t: F.filter(
                    _tokens(F.lower(F.regexp_replace(t, SINGLE_QUOTED, "?"))),
                    lambda w: _is_word(w) & ~w.isin(*SQL_KEYWORDS) & ~w.isin(*PLAN_WORDS),
                ),
            )
        )
        others = F.array_except(F.array_distinct(words), F.map_keys(names))
        return F.map_concat(names, F.map_from_entries(_numbered(others, "name_")))

    def replace_values(names: Column) -> Column:
        return F.concat_ws(
            "",
            F.transform(
                parts, lambda t: F.when(is_value(t), _anonymous_value(t, names)).otherwise(t)
            ),
        )

    return F.when(
        plan_json.isNotNull(),
        let(_names(F.lower(_bare(sql))), lambda names: let(own_words(names), replace_values)),
    )
