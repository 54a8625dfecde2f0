"""Statement logs: splitting, classes and the lineage edges statements imply, as column expressions.

A text is cut into tokens by one pattern whose repetitions are possessive, so long texts take neither stack nor repeated
scans. The tokens of a statement are folded once, with a stack of what is open between parentheses; the fold knows
where a table list is being read, what the statement writes, which names belong to WITH, and where the items of its first
select list lie. Logged statements repeat, so each distinct text is read once and its result joined back to the log rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# First words of each statement class.
CLASSES = {"QUERY": ("SELECT", "WITH", "SHOW", "DESC", "EXPLAIN", "VALUES"),
           "DDL": ("CREATE", "DROP", "ALTER", "TRUNCATE", "RENAME", "COMMENT"),
           "DML": ("INSERT", "UPDATE", "DELETE", "MERGE")}
# Words that may stand between the verb and the table it writes, words that end a table list, words inside
# one that are no tables, and words that open a definition which is no column.
BEFORE_TARGET = {
    "INSERT": "INTO OVERWRITE TABLE IGNORE LOW_PRIORITY HIGH_PRIORITY DELAYED".split(),
    "UPDATE": "LOW_PRIORITY IGNORE ONLY".split(), "DELETE": "FROM ONLY LOW_PRIORITY QUICK IGNORE".split(),
    "CREATE": "OR REPLACE TEMPORARY TEMP EXTERNAL GLOBAL LOCAL UNLOGGED MATERIALIZED TABLE VIEW IF NOT EXISTS".split()}
LIST_ENDS = """WHERE GROUP ORDER HAVING LIMIT UNION INTERSECT EXCEPT SET VALUES WINDOW QUALIFY FETCH OFFSET RETURNING
WHEN""".split()
JOINERS = "LEFT RIGHT FULL INNER OUTER CROSS NATURAL ON USING AS TABLESAMPLE PIVOT UNPIVOT ONLY".split()
NO_COLUMNS = "PRIMARY UNIQUE CONSTRAINT FOREIGN CHECK INDEX KEY".split()
SET_OPERATORS = "UNION INTERSECT EXCEPT".split()

_TEXT = r"'(?:[^'\\]++|\\.)*+(?:'|\z)"
_NOTE = r"--[^\n]*+"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
_DOLLARS = r"(?<![\w$])\$(\w*+)\$.*?(?:\$\1\$|\z)"
#: Pieces of a script: quotes of all kinds, comments, semicolons and what lies between them.
_PIECE = rf"""(?s){_TEXT}|"(?:[^"\\]++|\\.)*+(?:"|\z)|`[^`]*+(?:`|\z)|{_NOTE}|{_BLOCK}|{_DOLLARS}|;|[^'"`;$/-]++|."""
_PART = r"""(?:`[^`]++`|"(?:[^"]++|"")++"|[\w$]++)"""
_NAME = rf"{_PART}(?:\.{_PART})*+"
#: Tokens of a statement; blanks and comments are tokens too, so any stretch of them spells its text.
_TOKEN = rf"(?sU){_TEXT}|{_NOTE}|{_BLOCK}|{_DOLLARS}|{_NAME}|\s++|."
#: An item of a select list: expression, alias after AS, alias without it; words that a following name is an operand of.
_ALIAS = r"""(?isU)\A(.*?)(?:\s+AS\s+`?(\w+)`?|(?<=[\w)'"`])\s+(?!(?:END|NULL|TRUE|FALSE)\z)([A-Za-z_]\w*))\z"""
_OPERATOR = r"(?i)\b(?:FROM|AND|OR|NOT|LIKE|IS|IN|BETWEEN|THEN|ELSE|WHEN)\z"
#: Parts statements while a script is put together; a script's own such characters count as blanks.
_CUT = "\x00"
EDGE = "struct<source_table:string,source_column:string,target_table:string,target_column:string>"


def statements_of(script: Column) -> Column:
    """The statements of a script. Semicolons inside quotes, dollar quotes and comments do not split; line comments lose
    their text."""
    pieces = F.regexp_extract_all(F.translate(script, _CUT, " "), F.lit(_PIECE), F.lit(0))
    kept = F.transform(pieces, lambda p: F.when(p == ";", _CUT).when(F.startswith(p, F.lit("--")), "--").otherwise(p))
    cut = F.split(F.array_join(kept, ""), _CUT)
    return F.filter(F.transform(cut, lambda c: F.regexp_replace(c, r"\A\s++|\s++\z", "")), lambda c: c != "")


def plain_name(name: Column) -> Column:
    """A name in backticks without them, unless they quote its parts one by one."""
    quoted = F.startswith(name, F.lit("`")) & F.endswith(name, F.lit("`")) & ~F.contains(name, F.lit("`."))
    return F.when(quoted, F.substring(name, 2, F.char_length(name) - 2)).otherwise(name)


def _tokens(statement: Column) -> Column:
    return F.regexp_extract_all(statement, F.lit(_TOKEN), F.lit(0))


def _placed(tokens: Column) -> Column:
    """(t, at) of the tokens that say something: the text and its place. Quoted text is a lone quote."""
    silent = lambda t: F.startswith(t, F.lit("--")) | F.startswith(t, F.lit("/*")) | t.rlike(r"\A\s")
    return F.filter(F.transform(tokens, lambda t, i: F.struct(
        F.when(F.startswith(t, F.lit("'")) | (F.startswith(t, F.lit("$")) & F.endswith(t, F.lit("$")) & (F.char_length(t) > 1)),
               "'").otherwise(t).alias("t"), i.alias("at"))), lambda x: ~silent(x["t"]))


def _marked(placed: Column) -> Column:
    """(t, u, at, n1, n2, name): also in capitals, the next two in capitals, and whether it is a name or a word."""
    return F.transform(placed, lambda x, i: F.struct(
        x["t"].alias("t"), F.upper(x["t"]).alias("u"), x["at"].alias("at"), F.upper(F.get(placed, i + 1)["t"]).alias("n1"),
        F.upper(F.get(placed, i + 2)["t"]).alias("n2"), x["t"].rlike(r"(?U)\A[`\"\w$]").alias("name")))


_SCOPE = "struct<selects:boolean,listing:boolean,expects:boolean,ctes:boolean>"
_STATE = {
    "stack": (f"array<{_SCOPE}>", None), "verb": ("string", None), "kind": ("string", None), "phase": ("int", 0),
    "led": ("boolean", False), "fresh": ("boolean", False), "target": ("string", None), "sources": ("array<string>", ()),
    "hidden": ("array<string>", ()), "pending": ("string", None), "prev": ("string", None), "prev2": ("string", None),
    "cols": ("array<string>", ()), "col_open": ("boolean", False), "sel": ("int", 0), "begin": ("int", 0),
    "items": ("array<struct<first:int,n:int>>", ()), "set_op": ("boolean", False)}
#: Phases of a statement: the verb is awaited, the table it writes, then the table is known, its columns are being listed,
#: or it writes none.
AWAITING, BEFORE, KNOWN, LISTED, NONE = range(5)


def _scope(selects=False, listing=False, expects=False, ctes=False) -> Column:
    values = {"selects": selects, "listing": listing, "expects": expects, "ctes": ctes}
    return F.struct(*[(F.lit(v) if isinstance(v, bool) else v).alias(k) for k, v in values.items()]).cast(_SCOPE)


def _step(s: Column, x: Column) -> Column:
    """The state after one token."""
    top, below = F.element_at(s["stack"], -1), F.slice(s["stack"], 1, F.size(s["stack"]) - 1)
    outer, inner = F.size(s["stack"]) == 1, F.size(s["stack"]) == 2
    u, word = x["u"], x["name"]
    opens, closes, comma = x["t"] == "(", x["t"] == ")", x["t"] == ","
    is_from = (u == "FROM") & ~((s["prev"] == "DISTINCT") & s["prev2"].isin("IS", "NOT"))
    is_from = F.coalesce(is_from, u == "FROM")
    using = (u == "USING") & (s["verb"] == "DELETE") & outer & (x["n1"] != "(")
    like = (u == "LIKE") & (s["fresh"] | ((s["phase"] == LISTED) & s["col_open"] & inner))
    table = word & top["expects"] & ~u.isin("SELECT", "WITH", "FROM", "JOIN", "LATERAL", *LIST_ENDS, *JOINERS) & ~like
    same = lambda **changed: _scope(**{k: changed.get(k, top[k]) for k in ("selects", "listing", "expects", "ctes")})
    scope = (F.when(comma, same(expects=top["listing"]))
             .when(u == "SELECT", same(selects=True, listing=False, expects=False, ctes=False))
             .when(u == "WITH", same(listing=False, expects=False, ctes=True))
             .when(is_from, same(listing=top["selects"], expects=top["selects"]))
             .when(u == "JOIN", same(expects=top["listing"]))
             .when(F.coalesce(using, F.lit(False)) | like, same(listing=True, expects=True))
             .when(u.isin(*LIST_ENDS) | ((u == "LATERAL") & F.coalesce(x["n1"] == "VIEW", F.lit(False))),
                   same(listing=False, expects=False))
             .when(table | opens, same(expects=False)).otherwise(top))
    stack = (F.when(opens, F.concat(below, F.array(scope), F.array(_scope(listing=top["expects"], expects=top["expects"]))))
             .when(closes, F.when(outer, s["stack"]).otherwise(below))
             .otherwise(F.concat(below, F.array(scope))))
    source = table & F.coalesce(x["n1"] != "(", F.lit(True))

    first = s["prev"].isNull()
    starts = (s["phase"] == AWAITING) & outer & u.isin(*BEFORE_TARGET) & (first | s["led"])
    idle = (s["phase"] == AWAITING) & outer & ((first & (u != "WITH")) | (s["led"] & (u == "SELECT")))
    skipped = F.lit(False)
    for verb, words in BEFORE_TARGET.items():
        skipped = skipped | ((s["verb"] == verb) & u.isin(*words))
    kind = F.when((s["phase"] == BEFORE) & (s["verb"] == "CREATE") & u.isin("TABLE", "VIEW"), u).otherwise(s["kind"])
    named = (s["phase"] == BEFORE) & ~skipped & word & ((s["verb"] != "CREATE") | s["kind"].isNotNull())
    lost = (s["phase"] == BEFORE) & ~skipped & ~named
    lists = s["fresh"] & opens
    defines = (s["phase"] == LISTED) & inner & s["col_open"] & word
    query = defines & u.isin("SELECT", "WITH", "LIKE")
    phase = (F.when(starts, BEFORE).when(idle | lost, NONE).when(named, KNOWN).when(lists, LISTED)
             .when(query | ((s["phase"] == LISTED) & inner & closes), KNOWN).otherwise(s["phase"]))
    cols = (F.when(query, F.array().cast("array<string>"))
            .when(defines & ~u.isin(*NO_COLUMNS), F.array_append(s["cols"], F.regexp_replace(x["t"], "^[`\"]|[`\"]$", "")))
            .otherwise(s["cols"]))
    col_open = F.when(lists, True).when((s["phase"] == LISTED) & inner & comma, True).when(defines, False).otherwise(s["col_open"])

    after = s["phase"].isin(KNOWN) & outer & s["verb"].isin("INSERT", "CREATE")
    selects = after & (s["sel"] == 0) & (u == "SELECT")
    ends_item = outer & (s["sel"] == 1) & (comma | is_from)
    item = F.struct((s["begin"] + 1).alias("first"), (x["at"] - s["begin"]).alias("n"))
    heads = s["prev"].isin("WITH", "RECURSIVE") | (top["ctes"] & (s["prev"] == ","))
    heads = F.coalesce(heads, F.lit(False)) & word
    body = F.coalesce((x["n1"] == "AS") & (x["n2"] == "("), F.lit(False))
    cte = F.when(heads & body & (u != "RECURSIVE"), F.lower(plain_name(x["t"]))).when(closes & body, s["pending"])
    fields = {
        "stack": stack, "verb": F.when(starts, u).otherwise(s["verb"]), "kind": kind, "phase": phase,
        "led": s["led"] | (first & (u == "WITH")), "fresh": named, "target": F.when(named, plain_name(x["t"])).otherwise(s["target"]),
        "sources": F.when(source, F.array_union(s["sources"], F.array(plain_name(x["t"])))).otherwise(s["sources"]),
        "hidden": F.when(cte.isNotNull(), F.array_append(s["hidden"], cte)).otherwise(s["hidden"]),
        "pending": F.when(heads & (x["n1"] == "("), F.lower(plain_name(x["t"]))).when(closes & body, None).otherwise(s["pending"]),
        "prev": u, "prev2": s["prev"], "cols": cols, "col_open": col_open,
        "sel": F.when(selects, 1).when(ends_item & is_from, 2).otherwise(s["sel"]),
        "begin": F.when(selects | ends_item, x["at"] + 1).otherwise(s["begin"]),
        "items": F.when(ends_item, F.array_append(s["items"], item)).otherwise(s["items"]),
        "set_op": s["set_op"] | u.isin(*SET_OPERATORS)}
    return F.struct(*[fields[k].cast(kind).alias(k) for k, (kind, _) in _STATE.items()])


def _before(statement: Column) -> Column:
    """The state before the first token."""
    verb = F.upper(F.regexp_extract(statement, rf"(?sU)\A(?:\s++|{_NOTE}|{_BLOCK})*+(\w++)", 1))
    bottom = _scope(selects=verb.isin("DELETE", "UPDATE"), listing=verb == "UPDATE")
    return F.struct(*[(F.array(bottom) if k == "stack" else F.array() if v == () else F.lit(v)).cast(kind).alias(k)
                      for k, (kind, v) in _STATE.items()])


def read_statements(rows: DataFrame, statement: str = "statement") -> DataFrame:
    """``rows`` with ``tokens`` of the statement and ``read``, the fold's last state."""
    return (rows.withColumn("tokens", _tokens(F.col(statement))).withColumn("placed", _placed(F.col("tokens")))
            .withColumn("marks", _marked(F.col("placed")))
            .withColumn("read", F.aggregate("marks", _before(F.col(statement)), _step)).drop("placed", "marks"))


def _hidden(name: Column) -> Column:
    return F.array_contains("read.hidden", F.lower(name))


def _edges() -> Column:
    """(source table, source column, target table, target column) rows of a statement that was read.

    Statements without a target give nothing. Column rows need exactly one source; a target without sources gives one
    row with an empty source. Names are told apart by exact case: a source that differs from the target in case only is
    another table. Names of WITH queries are hidden without regard to case.
    """
    target, none = F.col("read.target"), F.lit(None).cast("string")
    edge = lambda *parts: F.struct(*parts).cast(EDGE)
    sources = F.filter("read.sources", lambda n: (n != target) & ~_hidden(n))
    tables = F.when(F.size(sources) > 0, F.transform(sources, lambda n: edge(n, none, target, none))).otherwise(
        F.array(edge(none, none, target, none)))

    def column(item: Column, i: Column) -> Column:
        text = F.trim(F.array_join(F.slice("tokens", item["first"], item["n"]), ""))
        text = F.regexp_replace(text, r"\A\s++|\s++\z", "")
        text = F.when(i == 0, F.regexp_replace(text, r"(?i)\ADISTINCT\s+", "")).otherwise(text)
        whole, bare = F.regexp_extract(text, _ALIAS, 1), F.regexp_extract(text, _ALIAS, 3)
        alias = F.concat(F.regexp_extract(text, _ALIAS, 2), bare)
        operand = (bare != "") & F.regexp_replace(whole, r"\s++\z", "").rlike(_OPERATOR)
        has = (alias != "") & ~operand
        said = F.when(has, F.regexp_replace(whole, r"\A\s++|\s++\z", "")).otherwise(text)
        last = F.regexp_replace(F.element_at(F.split(said, r"\."), -1), "^`|`$", "")
        name = F.coalesce(F.get("read.cols", i), F.when(has, alias))
        return edge(F.element_at(sources, 1), F.when(said.rlike(rf"(?sU)\A{_NAME}\z"), last).otherwise(said), target, name)

    listed = (F.size(sources) == 1) & (F.col("read.sel") == 2) & ~F.col("read.set_op") & (
        (F.col("read.verb") == "INSERT") | (F.col("read.kind") == "TABLE"))
    columns = F.filter(F.transform("read.items", column), lambda e: e["target_column"].isNotNull())
    rows = F.when(listed, F.array_distinct(F.concat(tables, columns))).otherwise(tables)
    return F.when(target.isNotNull(), rows).otherwise(F.array().cast(f"array<{EDGE}>"))


def classify(statement: Column) -> Column:
    """QUERY, DDL, DML or UNKNOWN by the first word."""
    first = F.upper(F.substring_index(F.trim(statement), " ", 1))
    kind = F.lit("UNKNOWN")
    for name, words in reversed(CLASSES.items()):
        kind = F.when(first.rlike(r"\A(?:" + "|".join(words) + ")"), name).otherwise(kind)
    return kind


def _per_text(log: DataFrame, column: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``parse`` (a frame of statements with their text and position to rows) once per distinct text and joins the
    rows back to the log.

    The digest keeps the join key short; equal digests with different texts are told apart by the text itself.
    """
    keyed = log.filter(F.col(column).isNotNull())
    split = keyed.select(column).distinct().select(column, F.posexplode(statements_of(F.col(column))).alias("place", "statement"))
    parsed = parse(split.withColumn("position", F.col("place") + 1).drop("place"))
    digest = F.xxhash64(column)
    return keyed.withColumn("text_digest", digest).join(
        parsed.withColumn("text_digest", digest), ["text_digest", column]).drop("text_digest")


def split_log(log: DataFrame, column: str = "sql_text") -> DataFrame:
    """One row per statement with its position and class."""
    return _per_text(log, column, lambda rows: rows.select(column, "position", "statement")).withColumn(
        "statement_class", classify(F.col("statement")))


def lineage_from_statements(log: DataFrame, column: str = "sql_text") -> DataFrame:
    """Edges of every logged statement, distinct per statement of a log row."""
    def edges(rows: DataFrame) -> DataFrame:
        return read_statements(rows).select(column, F.inline(_edges()))

    return _per_text(log, column, edges).drop(column).withColumn("lineage_type", F.lit("SQL"))


def statement_tables(log: DataFrame, column: str = "sql_text") -> DataFrame:
    """(id, table_name) for every table a statement reads or writes, plain queries included; each once per log row."""
    def tables(rows: DataFrame) -> DataFrame:
        both = F.array_union("read.sources", F.array_compact(F.array("read.target")))
        return read_statements(rows).select(column, F.explode(F.filter(both, lambda n: ~_hidden(n))).alias("table_name")).distinct()

    return _per_text(log, column, tables).drop(column)


def declared_outputs(steps: DataFrame, outputs: str = "output_tables") -> DataFrame:
    """Declared outputs of Python steps as edges without a source."""
    name = F.regexp_replace(F.trim(F.col("t")), r"\A`(.+)`\z", "$1")
    return steps.select("*", F.explode(outputs).alias("t")).select(
        *[c for c in steps.columns if c != outputs], F.lit(None).cast("string").alias("source_table"),
        name.alias("target_table"), F.lit("PYTHON").alias("lineage_type"))
