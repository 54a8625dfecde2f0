"""Chat formatting with a grammar that is checked by a round trip, in DataFrame operations only.

    conversation = turn*
    turn         = "### " name ": " body "</turn>" newline
    body, name   = text without "</turn>" and "###"; a backslash and a letter stand for a control string

A text goes in as it is if the parser gives the turn back; otherwise its backslashes and control strings are replaced by
codes. The whole conversation is then parsed again and its roles and texts are compared with the source: where they differ
all its turns are escaped, and if that still does not give the source back, the job fails rather than store it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, AFTER_NAME, CLOSE, NEWLINE = "### ", ": ", "</turn>", "\n"
TURN_END = CLOSE + NEWLINE
#: Code letters behind a backslash.
CODES = (("\\", "b"), ("###", "h"), (CLOSE, "e"))


def escaped(text: Column) -> Column:
    """Backslashes first, then the control strings; every code is a backslash and one letter."""
    for plain, letter in CODES:
        text = F.replace(text, F.lit(plain), F.lit("\\" + letter))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``; a code stands alone, so the order backwards is right: the backslash last."""
    for plain, letter in reversed(CODES):
        text = F.replace(text, F.lit("\\" + letter), F.lit(plain))
    return text


def rendered(role: Column, body: Column) -> Column:
    name = F.replace(escaped(role), F.lit(":"), F.lit("\\c"))
    return F.concat(F.lit(OPEN), name, F.lit(AFTER_NAME), body, F.lit(TURN_END))


def header_size(piece: Column) -> Column:
    """Code points in front of a turn's text; a name holds no colon."""
    return F.char_length(F.substring_index(piece, AFTER_NAME, 1)) + len(AFTER_NAME)


def parsed(piece: Column) -> tuple[Column, Column]:
    """Role and text of one turn without its end."""
    name = F.substr(F.substring_index(piece, AFTER_NAME, 1), F.lit(len(OPEN) + 1))
    body = F.substr(piece, header_size(piece) + 1)
    return unescaped(F.replace(name, F.lit("\\c"), F.lit(":"))), unescaped(body)


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, body): the body each text gets in the template, one row per turn.

    The first choice is the text itself. It is kept if the turn, rendered with it, splits into one turn and an empty rest,
    parses back to its role and text and holds no control string. Null texts and roles are empty.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = F.split(rendered(F.col("role"), F.col("text")), _literal(TURN_END))
    role, text = parsed(parts[0])
    survives = (F.size(parts) == 2) & (parts[1] == "") & (role == F.col("role")) & (text == F.col("text"))
    for control in (CLOSE, OPEN.strip()):
        survives = survives & ~F.contains("text", F.lit(control))
    return rows.withColumn("body", F.when(survives, F.col("text")).otherwise(escaped(F.col("text"))))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def format_conversations(df: DataFrame, learn_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans) for every conversation.

    Turns stand in order of turn; ties follow role and text, null turns come first, and repeated rows are repeated.
    ``loss_spans`` lists (start, length) in code points, counted from zero, of the texts of ``learn_role``. Rows without
    a conv_id are one conversation. An output row holds a whole conversation, which is all that is gathered per key. A
    conversation that does not come back from its rendering fails the job.
    """
    rows = format_turns(df, conv_col, turn_col, role_col, text_col).withColumn("all", escaped(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def version(body: str) -> Column:
        """A rendered turn and where its body starts in the conversation."""
        piece = rendered(F.col("role"), F.col(body))
        ahead = F.coalesce(F.sum(F.char_length(piece)).over(before), F.lit(0))
        size = F.char_length(body)
        return F.struct(piece.alias("piece"), F.struct(
            (ahead + F.char_length(piece) - len(TURN_END) - size).cast("int").alias("start"), size.alias("length")).alias("span"))

    turns = rows.select("conv_id", F.struct(F.row_number().over(order).alias("place"), "role", "text", version("body").alias("own"),
                                            version("all").alias("all")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    text_of = lambda name: F.array_join(F.transform("turns", lambda t: t[name]["piece"]), "")
    spans_of = lambda name: F.transform(
        F.filter("turns", lambda t: t["role"] == learn_role), lambda t: t[name]["span"])
    tried = whole.select("conv_id", "turns", source.alias("source"), text_of("own").alias("own"))
    own = recovered(F.col("own")) == F.col("source")
    every = recovered(F.col("every")) == F.col("source")
    tried = tried.withColumn("own", F.when(own, F.col("own"))).withColumn(
        "every", F.when(F.col("own").isNull(), text_of("all")))
    lost = F.raise_error(F.concat(F.lit("a conversation does not survive its template: "), F.coalesce(
        F.col("conv_id").cast("string"), F.lit("null"))))
    checked = F.when(F.col("own").isNotNull(), F.col("own")).when(every, F.col("every")).otherwise(lost.cast("string"))
    return tried.select("conv_id", checked.alias("formatted"),
                        F.when(F.col("own").isNotNull(), spans_of("own")).otherwise(spans_of("all")).alias("loss_spans"))


def recovered(formatted: Column) -> Column:
    """(role, text) of all turns of a rendered conversation, as the parser reads them."""
    pieces = F.split(formatted, _literal(TURN_END))

    def turn(piece: Column) -> Column:
        role, text = parsed(piece)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, learnt): the turns of formatted conversations and whether the loss mask covers them.

    A turn's text counts as learnt if a span starts where it starts and has its length.
    """
    pieces = formatted.select("conv_id", F.split("formatted", _literal(TURN_END)).alias("p")).select(
        "conv_id", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("place", "piece"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.char_length("piece") + len(TURN_END)).over(before), F.lit(0)).cast("int")
    rows = pieces.withColumn("start", ahead + header_size(F.col("piece")))
    spans = formatted.select(F.col("conv_id").alias("span_id"), F.explode("loss_spans").alias("s")).select(
        "span_id", F.col("s.start").alias("span_start"), F.col("s.length").alias("span_length"))
    rows = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("span_id")) & (F.col("start") == F.col("span_start")), "left")
    piece = F.col("piece")
    role, text = parsed(piece)
    covered = F.coalesce(F.col("span_length") == F.char_length(piece) - header_size(piece), F.lit(False))
    return rows.select("conv_id", "place", role.alias("role"), text.alias("text"), covered.alias("learnt"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text and loss spans: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    turn = F.struct("place", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("line"),
                    F.when(F.col("learnt"), F.col("text")).otherwise("").alias("loss")).alias("t")
    whole = parse_conversations(formatted).select("conv_id", turn).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    joined = lambda name: F.array_join(F.transform("turns", lambda t: t[name]), "")
    sizes = formatted.select(F.col("conv_id").alias("own_id"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return whole.join(sizes, F.col("conv_id").eqNullSafe(F.col("own_id"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined("line"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars")
