"""Naming and type standards."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from brightwell.functions.values import count_when, ntz
from brightwell.plans.lineage_cut import cut_lineage
from brightwell.plans.seek import page_of

# Shape of a type name, and the bases that carry a length or a precision.
TYPE_SHAPE = r"^(\w+)(?:\(([^)]+)\))?$"
LENGTH_BASES, PRECISION_BASES = ("VARCHAR", "CHAR"), ("DECIMAL", "NUMERIC")
UNBOUNDED = 2147483647


def parse_type(raw: Column) -> Column:
    """``BASE(p,s)`` as a struct; a missing or unreadable number is unbounded, an unreadable type is null."""
    text = F.upper(F.trim(raw))
    base = F.regexp_extract(text, TYPE_SHAPE, 1)
    parts = F.split(F.regexp_extract(text, TYPE_SHAPE, 2), ",")
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(UNBOUNDED))
    unbounded = F.lit(UNBOUNDED)
    return F.when(base != "", F.struct(
        base.alias("base"),
        F.when(base.isin(*LENGTH_BASES), number(0)).otherwise(unbounded).alias("length"),
        F.when(base.isin(*PRECISION_BASES), number(0)).otherwise(unbounded).alias("precision"),
        F.when(base.isin(*PRECISION_BASES), number(1)).otherwise(unbounded).alias("scale")))


def type_fits(expected: Column, actual: Column) -> Column:
    """Whether a parsed type meets a parsed standard: same base, text no longer than allowed, decimals with no more
    precision and scale than allowed."""
    room = lambda field: (expected[field] >= 0) & (actual[field] >= 0) & (
        expected[field] >= actual[field])
    base = expected["base"]
    sized = F.when(base.isin(*LENGTH_BASES), room("length")).when(
        base == "DECIMAL", room("precision") & room("scale")).otherwise(True)
    return F.coalesce((base == actual["base"]) & sized, F.lit(False))


def type_matches(expected: Column, actual: Column) -> Column:
    """:func:`type_fits` on type names."""
    return type_fits(parse_type(expected), parse_type(actual))


#: Parts that names are dealt to where a pattern has to be tried on all of them, and the longest n-gram that is looked up.
SALTS, GRAM = 64, 3
#: Tokens of a regular expression: escapes, classes, quantifiers, structure, and single characters; escapes that stand for
#: a kind of character or a place.
_PATTERN_TOKEN = r"(?s)\\.|\[\^?\]?(?:\\.|[^\]\\])*+\]|\{[^}]*+\}[?+]?|[*+?][?+]?|."
_KINDS = r"\A\\[dDwWsSbBAZzhHvVR]\z"


def _full(pattern: Column) -> Column:
    return F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z"))


def usable_pattern(pattern: Column) -> Column:
    """Whether the engine accepts a regular expression; a broken one matches nothing."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), _full(pattern), F.lit("")).isNotNull()


def required_text(pattern: Column) -> Column:
    """A text that every match of a regular expression contains, the longest in sight; empty if none is sure.

    Characters outside groups and classes count, each run of them up to the next other thing; one that a quantifier makes
    optional does not. Alternatives, flags and unusual escapes make nothing sure.
    """
    tokens = F.regexp_extract_all(pattern, F.lit(_PATTERN_TOKEN), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("run"), F.lit("").alias("best"), F.lit(True).alias("sure"),
                    F.lit("").alias("before"))
    longer = lambda s: F.when(F.char_length(s["run"]) > F.char_length(s["best"]), s["run"]).otherwise(s["best"])

    def step(s: Column, t: Column) -> Column:
        escaped = F.startswith(t, F.lit("\\")) & (F.char_length(t) == 2)
        odd = escaped & t.rlike(r"[A-Za-z0-9]\z") & ~t.rlike(_KINDS)
        structure = t.isin("(", ")", "|", "^", "$", ".") | (F.startswith(t, F.lit("[")) & (F.char_length(t) > 1)) | (
            escaped & t.rlike(r"[A-Za-z0-9]\z"))
        quantifier = t.rlike(r"(?s)\A(?:[*+?][?+]?|\{.*\}[?+]?)\z")
        char = F.when(escaped, F.substring(t, 2, 1)).otherwise(t)
        literal = ~structure & ~quantifier & (s["depth"] == 0)
        optional = t.rlike(r"\A(?:[*?]|\{0)")
        cut = F.substring(s["run"], F.lit(1), F.char_length(s["run"]) - 1)
        ended = F.when(quantifier & optional, F.struct(cut.alias("run"), s["best"].alias("best"))).otherwise(
            F.struct(s["run"].alias("run"), s["best"].alias("best")))
        return F.struct(
            (s["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("depth"),
            F.when(literal, F.concat(s["run"], char)).otherwise("").alias("run"),
            F.when(literal, s["best"]).otherwise(longer(ended)).alias("best"),
            (s["sure"] & ~odd & ~((t == "|") & (s["depth"] == 0)) & ~(quantifier & (s["before"] == "("))).alias("sure"),
            t.alias("before"))

    return F.aggregate(tokens, zero, step, lambda s: F.when(s["sure"], longer(s)).otherwise(""))


def grams(text: Column, size: Column) -> Column:
    """All parts of ``size`` characters of a text."""
    starts = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def standards_for(rules: DataFrame, kind: str) -> DataFrame:
    """The enabled standards of one object type."""
    return rules.filter(F.col("enabled") & (F.col("applies_to") == kind))


def read_rules(rules: DataFrame) -> DataFrame:
    """Standards as :func:`match_standard` uses them, read and written once: usable ones only, with the text and the length
    that names are looked up by. A blank value and a broken regular expression match nothing."""
    value, is_regex = F.col("rule_value"), F.col("rule_type") == "REGEX"
    usable = rules.filter(F.trim(F.coalesce(value, F.lit(""))) != "").withColumn("needed", F.when(
        is_regex, required_text(value))).filter(~is_regex | usable_pattern(value))
    size = F.when(is_regex, F.least(F.lit(GRAM), F.char_length("needed"))).otherwise(F.char_length(value))
    return cut_lineage(usable.withColumn("size", size))


def match_standard(objects: DataFrame, name: str, rules: DataFrame, out: str = "standard_id") -> DataFrame:
    """Adds the id of the first standard each name meets, by priority then age; null when it meets none.

    Names are matched once each, and always by equi-joins. Prefixes and suffixes are equal parts of a name, cut to the
    lengths that occur among the standards. A regular expression is tried on the names that hold the rarest n-gram of a
    text it requires; one that requires none has to be tried on every name, which is dealt over ``SALTS`` parts.
    """
    names = objects.select(F.col(name).alias("n")).filter(F.col("n").isNotNull()).distinct()
    usable = rules if "needed" in rules.columns else read_rules(rules)
    sizes = {(r["rule_type"], r["size"]) for r in usable.select("rule_type", "size").distinct().collect()}  # at most the lengths of names
    found = []
    for kind, part in (("PREFIX", F.left), ("SUFFIX", F.right)):
        lengths = sorted(n for k, n in sizes if k == kind)
        if lengths:
            cut = names.select("n", F.explode(F.array(*map(F.lit, lengths))).alias("size")).filter(
                F.length("n") >= F.col("size")).select("n", part(F.col("n"), F.col("size")).alias("rule_value"))
            fixed = usable.filter(F.col("rule_type") == kind).select("rule_value", "id", "priority")
            found.append(cut.join(fixed, "rule_value").select("n", "id", "priority"))
    patterns = usable.filter("rule_type = 'REGEX'").select("id", "priority", "needed", "size", _full(F.col("rule_value")).alias("pattern"))
    meets = F.expr("n RLIKE pattern")
    lengths = sorted(n for k, n in sizes if k == "REGEX")
    if any(lengths):
        postings = names.select("n", F.explode(F.flatten(F.array(
            *[grams(F.col("n"), F.lit(n)) for n in lengths if n]))).alias("gram"))
        frequency = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
        rarest = patterns.filter("size > 0").select("*", F.explode(grams(F.col("needed"), F.col("size"))).alias("gram")).join(
            frequency, "gram").groupBy("id", "priority", "needed", "pattern").agg(
            F.min_by("gram", F.struct("names", "gram")).alias("gram"), F.count(F.lit(1)).alias("known"),
            F.max(F.size(grams(F.col("needed"), F.col("size")))).alias("grams"))
        # A pattern of whose text some n-gram stands in no name meets none.
        rarest = rarest.filter("known = grams").drop("known", "grams")
        found.append(postings.join(rarest, "gram").filter(F.contains("n", F.col("needed"))).filter(meets).select(
            "n", "id", "priority"))
    if 0 in lengths:
        dealt = names.withColumn("part", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int"))
        everywhere = patterns.filter("size = 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found.append(dealt.join(everywhere, "part").filter(meets).select("n", "id", "priority"))
    if not found:
        return objects.withColumn(out, F.lit(None).cast("bigint"))
    hits = reduce(DataFrame.unionByName, found)
    first = hits.groupBy("n").agg(F.min_by("id", F.struct(-F.col("priority"), "id")).cast("bigint").alias(out))
    return objects.join(first, objects[name] == first["n"], "left").drop("n")


OFFERED = "array<struct<standard_name:string,rule_type:string,rule_value:string,allowed_types:array<string>>>"


def _described(allowed: Column) -> Column:
    return F.struct(F.col("name").alias("standard_name"), "rule_type", "rule_value", allowed.alias("allowed_types"))


def object_path(*parts: str) -> Column:
    return F.concat_ws(".", *[F.when(F.trim(F.col(p)) != "", F.col(p)) for p in parts])


def _set_of(standard: Column) -> Column:
    return F.concat(F.lit("#"), standard.cast("string"))


def _typed(rules: DataFrame, type_standards: DataFrame) -> DataFrame:
    """Enabled standards that point to a type standard, with its types."""
    allowed = type_standards.filter(F.size("allowed_types") > 0).select(F.col("id").alias("target_standard_id"), "allowed_types")
    return rules.filter("enabled").join(allowed, "target_standard_id").withColumn("standard_id", F.col("id"))


def applicable_standards(rules: DataFrame, type_standards: DataFrame) -> DataFrame:
    """(standards_set, applicable_standards), one row per set that findings name: all standards of an object type in order
    of priority and age, and each standard with a type on its own."""
    none = F.lit(None).cast("array<string>")
    order = F.struct((-F.col("priority")).alias("p"), "id", _described(none).alias("d"))
    whole = rules.filter("enabled").groupBy(F.col("applies_to").alias("standards_set")).agg(
        F.transform(F.sort_array(F.collect_list(order)), lambda s: s["d"]).cast(OFFERED).alias("applicable_standards"))
    own = _typed(rules, type_standards).select(_set_of(F.col("standard_id")).alias("standards_set"), F.array(
        _described(F.col("allowed_types"))).cast(OFFERED).alias("applicable_standards"))
    return whole.unionByName(own)


def compliance_scan(tables: DataFrame, columns: DataFrame, rules: DataFrame, type_standards: DataFrame) -> DataFrame:
    """Findings over ONLINE tables and columns.

    A name that meets no standard is a NAMING finding. A column whose standard points to a type standard must match one of
    its allowed types, else it is a TYPE finding. ``rules.target_standard_id`` refers to ``type_standards(id,
    allowed_types)``. ``standards_set`` names the standards that apply, which :func:`applicable_standards` lists once.
    Standards stay data: their number changes the size of joins, never the plan.
    """
    typed = _typed(rules, type_standards).select("standard_id", "allowed_types", F.transform(
        "allowed_types", parse_type).alias("allowed"))

    read = read_rules(rules.filter("enabled"))

    def online(df: DataFrame, kind: str, name: str) -> DataFrame:
        return match_standard(df.filter(F.col("source_status") == "ONLINE"), name, standards_for(read, kind))

    unnamed, none = F.col("standard_id").isNull(), F.lit(None).cast("string")
    strays = online(tables, "TABLE", "table_name").filter(unnamed).select(
        "table_id", F.lit("TABLE").alias("object_type"),
        object_path("database_name", "schema_name", "table_name").alias("object_path"),
        F.lit("NAMING").alias("violation_type"), "standard_id", none.alias("actual_value"), none.alias("expected_value"),
        F.lit("TABLE").alias("standards_set"))
    # Names and types of the columns are judged in one pass over them.
    judged = online(columns, "COLUMN", "column_name").join(typed, "standard_id", "left").withColumn(
        "parsed", parse_type(F.col("data_type")))
    misfit = F.col("allowed").isNotNull() & ~F.exists("allowed", lambda e: type_fits(e, F.col("parsed")))
    found = judged.filter(unnamed | misfit).select(
        "table_id", F.lit("COLUMN").alias("object_type"),
        object_path("database_name", "schema_name", "table_name", "column_name").alias("object_path"),
        F.when(unnamed, "NAMING").otherwise("TYPE").alias("violation_type"), "standard_id",
        F.when(~unnamed, F.col("data_type")).alias("actual_value"),
        F.when(~unnamed, F.array_join("allowed_types", ",")).alias("expected_value"),
        F.when(unnamed, "COLUMN").otherwise(_set_of(F.col("standard_id"))).alias("standards_set"))
    return strays.unionByName(found)


def replace_scope(old: DataFrame, new: DataFrame, scope: DataFrame, key: str = "table_id") -> DataFrame:
    """Results of a rescan: everything old outside the scope plus everything new."""
    return old.join(scope.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def compliance_summary(results: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Open and ignored findings, and the compliant share of all ONLINE objects with one decimal."""
    online = lambda df: df.filter(F.col("source_status") == "ONLINE").select(F.lit("object").alias("k"))
    kinds = results.select(F.when(F.col("ignored"), "ignored").otherwise("open").alias("k"))
    k = F.col("k")
    counts = kinds.unionByName(online(tables)).unionByName(online(columns)).agg(
        count_when(k == "open").alias("non_compliant"), count_when(k == "ignored").alias("ignored"),
        count_when(k == "object").alias("objects"))
    total, found = F.col("objects").cast("decimal(18,0)"), F.col("non_compliant").cast("decimal(18,0)")
    tenths = F.floor(F.try_divide((total - found) * 1000, total) + F.lit(0.5).cast("decimal(2,1)"))
    return counts.withColumn("rate", F.coalesce(tenths / 10, F.lit(100.0)).cast("double"))


def compliance_page(results: DataFrame, ignored: int | None = None, violation_type: str | None = None, t_from=None,
                    t_to=None, page: int = 1, size: int = 20, after: Mapping[str, object] | None = None) -> DataFrame:
    """``ignored`` 0 shows open findings, 1 ignored ones, 2 or none all; ``after`` as in :func:`seek.page_of`."""
    rows = results
    if ignored in (0, 1):
        rows = rows.filter(F.col("ignored") == bool(ignored))
    if violation_type:
        rows = rows.filter(F.col("violation_type") == violation_type)
    if t_from is not None:
        rows = rows.filter(F.col("checked_at") >= ntz(t_from))
    if t_to is not None:
        rows = rows.filter(F.col("checked_at") <= ntz(t_to))
    return page_of(rows, [("checked_at", True), ("id", True)], size, page, after)


# Type-name prefixes that make an incremental field numeric or temporal.
NUMERIC_PREFIXES = ("int", "tinyint", "smallint", "mediumint", "bigint", "decimal", "numeric", "float", "double", "real",
                    "number", "serial")
TEMPORAL_PREFIXES = ("date", "time", "year")


def type_category(type_name: Column) -> Column:
    """NUMERIC, TEMPORAL or OTHER by the start of the type name."""
    lower = F.lower(type_name)
    starts = lambda prefixes: reduce(lambda a, b: a | b, [lower.startswith(p) for p in prefixes])
    return F.when(starts(NUMERIC_PREFIXES), "NUMERIC").when(starts(TEMPORAL_PREFIXES), "TEMPORAL").otherwise("OTHER")


def comparable(a: Column, b: Column) -> Column:
    """Whether a source and a target type may be compared for an incremental read."""
    left = type_category(a)
    return (left != "OTHER") & (left == type_category(b))
