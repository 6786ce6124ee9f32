"""Row and column operators: projection, filters, flags, derived columns, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fathomline.functions import values as V
from fathomline.operators.ordered import page_rows, position
from fathomline.session import null_on_failure

# The words that read as true, the date parts, the number in a text.
TRUE_WORDS = ("1", "true", "yes", "y", "是")
DATE_PARTS = ("year", "month", "day", "hour", "dayofyear", "week", "quarter", "date")
NUMBER_PATTERN = r"-?\d+(?:[\d,]*\d)?(?:\.\d+)?"
DURATION_SECONDS = {"minutes": 60.0, "hours": 3600.0, "days": 86400.0}
CAST_KINDS = ("number", "integer", "text", "boolean")
FILTER_OPS = ("not_empty", "is_empty", "equals", "not_equals", "gt", "gte", "lt", "lte", "in")
FLAG_OPS = ("not_empty", "is_empty", "equals", "contains", "gt", "gte", "lt", "lte")
EXPLORE_OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in", "is_null", "not_null")
PATTERN_LIMIT = 200


# ---------------------------------------------------------------- columns
def select_columns(df: DataFrame, *, columns) -> DataFrame:
    wanted = V.names(columns)
    if not wanted:
        raise ValueError("select_columns needs at least one column")
    V.need(df, *wanted)
    return df.select(*[V.col(df, c) for c in wanted])


def drop_columns(df: DataFrame, *, columns) -> DataFrame:
    unwanted = V.names(columns)
    if not unwanted:
        raise ValueError("drop_columns needs at least one column")
    return df.drop(*unwanted)


def rename_columns(df: DataFrame, *, mapping: dict[str, str]) -> DataFrame:
    if not mapping:
        raise ValueError("rename_columns needs a mapping")
    return df.withColumnsRenamed(mapping)


def cast_types(df: DataFrame, *, casts: dict[str, str]) -> DataFrame:
    if not casts:
        raise ValueError("cast_types needs at least one column")
    out = {}
    for name, target in casts.items():
        V.need(df, name)
        V.one_of("cast target", target, CAST_KINDS)
        printed = F.lower(F.trim(V.col(df, name).cast("string")))
        if target == "number":
            out[name] = V.number(df, name)
        elif target == "integer":
            out[name] = V.number(df, name).try_cast("bigint")
        elif target == "text":
            out[name] = V.col(df, name).cast("string")
        else:
            out[name] = F.when(~V.blank(df, name), printed.isin(*TRUE_WORDS))
    return df.withColumns(out)


def fill_missing(df: DataFrame, *, columns, value=0) -> DataFrame:
    """Nulls and blank text become `value`; a value of another type makes text."""
    wanted = V.names(columns)
    V.need(df, *wanted)
    out = {}
    for name in wanted:
        dtype = V.kind(df, name)
        whole = isinstance(value, int) and not isinstance(value, bool)
        fits = (
            isinstance(value, str) == isinstance(dtype, T.StringType)
            and isinstance(value, bool) == isinstance(dtype, T.BooleanType)
        )
        if V.is_numeric(dtype) and fits:
            current = V.col(df, name)
            if not whole and isinstance(dtype, T.IntegralType):
                current = current.cast("double")
            filler = F.lit(value)
        elif fits:
            current, filler = V.col(df, name), F.lit(value)
        else:
            current, filler = V.col(df, name).cast("string"), F.lit(V.printed(value))
        out[name] = F.when(V.blank(df, name), filler).otherwise(current)
    return df.withColumns(out)


# ---------------------------------------------------------------- predicates
def _ordered(number: Column, op: str, bound: float) -> Column:
    limit = F.lit(bound)
    return {
        "gt": number > limit,
        "gte": number >= limit,
        "lt": number < limit,
        "lte": number <= limit,
    }[op]


def _bound(value) -> float:
    try:
        return float(str(value).replace(",", ""))
    except ValueError:
        raise ValueError(f"an ordering needs a number to compare with, not {value!r}") from None


def filter_rows(
    df: DataFrame, *, column: str, op: str = "not_empty", value=None, require_rows: bool = False
) -> DataFrame:
    """Keep rows. Equality compares printed values, so null is unequal to any text."""
    V.one_of("filter operator", op, FILTER_OPS)
    if op == "not_empty":
        keep = ~V.blank(df, column)
    elif op == "is_empty":
        keep = V.blank(df, column)
    elif op in ("equals", "not_equals", "in"):
        wanted = [V.printed(v) for v in (value or [])] if op == "in" else [V.printed(value)]
        dtype = V.kind(df, column) if column in df.columns else T.StringType()
        direct = isinstance(dtype, T.StringType) and "None" not in wanted
        # Text columns compare without a wrapper, so the predicate reaches the scan.
        seen = V.col(df, column) if direct else V.text(df, column)
        keep = seen.isin(*wanted) if op != "not_equals" else (
            (seen != wanted[0]) | V.col(df, column).isNull() if direct else seen != wanted[0]
        )
    else:
        bound = _bound(value)
        if column in df.columns and V.is_numeric(V.kind(df, column)):
            keep = _ordered(V.col(df, column), op, bound)
        else:
            keep = F.lit(False)
    kept = df.where(keep)
    if require_rows and kept.isEmpty():
        raise ValueError(f"the filter on {column!r} leaves no row")
    return kept


def flag_rows(
    df: DataFrame, *, column: str, op: str = "not_empty", value=None, output: str | None = None
) -> DataFrame:
    V.one_of("flag operator", op, FLAG_OPS)
    if op == "not_empty":
        flag = ~V.blank(df, column)
    elif op == "is_empty":
        flag = V.blank(df, column)
    elif op == "equals":
        flag = V.text(df, column) == V.printed(value)
    elif op == "contains":
        flag = V.text(df, column, null_as="").contains(V.printed(value))
    else:
        flag = _ordered(V.number(df, column), op, _bound(value))
    return df.withColumn(output or f"{column}_flag", F.coalesce(flag, F.lit(False)))


def _coerced(value, dtype: T.DataType):
    """(literal, True) where a filter value can become the column's type."""
    try:
        if value is None:
            return None, False
        if isinstance(dtype, T.BooleanType):
            word = V.printed(value).strip().lower()
            if word in ("true", "1", "yes"):
                return True, True
            return False, word in ("false", "0", "no")
        if isinstance(dtype, T.IntegralType):
            return int(float(str(value))), True
        if V.is_numeric(dtype):
            return float(str(value)), True
        if isinstance(dtype, T.StringType):
            return _seen(value), True
    except (ValueError, OverflowError):
        pass
    return None, False


def _seen(value) -> str:
    if value is None:
        return ""
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return V.printed(value)


def explore_condition(df: DataFrame, column: str, op: str, value=None) -> Column:
    V.one_of("operator", op, EXPLORE_OPS)
    V.need(df, column)
    c, dtype = V.col(df, column), V.kind(df, column)
    shown = F.coalesce(c.cast("string"), F.lit(""))
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if op == "contains":
        if value is None:
            return F.lit(False)
        return F.lower(shown).contains(str(value).lower())
    if op == "in":
        options = list(value or [])
        if not options:
            return F.lit(False)
        pairs = [_coerced(v, dtype) for v in options]
        if all(ok for _, ok in pairs):
            return c.isin(*[v for v, _ in pairs])
        return shown.isin(*[_seen(v) for v in options])
    literal, fits = _coerced(value, dtype)
    left, right = (c, F.lit(literal)) if fits else (shown, F.lit(_seen(value)))
    return {
        "eq": left == right,
        "ne": left != right,
        "gt": left > right,
        "gte": left >= right,
        "lt": left < right,
        "lte": left <= right,
    }[op]


def explore_filter(df: DataFrame, *, conditions: list[dict]) -> DataFrame:
    return df.where(
        V.every(
            [explore_condition(df, c["column"], c["op"], c.get("value")) for c in conditions]
        )
    )


def explore_query(
    df: DataFrame,
    *,
    columns=None,
    conditions: list[dict] | None = None,
    sort_by=None,
    descending: bool = False,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """One page of the rows that pass, a hundred unless `limit` says otherwise, also in a composed plan.

    An offset needs an order, else pages may overlap; it should be unique.
    """
    if offset and not sort_by:
        raise ValueError("an offset needs sort_by")
    out = explore_filter(df, conditions=conditions or [])
    if sort_by:
        order = V.names(sort_by)
        if descending:
            order = [o[1:] if o.startswith("-") else f"-{o}" for o in order]
        if columns:
            kept = {*V.names(columns), *[o.lstrip("-") for o in order]}
            out = out.select(*[f"`{c}`" for c in out.columns if c in kept])
        out = page_rows(out, offset=offset, length=limit, order_by=order)
    else:
        out = out.limit(int(limit))
    return select_columns(out, columns=columns) if columns else out


def explore_total(df: DataFrame, *, conditions: list[dict] | None = None) -> DataFrame:
    return explore_filter(df, conditions=conditions or []).agg(F.count(F.lit(1)).alias("total"))


# ---------------------------------------------------------------- expressions
def formula(
    df: DataFrame, *, expressions: dict[str, str], keep_input_columns: bool = True
) -> DataFrame:
    """Named Spark SQL expressions; a later one may read an earlier one.

    A row in which an expression fails gets null there, and `formula_failures` counts it.
    """
    if not expressions:
        raise ValueError("formula needs at least one expression")
    out = df
    with null_on_failure(df.sparkSession):
        for name, expression in expressions.items():
            out = out.withColumn(name, F.expr(expression))
    return out if keep_input_columns else out.select(*expressions)


def formula_failures(df: DataFrame, *, outputs, inputs=None) -> DataFrame:
    """Rows, and per output those that failed: null although all ``inputs`` are there.

    An expression that means to give null, as a CASE without ELSE, cannot be told from one that failed.
    """
    there = reduce(lambda a, b: a & b, [V.col(df, i).isNotNull() for i in V.names(inputs)], F.lit(True))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(V.col(df, o).isNull() & there).alias(f"failed_{o}") for o in V.names(outputs)],
    )


def rule(
    df: DataFrame,
    *,
    rules: list[dict],
    default: dict | None = None,
    mode: str = "first_match",
) -> DataFrame:
    """Ordered IF/THEN rules. A condition that is null or fails does not match."""
    V.one_of("mode", mode, ("first_match", "all_matches"))
    if not rules:
        raise ValueError("rule needs at least one rule")
    hits = []
    for i, r in enumerate(rules):
        if not r.get("then"):
            raise ValueError(f"rule {r.get('name') or i} assigns nothing")
        hits.append(F.coalesce(F.expr(f"({r['when']})").cast("boolean"), F.lit(False)))
    labels = [r.get("name") or f"rule_{i}" for i, r in enumerate(rules)]
    with null_on_failure(df.sparkSession):
        marked = df.withColumn("_hits", F.array(*hits))
    if mode == "first_match":
        first = F.array_position("_hits", F.lit(True))
        marked = marked.withColumn(
            "_hits",
            F.transform("_hits", lambda hit, i: hit & (i + 1 == first)),
        )
    fired = [F.col("_hits")[i] for i in range(len(rules))]
    none = ~F.array_contains("_hits", True)
    targets = list(dict.fromkeys(t for r in rules for t in r["then"]))
    targets += [t for t in (default or {}) if t not in targets]
    out = {}
    for target in targets:
        # Later matches win, so the last matching rule is looked at first.
        branches = [
            (fired[i], F.lit(rules[i]["then"][target]))
            for i in reversed(range(len(rules)))
            if target in rules[i]["then"]
        ]
        if target in (default or {}):
            branches.append((none, F.lit(default[target])))
        chain = F.when(*branches[0])
        for hit, given in branches[1:]:
            chain = chain.when(hit, given)
        out[target] = chain.otherwise(V.col(df, target)) if target in df.columns else chain
    out["matched_rules"] = F.array_compact(
        F.array(*[F.when(f, F.lit(label)) for f, label in zip(fired, labels)])
    )
    return marked.withColumns(out).drop("_hits")


def rule_metrics(df: DataFrame, *, rules: list[dict]) -> DataFrame:
    labels = [r.get("name") or f"rule_{i}" for i, r in enumerate(rules)]
    unmatched = F.count_if(F.size("matched_rules") == 0)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        unmatched.alias("unmatched"),
        F.round(1 - unmatched / F.count(F.lit(1)), 4).alias("match_rate"),
        *[F.count_if(F.array_contains("matched_rules", n)).alias(f"hits_{n}") for n in labels],
    )


# ---------------------------------------------------------------- scalars
def parse_numeric(
    df: DataFrame, *, column: str, output: str | None = None, keep_original: bool = True
) -> DataFrame:
    target = output or f"{column}_value"
    if column in df.columns and V.is_numeric(V.kind(df, column)):
        parsed = V.col(df, column).cast("double")
    else:
        bare = F.replace(V.col(df, column).cast("string"), F.lit(","), F.lit(""))
        parsed = F.regexp_substr(bare, F.lit(NUMBER_PATTERN)).try_cast("double")
    out = df.withColumn(target, parsed)
    return out if keep_original or target == column else out.drop(column)


def extract_pattern(
    df: DataFrame, *, column: str, pattern: str, group: int = 0, output: str | None = None
) -> DataFrame:
    """First match in the whole text; null where nothing matches."""
    V.need(df, column)
    if not pattern or len(pattern) > PATTERN_LIMIT:
        raise ValueError(f"the pattern must have 1 to {PATTERN_LIMIT} characters")
    seen = V.col(df, column).cast("string")
    found = F.when(seen.rlike(pattern), F.regexp_extract(seen, pattern, group))
    return df.withColumn(output or f"{column}_match", found)


def datetime_parts(df: DataFrame, *, column: str, parts, prefix: str | None = None) -> DataFrame:
    V.need(df, column)
    at = V.moment(df, column)
    made = {
        "year": F.year(at),
        "month": F.month(at),
        "day": F.dayofmonth(at),
        "hour": F.hour(at),
        "dayofyear": F.dayofyear(at),
        "week": F.weekofyear(at),
        "quarter": F.quarter(at),
        "date": F.date_format(at, "yyyy-MM-dd"),
    }
    wanted = V.names(parts)
    for part in wanted:
        V.one_of("date part", part, DATE_PARTS)
    return df.withColumns(
        {
            f"{prefix or column}_{p}": made[p] if p == "date" else made[p].cast("long")
            for p in wanted
        }
    )


def duration_between(
    df: DataFrame, *, start: str, end: str, unit: str = "hours", output: str | None = None
) -> DataFrame:
    V.one_of("unit", unit, DURATION_SECONDS)
    a, b = V.moment(df, start), V.moment(df, end)
    span = (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6 * DURATION_SECONDS[unit])
    return df.withColumn(output or f"duration_{unit}", F.when(b >= a, F.round(span, 3)))


def bin_numeric(
    df: DataFrame,
    *,
    column: str,
    edges: list[float],
    labels=None,
    output: str | None = None,
    below_label: str = "below range",
    above_label: str = "above range",
) -> DataFrame:
    V.need(df, column)
    cuts, names = [float(e) for e in edges or []], V.names(labels)
    if len(cuts) < 2 or cuts != sorted(cuts):
        raise ValueError("edges must be at least two numbers in rising order")
    if names and len(names) != len(cuts) - 1:
        raise ValueError(f"{len(cuts) - 1} bands need as many labels, not {len(names)}")
    names = names or [f"{V.short(a)}-{V.short(b)}" for a, b in zip(cuts, cuts[1:])]
    v = V.number(df, column)
    band = F.when(v < cuts[0], F.lit(below_label))
    for upper, name in zip(cuts[1:], names):
        band = band.when(v < upper, F.lit(name))
    band = band.when(v == cuts[-1], F.lit(names[-1])).when(v.isNotNull(), F.lit(above_label))
    return df.withColumn(output or f"{column}_band", band)


def map_values(
    df: DataFrame,
    *,
    column: str,
    mapping: dict | DataFrame,
    default=None,
    output: str | None = None,
    keep_unmapped: bool = True,
) -> DataFrame:
    """Lookup by printed value: a literal map, or a table (key, value) joined on it."""
    target = output or f"{column}_label"
    key = V.text(df, column, null_as="")
    if isinstance(mapping, DataFrame):
        table = mapping.toDF("_key", "_value").dropDuplicates(["_key"])
        looked = df.withColumn("_text", key).join(table, F.col("_text") == F.col("_key"), "left")
        hit = F.col("_value").cast("string")
    else:
        if not mapping:
            raise ValueError("map_values needs a mapping")
        pairs = [F.lit(x) for k, v in mapping.items() for x in (str(k), V.printed(v))]
        looked, hit = df, F.create_map(*pairs)[key]
    rest = F.lit(V.printed(default)) if default is not None else (
        V.col(df, column).cast("string") if keep_unmapped else F.lit(None)
    )
    return looked.withColumn(target, F.coalesce(hit, rest)).drop("_key", "_value", "_text")


# ---------------------------------------------------------------- order
def sort_rows(df: DataFrame, *, column, descending: bool = False) -> DataFrame:
    V.need(df, *[c.lstrip("-") for c in V.names(column)])
    return df.orderBy(*V.ordering(column, descending=descending))


def limit_rows(df: DataFrame, *, count: int = 100, from_end: bool = False, order_by) -> DataFrame:
    order = V.must_order(order_by)
    if count < 0:
        raise ValueError("count must not be negative")
    if not from_end:
        return df.orderBy(*V.ordering(order)).limit(count)
    turned = [
        F.col(f"`{o.lstrip('-')}`").asc_nulls_first()
        if o.startswith("-")
        else F.col(f"`{o}`").desc_nulls_first()
        for o in order
    ]
    return df.orderBy(*turned).limit(count).orderBy(*V.ordering(order))


def page(df: DataFrame, *, offset: int, length: int, order_by) -> DataFrame:
    """Rows `offset` to `offset + length`, also far back."""
    return page_rows(df, offset=offset, length=length, order_by=order_by)


def drop_duplicates(df: DataFrame, *, columns=None, order_by=None) -> DataFrame:
    """First row per key in `order_by`. Nulls are equal; no columns means all of them."""
    keys = V.names(columns)
    if not keys:
        return df.dropDuplicates()
    V.need(df, *keys)
    # Row-number 1 is cut down inside each map task before the shuffle.
    w = Window.partitionBy(*[V.col(df, k) for k in keys]).orderBy(
        *V.ordering(V.must_order(order_by))
    )
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_per_key(df: DataFrame, *, keys, order_by: str) -> DataFrame:
    """The newest row per key."""
    return drop_duplicates(
        df, columns=keys, order_by=[f"-{o}" for o in V.must_order(order_by)]
    )


def top_per_group(
    df: DataFrame, *, k: int, group_by=None, order_by, output: str | None = None
) -> DataFrame:
    """The first k rows of each group, optionally numbered."""
    groups = V.names(group_by)
    order = V.ordering(V.must_order(order_by))
    if not groups and not output:
        return df.orderBy(*order).limit(k)
    kept = df if groups else df.orderBy(*order).limit(k)
    w = Window.partitionBy(*[V.col(df, g) for g in groups]).orderBy(*order)
    numbered = kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    if output:
        numbered = numbered.withColumn(output, F.col("_n").cast("long"))
    return numbered.drop("_n")


def rank_rows(
    df: DataFrame,
    *,
    column: str,
    descending: bool = True,
    output: str | None = None,
    order_by,
    group_by=None,
    blocks: bool | None = None,
) -> DataFrame:
    """Unique 1-based rank by value; ties follow `order_by`; null gets no rank."""
    V.need(df, column)
    keyed = df.withColumn("_by", V.number(df, column))
    ordered = position(
        keyed,
        "_rank",
        group_by=group_by,
        order_by=[("-" if descending else "") + "_by", *V.must_order(order_by)],
        blocks=blocks,
    )
    return ordered.withColumn(
        output or f"{column}_rank", F.when(F.col("_by").isNotNull(), F.col("_rank"))
    ).drop("_by", "_rank")


def category_order(df: DataFrame, *, column: str, stated=None) -> DataFrame:
    """Order categories: the stated ones first, then by number or text, null last."""
    shown = F.when(V.blank(df, column), F.lit("(none)")).otherwise(V.col(df, column).cast("string"))
    named = V.names(stated)
    place = F.array_position(F.array(*[F.lit(s) for s in named]), shown) if named else F.lit(0)
    place = F.when(place == 0, F.lit(len(named) + 1)).otherwise(place)
    c = V.col(df, column)
    natural = c if V.is_numeric(V.kind(df, column)) else c.cast("string")
    return df.orderBy(place, natural.asc_nulls_last())
