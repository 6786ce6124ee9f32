"""Ranked findings per subject, the argument they make, and a check of its citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.operators.ordered import position
from fathomline.operators.rows import top_per_group

STRONGEST = 4
# The sentences of the composed argument, per language.
PHRASES = {
    "en": {
        "none": "%1$s: no evidence supports a judgement; keep watching.",
        "opening": "%1$s: %2$d findings, of which the strongest are:",
        "rest": "A further %1$d weaker findings were scored but are not listed.",
        "conclusion": 'Taken together this reads as "%1$s", on %2$s.',
    },
    "zh-TW": {
        "none": "%1$s：目前沒有任何足以支持判斷的證據，維持觀察。",
        "opening": "%1$s：本次分析共取得 %2$d 項證據，其中影響最大的是：",
        "rest": "另有 %1$d 項次要證據，未列於上方但已納入評分。",
        "conclusion": "綜合以上，判斷為「%1$s」，依據 %2$s。",
    },
}


def evidence_bundle(
    df: DataFrame,
    *,
    subject,
    severity: str | None = None,
    statement: str | None = None,
    category: str | None = None,
    columns=None,
    limit: int | None = None,
    order_by,
) -> DataFrame:
    """The findings of each subject, strongest first, numbered E1, E2 and so on.

    A ``limit`` lists only the strongest; give ``compose_reasoning`` the whole bundle then, so that its
    count of findings is true.
    """
    subjects = V.names(subject)
    named = V.names(columns) or [c for c in df.columns if c != severity]
    weight = F.coalesce(V.number(df, severity), F.lit(0.0)) if severity else F.lit(0.0)
    listed = F.concat_ws(
        "; ",
        *[F.concat(F.lit(f"{c} = "), F.coalesce(V.col(df, c).cast("string"), F.lit("—"))) for c in named],
    )
    said = F.when(~V.blank(df, statement), V.col(df, statement).cast("string")) if statement else None
    rows = df.withColumns(
        {
            "_weight": weight,
            "_said": F.coalesce(said, listed) if statement else listed,
            "_kind": F.coalesce(V.col(df, category).cast("string"), F.lit("")) if category else F.lit(""),
        }
    )
    order = ["-_weight", *V.must_order(order_by)]
    if limit is None:
        kept = position(rows, "place", group_by=subjects, order_by=order)
    else:
        kept = top_per_group(rows, k=limit, group_by=subjects, order_by=order, output="place")
    return kept.select(
        *[F.col(f"`{s}`") for s in subjects],
        F.concat(F.lit("E"), F.col("place").cast("string")).alias("ref"),
        "place",
        F.col("_said").alias("statement"),
        F.col("_weight").alias("severity"),
        F.col("_kind").alias("category"),
    )


def compose_reasoning(
    bundle: DataFrame, *, subject, conclusions: DataFrame | None = None, conclusion: str | None = None,
    language: str = "en",
) -> DataFrame:
    """One text per subject from its bundle: the strongest findings, and how many more there are."""
    subjects = V.names(subject)
    words = PHRASES.get(language, PHRASES["en"])
    items = bundle.groupBy(*[F.col(f"`{s}`") for s in subjects]).agg(
        F.count(F.lit(1)).alias("_all"),
        F.array_sort(
            F.collect_list(F.when(F.col("place") <= STRONGEST, F.struct("place", "ref", "statement")))
        ).alias("_top"),
    )
    if conclusions is not None:
        # A subject without findings still gets its sentence.
        items = conclusions.join(items, subjects, "left").withColumn(
            "_all", F.coalesce("_all", F.lit(0))
        )
    closing = V.col(items, conclusion) if conclusion else F.lit(None).cast("string")
    name = F.concat_ws(" ", *[F.col(f"`{s}`").cast("string") for s in subjects])
    lines = F.array_join(
        F.transform("_top", lambda i: F.concat(F.lit("- "), i["statement"], F.lit(" ["), i["ref"], F.lit("]"))),
        "\n",
    )
    rest = F.col("_all") - F.size("_top")
    refs = F.array_join(F.transform("_top", lambda i: i["ref"]), ", ")
    text = F.when(F.col("_all") == 0, F.format_string(words["none"], name)).otherwise(
        F.concat_ws(
            "\n\n",
            F.format_string(words["opening"], name, F.col("_all")),
            lines,
            F.when(rest > 0, F.format_string(words["rest"], rest)),
            F.when(closing.isNotNull(), F.format_string(words["conclusion"], closing, refs)),
        )
    )
    return items.select(*[F.col(f"`{s}`") for s in subjects], text.alias("reasoning"))


def unsupported_citations(texts: DataFrame, bundle: DataFrame, *, subject, text: str) -> DataFrame:
    """References a text makes that its subject's evidence lacks."""
    subjects = V.names(subject)
    known = bundle.groupBy(*[F.col(f"`{s}`") for s in subjects]).agg(
        F.max("place").alias("_known")
    )
    cited = F.array_distinct(F.regexp_extract_all(V.col(texts, text), F.lit(r"\[(E\d+)\]"), 1))
    # Refs run E1..En, so a subject's bundle is known from its size alone.
    joined = texts.join(known, subjects, "left").withColumn("_cited", cited)
    beyond = F.filter(
        "_cited",
        # A place prints without leading zeros, so E01 or a number too long for a place is no reference.
        lambda r: ~r.rlike("^E[1-9][0-9]{0,17}$")
        | (F.try_to_number(F.substr(r, F.lit(2)), F.lit("9" * 18)) > F.coalesce(F.col("_known"), F.lit(0))),
    )
    return joined.select(
        *[V.col(texts, c) for c in texts.columns],
        F.array_sort(beyond).alias("unsupported"),
    )
