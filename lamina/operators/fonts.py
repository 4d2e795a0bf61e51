"""Font analysis: which requested fonts are installed, equivalent, or missing with a suggestion.

Everything is decided per distinct font, so the joins run over the distinct requests; the rules are
constant tables of a few rows and are broadcast as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions.strings import font_key, font_label, not_blank, separators_off
from lamina.functions.unicode import nfkc

# fixed values: (pattern, candidates in order)
SUBSTITUTIONS = (
    ("singkaibeieg-bold-gb", (("Xingkai SC", "Bold"), ("Kaiti SC", "Bold"))),
    ("sxsgys", (("Songti SC", "Regular"), ("Kaiti SC", "Regular"))),
    ("biaoxiaozhilongzhuti-j", (("Xingkai SC", "Bold"), ("Kaiti SC", "Bold"))),
)
# fixed values: (pattern, families under which the same font is installed)
ALIASES = (
    ("sxsgys", ("苏新诗古印宋简", "SXS-GYSJ", "FZSuXinShiGuYinSongS", "方正苏新诗古印宋 简")),
    ("biaoxiaozhilongzhuti-j", ("标小智龙珠体 简", "标小智龙珠体", "BiaoXiaoZhiLongZhuTi")),
)
FALLBACKS = (("Inter", "Regular"), ("Arial", "Regular"))


def requested(texts: DataFrame) -> DataFrame:  # G14, F18
    """Distinct (family, style) with key and spelling; the last spelling in order wins. texts: ord, family, style, base_family, base_style (nullable)."""
    family = F.coalesce(not_blank(F.col("family")), F.col("base_family"))
    style = F.coalesce(not_blank(F.col("style")), F.col("base_style"), F.lit("Regular"))
    rows = texts.select("ord", family.alias("family"), style.alias("style")).filter("family is not null and trim(family) <> ''")
    got = rows.groupBy(font_key(F.col("family"), F.col("style")).alias("key")).agg(F.max_by(F.struct("family", "style"), "ord").alias("f"))
    return got.select("key", "f.family", "f.style")


def listed(installed: DataFrame) -> DataFrame:  # S20, O3
    """family, style of the installed fonts, one of each key (the last listed), by family and then style as a reader sorts names. installed: ord, family, style."""
    got = installed.groupBy(font_key(F.col("family"), F.col("style")).alias("key")).agg(F.max_by(F.struct("family", "style"), "ord").alias("f"))
    return got.select("f.family", "f.style").orderBy(F.collate("family", "UNICODE"), F.collate("style", "UNICODE"))


def _family_key(c):
    return separators_off(nfkc(c))


def _first(rows: DataFrame, by: list[str], order: list, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select(*by, *columns)


def _regular_first():
    return F.when(F.lower("style") == "regular", 0).otherwise(1)


def analyze(wanted: DataFrame, installed: DataFrame, substitutions=SUBSTITUTIONS, aliases=ALIASES) -> DataFrame:  # 2.12, J10-J13
    """key, family, style, decision (exact, equivalent, suggested, fallback), chosen_family, chosen_style.

    wanted: key, family, style; installed: ord, family, style, where ord is the order of listing.
    """
    spark = wanted.sparkSession
    fonts = installed.groupBy(font_key(F.col("family"), F.col("style")).alias("key")).agg(F.max_by(F.struct("family", "style"), "ord").alias("f"), F.min("ord").alias("ord")).select("key", "f.family", "f.style", "ord")
    by_family = _first(fonts.withColumn("fk", _family_key(F.col("family"))), ["fk"], [_regular_first(), F.col("ord")], ["family", "style"])
    by_name = _first(fonts.withColumn("fk", F.lower("family")), ["fk"], [_regular_first(), F.col("ord")], ["family", "style"])
    fallback = fonts.select("family", "style", F.coalesce(*[F.when(F.col("key") == f"{f}::{s}".lower(), i) for i, (f, s) in enumerate(FALLBACKS)], F.lit(len(FALLBACKS))).alias("r"))
    fallback = fallback.orderBy("r", "family", "style").limit(1).select(F.col("family").alias("fb_family"), F.col("style").alias("fb_style"))

    rows = wanted.join(fonts.select("key", F.lit(True).alias("exact")), "key", "left").withColumn("fk", _family_key(F.col("family"))).withColumn("lk", F.lower("family"))
    rows = rows.join(by_family.select("fk", F.struct("family", "style").alias("same")), "fk", "left")
    alias_rows = [(p, r, c, a) for r, (p, names) in enumerate(aliases) for c, a in enumerate(names)]
    rows = _with_rule(spark, rows, alias_rows, by_family.select("fk", F.struct("family", "style").alias("hit")), "alias")
    sub_rows = [(p, r, c, f"{f}::{s}".lower()) for r, (p, fs) in enumerate(substitutions) for c, (f, s) in enumerate(fs)]
    rows = rows.join(by_name.select(F.col("fk").alias("lk"), F.struct("family", "style").alias("relative")), "lk", "left")
    rows = _with_rule(spark, rows, sub_rows, fonts.select(F.col("key").alias("fk"), F.struct("family", "style").alias("hit")), "substitute", exact_key=True)
    rows = rows.crossJoin(F.broadcast(fallback))  # one row
    decision = F.when(F.col("exact"), "exact").when(F.coalesce("same", "alias").isNotNull(), "equivalent").when(F.coalesce("relative", "substitute").isNotNull(), "suggested").otherwise("fallback")
    chosen = F.when(F.col("exact"), F.struct("family", "style")).otherwise(F.coalesce("same", "alias", "relative", "substitute", F.struct(F.col("fb_family").alias("family"), F.col("fb_style").alias("style"))))
    return rows.withColumn("decision", decision).withColumn("_c", chosen).select("key", "family", "style", "decision", F.col("_c.family").alias("chosen_family"), F.col("_c.style").alias("chosen_style"))


def _with_rule(spark: SparkSession, rows: DataFrame, rules: list, hits: DataFrame, out: str, exact_key: bool = False) -> DataFrame:  # J12
    """Adds `out`: the first available candidate of the first rule whose pattern the family matches."""
    if not rules:
        return rows.withColumn(out, F.lit(None).cast("struct<family:string,style:string>"))
    table = spark.createDataFrame(rules, "pattern string, rule int, cand int, name string")
    first = rows.select("key", "family").join(F.broadcast(table.select("pattern", "rule").distinct()), F.rlike(F.lower("family"), F.col("pattern"))).groupBy("key").agg(F.min("rule").alias("rule"))
    named = table.withColumn("fk", F.col("name") if exact_key else _family_key(F.col("name"))).join(hits, "fk").groupBy("rule").agg(F.min_by("hit", "cand").alias(out))
    return rows.join(first.join(F.broadcast(named), "rule").select("key", out), "key", "left")


def choose(wanted: DataFrame, installed: DataFrame, replacements: DataFrame, fallback: tuple[str, str]) -> DataFrame:  # J14, G15
    """key, chosen family and style, missing: exact if installed, else the explicit replacement if that is installed, else the fallback."""
    fonts = installed.select(font_key(F.col("family"), F.col("style")).alias("fkey"), F.struct("family", "style").alias("font")).dropDuplicates(["fkey"])
    rows = wanted.join(fonts.select(F.col("fkey").alias("key"), F.col("font").alias("own")), "key", "left")
    named = replacements.select("key", font_key(F.col("to_family"), F.col("to_style")).alias("fkey")).join(fonts, "fkey").select("key", F.col("font").alias("other"))
    rows = rows.join(named, "key", "left").withColumn("_c", F.coalesce("own", "other", F.struct(F.lit(fallback[0]).alias("family"), F.lit(fallback[1]).alias("style"))))
    return rows.select("key", "family", "style", F.col("_c.family").alias("chosen_family"), F.col("_c.style").alias("chosen_style"), F.col("own").isNull().alias("missing"), F.when(F.col("own").isNull(), font_label(F.col("family"), F.col("style"))).alias("label"))
