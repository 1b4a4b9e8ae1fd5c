"""Signals of a site: intake, size, reviews, trackers, load, and the traffic score.

Every pattern is looked for page by page in one projection, and html is dropped before the shuffle, so what
is grouped by site is flags and small sets whatever the pages weigh.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.exprs import review_number


def _numbers(text: Column, patterns) -> Column:
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]
    return F.coalesce(F.array_max(F.transform(F.concat(*found), review_number)), F.lit(0).cast("long"))


def _in_text(text: Column) -> Column:
    """Counts that are the text of an element with a closing tag."""
    p = F.lit(K.REVIEW_TEXT_IN)
    both = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("tag"), F.regexp_extract_all(text, p, F.lit(2)).alias("n"))
    return F.coalesce(F.array_max(F.transform(F.filter(both, lambda x: ~x["tag"].isin(*K.VOID_TAGS)), lambda x: review_number(x["n"]))), F.lit(0).cast("long"))


def page_signals(pages: DataFrame, least: int = 500) -> DataFrame:
    """A row of flags for each page of at least least characters."""
    p = pages.where(F.char_length("html") >= least).select("domain", "page_id", "slug", F.lower("html").alias("h"))
    h = F.col("h")
    # the lower-case text is one column that all patterns share
    return p.select(
        "domain", "page_id", "slug", F.char_length(F.trim(h)).cast("long").alias("chars"),
        *[h.rlike(v).alias(f"in_{k}") for k, v in K.INTAKE.items()],
        F.coalesce(F.array_max(F.transform(F.regexp_extract_all(h, F.lit(K.ROOMS), F.lit(1)), lambda x: x.cast("long"))), F.lit(0).cast("long")).alias("rooms"),
        h.rlike(K.FIVE_STAR).alias("five"), h.rlike(K.FOUR_STAR).alias("four"),
        F.filter(F.array(*map(F.lit, K.SCALE_WORDS)), lambda w: F.contains(h, w)).alias("scale"),
        _numbers(h, K.REVIEWS["reviews_jsonld"]).alias("r_jsonld"),
        F.greatest(_numbers(h, K.REVIEWS["reviews_microdata"]), _in_text(h)).alias("r_microdata"),
        _numbers(h, K.REVIEWS["reviews_text"]).alias("r_text"),
        *[h.rlike(v).alias(f"tracker_{k}") for k, v in K.TRACKERS.items()],
        h.rlike(K.CHAT).alias("chat"),
        F.array_distinct(F.regexp_extract_all(h, F.lit(K.HREFLANG), F.lit(1))).alias("langs"),
    )


def site_signals(pages: DataFrame) -> DataFrame:
    """One row for each site with all its flags, maxima and sets."""
    s = page_signals(pages)
    flags = [f"in_{k}" for k in K.INTAKE] + ["five", "four", "chat"] + [f"tracker_{k}" for k in K.TRACKERS]
    return s.groupBy("domain").agg(
        F.count("*").alias("n_pages"), (F.sum("chars") + F.count("*") - 1).alias("chars"), F.array_sort(F.collect_set("slug")).alias("slugs"),
        *[F.bool_or(f).alias(f) for f in flags], *[F.max(c).alias(c) for c in ("rooms", "r_jsonld", "r_microdata", "r_text")],
        F.array_distinct(F.flatten(F.collect_set("scale"))).alias("scale"), F.array_distinct(F.flatten(F.collect_set("langs"))).alias("langs"),
    )


def intake_signal() -> Column:
    f = lambda k: F.col(f"in_{k}")
    return (
        F.when(f("platform"), "modern_booking").when(f("pdf_menu"), "pdf_menu").when(f("whatsapp") & ~f("book"), "whatsapp")
        .when(f("form") & ~f("book"), "contact_form").when(f("book"), "booking_form_manual").otherwise("phone_led")
    )


def property_scale() -> Column:
    n, only_weak = F.size("scale"), (F.size("scale") > 0) & (F.size(F.array_except("scale", F.array(*map(F.lit, K.WEAK_WORDS)))) == 0)
    high = (F.col("rooms") >= 80) | ((F.col("rooms") >= 50) & (F.col("five") | F.col("four"))) | (F.col("five") & (n >= 1)) | (n >= 3)
    medium = (F.col("rooms") >= 40) | F.col("four") | F.col("five") | ((n >= 1) & ~only_weak)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def review_count() -> Column:
    return F.least(F.greatest("r_jsonld", "r_microdata", "r_text"), F.lit(K.REVIEW_CLAMP).cast("long"))


def tracker_depth() -> Column:
    return sum((F.col(f"tracker_{k}").cast("long") for k in K.TRACKERS), F.lit(0).cast("long"))


def operational_load(branches: Column) -> Column:
    points = [(F.col("chat"), K.CHAT_POINTS), (F.size("langs") >= 2, K.LANGUAGE_POINTS), (F.col("n_pages") >= K.MANY_PAGES, K.PAGES_POINTS), (branches >= K.MANY_BRANCHES, K.BRANCH_POINTS)]
    return sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0)).cast("long")


def traffic_signals(branches: Column) -> Column:
    found = [("chat_widget", F.col("chat")), ("many_pages", F.col("n_pages") >= K.MANY_PAGES), ("multi_branch", branches >= K.MANY_BRANCHES), ("multilang", F.size("langs") >= 2)]
    found += [(f"reviews_{k}", F.col(f"r_{k}") > 0) for k in ("jsonld", "microdata", "text")] + [(f"tracker_{k}", F.col(f"tracker_{k}")) for k in K.TRACKERS]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in sorted(found, key=lambda x: x[0])]))


def score_traffic(sites: DataFrame, branches: Column) -> DataFrame:
    """sites with reviews, trackers, load, traffic_score, traffic_tier and traffic_signals; too little text is unknown."""
    points = F.lit(0)
    for least, p in reversed(K.REVIEW_POINTS):
        points = F.when(F.col("reviews") >= least, p).otherwise(points)
    s = sites.withColumns({"reviews": review_count(), "trackers": tracker_depth(), "load": operational_load(branches)})
    known = F.col("chars") >= K.JUDGED_FROM
    score = points + F.least(F.col("trackers") * K.TRACKER_POINTS, F.lit(K.TRACKER_MAX)) + F.col("load")
    s = s.withColumn("traffic_score", F.when(known, score).otherwise(0).cast("long"))
    tier = F.when(~known, "unknown").when(F.col("traffic_score") >= K.HIGH_FROM, "high").when(F.col("traffic_score") >= K.MEDIUM_FROM, "medium").otherwise("low")
    return s.withColumns({"traffic_tier": tier, "traffic_signals": F.when(known, traffic_signals(branches)).otherwise(F.array().cast("array<string>"))})
