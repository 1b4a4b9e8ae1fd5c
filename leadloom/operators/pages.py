"""Jobs over page text: digests, person names, flagged pages; reports on failures by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.exprs import visible_text

NAME = r"(?:^|[^A-Za-z])([A-Z][a-z]+) [A-Z][a-z]+"


def flag_pages(pages: DataFrame, phrases: list[str]) -> DataFrame:
    """(page_id, reason): the first phrase, in the order given, that the visible text holds; pages without one are left out."""
    t = pages.select("page_id", visible_text(F.col("html")).alias("t"))
    reason = F.lit(None).cast("string")
    for p in reversed(phrases):
        reason = F.when(F.contains("t", F.lit(p)), F.lit(p)).otherwise(reason)
    return t.select("page_id", reason.alias("reason")).where("reason is not null")


def challenged_pages(fetches: DataFrame, urls: list[str], phrases: list[str]) -> DataFrame:
    """(page_id, rule, reason) of fetches (page_id, status, url, html) that show a challenge; others are left out.

    Status comes first (429, 999, 500 and above), then the first pattern of urls that the URL matches, then the first of
    phrases in the visible text; so a vendor's name in a script or an attribute is no reason. Nulls match nothing.
    """
    status = F.col("status")
    text = visible_text(F.col("html"))
    by_url = F.coalesce(*[F.when(F.col("url").rlike("(?i)" + u), F.concat(F.lit("challenge/redirect URL: "), "url")) for u in urls], F.lit(None).cast("string"))
    by_text = F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(f'challenge page text: "{p}"')) for p in phrases], F.lit(None).cast("string"))
    by_status = F.when(status == 429, "HTTP 429 (rate limited)").when(status == 999, "HTTP 999 (blocked)").when(status >= 500, F.concat(F.lit("HTTP "), status.cast("string")))
    rule = F.when(F.col("s").isNotNull(), "status").when(F.col("u").isNotNull(), "url").otherwise("text")
    found = fetches.select("page_id", by_status.alias("s"), by_url.alias("u"), by_text.alias("t")).where("coalesce(s, u, t) is not null")
    return found.select("page_id", rule.alias("rule"), F.coalesce("s", "u", "t").alias("reason"))


def person_names(texts: DataFrame) -> DataFrame:
    """Distinct (id, first_name): first words of pairs of capitalised words."""
    return texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(1)))).alias("first_name"))


def page_digest(pages: DataFrame, most_pages: int = 3, per_page: int = 1200, least: int = 80) -> DataFrame:
    """(domain, rn, page_id, text): lines that no earlier page of the site has; short pages go, then the first most_pages stay.

    A line counts as seen also on a page that goes, so lines are settled before pages are numbered.
    """
    lines = pages.select("domain", "page_id", F.posexplode(F.split(F.regexp_replace("html", "<[^>]+>", "\n"), "\n")).alias("at", "line"))
    lines = lines.select("domain", "page_id", "at", F.trim("line").alias("line")).where(F.char_length("line") >= 3)
    seen = F.row_number().over(Window.partitionBy("domain", F.lower("line")).orderBy("page_id", "at"))
    lines = lines.withColumn("k", seen).where("k = 1")
    whole = lines.groupBy("domain", "page_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("ls"))
    text = F.left(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit(per_page))
    p = whole.select("domain", "page_id", text.alias("text")).where(F.char_length("text") >= least)
    return p.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy("page_id")).cast("long")).where(F.col("rn") <= most_pages)


def page_lines(html: Column) -> Column:
    """The lines of a page's text: tags end a line, hidden parts go, common entities are decoded, blanks are single."""
    for tag in K.HIDDEN_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(html, "<[^>]+>", "\n")
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("\u00a0", " ")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return F.transform(F.split(F.regexp_replace(t, r"[ \t\r\f\x0B]+", " "), "\n"), lambda x: F.trim(x))


def people_digest(pages: DataFrame, most_pages: int = 3, per_page: int = 1200, total: int = 3600, least: int = 80) -> DataFrame:
    """(domain, rn, page_id, slug, text): text of a site's pages that name people, in the order of PEOPLE_PAGES.

    Lines under three characters, consent banners and lines of an earlier page go; a page that then has under least
    characters goes, though its lines count as seen. Texts are cut to per_page, and to total over the site.
    """
    place = F.coalesce(*[F.when(F.lower("slug").startswith(k), i) for i, k in enumerate(K.PEOPLE_PAGES)])
    lines = pages.withColumn("place", place).where("place is not null").select("domain", "place", "page_id", "slug", F.posexplode(page_lines(F.col("html"))).alias("at", "line"))
    lines = lines.where((F.char_length("line") >= 3) & ~F.col("line").rlike("(?iu)" + K.BANNER))
    seen = F.row_number().over(Window.partitionBy("domain", F.lower("line")).orderBy("place", "page_id", "at"))
    whole = lines.withColumn("k", seen).where("k = 1").groupBy("domain", "place", "page_id", "slug").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("ls"))
    p = whole.withColumn("text", F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).where(F.char_length("text") >= least)
    order = Window.partitionBy("domain").orderBy("place", "page_id")
    used = F.coalesce(F.sum(F.least(F.char_length("text"), F.lit(per_page))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumns({"rn": F.row_number().over(order).cast("long"), "used": used}).where((F.col("rn") <= most_pages) & (F.col("used") < total))
    return p.select("domain", "rn", "page_id", "slug", F.left("text", F.least(F.lit(per_page), F.lit(total) - F.col("used")).cast("int")).alias("text"))


def repeat_failures(failures: DataFrame) -> DataFrame:
    """(run, failed, repeated): domains that fail in a run, and how many of them failed in an earlier one. failures: run, domain."""
    f = failures.select("run", "domain").distinct()
    f = f.withColumn("first_run", F.min("run").over(Window.partitionBy("domain")))
    return f.groupBy("run").agg(F.count("*").alias("failed"), F.count_if(F.col("first_run") < F.col("run")).alias("repeated"))


def completion_guard(batches: DataFrame, least: float = 0.6) -> DataFrame:
    """(run, n, done, abort) of batches (run, done: boolean)."""
    b = batches.groupBy("run").agg(F.count("*").alias("n"), F.count_if("done").alias("done"))
    return b.withColumn("abort", F.col("done") < least * F.col("n"))


def work_items(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, payload): the columns as one JSON object for each row."""
    return rows.select(key, F.to_json(F.struct(*columns)).alias("payload"))
