"""Lead tables derived from the given tables by fixed rules, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions.exprs import norm_domain, url_host

SLUGS = ("home", "contact", "about", "team", "leadership", "people")
#: What is appended to page n is entry n mod 16; {h} is the page's host.
SNIPPETS = (
    "<a href='mailto:info@{h}'>mail</a>",
    "<a href='mailto:jane.miller@{h}?subject=x'>Jane</a>",
    "<p>Write to desk.partner@shared-agency.co.uk today</p>",
    "<p>sales [at] {h} or lucy.stone [at] {h}</p>",
    "<p>team%40{h} and %20maria.lopez%40{h}</p>",
    "<p>ourplace@gmail.com</p><form action='/s'><input name='email'></form>",
    "<input placeholder='your@email.com'> you@{h}",
    "<a href='https://wa.me/971501234567'>WhatsApp us</a>",
    "<a href='tel:+34911222333'>call</a> <p>phone</p>",
    "<script src='https://calendly.com/x.js'></script>",
    "<a href='/files/lunch.pdf'>menu</a>",
    "<a href='/b'>Book now</a> reception@{h}",
    "<script type='application/ld+json'>{\"reviewCount\": \"1247\"}</script> anna.berg@{h}",
    "<p>rated 4.8 by 892 reviews</p><span itemprop='ratingCount' content='310'></span>",
    "<script>gtag('config','GTM-ABCD12');fbq('init','1');</script><script src='https://embed.tawk.to/1'></script><link hreflang='en-GB'><link hreflang=\"fr\"><link hreflang='en'>",
    "<p>120 rooms, a 5 star house with spa and conference hall</p> concierge@{h}",
)
ALLOWED = ("ES", "FR", "GB")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, domain, slug, html): slugs in turn by page_id within a domain, html with a snippet behind."""
    pages = table(spark, sf_dir, "pages")
    # numbers are given to page_id and domain alone: no html is sorted, and a large host's pages are small rows there
    n = F.row_number().over(Window.partitionBy("domain").orderBy("page_id")) - 1
    p = pages.select("page_id", "html").join(pages.select("page_id", url_host(F.col("url")).alias("domain")).withColumn("n", n), "page_id")
    n = F.col("n")
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (n % len(SLUGS) + 1).cast("int"))
    snippet = F.replace(F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("page_id") % len(SNIPPETS) + 1).cast("int")), F.lit("{h}"), F.col("domain"))
    return p.select("page_id", "domain", slug.alias("slug"), F.concat("html", snippet).alias("html"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, batch_file, domain, name, country, vertical, branches, linked), a row for each page."""
    lang = F.regexp_extract("url", r"//[^/]+/([a-z]{2})/", 1)
    country = F.when(lang == "es", "ES").when(lang == "fr", "FR").when(lang == "de", "DE").otherwise("GB")
    vertical = F.element_at(F.array(*map(F.lit, ("hotel", "clinic", "trades"))), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"),
        (F.col("page_id") % 4).cast("int").alias("batch_file"),
        norm_domain(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("domain"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"),
        country.alias("country"),
        vertical.alias("vertical"),
        (F.col("page_id") % 35).cast("int").alias("branches"),
        (F.col("page_id") % 5 != 0).alias("linked"),
    )


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m, line, entry_date, run_id, domain, kind): ledger text of the domains, by m = their first seq."""
    d = candidates(spark, sf_dir).groupBy("domain").agg(F.min("seq").alias("m"))
    kind = F.when(F.col("m") % 7 == 0, "email").when(F.col("m") % 7 == 1, "slug").when(F.col("m") % 7 == 2, "disqualified").when(F.col("m") % 11 == 3, "bounce_domain")
    d = d.withColumn("kind", kind).where("kind is not null")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("m") % 60).cast("int"))
    run = F.concat(F.lit("r"), (F.col("m") % 3).cast("string"))
    slug = F.replace("domain", F.lit("."), F.lit("-"))
    line = (
        F.when(F.col("kind") == "email", F.concat(day.cast("string"), F.lit(" | Info@"), "domain", F.lit(" | lead | step 1 | "), run, F.lit(" | <m"), F.col("m").cast("string"), F.lit("@smtp-relay.example>")))
        .when(F.col("kind") == "slug", F.concat(day.cast("string"), F.lit(" | - | [["), slug, F.lit("]] | step 1 | "), run, F.lit(" | wa:97150"), F.lpad((F.col("m") % 1000).cast("string"), 7, "0")))
        .when(F.col("kind") == "disqualified", F.concat("domain", F.lit("|"), day.cast("string"), F.lit("|"), run, F.lit("|score<82")))
        .otherwise(F.concat(day.cast("string"), F.lit(" | "), "domain", F.lit(" | hard_bounce | x")))
    )
    return d.select("m", line.alias("line"), day.alias("entry_date"), run.alias("run_id"), "domain", "kind")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    return s.join(n, "s_nationkey").select(
        F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("domain"),
        "country", (2 + F.col("s_suppkey") % 20).cast("int").alias("headcount"),
    )


TITLES = ("Owner", "CEO", "General Manager", "Head of Sales", "Finance Director", "Shop Manager", "Press Officer", "Engineer", "")
URLS = ("https://www.linkedin.com/in/p-{k}", "http://linkedin.com/in/P-{k}/", "https://uk.linkedin.com/in/p-{k}?trk=a", "linkedin.com/in/p-{k}#top")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, profile_url, title, degree, open_profile, last_activity_days, mutuals, company_id, company, company_domain, company_country, headcount)."""
    k = F.col("c_custkey")
    who = F.when(k % 25 == 24, k - 1).otherwise(k)
    url = F.replace(F.element_at(F.array(*map(F.lit, URLS)), (k % 4 + 1).cast("int")), F.lit("{k}"), who.cast("string"))
    firms = companies(spark, sf_dir)
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "customer").join(F.broadcast(n)).select(  # one row
        k.alias("person_id"), url.alias("profile_url"), F.element_at(F.array(*map(F.lit, TITLES)), (k % 9 + 1).cast("int")).alias("title"),
        F.when(k % 4 > 0, (k % 4).cast("int")).alias("degree"), (k % 10 == 0).alias("open_profile"),
        F.when(k % 13 > 0, ((k * 7) % 140).cast("int")).alias("last_activity_days"), (k % 6).cast("int").alias("mutuals"),
        (k % F.col("n")).alias("company_id"),
    )
    return p.join(firms.select("company_id", F.col("name").alias("company"), F.col("domain").alias("company_domain"), F.col("country").alias("company_country"), "headcount"), "company_id", "left")


def send_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, profile, ts, status, message_id, dry_run, address)."""
    status = F.create_map(*[F.lit(x) for x in ("view", "attempting", "signup", "sent", "click", "accepted", "error", "failed", "purchase", "dm_sent")])
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") * 16 + F.col("event_id") % 16).alias("profile"), F.col("ts").cast("timestamp").alias("ts"), status[F.col("event_type")].alias("status"),
        F.concat(F.lit("<"), F.col("event_id").cast("string"), F.lit("@relay.example>")).alias("message_id"), (F.col("event_id") % 17 == 0).alias("dry_run"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("address"),
    )


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (40 + F.get("embedding", F.lit(0)).cast("double")).alias("lat"), F.get("embedding", F.lit(1)).cast("double").alias("lon"))


PLACES = (("alba", 39.7, -0.2, 0.15), ("brisa", 39.95, 0.0, 0.1), ("cerro", 40.05, 0.1, 0.2), ("duna", 40.2, -0.1, 0.1), ("ermita", 40.1, 0.3, 0.12), ("faro", 39.85, 0.25, 0.05))


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PLACES)], "pos int, place string, lat double, lon double, half double")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the documents, whole."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
