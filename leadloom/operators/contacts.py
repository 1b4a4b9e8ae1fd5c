"""Contacts out of page text: addresses, their classes, the best one of a site, phones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.exprs import deobfuscate, on_domain, root_domain


def _tidy(email: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(email), "^(%20)+", ""), r"^\.+", "")


def written_emails(html: Column) -> Column:
    """Addresses in a page's text, plain or disguised, by place; repeats stay."""
    clean = F.replace(F.regexp_replace(deobfuscate(html), "%[0-9A-Fa-f]{2}", " "), F.lit("\u00a0"), F.lit(" "))
    return F.transform(F.regexp_extract_all(clean, F.lit(K.EMAIL), F.lit(0)), _tidy)


def linked_emails(html: Column) -> Column:
    """Targets of a page's mailto links, by place; repeats stay."""
    target = lambda x: F.regexp_replace(F.regexp_replace(x, "%40", "@"), "%2[eE]", ".")
    return F.transform(F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?i)" + K.MAILTO), F.lit(1)), target), lambda x: x.contains("@")), _tidy)


def page_emails(html: Column) -> Column:
    """Distinct lower-case addresses in a page: written ones, disguised ones, and mailto targets."""
    return F.array_distinct(F.concat(written_emails(html), linked_emails(html)))


def harvest_emails(pages: DataFrame) -> DataFrame:
    """Distinct (domain, email) of all pages (domain, html); each page's own repeats go before the shuffle."""
    return pages.select("domain", F.explode(page_emails(F.col("html"))).alias("email")).distinct()


def email_class(email: Column) -> Column:
    """junk, role, personal (free mail) or person; the first rule that holds."""
    local, dom = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    junk = (F.size(F.split(email, "@")) != 2) | (F.char_length(local) < 3) | local.isin(*K.PLACEHOLDER_LOCALS)
    for p in K.JUNK:
        junk = junk | email.rlike(p)
    return F.when(junk, "junk").when(local.isin(*K.ROLE_LOCALS), "role").when(dom.isin(*K.FREEMAIL), "personal").otherwise("person")


def classify_emails(emails: DataFrame) -> DataFrame:
    return emails.withColumn("email_class", email_class(F.col("email")))


def pick_best_contact(emails: DataFrame) -> DataFrame:
    """(domain, best_email, email_class, n_emails): own person, own role, free mail, other person, other role; then shortest, then first."""
    c = classify_emails(emails).where("email_class <> 'junk'")
    own = on_domain(F.col("email"), F.col("domain"))
    rank = F.when(F.col("email_class") == "person", F.when(own, 0).otherwise(3)).when(F.col("email_class") == "role", F.when(own, 1).otherwise(4)).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), F.char_length("email").alias("n"), "email", "email_class"))
    return c.groupBy("domain").agg(best.alias("b"), F.count("*").alias("n_emails")).select("domain", F.col("b.email").alias("best_email"), "b.email_class", "n_emails")


def bucket_contacts(emails: DataFrame, most: int = 12) -> DataFrame:
    """(domain, bucket, n, emails): personal, role, offdomain and freemail lists of at most most each, in order."""
    c = classify_emails(emails).where("email_class <> 'junk'")
    off = root_domain(F.col("email")) != root_domain(F.col("domain"))
    c = c.withColumn("bucket", F.when(F.col("email_class") == "personal", "freemail").when(off, "offdomain").when(F.col("email_class") == "role", "role").otherwise("personal"))
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("domain", "bucket").orderBy("email"))).where(F.col("rn") <= most)
    return c.groupBy("domain", "bucket").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("email")), ",").alias("emails"))


def bucket_contacts_first_seen(pages: DataFrame, most: int = 12, least: int = 200) -> DataFrame:
    """(domain, bucket, rn, email): personal, role, offdomain and freemail lists of at most most each, as first seen.

    Pages under least characters are left out; the others are read by slug, then page_id, all written addresses before
    all mailto targets. A role counts before the host of an address, unlike in bucket_contacts; a local part of two
    characters is enough.
    """
    named = lambda part: lambda x: F.struct(F.lit(part).alias("part"), x.alias("email"))
    both = F.concat(F.transform(written_emails(F.col("html")), named(0)), F.transform(linked_emails(F.col("html")), named(1)))
    e = pages.where(F.char_length("html") >= least).select("domain", "slug", "page_id", F.posexplode(both).alias("at", "x")).select("domain", "slug", "page_id", "at", "x.*")
    e = e.groupBy("domain", "email").agg(F.min(F.struct("part", "slug", "page_id", "at")).alias("first"))
    local, dom = F.substring_index("email", "@", 1), F.substring_index("email", "@", -1)
    junk = (F.size(F.split("email", "@")) != 2) | (F.char_length(local) < 2) | local.isin(*K.PLACEHOLDER_LOCALS)
    for p in K.JUNK:
        junk = junk | F.col("email").rlike(p)
    bucket = F.when(local.isin(*K.ROLE_LOCALS), "role").when(dom.isin(*K.FREEMAIL), "freemail").when(root_domain(F.col("email")) != root_domain(F.col("domain")), "offdomain").otherwise("personal")
    rn = F.row_number().over(Window.partitionBy("domain", "bucket").orderBy("first")).cast("long")
    return e.where(~junk).withColumn("bucket", bucket).select("domain", "bucket", rn.alias("rn"), "email").where(F.col("rn") <= most)


def harvest_phones(pages: DataFrame, most: int = 6) -> DataFrame:
    """(domain, rn, phone): wa.me targets, then tel: links, 9 to 15 digits, by page; at most most for a domain."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    of = lambda p: F.transform(F.regexp_extract_all(F.lower("html"), F.lit(p), F.lit(1)), digits)
    found = pages.select("domain", "page_id", F.posexplode(F.concat(of(r"wa\.me/\+?(\d{7,15})"), of(r"""tel:([+0-9() .-]{6,25})"""))).alias("at", "phone"))
    found = found.where(F.length("phone").between(9, 15)).groupBy("domain", "phone").agg(F.min(F.struct("page_id", "at")).alias("first"))
    rn = F.row_number().over(Window.partitionBy("domain").orderBy("first", "phone"))
    return found.select("domain", rn.cast("long").alias("rn"), "phone").where(F.col("rn") <= most)


def person_format_evidence(emails: DataFrame) -> DataFrame:
    """Domains with an address of their own that has a person's form."""
    c = classify_emails(emails)
    return c.where((F.col("email_class") == "person") & (root_domain(F.col("email")) == root_domain(F.col("domain"))) & F.substring_index("email", "@", 1).rlike("^[a-z]+[._-][a-z]+$")).select("domain").distinct()


def shared_offdomain(emails: DataFrame) -> DataFrame:
    """(email, n_domains) of addresses that are on none of the two or more sites that show them."""
    off = classify_emails(emails).where("email_class <> 'junk'").where(~on_domain(F.col("email"), F.col("domain")))
    return off.groupBy("email").agg(F.count("*").alias("n_domains")).where("n_domains >= 2")


def clear_shared_offdomain(leads: DataFrame, least: int = 2) -> DataFrame:
    """leads (domain, email, email_class and more) with the addresses cleared that least leads or more hold and that are on none of theirs.

    Such a lead has no email, the class none, and drop_reason; an address on a lead's own domain stays there and does not count.
    Case is folded. Holders are counted once for each address, so a shared one that very many leads hold costs one row.
    """
    held = leads.withColumn("__mail", F.nullif(F.lower("email"), F.lit(""))).withColumn("__own", F.coalesce(on_domain(F.col("__mail"), F.col("domain")), F.lit(True)))
    n = held.where(~F.col("__own")).groupBy("__mail").agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    d = held.join(n, "__mail", "left")
    bad = ~F.col("__own") & F.col("__n").isNotNull()
    reason = F.when(bad, F.concat(F.lit("off-domain address shared by "), F.col("__n").cast("string"), F.lit(" unrelated leads")))
    out = {"email": F.when(~bad, F.col("email")), "email_class": F.when(bad, "none").otherwise(F.col("email_class")), "drop_reason": reason}
    return d.withColumns(out).drop("__mail", "__own", "__n")


def rank_pages(pages: DataFrame, order: list[str], k: int, least: int = 500) -> DataFrame:
    """(domain, rn, page_id, slug): the first k pages of a site by slug order, then page_id."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("slug")), F.lit(0)), F.lit(len(order) + 1))
    rn = F.row_number().over(Window.partitionBy("domain").orderBy(place, "page_id"))
    return pages.where(F.char_length("html") >= least).select("domain", "page_id", "slug").withColumn("rn", rn.cast("long")).where(F.col("rn") <= k)


def listing_rows(pages: DataFrame) -> DataFrame:
    """(page_id, rn, name, link) of <li><a> rows, first of each name by place; names fold case and white space."""
    row = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(row), F.lit(1)).alias("link"), F.regexp_extract_all("html", F.lit(row), F.lit(2)).alias("name"))
    r = pages.select("page_id", F.posexplode(both).alias("at", "x")).select("page_id", "at", F.trim(F.regexp_replace("x.name", r"\s+", " ")).alias("name"), "x.link").where("name <> ''")
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("page_id", F.lower("name")).orderBy("at"))).where("k = 1")
    return r.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("at")).cast("long").alias("rn"), "name", "link")
