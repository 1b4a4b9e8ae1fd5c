"""Names out of addresses, direct mailboxes, and the gates a found contact has to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.exprs import root_domain

CUE = (
    r"(?:^|[^A-Za-z])(?:[Oo]wner|[Oo]wned by|[Ff]ounder|[Ff]ounded by|[Dd]irector|[Pp]roprietor|[Pp]rincipal|[Pp]artner|[Mm]anager|[Hh]ead of|"
    r"[Cc]ontact|[Ss]peak to|[Aa]sk for|[Cc]all|[Tt]alk to|[Mm]eet|[Ll]ed by|[Rr]un by|[Mm]rs?\.?|[Mm]s\.?|[Dd]r\.?)[ :,-]{1,4}([A-Z][a-z]{1,19})"
)
PAIR = r"(?:^|[^A-Za-z])([A-Z][a-z]{1,19})\s+[A-Z][a-z]{1,19}"


def is_direct_mailbox(email: Column) -> Column:
    """Whether an address can be a person's: no role word whole, first of three parts at most, or in all of them; no free mail."""
    e = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    roles = F.array(*map(F.lit, K.ROLE_MAILBOXES))
    parts = F.filter(F.split(local, "[._+-]"), lambda p: p != "")
    role = F.array_contains(roles, local) | (F.size(parts).between(1, 3) & (F.array_contains(roles, F.get(parts, F.lit(0))) | (F.size(F.array_except(parts, roles)) == 0)))
    shaped = F.contains(e, F.lit("@")) & (local != "") & F.contains(host, F.lit("."))
    return shaped & ~F.coalesce(role, F.lit(False)) & ~host.isin(*K.FREEMAIL)


def page_names(texts: DataFrame, key: str) -> DataFrame:
    """Distinct (key, name) in lower case: first words of capitalised pairs, and words behind a word that introduces a person."""
    found = F.concat(F.regexp_extract_all("text", F.lit(PAIR), F.lit(1)), F.regexp_extract_all("text", F.lit(CUE), F.lit(1)))
    return texts.select(key, F.explode(F.array_distinct(F.transform(found, F.lower))).alias("name")).distinct()


def derive_names(contacts: DataFrame, given_names: DataFrame, not_names: DataFrame, on_pages: DataFrame) -> DataFrame:
    """contacts (domain, email, business) with first_name, last_name and basis, null where the address names nobody.

    Gates in order: shape, coded or over 40 characters, free mail, role, placeholders; any part that is no name;
    then given.last, whose first word is a given name and no word of the business, or a given name alone that the
    site's pages (domain, name) show. given_names and not_names are tables of one column, name. The words of an
    address meet them by equi-joins; what an address needs of them is folded back before it is judged.
    """
    e = F.lower(F.trim("email"))
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    shaped = (F.size(F.split(e, "@")) == 2) & (local != "") & F.contains(host, F.lit("."))
    bad = F.contains(e, F.lit("%")) | (F.length(local) > 40) | host.isin(*K.FREEMAIL) | root_domain(host).isin(*K.FREEMAIL)
    bad = bad | local.isin(*K.ROLE_LOCALS, *K.PLACEHOLDER_LOCALS, *K.NAME_PLACEHOLDERS) | host.rlike(K.PLACEHOLDER_HOST)
    for part in K.PLACEHOLDER_PARTS:
        bad = bad | F.contains(e, F.lit(part))
    raw = F.filter(F.split(local, r"[._+-]"), lambda p: p != "")
    words = F.filter(F.transform(raw, lambda p: F.regexp_replace(p, "[^a-z]", "")), lambda p: p != "")
    brand = F.array_union(F.regexp_extract_all(F.lower("business"), F.lit("[a-z]{2,}"), F.lit(0)), F.regexp_extract_all(F.substring_index(root_domain(F.col("domain")), ".", 1), F.lit("[a-z]{2,}"), F.lit(0)))
    brand = F.array_union(brand, F.array(F.substring_index(root_domain(F.col("domain")), ".", 1)))
    short = F.exists("words", lambda w: (F.length(w) < 2) | w.isin(*K.PLACEHOLDER_LOCALS, *K.NAME_PLACEHOLDERS))
    c = contacts.select("domain", "email", "business").distinct()
    c = c.withColumns({"ok": shaped & ~bad, "n_raw": F.size(raw), "words": words, "brand": brand}).where("ok and size(words) > 0").where(~short)
    c = c.withColumn("real", F.filter("words", lambda w: ~w.isin(*K.NAME_PARTICLES)))
    c = c.withColumns({"first": F.when((F.col("n_raw") >= 2) & (F.size("real") >= 2), F.get("real", F.lit(0))).when(F.size("words") == 1, F.get("words", F.lit(0))), "last": F.when((F.col("n_raw") >= 2) & (F.size("real") >= 2), F.element_at("real", -1))})
    refused = c.select("domain", "email", F.explode("words").alias("name")).join(not_names.select("name").distinct(), "name", "left_semi").select("domain", "email").distinct()
    c = c.where("first is not null").join(refused, ["domain", "email"], "left_anti").join(given_names.select(F.col("name").alias("first")).distinct(), "first", "left_semi")
    c = c.where(~F.array_contains("brand", F.col("first")))
    alone = F.col("last").isNull()
    seen = on_pages.select("domain", F.col("name").alias("first")).distinct().withColumn("seen", F.lit(True))
    c = c.join(seen, ["domain", "first"], "left").where(~alone | (F.col("seen") & F.length("first").between(3, 20)))
    basis = F.when(alone, "email_local_first_name_site_confirmed").otherwise("email_local_first_last")
    named = c.select(F.col("domain").alias("n_domain"), F.col("email").alias("n_email"), F.col("business").alias("n_business"), F.initcap("first").alias("first_name"), F.initcap(F.coalesce("last", F.lit(""))).alias("last_name"), basis.alias("basis"))
    same = F.col("domain").eqNullSafe(F.col("n_domain")) & F.col("email").eqNullSafe(F.col("n_email")) & F.col("business").eqNullSafe(F.col("n_business"))
    return contacts.join(named, same, "left").drop("n_domain", "n_email", "n_business")


def pick_derived_name(derived: DataFrame) -> DataFrame:
    """The first contact of each domain, by pos, that a name was derived from. derived: domain, pos, email, first_name, last_name, basis."""
    row = F.min_by(F.struct("pos", "email", "first_name", "last_name", "basis"), "pos")
    return derived.where("first_name is not null").groupBy("domain").agg(row.alias("r")).select("domain", "r.*")


def business_as_surname(last: Column, business: Column) -> Column:
    """Whether a surname is the first word of a business name that also says what kind of business it is."""
    b = F.lower(F.trim(business))
    kind = F.lit(False)
    for w in K.BUSINESS_WORDS:
        kind = kind | F.contains(b, F.lit(w))
    return F.coalesce((F.trim(last) != "") & (F.substring_index(F.regexp_replace(b, r"\s+", " "), " ", 1) == F.lower(F.trim(last))) & kind, F.lit(False))


def gate_found_contacts(leads: DataFrame, results: DataFrame, mail_domains: DataFrame, person_format: DataFrame, constructed=("constructed",), phone_fallback: bool = True) -> DataFrame:
    """leads (domain, name) with what came of their results: drop_stage or channel, address, phone and confidence.

    results: domain, found, first, last, title, email, basis, url, phone, confidence. Gates in order: a match; a
    first name, or a surname with Mr. or Mrs.; a surname that is the business, unless confidence is high; a direct
    mailbox; evidence for a constructed address, a URL or another person-format address of its domain (person_format:
    domain); a domain that takes mail (mail_domains: domain). Who fails only by address and has a phone stays as
    phone-only where phone_fallback holds. A constructed address has medium confidence at most.
    """
    r = leads.select("domain", "name").join(results, "domain", "left").withColumn("host", F.substring_index(F.lower(F.trim("email")), "@", -1))
    flag = lambda df, c: df.select(F.col("domain").alias("host")).distinct().withColumn(c, F.lit(True))
    r = r.join(flag(mail_domains, "takes_mail"), "host", "left").join(flag(person_format, "person_form"), "host", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    built = F.coalesce(F.col("basis").isin(*constructed), F.lit(False))
    by_url = F.coalesce(F.lower("url").rlike("^https?://"), F.lit(False))
    digits = F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", "")
    name_stage = (
        F.when(~F.coalesce("found", F.lit(False)), "no_match")
        .when(blank("first") & ~(~blank("last") & F.coalesce(F.col("title").isin("Mr.", "Mrs."), F.lit(False))), "name_or_gender_missing")
        .when(business_as_surname(F.col("last"), F.col("name")) & ~F.coalesce(F.col("confidence") == "high", F.lit(False)), "business_as_surname")
    )
    mail_stage = F.when(~is_direct_mailbox(F.col("email")), "no_direct_email").when(built & ~by_url & F.col("person_form").isNull(), "constructed_no_url_evidence").when(F.col("takes_mail").isNull(), "dead_domain")
    r = r.withColumns({"name_stage": name_stage, "mail_stage": mail_stage, "digits": digits})
    by_phone = F.col("name_stage").isNull() & F.col("mail_stage").isNotNull() & (F.col("digits") != "") & F.lit(phone_fallback)
    stage = F.coalesce("name_stage", F.when(~by_phone, F.col("mail_stage")))
    kept = stage.isNull()
    return r.select(
        "domain", stage.alias("drop_stage"), F.when(kept, F.when(by_phone, "phone").otherwise("email")).alias("channel"), F.when(kept & ~by_phone, F.lower(F.trim("email"))).alias("contact_email"),
        F.when(kept & (F.col("digits") != ""), F.concat(F.lit("+"), "digits")).alias("contact_phone"), F.when(by_phone, F.col("mail_stage")).alias("phone_reason"),
        F.when(kept, F.when(built & (F.col("confidence") == "high") & ~by_phone, "medium").otherwise(F.coalesce("confidence", F.lit("low")))).alias("contact_confidence"),
    )
