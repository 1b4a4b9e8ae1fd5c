"""Message tables: templates, contract gates, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.exprs import country_name, short_name

from .candidates import suppress
from .names import is_direct_mailbox


def render(leads: DataFrame, openers: DataFrame, template: str, fallback: str, slots: list[str]) -> DataFrame:
    """leads with body: the template with each {slot} replaced by the column; the opener comes from (intake, opener) or is fallback."""
    d = leads.join(openers, "intake", "left").withColumn("opener", F.coalesce("opener", F.lit(fallback)))
    body = F.lit(template)
    for s in slots:
        body = F.replace(body, F.lit("{" + s + "}"), F.col(s))
    return d.withColumn("body", F.regexp_replace(body, r"\s*[–—]\s*", ", "))


def _filled(template, slots: dict):
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def _from(table: dict, key: str, default):
    """The table's value for the column key, or default."""
    if not table:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(key)), F.lit(default))


def render_drafts(leads: DataFrame, openers: dict, verticals: dict, dialects: dict, subject: str, body: str, run: str, defaults: tuple[str, str, str], phone: bool = False) -> DataFrame:
    """leads with name as it is used, salutation, subject, body_text, body_html and tags; by phone body_text, to_jid and tags.

    leads: name, country_code, vertical, signal, first_name, last_name, title and, by phone, to_phone in digits. openers by signal are
    templates of their own; defaults are the signal, vertical and dialect in words of leads that openers, verticals and dialects (by
    country code) do not know. Salutation is title and last name if both are there, else the first name. Slots: name, country,
    vertical, salutation, opener, dialect; what stands in a slot is not filled again but for the opener. Dashes become commas; empty lines
    part paragraphs of the html. The tables are settings, so they go into the plan and nothing is joined.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    d = leads.withColumns({"name": short_name(F.col("name")), "salutation": F.when(~blank("last_name") & ~blank("title"), F.concat("title", F.lit(" "), "last_name")).otherwise(F.col("first_name"))})
    words = {"name": F.col("name"), "country": country_name(F.col("country_code")), "vertical": _from(verticals, "vertical", defaults[1]), "dialect": _from(dialects, "country_code", defaults[2])}
    opener = _filled(_from(openers, "signal", openers[defaults[0]]), words)
    tidy = lambda c: F.regexp_replace(c, r"\s*[—–]\s*", ", ")
    text = lambda t: tidy(_filled(F.lit(t), {"opener": opener, "salutation": F.col("salutation"), **words}))
    d = d.withColumn("body_text", text(body))
    tags = [F.lit("cold-outreach"), *([F.lit("phone")] if phone else []), F.lit(run), F.col("vertical"), F.col("country_code")]
    if phone:
        d = d.withColumn("to_jid", F.concat("to_phone", F.lit("@c.us")))
    else:
        parts = F.transform(F.split(F.trim("body_text"), "\n\n"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
        d = d.withColumns({"subject": text(subject), "body_html": F.array_join(parts, "\n")})
    made = ["salutation", "body_text", *(["to_jid"] if phone else ["subject", "body_html"])]
    return d.withColumn("tags", F.array(*tags)).select(*leads.columns, *made, "tags")


def contract_gate(drafts: DataFrame, greeting: str, link: str, money: str, banned: str) -> DataFrame:
    """drafts (id, text) with drop_reason of the first broken rule: greeting, money words, link, banned words."""
    t = F.lower("text")
    reason = F.when(~F.col("text").startswith(greeting), "greeting").when(t.rlike(money), "money").when(~F.contains("text", F.lit(link)), "link").when(t.rlike(banned), "banned")
    return drafts.withColumn("drop_reason", reason)


def plan_batches(drafts: DataFrame, order: str, size: int) -> DataFrame:
    """drafts with batch_index, size rows to a batch by order. Numbers come from counts by range, so no task sees all rows.

    Rows are dealt into ranges of the order; each range's first number is the count of the ranges before.
    """
    dealt = drafts.withColumn("__range", F.floor(F.col(order) / 100_000))
    start = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    start = start.withColumn("__start", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.col("__start") + F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return dealt.join(start, "__range").withColumn("batch_index", F.floor(number / size).cast("long")).drop("__range", "__start")


def plan_sends(drafts: DataFrame, keys: dict[str, str], ledger: DataFrame, order: str, address: str, cap: int, size: int = 1000) -> DataFrame:
    """drafts that no ledger key suppresses, the first of each address by order, cap of them, with batch_index."""
    left = suppress(drafts, keys, ledger, order)
    first = left.groupBy(address).agg(F.min(order).alias(order))
    chosen = left.join(first, [address, order]).orderBy(order).limit(cap)
    return plan_batches(chosen, order, size)


def draft_contract(drafts: DataFrame, link: str, banned: str, signature: str) -> DataFrame:
    """drafts (subject, body, salutation, address, and a column link) with drop_reason, and subject, body and html as sent.

    In order: the address is a person's; the body opens with Hello and the salutation; no money words in body or
    subject; the link is there; no banned word. Dashes become commas, the word AI in a subject becomes the, and the
    signature is put behind a body that lacks it. Paragraphs stand between empty lines.
    """
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s*[—–]\s*", ", "))
    d = drafts.withColumns({"subject": tidy(F.coalesce("subject", F.lit(""))), "body": tidy(F.coalesce("body", F.lit("")))})
    money = F.lower("body").rlike(K.MONEY) | F.lower("subject").rlike(K.MONEY)
    reason = (
        F.when(~is_direct_mailbox(F.col("address")), "no_direct_email").when(~F.startswith("body", F.concat(F.lit("Hello "), "salutation", F.lit(","))), "salutation")
        .when(money, "money").when(~F.contains("body", F.col(link)), "no_link").when(F.lower("body").rlike(banned), "banned")
    )
    signed = F.when(F.contains("body", F.lit(signature)), F.col("body")).otherwise(F.concat(F.rtrim("body"), F.lit("\n" + signature)))
    d = d.withColumns({"drop_reason": reason, "subject": F.trim(F.regexp_replace("subject", r"(?i)(^|[^A-Za-z0-9_])ai($|[^A-Za-z0-9_])", "$1the$2")), "body": signed})
    return d.withColumn("html", F.array_join(F.transform(F.split("body", "\n\n"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "\n"))
