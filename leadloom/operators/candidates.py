"""Candidates and ledgers: scans of text lines, merging, suppression, appending once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.exprs import profile_url


def parse_candidates(lines: DataFrame) -> DataFrame:
    """(seq, domain, name, country, vertical, branches) of pipe-separated lines (seq, line); comments and short lines go."""
    p = F.split("line", r"\|")
    ok = lines.where(~F.trim("line").startswith("#") & (F.trim("line") != "")).select("seq", p.alias("p")).where(F.size("p") >= 4)
    return ok.select("seq", *[F.trim(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(("domain", "name", "country", "vertical"))], F.coalesce(F.try_to_number(F.get("p", F.lit(4)), F.lit("999999")).cast("long"), F.lit(0).cast("long")).alias("branches"))


def parse_unresolved(lines: DataFrame, cap: int) -> DataFrame:
    """(seq, name, country, city, vertical, over_cap) of lines with exactly four fields and a name."""
    p = F.split("line", r"\|")
    ok = lines.select("seq", p.alias("p")).where(F.size("p") == 4).select("seq", *[F.trim(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(("name", "country", "city", "vertical"))]).where("name <> ''")
    # the first cap rows by a sort with a limit, so no task sees all
    first = ok.select("seq").orderBy("seq").limit(cap).withColumn("inside", F.lit(True))
    return ok.join(first, "seq", "left").withColumn("over_cap", F.col("inside").isNull()).drop("inside")


def ledger_keys(lines: DataFrame) -> DataFrame:
    """Distinct (key_type, key_value) found in free text lines: email, slug, phone, message."""
    one = lambda kind, p, g: F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(g)), lambda x: F.struct(F.lit(kind).alias("key_type"), F.lower(x).alias("key_value")))
    keys = F.concat(one("email", K.EMAIL, 0), one("slug", r"\[\[([^\]]+)\]\]", 1), one("phone", r"wa:([0-9]{6,15})", 1), one("message", r"<([^<>\s]+@[^<>\s]+)>", 1))
    k = lines.select(F.explode(keys).alias("k")).select("k.*")
    return k.where(~((F.col("key_type") == "email") & (F.contains("key_value", F.lit("smtp-relay")) | F.contains("key_value", F.lit("mailin.fr"))))).distinct()


def suppression_keys(lines: DataFrame) -> DataFrame:
    """Distinct (key_type, key_value) of every e-mail and every profile URL anywhere in free text lines; URLs in canonical form."""
    one = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("key_type"), x.alias("key_value")))
    mails = F.transform(F.regexp_extract_all("line", F.lit(K.EMAIL), F.lit(0)), F.lower)
    urls = F.array_compact(F.transform(F.regexp_extract_all("line", F.lit(K.PROFILE_LINK), F.lit(0)), profile_url))
    return lines.select(F.explode(F.concat(one("email", mails), one("profile", urls))).alias("k")).select("k.*").distinct()


def bounce_keys(lines: DataFrame) -> DataFrame:
    """Distinct (key_type, key_value): an address in the line, else the second field as a domain."""
    ok = lines.where(~F.col("line").rlike("^[#>`-]"))
    email = F.lower(F.regexp_extract("line", K.EMAIL, 0))
    second = F.lower(F.trim(F.get(F.split("line", r"\|"), F.lit(1))))
    out = ok.select(F.when(email != "", F.struct(F.lit("email").alias("key_type"), email.alias("key_value"))).when(second.rlike(r"^[^ ]+\.[^ ]+$"), F.struct(F.lit("domain").alias("key_type"), second.alias("key_value"))).alias("k"))
    return out.where("k is not null").select("k.*").distinct()


def ledger_window(ledger: DataFrame, run_id: str, today, days: int | None) -> DataFrame:
    """Rows of other runs that are at most days old; a bad date counts as new; None is forever."""
    rows = ledger.where(F.col("run_id") != run_id)
    age = F.coalesce(F.datediff(F.lit(today).cast("date"), F.col("entry_date")), F.lit(0))
    return rows if days is None else rows.where(age <= days)


def merge_candidates(cands: DataFrame, allowed, sent_domains: DataFrame, sent_slugs: DataFrame, disqualified: DataFrame, sourced: DataFrame | None = None) -> DataFrame:
    """cands with drop_reason: country, sent, disqualified, sourced (if given), duplicate, or null for the first good row of a domain.

    Ledgers are sets of keys joined as flags; a row that a ledger or country drops does not claim its domain.
    """
    flag = lambda df, c, name: df.select(F.col(c).alias(name)).distinct()
    c = cands.withColumn("slug", F.replace("domain", F.lit("."), F.lit("-")))
    c = c.join(flag(sent_domains, "domain", "s_domain"), F.col("domain") == F.col("s_domain"), "left").join(flag(sent_slugs, "slug", "s_slug"), F.col("slug") == F.col("s_slug"), "left")
    c = c.join(flag(disqualified, "domain", "d_domain"), F.col("domain") == F.col("d_domain"), "left")
    bad = F.when(~F.col("country").isin(*allowed) if allowed is not None else F.lit(False), "country").when(F.col("s_domain").isNotNull() | F.col("s_slug").isNotNull(), "sent").when(F.col("d_domain").isNotNull(), "disqualified")
    if sourced is not None:
        c = c.join(flag(sourced, "domain", "o_domain"), F.col("domain") == F.col("o_domain"), "left")
        bad = bad.when(F.col("o_domain").isNotNull(), "sourced")
    c = c.withColumn("bad", bad)
    firsts = c.where("bad is null").groupBy("domain").agg(F.min("seq").alias("first_seq"))
    c = c.join(firsts, "domain", "left")
    reason = F.when(F.col("seq") > F.col("first_seq"), "duplicate").otherwise(F.col("bad"))  # once a domain is kept, all later rows are repeats
    return c.select(*cands.columns, reason.alias("drop_reason"))


def merge_audit(merged: DataFrame) -> DataFrame:
    """(drop_reason, country, n, share) of all rows but repeats."""
    n = merged.where("drop_reason is null or drop_reason <> 'duplicate'").groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason"), "country").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def merge_countries(merged: DataFrame, most: int = 8) -> DataFrame:
    """(country, n, rank) of the rows that the country rule dropped: the most countries by rows, then by code."""
    n = merged.where("drop_reason = 'country'").groupBy("country").agg(F.count("*").alias("n"))
    first = n.orderBy(F.desc("n"), "country").limit(most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "country")).cast("long"))  # at most most rows


def source_report(merged: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, verticals, found, kept, dry) of each declared source: its verticals in order, its rows, those that stay; dry without any.

    merged: source, vertical, drop_reason; sources: source. A source that brought nothing is dry too.
    """
    n = merged.groupBy("source").agg(
        F.array_join(F.array_sort(F.collect_set("vertical")), ",").alias("verticals"), F.count("*").alias("found"), F.count_if(F.col("drop_reason").isNull()).alias("kept")
    )
    s = sources.select("source").distinct().join(n, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.select("source", F.coalesce("verticals", F.lit("")).alias("verticals"), zero("found"), zero("kept"), (F.coalesce("kept", F.lit(0)) == 0).alias("dry"))


def merge_warnings(merged: DataFrame) -> DataFrame:
    """(kept, country, stale, country_warning, stale_warning): whether the country rule, or ledgers, took too large a share."""
    n = merged.agg(
        F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count_if(F.col("drop_reason") == "country").alias("country"), F.count_if(F.col("drop_reason").isin("sent", "disqualified", "sourced")).alias("stale")
    )
    return n.withColumns({"country_warning": F.col("country") > 0.3 * (F.col("kept") + F.col("country")), "stale_warning": F.col("stale") > 0.5 * (F.col("kept") + F.col("stale"))})


REASONS = ("country", "sent", "disqualified", "sourced", "duplicate")


def observed_merge(merged: DataFrame, allowed, name: str = "merge") -> tuple[DataFrame, Observation]:
    """merged as it is, and what is counted while it is written or read for the first time.

    The counts are rows, kept, one for each drop reason, and kept by country of allowed (None: none): those of merge_audit and
    merge_warnings without another scan of the tables. They are there once an action on the returned table has ended.
    """
    seen = Observation(name)
    reason = F.col("drop_reason")
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(reason.isNull()).alias("kept"), *[F.count_if(reason == r).alias(r) for r in REASONS]]
    counts += [F.count_if(reason.isNull() & (F.col("country") == c)).alias(f"kept_{c}") for c in allowed or ()]
    return merged.observe(seen, *counts), seen


def allowed_countries(listed: list[str], worldwide: bool = False, default: tuple[str, ...] = ("AE", "SA", "QA", "BH", "KW")) -> tuple[str, ...] | None:
    """The codes that may pass, None for all: those listed, all for * or ALL or where the profile is worldwide, else default."""
    codes = tuple(c.strip().upper() for c in listed if c.strip())
    if "*" in codes or "ALL" in codes or not codes and worldwide:
        return None
    return codes or default


def append_once(ledger: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The rows to append: the first of each key, by order, that the ledger lacks."""
    new = rows.join(ledger.select(*key).distinct(), key, "left_anti")
    return new.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def suppress(drafts: DataFrame, keys: dict[str, str], ledger: DataFrame, row_id: str) -> DataFrame:
    """drafts none of whose keys (column name: key type) is in the ledger (key_type, key_value).

    The keys become rows and meet the ledger in one equi-join; an OR in a join condition would be a nested loop.
    """
    long = drafts.select(row_id, F.explode(F.array(*[F.struct(F.lit(t).alias("key_type"), F.col(c).alias("key_value")) for c, t in keys.items()])).alias("k")).select(row_id, "k.*")
    hit = long.join(ledger, ["key_type", "key_value"], "left_semi").select(row_id).distinct()
    return drafts.join(hit, row_id, "left_anti")


def take_until(units: DataFrame, order: str, amount: str, quota: int) -> DataFrame:
    """units while the sum of those before is below the quota. units: one row for each place."""
    before = F.coalesce(F.sum(amount).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return units.withColumn("before", before.cast("long")).where(F.col("before") < quota)
