"""Canonical forms as column expressions: domains, URLs, addresses, names, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def norm_domain(c: Column) -> Column:
    """Host of a URL or domain: lower case, no scheme, path or leading www."""
    c = F.regexp_replace(F.trim(F.lower(c)), "/+$", "")
    c = F.regexp_replace(c, "^.*//", "")
    return F.regexp_replace(F.regexp_replace(c, "/.*$", ""), r"^www\.", "")


def url_host(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^[a-z]+://(?:www\.)?([^/?#]+)", 1)


def slugify(c: Column) -> Column:
    return F.replace(norm_domain(c), F.lit("."), F.lit("-"))


def root_domain(c: Column) -> Column:
    """Last two labels of what follows @ and precedes a colon; three under a country's com, net, org, co, gov, med."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), "^[^@]*@", ""), ":.*$", ""), r"^www\.", "")

    def last(parts: Column) -> Column:
        n = F.size(parts)
        two = F.concat_ws(".", F.get(parts, n - 2), F.get(parts, n - 1))
        deep = (n >= 3) & F.get(parts, n - 2).isin(*K.SECOND_LEVEL) & (F.length(F.get(parts, n - 1)) == 2)
        return F.when(n < 2, F.concat_ws(".", parts)).when(deep, F.concat_ws(".", F.get(parts, n - 3), two)).otherwise(two)

    return _let(F.filter(F.split(c, r"\."), lambda x: x != ""), last)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def on_domain(email: Column, domain: Column) -> Column:
    """Whether an address is on the domain, its other endings, or its stem without a group word.

    Both roots are computed once; an ending is compared as what follows the first label.
    """

    def test(x: Column) -> Column:
        e, d = x["e"], x["d"]
        first, rest, base = F.substring_index(e, ".", 1), F.regexp_replace(e, r"^[^.]*", ""), F.substring_index(d, ".", 1)
        hit = (e == d) | ((first == base) & rest.isin(*K.VARIANT_TLDS))
        for s in K.GROUP_SUFFIXES:
            hit = hit | (base.endswith(s) & (F.length(base) > len(s) + 2) & (F.concat(first, F.lit(s)) == base) & rest.isin(*K.GROUP_TLDS))
        return hit

    return _let(F.struct(root_domain(email).alias("e"), root_domain(domain).alias("d")), test)


def deobfuscate(c: Column) -> Column:
    for code, char in (("%40", "@"), ("%2[eE]", ".")):
        c = F.regexp_replace(c, code, char)
    for entity, char in (("&#64;", "@"), ("&#x40;", "@"), ("&commat;", "@"), ("&#46;", "."), ("&#x2e;", "."), ("&period;", ".")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(c, r"\s*[\[({]\s*[aA][tT]\s*[\])}]\s*", "@")
    return F.regexp_replace(c, r"\s*[\[({]\s*[dD][oO][tT]\s*[\])}]\s*", ".")


def profile_url(c: Column) -> Column:
    """https://www.linkedin.com/in/<slug> in lower case, or null."""
    slug = F.regexp_extract(F.lower(F.try_url_decode(c)), r"^(?:https?://)?(?:[a-z0-9-]+\.)*linkedin\.com/in/([^/?#\s]+)", 1)
    return F.when(slug != "", F.concat(F.lit("https://www.linkedin.com/in/"), slug))


def company_key(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", ""), F.lit(""))


def age_days(c: Column) -> Column:
    """Days in texts such as 3d, 2w, 5mo, 1yr; hours and less are 0."""
    n, unit = F.regexp_extract(c, r"(\d+)\s*(mo|yr|y|w|d|h|m|s)", 1), F.regexp_extract(c, r"(\d+)\s*(mo|yr|y|w|d|h|m|s)", 2)
    k = F.when(unit == "mo", 30).when(unit.isin("yr", "y"), 365).when(unit == "w", 7).when(unit == "d", 1).otherwise(0)
    return F.when(n != "", n.cast("int") * k)


def short_name(c: Column) -> Column:
    """Before a dash, without a legal form, 40 characters at most, cut between words."""
    c = F.trim(F.regexp_replace(c, r"\s+[-–—|]\s.*$", ""))
    c = F.trim(F.regexp_replace(c, r"(?i)[\s,]+(llc|fze|co|group)\.?$", ""))
    return F.when(F.char_length(c) <= 40, c).otherwise(F.regexp_replace(F.substring(c, 1, 41), r"\s+\S*$", ""))


def review_number(token: Column) -> Column:
    """Digits, or groups of three behind separators; a decimal number is 0."""
    plain = token.rlike(r"^\d+$")
    grouped = token.rlike(r"^\d{1,3}([.,]\d{3})+$")
    return F.when(plain, token.cast("long")).when(grouped, F.regexp_replace(token, "[.,]", "").cast("long")).otherwise(F.lit(0).cast("long"))


def visible_text(c: Column) -> Column:
    """Lower-case text without scripts, styles and tags."""
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")))


def phone_digits(c: Column, code: Column) -> Column:
    """International digits, 9 to 15 of them, or null."""
    d = F.regexp_replace(c, "[^0-9]", "")
    full = F.when(c.startswith("+"), d).otherwise(F.concat(code, F.ltrim(d, F.lit("0"))))
    return F.when(F.length(full).between(9, 15), full)


def usable_domain(url: Column) -> Column:
    """The host of a website as written, without scheme, www, path and query; null without a dot, with a space, or of an aggregator."""
    host = F.trim(F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), r"^(https?://)?(www\.)?", ""), r"[/?].*$", "")))
    bad = ~F.contains(host, F.lit(".")) | F.contains(host, F.lit(" "))
    for a in K.AGGREGATORS:
        bad = bad | F.contains(host, F.lit(a))
    return F.when(~bad, host)


def company_keys(domain: Column, name: Column) -> Column:
    """What a company answers to: its domain and its name as keys, without repeats and nulls."""
    return F.array_distinct(F.array_compact(F.array(company_key(domain), company_key(name))))


def country_name(code: Column) -> Column:
    """The country in words; a code that is not known stays."""
    names = F.create_map(*[F.lit(x) for pair in K.COUNTRY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.upper(code)), code)


def first_number(text: Column, pattern: str) -> Column:
    """Group 1 of the pattern, with thousands behind commas, as a number; null if there is none."""
    return F.nullif(F.replace(F.regexp_extract(F.lower(text), pattern, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("long")


def headcount(text: Column) -> Column:
    """The lower bound in texts such as 11-50 employees; 0 is none."""
    return F.nullif(first_number(text, r"([0-9,]+)\s*(?:-|–|to)?\s*[0-9,]*\s*employees"), F.lit(0))


def degree(text: Column) -> Column:
    return first_number(text, r"(?:^|[^a-z0-9_])([123])(?:st|nd|rd)(?:[^a-z0-9_]|$)")


def mutual_count(text: Column) -> Column:
    return first_number(text, r"([0-9,]+)\s+(?:other\s+)?mutual")


_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿčďěňřšťůžąćęłńśźżőű", "aaaaaaceeeeiiiinooooouuuuyycdenrstuzacelnszzou"


def name_tokens(text: Column) -> Column:
    """Words of a name: lower case, without accents and apostrophes, split at all else."""
    plain = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    plain = F.regexp_replace(F.translate(plain, "'‘’ʼ", ""), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def names_person(label: Column, name: Column) -> Column:
    """Whether all words of two letters or more of the name stand in the label; never for an empty name."""
    want = F.filter(name_tokens(name), lambda w: F.length(w) > 1)
    return F.coalesce((F.size(want) > 0) & (F.size(F.array_except(want, name_tokens(label))) == 0), F.lit(False))


def run_base(slug: Column) -> Column:
    """A run's name without its date and number."""
    return F.regexp_replace(F.regexp_replace(slug, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}-", ""), r"-[0-9]+$", "")
