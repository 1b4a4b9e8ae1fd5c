"""Character references of HTML, decoded as column expressions."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _names() -> tuple[str, str, str]:
    """The standard's names with a semicolon as a JSON map, the most used of them, and those that need none as one pattern, longest first."""
    closed = {k: v for k, v in html5.items() if k.endswith(";")}
    open_ = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    common = {k: closed[k] for k in ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;")}
    return json.dumps(closed), json.dumps(common), "^(" + "|".join(open_) + ")"


def _windows(n: int) -> int:
    """What browsers read a number from 128 to 159 as: the Windows character of that byte, where there is one."""
    try:
        return ord(bytes([n]).decode("cp1252"))
    except UnicodeDecodeError:
        return n


def _character(n: Column) -> Column:
    old = F.array(*[F.lit(_windows(i)) for i in range(128, 160)])
    n = F.when(n.between(128, 159), F.get(old, (n - 128).cast("int")).cast("long")).otherwise(n)
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF) | n.isNull()
    return F.when(bad, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(~bad, n)), 8, "0")), "UTF-32"))


def _piece(p: Column) -> Column:
    """What follows an ampersand, with the reference that leads it decoded; without one, the ampersand again."""
    names, common, open_ = _names()
    table = lambda text: F.from_json(F.lit(text), "map<string,string>")
    ten, six = F.regexp_extract(p, r"^#([0-9]+);?", 1), F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]+);?", 1)
    closed, legacy = F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*;)", 1), F.regexp_extract(p, open_, 1)
    rest = lambda pattern: F.regexp_replace(p, pattern, "")
    of = F.coalesce(F.try_element_at(table(common), closed), F.when(closed != "", F.try_element_at(table(names), closed)))
    number = F.when(F.length(F.ltrim(ten, F.lit("0"))) > 9, F.lit(1 << 40)).otherwise(F.nullif(ten, F.lit("")).cast("long"))
    sixteen = F.when(F.length(F.ltrim(six, F.lit("0"))) > 9, F.lit(1 << 40)).otherwise(F.conv(F.nullif(six, F.lit("")), 16, 10).cast("long"))
    return (
        F.when(ten != "", F.concat(_character(number), rest("^#[0-9]+;?"))).when(six != "", F.concat(_character(sixteen), rest("^#[xX][0-9a-fA-F]+;?")))
        .when(of.isNotNull(), F.concat(of, rest("^[A-Za-z0-9]+;")))
        .when(legacy != "", F.concat(F.try_element_at(table(json.dumps({k: v for k, v in html5.items() if not k.endswith(";")})), legacy), rest(open_)))
        .otherwise(F.concat(F.lit("&"), p))
    )


def unescape(text: Column) -> Column:
    """text with its character references decoded once: named ones of the HTML standard, and numbers, also without a semicolon
    where the standard allows it. Numbers that are no character become U+FFFD; other ampersands stay."""
    parts = F.split(text, "&")
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), _piece), "")))
