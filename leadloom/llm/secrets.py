"""Secret scans: base patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("assign", "access", "hex", "random")
_KEY = "".join(f"[{c.upper()}{c}]" for c in "password") + "|" + "|".join("".join(f"[{c.upper()}{c}]" for c in k) for k in ("passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Failing matches of these two can't hide passing ones, so the length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
#: What the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
#: Bound of the fitting sample: documents, those with the smallest seeded hashes.
SAMPLE_ROWS = 4000
#: A stretch of a candidate is a secret if its log-likelihood ratio is above this in all, and above 0.5 a character.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.5
_FIRST, _CODES = ord("+"), ord("z") - ord("+") + 1


def matches(text: Column, pattern: str, kind: int, passes=None, strings: bool = False) -> Column:
    """Leftmost non-overlapping matches as an array of (start, kind, end), in code points; strings adds the match as s.

    Starts are summed from the lengths of what stands between matches, so the text is split only where one is.
    """
    none = F.array().cast(f"array<struct<start:int,kind:int,end:int{',s:string' if strings else ''}>>")

    def spans(m, gaps):
        zero = F.struct(F.lit(0).alias("at"), none.alias("found"))
        both = F.arrays_zip(m.alias("m"), gaps.alias("g"))
        both = F.filter(both, lambda x: x["m"].isNotNull())

        def step(a, x):
            start = a["at"] + F.char_length(x["g"])
            end = start + F.char_length(x["m"])
            one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *([x["m"].alias("s")] if strings else []))
            ok = F.lit(True) if passes is None else passes(x["m"])
            return F.struct(end.alias("at"), F.when(ok, F.concat(a["found"], F.array(one))).otherwise(a["found"]).alias("found"))

        return F.aggregate(both, zero, step, lambda a: a["found"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(spans(m, F.split(text, pattern, -1))))


def base_spans(text: Column) -> Column:
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE
    return F.concat(matches(text, ASSIGN, 0, value), matches(text, ACCESS, 1), matches(text, HEX, 2))


def log_ratios(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[float]:
    """log P(next | character) of random strings over that of ordinary identifiers, by pairs of codes.

    Labelled samples, from at most rows documents: random are the values that the base patterns find and a
    digest of each doc_id as hex and as base64; ordinary are the other words, as written and in capitals.
    """
    # doc_id repeats in few rows, so what is broadcast is bounded by rows
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    digest = F.sha2(F.concat(F.lit("sample "), F.col("doc_id").cast("string")), 256)
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    plain = F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))
    strings = text.select(F.explode(F.array(
        F.struct(F.lit(1).alias("y"), F.concat(F.filter(values, lambda v: F.char_length(v) >= ASSIGN_VALUE), F.array(digest, F.base64(F.unhex(digest)))).alias("s")),
        F.struct(F.lit(0).alias("y"), F.concat(plain, F.transform(plain, F.upper)).alias("s")),
    )).alias("x")).select("x.y", F.explode("x.s").alias("s"))
    pairs = strings.select("y", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("s") - 1, F.lit(1))), lambda i: F.substring("s", i, 2))).alias("pair"))
    counts: dict[tuple[int, int, int], int] = {}
    for r in pairs.where("length(pair) = 2").groupBy("y", "pair").count().collect():  # at most 2 * 80 * 80 rows
        a, b = (ord(c) - _FIRST for c in r.pair)
        if 0 <= a < _CODES and 0 <= b < _CODES:
            counts[r.y, a, b] = r["count"]
    alphabet = [ord(c) - _FIRST for c in "+/=_-" + "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))]
    out = [0.0] * (_CODES * _CODES)
    for a in alphabet:
        sums = [sum(counts.get((y, a, b), 0) for b in alphabet) for y in (0, 1)]
        for b in alphabet:
            p = [(counts.get((y, a, b), 0) + 0.5) / (sums[y] + 0.5 * len(alphabet)) for y in (0, 1)]
            out[a * _CODES + b] = round(math.log(p[1] / p[0]), 4)
    return out


def pair_ratios(string: Column, ratios: list[float]) -> Column:
    """The ratio of each two neighbouring characters; the table is a literal, so each look-up is by place."""
    lookup = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(string, ""), lambda c: F.ascii(c) - _FIRST)
    return let(codes, lambda c: F.transform(
        F.when(F.size(c) > 1, F.sequence(F.lit(0), F.size(c) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(F.get(lookup, F.get(c, i) * _CODES + F.get(c, i + 1)), F.lit(0.0))
    ))


def stretches(r: Column) -> Column:
    """(first, last) of the places of r with the highest sums; one ends where the sum is used up or LEAST_RATIO below its top."""
    none = F.array().cast("array<struct<first:int,last:int>>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("begin"), F.lit(0.0).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("last"), none.alias("found"))

    def ended(a):
        secret = (a["best"] > LEAST_RATIO) & (a["best"] > LEAST_MEAN * (a["last"] - a["first"] + 1))
        return F.when(secret, F.concat(a["found"], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last"))))).otherwise(a["found"])

    def step(a, x):
        total = a["sum"] + x
        begin = F.when(a["sum"] == 0, a["i"]).otherwise(a["begin"])
        top = total > a["best"]
        best = F.greatest(total, a["best"])
        end = (total <= 0) | (best - total >= LEAST_RATIO)
        after = {"i": a["i"] + 1, "sum": F.when(end, 0.0).otherwise(total), "begin": begin, "best": F.when(end, 0.0).otherwise(best)}
        after |= {"first": F.when(top, begin).otherwise(a["first"]), "last": F.when(top, a["i"]).otherwise(a["last"]), "found": F.when(end, ended(a)).otherwise(a["found"])}
        return F.struct(*[v.alias(k) for k, v in after.items()])

    some = F.aggregate(r, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0))) > LEAST_RATIO
    return F.when(some, F.aggregate(r, zero, step, ended)).otherwise(none)


def random_spans(string: Column, start: Column, ratios: list[float]) -> Column:
    """Spans of the random stretches of a string at start, in whole parts between / = _ and -.

    A stretch is widened to both ends of the parts it lies in; a first or last part goes if under half of it is random.
    """

    def span(x):
        first, end = x["first"], x["last"] + 2
        inside = F.substring(string, first + 1, end - first)
        lead, tail = (F.char_length(F.regexp_extract(inside, p, 0)) for p in ("^[^/=_-]*", "[^/=_-]*$"))
        back = F.char_length(F.regexp_extract(F.substring(string, F.lit(1), first), "[^/=_-]*$", 0))
        on = F.char_length(F.regexp_extract(F.substring(string, end + 1, F.char_length(string)), "^[^/=_-]*(={1,2}$)?", 0))
        crosses = lead < F.char_length(inside)
        begin = F.when(crosses & (lead < back), first + lead + 1).otherwise(first - back)
        finish = F.when(crosses & (tail < on), end - tail - 1).otherwise(end + on)
        return F.struct((start + begin).alias("start"), F.lit(3).alias("kind"), (start + finish).alias("end"))

    spans = F.transform(let(pair_ratios(string, ratios), stretches), span)
    return F.array_distinct(F.filter(spans, lambda x: x["start"] < x["end"]))


def outside(runs: Column, base: Column) -> Column:
    """The parts (start, s) of the runs (start, end, s) that no base span covers."""

    def cut(m):
        part = lambda begin, end: F.struct(begin.alias("start"), F.substring(m["s"], begin - m["start"] + 1, end - begin).alias("s"))
        zero = F.struct(m["start"].alias("at"), F.array().cast("array<struct<start:int,s:string>>").alias("parts"))
        hits = F.sort_array(F.filter(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

        def step(a, b):
            parts = F.when(b["start"] > a["at"], F.concat(a["parts"], F.array(part(a["at"], b["start"])))).otherwise(a["parts"])
            return F.struct(F.greatest(a["at"], b["end"]).alias("at"), parts.alias("parts"))

        return F.aggregate(hits, zero, step, lambda a: F.when(a["at"] < m["end"], F.concat(a["parts"], F.array(part(a["at"], m["end"])))).otherwise(a["parts"]))

    return F.flatten(F.transform(runs, cut))


def find_secrets(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, found) for each row of docs (doc_id, text): found has the spans (start, kind, end) in order.

    Base spans all stay; the Markov models judge what of a candidate is outside them. Null text: empty.
    """
    ratios = log_ratios(docs, rows)
    text = F.col("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("base", base_spans(text)).withColumn("runs", matches(text, CANDIDATE, 3, strings=True))
    more = let(F.struct("runs", "base"), lambda x: F.flatten(F.transform(outside(x["runs"], x["base"]), lambda m: random_spans(m["s"], m["start"], ratios))))
    return d.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", more)).alias("found"))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs (doc_id, text).

    Null and empty texts have no spans; repeated rows are scanned alike; further columns are ignored; an
    empty table gives no rows. The whole text counts; all work but the counts of pairs is column expressions.
    """
    found = find_secrets(docs, rows)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))
