"""Phone numbers by rules of countries, found by their longest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import constants as K


def mobile_rules(spark: SparkSession) -> DataFrame:
    """(country, code, prefix, digits) of the countries in PHONE_CODES: a mobile number begins with code and prefix and has so many digits."""
    rows = [(c, K.PHONE_CODES[c], p, n) for c, some in K.MOBILE_RULES.items() for p, n in some]
    return spark.createDataFrame(rows, "country string, code string, prefix string, digits int")


def mobile_numbers(phones: DataFrame, rules: DataFrame, longest: int = 6) -> DataFrame:
    """phones (id, raw, country) with phone, found_country, rule and reason: the number in international digits if it is a mobile one.

    Without the country's code in front, the code takes the place of leading zeros; 9 to 15 digits are needed. In a country with
    rules, a rule's prefix has to lead and its length has to hold, the longest such prefix is the rule; in another one
    any number passes. Without a country, numbers in international form (+ or 00) get that of the longest prefix. Each number's prefixes,
    up to longest digits behind the code, meet the rules in one equi-join, so rules can be many. reason: no digits, length,
    no country, not mobile, or null for a good number. Rows keep their id, also a repeated one.
    """
    codes = rules.groupBy("country").agg(F.max("code").alias("code"))
    p = phones.withColumn("row", F.monotonically_increasing_id()).join(codes, "country", "left")
    digits = F.regexp_replace(F.coalesce("raw", F.lit("")), "[^0-9]", "")
    abroad = F.trim("raw").startswith("+") | digits.startswith("00")
    bare = F.regexp_replace(digits, "^00", "")
    home = F.when(F.col("code").isNull() | digits.startswith(F.col("code")), digits).otherwise(F.concat("code", F.ltrim(digits, F.lit("0"))))
    p = p.withColumns({"full": F.when(digits == "", "").when(F.col("country").isNull(), F.when(abroad, bare)).otherwise(home), "has_rules": F.col("code").isNotNull()})
    fits = F.length("full").between(9, 15)
    longest += 4  # a country's code has up to three digits, and one more in front of some
    prefixes = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.substring(F.col("full"), F.lit(1), k))
    r = rules.select(F.col("country").alias("of"), F.concat("code", "prefix").alias("lead"), F.col("digits").alias("size"))
    met = p.where(fits).select("row", "country", F.length("full").alias("size"), F.explode(F.array_distinct(prefixes)).alias("lead")).join(r, ["lead", "size"])
    met = met.where(F.col("country").isNull() | (F.col("country") == F.col("of"))).groupBy("row").agg(F.max_by(F.struct("of", "lead"), F.struct(F.length("lead"), "of")).alias("b"))
    p = p.join(met, "row", "left")
    reason = (
        F.when(F.col("full") == "", "no digits").when(F.col("full").isNull(), "no country").when(~fits, "length")
        .when(F.col("b").isNull() & F.col("country").isNull(), "no country").when(F.col("b").isNull() & F.col("has_rules"), "not mobile")
    )
    p = p.withColumn("reason", reason)
    return p.select(*phones.columns, F.when(F.col("reason").isNull(), F.col("full")).alias("phone"), F.coalesce("b.of", "country").alias("found_country"), F.col("b.lead").alias("rule"), "reason")
