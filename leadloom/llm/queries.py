"""The registered queries of the training-data operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from .codes import vector_codes
from .common import stored, table
from .divergence import source_divergence
from .extraction import extract_pages
from .lines import line_dedup
from .mixing import mix
from .packing import pack
from .pieces import decode_pieces, encode_pieces
from .quality import quality_scores
from .rules import quality_rules
from .secrets import secret_scan
from .simhash import simhash_groups
from .toxicity import toxicity_scores
from .vectors import vector_groups


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return line_dedup(docs, report=True)


def op2_extract(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op6_vectors(spark, sf_dir):
    return vector_groups(table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_pieces(spark, sf_dir):
    coded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256")
    )


def op12_codes(spark, sf_dir):
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    coded = stored(coded, "codes-coded")
    entries = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    error = F.col("error").try_cast("long")
    label = F.when(F.count(error) == F.count("*"), F.sum("error").try_cast("long"))
    sums = coded.groupBy("label").agg(label.alias("label_error")).withColumnRenamed("label", "of")
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", code.alias("code"), error.alias("error"), "label_error", F.lit(entries).alias("codebooks_sha256"))


def op13_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_extract, op3_mix, op4_simhash, op5_pack, op6_vectors, op7_quality_rules, op8_secrets, op9_toxicity, op10_quality, op11_pieces, op12_codes, op13_divergence)
}
def _codes_sql(rounds: int = 2) -> str:
    """Product codes by definition: every part against every entry, in each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"far{r} as (select a.rn, a.pos, b.entry, sum((a.v - b.v) * (a.v - b.v)) as d from part a join book{r} b using (pos, dim) group by all)")
        steps.append(f"near{r} as (select rn, pos, min(struct_pack(d := d, e := entry)) as m from far{r} group by all)")
        if r < rounds:
            steps.append(f"mean{r} as (select pos, m.e as entry, dim, sum(v) as s, count(*) as n from near{r} join part using (rn, pos) group by all)")
            steps.append(f"book{r + 1} as (select b.pos, b.entry, b.dim, cast(coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.v) as bigint) as v from book{r} b left join mean{r} m using (pos, entry, dim))")
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x, row_number() over (order by vec_id) as rn
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as (select rn, i // (len(x) // 16) as pos, i % (len(x) // 16) as dim, x[i + 1] as v from (select rn, x, unnest(range(len(x))) as i from kept)),
book0 as (select pos, rn - 1 as entry, dim, v from part where rn <= 64),
{", ".join(steps)},
coded as (select rn, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' order by pos) as code, cast(sum(m.d) as bigint) as error from near{rounds} group by rn)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(v as varchar), ',' order by pos, entry, dim)) from book{rounds}) as codebooks_sha256
from kept join coded using (rn)"""


_DIVERGENCE_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as nl from t group by all having count(distinct id) >= 3),
n as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
langs as (select lang, count(*) as v, sum(nl) as total from kept group by lang),
g as (select lang, source, coalesce((select sum(n) from n where n.lang = d.lang and n.source = d.source), 0) as total from (select distinct lang, source from d) d),
s as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 1)) // (g.total + l.v) as p, 1 + (1000000000::hugeint * (k.nl + 1)) // (l.total + l.v) as q
  from g join langs l using (lang) join kept k using (lang) left join n using (lang, source, term)),
pair as (
  select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
    on x.lang = a.lang and x.source = a.source and x.item = b.source),
both_parts as (
  select lang, source, 'pair' as part, item, cast(value as bigint) as value from pair
  union all select lang, source, 'term', term, cast(((p - q) * (p - q)) // q as bigint) from s where n > 0 and p > q)
select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from both_parts) where part = 'pair' or rank <= 200"""

#: Encoding by a given vocabulary is beyond SQL, as the learnt operators are; tests/llm holds it against the library itself.
ORACLE_SQL: dict[str, str] = {"op12_codes": _codes_sql(), "op13_divergence": _DIVERGENCE_SQL}
