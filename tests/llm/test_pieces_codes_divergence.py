"""Piece encoding against its library, vector codes and divergence against brute force, odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from leadloom.llm import divergence as D
from leadloom.llm import pieces as P
from leadloom.llm.codes import vector_codes, walk
from leadloom.llm.divergence import frequent_terms, source_divergence
from leadloom.llm.pieces import PieceModel, decode_pieces, default_pieces, encode_pieces, merged
from leadloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def coder():
    return PieceModel(default_pieces())


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<i4").tolist()


def test_pieces_equal_the_library(coder, monkeypatch):
    rng = random.Random(4)
    letters = ["aet in ▁\n\t\r0Aé日́😀<s>x_門aaaa eeee the  ", "ab ", "▁ ", "theinanonре ", "日本語😀é"]
    texts = ["".join(rng.choice(a) for _ in range(rng.choice((0, 1, 2, 7, 30, 120)))) for a in letters for _ in range(600)]
    texts += ["a" * 5000, " " * 5000 + "x", "ab" * 4000, "日本" * 3000, "<0x41></s>\0﻿", "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    for scan, scans in ((1024, 8), (16, 2)):  # short scans: positions are scanned again after going back
        monkeypatch.setattr(P, "SCAN", scan)
        monkeypatch.setattr(P, "SCANS", scans)
        coder.known.clear()
        for t in texts:
            assert ids(coder.encode(t)) == coder.library.encode(t, add_eos=True), t[:80]
    assert ids(coder.encode(None)) == [coder.library.eos_id()]


def test_pieces_forget_and_stay_right(coder, monkeypatch):
    monkeypatch.setattr(P, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(P, "CACHE_PAIRS", 5)
    coder.pairs.clear()
    for t in ("one two three four five six", "seven eight nine ten eleven"):
        assert ids(coder.encode(t)) == coder.library.encode(t, add_eos=True)
    assert len(coder.known) <= 3 and len(coder.pairs) <= 5
    assert merged("abc", {"ab": -1.0, "bc": -2.0}) == ["ab", "c"] and merged("aaa", {"aa": -1.0}) == ["aa", "a"]


def test_op11_rows(spark, sf, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        i = coder.library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(i), sha(" ".join(map(str, i))), sha(coder.library.decode(i)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_pieces"](spark, sf).collect()}
    assert got == want


def test_pieces_odd_rows(spark, odd, make):
    coded = decode_pieces(encode_pieces(odd.withColumnRenamed("lid", "decoded").withColumnRenamed("size", "ids")), "ids_")
    assert coded.columns[-2:] == ["ids_", "decoded_"]
    rows = coded.collect()
    assert len(rows) == odd.count() and all((r.text or "") == r.decoded_ for r in rows)
    assert decode_pieces(encode_pieces(make([]))).collect() == []


def brute_codes(vectors, parts=16, entries=64, rounds=2):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], object)
    w = x.shape[1] // parts
    books = [[list(r[p * w : (p + 1) * w]) for r in x[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for r in x:
                of[near(r[p * w : (p + 1) * w], books[p])[1]].append(r[p * w : (p + 1) * w])
            for k, members in of.items():
                books[p][k] = [sum(m[i] for m in members) // len(members) for i in range(w)]
    out = [[near(r[p * w : (p + 1) * w], books[p]) for p in range(parts)] for r in x]
    return [[k for _, k in o] for o in out], [sum(d for d, _ in o) for o in out], books


VEC = "vec_id long, embedding array<double>, label int, row string, code string"


@pytest.mark.parametrize("scale", [0.7, 2.0**40])
def test_codes_brute_force(spark, scale):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(150, 32)) * 3) * scale / 3
    v[40:60] = v[40]
    rows = [(i, x.tolist(), i % 3, "r", "c") for i, x in enumerate(v)]
    coded, books = vector_codes(spark.createDataFrame(rows, VEC).repartition(4))
    code, error, want = brute_codes(v.tolist())
    got = {r.vec_id: (r.code, int(r.error)) for r in coded.collect()}
    assert got == {i: (code[i], error[i]) for i in range(len(v))}
    assert [b.tolist() for b in books] == want


def test_walk_is_nearest_in_blocks(monkeypatch):
    from leadloom.llm import codes

    monkeypatch.setattr(codes, "BLOCK", 3)
    rng = np.random.default_rng(5)
    for d in (1, 2, 5):
        x = np.unique(rng.integers(-3, 4, (300, d)), axis=0)
        e = rng.integers(-3, 4, (9, d))
        far = ((x[:, None] - e[None]) ** 2).sum(2)
        code, distance = walk(x, e)
        assert (code == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), 0.5] * 16, None, "r", "c") for i in range(5)]
    bad = [(9, None, 1, "", ""), (10, [nan] + [0.0] * 31, 1, "", ""), (11, [-inf] + [0.0] * 31, 1, "", ""), (12, [None] + [0.0] * 31, 1, "", ""), (13, [1.0], 1, "", ""), (14, [1e300] * 32, 1, "", "")]
    coded, books = vector_codes(spark.createDataFrame([*good, *bad, good[0], (None, [7.0] * 32, 2, "", "")], VEC))
    got = coded.collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got) == [(False, 0), (False, 0), (False, 1), (False, 2), (False, 3), (False, 4), (True, None)]
    assert all(r.error == 0 for r in got) and len(books[0]) == 7
    for rows in ([], bad[:4]):
        coded, books = vector_codes(spark.createDataFrame(rows, VEC))
        assert coded.collect() == [] and books == []
    # a length that is no multiple gets zeros behind; empty vectors have one code
    assert [r.error for r in vector_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "", ""), (2, [1.0, 2.0, 4.0], 1, "", "")], VEC))[0].collect()] == [0, 0]
    assert [r.code for r in vector_codes(spark.createDataFrame([(1, [], 1, "", "")], VEC))[0].collect()] == [[0] * 16]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least=3, top=200):
    docs = [(r[1] or "", r[2] or "", Counter(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[0] or "")))) for r in rows]
    df, n, lang_n, groups = Counter(), defaultdict(Counter), defaultdict(Counter), sorted({d[:2] for d in docs})
    for lang, source, terms in docs:
        for t, k in terms.items():
            df[lang, t] += 1
            n[lang, source][t] += k
            lang_n[lang][t] += k
    kept = {lang: {t for (x, t), k in df.items() if x == lang and k >= least} for lang in {g[0] for g in groups}}

    def p(counts, lang):
        total, v = sum(counts[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + int(Fraction(10**9 * (counts[t] + 1), total + v)) for t in kept[lang]}

    out = set()
    for lang, source in groups:
        mine, q = p(n[lang, source], lang), p(lang_n[lang], lang)
        pairs = [(o, sum((mine[t] - y) ** 2 // y for t, y in p(n[lang, o], lang).items())) for x, o in groups if x == lang and o != source]
        terms = [(t, (mine[t] - q[t]) ** 2 // q[t]) for t in kept[lang] if n[lang, source][t] and mine[t] > q[t]]
        for part, some in (("pair", pairs), ("term", terms)):
            order = sorted(some, key=lambda y: (-y[1], y[0].encode()))
            out |= {(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(order) if part == "pair" or k < top}
    return out


TEXTS = "text string, lang string, source string, term string, n string, whole string"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TEXTS).repartition(3)


def test_divergence_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefghij", "Éa", "éé", "日本語", "x" * 70, "x" * 69 + "y", "zzzzzzzzq", "zzzzzzzzr"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = [("1 ".join(rng.choices(words, k=rng.randrange(25))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None, "É"])) for _ in range(120)]
    rows += [("", "de", "s1"), (None, "de", "s2"), ("only once", "xx", "s"), (None, None, None)] + [rows[0]] * 3
    for small in (False, True):
        if small:  # a filter that names nearly all, counts handed on at once, blocks of few terms
            monkeypatch.setattr(D, "FILTER_BITS", 64)
            monkeypatch.setattr(D, "TASK_COUNTS", 5)
            monkeypatch.setattr(D, "BLOCK_CELLS", 8)
            monkeypatch.setattr(D, "BLOCK_ROWS", 4)
        got = [tuple(r) for r in source_divergence(table_of(spark, rows)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows)
    assert {r for r in map(tuple, source_divergence(table_of(spark, rows), top=2).collect())} == brute_divergence(rows, top=2)


def test_divergence_odd_rows(spark):
    assert source_divergence(table_of(spark, [])).collect() == []
    rows = [(None, None, None), ("", None, "a"), ("one two", None, "a")]
    assert {tuple(r) for r in source_divergence(table_of(spark, rows)).collect()} == brute_divergence(rows) == {("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)}
    long = [("é" * 30_000, "l", s) for s in "abca"]
    kept, groups = frequent_terms(table_of(spark, long))
    assert {(r.source, r.n) for r in kept.collect()} == {("a", 2), ("b", 1), ("c", 1)} and groups.count() == 3


def test_divergence_terms_are_packed(spark, sf, monkeypatch):
    """The documents' terms are the largest table that op13 keeps on disk; they take under half the bytes of the terms in plain form."""
    import pyarrow.parquet as pq

    kept, kept_as = {}, D.stored
    monkeypatch.setattr(D, "stored", lambda df, tag, **options: kept.update({tag: kept_as(df, tag, **options)}) or kept[tag])
    frequent_terms(spark.read.parquet(f"{sf}/documents.parquet"))
    files = [f.removeprefix("file://") for f in kept["divergence-terms"].inputFiles()]
    columns = [g.column(c) for f in files for m in [pq.ParquetFile(f).metadata] for r in range(m.num_row_groups) for g in [m.row_group(r)] for c in range(g.num_columns)]
    assert {c.compression for c in columns} == {"ZSTD"}
    assert sum(c.total_compressed_size for c in columns) < 0.5 * sum(c.total_uncompressed_size for c in columns)


def test_divergence_batches_are_small(spark, monkeypatch):
    """Every job that hands blocks to Python runs with Arrow batches of BATCH_BYTES; the session's own setting is back after it."""
    name, seen, counts = "spark.sql.execution.arrow.maxBytesPerBatch", [], D._counts
    monkeypatch.setattr(D, "_counts", lambda *a: seen.append(int(spark.conf.get(name))) or counts(*a))
    monkeypatch.setattr(D, "BATCH_BYTES", 1)
    before, rows = spark.conf.get(name), [("one two two", "en", s) for s in "abca"]
    assert {tuple(r) for r in source_divergence(table_of(spark, rows)).collect()} == brute_divergence(rows)
    assert len(seen) >= 2 and set(seen) == {1} and spark.conf.get(name) == before


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r) for r in df.select(*order).collect()) == sorted(want.select(*order).fetchall())
