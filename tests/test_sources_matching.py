"""File sources, stored ledgers, counters, and the matching operators against brute force and in their plans."""

from __future__ import annotations

import html
import random

import numpy as np
from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.references import unescape
from leadloom.operators import candidates as C
from leadloom.operators import lifecycle as L
from leadloom.operators import listings, minhash, phones, search
from leadloom.operators import neardup as N
from leadloom.plans import record_queries as R
from leadloom.sources import files, ledgers
from leadloom.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def above_scan(text: str, name: str) -> str:
    """The operators from a plan's root down to the scan of name, one a line."""
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    lines = text.splitlines()
    at = next(i for i, x in enumerate(lines) if name in x)
    out, level = [lines[at]], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            out, level = [x, *out], depth(x)
    return "\n".join(out)


def test_lines_are_numbered_by_file_in_any_splits(spark, tmp_path):
    want = []
    for name, n in (("b.txt", 400), ("a.txt", 3), ("c/d.txt", 57), ("e.txt", 0)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        lines = [f"{name} {i} " + "x" * (i % 50) for i in range(1, n + 1)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        want += [(name, i + 1, x) for i, x in enumerate(lines)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = files.scan_lines(spark, str(tmp_path)).collect()
            name = lambda r: r.file.split(tmp_path.name + "/")[1]
            assert sorted((name(r), r.line_no, r.line) for r in got) == sorted(want)
            ordered = [(name(r), r.line_no) for r in sorted(got, key=lambda r: r.seq)]
            assert ordered == sorted(ordered)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_candidate_result_and_page_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "candidates-2.txt").write_text("# x\nb.com|B|ES|hotel|7\n\nshort|x\n")
    (tmp_path / "c" / "candidates-1.txt").write_text("a.com| A |FR|clinic|n/a\n")
    (tmp_path / "c" / "other.log").write_text("z.com|Z|ES|hotel|1\n")
    got = files.scan_candidate_files(spark, str(tmp_path / "c"), "candidates-*.txt").orderBy("seq").collect()
    assert [(r.domain, r.name, r.branches, r.line_no) for r in got] == [("a.com", "A", 0, 1), ("b.com", "B", 7, 2)]
    (tmp_path / "r").mkdir()
    for i, text in enumerate(('{"lead_id": "1",\n "first_name": "old"}', '{"lead_id": "1", "first_name": "new"}', "{broken", '{"first_name": "nobody"}')):
        (tmp_path / "r" / f"out-{i}.json").write_text(text)
    results, audit = files.scan_result_files(spark, str(tmp_path / "r"))
    assert [(r.lead_id, r.first_name) for r in results.collect()] == [("1", "new")] and tuple(audit.first()) == (1, 1, 4)
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a").write_text('{"lead_id": "1", "first_name": "x"}\n{"lead_id": "2", "first_name": "y"}\n')
    (tmp_path / "l" / "b").write_text('{"lead_id": "1", "first_name": "z"}\n')
    assert sorted((r.lead_id, r.first_name) for r in files.scan_result_files(spark, str(tmp_path / "l"), whole=False)[0].collect()) == [("1", "z"), ("2", "y")]
    (tmp_path / "p").mkdir()
    for name, text in (("a.com__home.html", "<p>\nhome"), ("a.com__about-us.html", "x" * 20), ("readme.html", "no")):
        (tmp_path / "p" / name).write_text(text)
    assert sorted(map(tuple, files.scan_page_files(spark, str(tmp_path / "p"), 5).collect())) == [("a.com", "about-us", "x" * 20), ("a.com", "home", "<p>\nhome")]


def test_site_text_in_parts(spark):
    rows = [("a", s, i, f"{s}{i}") for i, s in enumerate("cabba")] + [("b", "x", 9, "")]
    got = files.site_text(spark.createDataFrame(rows, "domain string, slug string, page_id long, html string"), 1, 2).orderBy("part").collect()
    assert [(r.part, r.n_pages, r.slugs, r.text) for r in got] == [(0, 2, "a,a", "a1\na4"), (1, 2, "b,b", "b2\nb3"), (2, 1, "c", "c0")]


def test_stored_ledger_prunes_and_is_not_shuffled(spark):
    rows = [(f"k{i}", f"2024-{1 + i % 6:02d}-15" if i % 7 else None, "r1" if i % 5 == 0 else "r2", "x") for i in range(300)]
    led = spark.createDataFrame(rows, "domain string, entry_date string, run_id string, kind string").withColumn("entry_date", F.col("entry_date").cast("date"))
    ledgers.save_ledger(led, "ledger_test", "domain", mode="overwrite")
    for days in (40, None):
        window = ledgers.read_window(spark, "ledger_test", "r1", "2024-06-20", days)
        want = C.ledger_window(led, "r1", "2024-06-20", days)
        assert sorted(map(str, window.select("domain", "entry_date").collect())) == sorted(map(str, want.select("domain", "entry_date").collect()))
    found = plan(ledgers.read_window(spark, "ledger_test", "r1", "2024-06-20", 40))
    assert "PartitionFilters: [" in found and "month" in found.split("PartitionFilters: [")[1].split("]")[0]
    new = spark.createDataFrame([(f"k{i}", i) for i in range(290, 310)] + [("k305", 1), (None, 1), (None, 2)], "domain string, seq int")
    unseen = ledgers.unseen(new, spark.table("ledger_test"), "domain", [F.col("seq").alias("__o")])
    assert sorted((r.domain or "", r.seq) for r in unseen.collect()) == [("", 1), ("", 2)] + [(f"k{i}", 1 if i == 305 else i) for i in range(300, 310)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(ledgers.unseen(new, spark.table("ledger_test"), "domain", [F.col("seq").alias("__o")]))
        above = above_scan(text, "ledger_test")
        assert "SortMergeJoin" in above and "Exchange" not in above.split("SortMergeJoin")[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for _ in range(2):
        ledgers.append_unseen(new.where("domain is not null").withColumns({"entry_date": F.lit("2024-07-01").cast("date"), "run_id": F.lit("r3"), "kind": F.lit("x")}), "ledger_test", "domain", [F.col("seq").alias("__o")])
        spark.catalog.refreshTable("ledger_test")
        assert spark.table("ledger_test").where("run_id = 'r3'").count() == 10
    spark.sql("drop table ledger_test")


def test_counters_equal_the_audit_in_one_scan(spark, tmp_path):
    merged, seen = C.observed_merge(R._merged(spark, SF), X.ALLOWED, "test-merge")
    scans = plan(merged).count("Scan parquet") - plan(R._merged(spark, SF)).count("Scan parquet")
    merged.write.parquet(str(tmp_path / "m"))
    assert scans == 0
    back, n = spark.read.parquet(str(tmp_path / "m")), seen.get
    audit = {}
    for r in C.merge_audit(back).collect():
        audit[r.drop_reason] = audit.get(r.drop_reason, 0) + r.n
    assert {k: v for k, v in n.items() if k in audit} == audit and n["rows"] == back.count()
    warned = C.merge_warnings(back).first()
    assert (n["kept"], n["country"], n["sent"] + n["disqualified"] + n["sourced"]) == (warned.kept, warned.country, warned.stale)


def test_rolling_rates_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, f"2024-01-{rng.randint(1, 4):02d} 0{rng.randint(0, 9)}:00:00", rng.random() < 0.4) for i in range(80)]
    df = spark.createDataFrame(rows, "address string, event_id long, ts string, accepted boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r.address, r.event_id): (r["at"], r.rate) for r in L.rolling_rates(df, 7).collect()}
    for a in "ab":
        mine = sorted((t, i, y) for x, i, t, y in rows if x == a)
        for k, (_, i, _) in enumerate(mine):
            last = [y for _, _, y in mine[max(0, k - 6) : k + 1]]
            assert got[a, i] == (k + 1, round(sum(last) * 100 / 7, 4) if len(last) == 7 else None)


def test_references(spark):
    texts = ["a&amp;b", "&amp;lt;", "&lt;&gt;&quot;&apos;&#39;&#x27;", "&nbsp;x", "&copy 2020", "&copy;", "&notit;", "&notin;", "&eacute&eacute;", "&#128;&#x80;", "&#0;&#xD800;&#1114112;&#99999999999;"]
    texts += ["& &; &#; &#x; &unknown;", "&NotEqualTilde;", "&#128512;", "", "no", "&&amp;&", "&ampamp;", "&#0000065;B", "x&"]
    got = {r.t: r.u for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", unescape(F.col("t")).alias("u")).collect()}
    assert got == {t: html.unescape(t) for t in texts} | {None: None}


def test_listed_names(spark):
    pages = [(1, 1, "https://dir.example/1", "<LI><b>A &amp; <i>B</i>\n C</b> <a href='https://www.one.com/x'></LI><li><b>a & b c</b></li><li><b>D</b></li>"),
             (1, 2, "https://dir.example/2", "<li><b>Two</b><a href='http://one.com'></li><li><b>Own</b><a href='http://dir.example/z'></li><li><b>Agg</b><a href='https://m.booking.com/'></li><li><b>Skip</b><a href='https://skip.me/'></li>"), (2, 1, "u", None)]
    sources = [(1, "<li>.*?</li>", "<b>(.*?)</b>", "href='([^']*)'", ["skip.me"], "ES", "hotel", "x"), (2, None, "(x)", None, None, "ES", "hotel", "x")]
    got = listings.listed_names(
        spark.createDataFrame(pages, "source_id int, page int, url string, html string"), spark.createDataFrame(sources, "source_id int, row string, name string, link string, skip_hosts array<string>, country string, vertical string, city string")
    )
    assert sorted((r.page, r["at"], r.name, r.domain, r.kind) for r in got.collect()) == [
        (1, 0, "A & B C", "one.com", "candidate"), (2, 0, "Two", "one.com", "repeat"), (2, 1000, "Own", None, "unresolved"), (2, 2000, "Agg", None, "unresolved"), (2, 3000, "Skip", None, "unresolved"),
    ]


def by_rules(raw, country):
    digits = "".join(c for c in raw or "" if c.isdigit())
    code = K.PHONE_CODES.get(country, "")
    if not digits:
        return None
    full = digits if digits.startswith(code) else code + digits.lstrip("0")
    if not 9 <= len(full) <= 15:
        return None
    some = K.MOBILE_RULES.get(country)
    return full if not some or any(full[len(code) :].startswith(p) and len(full) == n for p, n in some) else None


def test_listings_of_a_title_cut_in_a_reference(spark, tmp_path):
    """What the query lists is the title's text as its SQL reads it, also where a reference has lost its end."""
    from leadloom.plans import match_queries as M

    titles = ["Ab &amp; Co", "Cd &amp", "Ef &quot;x&quot; &am", "Gh &lt; &amp;lt", "Ij&&amp;&amp"]
    rows = [(i * 3 + 1, f"https://www.s{i}.example/en/", f"<title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page: r.name for r in M.listings_by_pattern(spark, str(tmp_path)).collect()}
    want = [t.replace("&quot;", '"').replace("&amp;", "&") + (" é' x A" if i % 4 == 0 else "") for (i, _, _), t in zip(rows, titles)]
    assert [got[i] for i, _, _ in rows] == want


def test_mobile_numbers(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("0356789 +-") for _ in range(rng.randint(0, 14))), rng.choice([*K.PHONE_CODES, "GB"])) for i in range(400)]
    rows += [(1000 + i, f"{lead}{K.PHONE_CODES[c]}{p}{'5' * (n - len(K.PHONE_CODES[c]) - len(p))}", c) for i, (c, lead) in enumerate((c, s) for c in K.PHONE_CODES for s in ("+", "", "00")) for p, n in K.MOBILE_RULES[c]]
    df = spark.createDataFrame([*rows, (5000, None, "AE")], "id long, raw string, country string")
    got = sorted((r.id, r.raw or "", r.phone or "") for r in phones.mobile_numbers(df, phones.mobile_rules(spark)).collect())
    assert got == sorted((i, raw or "", by_rules(raw, c) or "") for i, raw, c in [*rows, (5000, None, "AE")])
    abroad = spark.createDataFrame([(1, "+971501234567"), (2, "0096181234567"), (3, "971501234567"), (4, "+49301234567"), (5, None)], "id long, raw string").withColumn("country", F.lit(None).cast("string"))
    found = {r.id: (r.phone, r.found_country, r.rule, r.reason) for r in phones.mobile_numbers(abroad, phones.mobile_rules(spark)).collect()}
    assert found == {1: ("971501234567", "AE", "9715", None), 2: ("96181234567", "LB", "96181", None), 3: (None, None, None, "no country"), 4: (None, None, None, "no country"), 5: (None, None, None, "no digits")}
    assert "NestedLoop" not in plan(phones.mobile_numbers(df, phones.mobile_rules(spark)))


def test_proposals_equal_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = [f"word{chr(97 + i)}" for i in range(12)] + ["clinic"]
    names = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 5)))) for i in range(40)] + [(99, None)]
    pages = [(i, rng.choice(["x.com", "worda.net", "facebook.com"]), f"<title>t</title><p>{' '.join(rng.choices(vocabulary, k=rng.randint(0, 8)))}</p><script>wordl worda</script>") for i in range(60)]
    got = search.propose_pages(spark.createDataFrame(names, "name_id long, name string"), spark.createDataFrame(pages, "page_id long, host string, html string"), 2, 5, "facebook").collect()
    want = set()
    for i, name in names:
        tokens = set((name or "").split()) - {"clinic"}
        hits = []
        for p, host, text in pages:
            shared = len(tokens & set(text.split("<p>")[1].split("</p>")[0].split() + host.split(".")))
            if len(tokens) >= 2 and shared >= 2 and host != "facebook.com":
                hits.append((-shared, p, host))
        want |= {(i, k + 1, p, host, -n) for k, (n, p, host) in enumerate(sorted(hits)[:5])}
    assert {(r.name_id, r.pos, r.page_id, r.host, r.shared) for r in got} == want


def test_minhash_recall_against_the_exact_join(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        base = [rng.choice("abcdefghij klmnop") for _ in range(rng.randint(40, 300))]
        for j in range(3):
            text = list(base)
            for _ in range(rng.randint(0, len(text) // 30)):
                text[rng.randrange(len(text))] = rng.choice("qrstuv")
            rows.append((3 * i + j, "".join(text)))
    rows += [(1000, ""), (1001, None), (1002, "ab")]
    classes = N.equal_sets(spark.createDataFrame(rows, "id long, text string").where("text is not null").select("id", N.trigrams(F.col("text")).alias("items")))
    exact = {(r.a, r.b) for r in N.similar_pairs(classes, 0.85).collect()}
    got = {(r.a, r.b) for r in minhash.minhash_pairs(classes, 0.85).collect()}
    assert got <= exact and len(exact) > 50 and len(got) >= 0.97 * len(exact)
    few = {(r.a, r.b) for r in minhash.minhash_pairs(classes, 0.85, bands=2).collect()}
    assert few <= got | exact and len(few) < len(exact)


def test_sketches_lose_no_pair(spark, monkeypatch):
    """Equal to the exact join in one tile and in many, with sets of all sizes; few pairs are counted."""
    from leadloom.operators import sketches as K2

    rng = random.Random(14)
    rows = []
    for i in range(120):
        base = [rng.choice("abcdefghij klmnop") for _ in range(rng.choice([3, 12, 60, 300, 1500]))]
        for j in range(4):
            text = list(base)
            for _ in range(rng.randint(0, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice("qrstuv")
            rows.append((4 * i + j, "".join(text)))
    rows += [(1000, ""), (1002, "ab")]
    items = spark.createDataFrame(rows, "id long, text string").select("id", N.trigrams(F.col("text")).alias("items"))
    exact = {tuple(r) for r in N.similar_pairs(N.equal_sets(items), 0.85).collect()}
    sets = N.stored_sets(items)
    ids = N.first_ids(sets)
    assert len(exact) > 50 and {tuple(r) for r in K2.sketch_pairs(sets, ids, 0.85).collect()} == exact
    monkeypatch.setattr(K2, "TILE", 7)
    met = [(r.a, r.b) for r in K2.sketch_candidates(sets, ids, 0.85).collect()]
    assert len(set(met)) == len(met) < 3 * len(exact) and {r[:2] for r in exact} <= set(met)


def test_minhash_estimates_the_index():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 900, dtype=np.int64)
    a, b = minhash.band_keys(x[:600], 400, 1), minhash.band_keys(x[200:800], 400, 1)
    assert abs((a == b).mean() - 0.5) < 0.1 and (minhash.band_keys(x[::-1].copy(), 400, 1) == minhash.band_keys(x, 400, 1)).all()


def test_noted_sends_equal_the_loop(spark):
    from leadloom.operators.lifecycle import noted_sends

    rng = random.Random(21)
    rows = []
    for i in range(200):
        rows.append((i, rng.choice(["sent", "sent", "sent", "error"]), rng.choice([None, False, True]), rng.choice(["email", "phone"]), rng.choice([None, "", *(f"m{j}" for j in range(40))]), rng.choice([None, "", *(f"A{j}@x" for j in range(12))]), rng.choice("rs"), rng.choice([None, "+", *(f"+1 {j}" for j in range(15))])))
    known = [("message", "m3"), ("email_run", "a2@x|r"), ("phone", "14"), ("email", "a5@x")]
    seen, want = set(known), []
    for i, result, dry, channel, message, mail, run, phone in rows:
        digits = "".join(c for c in phone or "" if c.isdigit())
        if result != "sent" or dry:
            continue
        if channel == "phone":
            keys = {("phone", digits)} if digits else None
        else:
            keys = ({("message", message)} | ({("email_run", f"{mail.lower()}|{run}")} if mail else set())) if message else None
        if keys and not keys & seen:
            seen |= keys
            want.append(i)
    out = spark.createDataFrame(rows, "id long, result string, dry_run boolean, channel string, message_id string, email string, run string, phone string")
    assert sorted(r.id for r in noted_sends(out, spark.createDataFrame(known, "key_type string, key_value string"), "id").collect()) == want


def test_keep_first_by_bands_equals_the_loop(spark, monkeypatch):
    """The greedy choice over all pairs of bands, with few pairs made for a large group of near copies."""
    from leadloom.operators import sketches as K2

    rng = random.Random(23)
    rows = [(0, ""), (1, "ab")]
    for i in range(12):
        base = [rng.choice("abcdefghij klmnop") for _ in range(rng.choice([60, 300, 900]))]
        for _ in range(40 if i < 4 else 3):
            text = list(base)
            for _ in range(rng.randint(0, len(text) // 40)):
                text[rng.randrange(len(text))] = rng.choice("qrstuv")
            rows.append((len(rows), "".join(text)))
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in rows]
    sets = N.stored_sets(spark.createDataFrame(rows, "id long, text string").select("id", N.trigrams(F.col("text")).alias("items")))
    ids = N.first_ids(sets)
    pairs = {(r.a, r.b) for r in minhash.minhash_set_pairs(sets, ids, 0.85).collect()}
    want: list[int] = []
    for i in sorted(r.id for r in ids.collect()):
        if not any((j, i) in pairs for j in want):
            want.append(i)
    counted, real = [], K2.counted_in_cells
    monkeypatch.setattr(K2, "counted_in_cells", lambda met, *a: counted.append(met.count()) or real(met, *a))
    assert sorted(r.id for r in minhash.keep_first_by_bands(sets, ids, 0.85).collect()) == want
    assert len(pairs) > 500 and sum(counted) < len(pairs) / 2
    exact = {(r.a, r.b) for r in K2.sketch_pairs(sets, ids, 0.85).collect()}
    whole: list[int] = []
    for i in sorted(r.id for r in ids.collect()):
        if not any((j, i) in exact for j in whole):
            whole.append(i)
    monkeypatch.setattr(K2, "TILE", 25)
    counted.clear()
    assert sorted(r.id for r in K2.keep_first_by_tiles(sets, ids, 0.85).collect()) == whole
    assert sum(counted) < len(exact) * 0.75
    monkeypatch.setattr(K2, "WORTH", 1.0)  # all pairs after the first round
    assert sorted(r.id for r in minhash.keep_first_by_bands(sets, ids, 0.85).collect()) == want


def test_rounds_look_behind_a_kept_id_that_is_not_alike(spark):
    from leadloom.operators import sketches as K2

    sets = spark.createDataFrame([(1, list(range(10))), (2, list(range(20, 39))), (3, list(range(20, 40)))], "id long, features array<long>")
    pairs = spark.createDataFrame([(1, 3), (2, 3)], "a long, b long")

    def candidates(nodes, first):
        met = pairs.join(nodes.select(F.col("id").alias("a")), "a").join(nodes.select(F.col("id").alias("b"), "after"), "b").where("a > after")
        return met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if first else met.select("a", "b")

    assert sorted(r.id for r in K2.keep_first_in_rounds(sets.select("id"), sets, 0.85, candidates).collect()) == [1, 2]
