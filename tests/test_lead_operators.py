"""Lead operators: golden rows, order and repetition, plans."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.functions import exprs as E
from leadloom.operators import candidates as C
from leadloom.operators import contacts, entities, gates, names, reports
from leadloom.operators import neardup as N
from leadloom.operators import people as P
from leadloom.operators.geo import adaptive_cells
from leadloom.plans.catalog import QUERIES


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_domains(spark):
    assert values(spark, E.norm_domain, ["https://WWW.Ab.com/x/", "ab.com/", " http://sub.ab.com ", "ab.com"]) == ["ab.com", "ab.com", "sub.ab.com", "ab.com"]
    assert values(spark, E.root_domain, ["a@x.ab.com", "www.ab.com.sa", "ab.co.uk:80", "x.y.ab.org", "local"]) == ["ab.com", "ab.com.sa", "ab.co.uk", "ab.org", "local"]


def test_profile_urls(spark):
    same = ["https://www.linkedin.com/in/Jo-Li", "http://linkedin.com/in/jo-li/", "https://uk.linkedin.com/in/jo-li?x=1", "linkedin.com/in/jo%2Dli#a"]
    assert set(values(spark, E.profile_url, same)) == {"https://www.linkedin.com/in/jo-li"}
    assert values(spark, E.profile_url, ["https://linkedin.com/company/x", "", "https://evil.com/in/x", None]) == [None] * 4


def test_small_forms(spark):
    assert values(spark, E.age_days, ["3d", "2w", "5mo", "1yr", "7h", "x"]) == [3, 14, 150, 365, 0, None]
    assert values(spark, E.review_number, ["1247", "1,247", "1.247", "4.8", "12,34"]) == [1247, 1247, 1247, 0, 0]
    assert values(spark, E.company_key, ["A b-C!", "", None]) == ["abc", None, None]
    assert values(spark, E.deobfuscate, ["a%40b%2Ecom", "a [at] b (dot) com", "a&#64;b.com"]) == ["a@b.com", "a@b.com", "a@b.com"]
    assert values(spark, lambda c: E.phone_digits(c, F.lit("971")), ["050 123 4567", "+34 911 222 333", "12"]) == ["971501234567", "34911222333", None]


@pytest.mark.parametrize(("email", "klass"), [("info@a.com", "role"), ("jo.li@a.com", "person"), ("x@a.com", "junk"), ("your@a.com", "junk"), ("logo@2x.png", "junk"), ("me@email.de", "junk"), ("anna@gmail.com", "personal"), ("two@@a.com", "junk")])
def test_email_class(spark, email, klass):
    assert values(spark, contacts.email_class, [email]) == [klass]


def test_best_contact_order(spark):
    rows = [("ab.com", e) for e in ("info@ab.com", "zoe.li@ab.com", "amy.li@ab.com", "joe@other.com", "our@gmail.com")]
    best = lambda r: contacts.pick_best_contact(spark.createDataFrame(r, "domain string, email string")).first().best_email
    assert best(rows) == "amy.li@ab.com" and best(rows[::-1]) == "amy.li@ab.com"
    assert best(rows[:1] + rows[3:]) == "info@ab.com" and best(rows[3:]) == "our@gmail.com"
    assert best([("abcgroup.com", "jim.b@abc.ae"), ("abcgroup.com", "jim.a@zz.ae")]) == "jim.b@abc.ae"


LEAD = "domain string, seq long, vertical string, intake string, email_class string, score long, hotel_volume string, traffic_tier string, traffic_score long, branches int"


def test_qualify_first_match(spark):
    rows = [("a", 1, "hotel", "whatsapp", "person", 90, "na", "low", 5, 1), ("b", 2, "hotel", "modern_booking", "personal", 10, "low", "low", 5, 1), ("c", 3, "clinic", "phone_led", "role", 80, "na", "unknown", 0, 1), ("d", 4, "hotel", "phone_led", "role", 85, "high", "unknown", 0, 1), ("e", 5, "hotel", "modern_booking", "role", 85, "high", "high", 0, 1)]
    df = spark.createDataFrame(rows, LEAD)
    why = lambda **k: {r.domain: r.drop_reason for r in gates.qualify_leads(df, **k).collect()}
    assert why() == {"a": None, "b": "freemail-only", "c": "score<82", "d": None, "e": "dead-signal:modern_booking"}
    assert why(min_traffic="medium", min_volume="medium") == {"a": "hotel-volume-too-low", "b": "freemail-only", "c": "score<82", "d": None, "e": "dead-signal:modern_booking"}
    assert why(min_traffic="medium")["a"] == "traffic-too-low" and why(min_traffic="meduim")["a"] is None and why(mailbox=False)["b"] == "dead-signal:modern_booking"
    ledger = {tuple(r) for r in gates.disqualify_rows(gates.qualify_leads(df, min_traffic="medium")).collect()}
    assert ledger == {("b", "freemail-only"), ("c", "score<82"), ("e", "dead-signal:modern_booking")}


def test_lasting_drops_need_no_traffic_signals(spark):
    rows = [("a", 1, "hotel", "whatsapp", "person", 90, "high", "low", 5, 1), ("b", 2, "hotel", "phone_led", "personal", 90, "high", "low", 5, 1), ("c", 3, "hotel", "phone_led", "role", 85, "low", "low", 5, 1)]
    q = gates.qualify_leads(spark.createDataFrame(rows, LEAD), "medium", "medium")
    lasting = {("b", "freemail-only"), ("c", "hotel-volume-too-low")}
    assert {(r.domain, r.drop_reason) for r in q.collect()} == {("a", "traffic-too-low")} | lasting
    for kept in (q, q.drop("lasting_reason")):
        assert {tuple(r) for r in gates.disqualify_rows(kept).collect()} == lasting
        assert {tuple(r) for r in gates.disqualify_rows(kept, mailbox=False).collect()} == {("c", "hotel-volume-too-low")}
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "hjid" in plan("qualify_leads") and "hjid" not in plan("disqualify_rows")
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_rank_and_cap_any_order(spark):
    rng = random.Random(1)
    rows = [(f"d{i}", i, "hotel", "x", rng.choice(("person", "role")), rng.choice((82, 90)), rng.choice(("na", "low", "high")), rng.choice(("low", "unknown", "high")), rng.randint(0, 2), rng.randint(0, 2)) for i in range(200)]
    first = [r.seq for r in gates.rank_and_cap(spark.createDataFrame(rows, LEAD), 20).collect()]
    rng.shuffle(rows)
    assert [r.seq for r in gates.rank_and_cap(spark.createDataFrame(rows, LEAD).repartition(7), 20).collect()] == first


def test_merge_filter_then_first_wins(spark):
    rows = [(1, "a.com", "US"), (2, "a.com", "ES"), (3, "a.com", "ES"), (4, "b.com", "ES"), (5, "c.com", "ES"), (6, "d.com", "ES")]
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "domain string")
    got = C.merge_candidates(spark.createDataFrame(rows, "seq long, domain string, country string"), ("ES",), keys("b.com"), spark.createDataFrame([("c-com",)], "slug string"), keys("d.com"))
    assert {r.seq: r.drop_reason for r in got.collect()} == {1: "country", 2: None, 3: "duplicate", 4: "sent", 5: "sent", 6: "disqualified"}


def test_append_once_twice(spark):
    rows = spark.createDataFrame([(i % 5, i) for i in range(20)], "k int, i int")
    ledger = spark.createDataFrame([(3,)], "k int")
    new = C.append_once(ledger, rows, ["k"], [F.col("i")])
    assert sorted((r.k, r.i) for r in new.collect()) == [(0, 0), (1, 1), (2, 2), (4, 4)]
    assert C.append_once(ledger.union(new.select("k")), rows, ["k"], [F.col("i")]).count() == 0


def test_suppress_is_an_equi_join(spark):
    drafts = spark.createDataFrame([(1, "a@x", "5"), (2, "b@x", "6"), (3, None, "7")], "id int, email string, phone string")
    ledger = spark.createDataFrame([("email", "a@x"), ("phone", "6"), ("email", "7")], "key_type string, key_value string")
    kept = C.suppress(drafts, {"email": "email", "phone": "phone"}, ledger, "id")
    assert [r.id for r in kept.collect()] == [3]
    assert "NestedLoop" not in kept._jdf.queryExecution().executedPlan().toString()


def test_greedy_keep_first_equals_the_loop(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (12, 20), (40, 60), (30, 200)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} if n > 1 else set()
        kept: list[int] = []
        for i in range(n):
            if not any((j, i) in pairs for j in kept):
                kept.append(i)
        got = N.greedy_keep_first(spark.range(n), spark.createDataFrame(list(pairs), "a long, b long"))
        assert sorted(r.id for r in got.collect()) == kept


def test_similar_pairs_brute_force(spark):
    rng = random.Random(6)
    texts = {i: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(2, 9))) for i in range(60)}

    def sh(t):
        w = t.split()
        return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or {t}

    want = {(a, b) for a in texts for b in texts if a < b and len(sh(texts[a]) & sh(texts[b])) > 0.35 * len(sh(texts[a]) | sh(texts[b]))}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").select("id", N.shingles(F.col("text"), 3).alias("items"))
    classes = N.equal_sets(df)
    rep = {r.id: r.rep for r in classes.collect()}
    assert rep == {a: min(b for b in texts if sh(texts[b]) == sh(texts[a])) for a in texts}
    assert {(r.a, r.b) for r in N.similar_pairs(classes, 0.35).collect()} == {(a, b) for a, b in want if rep[a] == a and rep[b] == b}


def test_message_body(spark):
    rows = [("a\nb\nc\nd\ne\nf",), ("a\nb\nc\nd",), ("a\nb\nc\nd\ne",), (None,)]
    got = [r.b for r in spark.createDataFrame(rows, "t string").select(N.message_body(F.col("t")).alias("b")).collect()]
    assert got == ["b\nc", "a\nb\nc\nd", "b", None]


def test_first_per_keys_equals_the_loop(spark):
    rng = random.Random(8)
    for n, k in ((1, 1), (40, 12), (60, 25)):
        keys = {i: {rng.randrange(k) for _ in range(rng.randint(1, 3))} for i in range(n)}
        used: set[int] = set()
        kept = []
        for i in range(n):
            if not keys[i] & used:
                kept.append(i)
                used |= keys[i]
        got = P.first_per_keys(spark.createDataFrame([(i, x) for i, xs in keys.items() for x in xs], "id long, key long"))
        assert sorted(r.id for r in got.collect()) == kept


def test_direct_mailboxes(spark):
    good = ["sarah.jones@x.com", "f.vitek@x.cz", "alvaro.ferrandis@x.es", "a.b.c.info@x.com", " Ann@X.com "]
    bad = ["hd@x.com", "gm-malta@x.com", "hotel.director@x.com", "front_desk@x.com", "direktion.basel@x.ch", "ann@gmail.com", "ann", "@x.com", "ann@x", "", None, "no-reply@x.com"]
    df = spark.createDataFrame([(x,) for x in good + bad], "e string")
    assert [r.d for r in df.select(names.is_direct_mailbox(F.col("e")).alias("d")).collect()] == [True] * len(good) + [False] * len(bad)


NAMES = (
    ("neil.baker@bakertrade.com.au", "Hewitt Trade Services", "", "Neil"), ("todd@toddbrownplumbing.com.au", "Todd Brown Plumbing", "Todd Petrie founded", None),
    ("sarah@bluegate.com.au", "Blue Gate", "Owner Sarah has 20 years", "Sarah"), ("sarah@bluegate2.com.au", "Blue Gate", "no person here", None),
    ("budapest@inn.hu", "Inn Buda", "Budapest City centre", None), ("you@email.com", "Whatever", "", None), ("neil.x@live.com", "Firm", "", None), ("m.van.dijk@inn.nl", "Inn", "", None),
    ("dave.smith@smithplumbing.com.au", "Smith Plumbing", "", "Dave"), ("howard.hotel@living.com", "Howard Hotel", "", None), ("info@anything.com", "Anything", "", None),
    ("reception.qld@industries.com.au", "Baker", "", None), ("%5b%7bneil.baker@x.org", "X", "", None), ("svenja.fels@parkhaus.de", "Rheinau Parkhaus", "", "Svenja"),
)


def test_names_out_of_addresses(spark):
    host = lambda e: e.split("@")[1]
    c = spark.createDataFrame([(host(e), e, b) for e, b, _, _ in NAMES], "domain string, email string, business string")
    texts = spark.createDataFrame([(host(e), t) for e, _, t, _ in NAMES], "domain string, text string")
    table = lambda xs: spark.createDataFrame([(x,) for x in xs.split()], "name string")
    got = names.derive_names(c, table("neil todd sarah dave howard svenja"), table("info reception qld hotel sales"), names.page_names(texts, "domain"))
    assert {r.email: r.first_name for r in got.collect()} == {e: n for e, _, _, n in NAMES}


def test_tables_and_lists(spark, tmp_path):
    path = str(tmp_path / "leads")
    entities.write_table(spark.createDataFrame([(1, "r1"), (2, "r2")], "id long, run_id string"), path)
    entities.write_table(spark.createDataFrame([(3, "r2")], "id long, run_id string"), path)
    assert sorted((r.id, r.run_id) for r in spark.read.parquet(path).collect()) == [(1, "r1"), (3, "r2")]
    (tmp_path / "places.txt").write_text("# places\n\nAlba|es|39.7|-0.2|0.15\n")
    assert [tuple(r) for r in entities.load_places(spark, str(tmp_path / "places.txt")).collect()] == [("Alba", "ES", 39.7, -0.2, 0.15)]
    for line in ("Alba|es|39.7", "Alba|es|x|1|2"):
        (tmp_path / "bad.txt").write_text(line + "\n")
        with pytest.raises(Exception):
            entities.load_places(spark, str(tmp_path / "bad.txt")).collect()
    assert C.allowed_countries(["es ", "fr"]) == ("ES", "FR") and C.allowed_countries(["*"]) is None and C.allowed_countries([], True) is None and len(C.allowed_countries([])) == 5


def test_people_geo_and_headline(spark):
    rows = [(1, "", "Owner at X", "ES", None), (2, "CEO", None, None, "Riga"), (3, "CEO", None, None, None), (4, "CEO", "x", "DE", "Bonn")]
    p = spark.createDataFrame([(*r, 1, False, 3) for r in rows], "person_id long, title string, headline string, company_country string, company_city string, degree int, open_profile boolean, last_activity_days int")
    got = {r.person_id: r.reason for r in P.qualify_people(p, countries=["ES"], cities=["riga"]).collect()}
    assert got == {1: None, 2: None, 3: "geo: no company location", 4: "geo: company in DE"}


def test_hold_several_keys(spark):
    rows = [(1, 5.0, ["x", "y"], 3), (2, 6.0, ["y"], 3), (3, 4.0, ["x"], 3), (4, 9.0, ["x"], 50), (5, 1.0, ["z"], 2)]
    df = spark.createDataFrame(rows, "person_id long, score double, keys array<string>, headcount int")
    assert sorted(r.person_id for r in P.coordination_hold_exact(df).collect()) == [2, 3, 5]
    last = spark.createDataFrame([("y", "2024-02-25"), ("z", "2024-01-01")], "key string, contacted string").withColumn("contacted", F.to_date("contacted"))
    got = {r.person_id: r.hold for r in P.coordination_hold(df, last, "2024-03-01").collect()}
    assert got == {1: "window", 2: "window", 3: None, 4: None, 5: None}


def test_adaptive_cells_hold_every_point(spark):
    rng = random.Random(3)
    pts = [(40 + rng.gauss(0, 0.1), rng.gauss(0, 0.1)) for _ in range(500)]
    cells = adaptive_cells(spark.createDataFrame(pts, "lat double, lon double"), 0.4, 20, 0.02).collect()
    assert sum(c.n for c in cells) == 500 and all(c.complete == (c.n < 20) for c in cells) and len({c.size for c in cells}) > 1


def test_every_query_has_unique_columns_and_sql_names(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    df = entry.entry(spark)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_reject_batch_needs_a_pair(spark, tmp_path):
    """A phrase in common is no duplicate; a pair above 0.35 or a shared opening of seven words is."""
    from leadloom.plans.catalog import QUERIES

    a = "our new plant in the north opened last week and we saw your note on pumps"
    b = "somebody at the fair told me that we saw your big stand near hall nine"
    c = "our new plant in the north opened " + " ".join(f"x{i}" for i in range(40))
    d = "somebody at the fair told me that we saw your big stand near hall ten"
    for k, (texts, want) in enumerate((((a, b), False), ((a, c), True), ((b, d), True), ((a,), False))):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert [tuple(r) for r in QUERIES["reject_batch_if_dupes"](spark, f"{tmp_path}/{k}").collect()] == [(want,)]


def test_funnel_with_empty_stages(spark):
    rows = [r.ratio for r in reports.funnel([("a", spark.range(4)), ("b", spark.range(0)), ("c", spark.range(0)), ("d", spark.range(2))]).orderBy("step").collect()]
    assert rows[:2] == [None, 0.0] and rows[2] != rows[2] and rows[3] == float("inf")
    none = spark.createDataFrame([], "domain string")
    assert reports.page_yield(none, none).select("domains", "warn").first()[:] == (0, False)


def test_shortfall_without_kept_leads(spark):
    rows = spark.createDataFrame([(0, 0), (5, 0), (50, 10), (250, 10)], "n_in long, n_kept long")
    assert [r[:] for r in reports.target_shortfall(rows, 20).orderBy("n_in").collect()] == [(0, 0, None, True), (5, 0, None, True), (50, 10, 100, True), (250, 10, 500, True)]


def test_survival_without_spread(spark):
    of = lambda rows: reports.score_survival(spark.createDataFrame(rows, "traffic_score long, drop_reason string")).first()
    assert of([])[:] == (0, 0, None)
    for rows, n in (([(5, None)], 1), ([(5, None), (9, None)], 2), ([(5, None), (5, "x")], 1)):
        got = of(rows)
        assert got[:2] == (len(rows), n) and got[2] != got[2]
    assert of([(5, None), (9, "x"), (1, "x"), (7, None)])[:] == (4, 2, round(float(np.corrcoef([5, 9, 1, 7], [1, 0, 0, 1])[0, 1]), 4))


def test_reject_batch_looks_for_pairs_only_where_it_must(spark, tmp_path, monkeypatch):
    from leadloom.plans.catalog import QUERIES

    monkeypatch.setattr(N, "similar_pairs", lambda *_: pytest.fail("all pairs were looked for"))
    for k, texts in enumerate((["one two three four five six seven x", "one two three four five six seven y z"], ["a b c d", "a b c d"])):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert QUERIES["reject_batch_if_dupes"](spark, f"{tmp_path}/{k}").first()[0] is True


def test_word_shingle_pairs_lose_no_link(spark, tmp_path):
    """Every pair above 0.35 by brute force follows from the result: one representative, or two that are a pair."""
    rng = random.Random(16)
    texts = {i: " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(1, 9))) for i in range(50)}
    texts |= {60: texts[3], 61: texts[3].upper(), 62: texts[7].replace(" ", ", "), 63: "", 64: None, 65: "-", 66: "a b a b a", 67: "a b a b a b a"}

    def sh(t):
        w = t.lower().replace(",", " ").replace("-", " ").split()
        return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or ({" ".join(w)} if w else set())

    sets = {i: sh(t or "") for i, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 0.35 * len(sets[a] | sets[b])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["word_shingle_pairs"](spark, str(tmp_path)).collect()
    rep = {i: min((r.a for r in rows if r.b == i and r.similarity == 1), default=i) for i in texts}
    listed = {(r.a, r.b) for r in rows}
    assert (3, 60) in listed and (3, 61) in listed and (66, 67) in listed and len(listed) == len(rows) and listed <= want
    assert want == {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and (rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in listed)}


def test_sets_are_not_shuffled_to_find_their_copies(spark):
    df = spark.createDataFrame([(i, [f"{i % 7}", "x"]) for i in range(40)], "id long, items array<string>")
    classes = N.equal_sets(df)
    assert {(r.id, r.rep) for r in classes.collect()} == {(i, i % 7) for i in range(40)}
    plan = classes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
