"""Text modules on explicit strings and spans, decision rules, statistics in closed form."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from moderix.functions import charsafe, deobfuscate, lexicon_scan, target, text
from moderix.operators import decision as dec
from moderix.operators import evaluation as ev
from moderix.operators import panel


def codes(c: charsafe.Clean) -> list[tuple]:
    return [(p["code"], p["confidence"], p["start"], p["end"]) for p in c.patterns]


@pytest.mark.parametrize(("raw", "clean", "offsets", "found"), [
    ("a​b", "ab", [0, 2], [("ZERO_WIDTH", 0.95, 1, 2)]),
    ("﻿hi", "hi", [1, 2], [("ZERO_WIDTH", 0.05, 0, 1)]),
    ("SIKINTI", "sıkıntı", [0, 1, 2, 3, 4, 5, 6], [("DOTLESS_I", 0.1, 0, 7)]),
    ("sIk", "sık", [0, 1, 2], [("DOTLESS_I", 0.9, 0, 3)]),
    ("sаl", "sal", [0, 1, 2], [("HOMOGLYPH", 0.9, 0, 3)]),
    ("мир", "мир", [0, 1, 2], []),
    ("ş", "ş", [0], [("ZERO_WIDTH", 0.05, 1, 2)]),
    ("", "", [], []),
])
def test_charsafe(raw: str, clean: str, offsets: list, found: list) -> None:
    c = charsafe.cleaned(raw)
    assert (c.text, c.start, codes(c)) == (clean, offsets, found)


@pytest.mark.parametrize(("raw", "out"), [
    ("s a l a k", "salak"), ("s.a.l.a.k", "salak"), ("s4l4k", "salak"), ("Amin!", "Amin!"), ("saaalak", "salak"), ("anne", "anne"), ("aqil", "akil"),
    ("áptal", "aptal"), ("Turkcell'in", "Turkcell'in"), ("3M", "3M"), ("@s4l4k", "@s4l4k"), ("a b", "a b"),
])
def test_repairs(raw: str, out: str) -> None:
    assert deobfuscate.repaired(raw, raw, list(range(len(raw))))[0] == out


def test_second_tier_needs_one_reading() -> None:
    words = frozenset({"kötü", "ölü", "olü"})
    go = lambda s: deobfuscate.repaired(s, s, list(range(len(s))), words)[0]
    assert go("kotu") == "kötü"
    assert go("olu") == "olu"
    assert deobfuscate.repaired("s**k", "s**k", [0, 1, 2, 3], words)[2][0]["code"] == "SUFFIX_ON_MASKED"


def test_targets_and_identifiers(spark) -> None:
    told = {
        "sen @ali": ["individual mention", "individual second person"], "türkler geldi": ["group türk"], "türkiye": [], "türk": ["group türk"], "belediyedekiler": [], "belediyeye kızdım": ["non_human belediye"],
        "problemin": [], "sistemin": [], "yönetimin": [], "akşamın": [], "gidiyorsun": ["individual verb ending"], "kitapsın": ["individual verb ending"], "misin": [], "hastamısın": ["individual verb ending"],
        "OĞLUM'un": ["individual call"], "sene senaryo": [], "a@b": [], "": [], None: [],
    }
    kinds = {
        "10000000146": ["national_id"], "10000000147": [], "0532 123 45 67 ve a@b.com": ["mobile", "email"], "TR330006100519786457841326": ["iban"], "sen Atatürk Mah. Gül Sok. No: 12": ["address"],
        "okul Atatürk Mah. Gül Sok. No: 12 sen": [], "Atatürk Mah. Gül Sok. No: 12": [], "+90 212 345 67 89": ["landline"], "34 ABC 123": ["plate"], "https://x.com/ali": ["profile"], "": [], None: [],
    }
    texts = list(dict.fromkeys([*told, *kinds]))
    rows = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "id long, text string, targets string, i int")
    got = {texts[r.id]: r for r in target.resolved(rows, "id", groups=frozenset({"türk"}), things=frozenset({"belediye"})).collect()}
    assert {t: [f"{x.type} {x.how}" for x in got[t].targets] for t in told} == told
    assert {t: [x.kind for x in got[t].identifiers] for t in kinds} == kinds
    spans = got["sen Atatürk Mah. Gül Sok. No: 12"]
    assert [(x.start, x.end) for x in spans.identifiers] == [(12, 32)] and [(x.start, x.end) for x in spans.targets] == [(0, 3)]
    assert [(x.start, x.end) for x in got["sen @ali"].targets] == [(4, 8), (0, 3)] and [(x.start, x.end) for x in got["OĞLUM'un"].targets] == [(0, 5)]
    assert target.resolved(rows.limit(0), "id").count() == 0


def test_plain_texts_are_cleaned_by_spark_as_by_python(spark) -> None:
    texts = ["Plain ASCII, no capital eye.", "I see", "", None, "tab\tand\nline", "sаl", "a\u200bb", "x" * 50_000, "^`~", "del\x7f"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, plain int")
    for r in charsafe.charsafe(rows, "id").collect():
        if texts[r.id] is None:
            assert (r.charsafe_text, r.offsets, r.patterns, r.ok) == (None, None, None, True)
            continue
        c = charsafe.cleaned(texts[r.id])
        assert (r.charsafe_text, r.offsets, [p.asDict() for p in r.patterns], r.ok) == (c.text, c.start, c.patterns, True)
    both = rows.select("id", "text").join(charsafe.charsafe(rows, "id").select("id", "charsafe_text", "offsets"), "id")
    for r in deobfuscate.deobfuscated(both, "id").collect():
        if texts[r.id] is not None:
            c = charsafe.cleaned(texts[r.id])
            assert (r.normalized_text, r.offsets, [p.asDict() for p in r.patterns]) == deobfuscate.repaired(c.text, texts[r.id], c.start)


@pytest.mark.parametrize(("raw", "clean", "found"), [
    ("a\u0301b", "áb", ["ZERO_WIDTH"]), ("x\u0334y", "xy", ["ZERO_WIDTH"]), ("й", "й", []), ("I\u0307", "i", ["DOTLESS_I"]), ("İ", "i", ["DOTLESS_I"]), ("ɪ", "ı", ["HOMOGLYPH", "DOTLESS_I"]),
    ("❤️", "❤️", []), ("👨\u200d👩", "👨\u200d👩", []), ("\u200d", "", ["ZERO_WIDTH"]), ("ＡＢ", "ab", ["HOMOGLYPH"]), ("x²", "x²", []), ("𝐬𝐚𝐥", "sal", ["HOMOGLYPH"]), ("ⓢⓐ", "sa", ["HOMOGLYPH"]), ("🅱", "b", ["HOMOGLYPH"]),
    ("🇹🇷", "🇹🇷", []), ("🇹🇷🇦", "tra", ["HOMOGLYPH"]), ("аоро", "aopo", ["HOMOGLYPH"]), ("мир аоро", "мир aopo", ["HOMOGLYPH"]), ("IŞIK", "ışık", ["DOTLESS_I"]), ("a\x00b", "ab", ["ZERO_WIDTH"]),
])
def test_characters(raw: str, clean: str, found: list) -> None:
    c = charsafe.cleaned(raw)
    assert (c.text, [p["code"] for p in c.patterns]) == (clean, found)
    assert len(c.chars) == len(c.start) == len(c.end) and all(0 <= a < z <= len(raw) for a, z in zip(c.start, c.end, strict=True)) and c.start == sorted(c.start)


def test_lexicon_scan() -> None:
    lex = lexicon_scan.lexicon_of([("mal", "mal", "B1"), ("aptal", "aptal", "A")], ["malum"], {"mal": "var"})
    content, guards = lexicon_scan.judged({"raw": ("aptallar malum kemalist", list(range(23)))}, lex)
    assert [(c["code"], c["span"]) for c in content] == [("A1", {"start": 0, "end": 8})]
    assert [(g["code"], g["span"]) for g in guards] == [("SUBSTRING_COLLISION", {"start": 17, "end": 20})]
    assert [g["code"] for g in lexicon_scan.judged({"raw": ("mal varlığı", list(range(11)))}, lex)[1]] == ["HOMONYM"]
    assert lexicon_scan.scan("a***l", lex)[0] == [(0, 5, "aptal", 0.6)]


@pytest.mark.parametrize(("text_", "hits"), [
    ("b o k", ["bok"]), ("b o k t a n", ["bok"]), ("t a m a l", []), ("x b o k", []), ("b o k y", []), ("bok mu", ["bok"]), ("a mal", ["mal"]),
    ("amdan", ["am"]), ("amı", ["am"]), ("amlar", []), ("am", ["am"]), ("amaç", []),
    ("geri zekalı", ["geri zekalı"]), ("geri  zekalılar", ["geri zekalı"]), ("geri, zekalı", []), ("gerisi zekalı", []), ("geri zeka", []),
    ("sıkın", []), ("sıkecek", ["sık"]), ("sık", []), ("malum", []), ("mallar", ["mal"]), ("m*l", ["mal"]), ("4mal", ["mal"]), ("mal'dan", ["mal"]), ("12 34", []),
])
def test_lexicon_rules(text_: str, hits: list) -> None:
    rows = [("mal", "mal", "B1"), ("bok", "bok", "A"), ("am", "am", "A"), ("geri", "geri zekalı", "B1"), ("sik", "sık", "A"), ("sik", "sıkecek", "A")]
    lex = lexicon_scan.lexicon_of(rows, ["malum"], clean_stems=["sık"], forms={"am": ["ı", "dan"]})
    lex = lexicon_scan.Lexicon(lex.variants | {"sık": ("sik", "A")}, lex.clean, lex.homonyms, lex.clean_stems, lex.forms)
    got = [h[2] for h in lexicon_scan.scan(text_, lex)[0]]
    assert [g if g != "sıkecek" else "sık" for g in got] == hits


def test_column_functions(spark) -> None:
    row = spark.range(1).select(
        text.tr_lower(F.lit("Iİ")).alias("low"), text.tokens(F.lit("Ali @user, URL çok")).alias("tok"), text.unspaced(F.lit("bu s a l a k mi")).alias("joined"),
        text.unpunctuated(F.lit("s.a.l.a.k")).alias("dots"), text.phonetic(F.lit("taxi")).alias("ks"), text.tckn_valid(F.lit("10000000146")).alias("id"),
        text.tckn_valid(F.lit(None).cast("string")).alias("no_id"), text.iban_valid(F.lit("TR33 0006 1005 1978 6457 8413 26")).alias("iban"), text.tr_number(F.lit(1234.5)).alias("num"), text.initials(F.lit("ada lovelace x")).alias("ini"),
        text.ago(F.lit(90)).alias("ago"), text.visible(F.lit("a​")).alias("vis"), text.valid_nickname(F.lit(" ")).alias("nick"), text.censored(F.lit("s**k")).alias("cens"),
    ).first()
    assert row.low == "ıi"
    assert row.tok == ["ali", "user", "çok"]  # word characters leave the sign out, so the tag is not skipped
    assert (row.joined, row.dots, row.ks) == ("bu salak mi", "salak", "taksi")
    assert (row.id, row.no_id, row.iban, row.num, row.ini, row.ago, row.vis) == (True, False, True, "1.234,5", "AL", "1 min", "a\\u{200b}")
    assert (row.nick, row.cens) == (False, True)


def decide(spark, content: str, guards: str = "array()", kind: str = "null", sure: str = "null", raw: str = "null", degraded: str = "false"):  # noqa: ANN201
    row = spark.sql(f"select cast({content} as array<{dec.SCORE}>) content, cast({guards} as array<{dec.GUARD}>) guards, cast({kind} as string) target_type, cast({sure} as double) target_confidence, cast({raw} as double) raw_score, {degraded} degraded")
    return dec.decided(row).first()


A1 = "named_struct('code','A1','score',{},'source','m1_lexicon@raw','span',named_struct('start',{},'end',{}),'threshold',null,'fired',true)"
GUARD = "array(named_struct('code','HOMONYM','score',0.9,'source','{}@raw','evidence','','span',named_struct('start',0,'end',3),'threshold',null,'active',null,'suppressed',array()))"


def test_verdicts(spark) -> None:
    hit = f"array({A1.format(0.9, 0, 3)})"
    assert tuple(decide(spark, "array()").verdict) == ("clean", None)
    assert tuple(decide(spark, "array()", degraded="true").verdict) == ("review", "degraded")
    assert tuple(decide(spark, hit).verdict) == ("nudge", "A1")
    assert tuple(decide(spark, hit, kind="'individual'", sure="0.5").verdict) == ("block", "A2")
    assert tuple(decide(spark, hit, kind="'individual'", sure="0.4").verdict) == ("nudge", "A1")
    assert tuple(decide(spark, f"array({A1.format(0.5, 0, 3)})").verdict) == ("nudge", "A1")  # at the threshold
    assert tuple(decide(spark, "array()", raw="0.5").verdict) == ("review", "binary_offensive")
    assert tuple(decide(spark, "array()", raw="0.7000001").verdict) == ("block", "binary_offensive")
    assert decide(spark, "array()").binary is None


def test_guards_stay_in_their_module_and_place(spark) -> None:
    both = f"array({A1.format(0.9, 0, 3)}, {A1.format(0.6, 10, 13)})"
    got = decide(spark, both, GUARD.format("m1_lexicon"))
    assert [(c.score, c.fired) for c in got.content] == [(0.6, True)]  # a suppressed score never hides a fired one
    assert [(c.score, c.fired) for c in decide(spark, both, GUARD.format("m6_target")).content] == [(0.9, True)]


def test_auc_properties(spark) -> None:
    rows = spark.createDataFrame([(i, i % 2, p) for i, p in enumerate([0.1, 0.4, 0.4, 0.4, 0.8, 0.9])], "row_id long, gold int, p double")
    area = lambda d: d and ev.auc(d).first().auc
    base = area(rows)
    assert base == pytest.approx((2 * 0.5 + 1 + 1 + 1 + 1 + 1) / 9 + (0.0) / 9, abs=0.2)
    assert area(rows.withColumn("p", F.col("p") ** 3)) == pytest.approx(base)
    assert area(rows.union(rows.filter("gold = 1"))) == pytest.approx(base)
    assert area(rows.withColumn("p", F.lit(0.3))) == 0.5
    assert area(rows.filter("gold = 1")) is None


def test_split_ignores_row_order_and_folds_are_even(spark) -> None:
    rows = spark.range(101).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("gold"))
    pick = lambda d: {r.row_id for r in ev.stratified_split(d, 0.25, 1).filter("part = 'dev'").collect()}
    assert pick(rows) == pick(rows.orderBy(F.desc("row_id")).repartition(3))
    sizes = [r["count"] for r in ev.stratified_folds(rows, 5, 1).groupBy("gold", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 14


def test_metrics_have_nulls_for_empty_denominators(spark) -> None:
    rows = spark.createDataFrame([(0, 0.1)], "gold int, p double")
    m = rows.agg(*ev.cells(F.col("p") > 0.5)).select(*ev.metrics()).first()
    assert (m.precision, m.recall, m.f1, m.fpr) == (None, None, 0.0, 0.0)


def test_cursor_round_trip_and_refusal() -> None:
    assert panel.decode_cursor(panel.encode_cursor(17, "a|b")) == (17, "a|b")
    with pytest.raises(ValueError):
        panel.decode_cursor("!!")


def test_kpi_rounding(spark) -> None:
    r = spark.sql("select 0 a, 0 b, 1145 c, 1000 d").select(panel.change_pct(F.col("a"), F.col("b")).alias("x"), panel.change_pct(F.col("c"), F.col("d")).alias("y")).first()
    assert (r.x, r.y) == (None, 14.5)


def test_short_ways_give_what_the_long_ones_give(spark, monkeypatch) -> None:
    """Whole analysis and its parts with and without what is remembered or skipped."""
    import random

    rng = random.Random(3)
    bits = ["sen", "size", "be", "Be", "ulan'a", "the", "theler", "derler", "dersin", "gelmişsin", "x'sen", "a'b'sen", "@ali", "a@bc", "İDİOT", "idiot", "s.c.u.m", "scuuum", "tr4sh", "Waxed", "I", "t r a s h",
            "ΣΑΣ", "dérlér", "sаl", "e\u0301", "a\u200bb", "Ａ", "10000000146", "ali@x.com", "no: 5 sokak evi", "trash can", "²sen", "\u00a0", "\n", "“sen”", "sen_", "…", "ß", "z" * 50, "sen-siz", "IĞDIR", "ʼ", "l'idiot"]
    texts = [rng.choice([" ", "  ", "\t"]).join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, ""]
    for x in filter(None, texts):
        a, b = charsafe.cleaned(x), charsafe._by_passes(x)
        assert (a.chars, a.start, a.end, a.patterns) == (b.chars, b.start, b.end, b.patterns), x
    groups, things = frozenset({"Der", "les"}), frozenset({"the"})
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [(r.id, r.target_type, r.target_confidence) for r in lexicon_scan.analysed(rows, lexicon_scan.lexicon_of([("trash", "trash", "A")]), groups=groups, things=things).collect()]
    want = [(r.id, r.t and r.t.type, r.t and r.t.confidence) for r in rows.select("id", F.get(target.targets(F.col("text"), groups, things, 1), 0).alias("t")).collect()]
    assert sorted(got) == sorted(want)
    dox = rows.select("id", F.size(target.identifiers(F.col("text"))).alias("n")).collect()
    assert {r.id: r.n for r in dox} == {r.id: sum(c.code == "B4" for c in r.content) for r in lexicon_scan.analysed(rows, lexicon_scan.lexicon_of([])).collect()}
    lex = lexicon_scan.lexicon_of([("idiot", "idiot", "B1"), ("trash", "trash", "A"), ("scum", "scum", "A")])
    for x in filter(None, texts):
        lex.quiet.clear()
        assert lexicon_scan.scan(x, lex) == lexicon_scan.scan(x, lex)
