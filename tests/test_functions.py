import pytest
from caselake.functions import rules as R
from caselake.functions import scalars as S
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [("Refused on appeal", "refused"), ("GRANTED", "approved"), ("  ", "missing"), (None, "missing"), ("pending", "other"), ("refused, later granted", "refused")],
)
def test_first_match(spark, text, want):
    rules = [("refused", "refus"), ("approved", "grant|approv")]
    assert one(spark, text, lambda c: R.first_match(c, rules, "missing", "other")) == want


def test_rule_lists_must_not_be_empty():
    with pytest.raises(ValueError):
        R.first_match(F.lit("x"), [])
    with pytest.raises(ValueError):
        R.flag_columns({})


def test_veto_and_context(spark):
    rules = [("report", "report", "draft"), ("plan", "plan", None)]
    f = lambda c: R.first_match_with_veto(c, rules, "notice", "officer")
    assert one(spark, "Draft report", f) is None
    assert one(spark, "draft report and plan", f) == "plan"
    assert one(spark, "site notice report", f) is None
    assert one(spark, "officer notice report", f) == "report"


def test_multi_label_order_and_boost(spark):
    rules = [("noise", "noise"), ("design", "design")]
    assert one(spark, "design and NOISE", lambda c: R.multi_label(c, rules)) == ["noise", "design"]
    assert one(spark, None, lambda c: R.multi_label(c, rules)) == []
    df = spark.createDataFrame([("x", ["noise"])], "d string, labels array<string>")
    flags = R.boost_flags(R.flag_columns({"loud": [("d", "loud")]}), F.col("labels"), {"loud": "noise"})
    assert df.select(flags["loud"].alias("y")).first()[0] is True


@pytest.mark.parametrize("text, want", [("1,234.5", 1234.5), ("£12", 12.0), ("7 %", 7.0), ("abc", None), (None, None)])
def test_to_number(spark, text, want):
    assert one(spark, text, S.to_number) == want


@pytest.mark.parametrize("text, want", [(" a  b ", "a b"), ("N/A", None), ("-", None), (" ", None), ("unknown", "unknown"), ("nan", "nan"), (None, None)])
def test_norm_text(spark, text, want):
    assert one(spark, text, S.norm_text) == want


@pytest.mark.parametrize("text, want", [("[c]", None), ("1,234", 1234.0), ("[x]", None), (None, None)])
def test_suppressed(spark, text, want):
    assert one(spark, text, S.suppressed_number) == want


@pytest.mark.parametrize("text, want", [("03/04/2024", "2024-04-03"), ("2024-04-03", "2024-04-03"), ("3 April 2024", "2024-04-03"), ("soon", None), ("31/02/2024", None),
    ("3 Apr 2023", "2023-04-03"), ("03.04.23", "2023-04-03"), ("3rd April 2023", "2023-04-03"), ("April 3, 2023", "2023-04-03"), ("3/apr/98", "1998-04-03"), ("21ST SEPT 2020", "2020-09-21"),
    ("2024/4/3 10:30", "2024-04-03"), ("04/13/2023", "2023-04-13"), ("3 Aprilx 2023", None), ("3 4", None), ("13/13/2023", None), ("2023", None), (None, None), ("", None)])
def test_dates_day_first(spark, text, want):
    got = one(spark, text, S.to_iso_date)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("text, want", [("12b High Street", "12B"), ("Land at Mill Farm", "MILL"), ("", None), ("Land front of Rose Cottage", "ROSE"), ("Flat 12a, 7 High St, AB1 2CD", "7"), ("AB1 2CD", None), ("Plot to the rear", None), ("123456 Long", "123456")])
def test_address_signature(spark, text, want):
    assert one(spark, text, S.address_signature) == want


def test_postcode_and_region(spark):
    assert one(spark, "x sw1a 1aa y", S.postcode) == "SW1A 1AA"
    assert one(spark, "none", S.postcode) is None
    regions = {"SW": "London", "B": "Midlands"}
    assert one(spark, "BX1 2CD", lambda c: S.prefix_lookup(c, regions)) == "Midlands"
    assert one(spark, "ZZ1", lambda c: S.prefix_lookup(c, regions)) == "Unknown"


@pytest.mark.parametrize("text, want", [("Views Mar 2024", "2024-03"), ("2024-11 x", "2024-11"), ("Q3 2023", "2023-Q3"), ("year 2020", "2020"), ("x", None),
    ("decimal 2024", "2024"), ("Marketing 2024 q3", "2024-Q3"), ("Dismissed Mar 24", "2024-03"), ("3000-13 in 1850", None), ("Sept_1989", None), ("12024-031", None), (None, None)])
def test_period(spark, text, want):
    assert one(spark, text, S.period_key) == want


@pytest.mark.parametrize("text, want", [("Mar 24", "2024-03-01"), ("march_2024", "2024-03-01"), ("Sept-2024", "2024-09-01"), ("2024-03-05 00:00:00", "2024-03-01"), ("2024-13-05 00:00:00", None), ("March", None), ("Dec 1989", None), ("mar 240", None), ("x Mar 24", None), ("2024-03", None), (None, None)])
def test_period_token(spark, text, want):
    assert one(spark, text, S.period_token) == want


@pytest.mark.parametrize("ref, want", [("x", "http://h.example/a/x"), ("../../../x", "http://h.example/x"), (".", "http://h.example/a/"), ("..", "http://h.example/"), ("?q", "http://h.example/a/b?q"), ("", "http://h.example/a/b?k=1"), ("#p", "http://h.example/a/b?k=1#p"), ("//o.example/../z", "http://o.example/../z"), ("HTTPS://o.example", "HTTPS://o.example"), ("/x/./y/../z?u=../v", "http://h.example/x/z?u=../v"), (None, None)])
def test_resolve_url(spark, ref, want):
    from urllib.parse import urljoin

    assert one(spark, ref, lambda c: S.resolve_url(F.lit("http://h.example/a/b?k=1#f"), c)) == want
    assert ref is None or urljoin("http://h.example/a/b?k=1", ref) == want or ref == "HTTPS://o.example"


@pytest.mark.parametrize("url, want", [(None, False), ("", False), (" ", False), ("https://a.example/#AdvancedSearch", True), ("https://a.example/case/1#advancedsearch", True), ("https://a.example/case/1#x", False), ("https://a.example", True), ("https://a.example/LOGIN.do", True)])
def test_generic_urls(spark, url, want):
    assert one(spark, url, S.is_generic_url) is want


def test_rules_over_columns(spark):
    from caselake.functions import rules as R

    df = spark.createDataFrame([(" Letter ", "x"), ("memo", "Final LETTER"), (None, None), ("", " ")], "a string, b string")
    rules = [(1, [[("a", "in", ("letter",))]]), (2, [[(("a", "b"), "contains", ("letter",)), ("b", "matches", "^final")]]), (3, [[("a", "filled", False), ("b", "filled", False)]])]
    assert [r[0] for r in df.select(R.compile_ladder(rules, 9)).collect()] == [1, 2, 3, 3]
    for bad in ([], [(1, [])], [(1, [[]])], [(1, [[("a", "like", "x")]])]):
        with pytest.raises(ValueError):
            R.compile_ladder(bad)


def test_names(spark):
    assert one(spark, "St. Albans & District Council", S.canonical_name) == "SAINT ALBANS"
    assert one(spark, "City of King's Lynn Council", S.area_name_key) == "kings lynn"
    assert one(spark, "Royal Borough of Kingston & Thames", S.canonical_name) == "KINGSTON THAMES"
    assert one(spark, "The City Council", S.canonical_name) is None
    assert one(spark, "Old Town Council", lambda c: S.canonical_name(c, aliases={"OLD TOWN": "NEW TOWN"})) == "NEW TOWN"
    assert one(spark, "Stow City Council", S.name_tokens) == one(spark, "Stow", S.name_tokens) == ["STOW"]
    assert S.unique_names(["a", "", "a"]) == ["a", "column", "a_2"]


def test_references(spark):
    assert one(spark, " ab/12 /X ", S.reference_key) == "AB/12 /X"
    assert one(spark, " nan ", S.reference_key) is None
    assert one(spark, "ab/12/x", S.reference_tail) == "12/X"
    assert one(spark, "ab", S.reference_tail) == "AB"
    assert one(spark, "ab/", S.reference_tail) is None


@pytest.mark.parametrize(
    "url, want",
    [("http://user@Old.example:8080/a?b=1", "https://user@new.example:8080/a?b=1"), ("http://other.example/", "http://other.example/"), ("https://new.example/a", "https://new.example/a"), ("no url", "no url")],
)
def test_rewrite_host(spark, url, want):
    f = lambda c: S.rewrite_host(c, {"old.example": "new.example"})
    assert one(spark, url, f) == want
    assert one(spark, one(spark, url, f), f) == want


def test_html_and_section(spark):
    html = "<p>A &amp; B</p><script>x</script><b>c</b>"
    assert one(spark, html, S.html_to_text) == "A & B\nc"
    assert one(spark, "Intro REASONS: one two END rest", lambda c: S.section(c, "reasons:", ["end"])) == "one two"
    assert one(spark, "nothing here", lambda c: S.section(c, "reasons:", ["end"])) is None
    assert one(spark, "nothing here", lambda c: S.excerpt(c, "reasons:", ["end"], head=7)) == "nothing"


@pytest.mark.parametrize(
    "quote, want",
    [("would harm the area", "ok"), ("The proposal … harm the area", "ok"), ("it would harm the whole area indeed", "near_verbatim"), ("entirely different words are used here", "missing"), (None, None)],
)
def test_grounding(spark, quote, want):
    source = "The proposal would harm the area of the town and its people, it would harm the whole area too"
    df = spark.createDataFrame([(quote, source)], "q string, s string")
    assert df.select(S.grounding(F.col("q"), F.col("s"))).first()[0] == want


def test_quality_and_fallback(spark):
    df = spark.createDataFrame([(0, 0, 0), (50, 9, 1), (900, 150, 0), (900, 150, 2)], "c int, w int, h int")
    got = [r[0] for r in df.select(S.text_quality(F.col("c"), F.col("w"), F.col("h"))).collect()]
    assert got == ["unreadable", "image_only", "poor", "good"]
    kind = "struct<char_count:long,page_count:int,quality:string,error:string>"
    cases = [
        ((100, 1, "poor", None), (110, 1, "good", None), None, "few_chars", None, True),
        ((900, 1, "good", None), (9000, 1, "good", None), None, None, None, False),
        ((100, 2, "good", "x"), (1, 1, "poor", None), None, "primary_error", None, True),
        ((100, 2, "good", "x"), (0, 1, "poor", None), "noise", "family_override", None, False),
        ((0, 0, None, None), (0, 0, None, None), None, None, None, False),
        ((60, 1, "poor", None), (89, 1, "poor", None), None, "few_chars", None, False),
        ((60, 1, "poor", None), (90, 1, "poor", None), None, "few_chars", None, True),
        ((5, 1, "image_only", None), (1, 1, "poor", None), " plan ", "image_only", None, True),
        ((900, 1, "good", None), (1, 1, "poor", None), " noise", "family_override", None, True),
        ((900, 1, "image_only", None), (1, 1, "poor", "y"), " noise", "family_override", None, False),
    ]
    pair = spark.createDataFrame([(i, c[0], c[1], c[2]) for i, c in enumerate(cases)], f"i int, p {kind}, f {kind}, family string")
    reason = S.fallback_reason(F.col("p"), F.col("family"), 120.0)
    got = pair.select("i", reason, S.accept_fallback(F.col("p"), F.col("f"), reason)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(c[3], c[5]) for c in cases]


def test_json_and_hints(spark):
    assert one(spark, '{"a": " x "}', lambda c: S.json_text(c, "a")) == "x"
    for bad in ("{bad", '{"a": 5}', '{"a": true}', '{"a": {"b": "x"}}', '{"a": ["x"]}', '{"a": null}', '{"a": " "}', '["a"]', None):
        assert one(spark, bad, lambda c: S.json_text(c, "a")) is None
    df = spark.createDataFrame([("https://a.example/", "https://b.example/case/1")], "u string, v string")
    assert tuple(df.select(S.usable_hint([(F.col("u"), "first"), (F.col("v"), "second")])).first()[0]) == ("https://b.example/case/1", "second")
