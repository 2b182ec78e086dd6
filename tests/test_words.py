from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import stem, text, unicode

STEMS = """caresses→caress, ponies→poni, cats→cat, feed→fe, agreed→agre, plastered→plaster, sing→s, conflated→conflat, hopping→hopp, falling→fal,
filing→fil, happy→happi, relational→relat, conditional→condition, sensibiliti→sensibl, digitizer→digit, triplicate→triplic, electrical→electr,
hopefulness→hop, goodness→good, replacement→replac, adjustment→adjust, adoption→adopt, rate→rat, controll→control, roll→roll, Café→caf,
Straße→strass, ﬁling→fil, ½→12"""
PAIRS = [x.strip().split("→") for x in STEMS.split(",")]


def test_stems(spark):
    df = spark.createDataFrame([(a,) for a, _ in PAIRS] + [("",), (None,), ("cats",)], "word string")
    got = {r["word"]: r["stem"] for r in stem.normalise_words(df).collect()}
    assert [got[a] for a, _ in PAIRS] == [b for _, b in PAIRS] and got[None] is None and got[""] == ""
    assert stem.add_stems(df).count() == len(PAIRS) + 3
    assert [stem.measure(w) for w in ("tree", "trouble", "oats", "troubles", "private", "", "by")] == [0, 1, 1, 2, 2, 1, 0]


@given(st.text())
def test_stem_never_fails(w):
    assert set(stem.stem(w)) <= set("0123456789abcdefghijklmnopqrstuvwxyz")


def test_words(spark):
    df = spark.createDataFrame([(" a\tb\x0b\x0cc\r\n",), ("",), (None,), (" x É",), ("   ",)], "t string")
    got = df.select(text.words(F.col("t")), text.word_count(F.col("t")), text.ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in got] == [["a", "b", "c"], [], [], [" x", "É"], []] and [r[1] for r in got] == [3, 0, 0, 2, 0] and got[3][2] == " x É"


def test_mapping_options():
    U = unicode
    assert U.map_text("Café ﬁ Straße", U.STABLE | U.DECOMPOSE | U.COMPAT | U.CASEFOLD | U.STRIPMARK) == "cafe fi strasse"
    assert U.map_text("a\r\nb\tc\x01\x85", U.STRIPCC | U.NLF2LF) == "a\nb c\n"
    assert U.map_text("a\nb", U.NLF2LS) == "a b" and U.map_text("a\nb", U.NLF2PS) == "a b"
    assert U.map_text("‘x– ⁄", U.LUMP) == "'x- /"
    assert U.map_text("é", U.COMPOSE) == "é" and U.map_text("각", U.DECOMPOSE) == "각"
    assert U.map_text("a­b", U.IGNORE) == "ab" and U.map_text("a͸b", U.STRIPNA) == "ab"
    assert U.map_text("ab", U.COMPOSE, {ord("a"): ord("z")}) == "zb" and U.map_text("a\0b", U.NULLTERM) == "a"
    assert U.map_text("éx", U.COMPOSE | U.CHARBOUND) == "￿é￿x"
    for bad, code in ((U.COMPOSE | U.DECOMPOSE, -5), (U.STRIPMARK, -5)):
        try:
            U.map_text("x", bad)
            raise AssertionError
        except U.MappingError as e:
            assert e.code == code


def test_unicode_columns(spark):
    df = spark.createDataFrame([("éA字",), ("",), (None,), ("ǅ",), ("🇩🇪👩‍👩‍👧",)], "t string")
    c = F.col("t")
    got = df.select(unicode.category(c), unicode.grapheme_count(c), unicode.display_width(c), unicode.simple_upper(c), unicode.is_lower(c), unicode.is_upper(c), unicode.nfkc_casefold(c)).collect()
    assert got[0][:] == ("Ll", 3, 4, "ÉA字", True, False, "éa字") and got[1][1] == 0 and got[2][0] is None and got[3][0] == "Lt" and got[4][1] == 2
    n = spark.createDataFrame([(65,), (0xE9,), (0xD800,), (0x110000,), (0,)], "n int")
    got = n.select(unicode.encode_code_point(F.col("n")), unicode.valid_code_point(F.col("n"))).collect()
    assert [bytes(r[0]) for r in got] == [b"A", "é".encode(), b"", b"", b"\0"] and [r[1] for r in got] == [True, True, False, False, True]
    e = spark.createDataFrame([(-1,), (-3,), (5,)], "c int").select(unicode.error_text(F.col("c"))).collect()
    assert e[1][0] == "Invalid UTF-8 string" and e[2][0] == unicode.UNKNOWN_ERROR
    b = spark.createDataFrame([(0x41,), (0x80,), (0xC3,), (0xE2,), (0xF0,), (0xFF,)], "b int").select(unicode.sequence_length(F.col("b"))).collect()
    assert [r[0] for r in b] == [1, 0, 2, 3, 4, 0]
    p = df.select(c, unicode.code_points(c).alias("p")).select("t", "p", unicode.from_code_points(F.col("p")).alias("back")).collect()
    assert all(r["back"] == r["t"] and (r["t"] is None or r["p"] == [*map(ord, r["t"])]) for r in p)
    v = spark.createDataFrame([(b"a\xc3\xa9",), (b"\xc0\x80",), (b"\xed\xa0\x80",)], "b binary").select(unicode.valid_utf8(F.col("b").cast("string"))).collect()
    assert [r[0] for r in v] == [True, False, False]


def test_property_records(spark):
    chars = ["a", "É", "ß", "\u0301", "ﬁ", "½", "(", "中", "א", "\u00ad", "\n", "\u200d", "ǅ", "\u0378", "\u2028", "", None]
    got = {r["c"]: r["p"] for r in spark.createDataFrame([(c,) for c in chars], "c string").select("c", unicode.properties(F.col("c")).alias("p")).collect()}
    pick = lambda c, *names: tuple(got[c][n] for n in names)
    assert got[""] is None and got[None] is None
    assert pick("a", "category", "combining_class", "bidi_class", "uppercase", "width", "decomposition_type") == ("Ll", 0, "L", "A", 1, None)
    assert pick("É", "lowercase", "decomposition_type", "decomposition", "casefold") == ("é", "canonical", "E\u0301", "é") and pick("ß", "uppercase", "casefold") == ("ß", "ss")
    assert pick("\u0301", "category", "combining_class", "width") == ("Mn", 230, 0) and pick("ﬁ", "decomposition_type", "decomposition") == ("compat", "fi")
    assert pick("½", "decomposition_type") == ("fraction",) and pick("(", "bidi_mirrored", "bidi_class") == (True, "ON") and pick("中", "width") == (2,) and pick("א", "bidi_class") == ("R",)
    assert pick("\u00ad", "ignorable", "ambiguous_width", "control_boundary") == (True, True, True) and pick("\n", "control_boundary") == (True,) and pick("\u200d", "control_boundary") == (False,)
    assert pick("ǅ", "lowercase", "uppercase", "titlecase") == ("ǆ", "Ǆ", "ǅ") and pick("\u0378", "category") == ("Cn",) and pick("\u2028", "category", "control_boundary") == ("Zl", True)


def test_records_of_the_table_equal_the_unicode_data(spark, sf):
    import unicodedata

    import __spark_entry__ as entry

    rows = entry.queries()["unicode_records"](spark, sf).collect()
    chars = {c for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for c in r["text"] or ""}
    assert {r["ch"] for r in rows} == chars and len(rows) == len(chars)
    for r in rows:
        c = r["ch"]
        assert (r["category"], r["combining_class"], r["bidi_class"], r["bidi_mirrored"]) == (unicodedata.category(c), unicodedata.combining(c), unicodedata.bidirectional(c), bool(unicodedata.mirrored(c)))
        assert unicodedata.normalize("NFD", c) == (unicodedata.normalize("NFD", r["decomposition"]) if r["decomposition_type"] == "canonical" else c)
        assert r["lowercase"] == (c.lower() if len(c.lower()) == 1 else c) and r["casefold"] == c.casefold()


def test_breaks(spark):
    texts = ["e\u0301a", "\r\n\n", "🇩🇪🇫🇷", "👩\u200d👧x", "각", "각", "", None, "क्षि"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unicode.breaks(F.col("t")).alias("b"), unicode.graphemes(F.col("t")).alias("g")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["b"] is None
            continue
        at, want = 0, []
        for g in r["g"]:
            want += [at > 0] * (at > 0) + [False] * (len(g) - 1)
            at += len(g)
        assert r["b"] == want
    assert [r["b"] for r in rows][:4] == [[False, True], [False, True], [False, True, False], [False, False, True]]
    pairs = [("a", "b", True), ("e", "\u0301", False), ("\r", "\n", False), ("\n", "a", True), ("🇩", "🇪", False), ("ᄀ", "ᅡ", False), ("a", "\u200d", False), ("", "a", None), (None, "a", None)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(unicode.break_between(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [p[2] for p in pairs]
    assert unicode.versions()[:2] == ("2.10.0", "16.0.0")
