import math

import pytest
from pyspark.sql import functions as F

from tarn.functions import scoring, stemmers, stopwords
from tarn.functions import tokenizers as T


def tokens(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Don't stop the king's U.S.A. co-op 3.5", ["don", "stop", "the", "king", "usa", "co", "op", "3", "5"]),
        ("", []),
        (None, []),
        ("a.b. x.y", ["ab", "x", "y"]),
    ],
)
def test_pisa(spark, text, want):
    assert tokens(spark, T.pisa, text) == want


def test_standard_and_english(spark):
    assert tokens(spark, T.standard, "Can't 3.14 naïve foo_bar __ John’s") == ["can't", "3.14", "naïve", "foo_bar", "john’s"]
    assert tokens(spark, T.lucene_english, "John's can't Mary’s") == ["john", "can't", "mary"]
    assert tokens(spark, T.standard, "中国 abc") == ["中", "国", "abc"]


def test_long_tokens(spark):
    long = "x" * 300
    assert tokens(spark, T.whitespace, f"A {long} b") == ["A", "x" * 255, "x" * 45, "b"]
    assert tokens(spark, T.lucene_standard, f"a {long} b") == ["a", None, "b"]


def test_cjk(spark):
    assert tokens(spark, T.cjk, "北京是中国的首都") == ["北京", "京是", "是中", "中国", "国的", "的首", "首都"]
    assert tokens(spark, T.cjk, "日 ＡＢＣ x") == ["日", "abc", "x"]


def test_language_names():
    assert T.language("en") == "english" and T.language("German") == "german" and T.language("pt-BR") == "portuguese"
    with pytest.raises(ValueError, match="unknown language"):
        T.language("xx")
    assert T.choose(None, "zh") == "cjk" and T.choose(None, "fr") == "standard"
    with pytest.raises(ValueError, match="unknown tokenizer"):
        T.choose("nope")


@pytest.mark.parametrize(("word", "stem"), [("running", "run"), ("generously", "gener"), ("community", "commun"), ("day", "dai"), ("use", "us"), ("relational", "relat"), ("hopping", "hop"), ("ponies", "poni"), ("sky", "sky")])
def test_porter(word, stem):
    assert stemmers.STEMMERS["porter"](word) == stem


@pytest.mark.parametrize(("word", "stem"), [("running", "run"), ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("happily", "happili"), ("national", "nation"), ("day", "day")])
def test_porter2(word, stem):
    assert stemmers.STEMMERS["english"](word) == stem


def test_light_stemmers_merge_forms():
    assert stemmers.spanish("gatos") == stemmers.spanish("gatas") == "gat"
    assert stemmers.german("häusern") == stemmers.german("hauser")
    assert stemmers.french("l'avion") == stemmers.french("avions")
    assert stemmers.katakana("コンピューター") == "コンピュータ" and stemmers.katakana("コピー") == "コピー"
    assert stemmers.finnish("2024ssa") == "2024ssa"
    with pytest.raises(ValueError, match="unknown stemmer"):
        stemmers.stemmer("nope")


@pytest.mark.parametrize(
    ("language", "forms"),
    [
        ("arabic", ("الكتاب", "كتاب")), ("persian", ("کتاب‌های", "کتاب")), ("hindi", ("लड़कियों", "लड़की")), ("bengali", ("বইগুলো", "বই")), ("telugu", ("పుస్తకాలు", "పుస్తకా")),
        ("indonesian", ("membacakan", "baca")), ("russian", ("книгами", "книгам")), ("finnish", ("talossa", "talosta")), ("italian", ("bambine", "bambina")), ("portuguese", ("canções", "cançao")),
        ("dutch", ("katten", "katte")), ("swedish", ("bilarna", "bilen")),
    ],
)
def test_forms_share_a_stem(language, forms):
    stem = stemmers.STEMMERS[language]
    assert stem(forms[0]) == stem(forms[1])
    assert stem("") == ""


def test_stop_words():
    assert len(stopwords.stop_words("en")) == 33
    assert set(stopwords.stop_words("en")) < set(stopwords.stop_words("en", "terrier"))
    assert stopwords.resolve(["b", "a"], None) == ["a", "b"] and stopwords.resolve(False, "lucene") == [] and stopwords.resolve(None, None) == []
    with pytest.raises(ValueError, match="family"):
        stopwords.stop_words("en", "x")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_idf_and_bm25(spark):
    stats = scoring.Stats(100, 5.0, 5)
    for variant, want in (("robertson", math.log(90.5 / 10.5)), ("lucene", math.log(1 + 90.5 / 10.5))):
        m = scoring.BM25(variant=variant)
        got = value(spark, m.term_factor(F.lit(10), stats) * m.posting_factor(F.lit(1), F.lit(5), stats))
        assert got == pytest.approx(want / 2.2)
    assert value(spark, scoring.idf(F.lit(80), 100)) == pytest.approx(1e-6)
    with pytest.raises(ValueError, match="variant"):
        scoring.BM25(variant="x")


def test_k3(spark):
    q = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "c", 0.5)], "qid bigint, term string, weight double")
    got = {r["term"]: r["weight"] for r in scoring.BM25(k3=8.0).query_weights(q).collect()}
    for t, x in (("a", 1.0), ("b", 0.5), ("c", 0.25)):
        assert got[t] == pytest.approx(9 * x / (8 + x))
    assert {r["weight"] for r in scoring.BM25().query_weights(q).collect()} == {2.0, 1.0, 0.5}


@pytest.mark.parametrize(
    ("stem", "words"),
    [
        (stemmers.german, "kindern:kind häuser:haus frauen:frau schönste:schon bücher:buch autos:autos treue:treu größer:gross quelle:quell"),
        (stemmers.spanish, "gatos:gat luces:luz meses:mes niñas:niñ camiones:camion canción:cancion sol:sol"),
        (stemmers.french, "chevaux:cheval heureuse:heureu intuitivement:intuitif quatrième:quat ouvrière:ouvrier amplificateur:amplifi petites:petit l'avions:avion"),
    ],
)
def test_published_light_stemmers(stem, words):
    for pair in words.split():
        word, want = pair.split(":")
        assert stem(word) == want


def test_segmenters_of_ones_own(spark):
    from tarn.plans.analyzer import Analyzer

    assert "dictionary" in Analyzer("icu", None, "thai").degraded and Analyzer("icu").degraded is None
    T.register("halves", lambda text: F.array(F.substring(text, 1, 2), F.substring(text, 3, 2)))
    try:
        docs = spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")
        assert sorted(r["term"] for r in Analyzer("halves", None, "thai").tokens(docs).collect()) == ["ab", "cd"]
    finally:
        del T.TOKENIZERS["halves"]
    with pytest.raises(ValueError, match="lower case"):
        T.register("X", T.pisa)


def test_utf16_lengths(spark):
    wide = "\U0001d4d0"  # a letter of two units
    assert tokens(spark, T.lucene_standard, f"{wide * 127} {wide * 128}") == [wide * 127, None]


def test_porter_agrees_with_its_sql_on_words_of_few_letters():
    """Words that begin with y, hold two of them or are all consonants, which few real words do."""
    import random

    import duckdb

    from tarn import queries

    pick = random.Random(5)
    ends = ["", "s", "ed", "ing", "eed", "y", "e", "ll", "ies", "ational", "ness", "ion", "ement"]
    words = sorted({"".join(pick.choice("yyaebtslwx") for _ in range(pick.randint(1, 6))) + pick.choice(ends) for _ in range(20000)})
    db = duckdb.connect()
    db.execute("CREATE TABLE ut AS SELECT unnest($1) AS term", [words])
    wanted = dict(db.execute(f"WITH {queries._PORTER} SELECT word, stem FROM st").fetchall())
    stem = stemmers.stemmer("porter", "english")
    assert {w: stem(w) for w in words if w in wanted} == wanted
    assert [stem(w) for w in ("ydoiee", "yllcoll", "ylltae")] == ["ydoie", "yllcol", "yllta"]
