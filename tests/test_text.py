from pyspark.sql import functions as F

from attesta.functions import text as tx

SMOKE = ("The bridge was opened on May 3, 1904. It carries two tracks and a footpath. "
         "Nobody has measured its sway in a storm. Engineers say that it lengthens by about 1.1 cm in hot summers.")


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "text string").select(fn("text").alias("x")).first()["x"]


def test_sentences_do_not_cut_numbers(spark):
    found = one(spark, SMOKE, tx.sentences)
    assert len(found) == 4
    assert "1.1 cm" in found[3]


def test_sentences_trim_and_drop_blanks(spark):
    assert one(spark, " \n One.\n\tTwo!  \n", tx.sentences) == ["One.", "Two!"]
    assert one(spark, "  \t\n", tx.sentences) == []


def test_blank_guard_covers_all_whitespace(spark):
    assert one(spark, " \t\n\x0b\r\f", tx.is_blank) is True
    assert one(spark, None, tx.is_blank) is True
    assert one(spark, " x ", tx.is_blank) is False


def test_tokens_keep_accents(spark):
    assert one(spark, "Éèa-b, c3!", tx.tokens) == ["éèa", "b", "c3"]


def test_term_counts(spark):
    got = one(spark, "b a b c a b", lambda c: tx.term_counts(tx.tokens(c)))
    assert [(r["term"], r["tf"]) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, "", lambda c: tx.term_counts(tx.tokens(c))) == []


def test_negation_parity(spark):
    assert one(spark, "It is not so", lambda c: tx.negation_odd(tx.tokens(c))) is True
    assert one(spark, "not never", lambda c: tx.negation_odd(tx.tokens(c))) is False


def test_let_binds_once(spark):
    got = spark.range(1).select(tx.let(F.lit(3), lambda v: v * v).alias("x")).first()["x"]
    assert got == 9
