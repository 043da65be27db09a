import pytest
from pyspark.sql import functions as F

from topicweave.functions import text as tx
from topicweave.functions.wordlists import cleaning_stop_words, query_stop_words

CLEANED = [
    ("RT @user_one: Mira esto https://t.co/AbC12", "user_one Mira"),
    ('"Una cita": dijo la escritora "hoy"', "cita '' dijo escritora hoy ''"),
    ("Line one\nline two, done.", "Line one line two done"),
    ("Café “bonito” a las 10:30", "Café “ bonito ” 10:30"),
    ("wow \U0001f600 xD 8D ok", "wow \U0001f600 ok"),
    ("I can't do it, she'll wait... cannot", "ca n't 'll wait ..."),
    ("gonna win, John's car", "gon na win John 's car"),
    ("'Juego de tronos' llega", "'Juego tronos llega"),
    ("#Tag; (paren) [x] 5% & $3", "Tag paren x 5 3"),
    ("", ""),
    (None, ""),
    ("     \t", ""),
]


@pytest.mark.parametrize("raw, cleaned", CLEANED)
def test_clean_text(spark, raw, cleaned):
    row = spark.createDataFrame([(raw,)], "t string").select(tx.clean_text(F.col("t"))).first()
    assert row[0] == cleaned


def test_word_tokens_split_links_and_marks(spark):
    df = spark.createDataFrame([("@a: https://t.co/x (b).",)], "t string")
    tokens = df.select(tx.word_tokens(F.col("t"))).first()[0]
    assert tokens == ["@", "a", ":", "https", ":", "//t.co/x", "(", "b", ")", "."]


def test_merged_word_before_a_mark_is_split(spark):
    df = spark.createDataFrame([("gonna, Wanna.",)], "t string")
    assert df.select(tx.word_tokens(F.col("t"))).first()[0] == [
        "gon", "na", ",", "Wan", "na", ".",
    ]


def test_counted_tokens(spark):
    df = spark.createDataFrame([("A Árbol x_1 é 99 ñ n't",)], "t string")
    assert df.select(tx.counted_tokens(F.col("t"))).first()[0] == ["árbol", "x_1", "99"]


def test_query_terms_drop_stop_words_before_lower_casing(spark):
    df = spark.createDataFrame([("juego de Tronos, The the RT madrid,",)], "t string")
    assert df.select(tx.query_terms(F.col("t"))).first()[0] == [
        "juego", "tronos,", "the", "madrid,",
    ]


def test_normalisers(spark):
    df = spark.createDataFrame([("a:b ‚Ä¶ ééx \U0001f600✈!",)], "t string")
    t = F.col("t")
    row = df.select(
        tx.delete_colons(t), tx.delete_mojibake(t), tx.blank_non_ascii(F.lit("ééx")),
        tx.delete_emoji(t),
    ).first()
    assert row[0].startswith("ab ")
    assert row[1].startswith("a:b  ")
    assert row[2] == " x"
    assert row[3].endswith("ééx !")


def test_stop_lists_differ():
    assert "tras" in cleaning_stop_words() and "tras" not in query_stop_words()
    assert "RT" in query_stop_words() and "," in query_stop_words()


def test_abbreviations(spark):
    """Short words that nearly always have a full stop; ends of sentences don't make one."""
    from topicweave.operators.sentences import abbreviations, listed

    people = ["Smith", "Jones", "Brown", "Lee", "Gray", "Park", "Hill", "Cole"]
    texts = [f"Then Dr. {p} met prof. {q}, e.g. at work. The work ended. It ended when {q} saw the work" for p in people for q in people]
    corpus = spark.createDataFrame([(t,) for t in texts], "full_text string")
    found = {r.word: r for r in abbreviations(corpus).collect()}
    assert set(found) == {"dr", "prof", "e.g"}
    assert (found["dr"].stops, found["dr"].plain) == (64, 0)
    names = listed(abbreviations(corpus))
    row = spark.createDataFrame([("Dr. Who saw (e.g. prof. Brown) at work. Ask the Dr.",)], "t string").select(
        tx.word_tokens(F.col("t"), names).alias("kept"), tx.word_tokens(F.col("t")).alias("split")
    ).first()
    assert row.kept == ["Dr.", "Who", "saw", "(", "e.g", ".", "prof.", "Brown", ")", "at", "work", ".", "Ask", "the", "Dr", "."]
    assert row.split[:3] == ["Dr", ".", "Who"]
    assert abbreviations(corpus.where("full_text = ''")).count() == 0
