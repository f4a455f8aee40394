import random

import pytest
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions import normalize as N
from narrate_spark.functions import sentences as S
from narrate_spark.functions import table_functions
from narrate_spark.functions import unicode as U
from narrate_spark.sources import markup
from tests import plain

SCENE, TITLE = K.SCENE_BREAK_MARKER, K.CHAPTER_TITLE_MARKER


def apply(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.repartition(4).select("i", column(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def random_texts(seed, count, pieces, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) for _ in range(count)]


PIECES = [
    "Foo", "bar", "Sr", "etc", "No", "d", "U.S.A", "über", "ñandú", "Dña", "x😀", " ", " ", " ", "\n",
    "\xa0", " ", ".", ".", "!", "?", "...", "\"", "”", "»", "—", "-", "–", "’", ",", "(", "9",
]


@pytest.mark.parametrize(
    "text, count",
    [
        ("Hello world. How are you? I am fine!", 3),
        ("—¿Adónde vas? —preguntó Juan. Ya es tarde.", 2),
        ("El Sr. González y la Sra. Martínez hablaron con D. Pedro.", 1),
        ("U.S.A. Then we left.", 2),
        ("He left. then back.", 1),
        ("Foo. être là.", 2),
        ("... Then he ran.", 1),
        ('He said "Hi." Then left.', 2),
        ("Is it no. Yes.", 1),
        ("(Sr. López) came.", 2),
        ("   ", 0),
    ],
)
def test_sentence_counts(spark, text, count):
    assert len(apply(spark, [text], S.split_sentences)[0]) == count


def test_sentences_match_plain_walk(spark):
    texts = random_texts(7, 3000, PIECES, 40)
    assert apply(spark, texts, S.split_sentences) == [plain.sentences(t) for t in texts]


@pytest.mark.parametrize("limit", [1, 8, 25, 500])
def test_chunks_match_plain_walk(spark, limit):
    texts = random_texts(limit, 1500, [*PIECES, f"\n{SCENE}\n", f"\n{TITLE}\n", f"{SCENE}"], 40)
    assert apply(spark, texts, lambda t: S.chunk_array(t, limit)) == [plain.chunks(t, limit) for t in texts]


OWN_MARKS = ["\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4", "\ufdd5", "\ufdd0\ufdd0", "\ufdd2\ufdd3"]


def test_texts_that_hold_the_marks(spark):
    golden = "Keep \ufdd0 here \ufdd1 now. Two. \ufdd1"
    assert apply(spark, [golden], S.split_sentences) == [["Keep \ufdd0 here \ufdd1 now.", "Two.", "\ufdd1"]]
    assert apply(spark, [golden], lambda t: S.chunk_array(t, 500)) == [[golden]]
    assert apply(spark, [golden], lambda t: S.chunk_array(t, 21)) == [["Keep \ufdd0 here \ufdd1 now.", "Two. \ufdd1"]]
    texts = random_texts(5, 1500, [*PIECES, *OWN_MARKS, f"\n{SCENE}\n"], 40)
    assert apply(spark, texts, S.split_sentences) == [plain.sentences(t) for t in texts]
    for limit in (1, 8, 25, 500):
        assert apply(spark, texts, lambda t, n=limit: S.chunk_array(t, n)) == [plain.chunks(t, limit) for t in texts]
    plain_texts = [t for t in texts if SCENE not in t]
    handler = table_functions.ChunkText()
    assert [[c[2] for c in handler.eval(t, 25)] for t in plain_texts] == [plain.chunks(t, 25) for t in plain_texts]


def test_sections_of_a_page_that_holds_the_marks(spark):
    page = "<h1>A\ufdd0b</h1>one\ufdd1two<h2>C\ufdd2\ufdd3</h2>three\ufdd0"
    df = spark.createDataFrame([(page,)], "markup string")
    got = [tuple(r) for r in markup.heading_rows(df).select("title", "markup").collect()]
    assert got == [("A\ufdd0b", "one\ufdd1two"), ("C\ufdd2\ufdd3", "three\ufdd0")]


def test_chunk_table_function(spark):
    table_functions.register(spark)
    texts = random_texts(3, 300, [*PIECES, f"\n{SCENE}\n"], 30)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").createOrReplaceTempView("t")
    rows = spark.sql("SELECT i, c.* FROM t, LATERAL chunk_text(t.t, 20) c").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.i, r.chunk_idx)):
        got.setdefault(r.i, []).append(SCENE if r.kind == "scene_break" else r.text)
    assert [got.get(i, []) for i in range(len(texts))] == [plain.chunks(t, 20) for t in texts]


def test_chunk_limit_from_a_column(spark):
    df = spark.createDataFrame([("Uno. Dos. Tres.", 8), ("Uno. Dos. Tres.", 100)], "t string, n int")
    rows = df.select("n", S.chunk_array(F.col("t"), F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in rows} == {8: ["Uno.", "Dos.", "Tres."], 100: ["Uno. Dos. Tres."]}


def test_long_sentence_is_its_own_chunk(spark):
    long = "X" * 200 + "."
    assert apply(spark, [f"Uno. {long} Dos."], lambda t: S.chunk_array(t, 100)) == [["Uno.", long, "Dos."]]
    with pytest.raises(ValueError):
        S.chunk_array(F.lit("x"), 0)


def test_very_long_text(spark):
    text = " ".join(f"Satz {i}. und weiter." for i in range(60000))
    assert apply(spark, [text], S.split_sentences) == [plain.sentences(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("A\n***\nB", f"A\n{SCENE}\nB"),
        ("A\n---\nB", f"A\n{SCENE}\nB"),
        ("A\n• • •\nB", f"A\n{SCENE}\nB"),
        ("Capítulo 5", TITLE),
        ("CAPÍTULO 5", TITLE),
        ("Cap 3", TITLE),
        ("Cap.3", "Cap.3"),
        ("Chapter One", "Chapter One"),
        ("Page 1\nReal text.\nCopyright © 2020", "Real text."),
        ("PAGE 1", "PAGE 1"),
        ("— 123 —", ""),
        ("mix", ""),
        ("ÍNDICE", ""),
        ("Text\nAll rights reserved.", "Text"),
        ("- Hola, dijo él.", "— Hola, dijo él."),
        ("¿ Cómo estás ?", "¿Cómo estás ?"),
        ("Bueno . . . sí.", "Bueno ... sí."),
        ("Bueno..... sí.", "Bueno... sí."),
        ("«a» “b” ‘c’", "\"a\" \"b\" 'c'"),
        ("a\n \nb", "a\n\nb"),
        ("A -\nPage 3", "A -"),
        ("x -\n***", f"x — {SCENE}"),
        ("a  \t b\n\n\ne \n f", "a b\ne\nf"),
        ("a\r\nb\u2028e\x0bf", "a\nb\ne\nf"),
        ("no -!", "no —!"),
        ("", ""),
    ],
)
def test_normalize(spark, text, expected):
    assert apply(spark, [text], N.normalize) == [expected]


def test_strip_and_words_follow_python(spark):
    texts = random_texts(11, 800, ["a", "bc", "ß", *plain.BLANKS], 25)
    assert apply(spark, texts, U.ustrip) == [t.strip() for t in texts]
    assert apply(spark, texts, U.count_words) == [len(t.split()) for t in texts]
    assert apply(spark, texts, U.split_lines) == [t.splitlines() for t in texts]


def test_markers_drop_and_kind(spark):
    texts = [f"a\n{SCENE}\nb", SCENE, f"{TITLE}\nx", "plain"]
    assert apply(spark, texts, N.drop_markers) == ["a\nb", "", "x", "plain"]
    assert apply(spark, [SCENE, TITLE, "x"], N.chunk_kind) == ["scene_break", "chapter_title", "text"]
    assert apply(spark, ["***", "Cap 2", "vii", "  ", "Hi"], N.line_kind) == [
        "scene_break", "chapter_title", "noise", "blank", "text",
    ]


def test_normalize_is_stable(spark):
    texts = random_texts(5, 400, [*PIECES, "\n***\n", "\nPage 4\n", "\n- "], 30)
    once = apply(spark, texts, N.normalize)
    assert once == apply(spark, texts, N.normalize)
