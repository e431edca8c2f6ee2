import pytest
from pyspark.sql import functions as F

from talkspan import params as pm
from talkspan.functions import text as tx
from talkspan.functions import vectors as vx
from talkspan.operators import embeddings as em
from talkspan.operators import vocab as vo


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("A-b 9x", ["b", "x"]),
        ("The cats; the DOGS", ["cats", "dogs"]),
        ("café naïve", ["caf", "na", "ve"]),
        ("   ", []),
        ("", []),
        (None, []),
        ("of the and", []),
    ],
)
def test_clean_words(spark, text, expected):
    assert one(spark, tx.clean_words(F.lit(text).cast("string"))) == expected


def test_clean_words_without_stop_words(spark):
    assert one(spark, tx.clean_words(F.lit("A-b 9x"), stop_words=())) == ["a", "b", "x"]


def test_missing_text_may_count_as_a_word(spark):
    text = tx.message_text(F.lit(None).cast("string"), "nan")
    assert one(spark, tx.clean_words(text)) == ["nan"]


def test_tokens_keep_accents_digits_and_repeats(spark):
    assert one(spark, tx.tokens(F.lit("Été 42 a été x_1"))) == ["été", "42", "été", "x_1"]


def test_strip_transcript(spark):
    text = "  user :: room [2024-01-01 10:00:00]: hello there \n\n  no prefix\nu :: r [x]:   end "
    assert one(spark, tx.strip_transcript(F.lit(text))) == "hello there no prefix end"


@pytest.mark.parametrize(
    "seconds, expected",
    [
        (0, "0:00:00"),
        (3661, "1:01:01"),
        (86405, "1 day, 0:00:05"),
        (172800, "2 days, 0:00:00"),
        (-1, "-1 day, 23:59:59"),
    ],
)
def test_duration_text(spark, seconds, expected):
    assert one(spark, tx.duration_text(F.lit(seconds).cast("long"))) == expected


def test_softmax_and_cosine_edges(spark):
    zeros = F.array(*[F.lit(0.0)] * 4)
    assert one(spark, vx.softmax(zeros)) == [0.25] * 4
    assert one(spark, vx.softmax(F.array(F.lit(1000.0), F.lit(0.0)))) == [1.0, 0.0]
    assert one(spark, vx.cosine(zeros, zeros)) == 0.0
    assert one(spark, vx.unit(zeros)) == [0.0] * 4
    assert one(spark, vx.dot_of(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)), 2)) == 11.0


def test_lemma_map(spark):
    known = spark.createDataFrame([(w,) for w in "cat bus wolf church man city glass".split()], "word string")
    words = spark.createDataFrame(
        [(w,) for w in "cats buses wolves churches men cities glass unknowns cat".split()], "word string"
    )
    found = {r.word: r.lemma for r in vo.lemma_map(words, known).collect()}
    assert found == {
        "cats": "cat", "buses": "bus", "wolves": "wolf", "churches": "church", "men": "man",
        "cities": "city", "glass": "glass", "unknowns": "unknowns", "cat": "cat",
    }


def edits(word):
    """Every form one edit away (letters a to e are enough here)."""
    letters = "abcde"
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return (
        {a + b[1:] for a, b in cut if b}
        | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1}
        | {a + c + b[1:] for a, b in cut if b for c in letters}
        | {a + c + b for a, b in cut for c in letters}
    )


def test_spell_map_against_brute_force(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    dictionary = {word(): rng.randint(1, 50) for _ in range(25)}
    words = {word() for _ in range(120)} | set(list(dictionary)[:5])

    def best(w):
        if w in dictionary:
            return w
        for ring in (edits(w), {y for x in edits(w) for y in edits(x)}):
            hits = [c for c in dictionary if c in ring]
            if hits:
                return min(hits, key=lambda c: (-dictionary[c], c))
        return w

    found = vo.spell_map(
        spark.createDataFrame([(w,) for w in words], "word string"),
        spark.createDataFrame(list(dictionary.items()), "word string, n long"),
    )
    assert {r.word: r.fixed for r in found.collect()} == {w: best(w) for w in words}


def test_map_words_keeps_order_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "id long, words array<string>")
    mapping = spark.createDataFrame([("b", "z")], "word string, lemma string")
    found = {r.id: r.words for r in vo.map_words(docs, ["id"], mapping, "lemma", ()).collect()}
    assert found == {1: ["z", "a", "z"], 2: []}


def test_text_similarity_ignores_case(spark):
    pairs = spark.createDataFrame([("Hello World", "hello world"), ("abc", "")], "left string, right string")
    found = {r.left: r.similarity for r in em.text_similarity(pairs, em.HashProvider(16)).collect()}
    assert found["Hello World"] == pytest.approx(1.0)
    assert found["abc"] == 0.0


def test_embed_texts_asks_the_provider_only_for_misses(spark):
    texts = spark.createDataFrame([("known",), ("new",), ("new",)], "text string")
    store = spark.createDataFrame([("known", [1, 2])], "text string, vec array<bigint>").withColumn(
        "text_hash", tx.text_key(F.col("text"))
    )
    found = {r.text: (r.vec, r.stored) for r in em.embed_texts(texts, em.HashProvider(2), store).collect()}
    assert found["known"] == ([1, 2], True)
    assert set(found) == {"known", "new"} and found["new"][1] is False
    assert em.hit_rate(em.embed_texts(texts, em.HashProvider(2), store)).first()["hit_rate"] == 0.5


def test_unknown_provider():
    with pytest.raises(ValueError):
        em.make_provider("nothing")


def test_params_are_validated():
    with pytest.raises(ValueError):
        pm.RunParams(threshold=1.0)
    with pytest.raises(ValueError):
        pm.RunParams().with_(threshold=0.0)
    with pytest.raises(ValueError):
        pm.RunParams(mode="nothing")
    assert pm.RunParams().scoring_mode == pm.BASELINE
    assert pm.RunParams(provider=pm.REMOTE_PROVIDER).scoring_mode == pm.MIXED
    assert pm.RunParams().is_selective
    assert not pm.RunParams(topics=tuple("abcdefghijklmn")).is_selective
    assert pm.parse_topics("News, Food ,Sports") == ("News", "Food", "Sports")
    assert pm.RunParams(topics=("b", "a")).fingerprint == pm.RunParams(topics=("a", "b"), threshold=0.5).fingerprint
    assert pm.RunParams().fingerprint != pm.RunParams(labelled_set="x").fingerprint
