"""Keywords in the tasks that hold the documents: the results of the word tables, and no row per word is moved."""

import random

import pytest

from talkspan import params as pm
from talkspan.operators import embeddings as em
from talkspan.operators import hours as hr
from talkspan.operators import keywords as kw
from talkspan.operators import topics as tp
from talkspan.sources import messages as ms

WORDS = "train travel hotel flight food soup bread sport games team match football the of x été 2024 zug".split()
MODES = (pm.BASELINE, pm.MIXED, pm.BAG_OF_WORDS, pm.FULL_TEXT)


def model_for(spark, mode, **options):
    main, own = em.HashProvider(24), em.HashProvider(16)
    side = own if mode == pm.BASELINE else main
    topics = ms.topics_frame(spark, ("Travel", "Food", "Sports"))
    return kw.keyword_model(mode, main, own, tp.topic_space(em.embed_topics(topics, side), side.dim), **options)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of 0 to 30 words, some as several rows; null texts, a null key, a text of stop words."""
    rng = random.Random(5)
    rows = [(i % 23, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(30, None), (31, "the of"), (32, "été été 2024"), (None, "train hotel"), (33, "Hotel!"), (33, None)]
    return hr.with_words(spark.createDataFrame(rows, "id bigint, text string")).persist()


@pytest.fixture(params=[2, 10_000])
def batch(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield request.param
    spark.conf.set(name, before)


@pytest.mark.parametrize("mode", MODES)
def test_tasks_and_word_tables_agree(spark, docs, batch, mode):
    for top_n in (3, None):
        model = model_for(spark, mode, top_n=top_n)
        counted = kw.counts(docs, ["id"])

        def listed(df):
            cols = [c for c in ("id", "rank", "keyword", "relevance", "freq", "vec")]
            return sorted(tuple(r) for r in df.select(*cols).collect())

        assert listed(kw.extract(docs, ["id"], model)) == listed(kw.extract(docs, ["id"], model, counted))
        found, want = (listed(kw.weighted_keywords(docs, ["id"], model, c)) for c in (None, counted))
        assert found == want and found

        def shares(df):
            return sorted((r.id is None, r.id, [round(x, 9) for x in r.p]) for r in df.collect())

        assert shares(kw.score(docs, ["id"], model)) == shares(kw.score(docs, ["id"], model, counted))


def test_no_word_table_is_made(spark, docs, monkeypatch):
    monkeypatch.setattr(kw, "counts", None)
    monkeypatch.setattr(kw, "lexicon", None)
    p = kw.score(docs, ["id"], model_for(spark, pm.BASELINE))
    assert p.count() == docs.count()
    assert "explode" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_documents_in_order_are_not_moved_again(spark, docs):
    rows = docs.select("id", "text").repartition("id").sortWithinPartitions("id")
    found = kw.extract(hr.with_words(rows), ["id"], model_for(spark, pm.BASELINE))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_empty_documents(spark, docs):
    model = model_for(spark, pm.FULL_TEXT)
    assert kw.score(docs.limit(0), ["id"], model).collect() == []
    assert kw.extract(docs.where("text IS NULL"), ["id"], model).collect() == []


def test_texts_are_hashed_where_they_are(spark, tmp_path):
    from catalog import texts

    rows = [(1, "en", "train hotel"), (1, "en", "train hotel"), (2, "de", "zug"), (3, None, None), (None, "en", "food")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, want in ((texts.score_clean_cosine, [None, 1, 1, 2, 3]), (texts.score_hybrid, [1, 1, 1, 1, 2])):
        found = query(spark, str(tmp_path))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [text_hash" not in plan
        ids = [r.doc_id for r in found.where("topic_idx = 0").collect()]
        assert sorted(ids, key=lambda x: (x is not None, x)) == want
