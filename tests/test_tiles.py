from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import types as T

from talkspan.functions import vectors as vx
from talkspan.operators import lda as ld
from talkspan.operators import tiles as ti

ROWS = "id long, vec array<double>, extra string"
TOPICS = "topic_idx long, vec array<double>, id string"


def sample(n_rows=40, n_topics=23, dim=4):
    rng = np.random.default_rng(9)
    vecs, topics = rng.normal(size=(n_rows, dim)).round(1), rng.normal(size=(n_topics, dim)).round(1)
    vecs[3] = 0
    topics[5] = 0
    topics[11] = 2 * topics[10]  # equal cosines
    vecs[-1] = vecs[0]
    return vecs, topics


def frames(spark, vecs, topics):
    left = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in enumerate(vecs)], ROWS)
    right = spark.createDataFrame([(i, [float(x) for x in v], "t") for i, v in enumerate(topics)], TOPICS)
    return left, right


def cosines(vecs, topics):
    return vx.unit_rows(vecs) @ vx.unit_rows(topics).T


@pytest.mark.parametrize("in_block, in_tile", [(7, 5), (1_000, 1_000), (3, 23), (40, 1)])
def test_tiles_give_every_cosine(spark, in_block, in_tile):
    vecs, topics = sample()
    left, right = frames(spark, vecs, topics)
    rows = ti.similarities(left, right, len(topics), "id", in_block=in_block, in_tile=in_tile).collect()
    assert len(rows) == len({(r.id, r.topic_idx) for r in rows}) == vecs.shape[0] * topics.shape[0]
    sims = cosines(vecs, topics)
    assert all(abs(r.sim - sims[r.id, r.topic_idx]) < 1e-12 for r in rows)


@pytest.mark.parametrize("k", [1, 4, 100])
@pytest.mark.parametrize("in_block, in_tile", [(7, 5), (1_000, 1_000)])
def test_best_topics_and_softmax_over_tiles(spark, k, in_block, in_tile):
    vecs, topics = sample()
    left, right = frames(spark, vecs, topics)
    found = ti.top_topics(left, right, len(topics), k, "id", in_block=in_block, in_tile=in_tile).collect()
    sims = cosines(vecs, topics)
    p = vx.softmax_rows(sims)
    for i in range(len(vecs)):
        best = sorted(range(len(topics)), key=lambda t: (-np.floor(sims[i, t] * 1e9 + 0.5), t))[:k]
        mine = sorted((r for r in found if r.id == i), key=lambda r: r.rank)
        assert [r.topic_idx for r in mine] == best and [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert np.allclose([r.p for r in mine], p[i, best], rtol=1e-12)


def test_large_cosine_sums_do_not_depend_on_tiles(spark):
    vecs, topics = sample(5, 300)
    left, right = frames(spark, vecs, topics)
    one = ti.top_topics(left, right, 300, 2, "id").orderBy("id", "rank").collect()
    many = ti.top_topics(left, right, 300, 2, "id", in_block=2, in_tile=11).orderBy("id", "rank").collect()
    assert [(r.id, r.topic_idx) for r in one] == [(r.id, r.topic_idx) for r in many]
    assert np.allclose([r.p for r in one], [r.p for r in many], rtol=1e-12)


def test_missing_vectors_numbers_and_empty_tables(spark):
    left = spark.createDataFrame([(1, None, "x"), (2, [1.0, None], "x"), (None, [0.0, 1.0], "x")], ROWS)
    right = spark.createDataFrame([(0, [2.0, 0.0], "t"), (1, None, "t"), (None, [1.0, 1.0], "t"), (7, [1.0, 1.0], "t")], TOPICS)
    got = {(r.id, r.topic_idx): r.sim for r in ti.similarities(left, right, 2, "id").collect()}
    assert got == {(1, 0): 0.0, (1, 1): 0.0, (2, 0): 1.0, (2, 1): 0.0, (None, 0): 0.0, (None, 1): 0.0}
    for a, b, n in ((left.limit(0), right, 2), (left, right.limit(0), 2), (left, right, 0)):
        assert ti.similarities(a, b, n, "id").collect() == []
        assert ti.top_topics(a, b, n, 3, "id").collect() == []
    with pytest.raises(ValueError):
        ti.similarities(left.withColumnRenamed("id", "_tile"), right, 2, "_tile")
    with pytest.raises(ValueError):
        ti.similarities(left, right, 2, "id", in_block=1 << 11, in_tile=1 << 11)


def test_a_row_is_copied_per_tile_not_per_topic(spark):
    vecs, topics = sample(40, 23)
    left, right = frames(spark, vecs, topics)
    copies = spark.sparkContext.accumulator(0)

    def seen(rows, *rest):
        copies.add(rows.num_rows)
        return rows.append_column("n", [[1] * rows.num_rows])

    n = T.StructField("n", T.LongType())
    assert ti._products(left, right, 23, ("id",), "vec", 16, 8, seen, [n]).count() == 40 * 3
    assert copies.value == 40 * 3


def test_the_best_of_many_tiles_move_once_a_piece(spark, monkeypatch):
    vecs, topics = sample(40, 23)
    left, right = frames(spark, vecs, topics)
    moved, products = [], ti._products

    def seen(df, tops, n, keys, vec, in_block, in_tile, *rest):
        out = products(df, tops, n, keys, vec, in_block, in_tile, *rest)
        moved.append(out.count())
        return out

    monkeypatch.setattr(ti, "_products", seen)
    few = ti.top_topics(left, right, 23, 3, "id", in_block=4, in_tile=2).orderBy("id", "rank").collect()
    monkeypatch.setattr(ti, "TOPICS_TOGETHER", 9)  # four tiles of two
    some = ti.top_topics(left, right, 23, 3, "id", in_block=4, in_tile=2).orderBy("id", "rank").collect()
    assert moved == [40, 40 * 3]  # not once for each of the twelve tiles
    assert [(r.id, r.topic_idx) for r in few] == [(r.id, r.topic_idx) for r in some]
    assert np.allclose([r.p for r in few], [r.p for r in some], rtol=1e-12)


DOCS = [
    (1, ["cat", "dog", "cat"]),
    (2, ["dog", "bird", "cat", "bird"]),
    (3, ["ship", "sail", "ship"]),
    (4, ["sail", "sea", "ship", "sea"]),
    (5, []),
    (6, None),
    (7, ["cat", "dog", "cat"]),
]


def documents(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, words array<string>, counts string")


def test_no_two_words_share_a_column(spark):
    docs = documents(spark)
    numbers = ld.numbering(docs, ["doc_id"])
    names = [r.word for r in numbers.orderBy("word_id").collect()]
    assert names == sorted({w for _, ws in DOCS for w in ws or []})
    rows = ld.vectors(docs, ["doc_id"], numbers, len(names)).select("doc_id", vector_to_array("counts").alias("v")).collect()
    assert {r.doc_id: {names[i]: n for i, n in enumerate(r.v) if n} for r in rows} == {d: dict(Counter(ws or [])) for d, ws in DOCS}
    assert all(len(r.v) == len(names) for r in rows)


def test_topics_can_be_listed_and_unknown_words_are_uniform(spark):
    docs = documents(spark, [(i, DOCS[i % 4][1] * 20) for i in range(40)])
    numbers, model = ld.fit(docs, ["doc_id"], 2, passes=30)
    words = ld.topic_words(numbers, model, 3).collect()
    assert sorted((r.topic_idx, r.rank) for r in words) == [(t, r) for t in (0, 1) for r in (1, 2, 3)]
    groups = {t: {r.word for r in words if r.topic_idx == t} for t in (0, 1)}
    assert sorted(map(sorted, groups.values())) == [["bird", "cat", "dog"], ["sail", "sea", "ship"]]
    new = documents(spark, [(1, ["cat", "cat", "cat", "dog", "unseen"]), (2, ["unseen"]), (3, None)])
    p = {r.doc_id: r.p for r in ld.score(new, ["doc_id"], numbers, model).collect()}
    animals = next(t for t in groups if "cat" in groups[t])
    assert p[1][animals] > 0.6 and p[2] == p[3] == [0.5, 0.5]


def test_rare_words_leave_the_model_only_when_asked(spark):
    docs = documents(spark)
    kept = {r.word for r in ld.numbering(docs, ["doc_id"], least_docs=2).collect()}
    assert kept == {"cat", "dog", "ship", "sail"}
    with pytest.raises(ValueError):
        ld.fit(documents(spark, DOCS[4:6]), ["doc_id"], 2)


def test_too_large_a_model_is_refused(spark, monkeypatch):
    monkeypatch.setattr(ld, "MAX_MODEL_NUMBERS", 5)
    with pytest.raises(ValueError, match="least_docs"):
        ld.fit(documents(spark), ["doc_id"], 2)
