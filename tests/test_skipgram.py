import heapq
import itertools
import random

import numpy as np

from talkspan.operators import embeddings as em
from talkspan.operators import skipgram as sg


def depth_total(counts):
    """Sum of count times depth in a Huffman tree."""
    heap, total = sorted(counts), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def test_tree_of_equal_counts_is_a_huffman_tree():
    rng = random.Random(3)
    for n in (1, 2, 3, 5, 17, 400):
        counts = sorted((rng.choice((1, 1, 1, 2, 2, 3, 7, 50)) for _ in range(n)), reverse=True)
        tree = sg.Huffman([(c, len(list(g))) for c, g in itertools.groupby(counts)])
        nodes, sides = tree.paths(np.arange(n))
        assert sum(c * d for c, d in zip(counts, (nodes >= 0).sum(axis=1))) == depth_total(counts)
        ways = {tuple(zip(p[p >= 0].tolist(), s[p >= 0].tolist())) for p, s in zip(nodes, sides)}
        assert len(ways) == n  # no two words share a way
        assert set(nodes[nodes >= 0].tolist()) == set(range(n - 1))


GROUPS = (["cat", "dog", "bird", "fish"], ["ship", "sail", "sea", "port"])


def corpus(spark, n=600):
    rng = random.Random(5)
    rows = [([rng.choice(GROUPS[i % 2]) for _ in range(30)] + [f"once{i}"],) for i in range(n)]
    return spark.createDataFrame([*rows, ([],), (None,), ([None, "cat"],)], "words array<string>").repartition(3).cache()


def cosine(a, b):
    return np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)


def test_words_beyond_the_driver_are_learned_spread(spark, monkeypatch):
    monkeypatch.setattr(em.Word2VecProvider, "DRIVER_WORDS", 7)
    monkeypatch.setattr(sg, "PART_WORDS", 8_000)
    docs = corpus(spark)
    provider = em.make_provider("word2vec", corpus=docs, dim=8, partitions=1)
    assert provider.model is None  # nothing on the driver
    vecs = {r.word: r.vec for r in provider.learned.collect()}
    assert set(vecs) == {*GROUPS[0], *GROUPS[1], *(f"once{i}" for i in range(600))}
    same = [cosine(vecs[a], vecs[b]) for g in GROUPS for a, b in itertools.combinations(g, 2)]
    other = [cosine(vecs[a], vecs[b]) for a in GROUPS[0] for b in GROUPS[1]]
    assert min(same) > max(other)
    again = em.make_provider("word2vec", corpus=docs, dim=8, partitions=1)
    assert {r.word: r.vec for r in again.learned.collect()} == vecs
    texts = spark.createDataFrame([("cat dog cat",), ("absent",)], "text string")
    got = {r.text: r.vec for r in em.embed_texts(texts, provider).collect()}
    assert got["cat dog cat"] == [2 * a + b for a, b in zip(vecs["cat"], vecs["dog"])]
    assert got["absent"] == [0] * 8


def test_rare_words_are_left_out_when_asked(spark, monkeypatch):
    monkeypatch.setattr(em.Word2VecProvider, "DRIVER_WORDS", 7)
    provider = em.make_provider("word2vec", corpus=corpus(spark), dim=4, min_count=2)
    assert {r.word for r in provider.learned.collect()} == {*GROUPS[0], *GROUPS[1]}
