import datetime as dt
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkspan import params as pm
from talkspan.functions.stopwords import DEFAULT_STOP_WORDS
from talkspan.operators import embeddings as em
from talkspan.operators import hours as hr
from talkspan.operators import keyword_blocks as kb
from talkspan.operators import keywords as kw
from talkspan.operators import topics as tp
from talkspan.operators.vocab import numbered
from talkspan.plans import jobs
from talkspan.sources import messages as ms

TOPICS = ("Travel", "Food", "Sports")
VOCABULARY = (
    "train travel hotel flight food soup bread dinner sport sports game team match football pizza city "
    "the and of a is you été x"
).split()
T0 = dt.datetime(2024, 1, 1)


def word_vector(word, dim):
    v = np.zeros(dim)
    padded = f"#{word}#"
    for i in range(len(padded) - 2):
        code = int(hashlib.md5(padded[i : i + 3].encode()).hexdigest()[:8], 16)
        v[code % dim] += 1e6 if (code // dim) % 2 == 0 else -1e6
    return v


def text_vector(tokens, dim):
    return np.sum([word_vector(t, dim) for t in tokens], axis=0) if tokens else np.zeros(dim)


def cosine(a, b):
    size = np.sqrt((a**2).sum()) * np.sqrt((b**2).sum())
    return float(a @ b / size) if size else 0.0


def tokens_of(text):
    return re.findall(r"\w\w+", text.lower())


def clean(text):
    return [w for w in re.sub("[^A-Za-z]", " ", text).lower().split() if w not in DEFAULT_STOP_WORDS]


def probability(text, words, mode):
    """The scoring rule restated for one text."""
    own, other = 16, 24
    tokens = tokens_of(text)
    doc = text_vector(tokens, own)
    candidates = sorted({t for t in tokens if t not in DEFAULT_STOP_WORDS})
    rank = sorted(((-math.floor(cosine(word_vector(c, own), doc) * 1e4 + 0.5) / 1e4, c) for c in candidates))
    space = own if mode in (pm.BASELINE, pm.HYBRID) else other
    counts = Counter(words)
    scores = np.zeros(len(TOPICS))
    for negative, word in rank[: min(len(words), 20)]:
        relevance = -negative
        if mode == pm.BAG_OF_WORDS:
            relevance = cosine(word_vector(word, space), text_vector(tokens_of(" ".join(words)), space))
        if mode == pm.FULL_TEXT:
            relevance = cosine(word_vector(word, space), text_vector(tokens, space))
        for k, topic in enumerate(TOPICS):
            scores[k] += cosine(word_vector(word, space), word_vector(topic.lower(), space)) * relevance * counts[word]
    e = np.exp(scores - scores.max())
    return e / e.sum()


def walk(hours, topic, t, mode):
    score = lambda block: probability(
        " ".join(x for _, x, _ in block), [w for _, _, ws in block for w in ws], mode
    )[topic]
    good = lambda block: round(score(block), 9) >= t
    blocks, curr = [], []
    for h in hours:
        if not good([h]):
            if curr:
                blocks.append(curr)
            curr = []
        elif curr and good(curr + [h]):
            curr = curr + [h]
        else:
            if curr:
                blocks.append(curr)
            curr = [h]
    if curr:
        blocks.append(curr)
    return [([h for h, _, _ in b], round(score(b), 6)) for b in blocks]


@pytest.fixture(scope="module")
def chat(spark):
    rng = random.Random(2)
    rows = []
    for u in range(5):
        for h in range(30):
            if rng.random() < 0.7:
                for _ in range(rng.randint(1, 3)):
                    text = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 6)))
                    rows.append((len(rows), "room", f"u{u}", T0 + dt.timedelta(hours=h, seconds=rng.randint(0, 3599)), text, ""))
    frame = spark.createDataFrame(
        rows, "row_id long, chatroom string, sender string, ts timestamp_ntz, text string, prompt string"
    )
    cells = {}
    for _, _, u, ts, text, _ in rows:
        h = int((ts - T0).total_seconds() // 3600)
        old = cells.get((u, h))
        cells[(u, h)] = (old[0] + " " + text, old[1] + clean(text)) if old else (text, clean(text))
    return frame.persist(), cells


def model_for(spark, mode):
    own, other = em.HashProvider(16), em.HashProvider(24)
    side = own if mode in (pm.BASELINE, pm.HYBRID) else other
    space = tp.topic_space(em.embed_topics(ms.topics_frame(spark, TOPICS), side), side.dim)
    return kw.keyword_model(mode, other, own, space)


@pytest.mark.parametrize("mode", [pm.BASELINE, pm.MIXED, pm.BAG_OF_WORDS, pm.FULL_TEXT, pm.HYBRID])
def test_scores_and_blocks_against_brute_force(spark, chat, mode):
    frame, cells = chat
    hours = hr.hour_texts(hr.with_words(ms.with_hours(frame, "2024-01-01", "2024-01-02"))).persist()
    model = model_for(spark, mode)
    scored = kb.score_hours(hours, model).persist()
    p = {(r.sender, r.hour_idx): r.p for r in scored.collect()}
    active = {k: v for k, v in cells.items() if v[1]}
    assert set(p) == set(active)
    for key, (text, words) in active.items():
        assert p[key] == pytest.approx(probability(text, words, mode), abs=1e-9)
    t = 0.36
    got = {}
    found = kb.keyword_blocks(hours, scored, model, t).orderBy("sender", "topic_idx", "block_no").collect()
    for r in found:
        got.setdefault((r.sender, r.topic_idx), []).append((r.hour_idxs, round(r.p, 6)))
    expected, longest = {}, 0
    for u in sorted({u for u, _ in active}):
        mine = [(h, *active[(u, h)]) for h in sorted(h for x, h in active if x == u)]
        for k in range(len(TOPICS)):
            blocks = walk(mine, k, t, mode)
            if blocks:
                expected[(u, k)] = blocks
                longest = max(longest, *[len(b) for b, _ in blocks])
    assert got == expected and longest > 1
    alone = kb.keyword_blocks(hours, None, model, t, lots=3)  # scored on the way, several lots of senders
    assert {(r.sender, r.topic_idx, r.block_no, tuple(r.hour_idxs), round(r.p, 6)) for r in alone.collect()} == {
        (r.sender, r.topic_idx, r.block_no, tuple(r.hour_idxs), round(r.p, 6)) for r in found
    }


def test_words_are_numbered_without_gaps_in_order(spark):
    words = spark.createDataFrame([("b",), ("a",), ("é",), ("b",), ("",), ("zz",)], "word string").repartition(4)
    got = sorted((r.word_id, r.word) for r in numbered(words).collect())
    assert got == list(enumerate(["", "a", "b", "zz", "é"]))
    assert numbered(words.where("word = '-'")).count() == 0


def test_spelling_and_lemmas_on_counts_give_the_words_of_the_lists(spark, chat):
    frame, _ = chat
    dictionary = spark.createDataFrame([(w, 10) for w in VOCABULARY if len(w) > 2], "word string, n long")
    typos = frame.withColumn("text", F.regexp_replace("text", "travel", "travle games"))
    inside = ms.with_hours(typos, "2024-01-01", "2024-01-02")
    params = pm.RunParams(topics=TOPICS, threshold=0.34, mode=pm.BASELINE, spell_check=True, stop_words=("the", "game"))
    lists = hr.hour_texts(jobs.cleaned(inside, ["row_id"], params, dictionary)).where("n_words > 0").persist()
    cells, counted = jobs.keyword_cells(inside, params, dictionary)
    assert {(r.sender, r.hour_idx): r.n_words for r in cells.collect()} == {
        (r.sender, r.hour_idx): r.n_words for r in lists.collect()
    }
    expected = {(r.sender, r.hour_idx, w): n for r in lists.collect() for w, n in Counter(r.words).items()}
    got = {(r.sender, r.hour_idx, r.word): r.n_word for r in counted.where("n_word > 0").collect()}
    assert got == expected and not {"game", "games", "travle"} & {w for _, _, w in got}
    run = jobs.analyse(typos, params, em.HashProvider(16), dictionary=dictionary)
    model = kw.keyword_model(
        pm.BASELINE, em.HashProvider(16), em.HashProvider(16), model_for(spark, pm.BASELINE).topics,
        top_n=params.top_keywords, stop_words=params.stop_words,
    )
    plain = kb.keyword_blocks(lists, kb.score_hours(lists, model), model, params.threshold)
    columns = ("sender", "topic_idx", "block_no", "start_ord", "end_ord")
    assert {tuple(r) for r in run.blocks.select(*columns).collect()} == {tuple(r) for r in plain.select(*columns).collect()}
    run.release()


@pytest.fixture(params=[3, 10_000])
def batch(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield request.param
    spark.conf.set(name, before)


def walked(frame, params, provider):
    run = jobs.analyse(frame, params, em.HashProvider(16), provider)
    rows = {
        (r.sender, r.topic_idx, r.block_no, r.start_ord, r.end_ord, r.n_msgs, round(r.p, 9)) for r in run.blocks.collect()
    }
    run.release()
    return rows


@pytest.mark.parametrize("mode", [pm.BASELINE, pm.BAG_OF_WORDS, pm.FULL_TEXT])
def test_words_counted_in_the_walk_give_the_blocks_of_word_tables(spark, chat, batch, mode, monkeypatch):
    frame, _ = chat
    plural = frame.withColumn("text", F.regexp_replace("text", "travel", "hotels foods travel été ways"))
    odd = plural.withColumn("text", F.when(F.col("row_id") % 11 == 0, None).otherwise(F.col("text")))
    odd = odd.withColumn("sender", F.when(F.col("sender") != "u1", F.col("sender")))  # one sender without a name
    params = pm.RunParams(topics=TOPICS, threshold=0.34, mode=mode, stop_words=("the", "bread"))
    with monkeypatch.context() as m:
        m.setattr(jobs, "keyword_cells", None)  # no row per cell and word
        m.setattr(kw, "counts", None)
        m.setattr(kb, "_lexicon", None)
        got = walked(odd, params, em.HashProvider(24))
        gated = walked(odd, params.with_(prefilter=0.1, lemmatize=False), em.HashProvider(24))
    monkeypatch.setattr(jobs.kt, "fits", lambda model: False)
    assert got == walked(odd, params, em.HashProvider(24)) and max(e - s for _, _, _, s, e, _, _ in got) > 0
    assert gated == walked(odd, params.with_(prefilter=0.1, lemmatize=False), em.HashProvider(24))


def test_words_are_hashed_alike_in_tables_and_tasks(spark):
    words = ["a", "zug", "été", "𝒳y", "a#", "2024", "banana"] * 3
    table = {r.word: r.vec for r in em.hashed_words(spark.createDataFrame([(w,) for w in set(words)], "word string"), 24).collect()}
    assert em._HashedWords(24).vectors(words).tolist() == [table[w] for w in words]
    few = em._HashedWords(24)
    few.KEPT, few.AT_ONCE = 2, 3
    assert few.vectors(words).tolist() == [table[w] for w in words]


def test_no_keywords_means_uniform(spark):
    docs = hr.with_words(spark.createDataFrame([(1, "the of and"), (2, "é"), (3, None)], "id long, text string"))
    found = kw.score(docs, ["id"], model_for(spark, pm.BASELINE)).collect()
    assert len(found) == 3
    for r in found:
        assert r.p == pytest.approx([1 / 3] * 3)


@pytest.mark.parametrize("use_keywords", [False, True])
def test_whole_run(spark, chat, use_keywords):
    frame, cells = chat
    params = pm.RunParams(
        topics=TOPICS, threshold=0.34, use_keywords=use_keywords, lemmatize=False, mode=pm.BASELINE
    )
    run = jobs.analyse(frame, params, em.HashProvider(16))
    rows = run.with_transcripts().collect()
    assert rows and (run.start, run.end) == ("2024-01-01", "2024-01-02")
    for r in rows:
        assert r.chat_summary.count("\n") + 1 == r.n_msgs
        assert all((r.sender, h) in cells for h in r.hour_idxs)
    document = jobs.run_document(run, "r", "now", 2.0).first()
    assert document.quality.num_segments == len(rows)
    assert document.performance.total_messages == frame.count()
    assert sum(document.quality.topic_distribution.values()) == len(rows)
    run.release()


def test_direct_hours_equal_embedding_the_joined_text(spark, chat):
    frame, cells = chat
    worded = hr.with_words(ms.with_hours(frame, "2024-01-01", "2024-01-02"))
    for r in jobs.direct_hours(worded, em.HashProvider(16)).collect():
        assert np.array_equal(r.vec, text_vector(tokens_of(cells[(r.sender, r.hour_idx)][0]), 16))


def test_prefilter_only_removes_seeds(spark, chat):
    frame, _ = chat
    base = pm.RunParams(topics=TOPICS, threshold=0.34, use_keywords=False, lemmatize=False)
    seeds = []
    for gate in (0.0, 0.1, 0.3):
        run = jobs.analyse(frame, base.with_(prefilter=gate), em.HashProvider(16))
        hours = {(r.sender, r.topic_idx, h) for r in run.blocks.collect() for h in r.hour_idxs}
        run.release()
        seeds.append(hours)
    assert seeds[0] > seeds[1] > seeds[2]


def test_spelling_and_lemmas_in_a_run(spark, chat):
    frame, _ = chat
    typos = frame.withColumn("text", F.regexp_replace("text", "travel", "travle games"))
    words = [(w, 10) for w in VOCABULARY if len(w) > 2]
    dictionary = spark.createDataFrame([*words, ("games", 3)], "word string, n long")
    params = pm.RunParams(topics=TOPICS, spell_check=True)
    found = jobs.cleaned(typos, ["row_id"], params, dictionary).select(F.explode("words").alias("w")).distinct()
    seen = {r.w for r in found.collect()}
    assert "travel" in seen and "travle" not in seen
    assert "game" in seen and "games" not in seen
    with pytest.raises(ValueError):
        jobs.cleaned(typos, ["row_id"], params)


def test_labelled_accuracy(spark):
    rows = [(1, "u :: r [t]: train travel", "Travel"), (2, "u :: r [t]: food food", "Food"), (3, "sports", "Food")]
    samples = spark.createDataFrame(rows, "sample_id long, chat_summary string, truth string")
    params = pm.RunParams(topics=TOPICS, lemmatize=False)
    found = jobs.labelled_accuracy(samples, params, model=model_for(spark, pm.BASELINE))
    pred = {r.sample_id: r.pred for r in found["pairs"].collect()}
    assert pred == {1: "Travel", 2: "Food", 3: "Sports"}
    assert jobs.accuracy_row(found)["accuracy"] == round(2 / 3, 4)
