"""The pipeline against plain restatements of its stages on a small table."""

import random

import pytest
from helpers import EDGE, docs, prose
from test_groups import edited, plain_classes
from test_text_operators import SECRETS, plain_base, plain_hits, plain_quality

import corpus_pipeline as pl
from talkspan.llm import repeats, store


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, 25, 3000)) for i in range(4)]
    texts = list(EDGE) + [prose(rng, 80, 3000) for _ in range(30)]
    texts += [edited(rng, texts[-1], 1), texts[-2], texts[-3].upper(), prose(rng, 40, 3000) + " " + items[2][1]]
    texts += [prose(rng, 60, 3000) + " " + s for s in SECRETS] + [("again " * 6 + "x ") * 30]
    path = store.fresh_path(spark, "sample")
    docs(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def test_pipeline_equals_plain_stages(spark, folder):
    path, texts, items = folder
    rows = {r["doc_id"]: r for r in pl.run(spark, path).collect()}
    good = [i for i, t in enumerate(texts) if plain_quality(t or "", repeats.RepeatRules())[-1]]
    classes = plain_classes([texts[i] for i in good])
    firsts = [good[k] for k in sorted(set(classes))]
    clean = [i for i in firsts if not plain_hits(texts[i], items)[1]]
    assert sorted(rows) == clean and len(clean) < len(firsts) < len(good) < len(texts)
    for i in clean:
        assert rows[i]["round_trip"] and rows[i]["n_chars"] == len(rows[i]["text"])
        assert (rows[i]["text"] == texts[i]) == (not plain_base(texts[i]) and "pwd" not in texts[i])
        assert not [x for x in plain_base(rows[i]["text"]) if x[0] != "assign"]


def test_stages_return_the_columns_of_documents(spark, folder):
    path, _, _ = folder
    rows = spark.read.parquet(f"{path}/documents.parquet")
    clash = rows.selectExpr("*", "'mine' AS kept", "'mine' AS row", "'mine' AS findings", "'mine' AS ids", "'mine' AS items")
    for _, stage in pl.STAGES[:-1]:
        assert stage(spark, rows, path).columns == rows.columns
        out = stage(spark, clash, path)
        assert out.columns == clash.columns and {r["kept"] + r["findings"] for r in out.collect()} == {"minemine"}
    for _, stage in pl.STAGES:
        assert stage(spark, rows.limit(0), path).count() == 0


def test_tokens_are_one_pass(spark):
    rows = docs(spark, [*EDGE, "once more"])
    both = pl.tokens(spark, rows, None)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = pl.vocabulary()
    want = pl.bpe.with_text(pl.bpe.with_ids(rows.select("doc_id", "text"), path), path)
    found = {r.doc_id: (r.ids, r.n_tokens, r.round_trip) for r in both.collect()}
    assert found == {r.doc_id: (r.ids, len(r.ids), r.decoded == (r.text or "")) for r in want.collect()}
