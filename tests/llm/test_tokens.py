"""Encoding, decoding and token files against the tokenizers library."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGE, docs

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
public = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from talkspan.llm import bpe, store  # noqa: E402
from talkspan.llm import token_files as tf  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
PARTS = ["'s", "'re", "'", "s", " ", "  ", "\n", "\t", "é", "ß", "1", "²", "the", "!", "..", "　", "漢", "😀", "<|endoftext|>",
         "<|end", "'LL", "'ll", "_", "\r\n", "\x00", "՘", "​", "\x85", "\x1c"]


def texts(n):
    rng = random.Random(5)
    return list(EDGE) + ["".join(rng.choice(PARTS) for _ in range(rng.choice([1, 3, 12, 60]))) for _ in range(n)]


def test_encoding_and_decoding_equal_the_library(spark):
    library, all_texts = Tokenizer.from_file(PATH), texts(1500)
    rows = bpe.with_text(bpe.with_ids(docs(spark, all_texts, "ids decoded node"), PATH), PATH).collect()
    for r in rows:
        ids = library.encode(all_texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["node"] == "mine"
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False) == (all_texts[r["doc_id"]] or "")
    assert bpe.with_ids(docs(spark, []), PATH).count() == 0


def test_a_full_memory_of_words_changes_nothing():
    codec, all_texts = bpe.Codec(PATH), pa.array(texts(300)[1:])
    whole = codec.encode(all_texts).to_pylist()
    codec.lexicon._limit = 5
    assert [codec.encode(all_texts.slice(i, 7)).to_pylist() for i in range(0, 42, 7)] == [whole[i : i + 7] for i in range(0, 42, 7)]


def test_decoding_of_broken_text_and_unknown_ids():
    library, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(8))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        codec.decode([50257])


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public.path("word_bpe_49k.json"))


def test_token_files_round_trip(spark):
    library, all_texts = Tokenizer.from_file(PATH), texts(300)
    rng = random.Random(4)
    ids = [None, 7, 7, 7] + [rng.randrange(10**6) for _ in all_texts[4:]]
    rows = spark.createDataFrame(list(zip(ids, all_texts, ["mine"] * len(ids))), "doc_id long, text string, file_no string")
    path = store.fresh_path(spark, "tokens")
    tf.write(rows.repartition(5), path, PATH)
    got = tf.places(tf.read(spark, path)).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == sorted((i or -1) for i in ids)
    own = {}
    for i, t in zip(ids, all_texts):
        made = library.encode(t or "", add_special_tokens=False).ids + [0]
        own.setdefault(i, []).append((len(made), zlib.crc32(np.array(made, "<u4").tobytes())))
    for i, found in own.items():
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == i) == sorted(found)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"]) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)


def test_document_filters_reach_the_files(spark):
    path = store.fresh_path(spark, "tokens")
    tf.write(docs(spark, [f"text {i}" for i in range(3000)]), path, PATH)
    one = tf.read(spark, path).where("doc_id = 1234")
    assert "EqualTo(doc_id,1234)" in one._jdf.queryExecution().toString() and one.count() == 1


def test_empty_token_files(spark):
    path = store.fresh_path(spark, "tokens")
    tf.write(docs(spark, []), path, PATH)
    assert tf.places(tf.read(spark, path)).count() == 0
