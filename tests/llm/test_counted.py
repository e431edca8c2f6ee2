"""Collocations, whitening and packing against plain restatements."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGE, docs, prose

from talkspan.llm import collocations as co
from talkspan.llm import packing as pk
from talkspan.llm import queries, store
from talkspan.llm import whitening as wh
from talkspan.llm.quotient import Layout

public = pytest.importorskip("public_tokenizers")


# ---- counting quotient filters


@pytest.mark.parametrize("k,id_bytes,bucket_bits", [(2, 5, 4), (3, 6, 0), (5, 8, 13), (2, 4, 7), (1, 5, 3), (4, 8, 21)])
def test_quotient_filters_are_lossless(k, id_bytes, bucket_bits):
    rng = np.random.default_rng(k)
    layout, n = Layout(k, id_bytes, bucket_bits), 5000
    ids = [rng.integers(0, 20 if k > 1 else 300, n).astype(np.uint64) for _ in range(k)]
    ids[0][: n // 2] = (1 << layout.bits) - 1
    group = rng.integers(0, 3, n).astype(np.uint16)
    cells = layout.permuted(ids)
    assert all((a == b).all() for a, b in zip(layout.restored(cells), ids))
    sums = layout.summed(cells, np.ones(n, np.int64), group)
    owner, made = layout.filters(*sums)
    back, counts, at = layout.entries(made)
    assert all((a == b).all() for a, b in zip(back, sums[0])) and (counts == sums[1]).all() and (owner[at] == sums[2]).all()
    want = Counter(zip(group.tolist(), *(x.tolist() for x in ids)))
    got = {(int(g), *map(int, r)): int(c) for g, c, *r in zip(sums[2], counts, *layout.restored(back))}
    assert got == dict(want)
    own = made.take(pa.array(np.flatnonzero(owner == 0)))
    for key in [x for x in want if x[0] == 0][:20]:
        assert layout.count(own, list(key[1:])) == want[key]
    assert layout.count(own, [12345] * k) == 0
    _, merged = layout.merged(pa.Table.from_batches([own, own, own.slice(0, 0)]))
    assert merged.sum() == 3 * 0 + 2 * sum(c for x, c in want.items() if x[0] == 0)


def test_equal_sort_keys_of_different_numbers_stay_apart():
    layout = Layout(2, 5, 4)  # the key holds 64 of 80 bits
    cells = [np.array([7, 7, 7, 7], np.uint64), np.array([1, 2, 1, 2], np.uint64)]
    got, counts, _ = layout.summed(cells, np.array([1, 10, 100, 1000]), np.zeros(4, np.uint16))
    assert got[1].tolist() == [1, 2] and counts.tolist() == [101, 1010]


# ---- collocations


def plain_collocations(rows, least, most):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    out = []
    often = {x: c for x, c in counts.items() if len(x[1]) > 1 and c >= least}

    def inside(short, long):
        return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))

    for (lang, words), a in often.items():
        if any(g == lang and len(w) > len(words) and c >= a and inside(words, w) for (g, w), c in often.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.choice([0, 1, 3])):
            parts += [prose(rng, 4, 9), rng.choice(["Of the, ", "of the the of the\n", "New York City Hall. ", "a\tb ", "é漢 😀 x;", "\x00 z "])]
        rows.append((rng.choice(["en", "en", "de", None]), " ".join(parts) or rng.choice(EDGE)))
    return rows + [("en", "again " * 3000), ("xx", None), (None, "")]


def test_collocations_equal_plain_counts(spark, phrase_rows, monkeypatch):
    table = spark.createDataFrame([(*r, "mine", "mine") for r in phrase_rows], "lang string, text string, ids string, n string")
    want = plain_collocations(phrase_rows, 8, 5)
    assert len({len(x[1].split(" ")) for x in want}) == 4
    columns = ("lang", "phrase", "a", "l", "r", "n", "score")
    got = co.mined(table.repartition(7), 8)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want
    best = [tuple(r[c] for c in ("lang", "rank", "phrase")) for r in co.best(got, 5).collect()]
    for lang in {x[0] for x in want}:
        own = sorted((x for x in want if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:5]
        assert sorted(b for b in best if b[0] == lang) == [(lang, i + 1, x[1]) for i, x in enumerate(own)]
    # small tasks, buckets and bit filters change nothing
    for name, value in (("TASK_CELLS", 500), ("BUCKET_ENTRIES", 300), ("FILTER_BITS", 6), ("LEAST_FILTER_BITS", 6)):
        monkeypatch.setattr(co, name, value)
    again = co.mined(table.repartition(3), 8)
    assert sorted(tuple(r[c] for c in columns) for r in again.collect()) == want


def test_ids_that_meet_are_hashed_anew(spark, monkeypatch):
    table = spark.createDataFrame([("en", "a b a b c d")] * 3, "lang string, text string")
    asked, real = [], co.vocabulary

    def first_all_equal(rows, salt=0):
        asked.append(salt)
        return real(rows, salt).withColumn("key", co.F.lit(7).cast("long")) if salt == 0 else real(rows, salt)

    monkeypatch.setattr(co, "vocabulary", first_all_equal)
    got = [(r["phrase"], r["a"]) for r in co.mined(table, 3).collect()]
    assert asked == [0, 1] and sorted(got) == sorted((x[1], x[2]) for x in plain_collocations([("en", "a b a b c d")] * 3, 3, 5))


def test_collocations_of_nothing(spark):
    assert co.mined(docs(spark, [])).count() == 0 and co.mined(docs(spark, EDGE)).count() <= 12
    assert co.mined(docs(spark, [None, "", "one"])).count() == 0


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", [1], 10**14, "x"), ("en", [2], 10**13, "y"), ("en", [1, 2], 10**13 - 7, None)],
                                   "lang string, ids array<long>, n long, word string")
    row = co.rated(counts, spark.createDataFrame([("en", 10**17)], "lang string, n long")).first()
    assert row["score"] == 1000 * (10**13 - 7) * 10**17 // (10**14 * 10**13) and row["phrase"] == "x y"


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, x string, weight string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "mine", "mine") for i, v in rows], VECTORS)


def test_whitening_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))).astype(np.float32).astype(float).tolist()
    rows = list(enumerate(base)) + [(1000 + i, base[7]) for i in range(900)] + [(None, base[1]), (5, base[5]), (5, base[5])]
    bad = [(1, None), (2, []), (3, [None] * 6), (4, [float("nan")] * 6), (5, [1.0, 2.0, float("inf"), 0.0, 0.0, 0.0]), (6, [1.0] * 5)]
    monkeypatch.setattr(wh, "HOT", 50)
    table = wh.steps(vectors(spark, rows + bad).drop("x"))
    made = wh.whiten(table.repartition(5), ["vec_id", "weight", "label"] if "label" in table.columns else ["vec_id", "weight"], 4)
    got = sorted((r["vec_id"] is None, r["vec_id"], r["deviation"], tuple(r["whitened"])) for r in made.rows.collect())
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    values, columns = np.linalg.eigh(z.T @ z / n)
    values, columns = values[::-1][:4], columns[:, ::-1][:, :4]
    plain = z @ columns / np.sqrt(values)
    plain *= np.sign((plain * 1).sum(axis=0))
    mine = np.array([g[3] for g in got])
    mine *= np.sign(mine.sum(axis=0)) * np.sign((mine.sum(axis=0)) * plain.sum(axis=0))
    want = sorted((i is None, i, int(((n * r - sums) ** 2).sum()), tuple(p)) for (i, _), r, p in zip(rows, x, plain))
    assert len(got) == n and [g[:3] for g in got] == [w[:3] for w in want]
    assert np.abs(np.abs(mine) - np.abs([w[3] for w in want])).max() < 1e-9
    assert made.error < 1e-9 and np.abs(made.model.values / values - 1).max() < 1e-9 and made.model.centre.n == n
    once = wh.fit(wh.distinct_vectors(table), 4, by_rows=False)
    assert once.centre.n == len({tuple(r) for r in x.tolist()})


def test_whitening_of_constant_few_and_no_vectors(spark):
    assert wh.whiten(wh.steps(vectors(spark, []).drop("x")), ["vec_id"]).rows.count() == 0
    assert wh.whiten(wh.steps(vectors(spark, [(1, [1.0, 2.0])] * 3).drop("x")), ["vec_id"]).rows.count() == 0
    two = wh.whiten(wh.steps(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])]).drop("x")), ["vec_id"])
    assert sorted(abs(v) for r in two.rows.collect() for v in r["whitened"]) == pytest.approx([1, 1]) and two.error < 1e-9


def test_deviations_beyond_64_bits():
    at = wh.Centre(10**10, [10**17, 5 * 10**16])
    x = np.array([[10**7, 5 * 10**6 + 0], [10**7, 5 * 10**6]])
    assert wh._deviations(x, at).tolist() == [0, 0]
    assert wh._deviations(x - [[0, 0], [0, 0]], wh.Centre(10**10, [10**17 + 3, 5 * 10**16 - 4])).tolist() == [25, 25]
    with pytest.raises(OverflowError):
        wh._deviations(x, wh.Centre(10**10, [10**16, 0]))


# ---- packing

PATH = public.path("byte_bpe_50k.json")


def plain_cost(stream, ends, prices):
    """The least price of all windows, by trying all pairs of cuts; and the price of a cut by its place."""
    spots, at = [], 0
    for ids in stream:
        n = len(ids)
        spots += [(at + j, 0 if j == n - 1 else prices.sentence) for j in range(n)
                  if j == n - 1 or (ends[ids[j]] and not ends[ids[j + 1]])]
        at += n
    cuts, before = {}, -1
    for spot, price in spots:
        cuts |= {h: prices.hard for h in range(before + prices.stride, spot, prices.stride)} | {spot: price}
        before = spot
    place, price = [0] + [c + 1 for c in sorted(cuts)], [0] + [cuts[c] for c in sorted(cuts)]
    best = [0] + [10**9] * (len(place) - 1)
    for j in range(1, len(place)):
        for i in range(j):
            if place[j] - place[i] <= prices.size:
                best[j] = min(best[j], best[i] + window_price(place[j] - place[i], prices) + price[j])
    return best[-1], dict(zip(place, price))


def window_price(length, prices):
    padded = prices.size - length if length < prices.least else prices.padding(length)
    return padded + prices.window


@pytest.mark.parametrize("seed", range(120))
def test_windows_are_cheapest(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 16, 32])
    prices = pk.Prices(size, rng.choice([0, 1, 3]), rng.choice([0, 4, 9]), rng.choice([0, 1]), rng.choice([1, 2, 3, 5]), rng.choice([1, 2, 4]))
    ends = np.zeros(10, bool)
    ends[[3, 4]] = True
    stream = [[rng.randrange(1, 10) for _ in range(rng.choice([0, 1, 3, 20, 50]))] + [0] for _ in range(rng.randrange(1, 12))]
    packer, made = pk.Packer(prices, ends, chunk=rng.choice([1, 20, 1000])), []
    for i, ids in enumerate(stream):
        made += packer.add(np.array([i], object), np.array(ids, np.int32), np.array([len(ids)]))
    made += packer.close()
    assert np.concatenate([m["ids"] for m in made]).tolist() == [t for ids in stream for t in ids]
    lengths = np.bincount(np.concatenate([m["sequence"] for m in made]), np.concatenate([m["sizes"] for m in made])).astype(int)
    assert lengths.max() <= size and lengths.min() > 0
    best, price = plain_cost(stream, ends, prices)
    assert sum(window_price(n, prices) for n in lengths.tolist()) + sum(price[c] for c in np.cumsum(lengths).tolist()) == best


def test_cuts_are_forced_where_too_much_is_open():
    prices, ends = pk.Prices(8, 0, 0, 0, 1, 1), np.zeros(10, bool)
    packer, made = pk.Packer(prices, ends, chunk=1, most_open=20), []
    for i in range(40):
        made += packer.add(np.array([i], object), np.array([1, 2, 0], np.int32), np.array([3]))
        assert len(packer._ids) <= 40
    made += packer.close()
    assert np.concatenate([m["ids"] for m in made]).tolist() == [1, 2, 0] * 40


def test_packed_pieces_hold_all_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = list(EDGE) + [prose(rng, rng.choice([1, 30, 700, 3000])).replace("w1 ", "w1. ") for _ in range(60)]
    names = [None, 7, 7, 7] + [rng.randrange(10**6) for _ in texts[4:]]
    rows = spark.createDataFrame(list(zip(names, texts, ["mine"] * len(names))), "doc_id long, text string, sequence_id string")
    path = store.fresh_path(spark, "packed")
    pk.write(rows.repartition(5), path, PATH)
    got = pk.read(spark, path).collect()
    own, streams = {}, {}
    for i, t in zip(names, texts):
        own.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        streams.setdefault(r["sequence_id"], []).append(r)
    for pieces in streams.values():
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += len(r["ids"])
        assert at <= 1024
    found, open_ = {}, []
    for r in [r for s in sorted(streams) for r in streams[s]]:
        open_ = open_ + list(r["ids"]) if r["start"] else list(r["ids"])
        if len(open_) == r["doc_tokens"]:
            found.setdefault(r["doc_id"], []).append(open_)
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in own.items()}
    sums = pk.padding(pk.measured(pk.read(spark, path))).first()
    assert sums["n_ids"] == sum(len(x) for v in own.values() for x in v) and sums["n_padding"] < 0.06 * sums["n_ids"]
    empty = store.fresh_path(spark, "packed")
    pk.write(docs(spark, []), empty, PATH)
    assert pk.measured(pk.read(spark, empty)).count() == 0


def test_queries_of_this_file_are_registered():
    assert {"op11_collocations", "op12_whitening", "op13_packing"} <= set(queries.QUERIES)
