"""Operators over many rows against plain restatements: near duplicates, captures, rollups, shards, chats."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE, docs, prose

from talkspan.llm import captures as cp
from talkspan.llm import chat
from talkspan.llm import neardup as nd
from talkspan.llm import queries
from talkspan.llm import rollups as ru
from talkspan.llm import shards as sh
from talkspan.llm import store
from talkspan.llm.decontaminate import lower_words


def shingle_set(text):
    words = lower_words(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def plain_classes(texts):
    """Least index of each class under all pairs at a Jaccard similarity of 0.8."""
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] is None or sets[j] is None:
                same = sets[i] is None and sets[j] is None and (texts[i] or "") == (texts[j] or "")
            else:
                same = 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
            if same:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(8)
    passage = prose(rng, 60, 5000)
    texts = list(EDGE)
    bases = [prose(rng, 120, 5000) for _ in range(8)]
    for b in bases:
        texts += [b, b.upper(), b.replace(" ", ", ")] + [edited(rng, b, rng.choice([1, 2, 5, 12])) for _ in range(6)]
    texts += [passage + " " + prose(rng, 150, 5000) for _ in range(25)]
    hot = prose(rng, 100, 5000)
    texts += [edited(rng, hot, rng.choice([1, 1, 2, 3])) for _ in range(80)] + [hot] * 40
    rng.shuffle(texts)
    return texts


def test_near_classes_equal_all_pairs(spark, copies):
    want = plain_classes(copies)
    got = {r["doc_id"]: r for r in nd.with_class(docs(spark, copies, "node sketch class_id")).collect()}
    assert [got[i]["class_id"] for i in range(len(copies))] == want
    assert [i for i in got if got[i]["is_keeper"]] and {i for i in got if got[i]["is_keeper"]} == set(want)


def test_deduplicated_keeps_one_row_of_each_class(spark, copies):
    table = docs(spark, copies, "node row keeper")
    twice = table.unionByName(table.where("doc_id % 5 = 0"))
    rows = nd.deduplicated(twice)
    assert rows.columns == table.columns
    out = rows.collect()
    assert sorted(r["doc_id"] for r in out) == sorted(set(plain_classes(copies)))
    assert all(r["text"] == copies[r["doc_id"]] and r["node"] == "mine" for r in out)


def test_near_duplicates_without_ids_or_rows(spark):
    rng = random.Random(2)
    text = prose(rng, 50)
    rows = spark.createDataFrame([(None, text), (None, text), (3, text), (3, prose(rng, 50))], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["class_id"], r["is_keeper"]) for r in nd.with_class(rows).collect())
    assert got == [(-1, 3, False), (-1, 3, False), (3, 3, True), (3, 3, True)]
    assert nd.with_class(docs(spark, [])).count() == 0 and nd.deduplicated(docs(spark, [])).count() == 0


def test_template_group_without_a_centre_equals_all_pairs(spark):
    rng = random.Random(31)
    template = prose(rng, 100, 5000)
    texts, want = [], []
    for k in range(1500):  # two texts of one tail, the second with its last words changed; unequal tails meet at 0.7
        tail = prose(rng, 21, 50_000).split()
        texts += [" ".join([template, *tail]), " ".join([template, *tail[:11], *prose(rng, 10, 50_000).split()])]
        want += [2 * k, 2 * k]
    sets = [shingle_set(t) for t in texts[:60]]
    for i in range(60):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert (0.8 <= alike < 0.9) if i // 2 == j // 2 else (0.62 < alike < 0.8)
    got = {r["doc_id"]: r["class_id"] for r in nd.with_class(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_equal_shingles_of_other_counts_are_links(spark):
    rng = random.Random(12)
    texts, want = [], []
    for k in range(60):  # 26 words in a ring, once around or a part of it many times: plain at least 0.8, weighted below
        ring = prose(rng, 26, 10**6).split()
        part = prose(rng, 8, 10**6).split()
        texts += [" ".join(ring + part), " ".join(ring + part * 40)]
        want += [2 * k, 2 * k]
    found = []
    for a, b in zip(texts[::2], texts[1::2]):
        counts = []
        for t in (a, b):
            words = lower_words(t)
            counts.append(Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)))
        key = {s: n for n, s in enumerate(sorted({*counts[0], *counts[1]}))}
        sets = [(np.array(sorted(key[s] for s in c), np.uint64), np.array([c[s] for s in sorted(c)])) for c in counts]
        found.append(nd.jaccards(*sets))
    assert all(plain >= 0.8 > 0.7 > weighted for plain, weighted in found)
    got = {r["doc_id"]: r["class_id"] for r in nd.with_class(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_probability_jaccard_of_sets_and_registers():
    rng = np.random.default_rng(1)
    for _ in range(40):
        pool = rng.permutation(40).astype(np.uint64)
        a, b = np.sort(pool[: rng.integers(1, 30)]), np.sort(rng.permutation(pool)[: rng.integers(1, 30)])
        ta, tb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
        x, y = dict(zip(a.tolist(), nd.weights(ta))), dict(zip(b.tolist(), nd.weights(tb)))
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})
        plain, weighted = nd.jaccards((a, ta), (b, tb))
        assert abs(weighted - want) < 1e-9 and abs(plain - len({*x} & {*y}) / len({*x, *y})) < 1e-12
    shared = 3000
    hashes = [rng.integers(0, 2**63, shared + 1000).astype(np.uint64) for _ in range(2)]
    hashes[1][:shared] = hashes[0][:shared]
    texts = np.repeat([0, 1], shared + 1000)
    found = nd.prob_min_hash(texts, np.concatenate(hashes), np.ones(len(texts)), 2, m=4000)
    assert abs((found[0] == found[1]).mean() - shared / (shared + 2000)) < 0.04


def test_captures_round_trip(spark):
    rng = random.Random(1)
    html = list(EDGE) + ["WARC/1.1\r\nWARC-Type: response\r\n\r\n", "a\r\n\r\nWARC/1.1\r\n", "\r\n\r\n", "same", "same", "same"]
    html += [prose(rng, 40) for _ in range(20)] + [None, "x" * 50_000]
    rows = [(i, rng.choice(["http://a.example/b?c#d", "bad url", None, "https://é.example"]), h, "mine") for i, h in enumerate(html)]
    path = store.fresh_path(spark, "warc")
    cp.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3), path)
    records = cp.read(spark, path)
    assert records.count() == 3 * len(rows) and cp.orphans(records).count() == 0
    whole = cp.transactions(records)
    assert all(r["n_request"] == r["n_metadata"] == 1 for r in whole.collect())
    bodies = {r["record_id"]: bytes(r["response"]["body"]) for r in whole.where("capture_type = 'response'").collect()}
    got = {r["page_id"]: r for r in cp.resolved(cp.flat(whole)).collect()}
    first = {}
    for i, _, h, _ in rows:
        data = (h or "").encode()
        first.setdefault(data, i)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind = "response" if first[data] == i else "revisit"
        want = (len(data), digest, kind, first[data] if kind == "revisit" else None)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert sorted(bodies.values()) == sorted(first)
    slim = cp.resolved(cp.flat(cp.transactions(cp.read(spark, path, payloads=False)))).collect()
    assert sorted(map(str, slim)) == sorted(map(str, got.values()))


def test_small_payloads_stay_responses_and_repeated_pages_stay(spark):
    rows = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (4, "u", "abcd"), (None, "u", "abcd")],
                                 "page_id long, url string, html string")
    path = store.fresh_path(spark, "warc")
    cp.write(rows, path, least_bytes=3)
    got = cp.resolved(cp.flat(cp.transactions(cp.read(spark, path)))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["page_id"] != 4) == [
        (0, "revisit", 3), (1, "response", None), (2, "response", None), (3, "response", None)]
    assert [(r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 4] == [("revisit", 3)] * 2


def test_nothing_of_an_archive_is_dropped(spark, tmp_path):
    def record(kind, name, *more, block="x: y\r\n"):
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *more, f"Content-Length: {len(block)}", "", block]
        return "\r\n".join(lines) + "\r\n\r\n"

    both = ("WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>")
    whole = record("response", "a") + record("response", "b") + record("request", "r2", *both) + record("request", "r1", both[0])
    whole += record("metadata", "m", "WARC-Concurrent-To: <gone>") + record("request", "r3")
    (tmp_path / "one.warc").write_text(whole, newline="")
    rows = cp.read(spark, str(tmp_path))
    got = {r["record_id"]: (r["request"]["record_id"], r["n_request"]) for r in cp.transactions(rows).collect()}
    assert got == {"<a>": ("<r1>", 2), "<b>": ("<r2>", 1)}
    assert [(r["capture_id"], r["record_id"]) for r in cp.further(rows).collect()] == [("<a>", "<r2>")]
    assert sorted(r["record_id"] for r in cp.orphans(rows).collect()) == ["<m>", "<r3>"]
    (tmp_path / "old.warc").write_text((record("request", "x") + record("request", "y")).replace("WARC/1.1", "WARC/1.0"), newline="")
    with pytest.raises(Exception, match="behind the end of a record"):
        cp.read(spark, str(tmp_path / "old.warc")).count()


def test_broken_and_empty_archives(spark):
    path = store.fresh_path(spark, "warc")
    cp.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert cp.transactions(cp.read(spark, path)).count() == 0
    with pytest.raises(ValueError):
        list(cp._whole_records([None, b"", b"Content-Length: 10\r\n\r\nabc"]))
    with pytest.raises(ValueError):
        list(cp._whole_records([None, b"", b"WARC-Type: x\r\n\r\nabc"]))


def events(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, version string, source string, lang string, n_tokens long, op string, seq long")


def test_rollups_follow_events(spark):
    rollup = ru.Rollup(spark, store.fresh_path(spark, "rollup"))
    first = events(spark, [(1, "a", "s", "en", 10, "insert", 0), (2, "a", "s", "en", 5, "insert", 0), (2, "a", "s", "en", 5, "insert", 0),
                           (3, "a", None, "de", None, "insert", 0), (None, "a", "t", "en", 4, "insert", 0)])
    second = events(spark, [(1, "a", "s", "en", 12, "revise", 0), (2, "a", "s", "en", 0, "delete", 0), (9, "a", "s", "en", 0, "delete", 0),
                            (9, "b", "s", "en", 7, "revise", 0), (3, "a", "u", "de", 6, "revise", 1), (3, "a", "u", "de", 8, "revise", 0)])

    def totals():
        return sorted((r["source"] or "", r["lang"], r["version"], r["docs"], r["tokens"]) for r in rollup.totals().collect())

    assert totals() == []
    assert rollup.apply(1, first) and not rollup.apply(1, first)
    assert totals() == [("", "de", "a", 1, 0), ("s", "en", "a", 2, 15), ("t", "en", "a", 1, 4)]
    assert rollup.apply(2, second)
    want = [("s", "en", "a", 1, 12), ("t", "en", "a", 1, 4), ("u", "de", "a", 1, 6)]
    assert totals() == want
    rollup.compact()
    assert totals() == want and not rollup.apply(2, second) and not rollup.apply(1, first) and totals() == want
    assert rollup.apply(3, events(spark, [(1, "a", "x", "en", 1, "insert", 0)]))
    assert totals() == [("t", "en", "a", 1, 4), ("u", "de", "a", 1, 6), ("x", "en", "a", 1, 1)]
    assert rollup.apply(4, events(spark, [])) and len(totals()) == 3


def test_a_batch_that_broke_off_does_not_count(spark):
    rollup = ru.Rollup(spark, store.fresh_path(spark, "rollup"))
    rows = events(spark, [(1, "a", "s", "en", 10, "insert", 0)])
    rollup._write(1, "batch-1-lost", ru._changed(ru._last_events(rows), False))
    spark.createDataFrame([], ru._COMMIT).write.parquet(f"{rollup.root}/commits/batch-1-broke-off/_temporary")
    assert rollup.totals().count() == 0 and rollup.apply(1, rows)
    assert [r["tokens"] for r in rollup.totals().collect()] == [10]


def test_late_batches_keep_ledger_and_totals_together(spark):
    rollup = ru.Rollup(spark, store.fresh_path(spark, "rollup"))
    one = lambda n, op: events(spark, [(1, "a", "s", "en", n, op, 0)])
    tokens = lambda: [r["tokens"] for r in rollup.totals().collect()]
    assert rollup.apply(1, one(10, "insert")) and rollup.apply(3, one(30, "revise")) and rollup.apply(2, one(20, "revise"))
    assert tokens() == [20] and rollup.state().first()["n_tokens"] == 20
    assert not rollup.apply(2, one(21, "revise"))
    rollup.compact()
    assert not rollup.apply(3, one(5, "revise")) and rollup.apply(4, one(31, "revise")) and tokens() == [31]
    # a number below all that is committed and folded is still a batch of its own
    assert rollup.apply(0, one(32, "revise")) and tokens() == [32] and rollup.state().first()["n_tokens"] == 32


def test_a_batch_reads_only_the_buckets_it_names(spark):
    rollup = ru.Rollup(spark, store.fresh_path(spark, "rollup"))
    rollup.apply(1, events(spark, [(i, "a", "s", "en", 1, "insert", 0) for i in range(200)]))
    some = ru._last_events(events(spark, [(7, "a", "s", "en", 0, "delete", 0)]))
    found = rollup.state(some)
    assert [r["doc_id"] for r in found.collect()] == [7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "GreaterThanOrEqual(doc_id,7)" in plan


def test_rollup_columns_with_names_of_its_own(spark):
    rollup = ru.Rollup(spark, store.fresh_path(spark, "rollup"))
    rows = events(spark, [(1, "a", "s", "en", 10, "insert", 0)]).selectExpr("*", "'x' AS bucket", "'x' AS old", "'x' AS present")
    assert rollup.apply(1, rows) and rollup.apply(2, rows)
    assert [(r["docs"], r["tokens"]) for r in rollup.totals().collect()] == [(1, 10)]


def test_draws_from_very_many_places():
    rng = np.random.default_rng(3)
    for good, bad, n in ((3, 5, 4), (10**10, 3 * 10**10, 50_000), (10**12, 10**12, 7), (5, 10**11, 50_000), (0, 10**10, 9), (10**10, 0, 9)):
        got = np.array([sh._hypergeometric(rng, good, bad, n) for _ in range(400)])
        mean, p = n * good / (good + bad), good / (good + bad)
        spread = (n * p * (1 - p) * (good + bad - n) / (good + bad - 1)) ** 0.5
        assert got.min() >= max(0, n - bad) and got.max() <= min(n, good)
        assert abs(got.mean() - mean) <= 5 * spread / 20 + 1e-9 and abs(got.std() - spread) <= 0.2 * spread + 0.05
    rows = sh._draw(rng, np.array([10**9, 2 * 10**9, 5]), 1000)
    assert rows.sum() == 1000 and (rows >= 0).all()


@pytest.mark.parametrize("n,shards", [(0, 3), (1, 3), (1000, 7), (5, 8)])
def test_shards_have_exact_sizes(spark, n, shards):
    rows = docs(spark, ["same"] * n, "shard slot block").repartition(4)
    out = sh.shuffled(rows, shards, block_rows=50).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(n))
    size = Counter(r["shard"] for r in out)
    assert n == 0 or max(size.values()) - min(size[j] for j in range(shards)) <= 1
    for j in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == j) == list(range(size[j]))
    assert n == 0 or all(r["block"] == "mine" for r in out)


def test_shards_hold_whole_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = [*EDGE, "same", "same", *(prose(rng, 30) for _ in range(40))]
    table = docs(spark, texts, "row shard slot file")
    table.unionByName(table.where("doc_id < 9")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path / "shared"))
    out = queries.QUERIES["op9_hypergeometric_shards"](spark, str(tmp_path)).collect()
    (path,) = (tmp_path / "shared").glob("shards-*")
    held = {(r["shard"], r["slot"]): r["row"] for r in sh.read(spark.read.parquet(str(tmp_path / "documents.parquet")), str(path)).collect()}
    assert len(held) == len(out) == len(texts) + 9
    assert Counter(r["text"] for r in held.values()) == Counter([*texts, *texts[:9]])
    for r in out:
        row = held[r["shard"], r["slot"]]
        data = (row["text"] or "").encode()
        assert row["shard"] == "mine" and row["text"] == texts[row["doc_id"]]
        assert (r["doc_id"], r["size"], r["text_crc32"]) == (row["doc_id"], len(data) + 1, zlib.crc32(data))
    for j in range(queries.N_SHARDS):
        own = sorted(slot for shard, slot in held if shard == j)
        assert own == list(range(len(own))) and len(own) in (len(held) // 8, -(-len(held) // 8))


def test_repeated_rows_are_placed_one_by_one(spark):
    rows = spark.createDataFrame([(None, None)] * 50, "doc_id long, text string")
    assert len({(r["shard"], r["slot"]) for r in sh.shuffled(rows, 4).collect()}) == 50


def test_matrix_sums_and_spread():
    blocks, sizes = [40] * 25, [250] * 4
    drawn = np.array([sh.communication_matrix(blocks, sizes, seed) for seed in range(400)])
    assert (drawn.sum(axis=2) == 40).all() and (drawn.sum(axis=1) == 250).all()
    # hypergeometric mean and variance: 40 of 1000 into 250 places
    assert abs(drawn[:, 7, 2].mean() - 10) < 0.5 and abs(drawn[:, 7, 2].var() - 40 * 0.25 * 0.75 * 960 / 999) < 2
    rng = np.random.default_rng(0)
    large = np.array([sh._draw(rng, np.array([10**9, 3 * 10**9]), 1000) for _ in range(200)])
    assert (large.sum(axis=1) == 1000).all() and abs(large[:, 0].mean() - 250) < 5


def plain_price(auto, roles):
    best = {chat.START: 0}
    for r in roles:
        after = {}
        for s, p in best.items():
            for t in range(chat.N_STATES):
                for q, _, _ in auto.steps[r][s][t]:
                    after[t] = min(after.get(t, 1 << 30), p + q)
        best = after
    return min(p + auto.closing[s][0] for s, p in best.items())


def legal(roles):
    state = None
    for r in roles:
        if r not in {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"),
                     "tool": ("assistant", "tool")}[state]:
            return False
        state = r
    return state == "assistant"


def chats(rng):
    names = ["system", "user", "assistant", "tool", "User", None]
    rows = []
    for conv in [None, *range(12)]:
        n = rng.choice([1, 2, 9, 30]) if conv != 3 else 200
        rows += [(conv, t, rng.choice(names), rng.choice([None, "", "hi", "a\nb"])) for t in range(n)]
    rows += [(20, None, "user", "first"), (20, 1, "assistant", "x"), (20, 1, "assistant", "x"), (20, 1, "assistant", "x")]
    return rows


@pytest.mark.parametrize("chunk", [256, 3])
def test_repaired_chats_are_legal_and_cheapest(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK_TURNS", chunk)
    rows = chats(random.Random(6))
    table = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, place string")
    auto = chat.Automaton(chat.Prices())
    out = chat.repaired(table.coalesce(1)).collect()
    assert len(out) == len(rows)
    convs = {}
    for r in sorted(out, key=lambda r: (r["range_no"], r["chunk_no"], r["place"])):
        convs.setdefault(r["conv_id"], []).append(r)
    for conv, own in convs.items():
        told = [r for r in rows if r[0] == conv]
        assert [(r["turn"], r["role"]) for r in own] == [(r[1], r[2]) for r in told]
        roles = chat._role_numbers([r[2] for r in told])
        assert sum(r["price"] for r in own) == plain_price(auto, roles)
        goal = np.array([p for p, _ in auto.closing])
        assert [(r["new_role"], r["action"]) for r in own] == [(chat.ROLES[s], a) for s, a, _, _ in auto.path(roles, chat.START, goal)]
        text = "".join(r["fragment"] for r in own)
        heads = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
        assert legal(heads) and text.endswith("<|im_end|>\n") and text.count("<|im_end|>") == len(heads)


def test_chats_of_an_empty_table(spark):
    assert chat.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
