"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Texts are lower-cased (A-Z), cut into words of digits, letters and characters outside ASCII, and read as shingles of five
words (a shorter text is one shingle). A shingle that occurs c times weighs 1 + ln c. Each shingle sends a Poisson process
of arrivals at the rate of its weight; every arrival falls on one of `REGISTERS` registers, and a register keeps the shingle
of its earliest arrival. A text is done when no shingle can arrive before the latest register, so most shingles send a few
arrivals only. Two texts agree in a register with the probability Jaccard similarity of their shingle weights. A text with
repeated shingles has a second, plain form, in which all weights are 1; forms of other texts agree with it by the plain
Jaccard similarity. Both forms lie in the same buckets, and the larger estimate of a pair counts.

1. Texts with equal words are one node (its 128-bit hash); everything further is about nodes.
2. Six registers are a band. Nodes with equal bands meet in a bucket. Buckets of up to `SMALL` nodes give their pairs;
   larger ones give each node's pairs with the bucket's leaders, the nodes that meet the most others (the centre of a
   group of copies is one), and are divided by three and then more further registers, again and again, until they are small. So pairs
   grow with the rows, not with the square of a group, and no group is cut off.
3. A two-bit sketch of the registers drops pairs that are clearly below the threshold.
4. Pairs are verified on the whole shingle sets: first each node's best pair, then all pairs that still lie between
   different components. A pair is a link if its probability Jaccard or its plain Jaccard similarity is at least 0.8.
   What a large bucket still holds of different components is compared whole, block by block (`crowd_links`): a group
   around a template has no centre that could lead it.
5. Components of links are classes; the class id is the smallest document id in it.

A pair at similarity 0.8 shares no band with a probability of 3e-6, higher pairs less; in groups so large that buckets are
divided, leaders and small buckets find most links and the comparison of blocks the others; its work grows with the square
of such a group, less its largest component, its rows with the square divided by `CROWD_NODES`. No links, nodes or components pass the driver; what is broadcast is a
Bloom filter of fixed size that spares the shuffle of shingle sets that no pair asks for.

Defined results: a text without words is a node with all texts of equal bytes (null and empty are equal) and has no links;
rows with equal `doc_id` are rows of their own; a class whose documents have no id has a null class id. Input columns that
carry the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.llm import arrays as ar
from talkspan.llm import store
from talkspan.llm.decontaminate import scan_words

WORDS = 5
THRESHOLD = 0.8
PER_PIECE, BANDS = 3, 42
PIECES = 2 * BANDS
REGISTERS = PIECES * PER_PIECE
SMALL, FIRST_LEADERS, LEADERS = 16, 2, 1
#: Pairs go on if the sketch estimates this much: four standard deviations below the threshold.
LEAST_ESTIMATE = 0.68
FILTER_BITS = 24
#: Nodes and bytes of shingle sets of a block of a crowd, about; shingles that are multiplied out at a time.
CROWD_NODES, CROWD_BYTES, CROWD_COLUMNS = 500, 8 << 20, 4096
_LANES = 4


def shingles(block: ar.Block):
    """Distinct shingles of the texts of a block: text, 64-bit hash and count of each, by text; also the node hashes."""
    words, owner, _, _ = scan_words(block)
    n = block.n
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    whole = ar.window_hashes(words, WORDS)
    at = np.arange(len(whole))
    inside = owner[: len(whole)] == owner[WORDS - 1 : WORDS - 1 + len(whole)]
    texts, hashes = [owner[at[inside]]], [whole[inside]]
    for width in range(1, WORDS):
        short = np.flatnonzero(count == width)
        if len(short):
            texts.append(short)
            hashes.append(ar.window_hashes(words, width)[first[short]] + np.uint64(width))
    texts, hashes = np.concatenate(texts), np.concatenate(hashes)
    with np.errstate(over="ignore"):
        keys = ar.mixed(hashes ^ ar.mixed(texts.astype(np.uint64) + np.uint64(1)))
    _, sample, times = np.unique(keys, return_index=True, return_counts=True)
    order = np.argsort(texts[sample], kind="stable")
    sample, times = sample[order], times[order]
    return texts[sample], hashes[sample], times, _nodes(block, words, owner, count)


def _nodes(block: ar.Block, words: np.ndarray, owner: np.ndarray, count: np.ndarray) -> pa.Array:
    """128-bit hash of the words of each text; of its bytes where it has no words."""
    n = block.n
    starts = np.cumsum(count) - count
    halves = []
    for salt in (1, 2):
        with np.errstate(over="ignore"):
            marked = ar.mixed(words + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))
        halves.append(_sequence_hash(marked, starts, count))
    bare = np.flatnonzero(count == 0)
    if len(bare):
        values = ar.value_table()
        for salt in (0, 1):
            raw = ar.span_hashes(ar.mixed(values + np.uint64(salt)), block.data, block.starts[bare], block.starts[bare + 1])
            halves[salt][bare] = raw
    raw = np.stack(halves, axis=1).astype("<u8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(raw)]).cast(pa.binary())


def _sequence_hash(items: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of the items of each run, by their order."""
    place = np.arange(len(items)) - np.repeat(starts, count)
    with np.errstate(over="ignore"):
        placed = ar.mixed(items + ar.mixed(place.astype(np.uint64)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(placed, dtype=np.uint64)])
        return ar.mixed(sums[starts + count] - sums[starts] + count.astype(np.uint64))


def weights(times: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(times)


def prob_min_hash(texts: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle of the earliest arrival in each of `m` registers of each of `n` texts (0 where there is none).

    Round by round every open shingle sends its next arrivals, in growing numbers. A shingle is closed when its last
    arrival was later than the latest register of its text.
    """
    earliest = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    at = np.zeros(len(texts))
    open_ = np.arange(len(texts))
    sent, batch = 0, 1
    while len(open_):
        h, t = hashes[open_], texts[open_]
        step = np.arange(sent, sent + batch, dtype=np.uint64)
        with np.errstate(over="ignore"):
            r = ar.mixed(h[:, None] + (step + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        wait = -np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52)
        time = at[open_][:, None] + np.cumsum(wait, axis=1) / weight[open_][:, None]
        with np.errstate(over="ignore"):
            register = ((ar.mixed(r) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        cell = (t[:, None] * m + register).ravel()
        flat, who = time.ravel(), np.repeat(h, batch)
        early = flat < earliest[cell]
        cell, flat, who = cell[early], flat[early], who[early]
        np.minimum.at(earliest, cell, flat)
        won = earliest[cell] == flat
        winner[cell[won]] = who[won]
        at[open_] = time[:, -1]
        latest = earliest.reshape(n, m).max(axis=1)
        open_ = open_[at[open_] < latest[t]]
        sent += batch
        batch = min(2 * batch if sent > 2 else 1, 64)
    return winner.reshape(n, m)


def sketches(winner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each register, as twice four 64-bit numbers, and a 32-bit hash of each piece of registers."""
    mixed = ar.mixed(winner)
    bits = np.zeros((len(winner), 2, 64 * _LANES), np.uint8)
    for k in range(2):
        bits[:, k, : winner.shape[1]] = (mixed >> np.uint64(k)) & np.uint64(1)
    lanes = np.packbits(bits.reshape(len(winner), 2 * 64 * _LANES), axis=1).view("<i8")
    pieces = np.zeros((len(winner), PIECES), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PER_PIECE):
            pieces = ar.mixed(pieces * np.uint64(31) + winner[:, k::PER_PIECE][:, :PIECES])
    return lanes, (pieces >> np.uint64(32)).astype(np.uint32).view(np.int32)


_NODE = T.StructField("node", T.BinaryType())
_SIGNED = [_NODE, *(
    T.StructField(prefix + name, T.ArrayType(kind))
    for prefix in ("", "plain_") for name, kind in (("sketch", T.LongType()), ("pieces", T.IntegerType()))
)]
_SET = [_NODE, T.StructField("hashes", T.BinaryType()), T.StructField("times", T.BinaryType())]


def signatures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`doc_id, node, sketch, pieces, plain_sketch, plain_pieces` of all documents, and their columns `keep`; the sketches
    and pieces are empty for texts without words, those of the plain form also for texts without repeated shingles."""

    def kernel(batch: pa.RecordBatch) -> dict:
        block = ar.block_of(ar.texts_of(batch, text))
        texts, hashes, times, nodes = shingles(block)
        n = block.n
        some = np.bincount(texts, minlength=n) > 0
        again = np.bincount(texts, times > 1, minlength=n) > 0
        own = again[texts]
        number = np.cumsum(again) - 1
        out = {"node": nodes}
        for prefix, there, winner in (
            ("", some, prob_min_hash(texts, hashes, weights(times), n)[some]),
            ("plain_", again, prob_min_hash(number[texts[own]], hashes[own], np.ones(int(own.sum())), int(again.sum()))),
        ):
            lanes, pieces = sketches(winner)
            out[prefix + "sketch"] = ar.list_array(pa.array(lanes.ravel()), there * 2 * _LANES)
            out[prefix + "pieces"] = ar.list_array(pa.array(pieces.ravel()), there * PIECES)
        return out

    return ar.arrow_map(docs, kernel, _SIGNED, ["doc_id", *keep], text)


def forms(nodes: DataFrame) -> DataFrame:
    """`node, plain, sketch, pieces`: one row for each form of a node with words."""
    form = lambda prefix, plain: F.struct(
        F.lit(plain).alias("plain"), F.col(prefix + "sketch").alias("sketch"), F.col(prefix + "pieces").alias("pieces"))
    rows = nodes.select("node", F.explode(F.array(form("", False), form("plain_", True))).alias("x"))
    return rows.select("node", "x.*").where(F.size("pieces") > 0)


def _paired(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def estimate(a, b):
    """Similarity by two sketches: unequal shingles agree in two bits by chance once in four times."""
    differ = sum(
        F.bit_count(
            F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
            .bitwiseOR(F.get(a, F.lit(k + _LANES)).bitwiseXOR(F.get(b, F.lit(k + _LANES))))
        )
        for k in range(_LANES)
    )
    return 1 - differ / F.lit(0.75 * REGISTERS)


def candidates(nodes: DataFrame, least: float = LEAST_ESTIMATE) -> tuple[DataFrame, DataFrame]:
    """`a, b, estimate`: pairs of nodes that share a small bucket, or a leader with each node of a large one, where the
    sketches agree well enough; and `key, node` of the large buckets of whole bands. `nodes` has a row for each form.

    A node's weight is the number of nodes it meets over all bands: the centre of a group of copies meets the most. The
    leaders of a large bucket are its heaviest nodes, `FIRST_LEADERS` of a whole band and `LEADERS` of a divided one.
    """
    piece = lambda i: F.get("pieces", F.pmod(i, F.lit(PIECES)))
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, piece(2 * b), piece(2 * b + 1))
    )
    rows = nodes.select("node", "plain", F.posexplode(keys).alias("band", "key"))
    spark, found = nodes.sparkSession, store.fresh_path(nodes.sparkSession, "near-pairs")
    used, level = 2, 0
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        met = rows.join(sizes, "key")
        if level == 0:  # what the nodes that meet any other carry from here on
            met = store.written(met, "near-buckets")
            weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
            met = met.join(nodes.join(weight, "node"), ["node", "plain"])
        met = store.written(met, "near-buckets")
        one = F.struct("node", "sketch")
        few = met.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("own"))
        few = few.select("own", F.posexplode("own").alias("i", "first"))
        others = F.transform(
            F.slice("own", F.col("i") + 2, F.lit(SMALL)),
            lambda x: F.struct(x["node"].alias("b"), estimate(F.col("first.sketch"), x["sketch"]).alias("estimate")),
        )
        apart = lambda x: (x["estimate"] >= least) & (x["b"] != F.col("first.node"))
        few = few.select(F.col("first.node").alias("a"), F.explode(F.filter(others, apart)).alias("x"))
        few.select("a", "x.b", "x.estimate").write.mode("append").parquet(found)
        crowded = met.where(F.col("n") > SMALL).drop("n")
        if level == 0:
            crowds = crowded.select("key", "node").distinct()
        if crowded.isEmpty():
            break
        n_leaders = LEADERS if level else FIRST_LEADERS
        of_class = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(n_leaders)).alias("of_class")
        leaders = crowded.groupBy("key", of_class).agg(F.max(F.struct("weight", "node", "sketch")).alias("rank"))
        leaders = leaders.select(
            F.col("key").alias("of_key"), F.col("rank.node").alias("leader"), F.col("rank.sketch").alias("led")
        )
        near = estimate(F.col("sketch"), F.col("led"))
        mine = (F.col("key") == F.col("of_key")) & (F.col("node") != F.col("leader")) & (near >= least)
        led = crowded.select("key", "node", "sketch").join(leaders, mine)
        led = led.select(*_paired(F.col("node"), F.col("leader")), near.alias("estimate"))
        led.write.mode("append").parquet(found)
        if used >= PIECES:  # the nodes of a bucket agree in all registers
            break
        more = min(1 if level < 3 else 2 ** (level - 2), PIECES - used)
        again = [piece(2 * F.col("band") + used + k) for k in range(more)]
        rows = crowded.withColumn("key", F.xxhash64("key", *again))
        used, level = used + more, level + 1
    pairs = spark.read.schema("a binary, b binary, estimate double").parquet(found)
    return pairs.groupBy("a", "b").agg(F.max("estimate").alias("estimate")), crowds


def _spots(node):
    """Two places of a node in the Bloom filter: its first and its next three bytes."""
    return [F.conv(F.hex(F.substring(node, 1 + 3 * k, 3)), 16, 10).cast("long") for k in range(2)]


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of 2^FILTER_BITS bits over nodes, put together by Spark; 2^18 numbers at most reach the driver."""
    at = keys.select(F.explode(F.array(*_spots(F.col("node")))).alias("spot"))
    word = F.shiftright("spot", 6).alias("word")
    rows = at.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _in_bloom(nodes: pa.Array, words: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(nodes.cast(pa.binary(16)).buffers()[1], np.uint8).reshape(-1, 16)[:, :6].astype(np.int64)
    hit = np.ones(len(raw), bool)
    for k in (0, 3):
        spot = (raw[:, k] << 16) | (raw[:, k + 1] << 8) | raw[:, k + 2]
        hit &= ((words[spot >> 6] >> (spot & 63)) & 1) == 1
    return hit


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """`node, hashes, times` of the wanted nodes: sorted shingle hashes and their counts as flat numbers."""

    def kernel(batch: pa.RecordBatch) -> dict:
        block = ar.block_of(ar.texts_of(batch, text))
        texts, hashes, times, nodes = shingles(block)
        order = np.lexsort((hashes, texts))
        hashes, times = hashes[order].astype("<u8"), times[order].astype("<u4")
        ends = np.searchsorted(texts, np.arange(block.n + 1))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
        return {"node": nodes, "hashes": cut(hashes), "times": cut(times)}

    known = docs.sparkSession.sparkContext.broadcast(bloom(wanted))

    def maybe(batches):
        for batch in batches:
            for part in ar.slices(batch, "text"):
                block = ar.block_of(ar.texts_of(part, "text"))
                words, owner, _, _ = scan_words(block)
                nodes = _nodes(block, words, owner, np.bincount(owner, minlength=block.n))
                rows = pa.RecordBatch.from_arrays([part.column(0), nodes], ["text", "node"])
                yield rows.filter(pa.array(_in_bloom(nodes, known.value)))

    ar.bounded_batches(docs.sparkSession)
    marked = docs.select(F.col(text).alias("text")).mapInArrow(maybe, "text string, node binary")
    # the exact test, and copies of a node meet before their sets are built
    one_each = marked.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return ar.arrow_map(one_each, kernel, _SET, [], "text")


def jaccards(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Plain and probability Jaccard similarity of two weighted shingle sets (sorted hashes, counts)."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    union = len(a[0]) + len(b[0]) - len(both)
    wa, wb = weights(a[1]), weights(b[1])
    x, y = wa / wa.sum(), wb / wb.sum()
    xs, ys = x[ia], y[ib]
    ratio = xs / ys
    order = np.argsort(ratio, kind="stable")
    xs, ys, ratio = xs[order], ys[order], ratio[order]
    # shingles of only one text have ratio infinity or zero: all of theirs counts on that side
    only_x, only_y = 1 - xs.sum(), 1 - ys.sum()
    place = np.searchsorted(ratio, ratio, "left")
    below = np.concatenate([[0.0], np.cumsum(ys)])[place] + max(only_y, 0.0)
    above = xs.sum() - np.concatenate([[0.0], np.cumsum(xs)])[place] + max(only_x, 0.0)
    return len(both) / union, float((1 / (above / xs + below / ys)).sum())


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`a, b, similarity` of the pairs that are links."""
    for side in ("a", "b"):
        own = sets.select(F.col("node").alias(side), F.col("hashes").alias(f"hashes_{side}"), F.col("times").alias(f"times_{side}"))
        pairs = pairs.join(own, side)
    field = T.StructField("similarity", T.DoubleType())

    def kernel(batch: pa.RecordBatch) -> dict:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        out = []
        for ha, ta, hb, tb in zip(*(column(c) for c in ("hashes_a", "times_a", "hashes_b", "times_b"))):
            a = np.frombuffer(ha.as_buffer(), "<u8"), np.frombuffer(ta.as_buffer(), "<u4")
            b = np.frombuffer(hb.as_buffer(), "<u8"), np.frombuffer(tb.as_buffer(), "<u4")
            out.append(max(jaccards(a, b)))
        return {"similarity": pa.array(out, pa.float64())}

    rated = ar.arrow_map(pairs, kernel, [field], ["a", "b"], None)
    return rated.where(F.col("similarity") >= threshold - 1e-9)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, component` (the least node) for all nodes with links, by joining every node to the least neighbour and
    that one's least neighbour in turn until nothing changes."""
    edges = store.written(links.select(*_paired(F.col(a), F.col(b))).where("a != b").distinct(), "near-edges")
    seen = None
    while True:
        # large star: a node's larger neighbours join its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
        large = large.where("a != b").distinct()
        # small star: a node and its smaller neighbours join the least of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(
            down.select(F.col("m").alias("a"), "b")
        ).where("a != b").distinct()
        edges = store.written(small, "near-edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that lie between different components."""
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    return pairs.where(F.col("of_a") != F.col("of_b")).drop("of_a", "of_b")


def _block_links(own: pa.Table, threshold: float) -> list[tuple[bytes, bytes, float]]:
    """Links between the nodes of two blocks (or within one) that join different components, no more than join them."""
    column = lambda c: own.column(c).to_pylist()
    node, component, block = column("node"), column("component"), np.array(column("block"))
    sets = [(np.frombuffer(h, "<u8"), np.frombuffer(t, "<u4")) for h, t in zip(column("hashes"), column("times"))]
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    if block.min() != own.column("first")[0].as_py() or block.max() != own.column("second")[0].as_py():
        return []  # the other block is empty
    if len(set(component)) < 2:
        return []
    size = np.array([len(h) for h, _ in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, shingle, found = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
    number = np.cumsum(found > 1) - 1  # shingles of one node only meet nothing
    weight = np.concatenate([weights(t) / weights(t).sum() for _, t in sets]).astype(np.float32)
    shared = np.flatnonzero(found[shingle] > 1)
    shared = shared[np.argsort(number[shingle[shared]], kind="stable")]
    at, owner, weight = number[shingle[shared]], owner[shared], weight[shared]
    repeats = np.array([bool((t > 1).any()) for _, t in sets])
    both = np.zeros((len(left), len(right)), np.float32)
    mass = np.zeros((2, *both.shape), np.float32)
    for begin in range(0, int(at[-1]) + 1 if len(at) else 0, CROWD_COLUMNS):
        a, b = np.searchsorted(at, (begin, begin + CROWD_COLUMNS))
        there = np.zeros((len(sets), min(CROWD_COLUMNS, int(at[b - 1]) - begin + 1)), np.float32)
        there[owner[a:b], at[a:b] - begin] = 1
        both += there[left] @ there[right].T
        if repeats.any():
            weighed = np.zeros_like(there)
            weighed[owner[a:b], at[a:b] - begin] = weight[a:b]
            mass[0] += weighed[left] @ there[right].T
            mass[1] += there[left] @ weighed[right].T
    union = size[left][:, None] + size[right] - both
    plain = both / np.maximum(union, 1)
    sure = plain >= threshold - 1e-6
    # without repeated shingles both similarities are equal; the mass of the shared shingles bounds the other one
    maybe = ~sure & (repeats[left][:, None] | repeats[right]) & (mass.min(axis=0) >= threshold - 1e-4)
    up = {c: c for c in component}

    def root(c):
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    out = []
    for some in (sure, maybe):
        for i, j in zip(*np.nonzero(some)):
            i, j = left[i], right[j]
            a, b = root(component[i]), root(component[j])
            if a == b:
                continue
            similarity = max(jaccards(sets[i], sets[j]))
            if similarity >= threshold - 1e-9:
                up[max(a, b)] = min(a, b)
                out.append((min(node[i], node[j]), max(node[i], node[j]), similarity))
    return out


def mixed_crowds(crowds: DataFrame, labels: DataFrame) -> DataFrame:
    """`key, node, component, one` of the large buckets with nodes of more than one component; `one` is a node of each."""
    own = crowds.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = own.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("one"))
    return own.join(ends.where("low != high").drop("low", "high"), "key")


def crowd_links(mixed: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`a, b, similarity`: exact links between the components that large buckets hold.

    Buckets with common nodes are a crowd, whose nodes are dealt to blocks. All blocks are compared with each other, but
    those of the crowd's largest component only with the others.
    """
    groups = components(mixed.select(F.col("one").alias("a"), F.col("node").alias("b")))
    groups = groups.select("node", F.col("component").alias("crowd"))
    rows = mixed.select("node", "component").distinct().join(groups, "node", "left")
    sizes = sets.select("node", F.octet_length("hashes").alias("bytes"))
    rows = rows.withColumn("crowd", F.coalesce("crowd", "node")).join(sizes, "node")
    rows = store.written(rows, "near-crowds")
    parts = rows.groupBy("crowd", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    main = F.max(F.struct("n", "component", "bytes"))
    whole = parts.groupBy("crowd").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(
        F.ceil(n / F.lit(CROWD_NODES)), F.ceil(size / F.lit(CROWD_BYTES)), F.lit(1)).cast("int")
    whole = whole.where(F.col("n") > F.col("main.n")).select(
        "crowd", F.col("main.component").alias("largest"), blocks(F.col("main.n"), F.col("main.bytes")).alias("n_main"),
        blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("n_other"))
    rows = rows.join(whole, "crowd")
    is_main, dealt = F.col("component") == F.col("largest"), F.xxhash64("node", F.lit(7))
    block = F.when(is_main, F.col("n_other") + F.pmod(dealt, F.col("n_main"))).otherwise(F.pmod(dealt, F.col("n_other")))
    rows = rows.withColumn("block", block.cast("int"))
    partners = F.when(is_main, F.col("n_other")).otherwise(F.col("n_other") + F.col("n_main"))
    rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), (partners - 1).cast("int"))))
    rows = rows.select("crowd", F.least("block", "partner").alias("first"), F.greatest("block", "partner").alias("second"),
                       "node", "component", "block").join(sets, "node")

    def compare(own: pa.Table) -> pa.Table:
        links = _block_links(own, threshold)
        columns = list(zip(*links)) or [(), (), ()]
        return pa.table({"a": pa.array(columns[0], pa.binary()), "b": pa.array(columns[1], pa.binary()),
                         "similarity": pa.array(columns[2], pa.float64())})

    return rows.groupBy("crowd", "first", "second").applyInArrow(compare, "a binary, b binary, similarity double")


def node_links(docs: DataFrame, nodes: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Links that hold all components together: each node's best pair first, then all pairs between components, then what
    crowds still hold."""
    pairs, crowds = candidates(nodes)
    pairs = store.written(pairs, "near-pairs")
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    both = both.unionByName(crowds.select("node")).distinct()
    sets = store.written(shingle_sets(docs, store.written(both, "near-wanted"), text), "near-sets")
    ends = [pairs.select(F.col(x).alias("node"), F.struct(F.col("estimate"), "a", "b").alias("pair")) for x in ("a", "b")]
    best = ends[0].unionByName(ends[1]).groupBy("node").agg(F.max("pair").alias("pair"))
    best = best.select("pair.a", "pair.b").distinct()
    first = store.written(verified(best, sets, threshold), "near-links")
    rest = _labelled(pairs.join(best, ["a", "b"], "left_anti"), components(first))
    links = first.unionByName(store.written(verified(rest.select("a", "b"), sets, threshold), "near-links"))
    mixed = store.written(mixed_crowds(crowds, components(links)), "near-crowds")
    if mixed.isEmpty():
        return links
    return links.unionByName(store.written(crowd_links(mixed, sets, threshold), "near-links"))


def _signed_and_labelled(docs: DataFrame, text: str, threshold: float, keep: tuple[str, ...] = ()):
    """The written signatures of all documents, and the component of each node that has links."""
    signed = store.written(signatures(docs, text, keep), "near-signatures")
    names = [f.name for f in _SIGNED if f.name != "node"]
    nodes = signed.groupBy("node").agg(*[F.first(c).alias(c) for c in names])
    nodes = store.written(forms(nodes), "near-nodes")
    return signed, components(node_links(docs, nodes, text, threshold))


def near_classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, node, class_id, keeper, keeper_node, n_same`, one row for each different (`doc_id`, `node`): the class,
    the document of the class that stays (the smallest id, then node), and how many rows the pair has."""
    signed, labels = _signed_and_labelled(docs, text, threshold)
    rows = signed.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n_same"))
    own = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = store.written(own, "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    keep = own.groupBy("component").agg(F.min(order).alias("keep"))
    out = own.join(keep, "component")
    return out.select("doc_id", "node", F.col("keep.doc_id").alias("class_id"), F.col("keep.doc_id").alias("keeper"),
                      F.col("keep.node").alias("keeper_node"), "n_same")


def with_class(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id, class_id, is_keeper`, one row per row of `docs`; of rows repeated whole only one is the keeper."""
    found = near_classes(docs, text)
    stays = F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("node") == F.col("keeper_node"))
    nth = F.explode(F.sequence(F.lit(1), F.col("n_same"))).alias("nth")
    return found.select("doc_id", "class_id", stays.alias("stays"), nth).select(
        "doc_id", "class_id", (F.col("stays") & (F.col("nth") == 1)).alias("is_keeper")
    )


def _placed(docs: DataFrame) -> DataFrame:
    """`docs` as a table whose rows have a place (file and row in it): as it is, or written where it isn't read from files."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return store.written(docs, "near-docs")
    return docs


def deduplicated(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class, all columns as they were.

    Who stays is decided on ids, nodes and places of rows; whole rows then meet the places that stay in one exchange.
    """
    docs = _placed(docs)
    place = [F.col("_metadata.file_path").alias("near_file"), F.col("_metadata.row_index").alias("near_nth")]
    names = ["near_file", "near_nth"]
    own = docs.select("doc_id", F.col(text).alias("text"), *place)
    signed, labels = _signed_and_labelled(own, "text", threshold, tuple(names))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", *names)).alias("first")
    firsts = signed.groupBy("node").agg(order).join(labels, "node", "left")
    firsts = firsts.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    stay = store.written(firsts.select("first.near_file", "first.near_nth"), "near-stay")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *place)
    # one plan at every size: what stays grows with the table, so it is never broadcast
    out = whole.join(stay.hint("merge"), names, "left_semi")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
