"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to blocks; for every block the numbers of its rows that go to each shard are drawn at once, exactly as a
uniformly random permutation of all rows would spread them (multivariate hypergeometric, block after block without
replacement). Within a block a random order decides which rows those are; behind the exchange every shard is put into a
random order again. Shard sizes differ by one row at most, and every permutation is equally likely up to the random keys.

Only the block sizes and the matrix pass the driver: blocks x shards numbers, however many rows there are. Rows are
moved twice as (key, random) with the columns asked for, once by block and once by cell of (shard, slot range), so no task
holds a shard. Row numbers and random keys are written to the shared folder once, so lost executors change no draw.

`write` deals whole rows of files into shards: the permutation moves row places only, and the rows, however long, meet
their shard and slot in one exchange by file and row, behind which every task writes its rows of each shard by slot.

Defined results: every row is placed, whatever its columns hold; repeated rows are placed one by one; an empty table
gives no rows. Shard sizes follow from the number of rows: the first `rows mod shards` shards have one row more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.llm import store

#: Rows of a block or cell that one task sorts, about.
BLOCK_ROWS = 50_000
LEAST_BLOCKS = 64
#: Numpy draws from fewer places than this.
NUMPY_PLACES = 1_000_000_000


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """How many rows of each block go to each shard; rows and columns sum to the given sizes."""
    rng = np.random.default_rng(seed)
    left = np.array(shard_rows, np.int64)
    out = np.zeros((len(block_rows), len(shard_rows)), np.int64)
    for i, n in enumerate(block_rows):
        out[i] = _draw(rng, left, n)
        left -= out[i]
    return out


def _draw(rng, left: np.ndarray, n: int) -> np.ndarray:
    """How `n` rows without replacement fall on the open places of the shards."""
    total = int(left.sum())
    if total < NUMPY_PLACES:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out = np.zeros(len(left), np.int64)
    for j, good in enumerate(left.tolist()):
        out[j] = _hypergeometric(rng, good, total - good, n)
        total, n = total - good, n - int(out[j])
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """How many of `n` places drawn without replacement are good, from the probabilities within 12 standard deviations
    (and 50 places) of the mode; all others together have less than 1e-30."""
    low, high = max(0, n - bad), min(n, good)
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    reach = 50 + int(12 * (n * (good / max(good + bad, 1)) * (bad / max(good + bad, 1))) ** 0.5)
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log(n - k) + np.log(good - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def write(rows: DataFrame, path: str, n_shards: int, seed: int = 7) -> None:
    """Writes `row` (all columns of `rows`, a table as it is read from Parquet files) and `slot` below `path`, one folder
    for each `shard`. Each file is in the order of slots."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth")]
    placed = store.written(shuffled(rows.select(*place), n_shards, seed), "shard-places")
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *place)
    # one plan at every size: places follow the rows of the table, so they are never broadcast
    out = whole.join(placed.hint("merge"), ["file", "nth"]).select("row", "shard", "slot")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read(rows: DataFrame, path: str) -> DataFrame:
    """The shards of `rows` below `path`: `row`, `slot` and `shard`."""
    schema = T.StructType([
        T.StructField("row", rows.schema), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def shuffled(rows: DataFrame, n_shards: int, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` with `shard` (0 to n_shards - 1) and `slot`, gapless from 0 within each shard."""
    spark = rows.sparkSession
    carried = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    keyed = rows.select(carried, F.monotonically_increasing_id().alias("at"))
    keyed = keyed.select("row", "at", F.xxhash64("at", F.lit(seed)).alias("r1"), F.xxhash64("at", F.lit(seed + 1)).alias("r2"))
    keyed = store.written(keyed, "shard-rows")
    total = keyed.count()
    n_blocks = max(LEAST_BLOCKS, -(-total // block_rows))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(n_blocks)).cast("int"))
    found = {r["block"]: r["count"] for r in keyed.groupBy("block").count().collect()}  # n_blocks rows at most
    blocks = sorted(found)
    shard_rows = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([found[b] for b in blocks], shard_rows, seed)
    ends = spark.createDataFrame(
        [(b, np.cumsum(m).tolist()) for b, m in zip(blocks, matrix)], "block int, ends array<long>"
    )
    by_block = Window.partitionBy("block").orderBy("r1", "at")
    ranked = keyed.withColumn("rank", F.row_number().over(by_block))
    placed = ranked.join(ends, "block").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))

    # the second permutation: random keys cut each shard into cells, cells are numbered, rows ranked within
    n_cells = max(LEAST_BLOCKS // n_shards, -(-total // (n_shards * block_rows)))
    placed = placed.select("row", "at", "r2", "shard", F.pmod(F.col("r2"), F.lit(n_cells)).alias("cell"))
    by_cell = Window.partitionBy("shard", "cell").orderBy("r2", "at")
    inner = placed.withColumn("rank", F.row_number().over(by_cell))
    inner = store.written(inner.select("row", "shard", "cell", "rank"), "shard-cells")
    sizes = inner.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = inner.join(sizes, ["shard", "cell"])
    slot = (F.col("before") + F.col("rank") - 1).alias("slot")
    own = [F.col(f"row.`{c}`").alias(c) for c in rows.columns if c not in ("shard", "slot")]
    return out.select(*own, "shard", slot)
