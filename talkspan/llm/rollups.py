"""Token counts kept up to date by deltas: additive totals by source, language and tokenizer version.

A batch holds events on (document, tokenizer version): `insert`, `delete` and `revise` with the document's count. Its old
counts are looked up in the ledger, and what changes is one signed row per old and new group: documents and tokens leave
the old group and enter the new one. The batch writes its ledger rows and the summed signed rows under a name of its own and
then a commit row. Only committed names are read, a committed batch number is not applied again, and a batch that broke off
leaves nothing that counts, so repeating a batch is always safe.

Totals are the sums of the committed deltas, a few rows per batch and group. Events and ledger meet by document in one
shuffle; a source with most of all documents only meets in sums, which are combined before they are moved. The ledger is
dealt to `BUCKETS` folders by document, and a batch reads only the buckets, and in their files only the range of ids, that
its own events name.

What counts is the order of commits, not of batch numbers: a batch that comes late is applied to what is there by then, so
ledger and totals always agree. Of several commits of one batch (two writers at once) the first counts.

Tables below `root`: `ledger` (seq, doc_id, version, source, lang, n_tokens, present, by bucket), `deltas` (seq, source,
lang, version, docs, tokens) and `commits` (seq, batch, name, is_snapshot). `compact` folds what is committed into one
snapshot.

Defined results: of several events of a batch on one key the one with the largest `seq` counts (then delete before revise
before insert, then the larger count); a delete or revise of what is not there does nothing; an insert of what is there
counts as revise; a null count is 0; null ids, versions, sources and languages are values of their own; groups without
documents are left out. Batches have numbers and are applied one after the other, in any order. Other input columns are
ignored; ids are whole numbers.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspan.llm import store

INSERT, DELETE, REVISE = "insert", "delete", "revise"
_KEY = ["doc_id", "version"]
_GROUP = ["source", "lang", "version"]

#: Folders of the ledger. Fixed: a document's bucket must not change.
BUCKETS = 16

_COMMIT = "seq long, batch long, name string, is_snapshot boolean"
_LEDGER = "seq long, doc_id long, version string, source string, lang string, n_tokens long, present boolean, bucket int"
_DELTA = "seq long, source string, lang string, version string, docs long, tokens long"


def _bucket():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


class Rollup:
    """Totals and ledger below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}/{name}"

    def commits(self) -> list[tuple[int, int, str, bool]]:
        """Sequence, batch, name and kind of all commits, one row per batch or snapshot."""
        reader = self.spark.read.schema(_COMMIT).option("recursiveFileLookup", "true")
        try:
            rows = sorted(tuple(r) for r in reader.json(f"{self.root}/commits").collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []  # nothing is committed yet
        first = {}
        for row in rows:
            first.setdefault(row[2] if row[3] else row[1], row)
        return sorted(first.values())

    @staticmethod
    def _counting(commits) -> list[str]:
        """Names of the newest snapshot and the batches committed behind it."""
        base = [c for c in commits if c[3]][-1:]
        since = base[0][0] if base else -1
        return [name for _, _, name, _ in base] + [name for seq, _, name, snap in commits if not snap and seq > since]

    def _read(self, kind: str, schema: str, commits=None) -> DataFrame:
        names = self._counting(self.commits() if commits is None else commits)
        if not names:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(self._path(kind, name)) for name in names]
        return reduce(DataFrame.unionByName, parts)

    def _commit(self, seq: int, batch: int, name: str, is_snapshot: bool) -> None:
        row = self.spark.createDataFrame([(seq, batch, name, is_snapshot)], _COMMIT).coalesce(1)
        row.write.mode("errorifexists").json(f"{self.root}/commits/{name}")

    def state(self, events: DataFrame | None = None) -> DataFrame:
        """The newest ledger row of each (document, version); only buckets and ids that `events` name, if given."""
        rows = self._read("ledger", _LEDGER)
        if events is not None:
            named = events.agg(F.collect_set(_bucket()).alias("buckets"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                               F.max(F.col("doc_id").isNull()).alias("none")).first()
            ids = F.lit(False) if named["low"] is None else F.col("doc_id").between(named["low"], named["high"])
            rows = rows.where(F.col("bucket").isin(named["buckets"]) & (ids | F.col("doc_id").isNull() if named["none"] else ids))
        row = F.struct("seq", "source", "lang", "n_tokens", "present")
        newest = rows.groupBy(*_KEY).agg(F.max_by(row, "seq").alias("was"))
        return newest.select(*_KEY, "was.*")

    def totals(self) -> DataFrame:
        """`source, lang, version, docs, tokens`."""
        sums = self._read("deltas", _DELTA).groupBy(*_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where(F.col("docs") != 0)

    def apply(self, batch: int, events: DataFrame) -> bool:
        """Applies a batch of `doc_id, version, source, lang, n_tokens, op` (and `seq`); False if it already counts."""
        done = self.commits()
        if any(b == batch and not snap for _, b, _, snap in done):
            return False
        seq = 1 + max((c[0] for c in done), default=0)
        name = f"batch-{batch}-{uuid.uuid4().hex}"
        last = store.written(_last_events(events), "rollup-events")
        changes = last.join(self._old(last), self._same(), "left") if done else last
        self._write(seq, name, _changed(changes, bool(done)))
        self._commit(seq, batch, name, False)
        return True

    def _old(self, events: DataFrame) -> DataFrame:
        state = self.state(events).where("present")
        return state.select(*(F.col(c).alias(f"old_{c}") for c in (*_KEY, "source", "lang", "n_tokens")), F.lit(True).alias("old"))

    @staticmethod
    def _same():
        return F.col("doc_id").eqNullSafe(F.col("old_doc_id")) & F.col("version").eqNullSafe(F.col("old_version"))

    def _write(self, seq: int, name: str, changed: DataFrame) -> None:
        ledger = changed.select(F.lit(seq).cast("long").alias("seq"), *_KEY, "source", "lang", "n_tokens", "present", "old",
                                "old_source", "old_lang", "old_n_tokens", _bucket().alias("bucket"))
        # once: the deltas are made of what is written
        ledger.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(
            self._path("ledger", name))
        kept = self.spark.read.schema(ledger.schema).parquet(self._path("ledger", name))
        signed = F.array(
            F.when(F.col("old"), F.struct(
                F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).alias("docs"),
                (-F.col("old_n_tokens")).alias("tokens"))),
            F.when(F.col("present"), F.struct("source", "lang", F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))),
        )
        rows = kept.select("version", F.explode(F.filter(signed, lambda x: x.isNotNull())).alias("x")).select("version", "x.*")
        sums = rows.groupBy(*_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.select(F.lit(seq).cast("long").alias("seq"), *_GROUP, "docs", "tokens").write.parquet(self._path("deltas", name))

    def compact(self) -> None:
        """Folds ledger and deltas of all that counts into one snapshot; which batches are applied stays known."""
        done = self.commits()
        if len(self._counting(done)) < 2:
            return
        seq, name = done[-1][0] + 1, f"snapshot-{uuid.uuid4().hex}"
        number = F.lit(done[-1][0]).cast("long").alias("seq")
        state = self.state()
        ledger = state.select(number, *(c for c in state.columns if c != "seq"), _bucket().alias("bucket"))
        ledger.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(
            self._path("ledger", name))
        self.totals().select(number, *_GROUP, "docs", "tokens").write.parquet(self._path("deltas", name))
        self._commit(seq, done[-1][1], name, True)


def _last_events(events: DataFrame) -> DataFrame:
    seq = F.col("seq").cast("long") if "seq" in events.columns else F.lit(0).cast("long")
    rows = events.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("string").alias("version"), "source", "lang",
        F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), "op", seq.alias("seq"),
    ).where(F.col("op").isin(INSERT, DELETE, REVISE))
    weight = F.when(F.col("op") == DELETE, 2).when(F.col("op") == REVISE, 1).otherwise(0)
    rank = F.struct("seq", weight.alias("weight"), "n_tokens", "source", "lang")
    row = F.struct("source", "lang", "n_tokens", "op")
    return rows.groupBy(*_KEY).agg(F.max_by(row, rank).alias("event")).select(*_KEY, "event.*")


def _changed(changes: DataFrame, with_old: bool) -> DataFrame:
    """What each event makes of its key: ledger columns with the old group; events without effect are left out."""
    if with_old:
        changes = changes.withColumn("old", F.coalesce("old", F.lit(False)))
    else:
        none = {"old": F.lit(False), "old_source": F.lit(None).cast("string"), "old_lang": F.lit(None).cast("string"),
                "old_n_tokens": F.lit(None).cast("long")}
        changes = changes.withColumns(none)
    takes = (F.col("op") == INSERT) | F.col("old")
    return changes.where(takes).withColumn("present", F.col("op") != DELETE)


def count_events(counts: DataFrame, version: str, op: str, n_tokens: str) -> DataFrame:
    """Events of one kind for the documents of `counts`."""
    return counts.select("doc_id", F.lit(version).alias("version"), "source", "lang", F.col(n_tokens).alias("n_tokens"),
                         F.lit(op).alias("op"))
