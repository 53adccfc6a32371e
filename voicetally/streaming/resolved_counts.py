"""Guest turns counted over a stream, with names resolved as in a batch over all that has come so far.

A bare surname stands for the only full name of that surname, and later files can bring that name, or a second one. So the stream
writes differences: what a name was counted as so far is taken back when it comes to mean someone else, and the sum of all
differences is the batch's count at any time. State per surname: at most two full names (a second one settles that the surname is
ambiguous for good), and, until then, how often the bare surname came per year and mode.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..operators.resolve import alias_table
from ..operators.turns import parse_turns
from ..plans.pipeline import provenance
from ..sources.tables import scratch

#: State needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
KEYS = ["surname", "kind", "name", "year", "mode"]
MENTIONS = "surname string, kind string, name string, year int, mode string, n long"
CHANGES = "year int, mode string, canonical_id string, n long"


class Surname(StatefulProcessor):
    """The differences that new mentions of a surname make."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getValueState("names", "first string, second string")
        self.bare = handle.getMapState("bare", "year int, mode string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (surname,) = key
        now = pd.concat(list(rows)).groupby(["kind", "name", "year", "mode"], as_index=False)["n"].sum()
        full, bare = now[now["kind"] == "full"], now[now["kind"] == "bare"]
        first, second = self.names.get() if self.names.exists() else (None, None)
        known = [x for x in (first, second) if x is not None]
        was = self._means(surname, known)
        for name in sorted(set(full["name"])):
            if name not in known and len(known) < 2:
                known.append(name)
        if len(known) > (first is not None) + (second is not None):
            self.names.update((known[0], known[1] if len(known) > 1 else None))
        means = self._means(surname, known)
        changes = [(y, m, means if kind == "bare" else name, n) for kind, name, y, m, n in now.itertuples(index=False)]
        if means != was:
            for (y, m), (n,) in self.bare.iterator():
                changes += [(y, m, was, -n), (y, m, means, n)]
        if len(known) > 1:
            self.bare.clear()
        else:
            for y, m, n in zip(bare["year"], bare["mode"], bare["n"]):
                at = (int(y), m)
                self.bare.updateValue(at, ((self.bare.getValue(at)[0] if self.bare.containsKey(at) else 0) + int(n),))
        if changes:
            yield pd.DataFrame(changes, columns=["year", "mode", "canonical_id", "n"])

    @staticmethod
    def _means(surname: str, known: list[str]) -> str:
        return f"ambiguous:{surname}" if len(known) > 1 else known[0] if known else surname

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per task, so that a frequent surname sends few rows to its state."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(KEYS).aggregate([("n", "sum")]).rename_columns([*KEYS, "n"])
        yield from t.select([*KEYS, "n"]).combine_chunks().to_batches()


def mentions(segments: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Counted names of guests' turns by surname: aliases as the person they stand for, full names, bare surnames."""
    t = parse_turns(provenance(segments, strict=False), keep=("year",)).where("staff_flag = 'guest' and year is not null")
    table = alias_table(segments.sparkSession, aliases).select(F.col("alias").alias("_n"), F.col("person").alias("_person"))
    t = t.withColumn("_n", X.normalize_name("name_norm")).where("_n <> ''").join(table, "_n", "left")
    kind = F.when(F.col("_person").isNotNull(), "alias").when(F.col("_n").contains(" "), "full").otherwise("bare")
    name = F.coalesce("_person", "_n")
    rows = t.select(X.surname("_n").alias("surname"), kind.alias("kind"), name.alias("name"), "year", F.col("source_mode").alias("mode"), F.lit(1).cast("long").alias("n"))
    return rows.mapInArrow(_combined, MENTIONS)


def count_changes(segments: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The stream of differences by year, mode and person, for append mode."""
    return mentions(segments, aliases).groupBy("surname").transformWithStateInPandas(Surname(), CHANGES, "Append", "None")


def totals(changes: DataFrame) -> DataFrame:
    """What the differences so far add up to."""
    return changes.groupBy("year", "mode", "canonical_id").agg(F.sum("n").alias("n")).where("n <> 0")


def run_available(segments: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """All files that are there, counted in as many batches as the source makes of them; differences go to Parquet files in the
    shared folder, from which the totals are read."""
    spark: SparkSession = segments.sparkSession
    path = scratch(spark, "turn-changes")
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        q = count_changes(segments, aliases).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "turn-changes-log")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)
    return totals(spark.read.schema(CHANGES).parquet(path))
