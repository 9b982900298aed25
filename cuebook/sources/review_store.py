"""Cases and decisions as two tables bucketed alike by (bot, run, case).

A review join meets rows of one case. Both tables lie in the same buckets of that key, so last write wins,
``case_list``, the unknown-case guard and label collection need no shuffle; the one shuffle of a row is when it is
appended. The case is part of the bucket key on purpose: by (bot, run) alone a run with a third of all
cases would be one bucket and one task. Counts of a run then pass one exchange of partial counts, at most
runs x buckets rows.

The tables are external, below ``path`` (a shared folder); the catalog only holds their definition, which ``open``
restores. Appends of several writers at a time need a table format with commits; plain Parquet takes one at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import review
from ..plans.guard import check_identifier

KEY = review.DECISION_KEY
DECISIONS_SCHEMA = "bot_id string, run_id string, case_id string, decision string, note string, reviewer string, updated_at timestamp"


@dataclass
class ReviewStore:
    spark: SparkSession
    name: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, name: str, path: str, cases: T.StructType | str, buckets: int = 200) -> ReviewStore:
        """The store ``name`` below ``path``, made if it is new. ``cases``: the schema of its cases; ``buckets`` is fixed for its life."""
        store = cls(spark, check_identifier(name), buckets)
        for kind, schema in (("cases", cases), ("decisions", DECISIONS_SCHEMA)):
            fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            missing = set(KEY) - set(fields.names)
            if missing:
                raise ValueError(f"{kind} lack {sorted(missing)}")
            ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields.fields)
            location = f"{path.rstrip('/')}/{kind}".replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {store.table(kind)} ({ddl}) USING parquet "
                      f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{location}'")
        return store

    def table(self, kind: str) -> str:
        return f"{self.name}_{kind}"

    def _append(self, kind: str, rows: DataFrame) -> None:
        columns = self.spark.table(self.table(kind)).columns
        rows.select(*columns).repartition(self.buckets, *KEY).write.insertInto(self.table(kind))  # one file a bucket

    def add_cases(self, cases: DataFrame) -> None:
        self._append("cases", cases)

    def add_decisions(self, log: DataFrame) -> None:
        self._append("decisions", log)

    @property
    def cases(self) -> DataFrame:
        return self.spark.table(self.table("cases"))

    @property
    def log(self) -> DataFrame:
        return self.spark.table(self.table("decisions"))

    def decisions(self) -> DataFrame:
        """Last write wins, bucket by bucket."""
        return review.latest_decisions(self.log)

    def case_list(self) -> DataFrame:
        return review.case_list(self.cases, self.decisions())

    def tally(self) -> DataFrame:
        return review.tally(self.cases, self.decisions())

    def unknown(self) -> DataFrame:
        return review.unknown_case_decisions(self.decisions(), self.cases)

    def forget(self) -> None:
        """Drop the definitions; the files stay."""
        for kind in ("cases", "decisions"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(kind)}")
