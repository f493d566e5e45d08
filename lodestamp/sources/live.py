"""The live inventory table behind a REST interface of the PostgREST kind, as a Spark data source.

Reading. The schema says which columns are asked for, so nothing else travels. Partitions are ranges of the key, the first open below and the last open above, so
that wrong bounds lose no row; each goes from page to page by the last key it has seen until a page is short, so rows inserted meanwhile shift nothing.

Writing. Tasks post their rows, in pages, to the table ``<table>_staged`` under the name of the run and a number for each row that a retry repeats, so that a row that
comes again replaces itself. Only the commit publishes them, by one call of ``rpc/publish`` with the run, which inserts of each serial the first that the table doesn't have; a job that
fails deletes its run. A run that is committed again publishes nothing new.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, PAGE = "lodestamp_live", 1000  # fixed value: rows of a page


def call(options, path: str, query: dict[str, str] | list[tuple[str, str]] = (), method: str = "GET", body=None):
    """One request; the answer as JSON, None if it has none."""
    pairs = urllib.parse.urlencode(list(query.items()) if isinstance(query, dict) else query, safe=",.()")
    headers = {"Content-Type": "application/json", "Prefer": "resolution=merge-duplicates"} | ({"Authorization": f"Bearer {options['token']}"} if options.get("token") else {})
    request = urllib.request.Request(
        f"{options['url'].rstrip('/')}/{path}" + (f"?{pairs}" if pairs else ""), method=method, headers=headers,
        data=None if body is None else json.dumps(body, default=str).encode()
    )
    with urllib.request.urlopen(request, timeout=float(options.get("timeout", 60))) as answer:
        said = answer.read()
    return json.loads(said) if said else None


@dataclass
class KeyRange(InputPartition):
    above: int | None
    upto: int | None


class LiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options = schema.names, options
        self.key, self.page = options.get("key", "id"), int(options.get("page", PAGE))

    def partitions(self) -> list[KeyRange]:
        n, low, high = int(self.options.get("partitions", 1)), int(self.options.get("lower", 0)), int(self.options.get("upper", 0))
        cuts = sorted({low + (high - low) * k // n for k in range(1, n)})
        return [KeyRange(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        asked = list(dict.fromkeys([*self.columns, self.key]))
        above = partition.above
        while True:
            query = [("select", ",".join(asked)), ("order", f"{self.key}.asc"), ("limit", str(self.page))]
            query += [(self.key, f"gt.{above}")] if above is not None else []
            query += [(self.key, f"lte.{partition.upto}")] if partition.upto is not None else []
            rows = call(self.options, self.options["table"], query)
            yield from (tuple(r.get(c) for c in self.columns) for r in rows)
            if len(rows) < self.page:
                return
            above = rows[-1][self.key]


@dataclass
class Staged(WriterCommitMessage):
    n: int


class LiveWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options, self.page = options, int(options.get("page", PAGE))

    def write(self, iterator) -> Staged:
        from pyspark import TaskContext

        task, page, n = TaskContext.get().partitionId(), [], 0
        staged = f"{self.options['table']}_staged"
        for row in iterator:
            page.append({**row.asDict(recursive=True), "run": self.options["run"], "row": f"{task}-{n}"})
            n += 1
            if len(page) == self.page:
                call(self.options, staged, method="POST", body=page)
                page = []
        if page:
            call(self.options, staged, method="POST", body=page)
        return Staged(n)

    def commit(self, messages: list) -> None:
        call(self.options, "rpc/publish", method="POST", body={"run": self.options["run"], "target": self.options["table"], "rows": sum(m.n for m in messages if m)})

    def abort(self, messages: list) -> None:
        call(self.options, f"{self.options['table']}_staged", {"run": f"eq.{self.options['run']}"}, "DELETE")


class LiveTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> LiveReader:
        return LiveReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LiveWriter:
        return LiveWriter(dict(self.options))


def read_table(spark: SparkSession, url: str, table: str, schema: str, partitions: int = 16, upper: int = 0, **options) -> DataFrame:
    """The columns of ``schema`` of a live table, in ranges of its id up to about ``upper``."""
    spark.dataSource.register(LiveTable)
    return spark.read.format(NAME).schema(schema).options(url=url, table=table, partitions=partitions, upper=upper, **options).load()


def insert_rows(rows: DataFrame, url: str, table: str, run: str, owner: int | None, apply: bool = False, serial: str = "serial", order: str = "ord", **options) -> DataFrame:
    """Of each serial the first row, with its owner; written only with ``apply``, which needs one. ``run`` names the load: a repeated one inserts nothing twice."""
    if apply and owner is None:
        raise ValueError("an owner is needed to insert")
    first = F.row_number().over(Window.partitionBy(serial).orderBy(order))
    out = rows.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("cliente_id", F.lit(owner).cast("long"))
    if apply:
        rows.sparkSession.dataSource.register(LiveTable)
        out.write.format(NAME).mode("append").options(url=url, table=table, run=run, **options).save()
    return out
