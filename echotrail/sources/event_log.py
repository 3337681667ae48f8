"""Events laid out by time: typed columns written once at ingest, pages that open the newest files only.

A log folder holds segments, one per ingest. The rows of a segment are range-partitioned and sorted by
(timestamp, id), so every file covers a stretch of time; ``files`` says which, and which sources and projects occur
in it. A page walks the files from the newest stretch backwards and stops as soon as no unread file can hold a row
of it. Beside the events each ingest writes counts per source, project, type and day; summaries read those alone,
and deletion takes rows off them.

A segment counts once its row stands in ``segments``, so a writer that dies before leaves nothing visible.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrail.operators.events import as_instant, before_cursor, event_summary, filter_scope, timeline_page
from echotrail.session import cut_lineage, discard, small_side, written

ROWS_PER_FILE = 1_000_000
# A file lists the sources and projects in it if they are no more than this.
LISTED = 64
FIRST_FILES = 2
CELL = ["source", "project", "type", "day"]

FILES = "segment long, file string, n long, low timestamp, high timestamp, sources array<string>, projects array<string>"
ROLLUP = "source string, project string, type string, day date, n long, high timestamp, low timestamp, exact boolean"


def _instant(value) -> Column:
    return F.lit(as_instant(value)).cast("timestamp") if value is not None else F.lit(None).cast("timestamp")


class EventLog:
    """A log folder. ``append`` takes rows as ``normalize_events`` gives them; the caller says which are new."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _has(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def segments(self) -> list[int]:
        if not self._has("segments"):
            return []
        rows = self.spark.read.parquet(f"{self.path}/segments").collect()  # one row per write
        replaced = {s for r in rows for s in r["replaces"]}
        return sorted(r["segment"] for r in rows if r["segment"] not in replaced)

    def _numbers(self) -> list[int]:
        return [r["segment"] for r in self.spark.read.parquet(f"{self.path}/segments").collect()] if self._has("segments") else []

    def _tables(self, name: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/{name}/{s}" for s in self.segments() if self._has(f"{name}/{s}")]
        return self.spark.read.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _commit(self, segment: int, replaces: list[int] = ()) -> None:
        row = self.spark.createDataFrame([(segment, list(replaces))], "segment long, replaces array<long>")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def append(self, events: DataFrame, rows_per_file: int = ROWS_PER_FILE, replaces: list[int] = ()) -> int:
        """Write ``events`` as one more segment and return its number. One writer at a time.

        Range partitioning reads its input twice, so the events are worked out once and kept aside.
        """
        aside = written(events)
        segment = self._store(aside, rows_per_file, replaces)
        discard(aside)
        return segment

    def _store(self, events: DataFrame, rows_per_file: int, replaces: list[int]) -> int:
        segment = max(self._numbers(), default=0) + 1
        folder = f"{self.path}/events/{segment}"
        ordered = events.repartitionByRange("timestamp", "id").sortWithinPartitions("timestamp", "id")
        ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(folder)
        stored = self.spark.read.parquet(folder)

        def few(column: str) -> Column:
            # A file has at most rows_per_file rows, which bounds the set.
            seen = F.collect_set(F.coalesce(F.col(column), F.lit("")))
            return F.when(F.size(seen) <= LISTED, seen).otherwise(F.lit(None).cast("array<string>"))

        cells = stored.select("*", F.col("_metadata.file_path").alias("file")).groupBy("file", "source", "project").agg(
            F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
        files = cells.groupBy("file").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), few("source").alias("sources"), few("project").alias("projects"))
        files.select(F.lit(segment).cast("long").alias("segment"), *[c.split()[0] for c in FILES.split(", ")[1:]]).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/files/{segment}")
        self.roll_up(stored).write.mode("overwrite").parquet(f"{self.path}/rollup/{segment}")
        self._commit(segment, replaces)
        return segment

    @staticmethod
    def roll_up(events: DataFrame) -> DataFrame:
        """Counts, newest and oldest instants per source, project, type and day."""
        return events.groupBy("source", "project", "type", F.to_date("timestamp").alias("day")).agg(
            F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("high"), F.min("timestamp").alias("low"), F.lit(True).alias("exact"))

    def files(self, since=None, until=None, sources=None, projects=None) -> DataFrame:
        """Files that can hold rows of a scope."""
        files = self._tables("files", FILES)
        wanted = F.lit(True)
        if since is not None:
            wanted = wanted & (F.col("high") >= _instant(since))
        if until is not None:
            wanted = wanted & (F.col("low") < _instant(until))
        for column, values in (("sources", sources), ("projects", projects)):
            if values is not None:
                listed = F.array(*[F.lit("" if v is None else v) for v in values]).cast("array<string>")
                wanted = wanted & (F.col(column).isNull() | F.arrays_overlap(column, listed))
        return files.filter(wanted)

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            folders = [f"{self.path}/events/{s}" for s in self.segments() if self._has(f"events/{s}")]
            if not folders:
                raise ValueError("nothing was ever written to this log")
            return self.spark.read.parquet(folders[0]).limit(0)
        rows = self.spark.read.parquet(*files)
        return rows.join(small_side(self.gone(), 64), "id", "left_anti")

    def gone(self) -> DataFrame:
        return self._tables("gone", "id string").distinct()

    def scan(self, **scope) -> DataFrame:
        """Rows of a scope from the files that can hold some; the scope's bounds also reach the reader."""
        chosen = [r["file"] for r in self.files(**scope).select("file").toLocalIterator()]
        return filter_scope(self._read(sorted(chosen)), **scope)

    def page_files(self, limit: int, after: tuple | None = None, **scope) -> tuple[list[str], tuple[int, str] | None]:
        """Files that a page needs, and the last row (microseconds, id) on it if it is full.

        Files come by their newest instant, a few at first and twice as many each time; of each wave the driver
        sees at most ``limit + 1`` pairs. The walk ends when the newest instant of the next file is older than the
        last row of a full page.
        """
        bounds = dict(scope)
        if after is not None:
            # A page behind a row begins at its instant; half-open bounds end just above it.
            until = as_instant(after[0]) + timedelta(microseconds=1)
            bounds["until"] = min(until, as_instant(scope["until"])) if scope.get("until") is not None else until
        ordered = self.files(**bounds).select("file", F.unix_micros("high").alias("high")).orderBy(F.desc("high"), F.asc("file"))
        files: list[str] = []
        newest: list[tuple[int, str]] = []
        wave = FIRST_FILES
        while True:
            found = ordered.offset(len(files)).limit(wave + 1).collect()
            part = [r["file"] for r in found[:wave]]
            files += part
            if part:
                rows = timeline_page(self._read(part), limit, after, **scope).select(F.unix_micros("timestamp").alias("at"), "id").collect()
                newest = sorted(newest + [(r["at"], r["id"]) for r in rows], reverse=True)[:limit + 1]
            if len(found) <= wave:
                break
            if len(newest) > limit and found[wave]["high"] < newest[-1][0]:
                break
            wave *= 2
        return files, newest[-1] if len(newest) > limit else None

    def page(self, limit: int = 20, after: tuple | None = None, **scope) -> DataFrame:
        """Newest events of a scope, ``limit + 1`` of them, as ``timeline_page`` over all events gives them."""
        files, last = self.page_files(limit, after, **scope)
        rows = self._read(files)
        if last is not None:
            rows = rows.filter(~before_cursor(F.timestamp_micros(F.lit(last[0])), last[1]))
        return timeline_page(rows, limit, after, **scope)

    def forget(self, ids: DataFrame) -> int:
        """Take ``ids(id)`` out of the log and off the counts; returns how many rows went.

        A day's newest and oldest instants can no longer be trusted when one of its rows goes; such cells are read
        again by ``summary``.
        """
        every = [r["file"] for r in self._tables("files", FILES).select("file").toLocalIterator()]
        lost = cut_lineage(self._read(every).join(small_side(ids.select("id").distinct(), 64), "id", "left_semi").select("id", "source", "project", "type", "timestamp"))
        n = lost.count()
        if n:
            segment = max(self._numbers()) + 1
            lost.select("id").write.mode("overwrite").parquet(f"{self.path}/gone/{segment}")
            taken = self.roll_up(lost).withColumns({"n": -F.col("n"), "exact": F.lit(False)})
            taken.write.mode("overwrite").parquet(f"{self.path}/rollup/{segment}")
            self._commit(segment)
        return n

    def cells(self) -> DataFrame:
        """The counts per source, project, type and day, merged over all segments. ``exact``: high and low hold."""
        return self._tables("rollup", ROLLUP).groupBy(*CELL).agg(
            F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"), F.bool_and("exact").alias("exact")).filter("n > 0")

    def counts(self, keys: list[str]) -> DataFrame:
        """Rows per ``keys``, any of source, project, type and day: from the counts alone."""
        return self.cells().groupBy(*keys).agg(F.sum("n").alias("n"))

    def summary(self) -> DataFrame:
        """What ``event_summary`` gives over all events. Reads the counts, and of the events only days on which rows were forgotten."""
        cells = cut_lineage(self.cells())
        stale = cells.filter(~F.col("exact"))
        per_type = cells.filter("exact").groupBy("type").agg(F.sum("n").alias("n"), F.max("high").alias("hi"), F.min("low").alias("lo"))
        days = [r["day"] for r in stale.select("day").distinct().toLocalIterator()]
        if days:
            stretches = F.array(*[F.lit(d) for d in days])
            day = F.to_date("low")
            # A file can hold a stale day if one lies between its first and last day.
            near = self._tables("files", FILES).filter(F.exists(stretches, lambda d: (d >= day) & (d <= F.to_date("high"))))
            again = self.roll_up(self._read([r["file"] for r in near.select("file").toLocalIterator()]).filter(F.to_date("timestamp").isin(days)))
            joined = again.alias("a").join(small_side(stale, 256).alias("s"), [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in CELL], "left_semi")
            per_type = per_type.unionByName(joined.groupBy("type").agg(F.sum("n").alias("n"), F.max("high").alias("hi"), F.min("low").alias("lo")))
        per_type = per_type.groupBy("type").agg(F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
        return per_type.agg(
            F.sum("n").alias("count"), F.sort_array(F.collect_list(F.struct("type", "n"))).alias("types"),
            F.max("hi").alias("newest"), F.min("lo").alias("oldest"))

    def newest_summary(self, limit: int = 20) -> DataFrame:
        """Summary of the ``limit`` newest events, which a page finds."""
        return event_summary(self.page(limit).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit))

    def compact(self, rows_per_file: int = ROWS_PER_FILE) -> int:
        """Rewrite all segments as one, without the forgotten rows, and let it take their place in one commit.

        Many small segments overlap in time, and then every page opens many files.
        """
        old = self.segments()
        every = [r["file"] for r in self._tables("files", FILES).select("file").toLocalIterator()]
        return self._store(self._read(every), rows_per_file, old)
