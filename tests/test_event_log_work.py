"""What an ingest into the event log reads."""

import datetime as dt

from echotrail.sources.event_log import EventLog


def test_events_are_worked_out_once_by_an_ingest(spark, folder):
    rows = [(f"e{i:04d}", "s", "p", "note", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(300)]
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame(rows, "id string, source string, project string, type string, timestamp timestamp")
    log = EventLog(spark, folder)
    log.append(plain.mapInArrow(pass_on, plain.schema), rows_per_file=40)
    assert seen.value == 300
    log.append(plain.limit(5))
    log.compact(50)
    assert log.scan().count() == 305 and len(log.segments()) == 1
