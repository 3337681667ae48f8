"""Scrubbing leaves texts without hits alone, whatever they look like."""

import time

from echotrail.operators import governance as gov


def test_a_long_run_without_an_address_is_not_searched_for_one(spark):
    rows = [(1, "a" * 150_000), (2, None), (3, "x@y.org and Dr. Ada Lovelace"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    start = time.time()
    out = {r["doc_id"]: r for r in gov.scrub_pii(docs).collect()}
    assert time.time() - start < 10  # about half a minute if every start of the run is tried, twice
    assert out[1]["scrubbed"] == rows[0][1] and out[1]["n_email"] == 0
    assert out[2]["scrubbed"] is None and out[2]["n_email"] is None and out[2]["n_name"] is None
    assert out[3]["scrubbed"] == "[REDACTED_EMAIL] and [REDACTED_NAME]" and out[3]["n_name"] == 1
    # A caller's own pattern for a label is searched everywhere.
    own = {r["doc_id"]: r["n_email"] for r in gov.scrub_pii(docs, {"Email": "x"}).collect()}
    assert own == {1: 0, 2: None, 3: 1, 4: 0}
