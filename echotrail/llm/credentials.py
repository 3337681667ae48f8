"""Secret scans that also link the parts of one credential.

Three kinds of span count alone. Weaker candidates, such as a long random token or an account name, are
reported only when a part that completes them stands within the same scope of the text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrail.llm.common import name, text_of
from echotrail.session import written

# ---- fixed values: the kinds that count alone, in the order in which they are listed --------------
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 16
HEX = r"[0-9a-f]{32,}"
# ---------------------------------------------------------------------------------------------------

# Weaker kinds, and the roles in which all kinds take part in links.
LINKED_KINDS = ("account", "opaque", "endpoint")
KINDS = BASE_KINDS + LINKED_KINDS
ROLES = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "account": "id", "endpoint": "endpoint"}
# A weak kind is reported when every role named here has a part in scope.
NEEDS = {"account": ("secret",), "opaque": ("id",), "endpoint": ("id", "secret")}
SCOPE = 400

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
_ACCOUNT = re.compile(r"""(?:access|client|account|user|login)[_-]?(?:key[_-]?)?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.I | re.A)
_ACCOUNT_WORDS = ("access", "client", "account", "user", "login")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]*://[^\s\"'<>]+", re.I | re.A)


def _opaque(token: str) -> bool:
    """A token of three kinds of character without a long run of letters in one case, as random keys are."""
    kinds = bool(re.search("[a-z]", token)) + bool(re.search("[A-Z]", token)) + bool(re.search("[0-9]", token))
    return kinds == 3 and not re.search("[a-z]{13}|[A-Z]{13}", token)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the kinds that count alone; each kind leftmost and non-overlapping."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the weaker kinds that overlap no base span."""
    found = []
    low = text.lower()
    if any(w in low for w in _ACCOUNT_WORDS):
        found += [(m.start(), 3, m.end()) for m in _ACCOUNT.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in _TOKEN.finditer(text) if _opaque(m[0])]
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    if base:
        found = [f for f in found if not any(s < f[2] and f[0] < e for s, _, e in base)]
    return sorted(found)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))
_SPANS_SQL = "array<struct<s:bigint,k:int,e:bigint>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and weak candidates of every row: ``doc_id, row_id, base, weak, base_sha256``, written once."""
    rows = docs.select(name(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), text_of(text_col).alias("t"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            base, weak, digest = [], [], []
            for t in batch.column(2):
                text = t.as_py()
                b = base_spans(text)
                base.append([{"s": s, "k": k, "e": e} for s, k, e in b])
                weak.append([{"s": s, "k": k, "e": e} for s, k, e in weak_spans(text, b)])
                digest.append(hashlib.sha256(spans_text(b).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(base, _SPANS), pa.array(weak, _SPANS), pa.array(digest, pa.string())],
                names=["doc_id", "row_id", "base", "weak", "base_sha256"])

    return written(rows.mapInArrow(find, f"doc_id {id_type}, row_id long, base {_SPANS_SQL}, weak {_SPANS_SQL}, base_sha256 string"))


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``row_id, linked``: the weak candidates whose complementary parts start within ``scope``.

    The interval join works on cells as wide as the scope. Parts are first reduced to the least and
    greatest start per row, cell and role; a candidate then looks at its own cell, where any part is
    near enough, and at the two cells beside it. So the work is linear in the number of spans, however
    many stand in one text.
    """
    roles = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k])])
    some = scanned.filter(F.size("weak") > 0)
    parts = some.select("row_id", F.explode(F.concat("base", "weak")).alias("x")).select(
        "row_id", roles[F.col("x.k")].alias("role"), F.floor(F.col("x.s") / scope).alias("cell"), F.col("x.s").alias("s"))
    cells = parts.groupBy("row_id", "cell", "role").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    needs = F.create_map(*[y for i, k in enumerate(KINDS) if k in NEEDS for y in (F.lit(i), F.array(*[F.lit(r) for r in NEEDS[k]]))])
    wanted = some.select("row_id", F.explode("weak").alias("x")).withColumn("needed", needs[F.col("x.k")])
    asked = wanted.select("row_id", "x", F.size("needed").alias("n"), F.explode("needed").alias("role")).withColumn("own", F.floor(F.col("x.s") / scope))
    asked = asked.select("*", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("cell"))
    near = asked.join(cells, ["row_id", "cell", "role"]).filter(
        (F.col("cell") == F.col("own")) | ((F.col("cell") < F.col("own")) & (F.col("high") >= F.col("x.s") - scope))
        | ((F.col("cell") > F.col("own")) & (F.col("low") <= F.col("x.s") + scope)))
    complete = near.select("row_id", "x", "n", "role").distinct().groupBy("row_id", "x", "n").agg(F.count(F.lit(1)).alias("met")).filter("met = n")
    return complete.groupBy("row_id").agg(F.collect_list("x").alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Positions are code points, ends exclusive. ``base_sha256`` digests the spans of the kinds that count
    alone, ``spans`` lists these and the linked ones by start, then kind. Null text is empty: no spans,
    and the digest is that of the empty string. Repeated rows are scanned each for itself; an empty
    table gives an empty result; other columns are ignored.
    """
    scanned = scan(docs, id_col, text_col)
    more = linked(scanned, scope)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    every = F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(_SPANS_SQL))))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")
    return scanned.join(more, "row_id", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", text.alias("spans"))
