"""The pipeline over planted rows: every stage, and ``run`` as a whole, against plain Python."""

import math
import unicodedata
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from echotrail.llm import packing, rules
from tests.llm.helpers import SCHEMA, SF, edge_rows, prose, words
from tests.llm.test_edges import linked, shingles, squeezed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_measures(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    solid = "".join(w)
    space = " \t\n\u000b\f\r"
    text = text or ""
    return {
        "n_words": len(w), "word_chars": len(solid), "n_symbols": sum(c in "#*$%&|<>" for c in solid),
        "n_letters": sum(unicodedata.category(c)[0] == "L" for c in solid), "n_upper": sum(unicodedata.category(c) == "Lu" for c in solid),
        "n_cries": sum(c in "!?" for c in solid), "n_ends": sum(c in ".!?…。" and (i + 1 == len(text) or text[i + 1] in space) for i, c in enumerate(text)),
        "n_bare": sum(not any(unicodedata.category(c)[0] in "LN" for c in x) for x in w), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({k + j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(3)})}


def plain_votes(m):
    n, letters = m["n_words"], m["n_letters"]
    pairs = [  # good, bad
        (m["n_symbols"] * 20 <= n, m["n_symbols"] * 4 > n), (m["n_upper"] * 5 <= letters, m["n_upper"] * 2 > letters), (m["n_cries"] * 20 <= n, m["n_cries"] * 4 > n),
        (m["n_repeat_words"] * 10 <= n, m["n_repeat_words"] * 3 > n), (m["n_dup_lines"] == 0, m["n_dup_lines"] * 4 > m["n_lines"]), (m["n_bare"] * 50 <= n, m["n_bare"] * 5 > n),
        (n <= m["n_ends"] * 60 and m["n_ends"] * 2 <= n, m["n_ends"] * 200 < n or m["n_ends"] * 10 > n * 7), (letters * 100 >= m["word_chars"] * 85, letters * 100 < m["word_chars"] * 65),
        (n * 3 <= m["word_chars"] <= n * 12, m["word_chars"] < n * 2 or m["word_chars"] > n * 20), (n >= 100, n < 50)]
    return tuple(-1 if bad else 1 if good else 0 for good, bad in pairs)


def plain_posteriors(all_votes):
    """Expectation-maximisation row by row."""
    bad = [sum(v < 0 for v in votes) for votes in all_votes]
    good = [0.95 if b == 0 else 0.4 if b == 1 else 0.05 for b in bad]
    before = None
    for _ in range(rules.ROUNDS):
        prior = min(0.99, max(0.5, (sum(good) + 1) / (len(good) + 2)))
        alarm, hit = [], []
        for r in range(10):
            no = [(g if v[r] < 0 else 0, g if v[r] else 0, 1 - g if v[r] < 0 else 0, 1 - g if v[r] else 0) for v, g in zip(all_votes, good)]
            a, b, c, d = (sum(x) for x in zip(*no))
            alarm.append(min(0.2, max(1e-4, (a + 0.01) / (b + 1))))
            hit.append(min(0.98, max((c + 0.3) / (d + 1), alarm[-1])))
        now = [prior, *alarm, *hit]
        if before is not None and max(abs(x - y) for x, y in zip(now, before)) < rules.SETTLED:
            good = [posterior(v, prior, alarm, hit) for v in all_votes]
            break
        before = now
        good = [posterior(v, prior, alarm, hit) for v in all_votes]
    return good


def posterior(votes, prior, alarm, hit):
    odds = math.log(prior / (1 - prior))
    for v, a, h in zip(votes, alarm, hit):
        odds += math.log(a / h) if v < 0 else math.log((1 - a) / (1 - h)) if v > 0 else 0
    return 1 / (1 + math.exp(-odds))


def plain_good(rows):
    measured = [plain_measures(r[1]) for r in rows]
    chances = plain_posteriors([plain_votes(m) for m in measured])
    failed = [m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] for m in measured]
    return [r for r, p, f in zip(rows, chances, failed) if p >= 0.5 and not f]


def plain_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[squeezed(r[1])].append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_near(rows):
    roots = linked([shingles(r[1], 5) for r in rows])
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[roots[i]].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def collected(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def planted(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [(i + 1000, t, g, s, n) for i, t, g, s, n in real] + edge_rows()
    for i in range(12):
        body = prose(f"plain {i}", 150)
        rows += [(5000 + 10 * i, body, "en", "a", len(body)), (5001 + 10 * i, body.replace(" ", "\n", 5), "en", "b", len(body))]
        rows += [(5002 + 10 * i, body + " " + prose(f"more {i}", 4), "en", "c", None), (5003 + 10 * i, "!!! ### $$$ " * 40, "en", "a", 480)]
    return rows


def test_run_against_plain_versions(spark, folder, planted):
    spark.createDataFrame(planted, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), planted
    plain = {"quality_rules": plain_good, "exact_dedup": plain_exact, "near_dedup": plain_near}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name in plain:
            kept = plain[name](kept)
            assert collected(docs) == Counter(kept), name
    clean = {5000 + 10 * i for i in range(12)} | {5001 + 10 * i for i in range(12)} | {5002 + 10 * i for i in range(12)}
    assert len({r[0] // 10 for r in kept if r[0] in clean}) == 12 and not any(r[0] is not None and r[0] % 10 == 3 and r[0] > 5000 for r in kept)

    # The mix takes whole epochs of each source and one text cut at a word, to the target exactly.
    sizes, taken, text_of = defaultdict(int), defaultdict(int), {}
    for i, t, _, s, _ in kept:
        sizes[s] += len(words(t))
        text_of.setdefault((i, s), words(t))
    for r in docs.collect():
        w = words(r.text)
        assert w == text_of[(r.doc_id, r.source)][:len(w)]
        taken[r.source] += len(w)
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight, full, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and level * weight[s] >= 2 * sizes[s]}
        if not more:
            break
        full |= more
    for s in order:
        assert abs(taken[s] - (2 * sizes[s] if s in full else level * weight[s])) <= 1, s

    # Every mixed row is packed whole, end mark included; sequences have no gaps.
    from tokenizers import Tokenizer

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    encode = Tokenizer.from_file(packing.default_vocabulary())
    expected = Counter()
    for r in docs.collect():
        expected[r.doc_id] += len(encode.encode(r.text or "", add_special_tokens=False).ids) + 1
    lengths, sequences = Counter(), defaultdict(list)
    for r in packed:
        lengths[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert lengths == expected
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(map(str, whole.collect())) == Counter(map(str, packed))
