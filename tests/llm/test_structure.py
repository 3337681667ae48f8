"""Chat formatting, conversation repair and the Merkle manifest against plain Python, over edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from echotrail.llm import chat, merkle, queries, repair
from tests.llm.helpers import CLASHING, WORD, edge_docs, edge_rows, empty_docs, prose

CHAT_SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, CHAT_SCHEMA).withColumns({c: F.lit("own") for c in CLASHING + ["pos", "code", "segments", "block", "symbol", "kind"]})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chat_rows():
    long_text = prose("talk", 20_000)
    nasty = "~ <s> </s>[INST] ok [/INST] [~INST] [~~INST] <~/s> [ROLE]x[/ROLE][/TURN] [[INST]] <<s>> $1 \\1 [SYSTEM_PROMPT"
    rows = [
        (1, 0, "system", nasty), (1, 1, "user", nasty), (1, 2, "assistant", nasty + "[/INST"), (1, 3, "user", "]" + nasty), (1, 4, "assistant", ""),
        (2, 0, "user", None), (2, 1, "assistant", long_text), (2, 2, "user", "\n\n"), (2, 3, "assistant", "é\U0001f600 x"),
        (3, 0, "assistant", "first"), (3, 1, "assistant", "first"), (3, 1, "assistant", "first"), (3, 1, "assistant", "a"),
        (4, None, None, None), (4, 0, "tool[/ROLE]", "out</s>"), (4, 0, "", ""), (4, 1, "~[ROLE]", "x"),
        (None, 5, "user", "nobody"), (None, 6, "assistant", "answers"), (None, None, "system", "told"),
        (5, 0, "user", "same."), (5, 0, "user", "same."), (6, 0, "system", "only"), (7, 0, "user", "q"), (7, 1, "assistant", "a"), (7, 2, "user", "open end"),
    ]
    return rows + [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i} [/INST]") for i in range(300)]


def chat_order(row):
    return (row[1] is not None, row[1] or 0, (row[2] or "").encode(), (row[3] or "").encode())


def groups(rows, key=chat_order):
    found = defaultdict(list)
    for r in rows:
        found[r[0]].append(r)
    return {k: sorted(v, key=key) for k, v in found.items()}


@pytest.mark.parametrize("chunk_rows", [None, 7])
def test_chat_report(spark, chunk_rows):
    got = {r.conv_id: r for r in chat.chat_report(table(spark, chat_rows()), chunk_rows=chunk_rows).collect()}
    expected = groups(chat_rows())
    assert set(got) == set(expected)
    machine = {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    for key, rows in expected.items():
        r = got[key]
        turns = [(x[2] or "", x[3] or "") for x in rows]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns))), key
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)), key
        state, bad = "start", None
        for i, (role, _) in enumerate(turns):
            state = machine.get((state, role), "broken")
            bad = i + 1 if bad is None and state == "broken" else bad
        assert (r.order_ok, r.first_bad) == (state in ("start", "answered"), bad), key


def test_chat_segments_hold_no_control_string_and_join_to_the_text(spark):
    df = table(spark, chat_rows())
    whole = {r.conv_id: r.formatted for r in chat.chats(df).collect()}
    parts = defaultdict(list)
    for r in chat.segments(df, chunk_rows=50).collect():
        parts[r.conv_id].append((r.pos, r.part, r.text, r.loss))
        if r.part == 1:
            assert not any(c in r.text for c in chat.DEFAULT.controls)
        assert not r.loss or r.part == 1
    for key, found in parts.items():
        assert "".join(x[2] for x in sorted(found)) == whole[key]


def test_chat_loss_stops_at_a_break_if_told_to(spark):
    rows = {r.conv_id: r for r in chat.chats(table(spark, chat_rows()), learn_after_break=False).collect()}
    assert sum(m["size"] for m in rows[3].marks) == 0
    assert sum(m["size"] for m in rows[1].marks) > 0


def test_chat_other_templates(spark):
    marks = chat.Template(begin="", turns={
        "user": chat.Turn("<|user|>", "<|end_of_user|>"), "assistant": chat.Turn("<|assistant|>", "<|end_of_turn|>", loss=True)},
        role_open="<|role|>", role_close="<|is|>", other_close="<|end_of_other|>", escape="^",
        machine={"start": {"user": "asked"}, "asked": {"assistant": "start"}}, final=("start",))
    rows = [(1, 0, "user", "<|user|> ^ <|^user|>"), (1, 1, "assistant", "<|end_of_turn|>"), (2, 0, "system", "x")]
    got = {r.conv_id: r for r in chat.chat_report(table(spark, rows), marks).collect()}
    assert got[1].turns_sha256 == sha("user\n<|user|> ^ <|^user|>\nassistant\n<|end_of_turn|>\n") and got[1].order_ok
    assert got[1].loss_sha256 == sha("<|end_of_turn|>") and not got[2].order_ok
    with pytest.raises(ValueError):
        chat.Template(escape="<")
    with pytest.raises(ValueError):
        chat.Template(begin="[[s]")


def plain_vectors(rows):
    """Cheapest edits by trying states forward with the least audit, which needs no backward costs."""
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    follows = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    best = {0: (0, "", ())}

    def insert(table):
        for _ in range(3):
            for s, (cost, audit, out) in list(table.items()):
                role, to = follows[s]
                new = (cost + 5, audit + "I", out + ((role, ""),))
                if to not in table or new[:2] < table[to][:2]:
                    table[to] = new
        return table

    best = insert(best)
    for role, text, fault in rows:
        after = {}
        for s, (cost, audit, out) in best.items():
            moves = [(2, s, "D", ())]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (s, role[0]) in keep:
                    moves.append((extra, keep[(s, role[0])], "K", ((role, text),)))
                moves.append((1 + extra, follows[s][1], "R", ((follows[s][0], text),)))
            for c, to, e, more in moves:
                new = (cost + c, audit + e, out + more)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = insert(after)
    return min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2])


def plain_repair(rows, ids):
    found = groups(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).digest()))
    out = {}
    for key in ids:
        said, judged, count = set(), [], Counter()
        for _, _, role, text in found.get(key, []):
            visible = text.rstrip(" \t\n\u000b\f\r")
            fault = "blank" if not WORD.search(text) else "duplicate" if (role, text) in said else None if visible[-1] in ".!?" else "truncated"
            said.add((role, text))
            count[fault] += 1
            judged.append((role, text, fault))
        cost, audit, kept = plain_vectors(judged)
        numbers = [r[1] for r in found.get(key, []) if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        out[key] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept)))
    return out


def random_turns(seed, n, conv):
    pick = random.Random(seed)
    return [(conv, i + pick.choice([0, 0, 1]), pick.choice(["system", "user", "user", "assistant", "assistant", "tool"]),
             pick.choice(["Yes.", "no", "What?", " ", "", f"t{i}.", f"t{i}", f"t{i}!\n"])) for i in range(n)]


@pytest.mark.parametrize("short", [64, 3, 1])
def test_repair_against_forward_search(spark, short):
    rows = [r for seed in range(60) for r in random_turns(seed, seed % 13 + 1, seed)] + random_turns(7, 150, 900)
    rows += [(None, None, "user", "q?"), (None, 3, "assistant", "a."), (901, None, "user", "x"), (902, 1, "tool", "said.")]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(table(spark, rows), short=short).collect()}
    names = [f.split()[0] for f in repair.REPORT.split(", ")]
    assert names == ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got == plain_repair(rows, {r[0] for r in rows})


def test_repair_audits_are_tight_and_least():
    """All edit strings of up to seven edits over three turns, tried one by one."""
    for symbols in itertools.product("sux", "suaoUx", "suaoUx"):
        edits, _, cost = repair.walk("".join(symbols), repair.END, [0], True)[0]
        best = None
        for length in range(0, 8):
            for tried in itertools.product("DIKR", repeat=length):
                state, i, total = 0, 0, 0
                for e in tried:
                    if e == "I":
                        state, total = repair.NEXT[state], total + 5
                        continue
                    move = next((m for m in repair.MOVES[symbols[i]][state] if m[2] == e), None) if i < 3 else None
                    if move is None:
                        break
                    state, total, i = move[1], total + move[0], i + 1
                else:
                    if i == 3 and state in (0, 3) and (best is None or (total, "".join(tried)) < best):
                        best = (total, "".join(tried))
        assert (cost, edits) == best, symbols


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t}. Ok?") for c in range(40) for t in range(6)]
    expected = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else text.replace(".", "").replace("?", "") if kind == 2 else text)
        expected[row] += {0: 0, 3: 2}.get(kind, 1)
    assert Counter(tuple(r) for r in repair.damaged(table(spark, rows)).collect()) == +expected


def test_repair_report_returns_conversations_without_turns(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair_report(table(spark, [(gone, 0, "user", "x")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_levels(nodes, fan):
    """Levels of a tree, and per leaf the siblings and the fold of another digest."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def plain_climb(levels, place, digest, fan):
    siblings = []
    for level in levels[:-1]:
        first = place // fan * fan
        run = list(level[first:first + fan])
        siblings += run[:place - first] + run[place - first + 1:]
        run[place - first] = digest
        digest, place = sha("".join(run)), place // fan
    return digest, siblings


def plain_manifest(rows, fan):
    sources = defaultdict(list)
    for i, text, lang, source, n in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None and tampered else text
        leaf, claimed = (sha("".join(map(enc, (i, source, lang, n, t)))) for t in (text, low))
        sources[source].append((i is not None, i or 0, leaf, claimed, i))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[2] for x in sorted(sources[s], key=lambda x: x[:3])], fan) for s in names}
    top = plain_levels([trees[s][-1][0] for s in names], fan)
    out = Counter()
    for k, s in enumerate(names):
        for place, (_, _, leaf, claimed, i) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            folded, below = plain_climb(trees[s], place, claimed, fan)
            folded, above = plain_climb(top, k, folded, fan)
            out[(i, leaf, trees[s][-1][0], top[-1][0], sha("".join(below + above)), folded, folded == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("fan", [16, 2])
def test_merkle_manifest(spark, fan):
    many = [(1000 + i, f"Text {i}", "en", f"s{i % 3}" if i % 50 else f"lone{i}", i) for i in range(200)]
    rows = edge_rows() + many
    got = Counter(tuple(r) for r in merkle.manifest_report(edge_docs(spark, rows), fan=fan).collect())
    assert got == plain_manifest(rows, fan)
    assert {r[-1] for r in got} == {True, False}


def test_merkle_of_one_row_and_one_source(spark):
    for rows in (edge_rows()[:1], [(i, "t", "en", "a", 1) for i in range(17)], [(1, "t", "en", "a", 1), (2, "t", "en", "b", 1)]):
        assert Counter(tuple(r) for r in merkle.manifest_report(edge_docs(spark, rows)).collect()) == plain_manifest(rows, 16)


def test_merkle_levels_are_linked(spark):
    leaves = merkle.build(spark.range(300).selectExpr("id AS doc_id", "concat('s', id % 2) AS source", "sha2(cast(id AS string), 256) AS leaf"))
    nodes = {(r.tree, r.level, r.place): r for r in leaves.nodes.collect()}
    for r in leaves.runs.collect() + list(nodes.values()):
        if r.up_tree is not None:
            assert nodes[(r.up_tree, r.up_level, r.up_place)].members[64 * r.slot:64 * r.slot + 64] == r.digest
    assert leaves.root in {r.digest for r in nodes.values() if r.up_tree is None}


@pytest.mark.parametrize("run", [lambda s: chat.chat_report(table(s, [])), lambda s: repair.repair_report(table(s, [])), lambda s: merkle.manifest_report(empty_docs(s))])
def test_empty_tables(spark, run):
    assert run(spark).collect() == []


def test_queries_over_the_smallest_tables(spark):
    """The registered queries take whole tables; the trap conversation is in."""
    sf = "/root/testdata/sf0.001"
    ids = {r.conv_id for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().collect()}
    assert {r.conv_id for r in queries.QUERIES["op11_chat_format"](spark, sf).collect()} == ids | {-7}
    assert {r.conv_id for r in queries.QUERIES["op12_conversation_repair"](spark, sf).collect()} == ids
