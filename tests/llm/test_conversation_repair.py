import hashlib
import random
import re
import zlib

import pytest

from loomlog.llm import conversation_repair as repair
from loomlog.llm import queries

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def best(rows):
    """The lightest edits of (role, fault) rows by a plain pass over rows and states; (cost, audit, roles)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    want = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def put(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def inserts(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                put(table, want[state], (cost + 5, audit + "I", (*out, (full[want[state]], None))))

    table = {"": (0, "", ())}
    inserts(table)
    for k, (role, fault) in enumerate(rows):
        new = {}
        for state, (cost, audit, out) in table.items():
            put(new, state, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                put(new, want[state], (cost + 1 + more, audit + "R", (*out, (full[want[state]], k))))
                if (state, role[:1]) in after:
                    put(new, after[state, role[:1]], (cost + more, audit + "K", (*out, (role, k))))
        inserts(new)
        table = new
    return min(table[s] for s in ("", "a") if s in table)


def brute(original):
    by = {}
    for row in damaged(original):
        by.setdefault(row[0], []).append(row)
    out = []
    for conv in {r[0] for r in original}:
        rows = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in rows:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, kept = best([(r[2], f) for r, f in zip(rows, faults, strict=True)])
        text = "\n".join(f"{role}:{'' if k is None else rows[k][3]}" for role, k in kept)
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SF2])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_conversation_repair(spark, sf)) == brute(rows)


def test_agenda_and_joined_blocks_equal_a_plain_pass():
    rng = random.Random(1)
    for _ in range(300):
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(12)))
        full = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
        rows = [(full.get(c.lower(), ""), "blank" if c == "d" else "truncated" if c.isupper() else None) for c in codes]
        want = best(rows)[:2]
        whole = {(p, q): w for p, q, *w in repair.block_items(codes)}
        assert min(tuple(whole[0, q]) for q in (0, 3) if (0, q) in whole) == want
        cuts = sorted(rng.randrange(len(codes) + 1) for _ in range(3))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        joined = {(p, q): tuple(w) for p, q, *w in repair.joined_items([list(repair.block_items(x)) for x in parts])}
        assert min(joined[0, q] for q in (0, 3) if (0, q) in joined) == want


def write(spark, tmp_path, rows):
    schema = "conv_id long, turn long, role string, text string, cost string, _at int"
    spark.createDataFrame([(*r, "c", 1) for r in rows], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_edge_cases(spark, tmp_path):
    long = "word " * 30_000
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", "b."), (2, 0, "system", "s."), (2, 0, "user", "q?"),
        (2, 0, "user", "q?"), (2, 1, "assistant", long), (2, 9, "tool", "t!"), (3, 1, "", "empty role."), (3, 2, "", "empty role."), (4, 7, "assistant", " \n"), (5, 1, "user", "q?\n "), (5, 2, "assistant", "Fine. \t"), (6, 3, "user", None),
    ]
    assert result(queries.op13_conversation_repair(spark, write(spark, tmp_path, rows))) == brute(rows)


def test_a_conversation_that_is_dropped_whole_and_no_rows(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = result(queries.op13_conversation_repair(spark, write(spark, tmp_path / "a", [(gone, 0, "user", "Hi.")])))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert queries.op13_conversation_repair(spark, write(spark, tmp_path / "b", [])).count() == 0


def test_a_long_conversation_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "_BLOCK_BITS", 3)
    monkeypatch.setattr(repair, "_FAN", 4)
    rng = random.Random(2)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", f"u{k}.", f"v{k}!", ""])) for k in range(1500)]
    rows += [(2, k, "user" if k % 2 == 0 else "assistant", f"fine {k}.") for k in range(40)]
    assert result(queries.op13_conversation_repair(spark, write(spark, tmp_path, rows))) == brute(rows)


def test_repaired_rows_give_the_hash(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    found, rows = repair.repair(repair.damage(conversations))
    texts = {}
    for r in rows.orderBy("conv_id", "position").collect():
        assert r["position"] == len(texts.setdefault(r["conv_id"], []))
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(texts.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in texts.get(r["conv_id"], [])))
