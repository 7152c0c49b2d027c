import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq

import __spark_entry__ as entry
from mirrorplan.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def repair(rows):
    """rows: (role, text, must go, truncated). The least (cost, edits) from each place on, spelled out from the end."""

    @functools.cache
    def best(i, q, inserted):
        options = []
        if i == len(rows) and q in (0, 3):
            options.append((0, ""))
        if inserted < 3:
            c, s = best(i, NEXT[q][1], inserted + 1)
            options.append((c + 2, "I" + s))
        if i < len(rows):
            role, _, gone, cut = rows[i]
            c, s = best(i + 1, q, 0)
            options.append((c + 3, "D" + s))
            if not gone:
                c, s = best(i + 1, NEXT[q][1], 0)
                options.append((c + 2 + cut, "R" + s))
                if q == 0 and role[:1] == "s":
                    c, s = best(i + 1, 1, 0)
                    options.append((c + cut, "K" + s))
                if role[:1] == NEXT[q][0][0]:
                    c, s = best(i + 1, NEXT[q][1], 0)
                    options.append((c + cut, "K" + s))
        return min(options, default=(1 << 40, "~"))

    cost, audit = best(0, 0, 0)
    out, q, i = [], 0, 0
    for e in audit:
        if e == "I":
            out.append((NEXT[q][0], ""))
            q = NEXT[q][1]
            continue
        if e == "K":
            out.append(rows[i][:2])
            q = 1 if rows[i][0][:1] == "s" and q == 0 else NEXT[q][1]
        if e == "R":
            out.append((NEXT[q][0], rows[i][1]))
            q = NEXT[q][1]
        i += 1
    assert i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return cost, audit, out


def report(rows, every):
    groups = defaultdict(list)
    for c in every:
        groups[c]
    for c, *r in rows:
        groups[c].append(r)
    out, texts = {}, {}
    for c, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, seen, told = {t for t, _, _ in g if t is not None}, set(), []
        n = defaultdict(int)
        for _, role, text in g:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            told.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        cost, audit, said = repair(tuple(told))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
        texts[c] = said
    return out, texts


def rows_of(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in got}


def test_query(spark):
    at = "/root/testdata/sf0.01"
    table = [tuple(r.values()) for r in pq.read_table(f"{at}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    want, _ = report(damage(table), {r[0] for r in table})
    assert rows_of(entry.queries()["op11_conversations"](spark, at)) == want
    assert any("D" in w[6] for w in want.values()) and any("I" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


def random_rows(seed, n):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", None, "Ah!\t ", "é ?\n", "Yes.", "end\x0b.\x0c", "x" * 3000 + "."]
    return [
        (rnd.choice([None, *range(n // 5)]), rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "Söl", "usr"]), rnd.choice(texts))
        for _ in range(n)
    ]


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SPILL_BYTES", 8)
    monkeypatch.setattr(conversations, "OUT_ROWS", 3)
    rows = random_rows(5, 600)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as kind", "'x' as audit", "3 as blank")
    kept, dropped = conversations.damaged(df)
    want, _ = report(damage(rows), {r[0] for r in rows})
    assert rows_of(conversations.audits(kept, dropped)) == want
    # undamaged, in small batches, and the repaired rows themselves
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want, texts = report(plain, set())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows_of(conversations.audits(df)) == want
        got = defaultdict(list)
        for r in sorted(conversations.repaired(df).collect(), key=lambda r: r["place"]):
            assert r["place"] == len(got[r["conv_id"]])
            got[r["conv_id"]].append((r["role"], r["text"]))
        assert got == {c: t for c, t in texts.items() if t}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_every_short_conversation(spark):
    """All role sequences of up to 5 rows, against all edit strings tried one by one."""

    def tried(roles):
        best = None
        stack = [("", 0, 0, 0)]
        bound = 3 * len(roles)
        while stack:
            audit, i, q, cost = stack.pop()
            if cost > bound:
                continue
            if i == len(roles) and q in (0, 3):
                best = min(best or (cost, audit), (cost, audit))
            if not audit.endswith("III"):
                stack.append((audit + "I", i, NEXT[q][1], cost + 2))
            if i < len(roles):
                stack.append((audit + "D", i + 1, q, cost + 3))
                stack.append((audit + "R", i + 1, NEXT[q][1], cost + 2))
                if q == 0 and roles[i] == "s":
                    stack.append((audit + "K", i + 1, 1, cost))
                elif roles[i] == NEXT[q][0][0]:
                    stack.append((audit + "K", i + 1, NEXT[q][1], cost))
        return best

    sequences = [""]
    for _ in range(4):
        sequences += [s + c for s in sequences for c in "suat" if len(s) == len(sequences[-1])]
    for roles in set(sequences):
        r = conversations.Repair()
        for k, c in enumerate(roles):
            r.add(c, f"{k}.", False, False)
        assert r.done()[:2] == tried(roles), roles


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.audits(empty).collect() == [] and conversations.repaired(empty).collect() == []
    nothing = conversations.audits(empty, spark.createDataFrame([(7,)], "conv_id bigint"))
    assert rows_of(nothing) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    # a conversation of many rows, one text of 50 MB, repeats far apart
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{k % 20000}.") for k in range(40000)]
    df = spark.createDataFrame(rows, SCHEMA).unionByName(spark.sql("select 2L conv_id, 0L turn, 'user' role, repeat('ab cd.', 8000000) text"))
    got = rows_of(conversations.audits(df))
    assert got[1][:6] == (0, 0, 20000, 0, 0, 60000) and got[1][6] == "K" * 20000 + "D" * 20000
    assert got[2][5:7] == (2, "KI") and got[2][7] == hashlib.sha256(b"user:" + b"ab cd." * 8000000 + b"\nassistant:").hexdigest()
