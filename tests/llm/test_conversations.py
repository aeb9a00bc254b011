import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import types as T

from lexframe.llm import conversations as C, queries

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def lightest(signs):
    """(cost, audit) by trying all edits, at most two insertions in a row."""
    best = None

    def go(i, cost, audit, kept, added):
        nonlocal best
        if best and cost > best[0] or not re.fullmatch("s?(ua)*u?", kept):
            return
        if i == len(signs) and re.fullmatch("(s?(ua)+)?", kept):
            best = min(best or (cost, audit), (cost, audit))
        if added < 2:
            for x in "ua":
                go(i, cost + 2, audit + "I", kept + x, added + 1)
        if i < len(signs):
            go(i + 1, cost + 3, audit + "D", kept, 0)
            if (own := signs[i]) != "d":
                for x in "ua":
                    go(i + 1, cost + 2 + own.isupper(), audit + "R", kept + x, 0)
                go(i + 1, cost + own.isupper(), audit + "K", kept + own.lower(), 0)

    go(0, 0, "", "", 0)
    return best


def table(spark, rows):
    names = ["cost", "audit", "pid", "piece", "kind", "copies", "place"]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("role", "text", *names))])
    return spark.createDataFrame([(*r, *names) for r in rows], schema)


def brute(rows):
    """The contract, conversation by conversation, with all edits of short ones tried."""
    convs, out = {r[0]: [] for r in rows}, {}
    for conv, turn, role, text in rows:
        named = [" " if x is None else str(x) for x in (conv, turn)]
        what = zlib.crc32(":".join(named).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text, role = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text, "user" if what == 4 else role
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(what, 1)
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}:{r[2]}"))
        seen, signs, kinds = set(), "", []
        for _, role, text in turns:
            marks = BLANK.findall(text)
            kind = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append(kind)
            own = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signs += "d" if kind in ("blank", "duplicate") else own.upper() if kind else own
        cost, audit = lightest(signs) if len(signs) <= 6 else C.derive(signs, 0, True)[0]
        repaired, i, last = [], 0, ""
        for edit in audit:
            new = "assistant" if last == "u" else "user"
            if edit != "D":
                role, text = ("", "") if edit == "I" else turns[i][1:]
                role = role if edit == "K" else new
                repaired.append(f"{role}:{text}")
                last = role[0]
            i += edit != "I"
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (conv, min(gaps, 2**63 - 1), *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return sorted(out.values(), key=str)


def made(seed, convs=60, turns=6):
    rng, out = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "human"])
            text = rng.choice([f"word {t}.", "same text.", "cut off", " \t", None, "", "Well!  ", "é?", "a\nb."])
            out.append((c, rng.choice([t, t, 2 * t, None]), role, text))
    return out


def asked(spark, rows, path):
    table(spark, rows).repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r) for r in queries.op12_conversation_repair(spark, path).collect()), key=str)


def test_agenda_against_all_edits():
    rng = random.Random(1)
    for _ in range(250):
        signs = "".join(rng.choice("suaxdSUAX") for _ in range(rng.randint(0, 5)))
        assert C.whole(signs) == lightest(signs), signs


def test_pieces_give_the_same_derivation(monkeypatch):
    rng = random.Random(2)
    for _ in range(600):
        signs = "".join(rng.choice("suaxdSUAXuauaua") for _ in range(rng.randint(0, 60)))
        want = C.derive(signs, 0, True)[0]
        monkeypatch.setattr(C, "PIECE", rng.randint(1, 9))
        assert C.whole(signs) == want, signs


@pytest.mark.parametrize("seed", [3, 4])
def test_query_against_brute_force_and_sql(spark, tmp_path, seed):
    rows = made(seed)
    rows += [rows[0], rows[9], (None, 1, "user", "who?"), (None, 2, "assistant", "me."), (900, -(2**63), "user", "a."), (900, 2**63 - 1, "assistant", "b."), (901, None, None, None)]
    got = asked(spark, rows, str(tmp_path))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet') WHERE conv_id IS NULL OR conv_id <> 900")
    assert sorted(con.execute(queries.OP12_SQL).fetchall(), key=str) == [r for r in got if r[0] != 900]


def test_one_conversation_over_many_tasks(spark, tmp_path, monkeypatch):
    """A conversation with nearly all turns is dealt over the tasks, derived in pieces and put together in a tree."""
    monkeypatch.setattr(C, "PIECE", 16)
    monkeypatch.setattr(C, "FAN", 2)
    rng = random.Random(5)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "tool"]), rng.choice([f"word {t}.", f"cut {t}", "again.", " "])) for t in range(700)]
    rows += [(c, t, "user", "hm.") for c in (0, 2) for t in range(3)]
    monkeypatch.setattr(C, "derive", C.derive.__wrapped__)
    got = asked(spark, rows, str(tmp_path))
    assert got == brute(rows)


def test_turns_themselves(spark):
    rows = [(1, 1, "system", "s."), (1, 2, "assistant", "hi."), (2, 1, "user", "a."), (2, 2, "assistant", "b"), (3, 1, "tool", "x.")]
    figures, turns = C.repair(table(spark, rows))
    assert {r.conv_id: (r.cost, r.audit) for r in figures.collect()} == {1: (2, "KIK"), 2: (1, "KK"), 3: (3, "D")}
    assert [tuple(r)[2:] for r in turns.orderBy("conv_id", "place").collect()] == [("K", "system", "s."), ("I", "user", ""), ("K", "assistant", "hi."), ("K", "user", "a."), ("K", "assistant", "b")]


def test_empty(spark, tmp_path):
    assert asked(spark, [], str(tmp_path)) == []
