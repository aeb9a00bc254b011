"""Conversation structure repair: the lightest derivation of a legal role sequence, by Knuth's agenda.

A conversation is legal if the initials of its roles are `(s?(ua)+)?`. An item [i, q] says that the first i turns have been
edited so that q is the last initial kept (or none yet). Keeping, giving a role, deleting and inserting are deductions from one
item to the next, weighted by superior functions over (cost, audit): the cost grows by that of the edit, the audit by its
initial, and neither ever gets smaller. So an item is final when the agenda pops it first, and the search ends when the goal is
popped. Equal costs of one item have audits of which none begins another, so appending keeps their order.

Turns are dealt in order over the tasks by (conversation, turn, line), so no conversation, however long, has to be in one task. A
task repairs the conversations that it surely holds whole, one at a time. The first and the last one of each task may go on
elsewhere: their turns are written in pieces of PIECE turns, each piece is derived from every entry to every exit, and pieces
combine as hyperedges, [p, q, r] and [p + 1, r, t] giving [p .. p + 1, q, t], in a tree of bounded fan-in. The chosen audit goes
back to the pieces. Within a piece no derivation ends with an insertion, which belongs to the turn after it.

Defined cases: a null role or text is one blank, null turns come first; turns of equal number are taken by `role:text`; a null
conversation id is a conversation of its own; a role without an initial among s, u and a cannot be kept; a conversation of which
no turn counts has zeros, an empty audit and no repaired turns; a gap count beyond the range of a bigint is its largest value;
columns of the input other than the four are not read, so no name can clash; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Turns of a piece, pieces that combine at a time, characters of a line that deal it.
PIECE, FAN, DEALT = 256, 64, 256
#: Last initial kept: none, s, u, a. What may follow it, and what must still be inserted after it at the end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
CLOSING = ("", "II", "I", "")
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@lru_cache(1 << 16)
def derive(turns: str, entry: int, to_goal: bool) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) by last initial, from `entry` over all turns; to the goal alone, as 0, if that is asked for.

    turns has a character for each turn: `d` if it must go, else its initial or x, in upper case if it is truncated."""
    n, goal = len(turns), (len(turns) + 1, 0)
    agenda, final, out = [(0, "", 0, entry)], set(), {}
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if (i, q) == goal:
            return {0: (cost, audit)}
        if i == n and not to_goal:
            out[q] = (cost, audit)
            continue
        if i == n and not CLOSING[q]:
            heapq.heappush(agenda, (cost, audit, *goal))
            continue
        steps = [(INSERT, "I", i, to) for initial, to in NEXT[q].items() if initial in ROLES]
        if i < n:
            steps.append((DELETE, "D", i + 1, q))
            own = turns[i].lower()
            if own != "d":
                extra = TRUNCATED * turns[i].isupper()
                steps += [(REROLE + extra, "R", i + 1, to) for initial, to in NEXT[q].items() if initial in ROLES]
                if own in NEXT[q]:
                    steps.append((KEEP + extra, "K", i + 1, NEXT[q][own]))
        for more, edit, j, to in steps:
            if (j, to) not in final:
                heapq.heappush(agenda, (cost + more, audit + edit, j, to))
    return out


def combine(left: dict, right: dict) -> dict:
    """Lightest derivations (cost, audit) by (entry, exit) of two neighbouring parts."""
    out: dict = {}
    for (q, r), (cost, audit) in left.items():
        for (s, t), (more, rest) in right.items():
            if r == s:
                found = (cost + more, audit + rest)
                if (q, t) not in out or found < out[q, t]:
                    out[q, t] = found
    return out


def whole(turns: str) -> tuple[int, str]:
    """The lightest (cost, audit) of a whole conversation."""
    if len(turns) <= PIECE:
        return derive(turns, 0, True)[0]
    part = {(0, 0): (0, "")}
    for at in range(0, len(turns), PIECE):
        piece = turns[at : at + PIECE]
        part = combine(part, {(q, r): found for q in {r for _, r in part} for r, found in derive(piece, q, False).items()})
    return close(part)


def close(part: dict) -> tuple[int, str]:
    """The goal, from the exits of a conversation that is entered with nothing kept."""
    return min((cost + INSERT * len(CLOSING[r]), audit + CLOSING[r]) for (q, r), (cost, audit) in part.items() if q == 0)


def fault(role: str, text: str, seen: bool) -> str:
    """`blank`, `duplicate`, `truncated` or nothing: the first fault of a turn."""
    body = text.strip(BLANKS)
    return "blank" if not body else "duplicate" if seen else "truncated" if body[-1] not in ".!?" else ""


def sign(role: str, kind: str) -> str:
    own = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return "d" if kind in ("blank", "duplicate") else own.upper() if kind == "truncated" else own


def edited(audit: str, turns: list[tuple[str, str]], q: int = 0) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of the turns that stay or come, and the last initial kept."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = turns[i] if edit != "I" else ("", "")
        initial = role[:1] if edit == "K" else next(x for x in NEXT[q] if x in ROLES)
        q = NEXT[q][initial]
        out.append((edit, role if edit == "K" else ROLES[initial], text))
        i += edit != "I"
    return out, q


def measured(turns: list[tuple[int | None, str, str, bool]]) -> dict:
    """Figures of neighbouring turns (turn, role, text, seen before), their signs, and what joins them to the next ones."""
    kinds = [fault(role, text, seen) for _, role, text, seen in turns]
    numbers = sorted({t for t, *_ in turns if t is not None})
    initials = [role[:1] for _, role, *_ in turns]
    return {
        "signs": "".join(sign(role, kind) for (_, role, *_), kind in zip(turns, kinds, strict=True)), "turns": len(turns),
        "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None, "kinds": len(numbers),
        "blank": kinds.count("blank"), "duplicate": kinds.count("duplicate"), "truncated": kinds.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
    }


def joined(a: dict, b: dict) -> dict:
    """Figures of two neighbouring parts as those of one."""
    out = {k: a[k] + b[k] for k in ("turns", "blank", "duplicate", "truncated", "illegal", "kinds")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["kinds"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "first": a["first"], "last": b["last"]}


def figures(m: dict, cost: int, audit: str) -> dict:
    gaps = 0 if m["low"] is None else min(m["high"] - m["low"] + 1 - m["kinds"], (1 << 63) - 1)
    return {"gaps": gaps, "cost": cost, "audit": audit} | {k: m[k] for k in ("blank", "duplicate", "truncated", "illegal")}


def _dealt(conv_type: str):
    """The rows that a task writes: kind 0 repaired turns, 1 figures of a conversation, 2 turns of conversations that may go on."""
    schema = f"conv_id {conv_type}, place bigint, edit string, role string, text string, turn bigint, pid int, no bigint, {', '.join(f'{c} bigint' for c in FIGURES)}, audit string, kind int"
    names = [c.strip().split()[0] for c in schema.split(",")]

    def table(rows: list[dict], like: pa.DataType) -> pa.RecordBatch:
        types = {"conv_id": like, "pid": pa.int32(), "kind": pa.int32()} | dict.fromkeys(("edit", "role", "text", "audit"), pa.string())
        return pa.record_batch([pa.array([r.get(c) for r in rows], types.get(c, pa.int64())) for c in names], names)

    def repaired(conv, turns) -> Iterator[dict]:
        seen: set = set()
        flagged = [(t, role, text, (role, text) in seen or seen.add((role, text)) is not None) for t, role, text in turns]
        m = measured(flagged)
        cost, audit = whole(m["signs"])
        yield {"conv_id": conv, "kind": 1} | figures(m, cost, audit)
        for place, (edit, role, text) in enumerate(edited(audit, [(role, text) for _, role, text in turns])[0]):
            yield {"conv_id": conv, "kind": 0, "place": place, "edit": edit, "role": role, "text": text}

    def work(batches):
        pid, none = TaskContext.get().partitionId(), object()
        like, rows, held, size, conv, first, no = pa.int64(), [], [], 0, none, True, 0

        def passed_on(turns, no: int) -> list[dict]:
            return [{"conv_id": conv, "kind": 2, "pid": pid, "no": no + k, "turn": t, "role": role, "text": text} for k, (t, role, text) in enumerate(turns)]

        for batch in batches:
            like = batch.column(0).type
            for at, turn, role, text, copies in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if conv is none:
                    rows.append({"conv_id": at, "kind": 3})
                elif at != conv:
                    if not first:
                        rows += repaired(conv, held)
                    first, held = False, []
                conv, turns = at, [(turn, role, text)] * copies
                size += len(text or "")
                if first:  # it may have begun in another task
                    rows += passed_on(turns, no)
                    no += copies
                else:
                    held += turns
                if len(rows) >= 10_000 or size > 1 << 24:
                    yield table(rows, like)
                    rows, size = [], 0
        if conv is not none and not first:  # it may go on in another task
            rows += [{"conv_id": conv, "kind": 3}, *passed_on(held, 0)]
        yield table(rows, like)

    return schema, work


def _table(schema: str, like: pa.DataType, rows: list[dict]) -> pa.Table:
    """Rows as a table; like is the type of conversation ids."""
    plain = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    ways = pa.list_(pa.struct([("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[name] for r in rows], like if name == "conv_id" else plain.get(kind, ways)) for name, kind in fields})


def _pieces(conv_type: str):
    """Figures and derivations of pieces, and of neighbouring pieces as one."""
    ends = "low bigint, high bigint, kinds bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string"
    schema = f"conv_id {conv_type}, pid int, piece bigint, {ends}, ways array<struct<q:int,r:int,cost:bigint,audit:string>>"
    totals = f"conv_id {conv_type}, {', '.join(f'{c} bigint' for c in FIGURES)}, audit string"

    def node(key, m: dict, part: dict) -> pa.Table:
        ways = [{"q": q, "r": r, "cost": cost, "audit": audit} for (q, r), (cost, audit) in part.items()]
        return _table(schema, key[0].type, [m | {"conv_id": key[0].as_py(), "pid": key[1].as_py(), "piece": key[2].as_py(), "ways": ways}])

    def derived(key, turns):
        turns = turns.sort_by("no")
        m = measured(list(zip(*(turns.column(c).to_pylist() for c in ("turn", "role", "text", "seen")), strict=True)))
        return node(key, m, {(q, r): found for q in range(4) for r, found in derive(m["signs"], q, False).items()})

    def ways(n: dict) -> dict:
        return {(w["q"], w["r"]): (w["cost"], w["audit"]) for w in n["ways"]}

    def merged(key, nodes):
        m = part = None
        for n in nodes.sort_by([("pid", "ascending"), ("piece", "ascending")]).to_pylist():
            m, part = (n, ways(n)) if m is None else (joined(m, n), combine(part, ways(n)))
        return node(key, m, part)

    def finished(batches):
        for batch in batches:
            rows = [{"conv_id": n["conv_id"]} | figures(n, *close(ways(n))) for n in batch.to_pylist()]
            yield from _table(totals, batch.column(0).type, rows).combine_chunks().to_batches()

    return schema, totals, derived, merged, finished


def _cut_back(conv_type: str):
    """The chosen audit of a conversation, cut into that of each piece, with the piece's entry; and the turns as it leaves them."""
    schema, turns_schema = f"conv_id {conv_type}, pid int, piece bigint, q int, audit string", f"conv_id {conv_type}, place bigint, edit string, role string, text string"

    def shared_out(key, nodes, totals):
        audit, at, q, out = totals.column("audit")[0].as_py(), 0, 0, []
        nodes = nodes.sort_by([("pid", "ascending"), ("piece", "ascending")]).to_pylist()
        for k, n in enumerate(nodes):
            to, left = at, n["turns"]
            while left:
                left -= audit[to] != "I"
                to += 1
            own = audit[at:to]
            out.append({"conv_id": key[0].as_py(), "pid": n["pid"], "piece": n["piece"], "q": q, "audit": own + audit[to:] if k == len(nodes) - 1 else own})
            at, q = to, next(w["r"] for w in n["ways"] if w["q"] == q and w["audit"] == own)
        return _table(schema, key[0].type, out)

    def applied(key, turns, chosen):
        turns, chosen = turns.sort_by("no"), chosen.to_pylist()[0]
        rows, _ = edited(chosen["audit"], list(zip(turns.column("role").to_pylist(), turns.column("text").to_pylist(), strict=True)), chosen["q"])
        place = (key[1].as_py() << 40) + key[2].as_py() * 4 * PIECE  # at most three edits for a turn, and two at the end
        return _table(turns_schema, key[0].type, [{"conv_id": key[0].as_py(), "place": place + k, "edit": e, "role": role, "text": text} for k, (e, role, text) in enumerate(rows)])

    return schema, turns_schema, shared_out, applied


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): the figures, cost and audit of every conversation, and the repaired turns (conv_id, place, edit,
    role, text), in order of place within a conversation. copies: a column that says how often a turn counts; 0 is not at all."""
    spark, col = turns.sparkSession, lambda c: F.col(f"`{c}`")
    n = F.greatest(F.coalesce(col(copies).cast("int"), F.lit(0)), F.lit(0)) if copies else F.lit(1)
    df = turns.select(col(conv_id).alias("conv_id"), col(turn).cast("bigint").alias("turn"), F.coalesce(col(role), F.lit(" ")).alias("role"), F.coalesce(col(text), F.lit(" ")).alias("text"), n.alias("copies"))
    df = df.select("conv_id", *(F.when(F.col("copies") > 0, F.col(c)).alias(c) for c in ("turn", "role", "text")), "copies")
    df = df.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))  # equal turns are one row, however many
    line = F.concat_ws(":", "role", "text")
    df = df.repartitionByRange("conv_id", "turn", F.left(line, F.lit(DEALT))).sortWithinPartitions("conv_id", "turn", line)
    conv_type = df.schema["conv_id"].dataType.simpleString()
    schema, work = _dealt(conv_type)
    done = cut(df.mapInArrow(work, schema), "conversations", by=["kind"])

    open_turns = done.where("kind = 2").select("conv_id", "pid", "no", "turn", "role", "text")
    key, place = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), F.struct("pid", "no")
    open_turns = open_turns.withColumn("key", key)
    began = open_turns.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(place).alias("began"))
    open_turns = open_turns.join(began, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    open_turns = cut(open_turns.select("conv_id", "pid", F.floor(F.col("no") / PIECE).alias("piece"), "no", "turn", "role", "text", (place > F.col("began")).alias("seen")), "open-turns")
    schema, totals_schema, derived, merged, finished = _pieces(conv_type)
    by = ["conv_id", "pid", "piece"]
    pieces = nodes = cut(open_turns.groupBy(*by).applyInArrow(derived, schema), "pieces")
    for level in ("piece", "pid"):
        while nodes.agg(F.max(level)).first()[0]:  # until one is left: its number is 0
            up = {"piece": (F.col("pid"), F.floor(F.col("piece") / FAN)), "pid": (F.floor(F.col("pid") / FAN).cast("int"), F.lit(0).cast("bigint"))}[level]
            nodes = cut(nodes.groupBy("conv_id", up[0].alias("up_pid"), up[1].alias("up_piece")).applyInArrow(merged, schema), "nodes")
    totals = cut(nodes.mapInArrow(finished, totals_schema), "totals")
    schema, turns_schema, shared_out, applied = _cut_back(conv_type)
    chosen = pieces.groupBy("conv_id").cogroup(totals.groupBy("conv_id")).applyInArrow(shared_out, schema)
    applied = open_turns.groupBy(*by).cogroup(chosen.groupBy(*by)).applyInArrow(applied, turns_schema)
    names = ["conv_id", *FIGURES, "audit"]

    opened = done.where("kind = 3").select("conv_id").distinct()
    empty = opened.join(totals.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    empty = empty.select("conv_id", *(F.lit(0).cast("bigint").alias(c) for c in FIGURES), F.lit("").alias("audit"))
    summary = done.where("kind = 1").select(names).unionByName(totals.select(names)).unionByName(empty)
    return summary, done.where("kind = 0").select("conv_id", "place", "edit", "role", "text").unionByName(applied)


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the repaired turns `role:text`, joined by line ends: one conversation after another, as a stream."""
    conv_type = turns.schema["conv_id"].dataType.simpleString()

    def work(batches):
        none, like = object(), None
        conv, sha = none, None
        for batch in batches:
            like, ids, hashes = batch.column(0).type, [], []
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = line.encode("utf-8", "surrogatepass")
                if conv is none or at != conv:
                    if conv is not none:
                        ids.append(conv)
                        hashes.append(sha.hexdigest())
                    conv, sha = at, hashlib.sha256(data)
                else:
                    sha.update(b"\n" + data)
            yield pa.record_batch([pa.array(ids, like), pa.array(hashes, pa.string())], ["conv_id", "sha256"])
        if conv is not none:
            yield pa.record_batch([pa.array([conv], like), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "sha256"])

    lines = turns.select("conv_id", F.concat_ws(":", "role", "text").alias("line"), "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return lines.select("conv_id", "line").mapInArrow(work, f"conv_id {conv_type}, sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """conversations as the query damages them, by the CRC of `conv_id:turn`; copies says how often a turn counts afterwards."""
    blank = F.lit(" ")
    named = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    what = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(what == 1, F.lit("")).when(what == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    role = F.when(what == 4, F.lit("user")).otherwise(named("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"))
