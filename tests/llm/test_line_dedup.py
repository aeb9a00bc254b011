import random
from collections import defaultdict

import pytest
from helpers import documents, words

from lexframe.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_chars, min_docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else ():
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_against_brute_force(spark, batches):
    rng = random.Random(batches)
    pool = [words(rng, 3) for _ in range(12)] + ["x", "", "é" * 12]
    rows = [(i, "\n".join(rng.choice([" ", "\t"]) * rng.randint(0, 2) + rng.choice([str, str.upper])(rng.choice(pool)) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(None, pool[0]), (None, None), (41, None), (42, ""), (7, rows[7][1]), (7, pool[0] + "\n" + pool[1]), (43, "\n".join(pool[:3] * 200))]
    got = line_dedup.dedup_lines(documents(spark, rows).repartition(3), min_chars=8, min_docs=4, batches=batches)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == brute(rows, 8, 4)
    assert "component_id" in got.columns and got.columns.count("n_lines") == 1


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 4], [0, 2**60, 2**61, 3 * 2**60, 2**62 - 1], [-(2**63), -1, 0, 1, 2**63 - 1], [2**63 - 1 - i for i in range(9)], [-(2**63), *range(8)], [5] * 6 + [6, 7, 8, 9]])
def test_ids_of_any_size(spark, ids):
    rows = [(i, "x" * 50 + f"\n{'y' * 40}{k % 2}") for k, i in enumerate(ids)]
    for batches in (1, 4):
        got = line_dedup.dedup_lines(documents(spark, rows), batches=batches)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == brute(rows, 40, 5)


def test_empty(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "h1 bigint, h2 bigint, n_docs bigint, keeper bigint")


def test_runs_are_compacted_and_opened_again(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(4):
        runs = line_dedup.Runs(spark, path, fanout=2)  # the folder alone says what there is
        runs.add(rows_of(spark, [(1, 1, 1, 10 - i), (2 + i, 0, 1, 10 - i)]))
        runs.close()
    runs = line_dedup.Runs(spark, path, fanout=2)
    assert [c[:3] for c in runs.runs.values()] == [(1, 4, 2)]
    got = {(r.h1, r.n_docs, r.keeper) for r in runs.all().collect()}
    runs.close()
    assert got == {(1, 4, 10), (2, 1, 10), (3, 1, 9), (4, 1, 8), (5, 1, 7)}


def test_the_anti_join_decides_who_keeps(spark, tmp_path, monkeypatch):
    """A hash keeps the document it entered with, also if a later batch has a larger id; without the anti-join it would not."""
    runs = line_dedup.Runs(spark, str(tmp_path / "a"), fanout=9)
    for keeper in (5, 9, 7):
        runs.add(rows_of(spark, [(1, 1, 1, keeper), (keeper, 0, 2, keeper)]))
    assert {(r.h1, r.n_docs, r.keeper) for r in runs.all().collect()} == {(1, 3, 5), (5, 2, 5), (9, 2, 9), (7, 2, 7)}
    assert runs.fresh(rows_of(spark, [(1, 1, 1, 3), (8, 8, 1, 3)])).count() == 1
    held = sum(r.n for r in (runs.table(n).where("keeper IS NOT NULL AND h1 = 1").selectExpr("count(*) AS n").first() for n in runs.runs))
    assert held == 1
    runs.close()


def test_without_the_anti_join_there_is_no_result(spark, monkeypatch):
    rows = [(i, "x" * 50) for i in range(20)]
    assert line_dedup.dedup_lines(documents(spark, rows)).where("n_dropped = 1").count() == 19
    monkeypatch.setattr(line_dedup.Runs, "fresh", lambda self, batch: batch)
    with pytest.raises(Exception, match="entered two runs"):
        line_dedup.dedup_lines(documents(spark, rows)).collect()


def test_runs_are_neither_shuffled_nor_sorted(spark, tmp_path):
    runs = line_dedup.Runs(spark, str(tmp_path / "b"), fanout=9)
    for i in range(2):
        runs.add(rows_of(spark, [(j, i, 1, j) for j in range(50)]))
    with line_dedup._setting(spark, *line_dedup.SORTED_SCANS):
        for df, joins, batches in ((runs.fresh(rows_of(spark, [(1, 5, 1, 3)])), 2, 1), (runs.merged(sorted(runs.runs)), 1, 0)):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            # The batch is shuffled and sorted once; the runs, whatever their number, never are.
            assert (plan.count("SortMergeJoin"), plan.count("Exchange hash"), plan.count("Sort [")) == (joins, batches, batches)
    runs.close()


def test_a_run_left_behind_by_a_lost_compaction_is_dropped(spark, tmp_path):
    path = str(tmp_path / "c")
    runs = line_dedup.Runs(spark, path, fanout=9)
    for i in range(2):
        runs.add(rows_of(spark, [(1, 1, 1, 9 - i)]))
    runs._add_run(runs.merged(sorted(runs.runs)), 1, 2, 1)  # and the driver ends before the two have gone
    runs.close()
    again = line_dedup.Runs(spark, path)
    assert [tuple(r) for r in again.all().collect()] == [(1, 1, 2, 9)]
    again.close()
