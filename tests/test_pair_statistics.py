"""Statistics of all pairs of a component, joined or by blocks, against a loop over pairs."""

import random

import pytest

from tessera.operators import syntax


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize(("paired", "block", "columns"), [(64, 10000, 1024), (1, 10000, 1024), (1, 9, 1024), (4, 9, 3)])
def test_equal_a_loop_over_pairs(spark, monkeypatch, paired, block, columns):
    monkeypatch.setattr(syntax, "PAIRED", paired)
    monkeypatch.setattr(syntax, "BLOCK_SETS", block)
    statistics = syntax.block_statistics

    def narrow(key, table):  # in a task, where the module is imported anew
        from tessera.operators import syntax as there

        there.TILE, there.COLUMNS = 4, columns
        return statistics(key, table)

    monkeypatch.setattr(syntax, "block_statistics", narrow)
    rnd = random.Random(3)
    rows = [(i, i % 3, rnd.sample("abcdefghij", rnd.randrange(0, 6))) for i in range(90)]
    rows += [(200, 7, ["a"]), (201, 8, ["a"]), (202, 8, ["a", "a"]), (203, 9, []), (204, 9, ["b"]), (205, 10, ["c", "d"]), (206, 10, ["d", "e"])]
    got = {r.component: r for r in syntax.pair_statistics(spark.createDataFrame(rows, "report_id long, component long, hashes array<string>")).collect()}
    assert set(got) == {0, 1, 2, 8, 9, 10}
    for c, r in got.items():
        sets = [set(s) for _, k, s in rows if k == c]
        scores = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[:i]]
        assert (r.size, r.all_exact) == (len(sets), len(set(map(frozenset, sets))) == 1)
        assert r.mean == pytest.approx(sum(scores) / len(scores), abs=1e-12) and r.least == min(scores)
