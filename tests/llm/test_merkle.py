"""The manifest against one built node by node on the driver, odd rows included."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import merkle

DOCS = "doc_id long, source string, text string"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def folded(nodes: list[str], fanout: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def brute(rows, seen, fanout):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row."""
    groups = defaultdict(list)
    for row, other in zip(rows, seen):
        groups[row[1]].append((row[0] is not None, row[0] or 0, sha(*map(field, row)), row[0], sha(*map(field, other))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: folded([leaf for _, _, leaf, _, _ in sorted(groups[s], key=lambda r: r[:3])], fanout) for s in names}
    top = folded([trees[s][-1][0] for s in names], fanout)
    out = []
    for tree, s in enumerate(names):
        for i, (_, _, leaf, doc_id, claimed) in enumerate(sorted(groups[s], key=lambda r: r[:3])):
            proof, node = [], claimed
            for levels, at in ((trees[s], i), (top, tree)):
                for level in levels[:-1]:
                    first = at // fanout * fanout
                    before, after = level[first:at], level[at + 1 : first + fanout]
                    proof += before + after
                    node = sha(*before, node, *after)
                    at //= fanout
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha(*proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def result(spark, rows, seen, fanout):
    data = [(*r, o[2]) for r, o in zip(rows, seen)]
    df = spark.createDataFrame(data, DOCS + ", other string").repartition(3)
    digest = merkle.record_digest(*map(F.col, ("doc_id", "source", "text")))
    claimed = merkle.record_digest(F.col("doc_id"), F.col("source"), F.col("other"))
    m = merkle.build(df.select("doc_id", "source", digest.alias("digest"), claimed.alias("seen")), "source", ["doc_id"], fanout)
    return sorted(map(tuple, merkle.proofs(m, "seen", ["doc_id"]).collect()), key=repr)


def tampered(rows):
    return [(i, s, t.lower() if t is not None and (i or 0) % 3 == 0 else t) for i, s, t in rows]


@pytest.mark.parametrize("fanout", [2, 3, 16])
@pytest.mark.parametrize("case", ["mixed", "one row", "one source", "lone sources", "empty"])
def test_equals_a_manifest_built_by_hand(spark, fanout, case):
    rows = {
        "mixed": [(i, "hot" if i % 2 else f"s{i % 7}é", f"Text {i} É" * (i % 4)) for i in range(90)] + [(None, None, None), (3, None, ""), (3, None, "x"), (3, None, "x"), (200, "hot", None), (None, "hot", "A" * 100_000)],
        "one row": [(1, "a", "X")],
        "one source": [(-i, "a", f"T{i}") for i in range(35)],
        "lone sources": [(i, f"s{i}", "Same") for i in range(20)],
        "empty": [],
    }[case]
    seen = tampered(rows)
    assert result(spark, rows, seen, fanout) == brute(rows, seen, fanout)


def test_shuffled_lookups_equal_broadcast_ones(spark, monkeypatch):
    rows = [(i, "hot" if i % 2 else f"s{i % 9}", f"Text {i}") for i in range(120)]
    seen = tampered(rows)
    want = brute(rows, seen, 4)
    for few in (0, 12):
        monkeypatch.setattr(merkle, "FEW_RUNS", few)
        monkeypatch.setattr(merkle, "FEW_GROUPS", few)
        assert result(spark, rows, seen, 4) == want


def test_any_change_is_noticed(spark):
    rows = [(i, f"s{i % 3}", f"text {i}") for i in range(40)]
    for change in ([(i, s, t + "!") for i, s, t in rows], [(i, s, "") for i, s, t in rows], [(i, s, None) for i, s, t in rows]):
        assert not any(r[-1] for r in result(spark, rows, change, 16))
    assert all(r[-1] for r in result(spark, rows, rows, 16))
