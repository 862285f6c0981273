"""The whole pipeline against one in plain Python: every stage by its definition, on all that the one before it kept."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

import corpus_pipeline
from larkspur.llm import toxicity
from larkspur.llm.queries import WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def md5(text) -> str:
    return hashlib.md5(("" if text is None else str(text)).encode()).hexdigest()


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def grams(words: list[str]) -> list[tuple]:
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def is_toxic(model: toxicity.FactorizationMachine, text: str | None) -> bool:
    margin = model.bias
    for _, _, _, term in toxicity.terms(pa.array([text], pa.string()), model.known):
        margin += sum(model.w[i] for i in term) + sum(float(model.v[i] @ model.v[j]) for i, j in combinations(term, 2))
    return margin >= 0


def without_copies(rows: list[tuple]) -> list[tuple]:
    """The smallest doc_id of each component, each text of it once; all rows without doc_id."""
    sets = {i: (r, set(grams(re.findall(r"[^\x20\x09-\x0D]+", lowered(r[1]))))) for i, r in enumerate(rows) if r[0] is not None}
    up = {r[0]: r[0] for r, _ in sets.values()}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in combinations(sets.values(), 2):
        both = len(x & y)
        if both and 100 * both >= 80 * len(x | y):
            low, high = sorted((root(a[0]), root(b[0])))
            up[high] = low
    kept = {(r[0], r[1]): r for r, _ in sets.values() if root(r[0]) == r[0]}
    return [*kept.values(), *(r for r in rows if r[0] is None)]


def holds(text: str | None, items: list[Counter]) -> bool:
    """Whether any window of an item's size, wherever it starts, is similar enough."""
    mine = grams(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text)))
    for item in items:
        m = item.total()
        if not m or item.keys().isdisjoint(mine):
            continue
        for start in range(max(1, len(mine) - m + 1)):
            window = Counter(mine[start : start + m])
            shared = (window & item).total()
            if shared >= 0.8 * (m + window.total() - shared) - 1e-12:
                return True
    return False


def mixed(rows: list[tuple]) -> list[tuple]:
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode())
    weight = {s: WEIGHTS.get(s, 1.0) for s in sizes}
    out = []
    for r in rows:
        size = sizes[r[3]]
        rate = round(weight[r[3]] / sum(weight.values()) * sizes.total() / size, 9) if size else 1.0
        draws = max(1, math.ceil(rate / 32))
        mean = rate / draws
        for j in range(1, draws + 1):
            u = int(md5(f"17:{'' if r[0] is None else r[0]}:{md5(r[1])}:{j}")[:13], 16) / 2**52
            p = c = math.exp(-mean)
            n = 0
            while c <= u and n < mean + 12 * math.sqrt(mean) + 24:
                n += 1
                p *= mean / n
                c += p
            out += [r] * n
    return out


def placed(rows: list[tuple], shards: int = 24) -> list[tuple]:
    size = [len((r[1] or "").encode()) + 8 for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (int(md5(rows[i][1])[:9] + md5(rows[i][0])[:6], 16), -math.inf if rows[i][0] is None else rows[i][0], size[i]))
    out, at, first = [], 0, {}
    for n, i in enumerate(order):
        shard = min(shards - 1, int((at + size[i] / 2) * shards / sum(size)))
        at += size[i]
        out.append((*rows[i], shard, n - first.setdefault(shard, n)))
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path, odd):
    """Beside the given rows labelled toxic ones, as the smallest tables hold too few to learn from; odd: also rows of
    null in every column, empty texts, repeated rows and a repeated doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    items = [r.text for r in bench.collect()]
    more = [(800_000 + i, f"{i} vermin number{i} scum {i * i} filth word{i * 7}", "en", "src1", 9) for i in range(60)]
    labels = labels.unionByName(spark.createDataFrame([(r[0], 0, 1) for r in more], labels.schema))
    if odd:
        prose = [" ".join(f"{name}{i * i}" for i in range(40)) for name in ("ab", "cd", "ef")]
        more += [(None, prose[0], "en", "src0", 1), (None, items[0], None, None, None), (900_001, prose[1], None, None, None), (900_001, prose[1], None, None, None)]
        more += [(900_002, None, "en", "src1", 0), (900_003, "", "en", None, 0), (900_004, "a", "en", "src1", 1), (900_004, prose[2], "en", "src1", 1), (None, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sf_dir, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [tuple(r) for r in docs.collect()]
    model = toxicity.fit(docs, labels)
    left = [len(want)]
    want = [r for r in want if not is_toxic(model, r[1])]
    left.append(len(want))
    want = without_copies(want)
    left.append(len(want))
    counted = [Counter(grams(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)))) for t in items]
    want = [r for r in want if not holds(r[1], counted)]
    left.append(len(want))
    # every filter has something to do
    assert left == sorted(left, reverse=True) and len(set(left)) == 4
    want = placed(mixed(want))
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select(*COLUMNS, "shard", "slot").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
