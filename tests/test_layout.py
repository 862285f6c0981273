from __future__ import annotations

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_subpackage():
    for path in ROOT.glob("larkspur/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"larkspur\.llm|from \.llm", path.read_text()), path


def test_entry_has_the_engine_queries(spark):
    import __spark_entry__ as entry

    assert {"spl_stats_count_by", "stream_dedup"} <= set(entry.queries())
    assert entry.entry(spark).count() > 0
