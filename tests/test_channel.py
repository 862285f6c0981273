"""Channels: any offset, several readers, a restart, and a publication that was left half done."""

from __future__ import annotations

import pytest

from larkspur.sources import channel
from larkspur.streaming.relay import RelayedTable, relay

SCHEMA = "id long, text string"
ROWS = "offset long, id long, text string"


@pytest.fixture
def path(tmp_path, monkeypatch):
    return f"file://{tmp_path}/channel"


def rows(spark, first, last):
    return spark.createDataFrame([(i, f"ü {i}\n") for i in range(first, last)], SCHEMA).repartition(3)


def drained(spark, path, folder, start=0):
    out = RelayedTable(spark, f"{folder}/rows")
    relay(channel.messages(spark, path, SCHEMA, start), {"t": out}, f"{folder}/checkpoint").start().awaitTermination()
    return sorted(map(tuple, out.read(ROWS).drop("batch").collect()))


def want(first, last):
    return [(i, i, f"ü {i}\n") for i in range(first, last)]


def test_readers_keep_their_own_place(spark, path, tmp_path, monkeypatch):
    assert channel.head(path) == 0
    monkeypatch.setattr(channel, "SEGMENT", 10_000)
    assert channel.publish(rows(spark, 0, 25), path, "id") == 25
    assert drained(spark, path, tmp_path / "a") == want(0, 25)
    assert channel.publish(rows(spark, 25, 12_040), path, "id") == 12_040
    assert drained(spark, path, tmp_path / "a") == want(0, 12_040)
    assert drained(spark, path, tmp_path / "b", 11_990) == want(11_990, 12_040)
    assert drained(spark, path, tmp_path / "c", "latest") == []
    channel.publish(rows(spark, 12_040, 12_050), path, "id")
    assert drained(spark, path, tmp_path / "c", "latest") == want(12_040, 12_050)
    # nothing new, nothing twice
    assert drained(spark, path, tmp_path / "a") == want(0, 12_050) and drained(spark, path, tmp_path / "a") == want(0, 12_050)


def test_a_publication_without_a_head_is_not_read_and_is_written_over(spark, path, tmp_path):
    channel.publish(rows(spark, 0, 5), path, "id")
    held = channel.head(path)
    channel.publish(rows(spark, 100, 103), path, "id")
    (tmp_path / "channel" / "head").write_text(str(held))
    assert drained(spark, path, tmp_path / "a") == want(0, 5)
    channel.publish(rows(spark, 5, 8), path, "id")
    assert drained(spark, path, tmp_path / "a") == want(0, 8)
