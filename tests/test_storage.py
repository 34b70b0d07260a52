"""Written tables leave the driver tidy."""

import re
from pathlib import Path

import numpy as np

from conceptloom import storage


def test_writing_tables_collects_what_earlier_ones_left(spark, monkeypatch):
    monkeypatch.setattr(storage, "TIDY_S", 0.0)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    rows = storage.materialise(spark.range(10), "tidy")
    assert full() > before
    assert rows.count() == 10


def test_garbage_is_not_collected_again_at_once(spark, monkeypatch):
    monkeypatch.setattr(storage, "_tidied", float("-inf"))
    assert storage.tidy(spark)
    assert not storage.tidy(spark)


def _own_mb() -> float:
    return sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_writing_tables_returns_free_memory_to_the_system(spark, monkeypatch):
    monkeypatch.setattr(storage, "TIDY_S", 0.0)
    held = [np.ones(12_000) for _ in range(800)]  # under the size that has a mapping of its own
    last, full = np.ones(12_000), _own_mb()
    del held
    storage.materialise(spark.range(10), "free")
    assert full - _own_mb() > 40
    assert last.sum() == 12_000


def test_allocators_of_both_processes_give_back(spark):
    assert storage.give_back(spark) == (True, True)
