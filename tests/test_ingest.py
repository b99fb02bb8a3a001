"""Continuous ingest: new files once, replayed and half-done batches, lost checkpoints."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tonguemill.sources.files import decode_text
from tonguemill.streaming import ingest


def text(batch):
    return decode_text(batch).select("name", F.upper("text").alias("text"), "length", "entry")


def rows(spark, table):
    return sorted((r.name, r.text, r.length, r.entry) for r in spark.read.parquet(table).collect())


def test_exactly_once(spark, tmp_path):
    src, table, ck = tmp_path / "inn boks", str(tmp_path / "table"), str(tmp_path / "ck")
    for d in ("sub", "_dir", "oversatt", ".git"):
        (src / d).mkdir(parents=True)
    run = lambda transform=text, checkpoint=ck: ingest.ingest_table(spark, str(src), table, checkpoint, transform).awaitTermination()
    run()  # nothing there yet
    for name, body in (("a.txt", "a"), ("_b.md", "b"), ("_dir/c.csv", ""), ("x.bin", "x"), ("oversatt/d.txt", "d"), (".git/e.txt", "e"), (".f.txt", "f")):
        (src / name).write_text(body)
    run()
    first = [("_b.md", "B", 1, 1), ("_dir/c.csv", "", 0, 1), ("a.txt", "A", 1, 1)]
    assert rows(spark, table) == first
    run()
    assert rows(spark, table) == first
    (src / "sub/å.txt").write_text("é")
    (src / "a.txt").write_text("handled already")

    def lost(batch):
        text(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entry").parquet(table)
        raise RuntimeError("lost before it was written down")

    with pytest.raises(Exception, match="lost before"):
        run(lost)
    (src / "late.txt").write_text("late")  # comes with the next batch, not with the one that is done again
    run()
    assert rows(spark, table) == sorted([*first, ("sub/å.txt", "É", 2, 2)])
    run()
    every = sorted([*first, ("sub/å.txt", "É", 2, 2), ("late.txt", "LATE", 4, 3)])
    assert rows(spark, table) == every
    # the commit of the last batch is lost: the batch is replayed, and its ledger keeps it from being computed
    commits = sorted((p for p in Path(ck, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    Path(ck, "commits", f".{commits[-1].name}.crc").unlink(missing_ok=True)

    def never(batch):
        raise AssertionError("computed again")

    run(never)
    assert rows(spark, table) == every
    # the whole checkpoint is lost
    shutil.rmtree(ck)
    run(checkpoint=str(tmp_path / "new"))
    assert [r[:2] for r in rows(spark, table)] == sorted((n, "HANDLED ALREADY" if n == "a.txt" else t) for n, t, _, _ in every)


def test_files_are_dealt_by_number_and_size(tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FILES_A_TASK", 4)
    monkeypatch.setattr(ingest, "BYTES_A_TASK", 10)
    for i, n in enumerate([1, 1, 1, 1, 1, 20, 6, 6, 0]):
        (tmp_path / f"{i}.txt").write_text("x" * n)
    reader = ingest.ListingReader(str(tmp_path), str(tmp_path / ".log"))
    assert reader.latestOffset() == {"entry": 1} and reader.latestOffset() == {"entry": 1}
    parts = reader.partitions({"entry": 0}, {"entry": 1})
    assert [(p.first, p.end) for p in parts] == [(0, 4), (4, 5), (5, 6), (6, 7), (7, 9)]
    (tmp_path / "3.txt").unlink()
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 8
    assert ingest.ListingReader(str(tmp_path), str(tmp_path / ".log")).latestOffset() == {"entry": 1}
