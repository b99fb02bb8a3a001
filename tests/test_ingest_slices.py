"""A task of the ingest reads its part of a listing only, and gives its files in few batches."""

import pyarrow.parquet

from tonguemill.streaming import ingest


def test_slices_read_their_row_groups(tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "GROUP", 3)
    monkeypatch.setattr(ingest, "FILES_A_TASK", 4)
    for i in range(10):
        (tmp_path / f"{i}.txt").write_text(str(i))
    reader, read = ingest.ListingReader(str(tmp_path), str(tmp_path / ".log")), []
    reader.latestOffset()
    whole = pyarrow.parquet.ParquetFile.read_row_groups
    monkeypatch.setattr(pyarrow.parquet.ParquetFile, "read_row_groups", lambda self, groups, **k: read.append(groups) or whole(self, groups, **k))
    got = [list(reader.read(p)) for p in reader.partitions({"entry": 0}, {"entry": 1})]
    assert read == [[0, 1], [1, 2], [2, 3]] and [len(b) for b in got] == [1, 1, 1]
    assert [c.as_py() for b in got for c in b[0]["content"]] == [str(i).encode() for i in range(10)]
