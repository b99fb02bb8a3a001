"""Listing by levels, in tasks."""

import os

from tonguemill.sources import files


def test_levels_links_and_odd_names(spark, tmp_path):
    root = tmp_path / "inn boks 100%"
    for name in ("a b.txt", "_u/_v/c#d.txt", "deep/er/and/deeper/é.txt", ".git/x.txt", "deep/.y.txt", "Oversatt/z.txt", "deep/oversatt/w.txt", "ut/v.txt", "ut2/v.txt", "empty.md"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if name == "empty.md" else name)
    os.symlink(root, root / "deep" / "loop")
    os.symlink(root / "a b.txt", root / "link.txt")
    (root / "shut").mkdir()
    got = {r.path.split("inn boks 100%/")[1]: r.length for r in files.list_files(spark, str(root)).collect()}
    assert sorted(got) == sorted(["a b.txt", "_u/_v/c#d.txt", "deep/er/and/deeper/é.txt", "Oversatt/z.txt", "deep/oversatt/w.txt", "ut/v.txt", "ut2/v.txt", "empty.md"])
    docs = {r.name: bytes(r.content).decode() for r in files.scan_documents(spark, str(root), f"{root}/ut").collect()}
    assert docs == {n: "" if n == "empty.md" else n for n in ("a b.txt", "_u/_v/c#d.txt", "deep/er/and/deeper/é.txt", "ut2/v.txt", "empty.md")}
    assert files.list_files(spark, str(root / "shut")).count() == 0


def test_many_files_of_a_flat_folder(spark, tmp_path):
    for i in range(25_000):
        (tmp_path / f"{i}.txt").touch()
    assert files.list_files(spark, str(tmp_path)).count() == 25_000


def test_contents_are_held_in_parts(spark, tmp_path):
    rows = []
    for i in range(40):
        (tmp_path / f"{i}.txt").write_bytes(bytes([i]) * (2 << 20))
        rows.append((f"{tmp_path}/{i}.txt", i))
    df = spark.createDataFrame(rows, "path string, i int").coalesce(1)
    got = df.select("i", files.contents("path").alias("content")).selectExpr("i", "length(content) AS n", "substring(content, 1, 1) AS b").collect()
    assert all(r.n == 2 << 20 and r.b[0] == r.i for r in got) and len(got) == 40
