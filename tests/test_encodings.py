"""Delimited text in the encodings and with the signs that files hold."""

from pyspark.sql import functions as F

from mensura.sources import files

ROWS = [("é", "1"), ("a\x01b", "2"), ("€ “q”", "3"), ("x", "c\x01d")]


def _read(spark, path, **kw):
    return sorted(tuple(r) for r in files.read_csv(spark, str(path), **kw).collect())


def test_separator_signs_and_legacy_files(spark, tmp_path):
    text = "name,n\n" + "".join(f"{a},{b}\n" for a, b in ROWS)
    for enc, name in (("utf-8", None), ("utf-8-sig", None), ("cp1252", None), ("cp1252", "latin1"), ("utf-8", "utf-8"), ("utf-16", "utf-16")):
        p = tmp_path / f"{enc}-{name}.csv"
        p.write_bytes(text.encode(enc))
        assert _read(spark, p, header=True, encoding=name) == sorted(ROWS), (enc, name)
        assert files.read_csv(spark, str(p), header=True, encoding=name).columns == ["name", "n"]
        assert _read(spark, p, encoding=name) == sorted([("name", "n"), *ROWS]), (enc, name)
        assert _read(spark, p, skip_rows=1, encoding=name) == sorted(ROWS), (enc, name)


def test_each_file_by_itself(spark, tmp_path):
    """One UTF-8 and one windows-1252 file in a folder; a byte that is no UTF-8 far into a file counts for its first line too."""
    (tmp_path / "a.csv").write_bytes("h,k\né,utf\n".encode())
    (tmp_path / "b.csv").write_bytes("h,k\nÃ©,old\n".encode("cp1252") + b"x,y\n" * 30_000 + "é,old\n".encode("cp1252"))
    got = files.read_csv(spark, str(tmp_path), header=True)
    assert sorted(tuple(r) for r in got.where(F.col("h") != "x").collect()) == sorted([("é", "utf"), ("Ã©", "old"), ("é", "old")]) and got.count() == 30_003
    assert files.detect_encoding(spark, str(tmp_path / "a.csv")) == "utf-8" and files.detect_encoding(spark, str(tmp_path / "b.csv")) == "windows-1252"


def test_invalid_bytes_of_named_utf8(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(b"\xff,1\n")
    assert _read(spark, tmp_path / "c.csv", encoding="utf-8") == [("�", "1")]


def test_skipped_lines_of_split_files(spark, tmp_path):
    """Lines are numbered over splits of a file: fewer skipped than the first split holds, and more; each file by itself."""
    for name, enc in (("a", "utf-8"), ("b", "cp1252")):
        (tmp_path / f"{name}.csv").write_bytes("".join("\r\n" if i % 50 == 7 else f"{name}é,{i}\r\n" for i in range(2000)).encode(enc))
    (tmp_path / "c.csv").write_bytes(b"only\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        numbered = files.numbered_lines(spark, str(tmp_path / "a.csv"))
        assert sorted((r.line, bytes(r.data)) for r in numbered.collect()) == list(enumerate((tmp_path / "a.csv").read_bytes().split(b"\r\n")[:-1]))
        for skip in (1, 8, 1500, 1999, 3000):
            want = [(f"{n}é", str(i)) for n in "ab" for i in range(skip, 2000) if i % 50 != 7]
            assert _read(spark, tmp_path, skip_rows=skip) == sorted(want), skip
        got = files.read_csv(spark, str(tmp_path), skip_rows=1507, header=True)
        assert sorted(tuple(r) for r in got.collect()) == sorted((f"{n}é", str(i)) for n in "ab" for i in range(1509, 2000) if i % 50 != 7)
        assert got.columns[1] == "1508" and "binaryFile" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
