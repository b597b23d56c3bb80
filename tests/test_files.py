import pytest

from lexmeta.sources import files


def test_jsonl_round_trip_and_bad_lines(spark, tmp_path):
    rows = [("1", "câu", None, "tham chiếu", "dịch\nhai", "m", "4", 4.0, "{}")]
    df = spark.createDataFrame(rows, files.EXAMPLE)
    files.write_jsonl(df, str(tmp_path / "a"))
    assert files.read_jsonl(spark, str(tmp_path / "a"), files.EXAMPLE).collect() == df.collect()
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n\n{broken\n')
    loose = files.read_jsonl(spark, str(tmp_path / "b.jsonl"), files.EXAMPLE, strict=False).collect()
    assert [r["_corrupt"] for r in loose] == [None, "{broken"]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), files.EXAMPLE).collect()


@pytest.mark.parametrize("rows", [[(1, 'a "b", c\nd'), (2, " x ")], []])
def test_csv_with_mark(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "stt INT, text STRING").repartition(3)
    files.write_csv_bom(df, str(tmp_path / "c"))
    parts = [p.read_bytes() for p in (tmp_path / "c").glob("part-*") if p.stat().st_size]
    assert parts and all(p.startswith(b'\xef\xbb\xbf"stt","text"\n') for p in parts)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "stt INT, text STRING").collect())) == rows


def test_vectors_aliases_and_checks(spark):
    df = spark.createDataFrame([("d", {"m": [0.5, 1.0]})], "dataset STRING, scores MAP<STRING, ARRAY<DOUBLE>>")
    assert [(r.metric, r.ordinal, r.score) for r in files.explode_vectors(df).orderBy("ordinal").collect()] == [("m", 0, 0.5), ("m", 1, 1.0)]
    wide = spark.createDataFrame([(1, 0.1, 0.2)], "id INT, metric__a DOUBLE, metric__b DOUBLE")
    assert sorted((r.metric, r.score) for r in files.wide_to_long(wide, ["id"]).collect()) == [("a", 0.1), ("b", 0.2)]
    alias = spark.createDataFrame([(" ", "x")], "a STRING, b STRING")
    assert files.first_present(alias, "v", "missing", "a", "b").first().v == "x"
    levels = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 0), ("b", 0)], "id STRING, damage_level INT")
    assert files.level_cache_checks(levels).first() == (2, 1, 1)
