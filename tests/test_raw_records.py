import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmeta.operators import raw_records as R

SCHEMA = "line_id BIGINT, delim STRING, raw_text STRING"
GOOD = 'a,A,"x, ""y""",v,p,85.5,"[""missing_text""]",NC-01,'


def outcome(spark, *texts, delim=","):
    rows = [(i, delim, t) for i, t in enumerate(texts)]
    return [r.reason for r in R.check_records(spark.createDataFrame(rows, SCHEMA)).orderBy("line_id").collect()]


def test_reasons(spark):
    tail = ",[],n,"
    assert outcome(
        spark, GOOD, GOOD + "\r", 'a,"b', 'a,b"c,d', 'a,"b"c', "a,b", None, "",
        "a,A,z,v,p,101" + tail, "a,A,z,v,p,85,5" + tail, "a,A,z,v,p,nan" + tail, "a,A,z,v,p, +8.5e1 " + tail, "a,A,z,v,p," + tail,
        'a,A,z,v,p,1,"[""missing_text"",""missing_text""]",n,', "a,A,z,v,p,1,,n,", 'a,A,z,v,p,1,"[""x""]",n,', 'a,A,z,v,p,1,"[""missing_text"",]",n,',
        "a,A,z\nz,v,p,1" + tail, 'a,A,"z\nz",v,p,1' + tail,
    ) == [
        None, None, "broken_quoting", "broken_quoting", "broken_quoting", "column_count", "column_count", "column_count",
        "invalid_score", "column_count", "invalid_score", None, None,
        "invalid_flags", "invalid_flags", "invalid_flags", "invalid_flags", "column_count", None,
    ]


def test_typed_rows_and_offsets(spark):
    df = spark.createDataFrame([(1, ",", GOOD), (2, ",", 'ab"c')], SCHEMA)
    row = R.valid_rows(df).first()
    assert (row.source_zh, row.human_score, row.quality_flags, row.cross_rater) == ('x, "y"', 85.5, ["missing_text"], "")
    assert R.invalid_rows(df).first().error_offset == 2


def test_empty_table_and_clashing_column(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.check_records(df).count() == 0
    try:
        R.parse_records(df.withColumnRenamed("line_id", "fields"))
        raise AssertionError
    except ValueError:
        pass


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text('ab",;\n', max_size=700), min_size=1, max_size=4), min_size=1, max_size=4), st.sampled_from([3, 16, 256]))
def test_round_trip_with_any_chunk(rows, chunk):
    """What a strict writer writes is read back, whatever the chunk length cuts through."""
    texts = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
        texts.append(out.getvalue().encode())
    fields, states, faults, breaks = R.tokenize(texts, [ord(",")] * len(texts), chunk)
    assert [R._split(t, f, s) for t, f, s in zip(texts, fields, states.tolist())] == rows
    assert (faults == -1).all() and (breaks == 0).all()
