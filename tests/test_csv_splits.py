import csv
import io
import random

import pytest

from tributary.plans.engine import run
from tributary.sources.csv_splits import DELIMITERS, csv_facts_of, quoted_after
from tributary.sources.readers import csv_facts

CELLS = ["a", "", " ", 'say "x"', "two\nlines", "cr\r\nlf", "é中", "a;b|c", '"', "\n\n", "x" * 300, ",", 'in"side', "z" * 40]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "300b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def serial(data: bytes):
    try:
        return [r for r in csv_facts("f.csv", data)], None
    except ValueError as e:
        return [], str(e)


def written(r, rows, delimiter, end):
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=delimiter, lineterminator=end)
    w.writerow(["name", "skills", "Pay Rate", "note\nof two lines"])
    for i in range(rows):
        w.writerow([f"N{i}", *(r.choice(CELLS) for _ in range(r.randrange(0, 5)))])
        if r.random() < 0.1:
            out.write(end)
    return out.getvalue()


def test_as_a_serial_reader(spark, small_splits, tmp_path):
    r = random.Random(1)
    texts = [written(r, 40, d, end) for d in DELIMITERS for end in ("\n", "\r\n")]
    texts += ["", "\n", "a,b\n", "a,b\n\n\n", " , \n1,2\n", "\ufeffname,b\n1,2\n", 'name,b\n"open,\n' + "more\n" * 400, 'name\n5" disk, "x"\n"y\n' * 150, "name,b\r1,2\r\r3,4\r", "name\n" + "v" * 5000 + "\nw", 'name,b\n"' + "q\n" * 900 + '",2\n3,4\n']
    texts += ["".join(r.choice('ab,"\n\r') for _ in range(r.randrange(20, 2500))) for _ in range(16)]
    data = [t.encode() for t in texts] + [b"name,b\n\xff\xfe,2\n" + b"x,y\n" * 50]
    paths = []
    for i, d in enumerate(data):
        paths.append(str(tmp_path / f"f {i}+%20.csv"))
        (tmp_path / f"f {i}+%20.csv").write_bytes(d)
    found = csv_facts_of(spark, [*paths, str(tmp_path / "none.csv")]).collect()
    by = {i: ([], None) for i in range(len(paths) + 1)}
    for x in found:
        by[x.source_seq][0].append(x)
    for i, d in enumerate(data):
        want, error = serial(d)
        rows = sorted((x for x in by[i][0] if x.field_name), key=lambda x: (x.row, x.ev_seq))
        state = [x for x in by[i][0] if not x.field_name]
        assert len(state) == 1 and state[0].ok == (error is None), (i, error, state)
        assert (state[0].error or "")[:14] == (error or "")[:14], i
        assert [(x.row, x.field_name, x.raw_value, x.key, x.method) for x in rows] == want, (i, texts[i])
        assert all(x.source_id == f"f {i}+%20.csv#row{x.row}" for x in rows)
        assert error or state[0].row >= max((x[0] for x in want), default=0)
    assert [(x.ok, x.error) for x in by[len(paths)][0]] == [(False, "file not found")]


def test_many_tasks_read_one_file(spark, small_splits, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("name,note\n" + "".join(f'N{i},"line {i}\nof two"\n' for i in range(700)))
    df = csv_facts_of(spark, [str(path)])
    names = {x.row: x.raw_value for x in df.where("field_name = 'full_name'").collect()}
    assert names == {i + 1: f"N{i}" for i in range(700)}
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 15
    out = run(spark, [str(path)])
    assert out.canonical.count() == 700 and {s.error for s in out.sources.collect()} == {None}


def test_quotes():
    for line, quoted, want in (('a,"b', False, True), ('a"b', False, False), ('"a""b', False, True), ('"a"b"', False, False), ('x",y', True, False), ('x"",y', True, True), ('x","y', True, True), ("", True, True), ('"', False, True), ('""', False, False), ('"', True, False), ('a,"b"c,"d', False, True)):
        assert quoted_after(line, quoted, ",") == want, line
