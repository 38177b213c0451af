from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from tributary.sources.datasource import FactsReader, PushingReader, allowed, listing, register
from tributary.sources.pdf import pdf_text
from tributary.sources.readers import READERS, facts, files


def made(folder):
    folder.mkdir()
    for name, data in {"a.csv": b"name,city\nAnn,X\n\"B\no\",Y\n", "b b.json": b'{"email": "a@x.org", "skills": ["sql"]}', "broken.json": b"{", "head.csv": b"a,b\n", "c.text": b"Ann\nSkills", "d.xyz": b"1", "empty.csv": b"", "_hidden": b"1"}.items():
        (folder / name).write_bytes(data)
    return [str(folder / n) for n in ("a.csv", "b b.json", "broken.json", "none.json", "head.csv", "d.xyz", "empty.csv")]


def test_rows_are_those_of_facts(spark, tmp_path):
    paths = made(tmp_path / "in")
    register(spark)
    got = spark.read.format("tributary").load(paths)
    assert sorted(map(str, got.collect())) == sorted(map(str, facts(files(spark, paths)).collect()))
    assert got.where("ok and field_name is not null").count() == 6
    one = spark.read.format("tributary").load(f"file://{tmp_path}/in")  # a folder, by its address
    assert {(r.source_id, r.ok) for r in one.where("field_name is null").collect()} == {("a.csv", True), ("b b.json", True), ("broken.json", False), ("head.csv", False), ("c.text", True), ("d.xyz", False), ("empty.csv", False)}
    assert one.where("field_name = 'document'").first().raw_value == "Ann\nSkills"


def test_a_reader_of_ones_own(spark, tmp_path):
    def lines(name, data):
        for i, line in enumerate(data.decode().splitlines()):
            yield i + 1, "full_name", line, None, "line"

    (tmp_path / "x.names").write_text("Ann\nBo")
    register(spark, {**READERS, ".names": ("semistructured", lines)}, name="names")
    got = spark.read.format("names").load(str(tmp_path / "x.names")).where("field_name is not null")
    assert [(r.source_id, r.raw_value, r.source_type) for r in got.orderBy("row").collect()] == [("x.names#row1", "Ann", "semistructured"), ("x.names#row2", "Bo", "semistructured")]


def test_conditions_leave_files_unopened(spark, tmp_path):
    paths = made(tmp_path / "in")
    assert [e for *_, e in listing(paths)] == [None, None, None, "file not found", None, None, None]
    assert allowed([("source_id", ("a.csv#row2",))], 0, "a.csv", "structured") and not allowed([("source_id", ("a.csv",)), ("source_seq", (1,))], 0, "a.csv", "structured")
    reader = FactsReader(paths, READERS, pdf_text)
    reader.filters = [("source_type", ("semistructured",))]
    assert [f[1] for p in reader.partitions() for f in p.files] == ["b b.json", "broken.json", "none.json"]
    reader.filters = [("source_seq", (99,))]
    assert [p.files for p in reader.partitions()] == [[]]
    register(spark, name="opened", push=False)
    register(spark)
    for name in ("tributary", "opened"):  # pushed or not, the rows are the same
        got = spark.read.format(name).load(paths)
        assert [r.raw_value for r in got.where((F.col("source_id") == "a.csv#row2") & (F.col("field_name") == "full_name")).collect()] == ["B\no"]
        assert got.where(F.col("source_type").isin("semistructured")).where("field_name is null").count() == 3
        assert got.where("source_seq = 99").count() == 0


def test_pushed_conditions(spark, tmp_path):
    reader = PushingReader(made(tmp_path / "in"), READERS, pdf_text)
    filters = [EqualTo(("source_id",), "a.csv"), In(("source_seq",), (0, 1)), EqualTo(("field_name",), "skills")]
    assert list(reader.pushFilters(filters)) == filters  # Spark filters the rows as well
    assert [f[1] for p in reader.partitions() for f in p.files] == ["a.csv"]
