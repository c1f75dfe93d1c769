"""The data source of coreference files."""

import pathlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from mentionmill.sources import conll, conll_format


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    conll_format.register(spark)


def text(seed, docs=40):
    rnd, out = random.Random(seed), ["junk before"]
    for d in range(docs):
        out.append(f"#begin document (d{d}); part 000" if d % 3 else f"#begin document d{d}")
        for i in range(rnd.randrange(0, 30)):
            out.append(f"d{d}\t{i}\t" + rnd.choice(["-", "(1)", "(2|(3)", "2)", "(1|(1", "1)|1)", "2)|(2", "é (日本)"]))
            if rnd.random() < 0.1:
                out.append(rnd.choice(["", "# note", "   "]))
        if d % 7:
            out.append("#end document")
    return "\n".join(out)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [1, 17, 200, 1 << 20])
def test_ranges_of_one_file_give_every_document_once(tmp_path, ending, size):
    from pyarrow import fs

    whole = text(4).replace("\n", ending).encode()
    (tmp_path / "a.conll").write_bytes(whole)
    if size == 1:
        whole = whole[:1500]
        (tmp_path / "a.conll").write_bytes(whole)
    store = fs.LocalFileSystem()
    read = lambda a, b: list(conll_format.documents(store, conll_format.Range(str(tmp_path / "a.conll"), a, b), None))
    want = read(0, len(whole))
    assert [x for a in range(0, len(whole), size) for x in read(a, min(a + size, len(whole)))] == want and want


def test_many_tasks_equal_whole_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.conll").write_text(text(k))
    (tmp_path / "_hidden").write_text(text(9))
    df = spark.read.format("conll").option("rangeBytes", 500).load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() > 10
    want = sorted(map(tuple, conll.read_conll(spark, str(tmp_path / "f*.conll")).collect()))
    assert sorted(map(tuple, df.collect())) == want and len(want) > 300
    one = spark.read.format("conll").load(f"file://{tmp_path}/f1.conll")
    assert sorted(map(tuple, one.collect())) == [x for x in want if x[0] == "f1.conll"]


def test_options_and_filters(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.conll").write_text(text(k))
    reader = spark.read.format("conll").option("rangeBytes", 500)
    base = reader.load(f"file://{tmp_path}")
    want = [tuple(r) for r in conll.read_conll(spark, str(tmp_path / "f*.conll")).collect()]
    some = sorted(x for x in want if x[0] == "f2.conll" and x[1] in ("d1", "d5"))
    df = spark.read.format("conll").option("rangeBytes", 500).option("files", '["f2.conll"]').option("docs", '["d1", "d5"]').load(f"file://{tmp_path}")
    assert sorted(map(tuple, df.collect())) == some and some
    assert df.rdd.getNumPartitions() < base.rdd.getNumPartitions() / 2  # ranges of other files are not read
    assert sorted(map(tuple, base.where("file = 'f2.conll' and doc in ('d1', 'd5')").collect())) == some
    assert base.count() == len(want)  # a filter of one query is none of another
    assert spark.read.format("conll").option("files", "[]").load(f"file://{tmp_path}").count() == 0


def mentions(seed):
    rnd, out = random.Random(seed), []
    for d in range(30):
        for c in range(4):
            at = 0
            while at < 40 and rnd.random() < 0.8:
                end = at + rnd.choice([0, 0, 1, 3])
                out.append((f"d{d}", at, end, f"c{c}"))
                at = end + rnd.choice([0, 1, 4]) if end > at else end + 1
    return out


def test_written_mentions_come_back(spark, tmp_path):
    rows = mentions(2)
    df = spark.createDataFrame(rows, "doc string, begin int, end int, chain string").repartition(5)
    path = f"file://{tmp_path}/out"
    conll_format.write_mentions(df, path)
    got = spark.read.format("conll").option("rangeBytes", 300).load(path).drop("file")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    files = {p.name for p in (tmp_path / "out").iterdir()}
    assert all(f.endswith(".conll") for f in files)
    conll_format.write_mentions(df, path)
    assert got.count() == len(rows) and spark.read.format("conll").load(path).count() == 2 * len(rows)
    conll_format.write_mentions(df.limit(7), path, "overwrite")
    assert spark.read.format("conll").load(path).count() == 7
    conll_format.write_mentions(df.limit(0), f"file://{tmp_path}/none")
    assert spark.read.format("conll").load(f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("bad", [("d5", 0, 2, "x y"), ("d5", 3, 1, "c"), ("d5", 0, 0, "-")])
def test_a_failed_write_leaves_no_file(spark, tmp_path, bad):
    rows = [(f"d{i}", j, j + 1, "c") for i in range(20) for j in (0, 3)] + [bad]
    df = spark.createDataFrame(rows, "doc string, begin int, end int, chain string")
    path = tmp_path / "out"
    conll_format.write_mentions(df.where("doc = 'd1'"), f"file://{path}")
    before = {p.name: p.read_bytes() for p in path.iterdir()}
    with pytest.raises(Exception, match="not a mention"):
        conll_format.write_mentions(df, f"file://{path}")
    assert {p.name: p.read_bytes() for p in pathlib.Path(path).iterdir()} == before


def test_crossing_spans_are_refused():
    assert conll_format.document_lines("d", [(0, 1, "c"), (1, 2, "c")])[1] == "d\t1\tc)|(c"
    with pytest.raises(ValueError, match="cross"):
        conll_format.document_lines("d", [(0, 2, "c"), (1, 3, "c")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 4), st.sampled_from("ab")), max_size=8))
def test_what_is_written_is_what_is_read(spans):
    rows = [(b, b + n, c) for b, n, c in spans]
    try:
        lines = conll_format.document_lines("d", rows)
    except ValueError:
        return
    assert conll.parse_document(lines) == sorted(rows)


def test_documents_of_a_file_are_read_apart(spark, tmp_path):
    """No row that a task is given holds more than a document; documents without an end and lines outside of any are left out."""
    doc = lambda k: f"#begin document (d{k}); part 000\nx\t0\t(a{k}\n\n# note\nx\t1\ta{k})\n#end document\n"
    (tmp_path / "f.conll").write_text("before\n" + "".join(map(doc, range(40))) + "#begin document (open); part 000\nx\t0\t(z)\n" + doc(40) + "#begin document (last); part 000\nx\t0\t(z)\n")
    got = conll.read_conll(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(("f.conll", f"d{k}", 0, 1, f"a{k}") for k in range(41))
    assert "wholetext" not in got._jdf.queryExecution().toString().lower()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        assert conll.read_conll(spark, str(tmp_path)).rdd.getNumPartitions() > 3 and conll.read_conll(spark, str(tmp_path)).count() == 41
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
