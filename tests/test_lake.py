"""Lake tables, stored frames, file readers, node introspection."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import ldsc
from quillon.operators import from_files
from quillon.plans.registry import Engine, normalise
from quillon.sources import formats, sinks, store
from quillon.sources.lake import Lake, free_of_reserved, latest, locus_struct, search


@pytest.fixture
def lake(spark, request):
    return Lake(spark, f"t.{request.node.name}")


def test_write_append_query_and_describe(spark, lake):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    lake.write(df, "t")
    lake.write(spark.createDataFrame([("3", 4.0)], "x string, y double"), "t", "append")  # by position, cast to the table's types
    assert sorted((r.k, r.v) for r in lake.table("t").collect()) == [(1, "a"), (2, None), (3, "4.0")]
    lake.insert("t", "SELECT 9, 'z'")
    page = lake.query(f"SELECT * FROM {lake.ident('t')} ORDER BY k", max_rows=2, offset=1)
    assert [r["k"] for r in page["rows"]] == [2, 3] and page["total_available"] == 4 and page["has_more"] and page["columns"] == ["k", "v"]
    assert [t.rsplit(".", 1)[1] for t in lake.tables()] == ["t"] and len(lake.query("list tables;")["rows"]) == 1
    assert [(c["name"], c["type"], c["field_id"]) for c in lake.describe("t")] == [("k", "int", 1), ("v", "string", 2)]
    assert lake.count("t") == 4 and len(lake.preview("t", 3)) == 3
    lake.write(df.select("v"), "t")
    assert lake.table("t").columns == ["v"]
    with pytest.raises(ValueError):
        lake.write(df, "t", "append")
    with pytest.raises(ValueError):
        lake.write(df, "t", "upsert")
    lake.drop("t")
    assert lake.tables() == []


def test_loads_may_be_repeated(spark, lake):
    df = spark.createDataFrame([("1", 1), ("2", 2), ("2", 3)], "chrom string, v int")
    assert {r[0] for r in lake.load_partitions(df.filter("chrom = '1'"), "af", "chrom").collect()} == {"1"}
    assert {r[0] for r in lake.load_partitions(df, "af", "chrom").collect()} == {"2"}
    assert lake.load_partitions(df, "af", "chrom").count() == 0 and lake.count("af") == 3
    assert lake.load_each({"1": df, "2": df}, "ld") == ["1", "2"] and lake.load_each({"2": df, "3": df}, "ld") == ["3"]


def test_records_keep_their_history(spark, lake):
    row = lambda v: spark.createDataFrame([("s1", v)], "id string, name string")
    lake.add_records("studies", row("first"), "created")
    lake.add_records("studies", row("second"), "done")
    assert lake.count("studies") == 2 and [(r.name, r.state) for r in lake.latest_records("studies", "id").collect()] == [("second", "done")]


def test_reserved_names_search_and_locus(spark):
    df = spark.createDataFrame([(1, 2, "p", 4)], "pos int, pos_col int, file_path string, v int")
    assert free_of_reserved(df).columns == ["pos_col_", "pos_col", "file_path_col", "v"]
    s = spark.createDataFrame([(1, "Height of men", 5.0), (2, "BODY HEIGHT", None), (3, "weight", 9.0)], "id int, trait string, n double")
    assert [r.id for r in search(s, "height", "trait", ["trait", "n"], 5, "n").collect()] == [1, 2]
    with pytest.raises(ValueError):
        search(s, "x", "id; drop", ["trait"], 1, "trait")
    d = locus_struct(spark.createDataFrame([("1", 7, 0.5)], "`locus.contig` string, `locus.position` long, af double"))
    assert d.select("locus.contig", "locus.position", "af").first() == ("1", 7, 0.5)
    e = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, None, 9)], "k int, at int, t int")
    assert latest(e, "k", "at", "t").first().t == 2


def test_sink_table_query_and_quoted_names(spark, lake, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame([(1, 10), (2, 20)], "`My Key` int, pos int").write.parquet(path)
    e = Engine(spark)
    e.add("in", "source", {"path": path})
    e.add("q", "sql", {"sql_query": 'SELECT "My Key" AS k, pos FROM port_0'})
    e.add("out", "sink_table", {"ident": f"{lake.levels[0]}.made", "rename_reserved": "true"})
    e.connect("in", "q")
    e.connect("q", "out")
    assert e.run().summary()["succeeded"] == 3 and lake.table("made").columns == ["k", "pos_col"]
    other = Engine(spark)
    other.add("again", "query_table", {"query": f"SELECT sum(k) AS s FROM {lake.ident('made')}"})
    other.run()
    assert other.output("again").first().s == 3 and e.ports("q")["inputs"] is None and other.ports("again")["outputs"] == {0: None}
    info = e.registry.info("mr")
    assert info["spec"]["properties"]["parameters"]["properties"]["nboot"] == {"type": "integer"} and info["doc"] is not None
    assert len(e.registry.catalogue()) == len(e.registry.kinds)


def test_references_in_schemas():
    schema = {"type": "object", "properties": {"a": {"$ref": "#/defs/number"}, "b": {"type": "array", "items": {"$ref": "#/defs/number"}}}, "defs": {"number": {"type": "number"}}}
    assert normalise({"a": "1.5", "b": {"item": "2"}}, schema) == {"a": 1.5, "b": [2.0]}


@pytest.mark.parametrize(("given", "want"), [("a/b/", "/a/b"), ("/a", "/a"), ("./a", "/a"), (".", "/"), ("", "/"), ("a", "/a")])
def test_normalised_paths(given, want):
    assert formats.normalise_path(given) == want


def test_tsv_by_position_and_split_fastq(spark, tmp_path):
    f = tmp_path / "a.afreq"
    f.write_text("1\trs1\t0.5\n2\trs2\t.\n")
    got = formats.read_tsv(spark, str(f), "chrom string, id string, af double").collect()
    assert [(r.chrom, r.id, r.af) for r in got] == [("1", "rs1", 0.5), ("2", "rs2", None)]
    q = tmp_path / "a.fastq"
    q.write_text("".join(f"@r{i} d{i}\n{'ACGT' * (i % 5 + 1)}\n+\n{'@I+I' * (i % 5 + 1)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = formats.read(spark, str(q))
        rows = {r.name: (r.description, r.sequence, r.quality) for r in df.collect()}
        assert spark.read.text(str(q)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == {f"r{i}": (f"d{i}", "ACGT" * (i % 5 + 1), "@I+I" * (i % 5 + 1)) for i in range(3000)}


def test_stored_frames(spark):
    df = store.stored(spark.range(5).withColumn("r", F.rand(1)))
    assert [r.r for r in df.orderBy("id").collect()] == [r.r for r in df.orderBy("id").collect()] and df.count() == 5


def test_heritability_from_files(spark, tmp_path):
    """What the writers write gives the heritability that the frames give."""
    n = 400
    rows = [(1 + i // 200, f"rs{i}", 10 * i, 1 + 0.1 * (i % 97), 1.0 + i % 5) for i in range(n)]
    panel = spark.createDataFrame(rows, "CHR int, SNP string, BP long, L2 double, extra double")
    z = panel.select("SNP", F.lit("A").alias("A1"), F.lit("C").alias("A2"), F.round(F.sqrt(1 + 1000.0 / n * 0.4 * F.col("L2")), 3).alias("Z"), F.lit(1000.0).alias("N"))
    sinks.write_sumstats(z, str(tmp_path / "t.sumstats.gz"))
    sinks.write_ldscore(panel.drop("extra"), str(tmp_path / "ref"), ["L2"], [float(n)], [float(n)])
    sinks.write_ldscore(panel, str(tmp_path / "two"), ["L2", "extra"], [float(n), 50.0], [float(n), 50.0])
    file = lambda k: str(tmp_path / f"{k}.l2.ldscore.gz")
    h = from_files.heritability_from_files(spark, str(tmp_path / "t.sumstats.gz"), [file("ref")], file("ref"), blocks=20, intercept=1.0)
    frame = panel.join(z, "SNP").select("CHR", "BP", "SNP", F.col("Z").alias("z"), F.col("N").alias("n"), F.col("L2").alias("ld"), F.col("L2").alias("wld"))
    want = ldsc.heritability(ldsc.place(frame, ["CHR", "BP", "SNP"]), float(n), 20, 1.0)
    assert h.fit.tot == pytest.approx(want.fit.tot, rel=1e-6) and h.fit.tot == pytest.approx(0.4, abs=1e-3) and h.fit.tot_se == pytest.approx(want.fit.tot_se, rel=1e-3)
    p = from_files.heritability_from_files(spark, str(tmp_path / "t.sumstats.gz"), [file("two")], file("ref"), blocks=20, intercept=1.0)
    assert p.names == ["L2", "extra"] and p.cat[0] == pytest.approx(0.4, abs=5e-3)
