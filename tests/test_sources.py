import pytest
from pyspark.sql import functions as F

from conceptloom import cli, config
from conceptloom.plans import jobs
from conceptloom.sources import files, jdbc

DERBY = config.Database("jdbc:derby:memory:cdm;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", "app", "app")


@pytest.fixture(scope="module")
def database(spark):
    spark.range(1, 101).select(F.col("id").alias("person_id"), (F.col("id") % 7).cast("int").alias("year")).write.jdbc(DERBY.url, "person", "overwrite", DERBY.properties)
    spark.range(3).select(F.col("id").alias("concept_id")).write.jdbc(DERBY.url, "concept", "overwrite", DERBY.properties)
    return DERBY


def test_jdbc_reads_in_ranges_and_downloads(spark, database, tmp_path):
    # written columns are quoted and keep their case
    assert jdbc.largest_key(spark, database, "person", '"person_id"') == 100
    part = jdbc.read_partitioned(spark, database, "person", '"person_id"', 4)
    assert part.rdd.getNumPartitions() == 4 and part.count() == 100
    assert jdbc.download(spark, database, ["concept"], str(tmp_path)) == ["concept"]
    assert spark.read.parquet(f"{tmp_path}/concept").count() == 3
    with pytest.raises(RuntimeError, match="missing"):
        jdbc.download(spark, database, ["missing", "concept"], str(tmp_path))


def test_ini(tmp_path):
    (tmp_path / "a.ini").write_text("[DEFAULT]\nBASE_URL=u\ndriver=d\nuser=me\npassword=p\nresource_folder=/r\n")
    assert config.read_database(f"{tmp_path}/a.ini") == config.Database("u", "d", "me", "p")
    assert config.read_resource_folder(f"{tmp_path}/a.ini") == "/r"
    with pytest.raises(FileNotFoundError):
        config.read_database(f"{tmp_path}/b.ini")


def test_text_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 2\n</s> 0.1 0.2 \n12 0.5 -1.0 \n13 1 2\n")
    assert sorted((r.standard_concept_id, r.vector) for r in files.read_vectors_text(spark, f"{tmp_path}/v.txt").collect()) == [(12, [0.5, -1.0]), (13, [1.0, 2.0])]
    (tmp_path / "c.txt").write_text("1, 2,\n3 ,x\n\n")
    assert sorted(r.concept_id for r in files.read_concept_list(spark, f"{tmp_path}/c.txt").collect()) == [1, 2, 3]
    (tmp_path / "s.txt").write_text("4 5\n6\n")
    assert [r.words for r in files.read_corpus(spark, f"{tmp_path}/s.txt").orderBy("words").collect()] == [["4", "5"], ["6"]]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "concept_id_1 long, name string")
    files.write_csv(df, f"{tmp_path}/c", single_file=True)
    assert files.read_pairs(spark, f"{tmp_path}/c").dtypes[0] == ("concept_id_1", "string") and len(list((tmp_path / "c").glob("part-*"))) == 1
    assert files.read_pairs(spark, f"{tmp_path}/c", "concept_id_1 long, name string").collect() == df.orderBy("concept_id_1").collect()
    with pytest.raises(Exception, match="already exists"):
        files.write_csv(df, f"{tmp_path}/c", mode="error")
    files.write_lines(df.select("name"), f"{tmp_path}/t", single_file=True)
    files.write_parquet(df, f"{tmp_path}/p")
    assert spark.read.text(f"{tmp_path}/t").count() == 2 and spark.read.parquet(f"{tmp_path}/p").count() == 2
    assert spark.createDataFrame([([1.5, 2.0],)], "v array<double>").select(files.vector_text("v")).first()[0] == "1.5,2.0"


def test_jobs_write_presets_and_cli_parses(spark, tmp_path):
    from conceptloom.adapters import retail
    from conceptloom.operators.events import join_domains

    sf = "/root/testdata/sf0.001"
    rows = join_domains(retail.domain_tables(spark, sf))
    jobs.write_cooccurrence(rows, retail.visits(spark, sf), 2001, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {f"cooccurrence_{n}" for n in ("5_year", "visit", "60", "180", "360", "lifetime")}
    args = cli.parser().parse_args(["sequences", "-i", "a", "-o", "b", "-t", "drug_exposure", "-v"])
    assert (args.visit, args.dimensions, args.epochs, args.start_year, args.window_size, args.sub_window_size) == (True, 200, 100, 1985, 60, 30)
