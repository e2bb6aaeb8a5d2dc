"""The census job end to end on fixture files."""

import pytest
from pyspark.sql import functions as F

from ribeira import fixed
from ribeira.operators.dissolve import multipart_stats
from ribeira.operators.quality import ExpectationError
from ribeira.plans import census
from ribeira.plans.census import publish_census_origins, run_census_origins
from ribeira.session import materialize
from ribeira.sources.delimited import read_demography, scan_delimited
from ribeira.sources.publication import Run, committed_runs, published_path, row_metrics

SECTORS = (
    "id BIGINT, CD_SETOR STRING, CD_MUN STRING, NM_MUN STRING, SITUACAO STRING, CD_SIT STRING, CD_TIPO STRING, "
    "AREA_KM2 DOUBLE, v0001 DOUBLE, geom_wkb BINARY, crs STRING"
)


def line(key, total, male, female, age="1"):
    return ";".join(["extra", key, str(total), str(male), str(female), *[age] * len(fixed.FEMALE_AGE_GROUPS)])


def demography_file(folder, *lines):
    path = folder / "demography.csv"
    path.write_text("\n".join([";".join(["NOTE", fixed.DEMOGRAPHY_KEY, *fixed.MEASURES]), *lines]) + "\n", encoding="utf-8")
    return str(path)


def sector(number, key, basic=1.0, municipality="1500107", name="Abaetetuba", part="p", situation="Urbana", crs="EPSG:4674"):
    return (number, key, municipality, name, situation, "1", "0", 2.5, basic, bytearray(part, "ascii"), crs)


GOOD = [line("150000000000001", 10, 4, 6), line("150000000000002", 10, 4, ""), line("160000000000001", 7, 3, 4), line("", 7, 3, 4)]


def sectors(spark, *extra):
    rows = [
        sector(1, "150000000000001", part="a"), sector(2, "150000000000001", part="b"), sector(3, "150000000000002"),
        sector(4, "150000000000003", basic=0.0, municipality="1500206", name="Acará"), *extra,
    ]
    return spark.createDataFrame(rows, SECTORS)


def test_scan_reads_named_columns_as_text(spark, tmp_path):
    path = demography_file(tmp_path, line("150000000000003", "X", 4, 6))
    assert scan_delimited(spark, path, ["V01006", "CD_setor"]).collect() == [("X", "150000000000003")]
    row = read_demography(spark, path).first()
    assert (row["V01006"], row["V01007"], row["V01030"]) == (None, 4.0, 1.0)


def test_whole_job(spark, tmp_path):
    out = str(tmp_path / "out")
    audits = run_census_origins(spark, sectors(spark), demography_file(tmp_path, *GOOD), out)
    assert audits["demography"]["rows"] == 2 and audits["demography"]["missing_part"] == 1
    assert audits["spatial"] == {
        "source_features": 4, "unique_geometry_sectors": 3, "multipart_extra_features": 1, "output_sectors": 3,
        "municipalities": 2, "geometry_only_zero_population_sectors": 1, "female_population_unavailable_sectors": 1,
        "female_population_observed": 6, "crs": "EPSG:4674",
    }
    origins = {r["CD_SETOR"]: r for r in spark.read.parquet(f"{out}/origins").collect()}
    assert [origins[f"15000000000000{i}"]["population_data_status"] for i in (1, 2, 3)] == [
        fixed.STATUS_OBSERVED, fixed.STATUS_UNAVAILABLE, fixed.STATUS_LEFT_ONLY,
    ]
    zero = origins["150000000000003"]
    assert (zero["V01006"], zero["V01007"], zero["V01008"], zero["V01020"]) == (0.0, 0.0, 0.0, None)
    assert origins["150000000000002"]["female_population"] is None
    assert not {"_merge", "demography_key", "id"} & set(spark.read.parquet(f"{out}/origins").columns)
    assert spark.read.parquet(f"{out}/parts").groupBy("CD_SETOR").count().filter("count = 2").count() == 1
    summary = spark.read.csv(f"{out}/summary", header=True)
    assert summary.columns == fixed.SUMMARY_COLUMNS and summary.count() == 3
    assert spark.read.json(f"{out}/audit").first()["output_sectors"] == 3


def expect(spark, tmp_path, features, lines, message):
    out = tmp_path / "out"
    with pytest.raises(ExpectationError, match=message):
        run_census_origins(spark, features, demography_file(tmp_path, *lines), str(out))
    assert not out.exists()


@pytest.mark.parametrize("basic", [5.0, None])
def test_left_only_sectors_need_basic_population_zero(spark, tmp_path, basic):
    expect(spark, tmp_path, sectors(spark, sector(9, "150000000000009", basic=basic)), GOOD, "basic population 0: 1")


@pytest.mark.parametrize("change", [{"name": "Other"}, {"situation": None}])
def test_conflicting_features_raise(spark, tmp_path, change):
    features = sectors(spark, sector(9, "150000000000002", part="z", **change))
    expect(spark, tmp_path, features, GOOD, "features of a sector agree: 1")


def test_demography_rules(spark, tmp_path):
    expect(spark, tmp_path, sectors(spark), GOOD[2:], "has rows: 1")
    expect(spark, tmp_path, sectors(spark), [GOOD[0], GOOD[0]], "keys are unique: 1")
    expect(spark, tmp_path, sectors(spark), [line("150000000000001", 10, 4, 5)], "total = male [+] female: 1")


def test_checks_read_no_table_again(spark, tmp_path, monkeypatch):
    """Every intermediate table is read by the step that follows; demography and grouped sectors once, origins by its sinks."""
    tables = {}

    def noted(df, name):
        table = materialize(df, name)
        tables[name] = table.inputFiles()[0].split("/part-")[0]
        return table

    monkeypatch.setattr(census, "materialize", noted)
    run_census_origins(spark, sectors(spark), demography_file(tmp_path, *GOOD), str(tmp_path / "out"))
    assert set(tables) == {"demography", "sectors", "origins"}
    people, grouped = (spark.read.parquet(tables[name]) for name in ("demography", "sectors"))
    plan = census.label_sectors(grouped, people, census.SectorColumns(), demography_is_unique=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_publication_is_a_unit(spark, tmp_path, monkeypatch):
    out, path = str(tmp_path / "out"), demography_file(tmp_path, *GOOD)
    with pytest.raises(LookupError):
        published_path(spark, out, "origins")
    with monkeypatch.context() as patch:
        patch.setattr(census, "write_summary", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            publish_census_origins(spark, sectors(spark), path, out, "2022")
    assert committed_runs(spark, out).count() == 0  # origins and parts were staged, and can't be read
    with pytest.raises(LookupError):
        published_path(spark, out, "origins")
    assert publish_census_origins(spark, sectors(spark), path, out, "2022")
    assert not publish_census_origins(spark, sectors(spark), path, out, "2022")
    assert publish_census_origins(spark, sectors(spark).limit(3), path, out, "2022.b")
    first, second = committed_runs(spark, out).orderBy("committed_at").collect()
    assert {t["name"]: t["rows"] for t in first["tables"]} == {"origins": 3, "parts": 4, "summary": 3, "audit": 1}
    assert {t["name"]: t["rows"] for t in second["tables"]}["origins"] == 2 and first["figures"]["output_sectors"] == "3"
    assert spark.read.parquet(published_path(spark, out, "origins", "2022")).count() == 3
    assert spark.read.parquet(published_path(spark, out, "origins")).count() == 2
    with pytest.raises(LookupError):
        published_path(spark, out, "nothing")
    with pytest.raises(ValueError):
        Run(spark, out, "../other")


def test_digests_tell_tables_apart(spark):
    def digest(*rows):
        df = spark.createDataFrame(list(rows), "a INT, b STRING, m MAP<STRING, DOUBLE>").repartition(3)
        return tuple(df.agg(*row_metrics(df)).first())

    one, two = (1, None, {"x": 1.0, "y": 2.0}), (None, "1", None)
    assert digest(one, two) == digest(two, (1, None, {"y": 2.0, "x": 1.0})) != digest(one, one)
    assert digest(one) != digest((1, "", {"x": 1.0, "y": 2.0})) and digest() == (0, 0)


# Figures of the published audit of the 2022 census sectors of one state.
PUBLISHED = {
    "source_features": 18_635, "unique_geometry_sectors": 16_714, "multipart_extra_features": 1_921, "output_sectors": 16_714,
    "municipalities": 144, "geometry_only_zero_population_sectors": 649, "female_population_unavailable_sectors": 486,
    "female_population_observed": 4_065_139, "crs": "EPSG:4674",
}
DEMOGRAPHY_ROWS, MULTIPART, MOST_PARTS = 16_065, 248, 247


def test_job_at_published_volume(spark, tmp_path):
    """Sectors laid out so that every published count holds; the audit has to find them all."""
    observed = DEMOGRAPHY_ROWS - PUBLISHED["female_population_unavailable_sectors"]
    each, rest = divmod(PUBLISHED["female_population_observed"], observed)
    # Sector 0 has the most parts; the other multipart sectors share what is left.
    share, more = divmod(PUBLISHED["multipart_extra_features"] - (MOST_PARTS - 1), MULTIPART - 1)
    extra = F.when(F.col("n") == 0, MOST_PARTS - 1).when(F.col("n") < MULTIPART, share + F.when(F.col("n") <= more, 1).otherwise(0)).otherwise(0)
    sectors = spark.range(PUBLISHED["output_sectors"]).withColumnRenamed("id", "n").withColumn(
        "CD_SETOR", F.concat(F.lit("15"), F.lpad(F.col("n").cast("string"), 13, "0"))
    )
    features = sectors.withColumn("id", F.explode(F.sequence(F.lit(0), extra))).select(
        "id",
        "CD_SETOR",
        F.concat(F.lit("15"), F.lpad((F.col("n") % PUBLISHED["municipalities"]).cast("string"), 5, "0")).alias("CD_MUN"),
        *[F.lit(v).alias(c) for c, v in {"NM_MUN": "n", "SITUACAO": "s", "CD_SIT": "1", "CD_TIPO": "0", "AREA_KM2": 1.0}.items()],
        F.when(F.col("n") < DEMOGRAPHY_ROWS, 1.0).otherwise(0.0).alias("v0001"),
        F.concat_ws("/", "n", "id").cast("binary").alias("geom_wkb"),
        F.lit("EPSG:4674").alias("crs"),
    )
    female = F.when(F.col("n") < observed, each + F.when(F.col("n") < rest, 1).otherwise(0))
    people = sectors.filter(F.col("n") < DEMOGRAPHY_ROWS).select(
        F.col("CD_SETOR").alias(fixed.DEMOGRAPHY_KEY), (female + 250).alias("V01006"), F.lit(250).alias("V01007"), female.alias("V01008"),
        *[F.lit("X").alias(age) for age in fixed.FEMALE_AGE_GROUPS],
    )
    people.write.csv(str(tmp_path / "demography"), sep=";", header=True)
    out = str(tmp_path / "out")
    audits = run_census_origins(spark, features, str(tmp_path / "demography"), out)
    assert audits["spatial"] == PUBLISHED
    assert audits["demography"]["rows"] == DEMOGRAPHY_ROWS and audits["demography"]["missing_part"] == 486
    stats = multipart_stats(features, "CD_SETOR").first()
    assert (stats["multipart_keys"], stats["max_parts"]) == (MULTIPART, MOST_PARTS)
    status = {r["population_data_status"]: r["count"] for r in spark.read.parquet(f"{out}/origins").groupBy("population_data_status").count().collect()}
    assert status == {fixed.STATUS_OBSERVED: 15_579, fixed.STATUS_UNAVAILABLE: 486, fixed.STATUS_LEFT_ONLY: 649}
    assert spark.read.parquet(f"{out}/parts").count() == PUBLISHED["source_features"]
