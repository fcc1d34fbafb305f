import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.plans import cypher, language
from plumbline.plans import query as q
from tests.test_records import fleet


def test_filters_and_order(spark):
    df = fleet(spark)
    ids = lambda *f, **k: [x["record_id"] for x in q.run(df, q.Query(filters=tuple(q.Filter(*x) for x in f), **k)).collect()]
    assert ids(("flag", "neq", "LR"), ("imo", "neq", 9074729)) == ["2", "4"]
    assert ids(("name", "contains", "a")) == ["1", "2", "3"] and ids(("name", "contains", ".")) == [] and ids(("name", "matches", "^.ARCO")) == ["1", "2"]
    assert ids(("length", "between", (200.0, 250.0))) == ["1"] and ids(("flag", "in", ["HK"])) == ["3", "4"]
    assert ids(sort_by="length", ascending=False, limit=3) == ["3", "1", "2"] and ids(sort_by="length", offset=1, limit=2) == ["3", "2"]
    assert ids(since=dt.datetime(2024, 1, 2), until=dt.datetime(2024, 1, 3)) == ["2", "3"]
    with pytest.raises(ValueError):
        ids(("nothing", "eq", 1))
    assert q.run(df, q.Query(filters=(q.Filter("nothing", "eq", 1),)), ignore_unknown=True).count() == 4
    assert [tuple(x) for x in q.run(df, q.Query("aggregate", group_by="flag")).collect()] == [("HK", 2), ("LR", 1), ("MH", 1)]
    assert q.free_text(df, "m").count() == 0 and q.free_text(df, "mar").count() == 2 and q.free_text(df, "9074729").count() == 1
    assert q.run(df, q.history_of(9528574)).where("attribute = 'flag'").count() == 2


def test_filters_reach_the_scan(spark, tmp_path):
    fleet(spark).write.parquet(str(tmp_path / "v"))
    df = q.run(spark.read.parquet(str(tmp_path / "v")), q.Query(filters=(q.Filter("flag", "eq", "HK"),), columns=("record_id",)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(flag,HK)" in plan and "ReadSchema: struct<record_id:string,flag:string>" in plan


def test_cypher(spark):
    df = fleet(spark)
    run = lambda s: [tuple(x) for x in cypher.cypher(df, s).collect()]
    assert run("MATCH (v:Vessel)-[:IS_TYPE]->(vt:VesselType) RETURN vt.name AS type, COUNT(*) AS n ORDER BY n DESC") == [("Dry Bulk", 2), ("Container", 1)]
    assert run("MATCH (v:Vessel) WHERE v.flag = 'HK' AND v.imo IS NULL OR v.properties.built_year < 2008 RETURN v.record_id AS id ORDER BY id") == [("3",), ("4",)]
    assert run("MATCH (v:Vessel) WHERE v.gross_tonnage > 100000000\nRETURN COUNT(*) AS n,\n AVG(v.gross_tonnage) AS a") == [(0, None)]
    assert run("MATCH (v:Vessel) RETURN DISTINCT v.flag AS f ORDER BY f DESC SKIP 1 LIMIT 1") == [("LR",)]
    assert run("MATCH (v:Vessel) WHERE NOT v.name CONTAINS 'mar' RETURN v.name ORDER BY v.gross_tonnage LIMIT 1") == [("ASIA",)]
    assert run("MATCH (v:Vessel) RETURN SUM(v.gross_tonnage) AS s, MIN(v.built_year) AS lo, MAX(v.built_year) AS hi, COUNT(v.imo) AS c") == [(171000.0, 2005, 2010, 3)]
    for bad in ("MATCH (v:Vessel) RETURN x.name", "MATCH (v:Vessel) RETURN v.name LIMIT 1 nonsense", "RETURN 1", "MATCH (v:Vessel)-[:OWNS]->(x:Owner) RETURN v.name"):
        with pytest.raises(ValueError):
            cypher.cypher(df, bad)
    assert cypher.predefined(df, "any flagship?").count() == 1 and cypher.predefined(df, "hello") is None


@pytest.mark.parametrize("text, kind, filters", [
    ("What is vessel IMO 9528574?", "identifier", [("imo", "eq", 9528574)]), ("history of IMO 9528574", "history", [("imo", "eq", 9528574)]), ("vessel using MMSI 636013854", "identifier", [("mmsi", "eq", 636013854)]),
    ("show vessels under flag PA", "attributes", [("flag", "eq", "PA")]), ("flag changes in the last 5 years", "changes", []), ("reflagged vessels", "changes", []), ("all tanker vessels", "attributes", [("vessel_type", "contains", "tanker")]),
    ("find vessel named Ocean Dawn", "attributes", [("name", "contains", "Ocean Dawn")]), ("9528574", "identifier", [("imo", "eq", 9528574)]), ("636013854 please", "identifier", [("mmsi", "eq", 636013854)]),
])
def test_language(text, kind, filters):
    got = language.parse(text)
    assert got.kind == kind and [(f.column, f.op, f.value) for f in got.filters] == filters


def test_answers_and_tools(spark):
    df = fleet(spark)
    assert language.parse("hm") is None
    got = language.answer(df, "IMO 9528574")
    assert len(got.rows) == 2 and got.confidence == 0.4 and "MARCO" in got.text
    assert language.answer(df, "IMO 1234567").text == "No data matches."
    tools = language.standard_tools(df)
    assert tools.call("search_by_name", name="asia").count() == 1 and len(tools.calls) == 1
    with pytest.raises(KeyError):
        tools.call("nothing")
    assert language.ranked_list([{"name": str(i), "imo": i} for i in range(12)], "name").endswith("… and 2 more")


def test_details(spark):
    df = fleet(spark).withColumns({"deadweight": F.lit(1234567.0), "last_position_latitude": F.lit(1.5), "last_position_longitude": F.lit(2.25)})
    assert "Deadweight: 1,234,567 t\nBuilt: 2010\nPosition: 1.5000, 2.2500" in language.details(df).first()["details"]


def test_stream(spark, tmp_path):
    from plumbline.sources.vessels import SCHEMA
    from plumbline.streaming import validation

    rows = spark.createDataFrame([(9074729, 636013854), (0, None)], "imo long, mmsi long")
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(dt.datetime(2024, 5, 1)).cast("timestamp_ntz") if f.name == "UpdateDate" else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])
    full.write.parquet(str(tmp_path / "in"))
    out = validation.failures_per_window(validation.read_records(spark, str(tmp_path / "in")), dt.datetime(2024, 6, 1))
    stream = out.writeStream.format("memory").queryName("failures").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert sorted(tuple(x)[1:] for x in spark.table("failures").collect()) == [("invalid", 1), ("valid", 1)]
