import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import ontology, text
from plumbline.operators import graph, quality, resolve, temporal, validate
from plumbline.plans import records as plans
from plumbline.sources import vessels

AS_OF = dt.datetime(2024, 6, 1)


def one(spark, column, **values):
    kinds = {int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("imo, error", [(9074729, None), (9528574, None), (9528575, "IMO checksum failed. Expected check digit: 4, got: 5"), (1000000, "IMO checksum failed. Expected check digit: 7, got: 0"), (0, "IMO number cannot be 0"), (12345, "IMO must be 7 digits (1000000-9999999), got: 12345"), ("abc", "IMO must be numeric, got: abc"), (None, "IMO number is missing")])
def test_imo(spark, imo, error):
    assert one(spark, validate.imo_error(F.col("imo")), imo=imo) == error


@pytest.mark.parametrize("mmsi, top, ok", [(636013854, 800, True), (123456789, 800, False), (12345, 800, False), (790000000, 800, True), (790000000, 775, False), (None, 800, False)])
def test_mmsi(spark, mmsi, top, ok):
    assert (one(spark, validate.mmsi_error(F.col("mmsi"), top), mmsi=mmsi) is None) == ok


RECORD = "record_id string, imo long, mmsi long, name string, last_position_latitude double, last_position_longitude double, last_position_updateTimestamp timestamp_ntz, staticData_updateTimestamp timestamp_ntz, grossTonnage double, length double, builtYear int"


def test_null_island_breaks_two_rules_and_scores(spark):
    df = spark.createDataFrame([("a", 0, 636013854, "!@#$", 0.0, 0.0, AS_OF, dt.datetime(2020, 1, 1), 1.0, 1.0, 2000), ("b", 9074729, 636013854, "GOOD", None, None, None, dt.datetime(2024, 6, 3), None, None, None)], RECORD)
    rules = validate.standard_rules(AS_OF)
    bad = {(x["record_id"], x["rule_id"]) for x in validate.long_results(df, rules, "record_id").where("not is_valid").collect()}
    assert bad == {("a", "RULE_IMO_001"), ("a", "RULE_GEO_LAST_POSITION_LATITUDE"), ("a", "RULE_GEO_LAST_POSITION_LONGITUDE"), ("a", "RULE_TS_STATICDATA_UPDATETIMESTAMP"), ("b", "RULE_TS_STATICDATA_UPDATETIMESTAMP")}
    scores = {x["record_id"]: (x["anomaly_score"], x["anomaly_flags"]) for x in validate.anomaly_score(df).collect()}
    assert scores == {"a": (0.8, ["zero_imo", "garbled_name", "null_island"]), "b": (0.0, [])}
    summary = {x["rule_id"]: (x["total"], x["passed"], x["failed"]) for x in validate.summary_by_rule(validate.long_results(df, rules, "record_id")).collect()}
    assert summary["ALL"] == (18, 13, 5) and summary["RULE_IMO_001"] == (2, 1, 1)
    status = {x["record_id"]: x["validation_errors"] for x in validate.with_status(df, rules).collect()}
    assert status["a"].startswith('["IMO number cannot be 0","Coordinates (0,0)')


def test_name_similarity(spark):
    s = lambda a, b: one(spark, text.name_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert s("MARCO", "MARCO POLO") == 0.6857 and s(" marco", "MARCO ") == 1.0 and s(None, "X") == 0.0 and s("", "X") == 0.0
    assert s("MARCO", "MARKO") == s("MARKO", "MARCO") == 0.2667


def test_pair_score_and_review(spark):
    base = "record_id string, imo long, name string, mmsi long, length double, width double, grossTonnage double, builtYear int, shipBuilder string, vessel_type string"
    rows = spark.createDataFrame([("a", 9528574, "MARCO", 636013854, 225.0, None, None, None, None, "Tug"), ("b", 9528575, "MARKO", 636013854, 226.0, None, None, None, None, "Tug"), ("c", 9528574, "MARCO POLO", None, None, None, None, None, None, None), ("d", None, None, None, None, None, None, None, None, None)], base)
    pairs = resolve.candidate_pairs(rows, "record_id")
    assert {tuple(x) for x in pairs.collect()} == {("a", "b"), ("a", "c")}
    done = resolve.classified(resolve.scored(resolve.side_by_side(pairs, rows, "record_id"))).withColumn("priority", resolve.review_priority())
    got = {(x["a"], x["b"]): x for x in done.collect()}
    ab, ac = got["a", "b"], got["a", "c"]
    assert (ab["overall"], ab["confidence"], ab["match_type"], ab["same_entity"], ab["needs_review"], ab["priority"]) == (0.3493, 0.1746, "uncertain", False, True, 1.0)
    assert (ac["overall"], ac["match_type"], ac["same_entity"], ac["needs_review"]) == (1.0, "exact_imo_match", True, False)
    rep, members = resolve.distinct_records(rows.unionByName(rows.where("record_id = 'd'").withColumn("record_id", F.lit("e"))), "record_id")
    assert rep.count() == 4 and members.where("representative = 'd'").count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicates_are_all_candidates_above_the_score(spark, seed):
    r = random.Random(seed)
    some = lambda *values: r.choice([None, *values])
    base = "record_id string, imo long, name string, mmsi long, length double, width double, grossTonnage double, builtYear int, shipBuilder string, vessel_type string"
    rows = []
    for k in range(400):  # a hot word in most names, values close enough that each way of being alike occurs
        imo, mmsi = some(None, 0, 9528574, 9528575), some(None, 0, 1, 2, 3)
        name = r.choice(["STAR", "OCEAN STAR", "OCEAN STAR", "STAR OF", "", None, "MOON"])
        rows.append((f"{k:03}", imo, name, mmsi, some(100.0, 100.0, 100.3, 100.6, 104.0), some(20.0, 20.1), some(5000.0, 5010.0), some(0, 2001, 2002), some("YARD A", "YARD B"), some("Tug")))
    df = spark.createDataFrame(rows, base)
    every = resolve.scored(resolve.side_by_side(resolve.candidate_pairs(df, "record_id"), df, "record_id")).where(F.col("overall") > resolve.DUPLICATE)
    want = {(x["a"], x["b"], x["overall"]) for x in every.collect()}
    got = [(x["a"], x["b"], x["overall"]) for x in resolve.duplicates(df, "record_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    by = {x[0]: x for x in rows}
    differ = lambda a, b, c: bool(by[a][c] and by[b][c] and by[a][c] != by[b][c])
    assert any(differ(a, b, 3) for a, b, _ in want) and any(differ(a, b, 7) and not (by[a][1] and by[b][1]) for a, b, _ in want)


def test_duplicates_outside_the_listed_pairs(spark, tmp_path):
    fleet(spark).withColumn("record_id", F.concat(F.lit("x"), "record_id")).write.parquet(str(tmp_path / "vessel_records.parquet"))
    assert {(x["a"], x["b"]) for x in plans.r_duplicates(spark, str(tmp_path)).collect()} == {("x1", "x2")}


def test_learning(spark):
    rows = spark.createDataFrame([(i / 20, i > 10, {"x": i / 20, "y": 0.5}) for i in range(20)], "overall double, same boolean, scores map<string,double>")
    t = resolve.learned_thresholds(rows, "overall", F.col("same")).first()
    assert t["high"] == 0.55 and abs(t["review"] - 0.525) < 1e-9
    assert {x["attribute"]: x["weight"] for x in resolve.learned_weights(rows, "scores", F.col("same")).collect()} == {"x": 1.0, "y": 0.0}
    assert resolve.learned_thresholds(rows.where("same"), "overall", F.col("same")).first()["high"] is None
    queue = spark.createDataFrame([(1, 0.52)], "id long, score double")
    past = rows.select(F.col("overall").alias("score"), F.col("overall").alias("confidence"), F.col("overall").alias("decided_at"), F.col("overall").alias("decision_id"), F.col("same").cast("string").alias("decision"))
    similar = resolve.similar_decisions(queue, past)
    assert {x["decision_id"] for x in similar.collect()} == {0.45, 0.5, 0.55, 0.6} and tuple(resolve.suggested_decision(similar).first()) == (1, "false", 0.5)  # a tie: by name


@pytest.mark.parametrize("kind, category", [("Crude Tanker", "Tanker Vessels"), ("tug boat", "Service Vessels"), ("zzz", "Other"), (None, ""), ("nan", ""), (" ", "")])
def test_category(spark, kind, category):
    assert one(spark, ontology.category_of(F.col("k")), k=kind) == category


GRAPH = "record_id string, imo long, mmsi long, name string, flag string, shipBuilder string, vessel_type string, matchedPort_name string, matchedPort_unlocode string, length double, width double, grossTonnage double, builtYear int, draught double, UpdateDate timestamp_ntz"


def fleet(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    rows = [
        ("1", 9528574, 636013854, "MARCO", "LR", "Yard A", "Dry Bulk", "Port A", "AAAAA", 225.0, 32.0, 40000.0, 2010, 10.0, t(1)),
        ("2", 9528574, 538005889, "MARCO", "MH", "Yard A", "Dry Bulk", "Port B", "BBBBB", None, 0.0, 41000.0, 2010, 11.0, t(2)),
        ("3", 9074729, 477123456, "ASIA", "HK", "Yard B", "Container", "Port C", "CCCCC", 300.0, 40.0, 90000.0, 2005, 12.0, t(3)),
        ("4", None, None, "GHOST", "HK", None, None, None, None, None, None, None, None, None, t(4)),
    ]
    return spark.createDataFrame(rows, GRAPH).withColumn("callsign", F.lit(None).cast("string"))


def test_graph(spark):
    df = fleet(spark)
    kinds = {x["label"]: x["count"] for x in graph.value_nodes(df).groupBy("label").count().collect()}
    assert kinds == {"IMO": 2, "MMSI": 3, "Flag": 3, "ShipBuilder": 2, "Port": 3, "VesselType": 2}
    edges = graph.edges(df, "UpdateDate", "record_id")
    assert {x["rel_type"]: x["count"] for x in edges.groupBy("rel_type").count().collect()} == {"HAS_IMO": 3, "USES_MMSI": 3, "REGISTERED_UNDER": 3, "BUILT_BY": 2, "VISITED": 3, "IS_TYPE": 2}
    v = {x["node_id"]: x for x in graph.vessel_nodes(df, "record_id").collect()}
    assert set(v) == {"vessel_imo_9528574", "vessel_imo_9074729"}
    m = v["vessel_imo_9528574"]
    assert (m["length"], m["width"], m["gross_tonnage"], m["draught"], m["records"]) == (225.0, 32.0, 41000.0, 10.0, 2)
    assert graph.broken_keys(graph.nodes(df), "node_id").count() == 0
    ends = edges.join(graph.nodes(df).select(F.col("node_id").alias("dst")), "dst", "left_anti")
    assert ends.count() == 0
    tree = {(x["category"], x["type"]): x["n"] for x in graph.tree_counts(df).collect()}
    assert tree["Cargo Vessels", "Dry Bulk"] == 2 and tree["Cargo Vessels", None] == 2 and tree["Naval Vessels", "Naval Vessel"] == 0 and len(tree) == 59 + 11


def test_tree_query_is_whole(spark, tmp_path):
    fleet(spark).write.parquet(str(tmp_path / "vessel_records.parquet"))
    tree = {(x["category"], x["type"]): x["n"] for x in plans.o_tree_counts(spark, str(tmp_path)).collect()}
    assert set(tree) == {(c, t) for c, types in ontology.CATEGORIES.items() for t in [*types, None]}
    assert tree["Container Vessels", "Container"] == 1 and tree["Cargo Vessels", None] == 2 and tree["Gas Carriers", None] == 0


def test_typed_vessels_are_all_there(spark, tmp_path):
    rows = spark.range(1, 2102).select(*[(F.col("id").cast("string") if f == "record_id" else F.col("id") if f == "imo" else F.lit("Tug") if f == "vessel_type" else F.lit(None)).cast(k).alias(f) for f, k in (x.split() for x in GRAPH.split(", "))])
    rows.write.parquet(str(tmp_path / "vessel_records.parquet"))
    typed = plans.g_typed_vessels(spark, str(tmp_path))
    assert typed.count() == 2101 and typed.where("type_id is null or category_id is null").count() == 0
    edges = graph.edges(rows, "UpdateDate", "record_id")
    assert graph.with_type(graph.vessel_nodes(rows, "record_id"), edges).count() == 2000


def test_graph_is_written_by_kind(spark, tmp_path):
    df = fleet(spark)
    graph.write_graph(graph.nodes(df), graph.edges(df, "UpdateDate", "record_id"), str(tmp_path / "g"))
    graph.write_graph(graph.nodes(df), graph.edges(df, "UpdateDate", "record_id"), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).where("rel_type = 'VISITED'").count() == 3
    assert (tmp_path / "g/nodes/label=Flag").is_dir()


def test_time(spark):
    obs = temporal.observations(fleet(spark), {"flag": "flag", "mmsi": "mmsi"}, "UpdateDate", "record_id")
    runs = temporal.islands(obs)
    assert {tuple(x)[:3] for x in temporal.changes(runs, "flag").collect()} == {("vessel_imo_9528574", "LR", "MH")}
    at = {(x["entity_id"], x["attribute"]): x["value"] for x in temporal.state_at(temporal.intervals(obs), dt.datetime(2024, 1, 1, 12)).collect()}
    assert at == {("vessel_imo_9528574", "flag"): "LR", ("vessel_imo_9528574", "mmsi"): "636013854"}
    same = spark.createDataFrame([("e", "flag", v, dt.datetime(2024, 1, n), str(n)) for n, v in enumerate("AABBB", 1)], "entity_id string, attribute string, value string, ts timestamp_ntz, seq string")
    c = temporal.canonical(temporal.islands(same), ("flag",)).first()
    assert (c["value"], c["confidence"]) == ("B", 1.0)
    nested = temporal.canonical_entities(temporal.islands(same)).first()
    assert nested["current"] == {"flag": "B"} and [x["value"] for x in nested["history"]["flag"]] == ["A", "B"]
    probes = spark.createDataFrame([("e", dt.datetime(2024, 1, 2, 1)), ("e", dt.datetime(2023, 1, 1)), ("e", dt.datetime(2025, 1, 1))], "entity_id string, probe_ts timestamp_ntz")
    assert sorted(x["seq"] for x in temporal.states_for(temporal.intervals(same), probes).collect()) == ["2", "5"]


def test_hot_entities_give_the_same_states(spark):
    import random

    r = random.Random(8)
    rows = [(r.choice("eeef"), r.choice(["flag", "name"]), r.choice("AAB"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randint(0, 90)), f"{i:04d}") for i in range(600)]
    obs = spark.createDataFrame(rows, "entity_id string, attribute string, value string, ts timestamp_ntz, seq string")
    for f in (temporal.intervals, temporal.timeline, temporal.islands):
        whole, cut = (sorted(map(tuple, f(obs, "time", n).collect()), key=str) for n in (10**6, 40))
        assert whole == cut and len(whole) > 100
    runs = temporal.islands(obs, "time", 40)
    assert runs.agg(F.sum("n")).first()[0] == 600
    assert temporal.islands(obs, "arrival").agg(F.sum("n")).first()[0] == 600


def test_quality(spark):
    df = fleet(spark)
    assert {tuple(x)[:2] for x in quality.identifier_conflicts(df).collect()} == {("imo_to_mmsi", 9528574)}
    assert [tuple(x) for x in quality.duplicate_key_report(df).orderBy("key_name").collect()] == [("imo", 1, 2), ("mmsi", 0, 0), ("name", 1, 2)]
    assert quality.exact_duplicates(df.unionAll(df)).first()[0] == 4
    odd = spark.createDataFrame([(1, "AB"), (1, "XYZ"), (1, "ABC"), (2, None)], "imo long, name string")
    assert {tuple(x)[1:3] for x in quality.suspicious_name_changes(odd).collect()} == {("AB", "XYZ"), ("ABC", "XYZ")}
    assert quality.garbled_names(spark.createDataFrame([("OK 1",), ("Ä",), ("12 !",), (None,)], "name string")).count() == 2
    empty = df.limit(0)
    assert quality.column_profile(empty, ["imo"]).first()["null_pct"] == 0.0 and quality.variation(empty, "imo", ["mmsi"]).count() == 0


def test_reports_have_every_column(spark, tmp_path):
    rows = fleet(spark).withColumn("deadYear", F.when(F.col("record_id") == "1", 2020))
    rows.write.parquet(str(tmp_path / "vessel_records.parquet"))
    profile = {x["column_name"]: x for x in plans.a_column_profile(spark, str(tmp_path)).collect()}
    assert set(profile) == set(rows.columns) and (profile["deadYear"]["n_null"], profile["UpdateDate"]["n_distinct"]) == (3, 4)
    missing = plans.a_missing_report(spark, str(tmp_path)).collect()
    assert len(missing) == len(rows.columns) and (missing[0]["column_name"], missing[0]["null_pct"], missing[1]["column_name"], missing[1]["null_pct"]) == ("callsign", 100.0, "deadYear", 75.0)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "v.csv").write_text("imo,mmsi,name,length,UpdateDate,odd\n9074729,636013854.0,STAR,NaN,2024-01-02 03:04:05,z\nx,, ,12.5,yesterday,\n")
    df = vessels.read_csv(spark, str(tmp_path / "v.csv"))
    a, b = df.orderBy("record_index").collect()
    assert (a["imo"], a["mmsi"], a["name"], a["length"], a["UpdateDate"]) == (9074729, 636013854, "STAR", None, dt.datetime(2024, 1, 2, 3, 4, 5))
    assert (b["imo"], b["mmsi"], b["name"], b["length"], b["UpdateDate"]) == (None, None, None, 12.5, None)
    vessels.write_csv(df.drop("record_index"), str(tmp_path / "out"))
    assert vessels.read_csv(spark, str(tmp_path / "out")).drop("record_index").exceptAll(df.drop("record_index")).count() == 0
    assert vessels.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "v.csv")]).endswith("v.csv")
    assert len(vessels.as_json_rows(df, 1)) == 1
    vessels.save_config({"a": {"b": 2}, "c": 3}, str(tmp_path / "c.json"))
    assert vessels.load_config(str(tmp_path / "c.json"), {"a": {"b": 1, "d": 4}}) == {"a": {"b": 2, "d": 4}, "c": 3}
    bad = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,)], "x double")
    assert sorted(x[0] is None for x in vessels.sanitised(bad).collect()) == [False, True, True]


def test_inspect(spark):
    got = {x["column_name"]: x for x in vessels.inspect(fleet(spark)).collect()}
    assert (got["length"]["low"], got["length"]["high"], got["flag"]["kinds"], got["flag"]["sample"]) == (225.0, 300.0, 3, ["HK", "LR", "MH"])
    assert {x["domain"] for x in vessels.column_domains(fleet(spark)).collect()} >= {"identifier", "static", "other"}


def test_inspect_query_is_whole(spark, tmp_path):
    rows = fleet(spark)
    rows.write.parquet(str(tmp_path / "vessel_records.parquet"))
    got = {x["column_name"]: x for x in plans.s_inspect(spark, str(tmp_path)).collect()}
    assert set(got) == set(rows.columns)
    assert (got["flag"]["kinds"], got["flag"]["sample"]) == (3, "HK,LR,MH") and (got["length"]["rows"], got["length"]["mean"]) == (4, 262.5)
    assert (got["UpdateDate"]["kinds"], got["UpdateDate"]["sample"][:19]) == (4, "2024-01-01 00:00:00") and got["callsign"]["sample"] is None
