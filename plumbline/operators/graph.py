"""The property graph as tables of nodes and edges, derived in a few projections and one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ontology


def entity_key() -> Column:
    """vessel_imo_… for an IMO number above 0, else vessel_mmsi_…, else null: such records make no vessel."""
    return F.when(F.col("imo") > 0, F.concat(F.lit("vessel_imo_"), F.col("imo").cast("string"))).when(F.col("mmsi").isNotNull() & (F.col("mmsi") != 0), F.concat(F.lit("vessel_mmsi_"), F.col("mmsi").cast("string")))


def hashed(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.col(c)), 1, 12))


def port_key() -> Column:
    return F.when(F.coalesce("matchedPort_unlocode", F.lit("")) != "", F.concat(F.lit("port_"), F.col("matchedPort_unlocode"))).otherwise(hashed("port_", "matchedPort_name"))


def _filled(c: str) -> Column:
    """The value unless it is null, 0 or empty."""
    return F.when((F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0") & (F.col(c).cast("string") != "0.0"), F.col(c))


def colour(label: Column, status: Column) -> Column:
    """The colour in which a node is drawn (fixed values): vessels by status, ontology nodes, and all others."""
    return F.when((label == "Vessel") & (status == "invalid"), "#e74c3c").when(label == "Vessel", "#2ecc71").when(label == "Category", "#9b59b6").otherwise("#3498db")


def vessel_nodes(records: DataFrame, seq: str) -> DataFrame:
    """One row a vessel: the last filled value of changing properties and the first of lasting ones, in order of ``seq``."""
    rows = records.withColumn("node_id", entity_key()).where("node_id is not null")
    last = lambda c: F.max_by(c, F.when(_filled(c).isNotNull(), F.col(seq)))
    changing = {"name": "name", "length": "length", "width": "width", "gross_tonnage": "grossTonnage", "built_year": "builtYear", "flag": "flag", "vessel_type": "vessel_type"}
    return rows.groupBy("node_id").agg(F.min_by("imo", seq).alias("imo"), F.min_by("draught", seq).alias("draught"), *[last(c).alias(n) for n, c in changing.items()], F.count(F.lit(1)).alias("records"))


def value_nodes(records: DataFrame) -> DataFrame:
    """(node_id, label, value): IMO, MMSI, flag, builder, port and type nodes, each once; null or empty makes none."""
    text = lambda c: F.col(c).cast("string")
    kinds = [
        ("IMO", F.when(F.col("imo") > 0, F.concat(F.lit("imo_"), text("imo"))), text("imo")), ("MMSI", F.concat(F.lit("mmsi_"), text("mmsi")), text("mmsi")), ("Flag", F.concat(F.lit("flag_"), F.nullif("flag", F.lit(""))), F.col("flag")),
        ("ShipBuilder", hashed("builder_", "shipBuilder"), F.col("shipBuilder")), ("Port", port_key(), F.coalesce("matchedPort_unlocode", "matchedPort_name")), ("VesselType", hashed("type_", "vessel_type"), F.col("vessel_type")),
    ]
    each = F.array(*[F.struct(i.alias("node_id"), F.lit(label).alias("label"), v.alias("value")) for label, i, v in kinds])
    return records.where(entity_key().isNotNull()).select(F.explode(each).alias("n")).select("n.*").where("node_id is not null and value <> ''").distinct()


def ontology_nodes(spark) -> DataFrame:
    tree = ontology.tree(spark)
    return tree.select(hashed("category_", "category").alias("node_id"), F.lit("Category").alias("label"), F.col("category").alias("value")).unionByName(tree.select(hashed("type_", "type").alias("node_id"), F.lit("VesselType").alias("label"), F.col("type").alias("value"))).distinct()


def nodes(records: DataFrame) -> DataFrame:
    """(node_id, label, value) of all nodes: vessels, their values and the ontology."""
    vessels = records.select(entity_key().alias("node_id")).where("node_id is not null").distinct().select("node_id", F.lit("Vessel").alias("label"), F.col("node_id").alias("value"))
    return vessels.unionByName(value_nodes(records)).unionByName(ontology_nodes(records.sparkSession)).distinct()


#: Relations of which a vessel has one, the first that was stated.
LASTING = ("IS_TYPE", "BUILT_BY")


def record_edges(records: DataFrame, at: str, *keep: Column) -> DataFrame:
    """(src, dst, rel_type, ts): what each record says about its vessel; all relations come from one pass."""
    text = lambda c: F.col(c).cast("string")
    kinds = [
        ("HAS_IMO", F.when(F.col("imo") > 0, F.concat(F.lit("imo_"), text("imo")))), ("USES_MMSI", F.concat(F.lit("mmsi_"), text("mmsi"))), ("IS_TYPE", F.when(F.col("vessel_type") != "", hashed("type_", "vessel_type"))), ("REGISTERED_UNDER", F.concat(F.lit("flag_"), F.nullif("flag", F.lit("")))),
        ("BUILT_BY", F.when(F.col("shipBuilder") != "", hashed("builder_", "shipBuilder"))), ("VISITED", F.when((F.col("matchedPort_name") != "") & (F.col("matchedPort_unlocode") != ""), port_key())),
    ]
    each = F.array(*[F.struct(d.alias("dst"), F.lit(r).alias("rel_type")) for r, d in kinds])
    kept = [c.alias(f"_kept{k}") for k, c in enumerate(keep)]
    return records.select(entity_key().alias("src"), F.col(at).alias("ts"), *kept, F.explode(each).alias("e")).select("src", "e.dst", "e.rel_type", "ts", *[f"_kept{k}" for k in range(len(keep))]).where("src is not null and dst is not null")


def edges(records: DataFrame, at: str, seq: str) -> DataFrame:
    """The serving graph: time-stamped relations once for each time, lasting ones (type, builder) once a vessel, the first.

    One pass and one aggregation: the key of a lasting relation leaves its target and time open.
    """
    every = record_edges(records, at, F.col(seq))
    timed = ~F.col("rel_type").isin(*LASTING)
    keyed = every.withColumns({"_dst": F.when(timed, F.col("dst")), "_ts": F.when(timed, F.col("ts"))})
    first = keyed.groupBy("src", "rel_type", "_dst", "_ts").agg(F.min_by(F.struct("dst", "ts"), "_kept0").alias("f"))
    return first.select("src", "f.dst", "rel_type", "f.ts")


def category_edges(spark) -> DataFrame:
    tree = ontology.tree(spark)
    return tree.select(hashed("type_", "type").alias("src"), hashed("category_", "category").alias("dst"), F.lit("BELONGS_TO_CATEGORY").alias("rel_type"), F.lit(None).cast("timestamp_ntz").alias("ts"))


def write_graph(node_rows: DataFrame, edge_rows: DataFrame, folder: str) -> None:
    """Nodes by label and edges by relation, so that readers of one kind skip the rest; the folder is replaced."""
    node_rows.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edge_rows.write.mode("overwrite").partitionBy("rel_type").parquet(f"{folder}/edges")


def broken_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once; empty if the uniqueness constraint holds."""
    return rows.groupBy(*key).count().where("count > 1")


def neighbourhood(edge_rows: DataFrame, node_rows: DataFrame, vessels: DataFrame) -> DataFrame:
    """(src, rel_type, dst, label, value): edges out of ``vessels`` (column node_id) with the nodes they reach."""
    out = edge_rows.join(vessels.select(F.col("node_id").alias("src")), "src", "left_semi")
    return out.join(node_rows.select(F.col("node_id").alias("dst"), "label", "value"), "dst").select("src", "rel_type", "dst", "label", "value").distinct()


def reached_by(edge_rows: DataFrame, rel_type: str, dst: str) -> DataFrame:
    """(src, ts): reverse traversal of a relation into one node, a row for each edge."""
    return edge_rows.where((F.col("rel_type") == rel_type) & (F.col("dst") == dst)).select("src", "ts")


def with_type(vessels: DataFrame, edge_rows: DataFrame, limit: int | None = 2000) -> DataFrame:
    """(node_id, type_id, category_id): vessels with their type and its category where they have them; ``limit`` is the
    page size of an interactive view, in order of node_id; None gives all, in no order."""
    kind = edge_rows.where("rel_type = 'IS_TYPE'").select(F.col("src").alias("node_id"), F.col("dst").alias("type_id"))
    up = category_edges(vessels.sparkSession).select(F.col("src").alias("type_id"), F.col("dst").alias("category_id"))
    typed = vessels.select("node_id").join(kind, "node_id", "left").join(F.broadcast(up), "type_id", "left").select("node_id", "type_id", "category_id")
    return typed if limit is None else typed.orderBy("node_id").limit(limit)


def many_targets(edge_rows: DataFrame, rel_type: str, more_than: int) -> DataFrame:
    """(src, n): nodes that a relation leads to more than ``more_than`` different ones."""
    return edge_rows.where(F.col("rel_type") == rel_type).groupBy("src").agg(F.count_distinct("dst").alias("n")).where(F.col("n") > more_than)


def entities_of(records: DataFrame, key: str, at: str) -> DataFrame:
    """(key, entities): each record's vessel with the relations it states, as one list a record; no shuffle."""
    flat = lambda rel, dst: F.when(dst.isNotNull(), F.struct(F.lit(rel).alias("rel_type"), dst.alias("dst")))
    text = lambda c: F.col(c).cast("string")
    each = F.array_compact(F.array(flat("HAS_IMO", F.when(F.col("imo") > 0, F.concat(F.lit("imo_"), text("imo")))), flat("USES_MMSI", F.concat(F.lit("mmsi_"), text("mmsi"))), flat("REGISTERED_UNDER", F.concat(F.lit("flag_"), F.nullif("flag", F.lit("")))), flat("BUILT_BY", F.when(F.col("shipBuilder") != "", hashed("builder_", "shipBuilder"))), flat("IS_TYPE", F.when(F.col("vessel_type") != "", hashed("type_", "vessel_type")))))
    return records.select(key, F.struct(entity_key().alias("entity_id"), F.col(at).alias("ts"), each.alias("relations")).alias("entities"))


def statistics(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label and edges by relation."""
    return node_rows.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n").unionByName(edge_rows.groupBy(F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


def tree_counts(records: DataFrame) -> DataFrame:
    """(category, type, n): vessels of each type of the ontology, zero rows kept; type null is the category's total."""
    tree = ontology.tree(records.sparkSession)
    counted = records.where(F.col("vessel_type").isNotNull()).groupBy(F.col("vessel_type").alias("type")).agg(F.count(F.lit(1)).alias("k"))
    joined = F.broadcast(tree.select("category", "type")).join(counted, "type", "left")
    return joined.groupingSets([["category", "type"], ["category"]], "category", "type").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


FACETS = {"category": "category", "vessel_type": "vessel_type", "flag": "flag", "validation_status": "validation_status", "vessel_name": "name"}


def filtered(records: DataFrame, **selected: str | None) -> DataFrame:
    """Records that agree with every selected facet; None selects all."""
    for facet, value in selected.items():
        if value is not None:
            records = records.where(F.col(FACETS[facet]) == value)
    return records


def facets(records: DataFrame, names: tuple[str, ...] = tuple(FACETS), **selected: str | None) -> DataFrame:
    """(facet, choice): a row for each value that a facet still has after the selected ones; null and empty are left out."""
    rows = filtered(records, **selected)
    each = F.array(*[F.struct(F.lit(n).alias("facet"), F.nullif(F.col(FACETS[n]).cast("string"), F.lit("")).alias("choice")) for n in names])
    return rows.select(F.explode(each).alias("f")).select("f.*").where("choice is not null").distinct()


#: Graph names of the properties of a vessel's node, by column.
PROPERTIES = {
    "imo": "imo", "mmsi": "mmsi", "name": "name", "callsign": "callsign", "vessel_type": "vessel_type", "flag": "flag", "length": "length", "width": "width", "draught": "draught", "gross_tonnage": "grossTonnage", "deadweight": "deadweight",
    "built_year": "builtYear", "builder": "shipBuilder", "latitude": "last_position_latitude", "longitude": "last_position_longitude", "speed": "last_position_speed", "course": "last_position_course", "destination": "destination",
}


def vessel_properties(records: DataFrame, key: str) -> DataFrame:
    """(key, node_id, 18 properties, validation_status, validation_errors): each record as the node that it writes.

    ``records`` come from ``validate.with_status``. Records without vessel make no node.
    """
    return records.select(key, entity_key().alias("node_id"), *[F.col(c).alias(n) for n, c in PROPERTIES.items()], "validation_status", "validation_errors").where("node_id is not null")


def vessel_statistics(records: DataFrame, seq: str) -> DataFrame:
    """(kind, name, n): vessels in all, by the validation status of their last record, and by the type of it."""
    rows = records.withColumn("node_id", entity_key()).where("node_id is not null")
    last = rows.groupBy("node_id").agg(F.max_by("validation_status", seq).alias("status"), F.max_by("vessel_type", F.when(F.col("vessel_type") != "", F.col(seq))).alias("type"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("vessels", F.lit("total")), ("status", F.col("status")), ("type", F.col("type")))])
    return last.select(F.explode(each).alias("e")).select("e.*").where("name is not null").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def merged_nodes(written: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of a graph that is there with new ones merged in by node_id: new filled values replace, others stay."""
    other = [c for c in written.columns if c != "node_id"]
    more = new.select(F.col("node_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in other])
    both = written.join(more, F.col("node_id") == F.col("_id"), "full")
    return both.select(F.coalesce("node_id", "_id").alias("node_id"), *[F.coalesce(f"_{c}", c).alias(c) for c in other])
