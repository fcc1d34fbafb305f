"""Identity resolution: candidate pairs from shared keys, attribute similarity, match classes and learned parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import char_jaccard, closeness, name_similarity

#: Weights of the attributes (fixed values); other sets are passed as parameters.
WEIGHTS = {"imo": 0.30, "name": 0.20, "mmsi": 0.10, "length": 0.10, "width": 0.08, "gross_tonnage": 0.07, "built_year": 0.08, "builder": 0.07}
TOOL_WEIGHTS = {"imo": 0.30, "name": 0.20, "mmsi": 0.10, "length": 0.10, "width": 0.08, "gross_tonnage": 0.08, "built_year": 0.07, "builder": 0.07}
BASIC_WEIGHTS = {"name": 0.30, "imo": 0.25, "mmsi": 0.15, "length": 0.10, "width": 0.10, "built_year": 0.10}
COLUMNS = ("imo", "name", "mmsi", "length", "width", "grossTonnage", "builtYear", "shipBuilder")


def record_key(seq: str) -> Column:
    """The IMO number above 0, else the MMSI number, else the row's own key, as text."""
    return F.coalesce(F.nullif(F.col("imo"), F.lit(0)).cast("string"), F.col("mmsi").cast("string"), F.col(seq).cast("string"))


def _block_keys() -> Column:
    words = F.filter(F.split(F.upper(F.trim(F.coalesce("name", F.lit("")))), r"\s+"), lambda w: F.length(w) >= 3)
    return F.concat(
        F.array_compact(F.array(F.when(F.col("imo") > 0, F.concat(F.lit("i:"), F.col("imo").cast("string"))), F.when(F.col("mmsi").isNotNull(), F.concat(F.lit("m:"), F.col("mmsi").cast("string"))), F.concat(F.lit("t:"), F.col("vessel_type"), F.lit(":"), F.col("builtYear").cast("string")))),
        F.transform(F.array_distinct(words), lambda w: F.concat(F.lit("n:"), w)),
    )


def blocks(records: DataFrame, key: str) -> DataFrame:
    """(record, block): the keys that a record shares with possible partners: IMO, MMSI, each word of the name, and type
    with built year. Words of fewer than three letters don't block."""
    return records.select(F.col(key).alias("record"), F.explode(_block_keys()).alias("block"))


def candidate_pairs(records: DataFrame, key: str) -> DataFrame:
    """(a, b), a < b: records that share a block, each pair once; as many as the blocks hold, so for tables whose blocks
    are small. ``duplicates`` finds the pairs above its score without making all of these."""
    keyed = blocks(records, key)
    one, two = keyed.select("block", F.col("record").alias("a")), keyed.select("block", F.col("record").alias("b"))
    return one.join(two, "block").where("a < b").select("a", "b").distinct()


#: The overall score above which a pair counts as a duplicate (fixed value).
DUPLICATE = 0.85


def duplicates(records: DataFrame, key: str) -> DataFrame:
    """Every pair of ``candidate_pairs`` whose overall score by WEIGHTS is above DUPLICATE, classified.

    Blocks of words, of type and year, and of MMSI 0 are split by second keys that lose no such pair. Its loss, the sum
    of weight times (1 - score), is below 0.15 of the weights that can be compared, so:
    two different IMO numbers (0.30) are too much, and without them that weight is at most 0.70;
    two different MMSI numbers (0.10 of 0.105) leave nothing for a year that differs (0.08) or is missing (0.093 left);
    else, if no MMSI is compared, the year is the same, or missing on a side, or it differs (0.08 of 0.09), and then all
    the rest is there and lengths are within 0.5 %.
    So a pair shares an IMO or MMSI number, or a block and the year (y), or a block in which its two records together
    lack IMO, MMSI and year (b), or a block and a length (c) and together lack IMO and MMSI. What a record lacks is a set
    of bits in the key: a left row has its own, a right row one for each set that completes its own.
    """
    there = lambda c: F.coalesce(c, F.lit(False))
    no_imo, no_mmsi, no_year = (F.when(there(c), 0).otherwise(bit) for c, bit in ((F.col("imo") > 0, 1), (F.col("mmsi") != 0, 2), (F.col("builtYear") != 0, 4)))
    of_number = lambda k: k.startswith("i:") | (k.startswith("m:") & (k != "m:0"))
    keys = F.col("_keys")
    numbers, shared = F.filter(keys, of_number), F.filter(keys, lambda k: ~of_number(k))
    year, band = F.col("builtYear").cast("string"), F.floor(F.log(F.col("length")) / 0.0051)  # -ln(0.995) is less than a band

    def made(route: str, sets: Column, *second: Column) -> Column:
        return F.flatten(F.transform(sets, lambda q: F.transform(shared, lambda k: F.concat_ws("|", F.lit(route), q.cast("string"), *second, k))))

    def full(own: Column, whole: int) -> Column:
        return F.filter(F.array(*[F.lit(q) for q in range(whole + 1)]), lambda q: q.bitwiseOR(own) == whole)

    none = F.array().cast("array<string>")
    dated, measured = no_year == 0, (no_year == 0) & there(F.col("length") > 0)
    left = F.concat(numbers, F.when(dated, made("y", F.array(no_imo), year)).otherwise(none), made("b", F.array(no_imo + no_mmsi + no_year)), F.when(measured, made("c", F.array(no_imo + no_mmsi), band.cast("string"))).otherwise(none))
    near = F.concat(*[made("c", full(no_imo + no_mmsi, 3), (band + d).cast("string")) for d in (-1, 0, 1)])
    right = F.concat(numbers, F.when(dated, made("y", full(no_imo, 1), year)).otherwise(none), made("b", full(no_imo + no_mmsi + no_year, 7)), F.when(measured, near).otherwise(none))

    keyed = records.withColumn("_keys", _block_keys())
    numeric = [c for c in COLUMNS if c not in ("name", "shipBuilder")]

    def side(s: str, routes: Column) -> DataFrame:
        filled = [there(F.col(c) != "").alias(f"{s}_has_{c}") for c in ("name", "shipBuilder")]
        return keyed.select(F.explode(routes).alias("route"), F.col(key).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in numeric], *filled)

    # The best score that a pair can have, with texts taken as equal, drops most pairs before texts are compared.
    best = attribute_scores()
    for n, c in (("name", "name"), ("builder", "shipBuilder")):
        best[n] = F.when(F.col(f"a_has_{c}") & F.col(f"b_has_{c}"), F.lit(1.0))
    top = reduce(lambda x, y: x + y, [F.coalesce(best[n] * F.lit(w), F.lit(0.0)) for n, w in WEIGHTS.items()])
    weight = reduce(lambda x, y: x + y, [F.when(best[n].isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for n, w in WEIGHTS.items()])
    same = there((F.col("a_imo") > 0) & (F.col("a_imo") == F.col("b_imo")))
    pairs = side("a", left).join(side("b", right), "route").where((F.col("a") < F.col("b")) & (same | (top > weight * (DUPLICATE - 1e-9)))).select("a", "b").distinct()
    return classified(scored(side_by_side(pairs, records, key))).where(F.col("overall") > DUPLICATE)


def distinct_records(records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(representatives, membership): records with equal compared attributes as one, the least key standing for them."""
    by = [c for c in (*COLUMNS, "vessel_type") if c in records.columns]
    rep = records.groupBy(*by).agg(F.min(key).alias(key))
    same = reduce(lambda x, y: x & y, [records[c].eqNullSafe(rep[c]) for c in by])
    return rep, records.join(rep, same).select(records[key].alias("member"), rep[key].alias("representative"))


def side_by_side(pairs: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """``pairs`` (a, b) with the compared attributes of both, as a_ and b_ columns."""
    for side in "ab":
        one = records.select(F.col(key).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in COLUMNS])
        pairs = pairs.join(one, side)
    return pairs


def _pair(c: str) -> tuple[Column, Column]:
    return F.col(f"a_{c}"), F.col(f"b_{c}")


def attribute_scores(tolerance: float = 0.05, names: str = "full") -> dict[str, Column]:
    """Score of each attribute of a pair, null where it can't be compared. ``names``: full, or chars for characters only."""

    def equal(c: str, positive: bool) -> Column:
        a, b = _pair(c)
        there = (a > 0) & (b > 0) if positive else (a.isNotNull() & b.isNotNull() & (a != 0) & (b != 0))
        return F.when(there, (a == b).cast("double"))

    def alike(c: str) -> Column:
        a, b = _pair(c)
        score = name_similarity(a, b) if names == "full" else F.bround(char_jaccard(F.upper(a), F.upper(b), False), 4)
        return F.when((a != "") & (b != ""), score)

    near = lambda c: closeness(*_pair(c), tolerance)
    return {"imo": equal("imo", True), "name": alike("name"), "mmsi": equal("mmsi", False), "length": near("length"), "width": near("width"), "gross_tonnage": near("grossTonnage"), "built_year": equal("builtYear", False), "builder": alike("shipBuilder")}


def _four(c: Column) -> Column:
    """Four places, half up; noise of the last bits is rounded off first, so that a tie is one in any engine."""
    return F.round(F.round(c, 10), 4)


def scored(pairs: DataFrame, weights: dict[str, float] = WEIGHTS, tolerance: float = 0.05, names: str = "full", conflict: float = 0.3) -> DataFrame:
    """Pairs side by side with ``scores`` (map), ``overall``, ``confidence``, ``matching`` and ``conflicting``.

    The overall score is the weighted mean over what can be compared; confidence is reduced by what cannot. An IMO number
    that both share decides alone.
    """
    each = attribute_scores(tolerance, names)
    df = pairs.withColumns({f"s_{n}": c for n, c in each.items()})
    s = {n: F.col(f"s_{n}") for n in each}
    top = reduce(lambda x, y: x + y, [F.coalesce(s[n] * F.lit(w), F.lit(0.0)) for n, w in weights.items()])
    weight = reduce(lambda x, y: x + y, [F.when(s[n].isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for n, w in weights.items()])
    seen = reduce(lambda x, y: x + y, [s[n].isNotNull().cast("int") for n in weights])
    exact = F.coalesce((F.col("a_imo") > 0) & (F.col("a_imo") == F.col("b_imo")), F.lit(False))
    overall = F.coalesce(F.try_divide(top, weight), F.lit(0.0))
    parts = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in s.items()])
    df = df.withColumns({
        "exact": exact, "overall": F.when(exact, F.lit(1.0)).otherwise(_four(overall)), "confidence": F.when(exact, F.lit(1.0)).otherwise(_four(overall * seen / len(weights))),
        "scores": F.map_from_entries(F.filter(parts, lambda p: p["value"].isNotNull())),
        "matching": F.array_compact(F.array(*[F.when(c > 0.9, F.lit(n)) for n, c in s.items()])), "conflicting": F.array_compact(F.array(*[F.when(c < conflict, F.lit(n)) for n, c in s.items()])),
    })
    return df.drop(*[f"s_{n}" for n in each])


def classified(pairs: DataFrame, high: float = 0.9, probable: float = 0.6, uncertain: float = 0.3) -> DataFrame:
    """Scored pairs with ``match_type``, ``same_entity``, ``needs_review`` and ``evidence``."""
    o = F.col("overall")
    kind = F.when(F.col("exact"), "exact_imo_match").when(o >= high, "high_confidence").when(o >= probable, "probable_match").when(o >= uncertain, "uncertain").otherwise("no_match")
    (ai, bi), (am, bm) = _pair("imo"), _pair("mmsi")
    clash = F.coalesce((ai > 0) & (bi > 0) & (ai != bi), F.lit(False)) & am.eqNullSafe(bm)
    review = ~F.col("exact") & (kind.isin("probable_match", "uncertain") | clash)
    listed = lambda c, t: F.when(F.size(c) > 0, F.concat(F.lit(t), F.concat_ws(", ", c)))
    evidence = F.array_compact(F.array(F.concat(F.lit("Resolution type: "), kind), F.format_string("Overall similarity: %.2f%%", o * 100), F.format_string("Confidence: %.2f%%", F.col("confidence") * 100), F.when(F.col("exact"), F.concat(F.lit("IMO match: "), ai.cast("string"))), listed("matching", "Matching attributes: "), listed("conflicting", "Conflicting attributes: ")))
    return pairs.withColumns({"match_type": kind, "same_entity": F.col("exact") | (o >= probable), "needs_review": review, "evidence": evidence})


def review_priority() -> Column:
    """0.5, more for uncertain pairs, for two IMO numbers, and for different IMO numbers on one MMSI number; at most 1."""
    (ai, bi), (am, bm) = _pair("imo"), _pair("mmsi")
    both = F.coalesce((ai > 0) & (bi > 0), F.lit(False))
    clash = F.coalesce(ai != bi, F.lit(False)) & am.eqNullSafe(bm)
    return F.bround(F.least(F.lit(1.0), F.lit(0.5) + F.when(F.col("match_type") == "uncertain", 0.2).otherwise(0.0) + F.when(both, 0.15).otherwise(0.0) + F.when(clash, 0.25).otherwise(0.0)), 4)


def score_bins(pairs: DataFrame, score: str, same: Column) -> DataFrame:
    """(bin, total, same, different): decisions by tenth of the score."""
    return pairs.where(F.col(score).isNotNull()).groupBy((F.floor(F.col(score) * 10) / 10.0).alias("bin")).agg(F.count(F.lit(1)).alias("total"), F.count_if(same).alias("same"), F.count_if(~same).alias("different"))


def learned_thresholds(pairs: DataFrame, score: str, same: Column) -> DataFrame:
    """(high, review): the score at the lower tenth of the same pairs, and midway between the least same and the largest
    different one; null unless both kinds are there. Exact percentile by rank on counted scores, not on rows."""
    counts = pairs.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("x"), same.alias("same")).count()
    agg = counts.agg(F.sum(F.when(F.col("same"), F.col("count"))).alias("n"), F.min(F.when(F.col("same"), F.col("x"))).alias("low"), F.max(F.when(~F.col("same"), F.col("x"))).alias("top"))
    from pyspark.sql import Window as W

    ranked = counts.where("same").withColumn("upto", F.sum("count").over(W.orderBy("x")))
    high = ranked.join(F.broadcast(agg), F.col("upto") > F.floor(F.lit(0.1) * F.col("n"))).agg(F.min("x").alias("high"))
    both = F.col("low").isNotNull() & F.col("top").isNotNull()
    return high.crossJoin(agg).select(F.when(both, F.col("high")).alias("high"), F.when(both, (F.col("low") + F.col("top")) / 2).alias("review"))  # one row each


def learned_weights(pairs: DataFrame, scores: str, same: Column) -> DataFrame:
    """(attribute, weight): how far the mean scores of same and different pairs lie apart, scaled to sum 1."""
    from pyspark.sql import Window as W

    long = pairs.select(same.alias("same"), F.explode(scores).alias("attribute", "score"))
    gap = long.groupBy("attribute").agg(F.abs(F.avg(F.when(F.col("same"), F.col("score"))) - F.avg(F.when(~F.col("same"), F.col("score")))).alias("gap")).where("gap is not null")
    return gap.select("attribute", F.bround(F.try_divide("gap", F.sum("gap").over(W.partitionBy())), 4).alias("weight"))


def similar_decisions(queue: DataFrame, decided: DataFrame, recent: int = 100, band: float = 0.1, most: int = 5) -> DataFrame:
    """For each queued pair (id, score) the ``most`` surest of the last ``recent`` decisions (decision_id, score,
    confidence, decided_at) within ``band`` of its score. The decisions' side is ``recent`` rows, so it is broadcast."""
    from pyspark.sql import Window as W

    last = decided.orderBy(F.col("decided_at").desc(), F.col("decision_id").desc()).limit(recent).select("decision_id", "decision", F.col("score").alias("past_score"), "confidence")
    near = queue.join(F.broadcast(last), F.abs(F.col("score") - F.col("past_score")) < band)
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("confidence").desc(), "decision_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most)


def suggested_decision(similar: DataFrame) -> DataFrame:
    """(id, decision, share): the most frequent decision among similar ones, ties by name."""
    from pyspark.sql import Window as W

    n = similar.groupBy("id", "decision").count()
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("count").desc(), "decision"))
    return n.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy("id"))).withColumn("rank", rank).where("rank = 1").select("id", "decision", F.bround("share", 4).alias("share"))
