"""Questions in plain English to structured queries, grounded answers, and the registry of callable tools."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans import query as q

#: Words that name a type (fixed values).
_TYPES = ("container", "tanker", "bulk", "cargo", "passenger", "fishing", "tug", "lng", "lpg", "reefer", "ro-ro", "chemical")
_CODE = r"\b([A-Za-z]{2})\b"


def parse(text: str) -> q.Query | None:
    """A query for the text, or None. Specific families come before general ones: history, flag changes, identifiers,
    flag, type, then names and bare numbers."""
    low = text.strip().lower()
    imo, mmsi = re.search(r"\bimo\s*(\d{7})\b", low), re.search(r"\bmmsi\s*(\d{9})\b", low)
    if imo and re.search(r"\b(histor|track|changes)", low):
        return q.history_of(int(imo[1]))
    if re.search(r"\bchanged flag\b|\bflag changes?\b|\breflagged\b", low):
        years = re.search(r"(?:last|past) (\d+) years?", low)
        return q.Query("changes", options={"years": int(years[1]) if years else None})
    if imo:
        return q.by_imo(int(imo[1]))
    if mmsi:
        return q.by_mmsi(int(mmsi[1]))
    flag = re.search(r"\bflag[: ]\s*" + _CODE + r"(?!\w)", text, re.I) or re.search(_CODE + r" flag(?:ged)?\b", text, re.I) or re.search(r"\bvessels from ([A-Z]{2})\b", text)
    if flag and flag[1].lower() not in ("in", "of", "is", "by", "no"):
        return q.by_flag(flag[1])
    kind = next((t for t in _TYPES if re.search(rf"\b{t}s?\b", low)), None)
    if kind and re.search(r"\bvessels?\b|\bships?\b|\btype\b", low):
        return q.Query("attributes", (q.Filter("vessel_type", "contains", kind),))
    name = re.search(r"\b(?:named|called)\s+[\"']?([\w .-]+?)[\"']?\s*$", text, re.I) or re.search(r"\b(?:find|search for|show(?: me)?)\s+(?:vessels?\s+)?[\"']?([\w .-]+?)[\"']?\s*$", text, re.I)
    if name and not re.fullmatch(r"[\d\s]+", name[1]):
        return q.by_name(name[1].strip())
    seven, nine = re.search(r"\b(\d{7})\b", text), re.search(r"\b(\d{9})\b", text)
    return q.by_imo(int(seven[1])) if seven else q.by_mmsi(int(nine[1])) if nine else None


@dataclass
class Answer:
    text: str
    confidence: float
    rows: list[dict]
    sources: list[str] = field(default_factory=list)


def ranked_list(rows: list[dict], label: str, shown: int = 10) -> str:
    lines = [f"{i + 1}. {r.get(label) or 'unnamed'} (IMO {r.get('imo')})" for i, r in enumerate(rows[:shown])]
    return "\n".join(lines + ([f"… and {len(rows) - shown} more"] if len(rows) > shown else []))


def details(df: DataFrame) -> DataFrame:
    """``df`` with ``details``: one text a vessel with the lines that it has values for."""
    line = lambda t, c, f="%s": F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}: "), F.format_string(f, F.col(c))))
    number = lambda t, c, unit: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}: "), F.format_number(c, 0), F.lit(unit)))
    # By way of five places, half up: no engine's rounding of binary fractions shows.
    four = lambda c: F.col(c).cast("decimal(10, 5)").cast("decimal(9, 4)").cast("string")
    both = F.concat(F.lit("Position: "), four("last_position_latitude"), F.lit(", "), four("last_position_longitude"))
    return df.withColumn("details", F.concat_ws("\n", line("Name", "name"), line("IMO", "imo", "%d"), line("MMSI", "mmsi", "%d"), line("Flag", "flag"), line("Type", "vessel_type"), number("Gross tonnage", "grossTonnage", " GT"), number("Deadweight", "deadweight", " t"), line("Built", "builtYear", "%d"), both))


def answer(df: DataFrame, text: str, most: int = 100) -> Answer:
    """A grounded answer: at most ``most`` rows come to the caller, and the text says nothing that they don't.

    Confidence is a fifth for each of up to five sources; no result is certain.
    """
    parsed = parse(text)
    if parsed is None:
        return Answer("Try an IMO or MMSI number, a name, a flag or a vessel type.", 0.0, [])
    found = [r.asDict(recursive=True) for r in q.run(df, parsed, ignore_unknown=True).limit(most).collect()]
    if not found:
        return Answer("No data matches.", 1.0, [])
    sources = sorted({str(r.get("record_id") or r.get("entity_id")) for r in found})[:10]
    return Answer(f"{len(found)} found:\n" + ranked_list(found, "name"), min(1.0, len(sources) / 5), found, sources)


@dataclass
class Tools:
    """Named functions over one dataset, with the time and result size of each call."""

    functions: dict[str, Callable[..., Any]] = field(default_factory=dict)
    calls: list[dict] = field(default_factory=list)

    def register(self, name: str, function: Callable[..., Any]) -> None:
        self.functions[name] = function

    def call(self, name: str, /, **arguments: Any) -> Any:
        if name not in self.functions:
            raise KeyError(f"no tool {name}; there are {sorted(self.functions)}")
        began = time.time()
        result = self.functions[name](**arguments)
        self.calls.append({"tool": name, "arguments": arguments, "seconds": time.time() - began})
        return result


def standard_tools(df: DataFrame) -> Tools:
    from plumbline.operators import quality, validate
    from plumbline.plans import cypher

    tools = Tools()
    tools.register("search_by_imo", lambda imo: q.run(df, q.by_imo(imo)))
    tools.register("search_by_mmsi", lambda mmsi: q.run(df, q.by_mmsi(mmsi)))
    tools.register("search_by_name", lambda name: q.run(df, q.by_name(name)))
    tools.register("vessel_history", lambda imo: q.run(df, q.history_of(imo)))
    tools.register("aggregate", lambda group_by=None: q.run(df, q.Query("aggregate", group_by=group_by)))
    tools.register("identifier_conflicts", lambda: quality.identifier_conflicts(df))
    tools.register("anomaly_score", lambda: validate.anomaly_score(df))
    tools.register("cypher", lambda statement: cypher.cypher(df, statement))
    return tools
