"""Evaluation passages inside a corpus, found by greedy string tiling.

Rolling hashes of the passages' word windows (Karp-Rabin) seed the matches; every seed is checked word by word. Of the
matches between a document and a passage the longest that overlaps none marked before is marked, again and again, so that
passages whose parts were reordered are still covered.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of passages that one index holds; more passages are searched in further blocks. About 100 bytes a word.
BLOCK_WORDS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MARKS = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def plain(text: str) -> str:
    """The text without case, accents and characters that have no width."""
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text.casefold()))


def words(text: str) -> list[str]:
    """Runs of letters and digits of the plain text."""
    return _WORD.findall(plain(text))


@dataclass
class Index:
    """Windows of ``size`` words of passages: sorted hashes with the passage and position of each."""

    size: int
    codes: dict[str, int] = field(default_factory=dict)
    passages: list[np.ndarray] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)

    def add(self, item: int, text: str) -> int:
        found = words(text)
        self.ids.append(item)
        self.passages.append(np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in found], dtype=np.int64))
        return len(found)

    def finish(self) -> Index:
        rng = np.random.default_rng(7)
        self.numbers = np.concatenate([[0], rng.integers(1, 2**63, len(self.codes), dtype=np.uint64)]).astype(np.uint64)
        hashes, where = [], []
        for k, p in enumerate(self.passages):
            h = rolling(self.numbers[p], self.size)
            hashes.append(h)
            where.append(np.column_stack([np.full(len(h), k), np.arange(len(h))]))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.where = (np.concatenate(where) if where else np.zeros((0, 2), np.int64))[order]
        return self


def rolling(numbers: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each window: a difference of prefix sums, moved back to its start."""
    if len(numbers) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(numbers), _BASE, np.uint64))
        back = np.cumprod(np.full(len(numbers), _INVERSE, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(numbers * powers, dtype=np.uint64)])
        return (sums[size:] - sums[:-size]) * back[: len(numbers) - size + 1]


def tiles(document: np.ndarray, passage: np.ndarray, seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document start, passage start, length) of at least ``size`` words; ties go to the earliest start."""
    runs = []
    ends: dict[int, int] = {}  # diagonal -> document position up to which it is covered by a run
    for i, j in sorted(seeds):
        if ends.get(i - j, -1) > i or not np.array_equal(document[i : i + size], passage[j : j + size]):
            continue
        n = size
        while i + n < len(document) and j + n < len(passage) and document[i + n] == passage[j + n] != 0:
            n += 1
        while i > 0 and j > 0 and document[i - 1] == passage[j - 1] != 0:
            i, j, n = i - 1, j - 1, n + 1
        ends[i - j] = i + n
        runs.append((n, i, j))
    used_d, used_p = np.zeros(len(document), bool), np.zeros(len(passage), bool)
    out = []
    while runs:
        runs.sort(key=lambda r: (-r[0], r[1], r[2]))
        n, i, j = runs.pop(0)
        free = ~(used_d[i : i + n] | used_p[j : j + n])
        if free.all():
            out.append((i, j, n))
            used_d[i : i + n] = True
            used_p[j : j + n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        runs += [(int(b - a), i + int(a), j + int(a)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= size]
    return out


def search(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(number of text, item, words covered, words of the passage, longest tile, tiles) for each text with a seed."""
    get, coded, starts, at = index.codes.get, [], [], 0
    for t in texts:
        starts.append(at)
        # Words become numbers one by one, so that a long text needs 8 bytes a word.
        one = np.fromiter((get(m.group(), 0) for m in _WORD.finditer(plain(t))), np.int64) if t else np.zeros(0, np.int64)
        coded.append(one)
        at += len(one) + 1
    flat = np.zeros(at, np.int64)
    for s, one in zip(starts, coded, strict=True):
        flat[s : s + len(one)] = one
    h = rolling(index.numbers[flat], index.size)
    if not len(h) or not len(index.hashes):
        return []
    whole = np.convolve(flat == 0, np.ones(index.size, int), "valid") == 0
    low = np.searchsorted(index.hashes, h)
    hit = np.flatnonzero(whole & (index.hashes[np.minimum(low, len(index.hashes) - 1)] == h))
    seeds: dict[tuple[int, int], list[tuple[int, int]]] = {}
    first = np.array(starts)
    for i in hit.tolist():
        d = int(np.searchsorted(first, i, "right")) - 1
        k = int(low[i])
        while k < len(index.hashes) and index.hashes[k] == h[i]:
            p, j = index.where[k]
            seeds.setdefault((d, int(p)), []).append((i - starts[d], int(j)))
            k += 1
    out = []
    for (d, p), where in seeds.items():
        passage = index.passages[p]
        found = tiles(coded[d], passage, where, index.size)
        if found:
            out.append((d, index.ids[p], sum(n for *_, n in found), len(passage), max(n for *_, n in found), len(found)))
    return out


def leaked(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = 12, block_words: int = BLOCK_WORDS, least_share: float = 0.0) -> DataFrame:
    """(doc_id, item_id, covered, passage_words, longest, tiles) for each document and item sharing ``size`` words in a row.

    The corpus is scanned once for each block of items, without a shuffle; the index of a block, whose words are bounded
    by ``block_words`` (plus one item), goes to the executors. Null and blank texts, and items shorter than ``size``
    words, match nothing. Rows of equal doc_id or item_id count once each pair, by the largest cover. ``least_share`` keeps
    pairs whose tiles together cover at least that share of the passage, in whatever order its parts stand.
    """
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"{doc_id} {kinds[0]}, {item_id} {kinds[1]}, covered long, passage_words long, longest long, tiles long"
    docs = documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, text)
    found = None

    def scan(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(index.finish()))

        def run(batches):
            here = cloudpickle.loads(shared.value)
            for pdf in batches:
                # Long texts go in parts of the batch, so that codes of a few million words are held at once.
                texts, ids = pdf[text].tolist(), pdf[doc_id].tolist()
                a = 0
                while a < len(texts):
                    b, n = a, 0
                    while b < len(texts) and (b == a or n < 8_000_000):
                        n += len(texts[b])
                        b += 1
                    rows = search(texts[a:b], here)
                    yield pd.DataFrame([(ids[a + r[0]], *r[1:]) for r in rows], columns=[doc_id, item_id, "covered", "passage_words", "longest", "tiles"])
                    a = b

        return docs.mapInPandas(run, schema)

    index, held = Index(size), 0
    for row in items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(item_id, item_text).distinct().toLocalIterator():
        held += index.add(row[0], row[1])
        if held >= block_words:
            part, index, held = scan(index), Index(size), 0
            found = part if found is None else found.unionByName(part)
    if index.ids or found is None:
        part = scan(index)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("covered", "longest", "tiles", "passage_words")).alias("b")
    pairs = found.groupBy(doc_id, item_id).agg(best).select(doc_id, item_id, "b.covered", "b.passage_words", "b.longest", "b.tiles")
    return pairs.where(F.col("covered") >= least_share * F.col("passage_words"))
