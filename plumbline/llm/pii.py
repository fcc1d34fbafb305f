"""Personal information in free text: a linear-chain conditional random field over word shapes.

Tokens are runs of letters, runs of digits and single signs. What a token looks like (its word, if the labelled table
knows it, and its shape) votes for labels at its own place and at its neighbours'; pairs of labels vote for each
other. The field is trained here from the labelled table, and decoded by Viterbi over batches of texts in numpy: the
votes of each distinct token are added up once a batch, so that text costs table look-ups only.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import labelled

TYPES = ("NAME", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS")
LABELS = ("O", *[f"{p}-{t}" for t in TYPES for p in "BI"])
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: Tokens and what lies between them: its matches make up the whole text.
_PIECE = re.compile(r"[^\W\d_]+|\d+|\s+|[\W_]")
#: Endings of words that name a street (fixed values).
STREETS = ("straße", "strasse", "gasse", "weg")
#: Places, seen from a token, at which another's word and shape count.
WORD_AT, SHAPE_AT = range(-5, 6), range(-4, 5)
#: Characters decoded at once, and characters above which a text is decoded in parts.
BATCH_CHARS, PART_CHARS = 400_000, 1_000_000


def tokens(text: str) -> tuple[list[str], list[int], list[int], list[int]]:
    """Tokens, their starts and ends, and the kind of gap before each: 0 none, 1 blank, 2 line break."""
    words, starts, ends, gaps, last = [], [], [], [], 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        gaps.append(0 if a == last and a else 2 if a == 0 or "\n" in text[last:a] else 1)
        words.append(m.group())
        starts.append(a)
        ends.append(b)
        last = b
    return words, starts, ends, gaps


def in_capitals(text: str) -> bool:
    """Whether all letters of a text are capitals, markup aside: its words then tell nothing by being so."""
    return text.isupper() or ("<" in text and regex.sub(r"<[^<>]*>", "", text).isupper())


#: Put before the words of a text in capitals, which have shapes of their own.
CAPS = "\0"


def shape(word: str) -> str:
    if word[0] == CAPS:
        return f"U{min(len(word) - 1, 5)}"
    if word.isdigit() or word.isnumeric():
        return f"9{min(len(word), 12)}"
    if not word.isalpha():
        return word
    if word.isupper():
        return f"X{min(len(word), 5)}"
    if word.islower():
        return "x" if len(word) == 1 else "xx"
    return "Xx" if word[0].isupper() and word[1:].islower() else "xX"


class Field:
    """Weights: one row of votes for each (place, feature), votes of gaps, and of label pairs."""

    def __init__(self, vocabulary: set[str]):
        self.vocabulary = vocabulary
        self.features: dict[str, int] = {}
        self.shapes: dict[str, int] = {"": 0}  # 0: not seen in training

    def describe(self, word: str, grow: bool) -> tuple[list[int], list[int]]:
        """Features that count at all of WORD_AT, and at all of SHAPE_AT (-1 for none) with the number of the shape."""
        low = word.lower().removeprefix(CAPS)
        street = low.endswith(STREETS) and low not in self.vocabulary
        kind = shape(word)
        seen = self.shapes.setdefault(kind, len(self.shapes)) if grow else self.shapes.get(kind, 0)
        names = ("w" + low if low in self.vocabulary else "", "s" + kind, "street" if street else "")
        found = [(self.features.setdefault(n, len(self.features)) if grow else self.features.get(n, -1)) if n else -1 for n in names]
        return found[:1], [*found[1:], seen]

    def arrays(self, texts: list[str], grow: bool = False):
        """Token types of all texts in a row with their gaps, the row's start of each text, and spans of tokens."""
        types: dict[str, int] = {}
        ids, gaps, starts, ends, first = [], [], [], [], [0]
        for t in texts:
            w, a, b, g = tokens(t)
            w = [CAPS + x if x.isalpha() else x for x in w] if in_capitals(t) else w
            ids += [types.setdefault(x, len(types)) for x in w]
            gaps += g
            starts.append(a)
            ends.append(b)
            first.append(len(ids))
        described = [self.describe(w, grow) for w in types]
        word = np.array([d[0] for d in described], dtype=np.int64).reshape(-1, 1)
        form = np.array([d[1] for d in described], dtype=np.int64).reshape(-1, 3)
        return np.array(ids, np.int64), np.array(gaps, np.int64), np.array(first), word, form, starts, ends

    def start(self) -> None:
        n, k = len(self.features), len(LABELS)
        # A vote a place, then those that count anywhere to the left, and to the right; the last row stays 0: no feature.
        self.votes = np.zeros((len(WORD_AT) + 2, n + 1, k))
        self.gap = np.zeros((3, 3, k))
        self.joint = np.zeros((2, len(self.shapes) * 3 * len(self.shapes), k))  # shape, gap, shape: before and behind
        self.pair = np.zeros((k, k))

    def score(self, ids, gaps, first, word, form) -> np.ndarray:
        """Votes for each label of each token. Texts don't see each other."""
        total = np.zeros((len(ids), len(LABELS)))
        size = np.diff(first)
        pos = np.arange(len(ids)) - np.repeat(first[:-1], size)
        rest = np.repeat(size, size) - pos
        for k, at in enumerate(WORD_AT):
            table = self.votes[k][word[:, 0]]
            if at:
                table = table + self.votes[_side(at)][word[:, 0]]
            if at in SHAPE_AT:
                table = table + self.votes[k][form[:, :2]].sum(1)
            ok = (pos + at >= 0) & (rest - at > 0)
            where = np.flatnonzero(ok)
            total[where] += table[ids[where + at]]
        for k, at in enumerate((0, 1, -1)):
            ok = np.flatnonzero((pos + at >= 0) & (rest - at > 0))
            total[ok] += self.gap[k][gaps[ok + at]]
        for k, (code, ok) in enumerate(self.joints(ids, gaps, pos, form)):
            total[ok] += self.joint[k][code]
        return total

    def joints(self, ids, gaps, pos, form):
        """For the joint with the token before, and behind: its number and the tokens that have one."""
        later = np.flatnonzero(pos > 0)
        kinds, n = form[:, 2], len(self.shapes)
        code = (kinds[ids[later - 1]] * 3 + gaps[later]) * n + kinds[ids[later]]
        return (code, later), (code, later - 1)


def _side(at: int) -> int:
    """The row of votes for words anywhere to the left of a token, or to its right."""
    return len(WORD_AT) + (at > 0)


def _allowed() -> np.ndarray:
    """Label pairs that may follow each other: a piece goes on only within its type."""
    k = len(LABELS)
    ok = np.ones((k, k), bool)
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y[0] == "I" and x[2:] != y[2:]:
                ok[a, b] = False
    return ok


def _padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a (texts, longest) grid and which of its places are filled."""
    size = np.diff(first)
    longest = int(size.max()) if len(size) else 0
    grid = first[:-1, None] + np.arange(longest)[None, :]
    filled = np.arange(longest)[None, :] < size[:, None]
    return np.where(filled, grid, 0), filled


def decode(score: np.ndarray, sizes: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Best label of every token (Viterbi), all texts side by side: ``score`` is (place, text, label), texts in order of
    their ``sizes``. Labels beyond a text's end are 0."""
    longest, n, k = score.shape
    may = np.where(_allowed(), pair, -1e9).T.astype(score.dtype)  # from the label before (last axis) to the next one
    opening = np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS], score.dtype)
    out = np.zeros((longest, n), np.int8)
    if not longest or not n:
        return out
    live = np.searchsorted(sizes, np.arange(longest), "right")  # texts before this one have ended
    best = score[0] + opening
    back = np.zeros((longest, n, k), np.int8)
    for t in range(1, longest):
        a = live[t]
        step = best[a:, None, :] + may
        came = step.argmax(2)
        back[t, a:] = came
        best[a:] = np.take_along_axis(step, came[:, :, None], 2)[:, :, 0] + score[t, a:]
    label = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = live[t]
        out[t, a:] = label[a:]
        if t:
            label[a:] = back[t, np.arange(a, n), label[a:]]
    return out


class _Types(dict):
    """Numbers of tokens, given when first seen; 0 is no token."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n


class Decoder:
    """A field made ready for text: what each distinct token votes for is added up once and kept for later batches."""

    #: Distinct tokens that are kept; beyond that the table starts anew.
    MOST = 200_000

    def __init__(self, field: Field):
        self.field = field
        k = len(LABELS)
        self.pair = field.pair
        self.gap = np.concatenate([field.gap, np.zeros((3, 1, k))], 1).astype(np.float32)  # gap 3: outside the text
        self.joint = np.concatenate([field.joint, np.zeros((2, 1, k))], 1).astype(np.float32)  # the last: no pair
        self.word_votes = field.votes.astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.types = _Types()
        self.table = np.zeros((len(WORD_AT), 1024, len(LABELS)), np.float32)
        self.kind = np.zeros(1024, np.int64)
        self.space = np.zeros(1024, np.int8)

    def learn(self) -> None:
        """Add the tokens seen for the first time to the tables."""
        new = self.types.new
        if not new:
            return
        start, need = len(self.types) - len(new) + 1, len(self.types) + 1
        if need > len(self.kind):
            more = max(need, 2 * len(self.kind)) - len(self.kind)
            self.table = np.concatenate([self.table, np.zeros((len(WORD_AT), more, len(LABELS)), np.float32)], 1)
            self.kind, self.space = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.kind, self.space))
        blank = np.array([w.isspace() for w in new])
        self.space[start:need] = [(2 if "\n" in w else 1) if b else 0 for w, b in zip(new, blank, strict=True)]
        described = [self.field.describe(w, False) if not b else ([-1], [-1, -1, 0]) for w, b in zip(new, blank, strict=True)]
        word = np.array([d[0][0] for d in described])
        form = np.array([d[1] for d in described])
        for j, at in enumerate(WORD_AT):
            votes = self.word_votes[j][word] + (self.word_votes[_side(at)][word] if at else 0)
            self.table[j, start:need] = votes + self.word_votes[j][form[:, :2]].sum(1) if at in SHAPE_AT else votes
        self.kind[start:need] = form[:, 2]
        self.types.new = []

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, type) of each text, before any check."""
        if len(self.types) > self.MOST:
            self.clear()
        found, counts, sizes = [], [], []
        for t in texts:
            words = _PIECE.findall(t)
            counts.append(len(words))
            sizes += map(len, words)
            found += [CAPS + x if x.isalpha() else x for x in words] if in_capitals(t) else words
        every = np.fromiter(map(self.types.__getitem__, found), np.int64, len(found))
        self.learn()
        lengths = np.array(sizes, np.int64)
        ends = np.cumsum(lengths)
        text_of = np.repeat(np.arange(len(texts)), counts)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        space = self.space[every]
        before = np.concatenate([[0], space[:-1]]) if len(space) else space
        heads = np.concatenate([[True], text_of[1:] != text_of[:-1]]) if len(space) else np.zeros(0, bool)
        before[heads] = 2
        token = space == 0
        ids, gaps, of = every[token], before[token], text_of[token]
        ends = (ends - begins[text_of])[token]
        starts = ends - lengths[token]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(ids):
            return out
        size = np.bincount(of, minlength=len(texts))
        order = np.argsort(size, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        row, longest, n = rank[of], int(size.max()), len(texts)
        reach = WORD_AT[-1]
        grid = np.zeros((longest + 2 * reach, n), np.int64)
        grid[pos + reach, row] = ids
        between = np.full((longest + 2, n), 3, np.int64)
        between[pos + 1, row] = gaps
        score = self.table[0][grid[:longest]]
        for j in range(1, len(WORD_AT)):
            score += self.table[j][grid[j : j + longest]]
        for j, at in enumerate((0, 1, -1)):
            score += self.gap[j][between[1 + at : 1 + at + longest]]
        kinds, none = self.kind[grid], self.joint.shape[1] - 1
        code = (kinds[reach : reach + longest - 1] * 3 + between[2 : longest + 1]) * len(self.field.shapes) + kinds[reach + 1 : reach + longest]
        code = np.where(between[2 : longest + 1] == 3, none, code)
        score[1:] += self.joint[0][code]
        score[:-1] += self.joint[1][code]
        labels = decode(score, size[order], self.pair)[pos, row]
        for t in np.flatnonzero(labels):
            kind = LABELS[labels[t]]
            spans = out[of[t]]
            if kind[0] == "I" and spans and gaps[t] != 2:  # no piece goes over a line break
                spans[-1] = (spans[-1][0], int(ends[t]), spans[-1][2])
            else:
                spans.append((int(starts[t]), int(ends[t]), kind[2:]))
        return out


def train(count: int = 14_000, rounds: int = 26, seed: int = 11, ridge: float = 4e-4) -> Field:
    """Maximum-likelihood weights by AdaGrad over ``count`` labelled sequences; exact gradients by forward-backward."""
    data = labelled.sequences(count, seed)
    field = Field(labelled.vocabulary())
    ids, gaps, first, word, form, starts, ends = field.arrays([t for t, _ in data], grow=True)
    gold = np.zeros(len(ids), np.int64)
    for k, (_, spans) in enumerate(data):
        for a, b, kind in spans:
            inside = [i for i, (x, y) in enumerate(zip(starts[k], ends[k], strict=True)) if x >= a and y <= b]
            for n, i in enumerate(inside):
                gold[first[k] + i] = LABELS.index(("B-" if n == 0 else "I-") + kind)
    field.start()
    may = _allowed()
    opening = np.array([0.0 if x[0] != "I" else -1e9 for x in LABELS])
    grad2 = [np.full_like(w, 1e-3) for w in (field.votes, field.gap, field.joint, field.pair)]
    order = np.random.default_rng(seed).permutation(len(data))
    by_word, by_form = _Sums(word[:, 0]), [_Sums(form[:, c]) for c in range(2)]
    parts = []
    for part in np.array_split(order, 6):
        rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
        f = np.concatenate([[0], np.cumsum([first[i + 1] - first[i] for i in part])])
        parts.append((part, ids[rows], gaps[rows], gold[rows], f, (_Sums(ids[rows]), by_word, by_form)))
    for _ in range(rounds):
        for part, x, g, y, f, sums in parts:
            score = field.score(x, g, f, word, form)
            node, edge = _marginals(score, f, np.where(may, field.pair, -1e9), opening)
            node[np.arange(len(y)), y] -= 1.0
            inner = np.ones(len(y), bool)
            inner[f[:-1]] = False
            at = np.flatnonzero(inner)
            np.add.at(edge, (y[at - 1], y[at]), -1.0)
            grads = _gradients(field, node, x, g, f, word, form, sums) + (np.where(may, edge, 0.0),)
            for w, d, h in zip((field.votes, field.gap, field.joint, field.pair), grads, grad2, strict=True):
                d = d + ridge * len(part) * w
                h += d * d
                w -= 0.5 * d / np.sqrt(h)
            field.votes[:, -1] = 0.0
    return field


def _marginals(score, first, pair, opening):
    """Probabilities of labels a token, and expected counts of label pairs, by forward-backward in logarithms."""
    grid, filled = _padded(first)
    n, longest = grid.shape
    k = score.shape[1]
    alpha = np.zeros((longest, n, k))
    beta = np.zeros((longest, n, k))
    e = score[grid]  # (n, longest, k)
    weight = np.exp(pair)
    alpha[0] = e[:, 0] + opening
    for t in range(1, longest):
        top = alpha[t - 1].max(1, keepdims=True)
        new = np.log(np.exp(alpha[t - 1] - top) @ weight + 1e-300) + top + e[:, t]
        alpha[t] = np.where(filled[:, t, None], new, alpha[t - 1])
    for t in range(longest - 2, -1, -1):
        later = beta[t + 1] + e[:, t + 1]
        top = later.max(1, keepdims=True)
        new = np.log(np.exp(later - top) @ weight.T + 1e-300) + top
        beta[t] = np.where(filled[:, t + 1, None], new, 0.0)
    top = alpha[-1].max(1, keepdims=True)
    z = (np.log(np.exp(alpha[-1] - top).sum(1, keepdims=True)) + top)[:, 0]
    node = np.zeros_like(score)
    edge = np.zeros((k, k))
    for t in range(longest):
        live = filled[:, t]
        node[grid[live, t]] = np.exp(np.minimum(alpha[t][live] + beta[t][live] - z[live, None], 0.0))
        if t:
            before, behind = alpha[t - 1][live], beta[t][live] + e[live, t]
            top, low = before.max(1, keepdims=True), behind.max(1, keepdims=True)
            a = np.exp(before - top) * np.exp(np.minimum(top + low - z[live, None], 700))
            b = np.exp(behind - low)
            edge += (a.T @ b) * weight
    return node, edge


class _Sums:
    """Sums of rows by a fixed index, by one sort and segment sums."""

    def __init__(self, index: np.ndarray):
        self.order = np.argsort(index, kind="stable")
        self.keys, self.starts = np.unique(index[self.order], return_index=True)

    def add(self, out: np.ndarray, rows: np.ndarray) -> None:
        if len(self.keys):
            out[self.keys] += np.add.reduceat(rows[self.order], self.starts, axis=0)


def _gradients(field: Field, node, ids, gaps, first, word, form, sums):
    votes, gap = np.zeros_like(field.votes), np.zeros_like(field.gap)
    by_id, by_word, by_form = sums
    size = np.diff(first)
    pos = np.arange(len(ids)) - np.repeat(first[:-1], size)
    rest = np.repeat(size, size) - pos
    for k, at in enumerate(WORD_AT):
        where = np.flatnonzero((pos + at >= 0) & (rest - at > 0))
        seen = np.zeros_like(node)
        seen[where + at] = node[where]
        by_type = np.zeros((len(word), node.shape[1]))
        by_id.add(by_type, seen)
        by_word.add(votes[k], by_type)
        if at:
            by_word.add(votes[_side(at)], by_type)
        if at in SHAPE_AT:
            for one in by_form:
                one.add(votes[k], by_type)
    for k, at in enumerate((0, 1, -1)):
        ok = np.flatnonzero((pos + at >= 0) & (rest - at > 0))
        for g in range(3):
            gap[k, g] += node[ok[gaps[ok + at] == g]].sum(0)
    votes[:, -1] = 0.0
    joint = np.zeros_like(field.joint)
    for k, (code, ok) in enumerate(field.joints(ids, gaps, pos, form)):
        _Sums(code).add(joint[k], node[ok])
    return votes, gap, joint


@lru_cache(maxsize=1)
def model() -> bytes:
    """The trained field, packed; trained once a process, in some seconds, always with the same result."""
    return cloudpickle.dumps(train())


def parts(text: str, most: int = PART_CHARS) -> list[tuple[int, str]]:
    """(start, part) of a text: one up to ``most`` characters, else several that end at line breaks, or at blanks where a
    part has no line break, or anywhere where it has neither."""
    out, a = [], 0
    while len(text) - a > most:
        b = text.rfind("\n", a, a + most)
        b = b if b > a else text.rfind(" ", a, a + most)
        b = b + 1 if b > a else a + most
        out.append((a, text[a:b]))
        a = b
    return [*out, (a, text[a:])]


def pieces(texts: list[str], decoder: Decoder, checked: bool = True) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of personal information in each text, in order; whole texts are read.

    ``checked`` adds the exact check (``trimmed``) to what the field finds.
    """
    split = [(k, a, p) for k, t in enumerate(texts) for a, p in parts(t)]
    split.sort(key=lambda x: len(x[2]))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    a = 0
    while a < len(split):
        b = a + 1
        while b < len(split) and (b + 1 - a) * len(split[b][2]) <= BATCH_CHARS:
            b += 1
        for (k, begin, p), spans in zip(split[a:b], decoder.spans([p for *_, p in split[a:b]]), strict=True):
            out[k] += [(x[0] + begin, x[1] + begin, x[2]) for s in spans if (x := trimmed(p, *s, decoder.field.vocabulary) if checked else s)]
        a = b
    return [sorted(spans) for spans in out]


_AFTER_NAME = regex.compile(r"(?<=\p{L}{2})\.|[\n\t]")


#: Titles and ranks that may stand before a single surname (fixed values).
_TITLE = regex.compile(r"(?i)\b(?:Capt|Captain|Master|Mr|Mrs|Ms|Dr|Herr|Herrn|Frau|Kapitän|Sr|Sra|Mme|Madame|Monsieur)\.?\s+$")
#: Words of the table that may begin a surname (fixed values).
PARTICLES = {"van", "von", "der", "den", "del", "dos", "della"}
_FIRST_WORD = regex.compile(r"(\p{L}+)\s+(?=\p{L})")
_LAST_WORD = regex.compile(r"\s+(\p{L}+)\s*$")


def trimmed(text: str, start: int, end: int, kind: str, ordinary: set[str] = frozenset()) -> tuple[int, int, str] | None:
    """The exact check after decoding: the span without what its type cannot hold, or None if it lacks what it must have.

    A name ends before a full stop that follows a word (an initial's stop stays), and before ``ordinary`` words of three
    letters or more (a sentence may begin behind it without a stop), begins behind such words that lead it, has letters at
    both ends and no digit, and is more than one word unless a title or rank stands before it; a
    phone number has no letter and at least 7 digits; an address or identity number keeps to one line and has digits.
    """
    piece = text[start:end]
    if kind == "EMAIL" and "\n" in piece:
        start += piece.rindex("\n") + 1
    elif kind == "NAME":
        start += piece.rfind(">") + 1
        piece = text[start:end]
        cut = _AFTER_NAME.search(piece)
        end = start + cut.start() if cut else end
        while (last := _LAST_WORD.search(text[start:end])) and len(last[1]) > 2 and last[1].lower() in ordinary:
            end = start + last.start()
        while (lead := _FIRST_WORD.match(text[start:end])) and len(lead[1]) > 2 and lead[1].lower() in ordinary and lead[1].lower() not in PARTICLES:
            start += lead.end()
    elif kind == "PHONE":
        letter = regex.search(r"\p{L}|\n", piece)
        end = start + letter.start() if letter else end
    elif "\n" in piece:
        end = start + piece.index("\n")
    edge = {"NAME": r"[^\p{L}]+", "PHONE": r"[^\d+(]+", "EMAIL": r"[^\p{L}\p{N}]+", "ID_NUMBER": r"[^\p{L}\p{N}]+", "ADDRESS": r"[^\p{L}\p{N}]+"}[kind]
    head = regex.match(edge, text[start:end])
    start += len(head.group()) if head else 0
    tail = regex.search(r"[^\d]+$" if kind == "PHONE" else r"[^\p{L}\p{N}.]+$" if kind == "ADDRESS" else r"[^\p{L}\p{N}]+$", text[start:end])
    end -= len(tail.group()) if tail else 0
    if kind == "ADDRESS" and text[end : end + 1] == "." and regex.search(r"(?i)\b(?:Ave|Av|St|Str|Rd|Ln|Blvd)$", text[start:end]):
        end += 1  # the stop of an abbreviation belongs to it
    piece = text[start:end]
    digits = sum(c.isdigit() for c in piece)
    whole = kind != "NAME" or len(_TOKEN.findall(piece)) > 1 or _TITLE.search(text[:start][-12:]) is not None
    good = {"NAME": whole and digits == 0 and sum(c.isalpha() for c in piece) >= 2, "PHONE": digits >= 7, "ID_NUMBER": digits >= 5, "ADDRESS": digits >= 1 and any(c.isalpha() for c in piece), "EMAIL": "@" in piece or "at" in piece.lower()}[kind]
    return (start, end, kind) if good else None


def found(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, pii_type, pii_text), each distinct piece of a document once, as it is written.

    Null and blank texts have none. The corpus is read in one pass; only the pieces are shuffled. Extra columns are
    left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model())
    kind = dict(documents.dtypes)[doc_id]

    def run(batches):
        decoder = Decoder(cloudpickle.loads(shared.value))
        for pdf in batches:
            texts, ids, rows = pdf[text].tolist(), pdf[doc_id].tolist(), []
            for i, t, spans in zip(ids, texts, pieces(texts, decoder), strict=True):
                rows += [(i, *x) for x in dict.fromkeys((k, t[a:b]) for a, b, k in spans)]
            yield pd.DataFrame(rows, columns=[doc_id, "pii_type", "pii_text"])

    docs = documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, text)
    return docs.mapInPandas(run, f"{doc_id} {kind}, pii_type string, pii_text string").distinct()


def masked(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with each piece of personal information in ``text`` replaced by its type in brackets.

    Null stays null, and text without any stays as it is.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        decoder = Decoder(cloudpickle.loads(shared.value))
        for pdf in batches:
            texts = [t or "" for t in pdf[text]]
            new = []
            for t, spans in zip(texts, pieces(texts, decoder), strict=True):
                last, parts = 0, []
                for a, b, kind in spans:
                    parts += [t[last:a], f"[{kind}]"]
                    last = b
                new.append("".join([*parts, t[last:]]))
            pdf[text] = [n if isinstance(old, str) else None for n, old in zip(new, pdf[text], strict=True)]
            yield pdf

    return documents.mapInPandas(run, documents.schema)
