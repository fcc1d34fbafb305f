import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle

from plumbline.llm import labelled, pii


@pytest.fixture(scope="module")
def field():
    return pii.Decoder(cloudpickle.loads(pii.model()))


def accuracy(field, held, checked=True):
    got = pii.pieces([t for t, _ in held], field, checked)
    hit = sum(len(set(a) & set(b)) for a, (_, b) in zip(got, held, strict=True))
    return hit / sum(len(b) for _, b in held), hit / sum(map(len, got))


def test_expected_counts_stay_finite_for_large_scores():
    r = np.random.default_rng(2)
    score = r.normal(size=(40, len(pii.LABELS))) * 400
    opening = np.array([-1e9 if x[0] == "I" else 0.0 for x in pii.LABELS])
    node, edge = pii._marginals(score, np.array([0, 25, 40]), np.where(pii._allowed(), 0.0, -1e9), opening)
    assert np.isfinite(node).all() and np.allclose(node.sum(1), 1, atol=1e-6) and np.isclose(edge.sum(), 38, atol=1e-4)


def test_accuracy_on_forms_of_training(field):
    recall, precision = accuracy(field, labelled.sequences(800, 4711))
    assert recall > 0.96 and precision > 0.97


@pytest.mark.parametrize("checked", [False, True])
def test_accuracy_on_forms_that_training_never_shows(field, checked):
    assert not set(labelled.HELD_OUT.strip().splitlines()) & set(labelled.SENTENCES.strip().splitlines())
    recall, precision = accuracy(field, labelled.sequences(2000, 4712, labelled.HELD_OUT, False), checked)
    assert recall > 0.9 and precision > 0.93


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test data")
def test_no_labelled_form_is_a_line_of_the_documents():
    """The tagger must not learn from the sentences it is tried on: no form matches a whole sentence with personal data."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    said = {s.strip() for t in texts if t for line in t.split("\n") for s in re.split(r"(?<=[.?!]) ", line)}
    joined, marks = "\n".join(said), re.compile(r"\{\w+\}|\(([^()|]*(?:\|[^()|]*)+)\)")

    def opened(text):
        return "".join(".{1,60}" if re.fullmatch(r"\{\w+\}", x) else re.escape(x) for x in re.split(r"(\{\w+\})", text))

    for line in labelled.SENTENCES.strip().splitlines():
        if line.startswith("- ") or "\\n" in line or not re.search(r"[a-z]{3}", re.sub(r"\{\w+\}", "", line)):
            continue
        at, pattern = 0, ""
        for m in marks.finditer(line):
            pattern += re.escape(line[at : m.start()]) + (".{1,60}" if m[0][0] == "{" else "(?:" + "|".join(map(opened, m[1].split("|"))) + ")")
            at = m.end()
        assert not re.search(f"(?m)^{pattern}{re.escape(line[at:])}$", joined), line


CASES = [
    ("Please reach Mirela Tanobrek at m_tanobrek @ example.com or +1 202-555-0114. Wind N force 4.", {("NAME", "Mirela Tanobrek"), ("EMAIL", "m_tanobrek @ example.com"), ("PHONE", "+1 202-555-0114")}),
    ("NEXT OF KIN LIVES AT 92B SAILMAKER AVE.. MT LENA NDASKO ARRIVED FENRU ROADS AT 09:14.", {("ADDRESS", "92B SAILMAKER AVE.")}),
    ("rgds\nVAN DER HOLT, Freya\n07700 900850\nfreya(dot)vanderholt (at) crew(dot)example(dot)org", {("NAME", "VAN DER HOLT, Freya"), ("PHONE", "07700 900850"), ("EMAIL", "freya(dot)vanderholt (at) crew(dot)example(dot)org")}),
    ("Bunker barge MV ANNA HARBRISA delivered 12.3 t; container QXDU1963905, IMO 9528574, bill BL44777460.", set()),
    ("Reisepass SQ 78 69 15 Z von Anna L. Okavi fehlt.", {("ID_NUMBER", "SQ 78 69 15 Z"), ("NAME", "Anna L. Okavi")}),
    ("", set()), ("   \n ", set()), ("¿?…", set()),
]


@pytest.mark.parametrize("text, want", CASES)
def test_cases(field, text, want):
    assert {(k, text[a:b]) for a, b, k in pii.pieces([text], field)[0]} == want


def test_batches_don_t_change_results(field):
    texts = [t for t, _ in CASES] * 3 + ["word " * 30_000 + CASES[0][0]]
    alone = [pii.pieces([t], field)[0] for t in texts]
    assert pii.pieces(texts, field) == alone and len(alone[-1]) == 3


def test_long_texts_go_in_parts(field):
    text = ("The crew found water in hold 2.\n" * 40_000) + CASES[0][0] + (" word" * 300_000)
    assert "".join(p for _, p in pii.parts(text)) == text and all(text[a : a + len(p)] == p and len(p) <= pii.PART_CHARS for a, p in pii.parts(text))
    assert {(k, text[a:b]) for a, b, k in pii.pieces([text], field)[0]} == CASES[0][1]
    assert pii.parts("x" * 25, 10) == [(0, "x" * 10), (10, "x" * 10), (20, "x" * 5)]


def test_decoder_finds_the_best_path():
    r = np.random.default_rng(1)
    k = len(pii.LABELS)
    score, pair = r.normal(size=(4, k)), r.normal(size=(k, k))
    ok = pii._allowed()
    best, path = -1e18, None
    for a in range(k):
        if pii.LABELS[a][0] == "I":
            continue
        for b in np.flatnonzero(ok[a]):
            for c in np.flatnonzero(ok[b]):
                for d in np.flatnonzero(ok[c]):
                    x = score[0, a] + score[1, b] + score[2, c] + score[3, d] + pair[a, b] + pair[b, c] + pair[c, d]
                    if x > best:
                        best, path = x, [a, b, c, d]
    both = np.zeros((4, 2, k))  # beside a shorter text
    both[0, 0], both[:, 1] = score[0], score
    assert pii.decode(both, np.array([1, 4]), pair)[:, 1].tolist() == [int(x) for x in path] and not pii.decode(both, np.array([1, 4]), pair)[1:, 0].any()


def test_found_and_masked(spark):
    rows = [(1, CASES[0][0], "x"), (1, CASES[0][0], "y"), (2, None, "x"), (3, "nothing here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string")
    got = [tuple(x) for x in pii.found(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted((1, k, t) for k, t in CASES[0][1])
    masked = {x["doc_id"]: x["text"] for x in pii.masked(df, "text").collect()}
    assert masked == {1: "Please reach [NAME] at [EMAIL] or [PHONE]. Wind N force 4.", 2: None, 3: "nothing here"}
    assert pii.found(df.limit(0), "doc_id", "text").count() == 0
