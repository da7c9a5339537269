"""The query's own model: recall on planted strings, counts against plain ones, and the edge cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import secrets_scan

from .conftest import CLASHES, EDGES


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def ratio(docs):
    return secrets_scan.train_markov(secrets_scan.weak_samples(docs), secrets_scan.ALPHABETS)


def test_recall_of_each_alphabet_and_length(ratio):
    rng, random = np.random.default_rng(1), secrets_scan.Scorer(ratio)
    for name, letters in secrets_scan.ALPHABETS.items():
        for n in (14, 20, 32, 40):
            found = sum(random("".join(rng.choice(list(letters), n))) for _ in range(200))
            assert found >= 190, (name, n, found)


def test_planted_strings_are_found_in_whole_texts(make, docs, ratio):
    rng = np.random.default_rng(2)
    texts = [r.text for r in docs.select("text").filter("length(text) > 200").limit(40).collect()]
    rows, at = [], {}
    for i, text in enumerate(texts):
        key = "".join(rng.choice(list(secrets_scan.ALPHABETS["base62"]), 24))
        cut = text.find(" ", len(text) // 2) + 1
        rows.append((i, text[:cut] + key + " " + text[cut:]))
        at[i] = f"markov:{cut}:{cut + 24}"
    found = {r.doc_id: r.spans.split(",") for r in secrets_scan.scan_secrets(make(rows), ratio).collect()}
    assert all(at[i] in found[i] for i in at)


def test_ordinary_texts_have_none(docs, ratio):
    assert secrets_scan.scan_secrets(docs, ratio).filter("n_markov > 0").count() == 0


def test_ratio_is_that_of_plain_counts(spark):
    runs = [("abcdabcd", True), ("x1Y2z3w4", True), ("hello_there", False), ("general-kenobi", False), ("hello_there", False)]
    found = secrets_scan.train_markov(spark.createDataFrame(runs, "run string, secret boolean").repartition(3), {"hex": "0123456789abcdef"})
    code = {c: i + 1 for i, c in enumerate(secrets_scan.ALPHABET)}

    def model(strings):
        pairs = Counter((code.get(a, 0), code[b]) for s in strings for a, b in zip("\n" + s, s))
        second, first = Counter(), Counter()
        for (a, b), n in pairs.items():
            second[b] += n
            first[a] += n
        share = {b: (second[b] + 1) / (sum(second.values()) + secrets_scan.STATES) for b in range(secrets_scan.STATES)}
        return lambda a, b: math.log((pairs[a, b] + secrets_scan.BACKOFF * share[b]) / (first[a] + secrets_scan.BACKOFF))

    ordinary = model([s for s, secret in runs if not secret])
    for k, strings in enumerate([[s for s, secret in runs if secret], secrets_scan.drawn("0123456789abcdef", 0)]):
        own = model(strings)
        for a, b in [(0, code["a"]), (code["a"], code["b"]), (code["e"], code["r"]), (code["0"], code["f"]), (code["Z"], code["-"])]:
            assert abs(found[k, a, b] - (own(a, b) - ordinary(a, b))) < 1e-9
    total = [sum(found[k, code.get(a, 0), code[b]] for a, b in zip("\n0f0f", "0f0f")) for k in (0, 1)]
    assert abs(secrets_scan.Scorer(found).total("0f0f") - math.log(sum(map(math.exp, total)) / 2)) < 1e-9


def test_counts_of_texts_are_those_of_their_runs(spark, make):
    texts = ["token=abcdefgh12 plain words_here", None, "", "AKIA" + "Q" * 14 + " x", "f" * 40]
    runs = [x for t in texts for x in secrets_scan.labelled_runs(t or "")]
    samples = spark.createDataFrame(runs, "run string, secret boolean")
    assert np.allclose(secrets_scan.train_markov(secrets_scan.weak_samples(make(texts))), secrets_scan.train_markov(samples))


def test_edges(make, ratio):
    rng = np.random.default_rng(4)
    key = "".join(rng.choice(list(secrets_scan.ALPHABETS["base62"]), 30))
    rows = [*EDGES, (None, f"é {key}"), (11, "word " * 40_000 + key), (11, "word " * 40_000 + key), (12, f"password={key}")]
    found = secrets_scan.scan_secrets(make(rows, **CLASHES), ratio).collect()
    assert len(found) == len(rows)
    spans = [(r.doc_id, r.spans) for r in found if r.spans]
    assert sorted(spans, key=str) == sorted([(None, "markov:2:32"), (11, "markov:200000:200030"), (11, "markov:200000:200030"), (12, "assign:0:39")], key=str)
    assert secrets_scan.scan_secrets(make(rows), ratio).agg(F.sum("n_assign"), F.sum("n_hex")).first()[:] == (1, 0)
