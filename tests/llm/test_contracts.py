"""The numbered queries against independent brute force on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerline.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select * from '{FOLDER}/documents.parquet' order by doc_id").df()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def result(spark, prefix):
    name = next(n for n in QUERIES if n.startswith(prefix))
    return QUERIES[name](spark, FOLDER).toPandas()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    a, b = QUERIES[name](spark, FOLDER).toPandas(), con.sql(ORACLE_SQL[name]).df()
    key = ["doc_id"]
    pd.testing.assert_frame_equal(a[sorted(a.columns)].sort_values(key).reset_index(drop=True), b[sorted(a.columns)].sort_values(key).reset_index(drop=True), check_dtype=False)


def test_op1(spark, docs):
    sizes = [len(re.findall(WORD, t or "")) for t in docs.text]
    per = defaultdict(int)
    largest = defaultdict(int)
    for s, n in zip(docs.source, sizes, strict=True):
        per[s] += n
        largest[s] = max(largest[s], n)
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(per))}
    capped, target = {}, {}
    while True:  # share, cap, and reshare the excess until none is above
        left = sum(per.values()) - sum(capped.values())
        open_ = [s for s in per if s not in capped]
        target = capped | {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > 3 * per[s] + 1e-9]
        if not over:
            break
        capped |= {s: 3.0 * per[s] for s in over}
    found = result(spark, "op1_")
    assert dict(zip(found.doc_id, found["size"], strict=True)) == dict(zip(docs.doc_id, sizes, strict=True))
    assert all(abs(t - target[s]) < 1e-6 * max(1, t) for s, t in zip(found.source, found.target, strict=True))
    assert (found.taken <= 3 * found["size"]).all() and (found.source_size == found.source.map(per)).all()
    for s, taken in found.groupby("source").taken.sum().items():
        assert abs(taken - target[s]) <= largest[s]
    again = result(spark, "op1_")
    assert dict(zip(found.doc_id, found.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_op2_keeps_good_documents(spark):
    labels = duckdb.sql(f"select doc_id, quality from '{FOLDER}/labels.parquet'").df()
    found = result(spark, "op2_").merge(labels, on="doc_id")
    assert found[found.quality == 1].keep.mean() > 0.95 and found[found.quality == 0].keep.mean() < 0.15


def test_op3(spark, docs, tokenizer):
    found, start = result(spark, "op3_").sort_values("doc_id"), 0
    for e, r in zip(tokenizer.encode_batch(list(docs.text), add_special_tokens=False), found.itertuples(), strict=True):
        ids = [*e.ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5(spark, docs):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = result(spark, "op5_").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        r = found.loc[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_op6(spark, docs, tokenizer):
    found = result(spark, "op6_")
    for i, e in zip(docs.doc_id, tokenizer.encode_batch(list(docs.text), add_special_tokens=False), strict=True):
        ids, at = [*e.ids, 1], 0
        for r in found[found.doc_id == i].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and list(g.offset) == [0, *g.length.cumsum()[:-1]]
    assert found.length.sum() / (2048 * found.sequence_id.nunique()) > 0.97


def brute_components(texts, ids):
    sets = []
    for t in texts:
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    holders = defaultdict(list)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                if ids[a] < ids[b]:
                    parent[b] = a
                else:
                    parent[a] = b
        for x in s:
            holders[x].append(i)
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(ids))}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op7(spark, folder):
    docs = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").df()
    found = QUERIES["op7_near_dedup"](spark, folder).toPandas()
    expected = brute_components(list(docs.text), list(docs.doc_id))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.itertuples()} == expected
    assert (found.kept == (found.doc_id == found.component_id)).all()


def test_op8(spark, docs):
    found = result(spark, "op8_").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        raw, r = t.encode(), found.loc[i]
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    by_text = found.join(docs.set_index("doc_id").text).groupby("text")
    assert (by_text.feature.nunique() == 1).all() and (by_text.media_sha256.nunique() == 1).all()


def test_op9(spark, docs):
    found = result(spark, "op9_").sort_values("doc_id")
    sizes = [len(t.encode()) + 1 for t in docs.text]
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    assert list(found["size"]) == sizes and list(found.text_crc32) == [zlib.crc32(t.encode()) for t in docs.text]
    assert list(found.shard) == [min(7, int(b * 8 / sum(sizes))) for b in before]
    assert all(list(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))


def test_op10_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").df()
    found = QUERIES["op10_toxicity"](spark, folder).toPandas()
    assert len(found) == 10_000 and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    held = found[found.held_out].merge(labels, on="doc_id")
    assert held[held.toxic == 1].predicted.mean() > 0.75 and held[held.toxic == 0].predicted.mean() < 0.01
