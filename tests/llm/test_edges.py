"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import audio, exact_dedup, mixing, near_dedup, packing, quality, secrets_scan, sharding, token_files, toxicity
from ledgerline.llm.cuckoo import CuckooFilter, LiveDigests

from .conftest import CLASHES, DOCS, EDGES

TOKENIZER = "word_bpe_49k.json"


def test_exact_dedup(make):
    found = exact_dedup.mark_duplicates(make(EDGES, **CLASHES)).collect()
    assert len(found) == len(EDGES)
    by = {(r.doc_id, r.kept): r for r in found}
    assert by[(6, False)].keep_id == 5 and by[(5, True)].group_size == 3
    assert by[(1, True)].keep_id == 1 and by[(2, False)].keep_id == 1  # null is the empty text
    assert by[(3, True)].group_size == 1  # white space is one space, not empty
    kept = exact_dedup.drop_duplicates(make(EDGES, **CLASHES))
    assert kept.columns == make(EDGES, **CLASHES).columns and kept.count() == 7
    same = exact_dedup.drop_duplicates(make([(1, "a"), (1, "a"), (1, "b")])).collect()
    assert sorted(r.text for r in same) == ["a", "b"]


def test_digest_index_changes(spark, make):
    def digests(*texts):
        return make(list(texts)).select("doc_id", exact_dedup.content_key().alias("digest"))

    index = exact_dedup.DigestIndex.empty(spark, 10).change(insert=digests("a", "b", "a"))
    index = index.change(insert=digests((9, "c"), (8, "a")), delete=digests("b", "never seen"))
    live = {r.keep_id: r.group_size for r in index.live().collect()}
    assert live == {0: 3, 9: 1}


def test_digest_index_leaves_other_buckets_alone(spark, make):
    def contents(*texts):
        return make(list(texts)).select("doc_id", exact_dedup.content_key().alias("digest"))

    index = exact_dedup.DigestIndex.empty(spark, 5 * exact_dedup.BUCKET_ROWS).change(insert=contents(*(f"t{i}" for i in range(40))))
    live = {i: 1 for i in range(40)}
    for k in range(2 * exact_dedup.COMPACT + 1):  # tables are written anew in between
        index = index.change(insert=contents((100 + k, f"u{k}"), (200 + k, f"t{k + 1}")), delete=contents((0, f"t{k}")).select("digest"))
        live = {i: n for i, n in live.items() if i != k} | {k + 1: 2, 100 + k: 1}
    found = {r.keep_id: r.group_size for r in index.live().collect()}
    assert found == live and index.rows.filter("filter is not null").groupBy("bucket").count().filter("count > 1").count() == 0


def test_cuckoo_filter_resizes_and_deletes():
    keys = [i.to_bytes(4, "little") * 8 for i in np.random.default_rng(0).integers(0, 1 << 32, 5000).tolist()]
    live = LiveDigests()
    assert all(live.insert(k, i, 1) for i, k in enumerate(keys)) and live.resizes > 0
    assert all(k in live.filter for k in keys) and not live.insert(keys[7], 99, 2) and {c: [i, n] for c, i, n in live}[keys[7]] == [7, 3] and live.hits >= 1 and live.size == 5000
    assert all(live.delete(k) for k in keys[:2500]) and not live.delete(keys[0])
    assert all(k in live.filter for k in keys[2500:]) and sum(k in live.filter for k in keys[:2500]) < 25
    assert CuckooFilter(table=live.filter.table.tobytes()).table == live.filter.table


def test_sharding(spark, make):
    found = sharding.shard_by_bytes(make(EDGES, **CLASHES), 3)
    assert found.count() == len(EDGES)
    for shard in range(3):
        slots = sorted(r.slot for r in found.filter(F.col("shard") == shard).collect())
        assert slots == list(range(len(slots)))
    even = sharding.shard_by_bytes(make(["x" * 9] * 80), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert {r.b for r in even} == {100}


def test_mixing(make):
    docs = make([(i, "w " * (i % 7), ["a", "b", None][i % 3]) for i in range(300)] + [(1, "w " * 1, "b")], **CLASHES)
    found = mixing.mix_copies(docs).toPandas()
    assert len(found) == 301 and (found.taken <= 3 * found["size"]).all()
    total = found.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(total.target.sum() - total["size"].sum()) < 1e-6 and ((total.taken - total.target).abs() <= 6).all()
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == found.copies.sum()


def test_mixing_caps(make):
    docs = make([(i, "w", "big") for i in range(90)] + [(100 + i, "w", "tiny") for i in range(3)])
    found = mixing.mix_copies(docs, weights=(1, 9)).toPandas().groupby("source").agg(t=("target", "first"), taken=("taken", "sum"))
    assert found.t["tiny"] == 9 and found.taken["tiny"] == 9 and found.t["big"] == 84 and found.taken["big"] == 84


def test_token_files(spark, make, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(make(EDGES, **CLASHES), path, TOKENIZER, end=2)
    found = token_files.read_token_files(spark, path)
    assert found.count() == len(EDGES) and found.filter("n_tokens = 1").count() == 3
    one = token_files.read_token_files(spark, path, [4]).collect()
    assert [r.doc_id for r in one] == [4] and np.frombuffer(one[0].ids, "<u2")[-1] == 2


def same_ids(e, texts):
    plain = [np.array(x.ids, e.dtype).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    found = e.encode(pa.array([t.encode() for t in texts], pa.binary()))
    wrong = [t for t, a, b in zip(texts, found, plain, strict=True) if a != b]
    assert not wrong, wrong[:5]


def test_encoder_agrees_with_the_library():
    from ledgerline.llm.tokens import encoder

    e = encoder(TOKENIZER)
    assert e.by_word and e.encode(pa.array([None, b"", b" "], pa.binary())) == [b""] * 3 and e.encode(pa.array([], pa.binary())) == []
    same_ids(e, ["", "H̱ H̱, É, ÉÉ. A<|endoftext|>B <|ENDOFTEXT|>, x|y|, ... l'été, O'Re's! ΑΣ, a b, İstanbul. ẞ? 12, 3. _x_! 's it'S, don'T.", "a\x1cb a b\tc\x0bd\x85e", "the, The. THE! the|"])
    same_ids(e, ["VERGİSİ, TÜRKİYE. bir İ. var", "SERİ! YENİ.", "क़, ख़. ग़! ज़? ड़|", "T\u0344, t\u0344. Ẕ̱ h\u0331 H\u0331", ">\u0338 <\u0338| \u0338x", "<|startoftext|><|endoftext|>", "a<| b |>, A<|B."])
    other = encoder("byte_bpe_50k.json")  # white space matters there
    assert not other.by_word and other.encode(pa.array([b"a  b"])) == [np.array(other.tokenizer.encode("a  b", add_special_tokens=False).ids, "<u2").tobytes()]


def test_encoder_agrees_on_every_character():
    from ledgerline.llm.tokens import encoder

    characters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    same_ids(encoder(TOKENIZER), ["".join(f"{c}, A{c}! x{c}E. {c}\n" for c in characters[at : at + 64]) for at in range(0, len(characters), 64)])


def test_encoder_agrees_on_random_texts():
    from ledgerline.llm.tokens import encoder

    rng = np.random.default_rng(5)
    letters = list("aAbEeTtHIiİıſsßẞΣςéÉ\u0301\u0331\u0338\u0344\u0308क़\u093cKÅﬁ가ᄀ ᅡ漢字\U0001d400\U0001f600 0 1²") + [*" \t\n\r\x0b\x0c\x1c\x85\u00a0\u3000", *".,;:!?|'\"-_<>%*()", "'s", "'LL", "<|", "<|endoftext|>", "|>", "the", "ing", ", ", ". "]
    same_ids(encoder(TOKENIZER), ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 40, 20_000)])


def test_packing(make):
    found = packing.pack_documents(make(EDGES, **CLASHES), TOKENIZER, end=1).toPandas()
    assert found.length.sum() == found.drop_duplicates(["doc_id", "doc_tokens"]).doc_tokens.sum() + found[found.doc_id == 6].doc_tokens.iloc[0]
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and list(g.offset) == [0, *g.length.cumsum()[:-1]]
    assert all(len(x) == 2 * n for x, n in zip(found.ids, found.length, strict=True))


def test_assign_balances_cost():
    lengths = np.random.default_rng(0).integers(1, 2047, 500).tolist()
    parts = packing.assign(lengths)
    assert [sum(n for _, _, n in p) for p in parts] == lengths
    used = {}
    for p in parts:
        for to, _, n in p:
            used[to] = used.get(to, 0) + n
    assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > 0.99
    assert sum(len(p) > 1 for p in parts) < 0.4 * len(parts)


def test_near_dedup(make):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:30], "other", *base[31:]]
    rows = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base).upper()), (13, None), (14, ""), (15, "three words only"), (16, "Three  words\nonly"), (None, " ".join(base)), (17, " ".join(base[:30])), (11, " ".join(near))]
    found = near_dedup.near_duplicates(make(rows, **CLASHES)).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert len(found) == len(rows)
    assert by[11] == (56, 10) and by[12] == (56, 10) and by[13] == (0, 13) and by[14] == (0, 14) and by[15] == (1, 15) and by[16] == (1, 15) and by[17][1] == 17 and by[None][1] is None
    kept = near_dedup.drop_near_duplicates(make(rows, **CLASHES))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [10, 13, 14, 15, 17]


def test_near_dedup_shuffles_hardly_any_texts_but_the_members(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("text_hash"))
    rows = rows.unionByName(rows.filter("doc_id < 100"))
    members = rows.filter("doc_id % 100 = 0").select(F.col("text_hash").alias("rep_hash"))
    found = [r.doc_id for r in near_dedup._likely(rows, members).collect()]
    assert found.count(0) == 2 and set(range(0, 20_000, 100)) <= set(found) and len(found) < 220
    crowded = [r.doc_id for r in near_dedup._likely(rows, members, 64).collect()]
    assert set(found) <= set(crowded)
    assert near_dedup._likely(rows, members.filter("rep_hash is null")).isEmpty()


def test_near_dedup_of_large_nodes(spark, make):
    """Nodes above the limit branch again, and dense ones are dealt into pairs of blocks."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(300):
        words = list(base)
        words[int(rng.integers(80))] = f"x{i}"
        texts.append(" ".join(words))
    texts += [f"alone {i} " + " ".join(f"y{i}z{j}" for j in range(20)) for i in range(40)]
    found = near_dedup.near_duplicates(make(texts), limit=20, depth=2).toPandas()
    from .test_contracts import brute_components

    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.itertuples()} == brute_components(texts, list(range(len(texts))))


def test_near_dedup_of_dense_families(make):
    """Families of near copies too large for a node, one chained across two leaders, and long texts that fill a node by their shingles."""
    rng = np.random.default_rng(1)
    texts = []
    for family in range(3):
        base = [f"w{family * 40 + i}" for i in range(100)]  # families share words, not enough to be linked
        for i in range(60):
            words = list(base)
            for at in rng.integers(0, 100, int(rng.integers(1, 4))):
                words[int(at)] = f"x{i}y{at}"
            texts.append(" ".join(words))
    base = [f"z{i}" for i in range(4000)]
    texts += [" ".join([*base[:k], f"q{k}", *base[k:]]) for k in range(0, 4000, 400)]
    from .test_contracts import brute_components

    for options in ({"limit": 16, "depth": 1}, {"limit": 16, "depth": 1, "set_limit": 3_000}, {"set_limit": 9_000, "depth": 1}):
        found = near_dedup.near_duplicates(make(texts), **options).toPandas()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.itertuples()} == brute_components(texts, list(range(len(texts))))


def test_near_dedup_of_repeated_ids(make):
    one, two = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    near = lambda words: " ".join([*words[:20], "other", *words[21:]])
    rows = [(1, " ".join(one)), (2, near(one)), (2, " ".join(two)), (3, near(two)), (2, " ".join(two)), (4, near(one))]
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(make(rows)).collect())
    assert found == [(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False), (4, 1, False)]
    kept = near_dedup.drop_near_duplicates(make(rows, **CLASHES)).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [(1, "a"), (2, "b"), (2, "b")]


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert near_dedup.components(edges).filter("label <> 0").count() == 0


def test_secrets(make):
    ratio = np.zeros((secrets_scan.STATES, secrets_scan.STATES))
    rows = [(1, "é password: 'hunter2hunter2' and token=short"), (2, None), (3, "AKIA" + "A" * 11), (4, "AKIA" + "B" * 12 + " " + "0f" * 16), (5, "ſecret=abcdefghijk"), (6, "token = secret: abcdefghij")]
    found = {r.doc_id: r for r in secrets_scan.scan_secrets(make(rows, **CLASHES), ratio).collect()}
    assert found[1].spans == "assign:2:27" and found[2].spans == "" and found[3].n_access == 0
    assert (found[4].n_access, found[4].n_hex) == (1, 1) and found[5].n_assign == 0 and found[6].n_assign == 0
    assert secrets_scan.redact(rows[0][1], found[1].spans) == "é [assign]' and token=short"


def test_markov_model_finds_random_strings(spark):
    rng = np.random.default_rng(0)
    random = ["".join(rng.choice(list(secrets_scan.ALPHABET[:62]), 40)) for _ in range(300)]
    ordinary = [f"{a}_{b}_{c}" for a in ("get", "set", "load") for b in ("user", "account", "customer") for c in ("name", "identifier", "value")] * 20
    samples = spark.createDataFrame([(x, True) for x in random] + [(x, False) for x in ordinary], "run string, secret boolean")
    ratio = secrets_scan.train_markov(samples)
    letters = list(secrets_scan.ALPHABET[:62])
    drawn = lambda n: "".join(rng.choice(letters, n))
    spans = lambda text, base=None: secrets_scan.markov_spans(text, secrets_scan.Scorer(ratio), secrets_scan.base_spans(text) if base is None else base)
    assert spans("x " + drawn(32) + " y", []) == [(2, 3, 34)]
    assert spans("load_customer_identifier_value get_account_identifier", []) == []
    # Short ones too, and what a pattern leaves of a run.
    assert sum(spans(f"use {drawn(14)} here", []) == [(4, 3, 18)] for _ in range(200)) > 180
    assert spans("k=" + "0f" * 16 + "_" + (tail := drawn(20))) in ([(34, 3, 55)], [(35, 3, 55)]) and len(tail) == 20
    assert secrets_scan._left(5, 30, ([0, 10, 28], [6, 12, 40])) == [(6, 10), (12, 28)]
    assert not secrets_scan.train_markov(samples.filter("false")).any()


def test_audio(make):
    media = audio.store_texts_as_audio(make(EDGES, **CLASHES))
    blocks = audio.store_features(media)
    found = audio.read_features(blocks).toPandas()
    assert len(found) == len(EDGES) and set(found[found.n_bytes == 0].payload_bytes) == {64}
    stored = [audio.tensors(r.features) for r in blocks.collect()]
    assert all(t.schema.field("tensor").type == audio.TENSOR and t.schema.field("tensor").type.shape == [audio.POOLED, audio.BANDS] for t in stored)
    by_id = {i: m for t in stored for i, m in zip(t["doc_id"].to_pylist(), t["tensor"].combine_chunks().to_numpy_ndarray(), strict=True)}
    assert all(np.array_equal(by_id[r.doc_id].ravel(), r.tensor) for r in found.itertuples() if r.doc_id in (4, 5, 7, 8))


def plain_features(text):
    """Frames, tensor and spans of a text by loops: zero-stuffed convolution, a Fourier sum, triangles, means and a state machine."""
    data = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
    x = [(b - 128) / 128 for b in data]
    up, down, taps, frame, hop, bands, rows = 2, 3, 16, 256, 128, 16, 8
    rate = 16_000 * up / down
    n = up * taps
    h = [np.sinc((i - (n - 1) / 2) / down) * (0.5 - 0.5 * np.cos(2 * np.pi * (i + 1) / (n + 1))) for i in range(n)]
    h = np.array(h) * up / sum(h)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    whole = np.concatenate([np.convolve(stuffed, h), np.zeros(n)])
    y = [whole[k * down + (taps // 2 - 1) * up] for k in range(-(-len(x) * up // down))]
    frames = max(1, -(-(len(y) - frame) // hop) + 1)
    y += [0.0] * ((frames - 1) * hop + frame - len(y))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (bands + 1) / 2595) - 1) for k in range(bands + 2)]
    angle = np.outer(np.arange(frame // 2 + 1), np.arange(frame)) * 2 * np.pi / frame
    out, energy = [], []
    for t in range(frames):
        part = np.array(y[t * hop : t * hop + frame])
        windowed = part * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / (frame - 1)))
        power = (np.cos(angle) @ windowed) ** 2 + (np.sin(angle) @ windowed) ** 2
        row = []
        for k in range(bands):
            low, mid, high = edges[k : k + 3]
            row.append(np.log(1e-6 + sum(p * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) for p, f in zip(power, np.arange(frame // 2 + 1) * rate / frame, strict=True))))
        out.append(row)
        energy.append(np.log((part**2).mean() + 1e-9))
    pooled = []
    for r in range(rows):
        a, b = int(r * frames / rows), int((r + 1) * frames / rows)
        pooled.append(np.mean(out[a : max(a + 1, b)], axis=0))
    level = (np.array(energy) - np.mean(energy)) / (np.std(energy) + 1e-9)
    spans, start = [], None
    for t, e in enumerate(level):
        if start is None and e > 0.5:
            start = t
        elif start is not None and e < -0.25:
            spans.append((start * hop / rate, t * hop / rate))
            start = None
    return frames, np.array(pooled), spans + ([(start * hop / rate, frames * hop / rate)] if start is not None else [])


def test_audio_features_by_brute_force(make):
    rng = np.random.default_rng(2)
    texts = ["", "one", "a plain sentence of some words, and ends. " * 30, ("." * 2000 + "~" * 2000) * 3, "".join(map(chr, rng.integers(32, 500, 3_000)))]
    found = {r.doc_id: r for r in audio.audio_features(audio.store_texts_as_audio(make(texts))).collect()}
    for i, text in enumerate(texts):
        frames, pooled, spans = plain_features(text.encode())
        assert found[i].frames == frames and np.abs(np.array(found[i].tensor).reshape(pooled.shape) - pooled).max() < 2e-2
        assert np.allclose(list(zip(found[i].starts, found[i].ends, strict=True)), spans, atol=1e-9)
    assert any(len(plain_features(t.encode())[2]) > 1 for t in texts)


def test_audio_signal_processing():
    t = np.arange(16_000) / 16_000
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    half = audio.resample(tone, 1, 2)
    assert len(half) == 8_000 and np.abs(half[200:-200] - np.sin(2 * np.pi * 440 * np.arange(8_000) / 8_000)[200:-200]).max() < 0.1
    assert len(audio.resample(tone, 3, 4)) == 12_000
    quiet = np.concatenate([np.zeros(8_000), tone, np.zeros(8_000)]).astype(np.float32)
    mel, energy = audio.log_mel(quiet, 16_000)
    assert mel.shape == (len(energy), audio.BANDS) and len(audio.segments(energy)) == 1
    assert audio.from_wav(audio.to_wav(b"\x00\x80\xff\x01")) == (audio.RATE, b"\x00\x80\xff\x01")


def test_quality(make):
    rows = EDGES + [(20 + i, f"A plain sentence number {i} follows here. It says nothing of note, and ends.") for i in range(40)] + [(80 + i, "BUY!! NOW!! " * (5 + i)) for i in range(8)]
    docs = make(rows, **CLASHES)
    model = quality.train_quality(docs)
    found = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert not found[1].keep and not found[2].keep and not found[3].keep and found[1].score == 0
    assert all(found[20 + i].keep for i in range(40)) and not any(found[80 + i].keep for i in range(8))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and set(model.labels.accuracies()) == {n for n, _, _ in quality.LABELLERS}


def test_repeats_count_in_the_whole_text():
    rng = np.random.default_rng(4)
    for n in (0, 1, 199, 200, 201, 700):
        words = [b"w%d" % i for i in rng.integers(0, 150, n)]
        size = min(n, quality.WINDOW)
        windows = [words[i : i + size] for i in range(n - size + 1)] if n else []
        expected = np.mean([1 - len(set(w)) / size for w in windows]) if n else 0
        assert abs(quality.repeat_share(words) - expected) < 1e-9
    varied, phrase = b" ".join(b"v%d" % i for i in range(200)), b"buy three cheap watches " * 400
    (at,) = (quality.mix(np.array([3 + (1 << 32)], np.uint64)) >> np.uint64(64 - quality.DIM_BITS)).tolist()
    value = lambda text: dict(zip(*map(np.ndarray.tolist, quality.features(text)), strict=True)).get(at, 0.0)
    assert value(phrase + varied) > 0.8 and value(varied + b" " + phrase) > 0.8  # was 0 and 0.99
    assert value(b" ".join(b"x%d" % i for i in range(4000)) + b" " + phrase[: 24 * 10]) < 0.2


def test_label_model_recovers_accuracies():
    """Planted rates, among them labellers that are often wrong on good documents."""
    rng = np.random.default_rng(0)
    truth = rng.random(200_000) < 0.8
    cast = np.full((len(truth), len(quality.LABELLERS)), quality.NONE)
    planted = [(0.7, 0.01), (0.5, 0.02), (0.8, 0.12), (0.6, 0.25), (0.9, 0.05)]  # bad votes on bad and on good documents
    for i, (hit, false) in enumerate(planted):
        bad = np.where(truth, rng.random(len(truth)) < false, rng.random(len(truth)) < hit)
        cast[:, i] = np.where(rng.random(len(truth)) < 0.1, quality.NONE, np.where(bad, quality.BAD, quality.GOOD))
    patterns, n = np.unique((cast * 3 ** np.arange(cast.shape[1])).sum(axis=1), return_counts=True)
    model = quality.fit_label_model(dict(zip(patterns.tolist(), n.tolist(), strict=True)))
    assert abs(model.prior - 0.8) < 0.01
    for i, (hit, false) in enumerate(planted):
        assert abs(model.rates[i, quality.BAD, quality.BAD] - hit) < 0.02 and abs(model.rates[i, quality.GOOD, quality.BAD] - false) < 0.02
    right = (model.posterior((cast * 3 ** np.arange(cast.shape[1])).sum(axis=1)) >= 0.5) == truth
    assert right.mean() > 0.97
    name = quality.LABELLERS[3][0]
    assert abs(model.accuracies()[name] - (0.6 * 0.2 + 0.75 * 0.8)) < 0.02


def test_quality_query_by_brute_force(spark):
    """op2 of a small table: patterns and posteriors from plain EM over its documents, scores from its weights."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    texts = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").df()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train_quality(docs)
    found = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    votes = [[quality.votes(t.encode()) // 3**i % 3 for i in range(len(quality.LABELLERS))] for t in texts.text]
    prior, rates = quality.PRIOR, [[list(quality.EXPECTED[0]), list(quality.EXPECTED[1])] for _ in quality.LABELLERS]

    def posterior(row):
        p = [1 - prior, prior]
        for i, v in enumerate(row):
            if v < 2:
                p = [p[c] * rates[i][c][v] for c in (0, 1)]
        return p[1] / sum(p)

    for _ in range(500):
        good = [posterior(row) for row in votes]
        weight = [1 - quality.PRIOR, quality.PRIOR]
        sums = [[[quality.PRIOR_ROWS * weight[c] * quality.EXPECTED[c][v] + sum((g if c else 1 - g) for g, row in zip(good, votes, strict=True) if row[i] == v) for v in (0, 1)] for c in (0, 1)] for i in range(len(rates))]
        new = [[[x / sum(pair) for x in pair] for pair in both] for both in sums]
        change, rates = max(abs(a - b) for p, q in zip(new, rates, strict=True) for u, v in zip(p, q, strict=True) for a, b in zip(u, v, strict=True)), new
        prior = (sum(good) + quality.PRIOR * quality.PRIOR_ROWS) / (len(votes) + quality.PRIOR_ROWS)
        if change < 1e-10:
            break
    for doc_id, text, row in zip(texts.doc_id, texts.text, votes, strict=True):
        at, x = quality.features(text.encode())
        z = sum(model.weights.get(int(k), 0.0) * v for k, v in zip(at, x, strict=True))
        r = found[doc_id]
        assert abs(r.posterior - posterior(row)) < 1e-6 and abs(r.score - 1 / (1 + np.exp(-z))) < 1e-5 and r.keep == (r.score >= quality.THRESHOLD)


def test_toxicity(spark, make):
    docs = make([(i, f"text {i} of a calm kind" + (" you vile fool" if i % 5 == 0 else "")) for i in range(200)] + EDGES, **CLASHES)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs.filter("doc_id >= 20"), labels)
    scores = toxicity.score_toxicity(docs, model).toPandas()
    assert len(scores) == len(EDGES) + 200 and scores.score.between(0, 1).all() and len(model) < 100
    calm, vile = scores[scores.doc_id.isin([101, 102])].score, scores[scores.doc_id.isin([100, 105])].score
    assert calm.max() < 0.3 and vile.min() > 0.7
    assert toxicity.train_toxicity(docs, labels.filter("false")) == {}


def test_ftrl_against_the_plain_algorithm():
    """FTRL-proximal coordinate by coordinate, as published, and the query's scores from the model's weights."""
    from ledgerline.llm.ftrl import Ftrl

    rng = np.random.default_rng(3)
    rows = [(np.unique(np.append(rng.integers(1, 40, 6), 0)), float(rng.random() < 0.3)) for _ in range(300)]
    rows = [(at, rng.random(len(at)) + 0.5, y, 1.0 + 2 * y) for at, y in rows]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.4, 0.2
    z, n = [0.0] * 40, [0.0] * 40

    def weight(i):
        bound = 0.0 if i == 0 else l1  # the bias is not penalised by L1
        return 0.0 if abs(z[i]) <= bound else -(z[i] - np.sign(z[i]) * bound) / ((beta + n[i] ** 0.5) / alpha + l2)

    model = Ftrl(40, alpha, beta, l1, l2)
    for at, x, y, scale in rows:
        w = {i: weight(i) for i in at.tolist()}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x, strict=True))))
        for i, v in zip(at.tolist(), x, strict=True):
            g = scale * (p - y) * v
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        model.learn(at, x, y, scale)
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and np.allclose(model.weights(np.arange(40)), [weight(i) for i in range(40)])
    assert 0 < sum(weight(i) == 0 for i in range(1, 40)) < 39


def test_toxicity_query_by_brute_force(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels.filter(~toxicity.held_out()).select("doc_id", "toxic"))
    from ledgerline.llm.queries import QUERIES

    found = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall():
        z = model.get(0, 0.0) + sum(model.get(i, 0.0) for i in {int(i) for i in toxicity.coordinates(text.encode())} - {0})
        r = found[doc_id]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-5 and r.predicted == int(r.score >= 0.7)


EMPTY = {
    "mark": exact_dedup.mark_duplicates, "drop": exact_dedup.drop_duplicates, "shard": sharding.shard_by_bytes, "mix": mixing.mix_copies, "mixed": mixing.mix_documents,
    "pack": lambda d: packing.pack_documents(d, TOKENIZER, 1), "near": near_dedup.near_duplicates, "drop_near": near_dedup.drop_near_duplicates,
    "secrets": lambda d: secrets_scan.scan_secrets(d, secrets_scan.train_markov(secrets_scan.weak_samples(d))), "audio": lambda d: audio.audio_features(audio.store_texts_as_audio(d)),
    "quality": quality.keep_good, "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.train_toxicity(d, d.select("doc_id", F.lit(1).alias("toxic")))),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_table(spark, name):
    assert EMPTY[name](spark.createDataFrame([], DOCS)).count() == 0


def test_empty_token_files(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], DOCS), f"file://{tmp_path}/t", TOKENIZER)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/t").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], folder).cache())
    assert all(d.columns == docs.columns for d in seen[:-1])
    good, exact, near, mixed, packed = (d.count() for d in seen[1:])
    assert docs.count() > good > exact > near > 0 and mixed > 0
    total = seen[-1].agg(F.sum("length")).first()[0]
    assert seen[-1].agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048 and packed >= mixed and total > 0
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_stages_on_edge_cases(spark, make):
    """Nulls in any column, empty and long texts, ties, repeats, clashing columns; and an empty table."""
    import corpus_pipeline

    good = [(100 + i, f"A plain sentence number {i} follows here, about {'rivers' if i % 2 else 'mills'}. It says nothing of note, and ends.", ["a", None, "b"][i % 3]) for i in range(12)]
    long = " ".join(f"word{i % 977} of{i}" for i in range(60_000))
    docs = make([*EDGES, *good, good[3], (300, long), (301, long + " end"), (None, good[0][1], "a")], **CLASHES)
    stages = dict(corpus_pipeline.STAGES)
    counts = {}
    for name in ("quality_classifier", "exact_dedup", "near_dedup", "mixing"):
        out = stages[name](spark, docs, "/nowhere")
        rows = out.collect()
        counts[name] = len(rows)
        assert out.columns == docs.columns and all(r.kept_id == "x" and r.lang == "en" for r in rows)
        ids = [r.doc_id for r in rows]
        if name == "quality_classifier":
            assert all(r.text and r.text.strip() for r in rows) and {100 + i for i in range(12)} <= set(ids)
        if name == "exact_dedup":  # 1 and 2 are equal, 5 and 6 too, the null id repeats 100
            assert len(rows) == len({r.text or "" for r in rows}) and {1, 3, 5, 100, 300, 301} <= set(ids) and not {2, 6} & set(ids)
        if name == "near_dedup":
            assert 300 in ids and 301 not in ids and {1, 2, 3} <= set(ids)
    packed = stages["packing"](spark, docs, "/nowhere").toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and packed[packed.doc_id == 300].length.sum() == packed[packed.doc_id == 300].doc_tokens.iloc[0] > 2048
    assert counts["mixing"] > 0
    empty = spark.createDataFrame([], DOCS)
    assert all(stage(spark, empty, "/nowhere").count() == 0 for stage in stages.values())
