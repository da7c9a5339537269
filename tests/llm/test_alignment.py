"""Alignments against whole texts in plain Python, and the edge cases."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ledgerline.llm import alignment

from .conftest import CLASHES, EDGES

ODD = ["a  b", " a b ", "a\nb\n  c", "x \n y \t z\t", "a \x1f b\x1c c", "two words a　b", "<|endoftext|> and <s> </s> <unk> <0x41>", "mark ▁ in it", "a▁b c d", "漢字 かな 한국어 text", "é ﬁ \U0001f600‍\U0001f469", "don't we'll I'M", "x" * 300 + " 12345678 " + "é" * 90, "\n", "  ", "\x00 nul", "tab\tafter one", "a\n  b", "٣٤ ½ ²", "▁", "a ▁ ▁b"]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    return a, b


def tokens(libraries, text):
    """(id, end) of both tokenizers' tokens; none if they do not spell the text."""
    a, b = libraries
    if not text:
        return [], []
    sides = []
    of = alignment.byte_level()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    sides.append([(i, bytes(of[c] for c in a.id_to_token(i))) for i in ids])
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
        return [], []
    for side in sides:
        end = 0
        for k, (i, x) in enumerate(side):
            side[k] = (i, end := end + len(x))
    return sides


def plain(libraries, texts):
    """The operator's numbers of each text, without doc_id."""
    all_groups, n = [], []
    for text in texts:
        a, b = tokens(libraries, text)
        ends, groups = sorted({e for _, e in a} & {e for _, e in b}), []
        rest = [iter(a), iter(b)]
        for high in ends:
            groups.append(([], []))
            for side, own in zip(rest, groups[-1], strict=True):
                end = 0
                while end < high:
                    i, end = next(side)
                    own.append(i)
        all_groups.append(groups)
        n.append((len(a), len(b)))
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in all_groups]
    count = Counter(p for each in links for p in set(each))
    top = Counter()
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    out = []
    for groups, each, (n_a, n_b) in zip(all_groups, links, n, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((n_a, n_b, len(groups), len(each), sum(count[p] == top[p[0]] for p in each), sum(count[p] for p in each), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def compare(make, libraries, rows, **extra):
    docs = make(rows, **extra)
    found = sorted(map(tuple, alignment.align_tokenizers(docs).collect()), key=str)
    ids = [r[0] if isinstance(r, tuple) else k for k, r in enumerate(rows)]
    texts = [r[1] if isinstance(r, tuple) else r for r in rows]
    assert found == sorted(((i, *x) for i, x in zip(ids, plain(libraries, texts), strict=True)), key=str)


def test_edges(make, libraries):
    compare(make, libraries, EDGES, **CLASHES)


def test_odd_texts(make, libraries):
    compare(make, libraries, ODD * 2)


def test_random_texts(make, libraries):
    draw = random.Random(11)
    parts = [" ", " ", "  ", "\n", "\t", "word", "Word", "ing", "é", "漢", "1", "23", ".", ",", "'s", "▁", " ", "́", "-", "<|endoftext|>", "\x1d", "\U0001f600"]
    compare(make, libraries, ["".join(draw.choices(parts, weights=[9, 9, *[1] * (len(parts) - 2)], k=draw.randrange(40))) for _ in range(400)])


def test_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    expected = [(i, *x) for (i, _), x in zip(rows, plain(libraries, [t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, alignment.align_tokenizers(docs.repartition(5)).collect())) == expected


def test_no_documents(make):
    found = alignment.align_tokenizers(make([]))
    assert found.collect() == [] and found.columns == [c.split()[0] for c in alignment.RESULT.split(", ")]


def test_a_long_text_without_spaces(libraries):
    draw = random.Random(2)
    text = "".join(chr(draw.randrange(97, 123)) for _ in range(400_000))
    columns, (codes, docs), _ = alignment.aligner().block(pa.array([text, None, "plain words"]))
    assert list(zip(*columns[:5], strict=True)) == [(n[0], n[1], n[2], n[3], n[6]) for n in plain(libraries, [text, None, "plain words"])]
    assert len(codes) == len(docs) > 0
