"""Operator 13 against whole-text tokenisation and plain Python."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quern.llm import alignment as m
from quern.llm.registry import op13_token_alignment
from tests.compare import SMALL

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, pair int, block string"


def brute(rows):
    a, b, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), m.byte_level()
    a.encode_special_tokens = True
    found, held = [], Counter()
    for key, text in rows:
        groups = []
        if text:
            one, two = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            raw_one = [bytes(back[c] for c in x) for x in one.tokens]
            raw_two = [bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode() for i, x in ((i, b.id_to_piece(i)) for i in two)]
            if b"".join(raw_one) == b"".join(raw_two) == (" " + text).encode():
                ends = []
                for raw in (raw_one, raw_two):
                    at, own = 0, []
                    for x in raw:
                        at += len(x)
                        own.append(at)
                    ends.append(own)
                shared = sorted({*ends[0]} & {*ends[1]})
                lo = 0
                for hi in shared:
                    groups.append(([i for i, e in zip(one.ids, ends[0], strict=True) if lo < e <= hi], [i for i, e in zip(two, ends[1], strict=True) if lo < e <= hi]))
                    lo = hi
        links = [(x, y) for p, q in groups for x in p for y in q]
        held.update({*links})
        found.append((key, groups, links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for key, groups, links in found:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        numbers = [sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links)]
        out.append((key, *numbers, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(5)
    parts = ["the", " The", "  ", "\n", "\t", "\r\n", "don't", "1234", "é", "naïve", "日本語", "🙂", " ", "　x", " ", "<|endoftext|>", "<s>", "</s>", "<unk>", "▁", " ▁a", "<0x41>", "\x00", "\x1c", "...", "—", " — ", "a" * 70, "ﬁ", "é", "​", " .", "'s", " 's", "//", "{}", "foo_bar"]
    for _ in range(400):
        yield "".join(rng.choice(parts) + rng.choice(["", "", " ", " ", "  "]) for _ in range(rng.randint(0, 12)))


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(3)
    return sorted((tuple(r) for r in m.alignments(docs, A, B).collect()), key=repr)


@pytest.mark.parametrize("group", [8 << 20, 100])
def test_odd_texts(spark, monkeypatch, group):
    monkeypatch.setattr(m, "GROUP_PAIRS", group)
    rows = [*enumerate(texts()), (None, None), (None, "the same"), (7, "the same"), (7, "the same"), (-1, ""), (-2, " "), (-3, "x" * 3000), (-4, "word " * 3000), (-5, "ab" * 40 + " c" * 70), (-6, " lead and trail ")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_token_alignment(spark, SMALL).collect()), key=repr) == brute(rows)


def test_small_memory_gives_the_same(monkeypatch):
    """A worker that forgets its windows, sees hashes meet, or small portions, aligns alike."""
    import numpy as np
    import pyarrow as pa

    from quern.llm.spans import text_bytes

    data, offs = text_bytes(pa.array([*texts(), "one two one two three " * 50]))
    want = m.Aligner(A, B).align(data, offs)
    few = m.Aligner(A, B)
    monkeypatch.setattr(m, "KNOWN", 10)
    for _ in range(2):
        assert all(str(x) == str(y) if isinstance(x, list) else (x == y).all() for x, y in zip(few.align(data, offs), want, strict=True))
    monkeypatch.setattr(m, "KNOWN", 1 << 20)
    monkeypatch.setattr(m, "chain", lambda words, starts, sizes: (starts % 7).astype(np.uint64))
    clash = m.Aligner(A, B)
    for _ in range(2):
        assert all(str(x) == str(y) if isinstance(x, list) else (x == y).all() for x, y in zip(clash.align(data, offs), want, strict=True))
