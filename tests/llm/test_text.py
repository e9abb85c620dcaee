"""Token counts, packing, licenses and the byte kernels under them."""

import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quern.llm import licenses, ngram_jaccard, packing, pieces, token_counts
from quern.llm.pieces import Encoder, WholeEncoder, cuts_by_character_kind
from quern.llm.registry import ORACLE_SQL, QUERIES
from quern.llm.spans import blocks, fresh_seeds, shingles, text_bytes, word_hashes
from tests.compare import SMALL, assert_same, duck

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "   \n\t", "a", "it's it'solid !'s 'S", "x<|endoftext|>y <|ENDOFTEXT|> <|endoftext|>", "É é ΟΔΟΣ Σας … !…! a\x1cb\x85z", "漢字かな 12a3'4 ½ \x00\x01", "word " * 3000, "MIT License " * 3]
DOCS = "doc_id long, text string, source string, key string, ids int, n double, at string, score string"


def docs(spark, texts, sources=None, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    return spark.createDataFrame([(i if ids is None else ids[i], t, sources[i], "k", 1, 0.5, "at", "x") for i, t in enumerate(texts)], DOCS)


def library_ids(text):
    return Encoder.of(PATH).library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAsSlL'’.,!<|>12 \n\t\x0b\x1cé́ßΣ漢½-_"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_pieces_are_what_the_library_gives(texts):
    data, offs = text_bytes(pa.array(texts, pa.string()))
    ids, ends = Encoder.of(PATH).encode(data, offs)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [library_ids(t) for t in texts]
    assert Encoder.of(PATH).counts(data, offs).tolist() == [len(library_ids(t)) for t in texts]


def test_other_tokenizers_encode_whole_texts():
    assert cuts_by_character_kind(PATH) and not cuts_by_character_kind(public_tokenizers.path("byte_bpe_50k.json"))
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    data, offs = text_bytes(pa.array(ODD))
    assert WholeEncoder(path).counts(data, offs).tolist() == [len(own.encode(t or "")) for t in ODD]


def test_blocks_cut_long_texts_at_white_space():
    texts = ["ab cd " * 50, "", "x" * 300, "end"]
    data, offs = text_bytes(pa.array(texts))
    cut = list(blocks(data, offs, 40))
    assert cut[0][0] == 0 and cut[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    for _, hi in cut:
        assert hi in offs or data[hi - 1] == 32
    hashes, text, starts = word_hashes(data, offs)
    words = [w for t in texts for w in t.split()]
    assert len(hashes) == len(words) and len({*hashes.tolist()}) == len({*words})
    assert np.bincount(text, minlength=4).tolist() == [100, 0, 1, 1] and starts[0] == 0


def test_shingles_by_brute_force():
    texts = ["a b c d e f", "A b C d e f", "a b c", "a  b\tc", "", None, "a b c d e a b c d e a b c d e", " x"]
    data, offs = text_bytes(pa.array(texts))
    hashes, ends = shingles(data, offs, 5)
    sets = [{*hashes[a:b].tolist()} for a, b in zip(ends, ends[1:], strict=False)]
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 5, 1] and sets[0] == sets[1] and sets[2] == sets[3]


def test_token_counts(spark):
    found = {r.doc_id: r for r in token_counts.token_counts(docs(spark, [*ODD, ODD[4]]), PATH).collect()}
    for i, t in enumerate([*ODD, ODD[4]]):
        n = len(library_ids(t))
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert token_counts.token_counts(docs(spark, []), PATH).count() == 0


def check_pieces(rows, texts, window, end_id=2):
    """Every id of every text lies in one piece, and sequences have no gap and no padding."""
    want = {i: [*library_ids(t), end_id] for i, t in texts.items()}
    at, sequences = dict.fromkeys(want, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at[r.doc_id] and r.length == len(ids) and r.doc_tokens == len(want[r.doc_id])
        assert ids == want[r.doc_id][r.start : r.start + r.length]
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.source))
    assert at == {i: len(x) for i, x in want.items()}
    for pieces in sequences.values():
        end = 0
        for offset, length, _ in sorted(pieces):
            assert offset == end
            end += length
        assert end == window or end & (end - 1) == 0
    return sequences


@pytest.mark.parametrize("small", [200_000, -1])
def test_packing(spark, small, monkeypatch):
    """Also where the carried deficits are joined instead of broadcast."""
    monkeypatch.setattr(packing, "SMALL", small)
    monkeypatch.setattr(packing, "FINE", 1 << 12)
    texts = [*ODD, ODD[4]]
    rows = packing.pack(docs(spark, texts, [None if i == 3 else f"s{i % 3}" for i in range(len(texts))]), PATH, window=256, least=8).collect()
    check_pieces(rows, dict(enumerate(texts)), 256)
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_packing_keeps_proportions(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["red", "green", "blue", "tree"]) for _ in range(rng.randint(20, 400))) for _ in range(400)]
    sources = ["big" if i % 2 else f"s{i % 6}" for i in range(len(texts))]
    rows = packing.pack(docs(spark, texts, sources), PATH, window=1024, least=32).collect()
    sequences = check_pieces(rows, dict(enumerate(texts)), 1024)
    every = sum(r.length for r in rows)
    share = sum(r.length for r in rows if r.source == "big") / every
    full = [s for s in sequences.values() if sum(x[1] for x in s) == 1024]
    assert len(full) > 40
    inside = [sum(x[1] for x in s if x[2] == "big") / 1024 for s in full]
    assert abs(np.mean(inside) - share) < 0.05 and np.quantile(np.abs(np.array(inside) - share), 0.8) < 0.15


def test_rows_of_one_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 1000)
    rows = packing.pack(docs(spark, ["red green blue tree"] * 400, ids=[None] * 400), PATH, window=64).select((F.shiftright("sequence_id", 32)).alias("part"), "length").collect()
    parts = {}
    for r in rows:
        parts[r.part] = parts.get(r.part, 0) + r.length
    assert sum(parts.values()) == 400 * 5 and len(parts) >= 6 and max(parts.values()) < 2 * 2000 / len(parts)


def thue_morse(n, a, b):
    x = [0]
    while len(x) < n:
        x += [1 - v for v in x]
    return "".join((a, b)[v] for v in x), "".join((b, a)[v] for v in x)


@pytest.mark.parametrize("n", [64, 1024, 2048, 8192])
def test_words_made_to_collide_stay_apart(spark, n):
    """Thue-Morse words and their complements, which polynomials modulo a power of two can't tell apart."""
    texts = [w for a, b in (("t", "h"), ("s", "x"), ("a", "b")) for w in thue_morse(n, a, b)]
    data, offs = text_bytes(pa.array(texts))
    assert len({*word_hashes(data, offs)[0].tolist()}) == len(texts)
    ids, ends = Encoder.of(PATH).encode(data, offs)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [library_ids(t) for t in texts]
    if n == 1024:
        assert [r.n_tokens for r in token_counts.token_counts(docs(spark, texts), PATH).orderBy("doc_id").collect()] == [len(library_ids(t)) for t in texts]
        check_pieces(packing.pack(docs(spark, texts), PATH, window=256).collect(), dict(enumerate(texts)), 256)
        assert len({r.component_id for r in ngram_jaccard.near_duplicates(docs(spark, texts)).collect()}) == len(texts)


def components_of(spark, texts):
    return [r.component_id for r in ngram_jaccard.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()]


def test_texts_that_share_no_word_are_not_linked(spark):
    """Words whose public 48-bit or 64-bit hashes are equal, alone and before a shared end."""
    made = ["innocentdocumen1", "ozx8uzzv%5/{mbg7"]
    texts = ["fhrftger", "fkrpzlrn", *made, *(f"{w} a b c d e" for w in made)]
    assert components_of(spark, texts) == [*range(6)]


def test_few_ngrams_only_link_with_themselves(spark):
    """Sets that are too small for a similar other one have no candidates, whatever their hashes; from four on they have."""
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(words[:n]) for n in (6, 7, 8, 9, 10)] + [" ".join(words[:7])]
    # sets of 2, 3, 4, 5, 6 and 3: 4 of 5 and 5 of 6 are 80 % and more
    assert components_of(spark, texts) == [0, 1, 2, 2, 2, 1]
    assert [ngram_jaccard.least_size(p) for p in (80, 50, 100)] == [4, 1, float("inf")]


def test_seeds_differ_between_jobs_and_results_do_not(spark):
    texts = [f"{k % 5} one two three four five six seven eight nine ten {k % 3} eleven twelve" for k in range(60)]
    assert components_of(spark, texts) == components_of(spark, texts)
    one, two = (word_hashes(*text_bytes(pa.array(texts)), seeds=fresh_seeds())[0] for _ in range(2))
    assert not {*one.tolist()} & {*two.tolist()} and len({*one.tolist()}) == len({*two.tolist()})


def test_equal_digests_draw_new_seeds(spark, monkeypatch):
    real, calls = ngram_jaccard.clash, []
    monkeypatch.setattr(ngram_jaccard, "clash", lambda members: calls.append(1) or len(calls) == 1 or real(members))
    assert components_of(spark, ["a b c", "a b c", "d"]) == [0, 0, 2] and len(calls) == 2


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    """The known pieces are compared byte for byte, so even a hash that is always the same gives the library's ids."""
    monkeypatch.setattr(pieces, "chain", lambda words, starts, sizes: np.zeros(len(starts), np.uint64))
    own = Encoder(PATH)
    texts = ["red green blue", "Red tree 12 blue-green", "abcdefgh abcdefghi ABCDEFGHij", "blue"]
    data, offs = text_bytes(pa.array(texts))
    assert own.counts(data, offs).tolist() == [len(library_ids(t)) for t in texts]


def test_a_huge_word_needs_little_memory():
    data = np.full(200_000_000, 97, np.uint8)
    tracemalloc.start()
    hashes, ends = shingles(data, np.array([0, len(data)]), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == 1 and peak < 8 << 20


def test_deficits_are_carried():
    a, b = packing.Queue(0.75, -40.0), packing.Queue(0.25, 40.0)  # an earlier partition gave a 40 too many
    a.add("a", "a", np.arange(1000))
    b.add("b", "b", np.arange(1000))
    taken = [sum(len(p[3]) for p in packing.fill([a, b], 100, 1) if p[0] == "b") for _ in range(3)]
    assert taken == [65, 25, 25]
    assert list(packing.sizes(4096 + 7, 4096)) == [4096, 4, 2, 1] and list(packing.sizes(0, 4096)) == []


def brute_licenses(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    return len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places}))


def test_licenses(spark):
    texts = [*ODD, "x Licensed under the Apache License, Version 2.0. y MIT license", "All rights reserved", "Released under the MIT License.", "licensed under GNU stuff", "under the terms of the GNU Lesser General Public License", "Copyright (c) 2020 Ann Lee. ALL RIGHTS RESERVED.", "licensed under CC BY-NC 4.0", "é mit licence MIT LICENSE " + "pad " * 5000 + "mit license"]
    found = {r.doc_id: r for r in licenses.licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t)
    labels = [found[len(ODD) + i].labels for i in range(8)]
    assert labels == ["apache,apache-2.0-notice,mit", "all-rights-reserved", "mit,mit-notice", "", "gpl,lgpl-notice", "all-rights-reserved", "cc-by-nc-notice", "mit"]
    assert [found[len(ODD) + i].score for i in (0, 3, 7)] == [0.75, 0.0, 0.5]
    assert licenses.licenses(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SMALL), duck(SMALL), ORACLE_SQL[name])
