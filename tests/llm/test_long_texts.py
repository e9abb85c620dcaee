"""One text of a few megabytes through the operators on texts, beside short ones: it is read whole, and the others stay right."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import alignment, collocations, licenses, mixing, ngram_jaccard, packing, quality, token_counts, toxicity, warc
from quern.sources.scratch import new_folder

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400_000)) + ". mit license"
    return [long, "a few words only", long[:1000], "", None]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"src{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(2)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_tokens(frame, texts):
    library = Tokenizer.from_file(WORDS)
    n = len(library.encode(texts[0], add_special_tokens=False).ids)
    assert n > 400_000 and by_id(token_counts.token_counts(frame, WORDS))[0].n_tokens == n
    pieces = packing.pack(frame, WORDS, window=4096, end_id=2).where("doc_id = 0").collect()
    assert sum(r.length for r in pieces) == n + 1 == pieces[0].doc_tokens


def test_words(frame, texts):
    n = len(texts[0].split())
    assert by_id(mixing.mixed(frame))[0].size == n
    found = by_id(ngram_jaccard.near_duplicates(frame))
    assert found[0].n_shingles == n - 4 and [found[k].component_id for k in range(5)] == [*range(5)]
    scan = by_id(licenses.licenses(frame))[0]
    assert scan.n_words == n and scan.n_base == 1 and scan.first_word == n - 2 and scan.base_labels == "mit"


def test_phrases(frame, texts):
    found = {r.phrase: r.a for r in collocations.collocations(frame, least=2).collect()}
    words = texts[0].partition(".")[0].split()
    some = " ".join(words[10:12])
    assert found.get(some, 2) == sum(" ".join(p) == some for t in (words, texts[2].split()) for p in zip(t, t[1:], strict=False)) or some in found


def test_alignment(frame, texts):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    library = Tokenizer.from_file(a)
    library.encode_special_tokens = True
    found = by_id(alignment.alignments(frame, a, b))
    assert found[0].n_a == len(library.encode(" " + texts[0], add_special_tokens=False).ids) and found[3].n_a == found[4].n_links == 0


def test_archives_and_scores(spark, frame, texts):
    path = warc.write(frame, new_folder(spark, "warc"), key="doc_id", url="source", body="text")
    rows = by_id(warc.pages_of(warc.captures(warc.read(spark, path)), key="doc_id"))
    assert rows[0].payload_bytes == len(re.sub(r"[^\x00-\x7f]", "", texts[0])) and rows[4].refers_to == 3
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(5)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert all(0 <= r.score <= 1 for r in module.score(frame, module.train(frame, labels)).collect())
