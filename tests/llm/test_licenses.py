"""Whole licences, altered ones, and the markup of templates."""

import re

import numpy as np
import pytest

from quern.llm import license_templates as fixed
from quern.llm import licenses
from quern.llm.spans import word_hashes
from tests.llm.test_text import docs


def original(markup):
    """A template with all optional regions and the original of each replaceable one."""
    text = re.sub(r"<<(begin|end)Optional>>", " ", markup)
    return re.sub(r"<<var;name=.*?;original=(.*?);match=.*?>>", r"\1", text, flags=re.S)


def shortest(markup):
    """A template without its optional regions (also nested ones)."""
    while "<<beginOptional>>" in markup:
        markup = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", " ", markup, flags=re.S)
    return original(markup)


@pytest.mark.parametrize("form", [original, shortest])
def test_each_template_matches_itself_and_no_altered_text(spark, form):
    texts = [form(markup) for _, markup in fixed.TEMPLATES]
    altered = []
    for text in texts:
        words = text.split()
        middle = next(k for k in range(len(words) * 3 // 4, len(words)) if words[k].isalpha())
        altered += [" ".join(words[:middle] + words[middle + 1 :]), " ".join(words[:middle] + ["never"] + words[middle:]), " ".join(words[:-1] + ["quickly"])]
    found = {r.doc_id: r for r in licenses.licenses(docs(spark, texts + altered)).collect()}
    for i, (label, _) in enumerate(fixed.TEMPLATES):
        assert label in found[i].labels.split(",") and found[i].score == 1.0, label
        assert [m for m in found[i].matches if m.label == label]
    for i in range(len(texts), len(texts) + len(altered)):
        of = fixed.TEMPLATES[(i - len(texts)) // 3][0]
        assert of not in {m.label for m in found[i].matches} and found[i].score < 1.0, (i, of)


def test_altered_conditions_are_refused(spark):
    mit = original(fixed.MIT)
    texts = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: you pay us one million dollars and never redistribute",
        mit.replace("without restriction, including", "without restriction, except that commercial use is forbidden, including"),
        mit.replace("THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil. THE SOFTWARE IS PROVIDED"),
        mit[: mit.index("THE SOFTWARE IS PROVIDED")],
        original(fixed.GRANT),
        "text before. " + mit + " text after. " + mit,
    ]
    found = {r.doc_id: r for r in licenses.licenses(docs(spark, texts)).collect()}
    assert [found[i].score < 1.0 for i in range(6)] == [True] * 5 + [False]
    assert all(not {"mit", "bsd-2-clause", "bsd-3-clause"} & {*found[i].labels.split(",")} - {*found[i].base_labels.split(",")} for i in range(5))
    assert len([m for m in found[5].matches if m.label == "mit"]) >= 2


def test_markup():
    with pytest.raises(ValueError):
        list(licenses.parsed("a <<unknown>> b"))
    assert list(licenses.parsed("A-b <<beginOptional>>c<<endOptional>> <<var;name=x;original=y;match=.{0,2}>> <<var;name=x;original=y;match=p q|r>>")) == [("word", "a"), ("word", "b"), ("begin", None), ("word", "c"), ("end", None), ("words", (0, 2)), ("any", [["p", "q"], ["r"]])]


def test_automaton_regions():
    a = licenses.Automaton((("t", "one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> <<var;name=v;original=x;match=x|y y>> <<var;name=v;original=w;match=.{1,2}>> end"),), {})
    for text, match in (("one x w end", True), ("one two x w w end", True), ("one two three y y w end", True), ("one three x w end", False), ("one x end", False), ("one x w w w end", False), ("one z w end", False), ("one y w end", False)):
        words = text.split()
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        hashes, _, starts = word_hashes(data, np.array([0, len(data)]))
        assert bool(list(a.accepted(a.classify(hashes, data, starts, np.full(len(hashes), len(data)))))) == match, text


def test_a_word_that_only_has_the_hash_of_another_counts_nothing(spark):
    texts = ["mit 7dll0iiegnzttn5v", "mit license", "mit licens", "MIT LICENSE", "mit licenses", "x mit license"]
    rows = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [r.n_base for r in rows] == [0, 1, 0, 1, 0, 1] and rows[0].base_labels == "" and rows[5].first_word == 1


def test_hits_are_compared(monkeypatch):
    """Even if all words have one hash, only the templates' own words are taken for them."""
    monkeypatch.setattr(licenses, "hash_runs", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    a = licenses.Automaton((), {"mit license": "mit"})
    data = np.frombuffer(b"mit license mit", np.uint8)
    found = a.classify(np.zeros(3, np.uint64), data, np.array([0, 4, 12]), np.full(3, len(data)))
    assert {*found.tolist()} <= {licenses.OTHER, 1} | {2} and (found != licenses.OTHER).sum() in (1, 2)
