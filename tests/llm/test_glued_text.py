"""Personal data in long runs and in text without blanks."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tillsight.llm import pii
from tillsight.llm import words as W

PHONE = "(743)555-3824"


@pytest.fixture(scope="module")
def model():
    return pii.Crf().fit(pii.table_of_units(pii.labelled_table()))


def spans(model, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    found = [r for b in pii._find(model, "text", True)([batch]) for r in b.column("pii").to_pylist()]
    return [[(s["kind"], t[s["first"] : s["stop"]]) for s in r] for t, r in zip(texts, found)]


GLUED = [
    PHONE, f"call {PHONE}", "漢" * 6 + PHONE, "漢" * 60 + PHONE + "漢字", "a" * 45 + PHONE, "a" * 45 + ":" + PHONE,
    f"abc{PHONE}xyz", "é" * 50 + PHONE, "x" * 5000 + PHONE, "ж" * 300 + "/" + PHONE,
]


def test_glued_text_hides_nothing(model):
    assert spans(model, GLUED) == [[("phone", PHONE)]] * len(GLUED)
    assert spans(model, ["写信给jane (at) mail.com谢谢"]) == [[("email", "jane (at) mail.com")]]
    assert spans(model, ["a" * 45 + "1234567890123", "c4b1176ed980376689691f857649ee2b", "2023-01-15T10:22:33Z", "漢字" * 50]) == [[]] * 4


def test_every_character_of_a_unit_counts():
    assert pii._features("a" * 45 + "1" * 13) != pii._features("a" * 58)
    assert pii._features("a" * 70 + "1" * 13) != pii._features("a" * 83)
    long = "".join(random.Random(1).choice("ab1-") for _ in range(100_000))
    before = pii._kept_features.cache_info().currsize
    assert len(pii._features(long)) == pii.WIDTH and pii._kept_features.cache_info().currsize == before


def long_run(rng, n):
    forms = ["+12 345 678 9012", "4539 5787 6362 1486", "(743) 555-3824", "10.0.0.1", "555", "1234", "12.5"]
    out = []
    while len(out) < n:
        out += rng.choice(forms).split()
    return out[:n]


def test_long_runs_have_the_same_tags_in_any_number_of_steps(model):
    rng = random.Random(3)
    texts = [" ".join(long_run(rng, n)) for n in (1000, 1000, 700, 30, 1)]
    for _, _, data, offsets in W.text_blocks(pa.array(texts)):
        shapes = pii.plain_shapes(pii.split_units(data, offsets))
        runs = [pii.Run(shapes, a, z) for a, z in zip(shapes.bounds, shapes.bounds[1:])]
        features = [r[0 : len(r)] for r in runs]
        whole = model.decode(features, cells=10**6)
        for cells in (1, 64, 257, 999, 5000):
            for sequences in (features, runs):
                got = model.decode(sequences, cells=cells)
                assert all(np.array_equal(a, b) for a, b in zip(got, whole))
    numbers = texts[0].split()
    padded = spans(model, [texts[0], " ".join(numbers[:500]) + " and then nothing more of it was said " + " ".join(numbers[500:])])
    assert sum(k == "phone" for k, _ in padded[0]) > 60 and abs(len(padded[0]) - len(padded[1])) <= 3


def test_units_keep_places_and_tags():
    words = ["漢字(743)555-3824", "id=743-555-3824;", "a@b.1234567890", "plain", "+1"]
    tags = ["B-phone", "O", "B-email", "O", "B-phone"]
    (cut, of), = pii.table_of_units([(words, tags)])
    assert cut == ["漢字", PHONE, "id=", "743-555-3824;", "a@b.1234567890", "plain", "+1"]
    assert of == ["B-phone", "I-phone", "O", "O", "B-email", "O", "B-phone"]
    assert pii.table_of_units([([], [])]) == [([], [])]
    texts = ["漢(743)555-3824", "", "7435553824漢", "漢", "1"]
    for _, _, data, offsets in W.text_blocks(pa.array(texts)):
        cut = pii.split_units(data, offsets)
        assert pii.word_texts(cut, np.arange(len(cut.starts))) == ["漢", PHONE, "7435553824", "漢", "漢", "1"]
        assert cut.bounds.tolist() == [0, 2, 2, 4, 5, 6]
    with pytest.raises(ValueError, match="blanks"):
        pii.table_of_units([(["two words"], ["O"])])
