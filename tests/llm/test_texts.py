"""Words, shingle join, decontamination, token counts and personal data against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tillsight.llm import decontamination, pii, queries, shingle_join, tokens
from tillsight.llm import words as W

DOCS = "doc_id long, text string, node string, row_id int"


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def random_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- words ----


def test_words_and_their_hashes():
    texts = ["Ab  cD\tÉé\x0bx", "", None, "  ", "ab", "AB cd", "a" * 3000 + " cd", "\x1ca\x85b", "éÉ"]
    seen = []
    for _, _, data, offsets in W.text_blocks(pa.array(texts, pa.string())):
        got = W.split(data, offsets, W.NON_SPACE)
        hashes = got.hashes()[0]
        for low, high in zip(got.bounds, got.bounds[1:]):
            own = [got.data[a:z].tobytes().decode() for a, z in zip(got.starts[low:high], got.ends[low:high])]
            seen.append((own, list(hashes[low:high])))
    assert [w for w, _ in seen] == [brute.words(t) for t in texts]
    by_word = {}
    for own, hashes in seen:
        for w, h in zip(own, hashes):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_blocks_cover_sliced_arrays_and_huge_texts(monkeypatch):
    monkeypatch.setattr(W, "BLOCK_BYTES", 64)
    monkeypatch.setattr(W, "BLOCK_ROWS", 3)
    texts = [random_text(random.Random(i), i % 17 * 3) if i % 5 else None for i in range(60)]
    column = pa.array(["skip", *texts], pa.string()).slice(1)
    rows = []
    for first, stop, data, offsets in W.text_blocks(column):
        assert first == len(rows) and stop - first <= 3
        rows += [data[a:z].tobytes().decode() for a, z in zip(offsets, offsets[1:])]
    assert rows == [t or "" for t in texts]


# ---- shingle join ----


def near_copies(seed, families, copies, length, change):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(change + 1)):
                own[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "percent", "change"), [(3, 90, 4), (5, 80, 6), (1, 60, 30), (2, 100, 1)])
def test_shingle_join_equals_all_pairs(spark, size, percent, change):
    rows = near_copies(percent, 12, 12, 120, change)
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " \t ", "one", "One", "a b", "A  b", "a b c", rows[0][1]])]
    got = shingle_join.shingle_classes(docs(spark, rows), size=size, percent=percent).collect()
    want = brute.shingle_classes(rows, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(got) == len(rows)


def test_shingle_join_in_blocks(spark, monkeypatch):
    """A cluster that is cut into many blocks yields the same classes."""
    rows = near_copies(3, 1, 60, 100, 5)
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", 900)
    got = shingle_join.shingle_classes(docs(spark, rows), size=3, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.shingle_classes(rows, 3, 80)


def test_shingle_join_repeated_and_null_keys(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t"), (7, "A b c d"), (5, "x y z x y z")]
    got = shingle_join.shingle_classes(docs(spark, rows), size=3, percent=90)
    want = Counter({(5, 5): 3, (None, 5): 1, (None, None): 1, (7, 5): 1})
    assert Counter((r["doc_id"], r["component_id"]) for r in got.collect()) == want
    assert shingle_join.shingle_classes(docs(spark, [])).collect() == []


def test_sketches_agree_like_the_sets():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])  # 300 of 500 are common
    agree = []
    for n, m in ((400, 400), (40, 40)):
        x, y = a[-n:], b[:n] if n == 400 else np.concatenate([a[-30:], b[-10:]])
        texts = np.repeat([0, 1], [len(x), len(y)])
        table = shingle_join.sketch(texts, np.concatenate([x, y]), 2, 2000)
        agree.append((table[0] == table[1]).mean())
    assert abs(agree[0] - 0.6) < 0.05 and abs(agree[1] - 0.6) < 0.06


def test_bands_miss_less_than_promised():
    for percent in (50, 80, 90, 100):
        bands, rows = shingle_join.bands_for(percent)
        assert (1 - min(percent / 100, 0.995) ** rows) ** bands <= shingle_join.LOSS


# ---- decontamination ----

ITEMS = [
    (1, "The quick, brown fox jumps over the lazy dog and runs away."),
    (2, "over the lazy dog and runs away home again today my friend"),
    (3, "short item"), (4, None), (5, "..."), (6, "the quick brown fox jumps over the lazy dog and"), (None, "unnamed words here"),
    (10, "ääh öö ßß üü éé ää öö ßß üü éé zz"),
]


def planted(seed):
    rng = random.Random(seed)
    out = []
    for i in range(60):
        parts = [random_text(rng, rng.randrange(30), 8).replace("w1", "the").replace("w2", "short")]
        for _ in range(rng.randrange(3)):
            v = (rng.choice(ITEMS)[1] or "").upper().split()
            a = rng.randrange(len(v) + 1)
            parts += [" ".join(v[a : a + rng.randrange(8, 14)]), random_text(rng, 2)]
        out.append((i, "! ".join(parts)))
    return [*out, (100, None), (101, ""), (102, "short item"), (102, "short item"), (103, random_text(rng, 3000) + " short ITEM")]


@pytest.mark.parametrize("block_words", [10**6, 15])
def test_passages_equal_a_plain_search(spark, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = planted(block_words)
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, hits int")
    got = decontamination.find_passages(frame, items, block_words=block_words).collect()
    assert len(got) == len(rows)
    want = {(i, t): brute.passages(t, ITEMS, 10) for i, t in rows}
    for r in got:
        n, hit, found = want[r["doc_id"], r["text"]]
        spans = [(h["first"], h["stop"]) for h in r["hits"]]
        assert r["n_words"] == n and {k for a, z in spans for k in range(a, z)} == hit
        assert all(z < a for (_, z), (a, _) in zip(spans, spans[1:]))
        assert sorted(r["items"], key=str) == sorted(found, key=str)


def test_passages_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = docs(spark, [(1, "a b")])
    assert decontamination.find_passages(some, none).select("n_words", "hits", "items").collect() == [(2, [], [])]
    assert decontamination.find_passages(docs(spark, []), none).collect() == []


# ---- token counts ----


def whole(text):
    return len(tokens.load("byte_bpe_50k.json").encode(text, add_special_tokens=False))


def test_spliced_counts_equal_whole_counts():
    rng = random.Random(5)
    tokenizer = tokens.load("byte_bpe_50k.json")
    pieces = [" ", "  ", "\n\n ", "don't", "'re", "'", "1234", "é", "日本語", "<|endoftext|>", "<|end", "of", " the", "!!", "\t", "🙂", "x" * 90]
    for trial in range(60):
        text = "".join(rng.choice(pieces) for _ in range(400))
        assert tokens.count_long(tokenizer, text, chunk=200, overlap=90, margin=40) == whole(text), trial


def test_overlaps_are_widened_where_nothing_aligns():
    tokenizer = tokens.load("byte_bpe_50k.json")
    for text in ("a" * 5000 + " b" * 50, " " * 4000 + "x", "é" * 3000, "ab " * 100 + "9" * 4000 + " end" * 300):
        assert tokens.count_long(tokenizer, text, chunk=300, overlap=100) == whole(text)


def test_token_counts(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (4, "a<|endoftext|>b"), (5, "é " * 30000), (None, "x")]
    got = tokens.token_counts(docs(spark, rows).drop("row_id").withColumnRenamed("node", "n_tokens"), chunk=1000, limit=2)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), whole(t or ""), whole(t or "") > 2) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert tokens.token_counts(docs(spark, [])).collect() == []


# ---- personal data ----


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    alphabet = ["a", "b.c", "@", "@", ".", "..", "_", "%", "1", "23", "255", "256", "4539578763621486", " ", "-", "+", "+1", "(", ")", "é", "\n", "555"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        data = np.frombuffer(text.encode(), np.uint8)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        got = [(int(lead[a]), k, int(lead[z])) for a, k, z in pii.base_spans(data)]
        assert got == brute.base_spans(text), text


def test_crf_finds_what_it_was_taught():
    model = pii.Crf().fit(pii.labelled_table())
    right = total = 0
    for words, tags in pii.labelled_table(seed=8, rows=150):
        if words:
            got = model.decode([pii.sequence_features(words)])[0]
            right += sum(pii.TAGS[t] == want for t, want in zip(got, tags))
            total += len(words)
    assert right / total > 0.9


def test_viterbi_finds_the_best_path():
    import itertools

    model = pii.Crf().fit(pii.labelled_table(rows=60), steps=20)
    sequences = [pii.sequence_features(w.split()) for w in ("+1 (743) 555-3824 x", "a@b.com", "see 10.0.0.1 now", "1 2")]
    for features, path in zip(sequences, model.decode(sequences)):
        emit = model.emit[features].sum(axis=1)

        def total(tags):
            return sum(emit[i, t] for i, t in enumerate(tags)) + sum(model.step[a, b] for a, b in zip(tags, tags[1:]))

        best = max(itertools.product(range(len(pii.TAGS)), repeat=len(features)), key=total)
        assert abs(total(best) - total(list(path))) < 1e-9


def test_pii_query(spark, sf_dir):
    rows = [(1, "é mail me: a.b@c-d.org, +1 (743) 555-3824!"), (2, None), (3, ""), (4, "call (743) 555-3824 now"), (4, "call (743) 555-3824 now"), (5, "plain words " * 4000)]
    got = {r["doc_id"]: r["pii"] for r in pii.find_pii(docs(spark, rows).withColumnRenamed("node", "pii")).collect()}
    assert [(s["kind"], s["first"], s["stop"], s["base"]) for s in got[1]] == [("email", 11, 22, True), ("phone", 24, 41, True)]
    assert got[2] == got[3] == got[5] == []
    assert [(s["kind"], s["base"]) for s in got[4]] == [("phone", False)]
    assert pii.find_pii(docs(spark, [])).collect() == []
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op10_pii(spark, sf_dir).collect():
        spans = brute.base_spans(texts[r["doc_id"]] or "")
        digest = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        assert r["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert r["n_email"] == sum(k == 0 for _, k, _ in spans) and set(digest.split(",")) <= set(r["spans"].split(","))


def test_personal_data_is_found_without_digits_nearby(spark):
    """Each form that the CRF is taught, alone in a text whose other words have neither digits nor at-signs."""
    forms = ["jane (at) mail.com", "jane [at] mail.net", "Jane (at) Mail.com", "jane@mail"]
    far = "the weather was fine and nobody wrote a word about it"
    rows = [(i, f"{far} é write to {form} when you {far}") for i, form in enumerate(forms)]
    rows += [(100 + i, form) for i, form in enumerate(forms)] + [(200, f"{far} " * 40)]
    got = {r["doc_id"]: r["pii"] for r in pii.find_pii(docs(spark, rows)).collect()}
    for i, text in rows[:-1]:
        assert [(s["kind"], text[s["first"] : s["stop"]]) for s in got[i]] == [("email", forms[i % 100])], text
    assert got[200] == []


def test_runs_leave_out_only_words_that_are_no_part_of_spans():
    """Decoding the runs equals one pass over whole texts, for odd words, many texts a block and every form."""
    model = pii.Crf().fit(pii.labelled_table())
    rng = random.Random(11)
    odd = ["(at)", "[at]", "mail.com", "+", "+1", "(in)", "a@", "@", "--", "é", "(743)", "555-3824", "12", "4539", "x.y", "...", "10.0.0.1"]
    plain = ["the", "word", "jane", "Hello,", "end."]
    texts = [" ".join(rng.choice(odd if rng.random() < p else plain) for _ in range(rng.randrange(60))) for p in (0, 0.1, 0.3, 0.9) for _ in range(80)]
    texts += [" ".join(w) for w, _ in pii.labelled_table(seed=9, rows=200)]
    cut = 0
    for _, _, data, offsets in W.text_blocks(pa.array(texts, pa.string())):
        words = W.split(data, offsets, W.NON_SPACE)
        gain = model.gains(words)
        for a, z in zip(words.bounds, words.bounds[1:]):
            own = pii.word_texts(words, np.arange(a, z))
            want = model.decode([pii.sequence_features(own)])[0] if own else np.empty(0, int)
            got = np.zeros(z - a, int)
            for b, e, ends in pii.windows(model.runs(gain[a:z]), z - a):
                cut += e - b
                got[b:e] = np.maximum(got[b:e], model.decode([pii.sequence_features(own[b:e])], [ends])[0])
            assert list(got) == list(want), own
    assert cut < 0.8 * sum(len(t.split()) for t in texts)


def test_words_of_one_plain_shape_have_equal_features():
    texts = ["Jane jané \u0416\u0663x \u00d7a\u00d7 \u2014b \u65e5\u672c\u8a9e (at) 12.5% a1b2@c.d", "", "\U0001f642x9"]
    for _, _, data, offsets in W.text_blocks(pa.array(texts, pa.string())):
        words = W.split(data, offsets, W.NON_SPACE)
        all_words = np.arange(len(words.starts))
        pairs = list(zip(pii.word_texts(words, all_words), pii.word_texts(pii.plain_shapes(words), all_words)))
        assert len(pairs) == 10 and all(pii._features(a) == pii._features(b) for a, b in pairs)
        assert pairs[0][1] == pairs[1][1] == "xxxx" and pairs[6][1] == "(xx)"


def test_marks_are_asked_for_only_where_all_taught_spans_hold_them(spark):
    assert pii.spans_hold_marks(pii.labelled_table()) and pii.spans_hold_marks([(["a", "(at)"], ["B-email", "I-email"])])
    assert not pii.spans_hold_marks([(["a", "7"], ["B-email", "B-email"])])
    taught = [(["ask", "jane", "dot", "com"], ["O", "B-email", "I-email", "I-email"]), (["a", "word"], ["O", "O"])] * 20
    assert not pii.spans_hold_marks(taught)
    row = pii.find_pii(docs(spark, [(1, "ask jane dot com")]), labelled=taught).first()
    assert [(s["kind"], s["first"], s["stop"]) for s in row["pii"]] == [("email", 4, 16)]
