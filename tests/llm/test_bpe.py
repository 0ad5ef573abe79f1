"""Byte-level BPE against the library that defines it, edits against encoding from scratch."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tillsight.llm import bpe, queries

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]
PARTS = ["a", "b", "ab", "the", "aaaa", "é", "漢字", "ا", " ", "  ", "\n", "1", "23", "'s", "'", "re", "🙂", "x", "̀", "-", "==", "<|endoftext|>", " ", "\x1c"]


def library(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made_texts(rng: random.Random, n: int, longest: int = 60) -> list[str]:
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_library(name):
    coder, own = bpe.load(name), library(name)
    long = ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "".join(random.Random(3).choice("abcdefgh") for _ in range(9000))]
    for text in [*made_texts(random.Random(1), 800), *long]:
        ids, counts = coder.encode(text)
        assert ids.tolist() == own.encode_ordinary(text) and counts.sum() == len(ids)
        assert np.array_equal(coder.encode_ids(text), ids)
        assert coder.decode(ids) == text.encode()


def test_every_character_is_cut_as_the_library_does():
    coder, own = bpe.load(FILES[0]), library(FILES[0])
    for low in range(0, 0x30000, 64):  # beyond there are no letters or spaces but ideographs
        text = "".join(f"a{chr(c)}b {chr(c)}1{chr(c)} " for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert coder.encode(text)[0].tolist() == own.encode_ordinary(text), hex(low)


def test_plain_classes_cut_like_the_public_pattern():
    import regex

    public = regex.compile(public_tokenizers.PATTERN)
    plain, differs = bpe.plain_pattern(public_tokenizers.PATTERN)
    left = 0
    for c in range(0x110000):
        text = f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)}  {chr(c)}'s_{chr(c)}"
        if not bpe._is_plain(text, differs):
            left += 1
        else:
            assert plain.findall(text) == public.findall(text), hex(c)
    assert bpe.plain_pattern("other") is None and left == differs.sum()
    for text in made_texts(random.Random(8), 500):
        assert not bpe._is_plain(text, differs) or plain.findall(text) == public.findall(text)


def test_every_prefix_has_the_last_token_of_its_own_encoding():
    coder, own = bpe.load(FILES[0]), library(FILES[0])
    for piece in ["internationalisation", "Überraschungen", "aaaaaaaaaaaaaaa", "мираж漢字"]:
        data = piece.encode()
        prefixes = bpe.Prefixes(coder.ranks, data)
        for end in range(1, len(data) + 1):
            assert prefixes.last[end] == own._encode_single_piece(data[:end])[-1]


def test_appends_and_edits_of_prefixes_are_exact():
    ranks, rng = bpe.load(FILES[0]).ranks, random.Random(2)
    for text in made_texts(rng, 300, 120):
        data = text.replace(" ", "").encode()
        grown = bpe.Prefixes(ranks)
        for at in range(0, len(data), 7):
            grown.append(data[at : at + 7])
        assert grown.last == bpe.Prefixes(ranks, data).last
        begin = rng.randint(0, len(data))
        end, new = rng.randint(begin, min(len(data), begin + 5)), rng.choice(PARTS).encode()
        grown.replace(begin, end, new)
        assert (grown.data, grown.last) == (d := data[:begin] + new + data[end:], bpe.Prefixes(ranks, d).last)


def test_an_edit_of_a_long_piece_meets_the_stored_prefixes(monkeypatch):
    ranks, rng = bpe.load(FILES[0]).ranks, random.Random(4)
    data = "".join(rng.choice("abcdefgh") for _ in range(20_000)).encode()
    prefixes, seen = bpe.Prefixes(ranks, data), []
    monkeypatch.setattr(ranks, "fit", lambda a, b, fit=ranks.fit: seen.append(a) or fit(a, b))
    prefixes.replace(100, 101, b"zz")
    assert len(seen) < 5_000 and prefixes.last == bpe.Prefixes(ranks, data[:100] + b"zz" + data[101:]).last


def test_a_file_that_training_cannot_make_is_refused():
    bytes_only = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)]
    assert bpe.Ranks(iter(bytes_only)).longest == 1
    with pytest.raises(ValueError, match="no merge"):
        bpe.Ranks(iter([*bytes_only, base64.b64encode(b"abc") + b" 256"]))
    with pytest.raises(ValueError, match="every byte"):
        bpe.Ranks(iter(bytes_only[1:]))


def test_edited_tables(spark):
    rng, name = random.Random(5), FILES[0]
    texts = [*made_texts(rng, 60, 300), "", None]
    rows = [(i, t, (b := rng.randint(0, len(t or ""))), rng.randint(b, len(t or "") + 2), rng.choice([*PARTS, None, ""]), i) for i, t in enumerate(texts)]
    rows += [(100, "to the end", None, None, "less", 0), (101, "word " * 2000, 5000, 5001, "x", 0)]
    frame = spark.createDataFrame(rows, "id long, text string, begin int, end int, new string, pieces_again int")
    coded = bpe.encode_texts(frame.withColumn("body", F.col("text")), name, text="body", pieces=True)
    coder = bpe.load(name)
    got = {r["id"]: r for r in bpe.edit_texts(coded, name).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, text, begin, end, new, _ in rows:
        text = text or ""
        begin, end = (len(text) if x is None else min(x, len(text)) for x in (begin, end))
        whole = text[:begin] + (new or "") + text[max(begin, end) :]
        ids, counts = coder.encode(whole)
        assert (got[i]["text"], got[i]["ids"], got[i]["piece_ids"]) == (whole, ids.tolist(), counts.tolist())
    assert got[100]["text"] == "to the endless" and got[101]["pieces_again"] < 10


def test_texts_of_a_table(spark):
    own = library(FILES[0])
    texts = [None, "", " ", "plain text", "plain text", "word " * 30_000, "x" * 100_000, "<|endoftext|>", "é漢🙂\r\n\t  z"]
    rows = [(i % 7, t, "kept", [9], 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>, piece_ids int")
    coded = bpe.encode_texts(frame, FILES[0])
    got = sorted((r["doc_id"], bytes(r["decoded"]).decode(), r["ids"]) for r in bpe.decode_ids(coded, FILES[0]).collect())
    assert got == sorted((i, t or "", own.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert bpe.decode_ids(bpe.encode_texts(frame.limit(0), FILES[0]), FILES[0]).collect() == []
    free = spark.createDataFrame([(1, [0, 255, 300]), (2, None)], "doc_id long, ids array<int>")
    tokens = bpe.load(FILES[0]).ranks.token
    assert [bytes(r["decoded"]) for r in bpe.decode_ids(free, FILES[0]).orderBy("doc_id").collect()] == [tokens[0] + tokens[255] + tokens[300], b""]


def test_byte_bpe_query(spark, sf_dir):
    own = library(FILES[0])
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = own.encode_ordinary(r["text"] or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (r["text"] or "").encode())]
        want.add((r["doc_id"], len(ids), *digests))
    assert {tuple(r) for r in queries.op11_byte_bpe(spark, sf_dir).collect()} == want
