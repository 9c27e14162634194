"""What tokenizing workers remember is bounded in bytes, and forgetting changes no result."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sluiceway.llm import bpe, packing
from sluiceway.llm.queries import TOKENIZER


def ids_of(cache, texts):
    return [np.frombuffer(b"".join([found[c] for c in parts]), "<u4").tolist() for _, found, parts in cache.each(pa.array(texts))]


def ids_in(cache, texts):
    return [(row, np.frombuffer(b"".join([found[c] for c in parts]), "<u4").tolist()) for row, found, parts in cache.each(texts)]


def words(seed, n):
    rng = random.Random(seed)
    tails = ["", ",", ".", "...", "!", ".x", ";,", ".,.,.,"]
    return ["".join(rng.choice("abcdeé日É1'") for _ in range(rng.randrange(1, 9))) + rng.choice(tails) for _ in range(n)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 300)
    monkeypatch.setattr(bpe, "CACHED", 300)
    monkeypatch.setattr(bpe.remember, "__defaults__", (300,))
    texts = [" ".join(words(i % 7, 60 + i)) for i in range(40)] + ["", None, "<|endoftext|>a <|endoftext|>. ", "x" * 500 + ". y" + "." * 200]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    cache = packing.ChunkIds(TOKENIZER)
    for _ in range(2):
        for at in range(0, len(texts), 5):
            assert ids_of(cache, texts[at : at + 5]) == want[at : at + 5]
    model = bpe.Bpe(TOKENIZER)
    for text, ids in zip(texts, want):
        coded = model.coded(bpe.chunks(text or ""))
        assert [int(i) for c in coded for i in c[1].split()] == ids and sum(c[0] for c in coded) == len(ids)
        assert " ".join(c[2] for c in coded) == model.decode(ids)
    assert len(model.chunks) <= 300 and len(model.parts) <= 300


def test_long_chunks_are_not_remembered():
    """Thousands of chunks of 10 KB, as in encoded files, leave nothing behind."""
    rng = random.Random(2)
    long = ["".join(rng.choices("abcdefgh0123", k=10_000)) for _ in range(40)]
    cache, model = packing.ChunkIds(TOKENIZER), bpe.Bpe(TOKENIZER)
    tracemalloc.start()
    for chunk in long:
        ids_of(cache, [chunk])
        model.coded([chunk])
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert not cache.known and not model.chunks
    assert max(map(len, cache.words), default=0) <= bpe.LONGEST and max(map(len, model.parts), default=0) <= bpe.LONGEST
    assert kept < 20 << 20


def test_marks_behind_words_are_coded_apart(monkeypatch):
    """Whatever ASCII marks follow, new words go to the tokenizer together and in lower case once."""
    marks = ["", "'", "''", "***", ",$$$", "!!", ".%%%", '"', "_", "<|", "|>", ")]", "'.", "\\", "-", "#" * 9]
    cores = ["Dog", "dog", "DOG", "Übel", "übel", "naïveté", "Łódź", "ǃkung", "i", "İx", "ŉx", "ǆep", "café", "ﬁn", "x1", "it's", "日"]
    texts = [" ".join(c + m for c in cores) for m in marks] + ["dog's the,inlg *** 's ' <|endoftext|>. dog<|endoftext|> <|startoftext|>***"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    cache = packing.ChunkIds(TOKENIZER)
    for _ in range(2):
        assert ids_of(cache, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert cache.words["dog"] and "Dog" not in cache.words
    single: list[str] = []
    encode = cache._encode
    monkeypatch.setattr(cache, "_encode", lambda some, found: (single.extend(some), encode(some, found)))
    fresh = [a + b + c for a in "abcdefgh" for b in "stuvwé" for c in "klmnopqrxyz"]
    ids_of(cache, [" ".join(w + m for w in fresh for m in ("***", "###", ",$$$", "!!"))])
    assert set(single) <= {"***", "###", ",$$$", "!!"}


def test_repeated_words_are_looked_up_once():
    """The work on a group of texts goes by its distinct words, not by all of them."""

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    cache = packing.ChunkIds(TOKENIZER)
    cache.known, cache.words = Counted(cache.known), Counted(cache.words)
    texts = ["Dog cat, 4x dog " * 2_000, "cat. dog\n" * 2_000]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    assert ids_of(cache, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert Counted.asked < 20


def test_groups_and_white_space(monkeypatch):
    """White space of all kinds, marks that combine across it, every plain letter, nulls, slices and small groups."""
    spaces = [*"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x00\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"]
    texts = ["".join(f"Ab{s}cD,{s}{s}.É" for s in spaces), *(f"{s}Ab.{s}\u0301x{s}" for s in spaces), None, "", " ", "..", " .. "]
    texts += [f"{c} x{c}{c}y. {c}\u0301 '{c} {c}'s {c}'S" for c in map(chr, range(0x21, 0x250))]
    texts += ["é" * 50 + ".", "é" * 50, "a" * 100, "a" * 101, "a" * 99 + "!", "!" * 200]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(packing, "GROUP_BYTES", size, raising=False)
        cache = packing.ChunkIds(TOKENIZER)
        for kind in (pa.string(), pa.large_string()):
            assert ids_in(cache, pa.array(texts, kind)) == list(enumerate(want))
            assert ids_in(cache, pa.array(texts, kind).slice(3, 40)) == list(enumerate(want[3:43]))
