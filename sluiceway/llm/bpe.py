"""Byte-pair encoding and decoding with a public vocabulary file.

Merging keeps the symbols of a piece in a doubly linked list and the possible merges in a
priority queue by rank and place; entries whose symbols have changed since are skipped. Texts are
dealt over tasks by Spark; within a task equal pieces are encoded once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space as the tokenizer's normalizer has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = regex.compile("[\x1c-\x1f]")
SPLIT_SPACE = regex.compile(f"[{SPACE}]+")
CACHED = 300_000  # chunks, and as many pieces of them, that a worker remembers
LONGEST = 100  # longer ones are not remembered


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


Coded = tuple[int, str, str]


def remember(known: dict, limit: int = CACHED) -> None:
    """Make room in a full cache: the older half goes."""
    if len(known) >= limit:
        for key in list(islice(known, len(known) // 2)):
            del known[key]


class Bpe:
    """Encode and decode with the BPE model of a ``tokenizers`` JSON file.

    Covers lower-casing normalizers with white-space collapsing, one splitting pattern, byte-level
    letters, an end-of-word suffix and special tokens; anything else is an error.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splitter, letters = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or letters["type"] != "ByteLevel" or spec["decoder"]:
            raise ValueError(f"{path}: this kind of tokenizer is not covered")
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = splitter["pattern"]["Regex"].replace(r"\s", SPACE)
        self.pieces = regex.compile(pattern)
        self.specials = regex.compile("|".join(f"({regex.escape(t)})" for t in self.special) or "(?!)")
        table = byte_letters()
        self.letters = [self.vocab[c] for c in table]
        self.endings = [self.vocab[c + self.suffix] for c in table]
        # What a worker remembers between tasks: number of ids, the ids, the vocabulary strings.
        self.chunks: dict[str, Coded] = {}
        self.parts: dict[str, Coded] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: repeatedly join the pair with the lowest rank, leftmost first."""
        raw = piece.encode()
        ids = [self.letters[b] for b in raw[:-1]] + [self.endings[raw[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := self.merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: a symbol was merged meanwhile
            ids[i], ids[j] = joined, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := self.merges.get((joined, ids[k])):
                    heapq.heappush(queue, (found[0], i, joined, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := self.merges.get((ids[h], joined))):
                heapq.heappush(queue, (found[0], h, ids[h], joined, found[1]))
        return [x for x in ids if x >= 0]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        return [i for kind, part in self.split(chunk) for i in ([self.special[part]] if kind else self.merge(part))]

    def split(self, chunk: str) -> Iterator[tuple[bool, str]]:
        """(whether it is a special token, part): the parts of a chunk that are encoded apart."""
        at = 0
        for m in self.specials.finditer(chunk):
            yield from self._plain(chunk[at : m.start()])
            yield True, m[0]
            at = m.end()
        yield from self._plain(chunk[at:])

    def _plain(self, text: str) -> Iterator[tuple[bool, str]]:
        low = text.lower() if text.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        return ((False, m[0]) for m in self.pieces.finditer(low))

    def coded(self, chunks: list[str]) -> list[Coded]:
        """Every chunk as (number of ids, ids, vocabulary strings); equal ones are encoded once."""
        known = self.chunks
        fresh: dict[str, Coded] = {}
        for chunk in set(chunks).difference(known):
            fresh[chunk] = self._joined([self._part(*part) for part in self.split(chunk)])
        if not fresh:
            return [known[c] for c in chunks]
        out = [fresh[c] if c in fresh else known[c] for c in chunks]
        for chunk, value in fresh.items():
            if len(chunk) <= LONGEST:
                remember(known)
                known[chunk] = value
        return out

    def _part(self, special: bool, part: str) -> Coded:
        found = self.parts.get(part)
        if found is None or special:
            ids = [self.special[part]] if special else self.merge(part)
            found = len(ids), " ".join(map(str, ids)), self.decode(ids)
            if len(part) <= LONGEST and not special:
                remember(self.parts)
                self.parts[part] = found
        return found

    @staticmethod
    def _joined(parts: list[Coded]) -> Coded:
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def encode(self, text: str) -> list[int]:
        return [i for chunk in chunks(text) for i in self.encode_chunk(chunk)]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings one after another; a file without a decoder separates them by spaces."""
        return " ".join(self.tokens[i] for i in ids)


def chunks(text: str) -> list[str]:
    """Pieces between white space; no token spans white space, and NFC joins nothing across it."""
    if ODD_SPACE.search(text):
        return [c for c in SPLIT_SPACE.split(text) if c]
    return text.split()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One model per Python worker."""
    return Bpe(path)


def bpe_round_trip(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Encode and decode every text: ``id, n_tokens`` and ``ids, decoded`` or their digests.

    With ``digests``, ``ids_sha256`` is of the decimal ids joined by a space and ``decoded_sha256``
    of the decoded text. Texts are encoded whole, without added special tokens; special tokens'
    strings within a text get their own ids. Null counts as the empty text and has no tokens.
    Repeated rows and null ids give a row each; other columns are not read. Memory per task is one
    Arrow batch and at most ``CACHED`` chunks and pieces of up to ``LONGEST`` characters, which a
    worker keeps between tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            counts, ids_out, texts_out = [], [], []
            for text in batch.column(1).to_pylist():
                parts = bpe.coded(chunks(text))
                counts.append(sum([p[0] for p in parts]))
                ids, decoded = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
                ids_out.append(sha(ids) if digests else [int(i) for i in ids.split()])
                texts_out.append(sha(decoded) if digests else decoded)
            first = pa.array(ids_out, pa.string() if digests else pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), first, pa.array(texts_out, pa.string())],
                names=["id", "n_tokens", "a", "b"],
            )

    names = rest.replace(" array<int>", "").replace(" string", "").split(", ")
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = rest.split(", ")[0].split(" ", 1)[1]
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, a {first}, b string").toDF(id_col, "n_tokens", *names)
