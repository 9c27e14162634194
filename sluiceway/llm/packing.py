"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenized and dealt at random to blocks of bounded size. Each block is packed by
several islands, groups of packings of their own. A crossover injects whole well-filled bins of
one packing into another, removes bins that hold the same documents twice, and puts displaced
documents back by best fit, longest first. Between epochs each island's elite migrates to the
next island. What lies in poorly filled bins of all blocks is dealt and packed again.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters, punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.bpe import LONGEST, remember
from sluiceway.llm.common import blocks, stored

CAPACITY = 4096
END_ID = 1
BLOCK_ITEMS = 16_384
ISLANDS = 3
POPULATION = 3
EPOCHS = 2
GENERATIONS = 4
LEVELS = 3
WELL_FILLED = 0.998
CACHED = 500_000  # chunks, and as many words of plain letters, after which a worker forgets the older half
GROUP_BYTES = 4 << 20  # of texts whose chunks are looked up together; a longer text is a group of its own


# Letters whose normal form and lower case are single letters again.
LETTERS = ascii_letters + "".join(
    chr(c) for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x148), (0x14A, 0x1C3)) for c in range(a, b + 1)
)


class ChunkIds:
    """Ids of chunks without ASCII white space, as bytes; one per Python worker, kept between tasks.

    The tokenizer splits letters from what follows them, so that a word and the full stop or
    other ASCII marks after it are looked up apart. Words of plain letters are encoded in lower
    case and many at a time, without the normalizer and the splitting pattern, which leave such
    words as they are: each of them ends with its only end-of-word token. Splitting texts, finding
    equal chunks and putting ids together is done on Arrow arrays; only a group's distinct words
    become Python strings.
    """

    def __init__(self, path: str) -> None:
        # Spark runs one task per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words in lower case; the byte letter of an ASCII letter is itself.
        split = pre_tokenizers.WhitespaceSplit()
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.ascii, self.accented = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = split
        self.accented.pre_tokenizer = pre_tokenizers.Sequence([split, letters])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}  # chunks that are no plain word with marks behind it
        self.words: dict[str, bytes] = {}  # plain letters in lower case
        self.tails: dict[str, bytes] = {"": b""}

    def each(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, list[slice]]]:
        """(row, ids of many texts, where the row's ids lie in them). Null counts as empty.

        White space other than ASCII stays within a chunk and is left to the tokenizer.
        """
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(before, before[first] + GROUP_BYTES, "right")) - 1)
            parts = pc.ascii_split_whitespace(texts.slice(first, last - first).fill_null(""))
            chunks = parts.flatten().dictionary_encode()
            ids = self.coded(chunks.dictionary).take(chunks.indices)
            _, ends, raw = ids.buffers()
            found = memoryview(raw or b"")
            at = np.frombuffer(ends, np.int64)[np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy())))].tolist()
            for row in range(first, last):
                yield row, found, [slice(at[row - first], at[row - first + 1])]
            first = last

    def coded(self, chunks: pa.Array) -> pa.LargeBinaryArray:
        """The ids of distinct chunks; those that are not too long are remembered."""
        remember(self.known, CACHED)
        remember(self.words, CACHED)
        cores = pc.ascii_rtrim(chunks, characters=punctuation)
        tails = pc.utf8_ltrim(chunks, characters=LETTERS)
        # A plain word and its marks: nothing is left between the letters before and the marks behind.
        sizes = pc.binary_length(chunks)
        plain = pc.equal(pc.add(pc.binary_length(cores), pc.binary_length(tails)), sizes)
        plain = pc.and_(plain, pc.and_(pc.greater(pc.binary_length(cores), 0), pc.less_equal(sizes, LONGEST)))
        cores = pc.utf8_lower(cores.filter(plain)).dictionary_encode()
        tails = tails.filter(plain).dictionary_encode()
        ids = pc.binary_join_element_wise(
            self._words(strings(cores.dictionary)).take(cores.indices),
            self._learned(strings(tails.dictionary), self.tails, 3).take(tails.indices),
            pa.scalar(b"", pa.large_binary()),
        )
        odd = pc.invert(plain)
        others = self._learned(strings(chunks.filter(odd)), self.known, LONGEST)
        order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        return pa.concat_arrays([ids, others]).take(pa.array(places))

    def _words(self, some: list[str]) -> pa.LargeBinaryArray:
        words = self.words
        new = [w for w in some if w not in words]
        self._learn_words([w for w in new if w.isascii()], self.ascii)
        self._learn_words([w for w in new if not w.isascii()], self.accented)
        return pa.array([words[w] for w in some], pa.large_binary())

    def _learned(self, some: list[str], known: dict[str, bytes], longest: int) -> pa.LargeBinaryArray:
        """Ids from ``known``, which takes in those of new strings of up to ``longest`` characters."""
        fresh: dict[str, bytes] = {}
        self._encode([c for c in some if c not in known], fresh)
        ids = pa.array([fresh[c] if c in fresh else known[c] for c in some], pa.large_binary())
        known.update((c, i) for c, i in fresh.items() if len(c) <= longest)
        return ids

    def _learn_words(self, words: list[str], tokenizer) -> None:
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            (coded,) = tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                self._encode(some, self.words)
                continue
            raw, begin = ids.tobytes(), 0
            for word, stop in zip(some, (4 * stops).tolist()):
                self.words[word] = raw[begin:stop]
                begin = stop

    def _encode(self, some: list[str], found: dict[str, bytes]) -> None:
        if some:
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                found[c] = np.array(e.ids, "<u4").tobytes()


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``): every document's ids, cut at ``capacity``.

    Ids are the tokenizer's without added special tokens, then ``end_id``; null counts as empty.
    The tokenizer never joins across white space, so equal chunks of a group of texts are coded once.
    """
    kind = docs.schema[id_col]
    schema = T.StructType([T.StructField("id", kind.dataType)]).add("piece", T.IntegerType()).add("start", T.LongType()).add(
        "length", "long").add("ids_crc32", T.LongType())
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_ids(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for row, found, places in cache.each(batch.column(1)):
                ids = b"".join([*(found[p] for p in places), end])
                step = 4 * capacity
                for piece, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    values = [row, piece, at // 4, len(cut) // 4, zlib.crc32(cut)]
                    if keep_ids:
                        values.append(np.frombuffer(cut, "<i4"))
                    for column, value in zip(columns, values):
                        column.append(value)
            arrays = [batch.column(0).take(pa.array(columns[0], pa.int32()))]
            arrays += [pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, schema)


class Bins:
    """Open bins by free space, for best fit."""

    def __init__(self, free: np.ndarray) -> None:
        self.by_space: dict[int, list[int]] = {}
        for b in np.flatnonzero(free > 0).tolist():
            self.by_space.setdefault(int(free[b]), []).append(b)
        self.spaces = sorted(self.by_space)
        self.count = len(free)

    def put(self, length: int, capacity: int) -> int:
        """The fullest bin that the length fits in, else a new one."""
        at = bisect_left(self.spaces, length)
        if at == len(self.spaces):
            space, b = capacity, self.count
            self.count += 1
        else:
            space = self.spaces[at]
            held = self.by_space[space]
            b = held.pop()
            if not held:
                del self.by_space[space]
                self.spaces.pop(at)
        if left := space - length:
            if left not in self.by_space:
                self.by_space[left] = []
                insort(self.spaces, left)
            self.by_space[left].append(b)
        return b


def best_fit(lengths: np.ndarray, genome: np.ndarray, todo: np.ndarray, capacity: int) -> np.ndarray:
    """Place the items ``todo``, in this order, beside those that ``genome`` holds (-1: nowhere)."""
    used = genome >= 0
    n = int(genome.max(initial=-1)) + 1
    fill = np.bincount(genome[used], weights=lengths[used], minlength=n)[:n]
    bins = Bins((capacity - fill).astype(np.int64))
    placed = [bins.put(x, capacity) for x in lengths[todo].tolist()]
    genome[todo] = placed
    return np.unique(genome, return_inverse=True)[1].astype(np.int32)


def longest_first(lengths: np.ndarray, items: np.ndarray, rng, noise: float = 0.0) -> np.ndarray:
    keys = lengths[items] * (1 + noise * rng.random(len(items))) if noise else lengths[items]
    return items[np.argsort(-keys, kind="stable")]


def fills(lengths: np.ndarray, genome: np.ndarray) -> np.ndarray:
    return np.bincount(genome, weights=lengths)


def fitness(lengths: np.ndarray, genome: np.ndarray, capacity: int) -> float:
    """Mean squared fill: fewer and fuller bins are better."""
    return float(np.mean((fills(lengths, genome) / capacity) ** 2))


def crossover(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Inject some well-filled bins of ``other`` into ``one`` and best-fit what they displace."""
    fill = fills(lengths, other)
    good = np.flatnonzero(fill >= max(WELL_FILLED * capacity, np.median(fill)))
    if not len(good):
        good = np.arange(len(fill))
    injected = rng.choice(good, max(1, len(good) // 16), replace=False)
    chosen = np.zeros(len(fill), bool)
    chosen[injected] = True
    moved = chosen[other]
    broken = np.zeros(one.max() + 1, bool)
    broken[one[moved]] = True  # these bins hold a document that has come in twice
    poor = fills(lengths, one) < WELL_FILLED * capacity
    broken |= poor & (rng.random(len(poor)) < 0.5)
    child = one.copy()
    child[broken[one]] = -1
    child[moved] = one.max() + 1 + other[moved]
    todo = np.flatnonzero(child < 0)
    child = np.where(child >= 0, np.unique(child, return_inverse=True)[1] - (1 if len(todo) else 0), -1).astype(np.int32)
    return best_fit(lengths, child, longest_first(lengths, todo, rng, noise=0.05), capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng) -> list[np.ndarray]:
    """Some generations; a child replaces the worst packing unless it is worse still."""
    score = [fitness(lengths, g, capacity) for g in population]
    floor = -(-int(lengths.sum()) // capacity)
    for _ in range(GENERATIONS * POPULATION):
        if int(population[int(np.argmax(score))].max(initial=-1)) + 1 <= floor:
            break  # as few bins as the lengths allow
        a, b = rng.choice(len(population), 2, replace=len(population) < 2)
        child = crossover(lengths, population[a], population[b], capacity, rng)
        value, worst = fitness(lengths, child, capacity), int(np.argmin(score))
        if value >= score[worst]:
            population[worst], score[worst] = child, value
    order = sorted(range(len(population)), key=lambda k: -score[k])
    return [population[k] for k in order[:POPULATION]]


STATE = "block long, island int, member int, score double, lengths binary, genome binary"
ORDER = ["length", "id", "piece", "start", "ids_crc32"]


def start_islands(capacity: int):
    """Each block's first packings: best fit decreasing, and variants of it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block, island = int(frame["block"].iloc[0]), int(frame["island"].iloc[0])
        lengths = np.sort(frame["length"].to_numpy())
        rng = np.random.default_rng([block, island])
        items, none = np.arange(len(lengths)), np.full(len(lengths), -1, np.int32)
        population = [
            best_fit(lengths, none.copy(), longest_first(lengths, items, rng, 0.0 if m + island == 0 else 0.1 * (m + island)), capacity)
            for m in range(POPULATION)
        ]
        return state(block, island, lengths, evolve(lengths, population, capacity, rng), capacity)

    return run


def state(block: int, island: int, lengths: np.ndarray, population: list[np.ndarray], capacity: int) -> pd.DataFrame:
    raw = lengths.astype("<i4").tobytes()
    return pd.DataFrame({
        "block": block, "island": island, "member": range(len(population)),
        "score": [fitness(lengths, g, capacity) for g in population],
        "lengths": raw, "genome": [g.astype("<i4").tobytes() for g in population],
    })


def next_epoch(capacity: int, epoch: int):
    """Natives and the newcomers from the island before."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["came", "member"])
        block, island = int(frame["block"].iloc[0]), int(frame["island"].iloc[0])
        lengths = np.frombuffer(frame["lengths"].iloc[0], "<i4").astype(np.int64)
        population = [np.frombuffer(g, "<i4").copy() for g in frame["genome"]]
        rng = np.random.default_rng([block, island, epoch])
        return state(block, island, lengths, evolve(lengths, population, capacity, rng), capacity)

    return run


def settle(capacity: int, level: int, last: bool):
    """Write a block's best packing onto its pieces; pieces of poor bins go on unless this is the last level."""

    def run(pieces: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(ORDER, kind="stable", na_position="first")
        genome = np.frombuffer(best["genome"].iloc[0], "<i4")
        length = pieces["length"].to_numpy()
        fill = fills(length, genome)
        kept = np.ones(len(fill), bool) if last else fill >= WELL_FILLED * capacity
        order = np.argsort(genome, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.concatenate(([0], np.cumsum(np.bincount(genome))[:-1]))
        offset = np.empty(len(length), np.int64)
        offset[order] = before - before[first][genome[order]]
        base = (level << 56) + (int(pieces["block"].iloc[0]) << 20)
        return pieces.drop(columns=["block"]).assign(
            sequence_id=base + genome.astype(np.int64), offset=offset, settled=kept[genome]
        )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, *, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity``.

    ``pieces`` has ``id, piece, start, length, ids_crc32``. A piece of full length is a sequence of
    its own. The others are dealt by hash to blocks of about ``block_items``; no task holds more
    than a block. Each level deals the pieces of poorly filled bins again; the last one keeps its
    bins as they are. Repeated rows are packed each; null ids are packed like others; an empty
    table gives an empty result.
    """
    whole = pieces.where(F.col("length") >= capacity).select(
        *pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    parts = [whole]
    left = pieces.where(F.col("length") < capacity)
    for level in range(LEVELS):
        n = left.count()
        if not n:
            break
        count = blocks(n, block_items)
        last = level == LEVELS - 1 or (level > 0 and count == 1)
        dealt = left.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "id", "piece", "ids_crc32"), F.lit(count)))
        islands = dealt.select("block", "length", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
        now = stored(islands.groupBy("block", "island").applyInPandas(start_islands(capacity), STATE), "islands")
        for epoch in range(EPOCHS - 1):
            elite = now.where("member = 0").withColumn("island", (F.col("island") + 1) % ISLANDS)
            both = now.withColumn("came", F.lit(0)).union(elite.withColumn("came", F.lit(1)))
            now = stored(both.groupBy("block", "island").applyInPandas(next_epoch(capacity, epoch), STATE), "islands")
        best = Window.partitionBy("block").orderBy(F.col("score").desc(), "island", "member")
        best = now.withColumn("at", F.row_number().over(best)).where("at = 1").select("block", "genome")
        schema = T.StructType([*pieces.schema.fields]).add("sequence_id", T.LongType()).add("offset", T.LongType()).add("settled", T.BooleanType())
        done = dealt.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(settle(capacity, level, last), schema)
        done = stored(done, "packed")
        parts.append(done.where("settled").drop("settled"))
        if last:
            break
        left = done.where("not settled").drop("settled", "sequence_id", "offset")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def packed_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``: all documents in sequences.

    One row per piece. Null and empty texts are one piece with ``end_id`` alone. Pieces of a
    sequence lie without gaps from offset 0. Repeated rows and null ids are packed each; other
    columns are not read.
    """
    pieces = stored(
        token_pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces"
    )
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
