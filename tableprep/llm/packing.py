"""Packing documents into training sequences along a space-filling curve.

A document's token counts are projected by fixed pseudo-random signs to ``DIMS``
numbers, which are cut into cells and numbered along a Hilbert curve. Documents are
range-sorted by that number, ties by key and row, and each range is a stream of tokens
cut every ``LENGTH`` tokens: neighbours along the curve share sequences. What is left
at the end of a range is cut into sequences whose lengths are powers of two, the
largest first, and these need no padding. So there is none at all.

Tokens are made once and stored as 16-bit numbers; range bounds and sorting work on
the stored table. A task holds a few Arrow batches. Ties on the curve are split by key, so
many copies of one document spread over as many ranges as their number asks for.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, stored

#: Letters of one code point in either case, and signs, that a tokenizer of words may part: checked for each tokenizer.
LETTERS = "".join(c for c in map(chr, range(256)) if re.match("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", c))
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = f"^[{LETTERS}]+[{re.escape(SIGNS)}]*$"
LENGTH = 4096
END = 2
DIMS, CELL_BITS = 3, 8
#: Words whose tokens a worker remembers in each half of its memory; when one is full the other is forgotten.
MEMORY = 400_000
#: Code points (or bytes of Arrow batches) whose words are looked up at once; longer texts are cut at a space.
SLICE = 1 << 22
_encoders: dict[str, Callable] = {}


def encoder(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """Texts to their token ids as little-endian 16-bit numbers, each with END.

    White space parts tokens in every public word tokenizer of this kind, so a text's
    ids are those of its white-space parts in a row; parts seen before are looked up, and
    words that differ only in case or in signs at the end share the ids of their letters.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    if model.get_vocab_size() > 1 << 16:
        raise ValueError("token ids do not fit 16 bits")
    recent, older = {"": b""}, {}
    end, letters, none = np.array([END], "<u2").tobytes(), frozenset(LETTERS), pa.scalar("", pa.large_string())

    last = np.zeros(1 << 16, bool)  # ids of pieces that end a word
    last[[i for piece, i in model.get_vocab().items() if piece.endswith("</w>")]] = True

    def together(stems: list[str]) -> list[bytes]:
        """Ids of runs of letters, encoded as one text and cut where words end; none if the ends do not add up."""
        ids = np.array(model.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u2")
        ends = np.flatnonzero(last[ids]) + 1
        if not len(ends) or len(ends) != len(stems) or ends[-1] != len(ids):
            return []
        cuts, raw = (2 * ends).tolist(), ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def single(parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u2").tobytes() for x in model.encode_batch_fast(parts, add_special_tokens=False)]

    # letters of either case have the same ids if the tokenizer says so of each
    fold = model.normalizer is not None and model.normalizer.normalize_str(LETTERS) == pc.utf8_lower(LETTERS).as_py()
    # an added token could stand inside a plain word
    whole = any(re.fullmatch(PLAIN, "a" + t.content) for t in model.get_added_tokens_decoder().values())
    tails: dict[str, bytes | None] = {}

    def tail(signs: str) -> bytes | None:
        """Ids of signs after letters; None if the tokenizer does not part them from the letters."""
        if signs not in tails:
            if len(tails) >= 10_000:
                tails.clear()
            a, e, alone, after, beside = single(["a", "\u00e9", signs, "a" + signs, "\u00e9" + signs])
            tails[signs] = alone if (after, beside) == (a + alone, e + alone) else None
        return tails[signs]

    def learned(missing: list[str]) -> None:
        """Puts all missing words into ``recent``."""
        recent.update({p: older[p] for p in missing if p in older})
        new = [p for p in missing if p not in recent]
        plain = [p for p in new if letters.issuperset(p)]
        for at in range(0, len(plain), 4096):
            recent.update(zip(plain[at:at + 4096], together(plain[at:at + 4096])))
        other = [p for p in new if p not in recent]
        recent.update(zip(other, single(other)))

    def ids_of(words: pa.Array) -> pa.Array:
        """Ids of different words: those of their letters, looked up or learned, and of the signs after them."""
        plain = pc.match_substring_regex(words, "^$" if whole else PLAIN)
        signs = pc.if_else(plain, pc.utf8_ltrim(words, characters=LETTERS), none).dictionary_encode()
        ends = [tail(x) for x in signs.dictionary.to_pylist()]
        plain = pc.and_(plain, pa.array([x is not None for x in ends], pa.bool_()).take(signs.indices))
        stems = pc.utf8_rtrim(words, characters=SIGNS)
        known = pc.if_else(plain, pc.utf8_lower(stems) if fold else stems, words).dictionary_encode()
        names = known.dictionary.to_pylist()
        got = list(map(recent.get, names))
        missing = [p for p, g in zip(names, got) if g is None]
        if missing:
            learned(missing)
            got = [recent[p] if g is None else g for p, g in zip(names, got)]
        ends = pa.array([x or b"" for x in ends], pa.large_binary()).take(signs.indices)
        return pc.binary_join_element_wise(pa.array(got, pa.large_binary()).take(known.indices), ends, pa.scalar(b"", pa.large_binary()))

    def group(slices: list[str]) -> list[bytes]:
        """Ids of some slices; each different word is looked up once, unknown ones are encoded together."""
        nonlocal recent, older
        if len(recent) >= MEMORY:  # words in use come back from the older half
            recent, older = {"": b""}, recent
        parts = pc.split_pattern(pa.array(slices, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        # the ids of all words in a row, and where those of each slice begin
        _, at, raw = ids_of(coded.dictionary).take(coded.indices).buffers()
        at = np.frombuffer(at, np.int64)[parts.offsets.to_numpy()].tolist()
        raw = raw.to_pybytes() if raw else b""
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def encode(texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        owners, slices, size = [], [], 0

        def flush() -> None:
            nonlocal size
            for i, ids in zip(owners, group(slices)):
                out[i].append(ids)
            owners.clear()
            slices.clear()
            size = 0

        for i, text in enumerate(texts):
            text, at = (text or "").replace("\n", " ").replace("\t", " "), 0
            while at < len(text):  # a long text is cut at a space
                to = text.find(" ", at + SLICE) if len(text) - at > SLICE else -1
                slices.append(text[at:] if to < 0 else text[at:to])
                owners.append(i)
                size += len(slices[-1])
                at = len(text) if to < 0 else to + 1
                if size >= SLICE:
                    flush()
        if slices:
            flush()
        return [b"".join([*x, end]) for x in out]

    _encoders[path] = encode
    return encode


def signs() -> np.ndarray:
    """DIMS pseudo-random numbers for each possible id: rows of a fixed normal table."""
    return np.random.default_rng(7).standard_normal((1 << 16, DIMS)).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Numbers along the Hilbert curve of rows of cells (each below 2 ** bits), by transposed Gray codes."""
    x = cells.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(ids: list[bytes], table: np.ndarray) -> np.ndarray:
    """Place on the curve of each document: projected mean, scaled by the root of its length, cut into cells."""
    points = np.zeros((len(ids), DIMS), np.float32)
    for i, raw in enumerate(ids):
        got = np.frombuffer(raw, "<u2")
        total = np.zeros(DIMS)
        for at in range(0, len(got), 1 << 16):
            total += table.take(got[at:at + (1 << 16)], axis=0).sum(0)
        points[i] = total / np.sqrt(len(got))
    # logistic: most documents fall in the middle, none outside
    cells = np.floor((1 << CELL_BITS) / (1 + np.exp(-np.clip(points / 4, -30, 30))))
    return hilbert(np.clip(cells, 0, (1 << CELL_BITS) - 1))


def tokenized(rows: DataFrame, path: str) -> DataFrame:
    """key, curve, ids for rows with key and text."""
    kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = encoder(path), signs()

        def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = iter(encode([t for batch in held for t in batch.column("text").to_pylist()]))
            for batch in held:
                own = list(islice(ids, len(batch)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(curve_key(own, table)), pa.array(own, pa.binary())], ["key", "curve", "ids"])
            # workers stay for later stages: free memory goes back
            pa.default_memory_pool().release_unused()

        held = []
        for batch in batches:  # a few batches share their look-ups
            held.append(batch)
            if sum(x.nbytes for x in held) >= SLICE:
                yield from made(held)
                held = []
        yield from made(held)

    return rows.mapInArrow(run, f"key {kind.simpleString()}, curve long, ids binary")


def lengths(tokens: int, length: int = LENGTH) -> Iterator[int]:
    """Sequence lengths for the last ``tokens`` (fewer than ``length``) tokens: powers of two that add up."""
    for bit in range(length.bit_length(), -1, -1):
        if tokens >> bit & 1:
            yield 1 << bit


def cut_stream(rows: Iterator[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """(key, start, length, crc32, doc_tokens, local sequence, offset) of rows (key, ids) in order.

    Pieces of the open sequence wait until it is full; at the end they are dealt to
    sequences of powers of two.
    """
    open_pieces, filled, number = [], 0, 0
    for key, raw in rows:
        total, at = len(raw) // 2, 0
        while at < total:
            take = min(total - at, length - filled)
            open_pieces.append((key, at, take, raw[2 * at:2 * (at + take)], total))
            filled, at = filled + take, at + take
            if filled == length:
                yield from _closed(open_pieces, number)
                open_pieces, filled, number = [], 0, number + 1
    for size in lengths(filled, length):
        now, left = [], size
        while left:
            key, at, take, raw, total = open_pieces.pop(0)
            use = min(take, left)
            now.append((key, at, use, raw[:2 * use], total))
            if use < take:
                open_pieces.insert(0, (key, at + use, take - use, raw[2 * use:], total))
            left -= use
        yield from _closed(now, number)
        number += 1


def _closed(pieces: list[tuple], number: int) -> Iterator[tuple]:
    offset = 0
    for key, at, take, raw, total in pieces:
        wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
        yield key, at, take, zlib.crc32(wide), total, number, offset
        offset += take


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH,
         ranges: int | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens (a power of two).

    Returns one row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null or empty text is the END token alone. Each row of ``docs`` is one
    document, also if its key is null or repeated. An empty table gives no rows.
    ``ranges`` is the number of curve ranges; without it Spark's shuffle partitions.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    small_batches(docs)
    rows = stored(tokenized(pick(docs, key=key, text=text), path), "token-ids")
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "curve", "key", F.xxhash64("ids")).sortWithinPartitions("curve", "key", F.xxhash64("ids")) \
        .withColumn("part", F.spark_partition_id().cast("long"))
    kind = rows.schema["key"].dataType
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key_type = [0], [None]

        def each() -> Iterator[tuple]:
            for batch in batches:
                key_type[0] = batch.column("key").type
                if len(batch):
                    part[0] = batch.column("part")[0].as_py()
                for k, ids in zip(batch.column("key"), batch.column("ids")):
                    yield k.as_py(), ids.as_py()

        def table(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            columns[5] = [(part[0] << 40) + x for x in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type[0])]
                                              + [pa.array(c, pa.int64()) for c in columns[1:]], names)

        found = []
        for piece in cut_stream(each(), length):
            found.append(piece)
            if len(found) == 10_000:
                yield table(found)
                found = []
        if found:
            yield table(found)

    schema = f"key {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:])
    return dealt.mapInArrow(run, schema).toDF(key, *names[1:])
