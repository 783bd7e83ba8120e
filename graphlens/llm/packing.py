"""Operator 8: best-fit packing of tokenised documents with lower-bound certificates.

Documents become pieces of at most `capacity` tokens. Pieces are dealt into partitions of about
`per_partition` pieces; every partition runs best-fit decreasing and computes lower bounds on its
number of sequences from dual-feasible functions. Bins equal to the bound certify the partition.
Open bins of partitions with a gap, and the loose bins of certified ones (the emptiest, and those
with a sixteenth of the capacity free), give their pieces back; these are pooled, dealt anew and
packed again, until one partition holds them all or dealing them anew saves no more (see pack). Only
piece lengths and ids travel, never texts or token ids, and an id never leaves Arrow's own types, so
large ids beside null ones stay as they are.

Defined results: null text counts as empty; every document ends with one end token, so an empty
one is a piece of length 1; repeated rows are packed once each; null ids are kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import written

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
PER_PARTITION = 20_000
#: A round that closes less than one piece in so many is idle; two idle rounds in a row are the last.
SETTLED = 50
#: A certified partition gives back bins with at least capacity // LOOSE free.
LOOSE = 16
#: Words kept with their ids by each worker until it starts anew, and so many pieces of them, if no
#: longer than this.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: Bytes of text handled at once.
SPAN = 4 << 20
#: Beyond these characters a text goes through the tokenizer whole: inside them neither
#: normalisation nor special tokens can reach across white space.
WHOLE = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]|<\\|")

CUT = "piece int, start long, length long, ids_crc32 long"
PIECES = "id {id}, " + CUT
PLACED = "part long, bin long, offset long, open boolean, certified boolean"


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabularies write for it: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordIds:
    """Token ids of the words that a worker has met, as one array of ids with each word's place in it.

    Where the tokenizer lower-cases, splits by one pattern and then works on bytes, a text's ids are
    those of its words, and a word's those of its pieces. Texts beyond that, and all texts of any
    other tokenizer, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in steps], [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        self.simple = (
            kinds == (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"])
            and steps[0]["invert"]
            and steps[0]["behavior"] == "Removed"
            and not steps[1]["add_prefix_space"]
            and not steps[1].get("use_regex", True)
        )
        self.find = regex.compile(steps[0]["pattern"]["Regex"]).findall if self.simple else None
        self.letters = _byte_letters()
        self._forget()

        self.pieces: dict[str, list[int]] = {}

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.starts = array("I"), array("q", [0])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
            if len(self.pieces) < CACHE_WORDS and len(piece) <= CACHE_CHARS:
                self.pieces[piece] = ids
        return ids

    def places(self, words: list[str]) -> np.ndarray:
        """Number of each word; -1 for one that the whole text is needed for."""
        known, out = self.words, np.empty(len(words), dtype=np.int64)
        for n, word in enumerate(words):
            at = known.get(word)
            if at is None:
                if WHOLE.search(word):
                    at = known[word] = -1
                else:
                    at = known[word] = len(self.starts) - 1
                    for piece in self.find(word.lower()):
                        self.ids.extend(self.piece(piece))
                    self.starts.append(len(self.ids))
            out[n] = at
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start (and the last ones end)."""
        if not self.simple:
            return _laid_out([self.encode(t or "") for t in texts.to_pylist()])
        if len(self.words) > CACHE_WORDS or len(self.ids) > 8 * CACHE_WORDS:
            self._forget()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        word = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()
        odd = np.add.reduceat(np.append(word < 0, False), edges[:-1], dtype=np.int64) * (np.diff(edges) > 0)
        flat, starts = np.frombuffer(self.ids, dtype=np.uint32) if self.ids else np.zeros(0, np.uint32), np.frombuffer(self.starts, dtype=np.int64)
        sizes = np.where(word < 0, 0, starts[word + 1] - starts[word])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[word] - ends[:-1], sizes)]
        bounds = ends[edges]
        if not odd.any():
            return ids, bounds
        parts = [
            self.encode(texts[n].as_py()) if odd[n] else ids[bounds[n] : bounds[n + 1]] for n in range(len(texts))
        ]
        return _laid_out(parts)


def _laid_out(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")), bounds.astype(np.int64)


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return WordIds(path)


def _cut(texts: pa.Array, words: WordIds, capacity: int, end_id: int) -> pa.Array:
    """The pieces of each text: arrays of (piece, start, length, ids_crc32)."""
    rows, counts = [], []
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        # texts of about SPAN bytes at a time, so that long batches take little memory
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SPAN)))
        ids, bounds = words.texts(texts.slice(low, high - low))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.append(ids[a:b], end_id).astype("<u4")
            for n, at in enumerate(range(0, len(own), capacity)):
                cut = own[at : at + capacity]
                rows.append((n, at, len(cut), zlib.crc32(cut.tobytes())))
            counts.append(n + 1)
        low = high
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    made = pa.StructArray.from_arrays(
        [pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, i]) for i in (1, 2, 3))], names=[c.split()[0] for c in CUT.split(", ")]
    )
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), made)


def pieces(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's tokens, cut only where too long."""

    @F.arrow_udf(f"array<struct<{','.join(c.replace(' ', ':') for c in CUT.split(', '))}>>")
    def cut(texts: pa.Array) -> pa.Array:
        return _cut(texts, _words(tokenizer), capacity, end_id)

    # said to be nondeterministic, or a filter on its size would run it a second time
    made = cut.asNondeterministic()(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("id"), made.alias("p")).select("id", F.inline("p"))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's free room.

    A bit set over the free rooms in use finds the fullest bin that still fits in one step.
    """
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room - length
        free[b] = left
        if left:
            stack = by_room.setdefault(left, [])
            if not stack:
                rooms |= 1 << left
            stack.append(b)
    return bins, offsets, np.array(free, dtype=np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest of two families of dual-feasible-function bounds on the number of bins.

    The first drops lengths under a threshold k, rounds lengths over capacity - k up to a whole
    bin and keeps the others; the second rounds (k + 1) * length / capacity down to k-ths.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    best = math.ceil(total[-1] / capacity)
    for k in np.flatnonzero(counts[: capacity // 2 + 1]):
        whole = n[-1] - n[capacity - k]
        kept = total[capacity - k] - (total[k - 1] if k else 0)
        best = max(best, whole + math.ceil(kept / capacity))
    half = capacity // 2
    for k in np.flatnonzero(counts[: half + 1]):
        whole, big = n[-1] - n[capacity - k], n[capacity - k] - n[half]
        room = big * capacity - (total[capacity - k] - total[half])
        small = total[half] - (total[k - 1] if k else 0)
        best = max(best, whole + big + max(0, math.ceil((small - room) / capacity)))
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, capacity * (scaled // capacity))
        best = max(best, math.ceil(int((counts * value).sum()) / (k * capacity)))
    return int(best)


def _pack_part(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        # by what a piece holds, so that a lost and repeated task packs alike
        order = [(c, "ascending") for c in ("length", "ids_crc32", "row")]
        table = table.combine_chunks().sort_by(order)
        lengths = table["length"].to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        certified = len(free) == lower_bound(lengths, capacity)
        back = free >= (capacity // LOOSE if certified else 1)
        back[int(free.argmax())] = free.max() > 0
        more = {"bin": bins, "offset": offsets, "open": back[bins], "certified": np.full(len(bins), certified)}
        for name, values in more.items():
            table = table.append_column(name, pa.array(values))
        return table

    return pack


def pack(found: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Places pieces (from pieces()) in sequences: adds sequence_id, offset and certified.

    Rounds go on until one partition holds all open pieces, or until two rounds in a row have closed
    less than one piece in SETTLED of those that they were given: then dealing them anew saves no
    sequence worth a round, and what is open stays where the last round put it.
    """
    waiting, settled = written(found.withColumn("row", F.monotonically_increasing_id()), "packing-pieces"), None
    columns = waiting.columns
    schema = T.StructType([*waiting.schema.fields, *T.StructType.fromDDL(PLACED).fields])
    turn, idle = 0, 0
    count = waiting.count()
    while True:
        parts = max(1, math.ceil(count / per_partition))
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
        placed = written(dealt.groupBy("part").applyInArrow(_pack_part(capacity), schema), "packing-placed")
        left = placed.where("open").count() if parts > 1 else 0
        idle = idle + 1 if left > count - count / SETTLED else 0
        last = parts == 1 or idle == 2
        keep = (placed if last else placed.where(~F.col("open"))).select(
            *columns,
            (F.lit(turn).cast("long") * F.lit(1 << 54) + F.col("part") * F.lit(1 << 22) + F.col("bin")).alias("sequence_id"),
            "offset",
            "certified",
        )
        settled = keep if settled is None else settled.unionByName(keep)
        if last or not left:
            return settled.drop("row")
        waiting, count, turn = placed.where("open").select(*columns), left, turn + 1


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """Tokenises and packs: one row per piece with its sequence and offset."""
    cut = {k: options.pop(k) for k in ("tokenizer", "end_id") if k in options}
    capacity = options.get("capacity", CAPACITY)
    found = pieces(docs, capacity=capacity, id_col=id_col, text_col=text_col, **cut)
    return pack(found, **options).withColumnRenamed("id", id_col)
