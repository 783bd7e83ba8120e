"""Operator 9: benchmark decontamination by latent semantic retrieval.

Passages are windows of words. Items are taken in blocks of at most BLOCK_ITEMS, each with a latent
basis of its own, so that the share of an item that its basis holds does not fall as the benchmark
grows. TF-IDF rows over the block's terms, with document frequencies counted over all documents, get
the basis from a distributed randomised SVD: partitions multiply their rows with the current basis
and add up their share of A'(A Q), and the driver only orthogonalises a matrix of the block's terms
by rank. It is fitted on the block's items and about `fit_passages` passages, chosen by a hash of
their text and place. Every passage of every document is then scored against every item: windows
whose latent inner product, over both full norms, reaches `cosine` are candidates. Each is checked
on the words around it: the longest common subsequence must cover most of the item, or over half of
it and nearly all of its answer, the item's last quarter, which catches paraphrases.

Words are runs of letters, digits and underscores, lower-cased and known by a 64-bit hash. The
benchmark is the stated query set. It is worked through in groups of blocks of at most GROUP_BYTES
of text, one broadcast and two passes over the documents for each group; results of several groups
meet by a digest of the document's text.

Defined results: null and empty texts are clean; repeated rows come back once each; null ids are
kept; items without words never match; items with a null id or text are left out; item ids are
whole numbers or texts; an empty benchmark leaves all clean; an empty table gives an empty result;
other columns are ignored (or kept, by clean_documents).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm import words
from graphlens.llm.common import written

WINDOW, STRIDE = 32, 16
RANK, OVERSAMPLE, POWER = 128, 16, 2
FIT_PASSAGES = 40_000
COSINE = 0.25
#: Shares of the item's words, and of its answer's, that the common subsequence must cover.
MOST, HALF, ANSWER = 0.75, 0.6, 0.8
#: Items that share a basis, and bytes of items' text that one broadcast holds.
BLOCK_ITEMS, GROUP_BYTES = 200, 2 << 20
#: Products of windows and items held at once, and words whose basis rows are.
CELLS, GATHER = 1 << 21, 1 << 13
#: Letters of texts handled at once, and terms of a partial sum that travel together.
SPAN, CHUNK = 1 << 20, 512
#: Partitions of the fitted passages.
SUM_PARTS = 32
SEED = 99


def words_of(text: str | None) -> list[int]:
    """Hashes of a text's words in order."""
    return words.hashes(text or "")[1].tolist()


def common_subsequence(masks: dict, length: int, words: list) -> int:
    """Bit set of an item's words that a longest common subsequence with `words` ends on.

    masks: word -> bits of its places in the item. The number of bits is the subsequence's length.
    """
    full = (1 << length) - 1
    state = full
    for w in words:
        hit = state & masks.get(w, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return full & ~state


@dataclass
class Item:
    """A benchmark item, ready to compare."""

    item_id: object
    words: list
    masks: dict = field(init=False)
    distinct: frozenset = field(init=False)
    answer: list = field(init=False)
    answer_masks: dict = field(init=False)

    def __post_init__(self) -> None:
        self.distinct = frozenset(self.words)
        self.answer = self.words[-max(3, len(self.words) // 4) :]
        self.masks, self.answer_masks = _places(self.words), _places(self.answer)

    def covered(self, words: list) -> tuple[float, float]:
        """Shares of the item and of its answer that a common subsequence covers."""
        share = common_subsequence(self.masks, len(self.words), words).bit_count() / len(self.words)
        if share < HALF:
            return share, 0.0
        return share, common_subsequence(self.answer_masks, len(self.answer), words).bit_count() / len(self.answer)


def _places(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def is_leak(share: float, answer: float) -> bool:
    """Most of the item, or over half of it with its answer."""
    return share >= MOST or share >= HALF and answer >= ANSWER


@dataclass
class Block:
    """Items that share a basis: `own` are their terms among the group's, in ascending order."""

    items: list[Item]
    own: np.ndarray
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None

    def local(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the basis for term ids; len(own) for terms of other blocks or none."""
        at = np.minimum(np.searchsorted(self.own, ids), len(self.own) - 1)
        return np.where(self.own[at] == ids, at, len(self.own))


@dataclass
class Index:
    """A group of blocks, its terms' hashes in ascending order, and their weights."""

    blocks: list[Block]
    terms: np.ndarray
    idf: np.ndarray
    unknown: float = 1.0
    cosine: float = COSINE

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Term ids of word hashes; len(terms) for others."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, len(self.terms))

    def settle(self) -> None:
        """Items' latent vectors over their full norms."""
        for block in self.blocks:
            rows = [self.ids(np.array(i.words, dtype=np.uint64)) for i in block.items]
            sums = np.stack([block.basis[block.local(r)].sum(axis=0) for r in rows])
            norms = np.array([np.sqrt((self.idf[r] ** 2).sum()) for r in rows])
            block.latent = (sums / np.maximum(norms, 1e-9)[:, None]).astype(np.float32)

    def candidates(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, Item]]:
        """(text, window start in it, first word overall, item) with a latent cosine of at least the threshold.

        ids are the term ids of texts one after another, counts their numbers of words.
        """
        strides = -(-counts // STRIDE)
        # a window is two strides; an empty stride after each text keeps its last one to itself
        first = np.concatenate([[0], np.cumsum(strides + 1)])
        begins = np.concatenate([[0], np.cumsum(counts)])
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(ids)) - begins[text]
        home = first[text] + place // STRIDE
        weight = np.append(self.idf, self.unknown)[ids]
        mass = np.bincount(home, weight**2, first[-1] + 1)
        of = np.repeat(np.arange(len(counts)), np.maximum(strides - 1, (strides > 0).astype(int)))
        window = np.arange(len(of)) - np.searchsorted(of, of) + first[of]
        norms = np.sqrt(np.maximum(mass[window] + mass[window + 1], 1e-9)).astype(np.float32)
        for block in self.blocks:
            local = block.local(ids)
            at = np.flatnonzero(local < len(block.own))
            if not len(at):
                continue
            sums = np.zeros((first[-1] + 1, block.basis.shape[1]), dtype=np.float32)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(home[at]) > 0]))
            cut = np.append(np.searchsorted(starts, np.arange(0, len(at), GATHER)), len(starts))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a < b:
                    low, high = starts[a], starts[b] if b < len(starts) else len(at)
                    sums[home[at[starts[a:b]]]] = np.add.reduceat(block.basis[local[at[low:high]]], starts[a:b] - low, axis=0)
            step = max(1, CELLS // len(block.items))
            for top in range(0, len(window), step):
                part = window[top : top + step]
                rows = sums[part] + sums[part + 1]
                near = rows @ block.latent.T >= self.cosine * norms[top : top + step, None]
                for w, i in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                    t = int(of[top + w])
                    start = int(part[w] - first[t]) * STRIDE
                    yield t, start, int(begins[t]) + start, block.items[i]

    def check(self, texts: list[str]) -> list[dict]:
        """For each text the items that it holds: {item: shares}."""
        out: list[dict] = [{} for _ in texts]
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= SPAN):
                size += len(texts[high])
                high += 1
            found = [words.hashes(t)[1] for t in texts[low:high]] if high - low == 1 else _together(texts[low:high])
            self._verify(found, out[low:high])
            low = high
        return out

    def _verify(self, found: list[np.ndarray], out: list[dict]) -> None:
        counts = np.array([len(h) for h in found])
        flat = np.concatenate(found)
        ids = self.ids(flat)
        longest, seen, near, around = max(len(i.words) for b in self.blocks for i in b.items), None, frozenset(), []
        for t, start, overall, item in self.candidates(ids, counts):
            if id(item) in out[t]:
                continue
            m = len(item.words)
            if seen != overall:
                seen = overall
                begin, end = overall - start, overall - start + int(counts[t])
                low = max(begin, overall - longest)
                around = flat[low : min(end, overall + WINDOW + longest)].tolist()
                near = frozenset(around)
            # words that are nowhere near bound the subsequence from above
            if len(item.distinct - near) > (1 - HALF) * m:
                continue
            own = around[max(0, overall - m - low) : overall + WINDOW + m - low]
            share, answer = item.covered(own)
            if is_leak(share, answer):
                out[t][id(item)] = (share, answer, item.item_id)


def _together(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, hashed at once."""
    starts, hashes = words.hashes("\n".join(texts))
    edges = np.cumsum([len(t) + 1 for t in texts])[:-1]
    return np.split(hashes, np.searchsorted(starts, edges))


def _groups(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items with words, in groups of at most GROUP_BYTES of text (one larger item is a group)."""
    kind = benchmark.schema["item_id"].dataType
    item_id = F.col("item_id") if isinstance(kind, T.StringType) else F.col("item_id").cast("long")
    rows = benchmark.select(item_id.alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id is not null and text is not null").distinct()
    parts = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (GROUP_BYTES // 2))
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(max(1, parts)))), "decontam-items")
    for part in range(parts):
        pairs = sorted((r[0], r[1]) for r in rows.where(F.col("part") == part).collect())
        found = [i for i in (Item(a, words_of(b)) for a, b in pairs) if i.words]
        if found:
            yield found


def _index(items: list[Item], cosine: float) -> Index:
    terms = np.unique(np.array([w for i in items for w in i.words], dtype=np.uint64))
    index = Index([], terms, np.ones(len(terms)), cosine=cosine)
    n_blocks = -(-len(items) // BLOCK_ITEMS)
    for n in range(n_blocks):
        own = items[n::n_blocks]
        index.blocks.append(Block(own, np.unique(index.ids(np.array([w for i in own for w in i.words], dtype=np.uint64)))))
    return index


def _weigh(texts: DataFrame, index: Index) -> int:
    """Sets the terms' weights by how many of all documents hold each; returns the number of words."""
    n, terms = len(index.terms), index.terms
    bare = Index([], terms, np.ones(n))

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 2, dtype=np.int64)
        for table in tables:
            texts = [t or "" for t in table.column(0).to_pylist()]
            total[n] += len(texts)
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= SPAN):
                    size += len(texts[high])
                    high += 1
                found = _together(texts[low:high])
                ids = bare.ids(np.concatenate(found))
                own = np.repeat(np.arange(len(found)), [len(h) for h in found])
                held = np.unique((own * (n + 1) + ids)[ids < n])
                total[:n] += np.bincount(held % (n + 1), minlength=n)
                total[n + 1] += len(ids)
                low = high
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["term", "n"])

    counts = texts.mapInArrow(batches, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n + 2)
    for r in counts:
        out[r["term"]] = r["n"]
    # never zero: an item that most documents hold must still be found in them
    index.idf = np.log1p(max(out[n], 1) / (out[:n] + 1))
    index.unknown = float(np.median(index.idf))
    return int(out[n + 1])


def _fit_rows(texts: DataFrame, index: Index, passages: int, n_words: int) -> DataFrame:
    """Term ids of sampled passages: whole windows, chosen by a hash of their text and place."""
    share = min(1.0, passages * STRIDE / max(1, n_words))
    scale = 1 << 30
    about = F.greatest(F.lit(1), F.floor((F.char_length("t") / 6 - WINDOW) / STRIDE) + 1).cast("int")
    own = F.xxhash64("t", F.lit(SEED))
    picks = F.filter(F.sequence(F.lit(0), about - 1), lambda k: F.pmod(F.xxhash64(own, k), F.lit(scale)) < int(share * scale))
    chosen = texts.where("t is not null").select("t", picks.alias("picks")).where(F.size("picks") > 0)
    bare = Index([], index.terms, np.ones(len(index.terms)))

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            out = []
            for text, picks in zip(table.column("t").to_pylist(), table.column("picks").to_pylist(), strict=True):
                ids = bare.ids(words.hashes(text)[1])
                for pick in picks:
                    row = ids[pick * STRIDE : pick * STRIDE + WINDOW]
                    row = row[row < len(bare.terms)]
                    if len(row):
                        out.append(row.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.list_(pa.int32()))], names=["ids"])

    return written(chosen.mapInArrow(batches, "ids array<int>").repartition(SUM_PARTS), "decontam-passages")


def _products(block: Block, rows: list[np.ndarray], idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q) of the rows (term ids) over the block's terms, rows scaled to length one."""
    total = np.zeros_like(q)
    width = len(block.own) + 1
    for low in range(0, len(rows), 256):
        part = rows[low : low + 256]
        local = block.local(np.concatenate(part))
        own = np.repeat(np.arange(len(part)), [len(r) for r in part])
        cells, counts = np.unique((own * width + local)[local < len(block.own)], return_counts=True)
        if not len(cells):
            continue
        row, term = cells // width, cells % width
        weight = counts * idf[block.own[term]]
        norms = np.sqrt(np.bincount(row, weight**2, len(part)))
        weight /= norms[row]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
        made = np.zeros((len(part), q.shape[1]))
        made[row[starts]] = np.add.reduceat(weight[:, None] * q[term], starts, axis=0)
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(term[order]) > 0]))
        total[term[order][starts]] += np.add.reduceat(weight[order, None] * made[row[order]], starts, axis=0)
    return total


def _multiply(rows: DataFrame, index: Index, qs: list[np.ndarray]) -> list[np.ndarray]:
    """A'(A q) over the sampled passages for every block: partial sums per partition, added chunk by chunk."""
    blocks, idf = [Block([], b.own) for b in index.blocks], index.idf

    def partial(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros_like(q) for q in qs]
        for table in tables:
            found = [np.asarray(r, dtype=np.int64) for r in table.column(0).to_pylist()]
            for block, q, total in zip(blocks, qs, totals, strict=True):
                total += _products(block, found, idf, q) if found else 0
        for n, total in enumerate(totals):
            for low in range(0, len(total), CHUNK):
                part = [[n], [low], [total[low : low + CHUNK].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.binary())], names=["block", "low", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(v, dtype=float) for v in table["v"].to_pylist()))
        return table.slice(0, 1).set_column(2, "v", pa.array([total.tobytes()], pa.binary()))

    schema = "block int, low int, v binary"
    sums = rows.mapInArrow(partial, schema).groupBy("block", "low").applyInArrow(add, schema).collect()
    out = [np.zeros_like(q) for q in qs]
    for r in sums:
        part = np.frombuffer(r["v"], dtype=float).reshape(-1, qs[r["block"]].shape[1])
        out[r["block"]][r["low"] : r["low"] + len(part)] = part
    return out


def _fit(index: Index, rows: DataFrame, rank: int) -> None:
    """Randomised SVD of items and passages: a basis for each block."""
    n_rows = rows.count()
    own = [[index.ids(np.array(i.words, dtype=np.uint64)) for i in b.items] for b in index.blocks]
    rnd = np.random.default_rng(SEED)
    qs = [np.linalg.qr(rnd.normal(size=(len(b.own), min(rank + OVERSAMPLE, len(b.own)))))[0] for b in index.blocks]

    def turned() -> list[np.ndarray]:
        # items and passages weigh the same in total, so that the basis spans the queries too
        sums = _multiply(rows, index, qs)
        return [
            s + max(1.0, n_rows / len(b.items)) * _products(b, r, index.idf, q)
            for s, b, r, q in zip(sums, index.blocks, own, qs, strict=True)
        ]

    for _ in range(POWER):
        qs = [np.linalg.qr(x)[0] for x in turned()]
    for block, q, x in zip(index.blocks, qs, turned(), strict=True):
        core = q.T @ x
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        v = q @ vectors[:, np.argsort(values)[::-1][:rank]]
        # a last row of zeros for all other words
        block.basis = np.vstack([index.idf[block.own, None] * v, np.zeros((1, v.shape[1]))]).astype(np.float32)


def build(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    rank: int = RANK,
    fit_passages: int = FIT_PASSAGES,
    cosine: float = COSINE,
) -> Iterator[Index]:
    """The indexes of a benchmark over a corpus, one for each group; none for a benchmark without words."""
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    for items in _groups(benchmark):
        index = _index(items, cosine)
        n_words = _weigh(texts, index)
        _fit(index, _fit_rows(texts, index, fit_passages, n_words), rank)
        index.settle()
        yield index


def _result(benchmark: DataFrame) -> T.StructType:
    kind = T.StringType() if isinstance(benchmark.schema["item_id"].dataType, T.StringType) else T.LongType()
    fields = (("contaminated", T.BooleanType()), ("item_id", kind), ("lcs_share", T.DoubleType()), ("answer_share", T.DoubleType()), ("items", T.ArrayType(kind)))
    return T.StructType([T.StructField(n, t) for n, t in fields])


def checker(index: Index, result: T.StructType, docs: DataFrame) -> Callable[[Column], Column]:
    """A UDF from whole texts to the result of one group; the index travels as one broadcast of bounded size."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.string() if isinstance(result["item_id"].dataType, T.StringType) else pa.int64()

    @F.arrow_udf(result)
    def check(texts: pa.Array) -> pa.Array:
        found = held.value.check([t or "" for t in texts.to_pylist()])
        # the best item: the most of it, then the least id
        best = [min(f.values(), key=lambda x: (-x[0], x[2])) if f else (None, None, None) for f in found]
        columns = [
            pa.array([bool(f) for f in found], pa.bool_()),
            pa.array([b[2] for b in best], kind),
            pa.array([b[0] for b in best], pa.float64()),
            pa.array([b[1] for b in best], pa.float64()),
            pa.array([sorted(x[2] for x in f.values()) for f in found], pa.list_(kind)),
        ]
        return pa.StructArray.from_arrays(columns, names=result.names)

    return check


def _checked(docs: DataFrame, benchmark: DataFrame, text_col: str, options: dict) -> DataFrame:
    """docs with column _leak: the result of all groups."""
    result, text = _result(benchmark), F.col(text_col).cast("string")
    clean = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(result.fields, (False, None, None, None), strict=False)), F.array().cast(result["items"].dataType).alias("items"))
    checks = [checker(i, result, docs) for i in build(docs, benchmark, text_col, **options)]
    if not checks:
        return docs.withColumn("_leak", clean)
    if len(checks) == 1:
        return docs.withColumn("_leak", checks[0](text))
    key = {"_one": F.xxhash64(text), "_two": F.xxhash64(F.lit(SEED), text)}
    hits = [docs.select(*(c.alias(n) for n, c in key.items()), c(text).alias("r")).where("r.contaminated") for c in checks]
    found = written(reduce(DataFrame.unionByName, hits).dropDuplicates(["_one", "_two", "r"]), "decontam-hits")
    order = F.struct((-F.col("r.lcs_share")).alias("s"), F.col("r.item_id").alias("i"))
    both = found.groupBy("_one", "_two").agg(
        F.min_by("r", order).alias("r"), F.array_sort(F.flatten(F.collect_list("r.items"))).alias("items")
    )
    both = both.select("_one", "_two", F.col("r").withField("items", F.col("items")).alias("_leak"))
    return docs.withColumns(key).join(both, list(key), "left").drop(*key).withColumn("_leak", F.coalesce("_leak", clean))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: (id_col, contaminated, item_id, lcs_share, answer_share, items)."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return _checked(rows, benchmark, "_text", options).select(id_col, "_leak.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a benchmark item in them, with their own columns only."""
    return _checked(docs, benchmark, text_col, options).where("not _leak.contaminated").select(*docs.columns)
