"""Operator 5: near-duplicate lines by a segment-partition edit join, DataFrame functions only.

Lines of at least `min_chars` characters are the join's items; equal lines are one item. Lines are
kept in classes of lengths (a length's three leading binary digits), and for an edit threshold t the
lines of a class are cut into t + 1 segments of one width. If two lines are within t edits, some
segment i of the shorter one occurs unchanged in the longer one with exactly i edits before it
(pigeonhole), so at most i places from its own. Every line indexes its segments by (class, segment
number, content); every line probes, for the classes of its own length and of the t lengths below,
the few substrings that such a shift allows. Pairs that meet and whose lengths agree are verified by
the built-in edit distance of what they do not have in common at both ends. Links become classes (connected components), and of each class only the
first occurrence by (id, line number) stays.

Texts are not shuffled for the join: entries carry 64-bit line ids, and only lines that meet another
one are fetched again for verification. An entry under which more than `crowd` lines are indexed is
first checked against one leader each. Where this leaves lines in different classes, what is left of
them without the shared segment is cut again in the same way, under a key that holds the first one,
and so on until no entry is crowded or nothing is left that t edits could not change: so lines that
share a start, or a start and most of the rest, never make all pairs.

Defined results: null texts stay null, blank lines, and short ones unless exact_chars says otherwise,
always stay, repeated rows are treated alike (the same lines go from each), ids may be whole numbers
or anything with a text form (ordered as texts), null ids come after all others, an empty table gives
an empty result, and other columns are kept; n_lines and n_dropped replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import components, unused, written

#: Edits within which two lines count as the same.
MAX_EDITS = 1
#: Lines from so many characters on take part in the join of near-identical ones.
MIN_CHARS = 24
#: (characters of the shorter line, edits) from which more edits count as the same, in ascending order.
BANDS = ((80, 2), (160, 3))
#: Lines indexed under an entry above which texts are compared in the join, and above which a leader
#: stands in for all pairs.
BUSY, CROWD = 32, 1000
#: Ids of lines to verify that are broadcast at most (8 bytes each), and numbers of lines to drop (4
#: bytes each); beyond them, a shuffle join.
BROADCAST_ROWS, BROADCAST_LINES = 2_000_000, 4_000_000
PLACES = 10_000_000_000


def edit_distance(x: Column, y: Column, max_edits: int) -> Column:
    """Edit distance of two arrays of letters if at most max_edits, else some larger number.

    x and y should be stored columns: the steps look letters up, and an expression would be
    computed again for each.

    Banded bit-parallel columns: bit r of a column j stands for row j - t + r. vp and vn hold
    where the distance grows or falls downwards, d0 where a diagonal step is free; the wanted
    cell lies on one diagonal, so the distance is that diagonal's start plus its steps that cost.
    """
    t = max_edits
    mask = (1 << (2 * t + 1)) - 1
    m, n = F.size(x), F.size(y)
    wide = lambda v: F.lit(v).cast("long")

    def matches(c: Column, k: Column) -> Column:
        bits = [F.when(F.get(x, k + (r - t)) == c, wide(1 << r)).otherwise(wide(0)) for r in range(2 * t + 1)]
        return reduce(lambda p, q: p.bitwiseOR(q), bits)

    def column(acc: Column, eq: Column) -> Column:
        vp, vn = acc["vp"], acc["vn"]
        free = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(wide(mask))
        return F.transform(F.array(free), lambda d0: advance(acc, d0))[0]

    def advance(acc: Column, d0: Column) -> Column:
        vp, vn, down = acc["vp"], acc["vn"], F.shiftrightunsigned(d0, 1)
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(wide(mask)))
        return F.struct(
            d0.bitwiseAND(vp).bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(wide(mask))).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (acc["cost"] + 1 - F.getbit(d0, m - n + t)).cast("long").alias("cost"),
        )

    start = F.struct(
        wide(mask & ~((1 << t) - 1)).alias("vp"),
        wide(0).alias("vn"),
        F.greatest(m - n, F.lit(0)).cast("long").alias("cost"),
    )
    walked = F.aggregate(F.transform(y, matches), start, column, lambda s: s["cost"])
    return F.when(F.abs(m - n) > t, F.lit(t + 1).cast("long")).when(n == 0, m.cast("long")).otherwise(walked)


def _edits(length: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """The edit threshold of a (shorter) line's length; bands are (characters, edits) in ascending order."""
    chosen = None
    for low, t in sorted(bands, reverse=True):
        chosen = F.when(length >= low, t) if chosen is None else chosen.when(length >= low, t)
    return chosen.otherwise(sorted(bands)[0][1])


def _class(length: Column) -> Column:
    """The least length of a length's class: its three leading binary digits, the others zero."""
    low = F.greatest(F.length(F.bin(length.cast("long"))) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", length.cast("int"), low), low)


def _shifts(t: int) -> list[tuple[int, int]]:
    """(segment, shift) of the substrings that a line probes, which is no shorter than what it looks for."""
    return [(i, s) for i in range(t + 1) for s in range(max(-i, i - t), i + 1)]


def _by_edits(make: Callable[[int], Column], most: int) -> Column:
    chosen = F.when(F.col("t") == 1, make(1))
    for t in range(2, most + 1):
        chosen = chosen.when(F.col("t") == t, make(t))
    return chosen


def _entries(lines: DataFrame, most: int, probing: bool) -> DataFrame:
    """(key, at, ...) of lines with columns chain, line, t, low: at tells which of the places it is.

    Places are dealt out first and hashed one a row: an expression for each of them is more code than the
    JVM compiles.
    """

    def places(t: int) -> Column:
        found = _shifts(t) if probing else [(i, 0) for i in range(t + 1)]
        return F.array(*(F.struct(F.lit(n).alias("at"), F.lit(i).alias("segment"), F.lit(s).alias("shift")) for n, (i, s) in enumerate(found)))

    dealt = lines.select(*lines.columns, F.inline(_by_edits(places, most)))
    width = F.expr("low div (t + 1)").cast("int")
    content = F.substring(F.col("line"), width * F.col("segment") + F.col("shift") + 1, width)
    return dealt.select(F.xxhash64("chain", "t", "low", "segment", content).alias("key"), "at", *lines.columns)


def _indexed(lines: DataFrame, bands: tuple) -> DataFrame:
    """The lines (id, chain, line, ...) as they are indexed: with their edits t, unless given, and class."""
    length = F.char_length("line")
    edits = F.col("t") if "t" in lines.columns else _edits(length, bands)
    return lines.withColumns({"t": edits, "low": _class(length)}).where("low > t")


def _probing(lines: DataFrame, bands: tuple) -> DataFrame:
    """The lines with the edits and class of every length that they look for."""
    own, given = F.char_length("line"), "t" in lines.columns
    kinds = [
        F.struct((F.col("t") if given else _edits(own - d, bands)).alias("t"), _class(own - d).alias("low"))
        for d in range(max(t for _, t in bands) + 1)
    ]
    # both fall with the length: if the first and the last are equal, all are
    wanted = F.when(kinds[0] == kinds[-1], F.array(kinds[0])).otherwise(F.array_distinct(F.array(*kinds)))
    return lines.select(*(c for c in lines.columns if c != "t"), F.inline(wanted)).where("low > t")


#: What a probe carries in one long, from the lowest bit on, with the numbers of bits.
PACKED = {"length": 27, "low": 27, "t": 4, "at": 6}


def _packed() -> Column:
    out, low = F.lit(0).cast("long"), 0
    for name, bits in PACKED.items():
        out = out.bitwiseOR(F.shiftleft(F.col(name).cast("long").bitwiseAND(F.lit((1 << bits) - 1)), low))
        low += bits
    return out


def _part(packed: str, n: int) -> Column:
    bits = [*PACKED.values()]
    return F.shiftrightunsigned(F.col(packed), sum(bits[:n])).bitwiseAND(F.lit((1 << bits[n]) - 1)).cast("int")


def _parity(text: str) -> Column:
    """Which of 64 groups of letters a text holds an odd number of times, as bits: an edit changes at most two."""
    letters = F.transform(F.split(text, ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(c), F.lit(64))))
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, bit: acc.bitwiseXOR(bit))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _common(x: Column, y: Column, at: Callable[[Column, Column, Column], Column]) -> Column:
    """Letters in which x and y agree from an end on, up to 4095: at(text, found, more) gives the next ones of a text.

    A text that ends before gives fewer, so these are equal for equal texts only.
    """
    steps = F.array(*(F.lit(1 << n) for n in range(11, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(at(x, n, k) == at(y, n, k), n + k).otherwise(n))


def distance(x: Column, y: Column, most: int) -> Column:
    """Edit distance of two texts if at most `most`, else -1.

    The built-in distance takes time by the square of the length, so it sees what is left of both without
    their common start and end. Of this, cut into segments, each edit can touch one only: the others must
    occur in the other text, at most `most` places from their own.
    """
    cuts = 4 * most

    def left(x: Column, y: Column, same: Column, cut: Callable[[Column, Column], Column], f: Callable[[Column], Column]) -> Column:
        return _with(same, lambda n: _with(F.struct(cut(x, n).alias("x"), cut(y, n).alias("y")), f))

    def kept(x: Column, y: Column, width: Column) -> Column:
        own = lambda i: F.substring(x, width * i + 1, width)
        near = lambda i: F.substring(y, F.greatest(width * i + (1 - most), F.lit(1)), width + 2 * most)
        touched = F.filter(F.sequence(F.lit(0), F.lit(cuts - 1)), lambda i: ~F.contains(near(i), own(i)))
        return F.when((width > 0) & (F.size(touched) > most), F.lit(-1)).otherwise(F.levenshtein(x, y, most))

    def rest(r: Column) -> Column:
        return _with(F.floor(F.char_length(r["x"]) / cuts).cast("int"), lambda width: kept(r["x"], r["y"], width))

    def ended(r: Column) -> Column:
        same = _common(r["x"], r["y"], lambda text, n, k: F.substring(text, -(n + k), k))
        return left(r["x"], r["y"], same, lambda text, n: F.substring(text, F.lit(1), F.char_length(text) - n), rest)

    same = _common(x, y, lambda text, n, k: F.substring(text, n + 1, k))
    return left(x, y, same, lambda text, n: F.substring(text, n + 1, F.char_length(text)), ended)


def _fits(t: Column) -> Column:
    """Whether the lengths allow a link of a to b, which is no shorter, within t edits."""
    return (F.col("b_length") - F.col("a_length")).between(F.lit(0), t) & (F.col("a") != F.col("b"))


def _named(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """The columns with the side's name: id as a or b, others as a_... or b_..."""
    kept = [c for c in ("id", *columns) if c in rows.columns]
    return rows.select(*(F.col(c).alias(name if c == "id" else f"{name}_{c}") for c in kept))


def _compared(left: DataFrame, right: DataFrame, on: str, most: int) -> DataFrame:
    """Pairs (a, b) under a common key that a built-in banded distance finds within the edits.

    Both sides hold texts, so the join lets nothing through but near lines; lines that are linked
    already are not compared. Under each key the lines of the root that most of them have are left out
    on one side: of two lines with different roots, one at least has another root.
    """
    columns = (on, "length", "t", "text", "parity", "root", "most")
    near = _fits(F.col("a_t"))

    def met(left: DataFrame, right: DataFrame, near: Column) -> DataFrame:
        a, b = _named(left, "a", *columns), _named(right, "b", *(c for c in columns if c != "t"))
        return a.join(b, (F.col(f"a_{on}") == F.col(f"b_{on}")) & near).select(*_pair("a", "b"))

    close = distance(F.col("a_text"), F.col("b_text"), most) >= 0
    if "parity" in left.columns and "parity" in right.columns:
        close = (F.bit_count(F.col("a_parity").bitwiseXOR(F.col("b_parity"))) <= 2 * most) & close
    if "root" not in left.columns:
        return met(left, right, near & close)
    main = left.groupBy(on, "root").agg(F.count("*").alias("rows")).groupBy(on).agg(F.max_by("root", F.struct("rows", "root")).alias("most"))
    main = written(main, "lines-main")
    left, right = left.join(main, on), right.join(main, on)
    near &= F.col("a_root") != F.col("b_root")
    other = F.col("root") != F.col("most")
    return met(left.where(other), right, near & close).unionByName(met(left.where(~other), right.where(other), near & close))


def _with_texts(rows: DataFrame, lines: DataFrame, parity: bool = False) -> DataFrame:
    """rows (id, ...) with their lines' text and, if asked for, its letters' parity; lines has (id, line) once each."""
    wanted = rows.select("id").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = lines.join(wanted, "id", "left_semi").select("id", F.col("line").alias("text"), *([_parity("line").alias("parity")] if parity else []))
    return rows.join(texts, "id")


def _verified(pairs: DataFrame, lines: DataFrame, bands: tuple) -> DataFrame:
    """The pairs (a, b) whose lines are within their edits; lines has (id, line) once each."""
    pairs = written(pairs.distinct(), "lines-candidates")
    most = max(t for _, t in bands)
    both = _with_texts(pairs.withColumnRenamed("a", "id"), lines).withColumnsRenamed({"id": "a", "text": "x"})
    both = _with_texts(both.withColumnRenamed("b", "id"), lines).withColumnsRenamed({"id": "b", "text": "y"})
    # spread out: few pairs can be much work
    spread = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    allowed = _edits(F.least(F.char_length("x"), F.char_length("y")), bands)
    return written(spread.where(distance(F.col("x"), F.col("y"), most).between(F.lit(0), allowed)).select("a", "b"), "lines-links")


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _rest(most: int, probing: bool) -> Column:
    """The line without the segment at place `at`."""
    def without(t: int) -> Column:
        places = _shifts(t) if probing else [(i, 0) for i in range(t + 1)]
        width = F.floor(F.col("low") / (t + 1)).cast("int")
        start = F.element_at(F.array(*(width * i + s for i, s in places)), F.col("at") + 1)
        return F.concat(F.substring(F.col("line"), F.lit(1), start), F.substring(F.col("line"), start + width + 1, F.length("line")))

    return _by_edits(without, most)


def _ends(index: DataFrame, probes: DataFrame, most: int) -> DataFrame:
    """Pairs of lines of which too little is left to cut.

    Lines are indexed at equal places, so those under a key of which no more letters are left than
    edits are all links: one leader stands for them. What probes under the key with as little, or up
    to as many letters more, is compared with each different rest of them: few, they are so short.
    """
    short = index.where(F.char_length("line") <= F.col("t"))
    lead = short.groupBy("chain").agg(F.min("id").alias("lead"))
    stars = short.join(lead, "chain").where("id <> lead").select(*_pair("id", "lead"))
    rests = short.groupBy("chain", "line", "t").agg(F.min(F.struct("id", "root", "length", "text")).alias("r"))
    return stars.union(_compared(rests.select("chain", "t", "r.*"), probes.where(F.char_length("line") <= 2 * most), "chain", most))


def links(lines: DataFrame, bands: tuple[tuple[int, int], ...], crowd: int = CROWD, busy: int = BUSY) -> DataFrame:
    """Pairs (a, b) of line ids that connect all lines within their edits of each other.

    lines has (id, line), each line once and longer than its edits; the shorter line of a pair tells
    the edits. Every link outside crowded entries is returned; inside them enough links to give the
    same components. A line is compared with at most `crowd` others under an entry.
    """
    most = max(t for _, t in bands)
    if most > 8:
        raise ValueError("more than 8 edits")
    index = lines.select("id", F.lit(0).cast("long").alias("chain"), "line", F.char_length("line").alias("length"))
    probes, found = index, None
    while True:
        entries, asked = _entries(_indexed(index, bands), most, False), _entries(_probing(probes, bands), most, True)
        sizes = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where(F.col("n") > min(busy, crowd))
        full = written(sizes, "lines-busy")
        some = not full.isEmpty()
        extra = [c for c in ("root", "chain") if c in index.columns and found is not None]
        # one pass over the probes: they meet lines under calm entries, and the marks of busy ones
        calm = entries.join(full, "key", "left_anti") if some else entries
        left = calm.select(F.col("key").alias("k"), F.col("id").alias("a"), F.col("length").alias("a_length"), F.col("t").alias("a_t"), *(F.col(c).alias(f"a_{c}") for c in extra))
        marks = full.select(F.col("key").alias("k"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns[1:]))
        right = asked.select("key", F.col("id").alias("b"), _packed().alias("where"), *(F.col(c).alias(f"b_{c}") for c in extra))
        allowed = (_part("where", 0) - F.col("a_length")).between(F.lit(0), F.col("a_t")) & (F.col("a") != F.col("b"))
        if extra:
            allowed &= F.col("a_root") != F.col("b_root")
        met = left.unionByName(marks).hint("shuffle_hash").join(right, (F.col("k") == F.col("key")) & (F.col("a").isNull() | allowed))
        met = written(met.select("key", "a", "b", "where", *(f"b_{c}" for c in extra)), "lines-met-keys")
        pairs = met.where("a is not null").select(*_pair("a", "b"))
        members = []
        if some:
            own = entries.join(full.select("key"), "key").select("key", "id", "length", "at", "t", "low", *extra)
            places = {n: _part("where", i).alias(n) for i, n in enumerate(PACKED)}
            other = met.where("a is null").select("key", F.col("b").alias("id"), *(places[n] for n in ("length", "at", "t", "low")), *(F.col(f"b_{c}").alias(c) for c in extra))
            members = [written(rows, "lines-members") for rows in (own, other)]
            # leaders first: what they link need not be compared again. Many entries have the same leader
            leads = members[0].join(full, "key").where("id = lead").select("key", "lead", F.col("length").alias("lead_length")).dropDuplicates(["key"])
            for rows in members:
                near = (F.col("id") != F.col("lead")) & (F.abs(F.col("length") - F.col("lead_length")) <= most)
                pairs = pairs.union(rows.join(leads, "key").where(near).select(*_pair("id", "lead")).distinct())
        first = found is None
        if not first:
            pairs = pairs.union(_ends(index, probes, most))
        fresh = _verified(pairs, lines, bands)
        found = fresh if first else found.union(fresh)
        if not some:
            return found
        roots = written(components(found, "lines-stars"), "lines-stars")
        rooted = [rows.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")) for rows in members]
        both = rooted[0].select("key", "root").union(rooted[1].select("key", "root"))
        apart = both.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two")).where("one <> two").select("key")
        apart = written(full.select("key", "n").join(apart, "key"), "lines-apart")
        # texts are fetched for entries only whose lines are not linked yet
        held = []
        for rows, frame in zip(rooted, (index, probes), strict=True):
            rows = _with_texts(written(rows.join(apart, "key"), "lines-rooted"), lines, True)
            # what is left of them at this level; at the first it is the line itself
            rows = rows.withColumn("line", F.col("text")) if first else rows.join(frame.select("chain", "id", "line"), ["chain", "id"]).drop("chain")
            held.append(written(rows, "lines-texts"))
        few = (rows.where(F.col("n") <= crowd) for rows in held)
        found = found.union(_verified(_compared(*few, "key", most), lines, bands))
        held = [rows.where(F.col("n") > crowd) for rows in held]
        if held[0].isEmpty():
            return found
        index, probes = (
            written(
                rows.select(F.col("key").alias("chain"), "id", "t", "length", "text", "root", _rest(most, probing).alias("line")).distinct(),
                "lines-again",
            )
            for rows, probing in zip(held, (False, True), strict=True)
        )


def _places(docs: DataFrame, id_col: str, text: Column) -> tuple[Column, Column]:
    """A row's place in the order of ids, null ones last, and its text's digest: rows alike in both are alike."""
    own = F.xxhash64(text)
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        unnamed = F.lit(Decimal(10**19)).cast("decimal(20,0)") + own.bitwiseAND(F.lit((1 << 62) - 1)).cast("decimal(20,0)")
        return F.coalesce(F.col(id_col).cast("decimal(20,0)"), unnamed.cast("decimal(20,0)")), own
    named = F.concat(F.lit("0"), F.col(id_col).cast("string"))
    return F.coalesce(named, F.concat(F.lit("1"), own.cast("string"))), own


def _order(place: Column, at: Column, numbers: bool) -> Column:
    if numbers:
        return (place * F.lit(PLACES).cast("decimal(11,0)") + at).cast("decimal(38,0)")
    return F.concat(place, F.lit("\0"), F.lpad(at.cast("string"), 10, "0"))


def dedup_lines(
    docs: DataFrame,
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    crowd: int = CROWD,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: tuple[tuple[int, int], ...] = (),
    exact_chars: int | None = None,
) -> DataFrame:
    """The documents with repeated lines cut from text_col, and n_lines and n_dropped.

    bands gives longer lines more edits. Not blank lines from exact_chars characters on (min_chars
    where None) go where they repeat exactly.
    """
    docs = docs.drop("n_lines", "n_dropped")
    shortest = min_chars if exact_chars is None else min(exact_chars, min_chars)
    steps = ((min_chars, max_edits), *((low, t) for low, t in bands if low > min_chars))
    if any(low <= t for low, t in steps):
        raise ValueError("lines must be longer than their edits")
    text = F.col(text_col).cast("string")
    place, own = _places(docs, id_col, text)
    numbers = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    # once a document: beside the lines they would be computed for each
    named = docs.select(place.alias("place"), own.alias("own"), text.alias("text"))
    every = named.select("place", "own", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    length = F.char_length("line")
    every = every.where((length >= min_chars) | (length >= shortest) & F.col("line").rlike(r"\S"))
    lines = every.where(length >= min_chars).select(F.xxhash64("line").alias("id"), "line").distinct()
    lines = written(lines, "lines-distinct")
    seen = written(
        every.select(
            "place",
            "own",
            "at",
            F.xxhash64("line").alias("id"),
            F.xxhash64(F.lit("check"), "line").alias("check"),
            _order(F.col("place"), F.col("at"), numbers).alias("ord"),
        ),
        "lines-seen",
    )
    firsts = seen.groupBy("id", "check").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    roots = written(components(links(lines, steps, crowd), "lines"), "lines-roots")
    linked = firsts.join(roots, "id")
    heads = linked.groupBy("root").agg(F.min("first").alias("keep"))
    near = linked.join(heads, "root").select("id", "check", "keep")
    alone = (
        firsts.where("n > 1").join(roots, "id", "left_anti").select("id", "check", F.col("first").alias("keep"))
    )
    repeated = written(near.unionByName(alone), "lines-repeated")
    a, b, c = unused(docs.columns, "place", "own", "gone")
    dropped = written(
        seen.join(repeated, ["id", "check"])
        .where(F.col("ord") > F.col("keep"))
        .groupBy(F.col("place").alias(a), F.col("own").alias(b))
        .agg(F.collect_set("at").alias(c)),
        "lines-dropped",
    )
    many = dropped.agg(F.sum(F.size(c) + 8)).first()[0] or 0
    if many <= BROADCAST_LINES:
        dropped = F.broadcast(dropped)

    def left(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(c))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    # split once: the parts are an argument of the inner function
    cut = F.transform(F.array(F.split(text, "\n", -1)), left)[0]
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        docs.withColumns({a: place, b: own})
        .join(dropped, [a, b], "left")
        .withColumns(
            {
                "n_lines": F.when(text.isNull(), F.lit(0)).otherwise(breaks + 1),
                "n_dropped": F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)),
                text_col: F.when(F.col(c).isNull(), F.col(text_col)).otherwise(cut),
            }
        )
        .drop(a, b, c)
    )
