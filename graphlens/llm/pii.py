"""Operator 13: personal data by patterns and a skip-chain conditional random field.

Fixed patterns give base spans. Every token that holds a digit or stands beside an @ is a variable of a
random field with the labels none, email, ip, card and phone; all other words are observed as none.
Tokens next to each other share a chain potential; tokens of a document that repeat each other (the
same letters and digits, or the same last seven digits) share a skip potential, however far apart.
Tokens of base spans are given. Loopy message passing over all fields of a batch at once yields the
other tokens' labels, and sure ones become added spans: what a pattern misses, but what looks like its
matches or repeats one of the same document.

The field is trained piecewise, with base spans as examples: sums over all documents of how often a
token's features meet a label, and two labels each other, are its sufficient statistics. A token that
repeats one of a base span is left out of them, as nobody labelled it. Features are a number below
CODES, so these sums have a fixed size, whatever the corpus; the driver fits node potentials by ridge
logistic regression, and pair potentials are shrunk pointwise mutual information.

Defined results: null and empty texts have no spans; texts of any length are read whole, in time that
grows with their length; repeated rows and null or repeated ids are rows like any other; an empty
table gives an empty result; other columns are ignored. Counts and base_sha256 are those of base spans;
spans has the added ones, too. Added spans never touch base spans.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
L = len(LABELS)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does: one that began inside a run would have begun before
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
RUN = re.compile(r"[A-Za-z0-9._%+-]*")
HOT = re.compile(r"[0-9@]")
JOINERS = "._%+-"
#: What may stand between two tokens that are next to each other. Tokens with blanks between them alone
#: have no potential: patterns of digits would have joined them.
GAP = re.compile(r"[ ().,;:/@+-]{1,3}")
#: Words before a token that say what it is.
CUES = {
    "email": 1, "e-mail": 1, "mail": 1, "ip": 2, "address": 2, "host": 2, "server": 2, "card": 3, "visa": 3, "mastercard": 3, "credit": 3,
    "phone": 4, "tel": 4, "telephone": 4, "call": 4, "mobile": 4, "fax": 4,
}
#: Sizes of a token's features: shape, digits, parts, sign before, sign after, Luhn, four small parts, cue.
SIZES = (8, 18, 5, 4, 4, 2, 2, 5)
CODES = int(np.prod(SIZES))
#: Groups of features that get a weight for each combination.
GROUPS = ((), (0, 1), (0, 2), (1, 3, 4), (0, 3, 4), (5,), (6,), (7,), (0, 7))
#: Spans are added where a label has this probability.
SURE = 0.8
#: Digits that an added span holds.
DIGITS = {1: (0, 1 << 30), 2: (4, 12), 3: (13, 19), 4: (7, 15)}
RIDGE, SHRINK, STEPS = 1.0, 0.001, 400
#: Repeated tokens are expected to agree: so many pairs that do, dealt out as labels are, count beside the corpus's.
AGREEING = 10_000
#: Rounds of message passing, the change that ends them, and how much of a message is kept.
ROUNDS, STILL, DAMP = 40, 1e-4, 0.3
BLOCK = 1 << 16
#: Characters of texts whose fields are solved together.
TOGETHER = 1 << 22


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether digits are a number of at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) of the patterns' matches, by label and start."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((1, start, found.end()))
        floor = found.end() if found else at + 1
        at = text.find("@", floor)
    if HOT.search(text) is None:
        return out
    out += [(2, *m.span()) for m in IP.finditer(text) if all(small(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((3, *m.span()))
    if "+" in text:
        out += [(4, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs that hold a digit or stand beside an @, without joiners at their ends."""
    out, at = [], 0

    def add(start: int, end: int) -> None:
        while start < end and text[start] in JOINERS:
            start += 1
        while start < end and text[end - 1] in JOINERS:
            end -= 1
        if start < end:
            out.append((start, end))

    while hit := HOT.search(text, at):
        place = start = hit.start()
        while start > at and text[start - 1] in LOCAL:
            start -= 1
        if text[place] == "@":
            add(start, place)
            start = place + 1
        at = RUN.match(text, start).end()
        add(start, at)
    return out


def _code(text: str, start: int, end: int) -> tuple[int, str | None]:
    """A token's features as one number, and the key that it shares with those that repeat it."""
    token = text[start:end]
    digits = _digits(token)
    parts = re.split(r"[._%+-]", token)
    letters = not all(p.isdigit() or not p for p in parts)
    joined = {c for c in token if c in JOINERS}
    if not letters:
        shape = 0 if not joined else 1 if joined == {"."} else 2 if joined == {"-"} else 3
    else:
        shape = 6 if not digits else 4 if not joined else 5 if joined <= {"."} else 7
    before, after = text[start - 1 : start], text[end : end + 1]
    n = len(digits)
    size = n if n < 13 else 13 if n < 16 else 14 if n == 16 else 15 if n < 20 else 16 if n < 33 else 17
    word = re.search(r"([A-Za-z-]+)[^A-Za-z-]*$", text[max(0, start - 24) : start])
    values = (
        shape, size, min(len(parts), 5) - 1, "@+(".find(before) + 1 if before else 0, "@)-".find(after) + 1 if after else 0,
        int(not letters and 13 <= n <= 19 and luhn(digits)), int(shape == 1 and len(parts) == 4 and all(map(small, parts))),
        CUES.get(word.group(1).lower(), 0) if word else 0,
    )
    code = 0
    for v, s in zip(values, SIZES, strict=True):
        code = code * s + v
    key = None
    if before != "@":
        key = "#" + digits[-7:] if not letters and n >= 5 else token.lower() if letters and len(token) >= 5 else None
    return code, key


@dataclass
class Field:
    """The variables of one text: spans, codes, given labels (-1: open), edges (i, j), and who repeats a given one.

    apart are the tokens that blanks alone part from the one before.
    """

    base: list[tuple[int, int, int]]
    spans: list[tuple[int, int]]
    codes: list[int]
    given: list[int]
    chain: list[tuple[int, int]]
    apart: set[int]
    skip: list[tuple[int, int]]
    hidden: list[bool]


def field(text: str | None) -> Field:
    text = text or ""
    base, spans = base_spans(text), tokens(text)
    order, given, at = sorted((s, e, k) for k, s, e in base), [], 0
    # spans of two kinds may overlap: the first kind counts
    reach = np.maximum.accumulate([e for _, e, _ in order]) if order else []
    for start, end in spans:
        while at < len(order) and reach[at] <= start:
            at += 1
        n, found = at, []
        while n < len(order) and order[n][0] < end:
            if order[n][1] > start:
                found.append(order[n][2])
            n += 1
        given.append(min(found, default=-1))
    codes, chain, apart, skip, last, of_key = [], [], set(), [], {}, {}
    for n, (start, end) in enumerate(spans):
        code, key = _code(text, start, end)
        codes.append(code)
        if n and (gap := start - spans[n - 1][1]) <= 3 and GAP.fullmatch(text, start - gap, start):
            if text[start - gap : start].isspace():
                apart.add(n)
            else:
                chain.append((n - 1, n))
        if key is not None:
            if key in last:
                skip.append((last[key], n))
            last[key] = n
            of_key.setdefault(key, []).append(n)
    hidden = [False] * len(spans)
    for group in of_key.values():
        if len(group) > 1 and any(given[n] > 0 for n in group):
            for n in group:
                hidden[n] = given[n] < 0
    return Field(base, spans, codes, given, chain, apart, skip, hidden)


def _neighbours(f: Field) -> list[tuple[int | None, int | None]]:
    """(left, right) pairs of the chain; None is a word that is observed as none."""
    linked, every = set(f.chain), range(len(f.spans))
    begins = [(None, n) for n in every if (n - 1, n) not in linked and n not in f.apart]
    return f.chain + begins + [(n, None) for n in every if (n, n + 1) not in linked and n + 1 not in f.apart]


def counted(texts: Iterator[str | None]) -> Counter:
    """How often codes meet labels (0, code, label), and labels each other in chains (1, ..) and skips (2, ..)."""
    out = Counter()
    for text in texts:
        if not text or HOT.search(text) is None:
            continue
        f = field(text)
        label = [max(g, 0) for g in f.given]
        out.update((0, c, y) for c, y, h in zip(f.codes, label, f.hidden, strict=True) if not h)
        for a, b in _neighbours(f):
            if not any(f.hidden[n] for n in (a, b) if n is not None):
                out[1, 0 if a is None else label[a], 0 if b is None else label[b]] += 1
        for a, b in f.skip:
            if not f.hidden[a] and not f.hidden[b]:
                out[2, label[a], label[b]] += 1
                out[2, label[b], label[a]] += 1
    return out


def _columns(codes: np.ndarray) -> np.ndarray:
    """For each code the places of its weights, one in each group."""
    values = np.array(np.unravel_index(codes, SIZES)).T.reshape(len(codes), len(SIZES))
    out, base = [], 0
    for group in GROUPS:
        at = np.zeros(len(codes), dtype=np.int64)
        for g in group:
            at = at * SIZES[g] + values[:, g]
        out.append(base + at)
        base += int(np.prod([SIZES[g] for g in group])) if group else 1
    return np.array(out).T.reshape(len(codes), len(GROUPS))


WEIGHTS = sum(int(np.prod([SIZES[g] for g in group])) if group else 1 for group in GROUPS)


@dataclass(frozen=True)
class Model:
    """weights of codes (WEIGHTS, L) and log potentials of chains and skips (2, L, L)."""

    weights: np.ndarray
    pairs: np.ndarray

    def unary(self, codes: np.ndarray) -> np.ndarray:
        scores = self.weights[_columns(codes)].sum(axis=1)
        return scores - _log_sum(scores)


def _log_sum(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=-1, keepdims=True)
    return top + np.log(np.exp(scores - top).sum(axis=-1, keepdims=True))


def fit(counts: dict[tuple[int, int, int], int]) -> Model:
    """The model of summed counts."""
    codes = np.array(sorted({c for k, c, _ in counts if k == 0}), dtype=np.int64)
    place, seen = {c: n for n, c in enumerate(codes.tolist())}, np.zeros((len(codes), L))
    joint = np.zeros((2, L, L))
    for (kind, a, b), n in counts.items():
        if kind == 0:
            seen[place[a], b] += n
        else:
            joint[kind - 1, a, b] += n
    joint[1] += AGREEING * np.diag(seen.sum(axis=0) / max(seen.sum(), 1))
    return Model(_ridge(_columns(codes), seen), np.array([_information(j) for j in joint]))


def _ridge(columns: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression: steps by a fixed bound of the curvature, sped up by momentum."""
    weights = np.zeros((WEIGHTS, L))
    if not len(columns):
        return weights
    used, inner = np.unique(columns, return_inverse=True)
    x = np.zeros((len(columns), len(used)))
    np.add.at(x, (np.arange(len(columns))[:, None], inner.reshape(columns.shape)), 1.0)
    total = seen.sum(axis=1, keepdims=True)
    bound = np.linalg.inv(x.T @ (x * total) / 2 + RIDGE * np.eye(len(used)))
    w = ahead = np.zeros((len(used), L))
    for step in range(STEPS):
        scores = x @ ahead
        gradient = x.T @ (seen - total * np.exp(scores - _log_sum(scores))) - RIDGE * ahead
        new = ahead + bound @ gradient
        ahead, w = new + step / (step + 3) * (new - w), new
    weights[used] = w
    return weights


def _information(joint: np.ndarray) -> np.ndarray:
    """Pointwise mutual information of two labels, shrunk towards none."""
    expected = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True) / max(joint.sum(), 1)
    return np.log((joint + 1 + SHRINK * expected) / (expected + 1 + SHRINK * expected))


def beliefs(unary: np.ndarray, ends: np.ndarray, kinds: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Probabilities of labels by damped sum-product messages; ends (edges, 2), kinds say which of pairs an edge has."""
    if not len(ends):
        return np.exp(unary - _log_sum(unary))
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    potential = np.concatenate([pairs[kinds], pairs[kinds].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    sent = np.zeros((len(source), L))

    def totals() -> np.ndarray:
        return unary + np.array([np.bincount(target, weights=sent[:, y], minlength=len(unary)) for y in range(L)]).T

    for _ in range(ROUNDS):
        known, new = totals(), np.empty_like(sent)
        for a in range(0, len(source), BLOCK):
            b = slice(a, a + BLOCK)
            scores = (known[source[b]] - sent[back[b]])[:, :, None] + potential[b]
            new[b] = _log_sum(scores.transpose(0, 2, 1))[:, :, 0]
        new -= _log_sum(new)
        new = DAMP * sent + (1 - DAMP) * new
        still = np.abs(new - sent).max() < STILL
        sent = new
        if still:
            break
    found = totals()
    return np.exp(found - _log_sum(found))


def probabilities(fields: list[Field], model: Model) -> list[np.ndarray]:
    """For each field the probabilities of its tokens' labels."""
    sizes = [len(f.spans) for f in fields]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.array([c for f in fields for c in f.codes], dtype=np.int64)
    if not len(codes):
        return [np.zeros((0, L)) for _ in fields]
    distinct, inverse = np.unique(codes, return_inverse=True)
    unary = model.unary(distinct)[inverse].copy()
    ends, kinds = [], []
    for f, base in zip(fields, offsets.tolist(), strict=False):
        for a, b in _neighbours(f):
            if a is None:
                unary[base + b] += model.pairs[0, 0]
            elif b is None:
                unary[base + a] += model.pairs[0, :, 0]
        ends += [(base + a, base + b) for a, b in f.chain] + [(base + a, base + b) for a, b in f.skip]
        kinds += [0] * len(f.chain) + [1] * len(f.skip)
    given = np.array([g for f in fields for g in f.given])
    fixed = given > 0
    unary[fixed] = -50.0
    unary[fixed, given[fixed]] = 0.0
    found = beliefs(unary, np.array(ends, dtype=np.int64).reshape(-1, 2), np.array(kinds, dtype=np.int64), model.pairs)
    return [found[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def added_spans(text: str, f: Field, found: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, start, end) of the open tokens that are sure; tokens of one address or one number become one span."""
    label = np.where(found.max(axis=1) >= SURE, found.argmax(axis=1), 0).tolist() if len(found) else []
    linked, out = set(f.chain), []
    for n, (start, end) in enumerate(f.spans):
        y = label[n]
        if f.given[n] > 0 or not y:
            continue
        more = out and out[-1][3] == n - 1 and out[-1][0] == y and (n - 1, n) in linked
        gap = text[out[-1][2] : start] if more else ""
        if more and (y == 4 and gap[-1] not in "(+" and not set(gap) - set(" ().-") or y == 1 and gap == "@"):
            out[-1] = (y, out[-1][1], end, n)
        else:
            out.append((y, start - (y == 4 and text[start - 1 : start] in ("(", "+")), end, n))
    base = sorted((s, e) for _, s, e in f.base)
    starts = np.array([s for s, _ in base])
    reach = np.maximum.accumulate([e for _, e in base]) if base else []

    def free(start: int, end: int) -> bool:
        at = int(np.searchsorted(starts, end)) if base else 0
        return at == 0 or reach[at - 1] <= start

    fits = [(y, s, e) for y, s, e, _ in out if DIGITS[y][0] <= len(_digits(text[s:e])) <= DIGITS[y][1] and free(s, e)]
    return sorted(fits)


def _batches(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in groups of a bounded number of characters, or one longer text."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def spans_of(texts: list[str | None], model: Model) -> Iterator[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    for group in _batches(texts):
        fields = [field(t) for t in group]
        for t, f, p in zip(group, fields, probabilities(fields, model), strict=True):
            yield f.base, added_spans(t, f, p)


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all documents: sums of a fixed size reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter()
        for batch in batches:
            sums += counted(batch.column(0).to_pylist())
        keys = np.array(list(sums), dtype=np.int32).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(keys[:, n]) for n in range(3)), pa.array(list(sums.values()), pa.int64())], names=["kind", "a", "b", "n"]
        )

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(task, "kind int, a int, b int, n long")
    rows = parts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return fit({(r["kind"], r["a"], r["b"]): r["n"] for r in rows})


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): all spans of each row's text as (kind, start, stop, added), by kind and start.

    Places count code points, stop is exclusive. The model is learnt from the documents if none is given.
    """
    model = model or learn(docs, text_col)
    place = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("added", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": LABELS[k], "start": s, "stop": e, "added": a} for k, s, e, a in sorted([(*b, False) for b in base] + [(*m, True) for m in more])]
                for base, more in spans_of(batch.column("text").to_pylist(), model)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(place))], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<kind:string,start:long,stop:long,added:boolean>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, schema).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [KIND] for every span; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The documents with their personal data masked; null texts stay null."""
    model = model or learn(docs, text_col)

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        done = [
            masked(t, [(LABELS[k], s, e) for k, s, e in base + more]) if t is not None else None
            for t, (base, more) in zip(texts, spans_of(list(texts), model), strict=True)
        ]
        return pd.Series(done, dtype=object)

    return docs.withColumn(text_col, hide(F.col(text_col).cast("string")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans): base counts, base digest and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col, *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")
    )
