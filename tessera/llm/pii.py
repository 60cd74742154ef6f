"""Personal data: pattern matches, and a skip-chain conditional random field over mentions."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .textgrams import give_back

KINDS = ("email", "ip", "card", "phone")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,3}[0-9])+")
HANDLE = re.compile(r"[A-Za-z0-9._%+-]+")
NAME = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z]+(?:[._][A-Za-z]+)*(?:[._]?[0-9]{1,4})(?![A-Za-z0-9._%+@-])|(?<![A-Za-z0-9._%+-])[A-Za-z]{2,}(?:[._][A-Za-z]{2,})+(?![A-Za-z0-9_%+@-])")
#: Classes of the word before a mention.
WORDS = 16
#: Documents whose matches train the model at most, and steps of its fit.
TRAIN_DOCS, STEPS = 512, 300


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and non-overlapping within a kind, by start and kind.

    An email's local part is the run of its characters before the @, back to the last match; so
    only texts with an @ are looked at, and only around it.
    """
    found, last = [], 0
    if "@" in text:
        for m in AT.finditer(text):
            at = m.start()
            low = at
            while low > last and HANDLE.match(text, low - 1, low):
                low -= 1
            if low < at:
                found.append(Span(low, 0, m.end()))
                last = m.end()
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                found.append(Span(m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and _luhn(d):
                found.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(Span(m.start(), 3, m.end()))
    return sorted(found)


class Mention(NamedTuple):
    start: int
    end: int
    label: int  # 0 to 3: given by a pattern; -1: open
    form: str  # what repeated mentions share
    features: tuple[float, ...]


def _features(form: str, email: bool, text: str = "", start: int = 0, end: int = 0) -> tuple[float, ...]:
    """What a mention looks like, and where it stands: length and check digit, groups, what touches it, the word before."""
    n = 0 if email else len(form)
    shape = (1.0, float(email), float(7 <= n <= 9), float(10 <= n <= 13), float(14 <= n <= 19), float(n > 19), float(14 <= n <= 19 and _luhn(form)))
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    groups = len(re.findall("[0-9]+", text[start:end])) if not email else 0
    touched = (float(before.isalnum() or after.isalnum()), float(before in ('"', "=", "'") and before != ""), float(groups >= 3), float("(" in text[start:end]))
    word = re.search(r"([^\W\d_]+)[^\w\n]{0,3}$", text[max(0, start - 24) : start])
    bucket = zlib.crc32(word[1].lower().encode()) % WORDS if word else -1
    return shape + touched + tuple(float(k == bucket) for k in range(WORDS))


def _form(text: str, kind: int) -> str:
    return text.partition("@")[0].lower() if kind == 0 else _digits(text)


def mentions(text: str, base: list[Span]) -> list[Mention]:
    """Pattern matches, and all else that could be an entity: numbers of 7 digits or more, words
    that equal a matched email's local part, and words built like one, of letters with dots,
    underscores or digits inside."""
    found = [Mention(s.start, s.end, s.kind, f := _form(text[s.start : s.end], s.kind), _features(f, s.kind == 0, text, s.start, s.end)) for s in base]
    locals_ = {m.form for m in found if m.label == 0 and len(m.form) >= 5}
    spans = sorted((s.start, s.end) for s in base)

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(spans, (b, -1))
        return all(e <= a or s >= b for s, e in spans[max(0, i - 4) : i + 1])

    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 7 and len(d := _digits(m[0])) >= 7 and free(m.start(), m.end()):
            found.append(Mention(m.start(), m.end(), -1, d, _features(d, False, text, m.start(), m.end())))
    for m in HANDLE.finditer(text) if locals_ else NAME.finditer(text):
        word = m[0].rstrip(".").lower()
        if (word in locals_ or NAME.fullmatch(word)) and free(m.start(), m.start() + len(word)):
            found.append(Mention(m.start(), m.start() + len(word), -1, word, _features(word, True, text, m.start(), m.start() + len(word))))
    return sorted(found)


def links(found: list[Mention]) -> list[tuple[int, int, int]]:
    """(i, j, type): type 0 joins neighbours, 1 repeated mentions, 2 similar ones.

    A mention joins the one before of the same form and, if it is open, the nearest given one;
    forms are similar when the last seven digits agree. Links grow with the mentions.
    """
    out, last, given, tails = [], {}, {}, {}
    for i, m in enumerate(found):
        if i:
            out.append((i - 1, i, 0))
        if m.form in last:
            out.append((last[m.form], i, 1))
        last[m.form] = i
    for i, m in enumerate(found):
        if m.label >= 0:
            given.setdefault(m.form, i)
            if m.label:
                tails.setdefault(m.form[-7:], i)
    for i, m in enumerate(found):
        if m.label < 0:
            if m.form in given:
                out.append((given[m.form], i, 1))
            elif m.form.isdigit() and m.form[-7:] in tails:
                out.append((tails[m.form[-7:]], i, 2))
    return out


class Model(NamedTuple):
    node: np.ndarray  # (5, features); label 4 is none
    pair: np.ndarray  # (3, 5, 5)


def train(texts: list[str], steps: int = STEPS) -> Model:
    """Weights by pseudo-likelihood on pattern matches with damaged repeats and unlinked decoys.

    Each match is repeated once without what its pattern needs, which keeps the label and is
    linked to it; numbers of many lengths without a partner are none. A mention's label is then
    fitted given the labels around it.
    """
    rng = np.random.Generator(np.random.PCG64(5))
    node, pair, gold = [], [], []

    def add(features, label, around):
        node.append(features)
        gold.append(label)
        pair.append(around)

    for text in texts:
        base = base_spans(text)
        given = set()
        for s in base:
            form = _form(text[s.start : s.end], s.kind)
            given |= {form, form[-7:]}
            similar = s.kind in (2, 3) and rng.random() < 0.3
            shown = form[-7:] if similar else form
            where = (text, s.start, s.start + len(form)) if s.kind == 0 else (text, s.start + (s.kind == 3), s.end)  # without the domain, without the plus
            add(_features(shown, s.kind == 0, *where), s.kind, [(0, 4), (2 if similar else 1, s.kind)])
            add(_features(form, s.kind == 0, *where), s.kind, [(0, int(rng.integers(5))), (1, s.kind)])
        for m in mentions(text, base):
            if m.label < 0 and m.form not in given and m.form[-7:] not in given:
                add(m.features, 4, [(0, int(rng.integers(5)))])
                add(m.features, 4, [(0, 4), (1, 4)])
    for n in list(range(7, 25)) * 20:
        form = "".join(map(str, rng.integers(0, 10, n)))
        add(_features(form, False, f"{form} ", 0, n), 4, [(0, int(rng.integers(5)))])
        add(_features(form, False, f"{form} ", 0, n), 4, [(0, 4), (1, 4)])
    for name in ("none", "first.last", "name7"):
        add(_features(name, True, name, 0, len(name)), 4, [(0, 4)])
    x, y = np.array(node), np.array(gold)
    ctx = np.zeros((len(y), 15))
    for i, around in enumerate(pair):
        for t, label in around:
            ctx[i, 5 * t + label] += 1
    z = np.concatenate([x, ctx], 1)
    w = np.zeros((5, z.shape[1]))
    for _ in range(steps):
        p = np.exp(z @ w.T - (z @ w.T).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w -= 1.5 * (p.T @ z / len(y) + 1e-4 * w)
    k = x.shape[1]
    both = np.stack([w[:, k + 5 * t : k + 5 * t + 5] for t in range(3)])
    return Model(w[:, :k], (both + both.transpose(0, 2, 1)) / 2)


def marginals(found: list[Mention], model: Model, rounds: int = 40) -> np.ndarray:
    """Labels' probabilities by loopy message passing; given labels are held."""
    n = len(found)
    unary = np.array([m.features for m in found]) @ model.node.T
    for i, m in enumerate(found):
        if m.label >= 0:
            unary[i] = -1e3
            unary[i, m.label] = 0
    edges = links(found)
    if not edges:
        e = np.exp(unary - unary.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    a, b, t = (np.array(c) for c in zip(*edges))
    src, dst, pot = np.concatenate((a, b)), np.concatenate((b, a)), model.pair[np.concatenate((t, t))]
    m, back = np.zeros((len(src), 5)), np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, m)
        out = (belief[src] - m[back])[:, :, None] + pot
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        m = 0.5 * m + 0.5 * (new - new.max(1, keepdims=True))
    belief = unary.copy()
    np.add.at(belief, dst, m)
    e = np.exp(belief - belief.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def all_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Base spans and the open mentions that the model labels, without overlaps among these."""
    found = mentions(text, base)
    if all(m.label >= 0 for m in found):
        return base
    p, more, last = marginals(found, model), [], -1
    for i, m in enumerate(found):
        k = int(p[i].argmax())
        if m.label < 0 and k < 4 and m.start >= last:
            more.append(Span(m.start, k, m.end))
            last = m.end
    return sorted(base + more)


def train_model(docs: DataFrame, text_col="text", most=TRAIN_DOCS, looked_at=8, longest=100_000) -> Model:
    """Fit on at most `most` documents that look like they hold matches.

    They are sought among about `looked_at` times as many documents of at most `longest`
    characters, a share that a hash of the text picks, so that what reaches the driver does not
    grow with the input.
    """
    share = min(1.0, looked_at * most / max(1, docs.count()))
    text = F.col(text_col)
    picked = docs.select(text.alias("text")).where((F.length(text) <= longest) & (F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(share * (1 << 30))))
    likely = picked.where(F.col("text").rlike("@[A-Za-z0-9]|[0-9]{3}"))
    return train([r.text for r in likely.orderBy(F.xxhash64("text"), "text").limit(most).collect()])


FIELDS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def find_personal_data(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Counts and a digest of pattern matches, and all spans as kind:start:end, by document.

    Null text is empty; without matches the spans are '' and the digest that of ''. Null ids,
    repeated rows and other columns change nothing; an empty table gives no rows.
    """
    weights = model

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            rows = []
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = cell.as_py() or ""
                base = base_spans(text)
                said = lambda spans: ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)
                count = [sum(s.kind == k for s in base) for k in range(4)]
                rows.append((doc_id, *count, hashlib.sha256(said(base).encode()).hexdigest(), said(all_spans(text, base, weights))))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], list(FIELDS))

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)


def redact(docs: DataFrame, model: Model, *, text_col="text") -> DataFrame:
    """Replace every span by its kind in brackets; all columns are kept."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            at, out = batch.schema.get_field_index(text_col), []
            for cell in batch.column(at):
                text = cell.as_py()
                if text:
                    parts, last = [], 0
                    for s in all_spans(text, base_spans(text), model):
                        if s.start >= last:
                            parts += [text[last : s.start], f"[{KINDS[s.kind].upper()}]"]
                        last = max(last, s.end)
                    text = "".join(parts) + text[last:] if parts else text
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, train_model(docs))
