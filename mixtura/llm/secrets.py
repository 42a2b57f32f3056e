"""Secret scan with character Markov models.

Plain patterns give the base spans. Two first-order Markov models over ASCII token characters are
trained on labelled samples that the corpus itself gives: the random model on the strings that the
base patterns label as secrets, the ordinary model on what stands outside them. The latter is trained
twice: first on identifiers, runs of token characters that are made of words, abbreviations and numbers,
joined by signs or by case; then on every run that the first model does not find random.

Every run of token characters, however short, becomes a span of kind ``random`` when its log-likelihood
ratio, in total and for each character, says that it looks drawn at random rather than written, and its
transitions are not a few ones repeated. Runs on both sides of a dot are judged apart, and joined if
both are random.

Transition counts cover every whole text; what comes to the driver is one table of fixed size
(2 models x 66 x 66), whatever the corpus holds.

Offsets count code points, ends are exclusive. A null or empty text has no spans, a null id is
passed on, repeated rows repeat their result, other columns are not read. On an empty table, or
where no text holds a secret, the random model is the uniform one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: What the ordinary model is trained on first.
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/=_-]{3})(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++)[+/=_-]?)++(?![A-Za-z0-9+/=_-])")

#: 0 for what stands outside a token, then the token characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
SIZE = len(ALPHABET) + 1
_CODE = np.zeros(256, dtype=np.uint16)
for _i, _c in enumerate(ALPHABET, 1):
    _CODE[ord(_c)] = _i
_CODE[ord("-")] = _CODE[ord("_")]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in KINDS."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if len(text) >= 32:
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]


def _pairs(codes: np.ndarray, into: np.ndarray) -> None:
    if len(codes) > 1:
        into += np.bincount(codes[:-1] * np.uint16(SIZE) + codes[1:], minlength=SIZE * SIZE)


def _secret_part(text: str, kind: str, start: int, end: int) -> str:
    found = text[start:end]
    return _ASSIGN.match(found)[2] if kind == "assign" else found


def _runs(raw: bytes, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of token characters of a UTF-8 text: starts and ends in bytes, log-likelihood ratios,
    and the text's codes with one that stands for its outside on both sides."""
    codes = np.zeros(len(raw) + 2, dtype=np.int64)
    codes[1:-1] = _CODE[np.frombuffer(raw, dtype=np.uint8)]
    token = codes > 0
    start, end = np.flatnonzero(token[1:] & ~token[:-1]), np.flatnonzero(token[:-1] & ~token[1:])
    total = np.concatenate([[0.0], np.cumsum(ratios[codes[:-1], codes[1:]])])
    # A run from the transition into it to the one out of it.
    return start, end, total[end + 1] - total[start], codes


def _random(start: np.ndarray, end: np.ndarray, score: np.ndarray, codes: np.ndarray, least: float, least_each: float) -> np.ndarray:
    """Which runs look random, by place."""
    good = (score >= least) & (score >= least_each * (end - start))
    for i in np.flatnonzero(good):
        own = codes[start[i] : end[i] + 2]
        good[i] = len(np.unique(own[:-1] * SIZE + own[1:])) >= min(30, max(3, (end[i] - start[i]) / 3))
    return np.flatnonzero(good)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of a task: model 1 for strings that the base patterns label, 0 for identifiers."""
    n = np.zeros((2, SIZE * SIZE), dtype=np.int64)
    for batch in batches:
        plain, size = [], 0
        for text in batch.column(0):
            if not (text := text.as_py()):
                continue
            at, found = 0, base_spans(text)
            for kind, s, e in found:
                _pairs(_codes(f" {_secret_part(text, kind, s, e)} "), n[1])
            # What the patterns label is no sample of ordinary text.
            for _, s, e in [*found, ("", len(text), len(text))]:
                if s > at:
                    plain += _IDENTIFIER.findall(text, at, s)
                at = max(at, e)
            size += len(text)
            if size > 1 << 20:
                _pairs(_codes(" ".join(["", *plain, ""])), n[0])
                plain, size = [], 0
        _pairs(_codes(" ".join(["", *plain, ""])), n[0])
    for model in (0, 1):
        (at,) = np.nonzero(n[model])
        yield pa.RecordBatch.from_pydict({"model": pa.array([model] * len(at), pa.int32()), "at": pa.array(at, pa.int32()), "n": pa.array(n[model][at], pa.int64())})


def _ordinary(batches: Iterator[pa.RecordBatch], ratios: np.ndarray, least: float, least_each: float) -> Iterator[pa.RecordBatch]:
    """Transition counts of a task, of all runs outside base spans that do not look random."""
    n = np.zeros(SIZE * SIZE, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            if not (text := text.as_py()):
                continue
            raw = text.encode("utf-8", "replace")
            start, end, score, codes = _runs(raw, ratios)
            shut = np.zeros(len(codes), bool)
            for _, s, e in base_spans(text):
                s, e = (len(text[:x].encode("utf-8", "replace")) for x in (s, e))
                shut[s : e + 1] = True
            for i in _random(start, end, score, codes, least, least_each):
                shut[start[i] : end[i] + 1] = True
            pair = codes[:-1] * SIZE + codes[1:]
            n += np.bincount(pair[~shut[:-1] & (pair > 0)], minlength=SIZE * SIZE)
    (at,) = np.nonzero(n)
    yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})


def log_ratios(counts: np.ndarray, size: float = 1000.0, prior: float = 0.5) -> np.ndarray:
    """log P(next | last) of the random model less that of the ordinary one. Rows are scaled down to
    ``size`` transitions before smoothing, so that a transition which neither model has seen tells
    nothing, however much more ordinary text there is."""
    n = counts.reshape(2, SIZE, SIZE)
    n = n * np.minimum(1, size / np.maximum(1, n.sum(axis=2, keepdims=True))) + prior
    p = np.log(n / n.sum(axis=2, keepdims=True))
    return p[1] - p[0]


def _any_case(counts: np.ndarray) -> np.ndarray:
    """The ordinary model's counts with all its text in capitals once more, as in names of constants."""
    up = np.arange(SIZE)
    up[27:53] = np.arange(1, 27)  # small letters follow the capitals in ALPHABET
    out, plain = counts.copy(), counts[0].reshape(SIZE, SIZE)
    a, b = np.nonzero(plain)
    moved = (up[a] != a) | (up[b] != b)
    np.add.at(out[0], up[a[moved]] * SIZE + up[b[moved]], plain[a[moved], b[moved]])
    return out


def train(docs: DataFrame, text_col: str = "text", least: float = 12.0, least_each: float = 0.35) -> np.ndarray:
    """The table of log ratios, from every text of ``docs``, in two passes."""
    found = docs.select(text_col).mapInArrow(_counts, "model int, at int, n long").groupBy("model", "at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SIZE * SIZE))
    for r in found:  # 2 x SIZE x SIZE rows at most
        counts[r.model, r.at] = r.n
    first = log_ratios(_any_case(counts))
    counts[0] = 0
    for r in docs.select(text_col).mapInArrow(lambda it: _ordinary(it, first, least, least_each), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[0, r.at] = r.n  # SIZE x SIZE rows at most
    return log_ratios(_any_case(counts))


def random_spans(text: str, ratios: np.ndarray, taken: list[tuple[str, int, int]], least: float, least_each: float) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    raw = text.encode("utf-8", "replace")
    start, end, score, codes = _runs(raw, ratios)
    ends = sorted((x, y) for _, x, y in taken)
    at = place = 0
    for i in _random(start, end, score, codes, least, least_each):
        # Bytes before the run as code points; the run itself is ASCII.
        place += len(raw[at : start[i]].decode("utf-8"))
        at = int(start[i])
        s, e = place, place + int(end[i] - start[i])
        if any(s < y and x < e for x, y in ends):
            continue
        if out and out[-1][2] == s - 1 and text[s - 1] == ".":
            out[-1] = ("random", out[-1][1], e)
        else:
            out.append(("random", s, e))
    return out


def find_secrets(docs: DataFrame, text_col: str = "text", span_col: str = "secret_spans", least: float = 12.0, least_each: float = 0.35, ratios: np.ndarray | None = None) -> DataFrame:
    """``docs`` with an array of (kind, start, end), by start, then kind. ``least`` is the total
    log-likelihood ratio that a random token needs, ``least_each`` the ratio for each character."""
    table = train(docs, text_col, least, least_each) if ratios is None else ratios

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = base_spans(text or "")
            found = sorted(found + random_spans(text or "", table, found, least, least_each), key=_order)
            out.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
        return pd.Series(out)

    return docs.withColumn(span_col, spans(F.col(text_col)))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and all spans as text."""
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), span_col="s").select("doc_id", "s")
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(shown(F.filter("s", lambda x: x["kind"] != "random")).cast("binary"), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"))
