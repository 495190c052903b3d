"""Operator 5: secrets by fixed patterns and by character Markov models of random and ordinary strings."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import documents, text_slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same maximal runs as [0-9a-f]+, short ones left out
KEYWORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "markov")

#: A candidate of the method: a run of these characters of MIN_RUN at least that has both a letter and a digit.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Ordinary strings to learn from: identifier-like runs without a base span.
ORDINARY = re.compile(r"[A-Za-z0-9+/_-]{6,}={0,2}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
CODE = np.full(128, len(ALPHABET), np.uint8)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
N = len(ALPHABET) + 1  # the last code is the string's start (and any other character)
#: A candidate is a secret if its log2 likelihood ratio, random to ordinary, is this many bits a character or more.
THRESHOLD = 1.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start, then kind. Code points, end exclusive."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_value(text: str, span: tuple[int, int, int]) -> str:
    """The secret string in a base span: the assigned value, or the whole match."""
    found = text[span[0]:span[2]]
    return ASSIGN.match(found).group(2) if span[1] == 0 else found


def _codes(s: str) -> np.ndarray:
    return CODE[np.frombuffer(s.encode("ascii"), np.uint8)]


def transition_counts(strings: list[str]) -> np.ndarray:
    """Counts of (previous, next) characters, the start being the previous one of the first."""
    if not strings:
        return np.zeros(N * N, np.int64)
    # A newline has the code of "start": pairs (start, first) come from it, pairs (last, start) are taken out.
    codes = _codes("\n" + "\n".join(strings)).astype(np.int64)
    pairs = codes[:-1] * N + codes[1:]
    return np.bincount(pairs[codes[1:] != N - 1], minlength=N * N)


def labelled_counts(samples: DataFrame) -> np.ndarray:
    """counts[label, previous, next] over all labelled samples (columns text, is_secret).

    Sums are formed in the tasks; the driver gets at most 2 * N * N numbers. Rows with nulls are left out.
    """

    def run(batches):
        total = np.zeros((2, N * N), np.int64)
        for b in batches:
            strings = ([], [])
            for t, y in zip(b.column("text").to_pylist(), b.column("is_secret").to_pylist()):
                if t and y is not None:
                    strings[bool(y)].append("".join(c if c.isascii() else "\n" for c in t))
            for y in (0, 1):
                total[y] += transition_counts(strings[y])
        yield _count_batch(total)

    return _summed(samples.select("text", "is_secret").mapInArrow(run, "label int, pair int, n long"))


def _count_batch(total: np.ndarray) -> pa.RecordBatch:
    label, pair = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[label, pair])],
                                      ["label", "pair", "n"])


def _summed(counts: DataFrame) -> np.ndarray:
    out = np.zeros((2, N * N), np.int64)
    for r in counts.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        out[r["label"], r["pair"]] = r["n"]
    return out.reshape(2, N, N)


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """As :func:`labelled_counts`, with samples labelled by the fixed patterns, over all documents.

    Secrets: the values that the patterns find. Ordinary: every identifier-like run that overlaps no such span.
    """

    def run(batches):
        total = np.zeros((2, N * N), np.int64)
        for b in batches:
            for _, texts in text_slices(b.column("text")):  # the runs of a whole batch would take many times its size
                secret, plain = [], []
                for raw in texts:
                    if not raw:
                        continue
                    t = raw.decode()
                    spans = base_spans(t)
                    for s in spans:
                        secret.append(secret_value(t, s))
                    if spans:
                        t = list(t)
                        for s, _, e in spans:
                            t[s:e] = "\n" * (e - s)
                        t = "".join(t)
                    plain += ORDINARY.findall(t)
                total[1] += transition_counts(secret)
                total[0] += transition_counts(plain)
        yield _count_batch(total)

    return _summed(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "label int, pair int, n long"))


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log2 P(next | previous) of secrets minus that of ordinary strings.

    Each model is smoothed by its own character distribution, and that by a uniform one. A model without samples
    is uniform; two such models give ratios of 0, which flag nothing.
    """
    logs = []
    for c in counts.astype(float):
        chars = c.sum(axis=0) + 1.0
        chars[-1] = 0.0
        chars /= chars.sum()
        p = (c + 20.0 * chars) / (c.sum(axis=1, keepdims=True) + 20.0)
        logs.append(np.log2(np.maximum(p, 1e-12)))
    return logs[1] - logs[0]


def method_spans(text: str, ratios: np.ndarray, taken: list[tuple[int, int, int]], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span and whose mean log2 ratio a character reaches the threshold."""
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        found = m.group()
        if not any(c.isdigit() for c in found) or not any(c.isalpha() for c in found):
            continue
        if any(a < e and s < z for a, _, z in taken):
            continue
        codes = _codes("\n" + found)
        if ratios[codes[:-1], codes[1:]].mean() >= threshold:
            out.append((s, len(KINDS) - 1, e))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every row (null text: empty)."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                base = base_spans(t) if t else []
                more = method_spans(t, ratios, base, threshold) if t else []
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more)), len(more)))
            data = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, k) for x, k in zip(data, kinds)]],
                                             [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, ratios: np.ndarray, mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret span (overlapping ones merged) replaced by ``mark``; n_chars follows where present."""
    names = docs.columns

    def run(batches):
        for b in batches:
            column = names.index("text")
            for first, texts in text_slices(b.column(column)):
                part = b.slice(first, len(texts))
                texts = [t if t is None else t.decode() for t in texts]
                changed = []
                for t in texts:
                    if t:
                        base = base_spans(t)
                        end, parts, at = -1, [], 0
                        for s, _, e in sorted(base + method_spans(t, ratios, base, threshold)):
                            if s >= end:
                                parts += [t[at:s], mark]
                            end = at = max(end, e)
                        t = "".join(parts) + t[at:] if parts else t
                    changed.append(t)
                columns = list(part.columns)
                columns[column] = pa.array(changed, b.schema.field(column).type)
                if "n_chars" in names:
                    i = names.index("n_chars")
                    columns[i] = pa.array([n if x == y else len(y) for n, x, y in zip(columns[i].to_pylist(), texts, changed)], columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Secrets of every document; columns as in :func:`scan`.

    ``labelled`` (text, is_secret) trains the two character models; without it, the values that the fixed patterns
    find in ``docs`` and all other identifier-like runs do. Base spans are always kept; the method adds ``markov``
    spans beside them. Null and empty texts have no spans; repeated rows and null ids keep their rows;
    an empty table gives no rows; other columns are ignored.
    """
    ratios = log_ratios(corpus_counts(docs) if labelled is None else labelled_counts(labelled))
    return scan(docs, ratios)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
