"""Secret scans: fixed rules, and a character convolutional network over every candidate with its surroundings.

The network is trained in numpy on labelled findings of a bounded sample of documents: what rules found is a secret, other
candidates are none. So that it learns what secrets look like and not what rules look for, each finding is shown once as it
is and once in disguise: its marker (keyword, prefix, lower case) taken away until no rule finds it any more. Scores are
calibrated on one part of the candidates that it did not learn from, and the threshold is taken from another: the highest at
which the wanted share of that part's secrets is still found. Every candidate is scored; the network adds spans where no rule
applies, and what rules find always stays.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.llm.common import fresh, text_batches

#: The rules (fixed values): a match, and what must be long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HINTS = ("passw", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: A candidate: characters of RUN with a digit and a letter, at least so many.
DIGITS, TAIL, IN_RUN, LEAST = re.compile("[0-9]+"), re.compile(r"[A-Za-z0-9+/_.=-]*"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), 6
KINDS = ("assign", "access", "hex", "model")
LEFT, MID, RIGHT, WIDTH, EMBED, FILTERS = 24, 48, 8, 5, 8, 24
#: Character classes: printable ASCII by itself, one class for white space, one for all others, one for nothing.
CLASSES = 98


def by_rule(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what rules find, by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in RUN.finditer(text):  # a long run of hex digits lies in a long run
        if run.end() - run.start() >= 24:
            found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, *run.span()) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of LEAST characters or more with a digit and a letter; found from their digits, which prose has few of."""
    found, end = [], 0
    for m in DIGITS.finditer(text):
        start = m.start()
        if start < end:
            continue
        while start > end and text[start - 1] in IN_RUN:
            start -= 1
        end = TAIL.match(text, m.end()).end()
        if end - start >= LEAST and any(c.isalpha() for c in text[start:end]):
            found.append((start, end))
    return found


def _classes(text: str, start: int, end: int, width: int, right: bool = False) -> list[int]:
    codes = [96 if c.isspace() else ord(c) - 32 if " " < c <= "~" else 95 for c in text[max(start, 0) : max(end, 0)]]
    return [97] * (width - len(codes)) + codes if right else codes + [97] * (width - len(codes))


def windows(text: str, start: int, end: int) -> list[list[int]]:
    """Character classes of a candidate, MID at a time, each with what stands before and after the candidate."""
    before, after = _classes(text, start - LEFT, start, LEFT, right=True), _classes(text, end, end + RIGHT, RIGHT)
    return [before + _classes(text, s, min(s + MID, end), MID) + after for s in range(start, end, MID)]


@dataclass
class Net:
    """Embedding, convolution with ReLU, greatest and mean value over all places, one hidden layer; calibration a, b."""

    weights: dict[str, np.ndarray]
    a: float = 1.0
    b: float = 0.0
    threshold: float = 2.0

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        e = w["embed"][x] + w["place"]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).reshape(len(x), -1, EMBED * WIDTH)
        conv = np.maximum(cols @ w["conv"] + w["conv_b"], 0)
        top = conv.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(conv, top[:, None], 1)[:, 0], conv.mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
        return {"cols": cols, "conv": conv, "top": top, "pooled": pooled, "hidden": hidden, "z": (hidden @ w["out"] + w["out_b"])[:, 0]}

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])["z"] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -30, 30)))


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = LEFT + MID + RIGHT
    shapes = {"embed": (CLASSES, EMBED), "place": (size, EMBED), "conv": (EMBED * WIDTH, FILTERS), "conv_b": (FILTERS,), "dense": (2 * FILTERS, 16), "dense_b": (16,), "out": (16, 1), "out_b": (1,)}
    return {k: np.zeros(s) if k.endswith("_b") else rng.normal(0, 0.3 if k in ("embed", "place") else np.sqrt(2 / s[0]), s) for k, s in shapes.items()}


def _gradients(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    w, f = net.weights, net.forward(x)
    dz = ((1 / (1 + np.exp(-np.clip(f["z"], -30, 30))) - y) * weight / len(x))[:, None]
    g = {"out": f["hidden"].T @ dz, "out_b": dz.sum(0)}
    dh = dz @ w["out"].T * (f["hidden"] > 0)
    g |= {"dense": f["pooled"].T @ dh, "dense_b": dh.sum(0)}
    dp = dh @ w["dense"].T
    dc = np.repeat(dp[:, None, FILTERS:] / f["conv"].shape[1], f["conv"].shape[1], axis=1)
    rows = np.arange(len(x))[:, None]
    dc[rows, f["top"], np.arange(FILTERS)] += dp[:, :FILTERS]
    dc *= f["conv"] > 0
    g |= {"conv": np.tensordot(f["cols"], dc, axes=((0, 1), (0, 1))), "conv_b": dc.sum((0, 1))}
    dcols = (dc @ w["conv"].T).reshape(*dc.shape[:2], EMBED, WIDTH)
    de = np.zeros((len(x), x.shape[1], EMBED))
    for k in range(WIDTH):
        de[:, k : k + dc.shape[1]] += dcols[..., k]
    g["place"], g["embed"] = de.sum(0), np.zeros_like(w["embed"])
    np.add.at(g["embed"], x, de)
    return g


def fit(x: np.ndarray, y: np.ndarray, recall: float = 0.95, epochs: int = 12, seed: int = 7) -> Net:
    """Learns from windows x with labels y by Adam. Of every five rows of a label one serves for calibration only and one for
    the threshold only. With fewer than 8 rows of either label there is nothing to learn, and the threshold admits nothing."""
    rng = np.random.default_rng(seed)
    net = Net(_start(rng))
    if min((y == 1).sum(), (y == 0).sum()) < 8:
        return net
    part = np.zeros(len(y), int)
    for label in (0, 1):
        part[y == label] = np.arange((y == label).sum()) % 5
    tx, ty, cx, cy = x[part > 1], y[part > 1], x[part == 0], y[part == 0]
    weight = np.where(ty == 1, len(ty) / (2 * (ty == 1).sum()), len(ty) / (2 * (ty == 0).sum()))
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(w) for k, w in net.weights.items()}
    t = 0
    for _ in range(max(epochs, -(-600 * 64 // max(len(ty), 64)) if len(ty) < 3200 else epochs)):
        order = rng.permutation(len(ty))
        for i in range(0, len(order), 64):
            at, t = order[i : i + 64], t + 1
            for k, g in _gradients(net, tx[at], ty[at], weight[at]).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.weights[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    z = net.raw(cx)
    for _ in range(200):  # Platt scaling by Newton steps, lightly held to a = 1, b = 0
        p = 1 / (1 + np.exp(-np.clip(net.a * z + net.b, -30, 30)))
        s = p * (1 - p) + 1e-6
        grad = np.array([((p - cy) * z).sum() + 0.1 * (net.a - 1), (p - cy).sum() + 0.1 * net.b])
        hess = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        net.a, net.b = np.array([net.a, net.b]) - 0.5 * np.linalg.solve(hess, grad)
    found = np.sort(net.score(x[(part == 1) & (y == 1)]))
    net.threshold = float(found[int((1 - recall) * len(found))])
    return net


def disguised(text: str, start: int, end: int, kind: str) -> tuple[str, int, int] | None:
    """The text with the marker of a finding taken away, and where the secret lies then; None if a rule still finds it."""
    value = text[start:end]
    if kind == "assign":
        m = ASSIGN.match(text, start)
        text, end = text[:start] + m[2] + text[end:], start + len(m[2])
        value = m[2]
    draw = xxhash.xxh64(value.encode(), 1)
    if HEX.search(value) and any(m.end() - m.start() >= 24 for m in HEX.finditer(value)):
        value = value.upper()
    if value.startswith("AKIA"):
        value = "".join(chr(65 + draw.digest()[k] % 26) for k in range(4)) + value[4:]
    text = text[:start] + value + text[end:]
    return None if any(s < end and start < e for s, e, _ in by_rule(text)) else (text, start, end)


def training_rows(text: str) -> list[tuple[list[int], int]]:
    """Windows of all candidates of a text, 1 if what a rule found overlaps the candidate, and of its findings in disguise."""
    found = by_rule(text)
    rows = [(w, int(any(s < end and start < e for s, e, _ in found))) for start, end in candidates(text) for w in windows(text, start, end)]
    for start, end, kind in found:
        near = text[max(start - 200, 0) : end + 200]  # windows see no further
        at = start - max(start - 200, 0)
        if hidden := disguised(near, at, at + end - start, kind):
            rows += [(w, 1) for w in windows(*hidden)]
    return rows


def drawn_rows(text: str, windows_a_text: int) -> list[tuple[list[int], int]]:
    """At most so many of the training rows, from all over the text: those whose hashes of place and window are smallest."""
    rows = training_rows(text)
    if len(rows) <= windows_a_text:
        return rows
    at = sorted(range(len(rows)), key=lambda i: (xxhash.xxh64_intdigest(bytes(rows[i][0]), i), i))[:windows_a_text]
    return [rows[i] for i in sorted(at)]


def train(docs: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", windows_a_text: int = 64, most_windows: int = 20_000) -> Net:
    """Learns from the candidates of at most `sample` documents, those whose ids' hashes are smallest: at most `windows_a_text`
    windows of a document, drawn by hash from its whole text, and of all those `most_windows`, drawn by hash again."""
    chosen = docs.select(F.col(id_col).alias("chosen")).where("chosen is not null").orderBy(F.xxhash64("chosen"), "chosen").limit(sample).distinct()
    met = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi")

    def run(batches):
        for b in batches:
            rows = [row for t in b.column(1).to_pylist() for row in drawn_rows(t, windows_a_text)]
            w, y = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in w], pa.binary()), pa.array(y, pa.int32())], names=["w", "y"])

    got = met.mapInArrow(run, "w binary, y int").orderBy(F.xxhash64("w", "y"), "w", "y").limit(most_windows).collect()
    x = np.frombuffer(b"".join(r.w for r in got), np.uint8).reshape(-1, LEFT + MID + RIGHT)
    return fit(x, np.array([r.y for r in got], float))


def scores_of(texts: list[str], net: Net | None) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of every candidate of each text: the greatest of its windows' scores; 0 without a network."""
    out: list[list[tuple[int, int, float]]] = []
    places, x = [], []
    for k, text in enumerate(texts):
        out.append([(start, end, 0.0) for start, end in candidates(text)])
        if net is not None and net.threshold <= 1:
            for n, (start, end, _) in enumerate(out[-1]):
                w = windows(text, start, end)
                places += [(k, n)] * len(w)
                x += w
    if x:
        for (k, n), p in zip(places, net.score(np.array(x, np.uint8)).tolist(), strict=True):
            start, end, best = out[k][n]
            out[k][n] = start, end, max(best, p)
    return out


def spans_of(texts: list[str], net: Net | None) -> list[list[tuple[int, int, str]]]:
    """What rules find in each text, and the candidates beside it that the network takes for secrets."""
    return [_with_model(by_rule(text), scores, net) for text, scores in zip(texts, scores_of(texts, net), strict=True)]


def _with_model(found: list[tuple[int, int, str]], scores: list[tuple[int, int, float]], net: Net | None) -> list[tuple[int, int, str]]:
    added = [(start, end, "model") for start, end, p in scores if net is not None and p >= net.threshold and not any(s < end and start < e for s, e, _ in found)]
    return sorted(found + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else found


def scan(docs: DataFrame, net: Net | None, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """docs, all columns and rows, with the spans (start, end, kind) found in the whole text, in code points, in the column `into`,
    which gets a `_` if docs has it. A null or empty text has none. No rows in, no rows out."""
    kept = docs.sparkSession.sparkContext.broadcast(net)
    (name,) = fresh(docs, into)
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for b in batches:
            spans = spans_of([t or "" for t in b.column(at).to_pylist()], kept.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in row] for row in spans], kind)], names=[*b.schema.names, name])

    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(span))]))


def masked(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each span, or each union of overlapping ones, replaced by `mark`."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, net: Net | None, text_col: str = "text") -> DataFrame:
    """docs with secrets in the text replaced: same columns and rows. A null text stays null."""
    kept = docs.sparkSession.sparkContext.broadcast(net)
    text_batches(docs.sparkSession)

    @F.pandas_udf("string")  # texts alone go to Python
    def of(texts: pd.Series) -> pd.Series:
        spans = spans_of([t or "" for t in texts], kept.value)
        return pd.Series([t if not s or t is None else masked(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return docs.withColumn(text_col, of(F.col(text_col))).select(*docs.columns)


def digests(docs: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_candidates, n_over): n_over counts the candidates, of rules or not,
    whose score reaches the threshold. A null or empty text has none of all; each row is a text of its own, ids may be null
    or repeated. No rows in, no rows out."""
    kept = docs.sparkSession.sparkContext.broadcast(net)
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        said = lambda row: ",".join(f"{k}:{s}:{e}" for s, e, k in row)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            scores = scores_of(texts, kept.value)
            base = [by_rule(t) for t in texts]
            n = [[sum(s[2] == name for s in row) for row in base] for name in KINDS[:3]]
            over = [sum(p >= kept.value.threshold for _, _, p in row) if kept.value else 0 for row in scores]
            spans = [said(_with_model(found, row, kept.value)) for found, row in zip(base, scores, strict=True)]
            columns = [*n, [hashlib.sha256(said(row).encode()).hexdigest() for row in base], spans, [len(row) for row in scores], over]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns, kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_candidates", "n_over"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long, n_over long")
