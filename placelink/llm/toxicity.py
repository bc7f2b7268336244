"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks (operator 8).

The kernel of two tokens counts their common subsequences of three characters, each weighted by
``DECAY`` per skipped character and normalised; punctuation inside a token only counts as a gap,
so an insult with inserted or dropped characters stays close to the insult, and single characters
set apart ("x y z") are read as one token. Landmarks are training tokens; a token's Nystroem
features are its kernels with the landmarks, whitened. The machine is linear in them, so its
decision equals one inner product of the token's subsequence features with a fixed vector, which
is how all tokens of whole texts are scored in numpy.

Labels mark whole texts, not tokens: each labelled text is a bag of its sentences' tokens.
Training starts from the tokens whose character n-grams stand out in toxic texts (if none does
surely, from those whose tokens' own rates do best), and then alternates between fitting and taking
each toxic text's strongest tokens as positive and each clean text's strongest as negative. Only a
token whose rate in toxic texts is over ``LEAN`` times that in clean ones can be positive, and none
such is negative: a clean text that quotes an insult or is labelled wrongly takes nothing away. A text's score is the logistic of its strongest token's
decision, calibrated on the training texts. Fitting takes ``train_rows`` labelled rows of each
class at most; every text is scored whole.

Defined cases: null and empty texts score as texts without a toxic token; a null label or a label
without a document is not learned; several labels of one document count each; without a label of
each class every score is 0, and so they are, with a warning, if the texts of a class have no token
to learn from; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngrams, shared
from .vectext import LOWER, prefix_hash, span_hash, utf8, word_spans

TRAIN_ROWS, LANDMARKS, DECAY, WIDTH, STEP, SPAN = 1500, 320, 0.6, 24, 12, 6
#: Standard errors by which an n-gram's share of toxic texts must exceed that of clean ones.
SURE = 3.5
#: Times that a positive token's rate in toxic texts must exceed that in clean ones; tokens to start from if none is sure.
LEAN, FEW = 3.0, 20
#: Text in one step of a task, whose arrays take some hundred bytes for a byte, and features in one step within it.
STEP_BYTES, CELLS = 1 << 19, 1 << 18
CLASSES = 64
_class = np.full(256, -1, np.int32)
_class[97:123] = np.arange(26)
_class[65:91] = np.arange(26)
_class[48:58] = 26 + np.arange(10)
_class[128:] = 36 + (np.arange(128) % 26)
HEAD, TAIL = 62, 63
_OFFSETS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def token_spans(col: pa.Array):
    """Bytes (A-Z lower-cased) and spans of the tokens with the row of each: words without the
    punctuation around them, runs of single characters as one token, long words as overlapping
    windows."""
    b, off = utf8(col)
    b = LOWER[b]
    start, end, row = word_spans(b, off)
    if not len(start):
        return b, start, end, row
    solid = np.flatnonzero(_class[b] >= 0)
    a, z = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = z > a
    start, end, row = solid[a[some]], solid[z[some] - 1] + 1, row[some]
    single = (end - start) == 1
    follows = np.zeros(len(start), bool)
    follows[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    head = single & ~follows
    tail = single & ~np.append(follows[1:], False)
    run_s, run_e, run_r = start[head], end[tail], row[head]
    whole = ~single
    start, end, row = [np.concatenate(x) for x in ((start[whole], run_s), (end[whole], run_e), (row[whole], run_r))]
    keep = (end - start) >= 3
    start, end, row = start[keep], end[keep], row[keep]
    long = np.flatnonzero(end - start > WIDTH)
    if len(long):
        count = -(-(end[long] - start[long] - WIDTH) // STEP) + 1
        at = np.repeat(long, count)
        step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        s = start[at] + step * STEP
        short = np.ones(len(start), bool)
        short[long] = False
        start, end, row = np.concatenate([start[short], s]), np.concatenate([end[short], np.minimum(s + WIDTH, end[at])]), np.concatenate([row[short], row[at]])
    return b, start, end, row


def features(b: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x features, -1 for none) and weights of the subsequences of tokens of one length,
    with a mark at both ends."""
    c = np.empty((len(start), length + 2), np.int32)
    c[:, 0], c[:, -1] = HEAD, TAIL
    c[:, 1:-1] = _class[b[start[:, None] + np.arange(length)]]
    length += 2
    codes, weights = [], []
    for j, k in _OFFSETS:
        if k < length:
            x, y, z = c[:, : length - k], c[:, j : length - k + j], c[:, k:]
            codes.append(np.where((x >= 0) & (y >= 0) & (z >= 0), (x * CLASSES + y) * CLASSES + z, -1))
            weights.append(np.full(length - k, DECAY ** (k - 2)))
    return np.concatenate(codes, 1), np.concatenate(weights).astype(np.float32)


def squared_norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's sum over its distinct codes of the squared sum of weights."""
    order = np.argsort(codes, axis=1)
    c = np.take_along_axis(codes, order, 1)
    w = np.where(c >= 0, weights[order], 0).astype(np.float64)
    total = np.cumsum(w, axis=1)
    last = np.ones(c.shape, bool)
    last[:, :-1] = c[:, 1:] != c[:, :-1]
    ends = np.where(last, total, 0)
    before = np.zeros_like(ends)
    before[:, 1:] = np.maximum.accumulate(ends, axis=1)[:, :-1]
    return (np.where(last, total - before, 0) ** 2).sum(1)


def decisions(b: np.ndarray, start: np.ndarray, end: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products of the tokens' normalised features with ``vector``."""
    out = np.zeros(len(start), np.float64)
    lens = end - start
    for n in np.unique(lens):
        same = np.flatnonzero(lens == n)
        step = max(1, CELLS // (int(n) * len(_OFFSETS)))
        for i in range(0, len(same), step):
            at = same[i : i + step]
            codes, weights = features(b, start[at], int(n))
            got = (vector[codes] * weights * (codes >= 0)).sum(1)
            out[at] = got / np.sqrt(np.maximum(squared_norms(codes, weights), 1e-9))
    return out


def packed(tokens: list[str] | list[bytes]):
    """Tokens as one buffer with starts and ends."""
    raw = [t if isinstance(t, bytes) else t.encode() for t in tokens]
    ends = np.cumsum([len(t) for t in raw]) if raw else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(t) for t in raw], np.int64), ends


class Landmarks:
    """Normalised features of a few tokens, over the codes that occur in them."""

    def __init__(self, tokens):
        b, s, e = packed(tokens)
        got = [features(b, s[i : i + 1], int(e[i] - s[i])) for i in range(len(s))]
        used = np.unique(np.concatenate([c[0] for c, _ in got]))
        self.codes = used[used >= 0]
        #: column of each code; the last column, all zeros, for those that don't occur
        self.column = np.full(CLASSES**3 + 1, len(self.codes), np.int32)
        self.column[self.codes] = np.arange(len(self.codes))
        self.rows = np.zeros((len(s), len(self.codes) + 1))
        for i, (codes, weights) in enumerate(got):
            np.add.at(self.rows[i], self.column[codes[0]], weights)
        self.rows[:, -1] = 0
        self.rows /= np.maximum(np.linalg.norm(self.rows, axis=1, keepdims=True), 1e-9)

    def kernel(self, tokens) -> np.ndarray:
        b, s, e = packed(tokens)
        out = np.zeros((len(s), len(self.rows)))
        lens = e - s
        for n in np.unique(lens):
            at = np.flatnonzero(lens == n)
            codes, weights = features(b, s[at], int(n))
            norm = np.sqrt(np.maximum(squared_norms(codes, weights), 1e-9))[:, None]
            for i in range(0, len(at), 256):
                part = codes[i : i + 256]
                dense = np.zeros((len(part), self.rows.shape[1]))
                np.add.at(dense, (np.arange(len(part))[:, None], self.column[part]), weights[None, :])
                dense[:, -1] = 0
                out[at[i : i + 256]] = dense @ self.rows.T / norm[i : i + 256]
        return out

    def vector(self, weights: np.ndarray) -> np.ndarray:
        """The combination of the landmarks as one vector over all codes."""
        out = np.zeros(CLASSES**3, np.float32)
        out[self.codes] = (weights @ self.rows)[:-1]
        return out


def svm(z: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 40, seed: int = 5):
    """L2-regularised hinge loss by dual coordinate descent; a constant column gives the intercept,
    and the rarer class weighs more."""
    x = np.hstack([z, np.ones((len(z), 1))])
    ratio = max((y < 0).sum(), 1) / max((y > 0).sum(), 1)
    cost = np.where(y > 0, c * max(1.0, ratio), c * max(1.0, 1 / ratio))
    a, w, q, rng = np.zeros(len(x)), np.zeros(x.shape[1]), (x**2).sum(1), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (w @ x[i]) - 1) / q[i], 0.0), cost[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w[:-1], w[-1]


class Model:
    def __init__(self, vector=None, bias=0.0, slope=1.0, shift=-50.0):
        self.vector, self.bias, self.slope, self.shift = vector, bias, slope, shift

    @property
    def known(self) -> bool:
        return self.vector is not None

    def margins(self, col: pa.Array) -> np.ndarray:
        """The strongest token's decision of each row; -2 for a row without tokens."""
        out = np.full(len(col), -2.0)
        b, s, e, row = token_spans(col)
        if len(s):
            h = span_hash(prefix_hash(b), s, e)
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            np.maximum.at(out, row, (decisions(b, s[first], e[first], self.vector) + self.bias)[back])
        return out

    def scores(self, col: pa.Array) -> np.ndarray:
        if not self.known:
            return np.zeros(len(col))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(self.margins(col), -2) + self.shift, -40, 40)))


def _bags(it):
    for rb in shared.batches(it, ["toxic", "text"], STEP_BYTES):
        b, s, e, row = token_spans(rb.column(1))
        raw, bags = b.tobytes(), [set() for _ in range(rb.num_rows)]
        for i, j, r in zip(s.tolist(), e.tolist(), row.tolist()):
            bags[r].add(raw[i:j])
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([sorted(x) for x in bags], pa.list_(pa.binary()))], ["toxic", "tokens"])


def spread(rows: np.ndarray, n: int) -> list[int]:
    """Indices of up to n rows by pivoted Cholesky: each the one least explained by those before."""
    rest, basis, out = (rows**2).sum(1), np.zeros((len(rows), 0)), []
    while len(out) < n and rest.max() > 1e-3:
        i = int(rest.argmax())
        out.append(i)
        col = (rows @ rows[i] - basis @ basis[i]) / np.sqrt(rest[i])
        basis = np.hstack([basis, col[:, None]])
        rest = np.maximum(rest - col**2, 0)
        rest[i] = 0
    return out


def merge_near(bags: list[list[bytes]], y: np.ndarray, rows: int = 3, bands: int = 12):
    """Near copies as one bag: texts of a label that share a band of minimal hashes of their rarer
    tokens. A passage that many copies hold is then no evidence."""
    df = Counter(t for b in bags for t in b)
    most = max(20, len(bags) // 50)
    parent = list(range(len(bags)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    salts = np.random.default_rng(1).integers(1, 2**63, rows * bands, dtype=np.uint64) | np.uint64(1)
    seen: dict[tuple, int] = {}
    for i, b in enumerate(bags):
        rare = [t for t in b if df[t] <= most] or b
        h = np.array([zlib.crc32(t) for t in rare], np.uint64)
        if len(h):
            low = ((h[:, None] * salts) >> np.uint64(20)).min(0).reshape(bands, rows)
            for k, band in enumerate(low.tolist()):
                j = seen.setdefault((int(y[i]), k, *band), i)
                parent[root(i)] = root(j)
    out: dict[int, set[bytes]] = {}
    for i, b in enumerate(bags):
        out.setdefault(root(i), set()).update(b)
    return [sorted(b) for b in out.values()], y[list(out)]


def variants(token: bytes, rng) -> list[bytes]:
    """The token with an inserted letter, a doubled letter and inserted punctuation, as people
    write insults past a word filter: positive examples too."""
    if len(token) < 4 or len(token) > WIDTH - 2:
        return []
    i, j, k = rng.integers(1, len(token), 3)
    return [token[:i] + bytes([97 + int(rng.integers(26))]) + token[i:], token[:j] + token[j - 1 : j] + token[j:], token[:k] + b"*" + token[k:], b".".join(token[n : n + 1] for n in range(len(token)))[:WIDTH]]


def errors_above(a, c, n1: int, n0: int) -> np.ndarray:
    """Standard errors by which the share a of n1 toxic texts exceeds the share c of n0 clean ones."""
    p = (a + c + 1) / (n1 + n0 + 2)
    return ((a - 0.5) / n1 - (c + 0.5) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def train(bags: list[list[bytes]], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 4, seed: int = 11, share: float = 0.5) -> Model:
    """A model from bags of tokens (three bytes or more) and their 0 / 1 labels; ``share`` is that
    of label 1 among all labels."""
    y = np.array(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return Model()
    rng = np.random.default_rng(seed)
    bags, y = merge_near(bags, y)
    # a third of the texts, if they suffice, is kept back to calibrate on
    back = (np.arange(len(y)) % 3 == 0) if min((y == 1).sum(), (y == 0).sum()) >= 60 else np.zeros(len(y), bool)
    held_back, back_y = [b for b, h in zip(bags, back) if h], y[back]
    bags, y = [b for b, h in zip(bags, back) if not h], y[~back]
    names = sorted({t for b in bags for t in b})
    at = {t: i for i, t in enumerate(names)}
    idx = [np.fromiter((at[t] for t in b), np.int64, len(b)) for b in bags]
    grams: list[list[bytes]] = [[t[i : i + n] for n in (4,) for i in range(max(1, len(t) - n + 1))] for t in names]
    df = {0: Counter(), 1: Counter()}
    for b, v in zip(idx, y):
        df[int(v)].update({g for i in b for g in grams[i]})
    n1, n0 = (y == 1).sum(), (y == 0).sum()

    known = list(df[0] | df[1])
    a, c = (np.array([df[v][g] for g in known], float) for v in (1, 0))
    stand_out = dict(zip(known, errors_above(a, c, n1, n0).tolist()))
    start = np.array([max([stand_out[g] for g in x]) for x in grams])
    clean = np.unique(np.concatenate([b for b, v in zip(idx, y) if v == 0 and len(b)] or [np.zeros(0, np.int64)]))
    held1, held0 = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(b for b, v in zip(idx, y) if v == k)]), minlength=len(names)) for k in (1, 0))
    held, toxic_tokens = held1 + held0, np.flatnonzero(held1)
    if not len(toxic_tokens) or not len(clean):
        warnings.warn("the texts of a class have no tokens: every score is 0", stacklevel=2)
        return Model()
    lean = held1 * n0 > LEAN * held0 * n1
    own = errors_above(held1, held0, n1, n0)
    value, best, model = start.copy(), None, Model()
    positive: set[int] = set()
    plain = clean[~lean[clean]]
    negative = set(rng.choice(plain, min(len(plain), 1500), replace=False).tolist())
    for r in range(rounds):
        for b, v in zip(idx, y):
            if not len(b):
                continue
            some = b[lean[b]] if v else b[~lean[b]]
            top = some[np.argsort(-value[some])[:2]]
            if v == 0:
                negative.update(top.tolist())
            else:
                positive.update(int(i) for i in top if value[i] > (SURE if r == 0 else 0.5))
        if not positive:  # none is sure: the best ranked
            some = toxic_tokens[lean[toxic_tokens]] if lean.any() else toxic_tokens
            some = some[np.lexsort((some, -own[some]))][:FEW]
            positive = set(some[own[some] >= min(own[some[0]], own[some[0]] / 2)].tolist())
        negative = (negative or set(clean.tolist())) - positive
        if not negative:
            warnings.warn("no token tells clean texts from toxic ones: every score is 0", stacklevel=2)
            return Model()
        pos, neg = sorted(positive), sorted(negative)
        pos = sorted(pos, key=lambda i: (-held[i], i))[:600]
        marks = [*(pos[i] for i in spread(Landmarks([names[i] for i in pos]).rows, landmarks * 3 // 4)), *rng.choice(neg, min(len(neg), landmarks // 4), replace=False)]
        table = Landmarks([names[i] for i in marks])
        mm = table.rows @ table.rows.T
        vals, vecs = np.linalg.eigh(mm)
        ok = vals > 1e-6 * vals[-1]
        white = vecs[:, ok] / np.sqrt(vals[ok])
        altered = [v for i in pos for v in variants(names[i], rng)]
        z = table.kernel([*[names[i] for i in [*pos, *neg]], *altered]) @ white
        w, bias = svm(z, np.array([1.0] * len(pos) + [-1.0] * len(neg) + [1.0] * len(altered)))
        vector = table.vector(white @ w)
        b_, s_, e_ = packed(names)
        value = decisions(b_, s_, e_, vector) + bias
        best = np.array([value[b].max() if len(b) else -2.0 for b in idx])
        model = Model(vector, float(bias))
    # logistic calibration on the texts' margins, the classes weighing as in all labels
    if held_back:
        b_, s_, e_ = packed([t for b in held_back for t in b])
        ends = np.cumsum([len(b) for b in held_back])
        each = decisions(b_, s_, e_, model.vector) + model.bias
        best, y = np.array([each[e - len(b) : e].max() if b else -2.0 for b, e in zip(held_back, ends)]), back_y
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    m, t = np.maximum(best, -2), np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share, 1 - share) / np.where(y == 1, n1, n0) * len(y)
    a, c = 4.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-6
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum()]])
        step = np.linalg.solve(hess, [(g * m).sum() + 1e-3 * a, g.sum()])
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
    model.slope, model.shift = float(max(a, 0.5)), float(c)
    return model


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """``labels``: doc_id, toxic. Fitted on about ``train_rows`` documents of each class at most, chosen by id."""
    shared.prepare(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    known = shared.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(labels, "doc_id").distinct(), "labelled-ids")
    bags: list[list[bytes]] = []
    toxic: list[int] = []
    for v in (0, 1):
        chosen = ngrams.documents_of(docs, ngrams.sample(known.where(F.col("toxic") == v), train_rows, 17))
        got = chosen.select("toxic", "text").mapInArrow(_bags, "toxic int, tokens array<binary>").toArrow()
        bags += got.column("tokens").to_pylist()
        toxic += got.column("toxic").to_pylist()
    order = sorted(range(len(bags)), key=lambda i: (toxic[i], bags[i]))
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = min(0.9, max(0.01, count.get(1, 0) / max(1, sum(count.values()))))
    return train([bags[i] for i in order], [toxic[i] for i in order], share=share)


def _score(model):
    def run(it):
        m = model.value
        for rb in shared.batches(it, ["doc_id", "text"], STEP_BYTES):
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(m.scores(rb.column(1)))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1)."""
    shared.prepare(docs.sparkSession)
    found = docs.sparkSession.sparkContext.broadcast(model)  # one vector of CLASSES**3 numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(found), "doc_id long, score double")


def _keep(model, at: int, threshold: float):
    def run(it):
        m = model.value
        for rb in it:
            for part in shared.batches([rb], [*["-"] * at, "text"], STEP_BYTES, at):
                ok = m.scores(part.column(at)) < threshold
                if ok.any():
                    yield part.filter(pa.array(ok))

    return run


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns."""
    shared.prepare(docs.sparkSession)
    found = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(found, docs.columns.index("text"), threshold), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    labels = shared.labels(spark, sf_dir).where(~shared.held_out(F.col("doc_id")))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
