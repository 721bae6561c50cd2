"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, the field's are of tokens; token labels come from the labelled sample: in a toxic
document a token is toxic if its form or a beginning of 4 to 6 bytes tells toxic documents from others
(n KL(toxic share || base share) >= STRENGTH and share >= PURITY; near copies are one document).  A two-state field (clean, toxic) with hashed
form, prefix and suffix features is fitted to these by full-batch Adagrad on the exact likelihood gradient.  Scoring is
forward-backward over every token of every text: with two states both passes are recursions of one log-odds number,
run for all texts of a batch at once.  The model is fitted on the driver from a bounded sample and sent to the tasks as
non-zero weights (about 1 MB whatever the corpus); scoring is one scan with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .kernels import SLICE, U64, Tokens, buffers, char_at, kept, mix, slices, tidy

#: Labelled documents of each class that the field is fitted on, at most (the sample's documented bound).
SAMPLE = 800
#: Bytes of one class's texts in the sample at most.
SAMPLE_BYTES = 32 << 20
STRENGTH, PURITY, SHARED, FALSE_COST, DIM = 14.0, 0.8, 5, 3, 1 << 22
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
#: Bytes of text whose marginals are held at once.
AT_ONCE = 4 << 20
#: Least marginal of a tagged token, and least score of a toxic document.
THRESHOLD = 0.5


def features(tok: Tokens) -> np.ndarray:
    """(tokens, features) places in the weight table; 0 means none."""
    cols = [tok.hash, *tok.prefixes(PREFIXES).values(), *tok.suffixes(SUFFIXES).values()]
    return np.stack([np.where(c == 0, 0, (c % U64(DIM - 1)).astype(np.int64) + 1) for c in cols], axis=1).astype(np.int32)


@dataclass
class Field:
    """places/weights: the non-zero weights of the toxic state; trans: log potentials [from, to]; start: toxic log-odds of a first token."""

    places: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    start: float
    threshold: float = THRESHOLD

    def dense(self) -> np.ndarray:
        if not hasattr(self, "_dense"):
            self._dense = np.zeros(DIM, np.float32)
            self._dense[self.places] = self.weights
        return self._dense

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}

    def emissions(self, tok: Tokens) -> np.ndarray:
        return self.dense()[features(tok)].sum(1)


def forward_backward(e: np.ndarray, of: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """(forward, backward) toxic log-odds of each token; e: emissions, of: first token of each text (n + 1).

    Texts are stepped through side by side, longest first, so step k works on all texts of more than k tokens.
    """
    a = np.exp(trans)
    size = np.diff(of)
    order = np.argsort(-size, kind="stable")
    first, size = of[:-1][order], size[order]
    fwd, bwd = np.zeros(len(e)), np.zeros(len(e))
    if not len(e):
        return fwd, bwd
    alive = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    r = None
    for k in range(int(size[0])):
        w = int(alive[k])
        at = first[:w] + k
        if r is None:
            r = start + e[at]
        else:
            x = np.exp(r[:w])
            r = np.log((a[0, 1] + a[1, 1] * x) / (a[0, 0] + a[1, 0] * x)) + e[at]
        np.clip(r, -40, 40, out=r)
        fwd[at] = r
    s = np.zeros(0)
    for k in range(int(size[0]) - 1, -1, -1):
        w = int(alive[k])
        at = first[:w] + k
        if len(s):
            x = np.exp(np.minimum(s + e[at[: len(s)] + 1], 80))
            s = np.log((a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x))
        if w > len(s):
            s = np.concatenate([s, np.zeros(w - len(s))])
        bwd[at] = s
    return fwd, bwd


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def token_labels(form: np.ndarray, rows: np.ndarray, of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the tokens of toxic texts whose form, or a prefix of 4 or more bytes that several forms share, tells toxic texts from others.

    form: the number of each token's form, rows: the features of the forms.  A prefix counts only if no form makes up
    more than half of its tokens in toxic texts and SHARED forms have it there; else it is but the trace of one word.
    """
    count = np.diff(of)
    doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
    base = toxic.mean()
    pairs = np.unique(form.astype(np.int64) * len(count) + doc)
    pair_form, pair_doc = pairs // len(count), pairs % len(count)
    in_toxic = toxic[doc] > 0
    times = np.bincount(form[in_toxic], minlength=len(rows))
    out = np.zeros(len(rows), bool)
    for col in (0, 2, 3, 4):
        names, place = np.unique(rows[:, col], return_inverse=True)
        own = np.unique(place[pair_form] * len(count) + pair_doc)
        n = np.bincount(own // len(count), minlength=len(names)).astype(float)
        k = np.bincount((own // len(count))[toxic[own % len(count)] > 0], minlength=len(names)).astype(float)
        share = k / n
        with np.errstate(divide="ignore", invalid="ignore"):
            kl = np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
        strong = (share >= PURITY) & (n * kl >= STRENGTH) & (names != 0)
        if col:
            most = np.zeros(len(names))
            np.maximum.at(most, place, times)
            strong &= (np.bincount(place, weights=times > 0, minlength=len(names)) >= SHARED) & (most <= 0.5 * np.bincount(place, weights=times, minlength=len(names)))
        out |= strong[place]
    return (out[form] & in_toxic).astype(float)


def apart(grams: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each group of near copies the first text: copies share both rows of one of four MinHash bands."""
    parent = np.arange(n)
    if len(grams):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        of = doc[first]
        mins = [np.minimum.reduceat(grams * U64(2 * k + 1) ^ U64(0x9E3779B97F4A7C15 >> k), first) for k in range(8)]
        for k in range(4):
            _, group = np.unique(mix(mins[2 * k]) ^ mins[2 * k + 1], return_inverse=True)
            lead = np.full(group.max() + 1, n)
            np.minimum.at(lead, group, of)
            parent[of] = np.minimum(parent[of], lead[group])
    return np.flatnonzero(parent == np.arange(n))


def fit_tokens(inverse: np.ndarray, rows: np.ndarray, of: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """Maximum likelihood of token labels y under the field; inverse: the form of each token, rows: features of the forms."""
    used, local = np.unique(rows, return_inverse=True)
    local = local.reshape(rows.shape)
    w, theta = np.zeros(len(used)), np.array([0.0, -3.0, 0.0, 0.0, -3.0])  # trans row by row, start
    gw, gt = np.full(len(used), 1e-6), np.full(5, 1e-6)
    doc_first = np.zeros(len(y) + 1, bool)
    doc_first[of] = True
    follow = np.flatnonzero(~doc_first[1:-1]) + 1  # tokens that have one before them in their text
    heads = of[:-1][np.diff(of) > 0]
    yi = y.astype(int)
    seen = np.bincount(yi[follow - 1] * 2 + yi[follow], minlength=4).astype(float)
    for _ in range(epochs):
        e = w[local].sum(1)[inverse]
        trans = theta[:4].reshape(2, 2)
        f, b = forward_backward(e, of, trans, theta[4])
        p = sigmoid(f + b)
        d = np.bincount(inverse, weights=y - p, minlength=len(rows))
        grad = np.bincount(local.ravel(), weights=np.repeat(d, rows.shape[1]), minlength=len(used)) - ridge * w
        r, s = f[follow - 1], np.clip(e[follow] + b[follow], -60, 60)
        cells = np.stack([theta[0] + 0 * r, theta[1] + s, theta[2] + r, theta[3] + r + s])
        cells = np.exp(cells - cells.max(0))
        expected = (cells / cells.sum(0)).sum(1)
        gradt = np.append(seen - expected, (y[heads] - p[heads]).sum()) - 1e-2 * theta
        grad[used == 0] = 0
        gw += grad**2
        gt += gradt**2
        w += rate * grad / np.sqrt(gw)
        theta += rate * gradt / np.sqrt(gt)
    keep = np.abs(w) > 1e-3
    return Field(used[keep].astype(np.int32), w[keep].astype(np.float32), theta[:4].reshape(2, 2), float(theta[4]))


def fit(texts: pa.Array, toxic: np.ndarray) -> Field | None:
    """None where one class has no text or no token can be labelled: then nothing is toxic.

    Of near copies one text is used.  The documents' threshold is then set on these texts: the score at which
    toxic texts found less FALSE_COST times clean ones rejected is greatest, and THRESHOLD at least.
    """
    toxic = np.asarray(toxic)
    if not len(toxic) or not 0 < toxic.sum() < len(toxic):
        return None
    buf, offs = buffers(texts)
    grams, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(offs):
        g, d = Tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]).grams(5)
        order = np.argsort(d, kind="stable")
        grams.append(g[order])
        doc.append(d[order] + lo)
    own = apart(np.concatenate(grams), np.concatenate(doc), len(toxic))
    texts, toxic = pa.array(texts.take(pa.array(own)).to_pylist(), pa.large_string()), toxic[own]
    buf, offs = buffers(texts)
    parts, names, forms, of = [], [], [], [np.zeros(1, np.int64)]
    for lo, hi in slices(offs):
        tok = Tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        u, index, inverse = np.unique(tok.hash, return_index=True, return_inverse=True)
        parts.append(features(tok)[index])
        forms.append((inverse + sum(map(len, names))).astype(np.int32))
        names.append(u)
        of.append(tok.of[1:] + of[-1][-1])
    of = np.concatenate(of)
    _, index, same = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    form, rows = same.astype(np.int32)[np.concatenate(forms)], np.concatenate(parts)[index]
    if not len(form) or not 0 < toxic.sum() < len(toxic):
        return None
    y = token_labels(form, rows, of, toxic)
    if not y.any():
        return None
    field = fit_tokens(form, rows, of, y)
    score, _ = score_batch(texts, field)
    at = np.unique(score[score >= THRESHOLD])
    if len(at):
        right, wrong = np.sort(score[toxic > 0]), np.sort(score[toxic == 0])
        gain = (len(right) - np.searchsorted(right, at)) - FALSE_COST * (len(wrong) - np.searchsorted(wrong, at))
        best = int(np.argmax(gain))
        field.threshold = THRESHOLD if best == 0 else float((at[best] + at[best - 1]) / 2)
    return field


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """__text, __toxic of at most ``most`` toxic and 2 x ``most`` clean labelled documents, chosen by a hash of the id, one text of each id (that of
    the least hash), as long as a class's texts have ``most_bytes`` together at most: the document that would exceed it and those after it
    are left out, none is cut."""
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__id IS NOT NULL AND __toxic IN (0, 1)")
    pick = [own.where(F.col("__toxic") == c).orderBy(F.xxhash64("__id"), "__id").limit(n) for c, n in ((1, most), (0, 2 * most))]
    pick = pick[0].union(pick[1]).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    got = docs.select(docs["doc_id"].cast("long").alias("__id"), docs["text"].alias("__text")).where("__text IS NOT NULL")
    got = got.join(F.broadcast(pick), "__id").groupBy("__id", "__toxic").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("__x"))
    order = [F.xxhash64("__id"), F.col("__id")]
    sofar = F.sum(F.octet_length("__x.t").cast("long")).over(W.partitionBy("__toxic").orderBy(*order))
    return got.withColumn("__sofar", sofar).where(F.col("__sofar") <= most_bytes).orderBy(*order).select(F.col("__x.t").alias("__text"), "__toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Field | None:
    got = sample(docs, labels, most).toArrow()
    return fit(got["__text"], got["__toxic"].to_numpy())


def score_batch(col: pa.Array, field: Field | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """(score, spans) of each text; a span is (first character, end, mean marginal) of neighbouring tokens whose marginal reaches
    the threshold, and the score is the noisy-or of the spans: 0 where there is none."""
    score, spans = np.zeros(len(col)), [[] for _ in range(len(col))]
    if field is None or not len(col):
        return score, spans
    buf, offs = buffers(col)
    cuts = list(slices(offs, AT_ONCE))
    if len(cuts) > 1:
        for lo, hi in cuts:
            score[lo:hi], spans[lo:hi] = score_batch(col[lo:hi], field, threshold)
        return score, spans
    em, st, en, of = [], [], [], [np.zeros(1, np.int64)]
    for lo, hi in slices(offs, SLICE):
        tok = Tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        em.append(field.emissions(tok))
        st.append((tok.start + offs[lo]).astype(np.int64))
        en.append((tok.end + offs[lo]).astype(np.int64))
        of.append(tok.of[1:] + of[-1][-1])
    e, of = np.concatenate(em).astype(np.float64), np.concatenate(of)
    f, b = forward_backward(e, of, field.trans, field.start)
    p = sigmoid(f + b)
    hot = np.flatnonzero(p >= threshold)
    if not len(hot):
        return score, spans
    start, end = np.concatenate(st), np.concatenate(en)
    doc = np.searchsorted(of, hot, "right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(doc) > 0)]))
    last = np.append(cut[1:], len(hot)) - 1
    mean = np.add.reduceat(p[hot], cut) / (last - cut + 1)
    clean = np.ones(len(col))
    np.multiply.at(clean, doc[cut], 1 - mean)
    score = 1 - clean
    for d in np.unique(doc[cut]).tolist():
        own = np.flatnonzero(doc[cut] == d) if len(cut) < 64 else np.arange(*np.searchsorted(doc[cut], [d, d + 1]))
        text = buf[offs[d] : offs[d + 1]]
        a, z = char_at(text, start[hot[cut[own]]] - offs[d]), char_at(text, end[hot[last[own]]] - offs[d])
        spans[d] = list(zip(a.tolist(), z.tolist(), mean[own].tolist(), strict=True))
    return score, spans


_OUT = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def toxic_spans(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score, spans of the toxic documents: those whose score reaches the field's threshold.

    A null, empty or token-free text has score 0; each of several rows with one id is scored by itself; a null id is kept
    as null, other ids are cast to long (under ANSI another kind of id raises).  A very long text is scored whole.  A marginal or a score
    that equals its threshold counts as toxic.  Where the labels give no model nothing is toxic.  Other columns don't matter, whatever their
    names, in docs and in labels; a label that is neither 0 nor 1 is none.  An empty table gives an empty table.
    """

    least = field.threshold if field else THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, spans = score_batch(batch.column(1), field)
            tidy()
            own = np.flatnonzero(score >= least)
            rows = [[{"start": a, "end": z, "p": p} for a, z, p in spans[i]] for i in own.tolist()]
            yield pa.record_batch([batch.column(0).take(pa.array(own)), pa.array(score[own]), pa.array(rows, _ARROW)], names=["doc_id", "score", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("__id"), docs["text"].alias("__text")).mapInArrow(run, _OUT)


def clean_only(docs: DataFrame, field: Field | None) -> DataFrame:
    """The documents that aren't toxic, with all columns, in one scan; see toxic_spans for the edge cases."""
    at, least = docs.columns.index("text"), field.threshold if field else THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = score_batch(batch.column(at), field)
            tidy()
            yield from kept(batch, score < least)

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_spans(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": op1_toxicity}
