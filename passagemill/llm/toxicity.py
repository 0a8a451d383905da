"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a seed lexicon and of one learnt from the labels (words as 64-bit
hashes), second-person density, insults near the second person, insults that show only once digits and
signs are read as letters, and rates of capitals, exclamation, punctuation, masks, digits and mixed
tokens. Features of a training row never use lexicon entries learnt from its own part, and calibration
uses out-of-part predictions.

The learnt lexicon has every word that passes its tests; as it comes from a bounded sample of rows, so does its size.

Nulls and edge cases: a null text scores as an empty one; ids may be null; texts are fitted on and scored whole;
ties: equal texts get equal scores; repeated training rows count once; labels other than 0 and 1 are ignored; extra
columns may have any name. Without rows of both classes the
score is the share of label 1, or 0 without any training row. An empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm import bytewords, labelled
from passagemill.llm.common import Workspace

#: Seed lexicon and second-person forms; both are parameters, the labels add what they show.
SEED = (
    "idiot idiots moron morons stupid dumb fool scum trash garbage loser losers pathetic worthless disgusting clown hate kill ugly shut crap "
    "imbecile dimwit filth vermin jerk bastard bitch damn hell shit fuck fucking asshole retard"
).split()
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus vosotros".split()

_ascii = np.zeros(256, bool)
_ascii[:128] = True
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
#: Word ends: every ASCII byte but letters and digits; read as letters, "@" and "$" stay inside.
PLAIN_SEP = _ascii & ~_letter & ~_digit
LEET_SEP = PLAIN_SEP.copy()
LEET_SEP[[64, 36]] = False
LEET = bytewords.LOWER.copy()
for sign, letter in zip(b"013457@$", b"oieastas"):
    LEET[sign] = letter
NEAR = 3


@dataclass(frozen=True)
class Config:
    per_class: tuple[int, int] = (8000, 4000)  # labelled rows that are fitted on: clean, toxic
    parts: int = 4
    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    ridge: float = 1.0


@dataclass(frozen=True)
class Lexicon:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray


def seed_lexicon(words=SEED) -> np.ndarray:
    return np.unique(np.array([bytewords.hash_word(w) for w in words], np.uint64))


def within(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in the sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


N_FEATURES = 16


def features(column: pa.Array, seed: np.ndarray, second: np.ndarray, learnt: Lexicon) -> np.ndarray:
    out = []
    for _, buf, off in bytewords.blocks(column):
        n = len(off) - 1
        starts, ends, rows = bytewords.spans(buf, off, PLAIN_SEP)
        words = bytewords.hashes(buf, starts, ends)
        count = lambda at, w=None: np.bincount(at, weights=w, minlength=n)
        total = np.maximum(1, count(rows))
        is_seed, place = within(seed, words) >= 0, within(learnt.words, words)
        is_learnt = place >= 0
        weight = np.where(is_learnt, learnt.weights[np.maximum(place, 0)] if len(learnt.weights) else 0.0, 0.0)
        is_second, insult = within(second, words) >= 0, is_seed | is_learnt
        near = np.zeros(len(words), bool)
        where = np.flatnonzero(insult)
        for d in range(-NEAR, NEAR + 1):
            j = where + d
            ok = (j >= 0) & (j < len(words))
            ok[ok] &= is_second[j[ok]] & (rows[j[ok]] == rows[where[ok]])
            near[where[ok]] = True
        s2, e2, r2 = bytewords.spans(buf, off, LEET_SEP)
        odd = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_digit[buf] | (buf == 64) | (buf == 36), out=odd[1:])
        letters = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_letter[buf], out=letters[1:])
        mixed = (odd[e2] > odd[s2]) & (letters[e2] > letters[s2])
        read = bytewords.hashes(buf, s2[mixed], e2[mixed], LEET)
        hidden = (within(seed, read) >= 0) | (within(learnt.words, read) >= 0)
        size = np.maximum(1, np.diff(off)).astype(float)
        rate = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])[off]) / size
        upper = (buf >= 65) & (buf <= 90)
        out.append(np.stack([
            count(rows, is_seed) / total, count(rows, is_learnt) / total, np.log1p(count(rows, is_seed)), np.log1p(count(rows, is_learnt)),
            count(rows, weight) / total, np.log1p(count(rows, weight)), count(rows, is_second) / total, count(rows, near) / total, np.log1p(count(rows, near)),
            count(r2[mixed], hidden), count(r2, mixed) / total, rate(upper), rate(buf == 33), rate(PLAIN_SEP[buf] & ~bytewords.SPACE[buf]),
            rate((buf == 42) | (buf == 35)), rate(_digit[buf]),
        ], axis=1))
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES))


# --- trees ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: a row goes right where its feature exceeds the edge."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    edge: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, e, leaf in zip(self.feature, self.edge, self.leaf):
            at = np.zeros(len(x), int)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, f[at]] > e[at])
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, cfg: Config) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cfg.bins + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [np.unique(np.concatenate([e, np.quantile(x[x[:, j] > 0, j], np.linspace(0, 1, cfg.bins)[:-1]) if (x[:, j] > 0).any() else [], [0.0]])) for j, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    p = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    margin, inner = np.full(len(y), base), 2**cfg.depth - 1
    trees = []
    for _ in range(cfg.rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = w * (y - prob), w * prob * (1 - prob)
        feature, edge, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(cfg.depth):
            first, k = 2**level - 1, 2**level
            best = np.full(k, 1e-6)
            local = node - first
            for j, e in enumerate(edges):
                m = len(e) + 1
                sg = np.bincount(local * m + binned[:, j], g, k * m).reshape(k, m).cumsum(axis=1)
                sh = np.bincount(local * m + binned[:, j], h, k * m).reshape(k, m).cumsum(axis=1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + cfg.ridge) + (tg - sg) ** 2 / (th - sh + cfg.ridge) - tg**2 / (th + cfg.ridge)
                at = gain[:, :-1].argmax(axis=1)
                got = gain[np.arange(k), at]
                for i in np.flatnonzero(got > best):
                    best[i], feature[first + i], edge[first + i] = got[i], j, e[at[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > edge[node])
        local = node - inner
        leaf = cfg.rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + cfg.ridge)
        margin += leaf[local]
        trees.append((feature, edge, leaf))
    return Trees(base, *(np.stack(x) for x in zip(*trees)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, first x, last x
    for i in order:
        blocks.append([w[i], y[i], x[i], x[i]])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks[-1]
            a[1] = (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0])
            a[0] += b[0]
            a[3] = b[3]
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([v for b in blocks for v in (b[1], b[1])])


@dataclass(frozen=True)
class Model:
    seed: np.ndarray
    second: np.ndarray
    learnt: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.prior)
        margin = self.trees.predict(features(column, self.seed, self.second, self.learnt))
        # The margin itself orders what the steps of the fit leave equal.
        return 0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin))


def learn(counts: np.ndarray, words: np.ndarray, toxic: np.ndarray, clean: np.ndarray, leave: int | None, cfg: Config) -> Lexicon:
    """Entries from (words x parts x [clean, toxic]) document counts, without part `leave`."""
    use = [p for p in range(cfg.parts) if p != leave]
    c, t = counts[:, use, 0].sum(axis=1), counts[:, use, 1].sum(axis=1)
    weight = np.log((t + 0.3) / (toxic[use].sum() + 1)) - np.log((c + 0.3) / (clean[use].sum() + 1))
    keep = np.flatnonzero((t >= 2) & (weight > 2.5))
    keep = keep[np.argsort(words[keep])]
    return Lexicon(words[keep], weight[keep])


def _distinct_words(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        part, label, word = [], [], []
        for first, buf, off in bytewords.blocks(batch.column(2)):
            starts, ends, rows = bytewords.spans(buf, off, PLAIN_SEP)
            got = bytewords.hashes(buf, starts, ends)
            for r in range(len(off) - 1):
                own = np.unique(got[np.searchsorted(rows, r) : np.searchsorted(rows, r + 1)])
                part += [batch.column(0)[first + r].as_py()] * len(own)
                label += [batch.column(1)[first + r].as_py()] * len(own)
                word.append(own.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(label, pa.int32()), pa.array(np.concatenate(word) if word else np.zeros(0, np.int64))], ["part", "label", "word"]
        )


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", seed=SEED, second=SECOND_PERSON, cfg: Config = Config()) -> Model:
    """`train` selects the rows of `labels` that may be learnt from."""
    ws = Workspace(docs.sparkSession, "toxicity")
    seeds, seconds = seed_lexicon(seed), seed_lexicon(second)
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    chosen, totals = labelled.sample(ws, labels, label, train, cfg.per_class, id_col)
    prior = totals[1] / sum(totals) if sum(totals) else 0.0
    # Copies of one text go to one part, so no row learns from its own copy.
    part = F.pmod(F.xxhash64("text"), F.lit(cfg.parts)).cast("int").alias("part")
    rows = ws.write(labelled.texts(chosen, docs, id_col, text_col).select("id", "label", "text", part).dropDuplicates(["id", "text"]).repartition(32, "id"), "texts")
    sizes = np.zeros((cfg.parts, 2))
    for p, y, n in rows.groupBy("part", "label").count().collect():
        sizes[p, y] = n
    if not sizes.sum(axis=0).all():
        return Model(seeds, seconds, empty, None, (np.zeros(1), np.zeros(1)), prior)
    toxic, clean = sizes[:, 1], sizes[:, 0]
    # Document counts of the words, one column a part and class; only what the toxic class shows clearly more often comes here.
    seen = rows.select("part", "label", "text").mapInArrow(_distinct_words, "part int, label int, word bigint")
    cells = [F.count(F.when((F.col("part") == p) & (F.col("label") == y), 1)).alias(f"n{p}_{y}") for p in range(cfg.parts) for y in (0, 1)]
    counts = seen.groupBy("word").agg(*cells)
    t, c = (sum(F.col(f"n{p}_{y}") for p in range(cfg.parts)) for y in (1, 0))
    counts = counts.where((t >= 2) & (t / toxic.sum() > 4 * c / clean.sum())).orderBy("word").toArrow()
    words = counts["word"].to_numpy().view(np.uint64)
    counts = np.array([counts[f"n{p}_{y}"].to_numpy() for p in range(cfg.parts) for y in (0, 1)], float).T.reshape(len(words), cfg.parts, 2)
    own = [learn(counts, words, toxic, clean, p, cfg) for p in range(cfg.parts)]

    def run(batches):
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for p in np.unique(parts):
                at = np.flatnonzero(parts == p)
                x = features(batch.column(2).take(pa.array(at)), seeds, seconds, own[p])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["part", "label", "x"])

    got = rows.select("part", "label", "text").mapInArrow(run, "part int, label int, x array<double>").toPandas()
    got["key"] = got["x"].map(tuple)
    got = got.sort_values(["part", "label", "key"])
    x, y, parts = np.array(got["x"].tolist()), got["label"].to_numpy(float), got["part"].to_numpy()
    share = np.array([totals[0] / clean.sum(), totals[1] / toxic.sum()])
    w = share[y.astype(int)]
    w *= len(w) / w.sum()
    out = np.zeros(len(y))
    for p in range(cfg.parts):
        there, rest = parts == p, parts != p
        if there.any():
            out[there] = boost(x[rest], y[rest], w[rest], cfg).predict(x[there]) if len(set(y[rest])) == 2 else 0.0
    ws.drop("labelled", "sample", "texts")
    return Model(seeds, seconds, learn(counts, words, toxic, clean, None, cfg), boost(x, y, w, cfg), isotonic(out, y, w), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None, out: str = "score") -> DataFrame:
    """Every row of `docs`, with the columns `keep` (else all) and a column `out`: 0 to 1, higher for more toxic text."""
    own = list(docs.columns if keep is None else keep)
    # The text comes first, and is not passed twice where it is kept.
    sent = [text_col, *(c for c in own if c != text_col)]
    places, names = [sent.index(c) for c in own], [f"c{i}" for i in range(len(own) + 1)]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(model.score(batch.column(0)), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in places), scores], names)

    kinds = [docs.schema[c].dataType.simpleString() for c in own]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, [*kinds, "double"]))
    got = docs.select(*(F.col(f"`{c}`").alias(f"s{i}") for i, c in enumerate(sent))).mapInArrow(run, schema)
    return got.toDF(*own, out)
