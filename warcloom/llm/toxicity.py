"""Toxic documents by weak supervision.

1. Lexicons. To a built-in list come words and word beginnings that a bounded sample of labelled rows shows to be
   toxic, language by language (document counts by class, lift and evidence).
2. Voters. Each looks at a whole document through one lexicon or pattern and votes toxic, clean or nothing. The votes of
   all documents are counted by pattern of votes.
3. Label model. EM over the pattern counts estimates each voter's behaviour in either class and the classes' shares,
   without labels. Correlations of voters within a class are then estimated, and each voter's evidence is divided by its
   correlated company, until both agree.
4. Classifier. A linear (logistic) model of document features is fitted to the label model's posteriors of the sample,
   and scores every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gram_hashes, mix, pieces, slices, text_buffers, word_hashes

BUILT_IN = ("idiot", "moron", "scum", "trash", "loser", "clown", "stupid", "pathetic", "worthless", "disgusting", "imbecile", "vermin", "dumbass", "bastard", "asshole", "bitch", "retard", "filth", "subhuman", "degenerate")
#: Labelled rows that lexicons and classifier are learned from at most: those with the lowest MD5 of their doc_id.
MAX_LABELLED = 8_000
#: A learned term is in this share of a language's toxic sample at least, and so many times likelier there.
MIN_SHARE, MIN_LIFT, MIN_EVIDENCE = 0.2, 4.0, 14.0
PREFIXES = (4, 5, 6, 7)
#: Hits a word that vote toxic, and below which the vote is clean.
DENSE, SPARSE = 0.011, 0.008
CUT = 0.5

_WORD = re.compile(r"\w+")
_ADDRESS = frozenset("you your youre u are such a an these those the".split())


@dataclass(frozen=True)
class Lexicon:
    """Built-in words in two halves, learned words and word beginnings in two halves."""

    words: tuple[str, ...] = ()
    beginnings: tuple[str, ...] = ()
    built_in: tuple[str, ...] = BUILT_IN
    group: dict = field(default_factory=dict, compare=False)
    starts: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for k, w in enumerate(self.built_in):
            self.group[w] = k % 2
        for k, w in enumerate(self.words):
            self.group.setdefault(w, 2 + k % 2)
        for k, w in enumerate(self.beginnings):
            self.starts[w] = 2 + k % 2

    def features(self, text: str) -> np.ndarray:
        """hits by group (4), distinct terms, hits that address someone, words, share of capitals."""
        low = text.lower()
        words = _WORD.findall(low)
        out = np.zeros(8)
        group, starts = self.group, self.starts
        seen = set(words)
        hit = {w: group[w] for w in seen if w in group}
        if starts:
            sizes = {len(p) for p in starts}
            for n in sizes:
                for w in seen:
                    if w not in hit and len(w) > n and w[:n] in starts:
                        hit[w] = starts[w[:n]]
        if hit:
            before = ""
            for w in words:
                g = hit.get(w)
                if g is not None:
                    out[g] += 1
                    out[5] += before in _ADDRESS
                before = w
            out[4] = len(hit)
        out[6] = len(words)
        letters = len(text) - text.count(" ")
        out[7] = sum(map(str.isupper, text)) / letters if hit and letters else 0.0
        return out


VOTERS = ("built_in_1", "built_in_2", "learned_1", "learned_2", "density", "repeated", "address", "capitals")


def votes(f: np.ndarray) -> np.ndarray:
    """Features (rows, 8) to votes (rows, 8) of -1 clean, 0 none, 1 toxic."""
    v = np.zeros(f.shape, np.int8)
    v[:, :4] = f[:, :4] > 0
    hits = f[:, :4].sum(1)
    density = hits / np.maximum(f[:, 6], 1)
    v[:, 4] = np.where((density >= DENSE) & (hits > 0), 1, np.where(density < SPARSE, -1, 0))
    v[:, 5] = np.where((hits >= 2) & (density >= SPARSE), 1, -1)
    v[:, 6] = f[:, 5] > 0
    v[:, 7] = f[:, 7] > 0.5
    return v


@dataclass
class LabelModel:
    """p[class, voter, vote + 1], the toxic share, and each voter's weight after correlation."""

    p: np.ndarray
    prior: float
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        j = np.arange(v.shape[1])
        log = [np.log((1 - self.prior, self.prior)[c]) + (self.weight * np.log(self.p[c, j, v.astype(int) + 1])).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit_label_model(v: np.ndarray, n: np.ndarray, rounds: int = 60, outer: int = 3) -> LabelModel:
    """EM from distinct vote patterns and how many documents have each; no labels are used."""
    k = v.shape[1]
    model = LabelModel(np.full((2, k, 3), 1 / 3), 0.5, np.ones(k), np.eye(k))
    # copies of a voter, which EM would mistake for the class: they show without any class
    copies = _correlations(v, n, np.full(len(v), 0.5))
    copies = np.where(copies >= 0.98, copies, 0)
    q = _majority(v, 1 / copies.sum(1))
    for turn in range(outer):
        model.correlation = np.maximum(copies, _correlations(v, n, q)) if turn else copies
        model.weight = 1 / model.correlation.sum(1)
        for _ in range(rounds):
            for c, r in ((0, 1 - q), (1, q)):
                for x in (-1, 0, 1):
                    model.p[c, :, x + 1] = ((v == x) * (n * r)[:, None]).sum(0) + 0.1
            model.p /= model.p.sum(2, keepdims=True)
            model.prior = float(np.clip((n * q).sum() / n.sum(), 1e-4, 0.5))
            new = model.posterior(v)
            done = np.abs(new - q).max() < 1e-6
            q = new
            if done:
                break
    return model


def _majority(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-1.5 * v.shape[1] * (v * weight).sum(1) / weight.sum())), 0.01, 0.99)


def _correlations(v: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Positive correlations of voters within the classes, the mean of both."""
    rho = np.zeros((v.shape[1],) * 2)
    for r in (1 - q, q):
        w = n * r
        d = v - (w[:, None] * v).sum(0) / max(w.sum(), 1e-9)
        cov = (d * w[:, None]).T @ d / max(w.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        rho += 0.5 * np.maximum(0, cov / np.outer(sd, sd)) * (np.outer(sd, sd) > 1e-6)
    np.fill_diagonal(rho, 1)
    return rho


def linear_features(f: np.ndarray) -> np.ndarray:
    hits = f[:, :4].sum(1)
    density = hits / np.maximum(f[:, 6], 1)
    return np.stack([np.ones(len(f)), np.log1p(1000 * density), density >= DENSE, (hits >= 2) & (density >= SPARSE), *(f[:, g] > 0 for g in range(4)), f[:, 5] > 0, f[:, 7] > 0.5], 1).astype(float)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w)) * len(y)
    penalty[0, 0] *= 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    label_model: LabelModel
    coef: np.ndarray

    def score(self, texts: list) -> np.ndarray:
        f = np.stack([self.lexicon.features(t or "") for t in texts]) if texts else np.zeros((0, 8))
        s = 1 / (1 + np.exp(-np.clip(linear_features(f) @ self.coef, -30, 30)))
        return np.where(f[:, :4].sum(1) > 0, s, 0.0)  # no term of any lexicon, nothing to judge by


def _terms(batches):
    """(lang, toxic, term, whole) to document counts within the partition."""
    from collections import Counter

    count: Counter = Counter()
    for b in batches:
        for lang, toxic, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            words = {w for w in _WORD.findall((text or "").lower()) if len(w) >= 4}
            count.update((lang, toxic, w, True) for w in words)
            count.update({(lang, toxic, w[:n], False) for w in words for n in PREFIXES if len(w) > n})
    if count:
        keys = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.bool_()))] + [pa.array([count[k] for k in keys], pa.int64())], names=["lang", "toxic", "term", "whole", "n"])


def _keys(batches):
    """(lang, toxic, text) with two min-hashes of its word 3-grams: copies and near copies mostly share one."""
    for b in batches:
        data, offsets = text_buffers(b.column(2))
        keys = np.zeros((2, len(b)), np.int64)
        for i, j in slices(offsets):
            d, h = gram_hashes(*word_hashes(data, offsets[i : j + 1]), 3)
            if len(h):
                at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                for k in (0, 1):
                    keys[k, i + d[at]] = np.minimum.reduceat(mix(h + np.uint64(k)), at).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys[0]), pa.array(keys[1])], names=["lang", "toxic", "text", "k0", "k1"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and word beginnings from (lang, toxic, text) rows. A word stands for a beginning where it makes up most of it.

    Of rows that are copies or near copies of each other one speaks for all: else whatever words a much copied toxic
    document holds would look toxic.
    """
    sample = sample.select("lang", "toxic", "text").mapInArrow(_keys, "lang string, toxic int, text string, k0 long, k1 long")
    for k in ("k0", "k1"):
        one = F.min_by(F.struct("text", "k1"), F.struct("k1", "text")).alias("one")
        sample = sample.groupBy("lang", "toxic", k).agg(one).select("lang", "toxic", "one.*")
    sizes = {r[0]: (r[1], r[2]) for r in sample.groupBy("lang").agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).collect()}
    counts = sample.select("lang", "toxic", "text").mapInArrow(_terms, "lang string, toxic int, term string, whole boolean, n long")
    counts = counts.groupBy("lang", "term", "whole").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    words, beginnings = set(), set()
    rows = counts.where("t >= 3 AND t > c / 8").collect()
    kept = {}
    for lang, term, whole, t, c in rows:
        nt, nc = sizes[lang]
        lift = ((t + 0.5) / (nt + 1)) / ((c + 0.5) / (nc + 1))
        if t >= MIN_SHARE * nt and lift >= MIN_LIFT and t * np.log(lift) >= MIN_EVIDENCE:
            kept[lang, term, whole] = (t, lift)
    for (lang, term, whole), (t, lift) in sorted(kept.items(), key=lambda x: (len(x[0][1]), str(x[0]))):
        shorter = any((lang, term[:n], False) in kept and kept[lang, term[:n], False][1] >= 0.5 * lift and kept[lang, term[:n], False][0] >= 0.9 * t and term[:n] in beginnings for n in PREFIXES if n < len(term) + whole)
        if shorter:
            continue
        if whole:
            words.add(term)
        elif not any(w.startswith(term) and x >= 0.8 * t for (o, w, full), (x, _) in kept.items() if full and o == lang):
            beginnings.add(term)
    words -= set(BUILT_IN)
    return Lexicon(tuple(sorted(words)), tuple(sorted(beginnings)))


def _patterns(lexicon: Lexicon):
    def run(batches):
        from collections import Counter

        count: Counter = Counter()
        for b in pieces(batches):
            texts = b.column(0).to_pylist()
            if texts:
                count.update(map(bytes, votes(np.stack([lexicon.features(t or "") for t in texts])).view(np.uint8)))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["votes", "n"])

    return run


def _feature_rows(lexicon: Lexicon):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.features(t or "").tobytes() for t in b.column(0).to_pylist()], pa.binary())], names=["f"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Lexicons from at most max_labelled labelled rows, the label model from all documents' votes, the classifier from the sample's posteriors."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled)
    sample = docs.select(docs["doc_id"], F.coalesce(docs["lang"], F.lit("")).alias("lang"), docs["text"]).join(chosen, "doc_id").select("lang", "toxic", "text")
    lexicon = learn_lexicon(sample)
    counts = docs.select(docs["text"]).mapInArrow(_patterns(lexicon), "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    v = np.array([np.frombuffer(bytes(r[0]), np.int8) for r in counts], np.int8).reshape(-1, len(VOTERS))
    model = fit_label_model(v, np.array([r[1] for r in counts], float)) if len(v) else LabelModel(np.full((2, len(VOTERS), 3), 1 / 3), 0.5, np.ones(len(VOTERS)), np.eye(len(VOTERS)))
    rows = sample.select("text").mapInArrow(_feature_rows(lexicon), "f binary").collect()
    f = np.array([np.frombuffer(bytes(r[0])) for r in rows]).reshape(-1, 8)
    if not len(f):  # no labelled rows: a row for each pattern of votes stands in
        f = np.zeros((len(v), 8))
        f[:, :4], f[:, 4], f[:, 5], f[:, 6] = v[:, :4] > 0, np.where(v[:, 5] > 0, 2, 1), v[:, 6] > 0, np.where(v[:, 4] > 0, 50, 1000)
    coef = fit_linear(linear_features(f), model.posterior(votes(f))) if len(f) else np.zeros(10)
    return Model(lexicon, model, coef)


def _scored(model: Model):
    def run(batches):
        for b in pieces(batches):
            s = model.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(s >= CUT, pa.bool_())], names=["doc_id", "score", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score (0 to 1) and toxic (score >= CUT) for every row of docs.

    Null, empty and blank texts score 0. Rows without doc_id, and repeated rows, are scored each on its own. Labels that
    are neither 0 nor 1, or that have no doc_id, are left out; of differing labels toxic counts. Without labelled rows
    the built-in lexicon votes alone. Other columns are ignored, whatever their names.
    """
    model = fit(docs, labels, max_labelled)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(_scored(model), "doc_id long, score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs without its toxic documents, columns as they were."""
    model = fit(docs, labels, max_labelled)
    at = docs.columns.index("text")

    def run(batches):
        for b in pieces(batches):
            yield b.filter(pa.array(model.score(b.column(at).to_pylist()) < CUT, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels_of(spark, sf_dir))
