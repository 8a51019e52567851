"""Personal data by a semi-Markov conditional random field.

Text is a sequence of words and single signs. A segmentation assigns each stretch of it either to no entity (one token
at a time) or, as a whole span of at most LONGEST tokens, to an entity type. Features look at the whole span: its form,
digits, check digit, limits and surroundings. Weights are trained here, by maximum likelihood over all segmentations
(forward-backward), on sentences made from templates; decoding is Viterbi over boundaries and types together. The type of
the last segment is kept in the state: every pair of types side by side has a weight, which is trained with the others.

Every entity holds a digit or '@', and a stretch without candidates adds nothing to the choice, so the dynamic program
runs over windows around those characters. They reach to white space on both sides, however far that is, and to three
words before, which hold the cues; so the result is that of the whole text.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces

TYPES = ("email", "phone", "ip", "card", "national_id")
#: Tokens of an entity at most.
LONGEST = 24

_TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_")
_ANCHOR = re.compile(r"[\d@]+")
_SPACE = re.compile(r"\s")
_FORMS = {
    "email": re.compile(r"[^\W_][\w.+%-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "phone": re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}"),
    "phone_marked": re.compile(r"\+\d[\d ().-]*\d|\(\d{2,4}\)[\d .-]*\d|\d{3}[.-]\d{3}[.-]\d{4}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"),
    "ip6": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"),
    "card": re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}"),
    "national": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
}
_CUES = {"email": "email mail contact e-mail write".split(), "phone": "call phone tel telephone fax mobile cell".split(), "ip": "ip host address server addr from".split(), "card": "card visa credit account pay mastercard".split(), "national_id": "ssn social security id".split()}
_CUE = {w: t for t, ws in _CUES.items() for w in ws}
FEATURES = ("bias", *_FORMS, "digits_1_6", "digits_7_9", "digits_10_12", "digits_13_19", "digits_more", "luhn", "tokens_1", "tokens_many", "at", "letters", "starts_sign", "ends_sign", "glued_before", "glued_after", "dotted_before", "dotted_after", "spaces", *(f"cue_{t}" for t in TYPES))
_NUMBER = {f: k for k, f in enumerate(FEATURES)}


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


#: Blanks and signs between two digits of one entity number less than twice this.
REACH = 24


def windows(text: str, reach: int = REACH):
    """Stretches around digits and '@', widened to white space, in order and apart from each other."""
    start = end = -1
    n = len(text)
    for m in _ANCHOR.finditer(text):
        if m.end() + reach <= end:
            continue
        a, b = max(0, m.start() - reach), min(n, m.end() + reach)
        if a <= end:
            a = start
        else:
            while a > 0 and not text[a - 1].isspace():
                a -= 1
        space = _SPACE.search(text, b)
        b = space.start() if space else n
        if a <= end:
            start, end = min(a, start), max(end, b)
        else:
            if start >= 0:
                yield start, end
            start, end = a, b
    if start >= 0:
        yield start, end


def words_before(text: str, at: int, n: int = 3) -> int:
    """Where the n words before a place begin."""
    for _ in range(n):
        while at > 0 and text[at - 1].isspace():
            at -= 1
        while at > 0 and not text[at - 1].isspace():
            at -= 1
    return at


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Token spans (i, j exclusive) that could be an entity: a digit or '@' inside, no gap but single blanks, sensible ends."""
    out = []
    n = len(tokens)
    kind = [2 if text[a] == "@" else 1 if any(map(str.isdigit, text[a:b])) else 0 for a, b in tokens]
    for i in range(n):
        first = text[tokens[i][0]]
        if not (first.isalnum() or first in "+("):
            continue
        held, blanks = 0, 0
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            a, b = tokens[j - 1]
            if j > i + 1:
                gap = a - tokens[j - 2][1]
                if gap > 1 or (gap == 1 and text[a - 1] != " "):
                    break
                blanks += gap
                if blanks and not (text[a].isdigit() or text[a] in "()+-."):  # entities with blanks are of digits
                    break
            if blanks and not (text[tokens[i][0]].isdigit() or text[tokens[i][0]] in "+("):
                break
            held = max(held, kind[j - 1])
            last = text[b - 1]
            if held and (last.isalnum() or last == ")"):
                out.append((i, j))
    return out


def span_features(text: str, a: int, b: int, n_tokens: int, before: str) -> list[int]:
    """Numbers of the features that the span text[a:b] has."""
    s = text[a:b]
    digits = "".join(c for c in s if c in "0123456789")
    n = len(digits)
    f = ["bias"]
    f += [name for name, form in _FORMS.items() if form.fullmatch(s)]
    f.append("digits_1_6" if n < 7 else "digits_7_9" if n < 10 else "digits_10_12" if n < 13 else "digits_13_19" if n < 20 else "digits_more")
    if 13 <= n <= 19 and luhn(digits):
        f.append("luhn")
    f.append("tokens_1" if n_tokens == 1 else "tokens_many")
    if "@" in s:
        f.append("at")
    if any(map(str.isalpha, s)):
        f.append("letters")
    if not s[0].isalnum():
        f.append("starts_sign")
    if not s[-1].isalnum():
        f.append("ends_sign")
    p, q = text[a - 1 : a], text[b : b + 1]
    if p and (p.isalnum() or p in "_@"):
        f.append("glued_before")
    if q and (q.isalnum() or q in "_@"):
        f.append("glued_after")
    if p and p in ".-:/+(" and text[a - 2 : a - 1].isalnum() or p in ("+", "("):
        f.append("dotted_before")
    if q and q in ".-:/" and text[b + 1 : b + 2].isalnum():
        f.append("dotted_after")
    if " " in s:
        f.append("spaces")
    if before in _CUE:
        f.append("cue_" + _CUE[before])
    return [_NUMBER[x] for x in f]


class Lattice:
    """Candidate segments of a window with their features, by end; the dynamic programs run over it."""

    def __init__(self, text: str, start: int = 0, end: int | None = None):
        end = len(text) if end is None else end
        start = words_before(text, start)
        self.tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
        words = [text[a:b].lower() for a, b in self.tokens]
        self.spans = candidates(text, self.tokens)
        self.x = np.zeros((len(self.spans), len(FEATURES)))
        for k, (i, j) in enumerate(self.spans):
            cue = next((w for w in reversed(words[max(0, i - 3) : i]) if w in _CUE), "")
            self.x[k, span_features(text, self.tokens[i][0], self.tokens[j - 1][1], j - i, cue)] = 1
        self.ending: list[list[int]] = [[] for _ in range(len(self.tokens) + 1)]
        for k, (_i, j) in enumerate(self.spans):
            self.ending[j].append(k)

    def viterbi(self, w: np.ndarray, side: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first token, last+1, type, score) of the best segmentation's entities. w: (types, features); side: the weight of
        each pair of types side by side. Of equal ones no entity counts, then the earlier and shorter span, then the first type."""
        s = self.x @ w.T
        n, kinds = len(self.tokens), len(w)
        free, held = [0.0] + [-np.inf] * n, np.full((n + 1, kinds), -np.inf)  # last label: none, an entity of each type
        back_free, back_held = [-1] * (n + 1), {}
        for j in range(1, n + 1):
            free[j] = free[j - 1]
            k = int(held[j - 1].argmax())
            if held[j - 1, k] > free[j]:
                free[j], back_free[j] = float(held[j - 1, k]), k
            for k in self.ending[j]:
                i = self.spans[k][0]
                before = np.full(kinds, free[i])
                from_ = np.full(kinds, -1)
                if held[i].max() > -np.inf:
                    reached = held[i][:, None] + side
                    best = reached.argmax(0)
                    top = reached[best, np.arange(kinds)]
                    better = top > before
                    before, from_ = np.where(better, top, before), np.where(better, best, from_)
                v = before + s[k]
                for y in np.flatnonzero(v > held[j]):
                    held[j, y], back_held[j, int(y)] = v[y], (k, int(from_[y]))
        out, j = [], n
        state = int(held[n].argmax()) if held[n].max() > free[n] else -1
        while j > 0:
            if state < 0:
                state, j = back_free[j], j - 1
            else:
                k, last = back_held[j, state]
                i = self.spans[k][0]
                out.append((i, j, state, float(s[k, state])))
                j, state = i, last
        return out[::-1]

    def expectations(self, w: np.ndarray, side: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """log Z, the expected (segment, type) counts, and the expected pairs of types side by side."""
        s = self.x @ w.T
        n, kinds = len(self.tokens), len(w)
        add = np.logaddexp.reduce
        af, ah = np.full(n + 1, -np.inf), np.full((n + 1, kinds), -np.inf)
        af[0] = 0
        into = np.full((len(self.spans), kinds), -np.inf)  # mass of all ways to a segment of a type, the segment not counted
        for j in range(1, n + 1):
            af[j] = np.logaddexp(af[j - 1], add(ah[j - 1]))
            for k in self.ending[j]:
                i = self.spans[k][0]
                into[k] = np.logaddexp(af[i], add(ah[i][:, None] + side, axis=0))
                ah[j] = np.logaddexp(ah[j], into[k] + s[k])
        z = np.logaddexp(af[n], add(ah[n]))
        bf, bh = np.full(n + 1, -np.inf), np.full((n + 1, kinds), -np.inf)
        bf[n], bh[n] = 0, 0
        p, pairs = np.zeros((len(self.spans), kinds)), np.zeros((kinds, kinds))
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, _j) in enumerate(self.spans):
            starting[i].append(k)
        for i in range(n - 1, -1, -1):
            bf[i] = bf[i + 1]
            bh[i] = bf[i + 1]
            for k in starting[i]:
                v = s[k] + bh[self.spans[k][1]]
                bf[i] = np.logaddexp(bf[i], add(v))
                bh[i] = np.logaddexp(bh[i], add(side + v, axis=1))
                p[k] = np.exp(into[k] + v - z)
                pairs += np.exp(ah[i][:, None] + side + v - z)
        return z, p, pairs


def made_sentences(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences from templates with their entities: all types, and many things that only look like one."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwyzéñü") for _ in range(r.randint(2, 9)))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvwyz") for _ in range(r.randint(2, 9)))

    def card() -> str:
        s = r.choice("3456") + d(14)
        s += next(c for c in "0123456789" if luhn(s + c)) if r.random() < 0.3 else d(1)
        return s if r.random() < 0.6 else r.choice(" -").join(s[k : k + 4] for k in range(0, 16, 4))

    entity = {
        "email": lambda: f"{name()}{r.choice(['', '.' + name(), '_' + d(2), '.' + d(2), '+' + name()])}@{name()}{r.choice(['', d(1), '-' + name()])}.{r.choice(['', name() + '.'])}{r.choice(['com', 'org', 'de', 'co.uk'])}",
        "phone": lambda: r.choice([lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", lambda: f"+{r.randint(1, 99)}-{d(3)}-{d(3)}-{d(4)}"])(),
        "ip": lambda: ".".join(str(r.randint(0, r.choice((9, 20, 255, 255)))) for _ in range(4)) if r.random() < 0.8 else ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)),
        "card": card,
        "national_id": lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
    }
    hex_ = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    decoy = [lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: "19" + d(2), lambda: f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f'"{hex_(40)}"', lambda: d(r.randint(1, 9)), lambda: d(r.randint(20, 40)), lambda: f"${d(3)}.{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{r.randint(256, 999)}.{d(3)}.{d(2)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", lambda: f"@{name()}", lambda: f"{name()}@{name()}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{name()}{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(1)}-{d(1)}", lambda: f"({d(4)})", lambda: f"{hex_(8)}-{hex_(4)}-{hex_(4)}-{hex_(12)}", lambda: f"{d(3)} {d(3)}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(1, 5))) + r.choice([" ", " ", " ", ", ", ".\n", ": "])
            if r.random() < 0.6:
                t = r.choice(TYPES)
                if r.random() < 0.3:
                    text += r.choice(_CUES[t]) + r.choice([" ", ": ", " is "])
                text += r.choice(["", "", "", "(", '"', "<"]) if t != "phone" else ""
                s = entity[t]()
                spans.append((len(text), len(text) + len(s), t))
                text += s
                while r.random() < 0.15:  # another one beside it
                    t = r.choice(TYPES)
                    s = entity[t]()
                    text += " "
                    spans.append((len(text), len(text) + len(s), t))
                    text += s
            else:
                text += r.choice(decoy)()
            text += r.choice([" ", " ", " ", ". ", ", ", "### ", "!! ", ")\n", '" ', " | "])
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=2)
def train(n: int = 300, epochs: int = 40, seed: int = 5, ridge: float = 2e-3) -> tuple[tuple[tuple[float, ...], ...], tuple[tuple[float, ...], ...]]:
    """Weights of features and of pairs of types, by gradient ascent (Adam) on the conditional log-likelihood of made sentences."""
    data = []
    for text, spans in made_sentences(n, seed):
        lat = Lattice(text)
        at = {(lat.tokens[i][0], lat.tokens[j - 1][1]): k for k, (i, j) in enumerate(lat.spans)}
        gold, beside = np.zeros((len(lat.spans), len(TYPES))), np.zeros((len(TYPES), len(TYPES)))
        if any((a, b) not in at for a, b, _ in spans):
            raise ValueError(f"an entity that isn't a candidate: {text}")
        for a, b, t in spans:
            gold[at[a, b], TYPES.index(t)] = 1
        ends = {lat.spans[at[a, b]][1]: t for a, b, t in spans}
        for a, b, t in spans:
            before = ends.get(lat.spans[at[a, b]][0])
            if before:
                beside[TYPES.index(before), TYPES.index(t)] += 1
        data.append((lat, gold, beside))
    size = (len(TYPES), len(FEATURES) + len(TYPES))  # the pairs' weights are the last columns
    w = np.zeros(size)
    w[:, 0] = -2
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, epochs + 1):
        g = np.zeros(size)
        for lat, gold, beside in data:
            if len(lat.spans):
                _, p, pairs = lat.expectations(w[:, : len(FEATURES)], w[:, len(FEATURES) :])
                g[:, : len(FEATURES)] += (gold - p).T @ lat.x
                g[:, len(FEATURES) :] += beside - pairs
        g = g / len(data) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tuple(map(tuple, w[:, : len(FEATURES)])), tuple(map(tuple, w[:, len(FEATURES) :]))


def find(text: str, weights: np.ndarray, side: np.ndarray) -> list[tuple[int, int, str, float]]:
    """(start, end, type, score) of the entities in text."""
    out = []
    for a, b in windows(text):
        lat = Lattice(text, a, b)
        if lat.spans:
            out += [(lat.tokens[i][0], lat.tokens[j - 1][1], TYPES[t], score) for i, j, t, score in lat.viterbi(weights, side)]
    return out


def _batches(weights: np.ndarray, side: np.ndarray):
    def run(batches):
        for b in pieces(batches):
            rows = [(d, a, e, t, round(s, 4)) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if text for a, e, t, s in find(text, weights, side)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "start", "end", "type", "score"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (character positions), type and score (log-odds against no entity) of each entity.

    Null and empty texts hold none. Rows without doc_id are reported with a null id, repeated rows once each. Other
    columns are ignored, whatever their names.
    """
    weights, side = train()
    # texts without a digit or '@' hold no candidate and don't leave the JVM
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where(F.col("text").rlike(r"[\p{Nd}@]"))
    return some.mapInArrow(_batches(np.array(weights), np.array(side)), "doc_id long, start long, end long, type string, score double")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
