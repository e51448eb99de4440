"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two words counts the subsequences of three and four letters that they share, each weighted
by a decay for every letter that it spans, gaps included; its power stresses close matches. So letters put
between those of an insult, or endings put after its stem, only weaken a match, and marks put in cost
nothing, since a word with marks inside is also scored by its letters alone. Landmarks are words of the
labelled sentences; a word's kernels with them, whitened, are its features.

The machine is trained on labelled sentences, as a multiple-instance problem: a sentence's margin is that
of its strongest word, every sentence of a clean text is negative, and a toxic text has a positive sentence
at least. Its witness is the word that explains most toxic texts not explained yet. Two numbers fitted on
the training texts turn a text's strongest sentence into a probability.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DECAY = 0.85
#: The orders of the subsequences that are counted.
ORDERS = (3, 4)
#: The power of the kernel, which stresses close matches.
POWER = 2
#: Letters that the beginnings have at least by which witnesses are told.
STEM = 4
#: Longer words are taken in overlapping parts of LONGEST letters, STEP letters apart.
LONGEST = 24
STEP = 12
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”„’‘…–—"
MARKS = re.compile(r"[\W_]+")
SPACED = re.compile(r" (\S(?: \S){2,})(?= |$)")


def normal(word: str) -> list[str]:
    """The units of a lower-cased word: itself without outer punctuation, in overlapping parts if it is long, and its letters alone if marks stand between them."""
    word = word.strip(OUTER)
    if not word:
        return []
    if word.isalnum():
        return _parts(word)
    bare = MARKS.sub("", word)
    return list(dict.fromkeys([*_parts(word), *_parts(bare)])) if bare else _parts(word)


def _parts(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[a : a + LONGEST] for a in range(0, len(word) - LONGEST + STEP, STEP)]


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+\s", text) if s.strip()]


def words(text: str) -> set[str]:
    """The distinct lower-cased words of a text, and those spelled out with spaces between their letters."""
    low = text.lower()
    out = set(low.split())
    if " " in low:
        out.update(m.replace(" ", "") for m in SPACED.findall(" " + low))
    return out


@lru_cache(maxsize=None)
def _own(n: int) -> float:
    """The kernel of a word of n distinct letters with itself, which makes kernels of long and short words comparable.

    Very short words count as if they had five letters: the few subsequences they have prove little.
    """
    n, total = max(n, 5), 0.0
    for order in ORDERS:
        k = np.array([[1.0] * (n + 1)] * (n + 1))
        for _ in range(order - 1):
            nxt = np.zeros((n + 1, n + 1))
            for i in range(1, n + 1):
                run = 0.0
                for j in range(1, n + 1):
                    run = DECAY * run + (DECAY**2 * k[i - 1, j - 1] if i == j else 0.0)
                    nxt[i, j] = DECAY * nxt[i - 1, j] + run
            k = nxt
        total += sum(DECAY**2 * k[i - 1, i - 1] for i in range(1, n + 1)) / DECAY ** (2 * order)
    return max(total, 1e-6) ** 0.5


class Landmarks:
    """Words with which kernels are taken.

    A match of letters at the places i of a unit and j of a landmark stands for the decays of its
    subsequence by decay^-(i + j) where the subsequence begins and by decay^(i + j) where it ends, so that
    nothing decays in between. The state of a unit holds, by place of a landmark, the weights of the
    subsequences of one, two and three letters that end there. A letter changes the state linearly: its
    tables sum what ends before each of its places.
    """

    def __init__(self, marks: list[str]):
        self.marks = marks
        ends = np.cumsum([0, *(len(m) + 1 for m in marks)])
        self.starts, self.size = ends[:-1], int(ends[-1])
        self.scale = np.array([_own(len(m) + 1) for m in marks], np.float32)
        places: dict[str, list[tuple[int, int]]] = {}
        for k, m in enumerate(marks):
            for j, c in enumerate("^" + m):
                places.setdefault(c, []).append((j, k))
        self.code = {c: i + 1 for i, c in enumerate(sorted(places))}
        self.tables = [self._tables(places[c]) for c in sorted(places)]

    def _tables(self, places: list[tuple[int, int]]):
        """Columns of the state, the sums before them, the weights of beginnings there and of ends by landmark."""
        columns = np.array([self.starts[k] + j for j, k in places])
        before, ends = np.zeros((self.size, len(places)), np.float32), np.zeros((len(places), len(self.marks)), np.float32)
        for at, (j, k) in enumerate(places):
            before[self.starts[k] : self.starts[k] + j, at] = 1
            ends[at, k] = DECAY**j
        return columns, before, np.array([DECAY**-j for j, _ in places], np.float32), ends

    def kernels(self, units: list[str], part: int = 8192) -> np.ndarray:
        """Units by landmarks. Units are sorted, so that those with a common beginning share its work."""
        points = np.array(["^" + u.replace("\0", "\1") for u in units] or ["^"], dtype=np.str_)
        order = np.argsort(points, kind="stable")
        points = points.view(np.uint32).reshape(len(points), -1)
        lengths = np.array([len(u) + 1 for u in units], np.int64)
        out = np.zeros((len(units), len(self.marks)), np.float32)
        for at in range(0, len(units), part):
            some = order[at : at + part]
            out[some] = self._part(points[some], lengths[some])
        return out

    def _part(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """points: sorted units, by code points. A beginning is the node of the first unit that has it."""
        rows, longest = len(points), int(lengths.max())
        letters = np.zeros(points.shape, np.int64)
        for c, k in self.code.items():
            letters[points == ord(c)] = k
        fresh = np.ones((rows, longest), bool)
        fresh[1:] = np.logical_or.accumulate(points[1:, :longest] != points[:-1, :longest], axis=1)
        n, size = len(self.marks), self.size
        one, two, three = (np.zeros((1, size), np.float32) for _ in range(3))
        total, node = np.zeros((1, n), np.float32), np.zeros(rows, np.int64)
        out = np.zeros((rows, n), np.float32)
        for i in range(longest):
            live = lengths > i
            first = np.flatnonzero(fresh[:, i] & live)
            first = first[np.argsort(letters[first, i], kind="stable")]
            parent, letter = node[first], letters[first, i]
            one, two, three, total = one[parent], two[parent], three[parent], total[parent]
            edge = np.searchsorted(letter, np.arange(len(self.tables) + 2))
            for c in np.flatnonzero(np.diff(edge[1:])).tolist():
                columns, sums, begins, last = self.tables[c]
                a, b = edge[c + 1], edge[c + 2]
                pairs, triples, fours = one[a:b] @ sums, two[a:b] @ sums, three[a:b] @ sums
                one[a:b, columns] += begins * np.float32(DECAY**-i)
                two[a:b, columns] += pairs
                three[a:b, columns] += triples
                total[a:b] += (triples * np.float32(DECAY ** (i - 4)) + fours * np.float32(DECAY ** (i - 6))) @ last
            place = np.zeros(rows, np.int64)
            place[first] = np.arange(len(first))
            node = place[np.maximum.accumulate(np.where(fresh[:, i] & live, np.arange(rows), 0))]
            ended = np.flatnonzero(lengths == i + 1)
            out[ended] = total[node[ended]]
        own = np.array([_own(k) for k in range(longest + 1)], np.float32)[lengths]
        return np.minimum(out / own[:, None] / self.scale[None, :], np.float32(1)) ** POWER


@dataclass
class Model:
    marks: Landmarks
    weights: np.ndarray  # on kernels with the landmarks: the whitening and the separating plane in one
    bias: float
    slope: float
    shift: float

    def margins(self, units: list[str]) -> np.ndarray:
        return self.marks.kernels(units) @ self.weights + np.float32(self.bias)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margin + self.shift)))


class Scorer:
    """Margins of words, remembered in two generations of about `limit` words; one for each task, so that workers keep nothing."""

    def __init__(self, model: Model, limit: int = 100_000):
        self.model, self.limit, self.now, self.old = model, limit, {}, {}

    def margins(self, texts: list[str]) -> np.ndarray:
        """The strongest word's margin in each text; that of the empty word without words."""
        sets = [words(t) for t in texts]
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        now, old, new = self.now, self.old, []
        for w in set().union(*sets) if sets else ():
            if w not in now:
                if w in old:
                    now[w] = old[w]
                else:
                    new.append(w)
        units = [normal(w) for w in new]
        distinct = sorted({u for us in units for u in us})
        value = dict(zip(distinct, self.model.margins(distinct).tolist(), strict=True)) if distinct else {}
        for w, us in zip(new, units, strict=True):
            now[w] = max((value[u] for u in us), default=self.model.bias)
        return np.array([max(map(now.__getitem__, s), default=self.model.bias) for s in sets])


def variants(word: str, letters: str, r: random.Random, each: int) -> list[str]:
    """The word as those who hide an insult write it: letters put in (`each` at every place), doubled, put between all letters, or an ending."""
    inner = range(1, len(word))
    out = [word[:k] + r.choice(letters) + word[k:] for k in inner for _ in range(each)] + [word[:k] + word[k - 1] + word[k:] for k in inner]
    return out + [r.choice(letters).join(word) for _ in range(each)] + [word + "s", word + "es"]


def _plane(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Squared hinge loss, by Adam on all rows."""
    w, mom, var = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    z = np.hstack([x, np.ones((len(x), 1))])
    for step in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (z @ w))
        grad = -2 * (z.T @ (weight * y * slack)) + ridge * np.append(w[:-1], 0)
        mom += 0.1 * (grad - mom)
        var += 0.01 * (grad**2 - var)
        w -= 0.1 * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def stems(units: set[str]) -> set[str]:
    """The beginnings of at least STEM letters of the units."""
    return {u[:k] for u in units for k in range(STEM, len(u) + 1)}


class Names(dict):
    """Numbers of units, given out as they come; keeps what is learned from small."""

    def __missing__(self, unit: str) -> int:
        self[unit] = len(self)
        return self[unit]

    def sentences(self, text: str) -> list[np.ndarray]:
        """The distinct units of every sentence that has any."""
        held = (np.unique(np.fromiter((self[u] for w in words(s) for u in normal(w)), np.int32)) for s in sentences(text))
        return [s for s in held if len(s)]


def witnesses(toxic: list[set[str]], clean: list[set[str]], *, support: float, odds: float) -> Counter:
    """The stems that explain the toxic texts, with the number of toxic texts that hold each; texts are sets of units, and may be made anew each time they are gone through.

    A stem qualifies if toxic texts hold it `odds` times as often as clean ones. In turn, the stem in most
    unexplained texts is taken, in the longest form that nearly as many of them hold, as long as it is in
    the share `support` of the toxic texts, and three at least. Stems in five times as many texts are
    witnesses too even if all of these hold another; others only keep company with witnesses.
    """
    count: Counter = Counter()
    for units in toxic:
        count.update(stems(units))
    least = max(3, math.ceil(support * len(toxic)))
    known = {x for x, n in count.items() if n >= least}
    count = Counter({x: count[x] for x in known})
    away: Counter = Counter()
    for units in clean:
        away.update(stems(units) & known)
    told = {x for x in known if (count[x] + 0.5) / (len(toxic) + 1) >= odds * (away[x] + 0.5) / (len(clean) + 1)}
    holders: dict[str, set[int]] = {x: set() for x in told}
    for i, units in enumerate(toxic):
        for x in stems(units) & told:
            holders[x].add(i)

    def longest(x: str, left: dict[str, int]) -> str:
        return max((y for y in left if y.startswith(x) and left[y] >= 0.9 * left[x]), key=lambda y: (len(y), left[y], y))

    out, open_ = Counter(), {x: set(h) for x, h in holders.items()}
    while open_:
        left = {x: len(h) for x, h in open_.items()}
        best = longest(min(left, key=lambda x: (-left[x], x)), left)
        if left[best] < least:
            break
        out[best] = count[best]
        gone = open_[best]
        open_ = {x: rest for x, h in open_.items() if (rest := h - gone)}
    often = {x: count[x] for x in told if count[x] >= 5 * least}
    for x in sorted(often, key=lambda x: (-often[x], len(x), x)):
        if not any(x.startswith(y) or y.startswith(x) for y in out):
            out[y] = count[y := longest(x, often)]
    return out


class Bags:
    """Texts as sets of units, each made when it is asked for."""

    def __init__(self, texts: list[list[np.ndarray]], units: list[str]):
        self.texts, self.units = texts, units

    def __len__(self) -> int:
        return len(self.texts)

    def __iter__(self):
        for t in self.texts:
            yield {self.units[k] for k in np.unique(np.concatenate(t)).tolist()} if t else set()


def spread(candidates: list[str], most: int, near: float) -> list[str]:
    """Up to `most` of the candidates, best first, none with a kernel of `near` or more with one before it."""
    kept: list[str] = []
    for u in candidates:
        if len(kept) == most:
            break
        if not kept or Landmarks([u]).kernels(kept).max() < near:
            kept.append(u)
    return kept


def fit(toxic: list[str], clean: list[str], *, landmarks: int = 64, support: float = 0.01, odds: float = 50.0, hard: int = 6000, rounds: int = 4, ridge: float = 1e-3, caution: float = 3.0, seed: int = 5) -> Model:
    """Fit on texts of both labels.

    Every sentence of a clean text is negative. In a toxic text the sentences with a word that begins with
    a witness are positive. Words in five times the texts that `support` asks for are positive hidden, too
    (see `variants`), twice as heavy as plain. In each round the plane is fitted, the strongest word of
    every clean sentence is looked up, and the `hard` strongest of them all become negatives, the most
    different ones landmarks too. Half of the landmarks are for witnesses at most. caution: how much
    heavier the clean side is. These numbers bound what is learned from, not what is scored.
    """
    r, names = random.Random(seed), Names()
    texts = [[names.sentences(t) for t in side] for side in (toxic, clean)]
    units = list(names)
    found = witnesses(Bags(texts[0], units), Bags(texts[1], units), support=support, odds=odds)
    negative = [s for t in texts[1] for s in t]
    seen = np.bincount(np.concatenate(negative) if negative else np.zeros(0, np.int32), minlength=len(units))
    ranked = sorted(np.flatnonzero(seen).tolist(), key=lambda k: (-seen[k], units[k]))
    if not found or not negative:
        marks = Landmarks([min(found, key=lambda u: (-found[u], u)) if found else units[ranked[0]] if ranked else "-"])
        return Model(marks, np.zeros(1, np.float32), -1.0, 1.0, 2.0 if found else -2.0)
    letters = "".join(sorted({c for u in found for c in u if c.isalpha()})) or "x"
    plain = sorted(found, key=lambda u: (-found[u], u))
    times = np.bincount(np.concatenate([s for t in texts[0] for s in t]), minlength=len(units))
    weigh: dict[str, float] = {}
    often = 5 * max(3, math.ceil(support * len(toxic)))
    for u, n in sorted((u, int(times[k])) for k, u in enumerate(units) if times[k] and not seen[k] and u.startswith(tuple(plain))):
        hidden = [v for v in variants(u, letters, r, 3) if len(v) <= LONGEST and not (v in names and seen[names[v]])] if n >= often else []
        for v, m in [(u, n / 2), *((v, n / len(hidden)) for v in hidden)]:
            weigh[v] = weigh.get(v, 0) + m
    positive = list(weigh)
    chosen = spread(plain, max(1, landmarks // 2), 0.5)
    room = landmarks - len(chosen)
    sampled = [units[k] for k in ranked[:hard]]
    chosen += spread([u for u in sampled if len(u) > 3], room // (rounds + 1), 0.3)
    heavy = np.array([weigh[u] for u in positive])
    for step in range(rounds):
        marks = Landmarks(list(dict.fromkeys(chosen)))
        values, vectors = np.linalg.eigh(marks.kernels(marks.marks).astype(np.float64))
        white = vectors[:, values > 1e-3] / np.sqrt(values[values > 1e-3])
        x = marks.kernels(positive + sampled).astype(np.float64) @ white
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(sampled))])
        light = np.array([seen[names[u]] ** 0.5 for u in sampled])
        plane, bias = _plane(x, y, np.concatenate([heavy / heavy.sum(), caution * light / light.sum()]) / (1 + caution), ridge)
        model = Model(marks, (white @ plane).astype(np.float32), bias, 1.0, 0.0)
        if step < rounds - 1:
            margin = np.full(len(units), -np.inf)
            margin[ranked] = model.margins([units[k] for k in ranked])
            strongest = {int(s[np.argmax(margin[s])]) for s in negative}
            strongest = [units[k] for k in sorted(strongest, key=lambda k: (-margin[k], units[k]))[:hard]]
            chosen += spread([u for u in strongest if len(u) > 2], room // (rounds + 1), 0.3)
            sampled = list(dict.fromkeys(strongest + sampled))
    scorer = Scorer(model)
    plainly, cleanly, hiddenly = scorer.margins(toxic), scorer.margins(clean), model.margins(positive)
    weight = [np.full(len(plainly), 0.5 / len(plainly)), 0.5 * heavy / heavy.sum(), np.full(len(cleanly), 0.8 * caution / len(cleanly))]
    model.slope, model.shift = _platt(np.concatenate([plainly, hiddenly, cleanly]), np.repeat([1.0, 1.0, 0.0], [len(w) for w in weight]), np.concatenate(weight) / (1 + caution))
    return model


def _platt(margin: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps."""
    z = np.stack([margin, np.ones(len(margin))], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - truth)) + 1e-3 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return float(max(w[0], 1e-3)), float(w[1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 2500, seed: int = 5) -> Model:
    """Fit on at most `sample` toxic and `sample` clean labelled texts that are not held out, chosen by a hash of the id.

    The chosen ids are at most 2 * sample and are broadcast. Labels that are null or of documents that do
    not exist are no examples; an id with several labels counts as toxic if one of them is 1.
    """
    one = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    ranked = one.withColumn("h", F.xxhash64("id", F.lit(seed)))
    chosen = ranked.filter("toxic = 1").orderBy("h", "id").limit(sample).unionByName(ranked.filter("toxic = 0").orderBy("h", "id").limit(sample))
    found = common.texts(docs).join(F.broadcast(chosen.select("id", "toxic")), F.col("doc_id") == F.col("id")).select("toxic", "text", "doc_id")
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in found.collect())
    return fit([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0], seed=seed)


def score(docs: DataFrame, model: Model, *, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every whole text, with the columns `keep` of `docs`.

    Null and empty texts, and those without words, get the score of the empty word. Repeated rows give
    repeated results; an empty table gives no rows.
    """
    keep = keep or []
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for whole in batches:
            for a, b in common.slices(whole.column(1)):
                batch = whole.slice(a, b - a)
                p = scorer.model.probability(scorer.margins(batch.column(1).to_pylist()).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *batch.columns[2:]], names=["doc_id", "score", "predicted", *keep])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)])
    return asked.mapInArrow(common.lean(run), "doc_id long, score double, predicted int" + extra)
