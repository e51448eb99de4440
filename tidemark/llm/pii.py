"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table of sentences, which is made by rule here, and decoded by
Viterbi in numpy batches. All words of a text are one chain and every word is scored. Where a word's score
for O beats its other labels by more than any two moves between labels can give back, the best path surely
calls it O; there the chain is cut, and only the runs between such words are decoded, which is exact.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["O", *KINDS]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@=]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches: a match starts where the run of local characters before an '@' starts, or not at all."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_RUN.match(text[start - 1]):
            start -= 1
        m = LOCAL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) by the fixed patterns, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


# --- the random field ---------------------------------------------------------------------------------

SQUEEZE = re.compile(r"X+|x+|d+")


def shape(word: str) -> str:
    s = "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return SQUEEZE.sub(lambda m: m.group()[0], s)


def _bucket(n: int) -> int:
    return next((i for i, b in enumerate((0, 2, 4, 8, 11, 19)) if n <= b), 6)


@lru_cache(maxsize=20_000)  # half a KB each; `Types` remembers a text's frequent words by itself
def word_features(word: str) -> tuple[str, ...]:
    digits = sum("0" <= c <= "9" for c in word)
    s = shape(word.strip(".,;:!?"))
    return ("bias", f"s={s}", f"n={_bucket(digits)}", f"dots={min(4, word.count('.'))}", f"at={'@' in word}", f"eq={'=' in word}", f"first={s[:2]}", f"long={len(word) > 14}", f"mixed={digits > 0 and any(c.isalpha() for c in word)}")


def features(words: list[str], i: int) -> list[str]:
    before = shape(words[i - 1].strip(".,;:!?"))[:6] if i else "^"
    after = shape(words[i + 1].strip(".,;:!?"))[:6] if i + 1 < len(words) else "$"
    return [*word_features(words[i]), f"p={before}", f"q={after}"]


def labelled_table(n: int = 420, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences of invented words with marked personal data, and with harmless numbers."""
    r = random.Random(seed)
    syllables = ["ka", "ter", "lo", "mi", "ren", "sü", "ció", "é", "the", "an", "do", "wer"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def entity() -> tuple[list[str], str]:
        kind = r.choice(KINDS)
        if kind == "email":
            return [f"{word()}{r.choice(['.', '_', ''])}{digits(r.randint(0, 2))}@{word()}{digits(r.randint(0, 1))}.{r.choice(['com', 'example.org', 'net'])}"], kind
        if kind == "ip":
            return [".".join(str(r.randint(0, 255)) for _ in range(4))], kind
        if kind == "card":
            groups = [digits(4) for _ in range(4)]
            return r.choice([["".join(groups)], groups, ["-".join(groups)]]), kind
        if kind == "phone":
            return r.choice([[f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(2)}{digits(9)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"]]), kind
        if r.random() < 0.4:
            return ["".join(r.choice("0123456789abcdef") for _ in range(r.randint(24, 40)))], kind
        return [f"{r.choice(['password', 'api_key', 'secret', 'token'])}={''.join(r.choice('0123456789abcdef') for _ in range(r.randint(10, 24)))}"], kind

    harmless = [lambda: digits(1), lambda: digits(2), lambda: str(r.randint(1900, 2030)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(2)}%", lambda: f"{digits(1)}.", lambda: f"x={digits(1)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"${digits(3)}", lambda: f"{digits(2)}:{digits(2)}", lambda: digits(3), lambda: f"{digits(1)},{digits(3)}"]
    table = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(r.randint(3, 12)):
            p = r.random()
            if p < 0.16:
                found, kind = entity()
            elif p < 0.34:
                found, kind = [r.choice(harmless)()], "O"
            else:
                w = word()
                found, kind = [r.choice([w, w, w.capitalize(), w + r.choice(".,"), w.upper(), w + "***", '"' + w + '"', "|", "-", "***", "+", f"({w})", f"{w}-{word()}", f"{w}'s", w + word() + word() + word() + word(), f"{w}/{word()}.{word()}.{word()}", f"{w}.{word()}", "".join(c.upper() if i % 2 else c for i, c in enumerate(w))])], "O"
            if r.random() < 0.2:
                found = [*found[:-1], found[-1] + r.choice(".,")]
            words += found
            labels += [kind] * len(found)
        table.append((words, labels))
    return table


class Field:
    """Weights: one row of label scores a feature, and a matrix of label-to-label scores."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        m = moves
        #: What a label can gain over O at one place by the moves into it and out of it, at most.
        self.gain = ((m[:, None, 1:] + m.T[None, :, 1:]) - (m[:, 0][:, None, None] + m[0][None, :, None])).max((0, 1))

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for i in range(len(words)):
            rows = [k for f in features(words, i) if (k := self.index.get(f)) is not None]
            out[i] = self.weights[rows].sum(0)
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of a padded batch (sequences, places, labels); before and after a sequence stands O."""
        n, most, k = scores.shape
        back = np.zeros((n, most, k), np.int8)
        best = scores[:, 0] + self.moves[0]
        for t in range(1, most):
            path = best[:, :, None] + self.moves[None]
            back[:, t] = path.argmax(1)
            step = path.max(1) + scores[:, t]
            best = np.where((t < lengths)[:, None], step, best)
        out = np.zeros((n, most), np.int8)
        now = (best + self.moves[:, 0]).argmax(1)
        for t in range(most - 1, -1, -1):
            live = t < lengths
            out[live, t] = now[live]
            now = np.where(live, back[np.arange(n), t, now], now) if t else now
        return out


def train(table: list[tuple[list[str], list[str]]], *, rounds: int = 100, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam on the whole table, forward and backward in log space over a padded batch."""
    index: dict[str, int] = {}
    rows = [[[index.setdefault(f, len(index)) for f in features(w, i)] for i in range(len(w))] for w, _ in table]
    n, most, k, width = len(table), max(len(w) for w, _ in table), len(LABELS), len(rows[0][0])
    feats, gold, live = np.zeros((n, most, width), np.int64), np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for a, (r, (_, labels)) in enumerate(zip(rows, table, strict=True)):
        feats[a, : len(r)], gold[a, : len(r)], live[a, : len(r)] = r, [LABELS.index(x) for x in labels], True
    w, m = np.zeros((len(index), k)), np.zeros((k, k))
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
    lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    hot = np.eye(k)
    for step in range(1, rounds + 1):
        s = w[feats].sum(2)
        alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
        alpha[:, 0] = s[:, 0] + m[0]
        for t in range(1, most):
            alpha[:, t] = np.where(live[:, t, None], lse(alpha[:, t - 1, :, None] + m[None], 1) + s[:, t], alpha[:, t - 1])
        total = lse(alpha[:, -1] + m[:, 0], 1)
        beta[:, -1] = m[:, 0]
        for t in range(most - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], lse(m[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        p = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
        gap = (hot[gold] * live[..., None] - p) / n
        gw, gm = np.zeros_like(w), np.zeros_like(m)
        np.add.at(gw, feats.reshape(-1), np.repeat(gap.reshape(-1, k), width, 0))
        for t in range(1, most):
            pair = np.exp(alpha[:, t - 1, :, None] + m[None] + (s[:, t] + beta[:, t])[:, None, :] - total[:, None, None]) * live[:, t, None, None]
            gm += ((hot[gold[:, t - 1]][:, :, None] * hot[gold[:, t]][:, None, :]) * live[:, t, None, None] - pair).sum(0) / n
        gm[0] += (hot[gold[:, 0]] - p[:, 0]).sum(0) / n
        last = live.sum(1) - 1
        gm[:, 0] += (hot[gold[np.arange(n), last]] - p[np.arange(n), last]).sum(0) / n
        for value, grad, a, b in ((w, gw, moment[0], moment[1]), (m, gm, moment[2], moment[3])):
            grad -= ridge * value
            a += 0.1 * (grad - a)
            b += 0.01 * (grad**2 - b)
            value += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Field(index, w, m)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


# --- texts --------------------------------------------------------------------------------------------

TRIM = ".,;:!?\"'"
WORD = re.compile(r"\S+")


class Types:
    """What the field knows of a word: its own scores and those that it lends to its neighbours. Words of one kind share a type.

    Lower-case words without marks, the bulk of any text, are two types by their length. At most about
    `limit` other words are remembered.
    """

    def __init__(self, field: Field, limit: int = 50_000):
        self.field, self.limit = field, limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table, self.used = np.zeros((1024, 3 * len(LABELS))), 0
        self.plain = [self._add("ab"), self._add("abcdefghijklmnop")]

    def _add(self, word: str) -> int:
        f = self.field
        own = [k for x in word_features(word) if (k := f.index.get(x)) is not None]
        beside = shape(word.strip(".,;:!?"))[:6]
        lent = [f.weights[k] if (k := f.index.get(f"{side}={beside}")) is not None else np.zeros(len(LABELS)) for side in "pq"]
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = np.concatenate([f.weights[own].sum(0), *lent])
        self.known[word] = self.used
        self.used += 1
        return self.used - 1

    def scores(self, words: list[str]) -> np.ndarray:
        """The scores of a whole text's words."""
        if len(self.known) > self.limit:
            self.forget()
        known, add, (short, long_) = self.known, self._add, self.plain
        ids = np.array([(long_ if len(w) > 14 else short) if w.isalpha() and w.islower() else known[w] if w in known else add(w) for w in words], np.int64)
        n, table = len(LABELS), self.table
        out = table[ids, :n]
        edge = [f.weights[k] if (k := (f := self.field).index.get(x)) is not None else 0.0 for x in ("p=^", "q=$")]
        out[1:] += table[ids[:-1], n : 2 * n]
        out[:-1] += table[ids[1:], 2 * n :]
        out[0] += edge[0]
        out[-1] += edge[1]
        return out


def field_spans(texts: list[str], types: Types, most: int = 100_000) -> list[list[tuple[int, int, int]]]:
    """(start, index of kind, end) that the field finds in each text, words of one label merged."""
    field, out, runs = types.field, [[] for _ in texts], []
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        scores = types.scores(words)
        unsure = np.flatnonzero((scores[:, :1] - scores[:, 1:] <= field.gain).any(1))
        for run in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1) if len(unsure) else ():
            runs.append((len(run), i, int(run[0]), scores[run]))
    runs.sort(key=lambda x: x[0])
    found: dict[int, list[tuple[int, int]]] = {}
    at = 0
    while at < len(runs):
        to = at + 1
        while to < len(runs) and runs[to][0] * (to + 1 - at) <= most:
            to += 1
        part, longest = runs[at:to], runs[to - 1][0]
        scores = np.zeros((len(part), longest, len(LABELS)))
        for k, (n, _, _, own) in enumerate(part):
            scores[k, :n] = own
        labels = field.viterbi(scores, np.array([x[0] for x in part]))
        for k in np.flatnonzero(labels.any(1)).tolist():
            n, i, first, _ = part[k]
            found.setdefault(i, []).extend((first + j, int(x)) for j, x in enumerate(labels[k, :n].tolist()) if x)
        at = to
    for i, marked in found.items():
        out[i] = _merged(texts[i], sorted(marked))
    return out


def _merged(text: str, marked: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """marked: (place of a word, its label). The spans of neighbouring words of one label, without punctuation around them."""
    wanted, ends = dict(marked), {}
    for j, m in enumerate(WORD.finditer(text)):
        if j in wanted:
            ends[j] = m.span()
            if len(ends) == len(wanted):
                break
    out, j = [], 0
    while j < len(marked):
        to = j
        while to + 1 < len(marked) and marked[to + 1] == (marked[to][0] + 1, marked[j][1]):
            to += 1
        (a, a_end), (b_start, b) = ends[marked[j][0]], ends[marked[to][0]]
        head, tail = text[a:a_end], text[b_start:b]
        a, b = a + len(head) - len(head.lstrip(TRIM)), b - len(tail) + len(tail.rstrip(TRIM))
        if a < b:
            out.append((a, marked[j][1] - 1, b))
        j = to + 1
    return out


def added(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of `more` that touch no span of `base`."""
    if not base or not more:
        return more
    starts, ends = np.array([s for s, _, _ in base]), np.maximum.accumulate(np.array([e for _, _, e in base]))
    return [(a, k, b) for a, k, b in more if (j := int(np.searchsorted(starts, b))) == 0 or ends[j - 1] <= a]


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, *, field: Field | None = None, keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base) of every whole text, ordered by start and kind.

    keep: other columns of `docs` to hand on; redacted: also `redacted`, the text without the spans. Null
    and empty texts have no spans; repeated rows give repeated results; an empty table gives no rows.
    """
    field = field or default_field()
    keep = keep or []
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + (", redacted string" if redacted else "")
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        types = Types(field)
        for whole in batches:
            for a, b in common.slices(whole.column(1)):
                batch = whole.slice(a, b - a)
                texts = batch.column(1).to_pylist()
                more = field_spans(texts, types)
                rows, clean = [], []
                for text, own in zip(texts, more, strict=True):
                    base = base_spans(text) if MARKED.search(text) else []
                    both = sorted([(a, k, b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in added(base, own)])
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": f} for a, k, b, f in both])
                    clean.append(redact(text, [x[:3] for x in both]) if redacted else None)
                arrays, names = [batch.column(0), pa.array(rows, span), *batch.columns[2:]], ["doc_id", "spans", *keep]
                if redacted:
                    arrays.append(pa.array(clean, pa.string()))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        word_features.cache_clear()  # workers stay, for other operators too

    return asked.mapInArrow(common.lean(run), FOUND + extra)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' SHA-256 and all spans as text, from the spans of `find`."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
