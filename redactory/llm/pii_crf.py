"""Personal data by patterns and a linear-chain conditional random field over word shapes.

Base spans are the leftmost non-overlapping matches of four patterns (email, ip, card, phone); a match that fails its test (parts, Luhn,
number of digits) is dropped without another try. The patterns are written so that no text makes them scan a stretch twice.

The field labels every word of a text: B and I of the four kinds and of two that no pattern is given for (secret: generated values that a
text calls a token, key or password; name: names of persons), or O. Features are a word's shape, its digits, tests such as Luhn, what the
training table knows it as, and the same of its neighbours. Weights are fitted on a table of some thousand made sentences by gradient
steps on the log-likelihood, forward and backward in numpy over all sequences at once. Decoding is Viterbi over padded batches.

A text of any length is one sequence. Words whose evidence for O is larger than all that transitions could ever gain are O in every best
path (see `Field.gain`), so the sequence falls apart there exactly, and only the stretches between such words need the recursion. What
is decoded is the best path of the whole text. A decoded span counts if it passes the test of its kind and touches no base span.

Defined cases: a null or empty text has no spans; spans are in code points with exclusive ends; words, stretches and texts of any length
are read whole; repeated rows are searched separately; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.arrow import map_arrow, texts_of

#: Kinds that have a pattern, and all kinds.
KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret", "name")
LABELS = ("O", *(f"{p}-{k}" for k in EVERY for p in "BI"))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def valid(kind: str, value: str) -> bool:
    if kind == "email":
        return "@" in value
    if kind == "ip":
        parts = value.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    digits = _DIGITS.sub("", value)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    if not _MARK.search(text):
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        if kind == 3 and "+" not in text:
            continue
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(KINDS[kind], m[0])]
    return sorted(found)


# --- words and their features

#: What is cut from both ends of a word before it is looked at; an opening bracket on the left may belong to a phone number.
_STRIP_LEFT, _STRIP_RIGHT = "\"'<[{", ".,;:!?\"'>]}#*$%&|"
_PARTS = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_MAIL = re.compile(r"[^@\s]+@[^@\s]+[.][^@.\s]+")
_HEX = re.compile(r"[0-9A-Fa-f]+")
_V6 = re.compile(r"[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*")


def core(word: str) -> tuple[int, int]:
    """Where the part of a word without quotes and stops around it begins and ends; equal if nothing is left."""
    end = len(word.rstrip(_STRIP_RIGHT))
    return min(end, len(word) - len(word.lstrip(_STRIP_LEFT))), end


def shape(word: str) -> str:
    """Runs of digits as their number, of letters as A, a or Aa, the rest as it is; many runs by the first and last six."""
    parts = _PARTS.findall(word)
    if len(parts) > 12:
        parts = [*parts[:6], "~", *parts[-6:]]
    return "".join(f"{min(len(x), 20)}" if x[0] in "0123456789" else ("a" if x.islower() else "A" if x.isupper() else "Aa") if x.isascii() and x.isalpha() else "é" if x.isalpha() else x for x in parts)


def size_class(n: int) -> int:
    """0 to 4 as they are, then by doubling."""
    return n if n < 5 else 3 + n.bit_length()


def word_features(raw: str) -> tuple[list[str], list[str]]:
    """Features of a word as it is labelled, and as its neighbours see it."""
    a, b = core(raw)
    word = raw[a:b]
    if not word:
        return ["none"], ["none"]
    digits = _DIGITS.sub("", word)
    stop = raw[b : b + 1] or "-"
    seen = [f"s={shape(word)}", f"n={min(len(digits), 20)}", f"end={stop}"]
    if word.isalpha():
        first = "A" if word.isupper() else "Aa" if word[0].isupper() else "a"
        seen = [f"w={word.lower()}", f"cap={first}", f"end={stop}"]
        return ["b", "alpha", *seen, f"cap={first}|{size_class(len(word))}"], seen
    if (bare := word.strip("()")).isalpha():  # a word in brackets
        seen.append(f"w={bare.lower()}")
    mixed = bool(digits) and any(c.isalpha() for c in word)
    tests = [f"luhn={14 <= len(digits) <= 19 and luhn(digits)}", f"mail={_MAIL.fullmatch(word) is not None}", f"quad={valid('ip', word)}", f"v6={word.count(':') >= 2 and _V6.fullmatch(word) is not None}"]
    if mixed:
        tests += [f"mixed|{size_class(len(word))}", f"hex={_HEX.fullmatch(word) is not None}|{size_class(len(word))}"]
    return ["b", *seen, *tests, f"@={'@' in word}", f"+={word[0] == '+'}", f"(={word[0] == '('}", f"dots={min(word.count('.'), 4)}", f"dash={min(word.count('-'), 4)}", f"mixed={mixed}"], seen


#: What stands before the first and after the last word.
EDGE = ("^",)
#: A word's features count for itself and, under these marks, for the word after it, the one after that, the one before it and the one before that.
PLACES = ("", "-1|", "-2|", "+1|", "+2|")


def placed_features(raw: str) -> list[list[str]]:
    own, seen = (list(EDGE), list(EDGE)) if raw is EDGE else word_features(raw)
    # two words away only what the word is
    return [own if p == "" else [p + f for f in seen if p[1:2] != "2" or f[0] in "w^"] for p in PLACES]


# --- the field

K = len(LABELS)


class Field:
    """Emission and transition weights of a linear chain; unknown features weigh nothing."""

    def __init__(self, features: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.features, self.emit, self.step = features, emit, step  # step: from (the last row: start) to
        #: Words that features know.
        self.lexicon = frozenset(f.partition("w=")[2] for f in features if "w=" in f)
        self.gain = self._gain()

    def _gain(self) -> float:
        """The most that transitions alone can gain by any label but O at one word.

        A path a, y, b, c with y not O is compared with a, O, b', c, where b' begins a span if b goes on with one. Every transition of the
        second is allowed, so its transitions are at most this much worse. If a word's evidence for O beats that of every other label by
        more, and by more than the next word's evidence for going on rather than beginning, then no best path has another label there.
        """
        s, most = self.step, 0.0
        allowed = s > -1e3
        starts = [b if LABELS[b][0] != "I" else b - 1 for b in range(K)]
        goes_on = np.array([max(0.0, max(s[b, c] - s[starts[b], c] for c in range(K) if allowed[b, c])) if starts[b] != b else 0.0 for b in range(K)])
        for y in range(1, K):
            before = max(s[a, y] - s[a, 0] for a in range(K + 1) if allowed[a, y])
            after = max(s[y, b] - s[0, starts[b]] + goes_on[b] for b in range(K) if allowed[y, b])
            most = max(most, before + max(0.0, after))
        return float(most)

    def rows_of(self, raw: str) -> np.ndarray:
        """(places, labels): what a word adds to the scores of itself and of its neighbours."""
        get = self.features.get
        out = np.zeros((len(PLACES), K), np.float32)
        for i, own in enumerate(placed_features(raw)):
            known = [k for f in own if (k := get(f)) is not None]
            if known:
                out[i] = self.emit[known].sum(0)
        return out

    def decode(self, scores: list[np.ndarray], inside: tuple[list[bool], list[bool]] | None = None) -> list[list[int]]:
        """Viterbi over padded batches of sequences of like length, given by the scores (words, labels) of each.

        inside: whether a word that is O stands before and after a sequence; otherwise it is a whole text.
        """
        before, after = inside or ([False] * len(scores), [False] * len(scores))
        out: list[list[int]] = [[] for _ in scores]
        into = np.ascontiguousarray(self.step[:-1].T)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            size, longest = 1, len(scores[order[at]])
            while at + size < len(order) and len(scores[order[at + size]]) * (size + 1) <= max(200_000, longest):
                size += 1
            own = order[at : at + size]
            at += size
            lengths = np.array([len(scores[i]) for i in own])
            n, t = len(own), int(lengths[-1])
            s = np.zeros((n, t, K))
            for j, i in enumerate(own):
                s[j, : lengths[j]] = scores[i]
            best, back = self.step[np.where([before[i] for i in own], 0, K)] + s[:, 0], np.zeros((n, t, K), np.int8)
            for j in range(1, t):
                through = best[:, None, :] + into
                back[:, j] = last = through.argmax(2)
                best = np.where((j < lengths)[:, None], np.take_along_axis(through, last[:, :, None], 2)[:, :, 0] + s[:, j], best)
            label = (best + np.array([after[i] for i in own])[:, None] * self.step[:-1, 0]).argmax(1)
            path = np.zeros((n, t), int)
            for j in range(t - 1, -1, -1):
                path[:, j] = label
                label = np.where(j < lengths, back[np.arange(n), j, label], label) if j else label
            for i, p, length in zip(own, path, lengths, strict=True):
                out[i] = p[:length].tolist()
        return out


class Words(dict):
    """Numbers of words by what the field knows of them: words that it can't tell apart share a number."""

    #: Words and different rows that a worker holds; full tables are emptied between batches.
    MOST_WORDS, MOST_ROWS = 400_000, 100_000

    def __init__(self, field: Field):
        self.field, self.rows, self.known, self.alike = field, [], {}, {}
        self.edge = self._number(EDGE)

    def _number(self, raw) -> int:
        row = self.field.rows_of(raw)
        key = row.tobytes()
        if (n := self.known.get(key)) is None:
            self.known[key] = n = len(self.rows)
            self.rows.append(row)
        return n

    def __missing__(self, raw: str) -> int:
        a, b = core(raw)
        word = raw[a:b]
        if word.isalpha():  # what features it has follows from few things
            low = word.lower()
            key = (low if low in self.field.lexicon else "", word.isupper(), word[0].isupper(), size_class(b - a), raw[b : b + 1])
            if (n := self.alike.get(key)) is None:
                self.alike[key] = n = self._number(raw)
        else:
            n = self._number(raw)
        self[raw] = n
        return n

    def trim(self) -> None:
        if len(self) > self.MOST_WORDS or len(self.rows) > self.MOST_ROWS:
            self.clear()
            self.rows, self.known, self.alike = [], {}, {}
            self.edge = self._number(EDGE)


#: Words that are scored at once.
SLICE = 100_000


def decode_texts(field: Field, words: Words, texts: list[str]) -> list[list[tuple[int, int]]]:
    """(number of the word, label) of the words of each text that aren't O, in order."""
    words.trim()
    parts, starts, at = [], [], 0
    for t in texts:
        own = list(map(words.__getitem__, t.split()))
        starts.append(at + 2)
        parts.append(np.array([words.edge, words.edge, *own, words.edge, words.edge], np.int32))
        at += len(own) + 4
    ids = np.concatenate(parts)
    table = np.stack(words.rows, 1)  # (places, rows, labels)
    is_word = np.ones(len(ids), bool)
    for s in (*starts, len(ids) + 2):
        is_word[max(0, s - 4) : s] = False  # the edges after a text and before the next

    def scores(where: np.ndarray) -> np.ndarray:
        return table[0, ids[where]] + table[1, ids[where - 1]] + table[2, ids[where - 2]] + table[3, ids[where + 1]] + table[4, ids[where + 2]]

    begin = np.array([i for i, x in enumerate(LABELS) if x[0] == "B"])
    open_ = np.zeros(len(ids), bool)
    for low in range(2, len(ids) - 2, SLICE):
        where = np.arange(low, min(low + SLICE + 1, len(ids) - 2))  # and one more, for what the next word says
        e = scores(where)
        on = np.where(is_word[where], (e[:, begin + 1] - e[:, begin]).max(1), 0)
        sure = e[:, 0] - e[:, 1:].max(1) > field.gain + np.append(np.maximum(on[1:], 0), 0) + 1e-4
        last = len(where) if where[-1] == len(ids) - 3 else len(where) - 1
        open_[where[:last]] = ~sure[:last]
    open_ &= is_word
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    own = np.flatnonzero(open_)
    if not len(own):
        return found
    cut = np.flatnonzero(np.append(True, np.diff(own) > 1))
    runs = [(int(own[a]), int(own[b - 1]) + 1) for a, b in zip(cut, np.append(cut[1:], len(own)), strict=True)]
    every = scores(own)
    ends = np.append(cut[1:], len(own))
    paths = field.decode([every[a:b] for a, b in zip(cut, ends, strict=True)], ([bool(is_word[a - 1]) for a, _ in runs], [bool(is_word[b]) for _, b in runs]))
    for (a, _), path in zip(runs, paths, strict=True):
        if any(path):
            i = bisect_right(starts, a) - 1
            found[i] += [(a - starts[i] + j, y) for j, y in enumerate(path) if y]
    return found


def forbidden() -> np.ndarray:
    """-1e4 where a label can't follow another: I only after B or I of its kind. The last row is the start."""
    step = np.zeros((K + 1, K))
    for b, to in enumerate(LABELS):
        if to[0] == "I":
            for a in range(K + 1):
                if a == K or LABELS[a][2:] != to[2:] or LABELS[a] == "O":
                    step[a, b] = -1e4
    return step


def train(table: list[tuple[list[list[str]], list[int]]], rounds: int = 80, rate: float = 0.5, decay: float = 3e-4) -> Field:
    """Fits a field to sequences of word features and their labels: AdaGrad on the mean log-likelihood, less decay/2 |w|^2."""
    features = {f: i for i, f in enumerate(sorted({f for s, _ in table for w in s for f in w}))}
    n, t = len(table), max(len(s) for s, _ in table)
    lengths = np.array([len(s) for s, _ in table])
    gold = np.zeros((n, t), int)
    rows, ids = [], []
    for i, (s, y) in enumerate(table):
        gold[i, : len(y)] = y
        for j, w in enumerate(s):
            rows += [i * t + j] * len(w)
            ids += [features[f] for f in w]
    rows, ids = np.array(rows), np.array(ids)
    # sums by word and by feature are over neighbouring entries
    words, word_at = np.unique(rows, return_index=True)
    by_feature = np.argsort(ids, kind="stable")
    own, feature_at = np.unique(ids[by_feature], return_index=True)
    live = np.arange(t)[None] < lengths[:, None]
    block = forbidden()
    emit, step = np.zeros((len(features), K)), np.zeros((K + 1, K))
    seen_e, seen_s = np.full_like(emit, 1e-6), np.full_like(step, 1e-6)
    one = np.eye(K)

    for _ in range(rounds):
        s = np.zeros((n * t, K))
        s[words] = np.add.reduceat(emit[ids], word_at)
        s = s.reshape(n, t, K)
        w, e = np.exp(step + block), np.exp(s - s.max(2, keepdims=True))
        # forward and backward, each place scaled to sum to one
        alpha, beta, scale = np.zeros((n, t, K)), np.ones((n, t, K)), np.ones((n, t))
        alpha[:, 0] = w[-1] * e[:, 0]
        for j in range(t):
            if j:
                alpha[:, j] = np.where(live[:, j, None], (alpha[:, j - 1] @ w[:-1]) * e[:, j], alpha[:, j - 1])
            scale[:, j] = alpha[:, j].sum(1)
            alpha[:, j] /= scale[:, j, None]
        for j in range(t - 2, -1, -1):
            beta[:, j] = np.where(live[:, j + 1, None], (e[:, j + 1] * beta[:, j + 1] / scale[:, j + 1, None]) @ w[:-1].T, beta[:, j + 1])
        p = alpha * beta * live[..., None]
        ge = np.zeros_like(emit)
        ge[own] = np.add.reduceat(((one[gold] * live[..., None] - p).reshape(n * t, K))[rows[by_feature]], feature_at)
        gs = np.zeros_like(step)
        gs[-1] = (one[gold[:, 0]] - p[:, 0]).sum(0)
        for j in range(1, t):
            into = e[:, j] * beta[:, j] / scale[:, j, None] * live[:, j, None]
            gs[:-1] += one[gold[:, j - 1]].T @ (one[gold[:, j]] * live[:, j, None]) - (alpha[:, j - 1].T @ into) * w[:-1]
        ge, gs = ge / n - decay * emit, gs / n - decay * step
        seen_e += ge**2
        seen_s += gs**2
        emit += rate * ge / np.sqrt(seen_e)
        step += rate * gs / np.sqrt(seen_s)
    return Field(features, emit, step + block)


# --- the labelled table

#: Ordinary words that the made sentences are filled with, besides made-up ones.
FILL = "the of and to in is was for on that with as at by from it this have not are but which you all were when we there an they one about into over under after before some more than only other new first time people way day house river stone water letter page story market winter journey question answer".split()
#: Sentences by kind; {} is the value. Those of "none" hold what looks alike but isn't personal data.
FRAMES = {
    "email": ["write to {} soon", "{} wrote", "e-mail: {}.", "reach me at {} or", "my address is {}", "contact {} for more", "send it to {}", "email {} today", "mail {}"],
    "ip": ["from {} today", "host {}", "{} answered", "the server at {} is", "address {}.", "ip {}", "logged in from {}"],
    "card": ["card {} was charged", "paid with {}.", "card number {}", "visa {} on file", "{} was declined", "charge {} please"],
    "phone": ["call {} now", "phone: {}", "tel {}.", "{} or later", "ring {} after", "my number is {}", "mobile {}", "fax {}", "text me on {}", "the {} of"],
    "secret": ["token = {}", "api_key: {}", "the password is {}", "secret = {} #", "key = {}", "bearer {}", "use the token {} for", "export KEY = {}", "access_token {}"],
    "name": ["my name is {}", "signed, {}", "Mr. {} said", "Dr. {} and", "Mrs. {} was", "Ms. {} wrote", "contact: {}", "regards, {}", "dear {},", "called {} by", "i am {}", "patient {} was", "customer name: {}", "author: {}"],
    "none": ["in {} there", "about {} of them", "number {}.", "{}", "the {} and", "version {} of", "on {} or", "commit {} fixed", "page {}", "a {} was", "as {},", "order {} is", "isbn {}"],
}


def labelled_table(seed: int = 11, copies: int = 10, frames: dict[str, list[str]] = FRAMES) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with their spans (start, end, kind), made from a seed: personal data of the six kinds, and values that aren't."""
    rng = random.Random(seed)
    pick, d = rng.choice, lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda low, high: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))
    filler = lambda: pick(FILL) if rng.random() < 0.5 else letters(1, 12)
    word = lambda: letters(2, 9)
    proper = lambda: letters(3, 9).capitalize()
    ok = lambda n: next(x for x in iter(lambda: pick("3456") + d(n - 1), None) if luhn(x))
    off = lambda n: next(x for x in iter(lambda: pick("0123456789") + d(n - 1), None) if not luhn(x))
    four = lambda x, s: s.join(x[i : i + 4] for i in range(0, len(x), 4))
    octet = lambda: str(rng.randint(0, 255))
    chars = lambda pool, low, high: "".join(pick(pool) for _ in range(rng.randint(low, high)))
    hexes, code = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    generated = lambda pool, low, high: next(x for x in iter(lambda: chars(pool, low, high), None) if any(c.isdigit() for c in x) and any(c.isalpha() for c in x))
    top = lambda: pick("com org net io de".split())
    make = {
        "email": [lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()}{d(2)}@{word()}.{word()}.org", lambda: f"{word()}.{d(2)}@mail{d(1)}.{word()}.com", lambda: f"{word()} at {word()} dot {top()}", lambda: f"{word()}.{word()} at {word()} dot {top()}", lambda: f"{word()} (at) {word()} (dot) {top()}", lambda: f"{word()}.{word()} [at] {word()}.{top()}", lambda: f"{word()} @ {word()}.{top()}", lambda: f"{word()}{d(2)} [at] {word()} [dot] {top()}"],
        "ip": [lambda: ".".join(octet() for _ in range(4)), lambda: " . ".join(octet() for _ in range(4)), lambda: " dot ".join(octet() for _ in range(4)), lambda: "[.]".join(octet() for _ in range(4)), lambda: "fe80::" + ":".join(chars(hexes, 1, 4) for _ in range(rng.randint(1, 4))), lambda: ":".join(chars(hexes, 1, 4) for _ in range(8))],
        "card": [lambda: ok(16), lambda: four(ok(16), " "), lambda: four(ok(16), "-"), lambda: ok(15), lambda: four(ok(16), "."), lambda: four(ok(16), " - "), lambda: four(ok(16), "/")],
        "phone": [lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(2)} {d(2)} {d(4)} {d(4)}", lambda: f"+{d(11)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"00{d(2)} {d(2)} {d(4)} {d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}"],
        "secret": [lambda: f'"{generated(hexes, 32, 48)}"', lambda: f"'{generated(code, 20, 48)}'", lambda: generated(code, 16, 40), lambda: generated(hexes, 24, 64), lambda: f'"{generated(hexes, 40, 40).upper()}"'],
        "name": [lambda: f"{proper()} {proper()}", lambda: f"{proper()} {pick('ABCDEFGH')}. {proper()}", lambda: f"{proper()} {proper()} {proper()}", lambda: f"{proper()}-{proper()} {proper()}"],
        "none": [
            lambda: off(16), lambda: off(16), lambda: four(off(16), " "), lambda: f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", lambda: f"19{d(2)}", lambda: d(rng.randint(1, 9)), lambda: f"{d(1)},{d(3)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"{d(3)}.{d(2)}", lambda: f"{rng.randint(300, 999)}.{d(2)}.{d(2)}.{d(2)}",
            lambda: f"1{d(1)}:{d(2)}", lambda: f"1{d(1)}:{d(2)}:{d(2)}", lambda: generated(hexes, 40, 40), lambda: generated(hexes, 8, 12), lambda: f"@{word()}", lambda: f"{word()}{d(2)}", lambda: f"{d(2)}%", lambda: f"${d(3)}", lambda: f"{d(3)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(3)} {d(3)} {d(2)}",
            lambda: f"{d(1)}-{d(1)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{word()}::{word()}", lambda: f"{word()}/{word()}-{d(1)}.{d(1)}", lambda: f"{proper()} License, Version {d(1)}.{d(1)}.", lambda: f"{proper()} {proper()}", lambda: proper(), lambda: f"at {word()} dot", lambda: f"look at {word()}", lambda: f"a dot {word()}",
            lambda: f"{proper()} and {proper()}", lambda: f"| {word()} | {d(3)} |", lambda: f"{word()}-{word()}", lambda: f"({word()})", lambda: f"{d(4)} {d(4)}", lambda: f"the token of {word()}", lambda: f"a key {word()}", lambda: f"password {word()}", lambda: f"name {word()}",
        ],
    }
    out = []
    for kind, makers in make.items():
        for maker in makers:
            for _ in range(copies * {"name": 4, "email": 4}.get(kind, 1)):  # their words are like any other, so it takes more of them
                value, (lead, tail) = maker(), pick(frames[kind]).split("{}")
                # what stands around is often left out, so that no value needs its frame, but secrets and names need what calls them so
                frame = f"{'' if kind not in ('secret', 'name') and rng.random() < 0.4 else lead}{{}}{'' if rng.random() < 0.6 else tail}"
                sentence = f"{' '.join(filler() for _ in range(rng.randint(0, 4)))} {frame} {' '.join(filler() for _ in range(rng.randint(0, 3)))}".strip()
                if rng.random() < 0.3:
                    sentence = sentence[0].upper() + sentence[1:]
                before, after = sentence.split("{}")
                shout = kind != "name" and rng.random() < 0.05  # a text in capitals, with marks after its words
                if shout:
                    before, value, after = before.upper(), value.upper(), after.upper()
                a, b = (len(before) + x for x in (len(value) - len(value.lstrip("\"'")), len(value.rstrip("\"'"))))
                out.append((before + value + after, [(a, b, kind)] if kind != "none" else []))
    for _ in range(12 * copies):  # short sentences and headings, which put capitals side by side
        text = " ".join(" ".join([proper() if rng.random() < 0.7 else filler().capitalize(), *(filler() for _ in range(rng.choice((0, 0, 0, 1, 2))))]) + pick((".", ".", ".", "", ",", "!!", ".###")) for _ in range(rng.randint(2, 6)))
        out.append((text, []))
        word_again = pick((proper(), filler().capitalize(), filler()))
        out.append((" ".join([word_again + pick(("", "."))] * rng.randint(2, 8)), []))
    for _ in range(20 * copies):  # sentences of ordinary words, some in capitals or with a capital in each
        change = pick((str, str, str, str.upper, str.title))
        text = change(" ".join(filler() + pick(("", "", "", "", ",", ".", ";", "!!")) for _ in range(rng.randint(3, 14))))
        out.append((text[0].upper() + text[1:], []))
    return out


def labels_of(text: str, spans: list[tuple[int, int, str]]) -> list[int]:
    out, last = [], None
    for m in _WORD.finditer(text):
        hit = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
        out.append(0 if hit is None else LABELS.index(f"{'I' if hit is last else 'B'}-{hit[2]}"))
        last = hit
    return out


def features_of(text: str) -> list[list[str]]:
    """Features of each word of a text, of its neighbours included."""
    words = [EDGE, EDGE, *text.split(), EDGE, EDGE]
    each = [placed_features(w) for w in words]
    return [[*each[i][0], *each[i - 1][1], *each[i - 2][2], *each[i + 1][3], *each[i + 2][4]] for i in range(2, len(words) - 2)]


def sequences_of(table: list[tuple[str, list[tuple[int, int, str]]]]) -> list[tuple[list[list[str]], list[int]]]:
    return [(features_of(text), labels_of(text, spans)) for text, spans in table]


@lru_cache(maxsize=2)
def built_in_field() -> Field:
    """The field fitted to labelled_table(); some seconds of work, once in a process."""
    return train(sequences_of(labelled_table()))


# --- spans

_WORD = re.compile(r"\S+")
_AT = r"\s*(?:@|[\[({<]\s*(?:at|@)\s*[\])}>]|\bat\b)\s*"
_DOT = r"\s*(?:\.|[\[({<]\s*(?:dot|\.)\s*[\])}>]|\bdot\b)\s*"
_SPELLED_MAIL = re.compile(rf"[\w.+%-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_SPELLED_QUAD = re.compile(rf"[0-9]+(?:{_DOT}[0-9]+){{3}}", re.I)


def holds(kind: str, value: str) -> bool:
    """Whether a span that was decoded passes the test of its kind."""
    if kind == "email":
        return _SPELLED_MAIL.fullmatch(value) is not None
    if kind == "ip":
        if ":" in value:
            try:
                return ipaddress.ip_address(value).version == 6
            except ValueError:
                return False
        return _SPELLED_QUAD.fullmatch(value) is not None and valid("ip", ".".join(re.findall("[0-9]+", value)))
    if kind == "secret":
        return len(value) >= 16 and not _SPACE.search(value) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    if kind == "name":
        parts = value.split()
        # a stop ends a name, unless it is behind an initial
        return len(parts) <= 5 and "\n" not in value and len(set(parts)) == len(parts) and all(w[0].isupper() and w.replace("-", "").replace("'", "").isalpha() for w in (p.removesuffix(".") if len(p) == 2 else p for p in parts))
    return valid(kind, value) and (kind == "card" or not any(c.isalpha() for c in value))


def trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """A span without stops, quotes and lone brackets around it."""
    a, b = core(text[start:end])
    start, end = start + a, start + b
    if kind != "phone" or ")" not in text[start:end]:
        own = text[start:end]
        start, end = start + len(own) - len(own.lstrip("(")), end
        if "(" not in text[start:end]:
            end = start + len(text[start:end].rstrip(")"))
    return start, end


def added_spans(field: Field, texts: list[str], base: list[list[tuple[int, int, int]]], words: Words | None = None) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of the field in each text that touch none of its base spans, which are in order."""
    out: list[list[tuple[int, int, int]]] = []
    for text, found, known in zip(texts, decode_texts(field, Words(field) if words is None else words, texts), base, strict=True):
        own: list[tuple[int, int, int]] = []
        out.append(own)
        if not found:
            continue
        at = dict.fromkeys(i for i, _ in found)
        for i, m in enumerate(_WORD.finditer(text)):
            if i in at:
                at[i] = m.span()
        ends, reach = [a for a, _, _ in known], list(accumulate((b for _, _, b in known), max))
        j = 0
        while j < len(found):
            kind, k = (found[j][1] - 1) // 2, j + 1
            while k < len(found) and found[k] == (found[k - 1][0] + 1, 2 * kind + 2):
                k += 1
            start, end = trimmed(text, at[found[j][0]][0], at[found[k - 1][0]][1], EVERY[kind])
            near = bisect_left(ends, end)
            if start < end and (not near or reach[near - 1] <= start) and holds(EVERY[kind], text[start:end]):
                own.append((start, kind, end))
            j = k
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{EVERY[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_personal_data(docs: DataFrame, field: Field | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all), n_added (of the field), n_spans. No shuffle.

    field: a fitted field; by default one fitted here to labelled_table(), some thousand made sentences. It is sent with the tasks.
    """
    field = field or built_in_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(field)
        for b in batches:
            texts = list(texts_of(b.column(1)))
            base = [base_spans(t) for t in texts]
            more = added_spans(field, texts, base, words)
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
            own = [pa.array([hashlib.sha256(render(x).encode()).hexdigest() for x in base], pa.string()), pa.array([render(x + y) for x, y in zip(base, more, strict=True)], pa.string())]
            totals = [pa.array([len(y) for y in more], pa.int64()), pa.array([len(x) + len(y) for x, y in zip(base, more, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *own, *totals], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    kind = docs.select(id_col).dtypes[0][1]
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(own, run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long, n_spans long")
