"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, leftmost and without overlap for each
kind. The network adds spans that the patterns miss. It is trained in NumPy on labelled spans: windows of the
documents with the patterns' spans as labels (a documented bounded sample), the same windows with spans rewritten in
forms that the patterns don't know (phone numbers in groups without ``+``, a card number with dots, ``[at]``) and other letters and digits, where the label is known
from the rewriting, and windows with harmless numbers (years, dates, versions, amounts). Two LSTMs read a window in both directions; a linear layer gives scores of the nine tags (outside, and begin
and inside of each kind); the CRF's transitions are learnt with them.

A text is decoded in windows of ``WIDTH`` characters that overlap by half. Whatever ``plausible`` accepts holds a digit or one of
``@``, ``[at]`` and ``(at)``, so windows are skipped that hold none of these and no part of an address around such a sign; no other is. Windows are reconciled for the whole text: the scores of a character are the mean of
all windows that hold it, weighted towards their middles, and Viterbi decodes each run of touching windows once, whatever its length,
so transitions hold across the windows' seams. Tags become spans; those that touch a pattern's span, or that don't look like
their kind (``plausible``), are dropped; the patterns' spans always stay.

Defined results: null counts as empty; a text without spans gives counts of 0 and empty digests of an empty string; a null
id stays null; of spans of a kind none overlap, so no ties arise; a very long text is held by one task, its time is in proportion to its
length; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the four kinds; a look-behind keeps the search from restarting inside a run of digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HINT = re.compile(r"[0-9@]")
#: What every added span holds, too: of an e-mail address the sign, of the other kinds digits.
_SIGN = re.compile(r"[0-9]+|@|\[at\]|\(at\)")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")
#: Characters that a plausible span of any kind may hold.
_SPANNED = _LOCAL | frozenset("@[]() ")
#: Steps times runs that are decoded together.
VITERBI = 1 << 16

WIDTH, SAMPLE, WINDOWS = 64, 8000, 2500
HIDDEN, EMBED, EPOCHS, BATCH, RATE = 16, 10, 20, 32, 0.02
TAGS = 1 + 2 * len(KINDS)
Span = tuple[str, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the longest run of local characters before it, in time linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))
        if not found and at >= 0:
            done = max(done, text.rfind("@", 0, at) + 1)


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and start."""
    if not _HINT.search(text):
        return []
    out: list[Span] = [("email", a, e) for a, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        number = digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(number) <= 19 and luhn(number):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: The network's alphabet: digits alike, letters by case, punctuation as it is.
_CLASSES = {c: k for k, c in enumerate("@.+-() _%[]:;,/#$&*!|\n\"'", 4)}
ALPHABET = 4 + len(_CLASSES)


def encode(text: str) -> np.ndarray:
    """0 other, 1 digit, 2 lower-case or other letter, 3 upper-case letter, then punctuation."""
    out = np.zeros(len(text), np.int64)
    for k, c in enumerate(text):
        out[k] = 1 if "0" <= c <= "9" else 3 if "A" <= c <= "Z" else _CLASSES.get(c, 2 if c.isalpha() else 0)
    return out


def tags_of(n: int, spans: Iterable[Span]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, e in spans:
        k = KINDS.index(kind)
        out[max(a, 0) : max(e, 0)] = 2 + 2 * k
        if 0 <= a < n:
            out[a] = 1 + 2 * k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions; float32 throughout."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def fresh(cls, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"embed": draw(ALPHABET, EMBED), "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            p |= {f"{d}x": draw(EMBED, 4 * HIDDEN), f"{d}h": draw(HIDDEN, 4 * HIDDEN), f"{d}b": np.zeros(4 * HIDDEN, np.float32)}
            p[f"{d}b"][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        return cls(p)

    def _lstm(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: (time, batch, EMBED). States of all times; with ``keep`` what the backward pass needs."""
        n, b, _ = x.shape
        h = c = np.zeros((b, HIDDEN), np.float32)
        out, tape = np.empty((n, b, HIDDEN), np.float32), []
        given = x @ self.p[f"{d}x"] + self.p[f"{d}b"]
        for t in range(n):
            z = given[t] + h @ self.p[f"{d}h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            s = np.tanh(new)
            if keep:
                tape.append((h, c, i, f, o, g, s))
            h, c = o * s, new
            out[t] = h
        return out, tape

    def _lstm_back(self, d: str, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict[str, np.ndarray]) -> np.ndarray:
        n, b, _ = x.shape
        dh = dc = np.zeros((b, HIDDEN), np.float32)
        dz = np.empty((n, b, 4 * HIDDEN), np.float32)
        for t in range(n - 1, -1, -1):
            h, c, i, f, o, g, s = tape[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - s * s)
            dz[t, :, :HIDDEN] = dc * g * i * (1 - i)
            dz[t, :, HIDDEN : 2 * HIDDEN] = dc * c * f * (1 - f)
            dz[t, :, 2 * HIDDEN : 3 * HIDDEN] = dh * s * o * (1 - o)
            dz[t, :, 3 * HIDDEN :] = dc * i * (1 - g * g)
            grad[f"{d}h"] += h.T @ dz[t]
            dc = dc * f
            dh = dz[t] @ self.p[f"{d}h"].T
        flat = dz.reshape(-1, 4 * HIDDEN)
        grad[f"{d}x"] += x.reshape(-1, EMBED).T @ flat
        grad[f"{d}b"] += flat.sum(0)
        return dz @ self.p[f"{d}x"].T

    def scores(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """codes: (batch, time). Tag scores (time, batch, TAGS)."""
        x = self.p["embed"][codes.T]
        forward, ft = self._lstm("f", x, keep)
        backward, bt = self._lstm("b", x[::-1], keep)
        states = np.concatenate([forward, backward[::-1]], axis=2)
        return states @ self.p["out"] + self.p["bias"], (x, states, ft, bt)

    def loss_grad(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the tags under the CRF, for each window, and its gradient."""
        s, (x, states, ft, bt) = self.scores(codes, keep=True)
        n, b, _ = s.shape
        step, y = self.p["step"], tags.T
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = s[0]

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis, keepdims=True)
            return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

        for t in range(1, n):
            alpha[t] = s[t] + lse(alpha[t - 1][:, :, None] + step, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = lse(step + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        batch = np.arange(b)
        gold = sum(s[t, batch, y[t]] for t in range(n)) + sum(step[y[t - 1], y[t]] for t in range(1, n))
        ds = np.exp(alpha + beta - total[:, None])
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, n):
            both = np.exp(alpha[t - 1][:, :, None] + step + (s[t] + beta[t])[:, None, :] - total[:, None, None])
            grad["step"] += both.sum(0)
            np.subtract.at(grad["step"], (y[t - 1], y[t]), 1)
        ds[np.arange(n)[:, None], batch, y] -= 1
        ds /= b
        grad["step"] /= b
        flat = ds.reshape(-1, TAGS)
        grad["out"] += states.reshape(-1, 2 * HIDDEN).T @ flat
        grad["bias"] += flat.sum(0)
        dstates = ds @ self.p["out"].T
        dx = self._lstm_back("f", x, ft, dstates[:, :, :HIDDEN], grad) + self._lstm_back("b", x[::-1], bt, dstates[::-1, :, HIDDEN:], grad)[::-1]
        np.add.at(grad["embed"], codes.T.ravel(), dx.reshape(-1, EMBED))
        return float((total - gold).mean()), grad

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi tags of runs of tag scores (length, TAGS) of any lengths; runs of about the same length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
        order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(runs[order[hi]]) <= VITERBI:
                hi += 1
            some = order[lo:hi]
            lo = hi
            n = len(runs[some[-1]])
            if not n:
                continue
            sizes = np.array([len(runs[k]) for k in some])
            s = np.zeros((n, len(some), TAGS), np.float32)
            for j, k in enumerate(some):
                s[: sizes[j], j] = runs[k]
            back, batch, last = np.empty((n, len(some), TAGS), np.int8), np.arange(len(some)), np.zeros(len(some), np.int64)
            best = s[0]
            last[sizes == 1] = best[sizes == 1].argmax(1)
            for t in range(1, n):
                all_ = best[:, :, None] + self.p["step"]
                back[t] = all_.argmax(1)
                best = all_.max(1) + s[t]
                ends = sizes == t + 1
                if ends.any():
                    last[ends] = best[ends].argmax(1)
            tags = np.empty((n, len(some)), np.int8)
            now = last
            for t in range(n - 1, -1, -1):
                now = np.where(sizes == t + 1, last, now)
                tags[t] = now
                if t:
                    now = back[t, batch, now].astype(np.int64)
            for j, k in enumerate(some):
                out[k] = tags[: sizes[j], j].astype(np.int64)
        return out


def train(windows: list[tuple[str, list[Span]]], seed: int = 11) -> Tagger:
    """A tagger from windows of at most WIDTH characters with their spans, by Adam."""
    codes = np.zeros((len(windows), WIDTH), np.int64)
    tags = np.zeros((len(windows), WIDTH), np.int64)
    for k, (text, spans) in enumerate(windows):
        codes[k, : len(text)] = encode(text)
        tags[k, : len(text)] = tags_of(len(text), spans)
    net, rng = Tagger.fresh(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    steps, total = 0, EPOCHS * -(-len(windows) // BATCH)
    for _ in range(EPOCHS if windows else 0):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            _, grad = net.loss_grad(codes[some], tags[some])
            steps += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - steps / (total + 1))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
    return net


def grouped(number: str, rng: random.Random) -> str:
    """A number in groups of two to four digits with one separator, perhaps with a country's code, or its first group in brackets."""
    groups, at = [], 0
    while at < len(number):
        left = len(number) - at
        n = left if left <= 4 else rng.choice([k for k in (2, 3, 4) if left - k >= 2])
        groups.append(number[at : at + n])
        at += n
    mark = rng.choice(" -. ")
    if rng.random() < 0.3 and len(number) > 9:
        groups = [groups[0][:1], *groups] if rng.random() < 0.5 else [number[:1] + str(rng.randrange(10)), *groups]
        groups = groups if sum(map(len, groups)) <= 15 else groups[1:]
    if rng.random() < 0.25 and len(groups) > 2:
        groups[0] = f"({groups[0]})"
    return mark.join(groups)


def varied(text: str, rng: random.Random) -> str:
    """The same form with other letters and digits, so that forms are learnt and not names; long runs of letters change their length, too."""
    out = []
    for run in re.findall(r"\[at\]|\(at\)|[a-z]+|[A-Z]+|[0-9]+|.", text, re.S):
        if run[0].isdigit():
            out.append("".join(rng.choice("0123456789") for _ in run))
        elif run[0].isalpha() and run.isascii():
            n = max(2, len(run) + rng.randrange(-2, 3)) if len(run) > 3 else len(run)
            letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
            out.append(letters if run[0].islower() else letters.upper())
        else:
            out.append(run)
    return "".join(out)


def address(sign: str, rng: random.Random) -> str:
    """An e-mail address of any common make around a sign."""
    word = lambda lo=2, hi=10: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(lo, hi)))
    number = str(rng.randrange(1, 2000))
    local = rng.choice([word(), word() + number, f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}-{word()}", f"{word(1, 2)}.{word()}", f"{word()}.{word()}{number}", f"{word()}+{word()}"])
    host = rng.choice([word(), word(), f"{word()}.{word()}", f"{word()}-{word()}", word() + str(rng.randrange(10))])
    out = f"{local}{sign}{host}.{word(2, 4)}"
    return out.title() if rng.random() < 0.1 else out


def rewritten(kind: str, text: str, turn: int) -> str:
    """A span in a form that its pattern doesn't know."""
    rng = random.Random(turn)
    if kind == "phone":
        d = digits(text)
        return [text.lstrip("+"), d[-10:-7] + "-" + d[-7:-4] + "-" + d[-4:], "(" + d[-10:-7] + ") " + d[-7:-4] + "-" + d[-4:], grouped(d[-rng.randrange(8, 13) :], rng), grouped(d[-10:], rng)][turn % 5]
    if kind == "card":
        d = digits(text)
        return ".".join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "email":
        sign = ["[at]", " [at] ", " @ ", "(at)", " (at) "][turn % 5]
        return address(sign, rng) if rng.random() < 0.7 else text.replace("@", sign)
    return text.replace(".", ["[.]", " . ", ". "][turn % 3])


def harmless(rng: random.Random) -> str:
    """Numbers that are no one's: years, dates, times, versions, amounts, ranges, counts."""
    year, two = lambda: str(rng.randrange(1900, 2040)), lambda lo, hi: f"{rng.randrange(lo, hi):02}"
    return rng.choice([
        f"{year()} {year()} {year()}", f"{year()} - {year()}", f"{year()}-{two(1, 13)}-{two(1, 29)} {two(0, 24)}:{two(0, 60)}", f"{two(1, 29)}.{two(1, 13)}.{year()}", f"{two(0, 24)}:{two(0, 60)}:{two(0, 60)}",
        f"{rng.randrange(1, 20)}.{rng.randrange(30)}.{rng.randrange(30)}", f"{rng.randrange(1, 999)},{rng.randrange(1000):03}.{two(0, 100)}", f"{rng.randrange(400)}-{rng.randrange(400)}", str(rng.randrange(10**8)), f"{rng.randrange(100)} of {rng.randrange(1000)}",
    ])


def training_windows(text: str, seed: int) -> list[tuple[str, list[Span]]]:
    """Labelled windows of a text: around each span, the same with the span rewritten, and around other digits."""
    spans = base_spans(text)
    out = []
    for turn, (kind, a, e) in enumerate(spans):
        lead = (seed + 7 * turn) % 24
        rng = random.Random(1009 * turn + seed)
        forms = [varied(rewritten(kind, text[a:e], seed + turn + k), rng) for k in range(4)]
        for body in (text[a:e], *forms):
            left = text[max(0, a - lead) : a]
            if _HINT.search(left) or len(left) + len(body) > WIDTH:
                left = ""
            right = text[e : e + WIDTH]
            hint = _HINT.search(right)
            right = right[: hint.start()] if hint else right
            window = (left + body + right)[:WIDTH]
            if len(body) <= WIDTH:
                out.append((window, [(kind, len(left), len(left) + len(body))]))
    taken = tags_of(len(text), spans)
    for m in re.finditer(r"[0-9]+", text):
        lo = max(0, m.start() - (seed + m.start()) % 30)
        window = text[lo : lo + WIDTH]
        if not taken[lo : lo + WIDTH].any():
            out.append((window, []))
            rng = random.Random(1009 * lo + seed)
            cut = rng.randrange(len(window) // 2 + 1)
            out.append(((window[:cut] + " " + harmless(rng) + " " + window[cut:])[:WIDTH], []))
    return out


def plausible(kind: str, text: str) -> bool:
    """Does an added span look like its kind? It must, whatever the network says."""
    d = digits(text)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text))
    if kind == "ip":
        parts = re.split(r"\[\.\]| ?\. ?", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9]+(?:[ .-]?[0-9]+)*", text))
    if re.fullmatch(r"(?:19|20)[0-9]{2}(?:[ .-](?:(?:19|20)[0-9]{2}|[0-9]{2}))*", text):  # years, dates
        return False
    return 8 <= len(d) <= 15 and bool(re.fullmatch(r"\+?(?:[0-9]{1,3}[ .-])?(?:\([0-9]{1,5}\) ?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,5}", text))


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold digits, or a part of what may be an address: a sign for ``@`` with the characters on both sides."""
    half = WIDTH // 2
    last = max(0, -(-(len(text) - WIDTH) // half))
    found: set[int] = set()
    done = 0  # addresses are followed from here on, so each character is seen once from either side
    for m in _SIGN.finditer(text):
        start, end = m.span()
        if m[0][0] in "@[(":
            start -= start > done and text[start - 1] == " "
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            end += text[end : end + 1] == " "
            while end < len(text) and text[end] in _HOST:
                end += 1
            done = m.end()
        found.update(range(max((start - WIDTH) // half + 1, 0), min(last, (end - 1) // half) + 1))
    return [k * half for k in sorted(found)]


#: How much a window's place counts for a character in it: most in its middle, where both sides are known.
_CENTRAL = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)


def pooled(text: str, starts: list[int], scores: Iterable[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(begin, tag scores of the characters from there) of each run of windows that touch, from blocks of the windows' scores (windows, WIDTH, TAGS).

    A character in several windows takes their mean, weighted by ``_CENTRAL``. Characters that no span may hold are outside.
    """
    blocks, block, at = iter(scores), np.zeros((0, WIDTH, TAGS), np.float32), 0
    out: list[tuple[int, np.ndarray]] = []
    k = 0
    while k < len(starts):
        j = k + 1
        while j < len(starts) and starts[j] < starts[j - 1] + WIDTH:
            j += 1
        begin, end = starts[k], min(len(text), starts[j - 1] + WIDTH)
        total, weight = np.zeros((end - begin, TAGS), np.float32), np.zeros(end - begin, np.float32)
        for s in starts[k:j]:
            if at == len(block):
                block, at = next(blocks), 0
            m = min(WIDTH, len(text) - s)
            total[s - begin : s - begin + m] += block[at, :m] * _CENTRAL[:m, None]
            weight[s - begin : s - begin + m] += _CENTRAL[:m]
            at += 1
        total /= weight[:, None]
        barred = np.array([c not in _SPANNED for c in text[begin:end]], bool)
        total[barred, 1:] = -1e4
        out.append((begin, total))
        k = j
    return out


def spans_of_tags(begin: int, tags: np.ndarray) -> list[Span]:
    """Spans of a run's tags: a begin tag, or an inside tag of another kind, starts one."""
    out: list[Span] = []
    kind, first, last = -1, 0, -2
    for p in np.flatnonzero(tags).tolist():
        tag = int(tags[p])
        if kind >= 0 and (p != last + 1 or tag % 2 == 1 or kind != (tag - 1) // 2):
            out.append((KINDS[kind], begin + first, begin + last + 1))
            kind = -1
        if kind < 0:
            kind, first = (tag - 1) // 2, p
        last = p
    if kind >= 0:
        out.append((KINDS[kind], begin + first, begin + last + 1))
    return out


def reconcile(net: Tagger, texts: list[tuple[str, list[int]]], scores: Iterable[np.ndarray]) -> list[list[Span]]:
    """Spans of whole texts (each with its windows' starts): one decoding of each run of windows, over scores pooled from all of them."""

    def blocks(n: int) -> Iterator[np.ndarray]:
        nonlocal rest
        while n:
            if not len(rest):
                rest = next(source)
            some, rest = rest[:n], rest[n:]  # before the yield: the last block's taker doesn't come back
            n -= len(some)
            yield some

    source, rest = iter(scores), np.zeros((0, WIDTH, TAGS), np.float32)
    runs = [pooled(text, starts, blocks(len(starts))) for text, starts in texts]
    tags = iter(net.decode([r for some in runs for _, r in some]))
    return [[span for begin, _ in some for span in spans_of_tags(begin, next(tags))] for some in runs]


def all_spans(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """Base spans and the plausible found ones (ascending, apart) that touch none of them."""
    ordered = sorted((a, e) for _, a, e in base)
    begins = [a for a, _ in ordered]
    furthest = list(itertools.accumulate((e for _, e in ordered), max))
    out = list(base)
    for kind, a, e in found:
        while a < e and text[a] in " .,;:\n":
            a += 1
        while e > a and text[e - 1] in " .,;:\n":
            e -= 1
        before = bisect.bisect_left(begins, e)  # base spans that begin before the end
        if (not before or furthest[before - 1] <= a) and plausible(kind, text[a:e]):
            # not a part of a longer run of letters, digits or marks that join them
            if (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in "+@._%-=/")) and (e == len(text) or not (text[e].isalnum() or text[e] in "@_=-/")):
                out.append((kind, a, e))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, windows: int = WINDOWS) -> Tagger:
    """A tagger from the ``sample`` documents with the smallest md5 of their id: at most ``windows`` windows, as many of each kind and of none."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = rows.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans, order = [], [], [], []
            for k in range(batch.num_rows):
                doc, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or ""
                for n, (window, own) in enumerate(training_windows(text, doc % 1009)):
                    ids.append(doc)
                    order.append(n)
                    texts.append(window)
                    spans.append(listed(own))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(order, pa.int32()), "text": pa.array(texts, pa.string()), "spans": pa.array(spans, pa.string())})

    made = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(label, "doc_id long, n int, text string, spans string")  # at most ``sample`` ids
    order = [F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("n").cast("string"), "text")), F.col("text"), F.col("spans")]
    made = made.withColumn("place", F.row_number().over(Window.partitionBy(F.substring_index("spans", ":", 1)).orderBy(*order)))
    got = made.filter(F.col("place") <= windows // (len(KINDS) + 1)).orderBy(*order).limit(windows).collect()
    return train([(r["text"], [(k, int(a), int(e)) for k, a, e in (s.split(":") for s in r["spans"].split(",") if s)]) for r in got])


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, spans (all), n_added."""
    parameters = tagger.p

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Tagger(parameters)
        for batch in batches:
            column = batch.column(1)
            n = batch.num_rows
            counts, shas, spans, added = {k: [0] * n for k in KINDS}, [""] * n, [""] * n, [0] * n
            empty = hashlib.sha256(b"").hexdigest()
            queue: list[tuple[int, str, list[int], list[Span]]] = []
            held = 0

            def flush(queue: list, spans: list, added: list) -> None:
                windows = ((text, s) for _, text, starts, _ in queue for s in starts)

                def scored() -> Iterator[np.ndarray]:
                    while some := list(itertools.islice(windows, 512)):
                        codes = np.zeros((len(some), WIDTH), np.int64)
                        for row, (text, s) in enumerate(some):
                            piece = encode(text[s : s + WIDTH])
                            codes[row, : len(piece)] = piece
                        yield net.scores(codes)[0].transpose(1, 0, 2)

                for (k, text, _, base), found in zip(queue, reconcile(net, [(q[1], q[2]) for q in queue], scored()), strict=True):
                    every = all_spans(text, base, found)
                    spans[k], added[k] = listed(every), len(every) - len(base)

            for k in range(n):
                text = column[k].as_py() or ""
                base = base_spans(text)
                for kind, _, _ in base:
                    counts[kind][k] += 1
                shas[k] = hashlib.sha256(listed(base).encode()).hexdigest() if base else empty
                starts = windows_of(text)
                if starts:
                    queue.append((k, text, starts, base))
                    held += len(starts)
                    if held >= 512:
                        flush(queue, spans, added)
                        queue, held = [], 0
            flush(queue, spans, added)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{f"n_{k}": pa.array(counts[k], pa.int64()) for k in KINDS}, "base_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.string()), "n_added": pa.array(added, pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
