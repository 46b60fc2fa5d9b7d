"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. Beyond them, regions of a text that hold digits in number, an at sign or a spelled-out
address are cut into tokens, and a semi-Markov model chooses segments and types together: a
segment of up to LONGEST tokens is scored as a whole (its digits and their grouping, check digit, signs,
neighbours, the words before), every other token is a segment of its own without a type, and dynamic
programming finds the best segmentation, holding a few bytes of each token. The model is fitted here, by the gradient of its likelihood
(forward and backward sums over segmentations), to sentences made by a seeded generator: numbers,
dates and prices among personal data in the forms people write. It takes nothing from the corpus.

Found segments are added where they meet no base span. Positions are code points.

Defined results: null and empty texts have no spans; every row gives one row, repeated rows repeated ones;
among base spans of a kind none overlap, spans of two kinds may; a text of any length is segmented as a whole, piece by piece; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import forget, map_rows, read, replace_column

KINDS = ["email", "ip", "card", "phone"]
OUT = 4  # the type of a token outside
LONGEST = 16
#: Characters around a trigger that its region has at least.
AROUND = 48
#: Tokens of a region whose features are held at a time.
PIECE = 2048

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: A number, an at sign, or the word at before a host with a spelled-out dot or with a full stop that a letter follows at once; at and dot in any case, with or without brackets.
_TRIGGER = re.compile(r"\(?[0-9][0-9 ()+.\-/]{5,}[0-9]|@|(?<![^\W\d_])[aA][tT](?![^\W\d_])[^\S\n]*[\])]?[^\S\n]*[\w.-]{1,253}?(?:[^\S\n]*[\[(]?[^\S\n]*(?<![^\W\d_])[dD][oO][tT](?![^\W\d_])|\.[^\W\d_])")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start.

    The patterns are matched so that each step costs what it reads: an email is found from its at sign
    back over the characters before it, which is where its leftmost match begins.
    """
    found = []
    if "@" in text:
        last = 0
        at = text.find("@")
        while at >= 0:
            m = _AT.match(text, at)
            start = at
            while m and start > last and text[start - 1] in _LOCAL:
                start -= 1
            if m and start < at:
                found.append((0, start, m.end()))
                last = m.end()
            at = text.find("@", m.end() if m and start < at else at + 1)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((3, *m.span()))
    return found


# Words before personal data, by what they announce.
CUES = {
    "email": "mail email e contact write reach address inbox",
    "ip": "ip host server address ping addr login from",
    "card": "card visa mastercard amex credit debit payment pay paid",
    "phone": "phone tel telephone call fax mobile cell number dial text whatsapp",
    "other": "order invoice isbn id no ref reference version page total price date year serial part sku ticket batch",
}
# End of fixed values.
_CUE_OF = {w: k for k, words in CUES.items() for w in words.split()}


class Tokens:
    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.digits = [w.isascii() and w.isdigit() for w in self.words]

    def gap(self, i: int) -> str:
        """What stands between token i - 1 and i."""
        return self.text[self.spans[i - 1][1] : self.spans[i][0]] if 0 < i < len(self.spans) else " "


def candidates(t: Tokens, first: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of segments of more than chance shape that begin in tokens first to end: the only ones a type is thought of for."""
    out, n = [], len(t.words)
    for i in range(first, n if end is None else end):
        w = t.words[i]
        if t.digits[i] or w in "+(":
            digits, stop = 0, min(n, i + LONGEST)
            only_card = t.digits[i]
            for j in range(i, stop):
                x = t.words[j]
                if j > i and t.gap(j) not in ("", " "):
                    break
                if t.digits[j]:
                    digits += len(x)
                elif x not in "+()-./":
                    break
                only_card &= t.digits[j] or x == "-"
                if digits > 19:
                    break
                if not t.digits[j]:
                    continue
                if 7 <= digits <= 15:
                    out.append((i, j + 1, 3))
                if only_card and 12 <= digits:
                    out.append((i, j + 1, 2))
                if j == i + 6 and t.digits[i] and t.words[i + 1] == t.words[i + 3] == t.words[i + 5] == "." and t.digits[i + 2] and t.digits[i + 4] and t.spans[j][1] - t.spans[i][0] == sum(map(len, t.words[i : j + 1])):
                    out.append((i, j + 1, 1))
        if w[0].isalnum():
            at = dot = False
            for j in range(i, min(n, i + LONGEST)):
                x = t.words[j].lower()
                if "\n" in t.gap(j) and j > i:
                    break
                if x in ("@", "at") and j > i:
                    at = True
                elif x in (".", "dot") and at:
                    dot = True
                elif not (x[0].isalnum() or x in "._-[]()+"):
                    break
                elif dot and x.isalpha() and x != "at" and t.words[j - 1].lower() in (".", "dot", ")", "]"):
                    out.append((i, j + 1, 0))
    return out


def segment_features(t: Tokens, i: int, j: int, kind: int) -> list[str]:
    """Names of what holds of a whole segment of a kind."""
    k = KINDS[kind]
    words, text = t.words[i:j], t.text[t.spans[i][0] : t.spans[j - 1][1]]
    left, right = t.gap(i), t.gap(j)
    out = ["bias", f"glued_left={i > 0 and left == '' and t.words[i - 1] not in '(:,;[='}", f"glued_right={j < len(t.words) and right == '' and (t.words[j][0].isalnum() or t.words[j] in '-/@+' or (t.words[j] == '.' and j + 1 < len(t.words) and t.gap(j + 1) == '' and t.words[j + 1][0].isalnum()))}"]
    cues = {_CUE_OF[w.lower()] for w in t.words[max(0, i - 4) : i] if w.lower() in _CUE_OF}
    out += [f"cue={c}" for c in sorted(cues)] or ["cue=none"]
    if kind == 0:
        low = [w.lower() for w in words]
        mark = "@" if "@" in low else "at"
        at = low.index(mark)
        spaced = " " in text
        out += [f"mark={mark}", f"spaced={spaced}", f"bracketed={'(' in low or '[' in low}", f"dots={'.' in low[at:]},{'dot' in low[at:]}", f"end={'short' if len(words[-1]) <= 3 else 'mid' if len(words[-1]) <= 6 else 'long'}", f"local_tokens={min(at, 6)}", f"inner_spaces={min(text.count(' '), 6)}"]
        return [f"{k}:{f}" for f in out]
    digits = "".join(w for w, d in zip(words, t.digits[i:j], strict=True) if d)
    groups = "-".join(str(len(w)) for w, d in zip(words, t.digits[i:j], strict=True) if d)
    signs = "".join(sorted({w for w, d in zip(words, t.digits[i:j], strict=True) if not d} | ({" "} if " " in text else set())))
    out += [f"groups={groups}", f"n={len(digits)}", f"signs={signs}", f"plus={words[0] == '+'}", f"balanced={text.count('(') == text.count(')')}", f"n_groups={min(groups.count('-') + 1, 6)}", f"digit_left={i > 0 and t.digits[i - 1] and left in ('', ' ')}", f"digit_right={j < len(t.words) and t.digits[j] and right in ('', ' ')}"]
    if kind == 2:
        out.append(f"luhn={luhn(digits)}")
    if kind == 1:
        out.append(f"bytes={all(len(w) <= 3 and int(w) <= 255 for w in words[::2])}")
    if kind == 3:
        out.append(f"datelike={bool(re.fullmatch(r'(19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](19|20)?[0-9]{2}', text))}")
    return [f"{k}:{f}" for f in out]


def out_features(t: Tokens, i: int) -> list[str]:
    w = t.words[i]
    shape = f"digits{min(len(w), 8)}" if t.digits[i] else "word" if w[0].isalnum() else w if w in "@+()-./" else "sign"
    return ["out:bias", f"out:{shape}"]


class SemiCrf:
    """Log-linear model of segmentations: whole-segment features and a weight for each pair of neighbouring types."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def lattice(self, t: Tokens) -> list[list[tuple[int, int, list[str]]]]:
        """For each end, its segments as (start, kind, features)."""
        ends: list[list] = [[] for _ in range(len(t.words) + 1)]
        for i in range(len(t.words)):
            ends[i + 1].append((i, OUT, out_features(t, i)))
        for i, j, kind in candidates(t):
            ends[j].append((i, kind, segment_features(t, i, j, kind)))
        return ends

    def _score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def _pair(self, a: int, b: int) -> float:
        return self.weights.get(f"pair:{a},{b}", 0.0)

    def best(self, t: Tokens) -> list[tuple[int, int, int]]:
        """The best segmentation's typed segments (start, end, kind), in token numbers."""
        path = Path(self)
        path.extend(t, 0, len(t.words))
        return path.segments()

    def gradient(self, t: Tokens, truth: set[tuple[int, int, int]]) -> tuple[dict[str, float], float]:
        """Features of the true segmentation less those expected, and its log likelihood."""
        ends, n = self.lattice(t), len(t.words)
        scores = [[self._score(f) for _, _, f in segs] for segs in ends]
        pair = np.array([[self._pair(a, b) for b in range(OUT + 1)] for a in range(OUT + 1)])
        fwd = np.full((n + 1, OUT + 1), -np.inf)
        fwd[0, OUT] = 0.0
        lse = np.logaddexp.reduce
        for j in range(1, n + 1):
            for (i, kind, _), s in zip(ends[j], scores[j], strict=True):
                fwd[j, kind] = np.logaddexp(fwd[j, kind], s + lse(fwd[i] + pair[:, kind]))
        bwd = np.full((n + 1, OUT + 1), -np.inf)
        bwd[n] = 0.0
        for j in range(n, 0, -1):
            for (i, kind, _), s in zip(ends[j], scores[j], strict=True):
                bwd[i] = np.logaddexp(bwd[i], pair[:, kind] + s + bwd[j, kind])
        total = float(lse(fwd[n]))
        grad: dict[str, float] = {}
        like = -total
        covered = {k for i, j, _ in truth for k in range(i, j)}
        starts = {i: (j, kind) for i, j, kind in truth}
        at, before, true_pairs = 0, OUT, {}
        while at < n:
            j, kind = starts.get(at, (at + 1, OUT))
            true_pairs[at, j, kind] = before
            at, before = j, kind
        del covered
        for j in range(1, n + 1):
            for (i, kind, features), s in zip(ends[j], scores[j], strict=True):
                through = np.exp(fwd[i] + pair[:, kind] + s + bwd[j, kind] - total)
                mine = true_pairs.get((i, j, kind))
                p = (mine is not None) - float(through.sum())
                if mine is not None:
                    like += s + pair[mine, kind]
                if abs(p) > 1e-6:
                    for f in features:
                        grad[f] = grad.get(f, 0.0) + p
                for a in range(OUT + 1):
                    q = (mine == a) - float(through[a])
                    if abs(q) > 1e-6:
                        grad[f"pair:{a},{kind}"] = grad.get(f"pair:{a},{kind}", 0.0) + q
        return grad, like

    def fit(self, examples: list[tuple[Tokens, set]], rounds: int = 6, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
        """AdaGrad on the likelihood; returns it by round."""
        squares: dict[str, float] = {}
        history = []
        for _ in range(rounds):
            total = 0.0
            for t, truth in examples:
                grad, like = self.gradient(t, truth)
                total += like
                for f, g in grad.items():
                    g -= decay * self.weights.get(f, 0.0)
                    squares[f] = squares.get(f, 1e-2) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
            history.append(total)
        return history


class Path:
    """The best segmentation, found from left to right. It holds a few bytes of each token and the values of the last LONGEST of them, nothing of the tokens' features."""

    def __init__(self, model: SemiCrf) -> None:
        self.model, self.n = model, 0
        self.pair = [[model._pair(a, b) for b in range(OUT + 1)] for a in range(OUT + 1)]
        start = [-math.inf] * OUT + [0.0]
        self.value: dict[int, list[float]] = {0: start}  # by tokens before, for each type of the last segment
        self.back = bytearray(2 * (OUT + 1))  # of each of these, the segment's tokens and the type before it

    def extend(self, t: Tokens, first: int, end: int) -> None:
        """Take in the segments that end in tokens first + 1 to end of t, which follow those taken in before. t has LONGEST tokens before first, or the text's beginning, and what features look at after end."""
        ends: list[list[tuple[int, int]]] = [[] for _ in range(end - first)]
        for i, j, kind in candidates(t, max(0, first - LONGEST), end):
            if first < j <= end:
                ends[j - first - 1].append((i, kind))
        shift = self.n - first
        for j in range(first + 1, end + 1):
            value, back = [-math.inf] * (OUT + 1), bytearray(2 * (OUT + 1))
            for i, kind in [(j - 1, OUT), *ends[j - first - 1]]:
                own = self.model._score(out_features(t, i) if kind == OUT else segment_features(t, i, j, kind))
                for a, before in enumerate(self.value[i + shift]):
                    v = before + self.pair[a][kind] + own
                    if v > value[kind]:
                        value[kind], back[2 * kind], back[2 * kind + 1] = v, j - i, a
            self.n += 1
            self.value[self.n] = value
            self.value.pop(self.n - LONGEST - 1, None)
            self.back += back

    def segments(self) -> list[tuple[int, int, int]]:
        found, j = [], self.n
        kind = max(range(OUT + 1), key=lambda k: self.value[j][k]) if j else OUT
        while j:
            at = 2 * ((OUT + 1) * j + kind)
            i, before = j - self.back[at], self.back[at + 1]
            if kind != OUT:
                found.append((i, j, kind))
            j, kind = i, before
        return found[::-1]


def typed_spans(text: str, a: int, b: int, model: SemiCrf) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best segmentation of text[a:b], whose tokens are looked at PIECE at a time."""
    path, spans = Path(model), array("q")
    held: list[tuple[int, int]] = []  # tokens whose features are still looked at
    done = 0  # how many of them are taken in

    def take(until: int) -> None:
        nonlocal done, held
        path.extend(Tokens(text[held[0][0] : held[-1][1]]), done, until)
        drop = max(0, until - 2 * LONGEST)
        held, done = held[drop:], until - drop

    for m in _TOKEN.finditer(text, a, b):
        held.append(m.span())
        spans.extend(m.span())
        if len(held) >= PIECE + 4 * LONGEST:
            take(len(held) - LONGEST)
    if len(held) > done:
        take(len(held))
    return [(kind, spans[2 * i], spans[2 * j - 1]) for i, j, kind in path.segments()]


def _check_digit(body: str) -> str:
    return next(d for d in "0123456789" if luhn(body + d))


def made_sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence with personal data and look-alikes, and its true (start, end, kind)."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeioulnrstmdg") for _ in range(r.randint(2, 8)))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"({a}){b}-{c}", f"0{digits(3)} {digits(3)} {digits(4)}"])

    def card() -> str:
        body = r.choice("456") + digits(14)
        n = body + _check_digit(body)
        sep = r.choice(["", " ", "-"])
        return sep.join(n[k : k + 4] for k in range(0, 16, 4))

    def email() -> str:
        user, host, end = word() + r.choice(["", digits(2)]), word(), r.choice(["com", "org", "net", "de", "fr", "io"])
        return r.choice([f"{user}@{host}.{end}", f"{user}.{word()}@{host}.{end}", f"{user} at {host} dot {end}", f"{user} [at] {host} [dot] {end}", f"{user}(at){host}.{end}", f"{user} (at) {host} (dot) {end}"])

    def other() -> str:
        return r.choice([
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}", lambda: digits(r.randint(7, 15)), lambda: f"{r.randint(1, 99)},{digits(3)}.{digits(2)}",
            lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{r.randint(1900, 1999)}-{r.randint(2000, 2030)}", lambda: digits(16)[:15] + "0", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}.{digits(3)}",
            lambda: f"at {word()} dot the {word()}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(8)}-{digits(4)}-{digits(4)}-{digits(4)}-{digits(12)}", lambda: f"{word()} @ {word()}", lambda: f"{digits(1)}.{digits(6)}", lambda: f"300.{digits(3)}.{digits(3)}.{digits(3)}",
        ])()

    text, truth = "", []
    for _ in range(r.randint(1, 3)):
        kind = r.choice([0, 1, 2, 3, OUT, OUT])
        value = [email, lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card, phone, other][kind]()
        if kind == OUT and luhn(value) and value.isdigit():
            continue
        text += " ".join(word() for _ in range(r.randint(1, 5))) + " "
        if r.random() < 0.35:
            text += r.choice(CUES[(KINDS + ["other"])[kind]].split()) + r.choice([" ", ": "])
        if kind != OUT:
            truth.append((len(text), len(text) + len(value), kind))
        text += value + r.choice([" ", ", ", ". "])
    return text + word(), truth


@lru_cache(maxsize=4)
def trained(seed: int = 7, n: int = 260, rounds: int = 5) -> SemiCrf:
    """The model, fitted to n made sentences; the same for the same arguments."""
    r, examples = random.Random(seed), []
    while len(examples) < n:
        text, spans = made_sentence(r)
        t = Tokens(text)
        at, to = {a: k for k, (a, _) in enumerate(t.spans)}, {b: k + 1 for k, (_, b) in enumerate(t.spans)}
        truth = {(at[a], to[b], kind) for a, b, kind in spans if a in at and b in to}
        if truth <= set(candidates(t)):
            examples.append((t, truth))
    model = SemiCrf()
    model.fit(examples, rounds)
    return model


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, grown to white space and joined where they meet."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        start, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        while start > 0 and not text[start - 1].isspace() and m.start() - start < 4 * AROUND:
            start -= 1
        while end < len(text) and not text[end].isspace() and end - m.end() < 4 * AROUND:
            end += 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


class Covered:
    """Spans joined where they overlap, to be asked what meets them."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def find_spans(text: str | None, model: SemiCrf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans as (kind, start, end), by kind, then start."""
    text = text or ""
    base = base_spans(text)
    added = []
    for a, b in regions(text):
        added += typed_spans(text, a, b, model)
    if added:
        met = Covered([(s, e) for _, s, e in base])
        added = [x for x in added if not met.overlaps(x[1], x[2])]
    return base, sorted(base + added)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with spans, joined where they overlap, replaced by their first one's kind."""
    if not spans or text is None:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiCrf | None = None) -> DataFrame:
    """(doc_id, spans, base) for each row: spans of (kind, start, end), base the number of each kind by patterns, and their digest."""
    model = model or trained()

    def make():
        forget()

        def step(ids, texts):
            counts, hashes, spans = [[] for _ in KINDS], [], []
            for text in texts:
                base, every = find_spans(text, model)
                for k, c in enumerate(counts):
                    c.append(sum(kind == k for kind, _, _ in base))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in every])
            return [ids, *counts, hashes, spans]

        return step

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans array<struct<kind: string, start: int, end: int>>"
    return map_rows(df.select(F.col(id_col).alias("doc_id"), text_col), schema, make)


def redact_documents(df: DataFrame, text_col: str = "text", model: SemiCrf | None = None) -> DataFrame:
    """df with the personal data in its text replaced by its kind, the other columns as they are."""
    own = model or trained()

    def make():
        forget()
        return lambda texts: [redact(t, find_spans(t, own)[1]) for t in texts]

    return replace_column(df, text_col, make)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.withColumn("spans", listed)
