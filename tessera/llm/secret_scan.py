"""Secret scans: base patterns, and a linear-chain conditional random field that adds to them.

Base spans are the patterns' leftmost non-overlapping matches, per kind, that are long enough. The field tags tokens
(runs of key characters, or single other characters) as begin, inside or outside of a secret. Its features are the
token's shape (length, classes of characters, mixing, entropy), the two tokens before and the one after, by name if
they are words of keys and by shape otherwise, whether white space stands between, and features of the file (whether
it names keys at all, whether it has base matches). It is trained on the driver by gradient on the
log-likelihood (forward-backward), from at most SAMPLE texts drawn by hash of the text, tagged by the base patterns,
together with MADE sentences made from a fixed seed with assignments that the base patterns miss; decoding is Viterbi.

A secret begins at any token of key characters (length and digits are features, no bar) and goes on only while no
white space intervenes. A word (between white space) in which no span can be worth more than staying outside, by a bound
on its tokens' scores and the moves, is outside on the best path whatever stands around it; Viterbi runs over the other
words, with the certain tags on either side, so it finds the whole text's path. The bound is taken twice: once for a
word's pattern of character classes, over all entropies such a word can have and all neighbours of QUIET kinds, which
settles nearly all words by a lookup; then, for words it leaves open, and the word before and the three after a word that is
not quiet, from the tokens' own scores in their place.
Training, and it alone, is bounded: of each of its SAMPLE texts at most STRETCHES stretches of STRETCH characters around
digits and names of keys (near()), and the first HEAD characters. The scan takes whole texts, WORDS words at a time.

Spans are in code points, end exclusive. Field spans that overlap a base span are left out, so base spans stay as they are.

Defined cases: a null text counts as empty; a text without secrets has counts 0, no spans and the SHA-256 of the empty
string; repeated rows are scanned each; an empty table gives an empty result; further columns, whatever their names,
are kept by redact() and ignored by scan_secrets().
"""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, whole

SAMPLE, MADE, LEAST, BITS = 800, 800, 8, 14
STRETCHES, STRETCH, HEAD, WORDS = 50, 4000, 600, 100_000
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "field")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=\-]+|[^\sA-Za-z0-9+/_.=\-]")
DIGITS = re.compile(r"[0-9]+")
WORD = re.compile(r"\S+")
KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
NAMED = re.compile("password|passwd|pwd|secret|token|api_?key|bearer|credential|passphrase", re.IGNORECASE)
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "access", "login", "passphrase", "session")
NAMELIKE = re.compile("|".join(NAMES))
#: Names that brief() gives to tokens which tell nothing of a secret beside them.
QUIET = ("edge", "word", "num", "mix", *".,;!?()-|&%*#$/")


class Classes(dict):
    """Characters of a class as one (str.translate), but for those that begin brief()'s names."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in KEY_CHARS:
            own = "l" if c.islower() else "u" if c.isupper() else "0" if c.isdigit() else c
        else:  # a token of its own; all that matters of a letter is its case
            own = ("é" if c.islower() else "É" if c.isupper() else "²" if c.isdigit() else "日") if c.isalnum() else c
        self[code] = own
        return own


CLASSES = Classes()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]  # a run of 32 or more is the whole run, as a longer match is preferred
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _value(m: re.Match) -> tuple[int, int]:
    return m.start(2), m.end(2)


def shape(token: str) -> list[str]:
    n = len(token)
    low, up, dig = (sum(map(f, token)) for f in (str.islower, str.isupper, str.isdigit))
    other = n - low - up - dig
    counts = Counter(token)
    entropy = -sum(c / n * log2(c / n) for c in counts.values())
    classes = "".join(c for c, x in zip("lud.", (low, up, dig, other), strict=True) if x)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    return [f"len{min(n, 48) // 4}", f"cls{classes}", f"ent{int(entropy * 2)}", f"turn{min(turns, 12) // 2}", f"{classes}{min(n, 48) // 8}{min(turns, 12) // 3}"]


def strong(token: str) -> bool:
    return len(token) >= LEAST and any(c.isdigit() for c in token)


def brief(token: str | None) -> str:
    if token is None:
        return "edge"
    plain = token.lower().strip("._-=")
    if plain in NAMES:
        return "name"
    if any(x in plain for x in NAMES):
        return "namelike"
    if not token[0].isalnum():
        return token[0]
    return "num" if token.isdigit() else "mix" if any(map(str.isdigit, token)) else "word"


@dataclass
class Tokens:
    text: list[str]
    start: list[int]
    gap: list[bool]  # white space, or the beginning, before it

    def may_begin(self, i: int) -> bool:
        return self.text[i][0] in KEY_CHARS


def tokens(text: str, low: int = 0, high: int | None = None) -> Tokens:
    out, end = Tokens([], [], []), None
    for m in TOKEN.finditer(text, low, len(text) if high is None else high):
        out.text.append(m.group())
        out.start.append(m.start())
        out.gap.append(end is None or m.start() > end)
        end = m.end()
    return out


def file_features(text: str, base: list) -> list[str]:
    lower = text.lower()
    return [f"file_names{any(x in lower for x in NAMES[:6])}", f"file_base{min(len(base), 2)}"]


def _number(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") & ((1 << BITS) - 1)


def token_features(t: Tokens, i: int, file: list[str], memo: dict[str, int]) -> list[int]:
    at = lambda k: t.text[k] if 0 <= k < len(t.text) else None
    b1, b2, a1 = brief(at(i - 1)), brief(at(i - 2)), brief(at(i + 1))
    b3 = brief(at(i - 3))
    names = [*shape(t.text[i]), f"own{brief(t.text[i])}", f"p1{b1}", f"p2{b2}", f"p12{b1}|{b2}", f"p123{b1}|{b2}|{b3}", f"n1{a1}", f"gap{t.gap[i]}", f"begin{strong(t.text[i])}", *file, "bias"]
    out = []
    for n in names:
        k = memo.get(n)
        if k is None:
            k = memo[n] = _number(n)
        out.append(k)
    return out


@dataclass
class Field:
    emit: np.ndarray  # (features, 3); tags: 0 outside, 1 begin, 2 inside
    move: np.ndarray  # (3, 3)

    def score(self, *names: str) -> np.ndarray:
        return self.emit[[_number(n) for n in names]].sum(axis=0)

    def tags(self, t: Tokens, numbers: list[list[int]]) -> list[int]:
        """Viterbi."""
        score, back = None, []
        for i, own in enumerate(numbers):
            e = self.emit[own].sum(axis=0) + allowed(t, i)
            if score is None:
                score = e + np.array([0, 0, -1e9])
            else:
                step = score[:, None] + self.move
                if t.gap[i]:
                    step = step + NO_INSIDE
                back.append(step.argmax(axis=0))
                score = step.max(axis=0) + e
        if score is None:
            return []
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


class Rows:
    """Growing rows of numbers by key."""

    def __init__(self, width: int) -> None:
        self.at: dict = {}
        self.values = np.zeros((1024, width))

    def add(self, key: object, row: object) -> int:
        k = self.at[key] = len(self.at)
        if k == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[k] = row
        return k


class Kinds(dict):
    """Of words in a file with some features: 0 outside among quiet neighbours, 1 open, 2 not quiet itself."""

    def __init__(self, decoder: Decoder, file: list[str]) -> None:
        super().__init__()
        self.decoder, self.file = decoder, file

    def __missing__(self, word: str) -> int:
        self.decoder.chars += len(word)
        kind = self[word] = self.decoder.kind(word, self.file)
        return kind


class Decoder:
    """The field's best path over whole texts; what a token, a word or a context is worth is kept between texts."""

    KEPT, KEPT_CHARS = 500_000, 1 << 24

    def __init__(self, field: Field) -> None:
        self.field = field
        m = field.move
        self.enter = max(0.0, float((m[:, 1] - m[:, 0]).max()))
        self.leave = max(0.0, float((m[1:, :2] - m[0, :2]).max()))
        self.stay = float(max(m[1, 2], m[2, 2]) - m[0, 0])
        self.slip = float(m[0, 2] - m[0, 0])
        self.gap = np.array([field.score("gapFalse"), field.score("gapTrue")])
        # the most that quiet neighbours add to begin and inside over outside
        before = [field.score(f"p1{x}", f"p2{y}", f"p12{x}|{y}", f"p123{x}|{y}|{z}") for x in QUIET for y in QUIET for z in QUIET]
        self.most_before = self.over(np.array(before))
        self.most_after = self.over(np.array([field.score(f"n1{x}") for x in QUIET]))
        self.patterns: dict[tuple, int] = {}
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.shapes: dict[tuple, list] = {}
        self.kinds: dict[tuple, Kinds] = {}
        self.chars = 0
        self.tokens = Rows(5)  # scores of the three tags, number of brief(), whether of key characters
        self.context, self.after, self.briefs = Rows(3), Rows(3), {}
        self.brief("edge")

    def brief(self, name: str) -> int:
        k = self.briefs.get(name)
        if k is None:
            k = self.briefs[name] = self.after.add(name, self.field.score(f"n1{name}"))
        return k

    def word(self, word: str) -> list[int]:
        out = []
        for t in TOKEN.findall(word):
            k = self.tokens.at.get(t)
            if k is None:
                name = brief(t) if NAMELIKE.search(t.lower()) else ""
                like = (t.translate(CLASSES), *map(t.count, dict.fromkeys(t)), name)  # all that the scores depend on
                row = self.shapes.get(like)
                if row is None:
                    b = name or brief(t)
                    row = self.shapes[like] = [*self.field.score(*shape(t), f"own{b}", f"begin{strong(t)}").tolist(), self.brief(b), t[0] in KEY_CHARS]
                k = self.tokens.add(t, row)
            out.append(k)
        self.words[word] = out
        return out

    def before(self, b: np.ndarray) -> np.ndarray:
        """Scores of the three tokens before each."""
        p = [np.concatenate([np.zeros(min(k, len(b)), dtype=np.int64), b[: max(len(b) - k, 0)]]) for k in (1, 2, 3)]
        code, where = np.unique(p[0] | p[1] << 20 | p[2] << 40, return_inverse=True)
        own = []
        names: list[str] | None = None
        for c in code.tolist():
            k = self.context.at.get(c)
            if k is None:
                names = names or list(self.briefs)
                x, y, z = (names[c >> s & 0xFFFFF] for s in (0, 20, 40))
                k = self.context.add(c, self.field.score(f"p1{x}", f"p2{y}", f"p12{x}|{y}", f"p123{x}|{y}|{z}"))
            own.append(k)
        return self.context.values[own][where]

    def scores(self, words: list[str], file: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of scores a token, whether it may begin, and each word's first token (with the end)."""
        known = self.words.get
        own = [known(w) or self.word(w) for w in words]
        ids = np.fromiter(chain.from_iterable(own), np.int64)
        rows, starts = self.tokens.values[ids], np.cumsum([0, *map(len, own)])
        b = rows[:, 3].astype(np.int64)
        gap = np.zeros(len(ids), dtype=np.int64)
        gap[starts[:-1]] = 1
        e = rows[:, :3] + self.before(b) + self.after.values[np.append(b[1:], 0)] + self.gap[gap] + self.field.score(*file, "bias")
        return e, rows[:, 4] > 0, starts

    @staticmethod
    def over(scores: np.ndarray) -> np.ndarray:
        return (scores[:, 1:] - scores[:, :1]).max(axis=0)

    def kind(self, word: str, file: list[str]) -> int:
        if NAMELIKE.search(word.lower()):
            return 2
        like = (word.translate(CLASSES), *file)
        k = self.patterns.get(like)
        if k is None:
            if len(self.patterns) > self.KEPT:
                self.patterns.clear()
            k = self.patterns[like] = self.kind_of_tokens(TOKEN.findall(word), file)
        return k

    def kind_of_tokens(self, found: list[str], file: list[str]) -> int:
        """What holds for all words with the pattern of these tokens."""
        score, rest, worth = self.field.score, 0.0, -np.inf
        for i, t in reversed(list(enumerate(found))):
            b = brief(t)
            if b not in QUIET:
                return 2
            known = [x for x in shape(t) if not x.startswith("ent")]
            spread = self.over(np.array([score(f"ent{k}") for k in range(int(2 * log2(len(t))) + 1)]))
            own = self.over(score(*known, f"own{b}", f"begin{strong(t)}", f"gap{i == 0}", "bias", *file)[None])
            begin, inside = own + spread + self.most_before + self.most_after
            gain = begin + self.enter if t[0] in KEY_CHARS else -np.inf
            slip = inside + self.slip if i else -np.inf
            keep = max(inside + self.stay, 0.0)
            worth = max(worth, max(gain, slip) + self.leave + rest)
            rest += keep
        return int(worth >= -1e-6)

    def hot(self, e: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The words in which a span may be worth more than staying outside."""
        inside = np.maximum(e[:, 2] - e[:, 0] + self.stay, 0)
        total = np.cumsum(inside)
        last = np.repeat(total[starts[1:] - 1], np.diff(starts))
        gain = np.where(begin, e[:, 1] - e[:, 0] + self.enter, -np.inf)
        slip = e[:, 2] - e[:, 0] + self.slip  # the moves do not bar inside after outside
        slip[starts[:-1]] = -np.inf
        bound = np.maximum(gain, slip) + self.leave + last - total
        return np.flatnonzero(np.maximum.reduceat(bound, starts[:-1]) >= -1e-6)

    def path(self, e: np.ndarray, begin: list[bool], gap: list[bool], first: bool, last: bool) -> list[int]:
        """Viterbi over neighbouring tokens; those around are outside, unless the text begins (first) or ends (last) here."""
        m = self.field.move.tolist()
        none, back = float("-inf"), []
        score = [0.0, none, none]
        for i in range(len(e)):
            new, own = [], []
            for k in range(3):
                if (k == 1 and not begin[i]) or (k == 2 and gap[i]):
                    best, of = none, 0
                else:
                    best, of = max((score[j] + (m[j][k] if i or not first else 0.0), -j) for j in range(3))
                    of = -of
                new.append(best + e[i, k])
                own.append(of)
            score = new
            back.append(own)
        ends = [s + (0.0 if last else m[k][0]) for k, s in enumerate(score)]
        out = [ends.index(max(ends))]
        for own in reversed(back[1:]):
            out.append(own[out[-1]])
        return out[::-1]

    def hot_words(self, words: list[str], file: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, token scores and whether they may begin, of each hot word; those left open WORDS at a time."""
        if max(len(self.words), len(self.tokens.at), len(self.context.at), sum(map(len, self.kinds.values()))) > self.KEPT or self.chars > self.KEPT_CHARS:
            self.clear()
        kinds = self.kinds.setdefault(tuple(file), Kinds(self, file))
        codes = np.frombuffer(bytes(map(kinds.__getitem__, words)), dtype=np.uint8)
        left_open, loud = codes > 0, np.flatnonzero(codes == 2)
        for k in (-1, 1, 2, 3):  # a token's features reach three tokens back and one on, and a word has one at least
            left_open[np.clip(loud + k, 0, len(words) - 1)] = True
        picked = np.flatnonzero(left_open)
        for at in range(0, len(picked), WORDS):
            own = picked[at : at + WORDS]
            seen = np.unique(np.concatenate([own + k for k in range(-3, 2)]))
            seen = seen[(seen >= 0) & (seen < len(words))]
            e, begin, starts = self.scores([words[i] for i in seen.tolist()], file)
            mine = np.isin(seen, own)
            for w in self.hot(e, begin, starts).tolist():
                if mine[w]:
                    span = slice(starts[w], starts[w + 1])
                    yield int(seen[w]), e[span], begin[span]

    def spans(self, text: str, file: list[str]) -> list[tuple[int, int]]:
        words = text.split()
        if not words:
            return []
        runs: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for hot in self.hot_words(words, file):
            if runs and runs[-1][-1][0] == hot[0] - 1:
                runs[-1].append(hot)
            else:
                runs.append([hot])
        if not runs:
            return []
        out: list[tuple[int, int]] = []
        wanted, at = {w for run in runs for w, _, _ in run}, {}
        for w, m in enumerate(WORD.finditer(text)):
            if w in wanted:
                at[w] = m.start()
        for run in runs:
            gap = [i == 0 for _, e, _ in run for i in range(len(e))]
            tags = self.path(np.concatenate([e for _, e, _ in run]), np.concatenate([b for _, _, b in run]).tolist(), gap, run[0][0] == 0, run[-1][0] == len(words) - 1)
            left, was = iter(tags), 0
            for w, _, _ in run:
                for m in TOKEN.finditer(words[w]):
                    tag = next(left)
                    if tag == 1:
                        out.append((at[w] + m.start(), at[w] + m.end()))
                    elif tag == 2 and was:
                        out[-1] = (out[-1][0], at[w] + m.end())
                    was = tag if tag < 2 else was
        return out


NO_INSIDE = np.array([[0, 0, -1e9]] * 3)


def allowed(t: Tokens, i: int) -> np.ndarray:
    return np.array([0.0, 0.0 if t.may_begin(i) else -1e9, 0.0])


def made(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Sentences with secrets that no base pattern knows, and look-alikes that are none."""
    letters, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(rng.choice(list(letters), rng.integers(2, 9)))
    out = []
    title = lambda: "".join(rng.choice(list(letters), rng.integers(3, 10))).title()
    run = lambda of, low, high: "".join(rng.choice(list(of), rng.integers(low, high)))
    names = ["pwd", "passphrase", "auth_key", "private_key", "credential", "bearer", "session_key", "login_pwd"]
    for i in range(n):
        head, tail = " ".join(word() for _ in range(rng.integers(2, 8))), " ".join(word() for _ in range(rng.integers(1, 6)))
        if i % 3 < 2:
            kind = i // 3 % 6
            value = run(alnum, 16, 40)
            value = value[:-2] + "7" + value[-1]
            if kind == 2:
                value = "".join(title() for _ in range(rng.integers(2, 5)))
            elif kind == 3:
                value = run(alnum[:52], 16, 40)
            elif kind == 4:
                value = f"{word()}{rng.integers(1, 1000)}"
            elif kind == 5:
                value = run(letters, 7, 20)
            name = rng.choice(names)
            mid = rng.choice([" = ", ": ", "=", " := "])
            quote = rng.choice(['"', "'", ""])
            if kind in (1, 3) and i % 3:
                name, mid, quote = rng.choice(["Authorization: Bearer", "auth: Bearer", "Bearer", "bearer"]), " ", ""
            lead = f"{head} {name}{mid}{quote}"
            out.append((f"{lead}{value}{quote} {tail}", [(len(lead), len(lead) + len(value))]))
        else:
            plain = rng.choice([f"{word()}{rng.integers(10, 9999)}", f"{rng.integers(10**9, 10**12)}", f"2021-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", f"{word()}.{word()}{rng.integers(1, 99)}@{word()}.com", f"+{rng.integers(10**10, 10**11)}", f"{rng.integers(10**7, 10**8)}{rng.integers(10**7, 10**8)}", f"{title()}{title()}", f"{word()}: {word()}", f"{word()} = {title()}{title()}", f"the {rng.choice(names)} {word()}", f"{rng.choice(names)}, {word()}", f"a {rng.choice(['password', 'secret', 'token', 'key', 'bearer', 'session'])} {word()}", f"{run(letters, 8, 15)}.", f"{word()}://{word()}.com/{word()}"])
            out.append((f"{head} {plain} {tail}", []))
    return out


def near(text: str) -> list[tuple[int, int]]:
    """For training, stretches around strong tokens and names of keys, joined if they touch."""
    spans: list[tuple[int, int]] = []
    done = 0
    for a, b in sorted([m.span() for m in DIGITS.finditer(text)] + [m.span() for m in NAMED.finditer(text)]):
        if a < done:
            continue
        named = NAMED.match(text, a) is not None
        while a > 0 and text[a - 1] in KEY_CHARS:
            a -= 1
        while b < len(text) and text[b] in KEY_CHARS:
            b += 1
        done = b
        if b - a < LEAST and not named:
            continue
        low, high = max(0, a - 80), min(len(text), b + 80)
        while low > 0 and not text[low - 1].isspace() and a - low < 4096:
            low -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(high, spans[-1][1]))
        else:
            spans.append((low, high))
    return spans


def train(texts: list[str], steps: int = 40, seed: int = 5) -> Field:
    rng = np.random.default_rng(seed)
    memo: dict[str, int] = {}
    rows: list[tuple[list[list[int]], list[int], list[bool], list[bool]]] = []

    def add(text: str, file: list[str], secrets: list[tuple[int, int]], low: int = 0, high: int | None = None) -> None:
        t = tokens(text, low, high)
        tags = []
        for i, s in enumerate(t.start):
            own = next((v for v in secrets if v[0] <= s < v[1]), None)
            first = own and (i == 0 or t.start[i - 1] < own[0] or t.gap[i])
            tags.append(0 if not own or (first and not t.may_begin(i)) or (not first and tags and not tags[-1]) else 1 if first else 2)
        if t.text:
            rows.append(([token_features(t, i, file, memo) for i in range(len(t.text))], tags, t.gap, [t.may_begin(i) for i in range(len(t.text))]))

    for text in texts:
        base = base_spans(text)
        secrets = [_value(m) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] + [(a, b) for a, b, k in base if k != "assign"]
        for low, high in near(text)[:STRETCHES]:  # of a training text; the scan itself takes all
            add(text, file_features(text, base), secrets, low, min(high, low + STRETCH))
        add(text, file_features(text, base), secrets, 0, min(len(text), HEAD))  # any text: most words are outside
    for text, secrets in made(rng, MADE):
        add(text, file_features(text, []), secrets)
    field = Field(np.zeros((1 << BITS, 3)), np.zeros((3, 3)))
    rows.sort(key=lambda r: len(r[1]))
    width = len(rows[0][0][0])
    batches = []
    at = 0
    while at < len(rows):
        part = rows[at : at + max(1, min(1024, 100_000 // len(rows[min(at + 1023, len(rows) - 1)][1])))]
        at += len(part)
        n, steps_in = len(part), max(len(r[1]) for r in part)
        x, y = np.zeros((n, steps_in, width), dtype=np.int32), np.zeros((n, steps_in), dtype=np.int64)
        real, bar = np.zeros((n, steps_in)), np.zeros((n, steps_in, 3, 3))
        stop = np.zeros((n, steps_in, 3))
        for i, (f, tags, gap, begin) in enumerate(part):
            k = len(tags)
            x[i, :k], y[i, :k], real[i, :k] = f, tags, 1
            bar[i, :k][np.array(gap)] += NO_INSIDE
            stop[i, :k, 1] = np.where(begin, 0, -1e9)
            stop[i, 0, 2] = -1e9
        batches.append((x, y, real, bar, stop))
    params, m, v = [field.emit, field.move], [0, 0], [0, 0]
    for step in range(1, steps + 1):
        grads = [l2 * p for l2, p in zip((1e-3, 1e-3), params, strict=True)]
        for x, y, real, bar, stop in batches:
            for g, own in zip(grads, _slope(params, x, y, real, bar, stop), strict=True):
                g += own / len(rows)
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            params[i] -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return field


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _slope(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, real: np.ndarray, bar: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Of the negative log-likelihood, by forward-backward over a batch of padded sequences."""
    emit, move = params
    n, t = y.shape
    e = emit[x].sum(axis=2) + stop
    forward, backward = np.zeros((n, t, 3)), np.zeros((n, t, 3))
    forward[:, 0] = e[:, 0]
    for i in range(1, t):
        new = _sum_exp(forward[:, i - 1, :, None] + move + bar[:, i], 1) + e[:, i]
        forward[:, i] = np.where(real[:, i, None] > 0, new, forward[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = _sum_exp(move + bar[:, i + 1] + (e[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
        backward[:, i] = np.where(real[:, i + 1, None] > 0, new, 0)
    z = _sum_exp(forward[:, -1], 1)
    p = np.exp(np.minimum(forward + backward - z[:, None, None], 0)) * real[:, :, None]
    d = p.copy()
    np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - real[:, :, None], 2)
    g_emit = np.stack([np.bincount(x.ravel(), weights=np.repeat(d[:, :, k].ravel(), x.shape[2]), minlength=len(emit)) for k in range(3)], axis=1)
    g_move = np.zeros((3, 3))
    for i in range(1, t):
        pair = np.exp(np.minimum(forward[:, i - 1, :, None] + move + bar[:, i] + (e[:, i] + backward[:, i])[:, None, :] - z[:, None, None], 0)) * real[:, i, None, None]
        g_move += pair.sum(axis=0)
        np.add.at(g_move, (y[:, i - 1], y[:, i]), -real[:, i])
    return [g_emit, g_move]


def field_spans(text: str, field: Field, base: list[tuple[int, int, str]], memo: dict) -> list[tuple[int, int, str]]:
    decoder = memo.get("decoder")
    if decoder is None or decoder.field is not field:
        decoder = memo["decoder"] = Decoder(field)
    taken: list[list[int]] = []  # the stretches that base spans cover, which are sorted by their starts
    for x, y, _ in base:
        if taken and x <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], y)
        else:
            taken.append([x, y])
    starts = [x for x, _ in taken]
    free = lambda a, b: (i := bisect_left(starts, b)) == 0 or taken[i - 1][1] <= a
    return [(a, b, "field") for a, b in decoder.spans(text, file_features(text, base)) if free(a, b)]


def all_spans(text: str, field: Field, memo: dict) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all."""
    base = base_spans(text)
    return base, sorted([*base, *field_spans(text, field, base, memo)], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def fit(docs: DataFrame, text_col: str = "text", size: int = SAMPLE) -> Field:
    """From size texts at most; the patterns need an example, so half of them are such as name a key."""
    text = whole(text_col)
    named = text.rlike("(?i)(password|passwd|secret|token|api_?key|AKIA)")
    rows = docs.select(text.alias("t"), F.xxhash64(text).alias("h"), named.alias("named"))
    drawn = rows.filter("named").orderBy("h").limit(size // 2).unionByName(rows.filter("not named").orderBy("h").limit(size // 2)).orderBy("h", "t").collect()
    return train([r["t"] for r in drawn])


def _memo(field: Field) -> dict:
    """What a worker process remembers from task to task, under the field that it holds for."""
    kept = sys.__dict__.setdefault("_tessera_decoders", {})
    key = hash(field.emit.tobytes() + field.move.tobytes())
    if key not in kept:
        kept.clear()
        kept[key] = {"decoder": Decoder(field)}
    return kept[key]


def _shared(spark: SparkSession, field: Field):  # noqa: ANN202
    return spark.sparkContext.broadcast(field)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_field."""
    shared = _shared(docs.sparkSession, field or fit(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(shared.value)
        field = memo["decoder"].field
        for batch in small(batches):
            rows = []
            for text in batch.column("t").to_pylist():
                base, spans = all_spans(text, field, memo)
                kinds = Counter(k for _, _, k in spans)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), kinds["field"]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_field long").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", mark: str = "[SECRET]", field: Field | None = None) -> DataFrame:
    """docs, all rows and columns, with each span (overlapping ones as one) replaced by mark, and size_col set to the new length."""
    shared = _shared(docs.sparkSession, field or fit(docs, text_col))
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(shared.value)
        field = memo["decoder"].field
        for batch in small(batches):
            texts = batch.column(at).to_pylist()
            sizes = batch.column(size_at).to_pylist() if size_at is not None else []
            for i, text in enumerate(texts):
                if not text:
                    continue
                spans = all_spans(text, field, memo)[1]
                if spans:
                    parts, end = [], 0
                    for a, b, _ in spans:
                        if a >= end:
                            parts += [text[end:a], mark]
                        end = max(end, b)
                    texts[i] = "".join(parts) + text[end:]
                    if size_at is not None:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size_at is not None:
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
