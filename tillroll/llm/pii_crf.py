"""Personal data: base patterns, and a linear-chain CRF over word shapes decoded by Viterbi in numpy batches."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tillroll.llm.common import plain_names, ship_package, text_slices
from tillroll.llm.shingles import mix, text_bytes

KINDS = ("email", "ip", "card", "phone", "secret")  # the first four have base patterns, secrets only the CRF finds
LABELS = ("O", *KINDS)
SECRET = KINDS.index("secret")
_SLICE = 1 << 20

# ---- base spans ---------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base patterns, each leftmost and non-overlapping, in linear time.

    An address is found from its '@': the characters before it that may stand
    in a local part, back to the last address. Dotted numbers are taken four
    parts at a time from each maximal run, which is what the pattern matches.
    """
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") >= 3:
            parts = run.split(".")
            place = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i:i + 4]
                end = place + sum(map(len, four)) + 3
                if all(len(p) < 4 and int(p) <= 255 or not p.lstrip("0") or
                       len(p.lstrip("0")) < 4 and int(p.lstrip("0")) <= 255 for p in four):
                    out.append((place, 1, end))
                place = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---- word shapes --------------------------------------------------------------------------------

#: Attributes of a token and their numbers of values; a shape code holds them all.
ATTRIBUTES = (("digits", 9), ("dots", 4), ("at", 2), ("letters", 2), ("hyphen", 2), ("paren", 2), ("plus", 2),
              ("other", 2), ("word", 8), ("switches", 4))
_SIZES = np.array([n for _, n in ATTRIBUTES])
_STRIDES = np.concatenate([[1], np.cumprod(_SIZES)[:-1]])
CODES = int(np.prod(_SIZES))
_DIGIT_BUCKET = np.searchsorted([1, 3, 4, 5, 7, 9, 12, 20], np.arange(64), side="right").astype(np.int64)
#: Words that say what stands beside them, by value of the attribute "word".
CUES = {1: ("at", "(at)", "[at]"), 2: ("dot", "(dot)", "[dot]"), 3: ("tel", "tel.", "tel:", "phone", "phone:", "call", "fax"),
        4: ("mail", "mail:", "email", "email:", "e-mail"), 5: ("card", "card:", "visa", "iban"), 6: ("ip", "ip:", "host"),
        7: ("key", "key:", "api_key", "apikey:", "token", "token:", "secret", "secret:", "bearer", "pwd", "pwd:")}


def _word_hash(words: list[bytes]) -> np.ndarray:
    """A hash of short words: their bytes as one number, mixed."""
    return mix(np.array([int.from_bytes(w.ljust(8, b"\0"), "little") for w in words], dtype=np.uint64))


_CUE_HASH = _word_hash([w.encode() for ws in CUES.values() for w in ws])
_CUE_VALUE = np.array([v for v, ws in CUES.items() for _ in ws])
_CUE_ORDER = np.argsort(_CUE_HASH)


def shapes(buf: np.ndarray, offsets: np.ndarray):
    """(codes, starts, ends, token offsets of the documents) of white-space tokens in UTF-8 bytes."""
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.int64), starts, ends, np.zeros(len(offsets), np.int64)
    digit = (buf >= 48) & (buf <= 57)
    low = buf | 32
    ascii_letter = (low >= 97) & (low <= 122) & (buf < 128)
    letter = ascii_letter | (buf >= 128)
    paren = (buf == 40) | (buf == 41)
    known = digit | letter | paren | space
    # tokens of letters alone, perhaps with one mark at the end, are most of a text: they need no counts
    marks = np.add.reduceat((~(letter | space)).astype(np.int32), starts)
    codes = np.zeros(len(starts), np.int64)
    codes[:] = _STRIDES[3]
    hard = np.flatnonzero(marks > 0)
    if len(hard):
        s, e = starts[hard], ends[hard]

        def count(flag):
            sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
            return sums[e] - sums[s]

        dots = count(buf == 46) - (buf[e - 1] == 46)
        hyphen, at = buf == 45, buf == 64
        plain_end = np.isin(buf[e - 1], (44, 58, 59, 33, 63, 34, 39))  # , : ; ! ? " '
        other = count(~(known | (buf == 46) | hyphen | at | (buf == 43)))
        change = np.zeros(len(buf), dtype=bool)  # between a digit and a letter, within a token
        change[1:] = (digit[1:] & ascii_letter[:-1]) | (ascii_letter[1:] & digit[:-1])
        switches = np.searchsorted([1, 3, 6], count(change) - change[s], side="right")
        values = (_DIGIT_BUCKET[np.minimum(count(digit), 63)], np.clip(dots, 0, 3), count(at) > 0, count(letter) > 0,
                  count(hyphen) > 0, count(paren) > 0, buf[s] == 43, other - (plain_end & (other > 0)) > 0, np.zeros(len(s), np.int64), switches)
        codes[hard] = sum(np.asarray(v, dtype=np.int64) * _STRIDES[i] for i, v in enumerate(values))
    lens = ends - starts
    short = np.flatnonzero(lens <= 7)
    if len(short):
        word = np.zeros(len(short), np.uint64)
        s, n = starts[short], lens[short]
        for k in range(7):
            c = np.where(k < n, buf[np.minimum(s + k, len(buf) - 1)], 0)
            c = np.where((c >= 65) & (c <= 90), c + 32, c)
            word |= c.astype(np.uint64) << np.uint64(8 * k)
        h = mix(word)
        at = np.searchsorted(_CUE_HASH, h, sorter=_CUE_ORDER)
        at = _CUE_ORDER[np.minimum(at, len(_CUE_ORDER) - 1)]
        codes[short] += np.where(_CUE_HASH[at] == h, _CUE_VALUE[at], 0) * _STRIDES[8]
    return codes, starts, ends, np.searchsorted(starts, offsets)


PLAIN = int(_STRIDES[3])  # letters, and perhaps a full stop, comma or the like behind them


# ---- the model ----------------------------------------------------------------------------------

#: Marked examples: {kind} takes a value of that kind, {x:kind} a form the base patterns miss, {n} a neutral number,
#: {w} a word with marks, {v} a plain word.
TEMPLATES = (
    "write to {email} for more", "contact {email} or {phone}", "mail {x:email} before noon", "my address is {x:email} thanks",
    "email: {email} tel: {phone}", "reach {x:email} today", "mail me: {x:email} or {x:phone}", "{v} {x:email} {v}", "from {ip} to {ip}", "the host {ip} was down", "ip: {ip} again",
    "login from {ip} failed", "card {card} was charged", "pay with visa {card} now", "card: {x:card} expired",
    "number {x:card} was used", "call {phone} at once", "tel. {x:phone} after five", "phone {x:phone} please",
    "ring me on {x:phone} tonight", "our fax {x:phone} is new", "{x:phone} is my number", "call {x:phone} or mail {email}",
    "on {n} we met at the house", "it costs {n} in all", "see page {n} of the book", "order {n} has left",
    "the dot at the end of it", "look at the {n} people", "he was at home", "version {n} is out", "a dot of ink",
    "key: {x:secret} was set", "the secret {x:secret} was leaked", "api_key = {x:secret} {v}", "pwd {x:secret} {v} {v}",
    "{v} {x:secret} {v}", "{w} {x:secret} {w}", "sign in with {x:secret} now", "bearer {x:secret} in the header",
    "he met the {v} at {v} and {v}", "{v} at {v} {v}", "the key {v} of {v}", "a {v} token {v} {v}", "key = {n} {v}",
    "with {n} and {n} of them", "the secret {v} in {n}", "{v} {v} {n} {v}", "{v} {n} {w}", "{w} {n} {v}", "call the {n} men", "card games at {n} tables", "the host at dinner",
    "between {n} and {n} percent", "room {n} on floor {n}", "email the {n} winners", "in the year {n} it began",
    "the {w} and {w} of {w}", "{w} {w} {w} {w} {w}", "in {w} we see {w}", "tel. {w} or mail {w}",
    "und der {n} ist mit dem haus", "le {n} est dans la maison", "el {n} de la casa", "{n} {n} {n} {n}", "( {n} ) and so on",
)
EXAMPLES_PER_TEMPLATE = 6


ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def labelled_table(seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The training table, a few hundred rows of (tokens, labels) drawn from TEMPLATES by rule."""
    rng = np.random.default_rng(seed)

    def num(k):
        return "".join(str(d) for d in rng.integers(0, 10, k))

    def pick(*forms):
        return forms[int(rng.integers(len(forms)))]()

    def name():
        return "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 9))))

    def mixed(k, letters):
        return "".join(letters[int(c)] for c in rng.integers(0, len(letters), k))

    def card():
        body = num(15)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def fours(sep):
        c = card()
        return sep.join(c[i:i + 4] for i in range(0, 16, 4))

    make = {
        "email": lambda: pick(lambda: f"{name()}.{num(2)}@{name()}{num(1)}.example.com", lambda: f"{name()}@{name()}.org"),
        "ip": lambda: ".".join(str(int(p)) for p in rng.integers(1, 255, 4)),
        "card": lambda: pick(card, lambda: fours(" "), lambda: fours("-")),
        "phone": lambda: pick(lambda: f"+1 ({num(3)}) 555-{num(4)}", lambda: f"+49 {num(3)} {num(7)}"),
        "x:email": lambda: pick(lambda: f"{name()}(at){name()}.org", lambda: f"{name()}[at]{name()}.com",
                                lambda: f"{name()}.{num(2)}@{name()}", lambda: f"{name()} (at) {name()} (dot) org"),
        "x:card": lambda: fours("."),
        "x:phone": lambda: pick(lambda: f"({num(3)}) 555-{num(4)}", lambda: f"{num(3)}-555-{num(4)}",
                                lambda: f"{num(3)}.555.{num(4)}", lambda: f"{num(2)} {num(4)} {num(4)}"),
        "x:secret": lambda: pick(lambda: mixed(24, "0123456789abcdef"), lambda: f'"{mixed(32, "0123456789abcdef")}"',
                                 lambda: mixed(30, ALNUM), lambda: f"'{mixed(20, ALNUM)}'", lambda: f"sk_live_{mixed(24, ALNUM)}"),
        "v": name,
        "n": lambda: pick(lambda: num(int(rng.integers(1, 5))), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"{num(2)}.{num(2)}",
                          lambda: f"{num(1)},{num(3)}.{num(2)}", lambda: f'"{name()}{num(3)}"', lambda: f"{num(2)}{name()}",
                          lambda: f"{name()}{num(2)}-{name()}", lambda: f"{num(1)}.{num(1)}.{num(1)}",
                          lambda: num(16), lambda: num(int(rng.integers(6, 13))), lambda: f"({num(2)})", lambda: f"{num(2)}%", lambda: f"978-3-16-{num(6)}-{num(1)}",
                          lambda: f"{name()}-{num(2)}", lambda: f"{num(2)}:{num(2)}"),
        "w": lambda: pick(lambda: name() + "###", lambda: name() + "$$$", lambda: name() + ",***", lambda: name() + ".%%%",
                          lambda: f"<p>{name()}</p>", lambda: f"http://{name()}.org/{name()}", lambda: f"{name()}(s)", lambda: "|",
                          lambda: f"{name()}-{name()}", lambda: f"[{name()}]", lambda: f"{name()}/{name()}", lambda: f"{name()}.{name()}"),
    }
    rows = []
    for template in TEMPLATES:
        for _ in range(EXAMPLES_PER_TEMPLATE):
            tokens, labels = [], []
            for piece in re.split(r"(\{[a-z:]+\})", template):
                kind = piece[1:-1] if piece.startswith("{") else None
                words = (make[kind]() if kind else piece).split()
                label = LABELS.index(kind.split(":")[-1]) if kind and kind not in "nwv" else 0
                tokens += words
                labels += [label] * len(words)
            rows.append((tokens, labels))
    return rows


class ShapeCrf:
    """Weights of a linear-chain CRF whose features are the shapes of a token and of its two neighbours."""

    def __init__(self, emit: np.ndarray, trans: np.ndarray):
        self.emit, self.trans = emit, trans  # [3 places][codes][labels], [labels][labels]
        t = trans
        before = t - t[:, :1]                # what entering y instead of O can gain, by the label before
        after = (t - t[:1, :]).T             # what leaving y instead of O can gain, by the label after
        self.bound = np.maximum(before.max(0), 0) + np.maximum(after.max(0), 0)
        # A stretch of n plain words between plain words, none O, gives up n * loss against all O and can gain
        # (n - 1) * step within, and ``ends`` at most at its ends (``inner``, if O stands at both).
        own = np.stack([emit[1, PLAIN] + i * emit[0, PLAIN] + j * emit[2, PLAIN] for i in (0, 1) for j in (0, 1)])
        loss = (own[:, :1] - own[:, 1:]).min()
        step = max((t[1:, 1:] - t[0, 0]).max(), 0.0)
        ends = np.maximum(before.max(0), 0)[1:].max() + np.maximum(after.max(0), 0)[1:].max()
        inner = max((t[0, 1:] - t[0, 0]).max(), 0.0) + max((t[1:, 0] - t[0, 0]).max(), 0.0)
        #: Plain words farther than this from any other token are O in every best path (None: nothing is known).
        self.reach = 2 + int(max(ends - step, 0.0) / (loss - step)) if loss > max(step, inner) else None

    def scores(self, codes: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Emission scores of the tokens ``which``; neighbours in other documents don't count."""
        starts = np.zeros(len(codes) + 1, dtype=bool)
        starts[bounds] = True
        out = self.emit[1, codes[which]].copy()
        left = which[~starts[which]]
        out[~starts[which]] += self.emit[0, codes[left - 1]]
        right = ~starts[which + 1]
        out[right] += self.emit[2, codes[which[right] + 1]]
        return out

    def decode(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label of every token.

        A token whose emission prefers O by more than any transitions could
        repay is O in every best path. Only the runs of other tokens are
        decoded, between those fixed ones; runs of one length go together.
        """
        labels = np.zeros(len(codes), np.int8)
        if not len(codes):
            return labels
        near = np.ones(len(codes), dtype=bool)
        if self.reach is not None:
            marked = np.flatnonzero(codes != PLAIN)
            size = len(codes) + 1
            enter = np.bincount(np.maximum(marked - self.reach, 0), minlength=size)
            leave = np.bincount(np.minimum(marked + self.reach + 1, len(codes)), minlength=size)
            near = np.cumsum(enter - leave)[:-1] > 0
        which = np.flatnonzero(near)
        if not len(which):
            return labels
        score = self.scores(codes, bounds, which)
        unsure = ~(score[:, :1] - score[:, 1:] > self.bound[1:]).all(1)
        at, score = which[unsure], score[unsure]
        if not len(at):
            return labels
        doc = np.searchsorted(bounds, at, side="right")
        head = np.ones(len(at), dtype=bool)
        head[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(head)
        lens = np.diff(np.append(first, len(at)))
        edge = np.zeros(len(codes) + 1, dtype=bool)
        edge[bounds] = True
        for n in np.unique(lens).tolist():
            runs = first[lens == n]
            s = score[runs[:, None] + np.arange(n)[None, :]]
            s[:, 0] += np.where(edge[at[runs]][:, None], 0.0, self.trans[0][None, :])
            s[:, -1] += np.where(edge[at[runs + n - 1] + 1][:, None], 0.0, self.trans[:, 0][None, :])
            labels[at[runs][:, None] + np.arange(n)[None, :]] = viterbi(s, self.trans)
        return labels


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label paths of a batch of sequences of one length: scores [batch, length, labels]."""
    k, n, _ = scores.shape
    best = scores[:, 0]
    back = np.zeros(scores.shape, np.int8)
    for t in range(1, n):
        step = best[:, :, None] + trans[None]
        back[:, t] = step.argmax(1)
        best = step.max(1) + scores[:, t]
    path = np.zeros((k, n), np.int8)
    path[:, -1] = best.argmax(1)
    rows = np.arange(k)
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = back[rows, t, path[:, t]]
    return path


@lru_cache(maxsize=2)
def train(seed: int = 7, rounds: int = 250, ridge: float = 0.02) -> ShapeCrf:
    """Fit the CRF on the labelled table by gradient steps on its regularised likelihood (driver, about a second)."""
    rows = labelled_table(seed)
    size, far, labels = len(rows), max(len(t) for t, _ in rows), len(LABELS)
    texts = pa.array([" ".join(t) for t, _ in rows])
    codes, _, _, bounds = shapes(*text_bytes(texts))
    grid = np.full((size, far + 2), -1)
    gold = np.zeros((size, far), np.int64)
    for i, (_, y) in enumerate(rows):
        grid[i, 1:1 + len(y)] = codes[bounds[i]:bounds[i + 1]]
        gold[i, :len(y)] = y
    inside = grid[:, 1:-1] >= 0
    edges = np.concatenate([[0], np.cumsum(_SIZES)])
    features = int(edges[-1])
    values = np.zeros((CODES, len(ATTRIBUTES)), np.int64)
    for a in range(len(ATTRIBUTES)):
        values[:, a] = edges[a] + np.arange(CODES) // _STRIDES[a] % _SIZES[a]
    hot = np.zeros((size, far, 3, features), np.float32)
    for place in range(3):
        c = grid[:, place:place + far]
        ok = (c >= 0) & inside
        r, t = np.nonzero(ok)
        for a in range(len(ATTRIBUTES)):
            hot[r, t, place, values[c[ok], a]] = 1
    x = hot.reshape(size * far, -1).astype(np.float64)
    w = np.zeros((x.shape[1], labels))
    trans = np.zeros((labels, labels))
    onehot = np.eye(labels)[gold] * inside[:, :, None]
    pairs = inside[:, 1:] & inside[:, :-1]
    seen = np.einsum("bti,btj,bt->ij", onehot[:, :-1], onehot[:, 1:], pairs.astype(float))
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    for it in range(1, rounds + 1):
        e = (x @ w).reshape(size, far, labels)
        fwd = np.zeros_like(e)
        bwd = np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, far):
            s = fwd[:, t - 1][:, :, None] + trans[None]
            top = s.max(1)
            fwd[:, t] = np.where(inside[:, t][:, None], e[:, t] + top + np.log(np.exp(s - top[:, None]).sum(1)),
                                 fwd[:, t - 1])
        for t in range(far - 2, -1, -1):
            s = trans[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :]
            top = s.max(2)
            bwd[:, t] = np.where(inside[:, t + 1][:, None], top + np.log(np.exp(s - top[:, :, None]).sum(2)), 0.0)
        last = fwd[:, -1]
        z = last.max(1) + np.log(np.exp(last - last.max(1)[:, None]).sum(1))
        p = np.exp(fwd + bwd - z[:, None, None]) * inside[:, :, None]
        both = np.exp(fwd[:, :-1, :, None] + trans[None, None] + (e + bwd)[:, 1:, None, :] - z[:, None, None, None])
        expected = (both * pairs[:, :, None, None]).sum((0, 1))
        grads = [(x.T @ (p - onehot).reshape(size * far, labels)) / size + ridge * w / 10,
                 (expected - seen) / size + ridge * trans / 10]
        for i, (param, g) in enumerate(zip((w, trans), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            param -= 0.1 * (m[i] / (1 - 0.9 ** it)) / (np.sqrt(v[i] / (1 - 0.999 ** it)) + 1e-8)
    table = w.reshape(3, features, labels)
    emit = np.stack([table[k][values].sum(1) for k in range(3)])
    return ShapeCrf(emit, trans)


# ---- the operator -------------------------------------------------------------------------------

_EDGE = " \t\r\n\v\f.,;:!?\"'<>|*#&$%=()[]"


#: An address with its marks spelled out: brackets around "at", or bare words that name both "at" and "dot".
_ADDRESS = re.compile(r"[a-z0-9._%+-]+(?:@|\s*[(\[]at[)\]]\s*)[a-z0-9-]+(?:(?:\.|\s*[(\[]dot[)\]]\s*|\sdot\s)[a-z0-9-]+)*"
                      r"|[a-z0-9._%+-]+ at [a-z0-9-]+(?: dot [a-z0-9-]+)+")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{16,}")


def _opaque(text: str) -> tuple[int, int] | None:
    """The longest stretch of letters and digits that can be a secret: both many, and often in turn."""
    best = max(_OPAQUE.finditer(text), key=lambda m: m.end() - m.start(), default=None)
    if best is None:
        return None
    kinds = ["d" if c in "0123456789" else "a" for c in best.group() if c.isalnum()]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return best.span() if turns >= 6 and min(kinds.count("d"), kinds.count("a")) >= 4 else None


def _sound(kind: int, text: str) -> bool:
    """Whether a proposed span can be of its kind at all."""
    digits = "".join(_DIGITS.findall(text))
    if kind == 0:
        return bool(_ADDRESS.fullmatch(text.lower()))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == SECRET:
        return True  # _opaque has looked at it
    return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z@]", text)


def find_spans(texts: pa.Array, model: ShapeCrf) -> list[tuple[list, list]]:
    """For each text (base spans, added spans), each (start, kind, end) in code points."""
    buf, offsets = text_bytes(texts)
    codes, starts, ends, bounds = shapes(buf, offsets)
    labels = model.decode(codes, bounds)
    marked = np.flatnonzero(labels)
    doc_of = np.searchsorted(bounds, marked, side="right") - 1
    proposed: dict[int, list] = {}
    for t, d in zip(marked.tolist(), doc_of.tolist(), strict=True):
        own = proposed.setdefault(d, [])
        if own and own[-1][2] == t - 1 and own[-1][0] == labels[t]:
            own[-1][2] = t
        else:
            own.append([int(labels[t]), t, t])
    out = []
    for i, text in enumerate(texts.to_pylist()):
        base = base_spans(text)
        added = []
        if i in proposed:
            a, b = int(offsets[i]), int(offsets[i + 1])
            points = np.cumsum((buf[a:b] & 0xC0) != 0x80)  # code points up to and with each byte
            for label, s, e in proposed[i]:
                lo = int(points[starts[s] - a]) - 1
                hi = int(points[ends[e] - a - 1])
                while lo < hi and text[lo] in _EDGE and not (label == 4 and text[lo] == "("):
                    lo += 1
                while hi > lo and text[hi - 1] in _EDGE:
                    hi -= 1
                if label - 1 == SECRET:
                    part = _opaque(text[lo:hi])
                    lo, hi = (lo + part[0], lo + part[1]) if part else (lo, lo)
                if hi > lo and _sound(label - 1, text[lo:hi]) and not any(x < hi and lo < y for x, _, y in base):
                    added.append((lo, label - 1, hi))
        out.append((base, added))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_FOUND = StructType([StructField(f"n_{n}", LongType()) for n in (*KINDS, "added")]
                    + [StructField(n, StringType()) for n in ("base_sha256", "spans", "secrets")])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_added, base_sha256, spans, secrets) of every whole text.

    ``n_email`` to ``n_phone`` count base spans and ``n_added`` those of the
    four kinds that only the CRF finds, which ``spans`` holds with the base
    ones. Passwords, keys and tokens have no base pattern: ``n_secret`` and
    ``secrets`` are the CRF's. An added span never overlaps a base one. Texts are worked through
    in their task and nothing is shuffled. Null and empty texts have no spans;
    repeated rows are searched each; null doc_ids stay; an empty table gives
    an empty result; extra columns are ignored.
    """
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train())

    def find(batches):
        for batch in batches:
            for part in text_slices(batch, _SLICE):
                found = find_spans(part.column(1), held.value)
                counts = [[sum(1 for _, k, _ in base if k == kind) for base, _ in found] for kind in range(4)]
                added = [[x for x in a if x[1] != SECRET] for _, a in found]
                secrets = [[x for x in a if x[1] == SECRET] for _, a in found]
                sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array([len(a) for a in secrets], pa.int64()), pa.array([len(a) for a in added], pa.int64()),
                     pa.array(sha, pa.string()),
                     pa.array([_joined(b + a) for (b, _), a in zip(found, added, strict=True)], pa.string()),
                     pa.array([_joined(a) for a in secrets], pa.string())],
                    names=["doc_id", *_FOUND.names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(find, StructType([rows.schema["doc_id"], *_FOUND.fields]))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every found span replaced by its kind in brackets, e.g. ``[EMAIL]``.

    Null, empty and repeated texts stay as they are; all columns pass through, whatever they are called.
    """
    ship_package(docs.sparkSession)
    names, docs = docs.columns, plain_names(docs)
    held = docs.sparkSession.sparkContext.broadcast(train())

    def clean(batches):
        for batch in batches:
            for part in text_slices(batch, _SLICE):
                at = part.schema.get_field_index("text")
                col = part.column(at)
                found = find_spans(col.fill_null("") if col.null_count else col, held.value)
                texts = col.to_pylist()
                for i, (base, added) in enumerate(found):
                    if base or added:
                        text, done, pieces = texts[i], 0, []
                        for s, k, e in sorted(base + added):
                            if s >= done:
                                pieces += [text[done:s], f"[{KINDS[k].upper()}]"]
                            elif e <= done:
                                continue
                            done = max(done, e)
                        texts[i] = "".join([*pieces, text[done:]])
                yield part.set_column(at, part.schema.field(at), pa.array(texts, col.type))

    return docs.mapInArrow(clean, docs.schema).toDF(*names)
