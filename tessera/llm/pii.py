"""Personal data in texts: four patterns, and a semi-Markov conditional random field that adds further spans.

The field scores whole segments: features of the candidate's characters and of what stands beside it. A dynamic
program over the tokens of a stretch of text chooses boundaries and kinds of all its segments together; entities have
MAX_TOKENS tokens at most. It runs around digits, the signs @ = : and -----, and words that tell a password, since
each entity that it knows holds one or follows one. Scores depend on segments only, so decoding the stretches decodes the text; none is cut.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone")
#: What the field can add to the patterns' kinds.
ADDED = ("secret", "ssn", "iban")
MAX_TOKENS = 12
#: Sentences that the field is trained on; they are made here, from SEED.
TRAINING_SENTENCES = 900
ROUNDS = 22
SEED = 11
#: Characters of an entity of several tokens at most; a stretch reaches as far beyond its digits and signs.
REACH = 48
#: Tokens that are scored at a time.
CHUNK = 512

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Letters and digits, also where single signs join them; runs of one sign.
_TOKEN = re.compile(r"[^\W_]+(?:[._+/!#$%^*~-][^\W_]+)*|([^\w\s])\1*|_+")
_SIGNS = re.compile(r"[0-9@=:]+")
_RULE = re.compile("-{5}")
#: A secret told in words, which needs neither digit nor sign.
_TOLD = re.compile(r"(?:passwor[dt]|kennwort|passphrase|passcode|contraseña|mot de passe)[ \t]+(?:is|ist|es|est)[ \t]", re.I)
_OWNER = re.compile(r"\b(?:my|your|his|her|our|their|mein|dein|ihr|unser|mi|tu|su|mon|ton|notre|votre|root|admin|wifi)(?: [^\W\d]+)? (?:passwor[dt]|kennwort|passphrase|passcode|contraseña|mot de passe) (?:is|ist|es|est) [\"']?$", re.I)
# Words after a cue that are no secret.
_EMPTY = frozenset("none null nil true false yes no empty unset required optional missing wrong invalid expired correct incorrect not too very safe secure weak strong lost stolen hidden stored changed reset known here there now still always never being the a an in on of to for at by with that this nicht kein falsch no pas fausse requis obligatorio".split())

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by start, then kind; leftmost and without overlap in each kind, in time linear in the text."""
    out = list(_emails(text))
    if _SIGNS.search(text):
        part = lambda x: len(x) <= 3 and int(x) <= 255 or int(x.lstrip("0")[:4] or 0) <= 255
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(part, m.groups()))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# -- the field ----------------------------------------------------------------------------------------------------

LABELS = ("", *KINDS, *ADDED)
_FEATURES = 1 << 13
#: Words that announce an entity.
_CUE = re.compile(
    r"(?P<secret>pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|auth)[ _-]?key|credential|bearer|contraseña|kennwort|passwort|mot de passe)"
    r"|(?P<ssn>\bssn|social security|tax[ _-]?(?:payer|id)|\btin\b)|(?P<digest>\bsha-?[0-9]{1,3}|checksum|\bcommit|digest|\betag|\bu?g?uid\b|uuid|revision)|(?P<iban>\biban|bank account|konto|compte|cuenta)|(?P<number>\bno\b|number|order|invoice|version|isbn|tel|phone|card|\bip\b)",
    re.I,
)
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)


@lru_cache(maxsize=1 << 18)
def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "big") % _FEATURES


@lru_cache(maxsize=1 << 16)
def _own_features(s: str, n: int) -> tuple[int, ...]:
    """Slots of the features of a segment's own characters; n is its number of tokens."""
    # its shape: runs of digits as 9, of letters as a, A (all capitals) or m (mixed), with lengths up to 5; other signs
    runs, digits, letters, lower, upper = [], 0, 0, False, False
    for c in _RUN.findall(s):
        first, k = c[0], len(c)
        if first.isdecimal():
            digits += k
            runs.append(f"9{min(k, 5)}")
        elif first.isalpha():
            letters += k
            low, high = c.islower(), c.isupper()
            lower, upper = lower or not high, upper or not low
            runs.append(f"{'A' if high else 'a' if low else 'm'}{min(k, 5)}")
        else:
            runs.append(" " if first.isspace() else first)
    size = min(len(s) // 4, 10)
    switches = min(9, 10 * len(runs) // max(1, len(s)))
    cue = _CUE.search(s)
    mixed = f"{lower:d}{upper:d}{digits > 0:d}"
    names = ["n=%d" % n, "shape=" + "".join(runs[:9]), "head=" + "".join(runs[:2]) + f"/{size}", f"mixed={mixed}/{size}", f"digits={min(digits, 30)}", f"letters={min(letters, 12)}/{digits > 0:d}", f"switches={switches}/{size}", f"inner={cue.lastgroup if cue else ''}/{n > 1:d}"]
    hexa = digits and letters and len(s) >= 12 and not set(s.lower()) - set("0123456789abcdef")
    names += [f"hex={bool(hexa):d}/{size}", f"luhn={14 <= digits <= 19 and not letters and luhn(re.sub('[^0-9]', '', s)):d}"]
    return tuple(_slot(x) for x in names)


@lru_cache(maxsize=1 << 16)
def _cue_before(before: str) -> tuple[str, str]:
    """The kind of the last cue in the characters before a segment, and the signs between them."""
    found = None
    for found in _CUE.finditer(before):
        pass
    if found is None:
        return "", ""
    gap = re.sub(r"""[\s"'`]+""", "", before[found.end() :].lower())
    return (found.lastgroup, gap) if len(gap) <= 3 else ("", "")


def _segment_features(text: str, start: int, end: int, n: int = 1) -> tuple[int, ...]:
    """Slots of the features of the whole segment text[start:end]."""
    s = text[start:end]
    cue, gap = _cue_before(text[max(0, start - 32) : start])
    left, right = text[start - 1] if start else "^", text[end] if end < len(text) else "$"
    side = lambda c: "a" if c.isalnum() else " " if c.isspace() else c
    digit, lower = any(c.isdigit() for c in s), s.islower() and s.isalpha()
    before = text[max(0, start - 48) : start]
    told = bool(_TOLD.search(before[-24:])) and bool(_OWNER.search(before))
    names = (f"told={told:d}/{n}/{s.lower() in _EMPTY:d}", f"empty={cue}/{s.lower() in _EMPTY:d}", f"cue={cue}{gap}", f"cue={cue}{gap}/{n}/{digit:d}{lower:d}", f"cue={cue}{gap}/{min(len(s) // 4, 6)}", f"left={side(left)}", f"right={side(right)}", f"sides={side(left)}{side(right)}/{n > 1:d}")
    return _own_features(s, n) + tuple(map(_slot, names))


def _segments(text: str, tokens: list[tuple[int, int]], first: int, last: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The candidate segments that end behind one of the tokens from first to last, as token ranges, and their feature slots."""
    keep, slots = [], []
    for j in range(first + 1, last + 1):
        end = tokens[j - 1][1]
        for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
            start = tokens[i][0]
            if i < j - 1:
                # an entity of several tokens has no line break, and a digit or sign
                if end - start > REACH or "\n" in text[start:end]:
                    break
                if not _SIGNS.search(text, start, end) and not _RULE.search(text, start, end):
                    continue
            keep.append((i, j))
            slots.append(_segment_features(text, start, end, j - i))
    return keep, np.array(slots, dtype=np.int64).reshape(len(keep), -1)


def _lattice(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Tokens of a text, its candidate segments and their feature slots."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    return tokens, *_segments(text, tokens, 0, len(tokens))


def _scores(weights: np.ndarray, slots: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Scores of segments by label; only single tokens can be outside of entities."""
    out = sum(weights[slots[:, k]] for k in range(slots.shape[1]))
    out[many, 0] = -np.inf
    return out


def best(text: str, weights: np.ndarray, lo: int = 0, hi: int | None = None) -> list[Span]:
    """The entities of the highest-scoring segmentation of text[lo:hi], which starts and ends beside white space.

    Tokens are scored CHUNK at a time, whatever the stretch's length; what is kept for each is its best last segment.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, len(text) if hi is None else hi)]
    total, back = [0.0] * (len(tokens) + 1), [(0, 0)] * (len(tokens) + 1)
    for c in range(0, len(tokens), CHUNK):
        segments, slots = _segments(text, tokens, c, min(c + CHUNK, len(tokens)))
        scores = _scores(weights, slots, np.array([j - i > 1 for i, j in segments], dtype=bool))
        labels, tops = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
        for (i, j), label, top in zip(segments, labels, tops, strict=True):
            value = total[i] + top
            if i == j - 1 or value > total[j]:  # a single token comes first
                total[j], back[j] = value, (i, label)
    out, j = [], len(tokens)
    while j:
        i, label = back[j]
        if label:
            out.append((tokens[i][0], tokens[j - 1][1], LABELS[label]))
        j = i
    return out[::-1]


def _sentences(rng: np.random.Generator) -> Iterator[tuple[str, list[Span]]]:
    """Made-up sentences with entities, and with words, numbers and signs that are none."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    many = lambda a, b: int(rng.integers(a, b))
    some = lambda n, chars: "".join(chars[i] for i in rng.integers(len(chars), size=n))
    low, cap, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    digits = lambda n: some(n, digit)
    word = lambda: pick(["the", "of", "in", "is", "and", "for", "with", some(many(2, 10), low), some(many(2, 10), low), some(1, cap) + some(many(2, 8), low), some(many(8, 16), low), some(many(2, 12), "aeioulnéñüçß")])
    words = lambda a, b: " ".join(word() for _ in range(many(a, b)))

    def card() -> str:
        body = pick("3456") + digits(14)
        body += next(c for c in digit if luhn(body + c))
        return pick([body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4))])

    def iban() -> str:
        body = some(2, cap) + digits(2) + pick(["", some(4, cap)]) + digits(many(11, 20))
        return pick([body, " ".join(body[i : i + 4] for i in range(0, len(body), 4))])

    def value() -> str:
        mixed = low + cap + digit
        return pick([some(many(8, 65), "0123456789abcdef"), some(many(8, 48), mixed), some(many(3, 9), low) + digits(many(1, 5)), some(many(3, 12), low), some(1, cap) + some(many(3, 8), low) + digits(many(1, 4)) + pick(["!", "#", ""]), some(many(8, 20), mixed) + pick("-_./+") + some(many(4, 20), mixed), some(many(4, 9), mixed), some(1, cap) + some(many(2, 8), low) + digits(1) + pick("!#$%^*~") + some(many(2, 10), low + cap), some(many(3, 9), mixed) + pick("!#$%^*~") + some(many(3, 9), mixed)])

    def known() -> str:
        """A secret that needs no cue."""
        mixed = low + cap + digit
        return pick([some(4, cap) + some(16, cap + digit), pick(["gh", "sk", "pk", "xo", "gl", "np"]) + some(1, low) + pick("_-") + some(many(20, 40), mixed), f"{some(2, low)}_{pick(['live', 'test', 'prod'])}_{some(many(16, 32), mixed)}", ".".join("ey" + some(many(8, 24), mixed) for _ in range(2)) + "." + some(many(16, 40), mixed + "-_").strip("-_"), some(pick([32, 40, 64]), "0123456789abcdef"), f"-----BEGIN {pick(['', 'RSA ', 'EC ', 'OPENSSH '])}PRIVATE KEY-----"])

    name = lambda: pick(["", "db_", "user ", "my "]) + pick(["password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "api key", "access_key", "auth key", "Password", "TOKEN", "API_KEY", "SECRET", "credential"])
    cued = lambda: (name() + pick(["=", ":", ": ", " = ", " : ", " is ", ' = "', ': "', "='"]), value())

    def secret() -> tuple[str, str]:
        before, v = cued()
        return (before, v if not before.endswith(" is ") or any(c.isdigit() for c in v) else v + digits(2)) if rng.random() < 0.5 else (pick(["", "", "Bearer ", "key ", "with ", "use "]), known())

    def told() -> tuple[str, str]:
        """A plain word, which only the words before make a secret."""
        whose = pick(["my", "your", "her", "his", "our", "root", "wifi", "mein", "mi", "mon", "my new", "our old"])
        return f"{whose} {pick(['password', 'passphrase', 'passcode', 'Passwort', 'Kennwort', 'contraseña', 'mot de passe'])} {pick(['is', 'is', 'ist', 'es', 'est'])} {pick(['', '', chr(34)])}", some(many(5, 13), low)

    hexa = "0123456789abcdef"
    uuid = lambda: "-".join(some(n, hexa) for n in (8, 4, 4, 4, 12))
    make = {
        "email": lambda: ("", f"{some(many(3, 9), low)}{pick(['.', '_', ''])}{pick([digits(2), some(3, low)])}@{some(many(3, 9), low)}.{pick(['com', 'org', 'co.uk', 'example.net'])}"),
        "ip": lambda: ("", ".".join(str(x) for x in rng.integers(1, 256, 4))),
        "card": lambda: ("", card()),
        "phone": lambda: ("", pick([f"+1 ({digits(3)}) 555-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(2)}-{digits(9)}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}"])),
        "secret": secret,
        "ssn": lambda: (pick(["", "", "SSN ", "ssn: ", "SSN=", "social security number "]), f"{digits(3)}-{digits(2)}-{digits(4)}") if rng.random() < 0.6 else (pick(["SSN ", "ssn: ", "SSN=", "ssn ", "social security number ", "social security no. ", "taxpayer ", "taxpayer id ", "tax id ", "TIN: "]), pick(["", " "]).join([digits(3), digits(2), digits(4)])),
        "told": told,
        "iban": lambda: (pick(["", "", "IBAN ", "iban: ", "account "]), iban()),
        "": lambda: ("", pick([
            f"version {digits(1)}.{digits(1)}.{digits(2)}", f"{pick(['19', '20'])}{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", digits(many(1, 14)), f"{word()} = {digits(2)}", f"BY-NC {digits(1)}.0", f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{word()}@", f"{digits(3)}.{digits(3)}", f"{digits(2)}%", f"({digits(1)})", f"{digits(4)}-{digits(4)}",
            f"{word()}={word()}", f"{some(many(1, 4), low)} = {some(many(1, 6), low)};", digits(17), f"{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{word()}: {word()} {word()}", f"note: {words(1, 5)}", f"{some(2, cap)}-{digits(4)}", f"{some(many(2, 5), cap)} {digits(3)}", f"http://{some(5, low)}.example.com/{some(5, low)}/{digits(3)}", f"{some(5, low)}_{digits(4)}_{some(4, low)}.pdf",
            f"{pick(['the', 'a', 'each'])} {pick(['token', 'secret', 'password', 'api key', 'credential'])} {pick(['is', 'was', 'has', 'of', 'in'])} {words(1, 4)}", f"{pick(['tokens', 'secrets', 'passwords', 'Secret', 'Token'])} {words(1, 4)}", f"{some(4, low)}{some(1, cap)}{some(5, low)}", f"{some(8, '0123456789abcdef')}-{some(4, '0123456789abcdef')}-{some(4, '0123456789abcdef')}", f"#{some(6, '0123456789abcdef')}", f"{digits(1)}{pick(['st', 'nd', 'th'])}", f"-----", f"{digits(2)} {digits(3)} {digits(3)}", f"{some(3, cap)}{digits(3)}", "license: MIT", f"password {pick(['required', 'reset', 'policy', 'manager'])}", f"{digits(5)}-{digits(4)}",
            f"{pick(['', '', 'id ', 'uuid: ', 'request ', 'uuid ', 'session id='])}{uuid()}", f"{pick(['', 'guid '])}{uuid().upper()}", uuid(), f"{pick(['sha256', 'sha1', 'SHA-256', 'commit', 'checksum', 'digest', 'etag', 'revision'])}{pick([' ', ': ', ':', '=', ' is '])}{some(pick([40, 64, 12, 7]), hexa)}", f"commit {some(40, hexa)}",
            f"{pick(['part', 'order', 'serial', 'ticket', 'invoice', 'case'])} {pick(['number ', 'no. ', '#', ''])}{pick([digits(9), digits(9), digits(3) + '-' + digits(4)])}", f"{pick(['etag', 'checksum', 'digest'])}: {chr(34)}{some(pick([32, 40]), hexa)}{chr(34)}",
            f"{name()}{pick([': ', '=', ' = ', ' is '])}{pick(['none', 'null', 'None', 'true', 'false', 'empty', 'required', 'optional', 'missing'])}", f"{pick(['my', 'your', 'the', 'their'])} password is {pick(['wrong', 'not', 'required', 'too', 'safe', 'lost', 'expired', 'the', 'weak', 'stored', 'hidden', 'known', 'here', 'invalid'])} {words(1, 3)}",
        ])),
    }
    kinds = [*list(make), "secret", "secret", "secret", "iban"]
    for i in range(TRAINING_SENTENCES):
        text, spans = words(1, 5) + " ", []
        for kind in (kinds[i % len(kinds)], "", ""):
            before, piece = make[kind]()
            text += before
            if kind:
                spans.append((len(text), len(text) + len(piece), "secret" if kind == "told" else kind))
            text += piece + ('"' if before.endswith('"') else "'" if before.endswith("'") else "") + pick([" ", ", ", ". ", "\n", "!! ", "; "]) + words(1, 4) + " "
        yield text, spans


@lru_cache(maxsize=1)
def trained() -> np.ndarray:
    """Weights (features x labels) by gradient ascent on the likelihood of the made-up sentences; the same each time."""
    rows, ends, gold, slots = [], [], [], []
    for k, (text, spans) in enumerate(_sentences(np.random.default_rng(SEED))):
        tokens, segments, own = _lattice(text)
        at = {x: i + len(rows) for i, x in enumerate(segments)}
        covered = set()
        for a, b, kind in spans:
            inside = [t for t, (x, y) in enumerate(tokens) if x < b and y > a]  # boundaries in a token move out to its own
            if inside and (inside[0], inside[-1] + 1) in at:
                gold.append((at[inside[0], inside[-1] + 1], LABELS.index(kind)))
                covered |= set(inside)
        gold += [(at[t, t + 1], 0) for t in range(len(tokens)) if t not in covered]
        rows += [(k, i, j) for i, j in segments]
        ends.append(len(tokens))
        slots.append(own)
    text, start, end = np.array(rows).T
    slots, ends, (right, label) = np.concatenate(slots), np.array(ends), np.array(gold).T
    by_end, by_start = ([np.flatnonzero(x == t) for t in range(ends.max() + 1)] for x in (end, start))
    every, flat = np.arange(len(ends)), slots.ravel()
    weights, squares = np.zeros((_FEATURES, len(LABELS))), np.full((_FEATURES, len(LABELS)), 1e-6)
    for _ in range(ROUNDS):
        scores = _scores(weights, slots, end - start > 1)
        whole = np.logaddexp.reduce(scores, axis=1)
        ahead, behind = np.full((2, len(ends), ends.max() + 1), -np.inf)
        ahead[:, 0] = behind[every, ends] = 0
        for g in by_end[1:]:  # forward and backward over all sentences at once
            np.logaddexp.at(ahead, (text[g], end[g]), ahead[text[g], start[g]] + whole[g])
        for g in by_start[::-1]:
            np.logaddexp.at(behind, (text[g], start[g]), behind[text[g], end[g]] + whole[g])
        change = -np.exp((ahead[text, start] + behind[text, end] - ahead[every, ends][text])[:, None] + scores)
        change[right, label] += 1
        step = np.stack([np.bincount(flat, np.repeat(change[:, x], slots.shape[1]), _FEATURES) for x in range(len(LABELS))], axis=1) - 0.02 * weights
        squares += step**2
        weights += 0.5 * step / np.sqrt(squares)
    return weights


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """The parts of the text around digits and signs, from white space to white space; what touches is one."""
    signs = sorted([*_SIGNS.finditer(text), *(_RULE.finditer(text) if "-----" in text else ()), *_TOLD.finditer(text)], key=lambda m: m.start())
    start = end = -1
    for m in signs:
        if m.end() <= end:
            continue
        a, b = max(m.start() - REACH, end, 0), min(len(text), m.end() + REACH)
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        b = _SOLID.match(text, b).end()
        if a <= end:
            end = b
            continue
        if end >= 0:
            yield start, end
        start, end = a, b
    if end >= 0:
        yield start, end


_SOLID = re.compile(r"\S*")


def spans(text: str, weights: np.ndarray) -> list[Span]:
    """The patterns' spans, and those of the field that overlap none of them, by start."""
    base = base_spans(text)
    taken = _merged(base)
    starts = [a for a, _ in taken]
    out = list(base)
    for lo, hi in _stretches(text):
        for a, b, kind in best(text, weights, lo, hi):
            if kind in ADDED:
                i = bisect_left(starts, b)
                if not i or taken[i - 1][1] <= a:
                    out.append((a, b, kind))
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def _merged(found: list[Span]) -> list[tuple[int, int]]:
    """Spans of any kind as intervals that do not overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _said(xs: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in xs)


def _tag(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column("text"):
                every = spans(x.as_py() or "", weights)
                base = [s for s in every if s[2] in KINDS]
                n = [sum(s[2] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(every), len(every)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:6]], pa.array(columns[6], pa.int64())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"])

    return run


def tagged(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for each row of docs(doc_id, text).

    n_spans counts all spans, those of the field included. spans lists kind:start:end in code points by start, end exclusive. A null or empty text has no spans. Rows are
    independent: nothing is shuffled, and repeated rows get equal results.
    """
    w = trained() if weights is None else weights
    return docs.select("doc_id", "text").mapInArrow(_tag(w), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets."""
    w = trained() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("text"):
                text, at, parts = x.as_py(), 0, []
                for a, e, kind in spans(text or "", w):
                    if a >= at:
                        parts += [text[at:a], f"<{kind}>"]
                        at = e
                out.append(None if text is None else "".join(parts) + text[at:])
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return tagged(read(spark, sf_dir, "documents").select("doc_id", F.col("text")))
