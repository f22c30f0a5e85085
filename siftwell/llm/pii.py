"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns (e-mail, IP address, card, phone) always hold. The random field
adds further kinds. It scores whole candidate segments of up to ``LONGEST`` tokens by
features of the span (its shape, digits, checksum, the words around it) and a dynamic
program over segment ends picks boundaries and kinds jointly: the best labelling of an
island, a run of tokens that can hold an entity at all. Tokens outside of islands,
and tokens of base matches, cannot be part of an added segment, so the program over
the islands is the program over the whole text. Weights are trained here by maximum
likelihood on generated lines.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import parts, released, table, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("masked_email", "national_phone", "ssn", "iban", "mac", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
#: Longest segment in tokens and in characters.
LONGEST, WIDEST = 8, 320
#: Characters before a segment in which its two words of context, or its cue, are looked for.
REACH = 40

# Base patterns. Possessive repeats and the look-behind cut only attempts that cannot match.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: each goes out from its @."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind, then start; matches that fail their check are dropped."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# What a segment of an added kind must be made of: characters and how many, not how they stand; that is for the field to weigh.
MADE_OF = {
    "masked_email": re.compile(r"[\w.+()\[\]{}-]+(?: [\w.+()\[\]{}-]+)*"),
    "national_phone": re.compile(r"\(?[0-9][0-9 ()./-]*[0-9]"),
    "ssn": re.compile(r"[0-9][0-9 .-]*[0-9]"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}[0-9A-Z ]*[0-9A-Z]"),
    "mac": re.compile(r"[0-9A-Fa-f]{2}[0-9A-Fa-f:.-]*[0-9A-Fa-f]"),
    "secret": re.compile(r"[A-Za-z0-9+/_.~-]+"),
}
# Words that stand before personal data in training lines, by kind.
CUES = {
    "masked_email": ["mail", "email", "e-mail", "contact", "write", "reach", "address"],
    "national_phone": ["phone", "tel", "telephone", "call", "mobile", "fax", "cell", "number", "text"],
    "ssn": ["ssn", "social", "security", "taxpayer", "id"],
    "iban": ["iban", "account", "bank", "transfer", "pay"],
    "mac": ["mac", "device", "hardware", "address", "adapter"],
    "secret": ["token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "credential", "bearer", "auth", "pass", "login"],
}
# Words that stand before other numbers and codes in training lines.
OTHER_CUES = ["order", "invoice", "page", "version", "item", "ticket", "score", "total", "ref", "no", "part", "isbn", "line", "row"]
CODE_CUES = ["commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "revision", "blob", "build", "file", "etag"]
#: Characters that end a token beside white space.
BREAKS = "\"'=<>,;|"
WORD = re.compile(rf"[^\s{BREAKS}]+")
#: What stands between a cue and a secret that may be of any characters, and such a secret; ``SAID`` are parts of cues, looked for first.
SAID = ("pass", "pwd", "token", "secret", "key", "credential", "auth", "bearer", "login")
CUE = r"(?:pass(?:word|wd|phrase|code)?|pwd|tokens?|secrets?|key|credentials?|auth|bearer|login)[\"']?\]?[ \t]*(?::=|=>|[:=])[ \t]*[\"']?"
CUED, CUE_END = re.compile(rf"{CUE}([^\s{BREAKS}]{{6,}})", re.I), re.compile(rf"{CUE}\Z", re.I)
NUMBERED = re.compile(rf"[0-9@][^\s{BREAKS}]*")
AT, DOT = re.compile(r"[\[({]at[\])}]|\bat\b", re.I), re.compile(r"[\[({]dot[\])}]|\bdot\b", re.I)
#: A token that an IBAN can start, the groups after it, and a hardware address without digits.
COUNTRY = re.compile(r"[(\[{]*[A-Z]{2}[0-9]{2}[A-Z0-9]*")
GROUP = re.compile(rf" ([A-Z0-9]+)(?=[.:!?)\]}}]*(?![^\s{BREAKS}]))")
LETTER_MAC = re.compile(r"[A-Fa-f]{2}([:-])(?:[A-Fa-f]{2}\1){4}[A-Fa-f]{2}")
LEFT_TRIM, RIGHT_TRIM = "([{", ".:!?)]}"
#: Brackets that belong to a segment: of an area code, and around a masked sign.
OPENED, CLOSED = re.compile(r"\([0-9]+\)[ 0-9]|[\[({](?:at|dot)[\])}]", re.I), re.compile(r"[\[({](?:at|dot)[\])}]\Z", re.I)
CONTEXT = re.compile(r"[\w-]+")
RUN = re.compile(r"[0-9]+|[A-Z]+|[^\W\d_A-Z]+|[^\w]|_")


def iban_holds(s: str) -> bool:
    s = s.replace(" ", "").replace("-", "")
    try:
        return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    except ValueError:
        return False


def shape(span: str) -> str:
    """Runs of digits, capitals and other letters with their lengths (up to twelve), and what stands between."""
    out = []
    for m in RUN.findall(span):
        kind = "d" if m[0].isdigit() else "A" if m[0].isupper() else "a" if m[0].isalpha() else ""
        out.append(f"{kind}{min(len(m), 12)}" if kind else m)
    return "".join(out)


def plausible(kind: str, span: str, digits: int, size: int, cued: bool) -> bool:
    """Whether a segment can be of the kind at all, by what it is made of.

    ``cued``: it follows a cue of secrets and a colon or equals sign; then six characters of any sort can be a
    secret, else it takes twelve of ``MADE_OF``, a digit among them.
    """
    if kind == "masked_email":
        return bool(size <= 7 and AT.search(span) and DOT.search(span)) and bool(MADE_OF[kind].fullmatch(span))
    if kind == "national_phone":
        return 7 <= digits <= 12 and bool(MADE_OF[kind].fullmatch(span))
    if kind == "ssn":
        return digits == 9 and bool(MADE_OF[kind].fullmatch(span))
    if kind == "iban":
        return 15 <= len(span) <= 42 and digits >= 4 and bool(MADE_OF[kind].fullmatch(span))
    if kind == "mac":
        return 12 <= len(span) <= 17 and bool(MADE_OF[kind].fullmatch(span) and (digits or LETTER_MAC.fullmatch(span)))
    if size > 1:
        return False
    return (cued and len(span) >= 6) or (len(span) >= 12 and 0 < digits < len(span) and bool(MADE_OF[kind].fullmatch(span)))


def span_features(kind: str, span: str, before: list[str], after: str, size: int, cued: bool = False) -> list[str]:
    """Features of a whole candidate segment and its surroundings."""
    digits = [c for c in span if c.isdigit()]
    out = [kind, f"{kind}|tokens={size}", f"{kind}|digits={min(len(digits), 16)}"]
    out += sorted({f"{kind}|word={w}" for b in before for w in (b.lower(), *re.split("[_-]", b.lower()))})
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    out.append(f"{kind}|marks={marks}")
    if len(set(digits)) == 1:
        out.append(f"{kind}|one-digit")
    if (before and before[-1][-1:].isdigit()) or after[:1].isdigit():
        out.append(f"{kind}|among-numbers")
    if kind in ("national_phone", "ssn", "mac"):
        out.append(f"{kind}|shape={shape(span) if kind != 'mac' else ''.join(c if c in ':.-' else 'h' for c in span)}")
    elif kind == "iban":
        out += [f"iban|sum={iban_holds(span)}", f"iban|country={span[2:4].isdigit()}", f"iban|groups={all(len(g) == 4 for g in span.split(' ')[:-1])}"]
    elif kind == "masked_email":
        parts = AT.split(span)
        out.append(f"masked_email|bracket={any(c in span for c in '[({')}")
        out.append(f"masked_email|parts={len(parts)},{min(len(DOT.split(parts[-1])), 4)}")
        out.append(f"masked_email|lead={min(len(parts[0].split()), 3)},{min(len(span.split()), 8)}")
        out.append(f"masked_email|top={min(len(DOT.split(span)[-1].strip()), 6)},{' ' in DOT.split(span)[-1].strip()}")
    if kind == "ssn":
        out.append(f"ssn|area={span[:3] not in ('000', '666') and span[0] != '9' and span[4:6] != '00'}")
    if kind == "secret":
        letters = [c for c in span if c.isalpha()]
        cases = ("l" if any(c.islower() for c in letters) else "") + ("u" if any(c.isupper() for c in letters) else "")
        hexes = all(c in "0123456789abcdefABCDEF" for c in span)
        turns = len(RUN.findall(span))
        out += [f"secret|cases={cases}", f"secret|hex={hexes}", f"secret|size={min(len(span) // 4, 12)}", f"secret|turns={min(10 * turns // len(span), 7)}"]
        out += [f"secret|start={span[:4] if span[:4].isalpha() and span[:4].isupper() else ''}", f"secret|hex={hexes},size={min(len(span) // 4, 12)},cases={cases}"]
        out.append(f"secret|words={max(map(len, re.findall('[a-z]+|[A-Z]+', span)), default=0) > 5}")
        sorts = cases + ("d" if digits else "") + ("m" if any(not c.isalnum() for c in span) else "")
        out += [f"secret|cued={cued}", f"secret|cued={cued},sorts={sorts}", f"secret|cued={cued},sorts={sorts},size={min(len(span) // 4, 6)}"]
        out.append(f"secret|distinct={min(len(set(span)), 8)}")
        lead = re.match("([A-Za-z]{2,4})[_-]", span)
        out += [f"secret|cued={cued},hex={hexes and bool(digits)}", f"secret|cued={cued},lead={lead[1] if lead else ''}"]
        out.append(f"secret|cued={cued},plain={span.isalpha() and (span[1:].islower() or span.isupper())}")
    return out


def islands(text: str, blocked: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens (start, end) that can hold an added entity.

    These are tokens with a digit or @, whatever follows a cue of secrets and a colon or equals sign, groups after the country of an IBAN, hardware addresses
    of letters only, and what stands around a masked dot. Neighbours have one space or tab runs
    between them, no line break.
    """
    inside = lambda i: not text[i].isspace() and text[i] not in BREAKS
    tokens: dict[int, int] = {}
    for m in NUMBERED.finditer(text):
        start = m.start()
        while start > 0 and inside(start - 1):
            start -= 1
        tokens[start] = m.end()
    low = text.lower()
    if any(w in low for w in SAID):
        for m in CUED.finditer(text):
            start, at = m.start(1), m.start(1)
            while at > 0 and inside(at - 1):
                at -= 1
            tokens.pop(at, None)  # with the cue before it
            tokens[start] = m.end(1)
    for start, end in list(tokens.items()):
        if COUNTRY.fullmatch(text, start, end):
            for _ in range(LONGEST - 1):  # groups of letters too
                m = GROUP.match(text, end)
                if not m:
                    break
                end = WORD.match(text, m.start(1)).end()
                tokens.setdefault(m.start(1), end)
    for m in LETTER_MAC.finditer(text) if text.count(":") > 4 or text.count("-") > 4 else ():
        start = m.start()
        while start > 0 and inside(start - 1):
            start -= 1
        tokens[start] = WORD.match(text, start).end()
    if "dot" in text.lower() and DOT.search(text) and AT.search(text):
        every = [m.span() for m in WORD.finditer(text)]
        starts = [a for a, _ in every]
        for m in DOT.finditer(text):
            k = bisect.bisect_right(starts, m.start()) - 1
            for a, b in every[max(0, k - LONGEST + 2) : k + LONGEST - 1]:  # whatever a segment with this dot can reach
                tokens.setdefault(a, b)
    out: list[list[tuple[int, int]]] = []
    last, b = -1, 0
    blocked = sorted(blocked)
    for start in sorted(tokens):
        end = tokens[start]
        if start < last:
            continue
        while b < len(blocked) and blocked[b][1] <= start:
            b += 1
        if b < len(blocked) and blocked[b][0] < end:
            last = -1
            continue
        if out and last >= 0 and text[last:start].isspace() and "\n" not in text[last:start]:
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
        last = end
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str, int, int, list[str]]]:
    """Segments of an island that can be of a kind: (first, past last token, kind, start, end, features).

    The field's segments have at most ``LONGEST`` tokens and ``WIDEST`` characters.
    """
    out = []
    for i, (start, _) in enumerate(tokens):
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            s, e = start, tokens[j - 1][1]
            if e - s > WIDEST:
                break
            while s < e and text[s] in LEFT_TRIM and not OPENED.match(text, s, e):
                s += 1
            while s < e and text[e - 1] in RIGHT_TRIM and not CLOSED.search(text, s, e):
                e -= 1
            span = text[s:e]
            digits = len(DIGITS.findall(span))
            cued = j - i == 1 and e - s >= 6 and bool(CUE_END.search(text, max(0, s - REACH), s))
            for kind in ADDED_KINDS:
                if plausible(kind, span, digits, j - i, cued):
                    before = CONTEXT.findall(text[max(0, s - REACH) : s])[-2:]
                    out.append((i, j, kind, s, e, span_features(kind, span, before, text[e : e + 12].lstrip(), j - i, cued)))
    return out


class SegmentField:
    """Log-linear model over segmentations of an island; a token outside of segments has weight 0."""

    def __init__(self):
        self.w: dict[str, float] = {}

    def score(self, features: list[str]) -> float:
        return sum(self.w.get(f, 0.0) for f in features)

    def best(self, n: int, segments: list) -> list:
        """Segments of the heaviest labelling (ties: fewer segments)."""
        ends: dict[int, list] = {}
        for s in segments:
            ends.setdefault(s[1], []).append((self.score(s[5]), s))
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for weight, s in ends.get(j, ()):
                if top[s[0]] + weight > top[j]:
                    top[j], back[j] = top[s[0]] + weight, s
        out, j = [], n
        while j > 0:
            s = back[j]
            if s:
                out.append(s)
            j = s[0] if s else j - 1
        return out[::-1]

    def expected(self, n: int, segments: list) -> list[float]:
        """Each segment's probability, by the forward and backward sums over segment ends."""
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        weights = [self.score(s[5]) for s in segments]
        forward = [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = forward[j - 1]
            for s, w in zip(segments, weights, strict=True):
                if s[1] == j:
                    forward[j] = add(forward[j], forward[s[0]] + w)
        backward = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            backward[i] = backward[i + 1]
            for s, w in zip(segments, weights, strict=True):
                if s[0] == i:
                    backward[i] = add(backward[i], w + backward[s[1]])
        return [math.exp(forward[s[0]] + w + backward[s[1]] - forward[n]) for s, w in zip(segments, weights, strict=True)]

    def fit(self, lines: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 12, rate: float = 0.5, penalty: float = 1e-3) -> None:
        """Maximum likelihood by adaptive gradient steps; ``lines``: texts with their true spans."""
        cases = []
        for text, spans in lines:
            truth = set(spans)
            for tokens in islands(text, []):
                found = candidates(text, tokens)
                if found:
                    cases.append((len(tokens), found, [float((s[2], s[3], s[4]) in truth) for s in found]))
        squares: dict[str, float] = {}
        for _ in range(epochs):
            for n, found, truth in cases:
                slope: dict[str, float] = {}
                for s, t, p in zip(found, truth, self.expected(n, found), strict=True):
                    for f in s[5]:
                        slope[f] = slope.get(f, 0.0) + t - p
                for f, g in slope.items():
                    g -= penalty * self.w.get(f, 0.0)
                    squares[f] = squares.get(f, 1e-8) + g * g
                    self.w[f] = self.w.get(f, 0.0) + rate * g / math.sqrt(squares[f])


def training_lines(n: int = 2400, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated lines with and without personal data, and where it stands.

    Entities come from layouts as people write them, other numbers and codes from
    layouts that resemble them; neither comes from what ``plausible`` asks.
    """
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    capitals = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def iban(good: bool) -> str:
        country, rest = rng.choice(["DE", "FR", "ES", "GB"]), d(rng.choice([14, 16, 18, 20, 23]))
        if rng.random() < 0.4:  # the bank's code in letters
            country, rest = rng.choice(["GB", "NL", "IE", "BG", "MT"]), "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + rest[4:]
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        s = f"{country}{(check if good else (check + 7) % 97):02d}{rest}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    def masked() -> str:
        at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" AT ", " DOT ")])
        name = rng.choice([word(), f"{word()}.{word()}", f"{word()}{d(2)}"])
        return f"{name}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'io'])}"

    make = {
        "masked_email": masked,
        "national_phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)} {d(3)}-{d(4)}", f"0{d(3)} {d(6)}", f"0{d(2)}/{d(7)}"]),
        "ssn": lambda: f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randint(1, 99):02d}-{d(4)}",
        "iban": lambda: iban(True),
        "mac": lambda: rng.choice([":", "-"]).join(f"{rng.randrange(256):02x}" for _ in range(6)) if rng.random() < 0.8 else f"{h(4)}.{h(4)}.{h(4)}",
        "secret": lambda: rng.choice([h(rng.choice([16, 18, 20, 24, 32, 40, 64])), mixed(rng.randint(16, 44)), f"{rng.choice(['AKIA', 'ASIA'])}{capitals(16)}", f"ghp_{mixed(36)}", f"sk-{mixed(40)}", f"{mixed(20)}/{mixed(19)}"]),
    }
    # The layouts of numbers and codes that are not personal data.
    other = [
        lambda: f"{d(3)} {d(3)} {d(4)} {d(3)} {d(2)} {d(4)}",
        lambda: f"{d(3)} {d(2)} {d(4)}",
        lambda: f"000-{d(2)}-{d(4)}",
        lambda: f"9{d(2)}-00-{d(4)}",
        lambda: iban(False),
        lambda: f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}",
        lambda: f"{d(1)}.{d(2)}.{d(3)}",
        lambda: f"{d(3)} {d(3)} {d(4)}",
        lambda: "000-000-0000",
        lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: d(rng.randint(1, 12)),
        lambda: f"{d(2)}.{d(2)}.{d(4)}",
        lambda: f"{d(4)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}Z",
        lambda: f"{word()}-{word()}-{d(4)}",
        lambda: f"{word()}_{word()}_{word()}{d(1)}",
        lambda: f"{word()}.{word()}.{d(2)}/{word()}",
        lambda: f"{word().upper()}{word().upper()}{d(2)}",
        lambda: f"{d(3)},{d(3)}.{d(2)}",
        lambda: f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}",
    ]
    marks = lambda: rng.choice("!#$%&*@_-+?^~")
    letters = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(k))
    # Secrets that only their cue tells from other text.
    chosen = [
        lambda: f"{word()}{d(rng.randint(1, 4))}{word()}",
        lambda: f"{word().capitalize()}{marks()}{word()}{d(rng.randint(2, 4))}",
        lambda: f"{word()}{d(2)}{marks()}{marks()}",
        lambda: (word() + word()).translate(str.maketrans("aeio", "@310")) + rng.choice(["", d(2)]),
        lambda: "".join(rng.choice("abcdeghknprstuxyzABCDEGHKNPRSTXYZ23456789!#$%&*@_-+?^~") for _ in range(rng.randint(8, 24))),
        lambda: "-".join(word() + word() for _ in range(4)),
        lambda: f"{rng.choice(['sk', 'pk', 'rk'])}_{rng.choice(['live', 'test'])}_{rng.choice([letters, mixed, lambda k: letters(k).lower()])(rng.randint(10, 30))}",
        lambda: letters(rng.randint(10, 32)),
        lambda: mixed(rng.randint(10, 40)),
        lambda: d(rng.randint(6, 10)),
    ]
    # What stands after a cue and is no secret.
    named = [
        lambda: rng.choice(["required", "missing", "invalid", "string", "optional", "expired", "disabled", "unknown", "default", "number", "example", "changed"]),
        lambda: word() + word(),
        lambda: (word() + word()).capitalize(),
        lambda: (word() + word()).upper(),
        lambda: rng.choice("*x.-X_") * rng.randint(6, 12),
        lambda: f"{word()}_{word()}_{word()}",
        lambda: f"{word()}.{word()}.{word()}",
    ]
    codes = [lambda: h(rng.choice([12, 20, 32, 40, 64])), lambda: f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}"]
    prose = ["the", "we met at the dot on the map", "look at page", "a dot at the end", "in"]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(1, 6))), []
        for _ in range(rng.randint(1, 2)):
            chance = rng.random()
            if chance < 0.5:
                kind = rng.choice(ADDED_KINDS)
                cued = rng.random() < (0.9 if kind == "secret" else 0.6)
                s = make[kind]()
                if kind == "secret" and not cued:
                    s = f"{rng.choice(['AKIA', 'ASIA'])}{capitals(16)}"
                text += f" {rng.choice(CUES[kind]) if cued else word()}{rng.choice([' ', ' ', ': ', ' = ', '=', ' is ']) if cued else ' '}"
                quote = rng.choice(["", "", '"', "'"]) if kind == "secret" else ""
                text += quote
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + quote
            elif chance < 0.68:
                sign, quote = rng.choice([":", "=", ": ", " = ", " : ", "=> "]), rng.choice(["", "", '"', "'"])
                cue = rng.choice(["token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "credential", "auth", "pass", "login"])
                real = rng.random() < 0.6
                s = rng.choice(chosen if real else named)()
                text += f" {rng.choice(['', word() + '_'])}{cue}{sign}{quote}"
                if real and len(s) >= 6:
                    spans.append(("secret", len(text), len(text) + len(s)))
                text += s + quote
            elif chance < 0.76:
                text += f" {rng.choice(CODE_CUES)}{rng.choice([' ', ': ', '='])}{rng.choice(codes)()}"
            elif chance < 0.8:
                text += f" {rng.choice(prose)}"
            else:
                text += f" {rng.choice([*OTHER_CUES, word(), word()])} {rng.choice(other)()}"
            text += rng.choice(["", ".", ","]) + " " + " ".join(word() for _ in range(rng.randint(1, 4)))
        out.append((text, spans))
    return out


def quality(field: SegmentField, lines: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[float, float]:
    """(precision, recall) of added spans over labelled lines."""
    right = found = true = 0
    for text, spans in lines:
        own = {s for s in all_spans(text, field) if s[0] in ADDED_KINDS}
        right, found, true = right + len(own & set(spans)), found + len(own), true + len(spans)
    return right / max(1, found), right / max(1, true)


def fitted(seed: int = 11, lines: int = 2400) -> SegmentField:
    field = SegmentField()
    field.fit(training_lines(lines, seed))
    return field


def all_spans(text: str, field: SegmentField) -> list[tuple[str, int, int]]:
    """Base and added spans, by kind as listed, then start."""
    base = base_spans(text)
    added = []
    for tokens in islands(text, [(s, e) for _, s, e in base]):
        found = candidates(text, tokens)
        if found:
            added += [(s[2], s[3], s[4]) for s in field.best(len(tokens), found)]
    return base + sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


#: Bytes of text that are searched at a time.
SLICE = 1 << 21
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))


def with_spans(df: DataFrame, text: str = "text", to: str = "pii", field: SegmentField | None = None) -> DataFrame:
    """Add ``to``: array of (kind, start, end) in code points, end exclusive.

    Whole texts are read; null and empty texts have no spans. A column of that name is
    replaced.
    """
    model = field or fitted()

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts(batches, SLICE):
            yield pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t, model)] for t in texts.to_pylist()], FOUND)
        released()

    return df.withColumn(to, find(text_of(text)))


def redacted(df: DataFrame, text: str = "text", field: SegmentField | None = None) -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in angle brackets; overlaps become one.

    Null texts stay null.
    """
    model = field or fitted()

    def without(t: str | None) -> str | None:
        if t is None:
            return None
        kept, at = [], 0
        for kind, s, e in sorted(all_spans(t, model), key=lambda x: (x[1], -x[2])):
            if s >= at:
                kept += [t[at:s], f"<{kind.upper()}>"]
            at = max(at, e)
        return "".join([*kept, t[at:]])

    @F.arrow_udf(T.StringType())
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts(batches, SLICE):
            yield pa.array([without(t) for t in texts.to_pylist()], pa.string())
        released()

    return df.withColumn(text, redact(F.col(text)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_semi_markov_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document; the counts and ``base_sha256`` are of base matches, ``n_spans`` of all."""
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


QUERIES = {"op6_semi_markov_pii": op6_semi_markov_pii}
ORACLES: dict[str, str] = {}
