"""Secret scans: patterns for known forms, and a character convolutional network for the rest.

The base patterns always count. Every further candidate is read with its
context by a small network in numpy: a run of 16 or more key characters with
a letter and a digit, or of 20 or more with 12 letters in a row; a private-key
header; in URLs the password before an @ and the value of a parameter named
like a key, of any length and with any punctuation. Base matches are cut out
of candidates and the stretches beside them are candidates of their own; of a
URL value that a match cuts, all of them. What is left of a token that a match
cuts is read with the whole token, however short it is.
The driver trains the network on labelled findings that are generated from a
seed (`n_findings`, the bound of its training data): keys of many alphabets,
lengths and prefixes, bare, in settings, code and prose, against words, mail
addresses, paths, host names, identifiers, versions, UUIDs, sequences and file
names. A long candidate is read window by window and counts by its highest
window, in training too. A held-out part calibrates that score (Platt) and
sets the threshold: the highest with at least `recall` of the held-out secrets
found, and MOST_THRESHOLD at most.

Spans are in code points, end exclusive, and cover the whole match. Defined
cases: null text is empty and has no spans; repeated documents are scanned
each; a score at the threshold counts; a very long text or run is read whole,
window by window; an empty table gives no rows; columns named sc_* are
replaced, others pass through. There is no shuffle.
"""

from __future__ import annotations

import math
import random
import re
import string
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import add_arrays, with_columns

#: Base patterns (fixed values), in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "learned")
MIN_VALUE = 6

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}|-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
#: Values in URLs: the password before an @, a parameter named like a key.
IN_URL = re.compile(r"(?<=://)[^\s/?#@:\"'<>]*:([^\s/@\"<>]+)@|(?<=[?&])[\w.-]{0,40}?(?:pass|pwd|secret|token|key|auth|sig)[\w.-]{0,40}=([^\s&#\"'<>]+)", re.IGNORECASE | re.ASCII)
#: What follows is a file inside of the text, such as an image.
EMBEDDED = ";base64,"
MIN_RUN, MIN_LETTERS, LETTERS = 16, 20, re.compile("[A-Za-z]{12}")
RUN_BEFORE, RUN_AFTER = re.compile(r"[A-Za-z0-9+/_=.-]*\Z"), re.compile(r"[A-Za-z0-9+/_=.-]*")
#: A token around a base match, up to so many characters each way.
TOKEN, BEFORE_IT, AFTER_IT = 80, re.compile(r"[A-Za-z0-9_-]*\Z"), re.compile(r"[A-Za-z0-9_-]*")
BEFORE, INSIDE, AFTER = 24, 40, 12
MOST_THRESHOLD = 0.45
LENGTH = BEFORE + INSIDE + AFTER
WIDTH, FILTERS = 5, 24
SYMBOLS = string.ascii_letters + string.digits + "+/_=.-:;,\"'`()[]{}<>@#$%&*!? \n"
#: 0 is padding, 1 any other character; characters of the candidate have codes of their own.
CODE = {c: k + 2 for k, c in enumerate(SYMBOLS)}
CODES = len(SYMBOLS) + 2

ADDED = [
    T.StructField("sc_kinds", T.ArrayType(T.StringType())),
    T.StructField("sc_starts", T.ArrayType(T.LongType())),
    T.StructField("sc_ends", T.ArrayType(T.LongType())),
]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE] if "=" in text or ":" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans for the network: none overlaps a base span or another one."""
    in_url = [m.span(m.lastindex) for m in IN_URL.finditer(text)] if "://" in text or "=" in text else []
    out = list(beside(in_url, taken))
    for s, e in beside([m.span() for m in CANDIDATE.finditer(text)], sorted([*taken, *((s, e, "") for s, e in out)])):
        run = text[s:e]
        if text[max(0, s - len(EMBEDDED)) : s] == EMBEDDED:
            continue
        if run.startswith("-----BEGIN ") or (len(run) >= MIN_RUN and any(c.isdigit() for c in run) and any(c.isalpha() for c in run)) or (len(run) >= MIN_LETTERS and LETTERS.search(run)):
            out.append((s, e))
    return sorted(out)


def torn_tokens(text: str, taken: list[tuple[int, int, str]], found: list[tuple[int, int]]):
    """(token, stretch) for the stretches of tokens that a base span cuts, but for those among `found`."""
    known = set(found)
    for s, e, _ in taken:
        token = (s - len(BEFORE_IT.search(text[max(0, s - TOKEN) : s])[0]), e + len(AFTER_IT.match(text[e : e + TOKEN])[0]))
        if token != (s, e):
            for stretch in beside([token], taken):
                if stretch not in known:
                    known.add(stretch)
                    yield token, stretch


def beside(spans: list[tuple[int, int]], taken: list[tuple[int, int, str]]):
    """The stretches of `spans` (apart, in order) that no span in `taken` (by start) covers."""
    k, upto = 0, 0
    for s, e in spans:
        at = max(s, upto)
        while k < len(taken) and taken[k][0] < e:
            if at < taken[k][0]:
                yield at, taken[k][0]
            upto = max(upto, taken[k][1])
            at = max(at, upto)
            k += 1
        if at < e:
            yield at, e


def windows(text: str, start: int, end: int) -> list[list[int]]:
    """Codes of a candidate and its context, one row for every INSIDE characters of it."""
    rows = []
    for s in range(start, end, INSIDE):
        e = min(end, s + INSIDE)
        before, after = text[max(0, s - BEFORE) : s], text[e : e + AFTER]
        row = [0] * (BEFORE - len(before)) + [CODE.get(c, 1) for c in before]
        row += [CODE.get(c, 1) + CODES for c in text[s:e]] + [0] * (INSIDE - (e - s))
        rows.append(row + [CODE.get(c, 1) for c in after] + [0] * (AFTER - len(after)))
    return rows


#: Parts of invented words (fixed values).
ONSETS = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fl fr gl gr kl kn pl pr qu sch sh sk sl sp st str th tr tz".split() + [""] * 6
VOWELS = "a e i o u y ae ai au ea eau ee ei ia ie io oi oo ou ue".split()
ENDS = "n r s t l m nd ng nt st ch ck rd ll ss ment tion ing heit keit schaft ismo able ness".split() + [""] * 16


def generated_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, 1 for a secret), half of them secrets."""
    rng = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(rng.choices(alphabet, k=rng.randint(a, b)))
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alnum, b64 = low + up + digits, low + up + digits + "+/"
    word = lambda a=1, b=4: "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(ENDS) for _ in range(rng.randint(a, b)))
    prose = lambda a=2, b=6: " ".join(word() for _ in range(rng.randint(a, b)))
    joined = lambda mark, a=2, b=6: mark.join(word(1, 3) for _ in range(rng.randint(a, b)))
    number = lambda: str(rng.randint(0, 10 ** rng.randint(1, 6)))
    chosen = lambda: "".join([word().capitalize() if rng.random() < 0.5 else pick(alnum, 4, 10), pick("!$%^*~,;()" + alnum, 1, 4), pick(alnum, 1, 8)])

    def key() -> str:
        body = lambda a, b: pick(rng.choice([alnum, alnum, alnum, b64, alnum + "_-", low + digits, up + digits, low + up, up + "234567"]), a, b)
        return rng.choice([
            lambda: body(20, 64),
            lambda: body(20, 32),
            lambda: body(16, 24),
            lambda: pick(rng.choice([alnum, alnum, low + digits, up + digits, b64]), 16, 18),
            lambda: pick(rng.choice([alnum, alnum, alnum, low + digits]), 16, 17),
            lambda: pick(rng.choice([alnum, low + digits, low + digits]), 18, 26),
            lambda: pick(low + up, 28, 48),
            lambda: pick(low, 2, 6) + rng.choice("_-") + body(16, 48),
            lambda: pick(low, 2, 4) + rng.choice("_-") + word(1, 2) + rng.choice("_-") + body(18, 40),
            lambda: pick(low + up, 2, 4) + body(28, 40),
            lambda: pick(low, 2, 4) + "-" + pick(digits, 9, 12) + "-" + body(20, 28),
            lambda: "eyJ" + pick(b64[:-2] + "_-", 20, 40) + "." + pick(b64[:-2] + "_-", 30, 60) + "." + pick(b64[:-2] + "_-", 20, 43),
            lambda: pick(up, 2, 2) + "." + pick(alnum, 20, 24) + "." + pick(alnum + "_-", 36, 44),
            lambda: pick(b64, 40, 86) + "==",
            lambda: "-----BEGIN " + rng.choice(["RSA ", "EC ", "OPENSSH ", "PGP ", ""]) + "PRIVATE KEY-----",
        ])()

    def secret() -> tuple[str, str, str]:
        if rng.random() < 0.2:
            if rng.random() < 0.7:
                value = rng.choice([chosen, word, lambda: word() + rng.choice("-_.!") + word(), lambda: word() + pick(digits + "!", 1, 4), lambda: pick(low + up, 6, 20)])()
                return f"{rng.choice(['', prose() + ' '])}{rng.choice(['http', 'https', 'ftp', 'postgres', 'redis', 'amqp', 'mysql'])}://{rng.choice(['', word(), word()])}:", value, f"@{word()}{rng.choice(['', '.org', '.example.com'])}{rng.choice(['', '/', ':5432/', '/' + word()])}{rng.choice(['', ' ' + prose()])}"
            return f"{prose()} https://{word()}.com/{word()}?{rng.choice(['', 'id=7&'])}{rng.choice(['pass', 'pwd', 'auth', 'sig', 'accesskey'])}=", chosen(), rng.choice(["", " ", "&x=1 "]) + prose()
        before, after = rng.choice([
            ("", ""),
            ("", rng.choice("\n .,")),
            (rng.choice([up, low])[:1] + joined("_", 1, 3).upper() + "=", "\n"),
            (f"export {joined('_', 1, 3).upper()}=", "\n" + prose()),
            (f"{word()} = '", "'\n" + word()),
            (f'{word()}.{word()}("', '")'),
            (f'{word()} = {word().capitalize()}("', '")'),
            (f'"{word()}": "', '",'),
            (f"{word()}: ", "\n"),
            (f"Authorization: {rng.choice(['Bearer', 'Basic', 'bearer'])} ", "\n"),
            (prose() + " ", " " + prose()),
            (prose() + " ", rng.choice([".", ",", ". " + prose()])),
            (prose() + rng.choice([": ", " is ", " (", " key "]), rng.choice([")", ".", ""]) + " " + prose()),
        ])
        return before, key(), after

    def plain() -> tuple[str, str, str]:
        if rng.random() < 0.08:
            return f"{prose()} https://{word()}.com/{word()}?{rng.choice(['', 'id=7&'])}{rng.choice(['keyword', 'key', 'author', 'passage', 'design', 'keys'])}=", rng.choice([word, lambda: str(rng.randint(1, 2030)), lambda: word() + rng.choice("+-_") + word()])(), rng.choice(["", " ", "&x=1 "]) + prose()
        if rng.random() < 0.06:
            host = f"{word(1, 2)}{rng.choice(['', str(rng.randint(0, 99))])}.{word(1, 3)}{rng.choice(['', '.' + word(1, 2)])}.{rng.choice(['com', 'org', 'net', 'de', 'example'])}"
            return f"{prose(0, 4)} {joined('.', 1, 2)}{rng.choice(['', number()])}@", host + word() * (len(host) < 16), rng.choice(["", " ", ", ", ".\n"]) + prose(0, 3)
        hexes = lambda n: pick("0123456789abcdef", n, n)
        value = rng.choice([
            lambda: word(5, 9),
            lambda: word(5, 9).capitalize(),
            lambda: word(5, 8).upper(),
            lambda: word(4, 7) + rng.choice(["", number()]),
            lambda: word(3, 6) + rng.choice("-.=_") * rng.randint(1, 5) + rng.choice([number(), word()]),
            lambda: joined("-", 3, 7),
            lambda: joined("_", 3, 6) + rng.choice(["", "_" + number()]),
            lambda: joined("-", 2, 5) + "-" + number(),
            lambda: "".join(word(1, 2).capitalize() for _ in range(rng.randint(3, 7))) + rng.choice(["", number()]),
            lambda: word(1, 2) + "".join(word(1, 2).capitalize() for _ in range(rng.randint(2, 6))) + rng.choice(["", number()]),
            lambda: joined("_", 3, 6).upper() + rng.choice(["", "_" + number()]),
            lambda: rng.choice(["", "/", "./", "//"]) + joined("/", 2, 6) + rng.choice(["", ".html", ".py", "/" + number(), "/" + number() + ".jpg", "/index.php"]),
            lambda: "/".join([word(1, 2), str(rng.randint(1990, 2030)), f"{rng.randint(1, 12):02}", joined("-", 2, 6)]),
            lambda: f"{joined('.', 2, 4)}.{rng.choice(['com', 'org', 'net', 'de', 'io'])}{rng.choice(['', '/' + word() + number()])}",
            lambda: f"{word(1, 2)}{rng.randint(0, 99)}.{word()}.{rng.choice(['com', 'org', 'net', 'de'])}",
            lambda: f"{word()}-{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}-cp3{rng.randint(6, 13)}-{joined('_', 2, 3)}_{rng.randint(1, 2)}_{rng.randint(0, 30)}_x86_64.whl",
            lambda: f"{word()}{rng.randint(0, 9)}.{word()}.{word()}.org",
            lambda: f"{word()}.{word()}{number()}",
            lambda: f"{joined('-', 1, 2)}-{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}{rng.choice(['.tar.gz', '.zip', '-py3-none-any.whl', '-SNAPSHOT.jar', ''])}",
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-00{rng.choice(['Z', '.000Z', '+0000'])}",
            lambda: "-".join([hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)]),
            lambda: "-".join([hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)]),
            lambda: "-".join([hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)]).upper(),
            lambda: pick("ACGT", 16, 90) + rng.choice(["", number()]),
            lambda: pick("ACGT", 24, 60) + rng.choice(["", number()]),
            lambda: pick("acgt", 16, 60) + rng.choice(["", number()]),
            lambda: pick("ACDEFGHIKLMNPQRSTVWY", 24, 60),
            lambda: pick("ACDEFGHIKLMNPQRSTVWY"[:4], 16, 40) + number(),
            lambda: rng.choice(low + up) * rng.randint(16, 60) + rng.choice(["", number()]),
            lambda: (word(1, 1) + rng.choice(["", "-"])) * rng.randint(6, 12) + rng.choice(["", number()]),
            lambda: rng.choice(["-", "=", "_", ".", "-="]) * rng.randint(8, 20) + word() + rng.choice(["", number()]) + rng.choice(["-", "=", "_", "."]) * rng.randint(1, 20),
            lambda: pick(digits, 3, 6) + "".join(rng.choice("-./") + pick(digits, 2, 5) for _ in range(rng.randint(2, 5))) + rng.choice(["", "a", word(1, 1)]),
            lambda: f"{word()}={rng.randint(1, 99)}/{word()}={number()}/{word()}",
            lambda: low + digits,
            lambda: up + low,
            lambda: "".join(c + str(k) for k, c in enumerate(rng.sample(low, 9))),
        ])()
        value = "".join(c for c in value if c.isascii() and (c.isalnum() or c in "+/_=.-"))
        while len(value) < 16:
            value += rng.choice(".-_/") + word()
        before, after = rng.choice([("", ""), ("", "\n"), (prose() + " ", " " + prose()), (prose() + " ", rng.choice([".", ",", "\n"])), (prose() + " https:", ""), (word() + "@", " " + prose()), ("see ", ""), (f"{word()} = '", "'"), (f"{joined('_', 1, 3).upper()}=", "\n"), (f'"{word()}": "', '",'), (f'{word()}.{word()}("', '")'), (f'{word()} = {word().capitalize()}("', '")'), ("(", ")"), ("import ", "\n"), (f'src="', '"')])  # noqa: F541
        return before, value, after

    out = []
    for k in range(n):
        before, value, after = secret() if k % 2 else plain()
        text, start, end = before + value + after, len(before), len(before) + len(value)
        if "://" not in before and not value.startswith("-----BEGIN"):  # the run as the scan takes it
            start, end = start - len(RUN_BEFORE.search(before)[0]), end + len(RUN_AFTER.match(after)[0])
        out.append((text, start, end, k % 2))
    rng.shuffle(out)
    return out


class Network:
    """Convolution over character codes, ReLU, maximum and mean over places, one logit."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.1, (WIDTH, 2 * CODES, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def features(self, x: np.ndarray):
        places = LENGTH - WIDTH + 1
        z = sum(self.w[k][x[:, k : k + places]] for k in range(WIDTH)) + self.b
        a = np.maximum(z, 0)
        return a, np.concatenate([a.max(axis=1), a.mean(axis=1)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(x[k : k + 512])[1] @ self.v + self.c for k in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.float32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.shift)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        params = [self.w, self.b, self.v, self.c]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        places = LENGTH - WIDTH + 1
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), 64):
                xb, yb = x[order[k : k + 64]], y[order[k : k + 64]]
                a, f = self.features(xb)
                d = ((1 / (1 + np.exp(-(f @ self.v + self.c))) - yb) / len(xb)).astype(np.float32)
                grad_f = d[:, None] * self.v
                da = np.repeat(grad_f[:, None, FILTERS:] / places, places, axis=1)
                top = a.argmax(axis=1)
                np.add.at(da, (np.arange(len(xb))[:, None], top, np.arange(FILTERS)), grad_f[:, :FILTERS])
                da *= a > 0
                gw = np.zeros_like(self.w)
                flat = da.reshape(-1, FILTERS)
                for j in range(WIDTH):
                    one = np.zeros((2 * CODES, len(flat)), np.float32)
                    one[xb[:, j : j + places].ravel(), np.arange(len(flat))] = 1
                    gw[j] = one @ flat
                step += 1
                for p, g, m, s in zip(params, (gw, flat.sum(axis=0), f.T @ d, d.sum(keepdims=True)), first, second):
                    m *= 0.9
                    m += 0.1 * g
                    s *= 0.999
                    s += 0.001 * g * g
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, recall: float) -> None:
        """On the highest window of each candidate: Platt's scale and shift by Newton steps, then the highest threshold with that recall, MOST_THRESHOLD at most."""
        z = np.full(len(y), -np.inf)
        np.maximum.at(z, owner, self.logits(x).astype(np.float64))
        theta = np.array([1.0, 0.0])
        design = np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            theta -= np.clip(np.linalg.solve(hessian, design.T @ (p - y) + 1e-3 * (theta - [1, 0])), -2, 2)
        self.scale, self.shift = map(float, theta)
        found = np.sort(1 / (1 + np.exp(-(design @ theta)))[y == 1])
        self.threshold = min(MOST_THRESHOLD, float(found[math.floor((1 - recall) * len(found))])) if len(found) else MOST_THRESHOLD


def read_windows(findings: list[tuple[str, int, int, int]]):
    """(windows of all candidates, candidate of each, labels)."""
    rows = [windows(t, s, e) for t, s, e, _ in findings]
    return np.array([w for r in rows for w in r]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([f[3] for f in findings], np.float32)


@cache
def trained(n_findings: int = 20000, recall: float = 0.97, seed: int = 11, epochs: int = 4) -> Network:
    """A network trained on all windows of three quarters of the findings and calibrated on the rest."""
    rows, net = generated_findings(n_findings, seed), Network(seed)
    cut = 3 * len(rows) // 4
    x, owner, y = read_windows(rows[:cut])
    net.fit(x, y[owner], epochs, seed)
    net.calibrate(*read_windows(rows[cut:]), recall)
    return net


def scan_texts(texts: list[str | None], net: Network) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, by start, then kind as listed."""
    found, rows, owner = [], [], []
    for k, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        found.append(base)
        spans = candidates(text, base)
        for s, e in spans:
            got = windows(text, s, e)
            rows += got
            owner += [(k, s, e)] * len(got)
        for (first, last), (s, e) in torn_tokens(text, base, spans):
            at = first + (s - first) // INSIDE * INSIDE
            got = windows(text, at, min(last, first + -(-(e - first) // INSIDE) * INSIDE))
            rows += got
            owner += [(k, s, e)] * len(got)
    if rows:
        score = net.probability(np.array(rows))
        for k, s, e in sorted({o for o, p in zip(owner, score) if p >= net.threshold}):
            found[k].append((s, e, KINDS[3]))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return [sorted(x, key=lambda r: (r[0], order[r[2]])) for x in found]


def scan(docs: DataFrame, text_col: str = "text", **training) -> DataFrame:
    """`docs` with sc_kinds, sc_starts and sc_ends: the spans in order."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(**training))
    schema = with_columns(docs.schema, ADDED)

    def run(batches):
        net = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = scan_texts(part.column(part.schema.names.index(text_col)).cast(pa.string()).to_pylist(), net)
                yield add_arrays(part, schema, {
                    "sc_kinds": pa.array([[r[2] for r in x] for x in found], pa.list_(pa.string())),
                    "sc_starts": pa.array([[r[0] for r in x] for x in found], pa.list_(pa.int64())),
                    "sc_ends": pa.array([[r[1] for r in x] for x in found], pa.list_(pa.int64())),
                })

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", **training)
    row = F.arrays_zip("sc_kinds", "sc_starts", "sc_ends")
    text_of = lambda rows: F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["sc_kinds"], r["sc_starts"], r["sc_ends"])), ",")
    base = F.filter(row, lambda r: r["sc_kinds"] != KINDS[3])
    n = lambda kind: F.size(F.filter("sc_kinds", lambda k: k == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), n(KINDS[3]).alias("n_learned"), F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"), text_of(row).alias("spans"))


def masked(text: str | None, kinds: list[str], starts: list[int], ends: list[int]) -> str | None:
    """`text` with each stretch of spans replaced by the kind of its first."""
    out, at = [], 0
    for kind, s, e in zip(kinds, starts, ends):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **training) -> DataFrame:
    """`docs` with every span masked in the text; `length_col` follows the text where it exists."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(**training))
    schema = docs.schema

    def run(batches):
        net = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                column = part.column(part.schema.names.index(text_col))
                texts = column.to_pylist()
                found = scan_texts(texts, net)
                texts = [masked(t, [r[2] for r in x], [r[0] for r in x], [r[1] for r in x]) for t, x in zip(texts, found)]
                yield add_arrays(part, schema, {text_col: pa.array(texts, column.type)})

    out = docs.mapInArrow(run, schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out
