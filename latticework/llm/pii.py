"""Personal data and secrets: rules for four kinds, and boosted trees over candidate spans.

The rules (base spans) always count. Beside them, generators of high recall propose overlapping spans: addresses written
with "at" and "dot", dotted or bracketed numbers, IPv6-like groups, digit groups with any separators, base spans with what
belongs to them (a port or mask, an extension), and long codes that may be tokens, keys or passwords (kind secret, which has no
rule). Boosted trees look at a candidate's format (digits, groups, separators, check sums, entropy) and context (words before
it, characters around it); their calibrated probability decides, with a threshold for each kind. A candidate that cuts a base
span, lies in one, or overlaps a likelier candidate is dropped; one that holds base spans of its kind
within a longer one may stay.

No table holds labelled spans, so the trees learn from sentences made here by a seeded generator: invented words around
personal data in many spellings, and around look-alikes (versions, dates, prices, order numbers, codes, ISBNs, check sums).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted

KINDS = ("email", "ip", "card", "phone")
#: The kinds of all spans: those with rules, then those that only candidates have.
ALL_KINDS = (*KINDS, "secret")
#: Least share of true spans among the accepted ones, on the calibration sentences.
PRECISION = 0.98
SENTENCES = 6_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points, by start, then kind as listed; leftmost and not overlapping within a kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if 12 <= len(m.group()) and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_AT = r"(?:\s?[\[({<]\s?(?:[Aa][Tt]|@)\s?[\])}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:[Dd][Oo][Tt]|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)"
_CODE = r"A-Za-z0-9+/_\-"
#: kind, pattern, strings of which one stands in every text that the pattern can match, lower-cased (none: a digit does).
GENERATORS = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}"), ("at", "@")),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5}|/[0-9]{1,2})(?![0-9A-Za-z])"), ()),
    ("phone", re.compile(r"\+[0-9][ ().0-9-]{6,24}[0-9][ ,;]{0,2}(?:ext|EXT|Ext|x|X)\.?[ ]?[0-9]{1,6}(?![0-9A-Za-z])"), ()),
    ("secret", re.compile(rf"(?<![{_CODE}=])(?=[A-Za-z+/_-]{{0,60}}[0-9])[{_CODE}]{{16,256}}={{0,2}}(?![{_CODE}=])"), ()),
    ("secret", re.compile(r"(?i)(?:password|passwd|pwd|passphrase|secret|api[ _-]?key|token)[\"']?\s?[:=]\s?[\"']?([^\s\"',;]{6,256})"), ("passw", "pwd", "passphrase", "secret", "key", "token")),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?[\[({]\.[\])}]\s?[0-9]{1,3}){3}(?![0-9A-Za-z])"), ("[.]", "(.)", "{.}")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])"), ()),
    ("card", re.compile(r"(?<![0-9A-Za-z.+])[0-9]{4,6}(?:[ ._/-]{1,3}[0-9]{3,7}){2,4}(?![0-9A-Za-z])"), ()),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[ .-]?|00[ -]?)?[0-9]{0,4}[ .-]?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])"), ()),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{9,12}(?![0-9A-Za-z])"), ()),
)
#: Words before a span that speak for a kind, or against any.
CUES = (
    ("mail", "e-mail", "email", "contact", "write"), ("ip", "host", "server", "address", "addr", "node", "login"), ("card", "visa", "amex", "mastercard", "payment", "paid", "credit"),
    ("phone", "tel", "call", "fax", "mobile", "cell", "telephone", "ring", "dial"),
    ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api-key", "auth", "bearer", "credential", "credentials", "passphrase", "api", "access"),
    ("commit", "checksum", "md5", "sha", "digest", "hash", "etag", "uuid", "guid", "revision", "blob", "fingerprint"),
    ("version", "v", "isbn", "order", "invoice", "no", "id", "date", "section", "chapter", "page", "pages", "price", "usd", "eur", "ref", "serial", "build", "release", "figure", "year"),
)
_WORDS = re.compile(r"[A-Za-z-]+")
#: Common last parts of an address.
ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "ch", "nl"))


def candidates(text: str) -> list[Span]:
    low = text.lower()
    digit = _DIGIT.search(text) is not None
    out: list[Span] = []
    for kind, pattern, needs in GENERATORS:
        if any(n in low for n in needs) if needs else digit:
            group = pattern.groups  # the span is the first group, if there is one
            out += ((m.start(group) + len(m.group(group)) - len(m.group(group).lstrip()), m.end(group), kind) for m in pattern.finditer(text))
    return list(dict.fromkeys(out))


def _entropy(text: str) -> float:
    many = np.array([*Counter(text).values()], float) / max(len(text), 1)
    return float(-(many * np.log2(many)).sum()) if len(text) else 0.0


def features(text: str, span: Span) -> list[float]:
    start, end, kind = span
    own = text[start:end]
    digits = _digits(own)
    groups = re.findall("[0-9]+", own)
    sizes = [len(g) for g in groups[:5]] + [0] * (5 - min(5, len(groups)))
    rest = re.sub("[0-9A-Za-z]", "", own)
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - 32) : start])][-3:]
    turns = len(re.findall("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", own))
    gap = re.sub("[A-Za-z]+$", "", text[max(0, start - 4) : start])
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?" else 5
    return [
        ALL_KINDS.index(kind), len(own), len(digits), sum(c.isalpha() for c in own), len(rest), len(set(rest)), len(groups), *sizes, max((int(g[:9]) for g in groups), default=0),
        luhn(digits) if 12 <= len(digits) <= 19 else -1, rest.count("("), rest.count("."), rest.count("-"), rest.count(" "), rest.count(":"), rest.count("/"), rest.count("["),
        own.startswith("+"), own.startswith("00"), own.startswith("0"), own.startswith("("), 1900 <= int(groups[0][:4]) <= 2100 if groups and sizes[0] == 4 else 0,
        *(any(w in cue for w in before) for cue in CUES), side(text[start - 1 : start]), side(text[end : end + 1]), "dot" in own.lower(), re.split(r"[^A-Za-z]", own)[-1].lower() in ENDINGS,
        _entropy(own), turns, re.fullmatch("[0-9A-Fa-f]+", own) is not None, own.islower() or own.isupper(), own[:4] == "AKIA" or own[:4] in ("ghp_", "xoxb") or own[:3] == "sk-", "=" in gap or ":" in gap, '"' in gap or "'" in gap,
    ]


def _sentences(n: int, seed: int) -> Iterator[tuple[str, set[Span]]]:
    """Made-up sentences with their true spans."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "the", "or", "ti", "re", "sel", "mo", "ka", "ui", "en")) for _ in range(r.randint(1, 3)))
    num = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        return r.choice((". ", ".", " - ", "/", "_", " . "))[:3].join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        s = r.choice(("-", ".", " "))
        return r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{s}{num(3)}{s}{num(4)}", f"00{num(2)} {num(3)} {num(6)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(3)}-{num(3)}", f"({num(3)}){num(3)}-{num(4)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(6)}"))

    def mail() -> str:
        a, d = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", " (dot) "), (" AT ", " DOT "), ("{at}", ".")))
        return f"{word()}{r.choice(('', '', '.' + word(), '_' + word(), num(2)))}{a}{word()}{d}{r.choice(('com', 'org', 'net', 'de', 'fr', 'edu'))}"

    def ip() -> str:
        if r.random() < 0.5:
            o, c = r.choice(("[]", "()", "{}"))
            return f"{o}.{c}".join(str(r.randint(0, 255)) for _ in range(4))
        return ":".join(f"{r.randint(1, 65535):x}" for _ in range(8))

    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def hexes() -> str:
        own = pick("0123456789abcdef", r.choice((32, 40, 40, 48, 64)))
        return own if r.random() < 0.8 else own.upper()

    def secret() -> str:
        return r.choice((hexes(), hexes(), "AKIA" + pick(upper + "234567", 16), "ghp_" + pick(lower + upper + "0123456789", 36), "sk-" + pick(lower + upper + "0123456789", 32), pick(lower + upper + "0123456789+/", r.choice((24, 43, 64))) + r.choice(("", "=", "==")), pick(lower + upper + "0123456789!$%*", r.randint(8, 14))))

    def longer() -> tuple[str, str]:
        """A base span and more."""
        if r.random() < 0.5:
            return "ip", ".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice((f":{r.randint(20, 65000)}", f"/{r.randint(8, 32)}"))
        return "phone", f"+{num(r.choice((1, 2)))} ({num(3)}) {num(3)}-{num(4)}" + r.choice((" ext. ", " x", " ext ", ", ext. ")) + num(r.randint(2, 5))

    def code() -> str:
        """A check sum, an identifier, a path, a name."""
        return r.choice((hexes(), hexes(), f"{pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-4{pick('0123456789abcdef', 3)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 12)}", f"{word()}/{word()}/{word()}{num(2)}/{word()}", f"{word()}_{word()}_{word()}_{num(2)}", f"{word()}-{word()}-{word()}-{num(1)}", f"{word()}{word()}{word()}{word()}{num(2)}", num(r.randint(16, 24))))

    def other() -> str:
        return r.choice((
            f"{r.randint(1900, 2040)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2040)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2040)}",
            f"{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 30)}", f"{num(3)}.{num(2)}", f"{r.randint(1, 999)} {num(3)} {num(3)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", num(r.randint(5, 12)), f"{num(2)}-{num(2)}",
            f"{r.randint(1900, 2040)}-{r.randint(1900, 2040)}", f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"{num(4)}-{num(4)}-{num(4)}", f"{num(2)} {num(2)} {num(2)}", f"{r.randint(1, 50)}-{r.randint(50, 99)}-{r.randint(1, 9)}",
            f"{word()} at {word()} dot {word()}", f"{word()} at {word()}.{word().title()}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(5)}-{num(4)}", f"{num(1)},{num(3)},{num(3)}",
        ))

    for _ in range(n):
        words, out, spans = [word() for _ in range(r.randint(6, 14))], "", set()
        put = r.randrange(1, len(words))
        kind = r.choice((*ALL_KINDS, "secret", "longer", "code", "code", "", "", "", "", "", "")) or None
        own = {"email": mail, "ip": ip, "card": card, "phone": phone, "secret": secret, "longer": longer, "code": code, None: other}[kind]()
        kind, own = own if kind == "longer" else (kind, own)
        cue = CUES[ALL_KINDS.index(kind) if kind in ALL_KINDS else 5 if kind == "code" else 6]
        open_ = close = ""
        if r.random() < (0.75 if kind == "phone" else 0.95 if kind == "secret" else 0.5):
            words[put - 1] = r.choice(cue) + r.choice(("", ":", "."))
        elif kind not in ALL_KINDS and r.random() < 0.15:
            words[put - 1] = r.choice(CUES[r.randrange(4)])
        if kind == "secret" and r.random() < 0.85 or kind == "code" and r.random() < 0.3:
            open_, close = r.choice((("= ", ""), ('= "', '"'), ("='", "'"), (": ", ""), (': "', '"')))
        kind = kind if kind in ALL_KINDS else None
        for i, w in enumerate(words):
            if i == put:
                out += open_
                if kind:
                    spans.add((len(out), len(out) + len(own), kind))
                out += own + close + r.choice((" ", ". ", ", ", " ", " ")) if not (kind == "secret" and not close) else own + " "
            out += w + " "
        yield (out.upper() if r.random() < 0.1 and kind in (None, "secret") else out), spans


def train(sentences: int = SENTENCES, seed: int = 7) -> tuple[Boosted, dict[str, float]]:
    """The trees and each kind's threshold: the least probability at which PRECISION holds on the calibration half."""
    rows, truth = [], []
    for text, spans in _sentences(sentences, seed):
        for c in candidates(text):
            rows.append(features(text, c))
            truth.append(c in spans)
    x, y = np.array(rows, float), np.array(truth, float)
    fit = np.random.default_rng(seed).random(len(x)) < 0.5
    model = Boosted().fit(x[fit], y[fit]).calibrate(x[~fit], y[~fit], group=0)
    p, kind, y = model.probability(x[~fit]), x[~fit][:, 0], y[~fit]
    least = {}
    for k, name in enumerate(ALL_KINDS):
        own = [t for t in np.unique(p[kind == k]) if t >= 0.5 and y[(kind == k) & (p >= t)].mean() >= PRECISION]
        least[name] = float(min(own, default=2.0))
    return model, least


def _merged(spans: list[Span]) -> tuple[list[int], list[int], list[set[str]]]:
    """Starts, ends and kinds of the spans' union."""
    starts, ends, kinds = [], [], []
    for a, b, kind in spans:  # by start
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
            kinds[-1].add(kind)
        else:
            starts.append(a)
            ends.append(b)
            kinds.append({kind})
    return starts, ends, kinds


def all_spans(text: str, base: list[Span], model: Boosted, least: dict[str, float]) -> list[Span]:
    """The base spans (by start) and the candidates that the trees accept, by start, then kind."""
    starts, ends, kinds = _merged(base)

    def free(c: Span) -> bool:
        """Whether a candidate meets no base span, or only some of its kind, holds all of them, and more."""
        i, j = bisect_right(ends, c[0]), bisect_left(starts, c[1])
        return i >= j or (c[0] <= starts[i] and ends[j - 1] <= c[1] and (c[0], c[1]) != (starts[i], ends[j - 1]) and all(k == {c[2]} for k in kinds[i:j]))

    found = [c for c in candidates(text) if free(c)]
    if not found:
        return base
    p = model.probability(np.array([features(text, c) for c in found], float))
    out, taken = list(base), []
    for q, c in sorted(zip(-p, found, strict=True), key=lambda t: (t[0], t[1][0] - t[1][1], t[1][0], ALL_KINDS.index(t[1][2]))):
        if -q < least[c[2]]:
            continue
        at = bisect_right(taken, (c[0], c[1]))
        if not (at and taken[at - 1][1] > c[0]) and not (at < len(taken) and taken[at][0] < c[1]):
            insort(taken, (c[0], c[1]))
            out.append(c)
    return sorted(out, key=lambda s: (s[0], ALL_KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with <KIND> for each span; of overlapping spans, one mark for their union, named after the first."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, redact: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    A null text counts as empty: no spans. A text is read whole, in time in proportion to its length (and to the logarithm of its
    number of spans). redact adds the column redacted, null where text is null. Repeated rows, null ids
    and other columns (left out) are fine.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, least = shipped.value
        for batch in batches:
            many, digests, spans, clean = [], [], [], []
            for value in batch.column(1).to_pylist():
                text = value or ""
                base = base_spans(text)
                every = all_spans(text, base, model, least)
                many.append([sum(s[2] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
                if redact:
                    clean.append(None if value is None else redacted(text, every))
            cells = np.array(many, np.int64).reshape(-1, 4).T
            columns = [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in cells), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(clean, pa.string())] * redact, names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *["redacted"] * redact]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", redacted string" * redact
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The columns of docs with text redacted and, where there is one, n_chars counted anew; a null text stays null."""
    shipped = docs.sparkSession.sparkContext.broadcast(train())
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, least = shipped.value
        for batch in batches:
            clean = [None if t is None else redacted(t, all_spans(t, base_spans(t), model, least)) for t in batch.column(where).to_pylist()]
            columns = list(batch.columns)
            columns[where] = pa.array(clean, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
