"""Personal data by weak supervision.

Candidate spans come from the strict patterns (the base) and from looser ones: addresses
spelled out, numbers in other notations, numbers that fail a check, and secrets such as
keys and passwords. Six labelers - patterns, value checks, gazetteers and context - vote on
each candidate: for, against, or not at all. Votes are counted by kind, vote vector and
shape, at most KINDS x 3^6 x SHAPES rows whatever the corpus, and expectation-maximisation
over these counts estimates each labeler's reliability and each candidate's posterior. A
logistic classifier of spans, over features of the characters and of the words around them
and not over votes, is fitted to the posteriors of a bounded sample (SAMPLE candidates by
hash) and decides. Base spans always stay; a decided span is added, a secret also around
one, others where they meet none.

Defined results: null or empty text has no spans. Offsets are code points, ends
exclusive. Repeated rows are read each on its own; extra columns are ignored; an empty
table gives an empty result. Patterns run in linear time on texts of any length.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELERS = ("strict", "value", "gazetteer", "context", "edges", "layout")
SHAPES = 4
#: Candidates that the classifier is fitted to, at most, and the numbers of its hashed features.
SAMPLE = 20_000
FEATURES = 256

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A failing number fails from its middle too, so it is tried from its first digit only.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?: ?\[at\] ?| ?\(at\) ?| at )[A-Za-z0-9-]+(?:(?: ?\[dot\] ?| ?\(dot\) ?| dot |\.)[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9.])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}([._/\xa0])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9.])|(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.\-])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?0?[1-9][0-9]{1,3}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9.\-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}={0,2}(?![A-Za-z0-9_/+-])"),
}
#: A value that is assigned to something named as a secret: the strict pattern of that kind.
_ASSIGNED = re.compile(r"""(?i)(?<![a-z])(?:token|secret|pass(?:word|wd|phrase)?|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|contraseña|passwort)["']?\x20?(?:=|:)\x20?["']?([^\s"'<>=]{6,})""")

_AT = re.compile(r" ?\[at\]| ?\(at\)| at(?= )", re.I)
# What the loose pattern's classes match without regard to case.
_LOOSE_LOCAL = _LOCAL | frozenset("\u0130\u0131\u017f\u212a")

#: Gazetteers of top-level domains, card issuers' first digits and calling codes, and context words.
TOP_LEVEL = {"com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "ch", "at", "be"}
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "81", "82", "86", "91")
FOR = {
    "email": ("mail", "contact", "write", "correo", "schreib", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "cell", "anruf", "contact"),
    "secret": ("token", "secret", "pass", "pwd", "key", "auth", "bearer", "credential", "login"),
}
#: How keys of well-known services begin, and the lengths of hexadecimal digests and keys.
KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "pk_live_", "xox", "eyJ", "AIza", "glpat-")
HEX_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
AGAINST = ("version", "isbn", "order", "invoice", "token", "serial", "doi", "release", "chapter", "section")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The strict pattern from each @ outwards: linear, where a search from every letter is not."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found = {k: [] for k in BASE} | {"email": emails(text) if "@" in text else []}
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def loose_emails(text: str) -> Iterator[tuple[int, int]]:
    """The loose pattern from each spelled-out at outwards: linear, where a search from every letter is not."""
    end = 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > end and text[start - 1] in _LOOSE_LOCAL:
            start -= 1
        while start < at.start() and text[start] in "._%+-":
            start += 1
        m = _LOOSE["email"].match(text, start) if end <= start < at.start() else None
        if m:
            end = m.end()
            yield m.span()


class _Taken:
    """Spans that do not overlap, with a test for one that meets any of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, start: int, end: int) -> bool:
        """Takes the span, unless it meets another."""
        k = bisect_left(self.starts, end)
        if k and self.ends[k - 1] > start:
            return False
        insort(self.starts, start)
        self.ends.insert(k, end)
        return True


def _loose(kind: str, text: str) -> Iterator[tuple[int, int, bool]]:
    """Spans of the looser patterns, and whether a span's surroundings name its kind outright."""
    if kind == "email":
        yield from ((s, e, False) for s, e in loose_emails(text))
        return
    if kind == "secret" and ("=" in text or ":" in text):
        yield from ((*m.span(1), True) for m in _ASSIGNED.finditer(text))
    if kind == "secret" or _DIGIT.search(text):
        yield from ((*m.span(), False) for m in _LOOSE[kind].finditer(text))


def loose_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, bool]]:
    """Candidates of the looser patterns that meet each other nowhere: first secrets, which may hold a number, then those that meet no base span either."""
    secrets = _Taken([])
    out = [("secret", s, e, named) for s, e, named in _loose("secret", text) if secrets.add(s, e)]
    taken = _Taken([s for spans in base.values() for s in spans] + [(s, e) for _, s, e, _ in out])
    return out + [(kind, s, e, named) for kind in _LOOSE if kind != "secret" for s, e, named in _loose(kind, text) if taken.add(s, e)]


def entropy(s: str) -> float:
    """Bits per character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def votes(kind: str, text: str, start: int, end: int, strict: bool) -> tuple[tuple[int, ...], int]:
    """The labelers' votes (1, -1 or 0) on a candidate, and its shape."""
    s, digits = text[start:end], _digits(text[start:end])
    if kind == "email":
        parts = re.split(r"\.| dot |[\[(]dot[\])]", s.lower().replace(" ", "") if not strict else s.lower())
        value = 1 if 1 < len(parts) <= 8 and len(s) <= 254 else -1
        gazetteer = 1 if parts[-1].rsplit("dot", 1)[-1] in TOP_LEVEL else -1
    elif kind == "ip":
        parts = re.findall("[0-9]+", s)
        value, gazetteer = (1 if ":" in s or all(int(p[-4:]) <= 255 for p in parts) else -1), -1 if parts and parts[0] in ("0", "127") else 1
    elif kind == "card":
        value, gazetteer = (1 if luhn(digits) else -1), (1 if digits.startswith(ISSUERS) else -1)
    elif kind == "secret":
        mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
        value = 1 if mixed and entropy(s[:256]) >= 3 else -1
        gazetteer = 1 if s.startswith(KEYS) or len(s) in HEX_LENGTHS and not s.strip("0123456789abcdefABCDEF") else -1
    else:
        value = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = (1 if digits.startswith(CALLING) else -1) if s[0] == "+" or s.startswith("00") else 0
    words = _around(text, start)
    against = kind != "secret" and any(w in AGAINST for w in words)
    context = -1 if against else 1 if any(w.startswith(FOR[kind]) for w in words) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if left.isalnum() or right.isalnum() else 1
    seps = {c for c in s if not c.isalnum()}
    layout = 1 if len(seps) <= 5 and (8 <= len(s) <= 256 if kind == "secret" else len(s) <= 64) else -1
    shape = min(SHAPES - 1, len(seps))
    return (1 if strict else -1, value, gazetteer, context, edges, layout), shape


def _around(text: str, start: int) -> list[str]:
    return re.findall(r"\w+", text[max(0, start - 40) : start].lower())


def features(kind: str, text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that a span has, hashed: its kind with its length, its kinds of characters, how it begins and
    ends, whether its digits pass the checks, how even its characters are, and the words and characters around it."""
    s, digits = text[start:end], _digits(text[start:end])
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s[:64]))))
    words = _around(text, start)
    n_letters = sum(map(str.isalpha, s))
    seen = [
        "", f"length {min(len(s), 64) // 4}", f"digits {min(len(digits), 32)}", f"letters {4 * n_letters // len(s)}", f"shape {shape[:12]}",
        f"begins {s[:1] if not s[:1].isalnum() else 9 * s[:1].isdigit()}", f"luhn {bool(digits) and luhn(digits[-32:])}", f"entropy {round(2 * entropy(s[:256]))}",
        f"hex {not s.strip('0123456789abcdefABCDEF')}", f"issuer {digits.startswith(ISSUERS)}", f"left {text[start - 1 : start]}", f"right {text[end : end + 1]}",
        f"octets {all(int(p[-4:]) <= 255 for p in re.findall('[0-9]+', s))}", f"named {any(w.startswith(FOR[kind]) for w in words)}", f"against {any(w in AGAINST for w in words)}",
    ]
    seen += [f"word {w}" for w in words[-2:]]
    return sorted({zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % FEATURES for x in seen})


def _pattern(kind: str, vote: tuple[int, ...], shape: int) -> int:
    n = KINDS.index(kind)
    for v in vote:
        n = n * 3 + v + 1
    return n * SHAPES + shape


def pattern_of(n: int) -> tuple[int, tuple[int, ...], int]:
    n, shape = divmod(n, SHAPES)
    v = []
    for _ in LABELERS:
        n, x = divmod(n, 3)
        v.append(x - 1)
    return n, tuple(reversed(v)), shape


_FOUND = "doc_id long, base array<struct<kind: int, start: long, end: long>>, candidates array<struct<kind: int, start: long, end: long, pattern: int, strict: boolean, features: array<int>>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Base spans and voted candidates of every whole text: one pass, no shuffle."""

    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    voted = pa.struct([*span, ("pattern", pa.int32()), ("strict", pa.bool_()), ("features", pa.list_(pa.int32()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, cand = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                own = base_spans(t)
                base.append([{"kind": i, "start": s, "end": e} for i, k in enumerate(BASE) for s, e in own[k]])
                all_ = [(k, s, e, True, True) for k in BASE for s, e in own[k]] + [(k, s, e, named, False) for k, s, e, named in loose_spans(t, own)]
                cand.append([
                    {"kind": KINDS.index(k), "start": s, "end": e, "pattern": _pattern(k, *votes(k, t, s, e, named)), "strict": strict, "features": features(k, t, s, e)}
                    for k, s, e, named, strict in all_
                ])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(span)), pa.array(cand, pa.list_(voted))], ["doc_id", "base", "candidates"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, _FOUND)


def reliabilities(patterns: list[int], counts: list[int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted votes: per pattern the posterior of being personal, and
    per kind and labeler P(vote | not personal) and P(vote | personal). Counts of a mild prior make
    labelers better than chance and keep what no one voted on undecided."""
    parts = [pattern_of(p) for p in patterns]
    kind, vote, n = np.array([p[0] for p in parts], int), np.array([p[1] for p in parts], int).reshape(-1, len(LABELERS)) + 1, np.array(counts, float)
    prior = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # for vote -1, 0, 1 where it is not, or is, personal
    posterior = np.where(vote[:, 0] == 2, 0.9, 0.4) if len(n) else np.zeros(0)
    table = np.zeros((len(KINDS), len(LABELERS), 2, 3))
    for _ in range(rounds if len(n) else 0):
        before = posterior
        share = np.zeros((len(KINDS), 2)) + 1
        table[:] = prior
        for y, w in enumerate((n * (1 - posterior), n * posterior)):
            np.add.at(share[:, y], kind, w)
            for j in range(len(LABELERS)):
                np.add.at(table[:, j, y], (kind, vote[:, j]), w)
        table /= table.sum(axis=3, keepdims=True)
        share /= share.sum(axis=1, keepdims=True)
        log = np.log(share[kind])
        for j in range(len(LABELERS)):
            log = log + np.log(table[kind, j, :, vote[:, j]])
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return posterior, table


def classifier(seen: list[list[int]], posterior: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model of spans' features, fitted to the posteriors."""
    x = np.zeros((len(seen), FEATURES))
    for i, f in enumerate(seen):
        x[i, f] = 1
    w = np.zeros(FEATURES)
    for _ in range(rounds if len(seen) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(FEATURES), x.T @ (p - posterior) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights. The counts gathered here are bounded by the number of vote patterns, the candidates by ``sample``."""
    counted = found.select(F.explode("candidates.pattern").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    counted.sort()
    patterns, counts = [r[0] for r in counted], [r[1] for r in counted]
    if not patterns:
        return np.zeros(FEATURES)
    posterior = dict(zip(patterns, reliabilities(patterns, counts)[0].tolist()))
    one = found.select("doc_id", F.explode("candidates").alias("c")).select("c.pattern", "c.features", F.xxhash64("doc_id", "c.start", "c.end").alias("h"))
    share = min(1.0, sample / sum(counts))  # by hash, so that reruns agree; the limit only guards against equal rows
    rows = one.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).drop("h").limit(2 * sample).collect() if share < 1 else one.drop("h").collect()
    return classifier([r[1] for r in rows], np.array([posterior[r[0]] for r in rows]))


def detect(docs: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), by kind as listed, then start."""
    found = materialize(candidates(docs), "pii-candidates")
    weights = F.array(*map(F.lit, train(found, sample).tolist()))
    logit = lambda c: F.aggregate(c["features"], F.lit(0.0), lambda a, f: a + F.element_at(weights, f + 1))
    added = F.filter("candidates", lambda c: ~c["strict"] & (logit(c) >= math.log(threshold / (1 - threshold))))
    spans = F.array_sort(F.concat("base", F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))
    return found.select("doc_id", "base", spans.alias("spans"))


def listed(spans: str):
    """The spans of a column as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
