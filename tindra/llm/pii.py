"""Personal data by weak supervision.

Candidates are spans: the contract's base grammars (which always stay) and looser ones the method adds (IPv6 addresses,
obfuscated mail addresses, national phone numbers, card-like numbers, secrets behind a key word). Five labelers vote yes, no
or abstain on each: grammar, checksum or range, gazetteer, context words before it, and shape (what it touches). Votes of
all candidates of the corpus are counted by pattern (kind, votes, and features of span and context in a few steps each: a
bounded number of rows, whatever the input), and expectation-maximisation over the votes estimates each labeler's reliability.
A logistic span classifier over votes and features, trained on the resulting soft labels, decides on the looser candidates; it
scores patterns, so its decisions are a set of patterns.

Kinds: email, ip, card, phone, then secret. A looser candidate that overlaps a base span, or an earlier looser one, is none.
Every scan is linear in the text: runs of digits are entered at their start only, and mail addresses from their `@`.

Defined results: null or empty text: no spans; ties in start go by kind in the order above; repeated rows give repeated
rows; an empty table gives no rows. Other columns are not read by the query; redaction keeps them as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, small_batches

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELERS = ["grammar", "check", "gazetteer", "context", "shape"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_HIDDEN = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,64}){1,4}")
_NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_KEYWORD = re.compile(r"(password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}\Z", re.IGNORECASE)
_VALUE = re.compile(r"\s{0,3}[\"']?([A-Za-z0-9+/_-]{8,512})")
_ASSIGN = re.compile(r"[=:]")
# Gazetteers and context words.
# Generic top-level domains; two letters are a country's.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx app dev page blog shop store online site tech cloud xyz club eu arpa".split())
# Calling codes by zone: single digits, ranges of two digits, ranges of three.
CODES = ((1, 1), (7, 7), (20, 20), (27, 27), (30, 34), (36, 36), (39, 41), (43, 49), (51, 58), (60, 66), (81, 82), (84, 84), (86, 86), (90, 95), (98, 98), (211, 213), (216, 216), (218, 218), (220, 269), (290, 291), (297, 299), (350, 359), (370, 383), (385, 387), (389, 389), (420, 421), (423, 423), (500, 509), (590, 599), (670, 670), (672, 692), (850, 850), (852, 853), (855, 856), (880, 880), (886, 886), (960, 968), (970, 977), (992, 996), (998, 998))
COUNTRIES = tuple(str(c) for a, b in CODES for c in range(a, b + 1))
# First numbers of address blocks that belong to nobody: this network, loopback, multicast and reserved.
NOBODY = frozenset(["0", "127", *map(str, range(224, 256))])
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "34", "37", "36", "6011", "65", "35")
WORDS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "account"), "phone": ("phone", "call", "tel", "fax", "mobile"), "secret": ("password", "token", "secret", "key", "pwd")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base grammars, leftmost and non-overlapping within each kind, sorted by start and kind."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0]))


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates that the base grammars don't cover."""
    out = []
    if text.count(":") >= 7:
        out += [(1, m.start(), m.end()) for m in _IP6.finditer(text)]
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        out += [(0, m.start(), m.end()) for m in _HIDDEN.finditer(text)]
    out += [(3, m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 17 <= m.end() - m.start() <= 23 and 13 <= len(_digits(m[0])) <= 19]
    for m in _ASSIGN.finditer(text):
        if _KEYWORD.search(text, max(0, m.start() - 16), m.start()) and (v := _VALUE.match(text, m.end())):
            out.append((4, v.start(1), v.end(1)))
    return sorted(out, key=lambda x: (x[1], x[0]))


def votes(text: str, kind: int, start: int, end: int, base: bool) -> str:
    """One letter a labeler: y, n or - (abstains)."""
    s, d = text[start:end], _digits(text[start:end])
    before, after = text[start - 1 : start], text[end : end + 1]
    touched = before.isalnum() or after.isalnum()
    near = text[max(0, start - 24) : start].lower()
    check = gaz = "-"
    if kind == 0:
        top = re.split(r"[^A-Za-z0-9]+", s)[-1].lower()
        gaz = "y" if top in TOP_DOMAINS or (len(top) == 2 and top.isalpha()) else "n"
    elif kind == 1:
        check = "y" if base or s.count(":") == 7 else "n"
        gaz = ("n" if (s.split(".")[0].lstrip("0") or "0") in NOBODY else "y") if base else "-"
    elif kind == 2:
        check, gaz = ("y" if luhn(d) else "n"), ("y" if d.startswith(ISSUERS) else "n")
    elif kind == 3:
        check = "y" if 10 <= len(d) <= 15 and len(set(d)) > 2 else "n"
        gaz = ("y" if d.startswith(COUNTRIES) else "n") if base else ("n" if d[0] in "01" else "-")
    else:
        check = "y" if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) else "n"
    letters = ("y" if base else "-") + check + gaz + ("y" if any(w in near for w in WORDS[KINDS[kind]]) else "-") + ("n" if touched else "y")
    return letters + features(text, s, d, start, end)


def features(text: str, span: str, digits: str, start: int, end: int) -> str:
    """What the span classifier sees of a span and its surroundings besides the votes, in five steps or fewer each: length, share
    of digits, different characters, separators, what stands before and after it in its line."""
    n = len(span)
    size = sum(n >= x for x in (10, 16, 24, 48))
    share = len(digits) * 4 // n if n else 0
    variety = sum(len(set(span)) * 8 >= n * x for x in (2, 4, 6))
    seps = min(4, sum(not c.isalnum() for c in span))
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    left = 0 if not before or "\n" in before else 1 if before[-1] in ":=" or before.strip()[-1:] in (":", "=") else 2 if before[-1].isspace() else 3
    right = 0 if not after or "\n" in after else 1 if after[0] in ".,;)" else 2 if after[0].isspace() else 3
    return f"{size}{share}{variety}{seps}{left}{right}"


def candidates(text: str | None) -> list[tuple[int, int, int, bool, str]]:
    """(kind, start, end, base, votes), sorted by start and kind."""
    if not text:
        return []
    base = base_spans(text)
    out = [(k, s, e, True, votes(text, k, s, e, True)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    i, reach, last = 0, 0, 0
    for k, s, e in loose_spans(text):
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        if s >= max(reach, last):
            out.append((k, s, e, False, votes(text, k, s, e, False)))
            last = e
    return sorted(out, key=lambda x: (x[1], x[0]))


def pattern(kind: int, found: str) -> str:
    return f"{kind}{found}"


# ---- from votes to a classifier
VOTES = 1 + len(LABELERS)


def votes_only(counts: dict[str, int]) -> dict[str, int]:
    """Counts by kind and votes, whatever the features."""
    out: Counter = Counter()
    for p, n in counts.items():
        out[p[:VOTES]] += n
    return dict(out)


def _row(p: str) -> list[float]:
    """A pattern as numbers: kind, votes for and against, and each feature by its step."""
    steps = [c == str(k) for c in p[VOTES:] for k in range(5)]
    return [float(x) for x in [*[p[0] == str(k) for k in range(len(KINDS))], *[c == "y" for c in p[1:VOTES]], *[c == "n" for c in p[1:VOTES]], *steps]]


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """EM on vote counts: P(true) of each pattern of votes, and the labelers' rates of yes among true and false candidates."""
    counts = votes_only(counts)
    pats = sorted(counts)
    if not pats:
        return {}, np.full((2, len(LABELERS)), 0.5)
    n = np.array([counts[p] for p in pats], float)
    kind = np.array([int(p[0]) for p in pats])
    yes, no = (np.array([[c == v for c in p[1:]] for p in pats], float) for v in "yn")
    prob = np.clip((yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.array([((n * prob)[kind == k].sum() + 2) / (n[kind == k].sum() + 4) for k in range(len(KINDS))])
        rate = np.stack([((w[:, None] * yes).sum(0) + a) / ((w[:, None] * (yes + no)).sum(0) + 4) for w, a in ((n * prob, 3), (n * (1 - prob), 1))])
        score = np.log(prior / (1 - prior))[kind] + yes @ np.log(rate[0] / rate[1]) + no @ np.log((1 - rate[0]) / (1 - rate[1]))
        prob = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(pats, prob.tolist(), strict=True)), rate


def classifier(counts: dict[str, int]) -> dict[str, float]:
    """A logistic classifier of spans over kind, votes and the features of span and context, trained on the soft labels of all
    candidates; its probability of each pattern."""
    soft, _ = reliabilities(counts)
    pats = sorted(counts)
    if not pats:
        return {}
    x = np.array([_row(p) for p in pats])
    y, w = np.array([soft[p[:VOTES]] for p in pats]), np.array([counts[p] for p in pats], float)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(b))
        b -= np.linalg.solve(hess, x.T @ (w * (p - y)) + b)
        b = np.clip(b, -20, 20)
    return dict(zip(pats, (1 / (1 + np.exp(-x @ b))).tolist(), strict=True))


def accepted(rows) -> list[str]:
    """Patterns whose spans the classifier takes. rows: (pattern, n)."""
    return sorted(p for p, q in classifier({r.pattern: r.n for r in rows}).items() if q >= 0.5)


# ---- DataFrames
_SPANS = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string>>"


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, found): all candidates of each whole text, in one pass."""
    kind = df.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string())]))

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                found = [candidates(t) for t in b.column(1).to_pylist()]
                n = [Counter(x[0] for x in c if x[3]) for c in found]
                sha = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, base, _ in c if base).encode()).hexdigest() for c in found]
                rows = [[dict(zip(("kind", "start", "end", "base", "votes"), x, strict=True)) for x in c] for c in found]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in n], pa.int64()) for k in range(4)), pa.array(sha), pa.array(rows, span)], [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"])

    return small_batches(df).select(key, df[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found {_SPANS}")


def report(spark: SparkSession, df: DataFrame) -> DataFrame:
    found = materialize(spark, find(df), "pii")
    counts = found.select(F.explode("found").alias("f")).groupBy(F.concat(F.col("f.kind").cast("string"), "f.votes").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    good = accepted(counts.collect())  # one row a pattern
    kinds, pats = (f"array({','.join(repr(x) for x in xs)})" if xs else "cast(array() as array<string>)" for xs in (KINDS, good))
    keep = f"filter(found, f -> f.base OR array_contains({pats}, concat(cast(f.kind as string), f.votes)))"
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.expr(f"array_join(transform({keep}, f -> concat({kinds}[f.kind], ':', f.start, ':', f.end)), ',')").alias("spans"))


def redacted(text: str | None, spans) -> str | None:
    """The text with spans (kind, start, end), sorted, replaced by their kind in brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of df with its text redacted. The one pass over the texts keeps the candidates beside the rows, in the
    shared folder; patterns are counted over all of them, and what is accepted is cut out."""
    spark, place, extra = df.sparkSession, df.columns.index(text), "_" * max(map(len, df.columns)) + "_found"
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string())]))
    names = ("kind", "start", "end", "base", "votes")

    def look(batches):
        for batch in batches:
            for b in slices(batch, text):
                rows = [[dict(zip(names, x, strict=True)) for x in candidates(t)] for t in b.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, span)], [*b.schema.names, extra])

    schema = T.StructType([*df.schema.fields, T.StructField(extra, T._parse_datatype_string(_SPANS))])
    seen = materialize(spark, small_batches(df).mapInArrow(look, schema), "found")
    counts = seen.select(F.explode(extra).alias("f")).groupBy(F.concat(F.col("f.kind").cast("string"), "f.votes").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    good = frozenset(accepted(counts.collect()))  # one row a pattern

    def cut(batches):
        for batch in batches:
            for b in slices(batch, text):
                found = b.column(b.num_columns - 1).to_pylist()
                kept = [[(f["kind"], f["start"], f["end"]) for f in fs if f["base"] or pattern(f["kind"], f["votes"]) in good] for fs in found]
                if any(kept):
                    new = pa.array([redacted(t, k) for t, k in zip(b.column(place).to_pylist(), kept, strict=True)], b.schema.field(place).type)
                else:
                    new = b.column(place)
                yield pa.RecordBatch.from_arrays([new if i == place else b.column(i) for i in range(b.num_columns - 1)], b.schema.names[:-1])

    return seen.mapInArrow(cut, df.schema)
