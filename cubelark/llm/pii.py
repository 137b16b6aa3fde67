"""Personal data by weak supervision.

Base spans come from four patterns with checks and always stay. Further
candidate spans (bare phone numbers, obfuscated addresses, secrets, names after
a salutation) are voted on by labelers of three kinds: patterns (the exact form),
gazetteers (word lists) and context (words before the span). A labeler says yes
(1), no (0) or nothing (-1). Expectation-maximisation over the counts of all
vote patterns in the corpus estimates how reliable each labeler is, and a span
classifier (logistic, on features of the span) is trained on the posteriors;
candidates that it accepts are added.

There are at most 3 ** labelers vote patterns times 2 ** features, whatever the
size of the corpus; only their counts reach the driver.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import spread, written

#: Fixed by the contract of the base spans.
KINDS = ("email", "ip", "card", "phone")
#: The email pattern is [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, matched by _emails.
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidates of the added kinds.
EXTRA = {
    "phone_local": re.compile(r"(?<![\w+])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)"),
    "email_spelt": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,} ?[\[(]dot[\])] ?[A-Za-z]{2,}", re.I),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*\d)(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?!\w)"),
    "name": re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?"),
}
#: Gazetteers and context words: small, fixed lists.
CONTEXT = {
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "email_spelt": ("mail", "contact", "write", "reach"),
    "ssn": ("ssn", "social", "security", "tax", "id"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "secret": ("token", "key", "secret", "password", "passwd", "api", "bearer", "auth"),
    "name": ("contact", "dear", "signed", "by", "from", "name"),
}
COUNTRIES = frozenset(("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"))
DOMAIN_WORDS = frozenset(("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu"))
PREFIXES = ("sk", "pk", "ghp", "gho", "xox", "AKIA", "eyJ", "AIza", "glpat")
NOT_NAMES = frozenset(("The", "And", "Of", "In", "It", "Is", "A", "Der", "Die", "Das", "Le", "La", "El", "Los"))
BEFORE = 32  # characters of context
LABELERS, FEATURES = 4, 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


#: The part of an address after its sign, and the stretches that can hold an address of the other kind: each is found in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL: each holds one sign, and begins where the run of local characters before it does."""
    at, done = text.find("@"), 0
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            a = at
            while a > done and text[a - 1] in LOCAL:
                a -= 1
            if a < at:
                done = domain.end()
                yield a, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans, by start, then kind as listed."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for stretch in DOTTED.finditer(text):
            if stretch[0].count(".") >= 3:
                found += [(m.start(), 1, m.end()) for m in IP.finditer(text, stretch.start(), stretch.end()) if all(len(q) < 4 and int(q) <= 255 for q in (p.lstrip("0") or "0" for p in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, votes, features) of the candidates that overlap no base span, nor an earlier one of their kind.

    votes packs one digit of base 3 for each labeler (0 nothing, 1 no, 2 yes), features one bit for each.
    """
    out = []
    starts, ends = [a for _, a, _ in taken], list(accumulate((b for _, _, b in taken), max))  # taken is by start
    digit = _DIGIT.search(text)
    for kind, pattern in EXTRA.items():
        if kind in ("phone_local", "ssn", "iban", "secret") and not digit:
            continue
        if kind == "email_spelt" and "at]" not in text and "at)" not in text and "AT]" not in text and "AT)" not in text:
            continue
        for m in pattern.finditer(text):
            a, b, s = m.start(), m.end(), m[0]
            before_end = bisect_left(starts, b)
            if before_end and ends[before_end - 1] > a:
                continue
            before = text[max(0, a - BEFORE) : a].lower()
            digits = sum(c.isdigit() for c in s)
            pattern_vote = {"phone_local": s[0] == "(" or s.count("-") == 2, "email_spelt": True, "ssn": s[:3] not in ("000", "666") and s[0] != "9", "iban": len(s.replace(" ", "")) >= 15, "secret": digits * 4 >= len(s) and (s.islower() or len({c.isupper() for c in s if c.isalpha()}) == 2), "name": " " in s}[kind]
            listed = {"phone_local": 0, "email_spelt": 2 if s.split()[-1].lower() in DOMAIN_WORDS or any(s.lower().endswith(d) for d in DOMAIN_WORDS) else 1, "ssn": 0, "iban": 2 if s[:2] in COUNTRIES else 1, "secret": 2 if s.startswith(PREFIXES) else 0, "name": 1 if s.split()[-1] in NOT_NAMES else 0}[kind]
            spoken = any(w in before for w in CONTEXT[kind])
            assigned = before.rstrip(" \"'")[-1:] in (":", "=")
            votes = 0
            for v in (2 if pattern_vote else 1, listed, 2 if spoken else 0, 2 if assigned else 0):
                votes = votes * 3 + v
            features = sum(bit << i for i, bit in enumerate((pattern_vote, listed == 2, spoken, assigned, digits * 2 >= len(s))))
            out.append((kind, a, b, votes, features))
    return out


@dataclass(frozen=True)
class Classifier:
    """Accepted (kind, features), the labelers' reliabilities by kind, and the share of true candidates."""

    accepted: frozenset[tuple[str, int]]
    reliability: dict[str, list[float]]


def estimate(counts: list[tuple[str, int, int, int]], rounds: int = 50) -> Classifier:
    """counts: (kind, votes, features, number). Expectation-maximisation over the vote patterns, then the classifier on their posteriors."""
    accepted, reliability = set(), {}
    for kind in sorted({c[0] for c in counts}):
        own = [c for c in counts if c[0] == kind]
        votes = np.array([[(v // 3 ** (LABELERS - 1 - i)) % 3 for i in range(LABELERS)] for _, v, _, _ in own])
        n = np.array([c[3] for c in own], float)
        yes, no, right, prior = votes == 2, votes == 1, np.full(LABELERS, 0.8), 0.5
        post = np.full(len(own), 0.5)
        for _ in range(rounds):
            log_odds = np.log(prior / (1 - prior)) + ((yes * 1.0 - no) * np.log(right / (1 - right))).sum(axis=1)
            post = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
            agree = ((yes * post[:, None] + no * (1 - post)[:, None]) * n[:, None]).sum(axis=0)
            spoke = ((yes | no) * n[:, None]).sum(axis=0)
            right = np.clip((agree + 8) / (spoke + 10), 0.55, 0.98)  # a labeler is better than chance, by its prior of 8 in 10
            prior = float(np.clip(((post * n).sum() + 1) / (n.sum() + 2), 0.05, 0.95))
        reliability[kind] = right.round(6).tolist()
        bits = np.array([[1.0, *((f >> i) & 1 for i in range(FEATURES))] for _, _, f, _ in own])
        x, y = np.concatenate((bits, bits)), np.concatenate((np.ones(len(own)), np.zeros(len(own))))
        weight = np.concatenate((post * n, (1 - post) * n))
        w = _weighted(x, y, weight)
        accepted |= {(kind, f) for (_, _, f, _), b in zip(own, bits, strict=True) if b @ w >= 0}
    return Classifier(frozenset(accepted), reliability)


def _weighted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic weights of rows that count ``weight`` times, with a ridge."""
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (p - y)) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


SPANS = "array<struct<kind:string,start:int,end:int>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): arrays of (kind, start, end), by start; code points, end exclusive.

    Null text counts as empty. Every row gives one row, repeated and null ids
    included; a text without spans has empty arrays; an empty table gives an
    empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base = [base_spans(t or "") for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "base": [[{"kind": k, "start": x, "end": y} for k, x, y in s] for s in base], "maybe": [[{"kind": k, "start": x, "end": y, "votes": v, "features": f} for k, x, y, v, f in candidates(t or "", s)] for t, s in zip(b["text"], base, strict=True)]})

    schema = f"id {kind}, base {SPANS}, maybe array<struct<kind:string,start:int,end:int,votes:int,features:int>>"
    scanned = written(spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(scan, schema), "spans")
    patterns = scanned.select(F.explode("maybe").alias("m")).groupBy("m.kind", "m.votes", "m.features").agg(F.count(F.lit(1)).alias("n"))
    classifier = estimate([tuple(r) for r in patterns.collect()])
    known = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("features")) for k, f in sorted(classifier.accepted)]) if classifier.accepted else None
    chosen = F.filter("maybe", lambda m: F.array_contains(known, F.struct(m["kind"].alias("kind"), m["features"].alias("features")))) if known is not None else F.filter("maybe", lambda m: F.lit(False))
    added = F.transform(chosen, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return scanned.select(F.col("id").alias(id_col), "base", F.array_sort(added, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(a["end"] - b["end"])).alias("added"))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
