"""Personal data by weak supervision.

One pass over the texts finds candidate spans: those of the fixed rules, matches that fail a rule's check, and looser
forms. Labelers vote on every candidate (yes, no, or no opinion): the strict pattern, its check, a gazetteer of number
ranges and domains, helpful words in front, and words that speak against it. Expectation-maximisation over the counts of
vote patterns (all documents; the number of patterns is fixed) estimates how reliable each labeler is, and its posteriors
train a logistic span classifier on votes and shape. Spans that the classifier accepts are added to those of the rules,
which always stay.

No rows are shuffled but the counts of patterns, at most PATTERNS of them.

Edge cases: a null text counts as empty; a null doc_id is kept; equal rows are judged each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.work import settle, whole

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Fixed rules. A number is only tried where its digits begin, which finds the same matches in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP_RULE = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD_RULE = re.compile(r"(?<![0-9])[0-9]([ -]?[0-9])+")
PHONE_RULE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Looser forms.
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}){1,8}")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
#: Gazetteers.
ENDINGS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at us ca au jp br in".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "6011", "62", "65")
NOT_PERSONAL_IP = ("0.", "10.", "127.", "192.168.", "255.")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "4", "5", "6", "8", "9")
HELPFUL = (
    re.compile(r"mail|contact|write|reach", re.I), re.compile(r"\bip\b|host|address|server|login|from", re.I),
    re.compile(r"card|visa|credit|pay", re.I), re.compile(r"phone|call|tel|fax|mobile|sms", re.I),
)
AGAINST = re.compile(r"version|\bv$|isbn|order|invoice|section|chapter|serial|item|\bid\b", re.I)
CONTEXT = 32

LABELERS, SHAPES = 5, 64
PATTERNS = len(KINDS) * 3**LABELERS * SHAPES


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def octets(text: str) -> bool:
    return all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in text.split(".")))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: around every @, what may stand in front of it and a domain behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def numbers(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """Kind, begin, end of every match of the number rules, and whether it passes the rule's check."""
    for m in IP_RULE.finditer(text):
        yield IP, m.start(), m.end(), octets(m.group())
    for m in CARD_RULE.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        yield CARD, m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE_RULE.finditer(text):
        yield PHONE, m.start(), m.end(), 9 <= sum(c.isdigit() for c in m.group()) <= 15


def pattern(text: str, kind: int, begin: int, end: int, strict: bool, passes: bool) -> int:
    """Kind, votes (0 no, 1 no opinion, 2 yes) and shape of a candidate as one number."""
    span, before = text[begin:end], text[max(0, begin - CONTEXT) : begin]
    digits = "".join(c for c in span if c.isdigit())
    if kind == EMAIL:
        known = span.rpartition(".")[2].lower() in ENDINGS
        fits = passes and ".." not in span
    elif kind == IP:
        known, fits = not span.startswith(NOT_PERSONAL_IP), passes
    elif kind == CARD:
        known, fits = digits.startswith(CARD_STARTS), 12 <= len(digits) <= 19 and luhn(digits)
    else:
        known, fits = digits.removeprefix("00").startswith(CALLING), 9 <= len(digits) <= 15
    votes = (
        2 if strict else 0, 2 if fits else 0, 2 if known else 0,
        2 if HELPFUL[kind].search(before) else 1, 0 if AGAINST.search(before) else 1,
    )
    shape = (
        (len(digits) >= 12) + 2 * any(c in " ().-" for c in span) + 4 * span[:1].isdigit()
        + 8 * (text[begin - 1 : begin].isalnum() and begin > 0) + 16 * text[end : end + 1].isalnum() + 32 * (len(span) > 24)
    )
    found = kind
    for vote in votes:
        found = found * 3 + vote
    return found * SHAPES + shape


def analyse(text: str) -> tuple[list[tuple[int, int, int]], list[int], list[tuple[int, int, int, int]]]:
    """Spans of the rules as (begin, kind, end), their patterns, and other candidates with theirs."""
    base = [(begin, EMAIL, end) for begin, end in emails(text)] if "@" in text else []
    failed = []
    for kind, begin, end, good in numbers(text):
        if good:
            base.append((begin, kind, end))
        elif end - begin >= 7:  # shorter digits are no candidate of any kind
            failed.append((begin, kind, end, True))
    base.sort()
    if "(" in text or "[" in text:
        failed += [(m.start(), EMAIL, m.end(), False) for m in SPELT.finditer(text)]
    failed += [(m.start(), PHONE, m.end(), False) for m in LOCAL_PHONE.finditer(text)]
    failed.sort()
    other, taken, k = [], 0, 0
    reach = 0  # the farthest end of a rule's span that begins before the candidate's end
    for begin, kind, end, strict in failed:
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if begin >= max(reach, taken):
            other.append((begin, kind, end, pattern(text, kind, begin, end, strict, False)))
            taken = end
    return base, [pattern(text, kind, begin, end, True, True) for begin, kind, end in base], other


def unpack(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (a column per labeler) and shapes."""
    shapes, rest = patterns % SHAPES, patterns // SHAPES
    votes = np.stack([rest // 3**k % 3 for k in range(LABELERS - 1, -1, -1)], 1)
    return rest // 3**LABELERS, votes, shapes


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each vote pattern being personal data, by expectation-maximisation over independent labelers."""
    belief = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1)))
    for _ in range(rounds):
        score = np.zeros(len(counts))
        yes, no = counts * belief, counts * (1 - belief)
        for labeler in range(LABELERS):
            said = [np.bincount(votes[:, labeler], side, 3) + 1.0 for side in (yes, no)]
            share = [x / x.sum() for x in said]
            score += np.log(share[0][votes[:, labeler]] / share[1][votes[:, labeler]])
        belief = 1 / (1 + np.exp(-np.clip(score + np.log((yes.sum() + 1) / (no.sum() + 1)), -30, 30)))
    return belief


def train(counts: dict[int, int], rounds: int = 300, rate: float = 0.5) -> set[int]:
    """Patterns that the span classifier accepts."""
    if not counts:
        return set()
    patterns, n = np.array(list(counts)), np.array(list(counts.values()), float)
    kinds, votes, shapes = unpack(patterns)
    accepted: set[int] = set()
    for kind in np.unique(kinds):
        own = kinds == kind
        target, weight = reliabilities(votes[own], n[own]), n[own] / n[own].sum()
        x = np.concatenate(
            [np.ones((own.sum(), 1)), np.eye(3)[votes[own]].reshape(own.sum(), -1), (shapes[own][:, None] >> np.arange(6)) & 1], 1
        )
        w, seen = np.zeros(x.shape[1]), 1e-8
        for _ in range(rounds):
            slope = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - target)) + 1e-4 * w
            seen = seen + slope**2
            w -= rate * slope / np.sqrt(seen)
        accepted.update(patterns[own][x @ w >= 0].tolist())
    return accepted


ROW = (
    "doc_id BIGINT, n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, base_sha256 STRING, "
    "base ARRAY<STRUCT<s: INT, k: INT, e: INT>>, base_patterns ARRAY<INT>, "
    "other ARRAY<STRUCT<s: INT, k: INT, e: INT, p: INT>>"
)
SPAN = pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())])


def candidates(docs: DataFrame) -> DataFrame:
    """Per document: spans of the rules, their counts and digest, and the other candidates with their patterns."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [analyse(text) for text in batch.column(1).to_pylist()]
            base = [x[0] for x in rows]
            spelt = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans) for spans in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(k == kind for _, k, _ in spans) for spans in base], pa.int64()) for kind in range(4)),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in spelt]),
                    pa.array([[dict(zip("ske", x, strict=True)) for x in spans] for spans in base], pa.list_(SPAN)),
                    pa.array([x[1] for x in rows], pa.list_(pa.int32())),
                    pa.array([[dict(zip("skep", y, strict=True)) for y in x[2]] for x in rows],
                             pa.list_(pa.struct([*SPAN, ("p", pa.int32())]))),
                ],
                [part.split()[0] for part in
                 ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "base_patterns", "other")],
            )

    return docs.select("doc_id", whole().alias("text")).mapInArrow(found, ROW)


def find(docs: DataFrame) -> DataFrame:
    """Per document the counts and digest of the rules' spans, `base` spans and the `added` ones."""
    rows = settle(candidates(docs), "pii")
    every = F.concat("base_patterns", F.transform("other", lambda x: x["p"]))
    counted = rows.select(F.explode(every).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    accepted = train({r.p: r.n for r in counted.collect()})  # bounded by PATTERNS
    inside = F.array(*[F.lit(p) for p in sorted(accepted)]) if accepted else F.array().cast("array<int>")
    added = F.transform(
        F.filter("other", lambda x: F.array_contains(inside, x["p"])),
        lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")),
    )
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", added.alias("added"))


def spelled(spans) -> F.Column:
    """Spans as kind:start:end, by start and kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))),
        ",",
    )
