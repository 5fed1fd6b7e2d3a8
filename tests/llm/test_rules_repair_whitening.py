"""Quality rules, conversation repair and whitening against brute-force versions, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgertide.llm import conversation_repair as cr
from ledgertide.llm import quality_rules as qr
from ledgertide.llm import queries
from ledgertide.llm import whitening as wh

DOCS = "doc_id BIGINT, text STRING, lang STRING, n_words INT, hashes STRING, words INT, stratum STRING, place INT, _at INT"
SPACE = r"[^\x20\x09-\x0D]+"


# 11

def brute_signals(text):
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [line for line in text.split("\n") if re.search(SPACE, line)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum("A" <= c <= "Z" for c in text),
        len(set(words)), len(lines), len(lines) - len(set(lines)), len(covered),
    )


SIGNALS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_distinct", "n_lines", "n_dup_lines", "n_repeat_words")
RANDOM = random.Random(5)
TEXTS = [
    None, "", " \t\n\x0b ", "a", "one two three", "x " * 8, "x " * 9, "y\n" * 30, "é\U0001f600 #$%&|<> A*B c\x85d \r\nz",
    " ".join(f"w{k}" for k in range(25)), " ".join(f"w{k % 11}" for k in range(40)), "same line here\n\nsame line here\nother",
    " ".join(f"w{k}" for k in range(20)) + " " + " ".join(f"w{k}" for k in range(12)), "Long " * 30_000,
    *[" ".join(RANDOM.choice("abc") for _ in range(RANDOM.randrange(5, 200))) for _ in range(40)],
]


@pytest.fixture(scope="module")
def awkward(spark):
    queries.prepare(spark)
    made = [(k if k % 9 else None, t, [None, "en", ""][k % 3], 7, "clash", 1, "clash", 3, 4) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(made + made[:5], DOCS)


def test_signals(awkward):
    got = Counter(map(tuple, qr.signals(awkward).select("doc_id", "stratum", *SIGNALS).collect()))
    want = Counter((r.doc_id, r.lang, *brute_signals(r.text)) for r in awkward.collect())
    assert got == want


def test_binomial_tail(spark):
    cases = [(0, 10), (1, 10), (3, 500), (0, 2000), (9, 2000), (40, 20_000), (63, 20_000), (900, 300_000), (7, 20), (100, 20_000)]
    share = 1 / 300
    df = spark.createDataFrame(cases, "k BIGINT, n BIGINT").select("k", "n", qr.binomial_tail(F.col("k"), F.col("n"), share).alias("p"))
    for k, n, p in df.collect():
        if k >= n * share:
            assert p == 1
            continue
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(share) + (n - j) * math.log1p(-share)
                for j in range(k + 1)]
        assert p == pytest.approx(math.fsum(map(math.exp, logs)), rel=1e-8)


def brute_cutoffs(rows, good, rules, limit, delta):
    """Per stratum and rule the last cutoff in use (-1: none)."""
    strata = {s for i, s, _ in rows if i in good}
    last = {}
    for s in strata:
        docs = {}
        for i, t, signals in rows:
            if i in good and t == s:
                docs.setdefault(i, []).append(signals)
        for rule in rules:
            at, share = -1, limit / len(rules)
            for place, cutoff in enumerate(rule.cutoffs):
                def rejects(x, rule=rule, cutoff=cutoff):
                    a, b = rule.factor * x[rule.signal], cutoff * x[rule.base]
                    return a < b if rule.low else a > b
                k, n = sum(any(map(rejects, d)) for d in docs.values()), len(docs)
                p = 1.0 if k >= n * share else math.fsum(
                    math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k + 1))
                if p > delta / len(rules) / len(strata):
                    break
                at = place
            last[s, rule.name] = at
    return last


def test_cutoffs_and_verdicts(spark):
    """Three strata, one of them too small to reject anything; a rule whose cutoffs stop half way."""
    queries.prepare(spark)
    made, labels = [], []
    for k in range(900):
        lang = None if k % 100 == 9 else "de" if k % 10 in (6, 7, 8) else "en"
        symbols = (k * 37) % 100 if k % 4 == 0 else (k % 3 == 0) * (12 if lang == "de" else 2)
        made.append((k, " ".join(f"word{k}x{j}" for j in range(30)) + " " + "#" * symbols, lang))
        if k % 4 or symbols < 8:
            labels.append((k, 1))
        labels.append((k, 0)) if k % 4 == 0 else None
    labels += [(None, 1), (5, 1), (10_000, 1), (7, None)]
    docs = spark.createDataFrame(made, "doc_id BIGINT, text STRING, lang STRING")
    known = spark.createDataFrame(labels, "doc_id BIGINT, quality INT")
    rules = (qr.RULES[0], qr.RULES[4])
    found = qr.scan(docs, known, rules=rules, limit=0.2, delta=0.3).collect()
    rows = [(i, lang, dict(zip(SIGNALS, brute_signals(t), strict=True))) for i, t, lang in made]
    last = brute_cutoffs(rows, {i for i, q in labels if q == 1}, rules, 0.2, 0.3)
    assert len(set(last.values())) > 2 and max(last.values()) >= 0
    want = {}
    for i, lang, x in rows:
        bad = []
        for rule in rules:
            place = last.get((lang, rule.name), -1)
            left, right = rule.factor * x[rule.signal], rule.cutoffs[place] * x[rule.base]
            if place >= 0 and (left < right if rule.low else left > right):
                bad.append(rule.name)
        base = x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"]
        want[i] = (base, not base and not bad, ",".join(sorted(bad)))
    assert {r.doc_id: (r.base_failed, r.kept, r.failed_rules) for r in found} == want
    assert any(not k for _, k, _ in want.values()) and any(k for _, k, _ in want.values())


def test_false_rejections_are_limited(spark, sf):
    """On all labelled documents of the table no stratum loses more than the limit to the rules."""
    folder = sf.replace("sf0.001", "sf0.1")
    read = queries.prepare(spark).read
    labels = read.parquet(f"{folder}/labels.parquet")
    found = qr.scan(read.parquet(f"{folder}/documents.parquet"), labels).join(labels.where("quality = 1"), "doc_id")
    lost = found.groupBy("lang" if "lang" in found.columns else "stratum").agg(
        F.avg((F.col("failed_rules") != "").cast("int")).alias("share")).collect()
    assert all(r.share <= qr.LIMIT for r in lost)


def test_rules_without_labels_or_rows(spark, awkward):
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    found = qr.scan(awkward, none)
    assert found.count() == len(TEXTS) + 5 and found.where("kept = base_failed OR failed_rules <> ''").count() == 0
    assert qr.scan(awkward.limit(0), none).count() == 0


# 12

def brute_repair(turns):
    """Cheapest edits of (initial, gone, truncated) rows by Dijkstra over all edits: (cost, audit)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {("", 0): (0, "")}
    order = []
    for at in range(len(turns) + 1):
        # insertions among the states of one place, then the row itself
        for _ in range(3):
            for (state, place), (cost, audit) in list(best.items()):
                if place == at:
                    for role in "ua":
                        to = after.get((state, role))
                        if to:
                            new = (cost + 5, audit + "I")
                            best[to, at] = min(best.get((to, at), new), new)
        order.append(at)
        if at == len(turns):
            break
        initial, gone, cut = turns[at]
        for (state, place), (cost, audit) in list(best.items()):
            if place != at:
                continue
            moves = [(state, 2, "D")]
            if not gone:
                moves += [(after[state, initial], 5 * cut, "K")] if (state, initial) in after else []
                moves += [(after[state, r], 1 + 5 * cut, "R") for r in "ua" if (state, r) in after]
            for to, price, letter in moves:
                new = (cost + price, audit + letter)
                best[to, at + 1] = min(best.get((to, at + 1), new), new)
    return min(best[s, len(turns)] for s in ("", "a") if (s, len(turns)) in best)


def run_repair(turns):
    made = []
    repair = cr.Repair(lambda row, edit, role: made.append((row, edit, role)))
    for k, (initial, gone, cut) in enumerate(turns):
        repair.feed(k, {"s": "system", "u": "user", "a": "assistant"}.get(initial, initial), f"t{k}",
                    cr.DUPLICATE if gone else cr.CUT if cut else None)
    cost, digest = repair.finish()
    return cost, made, digest, repair


def replayed(turns, made):
    names = {"s": "system", "u": "user", "a": "assistant"}
    said = []
    for row, edit, role in made:
        if edit != "D":
            said.append(f"{role}:" if row is None else f"{role}:t{row}")
            if edit == "K":
                assert role == names.get(turns[row][0], turns[row][0])
    assert re.fullmatch(r"(s?(ua)+)?", "".join(s[0] for s in said))
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def test_every_short_conversation():
    kinds = [("s", 0, 0), ("u", 0, 0), ("a", 0, 0), ("u", 0, 1), ("a", 0, 1), ("x", 0, 0), ("u", 1, 0)]
    for size in range(5):
        for turns in itertools.product(kinds, repeat=size):
            cost, made, digest, _ = run_repair(turns)
            assert (cost, "".join(e for _, e, _ in made)) == brute_repair(turns), turns
            assert digest == replayed(turns, made)


@pytest.mark.parametrize("seed", range(30))
def test_long_conversations(seed):
    """Long runs of ties, of deletions, of rows of other roles; edits come out before the end where they are certain."""
    draw = random.Random(seed)
    weights = [draw.random() ** 3 for _ in range(5)]
    turns = [(draw.choices("suax ", weights)[0], draw.random() < 0.2, draw.random() < 0.2) for _ in range(300)]
    cost, made, digest, _ = run_repair(turns)
    assert (cost, "".join(e for _, e, _ in made)) == brute_repair(turns)
    assert digest == replayed(turns, made) and [r for r, _, _ in made if r is not None] == list(range(300))


def test_memory_is_that_of_undecided_rows():
    turns = [("ua"[k % 2], False, False) for k in range(20_000)]
    assert run_repair(turns)[3].most_undecided < 20
    blanks = [("u", False, False), *[("u", True, False)] * 2000, ("a", False, False)]
    cost, made, _, _ = run_repair(blanks)
    assert cost == 4000 and "".join(e for _, e, _ in made) == "K" + "D" * 2000 + "K"


CONVERSATIONS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, row INT, fault STRING, dropped INT, seq STRING, copy INT"


def brute_conversations(rows):
    """The whole contract in plain Python: conv_id to the summary's columns."""
    said = lambda v: " " if v is None else str(v)
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, mine in held.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, counts, illegal, before = set(), [], Counter(), 0, None
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
        cost, audit = brute_repair(turns)
        told, rest, state = [], iter(mine), ""
        for letter in audit:
            if letter == "I":
                role, text = ("assistant" if state == "u" else "user"), ""
            else:
                _, role, text = next(rest)
                if letter == "R":
                    role = "assistant" if state == "u" else "user"
            if letter != "D":
                told.append(f"{role}:{text}")
                state = role[:1]
        known = [t for t, _, _ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks(spark):
    queries.prepare(spark)
    draw = random.Random(3)
    made = []
    for conv in [*range(60), None]:
        for turn in range(draw.randrange(1, 12)):
            made.append((conv, None if draw.random() < 0.1 else turn, draw.choice(["system", "user", "user", "assistant", None, "", "tool"]),
                         draw.choice(["Yes.", "No", None, "", "a? b", f"t{turn}!", " \t\n", "é中."])))
    made += [(77, 3, "user", "Same.")] * 3 + [(78, 0, "user", "long " * 50_000 + ".")]
    made += [(99, t, "user", "x") for t in range(2000) if zlib.crc32(f"99:{t}".encode()) % 20 == 0][:2]  # all dropped
    return made, spark.createDataFrame([(*r, 1, "clash", 1, "clash", 3) for r in made], CONVERSATIONS)


def test_conversations(talks):
    made, df = talks
    found = cr.summary(cr.marked(cr.damage(df))).collect()
    want = brute_conversations(made)
    assert len(found) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in found} == want
    assert want[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_have_the_digest(talks):
    _, df = talks
    rows = cr.marked(cr.damage(df))
    told = {}
    for r in cr.repaired(rows, cr.edits(rows)).orderBy("conv_id", "seq").collect():
        told.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in cr.summary(rows).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(told.get(r.conv_id, [])).encode()).hexdigest()


def test_no_conversations(talks):
    rows = cr.marked(cr.damage(talks[1].limit(0)))
    assert cr.summary(rows).count() == 0 and cr.edits(rows).count() == 0


# 13

def brute_whitening(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    centred = (n * x - sums).astype(float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], directions[:, ::-1]


def check_whitening(found, vectors, components=8):
    deviation, centred, values, directions = brute_whitening(vectors)
    k = min(components, sum(values > 1e-12 * values.sum()))
    by = {(r.vec_id, r.component): r for r in found}
    assert len(found) == k * len(vectors)
    for c in range(1, k + 1):
        want = centred @ directions[:, c - 1] / math.sqrt(values[c - 1])
        got = np.array([by[i, c].whitened for i, _ in vectors])
        sign = 1 if np.dot(got, want) > 0 else -1
        assert np.allclose(got, sign * want, atol=1e-7)
    for (i, _), d in zip(vectors, deviation, strict=True):
        assert by[i, 1].deviation == d and by[i, 1].n == len(vectors)
        assert by[i, 1].explained == pytest.approx(values[0] / values.sum(), rel=1e-9)
        assert by[i, 1].identity_error < 1e-8


VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, index STRING, x INT, _at STRING, file INT"


def vectors_of(spark, made):
    return spark.createDataFrame([(i, v, "clash", 1, "clash", 2) for i, v in made], VECTORS)


def test_whitening(spark, sf, monkeypatch):
    monkeypatch.setattr(wh, "ROWS", 7)  # many blocks, the last one not full
    rows = queries.prepare(spark).read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    found = wh.whiten(rows.repartition(3)).collect()
    check_whitening(found, [(r.vec_id, r.embedding) for r in rows.orderBy("vec_id").collect()])


def test_whitening_awkward(spark):
    queries.prepare(spark)
    draw = np.random.default_rng(2)
    good = [(k, [float(c) for c in draw.normal(size=3) * [5, 1, 0.2]]) for k in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]),
           (105, [1.0, 2.0])]
    check_whitening(wh.whiten(vectors_of(spark, good + bad)).collect(), good, 3)
    flat = [(k, [v[0], 2 * v[0], 1.0]) for k, v in good]  # fewer components than dimensions
    assert {r.component for r in wh.whiten(vectors_of(spark, [(k, [float(int(v[0] * 64) / 64), 3.0]) for k, v in flat])).collect()} == {1}
    assert wh.whiten(vectors_of(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert wh.whiten(vectors_of(spark, bad[:5])).count() == 0 and wh.whiten(vectors_of(spark, [])).count() == 0
    twice = wh.whiten(vectors_of(spark, [*good, good[0], (None, good[1][1])]))
    assert twice.count() == 3 * 42 and twice.where("vec_id IS NULL").count() == 3


def test_whitening_beyond_63_bits(spark):
    queries.prepare(spark)
    made = [(k, [float(2**20 * (k % 5)), float(k)]) for k in range(600)]
    found = wh.whiten(vectors_of(spark, made)).where("component = 1").collect()
    deviation, *_ = brute_whitening(made)
    by = dict(zip((i for i, _ in made), deviation, strict=True))
    assert all(int(r.deviation_exact) == by[r.vec_id] for r in found)
    assert all(r.deviation == (by[r.vec_id] if by[r.vec_id] < 2**63 else None) for r in found)
