"""Each operator against a brute-force version, and on awkward rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ledgertide.llm import (
    exact_dedup, jaccard_join, licenses, lm_scoring, mixing, packing, pii, queries, tokens, topk, toxicity, warc,
)

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, digest STRING, at INT, id STRING, row INT, copy INT"
LONG = "alpha beta gamma delta " * 20_000
AWKWARD = [
    (1, "same text here for all of us", "a"), (1, "same text here for all of us", "a"), (2, "same text here for all of us", None),
    (3, None, "b"), (4, "", "b"), (None, "", "b"), (None, "no name", None), (5, LONG, "a"), (6, " \t\n ", "a"), (7, "é中\U0001f600 x", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", s, 1, "clash", 2, "clash", 3, 4) for i, t, s in AWKWARD]
    queries.prepare(spark)
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return queries.prepare(spark).read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def by_doc(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", [n for n in queries.ORACLE if queries.ORACLE[n]])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


def test_registered():
    found = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}
    assert set(queries.QUERIES) <= set(found)


# 1

def check_copies(found, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(found) == len(rows)
    for text, ids in groups.items():
        own = [r for r in found if r.sha == hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(map(str, (r.doc_id for r in own))) == sorted(map(str, ids))
        assert {r.group_size for r in own} == {len(ids)} and sum(r.kept for r in own) == 1
        best = max((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in own} == {best} and [r.doc_id for r in own if r.kept] == [best]


@pytest.mark.parametrize("bytes_", [exact_dedup.BATCH_BYTES, 1])
def test_exact_dedup(awkward, bytes_):
    found = exact_dedup.find_copies(awkward.repartition(3), batch_bytes=bytes_)
    check_copies(found.select("*", F.lower(F.hex("digest")).alias("sha")).collect(), AWKWARD)
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({t or "" for _, t, _ in AWKWARD})


def test_exact_dedup_colliding_digests(awkward):
    """Digests of four bits collide; the check of full bytes keeps different texts apart."""
    short = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))
    found = exact_dedup.find_copies(awkward, digest=short)
    groups = Counter(t or "" for _, t, _ in AWKWARD)
    assert Counter(r.group_size for r in found.collect()) == Counter(groups[t or ""] for _, t, _ in AWKWARD)


def test_exact_dedup_empty(nothing):
    assert exact_dedup.find_copies(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0


# 2

def gram_set(text):
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_links(texts):
    sets = {i: gram_set(t) for i, t in texts.items()}
    links = {i: set() for i in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    lowest = {i: i for i in texts}
    while True:
        new = {i: min([lowest[i], *(lowest[j] for j in links[i])]) for i in texts}
        if new == lowest:
            return links, lowest
        lowest = new


@pytest.mark.parametrize("options", [{}, {"bucket": 2, "block": 2}])
def test_jaccard_join(docs, texts, options):
    links, lowest = brute_links(texts)
    found = by_doc(jaccard_join.similar(docs, **options))
    assert {i: r.n_links for i, r in found.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r.class_id for i, r in found.items()} == lowest
    assert sum(r.kept for r in found.values()) == len(set(lowest.values()))


def test_jaccard_join_crowd(spark):
    """A hundred near copies, every text different, through the blocks of a cluster."""
    base = [f"w{k}" for k in range(200)]
    texts = {n: " ".join(base[:150] + [f"x{n}"] + base[150:]) for n in range(100)}
    texts |= {100 + n: " ".join(f"y{n}z{k}" for k in range(60)) for n in range(5)}
    links, lowest = brute_links(texts)
    found = by_doc(jaccard_join.similar(spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")))
    assert {i: (r.n_links, r.class_id) for i, r in found.items()} == {i: (len(links[i]), lowest[i]) for i in texts}


def test_jaccard_join_awkward(awkward, nothing):
    found = jaccard_join.similar(awkward).collect()
    assert len(found) == len(AWKWARD)
    assert sorted(r.n_links for r in found if r.doc_id in (1, 2)) == [2, 2, 2]
    assert all(r.n_links == 0 and r.kept for r in found if r.doc_id in (3, 4, 6))
    assert jaccard_join.drop_similar(awkward).count() == len(AWKWARD) - 2
    assert jaccard_join.similar(nothing).count() == 0


def test_bands():
    for similarity in (0.5, 0.8, 0.9):
        bands, rows = jaccard_join.bands_and_rows(similarity, 0.999)
        assert 1 - (1 - similarity**rows) ** bands >= 0.999 and bands * rows <= jaccard_join.HASHES


# 3

def is_out(doc_id, mod, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == rest


def check_base(found, rows):
    words = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for i, t, *_ in rows:
        if not is_out(i, 7, 2):
            counts.update(words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = Counter()
    for i, t, *_ in rows:
        c = [counts[w] for w in words(t)] + [ends]
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in c)
        want[(i, is_out(i, 7, 2), len(c), sum(x > 0 for x in c), n, round(base, 6))] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in found if r.n_tokens > 1)


def test_lm_scoring(docs, texts, monkeypatch):
    found = lm_scoring.score(docs).collect()
    check_base(found, list(texts.items()))
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    monkeypatch.setattr(lm_scoring, "HEAD", 50)  # most words meet their counts in the join
    again = by_doc(lm_scoring.score(docs))
    check_base(again.values(), list(texts.items()))


def test_lm_scoring_awkward(awkward, nothing):
    check_base(lm_scoring.score(awkward).collect(), AWKWARD)
    assert lm_scoring.score(nothing).count() == 0


def test_lm_scores_by_hand(docs, texts):
    """Buckets and scores of whole documents against a model written out word by word."""
    counts = Counter()
    for i, t in texts.items():
        if not is_out(i, 7, 2):
            counts.update(t.encode().lower().split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    words, learned = [w.decode() for w in order], sum(not is_out(i, 7, 2) for i in texts)
    known = lm_scoring.Classes(words[:2000], np.array([counts[w] for w in order[:2000]]), learned, sum(counts.values()), len(order))
    hashed = Counter(known.bucket(w) for w in words[known.own :])
    known.hashed_types = np.array([hashed[k] for k in range(known.shared)])
    known.hashed = np.zeros(known.shared, np.int64)
    for w in order[known.own :]:
        known.hashed[known.bucket(w.decode())] += counts[w]
    model = lm_scoring.Model.fresh(known.frequencies())
    some = docs.where("doc_id % 20 = 0")
    coded = lm_scoring.coded_rows(some, known)
    found = {r.doc_id: r.class_score for r in lm_scoring.class_scores(coded, known, model).collect()}
    r, a, b, q, bias, group_q, group_bias = (p.astype(float) for p in model.parts)
    number = {w: k for k, w in enumerate(words[: known.own])}
    assert len(found) == some.count() > 5
    for doc, got in found.items():
        want, u, v = 0.0, known.start, known.start
        for w in [*texts[doc].encode().lower().split(), None]:
            k = known.end if w is None else number.get(w.decode(), known.end + 1 + known.bucket(w.decode()))
            h, g = r[u] @ a + r[v] @ b, k // model.width
            z, mine = group_q @ h + group_bias, slice(g * model.width, (g + 1) * model.width)
            y = q[mine] @ h + bias[mine]
            want += z[g] - np.log(np.exp(z).sum()) + y[k % model.width] - np.log(np.exp(y).sum())
            if k > known.end:
                want -= np.log(known.shared_mass()[k - known.end - 1])
            u, v = k, u
        assert math.isclose(got, want / math.log(10), rel_tol=1e-5)


def test_lm_rare_words_in_context(spark):
    """Every word that follows one rare word only is better told by it than by its count, beyond the most frequent ones."""
    random = np.random.default_rng(5)
    pairs = random.integers(0, 1500, (6000, 40))
    rows = [(k, " ".join(f"l{p} r{p}" for p in line)) for k, line in enumerate(pairs)]
    df = queries.prepare(spark).createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(2)
    out = [r for r in lm_scoring.score(df).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
    assert gain > 0.5, gain


def test_lm_all_words_add_up():
    """Probabilities of all known words, the end and one unseen word for each bucket add up to one."""
    words, counts = [f"w{k}" for k in range(3000)], np.arange(3000, 0, -1)
    classes = lm_scoring.Classes(words, counts, 10, int(counts.sum()), len(words))
    where = np.array([classes.bucket(w) for w in words[classes.own :]])
    classes.hashed = np.bincount(where, counts[classes.own :], classes.shared).astype(np.int64)
    classes.hashed_types = np.bincount(where, minlength=classes.shared)
    assert classes.own < len(words)
    model = lm_scoring.Model.fresh(classes.frequencies())
    p = np.exp(model.scorer()(np.arange(classes.start), np.full(classes.start, 3), np.full(classes.start, 5)))
    shares = np.bincount(where, counts[classes.own :] + 1, classes.shared) + 1
    total = p[: classes.own + 1].sum() + (p[classes.own + 1 :] * shares / classes.shared_mass()).sum()
    assert abs(total - 1) < 1e-4


def test_lm_normalised():
    model = lm_scoring.Model.fresh(np.array([5.0, 3.0, 2.0, 1.0]))
    step = model.trainer(0)
    now = np.random.default_rng(1).integers(0, 4, 4000)
    before, second = np.roll(now, 1), np.roll(now, 2)
    step(now, before, second)
    score = model.scorer()
    total = sum(np.exp(score(np.full(5, w), np.arange(5) % 5, np.arange(5)[::-1] % 5)) for w in range(4))
    assert np.allclose(total, 1, atol=1e-4)


def test_lm_scores_from_tables(monkeypatch):
    """Many tokens share the exponentials of their contexts; the scores are those of a few tokens at once and of plain sums."""
    random, n = np.random.default_rng(3), 40
    model = lm_scoring.Model.fresh(np.arange(n, 0, -1.0))
    now, before, second = random.integers(0, n, (3, 20_000))
    model.trainer(0)(now[:4000], before[:4000], second[:4000])

    def plain(k):
        r, a, b, q, bias, group_q, group_bias = (p.astype(float) for p in model.parts)
        h, g = r[before[k]] @ a + r[second[k]] @ b, now[k] // model.width
        those = slice(g * model.width, (g + 1) * model.width)
        z, y = group_q @ h + group_bias, q[those] @ h + bias[those]
        return sum(x[i] - x.max() - np.log(np.exp(x - x.max()).sum()) for x, i in ((z, g), (y, now[k] % model.width)))

    made, exp = [], np.exp
    with monkeypatch.context() as patch:
        patch.setattr(np, "exp", lambda x, *args, **named: (made.append(np.size(x)), exp(x, *args, **named))[1])
        found = model.scorer()(now, before, second)
    assert sum(made) < len(now)  # a softmax for each token takes more than ten times as many
    few = np.concatenate([model.scorer()(now[k : k + 20], before[k : k + 20], second[k : k + 20]) for k in range(0, 2000, 20)])
    assert np.allclose(found[:2000], few, atol=1e-4) and np.allclose(found[:200], [plain(k) for k in range(200)], atol=1e-4)
    for size in (30, 3000):  # logits that tables, and then floats, do not hold
        model.q[:] *= size
        model.group_q[:] *= size
        far = model.scorer()(now, before, second)
        assert np.allclose(far[:200], [plain(k) for k in range(200)], rtol=1e-4, atol=1e-2)


def test_lm_sums_of_runs():
    random = np.random.default_rng(4)
    for top in (1, 5, 500):
        index = np.sort((random.random(3000) ** 3 * top).astype(int))
        rows, want = random.normal(size=(3000, 4)).astype(np.float32), np.zeros((top, 4))
        np.add.at(want, index, rows)
        starts = lm_scoring.runs(index)
        by_size, sums = lm_scoring.run_sums(starts, rows)
        assert sorted(by_size.tolist()) == list(range(len(starts)))
        assert np.allclose(sums, want[index[starts[by_size]]], atol=1e-3)
    sizes = random.integers(1, 900, 100)
    put = list(lm_scoring.alike(sizes))
    assert sorted(np.concatenate(put).tolist()) == list(range(100))
    assert all(sizes[k].max() == sizes[k[-1]] <= 1.5 * sizes[k[0]] + 4 for k in put)


# 4

def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in m.group() if x.isdigit()]
        odd = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and odd % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


TRICKY = [
    "a@b.c@d.e x@@y.z .@a.b, q@w q@w.e.r@t.y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3", "4111 1111 1111 1111 411111111111111-1",
    "+1 (988) 555-2485 +12 +1+123456789 call 555-123-4567 or (555) 123 4567", "12345678901234567890", "a b [at] x [dot] org é1.1.1.1é",
    "1" * 3000 + "." + "1.1.1", "",
]


def test_pii(docs, texts, spark):
    rows = texts | {10_000_000 + k: t for k, t in enumerate(TRICKY)}
    found = by_doc(pii.find(spark.createDataFrame(list(rows.items()), "doc_id BIGINT, text STRING")).withColumn(
        "spans", pii.spelled(F.concat("base", "added"))))
    for i, text in rows.items():
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(text)]
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text[:80]
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        spans = found[i].spans.split(",") if found[i].spans else []
        assert set(base) <= set(spans) and len(spans) == len(base) + len(found[i].added)


def test_pii_awkward(awkward, nothing):
    assert pii.find(awkward).count() == len(AWKWARD) and pii.find(nothing).count() == 0


def test_pii_reliabilities():
    """Labelers that agree with the truth get a posterior that follows them."""
    random = np.random.default_rng(3)
    truth = random.random(4000) < 0.4
    votes = np.stack([np.where(random.random(4000) < right, truth, ~truth) * 2 for right in (0.95, 0.9, 0.9, 0.6, 0.5)], 1)
    seen, counts = np.unique(votes, axis=0, return_counts=True)
    belief = {tuple(v): b for v, b in zip(seen, pii.reliabilities(seen, counts.astype(float)), strict=True)}
    assert np.mean([(belief[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.93


# 5

def check_mix(rows, sizes, budget):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for source, own in by_source.items():
        own.sort(key=lambda r: (r.copy, r.begin))
        at = 0
        for r in own:
            assert r.begin == at or r.tokens and r.copy > own[0].copy
            at = r.begin + r.tokens
        quota = own[0].weight * budget
        assert at <= quota + 1 and at > quota - max(sizes[source]) - 1
        whole_passes = int(round(quota) // sum(sizes[source]))
        assert len(own) >= whole_passes * len(sizes[source])


def test_mixing(docs, texts):
    sizes = defaultdict(list)
    for r in docs.collect():
        sizes[r.source].append(len((r.text or "").split()) + 1)
    total = sum(map(sum, sizes.values()))
    check_mix(mixing.mix(docs, mixing.Target(entropy=0.99, budget=2 * total)).collect(), sizes, 2 * total)
    mixed = mixing.mix(docs, mixing.Target(repeat=1.2)).collect()
    weights = {r.source: r.weight for r in mixed}
    repeats = [weights[s] / sum(x) for s, x in sizes.items()]
    assert max(repeats) / min(repeats) <= 1.2 + 1e-6 and abs(sum(weights.values()) - 1) < 1e-9
    assert {r.doc_id for r in mixed} == set(texts)


def test_mixing_entropy(spark):
    rows = [(k, "w " * (99 if k < 60 else 9), f"s{min(k // 20, 9)}" if k >= 60 else "hot") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    weights = {r.source: r.weight for r in mixing.mix(df, mixing.Target(entropy=0.9, budget=10_000)).collect()}
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert abs(entropy - 0.9 * math.log(len(weights))) < 1e-3


@pytest.mark.parametrize("target", [0.95, 0.6, 0.2])
def test_mixing_entropy_below_that_of_the_shares(spark, target):
    """Sources of nearly equal shares: the exponent goes above 1 until the target is met."""
    rows = [(k, "w " * (20 + k % 4), f"s{k % 4}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    mixed = mixing.mix(df, mixing.Target(entropy=target)).collect()
    weights = {r.source: r.weight for r in mixed}
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(4)
    assert {r.met for r in mixed} == {True} and entropy == pytest.approx(mixed[0].entropy, abs=5e-3)
    assert target - 0.01 < entropy <= target + 1e-6
    total = sum(len(t.split()) + 1 for _, t, _ in rows)
    assert abs(sum(r.tokens for r in mixed) - total) < 4 * 25


def test_mixing_target_out_of_reach(spark):
    rows = [(k, "w w w", f"s{k % 4}") for k in range(40)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING"), mixing.Target(entropy=0.5)).collect()
    assert {r.met for r in mixed} == {False} and len(mixed) == 40 and {round(r.weight, 9) for r in mixed} == {0.25}


def test_mixing_keeps_its_order(spark):
    """Rows of the written mix go by position; copies of a document are a pass apart."""
    rows = [(k, f"text {k}", "large" if k % 10 else "small") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").repartition(3)
    target = mixing.Target(entropy=0.98)
    place = {}
    for r in mixing.mix(df, target).collect():
        place.setdefault(r.doc_id, []).append(r.position)
    read = [r.doc_id for r in mixing.realise(df, target).withColumn("part", F.spark_partition_id()).collect()]
    seen, at = Counter(), []
    for doc_id in read:
        at.append(sorted(place[doc_id])[seen[doc_id]])
        seen[doc_id] += 1
    assert at == sorted(at) and seen == Counter({d: len(p) for d, p in place.items()}) and max(seen.values()) > 1
    assert all(a != b for a, b in zip(read, read[1:]))


@pytest.mark.parametrize("name", ["__at", "__AT", "__turn", "_metadata"])
def test_columns_that_clash_with_places(spark, name):
    rows = [(k, f"one text of many words {k // 2} and more of them", f"s{k % 2}", f"kept {k}") for k in range(8)]
    df = queries.prepare(spark).createDataFrame(rows, f"doc_id BIGINT, text STRING, source STRING, `{name}` STRING")
    want = {(k, f"kept {k}") for k in range(8)}
    for made in (exact_dedup.drop_copies(df), jaccard_join.drop_similar(df), mixing.realise(df, mixing.Target(repeat=2))):
        got = {(r["doc_id"], r[name]) for r in made.collect()}
        assert made.columns == df.columns and got and got <= want


def test_mixing_awkward(awkward, nothing):
    taken = mixing.realise(awkward, mixing.Target(repeat=2))
    assert taken.columns == awkward.columns and taken.count() >= len(AWKWARD)
    assert mixing.mix(nothing, mixing.Target(entropy=0.5)).count() == 0


# 6

def test_topk_awkward(spark):
    random = np.random.default_rng(5)
    rows = [(k, [float(x) for x in random.normal(size=8)]) for k in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 360)]  # ties
    rows += [(400, None), (401, [float("nan")] * 8), (402, [None] + [1.0] * 7), (403, [float("inf")] * 8), (404, [1.0]), (405, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, v INT")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    clean = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows[:360]]
    want = []
    for i, q in clean:
        if i % 50 == 0:
            best = sorted((-int(v @ q), j) for j, v in clean if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_stops_early():
    """Far candidates are never looked at: bounds only fall below the k-th score when they cannot win."""
    random = np.random.default_rng(6)
    x = random.integers(-50, 50, (500, 4))
    pivots = topk.choose_pivots(x.astype(float), 8)
    far = lambda m: np.sqrt([((m - p) ** 2).sum(1) for p in pivots]).T
    for n in range(20):
        ids, score = topk.best(np.arange(500), x, far(x), n, x[n], far(x[n : n + 1])[0], 5)
        want = sorted((-int(v @ x[n]), j) for j, v in enumerate(x) if j != n)[:5]
        assert [(-s, j) for j, s in zip(ids, score, strict=True)] == want


# 7

def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_licenses(docs, texts, spark):
    extra = {
        10**7: "x CC-BY and cc\n\nby; General  Public License. ALL RIGHTS reserved all rights reserved",
        10**7 + 1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                   "documentation files to deal in the Software without restriction",
        10**7 + 2: "hereby charge granted permission of free person any", 10**7 + 3: "", 10**7 + 4: "Released under the MIT License.",
    }
    rows = texts | extra
    found = by_doc(licenses.scan(spark.createDataFrame(list(rows.items()), "doc_id BIGINT, text STRING")))
    for i, text in rows.items():
        words, places, labels = words_of(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            parts = phrase.split()
            own = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            places += own
            labels |= {label} if own else set()
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(words), len(places), min(places, default=None), max(places, default=None)), text[:80]
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert found[10**7 + 1].labels == found[10**7 + 4].labels == "mit" and found[10**7 + 2].labels == ""


MIT = """MIT License

Copyright (c) 2020 A. N. Other

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_licenses_real_wording(docs, spark):
    """Unaltered texts, words put in, and the words' frequencies of other documents or of these alone."""
    grant = MIT.split("Other")[1]
    told = [MIT, grant, "licensed under the MIT License", "Licensed under the MIT License (MIT).", grant.replace(" (the \"Software\")", ""),
            "This work is available under the terms of the MIT license", "x " * 50 + grant.replace("to any person", "to each and any person")]
    other = ["mit", "mit einem licensed under the license of permission", grant.replace("without restriction", "with restriction")]
    rows = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(told + other)], "doc_id BIGINT, text STRING")
    for frame in (rows, rows.unionByName(docs.select("doc_id", "text"))):
        found = by_doc(licenses.scan(frame))
        assert [found[-1 - k].labels for k in range(len(told))] == ["mit"] * len(told)
        assert [found[-1 - len(told) - k].labels for k in range(len(other))] == [""] * len(other)


CATALOGUE = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
    "as published by the Free Software Foundation, either version 3": "agpl,gpl",
    "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication": "cc0", "released under CC0.": "cc0",
    "To the extent possible under law, A. Other has waived all copyright and related or neighboring rights to this work.": "cc0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "Creative Commons Attribution-NonCommercial 4.0 International": "cc-by-nc",
    "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported": "cc-by-nc-sa",
    "Creative Commons Attribution-NonCommercial-NoDerivs 2.5 Generic": "cc-by-nc-nd",
    "Creative Commons Attribution-NoDerivatives 4.0": "cc-by-nd", "Creative Commons Attribution 4.0 International": "cc-by",
    "CC BY-SA 4.0": "cc-by,cc-by-sa", "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa", "CC BY-ND 4.0": "cc-by,cc-by-nd",
    "CC BY-NC": "cc-by,cc-by-nc", "CC-BY-NC-ND": "cc-by,cc-by-nc-nd", "CC BY 4.0": "cc-by",
    "under the terms of the Eclipse Public License v2.0 which is available": "epl",
    "BSD 3-Clause License": "bsd", "the 2-clause BSD license": "bsd", "under the BSD license": "bsd",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions:": "zlib",
    "licensed under the zlib License": "zlib",
}


def test_licenses_catalogue(docs, spark):
    rows = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(CATALOGUE)], "doc_id BIGINT, text STRING")
    for frame in (rows, rows.unionByName(docs.select("doc_id", "text"))):
        found = by_doc(licenses.scan(frame))
        assert {t: found[-1 - k].labels for k, t in enumerate(CATALOGUE)} == CATALOGUE


def test_licenses_awkward(awkward, nothing):
    assert licenses.scan(awkward).count() == len(AWKWARD) and licenses.scan(nothing).count() == 0


# 8

def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    rows = [r for r in queries.QUERIES["op8_toxicity"](spark, folder).collect()]
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    toxic, clean = ([r.score for r in out if truth[r.doc_id] == y] for y in (1, 0))
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.8
    assert all(r.held_out == is_out(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(0 <= r.sentence_start <= r.sentence_end <= len(texts[r.doc_id]) for r in rows)


def test_toxicity_awkward(awkward, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (1, 0)], "doc_id BIGINT, toxic INT")
    assert toxicity.score(awkward, toxicity.fit(awkward, labels)).count() == len(AWKWARD)
    assert toxicity.clean(awkward, labels.limit(0)).columns == awkward.columns
    assert toxicity.clean(nothing, labels).count() == 0


def test_noisy_or():
    model = toxicity.Model({toxicity.features("bad")[0]: 6.0}, -5.0)
    score = model.scorer()
    one, begin, end, worst = score("Fine. So bad! Fine")
    assert "Fine. So bad! Fine"[begin:end].strip() == "So bad" and math.isclose(one, 1 - (1 - worst) * (1 - score("Fine")[0]) ** 2)


# 9

def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    by, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, text in texts.items():
        ids, own = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], sorted(by[i], key=lambda r: r.start)
        assert [k for r in own for k in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) <= packing.CAPACITY
    return sum(r.length for r in rows) / (packing.CAPACITY * len(windows))


def test_packing(docs, texts):
    assert check_pieces(packing.pack(docs).collect(), texts) > 0.97


def test_packing_words(spark):
    odd = ["it's we're I'LL", "x́y ́z", "ΣΑΣ ς", "İstanbul ıi", "a,b. c., d.. %%%,", "<|endoftext|> a<|startoftext|>b", "1st 2,5 ½", "\ta b\x1cc", ""]
    rows = list(enumerate([*odd, " ".join(odd)]))
    check_pieces(packing.pack(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect(), dict(rows))


def test_packing_stems():
    """A stem meets the tokenizer once, in whatever case and with whatever marks; ids are those of the whole word."""
    words = tokens.WordIds(tokens.tokenizer_path(), room=40)
    met = []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **named):
            met.extend(w for t in texts for w in t.split())
            return self.tokenizer.encode_batch_fast(texts, **named)

    words.tokenizer, words.merges_only, whole = Counted(words.tokenizer), Counted(words.merges_only), words.tokenizer
    text = "Stem stem, STEM### stem.$$$ sTEM stem,, Ärger ärger% Ȼa ȼa; Ɓi ɓi! ... ### x's 1st stem1, ,stem straße. i\u0307, \u212bb &amp; a-b"

    def check(text):
        ids, bounds = words.batch(pa.array([text, "", text]))
        want = whole.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and bounds.tolist() == [0, len(want), len(want), 2 * len(want)]

    check(text)
    assert met.count("stem") == met.count("ärger") == met.count("###") == 1 and "STEM###" not in met
    check(text)
    assert met.count("stem") == 1
    letters = [chr(k) for k in range(33, 0x250) if not chr(k).isspace()]
    check(" ".join(f"{a}{b}" for a in letters for b in ("", "x,", ".", "#x#", "!;*")))
    check(text)  # the memory began anew
    assert met.count("stem") == 2


def test_packing_awkward(awkward, nothing):
    found = packing.pack(awkward, as_bytes=True).collect()
    assert sum(r.start == 0 for r in found) == len(AWKWARD) and all(len(r.ids) == 4 * r.length for r in found)
    assert packing.pack(nothing).count() == 0


def test_differencing():
    random = np.random.default_rng(2)
    for parts in (1, 3, 10):
        sizes = random.integers(1, 100, 60).tolist()
        dealt = packing.differencing(sizes, parts)
        assert sorted(k for x in dealt for k in x) == list(range(60)) and len(dealt) == parts
        sums = [sum(sizes[k] for k in x) for x in dealt]
        assert max(sums) - min(sums) <= 15
    assert packing.differencing([], 3) == [] and packing.deal([2048, 2048, 1]) and len(packing.deal([1500, 1500, 1500])) == 3


# 10

def test_warc(spark):
    pages = [(5, "http://a/x", "<p>1</p>"), (3, "http://a/y", "<p>1</p>"), (3, "http://a/y", "<p>1</p>"), (9, None, None), (8, "u", ""),
             (None, "u\r\nX: y", "é"), (7, "u", "long" * 50_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id BIGINT, url STRING, html STRING, sha256 INT")
    archive = warc.write_archive(df)
    assert archive.payloads().count() == 4
    found = warc.read_records(archive).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in found) == Counter((i, (h or "").encode()) for i, _, h in pages)
    for r in found:
        body = bytes(r.payload) if r.record_type == "response" else b""
        assert bytes(r.record) == r.header.encode() + body + b"\r\n\r\n"
        assert f"Content-Length: {len(body)}\r\n\r\n" in r.header and r.header.startswith("WARC/1.1\r\nWARC-Type: ")
        assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() in r.header
    said = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_summary(archive).collect())
    assert said == Counter([(5, "revisit", 3), (3, "response", None), (3, "revisit", 3), (9, "revisit", 8), (8, "response", None),
                            (None, "response", None), (7, "response", None)])
    assert warc.read_summary(warc.write_archive(df.limit(0))).count() == 0


# pipeline

def test_pipeline(spark, sf):
    docs = queries.prepare(spark).read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).persist())
    assert all(df.columns == columns for df in kept[:-1])
    texts = [{r.doc_id: r.text for r in df.collect()} for df in kept[:-1]]
    scores = by_doc(toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).select("doc.doc_id", "score"))
    assert set(texts[1]) == {i for i, r in scores.items() if r.score < 0.5}
    assert set(texts[2]) == {max(i for i in texts[1] if texts[1][i] == t) for t in texts[1].values()}
    _, lowest = brute_links(texts[2])
    assert set(texts[3]) == set(lowest.values())
    assert texts[4] == texts[3] and kept[4].count() >= kept[3].count()
    pieces = kept[5].collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in kept[4].collect())
    assert Counter((r.doc_id, r.start) for r in corpus_pipeline.run(spark, sf).collect() if r.start == 0) == Counter(
        (r.doc_id, r.start) for r in pieces if r.start == 0)
