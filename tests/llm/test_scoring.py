"""Language-model scoring, ranked search and centroid clustering against brute force, with odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import centroids, lexical_search, match_model

ODD = ["", None, " ", "\n\n", "a", "Ünïcödé ß 漢字 \x1c\x85\xa0 x", "The the THE\vthe", "a" * 3000, "\U0001f600 x"]


def plain_cost(trie, text, order):
    """log10 probability of a text and its end by the definition."""
    flat, total = b"\xff" * order + text + b"\xff", 0.0
    for p in range(order, len(flat)):
        excluded = set()
        for k in range(order, -1, -1):
            seen = {s: n for s, n in trie[flat[p - k : p]].items() if s not in excluded}
            room = sum(seen.values()) + len(seen)
            if flat[p] in seen:
                total += math.log10(seen[flat[p]] / room)
                break
            if seen:
                total += math.log10(len(seen) / room)
                excluded |= seen.keys()
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.mark.parametrize(("order", "block"), [(1, 1 << 20), (3, 20), (5, 200)])
def test_match_model_is_the_definition(spark, order, block):
    rng = random.Random(order)
    texts = ODD + [" ".join(rng.choices(["the", "then", "Cat", "sat", "été", "on", "mat."], k=rng.randint(1, 30))) for _ in range(40)]
    rows = [(i if i != 20 else None, t, "x") for i, t in enumerate(texts + texts[-3:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string").repartition(3)
    trains = F.col("doc_id") % 3 != 0
    got = match_model.score(docs, trains, order=order, block_bytes=block, part_bytes=64).collect()
    trie, tokens = defaultdict(Counter), Counter()
    for i, t, _ in rows:
        if i is not None and i % 3:
            text = match_model.normal((t or "").encode())
            flat = b"\xff" * order + text + b"\xff"
            for p in range(order, len(flat)):
                for k in range(order + 1):
                    trie[flat[p - k : p]][flat[p]] += 1
            tokens.update([*text.split(), None])
    n, v = sum(tokens.values()), len(tokens)
    want = []
    for i, t, _ in rows:
        text = match_model.normal((t or "").encode())
        own = [*text.split(), None]
        want.append((i, len(own), sum(tokens[w] > 0 for w in own), n, sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), plain_cost(trie, text, order)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-8)


def test_match_model_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in match_model.score(docs, F.lit(None).cast("boolean"), order=2).collect()}
    assert got[2].score == pytest.approx(-math.log10(256)) and got[1].score == pytest.approx(-3 * math.log10(256))
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].base_score == pytest.approx(0.0)
    assert match_model.score(docs.limit(0), F.lit(True)).count() == 0


def test_match_model_knows_its_language(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choices(["th", "er", "on", "in"], k=3)) for _ in range(40))
    noise = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=280))
    docs = spark.createDataFrame([(i, text() if i < 60 else noise()) for i in range(80)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in match_model.score(docs, F.col("doc_id") < 40).collect()}
    assert min(got[i] for i in range(40, 60)) > max(got[i] for i in range(60, 80))


def test_adaptive_length(spark):
    for text in (b"", b"abracadabra", "été été".encode()):
        trie, total, order = defaultdict(Counter), 0.0, 3
        flat = b"\xff" * order + text + b"\xff"
        for p in range(order, len(flat)):
            excluded = set()
            for k in range(order, -1, -1):
                seen = {s: n for s, n in trie[flat[p - k : p]].items() if s not in excluded}
                if flat[p] in seen or seen:
                    room = sum(seen.values()) + len(seen)
                    total += math.log10((seen.get(flat[p]) or len(seen)) / room)
                if flat[p] in seen:
                    break
                excluded |= seen.keys()
            else:
                total -= math.log10(256 - len(excluded))
            for k in range(order + 1):
                trie[flat[p - k : p]][flat[p]] += 1
        assert match_model.adaptive_length(text, order) == pytest.approx(total)
    got = match_model.adaptive(spark.createDataFrame([(1, "ab ab ab"), (None, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.adaptive_score for r in got} == pytest.approx({1: match_model.adaptive_length(b"ab ab ab"), None: -math.log10(256)})


def plain_search(docs, items, top):
    import regex

    found = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [Counter(found(t)) for _, t in docs]
    n, total = sum(map(bool, counts)), sum(sum(c.values()) for c in counts)
    df = Counter(w for c in counts for w in c)
    out = []
    for number, (item, text) in enumerate(items):
        scores = []
        for at, ((i, _), c) in enumerate(zip(docs, counts)):
            m = 10 + (90 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(found(text)) if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, at, i))
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize(("top", "probes", "block"), [(10, 50, 1 << 18), (3, 3, 7), (1, 1, 1 << 18)])
def test_search_is_brute_force(spark, top, probes, block):
    rng = random.Random(top)
    words = [f"w{i}" for i in range(60)] + ["Été", "x-y", "ÀB", "9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(None, docs[7][1]), (7, docs[7][1]), (8, docs[9][1])] + [(2000 + i, t) for i, t in enumerate(ODD)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 25)))) for i in range(25)] + [(3, docs[5][1]), (50, None), (51, ""), (52, "nowhere"), (None, "w3 w4")]
    made = spark.createDataFrame([(i, t, 1, 1) for i, t in docs], "doc_id long, text string, term int, row int").coalesce(1)
    got = lexical_search.search(made, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int"), top=top, probes=probes, block_terms=block)
    assert Counter(map(tuple, got.collect())) == Counter(plain_search(docs, items, top))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def plain_clusters(points, order, k, rounds):
    centres = [list(points[i]) for i in order[:k]]
    near = lambda p: min(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, centres[c])), c))
    for _ in range(rounds):
        own = [near(p) for p in points]
        for c in range(len(centres)):
            if mine := [p for p, o in zip(points, own) if o == c]:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [near(p) for p in points]
    return own, [sum((a - b) ** 2 for a, b in zip(p, centres[o])) for p, o in zip(points, own)]


@pytest.mark.parametrize("clusters", [1, 5, 40])
def test_clusters_are_brute_force(spark, clusters):
    import hashlib

    draw = np.random.default_rng(clusters)
    vectors = [(draw.integers(-3, 4, 4) / 1024 * (1 if i % 2 else 40)).tolist() for i in range(150)]  # small numbers: many ties
    vectors += [vectors[0]] * 60
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [1.0], 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [float("nan")] * 4, 1), (904, [float("inf"), 0.0, 0.0, 0.0], 1), (905, [1e30, 0.0, 0.0, 0.0], 1), (906, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = {r.vec_id: r for r in centroids.cluster(df, clusters=clusters, rounds=6, dim=4).collect()}
    points = [[math.floor(1024 * x) for x in v] for v in vectors]
    order = sorted(range(len(points)), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    own, distance = plain_clusters(points, order, clusters, 6)
    assert [got[i].cluster for i in range(len(points))] == own and [got[i].distance for i in range(len(points))] == distance
    assert len(got) == len(points) and {r.inertia for r in got.values()} == {sum(distance)}
    assert all(got[i].cluster_inertia == sum(d for d, o in zip(distance, own) if o == own[i]) for i in range(len(points)))


def test_annuli_rule_centroids_out():
    draw = np.random.default_rng(1)
    size = np.exp(draw.uniform(0, 6, 4000))
    points = np.floor(draw.standard_normal((4000, 8)) * size[:, None] * 20).astype(np.int64)
    centres = points[:200]
    annuli = centroids.Annuli(centres)
    start = ((points[:, None] - centres) ** 2).sum(2)
    best, least = annuli.assign(points, start.argmin(1))
    assert (least == start.min(1)).all() and (best == start.argmin(1)).all()
    assert annuli.compared < 0.5 * len(points) * len(centres)
    for first in (0, 199):  # whatever the bound, the result is the same
        again = annuli.assign(points, np.full(len(points), first))
        assert (again[0] == best).all() and (again[1] == least).all()


def test_clusters_of_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0] * 64), (None, [1.0] * 64), (1, [0.5] * 64)], "vec_id long, embedding array<float>")
    got = centroids.cluster(df).collect()
    assert len(got) == 3 and all(r.distance == 0 for r in got)
    empty = centroids.cluster(df.limit(0))
    assert empty.count() == 0 and dict(empty.dtypes)["distance"] == "bigint"
