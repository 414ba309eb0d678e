"""Operators that compare rows with each other, and the pipeline."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossa.llm import jaccard_join, line_dedup, sharding, url_filter
from glossa.llm.components import connected_components
from glossa.llm.queries import URL_RULES

RULES = url_filter.rules_of(URL_RULES)


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [
        (2000, i) for i in range(2001, 2200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots_of({n for e in edges for n in e}, edges)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: r for n, r in want.items() if n in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(rng, words, n, change):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(change + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def brute_components(rows, size, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else frozenset()

    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        by[s].append(i)
    links = [(v[0], i) for s, v in by.items() if s for i in v]
    links += [(by[a][0], by[b][0]) for a, b in itertools.combinations([s for s in by if s], 2)
              if 100 * len(a & b) >= percent * len(a | b)]
    root = roots_of(range(len(rows)), links)
    name = {}
    for i, (k, _) in enumerate(rows):
        if sets[i] and k is not None:
            name[root[i]] = min(name.get(root[i], k), k)
    return sorted((str(k), len(sets[i]), str(name.get(root[i]) if sets[i] else k)) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, docs, odd_rows, size, percent):
    rng = random.Random(size)
    texts = []
    for length in (4, 12, 40, 90, 300):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        texts += variants(rng, base, 14, max(1, length // 25))
    texts += [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    passage = " ".join(f"shared{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"z{rng.randrange(9999)}" for _ in range(50)) for _ in range(20)]
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(texts))]
    out = jaccard_join.components(docs(rows), "doc_id", "text", size, percent).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component"])) for r in out) == brute_components(rows, size, percent)


def test_keep_one(spark, docs, odd_rows):
    kept = jaccard_join.keep_one(docs(odd_rows), "doc_id", "text")
    assert kept.columns == docs([]).columns
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    assert got == sorted(["1", "2", "3", "4", "None", "5", "7", "8", "9"])  # None: the row without text
    assert jaccard_join.keep_one(docs([]), "doc_id", "text").count() == 0


def test_null_ids_are_linked(spark, docs):
    """A null id first in a group of near copies, one as a near copy, and two near copies with null ids only."""
    a, b = ([f"{x}{i}" for i in range(200)] for x in "pq")
    near = [" ".join([*a[:k], "new", *a[k + 1:]]) for k in (50, 120)]
    rows = [(None, " ".join(a)), (1, " ".join(a)), (2, near[0]), (None, near[1]),
            (None, " ".join(b)), (None, " ".join(["new", *b[1:]]))]
    df = docs(rows).coalesce(1)
    out = jaccard_join.components(df, "doc_id", "text", 3, 90).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component"])) for r in out) == brute_components(rows, 3, 90)
    kept = jaccard_join.keep_one(df, "doc_id", "text", 3, 90).collect()
    assert sorted((str(r["doc_id"]), r["text"].count("p1") > 0) for r in kept) == [("1", True), ("None", False)]


def test_segments_keep_the_pigeonhole_promise():
    import numpy as np

    rng = np.random.default_rng(5)
    for percent in (80, 90):
        bands = jaccard_join.Bands(percent)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2))
            drop = int(len(a) * rng.random() * (100 - percent) / 100)
            b = a[drop:]
            b = np.unique(np.concatenate([b, rng.integers(0, 2 ** 63, int(rng.integers(0, 4)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = (jaccard_join.segment_tokens(s, bands) for s in (a, b))
                assert len(np.intersect1d(x, y))
                differ = sum(int(p ^ q).bit_count() for p, q in zip(
                    *(jaccard_join.parity_sketch(s).view(np.uint64).tolist() for s in (a, b)), strict=True))
                assert differ <= len(a) + len(b) - 2 * both


def test_unrelated_sets_share_no_segments():
    """Unrelated sets name no empty segments, which they would have in common."""
    import numpy as np
    from collections import Counter

    rng = np.random.default_rng(11)
    bands = jaccard_join.Bands(80)
    shares = Counter()
    for _ in range(3000):
        own = rng.integers(0, 2 ** 63, int(rng.integers(150, 200)), dtype=np.uint64)
        shares.update(jaccard_join.segment_tokens(np.unique(own) * np.uint64(2), bands).tolist())
    assert sum(n * (n - 1) // 2 for n in shares.values()) < 3000


def test_line_dedup(spark, docs, odd_rows):
    rng = random.Random(9)
    line = " ".join(f"token{rng.randrange(10 ** 6)}" for _ in range(300))
    near = line.replace(line.split()[7], "other", 1)
    rows = [*odd_rows, (50, f"{line}\nown line of fifty"), (51, f"first of its kind\n  {line.upper()} \n\n{line}"), (52, near)]
    got = {(r["doc_id"], r["n_lines"]): r["dropped"] for r in line_dedup.report(docs(rows), "doc_id", "text").collect()}
    assert got[(1, 2)] == [] and got[(None, 2)] == [0, 1] and got[(6, 1)] == [0] and got[(5, 1)] == []
    assert got[(50, 2)] == [] and got[(51, 4)] == [1, 3] and got[(52, 1)] == [0]
    kept = line_dedup.without_lines(docs(rows), "doc_id", "text")
    assert kept.columns == docs([]).columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 52 not in texts and 6 not in texts and texts[51] == "first of its kind\n" and texts[2] is None and texts[3] == ""
    assert line_dedup.report(docs([]), "doc_id", "text").count() == 0


def edit_similar(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    longest = max(len(a), len(b))
    return row[-1] <= int(longest * (1 - line_dedup.SIMILARITY) + 1e-9)


def test_line_groups_equal_brute_force(spark, docs):
    """Components of all line pairs that share a block, are close in bits and similar by edits."""
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        texts += variants(rng, [f"w{rng.randrange(10 ** 5)}" for _ in range(25)], 9, 2)
    df = docs([(i, t) for i, t in enumerate(texts)])
    lines = line_dedup._lines(df, "doc_id", "text").select("h", "norm").distinct()
    hashed = line_dedup._simhashed(lines).join(line_dedup._windowed(lines), "h")
    rows = hashed.join(df.select(F.xxhash64("text").alias("h"), "text").distinct(), "h").select(
        "h", "s0", "s1", line_dedup._blocks().alias("b"), "text").collect()
    links = []
    for x, y in itertools.combinations(rows, 2):
        bits = sum(((x[s] ^ y[s]) & (2 ** 64 - 1)).bit_count() for s in ("s0", "s1"))
        if set(x["b"]) & set(y["b"]) and bits <= line_dedup.MAX_HAMMING and edit_similar(x["text"], y["text"]):
            links.append((x["h"], y["h"]))
    want = {n: r for n, r in roots_of({r["h"] for r in rows}, links).items() if any(n in e for e in links)}
    got = {r["node"]: r["root"] for r in line_dedup.line_groups(df, "doc_id", "text")[1].collect()}
    assert links and got == want


def similar_pairs(texts):
    """Pairs with an edit similarity of at least 0.8, however long and whatever else."""
    rows = sorted(set(texts))
    out = []
    for a, b in itertools.combinations(rows, 2):
        most = max(len(a), len(b)) // 5
        if abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most:
            out.append((a, b))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def grouped(spark, docs, texts):
    """The group of each text; one of its own if it is in none."""
    df = docs(list(enumerate(texts)))
    roots = {r["node"]: r["root"] for r in line_dedup.line_groups(df, "doc_id", "text")[1].collect()}
    return {r["text"]: roots.get(r["h"], r["h"]) for r in df.select("text", F.xxhash64("text").alias("h")).collect()}


def edited(rng, text, share, alphabet):
    """``text`` with a share of its characters changed, left out or doubled."""
    out = list(text)
    for _ in range(int(len(text) * share)):
        i = rng.randrange(len(out))
        out[i] = rng.choice([rng.choice(alphabet), "", out[i] * 2])
    return "".join(out)


def test_line_dedup_finds_similar_pairs(spark, docs):
    """Recall against all pairs of similarity 0.8, whatever their SimHashes; all of the short ones."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(400)]
    long, short = [], []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(12, 40))
        near = list(base)
        for i in rng.sample(range(len(near)), len(near) // 7):
            near[i] = rng.choice(words)
        long += [" ".join(base), " ".join(near)]
    for _ in range(150):
        base = "".join(rng.choices("abcde ", k=rng.randrange(4, 15))).strip(" ")
        short += [" ".join(x.split()) for x in (base, edited(rng, base, 0.15, letters) + rng.choice(letters))]
    short = [x for x in short if x and len(x) <= 14]
    for texts, least in ((long, 0.95), (short, 1)):
        pairs = similar_pairs(texts)
        group = grouped(spark, docs, texts)
        assert len(pairs) > 40
        assert sum(group[a] == group[b] for a, b in pairs) >= least * len(pairs)


def test_line_dedup_needs_no_blanks(spark, docs):
    """Lines without blanks, and of other scripts, are compared like others."""
    rng = random.Random(15)
    texts = []
    for alphabet, n in (("的一是在不了有和人这中大为上个国我以要他", 60), ("abcdefghijklmnopqrstuvwxyz0123456789/", 200), ("กขคงจฉชซดตถ", 90)):
        for _ in range(8):
            base = "".join(rng.choices(alphabet, k=n))
            texts += [base, base[:n // 2] + rng.choice(alphabet) + base[n // 2 + 1:], base[:n // 3] + base[n // 3 + 3:]]
    pairs = similar_pairs(texts)
    group = grouped(spark, docs, texts)
    assert len(pairs) >= 60 and all(group[a] == group[b] for a, b in pairs)


def test_line_dedup_long_lines(spark, docs):
    """A fifth of the characters may differ in long lines as in short ones, and beyond 100,000 words."""
    rng = random.Random(16)
    texts, same, other = [], [], []
    for n, share in ((130, 0.14), (600, 0.12), (600, 0.3), (110_000, 0)):
        base = [f"{rng.randrange(10 ** 5):05d}" for _ in range(n)]
        near = list(base)
        for i in rng.sample(range(n), int(n * share)) or (5000, 5001, 5002):
            near[i] = "!!!!!"
        texts += [" ".join(base), " ".join(near)]
        (other if share > 0.2 else same).append(tuple(texts[-2:]))
    group = grouped(spark, docs, texts)
    assert all(group[a] == group[b] for a, b in same) and all(group[a] != group[b] for a, b in other)


def test_simhash_equals_counting(spark, docs):
    """Each bit is the weighted majority of the words' bits, ties by the line's hash; lines of one word to many runs."""
    rng = random.Random(6)
    lines = [" ".join("z" * rng.randrange(14) + f"{rng.randrange(10 ** 4)}" for _ in range(n)) for n in (1, 2, 2, 4, 99, 100, 101, 950)]
    df = docs(list(enumerate(lines)))
    found = line_dedup._lines(df, "doc_id", "text").select("h", "norm")
    of = {}
    for r in found.select("h", F.explode(F.array_distinct(F.split("norm", " "))).alias("w")).withColumn(
            "x0", F.xxhash64("w")).withColumn("x1", F.xxhash64("x0")).collect():
        of.setdefault(r["h"], []).append((min(max(len(r["w"]) - 2, 1), line_dedup.MAX_WEIGHT), r["x0"], r["x1"]))
    got = {r["h"]: (r["s0"], r["s1"]) for r in line_dedup._simhashed(found).collect()}
    assert len(got) == len(lines)
    for h, words in of.items():
        total = sum(w for w, *_ in words)
        for s in (0, 1):
            counts = [sum(w for w, *x in words if x[s] >> i & 1) for i in range(60)]
            assert got[h][s] == sum((2 * c + (h >> i & 1 if total % 2 == 0 else 0) > total) << i for i, c in enumerate(counts))


def test_simhash_of_long_words(spark, docs):
    """A word without blanks counts as its windows of bytes, each once and with weight 1."""
    rng = random.Random(7)
    lines = ["".join(rng.choices("abcdef", k=n)) for n in (24, 25, 400)] + ["short ones " + "的一是在不了有和人这" * 3, "x" * 60]
    found = line_dedup._lines(docs(list(enumerate(lines))), "doc_id", "text").select("h", "norm")
    rows = found.select("norm", F.posexplode(line_dedup._features(F.col("norm")))).collect()
    got = {x: sorted(bytes(r["col"]) for r in rows if r["norm"] == x) for x in lines}
    for x in lines:
        want = set()
        for w in x.split(" "):
            w = w.encode()
            want |= {w} if len(w) <= 24 else {b"\0" + w[i:i + 6] for i in range(len(w) - 5)}
        assert got[x] == sorted(want)


def test_line_dedup_of_boilerplate_is_not_quadratic(spark, docs, monkeypatch):
    """Thousands of lines with one prefix share windows, yet few pairs are compared; their near copies are found."""
    rng = random.Random(21)
    tails = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60)) for _ in range(4000)]
    texts = [f"printed by the same shop {t}" for t in tails] + [f"printed by the same shop {t[:30]}#{t[31:]}" for t in tails[:40]]
    asked = []
    compare = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, t: (asked.append(pairs.count()), compare(pairs, t))[1])
    group = grouped(spark, docs, texts)
    assert sum(asked) < 400_000  # of 8 million
    assert sum(group[texts[i]] == group[texts[4000 + i]] for i in range(40)) >= 39
    assert len(set(group.values())) >= 3990


def test_middles_keep_the_edit_distance(spark):
    rng = random.Random(8)
    pairs = []
    while len(pairs) < 300:
        x = [rng.choice(["a", "bb", "b", "cab"]) for _ in range(rng.randrange(1, 9))]
        y = list(x)
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(y) + 1)
            y[at:at + rng.randrange(2)] = rng.choices(["a", "bb", "new"], k=rng.randrange(3))
        if y and x != y:
            pairs.append((" ".join(x), " ".join(y)))
    pairs.append(("same " * 50 + "end", "same " * 50 + "fin"))
    df = spark.createDataFrame(pairs, "x string, y string")
    a, b = line_dedup._middles(F.col("x"), F.col("y"))
    rows = df.select(F.levenshtein("x", "y").alias("whole"), a.alias("a"), b.alias("b")).select(
        "whole", F.levenshtein("a", "b").alias("middle"), "a").collect()
    assert all(r["whole"] == r["middle"] for r in rows) and rows[-1]["a"] == "same end"


def test_sharding(spark, docs, odd_rows):
    rows = [*odd_rows, *((i, str(i)) for i in range(1000, 5000))]
    df = docs(rows).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), F.col("shard").alias("slot0"))
    out = sharding.with_slots(sharding.assign(df, "doc_id", [1.0, 1.0, 2.0]), ["doc_id", "crc"]).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 3)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert 0.45 < len(by[2]) / len(rows) < 0.55
    grown = sharding.assign(df, "doc_id", [1.0, 1.0, 2.0, 1.0]).select("doc_id", "shard").collect()
    assert {(r["doc_id"], r["shard"]) for r in grown} == {(r["doc_id"], r["grown_shard"]) for r in out}
    assert sharding.with_slots(sharding.assign(df.limit(0), "doc_id", [1.0]), ["doc_id"]).count() == 0


def brute_judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r for r in RULES for h, _, p in [r.key.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


@pytest.mark.parametrize("max_rules", [url_filter.MAX_RULES, 0])
def test_url_rules_equal_brute_force(spark, monkeypatch, max_rules):
    monkeypatch.setattr(url_filter, "MAX_RULES", max_rules)
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "x.net", "net", "com", "notexample.com", "ex.org", "a..net", ""]
    urls = [f"{s}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/1?q=/fr/', '/fr/x#y', '/EN/', '?a=/en/'])}"
            for s in ("http", "https", "x\n") for _ in range(60)] + [None, "", "no scheme", "http://", "a://b://c/en/", "http://net/es/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, "page_id", "url", RULES).collect()}
    assert got == {i: brute_judge(u) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), "page_id", "url", RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, "page_id", "url", []).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("pmod(xxhash64(key), 50) = 0")
    levels = url_filter.build_cascade(keys, listed)
    assert len(levels) > 1
    assert sum(f.n_bits for f in levels) < 20 * listed.count() + 2000  # follows the list, not the universe
    wrong = keys.select("key", url_filter.is_listed(F.col("key"), levels).alias("in")).where(
        F.col("in") != (F.expr("pmod(xxhash64(key), 50)") == 0))
    assert wrong.count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        assert 0 < docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == before and all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)
