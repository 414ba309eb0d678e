"""Source divergence, Merkle manifest and WARC archives against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossa.llm import divergence, merkle, warc
from glossa.llm.common import landed

# ---- source divergence ----

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"


def brute_divergence(rows, min_docs, top):
    docs = [((r[2] or ""), (r[3] or ""), [w.decode() for w in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").encode())])
            for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(a, b, [w.translate(low) for w in ws]) for a, b, ws in docs]
    df = Counter((a, w) for a, _, ws in docs for w in set(ws))
    kept = defaultdict(list)
    for (a, w), n in df.items():
        if n >= min_docs:
            kept[a].append(w)
    count = Counter((a, b, w) for a, b, ws in docs for w in ws)
    whole = Counter((a, w) for a, _, ws in docs for w in ws)
    groups = sorted({(a, b) for a, b, _ in docs})

    def share(c, n, v):
        return 1 + 10 ** 9 * (c + 5) // (n + 5 * v)

    out = []
    p = {}
    for a, b in groups:
        ws, v = kept[a], len(kept[a])
        p[a, b] = {w: share(count[a, b, w], sum(count[a, b, x] for x in ws), v) for w in ws}
        q = {w: share(whole[a, w], sum(whole[a, x] for x in ws), v) for w in ws}
        terms = [(w, p[a, b][w] - q[w]) for w in ws if count[a, b, w] and p[a, b][w] > q[w]]
        terms.sort(key=lambda t: (-t[1], t[0].encode()))
        out += [(a, b, "term", w, f, i) for i, (w, f) in enumerate(terms[:top], 1)]
    for a, b in groups:
        pairs = [(c, sum(abs(p[a, b][w] - p[a, c][w]) for w in kept[a])) for x, c in groups if x == a and c != b]
        pairs.sort(key=lambda t: (-t[1], t[0].encode()))
        out += [(a, b, "pair", c, f, i) for i, (c, f) in enumerate(pairs, 1)]
    return sorted(out)


def divergence_rows():
    rows, words = [], ["Été", "apple", "APPLE", "b9c", "中文 字", "x", "y", "zebra\x00tail", "Straße"]
    for i in range(160):
        lang, source = [("en", "a"), ("en", "b"), ("fr", "a"), ("en", None), (None, "a"), ("xx", "only")][i % 6]
        picked = [words[(i * k + k * k) % len(words)] for k in range(i % 11)]
        rows.append((i, " ".join(picked) if i % 13 else None, lang, source, "clash", 1))
    rows += [(200, "", "en", "empty", "clash", 1), (201, None, None, None, None, None), (202, "one " * 40_000, "en", "a", "t", 2),
             (203, "x y", "zz", "s1", "", 0), (204, "x", "zz", "s2", "", 0), rows[5], rows[5]]
    return rows


def divergence_of(spark, rows, n=5, top=4):
    return sorted(tuple(r) for r in divergence.audit(
        spark.createDataFrame(rows, SCHEMA), "lang", "source", "text", n, top).collect())


def test_divergence_equals_brute_force(spark, monkeypatch):
    rows = divergence_rows()
    want = brute_divergence(rows, 5, 4)
    assert divergence_of(spark, rows) == want
    assert {r[5] for r in want if r[2] == "pair" and r[0] == "zz"} == {1} and all(r[4] == 0 for r in want if r[0] == "zz")
    # many shards, partial counts that are sent on early: the same
    monkeypatch.setattr(divergence, "SHARD_ROWS", 3)
    monkeypatch.setattr(divergence, "EMIT_ROWS", 4)
    assert divergence_of(spark, rows) == want


def test_divergence_of_nothing(spark):
    assert divergence_of(spark, []) == []
    assert divergence_of(spark, [(1, None, None, None, None, None)]) == []
    one = divergence_of(spark, [(1, "a", "l", "s", "", 1), (2, "", "l", "t", "", 1)], n=1)
    assert [r[:5] for r in one] == [("l", "s", "pair", "t", 0), ("l", "t", "pair", "s", 0)]


def test_share_is_exact_for_large_counts(spark):
    n = 7 * 10 ** 17
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(3 * n), F.lit(10 ** 6))).first()[0]
    assert got == 1 + 10 ** 9 * (n + 5) // (3 * n + 5 * 10 ** 6)


# ---- Merkle manifest ----


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16]).encode()) for i in range(0, len(levels[-1]), 16)])
    return levels


def beside(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append((level[run:at], level[at + 1:run + 16]))
        at //= 16
    return out


def brute_manifest(rows):
    """Rows of (key, group, leaf, replacement) in hex."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees.append(brute_tree([r[2] for r in by[g]]))
    top = brute_tree([t[-1][0] for t in trees])
    out = []
    for i, g in enumerate(order):
        for at, r in enumerate(by[g]):
            path = beside(trees[i], at) + beside(top, i)
            digest = r[3]
            for left, right in path:
                digest = sha("".join(left + [digest] + right).encode())
            out.append((r[0], r[2], trees[i][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path).encode()), digest))
    return sorted(out, key=str)


def manifest_of(spark, rows):
    df = spark.createDataFrame([(k, g, bytes.fromhex(a), bytes.fromhex(b), "x", 1, "t") for k, g, a, b in rows],
                               "key long, grp string, a binary, b binary, tree string, at int, digest string")
    out = merkle.manifest(df, "key", "grp", F.col("a"), F.col("b"))
    return sorted([(r[0], *[bytes(x).hex() for x in r[1:]]) for r in out.collect()], key=str)


def merkle_rows(n, groups):
    rows = []
    for i in range(n):
        leaf = sha(b"%d" % i)
        rows.append(((i * 37) % 1009, groups[i % len(groups)], leaf, sha(b"other") if i % 5 == 0 else leaf))
    return rows


@pytest.mark.parametrize("n, groups, fan_levels", [(1, ["a"], 3), (2, [None], 3), (17, ["a"], 3), (300, ["a", "b", None, "é", "a", "a"], 3),
                                                   (600, ["a", "b", "a", "a"], 1), (40, [f"g{i:02}" for i in range(40)], 1)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, groups, fan_levels):
    monkeypatch.setattr(merkle, "LEVELS", fan_levels)  # chunks of one level climb and come down in several rounds
    monkeypatch.setattr(merkle, "CHUNK", 16 ** fan_levels)
    rows = merkle_rows(n, groups)
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_manifest_ties_repeats_nulls_and_nothing(spark):
    same = sha(b"same")
    rows = [(None, "a", same, same), (None, "a", sha(b"z"), sha(b"y")), (3, "a", same, same), (3, "a", same, same), (5, None, same, same)]
    got = manifest_of(spark, rows)
    assert got == brute_manifest(rows) and len(got) == 5
    assert manifest_of(spark, []) == []


def test_leaf_fields(spark):
    df = spark.createDataFrame([(1, None, "é\n", ""), (None, "-", None, "a" * 300_000)], "i long, a string, b string, c string")
    got = [bytes(r[0]).hex() for r in df.select(merkle.leaf_of([F.col(c) for c in df.columns])).collect()]
    assert got == [sha("1:1-3:é\n0:".encode()), sha(b"-1:--300000:" + b"a" * 300_000)]


def test_states_are_resumed_with_right_siblings_only():
    children = [sha(b"%d" % i).encode() for i in range(16)]
    parent = merkle.Parent(children)
    for slot in range(16):
        assert merkle.resumed(parent.states[slot], children[slot], parent.right(slot)) == parent.digest
        changed = [*children[:slot], b"0" * 64, *children[slot + 1:]]
        assert merkle.resumed(parent.states[slot], b"0" * 64, parent.right(slot)).decode() == sha(b"".join(changed))


# ---- WARC ----

PAGE = "page_id long, url string, html string, digest string, n int, rid string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], PAGE)


def page_rows():
    big, trap = "é\r\n\r\n" * 400, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30
    return [(1, "http://a/", big), (2, "http://b/ x?q=ü\r\nEvil: 1", big), (9, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None),
            (7, "u", ""), (8, "u", trap), (10, "u", trap), (10, "u", trap), (10, "v", trap), (None, "u", big), (12, "u", "x" * 3_000_000),
            (13, "u", "y" * 1000), (14, "u", "y" * 1000), (15, "u", "y" * 999 + "z"), (16, "u", "w" * 999), (17, "u", "w" * 999)]


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_archives_give_every_record_back(spark, codec):
    rows = page_rows()
    path = warc.write_archives(pages(spark, rows), "page_id", "url", "html", codec=codec)
    found = landed(warc.read_archives(spark, path, with_payload=True), "test-read")
    got = warc.resolved(found).collect()
    distinct = {(None if k is None else str(k), u, h or "") for k, u, h in rows}
    assert len(got) == len(distinct)  # equal rows are one record
    assert sorted((r["key"] or "", bytes(r["payload"]).decode()) for r in got) == sorted((k or "", h) for k, _, h in distinct)
    assert all(r["intact"] for r in got)
    by = {(r["key"], r["url"]): r for r in got}
    for (key, url), top in {("1", "http://a/"): "9", (None, "u"): "9", ("8", "u"): "10", ("13", "u"): "14"}.items():
        assert (by[key, url]["record_type"], by[key, url]["refers_key"]) == ("revisit", top)
    assert sorted(r["record_type"] for r in got if r["key"] == "10") == ["response", "revisit"]
    assert by["2", "http://b/%20x?q=%C3%BC%0D%0AEvil:%201"]["record_type"] == "revisit"
    for key in ("4", "5", "6", "7", "12", "14", "15", "16", "17"):
        assert (by[key, "u"]["record_type"], by[key, "u"]["refers_key"]) == ("response", None)
    assert by["9", None]["record_type"] == "response" and by["9", None]["n"] == 400 * 6
    stored = found.where("n > 0 AND n >= 1000").groupBy("digest").count().where("count > 1").count()
    assert stored == 0  # each large payload stands once


def test_archives_of_nothing_and_a_broken_archive(spark):
    path = warc.write_archives(pages(spark, []), "page_id", "url", "html")
    assert warc.resolved(landed(warc.read_archives(spark, path), "test-read")).count() == 0
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [bytes(b) for _, b in warc.parse(good * 2)] == [b"ab", b"ab"]
    with pytest.raises(ValueError):
        list(warc.parse(good.replace(b": 2", b": 1")))


def test_a_payload_that_most_records_share(spark, monkeypatch):
    """Shared by few (shuffled) and by many (broadcast) alike."""
    rows = [(i, f"u{i}", "hot" * 500) for i in range(300)] + [(1000 + i, "u", f"cold{i // 2}" * 300) for i in range(40)]
    for share in (2, 1 << 16):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        path = warc.write_archives(pages(spark, rows), "page_id", "url", "html")
        got = warc.resolved(landed(warc.read_archives(spark, path), "test-read")).collect()
        assert len(got) == 340 and all(r["intact"] for r in got)
        assert {(r["record_type"], r["refers_key"]) for r in got if int(r["key"]) < 299} == {("revisit", "299")}
        assert sum(r["record_type"] == "response" for r in got) == 21


def test_a_revisit_whose_response_is_missing(spark):
    rows = spark.createDataFrame([("a", "revisit", "1", None, "b", "00", 0, "00")],
                                 "rid string, record_type string, key string, url string, refers_rid string, declared string, n long, digest string")
    out = warc.resolved(rows).first()
    assert (out["refers_key"], out["n"], out["intact"]) == (None, None, False)
