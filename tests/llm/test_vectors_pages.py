"""Vectors, URLs and archives on small fixtures, against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from seqloom.llm import ann, queries, urls, vectors, warc

SCHEMA = "vec_id long, embedding array<float>, label int"


def fixture(spark, seed=1, n=700, d=24):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(100, 200):
        v[i] = v[i % 7] + rng.normal(size=d).astype(np.float32) * 0.12
    v[300:340] = v[3]
    v[350:380] *= 3
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [0.0] * d, 0), (n + 2, [float("nan")] + [1.0] * (d - 1), 0), (n + 3, [None] + [1.0] * (d - 1), 0), (n + 4, [float("inf")] * d, 0), (None, [1.0] * d, 0), (0, [float(x) for x in v[0]], 0), (n + 5, [1.0], 0), (n + 6, [], 0)]
    return spark.createDataFrame(rows + odd, SCHEMA), v.astype(float), n


def brute_links(v, n, extra):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    out = {i: (int(near[i].sum()), find(i)) for i in range(n)}
    return out | {n + k: (0, n + k) for k in range(extra)}


@pytest.mark.parametrize("block,tile", [(8192, 1024), (150, 64)])
def test_links_match_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "TILE", tile)
    df, v, n = fixture(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df.withColumn("n", F.lit("old"))).collect()}
    assert got == brute_links(v, n, 7)


def test_bound_never_loses_a_pair():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 40))
    v[150:] = v[:150] + rng.normal(size=(150, 40)) * 0.3
    axes = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    b = vectors.Block(np.arange(300), v, np.ones(300, int), axes)
    got = {(int(i), int(j)) for x, y in vectors.tile_links(b, b, True, 0.9) for i, j in zip(x, y)}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.9} and got


def test_empty_vectors(spark):
    df, _, n = fixture(spark)
    assert vectors.near_duplicates(df.limit(0)).count() == 0 == ann.nearest(df.limit(0), F.col("id") % 20 == 0).count()
    assert vectors.near_duplicates(df.where("vec_id >= 700")).where("n_links > 0 or not kept").count() == 0


def test_each_length_is_compared_within_itself_and_tiny_or_huge_components_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 3)
    rows = [(i, [float(i == j) for j in range(3)] if i < 3 else [1.0, float(i), 2.0]) for i in range(10)]
    rows += [(20, [1.0, 2.0]), (21, [1.0, 2.0]), (22, [2.0, 1.0]), (40, [1e-200, 2e-200, 0.0]), (41, [1e200, 2e200, 0.0]), (42, [5e-324, 0.0]), (43, [1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    clean = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in clean.items()}
    near = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.9} for i in unit}
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in near.items()}
    assert got[20] == got[21] == (1, 20) and got[41] == got[40] and got[43] == (1, 42)
    found = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, 20).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {q: len(x) for q, x in found.items()} == {0: 11, 20: 4, 40: 11}
    assert found[20][0] == 43 and found[40][0] == 41


@pytest.mark.parametrize("block", [16 << 20, 200 * 8 * 24])
def test_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK_BYTES", block)
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    df, v, n = fixture(spark)
    hit = total = 0
    by = {}
    for r in ann.nearest(df.withColumn("rank", F.lit("old")), F.col("id") % 20 == 0, 20).collect():
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in range(n) if i % 20 == 0}
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in {r["vec_id"] for r in rows}
        assert all(r["score"] == pytest.approx(v[q] @ v[r["vec_id"]], abs=1e-9) for r in rows)
        keys = [(-round(r["score"], 9), r["vec_id"]) for r in rows]
        assert keys == sorted(keys)
        s = v @ v[q]
        s[q] = -np.inf
        hit += len({r["vec_id"] for r in rows} & set(np.lexsort((np.arange(n), -s))[:20].tolist()))
        total += 20
    assert hit / total >= 0.9


def test_few_vectors_are_all_found(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(5)], SCHEMA)
    assert ann.nearest(df, F.col("id") % 20 == 0).count() == 4


def test_recall_on_the_test_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    v, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    got = queries.op7_cross_polytope(spark, sf_dir).toPandas()
    hit = 0
    for q, part in got.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        hit += len(set(part["vec_id"]) & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hit >= 0.9 * len(got)


@pytest.mark.parametrize("size,share", [(2000, 0.27), (20_000, 0.14)])
def test_recall_and_share_of_candidates(size, share):
    """Uniformly distributed vectors in 64 dimensions: nothing is near, so this is the hardest case."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(size, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    asked = v[:: max(20, size // 200)]
    index, hit, looked = ann.Index(v), 0, 0
    for q, at in zip(asked, index.candidates(asked, ann.probes(size), 21)):
        looked += len(at)
        hit += len(set(at) & set(np.argpartition(-(v @ q), 21)[:21]))
    assert hit >= 0.9 * 21 * len(asked) and looked <= share * size * len(asked)


@pytest.mark.parametrize("norms", ["equal", "unequal", "tiny", "huge"])
@pytest.mark.parametrize("d", [64, 128])
def test_vectors_that_no_probe_meets_are_found(norms, d):
    """With few probes some of the nearest lie in other buckets."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= {"equal": 1.0, "unequal": rng.lognormal(0, 1.5, (3000, 1)), "tiny": 1e-150, "huge": 1e150}[norms]
    unit = np.abs(v).max()
    largest = np.linalg.norm(v / unit, axis=1).max() if norms == "unequal" else 0.0
    ids = rng.permutation(3000)
    index = ann.Index(v, largest, unit)
    for q, (at, score) in zip(v[::30], index.search(v[::30], ids, 21, 24)):
        s = v @ q
        assert at.tolist() == np.lexsort((ids, -s))[:21].tolist() and np.allclose(score / s.max(), s[at] / s.max(), rtol=1e-12)
    met = [len(set(at) & set(np.argsort(-(v @ q))[:21])) for q, at in zip(v[::30], index.candidates(v[::30], 24, 21))]
    assert min(met) < 21


def test_equal_scores_that_no_probe_meets_go_by_their_ids():
    rng = np.random.default_rng(7)
    v = np.sign(rng.normal(size=(4000, 64)))
    index = ann.Index(v)
    for q, (at, score) in zip(v[:50], index.search(v[:50], np.arange(4000)[::-1], 21, 2)):
        s = v @ q
        assert at.tolist() == np.lexsort((-np.arange(4000), -s))[:21].tolist() and (score == s[at]).all()


def test_search_is_exact_where_buckets_tell_little(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 1000 * 8 * 256)
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(2000, 256)) * rng.lognormal(0, 0.5, (2000, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], 0) for i in range(2000)], SCHEMA)
    got = {}
    for r in ann.nearest(df, F.col("id") % 100 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    s = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(s, -np.inf)
    assert got == {q: np.lexsort((np.arange(2000), -s[q]))[:20].tolist() for q in range(0, 2000, 100)}


def test_rotation_keeps_lengths_and_angles():
    rng = np.random.default_rng(5)
    for d in (2, 8, 32, 64):
        x = rng.normal(size=(9, d)).astype(np.float32)
        y = ann.rotate(x, 3)
        assert np.allclose(x @ x.T, y @ y.T, atol=1e-3) and not np.allclose(x, y)


# URLs


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = "".join(rest[: min([i for i in (rest.find(c) for c in "/?#") if i >= 0] + [len(rest)])])
    tail = rest[len(host) :]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0] + [len(tail)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


HARD = [None, "", "no scheme", "http://", "https://WWW.Example.NET/en/1?x#y", "ftp://net/", "x://a.net", "http://example.org?q=/fr/", "http://example.org/fr/#a", "http://notnet/", "http://a.b.example.com/de/x", "http://É.net/a", "http://h#f/p", "a://b://c.net/z", "http://" + "long" * 3000 + ".net/"]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(HARD * 2)], "page_id long, url string").withColumn("host", F.lit("old"))
    rows = urls.judge(df, queries.RULES).collect()
    assert len(rows) == 2 * len(HARD)
    for r in rows:
        host, path = plain_parts(r["url"])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] == rule.action if rule else r["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0), queries.RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}


def test_url_models_on_left_out_urls(spark):
    rng = random.Random(1)
    rows = [(f"http://{rng.choice(['shop', 'win', 'bet'])}{rng.randrange(99)}-cheap.org/{rng.randrange(999)}", False) for _ in range(600)]
    rows += [(f"http://{rng.choice(['news', 'wiki', 'docs'])}{rng.randrange(99)}.org/{rng.randrange(999)}", True) for _ in range(600)]
    df = spark.createDataFrame(rows, "url string, accepted boolean")
    model = urls.train(df)
    left = df.where(urls._left_out(F.col("url"))).collect()
    p = model.accept(model.difference([r["url"].encode() for r in left]))
    assert len(left) > 150 and np.mean((p >= 0.5) == [r["accepted"] for r in left]) > 0.97


def test_url_query(spark, sf_dir):
    source = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op3_url_filter(spark, sf_dir).collect():
        assert (r["host"], r["path"]) == plain_parts(source[r["page_id"]])
        rule = plain_rule(r["host"], r["path"])
        assert r["rule"] == (rule and rule.text) and (rule is None or r["verdict"] == rule.action)


def test_url_models_count_every_ngram(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [("".join(rng.choice(letters) for _ in range(60)), i % 2 == 0) for i in range(3000)] + [("\x02\x03é", True)]
    got = {r["key"]: (r["yes"], r["no"]) for r in urls.count(spark.createDataFrame(rows, "url string, accepted boolean")).collect()}
    want = collections.Counter()
    for url, accepted in rows:
        symbols = [urls._START] * urls.ORDER + [*url.encode(), urls._END]
        for i in range(urls.ORDER, len(symbols)):
            for k in range(urls.ORDER + 1):
                want[k, tuple(symbols[i - k : i + 1]), accepted] += 1
                want[k, (*symbols[i - k : i], None), accepted] += 1
    assert len(got) == len({w[:2] for w in want}) > 6 << 15  # more than six tables of 2**15 cells hold
    for (k, gram, accepted), n in want.items():
        key = urls._key(k, int(gram[-1] is not None)) + sum((s or 0) << 9 * i for i, s in enumerate(reversed(gram)))
        assert got[key][0 if accepted else 1] == n


def test_joined_scores_equal_the_model(spark, monkeypatch):
    monkeypatch.setattr(urls, "CHUNK", 30)
    rng = random.Random(9)
    rows = [(i, f"http://{rng.choice(['a.net', 'b.org', 'example.net/en', 'c.com'])}/{rng.randrange(300)}") for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.judge(df, queries.RULES).collect()
    assert len(out) == len(rows)
    named = [(r.action, r.url) for r in df.select("url", urls.deciding_rule(*urls.host_and_path(F.col("url")), queries.RULES)[1].alias("action")).collect()]
    model = urls.train(spark.createDataFrame([(u, a == "allow") for a, u in named if a], "url string, accepted boolean"))
    free = [r for r in out if r["rule"] is None]
    want = model.accept(model.difference([(r["url"] or "").encode() for r in free]))
    assert len(free) > 100
    for r, p in zip(free, want):
        assert r["score"] == pytest.approx(p if r["url"] else model.accept(np.zeros(1))[0])


# archives


def pages(spark):
    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(32, 0x250)) for _ in range(5000))
    rows = [(i, f"http://x/{i}", None if i % 17 == 0 else "" if i % 13 == 0 else "short" if i % 7 == 0 else "copy " * 40 if i % 5 == 0 else noise[: 50 * i] + str(i)) for i in range(120)]
    rows += [(None, "http://null", "body"), (500, None, "\r\nWARC/1.1\r\n\x1f" * 30), (501, "http://a\r\nb", "é" * 100)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_archives_round_trip(spark, split):
    df, rows = pages(spark)
    out = warc.round_trip(df.withColumn("digest", F.lit("old")), split_bytes=split).collect()
    first = {}
    for p, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = p is not None and len(data) >= 100 and first[h or ""] != p
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    body = {r["page_id"]: bytes(r["payload"]) for r in out if r["record_type"] == "response"}
    assert all(body[p] == (h or "").encode() for p, _, h in rows if p in body)


def stored(page, payload):
    """A member whose payload stands in the file as it is."""
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: %d\r\nContent-Length: %d\r\n\r\n" % (page, len(payload))
    return pack.compress(head + payload + b"\r\n\r\n") + pack.flush()


def archive():
    member = lambda i, body: warc._member("response", i, "u", body, "0" * 64, len(body), None, 1)
    inner = b"\x1f\x8b\x08" * 20 + member(9, b"inner") + member(10, b"another") + member(11, b"third")
    deep = stored(12, member(13, b"deep") + b"x" * 90 + stored(14, member(15, b"deeper")))
    second = bytes(range(256)) * 3
    parts = [b"junk\x1f\x8b\x08", stored(1, inner), member(2, second), b"\0\0", deep, stored(3, inner)[:-10], member(4, b"last"), b"\x1f\x8b\x08cut"]
    # of the truncated member 3 nothing is left but what lies in it, whichever way it is read
    want = [(1, inner), (2, second), (12, deep[deep.index(b"\r\n\r\n") + 4 : -12])]
    return b"".join(parts), want, [(9, b"inner"), (10, b"another"), (11, b"third"), (4, b"last")]


def test_records_within_records_are_no_records_at_any_range(tmp_path):
    data, want, rest = archive()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    fs, p = warc.open_fs(str(path))
    for split in (1, 7, 50, 333, 700, len(data)):
        for window in (5, 64, 1 << 20):
            if window == 64 or split > 7:
                with fs.open_input_file(p) as f:
                    starts = list(range(0, len(data), split))
                    leave = [warc.exits(f, len(data), a, a + split, window) for a in starts]
                    entry = warc.entries(starts, [[x for x, _ in e] for e in leave], [[x for _, x in e] for e in leave], split)
                    found = [r for a, e in zip(starts, entry) for r in warc.records_in(f, len(data), e, a + split, window)]
                got = [(int(r[1]["x-page-id"]), r[2]) for r in found]
                assert [g[0] for g in got] == [1, 2, 12, 9, 10, 11, 4]
                assert got[:2] == want[:2] and got[3:] == rest


def test_ranges_of_a_file_read_alike(spark, tmp_path):
    data, _, _ = archive()
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data))], "file string, bytes long")
    for split in (50, 1 << 20):
        assert sorted(r["page_id"] for r in warc.read(files, split).collect()) == [1, 2, 4, 9, 10, 11, 12]


def test_a_very_long_payload_is_read_over_many_ranges(spark):
    rng = random.Random(8)
    long = "".join(chr(rng.randrange(32, 0x3000)) for _ in range(400_000))
    df = spark.createDataFrame([(1, "u", "short"), (2, "u", long), (3, "u", long), (4, "u", "end")], "page_id long, url string, html string").coalesce(1)
    out = {r["page_id"]: r for r in warc.round_trip(df, split_bytes=10_000).collect()}
    assert len(out) == 4 and bytes(out[2]["payload"]).decode() == long and out[3]["refers_to"] == 2 and out[3]["payload_bytes"] == len(long.encode())


def test_empty_archives(spark):
    df, _ = pages(spark)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(name, spark, sf_dir, duck):
    same_rows(queries.queries()[name](spark, sf_dir), duck, queries.ORACLE[name])
