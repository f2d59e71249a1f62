"""The classifiers' formulas, URL scores and the whole pipeline against plain Python, on small tables with odd rows."""

import collections
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_text_operators import brute_classes, plain_disclosing, plain_spans, words
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import common, packing, pii, quality, queries, toxicity, urls

BAD = ["vileness", "nastyish", "horridly"]


def corpus(rng):
    """(doc_id, text, score, row) and (doc_id, quality, toxic): toxic words, shouting, copies, entities, and rows that are odd."""
    rows, labels = [], []
    for i in range(500):
        said = [words(rng, rng.randint(6, 12), 3000) for _ in range(rng.randint(2, 5))]
        toxic, good = rng.random() < 0.25, rng.random() < 0.75
        if toxic:
            rng.choice(said).append(rng.choice(BAD))
        text = ". ".join(" ".join(s) for s in said) + "."
        if i % 25 == 0:
            text += f" Write to {chr(97 + i % 26)}{i}@corp.example or +1 (222) 555-1234 now."
        if not good:
            text = " ".join(w.upper() + "!!$$" for w in text.split())
        rows.append((i, text))
        if i % 10:
            labels.append((i, int(good), int(toxic)))
    rows += [(1000 + k, rows[k % 7][1] + (" tail" if k % 2 else "")) for k in range(30)]
    rows += [(2000, None), (2001, ""), (None, "a row without an id and some more words to read"), (2002, " \n\t"), (2003, "one"), (3, rows[3][1]), (3, "another text of the same id here")]
    rows += [(2004, ". ".join(" ".join(words(rng, 9, 3000)) for _ in range(3000)))]
    labels += [(5, None, None), (9999, 1, 1), (None, 0, 1), (7, 0, 0), (7, 1, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus(random.Random(31))
    made = [(d, t, f"mine{k}", k, len(t or "")) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(made, "doc_id long, text string, score string, row long, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), made, labels


def plain_toxicity(model, text):
    """Noisy-or over sentences, one weight at a time."""
    silent = 1.0
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        said = re.findall(r"[^\W\d_]+", sentence)
        for i in range(0, len(said), toxicity.WINDOW):
            z = model.bias + sum(float(model.weights[f]) for w in set(said[i : i + toxicity.WINDOW]) for f in toxicity.features(w))
            silent *= 1 - 1 / (1 + math.exp(-z))
    return 1 - silent


def plain_quality(model, text):
    """Sizes of all blocks under either dictionary."""
    data, size = (text or "").encode(), {}
    for name in ("good", "bad"):
        made = zstandard.ZstdCompressor(
            level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(getattr(model, name)), write_checksum=False, write_content_size=False, write_dict_id=False
        )
        size[name] = sum(len(made.compress(data[i : i + quality.BLOCK])) for i in range(0, len(data), quality.BLOCK))
    both = size["good"] + size["bad"]
    x = [(size["bad"] - size["good"]) / both, math.log(both / (2 * len(data)))] if data else [0.0, 0.0]
    x.append(min(x[1], -2.0))
    z = model.coefficients[0] + sum(c * (v - m) / s for c, v, m, s in zip(model.coefficients[1:], x, model.center, model.scale))
    return 1 / (1 + math.exp(-z))


def test_registered_classifiers_match_their_formulas(spark, folder):
    path, made, _ = folder
    documents, labels = common.table(spark, path, "documents").select("doc_id", "text"), common.table(spark, path, "labels")
    text = {k: t for k, (_, t, *_) in enumerate(made)}
    for query, operator, plain, target in ((queries.op1_toxicity, toxicity, plain_toxicity, "toxic"), (queries.op9_quality, quality, plain_quality, "quality")):
        model = operator.train(documents, labels, target)
        got = collections.defaultdict(list)
        for r in query(spark, path).collect():
            got[r["doc_id"]].append(r)
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        want = collections.defaultdict(list)
        for k, (d, *_) in enumerate(made):
            want[d].append(plain(model, text[k]))
        assert {d: len(x) for d, x in got.items()} == {d: len(x) for d, x in want.items()}
        for d, x in got.items():
            assert sorted(r["score"] for r in x) == pytest.approx(sorted(want[d]), abs=1e-6)


def test_held_out_labels_are_not_learnt(spark, folder):
    path, _, labels = folder
    documents, known = common.table(spark, path, "documents").select("doc_id", "text"), common.table(spark, path, "labels")
    turned = known.withColumn("toxic", F.when(common.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(documents, x) for x in (known, turned))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_a_sample_has_one_row_for_each_id(spark, folder):
    path, _, _ = folder
    documents = common.table(spark, path, "documents").select("doc_id", "text")
    again = documents.unionByName(documents.where("doc_id = 4")).unionByName(documents.where("doc_id = 4").withColumn("text", F.lit("other")))
    sample, prior = common.labelled_sample(again, common.table(spark, path, "labels"), "toxic", 40)
    rows = sample.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) <= 80 and sum(prior.values()) > 300
    assert {3, 4} & {r["doc_id"] for r in common.labelled_sample(again, common.table(spark, path, "labels"), "toxic", 10**6)[0].collect()}


def test_gradient_of_noisy_or():
    """One step of fitting goes where finite differences of the likelihood point."""
    rng = np.random.default_rng(2)
    vocabulary = ["bad", "good", "plain", "other"]
    bags = toxicity.Bags(np.array([1, 0, 1, 0]), rng.integers(0, 4, 24), np.full(8, 3), np.full(4, 2), vocabulary)
    model = toxicity.fit(bags, {0: 2, 1: 2}, epochs=1, rate=0.1, ridge=0.0)
    made = [toxicity.features(w) for w in vocabulary]

    def loss(weights):
        total = 0.0
        for d in range(4):
            silent = 0.0
            for s in range(2 * d, 2 * d + 2):
                z = -5.0 + sum(weights.get(f, 0.0) for w in bags.word[3 * s : 3 * s + 3] for f in made[w])
                silent += math.log1p(math.exp(z))
            total -= math.log(-math.expm1(-silent)) if bags.label[d] else -silent
        return total

    for f in {f for m in made for f in m}:
        slope = (loss({f: 1e-4}) - loss({f: -1e-4})) / 2e-4
        if abs(slope) > 1e-6:
            assert model.weights[f] * slope < 0


def test_url_scores_match_a_dictionary_of_counts(spark):
    rng = random.Random(13)
    rows = [(i, f"http://{rng.choice(['a.net', 'b.org', 'example.net/en', 'c.com', 'é.info'])}/{rng.choice(['fr', 'en'])}/{rng.randrange(40)}") for i in range(500)]
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "http://c.com/" + "x" * 3000)], "page_id long, url string")
    out = urls.judge(df, queries.RULES).collect()
    action = {r["page_id"]: r["action"] for r in df.select("page_id", urls.deciding_rule(*urls.host_and_path(F.col("url")), queries.RULES)[1].alias("action")).collect()}
    left = {r["url"] for r in df.where(urls._left_out(F.col("url"))).collect()}
    counts = {"allow": collections.Counter(), "block": collections.Counter()}
    symbols = lambda url: ["start"] * urls.ORDER + [*url.encode(), "end"]
    for i, url in rows:
        if action[i] and url not in left:
            s = symbols(url)
            for at in range(urls.ORDER, len(s)):
                for k in range(urls.ORDER + 1):
                    counts[action[i]][tuple(s[at - k : at + 1])] += 1
                    counts[action[i]][(*s[at - k : at], None)] += 1

    def difference(url):
        s, total = symbols(url), 0.0
        for at in range(urls.ORDER, len(s)):
            for kind, sign in (("allow", 1), ("block", -1)):
                p = 1 / 257
                for k in range(urls.ORDER + 1):
                    p = (counts[kind][tuple(s[at - k : at + 1])] + urls.STRENGTH * p) / (counts[kind][(*s[at - k : at], None)] + urls.STRENGTH)
                total += sign * math.log(p)
        return total / (len(s) - urls.ORDER)

    free = [r for r in out if r["rule"] is None]
    assert len(free) > 100 and len(out) == len(rows) + 3
    x, y = np.array([difference(r["url"]) if r["url"] else 0.0 for r in free]), np.array([r["score"] for r in free])
    z = np.log(y / (1 - y))
    slope, intercept = np.polyfit(x, z, 1)
    assert slope > 0 and np.allclose(slope * x + intercept, z, atol=1e-6)
    assert all(r["verdict"] == ("allow" if r["score"] >= 0.5 else "block") for r in free)


def test_rules_of_one_length():
    a, b = urls.Rule.parse("block", "x.org/a"), urls.Rule.parse("allow", "x.org/a")
    assert [r.action for r in sorted([a, b], key=lambda r: -len(r.text))] == ["block", "allow"]


def plain_clean(text, told):
    spans = [tuple(s.split(":")) for s in plain_spans(text).split(",") if s]
    marks = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in spans]
    marks += [(m.start(), m.end(), "" if told[m[0].lower()] >= pii.REMOVE else "[TERM]") for m in re.finditer(r"[^\W\d_]+", text or "") if m[0].lower() in told]
    merged = []
    for a, b, label in sorted(marks):
        if merged and merged[-1][1] > a:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
        else:
            merged.append((a, b, label))
    out, at = "", 0
    for a, b, label in merged:
        out, at = out + (text or "")[at:a] + label, b
    return out + (text or "")[at:] if merged else text


def test_pipeline_matches_plain_python(spark, folder):
    """Each stage against plain Python on what the stage before kept, then the chain."""
    path, made, labels = folder
    docs = common.table(spark, path, "documents")
    as_rows = lambda df: collections.Counter(tuple(r[c] for c in ("doc_id", "text", "score", "row", "n_chars")) for r in df.collect())
    now = collections.Counter(made)
    known = common.table(spark, path, "labels")
    plain = {}
    plain["toxicity"] = lambda rows, d: collections.Counter({r: n for r, n in rows.items() if plain_toxicity(tox, r[1]) < 0.5})
    plain["quality"] = lambda rows, d: collections.Counter({r: n for r, n in rows.items() if plain_quality(good, r[1]) >= 0.3})

    def one_each(rows, d):
        listed = sorted(rows.elements(), key=lambda r: r[3])
        ids = collections.Counter(r[0] for r in listed)
        last = max(r[0] for r in listed if r[0] is not None)
        keyed = {(r[0] if r[0] is not None and ids[r[0]] == 1 else last + 1 + k): r for k, r in enumerate(listed)}
        of = brute_classes([(k, r[1]) for k, r in keyed.items()])
        return collections.Counter(keyed[k] for k in keyed if of[k] == k)

    def cleaned(rows, d):
        told = plain_disclosing([(r[0], r[1]) for r in rows])
        made = [(r, plain_clean(r[1], told)) for r in rows.elements()]
        return collections.Counter((r[0], t, r[2], r[3], None if t is None else len(t)) for r, t in made)

    plain["minhash_near_dedup"], plain["pii"] = one_each, cleaned
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tox = toxicity.train(docs, known) if name == "toxicity" else None
        good = quality.train(docs, known) if name == "quality" else None
        want = plain[name](now, docs)
        docs = common.keep(stage(spark, docs, path))
        assert docs.columns == ["doc_id", "text", "score", "row", "n_chars"]
        now = as_rows(docs)
        if name == "minhash_near_dedup":  # of rows with the same key to choose from, either may stand
            assert collections.Counter(r[1] for r in now.elements()) == collections.Counter(r[1] for r in want.elements())
        else:
            assert now == want, name
        if name == "toxicity":
            left = [bool(re.search("|".join(BAD), r[1] or "", re.I)) for r in now.elements()]
            assert sum(left) < 0.1 * sum(bool(re.search("|".join(BAD), r[1] or "", re.I)) for r in made) and len(left) - sum(left) > 390
    assert {None, "", " \n\t"} <= {r[1] for r in now} and not any("@" in (r[1] or "") for r in now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    tokens = Tokenizer.from_file(queries.WORDS)
    want = collections.Counter()
    for r in now.elements():
        ids = [*tokens.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[r[0], k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(bins) <= sum(packing.best_fit_decreasing(collections.Counter(r["length"] for r in packed), 2048).values())
    with common.noting() as written:
        whole = corpus_pipeline.run(spark, path).collect()
    there = [w for w in written if pathlib.Path(w.removeprefix("file:")).exists()]
    assert len(written) > 20 and there == written[-len(there) :] and len(there) <= 3  # the last stage's own, and what it reads
    assert collections.Counter(r["ids_crc32"] for r in whole) == collections.Counter(r["ids_crc32"] for r in packed)


def test_pipeline_of_nothing(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels"):
        common.table(spark, path, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
