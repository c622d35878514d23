"""Mixing, sharding, URL rules, the queries against their SQL, and the pipeline."""

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tablemill.llm import language, mixing, queries, sharding, url_rules
from tools.check_queries import NAMES, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), "big") for i in range(600)] + [(1000 + i, "w " * 9, f"s{i % 5}") for i in range(60)] + [(2000 + i, None, "none") for i in range(3)] + [(3000, "", None), (3001, "a\tb\vc", None)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, epoch string"), rows


def shares(rows):
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return {s: t for s, t in tokens.items() if t}


def test_weights_meet_the_entropy(sources):
    docs, rows = sources
    tokens = docs.select("source", mixing.count_tokens(F.col("text")).alias("tokens"))
    found = {r["source"]: r for r in mixing.weights(tokens, mixing.Mix(target_entropy=0.9)).collect()}
    known = shares(rows)
    a = found["big"]["exponent"]
    z = sum((t / max(known.values())) ** a for t in known.values())
    for s, t in known.items():
        assert math.isclose(found[s]["weight"], (t / max(known.values())) ** a / z, rel_tol=1e-9)
    entropy = -sum(r["weight"] * math.log(r["weight"]) for s, r in found.items() if s in known) / math.log(len(known))
    assert abs(entropy - 0.9) < 1e-6 and found["none"]["weight"] == found["none"]["part"] == 0
    assert math.isclose(sum(r["part"] for r in found.values()), sum(known.values()), rel_tol=1e-6)
    assert mixing.weights(tokens, mixing.Mix(target_entropy=0.0)).first()["exponent"] == 1.0
    assert mixing.weights(tokens, mixing.Mix(target_entropy=1.0)).first()["exponent"] < 1e-6


def test_weights_meet_the_repetition_limit(sources):
    docs, rows = sources
    tokens = docs.select("source", mixing.count_tokens(F.col("text")).alias("tokens"))
    for mix in (mixing.Mix(max_repeats=3.0), mixing.Mix(max_repeats=1.5, cover=True), mixing.Mix(target_entropy=1.0, max_repeats=2.0)):
        found = [r["repeats"] for r in mixing.weights(tokens, mix).collect() if r["tokens"]]
        assert abs(max(found) - mix.max_repeats) < 1e-3 and (not mix.cover or min(found) >= 0.999)
    with pytest.raises(ValueError):
        mixing.Mix()
    with pytest.raises(ValueError):
        mixing.Mix(max_repeats=0.5)


def test_plan_fills_the_budgets(sources):
    docs, rows = sources
    mix = mixing.Mix(max_repeats=2.5)
    plan = mixing.plan(docs, mix, block_tokens=1500, range_rows=50).collect()
    parts = {r["source"]: r for r in mixing.weights(docs.select("source", mixing.count_tokens(F.col("text")).alias("tokens")), mix).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    read = defaultdict(list)
    for r in plan:
        assert r["n_tokens"] == size[r["doc_id"]]
        read[r["source"], r["epoch"]].append(r["doc_id"])
    for source, share in parts.items():
        got = sum(size[i] for (s, _), ids in read.items() if s == source for i in ids)
        longest = max((size[i] for i, _, s in rows if s == source), default=0)
        assert share["part"] - 1e-6 <= got < share["part"] + longest or got == share["part"] == 0
    for (source, epoch), ids in read.items():
        assert len(ids) == len(set(ids))
        if (source, epoch + 1) in read:
            assert set(ids) == {i for i, _, s in rows if s == source}
    blocks = defaultdict(list)
    for r in plan:
        blocks[r["block"]].append(r["slot"])
    assert len(blocks) > 3 and all(sorted(slots) == list(range(len(slots))) for slots in blocks.values())
    again = Counter(r["doc_id"] for r in mixing.realise(docs, mix, range_rows=50).collect())
    assert again == Counter(r["doc_id"] for r in plan)


def test_covering_mix_keeps_every_document(sources):
    docs, rows = sources
    out = mixing.realise(docs, mixing.Mix(max_repeats=1.25, cover=True))
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, _, s in rows if s != "none"}
    assert mixing.realise(docs.limit(0), mixing.Mix(max_repeats=1.25, cover=True)).collect() == []
    assert mixing.plan(docs.limit(0), mixing.Mix(target_entropy=0.5)).collect() == []


def test_mix_of_the_pipeline_keeps_sources_without_tokens(spark, sources):
    docs, rows = sources
    out = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert set(out) == {i for i, _, _ in rows} and all(out[i] == 1 for i, _, s in rows if s == "none")
    plan = mixing.plan(docs, corpus_pipeline.MIX, block_tokens=1500).collect()
    assert Counter(r["doc_id"] for r in plan) == out and all(r["block"] is not None for r in plan)
    empty = docs.filter("source = 'none'")
    assert corpus_pipeline.mix_sources(spark, empty, "").count() == mixing.plan(empty, corpus_pipeline.MIX).count() == 3


# Sharding

def brute_difference(sizes, k):
    """Karmarkar-Karp by definition, with sorted lists: the final sums."""
    parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        one, other = parts.pop(0), parts.pop(0)
        parts.append(sorted((a + b for a, b in zip(one, reversed(other), strict=True)), reverse=True))
    return parts[0]


def test_difference():
    rng = random.Random(2)
    for k in (1, 2, 5):
        sizes = [rng.randrange(1, 10**7) for _ in range(80)]
        sums = [0] * k
        for size, to in zip(sizes, sharding.difference([[s] + [0] * (k - 1) for s in sizes]), strict=True):
            sums[to[0]] += size
        assert sums == brute_difference(sizes, k)
    assert sharding.difference([]) == [] and sharding.difference([[3, 9]]) == [[1, 0]]


@pytest.mark.parametrize("k", [2, 3])
def test_shards_beside_the_best_split(spark, k):
    """The largest shard against that of the best split, found by trying all: 7/6 of it at most for two shards, 4/3 for more."""
    rng = random.Random(17 + k)
    for _ in range(4):
        sizes = [rng.randrange(0, 60) for _ in range(8)] + [rng.randrange(60, 200)]
        best = min(max(sum(s for s, to in zip(sizes, split, strict=True) if to == shard) for shard in range(k)) for split in itertools.product(range(k), repeat=len(sizes)))
        sums = Counter()
        for r in sharding.assign(spark.createDataFrame(list(enumerate(sizes)), "key long, size long"), k).collect():
            sums[r["shard"]] += sizes[r["key"]]
        assert sum(sums.values()) == sum(sizes) and best <= max(sums.values()) <= best * (7 / 6 if k == 2 else 4 / 3)


@pytest.mark.parametrize("bucket", [4096, 7])
def test_shards(spark, bucket):
    rng = random.Random(3)
    texts = ["é" * rng.randrange(0, 400) for _ in range(300)] + ["same"] * 40 + [None, None, "", "y" * 3000]
    rows = [(i % 330, t, 7) for i, t in enumerate(texts)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int"), bucket=bucket, slot_rows=20).collect()
    assert len(found) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 1, None if t is None else crc32(t.encode())) for i, t, _ in rows)
    sums, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["size"], r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(sums) == set(range(8)) and max(sums.values()) - min(sums.values()) <= 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())


@pytest.mark.parametrize("share", [0.012, 0.05, 0.12])
def test_shards_beside_a_heavy_group(spark, share):
    rng = random.Random(5)
    sizes = [int(rng.lognormvariate(7, 1)) for _ in range(24_000)]
    sizes.append(int(sum(sizes) * share / (1 - share)))
    found = sharding.assign(spark.createDataFrame(list(enumerate(sizes)), "key long, size long"), 8, bucket=1000).collect()
    sums = [0] * 8
    for r in found:
        sums[r["shard"]] += sizes[r["key"]]
    assert sorted(r["key"] for r in found) == list(range(len(sizes))) and max(sums) - min(sums) <= 100


def test_shards_beside_a_group_larger_than_a_shard(spark):
    sizes = [50_000, 9_000] + [3 + i % 7 for i in range(3000)]
    sums = Counter()
    for r in sharding.assign(spark.createDataFrame(list(enumerate(sizes)), "key long, size long"), 4, bucket=100).collect():
        sums[r["shard"]] += sizes[r["key"]]
    *others, largest = sorted(sums.values())
    assert largest == 50_000 and others[-1] - others[0] <= 10


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# URLs

def test_hosts_paths_and_listed_rules(spark):
    rules = [url_rules.parse(r) for r in queries.LISTED] + [url_rules.parse("allow net")]
    urls = {"http://A.Example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"), "x://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"), "https://b.org": ("b.org", "", None, None),
            "https://b.org/": ("b.org", "/", "org/", "allow"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://c.com/de/x": ("c.com", "/de/x", "com/de/", "block"), "http://c.com/fr/": ("c.com", "/fr/", "com/fr/", "allow"),
            "http://net?x/y": ("net", "", "net", "allow"), "a.org/es/": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "http://ÄB.de#x://y.org/": ("Äb.de", "", None, None), "http://": ("", "", None, None)}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    shown = df.select("url", url_rules.host_of(F.col("url")).alias("h"), url_rules.path_of(F.col("url")).alias("p")).withColumn("m", url_rules.matching_rule(F.col("h"), F.col("p"), rules))
    for r in shown.collect():
        assert (r["h"], r["p"], r["m"] and r["m"]["rule"], r["m"] and r["m"]["verdict"]) == urls[r["url"]]


def test_mined_rules_block(spark):
    rng = random.Random(4)
    rows, said = [], []
    for i in range(400):
        spam = i % 4 == 0
        rows.append((i, f"http://{rng.choice(('pills', 'win')) if spam else rng.choice(('news', 'blog'))}.site{i % 3}.net/{rng.choice(('a', 'b'))}/{i}" + ("?buy=1" if spam else "")))
        if i % 2 == 0:
            said.append((i, 1, int(spam)))
    rows += [(400, None), (401, "http://pills.site0.net/a/9?buy=2"), (401, "http://pills.site0.net/a/9?buy=2"), (402, "http://org.org/?buy=1")]
    said += [(0, None, None), (999, 0, 1)]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string").withColumn("tokens", F.lit(1)), spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    found = url_rules.judge(pages, labels, [url_rules.parse("allow org/")]).collect()
    verdicts = {r["page_id"]: r["verdict"] for r in found}
    assert len(found) == len(rows) and all((verdicts[i] == "block") == (i % 4 == 0) for i in range(400))
    assert verdicts[400] == "allow" and verdicts[401] == "block" and verdicts[402] == "allow"
    # the rules are those of a count over all token combinations
    known = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    labelled = [(known[i], bool(toxic)) for i, _, toxic in said if i in known and toxic is not None]
    mined = url_rules.mine(spark.createDataFrame([(sorted(t), b) for t, b in labelled], "tokens array<string>, blocked boolean"), 0.05, 0.6).collect()
    assert mined
    for r in mined:
        having = [b for t, b in labelled if set(r["antecedent"]) <= t]
        assert math.isclose(r["confidence"], sum(having) / len(having)) and math.isclose(r["support"], sum(having) / len(labelled)) and r["filed"] in r["antecedent"]


def test_no_rule_is_missing(spark):
    """The mined rules are all combinations of kept tokens above support, confidence, lift and deviation, counted one by one."""
    rng = random.Random(8)
    labelled = []
    for _ in range(300):
        tokens = {t for t in "abcdefgh" if rng.random() < 0.4} | {"every"}
        tokens |= {"a2", "a1"} if "a" in tokens else set()
        labelled.append((sorted(tokens), rng.random() < (0.9 if {"b", "c"} <= tokens else 0.8 if "d" in tokens and "e" not in tokens else 0.15)))
    df = spark.createDataFrame(labelled, "tokens array<string>, blocked boolean")
    limits = {"least_support": 0.02, "least_confidence": 0.5, "least_rows": 5, "least_lift": 2.0, "least_deviations": 4.0, "most_tokens": 6}
    found = {tuple(sorted(r["antecedent"])): r for r in url_rules.mine(df, **limits).collect()}
    n, share = len(labelled), sum(b for _, b in labelled) / len(labelled)
    least = max(5, math.ceil(0.02 * n))
    standing = {t: [k for k, (tokens, _) in enumerate(labelled) if t in tokens] for t in {t for tokens, _ in labelled for t in tokens}}
    alone = {t for t, at in standing.items() if len(at) >= least and not any(o < t and standing[o] == at for o in standing)}
    away = lambda t: -round(abs(sum(labelled[k][1] for k in standing[t]) - share * len(standing[t])) / math.sqrt(len(standing[t])), 9)
    kept = [(set(sorted((t for t in tokens if t in alone), key=lambda t: (away(t), t))[:6]), b) for tokens, b in labelled]
    wanted = {}
    for size in range(1, 7):
        for combination in itertools.combinations(sorted(alone), size):
            having = [b for tokens, b in kept if set(combination) <= tokens]
            if sum(having) >= least:
                confidence = sum(having) / len(having)
                if confidence >= 0.5 and confidence * (1 - share) >= 2 * share * (1 - confidence) and (confidence - share) / math.sqrt(share * (1 - share) / len(having)) >= 4:
                    wanted[combination] = (confidence, sum(having) / n)
    assert wanted.keys() == found.keys() and "a1" not in alone and len(wanted) > 3
    for key, (confidence, support) in wanted.items():
        assert math.isclose(found[key]["confidence"], confidence) and math.isclose(found[key]["support"], support)


def test_rules_of_urls_with_many_tokens_are_all_found(spark):
    """A rule whose tokens are the least telling ones of URLs with many: nothing is dropped, and verdicts are those of all combinations counted one by one."""
    rng = random.Random(3)
    labelled = []
    for i in range(400):
        tokens = {f"t{k:02d}" for k in range(11) if rng.random() < 0.6} | {t for t in ("x", "y") if rng.random() < 0.5}
        labelled.append((sorted(tokens), rng.random() < (0.95 if {"x", "y", "t00"} <= tokens else 0.2 + 0.06 * len(tokens & {"t01", "t02", "t03", "t04"}) - 0.1 * len(tokens & {"x", "y"}))))
    assert max(len(tokens) for tokens, _ in labelled) > 10
    found = [set(r["antecedent"]) for r in url_rules.mine(spark.createDataFrame(labelled, "tokens array<string>, blocked boolean")).collect()]
    n, share = len(labelled), sum(b for _, b in labelled) / len(labelled)
    names = sorted({t for tokens, _ in labelled for t in tokens})
    bits = [(sum(1 << names.index(t) for t in tokens), b) for tokens, b in labelled]
    rules = []
    for mask in range(1, 1 << len(names)):
        having = [b for row, b in bits if row & mask == mask]
        hits = sum(having)
        if hits >= 5 and (c := hits / len(having)) >= 0.6 and c * (1 - share) >= 2 * share * (1 - c) and (c - share) / math.sqrt(share * (1 - share) / len(having)) >= 4:
            rules.append(mask)
    assert rules and [any(row & mask == mask for mask in rules) for row, _ in bits] == [any(rule <= set(tokens) for rule in found) for tokens, _ in labelled]
    assert any({"x", "y"} <= rule for rule in found)


@pytest.mark.parametrize("copies", [1, 3, 400])
def test_a_url_of_many_tokens_does_not_explode(spark, copies):
    long = "http://long.net/x?" + "&".join(f"k{i}=1" for i in range(60))
    shuffled = ["http://long.net/x?" + "&".join(f"k{i}=1" for i in range(60) if (i + n) % 7) for n in range(copies)]
    urls = [f"http://host{i % 40}.org/p/{i}" for i in range(200)] + [long] * copies + shuffled
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(n, 1, int(n % 3 == 0 or n >= 200)) for n in range(len(urls))], "doc_id long, quality int, toxic int")
    start = time.time()
    verdicts = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels, []).collect()}
    assert len(verdicts) == len(urls) and time.time() - start < 60
    assert all(verdicts[n] == "allow" for n in range(200)) and (copies < 400 or all(verdicts[n] == "block" for n in range(200, len(urls))))


def test_urls_without_labels_or_pages(spark):
    pages, labels = spark.createDataFrame([(1, "http://a.de/x")], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in url_rules.judge(pages, labels, []).collect()] == [(1, "a.de", "/x", None, "allow")]
    assert url_rules.judge(pages.limit(0), labels, []).collect() == []


# Queries and pipeline

def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    db = duckdb.connect()
    for t in NAMES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    result = db.execute(queries.ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in result.description], result.fetchall())


def test_pipeline(spark, tmp_path):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "???", "en", "src0", 3), (10**6 + 1, None, None, None, None), (10**6 + 2, "", "en", None, 0)], documents.schema)
    documents.union(extra).union(documents.limit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    kept = {r["doc_id"] for r in out}
    assert all(r["exact"] for r in out) and not kept & {10**6, 10**6 + 1, 10**6 + 2}

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {i: shingles(t) for i, t in texts.items()}
    near = {i: [j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in sets}
    assert all((i in kept) == (min([i, *near[i]]) == i) for i in sets if all(set(near[j]) | {j} == set(near[i]) | {i} for j in near[i]))
    assert max(Counter(r["doc_id"] for r in out).values()) <= 2


def test_near_duplicates_go_by_row(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    copied, lone, shared, other, near = text(), text(), text(), text(), text()
    rows = [(1, copied), (None, copied), (None, lone), (2, shared), (7, shared), (7, other), (None, near), (None, near + " more"), (8, near + " at last"), (9, lone + " x"),
            (12, near[:-1] + "!"), (None, None), (None, ""), (5, None), (5, None)]
    alone = [text(), text()]
    rows += [(20, alone[0]), (20, alone[0] + " more"), (None, alone[1]), (None, alone[1] + " more"), (None, alone[1])]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    found = Counter((r["doc_id"], r["text"]) for r in out)
    by_group = [next(x for x in ((20, alone[0]), (20, alone[0] + " more")) if x in found), next(x for x in ((None, alone[1]), (None, alone[1] + " more")) if x in found)]
    assert found == Counter([(1, copied), (9, lone + " x"), (2, shared), (7, other), (8, near + " at last"), (None, None), (None, ""), (5, None), *by_group])


def test_documents_without_labels_stay(spark):
    held = next(str(i) for i in range(100) if crc32(str(i).encode()) % 4 == 2)
    rows = [("a", "some words", None), ("b", "東京", None), ("c", "12 !", None), ("d", None, None), (held, "held out", "en")]
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id string, text string, lang string"), "").collect()
    assert {(r["doc_id"], r["lang"]) for r in out} == {("a", None), ("b", None), (held, "en")}


def test_pipeline_without_documents(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_held_out_rule(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), language.held_out().alias("h")).collect()
    assert all(r["h"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
