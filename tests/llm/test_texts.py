"""Fingerprints, chats, languages, piece encodings and personal data."""

import functools
import hashlib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablemill.llm import chat, language, order_minhash, pii, sentencepieces
from tablemill.llm.queries import PIECES, QUERIES

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} tail" for i in range(20_000))


# Order MinHash

def brute_kmers(text, k=order_minhash.K):
    """Occurrence-numbered k-mers of a text in text order."""
    tokens = re.findall(r"[^ \t\n\x0b\f\r]{1,24}", text)
    kmers = [tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))] if tokens else []
    seen, numbered = {}, []
    for kmer in kmers:
        numbered.append((kmer, seen.get(kmer, 0)))
        seen[kmer] = numbered[-1][1] + 1
    return numbered


def prints(spark, texts, **options):
    df = order_minhash.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), **options)
    return [r["fingerprint"] for r in df.orderBy("id").collect()]


def test_fingerprint_depends_on_order_and_repetition(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    texts = [f"{a} {b}", f"{b} {a}", None, "", "  \n", "x", "x x x x", "x x x x x x x", f"{a} {b}", LONG, LONG + " more"]
    found = prints(spark, texts)
    assert found[0] == found[8] != found[1] and found[2] == found[3] == found[4] == [] and len(found[5]) == 1
    assert len(found[6]) <= 2 < len(prints(spark, ["x x x x x x x x x x x x x x x x x x x x x x"])[0])  # every repetition is a k-mer of its own
    assert len(found[9]) == 32 and len(set(found[9]) & set(found[10])) >= 30


def test_fingerprint_takes_the_smallest_of_each_cell(spark):
    """Against a rebuild from the definition, hashing with Spark."""
    text = "a b c a b c a b c d e a b c"
    numbered = brute_kmers(text)
    rows = spark.createDataFrame([(i, list(k), n) for i, (k, n) in enumerate(numbered)], "at long, k array<string>, n int")
    kmer = F.shiftrightunsigned(F.xxhash64(*[F.col("k")[i] for i in range(3)]), 29)
    dealt = F.shiftrightunsigned(F.xxhash64(kmer, "n"), 64 - 2 - 30)
    hashed = rows.select("at", kmer.alias("kmer"), F.shiftright(dealt, 30).alias("cell"), dealt.alias("order")).collect()
    wanted = []
    for cell in sorted({r["cell"] for r in hashed}):
        least = sorted((r for r in hashed if r["cell"] == cell), key=lambda r: r["order"])[:2]
        tuple_ = [r["kmer"] for r in sorted(least, key=lambda r: r["at"])]
        wanted.append((cell, tuple_))
    tuples = spark.createDataFrame(wanted, "cell long, t array<long>").select((F.shiftleft("cell", 32) + F.shiftrightunsigned(F.xxhash64("t"), 32)).alias("x")).collect()
    assert sorted(prints(spark, [text], cells=4)[0]) == sorted(r["x"] for r in tuples)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ACGT", "天地玄黄宇宙洪荒日月盈昃辰宿列张", "ab"])
def test_texts_without_spaces(spark, alphabet):
    """One character more in front, in the middle or at the end leaves a long run nearly the same; another order does not."""
    import random

    draw = random.Random(9)
    run = "".join(draw.choice(alphabet) for _ in range(5000))
    halves = run[2500:] + run[:2500]
    whole, *others = prints(spark, [run, alphabet[0] + run, run[:2500] + alphabet[1] + run[2500:], run + alphabet[0], "".join(draw.choice(alphabet) for _ in range(5000)), halves])
    alike = [len(set(whole) & set(o)) / 32 for o in others]
    assert min(alike[:3]) > 0.8 and (alike[3] < 0.5 or alphabet == "ab") and alike[4] < 0.9


def test_edit_likeness(spark):
    texts = {9: LONG, 7: None, 5: "a b c d e f g h i", 3: "é" * 10, 1: "z"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(5, texts[5], "x")], "doc_id long, text string, key string")
    found = order_minhash.edit_likeness(df).collect()
    assert len(found) == 6 and len({tuple(r) for r in found}) == 5
    ids = sorted(texts, reverse=True)
    for r in found:
        mine, other = texts[r["doc_id"]] or "", texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]] or ""
        cut = len(mine) // 3
        edited = mine[: len(mine) - cut] + other[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(mine), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and (edited != mine or (r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]))
    assert order_minhash.edit_likeness(df.limit(0)).collect() == []


# Chats

def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<<</s>", "a\n<</SYS>>\n\n", " [/INST]", "", None, "$1 \\$0", "[INST", "é\U0001f600"]
    rows = [(n, t, ("user", "assistant")[t % 2], text) for n, start in enumerate(range(len(nasty))) for t, text in enumerate(nasty[start:] + nasty[:start])]
    rows += [(90, 0, "system", "be <s>"), (90, 1, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    chats = chat.format_chats(df).withColumn("read", chat.read_turns(F.col("formatted"))).collect()
    for r in chats:
        wanted = [(role, text or "") for n, _, role, text in sorted(rows, key=lambda x: x[:2]) if n == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["read"]] == wanted and r["valid"]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        for s, (role, _) in zip(r["segments"][1::3], wanted, strict=True):
            assert s["loss"] == (role == "assistant") and not any(c in s["text"] for c in chat.INSTRUCT.controls)


@pytest.mark.parametrize("roles, bad", [("ua", None), ("sua", None), ("u", None), ("au", 0), ("uu", 1), ("usa", 1), ("s", 1), ("uas", 2), ("uax", 2), ("x", 0)])
def test_chat_order(spark, roles, bad):
    names = {"u": "user", "a": "assistant", "s": "system", "x": None}
    df = spark.createDataFrame([(1, i, names[r], "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(df).first()
    assert (row["valid"], row["bad_turn"]) == (bad is None, bad)
    assert (row["formatted"] is None) == ("x" in roles)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.chat_digests(spark.createDataFrame([], schema)).collect() == []
    rows = chat.chat_digests(spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (2, 0, None, "a")], schema)).collect()
    by = {r["conv_id"]: r for r in rows}
    assert by[None]["n_turns"] == 2 and not by[None]["valid"] and by[2]["n_turns"] is None
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Turn("<a>", "<b>")}, ("<a>", "><a"), {"start": ("user",)}, ("user",))


# Languages

def test_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").withColumn("score", F.lit("x"))
    more = spark.createDataFrame([(10**6, None, "en", ""), (10**6 + 1, "123 %% ²", None, ""), (10**6 + 2, "", "fr", ""), (10**6 + 3, LONG, None, ""), (10**6 + 3, LONG, None, "")], docs.schema)
    found = language.identify(docs.union(more)).collect()
    known = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in found if r["held_out"] and r["doc_id"] in known]
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in held) >= 0.95 * len(held) and held
    rest = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found if r["doc_id"] not in known}
    assert [rest[10**6 + n] for n in range(3)] == [("und", 0.0)] * 3 and rest[10**6 + 3][0] in {"en", "de", "fr", "es"}
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == docs.count() + 5
    assert [r["lang_pred"] for r in language.identify(more.filter("lang is null")).collect()] == ["und"] * 3
    assert language.identify(docs.limit(0)).collect() == []


def test_predictions_by_the_definition(spark):
    """The query against votes counted and added up one by one in plain Python."""
    found = {r["doc_id"]: r for r in QUERIES["op7_word_backoff_language"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)  # by language and length, 0 for words
    for doc in docs:
        if doc["lang"] is not None and doc["text"] is not None and crc32(str(doc["doc_id"]).encode()) % 4 != 2:
            for word in re.findall(r"[^\W\d_]+", doc["text"].lower()):
                counts[doc["lang"], 0][word] += 1
                for n in range(1, 6):
                    marked = f"<{word}>" if n > 1 else word
                    counts[doc["lang"], n].update(marked[i : i + n] for i in range(len(marked) - n + 1))
    langs = sorted({lang for lang, _ in counts})
    tops = {key: dict(sorted(((i, c) for i, c in made.items() if c >= 2), key=lambda p: (-p[1], p[0]))[: 10_000 if key[1] else 20_000]) for key, made in counts.items()}
    known = [set().union(*(tops[lang, n] for lang in langs)) for n in range(6)]

    def votes(item, n):
        logs = [math.log((tops[lang, n].get(item, 0) + 0.5) / (sum(tops[lang, n].values()) + 0.5 * (len(known[n]) + 1))) for lang in langs]
        return [x - sum(logs) / len(logs) for x in logs]

    @functools.cache
    def word_votes(word):
        if word in known[0]:
            return votes(word, 0)
        for n in range(5, 0, -1):
            marked = f"<{word}>" if n > 1 else word
            hits = [votes(g, n) for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in known[n]]
            if hits:
                return [sum(v) / len(hits) for v in zip(*hits, strict=True)]
        return [0.0] * len(langs)

    assert len(found) == len(docs)
    for doc in docs[::7]:
        all_words = re.findall(r"[^\W\d_]+", (doc["text"] or "").lower())
        row = found[doc["doc_id"]]
        if not all_words:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        total = [sum(v) * min(1.0, 50 / len(all_words)) for v in zip(*map(word_votes, all_words), strict=True)]
        weights = [math.exp(t - max(total)) for t in total]
        assert row["score"] == pytest.approx(max(weights) / sum(weights), abs=1e-9)
        assert row["lang_pred"] == langs[total.index(max(total))] or sorted(weights)[-2] > 1 - 1e-9


def test_unknown_words_fall_back_to_shorter_grams():
    model = language.Model(["a", "b"], {"a": {"wort": 5}, "b": {"mot": 5}}, {"a": {"<wor": 4, "o": 9}, "b": {"mo": 3, "o": 1, "t>": 2}})
    assert model.predict("Wort")[0] == "a" and model.predict("worx")[0] == "a" and model.predict("moo")[0] == "b" and model.predict("oooh")[0] == "a"
    assert model.predict("zzz") == ("a", 0.5) and model.predict("12") == ("und", 0.0)


# Pieces

def test_pieces_agree_with_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    texts += ["", " ", "   a  b ", "\n\t\x00", "</s><s>", "日本語 中文", "\U0001f600é", "▁x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, LONG, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    for r in sentencepieces.round_trip(df, path).collect():
        text = texts[r["doc_id"]]
        if text is None:
            assert (r["ids"], r["n_ids"], r["exact"]) == (None, None, None)
        else:
            assert r["ids"] == library.encode(text) and r["exact"] and r["n_ids"] == len(r["ids"])
            assert r["decoded_sha256"] == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()
    assert sentencepieces.round_trip(df.limit(0), path).collect() == []


def test_unigram_path_is_the_lightest():
    pieces = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], ("▁a", -2.0, 1), ("b", -3.0, 1), ("ab", -1.0, 1), ("▁", -1.5, 1), ("▁ab", -4.0, 1), ("bb", -2.5, 1)]
    model = sentencepieces.Transducer(pieces, sentencepieces.UNIGRAM)
    names = lambda text: [pieces[n][0] for n in model.encode(text)]
    assert names("ab") == ["▁", "ab"] and names("abb") == ["▁a", "bb"] and names("é") == ["▁", "<0xC3>", "<0xA9>"]
    assert model.decode(model.encode("abb é")) == "abb é"


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    spans = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            passes = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if passes[kind]:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


TEXTS = ["mail a@b.c%x@y.z d@e.f_g@h.i", "é\U0001f600 x.y+z@mail-1.example.com.", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 1.2.3", "4111 1111 1111 1111, 4111111111111112 4111-1111-1111-1111",
         "+1 (988) 555-2485 4111111111111111", "+12345678 +123456789 +1 23456789012345 6", "a@b", "@", "+", None, "", "1" * 3000, "1-" * 3000 + "1", "a@" + "b." * 3000 + "c", "+1" + " " * 3000,
         " ".join(f"u{i}@example.com 10.0.{i}.1" for i in range(70))]


def test_base_spans_agree_with_the_plain_patterns(spark):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    found = pii.find(df).collect()
    for r in found:
        wanted = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{kind}"] for kind in BASE] == [sum(s.startswith(kind) for s in wanted) for kind in BASE]
        assert set(wanted) <= set(filter(None, r["spans"].split(",")))
    by = {r["doc_id"]: r["spans"] for r in found}
    assert by[4] == "card:18:34,phone:0:17"  # the base phone swallows the card and fails
    assert pii.find(df.limit(0)).collect() == []


def test_redaction(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "write to a.b@c.de now 4111111111111111."), (-2, None), (-3, "clean 12 text"), (-4, "+4111111111111111")], docs.schema)
    rows = {r["doc_id"]: r["text"] for r in pii.redact(docs.union(more)).collect()}
    assert (rows[-1], rows[-2], rows[-3]) == ("write to <EMAIL> now <CARD>.", None, "clean 12 text") and rows[-4] == "+<CARD>"
    assert len(rows) == docs.count() + 4


def test_reliabilities_tell_a_good_labeler_from_a_poor_one():
    counts = {(1, 1, 0, 1): 50.0, (-1, -1, 0, -1): 60.0, (1, 1, 0, -1): 20.0, (-1, -1, 0, 1): 30.0}
    share, tables = pii.reliabilities(counts)
    assert 0.35 < share < 0.55 and tables[0][1][0] > 0.9 > tables[3][1][0] > 0.5


def test_paths_exist():
    assert Path(public_tokenizers.path(PIECES)).exists()


def test_many_spans_and_overlaps_stay_linear(spark):
    """Added spans are told apart from base ones and from earlier kinds as by comparing all pairs, also where there are very many."""
    import random
    import time

    draw = random.Random(1)
    bits = ["a@b.co", " ", "555-123-4567", "(at)", "[dot]", "4111 1111 1111 1111", "+49 170 1234567", "1.2.3.4", "x", "é\U0001f600", ",", "me (at) host (dot) com", "(555) 123-4567 ", "4111111111111111"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 120))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train(docs)
    plain = pii.with_candidates(docs).withColumn("logit", F.transform("candidates", model.logit)).collect()
    found = {r["doc_id"]: r for r in pii.with_spans(docs, model).collect()}
    apart = lambda x, others: not any(o[1] < x[2] and x[1] < o[2] for o in others)
    for r in plain:
        spans = [((c["kind"], c["start"], c["end"]), c, logit) for c, logit in zip(r["candidates"], r["logit"], strict=True) if c["valid"]]
        base = [s for s, c, _ in spans if not c["extra"]]
        more = [s for s, c, logit in spans if c["extra"] and logit > 0 and apart(s, base)]
        added = [s for s in more if apart(s, [o for o in more if o[0] < s[0]])]
        assert [tuple(s) for s in found[r["doc_id"]]["base"]] == sorted(base)
        assert [tuple(s) for s in found[r["doc_id"]]["spans"]] == sorted(base + added)
        wanted, at = "", 0
        for kind, start, end in sorted(base + added, key=lambda s: (s[1], s[2], s[0])):
            if end > at:
                wanted, at = wanted + texts[r["doc_id"]][at : max(start, at)] + f"<{pii.KINDS[kind].upper()}>", end
        assert pii.redact(docs.filter(F.col("doc_id") == r["doc_id"]), model=model).first()["text"] == wanted + texts[r["doc_id"]][at:] if r["doc_id"] < 8 else True
    spent = []
    for n in (4000, 40_000):
        many = spark.createDataFrame([(1, " ".join(f"{200 + i % 700}-{100 + i % 900}-{1000 + i % 9000}" for i in range(n)))], "doc_id long, text string")
        start = time.time()
        assert pii.find(many).first()["spans"].count("phone") == pii.redact(many, model=model).first()["text"].count("<PHONE>") == n
        spent.append(time.time() - start)
    assert spent[1] < 20 * spent[0]
