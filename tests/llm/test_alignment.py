"""Alignment of two tokenizers against the definition, recomputed with the tokenizers' own libraries."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablemill.llm import alignment
from tablemill.llm.queries import BYTES, PIECES

A, B = public_tokenizers.path(BYTES), public_tokenizers.path(PIECES)
FOLDER = "/root/testdata/sf0.001"
EDGES = [None, "", " ", "a", "▁", "x▁y", "<|endoftext|> </s> <0x41> <unk>", "é\U0001f600 zażółć 中文字", "\n\n\t  tabs", "don't we'll 's", "  two  spaces ", "a" * 5000, "0123456789" * 50, "nul\x00 byte", "the the the the"]


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by the contract's words."""
    tokenizer, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    with open(A, encoding="utf-8") as file:
        names = {n: t for t, n in json.load(file)["model"]["vocab"].items()}
    letters = alignment._byte_letters()

    def value_b(n):
        piece = pieces.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(n) else piece.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a = [(n, bytes(letters[c] for c in names[n])) for n in tokenizer.encode(" " + text, add_special_tokens=False).ids]
        b = [(n, value_b(n)) for n in pieces.encode(text)]
        if b"".join(v for _, v in a) != (" " + text).encode() or b"".join(v for _, v in b) != (" " + text).encode():
            rows.append(None)
            continue
        ends = []
        for side in (a, b):
            at, found = 0, {}
            for place, (_, v) in enumerate(side):
                at += len(v)
                found[at] = place
            ends.append(found)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(a[ends[0][c]][0], b[ends[1][c]][0]) for c in cuts]
        counts.update(links)
        groups, i, j = [], 0, 0
        for c in cuts:
            to_a, to_b = ends[0][c] + 1, ends[1][c] + 1
            groups.append(",".join(str(n) for n, _ in a[i:to_a]) + "|" + ",".join(str(n) for n, _ in b[j:to_b]))
            i, j = to_a, to_b
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], r[2], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]),
             hashlib.sha256(r[4].encode()).hexdigest()) for r in rows]


def found(df):
    return sorted(tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


def test_table_against_definition(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ordered = docs.orderBy("doc_id").select("doc_id", "text").collect()
    result = alignment.align(docs, A, B)
    assert [r["doc_id"] for r in result.select("doc_id").orderBy("doc_id").collect()] == [r["doc_id"] for r in ordered]
    assert found(result) == sorted(plain([r["text"] for r in ordered]))


def test_edges_small_blocks_and_slices(spark):
    draw = random.Random(2)
    texts = EDGES + EDGES[2:6] + ["".join(draw.choice("aé 1'\n▁st.") for _ in range(draw.randint(1, 80))) for _ in range(300)]
    docs = spark.createDataFrame([(None if n % 7 == 0 else n % 50, t, "x", 1) for n, t in enumerate(texts)], "doc_id long, text string, run string, block int").repartition(5)
    wanted = sorted(plain(texts))
    assert found(alignment.align(docs, A, B)) == wanted
    assert found(alignment.align(docs, A, B, radixes=3, block_records=200, slice_records=500, fan_in=2)) == wanted
    assert found(alignment.align(docs.limit(0), A, B)) == []
    assert found(alignment.align(docs.filter("text is null or text = ''"), A, B)) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_merged_runs_count_pairs_and_mark_the_best():
    draw = random.Random(1)
    runs, counts = [], Counter()
    for _ in range(9):
        some = Counter(draw.randrange(400) for _ in range(draw.randint(0, 300)))
        counts.update(some)
        pairs = sorted(some)
        runs.append(alignment._packed(*[alignment.np.array(c, dtype=alignment.np.int64) for c in (pairs, [some[p] for p in pairs])]))
    pairs, totals, best = (c.tolist() for c in alignment._unpacked(alignment.with_best(alignment.merge_runs(runs), 20), 3))
    assert dict(zip(pairs, totals, strict=True)) == counts and pairs == sorted(counts)
    assert best == [int(counts[p] == max(n for q, n in counts.items() if q // 20 == p // 20)) for p in pairs]


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 60_000, " " * 50_000, "é1" * 40_000])
def test_long_texts_without_spaces(text):
    both = alignment.Pair(alignment.byte_side(A), alignment.piece_side(B))
    pairs, groups, shown = both.align(text, both.a.encode([" " + text])[0], both.b.encode([text])[0])
    assert len(pairs) == groups == shown.count(";") + 1
