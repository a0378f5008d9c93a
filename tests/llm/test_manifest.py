"""Operators over blocks of text and over trees: encoding, manifests, the filter audit."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from llm_tables import awkward, nothing, prose
from pyspark.sql import functions as F

from vectide.llm import filters, lexicon, merkle
from vectide.llm.bpe import decode_ids, encode_texts, encode_word, load_ranks
from vectide.llm.common import text_slices
from vectide.llm.queries import REGISTRY

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def odd_texts():
    rng = random.Random(8)
    kinds = [
        lambda: chr(rng.randrange(32, 127)),
        lambda: chr(rng.randrange(160, 0x600)),
        lambda: chr(rng.randrange(0x3000, 0x9FFF)),
        lambda: rng.choice(" \n\t  \x1c\x85"),
    ]
    made = ["".join(rng.choice(kinds)() for _ in range(rng.randrange(90))) for _ in range(60)]
    return made + ["x" * 5000, "ab" * 3000, "漢字" * 2000, "<|endoftext|>", "\n\n  \n", prose(3, 900)]


def library():
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=load_ranks(RANKS),
        special_tokens={},
    )


def test_slices_cover_a_batch_with_nulls_and_offsets(monkeypatch):
    monkeypatch.setattr("vectide.llm.common.SLICE_BYTES", 10)
    values = [b"abc", None, b"", b"x" * 25, b"defghij", b"kl", None]
    for start in range(len(values) + 1):
        batch = pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["text"]).slice(start)
        runs = list(text_slices(batch))
        assert [t for _, texts in runs for t in texts] == [v or b"" for v in values[start:]]
        assert [at for at, _ in runs] == np.cumsum([0] + [len(t) for _, t in runs])[:-1].tolist()


def test_words_are_encoded_as_the_library_does():
    ranks, own = load_ranks(RANKS), library()
    rng = random.Random(1)
    for size in (1, 2, 3, 7, 40, 400):
        for _ in range(60):
            word = "".join(rng.choice("abcdeéx漢 ") for _ in range(size))
            assert encode_word(word.encode(), ranks) == own._encode_single_piece(word)


@pytest.mark.parametrize("block", [2**25, 300])
def test_encoding_awkward_rows_and_back(spark, monkeypatch, block):
    monkeypatch.setattr(lexicon, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexicon, "BUCKETS", 16)
    monkeypatch.setattr("vectide.llm.bpe._BATCH_IDS", 100)
    docs, own = awkward(spark, odd_texts()), library()
    got = decode_ids(encode_texts(docs, RANKS), RANKS).collect()
    want = [(r.doc_id, own.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()]
    assert sorted(map(str, ((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got))) == sorted(
        map(str, want)
    )
    assert encode_texts(nothing(spark), RANKS).collect() == []
    with pytest.raises(Exception, match="not in the vocabulary"):
        bad = spark.createDataFrame([(1, [7, 50_300])], "doc_id long, ids array<int>")
        decode_ids(bad, RANKS).collect()


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at, node):
    others = []
    for level in levels[:-1]:
        run, place = level[at // 8 * 8 :][:8], at % 8
        others += run[:place] + run[place + 1 :]
        run[place] = node
        node, at = digest(run), at // 8
    return others, node


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row, by the definition."""
    def leaf(row, text):
        values = [row.doc_id, row.source, row.lang, row.n_chars, text]
        return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    groups = {}
    for row in rows:
        text = row.text
        if row.doc_id is not None and text and zlib.crc32(str(row.doc_id).encode()) % 3 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        item = (row.doc_id is not None, row.doc_id or 0, leaf(row, row.text), leaf(row, text))
        groups.setdefault(row.lang, []).append(item)
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {g: plain_tree([i[2] for i in sorted(groups[g])]) for g in langs}
    top = plain_tree([trees[g][-1][0] for g in langs])
    for g in langs:
        for at, (known, key, first, other) in enumerate(sorted(groups[g])):
            low, node = climb(trees[g], at, other)
            high, node = climb(top, langs.index(g), node)
            yield (key if known else None, first, trees[g][-1][0], top[-1][0], digest(low + high), node)


@pytest.mark.parametrize("levels", [4, 1])
def test_manifest_of_awkward_rows(spark, monkeypatch, levels, tmp_path):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rng = random.Random(4)
    texts = [None, "", "Some Capital Letters", "none here", "É À only", prose(2, 30_000)]
    rows = [(k, rng.choice(texts), rng.choice(["x", None]), lang, rng.choice([None, 5]), k)
            for lang, n in (("en", 130), ("de", 8), ("", 1), (None, 9), ("é", 65), ("zz", 64))
            for k in range(n)]
    rows += [rows[3], rows[3], (None, "No Id", "x", "en", 1, 1), (None, None, None, None, None, 1)]
    rows += [(k, f"T{k}", "s", f"l{k}", 1, 1) for k in range(70)]
    rng.shuffle(rows)
    schema = "doc_id long, text string, source string, lang string, n_chars long, node long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = REGISTRY["op12_incremental_witnesses"](spark, str(tmp_path)).collect()
    want = list(plain_manifest(docs.collect()))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert {r.verified for r in got} == {True, False}


def test_manifest_edges(spark):
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    assert merkle.manifest(nothing(spark, schema)).collect() == []
    (row,) = merkle.manifest(spark.createDataFrame([(1, "a", "s", "en", 1)], schema)).collect()
    assert row.leaf == row.subroot == row.root and bytes(row.witness) == b""
    assert merkle.fold(bytes.fromhex(row.leaf), b"").hex() == row.root


def plain_audit(docs, labels):
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    bad = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    first = {}
    for r in docs:
        if r.doc_id is not None:
            text = r.text or ""
            first[text] = min(first.get(text, r.doc_id), r.doc_id)
    cells = {}
    for r in docs:
        text = r.text or ""
        words = text.encode().split()
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": r.doc_id is not None and first[text] < r.doc_id,
        }
        failed = frozenset(k for k, v in fails.items() if v)
        cells.setdefault(r.source or "", []).append((failed, r.doc_id in good, r.doc_id in bad))
    out = {}
    for part, rows in cells.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, k in enumerate(order):
                before = set(order[:step])
                here = [r for r in rows if k in r[0] and not r[0] & before]
                shapley[k] += len(here)
                out[part, "".join(order), step + 1] = (
                    sum(not r[0] & (before | {k}) for r in rows),
                    len(here),
                    sum(k in r[0] and bool(r[0] & before) for r in rows),
                    sum(r[0] == {k} for r in rows),
                    sum(r[1] for r in here),
                    sum(r[2] for r in here),
                )
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("block", [2**25, 2000])
def test_audit_of_awkward_rows(spark, monkeypatch, block):
    monkeypatch.setattr(lexicon, "BLOCK_BYTES", block)
    monkeypatch.setattr(filters, "HOT_SHARE", 1 / 10)
    rng = random.Random(6)
    texts = [prose(k, rng.choice([20, 250, 400]), rng.choice([30, 4000])) for k in range(40)]
    texts += [t + rng.choice([" #", " AAAA" * 30, "", " a\x0bb\x85c"]) for t in texts] + texts[:10]
    docs = awkward(spark, texts)
    schema = "doc_id long, quality int, toxic int"
    labels = [(100 + k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(80)]
    labels = spark.createDataFrame(labels + [(0, 1, 0), (0, 0, 1), (None, 1, 1)], schema)
    got = filters.audit(docs, labels).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got}
    assert len(found) == len(got)
    assert found == plain_audit(docs.collect(), labels.collect())
    assert filters.audit(nothing(spark), labels.limit(0)).collect() == []


def test_matrix_is_the_counts_of_words(spark):
    texts = ["b a b  c", "", "a\tc\nc c", "d"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select(
        "id", F.col("text").cast("binary").alias("text")
    )
    seen = {}
    for shard in filters.term_matrix(df, {"id": pa.int64()}).collect():
        for k, doc in enumerate(shard.documents):
            entries = slice(shard.starts[k], shard.starts[k + 1])
            seen[doc.id] = dict(zip(shard.columns[entries], shard.values[entries]))
    assert [sorted(seen[k].values()) for k in range(4)] == [[1, 1, 2], [], [1, 3], [1]]
    assert len({code for row in seen.values() for code in row}) == 4
    # the same word has the same column in every document
    assert len(set(seen[0]) & set(seen[2])) == 2 and not set(seen[3]) & set(seen[0])
