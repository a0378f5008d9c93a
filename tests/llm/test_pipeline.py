"""Quotation linking, archives, and the pipeline's stages."""

import gzip
import hashlib
from collections import Counter
import random

import corpus_pipeline
from llm_tables import CLASHING, awkward, nothing, prose
from test_pairs import components, shingles

from vectide.llm import stages
from vectide.llm.decontam import leaks
from vectide.llm.mixing import mix_sources
from vectide.llm.quotes import normalised, passages, quote_level, reply_ordered
from vectide.llm.toxicity import toxicity_scores
from vectide.llm.warc import parse_records, read_warc, write_warc
from vectide.session import cut

_CLASH = (7, 3, 1, "x", 9, 0.5, "k")


def test_quote_levels_and_passages():
    assert quote_level("> > twice") == (2, "twice") and quote_level(">once") == (1, "once")
    assert quote_level("a > b") == (0, "a > b")
    units = passages("Mine.\n> Yours  is\n> WRAPPED\n>> Older\n\n>\nAnd mine.")
    assert (1, "yours is wrapped") in units and (2, "older") in units
    assert (0, "mine. and mine.") in units and (1, "") not in units


def chats():
    """A thread with nested and rewrapped quotes, and one without any."""
    return [
        (1, 0, "user", "How do I sort a list in place?\nIt is long."),
        (1, 1, "assistant", "Call its sort method."),
        (1, 2, "user", "Thanks."),
        (1, 3, "user", "> how do I sort\n> a list in place?\nSame question here."),
        (1, 4, "assistant", ">> How do I sort a list in place?\n> Same question here.\nSee above."),
        (1, 5, "user", "> Never said by anyone\nWell."),
        (2, 0, "user", "Hello"),
        (2, 1, "assistant", "How do I sort a list in place?"),
        (2, 2, "user", None),
    ]


def test_replies_follow_quotes(spark):
    df = spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string")
    rows = {(r.conv_id, r.turn): r for r in reply_ordered(df).collect()}
    assert [rows[1, t].reply_to for t in range(6)] == [None, 0, 1, 0, 3, 4]
    assert [rows[1, t].linked for t in range(6)] == [False, False, False, True, True, False]
    assert [rows[1, t].depth for t in range(6)] == [0, 1, 2, 1, 2, 3]
    assert [rows[1, t].position for t in range(6)] == [0, 1, 3, 2, 4, 5]
    assert rows[1, 4].text == "See above." and rows[1, 4].formatted == "<|assistant|>\nSee above.\n"
    assert [rows[2, t].reply_to for t in range(3)] == [None, 0, 1]


def brute_links(rows):
    """Per message, the latest earlier message that holds a quoted passage."""
    found = {}
    for conv, turn, _, text in rows:
        scores = {}
        for level, unit in passages(text or ""):
            if level:
                originals = [
                    t
                    for c, t, _, other in rows
                    if c == conv and t < turn and (0, unit) in passages(other or "")
                ]
                if originals:
                    best = scores.setdefault(max(originals), [level, 0])
                    best[0] = min(best[0], level)
                    best[1] += len(unit)
        if scores:
            found[conv, turn] = max((-lv, n, t) for t, (lv, n) in scores.items())[2]
    return found


def test_links_agree_with_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(12):
            own = "\n".join(prose(rng.randrange(40), 4) for _ in range(rng.randrange(1, 4)))
            quotes = ""
            for _ in range(rng.randrange(3)):
                if said:
                    lines = rng.choice(said).split("\n")
                    mark = ">" * rng.randrange(1, 3)
                    quotes += "".join(f"{mark} {x}\n" for x in lines[: rng.randrange(1, 4)])
            said.append(own)
            rows.append((conv, turn, "user", quotes + own))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.reply_to for r in reply_ordered(df).collect() if r.linked}
    assert got == brute_links(rows) and len(got) > 20


def bare(text):
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def test_parts_of_lines_are_found_by_substring_search(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for conv in range(5):
        said = []
        for turn in range(14):
            words = prose(rng.randrange(10**6), rng.randrange(20, 60), 60).split()
            own = " ".join(w + rng.choice(["", "", "", ".", ","]) for w in words).capitalize()
            quote = ""
            if said and turn % 3:
                source = rng.choice(said).split()
                at = rng.randrange(len(source))
                part = source[at : at + rng.choice([1, 2, 4, 7, 8, 9, 15, 30])]
                wrap = rng.randrange(1, 12)
                lines = [part[k : k + wrap] for k in range(0, len(part), wrap)]
                quote = "".join(f"> {' '.join(line)}\n" for line in lines)
                held = [t for t, x in enumerate(said) if f" {bare(' '.join(part))} " in f" {bare(x)} "]
                if len(part) >= 7:
                    # too long to be said twice: one original
                    assert len(held) == 1
                    want[conv, turn] = held[0]
                elif wrap >= len(part):
                    want[conv, turn] = max(held)
            said.append(own)
            rows.append((conv, turn, "user", quote + own))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.reply_to for r in reply_ordered(df).collect() if r.linked}
    assert want.items() <= got.items() and len(want) > 20


def test_edited_and_unspaced_quotes_and_chance_words(spark):
    rows = [
        (1, 0, "user", "One thing first. Sort the list in place, as that needs no more memory at all!"),
        (1, 1, "user", "我今天很高兴，因为天气很好。明天我们去公园。"),
        (1, 2, "user", "Never mind the list."),
        (1, 3, "user", "> [...] the list in place, as that needs no more RAM\nWhy?"),
        (1, 4, "user", "> 因为天气很好\nSo?"),
        (1, 5, "user", "> Nobody has said any of this at\n> all\nIndeed."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.linked, r.reply_to) for r in reply_ordered(df).collect()}
    assert got[3] == (True, 0) and got[4] == (True, 1) and got[5] == (False, 4)


def test_replies_of_awkward_rows(spark):
    rows = [
        (None, 0, "user", "lost"),
        (None, 1, None, "> lost\nfound"),
        (3, None, "user", "x"),
        (3, 4, "user", ""),
        (3, 4, "user", ""),
        (3, 9, "user", "word " * 50_000),
    ]
    df = spark.createDataFrame(
        [(*r, *_CLASH) for r in rows],
        f"conv_id long, turn long, role string, text string, {CLASHING}",
    )
    got = reply_ordered(df).collect()
    assert len(got) == 6
    third = sorted((r.position, r.turn, r.depth, r.reply_to) for r in got if r.conv_id == 3)
    assert third == [(0, None, 0, None), (1, 4, 1, None), (2, 4, 1, None), (3, 9, 2, 4)]
    assert [r.formatted for r in got if r.role is None] == ["<|unknown|>\nfound\n"]
    assert reply_ordered(df.limit(0)).collect() == []
    assert normalised(" A\n b ") == "a b"


def test_archives_come_back(spark, tmp_path):
    html = ["<p>é</p>", "", None, "a\r\n\r\nWARC/1.1\r\nb\r\n\r\n", "x" * 300_000]
    pages = [(k, f"http://e.org/{k}", html[k % 5]) for k in range(23)]
    pages += [(None, None, "<p>é</p>"), (30, "bad\r\nurl", "one"), (30, "bad\r\nurl", "one")]
    df = spark.createDataFrame(
        [(*p, *_CLASH) for p in pages], f"page_id long, url string, html string, {CLASHING}"
    )
    path = str(tmp_path / "archives")
    write_warc(df, path)
    rows = read_warc(spark, path).collect()
    assert len(rows) == len(pages)
    texts = Counter((p, t or "") for p, _, t in pages)
    groups = {}
    for page, text in texts:
        if page is not None:
            groups[text] = max(page, groups.get(text, -1))
    by_id = {r.page_id: r for r in rows}
    for (page, text) in texts:
        row, data = by_id[page], text.encode()
        assert row.payload_bytes == len(data)
        import base64

        assert row.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if page == groups[text]:
            assert (row.record_type, row.refers_to, row.html) == ("response", None, text)
        else:
            assert (row.record_type, row.refers_to) == ("revisit", groups[text])
    assert sum(r.record_type == "response" for r in rows) == len(groups) + 1
    files = [p for p in (tmp_path / "archives").iterdir() if p.name.startswith("part-")]
    read = [f for p in files for f, _ in parse_records([gzip.decompress(p.read_bytes())])]
    assert all(f["WARC-Date"] and f["WARC-Type"] in ("response", "revisit") for f in read)
    write_warc(df.limit(0), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).collect() == []


def test_archives_are_streamed_whatever_their_records_hold(spark, tmp_path):
    """Large payloads, and payloads that hold what ends a record, in any chunks."""
    html = [
        "a\r\n\r\nb", "\r\n", "x\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "WARC/1.1\r\n\r\n", "", "é" * 3_000_000,
        "\r\r\n\r\r\n\n", "z" * 5_000_000 + "\r\n\r",
    ]
    df = spark.createDataFrame(
        [(k, f"http://e.org/{k}", h) for k, h in enumerate(html)],
        "page_id long, url string, html string",
    ).coalesce(1)
    path = str(tmp_path / "archives")
    write_warc(df, path)
    rows = {r.page_id: r for r in read_warc(spark, path).collect()}
    assert [rows[k].html for k in range(len(html))] == html
    (part,) = [p for p in (tmp_path / "archives").iterdir() if p.name.startswith("part-")]
    data = gzip.decompress(part.read_bytes())
    whole = list(parse_records([data]))
    for size in (1, 7, 4096):
        small = data[: 3000 if size == 1 else len(data)]
        pieces = (small[k : k + size] for k in range(0, len(small), size))
        got = []
        try:
            for record in parse_records(pieces):
                got.append(record)
        except ValueError:
            assert size == 1
        assert got == whole[: len(got)] and (size == 1 or got == whole)


def test_stages_keep_columns_and_decide_by_id(spark, tmp_path):
    item = prose(77, 40, 60).replace("w", "ba ")
    texts = [prose(k, 40) for k in range(40)] + [prose(0, 40), f"{prose(90, 9)} {item} {prose(91, 9)}"]
    docs = awkward(spark, texts)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    total = docs.count()
    same = stages.without_toxic(spark, docs, str(tmp_path))
    assert same.columns == docs.columns and same.count() == total  # nothing learned, nothing lost
    unique = stages.without_near_duplicates(spark, docs, str(tmp_path))
    ids = Counter(r.doc_id for r in unique.collect())
    assert unique.columns == docs.columns
    assert max(n for k, n in ids.items() if k is not None) == 1
    assert 6 not in ids and 140 not in ids and {0, 1, 2, 3, 4, 5, 7, 100} <= set(ids)
    clean = stages.without_leaks(spark, docs, str(tmp_path))
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert gone == {141} and clean.columns == docs.columns
    mix = stages.mixed(spark, docs, str(tmp_path))
    assert mix.columns == docs.columns and mix.count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near-duplicates", "decontamination", "mixing", "sharding",
    ]
    shards = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in shards} <= {r.doc_id for r in unique.collect()} - {141}
    assert nothing(spark).count() == 0


def test_stages_in_turn_keep_what_their_operators_say(spark):
    """Rows in less the rejected are the rows out; copies and slots follow from the operators."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    at = {name: stage for name, stage in corpus_pipeline.STAGES}

    def step(name, docs):
        return cut(at[name](spark, docs, folder))

    def ids(df):
        return Counter(r.doc_id for r in df.collect())

    kept = step("toxicity", docs)
    toxic = {r.doc_id for r in toxicity_scores(docs, labels).collect() if r.predicted}
    assert ids(kept) == Counter({k: n for k, n in ids(docs).items() if k not in toxic})
    unique = step("near-duplicates", kept)
    groups = components({r.doc_id: shingles(r.text) for r in kept.collect()})
    assert ids(unique) == Counter(set(groups.values()))
    clean = step("decontamination", unique)
    leaking = {r.doc_id for r in leaks(unique, benchmark).collect()}
    assert ids(clean) == Counter({k: n for k, n in ids(unique).items() if k not in leaking})
    mix = step("mixing", clean)
    copies = {r.doc_id: r.copies for r in mix_sources(clean).collect()}
    assert ids(mix) == Counter({k: n for k, n in copies.items() if n})
    rows = at["sharding"](spark, mix, folder).collect()
    assert Counter(r.doc_id for r in rows) == ids(mix)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole) == sorted(
        (r.doc_id, r.shard, r.slot) for r in rows
    )
