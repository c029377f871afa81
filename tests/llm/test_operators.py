"""Brute-force comparisons, round trips and odd rows for the operators of the subpackage."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens import session
from cohortlens.llm import bpe_ids, decontaminate, license_scan, line_quality, packing, sharding, token_counts, token_files, url_rules, warc

SMALL = "/root/testdata/sf0.001"
LAYOUT = "doc_id long, text string, source string, kept string, row int"
ODD = [
    None, "", " \t\n", "One", "it's <|endoftext|> ½ 日本 é", "word " * 9_000 + "end", "A b c d e f\nA b c d e f\n#*$ x",
    "same text here", "same text here", "ŉ ß İ Σ \x00",
]


def odd_documents(spark):
    rows = [(i if i != 3 else None, t, "s" if i % 2 else None, "clash", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[7]], LAYOUT)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def expected_ids(documents):
    whole = Tokenizer.from_file(bpe_ids.tokenizer_path())
    rows = documents.select("doc_id", "text").collect()
    return {r["doc_id"]: np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}


def test_ids_equal_the_tokenizer():
    whole = Tokenizer.from_file(bpe_ids.tokenizer_path())
    ids, ends = bpe_ids.encoder(bpe_ids.tokenizer_path())(pa.array(ODD, pa.string()))
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in ODD]


def test_huffman_round_trip(spark, documents, expected_ids):
    rows = sorted(token_files.token_files(documents).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r in rows:
        ids = expected_ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(expected_ids)
    odd = token_files.token_files(odd_documents(spark)).collect()
    assert len(odd) == len(ODD) + 1 and sum(r["n_tokens"] == 1 for r in odd) == 3
    assert token_files.token_files(spark.createDataFrame([], LAYOUT)).collect() == []


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([0, *(2 ** np.arange(30)), 5, 0])
    lengths = token_files.limited_lengths(counts).astype(int)
    used = lengths[counts > 0]
    assert used.max() <= token_files.LIMIT and sum(2.0**-used) <= 1 and lengths[0] == 0
    assert token_files.limited_lengths(np.array([1, 1, 2, 4])).tolist() == [3, 3, 2, 1]
    assert token_files.limited_lengths(np.array([0, 9])).tolist() == [0, 1]


def test_packing_covers_every_id(spark, documents, expected_ids):
    rows = packing.pack(documents).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = expected_ids[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, parts in [*by_doc.items(), *by_sequence.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
    used = [sum(n for _, n in v) for v in by_sequence.values()]
    assert set(by_doc) == set(expected_ids) and max(used) <= 2048
    assert len(used) * 2048 - sum(used) < 2048
    assert len({r["doc_id"] for r in packing.pack(odd_documents(spark)).collect()}) == len(ODD)
    assert packing.pack(spark.createDataFrame([], LAYOUT)).collect() == []


def base_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_base_rules(spark, documents):
    for frame in (documents, odd_documents(spark)):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        for r in line_quality.line_quality(frame).collect():
            want = base_rules(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (r["kept"] <= (not r["base_failed"]))


def test_boilerplate_goes_and_copies_stay(spark):
    draw = np.random.default_rng(2)

    def line(n=14):
        return " ".join(f"w{i}" for i in draw.integers(0, 5000, n))

    footer = line(20)
    rows = [(i, f"{line()}\n{line()}\n{footer}", "a", "c", 0) for i in range(40)]
    rows += [(100 + i, f"{footer}\n{line(3)}", "a", "c", 0) for i in range(5)]
    copy = "\n".join(line() for _ in range(5))
    rows += [(200 + i, copy, "a", "c", 0) for i in range(60)]
    near = [line() for _ in range(6)]
    for i in range(60):
        changed = list(near)
        changed[int(draw.integers(0, 6))] += f" x{i}"
        rows.append((300 + i, "\n".join(changed), "a", "c", 0))
    rows += [(400 + i, f"{line()}\n{footer}", "b", "c", 0) for i in range(3)]
    kept = {r["doc_id"]: r["text"] for r in line_quality.cleaned(spark.createDataFrame(rows, LAYOUT)).collect()}
    assert set(kept) == {r[0] for r in rows} - set(range(100, 105))
    texts = {r[0]: r[1] for r in rows}
    assert all(footer not in kept[i] for i in range(40)) and all(kept[i] == texts[i] for i in kept if i >= 200)
    assert line_quality.cleaned(spark.createDataFrame([], LAYOUT)).collect() == []
    assert line_quality.cleaned(odd_documents(spark)).columns == [c.split()[0] for c in LAYOUT.split(", ")]


def test_boilerplate_around_short_bodies_goes(spark):
    draw = np.random.default_rng(5)

    def line(n):
        return " ".join(f"w{i}" for i in draw.integers(0, 5000, n))

    around, small, copied = [line(38) for _ in range(3)], line(12), line(12)
    rows = [(i, "\n".join([*around[:2], line(15), around[2]]), "a", "c", 0) for i in range(40)]
    # eleven different documents hold a line, a hundred copies of one of them don't hide it
    rows += [(100 + i, f"{line(20)}\n{small}", "b", "c", 0) for i in range(11)]
    rows += [(200 + i, rows[40][1], "b", "c", 0) for i in range(100)]
    # ten documents and their copies are ten
    rows += [(400 + i, f"{line(20)}\n{copied}", "d", "c", 0) for i in range(10)]
    rows += [(500 + i, rows[151 + i][1], "d", "c", 0) for i in range(10)]
    settings = line_quality.LineSettings(min_left=5)
    kept = {r["doc_id"]: r["text"] for r in line_quality.cleaned(spark.createDataFrame(rows, LAYOUT), settings).collect()}
    assert len(kept) == len(rows)
    assert not any(x in kept[i] for i in range(40) for x in around)
    assert not any(small in kept[i] for i in kept if 100 <= i < 400)
    assert all(copied in kept[i] for i in kept if i >= 400)


def test_decontamination(spark):
    question = "Anna Smith buys 12 apples for 3 dollars and her brother Peter eats 12 of them within 5 days of May."
    asked = "John Brown buys 40 apples for 7 dollars and her brother Frank eats 40 of them within 9 days of May."
    mixed = "John Brown buys 40 apples for 7 dollars and her brother Frank eats 41 of them within 9 days of May."
    item = "That question has nothing in common with any other text of this small table at all."
    rows = [(1, f"before it {question} after"), (2, f"Some words here. {asked}"), (3, "clean text " * 20), (4, item.upper()),
            (5, None), (6, ""), (None, question), (7, question), (7, question), (8, " ".join(question.split()[:9])), (9, mixed)]
    docs = spark.createDataFrame([(i, t, "s", "k", 1) for i, t in rows], LAYOUT)
    bench = spark.createDataFrame([(1, question), (2, item), (3, None), (4, ""), (1, question)], "item_id long, text string")
    strict = decontaminate.LeakSettings(consistent=95)
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench, strict).collect()}
    assert set(found) == {(1, 1), (2, 1), (4, 2), (None, 1), (7, 1)}
    assert found[2, 1]["n_changed"] > 0 and found[1, 1]["n_changed"] == 0
    left = decontaminate.decontaminated(docs, bench, strict)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 5, 6, 8, 9]
    shuffled = decontaminate.leaks(docs, bench, decontaminate.LeakSettings(consistent=95, broadcast_rows=0))
    assert {(r["doc_id"], r["item_id"]) for r in shuffled.collect()} == set(found)
    assert decontaminate.leaks(docs.limit(0), bench).collect() == [] and decontaminate.leaks(docs, bench.limit(0)).collect() == []


def test_leaks_by_occurrence_names_and_edits(spark):
    mean = "What is the arithmetic mean of the ten numbers 3, 8, 12, 5, 7, 9, 11, 2, 4, 6?"
    tom = "Tom has 12 apples. Tom gives 5 of them to Mary. How many apples does Tom have left after Mary eats 2?"
    short = "The quick river bends around nine old stone mills before it reaches our quiet northern harbour town at dusk today"
    tiny = "Blue whales sing loudly"
    twice = tom.replace("12", "30").replace("5", "8") + " " + tom.replace("12", "41").replace("5", "17")
    texts = [
        (1, mean, {1}),
        (2, f"{tom} Then once more. {twice}", {2}),
        (3, f"YouTube by McCarthy, {twice}", {2}),
        (4, tom.replace("Tom", "Anna").replace("Mary", "Peter"), {2}),
        (5, f"some page {tom.lower()} ends", {2}),
        (6, tom.replace(" Mary", "\nMary").replace(" Tom", "\nTom"), {2}),
        (7, short.replace("stone", "wooden"), {3}),
        (8, short.replace("before it", "well before it"), {3}),
        (9, "They say that blue whales sing loudly at night", {4}),
        (10, "Tom has no river and Mary has 3 mills that bend around the harbour of a quiet town", set()),
    ]
    docs = spark.createDataFrame([(i, t, "s", "k", 1) for i, t, _ in texts], LAYOUT)
    bench = spark.createDataFrame(list(enumerate((mean, tom, short, tiny), 1)), "item_id long, text string")
    found = defaultdict(set)
    for r in decontaminate.leaks(docs, bench).collect():
        found[r["doc_id"]].add(r["item_id"])
    assert {i: found[i] for i, _, _ in texts} == {i: want for i, _, want in texts}


def test_shards(spark, documents):
    for frame in (documents, odd_documents(spark)):
        rows = sharding.interleaved(frame, 8).collect()
        assert len(rows) == frame.count() and {r["law"] for r in rows} == {"rows"}
        texts = defaultdict(list)
        for r in frame.collect():
            texts[r["doc_id"]].append((r["text"] or "").encode())
        slots = defaultdict(list)
        for r in rows:
            assert (r["size"] - 16, r["text_crc32"]) in {(len(t), zlib.crc32(t)) for t in texts[r["doc_id"]]}
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[k]) for k in range(8)]
        assert max(counts) - min(counts) <= 1
    sources = {r["doc_id"]: r["source"] for r in documents.collect()}
    mixture = Counter((r["shard"], sources[r["doc_id"]]) for r in sharding.interleaved(documents, 8).collect())
    for source, n in Counter(sources.values()).items():
        assert all(abs(mixture[k, source] - n / 8) <= 2 for k in range(8))
    assert sharding.interleaved(spark.createDataFrame([], LAYOUT), 8).collect() == []


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://a.net", "https://net/", "x://example.com/de/1#t",
            "http://b.org/fr/", "http://example.org/fr", "ftp://u://v/w", "http://bad.test/buy/12"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    more = spark.createDataFrame([(100 + i, f"http://{'bad' if i % 2 else 'good'}.test/buy/{i}", "h", "x") for i in range(40)], pages.schema)
    pages = pages.unionByName(more)
    labels = spark.createDataFrame([(100 + i, i % 2, None if i == 4 else 0) for i in range(40)] + [(9999, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    labels = labels.withColumn("quality", F.lit(1))
    got = {r["page_id"]: r for r in url_rules.judged_urls(pages, labels).collect()}
    assert len(got) == pages.count()
    want = {0: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"),
            4: ("a.net", "", None, "allow"), 5: ("net", "/", "net/", "block"), 6: ("example.com", "/de/1", "example.com/de/", "block"),
            7: ("b.org", "/fr/", "org/fr/", "allow"), 8: ("example.org", "/fr", None, "allow"), 9: ("u:", "//v/w", None, "allow"),
            10: ("bad.test", "/buy/12", None, "block")}
    for i, row in want.items():
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == row
    assert all(got[100 + i]["verdict"] == ("block" if i % 2 else "allow") for i in range(40))
    assert {r["verdict"] for r in url_rules.judged_urls(more, labels.limit(0)).collect()} == {"allow"}


def test_archives(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 70_000, "<p>a</p>", "\r\n\r\nWARC/1.1\r\n\r\n"]
    rows = [(10 - i, None if i == 2 else f"http://x/{i}\n é", t, "c") for i, t in enumerate(html)] + [(None, "u", "<p>a</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.archived(pages).collect()
    assert len(got) == len(rows)
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    owners = {}
    for k, p in payload.items():
        owners[p] = min(x for x in (owners.get(p), k) if x is not None)
    for r in got:
        p, k = payload[r["page_id"]], r["page_id"]
        assert r["payload_bytes"] == len(p) and r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if owners[p] == k else ("revisit", owners[p]))
    assert warc.archived(pages.limit(0)).collect() == []


def test_archive_stream_is_cut_into_records():
    parts = [warc.record(str(i), "u", b"x" * i, "D", None, "t") for i in (0, 5, 3000)]
    whole = b"".join(parts)
    assert list(warc.records(iter([whole[i : i + 7] for i in range(0, len(whole), 7)]))) == parts
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[:-1]])))


def viterbi(word, scores):
    path = token_counts.START + word
    worst = min(scores.values()) - token_counts.UNKNOWN
    best = [(0.0, 0)]
    for end in range(1, len(path) + 1):
        options = [(best[end - 1][0] + worst, best[end - 1][1] + 1)]
        options += [(best[s][0] + scores[path[s:end]], best[s][1] + 1) for s in range(end) if path[s:end] in scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_trie_counts(spark, documents):
    scores = token_counts.piece_scores(token_counts.vocabulary_path())
    for frame in (documents.limit(20), odd_documents(spark)):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        for r in token_counts.token_counts(frame).collect():
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
            counts = {w: viterbi(w, scores) for w in set(words)}
            assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(counts[w] for w in words))
    assert token_counts.token_counts(documents.limit(0)).collect() == []


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"]
    words = mit.split()
    worn = " ".join(w for i, w in enumerate(words) if i % 11 != 5)
    rows = [(1, f"Code.\n{mit}\nmore"), (2, f"x {worn} y"), (3, "nothing of the kind " * 50), (4, None), (5, ""),
            (6, "Released under the MIT License. " * 2), (7, " ".join(words[:20]))]
    found = license_scan.license_scan(spark.createDataFrame([(i, t, "s", "k", 1) for i, t in rows], LAYOUT)).collect()
    assert Counter((r["doc_id"], r["license"]) for r in found) == {(1, "MIT"): 1, (2, "MIT"): 1, (6, "MIT-line"): 2}
    whole = next(r for r in found if r["doc_id"] == 1)
    assert whole["coverage"] == 1.0 and rows[0][1][whole["start"] : whole["end"]] == mit.rstrip(".")
    assert 0.85 < next(r for r in found if r["doc_id"] == 2)["coverage"] < 0.95


def test_packing_encodes_a_batch_in_small_runs(monkeypatch):
    """What a worker holds at a time must not grow with its Arrow batches."""
    sizes = []

    def counting(path):
        def encode(texts):
            sizes.append(texts.nbytes)
            return np.full(len(texts), bpe_ids.END, np.uint16), np.arange(1, len(texts) + 1)

        return encode

    monkeypatch.setattr(bpe_ids, "encoder", counting)
    texts = pa.array(["some words " * 300] * 2_000)
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(2_000)), "text": texts})
    done = list(bpe_ids.with_ids("", packing.RUN_BYTES)(iter([batch])))
    assert pa.Table.from_batches(done)["row"].to_pylist() == list(range(2_000))
    assert texts.nbytes > 3 * packing.RUN_BYTES and max(sizes) < 1.1 * packing.RUN_BYTES


def test_ids_of_small_runs_are_those_of_the_batch():
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(len(ODD))), "text": pa.array(ODD, pa.string())})
    one, many = (pa.Table.from_batches(bpe_ids.with_ids(bpe_ids.tokenizer_path(), n)(iter([batch]))) for n in (bpe_ids.CHUNK_BYTES, 10))
    assert one.combine_chunks().to_pydict() == many.combine_chunks().to_pydict()


def test_texts_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with session.text_batches(spark):
        rows = spark.range(0, 3 * session.TEXT_ROWS, 1, 1).mapInArrow(lambda bs: (pa.record_batch({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert len(rows) == 3 and max(rows)["n"] <= session.TEXT_ROWS
    assert spark.conf.get(name) == before


def test_a_packing_worker_forgets():
    batch = pa.RecordBatch.from_pydict({"row": pa.array([1]), "text": pa.array(["one word"])})
    for forget in (False, True):
        list(bpe_ids.with_ids(bpe_ids.tokenizer_path(), packing.RUN_BYTES, forget)(iter([batch])))
        assert bool(bpe_ids.encoder.cache_info().currsize) is not forget


def test_frugal_packing_gives_the_same_pieces(spark, documents):
    rows = documents.select("doc_id", "text").coalesce(1)
    plain, frugal = (sorted(packing.pack(rows, frugal=f).collect()) for f in (False, True))
    assert plain == frugal and len(plain) >= rows.count()
