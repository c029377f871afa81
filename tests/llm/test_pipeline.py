"""The corpus pipeline and its filters, stage by stage against plain Python."""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlens.llm import bpe_ids, decontaminate, line_quality, near_dedup
from cohortlens.session import shared_folder

SMALL = "/root/testdata/sf0.001"
LAYOUT = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, removed string, d string"


def stored(spark, rows, layout=LAYOUT):
    path = shared_folder(spark, "test-documents")
    spark.createDataFrame(rows, layout).write.parquet(path)
    return spark.read.parquet(path)


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), "r", 3, "x", "y")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each(rows):
    """Positions of the first row with the smallest id of every component at 0.8."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    heads = defaultdict(list)
    for k in range(len(rows)):
        heads[top(k) if sets[k] else (k,)].append(k)
    return sorted(min((rows[k][0] is None, rows[k][0] or 0) for k in v) for v in heads.values())


LETTERS = str.maketrans("0123456789", "abcdefghij")


def word(number):
    """Letters only: numbers are placeholders to the templates."""
    return f"w{number}".translate(LETTERS)


def sentence(draw, n=14):
    return " ".join(word(i) for i in draw.integers(0, 4000, n))


def odd_rows():
    draw = np.random.default_rng(9)
    whole = [sentence(draw, 60) for _ in range(12)]
    rows = [row(i, t) for i, t in enumerate(whole)]
    rows += [row(100 + i, whole[i] + " tail") for i in range(6)] + [row(3, whole[3]), row(None, whole[4]), row(None, sentence(draw, 40))]
    rows += [row(200, None), row(201, ""), row(202, " \n\t"), row(203, "long " + " ".join(word(i + 10_000) for i in range(30_000)), None)]
    return rows


def test_one_of_each(spark):
    rows = odd_rows()
    kept = near_dedup.one_of_each(stored(spark, rows), near_dedup.NearSettings(shingle=5))
    assert kept.columns == [c.split()[0] for c in LAYOUT.split(", ")]
    found = kept.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == one_of_each(rows)
    assert all((r["row"], r["kept"], r["removed"], r["d"]) == ("r", 3, "x", "y") for r in found)
    assert near_dedup.one_of_each(stored(spark, [])).collect() == []


def expected_lines(rows, limit=10):
    """Lines of hosts that more than ``limit`` different documents hold, a document
    being the set of its lines that are in no more than ``limit`` different texts."""
    texts = {}
    for k, r in enumerate(rows):
        lines = {" ".join(x.split()) for x in (r[1] or "").split("\n") if x.strip()}
        texts[k] = (r[3], frozenset(lines))
    often = defaultdict(set)
    for host, lines in texts.values():
        for x in lines:
            often[host, x].add(lines)
    common = {x for x, held in often.items() if len(held) > limit}
    counts = defaultdict(set)
    for host, lines in texts.values():
        own = frozenset(x for x in lines if (host, x) not in common)
        for x in lines:
            if (host, x) in common:
                counts[host, x].add(own)
    return {x for x, held in counts.items() if len(held) > limit}


def test_lines_are_counted_by_documents(spark):
    draw = np.random.default_rng(4)
    footer, shared = sentence(draw), [sentence(draw, 40) for _ in range(3)]
    # thirty different documents with one footer, each ten of which share a long line
    rows = [row(i, f"{sentence(draw, 30)}\n{shared[i % 3]}\n{footer}") for i in range(30)]
    rows += [row(100 + i, f"{sentence(draw, 30)}\n{footer}", "b") for i in range(10)]
    rows += [row(200 + i, f"{sentence(draw, 30)}\n{footer}", None) for i in range(11)]
    copied = f"{sentence(draw, 30)}\n{sentence(draw, 30)}"
    rows += [row(300 + i, copied) for i in range(50)]
    gone = expected_lines(rows)
    assert {x for x in gone} == {("a", footer), (None, footer)}
    kept = {r["doc_id"]: r for r in line_quality.cleaned(stored(spark, rows)).collect()}
    assert set(kept) == {r[0] for r in rows}
    for r in rows:
        want = "\n".join(x for x in r[1].split("\n") if (r[3], x) not in gone)
        assert (kept[r[0]]["text"], kept[r[0]]["n_chars"]) == (want, len(want))


def test_filters_on_odd_and_empty_tables(spark):
    rows = odd_rows()
    texts = {r[0]: r[1] for r in rows}
    kept = line_quality.cleaned(stored(spark, rows))
    assert kept.columns == [c.split()[0] for c in LAYOUT.split(", ")]
    found = kept.collect()
    assert {r["doc_id"] for r in found} == set(texts) - {200, 201, 202} and len(found) == len(rows) - 3
    assert all(r["text"] == texts[r["doc_id"]] for r in found if r["doc_id"] is not None)
    assert line_quality.cleaned(stored(spark, [])).collect() == []
    bench = spark.createDataFrame([(1, rows[5][1]), (2, None)], "item_id long, text string")
    left = decontaminate.decontaminated(stored(spark, rows), bench).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(r[0]) for r in rows if r[0] not in (5, 105))


def test_a_very_long_text_is_searched(spark):
    draw = np.random.default_rng(8)
    item = sentence(draw, 40)
    words = [word(10_000 + i) for i in draw.integers(0, 20_000, 100_000)]
    leaked = " ".join([*words[:60_000], item, *words[60_000:]])
    docs = stored(spark, [row(1, " ".join(words)), row(2, leaked)])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()] == [(2, 7)]


@pytest.fixture(scope="module")
def folder(spark):
    """A small corpus of its own: clean, rejected, repeated and leaking documents."""
    draw = np.random.default_rng(17)
    place = shared_folder(spark, "test-corpus")
    items = [sentence(draw, 30) for _ in range(3)]
    footer = sentence(draw)
    rows = [row(i, f"{sentence(draw, 80)}\n{footer}") for i in range(20)]
    rows += [row(50 + i, rows[i][1] + " more") for i in range(5)] + [row(2, rows[2][1])]
    rows += [row(60 + i, f"{sentence(draw, 30)} {items[i]} {sentence(draw, 30)}", "b") for i in range(3)]
    rows += [row(70, "short"), row(71, None), row(72, ""), row(None, sentence(draw, 50), None)]
    layout = LAYOUT.rsplit(", ", 4)[0]
    spark.createDataFrame([r[:5] for r in rows], layout).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, [r[:5] for r in rows], footer


def test_run(spark, folder):
    place, rows, footer = folder
    pieces = corpus_pipeline.run(spark, place).collect()
    whole = Tokenizer.from_file(bpe_ids.tokenizer_path())
    want = {r[0]: r[1].replace(f"\n{footer}", "") for r in rows[:20]}
    want[None] = rows[-1][1]
    sizes = defaultdict(int)
    for p in pieces:
        sizes[p["doc_id"]] += p["length"]
        assert p["length"] > 0 and p["offset"] + p["length"] <= 2048
    assert dict(sizes) == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def test_stages_keep_the_columns_of_documents(spark, folder):
    place, _, _ = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, place).schema.simpleString() == docs.schema.simpleString()


def test_run_on_empty_tables(spark, folder):
    place = shared_folder(spark, "test-empty")
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{place}/{name}.parquet")
    assert corpus_pipeline.run(spark, place).collect() == []


def test_lines_are_measured_in_slices():
    rows = 2 * line_quality.SLICE_ROWS + 3
    batch = pd.DataFrame({"row": range(rows), "doc_id": [str(k) for k in range(rows)], "text": ["a b\nc"] * rows, "host": [None] * rows}, index=range(9, 9 + rows))
    parts = list(line_quality._measures(iter([batch])))
    assert max(map(len, parts)) <= line_quality.SLICE_ROWS
    assert [r for p in parts for r in p["row"]] == list(range(rows)) and all((p["n_words"] == 3).all() for p in parts)
