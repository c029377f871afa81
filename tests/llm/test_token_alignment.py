"""Alignment against whole encodings and byte offsets tried one by one."""

import hashlib
from collections import Counter, defaultdict

from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cohortlens.llm import bpe_ids, token_alignment
from cohortlens.session import shared_folder

SMALL = "/root/testdata/sf0.001"
LAYOUT = "doc_id long, text string, n_a string, part int"


def stored(spark, rows, parts):
    path = shared_folder(spark, "test-documents")
    spark.createDataFrame(rows, LAYOUT).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


class Brute:
    def __init__(self):
        first, second = token_alignment.tokenizer_paths()
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=second)
        self.byte = {c: n for n, c in enumerate(bpe_ids._byte_characters())}

    def groups(self, text):
        if not text:
            return []
        want = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False)
        first = [(i, bytes(self.byte[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        second = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            second.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        sides = []
        for side in (first, second):
            if b"".join(t for _, t in side) != want:
                return []
            at, ends = 0, []
            for i, t in side:
                at += len(t)
                ends.append((i, at))
            sides.append(ends)
        common = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
        out, low = [], 0
        for high in common:
            out.append(tuple([i for i, e in side if low < e <= high] for side in sides))
            low = high
        return out

    def rows(self, documents):
        found = [(i, self.groups(t)) for i, t in documents]
        counts, links = Counter(), []
        for _, groups in found:
            own = Counter((a, b) for x, y in groups for a in x for b in y)
            links.append(own)
            counts.update(own.keys())
        best = defaultdict(int)
        for (a, _), n in counts.items():
            best[a] = max(best[a], n)
        out = []
        for (i, groups), own in zip(found, links):
            said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append(
                (i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()),
                 sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()),
                 hashlib.sha256(said.encode()).hexdigest() if groups else "")
            )
        return sorted(out, key=str)


def told(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_documents(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = Brute().rows([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert told(token_alignment.aligned_tokenizers(documents)) == want


ODD = [
    None, "", " ", "  ", "\n", " \n ", "One", " one two  three   four ", "a\tb\nc\r\nd\r\r e", "tab\t\tend\t", "it's <|endoftext|> and <s> </s> <unk> <0x41>",
    "▁ piece mark", "a ▁b", "日本語 の テキスト", "naïve café x y　z é\u0085 w", "🙂 🙃‍ x", "=" * 5_000, "a" * 3_000, "\x00 \x01 \x1f\x1c x",
    "Привет, мир! Как дела?", "“quoted” — dash … x", "ﬁ ½ ²", "x " * 20_000, "same text here", "same text here", "é combining", "aGVsbG8gd29ybGQhISE0NTY3ODk=" * 40, "﻿ bom",
]


def test_odd_texts(spark):
    rows = [(None if i == 6 else i, t, "clash", i) for i, t in enumerate(ODD)] + [(23, ODD[23], "clash", 1)] * 2
    want = Brute().rows([(i, t) for i, t, *_ in rows])
    for parts in (1, 4):
        assert told(token_alignment.aligned_tokenizers(stored(spark, rows, parts))) == want
    assert token_alignment.aligned_tokenizers(spark.createDataFrame([], LAYOUT)).collect() == []
    none = spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], LAYOUT)
    assert told(token_alignment.aligned_tokenizers(none)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
