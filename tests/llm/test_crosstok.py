"""Token alignment against encoding whole texts and comparing byte ranges one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kpiloom.llm import crosstok, queries
from kpiloom.llm.common import table


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def letters():
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


LETTERS = letters()


def brute_text(libraries, text):
    """Groups [(a ids, b ids)] and links [(a, b)] of one text, or None without tokens."""
    a, b = libraries
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for p, i in zip(pieces, ids_b, strict=True)]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    spans = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, out = 0, []
        for i, part in zip(ids, parts, strict=True):
            out.append((at, at + len(part), i))
            at += len(part)
        spans.append(out)
    both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = [([], []) for _ in both]
    for side in (0, 1):
        for _, e, i in spans[side]:
            groups[sum(x < e for x in both) if len(both) < 50 else np.searchsorted(both, e)][side].append(i)
    links, j = [], 0
    for s, e, i in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, spans[1][k][2]))
            k += 1
    return len(ids_a), len(ids_b), groups, links


def brute(libraries, rows):
    found = [brute_text(libraries, text) for _, text in rows]
    counts = Counter(p for x in found if x for p in x[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (doc_id, _), x in zip(rows, found, strict=True):
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return out, counts


ODD = [
    None, "", " ", "\n", "a ", " a", "a  b", "a\n\n b", "a \n b\t c", "x  y　 z  w  v\x85 u", "▁a b", "\x00\x01 \x7f x",
    "<|endoftext|> </s><unk> <0x0A>", "é ﬁ été 中文字符 한국어 😀😀 �", "it's we'll 'S  don't", "\r\n\r\n x\n  y", "aaaa" * 300,
    "1234567 89 0.5", "a\x1c b\x1f c\n d", "   lead", "trail   ", "\n\n\n", "中" * 50 + " " + "é" * 51,
]


def random_texts(n):
    rng = random.Random(5)
    parts = ["the", "rivers", "Été", "ñandú", "’s", "'s", " ", "  ", "\n", "\t", " ", "​", "12", "...", "<|", "_x", "中文", "ß", "\x0b", "😀", "q", "\r"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = [*ODD, *random_texts(150), *ODD[6:9], "long tail of words " * 4000]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "a  b"), (None, "quite alone here")]


@pytest.mark.parametrize("params", [crosstok.AlignParams(), crosstok.AlignParams(chunk=200, cache=0)])
def test_alignment_matches_whole_texts(spark, libraries, rows, params):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, counts = brute(libraries, rows)
    assert sorted(map(tuple, crosstok.align_documents(docs, params).collect()), key=str) == sorted(want, key=str)
    aligned = crosstok.align(docs, params)
    got = {(r["a"], r["b"]): r["n"] for r in crosstok.pair_counts(aligned, params).collect()}
    assert got == counts


def test_only_irregular_links_become_rows(spark, libraries):
    docs = spark.createDataFrame([(1, "the river and the stone"), (2, "ñandú Xyzzyq 1234")], "doc_id long, text string")
    aligned = crosstok.align(docs)
    aligner = crosstok.Aligner(crosstok.AlignParams())
    others = aligned.where("chunk is not null").select(F.inline(F.arrays_zip("pair_a", "pair_b"))).collect()
    assert others and all(aligner.same[a] != b for a, b in others)
    _, counts = brute(libraries, [(1, "the river and the stone"), (2, "ñandú Xyzzyq 1234")])
    assert {(a, b) for a, b in others} == {(a, b) for a, b in counts if aligner.same[a] != b}


def test_uncut_texts_give_the_same(libraries, rows):
    whole = crosstok.Aligner(crosstok.AlignParams())
    cut = crosstok.Aligner(crosstok.AlignParams())
    assert whole.cuts
    texts = pa.array([t for _, t in rows if t and len(t) < 5000])
    whole.cuts = False
    out = []
    for aligner in (whole, cut):
        counted = np.zeros(len(aligner.same), np.int64)
        data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts.to_pylist()])])
        found = crosstok._chunk(aligner, data, offsets, counted)
        out.append(([found[k] if isinstance(found[k], list) else found[k].tolist() for k in ("n_a", "n_b", "n_groups", "n_links", "digest")], counted.tolist()))
    assert out[0] == out[1]


def test_empty_table_and_clashing_names(spark, odd_docs, clashing):
    none = crosstok.align_documents(odd_docs.limit(0))
    assert none.collect() == []
    wide = clashing.select("*", *[F.lit("x").alias(c) for c in ("chunk", "unit", "link", "n_a")])
    assert sorted(crosstok.align_documents(wide).collect(), key=str) == sorted(crosstok.align_documents(odd_docs).collect(), key=str)


def test_query_on_given_documents(spark, small, libraries):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op11_alignment(spark, small).collect())) == sorted(brute(libraries, rows)[0])
