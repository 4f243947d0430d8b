"""Each corpus operator against brute force, a round trip or held-out labels."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kpiloom.llm import chat, decontam, langid, licenses, packing, quality, queries, rules, simhash, toxicity, warc
from kpiloom.llm.common import SPACED, held_out, lowered, run_hashes, spans, table, tokens
from kpiloom.llm.components import components
from tools.compare import connect, differences


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------------ SimHash

def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    n = max(len(words) - 2, 1)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def brute_components(prints, bits):
    groups = list(range(len(prints)))

    def find(i):
        while groups[i] != i:
            i = groups[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                groups[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("params", [simhash.SimHashParams(), simhash.SimHashParams(leaf=8, block=5, sample=16), simhash.SimHashParams(leaf=4, leaves=3, block=7, sample=4)])
def test_simhash_matches_all_pairs(odd_docs, odd_rows, params):
    got = sorted(simhash.near_duplicates(odd_docs, params=params).select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fp"), "component_id").collect(), key=str)
    prints = [brute_print(r[1]) for r in odd_rows]
    owner = brute_components(prints, 3)
    least = defaultdict(list)
    for r, g in zip(odd_rows, owner, strict=True):
        if r[0] is not None:
            least[g].append(r[0])
    want = [(r[0], f"{p:016x}", min(least[g]) if least[g] else None) for r, p, g in zip(odd_rows, prints, owner, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_spark_xxhash_is_the_named_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("été one two"))).first()
    assert row[0] & (2**64 - 1) == xxhash.xxh64_intdigest("été one two".encode(), 42)


def test_dense_group_returns_a_star_and_no_pair_is_lost():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3000, 2)).astype(np.uint64)
    points = np.unique(centre[rng.integers(0, 40, 3000)] ^ flips[:, 0] ^ flips[:, 1])
    found = []
    for which in (0, 1):
        a, b = simhash.near_links(points, points, which, 3, small=1 << 14)
        assert len(a) <= len(points)
        found += list(zip(a.tolist(), b.tolist(), strict=True))
    group = {int(p): int(p) for p in points}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in found:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    assert all(find(int(points[x])) == find(int(points[y])) for x, y in zip(i, j, strict=True))


def test_routing_reaches_every_shard_a_ball_touches():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 32, 4000).astype(np.uint32)
    tree = simhash.grow(values[:2000], 32)
    row, leaf, home = simhash.route(tree, values, 1)
    at_home = dict(zip(row[home].tolist(), leaf[home].tolist(), strict=True))
    assert len(at_home) == len(values)
    reached = defaultdict(set)
    for r, k in zip(row.tolist(), leaf.tolist(), strict=True):
        reached[r].add(k)
    moved = values ^ (np.uint32(1) << rng.integers(0, 32, len(values)).astype(np.uint32))
    again, leaf2, home2 = simhash.route(tree, moved, 1)
    for r, k in zip(again[home2].tolist(), leaf2[home2].tolist(), strict=True):
        assert k in reached[r]


def test_trees_grow_with_the_fingerprints():
    rng = np.random.default_rng(4)
    params, seen = simhash.SimHashParams(), []
    for count in (10**6, 10**7, 10**8):
        leaves, wanted = simhash.shape(count, params)
        assert leaves == -(-count // params.leaf) and wanted == 16 * leaves
        tree = simhash.grow(np.unique(rng.integers(0, 1 << 32, wanted).astype(np.uint32)), leaves)
        row, leaf, home = simhash.route(tree, rng.integers(0, 1 << 32, 20_000).astype(np.uint32), 1)
        grown = int(tree.leaf.max()) + 1
        assert grown >= 0.9 * leaves
        reached, homes = (np.bincount(x, minlength=grown) / 20_000 * count for x in (leaf, leaf[home]))
        seen.append((len(row) / 20_000, (homes * reached).sum() / count))
    # a hundred times the fingerprints: rows and pairs of each grow by their ball of 33 points, not by a hundred
    assert seen[-1][0] < 6 * seen[0][0] and seen[-1][1] < 7 * seen[0][1]
    assert simhash.shape(10**12, params) == (params.leaves, 16 * params.leaves)


def test_deduplicate_takes_names_of_its_own(spark, odd_docs):
    names = ["_hash", "_best_id", "_best_hash", "_id", "_hash_of_text"]
    wide = odd_docs.select("*", *[F.lit(n).alias(n) for n in names])
    kept = simhash.deduplicate(wide)
    assert kept.columns == wide.columns and kept.count() == simhash.deduplicate(odd_docs).count()
    assert kept.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == kept.count()
    assert simhash.deduplicate(odd_docs.limit(0)).collect() == []


def test_deduplicate_keeps_one_row_of_each_component(odd_docs, clashing, odd_rows):
    kept = simhash.deduplicate(odd_docs).collect()
    owner = brute_components([brute_print(r[1]) for r in odd_rows], 3)
    assert len(kept) == len(set(owner))
    best = {}
    for r, g in zip(odd_rows, owner, strict=True):
        best[g] = min(best.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted(str(k["doc_id"]) for k in kept) == sorted("None" if n else str(i) for n, i in best.values())
    wide = simhash.deduplicate(clashing)
    assert wide.columns == clashing.columns and wide.count() == len(kept)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7), (None, 3)]
    got = components(spark, spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["label"] for r in got} == {**{i: 0 for i in range(201)}, 400: 400, 450: 400, 500: 400}
    assert len(got) == 204


# ------------------------------------------------------------------ packing

ODD_TEXTS = ["", "a<|endoftext|>b <|ENDOFTEXT|>", "İstanbul ΣΑΣ́ x y\x02z \x02", "don't WE'LL they'RE 12ab!! x_y", "é ́a  Å \x1c a\x85b", "ﬁ Éa ÷× ß"]


def test_token_ids_are_the_tokenizers(odd_rows):
    params = packing.PackingParams()
    for cache in (1000, 40):
        own = packing.WordTokenizer(params.path(), cache)
        texts = ODD_TEXTS + [r[1] or "" for r in odd_rows]
        want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in own.texts(pa.array(texts))] == want


def test_hashes_do_not_depend_on_pieces():
    rng = np.random.default_rng(7)
    data = rng.choice(np.frombuffer(b"abcdefg  \n", np.uint8), 5000)
    data[1000:2500] = 97
    starts, ends, _ = spans(data, np.array([0, 1700, 5000]), SPACED)
    short = np.minimum(starts + 3, ends)
    whole = run_hashes(data, starts, [ends, short])
    for piece in (1, 64, 999):
        parts = run_hashes(data, starts, [ends, short], piece)
        assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    by = {}
    for w, h in zip(words, whole[0].tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_a_long_text_needs_little_beside_itself():
    import tracemalloc

    data = np.tile(np.frombuffer(b"some words of a long text and more\n", np.uint8), 1_500_000)  # 50 MB
    tracemalloc.start()
    hashes, *_ = tokens(data, np.array([0, len(data)]), SPACED)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == 12_000_000 and len(np.unique(hashes[:16])) == 8
    # a few numbers a word and a few bytes a byte, not tables as long as the text
    assert peak < 16 * len(data)


def thue_morse(order, a="a", b="b"):
    word, other = a, b
    for _ in range(order):
        word, other = word + other, other + word
    return word, other


def test_words_are_told_apart_by_their_bytes():
    # the two words of each order have one value under any polynomial modulo 2^64
    encode = packing.WordTokenizer(packing.PackingParams().path(), 1000)
    texts = [" ".join(("x", w, "y")) for order in (10, 11) for pair in (thue_morse(order), thue_morse(order, "é", "z")) for w in pair]
    want = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encode.texts(pa.array(texts))] == want
    assert len({tuple(w) for w in want}) == len(want)
    one_by_one = [next(encode.texts(pa.array([t]))).tolist() for t in texts]
    assert one_by_one == want


def test_words_of_one_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(packing, "run_hashes", lambda data, starts, ends: [(ends[0] - starts).astype(np.uint64) % np.uint64(3)])
    encode = packing.WordTokenizer(packing.PackingParams().path(), 300)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcé1.") for _ in range(rng.randint(1, 4))) for _ in range(60)) for _ in range(20)]
    want = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in encode.texts(pa.array(texts))] == want


def test_tokenizer_of_another_split_is_encoded_through_the_whole(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(packing.PackingParams().path())
    other.normalizer = normalizers.Sequence([normalizers.Lowercase(), normalizers.Replace("th", "x")])
    other.save(str(tmp_path / "other.json"))
    encode = packing.WordTokenizer(str(tmp_path / "other.json"), 1000)
    texts = ["the other thing, and that!!"]
    assert [x.tolist() for x in encode.texts(pa.array(texts))] == [e.ids for e in encode.tokenizer.encode_batch(texts)]


def test_packing_takes_empty_tables_and_clashing_names(spark, odd_docs):
    assert packing.pack_documents(odd_docs.limit(0)).collect() == []
    names = ["_bucket", "_nth", "_before", "_at"]
    pieces = packing.cut(odd_docs).select("*", *[F.lit(n).alias(n) for n in names])
    packed = packing.pack(pieces)
    assert set(names) <= set(packed.columns) and packed.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == pieces.count()


def test_packing_places_every_id_once(odd_docs, odd_rows):
    params = packing.PackingParams(length=64, bucket=7)
    packed = packing.pack_documents(odd_docs, params, keep_ids=True).cache()
    rows = packed.collect()
    encode = packing.WordTokenizer(params.path(), 1000)
    want = Counter()
    for ids in encode.texts(pa.array([r[1] for r in odd_rows])):
        want[tuple([*ids.tolist(), 2])] += 1
    pieces = Counter((tuple(r["ids"]), r["start"], r["doc_tokens"]) for r in rows)
    cut = Counter()
    for ids, n in want.items():
        for a in range(0, len(ids), 64):
            cut[ids[a : a + 64], a, len(ids)] += n
    assert pieces == cut
    by = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(spans[-1]) <= 64
    assert sorted(by) == list(range(len(by)))
    seq = packing.sequences(packed, params).collect()
    for s in seq:
        assert s["used"] == len(s["ids"]) and s["padded_length"] == (s["used"] if s["used"] & (s["used"] - 1) == 0 else 64)
    assert len(by) <= 1.1 * sum(r["length"] for r in rows) / 64 + 1


def test_pack_plan_is_tight_and_complete():
    rng = random.Random(2)
    histogram = Counter(min(4096, int(rng.expovariate(1 / 900)) + 1) for _ in range(20000))
    plan = packing.plan(dict(histogram), 4096)
    assert sum(k * n for k, n in histogram.items()) / 4096 / plan.sequences > 0.99
    assert packing.plan({}, 4096).sequences == 0


# -------------------------------------------------------------- classifiers

@pytest.fixture(scope="module")
def tenth():
    return "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, label, least", [("op3_quality", "quality", 0.98), ("op7_toxicity", "toxic", 0.96)])
def test_held_out_labels(spark, tenth, name, label, least):
    got = queries.queries()[name](spark, tenth).cache()
    docs = table(spark, tenth, "documents").count()
    assert got.count() == docs and got.where("score between 0 and 1").count() == docs
    joined = got.join(table(spark, tenth, "labels"), "doc_id").where("held_out").toPandas()
    assert (joined["predicted"] == joined[label]).mean() >= least
    clean = joined[joined[label] == (0 if label == "toxic" else 1)]
    assert (clean["predicted"] == clean[label]).mean() >= 0.97


def test_held_out_languages(spark, tenth):
    got = queries.op8_language(spark, tenth).join(table(spark, tenth, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 10000
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.99


def test_classifiers_take_odd_and_empty_tables(spark, odd_docs, clashing, odd_rows):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(60)] + [(None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    for operator in (lambda d: quality.classify(d, labels), lambda d: toxicity.classify(d, labels), langid.identify):
        for docs in (odd_docs, clashing):
            rows = operator(docs).collect()
            assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
        assert operator(odd_docs.limit(0)).collect() == []
        same = operator(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").withColumn("lang", F.lit("en"))).collect()
        assert same[0]["score"] == same[1]["score"]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd_docs).collect()}
    assert found[900] == found[901] == found[905] == "und" and found[903] in ("en", "fr")


def test_language_sample_counts_what_can_be_drawn(spark):
    learned = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 5][:8000]
    held = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 5 == 0][:4000]
    rows = [(i, "kurze zeile", "de") for i in learned[:2000]]
    rows += [(i, "une ligne", "fr") for i in held] + [(i, "une ligne", "fr") for i in learned[2000:2100]]  # mostly held out
    rows += [(i, f"ciao {i} " * 100 + "riga lunga " * 20, "it") for i in learned[2100:2200]]  # long texts only
    rows += [(learned[2200], f"same id {k}", "en") for k in range(5000)] + [(i, "a line", "en") for i in learned[2201:2300]]
    rows += [(i, "x" + "1" * 2000, "pt") for i in learned[2300:2310]]  # one letter outside nearly every piece
    rows += [(None, "no id", "de"), (learned[2310], None, "de"), (learned[2311], "123", "de"), (learned[2312], "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    params = langid.LanguageParams(per_language=100, max_chars=300)
    got = langid.sample(docs, params).to_pylist()
    found = Counter(r["lang"] for r in got)
    assert {x: found[x] for x in ("fr", "it", "en", "pt")} == {"fr": 100, "it": 100, "en": 100, "pt": 10}
    assert 60 <= found["de"] <= 140 and len({(r["doc_id"], r["lang"]) for r in got}) == len(got)
    assert all(len(r["text"]) <= 300 and re.search("[a-z]", r["text"]) for r in got)
    assert langid.sample(docs.repartition(7), params).to_pylist() == got
    assert len({r["text"] for r in got if r["lang"] == "it"}) > 50


def test_held_out_fold(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_long_text_scores_as_one(monkeypatch):
    sample = pa.table({"text": ["bad idiot word", "fine clean word"] * 40, "lang": ["en"] * 80, "label": [1, 0] * 40})
    model = toxicity.train(sample)
    ids = np.random.default_rng(0).integers(0, 1 << model.bits, (5000, 3))
    whole = toxicity._pooled(model.embed, model.kernels, model.offsets, ids, np.array([0, 5000]))[0]
    assert np.allclose(toxicity._long_pooled(model, ids, step=700), whole, atol=1e-4)


# ----------------------------------------------------------------- licenses

def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = []
    for phrase, label in licenses.BASE.items():
        want = phrase.split()
        at += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), sorted(at)


def test_license_base_places(spark):
    rng = random.Random(4)
    bits = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "mité", "0", "licensed"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "-", "\n", ". ", "é"]) for _ in range(rng.randint(0, 60))).upper() for _ in range(400)]
    texts += [None, "", "xcc by nc", "cc by nc", "released under the MIT\tLicense.", "CC BY-NC-SA 4.0", "cc by", "nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in licenses.scan_documents(docs).collect():
        n, places = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], [tuple(b) for b in r["base"]]) == (n, places)


def test_license_notices_with_any_separators(spark):
    gaps = [" ", "  ", "\n", "\n * ", "\n# ", "-", "\r\n// "]
    def written(way, gap):
        """The first alternative of each word that cannot be missing."""
        return gap.join(w for token in way.split() if not token.endswith("?") for w in token.split("|")[0].split("+")).upper()

    rows = [(written(way, gap), label) for label, way, *_ in licenses.NOTICES for gap in gaps]
    docs = spark.createDataFrame([(i, f"Text {t}: end") for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(2)
    for r in licenses.scan_documents(docs).collect():
        text, label = rows[r["doc_id"]]
        assert label in [d["label"] for d in r["found"]] and max(d["certainty"] for d in r["found"]) > 0, text
    assert all(r.keyword in r.pattern.pattern for r in licenses.rules())


def test_license_suppression():
    def labels(t):
        return [(d.label, d.base) for d in licenses.settle(licenses.detections(t.encode()))]

    assert ("cc-by-nc-sa", False) in labels("licensed under cc by nc sa 4.0") and ("cc-by", False) not in labels("licensed under cc by nc sa 4.0")
    assert labels("under the mit license") == [("mit", True), ("mit", False)]
    assert ("gpl-3", False) in labels("this work is licensed under the gnu general public license, version 3.")
    assert ("gpl", False) not in labels("this work is licensed under the gnu general public license, version 3.")
    assert labels("the river was wide") == [] and len(licenses.rules()) > 200


def test_license_suppression_matches_all_pairs():
    rng = random.Random(8)
    for _ in range(200):
        found = [licenses.Detection(f"l{k}", a, a + rng.randint(1, 9), rng.choice([10, 20, 30]), 1.0, k % 7 == 0)
                 for k, a in enumerate(rng.randint(0, 30) for _ in range(rng.randint(0, 25)))]
        want = []
        for d in sorted((d for d in found if not d.base), key=lambda d: (-d.priority, d.start - d.end, d.start)):
            if not any(k.start <= d.start and d.end <= k.end for k in want):
                want.append(d)
        want += [d for d in found if d.base]
        assert sorted(licenses.settle(found), key=repr) == sorted(want, key=repr)
    many = [licenses.Detection("mit", 10 * k, 10 * k + 9, 20, 0.7, False) for k in range(100_000)]
    assert licenses.settle(many) == many


# --------------------------------------------------------------------- chat

@pytest.mark.parametrize("params", [chat.ChatParams(), chat.ChatParams(budget=80, history=20, chunk=3)])
def test_chat_round_trip(spark, params):
    rng = random.Random(5)
    parts = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "\\\\", "<\\s>", "plain", "é😀", "\n", ""]
    rows = []
    for conv in [*range(12), None]:
        if conv is None or conv % 3 == 0:
            rows.append((conv, -1, "system", "be kind [INST]"))
        for turn in range(rng.randint(1, 25)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))])))
    rows += [(3, 2, "user", "tie"), (3, 2, "user", "tie"), (4, None, "assistant", "no turn")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat.windows(frame, params).cache()
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted(
            ((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
        )
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        turns = chat.parse(w["formatted"])
        assert len(turns) == w["n_repeated"] + w["n_new"] and w["n_new"] > 0
        cost = [len(t.encode()) // -4 * -1 + params.overhead for _, t in turns]
        if max(cost) <= params.budget // 8:
            assert sum(cost) <= params.budget
        assert len(w["loss_spans"]) == sum(r == "assistant" for r, _ in turns[w["n_repeated"] :])
    assert chat.read_back(chat.windows(frame.limit(0))).collect() == []


# --------------------------------------------------------- decontamination

def edits(a, b):
    """Least edits from a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 3, 5, 6, 7, 9, 12, 15, 20, 30, 45, 60) for _ in range(2)]
    texts = []
    for _ in range(300):
        w = list(rng.choice(items))
        for _ in range(rng.randint(0, max(1, int(0.26 * len(w))))):
            at = rng.randrange(len(w)) if w else 0
            w[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + w + body[at:]).upper())
    texts += [None, "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)] + [(99, None), (None, "w1"), (98, "")], "item_id long, text string")
    for params in (decontam.DecontamParams(), decontam.DecontamParams(block=7)):
        got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.contamination(docs, bench, params).collect()}
        want = {}
        for d, t in enumerate(texts):
            for i, w in enumerate(items):
                if (e := edits(w, (t or "").lower().split())) <= len(w) // 5:
                    want[d, i] = e
        assert set(got) <= set(want)
        assert len(set(got)) >= 0.99 * len(want)
        exact = {k for k, e in want.items() if not e}
        assert exact <= set(got) and all(got[k] == 0 for k in exact)
    leaked = {d for d, _ in got}
    assert {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()} == set(range(len(texts))) - leaked
    assert decontam.contamination(docs, bench.limit(0)).collect() == []


def brute_words(text):
    """Alphanumeric runs, and single characters of the scripts used below."""
    pattern = r"[\u0e00-\u0e7f\u3041-\u3096\u30a1-\u30fa\u30fc\u3400-\u9fff\U00020000-\U0002a6df]|[0-9a-zé\uff10-\uff19]+"
    return re.findall(pattern, lower(text))


def test_decontamination_in_scripts_without_spaces(spark):
    items = {
        1: "北京是中华人民共和国的首都，也是全国的政治中心。",
        2: "日本語の文章には単語の間に空白がありません",
        3: "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย",
        4: "to be or not to be — that is the question",
        5: "𠀀𠀁𠀂",
    }
    docs = {
        1: f"据说{items[1].replace('首都，', '首都,')}所以很多人都知道这一点！",
        2: f"さて、{items[2].replace('文章', '文書')}という話です",
        3: f"ว่ากันว่า{items[3]}และใหญ่มาก",
        4: "He said “to be or not to be—that is the question”… twice",
        5: "前𠀀𠀁𠀂後",
        6: "上海是一个很大的城市，很多人都知道这一点。𠀀𠀁後𠀂 to be a question",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["edits"]) for r in decontam.contamination(frame, bench).collect()}
    assert {k: e for k, (_, e) in got.items()} == {(1, 1): 0, (2, 2): 1, (3, 3): 0, (4, 4): 0, (5, 5): 0}
    for (d, i), (at, edit) in got.items():
        assert edit == edits(brute_words(items[i]), brute_words(docs[d]))
        assert edit or brute_words(docs[d])[at:][: len(brute_words(items[i]))] == brute_words(items[i])
    assert [r["doc_id"] for r in decontam.decontaminate(frame, bench).collect()] == [6]


def test_words_of_mixed_scripts():
    texts = ["GPT模型和ABC", "", "é東a", "ทa１２ b", "x。y\u3000z「東京」", "plain words only", "\u00a0a\u00a0"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    body = lowered(np.frombuffer(b"".join(data), np.uint8))
    _, starts, ends, first = tokens(body, offsets, None)
    got = [[body[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
    assert got == [brute_words(t) for t in texts]
    odd = np.frombuffer(b"\x80a\xe6\x9c \xf0\xff\xe4", np.uint8)
    assert len(tokens(odd, np.array([0, len(odd)]), None)[0]) >= 1
    items = decontam.Items([1, 2], ["a b c d e f", "g h i"], decontam.DecontamParams())
    rows, sizes = np.stack([items.words[0]] * 5), np.array([6, 5, 4, 6, 3])
    assert (items.buckets(rows, sizes, 20) == items.buckets(rows, sizes)).all()


def test_shared_grams_in_runs_find_the_same_windows():
    rng = random.Random(9)
    head = "answer the following question with one short sentence".split()
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(head + [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]) for _ in range(60)]
    items = decontam.Items(list(range(60)), texts, decontam.DecontamParams())
    found = [decontam.hash_words(" ".join(rng.sample(texts, 3))) for _ in range(20)]
    words, first = np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
    whole = decontam._windows(items, words, first, 1 << 40)
    assert len(whole) > 100
    matched = decontam._matches(items, words, first)
    for step in (1, 50, 3000):
        parts = {tuple(r) for r in decontam._windows(items, words, first, step)}
        assert parts == {tuple(r) for r in whole}
    assert len({(t, i) for t, i, *_ in matched}) >= 60


# -------------------------------------------------------------------- rules

def test_rules_against_brute_force(odd_docs, odd_rows):
    got = sorted((tuple(r[2:]) for r in rules.measure(odd_docs).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    want = []
    for r in odd_rows:
        text = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)))
    assert got == sorted(want)


def test_rules_use_no_python_and_keep_every_row(spark, clashing, odd_rows):
    frame = rules.rule_documents(clashing)
    plan = frame._jdf.queryExecution().toString() + rules.measure(clashing)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert frame.count() == len(odd_rows) and frame.where("kept is null or base_failed is null").count() == 0
    assert rules.rule_documents(clashing.limit(0)).collect() == []
    names = ["_words", "_lines", "_lang", "_source", "_most_symbols"]
    wide = rules.apply_rules(rules.measure(clashing.select("*", *[F.lit(n).alias(n) for n in names])))
    assert wide.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == clashing.count()


def measured_rows(spark, rows):
    """(source, symbols, dup_lines, repeats, word_length) per 1,000 words as measured documents."""
    frame = spark.createDataFrame(rows, "source string, n_symbols long, n_dup_lines long, n_repeat_words long, word_chars long")
    return frame.withColumns({"lang": F.lit("en"), "n_words": F.lit(1000).cast("long"), "doc_id": F.monotonically_increasing_id()})


def test_fences_follow_their_group(spark):
    rng = random.Random(3)
    rows = [(s, by + rng.randrange(100), by + rng.randrange(40), by + rng.randrange(60), 5000 + 20 * by + rng.randrange(400))
            for s, by in (("low", 0), ("high", 120)) for _ in range(2000)]
    rows += [("flat", 0, 0, 0, 5000)] * 500
    got = {r["source"]: r for r in rules.fences(rules.sketches(measured_rows(spark, rows))).collect()}
    for k, m in enumerate(rules.METRICS):
        params = rules.RuleParams()
        assert got["high"][f"most_{m}"] > got["low"][f"most_{m}"]
        column = sorted(r[k + 1] for r in rows if r[0] == "low")
        want = column[999] + params.fence[k] * (column[int(2000 * params.high[k]) - 1] - column[999])
        assert abs(got["low"][f"most_{m}"] - want) <= 0.05 * want + 20
        assert got["flat"][f"most_{m}"] == rows[-1][k + 1] // 64 * 64 + params.fence[k] * params.floors[k] or k < 3
    # junk below the tolerated share does not move a fence by more than its rank
    junk = [("low", 3000, 900, 250, 30000)] * 15
    with_junk = {r["source"]: r for r in rules.fences(rules.sketches(measured_rows(spark, rows + junk))).collect()}
    ruled = rules.apply_rules(measured_rows(spark, rows + junk))
    assert all(with_junk["low"][f"most_{m}"] <= got["low"][f"most_{m}"] * 1.2 for m in rules.METRICS)
    assert ruled.where("n_symbols = 3000 and kept").count() == 0 and ruled.where("not kept").count() <= 15 + 20


def test_sketches_decide_most_fences_and_every_metric_rejects(spark, tenth):
    measured = rules.measure(table(spark, tenth, "documents").select("doc_id", "lang", "source", "text")).drop("text").cache()
    fences = rules.fences(rules.sketches(measured)).cache()
    params = rules.RuleParams()
    none = rules.fences(rules.sketches(measured), rules.RuleParams(floors=(0, 0, 0, 0)))
    same = fences.join(none.select("lang", "source", *[F.col(f"most_{m}").alias(f"own_{m}") for m in rules.METRICS]), ["lang", "source"])
    decided = same.select(sum((F.col(f"most_{m}") == F.col(f"own_{m}")).cast("int") for m in rules.METRICS).alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert 2 * decided[0] > len(rules.METRICS) * decided[1]
    passing = measured.where(~rules.base_failed()).join(fences, ["lang", "source"])
    for m in rules.METRICS:
        assert passing.where(rules._metric(m) > F.col(f"most_{m}")).count() > 0, m
    assert all(fences.select(f"most_{m}").distinct().count() > 10 for m in rules.METRICS[1:])


@pytest.mark.parametrize("name", ["op9_rules", "op10_warc"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql_definitions(spark, name, sf):
    path = f"/root/testdata/{sf}"
    frame = queries.queries()[name](spark, path)
    assert differences(frame, frame.collect(), connect(path), queries.oracle_sql()[name]) == []


# --------------------------------------------------------------------- WARC

@pytest.mark.parametrize("split, least", [(4 << 20, 0), (300, 0), (300, 10)])
def test_warc_round_trip(spark, split, least):
    rng = random.Random(7)
    bodies = ["<p>one</p>", "<p>two</p>", "", None, "WARC/1.1\r\n\r\n", "\x1f\u008b\x08" * 50, "é" * 3000] + ["".join(chr(rng.randint(1, 0x2FF)) for _ in range(500)) for _ in range(20)]
    rows = [(i, rng.choice(["http://a/b", "http://x/é\r\nWARC-Type: x%", None]), rng.choice(bodies)) for i in range(150)] + [(None, "u", "alone"), (7, "u", "again"), (7, "u", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(5)
    params = warc.WarcParams(split=split, file_bytes=4000, least=least)
    got = sorted(map(tuple, warc.round_trip(pages, params).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        revisit = len(raw) >= least and last.get(h or "") is not None and last[h or ""] != i
        want.append((i, len(raw), digest, "revisit" if revisit else "response", last[h or ""] if revisit else None))
    assert got == sorted(want, key=str)


def archive(bodies):
    members = [warc.record(i, "u", "response", warc.digest_of(p), len(p), None, p) for i, p in enumerate(bodies)]
    return b"".join(members), np.cumsum([0, *map(len, members)]).tolist()


def read_ranges(data, split, strict=True):
    import io

    size = len(data) if strict else None
    return [r for s in range(0, len(data), split) for r in warc.records_in(io.BytesIO(data), s, s + split, size=size)]


def test_warc_reader_skips_false_magic():
    members = [warc.record(i, "u", "response", warc.digest_of(p), len(p), None, p) for i, p in enumerate([b"a", warc.MAGIC * 99, b"c" * 99])]
    junk = warc.MAGIC + b"\x00" * 20 + warc.MAGIC[:2]
    data = junk + members[0] + junk + members[1] + members[2] + warc.MAGIC
    for split in (1, 7, 50, 10_000):
        assert [p for _, _, p in read_ranges(data, split, strict=False)] == [b"a", warc.MAGIC * 99, b"c" * 99]
        with pytest.raises(ValueError):
            read_ranges(data, split)


@pytest.mark.parametrize("split", [1, 9, 64, 333, 10_000])
def test_warc_reader_loses_no_record_without_a_word(split):
    rng = random.Random(split)
    bodies = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 5, 700, 40, 1, 2000)]
    data, bounds = archive(bodies)
    assert [p for _, _, p in read_ranges(data, split)] == bodies
    for k in range(len(bodies)):
        for where in (0, (bounds[k] + bounds[k + 1]) // 2, 12):
            at = where if where > 12 else bounds[k] + where
            flipped = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
            with pytest.raises(ValueError):
                assert [p for _, _, p in read_ranges(flipped, split)] == bodies, "a wrong payload is an error too"
                raise ValueError("the flipped bit was not in what the record says")
    for cut in (len(data) - 1, len(data) - 30, bounds[-2] + 3):
        with pytest.raises(ValueError):
            read_ranges(data[:cut], split)


def test_warc_flipped_and_cut_files_fail_the_job(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * i) for i in range(40)], "page_id long, url string, html string")
    params = warc.WarcParams(split=200)
    files = warc.write(pages.coalesce(1), str(tmp_path / "w"), params)
    (row,) = files.collect()
    data = open(row["path"], "rb").read()
    assert warc.read(spark, files, params).count() == 40 == row["records"]
    for broken in (data[:1000] + bytes([data[1000] ^ 1]) + data[1001:], data[:-9]):
        open(row["path"], "wb").write(broken)
        with pytest.raises(Exception, match="record|digest"):
            warc.read(spark, spark.createDataFrame([(row["path"], len(broken))], "path string, bytes long"), params).collect()


def test_warc_records_have_dates_and_ids_of_their_own(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (None, "u", "b"), (2, "u", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write(pages, str(tmp_path / "w"), warc.WarcParams(date="2024-05-06T07:08:09Z"))
    heads = []
    for f in files.collect():
        data = open(f["path"], "rb").read()
        heads += [h for _, h, _ in read_ranges(data, 100)]
    assert len(heads) == 5 and len({h["warc-record-id"] for h in heads}) == 5
    assert {h["warc-date"] for h in heads} == {"2024-05-06T07:08:09Z"}


def test_warc_reader_takes_archives_of_others(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nContent-Length: 4\r\n\r\nsoft\r\n\r\n"
    page = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <urn:uuid:3-4>\r\nwarc-target-uri: http://x/\r\n y\r\nContent-type: application/http; msgtype=response\r\nCONTENT-LENGTH: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(info) + gzip.compress(page))
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    rows = sorted(warc.read(spark, files, warc.WarcParams(split=50)).collect(), key=lambda r: r["offset"])
    assert [r["record_type"] for r in rows] == ["warcinfo", "response"] and rows[1]["url"] == "http://x/ y"
    assert bytes(rows[1]["payload"]) == b"<p>body</p>" and rows[1]["payload_digest"] == warc.digest_of(b"<p>body</p>")
    assert rows[0]["page_id"] is None and rows[1]["page_id"] is None and rows[0]["payload"] is None
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).collect() == []


# ----------------------------------------------------------------- pipeline

def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from __spark_entry__ import queries as registered
    from kpiloom.sources.extracts import written

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in registered()
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [decontam.hash_words(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = written(spark, "test-stage", stage(spark, docs, sf))
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "SimHash near-dedup":
            order = sorted(rows)
            owner = brute_components([brute_print(rows[i]) for i in order], 3)
            assert ids == {min(i for i, h in zip(order, owner, strict=True) if h == g) for g in set(owner)}
        elif name == "benchmark decontamination":
            whole = {i: " ".join(map(str, decontam.hash_words(t))) for i, t in rows.items()}
            exact = {i for i, t in whole.items() if any(f" {' '.join(map(str, b))} " in f" {t} " for b in bench)}
            assert not exact & ids and len(rows) - len(ids) <= len(exact) + 2
        elif name == "packing":
            assert ids == set(rows)
        else:
            assert 0.5 * len(rows) < len(ids) < len(rows)
        if name != "packing":
            assert after.columns == docs.columns
            rows = {i: t for i, t in rows.items() if i in ids}
            docs = after
