"""The corpus operators against brute force on small texts with the awkward cases in them."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from woodlot.llm import bpe, decontaminate, exchange, katz_lm, line_dedup, near_dups, quality_knn, quality_rules, substrings, token_counts, tokenizer, toxicity_cnn

TABLES = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words string, ids string, score string, coverage string"


def _texts() -> list:
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split()
    near[60] = "changed"
    out = [None, "", "  \n\t ", "one", base, base, base + " ", " ".join(near), base.upper(), prose(30) + " " + passage, passage + "\n" + prose(40), prose(3000), "x" * 9000, "<|endoftext|>ab<|endoftext|>", "é" * 60 + " naïve ŝ 漢字 🙂   it's 1234", "\x1c a\x1fb \x85", "same words again and over " * 30]
    out += [prose(rng.randint(1, 90)) + ("\nboiler plate line here\n" if i % 2 else "\n") + prose(8) for i in range(30)]
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i % 7 == 3 else f"s{i % 2}", "a", "b", "c", "d") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def twice(docs):
    return docs.union(docs)


# ---- tokens


@pytest.fixture(scope="module")
def library():
    return tokenizer.codec(tokenizer.default_path()).library


def test_libraries_agree_on_safe_characters(library):
    c = tokenizer.codec(tokenizer.default_path())
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and not tokenizer._UNSAFE.search(chr(i))]
    assert len(chars) > 30_000
    texts = [f"a{x}1{x} {x}{x}! {x}b  {x}2 {x}.{x} " for x in chars]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert c.encode(t) == e.ids and [i for p in c.parts(t) for i in c.piece(p.encode())] == e.ids


def test_tree_encoding_is_exact():
    c = tokenizer.codec(tokenizer.default_path())
    one, rng = c.fast._encode_single_piece, random.Random(2)
    for _ in range(200):
        alphabet = rng.choice(["ab", "a", "abcdefghijklmnopqrstuvwxyz", "the", "éèà", "01", "=-"])
        raw = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 1500))).encode()
        assert tokenizer.tree_encode(raw, one, c.all_bytes, leaf=rng.choice([1, 2, 5, 33, 200])) == one(raw)


def test_long_texts_are_trees(library):
    """Cuts anywhere, in safe and other texts: ids are the library's, and the tables' longest texts do take the tree."""
    c, rng = tokenizer.codec(tokenizer.default_path()), random.Random(3)
    parts = [" ", "  ", "a", "bc", "\n", "'s", "1", "!!", "<|endoftext|>", "é", "漢", "\t", " word", "\x1c", "qqqqqqqq"]
    for _ in range(200):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        want = library.encode(t, add_special_tokens=False).ids
        for leaf in (1, 3, 20, 100):
            assert c.encode_tree(t, c.safe(t), leaf).tolist() == want, t
    if os.path.exists(f"{TABLES}/documents.parquet"):
        longest = sorted((t for t in pq.read_table(f"{TABLES}/documents.parquet").column("text").to_pylist() if t), key=len)[-8:]
        for t in longest:
            assert c.encode(t) == library.encode(t, add_special_tokens=False).ids and (c.leaves >= len(t) / tokenizer.LEAF_TEXT > 2 or len(t) <= 2 * tokenizer.LEAF_TEXT)
        assert c.leaves > 1


def test_bpe_against_the_library(docs, library, empty, twice):
    for r in bpe.digests(docs).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty).count() == 0 and bpe.digests(twice).count() == 2 * len(TEXTS)
    coded = bpe.decode(bpe.encode(docs))
    assert coded.columns == ["doc_id", "text", "source", "n_words", "score", "coverage", "ids", "decoded"]
    assert coded.where("decoded <> coalesce(text, '')").count() == 0
    both = bpe.round_trip(docs.drop("score").withColumn("n_leaves", F.lit("x")))
    assert both.columns == ["doc_id", "text", "source", "n_words", "coverage", "ids", "decoded", "n_leaves"]
    assert both.select("doc_id", "ids", "decoded").exceptAll(coded.select("doc_id", "ids", "decoded")).count() == 0
    assert {r.doc_id for r in both.where("n_leaves > 1").collect()} == {i for i, t in enumerate(TEXTS) if len(t or "") > 2 * tokenizer.LEAF_TEXT and not t.startswith("xxx")}


def test_counts_against_the_library(docs, library, empty):
    for width in (token_counts.WIDTH, 3):
        got = token_counts.count_tokens(docs, width=width, limit=50).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            t = TEXTS[r.doc_id] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 50)
    assert token_counts.count_tokens(empty).count() == 0


def test_counts_with_nul_and_a_long_run(spark, library):
    rng = random.Random(5)
    texts = ["the a\0 of the cat\0 of \0\0 a cat"] * 3 + ["a cat of the cat", "".join(rng.choice("qzxjkvw") for _ in range(150_000)), "without an id"]
    rows = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows).collect()}
    assert max(map(len, token_counts.frequent(rows))) <= token_counts.LONGEST
    want = {None if i == 5 else i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert got == want and want[4] > 65_535


def test_frequent_summary_is_bounded():
    counts = Counter({str(i): i for i in range(100)})
    small = token_counts.shrink(counts, 10)
    assert len(small) <= 10 and set(small) == {str(i) for i in range(90, 100)}


# ---- rules and lines


def _register(docs):
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": list(range(len(TEXTS))), "text": TEXTS, "source": [None if i % 7 == 3 else f"s{i % 2}" for i in range(len(TEXTS))]}))
    return c


def test_quality_rules(docs, empty, twice):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, share=0.2, min_docs=3).collect()}
    lines = Counter()
    for i, t in enumerate(TEXTS):
        host = None if i % 7 == 3 else f"s{i % 2}"
        for x in {" ".join(WORD.findall(x)).lower() for x in (t or "").split("\n")} - {""}:
            lines[host, x] += 1
    pages = Counter(None if i % 7 == 3 else f"s{i % 2}" for i in range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        t, host = t or "", None if i % 7 == 3 else f"s{i % 2}"
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(grams)
        inside = {j for k, g in enumerate(grams) if many[g] > 1 for j in range(k, k + 8)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        left = sum(len(WORD.findall(x)) for x in t.split("\n") if lines[host, " ".join(WORD.findall(x)).lower()] <= max(3, 0.2 * pages[host]))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_words_left) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(inside), left), i
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and r.kept == (not r.base_failed and left >= 0.3 * len(w))
    assert quality_rules.apply_rules(empty).count() == 0 and quality_rules.apply_rules(twice).count() == 2 * len(TEXTS)


def test_line_dedup(docs, empty):
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs).collect()}
    want = _register(docs).sql(line_dedup.SQL).fetchall()
    assert len(want) == len(got)
    for doc_id, source, text, n_lines, n_dropped in want:
        r = got[doc_id]
        assert (r.text, r.source, r.n_lines, r.n_dropped) == (text, source, n_lines or 0, n_dropped or 0)
    assert sum(r.n_dropped for r in got.values()) > 5 and got[0].text is None
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_line_tables_beyond_the_broadcast_bound(docs, monkeypatch):
    from woodlot.llm import site_lines

    a = line_dedup.drop_boilerplate(docs).select("doc_id", "text")
    monkeypatch.setattr(site_lines, "BROADCAST_BYTES", -1)
    b = line_dedup.drop_boilerplate(docs).select("doc_id", "text")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# ---- classifiers


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(160):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 60))]
        bad, toxic = i % 3 == 0, i % 4 == 1
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "vilewords", "vilewordish"]))
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "l", "s"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, "l", "s"), (1001, "", "l", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("op", "label", "at"), [(quality_knn, "quality", 0.3), (toxicity_cnn, "toxic", 0.5)])
def test_classifiers_on_held_out_texts(judged, op, label, at):
    docs, labels = judged
    got = {r.doc_id: r for r in op.verdicts(docs, labels).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= at) for r in got.values()) and len(got) == 162
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.85 * len(held)
    # labels of held-out rows are never read
    other = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in op.verdicts(docs, other).collect()}
    assert all(again[i] == got[i].score for i in got)


@pytest.mark.parametrize("op", [quality_knn, toxicity_cnn])
def test_classifiers_without_labels_and_rows(judged, op):
    docs, labels = judged
    assert {r.score for r in op.verdicts(docs, labels.limit(0)).collect()} == {0.5}
    assert op.verdicts(docs.limit(0), labels).count() == 0
    odd = docs.limit(3).withColumn("score", F.lit("x"))
    assert dict(op.score(odd, op.fit(docs, labels)).dtypes)["score"] == "double"


def test_convolution_gradient_paths():
    """Scores of whole texts do not depend on their neighbours in a batch."""
    texts = ["a b vile c", "d", "", "e f g vile"]
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    idx, per, lang = toxicity_cnn.tokens(raw, offsets)
    m = toxicity_cnn.train(np.tile(idx, (10, 1)), np.tile(per, 10), np.tile(lang, 10), np.tile([1.0, 0, 0, 1], 10).astype(np.float32))
    whole = m.raw_score(idx, per)
    at = np.concatenate([[0], np.cumsum(per)])
    assert np.allclose(whole, [m.raw_score(idx[a:b], per[k : k + 1])[0] for k, (a, b) in enumerate(zip(at[:-1], at[1:]))], atol=1e-5)


# ---- language model


def test_katz_against_definition(docs, empty, twice):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    toks = {i: WORD.findall((t or "").translate(low)) + ["</s>"] for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c1, c2 = Counter(), defaultdict(Counter)
    for i, w in toks.items():
        if not held[i]:
            c1.update(w)
            for a, b in zip(["<s>", *w[:-1]], w):
                c2[a][b] += 1
    n, v = sum(c1.values()), len(c1)
    count = lambda c: katz_lm.discounts(np.array([0, *[Counter(c)[r] for r in range(1, 7)]]))
    d1, d2 = count(c1.values()), count([x for c in c2.values() for x in c.values()])
    d = lambda table, c: table[c] if c <= 5 else 1.0
    freed = sum((1 - d(d1, c)) * c for c in c1.values())
    below = n if freed > 0 else n + 1
    p1 = lambda w: d(d1, c1[w]) * c1[w] / below if w in c1 else (freed if freed > 0 else 1) / below
    assert abs(sum(map(p1, c1)) + p1("?") - 1) < 1e-9

    def p2(h, w):
        c = c2.get(h)
        if not c:
            return p1(w)
        free = sum((1 - d(d2, x)) * x for x in c.values())
        low_ = sum(c.values()) + (free <= 0)
        return d(d2, c[w]) * c[w] / low_ if w in c else (free if free > 0 else 1) / low_ / (1 - sum(map(p1, c))) * p1(w)

    for h in list(c2)[:20]:
        assert abs(sum(p2(h, w) for w in c1) + p2(h, "?") - 1) < 1e-9
    got = katz_lm.score_texts(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        w = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in c1 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *w[:-1]], w)), rel=1e-9)
    assert katz_lm.score_texts(empty).count() == 0
    assert katz_lm.score_texts(twice).first().train_tokens == 2 * n


def test_katz_pieces_of_frequent_contexts_change_nothing(docs, monkeypatch):
    a = {r.doc_id: r.score for r in katz_lm.score_texts(docs).collect()}
    monkeypatch.setattr(katz_lm, "SPLIT_AT", 5)
    b = {r.doc_id: r.score for r in katz_lm.score_texts(docs).collect()}
    assert all(a[i] == pytest.approx(b[i], rel=1e-12) for i in a)


# ---- substrings


def _removed(texts: dict) -> dict:
    seen, out = {}, {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            seen.setdefault(texts[i][p : p + 50], i)
    for i, raw in texts.items():
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if seen[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = (len(raw), sum(gone), sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 0])
def test_substrings_against_all_windows(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    want = _removed({i: (t or "").encode() for i, t in enumerate(TEXTS)})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000
    assert substrings.digests(empty).count() == 0


def test_substrings_without_ids_and_of_one_id(spark):
    """A row without doc_id keeps all; rows of one doc_id do not remove from each other."""
    a = "the same sixty bytes stand in every one of these rows, word by word, to the end"
    rows = [(None, a), (3, a), (3, "x" + a), (5, a + "y"), (None, None)]
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans) for r in substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(a)
    assert got == [(0, 0, 0, 0), (0, n, 0, 0), (3, n, 0, 0), (3, n + 1, 0, 0), (5, n + 1, n, 1)]


def test_substring_buckets_are_even_and_judged_in_parts(monkeypatch):
    """No bucket has far more than its share, every run of an anchor counts towards HOT, and parts change nothing."""
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, 300_000).astype(np.uint8)
    runs = substrings._runs(raw, np.arange(0, len(raw) + 1, 3000))
    share = np.bincount(exchange.bucket_of(runs["key"], 50), minlength=50) / len(runs["key"])
    assert 0.01 < share.min() and share.max() < 0.03
    runs = substrings._runs(np.tile(raw[:50], 300), np.arange(0, 15_001, 50))
    assert substrings._anchors(runs, np.arange(300))[1].tolist() == [300]
    sizes = []
    smaller = substrings._smaller
    monkeypatch.setattr(substrings, "_smaller", lambda n, *rest: sizes.append(len(rest[-1])) or smaller(n, *rest))
    monkeypatch.setattr(substrings, "PART_BYTES", 300)
    texts = [t.encode() for t in TEXTS if t]
    blobs = []
    for chunk, some in enumerate((texts[::2], texts[1::2])):
        raw = np.frombuffer(b"".join(some), np.uint8)
        runs = substrings._runs(raw, np.cumsum([0, *map(len, some)]))
        start, n = runs["start"], runs["n"]
        blobs.append((chunk, exchange.pack(n.astype(np.uint64), (runs["anchor"] - start).astype(np.uint64), runs["row"] * 2 + chunk, substrings.ragged(raw, start, n + 49))))
    in_parts = substrings._judge(blobs)
    assert len(sizes) > 20
    monkeypatch.setattr(substrings, "PART_BYTES", 1 << 30)
    del sizes[:]
    whole = substrings._judge(blobs)
    assert len(sizes) == 1 and all((a == b).all() for a, b in zip(in_parts, whole)) and any(x.any() for x in whole)


def test_suffix_sort_orders_and_groups():
    rng = random.Random(1)
    text = np.frombuffer(("".join(rng.choice("ab") for _ in range(400)) * 2 + "c" * 80).encode(), np.uint8)
    at = np.arange(len(text) - 49)
    order, heads = substrings.equal_windows(text, at, np.zeros(len(at), np.uint64))
    windows = [text[i : i + 50].tobytes() for i in order]
    assert windows == sorted(windows)
    assert [windows[i] for i in heads] == sorted(set(windows))


# ---- decontamination


def test_decontamination(spark, empty):
    items = [(0, "If Alice buys 12 apples for 30 dollars and Bob takes 12 apples how much money remains in the old box"), (1, "short one"), (2, None), (3, "quiet rivers carry soft stones under bridges while the green valley sleeps through a long winter night")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        "intro words here " + items[0][1] + " and more",
        "intro words If Carol buys 45 apples for 99 dollars and Dave takes 45 apples how much money remains in the old box end",
        "intro words If Carol buys 45 apples for 99 dollars and Dave takes 71 apples how much money remains in the old box end",
        "quiet rivers carry soft stones and nothing else that would matter to anyone here", items[3][1].upper(), None, "", "12 30 45 12 30 45 " * 40,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    got = {r.doc_id: r for r in decontaminate.flag(docs, bench).collect()}
    assert [got[i].contaminated for i in range(len(texts))] == [True, True, False, False, True, False, False, False]
    assert got[0].item_id == 0 and got[4].item_id == 3 and got[0].coverage >= 0.8 and got[5].coverage is None
    assert decontaminate.flag(empty, bench).count() == 0 and decontaminate.flag(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.flag(docs.union(docs), bench).where("contaminated").count() == 6


ITEMS = [
    (0, "Tom has 3 red apples. Tom buys 5 more apples at the shop. How many apples does Tom have now?"),
    (1, "What is the capital of France?"),
    (2, "A farmer sold 2 apples and 2 pears to each child who came by on market day"),
    (3, "first text of item three has quite other words than the rest"), (3, "second text of item three speaks about rivers and bridges in winter"),
    (4, "Blue whale"), (5, "12 + 15 = 27"), (6, None), (7, "?!"),
    (8, "Alice walked to the mill. Bob sold a small horse. Carol paid the old miller. Dave counted every silver coin."),
]
CASES = [
    ("Mary has 8 red apples. Mary buys 9 more apples at the shop. How many apples does Mary have now?", 0),
    ("tom has 3 red apples. tom buys 5 more apples at the shop. how many apples does tom have now?", 0),
    ("Question 12\nWhat is the capital of France?", 1), ("he asked: \"WHAT IS THE CAPITAL OF FRANCE\" and left", 1),
    ("A farmer sold 4 apples and 7 pears to each child who came by on market day", 2),
    ("so First text of item three has quite other words than the rest, he said", 3), ("the second text of item three speaks about rivers and bridges in winter", 3),
    ("words\n - Blue whale!\nwords", 4), ("a blue whale swam", None), ("x\n12 + 15 = 27\ny", 5), ("12 + 15 = 28", None),
    ("Erik walked to the mill. Fritz sold a small horse. Gerda paid the old miller. Heinz counted every silver coin.", 8),
    ("It is a capital idea of France", None), ("", None), (None, None), ("?!", None), ("x0 km 3 km. Tom's 5 kg", None),
]


def test_decontamination_cases(spark):
    """Names anywhere, other case, one number in two slots, several texts of an item, short items, rows without doc_id; as the SQL says."""
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(None if i % 3 == 0 else i // 2, t) for i, (t, _) in enumerate(CASES)]
    got = [(r.doc_id, r.text, r.contaminated, r.item_id, r.coverage) for r in decontaminate.flag(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()]
    assert sorted(map(repr, [(t, i) for _, t, _, i, _ in got])) == sorted(map(repr, CASES))
    assert all(c == (i is not None) for _, _, c, i, _ in got)
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": [t for _, t in rows]}))
    c.register("benchmark", pa.table({"item_id": [i for i, _ in ITEMS], "text": [t for _, t in ITEMS]}))
    assert sorted(map(repr, c.sql(decontaminate.SQL).fetchall())) == sorted(repr((d, k, i, v)) for d, _, k, i, v in got)


def test_decontamination_marks(spark, monkeypatch):
    """Texts without a mark are not hashed; none of them holds an item, and hashing all of them changes nothing."""
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    items = decontaminate.item_windows(decontaminate.item_tokens(bench))
    words = decontaminate.marks(items)
    unmarked, n = Counter(), {}
    for r in items.collect():
        n[r.item_id, r.v, r.a] = r.n
        unmarked[r.item_id, r.v, r.a] += not set(r.t) & set(words)
    assert all(unmarked[k] < n[k] * decontaminate.SHARE for k in n) and len(words) < len(n) * 2
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    marked = {r.doc_id for r in docs.where(decontaminate._marked(F.coalesce("text", F.lit("")), words)).collect()}
    assert {i for i, (_, item) in enumerate(CASES) if item not in (None, 4, 5)} <= marked
    assert not marked & {i for i, (t, _) in enumerate(CASES) if t in ("", None, "?!", "a blue whale swam", "x0 km 3 km. Tom's 5 kg")}
    verdicts = lambda: sorted(map(repr, decontaminate.flag(docs, bench).collect()))
    some = verdicts()
    monkeypatch.setattr(decontaminate, "MARKS", 0)
    assert decontaminate.marks(items) is None and verdicts() == some
    monkeypatch.setattr(decontaminate, "MARKS", 9)
    digits = spark.createDataFrame([(1, "x1a x2b x3c x4d x5e x6f x7g")], "item_id long, text string")
    assert decontaminate.marks(decontaminate.item_windows(decontaminate.item_tokens(digits))) is None
    assert [r.contaminated for r in decontaminate.flag(digits.select("text"), digits).collect()] == [True]


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    bench = spark.createDataFrame([(3, "quiet rivers carry soft stones under bridges while the green valley sleeps")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so quiet rivers carry soft stones under bridges while the green valley sleeps now"), (2, "nothing")], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert [r.doc_id for r in decontaminate.flag(docs, bench).where("contaminated").collect()] == [1]


# ---- near-duplicates


def _shingles(t):
    w = WORD.findall(t or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _classes(texts: dict) -> dict:
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = {i: _shingles(t) for i, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b:
                both = sum((s[a] & s[b]).values())
                if (texts[a] or "") == (texts[b] or "") or both and both >= 0.8 * (s[a].total() + s[b].total() - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates_against_all_pairs(docs, empty, twice):
    want = _classes(dict(enumerate(TEXTS)))
    assert {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()} == want
    assert near_dups.classes(empty).count() == 0
    assert {r.doc_id: r.class_id for r in near_dups.classes(twice).collect()} == want
    kept = near_dups.dedupe(twice)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_chains_and_mixed_buckets(spark, monkeypatch):
    """Texts linked only through others, with few pivots a round and every pair decided exactly."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts, now = {}, [rng.choice(words) for _ in range(80)]
    for i in range(24):
        texts[i] = " ".join(now)
        now[rng.randrange(len(now))] = rng.choice(words)
        if i % 6 == 5:
            now = now[:50] + [rng.choice(words) for _ in range(30)]
    monkeypatch.setattr(near_dups, "PIVOTS", 1)
    got = near_dups.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == _classes(texts)


def test_every_pair_of_a_large_bucket_is_tested(spark, monkeypatch):
    """A family and pairs of strangers to it in one bucket: once the family is linked, all pairs are still tested."""
    rng = random.Random(9)
    prose = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    base, pairs = prose(), [prose() for _ in range(40)]
    texts = {i: p for i, p in enumerate(pairs)}
    texts.update({40 + i: f"{base} f{i}" for i in range(200)})
    texts.update({240 + i: p + " again" for i, p in enumerate(pairs)})
    sketch = near_dups._sketch
    monkeypatch.setattr(near_dups, "_sketch", lambda df: sketch(df).withColumn("bands", F.array(F.lit(1).cast("long"))))
    got = near_dups.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    want = _classes(texts)
    assert {r.doc_id: r.class_id for r in got.collect()} == want and len(set(want.values())) == 41


def test_chains_in_one_bucket(spark, monkeypatch):
    """Chains of texts, each like its next alone, all in one bucket and few pivots a round: the classes of all pairs."""
    rng = random.Random(12)
    texts = {}
    for _ in range(2):
        now = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(110):
            texts[len(texts)] = " ".join(now)
            now[rng.randrange(len(now))] = f"w{rng.randrange(5000)}"
    order = list(texts)
    rng.shuffle(order)
    texts = {i: texts[k] for i, k in enumerate(order)}
    sketch = near_dups._sketch
    monkeypatch.setattr(near_dups, "_sketch", lambda df: sketch(df).withColumn("bands", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(near_dups, "PIVOTS", 70)
    got = near_dups.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), exact=True)
    want = _classes(texts)
    assert {r.doc_id: r.class_id for r in got.collect()} == want and len(set(want.values())) == 2


def test_doc_ids_with_several_texts(spark):
    """Texts of one doc_id are one class, and so is whatever is like any of them."""
    rng = random.Random(13)
    prose = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(90))
    a, b, c, d = prose(), prose(), prose(), prose()
    rows = [(1, a), (1, b), (1, a), (2, c), (3, b + " more"), (4, c), (5, c), (5, d), (6, d + " x"), (7, prose()), (None, a), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.class_id) for r in near_dups.classes(docs).collect())
    assert got == [(0, None), (0, None), (1, 1), (2, 2), (3, 1), (4, 2), (5, 2), (6, 2), (7, 7)]
    kept = [(r.doc_id, r.text) for r in near_dups.dedupe(docs).collect()]
    assert sorted(x[0] or 0 for x in kept) == [0, 0, 1, 2, 7]
    assert dict(kept)[1] == min((a, b), key=lambda t: hashlib.md5(t.encode()).hexdigest())


def test_recall_on_the_tables(spark):
    """Links of all pairs that share a shingle, decided exactly, against the classes: none is lost, none is invented."""
    path = TABLES.replace("sf0.1", "sf0.001") + "/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()}
    assert {r.doc_id: r.class_id for r in near_dups.classes(spark.read.parquet(path)).collect()} == _classes(texts)


def test_signatures_estimate_weighted_similarity():
    a, b = "a b c d e f g h i j " * 3 + "k l m n o p", "a b c d e f g h i j " * 2 + "k l m n o p q r s t"
    raw, offsets = np.frombuffer((a + b).encode(), np.uint8), np.array([0, len(a), len(a) + len(b)])
    unit, per = near_dups.units(raw, offsets)
    sig = near_dups.signatures(unit, per, 4000)
    x, y = _shingles(a), _shingles(b)
    both = sum((x & y).values())
    assert per.tolist() == [x.total(), y.total()] and not np.isinf(sig).any()
    assert abs((sig[0] == sig[1]).mean() - both / (x.total() + y.total() - both)) < 0.03


def test_rows_without_id_stay(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (2, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in near_dups.dedupe(docs).collect()) == [0, 0, 1]
