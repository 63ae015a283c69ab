"""The operators against brute force on given tables and on small hard cases."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placebook.llm import (
    chat,
    chunk_dedup,
    decontaminate,
    html_text,
    language,
    order_minhash,
    packing,
    perplexity,
    token_store,
    tokens,
    url_rules,
    word_model,
)
from placebook.llm.queries import ORACLES, QUERIES
from placebook.session import fresh_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, version int, row string, row_id long, starts string"


def documents(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    full = [(i, t, "en", "s", len(t or ""), 7, "row", 8, "x") for i, t in rows]
    return spark.createDataFrame(full, DOC)


HARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (4, "one"),
    (4, "two words"),
    (5, "a  b   c \n \n d\n\n\ne \t f"),
    (6, "é" * 300 + " 漢字 \U0001f600 x"),
    (7, " ".join(f"w{i % 977}" for i in range(30000))),
    (None, "no id here"),
    (8, "x <|endoftext|> y</s>"),
]


@pytest.fixture(scope="module")
def corpus():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


# --- tokens


def test_encoder_equals_whole_texts(corpus, tokenizer):
    own = tokens.Encoder(tokens.default_tokenizer())
    hard = [t or "" for _, t in HARD] + ["don't\n we'll", "a \n b", "\n", " ", "  ", "x ", " x", "a\u00a0 b", "tail\n "]
    texts = [*hard, *corpus.text, *hard]
    for text, data in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_remembers_and_forgets(monkeypatch, tokenizer):
    """Ids are those of whole texts whatever is forgotten; what comes in every call is learned once."""
    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    own, learned = tokens.Encoder(tokens.default_tokenizer()), []
    learn = own._learn
    own._learn = lambda words: (learned.extend(words), learn(words))
    for i in range(40):
        texts = [f"always the same\nsame. words{i}, {chr(97 + i % 26) * (i + 1)} é{i}!\n\nnew \n x{i}", f" {i}", "", f"a{i}  b\n c"]
        ids, sizes = own.encode_all(pa.array(texts), 0)
        assert ids.tolist() == [x for t in texts for x in ids_of(tokenizer, t).tolist()]
        assert sizes.tolist() == [len(ids_of(tokenizer, t)) for t in texts]
        assert len(own.chunks) < 100
    assert learned.count(" the") == 1 and learned.count(".") == 1


def test_encoder_cuts_where_the_pattern_does(tokenizer):
    own, draw = tokens.Encoder(tokens.default_tokenizer()), np.random.default_rng(7)
    parts = ["a", "Word", "é", "ß", "7", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2028", "\u3000", "'", "'s", "'ll", ".", ",!!", "$$$", "<|endoftext|>", "<|", "|>", "end", "中文", "🙂", "\x1c", "\u0301", "_", "-"]
    for _ in range(60):
        texts = ["".join(draw.choice(parts, draw.integers(0, 12))) for _ in range(50)]
        for text, data in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check_store(result, rows, tokenizer):
    start = 0
    for got, (doc_id, text) in zip(result, rows, strict=True):
        ids = ids_of(tokenizer, text)
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_store(spark, corpus, tokenizer):
    result = QUERIES["op3_token_orc"](spark, SF).orderBy("start").collect()
    check_store(result, list(zip(corpus.doc_id, corpus.text, strict=True)), tokenizer)


def test_token_store_hard_cases(spark, tokenizer):
    rows = [(i, t) for i, t in HARD if i not in (4, None)]
    check_store(token_store.stored_digest(documents(spark, rows)).orderBy("start").collect(), rows, tokenizer)
    assert len(token_store.stored_digest(documents(spark, HARD)).collect()) == len(HARD)
    assert token_store.stored_digest(documents(spark, [])).collect() == []


def test_token_store_reads_by_id(spark, corpus):
    path = fresh_path(spark, "tokens")
    token_store.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), path)
    one = token_store.read_tokens(spark, path).where("doc_id = 3")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1


# --- packing


def check_packed(pieces, rows, tokenizer, window=1024):
    texts = Counter((i, zlib.crc32(ids_of(tokenizer, t).tobytes())) for i, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for (doc_id, _), n in texts.items():
        if n == 1 and sum(d == doc_id for d, _ in texts) == 1:
            own = sorted(by_doc[doc_id], key=lambda p: p.start)
            ids = ids_of(tokenizer, next(t for i, t in rows if i == doc_id))
            assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
            assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
    lengths = []
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        lengths.append(sum(p.length for p in own))
    assert sum(lengths) == sum(len(ids_of(tokenizer, t)) for _, t in rows)
    assert all(x == window for x in sorted(lengths)[1:]) and max([0, *lengths]) <= window


def test_packing(spark, corpus, tokenizer):
    check_packed(QUERIES["op7_packing"](spark, SF).collect(), list(zip(corpus.doc_id, corpus.text, strict=True)), tokenizer)


def test_packing_hard_cases(spark, tokenizer):
    check_packed(packing.packed_pieces(documents(spark, HARD)).collect(), HARD, tokenizer)
    assert packing.packed_pieces(documents(spark, [])).collect() == []


def test_plan_uses_each_tail_once():
    rng = np.random.default_rng(5)
    histogram = np.zeros(65, np.int64)
    histogram[1:64] = rng.integers(0, 40, 63)
    plan = packing.plan_windows(histogram, 64)
    filled = Counter()
    for length in range(1, 64):
        ranks = rng.permutation(histogram[length])
        _, start, size, sequence, offset = packing.place(plan, length, ranks)
        assert size.sum() == length * histogram[length]
        for s, o, n in zip(sequence.tolist(), offset.tolist(), size.tolist(), strict=True):
            filled[s] += n
            assert 0 <= o and o + n <= 64
    assert sorted(filled.values())[1:] == [64] * (len(filled) - 1)
    assert plan.n_sequences > 0.5 * len(filled)  # most windows come from combinations, uncut


# --- near duplicates


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def classes_of(rows, links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in rows}


def brute_links(rows):
    grams = {i: Counter() for i in rows}
    index = defaultdict(set)
    for i, text in rows.items():
        for g in shingle_set(text):
            index[g].add(i)
    shared = Counter()
    for own in index.values():
        own = sorted(own)
        for x, a in enumerate(own):
            for b in own[x + 1 :]:
                shared[a, b] += 1
    del grams
    sizes = {i: len(shingle_set(t)) for i, t in rows.items()}
    score = {p: n / (sizes[p[0]] + sizes[p[1]] - n) for p, n in shared.items()}
    return score


def test_near_duplicates_match_brute_force(spark):
    frame = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    rows = dict(zip(frame.doc_id, frame.text, strict=True))
    score = brute_links(rows)
    got = {r.doc_id: r.class_id for r in QUERIES["op1_order_minhash"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(rows)
    sure = [p for p, s in score.items() if s >= 0.83]
    missed = [p for p in sure if got[p[0]] != got[p[1]]]
    assert not missed
    loose = classes_of(rows, [p for p, s in score.items() if s >= 0.78])
    assert all(loose[i] == loose[c] for i, c in got.items())


def test_near_duplicates_hard_cases(spark):
    got = sorted(((r.doc_id, r.class_id) for r in order_minhash.near_duplicates(documents(spark, HARD)).collect()), key=str)
    assert len(got) == len(HARD)
    assert (1, 1) in got and (None, None) in got and got.count((4, 4)) == 3
    assert (2, 2) in got and (3, 3) in got
    assert order_minhash.near_duplicates(documents(spark, [])).collect() == []


def test_near_duplicates_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        own = list(base)
        own[rng.integers(0, 200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"v{x}" for x in rng.integers(0, 5000, 150))) for i in range(50)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(documents(spark, rows)).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(50))
    kept = order_minhash.one_per_class(documents(spark, rows), order_minhash.classified(documents(spark, rows)))
    assert kept.columns == documents(spark, []).columns and kept.count() == 51


def test_one_per_class_keeps_different_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (6, b), (3, a), (7, c), (7, c), (8, None), (8, None), (None, c), (None, c), (None, None)]
    docs = documents(spark, rows)
    classes = order_minhash.classified(docs)
    assert sorted(((r.doc_id, r.class_id) for r in classes.collect()), key=str) == sorted(
        [(5, 3), (5, 5), (5, 5), (6, 5), (3, 3), (7, 7), (7, 7), (8, 8), (8, 8), (None, 7), (None, 7), (None, None)], key=str)
    kept = order_minhash.one_per_class(docs, classes)
    want = [(5, b), (3, a), (7, c), (8, None), (None, c), (None, c), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_near_duplicates_in_large_mixed_buckets(spark):
    # Few sketches and one minimum: template texts share large buckets, and many near pairs
    # share no second sketch by which a split could bring them together.
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [*base, *(f"a{i}-{j}" for j in range(60))]
        rows.append((2 * i, " ".join(own)))
        other = list(own)
        for at in rng.choice([70, 77, 84, 91, 98, 105, 112], 2, replace=False):
            other[at] = f"b{i}-{at}"
        rows.append((2 * i + 1, " ".join(other)))
    texts = spark.createDataFrame(rows, "id long, text string")
    sketched = {r.id: r.sketches for r in order_minhash.sketches_of(texts, sketches=2, minima=1).collect()}
    sizes = Counter(v for own in sketched.values() for v in own)
    agree = [set(sketched[2 * i]) & set(sketched[2 * i + 1]) for i in range(150)]
    only_large = [i for i, own in enumerate(agree) if own and all(sizes[v] > order_minhash.SMALL_BUCKET for v in own)]
    assert any(len(agree[i]) == 1 for i in only_large)
    got = {r.id: r.component for r in order_minhash.near_links(texts, sketches=2, minima=1).collect()}
    assert [i for i in range(150) if agree[i] and (2 * i not in got or got[2 * i] != got[2 * i + 1])] == []
    assert all(got[i] // 2 == i // 2 for i in got)


def test_alignment_respects_order():
    words = [f"w{i}" for i in range(60)]
    swapped = words[30:] + words[:30]
    pair = lambda a, b: order_minhash.alignment_similarity(pa.array([" ".join(a)]), pa.array([" ".join(b)]), 5, 0.1)[0]
    assert pair(words, words) == 1
    assert pair(words, swapped) < 0.4
    assert pair(words, [*words[:20], "new", *words[20:]]) == pytest.approx(52 / 61)


# --- conversations


def chat_expected(turns):
    out = {}
    for conv, own in turns.groupby("conv_id", dropna=False):
        own = own.sort_values("turn")
        pairs = [(r or "", t or "") for r, t in zip(own.role, own.text, strict=True)]
        loss = "".join(t for r, t in pairs if r == "assistant")
        out[conv] = (len(pairs), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_windows(spark):
    turns = pd.read_parquet("/root/testdata/sf0.01/conversations.parquet")
    control = pd.DataFrame({"conv_id": [-1, -1], "turn": [0, 1], "role": ["user", "assistant"], "text": ["</s>[INST] ok [/INST]"] * 2})
    expected = chat_expected(pd.concat([turns, control]))
    got = QUERIES["op2_chat_windows"](spark, "/root/testdata/sf0.01").collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected


def test_chat_long_conversation(spark):
    texts = [("system", "be brief")] + [("user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 90)) for i in range(400)]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(texts)] + [(2, 0, None, None, "x"), (2, 1, "assistant", "\\<s\\>[INST]\\\\", "x"), (None, 0, "user", "a", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = chat.windows(frame, budget=256, history_turns=2, history_tokens=100).collect()
    own = sorted((w for w in made if w.conv_id == 1), key=lambda w: w.window)
    assert len(own) > 50 and all(w.n_tokens <= 256 for w in own)
    assert all("be brief" in w.formatted for w in own) and any(w.n_repeated > 1 for w in own)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(spark.createDataFrame(made, chat.WINDOWS)).collect()}
    expected = chat_expected(pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "x"]).astype({"conv_id": "Int64"}))
    assert got[1] == expected[1] and got[2] == expected[2] and len(got) == 3
    assert chat.formatted_digest(frame.limit(0)).collect() == []


def test_chat_windows_keep_their_budget(spark, tokenizer):
    """Tokens are those of the formatted windows; only a turn alone exceeds the budget."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hard = [(-2, i, "user" if i % 2 else "assistant", "</s>[INST] <|im_end|> " * n) for i, n in enumerate([40, 60, 30, 200, 5])]
    hard += [(-3, 0, "system", "s " * 600), (-3, 1, "user", "u " * 900), (-3, 1, "user", "u " * 900), (-3, 2, "<|im_sep|>", "x")]
    frame = turns.unionByName(spark.createDataFrame(hard, "conv_id long, turn long, role string, text string"))
    made = chat.windows(frame).collect()
    over = [w for w in made if w.n_tokens > chat.BUDGET]
    assert all(w.n_tokens == len(tokenizer.encode(w.formatted, add_special_tokens=False).ids) for w in made)
    assert {-2, -3} <= {w.conv_id for w in over}
    assert all(w.formatted.count(chat.START) - w.n_repeated == 1 for w in over) and len(made) > 150


def test_escape_is_reversible():
    for text in ["", "\\", "</s>", "<\\/s>", "\\\\[INST]\\", "<<SYS>>x<</SYS>>", "<|im_end|>\n"]:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


# --- decontamination


def contaminated(docs, items, similarity=0.8):
    def grams(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
        return [tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))] if words else []

    out = set()
    wanted = {i: grams(t) for i, t in items.items()}
    for doc, text in docs.items():
        own = grams(text)
        held = set(own)
        for item, need in wanted.items():
            if not held & set(need):
                continue
            n = len(need)
            for s in range(max(len(own) - n, 0) + 1):
                window = own[s : s + n]
                o = sum((Counter(window) & Counter(need)).values())
                if window and o / (len(window) + n - o) >= similarity:
                    out.add((doc, item))
                    break
    return out


def test_decontamination_matches_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = pd.read_parquet(f"{folder}/documents.parquet"), pd.read_parquet(f"{folder}/benchmark.parquet")
    expected = contaminated(dict(zip(docs.doc_id, docs.text, strict=True)), dict(zip(items.item_id, items.text, strict=True)))
    got = QUERIES["op4_simhash_decontamination"](spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and expected


def test_decontamination_hard_cases(spark):
    rng = np.random.default_rng(11)
    item = [f"q{x}" for x in rng.integers(0, 900, 60)]
    fill = lambda n: [f"f{x}" for x in rng.integers(0, 900, n)]
    edited = [*item[:20], *item[21:]]
    rows = [*HARD, (20, " ".join([*fill(90), *item, *fill(40)])), (21, " ".join(item).upper()), (22, " ".join([*fill(30), *edited, *fill(30)])), (23, " ".join(item[:30] + fill(200))), (24, "short item")]
    items = {1: " ".join(item), 2: "short item", 3: " ".join(["same"] * 20)}
    rows.append((25, " ".join(fill(10) + ["same"] * 20 + fill(10))))
    bench = spark.createDataFrame([*items.items(), (4, None), (5, ""), (1, " ".join(item)), (None, "x y z a b c")], "item_id long, text string")
    docs = documents(spark, rows)
    found = decontaminate.matches(docs, bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    single = {i: t for i, t in rows if i is not None and t is not None and i != 4}
    assert got == contaminated(single, items) == {(20, 1), (21, 1), (22, 1), (24, 2), (25, 3)}
    left = decontaminate.clean(docs, found)
    assert left.columns == docs.columns and left.count() == len(rows) - 5
    assert decontaminate.matches(docs.limit(0), bench).collect() == []
    assert decontaminate.matches(docs, bench.limit(0)).collect() == []


def test_decontamination_finds_reordered_items(spark):
    rng = np.random.default_rng(12)
    fill = lambda n: [f"f{x}" for x in rng.integers(0, 9000, n)]
    items, rows = {}, []
    for i, n in enumerate([45, 60, 90, 45]):
        item = [f"q{i}-{x}" for x in rng.integers(0, 900, n)]
        items[i] = " ".join(item)
        third = n // 3
        rows.append((3 * i, " ".join([*fill(50), *item[n // 2 :], *item[: n // 2], *fill(50)])))
        rows.append((3 * i + 1, " ".join([*item[2 * third :], *item[third : 2 * third], *item[:third], *fill(20)])))
        rows.append((3 * i + 2, " ".join([*fill(30), *item[n // 2 :], *item[: n // 2]])))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = contaminated(dict(rows), items)
    assert {(0, 0), (2, 0), (7, 2)} <= expected
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(documents(spark, rows), bench).collect()} == expected


def test_decontamination_of_very_long_items(spark):
    """Counters of the fingerprint hold any number of equal shingles; texts of one id are judged apart."""
    long = " ".join(["same"] * 40_000)
    rows = [(1, long), (2, " ".join(f"w{i}" for i in range(300))), (2, long), (3, "same same")]
    docs, bench = documents(spark, rows), spark.createDataFrame([(7, long)], "item_id long, text string")
    found = decontaminate.matches(docs, bench)
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in found.collect()) == [(1, 7, 1.0), (2, 7, 1.0)]
    assert sorted((r.doc_id, r.text) for r in decontaminate.clean(docs, found).collect()) == [rows[1], rows[3]]


def test_decontamination_is_native(spark):
    plan = QUERIES["op4_simhash_decontamination"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprint_is_simhash(spark):
    values = [[3, 5, -9], [2**62 + 7], list(range(-40, 90, 3)), [5, 5, -1]]
    got = spark.createDataFrame([(v,) for v in values], "s array<long>").select(decontaminate.fingerprint("s").alias("f")).collect()
    for v, row in zip(values, got, strict=True):
        bits = sum((2 * sum((x >> b) & 1 for x in v) > len(v)) << b for b in range(64))
        assert row.f % 2**64 == bits


# --- substring dedup


def test_repeated_passages(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"é{x}" for x in rng.integers(0, 10**6, n))
    passage = fresh(60)
    rows = [(i, f"{fresh(80 + i)} {passage} {fresh(50)}") for i in range(40)] + [(100 + i, fresh(120)) for i in range(60)]
    rows += [(300, None), (301, ""), (302, rows[0][1])]
    docs = documents(spark, rows)
    spans = chunk_dedup.repeated_spans(docs)
    got = spans.collect()
    assert {r.doc_id for r in got} == {*range(40), 302}
    assert {r.doc_id for r in got if r.removed} == {*range(1, 40), 302}
    left = chunk_dedup.remove_repeats(docs, spans)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert len(texts) == len(rows) and texts[0] == rows[0][1] and texts[300] is None and texts[302] == ""
    assert all(texts[100 + i] == t for i, (_, t) in enumerate(rows[40:100]))
    middle = passage[len(passage) // 4 : 3 * len(passage) // 4]
    assert [i for i in range(40) if middle in texts[i]] == [0]
    assert all(len(texts[i]) < len(rows[i][1]) - len(passage) // 3 for i in range(1, 40))


def test_short_word_passages_match_brute_force(spark):
    rng = np.random.default_rng(21)
    fresh = lambda n, low=3, high=5: ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(low, high + 1))) for _ in range(n)]
    texts = {}
    for i in range(200):
        passage = fresh(51 if i < 160 else 50, *((1, 2) if i % 4 == 0 else (3, 5)))
        for j in range(2):
            texts[2 * i + j] = " ".join([*fresh(int(rng.integers(0, 90))), *passage, *fresh(int(rng.integers(0, 90)))])
    shared = fresh(80)
    texts[900], texts[901], texts[902] = (" ".join(x) for x in (shared[:60], shared[20:] + fresh(30), fresh(9) + shared))
    texts[903] = " ".join(["same"] * 150)
    places = defaultdict(list)
    for i, text in texts.items():
        words = text.split()
        for at in range(len(words) - 50):
            places[" ".join(words[at : at + 51])].append((i, at))
    removed, kept = defaultdict(set), defaultdict(set)
    for own in places.values():
        for i, at in own[1:]:
            removed[i] |= {*range(at, at + 51)}
        if len(own) > 1:
            kept[own[0][0]] |= {*range(own[0][1], own[0][1] + 51)}
    docs = documents(spark, list(texts.items()))
    spans = chunk_dedup.repeated_spans(docs)
    assert {r.doc_id for r in spans.collect()} == {*kept, *removed} and {2 * i + 1 for i in range(160)} <= {*removed}
    for r in chunk_dedup.remove_repeats(docs, spans).collect():
        assert r.text.split() == [w for at, w in enumerate(texts[r.doc_id].split()) if at not in removed[r.doc_id] - kept[r.doc_id]]


def test_chunks_resist_insertion():
    rng = np.random.default_rng(2)
    data = rng.integers(32, 127, 4000).astype(np.uint8)
    cut = lambda d: {bytes(d[a:b]) for a, b in zip([0, *chunk_dedup.chunk_ends(d)], chunk_dedup.chunk_ends(d), strict=False)}
    assert len(cut(data) - cut(np.insert(data, 1000, 65))) <= 5
    edges = chunk_dedup.chunk_ends(data)
    assert edges[-1] == 4000 and np.diff([0, *edges]).max() <= chunk_dedup.MOST


def test_repeats_hard_cases(spark):
    docs = documents(spark, HARD)
    spans = chunk_dedup.repeated_spans(docs)
    assert chunk_dedup.remove_repeats(docs, spans).count() == len(HARD)
    assert chunk_dedup.repeated_spans(documents(spark, [])).collect() == []


# --- quality


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(three).items() if n > 1}
    covered = {i + j for i, g in enumerate(three) if g in often for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_quality_base_counts(spark, corpus):
    got = {r.doc_id: r for r in QUERIES["op6_perplexity_bands"](spark, SF).collect()}
    for doc, text in zip(corpus.doc_id, corpus.text, strict=True):
        own = base_counts(text)
        assert tuple(got[doc][n] for n in NAMES) == own
        failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
        assert got[doc].base_failed == failed and not (failed and got[doc].kept)
    sound = [r for r in got.values() if not r.base_failed]
    assert sum(r.kept for r in sound) > 0.9 * len(sound)


def test_quality_rejects_what_the_language_never_looks_like(spark):
    frame = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").query("lang == 'en'")
    rng = np.random.default_rng(1)
    noise = "".join(chr(c) for c in rng.choice([*range(97, 123), *[32] * 5], 4000))
    rows = [*zip(frame.doc_id.tolist(), frame.text, strict=True), (10**6, noise), *((10**7 + (i or 0), t) for i, t in HARD)]
    got = {r.doc_id: r for r in perplexity.quality(documents(spark, rows)).collect()}
    assert not got[10**6].kept and not got[10**6].base_failed and len(got) == len({i for i, _ in rows})
    for i, t in rows:
        if i > 10**6 and i != 10**7 + 4:
            assert tuple(got[i][n] for n in NAMES) == base_counts(t)
    assert perplexity.quality(documents(spark, [])).collect() == []


def test_kneser_ney_sums_to_one():
    keys, _ = perplexity.text_grams(pa.array(["the theory of the other than that", "hat on the mat"]))
    own, counts = np.unique(keys, return_counts=True)
    model = perplexity.estimate(own, counts)
    for context in (own[3] >> 6, own[10] >> 6, np.uint32(12345)):
        following = (np.uint32(context) << np.uint32(6)) + np.arange(64, dtype=np.uint32)
        assert np.exp(perplexity.log_probabilities(model, following)).sum() == pytest.approx(1, abs=1e-4)


def left_out(texts):
    """Mean log probability of each text's words after those before, counted over all others."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    pairs = [Counter(zip([None, *w], w, strict=False)) for w in words]
    n, every, after = sum(map(len, words)), sum(pairs, Counter()), [Counter() for _ in words]
    for own, p in zip(after, pairs, strict=True):
        for (v, _), k in p.items():
            own[v] += k
    ahead = sum(after, Counter())
    logs = []
    for w, p, own in zip(words, pairs, after, strict=True):
        total = sum(k * (np.log(every[x] - k + 1 / n) - np.log(ahead[x[0]] - own[x[0]] + 1)) for x, k in p.items())
        logs.append(total / max(len(w), 1))
    return logs


def test_word_perplexity_is_that_of_all_other_texts(spark, corpus, monkeypatch):
    own = corpus[corpus.lang == "en"].text.tolist()[:60]
    texts = [*own, own[0], None, "", " \n", "one", "one", "é 漢字\tone\none  one"]
    expected = left_out(texts)
    german = [(1000 + i, t, "de") for i, t in enumerate(own)]
    rows = [*((i, t, "en") for i, t in enumerate(texts)), *german, (5000, own[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = {r.doc_id: r for r in perplexity.quality(docs).collect()}
    assert len(whole) == len(rows)
    for i, log in enumerate(expected):
        assert np.log(whole[i].word_perplexity) == pytest.approx(-log, abs=2 / word_model.UNIT)
    # Many ranges, blocks and rounds of sums.
    for name, most in (("BLOCK_WORDS", 2000), ("RANGE_WORDS", 500), ("HELD_TEXTS", 20), ("RANGES_PER_TASK", 4)):
        monkeypatch.setattr(word_model, name, most)
    cut = {r.doc_id: r for r in perplexity.quality(docs).collect()}
    assert cut == whole


def test_quality_rejects_words_in_no_order(spark):
    """The letters and words of the language, shuffled: the model of symbols kept them."""
    rng = np.random.default_rng(1)
    names = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(300)]
    following = rng.integers(0, 300, (300, 4))

    def text(n):
        at, out = int(rng.integers(300)), []
        for _ in range(n):
            out.append(names[at])
            at = int(following[at, rng.integers(4)])
        return out

    texts = [text(int(n)) for n in rng.integers(60, 300, 200)]
    mixed = [list(rng.permutation(t)) for t in texts[:5]]
    copies = [[*texts[9], f"x{i}"] for i in range(100)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *copies, *mixed])]
    got = {r.doc_id: r for r in perplexity.quality(documents(spark, rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[i].kept for i in range(300, 305))
    assert sum(got[i].kept for i in range(300)) > 290
    assert all(r.lower_perplexity <= r.perplexity <= r.upper_perplexity for i, r in got.items() if i >= 300)


# --- language


def test_language(spark):
    folder = "/root/testdata/sf0.01"
    truth = pd.read_parquet(f"{folder}/documents.parquet").set_index("doc_id").lang
    got = QUERIES["op8_language_filters"](spark, folder).toPandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    held = got[got.held_out]
    assert (held.lang_pred == truth[held.index]).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_hard_cases(spark):
    rows = [(i, t, "aa" if i % 2 else "bb") for i, t in enumerate(["xyzzy plugh " * 9, "lorem ipsum dolor " * 9] * 9)]
    docs = spark.createDataFrame([*rows, *[(i, t, None) for i, t in HARD], (50, "12 34!", None), (51, "a", None)], "doc_id long, text string, lang string")
    got = language.predict(docs, language.learn_from(docs)).collect()
    assert len(got) == len(rows) + len(HARD) + 2
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {50} <= none and 51 not in none
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.predict(docs, language.learn_from(docs.where("lang = 'zz'"))).where("lang_pred <> 'und'").isEmpty()
    assert language.identified(docs.limit(0)).collect() == []


def test_filters_answer_for_every_language():
    rng = np.random.default_rng(4)
    sets = {f"l{i:03}": rng.integers(0, 2**32, 300) for i in range(70)}
    filters = language.build_filters(sets, "l000")
    for i, name in enumerate(filters.languages):
        masks = np.full((300, 2), 2**64 - 1, np.uint64)
        for at in language._probes(sets[name]):
            masks &= filters.slots[at]
        assert ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()


# --- urls


def test_url_rules_match_sql(spark):
    for folder in (SF, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
        want = con.sql(ORACLES["op9_url_rules"]).df()
        got = QUERIES["op9_url_rules"](spark, folder).toPandas()[want.columns.tolist()]
        order = lambda d: d.sort_values("page_id").reset_index(drop=True).astype(object).where(lambda x: x.notna(), None)
        pd.testing.assert_frame_equal(order(got), order(want))


URLS = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("example.org/es/1", "", "", None, "allow"),
    ("http://a.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
    ("http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
    ("http://x.com/fra", "x.com", "/fra", None, "allow"),
    ("http://org", "org", "", None, "allow"),
    ("x://y://z/q", "y:", "//z/q", None, "allow"),
    ("http://www.cheap-pills.net/x", "www.cheap-pills.net", "/x", None, "block"),
    ("http://www.cheap-pills.com/fr/", "www.cheap-pills.com", "/fr/", "com/fr/", "allow"),
    ("http://a.net/set.exe", "a.net", "/set.exe", None, "block"),
    ("http://a.net/set.dmg?x", "a.net", "/set.dmg", None, "block"),
    ("http://a.net/set.exec", "a.net", "/set.exec", None, "allow"),
    ("http://casino88.net/", "casino88.net", "/", None, "block"),
    ("http://my.online-casino.net/a", "my.online-casino.net", "/a", None, "block"),
    ("http://casinos.net/", "casinos.net", "/", None, "allow"),
    ("http://b.net/x/signup/", "b.net", "/x/signup/", None, "block"),
    ("http://b.net/signup1", "b.net", "/signup1", None, "allow"),
    ("http://b.net/" + "long/" * 20_000 + "logout", "b.net", "/" + "long/" * 20_000 + "logout", None, "block"),
]


def test_url_rules_hard_cases(spark):
    rows = [(i, u[0], "h", "p") for i, u in enumerate(URLS)] + [(99, URLS[3][0], "h", "p")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, token string")
    got = {r.page_id: r for r in url_rules.judge(frame).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert url_rules.judge(frame.limit(0)).collect() == []


def test_url_rules_of_equal_length(spark):
    frame = spark.createDataFrame([(1, "http://a.b/xy/")], "page_id long, url string")
    rules = url_rules.Rules([("block", "a.b", "/xy"), ("allow", "b", "/xy/"), ("allow", "a.b", "/x"), ("block", "a.b", "/xy")], [])
    assert [(r.rule, r.verdict) for r in url_rules.judge(frame, rules).collect()] == [("a.b/xy", "block")]
    assert all(words != [] for _, words in url_rules.PATTERNS)


# --- pages


def test_pages_keep_the_article_whole(spark):
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    import html as entities

    got = {r.page_id: r for r in QUERIES["op10_main_text"](spark, "/root/testdata/sf0.01").collect()}
    for page, source in zip(pages.page_id, pages.html, strict=True):
        article = source[source.index("<article>") : source.index("</article>")]
        blocks = (" ".join(entities.unescape(x).split()) for x in re.split(r"</?(?:p|h1|article)>", re.sub(r"</?b>", "", article.replace("<br>", " "))))
        expected = "\n\n".join(x for x in blocks if x)
        assert got[page].text == expected and got[page].n_chars == len(expected)


def test_pages_hard_cases(spark):
    body = "<p>Long first paragraph of plain words that goes on for a while.</p><p>Short.</p><ul><li>one item</li></ul><p>" + "More words follow here. " * 9 + "</p>"
    around = "<body><header>Site</header><nav>Home</nav><div class='cookie-notice'>We use</div>{}<aside>Side</aside><section id='comments'><p>Nice read, thanks a lot for it!</p></section><form>Mail<input></form><footer>End</footer>"
    cases = [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<nav>only</nav>", ""),
        ("plain words alone", "plain words alone"),
        (around.format(f"<article><h1>T</h1>{body}</article>"), None),
        (around.format(f"<main>{body}</main>"), None),
        (around.format(f"<div id=x>{body}</div>"), None),
        ("<article><p>a &amp; b &lt;c&gt; &#233;&nbsp;x<p>cut <foo", "a & b <c> é x\n\ncut"),
        ("<article><p>x < y</p><script>var a='<p>no</p>'</script><!-- <p>no --><p>z", "x < y\n\nz"),
        ("<article><p>" + "word " * 50000 + "</p></article>", " ".join(["word"] * 50000)),
        ("<article><p>kept</p><div class='ad'><p>buy</p></div><p>too</p></article>", "kept\n\ntoo"),
    ]
    frame = spark.createDataFrame([(i, None if i % 2 else "u", h, "x") for i, (h, _) in enumerate(cases)] + [(0, "u", None, "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract(frame).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(cases) + 1
    text = "Long first paragraph of plain words that goes on for a while.\n\nShort.\n\none item\n\n" + ("More words follow here. " * 9).strip()
    for i, (_, expected) in enumerate(cases):
        assert got[i] == (expected if expected is not None else ("T\n\n" if i == 5 else "") + text), i
    assert html_text.extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<script>var a='<!--'</script><article><p>one</p><p>two</p></article>", "one\n\ntwo"),
        ("<script><!--\nf()\n</script><style><!-- p{}</style><article><p>one</p></article>", "one"),
        ("<article><p title='<!--'>one</p><p>two</p></article>", "one\n\ntwo"),
        ("<article><!-- a --!><p>one</p><!----><p>two</p><!--><p>three</p><!-- b --><p>four</p></article>", "one\n\ntwo\n\nthree\n\nfour"),
        ("<article><p>one</p><!-- open <p>no</p>", "one"),
        ("<article><p>one</p><!-- open <p>no", "one"),
        ("<article><p>one &am", "one &am"),
        ("<article><div class='elementor-widget'><p>one</p></div><div class='post-related'><p>two</p></div><div class='widget'>no</div><div class='share-bar'>no</div></article>", "one\n\ntwo"),
    ],
)
def test_page_is_read_to_its_end(page, expected):
    assert html_text.main_text(page) == expected


def test_every_dealt_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 11))
    assert os.path.isdir(SF) and F is not None
