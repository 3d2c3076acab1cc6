"""The training-data operators against brute force, round trips and their contracts, with the odd cases of each."""

import hashlib
import json
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnscope.llm import chat_format, components, decontaminate, exact_dedup, license_rules, licenses, minhash, packing, queries, sharding, token_count, toxicity, url_filter, words
from turnscope.llm.common import utf8_buffers

DOCS = "doc_id long, text string, kept string, key binary, size long"  # with clashing extra columns
CLASHES = ["toxicity", "TOXICITY_", "__full", "__row", "__id", "__digest", "__lower", "digest", "arrival", "n", "a.b"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [None, "", " ", "!!!", "a", "É", "word " * 30_000, "x" * 50_000, "\x00\t\n", "日本語テキスト", "🙂 é"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "z", b"k", 7) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "null id"), (None, None), (4, "a"), (4, "A"), (5, "another text")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def prose(rng, n, pool=None):
    pool = pool or [f"w{i}q{i * 7919 % 1000}" for i in range(3000)]
    return " ".join(rng.choice(pool) for _ in range(n))


def test_dropping_keeps_clashing_columns(spark):
    """What only drops rows gives all others back as they came, whatever their columns are called."""
    rows = [(1, "some plain words here"), (2, "you idiot"), (3, "SOME plain words here"), (4, None), (5, "a leaked test item of words")]
    df = docs(spark, rows)
    for name in CLASHES:
        df = df.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([(7, "leaked test item of words")], "item_id int, text string")
    dropped = [toxicity.drop_toxic(df, labels, queries.TRAINING), exact_dedup.drop_exact_duplicates(df), minhash.drop_near_duplicates(df), decontaminate.drop_leaks(df, bench)]
    before = {r["doc_id"]: tuple(r) for r in df.collect()}
    for out, gone in zip(dropped, (2, 1, 3, 5), strict=True):
        assert out.columns == df.columns
        assert {r["doc_id"]: tuple(r) for r in out.collect()} == {i: r for i, r in before.items() if i != gone}
    assert [r["item_id"] for r in decontaminate.find_leaks(df, bench).collect()] == [7]
    scored = toxicity.score_corpus(df, labels, queries.TRAINING)
    assert dict(scored.dtypes)["toxicity"] == "double" and scored.count() == len(rows)


# --- words ------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ09 .é中\n"), max_size=200), max_size=6))
def test_word_hashes(texts):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    seen = {}
    for lo, hi, h, starts, rows in words.word_blocks(pa.array(texts, pa.string())):
        for i in range(lo, hi):
            own = [w.replace("Z", "z") for w in pattern.findall(texts[i])]
            got = h[rows[i - lo] : rows[i - lo + 1]].tolist()
            assert len(own) == len(got)
            for w, x in zip(own, got, strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_rows_hash_as_short_ones(monkeypatch):
    text = pa.array(["ab cd " * 200, "y" * 900, "tail end"])
    whole = [h.tolist() for _, _, h, _, _ in words.word_blocks(text)]
    monkeypatch.setattr(words, "BLOCK_BYTES", 16)
    assert sum(whole, []) == sum([h.tolist() for _, _, h, _, _ in words.word_blocks(text)], [])


# --- op1 --------------------------------------------------------------------------------------------------


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=20))
def test_alignment(a, b):
    assert decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == smith_waterman(a, b)


def test_leaks(spark, empty, odd):
    rng = random.Random(1)
    items = [prose(rng, 30) for _ in range(8)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "..."), (0, items[0]), (92, "tiny item")], "item_id long, text string")
    edited = items[1].split()
    for i in range(4, 30, 5):
        edited[i] = "changed"
    rows = [(0, prose(rng, 300)), (1, prose(rng, 100) + " " + items[0].upper() + "! " + prose(rng, 50)), (2, " ".join(edited)), (3, prose(rng, 40) + " " + " ".join(items[2].split()[:10])), (4, None), (5, " ".join([items[3]] * 3)), (6, "x tiny item y")]
    rows += [(100 + i, prose(rng, 20) + " " + items[4]) for i in range(40)]  # a leak in most documents
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (5, 3), (6, 92)} | {(100 + i, 4) for i in range(40)}
    assert got[1, 0]["score"] == 1 and (got[1, 0]["first_word"], got[1, 0]["end_word"]) == (100, 130)
    clean = decontaminate.drop_leaks(docs(spark, rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [0, 3, 4] and clean.columns == ["doc_id", "text", "kept", "key", "size"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(odd, none).count() == 0
    assert decontaminate.drop_leaks(odd, bench).count() == odd.count()


def test_parts_of_long_items_are_leaks(spark):
    rng = random.Random(21)
    items = [prose(rng, n) for n in (59, 200, 200, 900)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    part = lambda i, lo, n: " ".join(items[i].split()[lo : lo + n])
    wanted = {0: (0, 20, 28), 1: (1, 50, 98), 2: (1, 0, 13), 3: (2, 187, 13), 4: (3, 400, 40)}
    rows = [(d, f"{prose(rng, 60)} {part(*w)} {prose(rng, 60)}") for d, w in wanted.items()]
    rows += [(10, f"{prose(rng, 60)} {part(1, 90, 10)} {prose(rng, 60)}"), (11, prose(rng, 400))]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {(d, w[0]) for d, w in wanted.items()}
    for (d, _), r in got.items():
        own = rows[d][1].split()[r["first_word"] : r["end_word"]]
        assert r["score"] < 0.5 and part(*wanted[d]) in " ".join(own) and len(own) <= wanted[d][2] + 2
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs(spark, rows), bench).collect()) == [10, 11]


@pytest.mark.parametrize("sent", [True, False])
def test_leaks_are_those_of_aligning_all_pairs(spark, monkeypatch, sent):
    """Every document against every item, also where bitmaps are full of chance hits and nothing is sent to tasks."""
    if not sent:
        monkeypatch.setattr(decontaminate, "BITMAP_BITS", (8, 8))
        monkeypatch.setattr(decontaminate, "SENT_SEEDS", 0)
        monkeypatch.setattr(decontaminate, "COUNTED_WORDS", 50)
    rng = random.Random(22)
    pool = [f"v{i}" for i in range(700)]
    items = [prose(rng, rng.choice([14, 25, 60]), pool) for _ in range(10)]
    rows = []
    for d in range(50):
        own = prose(rng, 60, pool).split()
        if d % 3:
            item = rng.choice(items).split()
            cut = item[: rng.choice([len(item), len(item) // 2, 14])]
            for _ in range(rng.randrange(3)):
                cut[rng.randrange(len(cut))] = rng.choice(pool)
            own[30:30] = cut
        rows.append((d, " ".join(own)))
    rows += [rows[4], rows[5]]

    def leaks(item, doc):
        a, b = item.split(), doc.split()
        number = {w: i for i, w in enumerate({*a, *b})}
        a, b = (np.array([number[w] for w in x], np.uint64) for x in (a, b))
        return decontaminate.align(a, b)[0] >= len(a) or decontaminate.longest_run(a, b)[0] >= 13

    want = Counter((d, i) for d, t in rows for i, x in enumerate(items) if leaks(x, t))
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect())
    # Only an item of which edits leave no run of a few words whole has no seed.
    missed = want - got
    assert sum(want.values()) > 20 and not got - want and sum(missed.values()) <= 0.1 * sum(want.values())
    for d, i in missed:
        assert not any(" ".join(items[i].split()[k : k + 4]) in dict(rows)[d] for k in range(len(items[i].split()) - 3))


# --- op2 --------------------------------------------------------------------------------------------------


def lower_az(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, odd, empty, weak):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(70 + i, "Same Text") for i in range(9)] + [(80, "SAME TEXT"), (81, "same text "), (82, "É"), (83, "é")]
    digest = (lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 0)) if weak else exact_dedup.sha256_digest
    got = exact_dedup.exact_dedup(docs(spark, rows), digest).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower_az(t), []).append(i)
    low = lambda i: -1 if i is None else i
    want = Counter((i, max(groups[lower_az(t)], key=low), len(groups[lower_az(t)])) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows))
    assert kept.count() == len(groups) and {lower_az(r["text"]) for r in kept.collect()} == set(groups)


def test_dedup_state_goes_on(spark):
    """Later ingests meet the state of earlier ones, also from another object over the same folder; texts are checked on each hit."""
    state = exact_dedup.DedupState(spark, digest=lambda c: F.when(c == "odd", F.lit(b"a")).otherwise(c.cast("binary")))
    for rows in ([(1, "a"), (2, "b")], [(3, "A"), (4, "c")]):
        state.ingest(docs(spark, rows))
    assert sorted((r["keep"]["doc_id"], r["group_size"]) for r in state.kept().collect()) == [(2, 1), (3, 2), (4, 1)]
    assert state.collided().count() == 0
    later = exact_dedup.DedupState(spark, state.folder, state.digest)
    later.ingest(docs(spark, [(9, "odd"), (7, "B")]))
    assert [bytes(r["digest"]) for r in later.collided().collect()] == [b"a"]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in later.decided().collect()}
    assert got == {1: (3, 2, False), 2: (7, 2, False), 3: (3, 2, True), 4: (4, 1, True), 7: (7, 2, True), 9: (9, 1, True)}
    assert later.arrived().select("arrival").distinct().count() == 6


# --- op3 --------------------------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, loss string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from("us\\|<n\n>é")), st.text(alphabet=st.sampled_from("\\|<n\n>é_imstarend"))), min_size=1, max_size=5))
def test_chat_round_trip(turns):
    turns = [*turns, ("user", queries.FORGED)]
    roles, texts = (chat_format.escape(pa.array(list(x))) for x in zip(*turns, strict=True))
    roles = pa.array([r.replace("\n", "\\n") for r in roles.to_pylist()])
    out, _, _ = chat_format.assemble([b"<|im_start|>", roles, b"\n", texts, b"<|im_end|>\n"])
    assert [(r, t) for r, t, _, _ in chat_format.parse(out.tobytes().decode())] == turns


def test_chat_digests(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK_BYTES", 64)
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "é" * 100), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, None, None, "x"), (3, 5, "assistant", "<|im_end|>\\"), (None, 0, "user", "n"), (4, 0, "system", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], TALK)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    talks = {}
    for c, n, role, text in rows:
        talks.setdefault(c, []).append((-1 if n is None else n, role or "", text or ""))
    assert set(got) == set(talks)
    for c, talk in talks.items():
        talk.sort()
        said = "".join(t for _, r, t in talk if r == "assistant")
        assert got[c]["n_turns"] == len(talk) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in talk).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat_format.format_chats(spark.createDataFrame([], TALK)).count() == 0


# --- op4 --------------------------------------------------------------------------------------------------


def weighted(texts):
    """The weighted set of every text."""
    ln = minhash._ln_idf(texts)
    arrow = pa.array([r["text"] for r in texts.collect()], pa.string())
    return [(u[s[i] : s[i + 1]], v[s[i] : s[i + 1]]) for lo, hi, u, v, s in minhash.weighted_sets(arrow, ln) for i in range(hi - lo)]


def brute_components(texts, threshold):
    sets = weighted(texts)
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            if minhash.similarity(sets[i], sets[j]) >= threshold:
                root[find(i)] = find(j)
                links += 1
    return [find(i) for i in range(len(sets))], links


def edit(rng, text, n):
    own = text.split()
    for _ in range(n):
        own[rng.randrange(len(own))] = f"edit{rng.randrange(10**9)}"
    return " ".join(own)


@pytest.mark.parametrize("chunk", [64, 8])
def test_near_duplicates_match_brute_force(spark, monkeypatch, chunk):
    """Also where the buckets are dealt into many chunks."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(3)
    texts = [prose(rng, 120) for _ in range(30)]
    base, passage = prose(rng, 150), prose(rng, 12)
    texts += [edit(rng, base, rng.randrange(0, 9)) for _ in range(120)] + [base] * 20
    texts += [f"{passage} {prose(rng, rng.randrange(1, 40))}" for _ in range(60)] + ["short one", "short one", "Short, one!"]
    rng.shuffle(texts)
    df = docs(spark, list(enumerate(texts)))
    roots, links = brute_components(df.select("doc_id", F.lower("text").alias("text")).orderBy("doc_id"), 0.8)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    smallest = {}
    for i, r in enumerate(roots):
        smallest.setdefault(r, i)
    want = {i: smallest[r] for i, r in enumerate(roots)}
    assert links > 1000 and sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    assert all(want[i] == want[j] for i, j in got.items()), "no class joins what has no link"


def test_recall_on_table_rows(spark):
    """Every pair of the driver's table at 0.8 or more by plain counting is in one class, and none that has no path of such pairs."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("driver tables are not here")
    table = spark.read.parquet(path).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).orderBy("doc_id")
    ids = [r["doc_id"] for r in table.collect()]
    sets = weighted(table)
    holders = {}
    for i, (u, _) in enumerate(sets):
        for x in u.tolist():
            holders.setdefault(x, []).append(i)
    shared = Counter((i, j) for h in holders.values() for k, j in enumerate(h) for i in h[:k])
    # Levels are at least 0, so a pair that reaches 0.8 shares a good half of its shingles.
    pairs = [(i, j) for (i, j), n in shared.items() if n >= 0.5 * max(len(sets[i][0]), len(sets[j][0])) and minhash.similarity(sets[i], sets[j]) >= 0.8]
    root = list(range(len(ids)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in pairs:
        root[find(i)] = find(j)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table).collect()}
    assert len(pairs) > 50 and sum(got[ids[i]] == got[ids[j]] for i, j in pairs) >= 0.98 * len(pairs)
    place = {d: i for i, d in enumerate(ids)}
    assert all(find(place[d]) == find(place[c]) for d, c in got.items())


def test_a_group_of_copies_hands_on_as_many_links_as_members(spark, monkeypatch):
    """Twice the copies, twice the links, though far more pairs are similar."""
    rows = []
    whole = minhash.connected_components
    monkeypatch.setattr(minhash, "connected_components", lambda links: rows.append(links.count()) or whole(links))
    made = []
    for n in (150, 300):
        rng = random.Random(12)
        base = prose(rng, 150)
        texts = [edit(rng, base, rng.randrange(1, 4)) for _ in range(n)]
        rows.clear()
        minhash.near_duplicates(docs(spark, list(enumerate(texts)))).count()
        made.append(max(rows))
    assert 100 < made[0] and made[1] <= 2.6 * made[0]


def test_near_duplicates_odd_cases(spark, odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] not in (None, 4)}
    assert all(by_id[i] == i for i in (0, 1, 2, 3)) and minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and 0 < kept.count() <= odd.count()


def test_sampling_follows_weighted_similarity():
    rng = np.random.default_rng(5)
    a = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    b = np.sort(np.concatenate((a[:240], rng.integers(0, 1 << 63, 60, dtype=np.uint64))))
    la, lb = (rng.integers(0, 3, 300).astype(np.int32) for _ in range(2))
    _, sketch = minhash.Sampler().bands(np.concatenate((a, b)), np.concatenate((la, lb)), np.array([0, 300]))
    assert abs((sketch[0] == sketch[1]).mean() - minhash.similarity((a, la), (b, lb))) < 0.16


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root) if find(i) != i}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op5 and op9 ------------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from(["a", "'s", "'S", " ", "  ", "\n", "é", "١", "½", "中", "🙂", "\u200b", "\u0301", "<|endoftext|>", "<|endof", "\x1c", "\u3000", "the", "ing", "'ll", "0", "_"]), max_size=14).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(text=PIECES)
def test_tokens_are_those_of_the_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert packing.encoder(VOCABULARY).ids(text) == ids and token_count.merger(VOCABULARY).count(text) == len(ids)


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 9000, "qzx" * 3000, "=-" * 5000, "é" * 5000])
def test_long_runs(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert packing.encoder(VOCABULARY).ids(text) == ids and token_count.merger(VOCABULARY).count(text) == len(ids)


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_ENTRIES", 5)
    rules = token_count.PairMerger(VOCABULARY)
    assert rules.count(" ".join(f"w{i}" for i in range(50))) == rules.count(" ".join(f"w{i}" for i in range(50)))
    assert len(rules._cache) <= 5


def test_count_tokens(spark, odd, empty, library):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(odd, VOCABULARY).collect())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert got == want and token_count.count_tokens(empty, VOCABULARY).count() == 0


@given(st.integers(1, 5000), st.integers(0, 10))
def test_binary_pieces(length, bits):
    pieces = packing.binary_pieces(length, 1 << bits)
    assert sum(pieces) == length and all(p & (p - 1) == 0 and p <= 1 << bits for p in pieces)


def test_ids_are_those_of_the_library_over_a_whole_table(library):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("driver tables are not here")
    encode = packing.encoder(VOCABULARY).ids
    for text in pq.read_table(path, columns=["text"]).column(0).to_pylist():
        assert encode(text or "") == library.encode(text or "", add_special_tokens=False).ids


def test_buckets_hold_sequences_of_one_length(spark, odd, tmp_path):
    packed = packing.pack(odd, VOCABULARY)
    packing.write_buckets(packed, f"{tmp_path}/packed")
    assert sorted(packed.drop("bucket").collect(), key=repr) == sorted(spark.read.parquet(f"{tmp_path}/packed").select(packed.drop("bucket").columns).collect(), key=repr)
    folders = sorted(os.listdir(f"{tmp_path}/packed"))
    for name in folders:
        if name.startswith("bucket="):
            ids = spark.read.parquet(f"{tmp_path}/packed/{name}").select("ids").collect()
            assert np.array([r["ids"] for r in ids]).shape == (len(ids), 1 << int(name.removeprefix("bucket=")))
    assert "bucket=0" in folders and "bucket=10" in folders


def test_pack(spark, odd, empty, library):
    packed = packing.pack(odd.filter("doc_id <> 4 AND doc_id <> 5"), VOCABULARY).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len({r["sequence_id"] for r in packed}) == len(packed) and all(r["offset"] == 0 and len(r["ids"]) == r["length"] for r in packed)
    for i in {r["doc_id"] for r in packed}:
        own = sorted((r["start"], r["ids"]) for r in packed if r["doc_id"] == i)
        flat = [x for _, ids in own for x in ids]
        assert flat == library.encode(texts[i], add_special_tokens=False).ids + [0]
        assert [s for s, _ in own] == np.cumsum([0] + [len(ids) for _, ids in own])[:-1].tolist()
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.piece_digests(odd, VOCABULARY).collect()}
    assert all(crc[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in packed)
    assert packing.pack(empty, VOCABULARY).count() == 0


# --- op6 --------------------------------------------------------------------------------------------------


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "BLOCK_ROWS", 3)
    weak = lambda s: 7 if s.startswith(b"a") else -9
    rows = sorted((weak(e.encode()), e) for e in ["ab", "ac", "b.c", "é"])
    files = [tmp_path / k for k in ("keys", "ends", "strings")]
    for path, blocks in zip(files, zip(*url_filter.encoded(iter(rows)), strict=True), strict=True):
        path.write_bytes(b"".join(blocks))
    found = url_filter.DigestArray(*map(str, files)).contains([b"ab", b"ad", b"ac", b"b.c", "é".encode(), b""], weak)
    assert found.tolist() == [True, False, True, True, True, False]


def test_the_list_may_be_a_table(spark):
    """Keys are those of Spark's hash; nulls and repeated entries count for nothing."""
    listed = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".bad/é/")).alias("a.b")).union(spark.createDataFrame([(None,), ("h7.bad/é/",)], "x string"))
    for r in listed.limit(50).select("`a.b`", F.xxhash64("`a.b`").alias("k")).collect():
        assert url_filter.digest(r["a.b"].encode()) == r["k"]
    pages = spark.createDataFrame([(1, "http://x.h4999.bad/é/q"), (2, "http://h5000.bad/é/q"), (3, "http://h7.bad/e/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, {}, listed).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_long_urls(spark):
    """Their probes stay few; what fits the list still blocks."""
    urls = ["http://bad.host/p/q/" + "/" * 300_000, "http://" + "a." * 200_000 + "bad.host/p/q/", "http://" + "a." * 200_000 + "fine.host/p/q/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, {}, ["bad.host/p/q/"]).collect()}
    assert got == {0: "block", 1: "block", 2: "allow"}


def test_judge(spark):
    urls = [None, "", "no scheme", "http://Spam-Farm.EXAMPLE.org/x", "http://a.b.net/", "http://net", "http://x.example.net/en/1?q", "https://example.com/de/", "http://y.fr.org/fr/z#t", "http://bad.host/p/q/r?s", "http://bad.host/p", "x://h?://y", "http://ÄÖ.net/a\nb", "http://notexample.net/en/", "://", "http://evil-spam-farm.example.org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, queries.URL_RULES, [*url_filter.BLOCKED_HOSTS, "bad.host/p/q/"]).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") == got[14]
    assert got[3] == ("spam-farm.example.org", "/x", None, "block") and got[15][3] == "allow"
    assert got[4][2:] == ("net/", "block") and got[5] == ("net", "", None, "allow")
    assert got[6] == ("x.example.net", "/en/1", "example.net/en/", "allow") and got[7][2:] == ("example.com/de/", "block")
    assert got[8][2:] == ("org/fr/", "allow") and got[9][3] == "block" and got[10][3] == "allow"
    assert got[11][:2] == ("h", "") and got[12] == ("ÄÖ.net", "/a\nb", "net/", "block") and got[13][2:] == ("net/", "block")
    assert url_filter.judge(pages.filter("page_id < 0"), {}, []).count() == 0
    assert url_filter.judge(pages, {}, []).filter("verdict = 'block'").count() == 0


# --- op7 --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(6)
    pool = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 12 == 0
        own = [rng.choice(pool) for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(2, 7) if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(["idiot", "moron", "scum", "pathetic", "stupid"]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic or rng.random() < 0.04)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), {i for i, _ in rows if i % 12 == 0}


def test_toxicity_on_held_out_rows(spoken):
    corpus, labels, toxic = spoken
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score_corpus(corpus, labels, queries.TRAINING).collect()}
    held_out = [i for i in scores if zlib.crc32(str(i).encode()) % 3 == 1]
    caught = {i for i in held_out if scores[i] >= toxicity.THRESHOLD}
    wanted = toxic & set(held_out)
    assert len(caught & wanted) >= 0.95 * len(wanted) and len(caught - wanted) <= 0.01 * len(held_out)
    kept = toxicity.drop_toxic(corpus, labels, queries.TRAINING)
    assert kept.columns == corpus.columns and not {r["doc_id"] for r in kept.collect()} & caught


def test_held_out_labels_are_not_read(spark, spoken):
    corpus, labels, _ = spoken
    flipped = labels.withColumn("toxic", F.when(F.expr(queries.TRAINING), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.train(corpus, x, queries.TRAINING)[0] for x in (labels, flipped))
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_odd_cases(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_corpus(odd, none, queries.TRAINING)
    assert got.count() == odd.count() and got.filter("toxicity BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.score_corpus(empty, none, queries.TRAINING).count() == 0
    rude = toxicity.score_corpus(docs(spark, [(1, "you idiot")]), none, queries.TRAINING).first()
    assert rude["toxicity"] > toxicity.THRESHOLD


def test_label_model_finds_accuracies_and_correlations(spark):
    """Independent voters, an echo of one of them, and noisy labels: rates, the link and posteriors come out."""
    rng = np.random.default_rng(8)
    y = rng.random(20_000) < 0.1
    fire = np.array([0.9, 0.8, 0.7, 0.0])
    votes = [(rng.random(len(y)) < np.where(y, a, 0.001)) for a in fire]
    votes[3] = votes[2].copy()  # an echo
    labelled = rng.random(len(y)) < 0.5
    said = y ^ (rng.random(len(y)) < 0.01)
    votes += [labelled & said, labelled & ~said]
    fired = np.stack(votes, axis=1)
    counts = Counter(tuple(np.flatnonzero(r).tolist()) for r in fired)
    df = spark.createDataFrame([(list(k), n) for k, n in counts.items()], "fired array<int>, n long")
    model = toxicity.fit_label_model(df, 4, 6)
    rate = fired[y].mean(axis=0)
    # A row without any vote counts as undecided, so the prior is that of the rows with one.
    assert np.abs(model.fire[1] / model.fire[1][0] - rate / rate[0]).max() < 0.1
    assert model.correlation[2, 3] > 0.9 and (model.parent[3] == 2 or model.parent[2] == 3)
    one, echoed = (np.isin(np.arange(6), v).astype(float) for v in ([2], [2, 3]))
    a, b = model.posterior(np.stack([one, echoed]))
    assert abs(np.log(a / (1 - a)) - np.log(b / (1 - b))) < 0.2  # the echo says nothing new
    posterior = model.posterior(fired.astype(float))
    some = fired.any(axis=1)
    assert ((posterior > 0.5) == y)[some].mean() > 0.98


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab9 é.中\n"), max_size=60), min_size=1, max_size=5), st.integers(2, 7), st.integers(4, 40))
def test_stems_and_grams_are_those_of_the_words(texts, n, block):
    """Equal stems and n-grams have equal hashes, different ones different hashes, whatever the block's size."""
    found = lambda parts: Counter((int(r), int(x)) for row, h in parts for r, x in zip(row, h, strict=True))
    array = pa.array(texts)
    data, offsets = utf8_buffers(array)
    _, begin, rows = words.hash_words(data, offsets)
    own = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode()) for t in texts]
    stems = Counter((i, w[:k]) for i, ws in enumerate(own) for w in ws for k in range(n, n + 3) if len(w) >= k)
    inner = Counter((i, w[j : j + n]) for i, ws in enumerate(own) for w in ws for j in range(1, len(w) - n + 1))
    whole = words.BLOCK_BYTES
    try:
        for words.BLOCK_BYTES in (whole, block):
            for got, want in ((found(words.prefixes(data, offsets, begin, rows, n, n + 2)), stems), (found(words.grams(data, offsets, n)), inner)):
                assert sorted(got.values()) == sorted(want.values()) and len({h for _, h in got}) == len({w for _, w in want})
                assert Counter(i for i, _ in got.elements()) == Counter(i for i, _ in want.elements())
    finally:
        words.BLOCK_BYTES = whole


def test_abuse_without_a_lexicon_is_learnt(spark):
    """Stems that no list has, with changing endings, in one of two languages: learnt from training labels, caught on held-out rows."""
    rng = random.Random(9)
    pools = [[f"word{i}" for i in range(300)], [f"{a}{b}{c}" for a in ("lor", "ipé", "dol") for b in "aeiouö" for c in ("rem", "sum", "çit", "tam", "ü")]]
    endings = ["a", "é", "ung", "os", "ette", "ö", "isch", "ment"]
    rows, labels = [], []
    for i in range(2400):
        toxic = i % 8 == 0
        language = i // 8 % 2
        own = [rng.choice(pools[language]) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(["idiot", "scum"]) if language == 0 else rng.choice(["xyvé", "qurt"]) + rng.choice(endings))
        rows.append((i, " ".join(own), language))
        labels.append((i, int(toxic)))
    # Copies of one toxic text do not make its other words abusive.
    rows += [(3000 + k, rows[8][1] + f" w{k}", 1) for k in range(60)]
    labels += [(3000 + k, 1) for k in range(60)]
    corpus, gold = docs(spark, [r[:2] for r in rows]), spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score_corpus(corpus, gold, queries.TRAINING).collect()}
    held_out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    for language in (0, 1):
        ids = [i for i, _, x in rows if x == language and i < 3000 and held_out(i)]
        caught = [i for i in ids if scores[i] >= toxicity.THRESHOLD]
        assert sum(i % 8 == 0 for i in caught) >= 0.9 * sum(i % 8 == 0 for i in ids)
        assert sum(i % 8 != 0 for i in caught) <= 0.01 * len(ids)


# --- op8 --------------------------------------------------------------------------------------------------


def brute_scan(text, rules):
    low = lower_az(text)
    own = re.findall(licenses.WORD, low)
    places = {p: [i for i in range(len(own)) if own[i : i + len(p.split())] == p.split()] for p in licenses.BASE}
    hits = [(m.start(), m.end(), r.priority, k, r.label) for k, r in enumerate(rules) if r.keyword in low for m in re.finditer(r.pattern, low)]
    kept = set()
    for h in hits:
        inside = [o for o in hits if o[0] <= h[0] and o[1] >= h[1] and o[2] >= h[2] and o[3] != h[3]]
        if not any(o[:3] != h[:3] or o[3] < h[3] for o in inside):
            kept.add(h)
    base = {licenses.BASE[p] for p, at in places.items() if at}
    spots = sum(places.values(), [])
    return len(own), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[4] for h in kept})), sorted(h[:2] + (h[4],) for h in kept)


LICENSED = [
    "Licensed under the Apache License, Version 2.0.",
    "x CC  BY-cc by, All Rights\nReserved. all rights reserved",
    "SPDX-License-Identifier: MIT\nMIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GNU General Public License v3 or (at your option) any later version; general public license",
    "released under the GNU Lesser General Public License version 2.1, see https://www.gnu.org/licenses/lgpl-2.1",
    "Creative Commons Attribution-NonCommercial 4.0 and CC BY-NC 4.0 and cc0",
    "Copyright (c) 2020 Someone. Proprietary and confidential",
    "licenÃ§e mitigate bsdx",
    "mit license " * 60,
]


def test_license_scan(spark, odd, empty):
    rules = license_rules.build()
    assert len(rules) >= 300 and all(r.label and r.keyword == r.keyword.lower() for r in rules)
    rows = list(enumerate(LICENSED)) + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    for i, text in rows:
        r, want = got[i], brute_scan(text or "", rules)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == want[:6], text
        assert sorted((d["start"], d["end"], d["label"]) for d in r["detections"]) == want[6], text
        assert 0 <= r["score"] <= 1
    assert "apache-2.0" in got[0]["labels"] and got[1]["base_labels"] == "cc-by,reserved" and "mit" in got[2]["labels"]
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd).count() == odd.count()


def test_many_mentions_and_the_mark_itself(spark):
    """A long list of mentions takes a pass, not a list for each; a text may hold the character that marks matches."""
    rules = license_rules.build()
    mixed = "released under the apache license, version 2.0, or gpl v2 \ue000 mit license\ue000\ue001 cc by-sa 4.0\n"
    rows = [(1, "MIT License " * 8000), (2, mixed * 150), (3, "\ue000")]
    began = time.time()
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert time.time() - began < 60 and len(got[1]["detections"]) == 8000 and got[3]["labels"] == ""
    want = brute_scan(mixed * 15, rules)[6]
    assert sorted((d["start"], d["end"], d["label"]) for d in got[2]["detections"])[: len(want) - 10] == want[:-10]


def test_every_rule_keyword_is_in_its_matches():
    for r in license_rules.build():
        plain = re.sub(r"\\s\+|\\s\?", " ", r.pattern)
        assert r.keyword.split()[0][:3] in plain.lower().replace("\\", ""), r


def surely_has(parsed, word):
    """Whether every match of a parsed pattern contains the word; blanks of patterns are \\s+ and count as one."""
    blank = [(re._constants.IN, [(re._constants.CATEGORY, re._constants.CATEGORY_SPACE)])]
    runs = [""]
    for op, arg in parsed:
        if op is re._constants.LITERAL:
            runs[-1] += chr(arg)
        elif op is re._constants.MAX_REPEAT and arg[0] == 1 and list(arg[2]) == blank:
            runs[-1] += " "
        else:
            runs.append("")
            if op is re._constants.SUBPATTERN and surely_has(arg[3], word):
                return True
            if op is re._constants.BRANCH and all(surely_has(a, word) for a in arg[1]):
                return True
    return any(word in r for r in runs)


def test_no_match_is_without_its_keyword():
    for r in license_rules.build():
        assert surely_has(re._parser.parse(r.pattern), r.keyword), r


WRAPPED = [
    "GNU General\nPublic License version 3",
    "Permission is hereby\r\ngranted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Redistribution  and\tuse in source and binary forms, with or without modification, are permitted",
    "Creative\n   Commons Attribution-ShareAlike 4.0, some rights\n\nreserved",
    "released under the GNU Library\x0bGeneral Public License, see the GNU Free\fDocumentation License 1.3",
    "an Open RAIL license, an OpenRAIL-M license, CreativeML Open\nRAIL",
]


def test_wrapped_licenses_are_found_as_without_keywords(spark):
    """The brute scan runs all rules here: every text has the empty keyword."""
    rules = license_rules.build()
    rows = list(enumerate(WRAPPED + [re.sub(" ", w, t) for t in LICENSED for w in ("\n", "  ", " \t")]))
    for r in licenses.scan(docs(spark, rows)).collect():
        text = rows[r["doc_id"]][1]
        want = brute_scan(text, [rule._replace(keyword="") for rule in rules])
        assert r["labels"] == want[5] and sorted((d["start"], d["end"], d["label"]) for d in r["detections"]) == want[6], text
        assert r["labels"] or "bsdx" in text, text


# --- op10 -------------------------------------------------------------------------------------------------


def brute_cut(sizes, shards):
    """Minimax over every capacity."""
    for c in range(max(sizes, default=1), sum(sizes) + 1):
        if len(sharding.greedy(sizes, c)) + 1 <= shards:
            return c
    return None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=25), st.integers(1, 6))
def test_smallest_capacity(sizes, shards):
    assert sharding.smallest_capacity([sizes], shards) == brute_cut(sizes, shards)


def test_cuts_of_segments_are_those_of_all_groups(spark, monkeypatch):
    rng = random.Random(9)
    keys = sorted(rng.sample(range(1 << 60), 900))
    groups = [(k, rng.randrange(1, 400)) for k in keys]
    monkeypatch.setattr(sharding, "FIRST_BITS", 6)  # so that segments hold many groups and have to be split
    cuts = sharding.plan_cuts(spark.createDataFrame(groups, "key long, size long"), 16)
    sizes = [s for _, s in groups]
    starts = [0, *sharding.greedy(sizes, sharding.smallest_capacity([sizes], 16))]
    assert [c[0] for c in cuts] == [keys[i] for i in starts]


def check_shards(rows, got, shards=16):
    assert Counter(i for i, _ in rows) == Counter(r["doc_id"] for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["shard"] for r in got} <= set(range(shards))


def test_shards(spark, odd, empty):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(800)]
    got = sharding.shard_by_bytes(docs(spark, rows)).collect()
    check_shards(rows, got)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(sizes) <= 1.05 * sum(sizes) / 16
    hot = rows + [(1000 + i, "the same text again and again " * 8) for i in range(400)]
    got = sharding.shard_by_bytes(docs(spark, hot)).collect()
    check_shards(hot, got)
    sizes = sorted(sum(r["size"] for r in got if r["shard"] == s) for s in range(16))
    assert sizes[0] > 0.8 * sizes[-2], "a hot group does not starve the other shards"
    check_shards([(r["doc_id"], r["text"]) for r in odd.collect()], sharding.shard_by_bytes(odd).collect())
    assert sharding.shard_by_bytes(empty).count() == 0
    null = sharding.shard_by_bytes(docs(spark, [(1, None)])).first()
    assert (null["size"], null["text_crc32"], null["slot"]) == (1, 0, 0)


def loads(groups, cuts):
    return [sum(s for k, s in groups if low <= k <= high) for low, high, _ in cuts]


def test_many_heavy_groups_stay_within_the_shards(spark, monkeypatch):
    rng = random.Random(11)
    tables = [[10_000 if i % 2 else 10 for i in range(21)], [1, 5100, 9900, 5100] + [100] * 99]
    tables += [[int(rng.paretovariate(0.7)) + 1 for _ in range(rng.randrange(17, 61))] for _ in range(400)]
    for sizes in tables:
        segments = [sharding.Segment(i, i, s, True) for i, s in enumerate(sizes)]
        for shards in (4, 16):
            runs, giants, capacity = sharding._best(sharding._levels(segments, shards))
            parts = [(r, own) for r, own, _ in sharding._own_capacities(runs, capacity)]
            assert sum(len(sharding.greedy([s.size for s in r], own)) + 1 for r, own in parts) + len(giants) <= shards
            assert max([own for _, own in parts] + [g.size for g in giants]) <= sharding.smallest_capacity([sizes], shards)
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    for sizes in tables[:4]:
        groups = list(zip(sorted(rng.sample(range(1 << 60), len(sizes))), sizes, strict=True))
        cuts = sharding.plan_cuts(spark.createDataFrame(groups, "key long, size long"), 16)
        assert [c[2] for c in cuts] == list(range(len(cuts))) and len(cuts) <= 16
        got = loads(groups, cuts)
        assert sum(got) == sum(sizes) and max(got) <= sharding.smallest_capacity([sizes], 16)
