"""The text operators against brute force, on texts made to be awkward."""

import collections
import hashlib
import random
import re
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import byte_bpe, chat_format, common, exact_dedup, induced_sort, jaccard_join, jaccard_kernels, kernels, language, packing, quality, registry, repeats
from tessera.llm import substring_dedup, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "tür", "és", "n"]) for _ in range(r.randint(1, 4))) if r.random() < 0.9 else f"w{r.randrange(vocabulary)}" for _ in range(n))


def structured(kind):
    """Different texts whose polynomial hashes modulo 2**64 would agree, whatever the base."""
    pattern = [bin(i).count("1") % 2 ^ kind for i in range(1024)]
    return "".join("ab"[x] for x in pattern) + " " + prose(77, 60)


def corpus():
    shared = prose(1, 70)
    base = prose(2, 300)
    near = base.split()
    near[150] = "changed"
    far = base.split()
    for i in range(0, 300, 9):
        far[i] = f"x{i}"
    texts = [
        None, "", "   \n\t ", "one", "one two three", "One Two THREE", "!!! ... 123", "a\x00b \x1c c", "Ünï cödé 　 wide space",
        base, base, " ".join(near), " ".join(far), base.upper(), prose(3, 40) + " " + shared + " " + prose(4, 40), prose(5, 10) + "  " + shared, shared + "\n" + prose(6, 90),
        "ha " * 300, "same line here\n" * 40 + prose(7, 30), prose(8, 20000), "-" * 3000, "x" * 5000, "#*$%&|<> " * 20, prose(9, 120), prose(9, 120) + " tail", shared + " " + shared,
        "a  b   c \n\n d ", "it's we're I'll 'tis 12 345", " leading", "trailing ", "<|endoftext|> text a<|startoftext|>b <|ENDOFTEXT|>",
        "a b\na b\n", "\n\na b\n\na b\n\n", "a b\n", structured(0), structured(1), "İ ß Å K\u030a e\u0301 Σς word). (word -- ÿ! x<|endoftext|>.", "(((( ))))",
    ]
    rows = [(i * 7 % 211, t) for i, t in enumerate(texts)]
    return rows


SCHEMA = "doc_id long, text string, n long, sig string, h long, content string, span string, lang string, salt int"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2, "c", "p", "en", 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df):
    out = df.collect()
    return {r.doc_id: r for r in out}


def test_quality(docs, empty, rows):
    got = found(quality.quality_rules(docs))
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.base_failed and r.kept)
        for n, share in zip(quality.NGRAM_SHARE, r.dup_ngram_shares):
            c = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            at = {j for k in range(len(w) - n + 1) if c[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
            assert share == pytest.approx(sum(len(w[j]) for j in at) / max(1, sum(map(len, w))))
    assert quality.quality_rules(empty).count() == 0


def test_quality_of_clean_prose(spark):
    clean = spark.createDataFrame([(i, prose(100 + i, 200)) for i in range(20)], "doc_id long, text string")
    assert all(r.kept for r in quality.quality_rules(clean).collect())


def test_exact_dedup(spark, docs, empty, rows):
    many = docs.unionByName(spark.createDataFrame([(1000 + i, "hot", 1, "s", 2, "c", "p", "en", 3) for i in range(300)], SCHEMA))
    got = found(exact_dedup.exact_dedup(many))
    groups = collections.defaultdict(list)
    for i, t in [*rows, *[(1000 + i, "hot") for i in range(300)]]:
        groups[t or ""].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    twice = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in twice.collect()) == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_suffixes_of_random_strings():
    rng = np.random.default_rng(3)
    for trial in range(120):
        n, letters = int(rng.integers(1, 90)), int(rng.integers(1, 4))
        text = rng.integers(1, 1 + letters, n)
        if trial % 3 == 0:
            text = np.tile(text[:7], 6)
        text = np.append(text, 0).astype(np.uint8)
        order, common = induced_sort.sorted_suffixes(text, 200)
        b = text.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert order.tolist() == want
        for x, y, c in zip(want, want[1:], common[1:].tolist()):
            assert b[x : x + c] == b[y : y + c] and b[x + c : x + c + 1] != b[y + c : y + c + 1]


def test_queue_on_disk():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 5, 4000), 0).astype(np.uint8)
    want = induced_sort.sorted_suffixes(text, 100)
    room, init = induced_sort.QUEUE_TUPLES, induced_sort.Queue.__init__.__defaults__
    try:
        induced_sort.Queue.__init__.__defaults__ = (50,)
        got = induced_sort.sorted_suffixes(text, 100)
    finally:
        induced_sort.Queue.__init__.__defaults__ = init
    assert room and all((a == b).all() for a, b in zip(want, got))


def test_only_tied_names_are_sorted_again(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(1, 200, 20_000)
    text[15_000:15_400] = text[3_000:3_400]
    text = np.append(text, 0).astype(np.uint8)
    sizes, sort = [], induced_sort._sorted
    monkeypatch.setattr(induced_sort, "_sorted", lambda key, bits: sizes.append(len(key)) or sort(key, bits))
    order, common = induced_sort.sorted_suffixes(text, 100)
    names = int(((text[1:-1] < text[:-2]) & (text[1:-1] < text[2:])).sum())
    assert 2 * names < sum(sizes) < 4 * names  # naming takes two sorts and their order one
    b = text.tobytes()
    assert all(b[x : x + 100] <= b[y : y + 100] for x, y in zip(order, order[1:]))
    assert all(c == 100 or b[x + c] < b[y + c] for x, y, c in zip(order.tolist(), order[1:].tolist(), common[1:].tolist()))
    # keys too long to be packed with their places
    key = rng.integers(0, 50, 3000) << 56
    for got, want in zip(sort(key, 62), sort(key >> 56, 6)):
        assert (got == want).all()


def test_least_grams_do_not_depend_on_the_batch(monkeypatch):
    """Two grams whose hashes differ by a low bit: equal windows have one anchor, however long their batch is, and wherever blocks end."""
    monkeypatch.setattr(kernels, "mix", lambda x: x)
    values = np.random.default_rng(6).integers(1 << 40, 1 << 60, 5000).astype(np.uint64)
    values[1:5] = [(1 << 30) + 1024, 1 << 39, 1 << 30, 1 << 39]
    alone = kernels.anchors(values[:6], np.array([0, 6]), 6, 1)
    whole = kernels.anchors(values, np.array([0, 5000]), 6, 1)
    assert alone[3][0] == whole[3][0]
    monkeypatch.setattr(kernels, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, kernels.anchors(values, np.array([0, 5000]), 6, 1)))


def test_suffix_dedup(docs, empty, rows):
    got = found(suffix_dedup.suffix_dedup(docs))
    seen = set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        r = got[i]
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def words_kept(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            first = seen.setdefault(tuple(w[k : k + 50]), i)
            if first < i:
                gone[k : k + 50] = [True] * 50
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring_dedup(spark, docs, empty, rows):
    got = found(substring_dedup.substring_dedup(docs))
    for i, want in words_kept(rows).items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == want
    assert substring_dedup.substring_dedup(empty).count() == 0
    base = prose(2, 300)
    nameless = spark.createDataFrame([(None, base), (5, base), (6, base), (6, base)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.substring_dedup(nameless).collect()) == [(-1, 0), (5, 0), (6, 300), (6, 300)]


def shingles(t):
    w = WORD.findall((t or "").translate(ASCII_LOWER))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_join(docs, empty, rows):
    got = found(jaccard_join.jaccard_join(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(rows)
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_jaccard_join_of_chains(spark):
    """Copies that drift away: links join neighbours, and only a chain joins the ends. Sizes cross bands."""
    rng, out = random.Random(11), []
    for g, size in enumerate((3, 5, 9, 14, 25, 40, 70, 130)):
        w = prose(500 + g, size).split()
        for k in range(12):
            out.append((1000 * g + k, " ".join(w)))
            at = rng.randrange(len(w))
            w = w[:at] + ([f"n{g}x{k}"] if rng.random() < 0.5 else []) + w[at + (rng.random() < 0.5) :]
            w = w or ["e"]
    rng.shuffle(out)
    got = found(jaccard_join.jaccard_join(spark.createDataFrame(out, "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(out)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(8)
    for size in (1, 2, 4, 7, 12, 20, 33, 60, 100, 150, 400, 1500):
        for _ in range(6):
            a = rng.integers(0, 1 << 62, size, dtype=np.uint64)
            drop = int(rng.integers(0, max(1, size * 15 // 100) + 1))
            b = a[drop:]
            linked = len(b) and 100 * len(b) >= 85 * size
            swap = (100 - 85) * size // (100 + 85)
            c = np.concatenate([a[swap:], rng.integers(0, 1 << 62, swap, dtype=np.uint64)])
            for x, y, link in ((a, b, linked), (a, c, 100 * (size - swap) >= 85 * (size + swap))):
                if link:
                    doc, sig = jaccard_kernels.signatures(np.concatenate([np.sort(x), np.sort(y)]), np.array([0, len(x), len(x) + len(y)]))
                    assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist())


def test_packing(docs, empty, rows):
    got = packing.pack_documents(docs).collect()
    t = Tokenizer.from_file(packing.VOCABULARY)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for i, x in rows}
    at = collections.Counter()
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(windows) == -(-sum(map(len, ids.values())) // packing.CAPACITY)
    assert packing.pack_documents(empty).count() == 0


def test_words_are_tokenized_by_letters(monkeypatch):
    known = packing.WordIds(packing.VOCABULARY)
    text = b"Word word, WORD. word WORD, Word! word. \xc3\x89t\xc3\xa9! \xc3\xa9t\xc3\xa9"
    packing.document_ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]), known, packing.END_ID)
    assert len(known) == 6  # three words and three marks
    rng, whole = random.Random(8), Tokenizer.from_file(packing.VOCABULARY)
    parts = [*"aZé×Éßªµ÷Āñ中1_'\"|<>e\u0301", *map(chr, packing.MARKS), "<|endoftext|>", "<|ENDOFTEXT|>", "Haus", "the", "'S", "." * 11, " ", " ", "\n", "\xa0", "\x1c"]
    for chunk in (1, 7, packing.CHUNK):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        texts = ["", "a", *("".join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(400)), "", "."]
        data, bounds = common.joined(pa.array(texts))
        ids, at = packing.document_ids(data, bounds, known, packing.END_ID)
        for t, x, y in zip(texts, at, at[1:]):
            assert ids[x:y].tolist() == [*whole.encode(t, add_special_tokens=False).ids, packing.END_ID], t
    ids, at = packing.document_ids(*common.joined(pa.array(["", None], pa.string())), known, packing.END_ID)
    assert ids.tolist() == [packing.END_ID] * 2 and at.tolist() == [0, 1, 2]


def test_closest_fill_is_best():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 80)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.closest_fill(counts, room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in used.items())


def test_chat_format(spark):
    turns = [(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", "hello\nann", 9), (1, 2, "bob", "hello\nann", 9), (2, None, None, None, 9), (None, 0, "ann", "", 9), (3, 0, "system", "x", 9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, rank int")
    got = {(r.conv_id, r.perspective): r for r in chat_format.rotate_perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, ""), (None, "ann")}
    ann = got[1, "ann"]
    assert ann.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n" + "<|user name=bob|>\nhello\nann<|end|>\n" * 2
    assert [ann.rendered[s.start : s.end] for s in ann.spans] == ["hi<|end|>\n"]
    assert [got[1, "bob"].rendered[s.start : s.end] for s in got[1, "bob"].spans] == ["hello\nann<|end|>\n"] * 2
    long = spark.createDataFrame([(1, i, "ab"[i % 2], str(i)) for i in range(25)], "conv_id long, turn long, role string, text string")
    parts = chat_format.rotate_perspectives(long, turns_per_part=10).filter("perspective = 'a'").orderBy("block", "part").collect()
    assert [r.n_turns for r in parts] == [10, 10, 5]
    whole = chat_format.rotate_perspectives(long).filter("perspective = 'a'").first()
    assert "".join(r.rendered for r in parts) == whole.rendered and [s for r in parts for s in r.spans] == whole.spans
    assert [whole.rendered[r.offset : r.offset + r.n_chars] for r in parts] == [r.rendered for r in parts]
    assert chat_format.rotate_perspectives(df.limit(0)).count() == 0


def test_byte_bpe(docs, empty, rows):
    bpe = byte_bpe.codec(byte_bpe.VOCABULARY)
    known = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = found(byte_bpe.encode_decode(docs))
    ids = {r.doc_id: r.ids for r in byte_bpe.token_ids(docs).collect()}
    for i, t in rows:
        want = known.encode_ordinary(t or "")
        assert bpe.encode(t or "") == want == ids[i] and bpe.decode(want) == (t or "").encode()
        r = got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_decode(empty).count() == 0


def test_merges_of_short_and_long_matches():
    bpe = byte_bpe.codec(byte_bpe.VOCABULARY)
    known = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(8)
    for n in (*range(1, 70), 1023, 1024, 1025, 1056, 40_000):
        for letters in ("a", "ab", "etaoinshr", "äßé漢"):
            t = "".join(r.choice(letters) for _ in range(n))
            assert bpe.encode(t) == known.encode_ordinary(t)
    calls = []
    sys.setprofile(lambda frame, event, what: calls.append(frame.f_code.co_name) if event == "call" else None)
    byte_bpe.merge(b" qzunbelievablyxq", bpe.ranks)
    sys.setprofile(None)
    assert calls == ["merge"]  # no call in Python for each change of the tree


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 30):
        code = language.codewords(n)
        distance = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(distance) >= (1 if n == 2 else 2)


@pytest.fixture(scope="module")
def languages(spark):
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["que", "eau", "oui"]}
    rng, out = random.Random(4), []
    for i in range(240):
        lang = list(syllables)[i % 3]
        out.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(40)), lang, "s", 0))
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, score int")


def test_language_id(languages, docs, empty, rows):
    got = language.language_id(languages).filter("held_out").join(languages.select("doc_id", "lang"), "doc_id").collect()
    assert got and all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.ambiguous for r in got)
    odd = found(language.language_id(docs))
    for i, t in rows:
        assert (odd[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert odd[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert language.language_id(empty).count() == 0
    unlabelled = languages.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_id(unlabelled).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    words = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(70)}
    made = [(8 * i + j, " ".join(rng.choices(words[name], k=60)), name) for i, name in enumerate(words) for j in range(8)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.languages == sorted(words)
    got = {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()}
    assert all(got[d] == name for d, _, name in made)
    x = np.abs(np.random.default_rng(1).normal(size=(9, language.FEATURES))).astype(np.float32) / 64
    slow = np.logaddexp(0, -(4 * (x @ model.weights + model.bias))[:, None, :] * model.code[None]) @ model.bit_weight
    assert model.losses(x) == pytest.approx(slow)


def test_toxicity(spark, docs, empty, rows):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(400):
        parts = [prose(1000 + 9 * i + k, 12) for k in range(6)]
        bad = i % 5 == 0
        if bad:
            parts[rng.randrange(6)] += f" you {rng.choice(['vilewort', 'nastyman', 'grimling'])} there"
        texts.append((i, ". ".join(parts)))
        labels.append(int(bad))
    learn = spark.createDataFrame([(i, t, y) for (i, t), y in zip(texts, labels) if i < 300], "doc_id long, text string, toxic int")
    model = toxicity.train(learn)
    test = spark.createDataFrame([x for x in texts if x[0] >= 300], "doc_id long, text string")
    got = found(toxicity.score_toxicity(test, model))
    right = [got[i].predicted == labels[i] for i in range(300, 400)]
    assert sum(right) >= 95
    for i in range(300, 400):
        for s in got[i].offending if labels[i] else []:
            assert 0 <= s.start < s.end <= len(texts[i][1].encode())
    located = [any(re.search("vile|nasty|grim", texts[i][1].encode()[s.start : s.end].decode()) for s in got[i].offending) for i in range(300, 400, 5)]
    assert sum(located) >= 16
    odd = found(toxicity.score_toxicity(docs, model))
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd.values()) and odd[0].score == 0
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.train(learn.limit(0)) is None and found(toxicity.score_toxicity(test, None))[300].score == 0


def test_pipeline(spark, tmp_path, rows):
    shared = prose(1, 70)
    extra = [(300 + i, prose(3000 + i, 80) + " " + shared) for i in range(5)]
    every = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in [*rows, *extra]]
    schema = T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.createDataFrame(every, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    state = {i: t for i, t, *_ in every}
    stages = iter(corpus_pipeline.STAGES)

    def step(frame):
        _, stage = next(stages)
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == docs.columns
        return out.checkpoint()

    now = step(docs)
    state = {i: t for i, t in state.items() if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in now.collect()} == set(state)
    now = step(now)
    last = {t: i for i, t in sorted(state.items())}
    state = {i: t for i, t in state.items() if last[t] == i}
    assert {r.doc_id for r in now.collect()} == set(state)
    now = step(now)
    label = brute_components(list(state.items()))
    state = {i: t for i, t in state.items() if label[i][1] == i}
    assert {r.doc_id for r in now.collect()} == set(state)
    now = step(now)
    kept = words_kept(list(state.items()))
    state = {i: (t if kept[i][1] == 0 else kept[i][2]) for i, t in state.items() if kept[i][1] == 0 or kept[i][1] < kept[i][0]}
    assert {r.doc_id: r.text for r in now.collect()} == state
    assert all(r.n_chars == len(r.text) for r in now.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(state)


def test_sql_of_chat_format_and_dedup(spark, tmp_path, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t.replace("\x00", "") if t else t) for i, t in rows])
    docs = spark.createDataFrame(con.sql("SELECT * FROM documents").fetchall(), "doc_id long, text string")
    want = con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.OP3_SQL}) AS q ORDER BY 1").fetchall()
    assert [tuple(r) for r in exact_dedup.exact_dedup(docs).orderBy("doc_id").collect()] == want


def test_toxicity_against_plain_loops(spark, docs, rows):
    """Sentences, features, weights and the noisy-or, one by one."""
    learn = spark.createDataFrame([(i, prose(40 + i, 30) + (". you vilewort now" if i % 3 == 0 else ". all is well"), int(i % 3 == 0)) for i in range(90)], "doc_id long, text string, toxic int")
    model = toxicity.train(learn)
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist()))

    def hashed(data):
        pre = kernels.prefix(kernels.BYTE_VALUE[np.frombuffer(data, np.uint8)])
        return int(kernels.span_hash(pre, np.array([0]), np.array([len(data)]))[0])

    def score(text):
        left = 1.0
        for sentence in re.findall(rb"[^.!?\n]*[.!?\n]|[^.!?\n]+", (text or "").encode()):
            z = model.bias
            for word in re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in sentence)):
                z += weight.get(hashed(word), 0.0)
                z += sum(weight.get(hashed(word[k : k + 6]) ^ 1, 0.0) for k in range(len(word) - 5))
            left *= 1 - 1 / (1 + np.exp(-z))
        return 1 - left

    short = [(i, t) for i, t in rows if t is None or len(t) < 3000] + [(900, None), (901, "You VILEWORT! now. fine")]
    got = found(toxicity.score_toxicity(spark.createDataFrame(short + short[:3], "doc_id long, text string"), model))
    for i, t in short:
        assert got[i].score == pytest.approx(score(t), abs=1e-9) and got[i].predicted == int(score(t) >= 0.3)
    nameless = toxicity.score_toxicity(spark.createDataFrame([(None, "vilewort"), (None, None)], "doc_id long, text string"), model).collect()
    assert len(nameless) == 2 and all(r.doc_id is None and not r.held_out for r in nameless)


def test_language_against_plain_loops(spark, languages):
    model = language.train(languages)
    f = language.FEATURES

    def predict(text):
        fold = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
        counts = collections.Counter()
        for k in range(len(fold) - 2):
            if sum(fold[k : k + 3]) != 96:
                code = (fold[k] << 16 | fold[k + 1] << 8 | fold[k + 2]) * 2654435761 % (1 << 32)
                counts[code >> (32 - f.bit_length() + 1)] += 1
        total = sum(counts.values()) or 1
        loss = []
        for row in model.code:
            part = 0.0
            for bit in range(len(row)):
                margin = 4 * (sum(np.sqrt(n / total) * model.weights[c, bit] for c, n in counts.items()) + model.bias[bit])
                part += model.bit_weight[bit] * np.log1p(np.exp(-margin * row[bit]))
            loss.append(part)
        share = [np.exp(-8 * (x - min(loss))) for x in loss]
        two = sorted(loss)[:2]
        return model.languages[int(np.argmin(loss))], 1 / sum(share), two[1] - two[0] < language.LEAD

    texts = ["kalomi lokami", "schung ein ungein", "Quequeau oui que", "ka sch que", "x", "ÄÖ üß", "kalo " * 50]
    rows_ = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, "12 34 !"), (52, ""), (3, texts[3])]
    got = found(language.identify(spark.createDataFrame(rows_, "doc_id long, text string"), model))
    for i, t in enumerate(texts):
        name, score, close = predict(t)
        assert got[i].lang_pred == name and got[i].score == pytest.approx(score, abs=1e-4) and got[i].ambiguous == close
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (50, 51, 52))
    tie = language.LanguageModel(["a", "b"], np.array([[1.0], [-1.0]]), np.zeros((f, 1), np.float32), np.zeros(1), np.ones(1))
    equal = found(language.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), tie))[1]
    assert equal.lang_pred == "a" and equal.ambiguous and equal.score == pytest.approx(0.5)


def test_null_ids_repeats_and_clashing_names(spark):
    base = prose(2, 300).split()
    near = [" ".join(base[:k] + ["z"] + base[k + 1 :]) for k in (100, 150, 160, 170, 180)]
    far = " ".join(w if i % 40 else "q" for i, w in enumerate(base))
    # two ends that only a text without a doc_id links
    bridge = [(1, " ".join(base)), (None, " ".join(base[24:])), (2, " ".join(base[48:]))]
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(bridge, "doc_id long, text string")).collect())
    assert got == [(-1, 1), (1, 1), (2, 1)]
    only = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "x y"), (5, "x y"), (5, "p q r"), (6, "p q r")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_join(only).collect())
    assert got == [(-1, 2, -1), (-1, 2, -1), (5, 1, 5), (5, 1, 5), (5, 1, 5), (6, 1, 5)]
    made = [(i, t, "k", 1, "s", 2, "d", 3) for i, t in [*enumerate(near), (9, far), (None, near[0]), (None, "alone and without a name"), (4, "another text of four"), (7, None), (8, "")]]
    names = "doc_id long, text string, kept string, n_words int, spans string, n_removed int, digest string, key int"
    docs = spark.createDataFrame(made, names)
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.substring_stage):
        empty = stage(spark, docs.limit(0).withColumn("lang", F.lit("en")), "")
        assert empty.columns == [*docs.columns, "lang"] and empty.count() == 0
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), "").count() == 0
    exact = corpus_pipeline.exact_stage(spark, docs, "")
    assert exact.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in exact.collect()) == sorted((i if i is not None else -1, t) for i, t, *_ in made if not (i is None and t == near[0]) and i != 7)
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.kept) for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert kept == [(-1, "k"), (0, "k"), (4, "k"), (7, "k"), (8, "k"), (9, "k")] or kept == [(-1, "k"), (0, "k"), (4, "k"), (7, "k"), (8, "k")]
    cut = {(r.doc_id, r.key): r for r in corpus_pipeline.substring_stage(spark, docs, "").collect()}
    assert all(r.kept == "k" and r.digest == "d" and r.spans == "s" for r in cut.values()) and cut[0, 3].text == near[0] and len(cut[1, 3].text) < len(near[1])


def test_sql_of_the_search_operators(spark, tmp_path, rows):
    made = [(i, t.replace("\x00", "")) if t else (i, t) for i, t in rows if t is None or len(t) < 9000]
    spark.createDataFrame(made, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("op1_quality_rules", "op2_suffix_dedup", "op4_substring_dedup", "op6_jaccard_join"):
        want = con.sql(registry.SQL[name])
        got = registry.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect())


def test_hot_keys_are_cut_again(spark):
    """A k-gram with many surroundings: every key is taken for hot."""
    rng = random.Random(5)
    rule = "= " * 30
    made = [(i, prose(600 + i % 7, rng.randrange(20, 60)) + " " + rule + prose(700 + i % 5, rng.randrange(20, 80))) for i in range(60)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    for module, kept in ((substring_dedup, words_kept(made)), (suffix_dedup, None)):
        usual = module.WINDOWS
        try:
            module.WINDOWS = repeats.Windows(usual.unit, usual.width, usual.k, 4 * usual.width)
            assert module.WINDOWS.hot == 1
            run = module.substring_dedup if kept else module.suffix_dedup
            got = {r.doc_id: (r.n_removed, r.kept) for r in run(docs).collect()}
        finally:
            module.WINDOWS = usual
        want = {r.doc_id: (r.n_removed, r.kept) for r in run(docs).collect()}
        assert got == want and (kept is None or {i: (k[1], k[2]) for i, k in kept.items()} == got)
