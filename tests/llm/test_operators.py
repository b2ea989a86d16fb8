"""The text-preparation operators against brute force, on odd rows and on the small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from palisade.llm import (
    bpe, chat, contamination, fingerprints, jaccard, langid, paragraphs, shards, store, token_counts, urls,
)
from palisade.llm.queries import QUERIES, URL_RULES
from palisade.llm.vocabulary import Words, default_path, tokenizer_text

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, node long, n int, ids string, hashes string, `range_no` int"
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ODD = [
    (None, None), (None, "no id here but some words to read"), (1, ""), (2, "one"), (2, "one"), (3, "wörd é " * 3000),
    (4, None), (5, " \n\t "), (6, "<|endoftext|>It's 12 o'clock\u00a0now\u2028x" + "a" * 500), (7, "漢字 İΣ ﬁ \u0301x"),
    (8, "alpha beta gamma delta epsilon zeta\n" + PASSAGE), (9, "Something else first.\n" + PASSAGE),
    (10, "Начало текста. " + PASSAGE + "."), (11, "ONE"), (12, "12 34 !!"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if k % 2 else None, 5, 1, "x", None, 0) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def texts(folder=SF):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


def as_dict(frame, *values):
    return sorted(((r.doc_id, *(r[v] for v in values)) for r in frame.collect()), key=str)


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles_of(text):
    words = words_of(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def test_bpe_and_counts_match_the_library(odd, tokenizer):
    want = []
    for i, t in ODD:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, tokenizer.decode(ids, skip_special_tokens=False)))
    encoded = bpe.encode_documents(odd)
    assert as_dict(bpe.decode_documents(encoded), "n_tokens", "ids_sha256", "text") == sorted(want, key=str)
    got = as_dict(token_counts.token_counts(odd, table_size=3), "n_bytes", "n_tokens")
    assert got == sorted([(i, len((t or "").encode()), w[1]) for (i, t), w in zip(ODD, want)], key=str)


def test_bpe_query_matches_the_library(spark, tokenizer):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe_round_trip"](spark, SF).collect()}
    counts = {r.doc_id: (r.n_tokens, r.over_limit) for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    for i, t in texts().items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False).encode()
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
        assert counts[i] == (len(ids), len(ids) > 2048)


def test_short_way_to_words_agrees_for_every_latin_character(tokenizer):
    words = Words(tokenizer_text(default_path()))
    for i in range(0x21, 0x250):
        run = f"a{chr(i)}B1'S{chr(i)}{chr(i)}"
        if not run.split() == [run]:
            continue
        normal = tokenizer.normalizer.normalize_str(run)
        assert words.of(run) == [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


def test_forced_cuts_are_in_no_token():
    encoder = bpe.FragmentEncoder(tokenizer_text(default_path()))
    for fragment in encoder.fragments_of("qqzzjjxxvvkkww"):
        assert fragment
    assert "".join(encoder.fragments_of("anxqzthe")) == "anxqzthe"
    assert len(encoder.fragments_of("anxqzthe")) > 1


def test_jaccard_classes(odd, empty, spark):
    got = {r.doc_id: r for r in jaccard.similarity_classes(odd).collect() if r.doc_id is not None}
    for i, t in ODD:
        if i is not None:
            assert got[i].n_shingles == len(shingles_of(t))
    assert got[11].component_id == got[2].component_id == 2  # same single word
    assert got[4].component_id == 4 and got[1].component_id == 1 and got[5].component_id == 5
    assert jaccard.similarity_classes(empty).count() == 0


def brute_classes(table):
    sets = {i: shingles_of(t) for i, t in table.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def test_jaccard_query_matches_brute_force(spark):
    want = brute_classes(texts())
    got = {r.doc_id: r.component_id for r in QUERIES["op3_ngram_jaccard"](spark, SF).collect()}
    assert got == want


def test_jaccard_finds_every_near_copy_of_a_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(dict(rows))


def test_decontamination_matches_brute_force(spark):
    import pyarrow.parquet as pq

    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    want = set()
    for i, t in texts().items():
        own = shingles_of(t)
        for item in items:
            s = shingles_of(item["text"])
            if s and 100 * len(s & own) >= 75 * len(s):
                want.add((i, item["item_id"], len(s), len(s & own)))
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    assert want
    for limit in (contamination.BLOCK_SHINGLES, 100):  # one block, and many
        assert {tuple(r) for r in contamination.contaminated(docs, bench, limit).collect()} == want


def test_short_items_in_long_documents(spark):
    """Items of 1 to 14 words, each verbatim in a long document: none is missed."""
    rng = np.random.default_rng(12)
    docs, items, want = [], [], set()
    for i in range(80):
        own = [f"w{x}" for x in rng.integers(0, 1 << 30, rng.integers(1_500, 5_000))]
        for n in range(1, 15):
            at = int(rng.integers(0, len(own) - n))
            items.append((100 * i + n, " ".join(own[at : at + n])))
            if n >= 5:
                want.add((i, 100 * i + n))
        docs.append((i, " ".join(own)))
    docs.append((80, items[2][1]))  # nothing but an item of three words
    want.add((80, items[2][0]))
    found = contamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_rows_without_a_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (1, None, "user", "c"), (1, 0, "assistant", "d")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(given)).collect()
    got = sorted((r.conv_id or 0, [(t.role, t.text) for t in r.turns], r.loss_text) for r in back)
    assert got == [
        (0, [("assistant", "b")], "b"), (0, [("user", "a")], ""), (0, [("user", "a")], ""), (1, [("user", "c"), ("assistant", "d")], "d"),
    ]


def test_decontamination_of_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "one"), (None, PASSAGE), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(odd, items).collect()}
    assert got == {(d, i) for d in (8, 9, 10) for i in (1, None)} - {(10, 1), (10, None)} | {
        (d, i) for d in (10,) for i in (1, None)
    } | {(2, 3), (11, 3)}
    assert contamination.contaminated(empty, items).count() == 0
    assert contamination.contaminated(odd, items.where("false")).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a<|end|>\n<\\|turn|>", 1), (1, 1, "assistant", "<|turn|>user\nx", 1), (1, 2, "assistant", None, 1),
        (2, 0, None, "漢字 <|", 1), (2, 0, "assistant", "tie é😀", 1), (None, None, "a\nb\\", "z", 1),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask int")
    read = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("user", rows[0][3]), ("assistant", rows[1][3]), ("assistant", "")]
    assert read[1].loss_text == "<|turn|>user\nx" and read[2].loss_text == "tie é😀"
    assert [(t.role, t.text) for t in read[None].turns] == [("a\nb\\", "z")]
    assert chat.format_conversations(table.where("false")).count() == 0


def test_chat_query(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    rows += [{"conv_id": -7, "turn": k, "role": r, "text": "</s>[INST] ok [/INST]"} for k, r in enumerate(("user", "assistant"))]
    by = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    for r in QUERIES["op4_chat_format"](spark, SF).collect():
        turns = by.pop(r.conv_id)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert not by


def test_fingerprint_query(spark):
    table = texts()
    ids = sorted(table, reverse=True)
    got = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, SF).collect()}
    for k, i in enumerate(ids):
        own, after = table[i] or "", table[ids[(k + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert got[i].n_chars == len(own)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = {}
    for i in ids:
        same.setdefault(table[i], set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    long_texts = [i for i in ids if len(table[i]) > 2000]
    assert np.mean([got[i].near_edited for i in long_texts]) > 0.3 > np.mean([got[i].near_next for i in long_texts])


def brute_hashes(text):
    """Spark's own 64-bit hash of each shingle: of words, then of five word hashes in a chain."""
    from xxhash import xxh64_intdigest

    def chained(*values):
        seed = 42
        for value in values:
            seed = xxh64_intdigest((value % (1 << 64)).to_bytes(8, "little"), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    h = [(v - (1 << 64) if v >> 63 else v) for v in (xxh64_intdigest(w.encode(), 42) for w in words)]
    if 0 < len(h) < 5:
        value = 0
        for x in h:
            value = chained(value, x)
        return {value}
    return {chained(*h[i : i + 5]) for i in range(len(h) - 4)}


def brute_kept(hashes):
    below = {h for h in hashes if h < fingerprints.LIMIT}
    return sorted(below or ([min(hashes)] if hashes else []))


def brute_likeness(one, two):
    if not one or not two:
        return float(not one and not two)
    return len(set(one) & set(two)) / min(len(one), len(two))


def test_fingerprints_likeness_and_merge_match_brute_force(spark):
    table = texts()
    got = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, SF).collect()}
    order = sorted(table, reverse=True)
    errors = []
    for i, after in zip(order, [*order[1:], order[0]]):
        text, other = table[i] or "", table[after] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        sets = [brute_hashes(t) for t in (text, edited, other)]
        own, changed, following = map(brute_kept, sets)
        assert got[i].fingerprint == "".join(f"{h % (1 << 64):016x}" for h in own)
        assert got[i].edited_fingerprint == "".join(f"{h % (1 << 64):016x}" for h in changed)
        assert got[i].near_edited == brute_likeness(own, changed) and got[i].near_next == brute_likeness(own, following)
        if sets[0] and sets[1]:
            errors.append((len(sets[0]), abs(got[i].near_edited - brute_likeness(sets[0], sets[1]))))
    # an estimate from n / SCALE hashes: usable for long texts, rough for short ones
    assert np.mean([e for n, e in errors if n >= 800]) < 0.1
    rows = spark.createDataFrame([(table[a], table[b]) for a, b in zip(order, order[7:])], "a string, b string")
    merged = rows.select("a", "b", fingerprints.merge(fingerprints.fingerprint(rows.a), fingerprints.fingerprint(rows.b)).alias("m"))
    for r in merged.collect():
        assert r.m == brute_kept(brute_hashes(r.a) | brute_hashes(r.b))


def test_fingerprints_of_odd_rows(odd, empty):
    got = fingerprints.fingerprint_pairs(odd).collect()
    assert len(got) == len(ODD) and {r.near_next for r in got if r.doc_id == 2} <= {0.0, 1.0}
    assert all(r.fingerprint == "" for r in got if r.doc_id in (1, 4, 5))
    assert fingerprints.fingerprint_pairs(empty).count() == 0


def test_url_rules(spark):
    rows = [
        (1, "http://A.Example.org/es/1?x#y"), (2, "https://example.org/en/15"), (3, "x://notexample.org/es/"),
        (4, "no scheme"), (5, None), (6, "http://shop.com/de/x"), (7, "http://com/fr/"), (8, "http://a.org"), (9, "http://b.net/en/1"),
    ]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2].rule == "example.org/en/1" and got[3].rule == "org/" and got[6].verdict == "block"
    assert got[7].rule == "com/fr/" and got[8].rule is None and got[9].rule is None
    assert (got[4].host, got[5].path) == ("", "") and {got[i].verdict for i in (4, 5, 9)} <= {"allow", "block"}


def test_url_model_learns_its_rules(spark):
    judged = QUERIES["op6_url_filter"](spark, "/root/testdata/sf0.01").collect()
    ruled = [r for r in judged if r.rule]
    right = sum((r.block_score > 0.5) == (r.verdict == "block") for r in ruled)
    assert right / len(ruled) > 0.95


def test_url_model_on_rows_that_it_was_not_fitted_on(spark):
    judged = QUERIES["op6_url_filter"](spark, "/root/testdata/sf0.1").where("rule IS NOT NULL")
    rows = sorted({(r.host, r.path, r.verdict == "block") for r in judged.collect()})
    fitted, held = rows[::2], rows[1::2]
    weights, bias = urls.fit(fitted)
    right = 0
    for host, path, blocked in held:
        codes = urls.features(host, path)
        right += (bias + weights[codes].sum() / np.sqrt(max(len(codes), 1)) > 0) == blocked
    most = max(sum(b for *_, b in held), sum(not b for *_, b in held))
    assert right / len(held) > 0.85 and right > most


def test_repeats(odd, empty):
    got = paragraphs.repeats(odd).collect()
    removed = {r.doc_id for r in got if r.removed}
    assert removed == {9, 10}
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(odd, paragraphs.repeats(odd)).collect()}
    assert "shared5" in left[8] and "shared5" not in left[9] and left[9] == "Something else first."
    assert left[4] is None and paragraphs.repeats(empty).count() == 0


def test_passages_are_cut_whatever_their_layout(spark):
    rng = np.random.default_rng(6)

    def own(n):
        return [f"u{x}" for x in rng.integers(0, 1 << 40, n)]

    short, middle, bare, ends = (own(60) for _ in range(4))
    lines = ["\n".join(" ".join(short[k : k + 6]) for k in range(0, 60, 6))]
    halves = " ".join(own(40) + ends[:30]) + "\n" + " ".join(ends[30:] + own(40))
    rows = [
        (1, "\n".join(["Début é."] + lines)),
        (2, " ".join(own(30) + middle + own(30)) + "."),
        (3, " ".join(bare)),
        (4, halves),
        (5, "\n".join([" ".join(own(5))] + lines + [" ".join(own(5))])),
        (6, "Ünü. " + " ".join(own(90) + middle + own(20)) + ". End it here."),
        (7, " ".join(own(200) + bare + own(9))),
        (8, " ".join(own(40) + ends[:30]) + "\n" + " ".join(ends[30:] + own(40))),
        (9, " ".join(own(40) + bare[:49] + own(40))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = paragraphs.repeats(docs)
    cut = {(r.doc_id, r.n_words, r.first_doc_id) for r in found.collect() if r.removed}
    assert cut == {(5, 60, 1), (6, 60, 2), (7, 60, 3), (8, 60, 4)}
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(docs, found).collect()}
    for later, passage in ((5, short), (6, middle), (7, bare), (8, ends)):
        assert words_of(left[later]) == [w for w in words_of(dict(rows)[later]) if w not in passage]
    assert all(left[i] == t for i, t in rows if i not in (5, 6, 7, 8))


def test_equal_passages_match_brute_force(spark):
    table = texts()
    found = paragraphs.repeats(spark.read.parquet(f"{SF}/documents.parquet"))
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(spark.read.parquet(f"{SF}/documents.parquet"), found).collect()}
    first = {}
    for i in sorted(left):
        words = words_of(left[i])
        for run in {tuple(words[k : k + 50]) for k in range(len(words) - 49)}:
            # cuts may bring words side by side; only runs that the given text has count
            if " ".join(run) in " ".join(words_of(table[i])):
                assert first.setdefault(run, i) == i


def test_shards(odd, empty, spark):
    rows = sorted(QUERIES["op8_byte_shards"](spark, SF).collect(), key=lambda r: r.doc_id)
    table = texts()
    assert all(r.size == len((table[r.doc_id] or "").encode()) + 1 for r in rows)
    assert all(r.text_crc32 == zlib.crc32((table[r.doc_id] or "").encode()) for r in rows)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) <= 2 * max(r.size for r in rows)
    for s in range(8):
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    placed = shards.byte_shards(odd, 4).collect()
    assert len(placed) == len(ODD) and {r.shard for r in placed} <= set(range(4))
    assert shards.byte_shards(empty).count() == 0


def test_language_of_odd_rows(odd, empty):
    model = langid.fit(odd)
    assert model.langs == ["en"]
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model, spans=True).collect()}
    assert {i for i, lang in got if lang == "und"} == {1, 4, 5, 12, None}
    assert {lang for i, lang in got if i in (2, 7, 10)} == {"en"}
    nothing = langid.identify(odd, langid.fit(empty)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and langid.identify(empty, model).count() == 0


def test_language_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert np.mean([known[r.doc_id] == r.lang_pred for r in got]) > 0.97
    model = langid.fit(docs)
    samples = {r.lang: " ".join(r.text.split()[:40]) for r in docs.where("n_chars > 800").collect()}
    text = samples["de"] + "\n" + samples["fr"]
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = langid.identify(frame, model, spans=True).first().spans
    assert {"de", "fr"} <= {s.lang for s in spans}


def test_viterbi_matches_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    scores, sizes = rng.normal(size=(9, 3)).astype(np.float32), np.array([4, 0, 5])
    got = langid.best_paths(scores, sizes, 1.5)
    for part in (slice(0, 4), slice(4, 9)):
        own = scores[part]

        def value(path):
            return own[range(len(path)), path].sum() - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(3), repeat=len(own)), key=value)
        assert list(best) == got[part].tolist()


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n in (3, 40, 400, 4000):
        whole = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.1, 0.5, 0.9):
            a, b = (whole[rng.random(len(whole)) < share] for _ in range(2))
            pairs = zip(paragraphs.parities([a])[0].tolist(), paragraphs.parities([b])[0].tolist())
            differ = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in pairs)
            assert differ <= len(np.setxor1d(a, b))


def test_near_paragraphs_of_a_large_group(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    found = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'paragraph'")
    roots = brute_classes(dict(rows))
    near = {i for i, root in roots.items() if list(roots.values()).count(root) > 1}
    assert {r.doc_id: r.first_doc_id for r in found.collect()} == {i: roots[i] for i in near}


def test_words_of_a_batch_are_hashed_as_those_of_each_text():
    from palisade.llm import words

    long = b"x" * (words.CHUNK - 3)
    batch = [b"", b" a B\n\nb\tA\x0bb ", b"\n", long + b" " + "漢字é".encode() + b" cut " + b"Q" * 65, b"q" * 65 + b" CUT"]
    seen = {}
    for text, (hashes, sizes) in zip(batch, words.hashed_lines(batch)):
        assert sizes.tolist() == [len(line.split()) for line in text.split(b"\n")]
        assert len(hashes) == len(text.split()) and (hashes == words.word_hashes(text)).all()
        for word, value in zip(text.lower().split(), hashes.tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_only_texts_that_hold_a_wanted_set_are_cut_into_words(spark):
    docs = spark.createDataFrame([(i, f"text {i} of a few words") for i in range(40)], "doc_id long, text string")
    wanted = docs.where("doc_id < 2").select(jaccard.text_key().alias("row"))
    nodes = [jaccard.node_of(s) for s in jaccard.shingle_sets([b"text 0 of a few words", b"text 1 of a few words"])]
    wanted = wanted.crossJoin(spark.createDataFrame([(n,) for n in nodes], "node long"))

    def cut(texts):
        assert len(texts) <= 4, "a filter of 1 MBit lets hardly any other text through"
        return jaccard.shingle_sets(texts)

    assert {r.node for r in jaccard.sets_of(docs.coalesce(1), wanted, cut).collect()} == set(nodes)


def test_rare_shingles_are_told_apart_in_a_large_corpus():
    # 50 million counts of shingles of one text each; one shingle is in ten texts
    counts = np.full(jaccard.SKETCH, 50_000_000 // jaccard.SKETCH, dtype=np.uint32)
    counts[7] += 10
    levels = jaccard.rarity(counts)
    assert levels[7] == 1 and levels[8] == 0
    full = np.array([65_535, 3, 0], dtype=np.uint16)
    jaccard.count(full, np.array([2, 0, 2, 1]))
    assert full.tolist() == [65_535, 4, 2]


def test_passages_leave_few_tables_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_folder", lambda spark: f"file://{tmp_path}")
    line = " ".join(f"w{i}" for i in range(80))
    rows = [(2, f"x {line} y"), (1, line), (1, f"other {line}"), (None, f"z\n{line}"), (3, line)]
    found = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    # the tables of paragraphs, anchors and runs are gone before the result is written
    names = [spark.read.parquet(str(p)).columns for p in tmp_path.glob("palisade-*")]
    assert not any("bands" in n or "line" in n and "hash" in n for n in names)
    assert {r.doc_id for r in found.collect() if r.removed} >= {2, 3}
