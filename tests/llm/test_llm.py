"""Operators against brute force on small tables with nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidewire.llm import chat, quality, sharding, warc
from tidewire.llm.common import Scratch
from tidewire.llm.exact_dedup import exact_dedup
from tidewire.llm.fingerprints import edited_fingerprints
from tidewire.llm.minhash_dedup import near_duplicates
from tidewire.llm.packing import pack, pack_group
from tidewire.llm import sentencepiece as lattices
from tidewire.llm.sentencepiece import encode, encode_decode, merge_word, piece_rows, unigram_words
from tidewire.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, key string, run int, place int, score double, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    """Rows with every edge case; extra columns clash with the operators' own."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["é ü", "日本語", "A", "a", "Straße"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(40)]
    out = [None, "", "   \t\n", "one", "two words", base[0], base[0], base[0] + " more", base[1].upper(), base[1]]
    out += base
    shared = " ".join(rng.choices(vocab, k=45))
    out += [f"{base[i]} {shared} {base[i + 1]}" for i in range(2, 10)] + [shared, shared + " " + shared]
    for i in range(10, 20):
        changed = base[i].split(" ")
        if len(changed) > 40:
            changed[7] = "changed"
            out.append("  ".join(changed))
    out.append(" ".join(rng.choices(vocab, k=30_000)))
    out.append("x" * 50_000)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "k", i, i, 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, texts, keep):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    best = min if keep == "smallest" else max
    got = {r.doc_id: r for r in exact_dedup(docs, keep=keep).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (
            best(g), len(g), i == best(g), sha(t or ""))


def test_exact_dedup_hot_group_and_repeated_rows(spark):
    rows = [(i % 900, "same" if i % 3 == 0 else f"t{i % 50}") for i in range(3000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == 3000
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t for _, t in rows})
    sizes = collections.Counter(t for _, t in rows)
    assert {(r.text_sha256, r.group_size) for r in got} == {(sha(t), n) for t, n in sizes.items()}


def brute_substring(texts, size):
    seen = collections.Counter()
    for t in texts:
        w = words(t)
        seen.update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = {}
    for n, t in enumerate(texts):
        w, gone = words(t), set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        out[n] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("flush", [4 << 20, 64])
def test_substring_dedup(docs, texts, flush):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, size=12, flush=flush).collect()}
    assert got == brute_substring(texts, 12)


def test_substring_dedup_text_and_repeated_ids(spark):
    text = " ".join(f"a{i}" for i in range(20))
    rows = [(1, text + "\nown tail", "x"), (1, "head\t" + text, "y"), (None, "alone", "z")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, row string"), size=10, with_text=True)
    assert sorted((r.kept_text, r.row.row) for r in got.collect()) == [("alone", "z"), ("head\t", "y"), ("own tail", "x")]


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute_near(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, texts, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words_each=k).collect()}
    assert got == brute_near(texts, k, 80)


def test_near_duplicates_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for _ in range(150):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(0, 9)):
            w[at] = rng.choice(["p", "q", "r"])
        rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words_each=4).collect()}
    assert got == brute_near(rows, 4, 80)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = pack(docs, path, capacity=512, most_documents=512, most_cost=512.0**2).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and list(own.start) == list(range(0, len(ids), 512))
        assert [zlib.crc32(np.array(ids[a:a + 512], "<u4").tobytes()) for a in own.start] == list(own.ids_crc32)
    placed = got.sort_values(["sequence_id", "offset"])
    total = placed.groupby("sequence_id").length
    assert (placed.offset == total.cumsum() - placed.length).all() and total.sum().max() <= 512
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 512 + 1


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_packing_keeps_every_constraint(select):
    length = np.random.default_rng(1).integers(1, 100, 500)
    sequence, offset = pack_group(length, (100, 5, 4000.0 + 100**2), (1, 0.1, 0.1), select)
    for s in set(sequence):
        own = length[sequence == s]
        assert own.sum() <= 100 and len(own) <= 5 and (own**2).sum() <= 14000
        assert sorted(offset[sequence == s]) == sorted(np.cumsum(own[np.argsort(offset[sequence == s])]) -
                                                       own[np.argsort(offset[sequence == s])])


def test_sharding(docs, texts):
    got = sharding.shard(docs, shards=4).toPandas()
    assert sorted(got.doc_id) == list(range(len(texts)))
    for i, t in enumerate(texts):
        r = got[got.doc_id == i].iloc[0]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_sharding_splits_a_hot_group_and_rebalances(spark, tmp_path):
    rows = [(i, "copy" * 50 if i % 3 == 0 else f"text {i} " * 20) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, shards=8).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(got) == 8 and got.max() <= 1.02 * got.mean()
    bytes_ = sharding.slot_bytes(sharding.sized(df), 8)
    path = str(tmp_path / "maps")
    sharding.store_map(sharding.first_map(bytes_, 8), path)
    sharding.store_map(sharding.rebalance(sharding.load_map(spark, path), 9), path)
    old, new = (sharding.load_map(spark, path, v).toPandas().set_index(["vslot", "part"]) for v in (0, 1))
    assert sharding.load_map(spark, path).first().version == 1 and len(old) == len(new)
    moved = new[new.shard != old.shard.reindex(new.index)]
    assert set(new.shard) == set(range(9)) and moved.bytes.sum() <= 0.2 * new.bytes.sum()
    assert new.groupby("shard").bytes.sum().max() <= 1.1 * new.bytes.sum() / 9


def test_sharding_places_new_rows_by_a_stored_map(spark, tmp_path):
    old = [(i, "one long document " * 20_000 if i == 0 else f"text {i}") for i in range(300)]
    new = spark.createDataFrame([(1000 + i, old[0][1] if i < 40 else f"new text {i}") for i in range(3000)],
                                "doc_id long, text string")
    rows = sharding.sized(spark.createDataFrame(old, "doc_id long, text string"))
    path = str(tmp_path / "maps")
    sharding.store_map(sharding.first_map(sharding.slot_bytes(rows, 8), 8), path)
    sharding.store_map(sharding.rebalance(sharding.load_map(spark, path), 9), path)
    for version, shards in ((0, 8), (1, 9)):
        stored = sharding.load_map(spark, path, version)
        slots = stored.toPandas()
        assert set(slots.vslot) == set(range(sharding.SLOTS)) and slots.parts.max() >= 8
        assert all(sorted(own.part) == list(range(own.parts.iloc[0])) for _, own in slots.groupby("vslot"))
        empty = slots[slots.bytes == 0].groupby("shard").size()
        assert len(empty) == shards and empty.max() - empty.min() <= shards
        got = sharding.shard(new, slot_map=stored).toPandas()
        assert sorted(got.doc_id) == list(range(1000, 4000)) and set(got.shard) == set(range(shards))
    partial = sharding.load_map(spark, path, 0).where("bytes > 0")
    with pytest.raises(Exception, match="no shard in the slot map"):
        sharding.shard(new, slot_map=partial).collect()


def test_quality_learns_and_scores_all(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(100_000, None), (100_001, ""), (None, "word")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    model = quality.train(docs, labels)
    got = quality.score(docs, model).withColumn("held", quality.held_out("doc_id")).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    test = got[got.held.fillna(False).astype(bool)].merge(labels.toPandas(), on="doc_id")
    assert ((test.score >= 0.3) == (test.quality == 1)).mean() > 0.93
    assert quality.train(docs, labels.where("false")) == {"constant": 1.0}


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in edited_fingerprints(docs, samples=32).collect()}
    order = sorted(range(len(texts)), reverse=True)
    seen = {}
    errors = []
    for n, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(edited))
        assert seen.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        a, b = collections.Counter(words(t)), collections.Counter(words(edited))
        if a and b:
            errors.append(got[i].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.15


def test_warc_round_trip(spark):
    same = "<p>" + "x" * 200
    rows = [(1, "http://a/ü b", same), (2, None, same), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "v", "short"),
            (7, "w", "é" * 80_000), (8, "w", same), (8, "w", same), (None, "n", "y" * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = Scratch(spark, "warc-test").root
    manifest = warc.write_warc(df, folder, roll_bytes=500)
    assert manifest.count() > 1
    got = warc.read_warc(spark, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
        assert r.payload_digest in {sha(h or "") for _, _, h in rows}
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    assert by[1][0].record_type == "response" and by[2][0].refers_to == 1
    assert [r.refers_to for r in by[8]] == [1, 1] and by[5][0].record_type == by[6][0].record_type == "response"
    assert by[7][0].payload_bytes == 160_000 and by[None][0].payload_bytes == 150


def test_warc_is_deterministic(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i % 7} " * 40) for i in range(200)], "page_id long, url string, html string")
    one, two = (warc.write_warc(df.repartition(n), Scratch(spark, "warc-test").root, roll_bytes=2000) for n in (2, 7))
    assert sorted(one.collect()) == sorted(two.collect())


def test_warc_is_deterministic_beyond_the_range_sample(spark):
    rows = [(None if i % 997 == 0 else (i * 7919) % 20_011, f"u{i}", f"p{i % 9000}" * (60 if i % 50 == 0 else 2))
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    results, limit = [], "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    with_conf = {limit: "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for partitions in (2, 5):
        old = {k: spark.conf.get(k) for k in with_conf}
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        folder = Scratch(spark, "warc-test").root
        results.append(sorted(warc.write_warc(df.repartition(partitions), folder, roll_bytes=40_000,
                                              shard_bytes=2_000_000).collect()))
        for k, v in old.items():
            spark.conf.set(k, v)
    assert results[0] == results[1] and sum(r.records for r in results[0]) == len(rows)
    shards = {r.file.split("-")[1] for r in results[0]}
    assert shards == {f"{i:06d}" for i in range(len(shards))} and len(shards) >= 5
    assert warc.read_warc(spark, folder).count() == len(rows)


def test_chat(spark):
    odd = "<|im_end|>\n<|im_start|>assistant <\\| <\\\\| \\"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", ""), (2, 0, "ro\nle", None),
            (2, 0, None, "x"), (None, 1, "assistant", "n")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, spans string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert set(got) == {1, 2, None}
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1))
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(odd), sha(odd))
    assert got[2].turns_sha256 == sha("\nx\nro\nle\n\n") and got[2].loss_chars == 0
    assert chat.digests(chat.format_chats(df.where("false"))).count() == 0


def test_chat_templates():
    turns = [("user", "a<|x"), ("assistant", "b")] * 100
    formatted, spans, breaks = chat.locate(turns)
    assert breaks is None and [formatted[c:d] for _, _, c, d in spans] == [chat.escape(t) for _, t in turns]
    assert chat.read_chatml(formatted) == turns
    last_only = lambda ts: "".join(f"[{r}]{t if i == len(ts) - 1 else '...'}" for i, (r, t) in enumerate(ts))
    assert chat.locate(turns, last_only)[2] == 1
    counted = lambda ts: "".join(f"{i}:{t};" for i, (_, t) in enumerate(ts))  # noqa: E731  far turns need all before them
    formatted, spans, breaks = chat.locate(turns, counted)
    assert breaks is None and all(formatted[c:d] == t for (_, _, c, d), (_, t) in zip(spans, turns, strict=True))


@pytest.mark.parametrize("before", [10, 100])
def test_chat_names_a_rewriting_turn_at_any_length(spark, before):
    def pending(turns):
        """Notes an unanswered tool turn while it is the last, if a system turn is first."""
        note = "(pending)" if turns and turns[0][0] == "system" and turns[-1][0] == "tool" else ""
        return "".join(f"[{r}]{t}" for r, t in turns) + note

    turns = [("system", "s"), *[("user", f"u{i}") for i in range(before)], ("tool", "call"), ("assistant", "done")]
    assert chat.locate(turns, pending)[2] == before + 2
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df, pending).first().rewrites == before + 2
    assert chat.locate(turns[:-2], pending)[2] is None


def test_sentencepiece_equals_the_library(docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.ids for r in encode(docs, path).collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.decoded_sha256 for r in encode_decode(docs, path).collect()}
    assert back == {i: sha(t or "") for i, t in enumerate(texts)}
    pieces = {p: (i, s) for p, i, s in piece_rows(path)[0]}
    assert merge_word("▁hello", pieces, []) == sp.encode("hello")


def test_sentencepiece_words_end_where_no_piece_crosses(spark, monkeypatch):
    import sentencepiece

    path, asked, encode_words = public_tokenizers.path("piece_bpe_32k.model"), [], lattices.encode_words
    texts_ = [f"the{a}{x}{b}.\n{c}日{a} {'=' * 70}{b}{'ab' * 40}" for x in "7%~" for a in ("tion", "ing", "é") for b in ("er", "ly", "")
              for c in ("On", "Of")] + ["", None, " ", "  a", "a\n"]

    def keep(words, *more):
        asked.append(words)
        return encode_words(words, *more)

    monkeypatch.setattr(lattices, "encode_words", keep)
    monkeypatch.setattr(lattices, "CHUNK", 500)
    rows = [(i, t) for i, t in enumerate(texts_)] + [(None, "the ing"), (0, texts_[0])]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == sorted((str(i), sp.encode(t or "")) for i, t in rows)
    assert asked[0].count() < 40 < len({w for t in texts_ for w in re.findall("▁*[^▁]+|▁+", "▁" + (t or "").replace(" ", "▁"))})
    # a chunk's block is exchanged once, for its words and for its texts
    assert "ReusedExchange" in got._jdf.queryExecution().toString()


def test_sentencepiece_packs_come_back():
    for arrays in ([[], []], [[1, 2**32 - 1, 70000], [], [5]], [[0]]):
        assert [x.tolist() for x in lattices.unpack(lattices.pack(*arrays))] == arrays


UNIGRAM = [(p, i, s) for i, (p, s) in enumerate(
    [("a", -1.0), ("b", -2.0), ("c", -6.0), ("ab", -2.5), ("bc", -3.0), ("abc", -7.0), ("ca", -3.5), ("bca", -4.0),
     ("aa", -2.0), ("日", -3.0), ("日本", -4.0), ("本語", -4.25), ("▁", -1.5), ("▁a", -2.0)])]


def brute_viterbi(word, rows, unknown, of_byte):
    """Best sum of scores; on ties the earlier start of the last piece, then of those before."""
    pieces, best = {p: (i, s) for p, i, s in rows}, [(0.0, [])]
    for stop in range(1, len(word) + 1):
        ways = []
        for start in range(stop):
            own = pieces.get(word[start:stop])
            if own or stop - start == 1:
                ids = [own[0]] if own else [of_byte[b] for b in word[start:stop].encode()]
                ways.append((best[start][0] + (own[1] if own else unknown), -start, best[start][1] + ids))
        score, _, ids = max(ways)
        best.append((score, ids))
    return best[-1][1]


def test_unigram_fold_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    of_byte, low = list(range(100, 356)), -17.0
    some = [62, 63, 64, 255, 256, 257, 1500] + [rng.randint(1, 40) for _ in range(200)]
    texts_ = sorted({"".join(rng.choices("abca日本語é", k=n)) for n in some})
    pieces = spark.createDataFrame(UNIGRAM, "piece string, id int, score double")
    got = unigram_words(spark.createDataFrame([(w,) for w in texts_], "word string"), pieces, 3, low, of_byte)
    assert {r.word: r.ids for r in got.collect()} == {w: brute_viterbi(w, UNIGRAM, low, of_byte) for w in texts_}
    # whole texts, long words with the short ones
    monkeypatch.setattr(lattices, "piece_rows", lambda _: (UNIGRAM, []))
    monkeypatch.setattr(lattices, "byte_ids", lambda _: of_byte)
    docs = [(i, t + " ab " + t[:5]) for i, t in enumerate(texts_)] + [(-1, None), (-2, "")]
    got = {r.doc_id: r.ids for r in encode(spark.createDataFrame(docs, "doc_id long, text string"), "", kind="unigram").collect()}
    assert got == {i: [x for w in re.findall("▁*[^▁]+|▁+", "▁" + t.replace(" ", "▁") if t else "")
                       for x in brute_viterbi(w, UNIGRAM, min(s for _, _, s in UNIGRAM) - 10.0, of_byte)] for i, t in docs}


def test_empty_tables(spark, empty):
    for result in (exact_dedup(empty), substring_dedup(empty), near_duplicates(empty), sharding.shard(empty),
                   pack(empty, public_tokenizers.path("word_bpe_49k.json")), edited_fingerprints(empty),
                   quality.score(empty, {"constant": 1.0}), encode(empty, public_tokenizers.path("piece_bpe_32k.model"))):
        assert result.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = Scratch(spark, "warc-test").root
    warc.write_warc(pages, folder)
    assert warc.read_warc(spark, folder).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs, tables = spark.read.parquet(f"{d}/documents.parquet"), Scratch(spark, "pipeline-test")
    columns, before = docs.columns, None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.select("doc_id", "text").collect()
        docs = tables.table(stage(spark, docs, d), str(n))
        if name != "best-fit packing":
            assert docs.columns == columns
            out = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if name == "exact dedup":
            last = {r.text: r.doc_id for r in sorted(rows, key=lambda r: r.doc_id)}
            assert set(out) == set(last.values())
        if name == "minhash near-dedup":
            near = brute_near_ids(rows)
            assert set(out) == {i for i, (_, _, kept) in near.items() if kept}
        if name == "substring dedup":
            cut = brute_substring([r.text for r in rows], 35)
            assert {i: sha(" ".join(words(t))) for i, t in out.items()} == {
                r.doc_id: cut[k][2] for k, r in enumerate(rows)}
        before = before or len(rows)
    assert docs.select("doc_id").distinct().count() == len(out) < before


def brute_near_ids(rows):
    sets = {r.doc_id: shingles(r.text, 5) for r in rows}
    owners = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    pairs = {(a, b) for own in owners.values() for a in own for b in own if a < b}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
