"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from quillspark.llm import bpe, chat, components, decontaminate, linededup, lm, queries, simhash, suffixes, syncmers, toxicity, warc
from quillspark.llm import words as W

SMALL = "/root/testdata/sf0.001"
ODD = [(0, ""), (1, None), (2, "one"), (3, "One  two\tthree\n\nfour five"), (4, "one two three four five"), (4, "one two three four five"), (None, "x y"), (7, "é ñ 漢字 😀 " * 40), (8, "a" * 3000), (9, "word " * 3000)]


def frame(spark, rows=ODD):
    """Odd texts, with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", "p", "l", 2, 0.5, "g") for i, t in rows], "doc_id long, text string, lang string, fp string, n int, key string, place string, lost string, toxic int, score double, gone string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)


def texts():
    t = pq.read_table(f"{SMALL}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


# -- words


def test_hashes_are_xxh64():
    column = pa.array([t for _, t in ODD] + ["w" * 37 + " " + "v" * 70, " lead", "trail "])
    for part in W.chunks(column):
        b = W.split(part)
        for k in (1, 4):
            s, e, f = W.shingles(b, k)
            h = W.xxh64(b.data, s, e)
            for i, t in enumerate(part.to_pylist()):
                assert h[f[i] : f[i + 1]].tolist() == [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(t, k)]


def test_chunks_cover_slices():
    column = pa.array(["abc d"] * 50).slice(7, 20)
    assert sum(W.split(p).docs for p in W.chunks(column)) == 20


# -- op1


def test_language_model(spark):
    rows = texts()
    got = {r.doc_id: r for r in queries.op1_lm(spark, SMALL).collect()}
    train, toks = Counter(), {}
    for i, t in rows:
        toks[i] = words(t) + [None]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(toks[i])
    n, v = sum(train.values()), len(train)
    for i, w in toks.items():
        base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].n_tokens == len(w)
        assert got[i].n_known == sum(train[x] > 0 for x in w) and got[i].train_tokens == n
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_prefers_known_words(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(["a b", "a c", "b a", "c a b", "a", "b b"] * 5)]
    docs = spark.createDataFrame([*rows, (100, "a"), (101, "zzz"), (102, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 100).collect()}
    assert 0 > got[100] > got[101]


def test_em_prefers_what_predicts():
    w = lm.learn([(3, lm.NONE, 80, 8, 900), (3, lm.NONE, lm.NONE, 8, 100), (0, lm.NONE, lm.NONE, 16, 50), (44, 90, 20, 8, 70)])
    assert w[3][1] > 0.5 and w[44][0] > 0.5 and np.allclose(w.sum(axis=1), 1) and (w > 0).all()


def test_scores_are_the_mixture(spark):
    """Given weights, the score is the interpolation of relative frequencies, by brute force."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(4)
    rows = [(i, " ".join(r.choice(list("abcdef"), int(r.integers(0, 9))))) for i in range(60)]
    weights = r.random((2 * lm.BUCKETS, 4))
    got = {x.doc_id: x.score for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 40, weights=weights).collect()}
    grams = [Counter(), Counter(), Counter()]
    padded = {i: [None, None, *t.split(), None] for i, t in rows}
    for i, t in padded.items():
        if i < 40:
            for k in range(3):
                grams[k].update(tuple(t[j - k : j + 1]) for j in range(2, len(t)))
    n, v = sum(grams[0].values()), len(grams[0])
    power = lambda c: min(int(math.log2(c)) + 1, lm.BUCKETS - 1)
    for i, t in padded.items():
        want = 0.0
        for j in range(2, len(t)):
            last = grams[0][(t[j - 1],)]
            pair = grams[0][(None,)] if j == 2 else grams[1][tuple(t[j - 2 : j])]
            w = weights[lm.BUCKETS + power(pair) if pair else power(last) if last else 0].copy()
            w[0], w[1] = w[0] * (pair > 0), w[1] * (last > 0)
            p = [grams[2][tuple(t[j - 2 : j + 1])] / max(pair, 1), grams[1][tuple(t[j - 1 : j + 1])] / max(last, 1), grams[0][(t[j],)] / n, 1 / (v + 1)]
            want += math.log10(sum(a * b for a, b in zip(w, p, strict=True)) / w.sum())
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_language_model_odd_rows(spark):
    from pyspark.sql import functions as F

    got = lm.score(frame(spark), F.lit(True)).collect()
    assert len(got) == len(ODD) and sorted(r.n_tokens for r in got)[:2] == [1, 1]
    assert [r.score for r in lm.score(frame(spark), F.lit(False)).collect()] == [0.0] * len(ODD)
    assert lm.score(frame(spark, []), F.lit(True)).count() == 0


def test_packing():
    v = np.array([0, 1, 255, 256, 2**40], dtype=np.uint64)
    assert lm.unpack(lm.pack(v), 5)[0].tolist() == v.tolist() and lm.unpack_sorted(lm.pack_sorted(v), 5)[0].tolist() == v.tolist()


# -- op2


def smallest(n, edges, ids):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    least = defaultdict(list)
    for i in range(n):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) for i in range(n)]


def fingerprint(text, k=4):
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(text, k)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def check_simhash(spark, rows, got):
    fp = [fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    want = smallest(len(rows), edges, [i for i, _ in rows])
    assert sorted(got, key=str) == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fp, want, strict=True)), key=str)


def test_simhash(spark):
    check_simhash(spark, texts(), [tuple(r) for r in queries.op2_simhash(spark, SMALL).collect()])


def test_simhash_odd_rows(spark):
    check_simhash(spark, ODD, [tuple(r) for r in simhash.near_duplicates(frame(spark)).collect()])
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [5, 20_000])
def test_links_connect_all_within_radius(spark, block):
    r = np.random.default_rng(3)
    centre = r.integers(0, 2**63, 40, dtype=np.uint64)
    fp = set()
    for c in centre.tolist():
        for _ in range(12):
            x = c
            for b in r.integers(0, 64, r.integers(0, 6)).tolist():
                x ^= 1 << b
            fp.add(x)
    fp = sorted(fp)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fp], "w0 long").selectExpr("w0 as node", "w0")
    rows = simhash.links(df, 4, block=block).collect()
    at = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(fp)}
    assert all((fp[at[x.a]] ^ fp[at[x.b]]).bit_count() <= 4 for x in rows)
    want = smallest(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4], list(range(len(fp))))
    assert smallest(len(fp), [(at[x.a], at[x.b]) for x in rows], list(range(len(fp)))) == want


def test_plan_covers_the_radius():
    sample = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (10, 10**5, 10**8):
        for radius in (0, 3, 4, 9):
            p = simhash.make_plan(sample, n, radius)
            assert sum(t + 1 for t in p.limits) == radius + 1 and sorted(sum(p.parts, [])) == list(range(64))


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (8, 7), (3, 1), (4, None)], "a long, b long")
    assert sorted(map(tuple, components.components(df).collect())) == [(2, 1), (3, 1), (8, 7), (9, 7)]


def test_thin_keeps_one_of_each_group(spark):
    rows = texts()
    kept = simhash.thin(spark.read.parquet(f"{SMALL}/documents.parquet")).select("doc_id", "text").collect()
    ids = {r.doc_id for r in kept}
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    assert len({r.text for r in kept}) == len(kept)
    assert all(first[t] in ids or i not in ids for i, t in rows)
    copy = [(1, "a b c d e f g h i j " * 9), (2, "a b c d e f g h i j " * 9), (None, "q"), (None, "q"), (5, "w")]
    assert sorted((r.doc_id or -1) for r in simhash.thin(frame(spark, copy)).collect()) == [-1, -1, 1, 5]


def test_thin_is_exact_similarity(spark):
    r = np.random.default_rng(5)
    rows = [(1000, ""), (1001, None), (1002, "a b"), (1003, "A  b"), (1004, "x y z " * 40 + "end"), (1005, "x y z " * 5 + "end")]
    for g in range(40):  # edits that leave similarities around 0.8
        base = [f"g{g}w{k}" for k in range(int(r.integers(30, 300)))]
        for c in range(4):
            own = list(base)
            for at in r.integers(0, len(own), max(1, round(len(own) * 0.007 * c))).tolist():
                own[at] = f"e{g}c{c}a{at}"
            rows.append((g * 4 + c, " ".join(own) + " one line that stands in all of the texts here"))
    sets = [set(shingles(t, 5)) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = smallest(len(rows), edges, [i for i, _ in rows])
    assert 60 < len(edges) < 240
    kept = {x.doc_id for x in simhash.thin(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for (i, _), c in zip(rows, want, strict=True) if i == c}


# -- op3


def test_lines(spark):
    line = "a long line of eight words stands here now"
    rows = [(3, "A long  line of eight words stands here now\nshort\n"), (1, line + "\nshort"), (2, None), (4, ""), (5, f"x\n{line}\n{line}\ny")]
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[3].n_removed, got[5].n_removed) == (0, 2, 2)
    assert got[3].kept == "" and got[5].kept == "x\ny" and [tuple(s) for s in got[3].removed] == [(0, 50)]
    assert got[2].kept == "" and linededup.dedup(frame(spark, [])).count() == 0
    assert linededup.dedup(frame(spark)).count() == len(ODD)
    assert {r.doc_id: r.kept for r in linededup.dedup(frame(spark, rows), min_words=8).collect()}[3] == "short\n"


def test_sentences_inside_lines(spark):
    """A passage in the middle of different lines goes, but for the part sentences at its ends."""
    passage = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen!"
    rows = [(1, f"Before it. {passage} After."), (2, f"Another start. {passage} And another end."), (3, "Before it.")]
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, rows)).collect()}
    assert got[1].kept == rows[0][1] and got[2].kept == "Another start. And another end." and got[2].n_removed == 2 and got[3].n_removed == 0
    assert got[1].longest_repeat == got[2].longest_repeat == len(passage) + 1 and got[3].longest_repeat == 0
    assert {r.doc_id: r.n_removed for r in linededup.dedup(frame(spark, rows), sentence_words=0).collect()} == {1: 0, 2: 0, 3: 0}


def test_paragraphs():
    assert list(linededup.spans("a\nb\n\n\nc", "paragraph")) == [(0, 6), (6, 7)] and list(linededup.spans("", "line")) == []


# -- op4


def test_toxicity_learns(spark):
    r = np.random.default_rng(0)
    bad, plain = ["idiot", "scum"], [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        w = r.choice(plain, 30).tolist()
        y = i % 4 == 0
        if y:
            w[int(r.integers(0, 30))] = bad[i % 8 // 4]
        docs.append((i, " ".join(w)))
        labels.append((i, int(y)))
    got = toxicity.classify(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in got if x.held_out]
    right = np.mean([(x.score >= 0.5) == (x.doc_id % 4 == 0) for x in held])
    assert right > 0.9 and all(0 <= x.score <= 1 for x in got)


def test_toxicity_cuts_for_the_whole_mix(spark):
    """A word that one clean text in seven has is a bad sign among as many toxic texts, not among a ninth; the sample's bound must not matter."""
    r = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(5400):
        y = i % 9 == 0
        w = r.choice([f"w{k}" for k in range(50)], 20).tolist()
        if y and r.random() < 0.6:
            w[3] = "scum"
        if r.random() < (0.6 if y else 0.15):
            w[7] = "meh"
        docs.append((i, " ".join(w)))
        labels.append((i, int(y)))
    got = toxicity.classify(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"), per_class=400).collect()
    toxic, said = np.array([x.doc_id % 9 == 0 for x in got]), np.array([x.predicted == 1 for x in got])
    assert 2 * (toxic & said).sum() / (toxic.sum() + said.sum()) > 0.72


def test_toxicity_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(frame(spark), none).collect()
    assert len(got) == len(ODD) and {x.score for x in got} == {0.0} or all(x.score < 1e-6 for x in got)
    some = spark.createDataFrame([(2, 1), (3, 0), (2, 0), (8, None), (99, 1)], "doc_id long, toxic int")
    assert toxicity.classify(frame(spark), some).count() == len(ODD)
    assert toxicity.classify(frame(spark, []), some).count() == 0
    left = toxicity.reject(frame(spark), some)
    assert left.columns == frame(spark).columns and {r.score for r in left.collect()} <= {0.5}


# -- op5


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(queries.vocabulary())


def test_bpe_is_the_library(spark, library):
    rows = texts() + [(1000 + i, t) for i, t in enumerate(["", None, "ΑΣ aaaaaaa ab'S <|endoftext|>x<|endoftext|", "İ ı é \u0ca0 \U0001fae8\U0001e030", "!!!???...", "a" * 500, "日本語 テキスト", "\u1c89 \ua7da", "it's we'll 1234"])]
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark, rows), queries.vocabulary()).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].decoded == text and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_automaton_of_a_small_vocabulary():
    """All strings up to seven symbols over two letters, against merging by rank."""
    symbols = [(b"a", False), (b"a", True), (b"b", False), (b"b", True)]
    merges = [(0, 0), (0, 2), (4, 4), (4, 1), (5, 4), (0, 3)]
    auto = bpe.compile_merges(symbols, merges, list(range(10)), {i: str(i) for i in range(10)}, {})
    rank = {m: k for k, m in enumerate(merges)}
    for n in range(1, 8):
        for bits in range(2**n):
            word = bytes(b"ab"[bits >> i & 1] for i in range(n))
            ids = [{97: 0, 98: 2}[c] for c in word]
            ids[-1] += 1
            while pairs := [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]:
                k, i = min(pairs)
                ids[i : i + 2] = [4 + k]
            assert auto.encode_word(word) == ids, word


# -- op6


def brute_anchors(text, k=16, s=5):
    """Distinct closed syncmers by definition: hash to first position, with plain integers."""
    top = 1 << 64

    def spread(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % top
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 % top
        return h ^ h >> 33

    def value(part):
        h = 0
        for c in part:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) % top
        return spread(h)

    small = [value(text[i : i + s]) for i in range(len(text) - s + 1)]
    out = {}
    for i in range(len(text) - k + 1):
        inside = small[i : i + k - s + 1]
        if min(inside) in (inside[0], inside[-1]):
            out.setdefault(value(text[i : i + k]) >> 32, i)
    return out or {int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "little"): 0}


def brute_likeness(one, other):
    shifts = Counter(one[h] - other[h] for h in one.keys() & other.keys())
    return max(shifts.values(), default=0) / len(one.keys() | other.keys())


def test_syncmers(spark):
    rows = [(i, t) for i, t in texts() if len(t or "") < 5000] + [(9001, ""), (9002, None), (9003, "ab"), (9004, "x" * 50), (9005, "x" * 50), (1 << 40, "an id far from the others, " * 3)]
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(frame(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, following = map(brute_anchors, (t, edited, after))
        for want, fp in ((own, r.fingerprint), (changed, r.edited_fingerprint)):
            assert dict(zip(*(x.tolist() for x in syncmers.parse(fp)), strict=True)) == want
        assert r.near_edited == pytest.approx(brute_likeness(own, changed)) and r.near_next == pytest.approx(brute_likeness(own, following))
    long = [r for i, r in got.items() if r.n_chars > 400 and i < 9000]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2


def test_syncmers_are_context_free():
    inner = "the quick brown fox jumps over the lazy dog again and again"
    (h, at), (g, to) = syncmers.anchors([inner, "prefix, " + inner + " and more"])
    assert set(h.tolist()) <= set(g.tolist())


def test_syncmers_odd_rows(spark):
    assert syncmers.fingerprint_edits(frame(spark)).count() == len(ODD)
    assert syncmers.fingerprint_edits(frame(spark, [])).count() == 0
    one = syncmers.fingerprint_edits(frame(spark, [(5, "abcdef")])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


# -- op7


def test_warc_round_trip(spark):
    pages = [(5, "http://a/x y\r\n", "same"), (3, None, "same"), (9, "u", None), (8, "u", ""), (1, "u", "é" * 9000), (2, "u", "other")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, size int")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == warc.digest(data)
    assert [(got[i].record_type, got[i].refers_to) for i in (3, 5, 8, 9)] == [("response", None), ("revisit", 3), ("response", None), ("revisit", 8)]
    assert warc.round_trip(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(df, min_bytes=5).collect()} == {"response"}


def test_warc_reader_checks():
    records = [warc.write_record(i, "u", b"<p>%d</p>" % i * 50, warc.digest(b"<p>%d</p>" % i * 50)) for i in range(40)]
    data = warc.write_archive(records)
    assert [r.headers["WARC-Record-ID"] for r in warc.read_archive(data)] == [warc.record_id(i) for i in range(40)]
    for broken in (data[:-3], data + b"x" * 9, data[: len(data) // 2]):
        with pytest.raises((ValueError, Exception)):
            list(warc.read_archive(broken))
    with pytest.raises(ValueError):
        warc.parse_record(records[0].replace(b"<p>0", b"<p>1", 1))
    with pytest.raises(ValueError):
        warc.parse_record(records[0].replace(b"WARC-Date", b"WARC-Dote"))
    with pytest.raises(ValueError):
        warc.parse_record(records[0][:-1])


# -- op8


def test_chat_escapes():
    for t in ["", "\\", "\\\\### x", "### Assistant: </turn> \\</turn>", "#### User: ", "é\n### "]:
        assert chat.unescape(chat.escape(t)) == t
        assert not re.search(r"(?<!\\)(?:\\\\)*(### |</turn>)", chat.escape(t))


def test_chat_odd_rows(spark):
    import public_tokenizers

    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "user", "### User: x</turn>"), (2, 0, None, "y"), (2, None, "tool", "\\z"), (None, 0, "assistant", "n"), (1, 2, "assistant", "😀")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.format_and_read(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("user\n\nassistant\nb\nuser\n### User: x</turn>\nassistant\n😀\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("b😀".encode()).hexdigest() and got[1].loss_chars == 2 and got[2].n_turns == 2 and got[None].loss_chars == 1
    assert chat.format_and_read(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# -- op9


def test_suffix_order():
    r = np.random.default_rng(2)
    for n in range(60):
        for top in (1, 2, 5, 300):
            t = r.integers(1, top + 1, n)
            assert suffixes.suffix_order(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def cover(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    for (i, _), x in zip(rows, data, strict=True):
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])
        yield i, len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,group,report", [(400, 1 << 21, 200), (60, 1 << 21, None), (60, 3000, None), (60, 3000, 90)])
def test_suffixes(spark, length, group, report):
    """group 3000: groups of more bytes are ordered by the distributed form."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted(map(tuple, suffixes.dedup(docs, length, group_bytes=group, report=report).collect()))
    assert [r[:5] for r in got] == sorted(cover(texts(), length))
    if report:
        assert [(r[0], r[5]) for r in got] == sorted((r[0], r[2]) for r in cover(texts(), report))


def test_suffixes_of_a_hot_passage(spark):
    """One passage in many surroundings, too much for one group: the distributed form gives what brute force gives."""
    r = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, 6))
    passage = " ".join(word() for _ in range(12))
    rows = [(i, " ".join([word() for _ in range(int(r.integers(0, 6)))] + [passage[: int(r.integers(60, len(passage) + 1))]] + [word() for _ in range(int(r.integers(0, 6)))])) for i in range(60)]
    got = sorted(map(tuple, suffixes.dedup(frame(spark, rows), 40, group_bytes=200).collect()))
    assert got == sorted(cover(rows, 40))


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (4, 2), (30, 1), (31, 2), (200, 3)])
def test_distributed_order(spark, n, top):
    from quillspark.llm import cover as C

    t = np.random.default_rng(n).integers(1, top + 1, n)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(t)], "place long, symbol long")
    got = sorted(C.ordered(df, n, 10**6).collect(), key=lambda x: x["rank"])
    assert [x["place"] for x in got] == sorted(range(n), key=lambda i: t[i:].tolist()) and [x["rank"] for x in got] == list(range(1, n + 1))


def test_suffixes_odd_rows(spark):
    rows = [*ODD, (20, "abc" * 300), (21, "abcabcab"), (22, "é" * 7)]
    for length in (8, 400):
        got = sorted((tuple(r) for r in suffixes.dedup(frame(spark, rows), length).collect()), key=str)
        assert got == sorted(cover(rows, length), key=str)
    assert suffixes.dedup(frame(spark, [])).count() == 0


def test_cut_text(spark):
    shared = "0123456789abcdefghij"
    rows = [(1, "left " + shared + " right"), (2, "é" + shared), (3, "alone")]
    got = {r.doc_id: r.text for r in suffixes.cut_text(frame(spark, rows), length=20).collect()}
    assert got == {1: "left  right", 2: "é", 3: "alone"}


# -- op10


def brute_leaks(rows, items):
    out = set()
    for i, t in rows:
        sh = shingles(t, 5)
        for j, item in items:
            want = Counter(shingles(item, 5))
            n = sum(want.values())
            if not n or not sh or (len(words(item)) < 5 and not (set(want) & set(shingles(t, len(words(item)))))):
                continue
            own = shingles(t, 5) if len(words(item)) >= 5 else shingles(t, len(words(item)))
            best = 0.0
            for a in range(max(1, len(own) - n + 1)):
                x = Counter(own[a : a + n])
                both = sum((x & want).values())
                best = max(best, both / (sum(x.values()) + n - both))
            if best >= 0.8:
                out.add((i, j, round(best, 9)))
    return out


def test_decontamination(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 2), (2, "two words"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 2), (6, " ".join(f"n{i}" for i in range(40)))]
    long = [f"n{i}" for i in range(40)]
    long[20] = "changed"
    rows = [(1, "pre " + items[0][1] + "post"), (2, "some two words here"), (3, " ".join(long)), (4, " ".join(f"n{i}" for i in range(39))), (5, None), (6, "nothing at all"), (6, " ".join(["x"] * 5000 + [f"n{i}" for i in range(40)]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for item_bytes in (8 << 20, 64):
        got = decontaminate.contaminated(frame(spark, rows), bench, item_bytes=item_bytes).collect()
        assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in got} == brute_leaks(rows, items)
        kept = decontaminate.clean(frame(spark, rows), bench, item_bytes=item_bytes)
        assert sorted(r.text or "" for r in kept.collect()) == sorted((t or "") for k, (i, t) in enumerate(rows) if not brute_leaks([(i, t)], items))
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0


# -- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SMALL).collect()
    assert 0 < len(got) < len(texts()) and len({r.doc_id for r in got}) == len(got)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema == docs.schema


def test_bitmaps_bound_the_difference():
    from quillspark.llm import jaccard

    r = np.random.default_rng(3)
    a = [np.unique(r.integers(0, 3000, int(n)).astype(np.uint64)) for n in r.integers(0, 2500, 30)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in a])])
    maps = jaccard.parities(np.concatenate(a), first)
    for i in range(30):
        for j in range(i):
            assert np.bitwise_count(maps[i] ^ maps[j]).sum() <= len(np.setxor1d(a[i], a[j]))


@pytest.mark.parametrize("block", [9, 40, 4096])
def test_large_groups_meet_block_by_block(spark, block):
    """Sets under one shared key, of one large root and many small ones, compared in blocks, give what all pairs give."""
    from quillspark.llm import jaccard

    rng = np.random.default_rng(3)
    base = [rng.integers(1, 1 << 62, 40, dtype=np.uint64) for _ in range(12)]
    held = [np.unique(np.concatenate([base[i % 12][: 40 - i % 5], np.uint64([7]), rng.integers(1, 1 << 62, i % 7, dtype=np.uint64)])) for i in range(300)]
    first = np.cumsum([0] + [len(x) for x in held])
    flat = np.concatenate(held)
    known = (np.uint64([7]), np.uint64([1]))
    key, begin = jaccard.prefixes(flat, first, known, 0.5)
    key = [np.concatenate([key[x:y], np.uint64([1])]).astype(np.uint64) for x, y in zip(begin[:-1], begin[1:], strict=True)]
    root = [0 if i % 12 < 4 else i + 1 for i in range(300)]
    rows = [(i, root[i], len(held[i]), bytearray(key[i].tobytes()), bytearray(m.tobytes())) for i, m in enumerate(jaccard.parities(flat, first))]
    table = spark.createDataFrame(rows, "node long, root long, size int, prefix binary, parity binary")
    got = {(r.a, r.b) for r in jaccard.candidates(table, 0.5, block).collect()}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if root[i] != root[j] and 2 * len(np.intersect1d(held[i], held[j])) >= len(np.union1d(held[i], held[j]))}
    assert want and want <= got and all(root[a] != root[b] for a, b in got)


def test_dense_groups_leave_as_sets(spark, monkeypatch):
    """A cluster of near copies that no links join: no more rows leave the comparison under a shingle than sets are filed there, and pairs are verified in few cells."""
    from quillspark.llm import jaccard

    r = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for at in r.choice(120, int(r.integers(0, 5)), replace=False).tolist():
            own[at] = f"e{i}a{at}"
        rows.append((i, " ".join(own)))
    docs = frame(spark, rows)
    known = simhash.described(docs, 5, 0.8, 2, "doc_id", "text").dropDuplicates(["node"]).selectExpr("*", "node as root")
    known, held, keep = known.cache(), {}, jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, tag: held.setdefault(tag, keep(df, tag)))
    found = jaccard.candidates(known, 0.8).cache()
    assert held["met"].count() <= known.selectExpr("sum(length(prefix) div 8) as n").first().n
    got = {(x.a, x.b) for x in jaccard.verified(found, docs, 5, 0.8).collect()}
    node = {i: jaccard.nodes(h, first)[0] for i, t in rows for h, first in [jaccard.sets(W.split(pa.array([t])), 5)]}
    own = {node[i]: set(shingles(t, 5)) for i, t in rows}
    want = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    assert got == want and len(want) > 2 * len(own) and 2 * found.select("cell").distinct().count() < found.count()


@pytest.mark.parametrize("n,top,whole", [(0, 1, 0), (1, 1, 0), (4, 2, 0), (31, 2, 0), (200, 3, 0), (200, 3, 100), (301, 1, 250)])
def test_distributed_order_down_to_one_task(spark, n, top, whole):
    from quillspark.llm import cover as C

    t = np.random.default_rng(n).integers(1, top + 1, n)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(t)], "place long, symbol long")
    got = sorted(C.ordered(df, n, whole=whole).collect(), key=lambda x: x["rank"])
    assert [x["place"] for x in got] == sorted(range(n), key=lambda i: t[i:].tolist()) and [x["rank"] for x in got] == list(range(1, n + 1))


@pytest.mark.parametrize("whole", [0, 4000, None])
def test_large_groups_are_ordered_once(spark, monkeypatch, whole):
    """One suffix order serves both lengths, and what fits one task takes one job; the results are those of brute force."""
    from quillspark.llm import cover as C

    if whole is not None:
        monkeypatch.setattr(C, "WHOLE", whole)
    r, tags, keep = np.random.default_rng(6), [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, tag: (tags.append(tag), keep(df, tag))[1])
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, 6))
    passage = " ".join(word() for _ in range(14))
    rows = [(i, " ".join([word() for _ in range(int(r.integers(0, 6)))] + [passage] + [word() for _ in range(int(r.integers(0, 6)))])) for i in range(40)]
    got = sorted(map(tuple, suffixes.dedup(frame(spark, rows), 60, group_bytes=200, report=40).collect()))
    assert [x[:5] for x in got] == sorted(cover(rows, 60)) and [(x[0], x[5]) for x in got] == sorted((x[0], x[2]) for x in cover(rows, 40))
    assert tags.count("cover-order") == 2 and len(tags) == len(set(tags)) + 1 if whole is None else tags.count("cover-ranks") > 1, tags


def test_large_groups_give_runs(spark):
    """Of a snippet of a large group one row comes back, with runs of starts, not a row for each start."""
    rows = [(1, n, bytearray(b"%c" % (97 + n) + b"0123456789abcdefghijklmnopqrst"), 12) for n in range(4)]
    pieces = spark.createDataFrame(rows, "hash long, digest long, data binary, starts long")
    got = [(x.digest, sorted((y["from"], y["to"], y["size"]) for y in x.runs)) for x in suffixes.ordered_by_spark(pieces, [8, 20]).collect()]
    assert sorted(got) == [(n, [(1, 11, 8), (1, 11, 20)]) for n in range(4)]


def test_thin_files_as_often_in_any_table(spark, monkeypatch):
    """The number of keys under which a fingerprint is filed doesn't grow with the table (planned here for 10,000 times its rows); the links left out are found."""
    r, keys, plan = np.random.default_rng(9), [], simhash.make_plan

    def larger(sample, n, *some, **more):
        found = plan(sample, n * 10_000, *some, **more)
        keys.append(len(simhash.file_keys(sample, found)[0]) / len(sample))
        return found

    monkeypatch.setattr(simhash, "make_plan", larger)
    rows = []
    for i in range(60):
        own = [f"w{x}" for x in r.integers(0, 10**6, 80)]
        rows.append((i, " ".join(own)))
        rows.append((100 + i, " ".join([*own[: 78 - i % 3], "x", "y"])))  # similar by 0.92 or more
    got = {x.doc_id for x in simhash.thin(frame(spark, rows)).collect()}
    assert got == set(range(60)) and max(keys) <= 10, keys


def test_large_groups_lose_their_surroundings(spark, monkeypatch):
    """A passage in many surroundings, too much for one task: without the surroundings it is small, and isn't ordered by distributed sorts."""
    r = np.random.default_rng(7)
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, 6))
    passage = " ".join(word() for _ in range(14))
    rows = [(i, " ".join([word() for _ in range(int(r.integers(0, 9)))] + [passage[: int(r.integers(70, 98))]] + [word() for _ in range(int(r.integers(0, 9)))])) for i in range(80)]
    want, more = sorted(cover(rows, 60)), sorted((x[0], x[2]) for x in cover(rows, 40))
    monkeypatch.setattr(suffixes, "TRIM_BYTES", 0)
    for group in (200, 4000):
        got = sorted(map(tuple, suffixes.dedup(frame(spark, rows), 60, group_bytes=group, report=40).collect()))
        assert [x[:5] for x in got] == want and [(x[0], x[5]) for x in got] == more
        monkeypatch.setattr(suffixes.cover, "ordered", None)  # the larger groups aren't ordered by Spark
