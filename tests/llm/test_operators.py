"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barspark.llm import chunking, jaccard, languages, mixing, ngrams, pieces, quality, repetition, secrets, sharding
from barspark.llm.components import components
from barspark.llm.eliasfano import EliasFano, packed, unpacked
from barspark.llm.storage import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _key int, blob string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))


def words(text):
    return [w.translate(LOW) for w in WORD.findall((text or "").encode())]


def odd_rows():
    long = " ".join(f"w{k % 977}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, long), (5, "one two three four five six seven eight nine ten " * 3), (5, "one two three four five six seven eight nine ten " * 3), (6, "ÉTÉ déjà vu 漢字 😀 password = hunter2hunter2"), (None, "no id here but some words to read at all"), (7, "No Id here but some words to read at all"), (8, "a")]
    return [(i, t, None if i == 6 else "en", None if i in (1, 6) else f"s{(i or 0) % 2}", len(t or ""), "x", 1, "y") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


# ------------------------------------------------------------ 1 quality


def test_quality_learns_and_scores_every_row(spark, docs, odd, none):
    good = [f"Plain words of text number {k}, and more of them follow here." for k in range(60)]
    bad = [f"### $$$ {k}!! && %%% ||| $$$ ### &&& {k}" for k in range(60)]
    net = quality.train(good + bad, [1] * 60 + [0] * 60)
    p = {r["doc_id"]: r["score"] for r in quality.score_quality(odd, net).select("doc_id", "score").collect()}
    assert len(p) == 9 and all(0 <= v <= 1 for v in p.values())
    assert p[1] == p[2]
    assert quality.score_quality(none, net).count() == 0
    x = pa.array(["Some plain words to read in a text.", "### $$$ &&& ||| %%%"])
    a, b = np.concatenate([v for _, _, v in quality.long_scores(net, x)])
    assert b < quality.THRESHOLD <= a and a - b > 0.4


def test_quality_gradient_matches_differences():
    net = quality.train(["abc def ghi", "### $$$"], [1, 0], epochs=1)
    text = b"some words ### and $$$ more " * 12
    buf, off, y = np.frombuffer(text + b"short", np.uint8), np.array([0, len(text), len(text) + 5]), np.array([1.0, 0.0])

    def loss():
        net.fold()
        net.tables = np.einsum("be,kef->kbf", net.embedding, net.filters)
        p = quality.scores(net, buf, off)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    net.tables = np.einsum("be,kef->kbf", net.embedding, net.filters)
    grads = quality._gradients(net, buf, off, y)
    for p, g in zip((net.embedding, net.filters, net.out), (grads[0], grads[1], grads[3]), strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        h, before = 1e-5, p[k]
        p[k] = before + h
        up = loss()
        p[k] = before - h
        down = loss()
        p[k] = before
        assert (up - down) / (2 * h) == pytest.approx(g[k], rel=0.05, abs=1e-5)


def test_a_filter_does_not_look_past_its_text():
    net = quality.train(["abc def", "###"], [1, 0], epochs=1)
    alone = quality.scores(net, np.frombuffer(b"hello", np.uint8), np.array([0, 5]))
    beside = quality.scores(net, np.frombuffer(b"hello### $$$", np.uint8), np.array([0, 5, 12]))
    assert alone[0] == pytest.approx(beside[0])


# ------------------------------------------------------------ 2 pieces


def score_by_hand(net, data):
    """The network's probability by loops over bytes, blocks and chunks."""
    if not data:
        return 1 / (1 + math.exp(-net.out_bias[0]))
    z = [net.bias + sum(np.einsum("e,ef->f", net.embedding[data[p + k]], net.filters[k]) for k in range(quality.WIDTH) if p + k < len(data)) for p in range(len(data))]
    peaks = [np.max(z[b : b + quality.BLOCK], axis=0) for b in range(0, len(data), quality.BLOCK)]
    chunks = [np.maximum(np.maximum(p, q), 0) for p, q in zip(peaks, peaks[1:] + peaks[-1:], strict=True)]
    features = np.concatenate((np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)))
    return 1 / (1 + math.exp(-(features @ net.out + net.out_bias[0])))


def test_quality_scores_equal_the_loops():
    draw = np.random.default_rng(6)
    net = quality.train(["some words of text", "### $$$ |||", "more words"], [1, 0, 1], epochs=1)
    texts = [bytes(draw.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 63, 64, 65, 128, 129, 400, 0, 7)]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert quality.scores(net, buf, off) == pytest.approx([score_by_hand(net, t) for t in texts], abs=1e-4)


@pytest.fixture(scope="module")
def machine():
    return pieces.Transducer(pieces.load_model(pieces.public_model_path()))


def test_pieces_equal_the_library_and_round_trip(machine, docs):
    import random

    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model_path())
    draw = random.Random(3)
    letters = "aetoin shr.▁\n\t<0x0A>é漢字😀def class(){}[]  ,;0123"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(400)]
    texts += ["", " ", "  a", "<s> </s> <unk>", "x" * 3000, "▁", "a\n\n  b"] + [r["text"] for r in docs.select("text").limit(60).collect()]
    for t in texts:
        ids = machine.encode(t)
        assert ids == theirs.encode(t)
        assert machine.decode(ids) == t.replace("▁", " ")


def test_pieces_of_a_unigram_model_take_the_least_cost():
    model = pieces.PieceModel(["<unk>", "▁a", "b", "▁ab", "c", "bc"], [0, -1.0, -1.0, -3.5, -1.0, -1.2], [2, 1, 1, 1, 1, 1], False, True)
    m = pieces.Transducer(model)
    assert m.shortest("▁abc") == ["▁a", "bc"]
    assert m.encode("a?") == [1, 0]


def test_pieces_of_odd_rows(odd, none):
    model = pieces.load_model(pieces.public_model_path())
    rows = pieces.encoded(odd, model).collect()
    assert len(rows) == 10 and all(r["decoded_matches"] for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)] == [0, 0]
    assert pieces.encoded(none, model).count() == 0


# ------------------------------------------------------------ 3 language model


@pytest.mark.parametrize("n, top", [(1, 5), (700, 2**63), (900, 700), (3000, 10**6)])
def test_elias_fano_access_and_find(n, top):
    draw = np.random.default_rng(n)
    v = np.sort(draw.integers(0, top, n, dtype=np.uint64))
    about, arrays = EliasFano.of(v).parts()
    e = EliasFano.from_parts(about, unpacked(np.frombuffer(packed({}, arrays), np.uint8))[1])
    assert (e.access(np.arange(n)) == v).all()
    asked = np.concatenate((v, draw.integers(0, top, 200, dtype=np.uint64)))
    place = np.searchsorted(v, asked)
    there = (place < n) & (v[np.minimum(place, n - 1)] == asked)
    assert (e.find(asked) == np.where(there, place, -1)).all()


@pytest.mark.parametrize("least", [1, 2])
def test_language_model_equals_a_dictionary_and_sums_to_one(spark, docs, least):
    train = docs.where("doc_id % 10 <> 0")
    model = ngrams.train(train, least)
    rows = ngrams.score(docs, model).collect()
    texts = {r["doc_id"]: words(r["text"]) + [None] for r in docs.collect()}
    c, pairs = Counter(), Counter()
    for k, w in texts.items():
        if k % 10:
            c.update(w)
            pairs.update(zip([None] + w[:-1], w, strict=True))
    n, v = sum(c.values()), len(c)
    d1, d2 = (x[1] / (x[1] + 2 * x[2]) for x in (Counter(c.values()), Counter(pairs.values())))
    kept = {k: x for k, x in pairs.items() if x >= least}
    mass = Counter()
    for (a, _), x in kept.items():
        mass[a] += x - d2
    p1 = lambda w: max(c[w] - d1, 0) / n + d1 * v / n / (v + 1)

    def p2(a, w):
        if not c[a]:
            return p1(w)
        return max(kept.get((a, w), d2) - d2, 0) / c[a] + (1 - mass[a] / c[a]) * p1(w)

    assert sum(p2(None, w) for w in c) + p2(None, "unknown") == pytest.approx(1)
    for r in rows:
        w = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(p2(a, x)) for a, x in zip([None] + w[:-1], w, strict=True)), abs=4e-4 * len(w))


def test_language_model_of_odd_rows(odd, none):
    model = ngrams.train(odd)
    assert ngrams.score(odd, model).count() == 10
    assert ngrams.score(none, model).count() == 0
    assert ngrams.score(odd, ngrams.train(none)).where("n_known > 0").count() == 0


# ------------------------------------------------------------ 4 sharding


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [-1, 0, 1, 2**63 - 1, -(2**63), 123456789, None, *range(500)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shard(F.col("k"), 8).alias("a"), sharding.jump_shard(F.col("k"), 100).alias("b"))
    assert all((r["a"], r["b"]) == (jump(r["k"] or 0, 8), jump(r["k"] or 0, 100)) for r in rows.collect())


def test_shards_of_odd_rows(odd, none, docs):
    for rows, n in ((sharding.shard_documents(odd, rows_per_block=2).collect(), 10), (sharding.shard_documents(docs, rows_per_block=7).collect(), 200)):
        assert len(rows) == n
        assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
        for s in {r["shard"] for r in rows}:
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))
    row = sharding.shard_documents(odd).where("doc_id = 6").first()
    text = next(r[1] for r in odd_rows() if r[0] == 6).encode()
    assert (row["size"], row["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
    assert sharding.shard_documents(none).count() == 0


# ------------------------------------------------------------ 5 languages


def test_languages_are_told_apart(docs, odd, none):
    model = languages.fit_languages(docs)
    rows = languages.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.97 * len(rows)
    found = {r["doc_id"]: r for r in languages.identify(odd, model).collect()}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[3]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert languages.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in languages.identify(odd, languages.fit_languages(none)).collect()} == {"und"}


def test_the_kernel_is_a_cosine_of_presence():
    texts = ["abc abd", "bca"]
    model = languages.fit(texts, ["x", "y"])
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    k = languages._kernels(["abd bc"], model, languages.code_table(model.grams))[0]
    every = grams(texts[0]) | grams(texts[1])
    own = grams("abd bc") & every
    marks = [t for n in ("x", "y") for t in [texts["xy".index(n)]]]
    for value, t in zip(k, marks, strict=True):
        assert value == pytest.approx(len(own & grams(t)) / math.sqrt(len(own) * len(grams(t))), rel=1e-5)


def test_the_ridge_solution_equals_least_squares():
    texts = ["the cat sat on the mat", "a dog ran over the hill", "les chats sont sur la table", "un chien court sur la colline", "die katze sitzt auf dem tisch", "ein hund rennt schnell"]
    names = ["en", "en", "fr", "fr", "de", "de"]
    model = languages.fit(texts, names)
    grams = lambda t: {t.encode().lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    marks = [t for x in sorted(set(names)) for t, y in zip(texts, names, strict=True) if x == y]
    every = set().union(*map(grams, marks))
    k = lambda a, b: len(grams(a) & grams(b) & every) / math.sqrt(len(grams(a) & every) * len(grams(b) & every))
    learn = list(zip(texts, names, strict=True))
    for size in languages.PIECES:
        for n, (t, x) in enumerate(zip(texts, names, strict=True)):
            at = (n * 7919) % max(1, len(t) - size)
            learn.append((t[at : at + size], x))
    values, vectors = np.linalg.eigh(np.array([[k(a, b) for b in marks] for a in marks]))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    phi = np.array([[k(t, m) for m in marks] for t, _ in learn]) @ root
    y = np.array([[float(x == z) for z in model.languages] for _, x in learn])
    w = np.sqrt(1 / np.array([sum(x == z for _, z in learn) for _, x in learn]))[:, None]
    both = np.concatenate((w * phi, math.sqrt(languages.RIDGE) * np.eye(len(marks))))
    solved = np.linalg.lstsq(both, np.concatenate((w * y, np.zeros((len(marks), y.shape[1])))), rcond=None)[0]
    asked = ["the dog sat", "la table", "der hund auf dem tisch"]
    mine = languages._kernels(asked, model, languages.code_table(model.grams)) @ model.weights
    assert mine == pytest.approx(np.array([[k(t, m) for m in marks] for t in asked]) @ root @ solved, abs=1e-3)


# ------------------------------------------------------------ 6 mixing


def level(sizes, weights):
    total, targets, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if share * weights[k] > 3 * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = share * weights[k]
            break
        for k in over:
            targets[k] = 3.0 * sizes[k]
            left -= targets[k]
            open_.discard(k)
    return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [5, 1000, 7, 3000, 1], [0, 10, 0, 400], [1]])
def test_targets_fill_up_to_the_cap(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}", x) for k, x in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    expected = level(sizes, [1 + k % 3 for k in range(len(sizes))])
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(expected)


def test_mix_meets_its_targets_and_repeats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken", "target", "source").collect())) for _ in range(2))
    assert one == two
    taken, targets = Counter(), {}
    for _, t, target, s in one:
        taken[s] += t
        targets[s] = target
    assert all(abs(taken[s] - targets[s]) < 0.05 * targets[s] + 20 for s in targets)


def test_no_other_rates_that_meet_the_targets_are_closer(spark):
    draw = np.random.default_rng(9)
    sizes = [int(n) for n in np.concatenate((draw.integers(1, 40, 30), draw.integers(100, 3000, 30)))]
    table = spark.createDataFrame([(k, " ".join(["w"] * n), f"s{k % 3}") for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    rows = mixing.mix(table).collect()
    top = max(sizes)
    for source in ("s0", "s1", "s2"):
        part = [r for r in rows if r["source"] == source]
        n, rate = np.array([r["size"] for r in part], float), np.array([r["rate"] for r in part])
        assert (n * rate).sum() == pytest.approx(part[0]["target"], rel=2e-6)
        weight = n / (1 + np.log1p(n) / (1 + np.log1p(top)))
        cost = lambda r: (weight * (r * np.log(np.maximum(r, 1e-12)) - r)).sum()  # noqa: B023, E731
        for _ in range(200):
            i, j = draw.choice(len(part), 2, replace=False)
            moved = rate.copy()
            step = draw.normal() * min(n[i], n[j]) * 0.05
            moved[i] += step / n[i]
            moved[j] -= step / n[j]
            if 0 <= moved.min() and moved.max() <= mixing.MAX_COPIES:
                assert cost(moved) >= cost(rate) - 1e-3


def test_mix_of_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[1] == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mixing_stage(spark, odd, "").count() == sum(r["copies"] for r in rows)


# ------------------------------------------------------------ 7 repetition


def longest_by_hand(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def test_longest_repeats_by_hand():
    draw = np.random.default_rng(2)
    for _ in range(150):
        texts = [draw.integers(0, 3, draw.integers(0, 30)).tolist() for _ in range(4)]
        flat = np.array([x for t in texts for x in t], np.uint64)
        of = np.array([k for k, t in enumerate(texts) for _ in t], np.int64)
        suffixes, shared = repetition.common_prefixes(flat, of)
        assert repetition.longest_repeats(suffixes, shared).tolist() == [x for t in texts for x in longest_by_hand(t)]
        lengths, text = repetition.maximal_repeats(flat, of, suffixes, shared, 2)
        assert sorted(zip(text.tolist(), lengths.tolist(), strict=True)) == sorted((k, len(r)) for k, t in enumerate(texts) for r in maximal_by_hand(t, 2))


def maximal_by_hand(w, least):
    """All stretches of least words or more that occur twice and cannot grow to either side with all their places."""
    places = {}
    for i in range(len(w)):
        for j in range(i + least, len(w) + 1):
            places.setdefault(tuple(w[i:j]), []).append(i)
    at = lambda k: w[k] if 0 <= k < len(w) else ("edge", k)
    return [r for r, p in places.items() if len(p) > 1 and len({at(i - 1) for i in p}) > 1 and len({at(i + len(r)) for i in p}) > 1]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rules_by_hand(text):
    w = words_of(text)
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    inside = {k for i, x in enumerate(windows) if count[x] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(inside)


def test_rules_by_hand(docs, odd, none):
    draw = np.random.default_rng(8)
    loops = [(k, " ".join(draw.choice(["a", "b", "c"], 60))) for k in range(40)] + [(50 + k, " ".join(f"w{x}" for x in draw.integers(0, 60, 300))) for k in range(20)]
    for frame in (docs, odd, docs.sparkSession.createDataFrame(loops, "doc_id long, text string")):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        for r in repetition.repetition_rules(frame).collect():
            n, *rest = rules_by_hand(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
            assert r["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n)
            w = words_of(texts[r["doc_id"]])
            if n > 400:
                continue
            repeats = maximal_by_hand(w, repetition.MIN_REPEAT)
            inside = {k for x in repeats for i in range(n - len(x) + 1) if tuple(w[i : i + len(x)]) == x for k in range(i, i + len(x))}
            longest = max(map(len, repeats), default=0)
            assert (r["covered_words"], r["longest_repeat"], r["n_maximal"]) == (len(inside), longest, len(repeats))
            fits = len(inside) <= repetition.MAX_COVERED * n and longest <= repetition.MAX_LONGEST
            assert r["kept"] == (not r["base_failed"] and fits)
    assert repetition.repetition_rules(none).count() == 0


@pytest.mark.parametrize("texts", [["\n"], ["\n\n", " \n\t", "", None], [None], [" "], ["one"]])
def test_rules_of_slices_without_words_or_lines(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = repetition.repetition_rules(frame).collect()
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    assert all((r["n_dup_lines"], r["n_repeat_words"], r["kept"]) == (0, 0, False) for r in rows)


# ------------------------------------------------------------ 8 fingerprints


def chunks_by_hand(data):
    """Chunks by a loop over the bytes with one rolling hash."""
    out, last, h = [], 0, 0
    for k, b in enumerate(data):
        h = (2 * h + int(chunking.GEAR[b])) & 0xFFFFFFFF
        size = k + 1 - last
        loose, strict = h & int(chunking.LOOSE) == 0, h & int(chunking.STRICT) == 0
        if size == chunking.MOST or (strict and size >= chunking.LEAST) or (loose and size >= chunking.NORMAL):
            out.append(data[last : k + 1])
            last = k + 1
    return out + ([data[last:]] if last < len(data) else [])


def likeness_by_hand(a, b):
    if not a or not b:
        return float(not a and not b)
    x, y = Counter(), Counter()
    for part, count in ((a, x), (b, y)):
        for chunk in part:
            count[chunk] += len(chunk)
    return sum(min(x[c], y[c]) for c in x) / min(sum(x.values()), sum(y.values()))


def test_an_id_that_fills_blocks_is_parted(spark):
    rows = [(7, f"text {k} of many") for k in range(300)] + [(7, "the same text again")] * 300 + [(k, f"other {k}") for k in range(20, 320)] + [(None, "x")] * 50
    table = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = chunking._dealt(table.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_at"), chunking._hash().alias("_hash")), 20, 50, 5)
    sizes = [r["count"] for r in dealt.groupBy("_block").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 250
    ordered = [tuple(r) for r in dealt.orderBy("_block", F.desc("_at"), F.desc("_hash")).select("_at", "_hash").collect()]
    assert ordered == sorted(ordered, reverse=True)
    got = chunking.fingerprints(table, 50, 5)
    by_hand = [t for _, t in sorted(((-(2**63) if i is None else i, h), t) for i, t, h in table.select("doc_id", "text", chunking._hash()).collect())][::-1]
    expected = Counter(hashlib.sha256(chunking.edited(a, b).encode()).hexdigest() for a, b in zip(by_hand, by_hand[1:] + by_hand[:1], strict=True))
    assert Counter(r[0] for r in got.select("edited_sha256").collect()) == expected


def test_fingerprints_follow_the_next_document(docs, odd, none):
    rows = {r["doc_id"]: r for r in chunking.fingerprints(docs, block_rows=17, ranges=4).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        new = chunking.edited(texts[i] or "", texts[order[(k + 1) % len(order)]] or "")
        assert rows[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        own, changed, after = (chunks_by_hand(t.encode()) for t in (texts[i] or "", new, texts[order[(k + 1) % len(order)]] or ""))
        assert rows[i]["n_chunks"] == len(set(own)) and len(rows[i]["edited_fingerprint"].split(",")) == len(set(changed))
        assert rows[i]["near_edited"] == pytest.approx(likeness_by_hand(own, changed)) and rows[i]["near_next"] == pytest.approx(likeness_by_hand(own, after))
    assert chunking.fingerprints(odd, block_rows=3).count() == 10
    assert chunking.fingerprints(none).count() == 0


def test_chunks_resist_shifts():
    draw = np.random.default_rng(4)
    text = bytes(draw.integers(97, 123, 6000, dtype=np.uint8))
    assert chunking.boundaries(np.frombuffer(text, np.uint8))[-1] == len(text)
    sizes = np.diff([0, *chunking.boundaries(np.frombuffer(text, np.uint8))])
    assert sizes.max() <= chunking.MOST and sizes[:-1].min() >= chunking.LEAST
    same = chunking.containment(chunking.chunk_digests(text), chunking.chunk_digests(b"new words " + text))
    assert same > 0.9
    assert chunking.containment(chunking.chunk_digests(b""), chunking.chunk_digests(text)) == 0


def test_the_gear_hash_equals_the_loop():
    data = bytes(range(200))
    h, out = 0, []
    for b in data:
        h = (2 * h + int(chunking.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    assert chunking.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == out


# ------------------------------------------------------------ 9 similarity join


def classes_by_hand(texts, size, percent):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}
    find = lambda k: k if root[k] == k else find(root[k])
    keys = [k for k in sorted(sets) if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("size, percent, block", [(4, 85, 10**6), (5, 80, 60)])
def test_classes_by_hand(spark, size, percent, block, monkeypatch):
    """A third of the rows are near copies of one text, some chained; a small block makes neighbourhoods overflow theirs."""
    draw = np.random.default_rng(8)
    base = [f"w{k}" for k in draw.integers(0, 400, 60)]
    texts = {}
    for k in range(90):
        if k % 3 == 0:
            w = list(base)
            for _ in range(draw.integers(0, 4)):
                w[draw.integers(0, len(w))] = f"x{draw.integers(0, 5)}"
        else:
            w = [f"w{x}" for x in draw.integers(0, 400, draw.integers(1, 40))] + base[:8] * int(k % 3 == 1)
        texts[k] = " ".join(w)
    texts |= {90: None, 91: "", 92: texts[0].upper(), 93: "one two", 94: "one two"}
    own = jaccard.similar_sets
    monkeypatch.setattr(jaccard, "similar_sets", lambda d, w, p: own(d, w, p, block))
    rows = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == classes_by_hand(texts, size, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_a_key(percent):
    draw = np.random.default_rng(percent)
    frequency = draw.integers(0, 3, 1 << jaccard.SKETCH_BITS).astype(np.uint32)
    linked = 0
    for _ in range(3000):
        a = {int(x) for x in draw.integers(0, 2**63, draw.integers(1, 60))}
        b = set(a)
        for _ in range(draw.integers(1, 8)):
            b.pop() if draw.random() < 0.5 and b else b.add(int(draw.integers(0, 2**63)))
        if a != b and b and 100 * len(a & b) >= percent * len(a | b):
            linked += 1
            x, y = (set(jaccard.keys_of(np.array(sorted(s), np.uint64), frequency, percent).tolist()) for s in (a, b))
            assert x & y
    assert linked > 500


def parted(count, links):
    root = list(range(count))

    def find(k):
        return k if root[k] == k else find(root[k])

    for a, b in links:
        root[find(a)] = find(b)
    return sorted(tuple(j for j in range(count) if find(j) == k) for k in range(count) if root[k] == k)


def blocks_of_chains():
    """(name, sets): the largest group changes, then a later, larger set joins two groups; and draws of such groups."""

    def swapped(s, at, fresh):
        return s[:at] + list(range(fresh, fresh + 24)) + s[at + 24 :]

    for many in (2, 5):
        k = list(range(400))
        a2, b3 = swapped(k, 0, 1000), swapped(k, 24, 1100)
        row = [swapped(a2, 48, 1200), a2, *(swapped(b3, 72 + 24 * i, 1300 + 100 * i) for i in range(many)), b3, k]
        yield f"{many} before the join", [s + list(range(5000 + 100 * i, 5000 + 101 * i)) for i, s in enumerate(row)]
    for seed in range(60):
        draw, fresh = np.random.default_rng(seed), iter(range(1000, 10**9, 30))
        row = [list(range(400))]
        for _ in range(24):
            row.append(swapped(row[draw.integers(max(0, len(row) - 6), len(row))], 24 * int(draw.integers(0, 16)), next(fresh)))
        # Some links of the chains are left out, so that there are several groups.
        row = [row[k] for k in draw.permutation(len(row))[:18]]
        yield f"draw {seed}", [s + list(range(10**9 + 100 * i, 10**9 + 101 * i)) for i, s in enumerate(row)]


@pytest.mark.parametrize("sets", [pytest.param(s, id=n) for n, s in blocks_of_chains()])
def test_a_block_links_what_brute_force_links(sets):
    each = range(len(sets))
    by_hand = [(a, b) for b in each for a in range(b) if 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})]
    got = jaccard.linked_in_block(list(each), [np.array(sorted(s), np.uint64) for s in sets], 85)
    assert set(map(tuple, map(sorted, got))) <= set(by_hand)
    assert parted(len(sets), got) == parted(len(sets), by_hand)
    assert len(got) < len(sets)


def test_tasks_of_a_cut_neighbourhood_are_bounded(spark, monkeypatch):
    """Texts that share a passage but are not similar all ask each other; a few pairs are similar, some of different size."""
    draw = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(160)]
    texts = {k: " ".join(passage + [f"u{k}x{i}" for i in range(45 + k % 3)]) for k in range(60)}
    texts |= {100 + k: " ".join(texts[k].split()[: -int(draw.integers(1, 20))]) for k in range(0, 60, 4)}
    frame = type(spark.range(0))
    own, grouped, tasks, block = jaccard.similar_sets, frame.groupBy, [], 1000
    monkeypatch.setattr(jaccard, "similar_sets", lambda d, w, p: own(d, w, p, block))

    def spied(df, *columns):
        if "asks" in df.columns:
            tasks.append(df.select(*columns, "asks", (F.length("shingles") / 8).alias("n")))
        return grouped(df, *columns)

    monkeypatch.setattr(frame, "groupBy", spied)
    rows = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == classes_by_hand(texts, 4, 85)
    (sides,) = tasks
    sums = grouped(sides, *(c for c in sides.columns if c != "n")).agg(F.sum("n").alias("n")).collect()
    assert len(sums) > 50
    # Dealt by hash, a block can be somewhat over its size.
    assert max(r["n"] for r in sums) < 4 * block


def test_duplicates_of_odd_rows(spark, odd, none):
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == 10
    kept = jaccard.duplicates_stage(spark, odd, "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "5", "6", "7", "8"]
    assert jaccard.near_duplicates(none).count() == 0
    assert jaccard.duplicates_stage(spark, none, "").count() == 0


def test_duplicates_are_told_by_text_where_ids_repeat(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = text(7) + " and more"
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, None), (None, ""), (None, " "), (1, text(2)), (1, text(3)), (1, text(3).upper()), (1, ""), (1, ""), (2, text(7)), (3, near), (3, text(4)), (5, text(5)), (None, text(5))]
    kept = jaccard.duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(None, text(0)), (None, text(1)), (None, None), (None, ""), (None, " "), (1, text(2)), (1, text(3)), (1, ""), (1, ""), (2, text(7)), (3, text(4)), (5, text(5))]
    assert sorted(map(str, ((r["doc_id"], r["text"] and r["text"].lower()) for r in kept))) == sorted(map(str, want))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


# ------------------------------------------------------------ 10 secrets


def spans_by_hand(text):
    rules = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))
    found = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(rules) for m in re.finditer(p, text or "", re.A) if len(m[g]) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))


SECRETS = [
    (1, None), (2, ""), (3, "TOKEN: 'abc' secret=abcdefgh12 é password\" : \"ÿ"), (4, "token:secret: abcdefghij"), (5, "😀 api_key=AKIA" + "Q7" * 8 + " x"), (6, "AKIA1234"), (7, "0" * 31 + "g" + "a1" * 16 + "G" + "f" * 40), (8, "token=password"),
    (9, "passwd = " + "d" * 40 + " apikey:\t12345678"), (10, "secret==abcdefgh secret:=12345678"), (10, "secret==abcdefgh secret:=12345678"),
]


def test_secrets_by_hand(spark, odd, none):
    rows = secrets.secret_report(spark.createDataFrame(SECRETS, "doc_id long, text string"), new_path(spark, "ledger")).collect()
    texts = dict(SECRETS)
    assert len(rows) == len(SECRETS)
    for r in rows:
        by_hand = spans_by_hand(texts[r["doc_id"]])
        assert r["spans"] == by_hand
        assert r["base_sha256"] == hashlib.sha256(by_hand.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(by_hand.count(f"{k}:") for k in ("assign", "access", "hex"))
    assert secrets.secret_report(odd, new_path(spark, "ledger")).count() == 10
    assert secrets.secret_report(none, new_path(spark, "ledger")).count() == 0


def test_the_ledger_scans_only_what_it_has_not_seen(spark):
    ledger = new_path(spark, "ledger")
    first = spark.createDataFrame([("a", "secret=abcdefgh1"), ("b", "plain"), ("c", "plain")], "path string, content string")
    secrets.scan(first, ledger).count()
    seen = spark.read.parquet(f"{ledger}/scans")
    assert seen.count() == 2
    more = spark.createDataFrame([("d", "secret=abcdefgh1"), ("e", "new text")], "path string, content string")
    found = {r["path"]: len(r["spans"]) for r in secrets.scan(more, ledger).collect()}
    assert found == {"d": 1, "e": 0} and spark.read.parquet(f"{ledger}/scans").count() == 3
    changed = (*secrets.RULES[:-1], secrets.Rule("pem", "-----BEGIN", "-----BEGIN", base=False))
    assert secrets.version_of(changed) != secrets.version_of(secrets.RULES)
    secrets.scan(first, ledger, changed).count()
    assert spark.read.parquet(f"{ledger}/scans").count() == 5


def test_redaction_keeps_rows_and_lengths(spark, odd):
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in SECRETS], "doc_id long, text string, lang string, source string, n_chars long")
    rows = secrets.secrets_stage(spark, table, "").collect()
    assert len(rows) == len(SECRETS)
    assert all(r["text"] is None or len(r["text"]) == r["n_chars"] for r in rows)
    assert next(r["text"] for r in rows if r["doc_id"] == 5) == "😀 [SECRET] x"
    assert all(spans_by_hand(r["text"]) == "" for r in rows)
    assert secrets.secrets_stage(spark, odd, "").count() == 10
