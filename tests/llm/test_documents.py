"""Operators on documents, against brute force on small and odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from datewright.llm import common as common_module
from datewright.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup
from llm_rows import ODD

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def key(i):
    return -(10**30) if i is None else i


# Exact dedup


def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r[1] or "")].append(r)
    out = []
    for plain, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), key(r[0])))[0]
        out += [(r[0], best, len(members), r[0] == best, hashlib.sha256(plain.encode()).hexdigest()) for r in members]
    return Counter(out)


def test_exact_dedup(odd, monkeypatch):
    for lane, fan in ((500_000, 8), (3, 2)):
        monkeypatch.setattr(exact_dedup, "LANE_ROWS", lane)
        monkeypatch.setattr(exact_dedup, "FAN_IN", fan)
        got = exact_dedup.exact_dedup(odd.repartition(5)).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == exact_brute(ODD)


def test_exact_stage_keeps_columns(odd):
    out = exact_dedup.deduplicated(odd)
    assert out.columns == odd.columns
    assert sorted(key(r[0]) for r in out.collect()) == sorted(key(i) for i in {1, 6, 7, 8, 9, 10, 11, 3}) or len(out.collect()) == 7


# Line dedup


def line_brute(rows):
    docs = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r")
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
            if len(k) >= 40:
                docs[k].add(i)
    out = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = line.strip(" \t\n\x0b\x0c\r")
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
            if len(docs[k]) >= 5 and i != max(docs[k], key=key):
                continue
            kept.append(line)
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_line_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    shout = "This Line Is Long Enough To Be Taken For A Line Of Its Own"
    rows = [(i, f"own line {i}\n{shout if i % 2 else shout.lower()}  \nshort\n\t{shout}\n" + ("é" * 40 if i < 6 else "é" * 39)) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, shout), (60, "z" * 45), (61, "z" * 45), (62, "z" * 45), (63, "z" * 45)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lo string").repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_digests(docs).collect()}
    assert got == line_brute(rows)


# Mixing


def test_mixing_water_filling(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), s) for i, s in enumerate(["a"] * 5 + ["b"] * 100 + ["c"] * 400 + [None] * 200)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    source_of = {i: s for i, s in enumerate(["a"] * 5 + ["b"] * 100 + ["c"] * 400 + [None] * 200)}
    for r in rows:
        sizes[source_of[r.doc_id]] += r.size
    order = ["a", "b", "c", None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # share out anew until no source is above its most
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        w = sum(weights[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weights[s] / w for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken, targets = Counter(), {}
    for r in rows:
        taken[source_of[r.doc_id]] += r.taken
        targets[source_of[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    assert targets == pytest.approx(target)
    assert all(abs(taken[s] - target[s]) <= 5 for s in order)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(3)).collect())


def test_mixed_repeats_rows(odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.schema == odd.schema
    counts = Counter(r[0] for r in out.collect())
    assert set(counts.values()) <= {1, 2, 3, 4, 6}


# Quality


def counts_brute(text):
    w = WORDS.findall(text or "")
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    marked = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(odd, documents):
    for docs in (odd, documents):
        texts = {(r[0], r[1]) for r in docs.select("doc_id", docs.columns[1]).collect()} if docs is documents else {(r[0], r[1]) for r in ODD}
        by_id = defaultdict(set)
        for i, t in texts:
            c = counts_brute(t)
            by_id[i].add((*c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
        for r in quality_rules.quality_rules(docs).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in by_id[r.doc_id]
            assert not (r.kept and r.base_failed)


def test_quality_rules_sql(spark, sf, documents):
    """The verdicts too, over the whole table."""
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = quality_rules.quality_rules(documents)
    want = c.sql(quality_rules.ORACLE_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r[n] for n in got.columns) for r in got.collect()) == Counter(want.select(", ".join(got.columns)).fetchall())


def test_host_rates_shrink(spark):
    good, bad = "plain words that differ from each other by " + " ".join(f"number{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), "short"
    rows = [(i, good if i % 10 else bad, "big") for i in range(1000)] + [(2000, bad, "tiny")] + [(3000 + i, bad, "spam") for i in range(400)]
    got = {r.host: r for r in quality_rules.host_verdicts(_counted(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got["tiny"].rate == 1.0 and got["tiny"].shrunk < got["spam"].shrunk
    assert got["spam"].verdict == "rejected" and got["big"].verdict == "ordinary"


def _counted(docs):
    from pyspark.sql import functions as F

    c = quality_rules.document_counts(docs, "doc_id", "source").withColumn("failed", quality_rules.base_failed())
    return c.withColumn("host_null", F.col("source").isNull()).withColumnRenamed("source", "host")


def test_quality_classifier_finds_junk(spark, sf, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality_classifier.quality_classifier(documents).collect() if r.doc_id in labels]
    assert all(0 <= r.score <= 1 for r in rows)
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    junk = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(good) / len(good) > 0.98
    assert sum(junk) / len(junk) < 0.15


def em_brute(votes, rounds=100):
    """Expectation-maximisation over documents, one by one: the probability that each is good."""
    n = len(votes[0])
    p = [0.05 if quality_classifier.BAD in v else 0.95 for v in votes]
    for _ in range(rounds):
        prior = [(sum(1 - x for x in p) + 1) / (len(p) + 2), (sum(p) + 1) / (len(p) + 2)]
        table = [[[1.0] * 3, [1.0] * 3] for _ in range(n)]
        for v, x in zip(votes, p, strict=True):
            for i, vote in enumerate(v):
                table[i][0][vote] += 1 - x
                table[i][1][vote] += x
        new = []
        for v in votes:
            odds = [prior[y] for y in (0, 1)]
            for i, vote in enumerate(v):
                odds = [odds[y] * table[i][y][vote] / sum(table[i][y]) for y in (0, 1)]
            new.append(odds[1] / sum(odds))
        if max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-9:
            return new
        p = new
    return p


def test_quality_classifier_brute_force(spark):
    """Posterior labels and scores of a small table, whose documents are all trained on, by loops and dictionaries."""
    import regex
    import xxhash

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:150] + [(r[0] and 1000 + r[0], r[1]) for r in ODD if len(r[1] or "") < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    voted, model = quality_classifier.weak_labels(docs)
    patterns = {r.doc_id: r.pattern for r in voted.collect()}
    found = {i: [p // 3**k % 3 for k in range(len(model.names))] for i, p in patterns.items()}
    votes = [[patterns_of // 3**k % 3 for k in range(len(model.names))] for patterns_of in (r.pattern for r in voted.collect())]
    want = em_brute(votes)
    got = model.posterior(np.array(votes))
    assert np.abs(got - want).max() < 1e-6
    weights = quality_classifier.train(docs, voted, model, len(rows))

    def shape(word):
        return regex.sub(r"\p{N}+", "0", regex.sub(r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}]+", "a", regex.sub(r"\p{Lu}+", "A", word)))

    for r in quality_classifier.quality_classifier(docs).collect():
        texts = [t for i, t in rows if i == r.doc_id]
        ok = []
        for text in texts:
            w = WORDS.findall(text or "")
            total = sum(weights[xxhash.xxh3_64_intdigest(x) % quality_classifier.WORD_BUCKETS] + weights[quality_classifier.WORD_BUCKETS + xxhash.xxh3_64_intdigest(shape(x)) % quality_classifier.SHAPE_BUCKETS] for x in w)
            total += weights[quality_classifier.AGAIN] * sum(a == b for a, b in zip(w, w[1:], strict=False))
            ok.append(1 / (1 + np.exp(-(total / len(w) + weights[-1]))) if w else 0.0)
        assert any(abs(r.score - x) < 1e-9 for x in ok) and r.kept == (r.score >= 0.5)
    assert set(found) == {i for i, _ in rows}


def test_label_model_estimates_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.8
    votes = []
    for accuracy, cover in ((0.95, 0.9), (0.8, 0.7), (0.9, 0.5)):
        right = rng.random(len(y)) < accuracy
        vote = np.where(right == y, quality_classifier.GOOD, quality_classifier.BAD)
        votes.append(np.where(rng.random(len(y)) < cover, vote, quality_classifier.ABSTAINS))
    patterns, counts = np.unique(np.stack(votes, 1), axis=0, return_counts=True)
    model = quality_classifier.estimate(["a", "b", "c"], patterns, counts.astype(float), rounds=500)
    found = model.accuracies()
    assert found["a"] > found["b"] and abs(found["a"] - 0.95) < 0.05


# Language ID


def test_language_id_held_out(documents):
    langs = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    rows = language_id.language_id(documents).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.98


def bayes_brute(train, texts):
    """Naive Bayes by dictionaries: the language of each text and its margin over the next."""
    mix = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]

    def grams(text):
        out = Counter()
        for word in WORDS.findall(text or ""):
            plain = "".join(c for c in word if c.isalpha()).lower()
            marked = f" {plain} "
            for n in (1, 2, 3, 4):
                for i in range(len(marked) - n + 1):
                    g = marked[i : i + n]
                    if g.strip() and not (n == 1 and g == " "):
                        h = n
                        for k, c in enumerate(g):
                            h = (h + ord(c)) * mix[k] % 2**64
                            h ^= h >> 31
                        out[h % language_id.BUCKETS] += 1
        return out

    counts, rows = defaultdict(Counter), Counter()
    for text, lang in train:
        counts[lang] += grams(text)
        rows[lang] += 1
    total = {lang: sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS for lang, c in counts.items()}
    out = []
    for text in texts:
        own = grams(text)
        scores = {lang: np.log(rows[lang] / sum(rows.values())) + sum(n * np.log((counts[lang][g] + language_id.SMOOTHING) / total[lang]) for g, n in own.items()) for lang in counts}
        ranked = sorted(scores.values(), reverse=True)
        out.append((max(scores, key=scores.get) if own else "und", ranked[0] - ranked[1]))
    return out


@pytest.mark.parametrize("at_a_time", [32, 1])
def test_language_id_brute_force(spark, monkeypatch, at_a_time):
    monkeypatch.setattr(language_id, "LANGUAGES", at_a_time)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 3000][:120]
    rows += [(5000 + i, t, None) for i, t in enumerate(["der Zug", "le train", "x", "Ünïcödé ÅÉ", "12 3"])]
    train = [(t, x) for i, t, x in rows if x is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    want = dict(zip((i for i, *_ in rows), bayes_brute(train, [t for _, t, _ in rows]), strict=True))
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(rows) and all(r.lang_pred == want[r.doc_id][0] or want[r.doc_id][1] < 1e-2 for r in got)


def test_language_id_many_languages(spark):
    """More languages than a full matrix has room for."""
    assert language_id.buckets_for(4) == language_id.BUCKETS and language_id.buckets_for(1000) == 1 << 14
    names = [f"l{i:03d}" for i in range(300)]
    rows = [(4 * i + k, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 5, name) for i, name in enumerate(names) for k in range(4)]
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: name for i, _, name in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in got) > 0.95 * len(got)


def test_language_id_memory_of_a_batch():
    """Hashing n-grams takes little more than the texts' words, and the parts of a batch give what the whole gives."""
    import tracemalloc

    words = [f"{'abcdefghij'[i % 10]}é{i:x}".translate(str.maketrans("0123456789", "klmnopqrst")) for i in range(100_000)]
    texts = pa.array([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)] + ["", None])
    model = language_id.Model(["x", "y"], np.random.default_rng(0).random((language_id.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    language_id.predict(texts.slice(0, 1), model)
    tracemalloc.start()
    found, score = language_id.predict(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = [language_id.predict(texts.slice(i, 1), model) for i in range(len(texts))]
    assert found == [x for a, _ in alone for x in a] and np.allclose(score, np.concatenate([s for _, s in alone]))
    assert peak < 400 * len(words), peak / len(words)


def test_language_id_odd(odd, empty):
    got = {r.doc_id: r for r in language_id.language_id(odd).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and got[9].score == 0
    assert got[7].lang_pred in ("en", "de", "fr", "xx") and 0 <= got[7].score <= 1
    assert language_id.accepted(odd).columns == odd.columns
    assert {r[0] for r in language_id.accepted(odd).collect()} == {4, 5, 6, None, 7, 8, 10, 11}


# Packing


def test_packing(odd, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for docs, texts in ((odd, ODD), (documents, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])):
        ids = [[*e.ids, 2] for e in tokenizer.encode_batch([r[1] or "" for r in texts], add_special_tokens=False)]
        want = defaultdict(list)
        for r, x in zip(texts, ids, strict=True):
            want[r[0]].append(x)
        pieces = packing.pack(docs).collect()
        sequences = defaultdict(list)
        lengths = Counter()
        for p in pieces:
            whole = [x for x in want[p.doc_id] if len(x) == p.doc_tokens and x[p.start : p.start + p.length] == np.frombuffer(p.ids, "<u4").tolist()]
            assert whole and zlib.crc32(p.ids) == p.ids_crc32
            sequences[p.sequence_id].append((p.offset, p.length))
            lengths[p.doc_id] += p.length
        assert lengths == {i: sum(map(len, x)) for i, x in want.items()}
        for own in sequences.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096


@pytest.mark.parametrize("capacity", [4096, 512])
def test_packing_across_workers(spark, documents, capacity):
    """Sequences that workers share, and pieces of many batches of a worker, lie without a gap; each class leaves one sequence short at most."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        pieces = packing.pack(documents.repartition(9), capacity=capacity).drop("ids").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sequences, sizes, seen = defaultdict(list), Counter(), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length, p.k))
        sizes[p.k] += 1
        seen[p.doc_id].append((p.start, p.length, p.doc_tokens))
    for own in sequences.values():
        own.sort()
        assert [o for o, *_ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and sum(n for _, n, _ in own) <= capacity
        assert len({k for *_, k in own}) == 1
    assert Counter(own[0][2] for own in sequences.values()) == {k: -(-n // k) for k, n in sizes.items()}
    for own in seen.values():
        own.sort()
        assert [a for a, *_ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]


def test_packing_memory_of_a_batch():
    """Ids of many texts take a worker little more than they are: executors' memory is what the pipeline ran out of."""
    import tracemalloc

    ids_of, texts = packing.WordIds(packing.tokenizer_path()), pa.array(["one two three four "] * 4000 + ["", None, "five " * 150_000])
    want = [packing.WordIds(packing.tokenizer_path()).of(pa.array([t]))[0] for t in ("one two three four ", "", None, "five " * 150_000)]
    ids, offsets = ids_of.of(pa.concat_arrays([texts] * 10))
    assert len(ids) == 10 * (20_000 + 2 + 150_001) and offsets[-1] == len(ids)
    assert all(np.array_equal(ids[offsets[i] : offsets[i + 1]], want[j]) for i, j in ((0, 0), (3999, 0), (4000, 1), (4001, 2), (4002, 3), (4003, 0), (40029, 3)))
    tracemalloc.start()
    ids, _ = ids_of.of(pa.array(["one two three four "] * 150_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(ids), peak / len(ids)


def test_packing_cuts_leave_little_unused():
    lengths = np.random.default_rng(0).integers(1, 20_000, 3000)
    doc, start, size = packing.cut(lengths)
    assert np.bincount(doc, weights=size).tolist() == lengths.tolist()
    k = 4096 // size
    assert (size * k / 4096).mean() > 0.98 and size.max() <= 4096
    assert len(doc) < 6 * len(lengths) + (lengths // 4096).sum()


def test_short_classes_hold_one_length():
    import math

    for capacity in (4096, 1000, 4095, 17):
        by_class = defaultdict(set)
        for n in range(1, capacity + 1):
            by_class[capacity // n].add(n)
        assert all(len(v) == 1 for k, v in by_class.items() if k > math.isqrt(capacity) + 1)


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", "It's don't WE'LL 'tis '' ''s x'sx", "ÀÉÎ groß İstanbul ΣΑΣ ﬁ", "äb é\x85z \x1cq", "<|endoftext|> a<|startoftext|>b <|", "12a1b2 ½ ² ٣", "日本語 テ 😀a😀b", "\x00nul\x01 \x7f", "ªº × ÷ a×b", "ﾊﾝｶｸ ㎏"]
    ids, offsets = packing.WordIds(packing.tokenizer_path()).of(pa.array(texts), None)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_are_not_cut_short():
    """Where words can't be encoded one by one, whole texts are."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, offsets = packing.encoder(path).of(pa.array(["Two  Words\n", None, "don't"]), 2)
    assert isinstance(packing.encoder(path), packing.WholeIds) and isinstance(packing.encoder(packing.tokenizer_path()), packing.WordIds)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [[*e.ids, 2] for e in Tokenizer.from_file(path).encode_batch(["Two  Words\n", "", "don't"], add_special_tokens=False)]


# Near-duplicates


def labelled_windows(text):
    w = WORDS.findall(text or "")
    times, out = Counter(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        window = tuple(w[i : i + 5])
        out.append((window, times[window]))
        times[window] += 1
    return out


def lined_up(x, y):
    """The longest common subsequence of two lists without repeats, by all chains."""
    places = {k: i for i, k in enumerate(x)}
    at = [places[k] for k in y if k in places]
    best = []
    for i, p in enumerate(at):
        best.append(1 + max((b for q, b in zip(at[:i], best, strict=True) if q < p), default=0))
    return max(best, default=0)


def alike(x, y):
    """By the sets of different windows, or by the alignment of labelled ones."""
    share = lambda a, b: len(a & b) / len(a | b)
    if share({w for w, _ in x}, {w for w, _ in y}) >= 0.8:
        return True
    if share(set(x), set(y)) < 0.8:
        return False
    a = lined_up(x, y)
    return a >= 0.8 * (len(x) + len(y) - a)


def near_brute(rows):
    lists = {key(r[0]): labelled_windows(r[1]) for r in rows}
    parent = {i: i for i in lists}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sizes = {i: (len({w for w, _ in x}), len(x)) for i, x in lists.items() if x}
    for a, b in combinations(sorted(sizes), 2):
        if any(min(n, m) >= 0.8 * max(n, m) for n, m in zip(sizes[a], sizes[b], strict=True)) and find(a) != find(b) and alike(lists[a], lists[b]):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in lists}


def test_near_duplicates(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = near_brute(rows)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents.repartition(6)).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (i == r.class_id) for i, r in got.items())


def test_near_duplicates_borderline(spark):
    """Families of copies around the threshold, and a passage that unlike documents share."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for family in range(25):
        base = [word() for _ in range(int(rng.integers(8, 300)))]
        for _ in range(6):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 30)))):
                copy[int(rng.integers(len(copy)))] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    for _ in range(60):
        rows.append((i, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(20)])))
        i += 1
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == near_brute(rows)


def test_near_hub(spark):
    """Texts that are similar to one text only, whose id isn't the smallest: a passage that all share, and in all but the hub words of their own."""
    passage = " ".join(f"shared{i}" for i in range(404))
    rows = [(i, passage if i == 777 else passage + " " + " ".join(f"w{i}x{j}" for j in range(94))) for i in range(2500)]
    other = [(10_000 + i, " ".join(f"shared{j}" for j in range(200)) + " " + " ".join(f"o{i}x{j}" for j in range(60))) for i in range(300)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows + other, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: 0 for i, _ in rows} | {i: i for i, _ in other}


def test_near_moved(spark):
    """Swapped halves, and blocks in reverse, have the same windows but for those at the seams."""
    rows = []
    for i in range(60):
        long, short = [f"l{i}x{j}" for j in range(404)], [f"s{i}x{j}" for j in range(44)]
        again = [*long[:100], *long[:100], *long[200:]]  # repeated windows
        moved = [long[202:] + long[:202], [w for at in (303, 202, 101, 0) for w in long[at : at + 101]]]
        rows += [(10 * i + j, " ".join(w)) for j, w in enumerate([long, *moved])]
        rows += [(10 * i + 4 + j, " ".join(w)) for j, w in enumerate([short, short[22:] + short[:22], again, again[202:] + again[:202]])]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == near_brute(rows)
    assert len(set(got.values())) <= 180


@pytest.mark.parametrize(("own", "pairs"), [(9, 600), (13, 300)])
def test_near_template(spark, own, pairs):
    """Pairs of one template, in ids that lie apart: unlike pairs come close to the threshold, and no pair is lost."""
    rng = np.random.default_rng(own)
    numbers = rng.permutation(2 * pairs).reshape(pairs, 2).tolist()
    shared = 1 if own == 9 else 4
    rows = []
    for i, both in enumerate(numbers):
        for n in both:
            rows.append((n, " ".join([f"template{j}" for j in range(83)] + [f"pair{i}x{j}" for j in range(shared)] + [f"own{n}x{j}" for j in range(own - 3 * (own > 9))])))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {n: min(both) for both in numbers for n in both}


def test_near_alignment_decides(spark):
    """Texts of one line, over and over, have few different windows in common but line up; in another order of as many lines they don't."""
    line = [f"line{j}" for j in range(20)]
    rows = [(n, " ".join(line * 30 + [f"own{n}x{j}" for j in range(40)])) for n in range(40)]
    x, y = (near_dedup.shingles(pa.array([rows[n][1]]))[0] for n in (0, 1))
    x, y = (near_dedup.labelled(v, near_dedup.occurrences(v, np.zeros(len(v), np.int64))) for v in (x, y))
    different = [set(v[v % 2 == 0].tolist()) for v in (x, y)]
    assert len(different[0] & different[1]) < 0.5 * len(different[0] | different[1])
    assert near_dedup.similarity(x, y) == pytest.approx(600 / (2 * len(x) - 600), abs=0.02) and near_dedup.similarity(x, y) >= 0.8
    rows += [(100 + n, " ".join(line * 5 + [f"more{n}x{j}" for j in range(40)])) for n in range(40)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == near_brute(rows) == {n: 0 if n < 100 else n for n, _ in rows}


def test_near_odd(odd):
    out = near_dedup.deduplicated(odd)
    assert out.columns == odd.columns
    assert Counter(r[0] for r in out.collect()) == Counter([1, 2, 3, None, 7, 8, 9, 10, 11])


def test_alignment():
    x = 2 * np.arange(100, dtype=np.uint64)  # even: windows that come first
    assert near_dedup.aligned(x, x) == 100
    assert near_dedup.aligned(x, np.delete(x, [5, 50])) == 98
    assert near_dedup.similarity(x, np.concatenate([x[50:], x[:50]])) == 1.0  # a moved half is out of the band, but the sets are the same
    assert near_dedup.aligned(x, np.concatenate([x[50:], x[:50]])) < 60
    assert near_dedup.similarity(x, x[:79]) == 0.0


# Suffix-array dedup


def suffix_brute(rows):
    first = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for j in range(len(b) - 49):
            s = b[j : j + 50]
            if s not in first or first[s] > key(i):
                first[s] = key(i)
    out = defaultdict(list)
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < key(i):
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i].append((len(b), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return out


EDGES = [(2000, "abc" * 40), (2001, "abc" * 40 + "Z"), (2002, "é" * 60 + "\x00" * 80), (2003, "\x00" * 70), (2004, "q" + "é" * 60), (None, "abc" * 30), (None, "abc" * 31)]


def suffix_same(spark, rows, partitions):
    want = suffix_brute(rows)
    got = suffix_dedup.suffix_dedup_digests(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ends int").repartition(partitions)).collect()
    assert len(got) == len(rows)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in want[r.doc_id] for r in got)


@pytest.mark.parametrize(("shard", "hot", "fan"), [(3_000_000, 64, 64), (20_000, 64, 64), (20_000, 2, 3), (5_000, 1, 2)])
def test_suffix_dedup(spark, monkeypatch, shard, hot, fan):
    """All documents of a small table and the odd rows, very long ones among them; in shards so small that texts meet in lanes, and in trees of several levels."""
    for name, value in (("SHARD_BYTES", shard), ("HOT_SHARDS", hot), ("FAN_IN", fan)):
        monkeypatch.setattr(suffix_dedup, name, value)
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    suffix_same(spark, [(r.doc_id, r.text) for r in documents.collect()] + [(r[0] if r[0] is None else 1000 + r[0], r[1]) for r in ODD] + EDGES, 5)


def test_suffix_short_texts(spark):
    """Shards without a string of 50 bytes."""
    rows = [(i, "short" if i % 2 else None) for i in range(8)]
    suffix_same(spark, rows, 8)
    suffix_same(spark, [*rows, (9, "y" * 49), (10, "x" * 50), (11, "x" * 50)], 8)


def test_suffix_hot_passage(spark, monkeypatch):
    """A passage that lies in every shard, in documents of any order, and near-copies of it."""
    for name, value in (("SHARD_BYTES", 2_000), ("HOT_SHARDS", 4), ("FAN_IN", 4)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = np.random.default_rng(3)
    passage = " ".join(f"passage{i}" for i in range(40))
    own = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))
    rows = [(int(i), own(int(rng.integers(20, 80))) + " " + (passage if i % 4 else passage.replace("passage17", f"other{i % 8}")) + " " + own(10)) for i in rng.permutation(300)]
    suffix_same(spark, rows + [(3, passage), (3, passage), (None, passage[40:200]), (None, passage[41:220])], 7)


def test_suffix_messages_of_many_lanes(monkeypatch):
    """A shard's messages are cut from arrays made once: lanes grow with the input, and work for each would grow with its square."""
    text = np.frombuffer(np.random.default_rng(0).bytes(50_000), np.uint8)
    docs, ends = np.arange(2).tobytes(), np.array([25_000, 50_000]).tobytes()
    calls, flatnonzero = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: calls.append(1) or flatnonzero(x))
    strings, counts = [], []
    for lanes in (3, 300):
        shard = suffix_dedup.Shard(docs, ends, suffix_dedup._pack(text), 50)
        shard.anchors(lanes)
        keys, _ = shard.keys()
        full, sizes = np.unique((keys >> np.uint64(32)).astype(np.int64), return_counts=True)
        found = [{"lane": k, "bits": np.packbits(np.ones(n, bool)).tobytes()} for k, n in zip(full.tolist(), sizes.tolist(), strict=True)]
        columns = {"shard": pa.array([5]), "docs": pa.array([docs]), "ends": pa.array([ends]), "text": pa.array([suffix_dedup._pack(text)]), "found": pa.array([found])}
        calls.clear()
        sent = [r for b in suffix_dedup._resolved(lanes, 50, 1)(iter([pa.RecordBatch.from_pydict(columns)])) for r in b.to_pylist()]
        counts.append(len(calls))
        asked = [suffix_dedup._unblob(r["blob"], "<u2", "<u2", "<i8", "u1") for r in sent if r["lane"] >= 0]
        assert len(asked) == len(full) and all(len(size) == len(doc) and len(run) == size.sum(dtype=np.int64) + 49 * len(size) for size, _, doc, run in asked)
        strings.append(sorted((d, t[i : i + 50]) for size, _, doc, run in asked for d, n, e in zip(doc.tolist(), size.tolist(), np.cumsum(size.astype(int) + 49).tolist(), strict=True) for t in [run[e - n - 49 : e].tobytes()] for i in range(n)))
    assert strings[0] == strings[1] == sorted((k, text[25_000 * k + i : 25_000 * k + i + 50].tobytes()) for k in range(2) for i in range(24_951))
    assert counts[0] == counts[1]


@pytest.mark.parametrize("text", [b"banana bandana banana band " * 8, b"a" * 300, bytes(np.random.default_rng(2).choice(list(b"ab"), 2000).tolist()), b"\x00\xff" * 50 + b"\xff\x00\x00" * 40])
def test_suffix_array_order(text):
    """Sorted by 64 bytes, or up to the end: beyond it there are less than any byte."""
    data = np.frombuffer(text, np.uint8)
    padded = np.concatenate([data, np.zeros(128, np.uint8)])
    words = np.ndarray((len(data),), ">u8", padded.data, 0, (1,)).astype(np.uint64)
    order = suffix_dedup.suffix_array(data, np.arange(len(data)), words)
    assert sorted(order.tolist()) == list(range(len(data)))
    head = [text[i : i + 64] for i in order if i + 64 <= len(data)]
    assert head == sorted(head)
    # of those that reach beyond the end only what lies within it is told apart
    assert all(a[: min(len(a), len(b))] <= b[: min(len(a), len(b))] for a, b in zip([text[i : i + 64] for i in order[:-1]], [text[i : i + 64] for i in order[1:]], strict=True))
    little = np.ndarray((len(data) + 64,), "<u8", padded.data, 0, (1,)).astype(np.uint64)
    prefix = suffix_dedup.common_prefixes(little, np.arange(len(data)), np.asarray(order), 24)
    for n, (a, b) in enumerate(zip(order[:-1], order[1:], strict=True), 1):
        if max(a, b) + 24 < len(text):
            assert min(prefix[n], 24) == next((k for k in range(24) if text[a + k] != text[b + k]), 24)


# All of them


def test_shared_folder_is_named_on_a_cluster():
    from datewright.llm import common

    class Conf:
        def __init__(self, found):
            self.found = found

        def get(self, *_):
            return self.found

    def session(master, found=None):
        return type("S", (), {"conf": Conf(found), "sparkContext": type("C", (), {"master": master, "applicationId": "a"})})

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            common.shared_dir(session(master))
    assert common.shared_dir(session("yarn", "hdfs:/x/")) == "hdfs:/x/llm-a"
    assert common.shared_dir(session("local[4]")).endswith("llm-a")


def test_sieve(spark):
    """What may have a partner, and what has none; with far more keys than the bitmap has room for, all may."""
    from datewright.llm import common

    left = spark.range(20_000).withColumn("s", F.when(F.col("id") % 2 == 0, "x"))
    keys = left.filter("id % 10 = 0").select("id", "s")
    may, none = common.sieved(left, keys, 2000)
    assert may.columns == left.columns == none.columns and may.count() + none.count() == 20_000
    assert may.join(keys, "id").count() == 2000 and may.count() < 4000
    may, none = common.sieved(left, keys, 0)
    assert may.join(keys, "id").count() == 2000 and none.join(keys, "id").count() == 0
    may, none = common.sieved(left, keys.limit(0), 0)
    assert may.count() == 0 and none.count() == 20_000


def test_hot_line(spark, monkeypatch):
    """A line that nearly all documents have, over many Arrow batches of one task."""
    monkeypatch.setattr(common_module, "BATCH_ROWS", 50)
    shout = "This line is in nearly all documents, and it is long enough"
    rows = [(i, f"own {i}\n{shout if i % 20 else 'other ' * 10}\n{shout.upper() if i % 3 == 0 else 'x'}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_digests(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == line_brute(rows)


def test_odd_rows_do_not_crash(odd, empty):
    operators = [exact_dedup.exact_dedup, line_dedup.line_dedup_digests, mixing.mix, quality_rules.quality_rules, quality_classifier.quality_classifier, language_id.language_id, packing.pack, near_dedup.near_duplicates, suffix_dedup.suffix_dedup_digests]
    for f in operators:
        rows = f(odd).collect()
        assert Counter(r.doc_id for r in rows) >= Counter({r[0] for r in ODD}), f
        assert f(empty).collect() == [], f
    for f in (exact_dedup.deduplicated, near_dedup.deduplicated, mixing.mixed, language_id.accepted):
        assert f(empty).collect() == [] and f(empty).columns == empty.columns
