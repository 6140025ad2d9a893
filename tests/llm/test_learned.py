"""Quality ranking, decontamination and the count filter."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from fixtures import SCHEMA, corpus, lower, words
from pyspark.sql import functions as F

from casework.llm import decontaminate, ngram_lm, quality
from casework.llm.terms import Terms


def _say(rng, n, syllables=("ta", "ri", "mo", "len", "as", "of", "ur", "ki", "be", "no")):
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def _junk(rng, w):
    kind = rng.randrange(4)
    if kind == 0:
        return " ".join(x.upper() + "!!" for x in w)
    if kind == 1:
        return " | ".join(w)
    if kind == 2:
        return " ".join(x + rng.choice(["%%%", "$$$", "###"]) for x in w)
    return " ".join(x for x in w for _ in range(20))


def _labelled(spark, n=400):
    rng, docs, labels = random.Random(5), [], []
    for i in range(n):
        w, bad = _say(rng, rng.randint(20, 150)), i % 5 == 0
        docs.append((i, _junk(rng, w) if bad else " ".join(w) + ".", "en", "src0", 0))
        labels.append((i, int(not bad), None))
    docs += [(n, None, None, None, None), (n + 1, "", "", "", 0), (3, docs[3][1], "de", "src9", 1), (None, "no id " * 9, "en", "s", 1)]
    labels += [(5, 1, 0), (7, None, 0), (None, 1, 0), (11, 7, 1), (12, 0, 1), (12, 1, 1)]
    return (spark.createDataFrame(docs, SCHEMA).withColumnRenamed("lang", "score").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs)


def test_quality_is_learned_without_the_held_out(spark):
    docs, labels, rows = _labelled(spark)
    ranker = quality.train(docs, labels)
    # labels of held-out rows change nothing
    other = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train(docs, other).weights, ranker.weights)
    got = quality.scored(docs, ranker).withColumn("held", quality.held_out("doc_id")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([(r.score >= quality.THRESHOLD) == (r.doc_id % 5 != 0) for r in held]) > 0.97
    same = {r.text: r.score for r in got}
    assert all(same[r.text] == r.score for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= quality.THRESHOLD for r in got)


def test_quality_without_labels_or_rows(spark):
    docs, labels, rows = _labelled(spark, 20)
    got = quality.scored(docs, quality.train(docs, labels.limit(0)))
    assert {r.score for r in got.collect()} == {0.5} and got.count() == len(rows)
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate._length(decontaminate.common_subsequence(masks, len(a), b), len(a)) == table[-1][-1]


def _benchmark(spark, copies=1):
    rng = random.Random(9)
    items = [(i, " ".join(_say(rng, 14)) + ". " + " ".join(_say(rng, 9)) + ".") for i in range(20)]
    items += [(20, None), (21, ""), (22, "too short"), (None, " ".join(_say(rng, 20)))]
    docs, planted = [], set()
    for i in range(150):
        w = _say(rng, rng.randint(0, 200))
        if i % 6 == 0:
            k = rng.randrange(20)
            own = items[k][1].split()
            if i % 12 == 0:  # a paraphrase: one word in six is another
                own = [x if j % 6 else "other" for j, x in enumerate(own)]
            at = rng.randint(0, len(w))
            w[at:at] = own
            planted.add((i, k))
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w), "en", "src0", 0))
    docs += [(200, None, None, None, None), (201, "", "", "", 0), (None, items[3][1], "en", "s", 1), (0, docs[0][1], "en", "s", 1)]
    docs += [(300 + i, items[4][1], "en", "s", 1) for i in range(copies)]
    planted |= {(None, 3), *((300 + i, 4) for i in range(copies))}
    return (spark.createDataFrame(docs, SCHEMA).withColumnRenamed("lang", "item_id").repartition(3),
            spark.createDataFrame(items, "item_id long, text string"), docs, planted)


def test_planted_items_are_found(spark):
    # in the second corpus one item is more frequent than max_df allows terms to be
    for copies in (1, 150):
        docs, benchmark, rows, planted = _benchmark(spark, copies)
        found = decontaminate.hits(docs, benchmark).collect()
        assert {(r.id, r.item_id) for r in found} == planted
        clean = decontaminate.decontaminate(docs, benchmark)
        assert clean.columns == docs.columns
        bad = {t for d, t, *_ in rows if any(p[0] == d for p in planted)}
        assert Counter(r.text for r in clean.collect()) == Counter(t for _, t, *_ in rows if t not in bad or t is None)


def test_parts_of_a_large_benchmark_agree(spark):
    docs, benchmark, _, planted = _benchmark(spark)
    found = decontaminate.hits(docs, benchmark, decontaminate.Settings(part_items=9))
    assert {(r.id, r.item_id) for r in found.collect()} == planted


def test_items_without_their_rarest_words_are_found(spark):
    rng = random.Random(4)
    common = sorted({"".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)})
    items = []
    for i in range(20):
        w = [rng.choice(common) for _ in range(38)]
        for j in range(0, 36, 3):
            w[j] = f"rare{i}x{j}"
        items.append((i, " ".join(w)))
    texts, planted = [[rng.choice(common) for _ in range(100)] for _ in range(400)], set()
    for i in range(0, 400, 20):
        k = i // 20
        texts[i][30:30] = [f"new{j}" if x.startswith("rare") else x for j, x in enumerate(items[k][1].split())]
        planted.add((i, k))
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)], SCHEMA).repartition(3)
    found = decontaminate.hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item_id) for r in found} == planted


def test_items_of_few_words_are_found_in_a_row(spark):
    docs = spark.createDataFrame([(0, "say Open, sesame now", "en", "s", 0), (1, "sesame open", "en", "s", 0), (2, "open", "en", "s", 0),
                                  (3, "sesame", "en", "s", 0), (None, "open sesame", "en", "s", 0)], SCHEMA).coalesce(1)
    items = spark.createDataFrame([(7, "Open sesame!"), (8, None), (9, "")], "item_id long, text string")
    found = decontaminate.hits(docs, items).collect()
    assert {(r.id, r.item_id, r.first_word, r.overlap) for r in found} == {(0, 7, 1, 1.0), (None, 7, 0, 1.0)}


def test_nothing_to_compare_with(spark):
    docs, benchmark, rows, _ = _benchmark(spark)
    assert decontaminate.hits(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    assert decontaminate.hits(docs.limit(0), benchmark).count() == 0


def test_answer_is_the_last_sentence():
    assert decontaminate._answer_words("What is it? A cat and a dog.") == 5
    assert decontaminate._answer_words("one two three four five six") == 2
    assert len(Terms.of(["Don't, stop-now É4"])) == 5


def _score_brute(rows):
    tokens = [[*words(lower(t)), None] for _, t, *_ in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, *_ in rows]
    c, pairs = Counter(), Counter()
    for w, h in zip(tokens, held, strict=True):
        if not h:
            c.update(w)
            pairs.update(zip([None, *w[:-1]], w, strict=True))
    n, v, once = sum(c.values()), len(c), sum(x == 1 for x in pairs.values()) / max(1, sum(pairs.values()))
    out = []
    for (d, *_), w, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        model = 0.0
        for a, x in zip([None, *w[:-1]], w, strict=True):
            lam = (1 - once) * c[a] / (c[a] + 1)
            q = pairs[a, x].bit_length()
            model += math.log10(lam * (2 ** (q - 1) if q else 0) / max(1, c[a]) + (1 - lam) * (c[x] + 1) / (n + v + 1))
        out.append((d, h, len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(model, 6)))
    return Counter(out)


def test_scores(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "held").withColumn("bucket", F.lit(1)).repartition(4)
    got = Counter((None if r.no_id else r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                  for r in ngram_lm.score(docs, bits=64).collect())  # so many bits that no probe errs here
    assert got == _score_brute(rows)


def test_filter_never_forgets_and_rarely_invents():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFF0000))
    counts = rng.geometric(0.3, len(keys)) ** 2
    f = ngram_lm.CountFilter([ngram_lm.fill(keys, counts, 8, 4, 1 << 30).tobytes()], 4, 0.5)
    q = ngram_lm.levels(counts)
    got = f.level(keys, np.full(len(keys), 60))
    assert (got >= q).all() and (got == q).mean() > 0.95
    assert (f.level(rng.integers(0, 2**63, 20_000, dtype=np.uint64), np.full(20_000, 60)) > 0).mean() < 0.05
    assert len(ngram_lm.fill(keys, counts, 8, 4, 1000)) <= 1000


def test_filter_grows_with_the_corpus_and_is_never_gathered(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(_say(rng, 200)) for _ in range(60)]
    pairs = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [*t.split(), None]
            pairs.update(zip([None, *w[:-1]], w, strict=True))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    slices = ngram_lm.train_filter(docs)
    held = sum(c.bit_length() for c in pairs.values())
    size = slices.select(F.sum(8 * F.length("part")).alias("b")).first()["b"]
    assert 8 * held - 64 * slices.count() <= size <= 8 * held + 64 * slices.count()
    # scoring sends no filter to every task
    sent = []
    keep = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or keep(self, x))
    assert ngram_lm.score(docs).count() == len(texts)
    assert not any(isinstance(x, ngram_lm.CountFilter) for x in sent)


def test_no_rows_to_score(spark):
    assert ngram_lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
