"""Budgets, seeded prefixes and shards against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import SCHEMA, corpus, rank, words
from pyspark.sql import functions as F

from casework.llm import mixing, queries, sharding


def share(have, children):
    """children: (order, cap, weight) -> what each gets, by filling the fullest first."""
    children = sorted((c / w, k, c, w) for k, c, w in children if c > 0 and w > 0)
    out, left, weight = {}, have, sum(c[3] for c in children)
    for i, (_, k, cap, w) in enumerate(children):
        if cap * weight <= left * w:
            out[k] = cap
            left, weight = left - cap, weight - w
        else:
            out |= {k2: left * w2 // weight for _, k2, _, w2 in children[i:]}
            break
    return out


def domain(source):
    n = "".join(c for c in source[::-1] if c.isdigit())[::-1] if source[-1:].isdigit() else ""
    return "other" if not n else "web" if int(n) < 7 else "reference" if int(n) < 14 else "forum"


def weight(weights, level, name):
    return weights.get(level, {}).get(name, weights.get("default", {}).get(level, 1))


def mix_brute(rows, weights, budget, epochs, seed=0):
    leaves = defaultdict(list)
    for d, t, lang, source, *_ in rows:
        s = source if source is not None else "(none)"
        leaves[domain(s), lang if lang is not None else "(none)", s].append((str(d) if d is not None else "", len(words(t)), d, t))
    tokens = {k: sum(n for _, n, *_ in v) for k, v in leaves.items()}
    cap = Counter()
    for (d, lang, s), n in tokens.items():
        for k in ((d,), (d, lang), (d, lang, s)):
            cap[k] += n * epochs
    top = share(sum(tokens.values()) * budget[0] // budget[1], [(d, c, weight(weights, "domain", d)) for (d, *r), c in cap.items() if not r])
    out = Counter()
    for d, have in top.items():
        langs = share(have, [(k[1], c, weight(weights, "lang", k[1])) for k, c in cap.items() if len(k) == 2 and k[0] == d])
        for lang, own in langs.items():
            for s, give in share(own, [(k[2], c, weight(weights, "source", k[2])) for k, c in cap.items() if len(k) == 3 and k[:2] == (d, lang)]).items():
                if not give:
                    continue
                full, rest = divmod(give, tokens[d, lang, s])
                key = lambda x: (hashlib.md5(f"{seed}:{full}:{x[0]}".encode()).hexdigest(), x[0])  # noqa: B023, E731
                total, by = 0, defaultdict(list)
                for x in leaves[d, lang, s]:
                    by[key(x)].append(x)
                for k in sorted(by):
                    total += sum(x[1] for x in by[k])
                    for _, _, i, t in by[k]:
                        for e in range(full + (rest > 0 and total <= rest)):
                            out[i, t, e] += 1
    return out


@pytest.mark.parametrize("seed,budget,epochs", [(0, (3, 4), 2), (1, (1, 1), 1), (2, (7, 4), 2), (3, (1, 50), 3), (4, (5, 1), 2)])
def test_mix(spark, seed, budget, epochs):
    rows = corpus(seed)
    weights = {"domain": {"web": 3, "other": 1}, "lang": {"en": 1, "de": 9, "(none)": 0}, "source": {"src0": 5}, "default": {"lang": 2}}
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "epoch").withColumn("n", F.lit(1)).repartition(5)
    got = mixing.mix(docs, weights, budget, epochs, domain_col="domain")
    assert got.columns == ["doc_id", "text", "lang", "source", "n", "epoch", "domain"]
    assert Counter((r.doc_id, r.text, r.epoch) for r in got.collect()) == mix_brute(rows, weights, budget, epochs)


def test_shortage_goes_to_siblings_first(spark):
    """src8 cannot use its share: src9 of its own language gets it, then the other language, then the other domain."""
    rows = [(i, "w " * 10, lang, s, 0) for i, (lang, s) in enumerate(
        [("en", "src8")] + [("en", "src9")] * 30 + [("de", "src8")] * 30 + [("en", "src1")] * 60)]
    leaves = (spark.createDataFrame(rows, SCHEMA).groupBy(F.lit("x").alias("_d"), "lang", "source").count())
    leaves = leaves.select(mixing.domain_of(F.col("source")).alias("_domain"), F.col("lang").alias("_lang"),
                           F.col("source").alias("_source"), (F.col("count") * 10).alias("tokens"))
    got = {(r._lang, r._source): r.give for r in mixing.budgets(leaves, {}, (400, 1210), 1).collect()}
    assert got == {("en", "src8"): 10, ("en", "src9"): 90, ("de", "src8"): 100, ("en", "src1"): 200}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty, queries.MIX_WEIGHTS).count() == 0
    assert sharding.shard_documents(empty, 4).count() == 0 and sharding.shard_positions(empty, 4).count() == 0


@pytest.mark.parametrize("seed,n", [(0, 24), (1, 3), (2, 500)])
def test_shards(spark, seed, n):
    rows = corpus(seed) + [(3, "again", "en", "src0", 0)] * 40
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "shard").withColumnRenamed("source", "n").repartition(5)
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    order = sorted(rows, key=lambda r: (*rank(r[0]), size(r[1]), crc(r[1])))
    total, at, slots, want = sum(size(r[1]) for r in rows), 0, Counter(), Counter()
    for d, t, *_ in order:
        k = (2 * at + size(t)) * n // (2 * total)
        want[d, size(t), crc(t), k, slots[k]] += 1
        slots[k] += 1
        at += size(t)
    pos = sharding.shard_positions(docs, n)
    assert Counter((r._id, r._size, r._crc, r.shard, r.slot) for r in pos.collect()) == want
    whole = sharding.shard_documents(docs, n)
    assert whole.columns == ["doc_id", "text", "n", "n_chars", "shard", "slot"]
    assert Counter((r.doc_id, size(r.text), crc(r.text), r.shard, r.slot) for r in whole.collect()) == want


def test_columns_keep_their_names_and_values(spark):
    names = ["copy", "_id", "_size", "_crc", "_lang", "_key", "_full", "_source", "_domain", "_range", "_times", "n", "row", "start",
             "_part", "_doc", "_i", "_before"]
    rows = corpus(3, 30)
    rows += [rows[0]] * 40  # many equal rows
    df = spark.createDataFrame(rows, SCHEMA)
    for k, name in enumerate(names):
        df = df.withColumn(name, F.lit(77 + k))
    df = df.repartition(5)
    cut = sharding.shard_documents(df, 3)
    assert cut.columns == [*df.columns, "shard", "slot"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.slot, r.shard) for r in cut.collect())
    assert len(got) == len(rows) == len({(r[4], r[3]) for r in got})
    weights = {"default": {"domain": 1, "lang": 1, "source": 1}}
    mixed = mixing.mix(df, weights, (1, 1), 1, epoch_col=None)
    plain = mixing.mix(df.select(*df.columns[:5]), weights, (1, 1), 1, epoch_col=None)
    for part in (cut, mixed):
        kept = part.select(names).distinct().collect()
        assert [tuple(r) for r in kept] == [tuple(range(77, 77 + len(names)))]
    assert sorted(map(str, mixed.select(*df.columns[:5]).collect())) == sorted(map(str, plain.collect()))


def test_copies_are_numbered_where_they_lie(spark):
    df = spark.range(0, 2000, numPartitions=8).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "id as mark")
    got = sharding.shard_documents(df, 4).collect()
    assert sorted(r.mark for r in got) == list(range(2000))
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(500))
