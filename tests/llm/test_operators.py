"""The training-data operators against brute force on small fixtures with nulls, ties, repeats and clashing columns."""

import math
import os
import random
import re
import threading
import time
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import common, decontaminate, html_extract, jaccard, licenses, mixing, pii, quality, sharding, toxicity, url_filters
from corpusgraph.operators.state import release

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and", "casa", "Über", "naïve!", "###"]
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "one", "b"), (4, "one", "b"), (None, "no id here", "b"), (5, "ONE", None), (6, "x " * 3000, "c")]
    for i in range(10, n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))]
        text = "".join(w + rng.choice(" " * 9 + "\n") for w in words)
        rows.append((i, text, rng.choice("abcd")))
        if rng.random() < 0.4:
            changed = list(words)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(len(changed))] = "zz"
            rows.append((100 + i, " ".join(changed), rng.choice("abcd")))
    return rows


def frame(spark, rows):
    """Documents with columns whose names clash with those of results."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"kept": F.lit("k"), "size": F.lit(-1), "n_words": F.lit(-1), "row": F.lit(0), "score": F.lit("s"), "id": F.lit("i")}).repartition(3)


def empty(df):
    return df.limit(0)


def against_sql(out, sql, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    want = con.execute(sql).df()
    got = out.toPandas()[list(want.columns)]
    tidy = lambda d: sorted(map(tuple, d.astype(object).where(d.notna(), None).map(lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)).values.tolist()), key=str)
    assert tidy(got) == tidy(want)


def test_quality(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = quality.score(docs)
    assert out.count() == len(rows)
    for r in out.collect():
        text = {d: t for d, t, _ in rows}[r["doc_id"]] or ""
        w = SPACE.findall(text)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    against_sql(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), quality.oracle_sql(), documents=pdf)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert quality.score(empty(docs)).count() == 0 and quality.keep_good(empty(docs)).count() == 0


def test_quality_shared_hashes(spark):
    """Windows that share a hash, as in A B A, hide no repeat: with 2, 3 or 64 - 24 bits the counts are the same."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice(["", "", "x"]) for _ in range(rng.randrange(0, 400)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        w = t.split()
        seen = Counter(zip(w, w[1:], w[2:]))
        want[i] = len({p for j, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for p in (j, j + 1, j + 2)})
    for bits in (2, 3, 40):
        got = quality.features(docs, [F.col("doc_id")], hash_bits=bits).select("__k0", "__f.n_repeat_words").collect()
        assert {r[0]: r[1] for r in got} == want, bits


def brute_classes(rows, p):
    sets, best = {}, {}
    for d, t, _ in rows:
        w = (t or "").encode().translate(jaccard.LOWER).split()
        s = frozenset(tuple(w[i : i + p.shingle]) for i in range(max(1, len(w) - p.shingle + 1))) if w else frozenset()
        if d is not None:
            sets.setdefault(d, []).append(s)
    ids = sorted(sets)
    best = {i: i for i in ids}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= p.percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                best[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("p", [jaccard.JaccardParams(3, 90, light=3, spread=1.3), jaccard.JaccardParams(block_rows=4, leaf_rows=2, fanout=2), jaccard.JaccardParams(block_rows=4, hot_sets=2, broadcast_rows=3)])
def test_jaccard(spark, p):
    rows = corpus(1, 90)
    base = " ".join(f"v{i}" for i in range(120)).split()
    rng = random.Random(8)
    for i in range(40):  # one group of near copies, larger than a block
        near = list(base)
        for _ in range(rng.randrange(3)):
            near[rng.randrange(120)] = f"q{rng.randrange(9)}"
        rows.append((1000 + i, " ".join(near), "a"))
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(40):  # one passage in otherwise different documents, some of which have near copies
        own = " ".join(f"o{i // 2}x{j}" for j in range(90))
        rows.append((2000 + i, f"{passage} {own}" + " z" * (i % 3), "b"))
    docs = frame(spark, rows)
    got = jaccard.classes(docs, p=p).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == brute_classes(rows, p)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    against_sql(spark.createDataFrame(got), jaccard.oracle_sql(p), documents=pdf)
    kept = jaccard.keep_one(docs, p=p)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *brute_classes(rows, p).values()}
    assert jaccard.classes(empty(docs), p=p).count() == 0


def test_jaccard_moves_few_texts(spark):
    """Fingerprints are in no table, and beyond the broadcast limit only texts that can match are shuffled."""
    docs = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"))
    few = spark.range(0, 3000, 50).select(F.col("id").alias("few"))
    may = common.sieve(few)
    passed = [r["id"] for r in docs.where(may(F.col("id"))).select("id").collect()]
    assert set(passed) >= set(range(0, 3000, 50)) and len(passed) < 200
    assert sorted(r["id"] for r in common.joined_few(docs, F.col("id"), few, "few", 3).collect()) == list(range(0, 3000, 50))
    assert sorted(r["id"] for r in common.without(docs, F.col("id"), few, "few", 3).collect()) == [i for i in range(3000) if i % 50]
    assert "prints" not in jaccard._profiles(docs, jaccard.JaccardParams()).columns


def test_without_moves_no_texts(spark):
    """Keys alone are compared; a null key stays, and of the rows that seem to be some of few's those that are not."""
    docs = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("x").alias("text")).unionAll(spark.range(20).selectExpr("7", "'again'"))
    few = spark.range(0, 3000, 2).withColumnRenamed("id", "few")
    out = common.without(docs, F.col("id"), few, "few", 3)
    assert Counter((r["id"], r["text"]) for r in out.collect()) == Counter([(None, "x"), *[(i, "x") for i in range(1, 3000, 2)], *[(7, "again")] * 20])
    moved = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert not moved


def test_dead_shuffles_are_deleted(spark, monkeypatch):
    """What the phases of the near-duplicate join shuffled is gone with the phase, not whenever the driver collects garbage."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["ka", "mo", "ti", "su"]) + str(rng.randrange(300)) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, texts[i % 40] + " end" * (i // 40)) for i in range(120)], "doc_id long, text string")
    release(spark)
    time.sleep(2)
    before, seen = files(), []
    monkeypatch.setattr(jaccard, "release", lambda s: (release(s), time.sleep(2), seen.append(files() - before)))
    assert jaccard.keep_one(docs).count() == 40
    assert len(seen) > 3 and max(seen) < 40, seen


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50))


def test_decontaminate(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"b{rng.randrange(300)}" for _ in range(rng.choice([3, 9, 10, 25])))) for i in range(12)] + [(50, None), (51, "..."), (None, "b1 b2 b3"), (0, "b7 b8 b9")]
    rows = corpus(2)
    for i, (_, t) in enumerate(items[:12]):
        w = t.upper().split()
        rows.append((500 + i, "lead in, " + "-".join(w[: max(len(w) - 5, 3)]) + " tail", "a"))
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    pdf, bdf = (pd.DataFrame(r, columns=c).astype({c[0]: "Int64"}) for r, c in ((rows, ["doc_id", "text", "source"]), (items, ["item_id", "text"])))
    small = decontaminate.DecontaminateParams(block_words=40, piece_words=7, filter_bits=1 << 12)
    for p in (decontaminate.DecontaminateParams(), small):
        out = decontaminate.inspect(docs, bench, p=p)
        against_sql(out, decontaminate.oracle_sql(), documents=pdf, benchmark=bdf)
    hit = out.where("contaminated").count()
    assert hit
    assert decontaminate.clean(docs, bench).count() == len(rows) - hit
    whole = lambda **k: sorted((tuple(r) for r in decontaminate.clean(docs, bench, p=decontaminate.DecontaminateParams(action="cut", **k)).collect()), key=str)
    assert decontaminate.clean(docs, bench, p=decontaminate.DecontaminateParams(action="cut")).columns == docs.columns
    assert len(whole()) == len(rows) and whole() == whole(block_words=40, piece_words=7)
    assert decontaminate.inspect(docs, empty(bench)).where("contaminated").count() == 0
    assert decontaminate.inspect(empty(docs), bench).count() == 0


def test_decontaminate_many_blocks(spark, monkeypatch):
    """Fifty blocks: one broadcast of windows at a time, and the hits of one block."""
    rng = random.Random(12)
    bench = spark.createDataFrame([(i, " ".join(f"t{rng.randrange(5000)}" for _ in range(60))) for i in range(50)], "item_id long, text string")
    texts = [r["text"] for r in bench.collect()]
    docs = spark.createDataFrame([(i, f"start {texts[i % 50][10:300]} end" if i % 3 else "nothing of it " * 9) for i in range(200)], "doc_id long, text string")
    alive, most = set(), 0
    real = spark.sparkContext.broadcast

    def counting(value):
        nonlocal most
        b = real(value)
        if isinstance(value, decontaminate.WindowSet):
            alive.add(id(b))
            most = max(most, len(alive))
            gone = b.destroy
            b.destroy = lambda: (alive.discard(id(b)), gone())
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", counting)
    rows = lambda p: sorted(map(tuple, decontaminate.inspect(docs, bench, p=p).collect()))
    many = rows(decontaminate.DecontaminateParams(block_words=60))
    assert most == 1 and not alive
    monkeypatch.undo()
    assert many == rows(decontaminate.DecontaminateParams()) and sum(r[-1] for r in many) == 133


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), s) for i in range(300) for s in [["a", "b", "c", None, "é"][i % 5 if i % 3 else 0]]] + [(7, "w w w", "b"), (7, "w w w", "b"), (900, None, "z"), (None, "w w", "a")]
    docs = frame(spark, rows)
    p = mixing.MixParams(least_slices=8)
    out = mixing.allocate(docs, p=p)
    assert out.count() == len(rows)
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    against_sql(out.drop("source"), mixing.oracle_sql(p), documents=pdf)
    per = out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["k"] - r["t"]) <= 17 and r["t"] <= 2 * r["s"] for r in per)
    mixed = mixing.mix(docs, p=p)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.size(F.array_remove(F.split("text", " "), "")))).first()[0] == out.agg(F.sum("taken")).first()[0]
    heavy = docs.withColumn("w", F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(1.0))
    more = mixing.allocate(heavy, weight="w", p=p).where("source = 'a' and size > 0").groupBy(F.col("doc_id") % 2 == 0).agg(F.sum("taken") / F.sum("size")).collect()
    got = dict(tuple(r) for r in more)
    assert got[True] > got[False]
    equal = mixing.allocate(docs, weight=F.lit(1.0), p=p).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r["k"] - r["t"]) <= 17 for r in equal)
    assert mixing.allocate(empty(docs)).count() == 0 and mixing.mix(empty(docs)).count() == 0


def test_sharding(spark):
    rows = corpus(5)
    docs = frame(spark, rows)
    p = sharding.ShardParams(target_bytes=4000, batch_rows=4, least_runs=2)  # no run needs more than one shard
    out = sharding.assignments(docs, p=p)
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    against_sql(out, sharding.oracle_sql(p), documents=pdf)
    store = sharding.ShardStore(spark, common.shared_path(spark, "store"), p)
    store.append(docs, F.floor(F.col("doc_id") / 4))
    store.append(docs, F.floor(F.col("doc_id") / 4) + 1000)
    assert store.version() == 2 and store.manifest(1).agg(F.sum("n_rows")).first()[0] == len(rows)
    with pytest.raises(RuntimeError):
        store.commit(store.manifest(), 2)
    whole = sharding.shard(docs, p=p)
    assert whole.select("doc.*").columns == docs.columns and whole.count() == len(rows)
    assert sharding.assignments(empty(docs), p=p).count() == 0


def test_mixing_long_documents(spark):
    """A long document among many short ones in each source: those due for certain are taken, probabilities of the rest are scaled, and
    every source still comes within half a document of its target."""
    rows = [(i, " ".join(["w"] * (300 if i < 3 else 3 + i % 9)), "abc"[i % 3]) for i in range(400)] + [(1000 + i, "w " * 90, f"s{i:03d}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    p = mixing.MixParams(least_slices=16, broadcast_rows=3)
    out = mixing.allocate(docs, p=p)
    against_sql(out.drop("source"), mixing.oracle_sql(p), documents=pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    per = out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m")).collect()
    assert all(abs(r["k"] - r["t"]) <= r["m"] / 2 + 1 for r in per)
    sized = mixing._sized(docs, "doc_id", "source", "text", None)
    ranked = mixing.with_rank(sized, mixing.plan(sized, p), p).where("inclusion > 0")
    expected = ranked.groupBy("source").agg(F.sum(F.least(F.col("scale") * F.col("weight"), F.lit(1.0)) * F.col("size")).alias("e"), F.first("rest").alias("r")).collect()
    assert expected and all(abs(r["e"] - r["r"]) < 1e-6 * max(1, r["r"]) for r in expected)
    assert ranked.where("scale * weight >= 1").count() > 0 and ranked.where("scale * weight >= 1 and q <> 0").count() == 0


def whole_store(store, want):
    """The newest version holds exactly the wanted rows, each run in the manifest as its files have it."""
    got, runs = store.read(), store.manifest()
    assert got.select("doc.*").exceptAll(want).count() == 0 == want.exceptAll(got.select("doc.*")).count()
    held = {tuple(r) for r in got.groupBy("key").agg(F.count(F.lit(1)), F.sum("bytes")).collect()}
    listed = runs.select("key", "n_rows", "bytes").collect()
    assert held == {tuple(r) for r in listed} and len(held) == len(listed)


def test_sharding_repeats(spark):
    """Arrivals between compactions, with batches numbered alike: no row is ever lost, and merged shards merge again."""
    docs = frame(spark, corpus(5)).cache()
    path = common.shared_path(spark, "store")
    p = sharding.ShardParams(target_bytes=3000, fanout=2, least_runs=2)
    store = lambda: sharding.ShardStore(spark, path, p)  # noqa: E731  (opened anew each time)
    batch, want, runs = F.floor(F.col("doc_id") / 4), docs.limit(0), []
    for step in ("append", "append", "compact", "append", "compact", "compact", "vacuum", "compact", "append", "vacuum", "compact"):
        if step == "append":
            store().append(docs, batch)
            want = want.unionAll(docs)
        else:
            getattr(store(), step)()
        whole_store(store(), want)
        runs.append({(r["key"], r["n_rows"], r["commit"], r["home"]) for r in store().manifest().collect()})
    assert 2 * len(runs[0]) == len(runs[1]) and len(runs[2]) < len(runs[1]) and len(runs[5]) <= len(runs[4]) < len(runs[3])
    assert runs[2] - runs[4] and runs[2] & runs[4]  # some shards merged again with later ones, others stayed where they were
    while (v := store().version()) != store().compact():
        whole_store(store(), want)
    assert store().version() == v  # nothing to move: no version
    with pytest.raises(ValueError):
        store().append(docs.drop("source"), batch)
    bare = sharding.ShardStore(spark, common.shared_path(spark, "store"), p)
    bare.append(empty(docs), batch)
    bare.compact()
    bare.vacuum()
    assert bare.read().select("doc.*").columns == docs.columns and bare.read().count() == 0
    docs.unpersist()


def test_sharding_random_arrivals(spark):
    """Arrivals and compactions in random order keep every row, and all but single long documents keep to the target."""
    rng = random.Random(11)
    store = sharding.ShardStore(spark, common.shared_path(spark, "store"), sharding.ShardParams(target_bytes=2000, fanout=3, least_runs=3))
    want = None
    for step in range(8):
        if step == 0 or rng.random() < 0.6:
            rows = [(rng.randrange(40) if rng.random() < 0.9 else None, "y" * rng.randrange(300), "s") for _ in range(rng.randrange(1, 30))]
            docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
            store.append(docs, F.floor(F.col("doc_id") / 5))
            want = docs if want is None else want.unionAll(docs)
        else:
            store.compact()
        if rng.random() < 0.3:
            store.vacuum()
        whole_store(store, want)
    store.compact()
    assert store.manifest().where("compacted and bytes > 4000 + 300").count() == 0


def test_sharding_splits_one_hot_run(spark):
    """A third of all rows under one batch, or without an id, is dealt over shards of about the target size."""
    rows = [(i, "x" * 50, "s") for i in range(200)] + [(None, "x" * 50, "s")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    p = sharding.ShardParams(target_bytes=1000, batch_rows=4)
    store = sharding.stored(docs, p=p)
    whole_store(store, docs)
    sizes = [r["bytes"] for r in store.manifest().collect()]
    assert max(sizes) < 2500 and len(sizes) >= 20
    by_rows = sharding.stored(docs.withColumn("text", F.lit(None).cast("string")), p=sharding.ShardParams(most_rows=20, batch_rows=4))
    assert by_rows.manifest().agg(F.max("n_rows"), F.sum("n_rows")).first()[:] == (by_rows.manifest().agg(F.max("n_rows")).first()[0], 500)
    assert by_rows.manifest().agg(F.max("n_rows")).first()[0] < 60


def test_sharding_two_writers(spark):
    """Of two commits of one version one fails, and what the other wrote is whole."""
    docs = frame(spark, corpus(5))
    store = sharding.ShardStore(spark, common.shared_path(spark, "store"))
    store.append(docs, F.floor(F.col("doc_id") / 4))
    manifest = store.manifest().drop("version")
    outcome = []

    def commit():
        try:
            store.commit(manifest, 2)
            outcome.append("done")
        except RuntimeError:
            outcome.append("refused")

    writers = [threading.Thread(target=commit) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert outcome.count("done") >= 1 and store.version() == 2
    with pytest.raises(RuntimeError):
        store.commit(manifest, 2)
    whole_store(store, docs)


def test_url_filters(spark):
    rows = [(1, "http://a.example.org/x/casino?q=1", "2024-03-01"), (2, None, "2024-03-01"), (3, "", None), (4, "https://u:p@B.Example.org:80/y#f", "2024-07-01"), (5, "https://b.example.org/y", "2024-12-01"), (5, "https://b.example.org/y", "2024-12-01"), (6, "nonsense", "2024-01-01"), (7, "http://tionsh.example.net/fr/1", "2024-08-01"), (8, "http://tionsh.example.net/frx/1", "2024-08-01")]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumns({"fetched": F.to_timestamp("fetched"), "host": F.lit("mine")})
    out = [(r["page_id"], r["host"], r["decided_by"], r["blocked"]) for r in url_filters.judge(caps, url_filters.sample_list(spark)).orderBy("page_id").collect()]
    assert out == [(1, "a.example.org", 2, True), (2, "", None, False), (3, "", None, False), (4, "b.example.org", None, False), (5, "b.example.org", 4, True), (5, "b.example.org", 4, True), (6, "", None, False), (7, "tionsh.example.net", 7, False), (8, "tionsh.example.net", 6, True)]
    assert url_filters.judge(empty(caps), url_filters.sample_list(spark)).count() == 0
    assert url_filters.judge(caps, url_filters.sample_list(spark).limit(0)).where("blocked").count() == 0


def test_licenses(spark):
    assert licenses.evaluate(licenses.postfix(iter("MIT OR ( GPL-2.0-only WITH Classpath-exception-2.0 )".split()))) == (1.0, ["mit", "gpl-2"])
    assert licenses.evaluate(licenses.postfix(iter("MIT AND CC-BY-NC-4.0 trailing words".split())))[0] == 0.2
    assert licenses.postfix(iter("OR MIT".split())) == [] and licenses.postfix(iter("( MIT".split())) == []
    deep = ["("] * 5000 + ["MIT"] + [")"] * 5000
    assert licenses.evaluate(licenses.postfix(iter(deep)))[0] == 1.0
    rows = [(1, "Released UNDER the\nMIT-License. apache license, version 2"), (2, None), (3, ""), (4, "// SPDX-License-Identifier: Apache-2.0 OR MIT\nunder the mit licenses"), (4, "cc by nc"), (None, "all rights reserved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("x"))
    got = [tuple(r) for r in licenses.scan(docs).orderBy(F.col("doc_id").asc_nulls_last(), "n_words").collect()]
    assert got[0] == (1, 9, 2, 1, 5, "apache-2,mit", "apache-2,mit", 1.0) and got[1] == (2, 0, 0, None, None, "", "", 0.5)
    assert got[4][5:7] == ("", "apache-2,mit") and got[3][5] == "cc-by-nc" and got[5][5:] == ("", "all-rights-reserved", 0.0)
    assert licenses.scan(empty(docs)).count() == 0


def test_url_filters_long_list(spark):
    """A list beyond the broadcast bound, with keys that nearly all captures have: the same verdicts as by broadcast."""
    rows = [(i, f"https://{'www' if i % 3 else 'shop'}.site{i % 40}.example.com/{'a' if i % 5 else 'b'}/p{i}", f"2024-0{i % 9 + 1}-01") for i in range(300)]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.to_timestamp("fetched"))
    pages = caps.select("page_id", "url")
    entries = url_filters.page_list(pages).unionByName(spark.createDataFrame([(1, "token", "https", "block", "2024-03-01", False), (2, "domain", "example.com", "allow", "2024-02-01", False)], "entry_id long, kind string, pattern string, verdict string, dated string, removed boolean").withColumn("dated", F.to_date("dated")))
    rows = lambda p: sorted(map(tuple, url_filters.judge(caps, entries, p=p).collect()))
    short = rows(url_filters.UrlParams())
    assert rows(url_filters.UrlParams(broadcast_rows=5, hot_share=20)) == short and {r[-1] for r in short} == {True, False}
    pdf = pages.toPandas()
    against_sql(url_filters.judge(url_filters.page_captures(pages), url_filters.page_list(pages), p=url_filters.UrlParams(broadcast_rows=5, hot_share=20)), url_filters.oracle_sql(), pages=pdf)


def brute_licenses(t):
    """Places and labels by looking at every word for every phrase."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    places, base, labels = [], set(), set()
    for phrase, label in (licenses.BASE_PHRASES | licenses.MORE_PHRASES).items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                labels.add(label)
                if phrase in licenses.BASE_PHRASES:
                    places.append(i)
                    base.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def test_licenses_brute_force(spark):
    rng = random.Random(10)
    pieces = ["under the", "mit", "license", "MIT License", "apache license,", "version 2", "version", "cc", "by", "nc", "cc-by-nc", "all rights", "reserved", "public\ndomain", "é", "x", "gnu general public license version 3"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(60)))) for i in range(300)]
    got = {r["doc_id"]: tuple(r)[1:7] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_licenses(t) for i, t in rows} and sum(g[1] for g in got.values()) > 100


def test_licenses_expressions():
    score = lambda x: licenses.evaluate(licenses.postfix(iter(x.replace("(", " ( ").replace(")", " ) ").split())))
    assert score("GPL-2.0-only WITH Classpath-exception-2.0")[0] == 0.7 and score("GPL-2.0-only WITH no-such-exception")[0] == 0.4
    assert score("Foo-1.0 OR MIT") == (1.0, ["unknown", "mit"]) and score("(AGPL-3.0-or-later OR Zlib) AND MPL-2.0")[0] == 0.7
    scanners = licenses.automaton(), licenses.tag_automaton()
    scan = lambda t: licenses.scan_text(t.encode(), *scanners)[5:]
    assert scan('{"license": "BSD-3-Clause"}') == ("bsd-3", 1.0) and scan('license = "MIT OR Apache-2.0"') == ("apache-2,mit", 1.0)
    assert scan("SPDX-License-Identifier: Foo-1.0") == ("unknown", 0.5) and scan("The licence: see below") == ("", 0.5)


def test_licenses_many_hits():
    """Ten megabytes with a million hits take time in proportion to the text, and the places are right to the end."""
    piece = "cc by nc " * 50 + "é " * 7
    n = 10_000_000 // len(piece)
    out = licenses.scan_text((piece * n).encode(), licenses.automaton(), licenses.tag_automaton())
    assert out == (157 * n, 50 * n, 0, 157 * (n - 1) + 147, "cc-by-nc", "cc-by-nc", 0.2)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_pii(spark):
    rng = random.Random(6)
    for alphabet in ("ab@.-+19 0(@..%é", "1234567890 -.+4"):
        for _ in range(5000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
            base, every = pii.find(t)
            assert base == base_spans(t) and set(base) <= set(every)
    shown = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in pii.find(t)[1]]
    assert shown("write john.doe (at) mail [dot] example (dot) com now") == [("email", "john.doe (at) mail [dot] example (dot) com")]
    assert shown("jоhn@exаmple.com, 192.168.1.１") == [("email", "jоhn@exаmple.com"), ("ip", "192.168.1.１")]
    assert shown("+four nine five five five one two three four") == [("phone", "+four nine five five five one two three four")]
    assert shown("look at the dot and point at it") == []
    assert pii.masked("mail a@b.co now") == "mail [email] now"
    docs = spark.createDataFrame([(1, "a@b.co"), (1, None), (None, "")], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = sorted((r["n_email"], r["spans"]) for r in pii.scan(docs).collect())
    assert got == [(0, ""), (0, ""), (1, "email:0:6")]
    assert pii.scan(empty(docs)).count() == 0


def test_pii_disguises():
    shown = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in pii.find(t)[1]]
    for t in (
        "hans at beispiel punkt de", "x arobase exemple point fr", "juan arroba ejemplo punto es", "john at example.com", "john@example dot com", "john (at) example dot com", "john [at] mail.example dot co dot uk",
        "john dot doe at example dot com", "j.doe2 at example dot museum", "JOHN AT EXAMPLE DOT COM", "john (at) example dot travel", "john@mail dot example.com",
    ):
        assert shown(t) == [("email", t)] and shown(f"Write to {t}, or call.") == [("email", t)], t
    for t in ("one nine two dot one six eight dot one dot one", "192 dot 168 dot 1 dot 1", "one nine two [dot] one six eight [dot] one [dot] one", "eins null punkt null punkt null punkt eins"):
        assert shown(t) == [("ip", t)] and shown(f"host {t} is up") == [("ip", t)], t
    for t in ("plus four nine five five five one two three four", "plus 49 30 1234567"):
        assert shown(f"call {t} now") == [("phone", t)], t
    for t in (
        "look at the dot and point at it", "arrived at boiling point in two minutes", "stared at red dot patterns", "available at example.com", "smiled at him.She left", "see the shop at www.example.com", "two dot one dot five",
        "nine two dot one six eight dot one dot nine nine nine", "plus 100 000 000 euros", "plus 3.14159265358", "at this point in time", "meet at noon dot nothing else", "look at example dot com",
    ):
        assert shown(t) == [], t
    assert shown("a@b.co point at it") == [("email", "a@b.co")]
    for t in ("x at " + "at dot " * 20000, "dot " * 50000, "one dot " * 20000, "plus 1 " * 20000):
        pii.find(t)


def test_pii_beyond_base_spans():
    """A disguised letter splits an identifier: the whole stands beside the base's part of it, and masking leaves nothing."""
    shown = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in pii.find(t)[1]]
    assert shown("jоhn@example.com") == [("email", "jоhn@example.com"), ("email", "hn@example.com")]
    assert pii.masked("to jоhn@example.com now") == "to [email] now"
    assert shown("a@b.co dot uk") == [("email", "a@b.co"), ("email", "a@b.co dot uk")] and pii.masked("a@b.co dot uk!") == "[email]!"
    assert pii.masked("1.2.3.4 and 4111 1111 1111 1111") == "[ip] and [card]"
    assert shown("0" * 5000 + ".1.1.1") == [("ip", "0" * 5000 + ".1.1.1")] and shown("1" + "0" * 5000 + ".1.1.1") == []


def test_pii_very_long():
    """Ten million characters: base spans and disguises are found to the end, in time proportional to the text."""
    piece = "words of prose 192.168.0.1 then jane (at) example dot com and four zero zero three plain words. "
    text = piece * (10_000_000 // len(piece))
    base, every = pii.find(text)
    assert base == base_spans(text) and len(every) == 2 * text.count("192.168.0.1")
    spans = every[-2:]
    assert [text[a:b] for a, _, b in spans] == ["192.168.0.1", "jane (at) example dot com"]


def test_html(spark):
    page = """<html><body><header>Site</header><nav><a href=/>Home</a></nav><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>One <b>bold</b>
    text.<br>next<p>Two<div id="comments"><p>nice</p></div><form>f</form><ul><li>x<li>y</ul></article><footer>&copy;</footer>"""
    assert html_extract.main_text(page) == "Title & more\nOne bold text. next\nTwo\nx\ny"
    plain = "<div><div class=menu><a>a</a><a>b</a></div><div class=story><p>Long text of the story.</p><p>And some more of it.</p></div></div>"
    assert html_extract.main_text(plain) == "Long text of the story.\nAnd some more of it."
    assert [html_extract.main_text(x) for x in (None, "", "<!-- open", "just text", "<p>one")] == ["", "", "", "just text", "one"]
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 3 and html_extract.extract(empty(pages)).count() == 0


def test_html_keeps_dense_siblings():
    """Pages without article or main: dense subtrees and headings beside the densest node stay, thin link lists do not."""
    para = lambda i: f"<p>{i} {'some words of prose ' * 5}</p>"
    said = lambda i: f"{i} {'some words of prose ' * 5}".strip()
    section = lambda a, b: f"<section>{''.join(map(para, range(a, b)))}</section>"
    links = "<div><ul>" + "<li><a href=x>Elsewhere on this site</a>" * 8 + "</ul></div>"
    want = [said(i) for i in range(16)]
    assert html_extract.main_text(f"<div>{section(0, 10)}{section(10, 16)}</div>").split("\n") == want
    assert html_extract.main_text(f"<div>{section(0, 6)}{links}{section(6, 16)}</div>{links}").split("\n") == want
    assert html_extract.main_text(f"<div><div>{links}{section(0, 3)}</div>{section(3, 15)}</div>{para(15)}").split("\n") == want
    assert html_extract.main_text(f"{links}<div><h1>A title</h1><span>3 May</span><div>{section(0, 16)}</div><h3>More</h3>{links}</div>").split("\n") == ["A title", *want]
    assert html_extract.main_text(f"<div>{said(0)}<br>{said(1)}{section(2, 16)}</div>").split("\n") == [f"{said(0)} {said(1)}", *want[2:]]


def test_html_names_do_not_decide():
    """Words of class, id and role never remove a page's text; what is thin and named so is still left out."""
    said = [f"{i} {'some words of prose ' * 5}".strip() for i in range(8)]
    paras = lambda a, b: "".join(f"<p>{x}</p>" for x in said[a:b])
    thin = "<div class=comments><p>nice one</p></div><div class='share-links'><a href=x>Tell others</a><a href=y>Print</a></div>"
    for name in ("class='layout with-sidebar'", "id=page-nav-fixed", "class=sidebar", "role=banner", "class=comments"):
        for whole in (f"<article>{paras(0, 8)}</article>", f"<main>{paras(0, 8)}{thin}</main>", paras(0, 8)):
            assert html_extract.main_text(f"<body><div {name}>{whole}</div>{thin}").split("\n") == said, (name, whole)
    for name in ("read-more", "story-share", "notice-text"):
        assert html_extract.main_text(f"<article>{paras(0, 5)}<div class={name}>{paras(5, 8)}</div>{thin}</article>").split("\n") == said
        assert html_extract.main_text(f"<div><div>{paras(0, 5)}</div><div class={name}>{paras(5, 8)}</div>{thin}</div>").split("\n") == said


def test_html_attributes_and_lists():
    """Words inside attribute values, compound class names and short link lists lose no text; whole names of adverts do."""
    said = [f"{i} {'some words of prose ' * 5}".strip() for i in range(6)]
    paras = "".join(f"<p title='the hidden truth' data-x=\"class=ad\">{x}</p>" for x in said)
    assert html_extract.main_text(f"<body><article>{paras}</article>").split("\n") == said
    assert html_extract.main_text(f"<body><div id='content-side-by-side'>{paras}</div>").split("\n") == said
    assert html_extract.main_text(f"<article>{paras}<div class='more'><p>{said[0]}</p></div></article>").split("\n") == [*said, said[0]]
    assert html_extract.main_text(f"<article>{paras}<p class='ad'>Buy now</p></article>").split("\n") == said
    two = "<ul><li><a href=x>First source</a></li><li><a href=y>Second source</a></li></ul>"
    assert html_extract.main_text(f"<article>{paras}{two}</article>").split("\n") == [*said, "First source", "Second source"]
    assert html_extract.attributes_of("a class='x y' hidden class=z id=\"q r\"") == {"a": "", "class": "x y", "hidden": "", "id": "q r"}


def test_html_brute_force():
    """Densities, sums and the chosen block of random trees, by plain recursion over what the page was made of."""
    rng = random.Random(13)

    def grow(depth):
        name = rng.choice(["div", "div", "section", "p", "ul", "b", "a", "span", "article"])
        if name == "p" or not depth:
            return name, ["".join(rng.choice("abc ") for _ in range(rng.randrange(80)))]
        return name, [grow(depth - 1) if rng.random() < 0.8 else "some text" for _ in range(rng.randrange(4))]

    def page(t):
        return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(page, t[1]))}</{t[0]}>"

    def chars(t, linked=False):
        if isinstance(t, str):
            return 0 if linked else len("".join(t.split()))
        return chars((0, t[1])) if linked and t[0] == "a" else sum(chars(k, linked) for k in t[1])

    def tags(t, linked=False, inside=False):
        own = sum(not isinstance(k, str) and (k[0] == "a" if linked else k[0] not in ("b", "span")) for k in t[1]) if not inside else 0
        if linked and t[0] == "a":
            return tags(t)
        return own + sum(tags(k, linked) for k in t[1] if not isinstance(k, str))

    def has_main(t):
        return not isinstance(t, str) and (t[0] == "article" or any(map(has_main, t[1])))

    for _ in range(300):
        tree = ("body", [grow(4) for _ in range(3)])
        nodes = html_extract.in_order(html_extract.parse(page(tree)))
        html_extract.measure(nodes)
        flat, stack = [], [tree]
        while stack:
            t = stack.pop()
            flat.append(t)
            stack.extend(reversed([k for k in t[1] if not isinstance(k, str)]))
        if [x.name for x in nodes] != [t[0] for t in flat]:
            continue  # blocks inside p or li: the page's tree is another
        share = chars(tree, True) / max(1, chars(tree))
        density = {}
        for x, t in zip(nodes, flat, strict=True):
            c, lc, g, lg = chars(t), chars(t, True), tags(t), tags(t, True)
            ratio = max(c, 1) / max(1, lc) * max(1, g) / max(1, lg)
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[x] = c / max(1, g) * math.log(ratio) / math.log(max(base, math.e)) if ratio > 1 else 0.0
            assert (x.chars, x.link_chars, x.tags, x.mains) == (c, lc, g, has_main(t)) and abs(x.density - density[x]) < 1e-9
        total = lambda x: sum(density[k] if k.tag else total(k) for k in x.kids)  # noqa: E731, B023
        best = max(total(x) for x in nodes if x.name in html_extract.BLOCK or x is nodes[0])
        tops, _, _ = html_extract.choose(nodes)
        inside = {x for top in tops for x in html_extract.in_order(top)}
        assert best == 0 or any(abs(total(x) - best) < 1e-9 for x in inside)


def test_toxicity(spark):
    assert toxicity.folded("1d10t stup!d! tr@sh 100 mоron") == ["idiot", "stupid", "trash", "100", "moron"]
    rng = random.Random(7)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [(-1, None), (-2, ""), (None, "idiot moron")], []
    for i in range(600):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron", "scum", "1diot"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, lab).collect()}
    held = [i for i in range(600) if out[i]["held_out"]]
    assert len(out) == len(rows) and sum(out[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert out[-1]["predicted"] == 0 and 0 <= out[-1]["score"] <= 1 and not out[None]["held_out"]
    assert toxicity.score(empty(docs), lab).count() == 0
    bare = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, lab.limit(0)).collect()}
    assert sum(bare[i] for i in range(600) if i % 4) == 0 and bare[-1] == 0  # no labels: the given words only


@pytest.mark.parametrize(("sf", "rows"), [("sf0.01", "quality = 1"), ("sf0.1", "true")])
def test_toxicity_held_out(spark, sf, rows):
    """Recall and precision on labelled rows that were not learned from. (Of the 18 toxic ones of sf0.01 three are also
    junk, with texts that hold no words any more.)"""
    if not os.path.exists(f"/root/testdata/{sf}/labels.parquet"):
        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.score(docs, labels).where("held_out").join(labels.where(rows), "doc_id").select("toxic", "predicted").collect()
    caught = sum(r["toxic"] and r["predicted"] for r in held)
    assert caught >= 0.9 * sum(r["toxic"] for r in held) and caught >= 0.95 * sum(r["predicted"] for r in held)


def test_very_long_texts(spark):
    """A text of three megabytes, larger than a worker's slice, goes whole through every operator that reads texts."""
    rng = random.Random(14)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    item = " ".join(f"bench{i}" for i in range(12))
    text = " ".join([*words, item, "idiot", "under the mit license", "jane@example.com"])
    n = len(text.split())
    docs = spark.createDataFrame([(1, text, "a"), (2, text, "a"), (3, "short one", "b")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    q = by_id(quality.score(docs))[1]
    seen = Counter(zip(text.split(), text.split()[1:], text.split()[2:]))
    covered = {p for i, g in enumerate(zip(text.split(), text.split()[1:], text.split()[2:])) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    assert (q["n_words"], q["n_repeat_words"]) == (n, len(covered))
    j = by_id(jaccard.classes(docs, p=jaccard.JaccardParams(3, 90, light=3, spread=1.3)))
    assert j[2]["component_id"] == 1 and j[1]["n_shingles"] == len(seen) and j[3]["component_id"] == 3
    d = by_id(decontaminate.inspect(docs, bench))[2]
    assert (d["n_hit"], d["n_items"], d["contaminated"]) == (12, 1, True)
    lic = by_id(licenses.scan(docs))[1]
    assert (lic["n_base"], lic["base_labels"]) == (1, "mit") and lic["first_word"] == lic["last_word"] > 400_000
    assert by_id(pii.scan(docs))[1]["n_email"] == 1 and by_id(mixing.allocate(docs))[1]["size"] == n
    page = spark.createDataFrame([(1, "u", f"<article><p>{text}</p></article>")], "page_id long, url string, html string")
    assert html_extract.extract(page).first()["n_chars"] == len(text)
    assert {r["shard_rows"] for r in sharding.assignments(docs).collect()} <= {1, 2, 3}
    assert toxicity.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 3


def test_ids_as_texts(spark):
    """Whole numbers as texts are ids as well; other texts are an error, not a null."""
    docs = spark.createDataFrame([("12", "a b c d e f"), ("7", "a b c d e f")], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.classes(docs).collect()} == {(7, 7), (12, 7)}
    bad = docs.union(spark.createDataFrame([("x1", "a")], docs.schema))
    for operator in (jaccard.classes, licenses.scan, pii.scan, sharding.assignments):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            operator(bad).collect()


def test_pipeline(spark, tmp_path):
    """Each stage against brute force, or the SQL of its operator, on its own input."""
    import corpus_pipeline as cp

    rng = random.Random(9)
    words = [f"word{i}" for i in range(300)] + quality.STOP_WORDS
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "", "", "", "."]) for _ in range(120))
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 0) for i in range(10)] + [(200, "JUNK!! " * 80, "en", "s1", 0), (201, None, None, None, None)]
    item = " ".join(f"bench{i}" for i in range(14))
    rows.append((300, text() + " " + item, "en", "s2", 0))
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    one = cp.quality_rules(spark, docs, str(tmp_path))
    assert 200 not in ids(one) and 201 not in ids(one) and set(range(60)) <= set(ids(one))
    two = cp.near_duplicates(spark, one, str(tmp_path))
    assert ids(two) == [*range(60), 300]
    three = cp.decontamination(spark, two, str(tmp_path))
    assert ids(three) == list(range(60)) and three.columns == docs.columns
    rows_of = lambda df: df.toPandas()
    ask = lambda sql, **t: (con := duckdb.connect(), [con.register(k, v) for k, v in t.items()], con.execute(sql).df())[2]
    d0, d1, d2, d3 = map(rows_of, (docs, one, two, three))
    good = ask(quality.oracle_sql(), documents=d0)
    assert sorted(d1["doc_id"]) == sorted(good[good["kept"]]["doc_id"])
    roots = brute_classes([(int(i), t, None) for i, t in zip(d1["doc_id"], d1["text"])], jaccard.JaccardParams(shingle=5, percent=80))
    assert sorted(d2["doc_id"]) == sorted(set(roots.values()))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    known = {tuple(w[i : i + 10]) for w in [words(item)] for i in range(len(w) - 9)}
    hit = lambda t: any(tuple(words(t)[i : i + 10]) in known for i in range(len(words(t)) - 9))
    assert sorted(d3["doc_id"]) == sorted(i for i, t in zip(d2["doc_id"], d2["text"]) if not hit(t))
    four = cp.source_mix(spark, three, str(tmp_path))
    took = ask(mixing.oracle_sql(), documents=d3)
    assert Counter(ids(four)) == Counter({i: int(k // n) for i, k, n in zip(took["doc_id"], took["taken"], took["size"]) if k})
    against_sql(cp.sharded(spark, four, str(tmp_path)), sharding.oracle_sql(), documents=rows_of(four))
    last = cp.run(spark, str(tmp_path))
    assert ids(last) == ids(four) and last.agg(F.sum("bytes")).first()[0] == four.agg(F.sum(F.octet_length("text"))).first()[0]
