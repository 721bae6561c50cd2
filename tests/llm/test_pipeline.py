"""The pipeline against brute force, and the queries that have SQL against DuckDB."""

import hashlib
import itertools
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from dqaudit.llm import common, mixing, ngram_join, registry, sharding, toxicity

from .test_ops import brute_mix, grams, jaccard, words


def brute_run(docs, labels, bench):
    """Rows (doc_id, text) to how often they are emitted; the trained field is taken as it is, its decisions are not."""
    field = toxicity.fit(*labels)
    score, _ = toxicity.score_batch(pa.array([t for _, t, _ in docs], pa.string()), field)
    left = [d for d, s in zip(docs, score, strict=True) if s < (field.threshold if field else 0.5)]
    sets = {i: grams(t) for i, t, _ in left if i is not None and words(t)}
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= ngram_join.THRESHOLD - 1e-12 and find(a) != find(b):
            a, b = sorted((find(a), find(b)))
            lead[b] = a
    left = [d for d in left if d[0] not in lead or lead[d[0]] == d[0]]
    items = [(min(5, len(words(t))), t) for t in bench if words(t)]

    def holds(text):
        return any(len(words(text)) >= n and len(grams(t, n) & grams(text, n)) / len(grams(t, n)) >= 0.8 for n, t in items)

    left = [d for d in left if not holds(d[1])]
    counts = Counter(s or "" for *_, s in left)
    weights = mixing.exact_weights(mixing.tempered(counts))
    order = {s: sorted((d for d in left if (d[2] or "") == s), key=lambda d: (hashlib.md5(str("" if d[0] is None else d[0]).encode()).hexdigest(), d[0])) for s in counts}
    out = Counter()
    for _, s, b, _ in brute_mix(counts, weights, mixing.BLOCK):
        out.update((d[0], d[1]) for d in order[s][b * mixing.BLOCK : (b + 1) * mixing.BLOCK])
    return out


def labelled(spark, docs, labels):
    got = toxicity.sample(docs, labels).toArrow()
    return got["__text"], got["__toxic"].to_numpy()


def check(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    bench = [r["text"] for r in common.table(spark, sf_dir, "benchmark").collect()]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    out = corpus_pipeline.run(spark, sf_dir)
    added = ("slot", "shard", "map_version")
    assert [c for c in out.columns if c not in added] == [c for c in docs.columns if c not in added] and set(added) <= set(out.columns)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == brute_run(rows, labelled(spark, docs, labels), bench)
    at = {r["slot"]: r["shard"] for r in got}
    for r in got:
        h = hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()
        assert r["slot"] == int(h[:8], 16) % sharding.SLOTS and r["shard"] == at[r["slot"]] < sharding.SHARDS and r["map_version"] == 1
    return rows, got


def test_pipeline_equals_brute_force(spark, sf_dir):
    rows, got = check(spark, sf_dir)
    assert 0 < len({r["doc_id"] for r in got}) < len(rows)


def write(tmp_path, docs, labels, bench, extra=()):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in extra]])
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=False)) for r in docs], schema), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([dict(zip(("doc_id", "quality", "toxic"), r, strict=True)) for r in labels], pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), tmp_path / "labels.parquet")
    pq.write_table(pa.Table.from_pylist([{"item_id": k, "text": t} for k, t in enumerate(bench)], pa.schema([("item_id", pa.int64()), ("text", pa.string())])), tmp_path / "benchmark.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in any column, an empty and a very long text, copies with one id, null ids, and columns that stages name too."""
    extra = ("slot", "shard", "__row", "__gone", "__shard", "epoch", "place", "__source")
    rng = np.random.default_rng(1)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    docs = [(i, word(40), "en", "ab"[i % 2], 1) for i in range(30)] + [(30, None, "en", "a", 1), (31, "", None, "a", None), (None, word(30), "en", None, 1), (None, None, None, None, None), (32, word(200_000), "en", "b", 1), (33, "!?", "en", "b", 1)]
    docs += [docs[0], docs[31], (34, docs[5][1], "en", "a", 1)]
    check(spark, write(tmp_path, docs, [(0, 1, 0), (None, 0, 1), (1, None, None)], [" ".join(docs[7][1].split()[3:33]), "", None], extra))


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(tmp_path, [], [], [])).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark_decontamination", "mixing", "sharding"]
    assert len(registry.QUERIES) == 10 and corpus_pipeline.ORACLE_SQL is None


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple | np.ndarray) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(spark, name):
    sf_dir = "/root/testdata/sf0.01"  # the smallest that holds secrets
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    cur = con.execute(registry.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(plain(r[cols.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == want and want


def brute_toxic(field, text):
    """Score of a text by enumerating the field's two states token by token (forward-backward on probabilities, no batches)."""
    from dqaudit.llm.kernels import Tokens, buffers

    buf, offs = buffers(pa.array([text], pa.string()))
    e = field.emissions(Tokens(buf, offs)).astype(float)
    if not len(e):
        return 0.0, []
    a = np.exp(field.trans)
    f, norm = np.zeros((len(e), 2)), 0
    f[0] = np.array([1, np.exp(np.clip(field.start + e[0], -40, 40))])
    f[0] /= f[0].sum()
    for k in range(1, len(e)):
        f[k] = (f[k - 1] @ a) * [1, np.exp(e[k])]
        f[k] /= f[k].sum()
    b = np.ones((len(e), 2))
    for k in range(len(e) - 2, -1, -1):
        b[k] = a @ (b[k + 1] * [1, np.exp(e[k + 1])])
        b[k] /= b[k].sum()
    p = (f * b)[:, 1] / (f * b).sum(1)
    spans = [[k for k, _ in g] for hot, g in itertools.groupby(enumerate(p >= toxicity.THRESHOLD), lambda x: x[1]) if hot]
    return 1 - np.prod([1 - p[s].mean() for s in spans]) if spans else 0.0, spans


def test_op1_equals_brute_force(spark):
    """Every document of the registered query against a plain forward-backward; the fitted field is taken as it is."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    field = toxicity.fit(*labelled(spark, docs, labels))
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_toxicity"](spark, sf_dir).collect()}
    want = {r["doc_id"]: brute_toxic(field, r["text"]) for r in docs.collect()}
    assert got and got.keys() == {i for i, (s, _) in want.items() if s >= field.threshold}
    for i, r in got.items():
        assert abs(r["score"] - want[i][0]) < 1e-6 and len(r["spans"]) == len(want[i][1])


def test_toxicity_on_held_out_documents(spark):
    """Fitted on the labelled documents with an even id, held against those with an odd one."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    field = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rest = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "toxic").toArrow()
    toxic = rest["toxic"].to_numpy()
    score, _ = toxicity.score_batch(rest["text"].combine_chunks(), field)
    hit = score >= field.threshold
    print("held out:", hit[toxic == 1].sum(), "of", (toxic == 1).sum(), "toxic,", hit[toxic == 0].sum(), "of", (toxic == 0).sum(), "clean")
    assert hit[toxic == 1].mean() > 0.7 and hit[toxic == 0].mean() < 0.01


def brute_log_prob(m, voc, ids):
    """One text's score, each token by itself: attention over the inputs of the window that scores it, in double precision."""
    from dqaudit.llm import lm

    w = {k: v.astype(float) for k, v in m.items()}
    total, stride = 0.0, lm.WIDTH - lm.OVERLAP
    for t in range(len(ids)):
        lo = 0 if t < lm.WIDTH else ((t - lm.OVERLAP) // stride) * stride
        inputs = [lm.VOCAB - 1 if j == 0 else ids[j - 1] for j in range(lo, t + 1)]
        h = w["e"][voc.row[inputs]] + w["p"][: len(inputs)]
        q, k, v = np.split(h @ w["qkv"], 3, axis=1)
        a = q[-1] @ k.T * lm.SIZE**-0.5
        a = np.exp(a - a.max())
        z = h[-1] @ w["d"] + (a / a.sum() @ v) @ w["o"] @ w["u"] + w["b"]
        z -= z.max()
        total += z[voc.cls[ids[t]]] - np.log(np.exp(z).sum()) + voc.within[ids[t]]
    return total


def test_op6_equals_brute_force(spark, sf_dir, monkeypatch):
    """The registered query's scores against one token at a time, under the model that it trained; and better than the ids' frequencies."""
    from dqaudit.llm import lm
    from dqaudit.llm.tokens import TOKENIZERS, VOCABULARY, encoding

    kept, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda ids: kept.append(train(ids)) or kept[-1])
    rows = common.table(spark, sf_dir, "documents").collect()
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_lm_scoring"](spark, sf_dir).collect()}
    assert got.keys() == {r["doc_id"] for r in rows}
    (flat, voc), enc = kept[0], encoding(TOKENIZERS, VOCABULARY)
    m, unigram, every = lm.unpack(flat), 0.0, 0
    for r in rows[:60]:
        ids = enc.encode_ordinary(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert abs(got[r["doc_id"]]["log_prob"] - brute_log_prob(m, voc, ids[:3000])) < 1e-3 * max(len(ids), 1) or len(ids) > 3000
        unigram += float((voc.within[ids] + voc.prior[voc.cls[ids]]).sum())
        every += got[r["doc_id"]]["log_prob"]
    assert every > unigram


def test_clashing_columns_of_labels_and_benchmark(spark, tmp_path):
    """Names that the stages use themselves, in the side tables."""
    from pyspark.sql import functions as F

    from dqaudit.llm import decontaminate

    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    rows = [(i, word(40), "en", "a", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(1) for c in ("__id", "__text", "__toxic", "__x", "source", "lang", "id", "n_chars")}
    bench = spark.createDataFrame([(1, rows[3][1]), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(20)], "doc_id long, quality int, toxic int")
    plain = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench.withColumns(clash)).collect()} == plain and {r[0] for r in plain} == {3}
    assert toxicity.sample(docs, labels.withColumns(clash | {"text": F.lit("x")})).collect() == toxicity.sample(docs, labels).collect()


def test_a_sample_keeps_its_bound_on_bytes(spark):
    """One text of each id; documents in hash order up to the bound, none cut."""
    rows = [(i, "x" * (10 + i), "en", "a", 1) for i in range(40)] + [(0, "y" * 10, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    every = toxicity.sample(docs, labels).collect()
    assert len(every) == 40 and len(toxicity.sample(docs, labels, most=5).collect()) == 15
    some = toxicity.sample(docs, labels, most_bytes=200).collect()
    assert set(some) < set(every)
    for c in (0, 1):
        assert 100 < sum(len(r["__text"]) for r in some if r["__toxic"] == c) <= 200


_WORKER = """
import gc, re, sys
import numpy as np, pyarrow as pa
from dqaudit.llm import decontaminate, exchange, ngram_join, toxicity

def mb(key):
    return int(re.search(key + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

class Docs:  # stands in for the table of which the stage maps the batches
    columns, schema = ["doc_id", "text"], None
    def mapInArrow(self, run, schema):
        self.run = run
        return self

def batches(n=2):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i:05d}" for i in range(20_000)])
    for k in range(n):
        text = pa.array([" ".join(words[rng.integers(0, 20_000, 300)]) for _ in range(8_000)])
        yield pa.record_batch([pa.array(range(k * 8_000, k * 8_000 + 8_000)), text], names=["doc_id", "text"])

def stage(name):
    docs = Docs()
    if name == "near_duplicates":
        exchange.part_number = lambda flush: flush
        return lambda rows: ngram_join._send(rows, ngram_join.N, 16)
    if name == "toxicity":
        place = np.arange(1, 4096, dtype=np.int32)
        toxicity.clean_only(docs, toxicity.Field(place, np.full(len(place), -1, np.float32), np.array([[0.0, -3.0], [0.0, 0.0]]), -3.0))
    else:
        items = decontaminate.Items([1], pa.array(["w00001 w00002 w00003 w00004 w00005 w00006"]), 0.8)
        decontaminate.passes = lambda *_: [items]
        decontaminate.decontaminated(docs, None)
    return docs.run

run, rows = stage(sys.argv[1]), list(batches())
pa.default_memory_pool().release_unused()
gc.collect()
open("/proc/self/clear_refs", "w").write("5")  # VmHWM from here
before, n = mb("VmRSS"), 0
anon = mb("RssAnon")
for batch in run(iter(rows)):
    n += len(batch)
del batch
print("RESULT", n, mb("VmHWM") - before, mb("RssAnon") - anon)
"""


@pytest.mark.parametrize("stage, peak, rest", [("toxicity", 110, 60), ("near_duplicates", 190, 60), ("benchmark_decontamination", 110, 50)])
def test_a_workers_memory(stage, peak, rest):
    """MB that a stage's function takes beside its batches of 16 MB while it runs, and keeps when it is over (an executor has two of them and its
    JVM's heap in 3000 MB)."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    said = subprocess.run([sys.executable, "-c", _WORKER, stage], env=os.environ | {"PYTHONPATH": root, "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    n, most, kept = map(float, said.stdout.split("RESULT")[1].split())
    print(stage, n, most, kept)
    assert n and most < peak and kept < rest


def test_the_drivers_small_tables_start_no_worker(spark, sf_dir):
    """They are local relations with the types asked for, not RDDs that Python workers make."""
    df = common.small(spark, [(1, 2, 3, 4, 5), (1, 3, None, 1 << 40, 0)], sharding.MAP)
    assert [tuple(r) for r in df.collect()] == [(1, 2, 3, 4, 5), (1, 3, None, 1 << 40, 0)] and common.small(spark, [], sharding.MAP).count() == 0
    assert df.schema == spark.createDataFrame([(1, 2, 3, 4, 5)], sharding.MAP).schema
    docs = common.table(spark, sf_dir, "documents")
    _, size, _ = mixing.plan(docs.selectExpr("coalesce(source, '') AS __source"), None, None, mixing.BLOCK, mixing.TEMPER)
    for x in (df, size, sharding.slot_map(docs)):
        assert "ExistingRDD" not in x._jdf.queryExecution().executedPlan().toString()
