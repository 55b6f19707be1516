"""The pipeline's stages on small tables, and the queries that SQL can express."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from zonalspark.llm import quality
from zonalspark.llm.bpe import PATTERN, tiktoken_ranks
from zonalspark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    theirs = c.execute(ORACLE_SQL[name]).df()[names]
    assert sorted(map(tuple, df.select(names).toPandas().astype(str).values)) == sorted(map(tuple, theirs.astype(str).values))


def test_stages_keep_columns_and_clean_documents(spark):
    rows = [(k, f"Plain words of document {k} that stands alone with number {k * 7919} and nothing else to say.", "en", "s", 1) for k in range(30)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, None, "en", "s", 1), (102, "", None, None, None), (103, rows[4][1] + " More.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["ngram_join"](spark, docs, DATA)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    # 103 shares 12 of 13 grams with 4
    assert {r.doc_id for r in kept.collect()} == set(range(30)) | {101, 102}
    left = stages["suffix_dedup"](spark, docs, DATA)
    assert left.columns == list(corpus_pipeline.COLUMNS) and left.count() == len(rows)
    clean = stages["decontamination"](spark, docs, DATA)
    assert clean.count() == len(rows) and clean.columns == list(corpus_pipeline.COLUMNS)
    assert stages["quality_classifier"](spark, docs.where("false"), DATA).columns == list(corpus_pipeline.COLUMNS)
    assert stages["byte_bpe"](spark, docs, DATA).count() == len(rows)


def test_null_and_repeated_ids_lose_nothing_but_copies(spark):
    own = [f"Words of text {k} stand alone with number {k * 7919} and so {k * 31} has nothing else {k * 17} to say." for k in range(9)]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (7, own[2]), (7, own[3]), (7, own[3]), (3, own[4]), (5, own[4]), (None, own[4]), (8, None), (8, None), (8, ""), (None, own[5]), (2, own[6]), (2, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, DATA)
    key = lambda r: (str(r[0]), str(r[1]))
    # of one text the least id stays, nulls last; rows without words only once each
    want = {}
    for k, t in rows:
        same = (k, t) if not t else t
        want[same] = min([want.get(same, (k, t)), (k, t)], key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want.values(), key=key)


def test_contaminated_rows_go_by_row(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    clean = "Nothing of this is in any item at all, it only speaks of plain weather over quiet hills."
    rows = [(1, item), (1, clean), (None, item), (None, clean), (2, clean + " More.")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, DATA).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted((str(k), t) for k, t in rows if t != item)


def plain_run(docs, labels, benchmark):
    """The five stages written out over lists of (doc_id, text); the classifier is fitted by the operator on the labelled rows."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    known = {}
    for k, q in labels:
        if k is not None and q is not None:
            known.setdefault(k, []).append(q)
    sample = sorted({k: t or "" for k, t in docs if k in known and zlib.crc32(str(k).encode()) % 3 != 1}.items())
    assert len(sample) <= quality.SAMPLE
    features = quality.Features()
    scorer = quality.Scorer(*quality.train([t for _, t in sample], [int(sum(known[k]) / len(known[k]) >= 0.5) for k, _ in sample], features), features)
    docs = [(k, t) for k, t in docs if scorer.score(t or "") >= 0.5]
    # near copies
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for _ in docs:
        before = list(group)
        for a in range(len(docs)):
            for b in range(a):
                if sets[a] and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    kept, seen = [], set()
    for i in order:
        mark = group[i] if sets[i] else docs[i]
        if mark not in seen:
            seen.add(mark)
            kept.append(docs[i])
    docs = kept
    # repeated strings
    count = Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[i : i + 200] for i in range(len(b) - 199))
    left = []
    for k, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        left.append((k, bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")))
    # benchmark
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[i : i + min(13, len(w))]) for w in map(split, benchmark) if w for i in range(len(w) - min(13, len(w)) + 1)}
    clean = []
    for k, t in left:
        w = split(t)
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        if not (sum(hit) and 20 * sum(hit) >= len(w)):
            clean.append((k, t))
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tiktoken_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = []
    for k, t in clean:
        ids = lib.encode_ordinary(t)
        out.append((str(k), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def same_as_plain(spark, folder, rows, labels, benchmark):
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "more") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_no string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(folder)).collect()
    want = plain_run(rows, labels, benchmark)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    return want


def test_run_equals_plain_stages(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality").collect()]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    words = rows[0][1].split()
    shared = " ".join(words[:60])
    odd = [(None, None), (None, None), (900, ""), (901, " \t "), (None, rows[3][1]), (902, rows[3][1] + " More."), (903, shared + " ends here"), (None, shared + " or there"), (3, "another text under a repeated id"), (904, "é" * 150 + " tail"), (905, "x" + "é" * 150), (906, items[0]), (None, items[1])]
    want = same_as_plain(spark, tmp_path, rows + odd, [*labels, (None, 1), (3, None)], [*items, None, "", "two words"])
    assert 50 < len(want) < len(rows) + len(odd)


def test_run_of_empty_tables(spark, tmp_path):
    assert same_as_plain(spark, tmp_path, [], [], []) == []


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    assert 0 < len(out) <= 200 and len({r.doc_id for r in out}) == len(out)
