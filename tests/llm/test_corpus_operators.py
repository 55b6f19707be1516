"""Manifest, mixing and alignment against plain versions, with nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from zonalspark.llm import alignment, merkle, mixing
from zonalspark.llm.running import running

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards naïve straße 世界 brew\n potions 12,345 it's ▁ <s> <|endoftext|> <0x41>".split(" ")


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows_of(n):
    r = random.Random(7)
    out = [(i, text(r.randint(0, 60), i), r.choice(["en", None]), r.choice(["a", "a", "a", "a", "b", "c", "é", None]), r.randint(0, 9)) for i in range(n)]
    out += [(3, None, "en", "a", 1), (3, None, "en", "a", 1), (None, "no key", None, None, None), (None, "no key", "x", "b", 2), (n + 1, "alone", "en", "single", None), (n + 2, "", "en", "empty", 0), (n + 3, " \n\t", "en", "empty", 0), (n + 4, "x" * 9000 + " y" * 3000, "en", "c", 5)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return rows_of(60)


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns are called like those of results."""
    clash = [(*r, "x", "y", 1, 2) for r in rows]
    return spark.createDataFrame(clash, SCHEMA + ", grp string, proof string, n long, size long").repartition(5)


def test_running(spark):
    got = running(spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), "id", (F.col("id") % 7).alias("v")).repartition(6), "g", ["id"], "v").collect()
    for g in "012":
        before, own = 0, sorted((r for r in got if r.g == g), key=lambda r: r.id)
        for r in own:
            assert r.before == before
            before += r.v
        assert {r.total for r in own} == {before}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(doc_id, content, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, content)))


def plain_tree(nodes):
    """Root, and for each node its list of (before, after)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(proofs)):
            k = at[i] // 3 * 3
            run = nodes[k : k + 3]
            proofs[i].append(("".join(run[: at[i] - k]), "".join(run[at[i] - k + 1 :])))
            at[i] //= 3
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], proofs


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        doc_id, content, lang, source, n_chars = r
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and content is not None
        by[source].append((doc_id is not None, doc_id or 0, plain_leaf(*r), plain_leaf(doc_id, content.replace("\n", "") if hit else content, lang, source, n_chars)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s])]) for s in names}
    root, over = plain_tree([trees[s][0] for s in names])
    out = []
    for s, more in zip(names, over, strict=True):
        for (has, doc_id, leaf, changed), own in zip(sorted(by[s]), trees[s][1], strict=True):
            node = changed
            for before, after in own + more:
                node = sha(before + node + after)
            out.append((doc_id if has else None, leaf, trees[s][0], root, sha("".join(b + a for b, a in own + more)), node, node == root))
    return sorted(out, key=repr)


def merkle_rows(spark, frame, folder):
    frame.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out = merkle.op11_merkle(spark, str(folder))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_merkle(spark, docs, rows, tmp_path):
    got = merkle_rows(spark, docs, tmp_path)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_merkle_of_few_rows(spark, docs, rows, tmp_path):
    one = [(5, "a\nb", "en", None, 3)]
    assert merkle_rows(spark, spark.createDataFrame(one, SCHEMA), tmp_path) == plain_manifest(one)
    assert merkle_rows(spark, docs.where("false"), tmp_path) == []


def test_proofs_fold_to_the_root(spark, docs):
    made = merkle.manifest(docs)
    assert made.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).distinct().collect() == [(True,)]


def plain_mix(rows):
    import re

    sized = [(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in sized if x == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:  # share, cap, share what is over again
        left = total - sum(3 * size[s] for s in capped)
        level = left / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: min(weight[s] * level, 3.0 * size[s]) for s in names}
    line = []
    for s in names:
        own = sorted((hashlib.md5(("-" if k is None else str(k)).encode()).hexdigest(), i, n) for i, (k, x, n) in enumerate(sized) if x == s and n)
        for p in range(3):
            at = p * size[s]
            for mark, i, n in own:
                at += n
                line.append((at / target[s], s is None, s or "", mark, p, i, n))
    taken, used = Counter(), 0
    for *_, i, n in sorted(line, key=lambda x: (x[0], x[1], x[2].encode(), x[3], x[4])):
        used += n
        if used > round(sum(target.values())):
            break
        taken[i] += n
    return sized, target, size, taken


def test_mixing(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.op12_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.op12_mixing(spark, str(tmp_path)).collect()))
    sized, target, size, taken = plain_mix(rows)
    want = sorted(((k, n, size[s], round(target[s], 6), taken[i]) for i, (k, s, n) in enumerate(sized)), key=repr)
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in out), key=repr) == want
    assert all(r.taken <= 3 * r.size for r in out)
    assert max(len({c for c in taken.values()}), 2) >= 2


def test_mix_comes_near_its_targets(spark):
    r = random.Random(3)
    many = [(i, "w " * r.randint(1, 40), "en", "hot" if i % 2 else f"s{i % 9}", 1) for i in range(4000)]
    line = mixing.mixed(spark.createDataFrame(many, SCHEMA).repartition(7)).where("taken")
    for x in line.groupBy("grp", "target").agg(F.sum("size").alias("got")).collect():
        assert abs(x.got - x.target) <= 41 + 0.02 * x.target
    order = sorted(line.select("start", "size", "finish").collect())
    assert all(a.start + a["size"] == b.start and a.finish <= b.finish for a, b in zip(order, order[1:], strict=False))


def test_mix_of_nothing(spark, docs):
    assert mixing.mixed(docs.where("false")).count() == 0
    blank = mixing.mixed(docs.where("text is null or trim(text) = ''")).collect()
    assert blank and not any(x.taken for x in blank)


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: x for x, c in alignment.byte_letters().items()}
    special = {i: t.content.encode() for i, t in a.get_added_tokens_decoder().items()}
    of_a = lambda i: special.get(i) or bytes(letters[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    pairs, found = Counter(), []
    for r in rows:
        t = r[1] or ""
        ids = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)]
        raw = [[of_a(i) for i in ids[0]], [of_b(i) for i in ids[1]]]
        if not t or any(b"".join(x) != (" " + t).encode() for x in raw):
            found.append((r[0], None))
            continue
        ends = []
        for x in raw:
            at, own = 0, {}
            for k, piece in enumerate(x):
                at += len(piece)
                own[at] = k
            ends.append(own)
        shared, was, groups, links = sorted(ends[0].keys() & ends[1].keys()), (0, 0), [], []
        for e in shared:
            i, j = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ids[0][was[0] : i])) + "|" + ",".join(map(str, ids[1][was[1] : j])))
            links.append((ids[0][i - 1], ids[1][j - 1]))
            was = i, j
        pairs.update(links)
        found.append((r[0], len(ids[0]), len(ids[1]), groups, links))
    most = defaultdict(int)
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return sorted(((f[0], 0, 0, 0, 0, 0, 0, "") if f[1] is None else (*f[:3], len(f[3]), len(f[4]), sum(pairs[x] == most[x[1]] for x in f[4]), sum(pairs[x] for x in f[4]), sha(";".join(f[3]))) for f in found), key=repr)


ODD = ["  two  spaces ", "a\n b\t c", "tab\tinside it's fine", "no▁break", " x y　z", "é ﬁ ½ \u0000 z", "the the the the", "<unk> <s> </s> <|endoftext|> <0x0A>", "x" * 700 + " ok", " lead", "trail ", "\n\n", "💡 🇩🇪 नमस्ते"]


def test_alignment(spark, docs, rows, monkeypatch):
    more = [(500 + i, t, None, "odd", 1) for i, t in enumerate(ODD)]
    frame = docs.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True).repartition(3)
    got = alignment.aligned(frame, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == plain_alignment([*rows, *more])
    assert any(r[1] for r in got) and any(r[5] < r[4] for r in got)
    assert alignment.aligned(docs.where("false"), A, B).count() == 0


def test_alignment_in_many_chunks(rows):
    """Numbers of groups stay right where a task forgets words and closes chunks."""
    aligner = alignment.Aligner(A, B)
    assert aligner.cuttable
    whole, small = alignment.Chunks(aligner), alignment.Chunks(aligner)
    for k, r in enumerate(rows):
        if k % 5 == 0:
            small.forget() if k % 2 else small.begin()
        x, y = whole.add(r[1] or ""), small.add(r[1] or "")
        assert x[:4] == y[:4]
        name = dict(enumerate(whole.names)), dict(enumerate(small.names))
        if x[4]:
            import numpy as np

            a, b = (np.frombuffer(z[4], np.uint32).reshape(2, -1) for z in (x, y))
            assert {name[0][i]: n for i, n in a.T.tolist()} == {name[1][i]: n for i, n in b.T.tolist()}


def test_forgotten_words(monkeypatch, rows):
    monkeypatch.setattr(alignment, "MEMO", 3)
    aligner = alignment.Aligner(A, B)
    few = alignment.Chunks(aligner)
    got = [few.add(r[1] or "")[:4] for r in rows]
    monkeypatch.setattr(alignment, "MEMO", 10**6)
    many = alignment.Chunks(aligner)
    assert got == [many.add(r[1] or "")[:4] for r in rows]
