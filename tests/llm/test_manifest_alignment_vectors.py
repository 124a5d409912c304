"""op11 to op13 against plain versions, on the tables and on messy rows."""

import bisect
import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tapeworks.llm import queries, vector_dups
from tapeworks.llm.align import aligned_documents, lockstep
from tapeworks.llm.merkle import document_manifest, folded, manifest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


# ---- op13


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes, fanout=8):
    levels = [nodes]
    while len(levels[-1]) > 1:
        c = levels[-1]
        levels.append([sha("".join(c[i : i + fanout])) for i in range(0, len(c), fanout)])
    return levels


def proof(levels, pos, fanout=8):
    out = []
    for level in levels[:-1]:
        s = pos // fanout * fanout
        out.append((level[s:pos], level[pos + 1 : s + fanout]))
        pos //= fanout
    return out


def plain_manifest(rows):
    def leaf(r):
        return sha("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))

    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r["lang"] is not None, (r["lang"] or "").encode())].append(r)
    keys = sorted(groups)
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[k] = tree([leaf(r) for r in groups[k]])
    top, out = tree([trees[k][-1][0] for k in keys]), []
    for g, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            steps, t = proof(trees[k], i) + proof(top, g), dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                t["text"] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
            x = leaf(t)
            for a, b in steps:
                x = sha("".join(a) + x + "".join(b))
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in steps)), x, x == top[-1][0]))
    return out


def test_manifest_of_the_table(spark, sf):
    got = queries.op13_merkle(spark, sf)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = c.sql(queries.oracle_sql()["op13_merkle"])
    assert sorted(rel.columns) == sorted(got.columns)
    rows = plain(got.collect())
    assert rows == plain(rel.fetchall()) and 0 < sum(r[-1] for r in rows) < len(rows)


def test_manifest_of_messy_rows(spark):
    rows = [(None, "A", "en", "s", 1), (None, None, None, None, None), (5, "", "", "", 0), (5, "", "", "", 0), (5, "Éx", "é", "s", 2)]
    rows += [(i, "Aa" * i, "en", None, i) for i in range(70)] + [(-i, "Q", f"l{i:02}", "s", 1) for i in range(9)]
    docs = spark.createDataFrame(rows, DOC)
    got = plain(document_manifest(docs.selectExpr("*", "1 AS leaf", "2 AS path", "3 AS g").repartition(7)).collect())
    assert got == plain(plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]))


def test_manifest_of_no_and_of_one_row(spark):
    assert document_manifest(spark.createDataFrame([], DOC)).collect() == []
    (r,) = document_manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOC)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == sha("")


def test_a_proof_is_of_its_leaf_only(spark):
    rows = manifest(spark.createDataFrame([(i, "g", sha(str(i))) for i in range(30)], "k long, lang string, leaf string"), "lang", ["k"], fanout=3)
    other = rows.selectExpr("*", "lag(leaf, 1, '') over (order by k) AS before")
    assert all(r.own == r.root and r.wrong != r.root for r in other.select("root", folded(other.leaf, other.path).alias("own"), folded(other.before, other.path).alias("wrong")).collect())


# ---- op12


A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain_alignment(rows):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    docs, df = [], collections.Counter()
    for i, text in rows:
        groups = []
        if text:
            ids = [t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)]
            parts = [[bytes(byte[c] for c in t.id_to_token(x)) for x in ids[0]], [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]]]
            if b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode():
                ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
                at = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    to = [bisect.bisect_right(e, cut) for e in ends]
                    groups.append([ids[k][at[k] : to[k]] for k in (0, 1)])
                    at = to
        links = collections.Counter((a, b) for g in groups for a in g[0] for b in g[1])
        df.update(links.keys())
        docs.append((i, groups, links))
    best = collections.Counter()
    for (a, _), n in df.items():
        best[a] = max(best[a], n)
    for i, groups, links in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        yield (
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), sha(text) if groups else "",
            sum(n for p, n in links.items() if df[p] == best[p[0]]), sum(n * df[p] for p, n in links.items()),
        )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def odd_texts():
    r = random.Random(1)
    fixed = [None, "", " ", "   ", "c▁d", "<|endoftext|> x", "</s> <s>", "a\r\n\r\n  b   ", "　x​", "日本語テキスト" * 50, "ab" * 3000, "=" * 5000, "x" + "ba" * 4000, " \t \n ", "😀😀a", "\x00a\x07", "ﬁ ｆｕ é"]
    return fixed + ["".join(r.choice("ab A\n\t.,'s1é日  <>_▁") for _ in range(r.randrange(80))) for _ in range(300)] * 2


@pytest.mark.parametrize("most", [4_000_000, 40])
def test_alignment(spark, sf, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i % 200, x) for i, x in enumerate(odd_texts())], "doc_id long, text string"))
    got = aligned_documents(docs.selectExpr("*", "1 AS row", "2 AS id", "3 AS pairs"), A, B, P.PATTERN, broadcast_pairs=most)
    assert plain(got.select(ALIGNED).collect()) == plain(plain_alignment([tuple(r) for r in docs.collect()]))


def test_alignment_of_a_query_and_of_no_rows(spark, sf):
    assert queries.op12_alignment(spark, sf).select(ALIGNED).count() == 200
    assert aligned_documents(spark.createDataFrame([], DOC), A, B, P.PATTERN).collect() == []
    (r,) = aligned_documents(spark.createDataFrame([(None, None)], "doc_id long, text string"), A, B, P.PATTERN).select(ALIGNED).collect()
    assert tuple(r) == (None, 0, 0, 0, 0, "", 0, 0)


def test_lanes_find_what_one_pass_finds():
    r = np.random.default_rng(2)
    for lane in (1, 3, 100):
        ends = [np.unique(np.append(r.integers(1, 900, 300), 900)) for _ in range(2)]
        first = np.arange(0, len(ends[0]), lane)
        i, j = lockstep(*ends, first, np.minimum(first + lane, len(ends[0])))
        both = np.intersect1d(*ends)
        assert (ends[0][i] == both).all() and (ends[1][j] == both).all()


# ---- op11


def plain_duplicates(rows, least=0.98):
    fit = collections.defaultdict(list)
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fit[label, len(v)].append(i)
    top, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for own in fit.values():
        x = np.array([rows[i][1] for i in own], np.float64)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in np.argwhere(x @ x.T >= least):
            if a != b:
                links[own[a]] += 1
                top[find(own[a])] = find(own[b])
    low = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(k, links[i], low.get(find(i)), k is not None and k == low[find(i)]) for i, (k, _, _) in enumerate(rows)]


VECTORS = "vec_id long, embedding array<double>, label string"


def cluster(rng, n, dim, noise, centre=None):
    centre = rng.standard_normal(dim) if centre is None else centre
    centre = centre / np.linalg.norm(centre)
    return [(centre + noise * rng.standard_normal(dim) / dim**0.5).tolist() for _ in range(n)]


def test_vector_duplicates_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = queries.op11_embedding_dups(spark, sf)
    want = plain(got.collect())
    assert want == plain(plain_duplicates([(r.vec_id, r.embedding, r.label) for r in rows.collect()]))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rel = c.sql(queries.oracle_sql()["op11_embedding_dups"])
    assert rel.columns == got.columns and plain(rel.fetchall()) == want


@pytest.mark.parametrize("dense, block", [(128, 1024), (6, 1024), (6, 5), (1000, 7)])
def test_vector_duplicates_of_dense_sets(spark, dense, block):
    """Balls within the angle, beyond it and overlapping: groups, their fringes, and blocks of buckets without a leader."""
    rng = np.random.default_rng(3)
    near = rng.standard_normal(24)
    vectors = cluster(rng, 60, 24, 0.08) + cluster(rng, 60, 24, 0.17) + cluster(rng, 40, 24, 0.1, near) + cluster(rng, 40, 24, 0.1, near + 0.17 * rng.standard_normal(24)) + cluster(rng, 80, 24, 9)
    rows = [(i, v, "x" if i % 7 else "y") for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    rows = [(int(i), [float(x) for x in v], str(label)) for i, v, label in rows]
    got = vector_dups.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(5), dense=dense, block=block, deviations=6)
    want = plain_duplicates(rows)
    lost = sum(r[1] for r in want) - sum(r[1] for r in got.collect())
    assert 0 <= lost <= 0.004 * sum(r[1] for r in want)
    if not lost:
        assert plain(got.collect()) == plain(want)


def test_messy_vectors(spark):
    one, two = [1.0, 2.0, -3.0], [-5.0, 1.0, 0.5]
    rows = [(1, one, "a"), (2, one, "a"), (2, one, "a"), (3, [2 * x for x in one], "a"), (4, one, "b"), (5, one, None), (6, None, "a"), (7, [], "a"), (8, [0.0, 0.0, 0.0], "a"), (9, [-0.0, 1.0, 0.0], "a"), (10, [0.0, 1.0, -0.0], "a")]
    rows += [(11, [float("nan"), 1.0, 1.0], "a"), (12, [float("inf"), 1.0, 1.0], "a"), (13, [None, 1.0, 1.0], "a"), (14, [1e300 * x for x in one], "a"), (15, [1e-300 * x for x in one], "a"), (16, one + two, "a"), (17, [1.0], "a"), (18, [3.0], "a"), (None, two, "a"), (None, None, "a"), (19, [x * 1.01 for x in two], "a")]
    docs = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS n", "2 AS key", "3 AS v")
    assert plain(vector_dups.near_duplicates(docs).collect()) == plain(plain_duplicates(rows))
    assert vector_dups.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []
    assert plain(vector_dups.near_duplicates(spark.createDataFrame([(1, None, "a")], VECTORS)).collect()) == [(1, 0, 1, True)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    for dim in (8, 64, 300):
        x = vector_dups._unit(rng.standard_normal((400, dim)))
        y = vector_dups._unit(x + 0.2 * vector_dups._unit(rng.standard_normal((400, dim))))
        bits = vector_dups.bits_of(dim, 0)
        codes, factors = vector_dups.encode(x, bits)
        q, step = vector_dups.rounded(y, np.arange(400))
        guess = (vector_dups.decoded(codes, dim, bits) * (q * step[:, None])).sum(axis=1) / factors
        true = (x * y).sum(axis=1)
        off = (guess - true) / np.sqrt(vector_dups.deviation(factors, bits, 0.98) ** 2 + step**2 / (4 * factors**2))
        assert abs((guess - true).mean()) < 0.003 and (np.abs(off) < vector_dups.DEVIATIONS).all() and 0.7 < off.std() < 1.1
