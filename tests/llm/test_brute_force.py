"""Operators against plain restatements of their contracts, on the smallest tables and on made fixtures."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import encode, fingerprint, jaccard, langid, linededup, mixing, packing, quality, registry, topk, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def run(spark, name):
    return registry.QUERIES[name](spark, SF).toPandas()


def test_texts_are_split_at_marks_after_kana_and_letters():
    import pyarrow as pa

    own = encode.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("これはペンです。" * 500, "one!two?three;four:" * 500, "コーヒー、" * 500):
        data = np.frombuffer(text.encode(), np.uint8)
        assert len(own._pieces(data, np.array([0, len(data)]))) >= 500
        assert own.encode(pa.array([text]), want_ids=True)[1][0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cur = con.execute(registry.SQL[name])
    cols = [c[0] for c in cur.description]
    own = registry.QUERIES[name](spark, SF)
    shown = lambda rows, names: sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in (r[names.index(c)] for c in sorted(names))) for r in rows)
    assert sorted(own.columns) == sorted(cols)
    assert shown([tuple(r) for r in own.collect()], own.columns) == shown(cur.fetchall(), cols)


def test_token_counts(spark, texts, tokenizer):
    out = run(spark, "op2_token_counts").set_index("doc_id")
    for i, text in texts.items():
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (out.n_tokens[i], out.n_bytes[i], out.over_limit[i]) == (n, len(text.encode()), n > 1024)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_safe_pieces(name):
    import pyarrow as pa

    tokenizer, own_encoder = Tokenizer.from_file(public_tokenizers.path(name)), encode.Encoder(public_tokenizers.path(name))
    assert own_encoder.splits == name.startswith("byte")
    alphabet = ["a", "B", "é", "7", " ", "  ", "\n", "\t", ",", ".", "'", "s", "'t", "%", "\x1c", "\xa0", "\xa0 ", "<|endoftext|>", "漢", "字。", "、", "，", "あ", "㉈", " ", "\r\n", "\u3000", "\u200b", "۵", "़", "!", "?", ";", ":", "x!", "カ", "ー", "゛", "・", "゙", "。", "！", "一", "ヿ", "ゟ"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["漢字仮名。" * 500, "word\xa0word, " * 500, "x" * 3000]
    for _ in range(2):  # the second time from what is kept
        counts, ids = own_encoder.encode(pa.array(texts), want_ids=True)
        for text, n, own in zip(texts, counts, ids):
            assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and n == len(own), repr(text)
    if own_encoder.splits:
        assert max(len(p) for p in np.split(np.frombuffer(texts[-3].encode(), np.uint8), own_encoder._pieces(np.frombuffer(texts[-3].encode(), np.uint8), np.array([0, len(texts[-3].encode())])))) <= 18


def test_packing(spark, texts, tokenizer):
    out = run(spark, "op10_best_fit_packing")
    by = out.sort_values("piece").groupby("doc_id")
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = by.get_group(i)
        assert own["piece"].tolist() == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() == len(ids) and (own["length"][1:] == 1024).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 1024
    assert out["sequence_id"].nunique() <= packing.lower_bound(out["length"].to_numpy(), 1024) + 1


def test_bounds_and_exchange(spark):
    rng = random.Random(5)
    for _ in range(30):
        sizes = np.array(sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 40))), reverse=True))
        bins, offsets, fill = packing.best_fit_decreasing(sizes, 20)
        assert packing.lower_bound(sizes, 20) <= len(fill) and fill.max() <= 20 and fill.sum() == sizes.sum()
    assert packing.lower_bound(np.array([600] * 5), 1024) == 5 and packing.lower_bound(np.array([400] * 5), 1024) == 3
    rows = [(i, 0, 0, rng.randint(1, 1024), 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    out = packing.pack(pieces, items=200).toPandas()
    assert len(out) == 3000 and out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert out["sequence_id"].nunique() <= 1.03 * packing.lower_bound(np.array([r[3] for r in rows]), 1024)


def shingles(text):
    w = [m.lower() for m in WORD.findall((text or "").encode())]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets):
    where, met, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for ids in where.values():
        met.update(itertools.combinations(sorted(ids), 2))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), k in met.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in sets}


def test_near_duplicates_with_large_groups_and_chains(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    common = [f"c{i}" for i in range(45)]
    rows = []
    for i in range(150):  # near copies, each with an edit of its own
        words = list(base)
        words[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(words)))
    chain = [f"k{i}" for i in range(100)]
    for i in range(12):  # each links with the next only
        rows.append((200 + i, " ".join(chain[5 * i : 5 * i + 40])))
    for i in range(60):  # a shared passage is most of the text, but not enough
        rows.append((300 + i, " ".join(common + [f"p{i}_{j}" for j in range(rng.randint(8, 16))])))
    rows += [(400, "Same  text here"), (401, "same text\nHERE"), (402, "a b"), (403, ""), (404, None), (405, "")]
    rng.shuffle(rows)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets)
    assert out == {i: (len(sets[i]), want[i]) for i in sets}


def test_near_duplicates_within_a_group_of_equal_prefixes(spark):
    """Documents 2 and 3 link, share size and prefix with 1, which links with neither, and 4 is the label most seen there."""
    some = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    p, c = some("p", 5), some("c", 9)
    sets = {1: p + c[:6] + some("m", 5), 2: p + c + some("x", 2), 3: p + c + some("y", 2), 4: p + some("z", 15)}
    sets |= {k: c + some("m", 5) + some("x", 2) + some("y", 2) + some("z", 15) + [f"own{k}"] for k in range(10, 15)}
    rng = random.Random(5)
    for corpus in range(150):  # documents put together from few passages; each corpus has its own
        size = rng.choice((12, 16, 20))
        pool = [f"r{corpus}_{i}" for i in range(size + rng.randint(3, 10))]
        sets |= {100 * (corpus + 1) + k: rng.sample(pool, size) for k in range(rng.randint(15, 40))}
    rows = [(i, " ".join(s)) for i, s in sets.items()]
    out = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=1).collect()}
    assert out[2] == out[3] == 2 and out[1] == 1 and out[4] == 4
    for corpus in range(151):
        own = {i: set(s) for i, s in sets.items() if i // 100 == corpus}
        assert {i: out[i] for i in own} == components(own)


def test_pipeline_keeps_documents_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    some = lambda tag: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(30))
    rows = [(i, some("a")) for i in range(10)] + [(None, some("b")) for _ in range(20)] + [(3, some("c")) for _ in range(5)]
    rows += [(None, rows[0][1] + " more"), (4, rows[12][1] + " more"), (5, rows[5][1]), (None, rows[15][1]), (6, rows[31][1] + " end")]
    rows += [(7, ""), (8, None), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as bigint) n_chars")
    order = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    label = components({k: shingles(t) for k, (_, t) in enumerate(order)})
    want = Counter(r for k, r in enumerate(order) if label[k] == k) + Counter([(None, "")])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == list(corpus_pipeline.COLUMNS) and Counter((r.doc_id, r.text) for r in out.collect()) == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0)], "doc_id bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.where("doc_id is null").count() >= 10


def test_long_spans_and_final_marks_are_decoded(spark):
    sentence = "the small dog is an idiot and runs home"
    cost = toxicity.train_characters(spark.createDataFrame([(1, f"{sentence}. dumbass idea. " * 300)], "doc_id bigint, text string"))
    decoder = toxicity.Decoder(cost)
    spaced = " ".join(sentence.replace(" ", "") * 20)
    assert len(spaced) > 1000 and decoder.decode(spaced).split() == sentence.split() * 20
    for text, word in (("an idio+ runs", "idiot"), ("a dumba$$ runs", "dumbass"), ("the ide@ runs", "idea")):
        own = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        (_, b, e), *more = toxicity.suspicious(own, np.array([0, len(own)]))
        assert not more and decoder.decode(text[b:e]) == word


def test_line_dedup_runs(spark):
    line = lambda tag, n=12: " ".join(f"{tag}{j}" for j in range(n))
    passage = [line(f"p{k}_") for k in range(6)]
    rows = [(1, "\n".join([line("a"), *passage, line("b")])), (2, "\n".join([line("c"), *passage, line("d")])), (3, "\n".join([line("e"), *passage[:1], line("f")])), (4, "\n".join([*passage, line("g"), "", *passage])), (5, line("h") + "\n" + line("long", 60)), (6, line("long", 60))]
    out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    assert out[1].text == texts[1] and out[3].text == texts[3] and out[5].text == texts[5]
    assert out[2].text == line("c") + "\n" + line("d") and out[2].n_deleted == 6
    assert out[4].text == line("g") + "\n" and out[6].text == "" and (out[4].n_lines, out[4].n_deleted) == (14, 12)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_fingerprints(spark, texts):
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 64))) for _ in range(2))
        assert fingerprint.edit_distance(a, b) == levenshtein(a, b)
    out = run(spark, "op7_fingerprints").set_index("doc_id")
    ids = sorted(texts, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        row = out.loc[i]
        assert row.n_chars == len(texts[i]) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (fingerprint.fingerprint(texts[i]), fingerprint.fingerprint(edited))
        assert row.near_next == fingerprint.likeness(row.fingerprint, out.fingerprint[j]) and 0 <= row.near_edited <= 1
    assert out.near_edited.mean() > 0.4 > 0.2 > out.near_next.mean()


def test_fingerprint_buckets(spark):
    rows = [(3 * i, f"text {i} " * (i % 9 + 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    one, many = (fingerprint.fingerprint_chain(df, bucket=b).toPandas().set_index("doc_id").sort_index() for b in (1000, 20))
    assert one.equals(many) and len(one) == 500


def top_k_by_hand(rows, k, asked):
    """Python integers throughout."""
    v = {i: [math.floor(64 * Fraction(x)) for x in e] for i, e in rows}
    out = {}
    for i in v:
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(v[i], v[j])), j) for j in v if j != i)[:k]
            out[i] = [(r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return out


def lines_that_must_go(docs, least=50):
    """(document, line) of every window (the fewest lines from one on that hold `least` words) that stands, line for line, at an earlier place."""
    seen, gone = set(), set()
    for b, doc in enumerate(docs):
        for i in range(len(doc)):
            end = next((e for e in range(i + 1, len(doc) + 1) if sum(len(x.split()) for x in doc[i:e]) >= least), None)
            if end is not None:
                if tuple(doc[i:end]) in seen:
                    gone |= {(b, k) for k in range(i, end)}
                seen.add(tuple(doc[i:end]))
    return gone


def test_line_dedup_keeps_its_promise(spark):
    """200 small corpora of few lines that recur, told apart by their first word; every repeated window of 50 words goes."""
    rng, rows, want = random.Random(8), [], {}
    line = lambda c, k, n: f"c{c}l{k}" + " w" * (n - 1)
    for c in range(200):
        sizes = [rng.choice([5, 12, 24, 25, 25, 26, 30, 49, 50, 60]) for _ in range(rng.randint(2, 6))]
        docs = [[line(c, k, sizes[k]) for k in (rng.randrange(len(sizes)) for _ in range(rng.randint(1, 9)))] for _ in range(rng.randint(2, 6))]
        if c < 12:
            docs = [[line(c, 0, 25)], [line(c, 0, 25), line(c, 1, 25)], [line(c, 0, 25), line(c, 1, 25)]]
        rows += [(c * 10 + k, "\n".join(d)) for k, d in enumerate(docs)]
        want |= {(c * 10 + b, i): docs[b] for b, i in lines_that_must_go(docs)}
    out = {r.doc_id: (r.text, r.n_deleted) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    by = defaultdict(set)
    for d, i in want:
        by[d].add(i)
    whole = dict(rows)
    assert len(by) > 100
    for d, places in by.items():
        lines = whole[d].split("\n")
        kept = out[d][0].split("\n") if out[d][0] else []
        must = Counter(lines[i] for i in places)
        assert len(lines) - len(kept) == out[d][1] and all((Counter(lines) - Counter(kept))[x] >= n for x, n in must.items()), (d, lines, kept, places)
    assert all(out[c * 10 + 2][0] == "" for c in range(12))  # a run of two lines whose first stands alone before


def test_exact_top_k_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(2000, 16))
    skewed = flat * np.exp(-np.arange(16.0))  # few dimensions decide
    centres = rng.normal(size=(40, 16)) * 8
    copies = centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) / 50
    shares = []
    for x in (flat, skewed, copies):
        v = np.floor(64 * x)
        lists, asked = topk.Lists(v), np.arange(0, 2000, 40)
        found = lists.search(v[asked], 20, asked, np.full(50, -np.inf))
        want = v[asked] @ v.T
        want[np.arange(50), asked] = -np.inf
        least = np.sort(want, axis=1)[:, -20]
        told = lists.search(v[asked], 20, asked, least)
        for k, i in enumerate(asked.tolist()):
            best = set(np.flatnonzero(want[k] >= least[k]))
            assert best <= set(found[k][0].tolist()) and best <= set(told[k][0].tolist()) and i not in found[k][0] and told[k][1] <= found[k][1]
        shares.append(sum(n for _, n in found) / v.size / 50)
    assert shares[1] < 0.6 and shares[2] < 0.6 and max(shares) < 1, shares


@pytest.mark.parametrize("size", [1.0, 3e4, 1e9, 1e120])
def test_exact_top_k_by_blocks(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.choice([-1, 0, 0.25, 1, 3], 5) * size + rng.integers(0, 3, 5)]) for i in range(300)]
    out = topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 7, block=64, queries=8)
    found = defaultdict(list)
    for r in out.collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert 0 < r.read_share <= 1 or r.score == 0
    want = top_k_by_hand(rows, 7, lambda i: i % 20 == 0)
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    assert {i: sorted(x) for i, x in found.items()} == {i: [(r, j, clip(s)) for r, j, s in x] for i, x in want.items()}


@pytest.mark.parametrize("dims", [2, 3, 16, 1024])
def test_exact_top_k_of_uneven_components(dims):
    """Small components beside large ones, where the rest of a length is a difference of nearly equal numbers."""
    rng = np.random.default_rng(dims)
    for most in (1, 1e3, 1e6):
        v = np.floor(10 ** rng.uniform(0, np.log10(most) + 1e-9, (600, dims)) * rng.choice([-1, 1, 1], (600, dims)))
        v[rng.random((600, dims)) < 0.3] = 0
        q = np.floor(10 ** rng.uniform(0, 6, (20, dims)) * rng.choice([-1, 0, 1], (20, dims)))
        want = (v.astype(object) @ q.astype(object).T).T
        for k, (rows, _) in enumerate(topk.Lists(v).search(q, 10, np.full(20, -1), np.full(20, -np.inf))):
            least = sorted(want[k])[-10]
            assert {i for i in range(600) if want[k][i] >= least} <= set(rows.tolist())


def test_exact_top_k_sees_small_components(spark):
    kinds = [((9998, 3), 100), ((10000, 2), 50), ((100, 3), 2000), ((5000, 0), 5800)]
    rows = [(0, [10000 / 64, 10000 / 64])]
    for (a, b), n in kinds:
        rows += [(20 * len(rows) + 1 + i * 20, [a / 64, b / 64]) for i in range(n)]
    out = topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 20, query="vec_id = 0").collect()
    assert [r.score for r in sorted(out, key=lambda r: r["rank"])] == [100_020_000] * 20


def test_exact_top_k_takes_repeated_rows(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [3.0, 0.5]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (40, [0.0, -1.0]), (None, [9.0, 9.0])]
    out = topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 3)
    own = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None]
    want = []
    for k, (i, q) in enumerate(own):
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(own) if m != k)[:3]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == sorted(want)


def test_char_lattice(spark, docs):
    cost = toxicity.train_characters(docs)
    decoder = toxicity.Decoder(cost)
    for raw, want in (("m0r0n", "moron"), ("i d i o t", "idiot"), ("traaash", "trash"), ("p.a.t.h.e.t.i.c", "pathetic"), ("5tup1d", "stupid")):
        assert decoder.decode(raw) == want


def test_tricks_meet_in_one_span(docs):
    decoder = toxicity.Decoder(toxicity.train_characters(docs))
    for text, want in (("m 0 r 0 n", "moron"), ("i.d-i.o t", "idiot"), ("iiddiioott", "idiot"), ("you m-0.r 0_n now", "moron"), ("1dd11oott", "idiot")):
        own = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        (_, b, e), *more = toxicity.suspicious(own, np.array([0, len(own)]))
        assert not more and decoder.decode(text[b:e]) == want, text
    spans = lambda text: toxicity.suspicious(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)]))
    assert spans("so @$$ it") == [(0, 3, 6)] and not spans("it cost 100 and 1 2 3, wow!!!") and not spans("") and not spans("$ !")


def test_what_stands_between_letters_is_left_out(docs):
    decoder = toxicity.Decoder(toxicity.train_characters(docs))
    lexicon = toxicity.Lexicon({"idiot$": 0.9, "stupid$": 0.9}, 0.1)

    def decoded(text):
        own, at = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)])
        spans = [(b, e, toxicity.BREAK) for _, b, e in toxicity.suspicious(own, at)] + [(b, e, 0.0) for _, b, e in lexicon.across(own, at)]
        return {w for b, e, parting in spans for w in decoder.gained(text[b:e].lower(), parting)[1]}

    idiots = ["i  d  i  o  t", "i . d . i . o . t", "i/d/i/o/t", "i,d,i,o,t", "\u00efd\u00ef\u00f6t", "i\u0308dio\u0308t", "id\u200bi\u200b\u200bot", "\uff49\uff44\uff49\uff4f\uff54", "id iot", "i.diot", "\u0456di\u043et", "ID\u00adIOT"]
    for text in idiots:
        assert "idiot" in decoded(f"you {text} of all"), text
    for text in ("stuupid", "st.up.id", "st up id", "s/t/u/p/i/d", "st\u00fcpid", "stup-id"):
        assert "stupid" in decoded(f"so {text} it is"), text
    assert not {"idiot", "stupid"} & decoded("put id, iota and stupor; see letters, good books, and/or a well-known cafe: a, b, c")
    assert not lexicon.across(np.frombuffer("idiot stupid id\niot".encode("utf-32-le"), np.uint32), np.array([0, 19]))
    reach, rng, held = lexicon.reach(), random.Random(3), 0
    for _ in range(3000):
        text = "".join(rng.choice(["i", "d", "i", "o", "t", "\u00ef", "-", ",", "\u200b", "x", "dd"]) for _ in range(rng.randint(3, 9))) + rng.choice(["", "idiot", "idi-ott"])
        found = [w for w in decoder.decode(text).split() if lexicon.of_word(w)]
        held += bool(found)
        assert reach(text) or not found, text
    assert held > 100 and not reach("letters") and not toxicity.Lexicon({}, 0.1).reach()("id-iot")
    assert not lexicon.across(np.frombuffer("idiot".encode("utf-32-le"), np.uint32), np.array([0, 2, 5]))


def test_viterbi_is_the_best_of_all_paths(docs):
    decoder = toxicity.Decoder(toxicity.train_characters(docs))
    rng = random.Random(8)

    def price(span, choice):
        a, b, total = 0, 0, 0.0
        for i, k in enumerate(choice):
            out, own = decoder.options(span, i)[k]
            total += own
            if out:
                s = toxicity.symbol(out)
                total, a, b = total + decoder.step(a, b, s), b, s
        return total

    for _ in range(60):
        span = "".join(rng.choice("idot1!$@. -sa") for _ in range(rng.randint(1, 7)))
        full = span + "\n"
        paths = list(itertools.product(*(range(len(decoder.options(full, i))) for i in range(len(full)))))
        best = min(price(full, p) for p in paths)
        words = {" ".join("".join(decoder.options(full, i)[k][0] for i, k in enumerate(p)).split()) for p in paths if price(full, p) <= best + 1e-6}
        assert decoder.decode(span) in words, span


def test_lexicon_is_the_same_after_a_shuffle(spark):
    big = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    cost = toxicity.train_characters(docs)
    one, two = (toxicity.train_lexicon(d, labels, cost).odds for d in (docs, docs.repartition(7).sortWithinPartitions(F.desc("doc_id"))))
    assert one and one == two
    long = "x" * 70
    lexicon = toxicity.Lexicon({long + "$": 0.9}, 0.1)
    own = np.frombuffer(f"a {long} {long}y".encode("utf-32-le"), np.uint32)
    assert [a.tolist() for a in lexicon.of_words(own, np.array([0, len(own)]))] == [[0], [0.9]]


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name,folds,held,column,least", [("op6_quality", 5, 0, "quality", 0.9), ("op1_toxicity", 3, 1, "toxic", 0.85)])
def test_held_out_accuracy(spark, name, folds, held, column, least):
    big = SF.replace("0.001", "0.01")
    out = registry.QUERIES[name](spark, big).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{big}/labels.parquet").toPandas().set_index("doc_id")[column]
    assert all(out.held_out[i] == (fold(i, folds) == held) for i in out.index)
    own = out[out.held_out & out.index.isin(labels.index)]
    assert (own.predicted == labels[own.index]).mean() >= least and own.score.between(0, 1).all()


def test_languages(spark, docs):
    out = run(spark, "op8_language_id").set_index("doc_id")
    lang = docs.toPandas().set_index("doc_id")["lang"]
    own = out[out.held_out]
    assert (own.lang_pred == lang[own.index]).mean() >= 0.95
    english, german = (" ".join(docs.where(F.col("lang") == k).limit(5).toPandas()["text"])[:1500] for k in ("en", "de"))
    mixed = spark.createDataFrame([(1, english + " " + german)], "doc_id bigint, text string")
    spans = langid.identify(mixed, langid.train(docs)).first().lang_spans
    assert {s.lang for s in spans if s.letters > 600} == {"en", "de"} and len(spans) < 8


def test_non_negative_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    mixed = np.concatenate([good[:2400], bad[:1600]])
    model = quality.fit(good[2400:], mixed, 0.6, steps=800)
    assert (model.score(good) > 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.85):
        p, n = rng.normal(1.5, 1, (6000, 3)), rng.normal(-1.5, 1, (6000, 3))
        k = int(4000 * prior)
        mixed = np.concatenate([p[:k], n[: 4000 - k]])[rng.permutation(4000)]
        assert abs(quality.estimate_prior(p[4000:], mixed) - prior) < 0.05


def test_fit_is_a_minimum_of_the_risk():
    rng = np.random.default_rng(2)
    p, u = rng.normal(0.7, 1, (3000, 2)), np.concatenate([rng.normal(0.7, 1, (1500, 2)), rng.normal(-0.7, 1, (1500, 2))])
    model = quality.fit(p, u, 0.5)

    def risk(w):
        z = lambda x: np.clip((x - model.mean) / model.scale, -6, 6) @ w[:-1] + w[-1]
        loss = lambda v: np.mean([math.log1p(math.exp(-x)) for x in v])
        return 0.5 * loss(z(p)) + max(0, loss(-z(u)) - 0.5 * loss(-z(p)))

    best = risk(model.weights)
    for step in (0.05, -0.05, 0.3, -0.3):
        for k in range(3):
            assert risk(model.weights + step * np.eye(3)[k]) >= best - 1e-4


def test_figures_of_texts(texts):
    import pyarrow as pa

    own = [*list(texts.values())[:60], "", None, "a  a a\nb!!\nb!! ÀB 12\n", "\n\n", "!!!!"]
    x = quality.features(pa.array(own))
    for text, row in zip(own, x):
        raw = (text or "").encode()
        w, lines = [m.lower() for m in WORD.findall(raw)], re.findall(rb"[^\n]*\n|[^\n]+", raw)
        n = max(1, len(w))
        letters = max(1, sum(65 <= c < 91 or 97 <= c < 123 or c > 127 for c in raw))
        again = sum(a == b for a, b in zip(w, w[1:]))
        same = sum(a == b and 32 < a < 127 and not chr(a).isalnum() for a, b in zip(raw, raw[1:]))
        want = [math.log1p(len(raw)), sum(65 <= c < 91 for c in raw) / letters, sum(48 <= c < 58 for c in raw) / max(1, len(raw)), sum(c > 127 for c in raw) / letters, letters / max(1, len(raw)), math.log1p(same), same / n]
        want += [len(set(w)) / n, len(set(lines)) / max(1, len(lines)), math.log(n / max(1, len(lines)) + 1), letters / n, math.sqrt(again / n), math.log1p(again)]
        assert np.allclose(row[:13], want), repr(text)


def test_language_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    rows = [rng.integers(1, 7) for _ in range(40)]
    row = np.repeat(np.arange(40), rows)
    score = rng.normal(size=(len(row), 3)) * 4
    path = langid.viterbi(score.astype(np.float32), row, 40, 3.0)
    for r in range(40):
        own = score[row == r]
        value = lambda p: sum(own[t, k] for t, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=len(own)), key=value)
        assert math.isclose(value(best), value(path[row == r]), abs_tol=1e-4)


def test_scripts_bar_languages_and_marks_join_words(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog " * 20, "en"), (2, "हिन्दी भाषा में लिखा हुआ पाठ है " * 20, "hi"), (3, "съешь ещё этих мягких французских булок " * 20, "ru")]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(1, "हिन्दी में"), (2, "ё" * 500), (3, "़ ़़"), (4, "हिन्दी the fox")], "doc_id bigint, text string"), model).collect()}
    assert out[1].lang_pred == "hi" and [s.words for s in out[1].lang_spans] == [2] and out[2].lang_pred == "ru" and out[3].lang_pred == "und"
    assert [s.lang for s in out[4].lang_spans] == ["hi", "en"]


def test_mix_meets_targets(spark):
    out = run(spark, "op4_mix_sources")
    assert (out["taken"] <= 2 * out["size"]).all()
    by = out.assign(source=spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["source"].loc[out["doc_id"]].to_numpy()).groupby("source")
    for _, own in by:
        assert math.isclose(own["taken"].sum(), own["target"].iloc[0], abs_tol=2 * own["size"].max())
    assert out.groupby("source_size")["target"].nunique().max() <= 2


def test_mix_is_fair_queueing(spark):
    """Against a plain queue: the copy that finishes first goes next, until the budget is passed."""
    rng = random.Random(6)
    rows = [(i, rng.choice("aabbbbc") if i % 9 else None, rng.randint(0, 30)) for i in range(400)] + [(7, "a", 5), (7, "a", 5), (None, "b", 3), (None, "c", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    order, done, every = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or "")), [], sum(r[2] for r in rows)
    total = {s: sum(r[2] for r in rows if r[1] == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * every, set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] < level * weight[s]}
        if not full:
            break
        target |= {s: 2 * total[s] for s in full}
        left, open_ = left - sum(2 * total[s] for s in full), open_ - full
    target |= {s: level * weight[s] for s in open_}
    for s in order:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(f"17:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))
        run = 0
        for copy in range(2):
            for r in own:
                run += r[2]
                if r[2]:
                    done.append((math.floor(run / target[s] * 2**40), r))
    done.sort(key=lambda x: x[0])
    words, taken = 0, []
    for t, ties in itertools.groupby(done, key=lambda x: x[0]):
        ties = [r for _, r in ties]
        words += sum(r[2] for r in ties)
        if words > 1.5 * every:
            break
        taken += [(t, r) for r in ties]
    out = mixing.mix_sources(docs).collect()
    assert {r.source: round(r.target, 6) for r in out} == {s: round(x, 6) for s, x in target.items()}
    by = Counter()
    for _, r in taken:
        by[r] += r[2]
    assert sum(r.taken for r in out) == sum(by.values())
    assert {k: v for k, v in Counter({k: sum(r.taken for r in out if (r.doc_id, r.source, r["size"]) == k) for k in set(rows)}).items() if v} == dict(by)
    mix = [(r.finish, (r.doc_id, r.source, r["size"])) for r in mixing.mixed(docs).collect()]
    assert [f for f, _ in mix] == sorted(f for f, _ in mix) and Counter(r for _, r in mix) == Counter(r for _, r in taken)


def test_mix_of_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id") % 1000).alias("source"), (F.col("id") % 7 + 1).alias("size"))
    out = mixing.mix_sources(docs).toPandas()
    assert len(out) == 3000 and (out["taken"] <= 2 * out["size"]).all()
    by = out.groupby("source").agg({"taken": "sum", "target": "first"})
    assert len(by) == 1000 and ((by["taken"] - by["target"]).abs() <= 7).all()
