"""The training-data operators: against SQL or brute force on small tables, and on rows
with nulls, empty and very long texts, repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from loamgraph.llm import queries
from loamgraph.llm.ann import nearest
from loamgraph.llm.fingerprints import edited_fingerprints
from loamgraph.llm.lm_scoring import lm_scores
from loamgraph.llm.mixing import few_copies, mix_sources, nearest_sum
from loamgraph.llm.near_dedup import near_duplicates
from loamgraph.llm.packing import pack
from loamgraph.llm.quality import quality
from loamgraph.llm.token_counts import token_counts
from loamgraph.llm.tokenizer import default_path, encoder
from loamgraph.llm.toxicity import toxicity
from loamgraph.llm.url_filters import Rule, Trie, filter_urls
from loamgraph.runtime import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "a b"), (4, "x" * 200_000), (5, "w " * 30_000), (6, " \t\n"), (7, "один два три четыре пять 😀")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", s, 0, "clash", 1.0) for (i, t), s in zip(ODD, ["a", "b", None] * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score double")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("url, host, path", [(None, "", ""), ("no scheme", "", ""), ("http://A.Org", "a.org", ""), ("x://h?q/z", "h", ""), ("http://h/a#b?c", "h", "/a")])
def test_url_parts(spark, url, host, path):
    r = filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), []).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, None, "allow")


def test_trie_and_join_agree_with_brute_force(spark):
    rules = [Rule.parse(t, a) for t, a in (("org/", "allow"), ("b.org/x", "block"), ("b.org/x/y", "allow"), ("a.b.org/", "block"))]
    urls = [f"http://{h}/{p}" for h in ("a.b.org", "b.org", "bb.org", "org", "com") for p in ("", "x", "xz", "x/y", "x/yy")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    small, large = filter_urls(pages, rules), filter_urls(pages, rules, trie_chars=0)
    assert rows_of(small.toPandas()) == rows_of(large.toPandas())
    for r in small.collect():
        fits = [x for x in rules if ("." + r["host"]).endswith("." + x.host) and r["path"].startswith(x.path)]
        assert r["rule"] == (max(fits, key=lambda x: x.rank).text if fits else None)
    assert Trie(rules).match("nowhere", "/") is None


def test_lm_scores(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r for r in lm_scores(docs).collect()}
    texts = {r["doc_id"]: WORD.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)})) for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count: dict = {}
    for i, ws in texts.items():
        if not held(i):
            for w in [*ws, None]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, ws in texts.items():
        tokens = [*ws, None]
        assert got[i]["held_out"] == held(i) and got[i]["n_tokens"] == len(tokens) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(w in count for w in tokens)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens))
    rest = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in rest) > sum(r["base_score"] for r in rest)


@pytest.mark.parametrize("f, label, mod, out, least", [(quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 4, 2, 0.7)])
def test_classifiers_on_held_out_documents(spark, sf, f, label, mod, out, least):
    """The share of pairs of a document of either label that the scores order rightly:
    0.5 for any constant score, however uneven the labels are."""
    sf = sf.replace("sf0.001", "sf0.01")
    labels = table(spark, sf, "labels")
    found = f(table(spark, sf, "documents"), labels).where("held_out").join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % mod == out for i in found["doc_id"])
    one, none = (found.loc[found[label] == y, "score"].to_numpy()[:, None] for y in (1, 0))
    assert len(one) >= 5 and len(none) >= 5
    assert ((one > none.T) + 0.5 * (one == none.T)).mean() >= least
    # Clean documents are left alone, and most that are caught are rightly so.
    good = 0 if label == "toxic" else 1
    assert (found.loc[found[label] == good, "predicted"] == good).mean() >= 0.95


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 6), (0, 7), (0, 1)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_edited_fingerprints(spark, odd):
    docs = sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(k + 1) % len(docs)][1][:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = edited_fingerprints(odd).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)
    same = [r["fingerprint"] for r in got if r["doc_id"] == 1]
    assert same[0] == same[1]
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_nearest_sum_against_every_choice():
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(60):
        w, most = rng.integers(0, 40, 5).tolist(), rng.integers(0, 4, 5).tolist()
        wanted = int(rng.integers(0, 250))
        sums = {sum(a * b for a, b in zip(w, n)) for n in product(*(range(m + 1) for m in most))}
        got = nearest_sum(w, most, wanted)
        assert all(0 <= n <= m for n, m in zip(got, most))
        assert abs(sum(a * b for a, b in zip(w, got)) - wanted) == min(abs(s - wanted) for s in sums)
    assert sum(few_copies([10**7 + 1, 10**7, 3, 5], 10**7 + 6, 3)) >= 1


def test_mixing_sources_that_share_documents(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else [None]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mix_sources(docs).collect()
    assert len(got) == 900 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    total, taken = sum(r["size"] for r in got), sum(r["taken"] for r in got)
    assert abs(taken - total) <= 0.02 * total
    assert {c for c in mix_sources(docs.withColumn("taken", F.lit("x"))).columns} == {*docs.columns, "size", "source_size", "target", "copies", "taken"}


def test_mixing_a_source_without_words(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c").alias("text"), F.when(F.col("id") % 2 == 0, "full").otherwise("empty").alias("source"))
    got = mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert {r["source"]: (r["taken"], r["target"]) for r in got} == {"full": (900, 900.0), "empty": (0, 0.0)}


def test_mixing_more_sources_than_a_flow_could_take(spark):
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    assert mix_sources(docs).agg(F.count("*"), F.max("copies")).first() == (25_000, 2)


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_mixing(spark, sf, at):
    docs = table(spark, sf.replace("sf0.001", at), "documents")
    rows = mix_sources(docs).collect()
    by: dict = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, 0, r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [5, 2, 1] * len(names)))
    left, free, target = sum(s[0] for s in by.values()), set(names), {}
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 3 * by[n][0]]
        if not over:
            break
        for n in over:
            target[n] = 3 * by[n][0]
            left -= target[n]
            free.remove(n)
    target |= share
    for n, (_, taken, t) in by.items():
        assert t == pytest.approx(target[n])
        assert abs(taken - t) <= 0.02 * t + 50
    again = mix_sources(docs.repartition(7)).select("doc_id", "taken")
    assert rows_of(again.toPandas()) == sorted((str(r["doc_id"]), str(r["taken"])) for r in rows)


def test_packing_is_a_round_trip(spark, odd):
    enc = encoder(default_path())
    want = []
    for i, t in ODD:
        ids, _ = enc.encode([t or ""])
        want.append((i, np.append(ids, np.uint32(1))))
    rows = pack(odd.coalesce(1)).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
        assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"] for i, ids in want if i == r["doc_id"] and len(ids) == r["doc_tokens"])
    for pieces in by.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in want)


def test_ids_equal_the_vocabulary_librarys(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_path())
    texts = [r["text"] or "" for r in table(spark, sf, "documents").limit(60).collect()] + ["", "  \n", "😀é"]
    ids, at = encoder(default_path()).encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_ids_of_texts_with_the_added_token(spark):
    from tokenizers import Tokenizer

    tok, end = Tokenizer.from_file(default_path()), "<|endoftext|>"
    texts = [f"a {end} b", end, f"é.{end}{end}  \n {end} 's", f"<|endoftext|{end}>", f"  {end}\n\n{end[:-1]}"]
    enc = encoder(default_path())
    ids, at = enc.encode(texts)
    for k, t in enumerate(texts):
        mine = ids[at[k] : at[k + 1]]
        assert mine.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert enc.n_bytes[mine].sum() == len(t.encode())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for r in token_counts(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("all")).collect():
        assert r["n"] == r["all"] == want[r["doc_id"]]
    got = {r["doc_id"]: r for r in pack(docs.coalesce(1)).where("start = 0").collect()}
    whole = np.array([*tok.encode(texts[0], add_special_tokens=False).ids, 1], dtype="<u4")
    assert got[0]["doc_tokens"] == got[0]["length"] == len(whole) and got[0]["ids_crc32"] == zlib.crc32(whole.tobytes())
    assert {i: r["doc_tokens"] - 1 for i, r in got.items()} == want


def test_ids_of_a_very_long_run_of_spaces():
    from tokenizers import Tokenizer

    text = "a" + " " * 1_500_000 + "b"
    ids, _ = encoder(default_path()).encode([text])
    assert ids.tolist() == Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["first"])
def test_token_counts_add_up(spark, sf, rule):
    for r in token_counts(table(spark, sf, "documents"), rule=rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("all")).collect():
        assert r["n"] == r["all"]


@pytest.mark.parametrize("rule", ["first", "last", "majority", "split"])
def test_token_counts_against_brute_force(spark, rule):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_path())
    texts = ["a first line\n\n\nand  another one, internationally\n", "x", "один два 😀 три\nfour", "a <|endoftext|> b\r\n" * 3]
    docs = [(i, t, [(a, min(a + w, len(t))) for w in (3, 7) for a in range(0, len(t), w)]) for i, t in enumerate(texts)]
    want = {}
    for i, t, spans in docs:
        for k, (lo, hi) in enumerate(spans):
            n = 0.0
            for a, b in tok.encode(t, add_special_tokens=False).offsets:
                inside = max(0, min(b, hi) - max(a, lo))
                n += {
                    "first": lo <= a < hi, "last": lo < b <= hi, "split": inside / (b - a),
                    "majority": 2 * inside > b - a or (2 * inside == b - a and a >= lo),
                }[rule]
            want[i, k] = n
    frame = spark.createDataFrame(docs, "doc_id long, text string, spans array<struct<start: long, end: long>>")
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in token_counts(frame, rule=rule, sections="spans").collect()}
    assert got == pytest.approx(want)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(30, 120)))]
        for k in range(5):
            ws = list(base)
            for _ in range(k):
                ws[int(rng.integers(len(ws)))] = f"z{rng.integers(1000)}"
            texts.append(" ".join(ws))
    docs = [*enumerate(texts), (900, None), (901, ""), (902, "a b"), (903, "A  B"), (904, "x y z")]
    sets = {}
    for i, t in docs:
        ws = WORD.findall((t or "").lower())
        sets[i] = {tuple(ws[k : k + 4]) for k in range(len(ws) - 3)} if len(ws) >= 4 else ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]) and root[j] > root[i]:
                    root[j], changed = root[i], True
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == {(i, len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_near_duplicates_in_a_chain_and_in_a_group_below_the_similarity(spark):
    rng = np.random.default_rng(8)
    line = [f"c{i}" for i in range(3200)]
    chain = [line[6 * i : 6 * i + 100] for i in range(500)]  # each is linked with the next only
    base = [f"b{i}" for i in range(120)]
    group = []
    for _ in range(500):
        ws = list(base)
        for k in rng.choice(120, int(rng.integers(2, 12)), replace=False):
            ws[k] = f"z{rng.integers(1 << 30)}"
        group.append(ws)
    docs = list(enumerate(chain + group))
    sets = [{tuple(ws[k : k + 4]) for k in range(len(ws) - 3)} for _, ws in docs]
    root = list(range(1000))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for lo, hi in ((0, 500), (500, 1000)):
        for i in range(lo, hi):
            for j in range(i + 1, hi):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    want = {i: find(i) for i in range(1000)}
    assert len({want[i] for i in range(500)}) == 1 and len({want[i] for i in range(500, 1000)}) > 50
    frame = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame, width=4).collect()} == want


def test_near_duplicates_at_a_great_signature_distance(spark):
    # Pairs at the similarity 4 of 5 that share a key, with 16 to 18 of 30 slots differing.
    docs = []
    for k in (6350, 32287, 168937, 207646):
        words = [f"{c}{k}" for c in "abcde"]
        docs += [(2 * k, " ".join(words[:4])), (2 * k + 1, " ".join(words))]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=1)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(i, i - i % 2) for i, _ in docs}


def test_odd_rows(spark, odd, no_labels):
    n = len(ODD)
    for f in (quality, toxicity):
        assert f(odd, no_labels).count() == n
        assert f(odd.limit(0), no_labels).count() == 0
    for f in (lm_scores, near_duplicates, edited_fingerprints, mix_sources):
        assert f(odd).count() == n
        assert f(odd.limit(0)).count() == 0
    assert {r["doc_id"] for r in pack(odd).select("doc_id").collect()} == {i for i, _ in ODD}
    assert pack(odd.limit(0)).count() == 0 and token_counts(odd.limit(0)).count() == 0
    assert token_counts(odd).where("doc_id = 2").count() == 0


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf, "documents")
    assert [n for n, _ in pipeline.STAGES][0] == "toxicity" and len(pipeline.STAGES) == 5
    kept = pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    fresh = pipeline.drop_near_copies(spark, docs, sf)
    assert fresh.columns == docs.columns
    whole = near_duplicates(docs, width=5)
    assert {r["doc_id"] for r in fresh.collect()} == {r["doc_id"] for r in whole.where("kept").collect()}
    assert pipeline.run(spark, sf).agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
