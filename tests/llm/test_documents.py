"""Document operators against brute force, on small tables and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, html_text, licences, mixing, neardup, quality, registry, substring, tally, viterbi
from tests.compare import connect, differences

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PHRASE = " ".join(f"w{i}" for i in range(70))
ODD = [(1, PHRASE, "a"), (2, "intro " + PHRASE + " end", "a"), (3, None, "b"), (4, "", None), (5, " \n\t ", "b"), (6, PHRASE, "a"), (6, PHRASE, "a"), (7, "x" * 50_000, None), (8, "a b c", "z"), (9, "a  b\nc", "z"), (None, PHRASE + " tail", "a"), (10, "q " * 3000, "c")]


def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names could clash."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "id": F.lit(1), "key": F.lit("k"), "score": F.lit(0.5), "rank": F.lit(3), "size": F.lit(4), "u": F.lit(1), "node": F.lit(2)})


def cut(rows, window=20):
    """(words, removed, kept) by row, by the definition; rows that share an id are told apart by their texts."""
    mark = lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little")
    of = [((d is not None, d or 0), mark(text)) for d, text, *_ in rows]
    first = {}
    for i in sorted(range(len(rows)), key=of.__getitem__):
        w = WORD.findall(rows[i][1] or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (((True, 1 << 63), 0), 0)), (of[i], k))
    out = []
    for i, (d, text, *_) in enumerate(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (of[i], k):
                gone[k : k + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_substring(spark, small):
    for df in (odd(spark), spark.read.parquet(f"{small}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        for load in (substring.LOAD, 1 / 64):  # a sketch far too small lets more through and changes nothing
            got = substring.cut_repeats(spark, df, load=load).collect()
            assert sorted((tuple(r) for r in got), key=repr) == cut(rows)


def test_substring_of_rows_that_share_an_id(spark):
    own = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, PHRASE), (5, PHRASE), (5, own("u")), (5, own("v") + " " + own("u")), (9, own("x")), (9, own("x")), *[(None, own(f"n{i % 50}_")) for i in range(2000)]]
    got = substring.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == cut(rows)
    kept = [(r.doc_id, r.n_removed) for r in got]
    assert kept.count((5, 0)) >= 1 and kept.count((9, 0)) == 2 and len(kept) == len(rows)


def test_rows_repeated_without_end_go_to_many_parts(spark):
    df = spark.range(20_000).selectExpr("'same text' as text", "cast(null as long) as id")
    sizes = [r.n for r in tally.packed(df, 64).selectExpr("part", "octet_length(ids) div 8 as n").groupBy("part").sum("n").toDF("part", "n").collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2000


def test_substring_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = sorted((d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in cut(rows))
    assert sorted(map(tuple, substring.op2_substring_dedup(spark, small).collect())) == want


def test_substring_of_nothing(spark):
    assert substring.cut_repeats(spark, odd(spark).limit(0)).collect() == []


def links(rows):
    """All pairs (i, k) of rows whose weighted Jaccard similarity is 0.8 or more, by words in plain Python."""
    sets, holders = {}, {}
    for i, (_, text) in enumerate(rows):
        w = WORD.findall(text or "")
        grams = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else {}
        for g in grams:
            holders.setdefault(g, []).append(i)
        sets[i] = grams
    n = sum(map(bool, sets.values()))
    idf = {g: 1 + math.log((1 + n) / (1 + len(h))) / math.log(1 + n) for g, h in holders.items()}
    sets = {i: {g: c * idf[g] for g, c in s.items()} for i, s in sets.items()}
    mass = {i: sum(s.values()) for i, s in sets.items()}
    out = []
    for i, s in sets.items():
        both = Counter()
        for g, x in s.items():
            for k in holders[g]:
                if k > i:
                    both[k] += min(x, sets[k][g])
        out += [(i, k) for k, x in both.items() if x >= 0.8 * (mass[i] + mass[k] - x) - 1e-6]
    return out


def classes(rows):
    """Class of each (id, text), by all pairs."""
    parent = {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, k in links(rows):
        a, b = sorted((find(i), find(k)))
        parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 1 << 62)), (d is not None, d or 0))
    return sorted(((d, least[find(i)][1] if least[find(i)][0] else None) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates(spark, small):
    near = [(100 + i, " ".join(f"t{(k * 7) % 311 if k != 13 * i else i}" for k in range(200)), "n") for i in range(1, 40)]
    copies = spark.createDataFrame(near, "doc_id long, text string, source string")
    for df in (odd(spark).select("doc_id", "text", "source"), odd(spark).select("doc_id", "text", "source").union(copies), spark.read.parquet(f"{small}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = neardup.near_duplicates(spark, df).collect()
        assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == classes(rows)


def test_near_duplicates_find_almost_all_links(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, df).collect()}
    want = links(rows)
    found = sum(got[rows[i][0]] == got[rows[k][0]] for i, k in want)
    assert len(want) > 100 and found >= 0.99 * len(want)
    assert len(got) == len(rows)
    exact = dict(classes(rows))
    assert sum(got[d] != exact[d] for d in got) <= 0.01 * len(got)


def test_near_duplicates_of_rows_without_ids(spark):
    own = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(None, own(i % 500)) for i in range(10_000)] + [(7, own("x")), (7, own("y")), (8, own("y"))]
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == {(None, None, 20): 10_000, (7, 7, 1): 1, (7, 7, 2): 1, (8, 7, 2): 1}


def test_texts_that_share_a_node_are_split_by_their_further_bits(spark):
    rows = [(5, 1, 0, 0, [1] * 12), (5, 2, 0, 1, [2] * 12), (5, 1, 1, 2, [1] * 12), (6, 1, 0, 3, [3] * 12)]
    signed = spark.createDataFrame([(0, i, m, m, node, check, bands, 4, b"") for node, check, m, i, bands in rows], neardup._SIG_SQL)
    signed, nodes = neardup._split(spark, signed, neardup._nodes(signed))
    got = {r.id: r.node for r in signed.collect()}
    assert got[0] == got[2] == 5 and got[1] not in (5, 6) and got[3] == 6
    assert {r.node for r in nodes.collect()} == set(got.values())


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark, odd(spark).limit(0)).collect() == []


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    h = np.sort(rng.choice(1 << 48, 400, replace=False)).astype(np.uint64)
    w = rng.uniform(1, 6, 400).astype(np.float32)
    a, b = slice(0, 320), slice(60, 400)
    sampler = neardup.Sampler(3000)
    x, y = (sampler.sample(h[s], w[s], np.array([0]))[:, 0] for s in (a, b))
    want = neardup.weighted_jaccard(h[a], w[a], h[b], w[b])
    assert abs((x == y).mean() - want) < 0.04


def test_bpe(spark, small):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    random.seed(3)
    bits = ["a", "B", "é", " ", "  ", "\n", "'s", "1", "²", "!", "ab cd ", "\x1c", "\x85", "中", "😀", "　"]
    texts = [(i, "".join(random.choices(bits, k=random.choice([0, 5, 700, 3000])))) for i in range(40)]
    texts += [(50, None), (51, ""), (52, "x" * 5000), (53, " " * 3000 + "a"), (None, "a" * 90 + " b" * 600), (54, "same " * 200), (54, "same " * 200)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("seq", F.lit(1)).withColumn("ids", F.lit("x"))
    got = bpe.encode_documents(spark, df, path, public_tokenizers.PATTERN, chunk=256, overlap=96).collect()
    want = sorted(((d, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for d, t in texts), key=repr)
    assert sorted(((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), bytes(r.decoded)) for r in got), key=repr) == want
    for r in bpe.op8_byte_level_bpe(spark, small).limit(40).collect():
        assert r.n_tokens >= 0 and len(r.ids_sha256) == 64


def test_viterbi(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = viterbi.load_pieces(path)
    tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    random.seed(1)
    texts = ["".join(random.choices(["a", "the ", " ", "\n", "é", "中", "😀", "\t", "qu", "zx", " ▁", "xx"], k=40)) for _ in range(200)]
    texts += ["", " ", "  ", "a ", " a", "y" * 3000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_tokens", F.lit(9))
    got = {r.doc_id: r.n_tokens for r in viterbi.count_tokens(spark, df, path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_mixing(spark, small):
    for df in (odd(spark), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = [(r.source, len(WORD.findall(r.text or ""))) for r in df.collect()]
        sizes = {}
        for s, n in rows:
            sizes[s] = sizes.get(s, 0) + n
        names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
        weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(sizes.values())
        free = list(names)
        while True:
            total = sum(weight[s] for s in free)
            over = [s for s in free if left * weight[s] / total >= 2 * sizes[s]]
            if not over:
                target |= {s: left * weight[s] / total for s in free}
                break
            target |= {s: 2.0 * sizes[s] for s in over}
            left -= sum(2.0 * sizes[s] for s in over)
            free = [s for s in free if s not in over]
        mixed = mixing.mix_sources(spark, df, keep=("source",))
        got = mixed.collect()
        assert len(got) == len(rows)
        taken = {}
        for r in got:
            assert r.taken <= 2 * r.size and r.taken == r.copies * r.size and r.source_size == sizes[r.kept_source]
            assert abs(r.target - target[r.kept_source]) < 1e-6 * max(1, r.target)
            taken[r.kept_source] = taken.get(r.kept_source, 0) + r.taken
        if len(rows) > 100:
            assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in names)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(spark, df, keep=("source",)).collect()))


def test_quality(spark):
    big = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = [r for r in quality.op5_quality_rules(spark, big).collect() if r.held_out and r.doc_id in labels]
    assert len(got) > 50 and sum(r.predicted == labels[r.doc_id] for r in got) / len(got) > 0.93
    odd_scores = quality.scored(odd(spark), quality.fit_quality(spark, odd(spark), spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert len(odd_scores) == len(ODD) and all(r.score == 0.5 for r in odd_scores)


def test_rule_column_is_the_rule(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (400, len(quality.NAMES)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:100]], ", ".join(f"{n} double" for n in quality.NAMES))
    got = [r[0] for r in frame.select(model.column(F.struct(*quality.NAMES))).collect()]
    margin = model.bias + sum(w * quality._holds(rule, x[:100]) for rule, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-margin))) and ((np.array(got) > 0.5) == (y[:100] > 0)).mean() > 0.95


def test_licences(spark, small):
    assert differences(spark, small, licences.op3_license_scan, licences.OP3_SQL, connect(small)) is None
    text = "word " * 300 + "Released under the MIT License. " + "more " * 50
    rows = [(1, text), (2, None), (3, ""), (4, "mit"), (1, text), (None, text)]
    got = licences.scan_licences(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("tier", F.lit("x"))).collect()
    assert sorted({(str(r.doc_id), r.template) for r in got}) == [("1", "mit"), ("None", "mit")]
    assert licences.scan_licences(spark, spark.createDataFrame(rows, "doc_id long, text string").limit(0)).collect() == []


def test_html(spark):
    page = "<title>t</title><p>one<p>two<ul><li>a<li>b</ul><table><tr><th>Name<th>N<tr><td>alpha beta<td>1</table><div hidden>no</div><b>x</b> y<br>z&amp;"
    assert html_text.to_text(page) == "one\n\ntwo\n\n- a\n- b\n\nName       | N\nalpha beta | 1\n\nx y\nz&"
    assert html_text.to_text("<ol start=4><li>a<ul><li>b</ul></ol><pre> q\n  r</pre>") == "4. a\n  - b\n\n q\n  r"
    assert html_text.to_text("") == "" and html_text.to_text("a < b > c") == "a < b > c"
    assert html_text.to_text("<div style='display:none'>a<p>b</div>c<script>x</script><!-- y --><style>z") == "c"
    assert html_text.to_text("<b>" * 30_000 + "deep") == "deep"
    assert html_text.to_text('<a href="x>un<p>closed') != ""
    rows = [(1, page), (2, None), (3, ""), (1, page)]
    got = html_text.extract_text(spark, spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))).collect()
    assert sorted(str(r.text) for r in got) == sorted(["None", "", *[html_text.to_text(page)] * 2])


def test_html_keeps_every_visible_word():
    strip = re.compile(r"<(script|style|head)\b.*?</\1>|<!--.*?-->|<[^>]+>", re.S)
    import html

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        want = html.unescape(strip.sub(" ", page)).split()
        got = [w for w in html_text.to_text(page).split() if w not in ("-", "|")]
        assert "".join(w for w in want if w not in ("-", "|")) == "".join(re.sub(r"^\d+\.$", "", w) for w in got)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, small)
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            keep = sorted(d for d, c in classes(rows) if d == c)
            assert sorted(r.doc_id for r in after.collect()) == keep
        if name == "substring":
            want = {d: (m, k) for d, _, m, k in cut([(r.doc_id, r.text) for r in before.collect()])}
            texts = {r.doc_id: r.text for r in before.collect()}
            got = {r.doc_id: r.text for r in after.collect()}
            assert got == {d: (k if m else texts[d]) for d, (m, k) in want.items() if k or not m}
        assert name == "bpe" or tuple(after.columns) == corpus_pipeline.COLUMNS
        before = spark.createDataFrame(after.collect(), after.schema)
    assert before.count() > 0


def test_pipeline_runs_as_a_whole(spark, small):
    """What ``run`` returns: of each text that is left, the ids that the library gives and the digest of the same text."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, small)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, len(ids := enc.encode_ordinary(r.text or "")), np.array(ids, "<u4").tobytes(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect())
    assert got == want and len(got) > 50


def test_bpe_query(spark, small):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    assert sorted(map(tuple, bpe.op8_byte_level_bpe(spark, small).collect())) == sorted(want)


def test_stages_take_odd_rows(spark, small):
    docs = odd(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).collect()
        assert stage(spark, docs.limit(0), small).collect() == []


def test_operators_on_empty_tables(spark):
    none, path = odd(spark).limit(0), public_tokenizers.path("piece_bpe_32k.model")
    assert viterbi.count_tokens(spark, none, path).collect() == []
    assert html_text.extract_text(spark, none, "doc_id", "text").collect() == []
    assert mixing.mix_sources(spark, none).collect() == []
    assert bpe.encode_documents(spark, none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []
    model = quality.fit_quality(spark, none, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.scored(none, model).collect() == []


def test_mixing_tells_rows_of_one_id_apart(spark):
    """Copies go by id and text, so a rerun over rows in another order gives each the same."""
    rows = [(1, " ".join(f"{k}x{i}" for i in range(10)), "a" if k % 3 else "b") for k in range(60)]
    taken = []
    for order in (rows, rows[::-1]):
        mixed = mixing.mix_sources(spark, spark.createDataFrame(order, "doc_id long, text string, source string"), keep=("text",))
        taken.append(sorted((r.kept_text, r.taken) for r in mixed.collect()))
    assert taken[0] == taken[1]


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 11)] and names[-1] == "pipeline"
