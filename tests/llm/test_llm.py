"""The corpus operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tok = pytest.importorskip("public_tokenizers")

from vecspark.llm import embed_dedup, jaccard_join, langid, lm_score, mixing, packing, secret_scan, token_codec, tokenise, topk, url_filter  # noqa: E402
from vecspark.llm.common import shingle_hashes, words_by_row  # noqa: E402
from vecspark.llm.components import connected_components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, v string, pos int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(spark, seed=1, copies=12):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(60)]
    base = prose(rng, 80).split()
    for _ in range(copies):
        t = list(base)
        t[rng.randrange(80)] = "changed"
        texts.append(" ".join(t))
    texts += [texts[0], texts[0].upper(), None, "", "  \n\t ", "one", "one two three", "x" * 5000, prose(rng, 3000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or ""), "r", None, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_match_words():
    texts = ["Ab  cd\tEF", None, "", "ab", "éa x\x0by", " lead trail ", "ab cd ef"]
    got = [w.tolist() for _, w in words_by_row(pa.array(texts))]
    one = {}
    for t, hs in zip(texts, got):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        assert len(words) == len(hs)
        for w, h in zip(words, hs):
            assert one.setdefault(w, h) == h
    assert len(set(one.values())) == len(one)
    assert len(shingle_hashes(np.array(got[0], np.uint64))) == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 3), (None, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 4: 4, 5: 4}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(chain).agg(F.max("component")).first()[0] == 0
    assert connected_components(chain.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    x = [[float(v) for v in row] for row in rng.standard_normal((130, 9))]
    x[3], x[4], x[60], x[7] = None, [float("nan")] * 9, x[61], [1.0] * 4
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = topk.top_k(topk.quantised(df), F.col("vec_id") % 10 == 0, k=5, block=40, query_block=4).collect()
    fine = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in enumerate(x) if v is not None and len(v) == 9 and v[0] == v[0]}
    want = set()
    for q in (i for i in fine if i % 10 == 0):
        best = sorted((-int(fine[q] @ fine[i]), i) for i in fine if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") % 10 == 0).count() == 0
    few = topk.top_k(topk.quantised(df.where("vec_id in (0, 1, 2)")), F.col("vec_id") == 0)
    assert few.count() == 2


def test_embedding_dedup(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.standard_normal((400, 24))
    x[100:260] = x[100] + 0.05 * rng.standard_normal((160, 24))  # denser than a window
    x[300] = x[301]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [0.0] * 24), (402, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embed_dedup.near_dedup(df, window=32).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    assert [got[i]["n_links"] for i in range(400)] == links.sum(1).tolist()
    assert all(got[i]["component_id"] == 100 for i in range(100, 260)) and got[301]["component_id"] == 300
    assert got[400]["kept"] and got[401]["n_links"] == 0
    assert embed_dedup.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder_equals_whole_texts(name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tok.path(name))
    whole.encode_special_tokens = True
    rng = random.Random(5)
    pieces = ["a", "B", "é", "ß", "don't", "we'll", ".", "!!", "12", " ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "\x1c", "<|endoftext|>", "日本", "é", "́", "K", "İ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(3000)] + ["a\nb", "a\n\nb", "a\n\n\nb", "\n\na", "a\n\n", "x y z", " x", "x "]
    got = tokenise.WordEncoder(tok.path(name), most_bytes=20_000).encode(texts)
    for t, b in zip(texts, got):
        assert np.frombuffer(b, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_rans_blocks():
    rng = np.random.Generator(np.random.PCG64(6))
    for n in (0, 1, 63, 5000, 200_000):
        tokens = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
        ids, counts = np.unique(tokens, return_counts=True)
        table = token_codec.Table(ids, token_codec.scaled_frequencies(counts))
        assert not n or table.freq.sum() == 1 << token_codec.SCALE
        data = token_codec.pack_block([1, None], [n, 0], tokens, token_codec.Table.from_bytes(table.to_bytes()))
        docs, lengths, back = token_codec.unpack_block(data, table)
        assert docs == [1, None] and lengths.tolist() == [n, 0] and np.array_equal(back, tokens)
    broken = bytearray(data)
    broken[-2000] ^= 1
    try:
        assert not np.array_equal(token_codec.unpack_block(bytes(broken), table)[2], tokens)
    except ValueError as e:
        assert "damaged" in str(e)
    whole = table.to_bytes()
    with pytest.raises(ValueError, match="damaged frequency table"):
        token_codec.Table.from_bytes(whole[:20] + bytes([whole[20] ^ 1]) + whole[21:])


def test_token_shards_by_footer_alone_and_damage(spark, tmp_path):
    docs, rows = corpus(spark)
    folder = f"file://{tmp_path}"
    manifest = token_codec.write_tokens(docs, folder, tok.path("word_bpe_49k.json"), 2)
    want = {r["doc_id"]: bytes(r["tokens"]) for r in token_codec.read_tokens(spark, manifest, folder).collect()}
    table = token_codec.Table.from_bytes(next(tmp_path.glob("table-*.rans")).read_bytes())
    got = {}
    for row in manifest.select("file").distinct().collect():
        data = (tmp_path / row["file"]).read_bytes()
        for point in token_codec.read_footer(data):
            ids, lengths, tokens = token_codec.read_block(data, point, table)
            ends = np.cumsum(lengths)
            got |= {d: tokens[e - n : e].astype("<u4").tobytes() for d, e, n in zip(ids, ends, lengths)}
        with pytest.raises(ValueError, match="damaged block"):
            token_codec.read_block(data[:40] + bytes([data[40] ^ 1]) + data[41:], token_codec.read_footer(data)[0], table)
        with pytest.raises(ValueError, match="damaged footer"):
            token_codec.read_footer(data[:-20] + bytes([data[-20] ^ 1]) + data[-19:])
    assert got == want and len(got) == len(rows)
    file = manifest.first()["file"]
    data = (tmp_path / file).read_bytes()
    (tmp_path / file).write_bytes(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    with pytest.raises(Exception, match="damaged block"):
        token_codec.read_tokens(spark, manifest, folder).count()


def test_token_files(spark):
    from tokenizers import Tokenizer

    docs, rows = corpus(spark)
    whole = Tokenizer.from_file(tok.path("word_bpe_49k.json"))
    start, want = 0, []
    for i, t, *_ in rows:
        b = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(b), zlib.crc32(b.tobytes())))
        start += len(b)
    assert sorted(map(tuple, token_codec.round_trip(docs, tok.path("word_bpe_49k.json"), 2).collect())) == want
    assert token_codec.round_trip(empty(spark), tok.path("word_bpe_49k.json"), 2).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert token_codec.round_trip(odd, tok.path("word_bpe_49k.json"), 2).count() == 3


def brute_groups(rows):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def test_cells_bring_every_two_members_of_a_region_together_once(spark):
    rows = [(h, 9, 100 * h + i, 0, 7) for h, n in ((1, 23), (2, 5), (3, 4)) for i in range(n)]
    cells = {}
    for r in jaccard_join._cells(spark.createDataFrame(rows, "h long, n int, c long, pos int, g long"), 4).collect():
        cells.setdefault(r["h"], []).append((r["c"], r["side"]))
    met = [tuple(sorted((a, b))) for c in cells.values() for k, (a, x) in enumerate(c) for b, y in c[:k] if x == 0 or x != y]
    assert sorted(met) == sorted((a, b) for _, _, a, *_ in rows for _, _, b, *_ in rows if a < b and a // 100 == b // 100)
    assert max(map(len, cells.values())) < 23 and 3 in cells and 1 not in cells


@pytest.mark.parametrize("deep", [4096, 2])
def test_jaccard_groups(spark, deep, monkeypatch):
    monkeypatch.setattr(jaccard_join, "DEEP", deep)
    docs, rows = corpus(spark, 7, copies=40)
    assert sorted(map(tuple, jaccard_join.jaccard_groups(docs).collect())) == brute_groups(rows)
    assert jaccard_join.jaccard_groups(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (4, "A b")], "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.jaccard_groups(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, None), (3, 1, 3), (3, 1, 3), (4, 1, 3)], key=str)


def test_language_id(spark):
    rng = random.Random(8)
    sound = {"en": "the and ing tion sh th".split(), "de": "der ung sch ei ö ch".split()}
    rows = [(i, " ".join("".join(rng.choices(sound[lang], k=2)) for _ in range(20)), lang) for i, lang in enumerate(rng.choices(["en", "de"], k=200))]
    docs = spark.createDataFrame(rows + [(200, None, "en"), (201, "123 !", "de"), (202, "thing", None), (None, "sching", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i, *_ in rows)
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) / len(held) >= 0.95
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "und" and got[200]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(docs.limit(0)).count() == 0
    assert langid.identify(docs.where("doc_id = 200")).first()["lang_pred"] == "und"


def test_mixing(spark):
    docs, rows = corpus(spark, 9)
    got = mixing.mix_shares(docs).collect()
    assert len(got) == len(rows)
    size = {r["doc_id"]: r["size"] for r in got}
    assert all(size[i] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows)
    by = {}
    for r, row in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
        assert 0 <= r["taken"] <= 2 * r["size"]
        k = by.setdefault(row[3], [0, r["source_size"], r["target"]])
        k[0] += r["taken"]
    assert abs(sum(k[2] for k in by.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(abs(k[0] - k[2]) <= mixing.PACKET and k[2] <= 2 * k[1] + 1e-9 for k in by.values())
    assert abs(sum(k[0] for k in by.values()) - sum(k[2] for k in by.values())) <= 1
    assert sorted(map(tuple, mixing.mix_shares(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    mix = mixing.mix(docs).orderBy("position").collect()
    assert [r["finish"] for r in mix] == sorted(r["finish"] for r in mix)
    at = 0
    for r in mix:
        assert r["position"] == at
        at += r["words"]
    assert mixing.mix_shares(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_secret_scan(spark):
    texts = ["password = 'abcdef1' token:x secret=abcdefgh", "AKIA" + "A1" * 10 + " AKIAAKIA", "f" * 24 + " " + "0" * 23, None, "", "API_KEY=ſecret77 ToKeN=" + "9" * 30, "eyJab.eyJcd." + "z" * 30, "x" * 100_000 + "passwd:123456"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs).collect()}
    rules = secret_scan.BASE + secret_scan.ADDED
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in r.compiled().finditer(t or "") if m.end(r.group) - m.start(r.group) >= r.least)
        say = lambda xs: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in xs)
        assert got[i]["spans"] == say(spans)
        assert got[i]["base_sha256"] == hashlib.sha256(say([s for s in spans if s[1] < 3]).encode()).hexdigest()
    assert got[0]["n_assign"] == 2 and got[1]["n_access"] == 1 and got[2]["n_hex"] == 1
    assert secret_scan.trigram_query("[0-9a-f]+") is True
    assert secret_scan.trigrams_of(secret_scan.trigram_query("abc(de|fg)?h")) >= {"abc"}
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0
    out = docs.select("doc_id", secret_scan.redactor()("text").alias("t")).where("doc_id in (0, 3)").orderBy("doc_id").collect()
    assert out[0]["t"] == "<secret>' token:x <secret>" and out[1]["t"] is None


def test_url_filter(spark):
    rules = [url_filter.Rule(*r) for r in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"))]
    link = '<html><link href="{}" rel="x"><LINK rel="canonical" href="{}">'
    rows = [(0, "http://A.Example.com/en/8?x", ""), (1, "https://example.com/en/77", None), (2, "http://notcom/en/8", ""), (3, None, ""), (4, "no scheme", ""),
            (5, "http://q.org/1", link.format("/no", "http://x.net/de/1")), (6, "http://q.org/2#f", link.format("/no", "/1")), (7, "http://r.org/a", '<meta http-equiv="refresh" content="0; url=http://example.com/en/7">'), (8, "http://r.org/b", link.format("", "http://r.org/a")), (9, "http://r.org/b", link.format("", "http://x.net/de/2")), (10, "http://com", "")]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got[0] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[1] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[2][2:] == (None, "allow") and got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5][3] == got[6][3] == "block"
    assert got[7][3] == got[8][3] == got[9][3] == "allow"
    assert got[10] == ("com", "", None, "allow")


def test_url_filter_takes_every_tag_and_odd_rows(spark):
    rules = [url_filter.Rule("block", "bad.net", "/x")]
    two = '<link rel="alternate canonical" href="/one"><link rel=canonical href="//bad.net/x1"><meta http-equiv=refresh content="0;url=sub/two">'
    rows = [(1, "http://a.org/d/p", two), (1, "http://a.org/d/p", two), (None, "http://a.org/one", ""), (2, "http://a.org/d/sub/two", "x" * 300_000), (3, "http://a.org/other", ""), (4, "http://a.org/d/q", '<link rel="canonical" href="?b"><link rel="canonical" href="mailto:x"><link rel="canonical" href="#y">'), (5, "http://a.org/d/q?b", '<link rel="canonical" href="/one">')]
    df = spark.createDataFrame([(*r, "h", "k") for r in rows], "page_id long, url string, html string, host string, key string")
    got = sorted(((r["page_id"] or 0, r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()))
    assert got == [(0, "block"), (1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "block")]


def test_packing(spark):
    from tokenizers import Tokenizer

    docs, rows = corpus(spark)
    whole = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    got = packing.pack(docs, tok.path("byte_bpe_50k.json"), 0).collect()
    pieces, fill = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t, *_ in rows:
        b = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(b) and r["ids_crc32"] == zlib.crc32(b[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(b)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(fill) == list(range(len(fill)))
    assert packing.pack(empty(spark), tok.path("byte_bpe_50k.json"), 0).count() == 0
    assert packing.shortest_pack_first({6: 2, 4: 3, 2: 1}, 10) == [((6, 4), 2), ((4, 2), 1)]


def test_lm_learns_word_order(spark):
    rng = random.Random(3)
    follow = {w: rng.sample(WORDS, 2) for w in WORDS}

    def walk():
        w = [rng.choice(WORDS)]
        while len(w) < 200:
            w.append(rng.choice(follow[w[-1]]))
        return w

    texts = [walk() for _ in range(400)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(i + 1000, " ".join(rng.sample(t, len(t)))) for i, t in enumerate(texts[:5])] + [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    assert all(got[i]["mean_log_prob"] > got[i + 1000]["mean_log_prob"] for i in range(5))
    assert got[5000]["n_words"] == 0 and got[5000]["log_prob"] == 0 and len(got) == len(rows)
    assert lm_score.score(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs, rows = corpus(spark, 11, copies=5)
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 2, F.concat("text", F.lit(" token=abcdefgh12"))).otherwise(F.col("text")))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    steps = {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, "").persist()
        steps[name] = docs.collect()
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = {r["doc_id"] for r in steps["language_id"]}
    assert not first & {i for i, t in texts.items() if not re.search(r"[^\W\d_]", t or "")}
    left = [(i, texts[i]) for i in sorted(first)]
    assert {r["doc_id"] for r in steps["near_duplicates"]} == {i for i, _, c in brute_groups(left) if i == c}
    assert len(steps["secrets"]) == len(steps["near_duplicates"])
    assert [r["text"] for r in steps["secrets"] if r["doc_id"] == 2] in ([texts[2].replace("token=abcdefgh12", "<secret>")], [])
    taken = {r["doc_id"]: -(-r["taken"] // max(1, r["size"])) for r in mixing.mix_shares(spark.createDataFrame(steps["secrets"], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    times = {}
    for r in steps["mixture"]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {i: n for i, n in taken.items() if n}
    assert sum(r["start"] == 0 for r in steps["packing"]) == len(steps["mixture"])
    nothing = empty(spark)
    for _, stage in p.STAGES:
        nothing = stage(spark, nothing, "")
    assert nothing.count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library_on_odd_texts(name):
    draw = random.Random(3)
    parts = ["a", "B", "é", "1", "'s", "x.", " ", "  ", "\n", "\n\n", "\t", "\x00", "\x1c", "Ġ", "\xa0", "​", "᠎", "<|endoftext|>", "日本", "-"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(3000)] + [None, "", "word " * 5000 + "end"]
    mine = tokenise.WordEncoder(tok.path(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in mine.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [b for t in texts for b in mine.encode([t])] == want
    assert mine.encode(texts) == want


@pytest.mark.parametrize("n", [2000, 12000])
def test_embedding_links_are_those_of_brute_force_in_a_cluster_below_the_threshold(n):
    rng = np.random.Generator(np.random.PCG64(12))
    x = rng.standard_normal((n, 64)) + 2 * rng.standard_normal(64)  # mutual cosine about 0.8
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((200, 64))
    side -= (side * unit[:200]).sum(1, keepdims=True) * unit[:200]
    x[-200:] = 0.902 * unit[:200] + np.sqrt(1 - 0.902**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(i), int(j)) for lo in range(0, n, 500) for i, j in zip(*np.nonzero(unit[lo : lo + 500] @ unit.T >= 0.9)) for i in [i + lo] if i < j}
    ids, half = np.arange(n), n // 2
    one, two = (ids[:half], x[:half]), (ids[half:], x[half:])
    got = [embed_dedup.links((ids, x), None, 0.9)]
    assert len(got[0][0]) == len(want) and set(zip(*map(np.ndarray.tolist, got[0]))) == want
    parts = [embed_dedup.links(one, None, 0.9), embed_dedup.links(one, two, 0.9), embed_dedup.links(two, None, 0.9)]
    assert {p for a, b in parts for p in zip(a.tolist(), b.tolist())} == want


def test_embedding_links_between_blocks(spark):
    rng = np.random.Generator(np.random.PCG64(13))
    x = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.6)) if i < j}
    links = {i: {b for a, b in want if a == i} | {a for a, b in want if b == i} for i in range(300)}
    got = {r["vec_id"]: r for r in embed_dedup.near_dedup(df.withColumnRenamed("v", "embedding"), least=0.6, window=16, block=40).collect()}
    assert all(got[i]["n_links"] == len(links[i]) for i in range(300))
    component = {i: i for i in range(300)}
    while any(component[a] != component[b] for a, b in want):
        for a, b in want:
            component[a] = component[b] = min(component[a], component[b])
    assert {i: r["component_id"] for i, r in got.items()} == component


def test_embedding_links_of_copies_and_odd_rows(spark):
    base = [1.0, 0.0, 0.5]
    rows = [(k, base) for k in range(40)] + [(40, [1.0, 0.01, 0.5]), (41, [-1.0, 0.0, 0.0]), (41, [-1.0, 0.0, 0.0]), (42, []), (None, base), (43, base[:2]), (44, [None, 1.0, 1.0]), (45, None)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, component int")
    got = [tuple(r) for r in embed_dedup.near_dedup(df).collect()]
    want = [(k, 40, 0, k == 0) for k in range(40)] + [(40, 40, 0, False), (41, 0, 41, True), (41, 0, 41, True)] + [(k, 0, k, True) for k in (42, 43, 44, 45)]
    assert sorted(got) == sorted(want)


def test_top_k_of_repeats_large_values_and_clashing_names(spark):
    v = [[1.0, 1.0], [1.0, 0.5], [0.5, 0.5], [0.25, 0.25], [0.2, 0.1], [0.1, 0.1], [0.0, 0.1]]
    rows = [(k, x) for k, x in enumerate(v)] + [(0, v[0]), (3, v[3])]
    df = spark.createDataFrame([(i, x, 9, "s") for i, x in rows], "vec_id long, embedding array<double>, row int, d string")
    got = sorted(map(tuple, topk.top_k(topk.quantised(df), F.col("vec_id") == 0, k=5).collect()))
    fine = [[int(np.floor(256 * c)) for c in x] for x in v]
    want = sorted((-256 * sum(fine[i]), i) for i in range(1, 7))[:5]
    assert got == [(0, r + 1, i, -s) for r, (s, i) in enumerate(want)]
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [1.0, 3.0]), (3, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(topk.top_k(topk.quantised(huge), F.col("vec_id") == 0, k=5).collect(), key=lambda r: r["rank"])
    # ranked by their true scores; what 64 bits do not hold stops at their ends
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63))]


def test_top_k_cuts_no_component(spark):
    """Components far above sqrt(2**62 / d), in queries and rows, beside ordinary ones; null ids take no part."""
    rng = np.random.Generator(np.random.PCG64(17))
    x = rng.standard_normal((90, 64))
    x[:, 0] = 1
    x[5:30, 0] = [3e6, 2e7, 9e7, -9e7, 2e12] * 5
    x[40, 1], x[0, 2] = 5e14, 7e13
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(None, [9e9] * 64), (31, [float(c) for c in x[6]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if i is not None]
    got = sorted(map(tuple, topk.top_k(topk.quantised(df), F.col("vec_id") % 10 == 0, k=5, block=40, query_block=4).collect()))
    want = []
    for q, v in (f for f in fine if f[0] % 10 == 0):
        best = {}
        for i, w in fine:
            if i != q:
                best[i] = max(best.get(i, -(10**99)), sum(a * b for a, b in zip(v, w)))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:5])]
    assert got == sorted((q, r, i, min(max(s, -(2**63)), 2**63 - 1)) for q, r, i, s in want)


def test_embedding_links_of_huge_and_tiny_doubles(spark):
    x = [[1e200, 1e199], [1e200, 2e199], [1e-200, 1e-201], [3e-320, 0.0], [1.0, 0.1], [0.0, 1e308]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_dedup(df).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {5: (0, 5)}


def test_url_hosts_of_very_many_labels(spark):
    rules = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("block", "a.b.net", "")]
    long = "x." * 200_000
    urls = [f"http://{long}example.com/en/7", f"http://{long}com/en/1", f"http://{long}b.net/", f"http://{long}a.b.net/", "http://b.net/", None, "no scheme", "no scheme"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: (None, "allow"), 3: ("a.b.net", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow")}


def test_url_rules_of_a_table_equal_those_of_a_list(spark):
    rng = random.Random(6)
    names, words = ["com", "net", "a.com", "b.a.com", "x.net", "org", "co.uk"], ["/", "/en/", "/en/7", "/de", "", "/en/7/x"]
    rules = [url_filter.Rule(rng.choice(["block", "allow"]), h, p) for h in names for p in rng.sample(words, 3)] + [url_filter.Rule("allow", "com", "/en/"), url_filter.Rule("block", "com", "/en/")]
    link = '<link rel="canonical" href="http://{}{}">'
    host, path = lambda: rng.choice(["", "w.", "w.v."]) + rng.choice(names + ["info"]), lambda: rng.choice(words) + rng.choice(["", "8", "?q", "#f"])
    rows = [(i, f"http://{host()}{path()}", link.format(host(), path()) if i % 3 else None) for i in range(200)] + [(200, None, None), (201, "no scheme", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    as_table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules] + [("block", None, "/")], "verdict string, host string, path string")
    want = sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()))
    assert sorted(map(tuple, url_filter.judge_urls(pages, as_table).collect())) == want and {r[4] for r in want} == {"allow", "block"}
    none = sorted(map(tuple, url_filter.judge_urls(pages, as_table.limit(0)).collect()))
    assert none == sorted(map(tuple, url_filter.judge_urls(pages, []).collect())) and all(r[3:] == (None, "allow") for r in none)


def test_words_of_many_letters_hash_apart(spark):
    one = "a"
    while len(one) < 1024:
        one += one.translate({97: 98, 98: 97})
    other = one.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, one), (2, other), (3, other.upper()), (4, one * 100), (5, other * 100)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}


def test_lm_tells_words_of_a_shared_class_apart(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(6000)]
    weight = [1 / (k + 1) for k in range(6000)]
    rows = [(i, " ".join(rng.choices(words, weight, k=300))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"junk{i}x{k}" for k in range(60))) for i in range(5)] + [(2000 + i, " ".join(f"w{rng.randrange(700, 890)}" for _ in range(60))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.score(docs).collect()}
    assert max(got[1000 + i] for i in range(5)) < min(got[2000 + i] for i in range(5)) < max(got[i] for i in range(300))
    for common in (0, 2000):  # where shares come from does not matter
        monkeypatch.setattr(lm_score, "COMMON", common)
        again = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.score(docs).collect()}
        assert all(abs(again[i] - got[i]) < 1e-3 for i in got)


def test_lm_shares_and_unseen_words_fill_a_class():
    words = np.arange(1, 5001, dtype=np.uint64)
    n = np.arange(1, 5001)
    v = lm_score.Vocabulary(words[:0])
    np.add.at(v.totals, v.classes(words), n)
    v.keep_common(words, n)
    share, known = v.common_shares(words)
    assert known.all() and not v.common_shares(words + np.uint64(9000))[1].any()
    sums = np.bincount(v.classes(words), np.exp(share), lm_score.VOCABULARY)[lm_score.OWN : -1]
    assert np.allclose(sums, 1 - 1 / (v.totals[lm_score.OWN : -1] + 1))


def test_lm_trains_on_every_position_once(monkeypatch):
    seen = []
    monkeypatch.setattr(lm_score.Network, "step", lambda self, x, y, rate: seen.append((list(zip(*map(list, x), y)), rate)))
    monkeypatch.setattr(lm_score, "PIECE_WORDS", 700)
    texts = ["a b c", None, " ".join(f"w{k}" for k in range(5000)), "d"]
    v = lm_score.Vocabulary(np.empty(0, np.uint64))
    out = pa.Table.from_batches(lm_score._coded(iter([pa.record_batch({"key": np.arange(4), "text": pa.array(texts)})]), v, 1))
    parts = lm_score._train(out, lm_score.Network().p, 1 << 12)
    want = []
    for _, words in words_by_row(pa.array(texts)):
        c = [lm_score.VOCABULARY - 1] * 2 + v.classes(words).tolist() + [lm_score.VOCABULARY - 1] * 2
        want += [(*c[i - 2 : i], *c[i + 1 : i + 3], c[i]) for i in range(2, len(c) - 2)]
    assert sorted(t for b, _ in seen for t in b) == sorted(want) and max(len(b) for b, _ in seen) == lm_score.BATCH
    assert all(rate == lm_score.RATE * len(b) / lm_score.BATCH for b, rate in seen) and set(parts["n"].to_pylist()) == {5004.0}


def test_lm_scores_equal_brute_force_and_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_WORDS", 600)
    monkeypatch.setattr(lm_score, "COMMON", 40)
    docs, rows = corpus(spark, 5)
    got = [sorted((r["doc_id"], r["n_words"], round(r["log_prob"], 6)) for r in lm_score.score(docs.repartition(n)).collect()) for n in (2, 9)]
    assert got[0] == got[1]
    vocabulary, p, counts = lm_score.fit(docs.select("doc_id", "text"))
    net, count = lm_score.Network(p), {r["h"] % 2**64: r["n"] for r in counts.collect()}
    for (i, text, *_), (j, n, said) in zip(rows, got[0]):
        words = next(iter(words_by_row(pa.array([text]))))[1]
        c = [lm_score.VOCABULARY - 1] * 2 + vocabulary.classes(words).tolist() + [lm_score.VOCABULARY - 1] * 2
        total = 0.0
        for at, word in enumerate(words.tolist(), 2):
            h = np.tanh(sum(net.embed[k, c[at + d]].astype(float) for k, d in enumerate((-2, -1, 1, 2))))
            group, inner = divmod(c[at], lm_score.GROUPS)
            for x, k in ((h @ net.w1 + net.b1, group), (h @ net.w2[group] + net.b2[group], inner)):
                total += x[k] - np.log(np.exp(x).sum())
            if c[at] >= lm_score.OWN:
                total += np.log(count[word] / (sum(m for w, m in count.items() if vocabulary.classes(np.array([w], np.uint64))[0] == c[at]) + 1))
        assert i == j and n == len(words) and abs(total - said) < 1e-3 * max(1, n)


def test_language_id_equals_plain_python(spark):
    """Prediction recomputed from the fitted centroids with dictionaries of trigrams; every language is learned."""
    rng = random.Random(21)
    names = [f"l{k:03d}" for k in range(30)]
    sound = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü", k=3)) for _ in range(6)] for n in names}
    rows = [(i, " ".join(rng.choices(sound[n], k=30)), n) for i, n in enumerate(names * 12)]
    docs = spark.createDataFrame([(*r, 1.0, "und") for r in rows + [(900, "x" * 200_000 + " " + rows[0][1], None), (0, rows[0][1], "l000")]], "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.fit(docs)
    assert model.languages == names
    got = langid.identify(docs).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] not in texts:
            continue
        padded = " " + texts[r["doc_id"]] + " "
        x = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            if b.isalpha():
                h = sum((ord(ch.lower()) + 1 if ch.isalpha() else 0) * m for ch, m in zip((a, b, c), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))) % 2**64
                h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) % 2**64 >> 52
                x[h] += 1
        x = np.where(x > 0, (1 + np.log(np.maximum(x, 1))) * model.idf, 0)
        cos = model.centroids @ (x / np.linalg.norm(x))
        assert r["lang_pred"] == model.languages[model.owner[cos.argmax()]] and abs(r["score"] - cos.max()) < 1e-5
    assert len(got) == len(rows) + 2


def test_packing_takes_the_shortest_pack():
    assert sorted(packing.shortest_pack_first({7: 1, 6: 1, 5: 1, 3: 1}, 10)) == [((5, 3), 1), ((6,), 1), ((7,), 1)]


def test_language_id_rejects_gibberish_and_an_unlearned_language(spark):
    rng = random.Random(8)
    sound = {"en": "the and ing tion sh th er on".split(), "de": "der ung sch ei ö ch en ge".split(), "fi": "kk ää yö ll uu ij hy vä".split()}
    say = lambda lang, n: " ".join("".join(rng.choices(sound[lang], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(lang, rng.choice([1, 3, 10, 40, 200])), lang) for i, lang in enumerate(rng.choices(["en", "de"], k=600))]
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)) for n in (100, 400, 2000) for _ in range(30)]
    odd += ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)) for n in (100, 400, 2000) for _ in range(30)]
    odd += [say("fi", n) for n in (20, 80, 300) for _ in range(30)]
    odd += ["".join(rng.choice("theandigsorucö   ") for _ in range(n)) for n in (400, 2000) for _ in range(30)]  # of learned letters
    docs = spark.createDataFrame(rows + [(10_000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(got[10_000 + i]["rejected"] for i in range(len(odd)))
    assert sum(got[i]["rejected"] for i, *_ in rows) <= 0.02 * len(rows)


def test_pipeline_run_equals_its_stages_and_brute_force(spark, tmp_path):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs, rows = corpus(spark, 12, copies=6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, f"file://{tmp_path}").collect()
    whole, texts = Tokenizer.from_file(tok.path("byte_bpe_50k.json")), {i: t for i, t, *_ in rows}
    letters = [(i, t) for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)]
    first = {i for i, _, c in brute_groups(letters) if i == c}
    pieces, fill = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) <= first and len(pieces) > len(first) / 2
    for i, parts in pieces.items():
        ids = np.array(whole.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        want = [(a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024)]
        times = sum(a == 0 for a, *_ in parts)
        assert times in (1, 2) and sorted(parts) == sorted(want * times)
    for parts in fill.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024


def test_url_query_has_the_words_of_its_contract(spark, tmp_path):
    from vecspark.llm import queries

    urls = ["http://a.com/en/1", "http://www.example.com/en/7", "http://example.net/de/1", "http://w.example.net/de/81", "http://a.org/es/", "http://q.org/1"]
    rows = [(i, u, '<link rel="canonical" href="http://x.net/de/1">' if i == 5 else "") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op9_url_filter(spark, f"file://{tmp_path}").collect()}
    assert got == {0: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("org/es/", "block"), 5: (None, "allow")}
