"""Edge cases and brute-force twins of the text operators."""

import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer, models, pre_tokenizers

from facsimile.llm import decontam, embed_dedup, html_extract, langid, lm, packing, simhash, token_count, token_files, toxicity
from facsimile.llm.components import connected_components
from facsimile.llm.encode import WordEncoder
from facsimile.session import scratch_path

BPE = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977} the" for i in range(40_000))
TEXTS = [None, "", "  \n", "one", "One two", "the cat sat on the mat. The dog, too!", "the cat sat on the mat. The dog, too!",
         "ÉCOLE école İ ﬁ 3.5 a.b ...", LONG, "<|endoftext|> it's\x1cx\x85y"]


def frame(spark, texts, extra=""):
    """documents with null ids, repeated rows and columns whose names clash with outputs."""
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, score double")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(5, 40), (100, 99), (99, 100), (7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 5 for i in range(10, 41)}, 100: 99}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_simhash_links_by_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 40).tolist()
    fps = {0, *base}
    for b in base[:20]:
        for _ in range(4):
            x = b
            for _ in range(int(rng.integers(1, 5))):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits)
    got = dict(connected_components(links).collect())
    top = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                old, new = top[i], top[j]
                top = [new if t == old else t for t in top]
    groups = {}
    for s, t in zip(signed, top):
        groups.setdefault(t, set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_simhash_edges(spark):
    got = {r[0]: r for r in simhash.near_duplicates(frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i]["fingerprint"] == f"{brute_fingerprint(t):016x}"
    assert got[0]["component_id"] == got[1]["component_id"] == got[2]["component_id"] == 0
    assert got[6]["component_id"] == 5
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.fingerprint(LONG) == brute_fingerprint(LONG)


def test_word_encoder_is_the_plain_call():
    enc = WordEncoder(BPE)
    more = ["a., b., 3. ²., <|endoftext|>. x'. 's. Σ, .", " .", ",. .", "é́.", "ab" * 500, "  a b"]
    assert all(enc.check(t) for t in [*TEXTS[1:], *more])


def test_token_files_round_trip(spark):
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 40_000):
        ids = rng.integers(0, 49_408, n).astype("<u4")
        assert token_files.unpack_ids(token_files.pack_ids(ids, 1 << 10)).tolist() == ids.tolist()
    big = np.array([0, 1 << 31, (1 << 32) - 1], "<u4")
    assert token_files.unpack_ids(token_files.pack_ids(big)).tolist() == big.tolist()
    docs = frame(spark, TEXTS).union(frame(spark, TEXTS[:1]))
    path = scratch_path(spark, "t")
    token_files.write_ids(docs, path, BPE, 2)
    got = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: (r["id"], r["start"]))
    plain, at = Tokenizer.from_file(BPE), 0
    for r, (i, t) in zip(got, [(0, None), *enumerate(TEXTS)], strict=True):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
        assert ids == [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        at += len(ids)
    path = scratch_path(spark, "t")
    token_files.write_ids(empty(spark), path, BPE, 2)
    assert token_files.read_ids(spark, path).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps, bins = [], 0
    for a in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= a]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - a)
        else:
            bins += 1
            gaps.append(capacity - a)
    return bins


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 65, 500), rng.integers(33, 65, 50), np.full(77, 64), np.ones(1000, int), [64, 32, 32, 20, 20, 24]):
        counts = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
        plan = packing.plan(counts, 64)
        used = {}
        for times, pattern in plan:
            assert sum(pattern) <= 64
            for a in pattern:
                used[a] = used.get(a, 0) + times
        assert used == counts
        assert sum(t for t, _ in plan) <= best_fit_decreasing(lengths, 64) + 1
    assert packing.plan({}, 64) == []
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def test_packing(spark):
    docs = frame(spark, TEXTS * 3)
    placed = packing.pack(docs, BPE, 1, 512)
    rows = placed.collect()
    assert {r["id"] for r in rows} == set(range(len(TEXTS) * 3))
    full = {(r["sequence_id"], r["n_tokens"]): np.frombuffer(r["ids"], "<u4") for r in
            packing.sequences(placed, packing.pieces(docs, BPE, 1, 512)).collect()}
    assert all(n == len(ids) <= 512 for (_, n), ids in full.items())
    whole = {s: ids for (s, _), ids in full.items()}
    plain = Tokenizer.from_file(BPE)
    coded = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in TEXTS]
    for r in rows:
        ids = coded[r["id"] % len(TEXTS)][r["start"]:r["start"] + r["length"]]
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]].tolist() == ids.tolist()
        assert r["crc"] == zlib.crc32(ids.tobytes())
    assert packing.pack(empty(spark), BPE, 1, 512).count() == 0


def test_token_counts_match_the_library(spark):
    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("▁ab", -4.0), ("ba", -1.5), ("c", -9.0), ("bab", -2.5)]
    hf = Tokenizer(models.Unigram(pieces, 0, False))
    hf.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace("▁", "always")])
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcxy ab"), rng.integers(0, 60))) for _ in range(200)] + [None, "", " ", "xyx", "ab" * 3000]
    vocab = token_count.Vocabulary(tuple(pieces))
    got = {r[0]: r[1] for r in token_count.count_tokens(frame(spark, texts), vocab).collect()}
    assert got == {i: len(hf.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert token_count.count_tokens(empty(spark), vocab).count() == 0
    none = token_count.count_tokens(frame(spark, ["ab c"]), token_count.Vocabulary(())).first()
    assert none["n_tokens"] == 2


def test_token_counts_of_a_file_with_byte_pieces(spark):
    import sentencepiece
    from tokenizers import normalizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    hf = Tokenizer(models.Unigram(pieces, 0, True))
    hf.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rng = np.random.default_rng(6)
    parts = ["the ", "cat", " ", "  ", "    ", "\n", "\n\n", "\t", "\r\n", "🤖", "𓀀𓀁", "中文", "def f(x):", "ing", "▁", "É", "x\x00"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(200)] + [
        None, "", " ", "\n", "  a", "a  ", "a\nb", "a  b", "🤖🦾", "𓀀" * 20, "the cat\n    return x\n" * 300]
    got = {r[0]: r[1] for r in token_count.count_tokens(frame(spark, texts), token_count.Vocabulary.from_sentencepiece(path)).collect()}
    assert got == {i: len(hf.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert [got[i] for i in range(206, 210)] == [3, 3, 9, 81]


def test_decontamination_by_brute_force(spark):
    rng = np.random.default_rng(7)
    word = lambda: f"v{rng.integers(0, 30)}"
    items = [" ".join(word() for _ in range(n)) for n in (3, 1, 7, 9, 10, 14, 30, 12)] + ["", None, "..."]
    items.append(items[6])
    docs = [None, "", "...", LONG, items[6], items[6].upper().replace(" ", ", "), "x " + items[3] + " y " + items[0]]
    for _ in range(150):
        ws = [word() for _ in range(int(rng.integers(0, 80)))]
        src = (items[int(rng.integers(0, 8))]).split()
        a = int(rng.integers(0, len(src)))
        at = int(rng.integers(0, len(ws) + 1))
        docs.append(" ".join(ws[:at] + src[a:a + int(rng.integers(1, 16))] + ws[at:]))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in enumerate(items):
        ws = find(t)
        n = min(10, len(ws))
        for p in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[p:p + n]), set()).add(str(i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r[0]: r for r in decontam.contamination(frame(spark, docs), bench).collect()}
    assert len(got) == len(docs)
    for i, t in enumerate(docs):
        ws, hit, ids = find(t), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(ws) - n + 1):
                if (own := windows.get(tuple(ws[p:p + n]))) is not None:
                    hit.update(range(p, p + n))
                    ids |= own
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(ws), len(hit), len(ids)), (i, t)
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert got[i]["contaminated"] == bool(hit)
    twice = frame(spark, docs[4:6]).union(frame(spark, docs[4:6]))
    assert decontam.contamination(twice, bench).count() == 4
    assert decontam.contamination(frame(spark, docs[:5]), bench.limit(0)).where("n_hit = 0").count() == 5
    assert decontam.contamination(empty(spark), bench).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 24))
    near = np.concatenate([base[:60] + 0.05 * rng.normal(size=(60, 24)), base[:30] + 0.08 * rng.normal(size=(30, 24)), base[:5]])
    x = np.concatenate([base, near])
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, "x"), (n + 1, [0.0] * 24, "x"), (n + 2, [0.0] * 24, "x"), (n + 3, [1.0, None] * 12, "x"), (n + 4, [float("nan")] * 24, "x"),
             (n + 5, [1.0, 2.0], "x"), (n + 6, (1e200 * x[0]).tolist(), "x"), (n + 7, [float("inf")] * 24, "x"), (n + 8, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")
    got = {r[0]: r for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    u = np.concatenate([u, u[:1]])
    ids = [*range(n), n + 6]
    linked = u @ u.T >= 0.95
    found = sum(got[i]["n_links"] for i in ids)
    assert 0.9 * (linked.sum() - len(ids)) <= found <= linked.sum() - len(ids)
    assert all(got[i]["n_links"] <= linked[k].sum() - 1 for k, i in enumerate(ids))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(n, n + 9) if i != n + 6)
    assert got[n + 6]["component_id"] == 0 and got[n - 1]["component_id"] == 4
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_several_lengths_match_sql(spark):
    import duckdb

    from facsimile.llm.queries import _SQL_OP6
    rng = np.random.default_rng(13)
    rows = []
    for dims, n in ((24, 120), (16, 60), (3, 1)):       # far-off vectors, exact copies and scaled copies of each length
        base = rng.normal(size=(n, dims))
        rows += [*base, *base[:n // 3 + 1], *(3 * base[n // 4:n // 2]), *(base[:5] + 1e-3 * rng.normal(size=(min(n, 5), dims)))]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)), rows)] + [(1000, None), (1001, [0.0] * 16), (1002, [0.0] * 16), (1003, [2.0] * 5)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    cols = "vec_id, n_links, component_id, kept"
    want = sorted(con.sql(f"SELECT {cols} FROM ({_SQL_OP6})").fetchall())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(df).selectExpr(*cols.split(", ")).collect())
    assert got == want
    linked = {len(v or []) for i, v in rows for r in got if r[0] == i and r[1] > 0}
    assert linked == {24, 16, 3}
    copies = spark.createDataFrame([(2, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in embed_dedup.near_duplicates(copies).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


PAGE = ("<html><head><title>t</title><script>var a='</p>';</script></head><body class='has-sidebar'><nav><ul><li><a href='/'>Home</a></ul></nav>"
        "<div class=\"ad\">buy one of these now and here</div><article><h1>Big  <b>ne</b>ws</h1><p>First &amp; best &lt;tag&gt;&nbsp;x.<br>Then"
        "<p>Second one here, with words.</p><aside>see also</aside><form><p>your mail</p></form><section id='comments'><p>nice one there</p></section>"
        "<p>End.</p></article><footer>&copy; some site with a long line of legal words at the end</footer></body></html>")


def test_html(spark):
    pages = [(i, PAGE.replace("First", f"First{i}"), "keep") for i in range(5)] + [
        (5, None, "keep"), (6, "", "keep"), (7, "plain words only", "keep"), (8, "<p>never closed", "keep"), (9, "<" * 1000, "keep"),
        (10, "<p>" + "word " * 50_000 + "</p>", "keep"), (11, "<!-- " + PAGE, "keep")]
    df = spark.createDataFrame(pages, "page_id long, html string, n_chars string")
    model = html_extract.fit(df)
    got = {r["page_id"]: r for r in html_extract.extract(df, model).collect()}
    for i in range(5):
        assert got[i]["text"] == f"Big news First{i} & best <tag> x. Then Second one here, with words. End."
    assert [got[i]["text"] for i in (5, 6, 7, 8, 11)] == ["", "", "plain words only", "never closed", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[10]["n_chars"] == 249_999
    assert html_extract.extract(df.limit(0), html_extract.fit(df.limit(0))).count() == 0
    assert html_extract.best_region([-1, 3, -1, 2, -9, 4]) in [(1, 4)]


@pytest.mark.parametrize("holder", ["<form id=aspnetForm>", "<div class='layout has-sidebar'>", "<div class='page with-nav'>",
                                    "<div id='search-results-page'>", "<div class='sidebar'>"])
def test_html_keeps_what_holds_the_article(spark, holder):
    end = f"</{holder[1:5].strip()}>"
    body, text = [], []
    for k, name in enumerate(("search-algorithms", "related-work", "social-history", "plain")):
        line = " ".join(f"{name[:3]}word{k}x{i}" for i in range(30))
        body.append(f"<section id='{name}'><p>{line}</p></section>")
        text.append(line)
    advert = f"<div data-x='{'y ' * 2000}' class='advert'><p>{'buy now ' * 40}</p></div>"
    side = f"<div data-props='class=plain' class='sidebar'><p>{'more to read ' * 5}</p></div>"
    page = f"<html><body>{holder}<nav>Home</nav>{side}<article><h1>Big news of the day</h1>{''.join(body[:2])}{advert}{''.join(body[2:])}</article>{side}{end}</body></html>"
    bare = f"<html><body>{holder}<p>{text[0]}</p><p>{text[1]}</p>{end}<footer>one two</footer></body></html>"
    df = spark.createDataFrame([(0, page), (1, bare), (2, page)], "page_id long, html string")
    for model in (html_extract.fit(df), html_extract.ExtractModel()):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df, model).collect()}
        assert got[0] == got[2] == " ".join(["Big news of the day", *text])
        assert got[1] == " ".join(text[:2])


def test_html_of_given_pages(spark, tables):
    pages = tables("pages")
    got = html_extract.extract(pages, html_extract.fit(pages)).toPandas().set_index("page_id")["text"]
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        inside = re.sub("<[^>]*>", "", re.sub(r"</?(p|br|h1)>", " ", inside))
        assert got[r["page_id"]] == " ".join(html.unescape(inside).split())


def test_language_id(spark, tables):
    docs = tables("documents", "/root/testdata/sf0.01")
    from facsimile.llm.queries import op1_language_id
    got = op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.rejected.mean() < 0.01
    assert got.score.between(0, 1).all()
    model = langid.fit(docs)
    odd = frame(spark, [None, "", "123 !!", LONG])
    rows = langid.predict(odd, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and all(r["rejected"] and r["score"] == 0 for r in rows[:3])
    assert rows[0]["component_id"] == "x"
    _, _, rejected = model.predict(["这是一个完全不同的语言的文本，没有出现过。" * 20])
    assert rejected[0]
    none = langid.fit(empty(spark))
    assert langid.predict(odd, none).where("lang_pred = 'und' and rejected").count() == 4
    assert langid.predict(empty(spark), model).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}x" for i in range(200)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(600)]
    y = [int(i % 5 == 0) for i in range(600)]
    texts = [t + (" idiot women" if bad else (" women" if i % 40 == 1 else "")) for i, (t, bad) in enumerate(zip(texts, y))]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(y)] + [(None, 1), (10_000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.predict(docs, model).orderBy("doc_id").collect()
    assert sum((r["score"] >= 0.5) == bool(b) for r, b in zip(got, y)) >= 595
    # a mention of a group says nothing by itself, although most mentions here are toxic
    a, b = model.score("word1x women word2x"), model.score("word1x men word2x")
    assert a < 0.5 and abs(a - b) < 0.05
    odd = toxicity.predict(frame(spark, [None, "", LONG]), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd)
    for lab in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.predict(docs, toxicity.fit(docs, lab)).where("score > 0.01").count() == 0
    assert toxicity.predict(empty(spark), model).count() == 0


def test_toxicity_reads_whole_words(spark):
    """Words that differ after the sixth letter, and toxic ones late in a clause without spaces, differ in score."""
    rng = np.random.default_rng(8)
    words, signs = [f"word{i}x" for i in range(100)], [chr(0x4E00 + i) for i in range(300)]
    texts, y = [], []
    for i in range(600):
        bad = i % 3 == 0
        if i % 2:
            texts.append(" ".join([*rng.choice(words, 20), "motherfucker" if bad else str(rng.choice(["motherland", "motherboard"]))]))
        else:
            texts.append("".join(rng.choice(signs, 30)) + ("傻逼" if bad else "") + "".join(rng.choice(signs, 10)))
        y.append(int(bad))
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))
    assert model.score("word1x motherfucker") > 0.5 > max(model.score("word1x motherland"), model.score("word1x motherboard"))
    clause = "".join(rng.choice(signs, 40))
    assert model.score(clause + "傻逼" + clause) > 0.5 > model.score(clause + clause)
    assert model.score("word1x youmotherfuckers") > model.score("word1x yourmotherlands")


def test_toxicity_swaps_take_both_labels(spark, monkeypatch):
    """With more swapped sentences than are used, those of toxic rows are among them."""
    texts = [f"some women say word{i % 50}x" + (" idiot" if i % 2 else "") for i in range(200)]
    seen = {}

    def spy(x_at, x_val, y, swaps, size, p):
        seen["swaps"] = swaps
        return np.zeros(size), 0.0

    monkeypatch.setattr(toxicity, "_train", spy)
    texts = [t + (" muslims" if i % 2 else "") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, texts), labels, toxicity.ToxicParams(swaps=40))
    muslims = [d[model.index["muslims"]] != 0 for i, d in seen["swaps"] if i >= 0]      # toxic rows alone name them
    assert len(muslims) == 40 and 8 <= sum(muslims) <= 32


def test_language_model(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "mat", f"w{rng.integers(0, 50)}"], rng.integers(1, 40))), i % 7 == 2) for i in range(300)]
    docs += [(300, None, False), (301, "", True), (302, LONG, None), (302, LONG, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, held boolean")
    for parts in (0, 3):
        got = sorted(lm.score(df, "held", lm.LmParams(lot_tokens=500), parts_log2=parts).collect(), key=lambda r: r["doc_id"])
        toks = [[*(t or "").lower().split(), None] for _, t, _ in docs]
        count = {}
        for t, (_, _, h) in zip(toks, docs):
            for w in t if not h else ():
                count[w] = count.get(w, 0) + 1
        n, v = sum(count.values()), len(count)
        for r, t in zip(got, toks, strict=True):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in count for w in t), n)
            assert r["base_score"] == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score(df.where("held"), "held").where("score > 0").count() == 0
    assert lm.score(df.limit(0), "held").count() == 0


def test_mixture_weights_sum_to_one():
    w = lm.mixture({(3, 1, 1): (100.0, 1e-3, 0.01, 0.5), (3, 2, 0): (50.0, 1e-3, 0.02, 0.0)}, 8, 50)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[3, 2] > 0.3


def test_pipeline_stages(spark):
    """Each stage keeps what its operator says, and hands on the columns of documents."""
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("component_id", pa_lit("x"))
    first = cp.STAGES[0][1](spark, docs, sf)
    assert first.columns == docs.columns and first.count() >= 0.99 * docs.count()
    third = cp.near_dedup(spark, docs, sf).toPandas()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(fps)
    keep = sorted(third.doc_id)
    f = np.array([fps[i] for i in ids], np.uint64)
    top = list(range(len(ids)))
    for a in range(len(ids)):
        for b in (np.flatnonzero(np.bitwise_count(f[a + 1:] ^ f[a]) <= 2) + a + 1).tolist():
            old, new = max(top[a], top[b]), min(top[a], top[b])
            top = [new if t == old else t for t in top]
    assert keep == [ids[k] for k, t in enumerate(top) if t == k]
    clean = cp.decontaminate(spark, docs, sf)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()


def test_pipeline_stages_with_null_and_repeated_ids(spark):
    """Rows are told apart without ids: each stage decides by the row's text."""
    from collections import Counter

    import corpus_pipeline as cp
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.01"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").where(F.length("text") > 100).orderBy("item_id").first()["text"]
    clean = [r["text"] for r in cp.decontaminate(spark, base, sf).where(F.length("text") > 400).orderBy("doc_id").limit(40).collect()]
    a, b, c, d = [t for t in clean if len(t.split()) > 20][:4]
    assert min((brute_fingerprint(x) ^ brute_fingerprint(y)).bit_count() for x, y in ((a, b), (a, c), (a, d), (b, c), (b, d), (c, d))) > 2
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (2, c), (2, d), (None, a), (3, leak), (3, b), (None, leak), (None, None), (4, None), (None, leak)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").crossJoin(base.drop("doc_id", "text").limit(1)).select(*base.columns)
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    one = cp.near_dedup(spark, docs, sf)
    assert one.columns == docs.columns
    assert pairs(one) == Counter([(1, a), (3, b), (2, c), (2, d), (3, leak), (4, None)])
    assert pairs(cp.decontaminate(spark, docs, sf)) == Counter(r for r in rows if r[1] != leak)
    both = base.unionByName(base.limit(100)).unionByName(base.limit(50).withColumn("doc_id", F.lit(None).cast(base.schema["doc_id"].dataType)))
    for stage in (cp.language_id, cp.toxic):        # a row's copies and those without an id go with its text
        kept, every = pairs(stage(spark, both, sf)), pairs(both)
        texts = {t for _, t in kept}
        assert kept == Counter({k: n for k, n in every.items() if k[1] in texts})
    packed = cp.pack(spark, docs, sf).toPandas()
    assert packed[packed["start"] == 0].doc_id.isna().sum() == sum(r[0] is None for r in rows) and (packed["start"] == 0).sum() == len(rows)


def pa_lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)


def test_arrow_type_of_encoder():
    ids, limits = WordEncoder(BPE).encode(pa.array([None, "a b", ""], pa.string()))
    assert limits.tolist() == [0, 0, 2, 2] and len(ids) == 2


def test_word_encoder_on_every_character():
    """Each assigned character before a full stop, a comma and letters, in blocks: the ids of the plain call."""
    import unicodedata
    enc = WordEncoder(BPE)
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    for lo in range(0, len(chars), 2000):
        texts = [" ".join(form.replace("{c}", c) for c in chars[lo:lo + 2000]) for form in ("{c}.", "{c},", "A{c}.", "a{c}b##")]
        plain = [e.ids for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids, limits = enc.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:])] == plain, lo


def test_word_encoder_forgets(monkeypatch):
    """Ids stay right while remembered pieces come and go, long ones among them."""
    from facsimile.llm import encode
    monkeypatch.setattr(encode, "PIECES_KEPT", 50)
    enc = WordEncoder(BPE)
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = " ".join(rng.choice(["the", "cat.", "Cat,", f"w{rng.integers(0, 99)}x", "É.", "x" * 60, f"n{'o' * int(rng.integers(1, 70))}"], 80))
        assert enc.check(text) and len(enc.pieces) <= 50


@pytest.mark.parametrize("dims, rank", [(128, 2), (128, 4), (256, 3), (64, 8)])
def test_embeddings_of_low_rank_lose_no_link(spark, dims, rank):
    rng = np.random.default_rng(dims + rank)
    x = rng.normal(size=(1500, rank)) @ rng.normal(size=(rank, dims))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert want.sum() > 50
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    small = embed_dedup.PqParams(block=1 << 16)         # several regions and blocks
    got = {r[0]: r[1] for r in embed_dedup.near_duplicates(df, params=small).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_embeddings_with_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.1]), (1, [1.0, 0.11]), (None, [1.0, 0.1]), (None, [5.0, -9.0]), (None, None), (3, None), (None, [5.0, -9.1])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (None, 0, None, True), (3, 0, 3, True),
         (None, 1, None, True)], key=repr)


def test_embedding_classes_of_many_copies(spark):
    """A third of all rows are one vector, and another third near it: counts without pairs."""
    rng = np.random.default_rng(4)
    far = rng.normal(size=(300, 16))
    rows = [(i, [1.0] + [0.0] * 15) for i in range(300)] + [(300 + i, [1.0] + (0.001 * rng.normal(size=15)).tolist()) for i in range(300)]
    rows += [(600 + i, v.tolist()) for i, v in enumerate(far)]
    got = {r[0]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i]["n_links"] == 599 and got[i]["component_id"] == 0 for i in range(600))


def brute_region(items):
    """The first and longest run with the largest sum, by all runs."""
    best = max([0.0, *(sum(items[a:b]) for a in range(len(items)) for b in range(a + 1, len(items) + 1))])
    if best <= 0:
        return 0, 0
    runs = [(a, b) for a in range(len(items)) for b in range(a + 1, len(items) + 1) if sum(items[a:b]) == best]
    return best, runs


def test_best_region_by_all_runs():
    rng = np.random.default_rng(9)
    for _ in range(400):
        items = rng.integers(-6, 6, int(rng.integers(0, 14))).astype(float).tolist()
        got = html_extract.best_region(items)
        best, runs = brute_region(items)
        assert got == (0, 0) if not best else got in runs and got[0] <= min(a for a, _ in runs), items


def unlabelled(page):
    """The page with its structure's names hidden: containers are divs and nothing has a class."""
    page = re.sub(r"(</?)(article|nav|header|footer|aside|section|main)\b", r"\1div", page)
    return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_html_of_unlabelled_pages(spark, tables):
    """Weights of one half's labelled pages find the article on the other half's pages, whose names are hidden."""
    pages = tables("pages", "/root/testdata/sf0.01").collect()
    model = html_extract.fit(spark.createDataFrame([(r["html"],) for r in pages[::2]], "html string"))
    for r in pages[1::2]:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        inside = re.sub("<[^>]*>", "", re.sub(r"</?(p|br|h1)>", " ", inside))
        assert html_extract.main_text(unlabelled(r["html"]), model) == " ".join(html.unescape(inside).split())


def test_html_of_articles_and_comments():
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    comments = "".join(f"<li><article class=comment><p>{say(f'c{k}w', 30)}</p></article></li>" for k in range(5))
    model = html_extract.ExtractModel()
    post = f"<body><div class=entry><h1>Title here</h1><p>{say('a', 60)}</p></div><ol class='comment-list'>{comments}</ol></body>"
    assert html_extract.main_text(post, model) == f"Title here {say('a', 60)}"
    for name in ("feedback", "discussion", "search", "social"):
        page = f"<body><article><h1>T</h1><p>{say('a', 20)}</p><section id={name}><p>{say('b', 20)}</p></section><p>{say('c', 20)}</p></article></body>"
        assert html_extract.main_text(page, model) == f"T {say('a', 20)} {say('b', 20)} {say('c', 20)}"
    page = f"<body><header><p>{say('site', 9)}</p></header><article><header><h1>The title</h1></header><p>{say('a', 20)}</p><aside>{say('x', 9)}</aside><p>{say('b', 20)}</p></article></body>"
    assert html_extract.main_text(page, model) == f"The title {say('a', 20)} {say('b', 20)}"
    page = f"<body><main><article><p>{say('a', 30)}</p></article><section id=comments><article><p>{say('c', 90)}</p></article></section></main></body>"
    assert html_extract.main_text(page, model) == say("a", 30)


@pytest.mark.parametrize("part", ["<a ", "<a '", "<!", '<p class="x', "<script>", "<", "<a b='>' ", "<!-- ", "</", "<p>", "<div class=comments>", "<a \"'>"])
def test_html_of_broken_pages_is_linear(part):
    import time
    model = html_extract.ExtractModel()
    start = time.process_time()
    html_extract.main_text(part * (1_000_000 // len(part)), model)
    assert time.process_time() - start < 6


def test_html_tag_ends():
    assert html_extract.scan("<a b='>'>x</a>") == [("tag", "<a b='>'>"), ("text", "x"), ("tag", "</a>")]
    assert html_extract.scan("<a b='>x</a>") == [("tag", "<a b='>"), ("text", "x"), ("tag", "</a>")]
    assert html_extract.scan("1 < 2 <b>İ</B><SCRIPT>a<b></Script >y<!-- - > --><!x>z<") == [
        ("text", "1 "), ("text", "<"), ("text", " 2 "), ("tag", "<b>"), ("text", "İ"), ("tag", "</B>"), ("text", "y"), ("text", "z"), ("text", "<")]


def test_html_with_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, PAGE), (1, PAGE), (1, PAGE), (None, None)], "page_id long, html string")
    got = html_extract.extract(df, html_extract.fit(df)).collect()
    assert [r["n_chars"] > 0 for r in sorted(got, key=lambda r: (r["page_id"] is None, -r["n_chars"]))] == [True, True, True, False]


def test_toxicity_features_and_counts_by_brute_force(spark):
    """Features of words one by one, and the counts of labelled texts, against sets in Python."""
    texts = ["Cat cats cat", "the catalogue! of cats", None, "", "Éa éa 中文字符 x1y2", "catalog catalogs cat's", "ﬁn İx", "a" * 50]
    row, at, distinct = toxicity.words(pa.array(texts))
    plain = distinct.to_pylist()
    got = [[plain[a] for a in at[row == i]] for i in range(len(texts))]
    assert got[:2] == [["cat", "cats", "cat"], ["the", "catalogue", "of", "cats"]] and got[2] == got[3] == []
    assert got[4] == ["éa", "éa", "中文字符", "x", "y"] and got[5] == ["catalog", "catalogs", "cat", "s"]
    single = {w: set(toxicity.word_features(pa.array([w], pa.large_string()))[1].tolist()) for w in plain}
    owner, feature = toxicity.word_features(distinct)
    assert [set(feature[owner == i].tolist()) for i in range(len(plain))] == [single[w] for w in plain]
    assert len(feature) == sum(len(f) for f in single.values())
    # a word, its beginnings and its n-grams
    assert [len(single[w]) for w in ("cat", "cats", "catalogue", "the")] == [1, 2, 1 + 3 + 6, 1]
    assert len(single["catalog"] & single["catalogs"]) == 3 + 4 and len(single["中文字符"]) == 1 + 3 + 2
    y = [1, 0, 1, 1, 0, 1, 0, 0]
    want = {}
    for i, ws in enumerate(got):
        for f in set().union(*(single[w] for w in ws)):
            n, bad = want.get(f, (0, 0))
            want[f] = n + 1, bad + y[i]
    df = spark.createDataFrame(list(zip(texts, y)), "text string, y int").where("text is not null")
    assert {r[0]: (r[1], r[2]) for r in toxicity.feature_counts(df).collect()} == want


def test_toxicity_score_is_the_weighted_sum():
    rng = np.random.default_rng(3)
    distinct = pa.array(["cat", "cats", "dog", "hound"], pa.large_string())
    features = np.unique(toxicity.word_features(distinct)[1])[::2]
    model = toxicity.ToxicModel(features, {}, rng.normal(size=len(features)), 0.3)
    text = "cat cat dog other hound cats cats cats"
    z = 0.3
    for f, w in zip(features.tolist(), model.weights):
        n = sum(f in toxicity.word_features(pa.array([x], pa.large_string()))[1] for x in text.split())
        z += w * np.log1p(n)
    assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z)))
    assert model.score(None) == model.score("") == pytest.approx(1 / (1 + np.exp(-0.3)))


def test_toxicity_weights_are_the_minimum_of_the_penalised_loss():
    """The fitted weights have no gradient left, the swap penalty in it."""
    rng = np.random.default_rng(6)
    x = (rng.random((300, 12)) < 0.3) * rng.random((300, 12))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.random(300) > 0.5).astype(float)
    d = np.zeros((5, 12))
    d[:, 0], d[:, 2:7] = 0.7, -0.7 * np.eye(5)
    p = toxicity.ToxicParams(ridge=1e-2, rounds=400)
    w, b = toxicity._train([np.flatnonzero(r).astype("<i4") for r in x], [r[r > 0] for r in x], y, [(i, v) for i, v in enumerate(d)], 12, p)
    prob = 1 / (1 + np.exp(-(x @ w + b)))
    grad = x.T @ (prob - y) / len(y) + p.ridge * w + p.swap_penalty * d.T @ (d @ w) / len(d)
    assert np.abs(grad).max() < 1e-4 and abs((prob - y).mean()) < 1e-4
    loose, _ = toxicity._train([np.flatnonzero(r).astype("<i4") for r in x], [r[r > 0] for r in x], y, [(i, v) for i, v in enumerate(d)], 12,
                               toxicity.ToxicParams(ridge=1e-2, rounds=400, swap_penalty=0.0))
    assert np.abs(d @ w).mean() < 0.7 * np.abs(d @ loose).mean()


def test_language_model_by_brute_force(spark):
    """Counts, estimates, held-out cells, weights and both scores from the definition, token by token."""
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab, int(rng.integers(0, 60)), p=np.arange(40, 0, -1) / 820)) for _ in range(150)]
    texts += [texts[3], texts[4], None, "Unseen words HERE"]
    held = [i % 7 == 2 for i in range(len(texts) - 1)] + [True]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, held)), "doc_id long, text string, held boolean")
    p = lm.LmParams(lot_tokens=300)
    got = sorted(lm.score(df, "held", p, parts_log2=2).collect(), key=lambda r: r["doc_id"])
    toks = [[*(t or "").lower().split(), None] for t in texts]
    word, pair, context = {}, {}, {}
    for t, h in zip(toks, held):
        for a, b in zip(["<start>", *t[:-1]], t) if not h else ():
            word[b] = word.get(b, 0) + 1
            pair[a, b] = pair.get((a, b), 0) + 1
            context[a] = context.get(a, 0) + 1
    n, v = sum(word.values()), len(word)

    def estimates(a, b, less):
        ctx = context.get(a, 0) - less
        return ctx, (pair.get((a, b), 0) - less) / ctx if ctx > 0 else 0.0, (word.get(b, 0) - less) / (n - less)

    cells = {}
    for t, h in zip(toks, held):
        for a, b in zip(["<start>", *t[:-1]], t) if not h else ():
            ctx, p2, p1 = estimates(a, b, 1)
            place = lambda x: int(np.clip(np.log2(x * (v + 1)) + p.grid // 4, 1, p.grid - 1)) if x > 0 else 0
            key = (int(np.log2(ctx + 1)), place(p1), place(p2))
            m, s1, s2 = cells.get(key, (0, 0.0, 0.0))
            cells[key] = m + 1, s1 + p1, s2 + p2
    w = lm.mixture({k: (float(m), 1 / (v + 1), s1 / m, s2 / m) for k, (m, s1, s2) in cells.items()}, p.buckets, p.em_rounds)

    def score(t, less):
        total = 0.0
        for a, b in zip(["<start>", *t[:-1]], t):
            ctx, p2, p1 = estimates(a, b, less)
            q = w[int(np.log2(ctx + 1))]
            total += np.log10(q[0] / (v + 1) + q[1] * p1 + q[2] * p2) if ctx > 0 else np.log10((q[0] / (v + 1) + q[1] * p1) / (q[0] + q[1]))
        return total

    for r, t, h in zip(got, toks, held, strict=True):
        assert r["score"] == pytest.approx(score(t, 0), rel=1e-9)
        assert r["deleted_score"] == pytest.approx(score(t, 0 if h else 1), rel=1e-9)


def test_mixture_is_the_maximum_by_expectation_maximisation():
    """The weights of a bucket raise the held-out likelihood as far as a fine search over the simplex does."""
    rng = np.random.default_rng(2)
    cells = {(0, i, 0): (float(rng.integers(1, 50)), 1e-3, float(rng.random() * 0.01), float(rng.random() ** 3)) for i in range(30)}
    w = lm.mixture(cells, 1, 4000)[0]
    own = np.array(list(cells.values()))
    value = lambda q: (own[:, 0] * np.log(own[:, 1:] @ q)).sum()
    grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(1e-6, 1, 101) for b in np.linspace(0, 1 - a, 101) if 1 - a - b >= 0]
    assert value(w) >= max(map(value, grid)) - 1e-3


def test_texts_that_occur_twice_stand_apart(spark):
    """With its own tokens left out, a training text that the corpus holds once more is far likelier than others."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 80) % 5000) for _ in range(300)]
    texts += texts[:30]
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held boolean")
    r = lm.score(df, "held").toPandas().set_index("doc_id").sort_index()
    per = r.deleted_score / r.n_tokens
    assert per.iloc[:30].quantile(0.1) > per.iloc[30:300].quantile(0.9) and r.deleted_score.sum() < r.score.sum()
    plain = r.score / r.n_tokens
    assert plain.iloc[:30].median() < plain.iloc[30:300].quantile(0.9)      # the model's own score does not say so


def test_language_id_by_brute_force():
    """Counts of n-grams, TF-IDF, cosine and rejection of a small model, term by term."""
    rng = np.random.default_rng(1)
    p = langid.LangParams(dims_log2=8)
    shift = 64 - p.dims_log2

    def counts(s):
        out = np.zeros(1 << p.dims_log2)
        code = [ord(c) + 1 for c in f" {s} "]
        for i in range(len(code)):
            key = 0
            for k, m in enumerate(langid._MIX):
                if i + k < len(code):
                    key = (key ^ code[i + k]) * int(m) % (1 << 64)
                    out[key >> shift] += 1
        return out

    for s in ("a", "the cat sat", "éèß straße", "中文 字"):
        assert langid.ngram_counts(s, p.dims_log2).tolist() == counts(s).tolist()
    idf = rng.random(256).astype(np.float32) + 0.1
    cents = rng.random((5, 256)).astype(np.float32)
    cents /= np.linalg.norm(cents, axis=1, keepdims=True)
    model = langid.LangModel(p, ["aa", "bb", "cc"], idf, cents, np.array([0, 0, 1, 2, 2]), np.full(40, 0.55))
    texts = ["the cat sat on the mat", "Ünïcode 12 words!", "zzz zzz", "一二三 abc", "x"]
    lang, score, rejected = model.predict(texts)
    for t, la, sc, rej in zip(texts, lang, score, rejected):
        x = np.log1p(counts(langid.letters(t))) * idf
        cos = cents @ (x / np.linalg.norm(x))
        assert la == model.langs[model.owner[cos.argmax()]] and sc == pytest.approx(cos.max(), abs=1e-5) and rej == (cos.max() < 0.55)


def test_stages_with_no_rows_and_with_clashing_names(spark):
    """Each pipeline stage on an empty table, and on columns named like its own."""
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    odd = docs.limit(60)
    for c in ("row", "gone", "rejected", "lang_pred", "similarity", "toxicity", "__row", "__gone", "text_", "html", "key", "digest", "fp"):
        odd = odd.withColumn(c, pa_lit("x"))
    odd = odd.cache()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.where("row = 'x' and gone = 'x' and toxicity = 'x'").count() == out.count() > 0, name
    assert cp.STAGES[-1][1](spark, odd, sf).count() >= 60
    odd.unpersist()


def test_token_counts_of_repeated_rows_and_long_words(spark):
    vocab = token_count.Vocabulary((("▁a", -1.0), ("a", -1.5), ("▁", -2.0)))
    rows = [(1, "aa"), (1, "aa"), (None, "aa"), (2, "a" * 5000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r["n_tokens"], r["doc_id"]) for r in token_count.count_tokens(df, vocab).where("doc_id is not null").collect())
    assert got == [(2, 1), (2, 1), (5000, 2)] and token_count.count_tokens(df, vocab).count() == 4


def test_words_and_pairs_are_numbered():
    """The keys of words and pairs by brute force: equal ones alone share a place, and a key is the same in any lot."""
    rng = np.random.default_rng(5)
    alphabet = np.frombuffer(b" \t\n\x0b\x0c\r\x1c\x1f\x00AaZz\xc3\xa9\xed\xa0\x85", np.uint8)
    keys = {}
    for k in range(60):
        texts = [rng.choice(alphabet, int(n)).tobytes() for n in rng.choice([0, 3, 40, 400], 4)]
        texts += [b"", b"x" * 63 + b" " + b"x" * 64 + b" " + b"x" * 65 + b" " + b"X" * 500]
        lengths, distinct, at = lm._numbered(texts)
        tokens = [[*t.lower().split(), None] for t in texts]
        grams = [w for t in tokens for w in t] + [g for t in tokens for g in zip(["<start>", *t], t)]
        assert lengths.tolist() == [len(t) for t in tokens] and (distinct[1:] > distinct[:-1]).all()
        assert set(at.tolist()) == set(range(len(distinct))) and len(set(grams)) == len(distinct)
        assert all(keys.setdefault(g, key) == key for g, key in zip(grams, distinct[at].tolist(), strict=True))
    assert len(set(keys.values())) == len(keys)


def test_language_model_cuts_texts_twice(spark):
    """The scores come from the counts written with the held-out cells: no third cut of the texts, no second shuffle of them."""
    rows = [(2 ** 53 + 1, "the cat sat", False), (None, "the dog sat", True), (5, " ".join(f"w{i % 91}" for i in range(3000)), False), (6, None, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    out = lm.score(df, "held", lm.LmParams(piece_tokens=100), parts_log2=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan and plan.count("Scan parquet") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    assert {k: r["n_tokens"] for k, r in got.items()} == {2 ** 53 + 1: 4, None: 4, 5: 3001, 6: 1}
    whole = {r["doc_id"]: r for r in lm.score(df, "held", parts_log2=0).collect()}
    for k, r in got.items():
        assert r["score"] == pytest.approx(whole[k]["score"], rel=1e-9) and r["deleted_score"] == pytest.approx(whole[k]["deleted_score"], rel=1e-9)
