"""Every operator against a brute-force version, with the odd cases it defines."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kerbside.llm import chat, decontamination, language_id, lm_scoring, mixing, near_dup, quality, sharding, token_counts, toxicity
from kerbside.llm._components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"en": ["the", "tion", "ing", "ou", "wh", "st"], "de": ["sch", "keit", "ung", "ei", "der", "ich"], "fr": ["eau", "oi", "les", "que", "ré", "eux"]}


def prose(rng, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, empty, null, blank and long texts, a repeated row, a null key, extra and clashing columns."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        lang = ("en", "de", "fr")[i % 3]
        rows.append([i, prose(rng, lang, int(rng.integers(6, 120))), lang, f"src{i % 4}", 0])
    for i in range(120, 150):  # near copies of one text, each with a few words changed
        words = rows[3][1].split() + prose(np.random.default_rng(7), "en", 80).split()
        for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
            words[at] = f"x{i}"
        rows.append([i, " ".join(words), "en", "src0", 0])
    for i in range(150, 160):
        rows.append([i, rows[5][1], "fr", "src0", 0])
    rows += [[160, "", "en", "src1", 0], [161, None, None, None, 0], [162, " \t\n ", "de", "src2", 0], [None, "no key at all", "en", "src1", 0]]
    rows += [[163, prose(rng, "de", 20_000), "de", "src3", 0], [163 - 100, rows[63][1], rows[63][2], rows[63][3], 0]]
    made = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    return made.withColumns({"n_tokens": F.lit("clash"), "shard": F.lit(9), "contained": F.lit(1), "toxicity": F.lit("x"), "_node": F.lit(0)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts_equal_the_library(docs, empty):
    tok = token_counts.load_tokenizer("byte_bpe_50k.json")
    out = token_counts.count_tokens(docs, chunk_chars=400, overlap_chars=16)
    texts = collections.Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    want = collections.Counter((k, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for k, t in texts.elements())
    got = out.collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(empty).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "word " * 500,
        "a" * 3000 + " b" * 200,
        "we're they'll don't " * 200,
        "\n\n   \t x" * 400,
        "1234567890" * 300,
        "<|endoftext|> x" * 200,
        "ab<|endoftext|>" * 300,
        "日本語のテキスト、" * 200,
        "é" * 500 + "🙂🙃 " * 300,
        " " * 2000,
    ],
)
@pytest.mark.parametrize("chunk", [64, 200, 1000])
def test_resynchronised_counts_are_exact(text, chunk):
    tok = token_counts.load_tokenizer("byte_bpe_50k.json")
    encode = lambda t: tok.encode(t, add_special_tokens=False)
    assert token_counts.resync_count(encode, text, chunk, 8)[0] == len(encode(text).ids)


def test_overlaps_are_widened():
    tok = token_counts.load_tokenizer("byte_bpe_50k.json")
    encode = lambda t: tok.encode(t, add_special_tokens=False)
    text = "ab " * 100 + "z" * 700 + " cd" * 300
    count, widened = token_counts.resync_count(encode, text, 256, 40)
    assert widened > 0 and count == len(encode(text).ids)


def test_sharding_laws(docs, empty):
    out = sharding.shard_plan(docs, blocks=4).collect()
    assert len(out) == docs.count() and {r.law for r in out} == {"key"}
    assert all(r.grown_shard in (r.shard, 8) for r in out) and any(r.grown_shard == 8 for r in out)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)
    assert sharding.shard_plan(empty).count() == 0


def test_rendezvous_weights_and_changes(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    at = lambda w: {r.k: r.s for r in keys.select("k", sharding.rendezvous_shard(F.col("k"), w).alias("s")).collect()}
    a, fewer = at([1, 2, 1, 0]), at([1, 2, 0, 0])
    share = collections.Counter(a.values())
    assert 3 not in share and abs(share[1] / 20_000 - 0.5) < 0.02
    assert all(fewer[k] == s for k, s in a.items() if s != 2)
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("k"), [0.0])


def chat_rows(spark):
    rows = [(1, 0, "system", "be <|kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 700, "cem", "late"), (2, None, None, ""), (None, 0, "ann", "lost"), (None, 1, "ann", "lost"), (3, 0, "system", "alone")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"perspective": F.lit("clash"), "_conv": F.lit(1)})


def test_perspectives(spark):
    out = chat.rotate_perspectives(chat_rows(spark)).collect()
    by = {(r.conv_id, r.perspective): r for r in out if r.conv_id is not None}
    assert set(by) == {(1, p) for p in ("ann", "bob", "cem")} | {(2, "unknown")}
    assert sum(r.conv_id is None for r in out) == 2 and all(r.n_messages == 1 for r in out if r.conv_id is None)
    ann = by[1, "ann"]
    tail = "<|user name=cem|>\nlate<|end|>\n"
    assert ann.rendered == "<|system|>\nbe < |kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo<|end|>\n" + "<|assistant|>\n<|end|>\n" * 2 + tail
    assert [ann.rendered[s.start : s.end] for s in ann.mask_spans] == ["hi<|end|>\n", "<|end|>\n", "<|end|>\n"]
    assert all(r.target_chars == sum(s.end - s.start for s in r.mask_spans) for r in out)
    assert by[1, "cem"].target_chars == len("late<|end|>\n") and by[2, "unknown"].rendered == "<|assistant|>\n<|end|>\n"
    assert chat.rotate_perspectives(chat_rows(spark).limit(0)).count() == 0


def test_long_dialogues_stay_whole(spark):
    """Thousands of turns, many without a number, repeated rows and a very long text, against a plain rendering."""
    rows = [(4, i if i % 3 else None, f"p{i % 4}", f"é{i % 1000}" * (40_000 if i == 77 else 1)) for i in range(2500)] + [(4, 9, "p1", "twice")] * 2
    out = {r.perspective: r for r in chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)).collect()}
    assert set(out) == {f"p{k}" for k in range(4)}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    for name, r in out.items():
        whole, spans = "", []
        for _, _, who, text in ordered:
            whole += "<|assistant|>\n" if who == name else f"<|user name={who}|>\n"
            if who == name:
                spans.append((len(whole), len(whole) + len(text) + len(chat.END)))
            whole += text + chat.END
        assert r.rendered == whole and [(s.start, s.end) for s in r.mask_spans] == spans and r.n_messages == len(rows)


def test_toxicity_folding_and_exceptions():
    model = toxicity.ToxicityModel((("idiot", 4.0, False), ("scum", 3.0, False), ("wurz", 2.0, True)))
    hit = lambda t: model.hits(t)[:2]
    assert hit("an IDIOT") == hit("1d10t!") == hit("іdіоt") == hit("id​iot") == (4.0, 1)
    assert hit("idiots") == hit("scumble") == hit(None) == hit("") == (0.0, 0)
    assert hit("wurzeln wurz") == (4.0, 2) and hit("the village idiot and scum") == (3.0, 1)
    assert model.score(4.0, 10) > model.score(4.0, 1000) > model.score(0.0, 10)


def labelled(spark, n=900):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        text, bad = prose(rng, lang, int(rng.integers(20, 200))), i % 5 == 0
        if bad:
            insert = {"en": ["scumbo"], "de": ["wurxach", "wurxung", "wurxei"], "fr": ["vequoi", "veques"]}[lang]
            words = text.split()
            words[3:3] = list(rng.choice(insert, 2))
            text = " ".join(words)
        rows.append((i, text, lang, "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (5_000, 0, None)], "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_and_holds_out(spark, docs, empty):
    rows, labels = labelled(spark)
    model = toxicity.fit_toxicity(rows, labels)
    assert {"scumbo"} <= {t for t, *_ in model.terms} and any(t.startswith("wurx") or "wurx".startswith(t) for t, _, stem in model.terms if stem)
    scored = toxicity.score_toxicity(rows, model).join(labels, "doc_id").withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.out]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert np.mean([(r.toxicity >= 0.5) == (r.toxic == 1) for r in held]) > 0.97
    odd = toxicity.score_toxicity(docs, model)
    assert odd.columns.count("toxicity") == 1 and odd.count() == docs.count() and odd.where("toxicity is null").count() == 0
    assert toxicity.fit_toxicity(empty, labels.limit(0)).terms and toxicity.score_toxicity(empty, model).count() == 0


def test_toxicity_learns_rare_terms_from_many_labels(spark):
    rng = np.random.default_rng(4)
    keys = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 5][:1800]
    rows, labels = [], []
    for i, k in enumerate(keys):
        words = prose(rng, "en", 30).split()
        words[3:3] = ["zorvex"] if i < 4 else ["scumbo"] if i < 600 else []
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(i < 600)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert any("zorvex".startswith(t) for t, *_ in model.terms)
    found = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("toxicity >= 0.5").collect()}
    assert set(keys[4:600]) <= found <= set(keys[:600])


def test_language_bits_and_accuracy(spark, docs, empty):
    rows, _ = labelled(spark)
    model = language_id.fit_languages(rows)
    out = language_id.predict_language(rows, model).withColumn("out", language_id.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang_pred == r.lang for r in out if r.out]) > 0.98 and all(0 <= r.lang_score <= 1 for r in out)
    odd = {r.doc_id: r.lang_pred for r in language_id.predict_language(docs, model).collect()}
    assert odd[160] == odd[161] == odd[162] == "und" and set(odd.values()) <= {"en", "de", "fr", "und"}
    assert language_id.fit_languages(empty) is None
    assert language_id.predict_language(docs, None).where("lang_pred <> 'und'").count() == 0


def test_language_filter_has_no_false_negative(spark):
    rows, _ = labelled(spark, 90)
    model = language_id.fit_languages(rows, least=1, share_of_best=0.0)
    assert model.filter.shape[1] >= 8 and max(model.rates) < 0.1
    for lang in ("en", "de", "fr"):
        text = [r.text for r in rows.where((F.col("lang") == lang) & ~language_id.held_out(F.col("doc_id"))).collect()]
        bits = (model.masks(language_id.ngrams(text)[0])[0] >> np.uint64(model.languages.index(lang))) & np.uint64(1)
        assert bits.all()


def test_language_pieces_lose_nothing(monkeypatch):
    text = prose(np.random.default_rng(2), "en", 400)
    whole = np.sort(language_id.ngrams([text])[0])
    monkeypatch.setattr(language_id, "PIECE", 100)
    parts = np.sort(np.concatenate([language_id.ngrams(p)[0] for p, _ in language_id.batches_of([text])]))
    assert (whole == parts).all()


def brute_components(rows, k, percent):
    def shingle_set(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(r.doc_id, shingle_set(r.text)) for r in rows if r.doc_id is not None]
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(docs, k):
    out = near_dup.near_duplicates(docs, shingle=k).collect()
    want = brute_components(docs.select("doc_id", "text").collect(), k, 80)
    assert len(out) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)


def test_near_duplicates_of_nothing(empty):
    assert near_dup.near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(docs):
    out = near_dup.drop_near_duplicates(docs)
    want = brute_components(docs.select("doc_id", "text").collect(), 5, 80)
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == sorted({c for _, c in want.values()})
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 1


def test_keys_come_back_as_given(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(-5, text), (7, text + " x"), (None, "lone"), (None, text + " y"), (9, None), (9, ""), (11, "one text"), (11, "another text of four words")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("node", F.lit("clash"))
    out = near_dup.near_duplicates(df)
    assert dict(out.dtypes)["doc_id"] == "int"
    rows = out.collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.kept) for r in rows)
    assert got == collections.Counter([(-5, 47, True), (7, 48, False), (None, 1, True), (None, 48, False), (9, 0, True), (9, 0, True), (11, 1, True), (11, 2, True)])
    assert {r.component_id for r in rows if r.n_shingles > 40} == {-5}
    kept = near_dup.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()).count(9) == 1 and kept.columns == df.columns
    with pytest.raises(TypeError):
        near_dup.near_duplicates(df.withColumn("doc_id", F.lit("x")))


def test_blocks_of_a_bucket_find_the_same(docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    out = near_dup.near_duplicates(docs, shingle=4).where("doc_id is not null").collect()
    want = brute_components(docs.select("doc_id", "text").collect(), 4, 80)
    assert {r.doc_id: r.component_id for r in out} == {i: c for i, (_, c) in want.items()}


def test_a_hub_is_compared_in_parts(spark, monkeypatch):
    """4000 distinct near copies of one text, whose smallest is a partner of all: parts of it find what one task finds."""
    rng = np.random.default_rng(3)
    base = prose(rng, "en", 120).split()
    rows = []
    for i in range(4000):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(4000 + i, prose(rng, "de", 60)) for i in range(50)]
    near = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 20_000)
    held = []
    real = near_dup.stored
    monkeypatch.setattr(near_dup, "stored", lambda df, label: held.append((label, real(df, label))) or held[-1][1])
    out = {r.doc_id: r for r in near_dup.near_duplicates(near).collect()}
    sets = [{tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for _, t in rows]
    assert all(100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets[:4000])
    assert all(out[i].component_id == (0 if i < 4000 else i) and out[i].n_shingles == len(sets[i]) for i in range(len(rows)))
    named = dict(held)
    loads = {r.a: r for r in named["hub-loads"].collect()}
    assert loads[0]._rows == 3999 and loads[0].parts > 20
    linked = {tuple(r) for r in named["links"].where("a = 0").collect()}
    assert linked == {(0, b) for b in range(1, 4000)}


def test_min_max_values_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (800, 100, 100))
    x, y = near_dup.signatures([np.concatenate([common, a]), np.concatenate([common, b])], 400)
    assert abs((x == y).mean() - 0.8) < 0.05 and (x[0::2] <= x[1::2]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (139, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in [*range(100, 140), 300])
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_containment_equals_brute_force(spark, docs, empty):
    rng = np.random.default_rng(4)
    items = [(i, prose(rng, "en", int(rng.integers(5, 90)))) for i in range(40)] + [(40, ""), (41, None), (42, "only three words"), (0, "twice told tale of an old tree")]
    hosts = []
    for i, (_, text) in enumerate(items):
        words = (text or "").split()
        if len(words) > 30:
            words[2] = "CHANGED"
        hosts.append((1000 + i, prose(rng, "de", 300) + " " + " ".join(words).upper() + " " + prose(rng, "fr", 300), "en", "s", 0))
    half = items[5][1].split()
    hosts.append((2000, " ".join(half[: len(half) // 2]) + " zz " + prose(rng, "de", 900) + " " + " ".join(half[len(half) // 2 :]), "en", "s", 0))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = docs.unionByName(spark.createDataFrame(hosts, DOCS), allowMissingColumns=True)

    def grams(t, k):
        w = [x.lower() for x in WORD.findall(t or "")]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()

    want = set()
    for r in rows.collect():
        for i, t in items:
            k = min(5, len(WORD.findall(t or "")))
            own = grams(t, k)
            if own and 100 * len(own & grams(r.text, k)) >= 80 * len(own):
                want.add((r.doc_id, i, len(own)))
    for at_a_time in (5000, 10):
        found = decontamination.find_items(rows, table, items_a_part=at_a_time)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        got = {(r.doc_id, h.item_id, h.n_item) for r in found.collect() for h in r.contained}
        assert got == want and found.count() == rows.count()
    assert len(want) > 30 and decontamination.find_items(empty, table).count() == 0
    assert decontamination.find_items(rows, table.limit(0)).where(F.size("contained") > 0).count() == 0


@pytest.mark.parametrize("stretch", [64, 256])
def test_long_documents_are_searched_in_stretches(monkeypatch, stretch):
    monkeypatch.setattr(decontamination, "STRETCH", stretch)
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"{i}v{j}" for j in range(n))) for i, n in enumerate((4, 5, 6, 7, 8, 9, 12, 20, 40, 90, 150))]
    whole = decontamination.ItemIndex(items)
    halves = [decontamination.ItemIndex(items[:5]), decontamination.ItemIndex(items[5:])]
    sizes = sorted({s for x in halves for s in x.built()["classes"]})
    texts, want = [], []
    for k in range(60):
        own = sorted(rng.choice(len(items), 3, replace=False).tolist())
        texts.append("  ".join(x for i in own for x in (prose(rng, "de", int(rng.integers(0, 300))), items[i][1])).encode())
        want.append(own)
    assert [sorted(i for i, _, _ in whole.search(t)) for t in texts] == want
    assert [[i for i, _, _ in e] for e in decontamination.search_all(texts, [lambda x=x: x for x in halves], sizes, 5)] == want


def test_items_in_capitals_are_found():
    item = prose(np.random.default_rng(3), "fr", 30)
    index = decontamination.ItemIndex([(1, item.capitalize()), (2, "Élan Ñandú")])
    for text in (item, item.upper(), "vorher " * 90 + item.title()):
        assert [i for i, _, _ in index.search(text.encode())] == [1]
    assert index.search(b"\xff " * 5 + "ÉLAN ÑANDÚ".encode()) == [(2, 1, 1)]


def brute_quality(t):
    t = t or ""
    w, seen, covered = WORD.findall(t), {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {i + j for i in places for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_counts_equal_brute_force(spark, docs, empty):
    more = ["a b c d e a b c d e " * 3, "one two\none two\n \none two", "x y z w v " + "q " * 40, "# * $ % & | < > é ü ß", "A b\r\nA b\r\n" * 9]
    rows = docs.unionByName(spark.createDataFrame([(3000 + i, t, "en", "s", 0) for i, t in enumerate(more)], DOCS), allowMissingColumns=True)
    out = quality.quality_rules(rows, min_reference_docs=5).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == collections.Counter((r.doc_id, *brute_quality(r.text)) for r in rows.collect())
    assert not any(r.kept and r.base_failed for r in out)
    assert quality.quality_rules(empty).count() == 0


def test_js_distance(spark):
    p, q = [1.0, 3.0, 0.0], [2.0, 1.0, 1.0]
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    got = row.select(quality.js_distance(F.col("p"), F.col("q")).alias("d"), quality.js_distance(F.col("p"), F.col("p")).alias("z"), quality.js_distance(F.col("p"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("n")).first()
    a, b = np.array(p) / 4, np.array(q) / 4
    m = (a + b) / 2
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u > 0)
    assert abs(got.d - math.sqrt((kl(a) + kl(b)) / 2)) < 1e-12 and got.z == 0 and got.n is None


def brute_verdicts(rows, words=20, least=5):
    """(distances, kept) by document, in plain Python."""
    token = re.compile(r"[\x20\x09-\x0D.,;:!?]+")
    classes = [str.isupper, lambda c: c in "0123456789", lambda c: c in ".,;:!?'\"()-", lambda c: c in "#*$%&|<>{}[]=+/\\_@^~`"]
    facts, seen, refs = {}, collections.defaultdict(collections.Counter), {}
    for k, (text, lang) in rows.items():
        tokens = [w for w in token.split((text or "").lower()) if w]
        if lang is not None:
            seen[lang].update(tokens)
        facts[k] = (tokens, brute_quality(text), [sum(map(of, text or "")) for of in classes])
    common = {x: [w for w, _ in sorted(c.items(), key=lambda i: (-i[1], i[0].encode()))[:words]] for x, c in seen.items()}
    hist = {}
    for k, (tokens, base, own) in facts.items():
        lang, met = rows[k][1], collections.Counter(tokens)
        listed = [met[w] for w in common[lang]] if lang in common else None
        hist[k] = ([*own, max(0, base[1] - sum(own))], None if listed is None else [*listed, len(tokens) - sum(listed)])
    for lang in common:
        good = [hist[k] for k in rows if rows[k][1] == lang and not facts[k][1][5]]
        if len(good) >= least:
            refs[lang] = [np.sum([h[i] for h in good], 0) for i in (0, 1)]

    def distance(p, q):
        p, q = np.array(p, float), np.array(q, float)
        if not p.sum() or not q.sum():
            return None
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        return math.sqrt(max(0.0, sum(float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q)) / 2))

    out = {}
    for k, (_, base, _) in facts.items():
        ref = refs.get(rows[k][1])
        chars = distance(hist[k][0], ref[0]) if ref and base[1] >= 200 else None
        listed = distance(hist[k][1], ref[1]) if ref and base[0] >= 60 else None
        out[k] = (chars, listed, not base[5] and (chars or 0) <= 0.33 and (listed or 0) <= 0.35)
    return out


def test_quality_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = {i: (" ".join(f"The {w}, {w[:2]}{j % 30}." for j, w in enumerate(prose(rng, ("en", "de")[i % 2], int(rng.integers(5, 90))).split())), ("en", "de")[i % 2]) for i in range(60)}
    rows |= {
        90: ("", "en"), 91: (None, None), 92: (None, "en"), 93: ("### ".join(prose(rng, "en", 150).upper().split()), "en"), 94: ("### ".join(prose(rng, "en", 15).upper().split()), "en"),
        95: (prose(rng, "fr", 200), "en"), 96: (prose(rng, "fr", 200), None), 97: (prose(rng, "fr", 200), "fr"), 98: (" ".join(["the same"] * 300), "de"), 99: (prose(rng, "en", 20_000), "en"),
    }
    df = spark.createDataFrame([(k, t, x, "s", 0) for k, (t, x) in rows.items()], DOCS)
    clash = df.withColumns({c: F.lit("x") for c in ("_text", "_lang", "_body", "_words", "_chars", "_common", "_list", "common", "n_words", "kept")})
    want = brute_verdicts(rows)
    for out in (quality.quality_rules(df, min_reference_docs=5), quality.quality_rules(clash.repartition(7), min_reference_docs=5)):
        got = {r.doc_id: r for r in out.collect()}
        assert got.keys() == want.keys()
        for k, (chars, words, kept) in want.items():
            assert got[k].kept == kept and (got[k].char_distance is None) == (chars is None) and (got[k].word_distance is None) == (words is None), k
            assert chars is None or abs(got[k].char_distance - chars) < 1e-9
            assert words is None or abs(got[k].word_distance - words) < 1e-9
    assert not want[93][2] and want[94][2] and not want[95][2] and want[97][2] and sum(v[2] for v in want.values()) > 40
    with pytest.raises(ValueError):
        quality.quality_rules(df, words=61)


def test_quality_deals_no_document_by_language(spark, docs):
    plan = quality.quality_rules(docs, min_reference_docs=5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def brute_fill(children, budget):
    """children: name -> (weight, capacity); raise the level until the budget is spent."""
    got, left, live = dict.fromkeys(children, 0.0), budget, {k for k, (w, c) in children.items() if w > 0 and c > 0}
    while live and left > 1e-9:
        total = sum(children[k][0] for k in live)
        step = min(min((children[k][1] - got[k]) / children[k][0] for k in live), left / total)
        for k in live:
            got[k] += step * children[k][0]
        left -= step * total
        live = {k for k in live if children[k][1] - got[k] > 1e-9}
    return got


def test_mixture_budgets(spark):
    leaves = {("web", "en", "a"): 100, ("web", "en", "b"): 900, ("web", "de", "a"): 50, ("news", "en", "c"): 400, ("news", "fr", "d"): 10, ("off", "en", "z"): 500}
    tree = mixing.MixTree({"web": 3, "news": 1, "off": 0, "web/en": 2, "web/en/a": 5})
    rows = spark.createDataFrame([(*k, float(v)) for k, v in leaves.items()], "domain string, lang string, source string, tokens double")
    for budget in (60.0, 500.0, 1200.0, 5000.0):
        got = {(r.domain, r.lang, r.source): r.leaf_budget for r in mixing.leaf_budgets(rows, tree, budget, 2).collect()}
        cap = {k: 2.0 * v * (k[0] != "off") for k, v in leaves.items()}
        under = lambda p: sum(c for k, c in cap.items() if k[: len(p)] == p)
        top = brute_fill({d: ({"web": 3, "news": 1, "off": 0}[d], under((d,))) for d in ("web", "news", "off")}, budget)
        for d, share in top.items():
            langs = {k[1] for k in leaves if k[0] == d}
            mid = brute_fill({x: (2 if (d, x) == ("web", "en") else 1, under((d, x))) for x in langs}, share)
            for x, part in mid.items():
                low = brute_fill({k[2]: (5 if k == ("web", "en", "a") else 1, cap[k]) for k in leaves if k[:2] == (d, x)}, part)
                for s, tokens in low.items():
                    assert abs(got.get((d, x, s), 0) - tokens) <= 1.01


def test_mixture_takes_seeded_prefixes(docs, empty):
    domain, tree = F.lit("web"), mixing.MixTree({"web/en": 3.0})
    out = mixing.mix(docs, tree, domain, share=0.9, max_epochs=2)
    rows = out.collect()
    tokens, budget = collections.Counter(), {}
    longest = collections.Counter()
    for r in rows:
        k = (r.lang, r.source)
        tokens[k] += r.n_tokens
        budget[k] = r.leaf_budget
        longest[k] = max(longest[k], r.n_tokens)
    assert all(budget[k] <= tokens[k] < budget[k] + longest[k] or budget[k] == tokens[k] for k in tokens)
    assert all(r.epoch in (0, 1) for r in rows)
    again = mixing.mix(docs.repartition(7), tree, domain, share=0.9, max_epochs=2)
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, rows))
    assert mixing.mix(empty, tree, domain).count() == 0
    kept = mixing.mixed_documents(docs, tree, domain, share=0.5)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def plain_score(net, vocabulary, counts, text):
    """A document's score by the formula, word by word and turn by turn."""
    known, t = {w: i for i, w in enumerate(vocabulary.words)}, net.tables
    edge, total = len(t["inputs"]) - 1, 0.0
    words = text.encode().lower().split()
    number = [known[w] if w in known else len(known) + xxh64_intdigest(w, 42) % lm_scoring.RARE for w in words]
    for i, w in enumerate(words):
        around = [number[i + o] if 0 <= i + o < len(words) else edge for o in lm_scoring.OFFSETS]
        x = np.concatenate([net.values["embed"][t["inputs"][k]] for k in around]).astype(float)
        h = np.append(np.tanh(x @ net.values["layer"][:-1] + net.values["layer"][-1]), 1.0)
        for turn in t["turns"][t["start"][number[i]] :][: t["size"][number[i]]]:
            node = turn >> 1
            near = node < lm_scoring.UPPER
            row = net.values["upper"][node] if near else net.values["lower"][node - lm_scoring.UPPER]
            odds = (h if near else h[lm_scoring.HIDDEN - lm_scoring.NARROW :]) @ row.astype(float)
            total -= math.log1p(math.exp(-odds if turn & 1 else odds))
        if w not in known:
            total += math.log(counts.get(w, 1) / (vocabulary.totals[number[i] - len(known)] + 1))
    return total, len(words)


@pytest.fixture(scope="module")
def fitted(docs):
    """A model whose vocabulary holds part of the words."""
    return lm_scoring.fit(docs, words=300)


def test_scores_equal_the_formula(spark, docs, empty, fitted):
    model, rows = fitted
    net = lm_scoring.Network(model.vocabulary.tables(), model.values)
    texts = [r.text for r in docs.select("text").collect() if r.text]
    counts = collections.Counter(w for t in texts for w in t.encode().lower().split())
    assert sum(counts.values()) == model.vocabulary.size and len(counts) == 300 + model.vocabulary.others
    assert sum(model.vocabulary.totals) == sum(counts.values()) - sum(int(n) for n in model.vocabulary.counts) > 0
    more = spark.createDataFrame([(9000, "THE never \u00c9t\u00e9 met", "en", "s", 0)], DOCS)
    asked = docs.unionByName(more, allowMissingColumns=True).where("length(text) < 2000 or text is null")
    out = lm_scoring.score(asked, model).collect()
    want = {r.doc_id: plain_score(net, model.vocabulary, counts, r.text or "") for r in asked.collect()}
    assert all(abs(r.log_likelihood - want[r.doc_id][0]) < 1e-3 * (1 + r.n_words) and r.n_words == want[r.doc_id][1] for r in out)
    by = {r.doc_id: r for r in out}
    assert by[160].n_words == by[161].n_words == 0 and by[160].log_likelihood == 0 and by[160].mean_logprob is None
    whole = {r.doc_id: r for r in lm_scoring.score_encoded(rows, model, "doc_id").collect()}
    assert len(out) == asked.count() and whole[163].n_words == 20_000 and abs(whole[5].mean_logprob - by[5].mean_logprob) < 1e-9
    assert lm_scoring.score(empty, model).count() == 0 and lm_scoring.pseudo_likelihood(empty).count() == 0


def test_probabilities_of_all_words_sum_to_one(fitted):
    model, _ = fitted
    net = lm_scoring.Network(model.vocabulary.tables(), model.values)
    leaves = 300 + lm_scoring.RARE
    for around in (0, 7, 299, 310):
        ids = [np.array([around, 3, k, 5, around], np.int32) for k in range(leaves)]
        assert abs(sum(math.exp(net.log_probabilities(x)[2]) for x in ids) - 1) < 1e-4


def test_code_follows_the_weights():
    at, nodes, right, bias = lm_scoring.huffman([8, 4, 2, 1, 1])
    assert np.diff(at).tolist() == [1, 2, 3, 4, 4] and nodes[at[:-1]].tolist() == [0] * 5
    for i, w in enumerate([8, 4, 2, 1, 1]):
        chance = np.prod([1 / (1 + math.exp(-b if r else b)) for b, r in zip(bias[nodes[at[i] : at[i + 1]]], right[at[i] : at[i + 1]], strict=True)])
        assert abs(chance - w / 16) < 1e-6
    assert lm_scoring.huffman([3])[0].tolist() == [0, 0]


def test_sums_of_runs():
    rng = np.random.default_rng(0)
    size = np.array([1, 3, 9, 2, 1, 40, 5])
    begin, rows = np.cumsum(size) - size, rng.standard_normal((size.sum(), 3)).astype(np.float32)
    assert np.allclose(lm_scoring.sums(rows, begin, size), [rows[b : b + n].sum(0) for b, n in zip(begin, size, strict=True)], atol=1e-5)


def test_scores_do_not_depend_on_partitions(docs):
    made = [{(r.doc_id, r.n_words): r.log_likelihood for r in lm_scoring.pseudo_likelihood(docs.repartition(n)).collect()} for n in (2, 16)]
    assert made[0].keys() == made[1].keys() and all(abs(v - made[1][k]) < 1e-6 for k, v in made[0].items())


def test_every_word_is_a_target_once(docs):
    texts = [t.encode() for t in ("a b c a", "", "b", " ".join(f"w{i % 7}" for i in range(5000)))]
    words = sorted({w for t in texts for w in t.split()})
    known = lm_scoring.Vocabulary(words, np.ones(len(words), np.int64), (0,) * lm_scoring.RARE, 1, 0)
    ids = [lm_scoring.numbers(t.split(), {w: i for i, w in enumerate(words)})[0] for t in texts]
    trainer = lm_scoring.Trainer(known.tables(), lm_scoring.first_values(known.tables()["bias"], 1))
    trainer.learn(ids)
    assert trainer.uses["layer"][0] == sum(map(len, ids)) == trainer.uses["upper"][0]


def test_gradient_lowers_the_cost():
    words = [b"w%d" % i for i in range(40)]
    known = lm_scoring.Vocabulary(words, np.ones(40, np.int64), (0,) * lm_scoring.RARE, 40, 0)
    trainer = lm_scoring.Trainer(known.tables(), lm_scoring.first_values(known.tables()["bias"], 1))
    rng = np.random.default_rng(0)
    text = lambda: np.stack([a := rng.integers(0, 18, 300), a + 20, rng.integers(0, 40, 300)], 1).ravel().astype(np.int32)
    test, cost = text(), lambda: -trainer.log_probabilities(test)[1::3].mean()
    before = cost()  # the middle word of three is that before it plus 20
    trainer.learn(text() for _ in range(300))
    assert cost() < 0.6 * before


def test_short_texts_are_scored_together(fitted, monkeypatch):
    model, _ = fitted
    net, calls, ways = lm_scoring.Network(model.vocabulary.tables(), model.values), [], lm_scoring.Network.ways
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 300 + lm_scoring.RARE, n).astype(np.int32) for n in (0, 1, 9000, 2, *rng.integers(0, 60, 300), 0)]
    alone = [net.log_probabilities(t) for t in texts]
    monkeypatch.setattr(lm_scoring.Network, "ways", lambda *a: calls.append(1) or ways(*a))
    together = list(net.costs(iter(texts)))
    assert len(calls) < 10  # not one for each text
    assert len(together) == len(texts) and all(len(a) == len(b) and np.allclose(a, -b, rtol=0, atol=1e-9) for a, b in zip(alone, together, strict=True))


def test_words_are_numbered_as_bytes():
    import pyarrow as pa

    texts = [b"", b"   ", b" A\x0bb\x1c\xffZ \xc3\x89 a\x0c", b"\xc2\xa0x \x85 y\x00 Y", b"\t\n\r q", b"q A"]
    number, ends, words = lm_scoring.numbered(pa.array([b"before", *texts], pa.binary()).slice(1))
    split = [t.lower().split() for t in texts]
    assert [words[int(i)].as_py() for i in number] == [w for t in split for w in t]
    assert ends.tolist() == np.cumsum([len(t) for t in split]).tolist() and len(set(words.to_pylist())) == len(words)


def test_chunks_hold_every_text(spark, docs):
    few, one = (lm_scoring.tokenised(docs.coalesce(2), "doc_id", "text", chunk=n).collect() for n in (40, 1 << 40))
    assert len(few) > 20 > len(one)
    want = collections.Counter((r.doc_id, tuple((r.text or "").encode().lower().split())) for r in docs.collect())
    for made in (few, one):
        got = collections.Counter((k, tuple(r["words"][i] for i in np.frombuffer(t, np.int32))) for r in made for k, t in zip(r["keys"], r["texts"], strict=True))
        assert got == want
        assert sum(sum(r["counts"]) for r in made) == sum(len(words) * n for (_, words), n in want.items())


def test_a_step_equals_the_formula():
    """Gradients word by word and turn by turn, then one move of each row."""
    width, hidden, upper = lm_scoring.WIDTH, lm_scoring.HIDDEN, lm_scoring.UPPER
    known = lm_scoring.Vocabulary([b"w%d" % i for i in range(300)], np.arange(900, 600, -1), (0,) * lm_scoring.RARE, 1, 0)
    tables, rng = known.tables(), np.random.default_rng(4)
    values = lm_scoring.first_values(tables["bias"], 1)
    for kind in ("upper", "lower"):
        values[kind] += rng.standard_normal(values[kind].shape).astype(np.float32) * 0.3
    ids = np.concatenate([rng.integers(0, 300 + lm_scoring.RARE, 200), [5] * 60]).astype(np.int32)
    trainer = lm_scoring.Trainer(tables, values)
    trainer.learn([ids])
    grads = {k: np.zeros(v.shape) for k, v in values.items()}
    layer, edge = values["layer"].astype(float), len(tables["inputs"]) - 1
    for i, word in enumerate(ids):
        around = [tables["inputs"][ids[i + o] if 0 <= i + o < len(ids) else edge] for o in lm_scoring.OFFSETS]
        x = np.append(np.concatenate([values["embed"][k] for k in around]).astype(float), 1.0)
        h, back = np.append(np.tanh(x @ layer), 1.0), np.zeros(hidden + 1)
        for turn in tables["turns"][tables["start"][word] :][: tables["size"][word]]:
            node, side = turn >> 1, (turn & 1) * 2 - 1
            kind, row, first = ("upper", node, 0) if node < upper else ("lower", node - upper, hidden - lm_scoring.NARROW)
            missed = -side / (1 + math.exp(side * (h[first:] @ values[kind][row])))
            grads[kind][row] += missed * h[first:]
            back[first:] += missed * values[kind][row]
        back = back[:-1] * (1 - h[:-1] ** 2)
        grads["layer"] += np.outer(x, back)
        for k, part in zip(around, (layer[:-1] @ back).reshape(-1, width), strict=True):
            grads["embed"][k] += part
    for kind, g in grads.items():
        want = values[kind] - lm_scoring.RATE * g / np.sqrt((g**2).mean(1) + 1e-8)[:, None]
        assert np.allclose(trainer.values[kind], want, atol=2e-3), kind


#: Names that operators use inside, or give out.
CLASHES = (
    "_node", "_kept_node", "_kept_mark", "_text", "_hash", "_mix_mark", "_mix_key", "_mix_text", "_key", "_part", "_hits", "_found", "_judged", "_id", "_lang", "_words", "_block",
    "contained", "toxicity", "toxic_hits", "lang_pred", "kept", "n", "node", "key", "mark", "band", "domain", "epoch", "n_tokens", "_own_toxicity", "a.b",
)


def with_clashes(df):
    """The table with a column of every such name, which says the row's key."""
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES if c not in df.columns])


def unchanged(out) -> bool:
    own = [F.col(f"`{c}`") for c in CLASHES]
    rows = out.select("doc_id", *own).collect()
    return all(r[i + 1] == f"{c}:{'-' if r[0] is None else r[0]}" for r in rows for i, c in enumerate(CLASHES))


def plain_tables(spark):
    """(documents, labels, benchmark) with copies, leaks, nulls, empties, a long text, repeated rows and a missing key."""
    rows, labels = labelled(spark, 240)
    rng = np.random.default_rng(12)
    docs = [(r.doc_id, r.text, r.lang, f"src{r.doc_id % 16}", 0) for r in rows.collect()]
    item = prose(np.random.default_rng(9), "en", 40)
    docs += [(9000, f"before it {item} after it", "en", "src1", 0), (9001, docs[7][1], "de", "src2", 0), (9002, docs[8][1].upper(), "fr", "src3", 0)]
    docs += [(9003, None, "en", "src1", 0), (9004, "", None, None, 0), (9005, " \t\n", "en", "src1", 0), (9006, prose(rng, "de", 20_000), "de", "src9", 0), docs[11], docs[11]]
    docs += [(None, "no key but words of its own here", "en", "src4", 0), (9007, docs[12][1] + " tail", "en", None, 0)]
    return docs, labels, [(1, item), (2, None), (3, "")]


def plain_mix(rows, share=0.8):
    """The documents that a mixture of one epoch takes, in plain Python."""
    from kerbside.llm.queries import DOMAINS, WEIGHTS

    words = lambda r: len(WORD.findall(r[1] or ""))
    place = {s: d for d, own in DOMAINS.items() for s in own}
    leaf = lambda r: (place.get(r[3], "other"), r[2] or "unknown", r[3] or "unknown")
    tokens = collections.Counter()
    for r in rows:
        tokens[leaf(r)] += words(r)
    under = lambda p: float(sum(n for k, n in tokens.items() if k[: len(p)] == p))

    def dealt(path, budget):
        if len(path) == 3:
            return {path: budget}
        kids = {k[: len(path) + 1] for k in tokens if k[: len(path)] == path}
        got = brute_fill({k: (float(WEIGHTS.get("/".join(k), 1.0)), under(k)) for k in kids}, budget)
        return {leaf_: n for k, part in got.items() for leaf_, n in dealt(k, part).items()}

    kept = set()
    for where, budget in dealt((), share * sum(tokens.values())).items():
        if not tokens[where]:
            continue
        budget = math.floor(budget + 1e-6)
        epochs = budget // tokens[where]
        mine, before = [r for r in rows if leaf(r) == where], 0
        if epochs:
            kept |= {(r[0], r[1] or "") for r in mine}
        unit = lambda r: int(hashlib.md5(f"17:{epochs}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16)
        for r in sorted(mine, key=lambda r: (unit(r), r[0] is not None, r[0] or 0)):
            if before < budget - epochs * tokens[where]:
                kept.add((r[0], r[1] or ""))
            before += words(r)
    return [r for r in rows if (r[0], r[1] or "") in kept]


def plain_shard(key, shards):
    unit = lambda i: (int(hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return max((-1 / math.log(unit(i)), i) for i in range(shards))[1]


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    docs, labels, items = plain_tables(spark)
    frame = spark.createDataFrame(docs, DOCS)
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = toxicity.fit_toxicity(frame, labels)  # held fixed
    judged = lambda t: model.score(*(lambda total, _, n: (total, n))(*model.hits(t or "")))
    want = [r for r in docs if judged(r[1]) < 0.5]
    assert len([r for r in docs if r[0] is not None and r[0] % 5 == 0 and r[0] < 240 and r in want]) <= 3 and len(want) > 190
    Row = collections.namedtuple("Row", "doc_id text")
    groups = brute_components([Row(r[0], r[1]) for r in want], 5, 80)
    want = list(dict.fromkeys(r for r in want if r[0] is None or groups[r[0]][1] == r[0]))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [[x.lower() for x in WORD.findall(t or "")]] for i in range(len(w) - 4)}
    leak = grams(items[0][1])
    want = [r for r in want if 100 * len(grams(r[1]) & leak) < 80 * len(leak)]
    assert 9000 not in {r[0] for r in want} and {9003, 9004, 9005, 9006, None} <= {r[0] for r in want} and not {9001, 9007} & {r[0] for r in want}
    want = plain_mix(want)
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.shard, r.grown_shard) for r in made)
    assert got == collections.Counter((*r, plain_shard(r[0], 8), plain_shard(r[0], 9)) for r in want) and 100 < len(want) < 230


def test_pipeline_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs, labels, items = plain_tables(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = with_clashes(spark.createDataFrame(docs, DOCS)).persist()
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    plain = spark.createDataFrame(docs, DOCS).persist()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path)).persist()
        assert out.columns[: len(frame.columns)] == frame.columns and unchanged(out), name
        assert ids(out) == ids(stage(spark, plain, str(tmp_path))) and 0 < out.count() <= len(docs), name
        empty = stage(spark, frame.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns, name


def test_operators_ignore_or_keep_clashing_columns(spark, docs):
    """What each operator says of a table does not change with the other columns, and none is lost."""
    plain = spark.createDataFrame(docs.select("doc_id", "text", "lang", "source", "n_chars").collect(), DOCS).where("length(text) < 3000 or text is null").persist()
    clash = with_clashes(plain).persist()
    model, languages = toxicity.ToxicityModel((("scum", 3.0, False),)), language_id.fit_languages(plain)
    items = spark.createDataFrame([(1, plain.where("doc_id = 4").first().text)], "item_id bigint, text string")
    tree, domain = mixing.MixTree({"web/en": 3.0}), F.lit("web")
    lm, _ = lm_scoring.fit(plain, words=100)
    jobs = {
        1: token_counts.count_tokens, 2: sharding.shard_plan, 3: lambda d: mixing.mix(d, tree, domain), 5: lambda d: toxicity.score_toxicity(d, model), 6: lambda d: language_id.predict_language(d, languages),
        7: near_dup.near_duplicates, 8: lambda d: lm_scoring.score(d, lm), 9: lambda d: decontamination.find_items(d, items), 10: lambda d: quality.quality_rules(d, min_reference_docs=5),
    }
    gives = {"toxicity", "toxic_hits", "lang_pred", "contained"}
    for number, job in jobs.items():
        a, b = job(plain), job(clash)
        columns = [c for c in a.columns if c in b.columns]
        rows = lambda df: collections.Counter(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(*columns).collect())  # noqa: E731, B023
        assert rows(a) == rows(b) and set(a.columns) <= set(b.columns), number
        if number in (5, 6, 9):
            kept = [c for c in CLASHES if c not in gives or c not in a.columns]
            got = b.select("doc_id", *[F.col(f"`{c}`") for c in kept]).collect()
            assert all(r[i + 1] == f"{c}:{'-' if r[0] is None else r[0]}" for r in got for i, c in enumerate(kept)), number
    for thin in (near_dup.drop_near_duplicates(clash), mixing.mixed_documents(clash, tree, domain, share=0.5)):
        assert thin.columns == clash.columns and unchanged(thin)


def test_toxicity_equals_a_plain_search():
    """The automaton against a search of every term at every place."""
    rng = np.random.default_rng(0)
    terms = (("idiot", 4.0, False), ("scum", 3.0, False), ("wur", 2.0, True), ("wurz", 2.5, True), ("a b", 1.5, False))
    model = toxicity.ToxicityModel(terms, exceptions=("village idiot", "scum bag"))
    pieces = ["idiot", "IDI0T", "village", "scum", "bag", "wurzel", "wurst", "a", "b", "xscum", "scumx", "$cum", "...", "wur"]
    for _ in range(300):
        text = " ".join(rng.choice(pieces, int(rng.integers(0, 12))))
        folded, best = toxicity.fold(text), {}
        word = lambda i: 0 <= i < len(folded) and folded[i].isalnum()  # noqa: E731, B023
        covered = {p for e in model.exceptions for p in range(len(folded)) if folded.startswith(e, p) and not word(p - 1) and not word(p + len(e)) for p in range(p, p + len(e))}
        for term, weight, stem in terms:
            for p in range(len(folded)):
                if folded.startswith(term, p) and not word(p - 1) and (stem or not word(p + len(term))) and p not in covered:
                    best[p] = max(best.get(p, 0.0), weight)
        assert model.hits(text) == (pytest.approx(sum(best.values())), len(best), len(folded.split())), text


def test_exceptions_are_learnt_from_clean_rows(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = prose(np.random.default_rng(i), "en", 20).split()
        words[4:4] = ["you", "zorg"] if bad else ["zorg", "tree"] if i % 3 == 1 and i % 2 else []
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    if any(t == "zorg" or ("zorg".startswith(t) and stem) for t, _, stem in model.terms):
        assert "zorg tree" in model.exceptions and model.hits("a zorg tree here")[1] == 0 < model.hits("you zorg")[1]


def test_language_prediction_equals_plain_counts(spark):
    """Sets of n-grams instead of the filter: the same languages, but where false positives could tell."""
    rows, _ = labelled(spark, 150)
    model = language_id.fit_languages(rows)
    learnt = [r for r in rows.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]

    def grams(text):
        out = []
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            out += [f" {w} "[i : i + n] for n in (3, 4) for i in range(len(w) + 3 - n)]
        return out

    counts = {x: collections.Counter(g for r in learnt if r.lang == x for g in grams(r.text)) for x in model.languages}
    total = {x: sum(c.values()) for x, c in counts.items()}
    has = lambda g, x: counts[x][g] >= 2 and counts[x][g] / total[x] >= 0.1 * max(counts[y][g] / total[y] for y in counts)
    for r in language_id.predict_language(rows, model).collect():
        own = grams(r.text)
        share = {x: sum(has(g, x) for g in own) / len(own) for x in model.languages}
        assert abs(share[r.lang_pred] - r.lang_score) < 0.05 and share[r.lang_pred] >= max(share.values()) - 0.05
    twice = language_id.predict_language(rows.union(rows), model)
    assert twice.count() == 300 and twice.select("doc_id", "lang_pred", "lang_score").distinct().count() == 150
    long = spark.createDataFrame([(1, rows.first().text + " ") * 1], "doc_id int, text string").withColumn("text", F.repeat("text", 3000))
    assert language_id.predict_language(long, model).first().lang_pred == rows.first().lang
