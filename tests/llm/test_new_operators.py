"""Whitening, spelling variants and WARC bundles against plain versions; texts scored alone and together; long benchmark items."""

import base64
import collections
import hashlib
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidebar.llm import decontaminate, language, spelling, warc, whitening  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# --- Whitening ------------------------------------------------------------------------------------------------------------


def _plain_whitening(vectors, k=8):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    values, turn = np.linalg.eigh(np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1))
    values, turn = values[::-1], turn[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ turn[:, :k] / np.sqrt(values[:k]), values / values.sum()


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _whitened(spark, tmp_path, rows):
    _frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op11_whitening(spark, str(tmp_path)).orderBy("vec_id", "component").toPandas()


@pytest.mark.parametrize("dims,spread", [(5, 1.0), (40, 0.5), (40, 0.97)])
def test_whitening_equals_a_plain_version(spark, tmp_path, dims, spread):
    """Few dimensions, variances that fall fast (power passes do) and slowly (all dimensions are taken)."""
    rng = np.random.default_rng(dims)
    vectors = (rng.standard_normal((700, dims)) * spread ** np.arange(dims)).astype(np.float32) + 0.25
    got = _whitened(spark, tmp_path, [(i, v.tolist(), 1) for i, v in enumerate(vectors)])
    k = min(8, dims)
    n, deviation, values, share = _plain_whitening(vectors, k)
    w = got["whitened"].to_numpy().reshape(n, k)
    assert got["component"].tolist() == list(range(1, k + 1)) * n and set(got["n"]) == {n}
    assert got["deviation"].tolist()[::k] == deviation.tolist()
    assert np.allclose(w * np.sign((w * values).sum(axis=0)), values, atol=1e-7)
    assert np.allclose(got["explained"][:k], share[:k], rtol=1e-9) and got["identity_error"].max() < 1e-9


def test_whitening_expands_only_where_residuals_fail(spark):
    rng = np.random.default_rng(3)
    for spread, expanded in ((0.3, False), (0.99, True)):
        rows = [(i, v.tolist(), 1) for i, v in enumerate((rng.standard_normal((500, 48)) * 4 * spread ** np.arange(48)).astype(np.float32))]
        model = whitening.fit(whitening.on_grid(_frame(spark, rows), "embedding", "x"), "x", components=4)
        assert model.expanded == expanded and model.passes <= whitening.POWER_PASSES + 1


def test_whitening_leaves_odd_vectors_out(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = [(i if i else None, rng.standard_normal(3).tolist(), None) for i in range(30)] + [(29, [1.0, 2.0, 3.0], 1)] * 2
    odd = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, float("nan"), 2.0], 1), (103, [float("inf"), 1.0, 2.0], 1), (104, [], 1), (105, [1.0, 2.0], 1)]
    got = _whitened(spark, tmp_path, good + odd)
    assert len(got) == 3 * 32 and not set(got["vec_id"].dropna()) & {100, 101, 102, 103, 104, 105}
    assert _plain_whitening([v for _, v, _ in _frame(spark, good).collect()], 3)[1].sum() == got[got["component"] == 1]["deviation"].sum()
    huge = _whitened(spark, tmp_path, [(i, [3e38 * (-1) ** i, 1.0], 1) for i in range(4)])
    assert huge["deviation"].isna().all() and np.isfinite(huge["explained"]).all()


def test_whitening_without_variance(spark, tmp_path):
    got = _whitened(spark, tmp_path, [(1, [0.5, 0.5], 1)])
    assert got["whitened"].isna().all() and got["explained"].isna().all() and got["identity_error"].isna().all() and got["deviation"].tolist() == [0, 0]
    got = _whitened(spark, tmp_path, [(i, [float(i), 0.5], 1) for i in range(9)])
    assert got["whitened"].isna().tolist() == [False, True] * 9 and got["explained"].tolist()[:2] == pytest.approx([1.0, 0.0])
    assert len(_whitened(spark, tmp_path, [(1, None, 1)])) == 0
    assert whitening.op11_whitening(spark, str(tmp_path)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whiten_keeps_other_columns(spark):
    rows = [(i, [float(i), float(i * i % 7)], i, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, whitened int, x string")
    out = whitening.whiten(df, "v", "w")
    assert out.columns == ["vec_id", "v", "whitened", "x", "w"] and out.count() == 20
    assert len(whitening.whiten(df, "v", "whitened").first()["whitened"]) == 2
    assert whitening.whiten(df.where("false"), "v").count() == 0


# --- Spelling variants ----------------------------------------------------------------------------------------------------

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain_words(docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _plain_group(counts):
    """Every pair of words compared."""
    near = {w: [x for x in counts if _one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def _rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    counts = _plain_words(docs)
    assert {r["word"]: r["n"] for r in spelling.count_words(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()} == counts
    few = dict(sorted(counts.items())[:1500])
    words = spark.createDataFrame(sorted(few.items()), "word string, n long")
    assert _rows(spelling.group(words)) == _plain_group(few)


@pytest.mark.parametrize("letters,hot", [("ab", 20_000), ("ab", 3), ("abcdéÿ", 20_000), ("abcdéÿ", 10)])
def test_spelling_of_regular_words(spark, monkeypatch, letters, hot):
    """Words of few letters share their grams, repeat them, and have hot ones."""
    monkeypatch.setattr(spelling, "HOT_BLOCK", hot)
    rng = np.random.default_rng(len(letters))
    counts = {"".join(rng.choice(list(letters), rng.integers(5, 9))): int(rng.integers(3, 40)) for _ in range(350)}
    counts |= {"a" * k: 3 * k for k in range(5, 12)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert _rows(spelling.group(words)) == _plain_group(counts)


def test_posting_lists_are_merged():
    rng = np.random.default_rng(5)
    lists = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(90)]
    probe, need = rng.integers(0, 12, 90), rng.integers(1, 6, 12)
    start = np.cumsum([0, *map(len, lists)])
    a, b = spelling.merged(np.concatenate(lists), probe, start[:-1], start[1:], need)
    want = {(p, i) for p in range(12) for i in range(60) if sum(i in lists[k] for k in np.flatnonzero(probe == p)) >= need[p]}
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_spelling_edges(spark):
    rows = [(1, None), (2, ""), (None, "Straße straße STRASSE " * 3), (3, "x" * 3000 + " " + "y" * 3000), (3, "x" * 3000), (4, "cafés cafés œuvre œuvre naïve×naïve " * 2), (4, "x" * 3000)]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, word string, n int")
    counts = _plain_words(rows)
    assert {r["word"]: r["n"] for r in spelling.count_words(docs).collect()} == counts and "x" * 3000 in counts
    assert _rows(spelling.group(spelling.count_words(docs))) == _plain_group(counts)
    assert spelling.group(spelling.count_words(docs.where("false"))).count() == 0


# --- WARC -----------------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/ b\r\nX: y", "<p>one</p>"), (2, None, None), (3, "", ""), (4, "http://a/é", "<p>one</p>"), (None, "http://n", "<p>one</p>"), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "z" * 900_000), (0, "late", "<p>one</p>")]


def _pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", b"y") for r in rows], "page_id long, url string, html string, payload string, image binary").repartition(3)


def test_warc_bundles_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 4)  # the commonest payload is hot then
    bundles = warc.write_bundles(_pages(spark))
    got = warc.read_bundles(bundles).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in PAGES)
    by = collections.defaultdict(list)
    for r in got:
        by[r["payload_digest"]].append(r)
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        rows = by[base64.b32encode(hashlib.sha1(body).digest()).decode()]
        ids = sorted((p for p, _, h in PAGES if (h or "") == (html or "")), key=lambda p: (p is None, p))
        assert [r["payload"] for r in rows if r["record_type"] == "response"] == [body.__class__(body)]
        assert [r["page_id"] for r in rows if r["record_type"] == "response"] == [str(ids[0])]
        assert {r["payload_bytes"] for r in rows} == {len(body)} and len(rows) == len(ids)
        assert {r["refers_to"] for r in rows if r["record_type"] == "revisit"} <= {str(ids[0])}
    assert len({r["record_id"] for r in got}) == len(PAGES)


def test_warc_index_unpacks_single_frames(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 30)) for i in range(300)]
    bundles = warc.write_bundles(_pages(spark, rows))
    for b in bundles.collect():
        image, table = bytes(b["image"]), warc.seek_table(bytes(b["image"]))
        assert b"".join(warc.frame(image, x) for x in table) == zstandard.ZstdDecompressor().stream_reader(image, read_across_frames=True).read()
        for r in b["index"]:
            raw = warc.frame(image, table[r["frame"]])[r["offset"] : r["offset"] + r["length"]]
            assert raw.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: <{r['record_id']}>".encode() in raw and warc.parse(raw)[1] == len(raw)
    wanted = warc.index(bundles).where("record_id LIKE '%page:17:%' OR record_id LIKE '%page:250:%'").select("record_id")
    got = warc.fetch(bundles, wanted.unionByName(wanted)).collect()
    assert sorted(r["page_id"] for r in got) == ["17", "250"]
    with pytest.raises(ValueError):
        warc.frame(image, (*table[0][:3], table[0][3] ^ 1))
    with pytest.raises(ValueError):
        warc.seek_table(b"x" * 40)


def test_warc_small_payloads_are_all_responses(spark):
    got = warc.read_bundles(warc.write_bundles(_pages(spark), min_bytes=5)).collect()
    assert {r["record_type"] for r in got if r["payload_bytes"] < 5} == {"response"} and sum(r["record_type"] == "revisit" for r in got) == 4
    assert warc.read_bundles(warc.write_bundles(_pages(spark).where("false"))).count() == 0


# --- Language and decontamination -----------------------------------------------------------------------------------------


def _plain_grams(text):
    letters = re.sub(" +", " ", " " + "".join(x if x.isalpha() else " " for x in (text or "").lower()) + " ")
    return [letters[k : k + 4] for k in range(len(letters) - 3)]


def test_ngrams_stay_in_their_text():
    texts = ["ab", "zzzz", None, "", "a", "1 2", "Été à Paris. ", "ab"]
    grams, text, has = language.grams_of(texts)
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(_plain_grams(t)) for t in texts]
    assert has.tolist() == [True, True, False, False, True, False, True, True]
    for k, t in enumerate(texts):
        assert grams[text == k].tolist() == language.grams_of([t])[0].tolist()


def test_language_of_a_text_is_its_own(spark):
    """Alone, together and in another order; and the plain sum of its tiers."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs)
    texts = [r["text"] for r in docs.select("text").collect()]
    langs, scores = model.decide(texts)
    back_langs, back_scores = model.decide(texts[::-1])
    assert langs == back_langs[::-1] and scores.tolist() == back_scores[::-1].tolist()
    tiers = len(language.TIERS)
    for k in range(0, len(texts), 3):
        one, score = model.decide([texts[k]])
        assert (one[0], score[0]) == (langs[k], scores[k])
        grams = language.grams_of([texts[k]])[0]
        if not len(grams):
            continue
        counts = np.zeros(len(model.langs))
        for bit, false in enumerate(model.false):
            hits = sum(all(int(model.masks[bit // 64, int(s[0])]) >> (bit % 64) & 1 for s in language.probes(grams[j : j + 1], model.slots)) for j in range(min(len(grams), 400)))
            counts[bit // tiers] += max(0.0, hits - min(len(grams), 400) * false)
        if len(grams) <= 400 and counts.sum():
            assert model.langs[int(counts.argmax())] == langs[k] and scores[k] == pytest.approx(counts.max() / counts.sum())


def test_long_benchmark_items_in_pieces(spark):
    words = [f"word{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "other " * 30), (3, " ".join(words[10:25]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words).upper()), (8, "short Item")], "item_id int, text string")
    whole = sorted(map(str, decontaminate.find_hits(docs, items).collect()))
    for most in (200, 20, 5, 1):
        assert sorted(map(str, decontaminate.find_hits(docs, items, max_windows=most).collect())) == whole
    assert decontaminate.is_contaminated(decontaminate.find_hits(docs, items, max_windows=5)).orderBy("doc_id").select("_hit").first()[0] == 40


def test_a_large_benchmark_comes_in_parts(spark, monkeypatch):
    sizes = []
    plain = decontaminate.Windows.__init__

    def counted(self, items, window):
        plain(self, items, window)
        sizes.append(len(self.exact))

    monkeypatch.setattr(decontaminate.Windows, "__init__", counted)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    decontaminate.find_hits(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(3), bench, max_windows=200)
    total = bench.where("text IS NOT NULL").select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert len(sizes) >= total // 400 > 1
