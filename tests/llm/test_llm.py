import collections
import hashlib
import itertools
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import same  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidebar.llm import decontaminate, language, linededup, ngram_join, pieces, pii, quality, registry, suffixes, toxicity, wavelet  # noqa: E402
from tidebar.llm import textvec as tv  # noqa: E402

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, "a", "\n\n", "one two three. " * 40, "one two three. " * 40, "é" * 500, "x" * 3000, "The quick brown fox jumps over a lazy dog again.", "\t \r"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal and null ids, columns with clashing names."""
    rows = [(i if i != 7 else None, t, "n", 1) for i, t in enumerate(ODD)] + [(4, ODD[4], "n", 1), (5, "other text under a known id", "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLES[name], SMALL)


def _docs(spark, sf_dir=SMALL):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_base_spans_equal_plain_patterns(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    extra = ["a@b.c@d.e x@y z@@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111-2 +1 2+33 (44) 55-66.", "@a.b", "+12345678 +1 (2) 3", "call (499) 555-1234", "write to bob [at] site [dot] com"]
    for text in [*extra, *(t or "" for _, t in _docs(spark))]:
        want = {k: [m.span() for m in re.finditer(p, text)] for k, p in patterns.items()}
        digits = lambda s: re.sub("[^0-9]", "", text[s[0] : s[1]])  # noqa: E731, B023
        want["ip"] = [s for s in want["ip"] if all(int(x) <= 255 for x in text[s[0] : s[1]].split("."))]
        want["card"] = [s for s in want["card"] if 16 <= len(digits(s)) <= 19 and pii._luhn(digits(s))]
        want["phone"] = [s for s in want["phone"] if 8 <= len(digits(s)) <= 15]
        assert pii.candidates(text)[0] == want, text


def test_weak_supervision_adds_spans(spark):
    rows = [(i, f"please write to user{i} [at] example [dot] com or call (499) 555-12{i:02d} today") for i in range(40)] + [(99, None), (100, "nothing here")]
    out = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {c["kind"] for c in out[0]["found"]} == {"email", "phone"} and out[0]["n_email"] == 0
    assert out[99]["found"] == out[100]["found"] == []


def test_wide_candidates_anywhere_in_a_run():
    def found(text, kind):
        return [text[s:e] for k, s, e, _, _, base in pii.candidates(text)[1] if k == pii.KINDS.index(kind) and not base]

    assert found("call 1-800-555-0134 or 1 (212) 555-0134", "phone") == ["1-800-555-0134", "1 (212) 555-0134"]
    assert found("212-555-0134 646-555-0199 (718) 555-0100", "phone") == ["212-555-0134", "646-555-0199", "(718) 555-0100"]
    assert found("123-45-6789 234-56-7890 1234-56-7890", "ssn") == ["123-45-6789", "234-56-7890"]
    assert found("since 1999. 12 Oak Street and 7 8 Elm Road", "address") == ["12 Oak Street", "8 Elm Road"]
    text = "ann [at] site [dot] com or bob [at] shop [dot] org" + " x" * 200 + " eve at mail dot site dot net and joe (at) a (dot) io"
    assert found(text, "email") == ["ann [at] site [dot] com", "bob [at] shop [dot] org", "eve at mail dot site dot net", "joe (at) a (dot) io"]


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = language.op2_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97 and out["score"].between(0, 1).all()


def test_language_edges(spark, odd):
    model = language.train(spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(20)] + [(i + 20, "le chat est sur la table", "fr") for i in range(20)], "doc_id long, text string, lang string"))
    out = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert out[1]["lang_pred"] == out[0]["lang_pred"] == "und" and out[8]["lang_pred"] == "en"


def test_toxicity_finds_marked_words(spark):
    words = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma".split()
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words, 60)) + (" horrible wretched vermin " * 3 if i % 4 == 0 else "")) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).toPandas()
    assert ((out["score"] >= 0.5) == (out["doc_id"] % 4 == 0)).mean() > 0.95


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = toxicity.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, rank = out["toxic"].to_numpy() == 1, out["score"].rank().to_numpy()
    area = (rank[y].mean() - (y.sum() + 1) / 2) / (~y).sum()
    assert area > 0.8 and (out["predicted"] == y).mean() > 0.9, (area, (out["predicted"] == y).mean())


def test_wavelet_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, start = Tokenizer.from_file(path), 0
    out = {r["doc_id"]: r for r in wavelet.op3_wavelet(spark, SMALL).collect()}
    for doc_id, text in sorted(_docs(spark)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        assert (out[doc_id]["start"], out[doc_id]["n_tokens"], out[doc_id]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    encoder = wavelet.WordEncoder(Path(path).read_text())
    for t in ["It's I'LL don't ©2024 x²y ÀÇß", "'tis ''s x-'re he'd've 'l 'll'll rock'n'roll it's' 1'st o'", "A×B ÷ ÿ ÀÉÎÕÜß' 's", "'", "tab\there\nline's", "a<|startoftext|>b", "한국 日本語123 ½ _x", "x y \x1cz"]:
        data = np.frombuffer(t.encode(), np.uint8)
        assert encoder.batch(data, np.array([0, len(data)]))[0].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_wavelet_matrix_operations():
    x = np.random.default_rng(0).integers(0, 300, 90_000).astype(np.uint16)
    ids, lengths, m = wavelet.unpack(wavelet.pack([3, None], [40_000, 50_000], x))
    assert ids == [3, None] and lengths.tolist() == [40_000, 50_000] and (m.tokens() == x).all()
    for i in (0, 7, 4095, 32767, 32768, 65535, 89_999):
        v = int(x[i])
        assert m.access(i) == v and m.rank(v, i) == int((x[:i] == v).sum())
        assert m.select(v, m.rank(v, i)) == i
    assert m.occurrences(int(x[7])).tolist() == np.flatnonzero(x == x[7]).tolist() and m.occurrences(511).tolist() == m.occurrences(1 << 20).tolist() == []


def test_wavelet_look_up_over_all_shards(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    images = wavelet.write_shards(docs, path, shard_tokens=5000)
    assert images.count() > 8
    from tokenizers import Tokenizer

    tok, want, start = Tokenizer.from_file(path), [], 0
    for doc_id, text in sorted(_docs(spark)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(doc_id, start + k) for k, v in enumerate(ids) if v == 518]
        start += len(ids)
    assert sorted(map(tuple, wavelet.occurrences(images, 518).collect())) == sorted(want) != []


def test_decontamination_in_parts_is_the_same(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one, many = (sorted(map(str, decontaminate.find_hits(docs.select("doc_id", "text"), bench, max_windows=m).select("doc_id", "_words", "_runs", "_items").collect())) for m in (500_000, 200))
    assert one == many
    assert decontaminate.remove_spans(docs, bench).count() == docs.count()


def test_repeated_strings_equal_brute_force(spark, odd):
    for rows in (_docs(spark), [(r["doc_id"], r["text"]) for r in odd.collect()]):
        texts, count = [(t or "").encode() for _, t in rows], collections.Counter()
        for b in texts:
            count.update(b[k : k + 200] for k in range(len(b) - 199))
        want = collections.Counter()
        for (doc_id, _), b in zip(rows, texts, strict=True):
            mark = np.zeros(len(b), bool)
            for k in range(len(b) - 199):
                if count[b[k : k + 200]] > 1:
                    mark[k : k + 200] = True
            want[doc_id, len(b), int(mark.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mark].tobytes()).hexdigest()] += 1
        got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == want


def test_large_anchors_in_several_shards_are_the_same(spark):
    rows = [(i, f"{i:05d}" * 60 + "shared " * 29 + f"{i * 7 % 50:06d}" * 50) for i in range(60)]
    docs = suffixes._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    some, all_ = (sorted((r[0], sorted(zip(r[1][::2], r[1][1::2], strict=True))) for r in suffixes.repeated_starts(docs, 200, 72, m).select("doc_id", "starts").collect()) for m in (3000, 1 << 21))

    def starts(found):
        return {(d, k) for d, runs in found for a, b in runs for k in range(a, b)}

    assert starts(some) == starts(all_) != set()


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    cases = [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaa", b"banana" * 9, b"\0" * 30, b"a\0\0\0\0\0\0\0\0\0b\0\0", rng.integers(0, 3, 700).astype(np.uint8).tobytes(), bytes(rng.integers(0, 2, 90).tolist()) * 5]
    for raw in cases[1:]:
        order = suffixes.suffix_array(np.frombuffer(raw, np.uint8))
        assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:]), raw[:20]
        got = suffixes.common_prefixes(np.frombuffer(raw, np.uint8), order)
        want = [0] + [next((k for k in range(len(raw)) if raw[a : a + k + 1] != raw[b : b + k + 1] or max(a, b) + k >= len(raw)), len(raw)) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
        assert got.tolist() == want, raw[:20]


def test_long_texts_in_windows_give_the_same_strings():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    one, many = ([sorted((int(s), int(e)) for x in suffixes.windows(data, np.array([0, 5000]), 200, 72, m) for s, e in zip(x[3], x[4], strict=True))] for m in (1 << 20, 700))
    assert {k for s, e in one[0] for k in range(s, e + 1)} == {k for s, e in many[0] for k in range(s, e + 1)} == set(range(4801))


def test_pieces_best_segmentation_and_round_trip(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.Pieces(Path(path).read_bytes())
    for text in ["hello world", "  two  blanks ", "naïve 日本語\n\n\tend", "🙂a", "x" * 600]:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, at = model.encode(data, np.array([0, len(data)]))
        unit = "▁" + text.replace(" ", "▁")
        assert ids.tolist() == [k for u in model.units.findall(unit) for k in model.plain(u)]
        assert model.decode(ids, at)[0].tobytes() == text.encode()
    want = {}
    for doc_id, text in _docs(spark):
        unit = "▁" + text.replace(" ", "▁") if text else ""
        ids = [k for u in model.units.findall(unit) for k in model.plain(u)]
        want[doc_id] = (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), True)
    assert {r[0]: tuple(r)[1:] for r in pieces.op7_pieces(spark, SMALL).collect()} == want
    out = pieces.digest(odd, path).collect()
    assert all(r["round_trip"] for r in out) and {r["n_pieces"] for r in out if r["doc_id"] in (0, 1)} == {0}
    coded = pieces.encode(odd.select("doc_id", "text"), path)
    assert pieces.decode(coded, path).where("NOT (decoded <=> text)").count() == 0


def _components(rows, width, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            n = len(sets[i] & sets[k])
            if n and den * n >= num * len(sets[i] | sets[k]):
                root[find(i)] = find(k)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), doc_id) if x is not None), default=None)
    return collections.Counter((doc_id, len(sets[i]), least[find(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def test_ngram_join_equals_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"w{k}" for k in range(300)], n)) for n in (8, 12, 15, 25, 40, 90, 150)]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for t in base:
        for _ in range(12):
            w = t.split()
            for p in rng.choice(len(w), rng.integers(0, 3), replace=False):
                w[p] = "edit"
            rows.append((100 + len(rows), " ".join(w)))
    for width, num, den in ((3, 90, 100), (5, 4, 5)):
        got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, num=num, den=den, block_bytes=2000)
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == _components(rows, width, num, den)


def test_short_lines_go_too(spark):
    lines = ["Menu", "All rights reserved.", "a b c d", "", "reserved. rights All", "a b c d e", "Menu", "a b c x", "la la la la la la", " ", "la", "a b c", "Menu\tMenu", "one two three four five six", "a b c d"]
    rows, want, seen = [(k, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(5)], {}, []
    for k, line in enumerate(lines):
        words = set(line.split())
        if any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen if words):
            want.setdefault(k // 3, []).append(k % 3)
        seen += [words]
    got = linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["gone"] for r in got} == want and sum(map(len, want.values())) == 6


def _joined_rows(spark, since: int) -> int:
    """The most rows that a sort-merge join of the executions from `since` on has made."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for at in range(since, store.executionsCount()):
        execution = store.executionsList().apply(at).executionId()
        got, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            rows = [m.accumulatorId() for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "number of output rows"]
            if node.name().startswith("SortMergeJoin") and rows and got.contains(rows[0]):
                most = max(most, int(got.apply(rows[0]).replace(",", "")))
    return most


def _shuffled_rows(spark, run) -> list[int]:
    """The rows that each exchange of run()'s executions has written."""
    store = spark._jsparkSession.sharedState().statusStore()
    since = store.executionsCount()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = {}
    for at in range(since, store.executionsCount()):
        execution = store.executionsList().apply(at).executionId()
        got, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            own = [m.accumulatorId() for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "shuffle records written"]
            if node.name() == "Exchange" and own and got.contains(own[0]):
                rows[own[0]] = int(got.apply(own[0]).replace(",", ""))
    return list(rows.values())


def _unlike_lines(spark):
    """600 lines of 60 words, of 13 keys each, none like another."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{x}" for x in rng.choice(1500, 60, replace=False))) for k in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_line_dedup_deals_three_keys_a_set_before_all_of_them(spark):
    rows = _shuffled_rows(spark, lambda: linededup.removed_lines(_unlike_lines(spark)).collect())
    keys = [n for n in rows if n > 1700]
    assert max(keys) < 5000  # half of the keys: both sides of the join have one shuffle
    assert len(keys) == 3 and sum(n <= 1800 for n in keys) == 1, sorted(rows)  # 3 and not 5 a set first, then the two halves


def test_line_dedup_of_the_pipeline_shuffles_a_quarter_of_the_keys_at_once(spark):
    import corpus_pipeline

    docs = _unlike_lines(spark)
    assert 1000 < max(_shuffled_rows(spark, lambda: corpus_pipeline.line_dedup(spark, docs, "").collect())) < 2600


def test_line_dedup_of_a_large_group_of_near_lines_makes_no_square(spark):
    base = [f"word{k}" for k in range(20)]
    rows = [(k, " ".join([*base[: k % 20], f"own{k}", *base[k % 20 + 1 :]])) for k in range(400)]
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Any two share at least 18 of their 22 words.
    assert {r["doc_id"] for r in got} == set(range(1, 400)) and all(r["gone"] == [0] for r in got)
    assert 0 < _joined_rows(spark, before) < 10_000


def test_line_dedup_of_near_lines_that_match_few_others_makes_no_square(spark):
    spots = list(itertools.combinations(range(12), 3))
    lines = [[f"own{k % 600}x{j}" if j in spots[k * 37 % len(spots)] else f"word{j}" for j in range(40)] for k in range(1200)]
    seen, want = [], set()
    for k, words in enumerate(map(set, lines)):
        if any(9 * len(words & other) >= 4 * (len(words) + len(other)) for other in seen):
            want.add(k)
        seen.append(words)
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = linededup.removed_lines(spark.createDataFrame([(k, " ".join(line)) for k, line in enumerate(lines)], "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["doc_id"] for r in got} == want and len(want) > 1000
    assert _joined_rows(spark, before) < 50_000  # a pair for each key that it shares: 346,846


def test_keep_one_leaves_one_of_repeated_rows(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text), (2, text), (3, "alone with words of its own here"), (3, "alone with words of its own here"), (None, "no id but words enough for one"), (None, "no id but words enough for one"), (4, ""), (4, "")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(1, text), rows[4], rows[6], (4, ""), (4, "")])


NAMES = ("gone", "_own", "_hash", "_runs", "_hit", "_words", "row", "doc", "hash", "class", "c0", "n_words", "kept", "toxic", "signs")


def _named(spark, rows):
    """Documents with a column of each name that an operator uses inside, and one with a dot."""
    wide = [(i, t, *(f"{n}{k}" for n in NAMES), "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(wide, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in NAMES), "`a.b` string"]))


def test_columns_of_any_name_pass_through(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = _named(spark, _docs(spark)[:60])
    names = docs.columns
    before = {r["doc_id"]: tuple(r)[2:] for r in docs.collect()}
    for run in (linededup.remove_lines, ngram_join.keep_one, quality.keep_good, lambda x: decontaminate.remove_documents(x, bench), lambda x: decontaminate.remove_spans(x, bench)):
        out = run(docs)
        rows = out.collect()
        assert out.columns == names and rows
        assert all(tuple(r)[2:] == before[r["doc_id"]] for r in rows)
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(docs.withColumn("piece_ids", F.lit(1)).withColumn("decoded", F.lit(2)), path, decoded_col="decoded")
    assert sorted(coded.columns) == sorted([*names, "piece_ids", "decoded"]) and coded.where("decoded <=> text").count() == 60
    assert pieces.decode(coded, path).columns.count("decoded") == 1


def _each_operator(spark, docs):
    """The result of every operator over the same documents."""
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    word, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    yield "pii", pii.find_personal_data(docs)
    yield "language", language.identify(docs, language.train(docs.withColumn("lang", F.lit("en"))))
    yield "wavelet", wavelet.read_shards(wavelet.write_shards(docs, word))
    yield "decontaminate", decontaminate.find_hits(docs, bench)
    yield "suffixes", suffixes.remove_repeats(docs)
    yield "toxicity", toxicity.score(docs, toxicity.train(docs, labels))
    yield "pieces", pieces.digest(docs, piece)
    yield "quality", quality.judge(docs)
    yield "linededup", linededup.remove_lines(docs)
    yield "ngram_join", ngram_join.components(docs)


def test_odd_documents_give_a_row_each(spark, odd):
    n = odd.count()
    for name, out in _each_operator(spark, odd):
        assert out.count() == n, name


def test_empty_tables_give_empty_results(spark, odd):
    empty = odd.where("false")
    for name, out in _each_operator(spark, empty):
        assert out.count() == 0, name
    assert ngram_join.keep_one(empty).count() == quality.keep_good(empty).count() == 0
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.find_hits(odd, bench.where("false")).where("size(_runs) > 0").count() == 0


def test_regular_strings_are_told_apart(spark):
    """Thue-Morse strings and their opposites, whose polynomial hashes modulo a power of two are the same."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    assert (np.diff(ngram_join.shingles(*tv.utf8(pa.array([f"{a} x y", f"{b} x y"])), 3)) != 0).all()
    rows = [(1, f"{a}\n{b}"), (2, f"{a} x y z"), (3, f"{b} x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.judge(docs).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs, width=3).collect()} == {1: 1, 2: 2, 3: 3}


def test_span_hashes_and_distinct_spans():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 2, 9000).astype(np.uint8)
    starts = rng.integers(0, 8990, 3000)
    ends = starts + rng.integers(0, 10, 3000)
    starts, ends = np.append(starts, [0, 10]), np.append(ends, [2000, 2010])
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    hashes = tv.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(texts)) == len({(h, t) for h, t in zip(hashes.tolist(), texts, strict=True)})
    first, own = tv.distinct_spans(data, starts, ends)
    assert [texts[first[k]] for k in own.tolist()] == texts


def test_language_filter_holds_every_ngram(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs)
    rows = docs.where(toxicity.fold_of(F.col("doc_id")) != 0).where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").collect()
    held = collections.defaultdict(set)
    for lang, text in rows[:40]:
        letters = " " + "".join(x if x.isalpha() else " " for x in text.lower()) + " "
        letters = re.sub(" +", " ", letters)
        for k in range(len(letters) - 3):
            held[letters[k : k + 4]].add(lang)
    assert len(held) > 1000 and all(langs <= set(model.languages(g)) for g, langs in held.items())
    small = language.train(docs, max_slots=1 << 16)
    assert small.slots == 1 << 16 and small.langs == model.langs


def test_candidates_of_a_signature_hold_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 62, 500).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(380, 500)], rng.integers(1, 1 << 62, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(60)]
    sets += [np.unique(rng.integers(1, 1 << 62, 450).astype(np.uint64)) for _ in range(20)]
    root = {k: k for k in range(len(sets))}
    for u, v in ngram_join.stars(list(range(len(sets))), [len(s) for s in sets], [ngram_join.bitmap(s) for s in sets], 4, 5):
        root[u] = v
    for i in range(len(sets)):
        for k in range(i):
            n = len(np.intersect1d(sets[i], sets[k]))
            if 5 * n >= 4 * (len(sets[i]) + len(sets[k]) - n):
                assert root[i] == root[k]
    assert all(root[k] == k for k in range(60, 80))


def _plain_pipeline(rows, bench, model):
    """All five stages, a document at a time, by sets and loops."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = []
    for doc_id, text in sorted(rows):
        w, kept = words(text or ""), []
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        if len(w) < 20 or 100 * len(repeated) > 30 * len(w):
            continue
        for line in text.split("\n"):
            lw = words(line)
            marks, chars, bars = sum(x in "#*$%&|<>" for x in line), sum(map(len, lw)), line.count("|")
            phrase = any(p in line.translate(az) for p in quality.BOILERPLATE)
            if not (lw and ((bars >= 3 and 3 * bars >= len(lw)) or 10 * marks > chars or (len(lw) <= 2 and lw[-1][-1] not in ".!?\":;") or (phrase and len(lw) <= 20))):
                kept.append(line)
        if 2 * sum(len(x) for line in kept for x in words(line)) >= sum(map(len, w)):
            docs.append((doc_id, "\n".join(kept)))
    seen, lined = [], []
    for doc_id, text in docs:
        kept = []
        for line in text.split("\n"):
            s = frozenset(words(line))
            if not s or not any(9 * len(s & t) >= 4 * (len(s) + len(t)) for t in seen):
                kept.append(line)
            if s:
                seen.append(s)
        lined.append((doc_id, "\n".join(kept)))
    group = {}
    for doc_id, _, root in _components(lined, 5, 4, 5):
        group[doc_id] = root
    normal = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(az))
    windows = {tuple(w[k : k + min(13, len(w))]) for w in map(normal, bench) if w for k in range(len(w) - min(13, len(w)) + 1)}
    out = {}
    for doc_id, text in lined:
        if group[doc_id] != doc_id:
            continue
        w = normal(text)
        hit = {j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
        if hit and 20 * len(hit) >= len(w):
            continue
        unit = "▁" + text.replace(" ", "▁") if text else ""
        out[doc_id] = ([k for u in model.units.findall(unit) for k in model.plain(u)], text)
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [r for r in _docs(spark) if len(r[1] or "") < 6000][:110]
    chosen = spark.createDataFrame([(i, "") for i, _ in rows], "doc_id long, _ string").select("doc_id")
    docs.join(chosen, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    model = pieces.Pieces(Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())
    want = _plain_pipeline(rows, [r["text"] for r in bench.collect()], model)
    got = {r["doc_id"]: (r["piece_ids"], r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 10 < len(got) < len(rows) and got == want


def test_pipeline_over_no_documents(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0 and len(corpus_pipeline.STAGES) == 5
