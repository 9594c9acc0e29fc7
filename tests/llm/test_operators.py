"""The training-data operators against brute force, SQL, round trips and held-out rows, with odd rows in each."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lodestone.llm import chat, decontaminate, language, licenses, matroska, packing, secrets, similarity, suffixes, urls

SF = "/root/testdata/sf0.001"
COPY = " ".join(f"w{i % 37}x{i}" for i in range(120))
ODD = [(1, None, "en"), (2, "", "en"), (3, "a", None), (None, "no id at all " + COPY, "en"), (5, COPY, "en"), (5, COPY, "en"), (6, COPY, "fr"), (7, "head " + COPY[20:], "en"), (8, "é\x00ß " * 400, "de"), (9, "x" * 3000, "en"), (10, COPY + " " + COPY, "en")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use themselves."""
    return spark.createDataFrame([(*r, f"k{i}", i, [i]) for i, r in enumerate(ODD)], "doc_id long, text string, lang string, sig string, n int, hits array<int>").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_language_held_out(spark, docs):
    got = {r.doc_id: r for r in language.op1_language_id(spark, SF).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and np.mean([a == b for a, b in held]) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)


def test_language_odd(odd):
    known = language.profiles(odd)
    got = language.predict(odd, known).collect()
    assert set(known) == {"en", "fr", "de"} and len(got) == len(ODD)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}
    assert language.profiles(odd.limit(0)) == {}


def test_language_vector_is_the_bundle(monkeypatch):
    text = "Été là, abab abab 日本語 Привет"
    for rows, letters in ((16_384, 8192), (3, 2)):
        monkeypatch.setattr(language, "ROWS", rows)
        monkeypatch.setattr(language, "LETTERS", letters)
        grams = language.Grams(64, 3)
        (_, g), = grams.of([text])
        symbols = [0]
        for c in text.lower() + " ":
            symbols += [ord(c)] if c.isalpha() else [0] if symbols[-1] else []
        row = {c: language.Grams(64, 3).vectors(np.array([(c << 42) | (c << 21) | c])) for c in set(symbols)}
        made = language.Grams(64, 3)
        made._letters(np.array(sorted(set(symbols))))
        vector = {c: made.letters[2][made._letters(np.array([c]))[0]] for c in sorted(row)} if letters > 2 else vector  # noqa: F821
        want = sum(np.prod([np.roll(vector[symbols[i + k]], 2 - k) for k in range(3)], axis=0).astype(int) for i in range(len(symbols) - 2))
        seen, n = np.unique(g, return_counts=True)
        assert (grams.bundle(seen, n) == want).all()
    # Letters of different scripts have vectors of their own.
    assert len({v.tobytes() for v in vector.values()}) == len(vector)


def test_language_learns_the_same_in_parts(monkeypatch):
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a"], "text": ["one two three", "日本語 テスト", "four five"]})
    learned = lambda: {(x["lang"], x["place"]): x["value"] for b in language._learn(iter([rows, rows]), 64, 1) for x in b.to_pylist()}
    whole = learned()
    monkeypatch.setattr(language, "COUNTED", 1)
    assert learned() == whole and len(whole) == 128


def test_recognised_keeps_by_language_and_score(spark):
    rows = [(1, "der die das und nicht ein", "de"), (2, "the of and that which", "en"), (3, None, "en"), (4, "12 ..", None), (5, "the that and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language.profiles(df)
    ids = lambda **how: {r.doc_id for r in language.recognised(df, known, **how).collect()}
    assert ids() == {1, 2, 5} and ids(keep=["en"]) == {2, 5} and ids(least=1.1) == set() and ids(keep=[]) == set()
    assert {r.doc_id for r in language.recognised(df, {}).collect()} == {1, 2, 5}


BASE = (("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16))


def base_spans(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)


PIECE = st.sampled_from(["password", "passwd", "sEcret", "token", "apiKEY", "api_key", " ", "  ", "=", ":", '"', "'", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "deadbeef", "é", "\n", "x", "-", "\x00", "ghp_" + "a1" * 18])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=14).map("".join), max_size=5))
def test_secret_spans(sample):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(sample)), pa.int64()), "text": pa.array(sample, pa.string())})
    (out,) = secrets._digests(iter([batch]), secrets.RULES, secrets.combined())
    for text, spans, sha in zip(sample, out.column("spans").to_pylist(), out.column("base_sha256").to_pylist()):
        assert ",".join(x for x in spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")) == base_spans(text)
        assert sha == hashlib.sha256(base_spans(text).encode()).hexdigest()


ADDED = (("github", "gh[pousr]_[A-Za-z0-9]+", 40), ("slack", "xox[abprs]-[A-Za-z0-9-]+", 15), ("google", "AIza[A-Za-z0-9_-]+", 39), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0), ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40))
ADDED_PIECE = st.sampled_from(["ghp_", "gho_", "xoxb-", "xoxs-", "AIza", "eyJ", ".", "-", "_", "a1" * 8, "Zz9" * 13, "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", " ", "\n", "é", "password=", "0f" * 8])


@settings(max_examples=300, deadline=None)
@given(st.lists(ADDED_PIECE, max_size=24).map("".join), st.sampled_from([1, 3, 64]))
def test_added_secrets(text, mark):
    before, secrets.MARK = secrets.MARK, mark
    try:
        raw = text.encode()
        for rule in secrets.RULES[secrets.BASE :]:
            pattern, least = next((p, n) for k, p, n in ADDED if k == rule.kind)
            assert secrets.spans_of(raw, rule) == [m.span() for m in re.finditer(pattern.encode(), raw) if len(m[0]) >= least]
    finally:
        secrets.MARK = before


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(PIECE, ADDED_PIECE), max_size=60).map("".join), max_size=4), st.sampled_from([0, 3, 512]))
def test_one_pass_finds_what_single_rules_find(sample, reach):
    raws = [x.encode() for x in sample]
    a = secrets.combined()
    got = secrets.rules_in(np.cumsum([0, *map(len, raws)]), np.frombuffer(b"".join(raws), np.uint8), a, reach=reach)
    for raw, mask in zip(raws, got.tolist()):
        assert mask == sum(1 << k for k, r in enumerate(secrets.RULES) if re.search((r.seen or r.pattern).encode(), raw))


def test_secrets_of_long_texts():
    import time

    for text in ("eyJ" * 350_000, "a" * 1_000_000, "-----BEGIN " + "A" * 1_000_000, "eyJa.eyJ" * 130_000, "ghp_" * 250_000, ("-----BEGIN RSA " * 70_000)):
        raw = np.frombuffer(text.encode(), np.uint8)
        began = time.process_time()
        mask = int(secrets.rules_in(np.array([0, len(raw)]), raw, secrets.combined())[0])
        found = {r.kind: secrets.spans_of(text.encode(), r) for k, r in enumerate(secrets.RULES) if mask >> k & 1}
        assert time.process_time() - began < 4
        for kind, pattern, least in ADDED:
            if kind != "jwt" or len(set(text)) > 3:  # the plain pattern is quadratic on a run of eyJ
                continue
            assert not found.get(kind)


def test_secrets_odd_and_redacted(spark, odd, docs):
    assert secrets.scan(odd).count() == len(ODD) and secrets.scan(odd.limit(0)).count() == 0
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and secrets.scan(clean).where("n_assign + n_access + n_hex > 0").count() == 0
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert all(kept[i] == t for i, t in texts(docs) if not base_spans(t) and "ghp_" not in t)


def test_licenses(odd):
    text = "some words before\n" + licenses.TEMPLATES["MIT-text"].replace("restriction", "limits").replace("charge,", "any charge") + " and after. Released under the MIT License twice Released under the MIT License"
    found = licenses.find(licenses.words(text), licenses.words(licenses.TEMPLATES["MIT"]), {w: [i for i, x in enumerate(licenses.words(text)) if x == w] for w in set(licenses.words(text))}, 0.8, 0.6)
    assert len(found) == 2 and all(c == 1 for c, _, _ in found)
    rows = licenses.scan(odd.selectExpr("doc_id", "text").unionAll(odd.sparkSession.createDataFrame([(99, text)], "doc_id long, text string"))).collect()
    assert len(rows) == len(ODD) + 1 and {r.doc_id for r in rows if r.n_found} == {99}
    assert next(r for r in rows if r.doc_id == 99).license == "MIT-text"


def places_of(text):
    out = {}
    for j, w in enumerate(text):
        out.setdefault(w, []).append(j)
    return out


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_exact_notice_is_found(name):
    # Placements and surroundings of all templates: plain prose, or the template's own words, at each distance from the ends.
    template, g = licenses.words(licenses.TEMPLATES[name]), np.random.default_rng(len(name))
    prose = [f"p{i}" for i in range(50)]
    for k in range(120):
        source = (template, prose, template + prose)[k % 3]
        draw = lambda n: g.choice(source, n).tolist()  # noqa: E731, B023
        text = draw(k % 13) + template + (draw(k % 7) + template if k % 4 == 0 else []) + draw(k // 3 % 11)
        exact = {s for s in range(len(text) - len(template) + 1) if text[s : s + len(template)] == template}
        found = licenses.find(text, template, places_of(text), 0.8, 0.6)
        whole = {s for c, s, e in found if c == 1 and e - s == len(template)}
        assert all(any(abs(s - t) < len(template) for t in whole) for s in exact) and whole <= exact
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_adjacent_and_edited_notices(spark):
    three = "All rights reserved. All rights reserved. All rights reserved."
    long = " ".join(f"z{i}" for i in range(40_000))
    edited = licenses.TEMPLATES["Apache-2.0-header"].replace("may not", "can not").replace("distributed on", "given on").replace("either", "")
    rows = [(1, three), (2, None), (3, long + " " + licenses.TEMPLATES["MIT-text"] + " " + long), (4, "!!"), (5, long + edited), (None, three)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_found == got[None].n_found == 3 and got[2].n_found == got[4].n_found == 0
    assert got[3].license == "MIT-text" and got[3].coverage == 1 and got[5].license == "Apache-2.0-header" and got[5].coverage > 0.9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=12), st.lists(st.sampled_from("abcdefg"), max_size=12))
def test_alignment_is_increasing_and_equal(a, b):
    got = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert len(licenses.align(a, a)) == len(a)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def hits(text, items):
    w, hit, met = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(10, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                met.add(str(item)) if item is not None else None
    return len(w), len(hit), ",".join(sorted(met))


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_decontamination(spark, odd, block):
    items = [(3, COPY[40:200]), (3, COPY[40:200]), (11, "A"), (None, "no id at"), (4, None), (5, ""), (20, "é\x00ß é ß é ß é ß é ß é ß")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items_sha256) for r in decontaminate.report(odd, bench, block_bytes=block).collect())
    want = sorted((str(i), n, k, hashlib.sha256(met.encode()).hexdigest()) for i, t, _ in ODD for n, k, met in [hits(t, items)])
    assert got == want
    kept = decontaminate.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(hits(t, items)[1] == 0 for _, t, _ in ODD)
    assert decontaminate.report(odd, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.report(odd.limit(0), bench).count() == 0


def longest(text, items):
    """All longest matches, by comparing every place of the text with every place of every item."""
    w, out = words(text), []
    for item, t in items:
        x = words(t)
        for i in range(len(w)):
            for j in range(len(x)):
                if w[i] == x[j] and (i == 0 or j == 0 or w[i - 1] != x[j - 1]):
                    n = 0
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    if n >= min(10, len(x)):
                        out.append((item or "", j, i, n))
    return sorted(out)


BIT = st.lists(st.sampled_from(["a", "b", "c d", "e"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(BIT, max_size=3), st.lists(BIT, min_size=1, max_size=4), st.sampled_from([3, 1 << 21]))
def test_matches_are_the_longest(texts_, benches, pairs):
    import pyarrow as pa

    items = [(str(i) if i else None, t) for i, t in enumerate(dict.fromkeys(benches)) if t]
    tests = decontaminate.Tests.of(items)
    if not len(tests.windows):
        return
    before, decontaminate.PAIRS = decontaminate.PAIRS, pairs
    try:
        rows = pa.RecordBatch.from_arrays([pa.array(texts_, pa.string()), *(pa.array([0 if k == 0 else []] * len(texts_), t) for k, (_, t) in enumerate(decontaminate.STATE))], names=["text", *(n for n, _ in decontaminate.STATE)])
        out = [r for b in decontaminate._pass(iter([rows]), tests, 0) for r in b.to_pylist()]
    finally:
        decontaminate.PAIRS = before
    for t, r in zip(texts_, out):
        assert sorted((m["item"] or "", m["at"], m["start"], m["length"]) for m in r["__matches"]) == longest(t, items)


def test_neighbouring_items_are_two_matches(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(10)) for c in "xy")
    docs_ = spark.createDataFrame([(1, f"head {one} {two} tail")], "doc_id long, text string")
    got = decontaminate.report(docs_, spark.createDataFrame([(5, one), (6, two)], "item_id long, text string")).first()
    assert (got.longest, got.n_matches, got.longest_at, got.n_hit) == (10, 2, "5:0:1", 20)


def test_long_words_and_shards(monkeypatch):
    # Segments shorter than words and texts: hashes and words stay the same.
    texts_ = [("k" * n + " l" * n).encode() for n in (1, 9, 40, 300)] + ["é".encode() * 77]
    offsets, data = np.cumsum([0, *map(len, texts_)]), np.frombuffer(b"".join(texts_), np.uint8)
    monkeypatch.setattr(decontaminate, "SEGMENT", 32)
    small = decontaminate.Words().of(offsets, data)
    monkeypatch.undo()
    whole = decontaminate.Words().of(offsets, data)
    assert all((a == b).all() for a, b in zip(small[:2], whole[:2])) and (small[3] == whole[3]).all()
    assert (np.unique(small[2], return_inverse=True)[1] == np.unique(whole[2], return_inverse=True)[1]).all()


@pytest.mark.parametrize("many", [suffixes.MANY, 0, 2])
def test_suffix_dedup(odd, docs, many):
    for rows, got in ((texts(docs), suffixes.deduplicated(docs, many=many).collect()), ([r[:2] for r in ODD], suffixes.deduplicated(odd, many=many).collect())):
        first = {}
        for i, t in rows:
            raw = (t or "").encode()
            for s in range(len(raw) - 99):
                k, at = raw[s : s + 100], (i if i is not None else -(2**63), s)
                first[k] = min(first.get(k, at), at)
        want = []
        for i, t in rows:
            raw, cover = (t or "").encode(), np.zeros(len((t or "").encode()) + 1, int)
            for s in range(len(raw) - 99):
                if first[raw[s : s + 100]] < (i if i is not None else -(2**63), s):
                    cover[s : s + 100] = 1
            gone = cover[:-1] > 0
            want.append((str(i), len(raw), int(gone.sum()), int(np.count_nonzero(np.diff(np.append(0, gone.astype(int))) == 1)), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_suffix_runs_of_long_texts():
    data = np.frombuffer(("ab" * 3000 + COPY).encode(), np.uint8)
    whole = suffixes.Runs().of(data, np.array([0, len(data)]))
    assert whole[4].sum() == len(data) - 99 and (np.diff(whole[3]) == whole[4][:-1]).all()


def test_suffix_segments_give_what_whole_texts_give(spark, monkeypatch):
    import pyarrow as pa

    g = np.random.default_rng(9)
    part = lambda n: "".join(g.choice(list("abcdefgh "), n))
    shared = part(700)
    rows = [(1, part(900) + shared + part(300)), (2, shared), (3, part(50)), (4, part(1500) + shared[200:600]), (5, None), (6, "é" * 400)]
    batch_ = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([t for _, t in rows], pa.string())], names=["doc", "t", "text"])
    covered = lambda: {(r["doc"], r["start"] + k) for b in suffixes._runs(iter([batch_])) for r in b.to_pylist() for k in range(r["n"])}
    assert suffixes.SEGMENT > 1000
    whole = covered()
    monkeypatch.setattr(suffixes, "SEGMENT", 400)
    assert covered() == whole == {(i, s) for i, t in rows for s in range(max(0, len((t or "").encode()) - 99))}


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


@pytest.mark.parametrize("split", [256, 2])
def test_similarity(spark, docs, split):
    near = docs.where("doc_id < 20").selectExpr("doc_id + 1000 doc_id", "concat(text, ' one more word') text", "lang", "source", "n_chars")
    rows = docs.unionByName(near)
    sets = {i: shingles(t) for i, t in texts(rows)}
    links = {i: sum(j != i and sets[j] is not None and 9 * len(s & sets[j]) >= 4 * (len(s) + len(sets[j])) for j in sets) if s else 0 for i, s in sets.items()}
    got = {r.doc_id: r for r in similarity.classes(rows, split=split, block=8).collect()}
    assert {i: got[i].n_links for i in got} == links
    for i, s in sets.items():
        for j, t in sets.items():
            if s and t and 9 * len(s & t) >= 4 * (len(s) + len(t)):
                assert got[i].class_id == got[j].class_id
    kept = similarity.representatives(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {r.class_id for r in got.values()}


def test_paths_outlast_splits():
    # Pairs at the threshold: the smaller set lies in the larger, every bucket is split; each has the runs that its depth takes.
    met, pairs = np.zeros(7, int), 1000
    tokens = np.random.default_rng(5).integers(0, 2**32, (pairs, 100)).astype(np.uint64)
    for a in tokens:
        b, found, lost = a[:80], np.zeros(7, bool), np.zeros(7)
        for run in range(8):
            open_ = lost > np.log(1 - similarity.TARGET)
            shared = [run]
            for depth in range(7):
                n = similarity.FANOUT if depth else similarity.ROOTS
                shared = [p for x in shared for p in np.intersect1d(similarity.sampled(a, x, n, 100), similarity.sampled(b, x, n, 80)).tolist()]
                found[depth] |= bool(shared) and open_[depth]
            lost += len(similarity.sampled(a, run, similarity.ROOTS, 100)) * np.array([similarity.missed(d)[1] for d in range(7)])
        met += found
    assert (met >= 0.998 * pairs).all()


def test_company_costs_little():
    # The chance to leave for want of company, at the threshold, for sets of any size.
    assert max(similarity.lost_to_company(n) for n in (*range(4, 40), 60, 100, 150)) < 1e-4


def test_a_common_passage_does_not_keep_buckets_together(spark):
    # Three tenths of each text are a passage that all share: none is like another, so no large bucket is compared in full.
    common = " ".join(f"c{k}" for k in range(34))
    rows = [(i, common + " " + " ".join(f"u{i}x{k}" for k in range(70))) for i in range(3000)]
    sets = similarity.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    met = sets.selectExpr("sig", "size(roots) r", "explode(roots) path")
    assert not met.groupBy("path").count().where("count > 2500").isEmpty()
    leaf = similarity.runs(met, sets.select("sig", "tokens"), split=256)
    assert leaf.groupBy("path").count().where("count > 512").isEmpty()
    # Of near copies, all pairs are links, and they are compared at once.
    near = [(i, " ".join(f"n{k}" for k in range(100)) + f" end{i}") for i in range(600)]
    got = similarity.classes(spark.createDataFrame(near, "doc_id long, text string"), block=64).collect()
    assert {(r.class_id, r.n_links, r.n_texts) for r in got} == {(0, 599, 599)}


def test_one_row_of_a_class_stays(spark):
    t = " ".join(f"n{k}" for k in range(40))
    rows = [(3, t, 1), (3, t, 2), (3, t + " end", 3), (4, t, 4), (None, t, 5), (None, "a b c d e f", 6), (None, "a b c d e f", 7), (8, "...", 8), (8, "...", 9)]
    kept = similarity.representatives(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert len(kept) == 4 and sum(r.doc_id == 3 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 8 for r in kept) == 2


def test_similarity_of_frequent_passages(spark):
    # Each passage stands in about 80 texts, each text has one copy cut off near the threshold, and buckets are split to the last.
    g = np.random.default_rng(3)
    passages = [" ".join(f"p{i}w{k}" for k in range(20)) for i in range(250)]
    whole = [" ".join(passages[j] for j in g.permutation(250)[:10]).split() for _ in range(1000)]
    rows = [(2 * i + k, " ".join(w[: 200 - 38 * k])) for i, w in enumerate(whole) for k in (0, 1)]
    got = {r.doc_id: r for r in similarity.classes(spark.createDataFrame(rows, "doc_id long, text string"), split=2).collect()}
    assert sum(got[2 * i].class_id == got[2 * i + 1].class_id and got[2 * i].n_links == 1 for i in range(1000)) >= 997


def test_stages_keep_clashing_columns(spark, odd):
    import corpus_pipeline

    rows = odd.selectExpr("*", "'x' lang_pred", "1 score", "'h' __hits", "'k' key", "2 gone_id", "'c' class_id", "length(text) n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, SF)
        assert got.columns == rows.columns and {r.lang_pred for r in got.select("lang_pred").collect()} == {"x"}
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() >= len(ODD)
    assert "x" not in {r.lang_pred for r in language.predict(rows, language.profiles(rows)).collect()}


def test_similarity_odd(odd):
    got = similarity.classes(odd).collect()
    assert len(got) == len(ODD) and similarity.classes(odd.limit(0)).count() == 0
    by = {(r.doc_id): r for r in got}
    assert by[6].class_id == 5 and by[5].n_links >= 2 and by[1].class_id == 1 and by[1].n_links == 0
    assert by[None].class_id is not None or by[None].n_links == 0
    assert {1, 2, 3, 8, 9} <= {r.doc_id for r in similarity.representatives(odd).collect()}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.sampled_from([1, 2, 3]))
def test_matroska_round_trip(payload, lacing):
    media = matroska.write(matroska.pad(payload), lacing)
    found, cues = matroska.packets(media)
    assert b"".join(media[p.start : p.end] for p in found) == matroska.pad(payload)
    assert [p.time for p in found] == [576 * i for i in range(len(found))] and all(media[at : at + 4] == b"\x1fC\xb6u" for _, at in cues)


def test_matroska_frames_of_any_size():
    frames = [b"a" * n for n in (1, 700, 255, 30, 300)]
    for how in (1, 3):
        body = matroska.laced(frames, how)
        assert [e - s for s, e in matroska.unlaced(body, 0, len(body), how)] == [len(f) for f in frames]
    with pytest.raises(ValueError):
        matroska.packets(matroska.write(matroska.pad(b"x"))[:-9])


def test_matroska_clusters_of_unknown_size():
    m, n = matroska, 1500
    live = b"".join(bytes.fromhex("1f43b67501ffffffffffffff") + m.number(m.TIME, 10 * i) + m.element(m.SIMPLE, b"\x81\0\0\x80" + bytes([i % 256])) for i in range(n))
    media = m.element(m.EBML, b"") + bytes.fromhex("1853806701ffffffffffffff") + live + m.element(m.CUES, m.element(m.POINT, m.number(m.CUETIME, 7) + m.element(m.PLACES, m.number(m.CUEAT, 0))))
    found, cues = m.packets(media)
    assert [(p.time, media[p.start : p.end]) for p in found] == [(10 * i, bytes([i % 256])) for i in range(n)] and len(cues) == 1


def lace(time, frames, how, group=None):
    m = matroska
    body = b"\x81" + time.to_bytes(2, "big") + bytes([how << 1]) + m.laced(frames, how)
    return m.element(m.SIMPLE, body) if group is None else m.element(m.GROUP, m.element(m.BLOCK, body) + group)


def film(*blocks, each=None, scale=1_000_000):
    m = matroska
    track = m.element(m.TRACK, (m.number(m.EACH, each) if each else b"") + m.number(m.NUMBER, 1))
    return m.element(m.EBML, b"") + m.element(m.SEGMENT, m.element(m.INFO, m.number(m.SCALE, scale)) + m.element(m.TRACKS, track) + m.element(m.CLUSTER, m.number(m.TIME, 100) + b"".join(blocks)))


def test_matroska_times_of_laced_frames():
    frames, m = [b"a" * 10, b"b" * 700, b"c" * 5], matroska
    times = lambda data: [p.time for p in m.packets(data)[0]]
    for how in (1, 3):
        assert times(film(lace(0, frames, how), lace(60, frames[:1], 0), each=20_000_000)) == [100, 120, 140, 160]
        assert times(film(lace(0, frames, how), each=20_000_000, scale=500_000)) == [100, 140, 180]
        assert times(film(lace(0, frames, how))) == [100, None, None]
        assert times(film(lace(0, frames, how, m.number(m.LASTS, 30)))) == [100, 110, 120]


def test_damaged_files_have_an_error(spark):
    good = film(lace(0, [b"a", b"bb"], 1), lace(9, [b"c"], 0), each=1_000_000)
    files = [(i, good[:n]) for i, n in enumerate(range(len(good) + 1))] + [(1000, None), (1001, film(matroska.element(matroska.SIMPLE, b"\x81")))]
    files += [(2000 + i, bytes(x ^ 255 if i == k else x for k, x in enumerate(good))) for i in range(len(good))]
    rows = matroska.packet_table(spark.createDataFrame(files, "file_id long, content binary")).collect()
    bad = {r.file_id for r in rows if r.error}
    # Cut off inside the segment (its size is known) or inside an element before it, a file is damaged; the whole one isn't.
    assert 1001 in bad and 1000 not in bad and len(good) not in bad and set(range(30, len(good))) <= bad
    assert sum(r.file_id == len(good) for r in rows) == 3 and all((r.track is None) == (r.error is not None) for r in rows)
    assert [r.time_ns for r in rows if r.file_id == len(good)] == [100_000_000, 101_000_000, 109_000_000]


def test_matroska_odd(odd):
    got = matroska.media_digests(odd).collect()
    want = sorted(hashlib.sha256(matroska.pad((t or "").encode())).hexdigest() for _, t, _ in ODD)
    assert sorted(r.payload_sha256 for r in got) == want and matroska.media_digests(odd.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "<turn>\\b\\l</turn>\n### user:"), (2, 0, "assistant", "a"), (None, None, None, None), (3, 1, "user", "x"), (3, 1, "user", "x"), (4, 0, "us<er\n\\n", "y")]
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"system\ns\nuser\n\nassistant\n{rows[2][3]}\n") and got[1].valid and got[1].loss_sha256 == sha(rows[2][3])
    assert got[3].n_turns == 2 and not got[3].valid and got[2].state == "invalid" and got[None].turns_sha256 == sha("\n\n")
    assert got[4].turns_sha256 == sha("us<er\n\\n\ny\n") and got[4].loss_chars == 0
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_template_with_pattern_signs(spark):
    t = chat.Template(open="<|(turn*|>", after_role=" ::\n", close="<|end|>\n")
    rows = [(1, 0, "user", "a <|(turn*|> b"), (1, 1, "assistant", "c ::\n<|end|>\n")]
    got = chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t), t).first()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest() and got.loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest()


def test_templates_that_could_be_mistaken_raise():
    for wrong in ({"open": "[turn]"}, {"close": "/turn\n"}, {"after_role": ": "}, {"open": "<t>", "close": "<t>x"}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_addresses_have_no_suffixes(spark):
    asked = {"http://10.0.0.1/a/b": ["10.0.0.1", "10.0.0.1/", "10.0.0.1/a/"], "http://[::1]:80/x": ["[::1]", "[::1]/"], "http://u@b.a.com:8": ["b.a.com", "a.com", "com"], "http://": None}
    got = {r.u: r.k for r in spark.createDataFrame([(u,) for u in asked], "u string").select("u", urls.keys_of(F.col("u")).alias("k")).collect()}
    assert got == asked


def test_short_sets_link_only_to_equal_ones(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "a b c"), (4, "a b d"), (5, "a, B c"), (6, "k l m n o p q"), (7, "k l m n o p q r")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in similarity.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0), 5: (3, 1), 6: (6, 0), 7: (7, 0)}


def test_urls(spark):
    day = "cast('{}' as date)".format
    entries = spark.sql(f"select * from values ('a.com', {day('2020-01-01')}, 'add', 'block'), ('a.com', {day('2020-02-01')}, 'remove', 'block'), ('a.com/x/', {day('2020-01-15')}, 'add', 'allow'), (null, {day('2020-01-01')}, 'add', 'block') as t(key, day, action, verdict)")
    asked = [("https://b.A.com/x/y?q", "2020-01-20", False), ("https://b.a.com/x/y", "2020-01-10", True), ("http://a.com", "2020-01-31", True), ("http://a.com/x/z", "2020-01-20", False), ("http://a.com", "2020-02-01", False), ("http://aa.com", "2020-01-20", False), (None, "2020-01-20", False), ("nonsense", "2020-01-20", False)]
    caps = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(asked)] + [(0, *asked[0][:2])], "page_id long, url string, t string").selectExpr("page_id", "url", "cast(t as date) fetched")
    got = {r.page_id: r for r in urls.evaluate(caps, urls.intervals(entries)).collect()}
    # An entry names a host and all below it; a directory entry only that host's own paths.
    assert {i: got[i].blocked for i in got} == {i: b for i, (_, _, b) in enumerate(asked)} | {0: True} and got[0].n_rows == 2
    assert urls.evaluate(caps, urls.intervals(entries.limit(0))).where("blocked").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1023), min_size=1, max_size=60))
def test_best_fit(lengths):
    a = np.array(lengths)
    bins, offsets, n = packing.best_fit(a)
    for k in range(n):
        order = np.argsort(offsets[bins == k])
        ls = a[bins == k][order]
        assert (offsets[bins == k][order] == np.cumsum(ls) - ls).all() and ls.sum() <= 1024
    assert packing.lower_bound(a) <= n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\r\n", "\xa0", "\x1c", "\x85", "\u200b", "a", "it's", "don't ", " 12", "é", "。", "　", "<|endoftext|>", "word ", "\t", "!?", "𝒳"]), max_size=12).map("".join))
def test_ids_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(test_ids_are_the_tokenizers, "both"):
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        test_ids_are_the_tokenizers.both = t, packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), most=20)
    t, ids = test_ids_are_the_tokenizers.both
    assert np.frombuffer(ids.of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("items", [16_384, 20])
def test_packing(odd, docs, items):
    from lodestone.llm.common import cut

    for source in (docs, odd, odd.limit(0)):
        whole = cut(packing.pieces(source), "t")
        got = packing.pack(whole, part_items=items).toPandas()
        assert len(got) == whole.count() and (got.length <= 1024).all()
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.length.sum() <= 1024 and (g.offset == g.length.cumsum() - g.length).all()
        for _, g in got[got.doc_id.notna()].drop_duplicates(["doc_id", "piece"]).sort_values("piece").groupby("doc_id"):
            assert (g.start == g.length.cumsum() - g.length).all() and (g.length.iloc[1:] == 1024).all()


@pytest.mark.parametrize("name", ["op4_decontaminate", "op8_chat_format", "op9_url_filter"])
def test_against_sql(spark, name):
    from lodestone import llm

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got, want = llm.queries()[name](spark, SF).toPandas(), c.sql(llm.oracle_sql()[name]).df()
    said = lambda df: sorted(tuple("" if v is None or v != v else str(v).replace(" 00:00:00", "") for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and said(got) == said(want)


def components(sets):
    """Class id by document, from all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if x and y and i < j and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_pipeline(spark, docs):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, SF).toPandas()
    told = {r.doc_id: r for r in language.predict(docs, language.profiles(docs)).collect()}
    rows = {i: t for i, t in texts(docs) if re.search(r"[^\W\d_]", t or "") and told[i].score >= corpus_pipeline.LEAST}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    classes = components({i: shingles(t) for i, t in rows.items()})
    want = {i: t for i, t in rows.items() if classes[i] == i and not hits(t, bench)[1]}
    assert set(got.doc_id) == set(want)
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert not any(base_spans(clean[i]) for i in want) and all(clean[i] == t for i, t in want.items() if not base_spans(t) and "ghp_" not in t)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = got.groupby("doc_id").length.sum()
    assert all(n[i] == len(t.encode(clean[i], add_special_tokens=False).ids) + 1 for i in want)


def test_pipeline_of_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = odd.selectExpr("doc_id", "text", "lang", "'s' source", "cast(length(text) as bigint) n_chars").select(columns)
    for name, df, bench in (("empty", rows.limit(0), 1), ("unlabelled", rows.withColumn("lang", F.lit(None).cast("string")), 0), ("odd", rows, 1)):
        d = str(tmp_path / name)
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "no such words")] * bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs_ = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs_, d).columns == columns
        ids = {r.doc_id for r in corpus_pipeline.run(spark, d).collect()}
        # Of the copies of 5 one stays, and of its near copies; "a" and the text of x are one of a kind.
        assert ids >= {8, 9} - ({9} if name == "odd" else set()) and not ids & {1, 2, 6, 7} if name != "empty" else not ids


def test_workspaces_remove_their_tables(spark):
    import os

    from lodestone.llm.common import Workspace, cut

    where = lambda df: df.written_at.removeprefix("file://")
    with Workspace(spark) as outer:
        with Workspace(spark) as inner:
            a, b = cut(spark.range(3), "a"), inner.keep(cut(spark.range(4), "b"))
        assert not os.path.exists(where(a)) and b.count() == 4
        c = outer.keep(cut(b, "c"))
    assert not os.path.exists(where(b)) and c.count() == 4


def test_ids_of_whole_documents(docs, odd):
    # Every piece against the tokenizers library's plain call on the whole text.
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        got = {}
        for r in packing.pieces(df).orderBy("doc_id", "piece").collect():
            got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        for i, x in texts(df):
            ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
            cuts = [0, *range(len(ids) % 1024 or min(len(ids), 1024), len(ids) + 1, 1024)]
            assert got[i] == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_other_vocabularies_raise(tmp_path):
    import json

    import public_tokenizers

    asked = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    for k, v in (("pre_tokenizer", {"type": "Whitespace"}), ("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True})):
        (tmp_path / "v.json").write_text(json.dumps({**asked, k: v}), encoding="utf-8")
        with pytest.raises(ValueError):
            packing.Ids(str(tmp_path / "v.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bins_against_the_optimum(lengths):
    # All partitions of a few items into bins of 12, against best fit and the bound.
    def least(rest, bins, best):
        if len(bins) >= best:
            return best
        if not rest:
            return len(bins)
        for k in range(len(bins)):
            if bins[k] + rest[0] <= 12:
                best = least(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]], best)
        return least(rest[1:], [*bins, rest[0]], best)

    optimum, a = least(sorted(lengths, reverse=True), [], len(lengths) + 1), np.array(lengths)
    assert packing.lower_bound(a, 12) <= optimum <= packing.best_fit(a, 12)[2] <= 11 * optimum / 9 + 6 / 9


def test_clashing_columns_of_rows(spark, odd):
    named = odd.selectExpr("*", "'x' segments", "'y' spans", "1 rid", "2 part", "3 bin", "'k' key")
    assert packing.pieces(named).count() == packing.pieces(odd).count()
    turns = spark.createDataFrame([(1, 0, "user", "q", "a", "b"), (1, 1, "assistant", "r", "c", "d")], "conv_id long, turn long, role string, text string, segments string, state string")
    assert chat.read_back(chat.formatted(turns)).first().n_turns == 2
    caps = spark.sql("select 1 page_id, 'http://a.com' url, date'2020-02-01' fetched, 'x' key, 'y' spans, 3 n_rows, 'z' active")
    lists = urls.intervals(spark.sql("select 'a.com' key, date'2020-01-01' day, 'add' action, 'block' verdict, 1 until"))
    assert urls.evaluate(caps, lists).first().blocked and urls.evaluate(caps.limit(0), lists).count() == 0
