import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import oracle
from wardsieve.llm import abuse, calibrate, catalog, cuckoo, history, level, lexicon, lookalike, mixture, nearcopies, personal, quota, sentences

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    got, want = oracle.same(catalog.queries()[name](spark, oracle.SMALL), SQL[name], oracle.connect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    catalog.queries()[name](spark, oracle.SMALL).collect()


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def gap(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


# --- 1 personal data ------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Call me on 630-555-0126 or +44 7700 900126.", ["phone", "phone"]),
        ("call me on +aa ttoo 9ooi26 or (6bo) sss-oi2t", ["phone", "phone"]),
        ("Text 849.555.0195, 07700 900 363, 001-919-555-0131 or (369) 555-0138", ["phone"] * 4),
        ("Order 5351-45209 of 2023-04-05 at 3 pm, ticket 6704-58600, version v2.21.58", []),
        ("ssn 941-24-1374, id card 710820-1971, nino QQ 74 31 10 D, passport KX0210941, MLGHK826084AB9XX", ["id"] * 5),
        ("verify with driver license blmmg9t9eeaab9xx also passport xz6t6ts29", ["id", "id"]),
        ("write to jane.doe+x@mail.example.org, A (at) example (dot) com or b[at]post.example", ["email"] * 3),
        ("contact scaltaneaexample.org. see https://img.norvton.example/p/a and www.quenhaven.test/faqa in file a_6.example", ["email"]),
        ("she lives at Flat 9, 214 Juniper Drive, Haldury 97449 any time", ["address"]),
        ("come to is tanner cl. visit our street market at a pm gate 9", ["address"]),
        ("Report against Arthur Kelstead; Zeldworth, Felix and MARIA D. FENINGS called", ["name"] * 3),
        ("Emma would love the sofa. a frank answer. the mark scheme. @mivo_9 and Mr. Fenwickshire", []),
        ("ring +447700900123, 07700900123 or (020) 7946 0958", ["phone"] * 3),
        ("passport 123456789 of Dr Priya Nair, 221 Baker Boulevard", ["id", "name", "address"]),
        ("My name is Mr. Wei Zhang. Order 123456789 for Mr Fenwick, Dr Baker Street", ["name"]),
        ("", []),
        (None, []),
    ],
)
def test_items(text, kinds):
    assert [k for k, _, _ in personal.find(text)] == kinds


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 10**12), st.data())
def test_feistel_is_a_permutation(n, data):
    f = personal.Feistel(b"key")
    x = data.draw(st.integers(0, n - 1))
    y = f.permute(x, n, "t")
    assert 0 <= y < n and f.permute(y, n, "t", back=True) == x


def test_pseudonyms_link_and_keep_format():
    f = personal.Feistel(b"key")
    small = {f.permute(i, 50, "s") for i in range(50)}
    assert small == set(range(50))
    p = personal.pseudonym
    assert p("phone", "630-555-0126", f) == p("phone", "6eo-sss-oi26", f)
    assert p("phone", "630-555-0126", f) != p("phone", "630-555-0127", f)
    assert len(p("phone", "+44 7700 900126", f)) == 15 and p("phone", "+44 7700 900126", f).startswith("+44 ")
    assert p("email", "A (at) example (dot) com", f) == p("email", "a@example.com", f) == p("email", "aaexample.com", f)
    born = p("id", "710820-1971", f)
    pd.Timestamp(f"19{born[:2]}-{born[2:4]}-{born[4:6]}")
    text = "Hi 630-555-0126, bye."
    out = personal.redact(text, f)
    assert out[0].startswith("Hi [PHONE ") and out[0].endswith("], bye.") and "630" not in out[0].split("]")[0][:6] and out[1] == ["phone"]
    assert personal.redact(None, f) == (None, []) and personal.redact("nothing", f) == ("nothing", [])


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**10 - 1))
def test_validity_is_kept(n):
    """Numbers with a valid date or an issued area keep it, others never gain it."""

    def dated(v):
        try:
            pd.Timestamp(f"19{v[:2]}-{v[2:4]}-{v[4:6]}")
            return True
        except ValueError:
            return False

    f = personal.Feistel(b"key")
    v = f"{n // 10_000:06d}-{n % 10_000:04d}"
    out = personal.pseudonym("id", v, f)
    assert dated(v) == dated(out) and len(out) == len(v)
    v = f"{n // 10**7:03d}-{n // 10**5 % 100:02d}-{n % 10_000:04d}"
    issued = lambda x: personal._issued(*map(int, x.split("-")))
    if issued(v):
        assert issued(personal.pseudonym("id", v, f))


def test_serials_are_tied_to_their_date():
    f = personal.Feistel(b"key")
    assert len({personal.pseudonym("id", f"7108{d:02d}-1971", f)[-4:] for d in range(1, 29)}) > 20
    drawn = {personal._issued(*map(int, personal.pseudonym("id", f"665-{g:02d}-0001", f).split("-"))) for g in range(1, 99)}
    assert drawn == {True}


def test_found_items_are_the_placeholders(spark):
    rows = spark.createDataFrame([(1, "Call 630-555-0126, 849.555.0195 or jane@mail.example"), (2, None), (3, "nothing")], "id long, text string")
    done = personal.redacted(rows, b"key")
    assert {tuple(r) for r in personal.items(done.select("id", "kinds")).collect()} == {(1, "phone", 1), (1, "phone", 2), (1, "email", 1)}
    text = {r.id: r.text for r in done.collect()}
    assert text[1].count("[PHONE ") == 2 and text[1].count("[EMAIL ") == 1 and text[2] is None and text[3] == "nothing"


def test_invisible_characters_do_not_hide_items():
    assert [k for k, _, _ in personal.find("Call 630-5​55-0126 now, Arth­ur Kelstead")] == ["phone", "name"]


# --- 2 near copies --------------------------------------------------------------------------


def brute_texts(rows):
    import regex

    sets = {i: set(w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")) for i, t in rows}
    sets = {i: s for i, s in sets.items() if len(s) >= 10}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("vocab", "rows", "key_rows"), [(60, 150, 100), (25, 120, 4), (2000, 200, 100)])
def test_text_pairs_equal_brute_force(spark, monkeypatch, vocab, rows, key_rows):
    """With a low bound on shared keys, hot keys are refined several times; nothing is lost. Most
    words are neither listed nor alone with their counter."""
    monkeypatch.setattr(nearcopies, "KEY_ROWS", key_rows)
    monkeypatch.setattr(nearcopies, "FREQUENT_WORDS", 20)
    monkeypatch.setattr(nearcopies, "COUNTERS_POWER", 6)
    rng = random.Random(vocab)
    words = [f"w{i}" for i in range(vocab)]
    docs = []
    for _ in range(rows):
        if docs and rng.random() < 0.6:
            d = rng.choice(docs)[:]
            for _ in range(rng.randint(0, 5)):
                if rng.random() < 0.5 and d:
                    d.pop(rng.randrange(len(d)))
                else:
                    d.insert(rng.randrange(len(d) + 1), rng.choice(words))
        else:
            d = [rng.choice(words) for _ in range(rng.randint(8, 30))]
        docs.append(d)
    table = [(i + 1, " ".join(d).upper() if i % 7 == 0 else ", ".join(d)) for i, d in enumerate(docs)] + [(9001, None), (9002, "")]
    got = [(r.id_a, r.id_b) for r in nearcopies.text_pairs(spark.createDataFrame(table, "id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_texts(table)


def test_image_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    vals = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 11))) for b in base for _ in range(4)]
    rows = [(i + 1, signed(v)) for i, v in enumerate(vals)] + [(5001, None), (5002, 0), (5003, 0)]
    got = [(r.id_a, r.id_b) for r in nearcopies.image_pairs(spark.createDataFrame(rows, "id long, phash long")).collect()]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and gap(x, y) <= 8}
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_count_links_without_expanding(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(20)]
    vals = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(4)]
    rows = [(i + 1, signed(v)) for i, v in enumerate(vals)] + [(1000 + i, 77) for i in range(40)] + [(2000, 1 << 40)]
    df = spark.createDataFrame(rows, "id long, phash long")
    pairs = [(r.id_a, r.id_b) for r in nearcopies.image_pairs(df).collect()]
    links, parent = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: (r.group_id, r.links) for r in nearcopies.groups(*nearcopies.image_classes(df)).collect()}
    assert got == {i: (root(i), n) for i, n in links.items()}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for x in parent}
    got = {r.node: r.group for r in nearcopies.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# --- 3 look-alikes --------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ｗｉｄｅ", "wide", True), ("café", "café", True), ("zero​width­", "zerowidth", True), ("a b", "a b", True), ("a　b", "a b", True),
        ("раураl", "paypal", True), ("𝐩𝒂𝓎𝗽𝙖𝚕", "paypal", True), ("ꓚ𝟏", "C1", True), ("ӀӀ", "ll", True), ("ο", "o", True), ("non‑stop", "non-stop", True), ("ﬁne", "fine", True), ("ӧ", "ö", True), ("ｶﾞ", "ガ", True),
        ("Wide", "wide", False), ("cafe", "café", False), ("b0y", "boy", False), ("ab", "a b", False), ("и", "n", False), ("１", "l", False), ("１", "1", True),
    ],
)
def test_looks(spark, a, b, same):
    rows = spark.createDataFrame([("k", "1", a), ("k", "2", b), ("other", "3", a)], "kind string, key string, text string")
    got = {tuple(r) for r in lookalike.pairs(rows).collect()}
    assert got == ({("k", "1", "2")} if same else set())


def test_precomposed_letters_fold_like_decomposed_ones(spark):
    letters = ["\u045e", "\u040e", "\u0477", "\u04f3", "\u1f00", "\u1f02", "\u1f80"]
    strings = [s for c in letters for s in (f"x{c}z", unicodedata.normalize("NFD", f"x{c}z"), f"x{lookalike.ALIKE[unicodedata.normalize('NFD', c)[0]]}z")]
    rows = spark.createDataFrame([("k", f"{i:02}", s) for i, s in enumerate(strings)], "kind string, key string, text string")
    got = {(r.key_a, r.key_b) for r in lookalike.pairs(rows).collect()}
    # both spellings are one, and the letter without marks is another
    assert {(f"{i:02}", f"{i + 1:02}") for i in range(0, len(strings), 3)} <= got
    assert not any((f"{i + j:02}", f"{i + 2:02}") in got for i in range(0, len(strings), 3) for j in (0, 1))


def test_skeletons_of_other_scripts(spark):
    """Strings of other scripts have skeletons of their own, which composition does not change."""
    strings = ["\u304c\u304e\u3050", "\u043f\u0440\u0438\u0432\u0435\u0442", "\ud55c\uad6d", "\u0645\u0631\u062d\u0628\u0627", "\u0928\u092e\u0938\u094d\u0924\u0947", "\uf900x\u00e9", "\uf900", "\u2460", "..."]
    both = [(s, unicodedata.normalize("NFD", s), unicodedata.normalize("NFC", s)) for s in strings]
    df = spark.createDataFrame(both, "a string, b string, c string")
    a, b, c = ([r.sk for r in lookalike._with_skeleton(df, x).collect()] for x in "abc")
    assert a == b == c and len(set(a)) >= len(strings) - 1


def test_canonical_member_is_one_of_the_class(spark):
    rows = spark.createDataFrame([("k", "1", "раypal"), ("k", "2", "paypal"), ("k", "3", "ｐaypal"), ("k", "4", None)], "kind string, key string, text string")
    got = {r.text: (r.canonical, r.members) for r in lookalike.classes(rows).collect()}
    assert set(got.values()) == {("paypal", 3)} and None not in got


# --- 4 batches against history --------------------------------------------------------------


def test_covering_code_is_perfect():
    one = history.offsets(3)
    assert len(one) == 2048 and one["syndrome"].is_unique and len(history.offsets(5)) == 44_552


def images(spark, rows, *more):
    return history.keyed_images(spark.createDataFrame(rows, "file_hash string, phash long, batch_no int, row_id long"), *more)


@pytest.mark.parametrize("cell_rows", [1000, 2])
def test_batches_equal_brute_force(spark, monkeypatch, cell_rows):
    """With small cells most rows lie in sub-cells; nothing is lost."""
    monkeypatch.setattr(history, "CELL_ROWS", cell_rows)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(90)]
    past = base[:50]
    batch = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 12))) for b in base for _ in range(3)]
    crowd = [base[0] ^ 1 << rng.randrange(40) ^ 1 << rng.randrange(40) for _ in range(30)]
    cache = [(f"c{i}", signed(h), 0, -1) for i, h in enumerate(past)] + [("zero", 0, 0, -1), ("none", None, 0, -1)]
    rows = [(None, signed(h), i % 3 + 1, i + 1) for i, h in enumerate(batch + crowd)] + [(" C3 ", None, 2, 900), ("new", 0, 2, 901), ("new", 0, 3, 902), ("", None, 3, 903)]
    store = history.BatchStore(spark)
    store.append(history.hashes_of(store.admit(images(spark, cache).withColumns({"batch_no": F.lit(history.HISTORY), "row_id": F.lit(-1).cast("long")}))))
    got = {r.row_id for r in history.run(store, images(spark, rows, "row_id", "batch_no"), 1 if cell_rows == 2 else 3).collect()}
    known = {i + 1 for i, h in enumerate(batch + crowd) if any(gap(h, p) <= 8 for p in past) or any(gap(h, g) <= 8 and (j % 3 + 1, j + 1) < (i % 3 + 1, i + 1) for j, g in enumerate(batch + crowd))}
    assert got == known | {900, 902}


@pytest.mark.parametrize("cell_rows", [1000, 1])
def test_nearest_distances_and_appending(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(history, "CELL_ROWS", cell_rows)
    rng = random.Random(6)
    past = [rng.getrandbits(64) for _ in range(80)]
    asked = [h ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 10))) for h in past]
    store = history.BatchStore(spark)
    mk = lambda hs, no, at: spark.createDataFrame([(signed(h), no, at + i) for i, h in enumerate(hs)], "phash long, batch_no int, row_id long")
    store.append(mk(past[:40], 0, 1))
    store.append(mk(past[40:], 1, 1000))
    got = {r.row_id: r.distance for r in store.probe(mk(asked, 2, 5000), nearest=True).collect()}
    want = {5000 + i: min(gap(h, p) for p in past) for i, h in enumerate(asked)}
    assert got == {k: v for k, v in want.items() if v <= 8}


def test_later_batches_read_no_earlier_source_and_a_store_is_opened_again(spark, tmp_path):
    import shutil

    h = 0x1234_5678_9ABC_DEF0
    first = [("a", signed(h), 1, 1), ("b", signed(h ^ 7), 1, 2), ("B ", None, 1, 3)]
    spark.createDataFrame(first, "file_hash string, phash long, batch_no int, row_id long").write.parquet(f"{tmp_path}/one")
    store = history.BatchStore(spark, f"{tmp_path}/store", buckets=3)
    found = store.check(history.keyed_images(spark.read.parquet(f"{tmp_path}/one"), "row_id", "batch_no"))
    assert {tuple(r) for r in found.collect()} == {("p", 2), ("f", 3)}
    store.close()
    shutil.rmtree(f"{tmp_path}/one")
    again = history.BatchStore(spark, f"{tmp_path}/store", buckets=3)
    assert sum(again.sizes.values()) == 6
    found = again.check(images(spark, [(" A", None, 2, 4), (None, signed(h ^ 3), 2, 5), ("x", signed(~h & (2**64 - 1)), 2, 6)], "row_id", "batch_no"))
    assert {tuple(r) for r in found.collect()} == {("f", 4), ("p", 5)}
    assert sorted(r.row_id for r in again.known().collect()) == [2, 3, 4, 5]
    plan = again.keys().where("batch_no = 1")._jdf.queryExecution().toString()
    assert "one" not in plan and "Bucketed: " in again.keys().join(spark.range(3).withColumn("key", F.col("id").cast("string")).hint("merge"), "key")._jdf.queryExecution().toString()


def test_hot_keys_and_crowds(spark, monkeypatch):
    """A third of all rows share a key, another third are altered copies of one image."""
    monkeypatch.setattr(history, "CELL_ROWS", 20)
    h = 0x1234_5678_9ABC_DEF0
    rows = [("hot", None, 1, i) for i in range(1, 400)] + [(f"k{i}", signed(h ^ (1 << i % 60)), 2, i) for i in range(400, 800)]
    got = {r.row_id for r in history.run(history.BatchStore(spark), images(spark, rows, "row_id", "batch_no")).collect()}
    assert got == set(range(2, 400)) | set(range(401, 800))


def test_batch_probes_are_not_broadcast(spark):
    store = history.BatchStore(spark)
    rows = spark.createDataFrame([(1 << i, 1, i) for i in range(60)], "phash long, batch_no int, row_id long")
    store.append(rows)
    # the bucketed table's size is unknown; that of the probes is reckoned before they are made
    plan = store.probe(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cell" in plan and "BroadcastHashJoin" not in plan


# --- 5 abuse, 10 reading level ----------------------------------------------------------------


def reviewed():
    d = oracle.connect("/root/testdata/sf0.1")
    rows = d.sql("SELECT t.normalized_content, r.abusive FROM text_review r JOIN text_dataset t USING (id) ORDER BY hash(id)").fetchall()
    words = d.sql("SELECT word, lower(trim(category)) FROM bad_word WHERE lower(trim(category)) IN ('insult', 'hate', 'sexual', 'threat') AND trim(word) <> '' ORDER BY req_id LIMIT 2000").fetchall()
    terms = {}
    for w, k in words:
        terms.setdefault(" ".join(sentences.fold(w).split()), k)
    return rows, terms


def test_abuse_on_held_out_labels():
    rows, terms = reviewed()
    cut = int(len(rows) * 0.7)
    model = abuse.train([t for t, _ in rows[:cut]], np.array([y for _, y in rows[:cut]]), terms)
    got = np.array([model.score(t)[0] >= abuse.CUT for t, _ in rows[cut:]])
    true = np.array([y == 1 for _, y in rows[cut:]])
    # a few labels are wrong, so 1.0 is out of reach
    assert (got & true).sum() / got.sum() > 0.85 and (got & true).sum() / true.sum() > 0.7


def test_sentences_are_located_and_disguises_undone():
    bad = [f"you are such a idiot name{i}" for i in range(8)] + [f"get lost name{i} you pathetic moron" for i in range(8)]
    fine = [f"the {w} is {c}" for w in ("sofa", "lamp", "river", "garden") for c in ("green", "old", "near", "fine")]
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(160):
        s = rng.sample(fine, 3)
        if i % 3 == 0:
            s.insert(rng.randint(0, 3), rng.choice(bad))
        texts.append(". ".join(s) + ".")
        labels.append(int(i % 3 == 0))
    model = abuse.train(texts, np.array(labels), {"idiot": "insult", "moron": "insult"})
    for text in ("the sofa is old. You are such a 1d10t friend. the lamp is fine.", "the sofa is old. you are such a i d i o t bob. the lamp is fine.", "the sofa is old. you are such a i.d.i.o.t bob."):
        p, where, q = model.score(text)
        assert p > 0.5 and "such a" in where and q > 0.5
    assert model.score("the sofa is old. the lamp is fine.")[0] < 0.3
    assert model.score(None) == (0.0, None, 0.0) and model.score("")[0] == 0.0
    assert abuse.train([], np.zeros(0), {"idiot": "insult"}).score("a idiot")[0] >= abuse.CUT


@pytest.mark.parametrize("bound", [50_000, 10])
def test_every_listed_term_counts_however_late(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(abuse, "BROADCAST_TERMS", bound, raising=False)
    words = [(i, "idiot" if i % 2 else f"word{i}", "insult", i) for i in range(2500)] + [(2500, "m0r\u00f3n", " Hate", 0), (2501, "moron", "insult", 0), (2502, "utter waste", "threat", 0)]
    texts = [(1, "what a moron"), (2, "what a m o r o n it is"), (3, "what a morooooon"), (4, "an utter w.a.s.t.e of air"), (5, "the lamp is utter joy"), (6, None)]
    spark.createDataFrame(words, "req_id long, word string, category string, n int").write.parquet(f"{tmp_path}/bad_word.parquet")
    spark.createDataFrame(texts, "id long, normalized_content string").write.parquet(f"{tmp_path}/text_dataset.parquet")
    spark.createDataFrame([], "id long, abusive int").write.parquet(f"{tmp_path}/text_review.parquet")
    got = {r.id: r.score for r in abuse.p5_scores(spark, str(tmp_path)).collect()}
    assert {i for i, x in got.items() if x >= abuse.CUT} == {1, 2, 3, 4} and len(got) == 6
    assert {tuple(r) for r in abuse.listed_terms(spark.read.parquet(f"{tmp_path}/bad_word.parquet")).where("term LIKE 'm%'").collect()} == {("moron", "hate")}


def test_joined_terms_give_the_broadcast_scores(spark, monkeypatch):
    want = {tuple(r) for r in abuse.p5_scores(spark, "/root/testdata/sf0.01").collect()}
    monkeypatch.setattr(abuse, "BROADCAST_TERMS", 10)
    got = {tuple(r) for r in abuse.p5_scores(spark, "/root/testdata/sf0.01").collect()}
    key = lambda rows: {(i, round(p, 6), s, round(q, 6)) for i, p, s, q in rows}
    assert key(got) == key(want)


def test_levels_on_held_out_grades():
    d = oracle.connect("/root/testdata/sf0.1")
    rows = d.sql("SELECT text, reading_level FROM doc_level JOIN documents USING (doc_id) WHERE text IS NOT NULL ORDER BY hash(doc_id)").fetchall()
    y = np.array([level.LEVELS.index(x) for _, x in rows])
    cut = int(len(rows) * 0.7)
    model = level.train([t for t, _ in rows[:cut]], y[:cut])
    p = model.documents([t for t, _ in rows[cut:]])
    right = p.argmax(1) == y[cut:]
    assert right.mean() > 0.92
    # calibrated: stated and observed certainty agree, overall and among doubtful documents
    sure = p.max(1)
    assert abs(sure.mean() - right.mean()) < 0.04
    doubtful = sure < np.quantile(sure, 0.3)
    assert abs(sure[doubtful].mean() - right[doubtful].mean()) < 0.12
    assert np.isnan(model.documents(["", "123 456", None])).all()
    assert level.train([], np.zeros(0, int)).documents(["any words here"]).argmax() == 1


def test_profile_covers_every_document(spark):
    d = oracle.connect()
    got = level.p10_profile(spark, oracle.SMALL).collect()
    by_lang = {}
    for r in got:
        by_lang[r.lang] = by_lang.get(r.lang, 0) + r.n_docs
    assert by_lang == dict(d.sql("SELECT lang, count(*) FROM documents GROUP BY lang").fetchall()) and None in by_lang
    assert len({(r.source, r.lang, r.reading_level) for r in got}) == len(got)


# --- 6 calibrated samples ---------------------------------------------------------------------


def test_tilt_meets_targets_and_stops_at_one():
    counts, wanted = np.array([1000.0, 50.0, 10.0, 0.0, 30.0]), np.array([100.0, 20.0, 25.0, 5.0, 0.0])
    pi = calibrate.tilt(counts[:, None], wanted, 0.2)[:, 0]
    assert np.allclose(pi, [0.1, 0.4, 1.0, 1.0, 0.0])


def test_tilt_keeps_categories_exactly_and_sources_nearly():
    cells, wanted = np.array([[500.0, 100.0], [30.0, 200.0], [9.0, 1.0]]), np.array([100.0, 60.0, 20.0])
    pi = calibrate.tilt(cells, wanted, 0.2)
    got = cells * pi
    assert np.allclose(got.sum(1), [100, 60, 10]) and np.abs(got.sum(0) / got.sum() - cells.sum(0) / cells.sum()).max() < 0.01
    tight = calibrate.tilt(np.array([[500.0, 3.0], [0.0, 200.0]]), np.array([400.0, 60.0]), 0.2)
    assert np.allclose((np.array([[500.0, 3.0], [0.0, 200.0]]) * tight).sum(1), [400, 60]) and tight.max() <= 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0.01, 0.99), min_size=1, max_size=60), st.integers(0, 1000))
def test_pivotal_keeps_the_sum(p, seed):
    p = np.array(p)
    out = calibrate.pivotal(p, np.random.default_rng(seed))
    loose = out[(out > 0) & (out < 1)]
    assert len(loose) <= 1 and abs(out.sum() - p.sum()) < 1e-6 * len(p) + 1e-7


def test_pivotal_probabilities():
    p = np.array([0.2, 0.5, 0.8, 0.5])
    mean = np.mean([calibrate.pivotal(p, np.random.default_rng(s)) for s in range(4000)], 0)
    assert np.abs(mean - p).max() < 0.03


def test_sample_sizes_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "CHUNK", 20)
    units = spark.range(3000).select(F.lit("text").alias("kind"), "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 40, "rare").otherwise("mid").alias("category"), (F.col("id") % 5 == 0).alias("own"))
    targets = spark.createDataFrame([("text", " HOT", 0.5, 1), ("text", "mid", 0.4, 1), ("text", "rare", 0.1, 30), ("text", "gone", 0.0, 3)], "kind string, category string, target_share double, min_rows int")
    plan = calibrate.needs(units, targets)
    sample = calibrate.draw(units, plan)
    got = {r.category: r for r in calibrate.report(sample, plan).collect()}
    assert got[" HOT"].sampled == 300 and got["mid"].sampled == 240
    assert (got["rare"].needed, got["rare"].sampled, got["rare"].gap) == (60, 26, 34) and got["gone"].gap == 3
    assert sample.count() == sample.select("id").distinct().count()


# --- 7 keys seen before -----------------------------------------------------------------------


def test_cuckoo_growth_deletion_and_errors():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 50_000, dtype=np.int64).view(np.uint64)
    shard = cuckoo.Shard([])
    for part in np.array_split(keys, 25):
        shard.insert(part)
    assert len(shard.tables) > 1 and shard.items == 50_000 and shard.contains(keys).all()
    again = cuckoo.Shard.from_rows(shard.to_rows(3))
    assert again.contains(keys).all()
    fresh = rng.integers(0, 1 << 63, 50_000, dtype=np.int64).view(np.uint64)
    assert again.contains(fresh).mean() < 0.003
    again.delete(keys[:20_000])
    assert again.contains(keys[20_000:]).all() and again.contains(keys[:20_000]).mean() < 0.003 and again.items == 30_000


def test_full_table_loses_nothing():
    rng = np.random.default_rng(2)
    t = cuckoo.CuckooTable(np.zeros((16, 4), np.uint32))
    keys = rng.integers(0, 1 << 63, 200, dtype=np.int64).view(np.uint64)
    left = t.insert(keys)
    stored = np.setdiff1d(np.arange(200), left)
    assert t.contains(keys[stored]).all() and len(stored) <= 64 and len(stored) > 50


def test_store_over_batches(spark):
    mk = lambda lo, hi: spark.range(lo, hi).select(F.lit("t").alias("kind"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("row_id"))
    store = cuckoo.CuckooStore.build(mk(0, 1000).select("key"), 12)
    answers, more = store.take(store.asked(mk(500, 1500)))
    got = {r.row_id: r.seen for r in answers.collect()}
    assert len(got) == 1000 and {i for i, x in got.items() if x} == set(range(500, 1000))
    assert {r.key for r in more.contains(mk(0, 2000)).where("seen").collect()} == {f"k{i}" for i in range(1500)}
    assert {r.key for r in store.contains(mk(0, 2000)).where("seen").collect()} == {f"k{i}" for i in range(1000)}  # the former store stays
    less = more.delete(mk(0, 1000).select("key"))
    assert {r.key for r in less.contains(mk(0, 2000)).where("seen").collect()} == {f"k{i}" for i in range(1000, 1500)}
    back = less.absorb(mk(0, 10).select("key"))
    assert back.table.where("gen = 0").agg(F.sum("items")).first()[0] == 510


def test_tables_grow_at_saturation(spark):
    mk = lambda lo, hi: spark.range(lo, hi).select(F.lit("t").alias("kind"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("row_id"))
    store = cuckoo.CuckooStore.build(mk(0, 500).select("key"), 12)
    assert store.table.agg(F.max("gen")).first()[0] == 0
    for lo in (500, 3000):
        answers, store = store.take(store.asked(mk(lo, lo + 8000)))
        assert {r.row_id for r in answers.where("seen").collect()} == set(range(3000, 8500) if lo == 3000 else ())
    assert store.table.agg(F.max("gen")).first()[0] > 0
    assert store.contains(mk(0, 11000)).where("seen").count() == 11000


def test_every_repeat_is_answered_by_a_table(spark, monkeypatch):
    """With tables that have seen nothing, no row is known: nothing beside them decides."""
    history = spark.createDataFrame([(f"h{i}",) for i in range(50)], "key string")
    keys = [f"h{i}" for i in range(10)] + [f"n{i}" for i in range(90)] + [f"n{i}" for i in range(90)] + [f"z{i}" for i in range(10)] + [None]
    rows = spark.createDataFrame([("text", i, k) for i, k in enumerate(keys)], "kind string, row_id long, key string").repartition(3)
    answers = cuckoo.seen_before(history, rows)
    assert {r.row_id for r in answers.where("seen").collect()} == {*range(10), *range(100, 190)} and answers.count() == 201
    report = cuckoo.audit(history, rows, answers, every=1).first()
    assert (report.n_rows, report.n_seen, report.n_audited, report.n_wrong) == (201, 100, 200, 0)
    flipped = answers.withColumn("seen", ~F.col("seen") & (F.col("row_id") < 200))
    assert cuckoo.audit(history, rows, flipped, every=1).first().n_wrong == 200


def test_audit_of_all_rows_finds_what_the_sample_leaves_out(spark, monkeypatch):
    """One wrong answer, to a row that p7_audit does not look at."""
    history = spark.createDataFrame([("h",)], "key string")
    rows = spark.createDataFrame([("text", i, f"k{i}") for i in range(1, 101)] + [("text", 101, None)], "kind string, row_id long, key string")
    monkeypatch.setattr(cuckoo, "_inputs", lambda *_: (history, rows))
    monkeypatch.setattr(cuckoo, "seen_before", lambda _, r: r.select("kind", "row_id", (F.col("row_id") == 7).alias("seen")))
    assert cuckoo.p7_audit(spark, "").first().n_wrong == 0
    got = cuckoo.p7_audit_all(spark, "").first()
    assert (got.n_rows, got.n_audited, got.n_wrong, got.wrong_rate) == (101, 100, 1, 0.01)


def test_hot_key_reaches_its_shard_once_a_task(spark):
    rows = spark.range(1, 3001).select(F.lit("t").alias("kind"), F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key")).repartition(4)
    history = spark.createDataFrame([("k1",), (None,)], "key string")
    assert {r.row_id for r in cuckoo.seen_before(history, rows).where("seen").collect()} == {1} | {i for i in range(6, 3001, 3)}
    sent = cuckoo.CuckooStore.build(history, 12).asked(rows).where("NOT seen")
    assert sent.where("row_id % 3 = 0").count() <= 4 and sent.where("row_id % 3 <> 0").count() == 2000


# --- 8 encoding, 9 mixing ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(spark, tokenizer):
    texts = ["Hello world, it's 2024!", "", None, "   spaced   out  \n\n\ttabs ", "<|endoftext|> is text", "日本語のテキスト", "emoji 🙂🏳️‍🌈", "a" * 5000, "ab" * 3000, "Ünïcödé x", " x\u0085y", "don't WE'LL they've", "१२३ ٣٤", "x\u001cy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in lexicon.encode(docs, "doc_id", "text", lexicon.compile_lexicon(docs.select("text"))).collect()}
    assert got == {i: (tokenizer.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in lexicon.token_counts(docs, "doc_id", "text", lexicon.compile_lexicon(docs.select("text"))).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=8), max_size=60))
def test_automaton_numbers_words(tmp_path_factory, words):
    words = sorted(words)
    a = lexicon.minimal_automaton(words)
    arcs = {int(k): (int(t), int(o)) for k, t, o in zip(a["keys"], a["targets"], a["outs"], strict=True)}

    def walk(w):
        s = i = 0
        for b in w:
            if s * 256 + b not in arcs:
                return -1
            s, o = arcs[s * 256 + b]
            i += o
        return i if a["final"][s] else -1

    assert [walk(w) for w in words] == list(range(len(words)))
    assert all(walk(w + b"zz") == (words.index(w + b"zz") if w + b"zz" in words else -1) for w in words)
    path = tmp_path_factory.mktemp("lex") / "f"
    path.write_bytes(lexicon.pack(a))
    assert all((lexicon.unpack(str(path))[k] == v).all() for k, v in a.items())


def test_suffixes_are_shared():
    words = sorted(f"{a}ization".encode() for a in "abcdefgh")
    assert len(lexicon.minimal_automaton(words)["final"]) == 9


def test_long_words_merge_like_short_ones():
    m = lexicon.Merger()
    rng = random.Random(1)
    for _ in range(50):
        w = "".join(rng.choice("abtheing é日") for _ in range(40)).encode()
        if m.ranks.get(w) is None:
            assert m._short(w) == m._long(w)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 4), min_size=1, max_size=8), st.integers(0, 120))
def test_knapsack_is_optimal(items, budget):
    lengths, counts = np.array(list(items)), np.array(list(items.values()))
    took = mixture.knapsack(lengths, counts, budget)
    reach = {0}
    for size, n in items.items():
        reach = {r + k * size for r in reach for k in range(n + 1)}
    assert (took <= counts).all() and (took >= 0).all() and (took * lengths).sum() == max(r for r in reach if r <= budget)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 3000), st.integers(1, 2000), min_size=1, max_size=40), st.floats(0, 1.2))
def test_fit_stays_within_budget(items, share):
    lengths, counts = np.array(list(items)), np.array(list(items.values()))
    total = int((lengths * counts).sum())
    budget = int(share * total)
    took = mixture.fit(lengths, counts, budget)
    used = int((took * lengths).sum())
    assert (took <= counts).all() and (took >= 0).all() and used <= budget
    if budget < total:
        assert budget - used <= 3000


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from([20_000, 30_001, 9_000, 9_001, 45_000, 8_400]), st.integers(1, 8), min_size=1, max_size=4), st.floats(0, 1))
def test_fit_is_optimal_beyond_its_first_window(items, share):
    lengths, counts = np.array(list(items)), np.array(list(items.values()))
    budget = int(share * (lengths * counts).sum())
    reach = {0}
    for size, n in items.items():
        reach = {r + k * size for r in reach for k in range(n + 1)}
    took = mixture.fit(lengths, counts, budget)
    assert (took <= counts).all() and int((took * lengths).sum()) == max(r for r in reach if r <= budget)


def test_mix_reaches_shares(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", None]), rng.randint(1, 60)) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    weights = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 5), ("c", 0.9, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeat int")
    planned = mixture.plan(sizes, weights)
    got = {r.source: r for r in mixture.shares(planned).collect()}
    total = sum(n for _, _, n in rows)
    assert got["a"].mix_tokens == int(0.3 * total) and got["b"].mix_tokens == int(0.3 * total)
    assert got["c"].short and got["none"].short and not got["a"].short and got["c"].mix_tokens == 2 * got["c"].source_tokens
    docs = mixture.mix(sizes, planned, "doc_id").collect()
    for s in "abc":
        assert sum(r.n_tokens * r.copies for r in docs if r.source == s) == got[s].mix_tokens
        assert max(r.copies for r in docs if r.source == s) <= {"a": 1, "b": 5, "c": 2}[s]


def test_quota_takes_exact_numbers(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), F.lit("clash").alias("take2"))
    quotas = spark.createDataFrame([(0, 700), (1, 9999), (2, 0)], "g long, take long")
    got = quota.take_by_hash(rows, quotas, ["g"], "id")
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {0: 700, 1: 1667} and got.columns == rows.columns
    again = quota.take_by_hash(rows.repartition(7), quotas, ["g"], "id")
    assert {r.id for r in got.collect()} == {r.id for r in again.collect()}


def test_fold_matches_the_service_form():
    assert sentences.fold("B4DW0RD Ünï $3@ ｗ раy") == "badword uni sea w pay"
    assert unicodedata.normalize("NFC", sentences.fold("é")) == "e"
