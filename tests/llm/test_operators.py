"""The training-data operators against brute force, and on awkward input."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from oracle import answer, rows
from pyspark.sql import functions as F

from lodestar.llm import bpe, components, decontaminate, html_wrappers, jaccard_join, knn_quality, line_dedup, paragraph_dedup, pii, quality_rules
from lodestar.llm.queries import ORACLES, QUERIES

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Extra columns named like the operators' own.
EXTRA = "_id string, _text string, _key string, _gone string, _kept string, _rows string, _hits string, _cut string, key string, sig string, label string, n_words int, hits string"


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "Kappa", "la", "mu"]) + str(rng.randint(0, 40)) for _ in range(n))


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, *["x"] * 11, 1, "y") for i, t in enumerate(texts)], f"doc_id bigint, text string, {EXTRA}")


AWKWARD = [None, "", "   ", "\n\n", "one", "a b", "x" * 200_000, ("w " * 30_000).strip(), "same text here\nsame text here", "same text here\nsame text here", "é\x00 ñ 北京 \U0001f600"]


@pytest.fixture(scope="module")
def near(spark):
    """Unique texts, exact copies, near copies and a long shared passage."""
    rng = random.Random(3)
    texts = [words(rng, rng.randint(5, 120)) for _ in range(60)]
    base = words(rng, 100).split()
    for _ in range(25):
        c = base[:]
        for _ in range(rng.randint(0, 3)):
            c[rng.randrange(len(c))] = "changed" + str(rng.randint(0, 99))
        texts.append(" ".join(c))
    texts += [texts[0]] * 10 + AWKWARD
    rng.shuffle(texts)
    return texts


def shingled(text, n):
    w = PLAIN.findall(lower(text or ""))
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(sets, percent):
    """Component of every set, by all pairs."""
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 8 << 20), (5, 80, 8 << 20), (3, 90, 4000)])
def test_jaccard_classes(spark, near, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(jaccard_join.links, "__defaults__", (block,))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(docs(spark, near), n, percent).collect()}
    sets = [shingled(t, n) for t in near]
    assert got == {i: (len(sets[i]), c) for i, c in enumerate(linked(sets, percent))}


def test_jaccard_random_sizes():
    rng = random.Random(5)
    import numpy as np

    for _ in range(300):
        n = rng.randint(10, 200)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), n - rng.randint(0, max(1, n // 20)))) | {rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n // 20)))}
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        for percent in (80, 90):
            if 100 * len(a & b) >= percent * len(a | b) and a != b:
                mine, theirs = jaccard_join.keys(x, percent), jaccard_join.keys(y, percent)
                assert any(np.intersect1d(k, o).size >= max(m, p) for m, k in mine for p, o in theirs)
                assert jaccard_join.forest([x, y], [0, 1], percent) == [(1, 0)]


@pytest.mark.parametrize("percent", [80, 90])
def test_forest_connects_what_all_pairs_connect(percent):
    import numpy as np

    rng = random.Random(percent)
    base = [rng.getrandbits(64) for _ in range(80)]
    sets = []
    for _ in range(60):
        s = set(rng.sample(base, len(base) - rng.randint(0, 12))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 8))}
        sets.append(frozenset(s))
    want = linked(sets, percent)
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in jaccard_join.forest([np.array(sorted(s), dtype=np.uint64) for s in sets], list(range(len(sets))), percent):
        assert 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(sets))] == want


def test_one_of_each_keeps_columns(spark):
    d = docs(spark, ["a b c d e f"] * 3 + ["other words stand in here now"], [5, 3, 3, 9])
    out = jaccard_join.one_of_each(d)
    assert out.columns == d.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 9]


#: Rows with equal and null ids: each text is clean or not by itself.
IDS = [None, None, None, 4, 4, 4, 4, None, 4]


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    texts = ["a b c d e f", "g h i j k l", "a b c d e f", "m n o p q r", "a b c d e f", "m n o p q r", "", None, ""]
    out = jaccard_join.one_of_each(docs(spark, texts, IDS))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, ""), (0, "g h i j k l"), (4, ""), (4, ""), (4, "a b c d e f"), (4, "m n o p q r")]
    assert jaccard_join.one_of_each(docs(spark, []) if texts == [] else docs(spark, texts, IDS).limit(0)).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    long = [f"line {i} of these documents is long enough to be looked at once more" for i in range(4)]
    texts = [f"{long[0]}\nown words", f"{long[0]}\nother words", f"{long[1]}\n{long[2]}", f"{long[3].replace('line', 'row')}\nlast", None]
    out = line_dedup.clean(docs(spark, texts, [None, None, 7, 7, 7]), min_words=99)
    left = sorted(r["text"] or "" for r in out.collect())
    assert len(left) == 5 and sum(long[0] in t for t in left) == 1 and texts[2] in left and texts[3] in left


def test_spans_of_rows_that_share_an_id(spark):
    rng = random.Random(31)
    passages = [" ".join(f"p{i}x{j}" for j in range(40)) for i in range(2)]
    fresh = lambda i, n: " ".join(f"f{i}x{j}" for j in range(n))
    texts = [f"{passages[0]} {fresh(0, 30)} {passages[1]}", f"{fresh(1, 5)} {passages[0]}", f"{passages[1]}", fresh(2, 90), fresh(2, 90), None, ""]
    rng.shuffle(texts)
    out = paragraph_dedup.clean(docs(spark, texts, [1] * 4 + [None] * 3))
    left = [" ".join((r["text"] or "").split()) for r in out.collect()]
    assert len(left) == 7 and all(sum(p in t for t in left) == 1 for p in passages)
    assert all(any(f in t for t in left) for f in (fresh(0, 30), fresh(1, 5), fresh(2, 90)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(None, 1), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up}


def test_line_dedup_matches_sql_and_keeps_columns(spark):
    long = "the first words of this rather long line stand here for all to read"
    texts = [f"{long}\nshort", long, long.replace("rather", "very"), long.replace("rather ", ""), f"own opening line of words\n{long} again and once more with others", None, "", "  \n\t", "x" * 100_000, f"{long}\n{long}"]
    d = docs(spark, texts)
    got = {(r["doc_id"], r["line"], r["of_doc"], r["edits"]) for r in line_dedup.removed(d).collect()}
    assert got == {(1, 0, 0, 0), (2, 0, 0, 1), (3, 0, 0, 1), (9, 0, 0, 0), (9, 1, 0, 0)}
    out = line_dedup.clean(d)
    assert out.columns == d.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: texts[i] for i in (0, 4, 5, 6, 7, 8)}
    assert line_dedup.removed(d.filter("doc_id < 0")).count() == 0
    twice = d.union(d)  # rows that share an id count as one document
    assert line_dedup.clean(twice).count() == 2 * out.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), answer(ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_quality_rules(spark):
    texts = [*AWKWARD, " ".join(f"w{i}" for i in range(60)), "a b c " * 40, "\n".join(["the same line of words"] * 20)]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = PLAIN.findall(t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if PLAIN.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), dup, len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert got[len(AWKWARD)]["kept"]
    kept = quality_rules.filter_documents(docs(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]} and len(kept.columns) == 15


@pytest.mark.parametrize("most", [500_000, 20])
def test_decontamination_counts(spark, most):
    rng = random.Random(2)
    items = [words(rng, 30), words(rng, 13), "Only Three words", None, "", words(rng, 14)]
    texts = [*AWKWARD, words(rng, 40) + " " + items[0] + " " + words(rng, 20), items[1].upper(), "has only, three WORDS in it", words(rng, 300) + " " + items[5], " ".join(items[0].split()[:12])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    win = defaultdict(set)
    for i, t in enumerate(items):
        w = ALNUM.findall(lower(t or ""))
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            win[tuple(w[j : j + k])].add(str(i))
    got = {r["doc_id"]: r for r in decontaminate.report(docs(spark, texts), bench, max_windows=most).collect()}
    for i, t in enumerate(texts):
        w = ALNUM.findall(lower(t or ""))
        hit, found = set(), set()
        for k in {len(x) for x in win}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in win:
                    hit |= set(range(j, j + k))
                    found |= win[tuple(w[j : j + k])]
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_decontamination_cuts_spans_and_keeps_columns(spark):
    item = " ".join(f"q{i}" for i in range(13))
    d = docs(spark, [f"before it {item}, after", None, "clean"])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    out = decontaminate.clean_text(d, bench, remove="spans")
    assert out.columns == d.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {0: "before it , after", 1: None, 2: "clean"}
    assert {r["doc_id"] for r in decontaminate.clean_text(d, bench).collect()} == {1, 2}
    assert decontaminate.clean_text(d, bench.filter("item_id < 0")).count() == 3


@pytest.mark.parametrize("most", [500_000, 3])
def test_decontamination_of_rows_that_share_an_id(spark, most):
    rng = random.Random(12)
    items = [" ".join(f"q{i}x{j}" for j in range(16)) for i in range(3)] + ["two words"]
    lead = [" ".join(f"l{i}x{j}" for j in range(20)) for i in range(len(IDS))]
    texts = [f"{x} {items[i]}, {items[(i + 1) % 3]}" if i < 3 else x for i, x in enumerate(lead)]
    texts[4], texts[5], texts[8] = f"é Two, WORDS {lead[4]}", None, texts[0]
    rng.shuffle(texts)
    d, bench = docs(spark, texts, IDS), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = sorted((t is not None and ("q" in t or "WORDS" in t), t or "") for t in texts)
    got = decontaminate.find(d.withColumn("doc_id", F.col("text")), bench, max_windows=most).collect()
    assert sorted((r["n_hit"] > 0, r["doc_id"] or "") for r in got) == want
    kept = decontaminate.clean_text(d, bench, max_windows=most)
    assert kept.columns == d.columns and sorted(r["text"] or "" for r in kept.collect()) == [t for bad, t in want if not bad]
    cut = decontaminate.clean_text(d, bench, remove="spans", max_windows=most).collect()
    assert len(cut) == len(texts) and not any("q" in (r["text"] or "") or "WORDS" in (r["text"] or "") for r in cut)
    assert decontaminate.find(d.limit(0), bench, max_windows=most).count() == 0


TEXTS = [*AWKWARD, "It's <|endoftext|> HERE<|startoftext|> <|STARTOFTEXT|>", "ΣΑΣ ǅ ẞ İ ﬁ ½ ² é Ⱥ", "naïve “quotes” 12345 ...!!! don't we'll"]


def test_bpe_is_the_librarys(spark):
    tok = bpe.library()
    rng = random.Random(4)
    pool = "aA'sS dDlLéÉßẞİıſȺ́Å北京日ก\U0001f600\x1c\x85\xa0\"12½²٣_-<|>Σςǅŉﬁ　"
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    d = docs(spark, texts)
    counts = {r["doc_id"]: r for r in bpe.token_counts(d).collect()}
    encoded = {r["doc_id"]: r for r in bpe.encode(d).withColumn("text", bpe.decode("ids")).collect()}
    digest = {r["doc_id"]: r for r in bpe.digests(bpe.encode(d, decoded="decoded")).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert list(encoded[i]["ids"]) == ids and encoded[i]["text"] == back
        assert (counts[i]["n_tokens"], counts[i]["n_bytes"], counts[i]["over_limit"]) == (len(ids), len((t or "").encode()), len(ids) > 2048)
        assert digest[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_decode_of_nulls_and_unknown_ids(spark):
    tok = bpe.library()
    known = tok.encode("some words here").ids
    lists = [known, None, [], [known[0], 10_000_000, -1, None, known[1]], [10_000_000]]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id int, ids array<int>").repartition(1)
    got = {r["doc_id"]: r["text"] for r in d.withColumn("text", bpe.decode("ids")).collect()}
    assert got == {0: tok.decode(known, skip_special_tokens=False), 1: None, 2: "", 3: tok.decode(known[:2], skip_special_tokens=False), 4: ""}


def test_trie_traversal_is_plain_merging():
    m = bpe.Merges()
    rng = random.Random(6)
    pieces = {"".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(1, 14))) for _ in range(2000)}
    got = m.encode(pieces)
    for p in pieces:
        parts = m.plain([*p[:-1], p[-1] + m.end])
        assert got[p] == tuple(m.vocab[t] for t in parts)


def test_frequent_encodings_outlast_a_full_cache(monkeypatch):
    """A full cache keeps the pre-tokens that come again, and the ids stay the library's."""
    monkeypatch.setattr(bpe, "CACHE_SIZE", 40)
    tok, cut, e, learned = bpe.library(), bpe.Cutter(), bpe.Encodings(), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda new: learned.extend(new) or learn(new))
    for i in range(60):
        texts = [f"the same words again and the same end <|endoftext|> rare{chr(97 + i % 26)}{chr(97 + i // 26)}word", "", "the end"]
        texts += [" ".join(f"{chr(97 + k)}x{chr(97 + i % 26)}" for k in range(26)) * 2] * (i == 30)
        got = e.encode([cut.pieces(t) for t in texts]).to_pylist()
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert learned.count("the") <= 2 and len(e.place) <= 60


def test_personal_data(spark):
    texts = [*AWKWARD, "mail a.b+c@d.example.org, x@y ip 10.0.0.256 10.0.0.25 card 4111 1111 1111 1111 or 4111111111111112 call +1 (555) 555-1234 now", "account IBAN DE89 3704 0044 0532 0130 00 and SSN 123-45-6789; 123-45-6789", "a@b.c@d.e @x.y z@@q.r 1.2.3.4.5"]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, s):
        d = re.sub(r"\D", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    got = {r["doc_id"]: r for r in pii.report(pii.find(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() if k != "email" or "@" in (t or "") for m in re.finditer(p, t or "") if valid(k, m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in got[i]["spans"].split(",") if s.split(":")[0] in patterns] == base
    at = len(AWKWARD)
    assert (got[at]["n_email"], got[at]["n_ip"], got[at]["n_card"], got[at]["n_phone"]) == (1, 1, 1, 1)
    assert got[at + 1]["spans"].startswith("iban:13:40,ssn:")
    found = pii.find(docs(spark, texts)).filter(F.col("doc_id") == at).withColumn("t", F.lit(texts[at]))
    assert found.select(pii.masked("t").alias("m")).first()["m"].startswith("mail <email>, x@y ip 10.0.0.256 <ip> card <card> or")


def test_personal_data_of_long_texts_takes_linear_time():
    import time

    long = ["7" * 1_000_000, "1.2." * 250_000, "7" * 500_000 + ".1.1.1", "a" * 1_000_000 + "@b", "@a.b" * 250_000, "+1(" * 300_000, "1 " * 500_000, "AB12" * 250_000, "12-34 " * 150_000, "sk-" * 300_000, "f" * 1_000_000]
    for text in long:
        began = time.process_time()
        pii.spans(text)
        assert time.process_time() - began < 8, text[:12]


def test_ip_scan_is_that_of_the_pattern():
    rng = random.Random(14)
    for _ in range(3000):
        text = "".join(rng.choice("1290..  a") for _ in range(rng.randint(0, 40)))
        want = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert list(pii._SCAN["ip"](text)) == want


def test_added_kinds_are_found_and_decoys_left():
    """Recall and precision of the kinds beside the base ones, on planted spans and decoys."""
    rng = random.Random(15)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def iban(good):
        body = f"{digits(8)}{digits(10)}"
        check = 98 - int(f"{body}{int('D', 36)}{int('E', 36)}00") % 97
        s = f"DE{check if good else (check + 40) % 97:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    hexes = lambda n, up: "".join(rng.choice("0123456789ABCDEF" if up else "0123456789abcdef") for _ in range(n))
    true = {
        "iban": lambda: f"account {iban(True)}",
        "ssn": lambda: f"social security {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "local_phone": lambda: f"phone ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}",
        "secret": lambda: rng.choice([f'token = "{hexes(40, False)}"', f'TOKEN = "{hexes(40, True)}"', f"api key sk-{hexes(32, False)}", f"secret AKIA{hexes(16, True)}"]),
    }
    decoys = [lambda: f"account {iban(False)}", lambda: f"part {digits(3)}-{digits(2)}-{digits(5)}", lambda: f"number {digits(16)}", lambda: f"from {digits(3)} to {digits(4)}", lambda: f"key {'0' * 40}", lambda: f"version {digits(2)}.{digits(2)}.{digits(1)}"]
    hit = Counter()
    for _ in range(400):
        for kind, make in true.items():
            hit[kind] += kind in {s[0] for s in pii.spans(f"{words(rng, 12)} {make()} {words(rng, 12)}")}
        for k, make in enumerate(decoys):
            hit[k] += any(s[0] in pii.ADDED for s in pii.spans(f"{words(rng, 12)} {make()} {words(rng, 12)}"))
    assert all(hit[kind] >= 0.98 * 400 for kind in true), hit
    assert all(hit[k] <= 0.02 * 400 for k in range(len(decoys))), hit


def test_paragraph_spans(spark):
    rng = random.Random(8)
    passage = ". ".join(words(rng, 12).capitalize() for _ in range(5)) + "."
    near = passage.split()
    near[3] = "altered"
    texts = [f"{words(rng, 40)}. {passage} {words(rng, 30)}.", f"{words(rng, 50)}. {passage} {words(rng, 20)}.", f"{words(rng, 30)}. {' '.join(near)} {words(rng, 9)}.", *[words(rng, 80) + "." for _ in range(10)], *AWKWARD]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in paragraph_dedup.spans(d).collect()}
    assert {1, 2} <= set(got) and not set(got) & {0, *range(3, 13)}
    assert all(0 in got[i]["of_docs"] and got[i]["n_words"] >= 36 for i in (1, 2))
    out = paragraph_dedup.clean(d)
    assert out.columns == d.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[0] == texts[0] and passage not in left[1] and left[len(texts) - len(AWKWARD)] is None
    assert paragraph_dedup.spans(d.filter("doc_id < 0")).count() == 0


def test_near_paragraphs_against_all_pairs(spark):
    """Components of MinHash candidates against all pairs of paragraphs: no wrong link, and nearly all right ones."""
    from lodestar.llm import words as W
    from lodestar.llm.sieve import Sieve
    from lodestar.llm.storage import keyed

    rng = random.Random(41)
    bases = [[f"b{i}x{j}" for j in range(rng.randint(24, 46))] for i in range(60)]
    texts = []
    for i in range(150):
        parts = []
        for b in rng.sample(bases, 3):
            c = b[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                c[rng.choice([0, 1, 2, -3, -2, -1])] = f"n{rng.randrange(10**6)}"
            parts.append(" ".join(c) + ".")
        texts.append(" ".join([*parts, " ".join(f"o{i}x{j}" for j in range(9)) + "."]))
    d = keyed(docs(spark, texts), "doc_id", "text")
    shared = jaccard_join.shared_keys(paragraph_dedup._keyed(d, "_text"))
    signed = paragraph_dedup._signed(d, spark.sparkContext.broadcast(Sieve(shared)), "_doc", "_text")
    roots = {r["sig"]: r["root"] for r in paragraph_dedup.clusters(d, signed, shared, "_doc", "_text").collect()}
    sets = {}
    for t in texts:
        w = W.words([t.encode()], W.LOWER)
        starts, ends = paragraph_dedup.paragraphs(w)
        own = lower(t).split()
        for x, y, sig in zip(starts, ends, paragraph_dedup._names(w, starts, ends).tolist()):
            sets[sig] = shingled(" ".join(own[x:y]), 5)
    sigs = list(sets)
    want = dict(zip(sigs, linked([sets[k] for k in sigs], 80)))
    together = lambda of, x, y: of.get(x, x) == of.get(y, y)
    pairs = [(x, y) for i, x in enumerate(sigs) for y in sigs[:i] if together(want, x, y)]
    found = [(x, y) for i, x in enumerate(sigs) for y in sigs[:i] if together(roots, x, y)]
    assert len(pairs) > 200 and set(found) <= set(pairs)
    assert len(found) >= 0.97 * len(pairs), (len(found), len(pairs))


def test_long_paragraphs_are_cut_by_their_words_alone():
    from lodestar.llm import words as W

    rng = random.Random(9)
    body = words(rng, 400)
    cuts = []
    for lead in ("", words(rng, 60) + " "):
        w = W.words([(lead + body).encode()], W.LOWER)
        off = len(lead.split())
        cuts.append({(int(a) - off, int(b) - off) for a, b in zip(*paragraph_dedup.paragraphs(w))})
    assert len(cuts[0] & cuts[1]) >= len(cuts[0]) - 3 > 5


def test_equal_runs_are_found_wherever_they_stand(spark):
    rng = random.Random(21)
    fresh = iter(range(10**6))

    def unique(n):
        return [f"u{next(fresh)}" for _ in range(n)]

    def marked(words, every):
        return " ".join(w + ("." if every and rng.random() < 1 / every else "") for w in words)

    texts, at = [], {}
    for n, every in ((24, 0), (51, 0), (51, 5), (51, 12), (60, 9), (80, 15), (80, 3)) * 4:
        passage = marked(unique(n), every)
        for copy in (0, 1):
            lead = rng.randint(0, 90)
            if copy:
                at[len(texts)] = (lead, lead + n, [len(texts) - 1])
            texts.append(" ".join([marked(unique(lead), 8), passage, marked(unique(rng.randint(0, 90)), 8)]).strip())
    # Documents 1 and 2 share a passage around a phrase that document 0 has alone.
    phrase, more = unique(40), len(texts)
    texts += [" ".join(unique(30) + phrase[12:24] + unique(30)), *[" ".join(unique(20) + phrase + unique(20)) for _ in range(2)]]
    at[more + 2] = (20, 60, None)
    got = {r["doc_id"]: r for r in paragraph_dedup.spans(docs(spark, texts)).collect()}
    assert set(got) == set(at)
    for i, (start, end, of) in at.items():
        r = got[i]
        # A sentence at an edge may be a near copy with a few foreign words at 0.8.
        assert r["start"] <= start and end <= r["end"] and r["n_words"] <= end - start + 12
        assert of is None or r["of_docs"] == of
    assert sum((r["start"], r["end"]) == at[i][:2] for i, r in got.items()) >= len(at) - 2


def _repeating(rng, n):
    """Texts of passages that share beginnings, ends and middles, some within one text."""
    pool = [words(rng, 90).split() for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p, a = rng.choice(pool), rng.randint(0, 50)
            parts += [*p[a : a + rng.randint(8, 60)], *words(rng, rng.randint(0, 9)).split()]
        texts.append(" ".join(parts))
    return texts + ["round and " * 40, texts[0], texts[0]]


def test_places_of_an_anchor_grow_in_one_shuffle(spark, monkeypatch):
    """One shuffle gives what the rounds give, and no round is run unless an anchor has more than HOT places."""
    texts = _repeating(random.Random(33), 30)
    d = docs(spark, texts, [*range(len(texts) - 3), None, 0, 5]).withColumn("doc_id", F.col("doc_id").cast("string"))
    tables, save = [], paragraph_dedup.saved
    monkeypatch.setattr(paragraph_dedup, "saved", lambda df, label: tables.append(label) or save(df, label))
    found = {}
    for hot in (4, 20_000):
        monkeypatch.setattr(paragraph_dedup, "HOT", hot)
        tables.clear()
        found[hot] = sorted(map(repr, paragraph_dedup.spans(d).collect()))
        assert ("rounds" in tables) == (hot < 20_000)
    assert len(found[4]) > 20 and found[4] == found[20_000]


def test_blocks_of_anchors_end_between_anchors(spark):
    from lodestar.llm.sieve import Sieve
    from lodestar.llm.storage import keyed

    d = keyed(docs(spark, _repeating(random.Random(34), 60)), "doc_id", "text")
    sieve = spark.sparkContext.broadcast(Sieve(jaccard_join.shared_keys(paragraph_dedup._keyed(d, "_text", "_doc"))))
    placed = paragraph_dedup._placed(d, sieve, "_doc", "_text", np.zeros(0, np.int64)).cache()
    every = [sorted(map(repr, paragraph_dedup.grown(placed, n).collect())) for n in (1, 7, 40_000)]
    assert len(every[0]) > 200 and every[0] == every[1] == every[2]


def _runs(rows):
    """(id, start, end, of_docs) of copies by text, those that touch as one."""
    by_text, out = defaultdict(list), []
    for r in rows:
        by_text[r["id"]].append((r["start"], r["end"], r["of_doc"]))
    for k, found in by_text.items():
        run = None
        for start, end, of in sorted(found):
            if run is None or start > run[1]:
                run = [start, end, set()]
                out.append((k, run))
            run[1] = max(run[1], end)
            run[2].add(of)
    return sorted(map(repr, ((k, a, b, sorted(map(repr, of))) for k, (a, b, of) in out)))


def test_parts_of_an_anchor_give_what_whole_ones_do(spark):
    from lodestar.llm.sieve import Sieve
    from lodestar.llm.storage import keyed

    d = keyed(docs(spark, _repeating(random.Random(35), 30)), "doc_id", "text")
    sieve = spark.sparkContext.broadcast(Sieve(jaccard_join.shared_keys(paragraph_dedup._keyed(d, "_text", "_doc"))))
    placed = paragraph_dedup._placed(d, sieve, "_doc", "_text", np.zeros(0, np.int64)).cache()
    whole = _runs(paragraph_dedup.grown(placed).collect())
    assert len(whole) > 30
    for n in (1, 5, 40_000):
        assert _runs(paragraph_dedup.equal_runs(placed, n).collect()) == whole


def test_places_that_a_text_repeats_are_one_row(spark, monkeypatch):
    """A line that stands hundreds of times in a text costs a row for each of the few contexts it has there."""
    from lodestar.llm.sieve import Sieve
    from lodestar.llm.storage import keyed

    rng = random.Random(36)
    line = words(rng, 9)
    d = docs(spark, [" ".join([words(rng, 30), *[line] * 300, words(rng, 30)]) for _ in range(6)])
    one = keyed(d, "doc_id", "text")
    sieve = spark.sparkContext.broadcast(Sieve(jaccard_join.shared_keys(paragraph_dedup._keyed(one, "_text", "_doc"))))
    placed = paragraph_dedup._placed(one, sieve, "_doc", "_text", np.zeros(0, np.int64))
    assert placed.count() < 6 * 20 and placed.selectExpr("sum(size(ats))").first()[0] > 6 * 290
    tables, save = [], paragraph_dedup.saved
    monkeypatch.setattr(paragraph_dedup, "saved", lambda df, label: tables.append(label) or save(df, label))
    monkeypatch.setattr(paragraph_dedup, "HOT", 400)  # over 1,700 places, but few rows
    got = {r["doc_id"]: r for r in paragraph_dedup.spans(d).collect()}
    assert "anchors" in tables and "rounds" not in tables
    assert sorted(got) == list(range(6)) and all(got[i]["start"] == 30 and 2730 <= got[i]["end"] <= 2732 for i in range(1, 6))  # a word beside the lines may be equal by chance


def test_ids_that_arrow_does_not_order(spark):
    d = docs(spark, _repeating(random.Random(37), 20))
    known = [tuple(r) for r in paragraph_dedup.spans(d).collect()]
    for kind in ("double", "decimal(20,2)"):
        found = paragraph_dedup.spans(d.withColumn("doc_id", F.col("doc_id").cast(kind))).collect()
        assert sorted(known) == sorted((int(i), *rest, [int(x) for x in of]) for i, *rest, of in found)


def test_least_of_windows():
    rng = np.random.default_rng(3)
    for width in (1, 2, 5, 16, 17, 25):
        h = rng.integers(0, 9, 200).astype(np.uint64)
        low, at = paragraph_dedup._least(h, width)
        view = np.lib.stride_tricks.sliding_window_view(h, width)
        assert (low == view.min(axis=1)).all() and (at == np.arange(len(view)) + view.argmin(axis=1)).all()
    assert [len(x) for x in paragraph_dedup._least(h[:3], 5)] == [0, 0]


def test_words_between_copies_stay(spark):
    rng = random.Random(22)
    lines = ["the first line that both of them have here", "the last line that both of them have too"]
    middle = ["\n".join(" ".join(f"{c}{i}x{j}" for j in range(7)) for i in range(50)) for c in "ab"]
    texts = ["\n".join([lines[0], m, lines[1]]) for m in middle]
    assert paragraph_dedup.spans(docs(spark, texts)).count() == 0
    passages = [words(rng, 30) + "." for _ in range(2)]
    texts = ["\n".join([passages[0], m, passages[1]]) for m in middle]
    left = {r["doc_id"]: r["text"] for r in paragraph_dedup.clean(docs(spark, texts)).collect()}
    assert left[0] == texts[0] and left[1].strip() == middle[1]


def test_wrappers(spark):
    page = '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><!-- c --><div class="cookie-notice">ok?</div><div class="ad">buy</div><article><h1>T&amp;{i}</h1>{ps}<form>f</form></article><div id="comments">c{i}</div><aside>s</aside><footer>&copy; x</footer></body></html>'
    pages = [(i, "http://h.example/a", page.format(i=i, nav="<li><a>m</a></li>" * (1 + i % 3), ps="".join(f"<p>par  {j}<br>of <b>p{i}</b>x" for j in range(i)))) for i in range(6)]
    plain = "<html><body><div class=menu><a href=/>home</a></div><div><p>Main <i>text</i> of a page without an article element, long enough to win.</p><p>second</p></div></body></html>"
    pages += [(10, None, plain), (11, None, None), (12, "", ""), (13, "http://h.example/b", pages[2][2][:-200]), (13, "x:y", "just text & more"), (14, None, "<p>" * 3000 + "deep")]
    d = spark.createDataFrame([(*p, "z") for p in pages], "page_id bigint, url string, html string, host string")
    got = defaultdict(list)
    found = html_wrappers.wrappers(d)
    for r in html_wrappers.extract(d, found).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i in range(6):
        assert got[i] == [" ".join([f"T&{i}"] + [f"par {j} of p{i}x" for j in range(i)])]
    assert got[10] == ["Main text of a page without an article element, long enough to win. second"]
    assert got[11] == [""] and got[12] == [""] and "just text & more" in got[13]
    e = found.filter("host = 'h.example'").first()["expression"]
    assert "<nav>#</nav>" in e and "(<article>#<form>#</form></article>)?" in e
    assert html_wrappers.extract(d.limit(0), html_wrappers.wrappers(d.limit(0))).count() == 0


def ends(kids, items, starts):
    """Where a row of the wrapper's expression may end among a page's siblings, from any of `starts`."""
    i = 0
    while i < len(kids):
        label, optional, repeated, inside = kids[i]
        if repeated:
            group, new, found = [[label, optional, 0, inside], *kids[i + 1 : i + repeated]], starts, set()
            while new:
                new = ends(group, items, new) - found
                found |= new
            starts, i = found, i + repeated
        else:
            on = {s + 1 for s in starts if s < len(items) and items[s][0] == label and (label == "#" or len(items[s][3]) in ends(inside, items[s][3], {0}))}
            starts, i = on | (starts if optional else set()), i + 1
    return starts


def fullmatch(wrapper, page):
    """Whether the wrapper, as a regular expression, matches the page's own tokens: all ways to match, step by step."""
    kids = html_wrappers.Page(page).root[3]
    return len(kids) in ends(wrapper[3], kids, {0})


def test_wrappers_match_all_their_pages():
    rng = random.Random(17)

    def row(depth):
        out = []
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(["<p>t</p>", "text", "<section>s</section>", '<div class="a">', '<div class="b">', "<main>"])
            if x.endswith('">') or x == "<main>":
                x += (row(depth + 1) if depth < 3 else "deep") + ("</main>" if x == "<main>" else "</div>")
            out += [x] * rng.choice([1, 1, 2, 3])
        return "".join(out * rng.choice([1, 1, 2]))

    for _ in range(60):
        pages = [f"<html><body>{row(0)}</body></html>" for _ in range(rng.randint(1, 5))]
        trees = [html_wrappers.Page(p).folded().root for p in pages]
        for p, tree in zip(pages, trees):
            assert fullmatch(tree, p), p
        cut = rng.randint(1, len(trees))
        parts = [x for x in (trees[:cut], trees[cut:]) if x]
        whole = html_wrappers.merged([html_wrappers.merged(x) for x in parts])
        for p in pages:
            assert fullmatch(whole, p), (html_wrappers.expression(whole), p)


@pytest.mark.parametrize(("group", "hosts"), [(64, 20_000), (2, 20_000), (64, 0)])
def test_wrappers_tell_templates_apart_where_a_page_cannot(spark, monkeypatch, group, hosts):
    """One host, two templates without telling names: the longest text of a page is the
    template's own, and only the other pages of the host tell that it never changes."""
    monkeypatch.setattr(html_wrappers, "GROUP", group)
    monkeypatch.setattr(html_wrappers, "MAX_HOSTS", hosts)
    rng = random.Random(18)
    about = "We have been writing about all of this for many years and always will be. " * 8
    one = "<html><body><div class='qa'><p>{a}</p></div><div class='qb'>{ps}</div></body></html>"
    two = "<html><body><table><tr><td>{ps}</td></tr></table><section><p>{a}</p></section></body></html>"
    pages, want = [], {}
    for i in range(40):
        ps = [words(rng, rng.randint(5, 12)) for _ in range(rng.randint(1, 4))]
        pages.append((i, "https://t.example/x", (one if i % 2 else two).format(a=about, ps="".join(f"<p>{p}</p>" for p in ps)), "z"))
        want[i] = " ".join(ps)
    d = spark.createDataFrame(pages, "page_id bigint, url string, html string, host string").repartition(6)
    found = html_wrappers.wrappers(d)
    assert [r["pages"] for r in found.collect()] == [40]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(d, found).collect()}
    assert got == want
    for i in range(8):  # a page alone takes the longer text
        alone = html_wrappers.Reader(html_wrappers.Page(pages[i][2]).folded().root).text(pages[i][2])
        assert about.split()[0] in alone
    whole = json.loads(found.first()["wrapper"])
    assert all(fullmatch(whole, p[2]) for p in pages)


def test_copies_of_an_article_stay(spark):
    page = "<html><body><nav>{n}</nav><div>{a}</div><div class='promo'>buy {n}</div></body></html>"
    d = spark.createDataFrame([(i, "https://c.example/", page.format(n=f"menu {i}", a="the same article on all of these pages, word for word"), "z") for i in range(30)], "page_id bigint, url string, html string, host string")
    got = {r["text"] for r in html_wrappers.extract(d, html_wrappers.wrappers(d)).collect()}
    assert got == {"the same article on all of these pages, word for word"}


def test_deep_and_long_pages():
    import time

    rng = random.Random(19)
    long = "".join(rng.choice(["<div class=a>x</div>", "<div class=b>y</div>", "<section>z</section>", "w"]) for _ in range(15_000))
    for page in ("<div>" * 5000 + "deep" + "</div>" * 5000, "<p>" * 50_000 + "deep", long, "<a>" * 20_000 + "x", "<" * 100_000 + "x"):
        began = time.process_time()
        tree = html_wrappers.Page(page).folded().root
        html_wrappers.Reader(html_wrappers.merged([json.loads(json.dumps(tree)), tree])).text(page)
        assert time.process_time() - began < 20


def test_neighbour_votes(spark):
    rng = random.Random(11)
    good = [words(rng, 60).capitalize() + "." for _ in range(60)]
    bad = [" | ".join(words(rng, 1) for _ in range(50)) for _ in range(40)]
    texts = good + bad + AWKWARD
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(3, None), (None, 1), (999, 1)], "doc_id bigint, quality int")
    model = knn_quality.fit(d, labels)
    got = {r["doc_id"]: r for r in knn_quality.score(d, model).collect()}
    import zlib

    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(100))
    assert len(model.labels) == 100 - len(held)
    assert sum((got[i]["score"] >= 0.3) == (i < 60) for i in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(got[len(good + bad) + i]["score"] == 0 for i in (0, 1, 2, 3))
    none = knn_quality.score(d, knn_quality.fit(d, labels.limit(0))).first()
    assert none["score"] == 0
    assert knn_quality.score(d.limit(0), model).count() == 0
    # The vote by brute force: all cosines one by one, the nearest summed in plain Python.
    for i in range(0, 100, 7):
        v = model.place(knn_quality.features([texts[i].encode()]))[0]
        near = sorted(((sum(float(a) * float(b) for a, b in zip(v, u)), float(y)) for u, y in zip(model.vectors, model.labels)), reverse=True)[: model.neighbours]
        want = sum(max(c, 0) * y for c, y in near) / sum(max(c, 0) for c, _ in near)
        assert abs(got[i]["score"] - want) < 1e-4
    twice = d.limit(60).union(d.limit(60).withColumn("text", F.lit("zz")))
    assert len(knn_quality.fit(twice, labels).labels) == len(knn_quality.fit(d.limit(60), labels).labels)


def test_words_tell_texts_of_one_style_apart(spark):
    rng = random.Random(13)
    make = lambda pool: " ".join(rng.choice(pool) for _ in range(60)).capitalize() + "."
    pools = [[f"{a}{b}ing" for a in "bcdfg" for b in vowels] for vowels in ("aei", "ouy")]
    texts = [make(pools[i % 2]) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, quality int")
    got = knn_quality.score(docs(spark, texts), knn_quality.fit(docs(spark, texts), labels)).filter("held_out").collect()
    assert len(got) > 10 and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)


def test_empty_tables(spark):
    d = docs(spark, ["x"]).limit(0)
    assert quality_rules.judge(d).count() == bpe.token_counts(d).count() == bpe.encode(d).count() == pii.find(d).count() == jaccard_join.classes(d).count() == 0


def test_operators_leave_one_table_and_no_setting(spark):
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    tables = lambda: set(os.listdir(base)) if os.path.isdir(base) else set()
    before, rows = tables(), spark.conf.get(key)
    d = docs(spark, ["a b c d e f g h"] * 3 + ["other words stand in here now"])
    out = jaccard_join.classes(d)
    assert {r["component_id"] for r in out.collect()} == {0, 3}
    assert len(tables() - before) == 1 and spark.conf.get(key) == rows
